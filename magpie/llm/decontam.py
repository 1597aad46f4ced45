"""Benchmark decontamination by spaced-seed hashing.

Six fixed masks of six words each look at some words of a short span and ignore the others. Any 13
words of which at most 3 were replaced agree with the original under one of the masks at some
place. Seeds of the benchmark are joined with those of the training texts; each hit gives a
diagonal (place in the text minus place in the item), and the words along it are compared: 13
words in a row with at least 10 equal ones are an overlap. Items under 11 words are shorter than
what the masks need; they are hashed as a whole, with each allowed set of changed places left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Words, covered, mix, runs
from .store import fresh, save, ship

# Word places that each mask looks at.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 7, 8, 9), (0, 1, 2, 3, 4, 5), (0, 1, 4, 6, 9, 10), (0, 1, 5, 6, 8, 9), (0, 1, 2, 3, 5, 6))
WINDOW, EQUAL = 13, 10


def least_equal(size: int) -> int:
    """Equal words that so many in a row need."""
    return -(-EQUAL * size // WINDOW)


#: Places that are kept of an item of so many words, one mask for each set that may be changed.
SHORT = {n: tuple(combinations(range(n), least_equal(n))) for n in range(1, 11)}
#: Masks by number; those of short items follow, from FIRST[words] on.
EVERY = MASKS + tuple(m for n in SHORT for m in SHORT[n])
FIRST = {n: len(MASKS) + sum(len(SHORT[k]) for k in range(1, n)) for n in SHORT}
#: Benchmark words in one block of the query set; each block is one more step of the same job.
BLOCK_WORDS = 1_000_000
#: Hits of seeds that are looked at together.
HITS = 1_000_000
SPANS = "array<struct<item_id: long, start: long, end: long, equal: long>>"


def normal(text: str | None) -> bytes:
    """Lower case (A-Z), without ASCII punctuation."""
    return b"" if text is None else text.encode().lower().translate(None, b".,;:!?\"'()[]{}")


def word_hashes(text: str | None) -> np.ndarray:
    return Words(normal(text)).windows(1)


def seeds(w: np.ndarray, mask: int) -> np.ndarray:
    """The hashes of one mask at all places of a word sequence."""
    places = EVERY[mask]
    n = len(w) - places[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, mask + 1, np.uint64)
    for p in places:
        out = out * np.uint64(0x9E3779B97F4A7C15) + w[p : p + n]
    return mix(out)


class SeedIndex:
    """Seeds of a block of benchmark items, sorted, with their items and places."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.words = [word_hashes(t) for _, t in items]
        # a short item has to agree as a whole, with the same share of equal words
        self.size = [min(WINDOW, len(w)) for w in self.words]
        parts, used = [], set()
        for k, w in enumerate(self.words):
            short = FIRST.get(len(w))
            for m in range(len(MASKS)) if short is None else range(short, short + len(SHORT[len(w)])):
                h = seeds(w, m)
                if len(h):
                    # a short item has one place
                    parts.append((h if short is None else h[:1], k))
                    used.add(m)
        #: Masks that some item needs.
        self.masks = sorted(used)
        hashes = np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in parts)])
        owner = np.concatenate([np.zeros(0, np.int64), *(np.full(len(h), k) for h, k in parts)])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(h)) for h, _ in parts)])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner, self.place = hashes[order], owner[order], place[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def overlaps(self, w: np.ndarray) -> list[dict]:
        """Overlaps of a text's words with the items: item_id, word range, equal words in it."""
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for m in self.masks:
            h = seeds(w, m)
            at = np.flatnonzero(self.maybe[(h & np.uint64(0xFFFFF)).astype(np.int64)])
            lo, hi = (np.searchsorted(self.hashes, h[at], side) for side in ("left", "right"))
            at, lo, hi = (x[hi > lo] for x in (at, lo, hi))
            if len(at):
                hits.append((at, lo, hi))
        if not hits:
            return []
        at, lo, hi = (np.concatenate(x) for x in zip(*hits, strict=True))
        # hits of each item, from the sums of the items' shares in the ranges of the index
        touched, times = np.unique(np.stack([lo, hi]), axis=1, return_counts=True)
        n_hits = np.zeros(len(self.words), np.int64)
        for a, b, n in zip(*touched.tolist(), times.tolist(), strict=True):
            np.add.at(n_hits, self.owner[a:b], n)
        # where hits outnumber diagonals (words that are repeated on both sides), all diagonals are compared
        lengths = np.array([len(x) for x in self.words])
        every = n_hits > len(w) + lengths
        pairs = [np.stack([np.full(len(w) + n - 1, k), np.arange(1 - n, len(w))]) for k, n in zip(np.flatnonzero(every).tolist(), lengths[every].tolist(), strict=True)]
        step = max(1, HITS // max(1, int((hi - lo).max())))
        for k in range(0, len(at), step):
            size = hi[k : k + step] - lo[k : k + step]
            entry = np.repeat(lo[k : k + step] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            text_at = np.repeat(at[k : k + step], size)
            rare = ~every[self.owner[entry]]
            entry, text_at = entry[rare], text_at[rare]
            pairs.append(np.unique(np.stack([self.owner[entry], text_at - self.place[entry]]), axis=1))
        diagonals = np.unique(np.concatenate(pairs, axis=1), axis=1).T.tolist()
        found = []
        for k, d in diagonals:
            item, size = self.words[k], self.size[k]
            a, b = max(0, d), min(len(w), d + len(item))
            if b - a < size:
                continue
            equal = w[a:b] == item[a - d : b - d]
            sums = np.concatenate([[0], np.cumsum(equal)])
            good = np.flatnonzero(sums[size:] - sums[:-size] >= least_equal(size))
            for x, y in zip(*runs(covered(b - a, good, size)), strict=True):
                found.append({"item_id": self.ids[k], "start": a + int(x), "end": a + int(y), "equal": int(sums[y] - sums[x])})
        return found


def _searched(docs: DataFrame, index: SeedIndex, text: str, into: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("equal", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(into)
            texts = batch.column(batch.schema.get_field_index(text))
            found = [old.as_py() + shared.value.overlaps(word_hashes(t.as_py())) for old, t in zip(batch.column(at), texts, strict=True)]
            yield batch.set_column(at, into, pa.array(found, kind))

    return docs.mapInArrow(run, docs.schema)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", into: str = "overlaps") -> DataFrame:
    """docs with a column of the word ranges shared with benchmark items.

    benchmark: item_id, text. Every item is searched in every document; the items are a stated
    query set, taken in blocks of bounded size, whose seeds each task gets. An overlap has 13 words
    in a row with at least 10 equal ones, or a shorter item's full length with the same share
    (below 5 words: all equal). Null and empty texts have no overlaps; repeated rows and items are
    treated alike, items of one id are all searched; an empty benchmark finds nothing; an empty
    table stays empty. Other columns are kept, whatever their names; a column with the name of the
    new one is replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + total // (4 * BLOCK_WORDS)
    whole = fresh("text", docs.withColumn(into, F.lit(0)))
    out = docs.withColumn(whole, F.col(text).cast("string")).withColumn(into, F.array().cast(SPANS))
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        # bounded by the block size
        index = SeedIndex(sorted(((r.item_id, r.text) for r in block.collect()), key=repr))
        if k:
            out = save(out, "overlaps")
        if len(index.hashes):
            out = _searched(out, index, whole, into)
    return out.drop(whole)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that overlap with a benchmark item, same columns."""
    into = fresh("overlaps", docs)
    return contamination(docs, benchmark, into=into).where(F.size(into) == 0).drop(into)
