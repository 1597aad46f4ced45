"""Exact removal of repeated word windows, found through difference-cover anchors.

Only windows at word positions p with p mod 21 in a perfect difference set are hashed first
(5 of 21). For any two positions i, j there is a shift below 21 that brings both onto the cover,
so two equal windows of 35 words share an aligned anchor of 15 words. Anchors that occur twice in
the corpus are extended to the windows around them. Those are compared over the corpus by two
polynomials modulo the prime 2**61 - 1 (122 bits), whole texts by 128 bits of BLAKE2b.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .blocks import NOMINATE, SENT, Block, Keys, meet, pack, ranges, replies, resolve, scan, sent, unpack
from .hashing import Words, covered, digest, runs
from .store import discard, release, save, ship

# Perfect difference sets, period -> residues whose differences are all residues.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}

SCHEMA = "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string"


class Cover:
    """Anchor positions for windows of so many words."""

    def __init__(self, window: int):
        self.window = window
        # the largest period that leaves anchors of some words; without one every position is an anchor
        fit = [p for p in COVERS if window - p + 1 >= max(2, window // 3)]
        self.period = max(fit, default=1)
        self.mask = np.zeros(self.period, bool)
        self.mask[list(COVERS.get(self.period, (0,)))] = True
        self.size = window - self.period + 1

    def at(self, n: int) -> np.ndarray:
        """Anchors of a text of n words."""
        p = np.arange(max(0, n - self.size + 1)) if n >= self.window else np.zeros(0, np.int64)
        return p[self.mask[p % self.period]]


def _anchors(block: Block, cover: Cover) -> tuple[list[Words], list[np.ndarray], Keys, Keys, np.ndarray]:
    words = [Words(t) for t in block.texts]
    at = [cover.at(w.n) for w in words]
    keys = Keys(np.concatenate([np.zeros(0, np.uint64), *(w.windows(cover.size, at=a) & NOMINATE for w, a in zip(words, at, strict=True) if len(a))]))
    long = np.array([k for k, w in enumerate(words) if w.n >= cover.window], np.int64)
    prints = np.array([digest(words[k].text) for k in long], np.uint64).reshape(-1, 2)
    return words, at, keys, Keys(prints[:, 0], prints[:, 1]), long


def _candidates(block: Block, answers: pa.Table, no: int, cover: Cover, buckets: int) -> pa.Table:
    words, at, keys, copies, long = _anchors(block, cover)
    total, copied = replies(answers, "anchor") >> 1, replies(answers, "copy")
    n_copies, ones, twos, where = np.ones(len(words), np.int64), [], [], []
    first = np.zeros(len(words), bool)
    seen: set[int] = set()
    for k, x in zip(long, copies.inverse, strict=True):
        n_copies[k] = copied[x] >> 1
        first[k] = bool(copied[x] & 1) and x not in seen
        seen.add(x)
    done = 0
    for k, (w, a) in enumerate(zip(words, at, strict=True)):
        mine = keys.inverse[done : done + len(a)]
        done += len(a)
        if not first[k] or not len(a):
            continue
        _, back, times = np.unique(mine, return_inverse=True, return_counts=True)
        times = times[back]
        # what only the copies of this text have needs no windows: a text with copies goes as a whole
        shared = a[(total[mine] > n_copies[k] * times) | ((times > 1) & (n_copies[k] == 1))]
        if len(shared):
            lo = np.maximum(shared - cover.period + 1, 0)
            at_windows = np.flatnonzero(covered(w.n - cover.window + 1, lo, shared - lo + 1))
            ones.append(w.windows(cover.window, 0, at_windows))
            twos.append(w.windows(cover.window, 1, at_windows))
            where.append((k, at_windows))
    none = np.zeros(0, np.uint64)
    found = Keys(np.concatenate([none, *ones]), np.concatenate([none, *twos]))
    state = [(k, x.astype(np.int32)) for k, x in where], found.inverse.astype(np.int32), n_copies > 1
    return pa.Table.from_batches([sent([("state", 0, no, pack(state)), *found.messages("window", no, buckets)])])


def _removed(block: Block, answers: pa.Table, window: int) -> pa.Table:
    state = answers.filter(pc.equal(answers["kind"], "state"))
    where, inverse, copy = unpack(state["payload"][0].as_py())
    twice = (replies(answers, "window") >> 1) >= 2
    found, done = {}, 0
    for k, at in where:
        found[k] = at[twice[inverse[done : done + len(at)]]].astype(np.int64)
        done += len(at)
    rows = []
    for k, text in enumerate(block.texts):
        words = text.split()
        n = len(words)
        gone = np.ones(n, bool) if copy[k] else covered(n, found[k], window) if k in found else np.zeros(n, bool)
        spans = [{"start": int(a), "end": int(b)} for a, b in zip(*runs(gone), strict=True)]
        kept = b" ".join([w for w, g in zip(words, gone, strict=True) if not g] if spans else words)
        rows.append((block.ids[k], n, int(gone.sum()), spans, kept.decode()))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "spans", "kept"])


def repeated_windows(docs: DataFrame, window: int = 35) -> DataFrame:
    """Remove each word covered by a window whose word sequence also starts anywhere else.

    docs: doc_id, text; other columns are ignored. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.
    Returns one row per input row: doc_id, n_words, n_removed, spans (removed word ranges, end
    exclusive) and kept (kept words joined by one space). Null and empty texts, and texts shorter
    than a window, lose nothing; a repeated row is a copy like any other, so both lose all their
    words if they have a window; a null doc_id stays null; an empty table gives an empty result.
    """
    spark, cover = docs.sparkSession, Cover(window)
    ship(spark)
    buckets = ranges(docs)

    def send(block: Block, no: int, buckets: int):
        _, _, keys, copies, _ = _anchors(block, cover)
        yield from keys.messages("anchor", no, buckets)
        yield from copies.messages("copy", no, buckets)

    table = scan(docs, send, "substring", buckets)
    texts = table.where("kind = 'text'")
    first = resolve(table.where("kind IN ('anchor', 'copy')"))
    found = save(meet(texts, first, lambda b, t, no: _candidates(b, t, no, cover, buckets), SENT), "windows", by="kind", codec="uncompressed")
    del first
    discard(table, "kind = 'anchor'")
    release(spark)
    second = resolve(found.where("kind = 'window'")).unionByName(found.where("kind = 'state'"))
    return meet(texts, second, lambda b, t, no: _removed(b, t, window), SCHEMA)
