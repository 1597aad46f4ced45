"""Document blocks and the key exchange between them.

A corpus is written once as blocks of some MB of whole texts. To learn how often a key (a hash of
some part of a text) occurs in the corpus, each block sends its distinct keys with their counts,
dealt into even key ranges; each range is sorted by one task, and a reply of 4 bytes a key goes
back to the block. A key that is in a third of all documents is still at most one entry a block,
so no range grows with a hot key, and nothing passes through the driver.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import fanout, save, text_bytes, trim

BLOCK_BYTES = 4 << 20
SENT = "kind string, bucket int, block long, payload binary"
SENT_ARROW = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())])


def pack(x: object, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(x, protocol=5))


def unpack(x: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(x))


def sent(rows: list[tuple[str, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SENT_ARROW.types, strict=True)] if rows else [pa.array([], t) for t in SENT_ARROW.types], schema=SENT_ARROW)


class Block:
    """Whole texts (UTF-8; null is empty) with their ids, in one order for good."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.ids, self.texts = ids, texts

    def packed(self) -> bytes:
        return pack((self.ids, self.texts), 6)  # read and moved several times

    @staticmethod
    def of(payload: bytes) -> Block:
        return Block(*unpack(payload))


def _gaps(keys: np.ndarray) -> np.ndarray | tuple[int, np.ndarray]:
    """Ascending keys of 48 bits (the lowest 16 are 0) as the first one and 32-bit gaps, where they fit."""
    high = keys >> np.uint64(16)
    gaps = np.diff(high)
    if len(keys) and not (keys & np.uint64(0xFFFF)).any() and (not len(gaps) or int(gaps.max()) < 1 << 32):
        return int(high[0]), gaps.astype(np.uint32)
    return keys


def _ungap(x: np.ndarray | tuple[int, np.ndarray]) -> np.ndarray:
    if isinstance(x, tuple):
        return np.cumsum(np.concatenate([np.array([x[0]], np.uint64), x[1].astype(np.uint64)]), dtype=np.uint64) << np.uint64(16)
    return x


#: Keys that only nominate candidates need no more than these bits.
NOMINATE = np.uint64(0xFFFFFFFFFFFF0000)


class Keys:
    """Distinct keys (64 bits, or 128 as two columns) in ascending order, with counts; inverse leads from what was given to them."""

    def __init__(self, one: np.ndarray, two: np.ndarray | None = None):
        if two is None:
            self.one, self.inverse, self.count = np.unique(one, return_inverse=True, return_counts=True)
            self.two = None
        else:
            order = np.lexsort((two, one))
            a, b = one[order], two[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            self.inverse = np.empty(len(a), np.int64)
            self.inverse[order] = np.cumsum(new) - 1
            self.one, self.two = a[new], b[new]
            self.count = np.diff(np.append(np.flatnonzero(new), len(a)))

    def messages(self, kind: str, block: int, buckets: int, least_of: int = 1) -> Iterator[tuple[str, int, int, bytes]]:
        for k, a, b in spread(self.one, buckets, least_of):
            yield kind, k, block, pack((_gaps(self.one[a:b]), None if self.two is None else self.two[a:b], self.count[a:b].astype(np.uint32)))


def spread(keys: np.ndarray, buckets: int, least_of: int = 1) -> list[tuple[int, int, int]]:
    """Ascending keys by ranges that hold as many of them each: (range, first, last + 1).

    least_of: each key is the least of so many hashes, which crowd at the lower end.
    """
    share = -np.expm1(least_of * np.log1p(-np.minimum(keys.astype(float) / 2.0**64, 1 - 2.0**-53)))
    to = np.minimum((share * buckets).astype(np.int64), buckets - 1)
    cut = np.flatnonzero(np.diff(to)) + 1
    at = np.concatenate([[0], cut, [len(keys)]]).astype(int)
    return [(int(to[a]), a, b) for a, b in zip(at[:-1], at[1:], strict=True) if b > a]


def ranges(docs: DataFrame) -> int:
    """Number of key ranges for a corpus, from the bytes of its texts."""
    return fanout(docs.sparkSession, text_bytes(docs))


def scan(docs: DataFrame, send: Callable[[Block, int, int], Iterator[tuple]], name: str, buckets: int) -> DataFrame:
    """Write blocks of docs (doc_id, text) and what send() has to say of each; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, n, ids, texts, size = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def out() -> pa.RecordBatch:
            block = Block(ids, texts)
            return sent([("text", 0, base + n, block.packed()), *send(block, base + n, buckets)])

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                t = t.as_py()
                ids.append(i.as_py())
                texts.append(b"" if t is None else t.encode())
                size += len(texts[-1]) + 64
                if size >= BLOCK_BYTES:
                    yield out()
                    n, ids, texts, size = n + 1, [], [], 0
        if ids:
            yield out()

    return save(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, SENT), name, by="kind", codec="uncompressed")


def resolve(messages: DataFrame) -> DataFrame:
    """Replies to Keys.messages: for each key 2 x its count in all blocks, plus 1 for the first block that has it."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        got = [(_ungap(one), *rest) for one, *rest in (unpack(x.as_py()) for x in table["payload"])]
        one = np.concatenate([x[0] for x in got])
        two = np.concatenate([x[1] for x in got]) if got[0][1] is not None else None
        count = np.concatenate([x[2] for x in got]).astype(np.int64)
        order = np.argsort(one, kind="stable") if two is None else np.lexsort((two, one))
        new = np.ones(len(one), bool)
        new[1:] = np.diff(one[order]) != 0
        if two is not None:
            new[1:] |= np.diff(two[order]) != 0
        total = np.add.reduceat(count[order], np.flatnonzero(new)) if len(order) else count
        reply = np.empty(len(one), np.uint32)
        reply[order] = 2 * np.minimum(total[np.cumsum(new) - 1], 1 << 30) + new
        ends = np.cumsum([len(x[0]) for x in got])
        return pa.Table.from_arrays([table["kind"], table["bucket"], table["block"], pa.array([pack(reply[e - len(x[0]) : e]) for x, e in zip(got, ends, strict=True)], pa.binary())], schema=SENT_ARROW)

    return messages.groupBy("kind", "bucket").applyInArrow(run, SENT)


def replies(table: pa.Table, kind: str) -> np.ndarray:
    """A block's replies of one kind, in the order of its keys."""
    mine = table.filter(pc.equal(table["kind"], kind)).sort_by("bucket")
    return np.concatenate([np.zeros(0, np.uint32), *(unpack(x.as_py()) for x in mine["payload"])])


def meet(texts: DataFrame, answers: DataFrame, f: Callable[[Block, pa.Table, int], pa.Table], schema: str) -> DataFrame:
    """Each block again, with all that came back for it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        # the payload is one row: a block id is written once
        out = f(Block.of(left["payload"][0].as_py()), right, left["block"][0].as_py())
        trim()
        return out

    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
