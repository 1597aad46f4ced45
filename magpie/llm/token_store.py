"""Token shards in Simple-8b word-aligned coding.

A shard file (little-endian)::

    magic "S8B1" | u32 documents | u32 tokens per block | u32 blocks | u64 ids | u64 words
    u32 tokens of each document, u32 first word of each block (blocks + 1 of them), u64 words

Each 64-bit word has a selector in its upper 4 bits and packs that selector's count of ids in
equal bit fields, from the lowest bits up. Selector 15 is an escape: the word holds one id of up to
60 bits. A block has a fixed count of ids (the last one may have fewer) and starts with a new word,
so blocks are decoded alone and all words of a selector at once.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import save, ship, workdir
from .tokens import encoder

# Ids in a word and bits of each, by selector.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
BLOCK = 8192
_LIMITS = np.array([(1 << b) - 1 for b in BITS], np.uint64)
_NEED = np.searchsorted(_LIMITS, np.arange(1 << 17, dtype=np.uint64)).astype(np.uint8)
SHARD_BYTES = 16 << 20
HEAD = struct.Struct("<4sIIIQQ")


def encode_words(ids: np.ndarray) -> np.ndarray:
    """The words of one block. The first two selectors (runs of zeros) and all others pack greedily: as many ids as fit."""
    n = len(ids)
    x = ids.astype(np.uint64)
    # the least selector whose fields hold each id
    need = _NEED[ids] if n and int(ids.max()) < len(_NEED) else np.searchsorted(_LIMITS, x).astype(np.uint8)
    # the first selector whose ids, from here on, all fit its fields
    pick = np.full(n, 15, np.uint8)
    for s in range(14, (int(need.min()) if n else 15) - 1, -1):
        good, size = need <= s, 1
        while size < COUNTS[s] and good.any():
            step = min(size, COUNTS[s] - size)
            good, size = good[:-step] & good[step:] if len(good) > step else good[:0], size + step
        if size == COUNTS[s]:
            pick[: len(good)][good] = s
    choice = pick.tolist()
    at, i = [], 0
    while i < n:
        at.append(i)
        i += COUNTS[choice[i]]
    at = np.array(at, np.int64)
    chosen = np.array(choice, np.int64)[at] if n else at
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        if BITS[s]:
            mine = np.flatnonzero(chosen == s)
            k = np.arange(COUNTS[s])
            words[mine] |= np.bitwise_or.reduce(x[at[mine, None] + k] << (k * BITS[s]).astype(np.uint64), axis=1)
    return words


def decode_words(words: np.ndarray) -> np.ndarray:
    """The ids of some words, selector by selector."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS)[chosen]
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(chosen):
        if BITS[s]:
            mine = np.flatnonzero(chosen == s)
            shifts = np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(BITS[s])
            values = (words[mine, None] >> shifts) & np.uint64((1 << BITS[s]) - 1)
            out[(at[mine, None] + np.arange(COUNTS[s])).ravel()] = values.ravel()
    return out


def shard(ids: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> bytes:
    parts = [encode_words(ids[k : k + block]) for k in range(0, len(ids), block)]
    first = np.cumsum([0, *map(len, parts)]).astype("<u4")
    words = np.concatenate([np.zeros(0, np.uint64), *parts]).astype("<u8")
    return HEAD.pack(b"S8B1", len(lengths), block, len(parts), len(ids), len(words)) + lengths.astype("<u4").tobytes() + first.tobytes() + words.tobytes()


def unshard(data: bytes, blocks: range | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, tokens of each document) of a shard, or the ids of some of its blocks."""
    magic, docs, block, n, total, n_words = HEAD.unpack_from(data)
    if magic != b"S8B1":
        raise ValueError("not a token shard")
    lengths = np.frombuffer(data, "<u4", docs, HEAD.size)
    first = np.frombuffer(data, "<u4", n + 1, HEAD.size + 4 * docs)
    words = np.frombuffer(data, "<u8", n_words, HEAD.size + 4 * (docs + n + 1))
    a, b = (0, n) if blocks is None else (blocks.start, blocks.stop)
    return decode_words(words[first[a] : first[b]]), lengths


def write_shards(docs: DataFrame, path: str, tokenizer: str, end: int) -> DataFrame:
    """Encode whole texts, append the end id, and write shards in ascending doc_id order below path.

    Partitions are ranges of doc_id; each writes files of bounded size, put in place by a rename, so
    a task that runs again leaves the same files. Returns the table of shards: partition, shard,
    file, n_docs, n_tokens. A null text is empty; null doc_ids come first; rows that share a doc_id
    are ordered by their text; an empty table has no shards.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    ordered = docs.select(columns).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(path)
        enc, part, no, size = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        doc_ids: list = []
        chunks: list[bytes] = []
        last = np.array([end], "<u4").tobytes()

        def out() -> pa.RecordBatch:
            nonlocal no, doc_ids, chunks, size
            lengths = np.array([len(x) // 4 for x in chunks])
            ids = np.frombuffer(b"".join(chunks), "<u4")
            name, attempt = f"{root}/{part:06d}-{no:05d}.s8b", TaskContext.get().taskAttemptId()
            with fs.open_output_stream(f"{name}.{attempt}") as f:
                f.write(shard(ids, lengths))
            fs.move(f"{name}.{attempt}", name)
            row = [[part], [no], [f"{path}/{part:06d}-{no:05d}.s8b"], [doc_ids], [len(chunks)], [len(ids)]]
            no, doc_ids, chunks, size = no + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=["partition", "shard", "file", "doc_ids", "n_docs", "n_tokens"])

        kinds = [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
        for batch in batches:
            for i, ids in zip(batch.column(0), enc.encode(x.as_py() for x in batch.column(1)), strict=True):
                doc_ids.append(i.as_py())
                chunks.append(ids + last)
                size += len(chunks[-1])
                if size >= SHARD_BYTES:
                    yield out()
        if chunks:
            yield out()

    return save(ordered.mapInArrow(run, "partition int, shard int, file string, doc_ids array<long>, n_docs long, n_tokens long"), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """Every document of the shards, from their files: doc_id, start (ids of all documents before it), n_tokens, ids (binary, unsigned 32-bit, little-endian)."""
    ship(shards.sparkSession)
    parts = shards.groupBy("partition").agg(F.sum("n_tokens").alias("n"))
    # one row for each partition of the writer
    before = parts.select("partition", (F.sum("n").over(_upto("partition")) - F.col("n")).alias("before"))
    inside = shards.withColumn("inside", F.sum("n_tokens").over(_upto("shard", "partition")) - F.col("n_tokens"))
    placed = inside.join(before, "partition").select("file", "doc_ids", (F.col("before") + F.col("inside")).alias("base"), "n_docs")
    # a count of its own: the rows are few, but each stands for a file
    spread = placed.repartition(int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, name = pafs.FileSystem.from_uri(row["file"])
                with fs.open_input_stream(name) as f:
                    ids, lengths = unshard(f.read())
                ids = ids.astype("<u4")
                at = np.cumsum(lengths, dtype=np.int64)
                first = at - lengths
                for k in range(0, len(lengths), 2000):
                    take = slice(k, k + 2000)
                    values = [ids[a:b].tobytes() for a, b in zip(first[take], at[take], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"][take], pa.int64()), pa.array(row["base"] + first[take]), pa.array(lengths[take].astype(np.int64)), pa.array(values, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _upto(order: str, key: str | None = None):
    from pyspark.sql import Window

    w = Window.partitionBy(key) if key else Window.partitionBy()
    return w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def token_store(docs: DataFrame, tokenizer: str, end: int = 0, path: str | None = None) -> DataFrame:
    """Write docs as token shards (below path, by default in the shared folder) and read them back."""
    return read_shards(write_shards(docs, path or workdir(docs.sparkSession, "tokens"), tokenizer, end))
