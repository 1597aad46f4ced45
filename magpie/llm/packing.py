"""Packing token pieces into sequences by cutting-stock column generation.

Documents are cut at multiples of the sequence length; the pieces are counted by length class
(eight tokens wide). A linear program chooses patterns (how many pieces of each class make a
sequence) so that every class is used up with the fewest sequences: its columns are priced by a
knapsack dynamic program over the dual values. Whole multiples of the patterns are taken, what is
left over is packed best-fit, and the patterns' places are dealt to the pieces by their rank within
their class. The driver only sees the histogram, which has as many rows for any corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import fanout, save, ship, trim
from .tokens import encoder

Pattern = tuple[tuple[int, int], ...]
#: The linear program ends when a bound shows it to be within this part of its optimum.
GAP = 3e-4
#: Patterns taken from each dynamic program, and patterns kept for later steps.
COLUMNS, POOL = 32, 2048


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int, columns: int = 1) -> tuple[float, np.ndarray]:
    """The value of the best multiset of items (any number of each) within the capacity, and the best multisets for so many capacities from there down, as columns."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    useful = np.flatnonzero(values > 1e-12)
    v, s = values[useful], sizes[useful]
    fits = np.searchsorted(s, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c], last[c] = best[c - 1], -1
        if k := fits[c]:
            got = v[:k] + best[c - s[:k]]
            i = got.argmax()
            if got[i] > best[c] + 1e-12:
                best[c], last[c] = got[i], i
    count = np.zeros((len(values), columns))
    for column in range(min(columns, capacity)):
        c = capacity - column
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                count[useful[last[c]], column] += 1
                c -= int(s[last[c]])
    return float(best[capacity]), count


def _inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination; small, and free of library threads that compete with Spark's."""
    m = len(a)
    x = np.hstack([a, np.eye(m)])
    for k in range(m):
        p = k + int(np.abs(x[k:, k]).argmax())
        if p != k:
            x[[k, p]] = x[[p, k]]
        x[k] /= x[k, k]
        rows = np.flatnonzero(x[:, k])
        rows = rows[rows != k]
        x[rows] -= x[rows, k, None] * x[k]
    return x[:, m:]


def patterns(demand: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns with whole multiplicities that use up the demand (size class -> count) exactly."""
    sizes = np.array(sorted(k for k, n in demand.items() if n), np.int64)
    if not len(sizes):
        return []
    d = np.array([demand[int(k)] for k in sizes], float)
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    # demands made unequal by a trifle: without ties no step of the simplex method is in vain
    d = d * (1 + 1e-6 * np.random.default_rng(1).random(m))
    x = (inverse * d).sum(axis=1)
    pool, step, still, total = np.zeros((m, 0)), 0, 0, np.inf
    while True:
        price = inverse.sum(axis=0)
        # columns found before are tried first: a product is cheaper than a dynamic program
        worth = price @ pool
        if len(worth) and worth.max() > 1 + GAP:
            column = pool[:, worth.argmax()]
        else:
            # no pattern is worth more than value: the sum of x over value bounds the optimum from below
            value, found = knapsack(price, sizes, capacity, COLUMNS)
            if value <= 1 + GAP or x.sum() * (1 - 1 / value) < 0.5:
                break
            pool, column = np.hstack([pool[:, -POOL:], found]), found[:, 0]
        u = (inverse * column).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(u > 1e-9, x / u, np.inf)
        out = int(ratio.argmin())
        # the simplex method goes on until the bound holds; only rounding errors could let it stand still
        still = 0 if x.sum() < total * (1 - 1e-12) else still + 1
        total = min(total, x.sum())
        if still > 4 * m + 100 or not np.isfinite(ratio[out]):
            break
        step += 1
        basis[:, out] = column
        if step % 256 == 0:
            inverse = _inverse(basis)
        else:
            row = inverse[out] / u[out]
            inverse -= np.outer(u, row)
            inverse[out] = row
        x = np.maximum((inverse * d).sum(axis=1), 0)
    left = {int(k): demand[int(k)] for k in sizes}
    made: Counter[Pattern] = Counter()

    def take(column: np.ndarray, times: int) -> None:
        p = tuple((int(sizes[i]), int(column[i])) for i in np.flatnonzero(column)[::-1])
        times = min([times, *(left[k] // n for k, n in p)])
        if times > 0:
            made[p] += times
            for k, n in p:
                left[k] -= n * times

    for i in range(m):
        take(basis[:, i], int(x[i] + 1e-6))
    for i in np.argsort(-(x - np.floor(x))):
        take(basis[:, i], 1)
    # what is left is less than one sequence of each pattern: best fit, largest first
    bins: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    for k in sorted(left, reverse=True):
        for _ in range(left[k]):
            free = next((f for f in range(k, capacity + 1) if bins[f]), None)
            content = bins[free].pop() if free is not None else []
            content.append(k)
            bins[(capacity if free is None else free) - k].append(content)
    for content in (c for group in bins for c in group):
        made[tuple(sorted(Counter(content).items(), reverse=True))] += 1
    return sorted(made.items(), reverse=True)


def token_pieces(docs: DataFrame, tokenizer: str, end: int, length: int) -> DataFrame:
    """Whole texts as ids plus the end id, cut at multiples of length: doc_id, start, length, doc_tokens, ids, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, last, step = encoder(tokenizer), np.array([end], "<u4").tobytes(), 4 * length
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for i, ids in zip(batch.column(0).to_pylist(), enc.encode(x.as_py() for x in batch.column(1)), strict=True):
                ids += last
                for a in range(0, len(ids), step):
                    piece = ids[a : a + step]
                    for column, value in zip(rows, (i, a // 4, len(piece) // 4, len(ids) // 4, piece), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, [pa.int64()] * 4 + [pa.binary()], strict=True)], names=["doc_id", "start", "length", "doc_tokens", "ids"])
        trim()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary").withColumn("ids_crc32", F.crc32("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 1, length: int = 2048, unit: int = 8, with_ids: bool = True) -> DataFrame:
    """Pack all documents into sequences of at most length tokens.

    docs: doc_id, text; other columns are ignored. Returns one row per piece: doc_id, start,
    length, doc_tokens, ids (binary, unsigned 32-bit, little-endian; unless with_ids is false),
    ids_crc32, sequence_id and offset (place in the sequence, gapless from 0). A null or empty text is its end id alone;
    repeated rows are packed as often as they come; an empty table has no pieces.
    """
    spark = docs.sparkSession
    ship(spark)
    # numbered in the written table, so the numbers stay; the ids themselves wait there until the places are known
    pieces = save(token_pieces(docs, tokenizer, end, length).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    classed = pieces.drop("ids").withColumn("class", F.ceil(F.col("length") / unit).cast("int"))
    capacity = length // unit
    # one row per class, whatever the corpus
    demand = {r["class"]: r["count"] for r in classed.groupBy("class").count().collect()}
    rows, base, seen = [], 0, Counter()
    for pattern, times in patterns(demand, capacity):
        for k, n in pattern:
            rows.append((k, seen[k], seen[k] + n * times, n, base))
            seen[k] += n * times
        base += times
    # from Arrow: rows as a list would start Python workers of a second kind, which stay
    schema = pa.schema([("class", pa.int32()), *((x, pa.int64()) for x in ("lo", "hi", "copies", "base"))])
    places = spark.createDataFrame(pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema))
    # ranks within a class: by bucket, so that no class meets in one task
    classed = classed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(fanout(spark))).cast("int"))
    inside = F.row_number().over(Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "piece"))
    counts = classed.groupBy("class", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = save(counts.select("class", "bucket", F.coalesce(before, F.lit(0)).alias("before")), "ranks")
    ranked = classed.withColumn("inside", inside).join(counts, ["class", "bucket"]).withColumn("rank", F.col("before") + F.col("inside") - 1)
    # at most classes x patterns rows, a bound that does not depend on the corpus
    placed = ranked.join(F.broadcast(places), "class").where("rank >= lo AND rank < hi")
    placed = placed.withColumn("sequence_id", F.expr("base + (rank - lo) div copies"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))
    columns = ["doc_id", "start", "length", "doc_tokens", *(["ids"] if with_ids else []), "ids_crc32", "sequence_id", "offset"]
    if with_ids:
        placed = placed.join(pieces.select("piece", "ids"), "piece")
    return placed.select(columns)
