"""Exact nearest neighbours by inner product, with partial top-k in each batch of the database side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from magpie.functions.vectors import dot

#: Query vectors that one pass may hold; more are searched block by block.
QUERY_BLOCK = 20_000
#: Query vectors that one broadcast of the expression path holds.
EXPRESSION_BLOCK = 2_000
#: Scores that one matrix product of a batch may hold.
CELLS = 4_000_000
#: Rounding of a matrix product depends on the place in it; candidates this close to the edge stay until they are scored alone.
SLACK = 1e-9
MATCH = "query_id long, kp long, chunk_no long, page_id long, vec_id long, score double"


def cap_keypoints(queries: DataFrame, most: int = 2000) -> DataFrame:
    """The keypoints of each query with the largest norms before they were normalised (column norm)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("norm"), "kp")
    return queries.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def _blocks(queries: DataFrame, most: int) -> list[DataFrame]:
    """The queries in blocks of about so many rows; the smallest set is one block."""
    n = -(-queries.count() // most)
    return [queries] if n <= 1 else [queries.where(F.pmod(F.xxhash64("query_id", "kp"), F.lit(n)) == b) for b in range(n)]


def scores(queries: DataFrame, database: DataFrame) -> DataFrame:
    """Every query keypoint against every vector, as expressions. queries: query_id, kp, q; database: chunk_no, page_id, vec_id, v.

    Blocks of ``EXPRESSION_BLOCK`` queries are broadcast, so what is sent does not grow with them.
    """
    out = None
    for block in _blocks(queries, EXPRESSION_BLOCK):
        part = database.crossJoin(F.broadcast(block)).select("query_id", "kp", "chunk_no", "page_id", "vec_id", dot(F.col("q"), F.col("v")).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def above(queries: DataFrame, database: DataFrame, least: float) -> DataFrame:
    """All matches with a score at or above least, by matrix products; other scores never leave their batch."""
    out = None
    for block in _blocks(queries, QUERY_BLOCK):
        part = _best(block, database, None, least)
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("score") >= least)


def _dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (a[i], b[j]), each summed in the same order: equal vectors score equally, in both directions."""
    out = np.empty(len(i))
    for k in range(0, len(i), 10_000):
        out[k : k + 10_000] = (a[i[k : k + 10_000]] * b[j[k : k + 10_000]]).sum(axis=1)
    return out


def _best(queries: DataFrame, database: DataFrame, k: int | None, floor: float | None) -> DataFrame:
    """Candidates of the top k (all if k is None), found with one matrix product per batch; queries are a bounded block."""
    rows = queries.select("query_id", "kp", "q").collect()
    if not rows:
        return database.sparkSession.createDataFrame([], MATCH)
    matrix = np.array([r.q for r in rows], float)
    qid, kp = np.array([r.query_id for r in rows]), np.array([r.kp for r in rows])
    shared = database.sparkSession.sparkContext.broadcast((matrix, qid, kp))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, qs, kps = shared.value
        for batch in batches:
            chunk, page, vec = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            if not len(vec):
                continue
            x = flat.reshape(len(vec), -1)
            step = max(1, CELLS // len(vec))
            for first in range(0, len(m), step):
                product = m[first : first + step] @ x.T
                for c in np.unique(chunk):
                    at = np.flatnonzero(chunk == c)
                    part = product[:, at]
                    if k is not None and len(at) > k:
                        edge = np.partition(part, len(at) - k, axis=1)[:, len(at) - k]
                        keep = part >= edge[:, None] - SLACK
                    else:
                        keep = np.ones(part.shape, bool)
                    if floor is not None:
                        keep &= part >= floor - SLACK
                    i, j = np.nonzero(keep)
                    i, j = i + first, at[j]
                    yield pa.RecordBatch.from_arrays([pa.array(qs[i], pa.int64()), pa.array(kps[i], pa.int64()), pa.array(chunk[j], pa.int64()), pa.array(page[j], pa.int64()), pa.array(vec[j], pa.int64()), pa.array(_dots(m, x, i, j))], names=["query_id", "kp", "chunk_no", "page_id", "vec_id", "score"])

    side = database.select(*(F.col(c).cast("long") for c in ("chunk_no", "page_id", "vec_id")), F.col("v").cast("array<double>"))
    return side.mapInArrow(run, MATCH)


def top_matches(queries: DataFrame, database: DataFrame, k: int, threshold: float | None = None, scope: str = "chunk", path: str = "arrow") -> DataFrame:
    """The k best vectors of each query keypoint, per chunk or over all, at or above the threshold; ties go to the smaller vec_id."""
    if path == "arrow":
        found = None
        for part in _blocks(queries, QUERY_BLOCK):
            best = _best(part, database, k, threshold)
            found = best if found is None else found.unionByName(best)
    else:
        found = scores(queries, database)
    keys = ["query_id", "kp"] + (["chunk_no"] if scope == "chunk" else [])
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return found if threshold is None else found.where(F.col("score") >= threshold)


def nearest(query: DataFrame, database: DataFrame, k: int) -> DataFrame:
    """The k best rows for one query vector (column q); ties by vec_id."""
    one = query.first()
    if one is None:
        return database.limit(0).withColumn("score", F.lit(0.0))
    q = F.lit([float(x) for x in one["q"]])
    return database.withColumn("score", dot(q, F.col("v"))).orderBy(F.desc("score"), "vec_id").limit(k)


def top_by(queries: DataFrame, database: DataFrame, group: str, k: int) -> DataFrame:
    """The k best vectors of each query in each group (a column of the database), in one pass; ties go to the smaller vec_id."""
    marked = database.withColumn("__g", F.xxhash64(group))
    best = top_matches(queries, marked.select(F.col("__g").alias("chunk_no"), F.lit(0).alias("page_id"), "vec_id", "v"), k)
    names = database.select("vec_id", group)
    return best.select("query_id", "kp", "vec_id", "score").join(names, "vec_id").select("query_id", "kp", group, "vec_id", "score")


def cells(database: DataFrame, n: int, sample: int = 20_000, rounds: int = 10, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """An approximate index (chunk_no, page_id, vec_id, v): centres (cell, v) and the database with the cell of each vector.

    The centres come from k-means on at most ``sample`` rows (those with the least hashes of their
    ids); every row of the database is put into the cell of its nearest centre.
    """
    spark = database.sparkSession
    rows = database.select("vec_id", F.col("v").cast("array<double>")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    x = np.array([r.v for r in rows])
    if not len(x):
        return spark.createDataFrame([], "cell int, v array<double>"), database.withColumn("cell", F.lit(0))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        of = (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        for c in np.unique(of):
            centres[c] = x[of == c].mean(axis=0)
    frame = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, v array<double>")
    shared = spark.sparkContext.broadcast(centres)
    schema = "chunk_no long, page_id long, vec_id long, v array<double>, cell int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if not len(batch):
                continue
            y = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            step = max(1, CELLS // len(m))
            cell = np.concatenate([(y[k : k + step] @ m.T - (m**2).sum(axis=1) / 2).argmax(axis=1) for k in range(0, len(y), step)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=["chunk_no", "page_id", "vec_id", "v", "cell"])

    side = database.select(*(F.col(c).cast("long") for c in ("chunk_no", "page_id", "vec_id")), F.col("v").cast("array<double>"))
    return frame, side.mapInArrow(run, schema)


def probe(queries: DataFrame, centres: DataFrame, database: DataFrame, k: int, probes: int = 8) -> DataFrame:
    """The k best vectors of each query in the cells that are nearest to it; k is at most 10,000. Each query meets the vectors of its cells alone."""
    k = min(k, 10_000)
    near = scores(queries, centres.select(F.lit(0).alias("chunk_no"), F.lit(0).alias("page_id"), F.col("cell").alias("vec_id"), "v"))
    half = centres.select(F.col("cell").alias("vec_id"), (dot(F.col("v"), F.col("v")) / 2).alias("half"))
    w = Window.partitionBy("query_id", "kp").orderBy(F.desc(F.col("score") - F.col("half")), "vec_id")
    near = near.join(half, "vec_id").withColumn("n", F.row_number().over(w)).where(F.col("n") <= probes).select("query_id", "kp", F.col("vec_id").cast("int").alias("cell"))
    pairs = near.join(queries, ["query_id", "kp"]).join(database, "cell").withColumn("score", dot(F.col("q"), F.col("v")))
    best = Window.partitionBy("query_id", "kp").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "kp", "vec_id", "score", "rank")


def _first(left: DataFrame, lid: str, right: DataFrame, rid: str) -> DataFrame:
    """The nearest right row of each left row; ties by rid."""
    queries = left.select(F.lit(0).cast("long").alias("query_id"), F.col(lid).cast("long").alias("kp"), F.col("v").cast("array<double>").alias("q"))
    side = right.select(F.lit(0).alias("chunk_no"), F.lit(0).alias("page_id"), F.col(rid).alias("vec_id"), "v")
    return top_matches(queries, side, 1, None, "global").select(F.col("kp").alias(lid), F.col("vec_id").alias(rid), "score")


def mutual(left: DataFrame, right: DataFrame, threshold: float, by_distance: bool = False) -> DataFrame:
    """Pairs that are each other's nearest, with the forward score at or above the threshold (lid, v) x (rid, v).

    Both directions are searched in blocks of bounded size, so the sides may be whole tables. Few
    features of many candidates are compared within a group column by giving both sides ``g``.
    """
    if "g" in left.columns:
        pairs = left.withColumnRenamed("v", "lv").join(right.withColumnRenamed("v", "rv"), "g").select("g", "lid", "rid", dot(F.col("lv"), F.col("rv")).alias("score"))
        a = Window.partitionBy("g", "lid").orderBy(F.desc("score"), "rid")
        b = Window.partitionBy("g", "rid").orderBy(F.desc("score"), "lid")
        best = pairs.withColumn("a", F.row_number().over(a)).withColumn("b", F.row_number().over(b)).where("a = 1 AND b = 1").drop("a", "b")
    else:
        best = _first(left, "lid", right, "rid").join(_first(right, "rid", left, "lid").select("lid", "rid"), ["lid", "rid"])
    if by_distance:
        return best.where(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))) <= (max(0.0, 2 - 2 * threshold)) ** 0.5)
    return best.where(F.col("score") >= threshold)


def _earlier(vectors: DataFrame, heads: DataFrame, least: float) -> DataFrame:
    """The nearest of a bounded block of heads before each row, at or above least; an equal one before all others."""
    rows = heads.collect()
    shared = vectors.sparkSession.sparkContext.broadcast((np.array([r.q for r in rows], float), np.array([r.head for r in rows], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, ids = shared.value
        for batch in batches:
            vec = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(vec):
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(vec), -1)
            step = max(1, CELLS // len(vec))
            for first in range(0, len(m), step):
                i, j = np.nonzero(m[first : first + step] @ x.T >= least - SLACK)
                i = i + first
                i, j = (k[ids[i] < vec[j]] for k in (i, j))
                score = _dots(m, x, i, j)
                same = np.array([np.array_equal(m[a], x[b]) for a, b in zip(i, j, strict=True)], bool)
                score[same] = np.inf
                # one row a vector
                order = np.lexsort((ids[i], -score, j))
                order = order[score[order] >= least]
                order = order[np.unique(j[order], return_index=True)[1]]
                yield pa.RecordBatch.from_arrays([pa.array(vec[j[order]], pa.int64()), pa.array(ids[i[order]], pa.int64()), pa.array(score[order])], names=["vec_id", "head", "score"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("v").cast("array<double>")).mapInArrow(run, "vec_id long, head long, score double")


def exact_duplicates(vectors: DataFrame, least: float = 0.9999) -> DataFrame:
    """Rows (vec_id, v; unit vectors) with a vector before them of a score at or above least: the first claimant keeps the place.

    first_id is the first of the equal vectors if there are any before, else the nearest earlier one
    (ties to the smaller vec_id; it may have one before itself), else the row's own id. Every row is compared with
    every distinct vector, in blocks of bounded size. Rows without a vector have no duplicate.

    Returns vec_id, first_id, duplicate.
    """
    held = vectors.where("v IS NOT NULL")
    heads = held.groupBy(F.col("v").cast("array<double>").alias("q")).agg(F.min("vec_id").cast("long").alias("head"))
    blocks = -(-heads.count() // QUERY_BLOCK)
    found = None
    for b in range(blocks):
        part = _earlier(held, heads if blocks == 1 else heads.where(F.pmod(F.xxhash64("head"), F.lit(blocks)) == b), least)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.select("vec_id", F.col("vec_id").alias("first_id"), F.lit(False).alias("duplicate"))
    best = found.groupBy("vec_id").agg(F.max_by("head", F.struct("score", -F.col("head"))).alias("head"))
    out = vectors.select("vec_id").join(best, "vec_id", "left").withColumn("first_id", F.coalesce("head", "vec_id"))
    return out.select("vec_id", "first_id", (F.col("vec_id") != F.col("first_id")).alias("duplicate"))
