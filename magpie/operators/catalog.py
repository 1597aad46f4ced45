"""Index catalogue: chunks, compact ids, run-length maps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def assign_ids(known: DataFrame, seen: DataFrame, group: str = "collection") -> DataFrame:
    """New paths get ids after the largest known one of their group, in first-seen order. known: group, path, id; seen: group, path, pos."""
    new = seen.groupBy(group, "path").agg(F.min("pos").alias("pos")).join(known.select(group, "path"), [group, "path"], "left_anti")
    top = known.groupBy(group).agg(F.max("id").alias("top"))
    w = Window.partitionBy(group).orderBy("pos", "path")
    return new.join(top, group, "left").select(group, "path", (F.coalesce("top", F.lit(-1)) + F.row_number().over(w)).alias("id"))


def new_ids_only(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Dictionary rows beyond the largest stored id of their collection."""
    top = stored.groupBy("collection").agg(F.max("id").alias("top"))
    return rows.join(top, "collection", "left").where(F.col("id") > F.coalesce("top", F.lit(-1))).drop("top")


def run_lengths(rows: DataFrame, group: str, pos: str, value: str) -> DataFrame:
    """Runs of equal values in order: group, seq (from 0), value, n."""
    w = Window.partitionBy(group).orderBy(pos)
    before = F.lag(value).over(w)
    island = rows.withColumn("new", F.when(F.row_number().over(w) == 1, 0).when(before.eqNullSafe(F.col(value)), 0).otherwise(1))
    island = island.withColumn("seq", F.sum("new").over(w))
    return island.groupBy(group, "seq").agg(F.first(value).alias(value), F.count("*").alias("n"))


def expand_runs(runs: DataFrame, group: str, value: str) -> DataFrame:
    """The sequence back from its runs, with positions from 0."""
    w = Window.partitionBy(group).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("base", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return placed.select(group, value, "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).select(group, (F.col("base") + F.col("i")).alias("pos"), value)


def pack_exact(rows: DataFrame, group: str, order: list[str], cap: int) -> DataFrame:
    """Chunks of exactly cap items; items are split where a chunk is full."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / cap))


def split_equal(rows: DataFrame, group: str, pos: str, splits: int) -> DataFrame:
    """Equal ranges of positions; the last takes the remainder."""
    per = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy(group)) / splits))
    return rows.withColumn("part", F.least(F.floor(F.col(pos) / per), F.lit(splits - 1)))


def pack_greedy(items: DataFrame, group: str, order: str, size: str, cap: int) -> DataFrame:
    """Chunks closed as soon as they hold cap or more, on an item's end; a chunk is never empty.

    The state is one number, so each group is folded in order, over its (item, size) rows alone.
    """

    def run(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
        frame = frames.sort_values(order)
        chunk, held, out = 0, 0, []
        for n in frame[size]:
            out.append(chunk)
            held += n
            if held >= cap:
                chunk, held = chunk + 1, 0
        return frame.assign(chunk=out)

    few = items.select(group, order, F.col(size).cast("long").alias(size))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in few.schema) + ", chunk long"
    return few.groupBy(group).applyInPandas(run, kinds)


def boundary_item(items: DataFrame, group: str, order: str, size: str, boundary: int) -> DataFrame:
    """The item of each group that spans a boundary of the running total, and how much of it lies before."""
    w = Window.partitionBy(group).orderBy(order)
    total = items.withColumn("cum", F.sum(size).over(w))
    return total.where((F.col("cum") - F.col(size) < boundary) & (F.col("cum") > boundary)).select(group, order, (F.lit(boundary) - (F.col("cum") - F.col(size))).alias("inner"))


def tail_run(runs: DataFrame, group: str) -> DataFrame:
    """Length of the last run."""
    return runs.groupBy(group).agg(F.max_by("n", "seq").alias("tail"))


def two_way_index(rows: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """Sorted sets in both directions."""
    one = rows.groupBy(a).agg(F.array_sort(F.collect_set(b)).alias(f"{b}s"))
    two = rows.groupBy(b).agg(F.array_sort(F.collect_set(a)).alias(f"{a}s"))
    return one, two


def first_mismatch(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The first position, in the overlap, where two aligned sequences differ (null if none)."""
    both = a.withColumnRenamed(value, "va").join(b.withColumnRenamed(value, "vb"), [*keys, "pos"])
    return both.groupBy(*keys).agg(F.min(F.when(~F.col("va").eqNullSafe(F.col("vb")), F.col("pos"))).alias("first"))


def rebuild_state(outputs: DataFrame) -> DataFrame:
    """Next chunk number and the books already present, from the outputs."""
    return outputs.groupBy("collection").agg((F.max("chunk_no") + 1).alias("next_chunk"), F.countDistinct("book").alias("books"))


def latest(rows: DataFrame, group: str, order: list[str], columns: list[str]) -> DataFrame:
    got = rows.groupBy(group).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("x"))
    return got.select(group, "x.*")
