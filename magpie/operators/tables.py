"""Writes by key, on tables without transactions: the new content is a frame, written and then swapped in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows by key; of several new ones the latest wins, and any new one beats an old one."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    last = new.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return old.join(last.select(keys), keys, "left_anti").unionByName(last)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not there yet, one each."""
    return new.dropDuplicates(keys).join(old.select(keys), keys, "left_anti")


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in new go, the new ones come."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_cascade(headers: DataFrame, details: DataFrame, gone: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    ids = gone.select(F.col(key)).distinct()
    return headers.join(ids, key, "left_anti"), details.join(ids, F.col(foreign) == ids[key], "left_anti")


def rename_prefix(rows: DataFrame, column: str, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Every path with a name replaced, and how many rows that touches."""
    hit = F.col(column).contains(old)
    return rows.withColumn(column, F.replace(F.col(column), F.lit(old), F.lit(new))), rows.agg(F.count_if(hit).alias("touched"))


def ranked_rows(rows: DataFrame, key: str, order: list, top: int) -> DataFrame:
    """Details with rank 1..N."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def assert_aligned(vectors: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks whose counts of vectors and ids differ, on either side."""
    a, b = vectors.groupBy(*keys).agg(F.count("*").alias("vectors")), ids.groupBy(*keys).agg(F.count("*").alias("ids"))
    return a.join(b, keys, "full").withColumns({"vectors": F.coalesce("vectors", F.lit(0)), "ids": F.coalesce("ids", F.lit(0))}).withColumn("ok", F.col("vectors") == F.col("ids"))


def write_chunks(rows: DataFrame, path: str, keys: tuple[str, ...] = ("collection", "chunk_no")) -> None:
    """Vectors with their ids in one row each, partitioned so that collection and chunk filters prune; only the partitions that come are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def replace_partitions(rows: DataFrame, path: str, keys: tuple[str, ...]) -> None:
    """Rows of some partitions (say the runs of one chunk) in place of what those held; other partitions stay."""
    write_chunks(rows, path, keys)


def numbered(rows: DataFrame, order: list[str], by: tuple[str, ...] = (), name: str = "place") -> DataFrame:
    """rows with their place, from 1, in an order of columns without ties (within each value of by).

    Rows are counted by ranges of the order, then numbered within their range, so neither all rows
    nor those of one value have to meet in one task.
    """
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # some 20 rows a range: a bound for the driver; the ends of ranges only balance them
    share = min(1.0, 20 * ranges / max(1, rows.count()))
    at = F.struct(*order)
    some = rows.select(at.alias("at")).sample(share, 1).groupBy().agg(F.sort_array(F.collect_list("at")).alias("at"))
    ends = some.select(F.filter("at", lambda x, i: i % F.greatest(F.lit(1), F.ceil(F.size("at") / ranges)) == 0).alias("__ends"))
    placed = rows.crossJoin(F.broadcast(spark.createDataFrame(ends.collect(), ends.schema)))
    placed = placed.withColumn("__r", F.size(F.filter("__ends", lambda x: x <= at))).drop("__ends")
    # at most values x ranges rows
    counts = placed.groupBy(*by, "__r").agg(F.count("*").alias("__n"))
    if by:
        earlier = Window.partitionBy(*by).orderBy("__r")
    else:
        earlier = Window.orderBy("__r")  # one row a range
    counts = counts.select(*by, "__r", (F.sum("__n").over(earlier) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*by, "__r").orderBy(*order))
    out = placed.withColumn("__i", inside)
    for c in by:
        counts = counts.withColumnRenamed(c, f"__{c}")
    match = out["__r"] == counts["__r"]
    for c in by:
        match = match & out[c].eqNullSafe(counts[f"__{c}"])
    out = out.join(counts, match).withColumn(name, (F.col("__before") + F.col("__i")).cast("long"))
    return out.select(*rows.columns, name)


def distinct_first(rows: DataFrame, text: str, order: str) -> DataFrame:
    """The first spelling of each text, without regard to case."""
    w = Window.partitionBy(F.lower(text)).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def delete_where(stores: dict[str, DataFrame], column: str, any_of: list[str], dry: bool = False) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Each store without the rows whose column holds any of the words, and a one-row status: store, status, touched.

    A store without such a column is reported as failed and stays; a dry run only counts.
    """
    out = {}
    for name, rows in stores.items():
        spark = rows.sparkSession
        if column not in rows.columns:
            out[name] = rows, spark.createDataFrame([(name, "failed", 0)], "store string, status string, touched long")
            continue
        hit = F.coalesce(F.lit(False), F.lit(False))
        for word in any_of:
            hit = hit | F.coalesce(F.col(column).contains(word), F.lit(False))
        count = rows.agg(F.lit(name).alias("store"), F.lit("dry run" if dry else "done").alias("status"), F.count_if(hit).alias("touched"))
        out[name] = (rows if dry else rows.where(~hit)), count
    return out


def snapshot(rows: DataFrame, path: str) -> DataFrame:
    """A copy of a table, read back and compared with it by its rows: rows, copied, ok."""
    rows.write.mode("overwrite").parquet(path)
    mark = lambda d: d.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*rows.columns)).alias("mark"))
    a, b = mark(rows), mark(rows.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns))
    b = b.select(F.col("n").alias("copied"), F.col("mark").alias("copy_mark"))
    return a.join(b).select(F.col("n").alias("rows"), "copied", ((F.col("n") == F.col("copied")) & F.col("mark").eqNullSafe(F.col("copy_mark"))).alias("ok"))
