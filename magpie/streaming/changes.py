"""Change events of the watched folders, and their effect on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from magpie.operators import tables


def reclassify(events: DataFrame, within: float = 0.5) -> DataFrame:
    """A delete whose name turns up in another category within so many seconds is a move. events: ts, kind, name, category."""
    gone = events.where("kind = 'delete'").withColumn("id", F.xxhash64("ts", "name", "category"))
    come = events.where("kind = 'create'").select("name", F.col("ts").alias("t2"), F.col("category").alias("new_category"))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    gap = seconds("t2") - seconds("ts")
    moved = gone.join(come, "name").where((F.col("new_category") != F.col("category")) & (gap >= 0) & (gap <= within))
    w = Window.partitionBy("id").orderBy("t2", "new_category")
    moved = moved.withColumn("n", F.row_number().over(w)).where("n = 1").select("id", "new_category")
    return gone.join(moved, "id", "left").select("ts", F.when(F.col("new_category").isNotNull(), "move").otherwise("delete").alias("kind"), "name", "category", "new_category")


def apply_event(rows: DataFrame, column: str, kind: str, old: str, new: str | None = None, dry: bool = False) -> tuple[DataFrame, DataFrame]:
    """The table after an event, and the count of touched rows; a dry run leaves the table."""
    hit = F.col(column).contains(old)
    count = rows.agg(F.count_if(hit).alias("touched"))
    if dry:
        return rows, count
    if kind == "delete":
        return rows.where(~hit), count
    return rows.withColumn(column, F.replace(F.col(column), F.lit(old), F.lit(new))), count


def queue(jobs: DataFrame, kept: int = 100) -> DataFrame:
    """First in, first out: positions of waiting jobs and the last results. jobs: job_id, ts, state (queued, running, done).

    Waiting jobs are numbered by time ranges, so they need not meet in one task; of the finished ones only the last are looked for.
    """
    waiting = tables.numbered(jobs.where("state = 'queued'"), ["ts", "job_id"], name="position")
    done = jobs.where("state = 'done'").orderBy(F.desc("ts"), F.desc("job_id")).limit(kept)
    rest = jobs.where("state IS NULL OR state NOT IN ('queued', 'done')").unionByName(done)
    return waiting.withColumn("position", F.col("position").cast("int")).unionByName(rest.withColumn("position", F.lit(None).cast("int")))


def watch(spark: SparkSession, folder: str, late: str = "1 hour") -> DataFrame:
    """New files right below a folder, as a stream: path, length, modificationTime. Further ones are found while it runs."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).load(folder).withWatermark("modificationTime", late).drop("content")
