"""Votes from a stream of chunk files: one whole chunk a batch, resumable, stoppable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from magpie.config import SearchConfig
from magpie.operators import knn, votes


def stream_votes(spark: SparkSession, chunks: str, schema: StructType, queries: DataFrame, out: str, checkpoint: str, config: SearchConfig, stopped: Callable[[], DataFrame] | None = None, progress: Callable[[int], None] | None = None, leaders: str | None = None) -> StreamingQuery:
    """Start (or resume, by the checkpoint) counting votes, one file per batch.

    Each batch's votes are written below its batch number, so a batch that runs again overwrites
    itself. stopped() gives the query_ids that take no more votes. leaders: a folder for the first
    ``config.stored_top`` pages of each query after each batch.
    """

    def step(batch: DataFrame, no: int) -> None:
        live = queries.join(stopped(), "query_id", "left_anti") if stopped else queries
        found = knn.top_matches(live, batch, config.k, config.threshold, config.scope)
        votes.votes(found, config.scope).write.mode("overwrite").parquet(f"{out}/batch={no}")
        if leaders:
            total = total_votes(batch.sparkSession, out, no)
            w = Window.partitionBy("query_id").orderBy(F.desc("votes"), "page_id")
            first = total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= config.stored_top)
            first.write.mode("overwrite").parquet(f"{leaders}/step={no}")
        if progress:
            progress(no)

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(chunks)
    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total_votes(spark: SparkSession, out: str, upto: int | None = None) -> DataFrame:
    """Votes of all batches, or of those up to a number."""
    rows = spark.read.parquet(out)
    if upto is not None:
        rows = rows.where(F.col("batch") <= upto)
    return rows.groupBy("query_id", "page_id").agg(F.sum("votes").alias("votes"))


def finish(spark: SparkSession, query: StreamingQuery, checkpoint: str, stop: Callable[[], bool] | None = None, seconds: float = 0.5) -> bool:
    """Wait for a count of votes. Its checkpoint goes when all chunks were read, and stays when it was stopped (stop() says so) or failed."""
    while not query.awaitTermination(seconds):
        if stop and stop():
            query.stop()
            return False
    if query.exception() is not None:
        return False
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return True


def event_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Windowed counts with a watermark; works on streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
