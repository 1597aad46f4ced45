"""Resumable work: what to skip, virtual batches, quarantine, session states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def folder_state(current: DataFrame, scanned: DataFrame, known: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Per folder: skip if nothing changed since the last scan and all is known; recover if all is known though it was never scanned.

    Each frame: key, n; keys are compared without case, with forward slashes. A folder that was
    scanned and held nothing is not one that was never scanned. strict: after a scan exactly as
    many have to be known as there are. Virtual batches (``/._batch_`` in the path) are always done again.
    """
    name = F.lower(F.replace(F.col(key).cast("string"), F.lit("\\"), F.lit("/")))
    side = lambda d, n: d.groupBy(name.alias("__k")).agg(F.max("n").alias(n))
    rows = current.withColumnRenamed("n", "current").withColumn("__k", name)
    rows = rows.join(side(scanned, "scanned"), "__k", "left").join(side(known, "known"), "__k", "left")
    rows = rows.withColumn("known", F.coalesce("known", F.lit(0)))
    virtual = F.col("__k").contains("/._batch_")
    full = F.col("known") == F.col("current") if strict else F.col("known") >= F.col("current")
    skip = ~virtual & F.col("scanned").isNotNull() & (F.col("current") == F.col("scanned")) & full
    recover = ~virtual & F.col("scanned").isNull() & (F.col("known") >= F.col("current")) & (F.col("current") > 0)
    return rows.withColumn("action", F.when(skip, "skip").when(recover, "recover").otherwise("process")).drop("__k")


def folder_state_by_image(images: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The variant that looks at each image: a folder is done again as long as one of its images (key, path) is not known (path)."""
    seen = known.select("path", F.lit(True).alias("__seen")).distinct()
    rows = images.join(seen, "path", "left").groupBy(key).agg(F.count("*").alias("current"), F.count("__seen").alias("known"))
    return rows.withColumn("action", F.when(F.col("known") >= F.col("current"), "skip").otherwise("process"))


def virtual_batches(rows: DataFrame, group: str, order: str, size: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def split_by_status(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(done, quarantined, to try again): failures of the device are not marked as processed."""
    device = F.col("error").contains("CUDA")
    return rows.where("error IS NULL"), rows.where(F.col("error").isNotNull() & ~device), rows.where(F.col("error").isNotNull() & device)


def merge_quarantine(old: DataFrame, new: DataFrame) -> DataFrame:
    """The first entry of each path stays."""
    return old.withColumn("__o", F.lit(0)).unionByName(new.withColumn("__o", F.lit(1))).groupBy("path").agg(F.min_by(F.struct("ts", "reason"), F.struct("__o", "ts")).alias("x")).select("path", "x.*")


def latest_status(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


def allowed(old: Column, new: Column) -> Column:
    """in_progress may become completed, failed or stopped; nothing else changes."""
    return (old == "in_progress") & new.isin("completed", "failed", "stopped")


def transition(sessions: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Sessions (key, status, started, ended) after changes (key, status, ts): each takes its first allowed change and ignores the others."""
    live = changes.join(sessions.select(key, F.col("status").alias("__old")), key).where(allowed(F.col("__old"), F.col("status")))
    first = live.groupBy(key).agg(F.min_by(F.struct("status", "ts"), F.struct("ts", "status")).alias("__x"))
    out = sessions.join(first, key, "left")
    out = out.withColumns({"status": F.coalesce("__x.status", "status"), "ended": F.coalesce("__x.ts", "ended")}).drop("__x")
    return out.withColumn("seconds", (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1e6)


def repair_stuck(sessions: DataFrame, before: Column) -> DataFrame:
    stuck = (F.col("status") == "in_progress") & (F.col("date") < before)
    return sessions.withColumn("status", F.when(stuck, "failed").otherwise(F.col("status")))


def resumable(kind: Column, status: Column) -> Column:
    return F.upper(kind).contains("DISK") & (status != "in_progress") & status.isin("stopped", "failed")


def move_action(source: Column, dest: Column) -> Column:
    return F.when(~source & dest, "skip").when(~source, "error").otherwise("move")
