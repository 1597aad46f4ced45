"""Shared scratch tables.

Intermediate results that several jobs read are written below ``spark.checkpoint.dir``, the one
folder that driver and executors share, and read back: this cuts lineage and survives lost
executors. The folder is only chosen here when a local session has none (tests).
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text for one key range of an exchange.
RANGE_BYTES = 8 << 20
#: Folders of the scratch tables written inside settled().
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder. Without one a local session gets a temporary folder; on a cluster that is an error."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        option = sc._jsc.sc().getCheckpointDir()
        if option.isEmpty():
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="magpie-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            sc.setCheckpointDir("file://" + folder)
            option = sc._jsc.sc().getCheckpointDir()
        root = option.get()
    return root.rstrip("/")


def workdir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared root, deleted when the driver's JVM ends."""
    path = f"{shared_root(spark)}/magpie-{uuid.uuid4().hex[:12]}-{name}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    if (written := _written.get()) is not None:
        written.append(path)
    return path


def save(df: DataFrame, name: str, by: str | None = None, codec: str = "zstd") -> DataFrame:
    """Write df once as Parquet and return the table read back (its schema is kept)."""
    spark = df.sparkSession
    path = workdir(spark, name) + "/t"
    writer = df.write.mode("overwrite").option("compression", codec)
    (writer.partitionBy(by) if by else writer).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    return back.select(*df.columns)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of jobs that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Write the result of make() once and delete the scratch tables that it wrote on the way.

    The result is read from its own table, so neither it nor a lost executor needs them again.
    """
    written: list[str] = []
    token = _written.set(written)
    try:
        made = make()
    finally:
        _written.reset(token)
    out = save(made, name)
    for path in written:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    del made
    release(spark)
    return out


def trim() -> None:
    """Give freed memory of this Python worker back to the system: workers are used again, and keep their largest size otherwise."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.malloc_trim(0)


def fanout(spark: SparkSession, size: int = 0) -> int:
    """Number of key ranges for an exchange over so many bytes of text: some per shuffle partition, so that they even out, and more for more text."""
    return max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of a column of texts, over all rows."""
    return docs.agg(F.sum(F.octet_length(F.col(column).cast("string")).cast("long"))).first()[0] or 0


def fresh(name: str, *frames: DataFrame) -> str:
    """The name, with underscores before it as long as one of the frames has such a column."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python can import it.

    A Python function of Spark keeps the list of files of the moment it is made, so every public
    operator calls this first.
    """
    sc = spark.sparkContext
    if getattr(sc, "_magpie_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="magpie-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(f"{folder}/magpie_package", "zip", root, "magpie"))
    sc._magpie_shipped = True


def discard(table: DataFrame, partition: str) -> None:
    """Delete one partition (as in "kind = 'x'") of a table that save() wrote by a column, when no later step reads it."""
    jvm = table.sparkSession.sparkContext._jvm
    name = partition.replace(" ", "").replace("'", "")
    for path in {f.rpartition("/")[0] for f in table.where(partition).inputFiles()}:
        if path.endswith("/" + name):
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
