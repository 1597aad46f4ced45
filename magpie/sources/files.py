"""Sources: image trees, feature bundles, id lists."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from magpie.functions import paths

IMAGES = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp")
FEATURES = "path string, n int, width int, height int, descriptors array<array<float>>, points array<array<float>>, error string"


def images(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """All images below root, in the order of their paths: path, length, modificationTime and, if asked for, content."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = rows.where(paths.extension(F.col("path")).isin(*IMAGES))
    return (rows if content else rows.drop("content")).orderBy("path")


def image(spark: SparkSession, path: str | None = None, data: bytes | None = None) -> DataFrame:
    """One image, from a file or from uploaded bytes: path, content."""
    if data is not None:
        return spark.createDataFrame([(path, bytearray(data))], "path string, content binary")
    return spark.read.format("binaryFile").load(path).select("path", "content")


def ids(rows: DataFrame, vectors: DataFrame, group: str) -> DataFrame:
    """Vectors (group, pos) with the ids of the array aligned with them. rows: group, ids (array)."""
    flat = rows.select(group, F.posexplode("ids").alias("pos", "compact_id"))
    return vectors.join(flat, [group, "pos"], "left")


def by_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of a list of keys, each once; Spark sends the list to all tasks only if it is small."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def listed_folders(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """The listed folders (folder) that exist and hold an image, with counts."""
    return wanted.select("folder").distinct().join(folders(rows), "folder").where("files > 0")


def folders(rows: DataFrame) -> DataFrame:
    """Immediate folders of files, with counts and bytes."""
    return rows.groupBy(paths.dirname(F.col("path")).alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def read_bundle(data: bytes) -> tuple:
    """A feature bundle (npz): descriptors by name, or else the first 2-D array of 128 columns; size from the points if it is not given."""
    with np.load(io.BytesIO(data)) as z:
        arrays = {k: z[k] for k in z.files}
    d = arrays.get("descriptors")
    if d is None:
        d = next((a for a in arrays.values() if a.ndim == 2 and a.shape[1] == 128), None)
    if d is None or d.ndim != 2 or d.shape[1] != 128:
        raise ValueError("no descriptors of 128 columns")
    p = arrays.get("keypoints")
    if "image_size" in arrays:
        h, w = (int(x) for x in arrays["image_size"][:2])
    elif p is not None and len(p):
        w, h = (int(np.ceil(x)) for x in p.max(axis=0))
    else:
        w = h = 0
    return len(d), w, h, d.astype(np.float32).tolist(), None if p is None else p.astype(np.float32).tolist(), None


def features(rows: DataFrame) -> DataFrame:
    """Bundles of (path, content); unusable ones have null features and an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, data in zip(frame.path, frame.content, strict=True):
                try:
                    out.append((path, *read_bundle(bytes(data))))
                except Exception as e:  # reported in the row
                    out.append((path, None, None, None, None, None, str(e)[:200]))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in FEATURES.split(", ")])

    return rows.select("path", "content").mapInPandas(run, FEATURES)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """First tab-separated field of each line that is not blank."""
    value = F.trim(F.split("value", "\t")[0])
    return spark.read.text(path).select(value.alias("item")).where("item <> ''")


def json_list(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of strings with positions."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "item"))


def listed(text: str, spark: SparkSession) -> DataFrame:
    """A comma-separated parameter as rows."""
    return spark.range(1).select(F.explode(F.split(F.lit(text), ",")).alias("item")).select(F.trim("item").alias("item")).where("item <> ''")


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def stream_files(spark: SparkSession, folder: str, schema, most_bytes: str = "256m") -> DataFrame:
    """Parquet files of a folder as a stream that reads ahead by no more than so many bytes; a query's checkpoint says what was read."""
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", most_bytes).parquet(folder)
