"""Command line: index a folder of images, search it, and count what is there.

The embedder is the deterministic stand-in; a service gives its own to ``Search``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from magpie.embedders import HashEmbedder
from magpie.operators import tables
from magpie.session import Search


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="magpie", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, extra in (("index", ["images", "collection"]), ("add", ["images", "collection"]), ("search", ["image"]), ("stats", [])):
        one = commands.add_parser(name)
        one.add_argument("vectors", help="folder of the vector table")
        for x in extra:
            one.add_argument(x)
        if name == "search":
            one.add_argument("--top", type=int, default=20)
    got = parser.parse_args(args)
    spark = SparkSession.builder.appName("magpie").getOrCreate()
    empty = spark.createDataFrame([], "vec_id long, collection string, path string, v array<double>")
    search = Search(spark, {"vectors": empty if got.command == "index" else spark.read.parquet(got.vectors)}, HashEmbedder())
    if got.command in ("index", "add"):
        rows = search.index(got.images, got.collection)
        if got.command == "index":
            rows = tables.numbered(rows.where("v IS NOT NULL").select("collection", "path", "v"), ["collection", "path"], name="vec_id").withColumn("vec_id", F.col("vec_id") - 1)
        else:
            known = search.tables["vectors"].select("vec_id")
            rows = search.add_to_index(rows).join(known, "vec_id", "left_anti")
        rows.select("vec_id", "collection", "path", "v").write.mode("overwrite" if got.command == "index" else "append").parquet(got.vectors)
    elif got.command == "search":
        with open(got.image, "rb") as f:
            search.image_search(f.read(), got.top).select("path", "score").show(got.top, False)
    else:
        search.stats().orderBy("collection").show(1000, False)


if __name__ == "__main__":
    main()
