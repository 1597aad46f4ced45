"""Logical tables bound to the driver's tables, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Tables:
    """Frames over one data folder. Query vectors are those whose id is divisible by 20, against all vectors."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def keypoints(self) -> DataFrame:
        return self.embeddings.select("vec_id", F.expr("vec_id div 8").alias("page_id"), F.expr("vec_id div 128").alias("chunk_no"), F.col("label").alias("collection"), F.col("embedding").cast("array<double>").alias("v"))

    def queries(self, batch: bool = False) -> DataFrame:
        """All query vectors as keypoints of one query, or of one query for each 200 ids."""
        query = F.expr("vec_id div 200") if batch else F.lit(0).cast("long")
        return self.embeddings.where("vec_id % 20 = 0").select(query.alias("query_id"), F.col("vec_id").alias("kp"), F.col("embedding").cast("array<double>").alias("q"))

    def paths(self) -> DataFrame:
        """Pages of keypoints: every eleventh is a cover."""
        page = F.expr("vec_id div 8")
        return self.embeddings.select(page.alias("page_id")).distinct().withColumn("book", F.expr("page_id div 5")).withColumn("path", F.concat(F.lit("Books/Book"), F.col("book"), F.lit("/Book"), F.col("book"), F.lit("-page"), F.when(F.col("page_id") % 11 == 0, F.lit(0)).otherwise(F.col("page_id")), F.lit(".jpg")))

    def history(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "O", "in_progress").when(F.col("o_orderstatus") == "F", "completed").otherwise("stopped")
        return self.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("date"), F.col("o_orderpriority").alias("type"), status.alias("status"), F.col("o_totalprice").alias("price"))

    def results(self, of: DataFrame | None = None) -> DataFrame:
        """Ranked results of all sessions, or of those in a frame (id)."""
        rows = self.lineitem
        if of is not None:
            rows = rows.join(of.select(F.col("id").alias("l_orderkey")), "l_orderkey", "left_semi")
        w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber")
        return rows.select(F.col("l_orderkey").alias("history_id"), F.row_number().over(w).alias("rank"), F.col("l_partkey").alias("path"), F.col("l_quantity").cast("int").alias("votes"), F.col("l_discount").alias("score"))


KEYPOINTS = """kpts AS (
  SELECT vec_id, vec_id // 8 AS page_id, vec_id // 128 AS chunk_no, label AS collection, embedding::DOUBLE[] AS v
  FROM embeddings)"""
QUERIES = """qs AS (
  SELECT 0 AS query_id, vec_id AS kp, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0)"""
BATCH = """qs AS (
  SELECT vec_id // 200 AS query_id, vec_id AS kp, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0)"""
SCORED = """sc AS (
  SELECT query_id, kp, chunk_no, page_id, vec_id, collection, list_inner_product(q, v) AS score FROM kpts, qs)"""
RANKED = """rk AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, kp, chunk_no ORDER BY score DESC, vec_id) AS rank FROM sc)"""
MATCHED = """mt AS (SELECT * FROM rk WHERE rank <= 5 AND score >= 0.25)"""
VOTES = """vt AS (
  SELECT query_id, page_id, count(*) AS votes
  FROM (SELECT DISTINCT query_id, kp, chunk_no, page_id FROM mt) GROUP BY ALL)"""
PATHS = """pt AS (
  SELECT page_id, page_id // 5 AS book,
    'Books/Book' || (page_id // 5) || '/Book' || (page_id // 5) || '-page'
      || CASE WHEN page_id % 11 = 0 THEN 0 ELSE page_id END || '.jpg' AS path
  FROM (SELECT DISTINCT vec_id // 8 AS page_id FROM embeddings))"""
HISTORY = """hs AS (
  SELECT o_orderkey AS id, o_orderdate AS date, o_orderpriority AS type, o_totalprice AS price,
    CASE o_orderstatus WHEN 'O' THEN 'in_progress' WHEN 'F' THEN 'completed' ELSE 'stopped' END AS status
  FROM orders)"""
RESULTS = """rs AS (
  SELECT l_orderkey AS history_id, l_partkey AS path, l_quantity::INT AS votes, l_discount AS score,
    row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS rank
  FROM lineitem)"""


def chain(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


UPTO_VOTES = (KEYPOINTS, QUERIES, SCORED, RANKED, MATCHED, VOTES)
