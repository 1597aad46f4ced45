"""Second-stage scores: geometric tiers, combined tiers, two-stage cut, fallbacks, faces, federation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from magpie.functions import paths


def geometric_score(inliers: Column, total: Column, votes: Column) -> Column:
    """Tier by inliers, then inliers, matches and (adjusted) votes."""
    tier = F.when(inliers >= 20, 3).when(inliers >= 10, 2).when(inliers >= 5, 1).otherwise(0)
    return tier * 1e9 + inliers * 1000.0 + total * 10.0 + votes


def geometric_rank(results: DataFrame, by: str = "query_id", factor: float = 0.5) -> DataFrame:
    """Results of each query in the order of their geometric scores; equal ones keep their prior order.

    results: the by column, path, votes, inliers and total (null: not localised), prior (place before).
    """
    none = F.lit(0)
    adjusted = F.when(paths.is_page0(F.col("path")), F.col("votes") * factor).otherwise(F.col("votes").cast("double"))
    out = results.withColumn("rerank_score", geometric_score(F.coalesce("inliers", none), F.coalesce("total", none), adjusted))
    w = Window.partitionBy(by).orderBy(F.desc("rerank_score"), "prior")
    return out.withColumn("rank", F.row_number().over(w))


def verified_rank(results: DataFrame, by: str, verified: str, score: str, key: str) -> DataFrame:
    """Results by verified matches, then score."""
    w = Window.partitionBy(by).orderBy(F.desc(verified), F.desc(score), key)
    return results.withColumn("rank", F.row_number().over(w))


def combined_score(template: Column, keypoints: Column, base: Column) -> Column:
    """Tiers by template match, then by keypoint matches; else a blend with the base score (as a share of the best one)."""
    sure = F.when(template >= 0.9, 1000.0).when(template >= 0.85, 500.0).when(template >= 0.75, 200.0)
    strong = F.when(keypoints >= 30, 150.0).when(keypoints >= 15, 100.0)
    blend = base * 30 + template * 40 + keypoints * 2
    return F.coalesce(sure + template * 100 + keypoints, strong + keypoints + template * 50, blend)


def two_stage(candidates: DataFrame, cheap: str, costly: Column, first: int) -> DataFrame:
    """Only the first rows by the cheap score get the costly one; the rest get 0."""
    w = Window.partitionBy("query_id").orderBy(F.desc(cheap), "page_id")
    out = candidates.withColumn("stage_rank", F.row_number().over(w))
    return out.withColumn("costly", F.when(F.col("stage_rank") <= first, costly).otherwise(0.0))


def with_fallback(candidates: DataFrame, primary: str, secondary: str) -> DataFrame:
    """The primary count, else the secondary one, with the method's name."""
    method = F.when(F.col(primary).isNotNull(), "disk").when(F.col(secondary).isNotNull(), "orb_fallback").otherwise("disk_error")
    return candidates.withColumn("matches", F.coalesce(primary, secondary, F.lit(0))).withColumn("method", method)


def per_face_k(top_k: int) -> int:
    """How many hits to fetch per face."""
    return min(max(3 * top_k, top_k), 500)


def faces(hits: DataFrame, top: int, least: float = 0.0) -> DataFrame:
    """Hits of several query faces by source image, ordered by distinct faces, then best score. hits: face, source_image, face_index, score."""
    hits = hits.where(F.col("score") >= least)
    best = F.max_by("face_index", F.struct("score", -F.col("face_index")))
    out = hits.groupBy("source_image").agg(F.max("score").alias("best"), F.sum("score").alias("total"), F.count("*").alias("hits"), F.countDistinct("face").alias("faces"), best.alias("best_face"))
    return out.orderBy(F.desc("faces"), F.desc("best"), "source_image").limit(top)


def federated(matches: DataFrame, top_k: int) -> DataFrame:
    """Results of several collections merged by score, at most top_k of each. matches: query_id, kp, collection, vec_id, score."""
    own = Window.partitionBy("query_id", "kp", "collection").orderBy(F.desc("score"), "vec_id")
    every = Window.partitionBy("query_id", "kp").orderBy(F.desc("score"), "collection", "vec_id")
    return matches.withColumn("n", F.row_number().over(own)).where(F.col("n") <= top_k).drop("n").withColumn("rank", F.row_number().over(every))


def deep(one: DataFrame, two: DataFrame, keys: list[str]) -> DataFrame:
    """Two retrievals merged, the better score of each item."""
    return one.unionByName(two).groupBy(*keys).agg(F.max("score").alias("score"))


def result_rows(results: DataFrame) -> DataFrame:
    """Results as the service gives them: path, score, verified_matches and a struct of metadata; rows without a path are passed over."""
    path = F.col("path")
    meta = F.struct(path.alias("path"), paths.basename(path).alias("filename"), paths.basename(paths.dirname(path)).alias("folder"))
    verified = F.col("verified_matches") if "verified_matches" in results.columns else F.lit(0)
    return results.where(path.isNotNull()).select("path", F.col("score").cast("double").alias("score"), verified.cast("long").alias("verified_matches"), meta.alias("metadata"))


def exists(rows: DataFrame) -> bool:
    """Whether there is any row; one is looked for, not counted."""
    return not rows.limit(1).isEmpty()
