"""Votes of query keypoints for pages, and their ranking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from magpie.functions import paths


def votes(matches: DataFrame, scope: str = "chunk", dedupe: bool = True) -> DataFrame:
    """Votes per query and page: each keypoint votes once per page and chunk (or once per page); without dedupe as often as it matched."""
    if dedupe:
        matches = matches.select("query_id", "kp", "page_id", *(["chunk_no"] if scope == "chunk" else [])).distinct()
    return matches.groupBy("query_id", "page_id").agg(F.count("*").alias("votes"))


def merge_votes(*parts: DataFrame) -> DataFrame:
    """Counters of several shards added up."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("query_id", "page_id").agg(F.sum("votes").alias("votes"))


def threshold_sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """For each page, matches and score sums at several thresholds, in one pass."""
    columns = []
    for t in thresholds:
        name = str(round(t * 100))
        hit = F.when(F.col("score") >= t, F.col("score"))
        columns += [F.count(hit).alias(f"n_{name}"), F.coalesce(F.sum(hit), F.lit(0.0)).alias(f"w_{name}")]
    return scored.groupBy("query_id", "page_id").agg(*columns)


def k_sweep(ranked: DataFrame, ks: list[int]) -> DataFrame:
    """Votes at several k from one ranking (column rank)."""
    wide = ranked.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("rank") <= F.col("k"))
    return wide.select("query_id", "kp", "chunk_no", "page_id", "k").distinct().groupBy("query_id", "k", "page_id").agg(F.count("*").alias("votes"))


def rollup(page_votes: DataFrame, book: str = "book") -> DataFrame:
    return page_votes.groupBy("query_id", book).agg(F.sum("votes").alias("votes"), F.countDistinct("page_id").alias("pages"))


def best_pages(scored: DataFrame, by: list[str]) -> DataFrame:
    """One vote for the best page of each keypoint (or keypoint and book)."""
    best = scored.groupBy("query_id", "kp", *by).agg(F.max_by("page_id", F.struct("score", -F.col("page_id"))).alias("page_id"))
    return best.groupBy("query_id", "page_id").agg(F.count("*").alias("votes"))


def adjusted(page_votes: DataFrame, factor: float = 0.5, path: str = "path") -> DataFrame:
    """Votes of covers (page 0) are weighed down."""
    return page_votes.withColumn("adjusted", F.when(paths.is_page0(F.col(path)), F.col("votes") * factor).otherwise(F.col("votes").cast("double")))


def exclude(ranked: DataFrame, exclusions: DataFrame, path: str = "path") -> DataFrame:
    """Without the excluded paths (normalised on both sides)."""
    gone = exclusions.select(paths.normalise(F.col("path")).alias("__key")).distinct()
    return ranked.join(gone, paths.normalise(F.col(path)) == F.col("__key"), "left_anti")


def rank(page_votes: DataFrame, top: int, path: str = "path") -> DataFrame:
    """The top pages of each query by adjusted, then raw votes, then path, with scores relative to the first."""
    w = Window.partitionBy("query_id").orderBy(F.desc("adjusted"), F.desc("votes"), path)
    out = page_votes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    best = F.max("adjusted").over(Window.partitionBy("query_id"))
    return out.withColumn("score", F.when(best > 0, F.col("adjusted") / best).otherwise(0.0))


def possible_hit(ranked: DataFrame, sessions: DataFrame) -> DataFrame:
    """Whether the first result of each local-descriptor search stands out.

    ranked: query_id, rank, votes; sessions: query_id, type, status, percent. It needs a type with
    DISK in it, two results, at least 120 votes, 1.5 times and 50 more than the second, and, while
    the search is in progress, 10 percent of it done.
    """
    pick = lambda k: F.max(F.when(F.col("rank") == k, F.col("votes")))
    top = sessions.join(ranked.groupBy("query_id").agg(pick(1).alias("top"), pick(2).alias("second")), "query_id", "left")
    second = F.greatest("second", F.lit(1))
    early = (F.col("status") == "in_progress") & (F.col("percent") < 10)
    clear = (F.col("top") >= 120) & (F.col("top") / second >= 1.5) & (F.col("top") - second >= 50)
    possible = F.upper("type").contains("DISK") & F.col("second").isNotNull() & clear & ~early
    return top.select("query_id", "top", "second", F.coalesce(possible, F.lit(False)).alias("possible"))


def leaderboard_by_chunk(chunk_votes: DataFrame, top: int) -> DataFrame:
    """The running leaders after each chunk. chunk_votes: query_id, chunk_no, page_id, votes.

    A page that gains no votes in a chunk cannot rise, so the leaders after it are among those
    before it and the best of the pages that it votes for. Only so many rows a chunk are folded.
    """
    so_far = Window.partitionBy("query_id", "page_id").orderBy("chunk_no")
    best = Window.partitionBy("query_id", "chunk_no").orderBy(F.desc("votes"), "page_id")
    risen = chunk_votes.withColumn("votes", F.sum("votes").over(so_far)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        leaders: dict[int, int] = {}
        out = []
        for chunk, rows in frame.sort_values("chunk_no").groupby("chunk_no"):
            leaders |= dict(zip(rows.page_id.tolist(), rows.votes.tolist(), strict=True))
            first = sorted(leaders.items(), key=lambda x: (-x[1], x[0]))[:top]
            leaders = dict(first)
            out += [(frame.query_id.iloc[0], chunk, page, n, k + 1) for k, (page, n) in enumerate(first)]
        return pd.DataFrame(out, columns=["query_id", "chunk_no", "page_id", "votes", "rank"])

    risen = risen.select(*(F.col(c).cast("long") for c in ("query_id", "chunk_no", "page_id", "votes")))
    return risen.groupBy("query_id").applyInPandas(fold, "query_id long, chunk_no long, page_id long, votes long, rank long")
