"""Queries of the search families: votes, neighbours, ranking, faces, federation."""

from __future__ import annotations

from pyspark.sql import functions as F

from magpie.functions import vectors as V
from magpie.operators import knn, pixels, rerank, votes
from magpie.plans.fixtures import BATCH, KEYPOINTS, MATCHED, PATHS, QUERIES, RANKED, SCORED, UPTO_VOTES, VOTES, Tables, chain
from magpie.plans.registry import query

K, T = 5, 0.25


def _matches(t: Tables, batch: bool = False, k: int = K, threshold: float | None = T):
    return knn.top_matches(t.queries(batch), t.keypoints(), k, threshold)


def _votes(t: Tables):
    return votes.votes(_matches(t))


def _pathed(t: Tables):
    return votes.adjusted(_votes(t).join(t.paths(), "page_id"))


def _vectors(t: Tables):
    return t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


@query(chain(*UPTO_VOTES) + "SELECT page_id, votes FROM vt ORDER BY votes DESC, page_id LIMIT 50")
def keypoint_vote_topn(t):
    """Snippet keypoints vote for pages."""
    return _votes(t).select("page_id", "votes").orderBy(F.desc("votes"), "page_id").limit(50)


@query(chain(KEYPOINTS, QUERIES, SCORED, RANKED, MATCHED) + "SELECT kp, chunk_no, vec_id, rank, round(score, 6) AS score FROM mt")
def topk_per_chunk(t):
    """Best vectors per keypoint and chunk."""
    return _matches(t).select("kp", "chunk_no", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(
    chain(KEYPOINTS, QUERIES, SCORED)
    + """SELECT kp, vec_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY kp ORDER BY score DESC, vec_id) AS rank FROM sc) WHERE rank <= 3"""
)
def topk_global_expression(t):
    """J1 by expressions, scope global."""
    return knn.top_matches(t.queries(), t.keypoints(), 3, None, "global", "expression").select("kp", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(chain(KEYPOINTS, QUERIES, SCORED, RANKED, MATCHED) + "SELECT page_id, count(*) AS votes FROM mt GROUP BY page_id")
def votes_without_dedupe(t):
    """A2."""
    return votes.votes(_matches(t), dedupe=False).select("page_id", "votes")


@query(chain(KEYPOINTS, BATCH, SCORED, RANKED, MATCHED, VOTES) + "SELECT query_id, page_id, votes FROM vt")
def batch_votes(t):
    """Several queries share one scan."""
    return votes.votes(_matches(t, batch=True))


@query(
    chain(KEYPOINTS, QUERIES, SCORED)
    + """SELECT page_id,
  count(CASE WHEN score >= 0.2 THEN 1 END) AS n_20, round(coalesce(sum(CASE WHEN score >= 0.2 THEN score END), 0), 6) AS w_20,
  count(CASE WHEN score >= 0.3 THEN 1 END) AS n_30, round(coalesce(sum(CASE WHEN score >= 0.3 THEN score END), 0), 6) AS w_30
FROM sc WHERE score >= 0.2 GROUP BY page_id"""
)
def threshold_sweep(t):
    """A3: counts and weighted sums of pages with a match, at several thresholds."""
    got = votes.threshold_sweep(knn.above(t.queries(), t.keypoints(), 0.2), [0.2, 0.3])
    return got.select("page_id", "n_20", F.round("w_20", 6).alias("w_20"), "n_30", F.round("w_30", 6).alias("w_30"))


@query(
    chain(KEYPOINTS, QUERIES, SCORED, RANKED)
    + """SELECT k, page_id, count(*) AS votes FROM (
  SELECT DISTINCT kp, chunk_no, page_id, k FROM rk, (VALUES (1), (3), (5)) AS s(k) WHERE rank <= k AND score >= 0.25)
GROUP BY ALL"""
)
def k_sweep(t):
    """A4."""
    return votes.k_sweep(_matches(t), [1, 3, 5]).select("k", "page_id", "votes")


@query(chain(*UPTO_VOTES, PATHS) + "SELECT book, sum(votes)::BIGINT AS votes, count(DISTINCT page_id) AS pages FROM vt JOIN pt USING (page_id) GROUP BY book")
def book_rollup(t):
    """A5 J2 P14."""
    return votes.rollup(_votes(t).join(t.paths(), "page_id")).select("book", "votes", "pages")


@query(
    chain(KEYPOINTS, QUERIES, SCORED)
    + """SELECT page_id, count(*) AS votes FROM (
  SELECT kp, page_id FROM sc QUALIFY row_number() OVER (PARTITION BY kp ORDER BY score DESC, page_id) = 1)
GROUP BY page_id"""
)
def best_page_per_keypoint(t):
    """A6, method A."""
    return votes.best_pages(knn.top_matches(t.queries(), t.keypoints(), 1, None, "global"), []).select("page_id", "votes")


@query(
    chain(KEYPOINTS, QUERIES, SCORED, PATHS)
    + """SELECT page_id, count(*) AS votes FROM (
  SELECT kp, page_id FROM sc JOIN pt USING (page_id)
  QUALIFY row_number() OVER (PARTITION BY kp, book ORDER BY score DESC, page_id) = 1)
GROUP BY page_id"""
)
def best_page_per_keypoint_and_book(t):
    """A6, method B: the best vector of each keypoint and book."""
    side = t.keypoints().drop("chunk_no").join(t.paths(), "page_id").withColumnRenamed("book", "chunk_no")
    return votes.best_pages(knn.top_matches(t.queries(), side, 1), ["chunk_no"]).select("page_id", "votes")


_ADJ = r"""ad AS (
  SELECT page_id, path, book, votes,
    CASE WHEN regexp_matches(path, '(^|[-_])page0\.[a-z0-9]+$') THEN votes * 0.5 ELSE votes END::DOUBLE AS adjusted
  FROM vt JOIN pt USING (page_id))"""


@query(
    chain(*UPTO_VOTES, PATHS, _ADJ)
    + """SELECT path, votes, adjusted, row_number() OVER (ORDER BY adjusted DESC, votes DESC, path) AS rank,
  round(adjusted / max(adjusted) OVER (), 6) AS score
FROM ad QUALIFY rank <= 40"""
)
def page0_deboost_rank(t):
    """Covers weigh half; scores relative to the first."""
    return votes.rank(_pathed(t), 40).select("path", "votes", "adjusted", "rank", F.round("score", 6).alias("score"))


@query(
    chain(*UPTO_VOTES, PATHS, _ADJ)
    + """SELECT path, votes, row_number() OVER (ORDER BY adjusted DESC, votes DESC, path) AS rank
FROM ad WHERE page_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) QUALIFY rank <= 40"""
)
def exclusion_rank(t):
    """P5: excluded paths never rank."""
    gone = t.labels.where("toxic = 1").select(F.col("doc_id").alias("page_id")).join(t.paths(), "page_id").select(F.upper("path").alias("path"))
    return votes.rank(votes.exclude(_pathed(t), gone), 40).select("path", "votes", "rank")


@query(
    """WITH r AS (
  SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS rank,
    (l_quantity * 4)::INT AS votes
  FROM lineitem),
t AS (
  SELECT id, max(CASE WHEN rank = 1 THEN votes END) AS top, max(CASE WHEN rank = 2 THEN votes END) AS second
  FROM r GROUP BY id),
s AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderpriority LIKE '5%' THEN 'text' ELSE 'Disk search' END AS type,
    o_orderstatus = 'O' AS running, o_orderkey % 25 AS percent
  FROM orders)
SELECT id AS query_id, top, second,
  coalesce(type ILIKE '%DISK%' AND second IS NOT NULL AND top >= 120 AND NOT (running AND percent < 10)
    AND top::DOUBLE / greatest(second, 1) >= 1.5 AND top - greatest(second, 1) >= 50, false) AS possible
FROM s LEFT JOIN t USING (id)"""
)
def possible_hit(t):
    """The first result against the second, of every session."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber")
    ranked = t.lineitem.select(F.col("l_orderkey").alias("query_id"), F.row_number().over(w).alias("rank"), (F.col("l_quantity") * 4).cast("int").alias("votes"))
    kind = F.when(F.col("o_orderpriority").like("5%"), F.lit("text")).otherwise(F.lit("Disk search"))
    status = F.when(F.col("o_orderstatus") == "O", F.lit("in_progress")).otherwise(F.lit("completed"))
    sessions = t.orders.select(F.col("o_orderkey").alias("query_id"), kind.alias("type"), status.alias("status"), (F.col("o_orderkey") % 25).alias("percent"))
    return votes.possible_hit(ranked, sessions)


@query(
    chain(KEYPOINTS, BATCH, SCORED, RANKED, MATCHED).rstrip()
    + """,
cv AS (
  SELECT query_id, chunk_no, page_id, count(*) AS v
  FROM (SELECT DISTINCT query_id, kp, chunk_no, page_id FROM mt) GROUP BY ALL),
c AS (SELECT DISTINCT query_id, chunk_no FROM cv),
tot AS (
  SELECT c.query_id, c.chunk_no, page_id, sum(v)::BIGINT AS votes
  FROM cv JOIN c ON cv.query_id = c.query_id AND cv.chunk_no <= c.chunk_no GROUP BY ALL)
SELECT query_id, chunk_no, page_id, votes,
  row_number() OVER (PARTITION BY query_id, chunk_no ORDER BY votes DESC, page_id) AS rank
FROM tot QUALIFY rank <= 10"""
)
def running_leaderboard(t):
    """The leaders after each chunk."""
    per = _matches(t, batch=True).select("query_id", "kp", "chunk_no", "page_id").distinct().groupBy("query_id", "chunk_no", "page_id").agg(F.count("*").alias("votes"))
    return votes.leaderboard_by_chunk(per, 10)


@query(chain(*UPTO_VOTES) + "SELECT page_id, votes FROM vt")
def resume_votes(t):
    """Votes of chunks 0-1, seeded into a run over the rest."""
    early, late = (votes.votes(knn.top_matches(t.queries(), t.keypoints().where(c), K, T)) for c in ("chunk_no <= 1", "chunk_no > 1"))
    return votes.merge_votes(early, late).select("page_id", "votes")


@query(
    chain(KEYPOINTS, QUERIES, SCORED)
    + """SELECT kp, vec_id, round(score, 6) AS score FROM sc
QUALIFY row_number() OVER (PARTITION BY kp ORDER BY score DESC, vec_id) <= 20"""
)
def knn_top_k(t):
    """Whole-item neighbours of every query vector."""
    return knn.top_matches(t.queries(), t.keypoints(), 20, None, "global").select("kp", "vec_id", F.round("score", 6).alias("score"))


@query()
def knn_approximate(t):
    """Neighbours from the nearest cells of an index over all rows, 18 of 24 probed since these vectors form no clusters (no SQL: recall is measured in the tests)."""
    centres, cells = knn.cells(t.keypoints(), 24)
    return knn.probe(t.queries(), centres, cells, 10, 18).select("kp", "vec_id", F.round("score", 6).alias("score"), "rank")


_SIDES = """WITH a AS (SELECT vec_id AS lid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
b AS (SELECT vec_id AS rid, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 <> 0),
p AS (SELECT lid, rid, list_inner_product(a.v, b.v) AS s FROM a, b),
r AS (
  SELECT *, row_number() OVER (PARTITION BY lid ORDER BY s DESC, rid) AS x, row_number() OVER (PARTITION BY rid ORDER BY s DESC, lid) AS y
  FROM p)
"""


def _sides(t: Tables):
    e = _vectors(t)
    return e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "lid"), e.where("vec_id % 20 <> 0").withColumnRenamed("vec_id", "rid")


@query(_SIDES + "SELECT lid, rid, round(s, 6) AS score FROM r WHERE x = 1 AND y = 1 AND s >= 0.25")
def mutual_nn_matches(t):
    """Mutual nearest neighbours of the query vectors and all others."""
    return knn.mutual(*_sides(t), 0.25).select("lid", "rid", F.round("score", 6).alias("score"))


@query(_SIDES + "SELECT lid, rid FROM r WHERE x = 1 AND y = 1 AND sqrt(greatest(0, 2 - 2 * s)) <= sqrt(2 - 2 * 0.3)")
def cross_check_distance(t):
    """J4 V5."""
    return knn.mutual(*_sides(t), 0.3, by_distance=True).select("lid", "rid")


_COPIES = """WITH e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  UNION ALL SELECT vec_id + 1000000, embedding::DOUBLE[] FROM embeddings WHERE vec_id % 7 = 0
  UNION ALL
  SELECT vec_id + 2000000, list_transform(embedding::DOUBLE[], lambda x, i: x + ((i - 1) % 5 - 2) * 0.0005 * (vec_id % 4))
  FROM embeddings WHERE vec_id % 7 = 1),
p AS (
  SELECT b.vec_id, a.vec_id AS head, a.v = b.v AS same, list_inner_product(a.v, b.v) AS s
  FROM e a JOIN e b ON a.vec_id < b.vec_id AND list_inner_product(a.v, b.v) >= 0.9999),
h AS (SELECT vec_id, head FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY same DESC, CASE WHEN same THEN 0 ELSE s END DESC, head) = 1)
SELECT vec_id, coalesce(head, vec_id) AS first_id, head IS NOT NULL AS duplicate FROM e LEFT JOIN h USING (vec_id)"""


@query(_COPIES)
def exact_dup_vectors(t):
    """A vector with a score of 0.9999 or more with an earlier one is a duplicate; equal and shifted copies are planted."""
    e = _vectors(t)
    same = e.where("vec_id % 7 = 0").withColumn("vec_id", F.col("vec_id") + 1000000)
    shifted = F.transform("v", lambda x, i: x + (i % 5 - 2) * F.lit(0.0005) * (F.col("vec_id") % 4))
    moved = e.where("vec_id % 7 = 1").withColumn("v", shifted).withColumn("vec_id", F.col("vec_id") + 2000000)
    return knn.exact_duplicates(e.unionByName(same).unionByName(moved))


_GEO = r"""WITH c AS (
  SELECT l_orderkey AS q, l_linenumber * 10000000 + l_partkey AS prior, l_suppkey % 31 AS inl, l_suppkey % 31 + l_linenumber AS tot, l_quantity AS votes,
    CASE WHEN l_partkey % 11 = 0 THEN 'b-page0.jpg' ELSE 'b-page' || l_partkey || '.jpg' END AS path
  FROM lineitem),
d AS (SELECT *, CASE WHEN regexp_matches(path, '(^|[-_])page0\.[a-z0-9]+$') THEN votes * 0.5 ELSE votes END AS adj FROM c),
g AS (
  SELECT *, (CASE WHEN inl >= 20 THEN 3 WHEN inl >= 10 THEN 2 WHEN inl >= 5 THEN 1 ELSE 0 END) * 1e9 + inl * 1000 + tot * 10 + adj AS geo
  FROM d)
"""


@query(_GEO + "SELECT q, prior, inl, votes, geo, row_number() OVER (PARTITION BY q ORDER BY geo DESC, prior) AS rank FROM g")
def geometric_tier_rank(t):
    """O3: tiers by inliers, adjusted votes, equal scores in their prior order."""
    part = F.col("l_partkey")
    path = F.when(part % 11 == 0, F.lit("b-page0.jpg")).otherwise(F.concat(F.lit("b-page"), part.cast("string"), F.lit(".jpg")))
    c = t.lineitem.select(F.col("l_orderkey").alias("q"), (F.col("l_linenumber") * F.lit(10_000_000) + part).alias("prior"), (F.col("l_suppkey") % 31).alias("inliers"), (F.col("l_suppkey") % 31 + F.col("l_linenumber")).alias("total"), F.col("l_quantity").alias("votes"), path.alias("path"))
    return rerank.geometric_rank(c, "q").select("q", "prior", F.col("inliers").alias("inl"), "votes", F.col("rerank_score").alias("geo"), "rank")


@query(
    """SELECT l_orderkey AS q, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 5 DESC, l_discount DESC, l_linenumber) AS rank
FROM lineitem"""
)
def verified_sort(t):
    """By verified matches, then score."""
    c = t.lineitem.select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("n"), (F.col("l_suppkey") % 5).alias("verified"), F.col("l_discount").alias("score"))
    return rerank.verified_rank(c, "q", "verified", "score", "n").select("q", "n", "rank")


@query(
    """WITH c AS (
  SELECT l_orderkey AS q, l_linenumber AS n, l_partkey AS p, l_suppkey AS s,
    (l_partkey % 101)::DOUBLE / 100 AS tmpl, (l_quantity % 45)::INT AS kp,
    CASE WHEN max(l_tax) OVER (PARTITION BY l_orderkey) > 0 THEN l_tax / max(l_tax) OVER (PARTITION BY l_orderkey) ELSE 0 END AS base
  FROM lineitem)
SELECT q, n, p, s, round(CASE WHEN tmpl >= 0.9 THEN 1000 + tmpl * 100 + kp WHEN tmpl >= 0.85 THEN 500 + tmpl * 100 + kp
  WHEN tmpl >= 0.75 THEN 200 + tmpl * 100 + kp WHEN kp >= 30 THEN 150 + kp + tmpl * 50 WHEN kp >= 15 THEN 100 + kp + tmpl * 50
  ELSE base * 30 + tmpl * 40 + kp * 2 END, 4) AS score
FROM c"""
)
def combined_tier_score(t):
    """Scores on both sides of every tier."""
    from pyspark.sql import Window

    best = F.max("l_tax").over(Window.partitionBy("l_orderkey"))
    base = F.when(best > 0, F.col("l_tax") / best).otherwise(0.0)
    score = rerank.combined_score((F.col("l_partkey") % 101).cast("double") / 100, (F.col("l_quantity") % 45).cast("int"), base)
    return t.lineitem.select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.round(score, 4).alias("score"))


@query(
    chain(*UPTO_VOTES)
    + """SELECT page_id, votes, row_number() OVER (ORDER BY votes DESC, page_id) AS stage_rank,
  CASE WHEN row_number() OVER (ORDER BY votes DESC, page_id) <= 10 THEN page_id * 0.5 ELSE 0 END::DOUBLE AS costly
FROM vt"""
)
def two_stage_cut(t):
    """O5."""
    return rerank.two_stage(_votes(t), "votes", F.col("page_id") * 0.5, 10).select("page_id", "votes", "stage_rank", "costly")


@query(
    """SELECT d.doc_id, coalesce(quality, toxic, 0) AS matches,
  CASE WHEN quality IS NOT NULL THEN 'disk' WHEN toxic IS NOT NULL THEN 'orb_fallback' ELSE 'disk_error' END AS method
FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def fallback_method(t):
    """The primary count, else the other, with the method's name."""
    return rerank.with_fallback(t.documents.join(t.labels, "doc_id", "left"), "quality", "toxic").select("doc_id", "matches", "method")


@query(
    """WITH h AS (
  SELECT q.vec_id AS face, d.vec_id // 4 AS src, d.vec_id % 4 AS fi, d.vec_id AS vid,
    list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS s
  FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY face ORDER BY s DESC, vid) AS n FROM h)
SELECT src AS source_image, round(max(s), 6) AS best, round(sum(s), 6) AS total, count(*) AS hits,
  count(DISTINCT face) AS faces, arg_max(fi, (s, -fi)) AS best_face
FROM r WHERE n <= 90 AND s >= 0.05 GROUP BY src ORDER BY count(DISTINCT face) DESC, max(s) DESC, src LIMIT 30"""
)
def face_aggregate(t):
    """Hits of several faces by source image."""
    side = t.keypoints().select(F.lit(0).alias("chunk_no"), F.expr("vec_id div 4").alias("page_id"), "vec_id", "v")
    hits = knn.top_matches(t.queries(), side, rerank.per_face_k(30), None, "global")
    hits = hits.select(F.col("kp").alias("face"), F.col("page_id").alias("source_image"), (F.col("vec_id") % 4).alias("face_index"), "score")
    got = rerank.faces(hits, 30, 0.05)
    return got.select("source_image", F.round("best", 6).alias("best"), F.round("total", 6).alias("total"), "hits", "faces", "best_face")


@query(
    chain(KEYPOINTS, QUERIES, SCORED).rstrip()
    + """,
r AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY kp, collection ORDER BY score DESC, vec_id) <= 5)
SELECT kp, collection, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY kp ORDER BY score DESC, collection, vec_id) AS rank
FROM r"""
)
def all_collections_merge(t):
    """The best of every collection, merged by score."""
    got = rerank.federated(knn.top_by(t.queries(), t.keypoints(), "collection", 5), 5)
    return got.select("kp", "collection", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(
    chain(KEYPOINTS, QUERIES, SCORED).rstrip()
    + """,
r AS (
  SELECT kp // 40 AS pair, vec_id, score FROM sc
  QUALIFY row_number() OVER (PARTITION BY kp ORDER BY score DESC, vec_id) <= 20)
SELECT pair, vec_id, round(max(score), 6) AS score FROM r GROUP BY pair, vec_id"""
)
def deep_merge(t):
    """Two retrievals of each pair of queries merged."""
    best = knn.top_matches(t.queries(), t.keypoints(), 20, None, "global").withColumn("pair", F.expr("kp div 40"))
    one, two = (best.where(f"kp % 40 = {i}").select("pair", "vec_id", "score") for i in (0, 20))
    return rerank.deep(one, two, ["pair", "vec_id"]).select("pair", "vec_id", F.round("score", 6).alias("score"))


@query(
    """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 50 = 7 THEN list_transform(embedding::DOUBLE[], lambda x: 0.0) ELSE embedding::DOUBLE[] END AS v FROM embeddings),
n AS (SELECT *, sqrt(list_inner_product(v, v)) AS norm, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0) AS first FROM e)
SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / (norm + 1e-8))), 6) AS total,
  round(sqrt(greatest(0, 2 - 2 * list_inner_product(v, first))), 6) AS far, round(norm, 6) AS norm,
  round(CASE WHEN norm > 0 THEN list_sum(list_transform(v, lambda x: x / norm)) ELSE 0 END, 6) AS safe
FROM n"""
)
def normalize_l2(t):
    """V1-V5, with zero vectors planted."""
    zero = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.lit(0.0))
    e = t.embeddings.select("vec_id", F.when(F.col("vec_id") % 50 == 7, zero).otherwise(F.col("embedding").cast("array<double>")).alias("v"))
    first = F.lit([float(x) for x in t.embeddings.where("vec_id = 0").first()["embedding"]])
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + b)
    v = F.col("v")
    return e.select("vec_id", F.round(add(V.unit_eps(v)), 6).alias("total"), F.round(V.l2_limit(V.dot(v, first)), 6).alias("far"), F.round(V.norm(v), 6).alias("norm"), F.round(add(V.unit(v)), 6).alias("safe"))


@query(
    chain(KEYPOINTS, QUERIES, SCORED).rstrip()
    + """,
b AS (SELECT kp, max(score) AS s FROM sc WHERE vec_id <> kp GROUP BY kp)
SELECT count(*) FILTER (s >= 0.25) AS n_25, count(*) FILTER (s >= 0.3) AS n_30, count(*) FILTER (s >= 0.24 AND s < 0.26) AS near,
  round(avg(s), 6) AS mean, round(quantile_cont(s, 0.5), 6) AS median, round(min(s), 6) AS low, round(max(s), 6) AS high,
  round(stddev_pop(s), 6) AS spread
FROM b"""
)
def score_buckets(t):
    """The distribution of the queries' best scores with other vectors."""
    s = F.col("s")
    # the best two hold one that is not the query itself
    b = knn.top_matches(t.queries(), t.keypoints(), 2, None, "global").where("vec_id <> kp").groupBy("kp").agg(F.max("score").alias("s"))
    return b.agg(F.count_if(s >= 0.25).alias("n_25"), F.count_if(s >= 0.3).alias("n_30"), F.count_if((s >= 0.24) & (s < 0.26)).alias("near"), F.round(F.avg(s), 6).alias("mean"), F.round(F.percentile(s, F.lit(0.5)), 6).alias("median"), F.round(F.min(s), 6).alias("low"), F.round(F.max(s), 6).alias("high"), F.round(F.stddev_pop(s), 6).alias("spread"))


@query(
    chain(KEYPOINTS, QUERIES, SCORED).rstrip()
    + """,
m AS (SELECT kp, score AS s FROM sc WHERE vec_id = 101)
SELECT sc.kp, 1 + count(*) FILTER (score > s) AS rank FROM sc JOIN m USING (kp) GROUP BY sc.kp"""
)
def target_rank(t):
    """The global rank of one vector for each keypoint."""
    s = knn.scores(t.queries(), t.keypoints())
    mine = s.where("vec_id = 101").select("kp", F.col("score").alias("s"))
    return s.join(mine, "kp").groupBy("kp").agg((1 + F.count_if(F.col("score") > F.col("s"))).alias("rank"))


@query(
    chain(KEYPOINTS, QUERIES, SCORED, RANKED).rstrip()
    + """,
a AS (SELECT kp, vec_id FROM rk WHERE rank <= 5 AND score >= 0.25),
b AS (SELECT kp, vec_id FROM rk WHERE rank <= 3 AND score >= 0.2)
SELECT kp, vec_id, 'lost' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT kp, vec_id, 'gained' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""
)
def result_diff(t):
    """Neighbours lost and gained between two engines."""
    a, b = _matches(t).select("kp", "vec_id"), _matches(t, k=3, threshold=0.2).select("kp", "vec_id")
    return a.join(b, ["kp", "vec_id"], "left_anti").withColumn("side", F.lit("lost")).unionByName(b.join(a, ["kp", "vec_id"], "left_anti").withColumn("side", F.lit("gained")))


@query(
    """WITH k AS (SELECT vec_id // 100 AS query_id, vec_id AS kp, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * (vec_id % 13 + 1) AS norm FROM embeddings)
SELECT query_id, kp FROM k QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(norm, 6) DESC, kp) <= 40"""
)
def keypoint_cap(t):
    """The keypoints of each query with the largest norms."""
    v = F.col("embedding").cast("array<double>")
    k = t.embeddings.select(F.expr("vec_id div 100").alias("query_id"), F.col("vec_id").alias("kp"), F.round(V.norm(v) * (F.col("vec_id") % 13 + 1), 6).alias("norm"))
    return knn.cap_keypoints(k, 40).select("query_id", "kp")


@query(
    chain(*UPTO_VOTES, PATHS)
    + """SELECT path, votes::DOUBLE AS score, 0::BIGINT AS verified_matches, split_part(path, '/', 3) AS filename, split_part(path, '/', 2) AS folder
FROM vt JOIN pt USING (page_id)"""
)
def result_struct(t):
    """Results in the service's form, those without a path passed over."""
    got = rerank.result_rows(_votes(t).join(t.paths(), "page_id", "left").withColumnRenamed("votes", "score"))
    return got.select("path", "score", "verified_matches", F.col("metadata.filename").alias("filename"), F.col("metadata.folder").alias("folder"))


@query(
    """SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: abs(x)::DOUBLE)), 1) AS total, true AS close FROM embeddings"""
)
def half_codec(t):
    """Vectors through the half-precision codec, near to themselves after sorting."""
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<float>").alias("v"))
    back = e.withColumn("w", V.unpack_halves(V.pack_halves(F.col("v"))))
    total = F.aggregate(F.transform("v", lambda x: F.abs(x).cast("double")), F.lit(0.0), lambda a, b: a + b)
    return back.select("vec_id", F.size("w").cast("long").alias("n"), F.round(total, 1).alias("total"), V.same_within(F.col("v"), F.col("w"), 1e-3).alias("close"))


@query(
    """WITH i AS (SELECT p_partkey, p_size * 9 + 5 AS height, p_partkey % 70 + 1 AS width FROM part),
q AS (SELECT *, (height + 15) // 16 * 16 AS ph, (width + 15) // 16 * 16 AS pw FROM i)
SELECT p_partkey::VARCHAR AS path, ph AS padded_height, pw AS padded_width,
  (row_number() OVER (PARTITION BY ph, pw ORDER BY p_partkey::VARCHAR) - 1) // 8 AS batch
FROM q"""
)
def padded_batches(t):
    """Images of one padded size go together."""
    i = t.part.select(F.col("p_partkey").cast("string").alias("path"), (F.col("p_size") * 9 + 5).alias("height"), (F.col("p_partkey") % 70 + 1).alias("width"))
    return pixels.by_padded_size(i, 8).select("path", "padded_height", "padded_width", "batch")
