"""The searches as one object: what a service with these tables would answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from magpie.config import SearchConfig, page_args
from magpie.embedders import Embedder
from magpie.functions import formats, paths
from magpie.operators import catalog, incremental, knn, pixels, rerank, tables, votes
from magpie.sources import files
from magpie.streaming import changes


class Search:
    """Tables by name: keypoints, vectors, faces, path_lookup, search_history, search_results, exclusions, collections, jobs."""

    def __init__(self, spark: SparkSession, tables_: dict[str, DataFrame], embedder: Embedder | None = None, config: SearchConfig | None = None):
        self.spark, self.tables, self.embedder, self.config = spark, tables_, embedder, config or SearchConfig()

    def collections(self) -> DataFrame:
        return self.tables["collections"].orderBy("priority", "name")

    # --- local descriptors ---

    def keypoint_search(self, queries: DataFrame, collections: list[str] | None = None, chunks: list[int] | None = None, seed: DataFrame | None = None, localise: bool = False) -> DataFrame:
        """Ranked pages for query keypoints (query_id, kp, q and, for a cap by norms, norm).

        Filters prune partitions; seed: votes of an earlier, stopped run. localise: the first
        results get a box from matched points (x, y on both sides; w, h of the query) and are
        ranked again by their inliers.
        """
        c, side = self.config, self.tables["keypoints"]
        if "norm" in queries.columns:
            queries = knn.cap_keypoints(queries, c.max_keypoints)
        if collections:
            side = side.where(F.col("collection").isin(collections))
        if chunks:
            side = side.where(F.col("chunk_no").isin(chunks))
        got = votes.votes(knn.top_matches(queries, side, c.k, c.threshold, c.scope), c.scope)
        if seed is not None:
            got = votes.merge_votes(got, seed)
        got = got.join(self.tables["path_lookup"], "page_id")
        if "exclusions" in self.tables:
            got = votes.exclude(got, self.tables["exclusions"])
        ranked = votes.rank(votes.adjusted(got, c.page0_factor), c.top_k)
        return self.localised(queries, side, ranked) if localise else ranked

    resume = keypoint_search

    def localised(self, queries: DataFrame, side: DataFrame, ranked: DataFrame) -> DataFrame:
        """Ranked results with the box of the query in each of the first ones, in the order of their inliers; equal ones keep their order."""
        c = self.config
        top = ranked.where(F.col("rank") <= c.localise_top).select("query_id", "page_id")
        group = F.struct("query_id", "page_id")
        left = top.join(queries, "query_id").select(group.alias("g"), F.col("kp").alias("lid"), F.col("q").alias("v"))
        right = top.join(side, "page_id").select(group.alias("g"), F.col("vec_id").alias("rid"), "v")
        pairs = knn.mutual(left, right, c.threshold).select("g.query_id", "g.page_id", "lid", "rid")
        points = pairs.join(queries.select("query_id", F.col("kp").alias("lid"), F.col("x").alias("ax"), F.col("y").alias("ay"), "w", "h"), ["query_id", "lid"])
        points = points.join(side.select("page_id", F.col("vec_id").alias("rid"), F.col("x").alias("bx"), F.col("y").alias("by")), ["page_id", "rid"])
        boxes = pixels.localise(points.select("query_id", "page_id", *(F.col(x).cast("double") for x in ("ax", "ay", "bx", "by", "w", "h"))))
        out = ranked.withColumnRenamed("rank", "prior").join(boxes, ["query_id", "page_id"], "left")
        return rerank.geometric_rank(out, "query_id", c.page0_factor)

    # --- whole items and faces ---

    def image_search(self, data: bytes, k: int) -> DataFrame:
        return self._vector_search(self.embedder.image(data), k)

    def text_search(self, text: str, k: int) -> DataFrame:
        return self._vector_search(self.embedder.text(text), k)

    def _vector_search(self, vector: list[float], k: int) -> DataFrame:
        query = self.spark.createDataFrame([(vector,)], "q array<double>")
        return knn.nearest(query, self.tables["vectors"], k)

    def approximate_search(self, data: bytes, k: int, probes: int = 8) -> DataFrame:
        """As image_search, over the cells nearest to the query of an index made by knn.cells."""
        centres, cells = self.tables["centres"], self.tables["cells"]
        query = self.spark.createDataFrame([(0, 0, self.embedder.image(data))], "query_id long, kp long, q array<double>")
        return knn.probe(query, centres, cells, k, probes)

    def search_all(self, data: bytes, k: int) -> DataFrame:
        """The best k of each collection, merged by score, in one pass."""
        query = self.spark.createDataFrame([(0, 0, self.embedder.image(data))], "query_id long, kp long, q array<double>")
        return rerank.federated(knn.top_by(query, self.tables["vectors"], "collection", k), k)

    def face_search(self, data: bytes, top: int, least: float = 0.0) -> DataFrame:
        rows = [(0, i, v) for i, v in enumerate(self.embedder.faces(data))]
        queries = self.spark.createDataFrame(rows, "query_id long, kp long, q array<double>")
        side = self.tables["faces"].select(F.lit(0).cast("long").alias("chunk_no"), F.col("source_image").alias("page_id"), "vec_id", "v")
        hits = knn.top_matches(queries, side, rerank.per_face_k(top), None, "global")
        return rerank.faces(hits.select(F.col("kp").alias("face"), F.col("page_id").alias("source_image"), F.col("vec_id").alias("face_index"), "score"), top, least)

    def results(self, ranked: DataFrame) -> DataFrame:
        """Results in the form the service gives them."""
        return rerank.result_rows(ranked)

    # --- index ---

    def index(self, root: str, collection: str) -> DataFrame:
        """Vectors of all images below a folder; broken images have an error and no vector."""
        from magpie.embedders import embed

        return embed(files.images(self.spark, root), "content", self.embedder).select(F.lit(collection).alias("collection"), "path", F.col("embedding").alias("v"), "error")

    def add_to_index(self, rows: DataFrame) -> DataFrame:
        """Vectors of new images (collection, path, v) after the known ones; a path that is known already is passed over."""
        old = self.tables["vectors"]
        new = tables.insert_missing(old, rows.where("v IS NOT NULL").select("collection", "path", "v"), ["collection", "path"])
        top = old.agg(F.coalesce(F.max("vec_id"), F.lit(-1))).first()[0]
        new = tables.numbered(new, ["collection", "path"], name="vec_id").withColumn("vec_id", F.col("vec_id") + top)
        self.tables["vectors"] = old.unionByName(new.select(*[c for c in new.columns if c in old.columns]), allowMissingColumns=True)
        return self.tables["vectors"]

    def stats(self) -> DataFrame:
        return self.tables["vectors"].groupBy("collection").agg(F.count("*").alias("vectors"))

    # --- history, exclusions, queue ---

    def history(self, page: int = 1, size: int = 20, kind: str | None = None) -> DataFrame:
        skip, most = page_args(page, size)
        rows = self.tables["search_history"]
        if kind:
            rows = rows.where(F.col("type") == kind)
        return rows.orderBy(F.desc("date"), F.desc("id")).offset(skip).limit(most)

    def history_detail(self, history_id: int) -> DataFrame:
        return self.tables["search_results"].where(F.col("history_id") == history_id).orderBy("rank")

    def store_results(self, history_id: int, ranked: DataFrame) -> DataFrame:
        """The first results of a session in place of those it had."""
        new = ranked.where(F.col("rank") <= self.config.stored_top).select(F.lit(history_id).cast("long").alias("history_id"), "rank", "path", "votes", "score")
        self.tables["search_results"] = tables.replace_by_key(self.tables["search_results"].select(new.columns), new, "history_id")
        return self.tables["search_results"]

    def results_json(self, history_id: int) -> DataFrame:
        return self.history_detail(history_id).select(formats.to_json("rank", "path", "votes", "score").alias("json"))

    def delete_history(self, ids: DataFrame) -> None:
        """Sessions (id) go with their results."""
        self.tables["search_history"], self.tables["search_results"] = tables.delete_cascade(self.tables["search_history"], self.tables["search_results"], ids, "id", "history_id")

    def set_status(self, changes_: DataFrame) -> DataFrame:
        """Sessions after status changes (id, status, ts); changes that are not allowed are ignored."""
        self.tables["search_history"] = incremental.transition(self.tables["search_history"], changes_, "id").drop("seconds")
        return self.tables["search_history"]

    def exclude(self, paths_: list[str]) -> DataFrame:
        """The exclusions with more paths; each is held once."""
        new = self.spark.createDataFrame([(p,) for p in paths_], "path string")
        both = self.tables["exclusions"].select("path").unionByName(new).withColumn("__key", paths.normalise(F.col("path")))
        self.tables["exclusions"] = catalog.first_per_key(both, ["__key"], [F.col("path")]).drop("__key")
        return self.tables["exclusions"]

    def include(self, paths_: list[str]) -> DataFrame:
        gone = self.spark.createDataFrame([(p,) for p in paths_], "path string")
        self.tables["exclusions"] = votes.exclude(self.tables["exclusions"], gone)
        return self.tables["exclusions"]

    def queue_info(self) -> DataFrame:
        return changes.queue(self.tables["jobs"]).orderBy("state", "position", "ts")
