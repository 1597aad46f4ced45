"""Queries of the index, quality, history, scalar and incremental families."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from magpie.functions import formats as fm
from magpie.functions import paths as P
from magpie.functions import vectors as V
from magpie.operators import catalog, incremental, pixels, rerank, tables
from magpie.plans.fixtures import HISTORY, PATHS, RESULTS, Tables, chain
from magpie.plans.registry import query
from magpie.sources import files
from magpie.streaming import changes

# --- catalogue -------------------------------------------------------------------------------


@query("SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 7 AS chunk FROM events")
def chunk_pack_exact(t):
    """Items split where a chunk is full."""
    return catalog.pack_exact(t.events.select("event_id", "user_id"), "user_id", ["event_id"], 7)


@query("SELECT event_id, event_type, least(pos // greatest(1, count(*) OVER (PARTITION BY event_type) // 4), 3) AS part FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos FROM events)")
def chunk_split_equal(t):
    """The last part takes the remainder."""
    rows = catalog.pack_exact(t.events.select("event_id", "event_type"), "event_type", ["event_id"], 1).withColumnRenamed("chunk", "pos")
    return catalog.split_equal(rows, "event_type", "pos", 4).select("event_id", "event_type", "part")


@query("WITH RECURSIVE o AS (SELECT source, doc_id, n_chars AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents), f AS (SELECT source, doc_id, n, i, 0::BIGINT AS chunk, n AS held FROM o WHERE i = 1 UNION ALL SELECT o.source, o.doc_id, o.n, o.i, CASE WHEN f.held >= 20000 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.held >= 20000 THEN o.n ELSE f.held + o.n END FROM f JOIN o ON o.source = f.source AND o.i = f.i + 1) SELECT source, doc_id, n AS n_chars, chunk FROM f")
def chunk_pack_greedy(t):
    """Chunks closed once they hold the cap."""
    return catalog.pack_greedy(t.documents, "source", "doc_id", "n_chars", 20_000)


@query("WITH known AS (SELECT DISTINCT source, lang AS path FROM documents WHERE doc_id < 30), k AS (SELECT source, path, row_number() OVER (PARTITION BY source ORDER BY path) - 1 AS id FROM known), new AS (SELECT source, lang AS path, min(doc_id) AS pos FROM documents GROUP BY ALL), x AS (SELECT * FROM new ANTI JOIN known USING (source, path)), top AS (SELECT source, max(id) AS top FROM k GROUP BY source) SELECT source, path, coalesce(top, -1) + row_number() OVER (PARTITION BY source ORDER BY pos, path) AS id FROM x LEFT JOIN top USING (source)")
def compact_ids(t):
    """New paths continue the ids in first-seen order."""
    d = t.documents.select("source", F.col("lang").alias("path"), F.col("doc_id").alias("pos"))
    known = catalog.pack_exact(d.where("pos < 30").select("source", "path").distinct(), "source", ["path"], 1).withColumnRenamed("chunk", "id")
    return catalog.assign_ids(known, d, "source")


@query("WITH k AS (SELECT label AS collection, vec_id AS id FROM embeddings), s AS (SELECT collection, max(id) AS top FROM k WHERE id < 250 GROUP BY collection) SELECT collection, id FROM k LEFT JOIN s USING (collection) WHERE id > coalesce(top, -1)")
def dictionary_delta(t):
    """Only rows beyond the largest stored id."""
    k = t.embeddings.select(F.col("label").alias("collection"), F.col("vec_id").alias("id"))
    return catalog.new_ids_only(k.where("id < 250"), k)


_RUNS = "l AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type OR row_number() OVER w = 1 THEN 0 ELSE 1 END AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), i AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM l), r AS (SELECT user_id, seq::BIGINT AS seq, any_value(event_type) AS event_type, count(*) AS n FROM i GROUP BY user_id, seq)"


def _runs(t: Tables):
    return catalog.run_lengths(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query(f"WITH {_RUNS} SELECT * FROM r")
def rle_encode(t):
    """A12 K9."""
    return _runs(t)


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, event_type FROM events")
def rle_decode(t):
    """The sequence back from its runs."""
    return catalog.expand_runs(_runs(t), "user_id", "event_type")


@query(f"""WITH {_RUNS}
SELECT user_id, sum(n)::BIGINT AS items, count(*) AS runs, count(DISTINCT event_type) AS kinds, arg_max(n, seq) AS tail,
  round(sum(n) / greatest(count(DISTINCT event_type), 1), 6) AS ratio
FROM r GROUP BY user_id""")
def chunk_stats(t):
    """Items, runs, distinct values, their ratio and the last run of each chunk."""
    r = _runs(t)
    sums = r.groupBy("user_id").agg(F.sum("n").alias("items"), F.count("*").alias("runs"), F.countDistinct("event_type").alias("kinds"), F.max_by("n", "seq").alias("tail"))
    return sums.withColumn("ratio", F.round(F.col("items") / F.greatest("kinds", F.lit(1)), 6))


@query("SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM documents GROUP BY source UNION ALL SELECT lang, array_to_string(list_sort(list(DISTINCT source)), ',') FROM documents GROUP BY lang")
def book_chunk_index(t):
    """Sorted sets in both directions."""
    a, b = catalog.two_way_index(t.documents, "source", "lang")
    return a.select("source", F.array_join("langs", ",").alias("langs")).unionByName(b.select(F.col("lang").alias("source"), F.array_join("sources", ",").alias("langs")))


@query("SELECT source, lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) = 1")
def first_dir_wins(t):
    """The first location of each chunk."""
    return catalog.first_per_key(t.documents, ["source", "lang"], [F.desc("n_chars"), F.col("doc_id")]).select("source", "lang", "doc_id")


@query("SELECT source, doc_id, 30000 - (c - n_chars) AS inside FROM (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS c FROM documents) WHERE c - n_chars < 30000 AND c > 30000".replace("30000 - (c - n_chars)", "(30000 - (c - n_chars))::BIGINT"))
def boundary_item(t):
    """The item that spans a boundary."""
    return catalog.boundary_item(t.documents, "source", "doc_id", "n_chars", 30_000).withColumnRenamed("inner", "inside")


@query("WITH a AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events), b AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM events WHERE event_id % 13 <> 5) SELECT user_id, min(CASE WHEN a.event_type <> b.event_type THEN pos END) AS first FROM a JOIN b USING (user_id, pos) GROUP BY user_id")
def first_mismatch(t):
    """The first place where two aligned sequences differ."""
    seq = lambda d: catalog.pack_exact(d, "user_id", ["event_id"], 1).select("user_id", "event_type", (F.col("chunk") + 1).alias("pos"))
    return catalog.first_mismatch(seq(t.events), seq(t.events.where("event_id % 13 <> 5")), ["user_id"], "event_type")


@query("SELECT label AS collection, max(vec_id // 128) + 1 AS next_chunk, count(DISTINCT vec_id // 40) AS books FROM embeddings GROUP BY label")
def rebuild_state(t):
    """A29."""
    return catalog.rebuild_state(t.keypoints().withColumn("book", F.expr("vec_id div 40")))


@query("SELECT event_type, arg_max(user_id, (ts, event_id)) AS user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY event_type")
def latest_snapshot(t):
    """The latest record of each prefix."""
    return catalog.latest(t.events, "event_type", ["ts", "event_id"], ["user_id", "value"])


@query("SELECT coalesce(a.k, b.k) AS chunk_no, coalesce(n, 0) AS vectors, coalesce(m, 0) AS ids, coalesce(n, 0) = coalesce(m, 0) AS ok FROM (SELECT doc_id // 50 AS k, count(*) AS n FROM documents GROUP BY k) a FULL JOIN (SELECT doc_id // 50 AS k, count(*) AS m FROM labels GROUP BY k) b ON a.k = b.k")
def reconcile(t):
    """Counts on both sides of a chunk."""
    a, b = (x.select(F.expr("doc_id div 50").alias("chunk_no")) for x in (t.documents, t.labels))
    return tables.assert_aligned(a, b, ["chunk_no"])


# --- duplicates and quality ------------------------------------------------------------------


@query("SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS n, (count(*) - 1) * any_value(octet_length(encode(text))) AS wasted FROM documents GROUP BY hash HAVING count(*) > 1")
def hash_dedup(t):
    """Content hashes held more than once, and the space they waste."""
    size = F.octet_length("text").cast("long")
    return t.documents.groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), ((F.count("*") - 1) * F.max(size)).alias("wasted")).where("n > 1")


@query("SELECT doc_id FROM documents d WHERE doc_id % 4 <> 0 AND NOT EXISTS (SELECT 1 FROM documents k WHERE k.doc_id % 4 = 0 AND sha256(k.text) = sha256(d.text) AND k.source = d.source)")
def two_stage_dedup(t):
    """Paths first, then content within the collection."""
    new = t.documents.join(t.documents.where("doc_id % 4 = 0").select("doc_id"), "doc_id", "left_anti")
    known = t.documents.where("doc_id % 4 = 0").select(F.sha2("text", 256).alias("hash"), "source").distinct()
    return new.withColumn("hash", F.sha2("text", 256)).join(known, ["hash", "source"], "left_anti").select("doc_id")


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, sum(octet_length(encode(props)))::BIGINT AS bytes,
  sum(octet_length(encode(props)))::BIGINT // count(*) AS mean_bytes, round(avg(octet_length(encode(props))), 6) AS average,
  round(sum(octet_length(encode(props))) / 1048576.0, 6) AS mb, min(ts) AS first, max(ts) AS last
FROM events GROUP BY event_type""")
def hash_stats(t):
    """Counts, sizes and times by collection; the mean in whole numbers too."""
    size = F.octet_length("props").cast("long")
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.sum(size).alias("bytes"), F.expr("sum(octet_length(props)) div count(*)").alias("mean_bytes"), F.round(F.avg(size), 6).alias("average"), F.round(F.sum(size) / 1048576.0, 6).alias("mb"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("WITH i AS (SELECT doc_id, source FROM documents WHERE doc_id % 3 <> 0), f AS (SELECT doc_id FROM labels) SELECT coalesce(source, 'unknown') AS source, count(i.doc_id) AS images, count(i.doc_id) FILTER (f.doc_id IS NULL) AS missing, count(f.doc_id) FILTER (i.doc_id IS NULL) AS extra, round(count(i.doc_id) FILTER (f.doc_id IS NOT NULL) / greatest(count(i.doc_id), 1), 6) AS ratio FROM i FULL JOIN f ON i.doc_id = f.doc_id GROUP BY ALL")
def coverage(t):
    """Images against features."""
    i = t.documents.where("doc_id % 3 <> 0").select("doc_id", "source", F.lit(1).alias("i"))
    both = i.join(t.labels.select("doc_id", F.lit(1).alias("f")), "doc_id", "full")
    return both.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("i").alias("images"), F.count_if(F.col("i").isNotNull() & F.col("f").isNull()).alias("missing"), F.count_if(F.col("i").isNull() & F.col("f").isNotNull()).alias("extra"), F.round(F.count_if(F.col("i").isNotNull() & F.col("f").isNotNull()) / F.greatest(F.count("i"), F.lit(1)), 6).alias("ratio"))


@query("SELECT doc_id, 'orphan' AS kind FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE doc_id % 5 <> 0) UNION ALL SELECT doc_id, 'unprocessed' FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'both' FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)")
def orphans(t):
    """Set differences and intersection."""
    d, f = t.documents.select("doc_id"), t.labels.select("doc_id").distinct()
    return f.join(d.where("doc_id % 5 <> 0"), "doc_id", "left_anti").withColumn("kind", F.lit("orphan")).unionByName(d.join(f, "doc_id", "left_anti").withColumn("kind", F.lit("unprocessed"))).unionByName(d.join(f, "doc_id", "left_semi").withColumn("kind", F.lit("both")))


@query("SELECT lower(source) || '/' || lang AS folder, count(*) AS known FROM (SELECT source, lang, doc_id FROM documents WHERE doc_id % 2 = 0 UNION SELECT d.source, d.lang, doc_id FROM labels JOIN documents d USING (doc_id) WHERE toxic = 1) GROUP BY folder")
def known_per_folder(t):
    """Dictionary and quarantine together, by the first two path parts."""
    path = F.concat_ws("/", F.upper("source"), "lang", F.col("doc_id").cast("string")).alias("path")
    a = t.documents.where("doc_id % 2 = 0").select(path)
    b = t.labels.where("toxic = 1").join(t.documents, "doc_id").select(path)
    return a.unionByName(b).distinct().groupBy(P.first_segments(F.col("path"), 2).alias("folder")).agg(F.count("*").alias("known"))


@query("SELECT source, count(*) AS n FROM documents WHERE n_chars > 1500 GROUP BY source HAVING count(*) > 0 ORDER BY count(*) DESC, source LIMIT 10")
def terms_top(t):
    """The most frequent terms."""
    return t.documents.where("n_chars > 1500").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


# --- history -------------------------------------------------------------------------------


@query(chain(HISTORY, RESULTS) + """SELECT id, date, type, a.path AS first_path, a.votes AS first_votes, b.votes AS second_votes
FROM hs LEFT JOIN rs a ON a.history_id = id AND a.rank = 1 LEFT JOIN rs b ON b.history_id = id AND b.rank = 2
WHERE type = '1-URGENT' ORDER BY date DESC, id DESC LIMIT 20 OFFSET 20""")
def history_page(t):
    """A page of searches with their first and second results; only the results of the page are ranked."""
    page = t.history().where("type = '1-URGENT'").orderBy(F.desc("date"), F.desc("id")).offset(20).limit(20)
    of = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    top = t.results(page).where("rank <= 2").groupBy(F.col("history_id").alias("id")).agg(of(1, "path").alias("first_path"), of(1, "votes").alias("first_votes"), of(2, "votes").alias("second_votes"))
    return page.join(top, "id", "left").select("id", "date", "type", "first_path", "first_votes", "second_votes")


@query(chain(HISTORY) + "SELECT type, count(*) AS n FROM hs WHERE status <> 'in_progress' GROUP BY type")
def history_count(t):
    """A26."""
    return t.history().where("status <> 'in_progress'").groupBy("type").agg(F.count("*").alias("n"))


@query(chain(RESULTS) + "SELECT history_id, rank, path, votes, score FROM rs JOIN orders ON o_orderkey = history_id")
def history_detail(t):
    """The ranked details of all sessions."""
    return t.history().select(F.col("id").alias("history_id")).join(t.results(), "history_id").select("history_id", "rank", "path", "votes", "score")


@query(chain(RESULTS) + "SELECT history_id, max(CASE WHEN rank = 1 THEN votes END) AS top, max(CASE WHEN rank = 2 THEN votes END) AS second, count(*) AS n FROM rs GROUP BY history_id")
def top_result_view(t):
    """J5 in one pass."""
    pick = lambda k: F.max(F.when(F.col("rank") == k, F.col("votes")))
    return t.results().groupBy("history_id").agg(pick(1).alias("top"), pick(2).alias("second"), F.count("*").alias("n"))


@query(chain(RESULTS) + "SELECT history_id, rank, path, votes FROM rs WHERE history_id % 50 <> 0 UNION ALL SELECT history_id, rank, path, votes + 1 FROM rs WHERE history_id % 50 = 0 AND rank <= 2")
def replace_results(t):
    """K7: all rows of a session are replaced."""
    r = t.results().select("history_id", "rank", "path", "votes")
    new = r.where("history_id % 50 = 0 AND rank <= 2").withColumn("votes", F.col("votes") + 1)
    return tables.replace_by_key(r, new, "history_id")


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, 9, max(n_chars)::INT FROM documents WHERE doc_id % 3 = 0 GROUP BY doc_id")
def upsert_by_key(t):
    """K3-K5: merge by key."""
    new = t.documents.where("doc_id % 3 = 0").select("doc_id", F.lit(9).alias("quality"), F.col("n_chars").cast("int").alias("toxic"))
    return tables.upsert(t.labels, new, ["doc_id"], "toxic")


@query("SELECT sha256(text) AS hash, source FROM documents WHERE doc_id % 2 = 1 EXCEPT SELECT sha256(text), source FROM documents WHERE doc_id % 2 = 0")
def insert_missing(t):
    """K6: rows whose key is new."""
    rows = t.documents.select("doc_id", F.sha2("text", 256).alias("hash"), "source")
    return tables.insert_missing(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), ["hash", "source"]).select("hash", "source")


@query(chain(HISTORY, RESULTS) + "SELECT 'header' AS part, count(*) AS n FROM hs WHERE status <> 'stopped' UNION ALL SELECT 'detail', count(*) FROM rs WHERE history_id NOT IN (SELECT id FROM hs WHERE status = 'stopped')")
def cascade_delete(t):
    """Headers go with their details."""
    h = t.history()
    a, b = tables.delete_cascade(h, t.results(), h.where("status = 'stopped'"), "id", "history_id")
    return a.agg(F.count("*").alias("n")).select(F.lit("header").alias("part"), "n").unionByName(b.agg(F.count("*").alias("n")).select(F.lit("detail").alias("part"), "n"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, min(ts) AS started, max(ts) AS ended FROM events GROUP BY user_id")
def status_latest(t):
    """The latest state of each session."""
    e = t.events.select("user_id", "ts", "event_id", F.col("event_type").alias("status"))
    return incremental.latest_status(e, "user_id")


@query(chain(HISTORY) + "SELECT id, CASE WHEN status = 'in_progress' AND date < TIMESTAMP '1996-06-01' THEN 'failed' ELSE status END AS status FROM hs")
def stuck_sessions(t):
    """X13 K16."""
    return incremental.repair_stuck(t.history(), F.lit("1996-06-01").cast("timestamp")).select("id", "status")


# --- scalars -------------------------------------------------------------------------------


@query(chain(PATHS) + "SELECT page_id, lower(path) AS norm, split_part(path, '/', 3) AS base, 'Books/Book' || book AS dir, regexp_replace(split_part(path, '/', 3), '\\.[^.]*$', '') AS stem, '.jpg' AS ext, split_part(path, '/', 2) AS seg, regexp_matches(path, '-page0\\.') AS cover, regexp_extract(path, '-page(\\d+)\\.', 1)::INT AS page, regexp_replace(path, '\\.jpg$', '.npz') AS npz FROM pt")
def path_functions(t):
    """F1-F4 F6 F8."""
    p = F.col("path")
    return t.paths().select("page_id", P.normalise(F.concat(F.replace(p, F.lit("/"), F.lit("\\")), F.lit("/"))).alias("norm"), P.basename(p).alias("base"), P.dirname(p).alias("dir"), P.stem(p).alias("stem"), P.extension(p).alias("ext"), P.segment(p, 1).alias("seg"), P.is_page0(p).alias("cover"), P.page_number(p).alias("page"), P.swap_extension(p, ".npz").alias("npz"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://m.') THEN 's3://mobile/' || substr(url, 11) WHEN starts_with(url, 'https://') THEN 's3://web/' || substr(url, 9) ELSE url END AS path, CASE WHEN contains(lower(url), 'blog') THEN 'blogs' WHEN contains(lower(url), 'www') THEN 'sites' ELSE 'other' END AS kind FROM pages")
def prefix_remap(t):
    """The first prefix that fits."""
    u = F.col("url")
    return t.pages.select("page_id", P.remap(u, [("https://m.", "s3://mobile/"), ("https://", "s3://web/")]).alias("path"), P.label_by_substring(u, [("blog", "blogs"), ("www", "sites")], "other").alias("kind"))


@query(chain(PATHS) + "SELECT page_id, row_number() OVER (ORDER BY book, CASE WHEN page_id % 11 = 0 THEN 0 ELSE page_id END, page_id) AS place FROM pt")
def natural_sort(t):
    """Digit runs by value; places are counted by ranges."""
    keyed = t.paths().select("page_id", P.natural_key(F.col("path")).alias("key"))
    return tables.numbered(keyed, ["key", "page_id"]).select("page_id", "place")


@query("SELECT event_id, (event_id % 50)::INT AS done, 40 AS total, least(100, event_id % 50 * 100.0 / 40)::DOUBLE AS percent FROM events")
def progress_parse(t):
    """F17."""
    done, total = fm.progress(F.concat(F.lit("chunk "), (F.col("event_id") % 50).cast("string"), F.lit(" / 40 read")))
    return t.events.select("event_id", done.alias("done"), total.alias("total")).withColumn("percent", fm.percent(F.col("done"), F.col("total")))


@query("SELECT p_partkey, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN printf('%.1fs', ms / 1000) WHEN ms < 3600000 THEN printf('%.1fm', ms / 60000) ELSE printf('%.1fh', ms / 3600000) END AS took, CASE WHEN s >= 86400 THEN printf('%dd %dh', s // 86400, s // 3600 % 24) WHEN s >= 3600 THEN printf('%dh %dm', s // 3600, s // 60 % 60) ELSE printf('%dm', s // 60 % 60) END AS eta FROM (SELECT p_partkey, p_partkey * p_partkey * 7 + 8 AS ms, p_partkey * 131 AS s FROM part)")
def duration_format(t):
    """H2 H3."""
    k = F.col("p_partkey")
    return t.part.select("p_partkey", fm.duration(k * k * 7 + 8).alias("took"), fm.eta_text(k * 131).alias("eta"))


@query("SELECT o_orderkey, CASE date_diff('day', o_orderdate::DATE, DATE '1996-01-02') WHEN 0 THEN 'Today' WHEN 1 THEN 'Yesterday' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS label, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, CASE left(o_orderpriority, 1) WHEN '1' THEN 'danger' WHEN '2' THEN 'warning' WHEN '3' THEN 'info' ELSE 'secondary' END AS badge, left(o_orderpriority, 4) AS short FROM orders")
def date_labels(t):
    """H4 H5 H8 F18."""
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", fm.day_label(d, F.lit("1996-01-02").cast("date")).alias("label"), fm.iso(d).alias("iso"), fm.badge(F.col("o_orderpriority")).alias("badge"), P.short_message(F.col("o_orderpriority"), 4).alias("short"))


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, TRY_CAST(json_extract_string(props, '$.none') AS INT) AS none,
  '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS packed, event_type AS back
FROM events""")
def json_meta(t):
    """H6 H7: whole numbers of metadata; rows as JSON and back."""
    out = t.events.withColumn("packed", fm.to_json("event_id", "event_type"))
    back = fm.from_json(F.col("packed"), "event_id long, event_type string")["event_type"]
    return out.select("event_id", fm.meta_int(F.col("props"), "k").alias("k"), fm.meta_int(F.col("props"), "none").cast("int").alias("none"), "packed", back.alias("back"))


@query("SELECT page_id, CASE WHEN contains(lower(url), 'blog') THEN 'blog' WHEN contains(lower(url), 'spam') THEN 'spam' ELSE '/de/' END AS item FROM pages WHERE contains(lower(url), 'blog') OR contains(lower(url), 'spam') OR contains(lower(url), '/de/') UNION ALL SELECT -1, item FROM (VALUES ('blog'), ('spam'), ('/de/'), ('nowhere')) AS t(item) WHERE NOT EXISTS (SELECT 1 FROM pages WHERE contains(lower(url), item))")
def substring_list_filter(t):
    """Which item of a list a path holds, and the items found nowhere."""
    items = ["blog", "spam", "/de/", "nowhere"]
    url = F.lower("url")
    hit = F.get(F.filter(F.array(*map(F.lit, items)), lambda i: F.contains(url, i)), F.lit(0))
    found = t.pages.select("page_id", hit.alias("item")).where("item IS NOT NULL")
    every = t.spark.createDataFrame([(x,) for x in items], "item string")
    hits = t.pages.select(F.explode(F.filter(F.array(*map(F.lit, items)), lambda i: F.contains(url, i))).alias("item")).distinct()
    return found.unionByName(every.join(hits, "item", "left_anti").select(F.lit(-1).cast("long").alias("page_id"), "item"))


@query("""WITH b AS (
  SELECT *, greatest(0, least(l_quantity * 4 - 20, 99)) / 100 AS x1, greatest(0, least(l_quantity * 5 - 10, 99)) / 100 AS x2,
    greatest(0, least(l_linenumber - 1.0, 9)) / 10 AS y1, greatest(0, least(l_linenumber * 2.0, 9)) / 10 AS y2
  FROM lineitem)
SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, ((l_partkey + 15) // 16) * 16 AS padded,
  round(least(1.0, 512.0 / greatest(l_partkey, l_suppkey)), 6) AS factor, floor((l_partkey * 1000 - 200) / 512)::BIGINT AS vectors,
  CASE WHEN x2 > x1 AND y2 > y1 THEN round(x1, 6) END::DOUBLE AS x1, CASE WHEN x2 > x1 AND y2 > y1 THEN round(y1, 6) END::DOUBLE AS y1,
  CASE WHEN x2 > x1 AND y2 > y1 THEN round(x2, 6) END::DOUBLE AS x2, CASE WHEN x2 > x1 AND y2 > y1 THEN round(y2, 6) END::DOUBLE AS y2,
  CASE WHEN x2 > x1 AND y2 > y1
    THEN printf('left:%.2f%%;top:%.2f%%;width:%.2f%%;height:%.2f%%;', (x1 * 100)::DOUBLE, (y1 * 100)::DOUBLE, ((x2 - x1) * 100)::DOUBLE, ((y2 - y1) * 100)::DOUBLE)
    ELSE '' END AS style
FROM b""")
def geometry_functions(t):
    """Boxes of matches, whole and in percent, of every row."""
    p, s, q, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity"), F.col("l_linenumber")
    rows = t.lineitem.withColumn("b", V.box(q * 4 - 20, n - F.lit(1.0), q * 5 - 10, n * F.lit(2.0), F.lit(100.0), F.lit(10.0)))
    corners = [F.round(F.col("b")[c], 6).alias(c) for c in ("x1", "y1", "x2", "y2")]
    return rows.select(F.col("l_orderkey").alias("k"), n.alias("n"), p.alias("p"), s.alias("s"), V.padded(p).alias("padded"), F.round(V.resize_factor(p, s, 512), 6).alias("factor"), V.vectors_in(p * 1000).alias("vectors"), *corners, V.percent_box(F.col("b")).alias("style"))


@query("""WITH n AS (
  SELECT p_partkey, p_name, p_name || ' a and b x y' AS short FROM part)
SELECT p_partkey, lower(translate(p_name || '''s “x”', '''’‘`', '')) AS key, replace(p_name || '-page3.jpg', p_name, '') AS rest,
  starts_with(lower(p_name || '-page3.jpg'), lower(p_name)) AS fits, p_name || '/f.npz' AS stored, p_name AS source,
  CASE WHEN row_number() OVER (PARTITION BY short ORDER BY p_partkey) > 1
    THEN short || ' ' || row_number() OVER (PARTITION BY short ORDER BY p_partkey) ELSE short END AS title
FROM n""")
def title_functions(t):
    """Titles without marks and brackets, numbered where they are equal."""
    n, size = F.col("p_name"), F.col("p_size").cast("string")
    long = F.concat(n, F.lit(" [vol. "), size, F.lit("] (new); a & b, x_y -- "), size, F.lit(" -- z"))
    titled = P.unique_titles(t.part.withColumn("long", long), "long", "p_partkey")
    return titled.select("p_partkey", P.match_key(F.concat(n, F.lit("'s “x”"))).alias("key"), F.replace(F.concat(n, F.lit("-page3.jpg")), n, F.lit("")).alias("rest"), P.starts_with_folder(F.concat(n, F.lit("-page3.jpg")), n).alias("fits"), P.stored_path(n, F.lit("f")).alias("stored"), P.face_source(F.concat(n, F.lit("_face_"), size)).alias("source"), "title")


# --- incremental ---------------------------------------------------------------------------


@query("""WITH c AS (
  SELECT CASE WHEN lang = 'es' THEN source || '/._batch_' || doc_id % 3 ELSE source || '/' || lang END AS folder, doc_id FROM documents),
cur AS (SELECT folder, count(*) AS current FROM c GROUP BY folder UNION ALL SELECT 'empty/scanned', 0 UNION ALL SELECT 'empty/new', 0),
s AS (
  SELECT folder, count(*) AS scanned FROM c WHERE NOT starts_with(folder, 'src3/') GROUP BY folder
  UNION ALL SELECT 'empty/scanned', 0),
k AS (SELECT folder, count(*) AS known FROM c WHERE doc_id % 31 <> 1 OR starts_with(folder, 'src3/') GROUP BY folder)
SELECT folder, current, scanned, coalesce(known, 0) AS known,
  CASE WHEN contains(folder, '/._batch_') THEN 'process'
    WHEN scanned IS NOT NULL AND current = scanned AND coalesce(known, 0) >= current THEN 'skip'
    WHEN scanned IS NULL AND coalesce(known, 0) >= current AND current > 0 THEN 'recover' ELSE 'process' END AS action
FROM cur LEFT JOIN s USING (folder) LEFT JOIN k USING (folder)""")
def folder_skip(t):
    """Which folders need work; virtual batches always do, and a folder scanned as empty differs from one never scanned."""
    folder = F.when(F.col("lang") == "es", F.concat("source", F.lit("/._batch_"), (F.col("doc_id") % 3).cast("string"))).otherwise(F.concat_ws("/", "source", "lang"))
    c = t.documents.select(folder.alias("folder"), "doc_id")
    n = lambda d: d.groupBy("folder").agg(F.count("*").alias("n"))
    none = lambda *names: t.spark.createDataFrame([(x, 0) for x in names], "folder string, n long")
    src3 = F.col("folder").startswith("src3/")
    # other case and slashes on the scanned side
    scanned = n(c.where(~src3)).unionByName(none("empty/scanned")).withColumn("folder", F.upper(F.replace("folder", F.lit("/"), F.lit("\\"))))
    return incremental.folder_state(n(c).unionByName(none("empty/scanned", "empty/new")), scanned, n(c.where((F.col("doc_id") % 31 != 1) | src3)), "folder")


@query("SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 AS batch FROM documents")
def virtual_batches(t):
    """X11."""
    return incremental.virtual_batches(t.documents.select("doc_id", "source"), "source", "doc_id", 20)


@query("WITH e AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'CUDA' WHEN event_id % 10 = 1 THEN 'broken' END AS error FROM events) SELECT CASE WHEN error IS NULL THEN 'done' WHEN error = 'CUDA' THEN 'again' ELSE 'quarantine' END AS state, count(*) AS n FROM e GROUP BY state")
def quarantine_split(t):
    """Device failures are tried again, broken items are put aside."""
    e = t.events.select("event_id", F.when(F.col("event_id") % 10 == 0, "CUDA out of memory").when(F.col("event_id") % 10 == 1, "broken").alias("error"))
    names = ("done", "quarantine", "again")
    parts = [p.agg(F.count("*").alias("n")).select(F.lit(s).alias("state"), "n") for s, p in zip(names, incremental.split_by_status(e), strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_EVENTS = "e AS (SELECT ts, CASE WHEN event_id % 3 = 0 THEN 'delete' ELSE 'create' END AS kind, user_id AS name, event_type AS category FROM events)"


@query(f"WITH {_EVENTS}, d AS (SELECT * FROM e WHERE kind = 'delete'), m AS (SELECT d.ts, d.name, d.category, arg_min(c.category, (c.ts, c.category)) AS new_category FROM d JOIN e c ON c.kind = 'create' AND c.name = d.name AND c.category <> d.category AND epoch(c.ts) - epoch(d.ts) BETWEEN 0 AND 36000 GROUP BY ALL) SELECT d.ts, CASE WHEN new_category IS NULL THEN 'delete' ELSE 'move' END AS kind, name, category, new_category FROM d LEFT JOIN m USING (ts, name, category)")
def delete_or_move(t):
    """A delete that turns up elsewhere is a move."""
    e = t.events.select("ts", F.when(F.col("event_id") % 3 == 0, "delete").otherwise("create").alias("kind"), F.col("user_id").alias("name"), F.col("event_type").alias("category"))
    return changes.reclassify(e, 36_000)


@query("SELECT page_id, replace(url, 'example.net', 'sample.net') AS url, (SELECT count(*) FROM pages WHERE contains(url, 'example.net')) AS touched FROM pages")
def rename_paths(t):
    """A rename and how many rows it touches."""
    rows, count = changes.apply_event(t.pages.select("page_id", "url"), "url", "rename", "example.net", "sample.net")
    return rows.crossJoin(F.broadcast(count))


@query("""WITH j AS (
  SELECT event_id AS job_id, ts, CASE WHEN event_id % 3 = 0 THEN 'queued' WHEN event_id % 3 = 1 THEN 'done' ELSE 'running' END AS state
  FROM events),
n AS (
  SELECT *, row_number() OVER (PARTITION BY state ORDER BY ts, job_id) AS p, row_number() OVER (PARTITION BY state ORDER BY ts DESC, job_id DESC) AS d
  FROM j)
SELECT job_id, ts, state, CASE WHEN state = 'queued' THEN p END AS position FROM n WHERE state <> 'done' OR d <= 100""")
def job_queue(t):
    """Places in the queue, the last results kept."""
    return changes.queue(t.events.select(F.col("event_id").alias("job_id"), "ts", F.when(F.col("event_id") % 3 == 0, "queued").when(F.col("event_id") % 3 == 1, "done").otherwise("running").alias("state")))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(t):
    """Event-time windows, offered natively."""
    from magpie.streaming.votes import event_counts

    return event_counts(t.events, "10 minutes", "1 hour").select(F.col("window.start").alias("hour"), "event_type", "n")


@query(chain(HISTORY) + "SELECT id, type LIKE '%HIGH%' OR type LIKE '1%' AS urgent, status IN ('stopped') AND type LIKE '5%' AS again, CASE WHEN id % 2 = 1 AND id % 3 = 0 THEN 'skip' WHEN id % 2 = 1 THEN 'error' ELSE 'move' END AS action FROM hs")
def session_predicates(t):
    """P11 P12 P15 P17."""
    kind = F.when(F.col("type").like("5%"), F.lit("Disk search")).otherwise(F.lit("text"))
    return t.history().select("id", (F.col("type").like("%HIGH%") | F.col("type").like("1%")).alias("urgent"), incremental.resumable(kind, F.col("status")).alias("again"), incremental.move_action(F.col("id") % 2 == 0, F.col("id") % 3 == 0).alias("action"))


@query("""SELECT doc_id, CASE WHEN n.path IS NOT NULL THEN n.path ELSE d.p END AS found
FROM (SELECT doc_id, 'It''s ' || doc_id AS p FROM documents) d
LEFT JOIN (SELECT doc_id, 'It’s ' || doc_id AS path FROM documents WHERE doc_id % 3 = 0) n USING (doc_id)""")
def apostrophe_lookup(t):
    """the spelling under which a path is known."""
    path = lambda mark: F.concat(F.lit(f"It{mark}s "), F.col("doc_id").cast("string")).alias("path")
    return P.found_spelling(t.documents.select("doc_id", path("'")), t.documents.where("doc_id % 3 = 0").select(path("’"))).select("doc_id", "found")


@query("""SELECT page_id, CASE WHEN page_id % 4 IN (0, 1) THEN 'books' END AS owner,
  CASE WHEN page_id % 4 IN (0, 1) THEN 'B' || page_id % 9 || '/p' || page_id || '.jpg' END AS rest,
  'B' || page_id % 9 || '/p' || page_id || '.npz' AS features
FROM pages""")
def path_owner(t):
    """The collection that owns a path, by an ordered dimension of prefixes and their mirrored drives; where its features are."""
    n = F.col("page_id")
    start = F.when(n % 4 == 0, F.lit("T:/books/")).when(n % 4 == 1, F.lit("s:\\books/")).otherwise(F.lit("D:/books/"))
    path = F.concat(start, F.lit("B"), (n % 9).cast("string"), F.lit("/p"), n.cast("string"), F.lit(".jpg"))
    prefixes = t.spark.createDataFrame([("books", "S:\\books\\", 1), ("other", "T:/", 2)], "collection string, prefix string, order int")
    got = P.resolve(t.pages.select("page_id", path.alias("path")), prefixes)
    return got.select("page_id", "owner", "rest", P.feature_file(F.col("path")).alias("features"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'b/' || doc_id WHEN 1 THEN 'Subfolder1/' || doc_id WHEN 2 THEN 'etsy/x/' || doc_id ELSE 'pdf-images/' || doc_id END AS path,
  'Uber Cafe ' || doc_id AS folded
FROM documents""")
def path_rules(t):
    """Leading parts dropped by collection; names folded to ASCII."""
    n = F.col("doc_id")
    k = lambda i: n % 4 == i
    path = F.concat(F.when(k(0), "PDF-images//b/").when(k(1), "eBay/Subfolder1/").when(k(2), "etsy/x/").otherwise("pdf-images/"), n.cast("string"))
    kind = F.when(k(0), "books").otherwise("print_ads")
    return t.documents.select("doc_id", P.feature_path(path, kind).alias("path"), P.ascii_fold(F.concat(F.lit("Über:  <Café>? "), n.cast("string"))).alias("folded"))


@query("""SELECT min_by(url, page_id) AS url, min(page_id) AS page_id
FROM (SELECT page_id, split_part(url, '/', 3) AS url FROM pages) GROUP BY lower(url)""")
def ordered_distinct(t):
    """The first spelling of each text, without regard to case."""
    return tables.distinct_first(t.pages.select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("url")), "url", "page_id")


@query('SELECT count(*) > 0 AS "some", false AS none FROM documents WHERE n_chars > 10')
def existence(t):
    """Whether there is a row."""
    d = t.documents
    return t.spark.createDataFrame([(rerank.exists(d.where("n_chars > 10")), rerank.exists(d.where("n_chars < 0")))], "some boolean, none boolean")


@query("""SELECT 'pages' AS store, 'done' AS status, count(*) FILTER (contains(url, 'blog') OR contains(url, '/fr/')) AS touched FROM pages
UNION ALL SELECT 'labels', 'failed', 0
UNION ALL SELECT 'kept', 'done', count(*) FILTER (NOT contains(url, 'blog') AND NOT contains(url, '/fr/')) FROM pages""")
def delete_in_stores(t):
    """Rows that hold any of some words go from several stores, each with its status."""
    got = tables.delete_where({"pages": t.pages, "labels": t.labels}, "url", ["blog", "/fr/"])
    kept = got["pages"][0].agg(F.lit("kept").alias("store"), F.lit("done").alias("status"), F.count("*").alias("touched"))
    return got["pages"][1].unionByName(got["labels"][1]).unionByName(kept)


@query("""WITH s AS (SELECT user_id, arg_min(event_type, (ts, event_id)) AS first, min(ts) AS started FROM events GROUP BY user_id),
o AS (SELECT user_id, CASE WHEN first = 'click' THEN 'completed' ELSE 'in_progress' END AS old, started FROM s),
c AS (
  SELECT user_id, CASE event_type WHEN 'click' THEN 'stopped' WHEN 'view' THEN 'in_progress' ELSE 'completed' END AS new, ts FROM events),
f AS (
  SELECT user_id, arg_min(new, (ts, new)) AS new, min(ts) AS ended FROM c JOIN o USING (user_id)
  WHERE old = 'in_progress' AND new <> 'in_progress' GROUP BY user_id)
SELECT user_id, coalesce(new, old) AS status, ended, date_diff('microsecond', started, ended) / 1e6 AS seconds FROM o LEFT JOIN f USING (user_id)""")
def guarded_transitions(t):
    """Each session takes its first allowed change; a finished one takes none."""
    e = t.events
    first = e.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first"), F.min("ts").alias("started"))
    old = first.select("user_id", F.when(F.col("first") == "click", "completed").otherwise("in_progress").alias("status"), "started", F.lit(None).cast(e.schema["ts"].dataType).alias("ended"))
    new = F.when(F.col("event_type") == "click", "stopped").when(F.col("event_type") == "view", "in_progress").otherwise("completed")
    return incremental.transition(old, e.select("user_id", new.alias("status"), "ts"), "user_id").select("user_id", "status", "ended", F.col("seconds").cast("double").alias("seconds"))


@query("""SELECT source AS folder, count(*) AS current, count(l.doc_id) AS known, CASE WHEN count(l.doc_id) >= count(*) THEN 'skip' ELSE 'process' END AS action
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source""")
def folder_by_image(t):
    """X10, the variant that looks at each image."""
    images = t.documents.select(F.col("source").alias("folder"), F.col("doc_id").alias("path"))
    return incremental.folder_state_by_image(images, t.labels.select(F.col("doc_id").alias("path")), "folder")


@query("""SELECT source AS folder, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM documents
WHERE source IN ('src1', 'src2', 'src3') GROUP BY source""")
def listed_folders(t):
    """Listed folders that exist and hold an image."""
    rows = t.documents.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("length"))
    wanted = t.spark.createDataFrame([("src1",), ("src2",), ("src3",), ("nowhere",)], "folder string")
    return files.listed_folders(wanted, rows)


# --- pixels (no SQL) -----------------------------------------------------------------------


def _scene(seed: int) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    rng = np.random.default_rng(seed)
    page = rng.integers(0, 256, (96, 128)).astype(np.uint8)
    y, x = int(rng.integers(0, 60)), int(rng.integers(0, 90))
    return page, page[y : y + 32, x : x + 32], (y, x)


@query()
def template_match(t):
    """A planted patch is found again."""

    def run(frames):
        for f in frames:
            rows = []
            for seed in f.page_id:
                page, patch, at = _scene(int(seed))
                best = pixels.template(pixels.pad_to(page), patch)
                rows.append((seed, best["score"], best["y"] == at[0] and best["x"] == at[1], pixels.blank(page)))
            yield pd.DataFrame(rows, columns=["page_id", "score", "found", "blank"])

    # few bytes but much work: a stated number of partitions is not put together again
    pages = t.paths().select("page_id").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "page_id")
    return pages.mapInPandas(run, "page_id long, score double, found boolean, blank boolean")


@query()
def homography_box(t):
    """Boxes from matched points with outliers."""
    p = t.paths().select(F.lit(0).cast("long").alias("query_id"), "page_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("i"))
    ax, ay = F.pmod(F.col("i") * 37, F.lit(100)).cast("double"), F.pmod(F.col("i") * 53, F.lit(80)).cast("double")
    off = F.when(F.col("i") % 5 == 0, F.pmod(F.col("i") * 91, F.lit(200))).otherwise(0)
    return pixels.localise(p.select("query_id", "page_id", ax.alias("ax"), ay.alias("ay"), (ax * 0.5 + F.col("page_id") + off).alias("bx"), (ay * 0.5 + 10 - off).alias("by"), F.lit(100.0).alias("w"), F.lit(80.0).alias("h")))
