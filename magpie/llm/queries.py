"""The registered queries of these operators, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontam import contamination
from .host_quality import judge_hosts
from .mil_quality import held_out, score_quality, train
from .near_dup import near_duplicates
from .packing import pack_documents
from .substring_dedup import repeated_windows
from .suffix_dedup import repeated_bytes
from .token_store import token_store
from .tokens import byte_bpe
from .url_rules import document_of, filter_urls
from .warc import archive

#: Given url rules: host and path prefix, action.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as token ids in Simple-8b shards, read back."""
    got = token_store(_table(spark, sf_dir, "documents"), byte_bpe(), end=0)
    return got.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated windows of 35 words removed."""
    got = repeated_windows(_table(spark, sf_dir, "documents"), window=35)
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back; from the last chunk of each record."""
    got = archive(_table(spark, sf_dir, "pages"), with_data=False).where("last")
    revisit = F.col("record_type") == "revisit"
    size = F.when(revisit, F.col("header_bytes")).otherwise(F.col("payload_bytes"))
    digest = F.when(revisit, F.col("header_digest")).otherwise(F.col("digest"))
    return got.select(F.col("record_id").alias("page_id"), size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    got = pack_documents(_table(spark, sf_dir, "documents"), byte_bpe(), end=1, length=2048, with_ids=False)
    return got.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark items they overlap with."""
    got = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.col("overlaps.item_id")))
    longest = F.array_max(F.transform("overlaps", lambda x: x["end"] - x["start"]))
    return got.select("doc_id", (F.size("overlaps") > 0).alias("contaminated"), items.alias("item_ids"), F.coalesce(longest, F.lit(0)).alias("longest_overlap"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page url. The path of a page ends with the number of the document that it shows."""
    got = filter_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"), URL_RULES, document=document_of(F.col("url")))
    return got.select("page_id", "host", "path", "rule", "verdict")


def op7_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base signals of every document and the verdict after its host's failure rate."""
    got = judge_hosts(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 200 bytes removed."""
    got = repeated_bytes(_table(spark, sf_dir, "documents"), window=200)
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups at 80 % of 4-word shingles."""
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op10_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document."""
    docs = _table(spark, sf_dir, "documents")
    got = score_quality(docs.select("doc_id", "text"), train(docs, _table(spark, sf_dir, "labels")))
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_token_store, op2_substring_dedup, op3_warc, op4_packing, op5_decontamination, op6_url_rules, op7_host_quality, op8_suffix_dedup, op9_near_duplicates, op10_mil_quality)}

# Words as [^\x20\x09-\x0D]+ without empty ones.
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]'), lambda x: x <> '')"

ORACLE_SQL = {
    "op2_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i+34], ' ')) AS h FROM p),
dup AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM h JOIN dup USING (h)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM hit),
g AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id),
pos AS (SELECT d.doc_id, len(w) AS n, coalesce(len(ks), 0) AS r, ks, w, range(1, len(w) + 1) AS ps FROM d LEFT JOIN g USING (doc_id)),
kept AS (SELECT doc_id, n, r, CASE WHEN r = 0 THEN w ELSE list_transform(list_filter(ps, lambda k: NOT list_contains(ks, k)), lambda k: w[k]) END AS l FROM pos)
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(coalesce(array_to_string(l, ' '), '')) AS kept_sha256 FROM kept""",
    "op3_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d FROM p),
m AS (SELECT d, max(page_id) AS stored FROM q WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, q.d AS payload_digest,
       CASE WHEN stored IS NULL OR stored = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN stored <> page_id THEN stored END AS refers_to
FROM q LEFT JOIN m ON q.d = m.d""",
    "op9_near_duplicates": rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT b.a, b.b FROM b JOIN c x ON x.doc_id = b.a JOIN c y ON y.doc_id = b.b WHERE 100 * k >= 80 * (x.n + y.n - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS v, doc_id AS t FROM d UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.t)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, m.t AS component_id, d.doc_id = m.t AS kept
FROM d LEFT JOIN c USING (doc_id) JOIN (SELECT v, min(t) AS t FROM r GROUP BY v) m ON m.v = d.doc_id""",
    "op7_host_quality": rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
t AS (SELECT doc_id, i, array_to_string(w[i:i+2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
g AS (SELECT doc_id, g FROM t GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS k FROM t JOIN g USING (doc_id, g)) GROUP BY doc_id),
n AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls FROM d),
b AS (SELECT d.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN n USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, sum(base_failed::BIGINT) AS x FROM f GROUP BY source),
m AS (SELECT sum(x) / sum(n) AS mu, greatest(var_pop(x / n) - (sum(x) / sum(n)) * (1 - sum(x) / sum(n)) * avg(1.0 / n), 0) AS bv FROM h),
k AS (SELECT mu, CASE WHEN bv > 0 THEN least(greatest(mu * (1 - mu) / bv - 1, 1), 1000) ELSE 1000 END AS wt FROM m),
v AS (SELECT source, (x + mu * wt) / (n + wt) AS rate FROM h, k)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source""",
}
