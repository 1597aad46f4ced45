"""URL filtering by given host and path rules and by mined association rules.

Spark's FP-growth mines token combinations of labelled urls; rules that lead to the label "bad" with
enough support and confidence are kept, without those that a shorter rule makes needless. Each
rule is posted in an inverted index under its rarest token. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import save

BAD = "label:bad"
#: Standard deviations by which a rule has to be surer than the share of bad urls.
SURE = 2.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct parts of a url that can recur: scheme, host labels and suffixes, path parts, parameter names, ending, fragment."""
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.rlike(r"^\d+(\.\w+)?$"))
    query = F.filter(F.split(F.coalesce(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit("")), "&"), lambda x: x != "")
    named = F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("host:"), x)),
        F.array(F.concat(F.lit("site:"), host)),
        F.transform(parts, lambda x: F.concat(F.lit("path:"), x)),
        F.transform(query, lambda x: F.concat(F.lit("query:"), F.split_part(x, F.lit("="), F.lit(1)))),
        F.array(F.concat(F.lit("end:"), F.regexp_extract(path, r"(\.\w+|/)\z", 1)), F.concat(F.lit("part:"), F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)#(.*)\z", 1)), F.concat(F.lit("scheme:"), F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A(.*?)://", 1))),
    )
    return F.array_distinct(F.filter(named, lambda x: ~x.endswith(":")))


def listed(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (host and path prefix) that fits, and its action.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    """
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(action)
    return rule, action


def document_of(url: Column) -> Column:
    """The number that ends a url's path, as in /en/17, /en/17/ and /en/17.html; null without one."""
    return F.regexp_extract(path_of(url), r"/(\d+)(?:\.\w+)?/?\z", 1).try_cast("long")


def _surely(rate: Column, n: Column) -> Column:
    """Lower end of Wilson's interval of a share of n, at ``SURE`` standard deviations."""
    z = SURE * SURE
    return (rate + z / (2 * n) - SURE * F.sqrt(rate * (1 - rate) / n + z / (4 * n * n))) / (1 + z / n)


def mine(pages: DataFrame, labels: DataFrame, support: float = 0.002, confidence: float = 0.6, least: int = 20) -> DataFrame:
    """Rules (antecedent, confidence, support, key) for bad urls. pages: url, document; labels: doc_id, quality, toxic; bad: quality 0 or toxic 1.

    A rule needs the given support and at least ``least`` urls, the given confidence, and a
    confidence that is surely above the share of bad urls. With fewer than ``least`` labelled urls nothing is mined.
    """
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    marks = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy(F.col("doc_id").alias("document")).agg(F.max(bad).alias("bad"))
    known = pages.select("document", "url").where("url IS NOT NULL").join(marks, "document")
    items = known.select("bad", F.when(F.col("bad"), F.array_append(tokens_of(F.col("url")), BAD)).otherwise(tokens_of(F.col("url"))).alias("items"))
    items = save(items, "transactions")
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total, n_bad = items.agg(F.count("*"), F.count_if("bad")).first()
    if total < least or not n_bad:
        return spark.createDataFrame([], "antecedent array<string>, confidence double, support double, key string")
    model = FPGrowth(minSupport=max(support, least / total), minConfidence=confidence, itemsCol="items", numPartitions=parts).fit(items.select("items"))
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD)))
    rules = rules.where(_surely(F.col("confidence"), F.col("support") * total / F.col("confidence")) > n_bad / total).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    rules = save(rules, "rules")
    # a rule is needless if a part of its antecedent makes a rule of no less confidence
    short = rules.select(F.col("antecedent").alias("part"), F.col("confidence").alias("c"), F.explode("antecedent").alias("token"))
    needless = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(short, "token")
    needless = needless.where((F.size("part") < F.size("antecedent")) & (F.size(F.array_except("part", "antecedent")) == 0) & (F.col("c") >= F.col("confidence"))).select("antecedent").distinct()
    kept = rules.join(needless, "antecedent", "left_anti")
    counts = model.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("token"), "freq")
    keys = kept.select("antecedent", F.explode("antecedent").alias("token")).join(counts, "token").groupBy("antecedent").agg(F.min_by("token", F.struct("freq", "token")).alias("key"))
    return kept.join(keys, "antecedent")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct urls that fit a mined rule, with the best confidence. urls: url."""
    words = urls.where("url IS NOT NULL").select("url").distinct().withColumn("tokens", tokens_of(F.col("url")))
    posted = words.select("url", "tokens", F.explode("tokens").alias("key")).join(rules, "key")
    return posted.where(F.size(F.array_except("antecedent", "tokens")) == 0).groupBy("url").agg(F.max("confidence").alias("confidence"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], support: float = 0.002, confidence: float = 0.6, document: Column | None = None) -> DataFrame:
    """A verdict for every page url.

    pages: page_id, url; other columns are ignored. document: which labelled document a page shows
    (of the columns of pages; the page_id by default). Returns page_id, url, host, path, rule (the
    longest given rule that fits, else null), confidence (of the best mined rule that fits, else
    null) and verdict: the given rule's action, else block if a mined rule fits, else allow. A null
    url, or one without ://, has an empty host and path, fits no rule and is allowed. Repeated rows
    get one verdict each; empty tables give no rows; with fewer than 20 labelled urls, or none that
    is bad, nothing is mined.
    """
    document = F.col("page_id") if document is None else document
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), document.cast("long").alias("document"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, action = listed(F.col("host"), F.col("path"), rules)
    out = pages.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "action": action})
    found = save(matched(pages, mine(pages, labels, support, confidence)), "matched")
    out = out.join(found, "url", "left")
    verdict = F.coalesce("action", F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "url", "host", "path", "rule", "confidence", verdict.alias("verdict"))
