"""Path, title and label functions as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Prefixes that one plan holds.
MOST_PREFIXES = 1000


def normalise(p: Column) -> Column:
    """Forward slashes, no trailing slash, lower case; null becomes empty."""
    return F.lower(F.rtrim(F.replace(F.coalesce(p, F.lit("")), F.lit("\\"), F.lit("/")), F.lit("/")))


def basename(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def dirname(p: Column) -> Column:
    return F.regexp_extract(p, r"^(.*)/[^/]*$", 1)


def stem(p: Column) -> Column:
    return F.regexp_replace(basename(p), r"\.[^.]*$", "")


def extension(p: Column) -> Column:
    return F.lower(F.regexp_extract(basename(p), r"(\.[^.]*)$", 1))


def is_page0(p: Column) -> Column:
    return basename(p).rlike(r"(?i)(^|[-_])page0\.[a-z0-9]+$")


def page_number(p: Column) -> Column:
    return F.when(p.rlike(r"-page\d+\."), F.regexp_extract(p, r"-page(\d+)\.", 1).cast("int"))


def remap(p: Column, prefixes: list[tuple[str, str]]) -> Column:
    """The first prefix that fits is replaced."""
    out = p
    for old, new in reversed(prefixes):
        out = F.when(p.startswith(old), F.concat(F.lit(new), F.substring(p, len(old) + 1, 1 << 30))).otherwise(out)
    return out


def swap_extension(p: Column, to: str) -> Column:
    return F.regexp_replace(p, r"\.[^./]+$", to)


def segment(p: Column, n: int) -> Column:
    """n-th path part from 0; null beyond the end."""
    return F.get(F.split(p, "/"), F.lit(n))


def first_segments(p: Column, n: int) -> Column:
    return F.lower(F.array_join(F.slice(F.split(p, "/"), 1, n), "/"))


def feature_path(p: Column, collection: Column) -> Column:
    """The path below the features of a collection: books without a leading pdf-images, print ads without a market (ebay, etsy) before a subfolder."""
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    first, second = F.lower(F.get(parts, F.lit(0))), F.lower(F.get(parts, F.lit(1)))
    drop = ((collection == "books") & (first == "pdf-images")) | ((collection == "print_ads") & first.isin("ebay", "etsy") & F.coalesce(second.startswith("subfolder"), F.lit(False)))
    return F.array_join(F.when(drop, F.slice(parts, 2, 1 << 20)).otherwise(parts), "/")


def feature_file(p: Column) -> Column:
    """Where the features of an image are kept: the name of its folder, then its stem."""
    q = F.replace(p, F.lit("\\"), F.lit("/"))
    return F.concat(basename(dirname(q)), F.lit("/"), stem(q), F.lit(".npz"))


def label_by_substring(p: Column, names: list[tuple[str, str]], default: str) -> Column:
    out = F.lit(default)
    for part, name in reversed(names):
        out = F.when(F.lower(p).contains(part), F.lit(name)).otherwise(out)
    return out


def natural_key(p: Column, width: int = 12) -> Column:
    """Sorts digit runs by value: each is padded with zeros."""
    parts = F.regexp_extract_all(F.lower(p), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(x, width, "0")).otherwise(x)), "")


def chunk_number(p: Column) -> Column:
    return F.regexp_extract(p, r"(\d+)", 1).cast("int")


# What a title loses or has replaced, in this order.
TITLE_RULES = [(r"\s*--.*$", ""), (r"\[.*?\]", ""), (r"\(.*?\)", ""), ("[_©―`″]", " "), ("[,;:]", ""), ("&", "and"), (r"\s+", " ")]


def title(p: Column, most: int = 100) -> Column:
    """A file title without what follows a double dash, brackets, marks and repeated blanks, cut at a word's end."""
    for pattern, to in TITLE_RULES:
        p = F.regexp_replace(p, pattern, to)
    p = F.trim(p)
    return F.when(F.length(p) > most, F.regexp_replace(F.substring(p, 1, most), " [^ ]*$", "")).otherwise(p)


def unique_titles(rows: DataFrame, name: str, order: str, into: str = "title") -> DataFrame:
    """Titles of names; from the second one of the same title on, each has its number."""
    n = F.row_number().over(Window.partitionBy("__t").orderBy(order))
    out = rows.withColumn("__t", title(F.col(name)))
    return out.withColumn(into, F.when(n > 1, F.concat_ws(" ", "__t", n.cast("string"))).otherwise(F.col("__t"))).drop("__t")


def resolve(rows: DataFrame, prefixes: DataFrame, path: str = "path") -> DataFrame:
    """The collection that a path belongs to and the rest of the path: of the prefixes that fit, the one with the least order.

    prefixes: collection, prefix, order, a dimension of a few dozen rows. A prefix on drive S: or T:
    also fits the mirrored drive, next after itself. Paths that fit none have null columns.
    """
    slashes = lambda c: F.rtrim(F.replace(c, F.lit("\\"), F.lit("/")), F.lit("/"))
    plain = prefixes.select("collection", slashes(F.col("prefix")).alias("prefix"), F.col("order").cast("double").alias("order"))
    drive = F.substring("prefix", 1, 3)
    mirror = plain.where(drive.isin("S:/", "T:/")).select("collection", F.concat(F.when(drive == "S:/", "T:/").otherwise("S:/"), F.substring("prefix", 4, 1 << 20)).alias("prefix"), (F.col("order") + 0.5).alias("order"))
    rules = plain.unionByName(mirror)
    most = rules.limit(MOST_PREFIXES + 1).count()
    if most > MOST_PREFIXES:
        raise ValueError(f"more than {MOST_PREFIXES} prefixes")
    rules = rules.groupBy().agg(F.array_sort(F.collect_list(F.struct("order", "collection", "prefix"))).alias("__rules"))
    whole = slashes(F.col(path))
    fits = lambda r: (F.lower(whole) == F.lower(r["prefix"])) | F.startswith(F.lower(whole), F.concat(F.lower(r["prefix"]), F.lit("/")))
    out = rows.crossJoin(F.broadcast(rules)).withColumn("__hit", F.get(F.filter("__rules", fits), F.lit(0)))
    rest = F.ltrim(F.expr(f"substring(rtrim('/', replace({path}, '\\\\', '/')), length(__hit.prefix) + 1)"), F.lit("/"))
    return out.select(*rows.columns, F.col("__hit.collection").alias("owner"), F.when(F.col("__hit").isNotNull(), rest).alias("rest"))


def found_spelling(rows: DataFrame, known: DataFrame, path: str = "path") -> DataFrame:
    """rows with the spelling under which each path is known: its own, else with curly, else with straight apostrophes; else its own."""
    have = known.select(F.col(path).alias("__known")).distinct()
    straight, curly = apostrophes(F.col(path))
    tries = F.array(F.col(path), curly, straight)
    hits = rows.select(path).distinct().select(path, F.posexplode(tries).alias("__n", "__known")).join(have, "__known")
    best = hits.groupBy(path).agg(F.min_by("__known", "__n").alias("found"))
    return rows.join(best, path, "left").withColumn("found", F.coalesce("found", path))


def match_key(p: Column) -> Column:
    """Equal for titles that differ only in quotes and case."""
    return F.lower(F.translate(p, "'’‘`", ""))


def apostrophes(p: Column) -> tuple[Column, Column]:
    """The straight and the curly spelling, to look up one after the other."""
    return F.translate(p, "’", "'"), F.translate(p, "'", "’")


def starts_with_folder(name: Column, folder: Column) -> Column:
    return F.startswith(F.lower(name), F.lower(folder))


def expected_name(folder: Column, n: Column) -> Column:
    return F.concat(folder, F.lit("-page"), n.cast("string"), F.lit(".jpg"))


def stored_path(folder: Column, name: Column) -> Column:
    return F.concat_ws("/", folder, F.concat(name, F.lit(".npz")))


def face_source(face_id: Column) -> Column:
    return F.regexp_replace(face_id, "_face_[^_]*$", "")


def short_message(p: Column, most: int = 200) -> Column:
    return F.left(p, F.lit(most))


def _fold(names: pd.Series) -> pd.Series:
    return names.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


def ascii_fold(name: Column) -> Column:
    """NFKD without marks, without characters illegal in names, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.pandas_udf(_fold, "string")(name), r'[<>:"/\\|?*]', ""), r"\s+", " "))


def holds_any(columns: list[Column], word: str) -> Column:
    """Whether any of the columns holds a word, as it is; nulls hold nothing."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(c.contains(word), F.lit(False))
    return out
