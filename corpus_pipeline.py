"""The corpus pipeline: quality, near duplicates, repeated strings, benchmark overlaps, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from magpie.llm.decontam import decontaminate
from magpie.llm.mil_quality import score_quality, train
from magpie.llm.near_dup import near_duplicates
from magpie.llm.packing import pack_documents
from magpie.llm.store import fresh, save, settled
from magpie.llm.suffix_dedup import repeated_bytes
from magpie.llm.tokens import byte_bpe


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (a score of at least 0.5).

    Null and empty texts are scored like any other, rows with a null doc_id and repeated rows too.
    Without labels every document has the same score, 0.5, and stays; an empty table stays empty;
    all columns are kept, whatever their names.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh("score", docs)
    return score_quality(docs, model, into=score).where(F.col(score) >= 0.5).select(docs.columns)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that with the smallest doc_id.

    Groups: Jaccard similarity of 0.8 or more on five-word shingles. Documents with a null doc_id
    or without words are in no group and stay. Of the rows of one doc_id one stays: that with the
    largest text, then with the largest other columns. An empty table stays empty.
    """
    gone = settled(spark, lambda: near_duplicates(docs, shingle=5, percent=80).where("NOT kept").select("doc_id").distinct(), "gone")
    # written, so that Spark knows their number: where they are few, the texts need not be dealt out for them
    again = save(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    # a null doc_id matches none, so those rows stay
    single = docs.join(gone.unionByName(again).distinct(), "doc_id", "left_anti")
    place = fresh("place", docs)
    first = Window.partitionBy("doc_id").orderBy(F.desc_nulls_last("text"), F.desc(F.to_json(F.struct(*docs.columns))))
    one = docs.join(again, "doc_id", "left_semi").join(gone, "doc_id", "left_anti").withColumn(place, F.row_number().over(first))
    return single.unionByName(one.where(F.col(place) == 1).drop(place)).select(docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte covered by a 200-byte string that also starts elsewhere is cut from the text.

    The text is what remains (a character that lost some of its bytes goes as a whole) and n_chars
    its length; texts without such strings are untouched, null ones too. No row goes, even if its
    text becomes empty; rows with a null doc_id are cut like others, and so are repeated rows, which
    are copies of each other. An empty table stays empty.
    """
    identity, sha, kept = (fresh(x, docs) for x in ("identity", "sha", "kept"))

    def find() -> DataFrame:
        cut = repeated_bytes(docs, window=200, characters=True).where("n_removed > 0")
        # equal texts lose the same bytes, so rows that share a doc_id are told apart by their texts
        return cut.select(F.col("doc_id").alias(identity), F.col("sha256").alias(sha), F.col("kept").alias(kept)).dropDuplicates([identity, sha])

    cut = settled(spark, find, "cut")
    whole = F.sha2(F.col("text").cast("binary"), 256)
    out = docs.join(cut, F.col("doc_id").cast("long").eqNullSafe(F.col(identity)) & (whole == F.col(sha)), "left")
    changed = F.col(sha).isNotNull()
    columns = {"text": F.when(changed, F.col(kept)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(columns).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item.

    Null and empty texts overlap with nothing and stay; so do all documents without a benchmark;
    repeated rows and rows with a null doc_id are treated alike; an empty table stays empty.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents packed into sequences of at most 2048 tokens, a row per piece with its ids and its place.

    A null or empty text is its end id alone; repeated rows are packed as often as they come; a
    null doc_id stays null; an empty table gives no pieces.
    """
    return pack_documents(docs, byte_bpe(), end=1, length=2048)


STAGES = [("quality", quality), ("near_dup", near_dup), ("suffix_dedup", suffix_dedup), ("decontamination", decontamination), ("packing", packing)]

#: The classifier cannot be expressed in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written as Parquet and read again. An empty table of documents gives no pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs
