"""Quality rules for documents, with verdicts on their hosts.

Each document is judged by fixed rules on its whole text. Failures are summed by host, the failure
rates are shrunk towards a Beta prior fitted to all hosts by its moments, and a host whose shrunk
rate is too high takes its documents with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Words, covered
from .store import save, ship

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def signals(text: str) -> tuple[int, int, int, int, int]:
    """Words; code points in them; symbols; lines with a word that are equal to an earlier line; words in 3-word windows that occur twice or more."""
    words = Words(text.encode())
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    repeated = 0
    if words.n > 3:
        _, back, count = np.unique(words.windows(3), return_inverse=True, return_counts=True)
        repeated = int(covered(words.n, np.flatnonzero(count[back] > 1), 3).sum())
    return words.n, len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def base_signals(docs: DataFrame, host: str) -> DataFrame:
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [signals(t.as_py() or "") for t in batch.column(1)]
            columns = [pa.array(c, pa.int64()) for c in zip(*got, strict=True)] or [pa.array([], pa.int64())] * len(SIGNALS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["doc_id", "host", *SIGNALS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(host).cast("string").alias("host"))
    out = rows.mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{x} long" for x in SIGNALS))
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def host_rates(base: DataFrame) -> DataFrame:
    """Per host: documents, failures, and the failure rate shrunk by an empirical Beta prior.

    The prior's mean and variance are those of the hosts' own rates; with fewer than two hosts, or
    hosts that differ no more than chance, it weighs as much as 1,000 documents.
    """
    hosts = base.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    hosts = save(hosts, "hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    # one row
    m = hosts.agg(F.sum("n_failed") / F.sum("n_docs"), F.var_pop(rate), F.avg(1 / F.col("n_docs"))).first()
    mean, spread, inverse = (float(x or 0) for x in m)
    noise = mean * (1 - mean)
    between = max(spread - noise * inverse, 0.0)
    weight = min(max(noise / between - 1, 1.0), 1000.0) if between > 0 else 1000.0
    return hosts.withColumn("rate", (F.col("n_failed") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight)))


def judge_hosts(docs: DataFrame, host: str = "source", most: float = 0.5) -> DataFrame:
    """Base signals and verdicts per document.

    docs: doc_id, text and a host column; other columns are ignored. Returns doc_id, host, n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (under 50 words, or over half
    the words in repeated 3-word windows), host_rate and kept: neither the document failed nor its
    host, whose shrunk failure rate must not be above ``most``. A null text has no words and fails;
    a null host is one host of its own; repeated rows count as often as they come; an empty table
    gives no rows.
    """
    base = save(base_signals(docs, host), "signals")
    rates = host_rates(base).select(F.coalesce("host", F.lit("\0")).alias("key"), F.col("rate").alias("host_rate"))
    out = base.withColumn("key", F.coalesce("host", F.lit("\0"))).join(rates, "key").drop("key")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= most))
