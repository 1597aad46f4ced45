"""Text forms of times, progress and metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def progress(text: Column) -> tuple[Column, Column]:
    """(done, total) of a text such as 'chunk 3 / 40'; null without one."""
    found = text.rlike(r"\d+\s*/\s*\d+")
    part = lambda k: F.when(found, F.regexp_extract(text, r"(\d+)\s*/\s*(\d+)", k).cast("int"))
    return part(1), part(2)


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), done * 100.0 / total))).otherwise(0.0)


def eta_seconds(elapsed: Column, done: Column, total: Column) -> Column:
    return F.when(done > 0, elapsed / done * (total - done))


def eta_text(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    d, h, m = F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60
    return F.when(s >= 86400, F.format_string("%dd %dh", d, h)).when(s >= 3600, F.format_string("%dh %dm", h, m)).otherwise(F.format_string("%dm", m))


def duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.format_string("%dms", ms)).when(ms < 60000, F.format_string("%.1fs", ms / 1000)).when(ms < 3600000, F.format_string("%.1fm", ms / 60000)).otherwise(F.format_string("%.1fh", ms / 3600000))


def day_label(ts: Column, today: Column) -> Column:
    gap = F.datediff(today, ts)
    return F.when(gap == 0, F.lit("Today")).when(gap == 1, F.lit("Yesterday")).otherwise(F.date_format(ts, "yyyy-MM-dd"))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def meta_int(json: Column, key: str) -> Column:
    """A whole number, or a string of one; else null."""
    return F.get_json_object(json, f"$.{key}").try_cast("int")


def badge(kind: Column) -> Column:
    return F.when(kind.startswith("1"), F.lit("danger")).when(kind.startswith("2"), F.lit("warning")).when(kind.startswith("3"), F.lit("info")).otherwise(F.lit("secondary"))


def to_json(*columns: str) -> Column:
    """Columns as one JSON object, nulls included."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def from_json(text: Column, schema: str) -> Column:
    """The columns back; null for a text that is no such object."""
    return F.from_json(text, schema)
