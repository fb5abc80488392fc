"""Text helpers of reports and of the line formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape(text: Column) -> Column:
    r"""Backslash, tab, newline and carriage return as \\, \t, \n, \r."""
    for char, mark in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(char), F.lit(mark))
    return text


def unescape(text: Column) -> Column:
    """What escape() made, undone. Other marks, and a backslash at the end, stay as they are."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)\\.|[^\\]+|\\"), F.lit(0))
    one = lambda x: F.when(x == "\\\\", "\\").when(x == "\\t", "\t").when(x == "\\n", "\n").when(x == "\\r", "\r").otherwise(x)
    return F.when(text.contains("\\"), F.array_join(F.transform(parts, one), "")).otherwise(text)


def human_bytes(n: Column) -> Column:
    k, d = 1024.0, n.cast("double")
    return (
        F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1 << 20, F.format_string("%.1f KB", d / k))
        .when(n < 1 << 30, F.format_string("%.1f MB", d / k**2))
        .otherwise(F.format_string("%.2f GB", d / k**3))
    )


def human_millis(n: Column) -> Column:
    minutes, seconds = F.floor(n / 60_000), F.floor(n % 60_000 / 1000)
    return F.when(n < 1000, F.concat(n.cast("string"), F.lit(" ms"))).when(n < 60_000, F.format_string("%.1f s", n / 1000.0)).otherwise(F.format_string("%d m %d s", minutes, seconds))


def sanitize(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9_-]", "-"))


def is_partition_id(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z0-9._-]{1,128}$") & ~text.isin(".", "..")


def locality_rate(local: Column, fetched: Column) -> Column:
    """Share of local reads; 1 if there were none."""
    return F.when(local + fetched > 0, local / (local + fetched)).otherwise(F.lit(1.0))
