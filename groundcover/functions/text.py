"""Codes, spans and hosts inside free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract_code(col: Column | str, pattern: str = r"(\d{6})", kind: str = "long") -> Column:
    """First match of the pattern's first group, also inside longer digit runs."""
    col = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.regexp_extract(col, pattern, 1), F.lit("")).try_cast(kind)


def highlight_span(text: Column, spans: Column) -> Column:
    """Cuts `text` at the first listed span it contains, ignoring case.

    Struct (before, match, after); without a match all of the text is `before`.
    """
    lowered = F.lower(text)
    hit = F.try_element_at(
        F.filter(spans, lambda s: F.contains(lowered, F.lower(s))), F.lit(1)
    )
    start = F.call_function("instr", lowered, F.lower(hit))
    return F.when(
        hit.isNotNull(),
        F.struct(
            F.substring(text, F.lit(1), start - 1).alias("before"),
            F.substring(text, start, F.length(hit)).alias("match"),
            F.substring(text, start + F.length(hit), F.length(text)).alias("after"),
        ),
    ).otherwise(
        F.struct(
            text.alias("before"),
            F.lit(None).cast("string").alias("match"),
            F.lit(None).cast("string").alias("after"),
        )
    )


def domain(url: Column) -> Column:
    """Lower-case host without port, login, one trailing dot and one leading 'www.'."""
    authority = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    host = F.regexp_extract(F.lower(authority), r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1)
    host = F.regexp_replace(F.trim(host), r"\.+$", "")
    return F.regexp_replace(host, r"^www\.", "")


def with_disclaimer(message: str) -> Column:
    return F.lit(message)
