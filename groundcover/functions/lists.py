"""List-valued columns and the counters built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRINGS = "array<string>"


def parse_list_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """JSON array text to arrays; malformed text becomes NULL."""
    return df.withColumns({c: F.from_json(F.col(c), STRINGS) for c in columns})


def _literal(col: Column) -> Column:
    """A Python-style list or tuple as JSON text: round brackets become square, None becomes null."""
    square = F.regexp_replace(col, r"(?s)^\s*\((.*),\s*\)\s*$", "[$1]")
    square = F.regexp_replace(square, r"(?s)^\s*\((.*,.*)\)\s*$", "[$1]")
    return F.regexp_replace(square, r"(?<=[\[,]\s{0,9})None(?=\s*[,\]])", "null")


def parse_list_any(col: Column | str) -> Column:
    """Array from JSON, a quoted list or a tuple; any other text is a list of one.

    Items are trimmed and blank or NULL items dropped; missing text is an empty list.
    """
    col = F.col(col) if isinstance(col, str) else col
    single = F.array(F.coalesce(F.get_json_object(col, "$"), col))
    items = F.coalesce(F.from_json(col, STRINGS), F.from_json(_literal(col), STRINGS), single)
    cleaned = F.filter(F.transform(items, lambda item: F.trim(item)), lambda item: item != "")
    return F.when(F.trim(col) != "", cleaned).otherwise(F.array().cast(STRINGS))


def type_count(col: Column | str) -> Column:
    """Number of entries, repeats and NULLs included."""
    return F.size(F.coalesce(col if isinstance(col, Column) else F.col(col), F.array()))


def distinct_count(col: Column | str) -> Column:
    """Number of different non-NULL entries; the empty string counts."""
    col = F.coalesce(col if isinstance(col, Column) else F.col(col), F.array())
    return F.size(array_difference(col, F.array(F.lit(None).cast("string"))))


def array_difference(left: Column, right: Column) -> Column:
    """Entries of `left` not in `right`, each once."""
    return F.array_except(left, right)


def source_counts(df: DataFrame, types_col: str, urls_col: str) -> DataFrame:
    return df.withColumns(
        {"source_type_count": type_count(types_col), "source_url_count": distinct_count(urls_col)}
    )


def richness_prior(
    types: Column, urls: Column, staff: Column, logo: Column, null_presence: str = "zero"
) -> Column:
    """0..1 prior from source counts and presence flags.

    An unknown flag adds nothing (`zero`). `saturate` gives such rows a prior of 1.
    """
    flags = (staff.cast("int"), logo.cast("int"))
    if null_presence == "zero":
        flags = tuple(F.coalesce(f, F.lit(0)) for f in flags)
    elif null_presence != "saturate":
        raise ValueError(f"null_presence must be 'zero' or 'saturate', not {null_presence!r}")
    total = F.least(types / F.lit(4.0), F.lit(0.4)) + F.least(urls / F.lit(5.0), F.lit(0.3))
    for flag in flags:
        total = total + flag * F.lit(0.15)
    return F.least(F.lit(1.0), total)  # least() skips NULL
