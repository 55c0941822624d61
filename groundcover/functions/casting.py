"""Casts that turn unreadable text into NULL, never into 0 or "no"."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_cast(col: Column | str, kind: str) -> Column:
    return _col(col).try_cast(kind)


def with_reported(df: DataFrame, columns: Sequence[tuple[str, str, str]], kind: str) -> DataFrame:
    """For each (raw, clean, flag): the typed value and whether it was readable."""
    added = {}
    for raw, clean, flag in columns:
        value = safe_cast(raw, kind)
        added[clean] = value
        added[flag] = value.isNotNull()
    return df.withColumns(added)


def cast_columns(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    return df.withColumns({c: safe_cast(c, kind) for c in columns})


def bool_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return cast_columns(df, columns, "boolean")


def numeric_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return cast_columns(df, columns, "double")


def within_box(
    lat: Column | str,
    lon: Column | str,
    lat_range: tuple[float, float],
    lon_range: tuple[float, float],
) -> Column:
    """Inclusive bounding box. Unknown stays NULL unless the other side already fails."""
    return _col(lat).between(*lat_range) & _col(lon).between(*lon_range)


def first_nonempty(*cols: Column | str) -> Column:
    """First value that is neither NULL nor the empty string; blanks count as values."""
    return F.coalesce(*[F.nullif(_col(c).cast("string"), F.lit("")) for c in cols])


def clean_text(col: Column | str) -> Column:
    return F.nullif(F.trim(_col(col).cast("string")), F.lit(""))


def as_bool(col: Column | str, numeric: bool = False) -> Column:
    """Lenient yes/no: unknown is false. `numeric` columns are true when not 0."""
    if numeric:
        return F.coalesce(_col(col) != 0, F.lit(False))
    text = F.lower(F.trim(_col(col).cast("string")))
    return F.coalesce(text.isin("true", "1", "yes", "y"), F.lit(False))


def as_float(col: Column | str) -> Column:
    return safe_cast(col, "double")


def as_int(col: Column | str) -> Column:
    """Whole part of any readable number ('12.7' gives 12)."""
    return safe_cast(col, "double").try_cast("int")


def clean_suppressed(
    df: DataFrame, suffix: str = "_pct", markers: Sequence[str] = ("*", "NA", "N/A", "")
) -> DataFrame:
    """Text columns ending in `suffix` become numbers plus a low-confidence flag.

    A value written in parentheses is a small-sample estimate: it keeps its number
    and raises the flag. Suppression markers become NULL. Columns that are already
    numeric are left alone.
    """
    out = []
    for name, kind in df.dtypes:
        if not (name.endswith(suffix) and kind == "string"):
            out.append(F.col(name))
            continue
        bare = F.regexp_replace(name, "[()]", "")
        out.append(F.when(~bare.isin(*markers), bare.try_cast("double")).alias(name))
        out.append(F.col(name).rlike(r"^\(.*\)$").alias(f"{name}_low_confidence"))
    return df.select(*out)


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col
