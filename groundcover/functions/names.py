"""Name normalisation and lookup keys."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACCENT_FREE = "UNICODE_CI_AI"


def norm_name(col: Column | str, empty_as_null: bool = False) -> Column:
    """Whitespace runs to one space, trimmed, lower case."""
    col = F.col(col) if isinstance(col, str) else col
    name = F.lower(F.trim(F.regexp_replace(col, r"\s+", " ")))
    return F.nullif(name, F.lit("")) if empty_as_null else name


def same_name(left: Column, right: Column) -> Column:
    """Equality that ignores case, accents and outer blanks, inside the JVM."""
    return F.collate(F.trim(left), ACCENT_FREE) == F.collate(F.trim(right), ACCENT_FREE)


def name_order(col: Column | str) -> Column:
    """Sort key that ignores case and accents."""
    return F.collate(col if isinstance(col, Column) else F.col(col), ACCENT_FREE)


COMBINING_MARKS = re.compile("[\u0300-\u036f]+")


@F.pandas_udf(T.StringType())
def name_key(names: pd.Series) -> pd.Series:
    """Stored form of `same_name`: combining marks removed, trimmed, lower case."""

    def key(name):
        if name is None:
            return None
        if not name.isascii():
            name = COMBINING_MARKS.sub("", unicodedata.normalize("NFD", name))
        return name.strip().lower()

    return names.map(key)


def alias_lookup(col: Column | str, mapping: Mapping[str, str]) -> Column:
    """Mapped name where there is one, else the name itself."""
    col = F.col(col) if isinstance(col, str) else col
    if not mapping:
        return col
    entries = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, col), col)
