"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACKED_KEYS = 10_000
SKETCH_SIZE = 65_536
HOT_ROWS = 500_000  # smaller keys are never worth splitting


def hot_keys(table: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(the key columns, rows): keys with more rows than a shuffle partition should hold.

    A mergeable frequent-items sketch over hashes of the keys finds candidates (at most TRACKED_KEYS
    numbers reach the driver), a second pass counts only those, within the tasks first. Meant for written
    tables, where both passes read the key columns alone. The sketch decides what is salted, never what
    is joined, so its error cannot change a result.
    """
    hashed = F.xxhash64(*[F.col(c) for c in on])
    sketch = table.agg(
        F.count(F.lit(1)).alias("rows"),
        F.call_function("approx_top_k", hashed, F.lit(TRACKED_KEYS), F.lit(SKETCH_SIZE)).alias("top"),
    ).first()
    least = max(hot_rows, sketch["rows"] / int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hashes = [item["item"] for item in sketch["top"] or [] if item["count"] >= least]
    counted = table.where(hashed.isin(hashes)).groupBy(*on).agg(F.count(F.lit(1)).alias("rows"))
    return counted.where(F.col("rows") >= least)


def row_spread(df: DataFrame, buckets: Column) -> Column:
    """A bucket per row that is the same on every re-run of a task.

    All columns are hashed together with the partition number, so that exact
    copies of one row still land in different buckets.
    """
    hashable = [f.name for f in df.schema if not _has_map(f.dataType)]
    return F.pmod(
        F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in hashable]), buckets
    ).cast("int")


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, (T.MapType, T.VariantType))


def skew_safe_join(
    fact: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "left",
    hot: Mapping[tuple, int] | None = None,
) -> DataFrame:
    """Equi-join `fact` to `dim` (`inner`, `left`, `left_semi` or `left_anti`).

    Without `hot` this is a plain join, which Spark splits at run time where a partition of
    either side is much larger than the others; no job is started to find out. Where such a
    split isn't possible (the join feeds an aggregate on its own keys), pass the keys that
    `hot_keys` found on the written fact table as {key: buckets}: their rows are dealt to so many buckets, and
    the matching dim rows are repeated once per bucket. Keys are compared as the join compares them, whatever
    the types of the two sides; a None stands for a missing key.
    """
    on = list(on)
    if not hot:
        return fact.join(dim, on, how).select(*_columns(fact, dim, on, how))

    def buckets(df: DataFrame) -> Column:
        count = F.lit(1)
        for key, n in hot.items():
            same = F.lit(True)
            for name, value in zip(on, key, strict=True):
                same = same & (F.col(name).isNull() if value is None else F.coalesce(F.col(name) == F.lit(value), F.lit(False)))
            count = F.when(same, n).otherwise(count)
        return count

    salt = F.when(buckets(fact) > 1, row_spread(fact, buckets(fact))).otherwise(F.lit(0))
    salted_fact = fact.withColumn("_salt", salt)
    salted_dim = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), buckets(dim) - 1)))
    joined = salted_fact.join(salted_dim, [*on, "_salt"], how)
    return joined.select(*_columns(fact, dim, on, how))


def bucket_counts(hot: DataFrame, on: Sequence[str], per_bucket: int) -> dict[tuple, int]:
    """The keys of `hot_keys` with a number of buckets of about `per_bucket` rows each."""
    return {tuple(r[c] for c in on): max(2, math.ceil(r["rows"] / per_bucket)) for r in hot.collect()}


def _columns(fact: DataFrame, dim: DataFrame, on: list[str], how: str) -> list[str]:
    if how in ("left_semi", "left_anti"):
        return fact.columns
    return [*fact.columns, *[c for c in dim.columns if c not in on]]
