"""Running totals over a global order without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundcover.session import materialize


def prefix_sums(
    df: DataFrame,
    order: Sequence[str],
    weight: str,
    groups: Sequence[str] = (),
    out: str = "before",
    total: str = "total",
) -> DataFrame:
    """Adds the sum of `weight` over the earlier rows of a group and over all of them.

    `(groups, order)` must identify a row. Rows are range-partitioned on groups
    and order together, so a group of any size is cut into slices; each slice is
    summed on its own and shifted by the total of the slices before it. The
    slicing is written out once because both passes must see the same slices.
    """
    groups, order = list(groups), list(order)
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = materialize(
        df.repartitionByRange(slices, *groups, *order).withColumn("_slice", F.spark_partition_id()),
        "slices",
    )
    totals = sliced.groupBy(*groups, "_slice").agg(F.sum(weight).alias("_slice_sum"))
    earlier_slices = (
        Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    all_slices = Window.partitionBy(*groups)
    offsets = totals.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.col("_slice").alias("_offset_slice"),
        F.coalesce(F.sum("_slice_sum").over(earlier_slices), F.lit(0)).alias("_offset"),
        F.sum("_slice_sum").over(all_slices).alias("_total"),
    )
    earlier_rows = (
        Window.partitionBy(*groups, "_slice")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    within = sliced.withColumn("_within", F.coalesce(F.sum(weight).over(earlier_rows), F.lit(0)))
    same = F.col("_slice") == F.col("_offset_slice")
    for i, group in enumerate(groups):
        same = same & F.col(group).eqNullSafe(F.col(f"_g{i}"))
    if not groups:
        offsets = F.broadcast(offsets)  # one row per slice
    return within.join(offsets, same, "inner").select(
        *df.columns,
        (F.col("_within") + F.col("_offset")).alias(out),
        F.col("_total").alias(total),
    )


def positions(df: DataFrame, order: Sequence[str], groups: Sequence[str] = (), out: str = "position") -> DataFrame:
    """Adds each row's place (1, 2, 3, ...) in its group by `order`, whatever the size of the group.

    `(groups, order)` must identify a row.
    """
    weight, total = f"_{out}_weight", f"_{out}_total"
    placed = prefix_sums(df.withColumn(weight, F.lit(1)), order, weight, groups, out, total)
    return placed.withColumn(out, F.col(out).cast("long") + 1).drop(weight, total)


def ordered_counts(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """One row per (groups, value): `ties` rows have it, `before` of `total` are smaller."""
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, value)
        .agg(F.count(F.lit(1)).alias("ties"))
    )
    return prefix_sums(counts, [value], "ties", groups)


def exact_quantiles(
    df: DataFrame,
    value: str,
    quantiles: Sequence[float],
    groups: Sequence[str] = (),
    counts: DataFrame | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles: (groups, q, quantile), exact at any size.

    `counts` are the `ordered_counts` of the same data, if the caller has them already.
    """
    ranked = ordered_counts(df, value, groups) if counts is None else counts

    def at(q):
        return q * (F.col("total") - 1)

    def covers(position):
        return (F.col("before") <= position) & (position < F.col("before") + F.col("ties"))

    wanted = F.array(*[F.lit(float(q)) for q in quantiles])
    picked = ranked.withColumn(
        "q",
        F.explode(
            F.filter(wanted, lambda q: covers(F.floor(at(q))) | covers(F.floor(at(q)) + 1))
        ),
    )
    position = F.floor(at(F.col("q")))
    low = F.max(F.when(covers(position), F.col(value)))
    high = F.coalesce(F.max(F.when(covers(position + 1), F.col(value))), low)
    share = F.max(at(F.col("q")) - position)
    return picked.groupBy(*groups, "q").agg(
        (low + (high - low) * share).cast("double").alias("quantile")
    )
