"""Checks that must hold before a table is published.

Every gate is a DataFrame (gate, ok, detail); `enforce` runs them and stops on failure.
Gates are small aggregates: nothing of row size reaches the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundcover import config


class GateError(RuntimeError):
    """A publish gate failed; nothing was written."""


def enforce(*gates: DataFrame) -> None:
    rows = reduce(DataFrame.unionByName, gates).where(~F.col("ok")).collect()
    if rows:
        raise GateError("; ".join(f"{r['gate']}: {r['detail']}" for r in rows))


def _gate(name: str, ok: Column, detail: Column) -> list[Column]:
    return [
        F.lit(name).alias("gate"),
        F.coalesce(ok, F.lit(False)).alias("ok"),
        F.coalesce(detail.cast("string"), F.lit("")).alias("detail"),
    ]


def not_degenerate(
    df: DataFrame,
    statuses: Sequence[str] = config.STATUSES,
    max_share: float = 0.95,
    group: str = "capability",
    status: str = "evidence_status",
) -> DataFrame:
    """Every status occurs overall and in every group, and none reaches `max_share`."""
    counts = df.groupBy(group, status).agg(F.count(F.lit(1)).alias("n"))
    absent = [F.when(F.max(F.col(status) == s), 0).otherwise(1) for s in statuses]
    missing = sum(absent[1:], absent[0]).alias("missing")
    by_group = counts.groupBy(group).agg(missing)
    by_status = counts.groupBy(status).agg(F.sum("n").alias("n"))
    missing_groups = by_group.agg(F.count_if(F.col("missing") > 0).alias("bad")).select(
        *_gate("every_status_per_group", F.col("bad") == 0, F.col("bad"))
    )
    overall = by_status.agg(missing, (F.max("n") / F.sum("n")).alias("share"))
    return (
        overall.select(*_gate("every_status", F.col("missing") == 0, F.col("missing")))
        .unionByName(
            overall.select(
                *_gate("largest_status_share", F.col("share") < max_share, F.round("share", 4))
            )
        )
        .unionByName(missing_groups)
    )


def not_skewed(df: DataFrame, status: str = "coverage_status", max_share: float = 0.85) -> DataFrame:
    """No status holds more than `max_share` of the rows (exactly that share passes)."""
    counts = df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    share = counts.agg((F.max("n") / F.sum("n")).alias("share"))
    return share.select(*_gate("status_skew", F.col("share") <= max_share, F.round("share", 4)))


def row_count(df: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows equal the one number in `expected` and are not zero."""
    counted = df.agg(F.count(F.lit(1)).alias("n")).withColumn("expected", expected.scalar())
    return counted.select(
        *_gate("row_count", F.col("n") == F.col("expected"), F.concat_ws("/", "n", "expected"))
    ).unionByName(counted.select(*_gate("not_empty", F.col("n") > 0, F.col("n"))))


def same_values(df: DataFrame, col: str, expected: Sequence[str]) -> DataFrame:
    """The distinct values of `col` are exactly `expected`."""
    found = df.select(col).distinct()
    wanted = df.sparkSession.createDataFrame([(v,) for v in expected], f"{col} string")
    difference = found.exceptAll(wanted).unionByName(wanted.exceptAll(found))
    return difference.agg(F.count(F.lit(1)).alias("n")).select(
        *_gate("same_values", F.col("n") == 0, F.col("n"))
    )


def no_orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """No key of `child` is missing in `parent`; the detail counts missing keys.

    Keys are made distinct first, so a key with very many rows costs one row.
    """
    keys = child.select(key).distinct().where(F.col(key).isNotNull())
    missing = keys.join(parent.select(key).distinct(), key, "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("n")).select(
        *_gate("no_orphans", F.col("n") == 0, F.col("n"))
    )


def rules_plausible(rates: DataFrame) -> DataFrame:
    """No rule hits no row at all or every row."""
    bad = (F.col("flagged_rows") == 0) | (F.col("flagged_rows") == F.col("total_rows"))
    return rates.agg(F.count_if(bad).alias("n")).select(
        *_gate("rules_plausible", F.col("n") == 0, F.col("n"))
    )


def incomplete_keys(df: DataFrame, flag: str, keys: Sequence[str]) -> DataFrame:
    """Number of flagged rows with a missing or blank key; reported, never guessed."""
    blank = F.lit(False)
    for key in keys:
        blank = blank | F.col(key).isNull() | (F.trim(F.col(key)) == "")
    return df.where(F.col(flag) & blank).agg(F.count(F.lit(1)).alias("incomplete_rows"))


def domain(
    df: DataFrame,
    enums: Mapping[str, Sequence[str]] | None = None,
    ranges: Mapping[str, tuple[float, float]] | None = None,
    required: Sequence[str] = (),
    flags: str | None = None,
) -> DataFrame:
    """Values outside their list or range, missing values, misshapen flags: one pass.

    `flags` names an array of {rule, reason}; both parts must be present.
    """
    checks: dict[str, Column] = {}
    for name, allowed in (enums or {}).items():
        checks[f"domain_{name}"] = F.coalesce(~F.col(name).isin(*allowed), F.lit(True))
    for name, (low, high) in (ranges or {}).items():
        checks[f"range_{name}"] = F.coalesce(~F.col(name).between(low, high), F.lit(True))
    for name in required:
        checks[f"required_{name}"] = F.col(name).isNull()
    if flags:
        checks[f"shape_{flags}"] = F.exists(
            F.col(flags), lambda f: f["rule"].isNull() | f["reason"].isNull()
        )
    counted = df.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    return counted.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("gate"),
                        (F.col(n) == 0).alias("ok"),
                        F.col(n).cast("string").alias("detail"),
                    )
                    for n in checks
                ]
            )
        ).alias("_g")
    ).select("_g.gate", "_g.ok", "_g.detail")
