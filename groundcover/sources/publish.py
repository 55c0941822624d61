"""Writing tables: overwrite by a swap, safe self-overwrite, gated publish."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from groundcover import config
from groundcover.operators import gates as checks
from groundcover.operators.coverage import distribution
from groundcover.session import remove

Gate = Callable[[DataFrame], DataFrame]


def _swap(spark: SparkSession, fresh: str, path: str) -> None:
    """Puts the finished table at `fresh` in the place of the one at `path`.

    Two renames: a reader finds the old table, for a moment none, then the new one, never a half-written one.
    The old files go last, so a failure before that leaves one of the two tables whole.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, source = hadoop.Path(path), hadoop.Path(fresh)
    old = hadoop.Path(f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    had_table = files.exists(target)
    if had_table and not files.rename(target, old):
        raise OSError(f"cannot move {path}")
    if not files.rename(source, target):
        if had_table:
            files.rename(old, target)
        raise OSError(f"cannot move {fresh} to {path}")
    if had_table:
        files.delete(old, True)


def _beside(path: str) -> str:
    return f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"


def publish(df: DataFrame, path: str) -> DataFrame:
    """Overwrites the table at `path`; columns and types may change.

    The rows may come from `path` itself: they are written beside it, and the new table takes the place of
    the old one when it is complete. If writing fails, the old table stays and the part beside it is removed.
    """
    fresh = _beside(path)
    try:
        df.write.parquet(fresh)
    except Exception:
        remove(df.sparkSession, fresh)
        raise
    _swap(df.sparkSession, fresh, path)
    return df.sparkSession.read.parquet(path)


def publish_table(df: DataFrame, table: str) -> None:
    """Same for a catalog table."""
    df.write.mode("overwrite").option("overwriteSchema", "true").saveAsTable(table)


def publish_audited(df: DataFrame, path: str, gates: Sequence[Gate], status: str = "coverage_status") -> DataFrame:
    """Preview, gates, swap, read back, compare.

    The preview is written once beside the target and becomes the table; a failed gate removes it and
    the target stays untouched. The read table must have the preview's rows per status.
    """
    spark, fresh = df.sparkSession, _beside(path)
    try:
        df.write.parquet(fresh)
        preview = spark.read.parquet(fresh)
        checks.enforce(*[gate(preview) for gate in gates])
        before = sorted(map(tuple, distribution(preview, status).collect()), key=repr)
    except Exception:
        remove(spark, fresh)
        raise
    _swap(spark, fresh, path)
    written = spark.read.parquet(path)
    if sorted(map(tuple, distribution(written, status).collect()), key=repr) != before:
        raise checks.GateError("written table differs from its preview")
    return written


def coverage_gates(regions: int, capabilities: Sequence[str] = tuple(config.CAPABILITY_QUERIES)) -> list[Gate]:
    """What must hold before coverage is published: one row per region and capability, exactly these
    capabilities, no status on nearly all rows, known statuses and percentages."""

    def whole(df: DataFrame) -> DataFrame:
        expected = df.sparkSession.range(1).selectExpr(f"{regions * len(capabilities)}L AS n")
        return checks.row_count(df, expected)

    return [
        whole,
        lambda df: checks.same_values(df, "capability_queried", list(capabilities)),
        checks.not_skewed,
        lambda df: checks.domain(df, {"coverage_status": config.COVERAGE_STATUSES}, {"avg_trust_score_pct": (0, 100)}),
    ]


def publish_evidence(df: DataFrame, path: str) -> DataFrame:
    """Capability evidence, published only if its bands tell something."""
    return publish_audited(df, path, [checks.not_degenerate], "evidence_status")


__all__ = ["coverage_gates", "publish", "publish_audited", "publish_evidence", "publish_table"]
