"""District × capability coverage, its listings and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundcover.functions.names import name_order, same_name
from groundcover.plans.topk import top_k

REGION = ["region_name", "state"]


def resolved_facilities(facilities: DataFrame) -> DataFrame:
    """Resolved rows with complete keys, trimmed."""
    name, state = F.trim("nfhs_district_name"), F.trim("nfhs_state_ut")
    return facilities.where(F.col("district_resolved") & (name != "") & (state != "")).select(
        "unique_id", name.alias("region_name"), state.alias("state")
    )


def coverage_spine(regions: DataFrame, evidence: DataFrame, capabilities: Sequence[str] | None = None) -> DataFrame:
    """Every region with every capability.

    The capabilities form one short array that each region row unfolds, which keeps
    the spine a narrow step over the regions.
    """
    if capabilities is not None:
        array = F.array(*[F.lit(c) for c in capabilities])
    else:
        array = evidence.select("capability").distinct().agg(F.collect_list("capability")).scalar()
    return regions.withColumn("capability", F.explode(array))


def region_coverage(
    facilities: DataFrame,
    evidence: DataFrame,
    spine: DataFrame | None = None,
    capabilities: Sequence[str] | None = None,
) -> DataFrame:
    """One row per region and capability with status, facility count and mean trust.

    Evidence is first summed per facility and capability, so a facility with very many
    rows is small before the join; sums and counts keep the mean over evidence rows
    exact. `spine` (region_name, state) replaces the regions found in the facilities
    and makes regions without facilities visible as no_data.
    """
    resolved = resolved_facilities(facilities)
    per_facility = evidence.groupBy("unique_id", "capability").agg(
        F.max(F.col("evidence_status").isin("verified", "likely").cast("int")).alias("strong"),
        F.max((F.col("evidence_status") == "weak_signal").cast("int")).alias("weak"),
        F.sum("trust_score_pct").alias("pct_sum"),
        F.count("trust_score_pct").alias("pct_rows"),
    )
    summary = (
        resolved.join(per_facility, "unique_id")
        .groupBy(*REGION, "capability")
        .agg(
            F.max("strong").alias("strong"),
            F.max("weak").alias("weak"),
            (F.sum("pct_sum") / F.sum("pct_rows")).alias("avg_pct"),
        )
    )
    counts = resolved.groupBy(*REGION).agg(F.countDistinct("unique_id").alias("facility_count"))
    regions = counts if spine is None else (
        spine.select(*REGION).distinct().join(counts, REGION, "left")
    )
    facility_count = F.coalesce("facility_count", F.lit(0))
    return (
        coverage_spine(regions, evidence, capabilities)
        .join(summary, [*REGION, "capability"], "left")
        .select(
            F.concat("region_name", F.lit("_"), "state").alias("region_id"),
            *REGION,
            F.lit("district").alias("level"),
            F.col("capability").alias("capability_queried"),
            F.when(facility_count == 0, "no_data")
            .when(F.col("strong") == 1, "verified_coverage")
            .when(F.col("weak") == 1, "weak_coverage")
            .otherwise("no_facility")
            .alias("coverage_status"),
            facility_count.cast("int").alias("facility_count"),
            F.round(F.coalesce("avg_pct", F.lit(0.0))).cast("int").alias("avg_trust_score_pct"),
        )
    )


def filter_ci(df: DataFrame, **criteria: str | None) -> DataFrame:
    """Case- and blank-insensitive equality per given column; missing criteria add nothing."""
    for column, wanted in criteria.items():
        if wanted:
            df = df.where(F.lower(F.trim(F.col(column))) == F.lower(F.trim(F.lit(wanted))))
    return df


def list_coverage(
    coverage: DataFrame, capability: str, state: str | None = None, district: str | None = None
) -> DataFrame:
    found = filter_ci(coverage, capability_queried=capability, state=state, region_name=district)
    return found.select(
        "region_id",
        F.trim("region_name").alias("region_name"),
        F.trim("state").alias("state"),
        F.lit("district").alias("level"),
        "capability_queried",
        "coverage_status",
        "facility_count",
        F.round(F.coalesce(F.col("avg_trust_score_pct"), F.lit(0))).cast("int").alias("avg_trust_score_pct"),
    ).orderBy("state", "region_name")


def pick_list(coverage: DataFrame, column: str, state: str | None = None) -> DataFrame:
    """Distinct trimmed values in accent-free order, optionally of one state."""
    if state is not None:
        coverage = coverage.where(same_name(F.col("state"), F.lit(state)))
    return (
        coverage.select(F.trim(column).alias(column))
        .where(F.col(column) != "")
        .distinct()
        .orderBy(name_order(column), column)
    )


def _status_count(status: str) -> Column:
    return F.count_if(F.col("coverage_status") == status)


def _mean_pct() -> Column:
    return F.coalesce(F.round(F.avg("avg_trust_score_pct")), F.lit(0)).cast("int")


def capability_summary(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy(F.col("capability_queried").alias("capability")).agg(
        F.count(F.lit(1)).alias("rows"),
        _status_count("verified_coverage").alias("verified"),
        _status_count("weak_coverage").alias("weak"),
        _status_count("no_facility").alias("gaps"),
        _status_count("no_data").alias("no_data"),
        _mean_pct().alias("avg_trust"),
    )


def coverage_kpis(coverage: DataFrame) -> DataFrame:
    verified = _status_count("verified_coverage")
    rows = F.count(F.lit(1))
    return coverage.agg(
        rows.alias("rows"),
        F.countDistinct("region_id").alias("districts"),
        verified.alias("verified"),
        F.coalesce(F.round(F.try_divide(verified, rows) * 100), F.lit(0)).cast("int").alias("verified_pct"),
        _mean_pct().alias("avg_trust"),
    )


def state_leaderboard(coverage: DataFrame, k: int) -> DataFrame:
    """Best states by share of verified rows; facilities count once per capability."""
    return (
        coverage.groupBy("state")
        .agg(
            F.count(F.lit(1)).alias("total"),
            _status_count("verified_coverage").alias("verified"),
            F.countDistinct("region_name").alias("districts"),
            F.sum("facility_count").alias("facility_capability_rows"),
        )
        .withColumn("pct", F.round(F.col("verified") / F.col("total") * 100).cast("int"))
        .orderBy(F.desc("pct"), F.asc("state"))
        .limit(k)
    )


def region_stats(claims: DataFrame, coverage: DataFrame) -> DataFrame:
    """Inspector numbers: listed facilities and their claims, and the status mix.

    `claims` has one row per listed facility with `status` and `trust_score_pct` of its
    chosen claim (NULL without a claim).
    """
    listed = claims.agg(
        F.count(F.lit(1)).alias("facilities"),
        F.count_if(F.col("status") == "verified").alias("verified"),
        F.coalesce(F.round(F.avg("trust_score_pct")), F.lit(0)).cast("int").alias("avg_trust"),
    )
    mix = coverage.agg(
        F.count(F.lit(1)).alias("regions"),
        *[
            _status_count(s).alias(s)
            for s in ("verified_coverage", "weak_coverage", "no_facility", "no_data")
        ],
    )
    both = listed.withColumn("_mix", mix.select(F.struct("*")).scalar()).select(
        *listed.columns, "_mix.*"
    )
    shares = [
        F.round(F.col(s) / F.greatest(F.col("regions"), F.lit(1)) * 100, 2).alias(f"{s}_pct")
        for s in ("verified_coverage", "weak_coverage", "no_facility", "no_data")
    ]
    return both.select("*", F.greatest("regions", F.lit(1)).alias("total_regions"), *shares)


def enrich_boundaries(regions: DataFrame, coverage: DataFrame, keys: Sequence[str] = ("state", "region_name")) -> DataFrame:
    """Coverage attached to boundary rows; one coverage row per key, the last by state and name.

    With `keys=("region_name",)` same-named regions of two states share the last one.
    """
    last = top_k(
        coverage,
        list(keys),
        [F.col("state").desc(), F.col("region_name").desc(), F.col("capability_queried").desc()],
    )
    drop = [c for c in ("state", "region_name") if c in regions.columns and c not in keys]
    return regions.join(last.drop(*drop), list(keys), "left")


def distribution(df: DataFrame, col: str) -> DataFrame:
    """Rows and share of all rows per value, NULL being a value of its own."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("total"))
    return counts.withColumn(
        "pct", F.round(F.col("rows") / total.scalar() * 100, 2)
    ).orderBy(col)


def count_by(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("rows"))


def status_pivot(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Rows per (row, value) side by side with the row's percentages, missing as 0."""
    counts = df.groupBy(row).agg(
        *[F.count_if(F.col(col) == v).alias(v) for v in values],
    )
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return counts.select(
        row,
        *values,
        *[F.round(F.try_divide(F.col(v), total) * 100, 2).alias(f"{v}_pct") for v in values],
    )
