"""Records, listings and selections behind the planner's screens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundcover import config
from groundcover.functions.casting import as_bool, as_int, clean_text, first_nonempty
from groundcover.functions.names import same_name
from groundcover.operators.coverage import filter_ci
from groundcover.operators.rules import run_rules
from groundcover.plans.prefix import exact_quantiles, positions
from groundcover.plans.skew import skew_safe_join
from groundcover.plans.topk import top_k

EVIDENCE_FIELDS = [
    "unique_id", "capability", "evidence_status", "trust_score", "trust_score_pct",
    "field_source", "text_span", "confirm_message",
]


def evidence_struct() -> Column:
    fields = [
        clean_text(c).alias(c) if c in ("field_source", "text_span") else F.col(c)
        for c in EVIDENCE_FIELDS
    ]
    return F.struct(*fields)


def facility_record(facilities: DataFrame, evidence: Column | str | None = None) -> DataFrame:
    """Nested record per facility row.

    Coordinates show only if valid, counts only if reported; `evidence` is an
    array-of-struct column of the input.
    """
    valid = as_bool("coordinates_valid")
    capacity, doctors = as_bool("capacity_reported"), as_bool("doctors_reported")
    claims = F.array() if evidence is None else (F.col(evidence) if isinstance(evidence, str) else evidence)
    return facilities.select(
        F.col("unique_id").alias("facility_id"),
        "unique_id",
        F.coalesce(first_nonempty("name"), F.lit("Unnamed facility")).alias("name"),
        F.struct(
            clean_text("nfhs_state_ut").alias("state"),
            clean_text("nfhs_district_name").alias("district"),
            F.lit(None).cast("string").alias("city"),
            clean_text("zip_clean").alias("pin"),
            F.when(valid, F.col("latitude").cast("double")).alias("lat"),
            F.when(valid, F.col("longitude").cast("double")).alias("lon"),
            (~as_bool("district_resolved")).alias("unresolved"),
        ).alias("location"),
        claims.alias("capability_evidence"),
        F.struct(
            F.col("description"),
            F.col("procedure"),
            F.col("equipment"),
            F.when(doctors, as_int("numberDoctors_clean")).alias("numberDoctors"),
            F.when(capacity, as_int("capacity_clean")).alias("capacity"),
            clean_text(first_nonempty("yearEstablished_clean")).alias("yearEstablished"),
        ).alias("raw_fields"),
        F.struct(
            capacity.alias("capacity_reported"), doctors.alias("doctors_reported")
        ).alias("data_completeness"),
    )


def list_facilities(
    facilities: DataFrame,
    evidence: DataFrame,
    capability: str | None = None,
    district: str | None = None,
    state: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Facility records by name. With a capability, one record per matching evidence row."""
    rows = filter_ci(facilities, nfhs_district_name=district, nfhs_state_ut=state)
    claim = None
    if capability:
        wanted = filter_ci(evidence, capability=capability).select(
            "unique_id", F.array(evidence_struct()).alias("_claim")
        )
        rows = skew_safe_join(wanted, rows, ["unique_id"], "inner")
        claim = "_claim"
    page = rows.orderBy(F.col("name"), F.col("unique_id"), *(["_claim"] if claim else []))
    page = page if limit is None else page.limit(limit)
    return facility_record(page, claim)


def eligible_for_crosscheck(df: DataFrame) -> DataFrame:
    """High-acuity capability (exact spelling) with supported evidence."""
    return df.where(
        F.col("capability").isin(*config.HIGH_ACUITY)
        & F.col("evidence_status").isin(*config.SUPPORTED_STATUSES)
    )


def facility_detail(
    facilities: DataFrame, evidence: DataFrame, unique_id: str, capability: str | None = None
) -> DataFrame:
    """One facility with all its evidence, and flags for the viewed capability.

    Both filters are on the key, so they reach the scans. The evidence table has one row
    per facility and capability. An unknown key gives no row; a capability that the
    facility does not have gives the record without flags.
    """
    one = facilities.where(F.col("unique_id") == unique_id).limit(1)
    claims = evidence.where(F.col("unique_id") == unique_id)
    listed = claims.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col("capability").alias("_by"), evidence_struct().alias("_e")))),
            lambda s: s["_e"],
        ).alias("_claims")
    )
    record = facility_record(one.withColumn("_claims", listed.scalar()), "_claims")
    viewed = claims.where(
        F.lower("capability") == F.lower(F.trim(F.lit(capability))) if capability else F.lit(False)
    )
    viewed = top_k(viewed, ["unique_id"], [F.col("capability")])
    flagged = run_rules(viewed.join(one, "unique_id"), nulls="as_false").select(
        "unique_id",
        F.col("capability").alias("viewed_capability"),
        "validator_flags",
        (
            F.col("capability").isin(*config.HIGH_ACUITY)
            & F.col("evidence_status").isin(*config.SUPPORTED_STATUSES)
        ).alias("crosscheck_eligible"),
    )
    joined = record.join(flagged, "unique_id", "left")
    return joined.withColumn(
        "crosscheck_eligible", F.coalesce("crosscheck_eligible", F.lit(False))
    )


def normalize_claim(df: DataFrame) -> DataFrame:
    """Claim columns in the planner's vocabulary.

    Input: name, status, trust_score_pct, trust_score, confidence_level, field_source,
    text_span, confirm_message. Status synonyms fold into four values; the percentage
    falls back to trust_score * 100 and is held to 0..100. Nameless claims are dropped.
    """
    raw = F.regexp_replace(F.lower("status"), "-", "_")
    status = (
        F.when(raw.isin("verified", "likely"), raw)
        .when(raw.isin("weak_signal", "claimed_only"), "weak_signal")
        .otherwise("no_signal")
    )
    pct = F.floor(
        F.coalesce(
            F.col("trust_score_pct").try_cast("double"),
            F.coalesce(F.col("trust_score").try_cast("double"), F.lit(0.0)) * 100,
        )
        + 0.5
    )
    pct = F.greatest(F.lit(0), F.least(F.lit(100), pct)).cast("int")
    level = F.when(status == "verified", "high").when(status == "likely", "medium").otherwise("low")
    kind = (
        F.when(status == "verified", "corroborating")
        .when(status == "no_signal", "absence")
        .otherwise("claim")
    )
    has_evidence = first_nonempty("field_source", "text_span").isNotNull()
    rest = [c for c in df.columns if c not in (
        "name", "status", "trust_score_pct", "trust_score", "confidence_level", "confirm_message")]
    return df.where(first_nonempty("name").isNotNull()).select(
        *rest,
        "name",
        status.alias("status"),
        (pct / 100).alias("trust_score"),
        pct.alias("trust_score_pct"),
        F.coalesce(first_nonempty("confidence_level"), level).alias("confidence_level"),
        F.when(has_evidence, kind).alias("evidence_type"),
        F.coalesce("confirm_message", F.lit("")).alias("confirm_message"),
    )


def merge_facility_rows(
    rows: DataFrame,
    order: str,
    attributes: Sequence[str],
    claim: Sequence[str],
    key: str = "unique_id",
    name: str = "name",
) -> DataFrame:
    """One row per facility: attributes of its first row, its claims as an array.

    A later claim with the same name replaces the earlier one but keeps its place. Rows
    are reduced to one per facility and claim name in the map tasks, so an array never
    grows with the number of rows. Facilities without claims are dropped. `order` must be
    unique within a facility.
    """
    per_name = rows.groupBy(key, name).agg(
        F.min(order).alias("_place"),
        F.max_by(F.struct(*claim), order).alias("_claim"),
        F.min_by(F.struct(*attributes), order).alias("_attributes"),
    )
    named = first_nonempty(name).isNotNull()
    placed = F.when(named, F.struct("_place", "_claim"))
    merged = per_name.groupBy(key).agg(
        F.min_by("_attributes", "_place").alias("_attributes"),
        F.array_sort(F.collect_list(placed)).alias("_claims"),
    )
    return merged.where(F.size("_claims") > 0).select(
        key, "_attributes.*", F.transform("_claims", lambda c: c["_claim"]).alias("claims")
    )


def claim_for(claims: Column, capability: str) -> Column:
    """The claim with this name, else the first claim."""
    named = F.filter(claims, lambda c: c["name"] == capability)
    return F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(claims, F.lit(1)))


def score_tone(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.when(col >= 80, "score-high").when(col >= 60, "score-mid").otherwise("score-low")


def with_claim(merged: DataFrame, capability: str) -> DataFrame:
    """Adds the chosen claim's `status` and `trust_score_pct` (a missing score counts 0)."""
    chosen = claim_for(F.col("claims"), capability)
    return merged.withColumns(
        {
            "status": chosen["status"],
            "trust_score_pct": F.coalesce(chosen["trust_score_pct"], F.lit(0)),
        }
    )


def _in_region(merged: DataFrame, region: str, capability: str, status: str) -> DataFrame:
    rows = with_claim(merged.where(same_name(F.col("district"), F.lit(region))), capability)
    return rows if status == "all" else rows.where(F.col("status") == status)


def region_facilities(
    merged: DataFrame, region: str, capability: str, status: str = "all", best_first: bool = True
) -> DataFrame:
    """Facilities of a region (accent-free name match), by the score of the chosen claim."""
    rows, score = _in_region(merged, region, capability, status), F.col("trust_score_pct")
    return rows.orderBy(score.desc() if best_first else score.asc(), "unique_id")


def placed_facilities(
    merged: DataFrame, region: str, capability: str, status: str = "all", best_first: bool = True
) -> DataFrame:
    """`region_facilities` with each one's `position` in the list, for pages and for comparing orders."""
    rows, score = _in_region(merged, region, capability, status), F.col("trust_score_pct").cast("long")
    keyed = rows.withColumn("_by", -score if best_first else score)
    return positions(keyed, ["_by", "unique_id"]).drop("_by")


def preview_markers(
    merged: DataFrame, capability: str, k: int, matched: Sequence[str] = ()
) -> DataFrame:
    """Facilities to draw: the matched ones, else the best `k` with finite coordinates."""
    rows = with_claim(merged, capability)
    if matched:
        return rows.where(F.col("unique_id").isin(*matched))
    finite = F.lit(True)
    for axis in ("latitude", "longitude"):
        finite = finite & F.col(axis).isNotNull() & ~F.isnan(axis) & (F.abs(axis) != float("inf"))
    return rows.where(finite).orderBy(F.desc("trust_score_pct"), F.asc("unique_id")).limit(k)


def shortlist_lookup(shortlists: DataFrame, facilities: DataFrame) -> DataFrame:
    """Facilities of shortlist rows (…, pos, unique_id) in shortlist order; unknown ids drop."""
    found = skew_safe_join(shortlists, facilities, ["unique_id"], "inner")
    keys = [c for c in shortlists.columns if c not in ("pos", "unique_id")]
    return found.orderBy(*keys, "pos")


def top_per_status(
    df: DataFrame, status: str, order: Sequence[Column], n: int, statuses: Sequence[str] = ("verified", "likely", "weak_signal")
) -> DataFrame:
    """Best `n` rows of each status."""
    return top_k(df.where(F.col(status).isin(*statuses)), [status], order, n, rank="rank")


def review_sample(rows: DataFrame, per_stratum: int = 2) -> DataFrame:
    """A few reviewable rows per status, high-acuity supported claims first.

    A facility appears once per status. Rows need a name and a city.
    """
    named = rows.where(
        F.col("evidence_status").isin(*config.STATUSES)
        & (F.trim("facility_name") != "")
        & (F.trim("address_city") != "")
    )
    priority = F.when(
        F.col("evidence_status").isin(*config.SUPPORTED_STATUSES)
        & F.col("capability").isin(*config.HIGH_ACUITY),
        0,
    ).otherwise(1)
    score = F.col("trust_score_pct").desc()
    once = top_k(named, ["evidence_status", "unique_id"], [priority, score, F.col("capability")])
    picked = top_k(
        once, ["evidence_status"], [priority, score, F.col("unique_id")], per_stratum, rank="status_rank"
    )
    order = F.array_position(F.array(*[F.lit(s) for s in config.STATUSES]), F.col("evidence_status"))
    return picked.orderBy(order, "status_rank")


def describe_by(
    df: DataFrame, group: str | None, col: str, quantiles: Sequence[float] = (0.25, 0.5, 0.75)
) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quantiles and maximum per group."""
    groups = [group] if group else []
    value = F.col(col)
    basic = df.groupBy(*groups).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    cuts = exact_quantiles(df, col, quantiles, groups)
    wide = cuts.groupBy(*groups).agg(
        *[
            F.max(F.when(F.col("q") == float(q), F.col("quantile"))).alias(f"p{round(q * 100):02d}")
            for q in quantiles
        ]
    )
    if not group:
        return basic.withColumn("_cuts", wide.select(F.struct("*")).scalar()).select(
            *basic.columns, "_cuts.*"
        )
    wide = wide.withColumnRenamed(group, "_group")
    return basic.join(wide, basic[group].eqNullSafe(wide["_group"]), "left").drop("_group")
