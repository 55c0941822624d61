"""Facilities to reference districts: an ordered cascade that never guesses."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundcover import config
from groundcover.operators.geo import nearest_within, points_in_polygons
from groundcover.operators.match import fuzzy_resolve, polygon_names
from groundcover.plans.skew import skew_safe_join
from groundcover.plans.topk import top_k
from groundcover.session import materialize

UNMATCHED = "unmatched"


def district_aliases(indicators: DataFrame, codes: DataFrame, method: str = "ratio") -> DataFrame:
    """Indicator district names matched to postal district names, state by state."""
    return fuzzy_resolve(
        indicators.select(F.col("state_norm").alias("block"), F.col("district_norm").alias("name")),
        codes.select(F.col("state_norm").alias("block"), F.col("district_norm").alias("candidate")),
        config.DISTRICT_ALIASES,
        config.DISTRICT_BLOCKLIST,
        method=method,
    ).select(
        F.col("block").alias("state_norm"),
        F.col("name").alias("nfhs_district_norm"),
        F.col("matched").alias("pin_district_norm"),
        "match_type",
    )


def resolved_codes(codes: DataFrame, aliases: DataFrame, indicators: DataFrame) -> DataFrame:
    """Each postal code with its reference district, its state and the match type.

    The two name joins run on the small directory, so facilities later need only one
    join. Where a postal district belongs to several reference districts, a known alias
    beats an exact name beats a similar one, then the smallest name wins.
    """
    reference = indicators.select(
        "state_norm",
        F.col("district_norm").alias("nfhs_district_norm"),
        F.col("district_name").alias("nfhs_district_name"),
        F.col("state_ut").alias("nfhs_state_ut"),
    )
    named = (
        codes.withColumnRenamed("district_norm", "pin_district_norm")
        .join(aliases, ["state_norm", "pin_district_norm"], "left")
        .join(reference, ["state_norm", "nfhs_district_norm"], "left")
        .withColumnRenamed("state_norm", "pin_state_norm")
    )
    preference = (
        F.when(F.col("nfhs_district_name").isNull(), 9)
        .when(F.col("match_type") == "known_alias", 1)
        .when(F.col("match_type") == "exact", 2)
        .otherwise(3)
    )
    best = top_k(
        named,
        ["pincode"],
        [preference, F.col("nfhs_district_norm"), F.col("nfhs_district_name"), F.col("nfhs_state_ut")],
    ).drop("nfhs_district_norm")
    return materialize(best, "codes")  # every stage of the cascade reads it


def resolve_by_code(facilities: DataFrame, codes: DataFrame) -> DataFrame:
    """Left join on the postal code, with the resolved flag and the match type."""
    joined = skew_safe_join(facilities, codes.withColumnRenamed("pincode", "zip_clean"), ["zip_clean"])
    return joined.withColumns(
        {
            "district_resolved": F.col("nfhs_district_name").isNotNull(),
            "district_match_type": F.coalesce("match_type", F.lit(UNMATCHED)),
        }
    ).drop("match_type")


Stage = Callable[[DataFrame], DataFrame]


def resolve(facilities: DataFrame, stages: Sequence[Stage], key: str = "unique_id") -> DataFrame:
    """Runs each stage on the rows still unresolved that have valid coordinates.

    A stage maps (key, latitude, longitude) to at most one row per key with
    `found_district`, `found_state` and `found_type`. Earlier results always win and the
    number of rows never changes. Name and state are filled together. Between stages only
    the narrow open and found rows are written; the facilities are joined once at the end.
    """
    waiting = materialize(
        facilities.where(~F.col("district_resolved") & F.col("coordinates_valid")).select(
            key, "latitude", "longitude"
        ),
        "waiting",
    )
    answers = []
    for stage in stages:
        found = stage(waiting).where(F.col("found_district").isNotNull())
        answers.append(materialize(found, "found"))
        waiting = waiting.join(answers[-1].select(key), key, "left_anti")
    found = reduce(DataFrame.unionByName, answers)
    hit = F.col("found_district").isNotNull()
    return (
        facilities.join(found, key, "left")
        .withColumns(
            {
                "nfhs_district_name": F.coalesce("nfhs_district_name", "found_district"),
                "nfhs_state_ut": F.when(hit, F.col("found_state")).otherwise(F.col("nfhs_state_ut")),
                "district_match_type": F.coalesce("found_type", "district_match_type"),
                "district_resolved": F.col("district_resolved") | hit,
            }
        )
        .drop("found_district", "found_state", "found_type")
    )


def nearest_stage(codes: DataFrame, km: float = config.NEAREST_KM) -> Stage:
    """Only the single nearest centroid is asked, even if it leads to no district."""

    def stage(waiting: DataFrame) -> DataFrame:
        near = nearest_within(waiting, codes, km)
        return near.join(
            codes.select("pincode", "nfhs_district_name", "nfhs_state_ut"), "pincode"
        ).select(
            "unique_id",
            F.col("nfhs_district_name").alias("found_district"),
            F.col("nfhs_state_ut").alias("found_state"),
            F.lit("spatial_fallback").alias("found_type"),
        )

    return stage


def polygon_stage(edges: DataFrame, regions: DataFrame, indicators: DataFrame, method: str = "ratio") -> Stage:
    """Containing polygon, its name reconciled with the reference districts once.

    `regions` has one row per polygon region: region_id, district_norm, state_norm.
    """
    reference = indicators.select(
        F.col("state_norm").alias("block"),
        F.col("district_norm").alias("candidate"),
        "district_name",
        "state_ut",
    )
    names = polygon_names(
        regions.select(F.col("state_norm").alias("block"), F.col("district_norm").alias("name")),
        reference,
        method=method,
    )
    named = names.join(
        reference.withColumnRenamed("candidate", "matched"), ["block", "matched"]
    )
    named = top_k(named, ["block", "name"], [F.col("district_name"), F.col("state_ut")])
    lookup = regions.select(
        "region_id", F.col("state_norm").alias("block"), F.col("district_norm").alias("name")
    ).join(named, ["block", "name"])
    lookup = materialize(lookup, "regions")

    def stage(waiting: DataFrame) -> DataFrame:
        inside = points_in_polygons(waiting, edges)
        return inside.join(lookup, "region_id").select(
            "unique_id",
            F.col("district_name").alias("found_district"),
            F.col("state_ut").alias("found_state"),
            F.col("match_type").alias("found_type"),
        )

    return stage


def rate_by(df: DataFrame, group: str, flag: str) -> DataFrame:
    """Rows, resolved rows and rate per group, largest group first."""
    resolved = F.coalesce(F.sum(F.col(flag).cast("int")), F.lit(0))
    return (
        df.groupBy(group)
        .agg(F.count(F.lit(1)).alias("total"), resolved.alias("resolved"))
        .withColumn("resolution_rate", F.round(F.col("resolved") / F.col("total"), 2))
        .orderBy(F.desc("total"), F.asc(group))
    )


def funnel(df: DataFrame) -> DataFrame:
    """All stage counters in one pass over the data."""
    no_match = F.col("pin_district_norm").isNull()
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("coordinates_valid")).alias("invalid_coordinates"),
        F.count_if(F.col("district_resolved")).alias("resolved"),
        F.count_if(no_match).alias("no_code_match"),
        F.count_if(no_match & F.col("zip_clean").isNull()).alias("no_code"),
        F.count_if(no_match & F.col("zip_clean").isNotNull()).alias("code_not_in_directory"),
    )
