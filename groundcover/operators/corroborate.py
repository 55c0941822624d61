"""Do search results come from sources the facility did not name itself?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundcover.functions.text import domain

FACILITY = ["name_key", "city_key"]


def _folded(name: str) -> Column:
    """Caseless form: upper case first, so that e.g. sharp s and `ss` meet."""
    return F.lower(F.upper(F.trim(F.coalesce(F.col(name), F.lit("")))))


def facility_key(name: str = "facility_name", city: str = "city") -> list[Column]:
    return [
        _folded(name).alias("name_key"),
        _folded(city).alias("city_key"),
    ]


def corroborate(lookups: DataFrame, results: DataFrame, known_urls: DataFrame) -> DataFrame:
    """Status, confidence adjustment and URL for every looked-up facility.

    `lookups` (facility_name, city, available, error), one row per facility;
    `results` (facility_name, city, pos, url), one row per search result;
    `known_urls` (facility_name, city, url), one row per URL of the facility itself.
    Results are cut to the first position per facility and domain before they meet the
    known domains, so a facility with very many results stays small.
    """
    found = results.select(*facility_key(), "pos", F.trim(F.coalesce("url", F.lit(""))).alias("url"))
    found = found.withColumn("domain", domain(F.col("url")))
    seen = found.groupBy(*FACILITY).agg(F.count(F.lit(1)).alias("results"))
    by_domain = found.where(F.col("domain") != "").groupBy(*FACILITY, "domain").agg(
        F.min(F.struct("pos", "url")).alias("first")
    )
    known = known_urls.select(*facility_key(), domain(F.col("url")).alias("domain")).distinct()
    fresh = (
        by_domain.join(known, [*FACILITY, "domain"], "left_anti")
        .groupBy(*FACILITY)
        .agg(F.min("first").alias("first"))
    )
    joined = (
        lookups.select(*facility_key(), *lookups.columns)
        .join(seen, FACILITY, "left")
        .join(fresh, FACILITY, "left")
    )
    status = (
        F.when(~F.col("available"), "unavailable")
        .when(F.col("error").isNotNull(), "error")
        .when(F.col("results").isNull(), "no_digital_footprint")
        .when(F.col("first").isNotNull(), "independently_corroborated")
        .otherwise("no_new_corroboration")
    )
    rows = joined.withColumn("status", status)
    return rows.select(
        *lookups.columns,
        "status",
        F.when(F.col("status") == "no_digital_footprint", -0.1)
        .when(F.col("status") == "independently_corroborated", 0.05)
        .when(F.col("status") == "no_new_corroboration", 0.0)
        .alias("confidence_adjustment"),
        F.when(F.col("status") == "independently_corroborated", F.col("first.url")).alias("corroborating_url"),
    )


def results_from_arrays(searches: DataFrame, column: str = "results") -> DataFrame:
    """Search rows with a `results` array of {url} to one row per result."""
    return searches.select("facility_name", "city", F.posexplode(column).alias("pos", "_r")).select(
        "facility_name", "city", "pos", F.col("_r.url").alias("url")
    )


def urls_from_arrays(facilities: DataFrame, column: str = "known_urls") -> DataFrame:
    return facilities.select("facility_name", "city", F.explode(column).alias("url"))
