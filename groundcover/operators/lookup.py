"""Directory clean-up: hygiene filter, most frequent value per key, centroid per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundcover.functions.names import norm_name
from groundcover.plans.topk import top_k


def drop_garbage(
    df: DataFrame, required: Sequence[str], markers: dict[str, Sequence[str]] | None = None
) -> DataFrame:
    """Rows whose `required` columns are present and hold none of the bad `markers`."""
    keep = F.lit(True)
    for name in required:
        keep = keep & F.col(name).isNotNull()
    for name, bad in (markers or {}).items():
        keep = keep & ~F.upper(F.trim(F.col(name))).isin([b.upper() for b in bad])
    return df.where(keep)


def mode_per_key(
    df: DataFrame, key: str, values: Sequence[str], tie_break: Sequence[Column] | None = None
) -> DataFrame:
    """Most frequent combination of `values` per key; ties go to the smallest values.

    Rows are counted per (key, values) before anything is ranked, and Spark drops
    losing counts in the map tasks.
    """
    counts = df.groupBy(key, *values).agg(F.count(F.lit(1)).alias("_rows"))
    order = [F.col("_rows").desc(), *(tie_break or [F.col(v).asc() for v in values])]
    return top_k(counts, [key], order).drop("_rows")


def centroid_per_key(df: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    """Mean coordinates per key; unreadable coordinates are ignored."""
    return df.groupBy(key).agg(
        F.avg(F.col(lat).try_cast("double")).alias("centroid_lat"),
        F.avg(F.col(lon).try_cast("double")).alias("centroid_lon"),
    )


def code_lookup(
    directory: DataFrame,
    key: str = "pincode",
    district: str = "district",
    state: str = "statename",
    lat: str = "latitude",
    lon: str = "longitude",
) -> DataFrame:
    """One row per postal code: its usual district and state, their keys, a centroid."""
    valid = drop_garbage(directory, [district, state], {state: ["NA"]})
    usual = mode_per_key(valid, key, [district, state])
    centroids = centroid_per_key(directory, key, lat, lon)
    return usual.select(
        key,
        district,
        state,
        norm_name(district).alias("district_norm"),
        norm_name(state).alias("state_norm"),
    ).join(
        centroids.withColumnsRenamed(
            {"centroid_lat": "pin_centroid_lat", "centroid_lon": "pin_centroid_lon"}
        ),
        key,
        "left",
    )
