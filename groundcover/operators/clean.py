"""Raw directory and indicator rows to typed, flagged rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundcover import config
from groundcover.functions import casting, lists, names, text


def with_coordinates_valid(
    df: DataFrame,
    lat: str = "latitude",
    lon: str = "longitude",
    lat_range: tuple[float, float] = config.LATITUDE_RANGE,
    lon_range: tuple[float, float] = config.LONGITUDE_RANGE,
) -> DataFrame:
    return df.withColumn("coordinates_valid", casting.within_box(lat, lon, lat_range, lon_range))


def clean_facilities(raw: DataFrame, null_presence: str = "zero") -> DataFrame:
    """All row-level cleaning of the facility directory in one narrow stage."""
    df = lists.parse_list_columns(raw, config.LIST_COLUMNS)
    df = casting.with_reported(
        df,
        [
            ("numberDoctors", "numberDoctors_clean", "doctors_reported"),
            ("capacity", "capacity_clean", "capacity_reported"),
        ],
        "int",
    ).withColumn("yearEstablished_clean", casting.safe_cast("yearEstablished", "int"))
    df = casting.bool_columns(df, config.BOOLEAN_COLUMNS)
    df = casting.numeric_columns(df, config.SIGNAL_COLUMNS)
    df = with_coordinates_valid(df)
    df = lists.source_counts(df, "source_types", "source_urls")
    return df.withColumns(
        {
            "richness_prior": lists.richness_prior(
                F.col("source_type_count"),
                F.col("source_url_count"),
                F.col("affiliated_staff_presence"),
                F.col("custom_logo_presence"),
                null_presence,
            ),
            "zip_clean": text.extract_code("address_zipOrPostcode"),
        }
    )


def clean_indicators(raw: DataFrame, state_aliases: dict[str, str] = config.STATE_ALIASES) -> DataFrame:
    """Indicator rows with numeric percentages, low-confidence flags and name keys."""
    df = casting.clean_suppressed(raw, "_pct", config.SUPPRESSED_MARKERS)
    df = df.withColumns(
        {
            "district_norm": names.norm_name("district_name"),
            "state_norm_raw": names.norm_name("state_ut"),
        }
    )
    return df.withColumn("state_norm", names.alias_lookup("state_norm_raw", state_aliases))


def invalid_coordinates(df: DataFrame) -> DataFrame:
    """Rows known to lie outside the box; unknown coordinates are not listed."""
    return df.where(~F.col("coordinates_valid"))
