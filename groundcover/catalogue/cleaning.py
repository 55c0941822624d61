"""Cleaning, lookups and counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundcover import config
from groundcover.catalogue import inputs
from groundcover.catalogue.registry import derive, query, with_inputs
from groundcover.functions import casting, lists, names, text
from groundcover.operators import clean, lookup
from groundcover.plans.skew import skew_safe_join
from groundcover.sources.tables import load_table

YES_NO = (
    "CASE WHEN lower(trim({0})) IN ('true', 't', 'yes', 'y', '1') THEN TRUE "
    "WHEN lower(trim({0})) IN ('false', 'f', 'no', 'n', '0') THEN FALSE END"
)
STAFF = YES_NO.format("affiliated_staff_presence")
LOGO = YES_NO.format("custom_logo_presence")


@query(
    "safe_cast_flags",
    with_inputs(
        f"""
SELECT unique_id, TRY_CAST(numberDoctors AS INT) AS numberDoctors_clean,
  TRY_CAST(numberDoctors AS INT) IS NOT NULL AS doctors_reported,
  TRY_CAST(capacity AS INT) AS capacity_clean, TRY_CAST(capacity AS INT) IS NOT NULL AS capacity_reported,
  TRY_CAST(yearEstablished AS INT) AS yearEstablished_clean,
  {STAFF} AS affiliated_staff_presence, {LOGO} AS custom_logo_presence,
  TRY_CAST(number_of_facts_about_the_organization AS DOUBLE) AS number_of_facts_about_the_organization
FROM raw""",
        raw=inputs.RAW_FACILITIES,
    ),
)
def safe_cast_flags(spark, folder):
    df = derive(spark, folder, inputs.RAW_FACILITIES)
    df = casting.with_reported(
        df,
        [
            ("numberDoctors", "numberDoctors_clean", "doctors_reported"),
            ("capacity", "capacity_clean", "capacity_reported"),
        ],
        "int",
    ).withColumn("yearEstablished_clean", casting.safe_cast("yearEstablished", "int"))
    df = casting.bool_columns(df, ["affiliated_staff_presence", "custom_logo_presence"])
    df = casting.numeric_columns(df, ["number_of_facts_about_the_organization"])
    return df.select(
        "unique_id", "numberDoctors_clean", "doctors_reported", "capacity_clean", "capacity_reported",
        "yearEstablished_clean", "affiliated_staff_presence", "custom_logo_presence",
        "number_of_facts_about_the_organization",
    )


LIST_TEXT = """
SELECT event_id,
  CASE event_id % 6 WHEN 0 THEN '["' || event_type || '","' || event_type || '",null,""," b "]'
    WHEN 1 THEN '[' || CAST(user_id AS STRING) || ']' WHEN 2 THEN 'plain ' || event_type
    WHEN 3 THEN '[''' || event_type || ''']' WHEN 4 THEN '  ' END AS items
FROM {events}
"""


@query(
    "parse_lists",
    with_inputs(
        """
WITH strict AS (SELECT event_id, items,
    CASE WHEN event_id % 6 IN (0, 1) THEN CAST(items AS JSON)::VARCHAR[]
         WHEN event_id % 6 = 3 THEN CAST(replace(items, '''', '"') AS JSON)::VARCHAR[] END AS parsed
  FROM texts)
SELECT event_id,
  list_aggregate(list_transform(parsed, lambda x: coalesce(x, '~')), 'string_agg', '|') AS parsed,
  CAST(coalesce(len(parsed), 0) AS INT) AS type_count,
  CAST(coalesce(len(list_distinct(parsed)), 0) AS INT) AS distinct_count,
  coalesce(list_aggregate(list_filter(list_transform(
    CASE WHEN trim(items) = '' OR items IS NULL THEN [] ELSE coalesce(parsed, [items]) END,
    lambda x: trim(x)), lambda x: x <> ''), 'string_agg', '|'), '') AS tolerant
FROM strict""",
        texts=LIST_TEXT,
    ),
)
def parse_lists(spark, folder):
    df = derive(spark, folder, LIST_TEXT).withColumn("tolerant", lists.parse_list_any("items"))
    df = lists.parse_list_columns(df, ["items"])
    return df.select(
        "event_id",
        F.array_join("items", "|", "~").alias("parsed"),
        lists.type_count("items").alias("type_count"),
        lists.distinct_count("items").alias("distinct_count"),
        F.array_join("tolerant", "|").alias("tolerant"),
    )


SUPPRESSED = """
SELECT p_partkey, p_type,
  CASE p_partkey % 7 WHEN 0 THEN '*' WHEN 1 THEN 'NA' WHEN 2 THEN '(' || CAST(p_size AS STRING) || ')'
    WHEN 3 THEN 'N/A' WHEN 4 THEN '' WHEN 5 THEN NULL ELSE CAST(p_size AS STRING) END AS share_pct,
  CASE WHEN p_partkey % 3 = 0 THEN '(' || CAST(p_size AS STRING) ELSE '(' || CAST(p_size AS STRING) || '.5)' END AS other_pct,
  p_retailprice AS price_pct
FROM {part}
"""


@query(
    "clean_suppressed",
    with_inputs(
        """
SELECT p_partkey, p_type,
  TRY_CAST(nullif(nullif(nullif(nullif(replace(replace(share_pct, '(', ''), ')', ''), '*'), 'NA'), 'N/A'), '') AS DOUBLE) AS share_pct,
  share_pct LIKE '(%)' AS share_pct_low_confidence,
  TRY_CAST(replace(replace(other_pct, '(', ''), ')', '') AS DOUBLE) AS other_pct,
  other_pct LIKE '(%)' AS other_pct_low_confidence, price_pct
FROM raw""",
        raw=SUPPRESSED,
    ),
)
def clean_suppressed(spark, folder):
    return casting.clean_suppressed(derive(spark, folder, SUPPRESSED), "_pct", config.SUPPRESSED_MARKERS)


MESSY_NAMES = """
SELECT p_partkey, '  ' || upper(p_name) || '   of ' || p_type || ' ' AS name,
  CASE WHEN p_partkey % 9 = 0 THEN ' na ' WHEN p_partkey % 10 = 0 THEN NULL ELSE p_brand END AS brand
FROM {part}
"""


@query(
    "name_norm",
    with_inputs(
        """
SELECT p_partkey, norm, CASE norm WHEN 'small ring of economy' THEN 'ring' WHEN 'red widget of economy' THEN 'widget'
  ELSE norm END AS alias
FROM (SELECT p_partkey, lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS norm
      FROM names WHERE name IS NOT NULL AND brand IS NOT NULL AND upper(trim(brand)) <> 'NA') AS n""",
        names=MESSY_NAMES,
    ),
)
def name_norm(spark, folder):
    df = lookup.drop_garbage(derive(spark, folder, MESSY_NAMES), ["name", "brand"], {"brand": ["NA"]})
    df = df.select("p_partkey", names.norm_name("name").alias("norm"))
    mapping = {"small ring of economy": "ring", "red widget of economy": "widget"}
    return df.withColumn("alias", names.alias_lookup("norm", mapping))


@query(
    "name_key",
    """
SELECT doc_id, md5(lower(trim(strip_accents(text), chr(10) || chr(9) || chr(13) || ' '))) AS key_md5
FROM documents""",
)
def name_key(spark, folder):
    docs = load_table(spark, folder, "documents")
    return docs.select("doc_id", F.md5(names.name_key("text").cast("binary")).alias("key_md5"))


CODE_TEXT = """
SELECT o_orderkey,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'no code 12345 here'
    WHEN 2 THEN 'PIN ' || CAST(100000 + o_orderkey % 900000 AS STRING) || ', IND ' || CAST(200000 + o_custkey AS STRING)
    ELSE 'tel 0' || CAST(1000000000 + o_custkey AS STRING) END AS address
FROM {orders}
"""


@query(
    "extract_code",
    with_inputs(
        "SELECT o_orderkey, TRY_CAST(nullif(regexp_extract(address, '[0-9]{6}'), '') AS BIGINT) AS zip_clean FROM texts",
        texts=CODE_TEXT,
    ),
)
def extract_code(spark, folder):
    return derive(spark, folder, CODE_TEXT).select("o_orderkey", text.extract_code("address").alias("zip_clean"))


PRIOR_BODY = """
SELECT unique_id, source_type_count, source_url_count, round(least(1.0, {total}), 6) AS richness_prior
FROM (SELECT unique_id, CASE WHEN source_types LIKE '[%' THEN CAST(json_array_length(source_types) AS INT) ELSE 0 END AS source_type_count,
    CAST(CASE WHEN source_urls IS NULL THEN 0 ELSE len(list_distinct(CAST(CAST(source_urls AS JSON) AS VARCHAR[]))) END AS INT) AS source_url_count,
    CAST(""" + STAFF + """ AS INT) AS staff, CAST(""" + LOGO + """ AS INT) AS logo FROM raw) AS c"""
BASE = "(least(source_type_count / 4.0, 0.4) + least(source_url_count / 5.0, 0.3))"


def _prior(spark, folder, mode):
    df = derive(spark, folder, inputs.RAW_FACILITIES)
    df = lists.parse_list_columns(df, ["source_types", "source_urls"])
    df = casting.bool_columns(df, ["affiliated_staff_presence", "custom_logo_presence"])
    df = lists.source_counts(df, "source_types", "source_urls")
    prior = lists.richness_prior(
        F.col("source_type_count"), F.col("source_url_count"),
        F.col("affiliated_staff_presence"), F.col("custom_logo_presence"), mode,
    )
    return df.select("unique_id", "source_type_count", "source_url_count", F.round(prior, 6).alias("richness_prior"))


@query(
    "richness_prior",
    with_inputs(
        PRIOR_BODY.format(total=BASE + " + 0.15 * coalesce(staff, 0) + 0.15 * coalesce(logo, 0)"),
        raw=inputs.RAW_FACILITIES,
    ),
)
def richness_prior(spark, folder):
    return _prior(spark, folder, "zero")


@query(
    "richness_prior_saturate",
    with_inputs(
        PRIOR_BODY.format(
            total="CASE WHEN staff IS NULL OR logo IS NULL THEN 1.0 ELSE " + BASE + " + 0.15 * staff + 0.15 * logo END"
        ),
        raw=inputs.RAW_FACILITIES,
    ),
)
def richness_prior_saturate(spark, folder):
    return _prior(spark, folder, "saturate")


VALID_SQL = "(latitude BETWEEN 6 AND 38) AND (longitude BETWEEN 68 AND 98)"


@query(
    "coords_valid",
    with_inputs(f"SELECT unique_id, {VALID_SQL} AS coordinates_valid FROM raw", raw=inputs.RAW_FACILITIES),
)
def coords_valid(spark, folder):
    df = clean.with_coordinates_valid(derive(spark, folder, inputs.RAW_FACILITIES))
    return df.select("unique_id", "coordinates_valid")


@query(
    "invalid_coordinates",
    with_inputs(
        f"SELECT unique_id, name, address_city, latitude, longitude FROM raw WHERE NOT ({VALID_SQL})",
        raw=inputs.RAW_FACILITIES,
    ),
)
def invalid_coordinates(spark, folder):
    df = clean.with_coordinates_valid(derive(spark, folder, inputs.RAW_FACILITIES))
    return clean.invalid_coordinates(df).select("unique_id", "name", "address_city", "latitude", "longitude")


@query(
    "lenient_values",
    with_inputs(
        """
SELECT unique_id, coalesce(nullif(name, ''), nullif(address_city, '')) AS label,
  nullif(trim(address_city), '') AS city,
  coalesce(lower(trim(affiliated_staff_presence)) IN ('true', '1', 'yes', 'y'), FALSE) AS staff,
  coalesce(lower(trim(custom_logo_presence)) IN ('true', '1', 'yes', 'y'), FALSE) AS logo,
  TRY_CAST(numberDoctors || '.7' AS DOUBLE) AS doctors_float,
  CAST(trunc(TRY_CAST(numberDoctors || '.7' AS DOUBLE)) AS INT) AS doctors_int
FROM (SELECT * REPLACE (CASE WHEN numberDoctors IN ('NA', '', '*') THEN 'x' ELSE numberDoctors END AS numberDoctors) FROM raw) AS r""",
        raw=inputs.RAW_FACILITIES,
    ),
)
def lenient_values(spark, folder):
    df = derive(spark, folder, inputs.RAW_FACILITIES)
    doctors = F.when(F.col("numberDoctors").isin("NA", "", "*"), "x").otherwise(F.col("numberDoctors"))
    doctors = F.concat(doctors, F.lit(".7"))
    return df.select(
        "unique_id",
        casting.first_nonempty("name", "address_city").alias("label"),
        casting.clean_text("address_city").alias("city"),
        casting.as_bool("affiliated_staff_presence").alias("staff"),
        casting.as_bool("custom_logo_presence").alias("logo"),
        casting.as_float(doctors).alias("doctors_float"),
        casting.as_int(doctors).alias("doctors_int"),
    )


@query(
    "mode_per_key",
    """
SELECT c_custkey, c_name, m.o_orderpriority, m.o_orderstatus
FROM customer LEFT JOIN (
  SELECT * FROM (SELECT o_custkey, o_orderpriority, o_orderstatus,
      row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority, o_orderstatus) AS r
    FROM orders GROUP BY o_custkey, o_orderpriority, o_orderstatus) AS g WHERE r = 1) AS m
ON c_custkey = m.o_custkey""",
)
def mode_per_key(spark, folder):
    orders = load_table(spark, folder, "orders")
    usual = lookup.mode_per_key(orders, "o_custkey", ["o_orderpriority", "o_orderstatus"])
    customers = load_table(spark, folder, "customer").select("c_custkey", "c_name")
    return customers.join(usual.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")


CODES_SQL = """
codes AS (
  SELECT u.*, round(g.lat, 6) AS pin_centroid_lat, round(g.lon, 6) AS pin_centroid_lon
  FROM (SELECT pincode, district, statename,
      lower(trim(regexp_replace(district, '\\s+', ' ', 'g'))) AS district_norm,
      lower(trim(regexp_replace(statename, '\\s+', ' ', 'g'))) AS state_norm
    FROM (SELECT pincode, district, statename,
        row_number() OVER (PARTITION BY pincode ORDER BY count(*) DESC, district, statename) AS r
      FROM directory WHERE district IS NOT NULL AND statename IS NOT NULL AND upper(trim(statename)) <> 'NA'
      GROUP BY pincode, district, statename) AS c WHERE r = 1) AS u
  LEFT JOIN (SELECT pincode, avg(TRY_CAST(latitude AS DOUBLE)) AS lat, avg(TRY_CAST(longitude AS DOUBLE)) AS lon
    FROM directory GROUP BY pincode) AS g USING (pincode))
"""


@query("code_lookup", with_inputs("WITH " + CODES_SQL + " SELECT * FROM codes", directory=inputs.DIRECTORY))
def code_lookup(spark, folder):
    codes = lookup.code_lookup(derive(spark, folder, inputs.DIRECTORY))
    return codes.withColumns(
        {c: F.round(c, 6) for c in ("pin_centroid_lat", "pin_centroid_lon")}
    )


@query(
    "code_join",
    with_inputs(
        "WITH " + CODES_SQL + """,
zips AS (SELECT unique_id, TRY_CAST(nullif(regexp_extract(address_zipOrPostcode, '[0-9]{6}'), '') AS BIGINT) AS zip_clean FROM raw)
SELECT unique_id, zip_clean, district_norm, state_norm, pin_centroid_lat, pin_centroid_lon
FROM zips LEFT JOIN codes ON zip_clean = pincode""",
        directory=inputs.DIRECTORY,
        raw=inputs.RAW_FACILITIES,
    ),
)
def code_join(spark, folder):
    codes = code_lookup(spark, folder).withColumnRenamed("pincode", "zip_clean").drop("district", "statename")
    zips = derive(spark, folder, inputs.RAW_FACILITIES).select(
        "unique_id", text.extract_code("address_zipOrPostcode").alias("zip_clean")
    )
    return skew_safe_join(zips, codes, ["zip_clean"])
