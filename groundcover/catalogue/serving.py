"""Rules, coverage, listings, corroboration, explanations, planner events, publishing."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundcover import config
from groundcover.catalogue import inputs
from groundcover.catalogue.registry import derive, plain, query, with_inputs
from groundcover.functions.names import norm_name
from groundcover.operators import corroborate as web
from groundcover.operators import coverage, explain, gates, planner, rules, serve
from groundcover.plans.skew import skew_safe_join
from groundcover.session import materialize, scratch_path
from groundcover.sources import publish as sinks
from groundcover.sources import versions
from groundcover.sources.tables import load_table
from groundcover.streaming import planner as stream


def _facilities(spark, folder):
    return derive(spark, folder, inputs.FACILITIES)


def _evidence(spark, folder):
    return derive(spark, folder, inputs.EVIDENCE)


BOTH = {"facilities": inputs.FACILITIES, "evidence": inputs.EVIDENCE}
SUPPORTED = "evidence_status IN ('verified', 'likely')"
ACUTE = "capability IN ('ICU', 'NICU', 'Trauma', 'Oncology')"
STRICT = {
    "check_unsupported_claim": f"{SUPPORTED} AND doctors_reported IS FALSE AND capacity_reported IS FALSE",
    "check_single_source_high_acuity": f"{ACUTE} AND {SUPPORTED} AND coalesce(source_type_count <= 1, FALSE)",
    "check_low_legitimacy_signals": "evidence_status = 'verified' AND affiliated_staff_presence IS FALSE "
    "AND custom_logo_presence IS FALSE AND coalesce(number_of_facts_about_the_organization < 3, FALSE)",
    "check_unverified_location": "coordinates_valid IS FALSE",
    "check_geography_unresolved": "district_resolved IS FALSE",
}
AS_FALSE = {
    "check_unsupported_claim": f"{SUPPORTED} AND doctors_reported IS NOT TRUE AND capacity_reported IS NOT TRUE",
    "check_single_source_high_acuity": f"{ACUTE} AND {SUPPORTED} AND coalesce(source_type_count, 0) <= 1",
    "check_low_legitimacy_signals": "evidence_status = 'verified' AND affiliated_staff_presence IS NOT TRUE "
    "AND custom_logo_presence IS NOT TRUE AND coalesce(trunc(number_of_facts_about_the_organization), 0) < 3",
    "check_unverified_location": "coordinates_valid IS NOT TRUE",
    "check_geography_unresolved": "district_resolved IS NOT TRUE",
}


def _flags_sql(conditions):
    parts = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in conditions.items())
    return with_inputs(
        f"""
SELECT o_orderkey, capability, concat_ws('|', {parts}) AS flags FROM evidence JOIN facilities USING (unique_id)""",
        **BOTH,
    )


def _flags(spark, folder, nulls):
    facts = _facilities(spark, folder).select("unique_id", *rules.RULE_INPUTS)
    rows = skew_safe_join(_evidence(spark, folder), facts, ["unique_id"], "inner")
    return rules.run_rules(rows, nulls).select(
        "o_orderkey",
        "capability",
        F.array_join(F.transform("validator_flags", lambda f: f["rule"]), "|").alias("flags"),
    )


@query("rules_strict", _flags_sql(STRICT))
def rules_strict(spark, folder):
    return _flags(spark, folder, "strict")


@query("rules_as_false", _flags_sql(AS_FALSE))
def rules_as_false(spark, folder):
    return _flags(spark, folder, "as_false")


JOINED = "j AS (SELECT e.*, f.* EXCLUDE (unique_id) FROM evidence AS e LEFT JOIN facilities AS f ON e.unique_id = f.unique_id)"


@query(
    "rule_rates",
    with_inputs(
        "WITH " + JOINED + " "
        + " UNION ALL ".join(
            f"SELECT CAST({i} AS INT) AS rule_order, '{n}' AS rule, count(*) FILTER (WHERE {c}) AS flagged_rows, count(*) AS total_rows, "
            f"round(count(*) FILTER (WHERE {c}) * 100.0::DOUBLE / count(*), 2) AS rate_pct FROM j"
            for i, (n, c) in enumerate(STRICT.items())
        ),
        **BOTH,
    ),
)
def rule_rates(spark, folder):
    return rules.rule_rates(_evidence(spark, folder), _facilities(spark, folder))


ANY_RULE = " OR ".join(f"({c})" for c in STRICT.values())


@query(
    "validation_summary",
    with_inputs(
        "WITH " + JOINED + f""",
n AS (SELECT count(*) AS total_rows, {", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in STRICT.items())},
  count(*) FILTER (WHERE evidence_status IN ('likely', 'weak_signal')) AS eligible_rows,
  count(*) FILTER (WHERE evidence_status IN ('likely', 'weak_signal') AND keyword_confirmed) AS confirmed_rows,
  count(*) FILTER (WHERE {ANY_RULE}) AS validator_flagged_rows FROM j)
SELECT total_rows, eligible_rows, confirmed_rows, round_even(confirmed_rows::DOUBLE / eligible_rows * 100, 1) AS keyword_rate_pct,
  validator_flagged_rows, round_even(validator_flagged_rows::DOUBLE / total_rows * 100, 1) AS validator_flag_rate_pct,
  {" || ',' || ".join(f"'{n}=' || {n} || ':' || CAST(round_even({n}::DOUBLE / total_rows * 1000, 0) AS INT)" for n in sorted(STRICT))} AS rules FROM n""",
        **BOTH,
    ),
)
def validation_summary(spark, folder):
    out = rules.validation_summary(_evidence(spark, folder), _facilities(spark, folder))
    return out.select(
        "total_rows", "keyword_confirmation.eligible_rows", "keyword_confirmation.confirmed_rows",
        F.col("keyword_confirmation.rate_pct").alias("keyword_rate_pct"),
        "validator_flagged_rows", "validator_flag_rate_pct",
        F.array_join(F.array_sort(F.transform("validator_rules", lambda r: F.concat(
            r["rule"], F.lit("="), r["flagged_rows"], F.lit(":"), F.round(r["rate_pct"] * 10).cast("int")))), ",").alias("rules"),
    )


# Coverage

RESOLVED_SQL = """
resolved AS (SELECT unique_id, trim(nfhs_district_name) AS region_name, trim(nfhs_state_ut) AS state FROM facilities
  WHERE district_resolved AND trim(nfhs_district_name) <> '' AND trim(nfhs_state_ut) <> '')
"""
COVERAGE_SQL = RESOLVED_SQL + """,
summary AS (SELECT region_name, state, capability,
    max(CASE WHEN evidence_status IN ('verified', 'likely') THEN 1 ELSE 0 END) AS strong,
    max(CASE WHEN evidence_status = 'weak_signal' THEN 1 ELSE 0 END) AS weak, avg(trust_score_pct) AS pct
  FROM resolved JOIN evidence USING (unique_id) GROUP BY region_name, state, capability),
counts AS (SELECT region_name, state, count(DISTINCT unique_id) AS n FROM resolved GROUP BY region_name, state),
region_coverage AS (SELECT region_name || '_' || state AS region_id, region_name, state, 'district' AS level,
    capability AS capability_queried,
    CASE WHEN n = 0 THEN 'no_data' WHEN strong = 1 THEN 'verified_coverage' WHEN weak = 1 THEN 'weak_coverage' ELSE 'no_facility' END AS coverage_status,
    CAST(n AS INT) AS facility_count, CAST(round(coalesce(pct, 0)) AS INT) AS avg_trust_score_pct
  FROM counts CROSS JOIN (SELECT DISTINCT capability FROM evidence) AS c LEFT JOIN summary USING (region_name, state, capability))
"""


def coverage_sql(body, more=""):
    return with_inputs("WITH " + COVERAGE_SQL + (f", {more}" if more else "") + body, **BOTH)


def _coverage(spark, folder):
    return coverage.region_coverage(_facilities(spark, folder), _evidence(spark, folder))


@query("region_coverage", coverage_sql(" SELECT * FROM region_coverage"))
def region_coverage(spark, folder):
    return _coverage(spark, folder)


@query(
    "region_coverage_spine",
    with_inputs(
        "WITH " + COVERAGE_SQL + """,
spine AS (SELECT region_name, state FROM districts UNION SELECT region_name, 'ELSEWHERE' FROM districts)
SELECT s.region_name || '_' || s.state AS region_id, s.region_name, s.state, 'district' AS level, c.capability AS capability_queried,
  coalesce(r.coverage_status, 'no_data') AS coverage_status, coalesce(r.facility_count, CAST(0 AS INT)) AS facility_count,
  coalesce(r.avg_trust_score_pct, CAST(0 AS INT)) AS avg_trust_score_pct
FROM spine AS s CROSS JOIN (SELECT DISTINCT capability FROM evidence) AS c
LEFT JOIN region_coverage AS r ON r.region_name = s.region_name AND r.state = s.state AND r.capability_queried = c.capability""",
        **BOTH,
        districts=inputs.DISTRICTS,
    ),
)
def region_coverage_spine(spark, folder):
    districts = derive(spark, folder, inputs.DISTRICTS)
    spine = districts.select("region_name", "state").unionByName(
        districts.select("region_name", F.lit("ELSEWHERE").alias("state"))
    )
    return coverage.region_coverage(
        _facilities(spark, folder), _evidence(spark, folder), spine, list(config.CAPABILITY_QUERIES)
    )


@query(
    "coverage_listing",
    coverage_sql(" SELECT * FROM region_coverage WHERE capability_queried = 'ICU'"),
)
def coverage_listing(spark, folder):
    return coverage.list_coverage(_coverage(spark, folder), " icu ")


@query(
    "coverage_filtered",
    coverage_sql(" SELECT * FROM region_coverage WHERE lower(capability_queried) = 'oncology' AND lower(state) = 'asia'"),
)
def coverage_filtered(spark, folder):
    return coverage.list_coverage(_coverage(spark, folder), "Oncology", state=" asia ")


@query(
    "pick_list_states",
    coverage_sql(" SELECT DISTINCT state FROM region_coverage"),
)
def pick_list_states(spark, folder):
    return coverage.pick_list(_coverage(spark, folder), "state")


@query(
    "pick_list_districts",
    coverage_sql(" SELECT DISTINCT region_name FROM region_coverage WHERE state = 'EUROPE'"),
)
def pick_list_districts(spark, folder):
    return coverage.pick_list(_coverage(spark, folder), "region_name", state="Európe")


COUNTS = """count(*) FILTER (WHERE coverage_status = 'verified_coverage') AS verified,
  count(*) FILTER (WHERE coverage_status = 'weak_coverage') AS weak, count(*) FILTER (WHERE coverage_status = 'no_facility') AS gaps,
  count(*) FILTER (WHERE coverage_status = 'no_data') AS no_data"""


@query(
    "capability_summary",
    coverage_sql(f""" SELECT capability_queried AS capability, count(*) AS rows, {COUNTS},
  CAST(round(avg(avg_trust_score_pct)) AS INT) AS avg_trust FROM region_coverage GROUP BY capability_queried"""),
)
def capability_summary(spark, folder):
    return coverage.capability_summary(_coverage(spark, folder))


@query(
    "coverage_kpis",
    coverage_sql(""" SELECT count(*) AS rows, count(DISTINCT region_id) AS districts,
  count(*) FILTER (WHERE coverage_status = 'verified_coverage') AS verified,
  CAST(round(count(*) FILTER (WHERE coverage_status = 'verified_coverage')::DOUBLE / count(*) * 100) AS INT) AS verified_pct,
  CAST(round(avg(avg_trust_score_pct)) AS INT) AS avg_trust FROM region_coverage"""),
)
def coverage_kpis(spark, folder):
    return coverage.coverage_kpis(_coverage(spark, folder))


@query(
    "state_leaderboard",
    coverage_sql(""" SELECT state, count(*) AS total, count(*) FILTER (WHERE coverage_status = 'verified_coverage') AS verified,
  count(DISTINCT region_name) AS districts, CAST(sum(facility_count) AS BIGINT) AS facility_capability_rows,
  CAST(round(count(*) FILTER (WHERE coverage_status = 'verified_coverage')::DOUBLE / count(*) * 100) AS INT) AS pct
FROM region_coverage GROUP BY state ORDER BY pct DESC, state LIMIT 5"""),
)
def state_leaderboard(spark, folder):
    return coverage.state_leaderboard(_coverage(spark, folder), 5)


@query(
    "coverage_distribution",
    coverage_sql(""" SELECT coverage_status, count(*) AS rows, round(count(*)::DOUBLE / sum(count(*)) OVER () * 100, 2) AS pct
FROM region_coverage GROUP BY coverage_status"""),
)
def coverage_distribution(spark, folder):
    return coverage.distribution(_coverage(spark, folder), "coverage_status")


BOUNDARIES = inputs.DISTRICTS


@query(
    "boundary_coverage",
    coverage_sql(f""" SELECT b.n_nationkey, b.part, b.region_name, b.state, c.coverage_status, c.facility_count, c.avg_trust_score_pct
FROM ({plain(BOUNDARIES)}) AS b LEFT JOIN region_coverage AS c
  ON c.region_name = b.region_name AND c.state = b.state AND c.capability_queried = 'ICU'"""),
)
def boundary_coverage(spark, folder):
    icu = coverage.list_coverage(_coverage(spark, folder), "ICU")
    return coverage.enrich_boundaries(derive(spark, folder, BOUNDARIES), icu).select(
        "n_nationkey", "part", "region_name", "state", "coverage_status", "facility_count", "avg_trust_score_pct"
    )


@query(
    "boundary_coverage_by_name",
    coverage_sql(f""" SELECT b.n_nationkey, b.part, c.capability_queried, c.coverage_status FROM ({plain(BOUNDARIES)}) AS b
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region_name ORDER BY state DESC, capability_queried DESC) AS r
  FROM region_coverage) AS x WHERE r = 1) AS c ON c.region_name = b.region_name"""),
)
def boundary_coverage_by_name(spark, folder):
    regions = derive(spark, folder, BOUNDARIES).drop("state")
    out = coverage.enrich_boundaries(regions, _coverage(spark, folder), ["region_name"])
    return out.select("n_nationkey", "part", "capability_queried", "coverage_status")


# Records and listings

MERGE_ATTRIBUTES = ["facility", "district", "latitude", "longitude"]
CLAIM_FIELDS = ["name", "status", "trust_score_pct", "confidence_level", "evidence_type"]
CLAIMS_SQL = """
rows AS (SELECT unique_id, o_orderkey, f.name AS facility, trim(nfhs_district_name) AS district,
  CASE WHEN coordinates_valid THEN latitude END AS latitude, CASE WHEN coordinates_valid THEN longitude END AS longitude,
  capability AS name, CASE WHEN o_orderkey % 13 = 0 THEN 'Claimed-Only' WHEN o_orderkey % 17 = 0 THEN 'other' ELSE upper(evidence_status) END AS status,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE trust_score_pct * 2 - 50 END AS trust_score_pct, trust_score,
  CASE WHEN o_orderkey % 19 = 0 THEN 'set' ELSE '' END AS confidence_level, field_source, text_span, e.confirm_message
  FROM evidence AS e JOIN facilities AS f USING (unique_id))
"""
NORMAL_SQL = CLAIMS_SQL + """,
claims AS (SELECT unique_id, o_orderkey, facility, district, latitude, longitude, name, s AS status, pct AS trust_score_pct,
    CAST(pct AS DOUBLE) / 100 AS trust_score,
    CASE WHEN confidence_level <> '' THEN confidence_level WHEN s = 'verified' THEN 'high' WHEN s = 'likely' THEN 'medium' ELSE 'low' END AS confidence_level,
    CASE WHEN s = 'verified' THEN 'corroborating' WHEN s = 'no_signal' THEN 'absence' ELSE 'claim' END AS evidence_type
  FROM (SELECT *, CASE WHEN replace(lower(status), '-', '_') IN ('verified', 'likely') THEN lower(status)
      WHEN replace(lower(status), '-', '_') IN ('weak_signal', 'claimed_only') THEN 'weak_signal' ELSE 'no_signal' END AS s,
    CAST(greatest(0, least(100, floor(coalesce(trust_score_pct, trust_score * 100) + 0.5))) AS INT) AS pct FROM rows) AS n),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unique_id, name ORDER BY o_orderkey DESC) AS r,
    min(o_orderkey) OVER (PARTITION BY unique_id, name) AS place FROM claims) AS l WHERE r = 1),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY o_orderkey) AS r FROM claims) AS f WHERE r = 1),
merged AS (SELECT f.unique_id, f.facility, f.district, f.latitude, f.longitude, l.listed, l.n FROM firsts AS f JOIN (
  SELECT unique_id, count(*) AS n, string_agg(name || ':' || status || ':' || CAST(trust_score_pct AS VARCHAR), '|' ORDER BY place) AS listed
  FROM latest GROUP BY unique_id) AS l USING (unique_id)),
chosen AS (SELECT m.*, c.status, c.trust_score_pct FROM merged AS m JOIN (SELECT unique_id, status, trust_score_pct FROM (
  SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY CASE WHEN name = 'ICU' THEN 0 ELSE 1 END, place) AS k FROM latest) AS x WHERE k = 1) AS c USING (unique_id))
"""


def claims_sql(body):
    return with_inputs("WITH " + NORMAL_SQL + body, **BOTH)


def _claim_rows(spark, folder):
    e = _evidence(spark, folder).withColumnRenamed("capability", "claim_name")
    f = _facilities(spark, folder).select(
        "unique_id",
        F.col("name").alias("facility"),
        F.trim("nfhs_district_name").alias("district"),
        F.when(F.col("coordinates_valid"), F.col("latitude")).alias("latitude"),
        F.when(F.col("coordinates_valid"), F.col("longitude")).alias("longitude"),
    )
    key = F.col("o_orderkey")
    return skew_safe_join(e, f, ["unique_id"], "inner").select(
        "unique_id", "o_orderkey", *MERGE_ATTRIBUTES,
        F.col("claim_name").alias("name"),
        F.when(key % 13 == 0, "Claimed-Only").when(key % 17 == 0, "other").otherwise(F.upper("evidence_status")).alias("status"),
        F.when(key % 7 != 0, F.col("trust_score_pct") * 2 - 50).alias("trust_score_pct"),
        "trust_score",
        F.when(key % 19 == 0, "set").otherwise("").alias("confidence_level"),
        "field_source", "text_span", "confirm_message",
    )


def _merged(spark, folder):
    claims = serve.normalize_claim(_claim_rows(spark, folder))
    return serve.merge_facility_rows(claims, "o_orderkey", MERGE_ATTRIBUTES, CLAIM_FIELDS)


@query(
    "normalize_claim",
    claims_sql(" SELECT o_orderkey, name, status, trust_score, trust_score_pct, confidence_level, evidence_type, "
               "CASE WHEN trust_score_pct >= 80 THEN 'score-high' WHEN trust_score_pct >= 60 THEN 'score-mid' ELSE 'score-low' END AS tone FROM claims"),
)
def normalize_claim(spark, folder):
    return serve.normalize_claim(_claim_rows(spark, folder)).select(
        "o_orderkey", "name", "status", "trust_score", "trust_score_pct", "confidence_level", "evidence_type",
        serve.score_tone("trust_score_pct").alias("tone"),
    )


@query("facility_merge", claims_sql(" SELECT unique_id, facility, district, CAST(n AS INT) AS claim_count, listed FROM merged"))
def facility_merge(spark, folder):
    return _merged(spark, folder).select(
        "unique_id", "facility", "district", F.size("claims").alias("claim_count"),
        F.array_join(
            F.transform("claims", lambda c: F.concat_ws(":", c["name"], c["status"], c["trust_score_pct"].cast("string"))), "|"
        ).alias("listed"),
    )


@query(
    "region_facilities",
    claims_sql(" SELECT unique_id, status, trust_score_pct FROM chosen WHERE district = 'NATION_3 0' AND status = 'no_signal'"),
)
def region_facilities(spark, folder):
    rows = serve.region_facilities(_merged(spark, folder), " nation_3 0", "ICU", status="no_signal")
    return rows.select("unique_id", "status", "trust_score_pct")


@query(
    "region_facilities_order",
    claims_sql(" SELECT unique_id, status, trust_score_pct, row_number() OVER (ORDER BY trust_score_pct DESC, unique_id) AS best_first, "
               "row_number() OVER (ORDER BY trust_score_pct, unique_id) AS worst_first FROM chosen WHERE district = 'NATION_3 0'"),
)
def region_facilities_order(spark, folder):
    """Both orders of the list's sort switch, as positions."""
    merged = materialize(_merged(spark, folder), "merged")
    best, worst = (
        serve.placed_facilities(merged, "nation_3 0", "ICU", best_first=first).withColumnRenamed("position", name)
        for first, name in ((True, "best_first"), (False, "worst_first"))
    )
    return best.select("unique_id", "status", "trust_score_pct", "best_first").join(
        worst.select("unique_id", "worst_first"), "unique_id"
    )


@query(
    "preview_markers",
    claims_sql(""" SELECT unique_id, trust_score_pct, latitude, longitude FROM chosen
WHERE latitude IS NOT NULL AND longitude IS NOT NULL ORDER BY trust_score_pct DESC, unique_id LIMIT 72"""),
)
def preview_markers(spark, folder):
    return serve.preview_markers(_merged(spark, folder), "ICU", config.PREVIEW_MARKERS).select(
        "unique_id", "trust_score_pct", "latitude", "longitude"
    )


@query(
    "region_stats",
    claims_sql(", " + COVERAGE_SQL.strip() + """,
l AS (SELECT count(*) AS facilities, count(*) FILTER (WHERE status = 'verified') AS verified, CAST(round(avg(trust_score_pct)) AS INT) AS avg_trust
  FROM chosen WHERE district = 'NATION_3 0'),
m AS (SELECT count(*) AS regions, count(*) FILTER (WHERE coverage_status = 'verified_coverage') AS verified_coverage,
  count(*) FILTER (WHERE coverage_status = 'weak_coverage') AS weak_coverage, count(*) FILTER (WHERE coverage_status = 'no_facility') AS no_facility,
  count(*) FILTER (WHERE coverage_status = 'no_data') AS no_data FROM region_coverage WHERE capability_queried = 'ICU')
SELECT l.*, m.*, greatest(regions, 1) AS total_regions, round(verified_coverage::DOUBLE / regions * 100, 2) AS verified_coverage_pct,
  round(weak_coverage::DOUBLE / regions * 100, 2) AS weak_coverage_pct, round(no_facility::DOUBLE / regions * 100, 2) AS no_facility_pct,
  round(no_data::DOUBLE / regions * 100, 2) AS no_data_pct FROM l CROSS JOIN m"""),
)
def region_stats(spark, folder):
    listed = serve.region_facilities(_merged(spark, folder), "NATION_3 0", "ICU")
    return coverage.region_stats(listed, coverage.list_coverage(_coverage(spark, folder), "ICU"))


RECORD_SQL = """
SELECT f.unique_id, coalesce(nullif(name, ''), 'Unnamed facility') AS name, nullif(trim(nfhs_state_ut), '') AS state,
  nullif(trim(nfhs_district_name), '') AS district, CAST(zip_clean AS VARCHAR) AS pin,
  CASE WHEN coordinates_valid THEN latitude END AS lat, CASE WHEN coordinates_valid THEN longitude END AS lon,
  NOT coalesce(district_resolved, FALSE) AS unresolved, coalesce(capacity_reported, FALSE) AS capacity_reported,
  CASE WHEN doctors_reported THEN numberDoctors_clean END AS doctors, CASE WHEN capacity_reported THEN capacity_clean END AS capacity
"""


def _flat(records):
    return records.select(
        "unique_id", "name", "location.state", "location.district", "location.pin", "location.lat", "location.lon",
        "location.unresolved", "data_completeness.capacity_reported",
        F.col("raw_fields.numberDoctors").alias("doctors"), "raw_fields.capacity",
    )


@query("facility_record", with_inputs(RECORD_SQL + " FROM facilities AS f", **BOTH))
def facility_record(spark, folder):
    return _flat(serve.facility_record(_facilities(spark, folder)))


@query(
    "facility_listing",
    with_inputs(
        RECORD_SQL + """, capability, evidence_status, trust_score_pct, nullif(trim(field_source), '') AS field_source, nullif(trim(text_span), '') AS text_span
FROM facilities AS f JOIN evidence AS e USING (unique_id) WHERE lower(trim(capability)) = 'icu' AND lower(trim(nfhs_state_ut)) = 'asia'
ORDER BY f.name, f.unique_id, capability, evidence_status, trust_score, trust_score_pct LIMIT 500""",
        **BOTH,
    ),
)
def facility_listing(spark, folder):
    records = serve.list_facilities(_facilities(spark, folder), _evidence(spark, folder), " icu", state="ASIA ", limit=config.LISTING_LIMIT)
    claim = F.col("capability_evidence")[0]
    return records.select(
        *_flat(records).columns[:2], "location.state", "location.district", "location.pin", "location.lat",
        "location.lon", "location.unresolved", "data_completeness.capacity_reported",
        F.col("raw_fields.numberDoctors").alias("doctors"), "raw_fields.capacity",
        *[claim[c].alias(c) for c in ("capability", "evidence_status", "trust_score_pct", "field_source", "text_span")],
    )


DETAIL = "F7"


@query(
    "facility_detail",
    with_inputs(
        RECORD_SQL + f""", listed, viewed AS viewed_capability, flags, coalesce(acute, FALSE) AS crosscheck_eligible FROM facilities AS f
LEFT JOIN (SELECT unique_id, string_agg(capability || ':' || evidence_status, '|' ORDER BY capability, evidence_status) AS listed FROM evidence GROUP BY unique_id) AS l USING (unique_id)
LEFT JOIN (SELECT unique_id, capability AS viewed, acute,
    concat_ws('|', {", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in AS_FALSE.items())}) AS flags
  FROM (SELECT *, {ACUTE} AND {SUPPORTED} AS acute FROM (
    SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY capability, evidence_status) AS r FROM evidence WHERE lower(capability) = 'icu') AS v WHERE r = 1) AS e
  JOIN (SELECT unique_id, {", ".join(rules.RULE_INPUTS)} FROM facilities) AS g USING (unique_id)) AS v USING (unique_id)
WHERE f.unique_id = '{DETAIL}'""",
        facilities=inputs.FACILITIES,
        evidence="SELECT DISTINCT unique_id, capability, min(evidence_status) AS evidence_status FROM (" + inputs.EVIDENCE + ") AS raw GROUP BY unique_id, capability",
    ),
)
def facility_detail(spark, folder):
    evidence = _evidence(spark, folder).groupBy("unique_id", "capability").agg(
        F.min("evidence_status").alias("evidence_status"), F.max("trust_score").alias("trust_score"),
        F.max("trust_score_pct").alias("trust_score_pct"), F.max("field_source").alias("field_source"),
        F.max("text_span").alias("text_span"), F.max("confirm_message").alias("confirm_message"),
    )
    record = serve.facility_detail(_facilities(spark, folder), evidence, DETAIL, " icu")
    return record.select(
        *["unique_id", "name", "location.state", "location.district", "location.pin", "location.lat", "location.lon",
          "location.unresolved", "data_completeness.capacity_reported"],
        F.col("raw_fields.numberDoctors").alias("doctors"), "raw_fields.capacity",
        F.array_join(F.transform("capability_evidence", lambda e: F.concat_ws(":", e["capability"], e["evidence_status"])), "|").alias("listed"),
        "viewed_capability",
        F.array_join(F.transform("validator_flags", lambda f: f["rule"]), "|").alias("flags"),
        "crosscheck_eligible",
    )


@query(
    "eligible_for_crosscheck",
    with_inputs(f"SELECT o_orderkey, capability, evidence_status FROM evidence WHERE {ACUTE} AND {SUPPORTED}", **BOTH),
)
def eligible_for_crosscheck(spark, folder):
    return serve.eligible_for_crosscheck(_evidence(spark, folder)).select("o_orderkey", "capability", "evidence_status")


@query(
    "review_sample",
    with_inputs(
        f"""
WITH j AS (SELECT e.unique_id, capability, evidence_status, trust_score_pct,
    CASE WHEN {SUPPORTED} AND {ACUTE} THEN 0 ELSE 1 END AS p
  FROM evidence AS e JOIN facilities AS f USING (unique_id) WHERE trim(name) <> '' AND trim(address_city) <> ''),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY evidence_status, unique_id ORDER BY p, trust_score_pct DESC, capability) AS a FROM j) AS x WHERE a = 1)
SELECT unique_id, capability, evidence_status, trust_score_pct, CAST(b AS INT) AS status_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY evidence_status ORDER BY p, trust_score_pct DESC, unique_id) AS b FROM once) AS y WHERE b <= 2""",
        **BOTH,
    ),
)
def review_sample(spark, folder):
    facilities = _facilities(spark, folder).select("unique_id", F.col("name").alias("facility_name"), "address_city")
    rows = skew_safe_join(_evidence(spark, folder), facilities, ["unique_id"], "inner")
    return serve.review_sample(rows).select("unique_id", "capability", "evidence_status", "trust_score_pct", "status_rank")


# Gates

@query(
    "integrity",
    """
SELECT 'no_orphans' AS gate, count(DISTINCT k) = 0 AS ok, CAST(count(DISTINCT k) AS VARCHAR) AS detail FROM (
  SELECT l_orderkey * 2 AS k FROM lineitem) AS c WHERE k NOT IN (SELECT o_orderkey FROM orders)""",
)
def integrity(spark, folder):
    lines = load_table(spark, folder, "lineitem").select((F.col("l_orderkey") * 2).alias("o_orderkey"))
    return gates.no_orphans(lines, load_table(spark, folder, "orders"), "o_orderkey")


@query(
    "gates",
    coverage_sql(""" SELECT 'status_skew' AS gate, max(n)::DOUBLE / sum(n) <= 0.85 AS ok, CAST(round(max(n)::DOUBLE / sum(n), 4) AS VARCHAR) AS detail
FROM (SELECT count(*) AS n FROM region_coverage GROUP BY coverage_status) AS d
UNION ALL SELECT 'row_count', count(*) = count(DISTINCT region_id) * 6, CAST(count(*) AS VARCHAR) || '/' || CAST(count(DISTINCT region_id) * 6 AS VARCHAR) FROM region_coverage
UNION ALL SELECT 'not_empty', count(*) > 0, CAST(count(*) AS VARCHAR) FROM region_coverage
UNION ALL SELECT 'same_values', count(*) = 0, CAST(count(*) AS VARCHAR) FROM different
UNION ALL SELECT 'same_values', count(*) + 1 = 0, CAST(count(*) + 1 AS VARCHAR) FROM different
UNION ALL SELECT 'domain_coverage_status', bad = 0, CAST(bad AS VARCHAR) FROM outside
UNION ALL SELECT 'range_avg_trust_score_pct', bad_pct = 0, CAST(bad_pct AS VARCHAR) FROM outside
UNION ALL SELECT 'domain_coverage_status', other = 0, CAST(other AS VARCHAR) FROM outside
UNION ALL SELECT 'range_avg_trust_score_pct', high = 0, CAST(high AS VARCHAR) FROM outside
UNION ALL SELECT 'rules_plausible', bad = 0, CAST(bad AS VARCHAR) FROM implausible""",
        f"""
different AS (SELECT * FROM (SELECT DISTINCT capability_queried AS c FROM region_coverage) AS f
  FULL JOIN (VALUES {", ".join(f"('{c}')" for c in config.CAPABILITY_QUERIES)}) AS w(c) USING (c) WHERE f.c IS NULL OR w.c IS NULL),
outside AS (SELECT count(*) FILTER (WHERE coverage_status NOT IN ({", ".join(f"'{c}'" for c in config.COVERAGE_STATUSES)})) AS bad,
  count(*) FILTER (WHERE avg_trust_score_pct NOT BETWEEN 0 AND 100) AS bad_pct,
  count(*) FILTER (WHERE coverage_status <> '{config.COVERAGE_STATUSES[0]}') AS other,
  count(*) FILTER (WHERE avg_trust_score_pct NOT BETWEEN 0 AND 40) AS high FROM region_coverage),
j AS (SELECT * FROM evidence JOIN facilities USING (unique_id)),
implausible AS (SELECT {" + ".join(f"(CASE WHEN count(*) FILTER (WHERE {c}) IN (0, count(*)) THEN 1 ELSE 0 END)" for c in STRICT.values())} AS bad FROM j)
"""),
)
def gates_query(spark, folder):
    cov = _coverage(spark, folder)
    facilities, evidence = _facilities(spark, folder), _evidence(spark, folder)
    regions = coverage.resolved_facilities(facilities).select("region_name", "state").distinct()
    expected = regions.agg((F.count(F.lit(1)) * len(config.CAPABILITY_QUERIES)).alias("n"))
    parts = [
        gates.not_skewed(cov),
        gates.row_count(cov, expected),
        gates.same_values(cov, "capability_queried", list(config.CAPABILITY_QUERIES)),
        gates.same_values(cov, "capability_queried", [*config.CAPABILITY_QUERIES, "Dental"]),
        gates.domain(cov, {"coverage_status": config.COVERAGE_STATUSES}, {"avg_trust_score_pct": (0, 100)}),
        gates.domain(cov, {"coverage_status": config.COVERAGE_STATUSES[:1]}, {"avg_trust_score_pct": (0, 40)}),
        gates.rules_plausible(rules.rule_rates(evidence, facilities)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "incomplete_keys",
    with_inputs(
        """
SELECT count(*) AS incomplete_rows FROM facilities WHERE district_resolved AND (nfhs_district_name IS NULL
  OR trim(nfhs_district_name) = '' OR nfhs_state_ut IS NULL OR trim(nfhs_state_ut) = '')""",
        **BOTH,
    ),
)
def incomplete_keys(spark, folder):
    return gates.incomplete_keys(_facilities(spark, folder), "district_resolved", ["nfhs_district_name", "nfhs_state_ut"])


# Search results and explanations

SEARCH = """
SELECT 'Facility ' || CAST(page_id % 500 AS STRING) || ' ' AS facility_name, ' City ' || CAST(page_id % 7 AS STRING) AS city,
  page_id AS pos, url
FROM {pages}
"""
# Pages that a facility names itself: those of shops and of one host in three.
OWN_PAGE = "(url LIKE '%shop%' OR length(url) % 3 = 0)"
DUCK_DOMAIN = (
    "regexp_replace(regexp_replace(regexp_extract(lower({0}), '^[a-z]+://([^/?#:]*)', 1), '[.]+$', ''), '^www[.]', '')"
)


@query(
    "corroborate",
    with_inputs(
        f"""
WITH r AS (SELECT lower(trim(facility_name)) AS n, lower(trim(city)) AS c, pos, url, {DUCK_DOMAIN.format("url")} AS d FROM search),
lookups AS (SELECT DISTINCT facility_name, city FROM search UNION ALL SELECT 'Nobody', 'Nowhere'),
known AS (SELECT DISTINCT n, c, d FROM r WHERE {OWN_PAGE}),
fresh AS (SELECT n, c, arg_min(url, pos) AS url FROM r WHERE d <> ''
  AND NOT EXISTS (SELECT 1 FROM known AS k WHERE k.n = r.n AND k.c = r.c AND k.d = r.d) GROUP BY n, c),
seen AS (SELECT DISTINCT n, c FROM r),
s AS (SELECT facility_name, city, CASE WHEN trim(facility_name) = 'Facility 11' THEN 'unavailable' WHEN trim(facility_name) = 'Facility 12' THEN 'error'
    WHEN seen.n IS NULL THEN 'no_digital_footprint' WHEN fresh.url IS NOT NULL THEN 'independently_corroborated' ELSE 'no_new_corroboration' END AS status, fresh.url AS u
  FROM lookups LEFT JOIN seen ON seen.n = lower(trim(facility_name)) AND seen.c = lower(trim(city))
  LEFT JOIN fresh ON fresh.n = lower(trim(facility_name)) AND fresh.c = lower(trim(city)))
SELECT facility_name, city, status, CASE status WHEN 'no_digital_footprint' THEN -0.1::DOUBLE WHEN 'independently_corroborated' THEN 0.05::DOUBLE
  WHEN 'no_new_corroboration' THEN 0::DOUBLE END AS confidence_adjustment, CASE WHEN status = 'independently_corroborated' THEN u END AS corroborating_url FROM s""",
        search=SEARCH,
    ),
)
def corroborate(spark, folder):
    found = derive(spark, folder, SEARCH)
    name = F.trim("facility_name")
    lookups = found.select("facility_name", "city").distinct().select(
        "facility_name", "city", (name != "Facility 11").alias("available"),
        F.when(name == "Facility 12", "timeout").alias("error"),
    )
    nowhere = spark.createDataFrame([("Nobody", "Nowhere", True, None)], lookups.schema)
    out = web.corroborate(lookups.unionByName(nowhere), found, found.where(OWN_PAGE))
    return out.drop("available", "error")


def _guidance_sql() -> str:
    quoted = {status: text.replace("'", "''") for status, text in config.STATUS_GUIDANCE.items()}
    return " ".join(f"WHEN '{status}' THEN '{text}'" for status, text in quoted.items())


@query(
    "prompt_table",
    with_inputs(
        """
SELECT unique_id, capability, payload_key, guidance, CAST(len(flags) AS INT) AS flag_count FROM (
  SELECT e.unique_id, capability, CAST(o_orderkey AS VARCHAR) AS payload_key,
    CASE evidence_status """ + _guidance_sql() + """ END AS guidance,
    list_filter(["""
        + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in STRICT.items())
        + """], lambda x: x IS NOT NULL) AS flags
  FROM evidence AS e JOIN facilities AS f USING (unique_id)) AS p""",
        **BOTH,
    ),
)
def prompt_table(spark, folder):
    facts = _facilities(spark, folder).select("unique_id", *rules.RULE_INPUTS, "richness_prior")
    rows = skew_safe_join(_evidence(spark, folder), facts, ["unique_id"], "inner").withColumn("span_id", F.col("o_orderkey").cast("string"))
    fields = [*config.EXPLANATION_FIELDS, "span_id"]
    out = explain.build_prompts(rules.run_rules(rows), fields)
    return out.select(
        "unique_id", "capability",
        F.get_json_object("payload", "$.capability_evidence.span_id").alias("payload_key"),
        F.get_json_object("payload", "$.confidence_instruction").alias("guidance"),
        F.size(F.from_json(F.get_json_object("payload", "$.validator_flags"), "array<struct<rule: string>>")).alias("flag_count"),
    )


@query(
    "completion_text",
    """
SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 3 THEN NULL WHEN 2 THEN NULL ELSE md5(trim(text)) END AS completion_md5,
  CASE (conv_id + turn) % 4 WHEN 2 THEN 'no choices' WHEN 3 THEN 'no text' END AS completion_error FROM conversations""",
)
def completion_text(spark, folder):
    kind = (F.col("conv_id") + F.col("turn")) % 4
    text = F.concat(F.lit("  "), F.col("text"), F.lit(" "))
    plain_text = F.to_json(F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices")))
    half = F.floor(F.length(text) / 2).cast("int")
    parts = F.array(
        F.struct(F.lit("text").alias("type"), F.substring(text, F.lit(1), half).alias("text")),
        F.struct(F.lit("image").alias("type"), F.lit("skipped").alias("text")),
        F.struct(F.lit("output_text").alias("type"), F.substring(text, half + 1, F.length(text)).alias("text")),
    )
    part_text = F.to_json(F.struct(F.array(F.struct(F.struct(parts.alias("content")).alias("message"))).alias("choices")))
    response = (
        F.when(kind == 0, plain_text).when(kind == 1, part_text).when(kind == 2, '{"choices": []}')
        .otherwise('{"choices": [{"message": {}}]}')
    )
    chats = load_table(spark, folder, "conversations").withColumn("response", response)
    out = explain.extract_completion(chats, "response")
    return out.select("conv_id", "turn", F.md5("completion").alias("completion_md5"), "completion_error")


def _duck_phrases(table):
    cases = " ".join(
        f"WHEN '{s}' THEN (" + " OR ".join(f"contains(t, '{p}')" for p in phrases) + ")" for s, phrases in table.items()
    )
    return f"coalesce(CASE evidence_status {cases} END, {{0}})"


LINT_TEXT = """
SELECT conv_id, turn, variant,
  CASE (conv_id + turn) % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'likely' WHEN 2 THEN 'weak_signal' ELSE 'no_signal' END AS evidence_status,
  CASE variant WHEN 'text' THEN text ELSE CASE (conv_id * 7 + turn) % 5 WHEN 0 THEN 'It is Verified.' WHEN 1 THEN 'Likely, and definitely so!'
    WHEN 2 THEN 'Limited evidence suggests it?' WHEN 3 THEN 'No evidence, which is certainly so.' ELSE 'One. Two."' END
    || CASE WHEN turn % 2 = 0 THEN ' No flags were raised.' ELSE '' END || ' Confirm it directly.' END AS explanation,
  'Confirm it directly.' AS confirm_message
FROM {conversations} CROSS JOIN (SELECT 'text' AS variant UNION ALL SELECT 'canned') AS variants
"""


@query(
    "explanation_lint",
    with_inputs(
        f"""
SELECT conv_id, turn, variant, CAST(sentences AS INT) AS sentences, concat_ws('|',
  CASE WHEN NOT suffix(explanation, confirm_message) THEN 'confirm_message' END,
  CASE WHEN sentences NOT IN (2, 3) THEN 'sentence_count' END,
  CASE WHEN NOT {_duck_phrases(config.REQUIRED_PHRASES).format("TRUE")} THEN 'confidence_language' END,
  CASE WHEN {_duck_phrases(config.FORBIDDEN_PHRASES).format("FALSE")} THEN 'overconfident_language' END) AS violations
FROM (SELECT *, lower(explanation) AS t, len(regexp_extract_all(replace(explanation || ' ', ' ', '  '), '[.!?]["'']?\\s')) AS sentences FROM texts) AS x""",
        texts=LINT_TEXT,
    ),
)
def explanation_lint(spark, folder):
    out = explain.lint_explanations(derive(spark, folder, LINT_TEXT))
    return out.select("conv_id", "turn", "variant", "sentences", F.array_join("violations", "|").alias("violations"))


# Planner events

FOLD_SQL = """
valid AS (SELECT * FROM ev WHERE (kind = 'create' AND length(name) BETWEEN 1 AND 120)
  OR (kind = 'note' AND length(note) BETWEEN 1 AND 4000) OR kind = 'shortlist'),
created AS (SELECT * FROM (SELECT scenario_id, name, ts AS created_at, event_id AS created_by,
  row_number() OVER (PARTITION BY scenario_id ORDER BY ts, event_id) AS r FROM valid WHERE kind = 'create') AS c WHERE r = 1),
applied AS (SELECT v.*, c.created_at FROM valid AS v JOIN created AS c USING (scenario_id)
  WHERE v.kind <> 'create' AND (v.ts > c.created_at OR (v.ts = c.created_at AND v.event_id > c.created_by)))
"""
@query(
    "scenario_list",
    with_inputs(
        "WITH " + FOLD_SQL + """
SELECT c.scenario_id, c.name, CAST(c.created_at AS VARCHAR) AS created_at, CAST(greatest(c.created_at, t.touched_at) AS VARCHAR) AS updated_at,
  coalesce(t.notes, 0) AS notes, coalesce(t.shortlisted, 0) AS shortlisted FROM created AS c LEFT JOIN (
  SELECT scenario_id, max(ts) AS touched_at, count(*) FILTER (WHERE kind = 'note') AS notes,
    count(DISTINCT CASE WHEN kind = 'shortlist' THEN facility_id END) AS shortlisted FROM applied GROUP BY scenario_id) AS t USING (scenario_id)""",
        ev=inputs.PLANNER_EVENTS,
    ),
)
def scenario_list(spark, folder):
    out = planner.scenario_list(derive(spark, folder, inputs.PLANNER_EVENTS))
    return out.withColumns({c: F.col(c).cast("string") for c in ("created_at", "updated_at")})


ITEMS_SQL = with_inputs(
    "WITH " + FOLD_SQL + """,
items AS (SELECT scenario_id, 'shortlist' AS section, facility_id, NULL AS note, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id
    FROM applied WHERE kind = 'shortlist' GROUP BY scenario_id, facility_id
  UNION ALL SELECT scenario_id, 'note', facility_id, note, ts, event_id FROM applied WHERE kind = 'note')
SELECT scenario_id, section, row_number() OVER (PARTITION BY scenario_id, section ORDER BY ts, event_id) - 1 AS pos,
  facility_id, note, CAST(ts AS VARCHAR) AS ts FROM items""",
    ev=inputs.PLANNER_EVENTS,
)


@query(
    "rejected_events",
    with_inputs(
        """
SELECT scenario_id, event_id, CASE WHEN kind NOT IN ('create', 'note', 'shortlist') THEN 'unknown kind'
    WHEN kind = 'create' AND length(name) NOT BETWEEN 1 AND 120 THEN 'name length'
    WHEN kind = 'note' AND length(note) NOT BETWEEN 1 AND 4000 THEN 'note length' ELSE 'no facility' END AS problem
FROM ev WHERE NOT ((kind = 'create' AND length(name) BETWEEN 1 AND 120) OR (kind = 'note' AND length(note) BETWEEN 1 AND 4000
    AND length(facility_id) > 0) OR (kind = 'shortlist' AND length(facility_id) > 0))""",
        ev=inputs.PLANNER_EVENTS,
    ),
)
def rejected_events(spark, folder):
    out = planner.rejected_events(derive(spark, folder, inputs.PLANNER_EVENTS))
    return out.select("scenario_id", "event_id", "problem")


@query("fold_scenarios", ITEMS_SQL)
def fold_scenarios(spark, folder):
    out = planner.scenario_items(derive(spark, folder, inputs.PLANNER_EVENTS))
    return out.withColumn("ts", F.col("ts").cast("string"))


@query("fold_scenarios_stream", ITEMS_SQL)
def fold_scenarios_stream(spark, folder):
    schema = load_table(spark, folder, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    shaped = spark.sql(inputs.PLANNER_EVENTS, events=events)
    log = scratch_path(spark, "planner-log")
    stream.append_events(shaped, log, scratch_path(spark, "planner-offsets"))
    return stream.read_items(spark, log).withColumn("ts", F.col("ts").cast("string"))


SHORTLISTS = """
SELECT 'S' || CAST(user_id AS STRING) AS scenario_id, event_id AS pos, 'F' || CAST(value_key AS STRING) AS unique_id
FROM (SELECT user_id, event_id, event_id * 7 % 4001 AS value_key FROM {events} WHERE event_type = 'purchase') AS p
"""


@query(
    "shortlist_lookup",
    with_inputs(
        "SELECT scenario_id, pos, unique_id, name FROM shortlists JOIN facilities USING (unique_id)",
        shortlists=SHORTLISTS,
        facilities=inputs.FACILITIES,
    ),
)
def shortlist_lookup(spark, folder):
    names = _facilities(spark, folder).select("unique_id", "name")
    out = serve.shortlist_lookup(derive(spark, folder, SHORTLISTS), names)
    return out.select("scenario_id", "pos", "unique_id", "name")


# Publishing

@query("publish_audited", coverage_sql(" SELECT * FROM region_coverage"))
def publish_audited(spark, folder):
    regions = coverage.resolved_facilities(_facilities(spark, folder)).select("region_name", "state").distinct().count()
    return sinks.publish_audited(
        _coverage(spark, folder), scratch_path(spark, "published"), sinks.coverage_gates(regions)
    )


@query("publish_evidence", with_inputs("SELECT unique_id, capability, evidence_status, trust_score_pct FROM evidence", **BOTH))
def publish_evidence(spark, folder):
    rows = _evidence(spark, folder).select("unique_id", "capability", "evidence_status", "trust_score_pct")
    return sinks.publish_evidence(rows, scratch_path(spark, "evidence"))


@query(
    "publish_version",
    "SELECT c_custkey, upper(c_mktsegment) AS segment, c_acctbal * 2 AS doubled FROM customer",
)
def publish_version(spark, folder):
    """Two versions of one table, the second made of the first with other columns."""
    path = scratch_path(spark, "versions")
    first = versions.publish_version(load_table(spark, folder, "customer"), path)
    changed = first.select("c_custkey", F.upper("c_mktsegment").alias("segment"), (F.col("c_acctbal") * 2).alias("doubled"))
    return versions.publish_version(changed, path)


@query(
    "publish_self_read",
    "SELECT c_custkey, c_name, lower(c_mktsegment) AS segment, c_acctbal * 2 AS doubled FROM customer",
)
def publish_self_read(spark, folder):
    path = scratch_path(spark, "self")
    first = sinks.publish(load_table(spark, folder, "customer"), path)
    changed = first.select(
        "c_custkey", "c_name", norm_name("c_mktsegment").alias("segment"), (F.col("c_acctbal") * 2).alias("doubled")
    )
    return sinks.publish(changed, path)
