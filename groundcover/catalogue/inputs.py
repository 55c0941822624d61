"""Domain-shaped inputs derived from the driver tables by key arithmetic.

Plain SQL that means the same in every engine; the operators under test are not used.
"""

# Directory records as they arrive: numbers, flags and lists as text.
RAW_FACILITIES = """
SELECT 'F' || CAST(c_custkey AS STRING) AS unique_id,
  CASE WHEN c_custkey % 101 = 0 THEN '' WHEN c_custkey % 103 = 0 THEN NULL ELSE c_name END AS name,
  CASE WHEN c_custkey % 19 = 0 THEN ' ' ELSE n_name || ' city' END AS address_city,
  r_name AS address_stateOrRegion,
  CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 14 = 0 THEN 'no code'
       ELSE 'PIN ' || CAST(100000 + c_custkey % 1200 AS STRING) || '7' END AS address_zipOrPostcode,
  CASE c_custkey % 7 WHEN 0 THEN 'NA' WHEN 1 THEN '' WHEN 2 THEN '*'
       ELSE CAST(c_custkey % 500 AS STRING) END AS numberDoctors,
  CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'N/A' ELSE CAST(c_custkey % 900 AS STRING) END AS capacity,
  CASE WHEN c_custkey % 6 = 0 THEN 'unknown' ELSE CAST(1900 + c_custkey % 120 AS STRING) END AS yearEstablished,
  CASE c_custkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'maybe' END AS affiliated_staff_presence,
  CASE c_custkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'f' WHEN 3 THEN 't' END AS custom_logo_presence,
  CASE WHEN c_custkey % 10 = 9 THEN 'NA' ELSE CAST(c_custkey % 9 AS STRING) END AS number_of_facts_about_the_organization,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN CAST(52 AS DOUBLE)
       ELSE 6 + CAST(c_custkey * 37 % 3200 AS DOUBLE) / 100 END AS latitude,
  CASE WHEN c_custkey % 23 = 0 THEN NULL WHEN c_custkey % 29 = 0 THEN CAST(-30 AS DOUBLE)
       ELSE 68 + CAST(c_custkey * 53 % 3000 AS DOUBLE) / 100 END AS longitude,
  CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '[]' WHEN 2 THEN '["web"]'
       WHEN 3 THEN '["web","web","registry"]' WHEN 4 THEN '["web","press","registry","social"]'
       ELSE 'not json' END AS source_types,
  CASE c_custkey % 5 WHEN 0 THEN '["a","a",null,""]' WHEN 1 THEN NULL
       WHEN 2 THEN '["http://h' || CAST(c_custkey % 50 AS STRING) || '.org","http://x.org"]'
       WHEN 3 THEN '[]' ELSE '["u1","u2","u3","u4","u5","u5"]' END AS source_urls
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

# Cleaned facilities; flags and counts may be unknown.
FACILITIES = """
SELECT 'F' || CAST(c_custkey AS STRING) AS unique_id,
  CASE WHEN c_custkey % 101 = 0 THEN '' ELSE c_name END AS name,
  CASE WHEN c_custkey % 19 = 0 THEN ' ' ELSE n_name || ' city' END AS address_city,
  CASE WHEN c_custkey % 41 = 0 THEN ' ' WHEN c_custkey % 3 = 0 THEN '  ' ELSE '' END
    || CASE WHEN c_custkey % 41 = 0 THEN '' ELSE n_name || ' ' || CAST(CAST((c_custkey - c_custkey % 100) / 100 AS INT) AS STRING) END
    AS nfhs_district_name,
  CASE WHEN c_custkey % 43 = 0 THEN NULL ELSE r_name END AS nfhs_state_ut,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 7 > 3 END AS doctors_reported,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey % 9 > 5 END AS capacity_reported,
  CAST(c_custkey % 500 AS INT) AS numberDoctors_clean,
  CAST(c_custkey % 900 AS INT) AS capacity_clean,
  CAST(1900 + c_custkey % 120 AS INT) AS yearEstablished_clean,
  CASE c_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS affiliated_staff_presence,
  CASE c_custkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN NULL ELSE FALSE END AS custom_logo_presence,
  CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE CAST(c_custkey % 6 AS DOUBLE) END AS number_of_facts_about_the_organization,
  CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE CAST(c_custkey % 4 AS INT) END AS source_type_count,
  CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_custkey % 12 <> 5 END AS coordinates_valid,
  c_custkey % 17 <> 0 AS district_resolved,
  6 + CAST(c_custkey * 37 % 3200 AS DOUBLE) / 100 AS latitude,
  68 + CAST(c_custkey * 53 % 3000 AS DOUBLE) / 100 AS longitude,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 100000 + c_custkey END AS zip_clean,
  CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE CAST(c_custkey % 21 AS DOUBLE) / 20 END AS richness_prior,
  c_mktsegment AS description, c_mktsegment AS procedure, CAST(NULL AS STRING) AS equipment,
  c_custkey
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

# Capability evidence, several rows per facility.
EVIDENCE = """
SELECT 'F' || CAST(o_custkey AS STRING) AS unique_id,
  CASE o_orderkey % 6 WHEN 0 THEN 'ICU' WHEN 1 THEN 'NICU' WHEN 2 THEN 'Emergency'
       WHEN 3 THEN 'Maternity' WHEN 4 THEN 'Oncology' ELSE 'Trauma' END AS capability,
  CASE WHEN o_totalprice >= 480000 THEN 'verified' WHEN o_totalprice >= 450000 THEN 'likely'
       WHEN o_totalprice >= 400000 THEN 'weak_signal' ELSE 'no_signal' END AS evidence_status,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 3 = 0 END AS keyword_confirmed,
  CAST(o_orderkey % 101 AS INT) AS trust_score_pct,
  CAST(o_orderkey % 101 AS DOUBLE) / 100 AS trust_score,
  CASE o_orderkey % 4 WHEN 0 THEN 'capability' WHEN 1 THEN 'procedure' WHEN 2 THEN ' ' ELSE 'description' END AS field_source,
  CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE ' ' || o_orderpriority || ' ' END AS text_span,
  o_totalprice / 1000000 AS score,
  'confirm with the facility.' AS confirm_message,
  o_orderkey
FROM {orders}
"""

# Retrieved spans: many per facility and capability.
MATCHES = """
SELECT 'F' || CAST(l_partkey AS STRING) AS unique_id,
  CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'ICU' WHEN 'AO' THEN 'NICU' WHEN 'NF' THEN 'Emergency'
       WHEN 'NO' THEN 'Maternity' WHEN 'RF' THEN 'Oncology' ELSE 'Trauma' END AS capability,
  CASE l_linenumber % 4 WHEN 0 THEN 'capability' WHEN 1 THEN 'procedure' WHEN 2 THEN 'equipment'
       ELSE 'description' END AS field_source,
  CASE l_suppkey % 6 WHEN 0 THEN 'ICU and critical care ward' WHEN 1 THEN 'Neonatal unit, maternity services'
       WHEN 2 THEN 'Emergency casualty and trauma bay' WHEN 3 THEN 'oncology and chemotherapy'
       WHEN 4 THEN 'Ventilator support; labor and delivery' END AS text_span,
  l_extendedprice / 100000 AS score,
  CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || '_' || CAST(l_suppkey AS STRING)
    || '_' || CAST(l_quantity AS STRING) AS span_id
FROM {lineitem}
"""

# Postal directory: one row per post office.
DIRECTORY = """
SELECT 100000 + o_custkey AS pincode,
  CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE '  Dist   ' || o_orderpriority END AS district,
  CASE WHEN o_orderkey % 31 = 0 THEN ' na ' ELSE 'State ' || o_orderstatus END AS statename,
  CASE WHEN o_orderkey % 5 = 0 THEN 'NA' ELSE CAST(6 + o_orderkey * 41 % 32 AS STRING) END AS latitude,
  CASE WHEN o_orderkey % 5 = 0 THEN 'NA' ELSE CAST(68 + o_orderkey * 43 % 30 AS STRING) END AS longitude
FROM {orders}
"""

# Districts: a nation cut into as many parts as the customers fill.
DISTRICTS = """
SELECT DISTINCT n_name || ' ' || CAST(CAST((c_custkey - c_custkey % 100) / 100 AS INT) AS STRING) AS region_name,
  r_name AS state, n_nationkey, CAST((c_custkey - c_custkey % 100) / 100 AS INT) AS part
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

# Planner events; the scenario is the user.
PLANNER_EVENTS = """
SELECT 'S' || CAST(user_id AS STRING) AS scenario_id, event_id, ts,
  CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'note' WHEN 'purchase' THEN 'shortlist'
       ELSE 'other' END AS kind,
  'Plan ' || CAST(event_id AS STRING) AS name,
  'F' || CAST(event_id % 40 AS STRING) AS facility_id,
  CASE WHEN event_id % 25 = 0 THEN '' ELSE 'note ' || props END AS note
FROM {events}
"""

# Boundaries: one 5 x 6 degree box per nation on a grid, every third with a hole.
# Corners and holes follow from the key; edges run counter-clockwise from the south-west.
POLYGON_EDGES = """
SELECT n_name AS region_id, n_name AS region_name, 0 AS poly_id, ring_id, seq,
  CAST(ox + (CASE WHEN seq IN (0, 3) THEN lo ELSE hi END) * 5 / 4 AS DOUBLE) AS x1,
  CAST(oy + (CASE WHEN seq IN (0, 1) THEN lo ELSE hi END) * 6 / 4 AS DOUBLE) AS y1,
  CAST(ox + (CASE WHEN seq IN (3, 2) THEN lo ELSE hi END) * 5 / 4 AS DOUBLE) AS x2,
  CAST(oy + (CASE WHEN seq IN (0, 3) THEN lo ELSE hi END) * 6 / 4 AS DOUBLE) AS y2
FROM (SELECT n_name, n_nationkey % 3 AS kind, CAST(68 + (n_nationkey % 5) * 6 AS DOUBLE) AS ox,
        6 + CAST(n_nationkey - n_nationkey % 5 AS DOUBLE) / 5 * 13 / 2 AS oy FROM {nation}) AS n
JOIN (SELECT 0 AS for_kind, 0 AS ring_id, CAST(0 AS DOUBLE) AS lo, CAST(4 AS DOUBLE) AS hi
      UNION ALL SELECT 1, 0, CAST(0 AS DOUBLE), CAST(4 AS DOUBLE)
      UNION ALL SELECT 2, 0, CAST(0 AS DOUBLE), CAST(4 AS DOUBLE)
      UNION ALL SELECT 0, 1, CAST(1 AS DOUBLE), CAST(2 AS DOUBLE)) AS rings ON kind = for_kind
JOIN (SELECT 0 AS of_ring, 0 AS seq UNION ALL SELECT 0, 1 UNION ALL SELECT 0, 2 UNION ALL SELECT 0, 3
      UNION ALL SELECT 1, 0 UNION ALL SELECT 1, 1 UNION ALL SELECT 1, 2 UNION ALL SELECT 1, 3) AS corners
  ON ring_id = of_ring
"""
