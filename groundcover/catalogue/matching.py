"""Name matching, nearest neighbours, polygons and the resolution cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundcover.catalogue import inputs
from groundcover.catalogue.registry import derive, query, with_inputs
from groundcover.operators import geo, match, resolve
from groundcover.sources.tables import load_table

POINTS = """
SELECT 'C' || CAST(c_custkey AS STRING) AS unique_id,
  CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE 6 + CAST(c_custkey * 7919 % 32000 AS DOUBLE) / 1000 END AS latitude,
  68 + CAST(c_custkey * 6101 % 30000 AS DOUBLE) / 1000 AS longitude
FROM {customer}
"""
CENTROIDS = """
SELECT s_suppkey AS pincode,
  CASE WHEN s_suppkey % 40 = 0 THEN NULL ELSE 6 + CAST(s_suppkey * 3571 % 32000 AS DOUBLE) / 1000 END AS pin_centroid_lat,
  68 + CAST(s_suppkey * 4561 % 30000 AS DOUBLE) / 1000 AS pin_centroid_lon
FROM {supplier}
"""
HAVERSINE = """2 * 6371.0 * asin(sqrt(
  pow(sin((radians({lat2}) - radians({lat1})) / 2), 2)
  + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)))"""
DISTANCE = HAVERSINE.format(lat1="latitude", lon1="longitude", lat2="pin_centroid_lat", lon2="pin_centroid_lon")


@query(
    "nearest_within",
    with_inputs(
        f"""
SELECT unique_id, pincode, round(d, 6) AS distance_km FROM (
  SELECT unique_id, pincode, {DISTANCE} AS d,
    row_number() OVER (PARTITION BY unique_id ORDER BY {DISTANCE}, pincode) AS r
  FROM points CROSS JOIN centroids WHERE latitude IS NOT NULL AND pin_centroid_lat IS NOT NULL) AS x
WHERE r = 1 AND d <= 120""",
        points=POINTS,
        centroids=CENTROIDS,
    ),
)
def nearest_within(spark, folder):
    near = geo.nearest_within(derive(spark, folder, POINTS), derive(spark, folder, CENTROIDS), km=120.0)
    return near.select("unique_id", "pincode", F.round("distance_km", 6).alias("distance_km"))


@query(
    "points_in_polygons",
    with_inputs(
        """
SELECT unique_id, min(region_id) AS region_id FROM (
  SELECT unique_id, region_id, poly_id FROM points JOIN edges
  ON (y1 > latitude) <> (y2 > latitude)
   AND longitude < (x2 - x1) * (latitude - y1) / (y2 - y1) + x1
  GROUP BY unique_id, region_id, poly_id HAVING count(*) % 2 = 1) AS inside
GROUP BY unique_id""",
        points=POINTS,
        edges=inputs.POLYGON_EDGES,
    ),
)
def points_in_polygons(spark, folder):
    return geo.points_in_polygons(derive(spark, folder, POINTS), derive(spark, folder, inputs.POLYGON_EDGES))


@query(
    "region_bbox",
    with_inputs(
        """
SELECT region_id, min(least(x1, x2)) AS min_x, min(least(y1, y2)) AS min_y,
  max(greatest(x1, x2)) AS max_x, max(greatest(y1, y2)) AS max_y FROM edges GROUP BY region_id""",
        edges=inputs.POLYGON_EDGES,
    ),
)
def region_bbox(spark, folder):
    return geo.region_bbox(derive(spark, folder, inputs.POLYGON_EDGES), by=["region_id"])


# Names to match: a customer's number in words of the part vocabulary, some of them altered.
LEFT_NAMES = """
SELECT DISTINCT p_brand AS block,
  CASE p_partkey % 4 WHEN 0 THEN p_name || ' ' || p_type WHEN 1 THEN replace(p_name || ' ' || p_type, 'e', '')
    WHEN 2 THEN reverse(p_name) ELSE p_name || 's ' || lower(p_type) END AS name
FROM {part}
"""
RIGHT_NAMES = "SELECT DISTINCT p_brand AS block, p_name || ' ' || p_type AS candidate FROM {part}"
ALIASES = """
SELECT DISTINCT p_brand AS block, replace(p_name || ' ' || p_type, 'e', '') AS name, p_name || ' SMALL' AS target
FROM {part} WHERE p_type = 'ECONOMY'
"""
BLOCKED = """
SELECT DISTINCT p_brand AS block, reverse(p_name) AS name, p_name || ' ' || p_type AS candidate
FROM {part}
"""

FUZZY_SQL = """
lefts AS (SELECT DISTINCT l.block, l.name FROM left_names AS l WHERE l.block IN (SELECT block FROM right_names)),
aliased AS (SELECT DISTINCT a.block, a.name, a.target FROM aliases AS a JOIN right_names AS r ON a.block = r.block AND a.target = r.candidate),
firsts AS (SELECT l.block, l.name, a.target, e.candidate AS same FROM lefts AS l
  LEFT JOIN aliased AS a ON l.block = a.block AND l.name = a.name
  LEFT JOIN right_names AS e ON l.block = e.block AND l.name = e.candidate),
best AS (SELECT block, name, candidate FROM (
    SELECT f.block, f.name, r.candidate, row_number() OVER (PARTITION BY f.block, f.name ORDER BY
      1.0 - CAST(levenshtein(r.candidate, f.name) AS DOUBLE) / greatest(length(r.candidate), length(f.name)) DESC, r.candidate DESC) AS n,
      1.0 - CAST(levenshtein(r.candidate, f.name) AS DOUBLE) / greatest(length(r.candidate), length(f.name)) AS score
    FROM firsts AS f JOIN right_names AS r ON f.block = r.block WHERE f.target IS NULL AND f.same IS NULL) AS s
  WHERE n = 1 AND score >= CAST(0.72 AS DOUBLE)),
allowed AS (SELECT b.* FROM best AS b WHERE NOT EXISTS (SELECT 1 FROM blocked AS x
  WHERE x.block = b.block AND x.name = b.name AND x.candidate = b.candidate)),
matched AS (SELECT f.block, f.name, coalesce(f.target, f.same, a.candidate) AS matched,
  CASE WHEN f.target IS NOT NULL THEN 'known_alias' WHEN f.same IS NOT NULL THEN 'exact'
    WHEN a.candidate IS NOT NULL THEN 'fuzzy' ELSE 'unmatched' END AS match_type
  FROM firsts AS f LEFT JOIN allowed AS a ON f.block = a.block AND f.name = a.name)
"""
FUZZY_INPUTS = {
    "left_names": LEFT_NAMES, "right_names": RIGHT_NAMES, "aliases": ALIASES, "blocked": BLOCKED,
}


def _fuzzy(spark, folder, method):
    tables = {k: derive(spark, folder, v) for k, v in FUZZY_INPUTS.items()}
    return match.fuzzy_resolve(
        tables["left_names"], tables["right_names"], tables["aliases"], tables["blocked"], method=method
    )


@query("fuzzy_levenshtein", with_inputs("WITH " + FUZZY_SQL + " SELECT * FROM matched", **FUZZY_INPUTS))
def fuzzy_levenshtein(spark, folder):
    return _fuzzy(spark, folder, "levenshtein")


# The default similarity: twice the letters in matching blocks over all letters. The longest common
# block comes first (of equal ones the first in the candidate, then in the name), then the stretches before and after it.
RATIO_SQL = """
options AS (SELECT f.block, f.name, r.candidate FROM firsts AS f JOIN right_names AS r ON f.block = r.block
  WHERE f.target IS NULL AND f.same IS NULL AND 2.0 * list_sum(list_transform(list_distinct(string_split(f.name, '')),
    lambda c: least(length(f.name) - length(replace(f.name, c, '')), length(r.candidate) - length(replace(r.candidate, c, '')))))
    / (length(f.name) + length(r.candidate)) >= 0.72),
blocks AS (
  SELECT block, name, candidate, candidate AS a, name AS b, CAST(0 AS BIGINT) AS m FROM options
  UNION ALL
  SELECT block, name, candidate, piece.a, piece.b, piece.m FROM (
    SELECT block, name, candidate, unnest([
      {'a': substr(a, 1, i - 1), 'b': substr(b, 1, j - 1), 'm': n},
      {'a': substr(a, i + n), 'b': substr(b, j + n), 'm': 0}]) AS piece
    FROM (SELECT *, instr(b, substr(a, i, n)) AS j FROM (SELECT *, list_position(l, n) AS i FROM (
      SELECT *, list_max(l) AS n FROM (SELECT block, name, candidate, a, b, list_transform(range(1, length(a) + 1), lambda x:
        list_max(list_transform(range(1, length(a) - x + 2), lambda y: CASE WHEN contains(b, substr(a, x, y)) THEN y ELSE 0 END))) AS l
      FROM blocks WHERE a <> '' AND b <> '') AS p) AS q) AS r WHERE n > 0) AS s) AS t),
scores AS (SELECT block, name, candidate, 2.0::DOUBLE * sum(m) / (length(name) + length(candidate)) AS score
  FROM blocks GROUP BY block, name, candidate),
best AS (SELECT block, name, candidate FROM (SELECT *, row_number() OVER (PARTITION BY block, name ORDER BY score DESC, candidate DESC) AS n
  FROM scores) AS s WHERE n = 1 AND score >= 0.72::DOUBLE),
"""


def _by_ratio(sql: str, **inputs_: str) -> str:
    """FUZZY_SQL with the default similarity in place of the edit distance."""
    start, stop = FUZZY_SQL.index("best AS ("), FUZZY_SQL.index("allowed AS (")
    body = "WITH " + FUZZY_SQL[:start] + RATIO_SQL.strip() + "\n" + FUZZY_SQL[stop:] + sql
    return "WITH RECURSIVE" + with_inputs(body, **{**FUZZY_INPUTS, **inputs_})[4:]


@query("fuzzy_ratio", _by_ratio(" SELECT * FROM matched"))
def fuzzy_ratio(spark, folder):
    return _fuzzy(spark, folder, "ratio")


@query(
    "polygon_names",
    _by_ratio(
        """
SELECT block, name, matched, 'poly_' || match_type AS match_type FROM matched WHERE match_type <> 'unmatched'""",
        aliases=ALIASES + " AND 1 = 0",
    ),
)
def polygon_names(spark, folder):
    tables = {k: derive(spark, folder, v) for k, v in FUZZY_INPUTS.items()}
    return match.polygon_names(tables["left_names"], tables["right_names"], tables["blocked"])


# Cascade inputs: postal codes name districts, some spelled differently from the reference.
CASCADE_CODES = """
SELECT 100000 + s_suppkey AS pincode,
  CASE s_suppkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN replace(lower(n_name), 'nation', 'natin')
    WHEN 2 THEN 'zone ' || CAST(n_nationkey AS STRING) ELSE lower(n_name) || 's' END AS district_norm,
  lower(r_name) AS state_norm,
  6 + CAST(s_suppkey * 3571 % 32000 AS DOUBLE) / 1000 AS pin_centroid_lat,
  68 + CAST(s_suppkey * 4561 % 30000 AS DOUBLE) / 1000 AS pin_centroid_lon
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""
CASCADE_INDICATORS = """
SELECT n_name AS district_name, r_name AS state_ut, lower(n_name) AS district_norm, lower(r_name) AS state_norm
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
"""
CASCADE_FACILITIES = """
SELECT 'C' || CAST(c_custkey AS STRING) AS unique_id,
  CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 900000 + c_custkey ELSE 100000 + c_custkey END AS zip_clean,
  6 + CAST(c_custkey * 7919 % 32000 AS DOUBLE) / 1000 AS latitude,
  68 + CAST(c_custkey * 6101 % 30000 AS DOUBLE) / 1000 AS longitude,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 8 <> 0 END AS coordinates_valid
FROM {customer}
"""
CASCADE_REGIONS = """
SELECT n_name AS region_id, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE lower(n_name) || 'x' END AS district_norm,
  lower(r_name) AS state_norm
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
"""
BEST_LEVENSHTEIN = """(SELECT state_norm, name, candidate FROM (
  SELECT p.state_norm, p.name, c.candidate, 1.0 - CAST(levenshtein(c.candidate, p.name) AS DOUBLE) / greatest(length(c.candidate), length(p.name)) AS score,
    row_number() OVER (PARTITION BY p.state_norm, p.name ORDER BY
      1.0 - CAST(levenshtein(c.candidate, p.name) AS DOUBLE) / greatest(length(c.candidate), length(p.name)) DESC, c.candidate DESC) AS n
  FROM {pending} AS p JOIN {options} AS c ON p.state_norm = c.state_norm) AS s WHERE n = 1 AND score >= CAST(0.72 AS DOUBLE))"""
SPATIAL = HAVERSINE.format(lat1="f.latitude", lon1="f.longitude", lat2="c.pin_centroid_lat", lon2="c.pin_centroid_lon")
CASCADE_SQL = f"""
WITH code_names AS (SELECT DISTINCT state_norm, district_norm AS candidate FROM codes),
ind_names AS (SELECT DISTINCT state_norm, district_norm AS candidate FROM indicators),
pending AS (SELECT DISTINCT i.state_norm, i.district_norm AS name FROM indicators AS i
  WHERE NOT EXISTS (SELECT 1 FROM code_names AS c WHERE c.state_norm = i.state_norm AND c.candidate = i.district_norm)),
close_names AS {BEST_LEVENSHTEIN.format(pending="pending", options="code_names")},
alias AS (SELECT i.state_norm, i.district_norm AS nfhs, c.candidate AS pin, 'exact' AS match_type, 2 AS pref
    FROM indicators AS i JOIN code_names AS c ON c.state_norm = i.state_norm AND c.candidate = i.district_norm
  UNION ALL SELECT state_norm, name, candidate, 'fuzzy', 3 FROM close_names),
directory AS (SELECT pincode, pin_centroid_lat, pin_centroid_lon, district_norm, district_name, state_ut, match_type FROM (
  SELECT c.*, i.district_name, i.state_ut, a.match_type,
    row_number() OVER (PARTITION BY c.pincode ORDER BY coalesce(a.pref, 9), i.district_norm) AS n
  FROM codes AS c LEFT JOIN alias AS a ON c.state_norm = a.state_norm AND c.district_norm = a.pin
  LEFT JOIN indicators AS i ON i.state_norm = a.state_norm AND i.district_norm = a.nfhs) AS d WHERE n = 1),
by_code AS (SELECT f.*, d.district_norm AS pin_district_norm, d.district_name, d.state_ut, coalesce(d.match_type, 'unmatched') AS match_type
  FROM facilities AS f LEFT JOIN directory AS d ON f.zip_clean = d.pincode),
near AS (SELECT unique_id, district_name, state_ut FROM (
  SELECT f.unique_id, c.district_name, c.state_ut, {SPATIAL} AS km,
    row_number() OVER (PARTITION BY f.unique_id ORDER BY {SPATIAL}, c.pincode) AS n
  FROM by_code AS f CROSS JOIN directory AS c WHERE f.district_name IS NULL AND f.coordinates_valid) AS x
  WHERE n = 1 AND km <= 60 AND district_name IS NOT NULL),
step2 AS (SELECT b.unique_id, b.zip_clean, b.pin_district_norm, b.latitude, b.longitude, b.coordinates_valid,
  coalesce(b.district_name, n.district_name) AS district_name, coalesce(b.state_ut, n.state_ut) AS state_ut,
  CASE WHEN b.district_name IS NULL AND n.district_name IS NOT NULL THEN 'spatial_fallback' ELSE b.match_type END AS match_type
  FROM by_code AS b LEFT JOIN near AS n ON b.unique_id = n.unique_id),
inside AS (SELECT unique_id, min(region_id) AS region_id FROM (
  SELECT unique_id, region_id, poly_id FROM step2 JOIN edges
  ON (y1 > latitude) <> (y2 > latitude) AND longitude < (x2 - x1) * (latitude - y1) / (y2 - y1) + x1
  WHERE district_name IS NULL AND coordinates_valid
  GROUP BY unique_id, region_id, poly_id HAVING count(*) % 2 = 1) AS i GROUP BY unique_id),
poly_pending AS (SELECT DISTINCT r.state_norm, r.district_norm AS name FROM regions AS r
  WHERE NOT EXISTS (SELECT 1 FROM ind_names AS c WHERE c.state_norm = r.state_norm AND c.candidate = r.district_norm)),
poly_close AS {BEST_LEVENSHTEIN.format(pending="poly_pending", options="ind_names")},
poly_names AS (SELECT r.region_id, i.district_name, i.state_ut, 'poly_exact' AS match_type FROM regions AS r
    JOIN indicators AS i ON i.state_norm = r.state_norm AND i.district_norm = r.district_norm
  UNION ALL SELECT r.region_id, i.district_name, i.state_ut, 'poly_fuzzy' FROM regions AS r
    JOIN poly_close AS p ON p.state_norm = r.state_norm AND p.name = r.district_norm
    JOIN indicators AS i ON i.state_norm = p.state_norm AND i.district_norm = p.candidate),
final AS (SELECT s.unique_id, s.zip_clean, s.pin_district_norm, s.coordinates_valid,
  coalesce(s.district_name, p.district_name) AS nfhs_district_name, coalesce(s.state_ut, p.state_ut) AS nfhs_state_ut,
  CASE WHEN s.district_name IS NULL AND p.district_name IS NOT NULL THEN p.match_type ELSE s.match_type END AS district_match_type
  FROM step2 AS s LEFT JOIN inside AS i ON s.unique_id = i.unique_id LEFT JOIN poly_names AS p ON i.region_id = p.region_id)
"""
CASCADE_INPUTS = {
    "codes": CASCADE_CODES, "indicators": CASCADE_INDICATORS, "facilities": CASCADE_FACILITIES,
    "regions": CASCADE_REGIONS, "edges": inputs.POLYGON_EDGES,
}


def cascade(spark, folder):
    t = {k: derive(spark, folder, v) for k, v in CASCADE_INPUTS.items()}
    aliases = resolve.district_aliases(t["indicators"], t["codes"], method="levenshtein")
    codes = resolve.resolved_codes(t["codes"], aliases, t["indicators"])
    by_code = resolve.resolve_by_code(t["facilities"], codes)
    return resolve.resolve(
        by_code,
        [
            resolve.nearest_stage(codes, km=60.0),
            resolve.polygon_stage(t["edges"], t["regions"], t["indicators"], method="levenshtein"),
        ],
    )


@query(
    "resolve_cascade",
    with_inputs(
        CASCADE_SQL + """
SELECT unique_id, zip_clean, nfhs_district_name, nfhs_state_ut, district_match_type,
  nfhs_district_name IS NOT NULL AS district_resolved FROM final""",
        **CASCADE_INPUTS,
    ),
)
def resolve_cascade(spark, folder):
    return cascade(spark, folder).select(
        "unique_id", "zip_clean", "nfhs_district_name", "nfhs_state_ut", "district_match_type", "district_resolved"
    )


@query(
    "resolution_rate",
    with_inputs(
        CASCADE_SQL + """
SELECT district_match_type, count(*) AS total,
  CAST(count(nfhs_district_name) AS BIGINT) AS resolved,
  round(CAST(count(nfhs_district_name) AS DOUBLE) / count(*), 2) AS resolution_rate
FROM final GROUP BY district_match_type""",
        **CASCADE_INPUTS,
    ),
)
def resolution_rate(spark, folder):
    return resolve.rate_by(cascade(spark, folder), "district_match_type", "district_resolved")


@query(
    "resolution_funnel",
    with_inputs(
        CASCADE_SQL + """
SELECT count(*) AS total, count(*) FILTER (WHERE NOT coordinates_valid) AS invalid_coordinates,
  count(nfhs_district_name) AS resolved, count(*) FILTER (WHERE pin_district_norm IS NULL) AS no_code_match,
  count(*) FILTER (WHERE pin_district_norm IS NULL AND zip_clean IS NULL) AS no_code,
  count(*) FILTER (WHERE pin_district_norm IS NULL AND zip_clean IS NOT NULL) AS code_not_in_directory
FROM final""",
        **CASCADE_INPUTS,
    ),
)
def resolution_funnel(spark, folder):
    return resolve.funnel(cascade(spark, folder))


# Boundary documents: one per supplier, a box at its own place cut into two arcs, the
# second arc walked backwards, with a scale and a shift; a triangular hole in every other.
def _places(spark, folder):
    place = F.col("s_suppkey")
    return load_table(spark, folder, "supplier").select(
        F.concat(F.lit("d"), place.cast("string")).alias("doc_id"),
        "s_name",
        (place % 25 + 1).alias("x"),
        (place % 17 + 1).alias("y"),
        (place % 2 == 0).alias("hole"),
    )


TOPO_CORNERS = "(VALUES (0, 0, 0, 0, 10, 0), (0, 1, 10, 0, 10, 10), (0, 2, 10, 10, 0, 10), (0, 3, 0, 10, 0, 0), (1, 0, 4, 4, 4, 6), (1, 1, 4, 6, 6, 6), (1, 2, 6, 6, 4, 4)) AS c(ring_id, seq, ax, ay, zx, zy)"


@query(
    "topojson_edges",
    f"""
SELECT s_name AS region_name, 'all' AS parent_name, 0 AS poly_id, ring_id, seq,
  ((s_suppkey % 25 + 1) * 10 + ax) / 2 + 68 AS x1, ((s_suppkey % 17 + 1) * 10 + ay) / 4 + 6 AS y1,
  ((s_suppkey % 25 + 1) * 10 + zx) / 2 + 68 AS x2, ((s_suppkey % 17 + 1) * 10 + zy) / 4 + 6 AS y2
FROM supplier CROSS JOIN {TOPO_CORNERS} WHERE ring_id = 0 OR s_suppkey % 2 = 0""",
)
def topojson_edges(spark, folder):
    from groundcover.sources.boundaries import topojson_edges

    json = F.format_string(
        '{"transform":{"scale":[0.5,0.25],"translate":[68,6]},'
        '"arcs":[[[%d0,%d0],[10,0],[0,10]],[[%d0,%d0],[0,10],[10,0]],[[%d4,%d4],[0,2],[2,0],[-2,-2]]],'
        '"objects":{"o":{"geometries":[{"type":"Polygon","arcs":[[0,-2]%s],'
        '"properties":{"district":"%s","st_nm":"all"}},'
        '{"type":"Polygon","arcs":[],"properties":{"district":"empty","st_nm":"all"}}]}}}',
        *[F.col(c) for c in ("x", "y", "x", "y", "x", "y")],
        F.when(F.col("hole"), ",[2]").otherwise(""),
        F.col("s_name"),
    )
    docs = _places(spark, folder).select("doc_id", json.alias("json"))
    return topojson_edges(docs).drop("doc_id", "region_id")


@query(
    "geojson_edges",
    f"""
SELECT s_name AS region_name, CAST(NULL AS VARCHAR) AS parent_name, poly_id, ring_id, seq,
  CAST((s_suppkey % 25 + 1) * 10 + ax + 100 * poly_id AS DOUBLE) AS x1, CAST((s_suppkey % 17 + 1) * 10 + ay AS DOUBLE) AS y1,
  CAST((s_suppkey % 25 + 1) * 10 + zx + 100 * poly_id AS DOUBLE) AS x2, CAST((s_suppkey % 17 + 1) * 10 + zy AS DOUBLE) AS y2
FROM supplier CROSS JOIN {TOPO_CORNERS} CROSS JOIN (VALUES (0), (1)) AS p(poly_id)
WHERE (s_suppkey % 2 = 0) OR (ring_id = 0 AND poly_id = 0)""",
)
def geojson_edges(spark, folder):
    from groundcover.sources.boundaries import geojson_edges

    def ring(shift, corners):
        points = [
            F.format_string("[%d,%d]", F.col("x") * 10 + shift + dx, F.col("y") * 10 + dy) for dx, dy in corners
        ]
        return F.concat(F.lit("["), F.concat_ws(",", *points), F.lit("]"))

    shell = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    hole = [(4, 4), (4, 6), (6, 6), (4, 4)]
    both = [F.concat(F.lit("["), ring(s, shell), F.lit(","), ring(s, hole), F.lit("]")) for s in (0, 100)]
    simple = F.concat(F.lit('"Polygon","coordinates":['), ring(0, shell), F.lit("]"))
    multi = F.concat(F.lit('"MultiPolygon","coordinates":['), F.concat_ws(",", *both), F.lit("]"))
    json = F.concat(
        F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"shapeName":"'),
        F.col("s_name"),
        F.lit('"},"geometry":{"type":'),
        F.when(F.col("hole"), multi).otherwise(simple),
        F.lit("}}]}"),
    )
    docs = _places(spark, folder).select("doc_id", json.alias("json"))
    return geojson_edges(docs).drop("doc_id", "region_id")




# One region per supplier, of eight kinds: a box with a hole; a hole outside its shell; a hole in a hole; a polygon within
# another; an island in the lake of another; two overlapping polygons; crossing edges; two boxes that touch.
SHAPES = [
    "[[[0,0],[9,0],[9,9],[0,9],[0,0]],[[2,2],[2,4],[4,4],[2,2]]]",
    "[[[0,0],[9,0],[9,9],[0,9],[0,0]],[[12,2],[12,4],[14,4],[12,2]]]",
    "[[[0,0],[9,0],[9,9],[0,9],[0,0]],[[1,1],[1,8],[8,8],[8,1],[1,1]],[[2,2],[2,4],[4,4],[2,2]]]",
    "[[[0,0],[9,0],[9,9],[0,9],[0,0]]],[[[2,2],[4,2],[4,4],[2,2]]]",
    "[[[0,0],[9,0],[9,9],[0,9],[0,0]],[[1,1],[1,8],[8,8],[8,1],[1,1]]],[[[2,2],[4,2],[4,4],[2,2]]]",
    "[[[0,0],[9,0],[9,9],[0,9],[0,0]]],[[[5,0],[14,0],[14,9],[5,9],[5,0]]]",
    "[[[0,0],[9,9],[9,0],[0,9],[0,0]]]",
    "[[[0,0],[9,0],[9,9],[0,9],[0,0]]],[[[9,0],[14,0],[14,9],[9,9],[9,0]]]",
]
VALID_SHAPES = (0, 4, 7)


@query(
    "valid_regions",
    f"""
SELECT s_name AS region_name, s_suppkey % {len(SHAPES)} AS kind,
  CAST(CASE s_suppkey % {len(SHAPES)} WHEN 0 THEN 7 WHEN 4 THEN 11 ELSE 8 END AS BIGINT) AS edges
FROM supplier WHERE s_suppkey % {len(SHAPES)} IN {VALID_SHAPES}""",
)
def valid_regions(spark, folder):
    from groundcover.session import materialize
    from groundcover.sources.boundaries import geojson_edges, valid_regions

    kind = F.col("s_suppkey") % len(SHAPES)
    shape = F.array(*[F.lit(s) for s in SHAPES])[kind.cast("int")]
    several = shape.startswith("[[[") & shape.contains("]]],[[[")
    json = F.concat(
        F.lit('{"type":"Feature","properties":{"shapeName":"'), F.col("s_name"), F.lit('"},"geometry":{"type":'),
        F.when(several, F.concat(F.lit('"MultiPolygon","coordinates":['), shape, F.lit("]")))
        .otherwise(F.concat(F.lit('"Polygon","coordinates":'), shape)), F.lit("}}"),
    )
    suppliers = load_table(spark, folder, "supplier")
    docs = suppliers.select(F.col("s_suppkey").cast("string").alias("doc_id"), json.alias("json"))
    edges = materialize(geojson_edges(docs), "edges")
    return valid_regions(edges).groupBy("doc_id", "region_name").agg(F.count(F.lit(1)).alias("edges")).select(
        "region_name", (F.col("doc_id").cast("long") % len(SHAPES)).alias("kind"), "edges"
    )
