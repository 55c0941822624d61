"""Name matching and spatial operators against brute force."""

import difflib
import json
import math
import random

import pytest

from groundcover.operators import geo, match, resolve
from groundcover.sources import boundaries

CUTOFF = 0.72


def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _ratio(method, candidate, name):
    if method == "ratio":
        return difflib.SequenceMatcher(None, candidate, name).ratio()
    return 1 - _lev(candidate, name) / max(len(candidate), len(name))


@pytest.mark.parametrize("method", ["ratio", "levenshtein"])
def test_no_similar_pair_is_missed(spark, method):
    random.seed(11)
    words = ["nagar", "pur", "bad", "east", "west", "north", "garh", "zé", "kot "]
    def make():
        return "".join(random.choice(words) for _ in range(random.randrange(1, 4))).strip()
    left = {(random.choice("AB"), make()) for _ in range(60)} | {("A", "x")}
    right = {(random.choice("AB"), make()) for _ in range(60)}
    got = match.similar_pairs(
        spark.createDataFrame(sorted(left), "block string, name string"),
        spark.createDataFrame(sorted(right), "block string, candidate string"), CUTOFF, method)
    pairs = {tuple(r)[:3] for r in got.collect()}
    needed = {(b, n, c) for b, n in left for b2, c in right if b == b2 and _ratio(method, c, n) >= CUTOFF}
    assert needed and needed <= pairs
    assert len(pairs) < sum(b == b2 for b, _ in left for b2, _ in right)


@pytest.mark.parametrize("method", ["ratio", "levenshtein"])
def test_fuzzy_resolve_order(spark, method):
    left = spark.createDataFrame(
        [("s", "bangalore"), ("s", "mysore"), ("s", "belgaum"), ("s", "hassann"), ("s", "blocked nagar"),
         ("s", "qqqq"), ("t", "hassann"), ("empty", "hassan")], "block string, name string")
    right = spark.createDataFrame(
        [("s", "bengaluru urban"), ("s", "bangalore"), ("s", "belgaum"), ("s", "hassan"), ("s", "blockod nagar"),
         ("s", "blocked naga"), ("t", "other")], "block string, candidate string")
    alias = {("s", "bangalore"): "bengaluru urban", ("s", "mysore"): "mysuru"}
    winner = max(["blockod nagar", "blocked naga"], key=lambda c: (_ratio(method, c, "blocked nagar"), c))
    got = match.fuzzy_resolve(left, right, alias, [("s", "blocked nagar", winner)], method=method)
    found = {(r["block"], r["name"]): (r["matched"], r["match_type"]) for r in got.collect()}
    assert found == {
        ("s", "bangalore"): ("bengaluru urban", "known_alias"),  # outranks the exact name
        ("s", "mysore"): (None, "unmatched"),  # alias target missing
        ("s", "belgaum"): ("belgaum", "exact"),
        ("s", "hassann"): ("hassan", "fuzzy"),
        ("s", "blocked nagar"): (None, "unmatched"),  # no runner-up
        ("s", "qqqq"): (None, "unmatched"),
        ("t", "hassann"): (None, "unmatched"),  # never across blocks
    }


def test_fuzzy_ties_take_the_greatest_name(spark):
    left = spark.createDataFrame([("s", "abcdef")], "block string, name string")
    right = spark.createDataFrame([("s", "abcdex"), ("s", "abcdey")], "block string, candidate string")
    assert match.fuzzy_resolve(left, right).first()["matched"] == "abcdey"


def _km(a, b):
    lat1, lon1, lat2, lon2 = map(math.radians, (*a, *b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


@pytest.mark.parametrize("box", [(6, 38, 68, 98), (-89.9, 89.9, -180, 180), (80, 89.99, 170, 180)])
def test_nearest_equals_brute_force(spark, box):
    random.seed(13)
    def place(i):
        lon = random.uniform(box[2], box[3])
        return (i, random.uniform(box[0], box[1]), -lon if i % 5 == 0 and box[3] == 180 else lon)
    points = [place(i) for i in range(150)] + [(900, None, 70.0)]
    centroids = [place(i) for i in range(120)] + [(500, 20.0, 75.0), (501, 20.0, 75.0), (502, None, 75.0)]
    points.append((901, 20.001, 75.0))
    km = 25.0 if box[0] == 6 else 400.0
    got = geo.nearest_within(
        spark.createDataFrame(points, "unique_id int, latitude double, longitude double"),
        spark.createDataFrame(centroids, "pincode int, pin_centroid_lat double, pin_centroid_lon double"), km)
    found = {r["unique_id"]: r["pincode"] for r in got.collect()}
    expected = {}
    for p, lat, lon in points:
        if lat is None:
            continue
        best = min((_km((lat, lon), (c[1], c[2])), c[0]) for c in centroids if c[1] is not None)
        if best[0] <= km:
            expected[p] = best[1]
    assert found == expected and expected


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]
HOLE = [(4, 4), (6, 4), (6, 6), (4, 6)]


def _edges(region, poly, ring, points):
    return [(region, poly, ring, i, *map(float, (*p, *points[(i + 1) % len(points)]))) for i, p in enumerate(points)]


def test_points_in_polygons(spark):
    edges = spark.createDataFrame(
        _edges("a", 0, 0, SQUARE) + _edges("a", 0, 1, HOLE) + _edges("b", 0, 0, [(4.5, 4.5), (5.5, 4.5), (5, 5.5)])
        + _edges("b", 1, 0, [(20, 20), (21, 20), (21, 21), (20, 21)]) + _edges("z", 0, 0, SQUARE),
        "region_id string, poly_id int, ring_id int, seq int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame(
        [("shell", 1.0, 1.0), ("hole", 4.1, 4.1), ("island", 5.0, 5.0), ("second part", 20.5, 20.5),
         ("outside", -1.0, 5.0), ("far", 99.0, 99.0), ("low edge", 2.0, 0.0), ("high edge", 2.0, 10.0)],
        "unique_id string, longitude double, latitude double")
    found = {r[0]: r[1] for r in geo.points_in_polygons(points, edges).collect()}
    assert found == {"shell": "a", "hole": "z", "island": "b", "second part": "b", "low edge": "a"}
    box = geo.region_bbox(edges, ["b"]).first()
    assert tuple(box) == (4.5, 4.5, 21.0, 21.0)


def test_topojson_shared_arc_and_invalid_rings(spark, tmp_path):
    topology = {
        "transform": {"scale": [0.5, 2], "translate": [10, 20]},
        "arcs": [[[0, 0], [0, 4]], [[0, 4], [-4, 0], [0, -4], [4, 0]], [[0, 4], [4, 0], [0, -4], [-4, 0]], [[1, 1], [1, 1]],
                 [[0, 0], [4, 4], [0, -4], [-4, 4], [0, -4]]],
        "objects": {"d": {"geometries": [
            {"type": "Polygon", "arcs": [[0, 1]], "properties": {"district": " West  Side", "st_nm": "S"}},
            {"type": "MultiPolygon", "arcs": [[[-1, -3]]], "properties": {"district": "East", "st_nm": "S"}},
            {"type": "Polygon", "arcs": [[3]], "properties": {"district": "line", "st_nm": "S"}},
            {"type": "Polygon", "arcs": [[4]], "properties": {"district": "bow tie", "st_nm": "S"}},
            {"type": "Polygon", "arcs": [], "properties": {"district": "none", "st_nm": "S"}}]}}}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(topology, indent=1))
    edges = boundaries.load_topojson(spark, str(path))
    sides = {r[0]: r[1] for r in edges.groupBy("region_name").count().collect()}
    assert sides == {" West  Side": 4, "East": 4}
    spot = spark.createDataFrame([("w", 9.0, 24.0), ("e", 11.0, 24.0)], "unique_id string, longitude double, latitude double")
    inside = geo.points_in_polygons(spot, edges).join(boundaries.region_names(edges), "region_id")
    assert {r["unique_id"]: r["district_norm"] for r in inside.collect()} == {"w": "west side", "e": "east"}


def test_geojson_files_and_lines(spark, tmp_path):
    feature = {"type": "Feature", "properties": {"shapeName": "A"},
               "geometry": {"type": "Polygon", "coordinates": [[*SQUARE, SQUARE[0]]]}}
    (tmp_path / "one.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature, feature]}))
    assert boundaries.load_geojson(spark, str(tmp_path / "one.json")).count() == 8
    (tmp_path / "lines.json").write_text(json.dumps(feature) + "\n" + json.dumps(feature) + "\n")
    lines = boundaries.load_geojson(spark, str(tmp_path / "lines.json"), per_line=True)
    assert lines.count() == 8 and lines.select("region_id").distinct().count() == 2


def test_cascade_keeps_rows_and_fills_name_with_state(spark):
    indicators = spark.createDataFrame(
        [("Alpha", "S", "alpha", "s"), ("Beta", "S", "beta", "s"), ("Gamma", "S", "gamma", "s")],
        "district_name string, state_ut string, district_norm string, state_norm string")
    codes = spark.createDataFrame(
        [(1, "alpha", "s", 10.0, 70.0), (2, "betta", "s", 20.0, 80.0), (3, "nowhere", "s", 30.0, 90.0)],
        "pincode long, district_norm string, state_norm string, pin_centroid_lat double, pin_centroid_lon double")
    facilities = spark.createDataFrame(
        [("code", 1, 0.0, 0.0, True), ("fuzzy", 2, 0.0, 0.0, True), ("near", None, 10.1, 70.0, True),
         ("bad place", None, 10.1, 70.0, False), ("unknown place", None, 10.1, 70.0, None),
         ("poly", 3, 5.5, 95.5, True), ("lost", 99, 0.0, 0.0, True)],
        "unique_id string, zip_clean long, latitude double, longitude double, coordinates_valid boolean")
    edges = spark.createDataFrame(
        _edges("r1", 0, 0, [(95, 5), (96, 5), (96, 6), (95, 6)]),
        "region_id string, poly_id int, ring_id int, seq int, x1 double, y1 double, x2 double, y2 double")
    regions = spark.createDataFrame([("r1", "gama", "s")], "region_id string, district_norm string, state_norm string")
    aliases = resolve.district_aliases(indicators, codes)
    directory = resolve.resolved_codes(codes, aliases, indicators)
    out = resolve.resolve(
        resolve.resolve_by_code(facilities, directory),
        [resolve.nearest_stage(directory), resolve.polygon_stage(edges, regions, indicators)])
    got = {r["unique_id"]: (r["nfhs_district_name"], r["nfhs_state_ut"], r["district_match_type"], r["district_resolved"])
           for r in out.collect()}
    none = (None, None, "unmatched", False)
    assert got == {
        "code": ("Alpha", "S", "exact", True), "fuzzy": ("Beta", "S", "fuzzy", True),
        "near": ("Alpha", "S", "spatial_fallback", True), "bad place": none, "unknown place": none,
        "poly": ("Gamma", "S", "poly_fuzzy", True), "lost": none}
    counters = resolve.funnel(out).first().asDict()
    assert counters == {"total": 7, "invalid_coordinates": 1, "resolved": 4, "no_code_match": 4, "no_code": 3,
                        "code_not_in_directory": 1}
