import math
import random
import time

import pytest

from groundcover.operators import geo
from groundcover.plans import cells

EDGES = "region_id string, poly_id int, ring_id int, seq int, x1 double, y1 double, x2 double, y2 double"


def ring(region, poly, ring_id, corners):
    return [
        (region, poly, ring_id, i, *map(float, a), *map(float, b))
        for i, (a, b) in enumerate(zip(corners, [*corners[1:], corners[0]]))
    ]


def star(x, y, radius, n, seed):
    rng = random.Random(seed)
    return [
        (x + radius * rng.uniform(0.4, 1) * math.cos(2 * math.pi * i / n), y + radius * rng.uniform(0.4, 1) * math.sin(2 * math.pi * i / n))
        for i in range(n)
    ]


def brute(points, edges):
    """The smallest region a point is in, by counting all crossings."""
    polygons = {}
    for e in edges:
        polygons.setdefault((e[0], e[1]), []).append(e[4:])
    out = {}
    for i, x, y in points:
        for (region, _), lines in sorted(polygons.items()):
            odd = sum(
                (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in lines
            ) % 2
            if odd:
                out[i] = min(out.get(i, region), region)
    return out


def found(spark, points, edges, **options):
    got = geo.points_in_polygons(
        spark.createDataFrame(points, "unique_id int, longitude double, latitude double"), spark.createDataFrame(edges, EDGES), **options
    )
    return dict(map(tuple, got.collect()))


@pytest.mark.parametrize("leaf_edges", [64, 3])
def test_random_polygons_with_holes_against_brute_force(spark, leaf_edges):
    rng = random.Random(1)
    edges = []
    for n in range(12):
        x, y, radius = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0.01, 1, 10, 60])
        edges += ring(f"r{n}", 0, 0, star(x, y, radius, rng.choice([3, 10, 300]), n))
        edges += ring(f"r{n}", 0, 1, star(x, y, radius * 0.3, 7, 100 + n))
        edges += ring(f"r{n}", 1, 0, star(x + 2 * radius, y, radius, 5, 200 + n))
    vertices = [(e[4], e[5]) for e in edges]
    spots = [(rng.uniform(-120, 120), rng.uniform(-120, 120)) for _ in range(800)]
    spots += [(x + rng.gauss(0, 0.01), y + rng.gauss(0, 0.01)) for x, y in rng.choices(vertices, k=800)]
    points = [(i, x, y) for i, (x, y) in enumerate(spots)]
    assert found(spark, points, edges, leaf_edges=leaf_edges) == brute(points, edges)


@pytest.mark.parametrize("leaf_edges", [64, 2])
def test_points_on_vertices_edges_and_a_lattice(spark, leaf_edges):
    """Boxes, stairs and a diamond on whole numbers, points on the same whole and half numbers: every tie as with the ray."""
    edges = ring("a", 0, 0, [(0, 0), (8, 0), (8, 8), (0, 8)]) + ring("a", 0, 1, [(2, 2), (2, 4), (4, 4), (4, 2)])
    edges += ring("b", 0, 0, [(8, 0), (16, 0), (16, 4), (12, 4), (12, 8), (8, 8)]) + ring("c", 0, 0, [(4, 8), (8, 12), (4, 16), (0, 12)])
    points = [(i * 100 + j, i / 2, j / 2) for i in range(-2, 40) for j in range(-2, 40)]
    assert found(spark, points, edges, leaf_edges=leaf_edges) == brute(points, edges)


def test_repeated_points_missing_values_and_no_edges(spark):
    edges = ring("a", 0, 0, [(0, 0), (8, 0), (8, 8), (0, 8)])
    points = [(1, 4.0, 4.0), (1, 4.0, 4.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, 9.0, 9.0), (5, float("inf"), 1.0)]
    assert found(spark, points, edges) == {1: "a"}
    assert found(spark, points, []) == {}
    assert found(spark, [], edges) == {}


def test_a_very_wide_polygon_needs_few_cells(spark):
    """5,000,000 units wide beside one of a unit: no cell per unit."""
    wide = ring("wide", 0, 0, star(0, 0, 2_500_000, 2000, 1))
    small = ring("small", 0, 0, star(100.0, 100.0, 1, 200, 2))
    rng = random.Random(2)
    points = [(i, rng.uniform(-3e6, 3e6), rng.uniform(-3e6, 3e6)) for i in range(500)]
    points += [(1000 + i, 100 + rng.uniform(-1, 1), 100 + rng.uniform(-1, 1)) for i in range(200)]
    found(spark, points[:1], wide)
    started = time.time()
    assert found(spark, points, wide + small) == brute(points, wide + small)
    assert time.time() - started < 60
    shapes = cells.cover(spark.createDataFrame(wide + small, EDGES), ["region_id", "poly_id"])
    assert shapes.cells.count() < 100 * len(wide + small)
    most = shapes.edges.groupBy("level", "cx", "cy", "shape").count().agg({"count": "max"}).first()[0]
    assert most <= cells.LEAF_EDGES


def test_crossing_edges_on_a_dense_coast(spark):
    """100,000 edges within a quarter of a unit, beside long ones; only the region with a crossing goes."""
    from groundcover.sources import boundaries

    def coast(region, crossed):
        n = 100_000
        corners = [(0.25 * i / n, (i * 7919 % 13) * 1e-9) for i in range(n)]
        if crossed:
            corners[n // 2] = (corners[n // 2 - 5][0], 1e-6)
            corners[n // 2 - 3] = (corners[n // 2 - 3][0], 2e-6)
        return ring(region, 0, 0, [*corners, (0.25, -5.0), (0.0, -5.0)])

    edges = spark.createDataFrame(coast("good", False) + coast("bad", True), EDGES).repartition(8)
    found(spark, [(1, 0.0, 0.0)], ring("a", 0, 0, [(0, 0), (8, 0), (8, 8)]))
    started = time.time()
    assert [r[0] for r in boundaries.drop_crossing(edges).select("region_id").distinct().collect()] == ["good"]
    assert time.time() - started < 40


def test_rings_must_be_nested(spark):
    from groundcover.sources import boundaries

    def box(a, b, size):
        return [(a, b), (a + size, b), (a + size, b + size), (a, b + size)]

    shapes = {
        "hole": ring("hole", 0, 0, box(0, 0, 9)) + ring("hole", 0, 1, box(2, 2, 2)),
        "touching hole": ring("touching hole", 0, 0, box(0, 0, 9)) + ring("touching hole", 0, 1, [(0, 4), (3, 3), (3, 5)]),
        "two holes": ring("two holes", 0, 0, box(0, 0, 9)) + ring("two holes", 0, 1, box(1, 1, 2)) + ring("two holes", 0, 2, box(4, 4, 2)),
        "island": ring("island", 0, 0, box(0, 0, 9)) + ring("island", 0, 1, box(1, 1, 7)) + ring("island", 1, 0, box(2, 2, 3)),
        "neighbours": ring("neighbours", 0, 0, box(0, 0, 4)) + ring("neighbours", 1, 0, box(6, 0, 4)),
        "single": ring("single", 0, 0, box(0, 0, 4)),
        "hole outside": ring("hole outside", 0, 0, box(0, 0, 9)) + ring("hole outside", 0, 1, box(20, 2, 2)),
        "hole around": ring("hole around", 0, 0, box(0, 0, 9)) + ring("hole around", 0, 1, box(-2, -2, 20)),
        "hole equal": ring("hole equal", 0, 0, box(0, 0, 9)) + ring("hole equal", 0, 1, box(0, 0, 9)),
        "holes nested": ring("holes nested", 0, 0, box(0, 0, 9)) + ring("holes nested", 0, 1, box(1, 1, 6)) + ring("holes nested", 0, 2, box(2, 2, 2)),
        "holes equal": ring("holes equal", 0, 0, box(0, 0, 9)) + ring("holes equal", 0, 1, box(1, 1, 6)) + ring("holes equal", 0, 2, box(1, 1, 6)),
        "shells nested": ring("shells nested", 0, 0, box(0, 0, 9)) + ring("shells nested", 1, 0, box(2, 2, 2)),
        "shells equal": ring("shells equal", 0, 0, box(0, 0, 9)) + ring("shells equal", 1, 0, box(0, 0, 9)),
        "shells overlap": ring("shells overlap", 0, 0, box(0, 0, 9)) + ring("shells overlap", 1, 0, [(5, 0), (14, 0), (14, 9), (5, 9)]),
        "island over shore": ring("island over shore", 0, 0, box(0, 0, 9)) + ring("island over shore", 0, 1, box(4, 4, 2)) + ring("island over shore", 1, 0, box(3, 3, 4)),
    }
    edges = spark.createDataFrame(sum(shapes.values(), []), EDGES)
    kept = boundaries.drop_misnested(edges)
    assert kept.columns == edges.columns
    names = {r["region_id"] for r in kept.select("region_id").distinct().collect()}
    assert names == {"hole", "touching hole", "two holes", "island", "neighbours", "single"}
    assert boundaries.drop_misnested(edges.limit(0)).collect() == []


def test_boxes_of_few_edges_send_nothing_to_the_driver(spark):
    """Rows of like boxes: small files, many cells within. No side is broadcast, and cells are not listed."""
    from groundcover.session import materialize
    from groundcover.sources import boundaries

    def box(a, b, size):
        return [(a, b), (a + size, b), (a + size, b + size), (a, b + size)]

    some = sum((ring(f"r{n}", 0, 0, box(0, 0, 9)) + ring(f"r{n}", 0, 1, box(2 + n % 2 * 20, 2, 2)) for n in range(40)), [])
    edges = materialize(spark.createDataFrame(some, EDGES), "edges")
    shapes = cells.cover(edges, ["region_id", "poly_id", "ring_id"])
    assert shapes.cells.count() <= cells.FAN * 80
    points = edges.selectExpr("region_id", "struct(region_id, ring_id, seq) AS _pid", "(x1 + x2) / 2 AS _x", "(y1 + y2) / 2 AS _y")
    found = cells.locate(points, shapes, ["region_id"])
    assert found.where("NOT `on` AND inside AND _pid.ring_id = 1 AND shape.ring_id = 0").count() == 20 * 4
    kept = boundaries.drop_misnested(edges)
    for each in (found, kept):
        assert "Broadcast" not in each._jdf.queryExecution().executedPlan().toString()
    assert {r[0] for r in kept.select("region_id").distinct().collect()} == {f"r{n}" for n in range(0, 40, 2)}
