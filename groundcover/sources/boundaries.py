"""Boundary files to polygon edges.

Both formats end in the same table: (doc_id, region_id, region_name, parent_name,
poly_id, ring_id, seq, x1, y1, x2, y2), one row per edge. Ring 0 is the shell, the
others are holes. Documents are rows of (doc_id, json), so many files or many documents
in one file are decoded side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundcover.functions.names import norm_name
from groundcover.plans.cells import cover, locate, merged, x_at
from groundcover.session import materialize

EDGE_COLUMNS = [
    "doc_id", "region_id", "region_name", "parent_name", "poly_id", "ring_id", "seq",
    "x1", "y1", "x2", "y2",
]

TOPOLOGY = """
  transform struct<scale: array<double>, translate: array<double>>,
  arcs array<array<array<double>>>,
  objects map<string, struct<geometries: array<struct<
    type: string, arcs: string, properties: map<string, string>>>>>
"""
FEATURES = """
  type string, geometry struct<type: string, coordinates: string>,
  properties map<string, string>,
  features array<struct<
    geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>
"""


def documents(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """One document per file, or one per line of newline-delimited files."""
    text = spark.read.text(path, wholetext=not per_line)
    if not per_line:
        return text.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("json"))
    numbered = text.select(
        F.monotonically_increasing_id().cast("string").alias("doc_id"), F.col("value").alias("json")
    )
    return materialize(numbered, "documents")  # the numbers must not change between reads


def load_topojson(
    spark: SparkSession, path: str, name_prop: str = "district", parent_prop: str = "st_nm", per_line: bool = False
) -> DataFrame:
    return valid_regions(materialize(topojson_edges(documents(spark, path, per_line), name_prop, parent_prop), "edges"))


def load_geojson(
    spark: SparkSession, path: str, name_prop: str = "shapeName", parent_prop: str | None = None, per_line: bool = False
) -> DataFrame:
    return valid_regions(materialize(geojson_edges(documents(spark, path, per_line), name_prop, parent_prop), "edges"))


def _polygons(kind: Column, nested: Column, item: str) -> Column:
    """Polygons → rings → items, whatever the nesting depth of the geometry type."""
    return F.when(
        kind == "Polygon", F.array(F.from_json(nested, f"array<array<{item}>>"))
    ).when(kind == "MultiPolygon", F.from_json(nested, f"array<array<array<{item}>>>"))


def topojson_edges(docs: DataFrame, name_prop: str = "district", parent_prop: str = "st_nm") -> DataFrame:
    """Decodes arcs (deltas, scale, translation), stitches rings and returns their edges.

    A negative arc index is the arc `~index` walked backwards. All objects of a document
    are read. Without a transform coordinates stand as they are.
    """
    parsed = docs.select("doc_id", F.from_json("json", TOPOLOGY).alias("t"))
    scale = F.coalesce(F.col("t.transform.scale"), F.array(F.lit(1.0), F.lit(1.0)))
    shift = F.coalesce(F.col("t.transform.translate"), F.array(F.lit(0.0), F.lit(0.0)))
    steps = parsed.select(
        "doc_id", scale.alias("scale"), shift.alias("shift"), F.posexplode("t.arcs").alias("arc", "points")
    ).select("doc_id", "scale", "shift", "arc", F.posexplode("points").alias("at", "d"))
    walked = Window.partitionBy("doc_id", "arc").orderBy("at")
    points = steps.select(
        "doc_id",
        "arc",
        "at",
        (F.sum(F.col("d")[0]).over(walked) * F.col("scale")[0] + F.col("shift")[0]).alias("x"),
        (F.sum(F.col("d")[1]).over(walked) * F.col("scale")[1] + F.col("shift")[1]).alias("y"),
    )

    geometries = F.filter(F.transform(F.map_values("t.objects"), lambda o: o["geometries"]), lambda g: g.isNotNull())
    shapes = parsed.select("doc_id", F.posexplode(F.flatten(geometries)).alias("shape", "g"))  # of all objects
    rings = (
        shapes.select(
            "doc_id",
            "shape",
            F.col("g.properties")[name_prop].alias("region_name"),
            F.col("g.properties")[parent_prop].alias("parent_name"),
            F.posexplode(_polygons(F.col("g.type"), F.col("g.arcs"), "int")).alias("poly_id", "p"),
        )
        .select("doc_id", "shape", "region_name", "parent_name", "poly_id", F.posexplode("p").alias("ring_id", "r"))
        .select(
            "doc_id", "shape", "region_name", "parent_name", "poly_id", "ring_id",
            F.posexplode("r").alias("piece", "index"),
        )
    )
    backwards = F.col("index") < 0
    rings = rings.withColumn("arc", F.when(backwards, -F.col("index") - 1).otherwise(F.col("index")))
    stitched = rings.join(points, ["doc_id", "arc"]).withColumn(
        "step", F.when(backwards, -F.col("at")).otherwise(F.col("at"))
    )
    return _edges(stitched, ["piece", "step"])


def geojson_edges(docs: DataFrame, name_prop: str = "shapeName", parent_prop: str | None = None) -> DataFrame:
    """Edges of a feature collection, or of single features, one per document."""
    parsed = docs.select("doc_id", F.from_json("json", FEATURES).alias("t"))
    alone = F.array(F.struct(F.col("t.geometry").alias("geometry"), F.col("t.properties").alias("properties")))
    shapes = parsed.select(
        "doc_id", F.posexplode(F.coalesce(F.col("t.features"), alone)).alias("shape", "f")
    )
    parent = F.col("f.properties")[parent_prop] if parent_prop else F.lit(None).cast("string")
    points = (
        shapes.select(
            "doc_id",
            "shape",
            F.col("f.properties")[name_prop].alias("region_name"),
            parent.alias("parent_name"),
            F.posexplode(
                _polygons(F.col("f.geometry.type"), F.col("f.geometry.coordinates"), "array<double>")
            ).alias("poly_id", "p"),
        )
        .select("doc_id", "shape", "region_name", "parent_name", "poly_id", F.posexplode("p").alias("ring_id", "r"))
        .select(
            "doc_id", "shape", "region_name", "parent_name", "poly_id", "ring_id",
            F.posexplode("r").alias("at", "c"),
        )
        .withColumns({"x": F.col("c")[0], "y": F.col("c")[1]})
    )
    return _edges(points, ["at"])


def _edges(points: DataFrame, order: list[str]) -> DataFrame:
    """Consecutive points of a ring joined into edges, the last back to the first.

    Repeated points, as where two arcs meet, give no edge. A region with a ring of fewer
    than three edges is not a valid polygon and is left out whole.
    """
    ring = ["doc_id", "shape", "region_name", "parent_name", "poly_id", "ring_id"]
    around = Window.partitionBy(*ring).orderBy(*order)
    start = F.first(F.struct("x", "y")).over(around)
    following = F.coalesce(F.lead(F.struct("x", "y")).over(around), start)
    edges = points.withColumn("_to", following).where(
        (F.col("x") != F.col("_to.x")) | (F.col("y") != F.col("_to.y"))
    )
    per_region = Window.partitionBy("doc_id", "shape")
    sized = edges.withColumn("_ring_edges", F.count(F.lit(1)).over(Window.partitionBy(*ring)))
    sized = sized.withColumn("_smallest", F.min("_ring_edges").over(per_region))
    return sized.where(F.col("_smallest") >= 3).select(
        "doc_id",
        F.concat_ws("#", "doc_id", "shape").alias("region_id"),
        "region_name",
        "parent_name",
        "poly_id",
        "ring_id",
        (F.row_number().over(around) - 1).alias("seq"),
        F.col("x").alias("x1"),
        F.col("y").alias("y1"),
        F.col("_to.x").alias("x2"),
        F.col("_to.y").alias("y2"),
    )


def valid_regions(edges: DataFrame) -> DataFrame:
    """Edges of the regions that are valid shapes: no edges cross, and rings are nested as they should be.

    `edges` should be a written table, it is read several times.
    """
    return drop_misnested(materialize(drop_crossing(edges), "uncrossed"))


def drop_crossing(edges: DataFrame) -> DataFrame:
    """Leaves out regions whose edges cross each other; touching is allowed.

    Every edge lies on the grid level whose cells are as wide as the edge is long, in four cells at most, and looks for the edges of
    its own and of coarser levels in the cells around itself. So a dense coast meets its few neighbours and the long edges
    nearby, however many edges share one part of the map.
    """
    own = "int(ceil(log2(greatest(abs(x2 - x1), abs(y2 - y1)))))"
    lines = edges.selectExpr("region_id", "struct(poly_id, ring_id, seq) AS edge", "x1", "y1", "x2", "y2", f"{own} AS own")
    levels = lines.groupBy("region_id").agg(F.collect_set("own").alias("levels"))  # at most one per power of two

    def cells(axis: str) -> str:
        low, high = f"least({axis}1, {axis}2) / pow(2D, level)", f"greatest({axis}1, {axis}2) / pow(2D, level)"
        return f"explode(sequence(floor({low}), floor({high}))) AS c{axis}"

    keys = ["region_id", "level", "cx", "cy"]
    hosts = lines.withColumn("level", F.col("own")).selectExpr("*", cells("x")).selectExpr("*", cells("y")).drop("own")
    hosts = hosts.withColumnsRenamed({c: f"o_{c}" for c in ("edge", "x1", "y1", "x2", "y2")})
    visitors = merged(lines, levels, ["region_id"]).selectExpr("*", "explode(filter(levels, l -> l >= own)) AS level").drop("levels")
    visitors = visitors.selectExpr("*", cells("x")).selectExpr("*", cells("y"))

    def side(line: str, x: str, y: str) -> str:
        """Which side of an edge a point is on."""
        return f"signum(({line}x2 - {line}x1) * ({y} - {line}y1) - ({line}y2 - {line}y1) * ({x} - {line}x1))"

    crosses = F.expr(
        f"{side('', 'o_x1', 'o_y1')} * {side('', 'o_x2', 'o_y2')} < 0 AND {side('o_', 'x1', 'y1')} * {side('o_', 'x2', 'y2')} < 0"
    )
    once = F.expr("own < level OR edge < o_edge")
    invalid = merged(visitors, hosts, keys).where(once & crosses).select("region_id").distinct()
    return edges.join(invalid, "region_id", "left_anti").select(*edges.columns)


def drop_misnested(edges: DataFrame) -> DataFrame:
    """Leaves out regions with a hole that isn't inside its shell, holes inside each other, or polygons that overlap.

    Edges must not cross. The middle of every edge and one point inside every ring are looked up in the region's other rings
    (`plans.cells`): those of a hole must be in or on its shell and in no other hole, those of a polygon in no other polygon, but an
    island in a hole is one. Rings may touch. Two polygons of a region that only share a border are kept.
    """
    ring = ["region_id", "poly_id", "ring_id"]
    boxes = edges.groupBy(*ring).agg(
        F.min(F.least("x1", "x2")).alias("west"), F.max(F.greatest("x1", "x2")).alias("east"),
        F.min(F.least("y1", "y2")).alias("south"), F.max(F.greatest("y1", "y2")).alias("north"),
    )
    several = boxes.groupBy("region_id").count().where("count > 1").select("region_id")
    some = materialize(merged(edges, several, ["region_id"], "left_semi").select(*ring, "seq", "x1", "y1", "x2", "y2"), "rings")
    shapes = cover(some, ring)
    if shapes is None:
        return edges
    middles = some.selectExpr("region_id", f"struct({', '.join(ring)}, seq) AS _pid", "(x1 + x2) / 2 AS _x", "(y1 + y2) / 2 AS _y")
    polygon_points = _inner_points(some, ["region_id", "poly_id"]).withColumn("ring_id", F.lit(0))
    hole_points = _inner_points(some.where("ring_id > 0"), ring)
    inner = polygon_points.unionByName(hole_points).selectExpr("region_id", f"struct({', '.join(ring)}, -1 AS seq) AS _pid", "_x", "_y")
    points = materialize(middles.unionByName(inner), "ring_points")
    met = materialize(locate(points, shapes, ["region_id"]), "ring_hits")
    other = met.selectExpr(
        "_pid", "_pid.region_id", "_pid.poly_id", "_pid.ring_id", "shape.poly_id AS in_poly", "shape.ring_id AS in_ring", "inside", "`on`"
    ).where("(inside OR `on`) AND (poly_id <> in_poly OR ring_id <> in_ring)")
    in_shell = other.where("ring_id > 0 AND poly_id = in_poly AND in_ring = 0").select("_pid").distinct()
    outside = merged(points.where("_pid.ring_id > 0"), in_shell, ["_pid"], "left_anti").select("region_id")
    in_hole = other.where("ring_id > 0 AND poly_id = in_poly AND in_ring > 0 AND NOT `on`").select("region_id")
    overlap = (
        other.where("ring_id = 0 AND poly_id <> in_poly")
        .groupBy("region_id", "_pid", "in_poly")
        .agg(F.bool_or(F.expr("in_ring = 0 AND NOT `on`")).alias("deep"), F.bool_or(F.expr("in_ring > 0")).alias("lake"))
        .where("deep AND NOT lake").select("region_id")
    )
    shells = boxes.where("ring_id = 0").drop("ring_id")
    as_wide = merged(boxes.where("ring_id > 0"), shells, ["region_id", "poly_id", "west", "east", "south", "north"]).select("region_id")
    invalid = outside.unionByName(in_hole).unionByName(overlap).unionByName(as_wide).distinct()
    return merged(edges, invalid, ["region_id"], "left_anti").select(*edges.columns)


def _inner_points(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _x, _y): a point inside each shape, between its lowest two heights and its first two edges there."""
    heights = edges.selectExpr(*keys, "explode(array(y1, y2)) AS y")
    lowest = heights.groupBy(*keys).agg(F.min("y").alias("lowest"))
    lines = merged(heights, lowest, keys).where("y > lowest").groupBy(*keys, "lowest").agg(F.min("y").alias("next"))
    crossed = merged(edges, lines.selectExpr(*keys, "(lowest + next) / 2 AS _y"), keys).where("(y1 > _y) <> (y2 > _y)").selectExpr(
        *keys, "_y", f"{x_at('_y')} AS x"
    )
    first = crossed.groupBy(*keys).agg(F.min("x").alias("first"))
    return merged(crossed, first, keys).where("x > first").groupBy(*keys, "_y", "first").agg(F.min("x").alias("second")).selectExpr(
        *keys, "(first + second) / 2 AS _x", "_y"
    )


def region_names(edges: DataFrame) -> DataFrame:
    """One row per region with the keys used to match it to reference districts."""
    return edges.select("region_id", "region_name", "parent_name").distinct().select(
        "region_id",
        norm_name("region_name", empty_as_null=True).alias("district_norm"),
        norm_name("parent_name", empty_as_null=True).alias("state_norm"),
    )
