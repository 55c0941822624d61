"""Nearest neighbour within a radius and point-in-polygon, both as equi-joins on cells."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundcover import config
from groundcover.functions.geo import haversine_km
from groundcover.plans.cells import LEAF_EDGES, cover, locate
from groundcover.plans.skew import skew_safe_join
from groundcover.plans.topk import top_k
from groundcover.session import materialize

MARGIN = 1.01


def _row(lat: Column, km: float) -> Column:
    return F.floor(lat / F.lit(_row_height(km)))


def _row_height(km: float) -> float:
    return math.degrees(km / config.EARTH_RADIUS_KM) * MARGIN


def _reach(lat: Column, km: float) -> Column:
    """Largest longitude difference within `km` of a point at this latitude."""
    angle = km / config.EARTH_RADIUS_KM
    ratio = F.lit(math.sin(angle) * MARGIN) / F.cos(F.radians(lat))
    near_pole = F.abs(lat) + math.degrees(angle) * MARGIN >= 90
    return F.when(near_pole, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))))


def _columns_in_row(row: Column, km: float) -> Column:
    """Cells around the globe in a row of latitude, each at least one reach wide."""
    height = _row_height(km)
    farthest = F.greatest(F.abs(row * F.lit(height)), F.abs((row + 1) * F.lit(height)))
    return F.greatest(F.floor(F.lit(360.0) / _reach(F.least(farthest, F.lit(90.0)), km)), F.lit(1))


def _column(lon: Column, columns: Column) -> Column:
    return F.floor((lon + 180.0) * columns / 360.0)


def _search(points: DataFrame, centroids: DataFrame, km: float) -> DataFrame:
    """Nearest centroid of every point that has one within `km`."""
    here = points.withColumn("_row", _row(F.col("_lat"), km))
    here = here.withColumn("_columns", _columns_in_row(F.col("_row"), km))
    here = here.withColumn(
        "_col", F.pmod(_column(F.col("_lon"), F.col("_columns")), F.col("_columns"))
    ).drop("_columns")

    # Centroids are copied to every cell they can be reached from; points stay single.
    around = centroids.withColumn(
        "_row", F.explode(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]),
                                      lambda i: _row(F.col("_clat"), km) + i))
    )
    around = around.withColumn("_columns", _columns_in_row(F.col("_row"), km))
    reach = _reach(F.col("_clat"), km)
    first = _column(F.col("_clon") - reach, F.col("_columns"))
    last = _column(F.col("_clon") + reach, F.col("_columns"))
    last = F.least(last, first + F.col("_columns") - 1)
    around = around.withColumn(
        "_col", F.explode(F.transform(F.sequence(first, last), lambda c: F.pmod(c, F.col("_columns"))))
    ).drop("_columns")

    pairs = skew_safe_join(here, around, ["_row", "_col"], "inner").withColumn(
        "distance_km",
        haversine_km(F.col("_lat"), F.col("_lon"), F.col("_clat"), F.col("_clon")),
    )
    near = pairs.where(F.col("distance_km") <= km).select("_pid", "_cid", "distance_km")
    return top_k(near, ["_pid"], [F.col("distance_km"), F.col("_cid")])


def nearest_within(
    points: DataFrame,
    centroids: DataFrame,
    km: float = config.NEAREST_KM,
    point: Sequence[str] = ("unique_id", "latitude", "longitude"),
    centroid: Sequence[str] = ("pincode", "pin_centroid_lat", "pin_centroid_lon"),
    levels: Sequence[float] | None = None,
) -> DataFrame:
    """(point id, centroid id, distance_km) of the single nearest centroid within `km`.

    Instead of comparing all pairs, points meet only the centroids of their own cell
    neighbourhood. A short radius is tried first: in dense areas it settles most points
    against few centroids, and the nearest one inside any radius is the nearest overall.
    Equal distances go to the smallest centroid id.
    """
    pid, plat, plon = point
    cid, clat, clon = centroid
    open_points = points.select(
        F.col(pid).alias("_pid"), F.col(plat).alias("_lat"), F.col(plon).alias("_lon")
    ).dropna()
    places = centroids.select(
        F.col(cid).alias("_cid"), F.col(clat).alias("_clat"), F.col(clon).alias("_clon")
    ).dropna()
    places = top_k(places, ["_clat", "_clon"], [F.col("_cid")])  # copies of one place
    radii = list(levels or (km / 8, km))
    open_points = materialize(open_points, "points")
    found = []
    for radius in radii[:-1]:
        found.append(materialize(_search(open_points, places, radius), "nearest"))
        open_points = open_points.join(found[-1].select("_pid"), "_pid", "left_anti")
    found.append(_search(open_points, places, radii[-1]))
    return reduce(DataFrame.unionByName, found).withColumnsRenamed({"_pid": pid, "_cid": cid})


def points_in_polygons(
    points: DataFrame,
    edges: DataFrame,
    point: Sequence[str] = ("unique_id", "longitude", "latitude"),
    region: str = "region_id",
    leaf_edges: int = LEAF_EDGES,
) -> DataFrame:
    """(point id, region) for every point inside a region; holes are outside.

    A ray to the east crosses an odd number of a polygon's edges exactly when the point is inside; edges own their lower
    end (`(y1 > y) != (y2 > y)`). Polygons are covered by a hierarchy of cells (`plans.cells`): a point in a cell within a polygon
    meets no edge at all, one at its border meets only the few edges of its own cell. If regions overlap, the smallest region wins.
    """
    pid, px, py = point
    where = points.select(F.col(pid).alias("_pid"), F.col(px).alias("_x"), F.col(py).alias("_y")).dropna()
    lines = edges.select(F.col(region).alias("_region"), "poly_id", "x1", "y1", "x2", "y2")
    shapes = cover(lines, ["_region", "poly_id"], leaf_edges)
    if shapes is None:
        return where.select(F.col("_pid").alias(pid), F.lit(None).cast(edges.schema[region].dataType).alias(region)).where(F.lit(False))
    inside = locate(where, shapes).where("inside")
    return inside.groupBy("_pid").agg(F.min("shape._region").alias(region)).withColumnRenamed("_pid", pid)


def region_bbox(edges: DataFrame, regions: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Extent over the selected regions: one box, or one per `by` group."""
    chosen = edges if regions is None else edges.where(F.col("region_id").isin(list(regions)))
    return chosen.groupBy(*by).agg(
        F.min(F.least("x1", "x2")).alias("min_x"),
        F.min(F.least("y1", "y2")).alias("min_y"),
        F.max(F.greatest("x1", "x2")).alias("max_x"),
        F.max(F.greatest("y1", "y2")).alias("max_y"),
    )
