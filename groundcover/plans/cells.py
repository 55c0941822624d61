"""Cells for joins in the plane: a hierarchical cover of polygons, and a grid of segments by length."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundcover.session import materialize

FAN = 64  # a cell is split into FAN x FAN cells; a row of them is one 64-bit mask
SHIFT, LAST = 6, FAN - 1
LEAF_EDGES = 64  # a shape's cell with more edges is split
LEVELS = 5

EDGE = ("x1", "y1", "x2", "y2")


def merged(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join that never collects a side in the driver.

    Before it runs Spark sizes a side by the compressed files below it. Edges of like shapes compress well and are then multiplied by
    cells, so a side that looks small enough to broadcast can be a hundred times that.
    """
    return left.join(right.hint("merge"), list(keys), how)


@dataclass
class Frame:
    """The square around all edges. Its corner is at no round number, so sides of cells rarely meet vertices.

    Its methods, like the helpers below, give SQL text.
    """

    x: float
    y: float
    size: float

    def width(self, level: int) -> float:
        return self.size / FAN**level

    def side(self, axis: str, level: int, index: str) -> str:
        return f"({self._corner(axis)} + ({index}) * {self.width(level)!r}D)"

    def index(self, axis: str, level: int, at: str) -> str:
        return f"floor(({at} - {self._corner(axis)}) / {self.width(level)!r}D)"

    def below(self, axis: str, level: int, parent: str, at: str) -> str:
        """How many of a parent's FAN upper sides (east or north) are below `at`, each side compared as it is computed elsewhere."""
        guess = self.index(axis, level, at)
        up, down = self.side(axis, level, f"{guess} + 1"), self.side(axis, level, guess)
        return f"greatest(0, least({FAN}, {guess} - {parent} * {FAN} + if({up} < {at}, 1, 0) - if({down} >= {at}, 1, 0)))"

    def _corner(self, axis: str) -> str:
        return f"({self.x if axis == 'x' else self.y!r}D)"


def frame_of(edges: DataFrame) -> Frame | None:
    box = edges.selectExpr("min(least(x1, x2))", "max(greatest(x1, x2))", "min(least(y1, y2))", "max(greatest(y1, y2))").first()
    if box[0] is None:
        return None
    low_x, high_x, low_y, high_y = box
    extent = max(high_x - low_x, high_y - low_y)
    size = 2.0 ** math.ceil(math.log2(extent * 1.02)) if extent > 0 else 1.0
    return Frame(low_x - (size - high_x + low_x) / math.pi, low_y - (size - high_y + low_y) / math.e, size)


def x_at(y: str) -> str:
    return f"((x2 - x1) * ({y} - y1) / nullif(y2 - y1, 0D) + x1)"


def y_at(x: str) -> str:
    return f"((y2 - y1) * ({x} - x1) / nullif(x2 - x1, 0D) + y1)"


def _bits(first: str, last: str) -> str:
    """Bits first..last of a long."""
    return f"shiftleft(shiftrightunsigned(-1L, int({LAST} - ({last} - ({first})))), int({first}))"


@dataclass
class Cover:
    """Rows of a parent's FAN cells (level, px, cy, shape, border, states) and the edges of border cells (level, cx, cy, shape, ...).

    Bit i stands for the cell cx = px * FAN + i. A `border` cell has edges of the shape, unless it was split; its bit in `states` says
    whether its north-east corner is inside. A cell that is not border lies in the shape, and needs no edges, if its bit in `states` is set.
    Rows without either are not kept. Cells are never listed one by one: there can be FAN x FAN of them for a shape of four edges.
    """

    frame: Frame
    cells: DataFrame
    edges: DataFrame
    levels: list[int]


def cover(edges: DataFrame, keys: Sequence[str], leaf_edges: int = LEAF_EDGES) -> Cover | None:
    """Covers every shape (edges that share `keys`; its interior is where a ray crosses an odd number of them).

    Every round splits the cells that hold many edges of a shape FAN ways in both directions. Whether a new cell's north-east
    corner is inside follows from the parent's corner, by a path east to the parent's side and north along it, which meets
    edges of the parent only: their crossings flip bits of a row mask. So a round reads each edge in its own cells, and cells within
    a shape are found without edges. The number of rounds depends on how dense edges are, not on how wide a shape is.
    """
    active = edges.select(F.struct(*keys).alias("shape"), *EDGE).dropna(subset=list(EDGE))
    for key in keys:
        active = active.where(F.col(f"shape.{key}").isNotNull())
    frame = frame_of(active)
    if frame is None:
        return None
    # Without a shape of many edges no cell is split: one round, read as part of the query that uses it.
    most = active.groupBy("shape").count().agg(F.max("count")).first()[0]
    once = most <= leaf_edges
    active = active.selectExpr("shape", "0L AS px", "0L AS py", "false AS state", *EDGE)
    seeds = None
    found, kept, levels = [], [], []
    for level in range(1, LEVELS + 1):
        laid_out, masks = _masks(frame, level, active, seeds)
        if not once:
            laid_out, masks = materialize(laid_out, "cells"), materialize(masks, "masks")
        found.append(masks.where("(border | states) <> 0").selectExpr(f"{level} AS level", "px", f"py * {FAN} + j AS cy", "shape", "border", "states"))
        levels.append(level)
        place = [f"{level} AS level", f"px * {FAN} + i AS cx", f"py * {FAN} + j AS cy"]
        if once or level == LEVELS:
            kept.append(laid_out.selectExpr(*place, "shape", *EDGE))
            break
        counted = laid_out.groupBy("shape", "px", "py", "j", "i").agg(F.count(F.lit(1)).alias("edges"))
        border = merged(counted, masks, ["shape", "px", "py", "j"]).selectExpr(
            "shape", "px", "py", "i", "j", "shiftrightunsigned(states, i) & 1L = 1L AS state", f"edges > {leaf_edges} AS split"
        )
        border = materialize(border, "border")
        owned = merged(laid_out, border, ["shape", "px", "py", "j", "i"])
        kept.append(owned.where("NOT split").selectExpr(*place, "shape", *EDGE))
        dense = border.where("split")
        if dense.isEmpty():
            break
        down = [f"px * {FAN} + i AS px", f"py * {FAN} + j AS py"]
        active = owned.where("split").selectExpr("shape", *down, "state", *EDGE)
        seeds = dense.where("state").selectExpr("shape", *down)
    return Cover(frame, reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, kept), levels)


def _masks(frame: Frame, level: int, active: DataFrame, seeds: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Edges by cell, and per row of a parent's cells which of them are border and which have their north-east corner inside."""
    parent = ["shape", "px", "py"]
    own_east, own_north = frame.side("x", level - 1, "px + 1"), frame.side("y", level - 1, "py + 1")
    foot, top = frame.side("y", level, f"py * {FAN} + j"), frame.side("y", level, f"py * {FAN} + j + 1")
    # Cells are taken a little too wide: an edge too many changes nothing.
    pad = f"({frame.width(level) * 1e-3!r}D + (abs(x1) + abs(x2) + abs(y1) + abs(y2)) * 1e-14D)"

    def place(axis: str, at: str) -> str:
        return f"{frame.index(axis, level, at)} - p{axis} * {FAN}"

    rows = active.selectExpr("*", f"{place('y', f'least(y1, y2) - {pad}')} AS first", f"{place('y', f'greatest(y1, y2) + {pad}')} AS last")
    rows = rows.where(f"last >= 0 AND first <= {LAST}").selectExpr(
        *parent, *EDGE, f"explode(sequence(int(greatest(first, 0)), int(least(last, {LAST})))) AS j"
    )
    rows = rows.selectExpr(
        "*", f"if((y1 > {top}) <> (y2 > {top}), {x_at(top)}, NULL) AS crossing",
        f"if(y1 = y2, x1, {x_at(f'least(greatest(least(y1, y2), {foot}), greatest(y1, y2))')}) AS xa",
        f"if(y1 = y2, x2, {x_at(f'greatest(least(greatest(y1, y2), {top}), least(y1, y2))')}) AS xb",
    )
    rows = rows.selectExpr(
        *parent, *EDGE, "j", f"if(crossing <= {own_east}, least({frame.below('x', level, 'px', 'crossing')}, {LAST}), 0) AS crossed",
        f"{place('x', f'least(xa, xb) - {pad}')} AS west", f"{place('x', f'greatest(xa, xb) + {pad}')} AS east",
    )
    rows = rows.selectExpr(
        *parent, *EDGE, "j", "crossed", "int(greatest(west, 0)) AS west", f"int(least(east, {LAST})) AS east",
        f"east >= 0 AND west <= {LAST} AS here",
    )
    parts = rows.selectExpr(
        *parent, "j", f"if(crossed > 0, {_bits('0', 'crossed - 1')}, 0L) AS flips", f"if(here, {_bits('west', 'east')}, 0L) AS border"
    )
    rise = active.selectExpr(*parent, *EDGE, f"if((x1 > {own_east}) <> (x2 > {own_east}), {y_at(own_east)}, NULL) AS rise")
    up = rise.where(f"rise <= {own_north}").selectExpr(*parent, f"{frame.below('y', level, 'py', 'rise')} AS n").where("n > 0")
    parts = parts.unionByName(up.selectExpr(*parent, "explode(sequence(0, int(n - 1))) AS j", "-1L AS flips", "0L AS border"))
    if seeds is not None:
        parts = parts.unionByName(seeds.selectExpr(*parent, f"explode(sequence(0, {LAST})) AS j", "-1L AS flips", "0L AS border"))
    masks = parts.groupBy(*parent, "j").agg(F.bit_xor("flips").alias("states"), F.bit_or("border").alias("border"))
    laid_out = rows.where("here").selectExpr(*parent, "j", "explode(sequence(west, east)) AS i", *EDGE)
    return laid_out, masks


def locate(points: DataFrame, shapes: Cover, same: Sequence[str] = ()) -> DataFrame:
    """(_pid, shape, inside, on) of points (_pid, _x, _y) in the cells of shapes; points without a shape's cell have no row.

    `same` names key fields that points carry too and that must agree. Every point looks for its own cell on each level; a cell
    inside the shape answers at once, in a border cell the path to its corner is counted against the edges there. An edge owns its
    lower and its left end. `on`: the point lies on an edge, as far as 64-bit numbers can tell.
    """
    frame = shapes.frame
    places = [f"struct({n} AS level, {frame.index('x', n, '_x')} AS cx, {frame.index('y', n, '_y')} AS cy)" for n in shapes.levels]
    around = points.where(
        F.col("_x").between(frame.x, frame.x + frame.size) & F.col("_y").between(frame.y, frame.y + frame.size)
    ).selectExpr(*points.columns, f"inline(array({', '.join(places)}))")
    # Of the cells of a shape only those that hold points leave their row.
    around, row = around.selectExpr("*", f"shiftright(cx, {SHIFT}) AS px"), ["level", "px", "cy", *same]
    wanted = around.groupBy(*row).agg(F.expr(f"bit_or(shiftleft(1L, int(cx & {LAST})))").alias("wanted"))
    rows = merged(shapes.cells.selectExpr("*", *[f"shape.{k} AS {k}" for k in same]), wanted, row)
    cells = rows.selectExpr("*", "(border | states) & wanted AS here").where("here <> 0").selectExpr(
        *row, "shape", "border", "states", f"explode(filter(sequence(0, {LAST}), i -> shiftrightunsigned(here, i) & 1L = 1L)) AS i"
    ).selectExpr(
        "level", f"px * {FAN} + i AS cx", "cy", *same, "shape",
        "shiftrightunsigned(border, i) & 1L = 1L AS border", "shiftrightunsigned(states, i) & 1L = 1L AS state",
    )
    met = merged(around.drop("px"), cells, ["level", "cx", "cy", *same])
    sure = met.where("NOT border AND state").selectExpr("_pid", "shape", "true AS inside", "false AS `on`")
    open_ = met.where("border").select("_pid", "_x", "_y", "level", "cx", "cy", "shape", "state").distinct()

    def side(axis: str) -> str:
        return " ".join(["CASE level", *[f"WHEN {n} THEN {frame.side(axis, n, f'c{axis} + 1')}" for n in shapes.levels], "END"])

    tested = merged(open_.selectExpr("*", f"{side('x')} AS _east", f"{side('y')} AS _north"), shapes.edges, ["level", "cx", "cy", "shape"])
    tested = tested.selectExpr(
        "*", f"if((y1 > _y) <> (y2 > _y), {x_at('_y')}, NULL) AS crossing", f"if((x1 > _east) <> (x2 > _east), {y_at('_east')}, NULL) AS rise",
        "x2 - x1 AS dx", "y2 - y1 AS dy",
    )
    # How far the point is from the edge's line, against rounding of products of this size.
    near = (
        "abs(dx * (_y - y1) - dy * (_x - x1)) <= (abs(dx) + abs(dy)) * (abs(_x) + abs(_y) + abs(x1) + abs(y1) + abs(x2) + abs(y2)) * 1e-15D"
        " AND _x BETWEEN least(x1, x2) AND greatest(x1, x2) AND _y BETWEEN least(y1, y2) AND greatest(y1, y2)"
    )
    tested = tested.selectExpr(
        "_pid", "_x", "_y", "shape", "state", f"{near} AS near",
        "int(coalesce(_x < crossing AND NOT _east < crossing, false)) ^ int(coalesce((rise > _y) <> (rise > _north), false)) AS flip",
    )
    decided = tested.groupBy("_pid", "_x", "_y", "shape", "state").agg(F.bit_xor("flip").alias("flips"), F.bool_or("near").alias("on"))
    return sure.unionByName(decided.selectExpr("_pid", "shape", "(flips = 1) <> state AS inside", "`on`"))
