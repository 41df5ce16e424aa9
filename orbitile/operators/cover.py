"""Polygons covered by cells of several sizes, points in polygons, labels by latitude and longitude.

A polygon is an array of rings of (x, y), by the even-odd rule: holes and further parts are
rings like any other. Its cover holds large cells inside and small ones along the edge, so
that the number of cells follows the length of the edge in cells of the smallest size, which
is a fixed share of the polygon's own size: a footprint of any extent has some hundred cells.
Points meet cells in equi-joins, one key for each cell size that occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitile.functions.geo import all_from_utm, to_utm
from orbitile.operators.catalog import computed_once, named_values
from orbitile.operators.composite import GRID, edges_of_rings
from orbitile.operators.regions import edge_meets_box

#: Halvings from the cell that spans a polygon to the smallest along its edge.
DEPTH = 5


def crossings(edges: Column, x: Column, y: Column) -> Column:
    """Number of edges right of the point (x, y) on its level."""
    at = lambda e: e["x0"] + (y - e["y0"]) * (e["x1"] - e["x0"]) / F.nullif(e["y1"] - e["y0"], F.lit(0.0))
    return F.size(F.filter(edges, lambda e: ((e["y0"] <= y) != (e["y1"] <= y)) & (at(e) > x)))


def strictly_inside(edges: Column, x: Column, y: Column) -> Column:
    """Whether (x, y) lies inside the edges' polygon and on none of them."""

    def on(e: Column) -> Column:
        level = (e["x1"] - e["x0"]) * (y - e["y0"]) - (e["y1"] - e["y0"]) * (x - e["x0"])
        return (level == 0) & x.between(F.least(e["x0"], e["x1"]), F.greatest(e["x0"], e["x1"])) & y.between(F.least(e["y0"], e["y1"]), F.greatest(e["y0"], e["y1"]))

    return (crossings(edges, x, y) % 2 == 1) & ~F.exists(edges, on)


def _bounded(shapes: DataFrame, rings: str) -> DataFrame:
    """Adds _edges and _top, the exponent of two of the least cell as large as the polygon; no polygon without extent."""
    all_of = lambda axis: F.flatten(F.transform(rings, lambda r: F.transform(r, lambda v: v[axis])))
    bounds = {f"_{axis}{k}": least(all_of(axis)) for axis in "xy" for k, least in ((0, F.array_min), (1, F.array_max))}
    side = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))
    return computed_once(computed_once(shapes, **bounds).filter(side > 0), _top=F.ceil(F.log2(side)).cast("int"), _edges=edges_of_rings(F.col(rings)))


def _cell(e: Column, cx: Column, cy: Column, whole: Column) -> Column:
    return F.struct(e.cast("int").alias("e"), cx.cast("long").alias("x"), cy.cast("long").alias("y"), whole.alias("whole"))


def _meets(box: dict[str, Column]):
    return lambda e: edge_meets_box(e, box)


def cover(shapes: DataFrame, rings: str = "rings", depth: int = DEPTH) -> DataFrame:
    """``shapes`` with one row for each cell _cell(e, x, y, whole) of their polygons' covers.

    A cell spans x to x + 1 and y to y + 1 in units of 2**e; ``whole`` cells lie inside the
    polygon and touch no edge, the others are of the smallest size and hold a part of one.
    """
    unit = F.pow(F.lit(2.0), F.col("_top"))
    span = {a: F.sequence(F.floor(F.col(f"_{a}0") / unit), F.floor(F.col(f"_{a}1") / unit)) for a in "xy"}
    first = F.flatten(F.transform(span["x"], lambda x: F.transform(span["y"], lambda y: _cell(F.col("_top"), x, y, F.lit(False)))))
    cells = _bounded(shapes, rings).withColumn("_cell", F.explode(first))
    for step in range(depth + 1):
        size = F.pow(F.lit(2.0), F.col("_cell.e"))
        box = {"x0": F.col("_cell.x") * size, "x1": (F.col("_cell.x") + 1) * size, "y0": F.col("_cell.y") * size, "y1": (F.col("_cell.y") + 1) * size}
        touched = ~F.col("_cell.whole") & F.exists("_edges", _meets(box))
        held = F.col("_cell.whole") | (crossings(F.col("_edges"), (box["x0"] + box["x1"]) / 2, (box["y0"] + box["y1"]) / 2) % 2 == 1)
        cells = computed_once(cells, _touched=touched).filter(F.col("_touched") | held)
        own = _cell(F.col("_cell.e"), F.col("_cell.x"), F.col("_cell.y"), ~F.col("_touched"))
        if step == depth:
            return cells.withColumn("_cell", own).drop("_touched", "_top", "_x0", "_x1", "_y0", "_y1")
        parts = [_cell(F.col("_cell.e") - 1, F.col("_cell.x") * 2 + i, F.col("_cell.y") * 2 + j, F.lit(False)) for i in (0, 1) for j in (0, 1)]
        cells = cells.withColumn("_cell", F.explode(F.when(F.col("_touched"), F.array(*parts)).otherwise(F.array(own)))).drop("_touched")
    return cells


def _placed(points: DataFrame, levels: list[int]) -> DataFrame:
    """``points`` with one row, its cell _cx, _cy, for each cell size 2**_e of ``levels``."""
    placed = points.withColumn("_e", F.explode(F.array(*[F.lit(e) for e in levels]) if levels else F.array().cast("array<int>")))
    return placed.withColumns({f"_c{axis}": F.floor(F.col(axis) / F.pow(F.lit(2.0), F.col("_e"))) for axis in "xy"})


def _met(points: DataFrame, shapes: DataFrame, keys: list[str], rings: str, depth: int) -> DataFrame:
    """Points with the shapes of their key that they lie strictly inside, by the shapes' covers.

    Which cell sizes occur is read first: at most as many as a double has exponents. Covers have many
    times the rows of their table, by whose size they would be broadcast, so the join is a merge join.
    """
    tops = [r[0] for r in _bounded(shapes, rings).select("_top").distinct().collect()]
    levels = sorted({t - d for t in tops for d in range(depth + 1)})
    cells = cover(shapes, rings, depth).withColumns({"_e": F.col("_cell.e"), "_cx": F.col("_cell.x"), "_cy": F.col("_cell.y"), "_whole": F.col("_cell.whole")}).drop("_cell")
    met = _placed(points, levels).join(cells.hint("merge"), [*keys, "_e", "_cx", "_cy"])
    return met.filter(F.col("_whole") | strictly_inside(F.col("_edges"), F.col("x"), F.col("y"))).drop("_e", "_cx", "_cy", "_whole", "_edges")


def points_in_polygons(points: DataFrame, shapes: DataFrame, keys=GRID, rings: str = "rings", depth: int = DEPTH) -> DataFrame:
    """``points(keys, x, y, ...)`` with the ``shapes`` of their key that they lie strictly inside.

    Shapes of one key with equal rings, such as footprints of many dates, are covered and met once.
    """
    keys = list(keys)
    named = named_values(shapes, rings)
    one = named.groupBy(*keys, "_a", "_b").agg(F.first(rings).alias(rings))
    return _met(points, one, keys, rings, depth).drop(rings).join(named, [*keys, "_a", "_b"]).drop("_a", "_b")


def _ring_in_degrees(corners: list[tuple[Column, Column]], epsg: Column) -> Column:
    """Corners in metres as vertices (x: longitude, y: latitude); the projection stands in the plan once for all of them."""
    metres = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])
    return F.transform(all_from_utm(metres, epsg), lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))


def _tile(x: Column, y: Column) -> Column:
    return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))


#: What places a composite and its tiles.
REFERENCE = ("epsg", "x0", "y0", "res", "width", "height", "step")


def label_tiles_degrees(points: DataFrame, grids: DataFrame, keys=GRID, order: str = "bridge_id") -> DataFrame:
    """The first of ``points(lat, lon)`` strictly inside each tile, tiles being quadrilaterals in degrees.

    ``grids(keys, epsg, x0, y0, res, width, height, step)`` are references of composites,
    ``step`` the pixels of a tile's side; tiles over the far edge keep their size. A point
    counts for every grid whose outline, straight lines between its corners in degrees,
    holds it. Grids of the same reference have the same labels, which are found once.
    Points on an edge are in no tile. Returns keys, x_min, y_min, ``order``, lat, lon.
    """
    keys = list(keys)
    # the references of a key are one, unless its grids disagree
    own = grids.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(*REFERENCE))).alias("_references"))
    named = named_values(own, "_references")
    one = named.groupBy("_a", "_b").agg(F.first("_references").alias("_references")).select("_a", "_b", F.inline("_references"))
    labels = _labels(points, one, ["_a", "_b"], order)
    return labels.join(named.drop("_references"), ["_a", "_b"]).select(*keys, "x_min", "y_min", order, "lat", "lon")


def _labels(points: DataFrame, grids: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Labels of the tiles of ``grids``.

    A point's tile is predicted in the grid's projection and proved in degrees; where a bent
    border puts it elsewhere, the eight neighbours are tried.
    """
    epsg = F.col("epsg")
    right, low = F.col("x0") + F.col("width") * F.col("res"), F.col("y0") - F.col("height") * F.col("res")
    outline = _ring_in_degrees([(F.col("x0"), F.col("y0")), (right, F.col("y0")), (right, low), (F.col("x0"), low)], epsg)
    outlined = computed_once(grids.select(F.lit(0).alias("_all"), *keys, *REFERENCE), rings=F.array(outline))
    placed = points.select(F.lit(0).alias("_all"), order, F.col("lon").alias("x"), F.col("lat").alias("y"))
    met = _met(placed, outlined, ["_all"], "rings", DEPTH).drop("_all", "rings")
    side = F.col("step") * F.col("res")
    place = computed_once(met, _p=to_utm(F.col("y"), F.col("x"), epsg))
    place = computed_once(place, _tile=_tile(F.floor((F.col("_p.x") - F.col("x0")) / side), F.floor((F.col("y0") - F.col("_p.y")) / side))).drop("_p")

    def proved(rows: DataFrame, before: Column) -> DataFrame:
        """Adds _held: whether ``before`` or the tile exists and holds the point."""
        corner = lambda i, j: (F.col("x0") + (F.col("_tile.x") + i) * side, F.col("y0") - (F.col("_tile.y") + j) * side)
        ring = computed_once(rows, _ring=F.when(~before, _ring_in_degrees([corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)], epsg)))
        edged = computed_once(ring, _edges=edges_of_rings(F.array("_ring"))).drop("_ring")
        there = (F.col("_tile.x") >= 0) & (F.col("_tile.y") >= 0) & (F.col("_tile.x") * F.col("step") < F.col("width")) & (F.col("_tile.y") * F.col("step") < F.col("height"))
        return computed_once(edged, _held=before | there & strictly_inside(F.col("_edges"), F.col("x"), F.col("y"))).drop("_edges")

    # tiles share their corners exactly, so no point is inside two of a grid
    others = F.array(*[_tile(F.col("_tile.x") + i, F.col("_tile.y") + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    tried = proved(place, F.lit(False)).withColumn("_tried", F.explode(F.when(F.col("_held"), F.array("_tile")).otherwise(others)))
    again = tried.withColumns({"_tile": F.col("_tried"), "_sure": F.col("_held")}).drop("_tried", "_held")
    tiles = proved(again, F.col("_sure")).filter("_held")
    at = {"x_min": (F.col("_tile.x") * F.col("step")).cast("int"), "y_min": (F.col("_tile.y") * F.col("step")).cast("int")}
    first = F.min_by(F.struct(F.col(order), F.col("y").alias("lat"), F.col("x").alias("lon")), F.col(order)).alias("first")
    return tiles.withColumns(at).groupBy(*keys, "x_min", "y_min").agg(first).select(*keys, "x_min", "y_min", "first.*")


def truth_in_footprint(points: DataFrame, footprints: DataFrame, keys=GRID) -> DataFrame:
    """Points strictly inside a footprint box (x_lo, y_lo, x_hi, y_hi) of their grid.

    A box has cells of one size: at least half of its shorter side and a sixteenth of its longer
    one, so 51 at most and mostly four to nine. Which sizes occur is read first.
    """
    keys = list(keys)
    wide, high = F.col("x_hi") - F.col("x_lo"), F.col("y_hi") - F.col("y_lo")
    size = F.greatest(F.ceil(F.log2(F.least(wide, high))) - 1, F.ceil(F.log2(F.greatest(wide, high))) - 4)
    sized = computed_once(footprints.filter((wide > 0) & (high > 0)), _e=size.cast("int"))
    levels = sorted(r[0] for r in sized.select("_e").distinct().collect())
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_e")))
    cells = sized.withColumn("_cx", F.explode(F.sequence(at("x_lo"), at("x_hi")))).withColumn("_cy", F.explode(F.sequence(at("y_lo"), at("y_hi"))))
    met = _placed(points, levels).join(cells.hint("merge"), [*keys, "_e", "_cx", "_cy"])
    inside = (F.col("x") > F.col("x_lo")) & (F.col("x") < F.col("x_hi")) & (F.col("y") > F.col("y_lo")) & (F.col("y") < F.col("y_hi"))
    return met.filter(inside).drop("_e", "_cx", "_cy")
