"""Regions, dates, grids and elevation cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitile.functions.geo import METRES_A_DEGREE, cell_name, cell_top_left
from orbitile.operators.catalog import named_values
from orbitile.operators.composite import edges_of, mosaic_first

BOX = ("min_lon", "min_lat", "max_lon", "max_lat")
#: Parts that a mosaic's lines are dealt over.
SLICES = 16


def buffered(boxes: DataFrame, metres: float) -> DataFrame:
    """Boxes grown on all four sides."""
    d = metres / METRES_A_DEGREE
    return boxes.withColumns({c: F.col(c) + (d if c.startswith("max") else -d) for c in BOX})


def requested(registry: DataFrame, regions=None, districts=None) -> DataFrame:
    """Rows of the requested regions and districts; an unknown name is an error."""
    for column, names in (("region", regions), ("district", districts)):
        if names:
            known = {r[0] for r in registry.filter(F.col(column).isin(list(names))).select(column).distinct().collect()}
            if missing := set(names) - known:
                raise ValueError(f"unknown {column}: {sorted(missing)}")
            registry = registry.filter(F.col(column).isin(list(names)))
    return registry


def region_has_truth(registry: DataFrame) -> DataFrame:
    return registry.groupBy("region").agg(F.bool_or("ground_truth").alias("has_truth"))


def date_prefixes(registry: DataFrame) -> DataFrame:
    """One row a day of a row's date ranges, with its unpadded key part /y/m/d/; a day of several ranges comes once."""
    if "ranges" in registry.columns:
        days = F.array_distinct(F.flatten(F.transform("ranges", lambda r: F.sequence(r["date_from"], r["date_to"]))))
    else:
        days = F.sequence("date_from", "date_to")
    days = registry.withColumn("day", F.explode(days))
    return days.withColumn("prefix", F.concat(F.lit("/"), F.year("day"), F.lit("/"), F.month("day"), F.lit("/"), F.dayofmonth("day"), F.lit("/")))


def of_grids(frame: DataFrame, names) -> DataFrame:
    """Rows of the named grids, compared without case."""
    return frame.filter(F.lower("mgrs").isin([n.lower() for n in names]))


def scene_files(keys: DataFrame, bands, mask: str = "MSK_CLOUDS_B00") -> DataFrame:
    """Object keys of the wanted bands and of cloud masks, no previews."""
    wanted = rf"/({'|'.join(bands)})\.jp2$|/{mask}\.gml$"
    return keys.filter(F.col("object_key").rlike(wanted) & ~F.contains("object_key", F.lit("/preview/")))


def grid_parts(grids: DataFrame) -> DataFrame:
    """UTM zone, latitude band and square of grid ids, and their key prefix."""
    parts = {"utm": F.substring("mgrs", 1, 2).cast("int"), "band": F.substring("mgrs", 3, 1), "square": F.substring("mgrs", 4, 2)}
    return grids.withColumns(parts).withColumn("prefix", F.concat_ws("/", F.lit("tiles"), F.col("utm"), "band", "square"))


def _cells(frame: DataFrame, x: str, y: str) -> DataFrame:
    """One row for each whole-degree cell a box touches."""
    lon = F.sequence(F.floor(BOX[0]).cast("int"), F.floor(BOX[2]).cast("int"))
    lat = F.sequence(F.floor(BOX[1]).cast("int"), F.floor(BOX[3]).cast("int"))
    return frame.withColumn(x, F.explode(lon)).withColumn(y, F.explode(lat))


def bbox_grids(boxes: DataFrame, grids: DataFrame) -> DataFrame:
    """Boxes with the grid cells they intersect, touching included, via shared one-degree cells."""
    a = _cells(boxes, "cx", "cy")
    g = _cells(grids, "cx", "cy").withColumnsRenamed({c: f"g_{c}" for c in BOX})
    joined = a.join(g, ["cx", "cy"])
    meet = (F.col("min_lon") <= F.col("g_max_lon")) & (F.col("max_lon") >= F.col("g_min_lon")) & (F.col("min_lat") <= F.col("g_max_lat")) & (F.col("max_lat") >= F.col("g_min_lat"))
    return joined.filter(meet).select("region", "district", "grid_id", "mgrs").distinct()


def _side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Positive where p lies left of the way from a to b, negative right, 0 on it."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def edge_meets_box(e: Column, box: dict[str, Column]) -> Column:
    """Whether an edge touches a box: their ranges overlap and the box's corners are not all on one side of it."""
    low = lambda axis: F.least(e[f"{axis}0"], e[f"{axis}1"])
    high = lambda axis: F.greatest(e[f"{axis}0"], e[f"{axis}1"])
    overlap = (low("x") <= box["x1"]) & (high("x") >= box["x0"]) & (low("y") <= box["y1"]) & (high("y") >= box["y0"])
    sides = [_side(e["x0"], e["y0"], e["x1"], e["y1"], box[x], box[y]) for x in ("x0", "x1") for y in ("y0", "y1")]
    return overlap & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def ring_meets_box(vertices: Column, box: dict[str, Column]) -> Column:
    """Whether a polygon (a ring of x, y) and a box share a point: an edge touches the box, or one holds the other."""
    edges = edges_of(vertices, True)
    # with no edge at the box, the box's corner is inside the ring by the even-odd rule or nothing is shared
    crossed = lambda e: ((e["y0"] <= box["y0"]) != (e["y1"] <= box["y0"])) & (e["x0"] + (box["y0"] - e["y0"]) * (e["x1"] - e["x0"]) / F.nullif(e["y1"] - e["y0"], F.lit(0.0)) > box["x0"])
    return F.exists(edges, lambda e: edge_meets_box(e, box)) | (F.size(F.filter(edges, crossed)) % 2 == 1)


def polygon_grids(boxes: DataFrame, grids: DataFrame) -> DataFrame:
    """Boxes with the grids whose polygon (``vertices`` of x, y) they intersect, touching included.

    Candidates share a one-degree cell of the polygon's bounds; the edges decide.
    """
    x, y = F.col("vertices.x"), F.col("vertices.y")
    bounds = [F.array_min(x).alias("min_lon"), F.array_max(x).alias("max_lon"), F.array_min(y).alias("min_lat"), F.array_max(y).alias("max_lat")]
    bounded = grids.select("grid_id", "mgrs", "vertices", *bounds)
    cells = _cells(bounded, "cx", "cy").drop(*BOX)
    joined = _cells(boxes, "cx", "cy").join(cells, ["cx", "cy"]).dropDuplicates(["region", "district", "grid_id"])
    box = {"x0": F.col("min_lon"), "x1": F.col("max_lon"), "y0": F.col("min_lat"), "y1": F.col("max_lat")}
    return joined.filter(ring_meets_box(F.col("vertices"), box)).select("region", "district", "grid_id", "mgrs")


def dem_cells(boxes: DataFrame) -> DataFrame:
    """Names of the elevation cells that cover each box."""
    return _cells(boxes, "lon", "lat").withColumn("cell", F.concat(cell_name(F.col("lat"), F.col("lon")), F.lit(".SRTMGL1_NC.nc")))


def land_grids(grids: DataFrame, cells: DataFrame) -> DataFrame:
    """Grids whose lower left corner lies in an elevation cell that exists."""
    corner = grids.withColumns({"lat": F.floor("min_lat").cast("int"), "lon": F.floor("min_lon").cast("int")})
    return corner.join(cells.select("lat", "lon"), ["lat", "lon"], "left_semi")


def dem_for_boxes(boxes: DataFrame, cells: DataFrame, metres: float) -> DataFrame:
    """Elevation cells of boxes grown by ``metres``; of overlapping sources the first."""
    return _cells(buffered(boxes, metres), "lon", "lat").join(mosaic_first(cells, ["lat", "lon"]), ["lat", "lon"])


def mosaic_pixels(cells: DataFrame, side: int) -> DataFrame:
    """Adds g_row and g_col, whole numbers from 90 degrees north and 180 west, from the cells' names.

    A cell has ``side`` steps a degree and ``side + 1`` pixels a line: its last row and column
    are the first ones of its neighbours, and have the same numbers.
    """
    corner = cells.withColumn("_c", cell_top_left(F.col("cell")))
    at = {"g_row": (90 - F.col("_c.lat")) * side + F.col("px_row"), "g_col": (F.col("_c.lon") + 180) * side + F.col("px_col")}
    return corner.withColumns({k: v.cast("int") for k, v in at.items()}).drop("_c")


def dem_mosaic(boxes: DataFrame, cells: DataFrame, metres: float, side: int, keys=("district",)) -> DataFrame:
    """Elevation rasters of boxes grown by ``metres``, put together from the cell rasters that exist.

    ``cells(cell, source_order, px_row, px_col, elevation)``. Of sources, then cells, that
    overlap the first with a value wins; pixels without any are left out. Boxes that touch
    the same cells have the same mosaic, which is made once. Returns keys, px_row and px_col
    within the box's mosaic, lon and lat of the pixel, elevation.
    """
    keys = list(keys)
    # the span of a key is one, unless it has several boxes
    spans = F.array_sort(F.collect_set(F.struct(*[F.floor(c).cast("int").alias(c) for c in BOX])))
    named = named_values(buffered(boxes, metres).groupBy(*keys).agg(spans.alias("_spans")), "_spans")
    one = named.groupBy("_a", "_b").agg(F.first("_spans").alias("_spans")).select("_a", "_b", F.inline("_spans"))
    needed = dem_cells(one).select("_a", "_b", "cell").distinct()
    wanted = cells.join(F.broadcast(needed.select("cell").distinct()), "cell", "left_semi")  # the earth has 64,800 cells
    tops = mosaic_pixels(wanted.select("cell").distinct().join(needed, "cell").withColumns({"px_row": F.lit(0), "px_col": F.lit(0)}), side).groupBy("_a", "_b").agg(F.min("g_row").alias("_top"), F.min("g_col").alias("_left"))
    # of each cell's pixel the first value, before cells meet boxes
    held = wanted.filter("elevation is not null").groupBy("cell", "px_row", "px_col").agg(F.min(F.struct("source_order", "cell", "elevation")).alias("_v"))
    pixels = mosaic_pixels(held.join(needed, "cell"), side)
    first = pixels.groupBy("_a", "_b", "g_row", "g_col").agg(F.min("_v")["elevation"].alias("elevation"))
    place = [(F.col("g_row") - F.col("_top")).alias("px_row"), (F.col("g_col") - F.col("_left")).alias("px_col"), (F.col("g_col") / side - 180).alias("lon"), (90 - F.col("g_row") / side).alias("lat")]
    mosaics = first.join(tops, ["_a", "_b"]).select("_a", "_b", *place, "elevation")
    # lines are dealt out, so that the boxes of one place are no single task
    dealt = named.select(*keys, "_a", "_b", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("_slice"))
    sliced = mosaics.withColumn("_slice", F.pmod("px_row", F.lit(SLICES)))
    return sliced.join(dealt.hint("merge"), ["_a", "_b", "_slice"]).select(*keys, "px_row", "px_col", "lon", "lat", "elevation")


def download_estimate(files: DataFrame) -> DataFrame:
    """Files, gigabytes and their transfer price at 0.09 a gigabyte, rounded to 2."""
    gb = F.sum("size_bytes") / 1e9
    return files.agg(F.count("*").alias("n_files"), F.round(gb, 2).alias("total_gb"), F.round(gb * 0.09, 2).alias("cost"))


def pending_work(wanted: DataFrame, done: DataFrame, keys) -> DataFrame:
    """Wanted rows whose output does not exist yet."""
    return wanted.join(done, list(keys), "left_anti")
