"""From scene observations to composites: masks, medians, band stacks, mosaics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitile.functions.geo import from_utm, to_utm

#: Highest pixel value that is not saturated, and band order (fixed values).
MAX_PIXEL = 4000.0
BANDS = ("B04", "B03", "B02", "B08")
BAND_NAMES = {"B04": "red", "B03": "green", "B02": "blue", "B08": "nir"}
PIXEL = ("px_row", "px_col")
BLOCK = ("block_row", "block_col")
#: Pixels of a line that one window task holds.
RUN = 512
#: Columns that name a raster: pixels of different grids never meet. Callers with several
#: regions or districts pass ("region", "district", "mgrs").
GRID = ("mgrs",)


def masked(value: Column, clear: Column, max_pixel: float = MAX_PIXEL) -> Column:
    """The pixel if it is clear, not zero and not saturated, else null (never NaN)."""
    p = value * clear
    return F.when((p != 0) & (p <= max_pixel), p)


def mask_clouds(obs: DataFrame, max_pixel: float = MAX_PIXEL) -> DataFrame:
    return obs.withColumn("value", masked(F.col("value"), F.col("clear"), max_pixel))


def median_composite(obs: DataFrame, keys=GRID) -> DataFrame:
    """Cloud-free median over time of each grid's pixel and band; all missing gives null."""
    return mask_clouds(obs).groupBy(*keys, "band", *PIXEL).agg(F.median("value").alias("value"))


def band_pivot(obs: DataFrame, keys=GRID) -> DataFrame:
    """Median composite with one column a band, in red, green, blue, nir order."""
    value = masked(F.col("value"), F.col("clear"))
    return obs.groupBy(*keys, *PIXEL).agg(*[F.median(F.when(F.col("band") == b, value)).alias(BAND_NAMES[b]) for b in BANDS])


def blocks(obs: DataFrame, side: int, keys=GRID) -> DataFrame:
    """Block form: the clear values of a block of side x side pixels and a date as one array.

    A cell is (at, value), ``at`` counting the block's pixels row by row; a pixel with
    several observations on a date has the cell of their median.
    """
    at = ((F.col("px_row") % side) * side + F.col("px_col") % side).cast("int")
    block = [F.floor(F.col(px) / side).cast("int").alias(name) for px, name in zip(PIXEL, BLOCK, strict=True)]
    one = mask_clouds(obs).groupBy(*keys, "band", "acq_date", *PIXEL).agg(F.median("value").alias("value")).filter("value is not null")
    return one.groupBy(*keys, "band", "acq_date", *block).agg(F.collect_list(F.struct(at.alias("at"), "value")).alias("cells"))


def blocks_of_arrays(stack: DataFrame, side: int, values: str = "values") -> DataFrame:
    """Block form from dense arrays of side x side values, row by row, null where missing; another size fails."""
    sized = F.when(F.size(values) == side * side, F.col(values)).otherwise(F.raise_error(F.lit(f"a block has {side} x {side} values")))
    cells = F.filter(F.transform(sized, lambda v, i: F.struct(i.alias("at"), v.cast("double").alias("value"))), lambda c: c["value"].isNotNull())
    return stack.withColumn("cells", cells).drop(values)


def block_median(stack: DataFrame, side: int, keys=GRID) -> DataFrame:
    """Median over dates of each pixel of the blocks, as pixels; the scale form of the composite.

    Whole blocks are shuffled once, by grid, band and block; a pixel's key holds the
    block's, so the medians need no further shuffle.
    """
    by = [*keys, "band", *BLOCK]
    cells = stack.repartition(*by).select(*by, F.inline("cells"))
    medians = cells.groupBy(*by, "at").agg(F.median("value").alias("value"))
    row = (F.col("block_row") * side + F.floor(F.col("at") / side)).cast("int")
    col = (F.col("block_col") * side + F.col("at") % side).cast("int")
    return medians.select(*keys, "band", row.alias("px_row"), col.alias("px_col"), "value")


def scenes_with_mask(scenes: DataFrame, masks: DataFrame) -> DataFrame:
    """Scenes that have a readable mask of their grid and date."""
    return scenes.join(masks, ["mgrs", "acq_date"])


def mask_count_check(masks: DataFrame) -> DataFrame:
    """Grid and date with a number of masks other than one."""
    return masks.groupBy("mgrs", "acq_date").agg(F.count("*").alias("n_masks")).filter("n_masks <> 1")


def grid_reference(scenes: DataFrame, keys=GRID) -> DataFrame:
    """Size of each grid's scenes and how many different sizes they have."""
    size = scenes.groupBy(*keys, "acq_date").agg((F.max("px_row") + 1).alias("height"), (F.max("px_col") + 1).alias("width"))
    return size.groupBy(*keys).agg(F.max("height").alias("height"), F.max("width").alias("width"), F.count_distinct("height", "width").alias("n_sizes"))


def one_reference(scenes: DataFrame, keys=GRID, fields=("epsg", "x0", "y0", "xres", "yres", "height", "width")) -> DataFrame:
    """The CRS, transform and size that all scenes of a grid share; scenes that differ fail."""
    out = scenes.groupBy(*keys).agg(*[F.min(f).alias(f) for f in fields], F.count_distinct(*fields).alias("references"))
    wrong = F.raise_error(F.concat(F.lit("scenes of different references in "), F.concat_ws("/", *keys)))
    first, *rest = fields
    checked = F.when(F.col("references") == 1, F.col(first)).otherwise(wrong.cast(dict(out.dtypes)[first]))
    return out.select(*keys, checked.alias(first), *rest)


def row_slices(obs: DataFrame, n: int, keys=GRID) -> DataFrame:
    """Row range of each pixel when its grid's height is dealt over n slices; every row once."""
    heights = obs.groupBy(*keys).agg((F.max("px_row") + 1).alias("_height"))
    return obs.join(heights, list(keys)).withColumn("slice", F.floor(F.col("px_row") * n / F.col("_height")).cast("int")).drop("_height")


def stack_bands(layers, keys=GRID) -> DataFrame:
    """Layers (keys, px_row, px_col, value) joined by grid and pixel."""
    first, *rest = layers
    for layer in rest:
        first = first.join(layer, [*keys, *PIXEL])
    return first


def stack_columns(pixels: DataFrame, names: dict[str, str], keys=GRID) -> DataFrame:
    """Bands of a long raster side by side, in one scan: pixels that have all of them."""
    held = pixels.filter(F.col("band").isin(list(names)))
    wide = held.groupBy(*keys, *PIXEL).agg(F.count_distinct("band").alias("_n"), *[F.max(F.when(F.col("band") == b, F.col("value"))).alias(n) for b, n in names.items()])
    return wide.filter(F.col("_n") == len(names)).drop("_n")


def append_bands(stack: DataFrame, more: DataFrame, offset: int) -> DataFrame:
    """Long-form band append: band numbers of ``more`` follow those of ``stack``."""
    return stack.unionByName(more.withColumn("band_no", F.col("band_no") + offset))


def mosaic_first(cells: DataFrame, keys, order: str = "source_order", value: str = "elevation") -> DataFrame:
    """One value per cell; where sources overlap the first source wins."""
    return cells.groupBy(*keys).agg(F.min_by(value, F.struct(order, value)).alias(value))


def gradient(dem: DataFrame, step: float, value: str = "elevation", keys=GRID) -> DataFrame:
    """Central differences inside, one-sided at the ends, along rows and columns of each grid.

    Lines of a grid are cut in runs of RUN pixels, each with a halo of one pixel on
    either side, so that a task holds runs and no whole lines.
    """

    def along(frame: DataFrame, line: str, axis: str, name: str) -> DataFrame:
        run = F.floor(F.col(axis) / RUN)
        halo = F.array(F.struct(run.alias("run"), F.lit(True).alias("own")), *[F.struct(F.floor((F.col(axis) + d) / RUN).alias("run"), F.lit(False).alias("own")) for d in (-1, 1)])
        # a pixel is copied only to a neighbouring run that it borders
        copies = F.filter(halo, lambda h: h["own"] | (h["run"] != run))
        spread = frame.select("*", F.inline(copies))
        w = Window.partitionBy(*keys, line, "run").orderBy(axis)
        before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        step_of = F.when(before.isNotNull() & after.isNotNull(), (after - before) / (2 * step)).when(after.isNotNull(), (after - here) / step).otherwise((here - before) / step)
        return spread.withColumn(name, step_of).filter("own").drop("run", "own")

    return along(along(dem, "px_row", "px_col", "gx"), "px_col", "px_row", "gy")


def slope(dem: DataFrame, step: float = 30.87, as_integer: bool = False, keys=GRID) -> DataFrame:
    """Slope in degrees from the gradient; ``as_integer`` truncates."""
    degrees = F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))))
    out = gradient(dem, step, keys=keys).withColumn("slope", degrees)
    return out.withColumn("slope", F.col("slope").cast("int")) if as_integer else out


def resample_nearest(fine: DataFrame, coarse: DataFrame, ratio: float, keys=GRID) -> DataFrame:
    """Each grid's coarse raster read at fine pixels, by the nearest cell centre per axis, first on ties."""
    sizes = coarse.groupBy(*keys).agg((F.max("px_row") + 1).alias("_rows"), (F.max("px_col") + 1).alias("_cols"))

    def index(px: str, n: str) -> Column:
        at = (F.col(px) + 0.5) / ratio - 0.5
        return F.least(F.greatest(F.ceil(at - 0.5), F.lit(0)), F.col(n) - 1).cast("int")

    low = coarse.withColumnsRenamed({"px_row": "c_row", "px_col": "c_col"})
    placed = fine.join(sizes, list(keys)).withColumns({"c_row": index("px_row", "_rows"), "c_col": index("px_col", "_cols")}).drop("_rows", "_cols")
    return placed.join(low, [*keys, "c_row", "c_col"])


def nearest_index(at: Column, origin: Column, step: Column, n: Column) -> Column:
    """Index i below n at which origin + i * step is nearest to ``at``, the first on ties; the step may be negative."""
    guess = F.floor((at - origin) / step)
    near = F.transform(F.array(*[F.least(F.greatest(guess + d, F.lit(0)), n - 1) for d in (-1, 0, 1, 2)]), lambda i: F.struct(F.abs(origin + i * step - at).alias("far"), i.alias("i")))
    return F.array_min(near)["i"].cast("int")


def reprojected_origin(references: DataFrame, epsg: Column) -> DataFrame:
    """References (x0, y0, epsg) with their origin in the coordinates of another UTM zone; steps stay as they are.

    EPSG 4326 holds longitude and latitude.
    """
    made = lambda frame, name, value: frame.select("*", F.inline(F.array(F.struct(value.alias(name)))))  # noqa: E731  read twice, computed once
    geographic = F.struct(F.col("y0").alias("lat"), F.col("x0").alias("lon"))
    placed = made(references, "_g", F.when(F.col("epsg") == 4326, geographic).otherwise(from_utm(F.col("x0"), F.col("y0"), F.col("epsg"))))
    moved = made(placed, "_p", F.when(F.col("epsg") != epsg, to_utm(F.col("_g.lat"), F.col("_g.lon"), epsg)))
    return moved.withColumns({"x0": F.coalesce("_p.x", "x0"), "y0": F.coalesce("_p.y", "y0"), "epsg": epsg}).drop("_p", "_g")


def resample_onto(fine: DataFrame, fine_refs: DataFrame, coarse: DataFrame, coarse_refs: DataFrame, keys=GRID) -> DataFrame:
    """Each grid's coarse raster read at the fine raster's pixels, by the nearest corner per axis, first on ties.

    References (keys, epsg, x0, y0, xres, yres, width, height) name each raster's own origin,
    steps of either sign and projection; a coarse raster of another projection is moved by its
    origin. Both indexes are arithmetic, so the one join is on grid, row and column.
    """
    keys, fields = list(keys), ("x0", "y0", "xres", "yres")
    target = fine_refs.select(*keys, F.col("epsg").alias("_epsg"), *[F.col(c).alias(f"_f{c}") for c in fields])
    both = reprojected_origin(coarse_refs.join(target, keys), F.col("_epsg"))
    both = both.select(*keys, *[f"_f{c}" for c in fields], *[F.col(c).alias(f"_c{c}") for c in (*fields, "width", "height")])
    x, y = F.col("_fx0") + F.col("px_col") * F.col("_fxres"), F.col("_fy0") + F.col("px_row") * F.col("_fyres")
    placed = fine.join(both, keys).withColumns({
        "c_col": nearest_index(x, F.col("_cx0"), F.col("_cxres"), F.col("_cwidth")),
        "c_row": nearest_index(y, F.col("_cy0"), F.col("_cyres"), F.col("_cheight")),
    })
    low = coarse.withColumnsRenamed({"px_row": "c_row", "px_col": "c_col"})
    return placed.drop(*[c for c in both.columns if c not in keys]).join(low, [*keys, "c_row", "c_col"])


def raster_stats(raster: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    return raster.agg(F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.avg(v).alias("mean_value"), F.stddev_pop(v).alias("std_value"))


def _rows_between(low: Column, high: Column) -> Column:
    """The whole numbers from ``low`` to ``high``; none if high is below low."""
    return F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))


def burned(shapes: DataFrame, reach: float = 0.0) -> DataFrame:
    """Pixels whose centre lies in a box grown by ``reach``: found cell by cell, no range join."""
    rows = _rows_between(F.ceil(F.col("y0") - 0.5 - reach), F.floor(F.col("y1") - 0.5 + reach))
    cols = _rows_between(F.ceil(F.col("x0") - 0.5 - reach), F.floor(F.col("x1") - 0.5 + reach))
    return shapes.withColumn("px_row", F.explode(rows)).withColumn("px_col", F.explode(cols))


def edges_of(vertices: Column, closed: bool) -> Column:
    """Edges (x0, y0, x1, y1) between the vertices (x, y) of a line, or of a ring if ``closed``."""
    after = F.concat(F.slice(vertices, F.lit(2), F.greatest(F.size(vertices) - 1, F.lit(0))), F.slice(vertices, 1, 1) if closed else F.slice(vertices, 1, 0))
    pairs = F.filter(F.arrays_zip(vertices.alias("a"), after.alias("b")), lambda p: p["b"].isNotNull())
    return F.transform(pairs, lambda p: F.struct(p["a"]["x"].alias("x0"), p["a"]["y"].alias("y0"), p["b"]["x"].alias("x1"), p["b"]["y"].alias("y1")))


def edges_of_rings(rings: Column) -> Column:
    """Edges of all rings of a polygon: outer rings, holes and further parts alike."""
    return F.flatten(F.transform(rings, lambda r: edges_of(r, True)))


def line_pixels(shapes: DataFrame, vertices: str = "vertices") -> DataFrame:
    """Pixels of thin lines: one a step along an edge's longer axis.

    An edge goes from the pixel of its first vertex to that of its last. With ``long`` steps
    along one axis and ``short`` along the other, the error term starts at half of ``long``,
    loses ``short`` a step and moves the line by a pixel whenever it falls below zero: after
    k steps it has done so ceil((k * short - long div 2) / long) times.
    """
    e = shapes.withColumn("_e", F.explode(edges_of(F.col(vertices), False)))
    e = e.withColumns({f"_{a}{k}": F.floor(F.col(f"_e.{a}{k}")).cast("long") for a in "xy" for k in (0, 1)})
    dx, dy = F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")
    e = e.withColumns({"_long": F.greatest(F.abs(dx), F.abs(dy)), "_short": F.least(F.abs(dx), F.abs(dy))})
    e = e.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_long"))))
    half = F.floor(F.col("_long") / 2)
    shift = F.when(F.col("_long") > 0, F.greatest(F.ceil((F.col("_k") * F.col("_short") - half) / F.col("_long")), F.lit(0))).otherwise(0)
    wide = F.abs(dx) >= F.abs(dy)
    at = {"px_col": F.col("_x0") + F.signum(dx) * F.when(wide, F.col("_k")).otherwise(shift), "px_row": F.col("_y0") + F.signum(dy) * F.when(wide, shift).otherwise(F.col("_k"))}
    return e.withColumns({c: v.cast("int") for c, v in at.items()}).select(*shapes.columns, *PIXEL)


def walked(shapes: DataFrame, vertices: str = "vertices", closed: bool = False) -> DataFrame:
    """Pixels that the edges of a line or ring touch: for each row of an edge, the columns it crosses there."""
    e = shapes.withColumn("_e", F.explode(edges_of(F.col(vertices), closed)))
    low, high = F.least("_e.y0", "_e.y1"), F.greatest("_e.y0", "_e.y1")
    e = e.withColumn("px_row", F.explode(_rows_between(F.floor(low), F.floor(high))))

    def x_at(y: Column) -> Column:
        flat = F.col("_e.y0") == F.col("_e.y1")
        return F.when(flat, F.col("_e.x0")).otherwise(F.col("_e.x0") + (y - F.col("_e.y0")) * (F.col("_e.x1") - F.col("_e.x0")) / (F.col("_e.y1") - F.col("_e.y0")))

    ends = [x_at(F.greatest(low, F.col("px_row").cast("double"))), x_at(F.least(high, F.col("px_row") + 1.0))]
    flat = F.col("_e.y0") == F.col("_e.y1")
    left = F.when(flat, F.least("_e.x0", "_e.x1")).otherwise(F.least(*ends))
    right = F.when(flat, F.greatest("_e.x0", "_e.x1")).otherwise(F.greatest(*ends))
    return e.withColumn("px_col", F.explode(_rows_between(F.floor(left), F.floor(right)))).drop("_e")


def filled(shapes: DataFrame, vertices: str = "vertices", all_touched: bool = False) -> DataFrame:
    """Pixels whose centre lies inside a ring, as ``filled_rings`` of one ring."""
    inside = filled_rings(shapes.withColumn("_rings", F.array(vertices)), "_rings").select(*shapes.columns, *PIXEL)
    return inside.unionByName(walked(shapes, vertices, True).select(*shapes.columns, *PIXEL)) if all_touched else inside


def filled_rings(shapes: DataFrame, rings: str = "rings", all_touched: bool = False) -> DataFrame:
    """Pixels whose centre lies inside a polygon of several rings, by the even-odd rule; ``all_touched`` adds those its edges touch.

    Row by row: the crossings of all rings with the row's centre line, sorted, in pairs, so
    holes are left out and further parts come in.
    """
    levels = F.flatten(F.transform(rings, lambda r: F.transform(r, lambda v: v["y"])))
    bounds = shapes.withColumns({"_edges": edges_of_rings(F.col(rings)), "_low": F.array_min(levels), "_high": F.array_max(levels)})
    rows = bounds.withColumn("px_row", F.explode(_rows_between(F.ceil(F.col("_low") - 0.5), F.floor(F.col("_high") - 0.5))))
    y = F.col("px_row") + 0.5
    crossing = lambda e: (e["y0"] <= y) != (e["y1"] <= y)
    xs = F.array_sort(F.transform(F.filter("_edges", crossing), lambda e: e["x0"] + (y - e["y0"]) * (e["x1"] - e["x0"]) / (e["y1"] - e["y0"])))
    pairs = rows.withColumn("_x", xs).filter(F.size("_x") > 1).withColumn("_i", F.explode(F.sequence(F.lit(0), F.size("_x") - 2, F.lit(2))))
    cols = _rows_between(F.ceil(F.get("_x", F.col("_i")) - 0.5), F.ceil(F.get("_x", F.col("_i") + 1) - 0.5) - 1)
    inside = pairs.withColumn("px_col", F.explode(cols)).select(*shapes.columns, *PIXEL)
    if not all_touched:
        return inside
    one = shapes.withColumn("_ring", F.explode(rings))
    return inside.unionByName(walked(one, "_ring", True).select(*shapes.columns, *PIXEL))


def map_features(features: DataFrame) -> DataFrame:
    """Tagged features with a geometry that are burned: all waterways, and boundaries that are lines."""
    return features.dropna(subset=["tag", "geom_type"]).filter("tag_name = 'waterway' or geom_type = 'LineString'")


def rasterize(pixels: DataFrame, covered: DataFrame, name: str, keys=GRID) -> DataFrame:
    """``pixels`` with a 0/1 column: 1 where ``covered`` (burned, walked or filled shapes) has the grid's pixel."""
    ones = covered.select(*keys, *PIXEL).distinct().withColumn(name, F.lit(1))
    return pixels.join(ones, [*keys, *PIXEL], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def rasterize_tags(pixels: DataFrame, covered: DataFrame, names: dict[str, str], tag: str = "tag_name", keys=GRID) -> DataFrame:
    """``pixels`` with a 0/1 column for each tag of ``names`` (tag: column), all burned in one aggregation and one join."""
    burned_in = covered.filter(F.col(tag).isin(list(names))).groupBy(*keys, *PIXEL)
    ones = burned_in.agg(*[F.max((F.col(tag) == t).cast("int")).alias(c) for t, c in names.items()])
    return pixels.join(ones, [*keys, *PIXEL], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in names.values()})


def cloud_raster(clouds: DataFrame, all_touched: bool = False, keys=GRID) -> DataFrame:
    """Pixels under a cloud polygon of each grid and date: one ring in ``vertices``, or several in ``rings``."""
    burn = filled_rings if "rings" in clouds.columns else filled
    return burn(clouds, all_touched=all_touched).select(*keys, "acq_date", *PIXEL).distinct()
