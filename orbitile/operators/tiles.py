"""Tiles: window grids, tensors, normalisation, boxes, labels and duplicate removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitile.functions.geo import from_utm
from orbitile.operators.composite import GRID

#: Layers in cube order and their scales (fixed values).
LAYERS = ("red", "green", "blue", "nir", "osm-water", "osm-boundary", "elevation", "slope")
MAX_RGB, MAX_IR, MAX_ELEVATION, MAX_SLOPE = 4000.0, 4000.0, 8000.0, 90.0


def clip01(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def normalized(layer: str, v: Column) -> Column:
    """A layer's value scaled to 0..1; water and boundary layers must be there already."""
    if layer in ("osm-water", "osm-boundary"):
        return F.when(v.between(0, 1), v).otherwise(F.raise_error(F.lit(f"{layer} outside 0..1")))
    most = {"elevation": MAX_ELEVATION, "slope": MAX_SLOPE, "nir": MAX_IR}.get(layer, MAX_RGB)
    return clip01(v / most)


def scaled_rgb(v: Column) -> Column:
    """A colour value as a share of the greatest unsaturated one, not clipped."""
    return v / MAX_RGB


def preview(v: Column) -> Column:
    """A colour value as a whole number 0 to 255."""
    return (clip01(scaled_rgb(v)) * 255).cast("int")


def union_matches(*parts: DataFrame) -> DataFrame:
    """Tile-match rows of several regions; columns that a region lacks, as its truth, are null."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first


def tile_origins(sizes: DataFrame, step: int) -> DataFrame:
    """``sizes(width, height)``: one row a tile, x outer and y inner."""
    xs = F.sequence(F.lit(0), F.col("width") - 1, F.lit(step))
    ys = F.sequence(F.lit(0), F.col("height") - 1, F.lit(step))
    return sizes.withColumn("x_min", F.explode(xs)).withColumn("y_min", F.explode(ys))


def tile_tensor(pixels: DataFrame, step: int, value: str, keys=GRID) -> DataFrame:
    """Values of each grid's tile windows as arrays, row-major."""
    at = {"x_min": (F.floor(F.col("px_col") / step) * step).cast("int"), "y_min": (F.floor(F.col("px_row") / step) * step).cast("int")}
    cells = F.array_sort(F.collect_list(F.struct("px_row", "px_col", value)))
    return pixels.withColumns(at).groupBy(*keys, "x_min", "y_min").agg(F.transform(cells, lambda c: c[value]).alias("tensor"))


def select_layers(tiles: DataFrame, names, pixels: int, tensor: str = "tensor") -> DataFrame:
    """One to three layers of a layer-major tensor, by name; an unknown name fails."""
    if not 0 < len(names) <= 3:
        raise ValueError("one to three layers")
    at = [LAYERS.index(n) for n in names]
    return tiles.withColumn(tensor, F.concat(*[F.slice(tensor, i * pixels + 1, pixels) for i in at]))


def tile_bbox(tiles: DataFrame, x0: float, y0: float, res: float, epsg: int) -> DataFrame:
    """Corners tl, tr, br, bl of each tile as (lat, lon), from projected origins."""

    def corner(dx: int, dy: int) -> Column:
        x = F.col("x_min") * res + F.lit(x0) + F.col("step") * res * dx
        y = F.lit(y0) - F.col("y_min") * res - F.col("step") * res * dy
        return from_utm(x, y, F.lit(epsg))

    return tiles.withColumn("bbox", F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)))


def label_tiles(points: DataFrame, step: float, keys=GRID) -> DataFrame:
    """The first point strictly inside each grid's tile: tile index by arithmetic, no range join."""
    inside = points.withColumns({"tx": F.floor(F.col("x") / step).cast("int"), "ty": F.floor(F.col("y") / step).cast("int")})
    inside = inside.filter((F.col("x") > F.col("tx") * step) & (F.col("y") > F.col("ty") * step))
    first = F.min_by(F.struct(*[c for c in inside.columns if c not in {*keys, "tx", "ty"}]), "bridge_id")
    return inside.groupBy(*keys, "tx", "ty").agg(first.alias("first")).select(*keys, "tx", "ty", "first.*")


def dedupe_truth(match: DataFrame, order: str = "seq") -> DataFrame:
    """Of positive rows with one location the first stays; negative rows and those without a location all stay."""
    located = F.coalesce(F.col("is_bridge"), F.lit(False)) & F.col("bridge_loc").isNotNull()
    w = Window.partitionBy("bridge_loc").orderBy(order)
    first = match.filter(located).withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")
    return first.unionByName(match.filter(~located))


def parse_bbox(text: Column) -> Column:
    """Box text to an array of (lon, lat) vertices; null unless it holds four pairs."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))
    pair = lambda i: F.struct(F.get(numbers, F.lit(2 * i + 1)).alias("lon"), F.get(numbers, F.lit(2 * i)).alias("lat"))
    whole = text.rlike(r"^\(\([^()]*\), \([^()]*\), \([^()]*\), \([^()]*\)\)$")
    return F.when(whole & (F.size(numbers) == 8), F.array(*[pair(i) for i in range(4)]))


def polygon_wkt(vertices: Column) -> Column:
    """Closed polygon text of an array of (lon, lat) vertices."""
    point = lambda v: F.concat_ws(" ", v["lon"].cast("string"), v["lat"].cast("string"))
    ring = F.concat(vertices, F.array(F.get(vertices, F.lit(0))))
    return F.concat(F.lit("POLYGON (("), F.array_join(F.transform(ring, point), ", "), F.lit("))"))


def augment_flip(tiles: DataFrame, key: Column, rows: int, cols: int, tensor: str = "tensor") -> DataFrame:
    """Vertical and horizontal flips of each layer of a layer-major tensor, chosen by two bits of ``key``."""

    def layer(at: Column) -> Column:
        grid = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.slice(tensor, at * (rows * cols) + r * cols + 1, cols))
        up = F.when(key.bitwiseAND(F.lit(1)) == 1, F.reverse(grid)).otherwise(grid)
        across = F.when(key.bitwiseAND(F.lit(2)) == 2, F.transform(up, F.reverse)).otherwise(up)
        return F.flatten(across)

    layers = F.sequence(F.lit(0), F.floor((F.size(tensor) - 1) / (rows * cols)).cast("int"))
    return tiles.withColumn(tensor, F.flatten(F.transform(layers, layer)))


def channel_first(tensor: Column, channels: int, pixels: int) -> Column:
    """Pixel-major array (pixel, channel) to channel-major (channel, pixel)."""
    return F.transform(F.sequence(F.lit(0), F.lit(channels * pixels - 1)), lambda i: F.get(tensor, ((i % pixels) * channels + F.floor(i / pixels)).cast("int")))
