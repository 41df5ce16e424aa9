"""Queries over shapes, references and rasters on the ground: covers, labels in degrees, resampling, mosaics, date ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitile.operators import composite as C
from orbitile.operators import cover
from orbitile.operators import regions as R
from orbitile.plans.places import CELLS, NAME, _forward, _inverse
from orbitile.sources.io import read_registry, scratch
from orbitile.sources.views import oracle, view

SIDE = 10


def _rings(letters: str):
    """Rings of three corners each."""
    vertex = lambda k: F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"))
    return F.array(*[F.array(*[vertex(k) for k in letters[i : i + 3]]) for i in range(0, len(letters), 3)])


def _areas(spark, d):
    return view(spark, d, "area").select("mgrs", "area_id", "acq_date", _rings("abcdef").alias("rings"))


def area_raster(spark, d):
    """Pixels of polygons with a hole and of polygons of two parts."""
    return C.cloud_raster(_areas(spark, d))


def area_raster_touched(spark, d):
    return C.cloud_raster(_areas(spark, d), all_touched=True)


def truth_in_polygon(spark, d):
    return cover.points_in_polygons(view(spark, d, "truth"), _areas(spark, d)).select("area_id", "bridge_id")


def label_tiles_degrees(spark, d):
    """Labels of tiles from latitude and longitude, for all grids of both zones."""
    return cover.label_tiles_degrees(view(spark, d, "truth_deg"), view(spark, d, "grid_ref")).select("mgrs", "x_min", "y_min", "bridge_id")


def resample_onto(spark, d):
    """The elevation rasters, by their own origin, step and zone, at the composites' pixels."""
    refs = view(spark, d, "raster_ref")
    fine, coarse = (refs.filter(F.col("kind") == k).drop("kind") for k in ("fine", "coarse"))
    dem = view(spark, d, "dem")
    sizes = dem.groupBy("mgrs").agg((F.max("px_row") + 1).alias("height"), (F.max("px_col") + 1).alias("width"))
    coarse = coarse.drop("height", "width").join(sizes, "mgrs")
    pixels = view(spark, d, "obs").select("mgrs", "px_row", "px_col").distinct()
    return C.resample_onto(pixels, fine, dem, coarse).select("mgrs", "px_row", "px_col", "elevation")


def dem_mosaic(spark, d):
    out = R.dem_mosaic(view(spark, d, "meridian_box"), view(spark, d, "cell_raster"), 5000.0, SIDE)
    return out.select("district", "px_row", "px_col", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "elevation")


def registry_ranges(spark, d):
    """Days of each district from text of the registry's own shape, one line a district: lists of ranges by region, some overlapping."""
    registry = view(spark, d, "registry")
    text = lambda day, more: F.date_add(day, more).cast("string")
    first, last = F.min("date_from"), F.max("date_to")
    ranges = F.array(F.array(text(first, 0), text(first, 10)), F.array(text(first, 5), text(first, 12)), F.array(text(last, -2), text(last, 0)))
    entry = F.struct(F.array(*R.BOX).alias("bbox"), F.col("ground_truth"))
    districts = registry.join(registry.groupBy("region").agg(ranges.alias("dates")), "region").withColumn("districts", F.create_map("district", entry))
    path = scratch(spark, "ranges")
    districts.select(F.to_json(F.create_map("region", F.struct("dates", "districts"))).alias("value")).write.text(path)
    return R.date_prefixes(read_registry(spark, path)).select("region", "district", "day", "prefix")


_EDGES = [(f"x{a}", f"y{a}", f"x{b}", f"y{b}") for a, b in ("ab", "bc", "ca", "de", "ef", "fd")]


def _rays(x: str, y: str) -> str:
    """SQL of how many edges of an area lie right of a point on its level."""
    return " + ".join(f"case when ({ay} <= {y}) <> ({by} <= {y}) and {ax} + ({y} - {ay}) * ({bx} - {ax}) / ({by} - {ay}) > {x} then 1 else 0 end" for ax, ay, bx, by in _EDGES)


AREA_PIXELS = f"""select distinct mgrs, acq_date, cast(r as int) as px_row, cast(c as int) as px_col from (select *, unnest(range(cast(floor(least(ya, yb, yc, yd, ye, yf)) as int), cast(ceil(greatest(ya, yb, yc, yd, ye, yf)) as int) + 1)) as r from area) a,
 lateral (select unnest(range(cast(floor(least(xa, xb, xc, xd, xe, xf)) as int), cast(ceil(greatest(xa, xb, xc, xd, xe, xf)) as int) + 1)) as c) b where ({_rays('(c + 0.5e0)', '(r + 0.5e0)')}) % 2 = 1"""
#: An edge touches a pixel where their ranges overlap and the pixel's corners are not all on one side of it.
_SIDES = ["(tx - ax) * ({y} - ay) - (ty - ay) * ({x} - ax)".format(x=x, y=y) for x in ("c", "(c + 1)") for y in ("r", "(r + 1)")]
TOUCHED = f"""select distinct mgrs, acq_date, cast(r as int) as px_row, cast(c as int) as px_col from
 (select *, unnest(range(cast(floor(least(ay, ty)) as int), cast(floor(greatest(ay, ty)) as int) + 1)) as r from ({' union all '.join(f'select mgrs, acq_date, {ax} as ax, {ay} as ay, {bx} as tx, {by} as ty from area' for ax, ay, bx, by in _EDGES)}) e) a,
 lateral (select unnest(range(cast(floor(least(ax, tx)) as int), cast(floor(greatest(ax, tx)) as int) + 1)) as c) b where least({', '.join(_SIDES)}) <= 0 and greatest({', '.join(_SIDES)}) >= 0"""

_CORNERS = ((0, 0), (1, 0), (1, 1), (0, 1))


def _quad(prefix: str, w: str, h: str) -> str:
    """SQL columns lat and lon of the corners of a box of w x h pixels at (x_min, y_min)."""
    out = []
    for k, (i, j) in enumerate(_CORNERS):
        lat, lon = _inverse(f"(x0 + (x_min + {i} * {w}) * res)", f"(y0 - (y_min + {j} * {h}) * res)", "epsg")
        out += [f"{lat} as {prefix}a{k}", f"{lon} as {prefix}o{k}"]
    return ", ".join(out)


def _within(prefix: str) -> str:
    """SQL of whether (lat, lon) lies strictly inside a convex quadrilateral whose corners go clockwise."""
    turn = lambda p, q: f"({prefix}o{q} - {prefix}o{p}) * (lat - {prefix}a{p}) - ({prefix}a{q} - {prefix}a{p}) * (lon - {prefix}o{p}) < 0"
    box = f"lat > least({', '.join(f'{prefix}a{k}' for k in range(4))}) and lat < greatest({', '.join(f'{prefix}a{k}' for k in range(4))})"
    return box + " and " + " and ".join(turn(k, (k + 1) % 4) for k in range(4))


DEGREES = f"""select mgrs, cast(x_min as int) as x_min, cast(y_min as int) as y_min, min(bridge_id) as bridge_id from truth_deg join
 (select o.*, {_quad('t', 'step', 'step')} from (select g.*, x_min, y_min from (select *, unnest(range(0, width, step)) as x_min from
   (select f.*, {_quad('g', 'width', 'height').replace('x_min', '0').replace('y_min', '0')} from grid_ref f) q) g, lateral (select unnest(range(0, height, step)) as y_min) b) o) t
 on {_within('g')} and {_within('t')} group by all"""

_rx, _ry = _forward("lat", "lon", "fepsg")
_rlat, _rlon = _inverse("x0", "y0", "epsg")
REFERENCES = f"""select f.mgrs, f.x0 as fx, f.y0 as fy, f.xres as fxres, f.yres as fyres, case when c.epsg = f.epsg then c.x0 else {_rx.replace('lat', 'p.lat').replace('lon', 'p.lon').replace('fepsg', 'f.epsg')} end as cx,
 case when c.epsg = f.epsg then c.y0 else {_ry.replace('lat', 'p.lat').replace('lon', 'p.lon').replace('fepsg', 'f.epsg')} end as cy, c.xres as cxres, c.yres as cyres
 from raster_ref f join raster_ref c on f.mgrs = c.mgrs and f.kind = 'fine' and c.kind = 'coarse' join (select mgrs, {_rlat} as lat, {_rlon} as lon from raster_ref where kind = 'coarse') p on p.mgrs = c.mgrs"""


def _axis(px: str, fine: str, fres: str, coarse: str, cres: str) -> str:
    """SQL of the nearest coarse index of each fine one, by comparing all of them."""
    return f"""select mgrs, f, arg_min(c, struct_pack(far := far, c := c)) as c from (select z.mgrs, z.f, y.c, abs(r.{coarse} + y.c * r.{cres} - (r.{fine} + z.f * r.{fres})) as far
 from (select distinct mgrs, {px} as f from obs) z join (select distinct mgrs, {px} as c from dem) y on z.mgrs = y.mgrs join refs r on r.mgrs = z.mgrs) group by mgrs, f"""


RESAMPLED = f"""with refs as ({REFERENCES}), rows_of as ({_axis('px_row', 'fy', 'fyres', 'cy', 'cyres')}), cols_of as ({_axis('px_col', 'fx', 'fxres', 'cx', 'cxres')})
select p.mgrs, p.px_row, p.px_col, elevation from (select distinct mgrs, px_row, px_col from obs) p join rows_of r on r.mgrs = p.mgrs and r.f = p.px_row join cols_of c on c.mgrs = p.mgrs and c.f = p.px_col
join dem on dem.mgrs = p.mgrs and dem.px_row = r.c and dem.px_col = c.c"""

_GROWN = "(select district, " + ", ".join(f"{c} {'+' if 'max' in c else '-'} {5000 / 111000}e0 as {c}" for c in R.BOX) + " from meridian_box) z"
MOSAIC = f"""with near as (select district, {NAME} as cell from ({CELLS.format(t=_GROWN)})),
p as (select n.district, (89 - r.lat) * {SIDE} + r.px_row as g_row, (r.lon + 180) * {SIDE} + r.px_col as g_col, r.* from near n join cell_raster r on r.cell = n.cell),
tops as (select district, min((89 - lat) * {SIDE}) as top, min((lon + 180) * {SIDE}) as lft from p group by district),
best as (select *, row_number() over (partition by district, g_row, g_col order by source_order, cell, elevation) as k from p where elevation is not null)
select b.district, b.g_row - t.top as px_row, b.g_col - t.lft as px_col, round(b.g_col / {SIDE}e0 - 180, 6) as lon, round(90 - b.g_row / {SIDE}e0, 6) as lat, b.elevation from best b join tops t on t.district = b.district where k = 1"""

RANGES = """with s as (select region, min(date_from) as a, max(date_to) as z from registry group by region),
r as (select region, a as f, a + 10 as t from s union all select region, a + 5, a + 12 from s union all select region, z - 2, z from s),
days as (select distinct region, cast(unnest(generate_series(cast(f as timestamp), cast(t as timestamp), interval 1 day)) as date) as day from r)
select registry.region, district, day, concat('/', year(day), '/', month(day), '/', day(day), '/') as prefix from registry join days on days.region = registry.region"""

QUERIES = {
    "area_raster": (area_raster, oracle(AREA_PIXELS, "area")),
    "area_raster_touched": (area_raster_touched, oracle(f"{AREA_PIXELS} union {TOUCHED}", "area")),
    "truth_in_polygon": (truth_in_polygon, oracle(f"select area_id, bridge_id from area join truth on area.mgrs = truth.mgrs and ({_rays('x', 'y')}) % 2 = 1", "area", "truth")),
    "label_tiles_degrees": (label_tiles_degrees, oracle(DEGREES, "truth_deg", "grid_ref")),
    "resample_onto": (resample_onto, oracle(RESAMPLED, "obs", "dem", "raster_ref")),
    "dem_mosaic": (dem_mosaic, oracle(MOSAIC, "meridian_box", "cell_raster")),
    "registry_ranges": (registry_ranges, oracle(RANGES, "registry")),
}
