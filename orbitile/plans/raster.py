"""Queries over scene pixels, composites, terrain and map features."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitile.operators import composite as C
from orbitile.sources.io import composites_of_pending, scratch, write_blocks, write_composite
from orbitile.sources.views import oracle, view

MASKED = "case when value * clear <> 0 and value * clear <= 4000e0 then value * clear end"
MED = f"select mgrs, px_row, px_col, band, median({MASKED}) as value from obs group by mgrs, px_row, px_col, band"
STEP = 30.87
SIDE = 10


def _slope(spark, d):
    return C.slope(view(spark, d, "dem"), STEP)


def median_composite(spark, d):
    return C.median_composite(view(spark, d, "obs"))


def mask_clouds(spark, d):
    return C.mask_clouds(view(spark, d, "obs")).groupBy("band", "acq_date").agg(F.count("*").alias("n"), F.count("value").alias("n_clear"), F.sum("value").alias("total"))


def band_pivot(spark, d):
    return C.band_pivot(view(spark, d, "obs"))


def blocks_to_pixels(spark, d):
    return C.block_median(C.blocks(view(spark, d, "obs"), SIDE), SIDE)


def _scenes(spark, d):
    obs = view(spark, d, "obs")
    return obs.groupBy("mgrs", "acq_date", "band").agg(F.count("*").alias("n_pixels"))


def _masks(spark, d):
    return view(spark, d, "obs").filter("clear = 0").groupBy("mgrs", "acq_date", "band").agg(F.count("*").alias("n_cloudy"))


def scenes_with_mask(spark, d):
    masks = _masks(spark, d).groupBy("mgrs", "acq_date").agg(F.sum("n_cloudy").alias("n_cloudy"))
    return C.scenes_with_mask(_scenes(spark, d), masks).select("mgrs", "acq_date", "band", "n_pixels", "n_cloudy")


def scene_mask_join(spark, d):
    one = _masks(spark, d).filter("band = 'B02'").drop("band")
    return C.scenes_with_mask(_scenes(spark, d), one).select("mgrs", "acq_date", "band", "n_pixels", "n_cloudy")


def mask_count_check(spark, d):
    return C.mask_count_check(_masks(spark, d))


def grid_reference(spark, d):
    return C.grid_reference(view(spark, d, "obs"))


def row_slices(spark, d):
    return C.row_slices(view(spark, d, "obs"), 12).groupBy("mgrs", "slice").agg(F.min("px_row").alias("top"), F.max("px_row").alias("bottom"), F.count("*").alias("n"))


def stack_bands(spark, d):
    med = C.median_composite(view(spark, d, "obs"))
    return C.stack_columns(med, {b: C.BAND_NAMES[b] for b in C.BANDS[:2]})


def append_bands(spark, d):
    med = C.median_composite(view(spark, d, "obs")).withColumn("band_no", F.when(F.col("band") == "B04", 0).otherwise(1)).filter("band in ('B04', 'B03')").select("mgrs", "px_row", "px_col", "band_no", "value")
    dem = view(spark, d, "dem").select("mgrs", "px_row", "px_col", F.lit(0).alias("band_no"), F.col("elevation").alias("value"))
    return C.append_bands(med, dem, 2)


def mosaic_first(spark, d):
    return C.mosaic_first(view(spark, d, "cell"), ["lat", "lon"])


def terrain_gradient(spark, d):
    return C.gradient(view(spark, d, "dem"), STEP).select("mgrs", "px_row", "px_col", F.round("gx", 6).alias("gx"), F.round("gy", 6).alias("gy"))


def slope(spark, d):
    return _slope(spark, d).select("mgrs", "px_row", "px_col", F.round("slope", 6).alias("slope"))


def slope_integer(spark, d):
    return C.slope(view(spark, d, "dem"), STEP, as_integer=True).select("mgrs", "px_row", "px_col", "slope")


def raster_stats(spark, d):
    out = C.raster_stats(_slope(spark, d), "slope")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def resample_nearest(spark, d):
    fine = view(spark, d, "obs").select("mgrs", "px_row", "px_col").distinct()
    return C.resample_nearest(fine, view(spark, d, "dem"), 3.0).select("mgrs", "px_row", "px_col", "elevation")


def osm_filter(spark, d):
    return C.map_features(view(spark, d, "feature")).select("feature_id", "tag_name", "geom_type")


def _burned_features(spark, d):
    """Polygons are filled boxes here, lines the diagonals of theirs, one pixel thin."""
    f = C.map_features(view(spark, d, "feature")).select("mgrs", "tag_name", "geom_type", "x0", "y0", "x1", "y1")
    line = f.filter("geom_type = 'LineString'").withColumn("vertices", F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y1"))]))
    polygon = f.filter("geom_type = 'Polygon'").withColumn("vertices", F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))]))
    columns = ("mgrs", "tag_name", "px_row", "px_col")
    return C.line_pixels(line).select(*columns).union(C.filled(polygon).select(*columns))


def _osm(pixels, covered):
    return C.rasterize_tags(pixels, covered, {"waterway": "water", "boundary": "boundary"})


def osm_raster(spark, d):
    pixels = view(spark, d, "obs").select("mgrs", "px_row", "px_col").distinct()
    return _osm(pixels, _burned_features(spark, d)).select("mgrs", "px_row", "px_col", "water", "boundary")


def _clouds(spark, d):
    ring = F.array(*[F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in "abcd"])
    return view(spark, d, "cloud").select("mgrs", "acq_date", ring.alias("vertices"))


def cloud_raster(spark, d):
    return C.cloud_raster(_clouds(spark, d))


def cloud_raster_touched(spark, d):
    return C.cloud_raster(_clouds(spark, d), all_touched=True)


def _placed(frame):
    """Region and district of each grid."""
    return frame.withColumns({"region": F.when(F.col("mgrs") == "35MRV", "Uganda").otherwise("Rwanda"), "district": F.concat(F.lit("D"), F.substring("mgrs", 1, 2))})


def composite_sink(spark, d):
    """Four bands written by region, district and grid, one grid written again, read back with partition pruning."""
    path = scratch(spark, "composite")
    four = _placed(C.band_pivot(view(spark, d, "obs")))
    write_composite(four, path)
    again = write_composite(four.filter("mgrs = '35MRV'"), path)
    one = again.filter("region = 'Uganda' and district = 'D35'")
    return one.groupBy("region", "district", "mgrs").agg(F.count("*").alias("n"), *[F.sum(b).alias(b) for b in C.BAND_NAMES.values()])


def _eight(spark, d, obs, grids=None):
    """Eight layers of each pixel in one plan: medians, water, boundary, elevation, slope; of some grids only, if named."""
    of = (lambda frame: frame.join(F.broadcast(grids), "mgrs", "left_semi")) if grids is not None else (lambda frame: frame)
    terrain = C.slope(of(view(spark, d, "dem")), STEP).select("mgrs", "px_row", "px_col", F.round("elevation", 6).alias("elevation"), F.round("slope", 6).alias("slope"))
    # the composite's own pixels are the ones map features are burned into
    return C.stack_bands([_osm(C.band_pivot(obs), of(_burned_features(spark, d))), terrain])


def multivariate_sink(spark, d):
    """Eight bands written by region, district and grid in two runs; the second reads and computes only what the first left."""
    path, log, stored = (scratch(spark, name) for name in ("multivariate", "finished", "observations"))
    view(spark, d, "obs").write.partitionBy("mgrs").parquet(stored)
    obs = spark.read.parquet(stored)
    wanted = _placed(obs.select("mgrs").distinct())
    build = lambda work, grids: _eight(spark, d, work, grids)
    composites_of_pending(obs, wanted.filter("mgrs = '36MGR'"), build, path, log)
    every = composites_of_pending(obs, wanted, build, path, log)
    bands = [c for c in every.columns if c not in ("region", "district", "mgrs", "px_row", "px_col")]
    return every.groupBy("region", "district", "mgrs").agg(F.count("*").alias("n"), *[F.round(F.sum(b), 3).alias(b) for b in bands])


def multivariate_composite(spark, d):
    return _eight(spark, d, view(spark, d, "obs"))


def block_composite(spark, d):
    """Block arrays by grid and band, their one reference, the median of their dates, pixels with coordinates."""
    blocks = view(spark, d, "block")
    values = F.transform("values", lambda v: F.when(v > -0.2, v.cast("double")))
    stored = write_blocks(blocks.withColumn("values", values), scratch(spark, "blocks"))
    red = stored.filter("band = 'B04'")
    reference = C.one_reference(red)
    pixels = C.block_median(C.blocks_of_arrays(red, 8), 8).join(F.broadcast(reference), "mgrs")  # one row a grid
    x, y = F.col("x0") + F.col("px_col") * F.col("xres"), F.col("y0") + F.col("px_row") * F.col("yres")
    return pixels.select("mgrs", "epsg", "px_row", "px_col", x.alias("x"), y.alias("y"), F.round("value", 6).alias("value"))


GRAD = f"""select mgrs, px_row, px_col, elevation,
 case when lag(elevation) over r is not null and lead(elevation) over r is not null then (lead(elevation) over r - lag(elevation) over r) / {2 * STEP}e0
      when lead(elevation) over r is not null then (lead(elevation) over r - elevation) / {STEP}e0 else (elevation - lag(elevation) over r) / {STEP}e0 end as gx,
 case when lag(elevation) over c is not null and lead(elevation) over c is not null then (lead(elevation) over c - lag(elevation) over c) / {2 * STEP}e0
      when lead(elevation) over c is not null then (lead(elevation) over c - elevation) / {STEP}e0 else (elevation - lag(elevation) over c) / {STEP}e0 end as gy
 from dem window r as (partition by mgrs, px_row order by px_col), c as (partition by mgrs, px_col order by px_row)"""
SLOPE = f"select mgrs, px_row, px_col, elevation, degrees(atan(sqrt(gx * gx + gy * gy))) as slope from ({GRAD}) g"
SCENES = "select mgrs, acq_date, band, count(*) as n_pixels from obs group by all"
MASKS = "select mgrs, acq_date, band, count(*) as n_cloudy from obs where clear = 0 group by all"
FEATURES = "select * from feature where tag is not null and geom_type is not null and (tag_name = 'waterway' or geom_type = 'LineString')"
BOXES = """select mgrs, tag_name, cast(r as int) as px_row, cast(c as int) as px_col from (select unnest(range(cast(ceil(y0 - 0.5) as int), cast(ceil(y1 - 0.5) as int))) as r, * from ({f}) f where geom_type = 'Polygon') a,
 lateral (select unnest(range(cast(ceil(x0 - 0.5) as int), cast(ceil(x1 - 0.5) as int))) as c) b"""
#: Pixels of an edge (ax, ay) to (tx, by) that is not level: row by row, from where it enters the row to where it leaves.
WALK = """select {k}, cast(r as int) as px_row, cast(c as int) as px_col from (select *, ax + (greatest(least(ay, ty), r) - ay) * (tx - ax) / (ty - ay) as ea, ax + (least(greatest(ay, ty), r + 1e0) - ay) * (tx - ax) / (ty - ay) as eb
 from (select *, unnest(range(cast(floor(least(ay, ty)) as int), cast(floor(greatest(ay, ty)) as int) + 1)) as r from ({e}) e) q) a,
 lateral (select unnest(range(cast(floor(least(ea, eb)) as int), cast(floor(greatest(ea, eb)) as int) + 1)) as c) b"""
#: Thin lines by the error term, a step at a time.
LINES = f"""select distinct mgrs, tag_name, px_row, px_col from (with recursive line(mgrs, tag_name, px_col, px_row, err, along, down, steps) as (
 select mgrs, tag_name, cast(floor(x0) as int), cast(floor(y0) as int), cast(greatest(floor(x1) - floor(x0), floor(y1) - floor(y0)) as int) // 2, cast(floor(x1) - floor(x0) as int), cast(floor(y1) - floor(y0) as int),
  cast(greatest(floor(x1) - floor(x0), floor(y1) - floor(y0)) as int) from ({FEATURES}) where geom_type = 'LineString'
 union all select mgrs, tag_name, px_col + case when along >= down or err - along < 0 then 1 else 0 end, px_row + case when along < down or err - down < 0 then 1 else 0 end,
  err - least(along, down) + case when err - least(along, down) < 0 then greatest(along, down) else 0 end, along, down, steps - 1 from line where steps > 0)
 select * from line)"""
BURNED = f"{BOXES.format(f=FEATURES)} union {LINES}"
OSM = f"""select p.mgrs, p.px_row, p.px_col, cast(w.px_row is not null as int) as water, cast(b.px_row is not null as int) as boundary
 from (select distinct mgrs, px_row, px_col from obs) p
 left join (select distinct mgrs, px_row, px_col from ({BURNED}) where tag_name = 'waterway') w on p.mgrs = w.mgrs and p.px_row = w.px_row and p.px_col = w.px_col
 left join (select distinct mgrs, px_row, px_col from ({BURNED}) where tag_name = 'boundary') b on p.mgrs = b.mgrs and p.px_row = b.px_row and p.px_col = b.px_col"""
_EDGES = [f"({p[0]} as ax, {p[1]} as ay, {q[0]} as tx, {q[1]} as ty)" for p, q in ((("xa", "ya"), ("xb", "yb")), (("xb", "yb"), ("xc", "yc")), (("xc", "yc"), ("xd", "yd")), (("xd", "yd"), ("xa", "ya")))]
EDGES = " union all ".join(f"select mgrs, acq_date, {e[1:-1]} from cloud" for e in _EDGES)
_CROSS = " + ".join(f"case when ({a[1]} <= r + 0.5e0) <> ({b[1]} <= r + 0.5e0) and {a[0]} + (r + 0.5e0 - {a[1]}) * ({b[0]} - {a[0]}) / ({b[1]} - {a[1]}) > c + 0.5e0 then 1 else 0 end"
                    for a, b in ((("xa", "ya"), ("xb", "yb")), (("xb", "yb"), ("xc", "yc")), (("xc", "yc"), ("xd", "yd")), (("xd", "yd"), ("xa", "ya"))))
INSIDE = f"""select distinct mgrs, acq_date, cast(r as int) as px_row, cast(c as int) as px_col from (select *, unnest(range(cast(floor(least(ya, yb, yc, yd)) as int), cast(ceil(greatest(ya, yb, yc, yd)) as int) + 1)) as r from cloud) a,
 lateral (select unnest(range(cast(floor(least(xa, xb, xc, xd)) as int), cast(ceil(greatest(xa, xb, xc, xd)) as int) + 1)) as c) b where ({_CROSS}) % 2 = 1"""
PIVOT = "select mgrs, px_row, px_col, " + ", ".join(f"median(case when band = '{b}' then {MASKED} end) as {n}" for b, n in C.BAND_NAMES.items()) + " from obs group by mgrs, px_row, px_col"
MULTI = f"""select a.mgrs, a.px_row, a.px_col, red, green, blue, nir, water, boundary, round(elevation, 6) as elevation, round(slope, 6) as slope
        from ({PIVOT}) a join ({OSM}) o on a.mgrs = o.mgrs and a.px_row = o.px_row and a.px_col = o.px_col join ({SLOPE}) t on a.mgrs = t.mgrs and a.px_row = t.px_row and a.px_col = t.px_col"""

BLOCKS = """select mgrs, epsg, px_row, px_col, x0 + px_col * xres as x, y0 + px_row * yres as y, round(median(v), 6) as value from
 (select mgrs, epsg, x0, y0, xres, yres, cast(block_row * 8 + (i - 1) // 8 as int) as px_row, cast(block_col * 8 + (i - 1) % 8 as int) as px_col, cast(values[i] as double) as v from (select *, unnest(range(1, 65)) as i from block where band = 'B04') b)
 where v > cast(-0.2 as double) group by all"""

QUERIES = {
    "median_composite": (median_composite, oracle(MED, "obs")),
    "mask_clouds": (mask_clouds, oracle(f"select band, acq_date, count(*) as n, count({MASKED}) as n_clear, sum({MASKED}) as total from obs group by all", "obs")),
    "band_pivot": (band_pivot, oracle(PIVOT, "obs")),
    "blocks_to_pixels": (blocks_to_pixels, oracle(f"select mgrs, band, px_row, px_col, median(v) as value from (select mgrs, band, px_row, px_col, acq_date, median({MASKED}) as v from obs group by all) group by all having median(v) is not null", "obs")),
    "scenes_with_mask": (scenes_with_mask, oracle(f"select s.mgrs, s.acq_date, s.band, n_pixels, n_cloudy from ({SCENES}) s join (select mgrs, acq_date, cast(sum(n_cloudy) as bigint) as n_cloudy from ({MASKS}) group by all) m using (mgrs, acq_date)", "obs")),
    "scene_mask_join": (scene_mask_join, oracle(f"select s.mgrs, s.acq_date, s.band, n_pixels, n_cloudy from ({SCENES}) s join (select mgrs, acq_date, n_cloudy from ({MASKS}) where band = 'B02') m using (mgrs, acq_date)", "obs")),
    "mask_count_check": (mask_count_check, oracle(f"select mgrs, acq_date, count(*) as n_masks from ({MASKS}) group by all having count(*) <> 1", "obs")),
    "grid_reference": (grid_reference, oracle("select mgrs, max(h) as height, max(w) as width, count(distinct (h, w)) as n_sizes from (select mgrs, acq_date, max(px_row) + 1 as h, max(px_col) + 1 as w from obs group by all) group by mgrs", "obs")),
    "row_slices": (row_slices, oracle("select mgrs, cast(floor(px_row * 12 / h) as int) as slice, min(px_row) as top, max(px_row) as bottom, count(*) as n from obs join (select mgrs, max(px_row) + 1 as h from obs group by mgrs) using (mgrs) group by 1, 2", "obs")),
    "stack_bands": (stack_bands, oracle(f"select a.mgrs, a.px_row, a.px_col, a.value as red, b.value as green from ({MED}) a join ({MED}) b on a.mgrs = b.mgrs and a.px_row = b.px_row and a.px_col = b.px_col and a.band = 'B04' and b.band = 'B03'", "obs")),
    "append_bands": (append_bands, oracle(f"select mgrs, px_row, px_col, case band when 'B04' then 0 else 1 end as band_no, value from ({MED}) where band in ('B04', 'B03') union all select mgrs, px_row, px_col, 2, elevation from dem", "obs", "dem")),
    "mosaic_first": (mosaic_first, oracle("select lat, lon, arg_min(elevation, source_order * 1000000e0 + elevation) as elevation from cell group by all", "cell")),
    "terrain_gradient": (terrain_gradient, oracle(f"select mgrs, px_row, px_col, round(gx, 6) as gx, round(gy, 6) as gy from ({GRAD})", "dem")),
    "slope": (slope, oracle(f"select mgrs, px_row, px_col, round(slope, 6) as slope from ({SLOPE})", "dem")),
    "slope_integer": (slope_integer, oracle(f"select mgrs, px_row, px_col, cast(trunc(slope) as int) as slope from ({SLOPE})", "dem")),
    "raster_stats": (raster_stats, oracle(f"select round(min(slope), 6) as min_value, round(max(slope), 6) as max_value, round(avg(slope), 6) as mean_value, round(stddev_pop(slope), 6) as std_value from ({SLOPE})", "dem")),
    "resample_nearest": (resample_nearest, oracle("""select f.mgrs, f.px_row, f.px_col, elevation from (select distinct o.mgrs, px_row, px_col,
        cast(least(greatest(ceil((px_row + 0.5e0) / 3e0 - 0.5e0 - 0.5e0), 0), z.h - 1) as int) as cr, cast(least(greatest(ceil((px_col + 0.5e0) / 3e0 - 0.5e0 - 0.5e0), 0), z.w - 1) as int) as cc
        from obs o join (select mgrs, max(px_row) + 1 as h, max(px_col) + 1 as w from dem group by mgrs) z on o.mgrs = z.mgrs) f
        join dem on dem.mgrs = f.mgrs and dem.px_row = cr and dem.px_col = cc""", "obs", "dem")),
    "osm_filter": (osm_filter, oracle(f"select feature_id, tag_name, geom_type from ({FEATURES})", "feature")),
    "osm_raster": (osm_raster, oracle(OSM, "obs", "feature")),
    "cloud_raster": (cloud_raster, oracle(INSIDE, "cloud")),
    "cloud_raster_touched": (cloud_raster_touched, oracle(f"{INSIDE} union {WALK.format(k='mgrs, acq_date', e=EDGES)}", "cloud")),
    "block_composite": (block_composite, oracle(BLOCKS, "block")),
    "composite_sink": (composite_sink, oracle(f"select 'Uganda' as region, 'D35' as district, mgrs, count(*) as n, sum(red) as red, sum(green) as green, sum(blue) as blue, sum(nir) as nir from ({PIVOT}) where mgrs = '35MRV' group by mgrs", "obs")),
    "multivariate_sink": (multivariate_sink, oracle(f"select case when mgrs = '35MRV' then 'Uganda' else 'Rwanda' end as region, concat('D', mgrs[1:2]) as district, mgrs, count(*) as n, {', '.join(f'round(sum({b}), 3) as {b}' for b in ('red', 'green', 'blue', 'nir', 'water', 'boundary', 'elevation', 'slope'))} from ({MULTI}) group by mgrs", "obs", "feature", "dem")),
    "multivariate_composite": (multivariate_composite, oracle(MULTI, "obs", "feature", "dem")),
}
