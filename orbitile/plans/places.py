"""Queries over regions, grids, dates, coordinates, tiles and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitile.functions import geo as G
from orbitile.operators import cover
from orbitile.operators import regions as R
from orbitile.operators import tiles as T
from orbitile.sources.io import numeric_keys, read_registry, scratch
from orbitile.sources.io import tile_match_levels as levels
from orbitile.sources.views import oracle, view

#: Corners of slanted grids: columns of the box and what is added.
SLANTED = (("min_lon", "min_lat", 0.5, -0.6), ("max_lon", "min_lat", 0.7, 0.5), ("max_lon", "max_lat", -0.4, 0.7), ("min_lon", "max_lat", -0.8, -0.4))
BOX = "min_lon, min_lat, max_lon, max_lat"
X0, Y0, RES, EPSG = 300000.0, 9900040.0, 10.0, 32735


def region_registry(spark, d):
    """Written as the nested text of a registry file, one line a district, and read again."""
    box = F.array(*R.BOX)
    days = F.array(F.col("date_from").cast("string"), F.col("date_to").cast("string"))
    entry = F.struct(box.alias("bbox"), days.alias("dates"), F.col("ground_truth"))
    districts = F.create_map("district", entry).alias("districts")
    path = scratch(spark, "registry")
    view(spark, d, "registry").select(F.to_json(F.create_map("region", F.struct(districts))).alias("value")).write.text(path)
    return read_registry(spark, path).drop("ranges")


def requested_locations(spark, d):
    return R.requested(view(spark, d, "registry"), regions=["AFRICA", "ASIA"]).select("region", "district")


def bbox_buffer(spark, d):
    out = R.buffered(view(spark, d, "registry"), 5000.0)
    return out.select("district", *[F.round(c, 6).alias(c) for c in R.BOX])


def region_has_truth(spark, d):
    return R.region_has_truth(view(spark, d, "registry"))


def date_prefixes(spark, d):
    return R.date_prefixes(view(spark, d, "registry")).select("district", "day", "prefix")


def grid_parts(spark, d):
    return R.grid_parts(view(spark, d, "grid")).select("grid_id", "utm", "band", "square", "prefix")


def grid_filter(spark, d):
    return R.of_grids(view(spark, d, "grid"), ["10MRV", "13mrv", "11MGR"]).select("grid_id", "mgrs")


def bbox_grids(spark, d):
    return R.bbox_grids(view(spark, d, "registry"), view(spark, d, "grid"))


def polygon_grids(spark, d):
    """Grids as slanted quadrilaterals against the boxes of the registry."""
    corners = [F.struct((F.col(x) + dx).alias("x"), (F.col(y) + dy).alias("y")) for x, y, dx, dy in SLANTED]
    return R.polygon_grids(view(spark, d, "registry"), view(spark, d, "grid").select("grid_id", "mgrs", F.array(*corners).alias("vertices")))


def scene_filter(spark, d):
    return R.scene_files(view(spark, d, "scene_key"), ["B02", "B03"]).select("object_key", "size_bytes")


def download_estimate(spark, d):
    return R.download_estimate(view(spark, d, "scene_key"))


def dem_cells(spark, d):
    return R.dem_cells(view(spark, d, "registry")).select("district", "cell")


def dem_top_left(spark, d):
    cells = R.dem_cells(view(spark, d, "registry")).select("cell").distinct()
    return cells.select("cell", G.cell_top_left(F.col("cell")).alias("p")).select("cell", "p.lon", "p.lat")


def dem_for_bbox(spark, d):
    """Buffered boxes, their cells, the cells that exist, first source first."""
    return R.dem_for_boxes(view(spark, d, "registry"), view(spark, d, "cell"), 5000.0).select("district", "lat", "lon", "elevation")


def land_grids(spark, d):
    return R.land_grids(view(spark, d, "grid"), view(spark, d, "cell")).select("grid_id", "lat", "lon")


def utm_epsg(spark, d):
    return view(spark, d, "registry").select("district", G.utm_epsg(F.col("min_lat"), F.col("min_lon")).alias("epsg"))


def _centre(spark, d):
    c = view(spark, d, "registry").select("district", ((F.col("min_lat") + F.col("max_lat")) / 2).alias("lat"), ((F.col("min_lon") + F.col("max_lon")) / 2).alias("lon"))
    return c.withColumn("epsg", G.utm_epsg(F.col("lat"), F.col("lon")))


def utm_to_utm(spark, d):
    """Centres as points of their zone, read in the next zone."""
    c = _centre(spark, d).withColumn("p", G.to_utm(F.col("lat"), F.col("lon"), F.col("epsg")))
    moved = c.withColumn("q", G.utm_to_utm(F.col("p.x"), F.col("p.y"), F.col("epsg"), F.col("epsg") + 1))
    return moved.select("district", F.round("q.x", 1).alias("x"), F.round("q.y", 1).alias("y"))


def geo_to_metres(spark, d):
    c = _centre(spark, d).withColumn("p", G.to_utm(F.col("lat"), F.col("lon"), F.col("epsg")))
    return c.select("district", "epsg", F.round("p.x", 3).alias("x0"), F.round("p.y", 3).alias("y0"), F.lit(30.87).alias("xres"), F.lit(-30.87).alias("yres"))


def pixel_coords(spark, d):
    return G.pixel_coords(view(spark, d, "dem"), X0, Y0, RES).select("mgrs", "px_row", "px_col", "x", "y")


def _sizes(spark, d):
    return view(spark, d, "obs").groupBy("mgrs").agg((F.max("px_col") + 1).alias("width"), (F.max("px_row") + 1).alias("height"))


def tile_grid(spark, d):
    return T.tile_origins(_sizes(spark, d), 3).select("mgrs", "x_min", "y_min")


def tile_bbox(spark, d):
    t = T.tile_origins(_sizes(spark, d), 6).withColumn("step", F.lit(6))
    boxed = T.tile_bbox(t, X0, Y0, RES, EPSG)
    return boxed.select("mgrs", "x_min", "y_min", *[F.round(F.get("bbox", F.lit(i))[c], 7).alias(f"{c}{i}") for i in (0, 2) for c in ("lat", "lon")])


def tile_tensor(spark, d):
    t = T.tile_tensor(view(spark, d, "dem"), 5, "elevation")
    return t.select("mgrs", "x_min", "y_min", F.size("tensor").alias("n"), F.round(F.get("tensor", F.lit(0)), 6).alias("first"), F.round(F.aggregate("tensor", F.lit(0.0), lambda a, b: a * 0.5 + b), 4).alias("mixed"))


def normalize_layers(spark, d):
    m = view(spark, d, "dem")
    return m.select("mgrs", "px_row", "px_col", T.normalized("elevation", F.col("elevation")).alias("elevation"), T.normalized("red", F.col("elevation")).alias("red"), T.normalized("slope", F.col("px_row").cast("double")).alias("slope"), T.normalized("osm-water", (F.col("px_col") % 2).cast("double")).alias("water"))


def scale_rgb(spark, d):
    return view(spark, d, "obs").select(T.scaled_rgb(F.col("value")).alias("v")).groupBy("v").agg(F.count("*").alias("n"))


def preview_8bit(spark, d):
    return view(spark, d, "obs").select(T.preview(F.col("value")).alias("v")).groupBy("v").agg(F.count("*").alias("n"))


def label_tiles(spark, d):
    return T.label_tiles(view(spark, d, "truth"), 3.0).select("mgrs", "tx", "ty", "bridge_id")


def truth_in_footprint(spark, d):
    feet = view(spark, d, "feature").select("mgrs", "feature_id", F.col("x0").alias("x_lo"), F.col("x1").alias("x_hi"), F.col("y0").alias("y_lo"), F.col("y1").alias("y_hi"))
    return cover.truth_in_footprint(view(spark, d, "truth"), feet).select("feature_id", "bridge_id")


def dedupe_truth(spark, d):
    return T.dedupe_truth(view(spark, d, "match")).select("seq", "is_bridge", "bridge_loc")


def tile_match_levels(spark, d):
    t = levels(view(spark, d, "match").withColumn("tile_size", F.lit(300)), scratch(spark, "levels"))
    return t.filter("region = 'Uganda' and district = 'd1'").groupBy("region", "district", "mgrs", "tile_size").agg(F.count("*").alias("n"))


def _region(spark, d, name):
    return view(spark, d, "match").filter(F.col("region") == name)


def union_matches(spark, d):
    out = T.union_matches(_region(spark, d, "Uganda"), _region(spark, d, "Zambia").drop("is_bridge", "bridge_loc"))
    return out.select("seq", "region", "tile", "is_bridge")


def multi_region_match(spark, d):
    path = scratch(spark, "multi")
    T.dedupe_truth(T.union_matches(_region(spark, d, "Uganda"), _region(spark, d, "Rwanda"))).write.parquet(path)
    return spark.read.parquet(path).select("seq", "region", "tile", "is_bridge")


def parse_bbox(spark, d):
    m = view(spark, d, "match").withColumn("v", T.parse_bbox(F.col("bbox"))).filter("v is not null")
    return m.select("seq", *[F.get("v", F.lit(i))[c].alias(f"{c}{i}") for i in range(4) for c in ("lon", "lat")])


def result_polygons(spark, d):
    m = view(spark, d, "match").withColumn("v", T.parse_bbox(F.col("bbox"))).filter("v is not null")
    return m.select("seq", T.polygon_wkt(F.col("v")).alias("wkt"))


def bad_boxes(spark, d):
    return view(spark, d, "match").agg(F.count_if(T.parse_bbox(F.col("bbox")).isNull()).alias("n_bad"), F.count("*").alias("n"))


def augment_flip(spark, d):
    out = T.augment_flip(view(spark, d, "tile"), F.col("tile_id"), 2, 4)
    return out.select("tile_id", F.posexplode("tensor").alias("pos", "v")).select("tile_id", "pos", F.col("v").cast("double").alias("v"))


def channel_first(spark, d):
    t = view(spark, d, "tile").select("tile_id", T.channel_first(F.col("tensor"), 8, 8).alias("tensor"))
    return t.select("tile_id", F.posexplode("tensor").alias("pos", "v")).select("tile_id", "pos", F.col("v").cast("double").alias("v"))


def json_numeric_keys(spark, d):
    """Keys of JSON objects as numbers where they parse."""
    e = view(spark, d, "match").select("seq", F.concat(F.lit('{"'), (F.col("seq") % 9).cast("string"), F.lit('.5": 1, "k": '), (F.col("seq") % 4).cast("string"), F.lit("}")).alias("j"))
    return numeric_keys(e, "j").select("seq", "key", "number", "value")


def region_tiles(spark, d):
    """Tile grid with tensors, boxes, first labels and one row a location, end to end."""
    step = 5
    labels = T.label_tiles(view(spark, d, "truth"), float(step)).select("mgrs", (F.col("tx") * step).alias("x_min"), (F.col("ty") * step).alias("y_min"), "bridge_id", F.concat_ws(" ", "x", "y").alias("bridge_loc"))
    pixels = view(spark, d, "dem")
    # one row a location first, so that tensors are joined once and to few columns
    places = pixels.select("mgrs", (F.floor(F.col("px_col") / step) * step).cast("int").alias("x_min"), (F.floor(F.col("px_row") / step) * step).cast("int").alias("y_min")).distinct()
    match = places.join(labels, ["mgrs", "x_min", "y_min"], "left").withColumns({"is_bridge": F.col("bridge_id").isNotNull(), "seq": F.struct("mgrs", "x_min", "y_min")})
    tiles = T.tile_bbox(T.dedupe_truth(match).withColumn("step", F.lit(step)), X0, Y0, RES, EPSG)
    out = tiles.join(T.tile_tensor(pixels, step, "elevation"), ["mgrs", "x_min", "y_min"])
    return out.select("mgrs", "x_min", "y_min", F.size("tensor").alias("n_pixels"), F.round(F.get("bbox", F.lit(0))["lat"], 7).alias("lat0"), "is_bridge", "bridge_id")


CELLS = "select *, lon, lat from (select *, unnest(range(cast(floor(min_lon) as int), cast(floor(max_lon) as int) + 1)) as lon from {t}) a, lateral (select unnest(range(cast(floor(min_lat) as int), cast(floor(max_lat) as int) + 1)) as lat) b"
NAME = "concat(case when lat < 0 then 'S' else 'N' end, lpad(cast(abs(lat) as varchar), 2, '0'), case when lon < 0 then 'W' else 'E' end, lpad(cast(abs(lon) as varchar), 3, '0'), '.SRTMGL1_NC.nc')"
GROWN = "select district, " + ", ".join(f"{c} {'+' if 'max' in c else '-'} {5000 / 111000}e0 as {c}" for c in R.BOX) + " from registry"
ZONE = "case when {lat} >= 0 then 32600 else 32700 end + cast(floor(({lon} + 180e0) / 6e0) as int) + 1"
N = G._N
NUM = "select seq, list_transform(regexp_extract_all(bbox, '-?[0-9]+(?:\\.[0-9]+)?'), lambda x: cast(x as double)) as v from match where regexp_matches(bbox, '^\\(\\([^()]*\\), \\([^()]*\\), \\([^()]*\\), \\([^()]*\\)\\)$')"


def _inverse(x, y, epsg=EPSG):
    """SQL of latitude and longitude in degrees of a point in a southern zone."""
    scale = G.SCALE * G._A
    xi, eta = f"(({y} - 10000000e0) / {scale}e0)", f"(({x} - 500000e0) / {scale}e0)"
    x1 = xi + "".join(f" - {b:.17g} * sin({2 * k}e0 * {xi}) * cosh({2 * k}e0 * {eta})" for k, b in enumerate(G._BETA, 1))
    e1 = eta + "".join(f" - {b:.17g} * cos({2 * k}e0 * {xi}) * sinh({2 * k}e0 * {eta})" for k, b in enumerate(G._BETA, 1))
    chi = f"asin(sin({x1}) / cosh({e1}))"
    lat = f"degrees({chi}" + "".join(f" + {c:.17g} * sin({2 * k}e0 * {chi})" for k, c in enumerate(G._DELTA, 1)) + ")"
    return lat, f"degrees(atan2(sinh({e1}), cos({x1}))) + (({epsg} % 100) * 6e0 - 183e0)"


def _forward(lat, lon, epsg):
    """SQL of x and y in metres of a point in a UTM zone."""
    e = 2 * N**0.5 / (1 + N)
    phi, lam = f"radians({lat})", f"radians({lon} - (({epsg} % 100) * 6e0 - 183e0))"
    t = f"sinh(atanh(sin({phi})) - {e:.17g} * atanh({e:.17g} * sin({phi})))"
    xi, eta = f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt({t} * {t} + 1e0))"
    x = eta + "".join(f" + {a:.17g} * cos({2 * k}e0 * {xi}) * sinh({2 * k}e0 * {eta})" for k, a in enumerate(G._ALPHA, 1))
    y = xi + "".join(f" + {a:.17g} * sin({2 * k}e0 * {xi}) * cosh({2 * k}e0 * {eta})" for k, a in enumerate(G._ALPHA, 1))
    scale = f"{G.SCALE * G._A:.17g}"
    return f"({x}) * {scale} + 500000e0", f"({y}) * {scale} + case when {epsg} >= 32700 then 10000000e0 else 0e0 end"


def _corner(i, step):
    dx, dy = ((0, 0), (1, 0), (1, 1), (0, 1))[i]
    return _inverse(f"(x_min * {RES}e0 + {X0}e0 + {step * dx * RES}e0)", f"({Y0}e0 - y_min * {RES}e0 - {step * dy * RES}e0)")


SIZES = "select mgrs, max(px_col) + 1 as width, max(px_row) + 1 as height from obs group by mgrs"
ORIGINS = "select mgrs, cast(x_min as int) as x_min, cast(y_min as int) as y_min from (select mgrs, height, unnest(range(0, width, {s})) as x_min from ({z})) a, lateral (select unnest(range(0, height, {s})) as y_min) b"
LABELS = "select mgrs, tx, ty, bridge_id, x, y from (select *, row_number() over (partition by mgrs, tx, ty order by bridge_id) as k from (select *, cast(floor(x / {s}e0) as int) as tx, cast(floor(y / {s}e0) as int) as ty from truth) t where x > tx * {s}e0 and y > ty * {s}e0) where k = 1"
FLAT = "select tile_id, cast(pos as int) as pos, cast(tensor[{i}] as double) as v from tile, (select unnest(range({n})) as pos)"
_l0, _o0 = _corner(0, 6)
_l2, _o2 = _corner(2, 6)
_lat5, _ = _corner(0, 5)
_x, _y = _forward("lat", "lon", "epsg")
_x1, _y1 = _forward("lat", "lon", "(epsg + 1)")
CENTRE = f"select district, lat, lon, cast({ZONE.format(lat='lat', lon='lon')} as int) as epsg from (select district, (min_lat + max_lat) / 2e0 as lat, (min_lon + max_lon) / 2e0 as lon from registry)"

#: A convex polygon and a box are apart where an axis of the box or a normal of an edge separates them.
_P = [(f"(g.{x} + {dx}e0)", f"(g.{y} + {dy}e0)") for x, y, dx, dy in SLANTED]
_B = [(f"r.{x}", f"r.{y}") for x in ("min_lon", "max_lon") for y in ("min_lat", "max_lat")]
_apart = [f"greatest({', '.join(p[0] for p in _P)}) < r.min_lon", f"least({', '.join(p[0] for p in _P)}) > r.max_lon", f"greatest({', '.join(p[1] for p in _P)}) < r.min_lat", f"least({', '.join(p[1] for p in _P)}) > r.max_lat"]
_apart += [f"greatest({', '.join(f'({b[0]} - {a[0]}) * ({q[1]} - {a[1]}) - ({b[1]} - {a[1]}) * ({q[0]} - {a[0]})' for q in _B)}) < 0" for a, b in zip(_P, _P[1:] + _P[:1], strict=True)]

QUERIES = {
    "region_registry": (region_registry, oracle("select region, district, min_lon, min_lat, max_lon, max_lat, date_from, date_to, ground_truth from registry", "registry")),
    "requested_locations": (requested_locations, oracle("select region, district from registry where region in ('AFRICA', 'ASIA')", "registry")),
    "bbox_buffer": (bbox_buffer, oracle("select district, " + ", ".join(f"round({c}, 6) as {c}" for c in R.BOX) + f" from ({GROWN})", "registry")),
    "region_has_truth": (region_has_truth, oracle("select region, bool_or(ground_truth) as has_truth from registry group by region", "registry")),
    "date_prefixes": (date_prefixes, oracle("select district, cast(day as date) as day, concat('/', year(day), '/', month(day), '/', day(day), '/') as prefix from (select district, unnest(generate_series(cast(date_from as timestamp), cast(date_to as timestamp), interval 1 day)) as day from registry)", "registry")),
    "grid_parts": (grid_parts, oracle("select grid_id, cast(mgrs[1:2] as int) as utm, mgrs[3:3] as band, mgrs[4:5] as square, concat('tiles/', cast(cast(mgrs[1:2] as int) as varchar), '/', mgrs[3:3], '/', mgrs[4:5]) as prefix from grid", "grid")),
    "grid_filter": (grid_filter, oracle("select grid_id, mgrs from grid where lower(mgrs) in ('10mrv', '13mrv', '11mgr')", "grid")),
    "bbox_grids": (bbox_grids, oracle("select r.region, r.district, g.grid_id, g.mgrs from registry r join grid g on r.min_lon <= g.max_lon and r.max_lon >= g.min_lon and r.min_lat <= g.max_lat and r.max_lat >= g.min_lat", "registry", "grid")),
    "polygon_grids": (polygon_grids, oracle(f"select r.region, r.district, g.grid_id, g.mgrs from registry r join grid g on not ({' or '.join(_apart)})", "registry", "grid")),
    "scene_filter": (scene_filter, oracle("select object_key, size_bytes from scene_key where (object_key like '%B02.jp2' or object_key like '%B03.jp2' or object_key like '%MSK_CLOUDS_B00.gml') and object_key not like '%/preview/%'", "scene_key")),
    "download_estimate": (download_estimate, oracle("select count(*) as n_files, round(sum(size_bytes) / 1e9, 2) as total_gb, round(sum(size_bytes) / 1e9 * 0.09e0, 2) as cost from scene_key", "scene_key")),
    "dem_cells": (dem_cells, oracle(f"select district, {NAME} as cell from ({CELLS.format(t='registry')})", "registry")),
    "dem_top_left": (dem_top_left, oracle(f"select distinct {NAME} as cell, cast(lon as double) as lon, cast(lat as double) + 1e0 as lat from ({CELLS.format(t='registry')})", "registry")),
    "dem_for_bbox": (dem_for_bbox, oracle(f"select c.district, cast(c.lat as int) as lat, cast(c.lon as int) as lon, m.elevation from ({CELLS.format(t=f'({GROWN}) z')}) c join (select lat, lon, arg_min(elevation, source_order * 1000000e0 + elevation) as elevation from cell group by all) m on c.lat = m.lat and c.lon = m.lon", "registry", "cell")),
    "land_grids": (land_grids, oracle("select grid_id, cast(floor(min_lat) as int) as lat, cast(floor(min_lon) as int) as lon from grid where (cast(floor(min_lat) as int), cast(floor(min_lon) as int)) in (select (lat, lon) from cell)", "grid", "cell")),
    "utm_epsg": (utm_epsg, oracle(f"select district, cast({ZONE.format(lat='min_lat', lon='min_lon')} as int) as epsg from registry", "registry")),
    "utm_to_utm": (utm_to_utm, oracle(f"select district, round({_x1}, 1) as x, round({_y1}, 1) as y from ({CENTRE})", "registry")),
    "geo_to_metres": (geo_to_metres, oracle(f"select district, epsg, round({_x}, 3) as x0, round({_y}, 3) as y0, 30.87e0 as xres, -30.87e0 as yres from ({CENTRE})", "registry")),
    "pixel_coords": (pixel_coords, oracle(f"select mgrs, px_row, px_col, {X0}e0 + px_col * {RES}e0 as x, {Y0}e0 - px_row * {RES}e0 as y from dem", "dem")),
    "tile_grid": (tile_grid, oracle(ORIGINS.format(s=3, z=SIZES), "obs")),
    "tile_bbox": (tile_bbox, oracle(f"select mgrs, x_min, y_min, round({_l0}, 7) as lat0, round({_o0}, 7) as lon0, round({_l2}, 7) as lat2, round({_o2}, 7) as lon2 from ({ORIGINS.format(s=6, z=SIZES)})", "obs")),
    "tile_tensor": (tile_tensor, oracle("select mgrs, x_min, y_min, cast(len(t) as int) as n, round(t[1], 6) as first, round(list_reduce(list_prepend(0e0, t), lambda a, b: a * 0.5e0 + b), 4) as mixed from (select mgrs, cast(floor(px_col / 5) * 5 as int) as x_min, cast(floor(px_row / 5) * 5 as int) as y_min, list(elevation order by px_row, px_col) as t from dem group by 1, 2, 3)", "dem")),
    "normalize_layers": (normalize_layers, oracle("select mgrs, px_row, px_col, least(greatest(elevation / 8000e0, 0), 1) as elevation, least(greatest(elevation / 4000e0, 0), 1) as red, least(greatest(px_row / 90e0, 0), 1) as slope, cast(px_col % 2 as double) as water from dem", "dem")),
    "scale_rgb": (scale_rgb, oracle("select value / 4000e0 as v, count(*) as n from obs group by 1", "obs")),
    "preview_8bit": (preview_8bit, oracle("select cast(trunc(least(greatest(value / 4000e0, 0), 1) * 255) as int) as v, count(*) as n from obs group by 1", "obs")),
    "label_tiles": (label_tiles, oracle(f"select mgrs, tx, ty, bridge_id from ({LABELS.format(s=3)})", "truth")),
    "truth_in_footprint": (truth_in_footprint, oracle("select feature_id, bridge_id from feature f join truth t on f.mgrs = t.mgrs and x > x0 and x < x1 and y > y0 and y < y1", "feature", "truth")),
    "dedupe_truth": (dedupe_truth, oracle("select seq, is_bridge, bridge_loc from (select *, row_number() over (partition by is_bridge, bridge_loc order by seq) as k from match) where not is_bridge or k = 1", "match")),
    "tile_match_levels": (tile_match_levels, oracle("select region, district, mgrs, 300 as tile_size, count(*) as n from match where region = 'Uganda' and district = 'd1' group by all", "match")),
    "union_matches": (union_matches, oracle("select seq, region, tile, case when region = 'Uganda' then is_bridge end as is_bridge from match where region in ('Uganda', 'Zambia')", "match")),
    "multi_region_match": (multi_region_match, oracle("select seq, region, tile, is_bridge from (select *, row_number() over (partition by is_bridge, bridge_loc order by seq) as k from match where region in ('Uganda', 'Rwanda')) where not is_bridge or k = 1", "match")),
    "parse_bbox": (parse_bbox, oracle(f"select seq, v[2] as lon0, v[1] as lat0, v[4] as lon1, v[3] as lat1, v[6] as lon2, v[5] as lat2, v[8] as lon3, v[7] as lat3 from ({NUM})", "match")),
    "result_polygons": (result_polygons, oracle(f"select seq, concat('POLYGON ((', v[2], ' ', v[1], ', ', v[4], ' ', v[3], ', ', v[6], ' ', v[5], ', ', v[8], ' ', v[7], ', ', v[2], ' ', v[1], '))') as wkt from ({NUM})", "match")),
    "bad_boxes": (bad_boxes, oracle(f"select (select count(*) from match) - (select count(*) from ({NUM})) as n_bad, (select count(*) from match) as n", "match")),
    "augment_flip": (augment_flip, oracle(FLAT.format(n=64, i="1 + 8 * (pos // 8) + 4 * (case when tile_id % 2 = 1 then 1 - pos % 8 // 4 else pos % 8 // 4 end) + (case when tile_id // 2 % 2 = 1 then 3 - pos % 4 else pos % 4 end)"), "tile")),
    "channel_first": (channel_first, oracle(FLAT.format(n=64, i="1 + (pos % 8) * 8 + pos // 8"), "tile")),
    "json_numeric_keys": (json_numeric_keys, oracle("select seq, concat(seq % 9, '.5') as key, seq % 9 + 0.5e0 as number, cast(1 as bigint) as value from match union all select seq, 'k', null, seq % 4 from match", "match")),
    "region_tiles": (region_tiles, oracle(f"""select t.mgrs, t.x_min, t.y_min, cast(n as int) as n_pixels, round({_lat5}, 7) as lat0, b.bridge_id is not null as is_bridge, b.bridge_id from
        (select mgrs, cast(floor(px_col / 5) * 5 as int) as x_min, cast(floor(px_row / 5) * 5 as int) as y_min, count(*) as n from dem group by 1, 2, 3) t
        left join (select l.*, row_number() over (partition by x, y order by l.mgrs, tx, ty) as dup from ({LABELS.format(s=5)}) l
          where (l.mgrs, tx, ty) in (select (mgrs, cast(floor(px_col / 5) as int), cast(floor(px_row / 5) as int)) from dem)) b on b.mgrs = t.mgrs and b.tx * 5 = t.x_min and b.ty * 5 = t.y_min where b.bridge_id is null or dup = 1""", "dem", "truth")),
}
