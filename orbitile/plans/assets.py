"""Queries over the asset catalog; names are generated from ``part`` rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitile.operators import catalog as C
from orbitile.operators.regions import pending_work
from orbitile.sources.io import latest_truth as latest
from orbitile.sources.io import list_assets, read_tile_match, read_truth_csv, read_truth_points, scratch
from orbitile.sources.views import VIEWS, oracle, view

#: Names of every kind, and one that matches none, as SQL over the part row's fields.
_NAMES = (
    "concat('optical_composite_', r, '_', d, '_', g, '_B02_B03_B04.tif')",
    "concat('optical_composite_slice_', r, '_', d, '_', g, '_B03_', a, '_', b, '.tif')",
    "concat('multivariate_composite_', r, '_', d, '_', g, '.tif')",
    "concat(r, '_', d, '_35_M_RV_20', y, '_', m, '_', m, '_0_B02.jp2')",
    "concat(r, '_', d, '_35_M_RV_20', y, '_', m, '_', m, '_1_qi_MSK_CLOUDS_B00.gml')",
    "concat('elevation_', r, '_', d, '_', g, '.tif')",
    "concat('slope_', r, '_', d, '_', g, '.tif')",
    "concat('osm_', r, '_', d, '_', g, '.tif')",
    "concat('sr_tile_match_', r, case when k % 3 > 0 then concat('_', d) else '' end, case when k % 3 > 1 then concat('_', g) else '' end, '_300.csv')",
    "concat('mr_tile_match_', r, '_Zambia_', a, '.csv')",
    "concat(r, '_', d, '_', g, '_300_', a, '_', b, '.tif')",
    "concat(r, '_', d, '_', g, '_300_', a, '_', b, '.pt')",
    "concat(r, '_Zambia_resnet18_r5.0_ts300_green_nir_osm-water_epoch', m, case when k % 2 = 0 then '_best' else '' end, '.tar')",
    "concat(r, '_Zambia_resnet34_r2.5_ts300_red_epoch', m, '.csv')",
    "concat(r, '_Zambia_resnet50_r1.0_ts400_blue_slope_epoch', m, '.shp')",
    "concat(r, '_Zambia_resnet18_r5.0_ts300_green_nir_epoch', m, '_best_shapefile.tar')",
    "concat('train_', r, '_Zambia_70_ts300.csv')",
    "concat('validate_', r, '_Zambia_70_ts300.csv')",
    "concat('off_nominal_', a, '.txt')",
)
VIEWS["asset"] = "select concat('root/', cast(kind_no as varchar(3)), '/', name) as path, name, kind_no, r, d, g, a, b, y, m, k from (select *, case kind_no " + " ".join(f"when {i} then {n}" for i, n in enumerate(_NAMES)) + """ end as name from (
    select cast(p_partkey % 19 as int) as kind_no, case p_partkey % 3 when 0 then 'Uganda' when 1 then 'Rwanda' else 'Ghana' end as r, concat('D', cast(p_partkey % 7 as varchar(2))) as d,
    case p_partkey % 4 when 0 then '35MRV' when 1 then '36MGR' when 2 then '35mtu' else '30PTS' end as g, cast(p_partkey % 500 as varchar(5)) as a, cast(p_partkey % 500 + p_size as varchar(5)) as b,
    cast(10 + p_size % 10 as varchar(3)) as y, cast(1 + p_size % 12 as varchar(3)) as m, p_partkey as k from {part})) x"""
KINDS = [g.kind for g in C.GRAMMARS]
KIND = "case kind_no " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(KINDS)) + " end"


def _parsed(spark, d):
    return C.parse(view(spark, d, "asset").select("path"))


def catalog_parse(spark, d):
    return _parsed(spark, d).select("path", "kind", "region", "district", "mgrs", "tile_size", "x_min", "top_bound", "epoch", "ratio", "best", "acq_date", "regions", "architecture", F.array_join("layers", "_").alias("layers"))


def catalog_dispatch(spark, d):
    return view(spark, d, "asset").select("path", C.kind_of(C.base_name(F.col("path"))).alias("kind"))


def catalog_name(spark, d):
    return C.with_names(_parsed(spark, d)).filter("kind is not null").select("path", "rebuilt")


def catalog_path(spark, d):
    return C.with_paths(_parsed(spark, d)).filter("kind is not null").select("path", "archive_path", "remote_key")


def catalog_roundtrip(spark, d):
    """Names with their bands or regions out of order do not come back as they were."""
    twisted = view(spark, d, "asset").filter("kind_no in (0, 9, 16)").select(F.replace(F.replace("path", F.lit("B02_B03"), F.lit("B03_B02")), F.lit("Uganda_Zambia"), F.lit("Zambia_Uganda")).alias("path"))
    return C.round_trip(C.parse(twisted)).select("path", "rebuilt")


def _picked(*kinds, **by):
    return lambda spark, d: C.pick(_parsed(spark, d), *kinds, **by).select("path", "kind")


def district_grids(spark, d):
    return C.district_grids(_parsed(spark, d).filter("kind in ('optical_composite', 'sentinel2_tile')"))


def ci_sort(spark, d):
    a = view(spark, d, "asset")
    return a.select("k", F.array_join(C.ci_sort(F.array("r", F.lit("uganda2"), "d", "g")), "|").alias("sorted"))


def scene_key_to_asset(spark, d):
    return C.key_to_asset(view(spark, d, "scene_key").select("object_key").distinct(), "Uganda", "D1").select("object_key", "name", "kind")


def asset_scan(spark, d):
    """Files written from the part table, listed again by name."""
    path = scratch(spark, "assets")
    view(spark, d, "match").select("tile", "region").write.partitionBy("region").csv(path)
    listed = list_assets(spark, path, "*.csv").withColumn("region", F.regexp_extract("path", "region=([^/]+)/", 1))
    return listed.groupBy("region").agg(F.sum("length").alias("bytes"), F.count_if(~F.col("path").endswith(".csv")).alias("others"))


def tile_match_scan(spark, d):
    path = scratch(spark, "match")
    view(spark, d, "match").select("tile", "bbox", "is_bridge", "bridge_loc").write.csv(path, header=True, quote='"', escape='"')
    return read_tile_match(spark, path)


def tile_match_scan_no_truth(spark, d):
    path = scratch(spark, "match")
    view(spark, d, "match").select("tile", "bbox").write.csv(path, header=True, quote='"', escape='"')
    return read_tile_match(spark, path)


def latest_truth(spark, d):
    files = view(spark, d, "scene_key").select(F.concat(F.lit("truth/Uganda_"), F.date_format("acq_date", "MM.dd.yyyy"), F.lit(".csv")).alias("path")).distinct()
    return latest(files)


def truth_points(spark, d):
    t = view(spark, d, "truth").withColumn("y", F.when(F.col("bridge_id") % 30 == 0, None).otherwise(F.col("y")))
    return read_truth_points(t).select("bridge_id", "y", "x")


def truth_csv_scan(spark, d):
    """Truth files with latitudes and longitudes among other columns, some of them missing, written and scanned."""
    path = scratch(spark, "truth")
    lat = F.when(F.col("bridge_id") % 30 != 0, F.col("lat"))
    view(spark, d, "truth_deg").select(F.col("bridge_id").alias("Id"), F.col("lon").alias("Longitude"), lat.alias("Latitude")).write.csv(path, header=True)
    return read_truth_csv(spark, path).select(F.round("point.x", 6).alias("x"), F.round("point.y", 6).alias("y"))


def pending(spark, d):
    slices = view(spark, d, "asset").select("kind_no", "r", "d", "g", "a").distinct()
    return pending_work(slices.filter("kind_no = 5"), slices.filter("kind_no = 6"), ["r", "d", "g", "a"]).drop("kind_no")


def publish_set(spark, d):
    chosen = C.pick(_parsed(spark, d), "trained_model", architecture="resnet18", best=True)
    return C.with_paths(chosen).select("path", "remote_key")


def fetch_set(spark, d):
    wanted = C.with_paths(C.pick(_parsed(spark, d), "elevation", region="uganda")).select("remote_key").distinct()
    return pending_work(wanted, wanted.filter("remote_key like '%35MRV%'"), ["remote_key"])


REGIONS = "case when r < 'Zambia' then concat(r, '_Zambia') else concat('Zambia_', r) end"
LAYER = "case kind_no when 12 then 'green_nir_osm-water' when 13 then 'red' when 14 then 'blue_slope' when 15 then 'green_nir' end"
ARCH = "case kind_no when 12 then 'resnet18' when 13 then 'resnet34' when 14 then 'resnet50' when 15 then 'resnet18' end"
RATIO = "case kind_no when 12 then 5e0 when 13 then 2.5e0 when 14 then 1e0 when 15 then 5e0 when 16 then 70e0 when 17 then 70e0 end"
BEST = "case when kind_no between 12 and 15 then kind_no = 15 or kind_no = 12 and k % 2 = 0 end"
ONE = "kind_no in (0,1,2,3,4,5,6,7,8,10,11)"
PLACE = "r, d"
PATH = f"""case when kind_no in (0, 1, 2) then concat('composites/', r, '/', d, case when kind_no = 1 then concat('/', g) else '' end)
 when kind_no in (3, 4) then concat('sentinel2/', r, '/', d, '/35MRV/20', y, '_', m, '_', m) when kind_no = 5 then concat('elevation/', r, '/', d) when kind_no = 6 then concat('slope/', r, '/', d)
 when kind_no = 7 then concat('osm/', r, '/', d) when kind_no = 8 then concat('tiles/', r, case when k % 3 > 0 then concat('/', d) else '' end, case when k % 3 > 1 then concat('/', g) else '' end)
 when kind_no = 9 then 'multi_region_tile_match' when kind_no in (10, 11) then concat('tiles/', r, '/', d, '/', g, '/300')
 when kind_no in (12, 13, 15) then concat(case kind_no when 12 then 'trained_models/' else 'inference_results/' end, r, '_Zambia/', {ARCH}, '/r', cast({RATIO} as varchar))
 when kind_no = 14 then concat('inference_results/', r, '_Zambia/resnet50/r1.0/blue_slope_epoch', m, '_shapefile') else 'tiles/train_validate_splits' end"""


def _sql(where):
    return oracle(f"select path, {KIND} as kind from asset where {where}", "asset")


QUERIES = {
    "catalog_parse": (catalog_parse, oracle(f"""select path, {KIND} as kind, case when {ONE} then r end as region, case when {ONE} and not (kind_no = 8 and k % 3 = 0) then d end as district,
        case when kind_no in (0,1,2,5,6,7,10,11) or kind_no = 8 and k % 3 > 1 then g end as mgrs, cast(case when kind_no in (8,10,11,12,13,15,16,17) then 300 when kind_no = 14 then 400 when kind_no = 9 then cast(a as int) end as int) as tile_size,
        case when kind_no in (10, 11) then cast(a as int) end as x_min, case when kind_no = 1 then cast(a as int) end as top_bound, case when kind_no between 12 and 15 then cast(m as int) end as epoch,
        {RATIO} as ratio, {BEST} as best, case when kind_no in (3, 4) then make_date(2000 + cast(y as int), cast(m as int), cast(m as int)) end as acq_date,
        case when kind_no in (9, 12, 13, 14, 15, 16, 17) then concat(r, '_Zambia') end as regions, {ARCH} as architecture, {LAYER} as layers from asset""", "asset")),
    "catalog_dispatch": (catalog_dispatch, oracle(f"select path, {KIND} as kind from asset", "asset")),
    "catalog_name": (catalog_name, oracle("select path, name as rebuilt from asset where kind_no < 18", "asset")),
    "catalog_path": (catalog_path, oracle(f"select path, concat('data/', p, '/', name) as archive_path, concat(p, '/', name) as remote_key from (select path, name, {PATH} as p from asset where kind_no < 18)", "asset")),
    "catalog_roundtrip": (catalog_roundtrip, oracle("select replace(replace(path, 'B02_B03', 'B03_B02'), 'Uganda_Zambia', 'Zambia_Uganda') as path, name as rebuilt from asset where kind_no = 0 or kind_no in (9, 16) and r = 'Uganda'", "asset")),
    "filter_composites": (_picked("optical_composite", "multivariate_composite", region="uganda", mgrs=["35mrv", "35MTU"]), _sql("kind_no in (0, 2) and r = 'Uganda' and lower(g) in ('35mrv', '35mtu')")),
    "filter_bands": (_picked("optical_composite", bands=["B04", "B02", "B03"], district="D1"), _sql("kind_no = 0 and d = 'D1'")),
    "filter_slices": (_picked("optical_composite_slice", band="B03", top_bound=20), _sql("kind_no = 1 and a = '20'")),
    "filter_scenes": (_picked("sentinel2_tile", "sentinel2_cloud", year=2015, month=4), _sql("kind_no in (3, 4) and y = '15' and m = '4'")),
    "filter_aux": (_picked("elevation", "slope", "osm", district="d2"), _sql("kind_no in (5, 6, 7) and d = 'D2'")),
    "filter_match": (_picked("single_region_tile_match", district="D3", tile_size=300), _sql("kind_no = 8 and d = 'D3' and k % 3 > 0")),
    "filter_multi_match": (_picked("multi_region_tile_match", regions=["Zambia", "ghana"]), _sql("kind_no = 9 and r = 'Ghana'")),
    "filter_tiles": (_picked("tile", "tensor", mgrs=["36MGR"], tile_size=300), _sql("kind_no in (10, 11) and g = '36MGR'")),
    "filter_models": (_picked("trained_model", layers=["osm-water", "nir", "green"], best=True, ratio=5.0), _sql("kind_no = 12 and k % 2 = 0")),
    "filter_splits": (_picked("train_split", "validate_split", regions=["Rwanda", "Zambia"], tile_size=300), _sql("kind_no in (16, 17) and r = 'Rwanda'")),
    "district_grids": (district_grids, oracle("select distinct r as region, d as district, case kind_no when 0 then g else '35MRV' end as grid from asset where kind_no in (0, 3)", "asset")),
    "ci_sort": (ci_sort, oracle("select k, array_to_string(list_transform(list_sort(list_transform([r, 'uganda2', d, g], lambda x: lower(x) || chr(1) || x)), lambda x: split_part(x, chr(1), 2)), '|') as sorted from asset", "asset")),
    "scene_key_to_asset": (scene_key_to_asset, oracle("""select distinct object_key, name, case when name like '%.jp2' then 'sentinel2_tile' else 'sentinel2_cloud' end as kind from (select object_key, concat('Uganda_D1_', replace(replace(replace(replace(object_key, '/qi/', '/'), '_qi_', ''), '/', '_'), 'tiles_', '')) as name from scene_key where object_key not like '%/preview/%')
        where name like '%.jp2' or name like '%_qi_MSK_CLOUDS_B%.gml'""", "scene_key")),
    "asset_scan": (asset_scan, oracle("select region, cast(sum(length(tile) + 1) as bigint) as bytes, cast(0 as bigint) as others from match group by region", "match")),
    "tile_match_scan": (tile_match_scan, oracle("select tile, bbox, is_bridge, bridge_loc from match", "match")),
    "tile_match_scan_no_truth": (tile_match_scan_no_truth, oracle("select tile, bbox from match", "match")),
    "latest_truth": (latest_truth, oracle("select concat('truth/Uganda_', strftime(max(acq_date), '%m.%d.%Y'), '.csv') as path, max(acq_date) as day from scene_key", "scene_key")),
    "truth_csv_scan": (truth_csv_scan, oracle("select round(lat, 6) as x, round(lon, 6) as y from truth_deg where bridge_id % 30 <> 0", "truth_deg")),
    "truth_points": (truth_points, oracle("select bridge_id, y, x from truth where bridge_id % 30 <> 0", "truth")),
    "pending_work": (pending, oracle("select distinct r, d, g, a from asset where kind_no = 5 except select r, d, g, a from asset where kind_no = 6", "asset")),
    "publish_set": (publish_set, oracle("select path, concat('trained_models/', r, '_Zambia/resnet18/r5.0/', name) as remote_key from asset where kind_no = 12 and k % 2 = 0", "asset")),
    "fetch_set": (fetch_set, oracle("select distinct concat('elevation/', r, '/', d, '/', name) as remote_key from asset where kind_no = 5 and r = 'Uganda' and g <> '35MRV'", "asset")),
}
