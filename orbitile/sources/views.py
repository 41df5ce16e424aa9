"""Domain inputs read from the driver's tables.

Each view is one SELECT that Spark and DuckDB both run, so a query and its oracle see
the same rows. ``{name}`` stands for a driver table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # scene observations: one row per pixel, band and date; above 4000 is saturated
    "obs": """select cast(floor(l_partkey / 50) as int) as px_row, cast(l_partkey % 50 as int) as px_col,
        case l_suppkey % 4 when 0 then 'B02' when 1 then 'B03' when 2 then 'B04' else 'B08' end as band,
        cast(l_shipdate as date) as acq_date, l_quantity * 100e0 as value,
        case when l_returnflag = 'R' then 0 else 1 end as clear,
        case when l_orderkey % 3 = 0 then '35MRV' else '36MGR' end as mgrs from {lineitem}""",
    # elevation rasters of two grids, 50 columns wide
    "dem": """select case when floor(p_partkey / 50) % 2 = 0 then '35MRV' else '36MGR' end as mgrs, cast(floor(p_partkey / 100) as int) as px_row, cast(p_partkey % 50 as int) as px_col,
        p_retailprice + p_size * 10e0 as elevation from {part}""",
    # truth points inside the rasters, never on an integer edge
    "truth": """select case when c_custkey % 3 = 0 then '35MRV' else '36MGR' end as mgrs, c_custkey as bridge_id, cast(c_custkey * 37 % 4000 as double) / 100e0 + 0.005e0 as y,
        cast(c_custkey * 91 % 5000 as double) / 100e0 + 0.005e0 as x from {customer} where c_custkey % 10 = 0""",
    # inference results, and the validation third
    "pred": """select event_id as tile_id, case when event_type in ('click', 'purchase') then 1 else 0 end as pred,
        least(0.5e0 + value / 400e0, 0.9999e0) as conf from {events}""",
    "val": """select event_id as tile_id, case when value > 20e0 and (event_id + user_id) % 4 <> 0 then 1 else 0 end as is_target
        from {events} where event_id % 3 = 0""",
    # tile tensors: 8 layers of 8 pixels
    "tile": """select vec_id as tile_id, cast(label as int) as grp, case when label % 5 = 0 then 1 else 0 end as is_target,
        embedding as tensor from {embeddings}""",
    # registry: one row per region and district
    "registry": """select r_name as region, concat('D', cast(s_suppkey as varchar(12))) as district, s_suppkey % 3 = 0 as ground_truth,
        s_suppkey * 237 % 30000 / 100e0 - 150e0 as min_lon, s_suppkey * 161 % 10000 / 100e0 - 50e0 as min_lat,
        s_suppkey * 237 % 30000 / 100e0 - 148.7e0 as max_lon, s_suppkey * 161 % 10000 / 100e0 - 48.9e0 as max_lat,
        cast('2019-01-01' as date) + cast(s_suppkey % 300 as int) as date_from,
        cast('2019-01-05' as date) + cast(s_suppkey % 300 as int) + cast(s_suppkey % 4 as int) as date_to
        from {supplier} join {region} on r_regionkey = s_suppkey % 5""",
    # satellite grid cells: boxes of one degree
    "grid": """select concat(cast(10 + s_suppkey % 60 as varchar(2)), case s_suppkey % 3 when 0 then 'MRV' when 1 then 'MGR' else 'PTS' end) as mgrs,
        s_suppkey as grid_id, s_suppkey * 237 % 30000 / 100e0 - 149.4e0 as min_lon, s_suppkey * 161 % 10000 / 100e0 - 49.6e0 as min_lat,
        s_suppkey * 237 % 30000 / 100e0 - 148.4e0 as max_lon, s_suppkey * 161 % 10000 / 100e0 - 48.6e0 as max_lat from {supplier}""",
    # object keys of scene files
    "scene_key": """select concat('tiles/', cast(30 + o_custkey % 8 as varchar(2)), '/M/', case o_custkey % 3 when 0 then 'RV' when 1 then 'GR' else 'TS' end, '/',
        cast(year(o_orderdate) as varchar(4)), '/', cast(month(o_orderdate) as varchar(2)), '/', cast(day(o_orderdate) as varchar(2)), '/', cast(o_orderkey % 2 as varchar(1)),
        case o_orderkey % 6 when 0 then '/B02.jp2' when 1 then '/B03.jp2' when 2 then '/qi/MSK_CLOUDS_B00.gml' when 3 then '/preview/B02.jp2' when 4 then '/B08.jp2' else '/metadata.xml' end) as object_key,
        o_totalprice * 1000e0 as size_bytes, cast(o_orderdate as date) as acq_date from {orders}""",
    # tile-match rows; truth columns are null-free here
    "match": """select p_partkey as seq, case p_partkey % 3 when 0 then 'Uganda' when 1 then 'Rwanda' else 'Zambia' end as region,
        concat('d', cast(p_partkey % 5 as varchar(1))) as district, concat(cast(30 + p_partkey % 4 as varchar(2)), 'MRV') as mgrs,
        concat('t_', cast(p_partkey as varchar(12)), '.pt') as tile,
        concat('((', cast(p_size as varchar(6)), '.5, ', cast(p_partkey % 90 as varchar(6)), '.25), (', cast(p_size as varchar(6)), '.5, ', cast(p_partkey % 90 + 1 as varchar(6)), '.25), (',
               cast(p_size + 1 as varchar(6)), '.5, ', cast(p_partkey % 90 + 1 as varchar(6)), '.25), (', cast(p_size + 1 as varchar(6)), '.5, ', cast(p_partkey % 90 as varchar(6)), case when p_partkey % 17 = 0 then ')' else '.25))' end) as bbox,
        p_partkey % 7 = 0 as is_bridge, case when p_partkey % 7 = 0 then concat('POINT (', cast(p_partkey % 23 as varchar(4)), ' ', cast(p_size as varchar(4)), ')') end as bridge_loc from {part}""",
    # checkpoints of training runs
    "checkpoint": """select case c_custkey % 3 when 0 then 'resnet18' when 1 then 'resnet34' else 'resnet50' end as architecture,
        0.5e0 + c_custkey % 4 as ratio, cast(floor(c_custkey / 12) as int) as epoch, abs(c_acctbal) / 110e0 as total_acc,
        abs(c_acctbal) % 97e0 as bridge_acc, abs(c_acctbal) % 89e0 as no_bridge_acc, concat('ck_', cast(c_custkey as varchar(12)), '.tar') as path from {customer}""",
    # map features: water and boundary shapes near the raster, some without a geometry
    "feature": """select case when s_suppkey % 5 < 3 then '35MRV' else '36MGR' end as mgrs, s_suppkey as feature_id, case when s_suppkey % 2 = 0 then 'waterway' else 'boundary' end as tag_name,
        case when s_suppkey % 11 = 0 then null else 'yes' end as tag, case when s_suppkey % 13 = 0 then null when s_suppkey % 3 = 1 then 'Polygon' else 'LineString' end as geom_type,
        s_suppkey * 7 % 46 + 0.3e0 as x0, s_suppkey * 13 % 36 + 0.4e0 as y0, s_suppkey * 7 % 46 + 3.6e0 as x1, s_suppkey * 13 % 36 + 2.7e0 as y1 from {supplier}""",
    # cloud polygons per grid and date: quadrilaterals, some of them not convex
    "cloud": """select case when s_suppkey % 3 = 0 then '35MRV' else '36MGR' end as mgrs, s_suppkey as cloud_id, cast('1995-01-01' as date) + cast(s_suppkey % 30 as int) as acq_date,
        s_suppkey * 11 % 44 + 0.2e0 as xa, s_suppkey * 5 % 34 + 0.1e0 as ya, s_suppkey * 11 % 44 + 4.7e0 as xb, s_suppkey * 5 % 34 + 1.3e0 as yb,
        s_suppkey * 11 % 44 + 1.9e0 as xc, s_suppkey * 5 % 34 + 3.8e0 as yc,
        s_suppkey * 11 % 44 + 0.9e0 + s_suppkey % 2 as xd, s_suppkey * 5 % 34 + 1.7e0 as yd from {supplier}""",
    # one-degree elevation cells with a value each, from two sources that overlap
    "cell": """select cast(floor(floor(s_suppkey / 2) * 161 % 10000 / 100e0 - 49.6e0) as int) as lat, cast(floor(floor(s_suppkey / 2) * 237 % 30000 / 100e0 - 149.4e0) as int) as lon,
        cast(s_suppkey % 2 as int) as source_order, s_suppkey * 31e0 as elevation from {supplier}""",
    # truth points in degrees, around the border of zones 35 and 36
    "truth_deg": """select c_custkey as bridge_id, -1.7e0 - (c_custkey * 37 % 4001) / 1900e0 as lat, 29.35e0 + (c_custkey * 91 % 5003) / 4000e0 as lon from {customer}""",
    # composites' references: grids of two zones that overlap, their tiles a few pixels wide
    "grid_ref": """select concat(case when s_suppkey % 2 = 0 then '35M' else '36M' end, cast(s_suppkey as varchar(12))) as mgrs, cast(case when s_suppkey % 2 = 0 then 32735 else 32736 end as int) as epsg,
        case when s_suppkey % 2 = 0 then 815000e0 else 160000e0 end + (floor(s_suppkey / 2) % 5 - 2) * 20000e0 as x0, 9810000e0 - (floor(s_suppkey / 10) % 10) * 22000e0 as y0,
        600e0 as res, 50 as width, 40 as height, 3 as step from {supplier}""",
    # polygons of two rings a grid: a part with a hole, or two parts
    "area": """select case when s_suppkey % 3 = 0 then '35MRV' else '36MGR' end as mgrs, s_suppkey as area_id, cast('1995-01-01' as date) + cast(s_suppkey % 30 as int) as acq_date,
        s_suppkey * 11 % 40 + 0.2e0 as xa, s_suppkey * 5 % 30 + 0.1e0 as ya, s_suppkey * 11 % 40 + 9.7e0 as xb, s_suppkey * 5 % 30 + 1.3e0 as yb, s_suppkey * 11 % 40 + 4.9e0 as xc, s_suppkey * 5 % 30 + 8.8e0 as yc,
        s_suppkey * 11 % 40 + 3.4e0 + s_suppkey % 2 * 9 as xd, s_suppkey * 5 % 30 + 1.7e0 as yd, s_suppkey * 11 % 40 + 6.1e0 + s_suppkey % 2 * 9 as xe, s_suppkey * 5 % 30 + 2.2e0 as ye,
        s_suppkey * 11 % 40 + 4.6e0 + s_suppkey % 2 * 9 as xf, s_suppkey * 5 % 30 + 5.9e0 as yf from {supplier}""",
    # references of fine and coarse rasters: one coarse one shifted by a quarter step and upside down, one of the next zone
    "raster_ref": """select 'fine' as kind, '35MRV' as mgrs, 32735 as epsg, 500000e0 as x0, 9800000e0 as y0, 10e0 as xres, -10e0 as yres, 0 as width, 0 as height union all
        select 'coarse', '35MRV', 32735, 499990e0, 9799905e0, 30e0, 30e0, 50, 4 union all
        select 'fine', '36MGR', 32736, 166040e0, 9800010e0, 10e0, -10e0, 0, 0 union all
        select 'coarse', '36MGR', 32735, 833895e0, 9799960e0, 30.87e0, -30.87e0, 50, 5""",
    # rasters of one-degree elevation cells, 11 x 11 with shared edges, from two sources with gaps, on both sides of the zero meridian
    "cell_raster": """select concat(case when lat < 0 then 'S' else 'N' end, substring(cast(100 + abs(lat) as varchar(3)), 2, 2), case when lon < 0 then 'W' else 'E' end, substring(cast(1000 + abs(lon) as varchar(4)), 2, 3), '.SRTMGL1_NC.nc') as cell,
        lat, lon, source_order, cast(floor(px / 11) as int) as px_row, cast(px % 11 as int) as px_col, elevation from
        (select cast(floor(p_partkey % 4 / 2) as int) - 1 + 2 * (cast(floor(p_partkey / 968) as int) % 40) as lat, cast(p_partkey % 2 as int) - 1 as lon, cast(floor(p_partkey % 8 / 4) as int) as source_order,
         cast(floor(p_partkey / 8) as int) % 121 as px, case when p_partkey % 29 = 0 then null else p_retailprice end as elevation from {part}) t""",
    # boxes of districts on the zero meridian, from the equator northwards
    "meridian_box": """select concat('D', cast(s_suppkey as varchar(12))) as district, -0.6e0 as min_lon, 2e0 * (s_suppkey % 20) - 0.5e0 as min_lat, 0.7e0 as max_lon, 2e0 * (s_suppkey % 20) + 0.5e0 as max_lat from {supplier}""",
    # block arrays of scenes, 8 x 8 pixels each, with their scene's reference
    "block": """select vec_id, case when label % 2 = 0 then '35MRV' else '36MGR' end as mgrs, case floor(label / 2) % 2 when 0 then 'B04' else 'B08' end as band,
        cast('2020-01-01' as date) + cast(vec_id % 7 as int) as acq_date, cast(floor(vec_id / 3) % 5 as int) as block_row, cast(vec_id % 3 as int) as block_col,
        cast(case when label % 2 = 0 then 32735 else 32736 end as int) as epsg, 300000e0 as x0, 9900040e0 as y0, 10e0 as xres, -10e0 as yres, 40 as height, 24 as width, embedding as values from {embeddings}""",
    # class scores of tiles
    "score": """select event_id as tile_id, value / 100e0 as s0, (user_id % 50) / 25e0 as s1, cast(event_id % 2 as int) as target,
        cast(floor(event_id / 500) as int) as epoch from {events}""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _tables_of(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view as a DataFrame over the driver's Parquet tables."""
    sql = VIEWS[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _tables_of(sql)})


def oracle(body: str, *names: str) -> str:
    """DuckDB text of a query over views: a WITH list and ``body``."""
    ctes = [f"{n} as ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names]
    body = body.strip()
    if body.lower().startswith("with "):
        return "with " + ", ".join(ctes) + ", " + body[5:]
    return ("with " + ", ".join(ctes) + " " if ctes else "") + body
