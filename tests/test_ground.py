"""Covers, shapes of several rings, thin lines, labels in degrees, resampling, mosaics, registries, resumed work, training."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitile.operators import composite, cover, dataset, regions, training
from orbitile.plans.registry import QUERIES
from orbitile.sources import io

DATA = "/root/testdata/sf0.001"
RINGS = "i int, rings array<array<struct<x: double, y: double>>>"


def plan(df):
    return df._jdf.queryExecution().toString()


def polygons(rng, n, size=10.0):
    """Random polygons: an outer ring, often with a ring inside it, or a second part."""
    out = []
    for i in range(n):
        centre, parts = rng.uniform(-2 * size, 2 * size, 2), []
        for k in range(int(rng.integers(1, 4))):
            angles = np.sort(rng.uniform(0, 2 * math.pi, int(rng.integers(3, 8))))
            radii = rng.uniform(0.5, 1.0, len(angles)) * size / (1 + 2 * (k == 1))
            shift = centre + (k == 2) * np.array([2.5 * size, 0])
            parts.append([(float(shift[0] + r * math.cos(a)), float(shift[1] + r * math.sin(a))) for a, r in zip(angles, radii, strict=True)])
        out.append((i, parts))
    return out


def inside(rings, x, y):
    n = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay <= y) != (by <= y) and ax + (y - ay) * (bx - ax) / (by - ay) > x:
                n += 1
    return n % 2 == 1


@pytest.mark.parametrize("size", [0.01, 10.0, 1e6])
def test_cover_is_bounded_by_the_edge_and_holds_the_polygon(spark, size):
    shapes = polygons(np.random.default_rng(1), 6, size)
    cells = {}
    for r in cover.cover(spark.createDataFrame(shapes, RINGS)).collect():
        cells.setdefault(r.i, []).append((r._cell.e, r._cell.x, r._cell.y, r._cell.whole))
    rng = np.random.default_rng(2)
    for i, rings in shapes:
        assert len(cells[i]) < 700 and len(set(cells[i])) == len(cells[i]) and any(c[3] for c in cells[i])
        xs, ys = zip(*[v for ring in rings for v in ring], strict=True)
        for x, y in zip(rng.uniform(min(xs), max(xs), 300), rng.uniform(min(ys), max(ys), 300), strict=True):
            held = [c for c in cells[i] if (math.floor(x / 2.0 ** c[0]), math.floor(y / 2.0 ** c[0])) == c[1:3]]
            assert len(held) <= 1
            if inside(rings, x, y):
                assert held
            elif held:
                assert not held[0][3]


def test_points_in_polygons_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    shapes = [(i, f"g{i % 2}", rings) for i, rings in polygons(rng, 20)]
    # a square with a square hole: points on either edge are not strictly inside
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    shapes.append((99, "g0", [square(100.0, 108.0), square(102.0, 104.0)]))
    shapes.append((98, "g0", [[(5.0, 5.0)] * 3]))
    points = [(k, f"g{k % 2}", float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-30, 50, (800, 2)))]
    points += [(1000 + k, "g0", x, y) for k, (x, y) in enumerate([(100.0, 104.0), (101.0, 101.0), (102.0, 103.0), (103.0, 103.0), (104.0, 104.0), (104.5, 104.5), (108.0, 108.0)])]
    out = cover.points_in_polygons(spark.createDataFrame(points, "k int, mgrs string, x double, y double"), spark.createDataFrame(shapes, "i int, mgrs string, rings array<array<struct<x: double, y: double>>>"))
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    got = sorted((r.k, r.i) for r in out.collect())
    expected = [(k, i) for k, g, x, y in points if k < 1000 for i, h, rings in shapes if g == h and inside(rings, x, y)]
    assert got == sorted([*expected, (1001, 99), (1005, 99)])


def test_labels_in_degrees(spark):
    """Points just inside and on the corners of a tile, and one that lies in grids of two zones."""
    grids = [("35X", 32735, 815000.0, 9800000.0, 600.0, 50, 40, 3), ("36X", 32736, 160000.0, 9800000.0, 600.0, 50, 40, 3)]
    frame = spark.createDataFrame(grids, "mgrs string, epsg int, x0 double, y0 double, res double, width int, height int, step int")
    from orbitile.functions.geo import from_utm

    place = lambda x, y, e: spark.range(1).select(from_utm(F.lit(x), F.lit(y), F.lit(e)).alias("p")).first().p
    middle = place(815000.0 + 47 * 600, 9800000.0 - 4 * 600, 32735)  # also in the other zone's grid
    corner = place(815000.0 + 6 * 600, 9800000.0 - 6 * 600, 32735)
    points = [(5, middle.lat, middle.lon), (3, middle.lat, middle.lon + 1e-7), (7, corner.lat, corner.lon), (8, 0.0, 0.0)]
    out = cover.label_tiles_degrees(spark.createDataFrame(points, "bridge_id int, lat double, lon double"), frame)
    got = {(r.mgrs, r.x_min, r.y_min): r.bridge_id for r in out.collect()}
    assert got.pop(("35X", 45, 3)) == 3 and list(got.values()) == [3] and next(iter(got))[0] == "36X"


def line_by_hand(a, b):
    (x, y), (tx, ty) = (tuple(math.floor(v) for v in p) for p in (a, b))
    dx, dy = abs(tx - x), abs(ty - y)
    sx, sy, long, short = (tx > x) - (tx < x), (ty > y) - (ty < y), max(dx, dy), min(dx, dy)
    error, out = long // 2, [(y, x)]
    for _ in range(long):
        error -= short
        bend = error < 0
        error += long * bend
        x, y = (x + sx, y + sy * bend) if dx >= dy else (x + sx * bend, y + sy)
        out.append((y, x))
    assert (x, y) == (tx, ty)
    return out


def test_thin_lines_follow_the_error_term(spark):
    rng = np.random.default_rng(4)
    lines = [(0, [(0.5, 0.2), (9.6, 3.7)]), (1, [(3.3, 3.3)]), (2, [(2.5, 7.5), (2.6, 7.6)])]
    lines += [(i, [(float(x), float(y)) for x, y in rng.uniform(-20, 20, (int(rng.integers(2, 5)), 2))]) for i in range(3, 40)]
    df = spark.createDataFrame(lines, "i int, vertices array<struct<x: double, y: double>>")
    got = {}
    for r in composite.line_pixels(df).collect():
        got.setdefault(r.i, set()).add((r.px_row, r.px_col))
    assert len(got[0]) == 10 and 1 not in got and got[2] == {(7, 2)}
    for i, vertices in lines:
        assert got.get(i, set()) == {p for a, b in zip(vertices, vertices[1:], strict=False) for p in line_by_hand(a, b)}


def test_rings_are_filled_by_the_even_odd_rule(spark):
    shapes = polygons(np.random.default_rng(5), 8)
    df = spark.createDataFrame(shapes, RINGS)
    got, touched = ({(r.i, r.px_row, r.px_col) for r in composite.filled_rings(df, all_touched=t).collect()} for t in (False, True))
    span = range(-35, 50)
    assert got == {(i, r, c) for i, rings in shapes for r in span for c in span if inside(rings, c + 0.5, r + 0.5)}
    assert got < touched
    vertices = {(i, math.floor(y), math.floor(x)) for i, rings in shapes for ring in rings for x, y in ring}
    assert vertices <= touched


def test_features_without_a_geometry_go(spark):
    rows = [(1, "waterway", "yes", None), (2, "waterway", "yes", "Polygon"), (3, "boundary", "yes", "Polygon"), (4, "boundary", None, "LineString"), (5, "boundary", "yes", "LineString")]
    df = spark.createDataFrame(rows, "feature_id int, tag_name string, tag string, geom_type string")
    assert {r.feature_id for r in composite.map_features(df).collect()} == {2, 5}


def test_resampling_by_reference_equals_argmin(spark):
    """Rasters that are shifted, upside down, coarser or finer; ties go to the lower index."""
    refs = "mgrs string, epsg int, x0 double, y0 double, xres double, yres double, width int, height int"
    fine = {"a": (32735, 100.0, 500.0, 10.0, -10.0, 7, 6), "b": (32735, 100.0, 500.0, 10.0, -10.0, 7, 6), "c": (32735, 0.0, 0.0, 3.0, 3.0, 7, 6)}
    coarse = {"a": (32735, 95.0, 505.0, 20.0, -20.0, 4, 3), "b": (32735, 120.0, 430.0, 15.0, 30.0, 5, 4), "c": (32735, -1.0, 40.0, 1.0, -2.5, 30, 12)}
    pixels = [(g, r, c) for g in fine for r in range(6) for c in range(7)]
    values = [(g, r, c, 100 * r + c) for g, x in coarse.items() for r in range(x[6]) for c in range(x[5])]
    made = lambda of: spark.createDataFrame([(g, *x) for g, x in of.items()], refs)
    out = composite.resample_onto(spark.createDataFrame(pixels, "mgrs string, px_row int, px_col int"), made(fine), spark.createDataFrame(values, "mgrs string, px_row int, px_col int, v int"), made(coarse))
    got = {(r.mgrs, r.px_row, r.px_col): r.v for r in out.collect()}
    for g, r, c in pixels:
        f, k = fine[g], coarse[g]
        row = np.abs(k[2] + np.arange(k[6]) * k[4] - (f[2] + r * f[4])).argmin()
        col = np.abs(k[1] + np.arange(k[5]) * k[3] - (f[1] + c * f[3])).argmin()
        assert got[g, r, c] == 100 * row + col
    moved = composite.reprojected_origin(spark.createDataFrame([("d", 4326, 30.2, -1.5, 0.1, -0.1, 3, 3)], refs), F.lit(32736)).first()
    assert moved.epsg == 32736 and 180_000 < moved.x0 < 190_000 and 9_833_000 < moved.y0 < 9_835_000


def test_mosaic_over_the_zero_meridian_and_the_equator(spark):
    """2 x 2 cells of 3 x 3 pixels with shared edges make 5 x 5; a gap of the first source is filled by the second."""
    names = {(0, 0): "N00W001", (0, 1): "N00E000", (1, 0): "S01W001", (1, 1): "S01E000"}
    rows = []
    for (j, i), name in names.items():
        for source in (0, 1):
            rows += [(f"{name}.SRTMGL1_NC.nc", source, r, c, None if (j, i, r, c, source) == (0, 0, 0, 0, 0) else float(100 * (2 * j + r) + 2 * i + c + 0.5 * source)) for r in range(3) for c in range(3)]
    rows.append(("N05E005.SRTMGL1_NC.nc", 0, 0, 0, 1.0))
    cells = spark.createDataFrame(rows, "cell string, source_order int, px_row int, px_col int, elevation double")
    boxes = spark.createDataFrame([("D", -0.5, -0.5, 0.5, 0.5), ("E", 0.2, 0.2, 0.3, 0.3), ("none", 80.0, 20.0, 81.0, 21.0)], "district string, min_lon double, min_lat double, max_lon double, max_lat double")
    got = {}
    for r in regions.dem_mosaic(boxes, cells, 0.0, 2).collect():
        got[r.district, r.px_row, r.px_col] = (r.lon, r.lat, r.elevation)
    assert {k[0] for k in got} == {"D", "E"}
    assert {k: v for k, v in got.items() if k[0] == "D"} == {("D", r, c): (c / 2 - 1, 1 - r / 2, 100.0 * r + c + 0.5 * (r == c == 0)) for r in range(5) for c in range(5)}
    assert got["E", 0, 0] == (0.0, 1.0, 2.0) and len(got) == 25 + 9


def test_registry_of_ranges(spark):
    text = {
        "Ivory": {"dates": [["2017-12-30", "2018-01-02"], ["2018-01-01", "2018-01-03"], ["2019-05-02", "2019-05-01"]], "districts": {"A": {"ground_truth": True, "bbox": [1, 2, 3, 4]}, "B": {"bbox": [5, 6, 7, 8], "dates": ["2020-02-28", "2020-03-01"]}}},
        "Zam": {"dates": [["2019-09-01", "2019-09-01"]], "districts": {"C": {"ground_truth": False, "bbox": [1, 2, 3, 4]}}},
    }
    got = io.registry_of(spark, text)
    rows = {r.district: r for r in got.collect()}
    assert [len(rows[d].ranges) for d in "ABC"] == [2, 1, 1] and str(rows["A"].date_from) == "2017-12-30" and str(rows["A"].date_to) == "2018-01-03"
    days = {}
    for r in regions.date_prefixes(got).collect():
        days.setdefault(r.district, []).append(r.prefix)
    assert sorted(days["A"]) == ["/2017/12/30/", "/2017/12/31/", "/2018/1/1/", "/2018/1/2/", "/2018/1/3/"] and len(days["B"]) == 3 and days["C"] == ["/2019/9/1/"]
    with pytest.raises(ValueError, match="unknown region"):
        regions.requested(got, regions=["Nowhere"])


def test_truth_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("name,Longitude,Latitude\na,30.5,-1.5\nb,,2\nc,x,1\n")
    assert [tuple(r.point) for r in io.read_truth_csv(spark, str(tmp_path / "t.csv")).collect()] == [(-1.5, 30.5)]
    (tmp_path / "u.csv").write_text("name,lat\na,1\n")
    with pytest.raises(ValueError, match="no truth file"):
        io.read_truth_csv(spark, str(tmp_path / "u.csv"))


def test_finished_grids_are_not_read_again(spark, tmp_path):
    stored = str(tmp_path / "obs")
    rows = [("r", "d", g, px, px * 1.0) for g in ("A", "B", "C") for px in range(5)]
    spark.createDataFrame(rows, "region string, district string, mgrs string, px int, v double").write.partitionBy("mgrs").parquet(stored)
    obs = spark.read.parquet(stored).select("mgrs", "px", "v")
    wanted = spark.createDataFrame([("r", "d", g) for g in "ABC"], "region string, district string, mgrs string")
    path, log, seen = str(tmp_path / "out"), str(tmp_path / "log"), []

    def build(work, grids):
        seen.append(({r.mgrs for r in work.collect()}, plan(work)))
        return work.groupBy("mgrs").agg(F.sum("v").alias("v"))

    def broken(work, grids):
        # writes and breaks before the grid is listed
        io.write_composite(build(work, grids).join(wanted, "mgrs"), path)
        raise RuntimeError

    io.composites_of_pending(obs, wanted.filter("mgrs = 'B'"), build, path, log)
    with pytest.raises(RuntimeError):
        io.composites_of_pending(obs, wanted, broken, path, log)
    table = io.composites_of_pending(obs, wanted, build, path, log)
    assert [s for s, _ in seen] == [{"B"}, {"A", "C"}, {"A", "C"}]
    filters = next(x for x in seen[-1][1].splitlines() if "PartitionFilters" in x).split("PartitionFilters")[1].split("]")[0]
    assert "mgrs" in filters and "A" in filters and "B" not in filters
    assert sorted((r.mgrs, r.v) for r in table.collect()) == [("A", 10.0), ("B", 10.0), ("C", 10.0)]
    io.composites_of_pending(obs, wanted, build, path, log)
    assert seen[-1][0] == set() and io.finished_work(spark, log, "mgrs string").count() == 3


def test_block_tables_are_pruned_and_agree_on_a_reference(spark, tmp_path):
    fields = "mgrs string, band string, acq_date string, epsg int, x0 double, y0 double, xres double, yres double, height int, width int, block_row int, block_col int, values array<double>"
    rows = [(g, b, "d", 32735, 0.0, 0.0, 10.0, -10.0, 2, 2, 0, 0, [1.0, 2.0, None, 4.0]) for g in "AB" for b in ("B02", "B03")]
    path = str(tmp_path / "blocks")
    io.write_blocks(spark.createDataFrame(rows, fields), path)
    one = io.read_blocks(spark, path, ["A"], ["B02"])
    assert one.count() == 1 and io.read_blocks(spark, path).count() == 4
    filters = next(x for x in plan(one).splitlines() if "PartitionFilters" in x)
    assert "mgrs" in filters.split("PartitionFilters")[1].split("]")[0] and "band" in filters.split("PartitionFilters")[1].split("]")[0]
    assert composite.one_reference(one).first().epsg == 32735
    io.write_blocks(spark.createDataFrame([("A", "B02", "e", 32735, 0.0, 0.0, 10.0, -10.0, 3, 2, 0, 0, [1.0] * 4)], fields), path)
    with pytest.raises(Exception, match="different references"):
        composite.one_reference(io.read_blocks(spark, path, ["A"])).collect()


def test_training_equals_a_plain_version(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 16))
    y = (x[:, :2].sum(axis=1) + 0.3 * rng.normal(size=60) > 0).astype(int)
    rows = [(i, [float(v) for v in np.concatenate([x[i], np.zeros(48)])], int(y[i])) for i in range(60)]
    df = spark.createDataFrame(rows, "tile_id int, tensor array<double>, is_target int")
    path = str(tmp_path / "runs")
    got = training.train_epochs(df.filter("tile_id < 40"), df.filter("tile_id >= 40"), ["red", "green"], 8, path, epochs=3, rate=1.0).orderBy("epoch").collect()
    a, w = np.hstack([x, np.ones((60, 1))]), np.zeros(17)
    for e in range(3):
        p = 1 / (1 + np.exp(-a[:40] @ w))
        w = w - (a[:40] * (p - y[:40])[:, None]).mean(axis=0)
        right = (a[40:] @ w > 0) == (y[40:] == 1)
        assert abs(got[e].total_acc - 100 * right.mean()) < 1e-9 and abs(got[e].bridge_acc - 100 * right[y[40:] == 1].mean()) < 1e-9
    assert got[-1].total_acc > 70 and got[2].path.endswith("epoch2.tar")
    with pytest.raises(ValueError, match="no rows"):
        training.train_epochs(df.limit(0), df, ["red"], 8, path)


def test_positives_without_a_location_stay(spark):
    from orbitile.operators.tiles import dedupe_truth

    rows = [(1, True, "p"), (2, True, "p"), (3, True, None), (4, True, None), (5, False, None), (6, None, "p"), (7, False, "p")]
    got = dedupe_truth(spark.createDataFrame(rows, "seq int, is_bridge boolean, bridge_loc string"))
    assert sorted(r.seq for r in got.collect()) == [1, 3, 4, 5, 6, 7]


def test_draws_with_replacement(spark):
    rows = [(i, int(i < 5)) for i in range(12)]
    df = spark.createDataFrame(rows, "tile_id long, is_target int")
    got = dataset.draw_negatives(df, 4.0, [F.col("tile_id"), F.col("tile_id")]).collect()
    assert sorted(r.draw for r in got) == list(range(1, 21)) and {r.tile_id for r in got} <= set(range(5, 12)) and len({r.tile_id for r in got}) < 20
    again = dataset.draw_negatives(df, 4.0, [F.col("tile_id"), F.col("tile_id")]).collect()
    assert {(r.draw, r.tile_id) for r in again} == {(r.draw, r.tile_id) for r in got}
    assert dataset.draw_negatives(df.filter("is_target = 1"), 4.0, [F.col("tile_id")]).count() == 0


def lines_read(df):
    return [r.value for r in df.sparkSession.read.text(df.inputFiles()).collect()]


def test_registry_rows_do_not_carry_their_region(spark):
    """A line written holds one district, and a row read from a line of many holds no other."""
    out = QUERIES["region_registry"][0](spark, DATA)
    assert [line.count('"bbox"') for line in lines_read(out)] == [1] * 10 and out.count() == 10
    held = re.findall(r"Generate explode\([^)]*\), \[([^]]*)\][^\n]*district#", out._jdf.queryExecution().executedPlan().toString())
    assert held and all(re.sub(r"#\d+", "", h) in ("region", "region, _dates") for h in held)


def test_registry_lines_hold_a_district_and_the_dates_of_its_region(spark):
    out = QUERIES["registry_ranges"][0](spark, DATA)
    lines = lines_read(out)
    assert [line.count('"bbox"') for line in lines] == [1] * 10
    dates = {re.search(r'"dates":(.*?\]\])', line)[1] for line in lines}
    assert len(dates) == 5 and all(len(re.findall(r"\d{4}-\d\d-\d\d", d)) == 6 for d in dates)


def test_points_in_footprints_equal_brute_force(spark):
    """Small, large, thin, turned and empty boxes; their cells, many times the rows of the table, are never broadcast."""
    rng = np.random.default_rng(7)
    boxes = [(i, f"g{i % 2}", *map(float, (x, x + w, y, y + h))) for i, (x, y, w, h) in enumerate(zip(*rng.uniform(-30, 30, (2, 60)), *np.exp2(rng.uniform(-6, 6, (2, 60))), strict=True))]
    boxes += [(90, "g0", 4.0, 2.0, 4.0, 2.0), (91, "g0", 1.0, 1.0, 0.0, 9.0), (92, "g0", None, 2.0, 0.0, 9.0), (93, "g0", 0.0, 8.0, 0.0, 8.0)]
    points = [(k, f"g{k % 2}", float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-30, 30, (900, 2)))]
    points += [(1000 + k, "g0", x, y) for k, (x, y) in enumerate([(0.0, 4.0), (3.0, 3.0), (8.0, 4.0), (4.0, 8.0), (float("nan"), 4.0), (1.0, 5.0), (None, 3.0)])]
    out = cover.truth_in_footprint(spark.createDataFrame(points, "k int, mgrs string, x double, y double"), spark.createDataFrame(boxes, "i int, mgrs string, x_lo double, x_hi double, y_lo double, y_hi double"))
    assert "NestedLoop" not in plan(out) and "Broadcast" not in plan(QUERIES["truth_in_footprint"][0](spark, DATA))
    got = sorted((r.k, r.i) for r in out.collect())
    held = lambda x, y, a, b, c, d: None not in (x, a) and a < x < b and c < y < d
    assert got == sorted((k, i) for k, g, x, y in points for i, h, *box in boxes if g == h and held(x, y, *box)) and (1001, 93) in got and (1001, 90) not in got


def test_equal_polygons_are_met_once_and_their_covers_not_broadcast(spark):
    rings = [[(0.0, 0.0), (8.0, 0.0), (8.0, 8.0)]]
    shapes = [(i, "AB"[i % 2], f"2020-01-0{i + 1}", rings) for i in range(6)] + [(9, "A", "2020-01-01", [[(-0.0, 0.0), (8.0, 0.0), (8.0, 8.0)]]), (10, "A", "2020-01-01", [[(0.0, 0.0), (1.0, 0.0), (1.0, 8.0)]]), (11, "A", "2020-01-01", None)]
    points = [(1, "A", 7.0, 1.0), (2, "B", 7.0, 1.0), (3, "A", 0.9, 0.1), (4, "A", 1.0, 7.0)]
    out = cover.points_in_polygons(spark.createDataFrame(points, "k int, mgrs string, x double, y double"), spark.createDataFrame(shapes, "i int, mgrs string, day string, rings array<array<struct<x: double, y: double>>>"))
    assert set(out.columns) == {"k", "mgrs", "x", "y", "i", "day", "rings"}
    got = sorted((r.k, r.i, r.day) for r in out.collect())
    days = {s[0]: s[2] for s in shapes}
    assert got == [(k, i, days[i]) for k, held in ((1, (0, 2, 4, 9)), (2, (1, 3, 5)), (3, (0, 2, 4, 9, 10))) for i in held]
    text = plan(QUERIES["truth_in_polygon"][0](spark, DATA))
    assert re.search(r"SortMergeJoin \[[^]]*_cx", text) and not re.search(r"BroadcastHashJoin \[[^]]*_cx", text)


def test_grids_of_one_reference_are_labelled_once(spark, monkeypatch):
    """Two references for forty grids; a grid with both has the first label of either; the rest of the work sees two rows."""
    a, b = (32735, 815000.0, 9800000.0, 600.0, 50, 40, 3), (32735, 815000.0, 9800000.0, 600.0, 50, 40, 6)
    grids = [(f"G{i}", *(b if i % 4 == 0 else a)) for i in range(40)]
    frame = spark.createDataFrame([*grids, grids[1]], "mgrs string, epsg int, x0 double, y0 double, res double, width int, height int, step int")
    from orbitile.functions.geo import from_utm

    at = lambda x, y: from_utm(F.lit(815000.0 + 600 * x), F.lit(9800000.0 - 600 * y), F.lit(32735))
    places = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("bridge_id"), at(x, y).alias("p")) for k, (x, y) in enumerate([(1.5, 1.5), (4.5, 1.5), (4.6, 1.6), (7.5, 8.5)])])))
    points = places.select("bridge_id", "p.lat", "p.lon")
    seen, met = [], cover._met
    monkeypatch.setattr(cover, "_met", lambda points, shapes, *rest: seen.append(shapes.count()) or met(points, shapes, *rest))
    labels = lambda rows: sorted((r.mgrs, r.x_min, r.y_min, r.bridge_id) for r in cover.label_tiles_degrees(points, rows).collect())
    small, large = [(0, 0, 0), (3, 0, 1), (6, 6, 3)], [(0, 0, 0), (6, 6, 3)]
    assert labels(frame) == sorted((g[0], *x) for g in grids for x in (large if g[1:] == b else small))
    assert seen == [2]
    both = spark.createDataFrame([("X", *a), ("X", *b), ("Y", *a)], frame.schema)
    assert labels(both) == sorted([("X", *x) for x in small] + [("Y", *x) for x in small])


def test_boxes_of_one_place_share_a_mosaic(spark, monkeypatch):
    """Thirty boxes over the same two cells: pixels meet a place once, repeated values are settled first, a cell without values still sets the corner."""
    names = ["N00E000.SRTMGL1_NC.nc", "N00E001.SRTMGL1_NC.nc", "N01E000.SRTMGL1_NC.nc"]
    rows = [(n, k % 2, r, c, None if n == names[2] else float(100 * i + 10 * r + c + k)) for i, n in enumerate(names) for k in range(6) for r in range(3) for c in range(3)]
    cells = spark.createDataFrame(rows, "cell string, source_order int, px_row int, px_col int, elevation double")
    boxes = [(f"D{i}", 0.1 + i / 100, 0.2, 1.1 + i / 100, 0.9) for i in range(30)] + [("T", 0.2, 0.2, 0.3, 0.3), ("T", 0.2, 1.2, 1.3, 1.3), ("T", 1.2, 0.2, 1.3, 0.3)]
    frame = spark.createDataFrame(boxes, "district string, min_lon double, min_lat double, max_lon double, max_lat double")
    met, make = [], regions.mosaic_pixels
    monkeypatch.setattr(regions, "mosaic_pixels", lambda cells, side: met.append(cells.count()) or make(cells, side))
    got = {}
    for r in regions.dem_mosaic(frame, cells, 0.0, 2).collect():
        assert got.setdefault(r.district, {}).setdefault((r.px_row, r.px_col), (r.lon, r.lat, r.elevation)) == (r.lon, r.lat, r.elevation)
    # of the shared column the first cell's values stay
    place = {(r, c): (c / 2, 1 - r / 2, 10.0 * r + (c if c < 3 else 100 + c - 2)) for r in range(3) for c in range(5)}
    assert got == {**{f"D{i}": place for i in range(30)}, "T": {(r + 2, c): v for (r, c), v in place.items()}}
    assert max(met) == 2 * 9 + 2 * 9
