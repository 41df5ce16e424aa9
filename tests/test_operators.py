"""Hand-made cases and properties of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitile.functions import geo
from orbitile.operators import catalog, composite, cover, dataset, metrics, scoring, tiles
from orbitile.operators.regions import requested
from orbitile.sources.views import view

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_gradient_edges(spark):
    for run in (2, 3, 512):
        composite.RUN = run
        grids = {"A": np.array([[c * c + r for c in range(7)] for r in range(5)], float), "B": np.array([[100 * c - r * r for c in range(7)] for r in range(5)], float)}
        dem = spark.createDataFrame([(g, r, c, float(z[r, c])) for g, z in grids.items() for r in range(5) for c in range(7)], "mgrs string, px_row int, px_col int, elevation double")
        got = {(r.mgrs, r.px_row, r.px_col): (r.gx, r.gy) for r in composite.gradient(dem, 1.0).collect()}
        assert len(got) == 70
        for g, z in grids.items():
            gy, gx = np.gradient(z)
            assert all(math.isclose(got[g, r, c][0], gx[r, c]) and math.isclose(got[g, r, c][1], gy[r, c]) for r in range(5) for c in range(7))


def test_grids_do_not_mix(spark):
    """Two grids with the same pixels: what each gives alone, it gives beside the other."""
    rows = [(g, r, c, b, f"2020-01-0{d}", float(v + 10 * r + c), 1) for g, v in (("A", 100), ("B", 2000)) for r in range(4) for c in range(4) for b in ("B04", "B03") for d in (1, 2, 3)]
    obs = spark.createDataFrame(rows, "mgrs string, px_row int, px_col int, band string, acq_date string, value double, clear int")
    dem = obs.filter("band = 'B04' and acq_date = '2020-01-01'").select("mgrs", "px_row", "px_col", F.col("value").alias("elevation"))
    points = spark.createDataFrame([("A", 1, 0.5, 0.5), ("B", 2, 0.7, 0.7), ("B", 3, 0.2, 0.2)], "mgrs string, bridge_id int, x double, y double")
    boxes = spark.createDataFrame([("A", 0.0, 1.0, 0.0, 1.0)], "mgrs string, x_lo double, x_hi double, y_lo double, y_hi double")
    shape = spark.createDataFrame([("A", [(0.2, 0.2), (2.4, 0.2), (2.4, 2.4)])], "mgrs string, vertices array<struct<x: double, y: double>>")
    pixels = dem.drop("elevation")
    cases = {
        "median": lambda g: composite.median_composite(obs.filter(g)),
        "pivot": lambda g: composite.band_pivot(obs.filter(g)),
        "blocks": lambda g: composite.block_median(composite.blocks(obs.filter(g), 3), 3),
        "columns": lambda g: composite.stack_columns(composite.median_composite(obs.filter(g)), {"B04": "red", "B03": "green"}),
        "bands": lambda g: composite.stack_bands([composite.median_composite(obs.filter(g)).filter(F.col("band") == b).select("mgrs", "px_row", "px_col", F.col("value").alias(b)) for b in ("B04", "B03")]),
        "slope": lambda g: composite.slope(dem.filter(g)),
        "nearest": lambda g: composite.resample_nearest(pixels.filter(g), dem.filter(g), 2.0),
        "raster": lambda g: composite.rasterize(pixels.filter(g), composite.filled(shape.filter(g)), "on"),
        "slices": lambda g: composite.row_slices(obs.filter(g), 2),
        "tensor": lambda g: tiles.tile_tensor(dem.filter(g), 2, "elevation"),
        "labels": lambda g: tiles.label_tiles(points.filter(g), 1.0),
        "truth": lambda g: cover.truth_in_footprint(points.filter(g), boxes.filter(g)),
    }
    for name, run in cases.items():
        both = sorted(map(str, run(F.lit(True)).collect()))
        alone = sorted(str(r) for g in ("A", "B") for r in run(F.col("mgrs") == g).collect())
        assert both == alone and both, name


def test_shapes_are_burned_as_by_hand(spark):
    rng = np.random.default_rng(2)
    rings = [(i, [(float(x), float(y)) for x, y in rng.uniform(0.1, 9.7, (int(rng.integers(3, 7)), 2))]) for i in range(12)]
    df = spark.createDataFrame(rings, "i int, vertices array<struct<x: double, y: double>>")
    got, touched, lines = ({(r.i, r.px_row, r.px_col) for r in f.collect()} for f in (composite.filled(df), composite.filled(df, all_touched=True), composite.walked(df)))
    for i, ring in rings:
        edges = list(zip(ring, ring[1:] + ring[:1]))
        for r in range(11):
            for c in range(11):
                y, x = r + 0.5, c + 0.5
                inside = sum((a[1] <= y) != (b[1] <= y) and a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) > x for a, b in edges) % 2 == 1
                assert ((i, r, c) in got) == inside
        walk = lambda pairs: {(i, int(y), int(x)) for a, b in pairs for t in np.linspace(0, 1, 4001) for x, y in [(a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))]}
        own = {p for p in lines if p[0] == i}
        assert walk(edges[:-1]) <= own and len(own - walk(edges[:-1])) <= 2  # sampling may miss a corner
        assert walk(edges) <= {p for p in touched if p[0] == i}


def test_rings_meet_boxes(spark):
    """Random polygons, convex or not, against boxes: edges clipped to the box, and corners inside."""
    from orbitile.operators.regions import ring_meets_box

    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        x0, y0 = rng.uniform(0, 10, 2)
        w, h = rng.uniform(0.1, 4, 2)
        ring = [tuple(map(float, p)) for p in rng.uniform(0, 12, 2) + rng.uniform(-3, 3, (int(rng.integers(3, 7)), 2))]
        rows.append((i, ring, float(x0), float(y0), float(x0 + w), float(y0 + h)))
    df = spark.createDataFrame(rows, "i int, vertices array<struct<x: double, y: double>>, x0 double, y0 double, x1 double, y1 double")
    got = {r.i: r.meets for r in df.select("i", ring_meets_box(F.col("vertices"), {k: F.col(k) for k in ("x0", "y0", "x1", "y1")}).alias("meets")).collect()}

    def clipped(a, b, box):
        low, high = 0.0, 1.0
        for d, s, least, most in ((b[0] - a[0], a[0], box[0], box[2]), (b[1] - a[1], a[1], box[1], box[3])):
            t = sorted(((least - s) / d, (most - s) / d))
            low, high = max(low, t[0]), min(high, t[1])
        return low <= high

    for i, ring, *box in rows:
        edges = list(zip(ring, ring[1:] + ring[:1]))
        inside = sum((a[1] <= box[1]) != (b[1] <= box[1]) and a[0] + (box[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) > box[0] for a, b in edges) % 2 == 1
        assert got[i] == (inside or any(clipped(a, b, box) for a, b in edges))
    assert 30 < sum(got.values()) < 270


def test_blocks_of_arrays_are_checked(spark):
    good = spark.createDataFrame([("A", "B02", 0, 0, [1.0, None, 3.0, 4.0]), ("A", "B02", 0, 0, [3.0, None, None, 4.0])], "mgrs string, band string, block_row int, block_col int, values array<double>")
    got = {(r.px_row, r.px_col): r.value for r in composite.block_median(composite.blocks_of_arrays(good, 2), 2).collect()}
    assert got == {(0, 0): 2.0, (1, 0): 3.0, (1, 1): 4.0}
    with pytest.raises(Exception, match="3 x 3"):
        composite.blocks_of_arrays(good, 3).collect()


def test_references_must_agree(spark):
    rows = [("A", 1, 32735, 0.0), ("A", 2, 32735, 0.0), ("B", 1, 32736, 0.0)]
    df = spark.createDataFrame(rows, "mgrs string, scene int, epsg int, x0 double")
    assert sorted(tuple(r) for r in composite.one_reference(df, fields=("epsg", "x0")).collect()) == [("A", 32735, 0.0), ("B", 32736, 0.0)]
    with pytest.raises(Exception, match="different references"):
        composite.one_reference(df.withColumn("x0", F.col("scene").cast("double")), fields=("epsg", "x0")).collect()


def test_registry_reads_nested_text(spark):
    import yaml

    text = """
    Uganda:
      districts:
        Kibaale: {bbox: [30.0, -1.0, 31.0, 0.5], dates: [2020-01-01, 2020-02-01], ground_truth: true}
        Kafefe: {bbox: [29.0, -1.0, 30.0, 0.5], dates: [2020-01-01, 2020-02-01]}
    """
    from orbitile.sources.io import registry_of

    got = {r.district: (r.region, r.min_lon, r.max_lat, str(r.date_to), r.ground_truth) for r in registry_of(spark, yaml.safe_load(text)).collect()}
    assert got == {"Kibaale": ("Uganda", 30.0, 0.5, "2020-02-01", True), "Kafefe": ("Uganda", 29.0, 0.5, "2020-02-01", False)}


def test_tile_match_truth_is_detected(spark, tmp_path):
    from orbitile.sources.io import read_tile_match

    for name, rows in (("with", "tile,bbox,is_bridge,bridge_loc\na.pt,x,True,P\n"), ("without", "tile,bbox\na.pt,x\n")):
        (tmp_path / f"{name}.csv").write_text(rows)
        got = read_tile_match(spark, f"{tmp_path}/{name}.csv")
        assert ("is_bridge" in got.columns) == (name == "with") and got.count() == 1
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        read_tile_match(spark, f"{tmp_path}/bad.csv")


def test_split_keeps_null_strata_and_any_order(spark):
    rows = spark.range(1000).select(F.col("id").alias("tile_id"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("kind"))
    order = [dataset.order_key(F.col("tile_id")), F.col("tile_id")]
    for parts in (143, None, 1):
        ranks = dataset.ranked(rows, order, ["kind"], parts).collect()
        plain = dataset.ranked(rows, [-F.col("tile_id")], ["kind"], parts).collect()
        for kind in (None, 1, 2, 3, 4):
            assert [r.tile_id for r in sorted((r for r in plain if r.kind == kind), key=lambda r: r._rank)] == [i for i in range(999, -1, -1) if (i % 5 or None) == kind]
        assert {r._all for r in plain} == {200}
        assert len(ranks) == 1000
        for kind in (None, 1, 2, 3, 4):
            assert sorted(r._rank for r in ranks if r.kind == kind) == list(range(1, 201))
    out = dataset.stratified_split(rows, 70, ["kind"], order)
    assert {(r.kind, r.split): r["count"] for r in out.groupBy("kind", "split").count().collect()} == {(k, s): n for k in (None, 1, 2, 3, 4) for s, n in (("train", 140), ("validate", 60))}
    plan_text = plan(dataset.epoch_sample(rows.withColumn("is_target", (F.col("tile_id") % 4 == 0).cast("int")), 1.0, order))
    assert "TakeOrdered" not in plan_text


def test_metrics_take_other_names(spark):
    rows = spark.createDataFrame([(1, 1, 0.9, 1), (2, 1, 0.9, 0), (3, 0, 0.9, 1), (4, 0, 0.2, 0)], "unit int, guess int, sure double, truth int")
    left, right = rows.select("unit", "guess", "sure"), rows.select("unit", "truth").filter("unit < 4")
    assert metrics.subset(left, right, "unit").count() == 3
    got = metrics.confusion(metrics.aligned(left, right, "unit"), 0.5, "guess", "sure", "truth").first()
    assert got.asDict() == {"tp": 1, "tn": 0, "fp": 1, "fn": 1}


def test_scoring_transforms_the_tensor(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "tile_id int, tensor array<double>")
    got = {r.tile_id: r.pred for r in scoring.score_tiles(df, lambda batch: batch, transform=F.reverse).collect()}
    assert got == {1: 1, 2: 0}


def test_training_grid(spark):
    """Runs over models, ratios and strengths; a class told by its layer is learned."""
    rows = [(i, [float(i % 4 == 0) * 2 - 1 + 0.01 * i] * 8 + [0.0] * 56, int(i % 4 == 0)) for i in range(80)]
    df = spark.createDataFrame(rows, "tile_id long, tensor array<double>, is_target int")
    got = scoring.train_grid(df, ["red", "nir"], [1.0, 2.0], [0.01], 8, models=("logistic", "tree", "forest")).collect()
    assert sorted((r.model, r.ratio, r.n_rows) for r in got) == [(m, ratio, 80) for m in ("forest", "logistic", "tree") for ratio in (1.0, 2.0)]
    assert all(r.n_right >= 76 for r in got)
    held = scoring.train_grid(df.filter("tile_id < 60"), ["red", "nir"], [1.0], [0.01], 8, models=("logistic",), validate=df.filter("tile_id >= 60")).collect()
    assert [r.n_rows for r in held] == [20] and held[0].n_right >= 18


def test_mask_keeps_null_out_of_median(spark):
    obs = spark.createDataFrame([(0, 0, "B02", 0.0, 1), (0, 0, "B02", 5000.0, 1), (0, 0, "B02", 100.0, 0), (0, 0, "B02", 200.0, 1), (0, 1, "B02", 0.0, 1)], "px_row int, px_col int, band string, value double, clear int").withColumn("mgrs", F.lit("A"))
    got = {r.px_col: r.value for r in composite.median_composite(obs).collect()}
    assert got == {0: 200.0, 1: None}


def test_block_form_equals_long_form(spark):
    obs = view(spark, DATA, "obs")
    long = {(r.mgrs, r.band, r.px_row, r.px_col): r.value for r in composite.median_composite(obs.groupBy("mgrs", "band", "px_row", "px_col", "acq_date").agg(F.median(composite.masked(F.col("value"), F.col("clear"))).alias("value")).withColumn("clear", F.lit(1))).collect() if r.value is not None}
    block = composite.block_median(composite.blocks(obs, 10), 10)
    assert "Exchange" in plan(block)
    assert {(r.mgrs, r.band, r.px_row, r.px_col): r.value for r in block.collect()} == long


NAMES = {
    "optical_composite_Uganda_Kibaale_35MRV_B02_B03_B04.tif": "optical_composite",
    "optical_composite_slice_Uganda_Kibaale_35MRV_B03_0_500.tif": "optical_composite_slice",
    "Uganda_Kafefe_35_MR_V_2020_1_1_0_B02.jp2": "sentinel2_tile",
    "Uganda_Kafefe_35_MR_V_2020_1_1_0_qi_MSK_CLOUDS_B00.gml": "sentinel2_cloud",
    "sr_tile_match_Uganda_400.csv": "single_region_tile_match",
    "sr_tile_match_Uganda_Kabarole_400.csv": "single_region_tile_match",
    "sr_tile_match_Uganda_Kabarole_35MRV_400.csv": "single_region_tile_match",
    "mr_tile_match_Cote d'Ivoire_Rwanda_Uganda_300.csv": "multi_region_tile_match",
    "Cote D'Ivoire_Kafefe_35MRV_350_200_300.tif": "tile",
    "Cote D'Ivoire_Kafefe_35MRV_350_200_300.pt": "tensor",
    "Cote D'Ivoire_Rwanda_Uganda_resnet18_r5.0_ts300_green_nir_osm-water_epoch5.tar": "trained_model",
    "Cote D'Ivoire_Rwanda_Uganda_resnet18_r5.0_ts300_green_nir_osm-water_epoch5_best.tar": "trained_model",
    "train_Cote D'Ivoire_Rwanda_Uganda_70_ts300.csv": "train_split",
    "validate_Cote D'Ivoire_Rwanda_Uganda_70_ts300.csv": "validate_split",
    "off_nominal.txt": None,
}


def test_catalog_round_trip(spark):
    assets = spark.createDataFrame([(f"a/b/{n}",) for n in NAMES], "path string")
    parsed = catalog.parse(assets)
    got = {r["name"]: (r.kind, r.rebuilt) for r in catalog.with_names(parsed).collect()}
    assert {n: k for n, (k, _) in got.items()} == NAMES
    assert all(r == n for n, (k, r) in got.items() if k)
    assert catalog.round_trip(parsed).isEmpty()


def test_slice_with_top_above_bottom_is_none(spark):
    assets = spark.createDataFrame([("optical_composite_slice_U_K_35MRV_B03_600_500.tif",)], "path string")
    assert catalog.parse(assets).first().kind is None


def test_labels_use_a_point_once_and_skip_edges(spark):
    points = spark.createDataFrame([(1, 1.5, 1.5), (2, 1.7, 1.2), (3, 3.0, 1.0), (4, 3.5, 0.5)], "bridge_id int, x double, y double").withColumn("mgrs", F.lit("A"))
    got = {(r.tx, r.ty): r.bridge_id for r in tiles.label_tiles(points, 3.0).collect()}
    assert got == {(0, 0): 1, (1, 0): 4}


def test_no_nested_loops(spark):
    feet = view(spark, DATA, "feature").select("mgrs", "feature_id", F.col("x0").alias("x_lo"), F.col("x1").alias("x_hi"), F.col("y0").alias("y_lo"), F.col("y1").alias("y_hi"))
    assert "NestedLoop" not in plan(cover.truth_in_footprint(view(spark, DATA, "truth"), feet))
    assert "LeftSemi" in plan(metrics.subset(view(spark, DATA, "pred"), view(spark, DATA, "val")))


def test_split_is_a_partition(spark):
    rows = view(spark, DATA, "val")
    out = dataset.stratified_split(rows, 70, ["is_target"], [F.expr("tile_id * 7919 % 10007"), F.col("tile_id")])
    assert out.count() == rows.count() == out.select("tile_id").distinct().count()
    for n, train in out.groupBy("is_target").agg(F.count("*"), F.count_if(F.col("split") == "train")).select("count(1)", "count_if((split = train))").collect():
        assert train == round(n * 0.7)


def test_epoch_sample_draws_nothing_twice(spark):
    rows = view(spark, DATA, "val")
    order = [F.col("tile_id")]
    first = dataset.epoch_sample(rows, 0.5, order)
    second = dataset.epoch_sample(rows, 0.5, order, used=first)
    both = first.filter("is_target = 0").join(second.filter("is_target = 0"), "tile_id")
    assert both.isEmpty()


def test_roc_is_monotone_and_ends_at_one(spark):
    pairs = metrics.aligned(view(spark, DATA, "pred"), view(spark, DATA, "val"))
    roc = metrics.roc_curve(pairs).orderBy(F.desc("threshold")).collect()
    assert all(a.tpr <= b.tpr and a.fpr <= b.fpr for a, b in zip(roc, roc[1:]))
    assert roc[-1].tpr == roc[-1].fpr == 1.0


def test_thresholds_and_names_are_checked(spark):
    with pytest.raises(ValueError):
        metrics.check_threshold(1.0)
    with pytest.raises(TypeError):
        metrics.check_column(3)
    with pytest.raises(ValueError):
        requested(view(spark, DATA, "registry"), regions=["ATLANTIS"])
    with pytest.raises(ValueError):
        tiles.select_layers(view(spark, DATA, "tile"), ["purple"], 8)


@pytest.mark.parametrize("lat,lon", [(0.3, 32.5), (-1.9, 30.1), (51.5, -0.1), (-33.9, 151.2)])
def test_utm_round_trip(spark, lat, lon):
    df = spark.createDataFrame([(lat, lon)], "lat double, lon double").withColumn("epsg", geo.utm_epsg(F.col("lat"), F.col("lon")))
    df = df.withColumn("p", geo.to_utm(F.col("lat"), F.col("lon"), F.col("epsg"))).withColumn("q", geo.from_utm(F.col("p.x"), F.col("p.y"), F.col("epsg")))
    r = df.first()
    assert abs(r.q.lat - lat) < 1e-7 and abs(r.q.lon - lon) < 1e-7
    assert 160000 < r.p.x < 840000


def test_known_utm_point(spark):
    """The Eiffel Tower, 31U 448251.8 5411932.7."""
    df = spark.createDataFrame([(48.8582, 2.2945)], "lat double, lon double")
    p = df.select(geo.to_utm(F.col("lat"), F.col("lon"), F.lit(32631)).alias("p")).first().p
    assert abs(p.x - 448251.8) < 20 and abs(p.y - 5411932.7) < 20


def test_cell_names(spark):
    df = spark.createDataFrame([(-1, -13), (0, 3)], "lat int, lon int").select(geo.cell_name(F.col("lat"), F.col("lon")).alias("n"))
    assert [r.n for r in df.collect()] == ["S01W013", "N00E003"]


def test_results_refuse_to_overwrite(spark, tmp_path):
    df = spark.range(3)
    scoring.write_results(df, str(tmp_path / "x"))
    with pytest.raises(Exception):
        scoring.write_results(df, str(tmp_path / "x"))


def test_augment_flip(spark):
    t = spark.createDataFrame([(k, [0, 1, 2, 3, 4, 5]) for k in range(4)], "k int, tensor array<int>")
    got = {r.k: r.tensor for r in tiles.augment_flip(t, F.col("k"), 2, 3).collect()}
    assert got == {0: [0, 1, 2, 3, 4, 5], 1: [3, 4, 5, 0, 1, 2], 2: [2, 1, 0, 5, 4, 3], 3: [5, 4, 3, 2, 1, 0]}


def test_empty_inputs(spark):
    pairs = metrics.aligned(view(spark, DATA, "pred"), view(spark, DATA, "val")).limit(0)
    assert metrics.confusion(pairs).first().asDict() == {"tp": 0, "tn": 0, "fp": 0, "fn": 0}
    assert composite.median_composite(view(spark, DATA, "obs").limit(0)).isEmpty()
    assert tiles.dedupe_truth(view(spark, DATA, "match").limit(0)).isEmpty()


def test_checkpoints_of_all_customers(spark, tmp_path):
    from orbitile.plans.evaluation import checkpoint_scan

    spark.range(13000).selectExpr("id as c_custkey", "cast(id as double) as c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    assert checkpoint_scan(spark, str(tmp_path)).count() == 13000


def test_resample_reads_the_whole_raster(spark, tmp_path):
    from orbitile.plans.raster import resample_nearest

    spark.range(5000).selectExpr("id as p_partkey", "cast(id as double) as p_retailprice", "0 as p_size").write.parquet(f"{tmp_path}/part.parquet")
    line = "id as l_partkey", "id as l_suppkey", "id as l_orderkey", "1e0 as l_quantity", "'R' as l_returnflag", "timestamp '2020-01-01 00:00:00' as l_shipdate"
    spark.range(5000).selectExpr(*line).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.mgrs, r.px_row, r.px_col): r.elevation for r in resample_nearest(spark, str(tmp_path)).collect()}
    seen = {("35MRV" if i % 3 == 0 else "36MGR", i // 50, i % 50) for i in range(5000)}
    at = lambda g, y, x: (min(y // 3, 49) * 2 + (g == "36MGR")) * 50.0 + x // 3
    assert got == {k: at(*k) for k in seen}
