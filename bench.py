"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: the median of three runs each; prints one JSON line."""

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

HEADLINE = (
    "median_composite", "band_pivot", "blocks_to_pixels", "slope", "resample_nearest", "osm_raster", "multivariate_composite",
    "label_tiles", "tile_tensor", "region_tiles", "confusion", "roc_curve", "threshold_report", "stratified_split",
    "epoch_sample", "score_tiles", "catalog_parse", "catalog_path", "bbox_grids", "dem_cells",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from orbitile.plans.registry import queries

    found, times = queries(), {}
    found["median_composite"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the JVM's compiler
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.time()
            found[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        times[name] = round(median(runs), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
