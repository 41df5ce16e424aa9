"""Readers and writers of the engine's tables and files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE_MATCH = T.StructType([T.StructField("tile", T.StringType()), T.StructField("bbox", T.StringType()), T.StructField("is_bridge", T.BooleanType()), T.StructField("bridge_loc", T.StringType())])
CHECKPOINT = "architecture string, ratio double, epoch int, total_acc double, bridge_acc double, no_bridge_acc double, path string"
DISTRICTS = "struct<dates: array<array<string>>, districts: map<string, struct<bbox: array<double>, dates: array<string>, ground_truth: boolean>>>"
RESULT = T.StructType([T.StructField("tile_id", T.LongType()), T.StructField("pred", T.IntegerType()), T.StructField("conf", T.DoubleType())])


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder all executors see: below spark.checkpoint.dir or the session's checkpoint folder, or, on one machine only, a temporary one where neither is set."""
    base, current = spark.sparkContext.getConf().get("spark.checkpoint.dir", None), spark.sparkContext._jsc.sc().getCheckpointDir()
    if not base and current.isDefined():
        base = current.get()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/orbitile/{name}-{uuid.uuid4().hex[:12]}"


def read_tile_match(spark: SparkSession, path: str) -> DataFrame:
    """Tile-match CSV with a fixed schema; whether it has the truth columns is read from its header."""
    header = spark.read.csv(path, header=True).columns  # the first line only
    known = {f.name: f for f in TILE_MATCH.fields}
    if missing := {"tile", "bbox"} - set(header):
        raise ValueError(f"no tile match: {sorted(missing)} missing")
    schema = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in header])
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"')


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT).csv(path, header=True)


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Checkpoint tables of training runs."""
    return spark.read.schema(CHECKPOINT).csv(path, header=True)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """One row a region and district from nested text: region, dates and districts, then bbox and ground_truth.

    ``dates`` are a list of ranges of the region, which hold for its districts, or one range
    of a district. Column ``ranges`` holds them, date_from and date_to their first and last
    day; a range that ends before it begins is left out. Files are JSON, one document each or one a line; ``registry_of`` takes the same nesting
    from any other reader, such as one of YAML.
    """
    lines = spark.read.text(path).select(F.from_json("value", f"map<string, {DISTRICTS}>").alias("regions"))
    return _registry_rows(lines)


def registry_of(spark: SparkSession, nested: dict) -> DataFrame:
    """The registry from nested dicts as a configuration file holds them."""
    import json

    text = spark.createDataFrame([(json.dumps(nested, default=str),)], "value string")
    return _registry_rows(text.select(F.from_json("value", f"map<string, {DISTRICTS}>").alias("regions")))


def _registry_rows(frame: DataFrame) -> DataFrame:
    # columns of their own, so that no district's row holds the others of its region
    regions = frame.select(F.explode("regions").alias("region", "r")).select("region", F.col("r.dates").alias("_dates"), F.col("r.districts").alias("_districts"))
    flat = regions.select("region", "_dates", F.explode("_districts").alias("district", "e"))
    box = [F.get("e.bbox", F.lit(i)).alias(c) for i, c in enumerate(("min_lon", "min_lat", "max_lon", "max_lat"))]
    lists = F.when(F.col("e.dates").isNotNull(), F.array("e.dates")).otherwise(F.col("_dates"))
    ranges = F.transform(lists, lambda d: F.struct(F.get(d, F.lit(0)).cast("date").alias("date_from"), F.get(d, F.lit(1)).cast("date").alias("date_to")))
    ranges = F.filter(ranges, lambda r: r["date_from"] <= r["date_to"])
    first, last = F.array_min(F.transform("ranges", lambda r: r["date_from"])), F.array_max(F.transform("ranges", lambda r: r["date_to"]))
    out = flat.withColumn("ranges", ranges)
    return out.select("region", "district", *box, first.alias("date_from"), last.alias("date_to"), F.coalesce("e.ground_truth", F.lit(False)).alias("ground_truth"), "ranges")


def numeric_keys(frame: DataFrame, column: str) -> DataFrame:
    """One row a key of JSON objects of whole numbers, with the key as a number where it parses."""
    pairs = frame.select("*", F.explode(F.from_json(column, "map<string, bigint>")).alias("key", "value"))
    return pairs.withColumn("number", F.expr("try_cast(key as double)"))


def read_truth_csv(spark: SparkSession, path: str) -> DataFrame:
    """Truth points of CSV files with Latitude and Longitude among their columns: lat, lon and point (x is the latitude).

    Columns are found by name, whatever their order; rows without either number are left out.
    """
    header = spark.read.csv(path, header=True).columns  # the first line only
    if missing := {"Latitude", "Longitude"} - set(header):
        raise ValueError(f"no truth file: {sorted(missing)} missing")
    rows = spark.read.schema(", ".join(f"`{c}` string" for c in header)).csv(path, header=True)
    lat, lon = (F.expr(f"try_cast({c} as double)") for c in ("Latitude", "Longitude"))
    points = rows.select(lat.alias("lat"), lon.alias("lon")).dropna()
    return points.withColumn("point", F.struct(F.col("lat").alias("x"), F.col("lon").alias("y")))


def read_truth_points(rows: DataFrame) -> DataFrame:
    """Truth points that have both coordinates."""
    return rows.dropna(subset=["x", "y"])


def list_assets(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, length and time of files below ``path``, on any file system; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "modificationTime")


def latest_truth(files: DataFrame) -> DataFrame:
    """The file whose name bears the latest MM.dd.yyyy date."""
    day = F.to_date(F.regexp_extract("path", r"(\d{2}\.\d{2}\.\d{4})", 1), "MM.dd.yyyy")
    return files.withColumn("day", F.when(F.col("path").rlike(r"\d{2}\.\d{2}\.\d{4}"), day)).filter("day is not null").agg(F.max_by("path", F.struct("day", "path")).alias("path"), F.max("day").alias("day"))


def write_composite(composite: DataFrame, path: str, keys=("region", "district", "mgrs")) -> DataFrame:
    """A composite of any number of bands, a folder a grid; only the grids written are replaced. Returns the table."""
    composite.write.partitionBy(*keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return composite.sparkSession.read.parquet(path)


def write_blocks(blocks: DataFrame, path: str) -> DataFrame:
    """A table of block arrays, a folder a grid and band, so that readers open only those they ask for."""
    blocks.write.partitionBy("mgrs", "band").mode("append").parquet(path)
    return blocks.sparkSession.read.parquet(path)


def read_blocks(spark: SparkSession, path: str, grids=None, bands=None) -> DataFrame:
    """Blocks of the named grids and bands (all if None); folders of others are not opened."""
    blocks = spark.read.parquet(path)
    for column, names in (("mgrs", grids), ("band", bands)):
        if names is not None:
            blocks = blocks.filter(F.col(column).isin(list(names)))
    return blocks


def finished_work(spark: SparkSession, path: str, keys: str) -> DataFrame:
    """The table of finished work at ``path`` (``keys`` as a schema); none yet is an empty one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.read.schema(keys).parquet(path)
    return spark.createDataFrame([], keys)


def composites_of_pending(observations: DataFrame, wanted: DataFrame, build, path: str, log: str) -> DataFrame:
    """Composites of the grids of ``wanted(region, district, mgrs)`` that ``log`` does not list, written at ``path``.

    What is pending is known before observations are read: the names of the pending grids, of
    which the earth has some 57,000 of 100 km, are a filter of the scan, so of a table
    partitioned by grid no other folder is opened. ``build(observations, grids)`` makes the composite.
    A grid is listed after its folder has been written; a run that breaks in between writes the
    folder again, so runs can be repeated. Returns the table of composites.
    """
    spark, keys = observations.sparkSession, ["region", "district", "mgrs"]
    done = finished_work(spark, log, "region string, district string, mgrs string")
    pending = wanted.select(*keys).distinct().join(done, keys, "left_anti")
    grids = pending.select("mgrs").distinct()
    names = [r["mgrs"] for r in grids.collect()]  # grid squares of the earth at most
    work = observations.filter(F.col("mgrs").isin(names))
    write_composite(build(work, grids).join(F.broadcast(pending), "mgrs"), path)
    pending.write.mode("append").parquet(log)
    return spark.read.parquet(path)


def tile_match_levels(tiles: DataFrame, path: str) -> DataFrame:
    """One table partitioned by region, district, grid and tile size; levels are filters of it."""
    tiles.write.partitionBy("region", "district", "mgrs", "tile_size").parquet(path)
    return tiles.sparkSession.read.parquet(path)
