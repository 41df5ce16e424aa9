"""Splits, epoch samples and training bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitile.operators.tiles import dedupe_truth
from orbitile.sources.io import scratch

def order_key(key: Column, seed: int = 0) -> Column:
    """A deterministic random order that does not hang on partitioning."""
    return F.xxhash64(key, F.lit(seed))


def class_counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def ranked(rows: DataFrame, order, strata=(), parts: int | None = None) -> DataFrame:
    """Adds _rank and _all: the row's rank among its stratum in ``order``, and the stratum's size.

    Rows are sorted in ranges of (strata, order), so a stratum of any size is spread over
    tasks, and written once with their places; a rank is the place within the range plus the
    rows of the stratum in the ranges before. The source is read twice, once for the ranges'
    bounds, whatever reads the result. ``parts`` sets the number of ranges. Null strata are
    strata like any other.
    """
    strata = list(strata)
    sort = [F.col(c) for c in strata] + list(order)
    placed = (rows.repartitionByRange(parts, *sort) if parts else rows.repartitionByRange(*sort)).sortWithinPartitions(*sort)
    # the number of a row is its partition's, in the upper 31 bits, and its place there
    numbered = placed.withColumn("_at", F.monotonically_increasing_id())
    path = scratch(rows.sparkSession, "ranked")
    numbered.write.parquet(path)
    stored = rows.sparkSession.read.schema(numbered.schema).parquet(path).withColumn("_part", F.shiftright("_at", 33))
    counts = stored.groupBy(*strata, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    ahead = Window.partitionBy(*strata).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*strata, "_part", "_first", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*strata)).alias("_all"))
    out = _null_safe(stored, base, [*strata, "_part"])
    return out.withColumn("_rank", F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_at", "_part", "_first", "_before")


def _null_safe(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Join on keys among which nulls are equal; with no keys the right side is one row."""
    if not keys:
        return left.join(F.broadcast(right), how="cross")  # one row
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(named[f"_r_{k}"]) for k in keys]
    return left.join(named, on).drop(*[f"_r_{k}" for k in keys])


def stratified_split(rows: DataFrame, ratio: int, strata, order) -> DataFrame:
    """Adds split: in each stratum round(ratio% of n), half to even, rows train, the first in ``order``."""
    train = F.col("_rank") <= F.bround(F.col("_all") * (ratio / 100.0), 0)
    return ranked(rows, order, strata).withColumn("split", F.when(train, "train").otherwise("validate")).drop("_rank", "_all")


def region_split(match: DataFrame, ratio: int, order, dedupe_first: bool = False, seq: str = "seq") -> DataFrame:
    """Splits the tile matches of several regions, each region and class by itself.

    A location that several regions hold may fall in train and in validate; with
    ``dedupe_first`` its first row alone takes part.
    """
    rows = dedupe_truth(match, seq) if dedupe_first else match
    return stratified_split(rows, ratio, ["region", "is_bridge"], order)


def epoch_sample(rows: DataFrame, ratio: float, order, used: DataFrame | None = None, key: str = "tile_id") -> DataFrame:
    """All positives and round(ratio x positives) negatives not in ``used``, each once.

    The negatives are the first in ``order``, by ``ranked``; how many are wanted stays a
    one-row table of the plan.
    """
    negatives = rows.filter("is_target = 0")
    if used is not None:
        negatives = negatives.join(used.select(key), key, "left_anti")
    wanted = rows.filter("is_target = 1").agg(F.bround(F.count("*") * ratio, 0).cast("long").alias("_k"))
    places = ranked(negatives, order).join(F.broadcast(wanted), how="cross")  # one row
    return rows.filter("is_target = 1").unionByName(places.filter(F.col("_rank") <= F.col("_k")).select(*rows.columns))


def draw_negatives(rows: DataFrame, ratio: float, order, drawn=None) -> DataFrame:
    """round(ratio x positives) negatives, drawn with replacement: one row a draw, with its number ``draw``.

    Draw i, from 1, takes the negative of rank ``drawn(i, n)``, 0 to n - 1 (by default a
    hash of i modulo n); ranks come from ``ranked``. Draws are rows of a range and meet the
    ranked negatives in a join, so that no task holds them all. Without negatives there is none.
    """
    drawn = drawn or (lambda i, n: F.pmod(F.xxhash64(i, F.lit(17)), n))
    wanted = rows.filter("is_target = 1").agg(F.bround(F.count("*") * ratio, 0).cast("long").alias("k")).first()["k"]
    places = ranked(rows.filter("is_target = 0"), order)
    size = rows.filter("is_target = 0").agg(F.count("*").alias("_n")).filter("_n > 0")
    draws = rows.sparkSession.range(1, wanted + 1).withColumnRenamed("id", "draw").join(F.broadcast(size), how="cross")  # one row
    draws = draws.select("draw", (drawn(F.col("draw"), F.col("_n")) + 1).alias("_rank"))
    return places.join(draws, "_rank").select("draw", *rows.columns)


def best_epochs(history: DataFrame, *keys: str) -> DataFrame:
    """Adds is_best: accuracy above all earlier epochs' (from 0)."""
    before = Window.partitionBy(*keys).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    return history.withColumn("is_best", F.col("acc") > F.coalesce(F.max("acc").over(before), F.lit(0.0)))


def best_checkpoint(history: DataFrame, *keys: str) -> DataFrame:
    """The last best epoch of each run."""
    return best_epochs(history, *keys).filter("is_best").groupBy(*keys).agg(F.max_by("path", "epoch").alias("path"), F.max("epoch").alias("epoch"))


def ratio_box_stats(checkpoints: DataFrame, acc: str = "total_acc") -> DataFrame:
    """Minimum, quartiles and maximum of an accuracy per class ratio."""
    q = F.percentile(acc, F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    out = checkpoints.groupBy("ratio").agg(q.alias("q"))
    return out.select("ratio", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("low", "q1", "middle", "q3", "high"))])


def epoch_series(checkpoints: DataFrame, acc: str = "total_acc") -> DataFrame:
    """Mean accuracy per epoch as one array per ratio, in epoch order."""
    mean = checkpoints.groupBy("ratio", "epoch").agg(F.avg(acc).alias("acc"))
    return mean.groupBy("ratio").agg(F.transform(F.array_sort(F.collect_list(F.struct("epoch", "acc"))), lambda x: x["acc"]).alias("series"))
