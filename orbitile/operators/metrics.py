"""Evaluation of scored tiles: counts at a threshold, rates, ROC, best threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 0.834


def check_threshold(t: float) -> float:
    if not 0 < t < 1:
        raise ValueError("a confidence lies between 0 and 1")
    return t


def check_column(name: str) -> str:
    if not isinstance(name, str):
        raise TypeError("a column name is a string")
    return name


def threshold_pred(conf: Column, pred: Column, threshold: float = THRESHOLD) -> Column:
    """1 if the prediction is positive and sure enough, else 0."""
    return F.when((conf >= check_threshold(threshold)) & (pred == 1), 1).otherwise(0)


def positive_conf(conf: Column, pred: Column) -> Column:
    return F.when(pred == 1, conf).otherwise(1.0 - conf)


def subset(results: DataFrame, validation: DataFrame, key: str = "tile_id") -> DataFrame:
    """Results whose key is in the validation set."""
    return results.join(validation, check_column(key), "left_semi")


def aligned(results: DataFrame, validation: DataFrame, key: str = "tile_id") -> DataFrame:
    """Predictions with their targets, by key."""
    return results.join(validation, check_column(key))


def unmatched(results: DataFrame, validation: DataFrame, key: str = "tile_id") -> DataFrame:
    """How many keys of either side have no partner."""
    both = results.select(key, F.lit(1).alias("a")).join(validation.select(key, F.lit(1).alias("b")), key, "full")
    return both.agg(F.sum(F.when(F.col("b").isNull(), 1).otherwise(0)).alias("no_target"), F.sum(F.when(F.col("a").isNull(), 1).otherwise(0)).alias("no_result"))


def confusion(pairs: DataFrame, threshold: float = THRESHOLD, prediction_column: str = "pred", confidence_column: str = "conf", validation_column: str = "is_target") -> DataFrame:
    """True and false positives and negatives at a threshold, in one pass."""
    p = threshold_pred(F.col(check_column(confidence_column)), F.col(check_column(prediction_column)), threshold)
    t = F.col(check_column(validation_column))
    count = lambda a, b, name: F.coalesce(F.sum(F.when((p == a) & (t == b), 1).otherwise(0)), F.lit(0)).cast("long").alias(name)
    return pairs.agg(count(1, 1, "tp"), count(0, 0, "tn"), count(1, 0, "fp"), count(0, 1, "fn"))


def rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, the sum of both, true F1, and accuracy in percent."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    precision, recall = F.when(tp == 0, 0.0).otherwise(tp / (tp + fp)), F.when(tp == 0, 0.0).otherwise(tp / (tp + fn))
    out = counts.withColumns({"precision": precision, "recall": recall, "accuracy": (tp + tn) / (tp + tn + fp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumns({"f1_sum": p + r, "f1": F.when(p + r == 0, 0.0).otherwise(2.0 * p * r / (p + r))})


def roc_curve(pairs: DataFrame, parts: int = 64) -> DataFrame:
    """One point per distinct score: threshold, cumulative tp and fp, and their rates.

    Rows are first summed to distinct scores. Running sums go by score ranges: a total
    for each of ``parts`` ranges, summed over that many rows, then running sums inside
    each range. The ranges are cut at quantiles of the distinct scores, so that crowded
    scores are spread and no task holds more than about one part of them.
    """
    score = positive_conf(F.col("conf"), F.col("pred")).alias("threshold")
    points = pairs.groupBy(score).agg(F.sum("is_target").alias("p"), F.sum(F.lit(1) - F.col("is_target")).alias("n"))
    cuts = points.agg(F.percentile_approx("threshold", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(20 * parts)).alias("cuts"))
    part = F.size(F.filter("cuts", lambda c: c <= F.col("threshold")))
    points = points.join(F.broadcast(cuts), how="cross").withColumn("part", part).drop("cuts")  # one row
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # at most ``parts`` rows
    every = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = points.groupBy("part").agg(F.sum("p").alias("pp"), F.sum("n").alias("nn"))
    bases = totals.select("part", F.coalesce(F.sum("pp").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("nn").over(above), F.lit(0)).alias("n0"), F.sum("pp").over(every).alias("all_p"), F.sum("nn").over(every).alias("all_n"))
    inside = Window.partitionBy("part").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    run = points.withColumns({"tp": F.sum("p").over(inside), "fp": F.sum("n").over(inside)}).join(F.broadcast(bases), "part")
    tp, fp = F.col("tp") + F.col("p0"), F.col("fp") + F.col("n0")
    return run.select("threshold", tp.alias("tp"), fp.alias("fp"), F.try_divide(tp, F.col("all_p")).alias("tpr"), F.try_divide(fp, F.col("all_n")).alias("fpr"))


def best_threshold(roc: DataFrame) -> DataFrame:
    """The first point of the greatest geometric mean of tpr and 1 - fpr, rounded to 4."""
    g = F.sqrt(F.col("tpr") * (1.0 - F.col("fpr")))
    top = roc.withColumn("gmean", g).orderBy(F.desc("gmean"), F.desc("threshold")).limit(1)
    return top.select(*[F.bround(c, 4).alias(c) for c in ("threshold", "gmean", "fpr", "tpr")])


def at_confidence(roc: DataFrame, confidence: float) -> DataFrame:
    """The point of the highest threshold below a confidence."""
    return roc.filter(F.col("threshold") < check_threshold(confidence)).orderBy(F.desc("threshold")).limit(1)


def threshold_report(pairs: DataFrame) -> DataFrame:
    """Best threshold with the rates of the counts at it."""
    best = best_threshold(roc_curve(pairs))
    hit = (F.col("conf") >= F.col("threshold")) & (F.col("pred") == 1)
    t = F.col("is_target") == 1
    count = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(name)
    joined = pairs.join(F.broadcast(best), how="cross")  # one row
    counts = joined.groupBy("threshold", "gmean", "fpr", "tpr").agg(count(hit & t, "tp"), count(~hit & ~t, "tn"), count(hit & ~t, "fp"), count(~hit & t, "fn"))
    return rates(counts).select("threshold", "gmean", "fpr", "tpr", "precision", "f1_sum", "accuracy")


def class_accuracy(rows: DataFrame, *keys: str) -> DataFrame:
    """Percent right in all and per class; a class without rows gives null."""
    right = F.when(F.col("pred") == F.col("target"), 1.0).otherwise(0.0)
    return rows.groupBy(*keys).agg((F.avg(right) * 100).alias("total_acc"), (F.avg(F.when(F.col("target") == 1, right)) * 100).alias("bridge_acc"), (F.avg(F.when(F.col("target") == 0, right)) * 100).alias("no_bridge_acc"))


def weighted_mean(rows: DataFrame, value: str, weight: str, *keys: str) -> DataFrame:
    """Running-meter mean: sum of value x weight over weights, missing values skipped."""
    v, n = F.col(value).cast("double"), F.col(weight)
    good = v.isNotNull() & ~F.isnan(v)
    total, count = F.sum(F.when(good, v * n)), F.sum(F.when(good, n))
    return rows.groupBy(*keys).agg(F.try_divide(total, count).alias("mean"), total.alias("total"), count.alias("count"))
