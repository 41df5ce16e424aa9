"""Training by gradient steps that Spark sums, with metrics and a checkpoint each epoch."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitile.operators.metrics import class_accuracy
from orbitile.operators.tiles import select_layers
from orbitile.sources.io import CHECKPOINT, read_checkpoints


def layer_features(tiles: DataFrame, names, pixels: int) -> DataFrame:
    """tile_id, target and x: the values of one to three layers, and a 1 for the constant term."""
    chosen = select_layers(tiles, names, pixels)
    return chosen.select("tile_id", F.col("is_target").alias("target"), F.concat(F.col("tensor").cast("array<double>"), F.array(F.lit(1.0))).alias("x"))


def margin(x: Column, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(x, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def gradient(rows: DataFrame, weights: list[float]) -> list[float]:
    """Mean gradient of the log-loss over ``rows(target, x)``: one vector a task is summed, whatever the rows."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    error = 1 / (1 + F.exp(-margin(F.col("x"), weights))) - F.col("target")
    pulled = rows.withColumn("_e", error).select(array_to_vector(F.transform("x", lambda v: v * F.col("_e"))).alias("g"))
    mean = pulled.agg(Summarizer.mean(F.col("g")).alias("g")).first()["g"]
    return [float(v) for v in mean.toArray()]


def judged(rows: DataFrame, weights: list[float]) -> DataFrame:
    """Rows with pred and their log-loss."""
    z = margin(F.col("x"), weights)
    loss = F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - z * F.col("target")
    return rows.select("tile_id", "target", (z > 0).cast("int").alias("pred"), loss.alias("loss"))


def train_epochs(train: DataFrame, validate: DataFrame, names, pixels: int, path: str, epochs: int = 4, rate: float = 0.5, ratio: float = 1.0) -> DataFrame:
    """Logistic regression on chosen layers, a full gradient step an epoch; the checkpoints at ``path``.

    ``train`` and ``validate`` hold tile_id, tensor and is_target. Only weights, one number a
    feature, pass through the driver. Each epoch is judged on ``validate``, which it never
    learns from, and appended to ``path``, so that a broken run leaves its checkpoints.
    An epoch whose loss is not a number ends the run with an error.
    """
    spark = train.sparkSession
    rows, held_out = layer_features(train, names, pixels), layer_features(validate, names, pixels)
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("no rows to learn from")
    weights = [0.0] * first["n"]
    for epoch in range(epochs):
        weights = [w - rate * g for w, g in zip(weights, gradient(rows, weights), strict=True)]
        if not all(map(math.isfinite, weights)):
            raise ValueError(f"weights left the range of numbers in epoch {epoch}")
        found = class_accuracy(judged(held_out, weights)).first()
        name = f"logistic_r{ratio}_{'_'.join(names)}_epoch{epoch}.tar"
        row = [("logistic", float(ratio), epoch, found["total_acc"], found["bridge_acc"], found["no_bridge_acc"], name)]
        spark.createDataFrame(row, CHECKPOINT).coalesce(1).write.mode("append").csv(path, header=True)
    return read_checkpoints(spark, path)
