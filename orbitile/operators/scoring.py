"""Batch scoring with a user's model, training of model grids, and their sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def softmax(scores: Column) -> Column:
    """Softmax of an array of scores."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    return F.transform(e, lambda x: x / total)


def argmax(scores: Column) -> Column:
    """Index of the first greatest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def score_tiles(tiles: DataFrame, model_fn: Callable[[np.ndarray], np.ndarray], key: str = "tile_id", tensor: str = "tensor", target: str | None = None, transform: Callable[[Column], Column] | None = None) -> DataFrame:
    """Runs ``model_fn(batch of tensors) -> class scores`` over tiles in Arrow batches.

    Returns key, pred and conf (softmax of the predicted class), and the target if the
    tiles have one. ``transform`` is applied to the tensor column first.
    """
    passed = [target] if target and target in tiles.columns else []
    if transform is not None:
        tiles = tiles.withColumn(tensor, transform(F.col(tensor)))
    rows = tiles.select(key, *passed, tensor)
    schema = ", ".join([f"{key} {dict(rows.dtypes)[key]}", *[f"{t} {dict(rows.dtypes)[t]}" for t in passed], "pred int", "conf double"])

    def run(batches: Iterator) -> Iterator:
        for frame in batches:
            if len(frame) == 0:
                continue
            s = np.asarray(model_fn(np.stack(frame[tensor].to_numpy())), np.float64)
            e = np.exp(s - s.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            out = frame[[key, *passed]].copy()
            out["pred"], out["conf"] = p.argmax(axis=1).astype(np.int32), p.max(axis=1)
            yield out

    return rows.mapInPandas(run, schema)


def write_results(results: DataFrame, path: str) -> None:
    """Results as Parquet; a path that exists is an error."""
    results.write.mode("errorifexists").parquet(path)


def _estimator(name: str, strength: float):
    from pyspark.ml import classification as ml

    if name == "logistic":
        return ml.LogisticRegression(maxIter=10, regParam=strength)
    if name == "tree":
        return ml.DecisionTreeClassifier(maxDepth=5, minInfoGain=min(strength, 0.1), seed=1)
    if name == "forest":
        return ml.RandomForestClassifier(numTrees=10, maxDepth=5, minInfoGain=min(strength, 0.1), seed=1)
    raise ValueError(f"unknown model {name}")


def train_grid(tiles: DataFrame, names, ratios, strengths, pixels: int, models=("logistic", "tree"), validate: DataFrame | None = None) -> DataFrame:
    """A classifier on chosen layers for each model, class ratio and regularisation.

    One row a run: model, ratio, strength, rows judged, rows judged right. Runs are judged on
    ``validate``, tiles that none of them learns from; without it on ``tiles`` themselves.
    """
    from pyspark.ml.functions import array_to_vector

    from orbitile.operators.dataset import epoch_sample, order_key
    from orbitile.operators.tiles import select_layers

    def featured(of: DataFrame) -> DataFrame:
        return select_layers(of, names, pixels).select("tile_id", F.col("is_target").cast("double").alias("label"), F.col("is_target"), array_to_vector(F.col("tensor").cast("array<double>")).alias("features"))

    rows, judged = featured(tiles), featured(validate if validate is not None else tiles)
    out = []
    for ratio in ratios:
        sample = epoch_sample(rows, ratio, [order_key(F.col("tile_id")), F.col("tile_id")]).cache()
        for model in models:
            for strength in strengths:
                fitted = _estimator(model, strength).fit(sample)
                right = fitted.transform(judged).agg(F.count("*").alias("n_rows"), F.sum((F.col("prediction") == F.col("label")).cast("long")).alias("n_right"))
                out.append(right.select(F.lit(model).alias("model"), F.lit(float(ratio)).alias("ratio"), F.lit(float(strength)).alias("strength"), "n_rows", "n_right"))
        sample.unpersist()
    every = out[0]
    for r in out[1:]:
        every = every.unionByName(r)
    return every
