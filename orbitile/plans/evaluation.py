"""Queries over results, splits, samples, scoring and checkpoints."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from orbitile.operators import dataset as D
from orbitile.operators import metrics as M
from orbitile.operators import scoring as S
from orbitile.operators import tiles as T
from orbitile.operators.training import train_epochs
from orbitile.sources.io import read_checkpoints, read_results, scratch
from orbitile.sources.views import oracle, view



def _order():
    """A scattered order that both engines compute alike."""
    return [F.expr("tile_id * 7919 % 10007"), F.col("tile_id")]


def _pairs(spark, d):
    return M.aligned(view(spark, d, "pred"), view(spark, d, "val"))


def _rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


def threshold_pred(spark, d):
    return view(spark, d, "pred").select("tile_id", M.threshold_pred(F.col("conf"), F.col("pred")).alias("sure"))


def subset_semi(spark, d):
    return M.subset(view(spark, d, "pred"), view(spark, d, "val"))


def pred_target_join(spark, d):
    return _pairs(spark, d)


def unmatched_keys(spark, d):
    return M.unmatched(view(spark, d, "pred"), view(spark, d, "val"))


def confusion(spark, d):
    return M.confusion(_pairs(spark, d))


def _rates(spark, d, *names):
    return _rounded(M.rates(M.confusion(_pairs(spark, d))).select(*names), *names)


def precision_recall(spark, d):
    return _rates(spark, d, "precision", "recall")


def f1(spark, d):
    return _rates(spark, d, "f1_sum", "f1")


def accuracy(spark, d):
    return _rates(spark, d, "accuracy")


def roc_curve(spark, d):
    return _rounded(M.roc_curve(_pairs(spark, d)), "threshold", "tpr", "fpr")


def best_threshold(spark, d):
    return M.best_threshold(M.roc_curve(_pairs(spark, d)))


def roc_at_confidence(spark, d):
    return _rounded(M.at_confidence(M.roc_curve(_pairs(spark, d)), 0.7), "threshold", "tpr", "fpr")


def threshold_report(spark, d):
    return _rounded(M.threshold_report(_pairs(spark, d)), "precision", "f1_sum", "accuracy")


def inference_metrics(spark, d):
    """Results written and scanned again, subset, ROC and report."""
    path = scratch(spark, "metrics")
    view(spark, d, "pred").write.csv(path, header=True)
    return _rounded(M.threshold_report(M.aligned(read_results(spark, path), view(spark, d, "val"))), "precision", "f1_sum", "accuracy")


def result_scan(spark, d):
    path = scratch(spark, "results")
    view(spark, d, "pred").write.csv(path, header=True)
    return _rounded(read_results(spark, path), "conf")


def result_sink(spark, d):
    path = scratch(spark, "sink")
    S.write_results(view(spark, d, "pred"), path)
    return spark.read.parquet(path)


def positive_conf(spark, d):
    return view(spark, d, "pred").select("tile_id", F.round(M.positive_conf(F.col("conf"), F.col("pred")), 6).alias("p"))


def _scores(spark, d):
    return view(spark, d, "score").withColumn("scores", F.array("s0", "s1"))


def softmax_argmax(spark, d):
    return _scores(spark, d).select("tile_id", F.round(F.get(S.softmax(F.col("scores")), F.lit(0)), 6).alias("p0"), S.argmax(F.col("scores")).alias("pred"))


def _judged(spark, d):
    return _scores(spark, d).withColumn("pred", S.argmax(F.col("scores")))


def class_accuracy(spark, d):
    return _rounded(M.class_accuracy(_judged(spark, d)), "total_acc", "bridge_acc", "no_bridge_acc")


def epoch_metrics(spark, d):
    rows = _judged(spark, d)
    acc = M.class_accuracy(rows, "epoch")
    loss = rows.withColumn("loss", -F.log(F.get(S.softmax(F.col("scores")), F.col("target")))).withColumn("n", F.lit(1))
    mean = M.weighted_mean(loss, "loss", "n", "epoch").select("epoch", F.col("mean").alias("loss"))
    return _rounded(acc.join(mean, "epoch"), "total_acc", "bridge_acc", "no_bridge_acc", "loss")


def weighted_mean(spark, d):
    rows = view(spark, d, "checkpoint").withColumn("v", F.when(F.col("epoch") % 5 == 0, None).otherwise(F.col("total_acc"))).withColumn("n", F.col("epoch") % 7 + 1)
    return _rounded(M.weighted_mean(rows, "v", "n", "architecture"), "mean", "total")


def checkpoint_scan(spark, d):
    """Written as CSV and scanned again."""
    path = scratch(spark, "checkpoints")
    view(spark, d, "checkpoint").write.csv(path, header=True)
    return _rounded(read_checkpoints(spark, path).select("architecture", "ratio", "epoch", "total_acc"), "total_acc")


def ratio_box_stats(spark, d):
    return _rounded(D.ratio_box_stats(view(spark, d, "checkpoint")), "low", "q1", "middle", "q3", "high")


def epoch_series(spark, d):
    out = D.epoch_series(view(spark, d, "checkpoint"))
    return out.select("ratio", F.size("series").alias("n"), F.round(F.get("series", F.lit(0)), 6).alias("first"), F.round(F.element_at("series", -1), 6).alias("last"))


def _history(spark, d):
    c = view(spark, d, "checkpoint")
    return c.groupBy("architecture", "ratio", "epoch").agg(F.max("total_acc").alias("acc"), F.min("path").alias("path"))


def best_epochs(spark, d):
    return D.best_epochs(_history(spark, d), "architecture", "ratio")


def best_checkpoint(spark, d):
    return D.best_checkpoint(_history(spark, d), "architecture", "ratio")


def class_counts(spark, d):
    return D.class_counts(view(spark, d, "tile"), "grp", "is_target")


def stratified_split(spark, d):
    return D.stratified_split(view(spark, d, "val"), 70, ["is_target"], _order())


def train_validate(spark, d):
    rows = view(spark, d, "tile").select("tile_id", "grp", "is_target")
    return D.stratified_split(rows, 70, ["grp", "is_target"], _order())


def _region_split(spark, d, dedupe_first):
    order = [F.expr("seq * 7919 % 10007"), F.col("seq")]
    return D.region_split(view(spark, d, "match"), 70, order, dedupe_first).select("seq", "region", "is_bridge", "split")


def region_split(spark, d):
    return _region_split(spark, d, False)


def region_split_deduped(spark, d):
    """Each location once before the split, so that none is in both parts."""
    return _region_split(spark, d, True)


def split_sink(spark, d):
    path = scratch(spark, "split")
    stratified_split(spark, d).write.partitionBy("split").parquet(path)
    return spark.read.parquet(path).groupBy("split", "is_target").agg(F.count("*").alias("n"))


def split_complement(spark, d):
    both = stratified_split(spark, d)
    return view(spark, d, "val").join(both.filter("split = 'train'"), "tile_id", "left_anti")


def epoch_sample(spark, d):
    return D.epoch_sample(view(spark, d, "val"), 1.5, _order())


def epoch_pool(spark, d):
    v = view(spark, d, "val")
    first = D.epoch_sample(v, 0.5, _order())
    return D.epoch_sample(v, 0.5, _order(), used=first)


def epoch_draws(spark, d):
    """Negatives with replacement, by a draw that both engines compute alike."""
    return D.draw_negatives(view(spark, d, "val"), 2.5, _order(), lambda i, n: (i * 7919 + 104729) % n)


def _split_tiles(spark, d):
    tiles = D.stratified_split(view(spark, d, "tile"), 70, ["grp", "is_target"], _order())
    return [tiles.filter(F.col("split") == s).drop("split") for s in ("train", "validate")]


def _trained(spark, d):
    return train_epochs(*_split_tiles(spark, d), ["red", "nir"], 8, scratch(spark, "epochs"), EPOCHS, RATE)


def train_history(spark, d):
    """Checkpoints of a training run, judged on its validation split each epoch, the best so far marked."""
    out = D.best_epochs(_trained(spark, d).withColumn("acc", F.col("total_acc")), "architecture", "ratio")
    return _rounded(out.select("architecture", "ratio", "epoch", "total_acc", "bridge_acc", "no_bridge_acc", "is_best"), "total_acc", "bridge_acc", "no_bridge_acc")


def trained_checkpoint(spark, d):
    return D.best_checkpoint(_trained(spark, d).withColumn("acc", F.col("total_acc")), "architecture", "ratio").select("architecture", "epoch", "path")


def _linear(batch: np.ndarray) -> np.ndarray:
    """A fixed two-class model: sums of the halves of a tensor."""
    half = batch.shape[1] // 2
    return np.stack([batch[:, :half].sum(axis=1, dtype=np.float64), batch[:, half:].sum(axis=1, dtype=np.float64)], axis=1)


def score_tiles(spark, d):
    return _rounded(S.score_tiles(view(spark, d, "tile"), _linear, target="is_target"), "conf")


def train_grid(spark, d):
    """Runs that learn from the training split and are judged on the validation split."""
    train, validate = _split_tiles(spark, d)
    return S.train_grid(train, ["red", "nir"], [1.0, 2.0], [0.1, 1.0], 8, validate=validate)


def select_layers(spark, d):
    return T.select_layers(view(spark, d, "tile"), ["nir", "red"], 8).select("tile_id", F.posexplode("tensor").alias("pos", "v")).select("tile_id", "pos", F.col("v").cast("double").alias("v"))


def scoring_set(spark, d):
    t = view(spark, d, "match")
    wanted = ["Uganda", "Rwanda"]
    present = {r["region"] for r in t.filter(F.col("region").isin(wanted)).select("region").distinct().collect()}
    if missing := set(wanted) - present:
        raise ValueError(f"no tiles for {sorted(missing)}")
    return T.dedupe_truth(t.filter(F.col("region").isin(wanted))).select("seq", "region", "tile")


PAIRS = "select p.tile_id, pred, conf, is_target from pred p join val v on p.tile_id = v.tile_id"
COUNTS = """select sum(case when conf >= {t} and pred = 1 and is_target = 1 then 1 else 0 end) as tp, sum(case when not (conf >= {t} and pred = 1) and is_target = 0 then 1 else 0 end) as tn,
 sum(case when conf >= {t} and pred = 1 and is_target = 0 then 1 else 0 end) as fp, sum(case when not (conf >= {t} and pred = 1) and is_target = 1 then 1 else 0 end) as fn from """
CONF = f"select cast(tp as bigint) as tp, cast(tn as bigint) as tn, cast(fp as bigint) as fp, cast(fn as bigint) as fn from ({COUNTS.format(t='0.834e0')} ({PAIRS}))"
RATES = "select *, case when tp = 0 then 0e0 else tp * 1e0 / (tp + fp) end as precision, case when tp = 0 then 0e0 else tp * 1e0 / (tp + fn) end as recall, (tp + tn) * 1e0 / (tp + tn + fp + fn) as accuracy from ({c})"
R1 = RATES.format(c=CONF)
ROC = f"""select threshold, cast(sum(p) over w as bigint) as tp, cast(sum(n) over w as bigint) as fp, sum(p) over w * 1e0 / sum(p) over () as tpr, sum(n) over w * 1e0 / sum(n) over () as fpr
 from (select case when pred = 1 then conf else 1e0 - conf end as threshold, sum(is_target) as p, sum(1 - is_target) as n from ({PAIRS}) group by 1) window w as (order by threshold desc rows unbounded preceding)"""
ROC_R = f"select round(threshold, 6) as threshold, tp, fp, round(tpr, 6) as tpr, round(fpr, 6) as fpr from ({ROC})"
BEST = f"select round_even(threshold, 4) as threshold, round_even(sqrt(tpr * (1e0 - fpr)), 4) as gmean, round_even(fpr, 4) as fpr, round_even(tpr, 4) as tpr from ({ROC}) order by sqrt(tpr * (1e0 - fpr)) desc, threshold desc limit 1"
REPORT = f"""with b as ({BEST}), c as ({COUNTS.format(t="(select threshold from b)")} ({PAIRS})), r as ({RATES.format(c="select * from c")})
 select threshold, gmean, fpr, tpr, round(precision, 6) as precision, round(precision + recall, 6) as f1_sum, round(accuracy, 6) as accuracy from (select b.threshold, b.gmean, b.fpr, b.tpr, r.precision, r.recall, r.accuracy from b, r)"""
SPLIT = """select tile_id, {cols} case when row_number() over (partition by {s} order by tile_id * 7919 % 10007, tile_id) <= round_even(count(*) over (partition by {s}) * 0.7e0, 0) then 'train' else 'validate' end as split from {t}"""
VAL_SPLIT = SPLIT.format(cols="is_target,", s="is_target", t="val")
JUDGED = "select *, case when s1 > s0 then 1 else 0 end as pred, exp(s0 - greatest(s0, s1)) as e0, exp(s1 - greatest(s0, s1)) as e1 from score"
HIST = "select architecture, ratio, epoch, max(total_acc) as acc, min(path) as path from checkpoint group by all"
BEST_E = f"select *, acc > coalesce(max(acc) over (partition by architecture, ratio order by epoch rows between unbounded preceding and 1 preceding), 0e0) as is_best from ({HIST})"
NEG = "select * from val where is_target = 0 {anti} order by tile_id * 7919 % 10007, tile_id limit (select cast(round_even(count(*) * {r}e0, 0) as bigint) from val where is_target = 1)"
EPOCH = "select * from (select * from val where is_target = 1 union all select * from ({n}))"
HALVES = "select tile_id, is_target, list_sum([x::double for x in tensor[1:32]]) as a, list_sum([x::double for x in tensor[33:64]]) as b from tile"

REGION_SPLIT = """select seq, region, is_bridge, case when row_number() over (partition by region, is_bridge order by seq * 7919 % 10007, seq) <= round_even(count(*) over (partition by region, is_bridge) * 0.7e0, 0) then 'train' else 'validate' end as split from {t} m"""
EPOCHS, RATE, SIZE = 4, 2.0, 17
#: Gradient steps written out, an epoch after the other.
STEPS = f"""with s as ({SPLIT.format(cols='grp, is_target,', s='grp, is_target', t='tile')}),
 t as (select tile.is_target as target, split, list_append(list_concat(list_transform(tensor[1:8], lambda v: cast(v as double)), list_transform(tensor[25:32], lambda v: cast(v as double))), 1e0) as x from tile join s on s.tile_id = tile.tile_id),
 w0 as (select list_transform(range({SIZE}), lambda i: 0e0) as w), """ + ", ".join(
    f"w{k + 1} as (select [" + ", ".join(f"any_value(w)[{j}] - {RATE}e0 * avg((1e0 / (1e0 + exp(-list_dot_product(x, w))) - target) * x[{j}])" for j in range(1, SIZE + 1)) + f"] as w from t, w{k} where split = 'train')"
    for k in range(EPOCHS)
)
TRAINED = STEPS + ", judged as (" + " union all ".join(f"select {k} as epoch, target, case when list_dot_product(x, w) > 0 then 1 else 0 end as pred from t, w{k + 1} where split = 'validate'" for k in range(EPOCHS)) + """),
 h as (select 'logistic' as architecture, 1e0 as ratio, cast(epoch as int) as epoch, avg(case when pred = target then 1e0 else 0e0 end) * 100 as total_acc, avg(case when pred = target then 1e0 else 0e0 end) filter (where target = 1) * 100 as bridge_acc,
  avg(case when pred = target then 1e0 else 0e0 end) filter (where target = 0) * 100 as no_bridge_acc from judged group by epoch),
 b as (select *, total_acc > coalesce(max(total_acc) over (order by epoch rows between unbounded preceding and 1 preceding), 0e0) as is_best from h) """
DRAWS = "select i as draw, n.tile_id, n.is_target from (select unnest(range(1, (select cast(round_even(count(*) * 2.5e0, 0) as bigint) from val where is_target = 1) + 1)) as i) d join (select *, row_number() over (order by tile_id * 7919 % 10007, tile_id) - 1 as r, count(*) over () as n from val where is_target = 0) n on n.r = (i * 7919 + 104729) % n.n"

QUERIES = {
    "threshold_pred": (threshold_pred, oracle("select tile_id, case when conf >= 0.834e0 and pred = 1 then 1 else 0 end as sure from pred", "pred")),
    "subset_semi": (subset_semi, oracle("select * from pred where tile_id in (select tile_id from val)", "pred", "val")),
    "pred_target_join": (pred_target_join, oracle(PAIRS, "pred", "val")),
    "unmatched_keys": (unmatched_keys, oracle("select cast(sum(case when v.tile_id is null then 1 else 0 end) as bigint) as no_target, cast(sum(case when p.tile_id is null then 1 else 0 end) as bigint) as no_result from pred p full join val v on p.tile_id = v.tile_id", "pred", "val")),
    "confusion": (confusion, oracle(CONF, "pred", "val")),
    "precision_recall": (precision_recall, oracle(f"select round(precision, 6) as precision, round(recall, 6) as recall from ({R1})", "pred", "val")),
    "f1": (f1, oracle(f"select round(precision + recall, 6) as f1_sum, round(case when precision + recall = 0 then 0e0 else 2e0 * precision * recall / (precision + recall) end, 6) as f1 from ({R1})", "pred", "val")),
    "accuracy": (accuracy, oracle(f"select round(accuracy, 6) as accuracy from ({R1})", "pred", "val")),
    "roc_curve": (roc_curve, oracle(ROC_R, "pred", "val")),
    "best_threshold": (best_threshold, oracle(BEST, "pred", "val")),
    "roc_at_confidence": (roc_at_confidence, oracle(f"select round(threshold, 6) as threshold, tp, fp, round(tpr, 6) as tpr, round(fpr, 6) as fpr from ({ROC}) where threshold < 0.7e0 order by threshold desc limit 1", "pred", "val")),
    "threshold_report": (threshold_report, oracle(REPORT, "pred", "val")),
    "inference_metrics": (inference_metrics, oracle(REPORT, "pred", "val")),
    "result_scan": (result_scan, oracle("select tile_id, pred, round(conf, 6) as conf from pred", "pred")),
    "result_sink": (result_sink, oracle("select * from pred", "pred")),
    "positive_conf": (positive_conf, oracle("select tile_id, round(case when pred = 1 then conf else 1e0 - conf end, 6) as p from pred", "pred")),
    "softmax_argmax": (softmax_argmax, oracle(f"select tile_id, round(e0 / (e0 + e1), 6) as p0, pred from ({JUDGED})", "score")),
    "class_accuracy": (class_accuracy, oracle(f"select round(avg(case when pred = target then 1e0 else 0e0 end) * 100, 6) as total_acc, round(avg(case when pred = target then 1e0 else 0e0 end) filter (where target = 1) * 100, 6) as bridge_acc, round(avg(case when pred = target then 1e0 else 0e0 end) filter (where target = 0) * 100, 6) as no_bridge_acc from ({JUDGED})", "score")),
    "epoch_metrics": (epoch_metrics, oracle(f"select epoch, round(avg(case when pred = target then 1e0 else 0e0 end) * 100, 6) as total_acc, round(avg(case when pred = target then 1e0 else 0e0 end) filter (where target = 1) * 100, 6) as bridge_acc, round(avg(case when pred = target then 1e0 else 0e0 end) filter (where target = 0) * 100, 6) as no_bridge_acc, round(avg(-ln(case target when 0 then e0 else e1 end / (e0 + e1))), 6) as loss from ({JUDGED}) group by epoch", "score")),
    "weighted_mean": (weighted_mean, oracle("select architecture, round(sum(v * n) / sum(n), 6) as mean, round(sum(v * n), 6) as total, cast(sum(n) as bigint) as count from (select architecture, total_acc as v, epoch % 7 + 1 as n from checkpoint where epoch % 5 <> 0) group by all", "checkpoint")),
    "checkpoint_scan": (checkpoint_scan, oracle("select architecture, ratio, epoch, round(total_acc, 6) as total_acc from checkpoint", "checkpoint")),
    "ratio_box_stats": (ratio_box_stats, oracle("select ratio, round(min(total_acc), 6) as low, round(quantile_cont(total_acc, 0.25), 6) as q1, round(quantile_cont(total_acc, 0.5), 6) as middle, round(quantile_cont(total_acc, 0.75), 6) as q3, round(max(total_acc), 6) as high from checkpoint group by ratio", "checkpoint")),
    "epoch_series": (epoch_series, oracle("select ratio, cast(count(*) as int) as n, round(arg_min(acc, epoch), 6) as first, round(arg_max(acc, epoch), 6) as last from (select ratio, epoch, avg(total_acc) as acc from checkpoint group by all) group by ratio", "checkpoint")),
    "best_epochs": (best_epochs, oracle(BEST_E, "checkpoint")),
    "best_checkpoint": (best_checkpoint, oracle(f"select architecture, ratio, arg_max(path, epoch) as path, max(epoch) as epoch from ({BEST_E}) where is_best group by all", "checkpoint")),
    "class_counts": (class_counts, oracle("select grp, is_target, count(*) as n from tile group by all", "tile")),
    "stratified_split": (stratified_split, oracle(VAL_SPLIT, "val")),
    "train_validate": (train_validate, oracle(SPLIT.format(cols="grp, is_target,", s="grp, is_target", t="tile"), "tile")),
    "region_split": (region_split, oracle(REGION_SPLIT.format(t="match"), "match")),
    "region_split_deduped": (region_split_deduped, oracle(REGION_SPLIT.format(t="(select * from (select *, row_number() over (partition by is_bridge, bridge_loc order by seq) as k from match) where not is_bridge or bridge_loc is null or k = 1)"), "match")),
    "split_sink": (split_sink, oracle(f"select split, is_target, count(*) as n from ({VAL_SPLIT}) group by all", "val")),
    "split_complement": (split_complement, oracle(f"select tile_id, is_target from ({VAL_SPLIT}) where split = 'validate'", "val")),
    "epoch_sample": (epoch_sample, oracle(EPOCH.format(n=NEG.format(anti="", r="1.5")), "val")),
    "epoch_pool": (epoch_pool, oracle(EPOCH.format(n=NEG.format(anti=f"and tile_id not in (select tile_id from ({NEG.format(anti='', r='0.5')}))", r="0.5")), "val")),
    "epoch_draws": (epoch_draws, oracle(DRAWS, "val")),
    "train_history": (train_history, oracle(TRAINED + "select architecture, ratio, epoch, round(total_acc, 6) as total_acc, round(bridge_acc, 6) as bridge_acc, round(no_bridge_acc, 6) as no_bridge_acc, is_best from b", "tile")),
    "trained_checkpoint": (trained_checkpoint, oracle(TRAINED + "select architecture, max(epoch) as epoch, concat('logistic_r1.0_red_nir_epoch', max(epoch), '.tar') as path from b where is_best group by architecture", "tile")),
    "score_tiles": (score_tiles, oracle(f"select tile_id, is_target, case when b > a then 1 else 0 end as pred, round(1e0 / (1e0 + exp(-abs(a - b))), 6) as conf from ({HALVES})", "tile")),
    "train_grid": (train_grid, None),
    "select_layers": (select_layers, oracle("select tile_id, cast(pos as int) as pos, cast(case when pos < 8 then tensor[25 + pos] else tensor[pos - 7] end as double) as v from tile, (select unnest(range(16)) as pos)", "tile")),
    "scoring_set": (scoring_set, oracle("select seq, region, tile from (select *, row_number() over (partition by is_bridge, bridge_loc order by seq) as k from match where region in ('Uganda', 'Rwanda')) where not is_bridge or k = 1", "match")),
}
