"""Classification and regression metrics as aggregates.

Everything except AUC is one global aggregate (partial aggregation per task,
one row to the driver side of the plan).  AUC needs the negatives ranked below
each score: scores are grouped first (one row per distinct score), written in
range partitions, prefix-summed inside each partition by a window, and offset by
the totals of the partitions before it.  No task sees more than one partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medfuse.functions.exprs import DOUBLE_EPS
from medfuse.session import materialize

KERAS_EPS = 1e-7      # fixed value: probability clip for cross-entropy


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def confusion_counts(df: DataFrame, label: str = "label", pred: str = "pred_class") -> DataFrame:
    """(label, pred_class, n)."""
    return df.groupBy(_c(label).alias("label"), _c(pred).alias("pred_class")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, label: str = "label", pred: str = "pred_class") -> DataFrame:
    """E1-E4 with confusion counts; precision/recall/F1 are 0 on an empty denominator."""
    y, p = _c(label), _c(pred)
    agg = df.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                 F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"),
                 F.avg((y == p).cast("double")).alias("accuracy"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    z = F.lit(0.0)
    return agg.select(
        "accuracy",
        F.coalesce(F.try_divide(tp, tp + fp), z).cast("double").alias("precision"),
        F.coalesce(F.try_divide(tp, tp + fn), z).cast("double").alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), z).cast("double").alias("f1"),
        "tp", "fp", "fn", "tn")


def rank_areas(scores: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """(k, num, n_pos, n_neg) per class ``k`` from rows (k, label 0/1, s): ``num`` counts the negatives below each positive.

    Ties count half.  The table of distinct scores is written once in range partitions (sampled cuts, so they stay of one
    size whatever the scores look like), summed inside each, and offset by the totals of the partitions before: one scan
    for all classes, and no sketch, driver loop or global sort.  ``n_buckets`` sets the number of range partitions, which
    else follows ``spark.sql.shuffle.partitions``.
    """
    g = (scores.groupBy("k", "s").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
         .repartitionByRange(*([n_buckets] if n_buckets else []), "k", "s"))
    g = materialize(g.withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part", "k").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    local = g.select("part", "k", "pos", "neg", F.coalesce(F.sum("neg").over(inside), F.lit(0)).alias("below"))
    before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (g.groupBy("k", "part").agg(F.sum("neg").alias("neg"))
               .select("k", "part", F.coalesce(F.sum("neg").over(before), F.lit(0)).alias("off")))     # a row per partition
    credit = F.col("pos") * ((F.col("below") + F.col("off")).cast("double") + F.col("neg") / 2.0)
    return local.join(offsets, ["k", "part"]).groupBy("k").agg(
        F.sum(credit).alias("num"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def _area() -> Column:
    return F.try_divide(F.col("num"), F.col("n_pos").cast("double") * F.col("n_neg"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "p", n_buckets: int | None = None) -> DataFrame:
    """E5: area under ROC from scores, ties count half; NULL when one class is absent.  One row, also without scores."""
    rows = df.where(_c(score).isNotNull()).select(F.lit(0).alias("k"), _c(label).alias("label"), _c(score).cast("double").alias("s"))
    total = rank_areas(rows, n_buckets).agg(F.max("num").alias("num"), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))
    return total.select(_area().alias("roc_auc"), F.coalesce("n_pos", F.lit(0)).cast("long").alias("n_pos"),
                        F.coalesce("n_neg", F.lit(0)).cast("long").alias("n_neg"))


def macro_auc(df: DataFrame, label: str, probs: str, n_classes: int) -> DataFrame:
    """One-vs-rest AUC per class from a probability array, averaged over the classes; one scan for all of them."""
    each = df.select(_c(label).alias("y"), F.posexplode(_c(probs)).alias("k", "s")).where((F.col("k") < n_classes) & F.col("s").isNotNull())
    rows = each.select("k", (F.col("y") == F.col("k")).cast("int").alias("label"), F.col("s").cast("double").alias("s"))
    return rank_areas(rows).select(_area().alias("roc_auc")).agg(F.avg("roc_auc").alias("roc_auc_macro"))


def regression_metrics(df: DataFrame, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """MAE, MSE, RMSE, R2 (constant y: 1 if exact else 0), MAPE % with eps for y = 0."""
    e = _c(y) - _c(y_hat)
    denom = F.when(_c(y) == 0, F.lit(DOUBLE_EPS)).otherwise(_c(y))
    agg = df.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sum(e * e).alias("_sse"),
                 (F.var_pop(y) * F.count(y)).alias("_sst"), (F.avg(F.abs(e / denom)) * 100).alias("mape"))
    r2 = (F.when(F.col("_sst") == 0, F.when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
           .otherwise(1 - F.col("_sse") / F.col("_sst")))
    return agg.select("mae", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2"), "mape")


def losses(df: DataFrame, label: str = "label", p: str = "p", y: str | None = "y", y_hat: str | None = "y_hat",
           eps: float = KERAS_EPS) -> DataFrame:
    """Binary cross-entropy (probabilities clipped to [eps, 1-eps]), MSE, and their sum."""
    pc = F.least(F.greatest(_c(p), F.lit(eps)), F.lit(1 - eps))
    ce = -(_c(label) * F.ln(pc) + (1 - _c(label)) * F.ln(1 - pc))
    aggs = [F.avg(ce).alias("cross_entropy")]
    if y and y_hat:
        aggs.append(F.avg((_c(y) - _c(y_hat)) * (_c(y) - _c(y_hat))).alias("mse"))
    out = df.agg(*aggs)
    if y and y_hat:
        out = out.withColumn("total_loss", F.col("cross_entropy") + F.col("mse"))
    return out


def evaluate(df: DataFrame, label: str = "label", p: str | None = "p", probs: str | None = None,
             y: str | None = None, y_hat: str | None = None) -> DataFrame:
    """One metrics table (metric, value) for either output shape.

    One score column ``p`` -> class is p > 0.5 (R17); a probability array
    ``probs`` -> class is the argmax (R18) and AUC uses the positive column.
    Regression metrics are added only when ``y`` and ``y_hat`` are given.
    """
    if probs is not None:
        scored = df.select(_c(label).alias("label"), F.element_at(_c(probs), 2).alias("p"),
                           (F.array_position(_c(probs), F.array_max(_c(probs))) - 1).cast("int").alias("pred_class"),
                           *([_c(y).alias("y"), _c(y_hat).alias("y_hat")] if y and y_hat else []))
    else:
        scored = df.select(_c(label).alias("label"), _c(p).alias("p"),
                           F.when(_c(p) > 0.5, 1).otherwise(0).alias("pred_class"),
                           *([_c(y).alias("y"), _c(y_hat).alias("y_hat")] if y and y_hat else []))
    parts = [(classification_metrics(scored), ["accuracy", "precision", "recall", "f1"]), (roc_auc(scored), ["roc_auc"])]
    if y and y_hat:
        parts.append((regression_metrics(scored), ["mae", "mse", "rmse", "r2", "mape"]))
    # one aggregate row per part, turned into long rows: a part's input is read once for all of its metrics
    longs = [part.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                                             for c in names])).alias("m")).select("m.*") for part, names in parts]
    return reduce(DataFrame.unionByName, longs)
