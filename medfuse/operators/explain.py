"""Feature attribution for linear and tree heads, global and permutation importance, single-row breakdown.

For a linear model the exact Shapley value of feature j (independent
features, interventional form) is ``w_j * (x_j - E[x_j])`` on the model's
margin (log-odds for logistic regression), with base value
``b + sum_j w_j E[x_j]``.  Weights and background means are bounded by the
feature count, so they travel as literals; attribution itself is a projection
plus an explode, fully distributed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medfuse.functions import series as S
from medfuse.operators.metrics import KERAS_EPS
from medfuse.session import materialize, scratch_path
from medfuse.sources.fixtures import KEY


def contributions(df: DataFrame, values: Column, weights: Sequence[float], means: Sequence[float],
                  names: Sequence[str], key: str = KEY) -> DataFrame:
    """X1 core: long (key, position, feature, contribution) from an array of feature values."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    m = F.array(*[F.lit(float(v)) for v in means])
    nm = F.array(*[F.lit(n) for n in names])
    contrib = F.transform(values, lambda x, i: F.element_at(w, i + 1) * (x - F.element_at(m, i + 1)))
    return (df.select(F.col(key), F.posexplode(contrib).alias("position", "contribution"))
              .select(key, "position", F.element_at(nm, F.col("position") + 1).alias("feature"), "contribution"))


def linear_attribution(df: DataFrame, cols: Sequence[str], weights: Sequence[float],
                       means: Sequence[float] | None = None, key: str = KEY) -> DataFrame:
    """X1 on plain columns with given weights; means default to the column means of ``df``."""
    if means is None:
        row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        means = [row[f"m{i}"] for i in range(len(cols))]
    return contributions(df, F.array(*[F.col(c).cast("double") for c in cols]), weights, means, cols, key)


def _logistic_stage(model: PipelineModel) -> LogisticRegressionModel:
    for st in model.stages:
        if isinstance(st, LogisticRegressionModel):
            return st
    raise ValueError("pipeline has no logistic-regression class head")


def model_attribution(model: PipelineModel, scored: DataFrame, background: DataFrame,
                      names: Sequence[str], key: str = KEY) -> tuple[DataFrame, float]:
    """X1 for the fitted logistic class head: contributions on the log-odds, and the base value.

    ``scored`` and ``background`` are outputs of ``model.transform`` (they carry ``features``).
    """
    lr = _logistic_stage(model)
    w = lr.coefficients.toArray().tolist()
    mean_row = background.select(Summarizer.mean(F.col("features")).alias("m")).first()
    means = mean_row["m"].toArray().tolist()
    base = float(lr.intercept + sum(a * b for a, b in zip(w, means)))
    return contributions(scored, vector_to_array("features"), w, means, names, key), base


def global_importance(contrib: DataFrame, top_k: int | None = None) -> DataFrame:
    """Mean |contribution| per feature (a top-k report when ``top_k`` is given)."""
    out = contrib.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"),
                                         F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("mean_abs_contribution"), "feature").limit(top_k) if top_k else out


def breakdown(contrib: DataFrame, base_value: float, key: str = KEY) -> DataFrame:
    """Per row, contributions by decreasing |value| with the running total from the base value.

    The window is partitioned by row key, so it holds one row's features only.
    """
    w = Window.partitionBy(key).orderBy(F.abs("contribution").desc(), "position")
    return contrib.select(
        key, "feature", "contribution", F.row_number().over(w).alias("rank"),
        (F.lit(float(base_value)) + F.sum("contribution").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .alias("cumulative"))


# ----------------------------------------------------------------------------- X2: permutation importance

def permuted(df: DataFrame, cols: Sequence[str], key: str = KEY, seed: int = 42, rows_per_chunk: int = 100_000) -> DataFrame:
    """Every row of ``df`` once per feature, with that feature's value taken from another row; ``feature`` names it.

    Rows are ranked by a seeded hash of their key, and once more for each feature by a hash of their own; a row takes
    the value of the row that has its rank there.  Ranks come from ``rank_series`` over hash ranges with offsets by
    range, so no window holds more than about ``rows_per_chunk`` rows and nothing is sorted globally.  Keys must be
    distinct; a NULL value is permuted like any other.
    """
    def place(salt) -> Column:
        text = F.concat(F.col(key).cast("string"), F.lit(f":{seed}:"), salt)
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")

    width = float(2 ** 32) / (1 + df.count() // rows_per_chunk)
    own = S.rank_series(df.select(F.lit(0).alias("_one"), F.col(key).alias("_key"), place(F.lit("")).alias("_h")), ["_one"], ["_h", "_key"], width)
    values = df.select(F.col(key).alias("_key"), F.posexplode(F.array(*[F.col(f"`{c}`").cast("double") for c in cols])).alias("_at", "_value"))
    donors = values.withColumnRenamed("_key", key).withColumn("_h", place(F.col("_at").cast("string"))).withColumnRenamed(key, "_key")
    donors = S.rank_series(donors, ["_at"], ["_h", "_key"], width).select("_at", "rn", "_value")
    given = own.select("_key", "rn").join(
        donors.groupBy("rn").agg(F.sort_array(F.collect_list(F.struct("_at", "_value"))).alias("_given")), "rn")      # one struct per feature
    long = df.join(given, df[key] == given["_key"]).select(*[df[c] for c in df.columns], F.explode("_given").alias("_g"))
    at, names = {c: i for i, c in enumerate(cols)}, F.array(*[F.lit(c) for c in cols])
    return long.select(F.element_at(names, F.col("_g._at") + 1).alias("feature"),
                       *[F.when(F.col("_g._at") == at[c], F.col("_g._value")).otherwise(F.col(f"`{c}`")).alias(c) if c in at else F.col(f"`{c}`")
                         for c in df.columns])


def permutation_importance(df: DataFrame, cols: Sequence[str], predict: Callable[[DataFrame], DataFrame], label: str = "CVD_Presence",
                           p: str = "p_class1", key: str = KEY, seed: int = 42) -> DataFrame:
    """X2 for any model: (feature, loss, importance), importance being the cross-entropy gained by permuting the feature.

    ``predict`` adds the probability ``p`` to a frame of the columns of ``df``; it is asked twice, once for all permuted
    features together and once for the rows as they are.
    """
    def loss(scored: DataFrame) -> Column:
        q = F.least(F.greatest(F.col(p), F.lit(KERAS_EPS)), F.lit(1 - KERAS_EPS))
        return F.avg(-(F.col(label) * F.ln(q) + (1 - F.col(label)) * F.ln(1 - q)))

    scored = predict(permuted(df, cols, key, seed))
    base = predict(df)
    before = base.agg(loss(base).alias("loss")).first()["loss"]
    return scored.groupBy("feature").agg(loss(scored).alias("loss")).withColumn("importance", F.col("loss") - F.lit(before).cast("double"))


# ----------------------------------------------------------------------------- X1: tree heads

NODE_SCHEMA = ("tree int, weight double, node int, feature int, threshold double, categories array<double>, left int, right int, "
               "value double, cover double")


def node_table(model) -> DataFrame:
    """The written nodes of a fitted tree ensemble (NODE_SCHEMA; feature -1: a leaf; categories go left, NULL: by threshold)."""
    spark = SparkSession.active()
    path = scratch_path(spark, f"trees-{uuid.uuid4().hex}")
    model.save(path)
    weights = spark.createDataFrame([(i, float(w)) for i, w in enumerate(model.treeWeights)], "tree int, weight double")
    n = "nodeData."
    continuous = F.col(n + "split.numCategories") < 0
    return (spark.read.parquet(f"{path}/data").withColumnRenamed("treeID", "tree").join(weights, "tree").select(
        "tree", "weight", F.col(n + "id").alias("node"), F.col(n + "split.featureIndex").alias("feature"),
        F.when(continuous, F.try_element_at(n + "split.leftCategoriesOrThreshold", F.lit(1))).alias("threshold"),
        F.when(~continuous, F.col(n + "split.leftCategoriesOrThreshold")).alias("categories"), F.col(n + "leftChild").alias("left"),
        F.col(n + "rightChild").alias("right"), F.col(n + "prediction").alias("value"), F.col(n + "rawCount").cast("double").alias("cover")))


def tree_attribution(df: DataFrame, values: Column, nodes: DataFrame, names: Sequence[str], key: str = KEY) -> tuple[DataFrame, float]:
    """X1 for tree heads: long (key, position, feature, contribution) of the ensemble's margin, and the base value.

    Exact Shapley values under the trees' own cover (a feature not known sends a row both ways, by the shares of the
    training rows).  Rows walk the trees level by level as joins with the node table and part at every split; each path
    keeps, per feature on it, whether the row's value follows it and the share of rows that do.  At a leaf the weights of
    all coalitions of the d features on the path come from a product of d polynomials, so the cost is polynomial in the
    depth and no coalition is listed.  Contributions and base value add up to the margin.  Features on no path are not
    listed; a NULL or NaN value goes right, as a comparison that does not hold.
    """
    split = nodes.where("feature >= 0")
    children = [split.select("tree", "weight", "node", "feature", "threshold", "categories", F.lit(side).alias("goes_left"), F.col(side_col).alias("child"))
                for side, side_col in ((True, "left"), (False, "right"))]
    target = nodes.select("tree", F.col("node").alias("child"), F.col("value").alias("child_value"), F.col("cover").alias("child_cover"),
                          (F.col("feature") < 0).alias("leaf"))
    cover = nodes.select("tree", "node", "cover")
    edges = materialize(children[0].unionByName(children[1]).join(target, ["tree", "child"]).join(cover, ["tree", "node"])
                        .withColumn("share", F.col("child_cover") / F.col("cover")).drop("cover", "child_cover"))
    roots = materialize(nodes.where("node = 0").select("tree", "weight", "value", (F.col("feature") < 0).alias("leaf")))
    walks = materialize(df.select(F.col(key).alias("_key"), values.alias("_x")))
    # a tree of a single leaf adds to the base value only
    trees = [r["tree"] for r in roots.where("NOT leaf").select("tree").orderBy("tree").collect()]     # one row per tree
    base_alone = roots.where("leaf").agg(F.coalesce(F.sum(F.col("weight") * F.col("value")), F.lit(0.0)).alias("v")).first()["v"]
    step = walks.select("*", F.explode(F.array(*[F.lit(t) for t in trees]) if trees else F.expr("CAST(array() AS array<int>)")).alias("tree"),
                        F.lit(0).alias("node"), F.expr("CAST(map() AS map<int, struct<z: double, o: double>>)").alias("path"))
    leaves, depth = [], 0
    frontier = roots.where("NOT leaf").select("tree", F.lit(0).alias("node"))
    while True:                        # the depth of the deepest tree, from the edges alone
        frontier = edges.join(frontier, ["tree", "node"]).where("NOT leaf").select("tree", F.col("child").alias("node"))
        depth += 1
        if not frontier.limit(1).count():
            break
        frontier = materialize(frontier)
    for _ in range(depth):
        x = F.try_element_at("_x", F.col("feature") + 1)
        follows = F.coalesce(F.when(F.col("categories").isNull(), x <= F.col("threshold")).otherwise(F.array_contains("categories", x)), F.lit(False))
        on = F.when(follows == F.col("goes_left"), 1.0).otherwise(0.0)
        known = F.try_element_at("path", F.col("feature"))
        entry = F.struct((F.coalesce(known["z"], F.lit(1.0)) * F.col("share")).alias("z"), (F.coalesce(known["o"], F.lit(1.0)) * on).alias("o"))
        moved = step.join(edges, ["tree", "node"]).select(
            "_key", "_x", "tree", F.col("child").alias("node"), "leaf", "weight", "child_value",
            F.map_concat(F.map_filter("path", lambda k, v: k != F.col("feature")), F.map_from_arrays(F.array("feature"), F.array(entry))).alias("path"))
        leaves.append(moved.where("leaf").select("_key", "path", (F.col("weight") * F.col("child_value")).alias("v")))
        step = moved.where("NOT leaf").select("_key", "_x", "tree", "node", "path")
    if not leaves:
        return walks.selectExpr(f"_key AS {key}", "0 AS position", "'' AS feature", "0D AS contribution").limit(0), float(base_alone)
    ends = reduce(DataFrame.unionByName, leaves)
    # per feature i of the path: (o_i - z_i) times the Shapley-weighted coefficients of the other features' product
    told = ends.select("_key", F.expr("""explode(transform(map_entries(path), e -> struct(e.key AS position,
        v * (e.value.o - e.value.z) * aggregate(transform(
            aggregate(map_values(map_filter(path, (k, f) -> k <> e.key)), array(1D), (c, f) -> transform(sequence(0, size(c)),
                k -> f.z * coalesce(get(c, k), 0D) + f.o * coalesce(get(c, k - 1), 0D))),
            (c, k) -> c * factorial(k) * factorial(size(map_keys(path)) - 1 - k) / factorial(size(map_keys(path)))), 0D, (t, w) -> t + w) AS contribution)))""").alias("e"))
    out = told.groupBy("_key", F.col("e.position").alias("position")).agg(F.sum("e.contribution").alias("contribution"))
    # the base: what the ensemble says with nothing known, from the leaves of the edges alone
    start = roots.where("NOT leaf").select("tree", F.lit(0).alias("node"), F.lit(1.0).alias("z"))
    base = base_alone
    for _ in range(depth):
        at = edges.join(start, ["tree", "node"]).select("tree", F.col("child").alias("node"), (F.col("z") * F.col("share")).alias("z"), "leaf", "weight", "child_value")
        base += at.where("leaf").agg(F.coalesce(F.sum(F.col("z") * F.col("weight") * F.col("child_value")), F.lit(0.0)).alias("v")).first()["v"]
        start = at.where("NOT leaf").select("tree", "node", "z")
    nm = F.array(*[F.lit(n) for n in names])
    return out.select(F.col("_key").alias(key), "position", F.element_at(nm, F.col("position") + 1).alias("feature"), "contribution"), float(base)
