"""Tree attribution against coalitions and margins; permutation importance against a plain permutation."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from medfuse.operators import explain as X

COLS = ["a", "b", "c"]


def rows_of(spark, n=240, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(i, *(float(v) for v in rng.normal(size=3))) for i in range(n)]
    return spark.createDataFrame([(*r, int(r[1] * r[2] + r[3] > 0)) for r in rows], "Patient_ID long, a double, b double, c double, CVD_Presence int")


def shapley(nodes, x):
    """Every coalition of every tree's features."""
    out, base = {}, 0.0
    for t in {n["tree"] for n in nodes}:
        by = {n["node"]: n for n in nodes if n["tree"] == t}

        def said(k, known):
            n = by[k]
            if n["feature"] < 0:
                return n["value"]
            if n["feature"] in known:
                v = x[n["feature"]]
                return said(n["left"] if v is not None and v <= n["threshold"] else n["right"], known)
            share = by[n["left"]]["cover"] / n["cover"]
            return share * said(n["left"], known) + (1 - share) * said(n["right"], known)

        used = sorted({n["feature"] for n in by.values() if n["feature"] >= 0})
        w = by[0]["weight"]
        base += w * said(0, ())
        for i in used:
            rest = [u for u in used if u != i]
            for k in range(len(rest) + 1):
                share = math.factorial(k) * math.factorial(len(rest) - k) / math.factorial(len(used))
                for s in itertools.combinations(rest, k):
                    out[i] = out.get(i, 0.0) + w * share * (said(0, (*s, i)) - said(0, s))
    return out, base


def test_tree_attribution_adds_up_to_the_margin_and_equals_coalitions(spark):
    df = VectorAssembler(inputCols=COLS, outputCol="features").transform(rows_of(spark))
    model = GBTClassifier(labelCol="CVD_Presence", maxIter=5, maxDepth=4, seed=1).fit(df)
    nodes = X.node_table(model)
    contrib, base = X.tree_attribution(df, vector_to_array("features"), nodes, COLS)
    got = {}
    for r in contrib.collect():
        got.setdefault(r["Patient_ID"], {})[r["position"]] = r["contribution"]
        assert r["feature"] == COLS[r["position"]]
    margins = {r["Patient_ID"]: r["m"] for r in model.transform(df).select("Patient_ID", vector_to_array("rawPrediction")[1].alias("m")).collect()}
    assert got.keys() == margins.keys()
    for k, m in margins.items():
        assert sum(got[k].values()) + base == pytest.approx(m, abs=1e-9)
    table = [r.asDict() for r in nodes.collect()]
    for r in df.limit(12).collect():
        want, b = shapley(table, [r[c] for c in COLS])
        assert base == pytest.approx(b, abs=1e-9)
        assert got[r["Patient_ID"]] == pytest.approx({i: v for i, v in want.items()}, abs=1e-9)


def test_tree_attribution_of_missing_values_categories_and_single_leaves(spark):
    nodes = spark.createDataFrame([
        (0, 2.0, 0, 0, None, [1.0, 3.0], 1, 2, 0.0, 10.0), (0, 2.0, 1, -1, None, None, -1, -1, 5.0, 4.0), (0, 2.0, 2, -1, None, None, -1, -1, -1.0, 6.0),
        (1, 1.0, 0, -1, None, None, -1, -1, 0.5, 10.0)], X.NODE_SCHEMA)
    df = spark.createDataFrame([(1, 3.0), (2, 2.0), (3, None), (4, float("nan"))], "Patient_ID long, a double")
    contrib, base = X.tree_attribution(df, F.array("a"), nodes, ["a"])
    assert base == pytest.approx(2 * (0.4 * 5 - 0.6) + 0.5)
    assert {r["Patient_ID"]: round(r["contribution"] + base, 9) for r in contrib.collect()} == {1: 10.5, 2: -1.5, 3: -1.5, 4: -1.5}
    alone, base = X.tree_attribution(df, F.array("a"), nodes.where("tree = 1"), ["a"])
    assert alone.collect() == [] and base == 0.5
    assert X.tree_attribution(df.limit(0), F.array("a"), nodes, ["a"])[0].collect() == []


@pytest.mark.parametrize("rows_per_chunk", [100_000, 7])
def test_permutation_is_one_to_one_per_feature_in_any_chunking(spark, rows_per_chunk):
    df = rows_of(spark, 60).withColumn("a", F.when(F.col("Patient_ID") != 3, F.col("a")))
    rows = {r["Patient_ID"]: r for r in df.collect()}

    def order(salt):
        return sorted(rows, key=lambda k: (hashlib.md5(f"{k}:42:{salt}".encode()).hexdigest()[:8], k))

    own = order("")
    want = {(own[i], c): rows[k][c] for j, c in enumerate(COLS) for i, k in enumerate(order(j))}
    got = X.permuted(df, COLS, rows_per_chunk=rows_per_chunk).collect()
    assert len(got) == 180
    for r in got:
        for c in COLS:
            assert r[c] == (want[r["Patient_ID"], c] if c == r["feature"] else rows[r["Patient_ID"]][c])


def test_permutation_importance_finds_the_features_of_a_model(spark):
    df = rows_of(spark)
    assembler = VectorAssembler(inputCols=COLS[:2], outputCol="features")
    model = GBTClassifier(labelCol="CVD_Presence", maxIter=5, maxDepth=3, seed=1).fit(assembler.transform(df))

    def predict(d):
        return model.transform(assembler.transform(d)).withColumn("p_class1", vector_to_array("probability")[1])

    got = {r["feature"]: r["importance"] for r in X.permutation_importance(df, COLS, predict).collect()}
    assert got["c"] == pytest.approx(0.0, abs=1e-12) and min(got["a"], got["b"]) > 0.05
