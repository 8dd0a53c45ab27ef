"""Metrics against brute force, split properties."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from medfuse.operators import metrics as Mx
from medfuse.operators import split as Sp
from medfuse.sources import fixtures as fx


def brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    if not pos or not neg:
        return None
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.1, 0.2, 0.35, 0.5, 0.8, 0.9])), min_size=1, max_size=40))
def test_auc_matches_brute_force_with_ties(spark, rows):
    df = spark.createDataFrame(rows, "label int, p double")
    got = Mx.roc_auc(df, n_buckets=3).first()["roc_auc"]
    want = brute_auc(rows)
    assert (got is None and want is None) or got == pytest.approx(want, abs=1e-12)


def test_auc_symmetry_and_buckets(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 3)) for _ in range(500)]
    df = spark.createDataFrame(rows, "label int, p double")
    a = Mx.roc_auc(df, n_buckets=16).first()["roc_auc"]
    assert a == pytest.approx(brute_auc(rows), abs=1e-12)
    flipped = Mx.roc_auc(df.withColumn("p", 1 - F.col("p")), n_buckets=5).first()["roc_auc"]
    assert flipped == pytest.approx(1 - a, abs=1e-9)


def test_classification_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, pred_class int")
    r = Mx.classification_metrics(df).first()
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"]) == (1.0, 0.0, 0.0, 0.0)


def test_regression_metrics_edge_cases(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 2.0)], "y double, y_hat double")
    r = Mx.regression_metrics(df).first()
    assert r["mape"] == pytest.approx((1.0 / 2.220446049250313e-16) / 2 * 100, rel=1e-12)
    const = spark.createDataFrame([(3.0, 3.0), (3.0, 3.0)], "y double, y_hat double")
    assert Mx.regression_metrics(const).first()["r2"] == 1.0
    off = spark.createDataFrame([(3.0, 2.0), (3.0, 3.0)], "y double, y_hat double")
    assert Mx.regression_metrics(off).first()["r2"] == 0.0


def test_split_properties(spark, sf_mid):
    keys = fx.table(spark, sf_mid, "customer").select(F.col("c_custkey").alias("Patient_ID"))
    a = Sp.assign_split(keys, validation_size=0.2)
    b = Sp.assign_split(keys.repartition(13), validation_size=0.2)
    ra = {r["Patient_ID"]: r["split"] for r in a.collect()}
    rb = {r["Patient_ID"]: r["split"] for r in b.collect()}
    assert ra == rb and len(ra) == 1500
    share = sum(v == "test" for v in ra.values()) / len(ra)
    assert 0.15 < share < 0.25
    train, test = Sp.split_data(keys)
    assert train.join(test, "Patient_ID").count() == 0 and train.count() + test.count() == 1500


def test_evaluate_dispatch(spark):
    df = spark.createDataFrame([(1, 0.9, 2.0, 2.5), (0, 0.2, 1.0, 1.0), (1, 0.4, 3.0, 2.0)],
                               "label int, p double, y double, y_hat double")
    one = {r["metric"]: r["value"] for r in Mx.evaluate(df, "label", "p", y="y", y_hat="y_hat").collect()}
    two = {r["metric"]: r["value"] for r in Mx.evaluate(
        df.withColumn("probs", F.array(1 - F.col("p"), F.col("p"))), "label", None, probs="probs",
        y="y", y_hat="y_hat").collect()}
    assert one == pytest.approx(two)
    assert set(one) == {"accuracy", "precision", "recall", "f1", "roc_auc", "mae", "mse", "rmse", "r2", "mape"}
    cls_only = {r["metric"] for r in Mx.evaluate(df, "label", "p").collect()}
    assert "mae" not in cls_only


def test_macro_auc_of_three_classes_in_many_range_partitions(spark):
    import numpy as np
    rng = np.random.default_rng(6)
    y, probs = rng.integers(0, 3, 400), np.round(rng.dirichlet([1, 1, 1], 400), 2)
    df = spark.createDataFrame([(int(a), [float(v) for v in p]) for a, p in zip(y, probs)], "label int, probs array<double>")
    expected = []
    for k in range(3):
        pos, neg = probs[y == k, k], probs[y != k, k]
        expected.append(float(((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean()))
    areas = {r["k"]: r["num"] / (r["n_pos"] * r["n_neg"]) for r in Mx.rank_areas(
        df.select("label", F.posexplode("probs").alias("k", "s")).select("k", (F.col("label") == F.col("k")).cast("int").alias("label"), "s"), 7).collect()}
    assert [areas[k] for k in range(3)] == pytest.approx(expected, abs=1e-12)
    assert Mx.macro_auc(df, "label", "probs", 3).first()["roc_auc_macro"] == pytest.approx(float(np.mean(expected)), abs=1e-12)
    assert tuple(Mx.roc_auc(df.limit(0).selectExpr("label", "probs[0] AS p")).first()) == (None, 0, 0)


def test_exact_split_gives_every_stratum_its_share(spark):
    rows = [(i, "abc"[min(2, i % 7)] if i % 50 else None) for i in range(900)] + [(7, "a"), (None, "a"), (5000, "alone")]
    df = spark.createDataFrame(rows, "Patient_ID long, s string").withColumn("_cut", F.lit(1))
    got = Sp.exact_split(df, test_size=0.3, strata=["s"])
    assert got.count() == len(rows) and got.columns == ["Patient_ID", "s", "_cut", "split"]
    import hashlib
    import math
    want = set()
    for s in {s for _, s in rows}:
        keys = sorted({i for i, t in rows if t == s and i is not None}, key=lambda k: hashlib.md5(f"{k}:42".encode()).hexdigest())
        want |= {(k, s) for k in keys[:math.ceil(0.3 * len(keys))]}
    assert {(r["Patient_ID"], r["s"]) for r in got.where("split = 'test'").collect()} == want
    for size, n in ((0.0, 0), (1.0, 901), (0.001, 1)):
        assert Sp.exact_split(df, test_size=size).where("split = 'test'").select("Patient_ID").distinct().count() == n
    assert Sp.exact_split(df.limit(0), test_size=0.5, strata=["s"]).count() == 0
