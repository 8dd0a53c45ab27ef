"""Training rounds: gradients against finite differences, patience and restored weights, missing values, hidden layers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from medfuse.operators import rounds as RD

COLS = ["a", "b", "c"]


def frame(spark, n=300, seed=1, noise=0.3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c = (float(v) for v in rng.normal(size=3))
        margin = 2 * a - b + noise * rng.normal()
        rows.append((i, a, 10 * b + 3, c, int(margin > 0), float(5 + 2 * a + c + noise * rng.normal()),
                     "test" if i % 5 == 0 else "validation" if i % 5 == 1 else "train"))
    return spark.createDataFrame(rows, "Patient_ID long, a double, b double, c double, CVD_Presence int, Time_To_Event double, split string")


@pytest.mark.parametrize("sizes", [[3, 2], [3, 4, 3, 2]])
def test_gradient_equals_finite_differences(sizes):
    rng = np.random.default_rng(2)
    x, label, y, val = rng.normal(size=(20, 3)), rng.integers(0, 2, 20).astype(float), rng.normal(size=20), rng.random(20) < .3
    flat = rng.normal(size=sum((a + 1) * b for a, b in zip(sizes, sizes[1:])))

    def loss(w):
        s = RD.batch_sums(x, label, y, val, RD.unpack(w, sizes))
        return s[len(w)] + s[len(w) + 1]

    got = RD.batch_sums(x, label, y, val, RD.unpack(flat, sizes))
    assert got[len(flat) + 2] == (~val).sum() and got[len(flat) + 5] == val.sum()
    for i in range(len(flat)):
        d = np.zeros_like(flat)
        d[i] = 1e-6
        assert got[i] == pytest.approx((loss(flat + d) - loss(flat - d)) / 2e-6, abs=1e-4)


def test_patience_stops_and_the_best_weights_come_back(spark):
    df = frame(spark, n=60, noise=2.0)
    settings = RD.RoundSettings(rounds=100, patience=3, step=0.6, momentum="none")
    model = RD.fit_rounds(df, COLS, settings)
    losses = [p[3] + p[4] for p in model.path]
    assert model.best_round == int(np.argmin(losses)) and len(losses) == model.best_round + 4 < 100
    assert np.array_equal(model.weights, model.history[model.best_round])
    path = RD.loss_path(spark, model).collect()
    assert [r["round"] for r in path if r["best"]] == [model.best_round] and len(path) == len(losses)
    again = RD.fit_rounds(df.repartition(7), COLS, settings)
    assert np.allclose(again.weights, model.weights, atol=1e-10)
    assert RD.coefficients(spark, model).where("round = 1").count() == len(model.weights)


@pytest.mark.parametrize("hidden", [(), (8, 4)])
def test_heads_learn_and_score_alike_in_sql_and_numpy(spark, hidden):
    df = frame(spark)
    model = RD.fit_rounds(df, COLS, RD.RoundSettings(hidden=hidden, rounds=60, step=0.05))
    test = df.where("split = 'test'")
    got = {r["Patient_ID"]: r for r in RD.predict_rounds(model, test).collect()}
    right = sum(r["pred_class"] == r["CVD_Presence"] for r in got.values()) / len(got)
    error = np.mean([abs(r["pred_time"] - r["Time_To_Event"]) for r in got.values()])
    assert right > 0.85 and error < 1.0 and len(got) == test.count()
    rows = test.collect()
    x = (np.array([[r[c] for c in COLS] for r in rows]) - model.scale.mean) / model.scale.std
    last = RD.forward(x, RD.unpack(model.weights, model.sizes))[-1]
    assert [got[r["Patient_ID"]]["p_class1"] for r in rows] == pytest.approx((1 / (1 + np.exp(-last[:, 0]))).tolist(), abs=1e-12)
    assert [got[r["Patient_ID"]]["pred_time"] for r in rows] == pytest.approx((last[:, 1] * model.scale.y_std + model.scale.y_mean).tolist(), abs=1e-9)


def test_missing_and_infinite_features_count_as_the_mean(spark):
    rows = [(1, 1.0, None, 0.0, 1, 1.0, "train"), (2, 3.0, float("inf"), 0.0, 0, 2.0, "train"), (3, float("nan"), 4.0, 0.0, 1, 3.0, "train"),
            (4, 2.0, 1.0, 0.0, None, 3.0, "train"), (5, 2.0, 1.0, 0.0, 1, None, "train"), (6, 2.0, None, 0.0, 0, 1.0, "test")]
    df = spark.createDataFrame(rows, "Patient_ID long, a double, b double, c double, CVD_Presence int, Time_To_Event double, split string")
    scale = RD.fit_scale(df.where("split = 'train' AND Patient_ID < 4"), COLS)
    assert scale.mean.tolist() == [2.0, 4.0, 0.0] and scale.std.tolist() == [1.0, 1.0, 1.0]
    assert {r["Patient_ID"]: r["x"] for r in RD.scaled_rows(df, scale).collect()}[2] == [1.0, 0.0, 0.0]
    model = RD.fit_rounds(df, COLS, RD.RoundSettings(rounds=3))        # no validation row: the training loss decides
    assert model.path[0][1] == model.path[0][3] == pytest.approx(np.log(2)) and np.isfinite(model.weights).all()
    assert np.isfinite([r["pred_time"] for r in RD.predict_rounds(model, df.withColumn("pred", F.lit(1))).collect()]).all()
    with pytest.raises(ValueError, match="no training row"):
        RD.fit_rounds(df.where("split = 'test'"), COLS)


def test_training_survives_a_patient_without_a_defined_entropy(spark):
    from medfuse.functions.tsfeatures import FeatureSettings
    from medfuse.plans import training as TR
    rng = np.random.default_rng(3)
    ids = range(60)
    ehr = spark.createDataFrame([(i, float(rng.normal()), i % 2, float(i)) for i in ids], "Patient_ID long, age double, CVD_Presence int, Time_To_Event double")
    imaging = spark.createDataFrame([(i, float("inf") if i == 3 else float(rng.normal())) for i in ids], "Patient_ID long, e0 double")
    genomic = spark.createDataFrame([(i, int(rng.integers(3))) for i in ids], "Patient_ID long, g1 int")
    readings = [(i, t, float(v)) for i in ids for t, v in enumerate([1.0, 2.0, 1.0, 2.0, 5.0] if i == 7 else rng.integers(0, 3, 12))]
    wearables = spark.createDataFrame(readings, "Patient_ID long, time long, value double")
    prep = TR.prepare(spark, {"ehr": ehr, "imaging": imaging, "wearables": wearables, "genomic": genomic}, FeatureSettings().only("F1", "F21"))
    stored = prep.matrix.where("Patient_ID IN (3, 7)").select("Patient_ID", "imaging_e0", "value__sample_entropy").collect()
    assert {r["Patient_ID"]: (r["imaging_e0"], r["value__sample_entropy"]) for r in stored}[7][1] is None
    assert all(v is None or np.isfinite(v) for r in stored for v in r[1:])
    assert all(n == 1 for n in prep.non_finite.values()) and set(prep.non_finite) <= {"imaging_e0"}
    metrics = {r["metric"]: r["value"] for r in TR.train_multimodal(prep, fusion=False).metrics.collect()}
    assert np.isfinite(metrics["roc_auc"])


def _wide_prep(spark, n=60):
    """Four small modalities; a row's label depends on its number, one EHR value in seven is missing."""
    from medfuse.functions.tsfeatures import FeatureSettings
    from medfuse.plans import training as TR
    rows = [(i, None if i % 7 == 0 else float(i % 11), i % 2, float(i % 13)) for i in range(n)]
    ehr = spark.createDataFrame(rows, "Patient_ID long, age double, CVD_Presence int, Time_To_Event double")
    imaging = spark.createDataFrame([(i, float(i % 5), float((3 * i) % 17)) for i in range(n)], "Patient_ID long, e0 double, e1 double")
    genomic = spark.createDataFrame([(i, i % 3) for i in range(n)], "Patient_ID long, g1 int")
    wearables = spark.createDataFrame([(i, t, float((i * t) % 19)) for i in range(n) for t in range(6)], "Patient_ID long, time int, value double")
    mods = {"ehr": ehr, "imaging": imaging, "wearables": wearables, "genomic": genomic}
    return TR.prepare(spark, mods, FeatureSettings().only("F1"))


def test_heads_are_fitted_and_scored_without_the_feature_columns(spark):
    from medfuse.operators.models import build_pipeline, predict
    from medfuse.plans import training as TR
    prep = _wide_prep(spark)
    features = {c for cs in prep.columns.values() for c in cs}
    scores = ["Patient_ID", "p_class1", "pred_class", "pred_time"]
    for fusion in (False, True):
        tr = TR.train_multimodal(prep, fusion=fusion)
        for df in (tr.predictions, tr.background):
            plan = df._jdf.queryExecution().analyzed().toString()
            assert not features.intersection(df.columns) and "__imp" not in plan
        # the model is the one that a fit of all stages on the feature columns gives, and scores wide rows alike
        whole = build_pipeline(prep.columns, fusion).fit(prep.train)
        told = [{r[0]: r[1:] for r in p.select(*scores).collect()} for p in
                (tr.predictions, predict(whole, prep.test), predict(tr.model, prep.test), predict(tr.model, prep.test, ["Patient_ID"]))]
        assert told[0] and all(t.keys() == told[0].keys() for t in told)
        for k, row in told[0].items():
            assert all(abs(a - b) < 1e-6 for t in told[1:] for a, b in zip(row, t[k]))
        assert tr.background.count() == prep.train.count()


def test_values_are_counted_for_more_columns_than_one_aggregate_takes(spark, monkeypatch):
    from medfuse.operators import models
    monkeypatch.setattr(models, "COUNTED", 2)
    df = spark.createDataFrame([(1.0, float("nan"), None, 2), (float("inf"), 3.0, None, None), (2.0, 5.0, 1.0, 7)], "a double, b double, c double, d int")
    assert models.observed(df, ["a", "b", "c", "d"]) == {"a": (2, 1), "b": (2, 1), "c": (1, 0), "d": (2, 0)}
    assert models.observed(df, []) == {}


def test_time_head_learns_from_patients_with_a_time(spark):
    """A patient without an event (NULL or NaN time) still teaches the class head, is scored, and counts in no regression metric."""
    from dataclasses import replace

    from medfuse.plans import training as TR
    prep = _wide_prep(spark)
    time = F.when(F.col("Patient_ID") % 5 == 0, None).when(F.col("Patient_ID") % 5 == 1, float("nan")).otherwise(F.col("Time_To_Event"))
    some = prep.matrix.withColumn("Time_To_Event", time)
    gaps = replace(prep, matrix=some, train=some.where("split != 'test'"), test=some.where("split = 'test'"))
    whole, part = (TR.train_multimodal(p, fusion=False) for p in (prep, gaps))
    told = lambda tr: {r["Patient_ID"]: r for r in tr.predictions.select("Patient_ID", "p_class1", "pred_time").collect()}
    assert told(part).keys() == told(whole).keys()
    assert all(abs(told(part)[k]["p_class1"] - r["p_class1"]) < 1e-9 for k, r in told(whole).items())
    assert all(np.isfinite(r["pred_time"]) for r in told(part).values())
    assert part.background.count() == whole.background.count()
    known = {r[0]: r[1] for r in prep.test.where("Patient_ID % 5 > 1").select("Patient_ID", "Time_To_Event").collect()}
    mae = np.mean([abs(told(part)[k]["pred_time"] - y) for k, y in known.items()])
    metrics = {r["metric"]: r["value"] for r in part.metrics.collect()}
    assert known and abs(metrics["mae"] - mae) < 1e-9 and all(np.isfinite(v) for v in metrics.values())
    stopped = replace(gaps, matrix=some.withColumn("split", F.expr("IF(split = 'train' AND Patient_ID % 3 = 0, 'validation', split)")))
    gbt = TR.train_multimodal(stopped, fusion=False, classifier="gbt", regressor="gbt")
    assert all(np.isfinite(r["value"]) for r in gbt.metrics.collect())
    assert {r["metric"] for r in TR.ablation_study(gaps, parallelism=2).where("scope = 'All'").collect()} == set(metrics)
