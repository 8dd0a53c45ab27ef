"""Scoring records, stream = batch, windowed stream features, models and ablation."""

import datetime
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from medfuse.plans import scoring as SC
from medfuse.plans import training as TR
from medfuse.sources import fixtures as fx
from medfuse.sources import model_store as MS
from medfuse.sources import records as R
from medfuse.streaming import scoring_stream as SS
from medfuse.streaming import window_features as WF


def test_validation_quarantines_bad_records(spark):
    good = dict(R.SAMPLE_RECORD)
    rows = [json.dumps(good), "not json at all", json.dumps({k: v for k, v in good.items() if k != "Patient_ID"}),
            json.dumps({**good, "imaging_features": [0.1, "x", 0.3]}), json.dumps({**good, "Patient_ID": 123})]
    raw = spark.createDataFrame([(r,) for r in rows], "value string")
    valid, quarantine = R.validate(R.parse_records(raw))
    assert valid.count() == 2                     # numeric Patient_ID is coerced to text, like the reference
    errs = {r["raw"]: r["errors"] for r in quarantine.collect()}
    assert len(errs) == 3
    assert any("Patient_ID: field required or invalid" in e for e in errs.values())
    assert any("imaging_features: field required or invalid" in e for e in errs.values())


@pytest.fixture(scope="module")
def trained(spark, sf_mid):
    prep = TR.prepare(spark, fx.modalities(spark, sf_mid))
    return prep, TR.train_multimodal(prep, fusion=False)


def test_model_outputs_and_roundtrip(spark, trained):
    prep, tr = trained
    pred = tr.predictions.select("Patient_ID", "p_class1", "pred_class", "pred_time").orderBy("Patient_ID")
    rows = pred.collect()
    assert rows and all(0.0 <= r["p_class1"] <= 1.0 for r in rows)
    assert all(r["pred_class"] == (1 if r["p_class1"] > 0.5 else 0) for r in rows)
    path = MS.save_model(tr.model, tempfile.mkdtemp() + "/m")
    again = TR.predict(MS.load_model(path), prep.test).select("Patient_ID", "p_class1").orderBy("Patient_ID").collect()
    assert [r["p_class1"] for r in again] == pytest.approx([r["p_class1"] for r in rows])
    metrics = {r["metric"]: r["value"] for r in tr.metrics.collect()}
    assert metrics["accuracy"] > 0.7          # the label is a function of the wearables readings


def test_stream_scoring_equals_batch_and_restarts_cleanly(spark, sf_mid, trained):
    prep, tr = trained
    recs = SC.records_from_modalities(fx.modalities(spark, sf_mid), keys=prep.test.select("Patient_ID"))
    recs = recs.unionAll(recs)                    # copies fall into different micro-batches
    batch, _ = SC.score_records(recs, tr.model, tr.columns, prep.layout, prep.stored, prep.fills)
    base = tempfile.mkdtemp()
    recs.repartition(3).write.text(f"{base}/src")
    args = (tr.model, tr.columns, prep.layout, prep.stored, prep.fills)
    q = SS.start_scoring_stream(spark, f"{base}/src", f"{base}/sink", f"{base}/ck", *args, max_files_per_trigger=1)
    q.awaitTermination()
    q2 = SS.start_scoring_stream(spark, f"{base}/src", f"{base}/sink", f"{base}/ck", *args)
    q2.awaitTermination()                         # restart: nothing new, nothing duplicated
    stream = spark.read.parquet(f"{base}/sink/results").drop("batch_id")
    key = ["Patient_ID", "CVD_Presence", "CVD_Presence_probability", "Time_To_Event"]
    a = sorted(tuple(r[k] for k in key) for r in batch.collect())
    b = sorted(tuple(r[k] for k in key) for r in stream.collect())
    assert len(a) == len(b) and all(x[:2] == y[:2] and x[2] == pytest.approx(y[2]) for x, y in zip(a, b))
    told = {str(r["Patient_ID"]): r["p_class1"] for r in tr.predictions.collect()}
    assert all(x[2] == pytest.approx(told[x[0]]) for x in a)      # M8 of a known patient is M7


def _record(trained, patient, **changes):
    prep, _ = trained
    full = {"Patient_ID": patient, "ehr_features": {c: 1.0 for c in prep.layout["ehr"]}, "imaging_features": [0.1] * len(prep.layout["imaging"]),
            "wearables_data": {"time": "2024-03-01 10:00:00", "value": 42.5}, "genomic_features": [1] * len(prep.layout["genomic"])}
    return json.dumps({**full, **changes})


def test_scoring_of_unknown_patients_copies_and_deficient_records(spark, trained):
    prep, tr = trained
    rows = {"new": _record(trained, "999001"), "other": _record(trained, "999002", wearables_data={"time": "2024-03-01 10:00:00", "value": -50}),
            "untimed": _record(trained, "999003", wearables_data={"value": 42.5}), "empty": _record(trained, "999004", ehr_features={}, imaging_features=[], genomic_features=[]),
            "short": _record(trained, "999005", imaging_features=[0.1, 0.2]), "named": _record(trained, "999006", ehr_features={"else": 1.0}),
            "unread": _record(trained, "999007", wearables_data={"steps": 3}), "text": _record(trained, "patient-x")}
    raw = spark.createDataFrame([(r,) for r in [*rows.values(), rows["new"], rows["new"]]], "value string")
    results, quarantine = SC.score_records(raw, tr.model, tr.columns, prep.layout, prep.stored)
    out = {}
    for r in results.collect():
        out.setdefault(r["Patient_ID"], []).append(r)
    assert quarantine.count() == 0
    assert len(out["999001"]) == 3 and len({r["CVD_Presence_probability"] for r in out["999001"]}) == 1
    assert all(r["features_from"] == "record" for rs in out.values() for r in rs)
    assert out["999001"][0]["error"] is None and out["999003"][0]["CVD_Presence_probability"] == pytest.approx(out["999001"][0]["CVD_Presence_probability"])
    assert out["patient-x"][0]["error"] is None
    for patient, told in (("999004", "ehr_features: no"), ("999005", "imaging_features: 2 elements"), ("999006", "ehr_features: no"), ("999007", "no reading")):
        r = out[patient][0]
        assert told in r["error"] and r["CVD_Presence"] is None and r["CVD_Presence_probability"] is None and r["Time_To_Event"] is None


def test_fusion_differs_from_the_flat_model(spark, trained):
    prep, tr = trained
    fused = TR.train_multimodal(prep)
    a = {r["Patient_ID"]: r["p_class1"] for r in tr.predictions.collect()}
    b = {r["Patient_ID"]: r["p_class1"] for r in fused.predictions.collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) > 1e-6


def test_layout_comes_from_the_modalities_not_from_names(spark):
    from medfuse.operators.models import modality_layout
    mods = {"ehr": spark.createDataFrame([(1, 2.0, 1)], "Patient_ID long, age double, CVD_Presence int"),
            "imaging": spark.createDataFrame([(1, 0.5)], "Patient_ID long, left_lobe double"),
            "wearables": spark.createDataFrame([(1, 5.0, 3.0, 1)], "Patient_ID long, steps_per_day double, sleep_hours double, time int"),
            "genomic": spark.createDataFrame([(1, 2)], "Patient_ID long, snp int")}
    matrix = TR.build_feature_matrix(mods, TR.FeatureSettings().only("F1"))
    layout = modality_layout(mods, matrix)
    assert layout["ehr"] == ["age"] and layout["imaging"] == ["imaging_left_lobe"] and layout["genomic"] == ["genomic_snp"]
    assert {c.split("__")[0] for c in layout["wearables"]} == {"steps_per_day", "sleep_hours"}


def test_session_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace
    from medfuse.session import ensure_checkpoint_dir
    conf = SimpleNamespace(get=lambda k, d=None: d)
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=conf))


def test_windowed_stream_drops_late_rows(spark):
    base = tempfile.mkdtemp()
    schema = "Patient_ID long, time timestamp, value double"
    d = datetime.datetime
    # a batch is judged by the watermark of the batch before: the 02:00 reading of the second file still counts (no batch
    # before it had closed its window), the 03:00 reading of the third does not
    files = {"a": [(1, d(2024, 1, 1, 1), 1.0), (1, d(2024, 1, 3, 5), 2.0)], "b": [(1, d(2024, 1, 1, 2), 5.0), (1, d(2024, 1, 5, 5), 3.0)],
             "c": [(1, d(2024, 1, 1, 3), 7.0), (1, d(2024, 1, 7, 5), 4.0), (1, d(2024, 1, 7, 6), 9.0), (2, d(2024, 1, 7, 5), None)]}
    for name, rows in files.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/in/{name}")
    every = spark.read.schema(schema).parquet(*[f"{base}/in/{f}" for f in files])
    src = (spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*"))
    q = WF.run_to_sink(WF.windowed_features(src), f"{base}/out", f"{base}/ck")
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out").orderBy("window_start").collect()
    assert [(r["window_start"].day, r["n"]) for r in out] == [(1, 2), (3, 1), (5, 1)]
    dropped = sum(p["stateOperators"][0].get("numRowsDroppedByWatermark", 0) for p in q.recentProgress
                  if p.get("stateOperators"))
    assert dropped == 1
    whole = {(r["Patient_ID"], r["window_start"].day): (r["n"], r["median_approx"], r["median"])
             for r in WF.completed(spark, every, f"{base}/out").collect()}
    assert whole == {(1, 1): (2, 1.0, 5.0), (1, 3): (1, 2.0, 2.0), (1, 5): (1, 3.0, 3.0), (1, 7): (2, 4.0, 6.5), (2, 7): (0, None, None)}


def test_window_state_does_not_grow_with_its_readings(spark):
    sizes = []
    for n in (20_000, 80_000):
        base = tempfile.mkdtemp()
        (spark.range(n).selectExpr("1L AS Patient_ID", "timestamp'2024-01-01 01:00:00' AS time", "CAST(hash(id) AS DOUBLE) AS value")
         .coalesce(1).write.parquet(f"{base}/in/a"))
        src = spark.readStream.schema("Patient_ID long, time timestamp, value double").parquet(f"{base}/in/*")
        WF.run_to_sink(WF.windowed_features(src, accuracy=100), f"{base}/out", f"{base}/ck").awaitTermination()
        sizes.append(sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{base}/ck/state") for f in fs))
    assert sizes[1] < 1.5 * sizes[0] and sizes[1] < 60_000


def test_ablation_no_wearables_loses_most(spark, sf_mid, trained):
    prep, _ = trained
    ab = {(r["scope"], r["metric"]): r["value"] for r in TR.ablation_study(prep, regressor=None).collect()}
    scopes = {s for s, _ in ab}
    assert scopes == {"All", "No Ehr", "No Imaging", "No Wearables", "No Genomic"}
    auc = {s: ab[(s, "roc_auc")] for s in scopes}
    assert min(auc, key=auc.get) == "No Wearables"
