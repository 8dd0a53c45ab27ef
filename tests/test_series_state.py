"""Order-based stream features: any order of arrival, replays and late readings give what the batch extraction gives."""

import datetime
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from medfuse.functions.tsfeatures import FeatureSettings, extract_features
from medfuse.streaming import series_state as SST

SCHEMA = "Patient_ID long, time timestamp, value double"


def at(i):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=17 * i)


def expected(spark, rows):
    feats = extract_features(spark.createDataFrame(rows, SCHEMA), "Patient_ID", "time", settings=FeatureSettings().only("F8", "F9", "F12"))
    return {r["Patient_ID"]: {c[len("value__"):]: r[c] for c in feats.columns if c != "Patient_ID"} for r in feats.collect()}


def kept(spark, base):
    return {r["Patient_ID"]: {c: r[c] for c in r.asDict() if c != "Patient_ID"} for r in SST.features(SST.current_state(spark, base)).collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert got[k].keys() == want[k].keys()
        for c in want[k]:
            assert got[k][c] == (pytest.approx(want[k][c], rel=1e-9, abs=1e-9) if want[k][c] is not None else None), (k, c)


def test_states_follow_any_order_of_arrival_and_replays(spark, monkeypatch):
    monkeypatch.setattr(SST, "FULL_EVERY", 2)
    rng = random.Random(5)
    rows = [(p, at(i), float(rng.randint(0, 9))) for p in (1, 2, 3) for i in range(60)]
    rows += [(4, at(0), 1.0), (5, at(0), 2.0), (5, at(1), 2.0), (6, at(3), 1.0), (6, at(3), 0.0), (6, at(3), 1.0)]
    late = {1: 0.0, 2: 0.2, 3: 1.0}          # patient 1 arrives in order, 2 with late readings, 3 in any order
    files = [[], [], []]
    for r in rows:
        i = min(2, int((r[1] - at(0)) / datetime.timedelta(minutes=17 * 20)))
        files[rng.randrange(3) if rng.random() < late.get(r[0], 0) else i].append(r)
    files[2].append((6, at(2), 5.0))         # before everything known of patient 6
    base, seen = tempfile.mkdtemp(), []
    opened = []
    summaries = SST._summaries
    monkeypatch.setattr(SST, "_summaries", lambda df, st: opened.append(df.where("NOT new").count()) or summaries(df, st))
    for b, part in enumerate(files):
        df = spark.createDataFrame(part + [(None, at(1), 1.0), (9, None, 1.0), (9, at(2), float("inf")), (9, at(2), None)], SCHEMA)
        SST.upsert(df.withColumn("n", F.lit(1)), b, base)
        if b == 1:
            SST.upsert(df, b, base)          # replayed after a failure
        seen += part
        if b:
            same(kept(spark, base), expected(spark, seen))
    assert opened[-1] > 0                    # the last batch continued some series from their last readings alone
    monkeypatch.setattr(SST, "FULL_EVERY", 50)
    assert SST.current_state(spark, base).count() == 6


def test_no_readings_give_no_states(spark):
    base = tempfile.mkdtemp()
    assert SST.current_state(spark, base).count() == 0
    SST.upsert(spark.createDataFrame([], SCHEMA), 0, base)
    assert SST.features(SST.current_state(spark, base)).count() == 0
