"""Cross-check time-series features against numpy / pandas on a small fixture."""

import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from medfuse.functions.tsfeatures import FeatureSettings, extract_features, fname
from medfuse.sources import fixtures as fx


@pytest.fixture(scope="module")
def data(spark, sf_small):
    w = fx.wearables(spark, sf_small, inject_nulls=False)
    feats = extract_features(w, "Patient_ID", "time").toPandas().set_index("Patient_ID")
    series = {k: g.sort_values(["time", "value"])["value"].to_numpy()
              for k, g in w.toPandas().groupby("Patient_ID")}
    return feats, series


def _acf(x, lag):
    m, v = x.mean(), x.var()
    return ((x[:len(x) - lag] - m) * (x[lag:] - m)).sum() / ((len(x) - lag) * v)


def _perm_entropy(x, d):
    pats = {}
    for i in range(len(x) - d + 1):
        p = tuple(np.argsort(x[i:i + d], kind="stable"))
        pats[p] = pats.get(p, 0) + 1
    c = np.array(list(pats.values()), dtype=float)
    p = c / c.sum()
    return -(p * np.log(p)).sum()


def _pacf(x, k):
    r = [_acf(x, l) for l in range(1, k + 1)]
    phi, out = [], []
    for kk in range(1, k + 1):
        num = r[kk - 1] - sum(phi[j] * r[kk - 2 - j] for j in range(kk - 1))
        den = 1 - sum(phi[j] * r[j] for j in range(kk - 1))
        p = num / den
        phi = [phi[j] - p * phi[kk - 2 - j] for j in range(kk - 1)] + [p]
        out.append(p)
    return out


def test_against_numpy(data):
    feats, series = data
    for pid, x in series.items():
        row = feats.loc[pid]
        n = len(x)
        checks = {
            "value__mean": x.mean(), "value__median": np.median(x), "value__variance": x.var(),
            "value__skewness": pd.Series(x).skew(), "value__kurtosis": pd.Series(x).kurt(),
            "value__" + fname("quantile", q=0.3): np.quantile(x, 0.3),
            "value__absolute_sum_of_changes": np.abs(np.diff(x)).sum(),
            "value__" + fname("autocorrelation", lag=3): _acf(x, 3),
            "value__" + fname("partial_autocorrelation", lag=3): _pacf(x, 3)[2],
            "value__" + fname("fft_coefficient", attr="abs", coeff=3): abs(np.fft.rfft(x)[3]),
            "value__" + fname("fft_coefficient", attr="real", coeff=2): np.fft.rfft(x)[2].real,
            "value__" + fname("binned_entropy", max_bins=10): -sum(
                p * math.log(p) for p in np.histogram(x, bins=10)[0] / n if p > 0),
            "value__" + fname("permutation_entropy", dimension=4, tau=1): _perm_entropy(x, 4),
            "value__" + fname("mean_n_absolute_max", number_of_maxima=7): np.sort(np.abs(x))[-7:].mean(),
            "value__first_location_of_maximum": np.argmax(x) / n,
            "value__last_location_of_minimum": 1.0 - np.argmin(x[::-1]) / n,
            "value__" + fname("c3", lag=2): np.mean((np.roll(x, -4) * np.roll(x, -2) * x)[: n - 4]),
            "value__" + fname("number_peaks", n=3): sum(
                all(x[i] > x[i - j] and x[i] > x[i + j] for j in range(1, 4)) for i in range(3, n - 3)),
            "value__" + fname("energy_ratio_by_chunks", num_segments=10, segment_focus=3):
                (np.array_split(x, 10)[3] ** 2).sum() / (x ** 2).sum(),
        }
        ls = np.polyfit(np.arange(n), x, 1)
        checks["value__" + fname("linear_trend", attr="slope")] = ls[0]
        for name, want in checks.items():
            assert row[name] == pytest.approx(want, rel=1e-7, abs=1e-9), (pid, name)


def test_short_series_are_null_not_errors(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (2, 1, 1.0), (2, 2, 3.0)], "Patient_ID long, time long, value double")
    out = extract_features(df, "Patient_ID", "time", settings=FeatureSettings(chunk_width=10)).toPandas()
    one = out.set_index("Patient_ID").loc[1]
    assert one["value__length"] == 1
    assert pd.isna(one["value__skewness"]) and pd.isna(one["value__mean_change"])
    assert one["value__absolute_sum_of_changes"] == 0


def test_null_and_nan_readings_are_skipped(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, None), (1, 3, float("nan")), (1, 4, 7.0)],
                               "Patient_ID long, time long, value double")
    out = extract_features(df, "Patient_ID", "time", settings=FeatureSettings(chunk_width=10).only("F1", "F8"))
    r = out.first()
    assert r["value__length"] == 2 and r["value__mean"] == 6.0 and r["value__mean_change"] == 2.0


def test_feature_order_invariance(spark, sf_small):
    w = fx.wearables(spark, sf_small, inject_nulls=False)
    st = FeatureSettings().only("F8", "F9", "F14")
    a = extract_features(w, "Patient_ID", "time", settings=st).toPandas().set_index("Patient_ID").sort_index()
    b = extract_features(w.repartition(7).orderBy(F.rand(3)), "Patient_ID", "time", settings=st)
    b = b.toPandas().set_index("Patient_ID").sort_index()
    pd.testing.assert_frame_equal(a, b[a.columns], check_exact=False, rtol=1e-12)


# ----------------------------------------------------------------------------- F21 against the O(n^2) definitions

def _templates(x, L):
    return np.array([x[i:i + L] for i in range(len(x) - L + 1)])


def _sample_entropy(x, factor=0.2):
    tol = factor * np.std(x)
    b = sum((np.abs(t - _templates(x, 2)).max(axis=1) <= tol).sum() - 1 for t in _templates(x, 2))
    a = sum((np.abs(t - _templates(x, 3)).max(axis=1) <= tol).sum() - 1 for t in _templates(x, 3))
    return -math.log(a / b) if a else math.inf


def _approximate_entropy(x, m, factor):
    r = factor * np.std(x)
    if len(x) <= m + 1:
        return 0.0

    def phi(L):
        t = _templates(x, L)
        c = (np.abs(t[:, None, :] - t[None, :, :]).max(axis=2) <= r).sum(axis=0) / len(t)
        return np.log(c).sum() / len(t)
    return abs(phi(m) - phi(m + 1))


def test_entropies_against_numpy(data):
    feats, series = data
    st = FeatureSettings()
    for pid, x in list(series.items())[:6]:
        assert feats.loc[pid, "value__sample_entropy"] == pytest.approx(_sample_entropy(x), rel=1e-9)
        for r in st.apen_r:
            got = feats.loc[pid, "value__" + fname("approximate_entropy", m=st.apen_m, r=r)]
            assert got == pytest.approx(_approximate_entropy(x, st.apen_m, r), rel=1e-9, abs=1e-12)


def test_entropies_edge_series(spark):
    """Constant series (r = 0: exact-template cells), a two-level series and a tiny one."""
    rows = [(1, float(i), 5.0) for i in range(12)]                      # constant
    rows += [(2, float(i), float(i % 2)) for i in range(15)]            # alternating
    rows += [(3, float(i), v) for i, v in enumerate([1.0, 4.0, 2.0])]   # n = m + 1
    df = spark.createDataFrame(rows, "Patient_ID long, time double, value double")
    st = FeatureSettings().only("F21")
    got = extract_features(df, "Patient_ID", "time", settings=st).toPandas().set_index("Patient_ID")
    for pid in (1, 2):
        x = np.array([v for p, _, v in rows if p == pid])
        assert got.loc[pid, "value__sample_entropy"] == pytest.approx(_sample_entropy(x))
        for r in st.apen_r:
            assert got.loc[pid, "value__" + fname("approximate_entropy", m=2, r=r)] == pytest.approx(
                _approximate_entropy(x, 2, r), abs=1e-12)
    assert got.loc[3, "value__" + fname("approximate_entropy", m=2, r=0.5)] == 0.0


def test_bad_readings_do_not_count_in_any_group(spark):
    """NULL times, NULL, NaN and infinite values: every feature equals that of the clean readings."""
    clean = [(1, float(t), float((t * 7919) % 101) / 10) for t in range(1, 41)]
    dirty = clean + [(1, None, 90.0), (1, 5.5, None), (1, 6.5, float("nan")), (1, 7.5, float("inf")), (1, 8.5, float("-inf"))]
    schema = "Patient_ID long, time double, value double"
    a = extract_features(spark.createDataFrame(clean, schema), "Patient_ID", "time").first().asDict()
    b = extract_features(spark.createDataFrame(dirty, schema).repartition(3), "Patient_ID", "time").first().asDict()
    assert a["value__length"] == 40 and a.keys() == b.keys()
    for k in a:
        assert (a[k] is None and b[k] is None) or a[k] == pytest.approx(b[k], nan_ok=True), k


def test_entropies_by_tiles_of_blocks(spark):
    """A series of many blocks: every block meets every block, pairs are counted once, and no row goes to more tiles than there are blocks."""
    rng = np.random.default_rng(11)
    series = {1: rng.normal(0, 1, 41).round(1), 2: rng.integers(0, 3, 16).astype(float), 3: np.array([2.0, 5.0]), 4: np.array([1.0])}
    df = spark.createDataFrame([(k, float(i), float(v)) for k, xs in series.items() for i, v in enumerate(xs)], "Patient_ID long, time double, value double")
    for block in (4, 2048):
        feats = extract_features(df, "Patient_ID", "time", settings=replace(FeatureSettings().only("F21"), entropy_block_rows=block))
        got = feats.toPandas().set_index("Patient_ID")
        assert sorted(got.index) == [1, 2, 3]
        for pid in (1, 2):
            assert got.loc[pid, "value__sample_entropy"] == pytest.approx(_sample_entropy(series[pid]), rel=1e-9)
            for r in FeatureSettings().apen_r:
                assert got.loc[pid, "value__" + fname("approximate_entropy", m=2, r=r)] == pytest.approx(
                    _approximate_entropy(series[pid], 2, r), rel=1e-9, abs=1e-12)
    plan = feats._jdf.queryExecution().optimizedPlan().toString()
    assert "named_struct" not in plan and plan.count("Generate explode(sequence(") == 2     # no row per tolerance and offset


def test_sample_entropy_is_infinite_where_no_pair_goes_on(spark):
    """A pair of length 2 and none of length 3: infinite in the extraction (and its SQL), NULL in the feature matrix."""
    import duckdb

    from medfuse import oracle
    from medfuse.plans.features import build_feature_matrix
    series = {1: [1.0, 2.0, 1.0, 2.0, 5.0], 2: [1.0, 2.0, 1.0, 2.0, 1.0], 3: [1.0, 9.0, 4.0]}
    rows = [(k, t, v) for k, xs in series.items() for t, v in enumerate(xs)]
    df = spark.createDataFrame(rows, "Patient_ID long, time long, value double")
    st = FeatureSettings().only("F21")
    got = {r["Patient_ID"]: r["value__sample_entropy"] for r in extract_features(df, "Patient_ID", "time", settings=st).collect()}
    assert got == {1: math.inf, 2: pytest.approx(_sample_entropy(np.array(series[2]))), 3: None}
    every = {r["Patient_ID"]: r["value__sample_entropy"] for r in extract_features(df, "Patient_ID", "time").collect()}
    assert every == got
    con = duckdb.connect()
    con.execute("CREATE TABLE readings (Patient_ID BIGINT, time TIMESTAMP, value DOUBLE)")
    con.executemany("INSERT INTO readings VALUES (?, make_timestamp(?::BIGINT), ?)", [list(r) for r in rows])
    sql = {f: oracle.feature_sql("F21", source="readings", finite=f).replace(oracle.MODALITY_CTES + ",", "") for f in (False, True)}
    by_sql = {f: dict(con.execute(f"SELECT Patient_ID, sample_entropy FROM ({sql[f]})").fetchall()) for f in sql}
    assert by_sql[False] == {1: math.inf, 2: pytest.approx(got[2], abs=1e-6), 3: None} and by_sql[True] == by_sql[False] | {1: None}
    keys = [(k,) for k in series]
    one = lambda c: spark.createDataFrame(keys, "Patient_ID long").withColumn(c, F.lit(1.0))
    matrix = build_feature_matrix({"ehr": one("age"), "imaging": one("e0"), "wearables": df, "genomic": one("g1")}, st)
    assert {r["Patient_ID"]: r["value__sample_entropy"] for r in matrix.collect()} == got | {1: None}
