"""The skew-safe paths (tiny time chunks, tiny blocks with halos) give the same answers."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from medfuse.functions import series as S
from medfuse.functions.tsfeatures import FeatureSettings, extract_features
from medfuse.sources import fixtures as fx


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_rank_matches_plain_window(spark, sf_small):
    w = fx.wearables(spark, sf_small, inject_nulls=False)
    ranked = S.rank_series(w, ["Patient_ID"], ["time", "value"], chunk_width=3600)
    plain = w.withColumn("rn", F.row_number().over(Window.partitionBy("Patient_ID").orderBy("time", "value")))
    assert _rows(ranked, ["Patient_ID", "time", "rn"]) == _rows(plain, ["Patient_ID", "time", "rn"])


def test_readings_packed_into_a_day_and_an_instant_spread_over_pieces(spark):
    """200,000 readings of one patient in one day, a quarter of them at one instant, with values of very unlike sizes."""
    base = spark.range(200_000).select(
        F.when(F.col("id") < 190_000, 1).otherwise(F.col("id") % 7).cast("long").alias("Patient_ID"),
        F.when(F.col("id") % 4 == 0, F.lit(43_200_000_000)).otherwise(F.abs(F.xxhash64("id")) % 86_400_000_000).alias("us"), "id")
    df = base.select("Patient_ID", F.timestamp_micros("us").alias("time"), F.when(F.col("id") % 1001 == 0, F.lit(None))
                     .when(F.col("id") % 1003 == 0, F.lit(float("nan"))).when(F.col("id") % 1007 == 0, F.lit(float("inf")))
                     .when(F.col("id") % 1009 == 0, F.lit(float("-inf")))
                     .otherwise(F.exp((F.abs(F.xxhash64("id", F.lit(1))) % 4000) / 10.0 - 200) * F.when(F.col("id") % 8 < 4, -1).otherwise(1)).alias("value"))
    rows, pieces = S.chunked(df, ["Patient_ID"], ["time", "value"], dense_rows=2_000)
    counts = rows.groupBy("Patient_ID", S.CHUNK).count()
    assert pieces.exceptAll(counts).isEmpty() and counts.exceptAll(pieces).isEmpty()
    assert counts.agg(F.max("count")).first()[0] <= 2_000 and counts.agg(F.sum("count")).first()[0] == 200_000
    ranked = S.rank_series(df, ["Patient_ID"], ["time", "value"], dense_rows=2_000)
    plain = df.withColumn("rn", F.row_number().over(Window.partitionBy("Patient_ID").orderBy("time", "value")))
    cols = ["Patient_ID", "time", "value", "rn"]
    assert ranked.select(cols).exceptAll(plain.select(cols)).isEmpty() and ranked.count() == 200_000
    shown = ranked._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in shown and "Cartesian" not in shown


def test_rows_that_no_order_column_tells_apart_stay_in_one_piece(spark):
    df = spark.range(500).select(F.lit(1).alias("k"), F.lit(2.0).alias("t"), F.col("id").cast("string").alias("s"))
    assert S.rank_series(df, ["k"], ["t"], dense_rows=10).select("rn").distinct().count() == 500
    ordered = S.rank_series(df, ["k"], ["t", "s"], dense_rows=10).orderBy("rn").collect()
    assert [r["s"] for r in ordered] == sorted(str(i) for i in range(500))


def test_neighbors_and_prefix_scan_cross_blocks(spark, sf_small):
    w = fx.wearables(spark, sf_small, inject_nulls=False)
    ranked = S.rank_series(w, ["Patient_ID"], ["time", "value"], chunk_width=7200)
    nb = S.with_neighbors(ranked, ["Patient_ID"], "value", [1, 3], [1, 5], block_rows=8)
    sc = S.prefix_scan(nb, ["Patient_ID"], {"cum": ("sum", F.col("value")), "mx": ("max", F.col("value"))}, 8)
    ow = Window.partitionBy("Patient_ID").orderBy("rn")
    run = ow.rowsBetween(Window.unboundedPreceding, 0)
    plain = ranked.select("Patient_ID", "rn", F.lag("value", 1).over(ow).alias("lag_1"),
                          F.lag("value", 3).over(ow).alias("lag_3"), F.lead("value", 1).over(ow).alias("lead_1"),
                          F.lead("value", 5).over(ow).alias("lead_5"), F.sum("value").over(run).alias("cum"),
                          F.max("value").over(run).alias("mx"))
    cols = ["Patient_ID", "rn", "lag_1", "lag_3", "lead_1", "lead_5", "mx"]
    assert _rows(sc, cols) == _rows(plain, cols)
    a = {(r["Patient_ID"], r["rn"]): r["cum"] for r in sc.collect()}
    b = {(r["Patient_ID"], r["rn"]): r["cum"] for r in plain.collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_features_independent_of_chunk_and_block(spark, sf_small):
    w = fx.wearables(spark, sf_small, inject_nulls=False)
    default = extract_features(w, "Patient_ID", "time").toPandas().set_index("Patient_ID").sort_index()
    tiny = extract_features(w, "Patient_ID", "time",
                            settings=FeatureSettings(chunk_width=1800, block_rows=64)).toPandas()
    tiny = tiny.set_index("Patient_ID").sort_index()[default.columns]
    diff = (default - tiny).abs()
    rel = diff / default.abs().clip(lower=1.0)
    assert (rel.fillna(0) < 1e-9).all().all(), rel.max().sort_values().tail(5)
    assert (default.isna() == tiny.isna()).all().all()


def test_exact_quantiles_bucketed_scan_matches_numpy(spark):
    """Heavy duplicates and very few value buckets: still numpy's linear quantiles."""
    import numpy as np
    import pytest

    from medfuse.functions.tsfeatures import FeatureSettings, extract_features, fname
    rng = np.random.default_rng(7)
    vals = {1: np.concatenate([np.full(300, 2.5), rng.normal(0, 3, 200).round(2)]),   # one hot value
            2: rng.exponential(5, 257).round(3), 3: np.array([4.0])}
    rows = [(int(k), float(i), float(v)) for k, xs in vals.items() for i, v in enumerate(xs)]
    df = spark.createDataFrame(rows, "Patient_ID long, time double, value double")
    for buckets in (2, 128):
        st = FeatureSettings(quantile_buckets=buckets).only("F1", "F4")
        got = extract_features(df, "Patient_ID", "time", settings=st).toPandas().set_index("Patient_ID")
        for k, xs in vals.items():
            assert got.loc[k, "value__median"] == pytest.approx(np.median(xs), abs=1e-12)
            for q in st.quantiles:
                assert got.loc[k, "value__" + fname("quantile", q=q)] == pytest.approx(np.quantile(xs, q), abs=1e-9)
