"""Hand-sized frames for cleaning, profiling and joins."""

import math

import pytest
from pyspark.sql import functions as F

from medfuse.operators import clean as C
from medfuse.operators import joins as J
from medfuse.operators import profile as P


def test_impute_mean_rules(spark):
    df = spark.createDataFrame([(1, 1, None, float("nan"), "a"), (2, 2, None, 4.0, None), (3, 4, None, 2.0, "c")],
                               "Patient_ID long, i int, allnull double, d double, s string")
    out = C.impute_mean(df).orderBy("Patient_ID").collect()
    assert [r["i"] for r in out] == [1.0, 2.0, 4.0]               # ints become double
    assert out[0]["d"] == 3.0                                     # NaN counts as missing
    assert all(r["allnull"] is None for r in out)                  # all-null stays null
    assert [r["s"] for r in out] == ["a", None, "c"]               # strings untouched
    assert [r["Patient_ID"] for r in out] == [1, 2, 3]             # key untouched


def test_integer_mean_not_truncated(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, None), (4, 4)], "Patient_ID long, v int")
    assert C.impute_mean(df).where("Patient_ID = 3").first()["v"] == pytest.approx(7 / 3)


def test_standardize_population_std_and_constant(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0)], "Patient_ID long, a double, c double")
    out = C.standardize(df, ["a", "c"]).orderBy("Patient_ID").collect()
    assert [r["a"] for r in out] == [-1.0, 1.0] and [r["c"] for r in out] == [0.0, 0.0]


def test_coerce_fill_nan_to_num(spark):
    df = spark.createDataFrame([(1, "1.5", float("nan")), (2, "abc", float("inf")), (3, None, float("-inf"))],
                               "Patient_ID long, t string, x double")
    co = C.fill_zero(C.coerce_numeric(df)).orderBy("Patient_ID").collect()
    assert [r["t"] for r in co] == [1.5, 0.0, 0.0]
    nn = C.nan_to_num_cols(df, ["x"]).orderBy("Patient_ID").collect()
    assert nn[0]["x"] == 0.0 and nn[1]["x"] == 1.7976931348623157e308 and nn[2]["x"] == -1.7976931348623157e308


def test_drop_and_defaults(spark):
    df = spark.createDataFrame([(1, 2.0)], "Patient_ID long, a double")
    assert C.drop_lenient(df, ["a", "zz"]).columns == ["Patient_ID"]
    with pytest.raises(KeyError):
        C.drop_strict(df, ["zz"])
    assert C.ensure_column(df, "Time_To_Event").first()["Time_To_Event"] == 0.0
    assert C.restore_key(df.withColumnRenamed("Patient_ID", "index")).columns[0] == "Patient_ID"


def test_one_hot_argmax_decisions(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.2)], "c int, p double")
    oh = C.one_hot(df, "c").orderBy("c").collect()
    assert [list(r["c_onehot"]) for r in oh] == [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    d = df.select(C.class_from_prob("p").alias("k"), C.argmax_class(F.array(1 - F.col("p"), F.col("p"))).alias("a"),
                  C.label_text(C.class_from_prob("p")).alias("t")).collect()
    assert [(r["k"], r["a"], r["t"]) for r in d] == [(0, 0, "Negative"), (1, 1, "Positive"), (0, 0, "Negative")]


def test_missingness_profile(spark):
    df = spark.createDataFrame([(1, None, float("nan")), (2, 1.0, 2.0), (None, 1.0, 3.0)],
                               "Patient_ID long, a double, b double")
    p1 = {r["column"]: (r["n"], r["n_missing"]) for r in P.missingness(df).collect()}
    assert p1 == {"Patient_ID": (3, 1), "a": (3, 1), "b": (3, 1)}
    p2 = {r["pattern"]: r["n"] for r in P.missingness_patterns(df).collect()}
    assert p2 == {"011": 1, "000": 1, "100": 1}


def test_merge_rules(spark):
    ehr = spark.createDataFrame([(1, 1.0), (2, 2.0), (None, 3.0)], "Patient_ID long, a double")
    img = spark.createDataFrame([(1, 0.1), (3, 0.3)], "Patient_ID long, e double")
    wear = spark.createDataFrame([(1, 5.0), (1, 6.0), (2, 7.0)], "Patient_ID long, value double")
    gen = spark.createDataFrame([(1, 1), (2, 2)], "Patient_ID long, g int")
    tables = {"ehr": ehr, "imaging": img, "wearables": wear, "genomic": gen}
    m = J.merge_modalities(tables)
    assert m.columns == ["Patient_ID", "a", "imaging_e", "wearables_value", "genomic_g"]
    assert m.count() == 2                                           # fan-out kept, only key 1 in all
    rep = {r["modality"]: (r["n_keys"], r["n_lost"], r["n_null_key_rows"]) for r in J.unmatched_keys(tables).collect()}
    assert rep == {"ehr": (2, 1, 1), "imaging": (2, 1, 0), "wearables": (2, 1, 0), "genomic": (2, 1, 0)}
    wc = J.wide_concat([ehr.where("Patient_ID is not null"), img]).orderBy("Patient_ID").collect()
    assert [r["Patient_ID"] for r in wc] == [1, 2, 3]
    assert J.leave_one_out({"a": ["x"], "b": ["y"]}, "a") == ["y"]


def test_dummy_time_and_last_k(spark):
    df = spark.createDataFrame([(1, 10, 1.0), (1, 5, 2.0), (2, 7, 3.0), (1, 20, None)],
                               "Patient_ID long, event_id long, value double")
    t = {(r["Patient_ID"], r["event_id"]): r["time"] for r in C.dummy_time(df, ["event_id"], chunk_width=4).collect()}
    assert t == {(1, 5): 1, (1, 10): 2, (1, 20): 3, (2, 7): 1}
    seq = C.last_k_sequence(df.withColumnRenamed("event_id", "time"), 1).orderBy("Patient_ID").collect()
    assert [[s["value"] for s in r["sequence"]] for r in seq] == [[1.0], [3.0]]
    assert not math.isnan(1.0)


def test_csv_with_schema_keeps_corrupt_rows(spark, tmp_path):
    """A value that does not parse is kept as raw text, not silently NULL."""
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    from medfuse.sources.loaders import corrupt_rows, load_table
    p = tmp_path / "ehr.csv"
    p.write_text("Patient_ID,acctbal\n1,10.5\n2,not-a-number\n3,\n")
    schema = StructType([StructField("Patient_ID", LongType()), StructField("acctbal", DoubleType())])
    df = load_table(spark, str(p), schema, keep_corrupt=True)
    rows = {r["Patient_ID"]: r for r in df.collect()}
    assert rows[1]["acctbal"] == 10.5 and rows[1]["_corrupt_record"] is None
    assert rows[3]["acctbal"] is None and rows[3]["_corrupt_record"] is None      # empty = missing
    assert rows[2]["_corrupt_record"] == "2,not-a-number"
    assert [r["Patient_ID"] for r in corrupt_rows(df).collect()] == [2]
    assert "_corrupt_record" not in load_table(spark, str(p), schema).columns
