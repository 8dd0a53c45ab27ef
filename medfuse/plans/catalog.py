"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Names start with the SURVEY §2 operator id.  Every query reads the driver's
tables (through the modality views in ``medfuse.sources.fixtures``) over the
whole table; doubles are rounded to 6 places for the cross-engine compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medfuse.functions.exprs import round_doubles
from medfuse.functions.tsfeatures import FeatureSettings, extract_features
from medfuse.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]

FEATURE_QUERIES = {
    "F1": "f1_basic_stats", "F2": "f2_dispersion", "F3": "f3_skew_kurtosis", "F4": "f4_quantiles",
    "F5": "f5_threshold_counts", "F6": "f6_mean_relative", "F7": "f7_reoccurrence", "F8": "f8_changes",
    "F9": "f9_nonlinear", "F10": "f10_autocorrelation", "F11": "f11_partial_autocorrelation",
    "F12": "f12_extreme_locations", "F13": "f13_linear_trends", "F14": "f14_strikes",
    "F15": "f15_crossings_peaks", "F16": "f16_energy_mass", "F17": "f17_change_quantiles",
    "F18": "f18_mean_abs_max", "F19": "f19_entropy_benford", "F20": "f20_permutation_entropy",
    "F21": "f21_sample_approx_entropy", "F22": "f22_fft_coefficients",
}


def _feature_query(group: str) -> Query:
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = fx.wearables(spark, sf_dir, inject_nulls=False)
        feats = extract_features(w, "Patient_ID", "time", settings=FeatureSettings().only(group))
        return round_doubles(feats.select("Patient_ID", *[F.col(c).alias(c[len("value__"):])
                                                           for c in feats.columns if c != "Patient_ID"]))
    q.__name__ = FEATURE_QUERIES[group]
    return q


# ----------------------------------------------------------------------------- P, R, J, slice 1
import uuid  # noqa: E402
from functools import reduce  # noqa: E402

from medfuse.operators import clean as C  # noqa: E402
from medfuse.operators import joins as J  # noqa: E402
from medfuse.operators import profile as P  # noqa: E402
from medfuse.plans.features import patient_feature_matrix  # noqa: E402

KEY = fx.KEY


def p1_missingness(spark, sf_dir):
    mods = fx.modalities(spark, sf_dir)
    return round_doubles(reduce(DataFrame.unionByName, [P.missingness(df).withColumn("modality", F.lit(n))
                                                         for n, df in mods.items()]))


def p2_missingness_patterns(spark, sf_dir):
    mods = fx.modalities(spark, sf_dir)
    return reduce(DataFrame.unionByName, [P.missingness_patterns(df).withColumn("modality", F.lit(n))
                                          for n, df in mods.items()])


def r2_impute_ehr(spark, sf_dir):
    return round_doubles(C.impute_mean(fx.ehr(spark, sf_dir)))


def r2_impute_wearables(spark, sf_dir):
    return round_doubles(C.impute_mean(fx.wearables(spark, sf_dir)))


def r8_r9_coerce_fill(spark, sf_dir):
    return round_doubles(C.fill_zero(C.coerce_numeric(fx.ehr(spark, sf_dir))))


def _with_non_finite(spark, sf_dir):
    ev = fx.table(spark, sf_dir, "events")
    e = F.col("event_id")
    v = (F.when(e % 13 == 0, F.lit(float("nan"))).when(e % 17 == 0, F.lit(float("inf")))
          .when(e % 19 == 0, F.lit(float("-inf"))).otherwise(F.col("value")))
    return ev.select("event_id", v.alias("value"))


def r10_nan_to_num(spark, sf_dir):
    return round_doubles(C.nan_to_num_cols(_with_non_finite(spark, sf_dir), ["value"]))


def r12_one_hot(spark, sf_dir):
    ehr = fx.ehr(spark, sf_dir).select(KEY, "CVD_Presence")
    return C.one_hot(ehr, "CVD_Presence")


def r13_dummy_time(spark, sf_dir):
    ev = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias(KEY), "event_id", "value")
    return round_doubles(C.dummy_time(ev, ["event_id"], chunk_width=1000))


def r14_last_k_sequence(spark, sf_dir):
    seq = C.last_k_sequence(fx.wearables(spark, sf_dir, inject_nulls=False), 5)
    rows = seq.select(KEY, F.posexplode("sequence").alias("position", "r"))
    return round_doubles(rows.select(KEY, "position", F.unix_micros(F.col("r.time").cast("timestamp")).alias("time_micros"),
                                     F.col("r.value").alias("value")))


def r16_standardize(spark, sf_dir):
    img = fx.imaging(spark, sf_dir)
    return round_doubles(C.standardize(img, [c for c in img.columns if c != KEY]))


def r17_r19_decisions(spark, sf_dir):
    s = fx.score_table(spark, sf_dir)
    pc = C.class_from_prob("p")
    return round_doubles(s.select("order_key", "line", "p", pc.alias("pred_class"),
                                  C.argmax_class(F.array(1 - F.col("p"), F.col("p"))).alias("pred_argmax"),
                                  C.label_text(pc).alias("label_text")))


def j1_merge_modalities(spark, sf_dir):
    return round_doubles(J.merge_modalities(fx.modalities(spark, sf_dir)))


def j2_patient_feature_matrix(spark, sf_dir):
    return round_doubles(patient_feature_matrix(spark, sf_dir))


def j3_wide_concat(spark, sf_dir):
    m = fx.modalities(spark, sf_dir)
    return round_doubles(J.wide_concat([m["ehr"], C.add_prefix(m["imaging"], "imaging"),
                                        C.add_prefix(m["genomic"], "genomic")]))


def j5_unmatched_keys(spark, sf_dir):
    return J.unmatched_keys(fx.modalities(spark, sf_dir))


TABLE_QUERIES = [p1_missingness, p2_missingness_patterns, r2_impute_ehr, r2_impute_wearables, r8_r9_coerce_fill,
                 r10_nan_to_num, r12_one_hot, r13_dummy_time, r14_last_k_sequence, r16_standardize,
                 r17_r19_decisions, j1_merge_modalities, j2_patient_feature_matrix, j3_wide_concat,
                 j5_unmatched_keys]


# ----------------------------------------------------------------------------- M1-M2, E1-E14
from medfuse.operators import metrics as Mx  # noqa: E402
from medfuse.operators import split as Sp  # noqa: E402


def m1_m2_split_assignment(spark, sf_dir):
    keys = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(KEY))
    return Sp.assign_split(keys, test_size=0.2, validation_size=0.2, seed=42)


def m1_exact_stratified_split(spark, sf_dir):
    keys = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(KEY), F.col("c_mktsegment").alias("segment"))
    return Sp.exact_split(keys, test_size=0.2, strata=["segment"])


def m1_exact_split(spark, sf_dir):
    return Sp.exact_split(fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(KEY)), test_size=0.15, seed=7)


def r4_r7_r11_columns(spark, sf_dir):
    """Key restored from an index column, columns dropped, a default column, numeric feature columns picked."""
    indexed = fx.ehr(spark, sf_dir).withColumnRenamed(KEY, "index")
    df = C.drop_strict(C.drop_lenient(C.restore_key(indexed), ["Time_To_Event", "absent"]), ["CVD_Presence"])
    numeric, others = C.feature_columns(C.ensure_column(C.ensure_column(df, "Time_To_Event"), "severity", 1.5))
    kept = C.ensure_column(C.ensure_column(df, "Time_To_Event"), "severity", 1.5).select(KEY, *numeric, "Time_To_Event")
    return round_doubles(kept.withColumn("left_out", F.lit(",".join(others))))


def _scored(spark, sf_dir):
    s = fx.score_table(spark, sf_dir)
    return s.withColumn("pred_class", C.class_from_prob("p"))


def e1_e4_classification_metrics(spark, sf_dir):
    return round_doubles(Mx.classification_metrics(_scored(spark, sf_dir)))


def e5_roc_auc(spark, sf_dir):
    return round_doubles(Mx.roc_auc(_scored(spark, sf_dir)))


def e6_macro_auc(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("probs", F.array(1 - F.col("p"), F.col("p")))
    return round_doubles(Mx.macro_auc(s, "label", "probs", 2))


def e7_e11_regression_metrics(spark, sf_dir):
    return round_doubles(Mx.regression_metrics(_scored(spark, sf_dir)))


def e12_losses(spark, sf_dir):
    return round_doubles(Mx.losses(_scored(spark, sf_dir)))


def e13_evaluate(spark, sf_dir):
    return round_doubles(Mx.evaluate(_scored(spark, sf_dir), "label", "p", y="y", y_hat="y_hat"))


def e14_confusion_counts(spark, sf_dir):
    return Mx.confusion_counts(_scored(spark, sf_dir))


METRIC_QUERIES = [m1_m2_split_assignment, m1_exact_stratified_split, m1_exact_split, r4_r7_r11_columns, e1_e4_classification_metrics, e5_roc_auc, e6_macro_auc,
                  e7_e11_regression_metrics, e12_losses, e13_evaluate, e14_confusion_counts]


# ----------------------------------------------------------------------------- M3-M7, AB1, X1-X3, S5, S10
from medfuse.operators import explain as X  # noqa: E402
from medfuse.operators import rounds as RD  # noqa: E402
from medfuse.operators.models import declared_model, feature_names, predict  # noqa: E402
from medfuse.plans import training as TR  # noqa: E402
from medfuse.session import materialize, scratch_path  # noqa: E402
from medfuse.sources import model_store as MS  # noqa: E402

PRED_COLS = [KEY, "p_class1", "pred_class", "pred_time"]
FIXED_WEIGHTS = [(-1) ** i / (i + 1) for i in range(fx.ORACLE_IMAGING_DIMS)]   # declared attribution weights
FIXED_INTERCEPT = 0.1


def _prep(spark, sf_dir, **kw):
    return TR.prepare(spark, fx.modalities(spark, sf_dir), **kw)


def m3_baseline_metrics(spark, sf_dir):
    return round_doubles(TR.train_baseline(_prep(spark, sf_dir)).metrics)


def m3_mlp_baseline_metrics(spark, sf_dir):
    return round_doubles(TR.train_baseline(_prep(spark, sf_dir), classifier="mlp").metrics)


def m4_m7_multimodal_metrics(spark, sf_dir):
    return round_doubles(TR.train_multimodal(_prep(spark, sf_dir), fusion=False).metrics)


def m5_fusion_metrics(spark, sf_dir):
    return round_doubles(TR.train_multimodal(_prep(spark, sf_dir), scope="fusion").metrics)


def m6_gbt_early_stopping_metrics(spark, sf_dir):
    prep = _prep(spark, sf_dir, validation_size=0.2)
    return round_doubles(TR.train_multimodal(prep, classifier="gbt", regressor="gbt", scope="gbt").metrics)


def m7_test_predictions(spark, sf_dir):
    return round_doubles(TR.train_multimodal(_prep(spark, sf_dir)).predictions.select(*PRED_COLS))


def ab1_ablation_metrics(spark, sf_dir):
    return round_doubles(TR.ablation_study(_prep(spark, sf_dir)))


def _attribution(spark, sf_dir):
    prep = _prep(spark, sf_dir)
    tr = TR.train_multimodal(prep, fusion=False)
    contrib, base = X.model_attribution(tr.model, tr.predictions, tr.background,
                                        feature_names(tr.columns))
    return contrib, base


def x1_model_attribution(spark, sf_dir):
    return round_doubles(_attribution(spark, sf_dir)[0])


def x2_global_importance(spark, sf_dir):
    return round_doubles(X.global_importance(_attribution(spark, sf_dir)[0]))


def x3_model_breakdown(spark, sf_dir):
    contrib, base = _attribution(spark, sf_dir)
    return round_doubles(X.breakdown(contrib, base))


ROUND_FEATURES = ("acctbal", "nationkey", *[f"g{i + 1}" for i in range(len(fx.PRIORITIES))], "w_mean", "w_std", "w_min", "w_max",
                  *[f"e{i}" for i in range(3)])
ROUND_SETTINGS = RD.RoundSettings(rounds=100, patience=10, step=0.05, momentum="none")      # plain steps: the same path in any engine


def _round_rows(spark, sf_dir):
    """EHR, genomic and some imaging columns and order-free wearables statistics of every labelled patient, with the three-way split."""
    mods = fx.modalities(spark, sf_dir)
    w = mods["wearables"].groupBy(KEY).agg(F.avg("value").alias("w_mean"), F.stddev_pop("value").alias("w_std"),
                                           F.min("value").alias("w_min"), F.max("value").alias("w_max"))
    rows = mods["ehr"].join(mods["genomic"], KEY).join(mods["imaging"].select(KEY, *[f"e{i}" for i in range(3)]), KEY).join(w, KEY).where("CVD_Presence IS NOT NULL AND Time_To_Event IS NOT NULL")
    return materialize(Sp.assign_split(rows, KEY, 0.2, 0.2))


def _rounds(spark, sf_dir):
    rows = _round_rows(spark, sf_dir)
    return rows, RD.fit_rounds(rows, ROUND_FEATURES, ROUND_SETTINGS)


def m6_early_stopping_path(spark, sf_dir):
    return round_doubles(RD.loss_path(spark, _rounds(spark, sf_dir)[1]))


def m6_round_coefficients(spark, sf_dir):
    return round_doubles(RD.coefficients(spark, _rounds(spark, sf_dir)[1]))


def m6_restored_predictions(spark, sf_dir):
    rows, model = _rounds(spark, sf_dir)
    return round_doubles(RD.predict_rounds(model, rows.where("split = 'test'")).select(*PRED_COLS))


def m6_restored_metrics(spark, sf_dir):
    rows, model = _rounds(spark, sf_dir)
    return round_doubles(TR.evaluate_predictions(RD.predict_rounds(model, rows.where("split = 'test'")), "rounds"))


ABLATION_SETTINGS = RD.RoundSettings(rounds=20, patience=10, step=0.05, momentum="none")
ROUND_MODALITIES = {"ehr": ["acctbal", "nationkey"], "imaging": ["e0", "e1", "e2"], "wearables": ["w_mean", "w_std", "w_min", "w_max"],
                    "genomic": [f"g{i + 1}" for i in range(len(fx.PRIORITIES))]}


def m3_baseline_rounds(spark, sf_dir):
    return round_doubles(TR.ablation_rounds(_round_rows(spark, sf_dir), {"baseline_ehr": ROUND_MODALITIES["ehr"]}, ABLATION_SETTINGS))


def ab1_ablation_rounds(spark, sf_dir):
    scopes = {name: J.leave_one_out(ROUND_MODALITIES, drop) for name, drop in
              [("All", None), *[(f"No {m.capitalize()}", m) for m in ROUND_MODALITIES]]}
    return round_doubles(TR.ablation_rounds(_round_rows(spark, sf_dir), scopes, ABLATION_SETTINGS))


STACK_FOLDS, STACK_FIRST = 3, RD.RoundSettings(rounds=8, patience=8, step=0.05, momentum="none")
STACK_SECOND = RD.RoundSettings(rounds=20, patience=10, step=0.05, momentum="none")


def _stacked(spark, sf_dir):
    from medfuse.operators.stacking import fit_stacked
    rows = _round_rows(spark, sf_dir)
    return rows, fit_stacked(rows, ROUND_MODALITIES, STACK_FIRST, STACK_SECOND, STACK_FOLDS)


def m5_stacked_out_of_fold(spark, sf_dir):
    return round_doubles(_stacked(spark, sf_dir)[1].out_of_fold.drop("CVD_Presence", "Time_To_Event"))


def m5_stacked_metrics(spark, sf_dir):
    from medfuse.operators.stacking import predict_stacked
    rows, model = _stacked(spark, sf_dir)
    return round_doubles(TR.evaluate_predictions(predict_stacked(model, rows.where("split = 'test'")), "stacked"))


# declared coefficients of a two-headed model on raw columns, for every path that a fitted model takes
DECLARED_CLASS = {"acctbal": 5e-5, "nationkey": 0.02, "imaging_e0": 1.5, "imaging_e3": -2.0, "value__mean": 0.4, "value__maximum": 0.002, "genomic_g1": 0.1}
DECLARED_TIME = {"acctbal": -1e-4, "imaging_e1": 4.0, "value__minimum": 0.3, "genomic_g5": -0.5}
DECLARED_INTERCEPTS = (-20.5, 12.0)
DECLARED_COLUMNS = {"ehr": ["acctbal", "nationkey"], "imaging": ["imaging_e0", "imaging_e1", "imaging_e3"],
                    "wearables": ["value__mean", "value__maximum", "value__minimum"], "genomic": ["genomic_g1", "genomic_g5"]}


def _declared(spark, sf_dir):
    """Prepared data, and the declared model after a way through the model store."""
    model = declared_model(DECLARED_CLASS, DECLARED_INTERCEPTS[0], DECLARED_TIME, DECLARED_INTERCEPTS[1])
    path = MS.save_model(model, scratch_path(spark, f"model-{uuid.uuid4().hex}"))
    return _prep(spark, sf_dir, settings=FeatureSettings().only("F1")), MS.load_model(path)


def s5_m7_declared_predictions(spark, sf_dir):
    prep, model = _declared(spark, sf_dir)
    return round_doubles(predict(model, prep.test).select(*PRED_COLS))


def s10_declared_report(spark, sf_dir):
    prep, model = _declared(spark, sf_dir)
    report = TR.training_report(TR.evaluate_predictions(predict(model, prep.test), "declared"),
                                TR.evaluate_predictions(predict(model, prep.train), "declared_train", False))
    return round_doubles(spark.read.parquet(MS.write_report(report, scratch_path(spark, f"report-{uuid.uuid4().hex}"))))


def s6_s8_m8_declared_scoring(spark, sf_dir):
    prep, model = _declared(spark, sf_dir)
    recs = SC.records_from_modalities(fx.modalities(spark, sf_dir))
    return round_doubles(SC.score_records(recs, model, DECLARED_COLUMNS, prep.layout, prep.stored, prep.fills)[0])


def m9_declared_stream_scoring(spark, sf_dir):
    prep, model = _declared(spark, sf_dir)
    base = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    SC.records_from_modalities(fx.modalities(spark, sf_dir)).repartition(3).write.text(f"{base}/source")
    SS.start_scoring_stream(spark, f"{base}/source", f"{base}/sink", f"{base}/checkpoint", model, DECLARED_COLUMNS, prep.layout,
                            prep.stored, prep.fills, max_files_per_trigger=1).awaitTermination()
    return round_doubles(spark.read.parquet(f"{base}/sink/results").drop("batch_id"))


def _fixed_contrib(spark, sf_dir):
    img = fx.imaging(spark, sf_dir)
    cols = [c for c in img.columns if c != KEY]
    row = img.agg(*[F.avg(c).alias(c) for c in cols]).first()
    means = [row[c] for c in cols]
    base = FIXED_INTERCEPT + sum(w * m for w, m in zip(FIXED_WEIGHTS, means))
    return X.linear_attribution(img, cols, FIXED_WEIGHTS, means), base


def x1_linear_attribution_fixed(spark, sf_dir):
    return round_doubles(_fixed_contrib(spark, sf_dir)[0])


def x3_breakdown_fixed(spark, sf_dir):
    contrib, base = _fixed_contrib(spark, sf_dir)
    return round_doubles(X.breakdown(contrib, base))


def _labelled_imaging(spark, sf_dir):
    return fx.imaging(spark, sf_dir).join(fx.ehr(spark, sf_dir).where("CVD_Presence IS NOT NULL").select(KEY, "CVD_Presence"), KEY)


def x2_permutation_importance_fixed(spark, sf_dir):
    df = _labelled_imaging(spark, sf_dir)
    cols = [c for c in df.columns if c not in (KEY, "CVD_Presence")]
    margin = " + ".join(f"({w!r}D * {c})" for w, c in zip(FIXED_WEIGHTS, cols)) + f" + {FIXED_INTERCEPT!r}D"
    return round_doubles(X.permutation_importance(df, cols, lambda d: d.withColumn("p_class1", F.expr(f"1 / (1 + exp(-({margin})))"))))


# a declared forest over the imaging elements: (tree, weight, node, feature, threshold, left, right, value, rows)
FIXED_NODES = [
    (0, 1.0, 0, 0, 0.0, 1, 2, 0.1, 100.0), (0, 1.0, 1, 1, 0.05, 3, 4, -0.4, 40.0), (0, 1.0, 2, 0, 0.1, 5, 6, 0.5, 60.0),
    (0, 1.0, 3, -1, None, -1, -1, -1.0, 10.0), (0, 1.0, 4, 2, -0.02, 7, 8, 0.2, 30.0), (0, 1.0, 5, -1, None, -1, -1, 0.25, 45.0),
    (0, 1.0, 6, -1, None, -1, -1, 2.0, 15.0), (0, 1.0, 7, -1, None, -1, -1, 1.5, 12.0), (0, 1.0, 8, -1, None, -1, -1, -0.75, 18.0),
    (1, 0.1, 0, 3, 0.02, 1, 2, 0.0, 80.0), (1, 0.1, 1, -1, None, -1, -1, 3.0, 20.0), (1, 0.1, 2, 1, -0.03, 3, 4, 0.0, 60.0),
    (1, 0.1, 3, -1, None, -1, -1, -2.0, 24.0), (1, 0.1, 4, -1, None, -1, -1, 1.0, 36.0), (2, 0.1, 0, -1, None, -1, -1, 0.7, 80.0)]


def x1_tree_attribution_fixed(spark, sf_dir):
    img = fx.imaging(spark, sf_dir)
    cols = [c for c in img.columns if c != KEY]
    nodes = spark.createDataFrame([(t, w, n, f, thr, None, l, r, v, c) for t, w, n, f, thr, l, r, v, c in FIXED_NODES], X.NODE_SCHEMA)
    contrib, base = X.tree_attribution(img, F.array(*[F.col(c) for c in cols]), nodes, cols)
    return round_doubles(contrib.withColumn("base_value", F.lit(base)))


def s5_model_roundtrip(spark, sf_dir):
    prep = _prep(spark, sf_dir)
    tr = TR.train_multimodal(prep)
    path = MS.save_model(tr.model, scratch_path(spark, f"model-{uuid.uuid4().hex}"))
    return round_doubles(predict(MS.load_model(path), prep.test).select(*PRED_COLS))


def s10_training_report(spark, sf_dir):
    prep = _prep(spark, sf_dir)
    report = TR.training_report(TR.train_multimodal(prep).metrics, TR.train_baseline(prep).metrics)
    path = MS.write_report(report, scratch_path(spark, f"report-{uuid.uuid4().hex}"))
    return round_doubles(spark.read.parquet(path))


MODEL_QUERIES = [m3_baseline_metrics, m3_mlp_baseline_metrics, m4_m7_multimodal_metrics, m5_fusion_metrics, m6_gbt_early_stopping_metrics,
                 m6_early_stopping_path, m6_round_coefficients, m6_restored_predictions, m6_restored_metrics,
                 m3_baseline_rounds, ab1_ablation_rounds, s5_m7_declared_predictions, s10_declared_report, s6_s8_m8_declared_scoring,
                 m9_declared_stream_scoring,
                 m7_test_predictions, ab1_ablation_metrics, x1_model_attribution, x2_global_importance,
                 x3_model_breakdown, x1_linear_attribution_fixed, x1_tree_attribution_fixed, x2_permutation_importance_fixed, x3_breakdown_fixed, s5_model_roundtrip,
                 s10_training_report]


# ----------------------------------------------------------------------------- S6-S8, M8-M10
from medfuse.plans import scoring as SC  # noqa: E402
from medfuse.sources import records as RC  # noqa: E402
from medfuse.streaming import scoring_stream as SS  # noqa: E402
from medfuse.streaming import series_state as SST  # noqa: E402
from medfuse.streaming import window_features as WF  # noqa: E402


def _scoring_setup(spark, sf_dir):
    prep = _prep(spark, sf_dir)
    tr = TR.train_multimodal(prep)
    return prep, tr, SC.records_from_modalities(fx.modalities(spark, sf_dir))


def s6_s8_m8_batch_scoring(spark, sf_dir):
    prep, tr, recs = _scoring_setup(spark, sf_dir)
    results, _ = SC.score_records(recs, tr.model, tr.columns, prep.layout, prep.stored, prep.fills)
    return round_doubles(results)


def s7_quarantine(spark, sf_dir):
    recs = SC.records_from_modalities(fx.modalities(spark, sf_dir), corrupt_every=5)
    _, quarantine = RC.validate(RC.parse_records(recs))
    return quarantine.select(KEY, "errors")


def m9_stream_scoring(spark, sf_dir):
    prep, tr, recs = _scoring_setup(spark, sf_dir)
    base = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    recs.write.mode("overwrite").text(f"{base}/source")
    q = SS.start_scoring_stream(spark, f"{base}/source", f"{base}/sink", f"{base}/checkpoint", tr.model, tr.columns,
                                prep.layout, prep.stored, prep.fills)
    q.awaitTermination()
    return round_doubles(spark.read.parquet(f"{base}/sink/results").drop("batch_id"))


def m10_windowed_stream_features(spark, sf_dir):
    schema = fx.table(spark, sf_dir, "events").schema
    src = WF.reading_stream(spark, f"{sf_dir.rstrip('/')}/events.parq*", schema)
    readings = src.select(F.col("user_id").alias(KEY), F.col("ts").alias("time"), "value")
    base = scratch_path(spark, f"windows-{uuid.uuid4().hex}")
    q = WF.run_to_sink(WF.windowed_features(readings), f"{base}/sink", f"{base}/checkpoint")
    q.awaitTermination()
    stored = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias(KEY), F.col("ts").alias("time"), "value")
    return round_doubles(WF.completed(spark, stored, f"{base}/sink"))


def m10_stream_series_features(spark, sf_dir):
    """Readings in six files, one micro-batch each; one reading in seven arrives a file late, so patients are opened again."""
    ev = fx.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias(KEY), F.col("ts").alias("time"), "value")
    span = ev.agg(F.min(F.unix_micros(F.col("time").cast("timestamp"))).alias("a"), F.max(F.unix_micros(F.col("time").cast("timestamp"))).alias("z")).first()
    slot = F.least(F.lit(4), F.floor((F.unix_micros(F.col("time").cast("timestamp")) - span["a"]) * 5 / max(1, span["z"] - span["a"])))
    base = scratch_path(spark, f"series-{uuid.uuid4().hex}")
    arrived = ev.withColumn("arrived", slot.cast("int") + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0))
    arrived.repartition("arrived").write.partitionBy("arrived").parquet(f"{base}/source")
    src = WF.reading_stream(spark, f"{base}/source/*", arrived.drop("arrived").schema, max_files_per_trigger=1)
    SST.start_series_stream(src, f"{base}/tables", f"{base}/checkpoint").awaitTermination()
    return round_doubles(SST.features(SST.current_state(spark, f"{base}/tables")))


SCORING_QUERIES = [s6_s8_m8_batch_scoring, s7_quarantine, m9_stream_scoring, m10_windowed_stream_features, m10_stream_series_features]


def f_all_features(spark, sf_dir):
    """Every feature group in one extraction (the reference's single feature call)."""
    w = fx.wearables(spark, sf_dir, inject_nulls=False)
    return round_doubles(extract_features(w, "Patient_ID", "time"))


def _spectrum(df, kind, key=KEY, **kw):
    from medfuse.functions.spectrum import spectrum_features
    return round_doubles(spectrum_features(df, key, "time", kinds=[kind], **kw).drop("signal"))


def f22_fft_aggregated(spark, sf_dir):
    return _spectrum(fx.wearables(spark, sf_dir, inject_nulls=False), "fft_aggregated")


def f22_fourier_entropy(spark, sf_dir):
    return _spectrum(fx.wearables(spark, sf_dir, inject_nulls=False), "fourier_entropy")


def _by_event_type(spark, sf_dir):
    """One long series for each type of event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("event_type").alias("series"), F.col("ts").alias("time"), F.col("value"))


def f22_fft_aggregated_long(spark, sf_dir):
    """Long series by the staged transform (``block`` is small, so that it is taken at every table size)."""
    return _spectrum(_by_event_type(spark, sf_dir), "fft_aggregated", "series", block=64)


def f22_fourier_entropy_long(spark, sf_dir):
    return _spectrum(_by_event_type(spark, sf_dir), "fourier_entropy", "series")


SPECTRUM_QUERIES = [f22_fft_aggregated, f22_fourier_entropy, f22_fft_aggregated_long, f22_fourier_entropy_long]


def s2_csv_scan(spark, sf_dir):
    """The EHR modality written as CSV by Spark, read back with a schema (no inference)."""
    from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

    from medfuse.sources.loaders import CORRUPT_COL, load_table
    path = scratch_path(spark, f"s2_ehr_csv_{uuid.uuid4().hex}")
    (fx.ehr(spark, sf_dir).select(KEY, "acctbal", "nationkey", "mktsegment")
       .write.mode("overwrite").option("header", True).csv(path))
    schema = StructType([StructField(KEY, LongType()), StructField("acctbal", DoubleType()),
                         StructField("nationkey", LongType()), StructField("mktsegment", StringType())])
    back = load_table(spark, path, schema, fmt="csv", keep_corrupt=True)
    return round_doubles(back.select(KEY, "acctbal", "nationkey", "mktsegment",
                                     F.col(CORRUPT_COL).isNotNull().alias("corrupt")))


def s4_matrix_from_csv(spark, sf_dir):
    """The four modalities as CSV files with schemas, loaded and joined into the same matrix as J2."""
    from medfuse.plans.features import build_feature_matrix
    from medfuse.sources.loaders import load_modalities
    base = scratch_path(spark, f"s4_csv_{uuid.uuid4().hex}")
    mods = fx.modalities(spark, sf_dir)
    for name, df in mods.items():
        if name == "wearables":
            df = df.withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        df.write.option("header", True).csv(f"{base}/{name}.csv")
    loaded = load_modalities(spark, {n: f"{base}/{n}.csv" for n in mods}, {n: df.schema for n, df in mods.items()})
    return round_doubles(build_feature_matrix(loaded))


def queries() -> dict[str, Query]:
    out = {name: _feature_query(g) for g, name in FEATURE_QUERIES.items()}
    out |= {f.__name__: f for f in [*TABLE_QUERIES, *METRIC_QUERIES, *MODEL_QUERIES, *SCORING_QUERIES, *SPECTRUM_QUERIES, m5_stacked_out_of_fold, m5_stacked_metrics, f_all_features, s2_csv_scan, s4_matrix_from_csv]}
    return out
