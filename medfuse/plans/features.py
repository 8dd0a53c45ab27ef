"""Slice 1: the patient feature matrix.

modalities (S4) -> mean imputation (R2, fitted on the fitting patients)
-> wearables time-series features (F) -> patient-grain inner joins (J1/J2,
prefixes R3) -> default Time_To_Event (R5).

The readings are aggregated to patient grain *before* the modality join, so
no fan-out reaches the join and every join input has one row per patient.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from medfuse.functions.exprs import finite_or_null
from medfuse.functions.tsfeatures import FeatureSettings, extract_features
from medfuse.operators.clean import add_prefix, ensure_column, impute_mean
from medfuse.operators.split import is_test
from medfuse.session import materialize
from medfuse.sources import fixtures as fx
from medfuse.sources.fixtures import KEY

ALL_FEATURES = FeatureSettings()       # every group; pass ``settings`` for fewer


def impute_modalities(mods: dict[str, DataFrame], fit_filter: Column | None = None) -> dict[str, DataFrame]:
    """R2 on every modality; means learned on rows matching ``fit_filter``."""
    return {name: impute_mean(df, fit_df=df.where(fit_filter) if fit_filter is not None else df)
            for name, df in mods.items()}


def build_feature_matrix(mods: dict[str, DataFrame], settings: FeatureSettings = ALL_FEATURES,
                         fit_filter: Column | None = None, time_col: str = "time") -> DataFrame:
    imp = impute_modalities(mods, fit_filter)
    ts = extract_features(imp["wearables"], KEY, time_col, settings=settings)
    # an infinite sample entropy (pairs of which none goes on) has no place in the matrix
    ts = finite_or_null(ts, [c for c in ts.columns if c.endswith("__sample_entropy")])
    ts = materialize(ts)    # the joins below plan on a table
    patient = (imp["ehr"]
               .join(add_prefix(imp["imaging"], "imaging"), KEY)
               .join(ts, KEY)
               .join(add_prefix(imp["genomic"], "genomic"), KEY))
    return ensure_column(patient, "Time_To_Event", 0.0)


def patient_feature_matrix(spark: SparkSession, sf_dir: str, settings: FeatureSettings = ALL_FEATURES,
                           fit_scope: str = "all", test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """``fit_scope='train'`` learns imputation means on train patients only (Q6)."""
    mods = fx.modalities(spark, sf_dir)
    fit_filter = ~is_test(KEY, test_size, seed) if fit_scope == "train" else None
    return build_feature_matrix(mods, settings, fit_filter)
