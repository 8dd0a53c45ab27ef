"""Training job: feature matrix -> split -> fit -> evaluate -> baseline -> ablation.

Actions happen only at: imputation means, the written matrix, model fits, and
metric rows.  The matrix is written once as parquet to the shared folder, so the
iterative fits (and the five ablation fits) read only their own columns of a
table instead of recomputing the feature plan, and survive executor loss.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medfuse.functions.exprs import finite_or_null, nan_to_null
from medfuse.functions.tsfeatures import FeatureSettings
from medfuse.operators import metrics as Mx
from medfuse.operators.clean import fit_means, numeric_columns
from medfuse.operators.joins import leave_one_out
from medfuse.operators.models import (CLASS_LABEL, REG_LABEL, build_pipeline, feature_names, fit_assembled,
                                      modality_layout, observed, predict)
from medfuse.operators.rounds import RoundSettings, fit_rounds, predict_rounds
from medfuse.operators.split import assign_split, is_test
from medfuse.plans.features import ALL_FEATURES, build_feature_matrix
from medfuse.session import materialize
from medfuse.sources.fixtures import KEY, LABEL_COLS


@dataclass
class Prepared:
    matrix: DataFrame          # written to the shared folder, with ``split``
    train: DataFrame
    test: DataFrame
    columns: dict[str, list[str]]      # feature columns of the models, by modality
    layout: dict[str, list[str]]       # all matrix columns of each modality, in its own order
    fills: dict[str, float | None]     # imputation means of the EHR, imaging and genomic columns
    non_finite: dict[str, int]         # NaN and infinite feature values of the training rows, by column (those with any)

    @property
    def stored(self) -> DataFrame:
        """Wearables features of every known patient."""
        return self.matrix.select(KEY, *self.layout["wearables"])


@dataclass
class Trained:
    model: PipelineModel
    predictions: DataFrame
    metrics: DataFrame         # (scope, metric, value)
    columns: dict[str, list[str]]
    background: DataFrame      # the model's output for the train split


def prepare(spark: SparkSession, mods: dict[str, DataFrame], settings: FeatureSettings = ALL_FEATURES,
            test_size: float = 0.2, validation_size: float = 0.0, seed: int = 42,
            fit_scope: str = "train") -> Prepared:
    fit_filter = ~is_test(KEY, test_size, seed) if fit_scope == "train" else None
    matrix = build_feature_matrix(mods, settings, fit_filter).where(F.col(CLASS_LABEL).isNotNull())
    matrix = assign_split(matrix, KEY, test_size, validation_size, seed)
    matrix = materialize(matrix)
    layout = modality_layout(mods, matrix)
    features = [c for cs in layout.values() for c in cs]
    seen = observed(matrix.where(F.col("split") != "test"), features)
    # a value that is not finite is a missing one: it gets the training mean, which is 0 after scaling (R10); written
    # too, as the plan of every step of every fit holds what the matrix is made of
    matrix = materialize(finite_or_null(matrix, features))
    train, test = matrix.where(F.col("split") != "test"), matrix.where(F.col("split") == "test")
    cols = {m: [c for c in cs if seen[c][0] > 0] for m, cs in layout.items()}
    fills = {}
    for m in set(mods) - {"wearables"}:
        own = numeric_columns(mods[m], (KEY, *LABEL_COLS))
        means = fit_means(mods[m].where(fit_filter) if fit_filter is not None else mods[m], own)
        fills |= {c if m == "ehr" else f"{m}_{c}": v for c, v in means.items()}
    return Prepared(matrix, train, test, {m: cs for m, cs in cols.items() if cs}, layout, fills,
                    {c: bad for c, (_, bad) in seen.items() if bad})


def evaluate_predictions(pred: DataFrame, scope: str, with_regression: bool = True) -> DataFrame:
    reg = dict(y=REG_LABEL, y_hat="pred_time") if with_regression and "pred_time" in pred.columns else {}
    # scores are written first: each metric part would else plan (and run) the whole model over every feature column again
    # a time that is NaN is a missing one, which no regression metric counts
    cols = [nan_to_null(c).alias(c) if c == REG_LABEL else c for c in (CLASS_LABEL, "p_class1", *reg.values())]
    scores = materialize(pred.select(*cols))
    return Mx.evaluate(scores, CLASS_LABEL, "p_class1", **reg).select(F.lit(scope).alias("scope"), "metric", "value")


def train_multimodal(prep: Prepared, fusion: bool = True, classifier: str = "logistic",
                     regressor: str | None = "linear", scope: str = "multimodal") -> Trained:
    """M4-M7: fit both heads on the train split, score and evaluate the test split."""
    val = "is_validation" if classifier == "gbt" or regressor == "gbt" else None
    model, pred, background = _fit_and_score(prep, build_pipeline(prep.columns, fusion, classifier, regressor, validation_col=val))
    return Trained(model, pred, evaluate_predictions(pred, scope, regressor is not None), prep.columns, background)


def _fit_and_score(prep: Prepared, pipeline: Pipeline) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """(model, predictions of the test split, output for the train split), by one written table of key, labels and vectors."""
    rows = prep.matrix.withColumn("is_validation", F.col("split") == "validation")
    is_train = F.col("split") != "test"
    model, rest, vectors = fit_assembled(pipeline, rows, is_train, [KEY, *LABEL_COLS, "split", "is_validation"])
    return model, predict(rest, vectors.where(F.col("split") == "test")), rest.transform(vectors.where(is_train))


def train_baseline(prep: Prepared, modality: str = "ehr", classifier: str = "logistic") -> Trained:
    """M3: class head on one modality only."""
    cols = {modality: prep.columns.get(modality, [])}
    model, pred, background = _fit_and_score(prep, build_pipeline(cols, fusion=False, classifier=classifier, regressor=None))
    return Trained(model, pred, evaluate_predictions(pred, f"baseline_{modality}", False), cols, background)


def ablation_study(prep: Prepared, classifier: str = "logistic", regressor: str | None = "linear",
                   parallelism: int = 5) -> DataFrame:
    """AB1: refit with all modalities and with each one left out (J4); long metrics.

    The fits are independent, so they are submitted from ``parallelism`` driver
    threads (as Spark ML's tuning estimators do); each fit's jobs interleave on
    the cluster instead of queueing behind the previous fit.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    scopes = [("All", None)] + [(f"No {m.capitalize()}", m) for m in prep.columns]

    @inheritable_thread_target(prep.train.sparkSession)
    def one(scope):
        name, drop = scope
        left = set(leave_one_out(prep.columns, drop))
        cols = {m: cs for m, cs in prep.columns.items() if left.issuperset(cs)}
        _, pred, _ = _fit_and_score(prep, build_pipeline(cols, True, classifier, regressor))
        return evaluate_predictions(pred, name, regressor is not None)

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(scopes)))) as pool:
        parts = list(pool.map(one, scopes))
    return reduce(DataFrame.unionByName, parts)


def ablation_rounds(rows: DataFrame, scopes: dict[str, list[str]], settings: RoundSettings = RoundSettings()) -> DataFrame:
    """AB1 (and M3) with heads trained in rounds: one fit on the columns of each scope, test metrics, long table.

    The fits read one written table and run one after another, as each of their rounds already is one small job.
    """
    parts = [evaluate_predictions(predict_rounds(fit_rounds(rows, cols, settings), rows.where("split = 'test'")), scope) for scope, cols in scopes.items()]
    return reduce(DataFrame.unionByName, parts)


def training_report(*metric_tables: DataFrame) -> DataFrame:
    """One long table (scope, metric, value)."""
    return reduce(DataFrame.unionByName, metric_tables)


def run_training(spark: SparkSession, mods: dict[str, DataFrame], settings: FeatureSettings = ALL_FEATURES,
                 classifier: str = "logistic", regressor: str = "linear", ablation: bool = True):
    """The reference's ``train`` flow on four modality frames (``sources.loaders.load_modalities`` reads a user's own)."""
    prep = prepare(spark, mods, settings)
    main = train_multimodal(prep, classifier=classifier, regressor=regressor)
    base = train_baseline(prep)
    tables = [main.metrics, base.metrics]
    if ablation:
        tables.append(ablation_study(prep, classifier, regressor))
    return prep, main, training_report(*tables)


__all__ = ["prepare", "train_multimodal", "train_baseline", "ablation_study", "training_report", "run_training",
           "feature_names"]
