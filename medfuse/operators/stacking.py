"""M5, late fusion: one two-headed model per modality, and a second-level model on what they say.

The second level learns from out-of-fold values only: the training keys fall into folds by hash, and a key's values
come from heads that were fitted on the other folds.  Validation and test keys are scored by heads that were fitted on
all training keys; the validation keys decide when the second level stops and are not read before that.  The first-level
fits are independent and read only their own modality's columns of one table, so they are submitted from a few driver
threads; scoring them is a projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medfuse.operators.models import CLASS_LABEL, REG_LABEL
from medfuse.operators.rounds import RoundSettings, RoundsModel, fit_rounds, predict_rounds
from medfuse.operators.split import hash_bucket, threshold_hex
from medfuse.session import materialize
from medfuse.sources.fixtures import KEY

FOLD_SALT = ":fold"


@dataclass
class StackedModel:
    columns: dict[str, list[str]]
    heads: dict[str, RoundsModel]                       # by modality, from all training rows
    fold_heads: dict[tuple[str, int], RoundsModel]      # (modality, fold): from the rows of the other folds
    second: RoundsModel
    out_of_fold: DataFrame                              # (key, split, fold, labels, values of every modality)


def fold_of(key=KEY, folds: int = 3, seed: int = 42) -> Column:
    """0 .. folds - 1 by ranges of the key's hash; -1 for a NULL key, which is in no fold's own part."""
    h = hash_bucket(key, seed, FOLD_SALT)
    return F.coalesce(reduce(lambda a, b: a + b, [(h >= threshold_hex(i / folds)).cast("int") for i in range(1, folds)], F.lit(0)), F.lit(-1))


def value_columns(modalities: Sequence[str]) -> list[str]:
    return [f"{m}_{v}" for m in modalities for v in ("p_class1", "pred_time")]


def _say(df: DataFrame, heads: dict[str, RoundsModel], columns: dict[str, list[str]], keep: Sequence[str]) -> DataFrame:
    """``keep`` and the two values of every modality's head."""
    for m, head in heads.items():
        df = (predict_rounds(head, df).drop("pred_class").withColumnRenamed("p_class1", f"{m}_p_class1")
              .withColumnRenamed("pred_time", f"{m}_pred_time"))
    return df.select(*keep, *value_columns(list(heads)))


def fit_stacked(df: DataFrame, columns: dict[str, list[str]], first: RoundSettings = RoundSettings(), second: RoundSettings = RoundSettings(),
                folds: int = 3, key: str = KEY, split: str = "split", seed: int = 42, parallelism: int = 4) -> StackedModel:
    """Cross-fit the heads of ``columns`` (by modality) and fit the second level on their out-of-fold values.

    Rows of other splits than 'train' and 'validation' are not read.  Rows of one key share a fold.  Fewer than two folds,
    or folds of which one leaves no training row, raise.  Missing values count as the training mean.
    """
    if folds < 2:
        raise ValueError("out-of-fold values need two folds or more")
    rows = materialize(df.where(F.col(split).isin("train", "validation")).withColumn("fold", fold_of(key, folds, seed)))
    train = rows.where(F.col(split) == "train")

    @inheritable_thread_target(df.sparkSession)
    def one(job):
        m, fold = job
        return fit_rounds(train if fold is None else train.where(F.col("fold") != fold), columns[m], first, split)

    jobs = [(m, fold) for m in columns for fold in (None, *range(folds))]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        fitted = dict(zip(jobs, pool.map(one, jobs)))
    heads = {m: fitted[m, None] for m in columns}
    keep = [key, split, "fold", CLASS_LABEL, REG_LABEL]
    # a NULL key has no fold of its own: every fold's head has learned from it, so it teaches the second level nothing
    parts = [_say(train.where(F.col("fold") == f), {m: fitted[m, f] for m in columns}, columns, keep) for f in range(folds)]
    parts.append(_say(rows.where(F.col(split) == "validation"), heads, columns, keep))
    said = materialize(reduce(DataFrame.unionByName, parts))
    return StackedModel(columns, heads, {j: h for j, h in fitted.items() if j[1] is not None},
                        fit_rounds(said, value_columns(list(columns)), second, split), said)


def predict_stacked(model: StackedModel, df: DataFrame) -> DataFrame:
    """``df`` without its feature columns, with p_class1, pred_class and pred_time of the second level."""
    used = {c for cs in model.columns.values() for c in cs}
    keep = [c for c in df.columns if c not in used]
    return predict_rounds(model.second, _say(df, model.heads, model.columns, keep)).drop(*value_columns(list(model.columns)))
