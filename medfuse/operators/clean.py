"""Projection, cleaning, encoding and decision helpers.

Fitted values (means, standard deviations, one-hot width) come from one
aggregate over the fitting rows and reach the driver as a single small row;
applying them is a plain projection (constant-folded, codegen'd).
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from medfuse.functions import series as S
from medfuse.functions.exprs import argmax_index, nan_to_null, nan_to_num
from medfuse.sources.fixtures import KEY, LABEL_COLS

log = logging.getLogger(__name__)


# R1 -----------------------------------------------------------------------------------------------
def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in ex]


def non_numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, NumericType) and f.name not in ex]


def _clean(df: DataFrame, c: str) -> Column:
    x = F.col(c)
    if isinstance(df.schema[c].dataType, (DoubleType, FloatType)):
        x = nan_to_null(x)
    return x.cast("double")


# R2 -----------------------------------------------------------------------------------------------
def fit_means(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Column means over non-missing values (NaN counts as missing), one aggregate."""
    if not cols:
        return {}
    row = df.agg(*[F.avg(_clean(df, c)).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def apply_means(df: DataFrame, means: dict[str, float | None]) -> DataFrame:
    """Fill missing with the fitted mean; an all-missing column stays NULL."""
    repl = {c: (F.coalesce(_clean(df, c), F.lit(m).cast("double")) if m is not None else _clean(df, c))
            for c, m in means.items()}
    return df.withColumns(repl) if repl else df


def impute_mean(df: DataFrame, cols: Sequence[str] | None = None, fit_df: DataFrame | None = None,
                exclude: Iterable[str] = (KEY, *LABEL_COLS)) -> DataFrame:
    """R2: mean-impute numeric columns (key and labels excluded); others untouched.

    ``fit_df`` (default ``df``) is where the means are learned, e.g. the train split.
    Imputed columns become DOUBLE (integer means are not truncated).
    """
    cols = list(cols) if cols is not None else numeric_columns(df, exclude)
    return apply_means(df, fit_means(fit_df if fit_df is not None else df, cols))


# R3 / R4 ------------------------------------------------------------------------------------------
def add_prefix(df: DataFrame, prefix: str, key: str = KEY) -> DataFrame:
    """``<prefix>_<column>`` for every non-key column."""
    return df.select(*[F.col(c) if c == key else F.col(f"`{c}`").alias(f"{prefix}_{c}") for c in df.columns])


def restore_key(df: DataFrame, key: str = KEY, index_col: str = "index") -> DataFrame:
    """Make sure the key is a column named ``key`` (renaming an index column)."""
    if key in df.columns:
        return df
    if index_col in df.columns:
        return df.withColumnRenamed(index_col, key)
    raise ValueError(f"neither {key!r} nor {index_col!r} present")


# R5 / R6 / R7 -------------------------------------------------------------------------------------
def ensure_column(df: DataFrame, name: str, default: float = 0.0) -> DataFrame:
    """Add a constant column when absent (with a warning)."""
    if name in df.columns:
        return df
    log.warning("column %r not found; assigning default value %r", name, default)
    return df.withColumn(name, F.lit(default).cast("double"))


def drop_lenient(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop columns, ignoring the absent ones."""
    return df.drop(*[c for c in cols if c in df.columns])


def drop_strict(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop columns; every one must exist."""
    cols = list(cols)
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return df.drop(*cols)


# R8 / R9 / R10 ------------------------------------------------------------------------------------
def coerce_numeric(df: DataFrame, cols: Sequence[str] | None = None, exclude: Iterable[str] = (KEY,)) -> DataFrame:
    """Every column to DOUBLE, unparsable values to NULL (``try_cast``)."""
    ex = set(exclude)
    cols = [c for c in (cols or df.columns) if c not in ex]
    return df.withColumns({c: F.col(f"`{c}`").cast("string").try_cast("double")
                           if not isinstance(df.schema[c].dataType, NumericType)
                           else F.col(f"`{c}`").cast("double") for c in cols})


def fill_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing numeric values (NULL and NaN) -> 0; by default not in the key and the labels."""
    cols = cols or numeric_columns(df, (KEY, *LABEL_COLS))
    return df.withColumns({c: F.coalesce(nan_to_null(F.col(f"`{c}`")) if isinstance(
        df.schema[c].dataType, (DoubleType, FloatType)) else F.col(f"`{c}`"), F.lit(0)) for c in cols})


def nan_to_num_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NaN -> 0 and +-inf -> +-largest double on the given columns."""
    return df.withColumns({c: nan_to_num(F.col(f"`{c}`")) for c in cols})


# R11 ----------------------------------------------------------------------------------------------
def feature_columns(df: DataFrame, exclude: Iterable[str] = (KEY, *LABEL_COLS)) -> tuple[list[str], list[str]]:
    """(numeric feature columns, left-out non-numeric columns)."""
    return numeric_columns(df, exclude), non_numeric_columns(df, exclude)


# R12 ----------------------------------------------------------------------------------------------
def one_hot(df: DataFrame, col: str, width: int | None = None, out: str | None = None) -> DataFrame:
    """Class index -> one-hot array<double> of width max(class)+1 (or ``width``)."""
    if width is None:
        width = int(df.agg(F.max(col)).first()[0]) + 1
    c = F.col(col)
    return df.withColumn(out or f"{col}_onehot",
                         F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                                     lambda i: F.when(i == c, F.lit(1.0)).otherwise(F.lit(0.0))))


# R13 / R14 ----------------------------------------------------------------------------------------
def dummy_time(df: DataFrame, order_cols: Sequence[str], key: str = KEY, out: str = "time",
               chunk_width: float | None = None) -> DataFrame:
    """``time`` = 1..n per patient in the stated order (skew-safe rank)."""
    if out in df.columns:
        return df
    ranked = S.rank_series(df, [key], list(order_cols), chunk_width)
    return ranked.withColumn(out, F.col(S.RN)).drop(S.RN, S.N, S.CHUNK)


def last_k_sequence(df: DataFrame, k: int, key: str = KEY, time: str = "time", value: str = "value",
                    chunk_width: float | None = None) -> DataFrame:
    """The last ``k`` readings per patient as array<struct<time, value>> in time order.

    Rank first (skew-safe), keep only the k tail rows, then collect: each
    collected list holds at most k elements.
    """
    clean = df.where(F.col(value).isNotNull())
    ranked = S.rank_series(clean, [key], [time, value], chunk_width)
    tail = ranked.where(F.col(S.RN) > F.col(S.N) - k)
    return tail.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(S.RN).alias("rn"), F.col(time).alias("time"),
                                                         F.col(value).cast("double").alias("value")))),
                    lambda s: F.struct(s["time"].alias("time"), s["value"].alias("value"))).alias("sequence"))


# R16 ----------------------------------------------------------------------------------------------
def fit_scaler(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """Mean and population standard deviation per column, one aggregate."""
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        x = _clean(df, c)
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def apply_scaler(df: DataFrame, params: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """(x - mean) / std; a zero-variance column becomes 0.0 (sklearn convention)."""
    out = {}
    for c, (m, s) in params.items():
        x = _clean(df, c)
        if m is None:
            out[c] = x
        elif not s:
            out[c] = F.when(x.isNotNull(), F.lit(0.0))
        else:
            out[c] = (x - F.lit(m)) / F.lit(s)
    return df.withColumns(out) if out else df


def standardize(df: DataFrame, cols: Sequence[str], fit_df: DataFrame | None = None) -> DataFrame:
    """Standardise with population std fitted on ``fit_df`` (default ``df``)."""
    return apply_scaler(df, fit_scaler(fit_df if fit_df is not None else df, list(cols)))


# R17 / R18 / R19 ----------------------------------------------------------------------------------
def class_from_prob(p, threshold: float = 0.5) -> Column:
    """1 when the probability is strictly above the threshold."""
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p > threshold, F.lit(1)).otherwise(F.lit(0))


def argmax_class(arr) -> Column:
    """class = index of the largest probability, ties to the lowest index."""
    return argmax_index(arr)


def label_text(pred, positive: str = "Positive", negative: str = "Negative") -> Column:
    """1 -> 'Positive', otherwise 'Negative'."""
    pred = F.col(pred) if isinstance(pred, str) else pred
    return F.when(pred == 1, F.lit(positive)).otherwise(F.lit(negative))
