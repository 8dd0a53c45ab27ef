"""Missingness profile as data (the reference draws it as a picture).

Both are a single pass: P1 one global aggregate, P2 one ``groupBy`` on the
pattern string (partial aggregation keeps the shuffle to one row per pattern
per task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def missing_flag(df: DataFrame, c: str) -> Column:
    x = F.col(f"`{c}`")
    if isinstance(df.schema[c].dataType, (DoubleType, FloatType)):
        return x.isNull() | F.isnan(x)
    return x.isNull()


def missingness(df: DataFrame) -> DataFrame:
    """Long (column, position, n, n_missing, rate); NULL and NaN count as missing."""
    cols = df.columns
    one = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(missing_flag(df, c)).alias(f"_m{i}") for i, c in enumerate(cols)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"),
                                        F.col(f"_m{i}").alias("n_missing")) for i, c in enumerate(cols)]))
    return (one.select(F.col("_n").alias("n"), rows.alias("r"))
               .select("r.column", "r.position", "n", "r.n_missing",
                       F.try_divide(F.col("r.n_missing"), F.col("n")).cast("double").alias("rate")))


def missingness_patterns(df: DataFrame) -> DataFrame:
    """(pattern, n): one '1'/'0' per column in column order, '1' = missing."""
    pattern = F.concat(*[F.when(missing_flag(df, c), F.lit("1")).otherwise(F.lit("0")) for c in df.columns])
    return df.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
