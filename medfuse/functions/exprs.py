"""Column-expression helpers shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

# Largest finite double (numpy nan_to_num bound) and double eps.
DOUBLE_MAX = 1.7976931348623157e308
DOUBLE_EPS = 2.220446049250313e-16
ROUND_HALF = 0.5 - 2.0 ** -20
ROUND_LIMIT = 1e12   # larger magnitudes (and NaN, +-inf) are passed through unrounded


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN -> NULL for floating columns (so avg/min/max skip it)."""
    return F.nanvl(col_of(c), F.lit(None).cast("double"))


def nan_to_num(c) -> Column:
    """NaN -> 0, +inf -> largest double, -inf -> smallest double; NULL stays NULL."""
    x = col_of(c).cast("double")
    return (F.when(F.isnan(x), F.lit(0.0))
             .when(x == float("inf"), F.lit(DOUBLE_MAX))
             .when(x == float("-inf"), F.lit(-DOUBLE_MAX))
             .otherwise(x))


def finite_or_null(df: DataFrame, cols) -> DataFrame:
    """``cols`` as doubles in which NaN and +-inf are NULL; the other columns as they are."""
    wanted = set(cols)
    quoted = {c: "`" + c.replace("`", "``") + "`" for c in df.columns}
    return df.selectExpr(*[f"CASE WHEN abs(CAST({q} AS DOUBLE)) < double('Infinity') THEN CAST({q} AS DOUBLE) END AS {q}"
                           if c in wanted else q for c, q in quoted.items()])


def argmax_index(arr) -> Column:
    """0-based index of the first maximum of an array (ties -> lowest index)."""
    a = col_of(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (DoubleType, FloatType))


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NumericType)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column as floor(x*10^d + h)/10^d (and -0.0 -> 0.0).

    The same arithmetic is used in the SQL oracle, so equal doubles round equally.
    h is a hair below 0.5: exact decimal halves (common for means of short
    decimals) then sit 1e-6 units away from the cut, so last-bit differences
    between engines' summation orders cannot flip them.

    Used only where results are compared across engines; the library itself
    returns unrounded values.
    """
    scale = float(10 ** digits)
    out = []
    for f in df.schema.fields:
        c = "`" + f.name.replace("`", "``") + "`"
        if isinstance(f.dataType, (DoubleType, FloatType)):
            x = f"CAST({c} AS DOUBLE)"
            out.append(f"CASE WHEN abs({x}) < {ROUND_LIMIT!r}D THEN floor({x} * {scale!r}D + {ROUND_HALF!r}D) / {scale!r}D "
                       f"+ 0.0D ELSE {x} + 0.0D END AS {c}")
        else:
            out.append(c)
    return df.selectExpr(*out)   # one call for all columns (SQL text, parsed JVM-side)
