"""M1-M2: train / validation / test assignment by patient key hash.

``md5(key || ':' || seed)`` is compared as an 8-hex-digit prefix against the
test fraction, so the split is stable under repartitioning and re-execution
(an executor lost mid-job recomputes the same assignment), identical in DuckDB,
and never needs a global sort or row number.  Splitting by patient keeps every
Fractions are met in expectation; ``exact_split`` meets them exactly, per stratum.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medfuse.session import materialize
from medfuse.sources.fixtures import KEY

HEX_DIGITS = 8


def threshold_hex(fraction: float) -> str:
    return format(int(round(fraction * 16 ** HEX_DIGITS)), f"0{HEX_DIGITS}x")


def hash_bucket(key, seed: int = 42, salt: str = "") -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}{salt}"))), 1, HEX_DIGITS)


def is_test(key=KEY, test_size: float = 0.2, seed: int = 42) -> Column:
    """M1: True for the test share of patients."""
    return hash_bucket(key, seed) < F.lit(threshold_hex(test_size))


def is_validation(key=KEY, validation_size: float = 0.2, seed: int = 42) -> Column:
    """M2: validation share inside the train part (an independent second hash)."""
    return hash_bucket(key, seed, ":val") < F.lit(threshold_hex(validation_size))


def assign_split(df: DataFrame, key: str = KEY, test_size: float = 0.2, validation_size: float = 0.0,
                 seed: int = 42, out: str = "split") -> DataFrame:
    """Add ``split`` in {'train', 'validation', 'test'}."""
    col = F.when(is_test(key, test_size, seed), F.lit("test"))
    if validation_size > 0:
        col = col.when(is_validation(key, validation_size, seed), F.lit("validation"))
    return df.withColumn(out, col.otherwise(F.lit("train")))


def split_data(df: DataFrame, key: str = KEY, test_size: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """M1: (train, test) with every target column kept aligned on the row."""
    t = is_test(key, test_size, seed)
    return df.where(~t), df.where(t)


PLACES = 3          # hex digits by which a hash range is refined in one round (4,096 ranges)


def exact_cuts(df: DataFrame, key: str = KEY, test_size: float = 0.2, strata: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """(strata columns, ``_cut``): the largest key hash that is a test key's, so that every stratum gives its exact share.

    The share of a stratum of n keys is ceil(test_size * n).  Its last test key is found by counting: hashes by their
    first digits, then only those of the range that holds the last one, and so on until a range is taken whole.  A round is
    one aggregate of at most 4,096 rows a stratum; nothing is sorted or numbered, and no key leaves its task.
    """
    hashed = materialize(df.where(F.col(key).isNotNull()).select(*strata, F.lit(0).alias("_all"), _full_hash(key, seed).alias("_h")).distinct())
    within = reduce(lambda a, b: a & b, [F.col(f"h.{s}").eqNullSafe(F.col(f"o.{s}")) for s in (*strata, "_all")])
    sizes = hashed.groupBy(*strata).agg(F.ceil(F.count(F.lit(1)) * F.lit(test_size)).alias("_need")).where("_need > 0")
    todo = materialize(sizes.select(*strata, F.lit(0).alias("_all"), F.lit("").alias("_cut"), "_need", F.lit(0).alias("_whole")))
    done = []
    for digits in range(PLACES, 32 + PLACES, PLACES):
        near = hashed.alias("h").join(todo.alias("o"), within & F.col("h._h").startswith(F.col("o._cut")))
        counts = near.groupBy(*[F.col(f"o.{s}").alias(s) for s in strata], F.col("o._need").alias("_need"),
                              F.substring("h._h", 1, min(32, digits)).alias("_cut")).agg(F.count(F.lit(1)).alias("_n"))
        w = Window.partitionBy(*strata, "_need").orderBy("_cut")
        before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = (counts.withColumn("_before", before).where((F.col("_before") < F.col("_need")) & (F.col("_need") <= F.col("_before") + F.col("_n")))
                 .select(*strata, F.lit(0).alias("_all"), "_cut", (F.col("_need") - F.col("_before")).alias("_need"), F.col("_n").alias("_whole")))
        found = materialize(found)
        done.append(found.where("_need = _whole").select(*strata, "_cut"))
        todo = found.where("_need < _whole")
        if not todo.limit(1).count():
            break
    return reduce(DataFrame.unionByName, done)


def _full_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def exact_split(df: DataFrame, key: str = KEY, test_size: float = 0.2, strata: Sequence[str] = (), seed: int = 42, out: str = "split") -> DataFrame:
    """M1 with exact sizes: ``out`` is 'test' for exactly ceil(test_size * n) of the n distinct keys of every stratum.

    Without ``strata`` the table is one stratum.  NULL is a stratum like any other; rows that share key and stratum go the
    same way; a row with a NULL key is never tested on.  Fractions of 0 and 1 give no and only test keys.
    """
    own = "_cut" + "_" * max(len(c) for c in df.columns)           # longer than any column of the table
    cuts = exact_cuts(df, key, test_size, strata, seed).select(*[F.col(s).alias(f"{own}{i}") for i, s in enumerate(strata)], F.col("_cut").alias(own))
    if strata:
        joined = df.join(cuts, reduce(lambda a, b: a & b, [F.col(s).eqNullSafe(F.col(f"{own}{i}")) for i, s in enumerate(strata)]), "left")
        cut = F.col(own)
    else:
        row = cuts.first()
        joined, cut = df, F.lit(row[own] if row else None).cast("string")
    test = F.coalesce(F.substring(_full_hash(key, seed), F.lit(1), F.length(cut)) <= cut, F.lit(False))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.when(test, "test").otherwise("train").alias(out))
