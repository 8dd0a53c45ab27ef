"""Joining the modalities on the patient key.

Patient-grain tables are joined first and the long readings table last, so the
big table is exchanged once (or not at all when AQE sees the patient side is
under the broadcast threshold).  AQE's skew-join split handles a hot patient in
the readings.  Keys are cast to one type and NULL keys are dropped (Spark never
matches NULL keys; the count of dropped rows is reported by ``unmatched_keys``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medfuse.operators.clean import add_prefix
from medfuse.sources.fixtures import KEY

PREFIXED = ("imaging", "wearables", "genomic")


def _keyed(df: DataFrame, key: str, key_type: str | None) -> DataFrame:
    out = df.where(F.col(key).isNotNull())
    return out.withColumn(key, F.col(key).cast(key_type)) if key_type else out


def merge_modalities(tables: dict[str, DataFrame], key: str = KEY, key_type: str | None = None,
                     long_tables: Sequence[str] = ("wearables",)) -> DataFrame:
    """Prefix non-EHR modalities (R3), inner-join all on the key, fan-out kept.

    Output columns keep the modality order of ``tables``.
    """
    prepared = {name: _keyed(add_prefix(df, name, key) if name in PREFIXED else df, key, key_type)
                for name, df in tables.items()}
    order = [n for n in prepared if n not in long_tables] + [n for n in prepared if n in long_tables]
    joined = reduce(lambda a, b: a.join(b, key, "inner"), [prepared[n] for n in order])
    cols = [key] + [c for n in prepared for c in prepared[n].columns if c != key]
    return joined.select(*cols)


def wide_concat(tables: Sequence[DataFrame], key: str = KEY) -> DataFrame:
    """Column-wise union aligned on the key (full outer join, key coalesced)."""
    return reduce(lambda a, b: a.join(b, key, "full"), tables)


def leave_one_out(columns: dict[str, list[str]], drop: str | None) -> list[str]:
    """Feature columns of every modality except ``drop`` (None keeps all)."""
    return [c for name, cols in columns.items() if name != drop for c in cols]


def unmatched_keys(tables: dict[str, DataFrame], key: str = KEY) -> DataFrame:
    """Per modality, distinct keys, keys lost by the inner join, and NULL-key rows."""
    counts = {n: df.groupBy(key).agg(F.count(F.lit(1)).alias("_c")) for n, df in tables.items()}
    common = reduce(lambda a, b: a.join(b, key, "inner"),
                    [c.select(key).where(F.col(key).isNotNull()) for c in counts.values()])
    marked = common.withColumn("_in", F.lit(True))
    rows = []
    for n, c in counts.items():
        k = F.col(key)
        rows.append(c.join(marked, key, "left").agg(
            F.count_if(k.isNotNull()).alias("n_keys"),
            F.count_if(k.isNotNull() & F.col("_in").isNull()).alias("n_lost"),
            F.coalesce(F.sum(F.when(k.isNull(), F.col("_c"))), F.lit(0)).alias("n_null_key_rows"))
            .select(F.lit(n).alias("modality"), "n_keys", "n_lost", "n_null_key_rows"))
    return reduce(DataFrame.unionByName, rows)
