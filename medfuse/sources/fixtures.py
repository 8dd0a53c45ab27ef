"""Patient modality views derived from the driver's testdata tables.

The testdata has no patient tables, so each modality is a view over one of
them, keyed ``Patient_ID`` (= c_custkey = events.user_id = vec_id = o_custkey):

- ``ehr``        customer, with labels derived from events
- ``imaging``    embeddings, every vector element (width from the data)
- ``wearables``  events as a long (Patient_ID, time, value) series
- ``genomic``    orders counted per priority

NULLs are injected by fixed key rules (the testdata has none) so imputation has
work to do.  The same definitions exist as SQL in ``medfuse.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixture mapping.
ACCTBAL_NULL_EVERY = 7        # ehr.acctbal is NULL when Patient_ID % 7 = 0
VALUE_NULL_EVERY = 11         # wearables.value is NULL when event_id % 11 = 0
CVD_THRESHOLD = 49.5          # CVD_Presence = avg(value) > 49.5
EVENT_THRESHOLD = 100.0       # Time_To_Event: first reading above 100 ...
EVENT_ORIGIN = "2024-01-01 00:00:00"  # ... in days since this instant
ORACLE_IMAGING_DIMS = 64      # width of the test embeddings, for the oracle's SQL text only
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
MODALITIES = ["ehr", "imaging", "wearables", "genomic"]
LABEL_COLS = ["CVD_Presence", "Time_To_Event"]
KEY = "Patient_ID"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _micros(c):
    return F.unix_micros(F.col(c).cast("timestamp")) if isinstance(c, str) else F.unix_micros(c.cast("timestamp"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-patient targets from the raw readings (before NULL injection)."""
    ev = table(spark, sf_dir, "events")
    origin = F.unix_micros(F.lit(EVENT_ORIGIN).cast("timestamp"))
    first_event = F.min(F.when(F.col("value") > EVENT_THRESHOLD, F.col("ts")))
    return (ev.groupBy(F.col("user_id").alias(KEY))
              .agg((F.avg("value") > CVD_THRESHOLD).cast("int").alias("CVD_Presence"),
                   ((F.unix_micros(first_event.cast("timestamp")) - origin) / 86_400_000_000.0)
                   .alias("Time_To_Event")))


def ehr(spark: SparkSession, sf_dir: str, inject_nulls: bool = True) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    acct = F.col("c_acctbal")
    if inject_nulls:
        acct = F.when(F.col("c_custkey") % ACCTBAL_NULL_EVERY != 0, acct)
    base = c.select(F.col("c_custkey").alias(KEY), acct.alias("acctbal"),
                    F.col("c_nationkey").alias("nationkey"), F.col("c_mktsegment").alias("mktsegment"))
    return base.join(labels(spark, sf_dir), KEY, "left")


def imaging(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    width = e.agg(F.max(F.size("embedding")).alias("w")).first()["w"] or 0
    return e.select(F.col("vec_id").alias(KEY),
                    *[F.try_element_at("embedding", F.lit(i + 1)).cast("double").alias(f"e{i}") for i in range(width)])


def wearables(spark: SparkSession, sf_dir: str, inject_nulls: bool = True) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    v = F.col("value")
    if inject_nulls:
        v = F.when(F.col("event_id") % VALUE_NULL_EVERY != 0, v)
    return ev.select(F.col("user_id").alias(KEY), F.col("ts").alias("time"), v.alias("value"))


def genomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(F.col("o_custkey").alias(KEY))
             .agg(*[F.count_if(F.col("o_orderpriority") == p).cast("int").alias(f"g{i + 1}")
                    for i, p in enumerate(PRIORITIES)]))


def modalities(spark: SparkSession, sf_dir: str, inject_nulls: bool = True) -> dict[str, DataFrame]:
    return {
        "ehr": ehr(spark, sf_dir, inject_nulls),
        "imaging": imaging(spark, sf_dir),
        "wearables": wearables(spark, sf_dir, inject_nulls),
        "genomic": genomic(spark, sf_dir),
    }


def score_table(spark: SparkSession, sf_dir: str, zero_actuals: bool = False) -> DataFrame:
    """Scores for metric tests, no model needed (from lineitem).

    label = returnflag 'R'; p = round(discount*5 + tax, 4); y = quantity;
    y_hat = extendedprice / 1000; with ``zero_actuals`` y = 0 on line 1.
    """
    li = table(spark, sf_dir, "lineitem")
    y = F.col("l_quantity")
    if zero_actuals:
        y = F.when(F.col("l_linenumber") == 1, F.lit(0.0)).otherwise(y)
    return li.select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.round(F.col("l_discount") * 5 + F.col("l_tax"), 4).alias("p"),
        y.alias("y"), (F.col("l_extendedprice") / 1000.0).alias("y_hat"))
