"""Order-based features (F8, F9, F12) of arriving readings, kept as a mergeable state per patient.

A patient's state holds what the features are made of: counts, sums of changes, lagged products, extremes with their
places, and the first two and last six readings.  A micro-batch that only continues a series is ranked together with
the last readings alone and merged; a patient with a reading that is not after the last one (a late or repeated
reading) is opened again and recomputed from the stored readings, so order of arrival never shows in the result.

Readings and states are tables with one folder per micro-batch, overwritten when a batch is replayed: a restart from
the checkpoint gives the same tables.  A state folder holds the patients of its batch, and every ``FULL_EVERY``-th all
of them, so that reading the current state never reaches further back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medfuse.functions import series as S
from medfuse.functions.tsfeatures import FeatureSettings, fname
from medfuse.sources.fixtures import KEY

FULL_EVERY = 50
BUCKETS = 64            # folders by patient hash inside a batch of readings, so that opening a patient reads one of them
SETTINGS = FeatureSettings()
LAGS = sorted({*SETTINGS.c3_lags, *SETTINGS.tras_lags})
TAIL = 2 * max(LAGS)
READING = "struct<t: timestamp, x: double>"


def state_schema(key_type: str) -> str:
    sums = ", ".join(f"c3_{l} double, tras_{l} double" for l in LAGS)
    return (f"{KEY} {key_type}, n bigint, mean double, m2 double, abs_change double, sq_change double, {sums}, "
            f"high double, high_first bigint, high_last bigint, low double, low_first bigint, low_last bigint, "
            f"head array<{READING}>, tail array<{READING}>")


def _summaries(rows: DataFrame, settings: FeatureSettings) -> DataFrame:
    """State of the new readings of each patient alone; ``rows``: (key, t, x, new), old ones stand before all new ones.

    Sums over changes and lagged products belong to the later reading, so those across the border count here.
    """
    ranked = S.rank_series(rows, [KEY], ["t", "x"], settings.chunk_width)
    lags = sorted({1, *LAGS, *[2 * l for l in LAGS]})
    near = S.with_neighbors(ranked, [KEY], "x", lags, [], settings.block_rows)
    x, d = F.col("x"), F.col("x") - F.col("lag_1")
    near = near.where("new")
    r = F.struct("t", "x")
    sums = []
    for l in LAGS:
        one, two = F.col(f"lag_{l}"), F.col(f"lag_{2 * l}")
        sums += [F.sum(x * one * two).alias(f"c3_{l}"), F.sum(x * x * one - one * two * two).alias(f"tras_{l}")]
    extremes = near.groupBy(KEY).agg(F.max("x").alias("high"), F.min("x").alias("low"), F.min("rn").alias("start"))
    # one row per patient: the extremes ride on every reading, so that their places need no second series-wide pass
    placed = near.join(extremes, KEY)
    return placed.groupBy(KEY).agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("*")).alias("m2"),
        F.sum(F.abs(d)).alias("abs_change"), F.sum(d * d).alias("sq_change"), *sums,
        F.max("high").alias("high"), F.min(F.when(x == F.col("high"), F.col("rn") - F.col("start") + 1)).alias("high_first"),
        F.max(F.when(x == F.col("high"), F.col("rn") - F.col("start") + 1)).alias("high_last"),
        F.max("low").alias("low"), F.min(F.when(x == F.col("low"), F.col("rn") - F.col("start") + 1)).alias("low_first"),
        F.max(F.when(x == F.col("low"), F.col("rn") - F.col("start") + 1)).alias("low_last"),
        # at most 2 and TAIL readings each
        F.sort_array(F.collect_list(F.when(F.col("rn") < F.col("start") + 2, r))).alias("head"),
        F.sort_array(F.collect_list(F.when(F.col("rn") > F.col("n") - TAIL, r))).alias("tail"))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """States of ``new`` appended to those of ``old`` (a patient without an old state begins with the new one)."""
    a = {c: F.col(f"o.{c}") for c in old.columns}
    b = {c: F.col(f"w.{c}") for c in new.columns}
    fresh = a["n"].isNull()

    def added(c: str) -> Column:
        return F.when(a[c].isNull(), b[c]).otherwise(a[c] + F.coalesce(b[c], F.lit(0.0)))

    n = F.coalesce(a["n"], F.lit(0)) + b["n"]
    delta = b["mean"] - a["mean"]
    out = {
        KEY: b[KEY], "n": n,
        "mean": F.when(fresh, b["mean"]).otherwise(a["mean"] + delta * b["n"] / n),
        "m2": F.when(fresh, b["m2"]).otherwise(a["m2"] + b["m2"] + delta * delta * a["n"] * b["n"] / n),
        "abs_change": added("abs_change"), "sq_change": added("sq_change"),
        **{f"{s}_{l}": added(f"{s}_{l}") for l in LAGS for s in ("c3", "tras")},
    }
    for side, wins in (("high", lambda p, q: p >= q), ("low", lambda p, q: p <= q)):
        p, q = a[side], b[side]
        out[side] = F.when(fresh | wins(q, p), q).otherwise(p)
        out[f"{side}_first"] = F.when(~fresh & wins(p, q), a[f"{side}_first"]).otherwise(F.coalesce(a["n"], F.lit(0)) + b[f"{side}_first"])
        out[f"{side}_last"] = F.when(fresh | wins(q, p), F.coalesce(a["n"], F.lit(0)) + b[f"{side}_last"]).otherwise(a[f"{side}_last"])
    none = F.expr(f"CAST(array() AS array<{READING}>)")
    out["head"] = F.slice(F.concat(F.coalesce(a["head"], none), b["head"]), 1, 2)
    both = F.concat(F.coalesce(a["tail"], none), b["tail"])
    out["tail"] = F.slice(both, F.greatest(F.size(both) - TAIL + 1, F.lit(1)), TAIL)
    return new.alias("w").join(old.alias("o"), KEY, "left").select(*[v.alias(c) for c, v in out.items()])


def features(state: DataFrame) -> DataFrame:
    """F8, F9 and F12 per patient, by the names and rules of the batch extraction."""
    c = F.col
    n, std = c("n"), F.sqrt(c("m2") / c("n"))
    x = lambda i: F.try_element_at(c("head"), F.lit(i))["x"]
    y = lambda i: F.try_element_at(c("tail"), F.lit(-i))["x"]
    zero = F.lit(0.0)
    out = [F.coalesce("abs_change", zero).alias("absolute_sum_of_changes"), F.when(n > 1, c("abs_change") / (n - 1)).alias("mean_abs_change"),
           F.when(n > 1, (y(1) - x(1)) / (n - 1)).alias("mean_change"),
           F.when(c("high") == c("low"), zero).otherwise(F.sqrt(F.coalesce("sq_change", zero)) / std).alias(fname("cid_ce", normalize=True)),
           F.sqrt(F.coalesce("sq_change", zero)).alias(fname("cid_ce", normalize=False)),
           F.when(n > 2, (y(1) - y(2) - x(2) + x(1)) / (2.0 * (n - 2))).alias("mean_second_derivative_central")]
    out += [F.when(2 * l >= n, zero).otherwise(c(f"c3_{l}") / (n - 2 * l)).alias(fname("c3", lag=l)) for l in SETTINGS.c3_lags]
    out += [F.when(2 * l >= n, zero).otherwise(c(f"tras_{l}") / (n - 2 * l)).alias(fname("time_reversal_asymmetry_statistic", lag=l))
            for l in SETTINGS.tras_lags]
    out += [((c("high_first") - 1) / n).alias("first_location_of_maximum"), (c("high_last") / n).alias("last_location_of_maximum"),
            ((c("low_first") - 1) / n).alias("first_location_of_minimum"), (c("low_last") / n).alias("last_location_of_minimum")]
    return state.select(KEY, *out)


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Ids of the finished batches of a table, in order (a folder without its success mark was interrupted)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("batch_id=")]
    return sorted(int(p.getName().split("=")[1]) for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def current_state(spark: SparkSession, base: str, key_type: str = "bigint", before: int | None = None) -> DataFrame:
    """The latest state of every patient (of the batches before ``before``)."""
    done = [b for b in _batches(spark, f"{base}/state") if before is None or b < before]
    full = max([b for b in done if b % FULL_EVERY == FULL_EVERY - 1], default=-1)
    paths = [f"{base}/state/batch_id={b}" for b in done if b >= full]
    schema = state_schema(key_type)
    if not paths:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema + ", batch_id bigint").option("basePath", f"{base}/state").parquet(*paths)
    whole = F.struct(*[c for c in rows.columns if c != "batch_id"])
    return rows.groupBy(F.col(KEY).alias("_key")).agg(F.max_by(whole, "batch_id").alias("s")).select("s.*")


def upsert(batch: DataFrame, batch_id: int, base: str, time_col: str = "time", value_col: str = "value",
           settings: FeatureSettings = SETTINGS) -> None:
    """Store the readings of one micro-batch and write the states that they change.

    Readings without a patient, a time or a finite value do not count, as in the batch extraction.
    """
    spark = batch.sparkSession
    x, t = F.col(f"`{value_col}`").cast("double"), F.col(f"`{time_col}`").cast("timestamp")
    rows = batch.select(KEY, t.alias("t"), x.alias("x")).where(f"{KEY} IS NOT NULL AND t IS NOT NULL AND abs(x) < double('Infinity')")
    folder = f"{base}/readings/batch_id={batch_id}"
    bucket = F.pmod(F.hash(KEY), F.lit(BUCKETS)).alias("bucket")
    rows.select("*", bucket).write.mode("overwrite").partitionBy("bucket").parquet(folder)
    key_type = batch.schema[KEY].dataType.simpleString()
    schema = f"{KEY} {key_type}, t timestamp, x double"
    rows = spark.read.schema(schema + ", bucket int").parquet(folder).select(KEY, "t", "x", "bucket")
    old = current_state(spark, base, key_type, batch_id)
    last = old.select(KEY, F.element_at("tail", -1).alias("last"))
    firsts = rows.groupBy(KEY, "bucket").agg(F.min(F.struct("t", "x")).alias("first")).join(last, KEY, "left")
    onward = firsts.where("last < first").select(KEY)               # the series goes on
    opened = firsts.where("last IS NULL OR last >= first").select(KEY, "bucket")     # new, or opened again
    stored = spark.read.schema(schema + ", batch_id bigint, bucket int").option("basePath", f"{base}/readings").parquet(
        *[f"{base}/readings/batch_id={b}" for b in _batches(spark, f"{base}/readings") if b <= batch_id])
    whole = stored.join(opened, ["bucket", KEY], "left_semi").select(KEY, "t", "x", F.lit(True).alias("new"))
    added = rows.join(onward, KEY, "left_semi").select(KEY, "t", "x", F.lit(True).alias("new"))
    context = old.join(onward, KEY, "left_semi").select(KEY, F.inline("tail")).select(KEY, "t", "x", F.lit(False).alias("new"))
    new = _summaries(whole.unionByName(added).unionByName(context), settings)
    states = merge(old.join(onward, KEY, "left_semi"), new)
    if batch_id % FULL_EVERY == FULL_EVERY - 1:
        states = states.unionByName(old.join(firsts, KEY, "left_anti"))
    states.write.mode("overwrite").parquet(f"{base}/state/batch_id={batch_id}")


def start_series_stream(readings: DataFrame, base: str, checkpoint_dir: str, time_col: str = "time", value_col: str = "value",
                        available_now: bool = True, settings: FeatureSettings = SETTINGS):
    """Keep the states under ``base`` up to date with a stream of readings; ``features(current_state(...))`` reads them."""
    def each_batch(batch: DataFrame, batch_id: int) -> None:
        upsert(batch, batch_id, base, time_col, value_col, settings)

    writer = readings.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint_dir)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
