"""Windowed features from arriving wearables readings.

Event-time tumbling windows per patient with a watermark: append mode emits a
(patient, window) row once the watermark passes the window end, so state is
bounded by the open windows, and each window's state by fixed-width sums and a
quantile sketch of bounded size.  ``median_approx`` is the sketch's median (the
lower middle value, with a rank error of n / ``ACCURACY`` at most); the exact
median is a batch matter (``completed``).  Order-based features are kept by
``medfuse.streaming.series_state``.

Late readings: a micro-batch is judged by the watermark that the batch *before*
it left behind, so a reading can be later than the newest one seen by more than
the delay and still count, if its window had not been closed when its batch
began.  What comes after that is dropped and counted in the query progress
(``numRowsDroppedByWatermark``).

A stream that has ended leaves its newest windows open: no later reading pushes
the watermark past them.  ``completed`` adds every window of the bounded input that
the stream has not written, so no reading's window is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medfuse.functions.tsfeatures import exact_quantiles
from medfuse.sources.fixtures import KEY

EVENT_THRESHOLD = 100.0
ACCURACY = 10_000        # size of a window's quantile sketch
MEDIAN_BOUNDS = 128      # value buckets of a window for the exact median


def reading_stream(spark: SparkSession, path_glob: str, schema, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path_glob)


def _aggregates(x: Column, accuracy: int) -> list[Column]:
    return [F.count(x).alias("n"), F.sum(x).alias("sum_values"), F.avg(x).alias("mean"),
            F.stddev_pop(x).alias("standard_deviation"), F.min(x).alias("minimum"),
            F.max(x).alias("maximum"), F.percentile_approx(x, 0.5, accuracy).alias("median_approx"),
            F.count_if(x > EVENT_THRESHOLD).alias("n_above")]


def _windows(readings: DataFrame, time_col: str, value_col: str, window: str, accuracy: int) -> DataFrame:
    agg = readings.groupBy(F.window(time_col, window).alias("w"), F.col(KEY)).agg(*_aggregates(F.col(value_col), accuracy))
    return agg.select(KEY, F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                      *[c for c in agg.columns if c not in ("w", KEY)])


def windowed_features(readings: DataFrame, time_col: str = "time", value_col: str = "value",
                      window: str = "1 day", delay: str = "1 hour", accuracy: int = ACCURACY) -> DataFrame:
    """(Patient_ID, window_start, window_end, n, sum, mean, std, min, max, median_approx, n_above) of a stream."""
    timed = readings.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay)
    return _windows(timed, time_col, value_col, window, accuracy)


def run_to_sink(features: DataFrame, sink_dir: str, checkpoint_dir: str, available_now: bool = True):
    w = (features.writeStream.outputMode("append").format("parquet")
         .option("path", sink_dir).option("checkpointLocation", checkpoint_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def completed(spark: SparkSession, readings: DataFrame, sink_dir: str, time_col: str = "time", value_col: str = "value",
              window: str = "1 day", accuracy: int = ACCURACY) -> DataFrame:
    """All windows of the bounded ``readings``: those that the ended stream wrote, the others by the same aggregate.

    ``median`` is exact here: counted values by value bucket, never a window's readings in one buffer.  NULL values count
    in no statistic, readings without a time in no window.
    """
    timed = readings.withColumn(time_col, F.col(time_col).cast("timestamp")).where(F.col(time_col).isNotNull())
    keys = [KEY, "window_start"]
    every = _windows(timed, time_col, value_col, window, accuracy)
    written = spark.read.schema(every.schema).parquet(sink_dir)
    missing = every.join(written.select(*keys), keys, "left_anti")
    start = F.window(time_col, window)["start"].cast("timestamp_ntz").alias("window_start")
    values = timed.select(KEY, start, F.col(value_col).cast("double").alias("x")).where("x IS NOT NULL")
    cuts = [i / MEDIAN_BOUNDS for i in range(1, MEDIAN_BOUNDS)]
    bounds = values.groupBy(*keys).agg(F.count("x").alias("n"), F.percentile_approx("x", cuts, 10 * MEDIAN_BOUNDS).alias("_bounds"))
    median = exact_quantiles(values, keys, bounds, [0.5], MEDIAN_BOUNDS - 1).select(*keys, F.col("_q0").alias("median"))
    return written.unionByName(missing).join(median, keys, "left")
