"""Scoring records (JSON text), validation with quarantine, and the result sink.

A record has the reference's request shape:

    Patient_ID        string
    ehr_features      map<string, double>
    imaging_features  array<double>
    wearables_data    map<string, string>   (one reading; fields try_cast per use)
    genomic_features  array<int>

``from_json`` never fails a job: non-JSON gives an all-NULL struct, a number in a
string field is coerced, and a bad array element nulls the whole array.  So the
required fields are checked explicitly and every problem is listed per record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, MapType, StringType, StructField,
                               StructType)

from medfuse.sources.fixtures import KEY

RECORD_SCHEMA = StructType([
    StructField("Patient_ID", StringType()),
    StructField("ehr_features", MapType(StringType(), DoubleType())),
    StructField("imaging_features", ArrayType(DoubleType())),
    StructField("wearables_data", MapType(StringType(), StringType())),
    StructField("genomic_features", ArrayType(IntegerType())),
])
REQUIRED = [f.name for f in RECORD_SCHEMA.fields]
RESULT_COLS = ["Patient_ID", "CVD_Presence", "CVD_Presence_probability", "Time_To_Event", "features_from", "error"]

# The reference's sample request (fixed values).
SAMPLE_RECORD = {
    "Patient_ID": "12345",
    "ehr_features": {"age": 55, "sex": 1, "cp": 3, "trestbps": 130, "chol": 250, "fbs": 0, "restecg": 0,
                     "thalach": 150, "exang": 0, "oldpeak": 1.5, "slope": 2, "ca": 1, "thal": 3},
    "imaging_features": [0.1, 0.3, 0.5, 0.7, 0.9],
    "wearables_data": {"Patient_ID": "12345", "steps_per_day": 8000, "avg_heart_rate": 75, "sleep_hours": 7,
                       "activity_level": "Moderate", "time": 1},
    "genomic_features": [1, 0, 2, 1, 1, 0, 1, 2, 2, 0],
}


def read_record_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """S6 stream source: new JSON-lines files arriving in ``path``."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def parse_records(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """Parse JSON text into ``r`` (struct) keeping the raw text and a digest of it."""
    return raw.select(F.col(value_col).alias("raw"),
                      F.sha2(F.col(value_col), 256).alias("record_id"),
                      F.from_json(F.col(value_col), RECORD_SCHEMA).alias("r"))


def _missing(field: str) -> Column:
    return F.when(F.col(f"r.{field}").isNull(), F.lit(f"{field}: field required or invalid"))


def record_errors(parsed: DataFrame) -> Column:
    """List of problems per record (empty when valid)."""
    checks = [_missing(f) for f in REQUIRED]
    for arr in ("imaging_features", "genomic_features"):
        checks.append(F.when(F.exists(F.col(f"r.{arr}"), lambda v: v.isNull()),
                             F.lit(f"{arr}: null element")))
    checks.append(F.when(F.col("r.Patient_ID") == "", F.lit("Patient_ID: empty")))
    return F.array_compact(F.array(*checks))


def validate(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid records, quarantine with the error list)."""
    checked = parsed.withColumn("errors", record_errors(parsed))
    valid = checked.where(F.size("errors") == 0).drop("errors")
    quarantine = checked.where(F.size("errors") > 0).select(
        "record_id", F.col("r.Patient_ID").alias(KEY), "raw", "errors")
    return valid, quarantine


def result_records(scored: DataFrame) -> DataFrame:
    """The response fields (text label R19, probability, time); no prediction beside an ``error``."""
    good = F.size("_errors") == 0
    return scored.select(
        F.col(KEY).cast("string").alias("Patient_ID"),
        F.when(good, F.when(F.col("p_class1") > 0.5, F.lit("Positive")).otherwise(F.lit("Negative"))).alias("CVD_Presence"),
        F.when(good, F.col("p_class1")).alias("CVD_Presence_probability"),
        F.when(good, F.col("pred_time")).alias("Time_To_Event"),
        F.col("features_from"), F.when(~good, F.array_join("_errors", "; ")).alias("error"))
