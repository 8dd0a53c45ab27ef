"""M8: batch scoring of JSON records with the fitted pipeline.

record -> validate (S7) -> flatten (R15: map keys and array positions to the
training columns, by the layout that training kept) -> wearables features ->
PipelineModel -> result (S8).

A known patient is scored with the stored features of their readings, the ones
the model was trained on; the record's own reading stands in for an unknown
patient, as a series of one, and ``features_from`` says which.  One-reading
features depend on the reading alone, so each distinct reading is computed once
and repeated records score alike, whatever batch they come in.  A record that
lacks what the model needs gets an ``error`` and no prediction.  A feature that is
NaN or infinite counts as missing, as in training.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medfuse.functions.exprs import finite_or_null
from medfuse.functions.tsfeatures import FeatureSettings, extract_features
from medfuse.operators.models import predict
from medfuse.plans.features import ALL_FEATURES
from medfuse.session import materialize
from medfuse.sources import records as R
from medfuse.sources.fixtures import KEY

ARRAYS = {"imaging": "imaging_features", "genomic": "genomic_features"}


def _positions(columns: dict[str, list[str]], layout: dict[str, list[str]], modality: str) -> dict[str, int]:
    """1-based array position of each model column of an array modality."""
    at = {c: i + 1 for i, c in enumerate(layout.get(modality, []))}
    return {c: at[c] for c in columns.get(modality, [])}


def flatten(columns: dict[str, list[str]], layout: dict[str, list[str]]) -> list[Column]:
    """The model's EHR, imaging and genomic columns from a parsed record ``r``."""
    out = [F.try_element_at(F.col("r.ehr_features"), F.lit(c)).cast("double").alias(c) for c in columns.get("ehr", [])]
    for modality, field in ARRAYS.items():
        out += [F.try_element_at(F.col(f"r.{field}"), F.lit(i)).cast("double").alias(c)
                for c, i in _positions(columns, layout, modality).items()]
    return out


def model_errors(columns: dict[str, list[str]], layout: dict[str, list[str]]) -> list[Column]:
    """What a record lacks for the model: EHR keys, array elements."""
    checks = [F.when(~F.map_contains_key("r.ehr_features", F.lit(c)), F.lit(f"ehr_features: no {c}")) for c in columns.get("ehr", [])]
    for modality, field in ARRAYS.items():
        need = max(_positions(columns, layout, modality).values(), default=0)
        checks.append(F.when(F.size(f"r.{field}") < need, F.concat(
            F.lit(f"{field}: "), F.size(f"r.{field}").cast("string"), F.lit(f" elements, {need} needed"))))
    return checks


def score_records(raw: DataFrame, model: PipelineModel, columns: dict[str, list[str]], layout: dict[str, list[str]],
                  stored: DataFrame, fills: dict[str, float | None] | None = None, settings: FeatureSettings = ALL_FEATURES,
                  signals: tuple[str, ...] = ("value",)) -> tuple[DataFrame, DataFrame]:
    """M8: (results, quarantine) for a DataFrame of JSON text in ``value``.

    ``stored``: wearables features by patient; ``fills``: the means that training filled missing values with.
    """
    valid, quarantine = R.validate(R.parse_records(raw))
    wanted = columns.get("wearables", [])
    wd = F.col("r.wearables_data")
    time = F.try_element_at(wd, F.lit("time"))
    when = F.coalesce(time.try_cast("timestamp"), F.timestamp_micros(time.try_cast("long")), F.timestamp_micros(F.lit(0)))
    reading = F.struct(when.alias("time"), *[F.try_element_at(wd, F.lit(s)).try_cast("double").alias(s) for s in signals])
    key_type = stored.schema[KEY].dataType
    flat = valid.select(F.col("r.Patient_ID").alias(KEY), F.col("r.Patient_ID").try_cast(key_type).alias("_key"), reading.alias("_reading"),
                        F.array_compact(F.array(*model_errors(columns, layout))).alias("_errors"), *flatten(columns, layout))
    flat = flat.withColumns({c: F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(m)) for c, m in (fills or {}).items()
                             if m is not None and c in flat.columns})
    history = stored.select(F.col(KEY).alias("_known"), *wanted)
    joined = flat.join(history, flat["_key"] == history["_known"], "left")
    known = joined.where("_known IS NOT NULL").withColumn("features_from", F.lit("history"))
    unknown = flat.join(history.select("_known"), flat["_key"] == history["_known"], "left_anti")
    if wanted and unknown.limit(1).count():
        some = reduce(lambda a, b: a | b, [F.col(f"_reading.{s}").isNotNull() for s in signals])
        distinct = unknown.where(some).select("_reading").distinct()
        one = extract_features(distinct.select("_reading", "_reading.*"), "_reading", "time", list(signals), settings)
        one = one.select(F.col("_reading").alias("_of"), *[F.col(c) if c in one.columns else F.lit(None).cast("double").alias(c) for c in wanted])
        alone = unknown.join(one, unknown["_reading"] == one["_of"], "left").withColumn(
            "_errors", F.when(F.coalesce(some, F.lit(False)), F.col("_errors")).otherwise(
                F.concat("_errors", F.array(F.lit("wearables_data: no reading of " + ", ".join(signals))))))
        known = known.drop("_known").unionByName(alone.drop("_of").withColumn("features_from", F.lit("record")))
    # the joins and the cleaning of all feature columns are one plan, the model is another
    rows = materialize(finite_or_null(known.drop("_reading", "_key", "_known"), [c for cs in columns.values() for c in cs]))
    return R.result_records(predict(model, rows, [KEY, "features_from", "_errors"])), quarantine


def records_from_modalities(mods: dict[str, DataFrame], keys: DataFrame | None = None,
                            corrupt_every: int | None = None) -> DataFrame:
    """Scoring records built from the modality views (latest reading per patient).

    The latest reading is a ``max(struct(time, value))`` aggregate (combined map-side), so a hot
    patient never gathers its series in one place.  ``corrupt_every`` turns the
    imaging array of patients with key % n = 0 into text, to exercise S7.
    """
    ehr = mods["ehr"].select(KEY, F.create_map(F.lit("acctbal"), F.col("acctbal").cast("double"),
                                               F.lit("nationkey"), F.col("nationkey").cast("double")).alias("ehr_features"))
    img_cols = [c for c in mods["imaging"].columns if c != KEY]
    img = mods["imaging"].select(KEY, F.array(*[F.col(c) for c in img_cols]).alias("imaging_features"))
    gen = mods["genomic"].select(KEY, F.array(*[F.col(c) for c in mods["genomic"].columns if c != KEY])
                                 .alias("genomic_features"))
    last = (mods["wearables"].where(F.col("value").isNotNull()).groupBy(KEY)
            .agg(F.max(F.struct("time", "value")).alias("last")))
    wear = last.select(KEY, F.create_map(F.lit("time"), F.date_format("last.time", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
                                         F.lit("value"), F.col("last.value").cast("string")).alias("wearables_data"))
    rec = ehr.join(img, KEY).join(wear, KEY).join(gen, KEY)
    if keys is not None:
        rec = rec.join(keys, KEY, "left_semi")
    pid = F.col(KEY).cast("string").alias("Patient_ID")
    good = F.to_json(F.struct(pid, "ehr_features", "imaging_features", "wearables_data", "genomic_features"))
    if not corrupt_every:
        return rec.select(good.alias("value"))
    bad = F.to_json(F.struct(pid, "ehr_features", F.lit("bad").alias("imaging_features"), "wearables_data",
                             "genomic_features"))
    return rec.select(F.when(F.col(KEY) % corrupt_every == 0, bad).otherwise(good).alias("value"))
