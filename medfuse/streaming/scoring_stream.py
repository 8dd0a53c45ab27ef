"""M9: scoring records as they arrive (Structured Streaming).

Text files land in a folder; each micro-batch is scored with the same batch
function as M8 inside ``foreachBatch`` (the feature plan uses windows and
joins, which a streaming plan cannot host directly).  Each batch writes its
results to ``<sink>/batch_id=<n>`` with overwrite, so a batch replayed after a
failure replaces its own output: exactly-once results on restart from the
checkpoint.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from medfuse.functions.tsfeatures import FeatureSettings
from medfuse.plans.features import ALL_FEATURES
from medfuse.plans.scoring import score_records
from medfuse.sources import records as R


def start_scoring_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                         model: PipelineModel, columns: dict[str, list[str]], layout: dict[str, list[str]], stored: DataFrame,
                         fills: dict[str, float | None] | None = None,
                         settings: FeatureSettings = ALL_FEATURES, available_now: bool = True,
                         max_files_per_trigger: int | None = None):
    stream = R.read_record_stream(spark, source_dir, max_files_per_trigger)

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist()                     # read by the results and the quarantine
        results, quarantine = score_records(batch, model, columns, layout, stored, fills, settings)
        results.write.mode("overwrite").parquet(f"{sink_dir}/results/batch_id={batch_id}")
        quarantine.write.mode("overwrite").parquet(f"{sink_dir}/quarantine/batch_id={batch_id}")
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
