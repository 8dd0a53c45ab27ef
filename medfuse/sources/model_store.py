"""Persist the fitted pipeline and the training report.

One ``PipelineModel`` artefact carries imputer means, scalers and both heads
(the reference kept a Keras file and a pickled scaler apart).
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_report(report: DataFrame, path: str) -> str:
    """The long metrics table (scope, metric, value) written as parquet."""
    report.coalesce(1).write.mode("overwrite").parquet(path)
    return path
