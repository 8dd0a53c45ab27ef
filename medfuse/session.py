"""The Spark session and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this package relies on.  AQE re-plans joins at run time
# (broadcast only when the measured side is under the threshold; split skewed
# partitions of sort-merge joins), and ANSI mode stays on (try_* functions are
# used wherever a value may be bad).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # feature stages do heavy work per shuffled byte: do not coalesce small
    # shuffles below 64 KB per task (large inputs still target the advisory size)
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # no Python call-site capture per Column call (plans here have thousands of expressions)
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_spark_session(app_name: str = "medfuse", master: str | None = None,
                      conf: dict[str, str] | None = None) -> SparkSession:
    """Get or create the named session.

    On a cluster the launcher supplies the master and resources; ``master`` is
    only for local runs and tests.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, registering it with the context.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that setting
    always wins.  Only where it is unset and the master is local (tests) a scratch
    folder is created; on a cluster executors could not see it, so that raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current is not None:
        return current
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="medfuse-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    base = base[len("file:"):] if base.startswith("file:") and not base.startswith("file://") else base
    return os.path.join(base, "tables", name) if "://" not in base else f"{base.rstrip('/')}/tables/{name}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as parquet into the shared folder and read it back (S3).

    Several consumers then scan pruned columns of a written table instead of
    recomputing the plan, and a lost executor costs a re-read only.
    """
    path = scratch_path(df.sparkSession, f"step-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
