"""Helpers shared by the corpus operators: written cut points, fresh column names, table access."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a scratch folder only for a local master without one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    current = getattr(spark.sparkContext, "_medfuse_scratch", None)
    if current is None:
        current = spark.sparkContext._medfuse_scratch = "file://" + tempfile.mkdtemp(prefix="medfuse-llm-")
    return current


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The result has no lineage behind it, so a lost executor costs a re-read of the files and nothing more.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/medfuse-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._medfuse_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the files behind a ``cut`` that nothing reads any more."""
    path = getattr(df, "_medfuse_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with the columns of ``df`` (names compare without case, as Spark's do)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo ``modulus`` (NULL for a NULL key)."""
    return F.crc32(F.col(key).cast("string")) % modulus


