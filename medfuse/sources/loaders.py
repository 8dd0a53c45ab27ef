"""Table loaders.

One loader that honours its path and format.  CSV with a schema is read in
PERMISSIVE mode with a corrupt-record column, so a malformed value is visible
instead of silently turning NULL; without a schema the header is used and types
are inferred (one extra pass, avoid at scale).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType

CORRUPT_COL = "_corrupt_record"


def _format_of(path: str, fmt: str | None) -> str:
    if fmt:
        return fmt
    p = path.lower().rstrip("/")
    for ext in ("parquet", "csv", "json", "orc"):
        if p.endswith("." + ext):
            return ext
    return "parquet"


def load_table(spark: SparkSession, path: str, schema: StructType | None = None,
               fmt: str | None = None, keep_corrupt: bool = False) -> DataFrame:
    """Read one table.  ``schema`` given -> no inference pass.

    For CSV with a schema, rows whose fields do not parse keep their raw text in
    ``_corrupt_record`` (``keep_corrupt=True``) so they can be quarantined.
    """
    kind = _format_of(path, fmt)
    reader = spark.read
    if kind == "csv":
        reader = reader.option("header", True)
        if schema is not None:
            read_schema = schema
            if keep_corrupt:
                read_schema = StructType(list(schema.fields) + [StructField(CORRUPT_COL, StringType(), True)])
            reader = (reader.schema(read_schema).option("mode", "PERMISSIVE")
                      .option("columnNameOfCorruptRecord", CORRUPT_COL))
            df = reader.csv(path)
            return df if keep_corrupt else df.drop(CORRUPT_COL) if CORRUPT_COL in df.columns else df
        return reader.option("inferSchema", True).csv(path)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(kind).load(path)


def load_modalities(spark: SparkSession, paths: dict[str, str],
                    schemas: dict[str, StructType] | None = None) -> dict[str, DataFrame]:
    """Load each named modality table; every table must carry ``Patient_ID``."""
    schemas = schemas or {}
    out = {}
    for name, path in paths.items():
        df = load_table(spark, path, schemas.get(name))
        if "Patient_ID" not in df.columns:
            raise ValueError(f"modality {name!r} at {path} has no Patient_ID column")
        out[name] = df
    return out


def corrupt_rows(df: DataFrame) -> DataFrame:
    """Rows a PERMISSIVE CSV read could not parse (needs ``keep_corrupt=True``)."""
    return df.where(F.col(CORRUPT_COL).isNotNull())
