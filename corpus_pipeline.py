"""The corpus pipeline: five stages over ``documents``, each written to the shared folder and read again by the next.

Language ID, line dedup, SimHash near-dedup, benchmark decontamination, mixing to target weights.  Each stage calls the
operator of the same name with its production parameters; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medfuse.llm import crf_langid, fm_decontam, line_dedup, mixing, simhash
from medfuse.llm.common import cut, fresh, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with a score of 0.5 or more; texts that are NULL or have no letter go."""
    return crf_langid.keep_identified(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of recurring templates; ``n_chars`` follows, and documents left without a line go."""
    n_lines, n_dropped = fresh(docs, "n_lines", "n_dropped")
    slim = line_dedup.drop_recurring(docs).where((F.col(n_dropped) < F.col(n_lines)) | (F.col(n_lines) == 0))
    changed = F.col(n_dropped) > 0
    return slim.select(*[F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
                         if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by ``benchmark``."""
    return fm_decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents chosen for the target weights, once per pass, with the column ``epoch``."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("mix_sources", mix_sources),
]

#: The first stage's model has no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
