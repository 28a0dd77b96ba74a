"""The corpus pipeline: stages that each read what the one before has kept, written as Parquet in between.

1. ``language`` fits the classifier on a bounded sample of the labelled rows and drops texts it can't place: no letter, or a score below ``MIN_SCORE``.
2. ``near_copies`` keeps one document of each group of near copies, the one with the least id.
3. ``decontamination`` drops documents that repeat a benchmark item.
4. ``personal_data`` replaces personal data in the texts and sets n_chars anew.
5. ``packing`` packs the texts' tokens into sequences, one row per piece.

Nulls: a null text has no letter, so stage 1 drops it; a row without doc_id is judged by its text like any other. Empty tables pass as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm import decontam, jaccard, packing, pii
from studyloom.llm import language as lang
from studyloom.llm.common import free, table, written

#: Below the chance of guessing both the family and the language of a pair.
MIN_SCORE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose whole text the classifier can place. Input columns named like the model's keep their values; repeated rows are judged alike, and
    a score at the bound stays. Null, empty and letterless texts go; an empty table passes."""
    own = {c: free(f"own_{c}", docs.columns) for c in docs.columns if c.lower() in ("lang_pred", "score")}
    found = lang.predict(docs.withColumnsRenamed(own), lang.fit(docs))
    kept = found.where((F.col("lang_pred") != lang.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return kept.select([F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the least id; of repeated rows one stays. Texts without words all stay, of any length whole texts count,
    and columns of any name may stand beside."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that repeat no benchmark item anywhere in their text; each row is judged by itself, repeated ones and those without an id alike. Null and empty texts stay."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data in their whole texts replaced and n_chars set anew; null texts stay null."""
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; a null or empty text is its end id alone, repeated rows are packed one by one, other columns are not read."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", pack)]
#: Trained language models and tokens can't be written in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
