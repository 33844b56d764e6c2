"""The corpus pipeline: language ID, line dedup, near-duplicate dedup, secret redaction and best-fit packing over `documents`.

`run` writes what each stage returns as Parquet to the folder in spark.checkpoint.dir and reads it again as the next
one's documents. All stages but the last return the columns of `documents`; each works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestitch.llm import langid, line_dedup, neardup_text, packing, secrets
from lodestitch.llm.common import cut
from lodestitch.session import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no text, or no letter in it) go."""
    return langid.keep_known(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; the documents stay."""
    return line_dedup.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (0.8 of their word shingles or more) stays, that of the smallest doc_id."""
    return neardup_text.keep_one(docs, percent=80)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; the documents stay."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokenised documents' pieces, with their sequences and places."""
    return packing.pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("redact", redact), ("pack", pack)]

#: No twin: SQL can't express the classifier, the tokenizer or the packing. The stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
