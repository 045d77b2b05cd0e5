"""A training corpus from `documents`: quality, boilerplate, near-duplicates, benchmark leaks, source weights.

Each stage works on what its predecessor kept. A document that loses all its words as boilerplate goes, as all its lines stay
in an earlier document. n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caretrail.llm import decontamination, line_dedup, mixing, near_text, quality_classifier, simhash
from caretrail.llm.common import materialize, table, text_of, without


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the rule ensemble rejects."""
    return quality_classifier.score_quality(docs, table(spark, sf_dir, "labels")).where("score >= 0.5").select("row.*")


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines of any length that are spread over many sites, but for their first document."""
    out = line_dedup.dedup_lines(docs)
    out = out.where((F.col("n_removed") == 0) | text_of("text").rlike("[^\\x20\\x09-\\x0D]"))
    fresh = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return out.select(*[fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts whose five-word shingles are similar to 0.8 or more."""
    return simhash.keep_first(docs, near_text.near_groups(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    found = decontamination.find_items(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0").select("doc_id", "text_key").distinct()
    return without(docs, materialize(found, "leaks"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as its source's weight asks for."""
    return mixing.emit(mixing.mix(docs, mixing.mix_plan(docs)))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_boilerplate),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix_sources),
]

#: The classifier and the fingerprints cannot be written in SQL; tests/llm holds run() against a brute-force form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
