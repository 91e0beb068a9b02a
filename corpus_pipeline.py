"""A training corpus from documents: five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents; columns that documents has beyond COLUMNS pass through every stage
untouched, whatever their names. Every stage takes an empty table, and rows with nulls in any column.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isobath.llm import decontamination, language_id, line_dedup, mixing, near_dedup
from isobath.llm.shared import WORD, scratch, shared_dir, table

#: Predictions below this score, texts without a letter, and texts of no learned language are rejected.
LEAST_SCORE = 0.2
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keeping_columns(stage: Callable) -> Callable:
    """The stage on COLUMNS alone by name; further columns travel under names of their own and come back in their places."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        hidden = [c if c in COLUMNS else f"extra_{i}" for i, c in enumerate(docs.columns)]
        out = stage(spark, docs.toDF(*hidden), sf_dir)
        added = [c for c in out.columns if c not in hidden and c not in docs.columns]
        return out.select(*[F.col(h).alias(c) for h, c in zip(hidden, docs.columns, strict=True)], *added)

    return run


@keeping_columns
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is told with a score of at least LEAST_SCORE and whose trigrams are usual in it.

    Null, empty and letterless texts go, as no language can be told. Equal texts, repeated rows among them, go or
    stay together. A text of any length is judged whole. Learned from all labelled rows that are not held out, and held against all that are.
    """
    model = language_id.learn(docs)
    found = language_id.identify(docs, model, language_id.calibrate(docs, model))
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE) & ~F.col("foreign")).select(*docs.columns)


@keeping_columns
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated line chunks; a document of which no word is left goes, and n_chars follows the text.

    The first occurrence by doc_id stays, null first. Null and empty texts stay as they are. Rows with equal doc_id
    and text are one document and keep the same lines.
    """
    cleaned = line_dedup.dedup_lines(docs)
    left = cleaned.filter((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


@keeping_columns
def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies (five-word shingles, similarity 0.8).

    Null and wordless texts are near to nothing and stay, as do rows without doc_id, which name no group. Of rows
    with one doc_id all stay or all go.
    """
    return near_dedup.keep_one(docs)


@keeping_columns
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a benchmark item is found, judged row by row, so a null or repeated doc_id is no matter.

    Null and wordless texts contain nothing and stay. Equal rows go or stay together.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@keeping_columns
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits every document as often as the mixture takes it, with the number of the copy.

    Null sources are one source; null texts have size 0 and are taken as their source's rate says; rows without
    doc_id draw by their text.
    """
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written into the shared folder and read again; what a stage wrote on its way is deleted."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
