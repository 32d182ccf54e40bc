"""Corpus pipeline: language ID, line dedup, MinHash near-dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread for the next.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markerlake.llm.bpe import round_trip
from markerlake.llm.decontamination import contaminated
from markerlake.llm.language_id import learn, predict
from markerlake.llm.line_dedup import line_dedup
from markerlake.llm.near_dedup import near_components
from markerlake.llm.registry import tokenizer_path
from markerlake.llm.shared import broadcast_if_small, held_out, table, written


#: Letters below which a text is too short for its cosine to tell it from random vectors.
SHORT = 40


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is among ids (doc_id)."""
    ids = written(ids.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).distinct(), "pipeline-gone")
    return docs.join(broadcast_if_small(ids, ids.count()), "doc_id", "left_anti").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents to which no language can be given go: those without a letter, and those no more alike to any
    language's prototype than random vectors are (three standard deviations, 3 / sqrt of their length), unless they
    have fewer than SHORT letters. Where no lang can be learnt from, all documents with a letter stay."""
    model = learn(docs.filter(~held_out(F.col("doc_id"))))
    if not model["langs"]:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = predict(docs, model)
    short = F.length(F.regexp_replace("text", r"\P{L}+", "")) < SHORT
    return found.filter((F.col("lang_pred") != "und") & ((F.col("score") >= 3 / model["dim"] ** 0.5) | short)).select(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more share go from all but one; n_chars is counted again."""
    out = line_dedup(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest id stays."""
    return _without(docs, near_components(docs.select("doc_id", "text")).filter("NOT kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 or more of a benchmark item's five-word shingles go."""
    return _without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document left, as digests."""
    return round_trip(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", repeated_lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("bpe", bpe),
]

#: BPE is beyond SQL; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
