"""A training-corpus pipeline: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm.decontamination import without_contaminated
from lodestat.llm.language import fit_language_model, keep_identified
from lodestat.llm.line_dedup import without_repeated_lines
from lodestat.llm.ngram_join import keep_one
from lodestat.llm.packing import pack_documents
from lodestat.llm.queries import held_out, table, word_tokenizer
from lodestat.llm.scratch import Scratch


def identified_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language; those without a letter, or far from every language, go."""
    return keep_identified(docs, fit_language_model(docs.where(~held_out())))


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line resembles; those with no line left go."""
    kept = without_repeated_lines(docs, counted="_n_removed").where("_n_removed = 0 or trim(text) != ''")
    n_chars = F.when(F.col("_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).select(*docs.columns)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row per piece of a document."""
    return pack_documents(docs, word_tokenizer())


STAGES = [
    ("language", identified_language),
    ("line_dedup", unrepeated_lines),
    ("ngram_join", one_of_similar),
    ("decontamination", uncontaminated),
    ("packing", packed),
]

#: A fitted model and a tokenizer decide, which SQL can not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again by the next one."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
