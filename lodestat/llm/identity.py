"""Identity of a row where ids are null or repeat: id, hash of the text, and a number among rows equal in both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.llm.scratch import Scratch

#: Working columns of named rows: id, hash of the text, and whether the row repeats another one.
ID, CONTENT, AGAIN = "_row_id", "_row_content", "_row_again"


def content(text: str) -> Column:
    return F.xxhash64(F.col(text))


def named(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.withColumns({ID: F.col(id_column).cast("long"), CONTENT: content(text_column)})


def same(other_id: str, other_content: str) -> Column:
    """Join condition of named rows; null ids are equal, and their texts deal them out."""
    return F.col(ID).eqNullSafe(F.col(other_id)) & (F.col(CONTENT) == F.col(other_content))


def mark_copies(rows: DataFrame, copies: DataFrame, scratch: Scratch) -> DataFrame:
    """Named rows with AGAIN: false for one of the rows of each (id, content) of `copies` and for all other rows.

    `copies` is a written table of what occurs more than once. Only those rows are written, each with a number; the least
    of a group, found by an aggregation, is its first, so no group meets in one task.
    """
    if copies.isEmpty():
        return rows.withColumn(AGAIN, F.lit(False))
    keys = copies.select(F.col(ID).alias("_copy_id"), F.col(CONTENT).alias("_copy_content"))
    match = same("_copy_id", "_copy_content")
    number = F.monotonically_increasing_id()
    many = scratch.store(rows.join(keys, match, "left_semi").withColumn("_row_number", number))
    first = many.groupBy(ID, CONTENT).agg(F.min("_row_number").alias("_row_number")).select("_row_number", F.lit(False).alias(AGAIN))
    many = many.join(first, "_row_number", "left").withColumn(AGAIN, F.coalesce(AGAIN, F.lit(True))).drop("_row_number")
    return rows.join(keys, match, "left_anti").withColumn(AGAIN, F.lit(False)).unionByName(many)


def dealt(docs: DataFrame, id_column: str, text_column: str, batches: int, scratch: Scratch) -> DataFrame:
    """(batch, doc_id, text): rows dealt into batches by id and text, and rows equal in both by a number of their own.

    A retry deals a row alike: the numbers are stored with the rows that need one.
    """
    rows = named(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), "doc_id", "text")
    copies = scratch.store(rows.groupBy(ID, CONTENT).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(ID).alias("_copy_id"), F.col(CONTENT).alias("_copy_content")))
    batch = lambda *by: F.pmod(F.xxhash64(*by), F.lit(batches)).cast("int").alias("batch")
    out = lambda df, *by: df.select(batch(*by), F.col(ID).alias("doc_id"), "text")
    if copies.isEmpty():
        return out(rows, ID, CONTENT)
    match = same("_copy_id", "_copy_content")
    many = scratch.store(rows.join(copies, match, "left_semi").withColumn("_row_number", F.monotonically_increasing_id()))
    return out(rows.join(copies, match, "left_anti"), ID, CONTENT).unionByName(out(many, "_row_number"))
