"""Rows without an id of their own are dealt over all batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestat.llm.identity import dealt
from lodestat.llm.lm_scoring import stupid_backoff_scores
from lodestat.llm.scratch import Scratch


def test_copies_without_an_id_are_spread(spark):
    copies = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same words").alias("text"))
    others = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    rows = dealt(copies.union(others), "doc_id", "text", 64, Scratch(spark))
    sizes = [r["count"] for r in rows.groupBy("batch").count().collect()]
    assert sum(sizes) == 101_000 and len(sizes) == 64 and max(sizes) < 2 * 101_000 / 64
    assert rows.where("doc_id is not null").distinct().count() == 1000


def test_scores_do_not_depend_on_the_batches(spark):
    rows = [(k if k % 3 else None, " ".join(f"w{(k * j * j + j) % 23}" for j in range(k % 40))) for k in range(120)]
    rows += [(None, "w1 w2 w3 w4"), (None, "w1 w2 w3 w4"), (7, None), (7, ""), (8, "w5 " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shown = lambda **by: sorted((str(r["doc_id"]), r["n_tokens"], r["n_backoff"], round(r["log_score"], 6)) for r in stupid_backoff_scores(docs, **by).collect())
    assert shown() == shown(batch_bytes=500, bucket_grams=40)
