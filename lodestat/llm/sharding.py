"""Proportional stratified interleaving of documents into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.llm.scratch import Scratch

#: Rows of a bucket that one window sorts, on average.
BUCKET_ROWS = 8192
#: Buckets whose running totals one window adds up.
TOTALS = 4096


def _running(counts: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Add `before`: rows in earlier buckets of the same keys. Two levels, so no window holds all buckets."""
    coarse = counts.withColumn("high", F.floor(F.col(bucket) / TOTALS))
    step = coarse.groupBy(*keys, "high").agg(F.sum("n").alias("high_n"))
    upto = Window.partitionBy(*keys).orderBy("high").rowsBetween(Window.unboundedPreceding, -1)
    step = step.withColumn("high_before", F.coalesce(F.sum("high_n").over(upto), F.lit(0))).drop("high_n")
    inside = Window.partitionBy(*keys, "high").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return (
        coarse.withColumn("low_before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(step, [*keys, "high"])
        .withColumn("before", F.col("high_before") + F.col("low_before"))
        .drop("high", "high_before", "low_before")
    )


def shard_documents(
    docs: DataFrame, shards: int = 16, seed: int = 17, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text"
) -> DataFrame:
    """Deal documents into `shards` shards of equal row counts (at most one apart) that all match the source mixture.

    Rows of a source are shuffled by a seeded hash and ranked; rank r of n becomes the fraction (r - u) / n, where u in
    [0, 1) is a seeded hash of the source, so that small sources do not pile up at one place. All rows sorted by that
    fraction are cut into equal parts: every shard then holds each source's share, one row more or less.

    Returns doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null: counts rule here, not keys) and
    fraction. Null source is a source of its own; null text has size 1 and the checksum of no bytes; a null id is an id
    like any other. Rows repeated in full are interchangeable. Other columns are ignored. No row: no row.

    Ranks come from hash buckets of about BUCKET_ROWS rows and running totals of bucket counts, so a source with most
    rows is just more buckets. Texts are never shuffled, only their size and checksum.
    """
    scratch = Scratch(docs.sparkSession)
    total = docs.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    text = F.coalesce(F.col(text_column), F.lit(""))
    source = F.coalesce(F.concat(F.lit("="), F.col(source_column).cast("string")), F.lit(""))
    turn = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))), 1, 16)
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        source.alias("src"),
        turn.alias("turn"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
    ).withColumn("b", F.floor(F.conv(F.substring("turn", 1, 7), 16, 10).cast("double") / float(16**7) * buckets))

    counts = rows.groupBy("src", "b").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("src").agg(F.sum("n").alias("src_n"))
    before = _running(counts, ["src"], "b").join(sizes, "src").drop("n")
    ranked = rows.withColumn(
        "rn", F.row_number().over(Window.partitionBy("src", "b").orderBy("turn", "doc_id", "size", "text_crc32"))
    ).join(before, ["src", "b"])
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("src"))), 1, 13), 16, 10).cast("double") / float(2**52)
    ranked = ranked.select(
        "doc_id", "src", "turn", "size", "text_crc32", ((F.col("before") + F.col("rn") - offset) / F.col("src_n")).alias("fraction")
    ).withColumn("f", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)))
    ranked = scratch.store(ranked)

    starts = _running(ranked.groupBy("f").agg(F.count("*").alias("n")), [], "f").drop("n")
    order = Window.partitionBy("f").orderBy("fraction", "src", "turn", "doc_id", "size", "text_crc32")
    place = F.col("before") + F.col("rn") - 1
    total = max(total, 1)
    return (
        ranked.withColumn("rn", F.row_number().over(order))
        .join(starts, "f")
        .withColumn("place", place)
        .withColumn("shard", F.expr(f"cast((place * {shards}) div {total} as int)"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            F.expr(f"place - (shard * {total}L + {shards - 1}) div {shards}").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "fraction",
        )
    )
