"""One registered query for each operator of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm.decontamination import contaminated
from lodestat.llm.embedding_dedup import near_vectors
from lodestat.llm.language import fit_language_model, identify_language
from lodestat.llm.line_dedup import without_repeated_lines
from lodestat.llm.lm_scoring import stupid_backoff_scores
from lodestat.llm.merkle_manifest import FIELDS, folded, leaf_hash, merkle_manifest, path_hash
from lodestat.llm.ngram_join import jaccard_groups
from lodestat.llm.packing import pack_documents
from lodestat.llm.periodic_runs import periodic_runs
from lodestat.llm.phrase_dedup import without_recurring
from lodestat.llm.sharding import shard_documents
from lodestat.llm.sql import all_sql
from lodestat.llm.suffix_dedup import without_repeats
from lodestat.llm.toxicity import fit_toxicity_model, score_toxicity

__all__ = ["all_queries", "all_sql"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    """Place of the tokenizer file, which is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram stupid-backoff score of every document by the counts of all others."""
    scored = stupid_backoff_scores(table(spark, sf_dir, "documents"))
    mean = F.col("log_score") / F.col("n_tokens")
    return scored.select("doc_id", "n_tokens", "n_backoff", F.round("log_score", 4).alias("log_score"), F.when(F.col("n_tokens") > 0, F.round(mean, 6)).alias("mean_score"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 400-byte strings that occur elsewhere too."""
    cut = without_repeats(table(spark, sf_dir, "documents"))
    n_removed = F.col("n_bytes") - F.octet_length("kept")
    return cut.select("doc_id", "n_bytes", n_removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows with crc32(doc_id) mod 3 = 1 are held out of the training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity_model(docs.where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share 0.8 of their five-word shingles."""
    return jaccard_groups(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label with a cosine of 0.98 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; rows with crc32(doc_id) mod 3 = 1 are held out of the training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language_model(docs.where(~held_out()))
    found = identify_language(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that resemble an earlier one: lines removed and checksum of what is left."""
    kept = without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item or an edited copy of one, with the alignment score."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), word_tokenizer())


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt into 16 shards of the same mixture of sources."""
    return shard_documents(table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 20-word windows that start earlier too."""
    kept = without_recurring(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return kept.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document; one of seven is tampered with, which its proof must show."""
    forged = leaf_hash(*(F.col(c).cast("long") + 1 if c == "n_chars" else F.col(c) for c in FIELDS))
    touched = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaf = leaf_hash(*map(F.col, FIELDS))
    found = merkle_manifest(table(spark, sf_dir, "documents"), also={"start": F.when(touched, forged).otherwise(leaf)})
    found = found.withColumn("folded_root", folded(F.col("start"), F.col("path")))
    verified = (F.col("folded_root") == F.col("root")).alias("verified")
    return found.select("doc_id", "leaf", "subroot", "root", path_hash(F.col("path")).alias("proof_sha256"), "folded_root", verified)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten, by the checksum of its id, repeats a stretch of its words up to its end."""
    words = F.regexp_extract_all("text", F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.withColumn("_w", F.when(h % 10 == 0, words)).withColumn("_n", F.size("_w").cast("long"))
    g = F.floor(h / 10)
    docs = docs.withColumn("_a", F.when(F.col("_n") > 0, g % F.col("_n")))
    docs = docs.withColumn("_p", F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8)) + 1)
    repeat = "transform(sequence(0L, _n - 1), i -> element_at(_w, int(1 + if(i < _a, i, _a + (i - _a) % _p))))"
    text = F.when(F.col("_n") > 0, F.array_join(F.expr(repeat), " ")).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, some of which get one, and its text without the repeats."""
    found = periodic_runs(with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.expr("array_max(transform(runs, r -> struct(r.length / r.period as e, -r.start as s, -r.period as p, r as r))).r")
    found = found.withColumn("best", best)
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    milli = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long")
    shown = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *shown, milli.alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (op1_lm_scoring, op2_suffix_dedup, op3_toxicity, op4_ngram_join, op5_embedding_dedup, op6_language, op7_line_dedup, op8_decontamination, op9_packing, op10_sharding)
    operators += (op11_substring_dedup, op12_merkle_manifest, op13_periodic_runs)
    return {f.__name__: f for f in (*operators, pipeline)}
