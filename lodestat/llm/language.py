"""Language identification by nearest clustered centroid of TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.llm import text as T
from lodestat.llm.scratch import Scratch

#: Hashed n-gram dimensions; orders of the n-grams.
DIMENSIONS, ORDERS = 4096, (1, 2, 3)
UNKNOWN = "und"
#: A document nearer than this share of the lowest training similarity of its language and length is kept.
SLACK = 0.55

_CLASS = np.full(256, 32, np.uint32)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[97:123] = True


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed byte n-grams per row; all that is no letter is one space."""
    rows = len(offsets) - 1
    symbols = _CLASS[data]
    row = np.repeat(np.arange(rows), np.diff(offsets))
    keep = symbols != 32
    keep[1:] |= (symbols[:-1] != 32) & (row[1:] == row[:-1])
    symbols, row = symbols[keep], row[keep]
    total = np.zeros(rows * DIMENSIONS, np.int64)
    code = np.zeros(len(symbols), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(symbols) < n:
            break
        m = len(symbols) - n + 1
        code = code[:m] * np.uint32(0x01000193) + symbols[n - 1 :] + np.uint32(1)
        if n in ORDERS:
            mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            same = row[:m] == row[n - 1 :]
            key = row[:m] * DIMENSIONS + (mixed >> np.uint32(20)).astype(np.int64)
            total += np.bincount(key[same], minlength=len(total))
    return total.reshape(rows, DIMENSIONS)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row has a letter of any script."""
    plain = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    found = plain[offsets[1:]] > plain[offsets[:-1]]
    for k in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[k] = any(map(str.isalpha, data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")))
    return found


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(counts.astype(np.float32)) * idf)


def _band(counts: np.ndarray) -> np.ndarray:
    """Length band: by different n-grams, so that a text which repeats itself counts as the short one it is."""
    return np.log2(np.maximum(np.count_nonzero(counts, axis=1), 1)).astype(np.int64)


@dataclass
class LanguageModel:
    """Centroids (unit rows), their languages, inverse document frequencies and the least similarity by language and length band."""

    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    least: dict[str, dict[int, float]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in T.slices(T.lower(batch.column(1)), rows=256):
            ok = has_letter(data, offsets)
            counts = term_counts(data, offsets)[ok]
            names = batch.column(0).slice(low, high - low).filter(pa.array(ok))
            flat = pa.array(counts.astype(np.int32).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, counts.size + 1, DIMENSIONS), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([names, lists], ["lang", "counts"])


def _frequencies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, n = np.zeros(DIMENSIONS, np.int64), 0
    for frame in frames:
        for counts in frame["counts"]:
            total += np.asarray(counts) > 0
            n += 1
    yield pd.DataFrame({"i": np.append(np.arange(DIMENSIONS), -1), "n": np.append(total, n)})


def _clustered(idf: np.ndarray, clusters: int, rounds: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        counts = np.stack([np.asarray(c) for c in frame["counts"]])
        order = np.lexsort(counts.T[:: DIMENSIONS // 64])
        counts = counts[order]
        x = _vectors(counts, idf)
        centers = [int(np.argmax(x @ _unit(x.mean(axis=0, keepdims=True))[0]))]
        near = x @ x[centers[0]]
        while len(centers) < min(clusters, len(x)):  # the farthest from those chosen
            centers.append(int(np.argmin(near)))
            near = np.maximum(near, x @ x[centers[-1]])
        c = x[centers]
        for _ in range(rounds):
            own = np.argmax(x @ c.T, axis=1)
            c = _unit(np.stack([x[own == k].sum(axis=0) if (own == k).any() else c[k] for k in range(len(c))]))
        least = pd.Series((x @ c.T).max(axis=1)).groupby(_band(counts)).min()
        bands = [(int(b), float(v)) for b, v in least.items()]
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "centroid": list(c.astype(np.float64)), "bands": [[b for b, _ in bands]] * len(c), "least": [[v for _, v in bands]] * len(c)})

    return run


def fit_language_model(
    labelled: DataFrame, per_language: int = 600, clusters: int = 4, rounds: int = 8, seed: int = 5, text_column: str = "text", lang_column: str = "lang"
) -> LanguageModel:
    """Learn `clusters` centroids per language by spherical k-means.

    The fit uses a bounded sample: at most `per_language` different texts of each language, those with the least seeded
    hash of the text. Rows with null language or no letter teach nothing. Only centroids reach the driver.
    """
    scratch = Scratch(labelled.sparkSession)
    rows = labelled.select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text")).where("lang is not null and text is not null")
    many = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n"))
    turn = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    # one row for each language, far less than the centroids that every task holds anyway; so no text is shuffled by language
    drawn = rows.join(F.broadcast(many), "lang").withColumn("turn", turn).where(F.col("turn") * F.col("n") < 2.0 * per_language + 50)
    drawn = drawn.select("lang", "text", "turn").distinct()  # copies share a turn: one stands for all
    drawn = drawn.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("turn", "text"))).where(F.col("rn") <= per_language)
    counted = scratch.store(drawn.select("lang", "text").mapInArrow(_counted, "lang string, counts array<int>"))
    df = {r["i"]: r["n"] for r in counted.mapInPandas(_frequencies, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    n = df.get(-1, 0)
    idf = np.log((1.0 + n) / (1.0 + np.array([df.get(i, 0) for i in range(DIMENSIONS)]))).astype(np.float32) + np.float32(1)
    fitted = counted.groupBy("lang").applyInPandas(_clustered(idf, clusters, rounds), "lang string, centroid array<double>, bands array<int>, least array<double>")
    found = sorted(fitted.collect(), key=lambda r: (r["lang"], r["centroid"]))
    scratch.drop(counted)
    least = {r["lang"]: dict(zip(r["bands"], r["least"], strict=True)) for r in found}
    centroids = np.array([r["centroid"] for r in found], np.float32).reshape(len(found), DIMENSIONS)
    return LanguageModel([r["lang"] for r in found], centroids, idf, least)


def _predictor(model: LanguageModel, column: int):
    names = np.array([*model.languages, UNKNOWN], object)
    # a length that a language's training lacks takes the bound of the next shorter one; below all of them the bound
    # falls with the root of the length, as the cosine of a part of the n-grams does
    bounds = np.zeros((len(model.languages) + 1, 64))
    for k, language in enumerate(model.languages):
        for n, (band, least) in enumerate(sorted(model.least[language].items())):
            if n == 0:
                bounds[k, :band] = SLACK * least * 0.5 ** ((band - np.arange(band)) / 2)
            bounds[k, band:] = SLACK * least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, _, data, offsets in T.slices(T.lower(batch.column(column)), rows=256):
                ok = has_letter(data, offsets) & bool(len(model.languages))
                counts = term_counts(data, offsets)
                score, best = np.zeros(len(ok)), np.full(len(ok), len(model.languages))
                if len(model.languages):
                    near = _vectors(counts, model.idf) @ model.centroids.T
                    best = np.where(ok, near.argmax(axis=1), best)
                    score = np.where(ok, np.clip(near.max(axis=1), 0, 1), 0.0).astype(np.float64)
                parts.append((names[best], score, ~ok | (score < bounds[best, _band(counts)])))
            added = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(3)]
            types = (pa.string(), pa.float64(), pa.bool_())
            arrays = [c for k, c in enumerate(batch.columns) if k != column]
            labels = [name for k, name in enumerate(batch.schema.names) if k != column]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(a, t) for a, t in zip(added, types, strict=True))], [*labels, "lang_pred", "score", "rejected"])

    return run


def identify_language(docs: DataFrame, model: LanguageModel, keep: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Predict the language of every whole text.

    Returns `keep`, lang_pred, score (cosine with the nearest centroid) and rejected. Rejected are texts that are null
    or have no letter (lang_pred 'und', score 0) and texts farther from every centroid than SLACK allows for the
    language predicted and their length. A model of no language rejects all. Repeated rows are predicted each; other columns are ignored.
    """
    rows = docs.select(F.col(keep), F.col(text_column).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(_predictor(model, 1), f"`{keep}` {kind}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel, text_column: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text the model does not reject."""
    columns = docs.columns
    at = columns.index(text_column)
    predict = _predictor(model, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for answer in predict(iter([batch])):
                yield batch.filter(pc.invert(answer.column(answer.num_columns - 1)))

    return docs.mapInArrow(run, docs.schema)
