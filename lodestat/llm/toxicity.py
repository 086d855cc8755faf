"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm import text as T
from lodestat.llm.scratch import Scratch

#: Hashed n-gram features (a power of two), orders, and features in one block of counts.
BITS, ORDERS, BLOCK = 18, (4, 5), 4096
FEATURES = 1 << BITS
#: Groups in which the counts of input tasks are added up first.
TURNS = 64

_CLASS = np.full(256, 32, np.uint32)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[48:58] = np.arange(48, 58)
_CLASS[128:] = np.arange(128, 256)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed feature of every n-gram of letters; runs of all else, and both ends, are one space."""
    rows = len(offsets) - 1
    size = np.diff(offsets) + 2
    begin = np.cumsum(size) - size
    symbols = np.full(int(size.sum()), 32, np.uint32)
    row = np.repeat(np.arange(rows), size)
    symbols[np.arange(len(data)) + 2 * row_of(offsets, len(data)) + 1] = _CLASS[data]
    keep = symbols != 32
    keep[1:] |= (symbols[:-1] != 32) & (row[1:] == row[:-1])
    keep[begin] = True
    symbols, row = symbols[keep], row[keep]
    code, out = np.zeros(len(symbols), np.uint32), []
    for n in range(1, max(ORDERS) + 1):
        if len(symbols) < n:
            break
        m = len(symbols) - n + 1
        code = (code[:m] ^ (code[:m] >> np.uint32(13))) * np.uint32(0x01000193) + symbols[n - 1 :] * np.uint32(0x9E3779B1)
        if n in ORDERS:
            mixed = (code ^ (code >> np.uint32(16))) * np.uint32(0x2C1B3C6D)
            same = row[:m] == row[n - 1 :]
            out.append((row[:m][same], (mixed >> np.uint32(32 - BITS))[same]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    return np.concatenate([r for r, _ in out]), np.concatenate([f for _, f in out])


def row_of(offsets: np.ndarray, n: int) -> np.ndarray:
    """Row of each of the n bytes."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) if n else np.zeros(0, np.int64)


def _present(rows: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (row, feature) once, in order."""
    both = np.unique(rows.astype(np.int64) << BITS | found.astype(np.int64))
    return both >> BITS, both & (FEATURES - 1)


@dataclass
class ToxicityModel:
    """Weight of each hashed n-gram (zero for most) and the bias."""

    weights: np.ndarray
    bias: float


def _gathered(rates: dict[int, float]):
    """Per partition: documents with each feature by class, in blocks; and the texts drawn for the fit."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros((2, FEATURES), np.int32), np.zeros(2, np.int64)
        names = ["block", "label", "counts", "text"]
        types = (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string())
        for batch in frames:
            labels = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            turns = np.asarray(batch.column(1).to_numpy(zero_copy_only=False))
            drawn = turns < np.where(labels == 1, rates[1], rates[0])
            for low, _, data, offsets in T.slices(T.lower(batch.column(2))):
                rows, found = _present(*features(data, offsets))
                for label in (0, 1):
                    counts[label] += np.bincount(found[labels[low + rows] == label], minlength=FEATURES).astype(np.int32)
            seen += np.bincount(labels, minlength=2)
            n = int(drawn.sum())
            if n:
                columns = [[-1] * n, labels[drawn].tolist(), [None] * n, batch.column(2).filter(pa.array(drawn)).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        blocks = [(b, k, counts[k, b * BLOCK : (b + 1) * BLOCK]) for b in range(FEATURES // BLOCK) for k in (0, 1)]
        blocks += [(FEATURES // BLOCK, k, seen[k : k + 1].astype(np.int32)) for k in (0, 1)]
        columns = [[b for b, _, _ in blocks], [k for _, k, _ in blocks], [c.tolist() for _, _, c in blocks], [None] * len(blocks)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return run


def _summed(frame: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.asarray(c, np.int64) for c in frame["counts"]], axis=0)
    return pd.DataFrame({"block": [frame["block"].iloc[0]], "label": [frame["label"].iloc[0]], "counts": [total]})


def _logistic(starts: np.ndarray, at: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, decay: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and bias of L2-regularised logistic regression on sparse rows, by accelerated gradient steps."""
    row = np.repeat(np.arange(len(y)), np.diff(starts))
    w, b = np.zeros(width), 0.0
    w0, b0 = w, b
    norms = np.bincount(row, weights=values**2, minlength=len(y))
    step = 1.0 / (0.25 * (norms.mean() + 1.0) * 4 + decay)
    for k in range(rounds):
        v, c = w + (k / (k + 3)) * (w - w0), b + (k / (k + 3)) * (b - b0)
        z = np.bincount(row, weights=values * v[at], minlength=len(y)) + c
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        w0, b0 = w, b
        w = v - step * (np.bincount(at, weights=values * g[row], minlength=width) + decay * v)
        b = c - step * float(g.sum())
    return w, b


def labelled(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Texts with their labels. Labels grow with the texts, so both are shuffled whatever the size; it costs the texts once."""
    return texts.join(known.hint("merge"), "id")


def fit_toxicity_model(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 3000,
    selected: int = 4096,
    rounds: int = 400,
    decay: float = 1e-4,
    prior: float = 0.5,
    seed: int = 3,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
) -> ToxicityModel:
    """Learn from the documents that have a 0/1 label.

    Document counts of every n-gram by class are taken over all labelled rows; they give each n-gram its log-count
    ratio r. Of these the `selected` with the largest r against its standard error are kept. The logistic regression on
    presence times r is fitted on a bounded sample: about `per_class` documents of each class, drawn by a seeded hash of
    the id. Null labels teach nothing. With one class or none the model is the smoothed rate alone.

    Scores assume that `prior` of the texts are of label 1, whatever share of the sample they are: the sample's odds
    are taken out of the bias again. So neither `per_class` nor the size of the input moves a threshold.
    """
    scratch = Scratch(docs.sparkSession)
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).where("label in (0, 1)")
    many = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rates = {k: min(1.0, per_class / max(1, many.get(k, 0))) for k in (0, 1)}
    turn = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    rows = labelled(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), known).select("label", turn.alias("turn"), "text")
    parts = scratch.store(rows.mapInArrow(_gathered(rates), "block int, label int, counts array<int>, text string"))
    sums = parts.where("block >= 0").withColumn("turn", F.spark_partition_id() % TURNS)
    for by in (("block", "label", "turn"), ("block", "label")):  # so no task gets the blocks of all input tasks
        sums = sums.groupBy(*by).applyInPandas(_summed, "block int, label int, counts array<long>")
    counts, seen = np.zeros((2, FEATURES)), np.zeros(2)
    for r in sums.toLocalIterator():
        if r["block"] == FEATURES // BLOCK:
            seen[r["label"]] = r["counts"][0]
        else:
            counts[r["label"], r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = r["counts"]
    rate = (seen[1] + 1) / (seen.sum() + 2)
    weights = np.zeros(FEATURES, np.float32)
    if not seen.all():
        return ToxicityModel(weights, float(np.log(rate / (1 - rate))))
    p, q = (counts[1] + 0.5) / (seen[1] + 1), (counts[0] + 0.5) / (seen[0] + 1)
    ratio = np.log(p / q)
    error = np.sqrt(1 / (counts[1] + 0.5) + 1 / (counts[0] + 0.5))
    strength = np.where(counts.sum(axis=0) >= 3, np.abs(ratio) / error, 0.0)
    chosen = np.sort(np.argsort(-strength, kind="stable")[:selected])
    chosen = chosen[strength[chosen] > 2]
    index = np.full(FEATURES, -1)
    index[chosen] = np.arange(len(chosen))

    sample = parts.where("block < 0").select("label", "text").mapInPandas(_chosen(index), "label int, found array<int>").collect()
    scratch.drop(parts)
    sample.sort(key=lambda r: (r["label"], r["found"]))
    starts = np.cumsum([0] + [len(r["found"]) for r in sample])
    at = np.array([f for r in sample for f in r["found"]], np.int64)
    y = np.array([r["label"] for r in sample], float)
    scaled = ratio[chosen]
    w, bias = _logistic(starts, at, scaled[at], y, len(chosen), decay, rounds)
    bias += float(np.log(prior / (1 - prior)) - np.log(y.sum() / (len(y) - y.sum())))
    weights[chosen] = w * scaled
    return ToxicityModel(weights, bias)


def _chosen(index: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found_by_row: list[np.ndarray] = []
            for _, _, data, offsets in T.slices(T.lower(pa.array(frame["text"], pa.string()))):
                rows, found = features(data, offsets)
                hit = index[found] >= 0
                rows, found = _present(rows[hit], found[hit])
                found_by_row += np.split(index[found], np.searchsorted(rows, np.arange(1, len(offsets) - 1)))
            yield pd.DataFrame({"label": frame["label"], "found": found_by_row})

    return run


def _scorer(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.full(batch.num_rows, model.bias)
            for low, _, data, offsets in T.slices(T.lower(batch.column(1))):
                rows, found = features(data, offsets)
                hit = model.weights[found] != 0
                rows, found = _present(rows[hit], found[hit])
                z += np.bincount(low + rows, weights=model.weights[found], minlength=len(z))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["key", "score"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Score every whole text: `keep` and score in (0, 1), higher where label 1 is likelier.

    Null and empty texts get the score of no n-gram. Repeated rows are scored each; other columns are ignored.
    """
    rows = docs.select(F.col(keep).alias("key"), F.col(text_column).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(_scorer(model), f"key {kind}, score double").withColumnRenamed("key", keep)
