"""Benchmark decontamination: rare pairs of near words as seeds, a lossless count filter, then Smith-Waterman alignment.

With MATCH = 2 and -1 an error, an alignment of score s with M matched words has e <= 2 M - s errors. Of the M - 1 pairs
of consecutive matched words, z0 have no error between them and z1 have one, so 2 z0 + z1 >= 2 (M - 1) - e >= s - 2. Such
pairs are one or two words apart, in the item and in the text. So a copy shares pairs of that weight with its item, and
pairs that start at half as many words of the item at least: whichever others are left out, a seed remains.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestat.llm import text as T

#: Words of the shortest item, least share of the best score.
WORDS, SCORE = 3, 0.5
#: Alignment scores of a match, a mismatch and a gap of one word.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Test items whose pairs are held at once.
ITEMS = 20_000
#: Pairs that a task expands at once.
_PAIRS = 1 << 21


@dataclass
class Items:
    """A block of test items: ids, word hashes, and their word pairs (hash, item, position, distance), ordered by item."""

    ids: list
    words: list[np.ndarray]
    grams: np.ndarray
    item: np.ndarray
    at: np.ndarray
    gap: np.ndarray
    seeds: np.ndarray

    def __post_init__(self):
        self.size = np.array([len(w) for w in self.words])
        self.first = np.searchsorted(self.item, np.arange(len(self.words) + 1))


def _pairs(h: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, position and distance of every two words of a row that are one or two words apart."""
    out = []
    for gap in (1, 2):
        at = np.flatnonzero(r[:-gap] == r[gap:])
        one = h[at]
        out.append((T.mix((one ^ (one >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[at + gap]), at, np.full(len(at), gap)))
    grams, at, gap = (np.concatenate(x) for x in zip(*out, strict=True))
    return grams, at, gap


def _needed(size: np.ndarray, score: float) -> np.ndarray:
    """Least alignment score of a copy."""
    return np.ceil(MATCH * size * score - 1e-9).astype(np.int64)


def _blocks(benchmark: DataFrame, id_column: str, text_column: str) -> Iterator[Items]:
    """The benchmark in blocks of ITEMS items, so that no broadcast grows with it."""
    rows = benchmark.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("text is not null").toLocalIterator()
    while True:
        some = [r for _, r in zip(range(ITEMS), rows, strict=False)]
        if not some:
            return
        words, pairs, item = [], [], []
        for k, r in enumerate(some):
            h = np.zeros(0, np.uint64)
            for _, _, data, offsets in T.slices(T.lower(pa.array([r["text"]]))):
                h, _ = T.word_hashes(data, offsets)
            words.append(h)
            h = h if len(h) >= WORDS else h[:0]
            pairs.append(_pairs(h, np.zeros(len(h), np.int64)))
            item.append(np.full(len(pairs[-1][0]), k))
        g, a, d = (np.concatenate(x) for x in zip(*pairs, strict=True))
        yield Items([r["id"] for r in some], words, g, np.concatenate(item), a, d, np.ones(len(g), bool))


def _frequencies(wanted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for _, _, data, offsets in T.slices(T.lower(batch.column(0))):
                g, _, _ = _pairs(*T.word_hashes(data, offsets))
                where = np.minimum(np.searchsorted(wanted, g), len(wanted) - 1)
                counts += np.bincount(where[wanted[where] == g], minlength=len(wanted))
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts[found])], ["i", "n"])

    return run


def _choose_seeds(texts: DataFrame, items: Items, score: float) -> None:
    """Mark the pairs at the rarest words of each item, counted over all texts, without which no copy can be.

    A copy shares pairs that start at (s - 2) / 2 words at least (see above), so all but one less of those are enough.
    """
    wanted = np.unique(items.grams)
    if not len(wanted):
        return
    least = _needed(items.size[items.size >= WORDS], score)
    if least.min() < 3:
        raise ValueError("score is so low that a single word of the shortest item reaches it")
    counts = np.zeros(len(wanted), np.int64)
    for r in texts.mapInArrow(_frequencies(wanted), "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["i"]] = r["n"]
    frame = pd.DataFrame({"item": items.item, "at": items.at, "n": counts[np.searchsorted(wanted, items.grams)]})
    starts = frame.groupby(["item", "at"], as_index=False)["n"].sum()
    size = items.size[starts["item"]]
    use = starts.groupby("item")["n"].rank(method="first") <= size - (_needed(size, score) - 1) // 2
    items.seeds = frame.merge(starts.assign(use=use), on=["item", "at"], how="left")["use"].to_numpy(bool)


def align(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Best Smith-Waterman score of each pair of word sequences."""
    out = np.zeros(len(left), np.int64)
    for low in range(0, len(left), 256):
        a, b = left[low : low + 256], right[low : low + 256]
        m, w = max(map(len, a)), max(map(len, b))
        x, y = np.zeros((len(a), m), np.uint64), np.zeros((len(a), w), np.uint64)
        has_x, has_y = np.zeros((len(a), m), bool), np.zeros((len(a), w), bool)
        for k, (p, q) in enumerate(zip(a, b, strict=True)):
            x[k, : len(p)], has_x[k, : len(p)], y[k, : len(q)], has_y[k, : len(q)] = p, True, q, True
        best = np.zeros(len(a), np.int64)
        above = np.zeros((len(a), w + 1), np.int64)
        slope = np.arange(w + 1) * GAP
        for i in range(m):
            same = (y == x[:, i : i + 1]) & has_y & has_x[:, i : i + 1]
            row = np.zeros_like(above)
            row[:, 1:] = np.maximum(0, np.maximum(above[:, :-1] + np.where(same, MATCH, MISMATCH), above[:, 1:] + GAP))
            row = np.maximum.accumulate(row - slope, axis=1) + slope  # gaps along the text
            best = np.maximum(best, row.max(axis=1))
            above = row
        out[low : low + 256] = best
    return out


def _expand(low: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the run and place of every element of the runs low..low + many."""
    run = np.repeat(np.arange(len(low)), many)
    return run, low[run] + np.arange(len(run)) - (np.cumsum(many) - many)[run]


def _windows(items: Items, score: float, row: np.ndarray, item: np.ndarray, g: np.ndarray, at: np.ndarray, gap: np.ndarray, r: np.ndarray) -> np.ndarray:
    """(row, item, lane) of the windows that share enough pairs for a copy of the item.

    A copy covers 3 n - s words of text at most, so it lies in two adjacent lanes of that width.
    """
    salt = T.mix(np.arange(int(r[-1]) + 1, dtype=np.uint64) + np.uint64(0x51ED27))
    wanted = np.isin(r[at], row)
    at, gap = at[wanted], gap[wanted]
    own = T.mix(g[wanted] ^ salt[r[at]])
    order = np.argsort(own)
    own, at, gap = own[order], at[order], gap[order]
    many = items.first[item + 1] - items.first[item]
    out = []
    low = 0
    total = np.cumsum(many)
    while low < len(row):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + _PAIRS, "right")))
        pair, pick = _expand(items.first[item[low:high]], many[low:high])
        key = T.mix(items.grams[pick] ^ salt[row[low:high][pair]])
        left = np.searchsorted(own, key, "left")
        n = np.searchsorted(own, key, "right") - left
        start, held = 0, np.cumsum(n)
        cuts = np.flatnonzero(np.diff(pair, prepend=-1))
        # whole candidates at a time
        while start < len(pair):
            stop = np.searchsorted(cuts, np.searchsorted(held, (held[start - 1] if start else 0) + _PAIRS, "right"), "right")
            stop = max(int(cuts[stop - 1]) if stop < len(cuts) else len(pair), int(np.append(cuts, len(pair))[np.searchsorted(cuts, start, "right")]))
            of, place = _expand(left[start:stop], n[start:stop])
            of += start
            which, where = pair[of] + low, at[place]
            one = (items.gap[pick[of]] == 1) & (gap[place] == 1)
            lane = where // (3 * items.size[item[which]] - _needed(items.size[item[which]], score))
            which, lane, word, one = np.tile(which, 2), np.append(lane, lane - 1), np.tile(items.at[pick[of]], 2), np.tile(one, 2)
            order = np.lexsort((~one, word, lane, which))
            which, lane, word, one = which[order], lane[order], word[order], one[order]
            lanes = (np.diff(which, prepend=-1) != 0) | (np.diff(lane, prepend=-2) != 0)
            fresh = lanes | (np.diff(word, prepend=-1) != 0)
            first = np.flatnonzero(lanes)
            if len(first):
                weight = np.add.reduceat(np.where(fresh, 1 + one, 0), first)
                which, lane = which[first], lane[first]
                enough = weight >= _needed(items.size[item[which]], score) - 2
                out.append(np.stack([row[which], item[which], lane])[:, enough])
            start = stop
        low = high
    return np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)


def _hits(items: Items, data: np.ndarray, offsets: np.ndarray, score: float) -> list[tuple[int, int, float]]:
    """(row, item, share of the best possible score) of every item that aligns with a row."""
    h, r = T.word_hashes(data, offsets)
    g, at, gap = _pairs(h, r)
    order = np.argsort(items.grams[items.seeds], kind="stable")
    seeds, item = items.grams[items.seeds][order], items.item[items.seeds][order]
    low = np.searchsorted(seeds, g, "left")
    use = np.flatnonzero(seeds[np.minimum(low, len(seeds) - 1)] == g) if len(seeds) else np.zeros(0, np.int64)
    if not len(use):
        return []
    found = []
    low, many = low[use], np.searchsorted(seeds, g[use], "right") - low[use]
    for cut in range(0, len(use), 1 << 14):
        of, pick = _expand(low[cut : cut + (1 << 14)], many[cut : cut + (1 << 14)])
        found.append(np.unique(r[at[use[cut + of]]] * len(items.words) + item[pick]))
    found = np.unique(np.concatenate(found))
    row, item, lane = _windows(items, score, found // len(items.words), found % len(items.words), g, at, gap, r)
    if not len(row):
        return []
    size = items.size[item]
    width = 3 * size - _needed(size, score)
    first = np.searchsorted(r, np.arange(len(offsets)))
    start = np.maximum(lane * width, first[row])
    stop = np.minimum((lane + 2) * width, first[row + 1])
    # equal windows of many copies are aligned once
    known: dict[tuple[int, bytes], int] = {}
    same = np.array([known.setdefault((i, h[a:b].tobytes()), len(known)) for i, a, b in zip(item, start, stop, strict=True)])
    one = np.unique(same, return_index=True)[1]
    one = one[np.argsort(size[one], kind="stable")]
    best = np.zeros(len(known), np.int64)
    best[same[one]] = align([items.words[i] for i in item[one]], [h[a:b] for a, b in zip(start[one], stop[one], strict=True)])
    share = best[same] / (MATCH * size)
    return [(int(row[k]), int(item[k]), float(share[k])) for k in np.flatnonzero(best[same] >= _needed(size, score))]


def _aligned(items: Items, score: float, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[tuple[int, int], float] = {}
            for low, _, data, offsets in T.slices(T.lower(batch.column(1))):
                for row, item, share in _hits(items, data, offsets, score):
                    best[low + row, item] = max(share, best.get((low + row, item), 0.0))
            found = sorted(best)
            ids = batch.column(0).take(pa.array([r for r, _ in found], pa.int64()))
            columns = [ids, pa.array([items.ids[i] for _, i in found], kind), pa.array([best[k] for k in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """Pairs doc_id, item_id, score of documents that hold a test item, or an edited copy of one.

    Words are runs of bytes without white space, in lower case. The score is the best Smith-Waterman alignment of the item
    with any part of the text over that of the item with itself; all pairs of `score` or more are returned, with their
    best score. Pairs of near words at the rarest words of an item, counted over all documents, are its seeds, as many as
    no such alignment can do without; texts with a seed are aligned where they share enough pairs with the item (see the
    module), so neither step loses one. Null and empty texts, null items and items shorter
    than WORDS words match nothing; the latter are too short to tell from chance. Repeated rows give repeated pairs.
    Other columns are ignored. The benchmark is read in blocks of ITEMS items, each of which visits the documents twice.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    id_type, item_type = rows.schema[0].dataType.simpleString(), benchmark.schema[item_column].dataType.simpleString()
    out = None
    for items in _blocks(benchmark, item_column, "text"):
        _choose_seeds(rows.select("text"), items, score)
        kind = to_arrow_type(benchmark.schema[item_column].dataType)
        found = rows.mapInArrow(_aligned(items, score, kind), f"doc_id {id_type}, item_id {item_type}, score double")
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], f"doc_id {id_type}, item_id {item_type}, score double")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """The rows of docs, all columns as they are, in which no test item is found (see contaminated)."""
    out = docs
    for items in _blocks(benchmark, item_column, "text"):
        _choose_seeds(docs.select(text_column), items, score)

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for low, _, data, offsets in T.slices(T.lower(batch.column(batch.schema.get_field_index(text_column)))):
                    clean[[low + row for row, _, _ in _hits(items, data, offsets, score)]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
