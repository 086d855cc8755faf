"""Periodic runs of words: stretches that repeat themselves at least three times, and texts without the repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm import text as T

#: Words of the shortest run, and periods it must hold.
LENGTH, PERIODS = 24, 3
#: Text handled at once; a longer document is a slice of its own.
SLICE_BYTES = 4 << 20
#: Every difference modulo 21 is the difference of two of these residues.
MODULUS, COVER = 21, (0, 1, 4, 14, 16)


def _dense(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each row of the columns (equal rows share one, from 1), and an order that sorts them; the first column weighs most."""
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    fresh = np.zeros(len(order), bool)
    for c in columns:
        fresh[1:] |= c[order[1:]] != c[order[:-1]]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(fresh) + 1
    return rank, order


class CommonExtension:
    """Length of the longest common prefix of any two suffixes of a sequence, from the sorted order of a sample of them.

    Sampled are the positions whose residue modulo MODULUS is in COVER. For any two positions some shift of less than
    MODULUS makes both sampled, so a query compares that many words and then asks for the least common prefix between
    two sorted samples, which a table of minima over spans of 2**k answers. The sequence holds positive integers and
    must end with one that occurs nowhere else.
    """

    def __init__(self, symbols: np.ndarray):
        n, width = len(symbols), len(COVER)
        self.symbols = np.concatenate([symbols, np.zeros(2 * MODULUS, symbols.dtype)])
        self.slot = np.full(MODULUS, -1)
        self.slot[list(COVER)] = np.arange(width)
        at = (np.arange(0, n, MODULUS)[:, None] + np.array(COVER)).ravel()
        at = at[at < n]
        residue = np.arange(MODULUS)
        first = np.zeros(MODULUS, np.int64)  # by difference: the residue to which the left position is moved
        for a in COVER:
            for b in COVER:
                first[(b - a) % MODULUS] = a
        self.shift = (first[:, None] - residue[None, :]) % MODULUS

        bits = max(1, int(symbols.max(initial=1)).bit_length())
        packed = []
        for low in range(0, MODULUS, 63 // bits):
            word = np.zeros(len(at), np.int64)
            for k in range(low, min(MODULUS, low + 63 // bits)):
                word = (word << bits) | self.symbols[at + k]
            packed.append(word)
        rank, order = _dense(*packed)
        levels, jump = [rank], width
        while len(at) and rank.max() < len(at):  # each round doubles the words that the ranks tell apart
            ahead = np.zeros(len(at), np.int64)
            ahead[:-jump] = rank[jump:]
            rank, order = _dense(rank * (len(at) + 1) + ahead)
            levels.append(rank)
            jump *= 2
        self.place = np.empty(len(at), np.int64)
        self.place[order] = np.arange(len(at))
        self.minima = [self._neighbours(at, order, levels)]
        while 2 << len(self.minima) - 1 <= len(self.minima[0]):
            half, last = 1 << len(self.minima) - 1, self.minima[-1]
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def _neighbours(self, at: np.ndarray, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefix of each sorted sample and the next one."""
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            rank = np.append(levels[k], np.zeros(1, np.int64))
            step = len(COVER) << k
            equal = (a < len(at)) & (b < len(at)) & (rank[np.minimum(a, len(at))] == rank[np.minimum(b, len(at))])
            common += np.where(equal, MODULUS << k, 0)
            a, b = a + step * equal, b + step * equal
        x, y = at[order[:-1]] + common, at[order[1:]] + common
        return common + self._compare(x, y, np.full(len(x), MODULUS))

    def _compare(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Equal symbols from x and y on, at most `limit`."""
        out, left = np.zeros(len(x), np.int64), np.arange(len(x))
        for k in range(MODULUS):
            left = left[k < limit[left]]
            left = left[self.symbols[x[left] + k] == self.symbols[y[left] + k]]
            if not len(left):
                break
            out[left] += 1
        return out

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        shift = self.shift[(y - x) % MODULUS, x % MODULUS]
        out = self._compare(x, y, shift)
        far = np.flatnonzero(out == shift)
        a, b = ((z[far] + shift[far]) for z in (x, y))
        a, b = (self.place[z // MODULUS * len(COVER) + self.slot[z % MODULUS]] for z in (a, b))
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            here = np.flatnonzero(level == k)
            table = self.minima[k]
            out[far[here]] += np.minimum(table[low[here]], table[high[here] - (1 << k)])
        return out


def find_runs(symbols: np.ndarray, longest: int, length: int = LENGTH, periods: int = PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run of a sequence, by start and period.

    A run is a stretch of smallest period q and at least max(length, periods * q) symbols that can not be extended;
    `longest` bounds its length. The sequence is as CommonExtension asks; symbols that occur once may separate parts.

    For each q only the multiples of q are tried: a run holds two neighbouring ones, so all periods together take a
    harmonic sum of tries. Nearly all fail at their first symbols. From the first multiple inside a run the extension to
    the right shows its end; the start, less than q away, is found by halving, with extensions from there.
    """
    tries, none = [], np.zeros(0, np.int64)
    for q in range(1, longest // periods + 1):
        hit = np.flatnonzero(symbols[:-q:q] == symbols[q::q])
        if len(hit):
            tries.append((hit * q, np.full(len(hit), q)))
    if not tries:
        return none, none, none
    at, q = (np.concatenate(x) for x in zip(*tries, strict=True))
    least = np.maximum(length, periods * q)
    need = least - 2 * q + 1  # what must be equal from the first multiple on
    for k in (1, need.min() - 1):
        same = symbols[np.minimum(at + k, len(symbols) - 1)] == symbols[np.minimum(at + q + k, len(symbols) - 1)]
        at, q, least, need = at[same], q[same], least[same], need[same]
    if not len(at):
        return none, none, none
    common = CommonExtension(symbols)
    right = common(at, at + q)
    at, q, least, right = (x[right >= need] for x in (at, q, least, right))
    low, high = np.zeros(len(at), np.int64), np.minimum(q, at)
    while (low < high).any():
        middle = (low + high + 1) // 2
        reaches = common(at - middle, at - middle + q) >= middle + right
        low, high = np.where(reaches, middle, low), np.where(reaches, high, middle - 1)
    keep = (low < q) & (low + right + q >= least)  # from the first multiple inside the run only
    start, size, q = (at - low)[keep], (low + right + q)[keep], q[keep]
    order = np.lexsort((q, size, start))
    start, size, q = start[order], size[order], q[order]
    first = np.append(True, (start[1:] != start[:-1]) | (size[1:] != size[:-1])) if len(start) else np.zeros(0, bool)
    start, size, q = start[first], size[first], q[first]  # multiples of the smallest period find the same stretch
    order = np.lexsort((q, start))
    return start[order], size[order], q[order]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = "doc_id {id}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _slice_runs(data: np.ndarray, offsets: np.ndarray, length: int, periods: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Number of words, runs, and collapsed text of each row; every row ends with a space."""
    rows = len(offsets) - 1
    starts, ends, row = T.word_spans(data, offsets)
    counts = np.bincount(row, minlength=rows)
    hashes = T.span_hashes(T.prefix_sums(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    kinds, ids = np.unique(hashes, return_inverse=True)
    first = np.cumsum(np.append(0, counts[:-1] + 1))  # each row's place, with a mark of its own behind its words
    symbols = np.empty(len(ids) + rows, np.int64)
    symbols[first + counts] = len(kinds) + 1 + np.arange(rows)
    word = np.arange(len(ids)) + row
    symbols[word] = ids + 1
    start, size, q = find_runs(symbols, int(counts.max(initial=0)), length, periods)

    edge = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(edge, start + q, 1)
    np.add.at(edge, start + size, -1)
    kept = np.cumsum(edge[:-1])[word] == 0
    collapsed = T.joined_words(data, offsets, starts, ends, kept)

    owner = np.searchsorted(first, start, "right") - 1
    lists = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
    runs = pa.StructArray.from_arrays([pa.array(start - first[owner]), pa.array(size), pa.array(q)], fields=list(_RUN))
    return counts, pa.ListArray.from_arrays(pa.array(lists), runs), collapsed


def _scan(length: int, periods: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in T.slices(batch["text"], limit=SLICE_BYTES):
                found = _slice_runs(data, offsets, length, periods)
                columns = [batch["doc_id"].slice(low, high - low), pa.array(found[0]), *found[1:]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, length: int = LENGTH, periods: int = PERIODS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Runs of every text, and the text without their repeats.

    Words are what stands between ASCII white space. A run is a stretch of words with smallest period q (words q apart
    are equal) and at least max(length, periods * q) words that no neighbouring word extends. Returns one row per row:
    doc_id, n_words, runs (start, length and period in words, from 0; by start, then period) and collapsed: the words
    that no run holds after its first q words, joined by one space.

    Null and empty texts have no words and no run. Ids are only handed on: they may be null, repeat, and be of any type.
    Rows do not influence each other, so repeated rows have equal results and no key is hot. Other columns are ignored.
    A very long text is worked on alone, in memory proportional to it. No row: no row. Words are compared by 64-bit hash.
    """
    text = F.concat(F.coalesce(F.col(text_column).cast("string"), F.lit("")), F.lit(" "))
    rows = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(_scan(length, periods), _SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString()))
