"""Removal of passages that occur earlier, located by automata of the recurring phrases."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestat.llm import text as T
from lodestat.llm.identity import AGAIN, CONTENT, ID, mark_copies, named
from lodestat.llm.scratch import Scratch

#: Words of a window, and of the anchors by which equal windows meet.
WORDS, ANCHOR = 20, 8
#: Windows of one phrase at most; text of one shard.
LONGEST, SHARD_BYTES = 256, 2 << 20


def _windows(hashes: np.ndarray, rows: np.ndarray, words: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows with the same anchor: first window (its first word), count, anchor hash, hash of the whole.

    The anchor of a window is its run of `anchor` words of least hash, the first of equals, so equal windows have equal
    anchors at equal places. First and last window overlap, so their hashes stand for all that the run covers.
    """
    whole, at = T.ngrams(hashes, rows, words)
    if not len(at):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    grams, place = T.ngrams(hashes, rows, anchor)
    key = np.full(len(hashes) - anchor + 1, (1 << 64) - 1, np.uint64)
    key[place] = grams
    width = words - anchor + 1
    own = at + np.lib.stride_tricks.sliding_window_view(key, width)[at].argmin(axis=1)
    cut = np.flatnonzero((np.diff(own) != 0) | (np.diff(at) != 1))
    first, last = np.append(0, cut + 1), np.append(cut, len(at) - 1)
    offset = (own[first] - at[first]).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)
    return at[first], last - first + 1, key[own[first]], T.mix(T.mix(whole[first] ^ offset) + whole[last])


_RUNS = f"`{ID}` long, `{CONTENT}` long, start array<int>, n array<int>, h array<long>, w array<long>"


def _scan(words: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in T.slices(batch["text"]):
                hashes, rows = T.word_hashes(data, offsets)
                first = np.searchsorted(rows, np.arange(high - low))
                at, n, h, w = _windows(hashes, rows, words, anchor)
                owner = rows[at] if len(at) else at
                lists = pa.array(np.searchsorted(owner, np.arange(high - low + 1)).astype(np.int32))
                start = (at - first[owner]).astype(np.int32) if len(at) else at.astype(np.int32)
                columns = [batch[c].slice(low, high - low) for c in (ID, CONTENT)]
                columns += [pa.ListArray.from_arrays(lists, pa.array(x)) for x in (start, n.astype(np.int32), h.view(np.int64), w.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, [ID, CONTENT, "start", "n", "h", "w"])

    return run


def _place() -> Column:
    """Order of documents: by id, null first, then by the hash of the text; one number, so that aggregates stay hashed."""
    number = F.coalesce(ID, F.lit(-(1 << 63))).cast("decimal(19,0)") * F.lit(1 << 60).cast("decimal(19,0)")
    return (number.cast("decimal(38,0)") + (F.shiftright(CONTENT, 4) + (1 << 59)).cast("decimal(19,0)")).cast("decimal(38,0)")


def _rows_of(docs: pa.Table, other: pa.Table) -> np.ndarray:
    """Number of the document that each row of `other` names."""
    left = pd.DataFrame({c: other[c].to_pandas() for c in (ID, CONTENT)}).astype({ID: "Int64"})
    right = pd.DataFrame({c: docs[c].to_pandas() for c in (ID, CONTENT)}).astype({ID: "Int64"})
    right["at"] = np.arange(len(right))
    return left.merge(right, on=[ID, CONTENT], how="left")["at"].to_numpy(np.int64)


_WINDOWS = "h long, w long, x array<long>"


def _hashed(words: int):
    """Hashes of the windows of runs that documents stand for."""

    def run(docs: pa.Table, runs: pa.Table) -> pa.Table:
        parts = []
        if runs.num_rows:
            owner = _rows_of(docs, runs)
            order = np.argsort(owner, kind="stable")
            some, owner = np.unique(owner[order], return_inverse=True)
            runs, texts = runs.take(pa.array(order)), docs["text"].take(pa.array(some))
            for low, high, data, offsets in T.slices(pa.concat_arrays([c.cast(pa.string()) for c in texts.chunks])):
                hashes, rows = T.word_hashes(data, offsets)
                whole, at = T.ngrams(hashes, rows, words)
                by_start = np.zeros(len(hashes), np.uint64)
                by_start[at] = whole
                first = np.searchsorted(rows, np.arange(high - low))
                a, b = np.searchsorted(owner, [low, high])
                start = runs["start"].to_numpy()[a:b] + first[owner[a:b] - low]
                n = runs["n"].to_numpy()[a:b]
                ends = np.cumsum(n)
                flat = np.arange(ends[-1]) + np.repeat(start - (ends - n), n)
                lists = pa.array(np.append(0, ends).astype(np.int32))
                x = pa.ListArray.from_arrays(lists, pa.array(by_start[flat].view(np.int64)))
                parts.append(pa.Table.from_arrays([runs["h"].slice(a, b - a), runs["w"].slice(a, b - a), pa.chunked_array([x])], ["h", "w", "x"]))
        return pa.concat_tables(parts) if parts else pa.schema([("h", pa.int64()), ("w", pa.int64()), ("x", pa.list_(pa.int64()))]).empty_table()

    return run


def phrase_automaton(phrases: set[tuple[int, ...]]) -> ahocorasick.Automaton:
    """Automaton over word numbers whose matches give the length of the phrase."""
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for phrase in phrases:
        found.add_word(phrase, len(phrase))
    found.make_automaton()
    return found


def _phrases(at: np.ndarray, hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of the phrases that cover the given windows (sorted first words).

    A phrase is a stretch of consecutive windows, cut before a word whose hash ends in zeros, so that the same passage is
    cut alike wherever it stands, and after LONGEST windows.
    """
    fresh = (np.diff(at, prepend=-2) != 1) | (hashes[at] % np.uint64(64) == 0)
    begin = np.flatnonzero(fresh)
    fresh |= (np.arange(len(at)) - begin[np.cumsum(fresh) - 1]) % LONGEST == 0
    begin = np.flatnonzero(fresh)
    return at[begin], at[np.append(begin[1:], len(at)) - 1] + words


_KEPT = "doc_id long, n_words long, spans array<struct<start: long, end: long>>, kept string"
_MATCH = np.dtype([("end", np.int64), ("size", np.int64)])
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _result(ids: pa.Array, data, offsets, starts, ends, rows, gone: np.ndarray) -> pa.Table:
    """Result rows of a slice from its words and which of them go."""
    n = len(offsets) - 1
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.searchsorted(rows, np.arange(n + 1))
    inner = first[1:-1]  # a run of removed words ends with its document
    inner = np.unique(inner[(inner > 0) & (inner < len(gone))])
    split = inner[gone[inner] & gone[inner - 1]] if len(inner) else inner
    low, high = np.sort(np.append(low, split)), np.sort(np.append(high, split))
    owner = rows[low] if len(low) else low
    lists = pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32))
    spans = pa.StructArray.from_arrays([pa.array(low - first[owner]), pa.array(high - first[owner])], fields=list(_SPAN))
    kept = T.joined_words(data, offsets, starts, ends, ~gone)
    columns = [ids, pa.array(np.diff(first)), pa.ListArray.from_arrays(lists, spans), kept]
    return pa.Table.from_arrays([c if isinstance(c, pa.ChunkedArray) else pa.chunked_array([c]) for c in columns], ["doc_id", "n_words", "spans", "kept"])


def _covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def _spaced(texts: pa.ChunkedArray) -> pa.Array:
    """Texts that end with a space."""
    texts = pa.concat_arrays([c.cast(pa.string()) for c in texts.chunks])
    return pc.binary_join_element_wise(texts, "", " ")


def _removed(words: int):
    """Compile the shard's recurring phrases, stream its documents through them, and drop what is not its first place."""

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        parts = []
        if docs.num_rows:
            owner = _rows_of(docs, marks) if marks.num_rows else np.zeros(0, np.int64)
            order = np.argsort(owner, kind="stable")
            owner = owner[order]
            begin, mask, own = (marks[c].to_numpy()[order] for c in ("start", "mask", "own"))
            for low, high, data, offsets in T.slices(_spaced(docs["text"]), limit=SHARD_BYTES):
                starts, ends, rows = T.word_spans(data, offsets)
                hashes = T.span_hashes(T.prefix_sums(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)
                first = np.searchsorted(rows, np.arange(high - low))
                a, b = np.searchsorted(owner, [low, high])
                gone = np.zeros(len(starts), bool)
                if b > a:
                    _, numbers = np.unique(hashes, return_inverse=True)
                    stream = np.zeros(len(starts) + high - low, np.int64)  # 0 separates documents
                    stream[np.arange(len(starts)) + rows] = numbers + 1
                    at = begin[a:b] + first[owner[a:b] - low]
                    bit = np.arange(words)
                    recurring, mine = (np.sort((at[:, None] + bit)[(bits[a:b, None] >> bit & 1) > 0]) for bits in (mask, own))
                    symbols = (numbers + 1).tolist()
                    phrases = {tuple(symbols[x:y]) for x, y in zip(*(z.tolist() for z in _phrases(recurring, hashes, words)), strict=True)}
                    found = np.fromiter(phrase_automaton(phrases).iter(tuple(stream.tolist())), _MATCH)
                    end, size = found["end"], found["size"]
                    row_of = np.repeat(np.arange(high - low), np.diff(np.append(first, len(starts))) + 1)
                    end = end - row_of[end] + 1
                    again = _covered(end - size, end - words + 1, len(starts))  # windows that recur
                    if len(mine):  # windows of which this document is the first one
                        whole, place = T.ngrams(hashes, rows, words)
                        frame = pd.DataFrame({"row": rows[mine], "x": whole[np.searchsorted(place, mine)]})
                        again[mine[~frame.duplicated().to_numpy()]] = False
                    later = np.flatnonzero(again)
                    gone = _covered(later, later + words, len(starts))
                parts.append(_result(docs["doc_id"].slice(low, high - low), data, offsets, starts, ends, rows, gone))
        return pa.concat_tables(parts) if parts else _empty()

    return run


def _empty() -> pa.Table:
    return pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("kept", pa.string())]).empty_table()


def _all_removed(words: int):
    """Result of rows that repeat another row in id and text: every window goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for low, high, data, offsets in T.slices(_spaced(table["text"])) if len(batch) else ():
                starts, ends, rows = T.word_spans(data, offsets)
                gone = np.bincount(rows, minlength=high - low)[rows] >= words
                yield from _result(table["doc_id"].slice(low, high - low), data, offsets, starts, ends, rows, gone).to_batches()

    return run


def without_recurring(docs: DataFrame, words: int = WORDS, anchor: int = ANCHOR, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Remove each word that a window of `words` consecutive words covers whose sequence also starts earlier.

    Words are what stands between ASCII white space, unchanged; windows do not cross documents, may overlap, and are
    judged on the input. Earlier is a smaller id, or the same document and an earlier start. Null ids come before all
    others; among rows of the same id the hash of the text decides, and of rows equal in both the others lose every
    window. Null and empty texts have no words; very long ones are a shard of their own. Other columns are ignored.
    `words` is at most 32 above `anchor`. Returns one row per row: doc_id, n_words, spans (removed words: start, end) and
    kept (the rest, joined by one space). No row: no row.

    Every window has an anchor that depends on its content alone, and consecutive windows of the same anchor form a run.
    Anchors that occur once are dropped by an aggregation and a join. Runs that are alone with their anchor recur in full;
    where an anchor has different runs, one document for each sends the hashes of its windows, and counting those
    confirms what recurs and gives the first document. The confirmed phrases of each shard of documents are compiled into
    an automaton, which all documents of the shard are streamed through; phrases are of bounded length, so a shard's
    automaton and its matches grow with its text only. Hot anchors meet hash aggregates with map-side combining and joins that adaptive
    execution splits. Runs and windows are told apart by two 64-bit hashes.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    rows = named(rows, "doc_id", "text")
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    copies = scratch.store(rows.groupBy(ID, CONTENT).count().where("count > 1"))
    marked = mark_copies(rows, copies, scratch)
    fresh, spent = marked.where(~F.col(AGAIN)).drop(AGAIN), marked.where(AGAIN)
    by_shard = fresh.withColumn("shard", F.pmod(F.xxhash64(ID, CONTENT), F.lit(shards)))

    runs = scratch.store(fresh.select(ID, CONTENT, "text").mapInArrow(_scan(words, anchor), _RUNS))
    twice = scratch.store(runs.select(F.explode("h").alias("h")).groupBy("h").count().where("count > 1").select("h"))
    each = runs.select(ID, CONTENT, F.explode(F.arrays_zip("start", "n", "h", "w")).alias("r")).select(ID, CONTENT, "r.*")
    met = scratch.store(each.join(twice, "h", "left_semi"))
    scratch.drop(runs, twice)

    stand_in = {c: F.min_by(c, "place").alias(c) for c in (ID, CONTENT, "start", "n")}
    kinds = met.withColumn("place", _place()).groupBy("h", "w").agg(F.count("*").alias("times"), F.min("place").alias("first"), *stand_in.values())
    kinds = scratch.store(kinds)
    alone = kinds.groupBy("h").agg((F.count("*") == 1).alias("alone"))
    kinds_marked = scratch.store(kinds.join(alone, "h"))
    mixed = kinds_marked.where("not alone")
    shard = F.pmod(F.xxhash64(ID, CONTENT), F.lit(shards)).alias("shard")
    windows = by_shard.groupBy("shard").cogroup(mixed.select(ID, CONTENT, "start", "n", "h", "w", shard).groupBy("shard")).applyInArrow(_hashed(words), _WINDOWS)
    windows = scratch.store(windows.join(mixed.select("h", "w", "times", "first"), ["h", "w"]))
    spread = windows.select("h", "w", "times", "first", F.posexplode("x").alias("bit", "x"))
    recur = spread.groupBy("h", "x").agg(F.sum("times").alias("times"), F.min("first").alias("earliest")).where("times > 1").drop("times")
    one = F.expr("shiftleft(1L, bit)")
    masks = spread.join(recur, ["h", "x"]).groupBy("h", "w").agg(
        F.min("first").alias("first"), F.bit_or(one).alias("mask"), F.bit_or(F.when(F.col("first") == F.col("earliest"), one).otherwise(F.lit(0).cast("long"))).alias("own")
    )
    full = F.expr("shiftleft(1L, n) - 1")
    masks = masks.unionByName(kinds_marked.where("alone").select("h", "w", "first", full.alias("mask"), full.alias("own")))
    own = F.when(F.col("first") == F.col("place"), F.col("own")).otherwise(F.lit(0).cast("long")).alias("own")
    marks = met.withColumn("place", _place()).join(scratch.store(masks), ["h", "w"]).select(ID, CONTENT, "start", "mask", own, shard)
    out = by_shard.groupBy("shard").cogroup(marks.groupBy("shard")).applyInArrow(_removed(words), _KEPT)
    return out.unionByName(spent.select("doc_id", "text").mapInArrow(_all_removed(words), _KEPT))
