"""Line de-duplication by an exact set-similarity join over the words of lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from lodestat.llm import text as T
from lodestat.llm.identity import AGAIN, CONTENT, ID, content, mark_copies, named, same
from lodestat.llm.links import compare_in_groups, components, least_index
from lodestat.llm.ngram_join import similar_sets
from lodestat.llm.scratch import Scratch

SIMILARITY = 0.8
#: Counters of the word frequencies that order the words of a line.
COUNTERS = 1 << 24
_BLOCK = 1 << 16
_NEWLINE = 10
#: Bits of a packed word hash that number its line inside a slice of texts.
_LINE_BITS = 22
#: Bits of a packed sort key that hold a word's place in its slice.
_PLACE_BITS = 30
#: Bytes of text, prefix words and pairs that a task works on at once.
_SLICE, _FLUSH, _PAIRS = 1 << 18, 1 << 17, 1 << 18
#: Larger groups of lines with a common prefix word are compared in blocks by other tasks.
_GROUP = 32768
#: Bits of the filter that picks the lines whose words are fetched; a false hit only costs a row.
_FILTER_BITS = 26
#: 64-bit words of a line's bitmap of word hashes.
_BITMAP = 4
_BITS = [f"bits{k}" for k in range(_BITMAP)]


class Lines:
    """Lines of a slice of texts as sets of words: row, number and size of each line, and its distinct word hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        breaks = np.flatnonzero(data == _NEWLINE) + 1
        starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks[breaks < len(data)]]))
        row = np.searchsorted(offsets, starts, "right") - 1
        number = np.arange(len(starts)) - np.searchsorted(row, np.arange(len(offsets) - 1))[row]
        h, line = T.word_hashes(data, np.append(starts, len(data)).astype(np.int64)) if len(starts) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        h >>= np.uint64(_LINE_BITS)
        if len(starts) <= 1 << _LINE_BITS:
            packed = np.sort(line.astype(np.uint64) << np.uint64(64 - _LINE_BITS) | h)
            line, h = (packed >> np.uint64(64 - _LINE_BITS)).astype(np.int64), packed & np.uint64((1 << (64 - _LINE_BITS)) - 1)
        else:  # a text of so many lines: their numbers do not fit beside the words
            order = np.lexsort((h, line))
            line, h = line[order], h[order]
        fresh = np.append(True, (line[1:] != line[:-1]) | (h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
        line, self.words = line[fresh], h[fresh]
        counts = np.bincount(line, minlength=len(starts))
        self.has = np.flatnonzero(counts)  # lines with a word
        self.row, self.number, self.size = row[self.has], number[self.has], counts[self.has]
        self.ends = np.cumsum(self.size)
        self.starts = self.ends - self.size

    def short_keys(self) -> np.ndarray:
        """First column of the keys."""
        if not len(self.has):
            return np.zeros(0, np.uint64)
        return np.add.reduceat(T.mix(self.words ^ np.uint64(0xA5A5A5A5A5A5A5A5)), self.starts)

    def keys(self) -> np.ndarray:
        """128-bit names of the sets, as two columns."""
        if not len(self.has):
            return np.zeros((0, 2), np.uint64)
        two = np.add.reduceat(T.mix(self.words + np.uint64(0x1234567)), self.starts) + self.size.astype(np.uint64)
        return np.stack([self.short_keys(), two], axis=1)


def _binary(keys: np.ndarray) -> pa.Array:
    width = keys.dtype.itemsize * (keys.shape[1] if keys.ndim > 1 else 1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys))]).cast(pa.binary())


def _ids(column: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Row's place in the order of ids (null first) as 9 big-endian bytes, for each of the rows."""
    known = np.asarray(pc.is_valid(column))
    value = pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), 9), np.uint8)
    out[:, 0] = known
    out[:, 1:] = (value.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out[rows]


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line with a word: its place and the name of its set; and word counts in blocks at the end."""
    counts = np.zeros(COUNTERS, np.uint16)
    names = ["doc_id", "content", "line", "place", "key", "block", "at", "n"]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    for batch in batches:
        for low, high, data, offsets in T.slices(T.lower(batch.column(1)), _SLICE):
            lines = Lines(data, offsets)
            slot, n = np.unique(_slot(lines.words), return_counts=True)
            counts[slot] = np.minimum(counts[slot].astype(np.int64) + n, 60000)
            ids = batch.column(0).slice(low, high - low)
            texts = batch.column(2).slice(low, high - low)
            text = texts.to_numpy()[lines.row].astype(">i8").view(np.uint8).reshape(-1, 8)
            place = np.concatenate([_ids(ids, lines.row), lines.number.astype(">u4").view(np.uint8).reshape(-1, 4), text], axis=1)
            rest = [pa.nulls(len(lines.has), t) for t in types[5:]]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(lines.row)), texts.take(pa.array(lines.row)), pa.array(lines.number, pa.int32()), _binary(place), _binary(lines.keys()), *rest], names)
    found = np.flatnonzero(counts)
    cuts = np.searchsorted(found, np.arange(0, COUNTERS + 1, _BLOCK))
    some = np.flatnonzero(np.diff(cuts))
    lists = pa.array(np.append(cuts[some], len(found)), pa.int32())
    at = pa.ListArray.from_arrays(lists, pa.array((found % _BLOCK).astype(np.int32)))
    n = pa.ListArray.from_arrays(lists, pa.array(counts[found].astype(np.int32)))
    yield pa.RecordBatch.from_arrays([*(pa.nulls(len(some), t) for t in types[:5]), pa.array(some, pa.int32()), at, n], names)
    del counts
    T.give_back()


def _slot(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(COUNTERS - 1)).astype(np.int64)


def _added(table: pa.Table) -> pa.Table:
    """Sums of one block of counters in one byte each: exact to 127, then in steps of an eighth of a doubling."""
    flat = lambda c: np.concatenate([x.flatten().to_numpy() for x in table[c].chunks])
    total = np.bincount(flat("at"), weights=flat("n"), minlength=_BLOCK)
    total = np.where(total < 128, total, np.minimum(128 + 8 * np.log2(np.maximum(total, 128) / 128), 255)).astype(np.uint8)
    return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def prefix_length(size: np.ndarray, similarity: float) -> np.ndarray:
    """Words of which two sets of the similarity must share one, counted in a common order."""
    return size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1


def _prefixes(counters, similarity: float, buckets: int):
    """Prefix words that another line may share, with what the filters need, packed by hash bucket of the word."""
    names = ["bucket", "word", "key", *_BITS, "shape"]

    def prefix(lines: Lines, counts: np.ndarray) -> np.ndarray:
        # only lines large enough to resemble a different one
        some = np.flatnonzero(lines.size >= similarity / (1 - similarity) - 1e-6)
        size = lines.size[some]
        ends = np.cumsum(size)
        starts, line = ends - size, np.repeat(np.arange(len(some)), size)
        words = lines.words[np.arange(len(line)) + (lines.starts[some] - starts)[line]]
        # words of a line are in the order of their hashes, so a stable sort by rank keeps it
        rank = counts[_slot(words)]
        place = np.arange(len(words))
        if len(words) < 1 << _PLACE_BITS and len(some) < 1 << (56 - _PLACE_BITS):
            order = np.sort((line << 8 | rank) << _PLACE_BITS | place) & ((1 << _PLACE_BITS) - 1)
        else:
            order = np.argsort(line << 8 | rank, kind="stable")
        position = place - starts[line]
        # in the prefix and not unique
        use = (position < prefix_length(size, similarity)[line]) & (rank[order] > 1)
        of = line[use]
        slot = words >> np.uint64(30) & np.uint64(64 * _BITMAP - 1)
        one = np.uint64(1) << (slot & np.uint64(63))
        bits = [np.bitwise_or.reduceat(one * (slot >> np.uint64(6) == k), starts) if len(some) else np.zeros(0, np.uint64) for k in range(_BITMAP)]
        key = lines.short_keys()[some]
        return np.stack([words[order[use]], key[of], *(x[of] for x in bits), position[use].astype(np.uint64) << np.uint64(32) | size[of].astype(np.uint64)])

    def dealt(parts: list[np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate(parts, axis=1)
        bucket = (T.mix(flat[0]) % np.uint64(buckets)).astype(np.int64)
        flat = np.concatenate([bucket[None].astype(np.uint64), flat])[:, np.argsort(bucket, kind="stable")]
        cuts = np.searchsorted(flat[0], np.arange(buckets + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(cuts))
        lists = pa.array(np.append(cuts[some], flat.shape[1]), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.ListArray.from_arrays(lists, pa.array(x.view(np.int64))) for x in flat[1:])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for _, _, data, offsets in T.slices(T.lower(batch.column(0)), _SLICE):
                lines = Lines(data, offsets)
                if len(lines.has):
                    parts.append(prefix(lines, counters.value))
                    held += parts[-1].shape[1]
                if held >= _FLUSH:
                    yield dealt(parts)
                    parts, held = [], 0
        if held:
            yield dealt(parts)
        parts.clear()
        T.give_back()

    return run


def _fits(similarity: float, key, bits, shape, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length, positional and bitmap filter: False only where the sets cannot be similar."""
    m, n = (shape[a] & 0xFFFFFFFF).astype(np.float64), (shape[b] & 0xFFFFFFFF).astype(np.float64)
    p, q = shape[a] >> 32, shape[b] >> 32
    need = similarity / (1 + similarity) * (m + n) - 1e-6
    most = np.minimum(p, q) + np.minimum(m - p, n - q)
    apart = sum(np.bitwise_count((x[a] ^ x[b]).view(np.uint64)).astype(np.int64) for x in bits)
    return (key[a] != key[b]) & (np.minimum(m, n) >= similarity * np.maximum(m, n) - 1e-6) & (most >= need) & ((m + n - apart) / 2 >= need)


def _candidates(similarity: float):
    """Connect the lines of a bucket that share a prefix word and pass the filters; pass on the large groups."""

    def run(table: pa.Table) -> pa.Table:
        word, key, *bits, shape = (np.concatenate([c.flatten().to_numpy() for c in table[name].chunks]) for name in ("word", "key", *_BITS, "shape"))
        order = np.lexsort((key, shape & 0xFFFFFFFF, word))
        fresh = np.append(True, (word[order][1:] != word[order][:-1]) | (key[order][1:] != key[order][:-1]))
        word, key, *bits, shape = (x[order][fresh] for x in (word, key, *bits, shape))
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        size = np.diff(np.append(starts, len(word)))
        large = np.repeat(size > _GROUP, size)
        # partners are further on in the group, up to the largest size that can be similar
        group = np.repeat(np.arange(len(starts), dtype=np.int64) << 32, size)
        words = shape & 0xFFFFFFFF
        last = np.searchsorted(group | words, group | np.floor(words / similarity + 1e-6).astype(np.int64), "right")
        after = np.where(large, 0, last - np.arange(len(word)) - 1)
        edges = []
        low = 0
        total = np.cumsum(after)
        while low < len(word):
            high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + _PAIRS, "right")))
            some = after[low:high]
            a = np.repeat(np.arange(low, high), some)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(some) - some, some)
            ok = _fits(similarity, key, bits, shape, a, b)
            edges.append(np.stack([a[ok], b[ok]]))
            low = high
        pairs = np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), np.int64)
        # one item for each line, whatever words it shares
        lines, item = np.unique(key, return_inverse=True)
        root = least_index(len(lines), item[pairs[0]], item[pairs[1]])
        moved = np.flatnonzero(root != np.arange(len(lines)))
        n = int(large.sum())
        none = pa.nulls(len(moved), pa.int64())
        columns = [
            pa.concat_arrays([_binary(lines[moved]), _binary(key[large])]),
            pa.concat_arrays([_binary(lines[root[moved]]), pa.nulls(n, pa.binary())]),
            *(pa.concat_arrays([none, pa.array(x[large])]) for x in (word, key, *bits, shape)),
        ]
        return pa.Table.from_arrays(columns, ["a", "b", "word", "key8", *_BITS, "shape"])

    return run


def _bitmap_matcher(similarity: float):
    """Matcher of lines that share a prefix word, by the filters alone."""

    def match(columns: dict, starts: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key, *bits, shape = (columns[c].to_numpy() for c in ("key8", *_BITS, "shape"))
        found = [np.zeros((2, 0), np.int64)]
        for low, high in zip(starts[:-1], starts[1:], strict=True):
            # of two blocks only pairs across, else each pair once; some rows at a time
            middle = low + int(np.searchsorted(block[low:high], block[high - 1]))
            two = middle > low
            right = np.arange(middle, high) if two else np.arange(low, high)
            step = max(1, _PAIRS // max(1, len(right)))
            for at in range(low, middle if two else high, step):
                left = np.arange(at, min(at + step, middle if two else high))
                a, b = np.repeat(left, len(right)), np.tile(right, len(left))
                a, b = a[a < b], b[a < b]
                ok = _fits(similarity, key, bits, shape, a, b)
                found.append(np.stack([a[ok], b[ok]]))
        pairs = np.concatenate(found, axis=1)
        return pairs[0], pairs[1]

    return match


def _words_of(wanted):
    """Sets of the lines that the filter may hold: short key, key and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, seen = wanted.value, set()
        for batch in batches:
            for _, _, data, offsets in T.slices(T.lower(batch.column(0)), _SLICE):
                lines = Lines(data, offsets)
                slot = (T.mix(lines.short_keys()) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)
                at = np.flatnonzero(bitmap[slot >> 3] >> (slot & 7) & 1)
                keys = lines.keys() if len(at) else np.zeros((0, 2), np.uint64)
                names = [keys[k].tobytes() for k in at]
                fresh = [k for k, name in zip(at, names, strict=True) if name not in seen]
                if len(seen) < 100_000:  # only to save work on copies
                    seen.update(names)
                sets = [lines.words[lines.starts[k] : lines.ends[k]].view(np.int64) for k in fresh]
                yield pa.RecordBatch.from_arrays([_binary(keys[fresh, 0]), _binary(keys[fresh]), pa.array(sets, pa.list_(pa.int64()))], ["node", "key", "values"])
        seen.clear()
        T.give_back()

    return run


def _filter_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the filter that the nodes of a partition set."""
    for batch in batches:
        nodes = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
        slot = (T.mix(nodes) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(slot >> 3), pa.array(1 << (slot & 7), pa.int64())], ["i", "bits"])


def _cut(column: int, counted: str):
    """Texts without the lines whose numbers are in the last column but one, or without all words if the last is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone, again, out, removed = *(batch.column(k) for k in (column, -2, -1)), [], []
            for text, numbers, repeat in zip(texts.to_pylist(), gone.to_pylist(), again.to_pylist(), strict=True):
                if repeat and text:
                    numbers = [k for k, x in enumerate(text.split("\n")) if x.strip(" \t\r\v\f")]
                removed.append(len(numbers or ()))
                if numbers:
                    drop = set(numbers)
                    text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop)
                out.append(text)
            columns = [pa.array(out, pa.string()) if k == column else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns[:-2], pa.array(removed, pa.int32())], [*batch.schema.names[:-2], counted])

    return run


def repeated_lines(docs: DataFrame, similarity: float = SIMILARITY, id_column: str = "doc_id", text_column: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, content, line) of every line that an earlier line of the corpus resembles; lines count from 0.

    A line is the set of its words (runs of bytes without white space, in lower case); blank lines have none and never
    repeat. Earlier is by (doc_id, line, content), null ids first; content is a hash of the text, which tells rows apart
    that share an id. Rows equal in both count as one here. Words are ordered by rarity, counted over all lines in COUNTERS hashed counters (any common order is
    exact), then by hash.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    spark = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), content(text_column).alias("content"))
    places = scratch.store(rows.mapInArrow(_places, "doc_id long, content long, line int, place binary, key binary, block int, at array<int>, n array<int>"))
    counts = np.zeros(COUNTERS, np.uint8)
    blocks = places.where("block is not null").select("block", "at", "n").groupBy("block").applyInArrow(_added, "block int, counts binary")
    for r in blocks.toLocalIterator():
        counts[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["counts"], np.uint8)
    lines = places.where("key is not null").select("doc_id", "content", "line", "place", "key")

    buckets = max(1, lines.count() // 50_000)
    packed = rows.select("text").mapInArrow(_prefixes(spark.broadcast(counts), similarity, buckets), f"bucket int, word array<long>, key array<long>, {', '.join(f'{b} array<long>' for b in _BITS)}, shape array<long>")
    near = packed.groupBy("bucket").applyInArrow(_candidates(similarity), f"a binary, b binary, word long, key8 long, {', '.join(f'{b} long' for b in _BITS)}, shape long")
    near = scratch.store(near)
    large = near.where("b is null").select(F.col("word").alias("grp"), F.col("a").alias("key"), "key8", *_BITS, "shape")
    large = compare_in_groups(large, _bitmap_matcher(similarity), scratch, gather="none", block=1024).select("a", "b")
    groups = components(near.where("b is not null").select("a", "b").union(large), scratch)

    bitmap = np.zeros(1 << (_FILTER_BITS - 3), np.uint8)
    for r in groups.select("node").mapInArrow(_filter_bytes, "i long, bits long").groupBy("i").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        bitmap[r["i"]] = r["bits"]
    sets = scratch.store(rows.select("text").mapInArrow(_words_of(spark.broadcast(bitmap)), "node binary, key binary, values array<long>"))
    classes = scratch.store(lines.groupBy("key").agg(F.min("place").alias("place"), F.count("*").alias("n")))
    sets = scratch.store(sets.join(groups, "node").join(classes, "key").select(F.col("root").alias("grp"), "key", "place", "values"))
    earlier = compare_in_groups(sets, similar_sets(similarity), scratch, gather="earliest")
    earlier = earlier.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("earlier"))
    first = classes.join(earlier, "key", "left").where("n > 1 or earlier is not null")
    first = scratch.store(first.select("key", F.coalesce("earlier", "place").alias("first")))
    out = lines.join(first, "key").where("place > first").select("doc_id", "content", "line")
    scratch.drop(near, sets)
    return out


def without_repeated_lines(docs: DataFrame, similarity: float = SIMILARITY, id_column: str = "doc_id", text_column: str = "text", counted: str = "n_removed") -> DataFrame:
    """The rows of docs, all columns as they are but the text, which loses its repeated lines (see repeated_lines).

    The number of these is added as `counted`, in place of a column of that name.

    Each row is a document of its own, also where ids are null or repeat; of rows equal in id and text one stays whole.
    Null and empty texts stay as they are.
    """
    docs, scratch = docs.drop(counted), Scratch(docs.sparkSession)
    gone = repeated_lines(docs, similarity, id_column, text_column, scratch)
    gone = gone.groupBy(F.col("doc_id").alias("_gone_id"), F.col("content").alias("_gone_content")).agg(F.collect_set("line").alias("_gone"))
    rows = named(docs, id_column, text_column)
    copies = scratch.store(rows.where(F.length(text_column) > 0).groupBy(ID, CONTENT).agg(F.count("*").alias("n")).where("n > 1"))
    rows = mark_copies(rows, copies, scratch)
    joined = rows.join(gone, same("_gone_id", "_gone_content"), "left").select(*docs.columns, "_gone", AGAIN)
    schema = T_.StructType([*docs.schema.fields, T_.StructField(counted, T_.IntegerType())])
    return joined.mapInArrow(_cut(docs.columns.index(text_column), counted), schema)
