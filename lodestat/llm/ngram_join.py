"""N-gram Jaccard self-join of documents through a MinHash LSH forest, verified exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestat.llm import text as T
from lodestat.llm.identity import AGAIN, CONTENT, ID, content, mark_copies, named, same
from lodestat.llm.links import compare_in_groups, components, overlaps, resolve
from lodestat.llm.scratch import Scratch

#: Words of a shingle, least similarity of a link.
WORDS, SIMILARITY = 5, 0.8
#: Prefix trees, longest label of a tree, and the least chance to meet a pair of just SIMILARITY.
TREES, DEPTH, RECALL = 32, 8, 0.9999


def matched_depth(similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Longest shared prefix to ask for: shortened from `depth` until the chance to share it in some tree is `recall`."""
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's runs of `words` words; of all its words, if it has fewer but any."""
    for _, _, data, offsets in T.slices(T.lower(texts)):
        h, r = T.word_hashes(data, offsets)
        g, at = T.ngrams(h, r, words)
        rows = r[at]
        counts = np.bincount(r, minlength=len(offsets) - 1) if len(r) else np.zeros(len(offsets) - 1, int)
        ends = np.cumsum(counts)
        for k in range(len(offsets) - 1):
            if counts[k] >= words:
                a, b = np.searchsorted(rows, [k, k + 1])
                yield np.unique(g[a:b])
            elif counts[k]:
                yield T.ngrams(h[ends[k] - counts[k] : ends[k]], np.zeros(counts[k], int), int(counts[k]))[0]
            else:
                yield np.zeros(0, np.uint64)


def fingerprint(values: np.ndarray) -> bytes:
    """128 bits that name a set of hashes."""
    with np.errstate(over="ignore"):
        first = np.sum(T.mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)
        second = np.sum(T.mix(values + np.uint64(0x1234567)), dtype=np.uint64) + np.uint64(len(values))
    return first.tobytes() + second.tobytes()


_SEEDS = T.mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signature(values: np.ndarray, depth: int) -> bytes:
    """Labels of all trees, one after the other: `depth` minimum hashes of two bytes each."""
    seeds, least = _SEEDS[: TREES * depth], np.full(TREES * depth, (1 << 64) - 1, np.uint64)
    for at in range(0, len(values), 4096):
        some = values[at : at + 4096, None]
        for low in range(0, len(seeds), 32):
            np.minimum(least[low : low + 32], (some * seeds[None, low : low + 32]).min(axis=0), out=least[low : low + 32])
    return T.mix(least).astype(">u2").tobytes()


def _signed(words: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keys, labels = [], []
            for values in shingle_sets(batch.column(1), words):
                key = fingerprint(values) if len(values) else None
                labels.append(None if key is None or key in seen else signature(values, depth))
                keys.append(key)
                if len(seen) < 100_000:  # only to save work on copies
                    seen.add(key)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(labels, pa.binary())], ["doc_id", "content", "key", "labels"])
        T.give_back()

    return run


def _neighbours():
    """Link each row to the first of its run of labels that share the prefix; also tell each partition's ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "part", "first", "last"]
        types = (pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
        head, now, first, last, part = None, None, None, None, None
        for batch in batches:
            a, b = [], []
            columns = (batch.column(k).to_pylist() for k in range(3))
            for tree, label, key in zip(*columns, strict=True):
                prefix = tree.to_bytes(4, "big") + label
                if prefix == now:
                    if key != head:
                        a.append(head)
                        b.append(key)
                else:
                    now, head = prefix, key
                first = first or (prefix, key)
                last = (prefix, key)
            if batch.num_rows:
                part = batch.column(3)[0].as_py()
            none = [None] * len(a)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((a, b, none, none, none), types, strict=True)], names)
        if first:
            ends = ([first[1]], [last[1]], [part], [first[0]], [last[0]])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(ends, types, strict=True)], names)

    return run


def _sets(words: int):
    """The shingle sets of the rows whose text has the key that is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                sets = list(shingle_sets(part.column(3), words))
                same = [len(s) > 0 and fingerprint(s) == k for s, k in zip(sets, part.column(1).to_pylist(), strict=True)]
                columns = [*part.columns[:3], pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["grp", "key", "n", "values"]).filter(pa.array(same))

    return run


def similar_sets(similarity: float):
    """Matcher of sets in the column `values` by Jaccard similarity."""

    def match(columns: dict, starts: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = columns["values"]
        offsets, flat = values.offsets.to_numpy(), values.values.to_numpy()
        sets = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        size = np.diff(offsets).astype(np.float64)
        found = []
        for low, high in zip(starts[:-1], starts[1:], strict=True):
            if high - low < 2:
                continue
            middle = low + int(np.searchsorted(block[low:high], block[high - 1]))
            left, right = (np.arange(low, high),) * 2 if middle == low else (np.arange(low, middle), np.arange(middle, high))
            both = overlaps(sets, left, right)
            near = both >= similarity * (size[left][:, None] + size[right][None, :] - both) - 1e-9
            a, b = np.nonzero(near)
            a, b = left[a], right[b]
            found.append(np.stack([a[a < b], b[a < b]]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pairs[0], pairs[1]

    return match


def jaccard_groups(
    docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, id_column: str = "doc_id", text_column: str = "text", scratch: Scratch | None = None
) -> DataFrame:
    """Link documents whose sets of `words`-word shingles have a Jaccard similarity of `similarity` or more.

    Words are runs of bytes without white space, in lower case. A text of fewer words has one shingle, all its words;
    null, empty and blank texts have none and link with nothing. Returns one row per document: doc_id, n_links (other
    documents linked directly), component_id (least doc_id reachable), kept (the row stands for its component). Repeated
    rows link with each other and only one is kept. Rows with a null id take part; a component of them alone has a null
    component_id. Other columns are ignored.

    Documents of equal sets are one class. A class enters every tree of the forest with a label of minimum hashes; the
    labels are range-sorted, and rows that share a prefix are linked to the first of their run, so candidates are linear
    in the classes. `matched_depth` shortens the prefix until the target recall. Candidates form groups, inside which all
    classes are compared exactly, in blocks.
    """
    keyed, known, least = _linked(docs, words, similarity, id_column, text_column, scratch or Scratch(docs.sparkSession))
    known = known.join(least, "root").select("key", "n_links", F.col("first.doc_id").alias("component_id"))
    out = keyed.select("doc_id", "key").join(known, "key", "left")
    alone = F.col("key").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _linked(docs: DataFrame, words: int, similarity: float, id_column: str, text_column: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Key of every row, root and links of every key, and first row (known ids before null ones) of every root."""
    depth = matched_depth(similarity)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), content(text_column).alias("content"))
    keyed = scratch.store(rows.mapInArrow(_signed(words, depth), "doc_id long, content long, key binary, labels binary"))
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "content")
    classes = keyed.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min(first).alias("first"), F.max("labels").alias("labels"))
    classes = scratch.store(classes)

    candidates = scratch.store(_candidates(classes, depth, scratch))
    groups = components(candidates, scratch).withColumnsRenamed({"node": "key", "root": "grp"})
    wanted = classes.join(groups, "key").select("grp", "key", "n", F.col("first.doc_id").alias("first_id"), F.col("first.content").alias("first_content"))
    sets = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("content") == F.col("first_content"))).select("grp", "key", "n", "text")
    sets = scratch.store(sets.mapInArrow(_sets(words), "grp binary, key binary, n long, values array<long>"))
    found = resolve(compare_in_groups(sets, similar_sets(similarity), scratch), scratch)
    scratch.drop(sets, candidates)

    known = classes.select("key", "n", "first").join(found, "key", "left").withColumn("root", F.coalesce("root", "key"))
    known = scratch.store(known.select("key", "root", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    least = scratch.store(known.groupBy("root").agg(F.min("first").alias("first")))
    return keyed, known.drop("first"), least


def _candidates(classes: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """Edges (a, b) that connect all classes which share a prefix in some tree."""
    width = 2 * depth
    trees = classes.select(F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "labels", "key")
    trees = trees.select("tree", F.expr(f"substring(labels, tree * {width} + 1, {width})").alias("label"), "key")
    ordered = trees.repartitionByRange("tree", "label", "key").sortWithinPartitions("tree", "label", "key")
    near = ordered.withColumn("part", F.spark_partition_id())
    near = scratch.store(near.mapInArrow(_neighbours(), "a binary, b binary, part int, first binary, last binary"))
    # runs that go on in the next partition
    ends = near.where("part is not null").withColumn("prior", F.lag(F.struct("last", "b")).over(Window.orderBy("part")))
    across = ends.where("prior.last = first").select(F.col("prior.b").alias("a"), F.col("a").alias("b"))
    return near.where("part is null").select("a", "b").union(across).where("a != b").distinct()


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of docs, all columns as they are, of each component of similar rows (see jaccard_groups).

    Each row is a document of its own, also where ids are null or repeat: the row with the least id stays, null ids last,
    and of those the one with the least hash of its text. Texts without a word resemble nothing, so all of them stay.
    """
    scratch = Scratch(docs.sparkSession)
    keyed, _, least = _linked(docs, words, similarity, id_column, text_column, scratch)
    kept = least.select(F.col("first.doc_id").alias("_kept_id"), F.col("first.content").alias("_kept_content"))
    copies = keyed.where("key is not null").groupBy(F.col("doc_id").alias(ID), F.col("content").alias(CONTENT)).agg(F.count("*").alias("n")).where("n > 1")
    copies = scratch.store(copies.join(kept, same("_kept_id", "_kept_content"), "left_semi"))
    blank = keyed.where("key is null").select(F.col("doc_id").alias("_kept_id"), F.col("content").alias("_kept_content")).distinct()
    rows = named(docs, id_column, text_column).join(kept.union(blank), same("_kept_id", "_kept_content"), "left_semi")
    return mark_copies(rows, copies, scratch).where(f"not {AGAIN}").select(*docs.columns)
