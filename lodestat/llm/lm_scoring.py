"""Stupid-backoff language-model scores from n-gram counts of the whole corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm import text as T
from lodestat.llm.identity import dealt
from lodestat.llm.scratch import Scratch

#: Text of one batch of documents, and n-grams of one hash bucket of the count table, on average.
BATCH_BYTES, BUCKET_GRAMS = 4 << 20, 1 << 20
#: Stands for the n-gram of no word, whose count is the number of tokens.
_EMPTY = np.uint64(0)
_BOX = "batch int, box binary"
_REQUEST = "bucket int, batch int, grams binary, counts binary"
_RESPONSE = "batch int, bucket int, totals binary"
_SCORED = "doc_id long, n_tokens long, n_backoff long, log_score double"


def _grams(texts: pa.ChunkedArray, order: int) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """Per order k: hash, row and position (of the last word) of each k-gram; and the number of tokens."""
    hashes, rows = [], []
    for low, _, data, offsets in T.slices(T.lower(pa.concat_arrays([c.cast(pa.string()) for c in texts.chunks]) if texts.num_chunks else pa.array([], pa.string()))):
        h, r = T.word_hashes(data, offsets)
        hashes.append(h)
        rows.append(low + r)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    r = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    out = []
    for k in range(1, order + 1):
        g, at = T.ngrams(h, r, k)
        out.append((g, r[at], at + k - 1))
    return out, len(h)


def _boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each batch, compressed together, as the texts are most of what is shuffled."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for rows in batches:
        rows = rows.sort_by("batch")
        batch = rows["batch"].to_numpy()
        first = np.flatnonzero(np.diff(batch, prepend=-1))
        boxes = []
        for low, high in zip(first, np.append(first, len(batch))[1:], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
                writer.write_batch(rows.slice(low, high - low))
            boxes.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(batch[first], pa.int32()), pa.array(boxes, pa.binary())], ["batch", "box"])


def _unboxed(table: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(box.as_buffer()).read_all() for box in table["box"]])


def _tidy(run):
    """Run, and return what memory it leaves free; the next group need not grow the worker."""

    def tidied(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            T.give_back()

    return tidied


def _tidy_pair(run):
    def tidied(left: pa.Table, right: pa.Table) -> pa.Table:
        return _tidy(lambda both: run(*both))((left, right))

    return tidied


def _planes(counts: np.ndarray) -> bytes:
    """Numbers as all their lowest bytes, then all the next ones, of which most are zero; compressed, after their size."""
    planes = np.ascontiguousarray(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _numbers(packed: list[bytes]) -> np.ndarray:
    """The numbers of several planes in a row."""
    planes = [pa.decompress(p[8:], int.from_bytes(p[:8], "little"), codec="zstd", asbytes=True) for p in packed]
    parts = [np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(8, -1).T).view("<i8").ravel() for p in planes]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _requests(order: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        grams, tokens = _grams(_unboxed(table)["text"], order)
        found, counts = np.unique(np.concatenate([g for g, _, _ in grams]), return_counts=True)
        found, counts = np.concatenate([[_EMPTY], found]), np.concatenate([[tokens], counts])
        cuts = np.searchsorted(_bucket(found, buckets), np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(cuts))
        return pa.Table.from_arrays(
            [
                pa.array(some, pa.int32()),
                pa.array(np.full(len(some), table["batch"][0].as_py()), pa.int32()),
                pa.array([_packed(found[cuts[k] : cuts[k + 1]], k, buckets) for k in some], pa.binary()),
                pa.array([_planes(counts[cuts[k] : cuts[k + 1]]) for k in some], pa.binary()),
            ],
            ["bucket", "batch", "grams", "counts"],
        )

    return run


def _start(bucket: int, buckets: int) -> int:
    """Least n-gram hash of a bucket."""
    return -(-(bucket << 32) // buckets) << 32


def _packed(grams: np.ndarray, bucket: int, buckets: int) -> bytes:
    """Sorted n-grams of a bucket as the gaps between them, byte by byte as far as the widest gap goes.

    Only the highest bytes are far from evenly spread, so they alone are compressed. Number, width and their size lead.
    """
    gaps = np.diff(grams, prepend=np.uint64(_start(bucket, buckets)))
    width = max(1, -(-int(gaps.max()).bit_length() // 8))
    planes = np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    high = pa.compress(planes[-1].tobytes(), codec="zstd", asbytes=True)
    return np.array([len(gaps), width, len(high)], "<i8").tobytes() + high + planes[:-1].tobytes()


def _unpacked(data: bytes, bucket: int, buckets: int) -> np.ndarray:
    n, width, size = np.frombuffer(data, "<i8", 3).tolist()
    wide = np.zeros((n, 8), np.uint8)
    wide[:, width - 1] = np.frombuffer(pa.decompress(data[24 : 24 + size], n, codec="zstd", asbytes=True), np.uint8)
    if width > 1:
        wide[:, : width - 1] = np.frombuffer(data, np.uint8, offset=24 + size).reshape(width - 1, n).T
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64) + np.uint64(_start(bucket, buckets))


def _bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the high bits, so sorted n-grams are sorted by bucket."""
    return ((grams >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _respond(buckets: int):
    """Totals of every requested n-gram over all batches, in the order asked."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        asked = [_unpacked(g.as_py(), bucket, buckets) for g in table["grams"]]
        _, where = np.unique(np.concatenate(asked), return_inverse=True)
        totals = np.bincount(where, weights=_numbers(table["counts"].to_pylist())).astype(np.int64)[where]
        ends = np.cumsum([len(g) for g in asked])
        told = [_planes(totals[end - len(g) : end]) for g, end in zip(asked, ends, strict=True)]
        return pa.Table.from_arrays([table["batch"].combine_chunks(), table["bucket"].combine_chunks(), pa.array(told, pa.binary())], ["batch", "bucket", "totals"])

    return run


def _counts(grams: np.ndarray, rows: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Total and count in its own row of every n-gram; `totals` is in their order, after the count of the empty one."""
    if not len(grams):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    which, known = pd.factorize(grams)
    total = np.empty(len(known), np.int64)
    total[np.argsort(known)] = totals[1:]
    pair = rows * len(known) + which
    order = np.argsort(pair)
    first = np.flatnonzero(np.diff(pair[order], prepend=-1))
    many = np.diff(np.append(first, len(pair)))
    total, own = total[which], np.empty(len(grams), np.int64)
    own[order] = np.repeat(many, many)
    return total, own


def _score(order: int, backoff: float):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _unboxed(docs)
        grams, tokens = _grams(docs["text"], order)
        n = docs.num_rows
        totals = _numbers(answers.sort_by("bucket")["totals"].to_pylist())
        # counts without the document itself, for the k-gram that ends at each token; -1 where there is none
        other = np.full((order + 1, tokens), -1, np.int64)
        row = grams[0][1] if order else np.zeros(0, np.int64)
        other[0] = (totals[0] if len(totals) else 0) - np.bincount(row, minlength=n)[row]
        total, own = _counts(np.concatenate([g for g, _, _ in grams]), np.concatenate([r for _, r, _ in grams]), totals)
        context = np.zeros((order + 1, tokens), np.int64)
        low = 0
        for k, (g, _, at) in enumerate(grams, 1):
            other[k, at] = total[low : low + len(g)] - own[low : low + len(g)]
            low += len(g)
            # the context is the (k-1)-gram that ends one token earlier
            context[k, at] = other[k - 1, at - 1] if k > 1 else other[0, at]
        depth = np.zeros(tokens, np.int64)  # words in the longest n-gram there is
        for k in range(1, order + 1):
            depth[other[k] >= 0] = k
        value, level = np.zeros(tokens), np.zeros(tokens, np.int64)
        for k in range(1, order + 1):
            hit = other[k] > 0
            value[hit] = other[k][hit] / np.maximum(context[k][hit], 1)
            level[hit] = k
        unseen = level == 0
        value[unseen] = 1.0 / np.maximum(other[0][unseen], 1)
        level[unseen] = 1
        logs = np.log10(value) + np.log10(backoff) * (depth - level)
        columns = [
            docs["doc_id"].combine_chunks(),
            pa.array(np.bincount(row, minlength=n), pa.int64()),
            pa.array(np.bincount(row[depth > level], minlength=n), pa.int64()),
            pa.array(np.bincount(row, weights=logs, minlength=n).astype(np.float64)),
        ]
        return pa.Table.from_arrays(columns, ["doc_id", "n_tokens", "n_backoff", "log_score"])

    return run


def stupid_backoff_scores(
    docs: DataFrame,
    order: int = 3,
    backoff: float = 0.4,
    id_column: str = "doc_id",
    text_column: str = "text",
    batch_bytes: int = BATCH_BYTES,
    bucket_grams: int = BUCKET_GRAMS,
) -> DataFrame:
    """Score every document by the n-gram counts of all the others.

    Tokens are runs of bytes without white space, in lower case. The score of a token is count(n-gram) / count(context)
    for the longest n-gram of at most `order` words that other documents hold, times `backoff` for each word left off;
    a token that no other document has counts as seen once. Returns doc_id, n_tokens, n_backoff (tokens scored below
    their longest n-gram) and log_score (sum of log10). Null, empty and blank texts have 0 tokens and log_score 0.
    Repeated rows are documents of their own. Ids may be null. A very long text is one batch. Other columns are ignored.

    Documents are dealt into batches; a batch sends its distinct n-grams with counts to the hash buckets of
    the count table, which add up and answer in the same order. So common n-grams are pre-aggregated, each bucket is of
    bounded size and texts are shuffled once, compressed, for both visits to a batch. A batch sends no more lists than it has
    n-grams; `batch_bytes` may grow with the memory of a task.
    """
    total = docs.agg(F.sum(F.octet_length(text_column)).alias("n")).first()["n"] or 0
    batches = max(1, -(-total // batch_bytes))
    buckets = max(1, -(-total * order // (6 * bucket_grams)))
    rows = dealt(docs, id_column, text_column, batches, Scratch(docs.sparkSession)).mapInArrow(_boxed, _BOX)
    requests = rows.groupBy("batch").applyInArrow(_tidy(_requests(order, buckets)), _REQUEST)
    answers = requests.groupBy("bucket").applyInArrow(_tidy(_respond(buckets)), _RESPONSE)
    return rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_tidy_pair(_score(order, backoff)), _SCORED)
