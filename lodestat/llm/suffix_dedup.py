"""Removal of long repeated byte strings, found with suffix arrays built by Lyndon-prefix grouping."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm import text as T
from lodestat.llm.identity import dealt
from lodestat.llm.scratch import Scratch

#: Bytes that must repeat; bytes of an anchor, by which the places of equal strings meet.
LENGTH, ANCHOR = 400, 200
#: Text of one batch, strings of one bucket of the anchor table, and distinct surroundings of an anchor in one group.
BATCH_BYTES, BUCKET_ROWS, GROUP = 4 << 20, 1 << 19, 1024
#: Text for each bin of strings that are counted start by start, of which a text may have 28 bytes for each of its own.
BIN_BYTES = 1 << 18
_FULL, _MIXED, _SEND, _LARGE = 1, 2, 4, 8
_POSITION = 24


def suffix_array(symbols: list[int]) -> list[int]:
    """Start positions of the suffixes in order; the end of the string is less than any symbol.

    First the suffixes are grouped by their longest Lyndon prefix: groups, at first one per symbol, are taken in
    descending order, and each suffix of the group raises the suffix it points to, the nearest one to its left that is
    in a lower group. Raised suffixes leave their group for new ones right above it, higher if they were raised more
    often. Then the order inside the groups is emitted: a suffix whose Lyndon prefix ends where the next suffix in order
    begins takes the next place of its group. Both phases are linear; nothing is renamed or solved recursively.
    """
    n = len(symbols)
    members: dict[int, list[int]] = {}
    by_symbol: dict[int, list[int]] = defaultdict(list)
    for i, s in enumerate(symbols):
        by_symbol[s].append(i)
    group, below, above = [0] * n, {}, {}
    last = -1
    for g, s in enumerate(sorted(by_symbol)):
        members[g], below[g], above[g] = by_symbol[s], last, g + 1
        for i in by_symbol[s]:
            group[i] = g
        last = g
    above[last] = -1
    fresh, g = last + 1, last
    skip = list(range(-1, n - 1))  # towards the nearest suffix to the left that is not done yet
    done = bytearray(n)
    previous = [-1] * n
    order: list[int] = []
    while g != -1:
        order.append(g)
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        for i in own:
            done[i] = 1
        raised: dict[int, int] = {}
        for i in own:
            p = skip[i]
            trail = []
            while p != -1 and done[p]:
                trail.append(p)
                p = skip[p]
            for q in trail:
                skip[q] = p
            skip[i] = previous[i] = p
            if p != -1:
                raised[p] = raised.get(p, 0) + 1
        if raised:
            targets: dict[tuple[int, int], list[int]] = defaultdict(list)
            for p, k in raised.items():
                targets[k, group[p]].append(p)
            for k, old in sorted(targets, reverse=True):  # the most often raised first, so lower counts come in between
                up = above[old]
                members[fresh], below[fresh], above[fresh] = targets[k, old], old, up
                below[up] = above[old] = fresh
                for p in targets[k, old]:
                    group[p] = fresh
                fresh += 1
        g = below[g]
    place, at = {}, 0
    for g in reversed(order):
        place[g] = at
        at += len(members[g])
    out, r, j = [0] * n, -1, n
    while True:
        s, stop = j - 1, previous[j] if j < n else -1
        while s != stop:
            g = group[s]
            out[place[g]] = s
            place[g] += 1
            s = previous[s]
        r += 1
        if r == n:
            return out
        j = out[r]


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def repeated_starts(contexts: list[tuple[bytes, int, int]], length: int) -> list[np.ndarray]:
    """For strings (bytes, offset of the common anchor, number of starts): which starts begin a repeated substring.

    A substring of `length` bytes from one of the starts repeats if another string has it at the same distance from the
    anchor. Strings are cut where any two of them part, on either side of the anchor; the pieces become symbols, and the
    suffix array over all strings has next to each suffix the one that it shares most with.
    """
    lefts, rights = [c[:a][::-1] for c, a, _ in contexts], [c[a:] for c, a, _ in contexts]
    cuts = []
    for side in (lefts, rights):
        ordered = sorted(side)
        cuts.append(sorted({0} | {_common(x, y) for x, y in zip(ordered, ordered[1:], strict=False)}))
    symbols: list[int] = []
    names: dict[tuple, int] = {}
    where: list[tuple[int, int]] = []  # string and column of each symbol
    limits = cuts[1]
    for i, (left, right) in enumerate(zip(lefts, rights, strict=True)):
        known = [x for x in cuts[0] if x <= len(left)]
        for low, high in zip(reversed(known[:-1]), reversed(known[1:]), strict=True):
            symbols.append(names.setdefault((-high, left[low:high]), len(names)))
            where.append((i, -high))
        for low, high in zip(limits, limits[1:], strict=False):
            if high > len(right):
                break
            symbols.append(names.setdefault((low, right[low:high]), len(names)))
            where.append((i, low))
        symbols.append(-1 - i)
        where.append((i, 1 << 30))
    order = suffix_array(symbols)
    reach: dict[tuple[int, int], int] = {}
    for x, y in zip(order, order[1:], strict=False):
        k = 0
        while symbols[x + k] == symbols[y + k]:
            k += 1
        if k:
            i, column = where[x + k - 1]
            end = limits[limits.index(column) + 1] if column >= 0 else (-cuts[0][cuts[0].index(-column) - 1])
            for z in (x, y):
                reach[where[z]] = max(end, reach.get(where[z], -1))
    out = []
    for i, (_, anchor, starts) in enumerate(contexts):
        back = anchor - np.arange(starts)
        cut = np.searchsorted(cuts[0], back)  # least cut at or before the start
        best = np.array([reach.get((i, -c), -1) for c in cuts[0]] + [-1])
        out.append(best[cut] >= length - back)
    return out


class Runs:
    """Runs of starts in a slice of texts whose strings of `length` bytes have the same anchor.

    The anchor of a string is its ANCHOR-byte substring of least hash, the first of equals, so equal strings have equal
    anchors at equal offsets. Per run: row, first start, number of starts, anchor offset, hash of the anchor, and hash of
    all that the strings of the run cover.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, anchor: int):
        parts = []
        for low in range(0, max(1, len(data) - length + 1), 1 << 20):
            parts.append(self._part(data, offsets, low, min(len(data), low + (1 << 20) + length - 1), length, anchor))
        self.row, self.start, self.count, self.offset, self.hash, self.whole = (np.concatenate(x) for x in zip(*parts, strict=True))

    @staticmethod
    def _part(data, offsets, low, high, length, anchor):
        n, w = high - low, length - anchor + 1
        if n < length:
            return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
        sums = T.prefix_sums(data[low:high])
        at = np.arange(n - anchor + 1)
        grams = T.span_hashes(sums, at, at + anchor)
        mask = np.uint64((1 << _POSITION) - 1)
        key = (grams & ~mask) | at.astype(np.uint64)
        padded = np.concatenate([key, np.full(-len(key) % w, (1 << 64) - 1, np.uint64)]).reshape(-1, w)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        m = n - length + 1
        least = (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & mask).astype(np.int64)
        row = np.searchsorted(offsets, np.arange(low, low + m), "right") - 1
        starts = np.flatnonzero(np.arange(low, low + m) + length <= offsets[row + 1])
        if not len(starts):
            return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
        own = least[starts]
        cut = np.flatnonzero((np.diff(own) != 0) | (np.diff(starts) != 1))
        first, last = starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)]
        own = least[first]
        whole = T.mix(T.span_hashes(sums, first, last + length) ^ T.mix((own - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)))
        return row[first], first + low, last - first + 1, own - first, grams[own], whole


def _visits(texts: pa.ChunkedArray, length: int, anchor: int):
    """Slices of the batch with their runs."""
    if texts.num_chunks:
        for low, _, data, offsets in T.slices(pa.concat_arrays([c.cast(pa.string()) for c in texts.chunks]), limit=1 << 20):
            yield low, data, offsets, Runs(data, offsets, length, anchor)


_PAIR = np.dtype([("h", np.uint64), ("w", np.uint64)])


def _pairs(hashes: np.ndarray, whole: np.ndarray) -> np.ndarray:
    out = np.empty(len(hashes), _PAIR)
    out["h"], out["w"] = hashes, whole
    return out


def _known(visits: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (anchor hash, whole hash) of a batch, and how often each occurs."""
    parts = [(r.hash, r.whole) for _, _, _, r in visits]
    h = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
    w = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint64)
    order = np.lexsort((w, h))
    h, w = h[order], w[order]
    fresh = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (w[1:] != w[:-1]))) if len(h) else np.zeros(0, np.int64)
    return _pairs(h[fresh], w[fresh]), np.diff(np.append(fresh, len(h)))


def _requests(length: int, anchor: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        known, counts = _known(list(_visits(table["text"], length, anchor)))
        bucket = ((known["h"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(cuts))
        lists = pa.array(np.append(cuts[some], len(known)), pa.int32())
        columns = [pa.array(some, pa.int32()), pa.array(np.full(len(some), table["batch"][0].as_py()), pa.int32())]
        for values in (known["h"].view(np.int64), known["w"].view(np.int64), np.minimum(counts, 2)):
            columns.append(pa.ListArray.from_arrays(lists, pa.array(np.ascontiguousarray(values))))
        return pa.Table.from_arrays(columns, ["bucket", "batch", "h", "w", "n"])

    return run


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in column.chunks]) if column.num_chunks else np.zeros(0, np.int64)


def _respond(group: int):
    """What becomes of each (anchor, whole): repeated in full; other surroundings exist; who sends the bytes; too many."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("batch")
        sizes = table["h"].combine_chunks().value_lengths().to_numpy()
        h, w, n = (_flat(table[c]) for c in ("h", "w", "n"))
        order = np.lexsort((w, h))  # stable: the first of equals is of the first batch
        hs, ws = h[order], w[order]
        fresh = np.append(True, (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1]))
        pair = np.cumsum(fresh) - 1
        total = np.bincount(pair, weights=n[order])
        anchor = np.cumsum(np.append(True, hs[fresh][1:] != hs[fresh][:-1])) - 1
        kinds = np.bincount(anchor)[anchor]
        status = np.where(total > 1, _FULL, 0) | np.where(kinds > 1, _MIXED, 0) | np.where(kinds > group, _LARGE, 0)
        answer = np.empty(len(h), np.uint8)
        answer[order] = status[pair] | np.where(fresh, _SEND, 0)
        ends = np.cumsum(sizes)
        parts = [answer[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True)]
        return pa.Table.from_arrays([table["batch"].combine_chunks(), table["bucket"].combine_chunks(), pa.array(parts, pa.binary())], ["batch", "bucket", "status"])

    return run


def _answered(answers: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(answers.sort_by("bucket")["status"].to_pylist()), np.uint8)


_CONTEXT = "batch int, h long, w long, bytes binary, anchor int, starts int, bin int, piece array<long>, hs array<long>, ws array<long>, at array<int>"
_FOUND = "batch int, hs array<long>, ws array<long>, at array<int>"
_LISTS = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))


def _contexts(length: int, anchor: int, bins: int):
    """Bytes around the anchors that have several surroundings, each sent by one batch.

    Where these are too many for one group, the hash of the string at each start is sent instead, packed by its bin.
    """

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["batch", "h", "w", "bytes", "anchor", "starts", "bin", "piece", "hs", "ws", "at"]
        types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), *_LISTS)
        rows, tables = [], []
        batch = docs["batch"][0].as_py() if docs.num_rows else None
        if docs.num_rows:
            visits = list(_visits(docs["text"], length, anchor))
            known, _ = _known(visits)
            status = _answered(answers)
            sent = np.zeros(len(known), bool)
            for _, data, _, runs in visits:
                wide = []
                at = np.searchsorted(known, _pairs(runs.hash, runs.whole))
                for k in np.flatnonzero((status[at] & (_MIXED | _SEND)) == (_MIXED | _SEND)):
                    if sent[at[k]]:
                        continue
                    sent[at[k]] = True
                    a, n = int(runs.start[k]), int(runs.count[k])
                    h, w = runs.hash[k].view(np.int64), runs.whole[k].view(np.int64)
                    whole = data[a : a + n - 1 + length]
                    if status[at[k]] & _LARGE:
                        s = np.arange(n)
                        wide.append(np.stack([T.span_hashes(T.prefix_sums(whole), s, s + length).view(np.int64), np.full(n, h), np.full(n, w), s]))
                    else:
                        full = bool(status[at[k]] & _FULL)
                        rows.append((batch, int(h), int(w), whole.tobytes(), int(runs.offset[k]), -n if full else n, *[None] * 5))
                if wide:
                    # One slice of text at a time: its strings take many times its bytes.
                    binned, lists = _binned(np.concatenate(wide, axis=1), bins)
                    few = len(binned)
                    columns = [pa.array(np.full(few, batch, np.int32)), *[pa.nulls(few, t) for t in types[1:6]], pa.array(binned, pa.int32()), *lists]
                    tables.append(pa.Table.from_arrays(columns, names))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 11
        tables.append(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names))
        return pa.concat_tables(tables)

    return run


def _binned(flat: np.ndarray, bins: int) -> tuple[np.ndarray, list[pa.ListArray]]:
    """Bins of the hashes in the first row, and all rows as lists by bin."""
    bin_ = (flat[0].view(np.uint64) % np.uint64(bins)).astype(np.int64)
    order = np.argsort(bin_, kind="stable")
    bin_ = bin_[order]
    fresh = np.flatnonzero(np.append(True, bin_[1:] != bin_[:-1]))
    ends = pa.array(np.append(fresh, len(bin_)), pa.int32())
    kinds = (pa.int64(), *(t.value_type for t in _LISTS))
    return bin_[fresh], [pa.ListArray.from_arrays(ends, pa.array(x[order], t)) for x, t in zip(flat, kinds, strict=True)]


def _by_batch(batch: np.ndarray, hs: np.ndarray, ws: np.ndarray, at: np.ndarray) -> pa.Table:
    """Starts that repeat, one row per batch that holds them."""
    order = np.argsort(batch, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(batch[order])) + 1) if len(order) else []
    columns = [pa.array([batch[p[0]] for p in parts], pa.int32())]
    columns += [pa.array([x[p] for p in parts], t) for x, t in zip((hs, ws, at), _LISTS, strict=True)]
    return pa.Table.from_arrays(columns, ["batch", "hs", "ws", "at"])


def _grouped(length: int):
    """Repeated starts of the strings of each anchor; a negative number of starts is known to repeat in full."""

    def run(table: pa.Table) -> pa.Table:
        rows = [np.zeros((4, 0), np.int64)]
        frame = table.select(["batch", "h", "w", "bytes", "anchor", "starts"]).to_pandas()
        for _, same in frame.groupby("h", sort=False):
            if len(same) < 2:
                continue
            contexts = [(b, a, abs(n)) for b, a, n in zip(same["bytes"], same["anchor"], same["starts"], strict=True)]
            for found, batch, h, w, n in zip(repeated_starts(contexts, length), same["batch"], same["h"], same["w"], same["starts"], strict=True):
                if n > 0 and found.any():
                    at = np.flatnonzero(found)
                    rows.append(np.stack([np.full(len(at), batch), np.full(len(at), h), np.full(len(at), w), at]))
        return _by_batch(*np.concatenate(rows, axis=1))

    return run


def _counted(table: pa.Table) -> pa.Table:
    """Starts whose string occurs more than once in the bin."""
    batch = np.repeat(table["batch"].to_numpy(), table["piece"].combine_chunks().value_lengths().to_numpy())
    _, where, many = np.unique(_flat(table["piece"]), return_inverse=True, return_counts=True)
    again = many[where] > 1
    return _by_batch(batch[again], *(_flat(table[c])[again] for c in ("hs", "ws", "at")))


_KEPT = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"


def _cut(length: int, anchor: int):
    """Mark what repeats and keep the rest."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        ids, rows = docs["doc_id"].to_pylist(), []
        if docs.num_rows:
            visits = list(_visits(docs["text"], length, anchor))
            known, _ = _known(visits)
            told = answers.filter(pc.is_valid(answers["status"]))
            extra = answers.filter(pc.is_null(answers["status"]))
            status = _answered(told)
            extra_at = np.searchsorted(known, _pairs(_flat(extra["hs"]).view(np.uint64), _flat(extra["ws"]).view(np.uint64)))
            extra_start = _flat(extra["at"])
            run_of = np.full(len(known) + 1, -1)
            for _, data, offsets, runs in visits:
                pairs = _pairs(runs.hash, runs.whole)
                at = np.searchsorted(known, pairs)
                full = (status[at] & _FULL) > 0 if len(at) else np.zeros(0, bool)
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, runs.start[full], 1)
                np.add.at(edge, runs.start[full] + runs.count[full] - 1 + length, -1)
                run_of[at] = np.arange(len(at))  # these occur once
                here = run_of[extra_at]
                s = runs.start[here[here >= 0]] + extra_start[here >= 0]
                run_of[at] = -1
                np.add.at(edge, s, 1)
                np.add.at(edge, s + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                change = np.zeros(len(data) + 1, bool)
                change[1:-1] = gone[1:] != gone[:-1]
                change[offsets] = True
                cuts = np.flatnonzero(change)
                first = np.searchsorted(cuts, offsets)
                for k in range(len(offsets) - 1):
                    own = cuts[first[k] : first[k + 1] + 1] if offsets[k + 1] > offsets[k] else cuts[:0]
                    spans = [(int(x - offsets[k]), int(y - offsets[k])) for x, y in zip(own, own[1:], strict=False) if gone[x]]
                    text = data[offsets[k] : offsets[k + 1]]
                    kept = text[~gone[offsets[k] : offsets[k + 1]]].tobytes() if spans else text.tobytes()
                    rows.append((ids[len(rows)], len(text), [{"start": a, "end": b} for a, b in spans], kept))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        types = (pa.int64(), pa.int64(), span, pa.binary())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "n_bytes", "spans", "kept"])

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Remove each byte that a string of `length` bytes covers which also starts anywhere else in the corpus.

    Texts are UTF-8 bytes (null: none); strings do not cross documents, may overlap, and are judged on the input.
    Returns one row per document: doc_id, n_bytes, spans (removed runs: start, end) and kept (the rest, which need not be
    valid UTF-8). Repeated rows are documents of their own and so repeat each other. Ids may be null. Other columns are
    ignored.

    Every string of `length` bytes has an anchor that depends on its content alone, and consecutive strings of the same
    anchor form a run. Batches of documents ask the hash buckets of the anchor table which of their runs occur again.
    Runs equal in full repeat. Where an anchor has different surroundings, one batch for each of these sends its bytes,
    and a suffix array over the group decides which strings repeat; a group beyond GROUP surroundings is instead decided
    start by start through an aggregation of string hashes. Equality of runs rests on 64-bit hashes of anchor and whole.
    """
    scratch = Scratch(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(text_column)).alias("n")).first()["n"] or 0
    batches = max(1, -(-total // BATCH_BYTES))
    buckets = max(1, -(-total // ((length - anchor) // 2 * BUCKET_ROWS)))
    rows = dealt(docs, id_column, text_column, batches, scratch)
    requests = rows.groupBy("batch").applyInArrow(_requests(length, anchor, buckets), "bucket int, batch int, h array<long>, w array<long>, n array<long>")
    answers = scratch.store(requests.groupBy("bucket").applyInArrow(_respond(GROUP), "batch int, bucket int, status binary"))

    bins = max(1, total // (1 << 22))
    contexts = rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_contexts(length, anchor, max(1, total // BIN_BYTES)), _CONTEXT)
    contexts = scratch.store(contexts)
    small = contexts.where("bytes is not null").withColumn("bin", F.pmod(F.xxhash64("h"), F.lit(bins)))
    found = small.groupBy("bin").applyInArrow(_grouped(length), _FOUND)
    wide = contexts.where("piece is not null").groupBy("bin").applyInArrow(_counted, _FOUND)
    extra = found.union(wide).select("batch", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("status"), "hs", "ws", "at")
    extra = scratch.store(extra)
    told = answers.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("hs", "array<long>"), ("ws", "array<long>"), ("at", "array<int>"))))
    return rows.groupBy("batch").cogroup(told.unionByName(extra).groupBy("batch")).applyInArrow(_cut(length, anchor), _KEPT)
