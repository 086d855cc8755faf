"""Bounded-space online best-fit packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of a bucket: one run of the packer, with its own open bins.
BUCKET_ROWS = 65536
#: Distinct words whose ids a Python worker remembers: as many of late, and those they replaced.
CACHED_WORDS = 300_000
#: Words of visible ASCII without the apostrophe of contractions and the bracket of added tokens; pieces of one in lower case.
_PLAIN = re.compile("[!-&(-;=-~]+")
_PIECE = re.compile("[a-z]+|[0-9]|[^a-z0-9]+")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path), {}, {}


@lru_cache(maxsize=2)
def _splits_plainly(tokenizer) -> bool:
    """Whether the tokenizer takes _PLAIN words in lower case and by _PIECE, as seen on all words of two characters."""
    if getattr(tokenizer, "normalizer", None) is None or getattr(tokenizer, "pre_tokenizer", None) is None:
        return False
    if any(_PLAIN.fullmatch(t.content) for t in tokenizer.get_added_tokens_decoder().values()):
        return False
    signs = [c for c in map(chr, range(128)) if _PLAIN.fullmatch(c)]
    words = [a + b for a in signs for b in signs]
    text = tokenizer.normalizer.normalize_str(" ".join(words))
    pieces = [p for w in words for p in _PIECE.findall(w.lower())]
    return text == " ".join(words).lower() and [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)] == pieces


def _encoded(tokenizer, plainly: bool, words: list[str]) -> Iterator[tuple[str, bytes]]:
    """Each word and its ids.

    Pieces of plain words go to the tokenizer's model at once, as normalising and splitting costs more than it does. Other
    words are encoded many at a time and told apart by their character offsets.
    """
    others = words
    if plainly:
        others, tokenize = [], tokenizer.model.tokenize
        for word in words:
            if _PLAIN.fullmatch(word):
                yield word, b"".join([t.id.to_bytes(4, sys.byteorder) for p in _PIECE.findall(word.lower()) for t in tokenize(p)])
            else:
                others.append(word)
    for low in range(0, len(others), 4096):
        some = others[low : low + 4096]
        encoded = tokenizer.encode(" ".join(some), add_special_tokens=False)
        starts = np.cumsum([0] + [len(w) + 1 for w in some])
        ids = np.array(encoded.ids, np.uint32).tobytes()
        cuts = 4 * np.searchsorted([a for a, _ in encoded.offsets], starts)
        for word, (low_byte, high_byte) in zip(some, pairwise(cuts.tolist()), strict=True):
            yield word, ids[low_byte:high_byte]


def token_ids(texts: list[str], path: str, ends: int) -> Iterator[np.ndarray]:
    """Ids of each text and then `ends`, as unsigned 32-bit.

    The tokenizer splits at white space and treats each word alone, so words seen before come from a cache. Is it
    full, a new one begins, and words of the one before move over as they occur again; so frequent words stay.
    """
    tokenizer, cache, older = _tokenizer(path)
    plainly = _splits_plainly(tokenizer)
    end = np.uint32(ends).tobytes()
    for text in texts:
        if not text.isprintable() and any(c in text for c in "\x1c\x1d\x1e\x1f\x85"):
            ids = tokenizer.encode(text, add_special_tokens=False).ids
            yield np.array([*ids, ends], np.uint32)
            continue
        words = text.split()
        new = list(set(words).difference(cache))
        if len(cache) + len(new) > CACHED_WORDS:
            older.clear()
            older.update(cache)
            cache.clear()
            new = list(set(words))
        if older:
            known = [w for w in new if w in older]
            cache.update((w, older[w]) for w in known)
            new = [w for w in new if w not in older] if known else new
        cache.update(_encoded(tokenizer, plainly, new))
        yield np.frombuffer(b"".join([*map(cache.__getitem__, words), end]), np.uint32)


def _pieces(path: str, capacity: int, ends: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                keys, rows = part.column(0).to_pylist(), []
                texts = pc.fill_null(part.column(1), "").to_pylist()
                for key, ids in zip(keys, token_ids(texts, path, ends), strict=True):
                    raw = ids.astype("<u4", copy=False)
                    for k, at in enumerate(range(0, len(raw), capacity)):
                        cut = raw[at : at + capacity]
                        rows.append((key, k, at, len(cut), zlib.crc32(cut.tobytes())))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class BestFit:
    """At most `bins` open sequences, found by free space in a bitset.

    A piece goes to the open sequence with the least free space that holds it. If none does, a new one opens; is the
    number of open ones reached, the fullest closes first. Full ones close at once.
    """

    def __init__(self, capacity: int, bins: int, first: int):
        self.capacity, self.bins, self.next = capacity, bins, first
        self.bits, self.count = 0, 0
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, space: int) -> int:
        held = self.free[space]
        found = held.pop()
        if not held:
            self.bits ^= 1 << space
        self.count -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """Sequence and offset of a piece."""
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            sequence = self._take(space)
        else:
            space, sequence = self.capacity, self.next
            self.next += 1
        left = space - length
        if left:
            if self.count == self.bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.free[left].append(sequence)
            self.bits |= 1 << left
            self.count += 1
        return sequence, self.capacity - space


def _pack(capacity: int, bins: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, now = None, None
        for frame in frames:
            placed = np.zeros((len(frame), 2), np.int64)
            for k, (bucket, length) in enumerate(zip(frame["bucket"].to_numpy(), frame["length"].tolist(), strict=True)):
                if bucket != now:
                    packer, now = BestFit(capacity, bins, int(bucket) << 40), bucket
                placed[k] = packer.place(length)
            yield frame[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=placed[:, 0], offset=placed[:, 1])

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, bins: int = 4096, ends: int = 0, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Pack tokenised documents into sequences of at most `capacity` tokens.

    A document is its ids and then `ends`. Longer ones are cut into pieces of `capacity`; shorter ones stay whole. Rows
    are dealt into buckets of about BUCKET_ROWS documents by a hash of the id and arrive there in hash order, which is a
    shuffle that any retry repeats; each bucket is packed online (see BestFit) with `bins` open sequences.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are
    the single token `ends`. Repeated rows are packed each. Ids may be null. Other columns are ignored. No row: no row.
    `tokenizer` is a file that every executor can read.
    """
    buckets = max(1, round(docs.count() / BUCKET_ROWS))
    pieces = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(_pieces(tokenizer, capacity, ends), PIECES)
    turn = F.xxhash64("doc_id", F.lit(29))
    return (
        pieces.withColumn("turn", turn)
        .withColumn("bucket", F.pmod(F.col("turn"), F.lit(buckets)))
        .repartition("bucket")
        .sortWithinPartitions("bucket", "turn", "doc_id", "piece", "length", "ids_crc32")
        .mapInPandas(_pack(capacity, bins), PACKED)
    )
