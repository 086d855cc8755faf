"""Removal of repeated byte strings against counting every string of every text."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestat.llm import suffix_dedup
from lodestat.llm.suffix_dedup import without_repeats


def plain_repeats(texts, length):
    """(spans, kept) of each text, by counting all its strings of `length` bytes."""
    data = [(t or "").encode() for t in texts]
    starts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if starts[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        edges = [i for i in range(len(d) + 1) if (i < len(d) and gone[i]) != (i > 0 and gone[i - 1])]
        out.append((list(zip(edges[::2], edges[1::2])), bytes(b for b, g in zip(d, gone) if not g)))
    return out


@pytest.mark.parametrize("group", [2, 1024])
def test_every_repeated_string_goes(spark, monkeypatch, group):
    # groups of more surroundings than `group` are decided by counting, smaller ones by suffix arrays
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    draw = random.Random(17)
    words = [f"{draw.choice('abcdeé')}{draw.randrange(9)}" for _ in range(12)]
    say = lambda n: " ".join(draw.choice(words) for _ in range(n))
    passages = [say(40) for _ in range(6)]
    texts = []
    for k in range(150):
        text = say(draw.randint(0, 60))
        if k % 2:  # whole or in part, amid other text, so that few surroundings are alike
            passage = draw.choice(passages)
            low = draw.randrange(len(passage) // 2)
            text += passage[low : low + draw.randint(30, len(passage))] + say(draw.randint(0, 20))
        if k % 10 == 0:  # strings that repeat inside one text
            text += draw.choice(["ab", "x", "abc "]) * draw.randint(20, 80)
        texts.append(text)
    texts += [None, "", "short", "short", passages[0], passages[0], passages[0] * 3, "é" * 90]
    docs = spark.createDataFrame([(k if k % 7 else None, t, k) for k, t in enumerate(texts)], "doc_id long, text string, spans int")
    want = sorted((str(k if k % 7 else None), len((t or "").encode()), spans, kept) for (k, t), (spans, kept) in zip(enumerate(texts), plain_repeats(texts, 40)))
    got = sorted((str(r["doc_id"]), r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in without_repeats(docs, 40, 20).collect())
    assert got == want and sum(bool(w[2]) for w in want) > 80
    assert without_repeats(docs.limit(0), 40, 20).count() == 0


def test_strings_of_many_surroundings_take_bounded_memory():
    """Hashes of the strings at each start are made a slice of text at a time."""
    import tracemalloc

    text = np.random.default_rng(3).integers(97, 123, 4 << 20).astype(np.uint8).tobytes().decode()
    docs = pa.table({"batch": pa.array([0] * 64, pa.int32()), "text": [text[k << 16 : (k + 1) << 16] for k in range(64)]})
    known, _ = suffix_dedup._known(list(suffix_dedup._visits(docs["text"], 400, 200)))
    status = bytes([suffix_dedup._MIXED | suffix_dedup._SEND | suffix_dedup._LARGE]) * len(known)
    answers = pa.table({"batch": pa.array([0], pa.int32()), "bucket": pa.array([0], pa.int32()), "status": pa.array([status], pa.binary())})
    tracemalloc.start()
    made = suffix_dedup._contexts(400, 200, 7)(docs, answers)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    starts = sum(max(0, (1 << 16) - 399) for _ in range(64))
    assert sum(len(x) for x in made["piece"].to_pylist()) == starts
    assert all((np.array(p).view(np.uint64) % 7 == b).all() for p, b in zip(made["piece"].to_pylist()[:3], made["bin"].to_pylist()))
    assert peak < 300 << 20
