"""Small brute-force checks of the text operators."""

from __future__ import annotations

import random
import zlib

import pytest

from lodestat.llm.line_dedup import without_repeated_lines
from lodestat.llm.links import components
from lodestat.llm.ngram_join import jaccard_groups, keep_one
from lodestat.llm.packing import BestFit
from lodestat.llm.scratch import Scratch
from lodestat.llm.sharding import shard_documents
from lodestat.llm.suffix_dedup import suffix_array, without_repeats

SCHEMA = "doc_id long, text string, source string, shard int"


@pytest.fixture
def docs(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "a", 9), (2, text, "a", 9), (3, None, None, None), (4, "", "b", 1), (None, "odd\nlines here", "b", 1), (4, "", "b", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_suffix_array():
    draw = random.Random(1)
    for _ in range(500):
        s = [draw.randint(0, 3) for _ in range(draw.randint(1, 40))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_repeats(docs):
    rows = {r["doc_id"]: r for r in without_repeats(docs, length=20, anchor=10).collect()}
    assert bytes(rows[1]["kept"]) == b"" and rows[3]["n_bytes"] == 0 and rows[None]["spans"] == []


def test_groups(docs):
    rows = {r["doc_id"]: r for r in jaccard_groups(docs).collect()}
    assert rows[2]["component_id"] == 1 and not rows[2]["kept"] and rows[1]["n_links"] == 1 and rows[3]["kept"] and rows[4]["n_links"] == 0


def test_lines(docs):
    rows = {r["doc_id"]: r["text"] for r in without_repeated_lines(docs).collect()}
    assert rows[2] == "" and rows[1].startswith("one") and rows[3] is None


def test_rows_without_an_id_of_their_own(spark):
    """Null and repeated ids, and rows that repeat in full, change neither what goes nor what stays."""
    text = "a b c d e f g h"
    rows = [(None, "a b c d e\nfoo"), (None, "unique one\na b c d e"), (5, "left right up down\nbar"), (5, "left right up down\nbaz")]
    rows += [(7, "six seven eight\n\nnine"), (7, "six seven eight\n\nnine"), (7, "six seven eight\n\nnine"), (None, "ten\nten"), (None, "ten\nten"), (8, None), (8, None), (8, ""), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in without_repeated_lines(docs).collect()), key=str)
    want = [(None, "a b c d e\nfoo", 0), (None, "unique one", 1), (7, "six seven eight\n\nnine", 0), (7, "", 2), (7, "", 2), (None, "ten", 1), (None, "", 2), (8, None, 0), (8, None, 0), (8, "", 0), (8, "", 0)]
    fives = [r for r in got if r[0] == 5]
    assert sorted((r for r in got if r[0] != 5), key=str) == sorted(want, key=str)
    assert sorted(n for _, _, n in fives) == [0, 1] and {t.split("\n")[-1] for _, t, _ in fives} == {"bar", "baz"}

    rows = [(3, text, k) for k in range(1000)] + [(None, "p q r s t u v w x y z", 1), (None, "p q r s t u v w x y z", 2), (None, "P q r s t u v w x y  z", 3)]
    rows += [(4, "other words in this one here", 0), (4, "still others than in that one", 0), (2, text.upper(), 9), (None, " ", 0), (None, None, 0), (None, None, 0)]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string, n int"))
    got = sorted(((r["doc_id"], (r["text"] or "").lower().split()) for r in kept.collect()), key=str)
    want = [(2, text.split()), (4, rows[-6][1].split()), (4, rows[-5][1].split()), (None, "p q r s t u v w x y z".split()), (None, []), (None, []), (None, [])]
    assert got == sorted(want, key=str) and kept.columns == ["doc_id", "text", "n"]


def test_shards(docs):
    rows = shard_documents(docs, shards=2).collect()
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, k) for s in (0, 1) for k in range(3)]
    assert shard_documents(docs.limit(0)).count() == 0


def test_best_fit():
    packer = BestFit(10, 2, 0)
    assert [packer.place(n) for n in (6, 7, 3, 4, 10)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0)]


def test_components(spark):
    draw = random.Random(4)
    name = lambda k: zlib.crc32(str(k).encode()).to_bytes(8, "big")
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(30)] + [(draw.randrange(200, 260), draw.randrange(200, 260)) for _ in range(45)] + [(7, 7), (3, 4)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, {a}).add(b)
            near.setdefault(b, {b}).add(a)
    reach = {a: a for a in near}
    for _ in near:
        reach = {a: min(reach[b] for b in near[a]) for a in near}
    want = sorted(sorted(name(a) for a in near if reach[a] == r) for r in set(reach.values()))
    frame = spark.createDataFrame([(name(a), name(b)) for a, b in edges], "a binary, b binary")
    got = {}
    for r in components(frame, Scratch(spark)).collect():
        got.setdefault(bytes(r["root"]), []).append(bytes(r["node"]))
    assert sorted(map(sorted, got.values())) == want and all(root in nodes for root, nodes in got.items())
    assert components(frame.limit(0), Scratch(spark)).count() == 0
