"""Passage removal, Merkle manifests and periodic runs against plain versions, with nulls, ties, repeats and long texts."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.llm.merkle_manifest import append_log, folded, height_of, leaf_hash, merkle_manifest, path_hash, position
from lodestat.llm.periodic_runs import CommonExtension, find_runs, periodic_runs
from lodestat.llm.phrase_dedup import without_recurring
from lodestat.llm.queries import with_planted_periods


def split(text):
    return [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]


# --- passages


def plain_passages(rows, words):
    """Kept words of each (id, text); rows must be in the order of places."""
    seen, out = set(), []
    for _, text in rows:
        w = split(text)
        gone = set()
        for i in range(len(w) - words + 1):
            window = tuple(w[i : i + words])
            gone |= set(range(i, i + words)) if window in seen else set()
            seen.add(window)
        out.append(" ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def passage_rows(seed, n=60):
    draw = random.Random(seed)
    passages = [[f"w{draw.randrange(300)}" for _ in range(draw.randint(8, 60))] for _ in range(5)]
    rows = []
    for k in range(n):
        w = [f"w{draw.randrange(300)}" for _ in range(draw.randint(0, 40))]
        for _ in range(draw.randint(0, 3)):
            p = passages[draw.randrange(5)]
            low = draw.randrange(len(p))
            w[draw.randint(0, len(w)) :] += p[low:] + ["x", "y"][: draw.randint(0, 2)]
        if k % 9 == 0:
            w += ["a", "b", "a"][: draw.randint(1, 3)] * draw.randint(5, 30)
        rows.append((k, draw.choice([" ", "\n", "  \t"]).join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_passages(spark, seed):
    rows = passage_rows(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in without_recurring(docs, words=12, anchor=5).collect()}
    for (k, text), kept in zip(rows, plain_passages(rows, 12), strict=True):
        assert got[k]["kept"] == kept and got[k]["n_words"] == len(split(text))
        spans = [(s["start"], s["end"]) for s in got[k]["spans"]]
        assert " ".join(w for i, w in enumerate(split(text)) if not any(a <= i < b for a, b in spans)) == kept
        assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_passages_of_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(50))
    rows = [(3, long, 1), (3, long, 2), (None, long, 1), (None, long, 1), (None, None, 0), (4, "", 0), (5, "w " * 3000, 0), (6, "ü " * 25, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int").selectExpr("*", "1 as kept", "2 as shard")
    got = [(r["doc_id"], r["n_words"], r["kept"]) for r in without_recurring(docs).collect()]
    assert len(got) == len(rows)
    assert sorted(k for i, _, k in got if i == 3) == ["", ""]  # null ids come first
    assert sorted(k for i, n, k in got if i is None and n) == ["", long] and (None, 0, "") in got
    assert (4, 0, "") in got and (5, 3000, "w") in got and (6, 25, "ü") in got  # only the first window's first word is in no later one
    assert without_recurring(docs.limit(0)).collect() == []


# --- Merkle trees


def plain_tree(leaves):
    """Root and the path of each leaf."""
    paths, where = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        for k, at in enumerate(where):
            other = at ^ 1
            paths[k].append("" if other >= len(leaves) else "RL"[at & 1] + leaves[other])
        leaves = [hashlib.sha256("".join(leaves[i : i + 2]).encode()).hexdigest() for i in range(0, len(leaves), 2)]
        where = [at // 2 for at in where]
    return leaves[0], paths


def plain_leaf(row):
    parts = ("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def test_positions():
    for n in range(1, 80):
        for height in (height_of(n), 8):
            levels = [[str(i) for i in range(n)]]
            for _ in range(height):
                last = levels[-1]
                levels.append([hashlib.sha256("".join(last[i : i + 2]).encode()).hexdigest() for i in range(0, len(last), 2)])
            log = append_log(levels[0], height)
            assert len(log) == sum(map(len, levels))
            assert all(log[position(level, i, n)] == d for level, row in enumerate(levels) for i, d in enumerate(row))


@pytest.mark.parametrize(("bits", "rows"), [(2, 150), (10, 150), (1, 9), (10, 1), (10, 0)])
def test_manifest(spark, bits, rows):
    draw = random.Random(rows)
    table = [(draw.choice([None, *range(100)]), draw.choice(["s", None, ""]), draw.choice(["en", "en", "é", "z", None]), draw.choice([5, None]), draw.choice(["", None, "täxt", "x" * 70000])) for _ in range(rows)]
    table += table[:3]
    columns = "doc_id long, source string, lang string, n_chars long, text string"
    docs = spark.createDataFrame(table, columns).withColumn("leaf", F.lit(1)).withColumn("place", F.lit(2)).repartition(6)
    found = merkle_manifest(docs, also={"start": leaf_hash(F.lit("forged"))}, builder_bits=bits)
    found = found.withColumn("back", folded(F.col("leaf"), F.col("path"))).withColumn("bad", folded(F.col("start"), F.col("path"))).withColumn("proof", path_hash(F.col("path")))
    got = sorted((r["leaf"], r["subroot"], r["root"], tuple(r["path"])) for r in found.collect())
    assert all(r["back"] == r["root"] and r["bad"] != r["root"] for r in found.collect())
    want, subroots, leaves = [], [], {}
    for lang in sorted({r[2] for r in table}, key=lambda x: (x is not None, (x or "").encode())):
        mine = sorted((-1 if r[0] is None else r[0], plain_leaf(r)) for r in table if r[2] == lang)
        root, paths = plain_tree([d for _, d in mine])
        subroots.append(root)
        leaves[lang] = (root, [(d, p) for (_, d), p in zip(mine, paths, strict=True)])
    if table:
        top, above = plain_tree(subroots)
        for (root, members), high in zip(leaves.values(), above, strict=True):
            want += [(d, root, top, tuple(p + high)) for d, p in members]
    assert got == sorted(want)
    for r in found.limit(5).collect():
        assert r["proof"] == hashlib.sha256("".join(s[1:] for s in r["path"]).encode()).hexdigest()


# --- periodic runs


def plain_runs(w, length=24, periods=3):
    found = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i < len(w) - q:
            low = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            if i - low + q >= max(length, periods * q) and i > low:
                found.setdefault((low, i - low + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in found.items())


def periodic_words(draw):
    k = draw.choice([1, 2, 3, 7])
    w = [draw.choice("abcdefg"[:k]) for _ in range(draw.choice([0, 1, 5, 30, 90]))]
    for _ in range(draw.randint(0, 3)):
        p = [draw.choice("abcdefg"[:k]) for _ in range(draw.randint(1, 12))]
        w += (p * 20)[: draw.randint(1, 8) * len(p) + draw.randint(0, 3)]
    return w


def test_common_extension():
    draw = random.Random(4)
    for _ in range(60):
        s = np.array([draw.randint(1, 2) for _ in range(draw.randint(1, 300))] * draw.randint(1, 3) + [3])
        common = CommonExtension(s)
        x, y = (np.array([draw.randrange(len(s)) for _ in range(50)]) for _ in range(2))
        x, y = x[x != y], y[x != y]
        want = [next(k for k in range(len(s)) if i + k >= len(s) or j + k >= len(s) or s[i + k] != s[j + k]) for i, j in zip(x, y, strict=True)]
        assert common(x, y).tolist() == want


@pytest.mark.parametrize("length", [1, 6, 24])
def test_find_runs(length):
    draw = random.Random(length)
    for _ in range(150):
        w = periodic_words(draw)
        s = np.array([ord(x) for x in w] + [200])
        assert list(zip(*(x.tolist() for x in find_runs(s, len(w), length)), strict=True)) == plain_runs(w, length)


def test_periodic_runs(spark):
    draw = random.Random(9)
    rows = [(k if k % 5 else None, draw.choice([" ", "\n\t", "  "]).join(periodic_words(draw))) for k in range(150)]
    rows += [(7, None), (7, ""), (7, "  "), (8, "long " * 40000), (8, "ß a " * 9), (8, "ß a " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).repartition(4)
    got = sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs(docs).collect())
    want = []
    for k, text in rows:
        w = split(text)
        runs = [(0, 40000, 1)] if len(w) == 40000 else plain_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((str(k), len(w), runs, " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert got == sorted(want)
    assert periodic_runs(docs.limit(0)).collect() == []
    texts = spark.createDataFrame([("a", "b " * 30)], "key string, body string")
    assert [tuple(x) for x in periodic_runs(texts, id_column="key", text_column="body").first()["runs"]] == [(0, 30, 1)]


def test_planted_periods(spark):
    import zlib

    rows = [(k, " ".join(f"w{i}" for i in range(k % 50))) for k in range(120)] + [(None, "a b"), (500, None)]
    got = {r["doc_id"]: r["text"] for r in with_planted_periods(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        h, w = zlib.crc32(str(k).encode()), split(text)
        n, g = len(w), h // 10
        if k is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        assert split(got[k]) == w
