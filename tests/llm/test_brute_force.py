"""Text operators against plain versions of what they compute, on small tables."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestat.llm import text as T
from lodestat.llm.decontamination import GAP, MATCH, MISMATCH, align, contaminated, without_contaminated
from lodestat.llm.embedding_dedup import near_vectors
from lodestat.llm.line_dedup import without_repeated_lines
from lodestat.llm.lm_scoring import stupid_backoff_scores
from lodestat.llm.packing import pack_documents, token_ids
from lodestat.llm.queries import word_tokenizer


def draw_words(draw, n, vocabulary=400):
    return [f"w{draw.randrange(vocabulary)}" for _ in range(n)]


def smith_waterman(a, b):
    above, best = [0] * (len(b) + 1), 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (MATCH if x == y else MISMATCH), above[j + 1] + GAP, row[j] + GAP))
        best, above = max(best, max(row)), row
    return best


def test_alignment():
    draw = random.Random(3)
    pairs = [([draw.randrange(4) for _ in range(draw.randint(1, 15))], [draw.randrange(4) for _ in range(draw.randint(1, 25))]) for _ in range(300)]
    got = align([np.array(a, np.uint64) for a, _ in pairs], [np.array(b, np.uint64) for _, b in pairs])
    assert got.tolist() == [smith_waterman(a, b) for a, b in pairs]


@pytest.fixture(scope="module")
def leaks(spark):
    """Items, and documents of which some hold one: whole, with words changed, left out or put in."""
    draw = random.Random(12)
    items = [draw_words(draw, draw.randint(12, 40)) for _ in range(12)]
    rows = []
    for k in range(80):
        words = draw_words(draw, draw.randint(20, 120))
        if k % 4 == 0:
            item = list(items[draw.randrange(len(items))])
            for _ in range(len(item) // 8 if k % 8 else 0):
                at = draw.randrange(len(item))
                item[at : at + draw.randint(0, 1)] = draw_words(draw, draw.randint(0, 1))
            words[10:10] = item
        rows.append((k, " ".join(words), k))
    rows += [(100, None, 0), (101, "", 0), (None, " ".join(items[0]).upper(), 0), (102, " ".join(items[1]), 0), (102, " ".join(items[1]), 0)]
    benchmark = [(i, " ".join(w), "x") for i, w in enumerate(items)] + [(90, None, "x"), (91, "", "x"), (92, "w1 w2", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score int"), spark.createDataFrame(benchmark, "item_id long, text string, doc_id string")


def test_decontamination(leaks):
    docs, benchmark = leaks
    want = Counter()
    for d in docs.collect():
        for i in benchmark.collect():
            words = (i["text"] or "").split()
            share = smith_waterman(words, (d["text"] or "").lower().split()) / max(1, MATCH * len(words))
            if len(words) >= 3 and share >= 0.5:
                want[d["doc_id"], i["item_id"], round(share, 9)] += 1
    got = Counter((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in contaminated(docs, benchmark).collect())
    assert got == want and len(want) >= 22
    clean = without_contaminated(docs, benchmark)
    hit = {k[0] for k in want}
    assert clean.schema == docs.schema
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] not in hit)


def contaminations(docs, benchmark):
    """(doc_id, item_id, score) of all pairs whose whole texts align with a share of 0.5 or more."""
    want = Counter()
    for d, text in docs:
        for i, words in enumerate(benchmark):
            share = smith_waterman(words, text) / (MATCH * len(words))
            if share >= 0.5:
                want[d, i, round(share, 9)] += 1
    return want


def test_decontamination_of_heavy_edits(spark):
    draw = random.Random(21)
    items = [draw_words(draw, n, 4000) for n in (3, 4, 9, 17, 24, 33, 41, 50, 58, 58)]
    docs = []
    for k in range(120):
        item = list(items[k % 10])
        if k % 3 == 0:  # every second, third or fourth word
            item = [draw.choice(["other", "word"]) if j % (2 + k // 3 % 3) == 1 else w for j, w in enumerate(item)]
        elif k % 3 == 1:
            item = [w if draw.random() > draw.choice([0.2, 0.27, 0.35]) else f"z{draw.randrange(99)}" for w in item]
        else:  # words left out, and put in
            item = [x for w in item for x in ([] if draw.random() < 0.15 else [w, "new"] if draw.random() < 0.4 else [w])]
        docs.append((k, [*draw_words(draw, draw.randint(0, 60), 4000), *item, *draw_words(draw, draw.randint(0, 60), 4000)]))
    # one exact copy beside many of one edit, of which few words are left in a row
    edit = ["other" if j % 3 == 2 else w for j, w in enumerate(items[8])]
    docs += [(500, items[8]), *((1000 + k, edit) for k in range(3000))]
    want = contaminations(docs[:121], items)
    again = contaminations([(1000, edit)], items)
    assert len(again) == 1 and len(want) > 60
    want.update({(1000 + k, i, share): 1 for k in range(3000) for _, i, share in again})
    rows = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in contaminated(rows, benchmark).collect())
    assert got == want
    assert without_contaminated(rows, benchmark).count() == len(docs) - len({d for d, _, _ in want})


def test_decontamination_of_long_insertions(spark):
    draw = random.Random(31)
    items = [draw_words(draw, n, 4000) for n in (18, 30, 42, 57)]
    docs = []
    for k in range(40):
        item, third = items[k % 4], len(items[k % 4]) // 3
        gaps = [[f"z{draw.randrange(999)}" for _ in range(int(len(item) * draw.choice([0.3, 0.4, 0.45])))] for _ in range(2)]
        docs.append((k, [*draw_words(draw, 30, 4000), *item[:third], *gaps[0], *item[third : 2 * third], *gaps[1], *item[2 * third :], *draw_words(draw, 30, 4000)]))
    want = contaminations(docs, items)
    rows = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in contaminated(rows, benchmark).collect())
    assert got == want and len(want) >= 40


def test_decontamination_of_nothing(leaks):
    docs, benchmark = leaks
    assert contaminated(docs.limit(0), benchmark).count() == 0
    assert contaminated(docs, benchmark.limit(0)).count() == 0
    assert without_contaminated(docs, benchmark.where("item_id >= 90")).count() == docs.count()


def test_lines(spark):
    draw = random.Random(6)
    base = [draw_words(draw, draw.randint(1, 14), 60) for _ in range(40)]
    rows = []
    for k in range(40):
        lines = []
        for _ in range(draw.randint(0, 6)):
            words = list(draw.choice(base))
            if draw.random() < 0.5:
                words[draw.randrange(len(words))] = draw.choice(["w1", "zz", "WW"])
            lines.append(draw.choice(["", "  "]) if draw.random() < 0.1 else " ".join(words))
        rows.append((k, "\n".join(lines), 7, "x"))
    rows += [(50, None, 7, "x"), (51, "", None, None), (-1, rows[3][1], 7, "x")]
    kept, want = [], {}
    for key, text, *_ in sorted(rows):
        left = []
        for line in (text or "").split("\n"):
            words = set(line.lower().split())
            if not any(words and len(words & w) >= 0.8 * len(words | w) - 1e-9 for w in kept):
                left.append(line)
            kept.append(words)  # an earlier line counts even if it went itself
        want[key] = None if text is None else "\n".join(left)
    docs = spark.createDataFrame(rows, "doc_id long, text string, line int, key string")
    got = {r["doc_id"]: r["text"] for r in without_repeated_lines(docs).collect()}
    assert got == want
    assert without_repeated_lines(docs.limit(0)).count() == 0


def test_backoff(spark):
    draw = random.Random(2)
    rows = [(k, " ".join(draw_words(draw, draw.randint(0, 30), 25)), k) for k in range(30)] + [(40, None, 1), (None, "", 1), (41, "w1 w2 w3", 1), (41, "w1 w2 w3", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, batch int")
    texts = [(t or "").split() for _, t, _ in rows]
    for order in (2, 3):
        want = []
        counts = [Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for w in texts for k in range(1, order + 1)]
        total = sum(counts, Counter())
        for d, words in enumerate(texts):
            own = sum(counts[d * order : (d + 1) * order], Counter())
            others = lambda g, own=own, d=d: total[g] - own[g] if g else sum(map(len, texts)) - len(texts[d])
            score, n_backoff = 0.0, 0
            for i in range(len(words)):
                longest = min(order, i + 1)
                seen = next((k for k in range(longest, 0, -1) if others(tuple(words[i - k + 1 : i + 1])) > 0), 0)
                gram = tuple(words[i - max(seen, 1) + 1 : i + 1])
                score += math.log10((others(gram) if seen else 1) / others(gram[:-1])) + math.log10(0.4) * (longest - max(seen, 1))
                n_backoff += longest > max(seen, 1)
            want.append((rows[d][0], len(words), n_backoff, round(score, 6) + 0.0))
        got = [(r["doc_id"], r["n_tokens"], r["n_backoff"], round(r["log_score"], 6) + 0.0) for r in stupid_backoff_scores(docs, order).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert stupid_backoff_scores(docs.limit(0)).count() == 0


def test_vectors(spark):
    draw = np.random.default_rng(5)
    rows = []
    for k in range(60):
        base = draw.standard_normal(32)
        for copy in range(1 + k % 4):
            rows.append((len(rows), (base + 0.08 * copy * draw.standard_normal(32)).tolist() if copy else base.tolist(), k % 3))
    rows += [(900, rows[0][1], 0), (901, rows[0][1], None), (902, None, 0), (903, [0.0] * 32, 0), (904, [math.nan] * 32, 0), (905, [None] * 32, 0), (906, [], 0), (None, rows[1][1], rows[1][2]), (907, [1.0, 2.0], 0), (908, [1.0, 2.0], 0)]
    valid = [len(v or []) > 0 and label is not None and None not in v and bool(np.isfinite(v).all()) and any(v) for _, v, label in rows]
    near = {k: {k} for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            if valid[a] and valid[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    near[a].add(b)
                    near[b].add(a)
    root = list(range(len(rows)))
    for _ in rows:
        root = [min(root[b] for b in near[a]) for a in range(len(rows))]
    ids = [r[0] for r in rows]
    least = [min((ids[b] for b in range(len(rows)) if root[b] == root[a] and ids[b] is not None), default=None) for a in range(len(rows))]
    want = [(ids[a], len(near[a]) - 1, least[a], ids[a] == least[a]) for a in range(len(rows))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, key string")
    got = [tuple(r) for r in near_vectors(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(n for _, n, _, _ in want) > 40
    assert near_vectors(docs.limit(0)).count() == 0


@pytest.mark.parametrize("common", [0.8, 0.9, 0.97])
def test_vectors_with_a_common_direction(spark, common):
    draw = np.random.default_rng(8)
    base = draw.standard_normal((1500, 64))
    base *= math.sqrt(1 - common) / np.linalg.norm(base, axis=1, keepdims=True)
    base[:, 0] += math.sqrt(common)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = draw.standard_normal((500, 64))
    away -= (away * base[:500]).sum(axis=1, keepdims=True) * base[:500]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    x = np.concatenate([base, 0.9802 * base[:500] + math.sqrt(1 - 0.9802**2) * away])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.98).sum(axis=1) - 1
    rows = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = np.zeros(len(x), int)
    for r in near_vectors(rows).collect():
        got[r["vec_id"]] = r["n_links"]
    assert (got <= want).all() and want.sum() >= 1000
    assert got.sum() >= 0.9 * want.sum()


def test_tokens_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    path = word_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    texts = ["", " ", "plain words here", "Tab\tand\nline", "naïve Straße 東京 é é", "odd\x1cbreak\x85here", "dots...and,commas!!", "x" * 3000, " no break　space​", "🙂 emoji🙂🙂", "<s> [UNK] </s>", "İstanbul ﬁ Ⅷ", "a\x00b \x07"]
    for text, ids in zip(texts, token_ids(texts, path, 0), strict=True):
        assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0], text


def test_packing(spark):
    from tokenizers import Tokenizer

    draw = random.Random(9)
    texts = [" ".join(draw_words(draw, draw.choice([1, 5, 30, 400]))) for _ in range(60)] + [None, "", "same", "same", "long " * 9000]
    docs = spark.createDataFrame([(k if k != 3 else None, t, 5) for k, t in enumerate(texts)], "doc_id long, text string, piece int")
    rows = pack_documents(docs, word_tokenizer()).collect()
    tokenizer = Tokenizer.from_file(word_tokenizer())
    want = []
    for k, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for p, at in enumerate(range(0, len(ids), 2048)):
            cut = ids[at : at + 2048]
            want.append((k if k != 3 else None, p, at, len(cut), zlib.crc32(cut.tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    # while no sequence closes early, two that are half empty would have been one
    assert sum(sum(n for _, n in parts) <= 1024 for parts in held.values()) <= 1
    assert pack_documents(docs.limit(0), word_tokenizer()).count() == 0


def test_slices_hold_every_byte():
    texts = ["ab", None, "", "ü" * 10, "c" * 50]
    parts = [data[a:b].tobytes().decode() for _, _, data, offsets in T.slices(pa.array(texts), limit=8) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert parts == [t or "" for t in texts]
