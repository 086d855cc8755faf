"""Held-out accuracy and defined results of the trained text operators."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestat.llm import text as T
from lodestat.llm.language import fit_language_model, identify_language, keep_identified
from lodestat.llm.toxicity import features, fit_toxicity_model, score_toxicity

SYLLABLES = {"north": ["kra", "tol", "gir", "bek", "dun"], "south": ["ami", "olu", "esa", "ino", "uva"], "west": ["shé", "wyß", "thö", "nñu", "phä"]}


def invented(draw, language, words=30):
    return " ".join("".join(draw.choices(SYLLABLES[language], k=draw.randint(1, 3))) for _ in range(words))


def as_bytes(texts):
    _, _, data, offsets = next(T.slices(T.lower(pa.array(texts, pa.string()))))
    return data, offsets


@pytest.fixture(scope="module")
def spoken(spark):
    draw = random.Random(4)
    rows = [(k, invented(draw, name), name) for k, name in enumerate(sorted(SYLLABLES) * 40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_of_held_out_texts(spoken):
    model = fit_language_model(spoken.where("doc_id % 10 < 7"), clusters=2)
    found = identify_language(spoken.where("doc_id % 10 >= 7"), model)
    right = {r["doc_id"]: r["lang"] for r in spoken.collect()}
    answers = found.collect()
    assert len(answers) == 36 and all(r["lang_pred"] == right[r["doc_id"]] and 0 < r["score"] <= 1 and not r["rejected"] for r in answers)


def test_unknown_language_is_rejected(spoken):
    model = fit_language_model(spoken.where("lang != 'west'"))
    assert all(r["rejected"] for r in identify_language(spoken.where("lang = 'west'"), model).collect())


WORDS = {
    "de": "der die das und ist nicht ein eine mit auf für von dem den sich auch werden haben über nach kann wird wenn nur noch zwischen Straße Häuser gehen".split(),
    "en": "the and of to in is that it was for on are with as his they be at one have this from or had by but some what there we can out other were".split(),
    "fr": "le la les de des et un une est dans que pour qui sur avec pas plus par être cette mais comme ou nous vous leur après où même très".split(),
    "nl": "de het een en van ik te dat die in is niet zijn op aan met als voor er maar om dan zou wat mijn geen ook naar heb hoe heeft uit".split(),
}


@pytest.mark.parametrize("unknown", WORDS)
def test_left_out_real_language_is_rejected(spark, unknown):
    draw = random.Random(6)
    rows = [(k, " ".join(draw.choices(WORDS[name], k=draw.randint(30, 80))), name) for k, name in enumerate(sorted(WORDS) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_language_model(docs.where((F.col("lang") != unknown) & (F.col("doc_id") % 40 < 28)))
    found = {r["doc_id"]: r for r in identify_language(docs, model).collect()}
    strange = [found[k]["rejected"] for k, _, name in rows if name == unknown]
    known = [(found[k]["rejected"], found[k]["lang_pred"] == name) for k, _, name in rows if name != unknown and k % 40 >= 28]
    assert np.mean(strange) >= 0.95 and not any(r for r, _ in known) and all(right for _, right in known)


def test_nearest_centroid_and_bounds_by_hand(spoken):
    """Cosine with every centroid, the nearest one's language, and its bound by length."""
    from lodestat.llm import language as L

    model = fit_language_model(spoken, clusters=2)
    assert np.linalg.norm(model.centroids, axis=1) == pytest.approx(1, abs=1e-5)
    rows = spoken.where("doc_id < 15").collect()
    found = {r["doc_id"]: r for r in identify_language(spoken.where("doc_id < 15"), model).collect()}
    for r in rows:
        counts = L.term_counts(*as_bytes([r["text"]]))[0]
        v = np.log1p(counts) * model.idf
        cosines = [float(v @ c / np.sqrt(v @ v)) for c in model.centroids]
        assert found[r["doc_id"]]["score"] == pytest.approx(max(cosines), abs=1e-5)
        assert found[r["doc_id"]]["lang_pred"] == model.languages[int(np.argmax(cosines))] == r["lang"]
        assert max(cosines) >= model.least[r["lang"]][int(np.log2(np.count_nonzero(counts)))] - 1e-5


def test_language_edges(spark, spoken):
    model = fit_language_model(spoken.union(spark.createDataFrame([(900, "kra", None), (901, None, "north"), (902, "12", "north")], spoken.schema)))
    assert model.languages == sorted(model.languages) and set(model.languages) == set(SYLLABLES)
    odd = [(1, None, 0.5), (2, "", 0.5), (3, "12 ?!", None), (4, "字 文 " * 50, 0.5), (None, "kratol girbek " * 20000, 0.5), (5, "amiolu " * 30, 0.5), (5, "amiolu " * 30, 0.5)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, score double")
    rows = identify_language(docs, model).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == 7
    assert all(by_id[k]["lang_pred"] == "und" and by_id[k]["score"] == 0 and by_id[k]["rejected"] for k in (1, 2, 3))
    assert by_id[4]["rejected"] and by_id[None]["lang_pred"] == "north" and by_id[5]["lang_pred"] == "south", by_id
    kept = keep_identified(docs, model)
    assert kept.schema == docs.schema and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 5, 5]
    assert identify_language(docs.limit(0), model).count() == 0


def test_language_without_training(spark, spoken):
    model = fit_language_model(spoken.limit(0))
    assert all(r["lang_pred"] == "und" and r["rejected"] for r in identify_language(spoken, model).collect())
    assert keep_identified(spoken, model).count() == 0


def test_features_ignore_what_is_no_letter():
    def present(text):
        return set(features(*as_bytes([text]))[1].tolist())

    assert present("Ab,  cd!") == present("ab cd") and present("") == set() and present("a") == set()
    padded = " abc1 def "  # both ends count as a space
    assert len(features(*as_bytes(["abc1 def"]))[1]) == sum(len(padded) - n + 1 for n in (4, 5))
    together = features(*as_bytes(["abcd efg", "", "xyz w"]))
    for row, alone in ((0, "abcd efg"), (2, "xyz w")):
        assert set(together[1][together[0] == row].tolist()) == present(alone)


@pytest.fixture(scope="module")
def judged(spark):
    draw = random.Random(8)
    plain = [invented(draw, "north", 1) for _ in range(200)]
    vile = ["skornik", "vulgrot", "bazzfel"]
    rows, labels = [], []
    for k in range(600):
        toxic = draw.random() < 0.3
        words = draw.choices(plain, k=40)
        if toxic:
            words[3], words[20] = draw.choice(vile), draw.choice(vile)
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_of_held_out_texts(judged):
    docs, labels = judged
    model = fit_toxicity_model(docs.where("doc_id % 3 != 0"), labels.where("doc_id % 3 != 0"))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    scores = score_toxicity(docs.where("doc_id % 3 = 0"), model).collect()
    assert np.mean([(r["score"] >= 0.7) == truth[r["doc_id"]] for r in scores]) >= 0.97


def test_toxicity_sums_the_weights_of_present_features(judged):
    docs, labels = judged
    model = fit_toxicity_model(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in score_toxicity(docs.where("doc_id < 20"), model).collect()}
    for r in docs.where("doc_id < 20").collect():
        z = model.bias + sum(float(model.weights[f]) for f in set(features(*as_bytes([r["text"]]))[1].tolist()))
        assert scores[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_toxicity_threshold_does_not_move_with_the_sample(judged):
    docs, labels = judged
    few, all_ = (fit_toxicity_model(docs, labels, per_class=n) for n in (60, 3000))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    for model in (few, all_):
        scores = score_toxicity(docs, model).collect()
        caught = np.mean([r["score"] >= 0.7 for r in scores if truth[r["doc_id"]]])
        flagged = np.mean([r["score"] >= 0.7 for r in scores if not truth[r["doc_id"]]])
        assert caught >= 0.97 and flagged <= 0.03
    assert fit_toxicity_model(docs, labels, prior=0.1).bias == pytest.approx(all_.bias + np.log(0.1 / 0.9))


def test_toxicity_weights_against_a_plain_fit(spark):
    """Log-count ratios by counting, and the logistic optimum by plain gradient steps."""
    texts = ["bad rat", "bad cat", "bad dog", "good rat", "good cat", "good dog", "fine cow", "fine hen"] * 4
    marks = [1, 1, 1, 0, 0, 0, 0, 0] * 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int")
    model = fit_toxicity_model(docs, labels, rounds=3000, decay=0.01)
    y = np.array(marks, float)
    found = [sorted(set(features(*as_bytes([t]))[1].tolist())) for t in texts]
    x = np.zeros((len(texts), 1 << 18), np.float32)
    for row, fs in zip(x, found):
        row[fs] = 1
    counts = np.stack([x[y == 0].sum(axis=0), x[y == 1].sum(axis=0)])
    p, q = (counts[1] + 0.5) / ((y == 1).sum() + 1), (counts[0] + 0.5) / ((y == 0).sum() + 1)
    used = np.flatnonzero(model.weights)
    error = np.sqrt(1 / (counts[1] + 0.5) + 1 / (counts[0] + 0.5))
    strong = np.flatnonzero((counts.sum(axis=0) >= 3) & (np.abs(np.log(p / q)) / error > 2))
    assert set(used) == set(strong) and len(used)
    scaled = x[:, used].astype(float) * np.log(p / q)[used]
    w, b = np.zeros(len(used)), 0.0
    for _ in range(60000):
        g = (1 / (1 + np.exp(-(scaled @ w + b))) - y) / len(y)
        w, b = w - 0.05 * (scaled.T @ g + 0.01 * w), b - 0.05 * g.sum()
    assert model.weights[used] == pytest.approx(w * np.log(p / q)[used], abs=2e-3)
    assert model.bias == pytest.approx(b - np.log(y.sum() / (len(y) - y.sum())), abs=1e-2)


def test_toxicity_edges(spark, judged):
    docs, labels = judged
    more = labels.union(spark.createDataFrame([(1, None), (None, 1), (5000, 1)], labels.schema))
    model = fit_toxicity_model(docs, more)
    odd = spark.createDataFrame([(1, None, 2.0, 1), (2, "", 2.0, 1), (None, "skornik " * 50000, 2.0, 0), (2, "", 2.0, 1)], "doc_id long, text string, score double, label int")
    rows = score_toxicity(odd, model).collect()
    empty = {r["score"] for r in rows if r["doc_id"]}
    assert len(rows) == 4 and len(empty) == 1 and 0 < empty.pop() < 0.7
    assert [r["score"] > 0.7 for r in rows if r["doc_id"] is None] == [True]
    assert score_toxicity(odd.limit(0), model).count() == 0


def test_toxicity_with_one_class_or_none(judged):
    docs, labels = judged
    one = fit_toxicity_model(docs, labels.where("toxic = 0"))
    none = fit_toxicity_model(docs, labels.limit(0))
    assert {r["score"] for r in score_toxicity(docs, none).collect()} == {0.5}
    assert all(r["score"] < 0.05 for r in score_toxicity(docs, one).collect())
