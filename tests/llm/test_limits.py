"""Long labels, very many lines, small integer ids and columns whose names clash."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.llm.decontamination import contaminated
from lodestat.llm.embedding_dedup import near_vectors
from lodestat.llm.line_dedup import Lines, without_repeated_lines


def test_vectors_of_long_labels(spark):
    v = [0.5, 0.25, -1.0]
    rows = [(1, "x" * 80 + "A", v), (2, "x" * 80 + "B", v), (3, "x" * 80 + "A", v), (4, "", v)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (0, 2), 3: (1, 1), 4: (0, 4)}


def test_line_numbers_beyond_the_packed_ones(spark):
    many = 1 << 22
    line = "one two three four five six"
    rows = [(1, line), (2, "\n" * many + line)]
    got = {r["doc_id"]: r for r in without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"] == line and got[1]["n_removed"] == 0
    assert got[2]["n_removed"] == 1 and got[2]["text"] == "\n" * (many - 1)


def test_lines_are_the_same_sets_either_way(monkeypatch):
    from lodestat.llm import line_dedup

    texts = [b"b a b\n\nc c\na b", b"", b"x\ny x"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    packed = Lines(data, offsets)
    monkeypatch.setattr(line_dedup, "_LINE_BITS", 1)
    apart = Lines(data, offsets)
    assert packed.number.tolist() == apart.number.tolist() == [0, 2, 3, 0, 1] and packed.size.tolist() == apart.size.tolist() == [2, 1, 2, 1, 2]


def test_a_column_of_the_name_of_the_count(spark):
    rows = [(1, "a b c d e\nf", 7), (2, "a b c d e\ng", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed int")
    assert sorted(without_repeated_lines(docs).select("doc_id", "n_removed").collect()) == [(1, 0), (2, 1)]
    kept = without_repeated_lines(docs, counted="_cut")
    assert sorted(kept.select("doc_id", "n_removed", "_cut").collect(), key=str) == [(1, 7, 0), (2, None, 1)]


@pytest.mark.parametrize("kind", ["smallint", "tinyint", "int", "long", "string", "decimal(10,0)"])
def test_item_ids_of_any_type(spark, kind):
    item = " ".join(f"w{i}" for i in range(30))
    benchmark = spark.createDataFrame([(5, item)], "item_id int, text string").withColumn("item_id", F.col("item_id").cast(kind))
    docs = spark.createDataFrame([(9, f"u v {item} z")], "doc_id int, text string")
    found = contaminated(docs, benchmark)
    assert found.schema["item_id"].dataType == benchmark.schema["item_id"].dataType
    assert [(r["doc_id"], int(r["item_id"])) for r in found.collect()] == [(9, 5)]


def test_labels_are_joined_alike_at_any_size(spark):
    """A join that turns from a broadcast to a shuffle as labels grow makes small runs say nothing of large ones."""
    from lodestat.llm.toxicity import labelled

    texts = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (1, "d")], "id long, text string")
    known = spark.createDataFrame([(1, 0), (1, 1), (None, 1)], "id long, label int")
    rows = labelled(texts, known)
    assert sorted((r["text"], r["label"]) for r in rows.collect()) == [("a", 0), ("a", 1), ("d", 0), ("d", 1)]
    assert "SortMergeJoin" in rows._jdf.queryExecution().toString()


def test_frequent_words_stay_when_the_cache_is_full(monkeypatch):
    from lodestat.llm import packing, queries

    monkeypatch.setattr(packing, "CACHED_WORDS", 50)
    path = queries.word_tokenizer()
    tokenizer, cache, older = packing._tokenizer(path)
    cache.clear(), older.clear()
    encoded = []

    class Counting:
        def encode(self, text, **options):
            encoded.extend(text.split())
            return tokenizer.encode(text, **options)

    monkeypatch.setattr(packing, "_tokenizer", lambda _: (Counting(), cache, older))
    texts = [" ".join(["often", *[f"w{i * 10 + k}" for k in range(10)]]) for i in range(40)]
    for text, ids in zip(texts, packing.token_ids(texts, path, 0), strict=True):
        assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        assert len(cache) + len(older) <= 100
    assert encoded.count("often") == 1
    cache.clear(), older.clear()


def test_only_words_that_need_it_are_normalised_and_split(monkeypatch):
    from lodestat.llm import packing, queries

    path = queries.word_tokenizer()
    whole = packing._tokenizer(path)[0]
    given = []

    class Counting:
        def __getattr__(self, name):
            return getattr(whole, name)

        def encode(self, text, **how):
            given.extend(text.split())
            return whole.encode(text, **how)

    monkeypatch.setattr(packing, "_tokenizer", lambda _: (Counting(), {}, {}))
    plain = "The the, THE. a1b22c x***y ++-- 007 (and) \"or\" <odd> unlikelyword7 ." + "".join(map(chr, range(33, 127)))
    text = plain + " don't it's we'LL a<|endoftext|>b x\x00y \x7f caf\u00e9 Stra\u00dfe \u03a3\u0391\u03a3 e\u0301 \u6f22\u5b57 a\u200bb"
    for one in (text, plain, "", " \n"):
        (ids,) = packing.token_ids([one], path, 0)
        assert ids.tolist() == [*whole.encode(one, add_special_tokens=False).ids, 0]
    assert "don't" in given and "caf\u00e9" in given and not {"The", "the,", "THE.", "a1b22c", "x***y", "unlikelyword7"} & set(given)


def test_prefixes_sort_only_lines_that_can_resemble_another(monkeypatch):
    """Prefix words against the definition; neither they nor the filter make the whole keys of all lines."""
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from lodestat.llm import line_dedup, text

    texts = pa.array(["a b c d e f g\nb b\n\none two three four five six", "", None, "g f e d c b a\nx", "a b c d e\n" * 3])
    counts = np.arange(line_dedup.COUNTERS, dtype=np.uint32).astype(np.uint8)
    want = []
    for _, _, data, offsets in text.slices(texts):
        lines = line_dedup.Lines(data, offsets)
        for k, key in enumerate(lines.keys()):
            words = lines.words[lines.starts[k] : lines.ends[k]].tolist()
            n = len(words)
            ranked = sorted(words, key=lambda w: (int(counts[w & (line_dedup.COUNTERS - 1)]), w))
            for place, w in enumerate(ranked[: int(line_dedup.prefix_length(np.array([n]), 0.8)[0])]):
                if n >= 4 and counts[w & (line_dedup.COUNTERS - 1)] > 1:
                    bits = [0] * line_dedup._BITMAP
                    for x in words:
                        slot = x >> 30 & (64 * line_dedup._BITMAP - 1)
                        bits[slot >> 6] |= 1 << (slot & 63)
                    want.append(tuple(np.array([w, key[0], *bits, place << 32 | n], np.uint64).view(np.int64).tolist()))
    assert want

    monkeypatch.setattr(line_dedup.Lines, "keys", lambda self: 1 / 0)
    rows = lambda: [pa.RecordBatch.from_arrays([texts], ["text"])]
    held = lambda value: SimpleNamespace(value=value)
    for bits in (line_dedup._PLACE_BITS, 1):  # 1: no room for the place beside the sort key
        monkeypatch.setattr(line_dedup, "_PLACE_BITS", bits)
        got = []
        for batch in line_dedup._prefixes(held(counts), 0.8, 3)(iter(rows())):
            got += zip(*(c.flatten().to_pylist() for c in batch.columns[1:]), strict=True)
        assert sorted(got) == sorted(want)
    nothing = np.zeros(1 << (line_dedup._FILTER_BITS - 3), np.uint8)
    assert sum(b.num_rows for b in line_dedup._words_of(held(nothing))(iter(rows()))) == 0
    assert sum(b.num_rows for b in line_dedup._prefixes(held(counts), 0.8, 3)(iter([pa.RecordBatch.from_arrays([pa.array(["a b", ""])], ["text"])]))) == 0
