"""Every operator on nulls in any column, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest

from fairtag.llm import bpe, decontaminate, language, near_dup, sharding, substring_dedup, top_k, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
# Extra columns whose names clash with those that the operators work with.
SCHEMA = "doc_id long, text string, lang string, ids string, k1 string, words int, root int, score string"
LONG = " ".join(f"w{i}" for i in range(30_000))
TEXTS = [None, "", " \t\n", "one", "One", LONG, LONG, "same text here", "same text here", "é 🙂 ünï", "!!!", "a" * 20_000]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, "en", "x", None, 1, None, "y") for i, t in enumerate(TEXTS)]
    rows += [rows[7], (None, "no id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    return sorted(((r.doc_id, *(r[c] for c in columns)) for r in df.collect()), key=str)


def test_substring_dedup(documents, nothing):
    out = by_id(substring_dedup.remove_repeats(documents), "n_words", "n_removed")
    assert len(out) == len(TEXTS) + 3
    assert (0, 0, 0) in out and (2, 0, 0) in out and (5, 30_000, 30_000) in out and (6, 30_000, 30_000) in out
    assert out.count((7, 3, 0)) == 2 and (None, 2, 0) in out and (None, 0, 0) in out
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_near_dup(documents, nothing):
    out = by_id(near_dup.near_duplicates(documents), "n_shingles", "component_id", "kept")
    assert (0, 0, 0, True) in out and (3, 1, 3, True) in out and (4, 1, 3, False) in out
    assert (6, 29_999, 5, False) in out and (8, 2, 7, False) in out and out.count((7, 2, 7, True)) == 2
    assert (None, 1, None, True) in out and (None, 0, None, True) in out
    assert near_dup.near_duplicates(nothing).count() == 0
    kept = near_dup.representatives(documents)
    assert kept.columns == documents.columns
    assert by_id(kept) == sorted([(i,) for i in (0, 1, 2, 3, 5, 7, 9, 10, 11)] + [(None,), (None,)], key=str)
    assert near_dup.representatives(nothing).count() == 0


def test_bpe(documents, nothing):
    out = by_id(bpe.digests(documents, VOCABULARY), "n_tokens")
    assert (0, 0) in out and (1, 0) in out and (None, 0) in out and len(out) == len(TEXTS) + 3
    back = bpe.decode_ids(bpe.encode_texts(documents, VOCABULARY, ("doc_id", "lang")), VOCABULARY)
    assert by_id(back, "text") == sorted([*((i, t or "") for i, t in enumerate(TEXTS)), (7, TEXTS[7]), (None, "no id"), (None, "")], key=str)
    assert bpe.digests(nothing, VOCABULARY).count() == 0


def test_sharding(documents, nothing):
    out = by_id(sharding.shard(documents), "size", "text_crc32", "shard", "slot")
    assert (0, 1, 0) in [r[:3] for r in out] and len(out) == len(TEXTS) + 3
    assert len({r[3] for r in out if r[0] == 7}) == 1
    for s in {r[3] for r in out}:
        assert sorted(r[4] for r in out if r[3] == s) == list(range(sum(r[3] == s for r in out)))
    assert sharding.shard(nothing).count() == 0


def test_language(documents, nothing):
    network = language.fit(documents)
    out = by_id(language.predict(documents, network), "lang_pred", "score")
    assert (0, "und", 0.0) in out and (2, "und", 0.0) in out and (10, "und", 0.0) in out
    assert {r[1] for r in out} == {"und", "en"}
    assert language.fit(nothing) is None
    assert {r[1] for r in by_id(language.predict(documents, None), "lang_pred")} == {"und"}
    assert language.predict(nothing, network).count() == 0


def test_toxicity(spark, documents, nothing):
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (5, 0, 1), (None, 0, 1), (7, 1, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for table in (labels, labels.limit(0)):
        model = toxicity.fit(documents, table)
        out = by_id(toxicity.score(documents, model), "score", "predicted")
        assert len(out) == len(TEXTS) + 3 and all(0 <= r[1] <= 1 and r[2] == (r[1] >= 0.5) for r in out)
    assert toxicity.without_toxic(documents, model).columns == documents.columns
    assert toxicity.score(nothing, toxicity.fit(nothing, labels)).count() == 0


def test_decontamination(spark, documents, nothing):
    items = spark.createDataFrame([(1, None), (2, ""), (3, " ".join(f"w{i}" for i in range(500, 540))), (None, "never seen words")], "item_id long, text string")
    out = by_id(decontaminate.find_leaks(documents, items), "item_id")
    assert out == [(5, 3), (6, 3)]
    assert by_id(decontaminate.without_leaks(documents, items)) == sorted([(i,) for i in range(len(TEXTS)) if i not in (5, 6)] + [(7,), (None,), (None,)], key=str)
    assert decontaminate.find_leaks(nothing, items).count() == 0
    assert decontaminate.find_leaks(documents, items.limit(0)).count() == 0


def test_top_k(spark):
    vectors = [
        (0, [0.5, 0.1], "x"), (1, None, "x"), (2, [], "x"), (3, [None, 1.0], "x"), (4, [float("nan"), 1.0], "x"), (5, [float("inf"), 1.0], "x"),
        (6, [0.5, 0.1], None), (7, [0.5, 0.1], "x"), (8, [0.25], "x"), (None, [0.5, 0.1], "x"), (6, [0.5, 0.1], None),
    ]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, score string")
    out = [tuple(r) for r in top_k.top_k(table.where("vec_id = 0"), table).orderBy("rank").collect()]
    # floor(256 * 0.1) = 25: 128 * 128 + 25 * 25
    assert out == [(0, 1, 6, 17009), (0, 2, 6, 17009), (0, 3, 7, 17009), (0, 4, 8, 8192)]
    assert top_k.top_k(table.limit(0), table.limit(0)).count() == 0
    assert top_k.top_k(table.where("vec_id = 0"), table.where("vec_id = 0")).count() == 0
