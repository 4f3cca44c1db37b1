"""The operators against brute force, other libraries, planted cases and held-out labels."""

import random
import re
from pathlib import Path

import numpy as np
import pytest

from checks.compare_engines import duck
from fairtag.llm import bpe, decontaminate, near_dup, sharding
from fairtag.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not here")


@here
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duck(SF)
    have, want = QUERIES[name](spark, SF), con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(have.columns)
    assert sorted(map(tuple, have.select(columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(300)]
    texts = []
    for _ in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 120))]
        for _ in range(25):  # copies with few to many changed words, so that some pairs lie on either side of the threshold
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 8)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    sets = [set(zip(t.split(), t.split()[1:])) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in near_dup.near_duplicates(table).collect()}
    assert out == {i: find(i) for i in range(len(texts))}


def test_tokens_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    library, own = tokenizers.Tokenizer.from_file(path), bpe.load(path)
    rng = random.Random(1)
    pools = [
        "abcdefghijklmnopqrstuvwxyz '", "aab  \n\t", "".join(map(chr, range(33))), "\x85\xa0   　᠎​ x1é",
        "日本語かな漢字éàß1٣²½ ", "'s're don't 12 34 ...!!", "🙂👍🏽 é ", "".join(map(chr, range(32, 600))),
    ]
    for i in range(1500):
        text = "".join(rng.choice(rng.choice(pools) if i % 2 else pools[i // 2 % 8]) for _ in range(rng.randint(0, 70)))
        text += rng.choice(["", "<|endoftext|>", " <|endoftext|> a"])
        ids = np.frombuffer(own.encode(text), "<u4")
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert own.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_shards_move_only_where_the_tree_changes(spark):
    rows = spark.range(4000).selectExpr("id as doc_id", "cast(id as string) as text")
    place = lambda tree: {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard(rows, tree).collect()}
    for shards in (1, 3, 8, 9):
        for shard, grown in place(sharding.Tree(shards)).values():
            assert grown in (shard, shards)
    light, heavy = place(sharding.Tree(8)), place(sharding.Tree(8, weights=(1, 1, 1, 3, 1, 1, 1, 1)))
    moved = {heavy[i][0] for i in light if light[i][0] != heavy[i][0]}
    assert moved == {3}
    counts = np.bincount([s for s, _ in heavy.values()], minlength=8)
    assert abs(counts[3] / 4000 - 0.3) < 0.04 and abs(counts[0] / 4000 - 0.1) < 0.03


def test_leaks_and_paraphrases(spark):
    rng = random.Random(2)
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(5000)]
    words = lambda n: [rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n)]
    items = [words(rng.randint(15, 120)) for _ in range(20)]
    documents, want = [], set()
    for i in range(300):
        text = words(rng.randint(40, 300))
        if i % 10 == 0:
            item = i // 10 % 20
            copy = list(items[item])
            if i % 20 == 0:  # a paraphrase: one word in six replaced, the answer kept
                for j in range(0, len(copy) * 3 // 4, 6):
                    copy[j] = rng.choice(rare)
            at = rng.randrange(len(text))
            text[at:at] = copy
            want.add((i, item))
        documents.append((i, " ".join(text).upper() + "."))
    out = decontaminate.find_leaks(
        spark.createDataFrame(documents, "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string"),
    )
    assert {(r.doc_id, r.item_id) for r in out.collect()} == want


def test_longest_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(0, 30)), rng.integers(0, 6, rng.integers(0, 90))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert decontaminate.common_subsequence(a, b) == table[-1, -1]


@here
def test_held_out_accuracy(spark):
    big = SF.replace("0.001", "0.1")  # the smaller tables hold out too few toxic documents to measure on
    documents, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    lang = QUERIES["op8_language"](spark, big).where("held_out").join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    assert (lang.lang == lang.lang_pred).mean() > 0.97 and lang.score.between(0, 1).all()
    tox = QUERIES["op10_toxicity"](spark, big).where("held_out").join(labels, "doc_id").toPandas()
    assert tox.toxic[tox.predicted == 1].mean() > 0.9 and tox.predicted[tox.toxic == 1].mean() > 0.75


def test_secrets_are_masked_in_place(spark):
    from fairtag.llm.secrets import redact

    rows = [(1, 'é token = "0123456789abcdef01234567" end', 40, None), (2, "plain", 5, "x"), (3, None, None, "x"), (3, None, None, "x")]
    out = sorted(map(tuple, redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, k1 string")).collect()), key=str)
    masked = re.sub(r'token = "0123456789abcdef01234567', "[SECRET]", rows[0][1])
    assert out == sorted([(1, masked, len(masked), None), *rows[1:]], key=str)


def test_pipeline_keeps_what_five_words_tell_apart(spark):
    """The stage against all pairs of five-word sets; with two words, five changed words in a hundred are a near copy."""
    import corpus_pipeline

    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(2000)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(100)]
        for changes in (0, 0, 1, 2, 3, 5, 6, 8):
            copy = list(base)
            for at in rng.sample(range(5, 95), changes):
                copy[at] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for t in texts]
    least = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((least[i], least[j]))
                least = [a if x == b else x for x in least]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dup(spark, docs, "").collect()} == set(least)


def test_short_items_among_words_the_benchmark_does_not_hold(spark):
    """Items of 5 to 12 words that are frequent in the corpus; nearly all other words of their documents are unseen."""
    rng = random.Random(4)
    common = [f"c{i}" for i in range(60)]
    items = [rng.sample(common, rng.randint(5, 12)) for _ in range(20)]
    texts = []
    for i in range(1500):
        text = [f"u{i}x{j}" for j in range(60)]
        at = rng.randrange(len(text))
        text[at:at] = items[i] if i < len(items) else rng.sample(common, 4)
        texts.append((i, " ".join(text)))
    out = decontaminate.find_leaks(
        spark.createDataFrame(texts, "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string"),
    )
    found = {(r.doc_id, r.item_id) for r in out.collect()}
    assert {(i, i) for i in range(len(items))} <= found
