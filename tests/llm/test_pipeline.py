"""Every stage of the pipeline against a plain version, on planted rows with nulls, repeated rows and clashing names."""

import random
import re

import pytest

import corpus_pipeline

public_tokenizers = pytest.importorskip("public_tokenizers")
CLASHES = ["_id", "_none", "_k1", "_k2", "_worded", "_row", "_spans", "row", "k1", "spans", "found", "ids", "n_tokens", "id", "nth"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
RUDE = "idiot moron pathetic worthless stupid".split()
KEY = 'token = "0123456789abcdef01234567"'


def row(i, text):
    return (i, text, "en", "s", None if text is None else len(text), *[f"{c}{i}" for c in CLASHES])


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [prose(rng.randint(15, 40)) for _ in range(12)]
    kinds, rows, labels = {}, [], []

    def add(kind, words):
        i = len(rows)
        kinds.setdefault(kind, []).append(i)
        rows.append(row(i, None if words is None else " ".join(words)))
        return i

    for i in range(360):
        words = prose(rng.randint(60, 160))
        toxic = rng.random() < 0.35
        if toxic:
            for _ in range(8):
                words.insert(rng.randrange(len(words)), "you " + rng.choice(RUDE))
        labels.append((add("toxic" if toxic else "clean", words), 1, int(toxic)))
    for i in range(20):
        base = prose(120)
        first = add("first", base)
        for changes in (0, 1, 2):
            copy = list(base)
            for at in rng.sample(range(10, 110), changes):
                copy[at] = rng.choice(vocabulary)
            add("copy", copy)
        # Far enough to stay: every fourth word differs.
        add("other", [w if n % 4 else rng.choice(vocabulary) for n, w in enumerate(base)])
    for i in range(24):
        words = prose(100)
        at = rng.randrange(100)
        add("leak", words[:at] + items[i % 12] + words[at:])
    for i in range(15):
        words = prose(80)
        words[40:40] = [KEY]
        add("secret", words)
    add("empty", None)
    add("empty", [])
    rows.append(rows[kinds["clean"][0]])
    folder = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), {r[0]: r for r in rows}, kinds


def kept(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def near(texts):
    """The least id of every component of five-word sets, by all pairs."""
    sets = {i: frozenset(zip(*(t.split()[k:] for k in range(5)))) or frozenset([tuple(t.split())]) for i, t in texts.items() if t.split()}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i for i in ids if root[i] == i} | (texts.keys() - sets.keys())


def common(a, b):
    line = [0] * (len(b) + 1)
    for x in a:
        above, line = line, [0]
        for j, y in enumerate(b):
            line.append(above[j] + 1 if x == y else max(above[j + 1], line[j]))
    return line[-1]


def test_stages_against_plain_versions(spark, tables):
    folder, rows, kinds = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    out = kept(corpus_pipeline.toxicity(spark, docs, folder))
    assert {r[0] for r in out} == rows.keys() - set(kinds["toxic"])
    assert out == sorted([rows[r[0]] for r in out], key=str) and len(out) == len({r[0] for r in out}) + 1

    out = kept(corpus_pipeline.near_dup(spark, docs, folder))
    alone = near({i: r[1] or "" for i, r in rows.items()})
    assert alone >= {*kinds["first"], *kinds["other"], *kinds["clean"]} and not alone & set(kinds["copy"])
    assert out == sorted((rows[i] for i in alone), key=str)

    items = [r.text.split() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaks = {
        i for i, r in rows.items() for item in items
        if r[1] and len(set(item) & set(r[1].split())) >= 0.55 * len(item) and common(item, r[1].split()) >= 0.75 * len(item)
    }
    assert leaks == set(kinds["leak"])
    out = kept(corpus_pipeline.decontamination(spark, docs, folder))
    assert out == sorted([*(r for i, r in rows.items() if i not in leaks), rows[kinds["clean"][0]]], key=str)

    def masked(r):
        text = r[1] and re.sub(r'token = "0123456789abcdef01234567', "[SECRET]", r[1])
        return r if text == r[1] else (r[0], text, *r[2:4], len(text), *r[5:])

    out = kept(corpus_pipeline.secrets(spark, docs, folder))
    assert out == sorted([*map(masked, rows.values()), rows[kinds["clean"][0]]], key=str)

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    frame = corpus_pipeline.tokens(spark, docs, folder)
    assert frame.columns == [*docs.columns, "ids_", "n_tokens_", "round_trip"]
    for r in frame.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert tuple(r)[:len(docs.columns)] == rows[r.doc_id] and (r.ids_, r.n_tokens_, r.round_trip) == (ids, len(ids), True)


def test_run_applies_the_stages_in_order(spark, tables):
    folder, rows, kinds = tables
    out = corpus_pipeline.run(spark, folder)
    gone = {*kinds["toxic"], *kinds["copy"], *kinds["leak"]}
    assert sorted(r.doc_id for r in out.collect()) == sorted(rows.keys() - gone)
    assert {r.text.count("[SECRET]") for r in out.where("text like '%SECRET%'").collect()} == {1}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dup", "decontamination", "secrets", "tokens"]


def test_empty_tables(spark, tables, tmp_path):
    folder, _, _ = tables
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
