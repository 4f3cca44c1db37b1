"""Personal data: known forms against plain regular expressions, the rounds against a plain loop, planted unseen identifiers."""

import hashlib
import random
import re
import time
from collections import defaultdict

import pytest

from fairtag.llm.pii import Bootstrap, FOUND, KINDS, UNSEEN, contexts, discovered, find_private, graph, known_forms, scanned, span_digests

SCHEMA = "doc_id long, text string, row string, base int, seen string, kind long, score double"
EXTRA = (None, 1, "x", 2, 0.5)
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0


def plain(text):
    out = []
    for kind, (name, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if name == "ip" and any(int(p) > 255 for p in m[0].split(".")) or name == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if name == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_known_forms_against_plain_expressions():
    rng = random.Random(1)
    pieces = ["a", "B7", "@", "@", ".", ".", "-", " ", "+", "+1", "4", "55", "255", "256", "10.0.0.1", "4111111111111111", "(", ")", "%", "é", "🙂", "\n", "x.y", "4 1-1"]
    for _ in range(30_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert known_forms(text)[0] == plain(text), text
    digits = "".join(rng.choice("0123456789 -") for _ in range(20_000))
    assert known_forms(digits)[0] == plain(digits)


@pytest.mark.parametrize("text", ["1" * 300_000, "a" * 300_000, "a@" * 100_000, "1." * 150_000, "+1 " * 100_000, "x1 " * 100_000, "(" * 300_000, "a=1" * 100_000, "+" + "1 " * 150_000])
def test_long_texts_are_scanned_in_linear_time(text):
    from fairtag.llm.pii import unseen

    started = time.perf_counter()
    known_forms(text)
    assert len(list(unseen(text))) >= 0 and time.perf_counter() - started < 5


def document(rng, i):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    words = [word() for _ in range(60)]
    kind = i % 6
    if kind == 0:
        words[20:20] = ["Reach", "me:", f"{word()}.{i}@mail.example.com,", "thanks"]
    elif kind == 1 and i % 4:
        words[20:20] = ["my", "phone:", f"+1 (555) {i:03d}-{rng.randrange(10_000):04d}"]
    elif kind == 1:
        words[20:20] = ["my", "phone:", f"555/{i:04d}/77"]
    elif kind == 2:
        words[20:20] = ["page", f"{rng.randrange(1000)}"]
    elif kind == 3:
        words[20:20] = ["card", f"{rng.randrange(10**15, 10**16)}"]
    return " ".join(words)


def plain_rounds(edges, spec):
    """The rounds of ``discovered`` over (pattern, instance) -> label."""
    scores = {}
    for _ in range(spec.rounds):
        sums = defaultdict(lambda: [0, [0.0] * len(KINDS)])
        for (pattern, instance), label in edges.items():
            sums[pattern][0] += 1
            if label < len(KINDS):
                sums[pattern][1][label] += 1
            elif label == UNSEEN and instance in scores:
                kind, score = scores[instance]
                sums[pattern][1][kind] += score
        sure = {}
        for pattern, (n, kinds) in sums.items():
            m, z = max(kinds) / n, spec.z
            low = (m + z * z / (2 * n) - z * (max(m * (1 - m), 0) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
            if low >= spec.pattern:
                sure[pattern] = (kinds.index(max(kinds)), low)
        fresh = defaultdict(lambda: [0.0] * len(KINDS))
        for (pattern, instance), label in edges.items():
            if label == UNSEEN and pattern in sure:
                kind, score = sure[pattern]
                fresh[instance][kind] = max(fresh[instance][kind], score)
        scores = {i: (k.index(max(k)), max(k)) for i, k in fresh.items()}
    return {(i, k, round(s, 9)) for i, (k, s) in scores.items() if s >= spec.accept}


@pytest.mark.parametrize("spec", [Bootstrap(), Bootstrap(accept=0.6, salts=3, rounds=2)])
def test_rounds_against_plain_loop_and_planted_identifiers(spark, spec):
    rng = random.Random(5)
    texts = [document(rng, i) for i in range(900)]
    docs = spark.createDataFrame([(i, t, *EXTRA) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    edges = graph(scanned(docs, spec))
    labels = {(r.pattern, r.instance): r.label for r in edges.collect()}
    got = {(r.instance, r.kind, round(r.score, 9)) for r in discovered(edges, spec).collect()}
    assert got == plain_rounds(labels, spec)
    found = find_private(docs, spec).collect()
    extra = {(r.doc_id, s.hit) for r in found for s in r.all_spans if s.kind >= len(KINDS)}
    assert extra == {(i, f"555/{i:04d}/77") for i in range(900) if i % 6 == 1 and i % 4 == 0}
    for r in found:
        assert all(texts[r.doc_id][s.start:s.end].lower() == s.hit.lower() for s in r.all_spans)
        assert [tuple(s)[:3] for s in r.base_spans] == plain(texts[r.doc_id])


def test_random_contexts_discover_nothing(spark):
    """Known forms and other numbers among the same few words: no word tells of either."""
    rng = random.Random(8)
    rows = []
    for i in range(600):
        words = [rng.choice("the of and in to a".split()) for _ in range(40)]
        words[20:20] = [rng.choice([f"u{i}@mail.example.com", f"10.0.{i % 250}.{i % 7}", f"{rng.randrange(10**15, 10**16)}", f"id{i}"])]
        rows.append((i, " ".join(words), *EXTRA))
    assert all(r.n_context == 0 for r in find_private(spark.createDataFrame(rows, SCHEMA)).collect())


def test_edges_and_digests(spark):
    texts = [
        None, "", " \n", "a@b.c", "é🙂 x@y.zz and 10.1.2.3", "10.1.2.3.4.5.6.7 256.1.1.1", "+1 (017) 555-7713 4111 1111 1111 1111", "1" * 50_000, "a" * 50_000,
    ]
    rows = [(i, t, *EXTRA) for i, t in enumerate(texts)] + [(None, "a@b.c", *EXTRA), (3, "a@b.c", *EXTRA)]
    out = span_digests(find_private(spark.createDataFrame(rows, SCHEMA))).collect()
    names = lambda t: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in plain(t or ""))
    assert sorted((str(r.doc_id), r.spans, r.base_sha256) for r in out) == sorted(
        (str(r[0]), names(r[1]), hashlib.sha256(names(r[1]).encode()).hexdigest()) for r in rows
    )
    assert len(FOUND) == len(KINDS) and contexts("word", 0, 4, Bootstrap()) == []
    assert find_private(spark.createDataFrame([], SCHEMA)).collect() == []
