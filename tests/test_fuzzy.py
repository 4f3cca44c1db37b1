"""The blocked similarity join against all pairs scored by the plain definition."""

import random

from pyspark.sql import functions as F

from fairtag.functions.similarity import common_subsequence, token_set_ratio
from fairtag.operators import classify as cls

WORDS = ["rtx", "rx", "4070", "407", "40700", "ti", "super", "xt", "sapphire", "saphire", "b", "580", "arc", "z", "notebok", "notebook"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    new = [0]
    for j, y in enumerate(b):
        new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
    return new


def ratio(a, b):
    return 100 - 100 * (len(a) + len(b) - 2 * lcs(a, b)) / (len(a) + len(b))


def token_set(title, alias, noise=cls.text.NOISE_WORDS):
    t, a = set(title.split()) - set(noise), set(alias.split())
    if not t or not a:
        return 0
    shared, left, right = (" ".join(sorted(s)) for s in (t & a, t - a, a - t))
    if shared and not (left and right):
        return 100
    whole = [" ".join(filter(None, (shared, side))) for side in (left, right)]
    scores = [ratio(*whole)]
    if shared:
        scores += [ratio(shared, w) for w in whole]
    return max(scores)


def test_common_subsequence_in_one_long_and_several(spark):
    rng = random.Random(0)
    rows = [("", ""), ("a", ""), ("", "b"), ("kitten", "sitting")]
    for n in (5, 12, 62, 63, 64, 130, 190):
        rows += [tuple("".join(rng.choice("abcd é🙂") for _ in range(rng.randrange(max(0, n - 12), n + 12))) for _ in "ab") for _ in range(40)]
    out = spark.createDataFrame(rows, "a string, b string").withColumn("n", common_subsequence(F.col("a"), F.col("b"))).collect()
    assert [r.n for r in out] == [lcs(r.a, r.b) for r in out]


def test_scores_are_exact_from_the_cutoff_up(spark):
    rng = random.Random(2)
    side = lambda: sorted({rng.choice(WORDS) + rng.choice(["", "", "x"]) for _ in range(rng.randrange(5))})
    rows = [(side(), side()) for _ in range(400)]
    frame = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for cutoff in (0, 60, 88):
        for r in frame.withColumn("s", token_set_ratio(F.col("a"), F.col("b"), cutoff)).collect():
            want = token_set(" ".join(r.a), " ".join(r.b), noise=())
            assert abs(r.s - want) < 1e-9 if want >= cutoff else r.s < cutoff


def test_no_match_is_lost_and_the_best_alias_wins(spark):
    rng = random.Random(4)

    def garble(text):
        chars = list(text)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(chars)) if chars else 0
            chars[at:at + 1] = rng.choice([[], [rng.choice("abcr0 47")], chars[at:at + 1] * 2])
        return " ".join("".join(chars).split())

    def phrase(most):
        return " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, most)))

    aliases = list(dict.fromkeys(phrase(4) for _ in range(60)))
    titles = list({garble(rng.choice(aliases)) for _ in range(250)} | {phrase(7) for _ in range(250)} - {""})
    vetoed = {f"p{i}": ["super"] for i in range(0, len(aliases), 3)}
    products = spark.createDataFrame(
        [(i, f"p{i}", vetoed.get(f"p{i}", []), [a]) for i, a in enumerate(aliases)],
        "pos int, product_id string, none_of array<string>, aliases array<string>",
    )
    found = {
        r.normalized_title: (r.fuzzy_product, round(r.fuzzy_score, 6))
        for r in cls.fuzzy_match(spark.createDataFrame([(t,) for t in titles], "normalized_title string"), products).collect()
    }
    expected = {}
    for title in titles:
        scored = [(token_set(title, a), -i) for i, a in enumerate(aliases)]
        score, at = max(scored)
        if score >= 88 and not ("super" in title.split() and f"p{-at}" in vetoed):
            expected[title] = (f"p{-at}", round(score, 6))
    assert len(expected) > 100
    assert found == expected


def test_shared_alias_text_belongs_to_the_last_product(spark):
    products = spark.createDataFrame(
        [(0, "a", [], ["foo bar"]), (1, "b", [], ["foo baz"]), (2, "c", [], ["foo bar"])],
        "pos int, product_id string, none_of array<string>, aliases array<string>",
    )
    got = cls.fuzzy_match(spark.createDataFrame([("foo",)], "normalized_title string"), products).first()
    assert (got.fuzzy_product, got.fuzzy_score) == ("c", 100.0)
