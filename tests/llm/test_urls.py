"""URL rules, word segmentation and the classifier."""

import math
import re
from collections import Counter

from fairtag.llm.urls import ALLOW_WORDS, BLOCK_WORDS, PLAIN_LABELS, Segmenter, UrlModel, judge, word_counts

SCHEMA = "page_id long, url string, html string, host int, found string"


def judged(spark, urls):
    rows = [(i, u, None, 1, "x") for i, u in enumerate(urls)]
    return [tuple(r)[:5] for r in judge(spark.createDataFrame(rows, SCHEMA)).orderBy("page_id").collect()]


def test_hosts_paths_and_rules(spark):
    urls = [
        "HTTP://WWW.Example.ORG/es/Seite?x=1", "https://a.example.org/en/17#top", "http://example.org", "x://b.com/fr/1", "x://b.com/de",
        "x://b.com/de/2", "x://notorg/1", "x://ÄB.net?q", None, "", "no scheme", "://", "x://a.org#://b.com/de/", "x://a.org#://b.com/de/",
    ]
    assert judged(spark, urls) == [
        (0, "www.example.org", "/es/Seite", "example.org/es/", "block"), (1, "a.example.org", "/en/17", "example.org/en/1", "block"),
        (2, "example.org", "", None, "allow"), (3, "b.com", "/fr/1", "com/fr/", "allow"), (4, "b.com", "/de", None, "allow"),
        (5, "b.com", "/de/2", "com/de/", "block"), (6, "notorg", "/1", None, "allow"), (7, "Äb.net", "", None, "allow"),
        (8, "", "", None, "allow"), (9, "", "", None, "allow"), (10, "", "", None, "allow"), (11, "", "", None, "allow"),
        (12, "a.org", "", None, "allow"), (13, "a.org", "", None, "allow"),
    ]


def test_joined_names_are_split_and_scored(spark):
    urls = ["http://freecasinobonus.net/a", "http://schoollibrary.net/help", "http://sussex.net/", "http://x.net/" + "win" * 5000]
    verdicts = [r[4] for r in judged(spark, urls)]
    assert verdicts[0] == "block" and verdicts[1] == "allow" and verdicts[2] == "allow" and verdicts[3] == "block"
    segmenter = Segmenter({}, UrlModel())
    assert segmenter.split("freecasinobonus") == ["free", "casino", "bonus"]
    assert segmenter.split("sussex") == ["sussex"]


def test_split_is_the_most_probable_one():
    counts = {"ab": 5, "a": 3, "b": 3, "abc": 1, "c": 4, "bc": 2}
    segmenter = Segmenter(counts, UrlModel())

    def splits(token):
        if not token:
            yield []
        for i in range(1, len(token) + 1):
            if token[:i] in counts:
                yield from ([token[:i], *rest] for rest in splits(token[i:]))

    for token in ("abc", "abab", "abcabc", "cabbc", "aabbcc"):
        cost = lambda words: sum(segmenter.cost[w] for w in words)
        assert abs(cost(segmenter.split(token)) - min(map(cost, splits(token)))) < 1e-9


def test_no_rows(spark):
    assert judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_words_of_visible_text_are_counted(spark):
    html = "<p class='x'>The poker &amp; the Größe<script>var poker = 1;</script> it's a-b www.mypoker.com/win</p>"
    counts = word_counts(spark.createDataFrame([(1, None, html, 1, "x"), (2, None, None, 1, "x"), (3, None, "", 1, "x")], SCHEMA))
    assert {r["piece"]: r["n"] for r in counts.collect()} == {"the": 2, "poker": 1, "a": 1, "b": 1}


def plain_verdicts(pages, spec=UrlModel()):
    """Words and log odds of (url, html, label, rest of the url that the rule leaves), one page after the other."""
    counts = Counter(w for _, html, _, _ in pages for w in html.split())
    segmenter = Segmenter(counts, spec)

    def least(token):
        """Every split, words known or unknown, by its cost."""
        if not token:
            return 0.0, []
        found = []
        for i in range(1, len(token) + 1):
            word = token[:i]
            cost = segmenter.cost[word] if word in segmenter.cost else segmenter.unknown + spec.letter * i
            tail = least(token[i:])
            found.append((cost + tail[0], [word, *tail[1]]))
        return min(found)

    words = lambda text: [w for t in re.findall("[a-z]+", text) if t not in PLAIN_LABELS for w in least(t)[1]]
    seen = {(url.split("/")[2], label, w) for url, _, label, rest in pages if label for w in words(rest)}
    block, allow = (Counter(w for _, label, w in seen if label == kind) for kind in ("block", "allow"))
    seed = [max(spec.seed_sites, spec.seed_hosts * sum(c.values())) for c in (block, allow)]
    for w in BLOCK_WORDS:
        block[w] += seed[0]
    for w in ALLOW_WORDS:
        block[w] += spec.mixed * seed[0]
        allow[w] += seed[1]
    size = len({*block, *allow}) + 1
    share = lambda c, w: (c[w] + spec.smoothing) / (sum(c.values()) + spec.smoothing * size)
    odds = lambda w: math.log(share(block, w) / share(allow, w)) if w in block or w in allow else 0.0
    out = []
    for url, _, _, _ in pages:
        found = words(url.split("://")[1])
        out.append((found, math.log(spec.block_prior / (1 - spec.block_prior)) + sum(map(odds, found))))
    return out


def test_against_brute_force(spark):
    pages = [
        ("x://mypoker.net/a", "my the royal", None, ""), ("x://casinoroyal.net/q", "go the my go", None, ""),
        ("x://theking.com/de/grabit", "the king grab it", "block", "theking./grabit"), ("x://theking.com/de/grabit", "", "block", "theking./grabit"),
        ("x://gograb.com/de/", "go", "block", "gograb./"), ("x://booksmy.com/fr/king", "my", "allow", "booksmy./king"),
        ("x://kingbooks.org/it", "it", "allow", "kingbooks./it"), ("x://grabking.net/", "king", None, ""), ("x://zzqqy.net/", "", None, ""),
    ]
    rows = [(i, url, html, 1, "x") for i, (url, html, _, _) in enumerate(pages)]
    found = judge(spark.createDataFrame(rows, SCHEMA)).orderBy("page_id").collect()
    for row, (words, margin) in zip(found, plain_verdicts(pages), strict=True):
        assert row["words"] == words
        assert abs(row["log_odds"] - margin) < 1e-9
        assert row["rule"] or row["verdict"] == ("block" if margin > 0 else "allow")
    assert found[0]["words"] == ["my", "poker", "a"] and found[1]["words"][:2] == ["casino", "royal"]


def test_a_hot_word_and_repeated_rows(spark):
    rows = [(1, "x://freecasino.net/win", "free", 1, "x")] * 300 + [(i, None, None, 1, "x") for i in range(2, 200)]
    found = judge(spark.createDataFrame(rows, SCHEMA))
    assert found.groupBy("page_id", "verdict").count().where("page_id = 1").collect()[0][1:] == ("block", 300)
    assert found.where("page_id > 1 and verdict = 'allow' and size(words) = 0").count() == 198
