"""Modifiers as a table against every pattern over every text."""

import random
import re

import pytest

from fairtag.operators import modifiers as mods
from fairtag.sources.catalog import Modifier

PLAIN = {
    "avariad": "avariad", r"^procuro\b": "procuro", r"^precisa[- ]se\b": "precisa", "(?<!sem )(?<!s )garantia": "garantia",
    r"lote de \d+": "lote de ", r"\d+ unidades": " unidades", r"\bis\b.*\bof\b": "is", "a|b": "", "(?i)abc": "", "colou?r": "colo",
    "ab+cd": "ab", "x{2,3}yz": "yz", "(foo|bar) baz": " baz", r"1\.5 gb": "1.5 gb", r"\x41bc": "", r"\Qa.b\E": "", "": "", "[a-c]*": "",
    r"(a\)b)c": "c", "a{2": "", "q$": "q",
}


@pytest.mark.parametrize("pattern", PLAIN)
def test_plain_part(pattern):
    assert mods.plain_part(pattern) == PLAIN[pattern]


def brute(title, haystack, modifiers):
    """First exclusion, price modifiers and their sum, by every pattern."""
    excluded, found, pct = None, [], 0.0
    for m in modifiers:
        target = title if m.exclude and any(p.startswith("^") for p in m.patterns) else haystack
        if target is None or not any(re.search(p, target) for p in m.patterns):
            continue
        if m.exclude:
            excluded = excluded or m.modifier_id
        else:
            found.append(m.modifier_id)
            pct += m.price_adjust_pct
    return excluded, found, pct


def found_in(spark, texts, modifiers):
    rows = spark.createDataFrame([(str(i), *t) for i, t in enumerate(texts)], "listing_id string, title string, hay string")
    out = mods.with_modifiers(rows, "title", "hay", modifiers)
    assert "hay" not in out.columns
    return {r["listing_id"]: (r["excluded_by"], r["found"], r["adjust_pct"]) for r in out.collect()}


def test_against_every_pattern(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 7))) for _ in range(60)] + ["1", "22", "novo", "caixa"]
    phrase = lambda n: " ".join(rng.choices(words, k=n))
    shapes = [
        lambda: rng.choice(words), lambda: rf"\b{rng.choice(words)}\b", lambda: "^" + rng.choice(words), lambda: rf"{rng.choice(words)} \d+",
        lambda: f"(?<!{rng.choice(words)} ){rng.choice(words)}", lambda: phrase(2), lambda: f"({phrase(1)}|{phrase(1)}) {phrase(1)}",
        lambda: rng.choice(words) + "+$", lambda: rf"{phrase(1)}.*{phrase(1)}", lambda: r"^\d+$",
    ]
    modifiers = [
        Modifier(f"m{i}", tuple(rng.choice(shapes)() for _ in range(rng.randint(0, 3))), rng.random() < 0.3, rng.choice([-8.0, 0.1, 10.0]))
        for i in range(120)
    ]
    titles = [phrase(rng.randint(1, 8)) for _ in range(150)] + ["", None, "22"]
    texts = [(t, t if rng.random() < 0.3 or not t else f"{t} {phrase(rng.randint(1, 20))}") for t in titles]
    got = found_in(spark, texts, modifiers)
    for i, (title, hay) in enumerate(texts):
        assert got[str(i)] == brute(title, hay, modifiers), (title, hay)


def test_five_thousand_modifiers_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(mods, "BLOCK", 4_000)
    modifiers = [Modifier(f"m{i}", (rf"\bcode {i:05d}\b", f"tag{i:05d}x"), i % 7 == 0, float(i % 5)) for i in range(5_000)]
    texts = [(f"card code {i:05d}", f"card code {i:05d} tag{(i * 3) % 5_000:05d}x") for i in range(0, 5_000, 37)]
    got = found_in(spark, texts, modifiers)
    for i, (title, hay) in enumerate(texts):
        there = {int(n) for n in re.findall(r"\d{5}", hay)}
        assert got[str(i)] == brute(title, hay, [modifiers[n] for n in sorted(there)])


def test_rows_of_one_listing_and_no_modifiers(spark):
    rows = spark.createDataFrame([("1", "a b", "a b"), ("1", "c", "c d"), ("1", "c", "c d"), (None, "a", "a"), (None, None, None)],
                                 "listing_id string, title string, hay string")
    modifiers = [Modifier("one", ("a", "b")), Modifier("two", ("^c",), True)]
    out = mods.with_modifiers(rows, "title", "hay", modifiers).select("listing_id", "title", "excluded_by", "found").collect()
    assert sorted(map(tuple, out), key=str) == sorted(
        [("1", "a b", None, ["one"]), ("1", "c", "two", []), ("1", "c", "two", []), (None, "a", None, ["one"]), (None, None, None, [])], key=str
    )
    assert mods.with_modifiers(rows, "title", "hay", []).where("excluded_by is null and size(found) = 0 and adjust_pct = 0").count() == 5
    assert mods.with_modifiers(rows.limit(0), "title", "hay", modifiers).count() == 0


def test_few_and_many_agree_and_shuffle_no_text(spark, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(40)]
    shapes = [lambda: rf"\b{rng.choice(words)}", lambda: rng.choice(words), lambda: "^" + rng.choice(words), lambda: rf"\b{rng.choice(words)} \w+"]
    modifiers = [Modifier(f"m{i}", tuple(rng.choice(shapes)() for _ in range(2)), rng.random() < 0.4, float(i % 5)) for i in range(100)]
    texts = [(" ".join(rng.choices(words, k=3)), " ".join(rng.choices(words, k=9))) for _ in range(80)]
    texts += [("begins ab", "begins abc"), ("x-abc", "\u00e9abc"), (None, "abc"), ("abc", None)]
    few = found_in(spark, texts, modifiers)
    monkeypatch.setattr(mods, "FEW", 0)
    assert found_in(spark, texts, modifiers) == few
    for i, (title, hay) in enumerate(texts):
        if hay is not None and hay.isascii():
            assert few[str(i)] == brute(title, hay, modifiers), (title, hay)
    rows = spark.createDataFrame([("1", "a", "a b")], "listing_id string, title string, hay string")
    plan = mods.with_hits(rows, "title", "hay", modifiers)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "m17" not in plan


def test_few_patterns_are_conditions_of_the_plan(spark, monkeypatch):
    modifiers = [
        Modifier("x", ("^ab", "zz"), True), Modifier("y", (r"b\d+",), True), Modifier("p", ("cd", r"\bc"), price_adjust_pct=0.1),
        Modifier("q", (), price_adjust_pct=5.0), Modifier("r", ("d$",), price_adjust_pct=0.2), Modifier("s", ("d",), price_adjust_pct=-0.3),
    ]
    texts = [("ab", "x ab"), ("cab", "ab cd"), ("c", "b12 zz"), ("cd", "cd"), ("", ""), (None, "zz d"), ("abc", None), (None, None), ("e", "c e")]
    want = {str(i): brute(*t, modifiers) for i, t in enumerate(texts)}
    called = []
    monkeypatch.setattr(mods, "with_hits", lambda *args: called.append(args))
    assert found_in(spark, texts, modifiers) == want and not called
    assert found_in(spark, texts, []) == {str(i): (None, [], 0.0) for i in range(len(texts))}
    monkeypatch.undo()
    monkeypatch.setattr(mods, "DIRECT", 0)
    assert found_in(spark, texts, modifiers) == want
