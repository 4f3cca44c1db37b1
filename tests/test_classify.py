"""Classification of titles generated from the catalog's own rows and patterns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fairtag.functions import text
from fairtag.operators import classify as cls


def bare(pattern):
    """The plain words of a pattern, and the guard words that must not stand before them."""
    guards = re.findall(r"\(\?<!([^)]*)\)", pattern)
    words = re.sub(r"\(\?<![^)]*\)", "", pattern)
    for sign, plain in ((r"\b", ""), ("^", ""), (r"\d+", "3"), ("[- ]", " ")):
        words = words.replace(sign, plain)
    return words.strip(), guards


def modifier_titles(gpu):
    """Every pattern alone and after each of its guard words."""
    for m in gpu.modifiers:
        for pattern in m.patterns:
            words, guards = bare(pattern)
            for guard in ["", *guards]:
                yield f"{guard}{words} rtx 3090" if pattern.startswith("^") else f"rtx 3090 {guard}{words}"


@pytest.fixture(scope="module")
def labels(gpu):
    return {r.label: r for r in gpu.products.collect()}


@pytest.fixture(scope="module")
def results(spark, gpu, labels):
    """All titles of this module classified in one pass: title -> (normalised title, result)."""
    titles = [*labels, *(f"{label} {gpu_word}" for label in labels for gpu_word in ("laptop",)), *modifier_titles(gpu), *FUZZY, *UNKNOWN]
    rows = [(str(i), t, "", 100_000) for i, t in enumerate(dict.fromkeys(titles))]
    listings = spark.createDataFrame(rows, "listing_id string, title string, description string, price_cents bigint")
    plain = {r.listing_id: r.n for r in listings.select("listing_id", text.normalize(F.col("title")).alias("n")).collect()}
    found = {r.listing_id: r for r in cls.classify(listings, gpu).collect()}
    assert len(found) == len(rows)
    return {t: (plain[i], found[i]) for i, t, _, _ in rows}


# A title of which only a common word is left counts as contained in the first alias that has it.
FUZZY = {"arc placa gaming b": "arc_b580"}
UNKNOWN = ["Candeeiro de pé", "Quadro W7100", "Ecrã de 32 polegadas", ""]


def test_each_card_is_told_from_its_variants(results, labels):
    got = {label: (results[label][1].match_kind, results[label][1].product_id) for label in labels}
    assert got == {label: ("rule", row.product_id) for label, row in labels.items()}
    # A variant's title names the base card too; the rule with more words wins.
    words = {row.product_id: set(row["all"]) for row in labels.values()}
    pairs = [(a, b) for a in words for b in words if words[a] < words[b]]
    assert len(pairs) > 15


def test_laptop_cards_stay_unmatched(results, labels):
    assert {results[f"{label} laptop"][1].match_kind for label in labels} == {"none"}


def test_unknown_titles_stay_unmatched(results):
    assert {(results[t][1].match_kind, results[t][1].product_id) for t in UNKNOWN} == {("none", None)}


def test_fuzzy(results):
    assert {t: (results[t][1].match_kind, results[t][1].product_id) for t in FUZZY} == {t: ("fuzzy", p) for t, p in FUZZY.items()}


def test_patterns_and_their_guards(results, gpu):
    guarded = 0
    for title in modifier_titles(gpu):
        plain, row = results[title]
        hits = [m for m in gpu.modifiers if any(re.search(p, plain) for p in m.patterns)]
        reason = next((m.modifier_id for m in hits if m.exclude), None)
        assert row.excluded_by == reason, title
        found = [] if reason else [m for m in hits if not m.exclude]
        assert sorted(row.modifiers) == sorted(m.modifier_id for m in found), title
        assert row.adjust_pct == sum(m.price_adjust_pct for m in found), title
        assert reason is None or (row.match_kind, row.product_id) == ("excluded", None)
        guarded += not hits
    assert guarded >= 5


def test_adjustment_is_clamped_and_null_safe(spark):
    df = spark.createDataFrame([(100000, -400.0), (100000, 400.0), (None, -10.0), (250, 1.0)], "c bigint, p double")
    got = [r.a for r in df.select(cls.adjusted_cents(F.col("c"), F.col("p")).alias("a")).collect()]
    assert got == [65000, 135000, None, 252]


def test_catalog_tables(gpu):
    rows = {r.product_id: r for r in gpu.products.collect()}
    assert len(rows) == 66 and sum("perf_index" in r.attributes for r in rows.values()) == 48
    assert sum(r.retail_fallback_eur > 0 for r in rows.values()) == 14
    assert rows["rtx_5070_ti"].attributes["perf_index"] == 100.0 and rows["rtx_5070"].retail_fallback_eur == 670
    assert rows["rtx_5090"].attributes == {"perf_index": 143.3, "vram_gb": 32.0, "tdp_w": 575.0}
    assert rows["rtx_5060_ti_16"].label == "GeForce RTX 5060 Ti 16GB" and rows["rtx_5060_ti_16"].any_of == ["16gb"]
    assert rows["rtx_5080"].none_of == ["super", "ti", "laptop", "portatil", "notebook"]
    assert rows["rtx_5090"].pos == 0 and rows["gtx_1060_6"].pos == 65 and len(gpu.version) == 12


def test_search_terms(gpu):
    from fairtag.sources.catalog import search_terms

    terms = [r.term for r in search_terms(gpu).orderBy("pos").collect()]
    assert len(terms) == len(set(terms)) and terms[0] == "rtx 5090" and terms[-1] == "placa grafica"
    assert "rtx 5060 ti" in terms and not any(t.endswith("16gb") or t.startswith(("geforce", "radeon rx")) for t in terms)


def test_catalog_is_clean(gpu):
    from fairtag.operators import quality

    assert quality.variant_swallowing(gpu.products).count() == 0
    assert quality.duplicate_ids(gpu.products).count() == 0
    assert quality.unmatchable_rules(gpu.products).count() == 0


def test_incremental_work_list(spark, gpu):
    now = "2024-05-01"
    listings = spark.createDataFrame(
        [(k, "gpu", "RTX 4070", "", 1, seen) for k, seen in (("new", now), ("same", "2024-01-01"), ("old", "2024-01-01"), ("again", now))],
        "listing_id string, category string, title string, description string, price_cents bigint, last_seen string",
    ).withColumn("last_seen", F.col("last_seen").cast("timestamp"))
    stamp = F.lit("2024-02-01").cast("timestamp")
    _, table = cls.reclassify(listings.filter("listing_id <> 'new'"), empty(spark), gpu, stamp, force=True)
    known = table.withColumn("catalog_version", F.when(F.col("listing_id") == "old", "other").otherwise(F.col("catalog_version")))
    fresh, full = cls.reclassify(listings, known, gpu, F.lit(now).cast("timestamp"))
    assert sorted(r.listing_id for r in fresh.collect()) == ["again", "new", "old"]
    assert full.count() == 4 and full.filter("product_id = 'rtx_4070'").count() == 4


def empty(spark):
    from fairtag import schemas

    return spark.createDataFrame([], schemas.NORMALIZED)


def test_unmatched_queue_counts_every_run(spark):
    listings = spark.createDataFrame([(str(i), "Olá Mundo" if i < 3 else "x") for i in range(4)], "listing_id string, title string")
    results = listings.selectExpr("listing_id", "'c' AS category", "'none' AS match_kind", "IF(listing_id < 3, 'ola mundo', 'x') AS normalized_title")
    first, second = (cls.unmatched_titles(results, listings, F.lit(t).cast("timestamp")) for t in ("2024-01-01", "2024-02-01"))
    seen = cls.dismiss(first, first.filter("sample_title = 'x'"))
    merged = {r.sample_title: r for r in cls.merge_unmatched(seen, second).collect()}
    assert merged["Olá Mundo"].occurrences == 6 and not merged["Olá Mundo"].resolved
    assert merged["x"].resolved and str(merged["x"].first_seen) < str(merged["x"].last_seen)


def test_a_catalog_edit_rematches_only_what_it_can_reach(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    schema = "pos int, product_id string, `all` array<string>, any_of array<string>, none_of array<string>, aliases array<string>"
    rows = [
        (i, f"p{i}", rng.sample(words, rng.choice([0, 1, 2])), rng.sample(words, 2) if i % 3 == 0 else [], rng.sample(words, 1) if i % 4 == 0 else [],
         [" ".join(rng.sample(words, 3))]) for i in range(40)
    ]
    titles = {" ".join(rng.sample(words, rng.randint(1, 5))) + rng.choice(["", "x"]) for _ in range(600)}
    names = spark.createDataFrame([(t,) for t in titles], "normalized_title string")
    edits = [
        rows[:5] + rows[6:] + [(99, "new", [words[20]], [], [], ["w20 w21"])],
        [(*r[:2], [words[7]], *r[3:]) if r[0] == 9 else (*r[:4], [words[3]], r[5]) if r[0] == 12 else (*r[:5], [*r[5], "w1 w2 w3"]) if r[0] == 11 else r for r in rows],
    ]
    old = spark.createDataFrame(rows, schema)
    before = cls.cut_lineage(cls.match_titles(names, old))
    for edit in edits:
        new = spark.createDataFrame(edit, schema)
        touched, after = cls.rematch_titles(names, before, old, new)
        assert sorted(map(str, after.collect())) == sorted(map(str, cls.match_titles(names, new).select(after.columns).collect()))
        assert touched.count() < len(titles) / 2
