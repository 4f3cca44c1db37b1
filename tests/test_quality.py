from pyspark.sql import functions as F

from fairtag.operators import quality


def rules(spark, *rows):
    return spark.createDataFrame(
        [("c", i, name, all_, [], none_of) for i, (name, all_, none_of) in enumerate(rows)],
        "category string, pos int, product_id string, `all` array<string>, any_of array<string>, none_of array<string>",
    )


def test_swallowing_is_named(spark):
    found = quality.variant_swallowing(rules(spark, ("base", ["7900"], []), ("variant", ["7900 XTX"], []), ("joined", ["7900xtx"], []))).collect()
    assert sorted((r.product_id, r.swallowed_id) for r in found) == [("base", "joined"), ("base", "variant")]
    assert found[0].level == "error" and found[0].missing == ["xtx"] and found[0]["where"] == "products / base"
    assert "'base' will swallow 'variant' listings: it requires ['7900'] and does not exclude xtx. Add none_of: [xtx] to 'base'." in [r.message for r in found]


def test_bans_and_unrelated_rules_are_clean(spark):
    clean = rules(spark, ("base", ["7900"], ["XTX"]), ("variant", ["7900", "xtx"], []), ("other", ["6600", "xt"], []), ("empty", [], []))
    assert quality.variant_swallowing(clean).count() == 0
    assert [r.product_id for r in quality.unmatchable_rules(clean).collect()] == ["empty"]


def test_preview_scans_the_newest_and_caps_steals(spark):
    results = spark.range(40).selectExpr(
        "CAST(id AS STRING) AS listing_id", "IF(id = 0, 'excluded', 'rule') AS match_kind",
        "IF(id % 2 = 0, 'rtx 4070 ti', 'rtx 4070') AS normalized_title", "IF(id % 4 = 0, 'own', IF(id % 4 = 1, NULL, 'other')) AS product_id",
        "timestamp_seconds(id) AS updated_at",
    )
    listings = results.select("listing_id", F.upper("normalized_title").alias("title"), F.lit(100).alias("price_cents"))
    scanned, matches = quality.preview_rule(results, listings, ["4070"], [], ["ti"], "own", scan_limit=30)
    assert quality.preview_summary(scanned, matches).first().asDict() == {"matched": 15, "steal_count": 8, "scanned": 30}
    _, every = quality.preview_rule(results, listings, ["4070"], [], [], "own", scan_limit=None)
    assert quality.preview_summary(results, every).first().steal_count > 10
    shown = quality.preview_examples(every, 5).collect()
    assert len(shown) == 10 and {r.listing_id for r in shown if r.steals} == {"39", "38", "35", "34", "31"}


def test_a_rule_without_needles_matches_nothing(spark):
    results = spark.createDataFrame([("1", "rule", "x", None)], "listing_id string, match_kind string, normalized_title string, product_id string").withColumn("updated_at", F.current_timestamp())
    listings = spark.createDataFrame([("1", "x", 1)], "listing_id string, title string, price_cents bigint")
    assert quality.preview_rule(results, listings, [" "], [], ["y"])[1].count() == 0


def test_perf_order(gpu, spark):
    pairs = spark.createDataFrame(
        [("rtx_5090", "rtx_5080"), ("rx_9070_xt", "rx_9070"), ("rtx_3070", "rtx_3080_10"), ("rtx_2080", "rtx_2070")], "faster_id string, slower_id string"
    )
    wrong = quality.order_violations(gpu.products, pairs, "perf_index").collect()
    assert sorted(r.faster_id for r in wrong) == ["rtx_2080", "rtx_3070"]
