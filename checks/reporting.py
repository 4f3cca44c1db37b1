"""Summary reports over the part market and the unmatched-title queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check
from checks.alerting import alert_log
from checks.classifying import UNMATCHED, queue
from checks.markets import BASE, BINS_SQL, bins, current, spread
from checks.tables import (
    MARKET_SQL, PARAMS, PRODUCTS_SQL, RETAIL_SQL, SPREAD_SQL, as_of, classified, micros, products, r6, with_ctes,
)
from fairtag.functions.numbering import numbered
from fairtag.operators import deals, feed, reports

GONE = "disappeared_at IS NOT NULL"
SOLD = f"{GONE} AND seen_count > 1 AND disappeared_at - first_seen < INTERVAL {PARAMS.sold_hours} HOURS"


@check("agg_1_listing_totals", with_ctes(MARKET_SQL, select=f" SELECT category, count(*) AS total, count(*) FILTER (WHERE NOT ({GONE})) AS active FROM m GROUP BY category"))
def agg_1(spark, sf):
    return reports.listing_totals(classified(spark, sf))


@check(
    "agg_2_status",
    with_ctes(MARKET_SQL, select=f"""
SELECT category, count(*) AS total, count(*) FILTER (WHERE NOT ({GONE})) AS active, count(*) FILTER (WHERE {GONE}) AS disappeared,
  count(*) FILTER (WHERE {SOLD}) AS sold_proxy, strftime(max(last_seen), '%d %b %H:%M') AS last_seen, strftime(min(first_seen), '%d %b %Y') AS oldest
FROM m GROUP BY category"""),
)
def agg_2(spark, sf):
    return reports.status(classified(spark, sf), PARAMS)


@check(
    "agg_3_coverage",
    with_ctes(MARKET_SQL, select="""
, k AS (SELECT count(*) FILTER (WHERE match_kind = 'rule') AS rule, count(*) FILTER (WHERE match_kind = 'fuzzy') AS fuzzy,
  count(*) FILTER (WHERE match_kind = 'none') AS none, count(*) FILTER (WHERE match_kind = 'excluded') AS excluded FROM m)
SELECT *, round((rule + fuzzy) / (rule + fuzzy + none) * 100, 6) AS coverage_pct FROM k"""),
)
def agg_3(spark, sf):
    return reports.coverage(classified(spark, sf)).select("rule", "fuzzy", "none", "excluded", r6("coverage_pct"))


@check("agg_4_product_counts", with_ctes(MARKET_SQL, select=" SELECT product_id, count(*) AS n FROM m WHERE product_id IS NOT NULL GROUP BY product_id"))
def agg_4(spark, sf):
    return reports.product_counts(classified(spark, sf)).select("product_id", "n")


@check(
    "agg_5_unresolved_queue",
    with_ctes(*UNMATCHED, select=" SELECT title_hash, occurrences FROM q WHERE occurrences % 5 <> 0 ORDER BY occurrences DESC, title_hash LIMIT 300"),
)
def agg_5(spark, sf):
    marked = queue(spark, sf).withColumn("resolved", F.expr("occurrences % 5 = 0"))
    return feed.unresolved(marked, 300).select("title_hash", "occurrences")


@check(
    "snk_1_unmatched_export",
    with_ctes(*UNMATCHED, select=" SELECT sample_title AS title, CAST(occurrences AS VARCHAR) AS occurrences FROM q ORDER BY q.occurrences DESC, title_hash LIMIT 200"),
)
def snk_1(spark, sf):
    from fairtag.session import scratch

    path = f"{scratch(spark)}/unmatched"
    feed.export_unmatched(queue(spark, sf), "parts", path)
    return spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path).select("title", "occurrences")


OVERVIEW_SQL = """
ov AS (SELECT p.product_id, p.pos, p.label, coalesce(n, 0) AS n, coalesce(p50, 0e0) AS p50, retail_eur,
  CASE WHEN retail_eur <> 0 AND p50 <> 0 THEN p50 / retail_eur END AS ratio
  FROM p LEFT JOIN d USING (product_id) LEFT JOIN r USING (product_id))
"""
OVERVIEW = (*BASE, SPREAD_SQL, PRODUCTS_SQL, RETAIL_SQL, OVERVIEW_SQL)


def overview(spark, sf):
    return reports.product_overview(products(spark, sf), spread(spark, sf), current(spark, sf))


@check(
    "agg_6_product_overview",
    with_ctes(*OVERVIEW, select="""
SELECT product_id, label, n, round(p50, 6) AS p50, round(retail_eur, 6) AS retail_eur, round(ratio, 6) AS ratio FROM ov"""),
)
def agg_6(spark, sf):
    return overview(spark, sf).select("product_id", "label", "n", r6("p50"), r6("retail_eur"), r6("ratio"))


@check(
    "agg_6_best_covered_products",
    with_ctes(*OVERVIEW, select=" SELECT product_id, n, row_number() OVER (ORDER BY n = 0, n DESC, pos) AS place FROM ov"),
)
def agg_6_order(spark, sf):
    rows = numbered(overview(spark, sf), *reports.overview_keys())
    return rows.select("product_id", "n", (F.col("place") + 1).alias("place"))


@check(
    "agg_7_product_detail",
    with_ctes(*OVERVIEW, BINS_SQL, select="""
, lv AS (SELECT product_id, min(adjusted_cents) / 1e2 AS cheapest_live, count(*) AS n_live FROM c WHERE disappeared_at IS NULL GROUP BY product_id),
hs AS (SELECT product_id, count(*) AS n_bins, string_agg(CAST(count AS VARCHAR), ',' ORDER BY bin) AS counts FROM hist GROUP BY product_id)
SELECT product_id, n, round(ratio, 6) AS ratio, cheapest_live, n_live, n_bins, counts FROM ov LEFT JOIN lv USING (product_id) LEFT JOIN hs USING (product_id)"""),
)
def agg_7(spark, sf):
    live = deals.active_listings(classified(spark, sf), as_of(), params=PARAMS)
    return reports.product_detail(overview(spark, sf), live, bins(spark, sf)).select(
        "product_id", "n", r6("ratio"), "cheapest_live", "n_live",
        F.when(F.col("histogram").isNotNull(), F.size("histogram")).alias("n_bins"),
        F.array_join(F.transform("histogram", lambda b: b["count"].cast("string")), ",").alias("counts"),
    )


@check(
    "sta_11_histogram_table",
    with_ctes(*BASE, BINS_SQL, select="""
SELECT product_id, bin, '€' || format('{:,d}', CAST(round_even(lo, 0) AS BIGINT)) || ' – €' || format('{:,d}', CAST(round_even(hi, 0) AS BIGINT)) AS price_range, count FROM hist"""),
)
def sta_11(spark, sf):
    return reports.histogram_table(bins(spark, sf)).select("product_id", "bin", "price_range", "count")


@check("agg_8_health", with_ctes(MARKET_SQL, select=" SELECT count(*) AS listings, epoch_us(max(last_seen)) AS last_seen FROM m"))
def agg_8(spark, sf):
    return reports.health(classified(spark, sf)).select("listings", micros("last_seen"))


@check("agg_9_alert_count", with_ctes(MARKET_SQL, select=" SELECT count(*) AS alerted FROM m WHERE price_cents IS NOT NULL AND seen_count IN (3, 4)"))
def agg_9(spark, sf):
    return reports.alert_count(alert_log(spark, sf))


@check("agg_5_unmatched_count", with_ctes(*UNMATCHED, select=" SELECT count(*) FILTER (WHERE occurrences % 5 <> 0) AS n FROM q"))
def agg_5_count(spark, sf):
    marked = queue(spark, sf).withColumn("resolved", F.expr("occurrences % 5 = 0"))
    return reports.unmatched_count(marked).select("n")


# Acknowledgements: shipments acknowledge their return class, one class never did.
@check(
    "dea_13_acknowledgement",
    """
WITH a AS (SELECT l_returnflag AS category, max(l_shipdate) AS ack FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL)
SELECT DISTINCT l_returnflag AS category, epoch_us(CASE WHEN l_returnflag = 'A' THEN TIMESTAMP '2030-01-01' ELSE coalesce(ack, TIMESTAMP '2030-01-01') END) AS seen_at
FROM lineitem LEFT JOIN a ON a.category = l_returnflag""",
)
def dea_13(spark, sf):
    from checks.tables import read

    now = F.lit("2030-01-01").cast("timestamp")
    items = read(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("category"), F.col("l_shipdate").cast("timestamp").alias("ack_ts")
    )
    log = deals.mark_seen(items.filter("category <> 'N'"), "A", now)
    return deals.acknowledged_at(log, items.select("category").distinct(), now).select("category", micros("seen_at"))
