"""The whole run over order lines as sightings: a line seen again is a re-sighting of its ad."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from checks import check
from checks.classifying import (
    FUZZY_SQL, MATCH_SQL, PART_TEXT, PART_TITLE, RESULT_SQL, RULES_SQL, part_catalog,
)
from checks.markets import DEAL_SQL, RANK_SQL
from checks.tables import AS_OF, COMPARABLE_SQL, PARAMS, SAMPLES_SQL, SPREAD_SQL, as_of, micros, read, rounded, with_ctes
from fairtag import schemas
from fairtag.operators import classify as cls
from fairtag.operators import market
from fairtag.plans import cycle

RUN_PARAMS = replace(PARAMS, cycle_minutes=60 * 24 * 100)


def line_sightings(spark, sf):
    items = read(spark, sf, "lineitem")
    return items.join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        "'lines' AS site", "concat_ws('-', l_orderkey, l_linenumber) AS site_listing_id", "'parts' AS category",
        "concat('https://lines.example/', l_orderkey) AS url", f"{PART_TITLE.format(cat='||')} AS title",
        f"{PART_TEXT} AS description", "IF(l_tax = 0, NULL, CAST(floor(l_extendedprice / l_quantity * 100) AS BIGINT)) AS price_cents",
        "'EUR' AS currency", "concat('City ', l_suppkey % 10) AS location", "'u' AS seller_id",
        "l_returnflag = 'R' AS seller_is_pro", "l_linenumber AS photo_count", "CAST(NULL AS TIMESTAMP) AS posted_at",
        "CAST(NULL AS STRING) AS raw", "CAST(l_shipdate AS TIMESTAMP) AS batch_ts",
        "l_partkey * 16777216 + l_suppkey AS batch_pos",
    )


GRACE = RUN_PARAMS.grace_hours
LINES_SQL = f"""
sg AS (
  SELECT l_orderkey || '-' || l_linenumber AS sid, {PART_TITLE.format(cat='||')} AS title, {PART_TEXT} AS description,
    CASE WHEN l_tax <> 0 THEN CAST(floor(l_extendedprice / l_quantity * 100) AS BIGINT) END AS price_cents, l_suppkey,
    l_returnflag, l_linenumber, l_shipdate, (l_shipdate, l_partkey * 16777216 + l_suppkey) AS seq
  FROM lineitem JOIN part ON l_partkey = p_partkey),
fl AS (
  SELECT 'lines/' || sid AS listing_id, count(*) AS seen_count, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen,
    arg_max(title, seq) AS title, coalesce(arg_max(description, seq) FILTER (WHERE description <> ''), '') AS description,
    last(price_cents ORDER BY seq) AS price_cents, arg_min(price_cents, seq) FILTER (WHERE price_cents IS NOT NULL) AS first_price_cents,
    max(l_linenumber) AS photo_count, arg_min('City ' || (l_suppkey % 10), seq) AS location, arg_min(l_returnflag = 'R', seq) AS seller_is_pro
  FROM sg GROUP BY sid),
ad AS (SELECT listing_id, title, description, price_cents, last_seen FROM fl)
"""
LINE_MARKET_SQL = f"""
m AS (
  SELECT fl.*, res.product_id, res.match_kind, fl.first_seen AS discovered_at,
    CASE WHEN fl.last_seen < TIMESTAMP '{AS_OF}' - INTERVAL {GRACE} HOURS THEN fl.last_seen END AS disappeared_at,
    CAST(round_even(fl.price_cents * (1 + adjust_pct / 1e2), 0) AS BIGINT) AS adjusted_cents
  FROM fl JOIN res USING (listing_id)),
p AS (SELECT product_id, product_id AS label FROM prod),
r AS (SELECT NULL::VARCHAR AS product_id, NULL::DOUBLE AS retail_eur WHERE false)
"""
RUN_SQL = (
    LINES_SQL, RULES_SQL, MATCH_SQL, FUZZY_SQL, RESULT_SQL, LINE_MARKET_SQL, COMPARABLE_SQL, SAMPLES_SQL, SPREAD_SQL,
    RANK_SQL, DEAL_SQL,
)


DEALS_SQL = with_ctes(*RUN_SQL, select="""
SELECT listing_id, product_label, price_eur, round(p50, 6) AS median_eur, round(pct_rank, 9) AS pct_rank, round(price_drop_pct, 6) AS price_drop_pct, score
FROM g ORDER BY score DESC, listing_id LIMIT 50""")


def run(spark, sightings, moment, catalog, before=None):
    nothing = spark.createDataFrame([], schemas.NORMALIZED)
    retail = spark.createDataFrame([], schemas.RETAIL_PRICE)
    log = spark.createDataFrame([], "listing_id string, alert_cents bigint, score double")
    if before is None:
        return cycle.run_cycle(sightings, nothing, catalog, retail, log, moment, ["chat"], RUN_PARAMS)
    return cycle.run_cycle(
        sightings, before.normalized, catalog, retail, before.alerted, moment, ["chat"], RUN_PARAMS,
        prior=before.folded, queue=before.unmatched,
    )


def unpriced_catalog(spark, sf):
    catalog = part_catalog(spark, sf)
    return replace(catalog, products=catalog.products.withColumn("retail_fallback_eur", F.lit(0.0)))


def deal_columns(found):
    return found.deals.select(
        "listing_id", "product_label", "price_eur", rounded("median_eur"), rounded("pct_rank", 9), rounded("price_drop_pct"), "score"
    )


@check("cyc_full_cycle_deals", DEALS_SQL)
def full_cycle(spark, sf):
    return deal_columns(run(spark, line_sightings(spark, sf), as_of(), unpriced_catalog(spark, sf)))


# Two runs: the sightings before a day, then the others on top of what the first run left.
HALF = "1996-01-01"


def two_runs(spark, sf):
    lines, catalog = line_sightings(spark, sf), unpriced_catalog(spark, sf)
    first = run(spark, lines.filter(F.col("batch_ts") < HALF), F.lit(HALF).cast("timestamp"), catalog)
    return run(spark, lines.filter(F.col("batch_ts") >= HALF), as_of(), catalog, first)


@check("cyc_two_cycles", DEALS_SQL)
def two_cycles(spark, sf):
    return deal_columns(two_runs(spark, sf))


@check(
    "cyc_two_cycles_listings",
    with_ctes(*RUN_SQL, select=" SELECT listing_id, title, seen_count, epoch_us(last_seen) AS last_seen, price_cents FROM fl"),
)
def two_cycles_listings(spark, sf):
    return two_runs(spark, sf).listings.select("listing_id", "title", "seen_count", micros("last_seen"), "price_cents")


# Joins of the classification with the listings.



@check(
    "joi_1_listing_classification",
    with_ctes(LINES_SQL, RULES_SQL, MATCH_SQL, FUZZY_SQL, RESULT_SQL, select="""
SELECT fl.listing_id, fl.title, fl.seen_count, res.match_kind, res.product_id FROM fl JOIN res USING (listing_id)"""),
)
def joi_1(spark, sf):
    from fairtag.operators import fold

    listings = fold.fold(line_sightings(spark, sf), as_of(), RUN_PARAMS)
    results = cls.classify(listings, part_catalog(spark, sf)).withColumn("updated_at", as_of())
    return market.classified_listings(listings, results).select(
        "listing_id", "title", "seen_count", "match_kind", "product_id"
    )


@check(
    "joi_2_work_list",
    """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS listing_id FROM lineitem
WHERE l_orderkey % 3 = 0 OR l_orderkey % 3 = 1 AND l_linenumber > 4 OR l_orderkey % 3 = 2 AND l_shipdate > TIMESTAMP '1998-06-01'""",
)
def joi_2(spark, sf):
    # Of every three orders one has no result, one partly results of an old catalog, one results from a fixed day.
    items = read(spark, sf, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS listing_id", "'parts' AS category",
        "CAST(l_shipdate AS TIMESTAMP) AS last_seen", "l_orderkey", "l_linenumber",
    )
    results = items.filter("l_orderkey % 3 <> 0").selectExpr(
        "listing_id", "IF(l_orderkey % 3 = 1 AND l_linenumber > 4, 'v0', 'v1') AS catalog_version",
        "IF(l_orderkey % 3 = 1, TIMESTAMP '2030-01-01', TIMESTAMP '1998-06-01') AS updated_at",
    )
    return cls.stale(items, results, part_catalog(spark, sf)).select("listing_id")
