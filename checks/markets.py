"""Distributions, ranks, deals, comparison and retail baselines over the part market."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check
from checks.tables import (
    AS_OF, COMPARABLE_SQL, MARKET_SQL, PARAMS, PRODUCTS_SQL, RETAIL_PARAMS, RETAIL_SQL, SAMPLES_SQL, SPREAD_SQL,
    as_of, classified, micros, products, r6, retail_prices, rounded, with_ctes,
)
from fairtag.functions.numbering import numbered
from fairtag.operators import compare, deals, market, retail
from fairtag.operators.market import PRODUCT

BASE = (MARKET_SQL, COMPARABLE_SQL, SAMPLES_SQL)
QS = ["p10", "p25", "p50", "p75", "p90"]
R6 = ", ".join(f"round({q}, 6) AS {q}" for q in QS)


def samples(spark, sf):
    return market.samples(classified(spark, sf), as_of(), PARAMS)


def spread(spark, sf):
    return market.distributions(samples(spark, sf), products(spark, sf), PARAMS)


def current(spark, sf):
    return retail.current_retail(retail_prices(spark, sf), products(spark, sf), as_of(), RETAIL_PARAMS)


# Sampling and distributions


@check("sta_1_sample_selection", with_ctes(*BASE, select=" SELECT product_id, listing_id, adjusted_cents FROM s"))
def sta_1(spark, sf):
    return samples(spark, sf).select("product_id", "listing_id", "adjusted_cents")


@check("sta_2_sold_proxy_weight", with_ctes(*BASE, select=" SELECT listing_id, sold, w AS weight FROM s"))
def sta_2(spark, sf):
    return samples(spark, sf).select("listing_id", "sold", "weight")


@check("sta_3_weighted_percentile", with_ctes(*BASE, SPREAD_SQL, select=f" SELECT product_id, {R6} FROM d"))
def sta_3(spark, sf):
    climbed = market.climb(market.sample_ladder(samples(spark, sf)))
    return market.distributions_from(climbed, PARAMS).select("product_id", *[r6(q) for q in QS])


@check("sta_4_weighted_mean", with_ctes(*BASE, SPREAD_SQL, select=" SELECT product_id, round(mean, 6) AS mean FROM d"))
def sta_4(spark, sf):
    climbed = market.climb(market.sample_ladder(samples(spark, sf)))
    return market.distributions_from(climbed, PARAMS).select("product_id", r6("mean"))


_ALL = "p LEFT JOIN d USING (product_id)"


@check(
    "sta_5_distribution_per_product",
    with_ctes(*BASE, SPREAD_SQL, PRODUCTS_SQL, select=f"""
SELECT product_id, coalesce(n, 0) AS n, coalesce(n_sold_proxy, 0) AS n_sold_proxy,
  {", ".join(f"round(coalesce({q}, 0e0), 6) AS {q}" for q in QS)}, round(coalesce(mean, 0e0), 6) AS mean FROM {_ALL}"""),
)
def sta_5(spark, sf):
    return spread(spark, sf).select("product_id", "n", "n_sold_proxy", *[r6(q) for q in QS], r6("mean"))


@check(
    "sta_5_distribution_values",
    with_ctes(*BASE, select=" SELECT product_id, v AS value, count(*) AS n FROM s GROUP BY product_id, v"),
)
def sta_5_values(spark, sf):
    return market.price_counts(samples(spark, sf)).select("product_id", "value", "n")


@check(
    "sta_6_confidence_tier",
    with_ctes(*BASE, SPREAD_SQL, PRODUCTS_SQL, select=f" SELECT product_id, coalesce(confidence, 'none') AS confidence FROM {_ALL}"),
)
def sta_6(spark, sf):
    return spread(spark, sf).select("product_id", "confidence")


@check(
    "sta_7_trustworthy_iqr",
    with_ctes(*BASE, SPREAD_SQL, PRODUCTS_SQL, select=f"""
SELECT product_id, coalesce(n, 0) >= 8 AS trustworthy, round(coalesce(p75 - p25, 0e0), 6) AS iqr FROM {_ALL}"""),
)
def sta_7(spark, sf):
    return spread(spark, sf).select("product_id", "trustworthy", r6("iqr"))


# The rank by its definition: every live listing against every sample of its product.
RANK_SQL = """
live AS (SELECT * FROM c WHERE disappeared_at IS NULL),
k AS (
  SELECT live.listing_id, coalesce((sum(CASE WHEN s.adjusted_cents < live.adjusted_cents THEN w ELSE 0e0 END)
      + sum(CASE WHEN s.adjusted_cents = live.adjusted_cents THEN w ELSE 0e0 END) / 2) / sum(w), 0.5e0) AS pct_rank
  FROM live LEFT JOIN s ON s.product_id = live.product_id GROUP BY live.listing_id)
"""


@check("sta_8_mid_rank", with_ctes(*BASE, RANK_SQL, select=" SELECT listing_id, round(pct_rank, 9) AS pct_rank FROM k"))
def sta_8(spark, sf):
    facts = classified(spark, sf)
    live = deals.active(facts, as_of()).select(*PRODUCT, "adjusted_cents", "listing_id")
    ranked = market.rank_prices(market.samples(facts, as_of(), PARAMS), live, PARAMS)
    return ranked.select("listing_id", rounded("pct_rank", 9))


BINS_SQL = """
hb AS (
  SELECT product_id, min(v) AS low, max(v) AS high,
    CASE WHEN max(v) <= min(v) THEN 1 ELSE greatest(5, least(14, greatest(5, count(*) // 3))) END AS bins
  FROM s GROUP BY product_id),
he AS (
  SELECT *, (high - low) / bins AS width, unnest(range(bins)) AS bin FROM hb),
hc AS (
  SELECT s.product_id, CASE WHEN high <= low THEN 0 ELSE least(bins - 1, CAST(floor((v - low) / ((high - low) / bins)) AS BIGINT)) END AS bin, count(*) AS count
  FROM s JOIN hb USING (product_id) GROUP BY 1, 2),
hist AS (
  SELECT he.product_id, he.bin, low + he.bin * width AS lo,
    CASE WHEN width = 0 THEN low ELSE low + (he.bin + 1) * width END AS hi, coalesce(hc.count, 0) AS count
  FROM he LEFT JOIN hc ON he.product_id = hc.product_id AND he.bin = hc.bin)
"""


def bins(spark, sf):
    return market.histogram(market.price_counts(samples(spark, sf)), PRODUCT, "value", "n")


@check(
    "sta_9_histogram",
    with_ctes(*BASE, BINS_SQL, select=" SELECT product_id, bin, round(lo, 6) AS lo, round(hi, 6) AS hi, count FROM hist"),
)
def sta_9(spark, sf):
    return bins(spark, sf).select("product_id", "bin", r6("lo"), r6("hi"), "count")


@check(
    "sta_10_market_position",
    with_ctes(*BASE, SPREAD_SQL, select="""
SELECT listing_id, round(greatest(0e0, least(1e0, (c.adjusted_cents / 1e2 - p10) / (p90 - p10))), 9) AS value,
  round(greatest(0e0, least(1e0, (p25 - p10) / (p90 - p10))), 9) AS p25, round(greatest(0e0, least(1e0, (p75 - p10) / (p90 - p10))), 9) AS p75
FROM c JOIN d USING (product_id) WHERE disappeared_at IS NULL AND p90 > p10"""),
)
def sta_10(spark, sf):
    facts = classified(spark, sf)
    quotes = deals.live_market(facts, as_of(), PARAMS).drop("n")
    at = market.market_position(F.col("adjusted_cents") / 100.0, F.col("p10"), F.col("p25"), F.col("p75"), F.col("p90"))
    return (
        deals.active(facts, as_of()).join(quotes, [*PRODUCT, "adjusted_cents"]).withColumn("at", at).filter("at is not null")
        .select("listing_id", *[rounded(f"at.{c}", 9) for c in ("value", "p25", "p75")])
    )


# Deals

RATIO = "CASE WHEN retail_eur <> 0 THEN adjusted_eur / retail_eur END"
DEAL_SQL = f"""
a AS (
  SELECT c.*, pct_rank, retail_eur, p.label AS product_label, d.n, d.n_sold_proxy, d.confidence, p10, p25, p50, p75, p90,
    coalesce(price_cents, 0) / 1e2 AS price_eur, adjusted_cents / 1e2 AS adjusted_eur,
    coalesce(nullif(first_price_cents, 0), price_cents, 0) / 1e2 AS first_eur,
    (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(first_seen)) / 86400e6 AS days_listed
  FROM c JOIN k USING (listing_id) JOIN p USING (product_id) JOIN d USING (product_id) LEFT JOIN r USING (product_id)),
b AS (
  SELECT *, {RATIO} AS retail_ratio,
    CASE WHEN first_eur > 0 THEN (first_eur - price_eur) / first_eur * 100 ELSE 0e0 END AS price_drop_pct FROM a),
e AS (
  SELECT *, greatest(0e0, (0.5e0 - pct_rank) / 0.5e0) * 55
    + CASE WHEN retail_ratio IS NULL THEN 0e0 ELSE greatest(0e0, least(1e0, (0.85e0 - retail_ratio) / 0.35e0)) * 30 END
    + greatest(0e0, least(1e0, price_drop_pct / 20e0)) * 10
    + CASE WHEN days_listed <= 2 THEN 5e0 ELSE 0e0 END AS score_raw FROM b),
g AS (SELECT *, round_even(score_raw * 10, 0) / 10 AS score FROM e WHERE pct_rank <= 0.2e0 AND confidence <> 'none')
"""
DEALS = (*BASE, SPREAD_SQL, RANK_SQL, PRODUCTS_SQL, RETAIL_SQL, DEAL_SQL)


def scored(spark, sf, **options):
    options = {"limit": None, **options}
    return deals.find_deals(classified(spark, sf), products(spark, sf), current(spark, sf), as_of(), PARAMS, **options)


@check(
    "dea_1_active_listings",
    with_ctes(*BASE, select=f"""
SELECT listing_id, product_id, first_price_cents, epoch_us(discovered_at) AS discovered_at, array_to_string(modifiers, ',') AS modifiers,
  round((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(first_seen)) / 86400e6, 6) AS days_listed FROM c WHERE disappeared_at IS NULL"""),
)
def dea_1(spark, sf):
    return deals.active(classified(spark, sf), as_of()).select(
        "listing_id", "product_id", "first_price_cents", micros("discovered_at"),
        F.array_join("modifiers", ",").alias("modifiers"), r6("days_listed"),
    )


@check(
    "dea_2_candidate_filters",
    with_ctes(*DEALS, select="""
SELECT listing_id, round(pct_rank, 9) AS pct_rank, price_eur, location FROM e
WHERE pct_rank <= 0.35e0 AND confidence IN ('medium', 'high') AND price_eur <= 1500 AND contains(lower(location), 'city 3')
  AND round_even(score_raw * 10, 0) / 10 >= 20"""),
)
def dea_2(spark, sf):
    return scored(
        spark, sf, max_percentile=0.35, min_confidence="medium", max_price=1500.0, location="CITY 3", min_score=20.0
    ).select("listing_id", rounded("pct_rank", 9), "price_eur", "location")


@check(
    "dea_3_retail_ratio_price_drop",
    with_ctes(*DEALS, select=" SELECT listing_id, round(retail_ratio, 6) AS retail_ratio, round(price_drop_pct, 6) AS price_drop_pct FROM g"),
)
def dea_3(spark, sf):
    return scored(spark, sf).select("listing_id", r6("retail_ratio"), r6("price_drop_pct"))


@check("dea_4_score", with_ctes(*DEALS, select=" SELECT listing_id, round(score_raw, 6) AS score_raw, score FROM g"))
def dea_4(spark, sf):
    return scored(spark, sf).select("listing_id", r6("score_raw"), "score")


def _w(x: str) -> str:
    return f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"


REASONS_SQL = f"""list_filter([
  CASE WHEN pct_rank <= 0.1e0 THEN 'cheapest ' || {_w('pct_rank * 100')} || '% of what''s listed'
    WHEN pct_rank <= 0.25e0 THEN 'bottom ' || {_w('pct_rank * 100')} || '% of the market' END,
  CASE WHEN retail_ratio < 0.7e0 THEN {_w('retail_ratio * 100')} || '% of retail' END,
  CASE WHEN price_drop_pct >= 5 THEN 'price cut ' || {_w('price_drop_pct')} || '% since listed' END,
  CASE WHEN days_listed <= 2 THEN 'posted in the last 48h' END,
  CASE WHEN n_sold_proxy >= 3 THEN n_sold_proxy || ' comparable sales observed' END], lambda x: x IS NOT NULL)"""
CAUTIONS_SQL = f"""list_filter([
  CASE WHEN retail_ratio > 0.95e0 THEN 'barely cheaper than buying new' END,
  CASE WHEN days_listed >= 45 THEN 'listed ' || {_w('days_listed')} || ' days and still unsold' END,
  CASE WHEN confidence IN ('low', 'none') THEN 'thin data — only ' || n || ' comparable listings' END,
  CASE WHEN p10 > 0 AND adjusted_eur < p10 * 0.6e0 THEN 'far below every comparable listing — verify carefully' END,
  CASE WHEN coalesce(photo_count, 0) <= 1 THEN 'one photo or fewer' END], lambda x: x IS NOT NULL)"""


@check("dea_5_reasons", with_ctes(*DEALS, select=f" SELECT listing_id, array_to_string({REASONS_SQL}, '|') AS reasons FROM g"))
def dea_5(spark, sf):
    return scored(spark, sf).select("listing_id", F.array_join("reasons", "|").alias("reasons"))


@check("dea_6_cautions", with_ctes(*DEALS, select=f" SELECT listing_id, array_to_string({CAUTIONS_SQL}, '|') AS cautions FROM g"))
def dea_6(spark, sf):
    return scored(spark, sf).select("listing_id", F.array_join("cautions", "|").alias("cautions"))


@check(
    "dea_7_below_median_saving",
    with_ctes(*DEALS, select="""
SELECT listing_id, round(CASE WHEN p50 > 0 THEN (p50 - adjusted_eur) / p50 * 100 ELSE 0e0 END, 6) AS below_median_pct,
  round(greatest(0e0, p50 - adjusted_eur), 6) AS saving_eur FROM g"""),
)
def dea_7(spark, sf):
    return scored(spark, sf).select("listing_id", r6("below_median_pct"), r6("saving_eur"))


SEEN_AT = "1998-03-01"
SEEN_SQL = f"discovered_at > TIMESTAMP '{SEEN_AT}'"


def seen_at():
    return F.lit(SEEN_AT).cast("timestamp")


@check("dea_8_new_flag", with_ctes(*DEALS, select=f" SELECT listing_id, {SEEN_SQL} AS is_new FROM g"))
def dea_8(spark, sf):
    return scored(spark, sf, seen_at=seen_at()).select("listing_id", "is_new")


@check(
    "dea_9_top_deals",
    with_ctes(*DEALS, select=" SELECT listing_id, product_label, score, price_eur FROM g ORDER BY score DESC, listing_id LIMIT 50"),
)
def dea_9(spark, sf):
    return scored(spark, sf, limit=50).select("listing_id", "product_label", "score", "price_eur")


@check(
    "dea_10_product_live_view",
    with_ctes(*BASE, SPREAD_SQL, RANK_SQL, select="""
SELECT listing_id, product_id, adjusted_cents / 1e2 AS adjusted_eur, round(pct_rank, 9) AS pct_rank,
  round(CASE WHEN p50 > 0 THEN (p50 - adjusted_cents / 1e2) / p50 * 100 ELSE 0e0 END, 6) AS vs_median
FROM live JOIN k USING (listing_id) LEFT JOIN d USING (product_id)"""),
)
def dea_10(spark, sf):
    return deals.active_listings(classified(spark, sf), as_of(), params=PARAMS).select(
        "listing_id", "product_id", "adjusted_eur", rounded("pct_rank", 9), r6("vs_median")
    )


# Every listing of the city is searched for, whatever its match kind.
@check(
    "dea_11_search_pricing",
    with_ctes(*BASE, SPREAD_SQL, PRODUCTS_SQL, select="""
, h AS (SELECT *, coalesce(adjusted_cents, 0) AS pc FROM m WHERE contains(location, 'City 4')),
hk AS (SELECT h.listing_id, coalesce((sum(CASE WHEN s.adjusted_cents < pc THEN w ELSE 0e0 END)
      + sum(CASE WHEN s.adjusted_cents = pc THEN w ELSE 0e0 END) / 2) / sum(w), 0.5e0) AS pct_rank
  FROM h LEFT JOIN s ON s.product_id = h.product_id WHERE h.product_id IS NOT NULL GROUP BY h.listing_id)
SELECT listing_id, match_kind, product_label, pc / 1e2 AS adjusted_eur, round(hk.pct_rank, 9) AS pct_rank,
  round(coalesce(p50, 0e0), 6) AS median_eur, coalesce(n, 0) AS sample_size, coalesce(confidence, 'none') AS confidence,
  round(CASE WHEN p50 <> 0 THEN (p50 - pc / 1e2) / p50 * 100 END, 6) AS vs_median
FROM h LEFT JOIN hk USING (listing_id) LEFT JOIN (SELECT product_id, label AS product_label FROM p) USING (product_id) LEFT JOIN d USING (product_id)"""),
)
def dea_11(spark, sf):
    facts = classified(spark, sf)
    wanted = facts.filter(F.contains("location", F.lit("City 4"))).select("site_listing_id")
    return deals.price_search(wanted, facts, products(spark, sf), as_of(), PARAMS).select(
        "listing_id", "match_kind", "product_label", "adjusted_eur", rounded("pct_rank", 9),
        r6("median_eur"), "sample_size", "confidence", r6("vs_median"),
    )


@check(
    "dea_12_new_deal_count",
    with_ctes(*DEALS, select=f"""
SELECT count(*) FILTER (WHERE {SEEN_SQL}) AS new_deals FROM (SELECT * FROM g ORDER BY score DESC, listing_id LIMIT 500)"""),
)
def dea_12(spark, sf):
    return deals.new_deal_count(scored(spark, sf, seen_at=seen_at()), 500)


# Comparison

BEST_SQL = """
best AS (
  SELECT product_id, min(adjusted_cents) / 1e2 AS best_active_eur, arg_min(url, (adjusted_cents, listing_id)) AS best_active_url
  FROM c WHERE disappeared_at IS NULL GROUP BY product_id)
"""


def _compare_sql(price: str, where: str = "true") -> str:
    return f"""
v0 AS (
  SELECT p.*, coalesce(n, 0) AS n, coalesce(p25, 0e0) AS p25, coalesce(p50, 0e0) AS p50, retail_eur, best_active_eur, best_active_url
  FROM p LEFT JOIN d USING (product_id) LEFT JOIN r USING (product_id) LEFT JOIN best USING (product_id) WHERE {where}),
v1 AS (SELECT *, coalesce({price}, 0e0) AS basis_price, CASE WHEN coalesce({price}, 0e0) > 0 AND size > 0 THEN coalesce({price}, 0e0) / size END AS cost_per_point FROM v0),
v AS (SELECT *, coalesce(round_even(min(cost_per_point) OVER () / cost_per_point * 100 * 10, 0) / 10, 0e0) AS value_index,
  CASE WHEN retail_eur > 0 THEN p50 / retail_eur END AS used_vs_retail FROM v1)
"""


COMPARE = (*BASE, SPREAD_SQL, PRODUCTS_SQL, RETAIL_SQL, BEST_SQL)


def compared(spark, sf, **options):
    return compare.compare(
        products(spark, sf), spread(spark, sf), current(spark, sf), compare.best_active(classified(spark, sf)), "size", **options
    )


@check("cmp_1_best_active", with_ctes(MARKET_SQL, COMPARABLE_SQL, BEST_SQL, select=" SELECT * FROM best"))
def cmp_1(spark, sf):
    return compare.best_active(classified(spark, sf)).drop("category")


@check(
    "cmp_2_attribute_filters",
    with_ctes(PRODUCTS_SQL, select=" SELECT product_id FROM p WHERE coalesce(size, 0) >= 10 AND coalesce(size, 'inf'::DOUBLE) <= 40"),
)
def cmp_2(spark, sf):
    keep = compare.attribute_filter({"size": 10.0}, {"size": 40.0})
    return products(spark, sf).filter(keep).select("product_id")


for _basis, _price in (("p25", "p25"), ("median", "p50"), ("best", "best_active_eur"), ("retail", "retail_eur")):

    @check(
        f"cmp_3_basis_{_basis}",
        with_ctes(*COMPARE, _compare_sql(_price), select="""
SELECT product_id, round(basis_price, 6) AS basis_price, round(cost_per_point, 6) AS cost_per_point, value_index FROM v"""),
    )
    def cmp_3(spark, sf, basis=_basis):
        return compared(spark, sf, basis=basis).select(
            "product_id", r6("basis_price"), r6("cost_per_point"), "value_index"
        )


@check(
    "cmp_4_5_value_index_filtered",
    with_ctes(*COMPARE, _compare_sql("p25", "coalesce(size, 0) >= 5 AND coalesce(size, 'inf'::DOUBLE) <= 30"), select="""
SELECT product_id, label, brand, n AS sample_size, round(cost_per_point, 6) AS cost_per_point, value_index, best_active_url FROM v"""),
)
def cmp_4_5(spark, sf):
    return compared(spark, sf, minimums={"size": 5.0}, maximums={"size": 30.0}).select(
        "product_id", "label", "brand", "sample_size", r6("cost_per_point"), "value_index", "best_active_url"
    )


@check(
    "cmp_6_ranking",
    with_ctes(*COMPARE, _compare_sql("p25"), select="""
SELECT product_id, round(cost_per_point, 6) AS cost_per_point, row_number() OVER (ORDER BY cost_per_point ASC NULLS LAST, pos) AS place
FROM v"""),
)
def cmp_6(spark, sf):
    rows = numbered(compared(spark, sf), *compare.rank_keys())
    return rows.select("product_id", r6("cost_per_point"), (F.col("place") + 1).alias("place"))


@check(
    "cmp_7_used_vs_retail",
    with_ctes(*COMPARE, _compare_sql("p25"), select=" SELECT product_id, round(used_vs_retail, 6) AS used_vs_retail FROM v"),
)
def cmp_7(spark, sf):
    return compared(spark, sf).select("product_id", r6("used_vs_retail"))


# Retail


@check(
    "ret_2_cheapest_offer",
    with_ctes(PRODUCTS_SQL, RETAIL_SQL, select="""
SELECT product_id, source, CAST(observed_on AS VARCHAR) AS observed_on, min(price_cents) AS price_cents,
  arg_min(url, (price_cents, url)) AS url FROM shop GROUP BY ALL"""),
)
def ret_2(spark, sf):
    offers = retail_prices(spark, sf).withColumn("price_eur", F.col("price_cents") / 100.0).withColumn("seq", F.col("url"))
    return retail.cheapest_offers(offers).select(
        "product_id", "source", F.col("observed_on").cast("string").alias("observed_on"), "price_cents", "url"
    )


@check(
    "ret_3_daily_minimum_upsert",
    with_ctes(PRODUCTS_SQL, RETAIL_SQL, select="""
SELECT product_id, source, CAST(observed_on AS VARCHAR) AS observed_on, min(price_cents) AS price_cents,
  arg_max(url, ((price_cents % 5), url, in_stock)) AS url, arg_max(in_stock, ((price_cents % 5), url, in_stock)) AS in_stock
FROM shop GROUP BY ALL"""),
)
def ret_3(spark, sf):
    # Runs are told apart by the last digit of the price: even runs are on record, odd ones come in.
    runs = retail_prices(spark, sf).withColumn("run_ts", F.timestamp_seconds(F.col("price_cents") % 5))
    merged = retail.upsert_daily(
        runs.filter("price_cents % 5 % 2 = 0"), runs.filter("price_cents % 5 % 2 = 1")
    )
    return merged.select(
        "product_id", "source", F.col("observed_on").cast("string").alias("observed_on"), "price_cents", "url", "in_stock"
    )


@check("ret_4_current_retail", with_ctes(PRODUCTS_SQL, RETAIL_SQL, select=" SELECT product_id, round(retail_eur, 6) AS retail_eur FROM r"))
def ret_4(spark, sf):
    return current(spark, sf).select("product_id", r6("retail_eur"))


@check(
    "ret_5_source_summary",
    with_ctes(PRODUCTS_SQL, RETAIL_SQL, select="""
SELECT source, count(DISTINCT product_id) AS n_products, CAST(max(observed_on) AS VARCHAR) AS last_day FROM shop GROUP BY source"""),
)
def ret_5(spark, sf):
    return retail.source_summary(retail_prices(spark, sf)).select(
        "source", "n_products", F.col("last_day").cast("string").alias("last_day")
    )


# Joins of the market model


@check(
    "joi_4_first_price",
    "SELECT CAST(user_id AS VARCHAR) AS listing_id, arg_min(CAST(floor(value * 100) AS BIGINT), ts) AS first_price_cents FROM events GROUP BY user_id",
)
def joi_4(spark, sf):
    from checks.tables import read
    from fairtag.operators.fold import first_prices

    points = read(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("listing_id"), F.col("ts").alias("observed_at"),
        F.floor(F.col("value") * 100).alias("price_cents"),
    )
    return first_prices(points)
