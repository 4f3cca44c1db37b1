"""Retail price baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairtag.functions.numeric import round_cents
from fairtag.functions.ordered import extreme_rows, gathered_extremes
from fairtag.operators.classify import classify
from fairtag.params import Params
from fairtag.session import cut_lineage
from fairtag.sources.catalog import Catalog
from fairtag.sources.jsonld import page_offers

KEY = ["category", "product_id", "source", "observed_on"]


def classify_offers(offers: DataFrame, catalog: Catalog, params: Params = Params()) -> DataFrame:
    """Shop offers with the product their name matches; unmatched offers drop out.

    ``offers``: offer_id, seq, source, observed_on, name, price_eur, url, in_stock.
    """
    # The offers are read here and met again with their matches; the pages behind them are walked once.
    offers = cut_lineage(offers)
    named = offers.select(
        F.col("offer_id").alias("listing_id"), F.col("name").alias("title"),
        F.lit("").alias("description"), round_cents(F.col("price_eur") * 100).alias("price_cents"),
    )
    matched = classify(named, catalog, params).filter("product_id is not null")
    return offers.join(
        matched.select(F.col("listing_id").alias("offer_id"), "category", "product_id"), "offer_id"
    )


def cheapest_offers(classified: DataFrame) -> DataFrame:
    """Cheapest offer per product, shop and day; the earlier one on equal prices."""
    cheapest = extreme_rows(classified, KEY, F.col("price_eur"), [F.col("seq"), F.col("url"), F.col("in_stock")])
    return cheapest.select(*KEY, round_cents(F.col("price_eur") * 100).alias("price_cents"), "url", "in_stock")


def upsert_daily(prior: DataFrame, new: DataFrame) -> DataFrame:
    """Lowest price of the day, link and stock of the newest run. Both sides carry ``run_ts``."""
    newest = ("max", F.coalesce(F.unix_micros("run_ts"), F.lit(-(2**62))), F.struct("run_ts", "url", "in_stock"))
    rows = gathered_extremes(prior.unionByName(new), KEY, {"newest": newest}, price_cents=F.min("price_cents"))
    return rows.select(*KEY, "price_cents", "newest.url", "newest.in_stock", "newest.run_ts")


def retail_pass(pages: DataFrame, catalog: Catalog, prior: DataFrame, run_ts: Column, params: Params = Params()) -> DataFrame:
    """One run over fetched shop pages: offers read, matched, the cheapest of each product, shop and day put into the daily table.

    ``pages``: source, seq (a number that orders the pages of the run), observed_on, html. ``prior`` is the daily table before,
    with ``run_ts``; the whole table after the run is returned.
    """
    found = page_offers(pages, ["source", "seq", "observed_on"])
    offers = found.select(
        F.concat_ws("/", "source", "observed_on", "seq", "block_no", "node_no").alias("offer_id"), "source", "observed_on",
        F.struct("seq", "block_no", "node_no").alias("seq"), "name", "price_eur", "url", "in_stock",
    )
    # Read more than once below, and again by the next run.
    best = cut_lineage(cheapest_offers(classify_offers(offers, catalog, params)))
    return upsert_daily(prior, best.withColumn("run_ts", run_ts))


def current_retail(
    prices: DataFrame, products: DataFrame, as_of: Column, params: Params = Params()
) -> DataFrame:
    """Cheapest in-stock price of the last days per product, else the catalog's hint if any."""
    scraped = (
        prices.filter("in_stock")
        .filter(F.col("observed_on") > F.date_sub(as_of.cast("date"), params.retail_days))
        .groupBy("category", "product_id")
        .agg((F.min("price_cents") / 100.0).alias("scraped_eur"))
    )
    hint = F.when(F.col("retail_fallback_eur") > 0, F.col("retail_fallback_eur"))
    return (
        products.select("category", "product_id", "retail_fallback_eur")
        .join(scraped, ["category", "product_id"], "full")
        .select("category", "product_id", F.coalesce("scraped_eur", hint).alias("retail_eur"))
        .filter("retail_eur is not null")
    )


def source_summary(prices: DataFrame) -> DataFrame:
    """Distinct products and last day per category and shop."""
    return prices.groupBy("category", "source").agg(
        F.countDistinct("product_id").alias("n_products"), F.max("observed_on").alias("last_day")
    )
