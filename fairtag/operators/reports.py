"""Summary figures over listings, classifications, retail prices and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairtag.operators import market
from fairtag.operators.market import PRODUCT
from fairtag.params import Params


def listing_totals(listings: DataFrame) -> DataFrame:
    return listings.groupBy("category").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("disappeared_at").isNull()).alias("active")
    )


def status(listings: DataFrame, params: Params = Params()) -> DataFrame:
    gone = F.col("disappeared_at").isNotNull()
    return listings.groupBy("category").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~gone).alias("active"),
        F.count_if(gone).alias("disappeared"),
        F.count_if(market.sold_proxy(params)).alias("sold_proxy"),
        F.date_format(F.max("last_seen"), "dd MMM HH:mm").alias("last_seen"),
        F.date_format(F.min("first_seen"), "dd MMM yyyy").alias("oldest"),
    )


def coverage(normalized: DataFrame) -> DataFrame:
    """Results per match kind and the share of classifiable titles that found a product."""
    kinds = ("rule", "fuzzy", "none", "excluded")
    counted = normalized.groupBy("category").agg(
        *[F.count_if(F.col("match_kind") == k).alias(k) for k in kinds]
    )
    matched = F.col("rule") + F.col("fuzzy")
    classifiable = matched + F.col("none")
    return counted.withColumn(
        "coverage_pct", F.when(classifiable > 0, matched / classifiable * 100).otherwise(0.0)
    )


def product_counts(normalized: DataFrame) -> DataFrame:
    return normalized.filter("product_id is not null").groupBy(*PRODUCT).agg(F.count(F.lit(1)).alias("n"))


def unmatched_count(queue: DataFrame) -> DataFrame:
    return queue.groupBy("category").agg(F.count_if(~F.col("resolved")).alias("n"))


def product_overview(products: DataFrame, spread: DataFrame, retail: DataFrame) -> DataFrame:
    """Per product its distribution and distance to retail; sort with ``overview_order``."""
    ratio = F.when((F.col("retail_eur") != 0) & (F.col("p50") != 0), F.col("p50") / F.col("retail_eur"))
    return (
        products.select(*PRODUCT, "pos", "label", "brand")
        .join(spread, PRODUCT)
        .join(retail, PRODUCT, "left")
        .withColumn("ratio", ratio)
    )


def overview_order(overview: DataFrame) -> DataFrame:
    """Products with data first, the best covered first, catalog order on ties."""
    return overview.orderBy(*overview_keys())


def overview_keys() -> tuple[Column, ...]:
    return F.asc(F.col("n") == 0), F.desc("n"), F.asc("pos")


def product_detail(overview: DataFrame, live: DataFrame, bins: DataFrame) -> DataFrame:
    """Distribution, cheapest live listing and histogram of each product in one row."""
    cheapest = live.groupBy(*PRODUCT).agg(
        F.min("adjusted_eur").alias("cheapest_live"), F.count(F.lit(1)).alias("n_live")
    )
    # A histogram has at most 14 bins.
    drawn = bins.groupBy(*PRODUCT).agg(
        F.array_sort(F.collect_list(F.struct("bin", "lo", "hi", "count"))).alias("histogram")
    )
    return overview.join(cheapest, PRODUCT, "left").join(drawn, PRODUCT, "left")


def histogram_table(bins: DataFrame) -> DataFrame:
    """Bins with a printable price range."""
    label = F.concat(
        F.lit("€"), F.format_number(F.rint("lo"), 0), F.lit(" – €"), F.format_number(F.rint("hi"), 0)
    )
    return bins.select(*PRODUCT, "bin", label.alias("price_range"), "count")


def health(listings: DataFrame) -> DataFrame:
    return listings.agg(F.count(F.lit(1)).alias("listings"), F.max("last_seen").alias("last_seen"))


def alert_count(alerted: DataFrame) -> DataFrame:
    return alerted.agg(F.count(F.lit(1)).alias("alerted"))

