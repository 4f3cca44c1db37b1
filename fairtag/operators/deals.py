"""Live listings scored against their own market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairtag.functions.numeric import round_1dp, whole
from fairtag.operators import market
from fairtag.operators.market import PRODUCT
from fairtag.params import Params

CONFIDENCE_ORDER = {"none": 0, "low": 1, "medium": 2, "high": 3}


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 86_400_000_000.0


def with_first_price(classified: DataFrame, points: DataFrame | None) -> DataFrame:
    """Earliest recorded price per listing, from the change log unless the fold carries it."""
    if "first_price_cents" in classified.columns:
        return classified
    if points is None:
        return classified.withColumn("first_price_cents", F.lit(None).cast("bigint"))
    first = points.groupBy("listing_id").agg(
        F.min(F.struct("observed_at", "price_cents"))["price_cents"].alias("first_price_cents")
    )
    return classified.join(first, "listing_id", "left")


def is_live() -> Column:
    return F.col("disappeared_at").isNull()


def active(classified: DataFrame, as_of: Column) -> DataFrame:
    """Live comparable listings with their age in days."""
    return (
        market.comparable(classified)
        .filter(is_live())
        .withColumn("days_listed", days_between(as_of, F.col("first_seen")))
    )


def score_parts(pct: Column, ratio: Column, drop: Column, days: Column) -> Column:
    """Unrounded 0..100 score: market position, retail gap, price cuts, freshness."""

    def unit(v: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))

    market_pts = F.greatest(F.lit(0.0), (0.5 - pct) / 0.5) * 55
    retail_pts = F.when(ratio.isNull(), 0.0).otherwise(unit((0.85 - ratio) / 0.35) * 30)
    drop_pts = unit(drop / 20.0) * 10
    fresh_pts = F.when(days <= 2, 5.0).otherwise(0.0)
    return market_pts + retail_pts + drop_pts + fresh_pts


# Wording of reasons and cautions.


def reasons(pct: Column, ratio: Column, drop: Column, days: Column, n_sold: Column) -> Column:
    return F.array_compact(F.array(
        F.when(pct <= 0.10, F.concat(F.lit("cheapest "), whole(pct * 100), F.lit("% of what's listed")))
        .when(pct <= 0.25, F.concat(F.lit("bottom "), whole(pct * 100), F.lit("% of the market"))),
        F.when(ratio < 0.7, F.concat(whole(ratio * 100), F.lit("% of retail"))),
        F.when(drop >= 5, F.concat(F.lit("price cut "), whole(drop), F.lit("% since listed"))),
        F.when(days <= 2, F.lit("posted in the last 48h")),
        F.when(n_sold >= 3, F.concat(n_sold.cast("string"), F.lit(" comparable sales observed"))),
    ))


def cautions(
    ratio: Column, days: Column, tier: Column, n: Column, adjusted: Column, p10: Column, photos: Column
) -> Column:
    return F.array_compact(F.array(
        F.when(ratio > 0.95, F.lit("barely cheaper than buying new")),
        F.when(days >= 45, F.concat(F.lit("listed "), whole(days), F.lit(" days and still unsold"))),
        F.when(
            tier.isin("low", "none"),
            F.concat(F.lit("thin data — only "), n.cast("string"), F.lit(" comparable listings")),
        ),
        F.when(
            (p10 > 0) & (adjusted < p10 * 0.6),
            F.lit("far below every comparable listing — verify carefully"),
        ),
        F.when(photos <= 1, F.lit("one photo or fewer")),
    ))


def below_median_pct(median: Column, adjusted: Column) -> Column:
    return F.when(median > 0, (median - adjusted) / median * 100).otherwise(0.0)


def saving(median: Column, adjusted: Column) -> Column:
    return F.greatest(F.lit(0.0), median - adjusted)


def live_market(classified: DataFrame, as_of: Column, params: Params = Params()) -> DataFrame:
    """Mid-rank and product distribution for every price of a live listing."""
    ladder = market.price_ladder(
        market.comparable(classified),
        market.in_window(as_of, params.window_days), is_live(), market.sold_proxy(params),
    )
    return market.ranked_ladder(ladder, params)


def find_deals(
    classified: DataFrame,
    products: DataFrame,
    retail: DataFrame,
    as_of: Column,
    params: Params = Params(),
    points: DataFrame | None = None,
    limit: int | None = 50,
    min_score: float = 0.0,
    max_percentile: float | None = None,
    product_ids: list[str] | None = None,
    max_price: float | None = None,
    location: str | None = None,
    min_confidence: str = "low",
    seen_at: Column | None = None,
) -> DataFrame:
    """Top deals, best score first; filters left empty are off.

    Ranks and distributions join the products' reference data first, all of it
    small next to the listings. Prices above the percentile ceiling are gone by
    then, so the one join against the listings already drops most of them.
    """
    ceiling = params.deal_percentile if max_percentile is None else max_percentile
    floor = CONFIDENCE_ORDER.get(min_confidence, 1)
    tiers = [tier for tier, order in CONFIDENCE_ORDER.items() if order >= floor]
    quotes = (
        live_market(classified, as_of, params)
        .filter((F.col("pct_rank") <= ceiling) & F.col("confidence").isin(*tiers))
        .join(products.select(*PRODUCT, F.col("label").alias("product_label")), PRODUCT)
        .join(retail, PRODUCT, "left")
    )
    live = active(classified, as_of)
    if product_ids:
        live = live.filter(F.col("product_id").isin(*product_ids))
    if max_price:
        live = live.filter(F.coalesce("price_cents", F.lit(0)) / 100.0 <= max_price)
    if location:
        live = live.filter(F.contains(F.lower("location"), F.lit(location.lower())))
    live = with_first_price(live, points)

    adjusted = F.col("adjusted_cents") / 100.0
    price = F.coalesce("price_cents", F.lit(0)) / 100.0
    # Zero prices fall through like missing ones.
    first = F.coalesce(
        F.when(F.col("first_price_cents") != 0, F.col("first_price_cents")), "price_cents", F.lit(0)
    ) / 100.0
    known_retail = F.when(F.col("retail_eur") != 0, F.col("retail_eur"))
    scored = (
        live.join(quotes, [*PRODUCT, "adjusted_cents"])
        .withColumns({
            "price_eur": price,
            "adjusted_eur": adjusted,
            "retail_ratio": adjusted / known_retail,
            "price_drop_pct": F.when(first > 0, (first - price) / first * 100).otherwise(0.0),
        })
        .withColumn(
            "score_raw",
            score_parts(F.col("pct_rank"), F.col("retail_ratio"), F.col("price_drop_pct"), F.col("days_listed")),
        )
        .withColumn("score", round_1dp(F.col("score_raw")))
    )
    if min_score > 0:
        scored = scored.filter(F.col("score") >= min_score)
    # Texts are written for the listings that are shown only.
    return explained(top(scored, limit), seen_at)


def explained(scored: DataFrame, seen_at: Column | None = None) -> DataFrame:
    """Deal rows with reasons, cautions and derived figures."""
    is_new = F.lit(False) if seen_at is None else F.coalesce(F.col("discovered_at") > seen_at, F.lit(False))
    photos = F.coalesce("photo_count", F.lit(0))
    args = [F.col(c) for c in ("pct_rank", "retail_ratio", "price_drop_pct", "days_listed")]
    return scored.select(
        "listing_id", "site", "url", "title", "location", *PRODUCT, "product_label",
        "price_cents", "price_eur", "adjusted_eur", "modifiers",
        F.col("p50").alias("median_eur"), F.col("p25").alias("p25_eur"), F.col("p10").alias("p10_eur"),
        F.col("p75").alias("p75_eur"), F.col("p90").alias("p90_eur"),
        "pct_rank", "retail_eur", "retail_ratio", "price_drop_pct", "days_listed",
        photos.alias("photo_count"),
        F.col("n").alias("sample_size"), "confidence", is_new.alias("is_new"), "score_raw", "score",
        reasons(*args, F.col("n_sold_proxy")).alias("reasons"),
        cautions(
            F.col("retail_ratio"), F.col("days_listed"), F.col("confidence"), F.col("n"),
            F.col("adjusted_eur"), F.col("p10"), photos,
        ).alias("cautions"),
        below_median_pct(F.col("p50"), F.col("adjusted_eur")).alias("below_median_pct"),
        saving(F.col("p50"), F.col("adjusted_eur")).alias("saving_eur"),
    )


def top(deals: DataFrame, limit: int | None) -> DataFrame:
    """Best score first, listing key on ties."""
    if limit is None:
        return deals
    return deals.orderBy(F.desc("score"), "listing_id").limit(limit)


def new_deal_count(deals: DataFrame, limit: int = 500) -> DataFrame:
    """How many of the top deals were discovered since the last acknowledgement."""
    return top(deals, limit).agg(F.count_if("is_new").alias("new_deals"))


def acknowledged_at(log: DataFrame, categories: DataFrame, now: Column) -> DataFrame:
    """Latest acknowledgement per category; one never acknowledged starts now."""
    latest = log.groupBy("category").agg(F.max("ack_ts").alias("ack_ts"))
    return categories.select("category").join(latest, "category", "left").select(
        "category", F.coalesce("ack_ts", now).alias("seen_at")
    )


def mark_seen(log: DataFrame, category: str, now: Column) -> DataFrame:
    """The acknowledgement log with one more entry."""
    entry = log.sparkSession.range(1).select(F.lit(category).alias("category"), now.alias("ack_ts"))
    return log.select("category", "ack_ts").unionByName(entry)


def active_listings(
    classified: DataFrame, as_of: Column, product_id: str | None = None, params: Params = Params()
) -> DataFrame:
    """Live listings with rank and distance to the median; sort by (product, price) to read them."""
    if product_id is not None:
        classified = classified.filter(F.col("product_id") == product_id)
    quotes = live_market(classified, as_of, params).select(*PRODUCT, "adjusted_cents", "pct_rank", "p50")
    adjusted = F.col("adjusted_cents") / 100.0
    return (
        active(classified, as_of)
        .join(quotes, [*PRODUCT, "adjusted_cents"])
        .select(
            "listing_id", *PRODUCT, "url", "title", "location",
            (F.coalesce("price_cents", F.lit(0)) / 100.0).alias("price_eur"),
            adjusted.alias("adjusted_eur"), "modifiers", "days_listed",
            F.coalesce("photo_count", F.lit(0)).alias("photo_count"), "pct_rank",
            below_median_pct(F.col("p50"), adjusted).alias("vs_median"),
        )
    )


def price_search(
    wanted: DataFrame, classified: DataFrame, products: DataFrame, as_of: Column, params: Params = Params()
) -> DataFrame:
    """Price an ad-hoc set of listings (``wanted``: site_listing_id), all match kinds kept."""
    hits = classified.join(wanted.select("site_listing_id").distinct(), "site_listing_id", "left_semi")
    sampled = market.samples(classified, as_of, params)
    cents = F.coalesce("adjusted_cents", F.lit(0))
    probes = hits.filter("product_id is not null").select(*PRODUCT, cents.alias("adjusted_cents"))
    labels = products.select(*PRODUCT, F.col("label").alias("product_label"))
    # Products missing from the catalog are ranked but report no distribution.
    quotes = (
        market.ranked_ladder(market.probe_ladder(sampled, probes), params)
        .join(labels, PRODUCT, "left")
        .select(
            *PRODUCT, F.col("adjusted_cents").alias("probe_cents"), "pct_rank", "product_label",
            *[
                F.when(F.col("product_label").isNotNull(), F.col(c)).alias(name)
                for c, name in (("p50", "median_eur"), ("n", "sample_size"), ("confidence", "confidence"))
            ],
        )
    )
    adjusted = cents / 100.0
    return (
        hits.withColumn("probe_cents", cents)
        .join(quotes, [*PRODUCT, "probe_cents"], "left")
        .select(
            "listing_id", "url", "title", "location",
            (F.coalesce("price_cents", F.lit(0)) / 100.0).alias("price_eur"),
            adjusted.alias("adjusted_eur"),
            days_between(as_of, F.col("first_seen")).alias("days_listed"),
            F.coalesce("photo_count", F.lit(0)).alias("photo_count"),
            "modifiers", "match_kind", "excluded_by", "product_id", "product_label",
            F.coalesce("median_eur", F.lit(0.0)).alias("median_eur"),
            F.coalesce("sample_size", F.lit(0)).alias("sample_size"),
            F.coalesce("confidence", F.lit("none")).alias("confidence"),
            "pct_rank",
            F.when(F.col("median_eur") != 0, (F.col("median_eur") - adjusted) / F.col("median_eur") * 100).alias("vs_median"),
            "adjusted_cents",
        )
        .orderBy(F.asc_nulls_last("adjusted_cents"), "listing_id")
        .drop("adjusted_cents")
    )
