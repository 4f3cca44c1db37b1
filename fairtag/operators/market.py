"""Weighted price distributions and mid-ranks per product.

All of it runs on the *price ladder*: one row per (product, price) with counts.
Building the ladder is a map-side combined aggregation, so a product that holds
a third of all listings shrinks to its distinct prices in cents before anything
is ordered: the windows over a product are bounded by its price range, not by
the number of listings. Percentiles and ranks read off the ladder equal those
of the single listings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairtag.operators.classify import USABLE
from fairtag.params import Params

PRODUCT = ["category", "product_id"]
# The percentiles a distribution reports.
QUANTILES = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}


def classified_listings(listings: DataFrame, normalized: DataFrame) -> DataFrame:
    """Listings with their classification; listings without one drop out."""
    result = normalized.drop("category", "normalized_title", "catalog_version", "updated_at")
    return listings.join(result, "listing_id")


def comparable(classified: DataFrame) -> DataFrame:
    """Privately sold listings of a known product with a like-for-like price."""
    return classified.filter(
        F.col("match_kind").isin(*USABLE) & F.col("adjusted_cents").isNotNull() & ~F.col("seller_is_pro")
    )


def in_window(as_of: Column, days: int) -> Column:
    """By last sighting: an old ad that is still up is current market data."""
    return F.col("last_seen") > as_of - F.expr(f"INTERVAL {days} DAYS")


def sold_proxy(params: Params = Params()) -> Column:
    """Gone soon after it appeared, having been seen more than once."""
    return F.coalesce(
        (F.col("seen_count") > 1)
        & (F.col("disappeared_at") - F.col("first_seen") < F.expr(f"INTERVAL {params.sold_hours} HOURS")),
        F.lit(False),
    )


def samples(classified: DataFrame, as_of: Column, params: Params = Params()) -> DataFrame:
    return (
        comparable(classified)
        .filter(in_window(as_of, params.window_days))
        .select(*PRODUCT, "listing_id", "adjusted_cents", sold_proxy(params).alias("sold"))
        .withColumn("weight", F.when(F.col("sold"), params.sold_weight).otherwise(1.0))
    )


def price_ladder(priced: DataFrame, is_sample: Column, is_probe: Column, sold: Column) -> DataFrame:
    """(product, price) counts of plain samples, sold samples and probes to be ranked."""
    return (
        priced.filter(is_sample | is_probe)
        .groupBy(*PRODUCT, "adjusted_cents")
        .agg(
            F.count_if(is_sample & ~sold).alias("n_open"),
            F.count_if(is_sample & sold).alias("n_sold"),
            F.count_if(is_probe).alias("n_probe"),
        )
    )


def sample_ladder(sampled: DataFrame) -> DataFrame:
    return price_ladder(sampled, F.lit(True), F.lit(False), F.col("sold"))


def climb(ladder: DataFrame) -> DataFrame:
    """Adds counts below each price, product totals and the next lower sample price."""
    below = Window.partitionBy(*PRODUCT).orderBy("adjusted_cents").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*PRODUCT)
    sampled_price = F.when(F.col("n_open") + F.col("n_sold") > 0, F.col("adjusted_cents"))
    return ladder.select(
        "*",
        F.coalesce(F.sum("n_open").over(below), F.lit(0)).alias("open_below"),
        F.coalesce(F.sum("n_sold").over(below), F.lit(0)).alias("sold_below"),
        F.last(sampled_price, True).over(below).alias("lower_cents"),
        F.sum("n_open").over(whole).alias("total_open"),
        F.sum("n_sold").over(whole).alias("total_sold"),
    )


def _weight(n_open: str, n_sold: str, params: Params) -> str:
    return f"({n_open} + {params.sold_weight}D * {n_sold})"


def _percentile_here(q: float, params: Params) -> Column:
    """The interpolated percentile if it falls on this ladder row, else null.

    Equal prices count as single samples, lightest first: the step up from the
    next lower price spans the first of them, the others sit flat on the price.
    """
    under = _weight("open_below", "sold_below", params)
    here = _weight("n_open", "n_sold", params)
    target = f"({q}D * {_weight('total_open', 'total_sold', params)})"
    light, heavy = min(1.0, params.sold_weight), max(1.0, params.sold_weight)
    few = "n_sold" if params.sold_weight < 1 else "n_open"
    share = f"(({target} - {under}) / IF({few} > 0, {light}D, {heavy}D))"
    value, lower = "(adjusted_cents / 100D)", "(lower_cents / 100D)"
    return F.expr(f"""
        CASE WHEN {here} > 0 AND {under} + {here} >= {target} AND ({under} < {target} OR lower_cents IS NULL)
        THEN IF(lower_cents IS NULL OR {share} >= 1, {value}, {lower} + {share} * ({value} - {lower})) END
    """)


def confidence_tier(n: Column, params: Params = Params()) -> Column:
    return (
        F.when(n >= params.tier_high, "high")
        .when(n >= params.tier_medium, "medium")
        .when(n >= params.tier_low, "low")
        .otherwise("none")
    )


SPREAD = ["n", "n_sold_proxy", *QUANTILES, "mean"]


def _spread_totals(params: Params) -> dict[str, Column]:
    """Aggregates over the ladder rows of a product."""
    weight = _weight("n_open", "n_sold", params)
    return {
        "n": F.expr("sum(n_open + n_sold)"),
        "n_sold_proxy": F.sum("n_sold" if params.sold_weight > 1 else F.lit(0)),
        **{name: F.max(_percentile_here(q, params)) for name, q in QUANTILES.items()},
        "_cents": F.expr(f"sum({weight} * adjusted_cents)"),
        "_weight": F.expr(f"sum({weight})"),
    }


def _spread_columns() -> list[Column]:
    """Reported figures from the totals; zeros where a product has probes but no samples."""
    mean = F.when(F.col("_weight") > 0, F.col("_cents") / F.col("_weight") / 100.0)
    return [
        "n", "n_sold_proxy",
        *[F.coalesce(q, F.lit(0.0)).alias(q) for q in QUANTILES],
        F.coalesce(mean, F.lit(0.0)).alias("mean"),
    ]


def distributions_from(climbed: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per product of the ladder."""
    totals = climbed.groupBy(*PRODUCT).agg(*[c.alias(name) for name, c in _spread_totals(params).items()])
    return totals.select(*PRODUCT, *_spread_columns())


def ranked_ladder(ladder: DataFrame, params: Params = Params()) -> DataFrame:
    """Each price to be ranked with its mid-rank and its product's distribution.

    Both come from the same ordered pass; a separate distribution table would
    mean building the ladder twice and joining it to itself.
    """
    whole = Window.partitionBy(*PRODUCT)
    return (
        climb(ladder)
        .select(
            *PRODUCT, "adjusted_cents", "n_probe", mid_rank(params).alias("pct_rank"),
            *[c.over(whole).alias(name) for name, c in _spread_totals(params).items()],
        )
        .filter("n_probe > 0")
        .select(
            *PRODUCT, "adjusted_cents", "pct_rank", *_spread_columns(),
            confidence_tier(F.col("n"), params).alias("confidence"),
        )
    )


def distributions(sampled: DataFrame, products: DataFrame, params: Params = Params()) -> DataFrame:
    """Every catalog product with its weighted price distribution, zeros where nothing was sampled."""
    found = distributions_from(climb(sample_ladder(sampled)), params)
    n = F.coalesce("n", F.lit(0))
    return products.select(*PRODUCT).join(found, PRODUCT, "left").select(
        *PRODUCT,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in SPREAD[:2]],
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in SPREAD[2:]],
        confidence_tier(n, params).alias("confidence"),
        (n >= params.min_samples).alias("trustworthy"),
        F.coalesce(F.col("p75") - F.col("p25"), F.lit(0.0)).alias("iqr"),
    )


def price_counts(sampled: DataFrame) -> DataFrame:
    """The sorted values of a distribution, equal prices counted: one row per (product, price)."""
    return sample_ladder(sampled).select(
        *PRODUCT, (F.col("adjusted_cents") / 100.0).alias("value"), (F.col("n_open") + F.col("n_sold")).alias("n")
    )


def mid_rank(params: Params = Params()) -> Column:
    """Share of weight below the price plus half the share at it; 0 is the cheapest."""
    below, here, total = (
        _weight(*names, params)
        for names in (("open_below", "sold_below"), ("n_open", "n_sold"), ("total_open", "total_sold"))
    )
    return F.expr(f"IF({total} > 0, ({below} + {here} / 2) / {total}, 0.5D)")


def probe_ladder(sampled: DataFrame, probes: DataFrame) -> DataFrame:
    """Ladder of the samples that also holds the prices of ``probes`` (product, adjusted_cents)."""
    marked = sampled.select(*PRODUCT, "adjusted_cents", "sold", F.lit(False).alias("probe")).unionByName(
        probes.select(*PRODUCT, "adjusted_cents", F.lit(False).alias("sold"), F.lit(True).alias("probe"))
    )
    return price_ladder(marked, ~F.col("probe"), F.col("probe"), F.col("sold"))


def rank_prices(sampled: DataFrame, probes: DataFrame, params: Params = Params()) -> DataFrame:
    """Mid-rank of every probe row (product, adjusted_cents) among the samples of its product."""
    ranks = (
        climb(probe_ladder(sampled, probes))
        .filter("n_probe > 0")
        .select(*PRODUCT, "adjusted_cents", mid_rank(params).alias("pct_rank"))
    )
    return probes.join(ranks, [*PRODUCT, "adjusted_cents"])


def histogram(values: DataFrame, by: list[str], value: str, n: str, target: int = 14) -> DataFrame:
    """Equal-width bins over (value, count) rows, the top edge inside the last bin.

    At least 5 and at most ``target`` bins, about one per three values; a single
    bin where all values are equal.
    """
    bounds = values.groupBy(*by).agg(
        F.min(value).alias("low"), F.max(value).alias("high"), F.sum(n).alias("size")
    )
    bins = F.greatest(
        F.lit(5), F.least(F.lit(target), F.greatest(F.lit(5), F.floor(F.col("size") / 3).cast("int")))
    )
    shaped = bounds.withColumn(
        "bins", F.when(F.col("high") <= F.col("low"), 1).otherwise(bins)
    ).withColumn("width", (F.col("high") - F.col("low")) / F.col("bins"))
    index = F.least(F.col("bins") - 1, F.floor((F.col(value) - F.col("low")) / F.col("width")).cast("int"))
    filled = (
        values.join(shaped, by)
        .withColumn("bin", F.when(F.col("width") == 0, 0).otherwise(index))
        .groupBy(*by, "bin")
        .agg(F.sum(n).alias("count"))
    )
    edges = shaped.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    return (
        edges.join(filled, [*by, "bin"], "left")
        .select(
            *by, "bin",
            (F.col("low") + F.col("bin") * F.col("width")).alias("lo"),
            F.when(F.col("width") == 0, F.col("low"))
            .otherwise(F.col("low") + (F.col("bin") + 1) * F.col("width"))
            .alias("hi"),
            F.coalesce("count", F.lit(0)).alias("count"),
        )
    )


def market_position(value: Column, p10: Column, p25: Column, p75: Column, p90: Column) -> Column:
    """Value and quartiles as 0..1 positions between p10 and p90; null on a flat market."""

    def at(v: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - p10) / (p90 - p10)))

    return F.when(
        p90 > p10, F.struct(at(value).alias("value"), at(p25).alias("p25"), at(p75).alias("p75"))
    )
