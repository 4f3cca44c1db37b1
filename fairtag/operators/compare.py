"""Products ranked by cost per unit of an attribute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairtag.functions.numeric import round_1dp
from fairtag.functions.ordered import extreme_rows
from fairtag.operators import market
from fairtag.operators.deals import is_live
from fairtag.operators.market import PRODUCT


def best_active(classified: DataFrame) -> DataFrame:
    """Cheapest live listing per product."""
    live = market.comparable(classified).filter(is_live())
    cheapest = extreme_rows(live, list(PRODUCT), F.col("adjusted_cents"), [F.col("listing_id"), F.col("url")])
    return cheapest.select(
        *PRODUCT, (F.col("adjusted_cents") / 100.0).alias("best_active_eur"), F.col("url").alias("best_active_url")
    )


def attribute_filter(
    minimums: dict[str, float] | None = None, maximums: dict[str, float] | None = None
) -> Column:
    """A missing attribute counts as 0 for minimums and as infinite for maximums."""
    keep = F.lit(True)
    for name, value in (minimums or {}).items():
        keep = keep & (F.coalesce(F.try_element_at("attributes", F.lit(name)), F.lit(0.0)) >= value)
    for name, value in (maximums or {}).items():
        keep = keep & (F.coalesce(F.try_element_at("attributes", F.lit(name)), F.lit(float("inf"))) <= value)
    return keep


def compare(
    products: DataFrame,
    spread: DataFrame,
    retail: DataFrame,
    best: DataFrame,
    rank_by: str,
    product_ids: list[str] | None = None,
    basis: str = "p25",
    minimums: dict[str, float] | None = None,
    maximums: dict[str, float] | None = None,
) -> DataFrame:
    """Cost per point and a value index where the cheapest of the filtered set is 100.

    ``basis`` is the price ranked on: p25, median, best (cheapest live) or retail.
    """
    price = {"median": F.col("p50"), "best": F.col("best_active_eur"), "retail": F.col("retail_eur")}.get(
        basis, F.col("p25")
    )
    chosen = products.filter(attribute_filter(minimums, maximums))
    if product_ids:
        chosen = chosen.filter(F.col("product_id").isin(*product_ids))
    attr = F.try_element_at("attributes", F.lit(rank_by))
    rows = (
        chosen.join(spread, PRODUCT)
        .join(retail, PRODUCT, "left")
        .join(best, PRODUCT, "left")
        .withColumn("basis_price", F.coalesce(price, F.lit(0.0)))
        .withColumn("cost_per_point", F.when((F.col("basis_price") > 0) & (attr > 0), F.col("basis_price") / attr))
    )
    # Products are catalog rows, few to a category; their window needs no second plan of the statistics.
    cheapest = F.min("cost_per_point").over(Window.partitionBy("category"))
    index = F.coalesce(round_1dp(F.col("cheapest") / F.col("cost_per_point") * 100), F.lit(0.0))
    return (
        rows.withColumn("cheapest", cheapest)
        .select(
            *PRODUCT, "pos", "label", "brand", "attributes",
            F.col("p25").alias("used_p25"), F.col("p50").alias("used_median"), "retail_eur",
            "best_active_eur", "best_active_url", F.col("n").alias("sample_size"), "basis_price",
            "cost_per_point", index.alias("value_index"),
            F.when(F.col("retail_eur") > 0, F.col("p50") / F.col("retail_eur")).alias("used_vs_retail"),
        )
    )


def rank_keys() -> tuple[Column, ...]:
    return F.asc_nulls_last("cost_per_point"), F.asc("pos")


def ranked(rows: DataFrame) -> DataFrame:
    """Cheapest per point first, products without a cost last, catalog order on ties."""
    return rows.orderBy(*rank_keys())
