"""One run from sightings to alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairtag.operators import alerts, compare, deals, fold, market, retail
from fairtag.operators import classify as cls
from fairtag.params import Params
from fairtag.session import cut_lineage
from fairtag.sources.catalog import Catalog


@dataclass(frozen=True)
class Cycle:
    """``folded`` and ``unmatched`` are what the next run starts from."""

    folded: DataFrame
    listings: DataFrame
    normalized: DataFrame
    unmatched: DataFrame
    deals: DataFrame
    fresh: DataFrame
    alerted: DataFrame


def run_cycle(
    sightings: DataFrame,
    normalized: DataFrame,
    catalog: Catalog,
    retail_prices: DataFrame,
    alerted: DataFrame,
    as_of: Column,
    channels: list[str],
    params: Params = Params(),
    force: bool = False,
    prior: DataFrame | None = None,
    queue: DataFrame | None = None,
    limit: int | None = 50,
) -> Cycle:
    """Fold the new sightings, classify what is new or stale, score the live market and pick what to alert on.

    ``prior`` and ``queue`` are the ``folded`` and ``unmatched`` tables of the run before, so only new sightings are read.
    ``force`` reclassifies everything, as a catalog edit asks for. The best ``limit`` deals are kept, all of them with None.
    The folds and the fresh results are materialised in the shared folder; everything else reads them.
    """
    folded = cut_lineage(fold.partial_fold(sightings))
    if prior is not None:
        # Both branches of the merge read the partial fold, whose shuffles are gone by then.
        folded = cut_lineage(fold.merge_folds(prior.unionByName(folded)))
    listings = fold.close_missing(fold.finish_fold(folded), as_of, params)
    todo = cls.work_list(listings, normalized, catalog, force)
    fresh_results = cut_lineage(cls.classify(todo, catalog, params).withColumn("updated_at", as_of))
    results = cls.replaced(normalized, fresh_results)
    unmatched = cls.unmatched_titles(fresh_results, listings, as_of)
    if queue is not None:
        unmatched = cls.merge_unmatched(queue, unmatched)
    classified = market.classified_listings(listings, results)
    prices = retail.current_retail(retail_prices, catalog.products, as_of, params)
    found = deals.find_deals(classified, catalog.products, prices, as_of, params, limit=limit)
    fresh, log = alerts.push_new_deals(found, alerted, channels, params)
    return Cycle(folded, listings, results, unmatched, found, fresh, log)


def value_ranking(
    cycle: Cycle, catalog: Catalog, retail_prices: DataFrame, as_of: Column, params: Params = Params(), **options
) -> DataFrame:
    """Products of a finished cycle by cost per point; ``options`` as of ``compare``."""
    classified = market.classified_listings(cycle.listings, cycle.normalized)
    spread = market.distributions(market.samples(classified, as_of, params), catalog.products, params)
    prices = retail.current_retail(retail_prices, catalog.products, as_of, params)
    rows = compare.compare(
        catalog.products, spread, prices, compare.best_active(classified), catalog.rank_by, **options
    )
    return compare.ranked(rows)


def search(
    terms_found: DataFrame, cycle: Cycle, catalog: Catalog, as_of: Column, params: Params = Params()
) -> DataFrame:
    """Price the listings an ad-hoc search returned (``terms_found``: site_listing_id)."""
    classified = market.classified_listings(cycle.listings, cycle.normalized).filter(
        F.col("category") == catalog.category
    )
    return deals.price_search(terms_found, classified, catalog.products, as_of, params)
