"""Micro-batch forms of the fold, the classifier and the price distributions.

Folds and price ladders are tables that merge themselves (``tiers``). Classified micro-batches write a folder each, overwritten on a
retry, so a batch counts once however often it runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from fairtag.operators import classify as cls
from fairtag.operators import fold, market
from fairtag.operators.market import PRODUCT
from fairtag.params import Params
from fairtag.sources.catalog import Catalog
from fairtag.streaming.tiers import Tiers, summed


def _to_folders(path: str, transform: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        # Read once: the classifier writes the read titles before it matches them.
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def folds(path: str, fan: int = 4) -> Tiers:
    return Tiers(path, fold.merge_folds, fan)


def fold_stream(sightings: DataFrame, path: str, fan: int = 4) -> DataStreamWriter:
    """Adds each micro-batch's partial fold to the folds under ``path``; start it with a checkpoint location."""
    return sightings.writeStream.foreachBatch(folds(path, fan).sink(fold.partial_fold))


def read_fold(spark: SparkSession, path: str, as_of: Column, params: Params = Params()) -> DataFrame:
    """Listings as of a moment from all partial folds written so far."""
    return fold.close_missing(fold.finish_fold(folds(path).read(spark)), as_of, params)


def classify_stream(listings: DataFrame, catalog: Catalog, path: str, params: Params = Params()) -> DataStreamWriter:
    """Classifies each micro-batch of listings against the catalog."""
    return listings.writeStream.foreachBatch(
        _to_folders(path, lambda batch: cls.classify(batch, catalog, params))
    )


def refresh_distributions(
    known: DataFrame, sampled: DataFrame, touched: DataFrame, products: DataFrame, params: Params = Params()
) -> DataFrame:
    """Distributions recomputed for the ``touched`` products only, the others carried over."""
    changed = touched.select(*PRODUCT).distinct()
    fresh = market.distributions(
        sampled.join(changed, PRODUCT, "left_semi"), products.join(changed, PRODUCT, "left_semi"), params
    )
    return known.join(changed, PRODUCT, "left_anti").unionByName(fresh)


LADDER = ["n_open", "n_sold"]


def sample_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What turns the samples ``before`` into those ``after``: (product, price, sold) and how many more (or fewer) there are.

    Samples that left the window, disappeared or changed their price are taken back; those that stay do not show.
    """
    rows = [s.select(*PRODUCT, "adjusted_cents", "sold", F.lit(sign).alias("delta")) for s, sign in ((before, -1), (after, 1))]
    return rows[0].unionByName(rows[1]).groupBy(*PRODUCT, "adjusted_cents", "sold").agg(F.sum("delta").alias("delta")).filter("delta <> 0")


def ladders(path: str, fan: int = 4) -> Tiers:
    return Tiers(path, summed([*PRODUCT, "adjusted_cents"], LADDER), fan)


def distribution_stream(changes: DataFrame, path: str, fan: int = 4) -> DataStreamWriter:
    """Adds each micro-batch of ``sample_changes`` to the price ladders under ``path``.

    A micro-batch touches the prices that it holds and nothing else: no sample is read again. See ``read_distributions``.
    """
    def rungs(batch: DataFrame) -> DataFrame:
        count = lambda sold: F.sum(F.when(F.col("sold") == sold, F.col("delta")).otherwise(0))
        return batch.groupBy(*PRODUCT, "adjusted_cents").agg(count(False).alias("n_open"), count(True).alias("n_sold"))

    return changes.writeStream.foreachBatch(ladders(path, fan).sink(rungs))


def read_distributions(spark: SparkSession, path: str, params: Params = Params()) -> DataFrame:
    """The distribution of every product that has samples, from the ladders written so far."""
    ladder = ladders(path).read(spark).withColumn("n_probe", F.lit(0))
    return market.distributions_from(market.climb(ladder), params)
