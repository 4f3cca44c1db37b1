"""Streams over the event table, drained once, compared with the batch results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import check
from checks.classifying import FUZZY_SQL, PART_SQL, RESULT_SQL, part_catalog, part_listings
from checks.ingesting import (
    EVENT_PARAMS, FOLD_SQL, GONE_SQL, SIGHTING_SQL, event_sightings, events_as_of,
)
from checks.tables import micros, read, rounded, with_ctes
from checks import tables
from fairtag.operators import market
from fairtag.params import Params
from fairtag.session import scratch
from fairtag.streaming import alerting, changelog, folding

# Grace of a day, so that the month holds many gaps.
GAP_PARAMS = Params(cycle_minutes=6 * 60)


def table_stream(spark, sf, name):
    """The table as a file stream; a glob stands for a single file as well as for a folder of files."""
    schema = read(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/[{name[0]}]{name[1:]}.parquet")


def sighting_stream(spark, sf):
    """The sighting columns of the stream, cut like the batch ones."""
    return event_sightings(spark, sf, table_stream(spark, sf, "events"))


def run(writer, spark) -> None:
    """Drain what is there and stop."""
    writer.option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start().awaitTermination()


def drained(stream, spark):
    """Run a stream into files and read them back; nothing passes through the driver."""
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    run(stream.writeStream.format("parquet").option("path", path).option("compression", "zstd").outputMode("append"), spark)
    return spark.read.schema(stream.schema).parquet(path)


@check(
    "str_1_streaming_fold",
    with_ctes(SIGHTING_SQL, FOLD_SQL, select=f"""
SELECT site_listing_id, seen_count, epoch_us(first_seen) AS first_seen, title, price_cents, description, url,
  CASE WHEN {GONE_SQL} THEN epoch_us(last_seen) END AS disappeared_at FROM f"""),
)
def str_1(spark, sf):
    # The stream is drained twice, several micro-batches each time, and its folds are merged on the way.
    arriving, path, checkpoint = f"{scratch(spark)}/events", f"{scratch(spark)}/folds", scratch(spark)
    events = read(spark, sf, "events")
    for half in (0, 1):
        events.filter(f"event_id % 2 = {half}").repartition(3, "event_id").write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
        writer = folding.fold_stream(event_sightings(spark, sf, stream), path, fan=2)
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return folding.read_fold(spark, path, events_as_of(), EVENT_PARAMS).select(
        "site_listing_id", "seen_count", micros("first_seen"), "title", "price_cents", "description", "url",
        micros("disappeared_at"),
    )


def changes(spark, sf):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    return drained(changelog.listing_changes(sighting_stream(spark, sf), GAP_PARAMS), spark)


@check(
    "str_2_streaming_change_log",
    with_ctes(SIGHTING_SQL, select="""
, t AS (SELECT *, lag(price_cents) OVER (PARTITION BY site_listing_id ORDER BY batch_ts, batch_pos) AS prev FROM e WHERE price_cents IS NOT NULL)
SELECT site_listing_id, epoch_us(batch_ts) AS observed_at, price_cents FROM t WHERE prev IS NULL OR prev <> price_cents"""),
)
def str_2(spark, sf):
    return changes(spark, sf).filter("change = 'price'").select("site_listing_id", micros("observed_at"), "price_cents")


# The watermark trails the newest event by the grace, so a listing is reported
# gone once its last sighting is two graces behind the newest event.
@check(
    "str_3_streaming_disappearance",
    with_ctes(SIGHTING_SQL, select=f"""
, g AS (SELECT site_listing_id, max(batch_ts) AS seen FROM e GROUP BY ALL)
SELECT site_listing_id, epoch_us(seen) AS observed_at FROM g WHERE seen + INTERVAL {2 * GAP_PARAMS.grace_hours} HOURS <= (SELECT max(batch_ts) FROM e)"""),
)
def str_3(spark, sf):
    return changes(spark, sf).filter("change = 'gone'").select("site_listing_id", micros("observed_at"))


@check(
    "str_3_live_intervals",
    with_ctes(SIGHTING_SQL, select=f"""
, a AS (SELECT *, batch_ts - lag(batch_ts) OVER (PARTITION BY site_listing_id ORDER BY batch_ts) > INTERVAL {GAP_PARAMS.grace_hours} HOURS AS cut FROM e),
b AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY site_listing_id ORDER BY batch_ts) AS run FROM a)
SELECT site_listing_id, epoch_us(min(batch_ts)) AS live_from, epoch_us(max(batch_ts)) AS live_until, count(*) AS sightings FROM b GROUP BY site_listing_id, run"""),
)
def str_3_intervals(spark, sf):
    return changelog.live_intervals(event_sightings(spark, sf), GAP_PARAMS).select(
        "site_listing_id", micros("live_from"), micros("live_until"), "sightings"
    )


# Twenty listings to a user, and the month in four parts in order of time, one to a micro-batch.
LISTINGS_SQL = "x AS (SELECT e.site_listing_id || '-' || (batch_pos % 20) AS site_listing_id, batch_ts FROM e)"
WEEKS = ["2024-01-01", "2024-01-09", "2024-01-17", "2024-01-25", "9999-01-01"]
# A part is one file, or several of so many rows.
FILE_ROWS = 200_000


def listings_by_week(spark, sf):
    def listings(events):
        return event_sightings(spark, sf, events).withColumn(
            "site_listing_id", F.concat_ws("-", "site_listing_id", F.col("batch_pos") % 20)
        )

    events = read(spark, sf, "events")
    at = F.col("ts").cast("timestamp")
    weeks = [(at >= start if i else F.lit(True)) & (at < end) for i, (start, end) in enumerate(zip(WEEKS, WEEKS[1:]))]
    # Each part has as many files as the others: rows are dealt in turn, so none of so few files stays empty (and unwritten).
    files = max(1, min(events.agg(*(F.count_if(week) for week in weeks)).first()) // FILE_ROWS)
    arriving = f"{scratch(spark)}/weeks"
    for week in weeks:
        listings(events.filter(week).repartition(files)).write.mode("append").option("compression", "zstd").parquet(arriving)
    sightings = listings(events)
    return sightings, spark.readStream.schema(sightings.schema).option("maxFilesPerTrigger", files).parquet(arriving)


@check(
    "str_3_gone_in_micro_batches",
    with_ctes(SIGHTING_SQL, LISTINGS_SQL, select=f"""
, g AS (SELECT site_listing_id, max(batch_ts) AS seen FROM x GROUP BY ALL)
SELECT site_listing_id, epoch_us(seen) AS observed_at FROM g WHERE seen + INTERVAL {2 * GAP_PARAMS.grace_hours} HOURS <= (SELECT max(batch_ts) FROM x)"""),
)
def str_3_gone(spark, sf):
    """Listings gone for good; those that came back were reported by the micro-batch that missed them, too."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    events, stream = listings_by_week(spark, sf)
    gone = drained(changelog.listing_changes(stream, GAP_PARAMS), spark).filter("change = 'gone'")
    newest = events.groupBy("site_listing_id").agg(F.max("batch_ts").alias("observed_at"))
    return gone.join(newest, ["site_listing_id", "observed_at"], "left_semi").select("site_listing_id", micros("observed_at"))


@check(
    "str_3_live_intervals_stream",
    with_ctes(SIGHTING_SQL, LISTINGS_SQL, select=f"""
, a AS (SELECT *, batch_ts - lag(batch_ts) OVER (PARTITION BY site_listing_id ORDER BY batch_ts) > INTERVAL {GAP_PARAMS.grace_hours} HOURS AS cut FROM x),
b AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY site_listing_id ORDER BY batch_ts) AS run FROM a),
v AS (SELECT site_listing_id, min(batch_ts) AS live_from, max(batch_ts) AS live_until, count(*) AS sightings FROM b GROUP BY site_listing_id, run)
SELECT site_listing_id, epoch_us(live_from) AS live_from, epoch_us(live_until) AS live_until, sightings FROM v
WHERE live_until + INTERVAL {2 * GAP_PARAMS.grace_hours} HOURS <= (SELECT max(batch_ts) FROM x)"""),
)
def str_3_intervals_stream(spark, sf):
    """Periods that the watermark has closed."""
    _, stream = listings_by_week(spark, sf)
    return drained(changelog.live_intervals(stream, GAP_PARAMS), spark).select(
        "site_listing_id", micros("live_from"), micros("live_until"), "sightings"
    )


@check(
    "str_4_streaming_alert_dedup",
    """SELECT DISTINCT CAST(user_id AS VARCHAR) AS listing_id, CAST(floor(value) AS BIGINT) * 100 AS alert_cents
FROM events WHERE event_type = 'purchase' AND value >= 45""",
)
def str_4(spark, sf):
    deals = table_stream(spark, sf, "events").filter("event_type = 'purchase'").selectExpr(
        "CAST(user_id AS STRING) AS listing_id", "floor(value) AS price_eur", "value AS score"
    )
    return drained(alerting.fresh_deals_stream(deals).select("listing_id", "alert_cents"), spark)


# Order lines as a stream of ads, classified per micro-batch.
@check(
    "str_5_streaming_classification",
    with_ctes(PART_SQL, FUZZY_SQL, RESULT_SQL, select=" SELECT listing_id, match_kind, product_id, excluded_by, adjust_pct FROM res"),
)
def str_5(spark, sf):
    ads = part_listings(spark, sf, table_stream(spark, sf, "lineitem"))
    path = f"{scratch(spark)}/classified"
    run(folding.classify_stream(ads, part_catalog(spark, sf), path), spark)
    return spark.read.parquet(path).select("listing_id", "match_kind", "product_id", "excluded_by", "adjust_pct")


# Distributions as of 1996, refreshed for the products sampled since.
@check(
    "str_6_distribution_refresh",
    with_ctes(
        tables.MARKET_SQL, tables.COMPARABLE_SQL, tables.SAMPLES_SQL, tables.SPREAD_SQL, tables.PRODUCTS_SQL,
        select=""" SELECT product_id, coalesce(n, 0) AS n, round(coalesce(p50, 0e0), 6) AS p50 FROM p LEFT JOIN d USING (product_id)""",
    ),
)
def str_6(spark, sf):
    facts, products = tables.classified(spark, sf), tables.products(spark, sf)
    now = tables.as_of()
    cut = F.lit("1997-06-01").cast("timestamp")
    known = market.distributions(
        market.samples(facts.filter(F.col("last_seen") <= cut), now, tables.PARAMS), products, tables.PARAMS
    )
    sampled = market.samples(facts, now, tables.PARAMS)
    touched = market.samples(facts.filter(F.col("last_seen") > cut), now, tables.PARAMS)
    return folding.refresh_distributions(known, sampled, touched, products, tables.PARAMS).select(
        "product_id", "n", rounded("p50")
    )


@check(
    "str_6_distribution_stream",
    with_ctes(
        tables.MARKET_SQL, tables.COMPARABLE_SQL, tables.SAMPLES_SQL, tables.SPREAD_SQL, tables.PRODUCTS_SQL,
        select=""" SELECT product_id, n, round(p50, 6) AS p50 FROM p JOIN d USING (product_id)""",
    ),
)
def str_6_stream(spark, sf):
    # Older samples arrive first, then what takes back those that left the window and adds the newer ones; no sample is read again.
    arriving, refreshed = f"{scratch(spark)}/changes", f"{scratch(spark)}/ladders"
    facts = tables.classified(spark, sf)
    early = F.lit("1997-06-01").cast("timestamp")
    older = market.samples(facts.filter(F.col("last_seen") <= early), early, tables.PARAMS)
    newer = market.samples(facts, tables.as_of(), tables.PARAMS)
    for before, after in ((older.limit(0), older), (older, newer)):
        folding.sample_changes(before, after).repartition(3, "product_id", "adjusted_cents").write.mode("append").parquet(arriving)
    stream = spark.readStream.schema(spark.read.parquet(arriving).schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    run(folding.distribution_stream(stream, refreshed, fan=2), spark)
    return folding.read_distributions(spark, refreshed, tables.PARAMS).select("product_id", "n", rounded("p50"))
