"""The ingestion fold over the event stream (one listing per user) and over repeated order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check
from checks.tables import micros, read, with_ctes
from fairtag.operators import fold
from fairtag.params import Params

EVENTS_AS_OF = "2024-01-31"
EVENT_PARAMS = Params(cycle_minutes=45)


def event_sightings(spark, sf, events=None):
    """Every event is a sighting of its user's listing; some lack a price or a description."""
    return (read(spark, sf, "events") if events is None else events).selectExpr(
        "'stream' AS site",
        "CAST(user_id AS STRING) AS site_listing_id",
        "concat('cat', user_id % 3) AS category",
        "concat('u/', event_id) AS url",
        "concat(event_type, ' ', event_id % 50) AS title",
        "IF(event_id % 3 = 0, '', concat('text ', event_id)) AS description",
        "IF(event_type = 'error', NULL, CAST(floor(value) AS BIGINT)) AS price_cents",
        "'EUR' AS currency",
        "IF(event_id % 2 = 0, concat('City ', event_id % 7), NULL) AS location",
        "concat('s', event_id % 11) AS seller_id",
        "event_id % 5 = 0 AS seller_is_pro",
        "CAST(event_id % 6 AS INT) AS photo_count",
        "IF(event_id % 4 = 0, CAST(ts AS TIMESTAMP) - INTERVAL 3 DAYS, NULL) AS posted_at",
        "props AS raw",
        "CAST(ts AS TIMESTAMP) AS batch_ts",
        "event_id AS batch_pos",
        "event_type AS term",
    )


SIGHTING_SQL = """
e AS (
  SELECT CAST(user_id AS VARCHAR) AS site_listing_id, 'cat' || (user_id % 3) AS category, 'u/' || event_id AS url,
    event_type || ' ' || (event_id % 50) AS title, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'text ' || event_id END AS description,
    CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) END AS price_cents,
    CASE WHEN event_id % 2 = 0 THEN 'City ' || (event_id % 7) END AS location, event_id % 5 = 0 AS seller_is_pro,
    CAST(event_id % 6 AS INT) AS photo_count, CASE WHEN event_id % 4 = 0 THEN ts - INTERVAL 3 DAYS END AS posted_at,
    ts AS batch_ts, event_id AS batch_pos, event_type AS term
  FROM events)
"""

FOLD_SQL = f"""
f AS (
  SELECT site_listing_id, count(*) AS seen_count, min(batch_ts) AS discovered_at, max(batch_ts) AS last_seen,
    least(coalesce(min(posted_at), min(batch_ts)), min(batch_ts)) AS first_seen,
    max_by(title, (batch_ts, batch_pos)) AS title, last(price_cents ORDER BY batch_ts, batch_pos) AS price_cents,
    max_by(photo_count, (batch_ts, batch_pos)) AS photo_count,
    coalesce(max_by(description, (batch_ts, batch_pos)) FILTER (WHERE description <> ''), '') AS description,
    min_by(category, (batch_ts, batch_pos)) AS category, min_by(url, (batch_ts, batch_pos)) AS url,
    first(location ORDER BY batch_ts, batch_pos) AS location, min_by(seller_is_pro, (batch_ts, batch_pos)) AS seller_is_pro
  FROM e GROUP BY site_listing_id)
"""
GONE_SQL = f"last_seen < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL {EVENT_PARAMS.grace_hours} HOURS"


def events_as_of():
    return F.lit(EVENTS_AS_OF).cast("timestamp")


def folded(spark, sf):
    return fold.fold(event_sightings(spark, sf), events_as_of(), EVENT_PARAMS)


@check(
    "ing_1_listing_upsert",
    with_ctes(SIGHTING_SQL, FOLD_SQL, select="""
SELECT site_listing_id, seen_count, epoch_us(first_seen) AS first_seen, epoch_us(last_seen) AS last_seen,
  epoch_us(discovered_at) AS discovered_at, title, price_cents, photo_count, description, category, url, location, seller_is_pro FROM f"""),
)
def ing_1(spark, sf):
    return folded(spark, sf).select(
        "site_listing_id", "seen_count", micros("first_seen"), micros("last_seen"), micros("discovered_at"), "title",
        "price_cents", "photo_count", "description", "category", "url", "location", "seller_is_pro",
    )


# A mergeable fold: the halves of the stream folded apart, then merged.
@check(
    "ing_1_merged_fold",
    with_ctes(SIGHTING_SQL, FOLD_SQL, select="""
SELECT site_listing_id, seen_count, epoch_us(first_seen) AS first_seen, title, price_cents, description, url FROM f"""),
)
def ing_1_merged(spark, sf):
    sightings = event_sightings(spark, sf)
    halves = [fold.partial_fold(sightings.filter(f"batch_pos % 2 = {i}")) for i in (0, 1)]
    return fold.finish_fold(fold.merge_folds(halves[0].unionByName(halves[1]))).select(
        "site_listing_id", "seen_count", micros("first_seen"), "title", "price_cents", "description", "url"
    )


LAG_SQL = """
l AS (
  SELECT *, lag(price_cents) OVER x AS prev, row_number() OVER x AS rn FROM e
  WINDOW x AS (PARTITION BY site_listing_id ORDER BY batch_ts, batch_pos))
"""
COUNTERS = "count(*) FILTER (WHERE rn = 1) AS new, count(*) FILTER (WHERE rn > 1) AS seen, " \
    "count(*) FILTER (WHERE rn > 1 AND price_cents IS DISTINCT FROM prev) AS price_changed"


@check("ing_2_seen_counters", with_ctes(SIGHTING_SQL, LAG_SQL, select=f" SELECT category, term, {COUNTERS} FROM l GROUP BY ALL"))
def ing_2(spark, sf):
    return fold.seen_counters(event_sightings(spark, sf), ["category", "term"], EVENT_PARAMS)


@check(
    "ing_3_price_change_log",
    with_ctes(SIGHTING_SQL, select="""
, t AS (SELECT *, lag(price_cents) OVER (PARTITION BY site_listing_id ORDER BY batch_ts, batch_pos) AS prev FROM e WHERE price_cents IS NOT NULL)
SELECT site_listing_id, epoch_us(batch_ts) AS observed_at, price_cents FROM t WHERE prev IS NULL OR prev <> price_cents"""),
)
def ing_3(spark, sf):
    return fold.price_points(event_sightings(spark, sf), EVENT_PARAMS).select(
        "site_listing_id", micros("observed_at"), "price_cents"
    )


# Day-long batches hold many prices of one listing, and each batch records one
# point at most, so the last recorded price has to be followed batch by batch.
@check(
    "ing_3_price_change_log_conflicts",
    """
WITH RECURSIVE e AS (
  SELECT user_id % 20 AS id, date_trunc('day', ts) AS b, event_id AS pos, CAST(floor(value / 25) AS BIGINT) AS p FROM events),
per AS (SELECT id, b, p, min(pos) AS pos FROM e GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY id, b ORDER BY pos) AS rn FROM per),
z AS (
  SELECT id, b, max(CASE WHEN rn = 1 THEN p END) AS a, max(CASE WHEN rn = 2 THEN p END) AS o,
    row_number() OVER (PARTITION BY id ORDER BY b) AS n FROM k GROUP BY id, b),
w AS (
  SELECT id, b, n, a AS state, a AS point FROM z WHERE n = 1
  UNION ALL
  SELECT z.id, z.b, z.n, CASE WHEN z.a <> w.state THEN z.a ELSE coalesce(z.o, z.a) END, CASE WHEN z.a <> w.state THEN z.a ELSE z.o END
  FROM w JOIN z ON z.id = w.id AND z.n = w.n + 1)
SELECT CAST(id AS VARCHAR) AS site_listing_id, epoch_us(b) AS observed_at, point AS price_cents FROM w WHERE point IS NOT NULL""",
)
def ing_3_conflicts(spark, sf):
    batches = read(spark, sf, "events").selectExpr(
        "'stream' AS site", "CAST(user_id % 20 AS STRING) AS site_listing_id",
        "CAST(date_trunc('day', ts) AS TIMESTAMP) AS batch_ts", "event_id AS batch_pos",
        "CAST(floor(value / 25) AS BIGINT) AS price_cents",
    )
    return fold.price_points(batches, Params(slot_minutes=3 * 24 * 60)).select(
        "site_listing_id", micros("observed_at"), "price_cents"
    )


@check(
    "ing_4_disappearance",
    with_ctes(SIGHTING_SQL, FOLD_SQL, select=f" SELECT site_listing_id, CASE WHEN {GONE_SQL} THEN epoch_us(last_seen) END AS disappeared_at FROM f"),
)
def ing_4(spark, sf):
    return folded(spark, sf).select("site_listing_id", micros("disappeared_at"))


# Gone as of mid-month, seen again by the end of it.
@check(
    "ing_5_reappearance",
    with_ctes(SIGHTING_SQL, select=f"""
, a AS (SELECT site_listing_id, max(batch_ts) AS last_seen FROM e WHERE batch_ts < TIMESTAMP '2024-01-15' GROUP BY ALL),
b AS (SELECT site_listing_id, max(batch_ts) AS last_seen FROM e GROUP BY ALL)
SELECT a.site_listing_id, NOT (b.{GONE_SQL}) AS live_again FROM a JOIN b USING (site_listing_id)
WHERE a.last_seen < TIMESTAMP '2024-01-15' - INTERVAL {EVENT_PARAMS.grace_hours} HOURS"""),
)
def ing_5(spark, sf):
    sightings = event_sightings(spark, sf)
    middle = F.lit("2024-01-15").cast("timestamp")
    before = fold.fold(sightings.filter(F.col("batch_ts") < middle), middle, EVENT_PARAMS)
    after = fold.fold(sightings, events_as_of(), EVENT_PARAMS)
    gone = before.filter("disappeared_at is not null").select("site_listing_id")
    return after.join(gone, "site_listing_id").select(
        "site_listing_id", F.col("disappeared_at").isNull().alias("live_again")
    )


@check(
    "ing_6_sweep_totals",
    with_ctes(SIGHTING_SQL, LAG_SQL, FOLD_SQL, select=f"""
, terms AS (SELECT DISTINCT category, term FROM e UNION ALL SELECT DISTINCT category, 'no hits' FROM e),
n AS (SELECT category, {COUNTERS} FROM l GROUP BY category)
SELECT category, new, seen, price_changed, t.terms, coalesce(g.disappeared, 0) AS disappeared
FROM n JOIN (SELECT category, count(*) AS terms FROM terms GROUP BY category) t USING (category)
LEFT JOIN (SELECT category, count(*) FILTER (WHERE {GONE_SQL}) AS disappeared FROM f GROUP BY category) g USING (category)"""),
)
def ing_6(spark, sf):
    sightings = event_sightings(spark, sf)
    hit = sightings.select("category", "term").distinct()
    searched = hit.unionByName(hit.select("category", F.lit("no hits").alias("term")).distinct())
    return fold.sweep_totals(sightings, searched, events_as_of(), EVENT_PARAMS)
