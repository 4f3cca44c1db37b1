"""Sightings folded into listings, price history and disappearance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairtag.functions.ordered import extremes, packed, time_slot, with_previous
from fairtag.params import Params

KEY = ["site", "site_listing_id"]
_FIRST_FIELDS = [
    "category", "url", "currency", "location", "seller_id", "seller_is_pro", "posted_at", "raw",
]


def listing_id() -> Column:
    """The natural key as one string; a 64-bit hash would collide at billions of listings."""
    return F.concat_ws("/", *KEY).alias("listing_id")


_FOLDED = {
    "newest": ("max", ["title", "price_cents", "photo_count"]),
    "described": ("max", ["description"]),
    "oldest": ("min", _FIRST_FIELDS),
    "priced": ("min", ["price_cents"]),
}


def partial_fold(sightings: DataFrame) -> DataFrame:
    """One mergeable row per listing: sums, and the sightings that are first or last of their kind."""
    at = packed(F.col("batch_ts"), F.col("batch_pos"))
    takes_part = {"described": F.col("description") != "", "priced": F.col("price_cents").isNotNull()}
    picks = {
        name: (how, F.when(takes_part[name], at) if name in takes_part else at, F.struct("batch_ts", "batch_pos", *fields))
        for name, (how, fields) in _FOLDED.items()
    }
    return extremes(
        sightings, KEY, picks, seen_count=F.count(F.lit(1)), discovered_at=F.min("batch_ts"), last_seen=F.max("batch_ts"),
        earliest_posted=F.min("posted_at"),
    )


def merge_folds(partials: DataFrame) -> DataFrame:
    """Combine partial folds of disjoint sets of sightings; associative and commutative."""
    picks = {
        name: (how, F.when(F.col(name).isNotNull(), packed(F.col(f"{name}.batch_ts"), F.col(f"{name}.batch_pos"))), F.col(name))
        for name, (how, _) in _FOLDED.items()
    }
    return extremes(
        partials, KEY, picks, seen_count=F.sum("seen_count"), discovered_at=F.min("discovered_at"), last_seen=F.max("last_seen"),
        earliest_posted=F.min("earliest_posted"),
    )


def finish_fold(partials: DataFrame) -> DataFrame:
    """Listing columns from merged partial folds, everything still live."""
    return partials.select(
        listing_id(),
        *KEY,
        *[F.col(f"oldest.{name}").alias(name) for name in _FIRST_FIELDS],
        F.col("newest.title").alias("title"),
        F.coalesce("described.description", F.lit("")).alias("description"),
        F.col("newest.price_cents").alias("price_cents"),
        F.col("priced.price_cents").alias("first_price_cents"),
        F.col("newest.photo_count").alias("photo_count"),
        F.least("earliest_posted", "discovered_at").alias("first_seen"),
        "last_seen",
        "discovered_at",
        F.col("seen_count").cast("bigint").alias("seen_count"),
    )


def close_missing(listings: DataFrame, as_of: Column, params: Params = Params()) -> DataFrame:
    """``disappeared_at`` from the newest sighting, so a re-sighted listing is live again."""
    cutoff = as_of - F.expr(f"INTERVAL {params.grace_hours} HOURS")
    return listings.withColumn(
        "disappeared_at", F.when(F.col("last_seen") < cutoff, F.col("last_seen"))
    )


def fold(sightings: DataFrame, as_of: Column, params: Params = Params()) -> DataFrame:
    """Current state of every listing as of a moment."""
    return close_missing(finish_fold(partial_fold(sightings)), as_of, params)


def seen_events(sightings: DataFrame, params: Params = Params(), carry: tuple[str, ...] = ()) -> DataFrame:
    """Per sighting: first one of its listing, or a re-sighting with or without a new price."""
    narrow = sightings.select(
        *KEY, "batch_ts", "batch_pos", "price_cents", *carry,
        time_slot(F.col("batch_ts"), params.slot_minutes).alias("_slot"),
    )
    with_prev = with_previous(narrow, KEY, "_slot", ["batch_ts", "batch_pos"], "_prev")
    is_new = F.col("_prev").isNull()
    return with_prev.select(
        *KEY, "batch_ts", "batch_pos", *carry,
        is_new.alias("is_new"),
        (~is_new & ~F.col("price_cents").eqNullSafe(F.col("_prev.price_cents"))).alias("price_changed"),
    )


def seen_counters(sightings: DataFrame, by: list[str], params: Params = Params()) -> DataFrame:
    """New, re-seen and re-priced sightings per group."""
    return seen_events(sightings, params, tuple(by)).groupBy(*by).agg(
        F.count_if("is_new").alias("new"),
        F.count_if(~F.col("is_new")).alias("seen"),
        F.count_if("price_changed").alias("price_changed"),
    )


def sweep_totals(
    sightings: DataFrame, terms: DataFrame, as_of: Column, params: Params = Params()
) -> DataFrame:
    """Counters of a sweep per category summed over its search terms, terms without hits included.

    Sightings carry the ``term`` that found them; ``terms`` lists (category, term) searched.
    """
    counted = seen_counters(sightings, ["category", "term"], params)
    closed = (
        fold(sightings, as_of, params)
        .groupBy("category")
        .agg(F.count("disappeared_at").alias("disappeared"))
    )
    return (
        terms.select("category", "term")
        .join(counted, ["category", "term"], "left")
        .groupBy("category")
        .agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("new", "seen", "price_changed")],
            F.count(F.lit(1)).alias("terms"),
        )
        .join(closed, "category", "left")
        .fillna(0, ["disappeared"])
    )


def _after(recorded: Column, step: Column) -> Column:
    """The last recorded price after a batch: its first price, or the other one if that is recorded already."""
    return F.when(recorded.eqNullSafe(step["a"]), F.coalesce(step["b"], step["a"])).otherwise(step["a"])


def _slots(sightings: DataFrame, params: Params) -> DataFrame:
    """One row per listing and time slot: its batches in order, and what they make of the price recorded before.

    Whatever that price was, a run of batches ends at ``y`` if it was ``x`` and at ``z`` if not; such functions compose to
    functions of the same form, so a slot of any length is three numbers.
    """
    # Rows without key or time have no place in an order.
    rows = sightings.dropna(subset=[*KEY, "batch_ts", "price_cents"]).select(
        *KEY, "batch_ts", "price_cents", time_slot(F.col("batch_ts"), params.slot_minutes).alias("_slot"),
        (F.col("batch_pos").cast("decimal(19,0)") * F.lit(str(10**19)).cast("decimal(20,0)") + F.col("price_cents").cast("decimal(19,0)")).alias("at"),
    ).repartition(*KEY, "_slot")
    batch = [*KEY, "_slot", "batch_ts"]
    firsts = rows.withColumn("a", F.min_by("price_cents", "at").over(Window.partitionBy(*batch)))
    other = F.col("price_cents") != F.col("a")
    batches = firsts.groupBy(*batch).agg(
        F.min("a").alias("a"), F.min_by(F.when(other, F.col("price_cents")), F.when(other, F.col("at"))).alias("b")
    )
    steps = batches.groupBy(*KEY, "_slot").agg(F.array_sort(F.collect_list(F.struct("batch_ts", "a", "b"))).alias("steps"))
    start = F.col("steps")[0]
    ends = F.aggregate(
        F.slice("steps", 2, F.size("steps")),
        F.struct(F.coalesce(start["b"], start["a"]).alias("y"), start["a"].alias("z")),
        lambda at, step: F.struct(_after(at["y"], step).alias("y"), _after(at["z"], step).alias("z")),
    )
    return steps.select(*KEY, "_slot", "steps", start["a"].alias("x"), ends.alias("ends"))


def price_points(sightings: DataFrame, params: Params = Params()) -> DataFrame:
    """Change log: a price is recorded when it differs from the last recorded one.

    A batch records at most one point per listing: its first price that differs
    from the last recorded price. So of each batch only the first price (a) and
    the first other price (b) matter. Whether a slot starts with its own first price
    recorded follows from the slot before: that is either given (set), or as it was there
    (keep), or the reverse (flip), so it is a running parity over one row per slot.
    The busiest listing spreads over its slots. The slots are read twice from one shuffle.
    """
    slots = _slots(sightings, params)
    in_order = Window.partitionBy(*KEY).orderBy("_slot")
    if_was, if_not = (F.coalesce(F.lag(f"ends.{end}").over(in_order) == F.col("x"), F.lit(False)) for end in "yz")
    marked = slots.select(*KEY, "_slot", "x", F.when(if_was == if_not, if_was).alias("set"), (if_not & ~if_was).cast("int").alias("flip"))
    running = in_order.rowsBetween(Window.unboundedPreceding, 0)
    flips = F.sum("flip").over(running)
    counted = marked.withColumn("flips", flips).withColumn("flips_at_set", F.when(F.col("set").isNotNull(), F.col("flips")))
    since = F.col("flips") - F.last("flips_at_set", True).over(running)
    known = counted.select(*KEY, "_slot", (F.last("set", True).over(running) != (since % 2 == 1)).alias("starts_recorded"))

    def scan(at: Column, step: Column) -> Column:
        price = F.when(at["recorded"].eqNullSafe(step["a"]), step["b"]).otherwise(step["a"])
        point = F.struct(step["batch_ts"].alias("observed_at"), price.alias("price_cents"))
        return F.struct(
            F.coalesce(price, at["recorded"]).alias("recorded"),
            F.when(price.isNull(), at["points"]).otherwise(F.concat(at["points"], F.array(point))).alias("points"),
        )

    points = F.aggregate(
        "steps",
        F.struct(
            F.when(F.col("starts_recorded"), F.col("x")).alias("recorded"),
            F.array().cast("array<struct<observed_at:timestamp,price_cents:bigint>>").alias("points"),
        ),
        scan, lambda at: at["points"],
    )
    # Null-safe, so that no filter is pushed into one reader of the shuffle only.
    named = known.withColumnsRenamed({k: f"_of_{k}" for k in [*KEY, "_slot"]})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in [*KEY, "_slot"]]
    return slots.join(named, same).select(*KEY, F.inline(points)).select(listing_id(), *KEY, "observed_at", "price_cents")


def first_prices(points: DataFrame) -> DataFrame:
    """Earliest recorded price of each listing."""
    return points.groupBy("listing_id").agg(
        F.min(F.struct("observed_at", "price_cents"))["price_cents"].alias("first_price_cents")
    )
