"""The fold and the change log against a sighting-by-sighting replay."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fairtag import schemas
from fairtag.operators import fold
from fairtag.params import Params

START = datetime(2024, 1, 1)


def sightings(seed, n=400, listings=6, batches=40):
    rng = random.Random(seed)
    rows = []
    for pos in range(n):
        hot = rng.random() < 0.4
        key = "hot" if hot else f"l{rng.randrange(listings)}"
        at = START + timedelta(hours=5 * rng.randrange(batches))
        price = rng.choice([None, 500, 650, 700])
        posted = at - timedelta(days=rng.randrange(9)) if rng.random() < 0.3 else None
        text = rng.choice(["", f"d{pos}"])
        rows.append(("s", key, f"c{pos % 2}", f"u{pos}", f"t{pos}", text, price, "EUR", None, None, False, pos % 4, posted, None, at, pos))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, schemas.SIGHTING)


def replay(rows):
    """Listings and price points as a row-by-row upsert would leave them."""
    state, points = {}, []
    for row in sorted(rows, key=lambda r: (r[14], r[15])):
        key, price, posted, at = row[1], row[6], row[12], row[14]
        old = state.get(key)
        if old is None:
            old = state[key] = {"first": min(posted or at, at), "n": 0, "category": row[2], "desc": "", "new": at}
        old["first"] = min(old["first"], posted or old["first"])
        old.update(n=old["n"] + 1, last=at, title=row[4], price=price, desc=row[5] or old["desc"])
        mine = [p for p in points if p[0] == key]
        if price is not None and (not mine or (mine[-1][2] != price and mine[-1][1] != at)):
            points.append((key, at, price))
    return state, points


def test_fold_and_change_log_match_a_replay(spark):
    for seed in range(3):
        rows = sightings(seed)
        state, points = replay(rows)
        df = frame(spark, rows)
        listings = fold.fold(df, F.lit("2024-02-01").cast("timestamp")).collect()
        got = {
            r.site_listing_id: {
                "first": r.first_seen, "n": r.seen_count, "category": r.category, "desc": r.description,
                "new": r.discovered_at, "last": r.last_seen, "title": r.title, "price": r.price_cents,
            } for r in listings
        }
        assert got == state
        logged = fold.price_points(df, Params(slot_minutes=24 * 60)).collect()
        assert sorted((r.site_listing_id, r.observed_at, r.price_cents) for r in logged) == sorted(points)


def test_partial_folds_merge_in_any_order(spark):
    rows = sightings(9)
    whole = fold.finish_fold(fold.partial_fold(frame(spark, rows)))
    random.Random(1).shuffle(rows)
    parts = [fold.partial_fold(frame(spark, rows[i::3])) for i in range(3)]
    left = fold.merge_folds(fold.merge_folds(parts[0].union(parts[1])).union(parts[2]))
    right = fold.merge_folds(parts[2].union(fold.merge_folds(parts[1].union(parts[0]))))
    expected = sorted(map(str, whole.collect()))
    assert sorted(map(str, fold.finish_fold(left).collect())) == expected
    assert sorted(map(str, fold.finish_fold(right).collect())) == expected


def test_round_trip_is_fully_recorded(spark):
    rows = [("s", "a", "c", "u", "t", "", p, "EUR", None, None, False, 0, None, None, START + timedelta(hours=i), 0)
            for i, p in enumerate([700, 650, 650, None, 700])]
    logged = fold.price_points(frame(spark, rows)).orderBy("observed_at").collect()
    assert [r.price_cents for r in logged] == [700, 650, 700]


def test_gone_and_back(spark):
    rows = [("s", "a", "c", "u", "t", "", 1, "EUR", None, None, False, 0, None, None, START, 0)]
    later = F.lit("2024-01-01 07:00").cast("timestamp")
    gone = fold.fold(frame(spark, rows), later).first()
    assert gone.disappeared_at == START
    again = rows + [rows[0][:14] + (START + timedelta(hours=5), 1)]
    assert fold.fold(frame(spark, again), later).first().disappeared_at is None
    assert Params().grace_hours == 6 and Params(cycle_minutes=180).grace_hours == 12
