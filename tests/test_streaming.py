"""Several micro-batches give what one batch run gives."""

import random
from collections import defaultdict
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fairtag import schemas
from fairtag.operators import fold, market
from fairtag.params import Params
from fairtag.streaming import alerting, changelog, folding
from tests.test_fold import frame, sightings


@pytest.fixture()
def files(spark, tmp_path):
    """Sightings in four files, in order of time."""
    rows = sorted(sightings(21, n=300), key=lambda r: (r[14], r[15]))
    step = len(rows) // 4 + 1
    for i in range(4):
        frame(spark, rows[i * step:(i + 1) * step]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return frame(spark, rows), str(tmp_path / "in"), tmp_path


def source(spark, path):
    return spark.readStream.schema(schemas.SIGHTING).option("maxFilesPerTrigger", 1).parquet(path)


def drain(writer, folder):
    writer.option("checkpointLocation", str(folder)).trigger(availableNow=True).start().awaitTermination()


def test_streamed_fold_equals_batch_fold(spark, files):
    whole, path, tmp = files
    as_of = F.lit("2024-01-08").cast("timestamp")
    drain(folding.fold_stream(source(spark, path), str(tmp / "folds")), tmp / "ck")
    expected = sorted(map(str, fold.fold(whole, as_of).select("listing_id", "title", "seen_count", "first_seen", "disappeared_at").collect()))

    def read(folder):
        return sorted(map(str, folding.read_fold(spark, folder, as_of).select("listing_id", "title", "seen_count", "first_seen", "disappeared_at").collect()))

    assert read(str(tmp / "folds")) == expected


def test_folders_stay_few_and_retries_count_once(spark, files):
    whole, _, tmp = files
    rows = [frame(spark, [tuple(r) for r in part]) for part in _parts(whole.collect(), 18)]
    store = folding.folds(str(tmp / "folds"), fan=3)
    as_of = F.lit("2024-01-08").cast("timestamp")
    read = lambda: sorted(map(str, folding.read_fold(spark, str(tmp / "folds"), as_of).collect()))
    for n, part in enumerate(rows):
        if n == 7:
            # A try that failed before its version was written, then one that is repeated after it.
            fold.partial_fold(rows[0]).write.parquet(store.folder(0, n, n))
        store.add(fold.partial_fold(part), n)
        if n in (2, 7):
            store.add(fold.partial_fold(part), n)
        assert len(store.live(spark)) <= 2 * 3
    # 18 = 2 * 9 + 0 * 3 + 0: two folders of the second level, and what the version before still names.
    assert len(store.live(spark)) == 2
    assert read() == sorted(map(str, fold.fold(whole, as_of).collect()))
    assert len(list((tmp / "folds").glob("level=*/batches=*"))) <= 8 and len(list((tmp / "folds" / "manifest").glob("v=*"))) == 2


def _parts(rows, n):
    return [rows[i::n] for i in range(n)]


def test_distributions_follow_additions_and_retractions(spark, tmp_path):
    rng = random.Random(3)
    schema = "category string, product_id string, adjusted_cents long, sold boolean, weight double"
    sample = lambda: ("c", rng.choice("abcd"), rng.randrange(100, 140), rng.random() < 0.3)
    rows = [(*s, 2.0 if s[3] else 1.0) for s in (sample() for _ in range(200))]
    frames = [spark.createDataFrame(r, schema) for r in (rows[:120], rows[40:160], rows[90:], [r for r in rows[90:] if r[1] != "d"])]
    before = frames[0].limit(0)
    for after in frames:
        folding.sample_changes(before, after).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        before = after
    arriving = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(folding.distribution_stream(arriving, str(tmp_path / "ladders"), fan=2), tmp_path / "ck")
    got = sorted(map(str, folding.read_distributions(spark, str(tmp_path / "ladders")).collect()))
    want = market.distributions_from(market.climb(market.sample_ladder(frames[-1])))
    assert got == sorted(map(str, want.collect())) and len(got) == 3


def test_streamed_change_log_equals_batch(spark, files):
    whole, path, tmp = files
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = changelog.listing_changes(source(spark, path), Params(cycle_minutes=6 * 60))
    drain(stream.writeStream.format("parquet").option("path", str(tmp / "out")).outputMode("append"), tmp / "ck")
    changes = spark.read.parquet(str(tmp / "out"))
    got = sorted((r.site_listing_id, r.observed_at, r.price_cents) for r in changes.filter("change = 'price'").collect())
    assert got == sorted((r.site_listing_id, r.observed_at, r.price_cents) for r in fold.price_points(whole).collect())


def test_many_listings_share_state_rows(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "site string, site_listing_id string, batch_ts timestamp, batch_pos long, price_cents long"
    ids = [("s", str(i)) for i in range(3000)] + [("t", "0"), ("s", None), (None, "0")]
    days = {"2024-01-01": ids, "2024-01-05": ids[::2], "2024-01-09": ids[:1]}
    for day, seen in days.items():
        rows = spark.createDataFrame([(*x, i, 5 if i % 3 else None) for i, x in enumerate(seen)], "site string, site_listing_id string, batch_pos long, price_cents long")
        rows.withColumn("batch_ts", F.lit(day).cast("timestamp")).select(*(c.split()[0] for c in schema.split(", "))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    writer = changelog.listing_changes(arriving, Params(cycle_minutes=6 * 60)).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    query = writer.outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = [x["stateOperators"][0]["numRowsTotal"] for x in query.recentProgress]
    # The three sites have a state row of a bucket each at most, whatever the listings are.
    assert len(rows) >= 3 and 0 < max(rows) <= changelog.BUCKETS + 2
    got = spark.read.parquet(str(tmp_path / "out")).selectExpr("site", "site_listing_id", "change", "CAST(CAST(observed_at AS DATE) AS STRING) AS day", "price_cents")
    # The newest sighting is of the ninth: those of the fifth are four days older, the watermark trails by one.
    want = [(*x, "price", "2024-01-01", 5) for i, x in enumerate(ids) if i % 3]
    want += [(*x, "price", "2024-01-05", 5) for i, x in enumerate(ids[::2]) if i % 3 and not (2 * i) % 3]
    want += [(*x, "gone", "2024-01-01", None) for x in ids[1::2]] + [(*x, "gone", "2024-01-05", None) for x in ids[::2][1:]]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


class State(SimpleNamespace):
    """What a bucket's state holds between its micro-batches."""

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, value):
        self.get, self.exists = value, True

    def setTimeoutTimestamp(self, at):
        assert at >= self.watermark
        self.timeout = at


def changes_one_by_one(batches, grace):
    """(listing, time, price or none) of each micro-batch, one listing and batch after another."""
    recorded, recorded_at, last_seen, live = {}, {}, {}, set()
    for rows, watermark in batches:
        found, priced = [], defaultdict(lambda: defaultdict(list))
        for name, at, pos, price in rows:
            if at > last_seen.get(name, at - 1):
                last_seen[name] = at
                live.add(name)
            if price != changelog._NONE:
                priced[name][at].append((pos, price))
        for name, ats in priced.items():
            for at in sorted(ats):
                price = next((p for _, p in sorted(ats[at]) if p != recorded.get(name)), None)
                if price is not None and at != recorded_at.get(name):
                    recorded[name], recorded_at[name] = price, at
                    found.append((name, at, price))
        for name in sorted(live, key=str):
            if (last_seen[name] + grace) // 1000 <= watermark:
                live.remove(name)
                found.append((name, last_seen[name], None))
        yield sorted(found, key=str), bool(live)


@pytest.mark.parametrize("held", [5, 500_000])
def test_change_log_of_a_bucket_equals_one_listing_after_another(monkeypatch, held):
    monkeypatch.setattr(changelog, "_HELD", held)
    hour = 3_600_000_000
    for seed in range(60):
        rng = random.Random(seed)
        names = [None, *"abcdefg"[:rng.randrange(1, 8)]]
        # Few times and prices: batches of several prices, batches that come again later, returns after a listing was gone.
        batches, watermark = [], 0
        for k in range(6):
            ats = [hour * (50 * k + rng.randrange(-30 if k else 1, 60)) + rng.randrange(3) * 400 for _ in range(rng.randrange(1, 25))]
            rows = [(rng.choice(names), at, pos, rng.choice([changelog._NONE, 1, 2, 3])) for pos, at in enumerate(ats) if at > watermark * 1000]
            rng.shuffle(rows)
            batches.append((rows, watermark))
            watermark = max(watermark, max(ats) // 1000 - 24 * hour // 1000)
        batches.append(([], watermark))
        state, changes = State(exists=False, get=None, timeout=None), changelog.ListingChanges(24)
        for (rows, state.watermark), (want, live) in zip(batches, changes_one_by_one(batches, 24 * hour)):
            state.hasTimedOut, state.timeout = not rows, None
            columns = ["site_listing_id", "at", "pos", "price"]
            chunks = [pd.DataFrame(rows[i:i + 7], columns=columns).astype({c: "int64" for c in columns[1:]}) for i in range(0, len(rows), 7)]
            got = []
            for frame in changes((0, "s"), iter(chunks), state):
                assert set(frame["site"]) == {"s"}
                for lists in zip(frame["site_listing_id"], frame["observed_us"], frame["price_cents"]):
                    got += [(None if pd.isna(name) else name, int(at), None if price == changelog._NONE else int(price)) for name, at, price in zip(*lists)]
            assert sorted(got, key=str) == want
            assert (state.timeout is not None) == live


def test_first_two_prices_in_any_order():
    rng = random.Random(1)
    for _ in range(500):
        rows = list({rng.randrange(30): rng.randrange(4) for _ in range(rng.randrange(1, 12))}.items())
        first = changelog.FirstTwo()
        for pos, price in rng.sample(rows, len(rows)):
            first.add(pos, price)
        for recorded in (None, 0, 1, 2, 3):
            assert first.first_but(recorded) == next((price for _, price in sorted(rows) if price != recorded), None)


def test_alerts_once_across_micro_batches(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([("a", 10.0, 50.0), ("b", 10.0 + i, 50.0), ("c", 1.0, 10.0)], "listing_id string, price_eur double, score double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    deals = spark.readStream.schema("listing_id string, price_eur double, score double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(alerting.fresh_deals_stream(deals).writeStream.format("parquet").option("path", str(tmp_path / "out")), tmp_path / "ck")
    got = sorted((r.listing_id, r.alert_cents) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 1000), ("b", 1000), ("b", 1100), ("b", 1200)]
