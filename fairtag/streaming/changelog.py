"""Price changes and disappearances as a stream, with the state of many listings in each state row."""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fairtag.params import Params

# The functions travel to the executors by value, which need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = ["site", "site_listing_id"]
# The listings of a site share state rows by their hash, as a row for each listing would cost a call to Python for each. The
# checkpoint of a stream holds its rows by this number.
BUCKETS = 512
# Changes come back many to a row; a row for each would cost more than the change.
_CHANGES = "site string, site_listing_id array<string>, observed_us array<bigint>, price_cents array<bigint>"
_TO_A_ROW = 256
_STATE = "listings binary, size bigint"
# Stands for null among whole numbers.
_NONE = -(1 << 63)
# Sightings of a bucket that are held before each batch of theirs is cut to its first two prices.
_HELD = 500_000


class FirstTwo:
    """The two prices that come first in a batch, whatever the order they are added in."""

    __slots__ = ("first", "second")

    def __init__(self) -> None:
        self.first: tuple[int, int] | None = None
        self.second: tuple[int, int] | None = None

    def add(self, pos: int, price: int) -> None:
        found = (pos, price)
        if self.first is None or self.first[1] == price:
            self.first = min(self.first or found, found)
        elif found < self.first:
            self.first, self.second = found, self.first
        elif self.second is None or found < self.second:
            self.second = found

    def first_but(self, price: int | None) -> int | None:
        """The first price that is not ``price``."""
        return next((p[1] for p in (self.first, self.second) if p and p[1] != price), None)


class Listings:
    """Of each listing of a bucket the price last recorded, its batch, when it was last seen and whether its timer is set."""

    __slots__ = ("names", "recorded", "recorded_at", "last_seen", "live")

    def __init__(self, state: GroupState) -> None:
        names, numbers = self._unpacked(*state.get) if state.exists else ([], b"")
        self.names = np.array(names, dtype=object)
        # Copied, as the bytes cannot be written to.
        self.recorded, self.recorded_at, self.last_seen, live = np.frombuffer(numbers, np.int64).reshape(4, -1).copy()
        self.live = live > 0

    def packed(self) -> tuple[bytes, int]:
        numbers = np.stack([self.recorded, self.recorded_at, self.last_seen, self.live]).astype(np.int64)
        whole = pickle.dumps((self.names.tolist(), numbers.tobytes()), 5)
        return pa.compress(whole, "zstd", asbytes=True), len(whole)

    @staticmethod
    def _unpacked(packed: bytes, size: int) -> tuple[list, bytes]:
        return pickle.loads(pa.decompress(packed, size, "zstd", asbytes=True))

    def places(self, names: np.ndarray) -> np.ndarray:
        """Where the listings of these names are; new ones are added."""
        known = len(self.names)
        places, self.names = pd.factorize(np.concatenate([self.names, names]), use_na_sentinel=False)
        if more := len(self.names) - known:
            none = np.full(more, _NONE)
            self.recorded, self.recorded_at, self.last_seen = (
                np.concatenate([x, none]) for x in (self.recorded, self.recorded_at, self.last_seen)
            )
            self.live = np.concatenate([self.live, none > 0])
        return places[known:]


def _by_batch(sightings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sightings (places, times, positions, prices) in order, and which of them are of the same batch as the one before."""
    ordered = sightings[:, np.lexsort(sightings[2::-1])]
    again = np.zeros(ordered.shape[1], bool)
    again[1:] = (ordered[:2, 1:] == ordered[:2, :-1]).all(axis=0)
    return ordered, again


def _two_prices(sightings: np.ndarray) -> np.ndarray:
    """Of each batch the first sighting, and the first at another price."""
    ordered, again = _by_batch(sightings)
    starts = np.flatnonzero(~again)
    batch = np.cumsum(~again) - 1
    other = np.flatnonzero(ordered[3] != ordered[3][starts][batch])
    return ordered[:, np.union1d(starts, other[np.unique(batch[other], return_index=True)[1]])]


class ListingChanges:
    """Emits a change with a price when a new one is recorded, without one when a listing stays unseen.

    One point per batch at most: its first price that differs from the last
    recorded one. The newest batch that recorded a point records no second one.
    A late re-sighting simply moves the timer; batches are taken in order of
    their time within each micro-batch.
    """

    def __init__(self, grace_hours: int) -> None:
        self.grace = grace_hours * 3_600_000_000

    def __call__(self, key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        listings = Listings(state)
        changes = [] if state.hasTimedOut else [self._points(listings, chunks)]
        timer = (listings.last_seen + self.grace) // 1000
        due = listings.live & (timer <= state.getCurrentWatermarkMs())
        listings.live &= ~due
        if due.any():
            gone = np.flatnonzero(due)
            changes.append(np.stack([gone, listings.last_seen[gone], np.full(len(gone), _NONE)]))
        state.update(listings.packed())
        if listings.live.any():
            # Goes off once the watermark has passed it.
            state.setTimeoutTimestamp(max(int(timer[listings.live].min()) - 1, 1))
        places, at, price = np.concatenate(changes, axis=1) if changes else np.empty((3, 0), np.int64)
        if len(places):
            columns = {"site_listing_id": listings.names[places], "observed_us": at, "price_cents": price}
            starts = range(0, len(places), _TO_A_ROW)
            rows = {name: [column[i:i + _TO_A_ROW] for i in starts] for name, column in columns.items()}
            yield pd.DataFrame({"site": [key[1]] * len(starts), **rows})

    def _points(self, listings: Listings, chunks: Iterator[pd.DataFrame]) -> np.ndarray:
        """The points (places, times, prices) that the chunks add; the listings are brought up to date."""
        seen, held = listings.last_seen.copy(), [np.empty((4, 0), np.int64)]
        # Chunk by chunk; what is held is whole numbers, two prices of a batch once there are many.
        for chunk in chunks:
            places = listings.places(chunk["site_listing_id"].to_numpy(object))
            at, price = chunk["at"].to_numpy(), chunk["price"].to_numpy()
            seen = np.concatenate([seen, listings.last_seen[len(seen):]])
            np.maximum.at(seen, places, at)
            held.append(np.stack([places, at, chunk["pos"].to_numpy(), price])[:, price != _NONE])
            if sum(x.shape[1] for x in held) > _HELD + held[0].shape[1]:
                held = [_two_prices(np.concatenate(held, axis=1))]
        listings.live |= seen > listings.last_seen
        listings.last_seen = seen
        sightings = np.concatenate(held, axis=1)
        ordered, again = _by_batch(sightings)
        places, at, _, price = ordered
        # Most listings come with a price in each batch; those of more, of none with a time, or of a batch met before go one by one.
        apart = np.zeros(len(seen), bool)
        apart[places[again | (at == _NONE) | (at == listings.recorded_at[places])]] = True
        one_by_one = self._one_by_one(listings, sightings[:, apart[sightings[0]]])
        places, at, price = ordered[[0, 1, 3]][:, ~apart[places]]
        before = np.roll(price, 1)
        first = np.ones(len(places), bool)
        first[1:] = places[1:] != places[:-1]
        before[first] = listings.recorded[places[first]]
        new = price != before
        # Of several values for a place the last one stays.
        listings.recorded[places[new]], listings.recorded_at[places[new]] = price[new], at[new]
        return np.concatenate([np.stack([places, at, price])[:, new], one_by_one], axis=1)

    @staticmethod
    def _one_by_one(listings: Listings, sightings: np.ndarray) -> np.ndarray:
        found: dict[int, dict[float, FirstTwo]] = {}
        untimed = float("nan")
        for place, at, pos, price in sightings.T.tolist():
            # A batch without a time is neither before nor after another.
            found.setdefault(place, {}).setdefault(untimed if at == _NONE else at, FirstTwo()).add(pos, price)
        points = []
        for place, batches in found.items():
            recorded, recorded_at = (None if x == _NONE else int(x) for x in (listings.recorded[place], listings.recorded_at[place]))
            for at in sorted(batches):
                price = batches[at].first_but(recorded)
                if price is not None and at != recorded_at:
                    recorded, recorded_at = price, None if at is untimed else at
                    points.append((place, _NONE if at is untimed else at, recorded))
            listings.recorded[place] = _NONE if recorded is None else recorded
            listings.recorded_at[place] = _NONE if recorded_at is None else recorded_at
        return np.array(points, np.int64).reshape(-1, 3).T


def listing_changes(sightings: DataFrame, params: Params = Params()) -> DataFrame:
    """Change stream of a stream of sightings; event time is the batch time, lateness the grace.

    A listing's rows of one micro-batch pass through one task in chunks; it holds numbers of the sightings of one bucket
    (of each batch among them two at most, once there are many), and the state of its listings.
    """
    whole = lambda value: F.coalesce(value, F.lit(_NONE))
    changes = (
        sightings.withWatermark("batch_ts", f"{params.grace_hours} hours")
        .select(
            F.pmod(F.xxhash64("site_listing_id"), F.lit(BUCKETS)).alias("bucket"), *KEY, "batch_ts",
            whole(F.unix_micros("batch_ts")).alias("at"), whole(F.col("batch_pos").cast("bigint")).alias("pos"),
            whole(F.col("price_cents").cast("bigint")).alias("price"),
        )
        .groupBy("bucket", "site")
        .applyInPandasWithState(
            ListingChanges(params.grace_hours), _CHANGES, _STATE, "append", GroupStateTimeout.EventTimeTimeout
        )
        .select("site", F.inline(F.arrays_zip("site_listing_id", "observed_us", "price_cents")))
    )
    price = F.nullif("price_cents", F.lit(_NONE))
    return changes.select(
        *KEY, F.when(price.isNull(), "gone").otherwise("price").alias("change"),
        F.timestamp_micros(F.nullif("observed_us", F.lit(_NONE))).alias("observed_at"), price.alias("price_cents"),
    )


def live_intervals(sightings: DataFrame, params: Params = Params()) -> DataFrame:
    """Every period a listing was seen without a gap longer than the grace; an extra report."""
    gap = f"{params.grace_hours} hours"
    if sightings.isStreaming:
        sightings = sightings.withWatermark("batch_ts", gap)
    return (
        sightings.groupBy(*KEY, F.session_window("batch_ts", gap).alias("seen"))
        .agg(F.count(F.lit(1)).alias("sightings"))
        .select(
            *KEY, F.col("seen.start").alias("live_from"),
            (F.col("seen.end") - F.expr(f"INTERVAL {gap}")).alias("live_until"), "sightings",
        )
    )
