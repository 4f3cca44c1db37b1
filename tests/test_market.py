"""Percentiles and ranks against brute force, a third of the samples on one product."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairtag.operators import deals, market
from fairtag.params import Params

QS = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


def percentile(pairs, q):
    """Where the weights that run up over the sorted values, joined by straight lines, reach the share ``q``."""
    values, weights = np.array(sorted(pairs)).T
    return np.interp(q * weights.sum(), weights.cumsum(), values)


def rank(pairs, value):
    below = sum(w for v, w in pairs if v < value) + sum(w for v, w in pairs if v == value) / 2
    return below / sum(w for _, w in pairs)


def sampled(seed, n=600):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        product = "hot" if i % 3 == 0 else f"p{rng.randrange(12)}"
        rows.append(("c", product, str(i), rng.choice([rng.randrange(90, 110), rng.randrange(1, 10**6)]) * 100, rng.random() < 0.3))
    return rows


SCHEMA = "category string, product_id string, listing_id string, adjusted_cents bigint, sold boolean"


@pytest.mark.parametrize("weight", [2.0, 3.0, 0.5])
def test_distribution_matches_brute_force(spark, weight):
    rows, params = sampled(5), Params(sold_weight=weight)
    found = market.distributions_from(market.climb(market.sample_ladder(spark.createDataFrame(rows, SCHEMA))), params)
    got = {r.product_id: r for r in found.collect()}
    for product in {r[1] for r in rows}:
        pairs = [(r[3] / 100, weight if r[4] else 1.0) for r in rows if r[1] == product]
        assert got[product].n == len(pairs)
        assert got[product].mean == pytest.approx(sum(v * w for v, w in pairs) / sum(w for _, w in pairs))
        values = [got[product][name] for name in QS]
        assert values == pytest.approx([percentile(pairs, q) for q in QS.values()])
        assert values == sorted(values)


def test_mid_rank_matches_brute_force(spark):
    rows = sampled(6)
    df = spark.createDataFrame(rows, SCHEMA)
    probes = spark.createDataFrame(
        [("c", p, c) for p in ("hot", "p1", "nowhere") for c in (1, 9_500, 10_000, 10_010, 10**9)],
        "category string, product_id string, adjusted_cents bigint",
    )
    for r in market.rank_prices(df, probes).collect():
        pairs = [(x[3], 2.0 if x[4] else 1.0) for x in rows if x[1] == r.product_id]
        expected = rank(pairs, r.adjusted_cents) if pairs else 0.5
        assert r.pct_rank == pytest.approx(expected) and 0 <= r.pct_rank <= 1


def test_single_and_missing_samples(spark):
    df = spark.createDataFrame([("c", "a", "1", 31750, False)], SCHEMA)
    products = spark.createDataFrame([("c", "a"), ("c", "b")], "category string, product_id string")
    got = {r.product_id: r for r in market.distributions(df, products).collect()}
    assert [got["a"][q] for q in QS] == [317.5] * 5
    assert got["b"].n == 0 and got["b"].p50 == 0.0 and got["b"].mean == 0.0 and got["b"].confidence == "none"


def test_interpolation_between_samples(spark):
    df = spark.createDataFrame([("c", "a", str(i), c * 100, False) for i, c in enumerate((100, 200, 300))], SCHEMA)
    assert market.distributions_from(market.climb(market.sample_ladder(df))).first().p50 == 150.0


@pytest.mark.parametrize("n,tier", [(0, "none"), (3, "none"), (4, "low"), (7, "low"), (8, "medium"), (14, "medium"), (15, "high"), (900, "high")])
def test_confidence(spark, n, tier):
    assert spark.range(1).select(market.confidence_tier(F.lit(n)).alias("t")).first().t == tier


def test_histogram_covers_all_values(spark):
    rng = random.Random(9)
    values = [round(rng.lognormvariate(5, 1), 2) for _ in range(400)]
    df = spark.createDataFrame([("c", "a", v, 1) for v in values] + [("c", "b", 31.0, 3)], "category string, product_id string, value double, n bigint")
    bins = market.histogram(df, ["category", "product_id"], "value", "n").orderBy("product_id", "bin").collect()
    a, b = [r for r in bins if r.product_id == "a"], [r for r in bins if r.product_id == "b"]
    assert sum(r["count"] for r in a) == len(values)
    assert a[0].lo == min(values) and a[-1].hi == pytest.approx(max(values))
    for r in a:
        last = r is a[-1]
        assert r["count"] == sum(r.lo - 1e-9 <= v and (v < r.hi - 1e-9 or last) for v in values)
    assert [(r.lo, r.hi, r["count"]) for r in b] == [(31.0, 31.0, 3)]


def test_market_position_is_clamped_and_null_on_a_flat_market(spark):
    df = spark.createDataFrame([(100.0, 500.0, 700.0), (9999.0, 500.0, 700.0), (600.0, 500.0, 500.0)], "v double, p10 double, p90 double")
    at = market.market_position(F.col("v"), F.col("p10"), F.lit(550.0), F.lit(650.0), F.col("p90"))
    got = df.select(at.alias("at")).collect()
    assert got[0]["at"]["value"] == 0 and got[1]["at"]["value"] == 1 and got[2]["at"] is None


def test_score_by_hand(spark):
    args = [F.lit(v) for v in (0.02, 0.58, 0.0, 1.0)]
    row = spark.range(1).select(
        deals.score_parts(*args).alias("raw"), deals.reasons(*args, F.lit(3)).alias("why")
    ).first()
    assert row.raw == pytest.approx(80.942857, abs=1e-6)
    assert row.why == ["cheapest 2% of what's listed", "58% of retail", "posted in the last 48h", "3 comparable sales observed"]
