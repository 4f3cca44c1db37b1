"""The whole run on an even market of catalog cards with one planted bargain each."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fairtag import schemas
from fairtag.plans.cycle import run_cycle, search, value_ranking

NOW = datetime(2024, 6, 1)
# Every ninth card of the catalog is on the market, at a street price that falls with its place.
STEP, ADS, SALES = 9, 24, 5


def street(pos):
    return 900 - 10 * pos


def seen(key, title, cents, posted, last=NOW, pos=0, pro=False):
    return ("ads", key, "gpu", f"https://ads.example/{key}", title, "", cents, "EUR", "Porto", "u", pro, 1, posted, None, last, pos)


@pytest.fixture(scope="module")
def traded(gpu):
    return [r for r in gpu.products.orderBy("pos").collect() if r.pos % STEP == 0]


@pytest.fixture(scope="module")
def sightings(traded):
    rows = []
    for card in traded:
        euros = street(card.pos)
        # Asking prices climb evenly from 12 % under the street price to 11 % over it; posted over five weeks.
        for i in range(ADS):
            rows.append(seen(f"{card.product_id}-{i}", card.label, euros * (88 + i), NOW - timedelta(days=1 + 1.4 * i)))
        # Sold: seen for half a day, a week ago.
        for i in range(SALES):
            start = NOW - timedelta(days=7, hours=i)
            rows.append(seen(f"{card.product_id}-sold{i}", card.label, euros * 97, start, start))
            rows.append(seen(f"{card.product_id}-sold{i}", card.label, euros * 96, start, start + timedelta(hours=12), 1))
        rows.append(seen(f"{card.product_id}-bargain", card.label, euros * 65, NOW - timedelta(hours=3)))
        rows.append(seen(f"{card.product_id}-shop", card.label, euros * 40, NOW, pro=True))
    first = traded[0].label
    rows += [seen("noise0", f"Busco {first}", 5000, NOW), seen("noise1", f"{first} averiada", 5000, NOW), seen("noise2", "Estante de pinho", 5000, NOW)]
    return rows


@pytest.fixture(scope="module")
def cycle(spark, gpu, traded, sightings):
    nothing = spark.createDataFrame([], schemas.NORMALIZED)
    shop_price = 2 * street(0) * 100
    retail = spark.createDataFrame([("gpu", traded[0].product_id, "shop", NOW.date(), shop_price, "u", True)], schemas.RETAIL_PRICE)
    alerted = spark.createDataFrame([], "listing_id string, alert_cents bigint, score double")
    as_of = F.lit(NOW).cast("timestamp")
    run = run_cycle(spark.createDataFrame(sightings, schemas.SIGHTING), nothing, gpu, retail, alerted, as_of, ["chat"])
    return run, retail, as_of


def test_bargains_surface_and_noise_does_not(cycle, traded):
    run, _, _ = cycle
    found = run.deals.collect()
    best_of = {c.product_id: next((r.listing_id for r in found if r.product_id == c.product_id), None) for c in traded}
    assert best_of == {c.product_id: f"ads/{c.product_id}-bargain" for c in traded}
    assert not any(word in r.listing_id for r in found for word in ("noise", "shop", "sold"))
    best = next(r for r in found if r.product_id == traded[0].product_id)
    assert best.retail_eur == 2.0 * street(0) and f"{SALES} comparable sales observed" in best.reasons and "posted in the last 48h" in best.reasons
    assert {r.listing_id for r in run.fresh.collect()} == {r.listing_id for r in found if r.score >= 45}
    kinds = {r.match_kind: r["count"] for r in run.normalized.groupBy("match_kind").count().collect()}
    assert kinds == {"excluded": 2, "none": 1, "rule": len(traded) * (ADS + SALES + 2)}
    assert run.unmatched.first().sample_title == "Estante de pinho"


def test_a_second_run_alerts_nothing_new(spark, gpu, cycle):
    run, retail, as_of = cycle
    from fairtag.operators import alerts

    again, log = alerts.push_new_deals(run.deals, run.alerted, ["chat"])
    assert again.count() == 0 and log.count() == run.alerted.count()


def test_value_ranking_and_search(spark, gpu, cycle, traded):
    run, retail, as_of = cycle
    rows = value_ranking(run, gpu, retail, as_of).collect()
    ranked = [r for r in rows if r.cost_per_point is not None]
    with_index = {c.product_id for c in traded if c.attributes.get("perf_index")}
    assert len(rows) == gpu.products.count() and rows[-1].cost_per_point is None
    assert {r.product_id for r in ranked} >= with_index and ranked[0].value_index == 100.0
    assert [r.cost_per_point for r in ranked] == sorted(r.cost_per_point for r in ranked)
    key = f"{traded[0].product_id}-bargain"
    wanted = spark.createDataFrame([("noise2",), (key,)], "site_listing_id string")
    cheap, shelf = sorted(search(wanted, run, gpu, as_of).collect(), key=lambda r: r.match_kind, reverse=True)
    assert cheap.product_label == traded[0].label and cheap.pct_rank < 0.05 and cheap.vs_median > 30
    assert (shelf.match_kind, shelf.pct_rank, shelf.confidence) == ("none", None, "none")
