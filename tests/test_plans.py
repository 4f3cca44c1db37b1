"""Plans that must hold at scale: first and last rows by hash aggregates, no Python in the classifier, few shuffles."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fairtag.functions.ordered import extreme_rows, extremes, gathered_extremes, packed
from fairtag.operators import classify as cls
from fairtag.operators import compare, fold, retail
from fairtag.session import cut_lineage, spread
from tests.test_fold import frame, sightings

START = datetime(2024, 1, 1)
OFFER = "category string, product_id string, source string, observed_on date, price_eur double, seq long, url string, in_stock boolean"
DAILY = "category string, product_id string, source string, observed_on date, price_cents long, url string, in_stock boolean, run_ts timestamp"
QUEUE = "category string, title_hash string, sample_title string, occurrences long, first_seen timestamp, last_seen timestamp, resolved boolean"
LIVE = (
    "category string, product_id string, listing_id string, url string, adjusted_cents long, match_kind string, seller_is_pro boolean, "
    "disappeared_at timestamp"
)
TITLED = "listing_id string, category string, match_kind string, normalized_title string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    titled = empty(TITLED)
    now = F.lit(START)
    return {
        "ING-1": fold.partial_fold(frame(spark, sightings(1))), "ING-1 merged": fold.merge_folds(fold.partial_fold(frame(spark, sightings(1)))),
        "RET-2": retail.cheapest_offers(empty(OFFER)), "RET-3": retail.upsert_daily(empty(DAILY), empty(DAILY)),
        "CMP-1": compare.best_active(empty(LIVE)),
        "CLS-10": cls.unmatched_titles(titled, empty("listing_id string, title string"), now),
        "CLS-10 merged": cls.merge_unmatched(empty(QUEUE), empty(QUEUE)),
    }


def test_first_and_last_need_no_sort_aggregate(plans):
    for name, df in plans.items():
        assert "SortAggregate" not in plan(df), name
        assert "HashAggregate" in plan(df), name


def test_fuzzy_matching_needs_no_python_worker(spark):
    products = spark.createDataFrame([(0, "a", [], ["foo bar"])], "pos int, product_id string, none_of array<string>, aliases array<string>")
    text = plan(cls.fuzzy_match(spark.createDataFrame([("foo",)], "normalized_title string"), products))
    assert "EvalPython" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_extremes_against_a_plain_loop(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        at = START + timedelta(minutes=rng.randrange(40)) if rng.random() < 0.9 else None
        rows.append((rng.choice(["a", "b", None]), at, rng.randrange(5), rng.choice([None, "x", "y", "z"]), i))
    df = spark.createDataFrame(rows, "k string, ts timestamp, pos long, text string, n long")
    at = packed(F.col("ts"), F.col("pos"))
    picks = {
        "oldest": ("min", at, F.struct("ts", "pos", "text")),
        "newest": ("max", F.when(F.col("text").isNotNull(), at), F.struct("ts", "pos", "text")),
    }
    out = {r.k: (r.n, tuple(r.oldest), tuple(r.newest)) for r in extremes(df, ["k"], picks, n=F.count(F.lit(1))).collect()}
    order = lambda r: (r[1] is not None, r[1] or START, r[2])
    sort = lambda r: (r[3] is not None, r[3] or "")
    for k in ("a", "b", None):
        own = [r for r in rows if r[0] == k]
        least = min(own, key=lambda r: (order(r), sort(r)))
        most = max((r for r in own if r[3]), key=lambda r: (order(r), sort(r)))
        assert out[k] == (len(own), least[1:4], most[1:4])
    first = {r.k: r.n for r in extreme_rows(df, ["k"], F.col("pos"), [F.col("n")]).collect()}
    assert first == {k: min((r[2], r[4]) for r in rows if r[0] == k)[1] for k in ("a", "b", None)}


@pytest.mark.parametrize("how", ["min", "max"])
@pytest.mark.parametrize("most", [0, 60, 1000])
def test_gathered_extremes_are_extremes(spark, how, most):
    """Whether all, some or none of the keys have too many rows to be gathered; null keys, orders and texts included."""
    rng = random.Random(8)
    rows = [
        (rng.choice(["a", "a", "a", None, *"bcdefg"]), rng.choice([1, 1, None]), rng.choice([None, 1, 2, 3]) if i % 2 else 3, rng.choice([None, "x", "y"]), i)
        for i in range(600)
    ]
    rows += [("only", 1, None, "x", 600), ("one", 1, 5, None, 601)]
    df = spark.createDataFrame(rows, "k string, l int, at long, text string, n long")
    picks = {"best": (how, F.col("at"), F.struct("text", "at"))}
    totals = {"n": F.count(F.lit(1)), "least": F.min("n")}
    read = lambda out: sorted(map(str, out.select("k", "l", "n", "least", "best").collect()))
    found = read(gathered_extremes(df, ["k", "l"], picks, most, **totals))
    assert found == read(extremes(df, ["k", "l"], picks, **totals)) and not any("'only'" in r for r in found)
    text = lambda r: (r[3] is not None, r[3] or "")
    ends = {"min": min, "max": max}
    loop = []
    for key in {r[:2] for r in rows}:
        own = [r for r in rows if r[:2] == key]
        if ordered := [r for r in own if r[2] is not None]:
            end = ends[how](ordered, key=lambda r: (r[2], text(r)))
            loop.append((*key, len(own), own[0][4], end[3], end[2]))
    out = gathered_extremes(df, ["k", "l"], picks, most, **totals).select("k", "l", "n", "least", "best.text", "best.at").collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, loop))


def test_the_rows_of_a_day_travel_once_and_meet_in_no_join(spark):
    day = [("c", f"p{i % 50}", "s", START.date(), i, f"u{i}", True, START) for i in range(200)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        merged = retail.upsert_daily(spark.createDataFrame(day[:100], DAILY), spark.createDataFrame(day[100:], DAILY))
        assert exchanges(merged) == 1 and "SortMergeJoin" not in plan(merged).split("== Initial Plan ==")[0]
        assert {(r.product_id, r.price_cents, r.url) for r in merged.collect()} == {
            (f"p{i}", i, max(f"u{j}" for j in range(i, 200, 50))) for i in range(50)
        }
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_joined_extremes_sort_by_a_number_first(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert re.search(r"Sort \[xxhash64\(_key", plan(fold.partial_fold(frame(spark, sightings(1)))))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_sighting_repeated_many_times_is_kept_once(spark):
    row = ("s", "k", "c", "u", "t", "d", 5, "EUR", None, None, False, 1, None, None, START, 3)
    out = fold.partial_fold(frame(spark, [row] * 500)).collect()
    assert len(out) == 1 and out[0].seen_count == 500 and out[0].newest.title == "t" and out[0].priced.price_cents == 5


def test_the_change_log_takes_three_shuffles(spark):
    points = fold.price_points(frame(spark, sightings(2)))
    points.collect()
    final = plan(points).split("== Initial Plan ==")[0]
    # The third is a broadcast on so few rows.
    assert len(re.findall(r"- (?:Broadcast)?Exchange ", final)) == 3 and "ReusedExchange" in final


def test_a_cut_lineage_is_compressed_and_a_single_row_group_is_dealt_out(spark):
    rows = spark.range(1000).coalesce(1).selectExpr("id", "repeat('long text ', 100) AS text")
    cut = cut_lineage(rows)
    assert "FileScan parquet" in plan(cut) and "id" in plan(cut.select("id")) and "text" not in plan(cut.select("id")).split("ReadSchema")[1]
    dealt = spread(rows.select("id")).rdd.glom().map(len).collect()
    assert sum(dealt) == 1000 and max(dealt) < 1000


def test_packed_vectors_are_not_broadcast(spark):
    from fairtag.llm.top_k import top_k

    rng = random.Random(7)
    vectors = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)], "vec_id long, embedding array<double>")
    found = top_k(vectors.where("vec_id % 20 = 0"), vectors)
    assert "SortMergeJoin" in plan(found) and "BroadcastHashJoin" not in plan(found)
    # Annuli of one vector each: a query that met fewer than k has no bound.
    assert found.count() == 15


def test_offers_are_read_once(spark):
    from fairtag.operators import retail
    from fairtag.sources.catalog import Catalog

    products = spark.createDataFrame(
        [("c", 0, "p", "p", ["card"], [], [], [])],
        "category string, pos int, product_id string, label string, all array<string>, any_of array<string>, none_of array<string>, aliases array<string>",
    )
    offers = spark.createDataFrame([("1", "card", 2.0), ("2", "hat", 3.0)], "offer_id string, name string, price_eur double")
    out = retail.classify_offers(offers.repartition(3), Catalog("c", products, []))
    assert "RoundRobin" not in plan(out) and [r.offer_id for r in out.collect()] == ["1"]


def exchanges(df):
    df.collect()
    return len(re.findall(r"- Exchange ", plan(df).split("== Initial Plan ==")[0]))


def test_first_and_last_rows_travel_once(spark):
    """Keys with their orders twice, whole rows once."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert exchanges(fold.partial_fold(frame(spark, sightings(1)))) == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shuffle_files_go_with_their_query(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: sum(b.isShuffle() for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllBlocks()))
    left = files()
    df = spark.range(1000).selectExpr("id", "id % 7 AS k").repartition(5, "k").groupBy("k").count()
    cut_lineage(df)
    for _ in range(2):  # a query that runs again makes them again
        assert len(df.collect()) == 7
    assert files() <= left
