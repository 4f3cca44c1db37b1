import json
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from fairtag.operators import alerts, feed

SCHEMA = """listing_id string, site string, url string, title string, location string, product_label string, price_eur double,
adjusted_eur double, modifiers array<string>, median_eur double, retail_eur double, retail_ratio double, days_listed double,
sample_size bigint, confidence string, score double, reasons array<string>, cautions array<string>, below_median_pct double, saving_eur double"""
BASE = {
    "site": "ads", "url": "https://ads.example/1", "title": "RTX 4070 Dual", "location": "Faro", "product_label": "GeForce RTX 4070",
    "price_eur": 1400.0, "adjusted_eur": 1300.5, "modifiers": ["sealed_new", "boxed"], "median_eur": 1500.0, "retail_eur": 2000.0,
    "retail_ratio": 0.65, "days_listed": 1.2, "sample_size": 20, "confidence": "high", "score": 70.4, "reasons": ["r1", "r2"],
    "cautions": [], "below_median_pct": 13.3, "saving_eur": 199.5,
}


def deals(spark, *changes):
    names = [f.split()[0] for f in SCHEMA.replace("\n", " ").split(", ")]
    rows = [{**BASE, "listing_id": str(i), **c} for i, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


def messages(spark, df, **options):
    return [json.loads(r.payload) for r in alerts.alert_batches(df, F.lit("2024-01-01").cast("timestamp"), "me", **options).orderBy("batch").collect()]


def test_batches_of_ten_and_one_summary(spark):
    sent = messages(spark, deals(spark, *[{"score": 90.0 - i} for i in range(37)]))
    assert [len(m["embeds"]) for m in sent] == [10, 10, 10, 7]
    assert sent[0]["content"] == "**37 new deals**" and all("content" not in m for m in sent[1:])
    assert all(m["allowed_mentions"] == {"parse": []} and m["username"] == "me" for m in sent)
    assert messages(spark, deals(spark, {}))[0]["content"] == "**1 new deal**"
    assert messages(spark, deals(spark).limit(0)) == []


def test_entry_content_and_limits(spark):
    entry = messages(spark, deals(spark, {"cautions": ["c1", "c2"]}))[0]["embeds"][0]
    assert entry["title"] == "€1,400 · GeForce RTX 4070 · 70/100" and entry["color"] == alerts.COLOR_HOT
    assert entry["description"] == "RTX 4070 Dual\n\nr1 · r2\n\n⚠️ **Caution:** c1; c2\n`sealed new` `boxed`"
    assert {f["name"]: f["value"] for f in entry["fields"]} == {
        "Price": "**€1,400**\n≈€1,300 like-for-like", "vs median": "−13% (€1,500)\nsaves ≈€200", "Market": "n=20\nhigh confidence",
        "vs retail": "65% of €2,000", "Where": "Faro", "Listed": "1 days ago",
    }
    assert entry["footer"] == {"text": "ads · score 70/100"}
    long = messages(spark, deals(spark, {
        "title": "wide " * 90, "product_label": "name " * 70, "reasons": [f"reason {i} " * 30 for i in range(12)], "cautions": [f"caution {i} " * 40 for i in range(9)],
        "retail_ratio": None, "retail_eur": None, "location": None, "score": 50.0,
    }))[0]["embeds"][0]
    assert len(long["title"]) == 256 and len(long["description"]) == 4000 and long["color"] == alerts.COLOR_WARM
    assert [f["name"] for f in long["fields"]] == ["Price", "vs median", "Market", "Listed"]


def test_plain_text(spark):
    first, second = alerts.format_deals(deals(
        spark, {}, {"adjusted_eur": 1400.0, "retail_ratio": None, "modifiers": [], "location": "", "reasons": [], "cautions": ["c"]},
    )).orderBy("listing_id").collect()
    assert first.body.split("\n") == [
        "RTX 4070 Dual", "", "€1,400 (≈€1,300 like-for-like)", "13% below the €1,500 median — saves about €200",
        "n=20 comparable listings (high confidence)", "65% of the €2,000 retail price", "Flags: sealed new, boxed", "Faro · listed 1d ago",
        "", "· r1", "· r2",
    ]
    assert second.body.split("\n")[2:] == ["€1,400", "13% below the €1,500 median — saves about €200", "n=20 comparable listings (high confidence)", "", "Caution: c"]


def test_alert_once_per_listing_and_price(spark):
    log = spark.createDataFrame([("0", 140000, 60.0), ("1", 150000, 60.0)], "listing_id string, alert_cents bigint, score double")
    df = deals(spark, {}, {}, {"score": 44.9}, {"score": 45.0})
    fresh, after = alerts.push_new_deals(df, log, ["chat"])
    assert sorted(r.listing_id for r in fresh.collect()) == ["1", "3"]
    assert sorted((r.listing_id, r.alert_cents) for r in after.collect()) == [("0", 140000), ("1", 140000), ("1", 150000), ("3", 140000)]
    again, _ = alerts.push_new_deals(df, after, ["chat"])
    assert again.count() == 0


def test_nothing_recorded_without_a_channel(spark):
    log = spark.createDataFrame([], "listing_id string, alert_cents bigint, score double")
    fresh, after = alerts.push_new_deals(deals(spark, {}, {}), log, [])
    assert fresh.count() == 0 and after.count() == 0


def test_feed_is_well_formed(spark):
    df = deals(spark, {}, {"title": 'A & "b" <i>x</i> ]]> end', "location": "B & C", "retail_ratio": None, "cautions": ["old & cold"], "score": 60.0}, {"score": 44.0})
    xml = feed.feed_document(feed.deal_feed(df), "Deals & more", "https://x/?a&b", "about").first().xml
    assert "<i>x</i>" not in xml
    root = ET.fromstring(xml.encode())
    items = root.findall("./channel/item")
    assert root.get("version") == "2.0" and len(items) == 2
    assert [i.find("guid").text for i in items] == ["deal-0-140000", "deal-1-140000"] and items[0].find("guid").get("isPermaLink") == "false"
    text = items[1].find("description").text
    assert "A &amp; &quot;b&quot; &lt;i&gt;x&lt;/i&gt; ]]&gt; end" in text and "B &amp; C" in text and "old &amp; cold" in text
    assert "retail price" not in text and "retail price" in items[0].find("description").text
