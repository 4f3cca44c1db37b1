import json

from pyspark.sql import functions as F

from fairtag import schemas
from fairtag.sources import catalog, jsonld, offers


def parse(spark, *ads):
    rows = [(a if isinstance(a, str) else json.dumps(a), "gpu", i) for i, a in enumerate(ads)]
    payloads = spark.createDataFrame(rows, "payload string, category string, batch_pos bigint").withColumn(
        "batch_ts", F.lit("2024-01-01").cast("timestamp")
    )
    return offers.parse_offers(payloads, "ads", "https://ads.example/ad/").orderBy("batch_pos").collect()


def price(value, currency=None, key="price"):
    return {"key": key, "value": {"value": value, "currency": currency}}


def test_offer_fields(spark):
    full, bare = parse(
        spark,
        {
            "id": 17, "url": "https://x", "title": "  RTX 4070\n", "description": "a" * 9000, "business": False,
            "params": [price(1, key="other"), price(399.995, "USD"), price(5)], "user": {"id": 3, "is_business": True},
            "photos": [{"a": 1}, {"b": 2}], "location": {"city": {"name": "Porto"}, "region": {"name": "Norte"}},
            "created_time": "soon", "last_refresh_time": "2024-01-02T03:04:05+01:00",
        },
        {"id": "b", "title": "x"},
        {"title": "no id"}, {"id": 5, "title": "  "}, "not json",
    )
    assert (full.site_listing_id, full.title, len(full.description), full.price_cents, full.currency) == ("17", "RTX 4070", 8000, 40000, "USD")
    assert (full.seller_id, full.seller_is_pro, full.photo_count, full.location) == ("3", True, 2, "Porto, Norte")
    assert str(full.posted_at) == "2024-01-02 02:04:05" and json.loads(full.raw)["id"] == 17
    assert (bare.url, bare.price_cents, bare.currency, bare.location, bare.posted_at) == ("https://ads.example/ad/b", None, "EUR", None, None)
    assert (bare.description, bare.seller_id, bare.seller_is_pro, bare.photo_count) == ("", None, False, 0)


def test_price_parameter(spark):
    values = [price(0), price(1), price("1.01"), price("12,5"), price("x"), price(None), price("1e3"), {"key": "price", "value": "300"}, {"key": "price", "value": [1]}]
    got = parse(spark, *({"id": i, "title": "t", "params": [v]} for i, v in enumerate(values)))
    assert [r.price_cents for r in got] == [None, None, 101, None, None, None, 100000, None, None]


def page(*blocks):
    return "<html>" + "".join(f"<script id=x TYPE='application/ld+json' defer>{b}</script>" for b in blocks) + "</html>"


def found(spark, html):
    df = spark.createDataFrame([("p", html)], "page_id string, html string")
    return jsonld.page_offers(df, ["page_id"]).orderBy("block_no", "node_no").collect()


def test_jsonld_walk(spark):
    deep = {"@type": "Product", "name": "deep", "offers": {"lowPrice": "10"}}
    for _ in range(40):
        deep = {"x": [deep]}
    rows = found(spark, page(
        "{broken",
        json.dumps({"@graph": [
            {"@type": "Product", "name": "outer", "@id": "id1", "offers": [{"price": 0}, {"price": "1299,90", "availability": "http://schema.org/InStock"}],
             "isRelatedTo": {"@type": "ProductGroup", "name": "inner", "url": "u2", "offers": {"price": "5", "availability": "OutOfStock"}}},
            {"@type": ["Product"], "name": "listed type"}, {"@type": "Thing", "name": "by offers", "offers": {"price": 7}},
            {"@type": "Product", "name": "", "offers": {"price": 7}}, {"@type": "Product", "name": "free", "offers": {"price": "1.299,00"}},
            {"@type": "Product", "name": "negative", "offers": {"price": -1}}, {"@type": "Product", "name": "nan", "offers": {"price": "nan"}},
            {"@type": "Product", "name": "zero text", "offers": {"price": "0", "lowPrice": 3}},
        ]}),
        json.dumps(deep),
    ))
    assert [(r.block_no, r.name, r.price_eur, r.url, r.in_stock) for r in rows] == [
        (1, "outer", 1299.9, "id1", True), (1, "inner", 5.0, "u2", False), (1, "by offers", 7.0, "", True), (2, "deep", 10.0, "", True),
    ]
    assert found(spark, "<html>ld+json without a block</html>") == []


def test_catalog_files(spark, tmp_path):
    product = {"category": "bikes", "pos": 0, "product_id": "b1", "all": ["Trek-X5"], "aliases": ["TrekX5"]}
    for table, rows in {
        "products": [product, {"category": "cars", "pos": 0, "product_id": "c1"}],
        "modifiers": [{"category": "bikes", "pos": 0, "modifier_id": "wanted", "patterns": ["^busco"], "exclude": True}],
        "query_terms": [{"category": "bikes", "pos": 0, "term": "trek"}],
    }.items():
        (tmp_path / table).mkdir()
        (tmp_path / table / "good.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "products" / "bad.json").write_text(json.dumps({"category": "bikes", "pos": 9, "product_id": "lost"}) + "\n{oops")
    loaded = catalog.load(spark, str(tmp_path), "bikes")
    row = loaded.products.collect()
    assert [(r.product_id, r.label, r["all"], r.any_of, r.aliases, r.attributes) for r in row] == [("b1", "b1", ["trek x 5"], [], ["trekx 5"], {})]
    assert loaded.modifiers == [catalog.Modifier("wanted", ("^busco",), True, 0.0)] and len(loaded.version) == 12
    _, errors = catalog.read_json(spark, str(tmp_path / "products"), schemas.PRODUCT)
    assert [r.file.endswith("bad.json") for r in errors.collect()] == [True]
    (tmp_path / "query_terms" / "good.json").write_text(json.dumps({"category": "bikes", "pos": 0, "term": "treks"}))
    assert catalog.load(spark, str(tmp_path), "bikes").version != loaded.version
    try:
        catalog.load(spark, str(tmp_path), "boats")
    except KeyError as error:
        assert "boats" in str(error)
    else:
        raise AssertionError("unknown category loaded")


def test_jsonld_deep_trees_and_arrays_of_offers(spark):
    leaf = {"name": "leaf", "offers": [[], [[[{"price": 0}], [{"lowPrice": "3,5"}]], {"price": 9}]]}
    for depth in (1, 8, 30, 90):
        node = leaf
        for i in range(depth):
            node = [node] if i % 3 == 0 else {"child": node} if i % 3 == 1 else {"name": f"n{i}", "offers": {"price": i}, "a": node}
        html = f'<script type="application/ld+json">{json.dumps(node)}</script>'
        rows = jsonld.page_offers(spark.createDataFrame([(1, html)], "page_id int, html string"), ["page_id"]).orderBy("node_no").collect()
        want = [(f"n{i}", float(i)) for i in range(depth - 1, -1, -1) if i % 3 == 2]
        assert [(r.name, r.price_eur) for r in rows] == [*want, ("leaf", 3.5)]
        assert [r.node_no for r in rows] == list(range(len(rows)))
