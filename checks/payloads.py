"""Ad payloads and shop pages written from the order tables, then parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check
from checks.classifying import PART_SQL, part_catalog
from checks.tables import micros, read, with_ctes
from checks.texts import NORM
from fairtag.operators import retail
from fairtag.session import spread
from fairtag.sources import jsonld, offers

# Ads: some without id, title, price or place, some with prices no number.


def payloads(spark, sf):
    items = read(spark, sf, "lineitem").withColumn("sid", F.expr("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"))
    payload = F.expr("""
        to_json(named_struct(
          'id', IF(l_quantity = 13, NULL, sid),
          'url', IF(l_suppkey % 3 = 0, NULL, concat('https://ads.example/', sid)),
          'title', IF(l_quantity = 14, '  ', concat('  Part ', l_partkey, ' ')),
          'description', concat(' ', repeat(l_returnflag, IF(l_quantity = 50, 8100, l_linenumber)), ' '),
          'business', l_linenumber = 7,
          'params', array(
            named_struct('key', 'state', 'value', named_struct('value', 'used', 'currency', NULL)),
            named_struct('key', IF(l_linenumber = 6, 'cost', 'price'), 'value', named_struct(
              'value', CASE WHEN l_linenumber = 5 THEN 'negotiable' WHEN l_linenumber = 4 THEN CAST(l_tax * 20 AS STRING) ELSE CAST(l_extendedprice AS STRING) END,
              'currency', IF(l_suppkey % 2 = 0, 'USD', NULL)))),
          'user', named_struct('id', l_suppkey, 'is_business', l_returnflag = 'R'),
          'photos', transform(sequence(1, l_linenumber), i -> concat(i, '.jpg')),
          'location', named_struct(
            'city', IF(l_suppkey % 4 = 0, NULL, named_struct('name', concat('City ', l_suppkey % 10))),
            'region', IF(l_suppkey % 5 = 0, NULL, named_struct('name', concat('Region ', l_suppkey % 3)))),
          'created_time', CASE WHEN l_linenumber = 1 THEN 'yesterday' WHEN l_linenumber = 3 THEN concat('Tue, ', date_format(l_shipdate, 'dd MMM yyyy'), ' 23:00:00 GMT') WHEN l_linenumber = 4 THEN date_format(l_shipdate, 'd/M/yyyy HH:mm')
            WHEN l_linenumber > 4 THEN concat(date_format(l_shipdate, 'yyyy-MM-dd'), 'T00:00:00+01:00') END,
          'last_refresh_time', IF(l_linenumber = 2, date_format(l_shipdate, 'yyyy-MM-dd HH:mm:ss'), NULL),
          'valid_to_time', concat(date_format(l_shipdate, 'yyyy-MM-dd'), 'T10:30:00Z')))
    """)
    return items.select(
        payload.alias("payload"), F.lit("parts").alias("category"),
        F.col("l_shipdate").cast("timestamp").alias("batch_ts"), F.col("l_orderkey").alias("batch_pos"),
    )


def parsed(spark, sf):
    return offers.parse_offers(payloads(spark, sf), "ads", "https://ads.example/ad/")


ADS_SQL = """
i AS (
  SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS sid
  FROM lineitem WHERE l_quantity NOT IN (13, 14))
"""


@check(
    "src_1_offer_parse",
    with_ctes(ADS_SQL, select="""
SELECT sid AS site_listing_id, CASE WHEN l_suppkey % 3 = 0 THEN 'https://ads.example/ad/' ELSE 'https://ads.example/' END || sid AS url,
  'Part ' || l_partkey AS title, CASE WHEN l_quantity = 50 THEN 8000 ELSE l_linenumber END AS description_length,
  CAST(l_suppkey AS VARCHAR) AS seller_id, l_returnflag = 'R' OR l_linenumber = 7 AS seller_is_pro, l_linenumber AS photo_count FROM i"""),
)
def src_1(spark, sf):
    return parsed(spark, sf).select(
        "site_listing_id", "url", "title", F.length("description").alias("description_length"), "seller_id",
        "seller_is_pro", "photo_count",
    )


@check(
    "src_2_price_param",
    with_ctes(ADS_SQL, select="""
, c AS (SELECT *, CASE WHEN l_linenumber = 4 THEN round_even(l_tax * 20 * 100, 0) WHEN l_linenumber NOT IN (5, 6) THEN round_even(l_extendedprice * 100, 0) END AS cents FROM i)
SELECT sid AS site_listing_id, CAST(CASE WHEN cents > 100 THEN cents END AS BIGINT) AS price_cents,
  CASE WHEN l_suppkey % 2 = 0 AND l_linenumber <> 6 THEN 'USD' ELSE 'EUR' END AS currency FROM c"""),
)
def src_2(spark, sf):
    return parsed(spark, sf).select("site_listing_id", "price_cents", "currency")


@check(
    "src_3_posting_time",
    with_ctes(ADS_SQL, select="""
SELECT sid AS site_listing_id, epoch_us(l_shipdate + CASE l_linenumber WHEN 1 THEN INTERVAL '630 minutes' WHEN 2 THEN INTERVAL '0 minutes' WHEN 3 THEN INTERVAL '1380 minutes' WHEN 4 THEN INTERVAL '0 minutes' ELSE INTERVAL '-60 minutes' END) AS posted_at FROM i"""),
)
def src_3(spark, sf):
    return parsed(spark, sf).select("site_listing_id", micros("posted_at"))


@check(
    "src_4_location_label",
    with_ctes(ADS_SQL, select="""
SELECT sid AS site_listing_id, nullif(concat_ws(', ', CASE WHEN l_suppkey % 4 <> 0 THEN 'City ' || (l_suppkey % 10) END,
  CASE WHEN l_suppkey % 5 <> 0 THEN 'Region ' || (l_suppkey % 3) END), '') AS location FROM i"""),
)
def src_4(spark, sf):
    return parsed(spark, sf).select("site_listing_id", "location")


# Shop pages: one block per page, the product at varying depth, prices in several spellings.

PAGE = """
concat('<html><head><SCRIPT data-x="1" type=', IF(p_size % 2 = 0, '"application/ld+json"', "'application/ld+json'"), '>',
  CASE WHEN p_size % 7 = 0 THEN '{broken' ELSE concat(repeat('{"@graph":[', p_size % 10),
    to_json(named_struct(
      '@type', IF(p_size % 3 = 0, 'Product', 'Thing'), 'name', p_name, '@id', concat('id/', p_partkey),
      'url', IF(p_size % 4 = 0, NULL, concat('https://shop.example/', p_partkey)),
      'offers', array(
        named_struct('price', NULL, 'lowPrice', NULL, 'availability', 'x'),
        named_struct(
          'price', CASE p_size % 5 WHEN 0 THEN '1.299,00' WHEN 1 THEN replace(CAST(p_retailprice AS STRING), '.', ',') WHEN 2 THEN NULL ELSE CAST(p_retailprice AS STRING) END,
          'lowPrice', CAST(p_size AS STRING),
          'availability', CASE p_size % 3 WHEN 0 THEN 'https://schema.org/InStock' WHEN 1 THEN 'SoldOut' END)))),
    repeat(']}', p_size % 10)) END,
  '</SCRIPT></head><body>', p_name, '</body></html>')
"""


def shop_pages(spark, sf):
    """Written pages next to the crawled ones, which carry no product blocks."""
    written = spread(read(spark, sf, "part")).selectExpr("CAST(p_partkey AS STRING) AS page_id", f"{PAGE} AS html")
    crawled = spread(read(spark, sf, "pages")).selectExpr("concat('crawled ', page_id) AS page_id", "html")
    return written.unionByName(crawled)


SHOP_SQL = """
pg AS (
  SELECT CAST(p_partkey AS VARCHAR) AS page_id, p_name AS name, p_size % 3 <> 1 AS in_stock,
    CASE WHEN p_size % 4 = 0 THEN 'id/' || p_partkey ELSE 'https://shop.example/' || p_partkey END AS url,
    CASE p_size % 5 WHEN 0 THEN NULL WHEN 2 THEN CAST(p_size AS DOUBLE) ELSE p_retailprice END AS price_eur
  FROM part WHERE p_size % 7 <> 0)
"""


@check("src_5_jsonld_products", with_ctes(SHOP_SQL, select=" SELECT page_id, name, url FROM pg WHERE price_eur > 0"))
def src_5(spark, sf):
    return jsonld.page_offers(shop_pages(spark, sf), ["page_id"]).select("page_id", "name", "url")


@check("src_6_offer_price_stock", with_ctes(SHOP_SQL, select=" SELECT page_id, price_eur, in_stock FROM pg WHERE price_eur > 0"))
def src_6(spark, sf):
    return jsonld.page_offers(shop_pages(spark, sf), ["page_id"]).select("page_id", "price_eur", "in_stock")


OFFER_MATCH_SQL = f"""
pt AS (SELECT DISTINCT name, {NORM.format('name')} AS pnorm FROM pg),
ph AS (
  SELECT name, product_id, 10 * len(al) + len(any_of) AS spec, pos FROM pt, prod
  WHERE len(list_filter(al, lambda n: NOT contains(' ' || pnorm || ' ', ' ' || n || ' '))) = 0
    AND (len(any_of) = 0 OR len(list_filter(any_of, lambda n: contains(' ' || pnorm || ' ', ' ' || n || ' '))) > 0)
    AND len(list_filter(none_of, lambda n: contains(' ' || pnorm || ' ', ' ' || n || ' '))) = 0),
pw AS (SELECT name, arg_max(product_id, (spec, -pos)) AS product_id FROM ph GROUP BY name)
"""


@check(
    "ret_1_classified_offers",
    with_ctes(PART_SQL, SHOP_SQL, OFFER_MATCH_SQL, select="""
SELECT page_id, product_id, price_eur FROM pg JOIN pw USING (name) WHERE price_eur > 0"""),
)
def ret_1(spark, sf):
    found = jsonld.page_offers(shop_pages(spark, sf), ["page_id"]).selectExpr(
        "concat_ws('/', page_id, block_no, node_no) AS offer_id", "page_id", "name", "price_eur", "url", "in_stock"
    )
    return retail.classify_offers(found, part_catalog(spark, sf)).select("page_id", "product_id", "price_eur")




# Two runs of a day, from pages to the daily table: pages of even parts first, then those of odd ones.
@check(
    "ret_3_pass_from_pages",
    with_ctes(PART_SQL, SHOP_SQL, OFFER_MATCH_SQL, select="""
, o AS (
  SELECT product_id, 'shop' || (CAST(page_id AS BIGINT) // 2 % 3) AS source, CAST(page_id AS BIGINT) AS seq, CAST(page_id AS BIGINT) % 2 AS run,
    CAST(round_even(price_eur * 100, 0) AS BIGINT) AS price_cents, price_eur, url, in_stock FROM pg JOIN pw USING (name) WHERE price_eur > 0),
b AS (SELECT product_id, source, run, min(price_cents) AS price_cents, arg_min(url, (price_eur, seq)) AS url, arg_min(in_stock, (price_eur, seq)) AS in_stock
  FROM o GROUP BY ALL)
SELECT product_id, source, min(price_cents) AS price_cents, arg_max(url, (run, 0)) AS url, arg_max(in_stock, (run, 0)) AS in_stock FROM b GROUP BY ALL"""),
)
def ret_3_pass(spark, sf):
    catalog = part_catalog(spark, sf)
    pages = shop_pages(spark, sf).filter("page_id NOT LIKE 'crawled%'").selectExpr(
        "concat('shop', CAST(page_id AS BIGINT) DIV 2 % 3) AS source", "CAST(page_id AS BIGINT) AS seq", "DATE '2024-01-01' AS observed_on", "html"
    )
    daily = spark.createDataFrame([], (
        "category string, product_id string, source string, observed_on date, price_cents bigint, url string, in_stock boolean, run_ts timestamp"
    ))
    for run in (0, 1):
        daily = retail.retail_pass(pages.filter(f"seq % 2 = {run}"), catalog, daily, F.lit(f"2024-01-01 0{run}:00").cast("timestamp"))
    return daily.select("product_id", "source", "price_cents", "url", "in_stock")
