"""Driver tables read as the library's models, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairtag.operators.classify import adjusted_cents
from fairtag.params import Params
from fairtag.session import tuned

# The driver tables span 1995 to 2001; a moment inside them gives every branch rows.
AS_OF = "1998-06-01"
PARAMS = Params(window_days=1000, sold_hours=24 * 365)


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf}/{name}.parquet")


def classified(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as classified listings of part ads; see MARKET_SQL for the same in SQL."""
    items = read(spark, sf, "lineitem")
    orders = read(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    facts = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "*",
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS site_listing_id",
        "CASE l_linenumber WHEN 7 THEN 'none' WHEN 6 THEN 'excluded' WHEN 5 THEN 'fuzzy' ELSE 'rule' END AS match_kind",
        "CAST(floor(l_extendedprice / l_quantity * 100) AS BIGINT) AS cents",
        "CAST(rint(l_discount * 100) AS INT) AS disc",
        "CAST(rint(l_tax * 100) AS INT) AS tax",
        "CAST(l_shipdate AS TIMESTAMP) AS shipped",
        "CAST(o_orderdate AS TIMESTAMP) AS ordered",
    ).selectExpr(
        "*",
        "IF(tax <> 8, cents, NULL) AS price_cents",
        "IF(disc >= 5, -8D, 0D) + IF(tax IN (1, 2), 10D, 0D) AS adjust_pct",
        "greatest(shipped, ordered) AS last_seen",
    )
    return facts.select(
        *_exprs("""
            concat('market/', site_listing_id) AS listing_id
            'market' AS site
            site_listing_id
            'parts' AS category
            IF(match_kind IN ('rule', 'fuzzy'), CAST(l_partkey AS STRING), NULL) AS product_id
            match_kind
            IF(match_kind = 'excluded', 'wanted_ad', NULL) AS excluded_by
            price_cents
            IF(disc >= 3, CAST(floor(cents * 1.25D) AS BIGINT), price_cents) AS first_price_cents
            array_compact(array(IF(disc >= 5, 'warranty', NULL), IF(tax IN (1, 2), 'mined_on', NULL))) AS modifiers
            adjust_pct
            l_returnflag = 'R' AS seller_is_pro
            concat('https://market.example/', site_listing_id) AS url
            concat('Part <', l_partkey, '> & "lot" ', l_orderkey) AS title
            IF(l_suppkey % 7 <> 0, concat('City ', l_suppkey % 10, ', Region ', l_suppkey % 3), NULL) AS location
            IF(l_linenumber > 1, l_linenumber - 1, NULL) AS photo_count
            CAST(l_linenumber AS BIGINT) AS seen_count
            least(shipped, ordered) AS first_seen
            last_seen
            IF(l_linestatus = 'F', last_seen, NULL) AS disappeared_at
            shipped AS discovered_at
        """),
        adjusted_cents(F.col("price_cents"), F.col("adjust_pct"), PARAMS).alias("adjusted_cents"),
    )


def _exprs(lines: str) -> list[Column]:
    return [F.expr(line.strip()) for line in lines.strip().splitlines()]


MARKET_SQL = """
m AS (
  SELECT 'market/' || sid AS listing_id, 'market' AS site, sid AS site_listing_id, 'parts' AS category,
    CASE WHEN kind IN ('rule', 'fuzzy') THEN CAST(l_partkey AS VARCHAR) END AS product_id,
    kind AS match_kind, CASE WHEN kind = 'excluded' THEN 'wanted_ad' END AS excluded_by, price_cents,
    CASE WHEN disc >= 3 THEN CAST(floor(cents * 1.25e0) AS BIGINT) ELSE price_cents END AS first_price_cents,
    list_filter([CASE WHEN disc >= 5 THEN 'warranty' END, CASE WHEN tax IN (1, 2) THEN 'mined_on' END], lambda x: x IS NOT NULL) AS modifiers,
    apct AS adjust_pct,
    CAST(round_even(price_cents * (1 + greatest(least(apct, 35e0), -35e0) / 1e2), 0) AS BIGINT) AS adjusted_cents,
    l_returnflag = 'R' AS seller_is_pro, 'https://market.example/' || sid AS url,
    'Part <' || l_partkey || '> & "lot" ' || l_orderkey AS title,
    CASE WHEN l_suppkey % 7 <> 0 THEN 'City ' || (l_suppkey % 10) || ', Region ' || (l_suppkey % 3) END AS location,
    CASE WHEN l_linenumber > 1 THEN l_linenumber - 1 END AS photo_count,
    CAST(l_linenumber AS BIGINT) AS seen_count,
    least(l_shipdate, o_orderdate) AS first_seen, greatest(l_shipdate, o_orderdate) AS last_seen,
    CASE WHEN l_linestatus = 'F' THEN greatest(l_shipdate, o_orderdate) END AS disappeared_at,
    l_shipdate AS discovered_at
  FROM (
    SELECT *, CASE WHEN tax <> 8 THEN cents END AS price_cents,
      (CASE WHEN disc >= 5 THEN -8e0 ELSE 0e0 END) + (CASE WHEN tax IN (1, 2) THEN 10e0 ELSE 0e0 END) AS apct
    FROM (
      SELECT *, CAST(floor(l_extendedprice / l_quantity * 100) AS BIGINT) AS cents,
        CAST(round_even(l_discount * 100, 0) AS INT) AS disc, CAST(round_even(l_tax * 100, 0) AS INT) AS tax,
        l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS sid,
        CASE l_linenumber WHEN 7 THEN 'none' WHEN 6 THEN 'excluded' WHEN 5 THEN 'fuzzy' ELSE 'rule' END AS kind
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)))
"""

COMPARABLE_SQL = """
c AS (SELECT * FROM m WHERE match_kind IN ('rule', 'fuzzy') AND adjusted_cents IS NOT NULL AND NOT seller_is_pro)
"""

SAMPLES_SQL = f"""
s AS (
  SELECT product_id, listing_id, adjusted_cents, adjusted_cents / 1e2 AS v,
    coalesce(seen_count > 1 AND disappeared_at - first_seen < INTERVAL {PARAMS.sold_hours} HOURS, false) AS sold,
    CASE WHEN coalesce(seen_count > 1 AND disappeared_at - first_seen < INTERVAL {PARAMS.sold_hours} HOURS, false)
      THEN 2e0 ELSE 1e0 END AS w
  FROM c WHERE last_seen > TIMESTAMP '{AS_OF}' - INTERVAL {PARAMS.window_days} DAYS)
"""

# Percentiles of the single samples, lightest first among equal prices.
SPREAD_SQL = """
o AS (
  SELECT *, sum(w) OVER x AS cum, lag(v) OVER x AS pv, row_number() OVER x AS rn,
    sum(w) OVER (PARTITION BY product_id) AS total
  FROM s WINDOW x AS (PARTITION BY product_id ORDER BY adjusted_cents, w, listing_id ROWS UNBOUNDED PRECEDING)),
d AS (
  SELECT product_id, count(*) AS n, count(*) FILTER (WHERE w > 1) AS n_sold_proxy,
    {quantiles}, sum(adjusted_cents * w) / sum(w) / 1e2 AS mean,
    CASE WHEN count(*) >= 15 THEN 'high' WHEN count(*) >= 8 THEN 'medium' WHEN count(*) >= 4 THEN 'low' ELSE 'none' END AS confidence
  FROM o GROUP BY product_id)
""".format(
    quantiles=", ".join(
        f"arg_min(CASE WHEN rn = 1 THEN v ELSE pv + ({q}e0 * total - (cum - w)) / w * (v - pv) END, rn) "
        f"FILTER (WHERE cum >= {q}e0 * total) AS {name}"
        for name, q in (("p10", 0.1), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9))
    )
)


def products(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as the product dimension; every fifth lacks the rank attribute, small ones have no hint."""
    size = F.when(F.col("p_partkey") % 5 != 0, F.create_map(F.lit("size"), F.col("p_size").cast("double"))).otherwise(
        F.create_map().cast("map<string,double>")
    )
    return read(spark, sf, "part").select(
        F.lit("parts").alias("category"),
        F.col("p_partkey").cast("int").alias("pos"),
        F.col("p_partkey").cast("string").alias("product_id"),
        F.concat("p_name", F.lit(" & "), "p_partkey").alias("label"),
        F.col("p_brand").alias("brand"),
        F.map_concat(size, F.create_map(F.lit("list_price"), F.col("p_retailprice"))).alias("attributes"),
        F.when(F.col("p_size") >= 10, F.col("p_retailprice") * 3.0).otherwise(0.0).alias("retail_fallback_eur"),
    )


PRODUCTS_SQL = """
p AS (
  SELECT CAST(p_partkey AS INT) AS pos, CAST(p_partkey AS VARCHAR) AS product_id, p_name || ' & ' || p_partkey AS label,
    p_brand AS brand, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS size, p_retailprice AS list_price,
    CASE WHEN p_size >= 10 THEN p_retailprice * 3e0 ELSE 0e0 END AS retail_fallback_eur
  FROM part)
"""


def retail_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines of the last year before the moment, read as shop offers of the day."""
    items = read(spark, sf, "lineitem")
    return items.select(
        F.lit("parts").alias("category"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.concat(F.lit("shop"), F.col("l_suppkey") % 4).alias("source"),
        F.col("l_shipdate").cast("date").alias("observed_on"),
        F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 200).cast("bigint").alias("price_cents"),
        F.concat(F.lit("https://shop.example/"), "l_orderkey").alias("url"),
        (F.col("l_returnflag") != "N").alias("in_stock"),
    )


RETAIL_PARAMS = Params(retail_days=120)
RETAIL_SQL = f"""
shop AS (
  SELECT CAST(l_partkey AS VARCHAR) AS product_id, 'shop' || (l_suppkey % 4) AS source, CAST(l_shipdate AS DATE) AS observed_on,
    CAST(floor(l_extendedprice / l_quantity * 200) AS BIGINT) AS price_cents, l_returnflag <> 'N' AS in_stock,
    'https://shop.example/' || l_orderkey AS url
  FROM lineitem),
r AS (
  SELECT p.product_id, coalesce(x.cents / 1e2, CASE WHEN retail_fallback_eur > 0 THEN retail_fallback_eur END) AS retail_eur
  FROM p FULL JOIN (
    SELECT product_id, min(price_cents) AS cents FROM shop
    WHERE in_stock AND observed_on > DATE '{AS_OF}' - {RETAIL_PARAMS.retail_days} GROUP BY product_id) x USING (product_id)
  WHERE coalesce(x.cents / 1e2, CASE WHEN retail_fallback_eur > 0 THEN retail_fallback_eur END) IS NOT NULL)
"""


def with_ctes(*ctes: str, select: str) -> str:
    """``select`` may go on with further tables, led by a comma."""
    return "WITH " + ",\n".join(c.strip() for c in ctes) + select.rstrip()


def rounded(name: str, digits: int = 6) -> Column:
    """Half-even on the binary product, as the SQL side rounds."""
    scale = float(10**digits)
    return (F.rint(F.col(name) * scale) / scale).alias(name.split(".")[-1])


r6 = rounded


def micros(name: str) -> Column:
    return F.unix_micros(F.col(name)).alias(name)
