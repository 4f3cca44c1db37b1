"""Catalogs built from the part table, and the findings over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import check
from checks.tables import read
from checks.texts import NORM
from fairtag.operators import quality
from fairtag.session import scratch
from fairtag.sources import catalog as cat


def sparse_products(spark, sf):
    """Parts as raw catalog rows, fields missing here and there, words as people type them."""
    return read(spark, sf, "part").selectExpr(
        "'parts' AS category", "CAST(p_partkey AS INT) AS pos", "CAST(p_partkey AS STRING) AS product_id",
        "IF(p_size % 3 = 0, NULL, upper(p_name)) AS label", "IF(p_size % 4 = 0, NULL, p_brand) AS brand",
        "IF(p_size % 5 = 0, NULL, map('size', CAST(p_size AS DOUBLE))) AS attributes",
        "IF(p_size % 6 = 0, NULL, p_retailprice) AS retail_fallback_eur",
        "IF(p_size % 7 = 0, NULL, array(concat('É-', p_name, p_size, 'Ti'))) AS `all`",
        "CAST(NULL AS ARRAY<STRING>) AS any_of", "array('LAPTOP', p_type) AS none_of",
        "IF(p_size % 8 = 0, NULL, array(concat(p_name, '-', p_size, ' GB'))) AS aliases",
    )


@check(
    "src_7_catalog_defaults",
    f"""
SELECT CAST(p_partkey AS VARCHAR) AS product_id, CASE WHEN p_size % 3 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE upper(p_name) END AS label,
  CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand END AS brand, CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS size,
  CASE WHEN p_size % 6 = 0 THEN 0e0 ELSE p_retailprice END AS retail_fallback_eur,
  CASE WHEN p_size % 7 = 0 THEN '' ELSE {NORM.format("'É-' || p_name || p_size || 'Ti'")} END AS needles,
  0 AS n_any_of, 'laptop,' || lower(p_type) AS none_of,
  CASE WHEN p_size % 8 = 0 THEN '' ELSE {NORM.format("p_name || '-' || p_size || ' GB'")} END AS aliases FROM part""",
)
def src_7(spark, sf):
    return cat.with_defaults(sparse_products(spark, sf)).select(
        "product_id", "label", "brand", F.try_element_at("attributes", F.lit("size")).alias("size"),
        "retail_fallback_eur", F.array_join("all", ",").alias("needles"), F.size("any_of").alias("n_any_of"),
        F.array_join("none_of", ",").alias("none_of"), F.array_join("aliases", ",").alias("aliases"),
    )


@check(
    "src_7_content_version",
    """
WITH h AS (
  SELECT lower(p_type) AS category, sha256('0' || '{"pos":' || p_partkey || ',"term":"' || p_name || '"}') AS x FROM part
  UNION ALL SELECT lower(p_type), sha256('1' || '{"size":' || p_size || '}') FROM part)
SELECT category, left(sha256(concat_ws(':', sum(CAST('0x' || substr(x, 1, 15) AS BIGINT)), sum(CAST('0x' || substr(x, 16, 15) AS BIGINT)),
  sum(CAST('0x' || substr(x, 31, 15) AS BIGINT)), sum(CAST('0x' || substr(x, 46, 15) AS BIGINT)), count(*))), 12) AS version FROM h GROUP BY category""",
)
def src_7_version(spark, sf):
    parts = read(spark, sf, "part").withColumn("category", F.lower("p_type"))
    terms = parts.selectExpr("category", "p_name AS term", "p_partkey AS pos")
    return cat.content_version(terms, parts.selectExpr("category", "p_size AS size"))


@check(
    "src_7_load_all",
    """
SELECT p_brand AS category, count(*) AS n_products, CASE WHEN p_brand LIKE '%1' THEN '' ELSE 'size' END AS rank_by,
  CASE WHEN p_brand LIKE '%1' THEN '' ELSE 'size,' || p_brand END AS attributes, 1 AS n_errors FROM part GROUP BY p_brand""",
)
def src_7_all(spark, sf):
    # One catalog to a brand, some without an entry in the table of categories, and a broken file beside the good ones.
    folder, parts = f"{scratch(spark)}/catalogs", read(spark, sf, "part")
    parts.selectExpr(
        "p_brand AS category", "CAST(p_partkey AS INT) AS pos", "concat('p', p_partkey) AS product_id", "array(p_type) AS `all`"
    ).write.json(f"{folder}/products")
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(f"{folder}/products")
    parts.selectExpr("p_brand AS category", "array('size', p_brand) AS attributes", "'size' AS rank_by").filter(
        "category NOT LIKE '%1'"
    ).distinct().write.json(f"{folder}/categories")
    catalogs, errors = cat.load_all(spark, folder)
    rows = [
        c.products.agg(F.count(F.lit(1)).alias("n_products")).select(
            F.lit(name).alias("category"), "n_products", F.lit(c.rank_by).alias("rank_by"), F.lit(",".join(c.attributes)).alias("attributes")
        )
        for name, c in catalogs.items()
    ]
    return reduce(DataFrame.union, rows).withColumn("n_errors", F.lit(errors.count()))


@check(
    "src_8_catalog_build",
    """
WITH a AS (SELECT CAST(p_size AS DOUBLE) AS raw FROM part WHERE p_partkey = 1),
s AS (SELECT *, 'p_' || p_partkey AS product_id FROM part)
SELECT product_id, CASE WHEN p_size % 4 <> 0 OR p_partkey = 1 THEN round_even(p_size / (SELECT raw FROM a) * 100 * 10, 0) / 10 END AS perf_index,
  CASE WHEN p_size % 3 = 0 THEN round_even(p_retailprice * 1.22e0 / 10, 0) * 10 ELSE 0e0 END AS retail_fallback_eur,
  CASE WHEN product_id LIKE 'p\\_1%' ESCAPE '\\' THEN 'ones' ELSE 'twos' END AS family, p_type || ',laptop,notebook' AS none_of
FROM s WHERE product_id LIKE 'p\\_1%' ESCAPE '\\' OR product_id LIKE 'p\\_2%' ESCAPE '\\'""",
)
def src_8(spark, sf):
    parts = read(spark, sf, "part").withColumn("product_id", F.expr("concat('p_', p_partkey)"))
    empty = "CAST(array() AS ARRAY<STRING>)"
    specs = parts.selectExpr(
        "CAST(p_partkey AS INT) AS pos", "product_id", "p_name AS label", "p_brand AS brand",
        "map('size', CAST(p_size AS DOUBLE)) AS attributes", "split(p_name, ' ') AS `all`", f"{empty} AS any_of",
        "array(p_type) AS none_of", f"{empty} AS aliases",
    )
    benchmark = parts.filter("p_size % 4 <> 0 OR p_partkey = 1").selectExpr("product_id", "CAST(p_size AS DOUBLE) AS raw")
    msrp = parts.filter("p_size % 3 = 0").selectExpr("product_id", "p_retailprice AS usd")
    families = spark.createDataFrame([(0, "ones", "p_1"), (1, "twos", "p_2")], "family_pos int, family string, prefix string")
    built = cat.build_products(specs, benchmark, msrp, families, "parts", "p_1", ["laptop", "notebook"], 1.22)
    return built.select(
        "product_id", F.try_element_at("attributes", F.lit("perf_index")).alias("perf_index"), "retail_fallback_eur",
        "family", F.array_join("none_of", ",").alias("none_of"),
    )


LABEL = "CASE p_size % 3 WHEN 0 THEN 'GeForce ' ELSE '' END || upper(p_name) || CASE p_size % 4 WHEN 0 THEN ' ' || p_size || ' GB' ELSE '' END"


@check(
    "src_9_search_terms",
    f"""
WITH l AS (SELECT p_partkey AS pos, regexp_replace(lower(trim(regexp_replace({LABEL}, '(?i)^(geforce|radeon|arc|nvidia|amd|intel)\\s+', ''))), '\\s+\\d{{1,2}}\\s*gb$', '') AS term FROM part),
d AS (SELECT term, min(pos) AS pos FROM l GROUP BY term),
b AS (SELECT o_orderkey AS pos, o_orderpriority AS term FROM orders UNION ALL SELECT o_orderkey, lower(o_orderpriority) FROM orders WHERE o_orderkey > 5),
k AS (SELECT b.* FROM b WHERE lower(term) NOT IN (SELECT term FROM d)
  AND pos <= coalesce((SELECT min(x.pos) FROM b x WHERE x.term = lower(b.term)), pos))
SELECT term, min(pos) AS pos, count(*) AS times FROM (SELECT * FROM d UNION ALL SELECT term, pos + 4294967296 FROM k) GROUP BY term, pos""",
)
def src_9(spark, sf):
    products = read(spark, sf, "part").selectExpr("CAST(p_partkey AS INT) AS pos", f"{LABEL} AS label")
    orders = read(spark, sf, "orders")
    broad = orders.selectExpr("o_orderkey AS pos", "o_orderpriority AS term").unionByName(
        orders.filter("o_orderkey > 5").selectExpr("o_orderkey AS pos", "lower(o_orderpriority) AS term")
    )
    found = cat.search_terms(cat.Catalog("parts", products, broad))
    return found.groupBy("term", "pos").agg(F.count(F.lit(1)).alias("times"))


# Findings


def rule_rows(spark, sf):
    """Distinct part names as rules: adjectives are requirements of some, bans of others."""
    return read(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k")).selectExpr(
        "'parts' AS category", "CAST(k AS INT) AS pos",
        "IF(p_name LIKE 'hot%', '', IF(p_name LIKE 'cold%', split(p_name, ' ')[1], p_name)) AS product_id",
        "CASE WHEN p_name LIKE 'old%' THEN array() WHEN p_name LIKE 'new%' THEN split(p_name, ' ') "
        "WHEN p_name LIKE 'red%' THEN array(split(p_name, ' ')[1]) ELSE array(concat(upper(p_name), '-', k % 3)) END AS `all`",
        "CAST(array() AS ARRAY<STRING>) AS any_of",
        "IF(p_name LIKE '%g', array('NEW'), CAST(array() AS ARRAY<STRING>)) AS none_of",
        "map('size', CAST(k % 2 AS DOUBLE), concat('x', k % 3), 1D) AS attributes",
    )


RULE_SQL = f"""
WITH r0 AS (SELECT p_name, min(p_partkey) AS k, string_split(p_name, ' ') AS w FROM part GROUP BY p_name),
r AS (
  SELECT CAST(k AS INT) AS pos, k, CASE WHEN p_name LIKE 'hot%' THEN '' WHEN p_name LIKE 'cold%' THEN w[2] ELSE p_name END AS product_id,
    CASE WHEN p_name LIKE 'old%' THEN [] WHEN p_name LIKE 'new%' THEN w WHEN p_name LIKE 'red%' THEN [w[2]]
      ELSE string_split({NORM.format("upper(p_name) || '-' || (k % 3)")}, ' ') END AS al,
    CASE WHEN p_name LIKE '%g' THEN ['new'] ELSE [] END AS no FROM r0)
"""


@check(
    "qlt_1_variant_swallowing",
    RULE_SQL + """
SELECT a.product_id, b.product_id AS swallowed_id, array_to_string(list_sort(list_filter(b.al, lambda x: NOT list_contains(a.al, x))), ', ') AS missing
FROM r a JOIN r b ON a.product_id <> b.product_id AND len(a.al) > 0 AND len(b.al) > 0 AND a.product_id <> '' AND b.product_id <> ''
WHERE len(list_filter(a.al, lambda x: NOT list_contains(b.al, x))) = 0 AND len(list_filter(b.al, lambda x: NOT list_contains(a.al, x))) > 0
  AND len(list_filter(b.al, lambda x: NOT list_contains(a.al, x) AND list_contains(a.no, x))) = 0""",
)
def qlt_1(spark, sf):
    return quality.variant_swallowing(rule_rows(spark, sf)).select(
        "product_id", "swallowed_id", F.array_join("missing", ", ").alias("missing")
    )


@check(
    "qlt_2_duplicate_ids",
    """
WITH p AS (SELECT p_partkey AS pos, p_name AS id, lag(p_partkey) OVER (PARTITION BY p_name ORDER BY p_partkey) AS earlier FROM part)
SELECT id AS product_id, 'Duplicate product id ''' || id || ''' (also at products[' || earlier || ']). Ids are database keys — two rows would fight over one history.' AS message, 'products[' || pos || '] (' || id || ')' AS "where"
FROM p WHERE earlier IS NOT NULL""",
)
def qlt_2(spark, sf):
    rows = read(spark, sf, "part").selectExpr("'parts' AS category", "CAST(p_partkey AS INT) AS pos", "p_name AS product_id")
    return quality.duplicate_ids(rows).select("product_id", "message", "where")


@check(
    "qlt_3_unmatchable_rules",
    RULE_SQL + """SELECT product_id, 'products[' || pos || '] (' || product_id || ')' AS "where" FROM r WHERE product_id <> '' AND len(al) = 0""",
)
def qlt_3(spark, sf):
    return quality.unmatchable_rules(rule_rows(spark, sf)).select("product_id", "where")


@check(
    "qlt_4_attribute_findings",
    RULE_SQL + """
SELECT product_id, 'warning' AS level, 'attribute ''x' || (k % 3) || ''' is not declared in the top-level `attributes` block' AS message
FROM r WHERE product_id <> '' AND k % 3 <> 1
UNION ALL SELECT product_id, 'info', 'no ''size'' value — this product is excluded from the value ranking' FROM r WHERE product_id <> '' AND k % 2 = 0""",
)
def qlt_4(spark, sf):
    return quality.attribute_findings(rule_rows(spark, sf), ["size", "x1"], "size").select("product_id", "level", "message")


@check(
    "qlt_5_missing_ids",
    RULE_SQL + """SELECT 'error' AS level, 'Product has no id' AS message, 'products[' || pos || '] (?)' AS "where" FROM r WHERE product_id = ''""",
)
def qlt_5(spark, sf):
    return quality.missing_ids(rule_rows(spark, sf)).select("level", "message", "where")


@check(
    "qlt_5_catalog_and_modifier_findings",
    """
SELECT 'modifier' AS kind, p_type AS category, 'error' AS level, 'modifiers[' || p_partkey || '] (?)' AS "where" FROM part WHERE p_size % 9 = 0
UNION ALL SELECT 'modifier', p_type, 'warning', 'modifiers[' || p_partkey || '] (' || CASE WHEN p_size % 9 = 0 THEN '?' ELSE p_name END || ')' FROM part WHERE p_size % 10 = 0
UNION ALL SELECT DISTINCT 'catalog', p_type, 'warning', '' FROM part WHERE p_type NOT IN ('PROMO', 'SMALL')
UNION ALL SELECT DISTINCT 'catalog', p_type, 'warning', '' FROM part WHERE p_type LIKE 'S%'""",
)
def qlt_5_rest(spark, sf):
    parts = read(spark, sf, "part")
    modifiers = parts.selectExpr(
        "p_type AS category", "p_partkey AS pos", "IF(p_size % 9 = 0, NULL, p_name) AS modifier_id",
        "IF(p_size % 10 = 0, array(), array('x')) AS patterns",
    )
    categories = parts.select("p_type").distinct().selectExpr(
        "p_type AS category", "IF(p_type LIKE 'S%', 'speed', 'size') AS rank_by", "array('size') AS attributes"
    )
    terms = parts.filter("p_type IN ('PROMO', 'SMALL')").selectExpr("p_type AS category", "p_name AS term")
    return (
        quality.modifier_findings(modifiers).withColumn("kind", F.lit("modifier"))
        .unionByName(quality.category_findings(categories, terms).withColumn("kind", F.lit("catalog")))
        .select("kind", "category", "level", "where")
    )


@check(
    "qlt_5_catalog_report",
    RULE_SQL + """
, f AS (
  SELECT 'product' AS subject, 'error' AS level, 'Product has no id' AS message, 'products[' || pos || '] (?)' AS "where" FROM r WHERE product_id = ''
  UNION ALL SELECT 'product', 'error', 'Rule has neither `all` nor `any_of`, so it can never match.', 'products[' || pos || '] (' || product_id || ')' FROM r WHERE product_id <> '' AND len(al) = 0
  UNION ALL SELECT 'product', 'warning', 'attribute ''x' || (k % 3) || ''' is not declared in the top-level `attributes` block', 'products[' || pos || '] (' || product_id || ')' FROM r WHERE product_id <> '' AND k % 3 <> 1
  UNION ALL SELECT 'product', 'info', 'no ''size'' value — this product is excluded from the value ranking', 'products[' || pos || '] (' || product_id || ')' FROM r WHERE product_id <> '' AND k % 2 = 0
  UNION ALL SELECT 'product', 'error', 'Duplicate product id ''' || product_id || ''' (also at products[' || earlier || ']). Ids are database keys — two rows would fight over one history.', 'products[' || pos || '] (' || product_id || ')'
    FROM (SELECT *, lag(pos) OVER (PARTITION BY product_id ORDER BY pos) AS earlier FROM r WHERE product_id <> '') WHERE earlier IS NOT NULL
  UNION ALL SELECT 'product', 'error',
    '''' || owner || ''' will swallow ''' || other || ''' listings: it requires [''' || needs || '''] and does not exclude ' || miss || '. Add none_of: [' || miss || '] to ''' || owner || '''.',
    'products / ' || owner
    FROM (SELECT a.product_id AS owner, b.product_id AS other, array_to_string(list_sort(list_distinct(a.al)), ''', ''') AS needs,
        array_to_string(list_sort(list_filter(b.al, lambda x: NOT list_contains(a.al, x))), ', ') AS miss
      FROM r a JOIN r b ON a.product_id <> b.product_id AND len(a.al) > 0 AND len(b.al) > 0 AND a.product_id <> '' AND b.product_id <> ''
      WHERE len(list_filter(a.al, lambda x: NOT list_contains(b.al, x))) = 0 AND len(list_filter(b.al, lambda x: NOT list_contains(a.al, x))) > 0
        AND len(list_filter(b.al, lambda x: NOT list_contains(a.al, x) AND list_contains(a.no, x))) = 0)
  UNION ALL SELECT 'modifier', 'error', 'Modifier has no id', 'modifiers[' || p_partkey || '] (?)' FROM part WHERE p_size % 9 = 0
  UNION ALL SELECT 'modifier', 'warning', 'Modifier has no patterns', 'modifiers[' || p_partkey || '] (' || CASE WHEN p_size % 9 = 0 THEN '?' ELSE p_name END || ')' FROM part WHERE p_size % 10 = 0
  UNION ALL SELECT 'catalog', 'warning', 'No query_terms — the collector has nothing broad to search for.', ''
  UNION ALL SELECT 'catalog', 'error', 'Missing required key: category', ''
  UNION ALL SELECT 'catalog', 'warning', 'rank_by ''speed'' is not in attributes, so the compare view will rank everything at zero.', '')
SELECT subject, level, message, "where" FROM f""",
)
def qlt_5_report(spark, sf):
    """Everything at once: a catalog with products and modifiers, and one without name whose ranking is undeclared."""
    modifiers = read(spark, sf, "part").selectExpr(
        "'parts' AS category", "p_partkey AS pos", "IF(p_size % 9 = 0, NULL, p_name) AS modifier_id", "IF(p_size % 10 = 0, array(), array('x')) AS patterns"
    )
    categories = spark.createDataFrame([("parts", "size", ["size", "x1"]), ("", "speed", ["size"])], "category string, rank_by string, attributes array<string>")
    terms = read(spark, sf, "part").selectExpr("IF(p_partkey >= 0, 'parts', p_name) AS category", "p_name AS term")
    return quality.catalog_report(categories, rule_rows(spark, sf), modifiers, terms).select("subject", "level", "message", "where")


@check(
    "qlt_7_order_violations",
    """
SELECT CAST(a.p_partkey AS VARCHAR) AS faster_id, CAST(b.p_partkey AS VARCHAR) AS slower_id FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1
WHERE NOT coalesce(CASE WHEN a.p_size % 5 <> 0 THEN a.p_size END > CASE WHEN b.p_size % 5 <> 0 THEN b.p_size END, false)""",
)
def qlt_7(spark, sf):
    parts = read(spark, sf, "part")
    products = parts.selectExpr(
        "CAST(p_partkey AS STRING) AS product_id",
        "IF(p_size % 5 = 0, map(), map('size', CAST(p_size AS DOUBLE))) AS attributes",
    )
    follows = parts.selectExpr("CAST(p_partkey - 1 AS STRING) AS faster_id", "CAST(p_partkey AS STRING) AS slower_id").filter("faster_id <> '-1'")
    return quality.order_violations(products, follows, "size").select("faster_id", "slower_id")
