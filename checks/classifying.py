"""Classification of ad titles made from part names, and of the document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check
from checks.tables import read, with_ctes
from checks.texts import NORM
from fairtag.functions import text
from fairtag.operators import classify as cls
from fairtag.operators import quality
from fairtag.session import spread
from fairtag.sources.catalog import Catalog, Modifier

# Lookaround-free patterns, so that both engines' regular expressions agree.
MODIFIERS = [
    Modifier("wanted", (r"^the\b", r"^(?:ich|le) "), exclude=True),
    Modifier("faulty", (r"worthless", r"\bidiot\b", r"pathetic"), exclude=True),
    Modifier("licensed", (r"mit license", r"general public license", r"\bversion \d+"), price_adjust_pct=-8.0),
    Modifier("marked", (r"\bwh", r"ou\b"), price_adjust_pct=-30.0),
    Modifier("cheap", (r"\bis\b.*\bof\b",), price_adjust_pct=10.0),
]


def document_listings(spark, sf):
    """First line as the title, the whole text as the description."""
    return spread(read(spark, sf, "documents")).selectExpr(
        "CAST(doc_id AS STRING) AS listing_id", "split(text, '\n')[0] AS title", "text AS description",
        "n_chars AS price_cents",
    )


DOC_SQL = f"""
t AS (SELECT CAST(doc_id AS VARCHAR) AS listing_id, n_chars AS price_cents, string_split(text, chr(10))[1] AS title, text FROM documents),
x AS (SELECT *, {NORM.format('title')} AS norm, {NORM.format("title || ' ' || text")} AS hay FROM t)
"""


def _rx(column: str, modifier: Modifier) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{p}')" for p in modifier.patterns) + ")"


EXCLUDED = f"CASE WHEN {_rx('norm', MODIFIERS[0])} THEN 'wanted' WHEN {_rx('hay', MODIFIERS[1])} THEN 'faulty' END"
FOUND = "list_filter([" + ", ".join(
    f"CASE WHEN {_rx('hay', m)} THEN '{m.modifier_id}' END" for m in MODIFIERS[2:]
) + "], lambda v: v IS NOT NULL)"
PCT = " + ".join(f"CASE WHEN {_rx('hay', m)} THEN {m.price_adjust_pct}e0 ELSE 0e0 END" for m in MODIFIERS[2:])
DOC_CATALOG = Catalog("docs", products=None, modifiers=MODIFIERS)  # type: ignore[arg-type]


@check("cls_1_exclusions", with_ctes(DOC_SQL, select=f" SELECT listing_id, {EXCLUDED} AS excluded_by FROM x"))
def cls_1(spark, sf):
    return cls.read_titles(document_listings(spark, sf), DOC_CATALOG).select("listing_id", "excluded_by")


@check(
    "cls_7_price_modifiers",
    with_ctes(DOC_SQL, select=f" SELECT listing_id, array_to_string({FOUND}, ',') AS modifiers, {PCT} AS adjust_pct FROM x"),
)
def cls_7(spark, sf):
    read_ = cls.read_titles(document_listings(spark, sf), DOC_CATALOG)
    return read_.select("listing_id", F.array_join("found", ",").alias("modifiers"), "adjust_pct")


@check(
    "cls_8_adjusted_price",
    with_ctes(DOC_SQL, select=f"""
SELECT listing_id, CAST(round_even(price_cents * (1 + greatest(least({PCT}, 35e0), -35e0) / 1e2), 0) AS BIGINT) AS adjusted_cents FROM x"""),
)
def cls_8(spark, sf):
    read_ = cls.read_titles(document_listings(spark, sf), DOC_CATALOG)
    return read_.select("listing_id", cls.adjusted_cents(F.col("price_cents"), F.col("adjust_pct")).alias("adjusted_cents"))


# A catalog of 5,000 modifiers: the beginnings of words, every seventh excludes.
LETTERS = "etaoinshrdlucmfwyp"
MANY = [
    Modifier(f"m{i}", (rf"\b{LETTERS[i // 324]}{LETTERS[i // 18 % 18]}{LETTERS[i % 18]}",), i % 7 == 0 and i > 2000, float(i % 5))
    for i in range(5_000)
]


@check("cls_1_7_many_modifiers", with_ctes(DOC_SQL, select=rf"""
, starts AS (SELECT DISTINCT listing_id, unnest(regexp_extract_all(hay, '\b[a-z][a-z][a-z]')) AS start FROM x),
many AS (SELECT i, concat('{LETTERS}'[i // 324 + 1], '{LETTERS}'[i // 18 % 18 + 1], '{LETTERS}'[i % 18 + 1]) AS start, i % 7 = 0 AND i > 2000 AS exclude
  FROM (SELECT unnest(range(5000)) AS i)),
hits AS (SELECT listing_id, min(i) FILTER (exclude) AS first, string_agg('m' || i, ',' ORDER BY i) FILTER (NOT exclude) AS modifiers,
  sum(i % 5) FILTER (NOT exclude) AS pct FROM starts JOIN many USING (start) GROUP BY ALL)
SELECT x.listing_id, 'm' || first AS excluded_by, coalesce(modifiers, '') AS modifiers, CAST(coalesce(pct, 0) AS DOUBLE) AS adjust_pct
FROM x LEFT JOIN hits ON hits.listing_id = x.listing_id"""))
def cls_1_7_many(spark, sf):
    """Every price modifier found among 5,000, and the first exclusion of all documents."""
    read_ = cls.read_titles(document_listings(spark, sf), Catalog("docs", products=None, modifiers=MANY))  # type: ignore[arg-type]
    return read_.select("listing_id", "excluded_by", F.array_join("found", ",").alias("modifiers"), "adjust_pct")


# Part ads: the catalog is read off the part names, the ads off parts and order lines.


def place(adj: str, noun: str) -> str:
    """Catalog position from the first two letters of both words, the same in both engines."""
    letters = [f"(ascii(substr({word}, {i}, 1)) - 97)" for word in (adj, noun) for i in (1, 2)]
    return f"((({letters[0]} * 26 + {letters[1]}) * 26 + {letters[2]}) * 26 + {letters[3]})"


def part_catalog(spark, sf):
    """Nouns as base products and adjective-noun pairs as variants; 'red' bases are banned.

    Bases carry ``any_of`` brands only where the noun ends in g, so every kind of rule occurs.
    """
    names = read(spark, sf, "part").select(
        F.split("p_name", " ")[0].alias("adj"), F.split("p_name", " ")[1].alias("noun")
    ).distinct()
    empty = "CAST(array() AS ARRAY<STRING>)"
    pairs = names.filter("adj <> 'old'").selectExpr(
        f"{place('adj', 'noun')} AS pos", "concat(adj, '_', noun) AS product_id", "array(adj, noun) AS `all`",
        f"{empty} AS any_of", "IF(adj = 'new', array('promo'), " + empty + ") AS none_of",
        "array(concat(adj, ' ', noun), concat(noun, adj)) AS aliases",
    )
    bases = names.select("noun").distinct().selectExpr(
        f"{place(chr(39) + 'aa' + chr(39), 'noun')} AS pos", "concat('base_', noun) AS product_id",
        f"IF(noun LIKE '%g', {empty}, array(noun)) AS `all`",
        f"IF(noun LIKE '%g', array(noun, concat(noun, ' set')), {empty}) AS any_of",
        "array('red') AS none_of", "array(concat('vintage ', noun)) AS aliases",
    )
    return Catalog(
        category="parts",
        products=pairs.unionByName(bases).selectExpr(
            "'parts' AS category", "CAST(pos AS INT) AS pos", "product_id", "product_id AS label", "`all`", "any_of",
            "none_of", "aliases",
        ),
        modifiers=[
            Modifier("wanted_ad", (r"^want",), exclude=True),
            Modifier("faulty", (r"broken", r"for parts"), exclude=True),
            Modifier("warranty", ("warranty",), price_adjust_pct=-8.0),
            Modifier("mined_on", (r"\bused \d+ years",), price_adjust_pct=10.0),
        ],
        version="v1",
    )


PART_TITLE = """
  CASE WHEN l_linenumber = 6 THEN 'Wanted: ' WHEN l_linenumber = 7 THEN 'OLD ' ELSE 'Sell ' END {cat}
  CASE WHEN l_suppkey % 9 = 0 THEN left(p_name, length(p_name) - 1) WHEN l_suppkey % 9 = 1 THEN replace(p_name, ' ', '  ')
       WHEN l_suppkey % 9 = 2 THEN split_part(p_name, ' ', 2) WHEN l_suppkey % 9 = 3 THEN 'x' {cat} replace(p_name, ' ', '-y ')
       WHEN l_suppkey % 9 = 4 THEN split_part(p_name, ' ', 1) ELSE upper(p_name) END {cat}
  CASE WHEN l_linenumber = 5 THEN ' venda gpu' WHEN l_linenumber = 4 THEN '!!' {cat} p_type ELSE '' END
"""
PART_TEXT = """
  CASE WHEN l_suppkey % 11 = 0 THEN 'broken' WHEN l_suppkey % 11 = 1 THEN 'with warranty, used 3 years'
       WHEN l_suppkey % 11 = 2 THEN 'warranty' ELSE '' END
"""


def part_listings(spark, sf, items=None):
    items = read(spark, sf, "lineitem") if items is None else items
    return spread(items).join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS listing_id", "'parts' AS category",
        f"{PART_TITLE.format(cat='||')} AS title", f"{PART_TEXT} AS description",
        "CAST(floor(l_extendedprice) AS BIGINT) AS price_cents", "CAST(l_shipdate AS TIMESTAMP) AS last_seen",
    )


RULES_SQL = f"""
nm AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun FROM part),
rule AS (
  SELECT {place('adj', 'noun')} AS pos, adj || '_' || noun AS product_id, [adj, noun] AS al, []::VARCHAR[] AS any_of,
    CASE WHEN adj = 'new' THEN ['promo'] ELSE [] END AS none_of, [adj || ' ' || noun, noun || adj] AS aliases FROM nm WHERE adj <> 'old'
  UNION ALL
  SELECT DISTINCT {place("'aa'", 'noun')}, 'base_' || noun, CASE WHEN noun LIKE '%g' THEN [] ELSE [noun] END,
    CASE WHEN noun LIKE '%g' THEN [noun, noun || ' set'] ELSE [] END, ['red'], ['vintage ' || noun] FROM nm),
prod AS (SELECT * FROM rule)
"""
ADS_SQL = f"""
ad AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS listing_id,
    {PART_TITLE.format(cat='||')} AS title, {PART_TEXT} AS description, CAST(floor(l_extendedprice) AS BIGINT) AS price_cents,
    l_shipdate AS last_seen
  FROM lineitem JOIN part ON l_partkey = p_partkey)
"""
MATCH_SQL = f"""
y AS (SELECT *, {NORM.format('title')} AS norm, {NORM.format("title || ' ' || description")} AS hay FROM ad),
z AS (
  SELECT *, CASE WHEN regexp_matches(norm, '^want') THEN 'wanted_ad' WHEN regexp_matches(hay, 'broken|for parts') THEN 'faulty' END AS excluded_by,
    regexp_matches(hay, 'warranty') AS w, regexp_matches(hay, '\\bused \\d+ years') AS u FROM y),
titles AS (SELECT DISTINCT norm FROM z WHERE excluded_by IS NULL),
hit AS (
  SELECT norm, product_id, 10 * len(al) + len(any_of) AS spec, pos FROM titles, prod
  WHERE len(list_filter(al, lambda n: NOT contains(' ' || norm || ' ', ' ' || n || ' '))) = 0
    AND (len(any_of) = 0 OR len(list_filter(any_of, lambda n: contains(' ' || norm || ' ', ' ' || n || ' '))) > 0)
    AND len(list_filter(none_of, lambda n: contains(' ' || norm || ' ', ' ' || n || ' '))) = 0),
win AS (SELECT norm, arg_max(product_id, (spec, -pos)) AS rule_product, max(spec) AS spec FROM hit GROUP BY norm)
"""
PART_SQL = ",\n".join(part.strip() for part in (RULES_SQL, ADS_SQL, MATCH_SQL))

# Similarity by its definition: every unmatched title against every alias, the
# longest common subsequence by the textbook table, row after row.
FUZZY_SQL = """
al0 AS (SELECT pos, product_id, none_of, unnest(aliases) AS raw, unnest(range(len(aliases))) AS nth FROM prod),
al1 AS (SELECT raw AS alias, min((pos, nth)) AS first, arg_max(product_id, (pos, nth)) AS product_id, arg_max(none_of, (pos, nth)) AS none_of FROM al0 GROUP BY raw),
un AS (SELECT norm, list_sort(list_distinct(list_filter(string_split(norm, ' '), lambda v: v <> '' AND v NOT IN ({noise})))) AS tw
  FROM titles WHERE norm <> '' AND norm NOT IN (SELECT norm FROM win)),
pr AS (SELECT norm, alias, first, product_id, none_of, tw, list_sort(list_distinct(string_split(alias, ' '))) AS aw FROM un, al1 WHERE len(tw) > 0),
sp AS (SELECT *, array_to_string(list_filter(tw, lambda v: list_contains(aw, v)), ' ') AS i,
  array_to_string(list_filter(tw, lambda v: NOT list_contains(aw, v)), ' ') AS a,
  array_to_string(list_filter(aw, lambda v: NOT list_contains(tw, v)), ' ') AS b FROM pr),
st AS (SELECT DISTINCT a, b FROM sp WHERE a <> '' AND b <> ''),
lc AS (
  SELECT a, b, list_reduce(
      list_transform(string_split(a, ''), lambda c: list_transform(string_split(b, ''), lambda d: CASE WHEN c = d THEN 1 ELSE 0 END)),
      lambda p, m: list_transform(range(1, len(m) + 1), lambda j: list_max(list_transform(range(1, j + 1),
        lambda k: greatest(p[k], m[k] + CASE WHEN k > 1 THEN p[k - 1] ELSE 0 END)))),
      list_transform(string_split(b, ''), lambda d: 0)) AS row FROM st),
sc AS (
  SELECT sp.*, length(i) AS ni, CASE WHEN i <> '' THEN 1 ELSE 0 END AS g, length(sp.a) AS na, length(sp.b) AS nb,
    length(sp.a) + length(sp.b) - 2 * coalesce(row[len(row)], 0) AS dist FROM sp LEFT JOIN lc ON sp.a = lc.a AND sp.b = lc.b),
fs AS (
  SELECT *, CASE WHEN i <> '' AND (na = 0 OR nb = 0) THEN 100e0 ELSE greatest(100 - 100e0 * dist / (2 * (ni + g) + na + nb),
    CASE WHEN i <> '' THEN 100 - 100e0 * (g + na) / (2 * ni + g + na) ELSE 0e0 END,
    CASE WHEN i <> '' THEN 100 - 100e0 * (g + nb) / (2 * ni + g + nb) ELSE 0e0 END) END AS score FROM sc),
bf AS (SELECT norm, arg_max(product_id, (score, -first[1], -first[2])) AS fuzzy_product, max(score) AS fuzzy_score,
  arg_max(none_of, (score, -first[1], -first[2])) AS none_of FROM fs WHERE score >= 88 GROUP BY norm),
fz AS (SELECT norm, fuzzy_product, fuzzy_score FROM bf WHERE len(list_filter(none_of, lambda n: contains(' ' || norm || ' ', ' ' || n || ' '))) = 0)
""".replace("{noise}", ", ".join(f"'{w}'" for w in text.NOISE_WORDS))

RESULT_SQL = """
res AS (
  SELECT listing_id, norm, title, last_seen, excluded_by, rule_product, spec, fuzzy_product, fuzzy_score, price_cents,
    CASE WHEN excluded_by IS NOT NULL THEN 'excluded' WHEN rule_product IS NOT NULL THEN 'rule' WHEN fuzzy_product IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS match_kind,
    CASE WHEN excluded_by IS NULL THEN coalesce(rule_product, fuzzy_product) END AS product_id,
    CASE WHEN excluded_by IS NULL AND coalesce(rule_product, fuzzy_product) IS NOT NULL
      THEN CASE WHEN w THEN -8e0 ELSE 0e0 END + CASE WHEN u THEN 10e0 ELSE 0e0 END ELSE 0e0 END AS adjust_pct
  FROM z LEFT JOIN win USING (norm) LEFT JOIN fz USING (norm))
"""


def ruled(spark, sf):
    catalog = part_catalog(spark, sf)
    return cls.best_rule(cls.read_titles(part_listings(spark, sf), catalog), catalog.products)


@check(
    "cls_2_rule_predicate",
    with_ctes(PART_SQL, select=" SELECT DISTINCT norm AS normalized_title, product_id FROM hit"),
)
def cls_2(spark, sf):
    catalog = part_catalog(spark, sf)
    titles = cls.read_titles(part_listings(spark, sf), catalog).filter("excluded_by is null").select("normalized_title").distinct()
    anchored = cls.rule_anchors(catalog.products).join(catalog.products.select("pos", "product_id"), "pos")
    words = titles.withColumn("word", F.explode(text.tokens(F.col("normalized_title"))))
    holds = text.rule_holds(text.padded(F.col("normalized_title")), F.col("all"), F.col("any_of"), F.col("none_of"))
    return words.join(anchored, F.col("word") == F.col("anchor")).filter(holds).select("normalized_title", "product_id").distinct()


@check(
    "cls_3_most_specific_winner",
    with_ctes(PART_SQL, select="""
SELECT listing_id, CASE WHEN excluded_by IS NULL THEN rule_product END AS rule_product, CASE WHEN excluded_by IS NULL THEN spec END AS specificity
FROM z LEFT JOIN win USING (norm)"""),
)
def cls_3(spark, sf):
    return ruled(spark, sf).select("listing_id", "rule_product", "specificity")


@check(
    "cls_4_5_6_fuzzy_fallback",
    with_ctes(PART_SQL, FUZZY_SQL, select=" SELECT norm AS normalized_title, fuzzy_product, round(fuzzy_score, 6) AS fuzzy_score FROM fz"),
)
def cls_4(spark, sf):
    residue = ruled(spark, sf).filter("open")
    return cls.fuzzy_match(residue, part_catalog(spark, sf).products).select(
        "normalized_title", "fuzzy_product", (F.rint(F.col("fuzzy_score") * 1e6) / 1e6).alias("fuzzy_score")
    )


# Misspelt part ads: every part's name and type with letters lost, doubled or replaced, words moved or added.
VARIANT = """
  CASE p_partkey % 7
    WHEN 0 THEN left(base, spot - 1) || substr(base, spot + 1) WHEN 1 THEN left(base, spot) || substr(base, spot)
    WHEN 2 THEN lower(p_type) || ' ' || p_name WHEN 3 THEN left(base, spot - 1) || 'q' || substr(base, spot + 1)
    WHEN 4 THEN base || ' ' || lower(replace(p_brand, '#', ' ')) WHEN 5 THEN left(base, spot - 1) || substr(base, spot + 1, 4) || substr(base, spot + 6)
    ELSE p_name || ' ' || lower(replace(p_brand, '#', '')) END
"""
VARIANT_PARTS = "SELECT *, p_name || ' ' || lower(p_type) AS base, CAST(2 + p_partkey % 13 AS INT) AS spot FROM part"
VARIANT_SQL = f"""
titles AS (SELECT DISTINCT {VARIANT} AS norm FROM ({VARIANT_PARTS})),
win AS (SELECT '' AS norm WHERE false),
prod AS (
  SELECT CAST(min(p_partkey) AS INT) AS pos, p_name || '/' || p_type AS product_id, [p_name || ' ' || lower(p_type)] AS aliases,
    CASE WHEN p_name LIKE '%gear' THEN ['brand 1', 'brand 17', 'brand 9'] ELSE [] END AS none_of
  FROM part GROUP BY p_name, p_type)
"""
# Fewer inserts and deletes than edits there cannot be, so only pairs within the cutoff by edits need the table.
NEAR_FUZZY_SQL = FUZZY_SQL.replace(
    "st AS (SELECT DISTINCT a, b FROM sp WHERE a <> '' AND b <> '')",
    "st AS (SELECT DISTINCT a, b FROM sp WHERE a <> '' AND b <> '' AND "
    "levenshtein(a, b) <= 0.12 * (2 * (length(i) + CASE WHEN i <> '' THEN 1 ELSE 0 END) + length(a) + length(b)) + 1e-9)",
)


def variants(spark, sf):
    """(titles, products) of the misspelt part ads."""
    parts = read(spark, sf, "part")
    titles = parts.selectExpr("*", "p_name || ' ' || lower(p_type) AS base", "CAST(2 + p_partkey % 13 AS INT) AS spot").selectExpr(
        f"{VARIANT} AS normalized_title"
    )
    products = parts.groupBy("p_name", "p_type").agg(F.min("p_partkey").cast("int").alias("pos")).selectExpr(
        "pos", "p_name || '/' || p_type AS product_id", "array(p_name || ' ' || lower(p_type)) AS aliases",
        "IF(p_name LIKE '%gear', array('brand 1', 'brand 17', 'brand 9'), CAST(array() AS ARRAY<STRING>)) AS none_of",
    )
    return titles, products


@check(
    "cls_4_fuzzy_variants",
    with_ctes(VARIANT_SQL, NEAR_FUZZY_SQL, select="""
SELECT norm AS normalized_title, CASE WHEN fz.norm IS NOT NULL THEN bf.fuzzy_product END AS fuzzy_product, round(bf.fuzzy_score, 6) AS best_score
FROM bf LEFT JOIN fz USING (norm)"""),
)
def cls_4_variants(spark, sf):
    """Every title that reaches the cutoff with its best score; vetoed ones have no product."""
    titles, products = variants(spark, sf)
    never = products.withColumn("none_of", F.array().cast("array<string>"))
    best = cls.fuzzy_match(titles, never).select("normalized_title", (F.rint(F.col("fuzzy_score") * 1e6) / 1e6).alias("best_score"))
    kept = cls.fuzzy_match(titles, products).select("normalized_title", "fuzzy_product")
    return best.join(kept, "normalized_title", "left")


@check(
    "cls_classify",
    with_ctes(PART_SQL, FUZZY_SQL, RESULT_SQL, select="""
SELECT listing_id, match_kind, product_id, excluded_by, adjust_pct,
  CAST(round_even(price_cents * (1 + adjust_pct / 1e2), 0) AS BIGINT) AS adjusted_cents FROM res"""),
)
def cls_all(spark, sf):
    return cls.classify(part_listings(spark, sf), part_catalog(spark, sf)).select(
        "listing_id", "match_kind", "product_id", "excluded_by", "adjust_pct", "adjusted_cents"
    )


# Half of the ads have an up-to-date result, some a stale one, the rest none.
@check(
    "cls_9_incremental_reclassify",
    with_ctes(PART_SQL, FUZZY_SQL, RESULT_SQL, select="""
, todo AS (SELECT * FROM res WHERE price_cents % 4 = 0 OR price_cents % 4 = 1 AND last_seen > TIMESTAMP '1998-06-01' OR price_cents % 4 = 2),
k(match_kind) AS (VALUES ('rule'), ('fuzzy'), ('none'), ('excluded'))
SELECT k.match_kind, count(todo.listing_id) AS n FROM k LEFT JOIN todo USING (match_kind) GROUP BY ALL"""),
)
def cls_9(spark, sf):
    listings, catalog = part_listings(spark, sf), part_catalog(spark, sf)
    known = listings.filter("price_cents % 4 <> 0").selectExpr(
        "listing_id", "category", "CAST(NULL AS STRING) AS product_id", "'none' AS match_kind", "0D AS match_score",
        "CAST(NULL AS STRING) AS excluded_by", "CAST(array() AS ARRAY<STRING>) AS modifiers", "0D AS adjust_pct",
        "price_cents AS adjusted_cents", "'' AS normalized_title",
        "IF(price_cents % 4 = 2, 'v0', 'v1') AS catalog_version",
        "IF(price_cents % 4 = 1, TIMESTAMP '1998-06-01', TIMESTAMP '2030-01-01') AS updated_at",
    )
    fresh, _ = cls.reclassify(listings, known, catalog, F.lit("2030-01-02").cast("timestamp"))
    return cls.kind_counts(fresh)


# An edit of the catalog: hot parts banned from one kind of ad, rods no longer a base product, blue parts with one more alias.
EDITED_RULES_SQL = RULES_SQL.replace(
    "CASE WHEN adj = 'new' THEN ['promo'] ELSE [] END", "CASE WHEN adj = 'new' THEN ['promo'] WHEN adj = 'hot' THEN ['old'] ELSE [] END"
).replace(
    "[adj || ' ' || noun, noun || adj] AS aliases", "[adj || ' ' || noun, noun || adj] || CASE WHEN adj = 'blue' THEN ['azure ' || noun] ELSE [] END AS aliases"
).replace("['vintage ' || noun] FROM nm)", "['vintage ' || noun] FROM nm WHERE noun <> 'rod')")


def edited_products(products):
    is_hot, is_blue = (F.startswith("product_id", F.lit(f"{adj}_")) for adj in ("hot", "blue"))
    noun = F.split("product_id", "_")[1]
    return products.filter("product_id <> 'base_rod'").withColumns({
        "none_of": F.when(is_hot, F.array(F.lit("old"))).otherwise(F.col("none_of")),
        "aliases": F.when(is_blue, F.concat("aliases", F.array(F.concat(F.lit("azure "), noun)))).otherwise(F.col("aliases")),
    })


def rematched(spark, sf):
    catalog = part_catalog(spark, sf)
    names = cls.open_titles(cls.read_titles(part_listings(spark, sf), catalog))
    before = cls.match_titles(names, catalog.products)
    return names, before, cls.rematch_titles(names, before, catalog.products, edited_products(catalog.products))


@check(
    "cls_9_delta_rematch",
    with_ctes(EDITED_RULES_SQL, ADS_SQL, MATCH_SQL, FUZZY_SQL, select="""
SELECT norm AS normalized_title, rule_product AS product_id, spec AS specificity, CAST(NULL AS DOUBLE) AS fuzzy_score FROM win WHERE norm <> ''
UNION ALL SELECT norm, fuzzy_product, NULL, round(fuzzy_score, 6) FROM fz"""),
)
def cls_9_delta(spark, sf):
    """All titles' matches under the edited catalog, of which only the titles that the edit can reach were matched again."""
    _, _, (_, after) = rematched(spark, sf)
    return after.select(
        "normalized_title", F.col("rule_product").alias("product_id"), "specificity", (F.rint(F.col("fuzzy_score") * 1e6) / 1e6).alias("fuzzy_score")
    )


QUEUE_SQL = """
q AS (SELECT left(sha1(norm), 16) AS title_hash, arg_min(left(title, 300), (listing_id)) AS sample_title, count(*) AS occurrences
  FROM res WHERE match_kind = 'none' AND norm <> '' GROUP BY norm)
"""
NOW = "2001-01-01"


def queue(spark, sf):
    listings = part_listings(spark, sf)
    results = cls.classify(listings, part_catalog(spark, sf))
    return cls.unmatched_titles(results, listings, F.lit(NOW).cast("timestamp"))


UNMATCHED = (PART_SQL, FUZZY_SQL, RESULT_SQL, QUEUE_SQL)


@check("cls_10_unmatched_titles", with_ctes(*UNMATCHED, select=" SELECT title_hash, sample_title, occurrences FROM q"))
def cls_10(spark, sf):
    return queue(spark, sf).select("title_hash", "sample_title", "occurrences")


@check(
    "cls_11_dismiss_unmatched",
    with_ctes(*UNMATCHED, select=" SELECT title_hash, occurrences % 2 = 0 AS resolved FROM q"),
)
def cls_11(spark, sf):
    titles = queue(spark, sf)
    return cls.dismiss(titles, titles.filter("occurrences % 2 = 0")).select("title_hash", "resolved")


# The dry run scans all titles here; the newest 4000 are the default of the operator.
@check(
    "qlt_6_rule_preview",
    with_ctes(PART_SQL, FUZZY_SQL, RESULT_SQL, select="""
SELECT listing_id, left(title, 90) AS title, price_cents / 1e2 AS price_eur, product_id AS current,
  coalesce(product_id <> 'base_ring', false) AS steals
FROM res WHERE match_kind <> 'excluded' AND norm <> '' AND contains(' ' || norm || ' ', ' ring ')
  AND (contains(' ' || norm || ' ', ' small ') OR contains(' ' || norm || ' ', ' old ')) AND NOT contains(' ' || norm || ' ', ' gpu ')"""),
)
def qlt_6(spark, sf):
    listings = part_listings(spark, sf)
    results = cls.classify(listings, part_catalog(spark, sf)).withColumn("updated_at", F.lit(NOW).cast("timestamp"))
    _, matches = quality.preview_rule(
        results, listings, ["Ring"], ["SMALL", "old"], ["gpu"], product_id="base_ring"
    )
    return matches.drop("updated_at")


@check(
    "qlt_6_rule_preview_summary",
    with_ctes(PART_SQL, FUZZY_SQL, RESULT_SQL, select="""
, sc0 AS (SELECT *, contains(' ' || norm || ' ', ' ring ') AS m FROM res WHERE match_kind <> 'excluded' AND norm <> '')
SELECT count(*) AS scanned, count(*) FILTER (WHERE m) AS matched,
  count(*) FILTER (WHERE m AND coalesce(product_id <> 'base_ring', false)) AS steal_count FROM sc0"""),
)
def qlt_6_summary(spark, sf):
    listings = part_listings(spark, sf)
    results = cls.classify(listings, part_catalog(spark, sf)).withColumn("updated_at", F.lit(NOW).cast("timestamp"))
    scanned, matches = quality.preview_rule(results, listings, ["ring"], [], [], "base_ring")
    return quality.preview_summary(scanned, matches)


# Two catalogs, ads of odd orders in the second; the newest examples of each sort, of one catalog only.
@check(
    "qlt_6_rule_preview_examples",
    with_ctes(PART_SQL, FUZZY_SQL, RESULT_SQL, select="""
, m AS (
  SELECT listing_id, left(title, 90) AS title, coalesce(product_id <> 'base_ring', false) AS steals, last_seen FROM res
  WHERE match_kind <> 'excluded' AND norm <> '' AND contains(' ' || norm || ' ', ' ring ') AND CAST(split_part(listing_id, '-', 1) AS BIGINT) % 2 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY steals ORDER BY last_seen DESC, listing_id) AS place FROM m)
SELECT listing_id, title, steals, place FROM n WHERE place <= 10"""),
)
def qlt_6_examples(spark, sf):
    listings = part_listings(spark, sf)
    odd = F.split("listing_id", "-")[0].cast("bigint") % 2 == 1
    results = cls.classify(listings, part_catalog(spark, sf)).join(
        listings.select("listing_id", F.col("last_seen").alias("updated_at")), "listing_id"
    ).withColumn("category", F.when(odd, "others").otherwise(F.col("category")))
    _, matches = quality.preview_rule(results, listings, ["ring"], [], [], "base_ring", category="parts")
    return quality.preview_examples(matches).select("listing_id", "title", "steals", "place")
