"""Data-quality findings over the catalog tables, and the dry run of a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairtag.functions import text
from fairtag.functions.ordered import with_previous
from fairtag.operators.market import PRODUCT
from fairtag.params import Params


def _finding(level: str, message: Column, where: Column) -> list[Column]:
    return [F.lit(level).alias("level"), message.alias("message"), where.alias("where")]


def _place(table: str, key: str) -> Column:
    shown = F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit("?"))
    return F.concat(F.lit(f"{table}["), F.col("pos").cast("string"), F.lit("] ("), shown, F.lit(")"))


def _has_id() -> Column:
    return F.coalesce(F.col("product_id") != "", F.lit(False))


def _size(name: str) -> Column:
    return F.coalesce(F.nullif(F.size(name), F.lit(-1)), F.lit(0))


def rule_words(products: DataFrame) -> DataFrame:
    """Single words of each rule: "5080Ti" counts as two."""

    def split(name: str) -> Column:
        needles = F.coalesce(F.col(name), F.array().cast("array<string>"))
        return F.array_distinct(F.flatten(F.transform(needles, lambda n: text.words(text.normalize(n)))))

    return products.filter(_has_id()).select(
        *PRODUCT, "pos", split("all").alias("required"), split("none_of").alias("banned")
    ).filter("size(required) > 0")


def variant_swallowing(products: DataFrame) -> DataFrame:
    """Rules whose required words are a strict subset of another's without banning the rest.

    Each rule meets only the rules that hold its rarest word, so common words
    pair nothing.
    """
    rules = rule_words(products)
    spread = rules.select("category", F.col("product_id").alias("owner"), F.col("pos").alias("at"), F.explode("required").alias("word"))
    rarity = spread.groupBy("category", "word").agg(F.count(F.lit(1)).alias("uses"))
    rarest = (
        spread.join(rarity, ["category", "word"])
        .groupBy("category", "owner", "at")
        .agg(F.min(F.struct("uses", "word"))["word"].alias("word"))
    )
    short = rarest.join(
        rules.select("category", F.col("product_id").alias("owner"), F.col("pos").alias("at"), "required", "banned"),
        ["category", "owner", "at"],
    )
    long = rules.select(
        "category", "product_id", "pos", F.col("required").alias("longer"), F.explode("required").alias("word")
    )
    missing = F.array_sort(F.array_except("longer", "required"))
    listed = F.array_join("missing", ", ")
    needs = F.concat(F.lit("['"), F.array_join(F.array_sort("required"), "', '"), F.lit("']"))
    owner = F.col("owner")
    message = F.concat(
        F.lit("'"), owner, F.lit("' will swallow '"), F.col("product_id"), F.lit("' listings: it requires "),
        needs, F.lit(" and does not exclude "), listed, F.lit(". Add none_of: ["), listed, F.lit("] to '"),
        owner, F.lit("'."),
    )
    return (
        short.join(long, ["category", "word"])
        .filter(F.col("owner") != F.col("product_id"))
        .filter(F.size(F.array_except("required", "longer")) == 0)
        .withColumn("missing", missing)
        .filter((F.size("missing") > 0) & ~F.arrays_overlap("missing", "banned"))
        .select(
            "category", owner.alias("product_id"), F.col("product_id").alias("swallowed_id"), "missing",
            *_finding("error", message, F.concat(F.lit("products / "), owner)),
        )
    )


def duplicate_ids(products: DataFrame) -> DataFrame:
    """Every repeat of a product id, naming the position before it.

    Positions are looked through in stretches, so an id used everywhere is not
    gathered in one task.
    """
    message = F.concat(
        F.lit("Duplicate product id '"), F.col("product_id"), F.lit("' (also at products["),
        F.col("earlier").cast("string"),
        F.lit("]). Ids are database keys — two rows would fight over one history."),  # fixed value: wording
    )
    placed = products.filter(_has_id()).select(
        *PRODUCT, "pos", F.floor(F.col("pos") / 65536).alias("_stretch")
    )
    return (
        with_previous(placed, PRODUCT, "_stretch", ["pos"], "_before")
        .filter("_before is not null")
        .withColumn("earlier", F.col("_before.pos"))
        .select(*PRODUCT, *_finding("error", message, _place("products", "product_id")))
    )


def unmatchable_rules(products: DataFrame) -> DataFrame:
    message = F.lit("Rule has neither `all` nor `any_of`, so it can never match.")
    return products.filter(_has_id() & (_size("all") + _size("any_of") == 0)).select(
        *PRODUCT, *_finding("error", message, _place("products", "product_id"))
    )


def _attribute_findings(products: DataFrame, declared: Column, rank_by: Column) -> DataFrame:
    attributes = F.coalesce("attributes", F.create_map().cast("map<string,double>"))
    unknown = (
        products.filter(_has_id())
        .withColumn("attr", F.explode(F.array_except(F.map_keys(attributes), declared)))
        .select(
            *PRODUCT,
            *_finding(
                "warning",
                F.concat(F.lit("attribute '"), F.col("attr"), F.lit("' is not declared in the top-level `attributes` block")),
                _place("products", "product_id"),
            ),
        )
    )
    value = F.coalesce(F.try_element_at(attributes, rank_by), F.lit(0.0))
    unranked = products.filter(_has_id() & F.coalesce(rank_by != "", F.lit(False)) & (value == 0)).select(
        *PRODUCT,
        *_finding(
            "info",
            F.concat(F.lit("no '"), rank_by, F.lit("' value — this product is excluded from the value ranking")),
            _place("products", "product_id"),
        ),
    )
    return unknown.unionByName(unranked)


def attribute_findings(products: DataFrame, declared: list[str], rank_by: str) -> DataFrame:
    """Undeclared attributes (warning) and products without the rank attribute (info)."""
    known = F.array(*[F.lit(a) for a in declared]) if declared else F.array().cast("array<string>")
    return _attribute_findings(products, known, F.lit(rank_by))


def missing_ids(products: DataFrame) -> DataFrame:
    return products.filter(~_has_id()).select(
        *PRODUCT, *_finding("error", F.lit("Product has no id"), _place("products", "product_id"))
    )


def modifier_findings(modifiers: DataFrame) -> DataFrame:
    """Modifiers without an id (error) or without patterns (warning)."""
    nameless = ~F.coalesce(F.col("modifier_id") != "", F.lit(False))
    where = _place("modifiers", "modifier_id")
    return modifiers.filter(nameless).select(
        "category", *_finding("error", F.lit("Modifier has no id"), where)
    ).unionByName(
        modifiers.filter(_size("patterns") == 0).select(
            "category", *_finding("warning", F.lit("Modifier has no patterns"), where)
        )
    )


def category_findings(categories: DataFrame, query_terms: DataFrame) -> DataFrame:
    """Per catalog (category, rank_by, attributes): missing key, no search terms, unknown rank attribute."""
    blank = ~F.coalesce(F.col("category") != "", F.lit(False))
    undeclared = F.coalesce(F.col("rank_by") != "", F.lit(False)) & ~F.array_contains("attributes", F.col("rank_by"))
    searched = query_terms.select("category").distinct()
    none = F.lit("")
    return (
        categories.filter(blank)
        .select("category", *_finding("error", F.lit("Missing required key: category"), none))
        .unionByName(
            categories.join(searched, "category", "left_anti").select(
                "category",
                *_finding("warning", F.lit("No query_terms — the collector has nothing broad to search for."), none),
            )
        )
        .unionByName(
            categories.filter(undeclared).select(
                "category",
                *_finding(
                    "warning",
                    F.concat(
                        F.lit("rank_by '"), F.col("rank_by"),
                        F.lit("' is not in attributes, so the compare view will rank everything at zero."),
                    ),
                    none,
                ),
            )
        )
    )


def catalog_report(categories: DataFrame, products: DataFrame, modifiers: DataFrame, query_terms: DataFrame) -> DataFrame:
    """All findings over the catalogs as one table: category, subject, level, message, where.

    ``categories`` holds (category, rank_by, attributes) of each catalog; products and modifiers are judged against their own.
    """
    own = products.join(
        categories.select("category", F.col("attributes").alias("_declared"), F.col("rank_by").alias("_rank_by")), "category", "left"
    )
    declared = F.coalesce("_declared", F.array().cast("array<string>"))
    parts = {
        "catalog": [category_findings(categories, query_terms)],
        "modifier": [modifier_findings(modifiers)],
        "product": [
            missing_ids(products), duplicate_ids(products), unmatchable_rules(products),
            _attribute_findings(own, declared, F.coalesce("_rank_by", F.lit(""))), variant_swallowing(products),
        ],
    }
    rows = [found.select("category", F.lit(subject).alias("subject"), "level", "message", "where") for subject, all_ in parts.items() for found in all_]
    return reduce(DataFrame.unionByName, rows)


def order_violations(products: DataFrame, pairs: DataFrame, attribute: str) -> DataFrame:
    """Pairs (faster_id, slower_id) whose attribute is missing or not in that order."""
    value = F.try_element_at("attributes", F.lit(attribute))
    fast = products.select(F.col("product_id").alias("faster_id"), value.alias("faster"))
    slow = products.select(F.col("product_id").alias("slower_id"), value.alias("slower"))
    return (
        pairs.join(fast, "faster_id", "left")
        .join(slow, "slower_id", "left")
        .filter(~F.coalesce((F.col("faster") > F.col("slower")) & (F.col("slower") != 0), F.lit(False)))
    )


# Dry run of a rule against classified titles.


def _needles(values: list[str]) -> Column:
    given = [F.lit(v) for v in values if v.strip()]
    return F.transform(F.array(*given), lambda n: text.normalize(n)) if given else F.array().cast("array<string>")


def preview_rule(
    results: DataFrame,
    listings: DataFrame,
    all_of: list[str],
    any_of: list[str],
    none_of: list[str],
    product_id: str | None = None,
    scan_limit: int | None = None,
    category: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(scanned titles, matches of the candidate rule). ``steals`` marks other products' listings.

    ``category`` confines the run to one catalog. A rule that asks for no word scans nothing.
    All titles are scanned, or the newest ``scan_limit`` (``Params.preview_scan`` is the customary number).
    """
    scanned = results.filter("match_kind <> 'excluded' and normalized_title <> ''")
    if category is not None:
        scanned = scanned.filter(F.col("category") == category)
    if not any(needle.strip() for needle in [*all_of, *any_of]):
        scanned = scanned.filter(F.lit(False))
    if scan_limit is not None:
        scanned = scanned.orderBy(F.desc("updated_at"), "listing_id").limit(scan_limit)
    other_owner = F.col("product_id").isNotNull() & (F.col("product_id") != F.lit(product_id or ""))
    holds = text.rule_holds(
        text.padded(F.col("normalized_title")), _needles(all_of), _needles(any_of), _needles(none_of)
    )
    matches = (
        scanned.filter(holds)
        .join(listings.select("listing_id", "title", "price_cents"), "listing_id")
        .select(
            "listing_id", F.left("title", F.lit(90)).alias("title"),
            (F.coalesce("price_cents", F.lit(0)) / 100.0).alias("price_eur"),
            F.col("product_id").alias("current"), other_owner.alias("steals"), "updated_at",
        )
    )
    return scanned, matches


def preview_summary(scanned: DataFrame, matches: DataFrame) -> DataFrame:
    """Counts of a dry run."""
    found = matches.agg(F.count(F.lit(1)).alias("matched"), F.count_if("steals").alias("steal_count"))
    return found.withColumn("scanned", scanned.agg(F.count(F.lit(1))).scalar())


def preview_examples(matches: DataFrame, limit: int = Params().preview_examples) -> DataFrame:
    """The newest examples of each sort; a ranked filter, so each task keeps ``limit`` rows only."""
    order = Window.partitionBy("steals").orderBy(F.desc("updated_at"), "listing_id")
    return matches.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
