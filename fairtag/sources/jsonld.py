"""Product offers from the JSON-LD blocks of shop pages, as VARIANT expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairtag.functions.once import computed_once

# Fixed value: a JSON-LD script element of any attribute order.
BLOCK = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""


def page_blocks(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """One row per JSON-LD block: ``keys``, its place in the page, its text, and its JSON, null where it is none (or nested too deep)."""
    return (
        pages.filter(F.contains(F.lower(html), F.lit("ld+json")))
        .select(*keys, F.posexplode(F.regexp_extract_all(html, F.lit(BLOCK), 1)).alias("block_no", "block"))
        .select(*keys, "block_no", "block", F.try_parse_json("block").alias("node"))
    )


def refused_blocks(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Per ``keys`` the blocks found and those that were refused as JSON."""
    return page_blocks(pages, keys, html).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_blocks"), F.count_if(F.col("node").isNull()).alias("n_refused")
    )


def _bound(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of ``value``, which is worked out once however often it is used."""
    return F.transform(F.array(value), made)[0]


def _text(node: Column, field: str) -> Column:
    """A scalar field as text; empty text and, unless they are text, zero and false count as missing."""
    path = f"$['{field}']"
    is_text = F.schema_of_variant(F.try_variant_get(node, path, "variant")) == "STRING"
    return _bound(F.try_variant_get(node, path, "string"), lambda value: F.when(
        (value != "") & (is_text | ((value != "false") & ~F.coalesce(value.try_cast("double") == 0, F.lit(False)))), value
    ))


def _elements(node: Column) -> Column:
    return F.try_variant_get(node, "$", "array<variant>")


def _none(node: Column) -> Column:
    """An empty array of what ``node`` is."""
    return F.filter(F.array(node), lambda _: F.lit(False))


def _opened(nodes: Column) -> Column:
    """``nodes`` with the elements of each array in its place."""
    return F.flatten(F.transform(nodes, lambda n: F.coalesce(_elements(n), F.array(n))))


def _first_offer(offers: Column) -> Column:
    """struct<price_eur, in_stock> of the first offer with a price; arrays may stand in the place of an offer at any depth."""
    # No deeper than there are opening brackets.
    rounds = F.sequence(F.lit(1), F.length(F.regexp_replace(F.to_json(offers), r"[^\[]", "")))
    flat = _bound(_opened(_opened(F.array(offers))), lambda nodes: F.when(
        F.exists(nodes, lambda o: _elements(o).isNotNull()), F.aggregate(rounds, nodes, lambda some, _: _opened(some))
    ).otherwise(nodes))

    def read(offer: Column) -> Column:
        amount = F.replace(F.coalesce(_text(offer, "price"), _text(offer, "lowPrice")), F.lit(","), F.lit("."))
        stocked = _bound(
            F.lower(F.coalesce(_text(offer, "availability"), F.lit(""))), lambda shelf: (shelf == "") | F.contains(shelf, F.lit("instock"))
        )
        return F.struct(F.trim(amount).try_cast("double").alias("price_eur"), stocked.alias("in_stock"))

    return F.try_element_at(F.filter(F.transform(flat, read), lambda o: o["price_eur"] != 0), F.lit(1))


PRODUCT = "array<struct<path:string,name:string,price_eur:double,url:string,in_stock:boolean>>"


def _products(block: Column, root: Column) -> Column:
    """The priced products below ``root``, in the order of their paths: one row's own loop over the levels of its tree.

    A level's nodes are looked at and then replaced by their children. There are no more levels than the block has opening
    brackets; once a level is empty, nothing more is done.
    """
    def product(at: Column) -> Column:
        node = at["node"]
        return _bound(_first_offer(F.try_variant_get(node, "$.offers", "variant")), lambda offer: F.struct(
            at["path"].alias("path"), _text(node, "name").alias("name"), offer["price_eur"].alias("price_eur"),
            F.coalesce(_text(node, "url"), _text(node, "@id"), F.lit("")).alias("url"), offer["in_stock"].alias("in_stock"),
        ))

    def children(at: Column) -> Column:
        fields = F.map_values(F.try_variant_get(at["node"], "$", "map<string,variant>"))
        below = F.coalesce(_elements(at["node"]), fields, _none(at["node"]))
        # Positions are written with leading zeros, so paths sort as text.
        return F.transform(below, lambda n, i: F.struct(
            F.concat(at["path"], F.lpad(i.cast("string"), 10, "0")).alias("path"), n.alias("node")
        ))

    def step(done: Column, _: Column) -> Column:
        offering = F.filter(done["level"], lambda at: F.try_variant_get(at["node"], "$.offers", "variant").isNotNull())
        priced = F.filter(F.transform(offering, product), lambda p: (
            (p["price_eur"] > 0) & (p["price_eur"] < float("inf")) & p["name"].isNotNull()
        ))
        more = F.struct(
            F.flatten(F.transform(done["level"], children)).alias("level"), F.concat(done["found"], priced).alias("found")
        )
        return F.when(F.size(done["level"]) == 0, done).otherwise(more)

    first = F.array(F.struct(F.lit("").alias("path"), root.alias("node")))
    levels = F.sequence(F.lit(1), F.length(F.regexp_replace(block, r"[^\[{]", "")) + 1)
    start = F.struct(first.alias("level"), F.array().cast(PRODUCT).alias("found"))
    return F.array_sort(F.aggregate(levels, start, step, lambda done: done["found"]))


def page_offers(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """One row per priced product node: ``keys``, its block and place in it, and the offer.

    A product is an object with a name and a priced offer, at any depth. Places follow array positions and, in objects, the names of the
    fields. Prices that are not positive or not finite do not count. The whole tree of a block is walked in its own row.
    """
    walked = computed_once(
        page_blocks(pages, keys, html).filter("node IS NOT NULL"), [*keys, "block_no"], products=_products(F.col("block"), F.col("node"))
    )
    return walked.select(*keys, "block_no", F.posexplode("products").alias("node_no", "product")).select(
        *keys, "block_no", "node_no", "product.name", "product.price_eur", "product.url", "product.in_stock"
    )
