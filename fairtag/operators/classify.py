"""Classification of listings onto catalog products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairtag.functions import text
from fairtag.functions.numeric import clamp, round_cents
from fairtag.functions.once import computed_once
from fairtag.functions.ordered import extremes
from fairtag.functions.similarity import rest_ratio, rests
from fairtag.operators.modifiers import with_modifiers
from fairtag.params import Params
from fairtag.session import cut_lineage
from fairtag.sources.catalog import Catalog

USABLE = ("rule", "fuzzy")


def adjusted_cents(price_cents: Column, pct: Column, params: Params = Params()) -> Column:
    limit = params.adjust_limit_pct
    return round_cents(price_cents * (1 + clamp(pct, -limit, limit) / 100))


# Rules: equi-join of title words with one anchor word per rule.


def rule_anchors(products: DataFrame) -> DataFrame:
    """Every matching title holds an anchor: the first word of the first ``all`` needle,
    or of one of the ``any_of`` needles where ``all`` is empty."""
    needles = F.when(F.size("all") > 0, F.slice("all", 1, 1)).otherwise(F.col("any_of"))
    return products.select(
        "pos", "all", "any_of", "none_of",
        F.explode(
            F.array_distinct(F.transform(needles, lambda n: F.split(n, " ")[0]))
        ).alias("anchor"),
    ).filter("anchor <> ''")


def open_titles(titles: DataFrame) -> DataFrame:
    """The distinct normalised titles that are neither excluded nor blank."""
    return titles.filter("excluded_by IS NULL AND normalized_title <> ''").select("normalized_title").distinct()


def rule_matches(names: DataFrame, products: DataFrame) -> DataFrame:
    """``rule_product``, ``rule_pos`` and ``specificity`` of the most specific rule of each distinct ``normalized_title``.

    Only words of titles take part in the join. The winner is one long (specificity
    high, catalog order low), which keeps the aggregation in the hash path.
    """
    rank = F.shiftleft((10 * F.size("all") + F.size("any_of")).cast("bigint"), 32) - F.col("pos")
    holds = text.rule_holds(
        text.padded(F.col("normalized_title")), F.col("all"), F.col("any_of"), F.col("none_of")
    )
    best = (
        names.withColumn("word", F.explode(text.tokens(F.col("normalized_title")))).filter("word <> ''")
        .join(rule_anchors(products), F.col("word") == F.col("anchor"))
        .filter(holds)
        .groupBy("normalized_title")
        .agg(F.max(rank).alias("rank"))
    )
    specificity = F.shiftright(F.col("rank") + F.lit(2**31), 32)
    won = best.select(
        "normalized_title",
        specificity.alias("specificity"),
        (F.shiftleft(specificity, 32) - F.col("rank")).cast("int").alias("rule_pos"),
    )
    rules = products.select(F.col("pos").alias("rule_pos"), F.col("product_id").alias("rule_product"))
    return won.join(rules, "rule_pos")


def best_rule(titles: DataFrame, products: DataFrame) -> DataFrame:
    """Adds ``rule_product``, ``rule_pos`` and ``specificity`` of the most specific matching rule, null if none,
    and ``open``: neither excluded nor matched nor blank, so due for the fuzzy pass.

    Each distinct title is matched once, however many listings have it.
    """
    found = rule_matches(open_titles(titles), products)
    due = F.col("excluded_by").isNull() & (F.col("normalized_title") != "")
    return (
        titles.join(found, "normalized_title", "left")
        .withColumns({c: F.when(due, F.col(c)) for c in ("rule_product", "rule_pos", "specificity")})
        .withColumn("open", due & F.col("rule_pos").isNull())
    )


# Fuzzy fallback: lossless blocking, then exact scoring of the candidate pairs.


def _signature(counted: Column, cutoff: int) -> Column:
    """The rarest words, until the rest is too short for a partial overlap without any of them.

    ``counted`` holds structs of how often the other side has a word, and the word. If the shared words are all of one
    side, or nearly all of it by length (similarity to that side at or above the cutoff), the words missing from that side
    measure at most 2*(100-cutoff)/(200-cutoff) of it. Any order will do; rare words meet least of the other side.
    """
    room = 2.0 * (100 - cutoff) / (200 - cutoff)
    width = F.aggregate(counted, F.lit(-1), lambda n, w: n + F.length(w["word"]) + 1)
    taken = F.aggregate(
        F.array_sort(counted),
        F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("width"), (room * width + 1e-9).alias("budget")),
        lambda acc, w: F.when(acc["width"] > acc["budget"], acc).otherwise(
            F.struct(F.concat(acc["kept"], F.array(w["word"])).alias("kept"),
                     (acc["width"] + F.length(w["word"]) + 1).alias("width"), acc["budget"].alias("budget"))
        ),
    )
    return taken["kept"]


def _with_signature(table: DataFrame, key: str, words: str, other: DataFrame, cutoff: int) -> DataFrame:
    """Adds ``signature``: the rarest of ``words``, by the number of rows of ``other`` (word) that hold them."""
    frequency = other.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counted = (
        table.select(key, F.explode(words).alias("word")).join(frequency, "word", "left")
        .groupBy(key).agg(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("_counted"))
    )
    return table.join(counted.select(key, _signature(F.col("_counted"), cutoff).alias("signature")), key)


def _mates(length: Column, cutoff: int) -> tuple[Column, Column]:
    """Shortest and longest string that can reach the cutoff against one of this length."""
    return (
        F.ceil(length * (cutoff / (200.0 - cutoff)) - 1e-9).cast("int"),
        F.floor(length * ((200.0 - cutoff) / cutoff) + 1e-9).cast("int"),
    )


def _cut(word: Column, count: Column) -> Column:
    """``count`` pieces of the word, as even as can be."""
    length = F.length(word)
    at = lambda i: F.floor(i * length / count).cast("int")
    return F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(word, at(i - 1) + 1, at(i) - at(i - 1)))


def _pieces(words: Column, edits: Column) -> Column:
    """More pieces of the words than there are ``edits``, the longest such ones; all letters if there are no more.

    An insertion or deletion breaks one piece at most, so one survives inside a word of any match. Pieces do not span words:
    where a word is shared it survives whole, whatever stands beside it.
    """
    def number(size: Column) -> Column:
        return F.aggregate(words, F.lit(0), lambda n, w: n + F.floor(F.length(w) / size).cast("int"))

    sizes = F.sequence(F.array_max(F.transform(words, lambda w: F.length(w))), F.lit(1), F.lit(-1))
    # The first size that gives enough pieces; a word shorter than that gives none.
    size = F.coalesce(F.element_at(F.filter(sizes, lambda x: number(x) > edits), 1), F.lit(1))
    cut = lambda k: F.flatten(F.transform(
        F.filter(words, lambda w: F.length(w) >= k), lambda w: _cut(w, F.floor(F.length(w) / k).cast("int"))
    ))
    return F.flatten(F.transform(F.array(size), cut))


def _key(kind: str, *parts: Column) -> Column:
    return F.concat_ws("|", F.lit(kind), *[p.cast("string") for p in parts])


def _met(side: str, kind: str, word: Column, others: Column | None = None) -> Column:
    """A key, and what else of its kind the row has before it: a pair is taken at the first key that it shares."""
    before = F.array().cast("array<string>") if others is None else others
    return F.struct(_key(kind, word).alias("key"), before.alias(f"{side}_before"))


def alias_keys(aliases: DataFrame, cutoff: int) -> DataFrame:
    """Blocking keys of each alias (with its ``signature``), see ``fuzzy_candidates``."""
    words, width = F.col("alias_words"), F.length("alias_sorted")
    shortest, longest = _mates(width, cutoff)
    sizes = F.sequence(F.greatest(shortest, F.lit(1)), longest)

    def pieces(size: Column) -> Column:
        edits = F.floor((width + size) * ((100 - cutoff) / 100.0) + 1e-9).cast("int")
        found = F.array_distinct(_pieces(words, edits))
        return F.transform(found, lambda p, i: _met("alias", "piece", F.concat_ws("|", p, size.cast("string")), F.slice(found, 1, i)))

    keys = F.concat(
        F.transform("signature", lambda w, i: _met("alias", "whole", w, F.slice(F.col("signature"), 1, i))),
        F.transform(words, lambda w: _met("alias", "part", w)),
        F.flatten(F.transform(sizes, pieces)),
    )
    return aliases.select("alias", "alias_sorted", F.inline(keys))


def title_keys(titles: DataFrame, cutoff: int) -> DataFrame:
    """Blocking keys of each title (with its ``signature``). Needs the columns ``longest_mate`` and ``longest_piece`` of the alias side.

    A title longer than the longest mate of any alias can only contain an alias.
    """
    words, width = F.col("title_words"), F.length("title_sorted")
    similar_length = width <= F.col("longest_mate")
    none = F.array().cast("array<struct<key:string,title_before:array<string>>>")

    def inside(w: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.transform(
            F.sequence(F.lit(1), F.least(F.col("longest_piece"), F.length(w) - i + 1)), lambda n: F.substring(w, i, n)
        )))

    parts = F.transform("signature", lambda w, i: _met("title", "part", w, F.slice(F.col("signature"), 1, i)))
    pieces = F.transform(F.array_distinct(F.flatten(F.transform(words, inside))), lambda p: _met("title", "piece", F.concat_ws("|", p, width.cast("string"))))
    keys = F.concat(
        F.transform(words, lambda w: _met("title", "whole", w)),
        F.when(similar_length, parts).otherwise(none), F.when(similar_length, pieces).otherwise(none),
    )
    return titles.select("normalized_title", "title_sorted", F.inline(keys))


def _words_of(normalized: Column) -> Column:
    return F.array_sort(text.tokens(normalized))


def alias_table(products: DataFrame) -> DataFrame:
    """Distinct alias texts: first position, last product, in catalog order."""
    listed = products.select("pos", "product_id", "none_of", F.posexplode("aliases").alias("nth", "alias"))
    where = F.struct("pos", "nth")
    return (
        listed.groupBy("alias")
        .agg(
            F.min(where).alias("first"),
            F.max(F.struct("pos", "nth", "product_id", "none_of")).alias("owner"),
        )
        .select(
            "alias",
            (F.shiftleft(F.col("first.pos").cast("bigint"), 20) + F.col("first.nth")).alias("alias_pos"),
            F.col("owner.product_id").alias("product_id"),
            F.col("owner.none_of").alias("none_of"),
            _words_of(F.col("alias")).alias("alias_words"),
        )
        .withColumn("alias_sorted", F.array_join("alias_words", " "))
        .filter("size(alias_words) > 0")
    )


def title_table(titles: DataFrame) -> DataFrame:
    """Each distinct ``normalized_title`` with its words but the noise."""
    return (
        titles.select("normalized_title").distinct()
        .withColumn("title_words", _words_of(text.denoise(F.col("normalized_title"))))
        .filter("size(title_words) > 0")
        .withColumn("title_sorted", F.array_join("title_words", " "))
    )


def fuzzy_keys(titles: DataFrame, aliases: DataFrame, cutoff: int) -> tuple[DataFrame, DataFrame]:
    """Blocking keys of the titles and of the aliases, a ``salt`` beside each.

    A key that would meet more than one pair in a hundred is split: each title takes one of its salts, an alias all of them.
    """
    words = lambda table, name: table.select(F.explode(name).alias("word"))
    title_words, alias_words = words(titles, "title_words"), words(aliases, "alias_words")
    keyed_aliases = cut_lineage(alias_keys(_with_signature(aliases, "alias", "alias_words", title_words, cutoff), cutoff))
    limits = {
        "longest_mate": aliases.agg(F.max(_mates(F.length("alias_sorted"), cutoff)[1])).scalar(),
        "longest_piece": keyed_aliases.agg(F.max(F.length(F.regexp_extract("key", r"^piece\|(.*)\|", 1)))).scalar(),
    }
    signed = _with_signature(titles, "normalized_title", "title_words", alias_words, cutoff).withColumns(limits)
    # Keys that no alias has go no further.
    sizes = keyed_aliases.groupBy("key").agg(F.count(F.lit(1)).alias("n_aliases"))
    keyed_titles = cut_lineage(title_keys(signed, cutoff).join(sizes, "key"))
    met = keyed_titles.groupBy("key").agg(F.sum("n_aliases").alias("pairs"))
    share = F.col("pairs") / met.agg(F.sum("pairs")).scalar()
    # No more than a hundred keys can hold more than a hundredth each.
    hot = F.broadcast(cut_lineage(met.filter(share > 0.01).select("key", F.ceil(200 * share).cast("int").alias("salts"))))
    salts = F.coalesce("salts", F.lit(1))
    return (
        keyed_titles.join(hot, "key", "left").drop("n_aliases").withColumn("salt", F.pmod(F.hash("normalized_title"), salts)).drop("salts"),
        keyed_aliases.join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts"),
    )


def fuzzy_candidates(titles: DataFrame, aliases: DataFrame, cutoff: int) -> DataFrame:
    """Every (title, alias) pair that can reach the cutoff, by an equi-join on blocking keys.

    * whole: the alias is contained in the title, or the shared words are nearly
      all of the alias. A signature word of the alias is then shared.
    * part: the mirror image, a signature word of the title is shared.
    * piece: both whole strings are similar; one of the alias's pieces occurs in a word of the title,
      whose length is similar.

    A pair is kept at the first key that it shares, so it is met once for each kind at most.
    """
    keyed_titles, keyed_aliases = fuzzy_keys(titles, aliases, cutoff)
    pairs = keyed_titles.join(keyed_aliases, ["key", "salt"])
    padded = lambda words: F.concat(F.lit(" "), words, F.lit(" "))
    earlier = (
        F.when(F.startswith("key", F.lit("piece")), F.exists("alias_before", lambda p: F.contains("title_sorted", p)))
        .when(F.startswith("key", F.lit("whole")), F.exists("alias_before", lambda w: F.contains(padded(F.col("title_sorted")), padded(w))))
        .otherwise(F.exists("title_before", lambda w: F.contains(padded(F.col("alias_sorted")), padded(w))))
    )
    return pairs.filter(~earlier).select("normalized_title", "title_sorted", "alias")


def fuzzy_match(titles: DataFrame, products: DataFrame, params: Params = Params()) -> DataFrame:
    """Best alias per distinct ``normalized_title`` at or above the cutoff, vetoes applied.

    Only titles no rule matched should come in. A vetoed winner leaves the title
    unmatched; the second best is not tried.
    """
    cutoff = params.fuzzy_cutoff
    aliases = cut_lineage(alias_table(products))
    pairs = fuzzy_candidates(cut_lineage(title_table(titles)), aliases, cutoff)
    known = aliases.select("alias", "alias_pos", "alias_words")
    compared = pairs.join(known, "alias").withColumn("title_words", F.split("title_sorted", " "))
    rested = computed_once(compared, ["normalized_title", "alias_pos"], **rests(F.col("title_words"), F.col("alias_words")))
    score = rest_ratio(F.col("n_shared"), F.col("only_left"), F.col("only_right"), cutoff)
    scored = computed_once(rested, ["normalized_title", "alias_pos"], score=score).filter(F.col("score") >= cutoff)
    # Of the aliases that score best, the first in catalog order; numbers only, so both steps are hash aggregates.
    first = (
        scored.groupBy("normalized_title", "score").agg(F.min("alias_pos").alias("alias_pos"))
        .groupBy("normalized_title").agg(F.max("score").alias("score"), F.max_by("alias_pos", "score").alias("alias_pos"))
    )
    owners = aliases.select("alias_pos", "product_id", "none_of")
    return first.join(owners, "alias_pos").filter(
        ~text.has_any(text.padded(F.col("normalized_title")), F.col("none_of"))
    ).select("normalized_title", F.col("product_id").alias("fuzzy_product"), F.col("score").alias("fuzzy_score"))


# The whole classifier.


def read_titles(listings: DataFrame, catalog: Catalog) -> DataFrame:
    """Per listing the normalised title, the exclusion, and the price modifiers found with their sum in percent."""
    keep = ["listing_id", "price_cents"]
    titled = computed_once(
        listings, [*keep, "title", "description"], normalized_title=text.normalize(F.col("title"))
    )
    # The whole text is normalised in one piece, patterns may straddle its parts.
    whole = text.normalize(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.col("description")))
    plain = F.coalesce("description", F.lit("")) == ""
    haystack = F.when(plain, F.col("normalized_title")).otherwise(whole)
    texts = computed_once(titled, [*keep, "normalized_title"], haystack=haystack)
    return with_modifiers(texts, "normalized_title", "haystack", catalog.modifiers)


def match_titles(names: DataFrame, products: DataFrame, params: Params = Params(), fuzzy: bool = True) -> DataFrame:
    """What each of the distinct ``normalized_title`` matches: rule_product, specificity (by rule), fuzzy_score; titles without a match drop out."""
    names = cut_lineage(names.select("normalized_title"))
    matches = rule_matches(names, products).drop("rule_pos").withColumn("fuzzy_score", F.lit(None).cast("double"))
    if not fuzzy:
        return matches
    matches = cut_lineage(matches)
    found = fuzzy_match(names.join(matches, "normalized_title", "left_anti"), products, params)
    return matches.unionByName(found.withColumnRenamed("fuzzy_product", "rule_product"), allowMissingColumns=True)


def changed_products(old: DataFrame, new: DataFrame) -> DataFrame:
    """The products, as they were and as they are, whose place, rule or aliases differ between two catalogs."""
    fields = ["pos", "product_id", "all", "any_of", "none_of", "aliases"]
    both = old.select(*fields, F.lit(1).alias("side")).unionByName(new.select(*fields, F.lit(2).alias("side")))
    content = F.to_json(F.struct(*fields))
    seen = both.groupBy("product_id", F.sha2(content, 256).alias("content")).agg(F.sum("side").alias("sides"))
    return both.withColumn("content", F.sha2(content, 256)).join(seen.filter("sides <> 3"), ["product_id", "content"]).select(*fields)


def touched_titles(names: DataFrame, matches: DataFrame, changed: DataFrame, params: Params = Params()) -> DataFrame:
    """The titles among ``names`` whose match can differ where ``changed`` products do.

    A rule, old or new, matches titles only that hold one of its anchor words. Without a rule, a title can be reached
    by a changed alias only if the blocking of the fuzzy pass brings the two together.
    """
    words = names.select("normalized_title", F.explode(text.tokens(F.col("normalized_title"))).alias("word"))
    anchors = rule_anchors(changed).select(F.col("anchor").alias("word")).distinct()
    by_rule = words.join(anchors, "word", "left_semi").select("normalized_title")
    unruled = names.join(matches.filter("specificity IS NOT NULL"), "normalized_title", "left_anti")
    aliases = cut_lineage(alias_table(changed))
    by_alias = fuzzy_candidates(cut_lineage(title_table(unruled)), aliases, params.fuzzy_cutoff).select("normalized_title")
    return by_rule.unionByName(by_alias).distinct()


def rematch_titles(
    names: DataFrame, matches: DataFrame, old: DataFrame, new: DataFrame, params: Params = Params()
) -> tuple[DataFrame, DataFrame]:
    """(titles matched again, what all ``names`` match under the ``new`` products), given the ``matches`` under the ``old`` ones.

    Equal to ``match_titles(names, new)``; an edit of the catalog costs the titles that it can reach.
    """
    touched = cut_lineage(touched_titles(names, matches, cut_lineage(changed_products(old, new)), params))
    kept = matches.join(touched, "normalized_title", "left_anti")
    return touched, kept.unionByName(match_titles(touched, new, params).select(matches.columns))


def classify(
    listings: DataFrame, catalog: Catalog, params: Params = Params(), fuzzy: bool = True
) -> DataFrame:
    """One classification row per listing; pure function of listing text and catalog."""
    read = read_titles(listings, catalog)
    # Every distinct title is matched once; what is found goes back to the listings in one join.
    matches = match_titles(open_titles(read), catalog.products, params, fuzzy)
    return classified_from(read, matches, catalog, params)


def classified_from(read: DataFrame, matches: DataFrame, catalog: Catalog, params: Params = Params()) -> DataFrame:
    """Classification rows from read titles (``read_titles``) and what their distinct titles match (``match_titles``)."""
    ruled = read.join(matches, "normalized_title", "left")
    kind = (
        F.when(F.col("excluded_by").isNotNull(), "excluded")
        .when(F.col("specificity").isNotNull(), "rule")
        .when(F.col("fuzzy_score").isNotNull(), "fuzzy")
        .otherwise("none")
    )
    usable = F.col("match_kind").isin(*USABLE)
    none = F.array().cast("array<string>")
    return (
        ruled.withColumn("match_kind", kind)
        .withColumn("modifiers", F.when(usable, F.col("found")).otherwise(none))
        .withColumn("adjust_pct", F.when(usable, F.col("adjust_pct")).otherwise(0.0))
        .select(
            "listing_id",
            F.lit(catalog.category).alias("category"),
            F.when(usable, F.col("rule_product")).alias("product_id"),
            "match_kind",
            F.when(F.col("match_kind") == "rule", F.col("specificity").cast("double"))
            .when(F.col("match_kind") == "fuzzy", F.col("fuzzy_score"))
            .otherwise(0.0)
            .alias("match_score"),
            "excluded_by",
            "modifiers",
            "adjust_pct",
            adjusted_cents(F.col("price_cents"), F.col("adjust_pct"), params).alias("adjusted_cents"),
            "normalized_title",
            F.lit(catalog.version).alias("catalog_version"),
        )
    )


def stale(listings: DataFrame, normalized: DataFrame, catalog: Catalog) -> DataFrame:
    """Listings without a result, of another catalog version, or sighted since the last result."""
    known = normalized.select("listing_id", "catalog_version", "updated_at")
    return (
        listings.filter(F.col("category") == catalog.category)
        .join(known, "listing_id", "left")
        .filter(
            F.col("updated_at").isNull()
            | ~F.col("catalog_version").eqNullSafe(F.lit(catalog.version))
            | (F.col("updated_at") < F.col("last_seen"))
        )
        .drop("catalog_version", "updated_at")
    )


def work_list(listings: DataFrame, normalized: DataFrame, catalog: Catalog, force: bool = False) -> DataFrame:
    """The listings of the category to classify: the stale ones, or all with ``force``."""
    return listings.filter(F.col("category") == catalog.category) if force else stale(listings, normalized, catalog)


def replaced(normalized: DataFrame, fresh: DataFrame) -> DataFrame:
    """The result table with the fresh results in the place of the old ones."""
    return normalized.join(fresh.select("listing_id"), "listing_id", "left_anti").unionByName(fresh)


def reclassify(
    listings: DataFrame, normalized: DataFrame, catalog: Catalog, now: Column,
    force: bool = False, params: Params = Params(),
) -> tuple[DataFrame, DataFrame]:
    """(new results only, full table with those replaced)."""
    todo = work_list(listings, normalized, catalog, force)
    fresh = classify(todo, catalog, params).withColumn("updated_at", now)
    # The listings to replace are known before they are classified.
    kept = normalized.join(todo.select("listing_id"), "listing_id", "left_anti")
    return fresh, kept.unionByName(fresh)


def kind_counts(results: DataFrame) -> DataFrame:
    """Results per match kind, kinds that did not occur included."""
    kinds = ("rule", "fuzzy", "none", "excluded")
    counted = results.agg(
        F.map_from_entries(
            F.array(*[F.struct(F.lit(k), F.count_if(F.col("match_kind") == k)) for k in kinds])
        ).alias("n")
    )
    return counted.select(F.explode("n").alias("match_kind", "n"))


def unmatched_titles(results: DataFrame, listings: DataFrame, when: Column) -> DataFrame:
    """Review queue rows of one classification run; every classified listing counts once."""
    group = ["category", "title_hash"]
    missed = results.filter("match_kind = 'none' and normalized_title <> ''").select(
        "listing_id", "category", text.title_hash(F.col("normalized_title")).alias("title_hash")
    )
    counts = missed.groupBy(*group).agg(F.count(F.lit(1)).alias("occurrences"))
    # One candidate of each title leaves a partition; the sample is the title of the first listing.
    first = F.row_number().over(Window.partitionBy(*group).orderBy("listing_id"))
    samples = missed.withColumn("_nth", first).filter("_nth = 1").join(listings.select("listing_id", "title"), "listing_id")
    return (
        samples.select(*group, F.left("title", F.lit(300)).alias("sample_title")).join(counts, group)
        .withColumn("first_seen", when)
        .withColumn("last_seen", when)
        .withColumn("resolved", F.lit(False))
        .select(*group, "sample_title", "occurrences", "first_seen", "last_seen", "resolved")
    )


def merge_unmatched(queue: DataFrame, new: DataFrame) -> DataFrame:
    """Older sample titles stay, occurrences add up, a dismissed title stays dismissed."""
    group = ["category", "title_hash"]
    oldest = ("min", F.coalesce(F.unix_micros("first_seen"), F.lit(-(2**62))), F.struct("sample_title"))
    merged = extremes(
        queue.unionByName(new), group, {"oldest": oldest}, occurrences=F.sum("occurrences"), first_seen=F.min("first_seen"),
        last_seen=F.max("last_seen"), resolved=F.max("resolved"),
    )
    return merged.select(*group, "oldest.sample_title", "occurrences", "first_seen", "last_seen", "resolved")


def dismiss(queue: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Mark (category, title_hash) pairs as resolved."""
    marks = dismissed.select("category", "title_hash").distinct().withColumn("_mark", F.lit(True))
    return (
        queue.join(marks, ["category", "title_hash"], "left")
        .withColumn("resolved", F.col("resolved") | F.coalesce("_mark", F.lit(False)))
        .drop("_mark")
    )
