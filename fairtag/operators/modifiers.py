"""Exclusions and price modifiers: patterns as a table whose blocks come to the texts as one value each.

A pattern can match only where its plain part stands. A few patterns are tried one after the other, that part first. Of many patterns,
one piece of the plain part is the key: the pieces of a text are looked up among the keys, and a pattern runs over a text only if they
met. What a text costs so does not grow with the number of modifiers, and no pattern is part of the plan. Patterns without a plain
part run over every text; those that are their plain part, or a short beginning of words, need no run. No text is shuffled.
"""

from __future__ import annotations

import re
from itertools import batched
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairtag.functions.once import computed_once
from fairtag.session import cut_lineage
from fairtag.sources.catalog import Modifier

#: Lengths of keys: the longest that the plain part of a pattern fills.
KEY_LENGTHS = (4, 3, 2, 1)
#: Patterns that are broadcast at once; a catalog of more takes several passes.
BLOCK = 10_000
#: Up to so many patterns of a catalog are conditions of the plan, compiled once; a plan does not grow beyond them.
DIRECT = 16
#: Up to so many patterns of a block are tried one after the other; cutting a text into pieces costs more.
FEW = 256
PATTERN = "key: string, plain: string, pattern: string, on_title: boolean, pos: int, modifier_id: string, exclude: boolean, price_adjust_pct: double"
HIT = "pos: int, modifier_id: string, exclude: boolean, price_adjust_pct: double"
# Escapes of a letter that stand for one character of a class, or for a place.
CLASSES, PLACES = set("dDwWsShHvVR"), set("bBAzZG")
# A beginning of words that is as short as a key. Marked as such it is longer than any other key.
WORD_START = re.compile(rf"\\b([a-z0-9]{{1,{max(KEY_LENGTHS)}}})")
STARTS = "begins "


def plain_part(pattern: str) -> str:
    """The longest text that everything matched by ``pattern`` holds; empty where that cannot be told.

    Groups and classes only end a run of plain characters. A pattern with alternatives outside of groups, flags, quotations or
    coded characters has no plain part.
    """
    runs, run, at, depth = [], "", 0, 0

    def ended() -> None:
        nonlocal run
        runs.append(run)
        run = ""

    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            escaped = pattern[at + 1:at + 2]
            if escaped.isalnum() and escaped not in CLASSES | PLACES:
                return ""
            at += 2
            if depth:
                continue
            if escaped in CLASSES:
                ended()
            elif escaped not in PLACES:
                run += escaped
            continue
        if c == "[":
            close = pattern.find("]", at + 2)
            inner = pattern[at + 1:close]
            if close < 0 or "[" in inner or "\\" in inner or "&&" in inner:
                return ""
            at = close + 1
            ended()
            continue
        if c == "(":
            if pattern[at + 1:at + 2] == "?" and pattern[at + 2:at + 3] not in (":", "=", "!", "<", ">"):
                return ""
            depth += 1
            ended()
        elif c == ")":
            depth -= 1
        elif depth:
            pass
        elif c == "|":
            return ""
        elif c in "*?{":
            run = run[:-1]
            ended()
            if c == "{":
                at = pattern.find("}", at)
                if at < 0:
                    return ""
        elif c in "+.":
            ended()
        elif c not in "^$":
            run += c
        at += 1
    ended()
    return max(runs, key=len)


def pattern_rows(modifiers: list[Modifier]) -> list[tuple]:
    """One row for each pattern. One anchored pattern confines an exclusion to the title."""
    rows = []
    for pos, m in enumerate(modifiers):
        on_title = m.exclude and any(p.startswith("^") for p in m.patterns)
        for pattern in m.patterns:
            plain = plain_part(pattern)
            size = next((n for n in KEY_LENGTHS if n <= len(plain)), 0)
            start = (len(plain) - size) // 2
            begins = WORD_START.fullmatch(pattern)
            key = STARTS + begins[1] if begins else plain[start:start + size]
            rows.append((key, plain, pattern, on_title, pos, m.modifier_id, m.exclude, float(m.price_adjust_pct)))
    return rows


def _keys_of(text: Column, keys: set[str]) -> Column:
    """The distinct pieces and marked beginnings of words in the text, of the lengths that ``keys`` have; the empty piece is in all."""
    extracted = lambda regex: F.regexp_extract_all(text, F.lit(regex), 1)
    starts = {len(k) - len(STARTS) for k in keys if k.startswith(STARTS)}
    pieces = {len(k) for k in keys if not k.startswith(STARTS)}
    found = [F.array(F.lit(""))] if 0 in pieces else []
    found += [extracted(f"(?s)(?=(.{{{n}}}))") for n in sorted(pieces) if n]
    marked = [extracted(rf"(?s)\b(?=([a-z0-9].{{{n - 1}}}))") for n in sorted(starts)]
    if marked:
        found.append(F.transform(F.array_distinct(F.concat(*marked)), lambda start: F.concat(F.lit(STARTS), start)))
    return F.array_distinct(F.concat(*found))


def _matches(p: Column, target: Column) -> Column:
    return F.contains(target, p["plain"]) & ((p["pattern"] == p["plain"]) | F.rlike(target, p["pattern"]))


def _few(block: list[tuple], title: str, haystack: str) -> tuple[list, str, Column]:
    """The block as one value, its type, and those of its patterns that match."""
    target = lambda p: F.when(p["on_title"], F.col(title)).otherwise(F.col(haystack))
    return block, f"array<struct<{PATTERN}>>", F.filter("_block", lambda p: _matches(p, target(p)))


def _many(block: list[tuple], title: str, haystack: str) -> tuple[list, str, Column]:
    """As ``_few``. The patterns lie in as many lists as there are patterns, by a hash of the key."""
    lists: list[list] = [[] for _ in block]
    for row in block:
        lists[crc32(row[0].encode()) % len(block)].append(row)

    def found(on_title: bool, target: Column) -> Column:
        def met(key: Column) -> Column:
            near = F.get("_block", (F.crc32(key.cast("binary")) % len(block)).cast("int"))
            return F.filter(near, lambda p: (p["key"] == key) & (p["on_title"] == F.lit(on_title)) & (
                F.startswith(key, F.lit(STARTS)) | _matches(p, target)
            ))

        keys = {row[0] for row in block if row[3] == on_title}
        none = F.array().cast(f"array<struct<{PATTERN}>>")
        return F.coalesce(F.flatten(F.transform(_keys_of(target, keys), met)), none) if keys else none

    return lists, f"array<array<struct<{PATTERN}>>>", F.concat(found(False, F.col(haystack)), found(True, F.col(title)))


def with_hits(texts: DataFrame, title: str, haystack: str, modifiers: list[Modifier]) -> DataFrame:
    """Adds ``hits``: the modifiers found in each row, in catalog order. Texts that are null hold nothing.

    The texts stay where they are: the patterns come to them, ``BLOCK`` at a time.
    """
    none = F.array().cast(f"array<struct<{HIT}>>")
    texts = texts.withColumn("hits", none)
    for block in map(list, batched(pattern_rows(modifiers), BLOCK)):
        value, kind, matching = (_few if len(block) <= FEW else _many)(block, title, haystack)
        table = F.broadcast(texts.sparkSession.createDataFrame([(value,)], f"_block {kind}"))  # at most BLOCK patterns
        hit = lambda p: F.struct(*[p[name] for name in ("pos", "modifier_id", "exclude", "price_adjust_pct")])
        more = F.coalesce(F.transform(matching, hit), none).cast(f"array<struct<{HIT}>>")
        keep = [c for c in texts.columns if c != "hits"]
        texts = computed_once(texts.crossJoin(table), keep, hits=F.concat("hits", more))
    ordered = computed_once(texts, [c for c in texts.columns if c != "hits"], hits=F.array_sort("hits"))
    first = lambda h, i: (i == 0) | (h["pos"] != F.get("hits", i - 1)["pos"])  # noqa: E731 - a modifier may match by several patterns
    return ordered.withColumn("hits", F.filter("hits", first))


def _with_few_modifiers(texts: DataFrame, title: str, haystack: str, modifiers: list[Modifier], rows: list[tuple]) -> DataFrame:
    """As ``with_modifiers``, a condition for each modifier."""
    def matches(plain: str, pattern: str, on_title: bool) -> Column:
        target = F.col(title if on_title else haystack)
        held = F.contains(target, F.lit(plain))
        return held if pattern == plain else held & F.rlike(target, F.lit(pattern))

    met = {pos: F.lit(False) for pos in range(len(modifiers))}
    for _, plain, pattern, on_title, pos, *_ in rows:
        met[pos] = met[pos] | F.coalesce(matches(plain, pattern, on_title), F.lit(False))
    keep = [c for c in texts.columns if c != haystack]
    told = texts.select(*keep, *[condition.alias(f"_met_{pos}") for pos, condition in met.items()])
    none = F.array().cast("array<string>")
    excluded, found, adjust = F.lit(None).cast("string"), [none], F.lit(0.0)
    for pos, m in reversed(list(enumerate(modifiers))):
        if m.exclude:
            excluded = F.when(F.col(f"_met_{pos}"), F.lit(m.modifier_id)).otherwise(excluded)
    for pos, m in enumerate(modifiers):
        if not m.exclude:
            found.append(F.when(F.col(f"_met_{pos}"), F.array(F.lit(m.modifier_id))).otherwise(none))
            adjust = adjust + F.when(F.col(f"_met_{pos}"), F.lit(float(m.price_adjust_pct))).otherwise(F.lit(0.0))
    return told.select(*keep, excluded.alias("excluded_by"), F.concat(*found).alias("found"), adjust.alias("adjust_pct"))


def with_modifiers(texts: DataFrame, title: str, haystack: str, modifiers: list[Modifier]) -> DataFrame:
    """``texts`` and what is found in them, without the haystack.

    ``excluded_by`` is the first exclusion in catalog order, ``found`` the ids of the price modifiers in catalog order and
    ``adjust_pct`` their sum in that order.
    """
    rows = pattern_rows(modifiers)
    if len(rows) <= DIRECT:
        return cut_lineage(_with_few_modifiers(texts, title, haystack, modifiers, rows))
    met = with_hits(texts, title, haystack, modifiers).drop(haystack)
    excluding, adjusting = F.filter("hits", lambda h: h["exclude"]), F.filter("hits", lambda h: ~h["exclude"])
    # Written once: matching and the result both read it, and normalise no text again.
    return cut_lineage(met.withColumns({
        "excluded_by": F.try_element_at(excluding, F.lit(1))["modifier_id"],
        "found": F.transform(adjusting, lambda h: h["modifier_id"]),
        "adjust_pct": F.aggregate(adjusting, F.lit(0.0), lambda total, h: total + h["price_adjust_pct"]),
    }).drop("hits"))
