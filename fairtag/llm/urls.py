"""URL filters: rules by host and path, and a classifier over segmented host and path words.

Hosts join words without a gap. A unigram model, counted over the words in the visible text of all pages, splits each distinct token
of hosts and paths into its most probable words (Viterbi). A multinomial naive Bayes model scores the words; it learns from listed
words and from the pages that the rules judge. Counts, splits and odds are tables that Spark joins; no vocabulary is sent anywhere.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fairtag.llm.tables import written

# Words that tell unwanted sites, and words of ordinary ones. They are the labelled text of the classifier.
BLOCK_WORDS = (
    "adult bet bets betting bitcoin bonus cam cams casino cheap click crack cracked dating deal deals drug drugs escort fake free "
    "gamble gambling hack hot jackpot keygen loan loans lottery lucky money nude penis pharma pharmacy pill pills poker porn prize "
    "promo replica sex sexy slot slots spam torrent viagra warez weight win winner xxx"
).split()
ALLOW_WORDS = (
    "about academy article articles archive art blog book books business city code college community company contact culture data "
    "design dev docs education engineering events faq family food forum garden guide health help history home house index info "
    "journal kids language learn library life local map math media museum music nature network news office online open page paper "
    "people photo post press project public recipe recipes research review school science service shop society sport story study "
    "support team tech travel university video water weather web wiki work world write"
).split()
# Fixed values: (verdict, host, path prefix); the longest that fits decides.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
# Labels of hosts that say nothing about the site.
PLAIN_LABELS = "www m blog com org net edu gov example html htm php".split()


@dataclass(frozen=True)
class UrlModel:
    rules: tuple[tuple[str, str, str], ...] = RULES
    longest: int = 24  # letters of a word, known or unknown
    seed_share: float = 5e-5  # of running text, that each listed word holds besides what is counted
    letter: float = 3.0  # nats that a letter of an unknown word costs
    heavy: float = 0.001  # share of all rows, from which a join key is broadcast
    seed_sites: float = 10.0  # labelled hosts that a listed word counts as, at least
    seed_hosts: float = 0.01  # share of all labelled words that a listed word counts as, at least
    mixed: float = 0.25  # of that, for ordinary words in names of unwanted sites
    block_prior: float = 0.3
    smoothing: float = 1.0  # so that a word of one labelled host does not outweigh the prior


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    there = F.instr(url, "://") > 0
    after = F.substr(url, F.instr(url, "://") + 3)
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    empty = lambda c: F.when(there, c).otherwise(F.lit(""))
    return empty(host), empty(path)


def rule_columns(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The rule (host and path prefix) that fits, and its verdict; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # From the shortest rule to the longest, so the longest that fits is the outermost.
    for kind, rule_host, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        name = F.when(fits, F.lit(rule_host + prefix)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z]+"), lambda t: (F.length(t) > 0) & ~t.isin(PLAIN_LABELS))


class Segmenter:
    """Splits a token into words: the split of greatest probability under the unigram model.

    ``counts`` are those of words in running text, ``total`` of all of them. A word costs the negative logarithm of its share; the
    listed words hold a share of ``seed_share`` each besides. Other letters make unknown words beside the known ones, each at the cost
    of a word seen once and ``letter`` nats a letter. No word, known or not, is over ``longest`` letters; a longer one makes several.
    """

    def __init__(self, counts: dict[str, int], spec: UrlModel, total: int | None = None):
        self.spec = spec
        total = (sum(counts.values()) if total is None else total) + 1
        seeds = {*BLOCK_WORDS, *ALLOW_WORDS}
        self.cost = {w: -math.log(counts.get(w, 0) / total + (spec.seed_share if w in seeds else 0)) for w in (*counts, *seeds)}
        self.unknown = max(math.log(total), -math.log(spec.seed_share))

    def split(self, token: str) -> list[str]:
        best = [(0.0, 0)]  # least cost of the letters up to each place, and where its last word starts
        for end in range(1, len(token) + 1):
            best.append(min(
                (best[start][0] + self.cost.get(token[start:end], self.unknown + self.spec.letter * (end - start)), start)
                for start in range(max(0, end - self.spec.longest), end)
            ))
        words, end = [], len(token)
        while end:
            words.append(token[best[end][1]:end])
            end = best[end][1]
        return words[::-1]


def joined(rows: DataFrame, table: DataFrame, key: str, spec: UrlModel) -> DataFrame:
    """``rows`` left joined with ``table``, which holds each ``key`` once.

    Keys that hold over ``heavy`` of all rows are fewer than 1 / heavy, whatever the input: their part of the table is broadcast.
    The others are joined by a shuffle, in which none of them is a hot one.
    """
    counted = rows.groupBy(key).count()
    least = max(2.0, spec.heavy * (counted.agg(F.sum("count")).first()[0] or 0))
    heavy = F.broadcast(written(counted.where(F.col("count") >= least).select(key)))  # fewer than 1 / heavy rows
    common = table.join(heavy, key, "left_semi")
    return rows.join(heavy, key, "left_semi").join(F.broadcast(common), key, "left").unionByName(
        rows.join(heavy, key, "left_anti").join(table, key, "left")
    )


def word_counts(pages: DataFrame, spec: UrlModel = UrlModel()) -> DataFrame:
    """(piece, n): how often each word of a-z stands in the visible text of all pages. Joined names are in links, which do not count."""
    hidden = r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&#?\w+;|\S+[./@:_]\S+"
    words = F.split(F.lower(F.regexp_replace(F.col("html").cast("string"), hidden, " ")), r"[^\p{L}']+")
    return (
        pages.select(F.explode(words).alias("piece")).where(F.col("piece").rlike(f"^[a-z]{{1,{spec.longest}}}$"))
        .groupBy("piece").agg(F.count("*").alias("n"))
    )


def split_tokens(tokens: DataFrame, counts: DataFrame, spec: UrlModel = UrlModel()) -> DataFrame:
    """(token, words) of the distinct ``token``: its substrings meet the counts in a join, and Viterbi runs over those found."""
    total = int(counts.agg(F.sum("n")).first()[0] or 0)
    ends = F.sequence(F.lit(1), F.least(F.lit(spec.longest), F.length("token")))
    pieces = F.flatten(F.transform(ends, lambda n: F.transform(
        F.sequence(F.lit(1), F.length("token") - n + 1), lambda at: F.substring("token", at, n))))
    found = joined(tokens.select("token", F.explode(F.array_distinct(pieces)).alias("piece")), counts, "piece", spec)
    known = found.where("n is not null").groupBy("token").agg(F.collect_list("piece").alias("pieces"), F.collect_list("n").alias("ns"))

    @F.pandas_udf("array<string>")
    def words(token: pd.Series, pieces: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([
            Segmenter({} if p is None else dict(zip(p, (int(c) for c in n))), spec, total).split(t)
            for t, p, n in zip(token, pieces, ns)
        ], dtype=object)

    return tokens.join(known, "token", "left").select("token", words("token", "pieces", "ns").alias("words"))


def word_odds(sites: DataFrame, spec: UrlModel = UrlModel()) -> DataFrame:
    """(word, odds): log odds of ``block`` of the multinomial naive Bayes model, from labelled (host, label, word).

    A word counts once for each host and label, so a host of very many pages weighs as much as one of few. A listed word counts as
    ``seed_sites`` hosts of its label, or as the share ``seed_hosts`` of all labelled words where that is more; ordinary words are in
    unwanted names too, at the share ``mixed`` of that.
    """
    marks = lambda label: F.sum(F.when(F.col("label") == label, 1.0).otherwise(0.0))
    seen = written(sites.distinct().groupBy("word").agg(marks("block").alias("block"), marks("allow").alias("allow")))
    sums = seen.agg(F.sum("block"), F.sum("allow")).first()
    seed = [max(spec.seed_sites, spec.seed_hosts * (n or 0.0)) for n in sums]
    lists = [(w, seed[0], 0.0) for w in BLOCK_WORDS] + [(w, spec.mixed * seed[0], seed[1]) for w in ALLOW_WORDS]
    counts = written(
        seen.unionByName(sites.sparkSession.createDataFrame(lists, "word string, block double, allow double"))
        .groupBy("word").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    )
    size, block, allow = counts.agg(F.count("*"), F.sum("block"), F.sum("allow")).first()
    share = lambda c, n: (F.col(c) + spec.smoothing) / (n + spec.smoothing * (size + 1))
    return counts.select("word", F.log(share("block", block) / share("allow", allow)).alias("odds"))


def judge(pages: DataFrame, spec: UrlModel = UrlModel()) -> DataFrame:
    """page_id, host, path, rule, verdict, words, log_odds of every page's url.

    The rule's verdict holds where a rule fits; else the classifier's, which learns from the listed words and from the pages that
    rules judge (without the part of the url that the rule itself names). A null url, or one without ``://``, has an empty host and
    path, no rule and no words, and is allowed by the prior. A null html counts no words. Repeated rows are judged each. Other
    columns are not looked at.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select(
        "page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path")
    )
    name, verdict = rule_columns(F.col("host"), F.col("path"), spec.rules)
    ruled = urls.withColumns({"rule": name, "label": verdict})
    # What the rule does not name: labels before its host, and what follows its path.
    rule_host = F.substring_index("rule", "/", 1)
    rest = F.concat(
        F.expr("left(host, length(host) - length(substring_index(rule, '/', 1)))"), F.lit("/"),
        F.expr("substr(path, length(rule) - length(substring_index(rule, '/', 1)) + 1)"),
    )
    rows = written(ruled.select(
        "*", _tokens(F.concat("host", F.lit("/"), "path")).alias("tokens"),
        F.when(rule_host.isNotNull(), _tokens(rest)).alias("rest"), F.monotonically_increasing_id().alias("row"),
    ))
    tokens = rows.select(F.explode(F.concat("tokens", F.coalesce("rest", F.array()))).alias("token")).distinct()
    split = written(split_tokens(tokens, written(word_counts(pages, spec)), spec))

    sites = joined(rows.where("label is not null").select("host", "label", F.explode("rest").alias("token")).distinct(), split, "token", spec)
    odds = word_odds(sites.select("host", "label", F.explode("words").alias("word")), spec)
    each = joined(split.select("token", F.explode("words").alias("word")), odds, "word", spec)
    scored = written(
        split.join(each.groupBy("token").agg(F.sum("odds").alias("odds")), "token", "left")
    )
    placed = rows.select("row", F.posexplode("tokens").alias("at", "token"))
    found = joined(placed, scored, "token", spec).groupBy("row").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda s: s["words"])).alias("words"),
        F.sum("odds").alias("odds"),
    )
    margin = math.log(spec.block_prior / (1 - spec.block_prior)) + F.coalesce("odds", F.lit(0.0))
    judged = rows.join(found, "row", "left").withColumn("log_odds", margin)
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("label", F.when(F.col("log_odds") > 0, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("words", F.array().cast("array<string>")).alias("words"), "log_odds",
    )
