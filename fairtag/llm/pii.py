"""Personal data by bootstrapped contextual extraction.

Known forms (mail addresses, network addresses, card and phone numbers) are found by their patterns and are the seeds. The words
around seeds are lexical patterns, and so are those around every other token that looks like an identifier. Patterns and instances
make a graph of distinct edges, which Spark scores in rounds: a pattern is as sure as the lower confidence bound of the share of its
instances that are of one kind, an unseen instance as its best pattern. Instances that become sure enough are found wherever they
stand. Copies of a text add no edge, and what failed a known form's test is evidence against a pattern.

Texts are read once, in place; only identifiers and the words beside them are shuffled, with hot patterns and instances salted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fairtag.llm.tables import small_batches, written

# The kinds in order, then those that contexts discover.
KINDS = ("email", "ip", "card", "phone")
FOUND = tuple(f"like_{kind}" for kind in KINDS)
# The forms. Phones, addresses and cards start where no earlier start could match, so every text is scanned in linear time.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# A word with a digit or an at sign, and the groups of digits that follow it after one space each.
TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+(?:\x20[().-]*+[0-9][0-9().-]*+(?![^\x20\x09-\x0D]))*+")
TRIM = "\"'`()[]{}<>,;:!?*&%$#|.=-_/\\"
NEGATIVE, UNSEEN = len(KINDS), len(KINDS) + 1
SPANS = "array<struct<start:int,kind:int,end:int,hit:string>>"
SCANNED = "doc_id long, base array<struct<start:int,kind:int,end:int,hit:string>>, seen array<struct<start:int,label:int,end:int,instance:string,patterns:array<string>>>"


@dataclass(frozen=True)
class Bootstrap:
    reach: int = 80  # code points on either side in which context words are looked for
    word: int = 32  # longest context word
    instance: int = 64  # longest identifier that a context can discover; known forms have no bound
    z: float = 1.96  # of the lower bound
    pattern: float = 0.5  # least score of a pattern that says anything
    accept: float = 0.8  # least score of a discovered instance
    rounds: int = 4
    salts: int = 16


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def known_forms(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the matches of each form that hold, and of those that fail its test."""
    good, bad = [], []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            good.append((start, 0, last))
        at = text.find("@", at + 1)
    for m in IP.finditer(text):
        parts = m[0].split(".")
        (good if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in parts) else bad).append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        (good if 12 <= len(digits) <= 19 and _luhn(digits) else bad).append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        (good if 9 <= sum(c.isdigit() for c in m[0]) <= 15 else bad).append((m.start(), 3, m.end()))
    return sorted(good), bad


def contexts(text: str, start: int, end: int, spec: Bootstrap) -> list[str]:
    """Lexical patterns of a span: the word before it, the two before it, and the words on both sides."""
    left = text[max(0, start - spec.reach):start].lower().split()[-2:]
    right = text[end:end + spec.reach].lower().split()[:1]
    if any(len(w) > spec.word for w in (*left, *right)) or not left:
        return []
    patterns = [f"{left[-1]} _"]
    if len(left) == 2:
        patterns.append(f"{left[0]} {left[1]} _")
    if right:
        patterns.append(f"{left[-1]} _ {right[0]}")
    return patterns


def apart(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ``spans`` that meet none of ``taken``."""
    taken, out, at, reached = sorted(taken), [], 0, 0
    for start, end in sorted(spans):
        while at < len(taken) and taken[at][0] < end:
            reached = max(reached, taken[at][1])
            at += 1
        if reached <= start:
            out.append((start, end))
    return out


def unseen(text: str) -> Iterator[tuple[int, int]]:
    """Spans of tokens that look like identifiers: what follows the last '=' of a token, without the marks around it."""
    for m in TOKEN.finditer(text):
        start = m.start() + m[0].rstrip(TRIM).rfind("=") + 1
        value = text[start:m.end()]
        bare = value.strip(TRIM)
        if len(bare) > 2:
            start += value.index(bare)
            yield start, start + len(bare)


def _scan(text: str, spec: Bootstrap) -> tuple[list[dict], list[dict]]:
    good, bad = known_forms(text)
    known, failed = [(a, b) for a, _, b in good], [(a, b) for a, _, b in bad]
    labelled = [(a, k, b) for a, k, b in good]
    labelled += [(a, NEGATIVE, b) for a, b in apart(failed, known)]
    labelled += [(a, UNSEEN, b) for a, b in apart(list(unseen(text)), known + failed)]
    base = [{"start": a, "kind": k, "end": b, "hit": text[a:b]} for a, k, b in good]
    seen = [
        {"start": a, "label": k, "end": b, "instance": text[a:b].lower(), "patterns": contexts(text, a, b, spec)}
        for a, k, b in labelled if b - a <= spec.instance
    ]
    return base, seen


def scanned(documents: DataFrame, spec: Bootstrap = Bootstrap()) -> DataFrame:
    """doc_id, base spans and identifiers with their patterns of every whole text, and a number for the row."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_scan(t, spec) if t else ([], []) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([f[0] for f in found], _SPAN_TYPE), pa.array([f[1] for f in found], _SEEN_TYPE),
            ], ["doc_id", "base", "seen"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(run, SCANNED).withColumn("row", F.monotonically_increasing_id()))


_INT, _STR = pa.int32(), pa.string()
_SPAN_TYPE = pa.list_(pa.struct([("start", _INT), ("kind", _INT), ("end", _INT), ("hit", _STR)]))
_SEEN_TYPE = pa.list_(pa.struct([("start", _INT), ("label", _INT), ("end", _INT), ("instance", _STR), ("patterns", pa.list_(_STR))]))


def graph(rows: DataFrame) -> DataFrame:
    """Distinct (pattern, instance) with the instance's label there; a known form outweighs what else it is read as."""
    seen = rows.select(F.explode("seen").alias("s")).select("s.instance", "s.label", F.explode("s.patterns").alias("pattern"))
    return seen.groupBy("pattern", "instance").agg(F.min("label").alias("label"))


def _lower_bound(mean: Column, n: Column, z: float) -> Column:
    spread = z * F.sqrt(F.greatest(mean * (1 - mean), F.lit(0.0)) / n + z * z / (4 * n * n))
    return (mean + z * z / (2 * n) - spread) / (1 + z * z / n)


def discovered(edges: DataFrame, spec: Bootstrap = Bootstrap()) -> DataFrame:
    """(instance, kind, score) of the unseen instances that are sure enough after the rounds.

    A pattern's share counts a seed of the kind as 1, an unseen instance as its score of the round before, all else as 0. A score
    is for the best kind, the first listed where that ties.
    """
    edges = written(edges)
    scores = None
    salt = lambda c: F.pmod(F.hash(c), F.lit(spec.salts)).alias("salt")
    salts = F.explode(F.sequence(F.lit(0), F.lit(spec.salts - 1))).alias("salt")
    for _ in range(spec.rounds):
        weighed = edges.withColumns({"about": F.lit(None).cast("int"), "score": F.lit(0.0)})
        if scores is not None:
            weighed = edges.withColumn("salt", salt("pattern")).join(
                scores.select("instance", F.col("kind").alias("about"), "score", salts), ["instance", "salt"], "left"
            )
        share = lambda k: F.sum(
            F.when(F.col("label") == k, 1.0).when((F.col("label") == UNSEEN) & (F.col("about") == k), F.col("score")).otherwise(0.0)
        )
        sums = weighed.groupBy("pattern").agg(F.count("*").alias("n"), *[share(k).alias(f"k{k}") for k in range(len(KINDS))])
        best = F.greatest(*[F.col(f"k{k}") for k in range(len(KINDS))])
        kind = F.coalesce(*[F.when(F.col(f"k{k}") == best, F.lit(k)) for k in range(len(KINDS))])
        sure = sums.select("pattern", kind.alias("kind"), _lower_bound(best / F.col("n"), F.col("n"), spec.z).alias("score")).where(
            F.col("score") >= spec.pattern
        )
        led = edges.where(F.col("label") == UNSEEN).withColumn("salt", salt("instance")).join(
            sure.select("pattern", "kind", "score", salts), ["pattern", "salt"]
        )
        by_kind = led.groupBy("instance").agg(*[F.max(F.when(F.col("kind") == k, F.col("score"))).alias(f"s{k}") for k in range(len(KINDS))])
        top = F.greatest(*[F.coalesce(F.col(f"s{k}"), F.lit(0.0)) for k in range(len(KINDS))])
        scores = written(by_kind.select(
            "instance", F.coalesce(*[F.when(F.col(f"s{k}") == top, F.lit(k)) for k in range(len(KINDS))]).alias("kind"), top.alias("score")
        ))
    return scores.where(F.col("score") >= spec.accept)


def find_private(documents: DataFrame, spec: Bootstrap = Bootstrap()) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_email, n_ip, n_card, n_phone, n_context, base_spans, all_spans.

    Spans are arrays of (start, kind, end, hit), in code points with the end exclusive, by start and kind; the kinds that contexts
    discover are numbered after the known ones (``FOUND``). A null or empty text has none. Repeated rows are scanned each; other
    columns are not looked at.
    """
    rows = scanned(documents, spec)
    found = discovered(graph(rows), spec)
    salt = F.pmod("row", F.lit(spec.salts)).alias("salt")
    unseen = rows.select("row", salt, F.explode(F.filter("seen", lambda s: s["label"] == UNSEEN)).alias("s")).select(
        "row", "salt", F.col("s.instance").alias("instance"), "s.start", "s.end"
    )
    accepted = found.select("instance", "kind", F.explode(F.sequence(F.lit(0), F.lit(spec.salts - 1))).alias("salt"))
    more = unseen.join(accepted, ["instance", "salt"]).groupBy("row").agg(F.collect_set(F.struct(
        F.col("start"), (F.col("kind") + len(KINDS)).alias("kind"), F.col("end"), F.col("instance").alias("hit")
    )).cast(SPANS).alias("more"))
    none = F.array().cast(SPANS)
    counted = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.join(more, "row", "left").select(
        "doc_id", *[counted(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.size(F.coalesce("more", none)).cast("long").alias("n_context"), F.array_sort("base").alias("base_spans"),
        F.array_sort(F.concat("base", F.coalesce("more", none))).alias("all_spans"),
    )


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, *FOUND)])
    return F.concat_ws(",", F.transform(
        spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    ))


def span_digests(found: DataFrame) -> DataFrame:
    """The spans as text and the digest of the known forms' spans."""
    return found.select(
        "doc_id", *[f"n_{kind}" for kind in KINDS], F.sha2(_joined("base_spans"), 256).alias("base_sha256"), _joined("all_spans").alias("spans"),
        "n_context",
    )
