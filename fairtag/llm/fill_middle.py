"""Fill-in-middle by content-defined chunk memoization.

A rolling hash over a few bytes cuts a text into chunks, so the same passage is cut alike wherever it stands. What a chunk adds to a
document's count of units is its boundary summary: its words, whether a word touches either end, and its code points. A summary is
worked out once for a chunk's content and kept by that content, byte for byte, so a chunk met again is verified and not read again.
Summaries combine associatively; their running counts say how many units a document has and which chunk a cut falls into, and only
that chunk is looked into.

The cache is each task's own and of bounded size: a shared one would need a join that moves more bytes than it spares. No row is
shuffled and no text leaves its row; form, order of parts and digests are SQL expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fairtag.functions.once import computed_once
from fairtag.llm.tables import small_batches
from fairtag.llm.words import mix, powers, text_slices

# The sentinels of prefix, suffix and middle, and the salt of the draws.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SALT = "42:"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SPACES = b" \t\n\r\x0b\x0c"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_BYTES = np.random.default_rng(20240311).integers(1, 2**63, 256, dtype=np.uint64)


@dataclass(frozen=True)
class Chunking:
    rate: int = 50  # percent of documents that are transformed
    spm_rate: int = 80  # percent of those whose suffix comes first
    window: int = 32  # bytes that decide a cut
    mean: int = 1024  # bytes between possible cuts, a power of 2
    least: int = 256  # bytes of a chunk, except the last of a text
    most: int = 8192
    block: int = 1 << 20  # bytes hashed at a time
    cache: int = 32 << 20  # bytes of chunks that a task remembers; older ones are summarised again


def possible_cuts(data: np.ndarray, spec: Chunking) -> np.ndarray:
    """Positions whose ``window`` bytes before them hash to a cut, and that begin a code point."""
    found, w = [np.zeros(0, np.int64)], spec.window
    for lo in range(0, len(data), spec.block):
        part = data[max(lo - w, 0):lo + spec.block]
        n = len(part)
        if n <= w:
            continue
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[part] * powers(_BASE, n)[:n], out=sums[1:])
        hashes = mix((sums[w:n] - sums[:n - w]) * powers(_INVERSE, n)[:n - w])
        cut = (hashes & np.uint64(spec.mean - 1) == 0) & (part[w:] & 0xC0 != 0x80)
        found.append(np.flatnonzero(cut) + w + max(lo - w, 0))
    return np.concatenate(found)


def chunks(data: np.ndarray, lo: int, hi: int, cuts: np.ndarray, spec: Chunking) -> Iterator[tuple[int, int]]:
    """Bounds of the chunks of the text ``data[lo:hi]``."""
    while lo < hi:
        at = np.searchsorted(cuts, lo + spec.least)
        end = min(int(cuts[at]) if at < len(cuts) else hi, lo + spec.most, hi)
        while end < hi and data[end] & 0xC0 == 0x80:
            end += 1
        yield lo, end
        lo = end


class Memo:
    """Summaries by content: (words, a word touches the start, a word touches the end, code points)."""

    def __init__(self, limit: int):
        self.limit, self.held, self.young, self.old = limit, 0, {}, {}

    def summary(self, chunk: bytes) -> tuple[int, bool, bool, int]:
        known = self.young.get(chunk)
        if known is None:
            known = self.old.get(chunk)
            if known is None:
                known = (len(chunk.split()), chunk[0] not in _SPACES, chunk[-1] not in _SPACES, len(chunk.decode()))
            if self.held > self.limit // 2:
                self.young, self.old, self.held = {}, self.young, 0
            self.young[chunk] = known
            self.held += len(chunk)
        return known


class Document:
    """Units of one text from the summaries of its chunks."""

    def __init__(self, parts: list[bytes], memo: Memo):
        self.parts = parts
        of = [memo.summary(p) for p in parts]
        # A word that runs over a border belongs to the chunk that it ends in.
        running_on = [a[2] and b[1] for a, b in zip(of, of[1:])] + [False]
        self.ended = list(accumulate((s[0] - on for s, on in zip(of, running_on)), initial=0))
        self.chars = list(accumulate((s[3] for s in of), initial=0))
        self.words = self.ended[-1]
        self.units = self.words + bool(of and not of[-1][2])

    def end(self, units: int) -> int:
        """Code points of the first ``units`` units."""
        if units == 0:
            return 0
        if units > self.words:
            return self.chars[-1]
        at = int(np.searchsorted(self.ended, units)) - 1
        part = self.parts[at]
        for n, word in enumerate(_WORD.finditer(part), self.ended[at] + 1):
            if n == units:
                return self.chars[at] + len(part[:word.end()].decode())
        raise AssertionError("summary and chunk differ")


def cuts(text: Column | str, first: Column, second: Column, spec: Chunking = Chunking()) -> Column:
    """struct<n, prefix_chars, middle_chars>: units of the text, and its parts if cut after ``first`` % (n + 1) and ``second`` % (n + 1)."""

    @F.arrow_udf("struct<n:long,prefix_chars:long,middle_chars:long>")
    def located(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        memo = Memo(spec.cache)
        for texts, one, two in batches:
            one, two, rows = one.to_pylist(), two.to_pylist(), []
            for first_row, _, data, bounds in text_slices(texts):
                possible = possible_cuts(data, spec)
                for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()), first_row):
                    parts = [data[a:b].tobytes() for a, b in chunks(data, lo, hi, possible, spec)]
                    document = Document(parts, memo)
                    n = document.units
                    a, b = sorted((one[i] % (n + 1), two[i] % (n + 1)))
                    start, end = document.end(a), document.end(b)
                    rows.append((n, start, end - start))
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.StructArray.from_arrays(columns, ["n", "prefix_chars", "middle_chars"])

    return located(text, first, second)


def restored(output: Column | str, form: Column | str) -> Column:
    """The text that ``output`` was made from."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    second = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    # No text that is cut holds a sentinel, and no sentinel overlaps itself, so the first one found is the one set.
    lead = F.when(form == "psm", F.substring_index(output, SUFFIX, 1)).otherwise(F.substring_index(output, PREFIX, 1))
    rest = F.substr(output, F.char_length(lead) + F.char_length(second) + 1)
    follow = F.substring_index(rest, MIDDLE, 1)
    middle = F.substr(rest, F.char_length(follow) + len(MIDDLE) + 1)
    lead = F.substr(lead, F.lit(len(PREFIX) + 1))
    return F.when(form == "plain", output).when(form == "psm", F.concat(lead, middle, follow)).otherwise(F.concat(follow, middle, lead))


def fill_in_middle(documents: DataFrame, spec: Chunking = Chunking()) -> DataFrame:
    """One row per row of ``documents``: doc_id, n, form, prefix_chars, middle_chars, output.

    n counts the units of the text: words with the white space before them, and white space at its end. Draws are taken from the
    SHA-256 of the salt and doc_id ('null' without one), so equal texts are cut apart differently and repeated rows alike. A null text
    is empty; empty texts and texts with a sentinel stay plain. Other columns are not looked at.
    """
    small_batches(documents.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    draws = F.sha2(F.concat(F.lit(SALT), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    h = [F.conv(F.substr("draws", F.lit(1 + 8 * i), F.lit(8)), 16, 10).cast("long") for i in range(4)]
    text = F.col("text")
    rows = documents.select(doc_id.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), draws.alias("draws"))
    held = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | held | (h[2] % 100 >= spec.rate), "plain").when(h[3] % 100 < spec.spm_rate, "spm").otherwise("psm")
    cut = rows.select("doc_id", "text", form.alias("form"), cuts(text, h[0], h[1], spec).alias("cut"))
    at, n = F.col("cut.prefix_chars").cast("int"), F.col("cut.middle_chars").cast("int")
    prefix, middle, suffix = F.substr(text, F.lit(1), at), F.substr(text, at + 1, n), F.substr(text, at + n + 1)
    output = (
        F.when(F.col("form") == "plain", text)
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    made = computed_once(cut, ["doc_id", "form", "cut"], output=output)
    unless_plain = lambda name: F.when(F.col("form") != "plain", F.col(f"cut.{name}")).alias(name)
    return made.select("doc_id", F.col("cut.n").alias("n"), "form", unless_plain("prefix_chars"), unless_plain("middle_chars"), "output")


def digests(filled: DataFrame) -> DataFrame:
    """The outputs and the texts rebuilt from them as digests."""
    return filled.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored("output", "form"), 256).alias("restored_sha256"),
    )
