"""Substring dedup by De Bruijn compaction of token k-mers.

A window of ``span`` words is an edge of the De Bruijn graph whose nodes are its first and last ``span - 1`` words. Only
repeated edges can be removed, so only they enter the graph:

1. *Anchors.* Of every ``span - anchor + 1`` consecutive ``anchor``-word mers the one of least hash is an anchor. Equal windows
   hold the same anchor, so a window without a repeated anchor is not repeated. Anchors are about a twelfth of all words.
2. *Edges.* Texts with a repeated anchor give the hashes of the windows around it. Counting them leaves the repeated edges.
3. *Paths.* A join puts the repeated edges back on their texts, where edges that follow each other with one multiplicity are
   compacted into a path inside a task; node degrees are not looked at. A path keeps its coordinates in the text and the hash
   of its first edge.
4. *Coordinates.* There the words of the text are hashed again; only a path whose first edge is found is removed. Words are not
   compared with those of another occurrence.

Windows are named by 96 bits, and equal names count as equal windows. Equal texts are worked on once and counted as often as they occur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fairtag.llm.tables import distinct_texts, small_batches, text_key, written
from fairtag.llm.words import Words, hashed_words, lists, mix, text_slices, window_hashes


@dataclass(frozen=True)
class Spans:
    span: int = 35  # words of a window
    anchor: int = 12  # words of an anchor, at most ``span``


def anchor_positions(words: Words, spec: Spans) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of the anchors (over all texts of ``words``) and their hashes."""
    hashes, valid = window_hashes(words, spec.anchor)
    n, width = len(hashes), spec.span - spec.anchor + 1
    if n < spec.span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # Least hash of every ``width`` consecutive mers, by doubling; equal hashes are all anchors.
    least, have = np.where(valid, hashes, np.uint64(2**64 - 1)), 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    least[words.left()[:len(least)] < spec.span] = 0  # windows that leave their text select nothing
    reach, have = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(n - len(least), np.uint64)]), 1
    # A mer is an anchor if its hash is the least of a window that covers it: the greatest of those least values.
    while have < width:
        step = min(have, width - have)
        reach = np.maximum(reach[:-step], reach[step:])
        have += step
    at = np.flatnonzero(valid & (reach[:n] == hashes))
    return at, hashes[at]


def kept_text(words: Words, text: int, keep: np.ndarray | None = None) -> str:
    """SHA-256 of the kept words of one text, joined by one space."""
    lo, hi = words.first[text], words.first[text + 1]
    if lo == hi:
        return hashlib.sha256(b"").hexdigest()
    own = words.data[words.starts[lo]:words.ends[hi - 1]].tobytes().split()
    if keep is not None:
        own = [w for w, k in zip(own, keep.tolist()) if k]
    return hashlib.sha256(b" ".join(own)).hexdigest()


def _scan(spec: Spans):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in text_slices(batch.column("text")):
                words = hashed_words(data, bounds)
                at, hashes = anchor_positions(words, spec)
                text_of = np.searchsorted(words.first, at, side="right") - 1
                # Positions count from the start of the text.
                edges = np.searchsorted(text_of, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "k1", "k2")),
                    pa.array(np.diff(words.first), pa.int64()),
                    pa.array([kept_text(words, i) for i in range(hi - lo)]),
                    lists((at - words.first[text_of]).astype(np.int32), edges, pa.int32()),
                    lists(hashes.view(np.int64), edges, pa.int64()),
                ], ["doc_id", "k1", "k2", "n_words", "sha256", "positions", "anchors"])

    return run


SCANNED = "doc_id long, k1 long, k2 int, n_words long, sha256 string, positions array<int>, anchors array<long>"


def _check(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes * np.uint64(0xA24BAED4963EE407)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _edges(words: Words, spec: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (64 bits), check (32 bits of a second, independent hash) and validity of the window at every word."""
    hashes, valid = window_hashes(words, spec.span)
    second = Words(words.data, words.starts, words.ends, words.first, mix(words.hashes + np.uint64(0x632BE59BD9B4E019)))
    return hashes, _check(window_hashes(second, spec.span)[0]), valid


def _emit_edges(spec: Spans):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column("positions")
            for lo, hi, data, bounds in text_slices(batch.column("text")):
                words = hashed_words(data, bounds)
                n = len(words.hashes)
                own = near.slice(lo, hi - lo)
                at = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                lengths = np.diff(own.offsets.to_numpy())
                at = at + np.repeat(words.first[:-1], lengths)
                at = at[at < n]
                steps = np.zeros(n + 1, np.int64)
                np.add.at(steps, np.maximum(at - (spec.span - spec.anchor), 0), 1)
                np.add.at(steps, at + 1, -1)
                hashes, check, valid = _edges(words, spec)
                use = np.flatnonzero((np.cumsum(steps[:-1]) > 0) & valid)
                text_of = words.text_of[use]
                yield pa.RecordBatch.from_arrays([
                    pa.array(hashes[use].view(np.int64)), pa.array(check[use]),
                    batch.column("number").slice(lo, hi - lo).take(pa.array(text_of)),
                    pa.array((use - words.first[text_of]).astype(np.int32)),
                    batch.column("copies").slice(lo, hi - lo).take(pa.array(text_of)),
                ], ["edge", "check", "number", "position", "copies"])

    return run


EDGES = "edge long, check int, number long, position int, copies long"


def _compact(table: pa.Table) -> pa.Table:
    """Paths of one text: repeated edges that follow each other with one multiplicity."""
    order = np.argsort(table.column("position").to_numpy(), kind="stable")
    position, times, check = (table.column(c).to_numpy()[order] for c in ("position", "times", "check"))
    opens = np.ones(len(position), bool)
    opens[1:] = (position[1:] != position[:-1] + 1) | (times[1:] != times[:-1])
    at = np.flatnonzero(opens)
    lengths = np.diff(np.append(at, len(position)))
    return pa.table({
        "number": table.column("number").slice(0, 1),
        "paths": lists(position[at].astype(np.int32), np.array([0, len(at)]), pa.int32()),
        "lengths": lists(lengths.astype(np.int32), np.array([0, len(at)]), pa.int32()),
        "checks": lists(check[at].astype(np.int32), np.array([0, len(at)]), pa.int32()),
    })


def _remove(spec: Spans):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in text_slices(batch.column("text")):
                words = hashed_words(data, bounds)
                _, check, valid = _edges(words, spec)
                removed, digests = [], []
                for i in range(hi - lo):
                    first, n = words.first[i], words.first[i + 1] - words.first[i]
                    keep = np.ones(n, bool)
                    for start, length, seen in zip(*(batch.column(c)[lo + i].as_py() for c in ("paths", "lengths", "checks"))):
                        # The first edge at the coordinates must be that of the path.
                        if start < n and valid[first + start] and check[first + start] == seen:
                            keep[start:start + length + spec.span - 1] = False
                    removed.append(int(n - keep.sum()))
                    digests.append(kept_text(words, i, keep))
                yield pa.RecordBatch.from_arrays([
                    batch.column("k1").slice(lo, hi - lo), batch.column("k2").slice(lo, hi - lo),
                    pa.array(removed, pa.int64()), pa.array(digests, pa.string()),
                ], ["k1", "k2", "n_removed", "sha256"])

    return run


def remove_repeats(documents: DataFrame, spec: Spans = Spans()) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256.

    Removed are the words covered by a window of ``span`` words that also starts anywhere else, in the same document too.
    Windows are judged on the input. A null or empty text has no words. Rows that share a doc_id are documents of their own;
    other columns are not looked at.
    """
    small_batches(documents.sparkSession)
    key = ["k1", "k2"]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(), "text")
    scanned = written(rows.mapInArrow(_scan(spec), SCANNED))
    anchors = scanned.select(*key, F.explode(F.arrays_zip("positions", "anchors")).alias("a")).select(
        *key, F.col("a.positions").alias("position"), F.col("a.anchors").alias("anchor")
    )
    repeated = anchors.groupBy("anchor").count().where("count > 1").select("anchor")
    near = written(
        anchors.join(repeated, "anchor").groupBy(*key).agg(F.collect_set("position").alias("positions"))
        .withColumn("number", F.monotonically_increasing_id())  # stays as it is, once written
    )
    copies = scanned.join(near.select(*key), key, "left_semi").groupBy(*key).agg(F.count("*").alias("copies"))
    texts = distinct_texts(rows.select("text"), near).join(near, key).join(copies, key)
    edges = written(texts.mapInArrow(_emit_edges(spec), EDGES))
    times = (
        edges.groupBy("edge", "check").agg(F.sum("copies").alias("times")).where("times > 1")
    )
    paths = written(
        edges.drop("copies").join(times, ["edge", "check"])
        .select("number", "position", "check", "times").groupBy("number")
        .applyInArrow(_compact, "number long, paths array<int>, lengths array<int>, checks array<int>")
        .join(near.select("number", *key), "number").drop("number")
    )
    changed = distinct_texts(rows.select("text"), paths).join(paths, key).mapInArrow(
        _remove(spec), "k1 long, k2 int, n_removed long, sha256 string"
    )
    out = scanned.select("doc_id", *key, "n_words", "sha256").join(
        written(changed).withColumnRenamed("sha256", "rest"), key, "left"
    )
    return out.select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("rest", "sha256").alias("kept_sha256"),
    )
