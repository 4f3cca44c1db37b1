"""MinHash near-dedup by min-max hashing.

Every permutation of the shingle hashes gives two signature values, its least and its greatest, so half the hash evaluations
fill a signature. Bands of the signature propose pairs; a pair is a link only if the full shingle sets confirm it. Documents
of equal sets form one class and are compared once. Classes meet the least class of their bucket first. Members of a bucket
that then still are in different components are compared in tiles inside a task, by counts of shared shingles; only pairs that
reach the threshold leave it, the closest first, so neither a large group of copies nor one of texts that are merely alike is
expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fairtag.llm.components import components
from fairtag.llm.tables import boxed, distinct_texts, small_batches, text_key, written
from fairtag.llm.words import hashed_words, lists, mix, text_slices


@dataclass(frozen=True)
class NearDup:
    """Bands of ``rows`` values over ``permutations`` permutations: a pair at the threshold of 0.8 is missed with a
    probability of (1 - 0.8**4)**32 = 5e-8."""

    shingle: int = 2
    threshold: int = 80  # hundredths of intersection over union
    permutations: int = 64
    rows: int = 4
    # Members of other components that a class is confirmed against, the closest first, in each pass; the last takes all.
    closest: tuple[int, ...] = (4, 1 << 30)
    seed: int = 5

    @property
    def bands(self) -> int:
        return 2 * self.permutations // self.rows


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their bounds; a text of fewer words has its whole sequence."""
    words = hashed_words(data, bounds, lower=True)
    n, texts = len(words.hashes), len(bounds) - 1
    multiplier = np.uint64(0xD6E8FEB86659FD93)
    values = np.full(n, 0x51ED270B, np.uint64)
    room = words.left()
    for step in range(size):
        # A sequence that ends early goes on with zeros; it is only used for texts of fewer words.
        here = np.zeros(n, np.uint64)
        here[:n - step] = words.hashes[step:]
        values = mix(values * multiplier + np.where(room > step, here, np.uint64(0)))
    text_of = words.text_of
    lengths = np.diff(words.first)
    use = (room >= size) | ((lengths[text_of] < size) & (np.arange(n) == words.first[:-1][text_of]))
    values, text_of = values[use], text_of[use]
    order = np.lexsort((values, text_of))
    values, text_of = values[order], text_of[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (text_of[1:] != text_of[:-1])
    values, text_of = values[fresh], text_of[fresh]
    return values, np.searchsorted(text_of, np.arange(texts + 1))


def signatures(values: np.ndarray, bounds: np.ndarray, permutations: int, seed: int) -> np.ndarray:
    """uint64 [sets, 2 * permutations]: least and greatest value of each set under each permutation."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 2**63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 2**63, permutations, dtype=np.uint64)
    out = np.zeros((len(bounds) - 1, 2 * permutations), np.uint64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        at = bounds[:-1][full]
        for i in range(permutations):
            moved = values * factors[i] + shifts[i]
            moved ^= moved >> np.uint64(32)
            moved *= np.uint64(0x9E3779B97F4A7C15)
            out[full, 2 * i] = np.minimum.reduceat(moved, at)
            out[full, 2 * i + 1] = np.maximum.reduceat(moved, at)
    return out


def _profiles(spec: NearDup):
    """Rows of the documents with their set, its size and its signature (as 32-bit values, four to a band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in text_slices(batch.column("text")):
                values, edges = shingle_sets(data, bounds, spec.shingle)
                sizes = np.diff(edges)
                signature = (signatures(values, edges, spec.permutations, spec.seed) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                # The set itself is named by two sums of its values, each under a mixing of its own.
                names = [np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)]
                full = sizes > 0
                if full.any():
                    for name, salt in zip(names, (0x1B873593, 0xCC9E2D51)):
                        name[full] = np.add.reduceat(mix(values + np.uint64(salt)), edges[:-1][full])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(lo, hi - lo), batch.column("k1").slice(lo, hi - lo),
                    batch.column("k2").slice(lo, hi - lo), pa.array(sizes, pa.int64()),
                    pa.array(names[0].view(np.int64)), pa.array(names[1].view(np.int64)),
                    lists(signature.ravel(), np.arange(hi - lo + 1) * signature.shape[1], pa.int32()),
                ], ["doc_id", "k1", "k2", "n_shingles", "s1", "s2", "signature"])

    return run


PROFILE = "doc_id long, k1 long, k2 int, n_shingles long, s1 long, s2 long, signature array<int>"


def _confirmed(spec: NearDup):
    """Of pairs with both texts, those whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = []
            for name in ("text_a", "text_b"):
                sets = []
                for _, _, data, bounds in text_slices(batch.column(name)):
                    values, edges = shingle_sets(data, bounds, spec.shingle)
                    sets += [values[edges[i]:edges[i + 1]] for i in range(len(edges) - 1)]
                sides.append(sets)
            shared = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sides)])
            union = np.array([len(x) + len(y) for x, y in zip(*sides)]) - shared
            keep = (100 * shared >= spec.threshold * union) & (union > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _confirm(pairs: DataFrame, texts: DataFrame, spec: NearDup) -> DataFrame:
    """The links among ``pairs`` (a, b), checked on whole texts."""
    both = (
        pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
    )
    return written(both.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed(spec), "a long, b long"))


def _short_sets(spec: NearDup):
    """The shingles of each text, 32 bits each: two sets share at least as many of these as of the shingles themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in text_slices(batch.column("text")):
                values, edges = shingle_sets(data, bounds, spec.shingle)
                short = (values >> np.uint64(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("cls").slice(lo, hi - lo),
                    pa.array([short[edges[i]:edges[i + 1]].tobytes() for i in range(hi - lo)], pa.binary()),
                ], ["cls", "shingles"])

    return run


def _closest(spec: NearDup, most: int):
    """Of one tile of a bucket, pairs of members of different components that reach the threshold: the ``most`` closest of each."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        tile, x, y, cls, root = (table.column(c).to_numpy() for c in ("tile", "x", "y", "cls", "root"))
        sets = [np.frombuffer(b, np.uint32) for b in table.column("shingles").to_pylist()]
        left, right = np.flatnonzero(tile == x[0]), np.flatnonzero(tile == y[0])
        sizes = np.array([len(sets[i]) for i in right])
        owner = np.repeat(np.arange(len(right)), sizes)
        values = np.concatenate([sets[i] for i in right]) if len(right) else np.zeros(0, np.uint32)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        found = [np.zeros((0, 2), np.int64)]
        for i in left:
            begin, end = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
            lengths = end - begin
            hits = np.repeat(begin - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            shared = np.bincount(owner[hits], minlength=len(right))
            union = sizes + len(sets[i]) - shared
            near = np.flatnonzero((100 * shared >= spec.threshold * union) & (root[right] != root[i]))
            if len(near) > most:
                near = near[np.argsort(-(shared / union)[near], kind="stable")[:most]]
            other = cls[right[near]]
            found.append(np.stack([np.minimum(other, cls[i]), np.maximum(other, cls[i])], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    return run


def _apart(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, cls, root) of the buckets whose members lie in several components."""
    placed = shared.select("bucket", "cls").join(roots.withColumnRenamed("id", "cls"), "cls", "left").select(
        "bucket", "cls", F.coalesce("root", "cls").alias("root")
    )
    mixed = (
        placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members"))
        .where("lo <> hi").select("bucket", F.ceil(F.col("members") / F.lit(TILE)).cast("int").alias("tiles"))
    )
    return placed.join(mixed, "bucket")


def _ask(apart: DataFrame, sets: DataFrame, spec: NearDup, most: int) -> DataFrame:
    """The pairs to confirm, from tiles of bounded size: every two parts of a bucket meet in one."""
    rows = (
        apart.withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("bucket", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "tile", "cls", "root")
        .join(sets, "cls")
    )
    return written(rows.groupBy("bucket", "x", "y").applyInArrow(_closest(spec, most), "a long, b long").distinct())


def _grouped(documents: DataFrame, spec: NearDup) -> DataFrame:
    """doc_id, k1, k2 (its text), n_shingles, root (a name of its component, null for an empty set) and component (its least doc_id)."""
    small_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(), "text")
    profiles = written(rows.mapInArrow(_profiles(spec), PROFILE))

    named = ["s1", "s2", "n_shingles"]
    classes = written(
        profiles.where("n_shingles > 0").groupBy(*named)
        .agg(F.min("doc_id").alias("least"), F.min(F.struct("k1", "k2")).alias("key"), F.first("signature").alias("signature"))
        .select(*named, "least", "key.k1", "key.k2", "signature", F.monotonically_increasing_id().alias("cls"))
    )
    band = lambda i: F.xxhash64(F.lit(i), F.slice("signature", i * spec.rows + 1, spec.rows))
    buckets = classes.select(
        "cls", "n_shingles", F.explode(F.array(*[band(i) for i in range(spec.bands)])).alias("bucket")
    )
    hubs = buckets.groupBy("bucket").agg(F.min("cls").alias("hub"), F.count("*").alias("members")).where("members > 1")
    shared = written(buckets.join(hubs.select("bucket", "hub"), "bucket").select("bucket", "cls", "n_shingles", "hub"))
    near = (
        100 * F.least("n_shingles", "hub_size") >= spec.threshold * F.greatest("n_shingles", "hub_size")
    )
    sizes = classes.select(F.col("cls").alias("hub"), F.col("n_shingles").alias("hub_size"))
    first = written(
        shared.where("cls <> hub").select("cls", "n_shingles", "hub").distinct().join(sizes, "hub").where(near)
        .select(F.col("cls").alias("a"), F.col("hub").alias("b"))
    )
    members = shared.select("cls").distinct()
    keys = classes.join(members, "cls").select("cls", "k1", "k2")
    texts = written(keys.join(distinct_texts(rows.select("text"), keys), ["k1", "k2"]).select("cls", "text"))
    links = _confirm(first, texts, spec)
    roots = components(links)
    sets = None
    for most in spec.closest:
        apart = written(_apart(shared, roots))
        if sets is None:
            sets = written(texts.join(apart.select("cls").distinct(), "cls").mapInArrow(_short_sets(spec), "cls long, shingles binary"))
        more = _confirm(_ask(apart, sets, spec, most), texts, spec)
        if not more.isEmpty():
            links = written(links.union(more))
            roots = components(links)

    named_classes = classes.join(roots.withColumnRenamed("id", "cls"), "cls", "left").select(
        *named, "least", F.coalesce("root", "cls").alias("root")
    )
    least = named_classes.groupBy("root").agg(F.min("least").alias("component"))
    joined = named_classes.join(least, "root").select(*named, "root", "component")
    return profiles.select("doc_id", "k1", "k2", *named).join(joined, named, "left").select(
        "doc_id", "k1", "k2", "n_shingles", "root", "component"
    )


def near_duplicates(documents: DataFrame, spec: NearDup = NearDup()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Links hold between documents whose sets of lower-cased word shingles have 100 * intersection >= threshold * union.
    A null text, or one without words, has an empty set and links with nothing: its component is itself. Documents of equal sets
    are one class whatever their number, repeated rows included. component_id is the least doc_id of the component; rows
    without doc_id join their component and are kept only where it has no doc_id at all. Other columns are not looked at.
    """
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return _grouped(documents, spec).select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def representatives(documents: DataFrame, spec: NearDup = NearDup()) -> DataFrame:
    """The rows of ``documents`` without near copies: of each component the row of least doc_id, once.

    Rows without doc_id come last; texts without words have no copies and all stay. All columns are kept.
    """
    grouped = written(_grouped(documents, spec))
    chosen = (
        grouped.where("root is not null").groupBy("root")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "k1", "k2")).alias("c"))
        .select("c.*")
    )
    # Copies of one text have keys of their own, so a large group of them does not meet in one task.
    key = ["none", "id", "k1", "k2"]
    k1, k2 = text_key()
    id_ = F.col("doc_id").cast("long")
    marked = boxed(
        documents, none=id_.isNull(), id=F.coalesce(id_, F.lit(0)), k1=k1, k2=k2,
        worded=F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)),
    )
    order = Window.partitionBy(*key).orderBy(F.lit(0))
    once = marked.where("worded").join(chosen, key).withColumn("nth", F.row_number().over(order)).where("nth = 1")
    return once.select("row.*").unionByName(marked.where("not worded").select("row.*"))


#: Members of a bucket that one task compares with as many others.
TILE = 1024
