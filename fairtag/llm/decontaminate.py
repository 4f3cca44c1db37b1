"""Benchmark decontamination by latent semantic retrieval.

Documents and benchmark items are cut into passages of ``2 * stride`` words, one every ``stride`` words, weighted by TF-IDF
over the words of the benchmark. A randomised SVD of the benchmark's passages, distributed over their rows, gives a latent
space; document passages whose cosine with a benchmark passage is high enough there are candidates. A candidate is a leak if
the longest common subsequence of the item's words and the words around the passage covers the item, or covers a good part of
it together with its answer (a paraphrase).

Document frequencies count all passages of all documents. The benchmark is the stated query set: it is taken in blocks of
bounded size, each of which is sent to the executors and held against every passage. Terms are hashed into a fixed number of
dimensions, so the space has one size whatever the benchmark's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from fairtag.llm.tables import small_batches
from fairtag.llm.words import Words, hashed_words, text_slices


@dataclass(frozen=True)
class Retrieval:
    stride: int = 16
    dimensions: int = 1 << 16  # hashed terms
    rank: int = 128  # of the latent space
    least_cosine: float = 0.4
    verbatim: float = 0.75  # of the item's words, in order: a leak by itself
    paraphrase: float = 0.55  # of the item's words, in order: a leak if the answer is there too
    answer: float = 0.8  # of the answer's words, in order
    answer_share: float = 0.25  # the answer is what follows the last question mark, else this last share of the words
    block_bytes: int = 8 << 20  # of benchmark text in one block
    seed: int = 11


def _words(data: np.ndarray, bounds: np.ndarray) -> Words:
    return hashed_words(data, bounds, marks=False)


def _strides(words: Words, spec: Retrieval) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stride of each word, the text of each stride, and the first word of each stride."""
    lengths = np.diff(words.first)
    counts = -(-lengths // spec.stride)
    first = np.concatenate([[0], np.cumsum(counts)])
    text_of = words.text_of
    stride_of = first[:-1][text_of] + (np.arange(len(words.hashes)) - words.first[:-1][text_of]) // spec.stride
    owner = np.repeat(np.arange(len(lengths)), counts)
    begins = words.first[:-1][owner] + (np.arange(len(owner)) - first[:-1][owner]) * spec.stride
    return stride_of, owner, begins


@lru_cache(maxsize=2)
def _projection(spec: Retrieval) -> np.ndarray:
    return np.random.default_rng(spec.seed).standard_normal((spec.dimensions, spec.rank), dtype=np.float32)


class Block:
    """Items of one block of the benchmark: their words, and the terms all of them hold."""

    def __init__(self, rows: list[tuple[int, str]], spec: Retrieval):
        self.spec, self.ids, self.items, self.answers = spec, [], [], []
        for item, text in rows:
            text = pc.utf8_lower(pa.scalar(text)).as_py()
            data = np.frombuffer(text.encode(), np.uint8)
            own = _words(data, np.array([0, len(data)])).hashes
            if not len(own):
                continue
            mark = text.rfind("?")
            tail = text[mark + 1:].encode() if mark >= 0 else b""
            answer = _words(np.frombuffer(tail, np.uint8), np.array([0, len(tail)])).hashes
            if not len(answer):
                answer = own[-max(1, round(spec.answer_share * len(own))):]
            self.ids.append(item)
            self.items.append(own)
            self.answers.append(answer)
        # Benchmark words that a passage must hold: half of what the shortest item asks of the words of one stride. What
        # else the corpus holds, and how much of it, plays no part.
        shortest = min((min(len(own), spec.stride) for own in self.items), default=1)
        self.least_words = max(1, int(spec.paraphrase * shortest / 2))
        self.terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.items]))
        self.item_terms = [np.searchsorted(self.terms, own) for own in self.items]
        # Marks part words, so every word of an answer is one of its item.
        self.answer_terms = [np.searchsorted(self.terms, answer) for answer in self.answers]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.passages = [
            (i, s) for i, own in enumerate(self.items)
            for s in range(0, max(1, len(own) - spec.stride), spec.stride)
        ]
        self.idf = self.basis = self.vectors = None

    def terms_of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that are terms of the block: their positions and term numbers."""
        at = np.flatnonzero(self.seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        term = np.searchsorted(self.terms, hashes[at])
        term = np.minimum(term, max(len(self.terms) - 1, 0))
        good = self.terms[term] == hashes[at] if len(at) else np.zeros(0, bool)
        return at[good], term[good]

    def dimension(self, term: np.ndarray) -> np.ndarray:
        return (self.terms[term] >> np.uint64(20)).astype(np.int64) % self.spec.dimensions

    def passage_terms(self, number: int) -> np.ndarray:
        item, start = self.passages[number]
        return np.searchsorted(self.terms, self.items[item][start:start + 2 * self.spec.stride])


def _frequencies(block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, strides = np.zeros(len(block.terms), np.int64), 0
        for batch in batches:
            for _, _, data, bounds in text_slices(pc.utf8_lower(batch.column("text"))):
                words = _words(data, bounds)
                stride_of, owner, _ = _strides(words, block.spec)
                at, term = block.terms_of(words.hashes)
                pairs = np.unique(stride_of[at] * len(block.terms) + term)
                counts += np.bincount(pairs % max(len(block.terms), 1), minlength=len(block.terms))
                strides += len(owner)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(held, -1)), pa.array(np.append(counts[held], strides))], ["term", "n"]
        )

    return run


def _range_part(shared):
    """Rows (dimension, vector) of Q'QX for the given benchmark passages; Q: passages by terms, X: random projection."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        spec, x = block.spec, _projection(block.spec)
        for batch in batches:
            at, values = [], []
            for number in batch.column("passage").to_pylist():
                term = block.passage_terms(number)
                weight = block.idf[term][:, None]
                row = (x[block.dimension(term)] * weight).sum(axis=0)
                at.append(block.dimension(term))
                values.append(weight * row)
            if not at:
                continue
            at, values = np.concatenate(at), np.concatenate(values).astype(np.float32)
            order = np.argsort(at, kind="stable")
            begins = np.flatnonzero(np.diff(at[order], prepend=-1))
            sums = np.add.reduceat(values[order], begins)
            yield pa.RecordBatch.from_arrays([
                pa.array(at[order][begins]), pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), spec.rank).cast(pa.list_(pa.float32()))
            ], ["dimension", "vector"])

    return run


def _sum_vectors(table: pa.Table) -> pa.Table:
    at = table.column("dimension").to_numpy()
    values = np.stack(table.column("vector").to_numpy())
    order = np.argsort(at, kind="stable")
    begins = np.flatnonzero(np.diff(at[order], prepend=-1))
    sums = np.add.reduceat(values[order], begins)
    return pa.table({"dimension": at[order][begins], "vector": pa.array(list(sums), pa.list_(pa.float32()))})


def fit(block: Block, documents: DataFrame) -> Block:
    """Give the block its IDF weights (counted over all documents) and its latent space."""
    spark, spec = documents.sparkSession, block.spec
    counted = documents.select("text").mapInArrow(_frequencies(block), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    rows = counted.toPandas()
    total = int(rows.n[rows.term == -1].sum())
    counts = np.zeros(len(block.terms))
    held = rows[rows.term >= 0]
    counts[held.term.to_numpy()] = held.n.to_numpy()
    block.idf = np.log((1 + total) / (1 + counts)).astype(np.float32)
    shared = spark.sparkContext.broadcast(block)
    numbers = spark.range(len(block.passages)).withColumnRenamed("id", "passage")
    parts = numbers.mapInArrow(_range_part(shared), "dimension long, vector array<float>")
    sums = parts.groupBy((F.col("dimension") % 64).alias("part")).applyInArrow(_sum_vectors, "dimension long, vector array<float>").toPandas()
    dense = np.zeros((spec.dimensions, spec.rank), np.float32)
    if len(sums):
        dense[sums.dimension.to_numpy()] = np.stack(sums.vector.to_numpy())
    # An orthonormal basis of the range, turned onto the singular directions of the passages.
    basis = np.linalg.qr(dense)[0]
    vectors = np.stack([_project(block, basis, block.passage_terms(i)) for i in range(len(block.passages))])
    _, values, turn = np.linalg.svd(vectors, full_matrices=False)
    strong = values > 1e-4 * max(values[0], 1e-9)
    basis = (basis @ turn[strong].T).astype(np.float32)
    block.basis, vectors = basis, vectors @ turn[strong].T
    # The space holds only part of a passage's mass. Scaled by that part, the product with a copy of the passage is its
    # cosine, however small the part is; what other words add to it is noise that the word comparison sorts out.
    lengths = np.array([_length(block, block.passage_terms(i)) for i in range(len(block.passages))])
    block.vectors = vectors * (lengths / np.maximum((vectors**2).sum(axis=1), 1e-9))[:, None]
    return block


def _length(block: Block, term: np.ndarray) -> float:
    return float(np.sqrt((np.bincount(np.unique(block.dimension(term), return_inverse=True)[1], block.idf[term]) ** 2).sum()))


def _project(block: Block, basis: np.ndarray, term: np.ndarray) -> np.ndarray:
    return (basis[block.dimension(term)] * block.idf[term][:, None]).sum(axis=0)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b.tolist():
        hit = row & masks.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _latent(block: Block, strides: np.ndarray, term: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """[hi - lo, rank]: latent vectors of the strides from ``lo`` on, given the sorted stride and the term of each benchmark word."""
    own = slice(np.searchsorted(strides, lo), np.searchsorted(strides, hi))
    sums = np.zeros((hi - lo, block.basis.shape[1]), np.float32)
    if own.start < own.stop:
        # Each term's vector is made once, and summed for the words of a stride.
        terms, row = np.unique(term[own], return_inverse=True)
        table = block.basis[block.dimension(terms)] * block.idf[terms][:, None]
        begins = np.flatnonzero(np.diff(strides[own], prepend=-1))
        sums[strides[own][begins] - lo] = np.add.reduceat(table[row], begins)
    return sums


#: Strides whose words are turned into vectors at a time.
GROUP = 1024


def _candidates(block: Block, words: Words, at: np.ndarray, term: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(text, item, first, end, cosine): where an item may be, by the cosine of a passage with one of its passages.

    ``first`` and ``end`` bound the benchmark's words there, as places in ``term``.
    """
    spec = block.spec
    stride_of, owner, begins = _strides(words, spec)
    if not len(owner):
        return []
    strides = stride_of[at]
    # TF-IDF mass and number of the benchmark's words in each stride.
    known = np.bincount(strides, block.idf[term].astype(np.float64) ** 2, len(owner))
    number = np.bincount(strides, minlength=len(owner))
    more = np.append(owner[1:] == owner[:-1], False)
    known += np.append(known[1:], 0) * more
    number = number + np.append(number[1:], 0) * more
    # The last stride of a text is a passage of its own only where it is the only one.
    alone = np.append(True, owner[1:] != owner[:-1])
    held = (more | alone) & (number >= block.least_words) & (known > 0)
    item_of = np.array([item for item, _ in block.passages])
    start_of = np.array([start for _, start in block.passages])
    length_of = np.array([len(own) for own in block.items])
    vectors = np.ascontiguousarray(block.vectors.T.astype(np.float32))
    found = []
    for lo in range(0, len(owner), GROUP):
        hi = min(lo + GROUP, len(owner))
        rows = np.flatnonzero(held[lo:hi])
        if not len(rows):
            continue
        sums = _latent(block, strides, term, lo, min(hi + 1, len(owner)))
        both = sums[:hi - lo].copy()
        both[:len(sums) - 1] += sums[1:] * more[lo:lo + len(sums) - 1, None]
        cosine = (both[rows] / np.sqrt(known[lo + rows])[:, None].astype(np.float32)) @ vectors
        row, passage = np.nonzero(cosine >= spec.least_cosine)
        stride, item = lo + rows[row], item_of[passage]
        # The words around the passage in which the whole item fits, however the two are aligned.
        begin = begins[stride] - start_of[passage]
        first = np.maximum(words.first[owner[stride]], begin - 2 * spec.stride)
        end = np.minimum(words.first[owner[stride] + 1], begin + length_of[item] + 2 * spec.stride)
        _, once = np.unique(item * (len(words.hashes) + 1) + first, return_index=True)
        columns = (
            owner[stride[once]], item[once], np.searchsorted(at, first[once]), np.searchsorted(at, end[once]), cosine[row[once], passage[once]]
        )
        found += zip(*(c.tolist() for c in columns))
    return found


def leaks_of(block: Block, data: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], tuple[float, float, float]]:
    """By (text, item): the shares of the item and of its answer that are found in order, and the cosine."""
    spec = block.spec
    words = _words(data, bounds)
    at, term = block.terms_of(words.hashes)
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    tried = set()
    there = np.zeros(len(block.terms), bool)
    for text, item, first, end, cosine in _candidates(block, words, at, term):
        if (item, first, end) in tried:
            continue
        tried.add((item, first, end))
        own, around = block.item_terms[item], term[first:end]
        # No more words can follow in order than are there at all.
        there[around] = True
        count = np.count_nonzero(there[own])
        there[around] = False
        if count < spec.paraphrase * len(own):
            continue
        # Words that the item does not hold play no part in a common subsequence.
        there[own] = True
        around = around[there[around]]
        there[own] = False
        share = common_subsequence(own, around) / len(own)
        answer = common_subsequence(block.answer_terms[item], around) / len(block.answers[item])
        if share >= spec.verbatim or share >= spec.paraphrase and answer >= spec.answer:
            key = (text, item)
            best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (share, answer, cosine))
    return best


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for lo, hi, data, bounds in text_slices(pc.utf8_lower(batch.column("text"))):
                best = leaks_of(block, data, bounds)
                keys = sorted(best)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(lo, hi - lo).take(pa.array([k[0] for k in keys], pa.int64())),
                    pa.array([block.ids[k[1]] for k in keys], pa.int64()),
                    *(pa.array([best[k][c] for k in keys], pa.float64()) for c in range(3)),
                ], ["doc_id", "item_id", "lcs_share", "answer_share", "cosine"])

    return run


LEAKS = "doc_id long, item_id long, lcs_share double, answer_share double, cosine double"


def _fitted_blocks(documents: DataFrame, benchmark: DataFrame, spec: Retrieval) -> Iterator:
    """The blocks of the benchmark, of about ``block_bytes`` each, fitted and sent to the executors."""
    spark = small_batches(documents.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = -(-size // spec.block_bytes)
    for number in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == number)
        block = Block([tuple(r) for r in own.collect()], spec)
        if block.items:
            yield spark.sparkContext.broadcast(fit(block, documents))


def find_leaks(documents: DataFrame, benchmark: DataFrame, spec: Retrieval = Retrieval()) -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, item_id, lcs_share, answer_share, cosine.

    Items or documents without words (null texts too) hold nothing. Items of equal text are all reported. Repeated rows of a
    document give one row; a document without doc_id is reported with a null. Other columns are not looked at.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = documents.sparkSession.createDataFrame([], LEAKS)
    for shared in _fitted_blocks(docs, benchmark, spec):
        found = found.union(docs.mapInArrow(_search(shared), LEAKS))
    return found.groupBy("doc_id", "item_id").agg(
        F.max("lcs_share").alias("lcs_share"), F.max("answer_share").alias("answer_share"), F.max("cosine").alias("cosine")
    )


def without_leaks(documents: DataFrame, benchmark: DataFrame, spec: Retrieval = Retrieval()) -> DataFrame:
    """The rows of ``documents`` that hold no item of the benchmark, with all their columns."""
    def keep(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for lo, _, data, bounds in text_slices(pc.utf8_lower(batch.column("text"))):
                    clean[[lo + text for text, _ in leaks_of(shared.value, data, bounds)]] = False
                yield batch.filter(pa.array(clean))

        return run

    kept = documents
    for shared in _fitted_blocks(documents, benchmark, spec):
        kept = kept.mapInArrow(keep(shared), documents.schema)
    return kept
