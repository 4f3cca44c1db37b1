"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are lexicon densities (a lexicon of words that labelled toxic documents hold more often than others),
closeness of such words to second-person pronouns, shares of capitals and punctuation, and rates of obfuscated words. Trees
are boosted on the logistic loss; an isotonic step function, fitted on labelled rows that the trees have not seen, turns
their output into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fairtag.llm.tables import small_batches, written
from fairtag.llm.words import hashed_words, text_slices

# Pronouns that address the reader, and the signs that stand for letters in obfuscated words.
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes"
).split()
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
FEATURES = [
    "lexicon_hits", "lexicon_density", "lexicon_distinct", "lexicon_weight", "near_you", "obfuscated_hits", "mixed_words",
    "second_person", "capitals", "capital_words", "exclamations", "punctuation", "repeated_marks", "digits", "log_words",
]


@dataclass(frozen=True)
class Trees:
    train_rows: int = 20_000  # labelled documents the lexicon and the trees are fitted on, by the hash of their id
    lexicon: int = 400  # words
    least_documents: int = 4  # toxic training documents a lexicon word is in
    least_z: float = 3.5  # of its log odds
    rounds: int = 60
    depth: int = 3
    rate: float = 0.15
    bins: int = 32
    leaf_rows: int = 20
    calibration: int = 3  # one in so many training rows calibrates instead of training
    near: int = 6  # words


def _hashes(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    return hashed_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), lower=True, marks=False).hashes


class Features:
    def __init__(self, lexicon: dict[str, float], spec: Trees):
        self.spec = spec
        names = [w for w in lexicon if len(_hashes([w])) == 1]
        hashes = np.concatenate([np.zeros(0, np.uint64), *[_hashes([w]) for w in names]])
        order = np.argsort(hashes)
        self.lexicon, self.weights = hashes[order], np.array([lexicon[w] for w in names])[order] if names else np.zeros(0)
        self.second = np.sort(_hashes(SECOND_PERSON))
        self.seen = np.zeros(1 << 16, bool)
        for known in (self.lexicon, self.second):
            self.seen[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.letters = np.arange(256, dtype=np.uint8)
        for sign, letter in LOOKALIKES.items():
            self.letters[ord(sign)] = ord(letter)

    def _find(self, hashes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.seen[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        if not len(known) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
        good = known[place] == hashes[at]
        return at[good], place[good]

    def of(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """[texts, features] of whole texts."""
        texts = len(bounds) - 1
        words = hashed_words(data, bounds, lower=True, marks=False)
        text_of = words.text_of
        count = lambda at, n=None: np.bincount(at, n, texts).astype(float)
        n_words, n_bytes = np.maximum(np.diff(words.first), 1), np.maximum(np.diff(bounds), 1)
        hit, place = self._find(words.hashes, self.lexicon)
        you, _ = self._find(words.hashes, self.second)
        hits = count(text_of[hit])
        distinct = np.unique(text_of[hit] * (len(self.lexicon) + 1) + place) // (len(self.lexicon) + 1)
        weight = count(text_of[hit], self.weights[place])
        # Lexicon words with a second-person pronoun of the same text close by.
        after = np.searchsorted(you, hit)
        close = np.zeros(len(hit), bool)
        if len(you):
            for other in (you[np.minimum(after, len(you) - 1)], you[np.maximum(after - 1, 0)]):
                close |= (np.abs(other - hit) <= self.spec.near) & (text_of[other] == text_of[hit])
        # Words as parted by white space: with look-alike signs for letters, and of letters mixed with signs or digits.
        plain = hashed_words(self.letters[data], bounds, lower=True, marks=False)
        masked, _ = self._find(plain.hashes, self.lexicon)
        masked_hits = np.maximum(count(plain.text_of[masked]) - hits, 0)
        upper = (data >= 65) & (data <= 90)
        letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
        digit = (data >= 48) & (data <= 57)
        mark = (data < 128) & (data > 32) & ~letter & ~digit
        inner = np.zeros(len(data), bool)
        if len(data) > 2:
            inner[1:-1] = (mark | digit)[1:-1] & letter[:-2] & letter[2:]
        sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[bounds]).astype(float)
        repeated = np.zeros(len(data), bool)
        repeated[1:] = mark[1:] & (data[1:] == data[:-1])
        letters = np.maximum(sums(letter), 1)
        running = np.concatenate([[0], np.cumsum(upper)])
        shouted = (running[words.ends] - running[words.starts] == words.ends - words.starts) & (words.ends - words.starts > 2)
        return np.stack([
            hits, hits / n_words, count(distinct), weight / n_words, count(text_of[hit[close]]), masked_hits, sums(inner) / n_words,
            count(text_of[you]) / n_words, sums(upper) / letters, count(text_of[shouted]) / n_words, sums(data == 33) / n_words,
            sums(mark) / n_bytes, sums(repeated) / n_words, sums(digit) / n_bytes, np.log1p(np.diff(words.first)),
        ], axis=1)


class Model:
    """Features, boosted trees (as arrays) and the steps of the calibration."""

    def __init__(self, features: Features, spec: Trees):
        self.features, self.spec, self.trees, self.base = features, spec, [], 0.0
        self.steps, self.levels = np.array([-np.inf]), np.array([0.0])

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        spec = self.spec
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, spec.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T)], axis=1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        value = np.full(len(y), self.base)
        for _ in range(spec.rounds):
            p = 1 / (1 + np.exp(-value))
            gradient, weight = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            splits, leaf = [], np.zeros(2 ** spec.depth)
            for level in range(spec.depth):
                chosen = []
                for n in range(2 ** level):
                    rows = node == n
                    chosen.append(self._split(binned[rows], gradient[rows], weight[rows], edges))
                for n, (feature, cut) in enumerate(chosen):
                    rows = node == n
                    node[rows] = 2 * n + (x[rows, feature] >= cut)
                splits.append(chosen)
            for n in range(2 ** spec.depth):
                rows = node == n
                leaf[n] = spec.rate * gradient[rows].sum() / (weight[rows].sum() + 1.0)
            value += leaf[node]
            self.trees.append((splits, leaf))

    def _split(self, binned: np.ndarray, gradient: np.ndarray, weight: np.ndarray, edges: list[np.ndarray]) -> tuple[int, float]:
        """(feature, least value of the right side) of the best split; a split that sends all left if there is none."""
        best, found = 1e-9, (0, np.inf)
        if len(binned) < 2 * self.spec.leaf_rows:
            return found
        for f, cuts in enumerate(edges):
            if not len(cuts):
                continue
            n = np.cumsum(np.bincount(binned[:, f], minlength=len(cuts) + 1))
            g = np.cumsum(np.bincount(binned[:, f], gradient, len(cuts) + 1))
            h = np.cumsum(np.bincount(binned[:, f], weight, len(cuts) + 1))
            gain = g**2 / (h + 1) + (g[-1] - g)**2 / (h[-1] - h + 1) - g[-1]**2 / (h[-1] + 1)
            gain[(n < self.spec.leaf_rows) | (n[-1] - n < self.spec.leaf_rows)] = 0
            at = int(gain[:-1].argmax())
            if gain[at] > best:
                best, found = gain[at], (f, cuts[at])
        return found

    def margins(self, x: np.ndarray) -> np.ndarray:
        value = np.full(len(x), self.base)
        for splits, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for chosen in splits:
                feature, cut = np.array([c[0] for c in chosen]), np.array([c[1] for c in chosen])
                node = 2 * node + (x[np.arange(len(x)), feature[node]] >= cut[node])
            value += leaf[node]
        return value

    def calibrate(self, margins: np.ndarray, y: np.ndarray) -> None:
        """Pool neighbours until the shares of label 1 rise with the margin."""
        order = np.argsort(margins, kind="stable")
        groups: list[list[float]] = []  # sum, count, least margin
        for m, label in zip(margins[order], y[order]):
            groups.append([label, 1, m])
            while len(groups) > 1 and groups[-2][0] * groups[-1][1] >= groups[-1][0] * groups[-2][1]:
                s, n, _ = groups.pop()
                groups[-1][0] += s
                groups[-1][1] += n
        self.steps = np.array([g[2] for g in groups])
        self.levels = np.array([(g[0] + 0.5 * y.mean()) / (g[1] + 0.5) for g in groups])

    def scores(self, x: np.ndarray) -> np.ndarray:
        margin = self.margins(x)
        level = self.levels[np.maximum(np.searchsorted(self.steps, margin, side="right") - 1, 0)]
        # Within a step the order of the margins stays, in a thousandth of the scale.
        return np.clip(0.999 * level + 0.001 / (1 + np.exp(-margin)), 0.0, 1.0)


def _vectors(documents: DataFrame, features: Features, keep: list[str]) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(features)  # a lexicon of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in text_slices(batch.column("text")):
                rows = [r.tolist() for r in shared.value.of(data, bounds)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in keep), pa.array(rows, pa.list_(pa.float64()))], [*keep, "x"]
                )

    kinds = dict(documents.dtypes)
    return documents.select(*keep, "text").mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "x array<double>"]))


def fit(documents: DataFrame, labels: DataFrame, spec: Trees = Trees()) -> Model:
    """A model for the labels (doc_id, toxic) of ``documents``.

    At most ``train_rows`` labelled documents are used, the ones of least hash, and each once. Without any, every score is 0.
    """
    small_batches(documents.sparkSession)
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic"))
        .where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(spec.train_rows)
    )
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    train = written(own.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]))  # at most train_rows ids
    words = train.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")).where("length(word) > 2")
    total = train.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    model = Model(Features({}, spec), spec)
    if not total.n:
        return model
    toxic, clean = float(total.t or 0), float(total.n - (total.t or 0))
    a, b = F.col("a"), F.col("n") - F.col("a")
    odds = F.log((a + 0.5) / (F.lit(toxic) - a + 0.5)) - F.log((b + 0.5) / (F.lit(clean) - b + 0.5))
    z = odds / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    lexicon = (
        words.groupBy("word").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).where(a >= spec.least_documents)
        .select("word", odds.alias("weight"), z.alias("z")).where(F.col("z") >= spec.least_z)
        .orderBy(F.desc("z"), "word").limit(spec.lexicon).toPandas()
    )
    model = Model(Features(dict(zip(lexicon.word, lexicon.weight)), spec), spec)
    rows = _vectors(train, model.features, ["doc_id", "toxic"]).toPandas().sort_values("doc_id")
    x, y = np.stack(rows.x.to_numpy()), rows.toxic.to_numpy()
    held = np.arange(len(y)) % spec.calibration == 0
    if held.all() or y[~held].min() == y[~held].max():
        model.levels = np.array([y.mean()])
        return model
    model.train(x[~held], y[~held])
    model.calibrate(model.margins(x[held]), y[held])
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5 on) of every whole text.

    A null text counts as empty, and an empty one is scored like any other. Repeated rows are scored each. Other columns
    are not looked at.
    """
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # trees and a lexicon of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for lo, hi, data, bounds in text_slices(batch.column("text")):
                scores = own.scores(own.features.of(data, bounds))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(lo, hi - lo), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)),
                ], ["doc_id", "score", "predicted"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def without_toxic(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of ``documents`` that are not predicted toxic, with all their columns."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            keep = [own.scores(own.features.of(data, bounds)) < 0.5 for _, _, data, bounds in text_slices(batch.column("text"))]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *keep])))

    return documents.mapInArrow(run, documents.schema)
