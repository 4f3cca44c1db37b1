"""Language ID by a byte convolutional network.

Filters of several widths run over the bytes of fixed-length windows; each filter's greatest response in a window goes into a
softmax layer. The network is trained in numpy on labelled text and applied to all windows of a text, whose probabilities are
averaged in the log domain. A filter reads one table entry for each byte, so the first layer is a sum of table look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fairtag.llm.tables import small_batches
from fairtag.llm.words import text_slices


@dataclass(frozen=True)
class Network:
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 8  # of each width
    window: int = 256  # bytes
    train_rows: int = 6000  # labelled documents it is fitted on, by the hash of their id
    train_windows: int = 3  # windows taken from each of them, evenly spread over the text
    epochs: int = 6
    batch: int = 64
    rate: float = 0.02
    seed: int = 8


class ByteCnn:
    def __init__(self, languages: list[str], spec: Network):
        rng = np.random.default_rng(spec.seed)
        self.languages, self.spec = languages, spec
        # taps[j] holds the weights of byte j of every filter that is wider than j; the widest filters come last.
        self.widths = np.repeat(sorted(spec.widths), spec.filters)
        self.taps = [
            rng.normal(0, 0.3, (256, int((self.widths > j).sum()))).astype(np.float32) for j in range(max(spec.widths))
        ]
        self.output = np.zeros((len(self.widths), len(languages)), np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def responses(self, windows: np.ndarray) -> np.ndarray:
        """[windows, positions, filters] of byte windows."""
        total = len(self.widths)
        out = self.taps[0][windows]
        for j, tap in enumerate(self.taps[1:], 1):
            out[:, :-j, total - tap.shape[1]:] += tap[windows[:, j:]]
            out[:, -j:, total - tap.shape[1]:] = -np.inf  # the filter does not fit there
        return out

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        return _log_softmax(self.responses(windows).max(axis=1) @ self.output + self.bias)

    def train(self, windows: np.ndarray, labels: np.ndarray) -> ByteCnn:
        """Adam on the cross entropy; the gradient of a filter reaches only the bytes of its greatest response."""
        spec, rng = self.spec, np.random.default_rng(self.spec.seed + 1)
        parameters = [*self.taps, self.output, self.bias]
        first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
        total, steps = len(self.widths), 0
        for _ in range(spec.epochs):
            order = rng.permutation(len(windows))
            for lo in range(0, len(order), spec.batch):
                rows = order[lo:lo + spec.batch]
                x, n = windows[rows], len(rows)
                responses = self.responses(x)
                at = responses.argmax(axis=1)
                pooled = np.take_along_axis(responses, at[:, None], axis=1)[:, 0]
                error = np.exp(_log_softmax(pooled @ self.output + self.bias))
                error[np.arange(n), labels[rows]] -= 1
                error /= n
                back = error @ self.output.T
                gradients = []
                for j, tap in enumerate(self.taps):
                    own = np.arange(total - tap.shape[1], total)
                    gradient = np.zeros_like(tap)
                    bytes_ = np.take_along_axis(x, at[:, own] + j, axis=1)
                    np.add.at(gradient, (bytes_, np.broadcast_to(own - own[0], bytes_.shape)), back[:, own])
                    gradients.append(gradient)
                gradients += [pooled.T @ error, error.sum(axis=0)]
                steps += 1
                for p, g, m, v in zip(parameters, gradients, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= spec.rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-6)
        return self


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def windows_of(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, the last of each filled up with zero bytes, and the window bounds of the texts."""
    counts = -(-np.diff(bounds) // size)
    edges = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros((edges[-1], size), np.uint8)
    for i in range(len(counts)):
        text = data[bounds[i]:bounds[i + 1]]
        out[edges[i]:edges[i + 1]].reshape(-1)[:len(text)] = text
    return out, edges


def _training_windows(spec: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in text_slices(batch.column("text")):
                windows, edges = windows_of(data, bounds, spec.window)
                picks = [
                    windows[np.unique(np.linspace(edges[i], edges[i + 1] - 1, spec.train_windows).astype(int))].tobytes()
                    for i in range(hi - lo)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "lang")), pa.array(picks, pa.binary())],
                    ["doc_id", "lang", "windows"],
                )

    return run


def fit(labelled: DataFrame, spec: Network = Network()) -> ByteCnn | None:
    """A network for (doc_id, text, lang) rows; None if no row has an id, a text and a language.

    It learns from at most ``train_rows`` documents, the ones of least hash and each once, and ``train_windows`` windows of each;
    only these windows are gathered.
    """
    small_batches(labelled.sparkSession)
    usable = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(
        "doc_id is not null and lang is not null and length(text) > 0"
    )
    chosen = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(spec.train_rows)
    rows = (
        usable.join(F.broadcast(chosen), "doc_id")  # at most train_rows ids
        .mapInArrow(_training_windows(spec), "doc_id long, lang string, windows binary")
        .groupBy("doc_id").agg(F.min(F.struct("lang", "windows")).alias("one")).select("doc_id", "one.*")
        .toPandas().sort_values("doc_id")
    )
    if not len(rows):
        return None
    languages = sorted(set(rows.lang))
    windows, labels = [], []
    for lang, own in zip(rows.lang, rows.windows):
        windows.append(np.frombuffer(own, np.uint8).reshape(-1, spec.window))
        labels += [languages.index(lang)] * len(windows[-1])
    return ByteCnn(languages, spec).train(np.concatenate(windows), np.array(labels))


def predict(documents: DataFrame, network: ByteCnn | None) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every whole text.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if there is no network. Repeated rows are
    predicted each. Other columns are not looked at.
    """
    small_batches(documents.sparkSession)
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
    )
    if network is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = documents.sparkSession.sparkContext.broadcast(network)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo, hi, data, bounds in text_slices(batch.column("text")):
                windows, edges = windows_of(data, bounds, model.spec.window)
                sums = np.zeros((len(windows) + 1, len(model.languages)))
                for at in range(0, len(windows), STEP):
                    sums[at + 1:at + STEP + 1] = model.log_probabilities(windows[at:at + STEP])
                sums = np.cumsum(sums, axis=0)
                counts = np.maximum(np.diff(edges), 1)[:, None]
                # A text's windows count alike; more than a few of them leave no doubt, so the sum is damped by its root.
                mean = np.exp(_log_softmax((sums[edges[1:]] - sums[edges[:-1]]) / np.sqrt(counts)))
                lettered = batch.column("lettered").slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool)
                best = mean.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(lo, hi - lo),
                    pa.array([model.languages[b] if ok else "und" for b, ok in zip(best, lettered)], pa.string()),
                    pa.array(np.where(lettered, mean[np.arange(len(best)), best], 0.0)),
                ], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


#: Windows that are worked on at once.
STEP = 64
