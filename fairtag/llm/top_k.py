"""Exact top-k by inner product with a pivot-distance index.

Every vector x gets one more component, sqrt(M**2 - |x|**2) with M the greatest length, and a query gets 0 there. The distances
then are |q|**2 + M**2 - 2 q.x, so the nearest vectors have the greatest products. A vector is keyed by its nearest pivot and,
within it, by the annulus of its distance from the pivot; the vectors of a key are packed into blocks.

A query first visits its nearest annuli, which gives a bound on its k-th distance. By the triangle inequality an annulus [a, b]
around p holds nothing nearer than max(a - d(q, p), d(q, p) - b), so only the annuli below the bound are expanded, and no
other one can change the answer. Scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fairtag.llm.tables import written


@dataclass(frozen=True)
class Pivots:
    k: int = 5
    pivots: int = 48
    sample: int = 4000  # vectors the pivots are chosen from, by the hash of their id
    rings: int = 8  # annuli of a pivot, of equal width up to its farthest vector
    block: int = 4096  # vectors of an annulus that are packed together
    pack: int = 1024  # queries that visit a block together
    probe: int = 2  # annuli a query visits for its bound


def _matrix(vectors, width: int) -> np.ndarray:
    """floor(256 x) of each vector, padded with zeros to ``width``."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = np.floor(256.0 * np.asarray(v, np.float64))
    return out


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Centres of the sample: far points first, then a few rounds of moving each to the mean of its vectors."""
    chosen = [0]
    nearest = np.full(len(sample), np.inf)
    for _ in range(min(count, len(sample)) - 1):
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(nearest.argmax()))
    centres = sample[chosen]
    for _ in range(6):
        own = distances(sample, centres).argmin(axis=1)
        centres = np.stack([sample[own == i].mean(axis=0) if (own == i).any() else centres[i] for i in range(len(centres))])
    return centres


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(squared, 0))


def _lift(x: np.ndarray, greatest: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(greatest**2 - (x**2).sum(axis=1), 0))[:, None]], axis=1)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while they are exact, else in 64-bit integers."""
    limit = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    return np.rint(q @ x.T).astype(np.int64) if limit < 2**52 else q.astype(np.int64) @ x.astype(np.int64).T


def top_k(queries: DataFrame, vectors: DataFrame, spec: Pivots = Pivots()) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` greatest integer products of each query, ties to the smaller vec_id.

    Both tables have vec_id and embedding (an array of numbers). A vector that is null, empty or holds a null or a component that is not
    finite takes no part, nor does a row without vec_id. A query does not meet rows of its own id. Shorter vectors count as padded
    with zeros. Repeated rows of an id are candidates each; a query id is answered once, from any of its rows. With no other
    row there is no result. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    usable = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where(
        "vec_id is not null and size(x) > 0 and not exists(x, v -> v is null or isnan(v) or abs(v) = double('infinity'))"
    )
    data, asked = usable(vectors), usable(queries).dropDuplicates(["vec_id"])
    squares = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.pow(F.floor(256.0 * v), 2))
    facts = data.agg(F.max(F.size("x")).alias("width"), F.max(squares).alias("most")).first()
    result = "query_id long, vec_id long, score long"
    if facts.width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(facts.width, asked.agg(F.max(F.size("x"))).first()[0] or 0)
    greatest = float(np.sqrt(facts.most)) * (1 + 1e-9) + 1
    packs_of = -(-asked.count() // spec.pack) or 1
    # Written first: collected straight away, every task would send its own ``sample`` rows to the driver.
    sample = written(data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(spec.sample)).orderBy(F.xxhash64("vec_id"), "vec_id").toPandas()
    pivots = choose_pivots(_lift(_matrix(sample.x, width), greatest), spec.pivots)

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = _matrix(batch.x, width)
            far = distances(_lift(values, greatest), pivots) if len(values) else np.zeros((0, len(pivots)))
            own = far.argmin(axis=1)
            yield pd.DataFrame({
                "vec_id": batch.vec_id, "pivot": own.astype(np.int32), "far": far[np.arange(len(own)), own],
                "values": [row.tobytes() for row in values.astype(np.int64)],
            })

    keyed = written(data.mapInPandas(key, "vec_id long, pivot int, far double, values binary"))
    # The annuli of a pivot, and which of them hold vectors: at most pivots * rings rows.
    reach = keyed.groupBy("pivot").agg(F.max("far").alias("reach"))
    ring = F.least(F.floor(F.col("far") / (F.col("reach") + 1e-9) * spec.rings), F.lit(spec.rings - 1)).cast("int")
    placed = keyed.join(F.broadcast(reach), "pivot").withColumn("ring", ring)
    annuli = placed.groupBy("pivot", "ring").agg(F.min("far").alias("a"), F.max("far").alias("b"), F.count("*").alias("n"))
    rings = annuli.toPandas().sort_values(["pivot", "ring"]).reset_index(drop=True)
    parts = np.maximum(1, -(-rings.n.to_numpy() // spec.block))
    ring_no, part_count = rings["pivot"].to_numpy() * spec.rings + rings.ring.to_numpy(), parts
    counts = spark.createDataFrame(pd.DataFrame({"at": ring_no.astype(np.int64), "parts": part_count.astype(np.int64)}), "at long, parts long")
    blocks = written(
        placed.withColumn("at", (F.col("pivot") * spec.rings + F.col("ring")).cast("long")).join(F.broadcast(counts), "at")
        .withColumn("part", F.pmod(F.xxhash64("vec_id", "values"), F.col("parts")))
        .groupBy("at", "part").agg(F.collect_list(F.struct("vec_id", "values")).alias("rows"))
    )

    def bounds_of(values: np.ndarray) -> np.ndarray:
        """Least distance that a vector of each annulus can have from each query."""
        lifted = np.concatenate([values, np.zeros((len(values), 1))], axis=1)
        d = distances(lifted, pivots)[:, rings["pivot"].to_numpy()]
        slack = 1e-6 * greatest  # rounding of the distances
        return np.maximum(np.maximum(rings.a.to_numpy() - d, d - rings.b.to_numpy()), 0) - slack

    def visit(first: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                values = _matrix(batch.x, width)
                least = bounds_of(values)
                if first:
                    order = np.argsort(least, axis=1, kind="stable")
                    use = np.zeros(least.shape, bool)
                    np.put_along_axis(use, order[:, :spec.probe], True, axis=1)
                else:
                    use = least <= batch.bound.to_numpy()[:, None]
                    use &= ~np.array([np.isin(ring_no, seen) for seen in batch.seen]).reshape(use.shape)
                q, a = np.nonzero(use)
                yield pd.DataFrame({
                    "query_id": batch.vec_id.to_numpy()[q], "at": ring_no[a].astype(np.int64),
                    "query": [v.tobytes() for v in values.astype(np.int64)[q]],
                })

        return run

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asks, rows in zip(batch.column("asks").to_pylist(), batch.column("rows").to_pylist()):
                ids = np.array([r["vec_id"] for r in rows])
                x = np.frombuffer(b"".join(r["values"] for r in rows), np.int64).reshape(len(ids), -1)
                names = np.array([a["query_id"] for a in asks])
                q = np.frombuffer(b"".join(a["query"] for a in asks), np.int64).reshape(len(names), -1)
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], x[order].astype(np.float64)
                out = []
                for lo in range(0, len(names), 256):
                    s = _scores(q[lo:lo + 256].astype(np.float64), x)
                    for i, row in enumerate(s):
                        others = np.flatnonzero(ids != names[lo + i])
                        best = others[np.argsort(-row[others], kind="stable")[:spec.k]]
                        out += [(names[lo + i], ids[j], row[j]) for j in best]
                columns = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in columns], ["query_id", "vec_id", "score"])

    def answers(visits: DataFrame) -> DataFrame:
        """The best of each visited block; queries come in packs, so a block meets each pack once."""
        packs = (
            visits.withColumn("pack", F.pmod(F.xxhash64("query_id"), F.lit(packs_of)))
            .groupBy("at", "pack").agg(F.collect_list(F.struct("query_id", "query")).alias("asks"))
        )
        # Merged: vectors and queries take little room in their files, but not in a driver that gathers them for a broadcast.
        found = packs.join(blocks.hint("merge"), "at").select("asks", "rows").mapInArrow(score, result)
        return best(found)

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= spec.k)

    visits = written(asked.mapInPandas(visit(True), "query_id long, at long, query binary"))
    first = written(answers(visits).select("query_id", "vec_id", "score"))
    norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.pow(F.floor(256.0 * v), 2))
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= spec.k, F.min("score")).alias("kth"))
    seen = visits.groupBy("query_id").agg(F.collect_list("at").alias("seen"))
    squared = F.col("norm") + F.lit(greatest**2) - 2 * F.col("kth")
    bounded = (
        asked.withColumn("norm", norm).withColumnRenamed("vec_id", "query_id").join(kth.hint("merge"), "query_id", "left").join(seen.hint("merge"), "query_id")
        .select(F.col("query_id").alias("vec_id"), "x", "seen",
                F.when(squared.isNull(), float("inf")).otherwise(F.sqrt(F.greatest(squared, F.lit(0.0)))).alias("bound"))
    )
    rest = answers(written(bounded.mapInPandas(visit(False), "query_id long, at long, query binary")))
    return best(first.union(rest.select("query_id", "vec_id", "score"))).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
