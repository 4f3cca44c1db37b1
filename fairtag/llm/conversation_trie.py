"""Conversation prefix trie by splitters and a skeleton.

Conversations are paths of turns. Equal paths are counted once, sorted by range between sampled splitter paths, and every sorted
shard is walked with a stack. A node whose conversations lie in two shards is a prefix of the splitter between them: the trie of the
splitter paths (the skeleton) is broadcast, and shards finish every node outside it alone. For skeleton nodes they return partial
aggregates, which are reduced and then summed up the skeleton.

A node that holds more than about one shard's share of the paths has a splitter below it, so the nodes with very many children are
skeleton nodes, and a conversation that very many ids share is one path. A turn is known by 128 bits of its SHA-256; a conversation
travels as one row of about 20 bytes a turn, without texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fairtag.llm.tables import written

PATH = "array<struct<key:binary,chars:int>>"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
WALKED = f"node long, parent long, chars long, {NODE}"
EMPTY = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Splitters:
    """``shards`` x ``turns`` x 16 bytes bound the skeleton; ``shards`` 0 takes the number of shuffle partitions, 4,096 at most."""

    shards: int = 0
    turns: int = 256  # of a splitter path that are kept; any sequence splits, so results do not depend on it
    sample: int = 16  # paths sampled for each splitter
    ids: int = 4096  # conversation ids that one piece of an end list holds

    def count(self, df: DataFrame) -> int:
        return self.shards or min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4096)


def _turn_key() -> Column:
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), role, text), 256)


def rebuilt(conversations: DataFrame, century: int = 100, heads: int = 6) -> DataFrame:
    """(conv_id, path) of every conversation: the first h turns of conversation c - c % 100, then its own after its first h.

    h is crc32(c) % 6. Turns are ordered by ``turn``, null first, and by the SHA-256 of role and text where that ties. A null role or
    text is empty. Rows without conv_id belong to no conversation. Other columns are not looked at.
    """
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), _turn_key().alias("name"),
        F.coalesce(F.char_length(F.col("text").cast("string")), F.lit(0)).alias("chars"),
    )
    in_order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "name")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    turn = F.struct(F.unhex(F.substr("name", F.lit(1), F.lit(32))).alias("key"), F.col("chars").cast("int").alias("chars"))
    placed = written(turns.select(
        "conv_id", h.alias("h"), (F.row_number().over(in_order) - 1).alias("at"), turn.alias("turn")
    ))
    listed = lambda name: F.transform(F.array_sort(F.collect_list(F.struct("at", "turn"))), lambda x: x["turn"]).alias(name)
    own = placed.groupBy("conv_id").agg(
        F.first("h").alias("h"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("at") >= F.col("h"), F.struct("at", "turn")))), lambda x: x["turn"]).alias("own"),
    )
    first = placed.where((F.col("at") < heads - 1) & (F.col("conv_id") % century == 0)).groupBy(F.col("conv_id").alias("base")).agg(listed("head"))
    base = F.col("conv_id") - F.col("conv_id") % century
    return own.withColumn("base", base).join(first, "base", "left").select(
        "conv_id", F.concat(F.coalesce(F.slice("head", 1, F.col("h")), F.array().cast(PATH)), "own").cast(PATH).alias("path")
    )


def _end_digests(convs: DataFrame, spec: Splitters) -> DataFrame:
    """(path_key, ends_sha256): the digest of the ids of each path, ascending. Pieces of the list are joined before they meet."""
    pieces = convs.groupBy("path_key", F.floor(F.col("conv_id") / spec.ids).cast("long").alias("piece")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            keys, sums = [], []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key == at:
                    digest.update(b",")
                else:
                    if at is not None:
                        keys.append(at)
                        sums.append(digest.hexdigest())
                    at, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sums, pa.string())], ["path_key", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([digest.hexdigest()])], ["path_key", "ends_sha256"])

    in_order = pieces.repartition("path_key").sortWithinPartitions("path_key", "piece").select("path_key", "ids")
    return in_order.mapInArrow(run, "path_key binary, ends_sha256 string")


class Skeleton:
    """The trie of the splitter paths. Node 0 is the root; a child has a greater number than its parent."""

    def __init__(self, splitters: list[list[bytes]]):
        self.splitters = sorted(splitters)
        self.children: dict[tuple[int, bytes], int] = {}
        self.parents, self.depths = [-1], [0]
        for path in self.splitters:
            at = 0
            for key in path:
                child = self.children.get((at, key))
                if child is None:
                    child = self.children[at, key] = len(self.parents)
                    self.parents.append(at)
                    self.depths.append(self.depths[at] + 1)
                at = child

    def down(self, path: list[bytes]) -> list[int]:
        """The skeleton nodes on the path, from the root."""
        nodes = [0]
        for key in path:
            child = self.children.get((nodes[-1], key))
            if child is None:
                break
            nodes.append(child)
        return nodes


def _skeleton(paths: DataFrame, shards: int, spec: Splitters) -> Skeleton:
    """Splitters at even ranks of a sample of the paths, the ones of least hash."""
    keys = F.slice(F.transform("path", lambda t: t["key"]), 1, spec.turns).alias("keys")
    sample = paths.orderBy(F.xxhash64("path_key"), "path_key").limit(shards * spec.sample).select(keys)
    ranked = sample.withColumn("rank", F.row_number().over(Window.orderBy("keys")))  # of the bounded sample
    chosen = ranked.where(F.col("rank") % spec.sample == 0).select("keys").distinct().collect()
    return Skeleton([[bytes(k) for k in row["keys"]] for row in chosen])


def _walk(paths: DataFrame, skeleton: Skeleton) -> DataFrame:
    """Finished nodes outside the skeleton, and partial ones (``node`` not null) of the skeleton."""
    shared = paths.sparkSession.sparkContext.broadcast(skeleton)

    @F.arrow_udf("int")
    def shard_of(keys: pa.Array) -> pa.Array:
        import bisect

        return pa.array([bisect.bisect_right(shared.value.splitters, path) for path in keys.to_pylist()], pa.int32())

    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in WALKED.split(", ")])

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skeleton = shared.value
        partial: dict[int, list] = {}
        # Open nodes outside the skeleton, from the top: [key, chars, depth, conv_id, n_convs, leaves, saved, ends, finished children].
        stack: list[list] = []
        under, at_shard, out = 0, None, []

        def close(least_depth: int) -> None:
            while stack and stack[-1][2] >= least_depth:
                _, chars, depth, low, n, leaves, saved, ends, children = stack.pop()
                leaves, saved = leaves or 1, saved + (n - 1) * chars
                out.extend((None, None, None, c[0], c[1], low, *c[2:]) for c in children)
                row = (low, depth, n, len(children), leaves, saved, ends)
                if stack:
                    above = stack[-1]
                    above[5] += leaves
                    above[6] += saved
                    above[8].append(row)
                else:
                    above = partial[under]
                    above[2] += 1
                    above[3] += leaves
                    above[4] += saved
                    out.append((None, under, None, *row[:2], None, *row[2:]))

        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in range(5))
            for shard, path, low, n, ends in zip(*columns):
                if shard != at_shard:
                    close(0)
                    at_shard = shard
                keys = [t["key"] for t in path]
                nodes = skeleton.down(keys)
                inside = len(nodes) - 1
                if nodes[-1] != under:
                    close(0)
                common = inside
                for node in stack:
                    if common == len(keys) or node[0] != keys[common]:
                        break
                    common += 1
                close(common + 1)
                under = nodes[-1]
                for d, node in enumerate(nodes):
                    have = partial.get(node)
                    if have is None:
                        # n_convs, conv_id, children, leaves, saved, chars, ends
                        have = partial[node] = [0, low, 0, 0, 0, path[d - 1]["chars"] if d else 0, None]
                    have[0] += n
                    have[1] = min(have[1], low)
                for node in stack:
                    node[3] = min(node[3], low)
                    node[4] += n
                for d in range(common, len(keys)):
                    stack.append([keys[d], path[d]["chars"], d + 1, low, n, 0, 0, EMPTY, []])
                if len(keys) == inside:
                    partial[under][6] = ends
                else:
                    stack[-1][7] = ends
            yield as_batch(out)
            out.clear()
        close(0)
        out.extend(
            (node, None, chars, low, skeleton.depths[node], None, n, children, leaves, saved, ends)
            for node, (n, low, children, leaves, saved, chars, ends) in partial.items()
        )
        yield as_batch(out)

    placed = paths.withColumn("shard", shard_of(F.transform("path", lambda t: t["key"])))
    dealt = placed.repartitionById(len(skeleton.splitters) + 1, "shard").sortWithinPartitions("shard", "path")
    return dealt.select("shard", "path", "low", "n", "ends").mapInArrow(run, WALKED)


def _reduced(partial: DataFrame, skeleton: Skeleton) -> list[tuple]:
    """Rows (node, NODE) of the skeleton. There are no more of them than ``Splitters`` bounds, whatever the input."""
    rows = partial.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n"), F.sum("n_children").alias("children"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("chars").alias("chars"), F.max("ends_sha256").alias("ends"),
    ).collect()
    sums = {r["node"]: [r["n"], r["children"], r["leaves"], r["saved"]] for r in rows}
    by_node = {r["node"]: r for r in rows}
    out = []
    for node in sorted(by_node, reverse=True):
        r, (n, children, leaves, saved) = by_node[node], sums[node]
        leaves, saved = leaves or 1, saved + (n - 1) * r["chars"]
        parent = skeleton.parents[node]
        above = by_node[parent]["conv_id"] if node else None
        if node:
            for i, x in ((1, 1), (2, leaves), (3, saved)):
                sums[parent][i] += x
        out.append((node, r["conv_id"], skeleton.depths[node], above, n, children, leaves, saved, r["ends"] or EMPTY))
    return out


def prefix_trie(conversations: DataFrame, spec: Splitters = Splitters()) -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations (see ``rebuilt``): the columns of ``NODE``.

    A node is a distinct sequence of first turns, the root the empty one. Conversations without turns end at the root. Without any
    conversation there is no node. Repeated rows of a turn are turns of their own.
    """
    convs = written(rebuilt(conversations).withColumn("path_key", F.unhex(F.sha2(F.array_join(
        F.transform("path", lambda t: F.hex(t["key"])), ""), 256))))
    paths = convs.groupBy("path_key", "path").agg(F.min("conv_id").alias("low"), F.count("*").alias("n"))
    paths = written(paths.join(_end_digests(convs.select("path_key", "conv_id"), spec).withColumnRenamed("ends_sha256", "ends"), "path_key"))
    skeleton = _skeleton(paths, spec.count(convs), spec)
    walked = written(_walk(paths, skeleton))
    tops = _reduced(walked.where("node IS NOT NULL"), skeleton)
    spark = convs.sparkSession
    top = F.broadcast(spark.createDataFrame(tops, f"node long, {NODE}"))
    names = [c.split()[0] for c in NODE.split(", ")]
    rest = walked.where("node IS NULL").join(
        top.select(F.col("node").alias("parent"), F.col("conv_id").alias("above")), "parent", "left"
    )
    return top.select(names).unionByName(
        rest.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select(names)
    )
