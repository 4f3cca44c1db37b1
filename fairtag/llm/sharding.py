"""Sharding by a hierarchical weighted hash tree.

Shards are the leaves of a tree of regions, racks and shards. Every row draws an exponential value at each shard, with the
shard's weight as its rate; the draw of a rack is the least of its shards' draws and that of a region the least of its
racks', which is again an exponential draw with the summed weight. A row descends by the least draw: to a region, in it to a
rack, in it to a shard. Since a subtree's draw changes only if something under it changes, a new or heavier shard takes rows
into its own subtree and moves none between the others, and a lighter one only gives rows away.

Only DataFrame functions are used, and only the key, the size and the checksum of a row are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Tree:
    """``shards`` leaves; ``racks`` shards stand in a rack and ``regions`` racks in a region, filled in order."""

    shards: int = 8
    racks: int = 2
    regions: int = 2
    weights: tuple[float, ...] | None = None

    def weight(self, shard: int) -> float:
        return 1.0 if self.weights is None else self.weights[shard]

    def nested(self) -> list[list[list[int]]]:
        racks = [list(range(i, min(i + self.racks, self.shards))) for i in range(0, self.shards, self.racks)]
        return [racks[i:i + self.regions] for i in range(0, len(racks), self.regions)]


def _least(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.least(*columns)


def _uniform(key: Column, shard: int) -> Column:
    """A number in (0, 1) that the row's key and the shard decide: 48 bits of a digest."""
    digits = F.substring(F.md5(F.concat_ws("/", key, F.lit(str(shard)))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(2.0**48)


def draw_columns(key: Column, tree: Tree) -> list[Column]:
    """The exponential draw of the row at each shard."""
    return [-F.log(_uniform(key, s)) / F.lit(tree.weight(s)) for s in range(tree.shards)]


def descend(draws: list[Column], tree: Tree) -> Column:
    """The shard that the draws lead to, level by level."""
    def choose(nodes: list[tuple[Column, Column]]) -> tuple[Column, Column]:
        """(draw, shard) of the node with the least draw; the earlier one of two that are equal."""
        best = _least([d for d, _ in nodes])
        shard = nodes[-1][1]
        for draw, leaf in reversed(nodes[:-1]):
            shard = F.when(draw == best, leaf).otherwise(shard)
        return best, shard

    regions = []
    for region in tree.nested():
        racks = [choose([(draws[s], F.lit(s)) for s in rack]) for rack in region]
        regions.append(choose(racks))
    return choose(regions)[1].cast("int")


#: Parts of a shard in which slots are numbered side by side; a part's rows fit a task.
PARTS = 4096


def shard(documents: DataFrame, tree: Tree = Tree(), parts: int = PARTS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('key'), shard, slot, grown_shard.

    size is the bytes of the text plus 1 (a null text has none; its checksum is that of the empty text). slot counts the rows of a
    shard from 0 without gaps. Rows of one doc_id go to one shard; rows without doc_id share the key ``null``. Other columns are
    not looked at.
    """
    text = F.coalesce("text", F.lit(""))
    id_ = F.col("doc_id").cast("long")
    key = F.coalesce(id_.cast("string"), F.lit("null"))
    rows = documents.select(
        id_.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        key.alias("key"),
    )
    # Draws are columns of their own, so each is worked out once.
    grown = Tree(tree.shards + 1, tree.racks, tree.regions, None if tree.weights is None else (*tree.weights, 1.0))
    drawn = rows.withColumns({f"d{i}": d for i, d in enumerate(draw_columns(F.col("key"), grown))})
    draws = [F.col(f"d{i}") for i in range(grown.shards)]
    placed = drawn.select(
        "doc_id", "size", "text_crc32", descend(draws[:-1], tree).alias("shard"), descend(draws, grown).alias("grown_shard"),
        F.expr(f"cast(conv(substring(md5(concat_ws('/', key, size, text_crc32)), 1, 12), 16, 10) as bigint) % {parts}").alias("part"),
    )
    # Slots are numbered within parts of a shard; a part starts where the parts before it end. There are shards * parts counts.
    counts = placed.groupBy("shard", "part").count()
    running = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("count").over(running), F.lit(0)).alias("start"))
    numbered = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")
    return (
        placed.withColumn("at", F.row_number().over(numbered) - 1)
        .join(F.broadcast(starts), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                (F.col("start") + F.col("at")).cast("long").alias("slot"), "grown_shard")
    )
