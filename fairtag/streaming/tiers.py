"""Tables that micro-batches add to and that merge themselves, so that their folders stay few.

Every micro-batch writes a folder of its own. Folders of a level are merged into one of the next level once there are ``fan`` of
them, so the live folders grow with the logarithm of the micro-batches. Which folders are live is a version of a manifest, one row
for each, written as one file: a reader sees the old version or the new one, never a merge half done. Folders that two versions no
longer name are removed.

The merge must be associative and commutative, and one stream writes; a retried micro-batch replaces what its first try wrote.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairtag.session import exists, remove

MANIFEST = "version bigint, level int, first bigint, last bigint"


@dataclass(frozen=True)
class Tiers:
    """``merge`` combines the rows of several folders into rows of the same columns."""

    path: str
    merge: Callable[[DataFrame], DataFrame]
    fan: int = 4

    def folder(self, level: int, first: int, last: int) -> str:
        return f"{self.path}/level={level}/batches={first}-{last}"

    def _versions(self, spark: SparkSession) -> dict[int, list[tuple[int, int, int]]]:
        """The folders of each version that is still kept; a few dozen rows, whatever the table's size."""
        where = f"{self.path}/manifest"
        versions: dict[int, list[tuple[int, int, int]]] = {}
        if exists(spark, where):
            for row in spark.read.schema(MANIFEST).parquet(where).collect():
                versions.setdefault(row.version, []).append((row.level, row.first, row.last))
        return versions

    def live(self, spark: SparkSession) -> list[str]:
        """Folders of the newest version."""
        versions = self._versions(spark)
        return [self.folder(*f) for f in sorted(versions[max(versions)])] if versions else []

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows of all live folders merged."""
        return self.merge(spark.read.parquet(*self.live(spark)))

    def add(self, rows: DataFrame, batch: int) -> None:
        """Write ``rows`` as the folder of micro-batch ``batch``, merge what is due, and make the new version the live one."""
        spark = rows.sparkSession
        versions = self._versions(spark)
        newest = max(versions, default=-1)
        live = versions.get(newest, [])
        if any(first <= batch <= last for _, first, last in live):
            return  # this try comes after one that was finished
        rows.write.mode("overwrite").parquet(self.folder(0, batch, batch))
        live, merged_away = [*live, (0, batch, batch)], []
        for level in range(64):
            due = sorted(f for f in live if f[0] == level)
            if len(due) < self.fan:
                continue
            merged = (level + 1, due[0][1], max(f[2] for f in due))
            together = self.merge(spark.read.parquet(*[self.folder(*f) for f in due]))
            together.write.mode("overwrite").parquet(self.folder(*merged))
            live, merged_away = [*(f for f in live if f not in due), merged], [*merged_away, *due]
        named = spark.createDataFrame([(newest + 1, *f) for f in live], MANIFEST)
        named.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={newest + 1}")
        kept = {*live, *versions.get(newest, [])}
        # No version named what was written and merged in this one call.
        remove(spark, *[self.folder(*f) for f in merged_away if f not in kept])
        for version, folders in versions.items():
            if version < newest:
                remove(spark, f"{self.path}/manifest/v={version}", *[self.folder(*f) for f in folders if f not in kept])

    def sink(self, transform: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function that adds ``transform`` of each micro-batch."""
        return lambda batch, number: self.add(transform(batch), number)


def summed(keys: list[str], counts: list[str]) -> Callable[[DataFrame], DataFrame]:
    """A merge that adds up ``counts`` and drops keys of which nothing is left."""
    def merge(rows: DataFrame) -> DataFrame:
        added = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])
        return added.filter(" OR ".join(f"{c} <> 0" for c in counts))

    return merge
