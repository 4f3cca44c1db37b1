"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fairtag.llm.tables import written


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of ``edges`` (a, b): root is the least id that can be reached.

    Each round hooks the root of a node on the least root beside it and then shortens the chains of roots by joins, so the
    rounds grow with the logarithm of the longest chain. Only rows of changed size, never links, reach the driver.
    """
    ends = written(
        edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    )
    labels = ends.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    labels = written(labels)
    while True:
        near = ends.join(labels.select(F.col("id").alias("b"), F.col("root").alias("other")), "b")
        hooks = (
            near.join(labels.select(F.col("id").alias("a"), "root"), "a").where("other < root")
            .groupBy("root").agg(F.min("other").alias("onto"))
        )
        hooks = written(hooks)
        if hooks.isEmpty():
            return labels
        while True:
            further = hooks.select(F.col("root").alias("onto"), F.col("onto").alias("next"))
            longer = written(
                hooks.join(further, "onto", "left")
                .select("root", F.coalesce("next", "onto").alias("onto"), F.col("next").isNotNull().alias("moved"))
            )
            hooks = longer.select("root", "onto")
            if longer.where("moved").isEmpty():
                break
        labels = written(
            labels.join(hooks, "root", "left").select("id", F.coalesce("onto", "root").alias("root"))
        )
