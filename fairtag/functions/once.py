"""Expensive columns evaluated once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``keep`` and the new ``columns``, which later filters and projections only read.

    Filters on a projected expression are pushed below it and evaluate the
    expression a second time. They stop at a generator, so the values come out
    of a one-element array.
    """
    made = F.struct(*keep, *[c.alias(name) for name, c in columns.items()])
    return df.select(F.inline(F.array(made)))
