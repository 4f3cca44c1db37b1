"""Intermediate tables, and filters that keep rows out of a shuffle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fairtag.session import scratch

# Size of a membership filter. It is the bound of what is sent to the executors: 1 MiB. With more keys than it can
# tell apart it lets more rows through, and the join behind it still decides.
FILTER_BITS = 1 << 23


#: Rows and bytes of a batch that a Python worker holds; whole texts are wide.
BATCH_ROWS = 500
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Keep the batches of whole texts that are sent to Python workers small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the cluster's shared folder, so what follows neither repeats it nor loses it."""
    path = f"{scratch(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def boxed(documents: DataFrame, **columns: Column) -> DataFrame:
    """The rows of ``documents`` as a struct ``row`` beside work columns, so that no name of theirs meets another."""
    return documents.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in columns.items()])


def text_key(text: str = "text") -> list[Column]:
    """96 bits that stand for a text; every user checks the text or its words again."""
    return [F.xxhash64(text).alias("k1"), F.hash(text).alias("k2")]


def member_filter(keys: DataFrame, key: str = "k1") -> Callable[[Column], Column]:
    """A filter of fixed size which passes every value of ``keys[key]`` and few others."""
    slot = F.pmod(F.col(key), F.lit(FILTER_BITS))
    rows = (
        keys.select(slot.alias("slot"))
        .groupBy(F.expr("slot div 64").alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
        .toPandas()
    )
    words = np.zeros(FILTER_BITS // 64, np.uint64)
    words[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    shared = keys.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def passes(values: pd.Series) -> pd.Series:
        at = np.mod(values.to_numpy(np.int64), FILTER_BITS)
        return pd.Series((shared.value[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) > 0)

    return lambda value: passes(value)


def distinct_texts(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """(k1, k2, text) of the documents whose key is in ``keys``, each text once."""
    passes = member_filter(keys)
    return (
        documents.select(*text_key(), "text").where(F.col("text").isNotNull()).where(passes(F.col("k1")))
        .groupBy("k1", "k2").agg(F.first("text").alias("text"))
        .join(keys.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi")
    )
