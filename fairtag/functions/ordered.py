"""First, last and running values of ordered rows without gathering one key in one task.

A plain window partitioned by key sorts the whole history of the busiest key in
a single task. Here rows are windowed inside (key, slot) and only one summary
row per slot travels to a second, much smaller window over the key, so the
busiest key spreads over as many tasks as it has slots.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairtag.session import cut_lineage

#: Keys are counted by so many buckets of their hash; the keys of a bucket of more rows are not gathered.
BUCKETS, GATHERED = 2**16, 1_000_000


def time_slot(ts: Column, minutes: int) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (minutes * 60_000_000))


def with_previous(df: DataFrame, keys: list[str], slot: str, order: list[str], into: str) -> DataFrame:
    """Add struct ``into`` holding the preceding row of the key, null on the first.

    Rows without key or slot have no place in an order and are left out. Both readers of the rows take the same
    columns, the row travelling as one struct, so that they share one shuffle.
    """
    inside = Window.partitionBy(*keys, slot).orderBy(*order)
    fields = [c for c in df.columns if c not in keys and c != slot]
    rows = df.filter(" AND ".join(f"{c} IS NOT NULL" for c in [*keys, slot])).select(
        *keys, slot, *order, F.struct(*fields).alias("_row")
    )
    carried = (
        rows.withColumn("_ends_slot", F.lead(F.lit(True)).over(inside).isNull())
        .filter("_ends_slot")
        .select(
            *keys,
            slot,
            F.lag("_row").over(Window.partitionBy(*keys).orderBy(slot)).alias("_carried"),
        )
    )
    return (
        rows.withColumn("_local", F.lag("_row").over(inside))
        .join(carried, [*keys, slot])
        .select(*keys, slot, "_row.*", F.coalesce("_local", "_carried").alias(into))
    )


def _key(keys: list[str]) -> Column:
    """The keys as one value, which meets its like where some of them are null."""
    return F.struct(*keys).alias("_key")


def packed(ts: Column, pos: Column) -> Column:
    """One number that orders like (``ts``, ``pos``), ``pos`` from 0; a row without a time comes first."""
    micros = F.coalesce(F.unix_micros(ts.cast("timestamp")), F.lit(-(2**62)))
    return micros.cast("decimal(19,0)") * F.lit(str(10**19)).cast("decimal(20,0)") + F.coalesce(pos, F.lit(0)).cast("decimal(19,0)")


def extremes(df: DataFrame, keys: list[str], picks: dict[str, tuple[str, Column, Column]], **totals: Column) -> DataFrame:
    """One row per key: ``totals``, and for each pick the struct of the row that is first (min) or last (max) in an order.

    ``picks`` holds (min or max, order, struct); rows whose order is null take no part. Orders are numbers, so the first pass
    over the keys is a hash aggregate that combines map-side; a join on what it found brings the texts of the few rows that won.
    Where several rows have the same order, the least (min) or greatest (max) struct is taken.
    """
    functions, ends = {"min": F.min, "max": F.max}, {"min": F.array_min, "max": F.array_max}
    best = df.groupBy(*keys).agg(
        *[c.alias(name) for name, c in totals.items()],
        *[functions[how](order).alias(f"_best_{name}") for name, (how, order, _) in picks.items()],
    ).select(_key(keys).alias("_of"), *[F.col(name).alias(f"_total_{name}") for name in totals], *[f"_best_{name}" for name in picks])
    # The rows travel without their orders, once: what the join has dealt by the key is grouped where it lies. A number leads the
    # key, as sorts compare structs field by field.
    won = {name: F.coalesce(order == F.col(f"_best_{name}"), F.lit(False)) for name, (_, order, _) in picks.items()}
    same = (F.xxhash64("_key") == F.xxhash64("_of")) & (F.col("_key") == F.col("_of"))
    rows = df.withColumn("_key", _key(keys)).join(best, same).filter(reduce(Column.__or__, won.values()))
    found = rows.groupBy(F.xxhash64("_key").alias("_hash"), "_key", *[f"_total_{name}" for name in totals]).agg(*[
        ends[how](F.collect_set(F.when(won[name], made))).alias(name) for name, (how, _, made) in picks.items()
    ])
    return found.select("_key.*", *[F.col(f"_total_{name}").alias(name) for name in totals], *picks)


def gathered_extremes(
    df: DataFrame, keys: list[str], picks: dict[str, tuple[str, Column, Column]], most: int = GATHERED, **totals: Column
) -> DataFrame:
    """``extremes`` with a single pick, for keys of mostly few rows: whole rows travel once, and meet in a window instead of a join.

    A window has the rows of a key in one task. So keys are counted before, by buckets of their hash, which combines map-side;
    those in a bucket of more than ``most`` rows go through ``extremes``.
    """
    (name, (how, order, made)), = picks.items()
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket")
    counted = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n"))
    # At most as many rows as there are buckets.
    many = F.broadcast(cut_lineage(counted.filter(F.col("_n") > most).select("_bucket")))
    dealt = df.withColumn("_bucket", bucket)
    few = dealt.join(many, "_bucket", "left_anti").select(
        "*", F.xxhash64(*keys).alias("_hash"), _key(keys), order.alias("_order"), made.alias("_made")
    )
    best = [F.asc_nulls_last("_order"), F.asc("_made")] if how == "min" else [F.desc("_order"), F.desc("_made")]
    ranked = Window.partitionBy("_hash", "_key").orderBy(*best)
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = few.select(
        "_key", "_order", "_made", F.row_number().over(ranked).alias("_nth"),
        *[c.over(whole).alias(f"_total_{total}") for total, c in totals.items()],
    ).filter("_nth = 1 AND _order IS NOT NULL")
    return found.select("_key.*", *[F.col(f"_total_{total}").alias(total) for total in totals], F.col("_made").alias(name)).unionByName(
        extremes(dealt.join(many, "_bucket", "left_semi"), keys, picks, **totals)
    )


def extreme_rows(df: DataFrame, keys: list[str], order: Column, ties: list[Column], how: str = "min") -> DataFrame:
    """The row of each key that is first (min) or last (max) in a number, the first by ``ties`` where that is equal.

    The number is found by a hash aggregate; only rows that have it are put in order, one of each key leaving a partition.
    """
    functions = {"min": F.min, "max": F.max}
    best = df.groupBy(*keys).agg(functions[how](order).alias("_best")).select(_key(keys), "_best")
    tied = df.withColumn("_key", _key(keys)).join(best, "_key").filter(order.eqNullSafe(F.col("_best")))
    nth = F.row_number().over(Window.partitionBy("_key").orderBy(*ties))
    return tied.withColumn("_nth", nth).filter("_nth = 1").select(df.columns)
