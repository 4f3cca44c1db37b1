"""Rounding and number formatting with IEEE half-even behaviour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_cents(value: Column) -> Column:
    return F.rint(value).cast("bigint")


def round_1dp(value: Column) -> Column:
    """One decimal, nearest by the exact binary value, ties to even.

    ``bround`` rounds the printed decimal (0.35 gives 0.4 although the stored
    value is below 0.35). Only values next to a tie need care: 20*value is
    16*value + 4*value, both exact, and the rounding error of their sum is
    recovered exactly, which tells on which side of the tie the value lies.
    The lambda binds ``value`` once; pasted into every use it would outgrow the
    code generator.
    """

    def nearest(v: Column) -> Column:
        below = F.floor(v * 10).cast("double")
        big, small = v * 16, v * 4
        total = big + small
        shadow = total - big
        error = (big - (total - shadow)) + (small - shadow)
        side = (total - (below * 2 + 1)) + error
        even = F.when(below % 2 == 0, below).otherwise(below + 1)
        settled = F.when(side > 0, below + 1).when(side < 0, below).otherwise(even)
        return F.when(F.abs(v * 10 - below - 0.5) < 1e-6, settled).otherwise(F.rint(v * 10)) / 10

    return F.transform(F.array(value), nearest)[0]


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def whole(value: Column) -> Column:
    """Half-even whole number without separators, "-0" for small negatives."""
    return F.replace(F.format_number(F.rint(value), 0), F.lit(","), F.lit(""))


def money(value: Column) -> Column:
    return F.concat(F.lit("€"), F.format_number(F.rint(value), 0))
