import pytest
from pyspark.sql import functions as F

from fairtag.functions import numeric, text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw,expected", [
    ("RTX4090Ti", "rtx 4090 ti"),
    ("Gráfica RX7800XT — 16 GO!", "grafica rx 7800 xt 16gb"),
    ("RTX 4070 (12 gigas)", "rtx 4070 12gb"),
    ("Monitor 1440p 144Hz", "monitor 144 hz"),
    ("GTX 1080 para 1080p", "gtx 1080 para"),
    ("Évora", "evora"),
    ("½ ª ß ø", ""),
    ("B580", "b 580"),
    ("", ""),
    (None, ""),
])
def test_normalize(spark, raw, expected):
    assert one(spark, text.normalize(F.lit(raw).cast("string"))) == expected


def test_denoise_keeps_order_and_repeats(spark):
    assert one(spark, text.denoise(F.lit("placa rtx 4070 rtx gaming oc"))) == "rtx 4070 rtx"


@pytest.mark.parametrize("norm,needle,found", [
    ("rtx 5070 ti", "70", False), ("rtx 5070 ti", "5070 ti", True), ("rtx 5070 tis", "5070 ti", False),
    ("rtx 5070", "", False), ("", "a", False),
])
def test_has_token(spark, norm, needle, found):
    assert one(spark, text.has_token(text.padded(F.lit(norm)), F.lit(needle))) is found


def test_round_1dp_matches_exact_rounding(spark):
    import random

    random.seed(3)
    values = [0.35, 0.25, 0.45, 2.5, 80.942857, -0.05, 0.05, 1e6 + 0.05, 0.0] + [
        random.randrange(0, 4000) / 20 for _ in range(400)
    ] + [random.uniform(0, 100) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", numeric.round_1dp(F.col("v")).alias("r"))
    assert [(r.v, r.r) for r in df.collect() if r.r != round(r.v, 1)] == []


def test_whole_and_money(spark):
    values = [0.5, 1.5, 2.5, 1234.5, -0.4]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", numeric.whole(F.col("v")).alias("w"), numeric.money(F.col("v")).alias("m")).collect()
    assert [(r.w, r.m) for r in got] == [(f"{v:.0f}", f"€{v:,.0f}") for v in values]
