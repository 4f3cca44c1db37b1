"""Title normalisation over the document texts, whole texts throughout."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check
from checks.tables import read
from fairtag.functions import text

# The same steps without lookarounds: a split never needs the letter the one before consumed.
NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(
  strip_accents(lower({0})), '[^a-z0-9]+', ' ', 'g'), '([a-z])([0-9])', '\1 \2', 'g'), '([0-9])([a-z])', '\1 \2', 'g')),
  '\b(\d{{1,2}})\s*(?:gb|go|gigas)\b', '\1gb', 'g'), '\b\d{{3,4}} p\b', ' ', 'g'), ' +', ' ', 'g'))"""
NOISE = ", ".join(f"'{w}'" for w in text.NOISE_WORDS)
# Texts as ad writers would garble them: capacities, resolutions and model numbers attached.
RAW = "text || ' RTX' || (doc_id % 9000) || 'Ti ' || (doc_id % 64) || ' GB, ' || (doc_id % 2000) || 'p usada'"


def raw_texts(spark, sf):
    return read(spark, sf, "documents").selectExpr(
        "doc_id", "text",
        "concat(text, ' RTX', doc_id % 9000, 'Ti ', doc_id % 64, ' GB, ', doc_id % 2000, 'p usada') AS raw",
    )


def normalized(spark, sf):
    return raw_texts(spark, sf).select("doc_id", text.normalize(F.col("raw")).alias("norm"))


NORM_SQL = f"WITH n AS (SELECT doc_id, {NORM.format(RAW)} AS norm FROM documents)"


@check("txt_1_strip_accents", "SELECT doc_id, strip_accents(text) AS plain FROM documents")
def txt_1(spark, sf):
    return raw_texts(spark, sf).select("doc_id", text.strip_accents(F.col("text")).alias("plain"))


@check("txt_2_normalize", f"{NORM_SQL} SELECT * FROM n")
def txt_2(spark, sf):
    return normalized(spark, sf)


@check(
    "txt_3_denoise",
    f"""{NORM_SQL} SELECT doc_id, array_to_string(list_filter(string_split(norm, ' '), lambda x: x NOT IN ({NOISE})), ' ') AS denoised FROM n""",
)
def txt_3(spark, sf):
    return normalized(spark, sf).select("doc_id", text.denoise(F.col("norm")).alias("denoised"))


@check(
    "txt_4_token_set",
    f"{NORM_SQL} SELECT DISTINCT doc_id, unnest(string_split(norm, ' ')) AS token FROM n",
)
def txt_4(spark, sf):
    return normalized(spark, sf).select("doc_id", F.explode(text.tokens(F.col("norm"))).alias("token"))


# Single words and phrases alike.
NEEDLES = ["the", "de la", "rtx 12", "ti", "Usada", "is-and", "!"]
WANTED = [("the", "the"), ("de la", "de la"), ("rtx 12", "rtx 12"), ("ti", "ti"), ("Usada", "usada"), ("is-and", "is and")]


@check(
    "txt_5_token_predicate",
    f"{NORM_SQL} SELECT doc_id, "
    + ", ".join(rf"regexp_matches(norm, '\b{n}\b') AS has_{i}" for i, (_, n) in enumerate(WANTED))
    + ", false AS has_6 FROM n",
)
def txt_5(spark, sf):
    padded = text.padded(F.col("norm"))
    return normalized(spark, sf).select(
        "doc_id",
        *[text.has_token(padded, text.normalize(F.lit(n))).alias(f"has_{i}") for i, n in enumerate(NEEDLES)],
    )


@check("txt_6_title_hash", f"{NORM_SQL} SELECT doc_id, left(sha1(norm), 16) AS title_hash FROM n")
def txt_6(spark, sf):
    return normalized(spark, sf).select("doc_id", text.title_hash(F.col("norm")).alias("title_hash"))
