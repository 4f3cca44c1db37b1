"""Alert de-duplication and message payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairtag.functions.numbering import numbered
from fairtag.functions.numeric import money, whole
from fairtag.params import Params

ALERT_KEY = ["listing_id", "alert_cents"]


def with_alert_key(deals: DataFrame) -> DataFrame:
    return deals.withColumn("alert_cents", F.rint(F.col("price_eur") * 100).cast("bigint"))


def fresh_deals(deals: DataFrame, alerted: DataFrame, min_score: float | None = None, params: Params = Params()) -> DataFrame:
    """Good deals never alerted at this price; a price change makes a listing fresh again."""
    floor = params.alert_min_score if min_score is None else min_score
    good = with_alert_key(deals).filter(F.col("score") >= floor)
    return good.join(alerted.select(*ALERT_KEY).distinct(), ALERT_KEY, "left_anti")


def record_alerts(alerted: DataFrame, fresh: DataFrame) -> DataFrame:
    """The alert log with the keys of ``fresh`` added, which are not in it (see ``fresh_deals``)."""
    new = with_alert_key(fresh).select(*ALERT_KEY, "score").dropDuplicates(ALERT_KEY)
    return alerted.select(*ALERT_KEY, "score").unionByName(new)


def push_new_deals(
    deals: DataFrame, alerted: DataFrame, channels: list[str], params: Params = Params()
) -> tuple[DataFrame, DataFrame]:
    """(fresh deals to deliver, alert log after it). Without a channel nothing is fresh or logged."""
    if not channels:
        return with_alert_key(deals).limit(0), alerted
    fresh = fresh_deals(deals, alerted, params=params)
    return fresh, record_alerts(alerted, fresh)


# Message texts. Wording, size limits and colours.

MAX_TITLE, MAX_DESCRIPTION, MAX_FIELDS = 256, 4000, 25
COLOR_HOT, COLOR_WARM, COLOR_PLAIN = 0x0CA30C, 0xFAB219, 0x2A78D6


def headline() -> Column:
    return F.concat(
        money(F.col("price_eur")), F.lit(" · "), F.col("product_label"), F.lit(" · "),
        whole(F.col("score")), F.lit("/100"),
    )


def _like_for_like(before: str, after: str) -> Column:
    differs = F.abs(F.col("adjusted_eur") - F.col("price_eur")) > 5
    shown = F.concat(F.lit(before), money(F.col("adjusted_eur")), F.lit(after))
    return F.when(differs, shown).otherwise("")


def _flags() -> Column:
    return F.transform("modifiers", lambda m: F.replace(m, F.lit("_"), F.lit(" ")))


def _if_any(items: str, text: Column) -> Column:
    return F.when(F.size(items) > 0, text)


def _has_retail() -> Column:
    return F.coalesce(F.col("retail_ratio") != 0, F.lit(False))


def _has_location() -> Column:
    return F.coalesce(F.col("location") != "", F.lit(False))


def plain_text() -> Column:
    """Several lines per deal; lines without content are left out."""
    retail = F.concat(
        whole(F.col("retail_ratio") * 100), F.lit("% of the "), money(F.col("retail_eur")), F.lit(" retail price")
    )
    return F.concat_ws(
        "\n",
        F.left("title", F.lit(110)),
        F.lit(""),
        F.concat(money(F.col("price_eur")), _like_for_like(" (≈", " like-for-like)")),
        F.concat(
            whole(F.col("below_median_pct")), F.lit("% below the "), money(F.col("median_eur")),
            F.lit(" median — saves about "), money(F.col("saving_eur")),
        ),
        F.concat(
            F.lit("n="), F.col("sample_size").cast("string"), F.lit(" comparable listings ("),
            F.col("confidence"), F.lit(" confidence)"),
        ),
        F.when(_has_retail(), retail),
        _if_any("modifiers", F.concat(F.lit("Flags: "), F.array_join(_flags(), ", "))),
        F.when(
            _has_location(),
            F.concat(F.col("location"), F.lit(" · listed "), whole(F.col("days_listed")), F.lit("d ago")),
        ),
        _if_any("reasons", F.concat(F.lit("\n· "), F.array_join("reasons", "\n· "))),
        _if_any("cautions", F.concat(F.lit("\nCaution: "), F.array_join("cautions", "; "))),
    )


def format_deals(deals: DataFrame) -> DataFrame:
    return deals.select("listing_id", "score", headline().alias("headline"), plain_text().alias("body"))


def _field(name: str, value: Column, shown: Column | None = None) -> Column:
    field = F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(True).alias("inline"))
    return field if shown is None else F.when(shown, field)


def embed(sent_at: Column) -> Column:
    """One rich message entry per deal."""
    fields = F.array_compact(F.array(
        _field("Price", F.concat(F.lit("**"), money(F.col("price_eur")), F.lit("**"), _like_for_like("\n≈", " like-for-like"))),
        _field("vs median", F.concat(
            F.lit("−"), whole(F.col("below_median_pct")), F.lit("% ("), money(F.col("median_eur")),
            F.lit(")\nsaves ≈"), money(F.col("saving_eur")),
        )),
        _field("Market", F.concat(
            F.lit("n="), F.col("sample_size").cast("string"), F.lit("\n"), F.col("confidence"), F.lit(" confidence"),
        )),
        _field("vs retail", F.concat(
            whole(F.col("retail_ratio") * 100), F.lit("% of "), money(F.col("retail_eur")),
        ), _has_retail()),
        _field("Where", F.col("location"), _has_location()),
        _field("Listed", F.concat(whole(F.col("days_listed")), F.lit(" days ago"))),
    ))
    description = F.concat_ws(
        "",
        F.left("title", F.lit(240)),
        _if_any("reasons", F.concat(F.lit("\n\n"), F.array_join("reasons", " · "))),
        _if_any("cautions", F.concat(F.lit("\n\n⚠️ **Caution:** "), F.array_join("cautions", "; "))),
        _if_any("modifiers", F.concat(F.lit("\n`"), F.array_join(_flags(), "` `"), F.lit("`"))),
    )
    color = (
        F.when(F.col("score") >= 65, COLOR_HOT).when(F.col("score") >= 45, COLOR_WARM).otherwise(COLOR_PLAIN)
    )
    return F.struct(
        F.left(headline(), F.lit(MAX_TITLE)).alias("title"),
        "url",
        F.left(description, F.lit(MAX_DESCRIPTION)).alias("description"),
        color.alias("color"),
        F.slice(fields, 1, MAX_FIELDS).alias("fields"),
        F.struct(
            F.concat(F.col("site"), F.lit(" · score "), whole(F.col("score")), F.lit("/100")).alias("text")
        ).alias("footer"),
        F.date_format(sent_at, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"),
    )


def alert_batches(deals: DataFrame, sent_at: Column, sender: str, params: Params = Params()) -> DataFrame:
    """JSON messages of up to ten deals, best first; the first one says how many there are.

    Every deal is sent; a caller who wants the best few limits the deals.
    """
    placed = numbered(
        deals.select("listing_id", "score", embed(sent_at).alias("embed")), F.desc("score"), F.asc("listing_id")
    )
    summary = F.concat(
        F.lit("**"), F.first("total").cast("string"), F.lit(" new deal"),
        F.when(F.first("total") == 1, "").otherwise("s"), F.lit("**"),
    )
    batch = F.floor(F.col("place") / params.alert_batch).alias("batch")
    return (
        placed.groupBy(batch)
        .agg(
            F.count(F.lit(1)).alias("n_deals"),
            summary.alias("summary"),
            F.sort_array(F.collect_list(F.struct("place", "embed"))).alias("placed"),
        )
        .select(
            "batch", "n_deals",
            F.to_json(F.struct(
                F.lit(sender).alias("username"),
                F.when(F.col("batch") == 0, F.col("summary")).alias("content"),
                F.transform("placed", lambda p: p["embed"]).alias("embeds"),
                F.struct(F.array().cast("array<string>").alias("parse")).alias("allowed_mentions"),
            )).alias("payload"),
        )
    )
