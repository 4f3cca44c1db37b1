"""Classified-ad payloads (JSON) parsed into sightings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairtag.functions.once import computed_once
from fairtag.params import Params

# Prices of one currency unit or less stand for free and swap-only ads.
MIN_PRICE_CENTS = 100
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def field(offer: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(offer, f"$.{path}", kind)


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def number(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(_NUMBER)), F.trim(text).try_cast("double"))


def price_param(offer: Column) -> tuple[Column, Column]:
    """(cents, currency) of the first ``price`` parameter."""
    prices = F.filter(field(offer, "params", "array<variant>"), lambda p: field(p, "key") == "price")
    value = field(F.try_element_at(prices, F.lit(1)), "value", "variant")
    amount = number(field(value, "value"))
    currency = F.nullif(field(value, "currency"), F.lit(""))
    cents = F.rint(amount * 100).cast("bigint")
    return F.when(cents > MIN_PRICE_CENTS, cents), F.coalesce(currency, F.lit("EUR"))


def moment(text: Column) -> Column:
    """A time in ISO or one of the common free spellings; a bare time of day names no day and is null."""
    # The name of the weekday says nothing that the date does not.
    plain = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},?\s+(?=\d)", "")
    spellings = [
        "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "d MMM yyyy",
        "d/M/yyyy HH:mm:ss", "d/M/yyyy HH:mm", "d/M/yyyy", "d.M.yyyy HH:mm", "d.M.yyyy", "d-M-yyyy HH:mm", "d-M-yyyy",
    ]
    found = F.coalesce(plain.try_cast("timestamp"), *[F.try_to_timestamp(plain, F.lit(s)) for s in spellings])
    return F.when(F.rlike(plain, F.lit(r"\d{4}")), found)


def posted_at(offer: Column) -> Column:
    """First of creation, refresh and expiry time that parses."""
    names = ("created_time", "last_refresh_time", "valid_to_time")
    return F.coalesce(*[moment(field(offer, n)) for n in names])


def location_label(offer: Column) -> Column:
    parts = [F.nullif(field(offer, f"location.{level}.name"), F.lit("")) for level in ("city", "region")]
    return F.nullif(F.concat_ws(", ", *parts), F.lit(""))


def parse_offers(payloads: DataFrame, site: str, url_prefix: str, params: Params = Params()) -> DataFrame:
    """Sightings from rows (payload, category, batch_ts, batch_pos); ads without id or title drop out.

    A payload is parsed once; fields are read off it by their paths, those only that a query asks for.
    """
    offer = F.col("offer")
    listing = field(offer, "id")
    cents, currency = price_param(offer)
    described = stripped(field(offer, "description"))
    if params.description_chars is not None:
        described = F.left(described, F.lit(params.description_chars))
    yes = F.coalesce(field(offer, "user.is_business", "boolean"), F.lit(False)) | F.coalesce(field(offer, "business", "boolean"), F.lit(False))
    return (
        computed_once(payloads, ["payload", "category", "batch_ts", "batch_pos"], offer=F.try_parse_json("payload"))
        .filter(listing.isNotNull() & (stripped(field(offer, "title")) != ""))
        .select(
            F.lit(site).alias("site"),
            listing.alias("site_listing_id"),
            "category",
            F.coalesce(F.nullif(field(offer, "url"), F.lit("")), F.concat(F.lit(url_prefix), listing)).alias("url"),
            stripped(field(offer, "title")).alias("title"),
            described.alias("description"),
            cents.alias("price_cents"),
            currency.alias("currency"),
            location_label(offer).alias("location"),
            field(offer, "user.id").alias("seller_id"),
            yes.alias("seller_is_pro"),
            F.coalesce(F.size(field(offer, "photos", "array<variant>")), F.lit(0)).alias("photo_count"),
            posted_at(offer).alias("posted_at"),
            F.col("payload").alias("raw"),
            "batch_ts",
            "batch_pos",
        )
    )
