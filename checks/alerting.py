"""Alert de-duplication, messages and the deal feed over the part market."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check
from checks.markets import CAUTIONS_SQL, DEALS, REASONS_SQL, _w, scored
from checks.tables import classified, with_ctes
from fairtag.operators import alerts, feed

MIN_SCORE = 45.0


def sent_at():
    return F.lit("2001-01-01").cast("timestamp")


def alert_log(spark, sf):
    """Every third city was alerted at the current price, every fourth at another one."""
    facts = classified(spark, sf)
    return facts.filter("price_cents IS NOT NULL AND (seen_count = 3 OR seen_count = 4)").select(
        "listing_id", F.expr("IF(seen_count = 4, price_cents + 100, price_cents)").alias("alert_cents"), F.lit(50.0).alias("score")
    )


LOG_SQL = """
alerted AS (SELECT listing_id, CASE WHEN seen_count = 4 THEN price_cents + 100 ELSE price_cents END AS alert_cents FROM m
  WHERE price_cents IS NOT NULL AND seen_count IN (3, 4)),
gk AS (SELECT *, CAST(round_even(price_eur * 100, 0) AS BIGINT) AS alert_cents,
  CASE WHEN p50 > 0 THEN (p50 - adjusted_eur) / p50 * 100 ELSE 0e0 END AS below_median_pct, greatest(0e0, p50 - adjusted_eur) AS saving_eur FROM g),
fresh AS (SELECT * FROM gk WHERE score >= 45 AND (listing_id, alert_cents) NOT IN (SELECT (listing_id, alert_cents) FROM alerted))
"""
ALERTS = (*DEALS, LOG_SQL)


def fresh(spark, sf):
    return alerts.fresh_deals(scored(spark, sf), alert_log(spark, sf))


@check("alr_1_fresh_deals", with_ctes(*ALERTS, select=" SELECT listing_id, alert_cents, score FROM fresh"))
def alr_1(spark, sf):
    return fresh(spark, sf).select("listing_id", "alert_cents", "score")


@check(
    "alr_2_record_alerts",
    with_ctes(*ALERTS, select=" SELECT listing_id, alert_cents, 50e0 AS score FROM alerted UNION ALL SELECT listing_id, alert_cents, score FROM fresh"),
)
def alr_2(spark, sf):
    _, log = alerts.push_new_deals(scored(spark, sf), alert_log(spark, sf), ["chat"])
    return log.select("listing_id", "alert_cents", "score")


TOP_SQL = "gt AS (SELECT * FROM gk ORDER BY score DESC, listing_id LIMIT 50)"


@check(
    "alr_3_cycle_alerts",
    with_ctes(*ALERTS, TOP_SQL, select="""
SELECT listing_id, score FROM gt WHERE score >= 45 AND (listing_id, alert_cents) NOT IN (SELECT (listing_id, alert_cents) FROM alerted)"""),
)
def alr_3(spark, sf):
    new, _ = alerts.push_new_deals(scored(spark, sf, limit=50), alert_log(spark, sf), ["chat"])
    return new.select("listing_id", "score")


def _money(x: str) -> str:
    return f"('€' || format('{{:,d}}', CAST(round_even({x}, 0) AS BIGINT)))"


def _esc(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


HEADLINE = f"{_money('price_eur')} || ' · ' || product_label || ' · ' || {_w('score')} || '/100'"
# Ends inside a string, for the callers to go on.
SUMMARY = f"{_w('below_median_pct')} || '% below the ' || {_money('p50')} || ' median"


@check(
    "snk_2_deal_feed",
    with_ctes(*ALERTS, select=f"""
, ft AS (SELECT *, {REASONS_SQL} AS rs, {CAUTIONS_SQL} AS cs FROM gk WHERE score >= 45 ORDER BY score DESC, listing_id LIMIT 40)
SELECT listing_id, {_esc(HEADLINE)} AS title, {_esc('url')} AS link, 'deal-' || listing_id || '-' || CAST(floor(price_eur * 100) AS BIGINT) AS guid,
  '<![CDATA[<p>' || {_esc('title')} || '</p><p><strong>' || {_money('price_eur')} || '</strong> — ' || {_esc('product_label')} || ' (' || {_w('score')} || '/100)</p><p>'
  || {SUMMARY}, saving about ' || {_money('saving_eur')} || '. n=' || n || ' comparable listings (' || confidence || ' confidence).</p>'
  || CASE WHEN retail_ratio <> 0 THEN '<p>' || {_w('retail_ratio * 100')} || '% of the ' || {_money('retail_eur')} || ' retail price.</p>' ELSE '' END
  || CASE WHEN location <> '' THEN '<p>' || {_esc('location')} || ' · listed ' || {_w('days_listed')} || ' days ago</p>' ELSE '' END
  || CASE WHEN len(rs) > 0 THEN '<ul><li>' || {_esc("array_to_string(rs, '@@')").replace('replace(replace(replace(replace(', 'replace(replace(replace(replace(replace(', 1)}, '@@', '</li><li>') || '</li></ul>' ELSE '' END
  || CASE WHEN len(cs) > 0 THEN '<p><strong>Caution:</strong> ' || {_esc("array_to_string(cs, '; ')")} || '</p>' ELSE '' END || ']]>' AS description,
  {_esc('product_label')} AS category FROM ft"""),
)
def snk_2(spark, sf):
    return feed.deal_feed(scored(spark, sf)).drop("score")


LIKE = f"CASE WHEN abs(adjusted_eur - price_eur) > 5 THEN ' (≈' || {_money('adjusted_eur')} || ' like-for-like)' ELSE '' END"


@check(
    "snk_4_plain_text_alerts",
    with_ctes(*ALERTS, select=f"""
, tx AS (SELECT *, {REASONS_SQL} AS rs, {CAUTIONS_SQL} AS cs FROM gk)
SELECT listing_id, {HEADLINE} AS headline, left(title, 110) || chr(10) || chr(10) || {_money('price_eur')} || {LIKE} || chr(10)
  || {SUMMARY} — saves about ' || {_money('saving_eur')} || chr(10) || 'n=' || n || ' comparable listings (' || confidence || ' confidence)'
  || CASE WHEN retail_ratio <> 0 THEN chr(10) || {_w('retail_ratio * 100')} || '% of the ' || {_money('retail_eur')} || ' retail price' ELSE '' END
  || CASE WHEN len(modifiers) > 0 THEN chr(10) || 'Flags: ' || replace(array_to_string(modifiers, ', '), '_', ' ') ELSE '' END
  || CASE WHEN location <> '' THEN chr(10) || location || ' · listed ' || {_w('days_listed')} || 'd ago' ELSE '' END
  || CASE WHEN len(rs) > 0 THEN chr(10) || chr(10) || '· ' || array_to_string(rs, chr(10) || '· ') ELSE '' END
  || CASE WHEN len(cs) > 0 THEN chr(10) || chr(10) || 'Caution: ' || array_to_string(cs, '; ') ELSE '' END AS body FROM tx"""),
)
def snk_4(spark, sf):
    return alerts.format_deals(scored(spark, sf)).drop("score")


@check(
    "snk_3_alert_batches",
    with_ctes(*ALERTS, select=f"""
, rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, listing_id) - 1 AS place, {REASONS_SQL} AS rs, {CAUTIONS_SQL} AS cs FROM fresh)
SELECT place // 10 AS batch, place, listing_id, {HEADLINE} AS title, CASE WHEN score >= 65 THEN 828172 WHEN score >= 45 THEN 16429593 ELSE 2783446 END AS color,
  left(left(title, 240) || CASE WHEN len(rs) > 0 THEN chr(10) || chr(10) || array_to_string(rs, ' · ') ELSE '' END
    || CASE WHEN len(cs) > 0 THEN chr(10) || chr(10) || '⚠️ **Caution:** ' || array_to_string(cs, '; ') ELSE '' END
    || CASE WHEN len(modifiers) > 0 THEN chr(10) || '`' || replace(array_to_string(modifiers, '` `'), '_', ' ') || '`' ELSE '' END, 4000) AS description,
  'Price=**' || {_money('price_eur')} || '**' || CASE WHEN abs(adjusted_eur - price_eur) > 5 THEN chr(10) || '≈' || {_money('adjusted_eur')} || ' like-for-like' ELSE '' END
    || '|vs median=−' || {_w('below_median_pct')} || '% (' || {_money('p50')} || ')' || chr(10) || 'saves ≈' || {_money('saving_eur')}
    || '|Market=n=' || n || chr(10) || confidence || ' confidence'
    || CASE WHEN retail_ratio <> 0 THEN '|vs retail=' || {_w('retail_ratio * 100')} || '% of ' || {_money('retail_eur')} ELSE '' END
    || CASE WHEN location <> '' THEN '|Where=' || location ELSE '' END || '|Listed=' || {_w('days_listed')} || ' days ago' AS fields,
  'market · score ' || {_w('score')} || '/100' AS footer,
  CASE WHEN place < 10 THEN '**' || (SELECT count(*) FROM rk) || ' new deals**' END AS content FROM rk"""),
)
def snk_3(spark, sf):
    batches = alerts.alert_batches(fresh(spark, sf), sent_at(), "alerts")
    message = F.from_json("payload", """
        content string, embeds array<struct<title:string, url:string, description:string, color:int, fields:array<struct<name:string, value:string>>, footer:struct<text:string>>>
    """).alias("m")
    return (
        batches.select("batch", message)
        .select("batch", "m.content", F.posexplode("m.embeds").alias("nth", "embed"))
        .select(
            "batch", (F.col("batch") * 10 + F.col("nth")).alias("place"),
            F.concat(F.lit("market/"), F.element_at(F.split("embed.url", "/"), -1)).alias("listing_id"),
            "embed.title", "embed.color", "embed.description", F.col("embed.footer.text").alias("footer"),
            F.array_join(F.transform("embed.fields", lambda f: F.concat(f["name"], F.lit("="), f["value"])), "|").alias("fields"), "content",
        )
    )
