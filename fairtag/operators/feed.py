"""Deals as an RSS feed and unresolved titles as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairtag.functions.numeric import money, whole
from fairtag.operators.alerts import headline
from fairtag.operators.deals import top


def escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def cdata(html: Column) -> Column:
    """A literal end marker is split over two sections."""
    inner = F.replace(html, F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    return F.concat(F.lit("<![CDATA["), inner, F.lit("]]>"))


def description_html() -> Column:
    """Wording of the feed entry. Missing parts are left out."""
    label = escape(F.col("product_label"))
    return F.concat_ws(
        "",
        F.concat(F.lit("<p>"), escape(F.col("title")), F.lit("</p>")),
        F.concat(
            F.lit("<p><strong>"), money(F.col("price_eur")), F.lit("</strong> — "), label, F.lit(" ("),
            whole(F.col("score")), F.lit("/100)</p>"),
        ),
        F.concat(
            F.lit("<p>"), whole(F.col("below_median_pct")), F.lit("% below the "), money(F.col("median_eur")),
            F.lit(" median, saving about "), money(F.col("saving_eur")), F.lit(". n="),
            F.col("sample_size").cast("string"), F.lit(" comparable listings ("), F.col("confidence"),
            F.lit(" confidence).</p>"),
        ),
        F.when(
            F.col("retail_ratio") != 0,
            F.concat(
                F.lit("<p>"), whole(F.col("retail_ratio") * 100), F.lit("% of the "),
                money(F.col("retail_eur")), F.lit(" retail price.</p>"),
            ),
        ),
        F.when(
            F.col("location") != "",
            F.concat(
                F.lit("<p>"), escape(F.col("location")), F.lit(" · listed "), whole(F.col("days_listed")),
                F.lit(" days ago</p>"),
            ),
        ),
        F.when(
            F.size("reasons") > 0,
            F.concat(
                F.lit("<ul>"),
                F.array_join(
                    F.transform("reasons", lambda r: F.concat(F.lit("<li>"), escape(r), F.lit("</li>"))), ""
                ),
                F.lit("</ul>"),
            ),
        ),
        F.when(
            F.size("cautions") > 0,
            F.concat(
                F.lit("<p><strong>Caution:</strong> "), escape(F.array_join("cautions", "; ")), F.lit("</p>")
            ),
        ),
    )


def deal_feed(
    deals: DataFrame, guid_prefix: str = "deal", min_score: float = 45.0, limit: int = 40
) -> DataFrame:
    """Feed entries of the top deals; the price is part of the guid, so a cut shows up as new."""
    shown = top(deals.filter(F.col("score") >= min_score), limit)
    return shown.select(
        "listing_id", "score",
        escape(headline()).alias("title"),
        escape(F.col("url")).alias("link"),
        F.concat_ws(
            "-", F.lit(guid_prefix), F.col("listing_id").cast("string"),
            (F.col("price_eur") * 100).cast("bigint").cast("string"),
        ).alias("guid"),
        cdata(description_html()).alias("description"),
        escape(F.col("product_label")).alias("category"),
    )


def feed_document(entries: DataFrame, title: str, link: str, about: str) -> DataFrame:
    """The whole RSS 2.0 document as one row; entries are the top ``limit`` deals."""
    item = F.concat(
        F.lit("  <item>\n    <title>"), F.col("title"), F.lit("</title>\n    <link>"), F.col("link"),
        F.lit('</link>\n    <guid isPermaLink="false">'), F.col("guid"),
        F.lit("</guid>\n    <description>"), F.col("description"),
        F.lit("</description>\n    <category>"), F.col("category"), F.lit("</category>\n  </item>"),
    )
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0">\n<channel>\n  <title>'),
        escape(F.lit(title)), F.lit("</title>\n  <link>"), escape(F.lit(link)),
        F.lit("</link>\n  <description>"), escape(F.lit(about)), F.lit("</description>\n  <ttl>30</ttl>\n"),
    )
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("place"), "listing_id", item.alias("item"))))
    return entries.agg(ordered.alias("items")).select(
        F.concat(
            head, F.array_join(F.transform("items", lambda i: i["item"]), "\n"), F.lit("\n</channel>\n</rss>\n")
        ).alias("xml")
    )


def unresolved(queue: DataFrame, limit: int | None = 300) -> DataFrame:
    """Titles awaiting review, the most frequent first."""
    open_ = queue.filter(~F.col("resolved"))
    if limit is None:
        return open_
    return open_.orderBy(F.desc("occurrences"), F.desc("last_seen"), "title_hash").limit(limit)


def export_unmatched(queue: DataFrame, category: str, path: str, limit: int = 200) -> None:
    """CSV of the most frequent unresolved titles, header included."""
    rows = unresolved(queue.filter(F.col("category") == category), limit)
    (
        rows.select(F.col("sample_title").alias("title"), "occurrences", "first_seen", "last_seen")
        .coalesce(1)
        .write.mode("overwrite")
        .option("header", True)
        .csv(path)
    )
