"""Explicit schemas of the tables the operators exchange."""

from __future__ import annotations

SIGHTING = """
    site string, site_listing_id string, category string, url string, title string,
    description string, price_cents bigint, currency string, location string,
    seller_id string, seller_is_pro boolean, photo_count int, posted_at timestamp,
    raw string, batch_ts timestamp, batch_pos bigint
"""

PRODUCT = """
    category string, pos int, product_id string, label string, brand string,
    attributes map<string,double>, retail_fallback_eur double,
    `all` array<string>, any_of array<string>, none_of array<string>, aliases array<string>
"""

MODIFIER = """
    category string, pos int, modifier_id string, patterns array<string>,
    exclude boolean, price_adjust_pct double
"""

QUERY_TERM = "category string, pos int, term string"

CATEGORY = "category string, attributes array<string>, rank_by string"

RETAIL_PRICE = """
    category string, product_id string, source string, observed_on date,
    price_cents bigint, url string, in_stock boolean
"""

NORMALIZED = """
    listing_id string, category string, product_id string, match_kind string,
    match_score double, excluded_by string, modifiers array<string>, adjust_pct double,
    adjusted_cents bigint, normalized_title string, catalog_version string,
    updated_at timestamp
"""
