"""The graphics-card catalog: source tables and the catalog built from them."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from fairtag.sources.catalog import (
    Catalog, Modifier, build_products, content_version, numbered, with_defaults,
)

CATEGORY = "gpu"
RANK_BY = "perf_index"
ATTRIBUTES = ("perf_index", "vram_gb", "tdp_w")
ANCHOR = "rtx_5070_ti"
RETAIL_FACTOR = 1.22

# The cards in catalog order. ``benchmark`` is the speed in percent of the fastest card, from a public
# benchmark table; ``msrp_usd`` the list price of the cards still sold new; null where there is none.
CARDS = Path(__file__).with_name("gpu_cards.jsonl")

# Families in catalog order, and words no desktop card carries.
FAMILIES = [
    ("RTX 50", "rtx_5"), ("RTX 40", "rtx_4"), ("RTX 30", "rtx_3"), ("RX 9000", "rx_9"), ("RX 7000", "rx_7"),
    ("RX 6000", "rx_6"), ("Arc", "arc_"), ("Older", "rtx_2"), ("Older", "gtx_"),
]
LAPTOP_WORDS = ["laptop", "portatil", "notebook"]

# Broad search terms.
QUERY_TERMS = [
    "rtx 5090", "rtx 5080", "rtx 5070", "rtx 5060", "rtx 4090", "rtx 4080", "rtx 4070", "rtx 4060", "rtx 3080",
    "rtx 3070", "rtx 3060", "rtx 2070", "rtx 2060", "gtx 1660", "gtx 1080", "radeon 9070", "radeon 9060",
    "radeon 7900", "radeon 7800", "rx 7600", "rx 6700", "rx 6600", "arc b580", "placa grafica",
]

# Patterns over the normalised text. Exclusions first, then price modifiers in percent.
MODIFIERS = [
    Modifier("wanted_ad", (
        r"^procuro\b", r"^compro\b", r"^pago\b", r"^wanted\b", r"^busco\b", r"^troco\b", r"^precisa[- ]se\b",
    ), exclude=True),
    Modifier("faulty", (
        "para pecas", "para peca", "avariad", "nao funciona", "nao liga", "com defeito", "defeituos",
        r"\bno funciona", "averiad", "sin funcionar", "(?<!sem )artefact", "so para pecas", "nao da imagem",
        "para reparar", "para arranjar",
    ), exclude=True),
    Modifier("whole_system", (
        "pc completo", "pc gaming completo", "setup completo", "torre completa", "computador completo",
        "equipo completo", "ordenador completo", "pc gamer completo",
    ), exclude=True),
    Modifier("mining_rig", (
        "rig de mineracao", "mining rig", "rig completo", r"lote de \d+", r"\d+ unidades", "varias placas",
    ), exclude=True),
    Modifier("accessory_only", (
        "^waterblock", "^bloco de agua", "^backplate", "^suporte", "apenas o cooler", "so o cooler",
        "apenas backplate", "suporte anti sag", "suporte para placa", "^cabo ", "^adaptador ",
    ), exclude=True),
    Modifier("warranty", (
        "(?<!sem )(?<!s )garantia", "(?<!sem )garantida", "warranty", r"\bc garantia", "ainda com gar",
        r"\bem garantia", "con garantia", "garantia ate",
    ), price_adjust_pct=-8.0),
    Modifier("invoice", (
        "(?<!sem )fatura", "(?<!sem )factura", "talao de compra", "nota de compra", "com recibo", "con factura",
    ), price_adjust_pct=-3.0),
    Modifier("sealed_new", (
        "selad", "novo por abrir", "nunca usad", "lacrad", "precintad", "a estrear", "sem uso", "novo na caixa",
    ), price_adjust_pct=-12.0),
    Modifier("boxed", (
        "(?<!sem )com caixa", "na caixa", "(?<!sem )caixa original", "con caja",
    ), price_adjust_pct=-2.0),
    Modifier("mined_on", (
        "(?<!nunca )usada para mineracao", "(?<!nunca )minou", "(?<!sem )(?<!nunca )mineracao", "(?<!nunca )mining",
        "undervolt 24 7",
    ), price_adjust_pct=10.0),
    Modifier("no_returns", (
        "sem trocas", "nao aceito trocas", "nao troco", "vendo como esta", "sem garantia", "nao aceito devolucoes",
    ), price_adjust_pct=5.0),
    Modifier("negotiable", (
        "negociavel", "aceito propostas", "melhor oferta", "negociable", "aberto a propostas",
    ), price_adjust_pct=-4.0),
]


def source_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(specifications, benchmark, list prices, families)."""
    cards = [json.loads(line) for line in CARDS.read_text().splitlines()]
    specs = spark.createDataFrame(
        [
            (
                c["pos"], c["product_id"], c["label"], c["brand"], {"vram_gb": c["vram_gb"], "tdp_w": c["tdp_w"]},
                c["all"], c["any_of"], c["none_of"], c["aliases"],
            )
            for c in cards
        ],
        "pos int, product_id string, label string, brand string, attributes map<string,double>, "
        "`all` array<string>, any_of array<string>, none_of array<string>, aliases array<string>",
    )
    known = lambda name: [(c["product_id"], float(c[name])) for c in cards if c[name] is not None]
    benchmark = spark.createDataFrame(known("benchmark"), "product_id string, raw double")
    msrp = spark.createDataFrame(known("msrp_usd"), "product_id string, usd double")
    families = spark.createDataFrame(
        [(i, name, prefix) for i, (name, prefix) in enumerate(FAMILIES)], "family_pos int, family string, prefix string"
    )
    return specs, benchmark, msrp, families


def gpu_catalog(spark: SparkSession) -> Catalog:
    specs, benchmark, msrp, families = source_tables(spark)
    built = build_products(specs, benchmark, msrp, families, CATEGORY, ANCHOR, LAPTOP_WORDS, RETAIL_FACTOR)
    products = with_defaults(numbered(built, "category", "order"))
    terms = spark.createDataFrame(
        [(CATEGORY, i, term) for i, term in enumerate(QUERY_TERMS)], "category string, pos int, term string"
    )
    modifiers = spark.createDataFrame(
        [(CATEGORY, i, m.modifier_id, list(m.patterns), m.exclude, m.price_adjust_pct) for i, m in enumerate(MODIFIERS)],
        "category string, pos int, modifier_id string, patterns array<string>, exclude boolean, price_adjust_pct double",
    )
    version = content_version(products, modifiers, terms).first()["version"]
    return Catalog(CATEGORY, products, terms, MODIFIERS, ATTRIBUTES, RANK_BY, version)
