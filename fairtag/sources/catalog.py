"""Product catalogs as dimension tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairtag import schemas
from fairtag.functions.numeric import round_1dp
from fairtag.functions.text import normalize


@dataclass(frozen=True)
class Modifier:
    modifier_id: str
    patterns: tuple[str, ...]
    exclude: bool = False
    price_adjust_pct: float = 0.0


@dataclass(frozen=True)
class Catalog:
    """``products`` and ``query_terms`` stay DataFrames; the few modifiers are plan constants."""

    category: str
    products: DataFrame
    query_terms: DataFrame | None = None
    modifiers: list[Modifier] = field(default_factory=list)
    attributes: tuple[str, ...] = ()
    rank_by: str = ""
    version: str = ""


def _normalized_array(name: str) -> Column:
    return F.transform(
        F.coalesce(F.col(name), F.array().cast("array<string>")), lambda t: normalize(t)
    ).alias(name)


def with_defaults(products: DataFrame) -> DataFrame:
    """Missing fields filled and every rule word and alias normalised."""
    return products.select(
        "category", "pos", "product_id",
        F.coalesce("label", "product_id").alias("label"),
        F.coalesce("brand", F.lit("")).alias("brand"),
        F.coalesce("attributes", F.create_map().cast("map<string,double>")).alias("attributes"),
        F.coalesce("retail_fallback_eur", F.lit(0.0)).alias("retail_fallback_eur"),
        *[_normalized_array(name) for name in ("all", "any_of", "none_of", "aliases")],
    )


def read_modifiers(modifiers: DataFrame, category: str) -> list[Modifier]:
    """The modifiers of a category, which become expressions of the plan."""
    rows = modifiers.filter(F.col("category") == category).orderBy("pos").collect()
    return [
        Modifier(
            r["modifier_id"], tuple(r["patterns"] or ()), bool(r["exclude"]),
            float(r["price_adjust_pct"] or 0.0),
        )
        for r in rows
    ]


def content_version(*tables: DataFrame) -> DataFrame:
    """12-hex content version per category, independent of row order.

    The row hashes are summed in four lanes, so nothing is gathered and equal
    rows still count.
    """
    rows = [
        t.select(
            "category",
            F.sha2(
                F.concat(F.lit(str(i)), F.to_json(F.struct(*sorted(c for c in t.columns if c != "category")))), 256
            ).alias("row_hash"),
        )
        for i, t in enumerate(tables)
    ]
    every = reduce(DataFrame.unionByName, rows)
    lanes = [
        F.sum(F.conv(F.substring("row_hash", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string")
        for i in range(4)
    ]
    digest = F.concat_ws(":", *lanes, F.count(F.lit(1)).cast("string"))
    return every.groupBy("category").agg(F.left(F.sha2(digest, 256), F.lit(12)).alias("version"))


def read_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the good files, one error row per bad file); a bad line spoils its whole file only."""
    raw = (
        spark.read.text(path)
        .filter("trim(value) <> ''")
        .select(
            F.from_json(
                "value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}
            ).alias("row"),
            F.col("_metadata.file_path").alias("file"),
        )
        .select("row.*", "file")
    )
    errors = (
        raw.filter(F.col("_corrupt").isNotNull())
        .groupBy("file")
        .agg(F.min("_corrupt").alias("error"))
    )
    good = raw.join(errors.select("file"), "file", "left_anti").drop("file", "_corrupt")
    return good, errors


def load_all(spark: SparkSession, folder: str) -> tuple[dict[str, Catalog], DataFrame]:
    """(catalog of each category, errors of bad files) from the JSON tables of ``folder``.

    ``products``, ``modifiers`` and ``query_terms`` make the catalogs; ``categories`` names the attributes of a category and
    the one it is ranked by. Each table is read once for all categories; a table without a folder is empty.
    """
    tables, errors = {}, []
    for name, schema in (
        ("products", schemas.PRODUCT), ("modifiers", schemas.MODIFIER), ("query_terms", schemas.QUERY_TERM), ("categories", schemas.CATEGORY),
    ):
        try:
            tables[name], bad = read_json(spark, f"{folder}/{name}", schema)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            tables[name] = spark.createDataFrame([], schema)
        else:
            errors.append(bad.withColumn("table", F.lit(name)))
    versions = content_version(tables["products"], tables["modifiers"], tables["query_terms"]).collect()
    ranks = {r["category"]: r for r in tables["categories"].collect()}
    catalogs = {}
    for row in versions:
        category = row["category"]
        own = {name: t.filter(F.col("category") == category) for name, t in tables.items()}
        about = ranks.get(category)
        catalogs[category] = Catalog(
            category=category,
            products=with_defaults(own["products"]),
            query_terms=own["query_terms"],
            modifiers=read_modifiers(tables["modifiers"], category),
            attributes=tuple(about["attributes"] or ()) if about else (),
            rank_by=(about["rank_by"] or "") if about else "",
            version=row["version"],
        )
    none = spark.createDataFrame([], "file string, error string, `table` string")
    return catalogs, reduce(DataFrame.unionByName, errors, none)


def load(spark: SparkSession, folder: str, category: str) -> Catalog:
    """Catalog of one category; see ``load_all``."""
    catalogs, _ = load_all(spark, folder)
    if category not in catalogs:
        raise KeyError(f"no catalog for category {category!r}")
    return catalogs[category]


def build_products(
    specs: DataFrame, benchmark: DataFrame, msrp: DataFrame, families: DataFrame, category: str,
    anchor: str, common_none_of: list[str], retail_factor: float, perf_name: str = "perf_index",
) -> DataFrame:
    """Product rows from a specification list, a benchmark table and list prices.

    ``specs``: pos, product_id, label, brand, attributes, all, any_of, none_of, aliases.
    ``benchmark``: product_id, raw. ``msrp``: product_id, usd. ``families``:
    family_pos, family, prefix. The index is rescaled so that ``anchor`` is 100
    and stays absent where the benchmark has none; products of no family are dropped.
    """
    anchor_raw = benchmark.filter(F.col("product_id") == anchor).agg(F.max("raw")).scalar()
    scaled = (
        benchmark.filter("raw <> 0")
        .withColumn("scaled", F.col("raw") / anchor_raw * 100)
        .select("product_id", round_1dp(F.col("scaled")).alias("perf"))
    )
    # Every beginning of an id meets the families of that very prefix; ids are short.
    beginnings = F.transform(F.sequence(F.lit(1), F.length("product_id")), lambda n: F.left("product_id", n))
    grouped = (
        specs.withColumn("prefix", F.explode(beginnings)).join(families, "prefix")
        .groupBy("product_id")
        .agg(F.min(F.struct("family_pos", "family")).alias("home"))
    )
    perf = F.when(F.col("perf").isNotNull(), F.create_map(F.lit(perf_name), F.col("perf"))).otherwise(
        F.create_map().cast("map<string,double>")
    )
    return (
        specs.join(scaled, "product_id", "left")
        .join(msrp, "product_id", "left")
        .join(grouped, "product_id")
        .select(
            F.lit(category).alias("category"),
            F.struct("home.family_pos", "pos").alias("order"),
            "product_id", "label", "brand", F.col("home.family").alias("family"),
            F.map_concat(perf, "attributes").alias("attributes"),
            F.coalesce(F.rint(F.col("usd") * retail_factor / 10) * 10, F.lit(0.0)).alias("retail_fallback_eur"),
            "all", "any_of",
            F.concat("none_of", F.array(*[F.lit(w) for w in common_none_of])).alias("none_of"),
            "aliases",
        )
    )


# Vendor words a search term drops, and capacity suffixes.
VENDOR_PREFIX = r"(?i)^(geforce|radeon|arc|nvidia|amd|intel)\s+"
CAPACITY_SUFFIX = r"\s+\d{1,2}\s*gb$"


def search_terms(catalog: Catalog) -> DataFrame:
    """One term per product label plus the broad terms, ordered by ``pos``, without repeats."""
    short = F.regexp_replace(
        F.lower(F.trim(F.regexp_replace("label", VENDOR_PREFIX, ""))), CAPACITY_SUFFIX, ""
    )
    derived = (
        catalog.products.select(short.alias("term"), F.col("pos").cast("bigint").alias("pos"))
        .filter("term <> ''")
        .groupBy("term")
        .agg(F.min("pos").alias("pos"))
    )
    # A broad term repeats only if its lower-case form is listed already.
    key = F.lower("term")
    broad = catalog.query_terms.select("term", F.col("pos").cast("bigint").alias("pos"))
    lower_listed = derived.select(F.col("term").alias("listed"))
    added = broad.join(lower_listed, key == F.col("listed"), "left_anti")
    lower_first = added.filter(F.col("term") == key).groupBy("term").agg(F.min("pos").alias("seen_pos"))
    kept = (
        added.join(lower_first.select(F.col("term").alias("low"), "seen_pos"), F.lower("term") == F.col("low"), "left")
        .filter(F.col("seen_pos").isNull() | (F.col("pos") <= F.col("seen_pos")))
        .select("term", "pos")
    )
    offset = 1 << 32
    return derived.unionByName(kept.withColumn("pos", F.col("pos") + offset))


def numbered(df: DataFrame, partition: str, order: str) -> DataFrame:
    """``pos`` within a category; catalogs are configuration, one category fits one task."""
    return df.withColumn(
        "pos", F.row_number().over(Window.partitionBy(partition).orderBy(order)).cast("int") - 1
    )
