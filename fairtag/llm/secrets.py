"""Secret scans by a battery of randomness tests.

Known forms (assignments, access keys, long hex strings) are found by their patterns. Every other run of 20 or more key
characters is a candidate. Its encoding is inferred from its characters, and three tests hold its symbols against uniform
random ones: chi-squared on the symbol counts, the number of runs above and below the middle, and the serial correlation. A
candidate must pass the battery, and it must also look more random than text does: its likelihood as random symbols is held
against that under the pairs of characters in the corpus's own words, and the ratios are taken up to the Benjamini-Hochberg
bound of each stratum of length. Tests are distinct tokens. The parts of a candidate between '=' and '/' are candidates too.

DataFrame functions only. Counts cover all documents; the tables of pairs and of strata are of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from fairtag.functions.once import computed_once
from fairtag.llm.tables import boxed, text_key, written

# The patterns of the known forms, their names in order, and the letters of the encodings.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
PLAIN = "^[A-Za-z]?[a-z]+$"
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


@dataclass(frozen=True)
class Battery:
    assign_length: int = 6
    battery_level: float = 0.001  # least p-value of the battery, corrected for its three tests
    false_discoveries: float = 0.01  # share of discoveries that may be text
    strata: tuple[int, ...] = (20, 24, 32, 48, 80)  # least lengths
    prior_weight: float = 32.0  # pairs that what is known of a character in general counts as
    noise: float = 0.05  # share of text whose characters are anything; bounds what one odd character of a word can say


def _spans(hits: Column, pieces: Column, kind: int) -> Column:
    """array<struct<start, kind, end, hit>> of the matches ``hits`` that lie between ``pieces``."""
    total = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda a, x: a + F.char_length(x))

    def span(hit: Column, i: Column) -> Column:
        start = total(pieces, i + 1) + total(hits, i)
        return F.struct(
            start.alias("start"), F.lit(kind).alias("kind"), (start + F.char_length(hit)).alias("end"), hit.alias("hit")
        )

    return F.transform(hits, span)


SPANS = "array<struct<start:int,kind:int,end:int,hit:string>>"


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(
        spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    ))


def _normal_cdf(z: Column) -> Column:
    """The normal distribution by its logistic approximation; monotone far out, where only the order counts."""
    return 1 / (1 + F.exp(-1.5976 * z - 0.07056 * z * z * z))


def battery(tokens: DataFrame) -> DataFrame:
    """Add encoding, size, z_chi, z_runs, z_serial and p_random to rows with a ``token``."""
    bare = F.regexp_replace("token", "=+$", "")
    encoding = (
        F.when(F.col("bare").rlike("^[0-9]+$"), "decimal").when(F.col("bare").rlike("^[0-9a-f]+$|^[0-9A-F]+$"), "hex")
        .when(F.col("bare").rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")
    )
    by_encoding = lambda make: F.coalesce(*[F.when(F.col("encoding") == name, make(a)) for name, a in ALPHABETS.items()])
    plain = F.when(F.col("encoding") == "hex", F.lower("bare")).otherwise(F.translate("bare", "-_", "+/"))
    values = F.filter(
        F.transform(F.split(F.col("plain"), ""), lambda c: F.instr(F.col("alphabet"), c) - 1), lambda v: v >= 0
    )
    v, n, m, mean = F.col("v"), F.col("n"), F.col("m"), F.col("mean")
    total = lambda array: F.aggregate(array, F.lit(0.0), lambda a, x: a + x)
    squares = total(F.transform(F.array_distinct(v), lambda d: F.pow(F.size(F.filter(v, lambda x: x == d)).cast("double"), 2)))
    earlier, later = F.slice(v, 1, n - 1), F.slice(v, 2, n - 1)
    turns = total(F.zip_with(earlier, later, lambda a, b: F.when((2 * a < m) != (2 * b < m), 1.0).otherwise(0.0)))
    low = total(F.transform(v, lambda x: F.when(2 * x < m, 1.0).otherwise(0.0)))
    products = total(F.zip_with(earlier, later, lambda a, b: (a - mean) * (b - mean)))
    spread = total(F.transform(v, lambda x: (x - mean) * (x - mean)))
    # What a lambda reads is worked out once for each row, not for each element.
    keep = tokens.columns
    rows = computed_once(tokens, keep, bare=bare)
    rows = computed_once(rows, [*keep, "bare"], encoding=encoding)
    rows = computed_once(rows, [*keep, "encoding"], plain=plain, alphabet=by_encoding(lambda a: F.lit(a)))
    rows = computed_once(rows, [*keep, "encoding", "alphabet"], v=values)
    rows = computed_once(rows, [*keep, "encoding", "v"], n=F.size("v"), m=F.char_length("alphabet"))
    rows = computed_once(rows, [*keep, "encoding", "v", "n", "m"], mean=total(F.transform(v, lambda x: x.cast("double"))) / n)
    rows = computed_once(
        rows.where("n > 1"), [*keep, "encoding", "n", "m"], squares=squares, turns=turns, low=low, products=products, spread=spread
    )
    # Chi-squared of n symbols over m: mean m - 1, variance 2 (m - 1)(1 - 1/n).
    chi = (F.col("squares") * m / n - n - (m - 1)) / F.sqrt(2 * (m - 1) * (1 - 1 / n))
    high = n - F.col("low")
    expected = 1 + 2 * F.col("low") * high / n
    variance = (expected - 1) * (expected - 2) / (n - 1)
    runs = F.when(variance > 0, (F.col("turns") + 1 - expected) / F.sqrt(variance)).otherwise(F.lit(99.0))
    serial = F.when(F.col("spread") > 0, (F.col("products") / F.col("spread") + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
    rows = rows.withColumns({"z_chi": chi, "z_runs": runs, "z_serial": serial})
    least = F.least(
        1 - _normal_cdf(F.col("z_chi")), 2 * (1 - _normal_cdf(F.abs("z_runs"))), 2 * (1 - _normal_cdf(F.abs("z_serial")))
    )
    return rows.withColumn("p_random", F.least(F.lit(1.0), 3 * least)).drop("squares", "turns", "low", "products", "spread")


#: Steps of log10 E that discoveries are counted in.
STEPS = 20
#: What is known of text before any is read: the shares of lower case, upper case, digits and other key characters.
PRIOR = (("abcdefghijklmnopqrstuvwxyz", 0.9), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.05), ("0123456789", 0.04), ("+/_=-", 0.01))


def text_model(texts: DataFrame, spec: Battery) -> DataFrame:
    """(symbol, next, cost): -log of the probability of ``next`` after ``symbol`` in words, for every pair of key characters.

    Counted over the distinct words of all ``texts``. Runs as long as a candidate count only if they are plain words, so that keys
    are not taken for text. The pairs of 67 characters are a table of fixed size.
    """
    words = (
        texts.select(F.explode(F.split("text", "[^A-Za-z0-9+/_=-]+")).alias("word"))
        .where((F.char_length("word") > 1) & ((F.char_length("word") < 20) | F.col("word").rlike(PLAIN))).distinct()
    )
    pairs = words.select(_pairs(F.col("word")).alias("pair")).groupBy("pair.symbol", "pair.next").agg(F.count("*").alias("n"))
    letters = texts.sparkSession.createDataFrame([(c, share / len(chars)) for chars, share in PRIOR for c in chars], "next string, prior double")
    grid = letters.select(F.col("next").alias("symbol")).crossJoin(letters).join(pairs, ["symbol", "next"], "left").fillna(0, "n")
    row, column, whole = Window.partitionBy("symbol"), Window.partitionBy("next"), Window.partitionBy(F.lit(0))
    w = F.lit(spec.prior_weight)
    single = (F.sum("n").over(column) + w * F.col("prior")) / (F.sum("n").over(whole) + w)
    after = (F.col("n") + w * F.col("single")) / (F.col("row") + w)
    return (
        grid.withColumns({"single": single, "row": F.sum("n").over(row)})
        .select("symbol", "next", (-F.log((1 - spec.noise) * after + spec.noise / 64)).alias("cost"))
    )


def _pairs(word: Column) -> Column:
    """One row for each two neighbouring characters."""
    at = F.sequence(F.lit(1), F.char_length(word) - 1)
    return F.explode(F.transform(at, lambda i: F.struct(F.substr(word, i, F.lit(1)).alias("symbol"), F.substr(word, i + 1, F.lit(1)).alias("next"))))


def discoveries(tokens: DataFrame, texts: DataFrame, spec: Battery = Battery()) -> DataFrame:
    """The distinct ``token`` of ``tokens`` that pass the battery and are more random than text.

    E is the likelihood of the token as random symbols over that as text. Its mean over text is at most 1, whatever the lengths and
    however the tokens depend on each other, so 1 / E serves as the p-value of the bound (e-BH). The encoding is the best of four,
    which E is divided by.
    """
    tested = written(battery(tokens.select("token").distinct()).where(F.col("p_random").isNotNull()))
    stratum = F.lit(0)
    for i, least in enumerate(spec.strata):
        stratum = F.when(F.char_length("token") >= least, i).otherwise(stratum)
    # Capitals alone are read as the same word in lower case. Padding is no symbol; any other '=' ends a key.
    bare = F.regexp_replace("token", "=+$", "")
    read = F.when(bare == F.upper(bare), F.lower(bare)).otherwise(bare)
    costs = (
        tested.where(~F.contains(bare, F.lit("="))).select("token", "m", read.alias("read")).select("token", "m", _pairs(F.col("read")).alias("pair"))
        .select("token", "m", "pair.symbol", "pair.next").join(F.broadcast(text_model(texts, spec)), ["symbol", "next"])
        .groupBy("token").agg(F.sum(F.col("cost") - F.log(F.col("m").cast("double"))).alias("log_e"))
    )
    log10 = (F.col("log_e") - F.log(F.lit(float(len(ALPHABETS))))) / F.log(F.lit(10.0))
    scored = written(
        tested.select("token", "p_random").withColumn("stratum", stratum).join(costs, "token", "left")
        .withColumn("step", F.coalesce(F.floor(STEPS * F.least(F.greatest(log10, F.lit(0.0)), F.lit(300.0))).cast("int"), F.lit(0)))
    )
    # What fails the battery is no discovery, but a test.
    counts = scored.groupBy("stratum", "step").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("p_random") >= spec.battery_level, 1)).alias("passed")
    )
    above = Window.partitionBy("stratum").orderBy(F.desc("step"))
    whole = Window.partitionBy("stratum")
    bounds = (
        counts.withColumn("found", F.sum("passed").over(above)).withColumn("tests", F.sum("n").over(whole))
        .where(F.pow(F.lit(10.0), -F.col("step") / STEPS) * F.col("tests") <= spec.false_discoveries * F.col("found"))
        .groupBy("stratum").agg(F.min("step").alias("bound"))
    )
    return scored.join(F.broadcast(bounds), "stratum").where(
        (F.col("step") >= F.col("bound")) & (F.col("p_random") >= spec.battery_level)
    ).select("token")


def _parts(span: Column) -> Column:
    """The span, and the parts of it between '=' and between '=' or '/' that are as long as a candidate."""
    def cut(at: str) -> Column:
        pieces = F.split(span["hit"], at, -1)
        begin = lambda i: F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda a, x: a + F.char_length(x) + 1)
        return F.filter(F.transform(pieces, lambda x, i: F.struct(
            (span["start"] + begin(i)).alias("start"), span["kind"].alias("kind"),
            (span["start"] + begin(i) + F.char_length(x)).alias("end"), x.alias("hit"),
        )), lambda s: F.char_length(s["hit"]) >= 20)

    # A '=' that others or nothing follow is padding of the part before it.
    return F.array_distinct(F.concat(F.array(span), cut("=(?=[^=])"), cut("=(?=[^=])|/")))


def _scanned(documents: DataFrame, spec: Battery) -> DataFrame:
    """find_secrets with the key (k1, k2) of the text."""
    key = ["k1", "k2"]
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).select("doc_id", *text_key(), "text")
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "candidates": CANDIDATE}
    nothing = F.array().cast("array<string>")
    hits = computed_once(rows, ["doc_id", *key, "text"], **{
        name: F.regexp_extract_all("text", F.lit(pattern), 0) for name, pattern in patterns.items()
    })
    parts = computed_once(
        hits, ["doc_id", *key, *patterns], secrets=F.when(F.size("assign") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), 2)),
        **{f"{name}_pieces": F.when(F.size(name) > 0, F.split("text", pattern, -1)).otherwise(nothing) for name, pattern in patterns.items()},
    )
    spans = computed_once(parts, ["doc_id", *key, "secrets"], **{
        name: _spans(F.col(name), F.col(f"{name}_pieces"), kind) for kind, name in enumerate(patterns)
    })
    assign = F.coalesce(F.filter(
        F.zip_with("assign", "secrets", lambda s, g: F.when(F.char_length(g) >= spec.assign_length, s)), lambda s: s.isNotNull()
    ), F.array().cast(SPANS))
    based = written(
        spans.withColumn("assign", assign).select(
            "doc_id", *key, *(F.size(c).cast("long").alias(f"n_{c}") for c in KINDS[:3]),
            F.array_sort(F.concat("assign", "access", "hex")).alias("base_spans"), "candidates",
        )
    )
    covered = lambda c: F.exists("base_spans", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    # A text that very many documents share is read once.
    tokens = written(based.select(
        *key, F.explode(F.filter("candidates", lambda c: ~covered(c))).alias("whole")
    ).distinct().select(*key, F.explode(_parts(F.col("whole"))).alias("span")).select(*key, "span", F.col("span.hit").alias("token")))
    # Written, so that the join below can split the rows of a text that very many documents share.
    inside = lambda s, all_: F.exists(all_, lambda o: (o["start"] <= s["start"]) & (s["end"] <= o["end"]) & (o["hit"] != s["hit"]))
    found = written(
        tokens.join(discoveries(tokens, rows, spec), "token").groupBy(*key).agg(F.collect_set("span").alias("all"))
        .select(*key, F.filter("all", lambda s: ~inside(s, F.col("all"))).alias("random"))
    )
    none = F.array().cast(SPANS)
    return based.join(found, key, "left").select(
        "doc_id", *key, "n_assign", "n_access", "n_hex", F.coalesce(F.size("random"), F.lit(0)).cast("long").alias("n_random"),
        "base_spans", F.array_sort(F.concat("base_spans", F.coalesce("random", none))).alias("all_spans"),
    )


def find_secrets(documents: DataFrame, spec: Battery = Battery()) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_random, base_spans, all_spans.

    The spans are arrays of (start, kind, end, hit), in code points with the end exclusive, by start and kind. A null or empty text has
    none. Repeated rows are scanned each; equal texts get equal spans. Other columns are not looked at.
    """
    return _scanned(documents, spec).drop("k1", "k2")


def redact(documents: DataFrame, mask: str = "[SECRET]", spec: Battery = Battery()) -> DataFrame:
    """``documents`` with every span of a secret replaced by ``mask``; spans that overlap are replaced as one.

    Texts without a secret, null texts and all other columns stay as they are, but that n_chars, where there is one, follows the text.
    """
    spans = written(
        _scanned(documents, spec).where(F.size("all_spans") > 0).groupBy("k1", "k2").agg(F.first("all_spans").alias("spans"))
    )
    k1, k2 = text_key()
    text, found = F.col("row.text"), F.col("spans").isNotNull()
    between = lambda a, b: F.substr(text, a + 1, b - a)
    cleaned = F.aggregate(
        "spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda done, s: F.struct(
            F.greatest(done["at"], s["end"]).alias("at"),
            F.when((s["start"] < done["at"]) & (done["at"] > 0), done["out"])
            .otherwise(F.concat(done["out"], between(done["at"], s["start"]), F.lit(mask))).alias("out"),
        ),
        lambda done: F.concat(done["out"], F.substr(text, done["at"] + 1)),
    )
    joined = boxed(documents, k1=k1, k2=k2).join(spans, ["k1", "k2"], "left")
    fresh = joined.select(F.col("row").withField("text", F.when(found, cleaned).otherwise(text)).alias("row"), found.alias("found"))
    if "n_chars" in documents.columns:
        length = F.when(F.col("found"), F.char_length("row.text").cast(documents.schema["n_chars"].dataType))
        fresh = fresh.select(F.col("row").withField("n_chars", F.coalesce(length, "row.n_chars")).alias("row"))
    return fresh.select("row.*")


def span_digests(found: DataFrame) -> DataFrame:
    """The spans as text and the digest of the known forms' spans."""
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"),
        _joined(F.col("all_spans")).alias("spans"),
    )
