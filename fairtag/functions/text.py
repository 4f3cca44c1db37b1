"""Title normalisation and token predicates as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Filler words that never identify a product.
NOISE_WORDS = """
placa grafica graficas gpu geforce nvidia amd radeon intel arc vga usada usado usadas
seminova seminovo excelente estado oportunidade envio gratis portes incluidos urgente
barata barato top gaming oc edition ed vendo venda como nova novo
""".split()

# Capacity spellings folded to "NNgb", and screen resolutions as whole words.
CAPACITY = r"\b(\d{1,2})\s*(?:gb|go|gigas)\b"
RESOLUTION = r"(?:^| )\d{3,4} p(?= |$)"


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str, dict[str, str]]:
    """Every code point whose canonical decomposition loses marks, by rule.

    Returns the 1:1 part as two aligned strings and the rest as replacements.
    Hangul syllables decompose into letters, not marks, and are left whole.
    """
    source, target, longer = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if parts == char:
            continue
        base = "".join(p for p in parts if unicodedata.category(p) != "Mn")
        if len(base) == 1:
            source.append(char)
            target.append(base)
        elif base:
            longer[char] = base
    return "".join(source), "".join(target), longer


def strip_accents(text: Column) -> Column:
    source, target, longer = _fold_table()
    plain = F.translate(text, source, target)
    out = plain
    for char, base in longer.items():
        out = F.replace(out, F.lit(char), F.lit(base))
    # The characters that become several letters are rare; one look tells whether a text has any.
    rare = F.rlike(plain, F.lit(f"[{''.join(longer)}]"))
    return F.regexp_replace(F.when(rare, out).otherwise(plain), r"\p{Mn}+", "")


def _ascii_fold(text: Column) -> Column:
    """Accent folding limited to characters that end up as letters or digits.

    Everything else becomes a space one step later, so the short table is exact
    for titles and keeps the lookup small.
    """
    source, target, longer = _fold_table()
    kept = [(s, t) for s, t in zip(source, target) if t.isascii() and t.isalnum()]
    out = F.translate(text, "".join(s for s, _ in kept), "".join(t for _, t in kept))
    for char, base in longer.items():
        if any(c.isascii() and c.isalnum() for c in base):
            out = F.replace(out, F.lit(char), F.lit(base))
    return F.regexp_replace(out, r"\p{Mn}+", "")


def normalize(text: Column) -> Column:
    """Lower-case, de-accent, split letter|digit runs, unify capacities, drop resolutions."""
    given = F.coalesce(text, F.lit(""))
    low = F.lower(given)
    alnum = lambda out: F.regexp_replace(out, "[^a-z0-9]+", " ")
    # Texts of one byte a letter hold no accents, and only digits are split, capacities or resolutions.
    ascii_ = F.octet_length(given) == F.char_length(given)
    out = alnum(F.when(ascii_, low).otherwise(_ascii_fold(low)))
    out = F.regexp_replace(out, "(?<=[a-z])(?=[0-9])|(?<=[0-9])(?=[a-z])", " ")
    out = F.regexp_replace(F.trim(out), CAPACITY, "$1gb")
    full = F.trim(F.regexp_replace(out, RESOLUTION, ""))
    return F.when(ascii_ & ~F.rlike(given, F.lit("[0-9]")), F.trim(alnum(low))).otherwise(full)


def words(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def tokens(normalized: Column) -> Column:
    return F.array_distinct(words(normalized))


def denoise(normalized: Column) -> Column:
    noise = F.array(*[F.lit(w) for w in NOISE_WORDS])
    return F.array_join(
        F.filter(words(normalized), lambda t: ~F.array_contains(noise, t)), " "
    )


def padded(normalized: Column) -> Column:
    return F.concat(F.lit(" "), normalized, F.lit(" "))


def has_token(padded_text: Column, needle: Column) -> Column:
    """``needle`` is normalised; whole words only, phrases included, '' never matches."""
    return (needle != "") & F.contains(padded_text, padded(needle))


def has_all(padded_text: Column, needles: Column) -> Column:
    return F.forall(needles, lambda n: has_token(padded_text, n))


def has_any(padded_text: Column, needles: Column) -> Column:
    return F.exists(needles, lambda n: has_token(padded_text, n))


def rule_holds(padded_text: Column, all_: Column, any_of: Column, none_of: Column) -> Column:
    """A rule needs ``all`` or ``any_of``; an empty part asks for nothing."""
    return (
        (F.size(all_) + F.size(any_of) > 0)
        & has_all(padded_text, all_)
        & ((F.size(any_of) == 0) | has_any(padded_text, any_of))
        & ~has_any(padded_text, none_of)
    )


def title_hash(normalized: Column) -> Column:
    return F.left(F.sha1(normalized), F.lit(16))
