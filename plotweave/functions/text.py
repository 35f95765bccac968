"""String functions: folding, normalising, wildcards, ordered rules, names that carry parameters."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, functions as F


@functools.lru_cache(1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """All characters that compatibility decomposition without marks turns into one other character, those characters, and a map of those that it turns into several.

    Marks end the first string and have no partner in the second, so that ``translate`` drops them. Hangul syllables stay composed.
    """
    one, marks, several = {}, [], {}
    for c in map(chr, [*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, sys.maxunicode + 1)]):
        if unicodedata.combining(c):
            marks.append(c)
        elif (d := unicodedata.normalize("NFKD", c)) != c:
            d = "".join(x for x in d if not unicodedata.combining(x))
            if len(d) == 1:
                one[c] = d
            else:
                several[c] = d
    return "".join(one) + "".join(marks), "".join(one.values()), several


def _expand(col: Column) -> Column:
    """Ligatures, fractions and other characters that decompose to several; texts without any pass as they are."""
    several = _fold_tables()[2]
    pairs = F.create_map(*(F.lit(x) for kv in several.items() for x in kv))
    letter = lambda c: F.when(F.octet_length(c) == 1, c).otherwise(F.coalesce(F.element_at(pairs, c), c))
    return F.when(F.length(F.translate(col, "".join(several), "")) == F.length(col), col).otherwise(F.array_join(F.transform(F.split(col, ""), letter), ""))


def fold(col: Column) -> Column:
    """Upper case after compatibility decomposition without marks; all in the JVM. Plain ASCII is only put in upper case."""
    source, target, _ = _fold_tables()
    return F.upper(F.when(F.octet_length(col) == F.length(col), col).otherwise(F.translate(_expand(col), source, target)))


def normalise(col: Column) -> Column:
    """Folded, with every run of other characters than A-Z, 0-9 and ? as one space, trimmed. Null stays null."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(col), r"[^A-Z0-9? ]+", " "), r" +", " "))


def squeeze(col: Column) -> Column:
    """Without any separator."""
    return F.regexp_replace(col, r"[^A-Z0-9?]", "")


def wildcard_pattern(col: Column) -> Column:
    """A full-match pattern in which ``?`` stands for one character and everything else for itself."""
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(col, r"([\\.\[\]{}()*+^$|])", r"\\$1"), r"\?", "."), F.lit("$"))


def classify(col: Column, rules: Sequence[dict[str, str]], value: str) -> Column:
    """``value`` of the first rule whose pattern is found in ``col``; null where none is."""
    out = None
    for rule in rules:
        found = col.rlike(rule["pattern"])
        out = F.when(found, F.lit(rule[value])) if out is None else out.when(found, F.lit(rule[value]))
    return out


# The ordered rules for purposes, first match wins, and three nested definitions of parking.
RULES = (
    {"category": "missing", "subcategory": "unknown", "confidence": "high", "pattern": "^$"},
    {"category": "parking", "subcategory": "parking_space", "confidence": "high", "pattern": "ESTACIONAMENTO"},
    {"category": "parking", "subcategory": "garage_building", "confidence": "medium", "pattern": "GARAGEM"},
    {"category": "special", "subcategory": "residual_area", "confidence": "low", "pattern": "AREA A VISTORIAR|SOBRA DE AREA"},
    {"category": "special", "subcategory": "projected_plot", "confidence": "low", "pattern": "AREA PROJETADA DE GLEBA"},
    {"category": "special", "subcategory": "vacant_land", "confidence": "high", "pattern": "^TERRENO|^GLEBA"},
    {"category": "special", "subcategory": "special_property", "confidence": "medium", "pattern": "^IMOVEL ESPECIAL"},
    {"category": "commercial", "subcategory": "hospitality", "confidence": "low", "pattern": "HOTEL"},
    {"category": "residential", "subcategory": "apartment", "confidence": "high", "pattern": "^APARTAMENTO"},
    {"category": "residential", "subcategory": "house", "confidence": "high", "pattern": "^RESIDENCIA"},
    {"category": "commercial", "subcategory": "retail", "confidence": "high", "pattern": "^LOJA"},
    {"category": "commercial", "subcategory": "office", "confidence": "high", "pattern": "^SALA"},
    {"category": "commercial", "subcategory": "commercial_unit", "confidence": "high", "pattern": "UNIDADE .*COMERCIO"},
    {"category": "commercial", "subcategory": "fuel_station", "confidence": "high", "pattern": "POSTO DE COMBUSTIVEL"},
    {"category": "commercial", "subcategory": "industrial", "confidence": "medium", "pattern": "INDUSTRIAL|ARMAZEM|DEP.SITO|DEPOSITO"},
)
PARKING = {"narrow": r"^ESPACO (?:DE )?ESTACIONAMENTO|^ESPACO ESTACIONAMENTO", "standard": r"ESTACIONAMENTO|GARAGEM", "broad": r"ESTACIONAMENTO|GARAGEM|\bBOX\b|\bVAGA\b"}


def parking_flag(col: Column, definition: str = "standard", patterns: dict[str, str] = PARKING) -> Column:
    if definition not in patterns:
        raise ValueError(f"unknown parking definition: {definition}")
    return col.rlike(patterns[definition])


def truthy(col: Column) -> Column:
    """Text that means yes; anything else, null included, is no."""
    return F.coalesce(F.lower(F.trim(col)).isin("1", "true", "t", "yes", "y"), F.lit(False))


def decimal_comma(col: Column) -> Column:
    return col.rlike(r"^\s*-?[0-9.]*,[0-9]+\s*$")


# Fixed value: stem, metres, gamma, beta and offset in a measure's name.
MEASURE_NAME = r"^(c[ad])(\d+)g(\d+)b(\d+)k(\d+)$"


def encode_measure(stem: Column, radius: Column, gamma: Column, beta: Column, offset: Column) -> Column:
    return F.concat(stem, radius.cast("string"), F.lit("g"), gamma.cast("string"), F.lit("b"), beta.cast("string"), F.lit("k"), offset.cast("string"))


def decode_measure(name: Column) -> Column:
    """A struct of the five parts; null for a name of another form."""
    part = lambda i: F.regexp_extract(name, MEASURE_NAME, i)
    return F.when(name.rlike(MEASURE_NAME), F.struct(part(1).alias("stem"), *(part(i).cast("long").alias(n) for i, n in enumerate(("radius", "gamma", "beta", "offset"), 2))))


# Fixed value: a kind, a radius or g for none, one of eight measures and a digit in the name of a network plugin's column.
PLUGIN_NAME = r"^[TG](g|[0-9]{1,5})(Acc|Btw|Cen|Opp|Cvg|Pol|Rea|Cnc)[0-9]$"


def plugin_column(name: Column) -> Column:
    """Whether a network plugin's recipe could have given this name; false for null."""
    return F.coalesce(name.rlike(PLUGIN_NAME), F.lit(False))


def before_last(col: Column, mark: str) -> Column:
    """What stands before the last mark, as a split from the right gives it."""
    return F.regexp_extract(col, rf"^(.*)\{mark}[^{mark}]*$", 1)


def percent(col: Column, places: int = 1) -> Column:
    return F.format_string(f"%.{places}f%%", col * 100)


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def signed_verdict(estimate: Column, p: Column, alpha: float = 0.05) -> Column:
    """'+ sig', '- n.s.' and so on; a zero estimate counts as negative."""
    return F.concat(F.when(estimate > 0, "+ ").otherwise("- "), F.when(p < alpha, "sig").otherwise("n.s."))
