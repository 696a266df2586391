"""Amounts: one parser for each source of text, since they read separators differently; and numbers in words.

All are Column expressions over try_cast, so that what is no number is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import FLAGS, first_group, let

BLANK = "[   ]"
UNIT = FLAGS + "\\s*(?:DT|TND|€|\\$|EUR|dinars?)\\s*$"


def _number(text: Column) -> Column:
    return text.try_cast("double")


def _last_dot(text: Column) -> Column:
    """Only the last dot stays."""
    return F.regexp_replace(text, "\\.(?=.*\\.)", "")


def amount_nlp(text: Column) -> Column:
    """A1: digits and separators only; a comma is a dot; the last dot counts."""
    return _number(_last_dot(F.replace(F.regexp_replace(text, "[^\\d,.]", ""), F.lit(","), F.lit("."))))


def amount_matcher(text: Column) -> Column:
    """A2: the float as text, or the cleaned text as it is."""
    clean = F.replace(F.regexp_replace(text, BLANK, ""), F.lit(","), F.lit("."))
    return F.coalesce(_number(clean).cast("string"), clean)


def amount_extractor(text: Column) -> Column:
    """A3: spaces dropped, comma as dot; 0 where that is no number."""
    return F.coalesce(_number(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit(","), F.lit("."))), F.lit(0.0))


def amount_payment(text: Column, quirks: bool = True) -> Column:
    """A4: the last of mixed separators is the decimal one; three digits behind a comma are thousands (without quirks: millimes); a dot behind 1,000 or more joins; nothing at or below zero."""
    return let(F.regexp_replace(F.regexp_replace(text, UNIT, ""), "[^\\d.,]", ""), lambda s: _payment(s, quirks))


def _payment(s: Column, quirks: bool) -> Column:
    no = lambda c: F.replace(s, F.lit(c), F.lit(""))
    comma, dot = s.contains(","), s.contains(".")
    comma_last = F.length(F.substring_index(s, ",", -1)) < F.length(F.substring_index(s, ".", -1))
    after = F.substring_index(s, ",", -1)
    value = (
        F.when(s.rlike("^\\d{1,3}(,\\d{3})+(\\.\\d+)?$") & (dot | F.lit(quirks)), no(","))
        .when(comma & dot & comma_last, F.replace(no("."), F.lit(","), F.lit(".")))
        .when(comma & dot, no(","))
        .when(comma & (F.length(after) == 3) & F.lit(quirks), no(","))
        .when(comma & (F.length(after) == 4), F.concat(F.substring_index(s, ",", 1), F.lit("."), F.substring(after, 2, 3)))
        .when(comma, F.replace(s, F.lit(","), F.lit(".")))
        .when(s.rlike("^\\d{4,}\\.\\d{3}$"), no("."))
        .otherwise(s)
    )
    parsed = _number(value)
    return F.when(parsed > 0, parsed)


def amount_pipeline(text: Column) -> Column:
    """A5: unit and spaces dropped; a comma counts only where there is no dot."""
    s = F.regexp_replace(F.regexp_replace(F.trim(text), UNIT, ""), BLANK, "")
    return _number(F.when(s.contains("."), s).otherwise(F.replace(s, F.lit(","), F.lit("."))))


def amount_typed(text: Column) -> Column:
    """A comma is decimal if two or three digits end the text, else it parts thousands."""
    s = F.regexp_replace(text, "[^\\d,.\\-]", "")
    decimal = s.rlike(",\\d{2,3}$")
    return _number(F.when(decimal, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(s, F.lit(","), F.lit(""))))


def amount_bom(text: Column) -> Column:
    """With a comma, dots part thousands."""
    s = F.regexp_replace(text, "[^\\d,.]", "")
    return _number(F.when(s.contains(","), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(s))


def price(text: Column) -> Column:
    """Within (0.1, 999,999)."""
    v = amount_pipeline(text)
    return F.when((v > 0.1) & (v < 999_999), v)


def amount_cell(text: Column) -> Column:
    """A10: five accepted shapes; units, percentages and degrees are none."""
    s = F.trim(text)
    tight = F.regexp_replace(s, BLANK, "")
    value = (
        F.when(tight.rlike("^-?\\d{1,3}(,\\d{3})+\\.\\d+$"), F.replace(tight, F.lit(","), F.lit("")))
        .when(tight.rlike("^-?\\d{1,3}(\\.\\d{3})+,\\d+$"), F.replace(F.replace(tight, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(tight.rlike("^-?\\d+,\\d+$"), F.replace(tight, F.lit(","), F.lit(".")))
        .when(tight.rlike("^-?\\d+(\\.\\d+)?$"), tight)
    )
    return F.when(~s.rlike("[\\p{L}%°]"), _number(value))


def amount_api(text: Column, default: float = 0.0) -> Column:
    """A11."""
    return F.coalesce(_number(F.replace(F.regexp_replace(text, BLANK, ""), F.lit(","), F.lit("."))), F.lit(default))


AMOUNTS = {"nlp": amount_nlp, "extractor": amount_extractor, "payment": amount_payment, "pipeline": amount_pipeline, "typed": amount_typed, "bom": amount_bom, "price": price, "cell": amount_cell, "api": amount_api}


def amount(text: Column, profile: str = "pipeline") -> Column:
    return AMOUNTS[profile](text)


def scan_amounts(text: Column) -> Column:
    """All readings of all numbers in a text: seven digits as millions and as thousands with decimals, thousands by comma, by blank or dot; within (0.5, 9,999,999), without repeats nearer than 0.001."""
    s = F.regexp_replace(text, BLANK, " ")
    tight = lambda x: F.regexp_replace(x, "[ .,]", "")
    seven = F.regexp_extract_all(s, F.lit("(?<![\\d.,])(\\d[ .]\\d{3},\\d{3})(?!\\d)"), F.lit(1))
    english = F.regexp_extract_all(s, F.lit("(?<![\\d.,])(\\d{1,3}(?:,\\d{3})+\\.\\d{1,3})(?!\\d)"), F.lit(1))
    french = F.regexp_extract_all(s, F.lit("(?<![\\d.,])(\\d{1,3}(?:[ .]\\d{3})*,\\d{1,3})(?!\\d)"), F.lit(1))
    plain = F.regexp_extract_all(s, F.lit("(?<![\\d.,])(\\d+\\.\\d{1,3})(?![\\d.,])"), F.lit(1))
    found = F.concat(
        F.transform(seven, lambda x: _number(tight(x))),
        F.transform(seven, lambda x: _number(F.replace(F.regexp_replace(x, "[ .]", ""), F.lit(","), F.lit(".")))),
        F.transform(english, lambda x: _number(F.replace(x, F.lit(","), F.lit("")))),
        F.transform(french, lambda x: _number(F.replace(F.regexp_replace(x, "[ .]", ""), F.lit(","), F.lit(".")))),
        F.transform(plain, _number),
    )
    inside = F.filter(found, lambda x: (x > 0.5) & (x < 9_999_999))
    none = F.array().cast("array<double>")
    return F.aggregate(inside, none, lambda got, x: F.when(F.exists(got, lambda y: F.abs(x - y) <= 0.001), got).otherwise(F.concat(got, F.array(x))))


#: Numerals of up to three words (hyphens are blanks).
NUMERALS = {
    "zero": 0, "un": 1, "une": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "six": 6, "sept": 7, "huit": 8, "neuf": 9, "dix": 10, "onze": 11, "douze": 12, "treize": 13, "quatorze": 14, "quinze": 15, "seize": 16,
    "dix sept": 17, "dixsept": 17, "dix huit": 18, "dixhuit": 18, "dix neuf": 19, "dixneuf": 19, "vingt": 20, "trente": 30, "quarante": 40, "cinquante": 50, "soixante": 60, "soixante dix": 70, "quatre vingt": 80, "quatre vingts": 80, "quatre vingt dix": 90,
}
#: Multipliers.
MULTIPLIERS = {"cent": 100, "cents": 100, "mille": 1000, "million": 10**6, "millions": 10**6, "milliard": 10**9, "milliards": 10**9}


def words_to_number(text: Column, hundred_flushes: bool = False) -> Column:
    """One fold over the words. Longer numerals are joined before it; hundred multiplies in place (or, with hundred_flushes, ends a part as thousand does); null if nothing counts."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[-—–]", " "), "\\s+", " ")
    for phrase in sorted((p for p in NUMERALS if " " in p), key=lambda p: -p.count(" ")):
        s = F.regexp_replace(s, rf"(?<![\p{{L}}_]){phrase}(?![\p{{L}}_])", phrase.replace(" ", "_"))
    values = F.create_map(*[F.lit(x) for k, v in NUMERALS.items() for x in (k.replace(" ", "_"), float(v))])
    factors = F.create_map(*[F.lit(x) for k, v in MULTIPLIERS.items() for x in (k, float(v))])

    def step(state: Column, word: Column) -> Column:
        total, part = state["total"], state["part"]
        value, factor = F.try_element_at(values, word), F.try_element_at(factors, word)
        raised = F.when(part > 0, part).otherwise(1.0) * factor
        stays = (factor == 100) & ~F.lit(hundred_flushes)
        return F.struct(
            F.when(factor.isNotNull() & ~stays, total + raised).otherwise(total).alias("total"),
            F.when(value.isNotNull(), part + value).when(stays, raised).when(factor.isNotNull(), 0.0).otherwise(part).alias("part"),
        )

    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("part"))
    total = F.aggregate(F.split(s, " "), start, step, lambda x: x["total"] + x["part"])
    return F.when(total > 0, total)


def amount_in_words(text: Column, floor: float = 100.0, hundred_flushes: bool = False) -> Column:
    """The dinars (at least floor) and millimes that a text spells."""

    def spelled(s: Column) -> Column:
        said = F.coalesce(first_group(s, FLAGS + "somme\\s+(?:de|ae)\\s+(.*?)dinars?"), first_group(s, FLAGS + "montant\\s+(?:de\\s+)?(.*?)dinars?"))
        millimes = words_to_number(first_group(s, FLAGS + "dinars?\\s+et\\s+(.*?)millimes?"), hundred_flushes)
        return let(words_to_number(said, hundred_flushes), lambda dinars: F.when(dinars >= floor, F.round(dinars + F.coalesce(millimes, F.lit(0.0)) / 1000, 3)))

    # only a text with these letters can name dinars
    return let(F.replace(F.replace(F.lower(text), F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" ")), lambda s: F.when(F.contains(s, F.lit("nar")), spelled(s)))


def replaces(old: Column, new: Column) -> Column:
    """A new amount takes an old one's place if that is missing, zero or no number, or the two differ twentyfold."""
    before = amount_pipeline(old.cast("string"))
    apart = F.greatest(before, new) / F.greatest(F.least(before, new), F.lit(0.001)) >= 20
    return F.coalesce(new > 0, F.lit(False)) & (before.isNull() | (before <= 0) | apart)
