"""Fields from text by labels and the values behind them.

All labels of all wanted fields are found in one pass (docloom.operators.labels); guards are put to each way's value, as Column
expressions, before the first one counts.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import vocabulary as V
from docloom.functions.numbers import UNIT, amount_in_words
from docloom.functions.phrases import LINK, Labelled, any_of, loose
from docloom.functions.text import first_group, fold, let, rx, squeeze
from docloom.operators.labels import Ways, spans

AMOUNT_FIELDS = {"montant_ht", "tva", "montant_ttc", "montant", "prix_unitaire"}
PARTY_FIELDS = {"fournisseur", "client"}


def party_name(value: Column) -> Column:
    """A name up to the word that no name goes on with: a day, one that begins an address, a town behind a comma, a whole word of another label; up to a bar or slash; and up to the legal form that ends it."""
    bare = lambda words: F.transform(words, lambda w: F.regexp_replace(fold(w), "[^a-z0-9]", ""))
    begins = lambda heads: "^(?:" + "|".join(heads) + ")"

    def whole(x: Column) -> Column:
        words, letters = x["words"], x["letters"]

        def ends(w: Column, i: Column) -> Column:
            behind_comma = F.coalesce(F.get(words, i - 1).endswith(","), F.lit(False)) | w.startswith(",")
            town = F.concat_ws(" ", F.get(letters, i), F.get(letters, i + 1)).rlike(begins(V.TOWNS))
            address = F.get(letters, i).rlike(begins(V.ADDRESS_HEADS))
            day = w.rlike("^\\d{1,2}[/.\\-]\\d{1,2}[/.\\-]\\d{2,4}")
            return (i > 0) & (address | F.get(letters, i).isin(V.ADDRESS_WORDS) | day | behind_comma & town)

        stop = F.array_min(F.filter(F.transform(words, lambda w, i: F.when(ends(w, i), i)), lambda i: i.isNotNull()))
        return let(stop, lambda n: F.array_join(F.when(n.isNotNull(), F.slice(words, F.lit(1), F.coalesce(n, F.lit(1)))).otherwise(words), " "))

    split = let(F.split(value, " "), lambda words: F.struct(words.alias("words"), bare(words).alias("letters")))
    cut = F.regexp_replace(let(split, whole), "\\s*[|/\\\\].*$", "")
    named = lambda c: F.coalesce(first_group(c, rx(f"^(.*?{V.LEGAL_FORMS})")), c)
    return F.regexp_replace(let(cut, named), "^[ .,;:|]+|[ .,;:|]+$", "")


def guarded(value: Column, field: str) -> Column:
    """The cleaned value, or null if it can't be this field's."""

    def put(v: Column) -> Column:
        if field in PARTY_FIELDS:
            low = F.lower(v)
            bad = F.exists(F.array(*map(F.lit, V.NO_PARTY)), lambda w: F.contains(low, w)) | v.rlike("^[\\d\\s\\W_]+$")
            v = let(party_name(v), lambda name: F.when(~bad & (F.length(name) >= 3), name))
        if field == "numero_facture":
            v = F.when(~F.lower(v).isin(V.NO_NUMBER) & v.rlike("\\d") & ~v.rlike("^(?:19|20)\\d{2}$") & (F.length(v) >= 3), v)
        if field in AMOUNT_FIELDS:
            v = F.trim(F.regexp_replace(v, UNIT, ""))
        return F.nullif(v, F.lit(""))

    return let(F.regexp_replace(squeeze(value), "^[ .,;:]+|[ .,;:]+$", ""), put)


@cache
def ways(names: tuple[str, ...]) -> Ways:
    """The index of some fields' labels; a worker builds it once."""
    return Ways({n: V.LABELS[n] for n in names}, V.VALUES, {"date": V.DUE_LINE}, {"tva": V.TAX_NUMBER}, {"bank": V.BANKS})


def found(text: Column, names: list[str], every: bool = False) -> Column:
    """Struct with an array of (way, value) for each field, from one pass over the text: of each way its first match, or every one."""
    wanted = tuple(names)
    return spans(lambda: ways(wanted), names, every)(text)


def chosen(values: Column, name: str) -> Column:
    """The first of a field's values that its guard lets through."""
    return F.get(F.filter(F.transform(values, lambda s: guarded(s["value"], name)), lambda v: v.isNotNull()), F.lit(0))


def field(text: Column, name: str) -> Column:
    """X1 for one field."""
    return chosen(found(text, [name])[name], name)


def with_fields(df: DataFrame, names: list[str], text: str = "text") -> DataFrame:
    """Df with a column for each field."""
    return df.withColumn("_found", found(F.col(text), names)).withColumns({n: chosen(F.col(f"_found.{n}"), n) for n in names}).drop("_found")


def by_type(df: DataFrame, doc_type: str, text: str = "text") -> DataFrame:
    """Df with a column for each field of the type, and arrays of what was found and what is missing."""
    names = V.FIELDS[doc_type]
    have = F.array(*[F.struct(F.lit(n).alias("n"), F.col(n).isNotNull().alias("ok")) for n in names])
    return with_fields(df, names, text).withColumns({"found": F.transform(F.filter(have, lambda x: x["ok"]), lambda x: x["n"]), "missing": F.transform(F.filter(have, lambda x: ~x["ok"]), lambda x: x["n"])})


def long_form(df: DataFrame, doc_type: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, field, ord, value): one row for each field found."""
    names = V.FIELDS[doc_type]
    rows = df.select(key, found(F.col(text), names).alias("_found"))
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.lit(k).alias("ord"), chosen(F.col(f"_found.{n}"), n).alias("value")) for k, n in enumerate(names)])
    return rows.select(key, F.inline(F.filter(pairs, lambda x: x["value"].isNotNull())))


def best_of(values: Column, kind: str = "text") -> Column:
    """Of (way, value) the struct (value, confidence, uncertain) of the best: 0.6, more for digits, a date's shape or two words, for early ways and for length, at most 0.99; the earliest of equals; null without any."""

    def graded(s: Column, i: Column) -> Column:
        v = squeeze(s["value"])

        def score(v: Column) -> Column:
            bonus = {"number": F.when(v.rlike("\\d"), 0.3).otherwise(0.0), "date": F.when(v.rlike("\\d{1,2}[/.\\-]\\d{1,2}[/.\\-]\\d{2,4}"), 0.35).otherwise(0.0), "text": F.when(F.size(F.split(v, " ")) >= 2, 0.25).otherwise(0.0)}[kind]
            early = F.greatest(F.lit(0.0), F.lit(0.10) - 0.02 * s["way"])
            return F.struct(F.least(F.round(F.lit(0.6) + bonus + early + F.when(F.length(v) > 6, 0.1).otherwise(0.0), 6), F.lit(0.99)).alias("confidence"), (-i).alias("place"), v.alias("value"))

        return let(v, score)

    every = F.filter(F.transform(values, graded), lambda x: x["value"] != "")
    return let(F.array_max(every), lambda top: F.when(top.isNotNull(), F.struct(top["value"].alias("value"), F.round(top["confidence"], 2).alias("confidence"), (top["confidence"] < 0.65).alias("uncertain"))))


def most_confident(text: Column, patterns: list[str], kind: str = "text") -> Column:
    """X3 by patterns of the caller's own."""
    kinds = {str(k): p for k, p in enumerate(patterns)}
    return best_of(spans(lambda: Ways({"v": [Labelled((), k) for k in kinds]}, kinds), ["v"], True)(text)["v"], kind)


EMAIL = r"([A-Za-z0-9._+\-]+@[A-Za-z0-9\-]+\.[A-Za-z0-9.\-]*[A-Za-z0-9])"
PHONE = r"((?:\+216[ .\-]?)?\b\d{2}[ .\-]?\d{3}[ .\-]?\d{3}\b)"
TAX_ID = r"\b(\d{7}[ /]?[A-Z][ /]?[A-Z][ /]?[A-Z][ /]?\d{3})\b"


def contacts(text: Column) -> Column:
    """Struct of the first e-mail address, phone number, tax id and postcode."""
    return F.struct(first_group(text, rx(EMAIL)).alias("email"), first_group(text, rx(PHONE)).alias("phone"), first_group(text, "(?U)" + TAX_ID).alias("tax_id"), first_group(text, r"(?U)\b(\d{4})\s+(?=[A-ZÀ-Ü][a-zà-ü]+)").alias("postcode"))


def tunisian_fields(text: Column) -> Column:
    """Struct of the first invoice number, date, total, tax, company and address, by their labels."""
    g = lambda p: F.trim(first_group(text, rx(p, True)))
    return F.struct(
        g(any_of(["facture n°", "n° facture", "invoice n°"]) + LINK + r"([A-Z0-9][\w\-/]{1,25})").alias("invoice"), g(r"\b(\d{1,2}[/.\-]\d{1,2}[/.\-]\d{4})\b").alias("date"),
        g(any_of(["total t.t.c.", "net à payer", "montant t.t.c."]) + LINK + r"(\d[\d .,]*\d)").alias("total"), g(any_of(["montant tva", "t.v.a.", "tva"]) + r"\s*(?:\(?\d+\s*%\)?)?" + LINK + r"(\d[\d .,]*\d)").alias("tax"),
        F.coalesce(g(any_of(["société", "raison sociale"]) + LINK + r"([^\n]{3,60})"), g(r"(?U)^\s*([^\n]*?" + V.LEGAL_FORMS + ")")).alias("company"),
        g(r"((?:\d+\s*,?\s*)?" + any_of(["rue", "avenue", "boulevard", "route", "zone"]) + r"[^\n]{3,80})").alias("address"),
    )


#: Currencies behind an amount, words before one, labels of companies, and their legal forms.
CURRENCIES, AMOUNT_WORDS = ["€", "tnd", "dt", "$", "eur", "usd", "dinars?"], ["total", "montant", "net", "ttc", "ht", "tva"]
COMPANY_LABELS, COMPANY_FORMS = ["raison sociale", "société", "company", "fournisseur", "vendor"], ["SARL", "SUARL", "SPA", "SA", "SAS", "EURL", "SNC", "CORP", "LTD", "LLC", "INC", "GROUPE", "GROUP"]
COMPANY_STOPS = ["fodec", "base tva", "tva", "timbre", "taxe", "taxes", "montant", "total ht", "total ttc", "total taxe", "remise", "designation", "quantite", "article", "reference"]


def company(name: Column) -> Column:
    """The name without a stray letter before it; null for less than three characters, words that no company is called, and what is all digits and signs."""
    fits = lambda v: (F.length(v) >= 3) & ~F.exists(F.array(*map(F.lit, COMPANY_STOPS)), lambda w: F.contains(fold(v), w)) & ~v.rlike("^[\\d\\s\\W_]+$")
    return let(F.trim(F.regexp_replace(F.trim(name), "^[A-Za-z]\\s+", "")), lambda v: F.when(fits(v), v))


def entities(text: Column) -> Column:
    """Struct of distinct values in order of their first place. Dates with numbers (day or year first) or a month's name; amounts with a currency, then those behind a word for one, then the amount in words; references; companies by legal form, then behind a label, else lines of the first 30 in capitals."""
    months = "(?:" + "|".join(map(loose, V.MONTHS)) + ")"
    dates = F.regexp_extract_all(text, F.lit(rx(rf"\b(?:\d{{1,2}}[/.\-]\d{{1,2}}[/.\-]\d{{2,4}}|\d{{4}}[/.\-]\d{{1,2}}[/.\-]\d{{1,2}}|\d{{1,2}}\s+{months}\s+\d{{4}})\b")), F.lit(0))
    some = lambda found, least: F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x.rlike(f"\\d{{{least},}}"))
    told = some(F.regexp_extract_all(text, F.lit(rx(r"(\d[\d  .,]*\d)\s*" + any_of(CURRENCIES) + r"(?![A-Za-z])")), F.lit(1)), 2)
    behind = some(F.regexp_extract_all(text, F.lit(rx(any_of(AMOUNT_WORDS) + LINK + r"([\d  .,]{4,30})")), F.lit(1)), 3)
    spelled = let(amount_in_words(text), lambda v: F.when(v.isNotNull(), F.array(v.cast("string"))).otherwise(F.array().cast("array<string>")))
    refs = F.regexp_extract_all(text, F.lit("(?U)\\b([A-Z]{2,6}[-/]\\d[\\w\\-/]*|[A-Z]{2,5}\\d{3,}(?:[/\\-]\\d+)?)"), F.lit(1))
    forms = "|".join(COMPANY_FORMS)
    by_form = F.regexp_extract_all(text, F.lit(f"(?U)([A-ZÀ-Ü][\\w&'’.]*(?:[ ][\\w&'’.]+){{0,5}}[ ](?:{forms}))\\b"), F.lit(1))
    by_label = F.regexp_extract_all(text, F.lit("(?iuU)" + any_of(COMPANY_LABELS) + r"\s*[:\-]\s*" + "([^\\n]{4,61})"), F.lit(1))
    capitals = F.filter(F.transform(F.slice(F.split(text, "\\r?\\n"), 1, 30), lambda x: F.regexp_replace(squeeze(x), "^[ \\-:|]+|[ \\-:|]+$", "")), lambda x: x.rlike("^[A-ZÀ-Ü0-9&'’.\\- ]{4,40}$"))
    named = lambda xs: F.filter(F.transform(xs, company), lambda x: x.isNotNull())
    # a labelled line that holds a company by its form is that company
    lines = F.filter(by_label, lambda x: ~F.exists(by_form, lambda f: F.contains(x, f)))
    firms = let(named(F.concat(by_form, lines)), lambda f: F.when(F.size(f) > 0, f).otherwise(named(capitals)))
    return F.struct(F.array_distinct(dates).alias("dates"), F.array_distinct(F.concat(told, behind, spelled)).alias("amounts"), F.array_distinct(refs).alias("references"), F.array_distinct(firms).alias("companies"))


#: Words before a value that tell its role.
BEFORE = {
    "date": [("echeance", r"[eé]ch[eé]ance|due|limite"), ("livraison", r"livraison|livr[eé]"), ("commande", r"commande"), ("date", r"date|facture|le")],
    "amount": [("montant_ttc", r"t\.?t\.?c|net\s*à\s*payer|à\s*payer"), ("montant_tva", r"t\.?v\.?a|taxe"), ("montant_ht", r"\bh\.?t\b|hors\s*taxe"), ("montant", r"montant|total|somme")],
}
SHAPES = {"date": r"\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}", "amount": r"\d[\d ]*[.,]\d{2,3}"}


def roles(text: Column, kind: str) -> Column:
    """Map from role to the first value whose 60 characters before name that role, without leaving the JVM; see docloom.operators.roles for the full scan."""
    pieces = F.regexp_extract_all(text, F.lit(rx("([^\\n]{0,60}?)(" + SHAPES[kind] + ")")), F.lit(0))
    told = F.transform(
        pieces,
        lambda p: F.struct(
            F.coalesce(*[F.when(F.regexp_replace(p, SHAPES[kind] + "$", "").rlike(rx(r)), n) for n, r in BEFORE[kind]]).alias("role"),
            F.regexp_extract(p, "(" + SHAPES[kind] + ")$", 1).alias("value"),
        ),
    )
    told = F.filter(told, lambda x: x["role"].isNotNull())
    firsts = F.filter(told, lambda x, i: ~F.exists(F.slice(told, F.lit(1), i), lambda y: y["role"] == x["role"]))
    return F.map_from_entries(firsts)


#: What begins each part of a page of text.
BODY_SIGNS, FOOTER_SIGNS = r"d[ée]signation|r[ée]f[ée]rence|quantit[ée]|article", r"total\s*h\.?t|net\s*à\s*payer|montant\s*t\.?t\.?c|total\s*t\.?t\.?c"


def zones(text: Column) -> Column:
    """Struct (header, body, footer) by the first sign of each; a footer that begins before the body trades places with it."""
    at = lambda p: F.nullif(F.length(F.regexp_extract(text, rx(f"(?s)^(.*?)(?:{p})"), 1)) + F.when(text.rlike(rx(p)), 1).otherwise(0), F.lit(0))
    b, f = at(BODY_SIGNS), at(FOOTER_SIGNS)
    end = F.length(text) + 1
    first, second = F.least(F.coalesce(b, end), F.coalesce(f, end)), F.greatest(F.coalesce(b, end), F.coalesce(f, end))
    part = lambda a, z: F.btrim(F.substring(text, a, z - a), F.lit(" \n\r\t"))
    return F.struct(part(F.lit(1), first).alias("header"), part(first, second).alias("body"), part(second, end).alias("footer"))


def zone_of_line(top: Column, bottom: Column, height: Column) -> Column:
    """By a line's centre: below 30 % of the page header, below 75 % body, else footer."""
    y = (top + bottom) / 2 / height
    return F.when(y < 0.30, "header").when(y < 0.75, "body").otherwise("footer")


def body_line(line: Column) -> Column:
    """Struct (reference, designation, quantity, price, total) of a line of columns."""
    code = "^(?=.*\\d)[A-Z]{2,}[A-Z0-9\\-/]*$"
    number = lambda p: F.when(p.rlike("^[\\d ]+([.,]\\d+)?$"), F.translate(p, ", ", ".").try_cast("double"))
    taken = lambda parts: F.struct(parts.alias("parts"), F.sort_array(F.filter(F.transform(parts, number), lambda x: x.isNotNull()), False).alias("down"))

    def columns(x: Column) -> Column:
        parts, down = x["parts"], x["down"]
        at = lambda k: F.try_element_at(down, F.lit(k))
        return F.struct(
            F.try_element_at(F.filter(parts, lambda p: p.rlike(code)), F.lit(1)).alias("reference"),
            F.try_element_at(F.filter(parts, lambda p: p.rlike("\\p{L}") & ~p.rlike(code)), F.lit(1)).alias("designation"),
            at(3).alias("quantity"), at(2).alias("price"), at(1).alias("total"),
        )

    # the line is split once, and its numbers are read once
    return let(let(F.filter(F.transform(F.split(line, "\\||;|\\t|\\s{2,}"), lambda x: F.trim(x)), lambda p: p != ""), taken), columns)
