"""Document types and other classes from text: counts of words and patterns, and ordered arg max."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import vocabulary as V
from docloom.functions.phrases import sign, signs
from docloom.functions.text import count_in, let, rx
from docloom.operators.labels import Signs, counts

UNKNOWN = "inconnu"


def best(scores: dict[str, Column]) -> Column:
    """Struct (label, score) of the greatest score; the first of equals."""
    ranked = F.array(*[F.struct(s.cast("double").alias("score"), F.lit(-k).alias("order"), F.lit(n).alias("label")) for k, (n, s) in enumerate(scores.items())])
    top = F.array_max(ranked)
    return F.struct(top["label"].alias("label"), top["score"].alias("score"))


def by_weighted_words(text: Column) -> Column:
    """Struct (doc_type, confidence): twice the best share of all points, at most 1; any word of a sales invoice settles it."""
    low = F.lower(text)
    points = {t: count_in(low, words) * F.lit(w) for t, (w, words) in V.CONTEXT.items()}
    total = sum(list(points.values())[1:], list(points.values())[0])
    top = best(points)
    sales = points["facture_vente"] > 0
    winner = F.when(sales, points["facture_vente"]).otherwise(top["score"])
    return F.when(total == 0, F.struct(F.lit(UNKNOWN).alias("doc_type"), F.lit(0.0).alias("confidence"))).otherwise(
        F.struct(F.when(sales, "facture_vente").otherwise(top["label"]).alias("doc_type"), F.round(F.least(winner * 2 / total, F.lit(1.0)), 3).alias("confidence"))
    )


def by_substrings(text: Column) -> Column:
    """The type with most of its substrings in the text, first of equals; unknown without any."""
    top = best({t: count_in(F.lower(text), w) for t, w in V.SUBSTRINGS.items()})
    return F.when(top["score"] > 0, top["label"]).otherwise(UNKNOWN)


def _index(phrases: dict[str, list], shapes: dict[str, list[str]]) -> Signs:
    """Phrases as words of their own; spellings in one tuple count once."""
    spelled = {n: [p if isinstance(p, tuple) else (p,) for p in ps] for n, ps in phrases.items()}
    return Signs({n: [[(s, sign(s)) for s in p] for p in ps] for n, ps in spelled.items()}, shapes)


@cache
def _types() -> Signs:
    return _index({f"sure_{t}": ps for t, ps in V.SURE.items()} | {f"some_{t}": ps for t, ps in V.COUNTED.items()}, {f"sure_{t}": ps for t, ps in V.SURE_SHAPES.items()} | {f"some_{t}": ps for t, ps in V.COUNTED_SHAPES.items()})


@cache
def _payments() -> Signs:
    return _index({"cheque": V.CHEQUE_SIGNS, "traite": V.DRAFT_SIGNS}, {"cheque": V.CHEQUE_SHAPES, "traite": V.DRAFT_SHAPES})


@cache
def _others() -> Signs:
    return _index(V.NO_PAYMENT, {"facture": [r"\btva\b[^\n]*\bht\b"]})


def by_patterns(text: Column) -> Column:
    """C4: the type of a sure sign, first in order; else a sales invoice if any sign of one is there, else the type with most counted signs. All signs are found in one pass."""
    n = counts(_types, [*[f"sure_{t}" for t in V.SURE], *[f"some_{t}" for t in V.COUNTED]])(text)

    def typed(n: Column) -> Column:
        sure = F.coalesce(*[F.when(n[f"sure_{t}"] > 0, t) for t in V.SURE])
        top = best({t: n[f"some_{t}"] for t in V.COUNTED})
        return F.coalesce(sure, F.when(n["some_facture_vente"] > 0, "facture_vente").when(top["score"] > 0, top["label"]).otherwise(UNKNOWN))

    return let(n, typed)


def cheque_or_draft(text: Column) -> Column:
    """Struct (doc_type, confidence): the share of the greater count among the payment rules' own signs; equal counts are unknown."""

    def told(n: Column) -> Column:
        a, b = n["cheque"], n["traite"]
        return F.struct(F.when(a > b, "cheque").when(b > a, "traite").otherwise(UNKNOWN).alias("doc_type"), F.when(a == b, 0.0).otherwise(F.round(F.greatest(a, b) / (a + b), 3)).alias("confidence"))

    return let(counts(_payments, ["cheque", "traite"])(text), told)


def other_type(text: Column) -> Column:
    """Among the six types that are no payment, the first with most hits; null without any."""
    return let(counts(_others, list(V.NO_PAYMENT))(text), lambda n: let(best({t: n[t] for t in V.NO_PAYMENT}), lambda top: F.when(top["score"] > 0, top["label"])))


def payment_gate(text: Column, wanted: Column, duplicate: Column, draft_fields: Column, cheque_points: Column) -> Column:
    """Struct (accepted, reason, doc_type); the first case that holds decides. wanted: cheque, traite or null.

    draft_fields: how many fields of a draft were read; cheque_points: of a cheque, where the number counts two.
    Both count only for a wanted cheque without any sign of its own: two fields of a draft refuse it, three points let it pass.
    """
    kind, other = cheque_or_draft(text)["doc_type"], other_type(text)
    drafts_only, cheques_only = text.rlike(rx(signs(V.ONLY_DRAFTS))), text.rlike(rx(signs(V.ONLY_CHEQUES)))
    strict = F.coalesce(wanted.isin("cheque", "traite"), F.lit(False))
    opposite = F.when(wanted == "cheque", "traite").otherwise("cheque")
    lost = strict & (kind == UNKNOWN) & (wanted == "cheque") & ~cheques_only
    say = lambda ok, why, what: F.struct(F.lit(ok).alias("accepted"), F.lit(why).alias("reason"), what.alias("doc_type"))
    return (
        F.when(strict & F.coalesce(duplicate, F.lit(False)), say(False, "duplicate", wanted))
        .when(strict & other.isNotNull(), say(False, "other type", other))
        .when((wanted == "cheque") & drafts_only, say(False, "words of a draft", F.lit("traite")))
        .when((wanted == "traite") & cheques_only, say(False, "words of a cheque", F.lit("cheque")))
        .when(strict & (kind == opposite), say(False, "is the other kind", kind))
        .when(lost & (draft_fields >= 2), say(False, "fields of a draft", F.lit("traite")))
        .when(lost & (cheque_points < 3), say(False, "no sign of a cheque", F.lit(UNKNOWN)))
        .when(strict, say(True, "as wanted", wanted))
        .when(kind != UNKNOWN, say(True, "as found", kind))
        .when(other.isNotNull(), say(False, "other type", other))
        .otherwise(say(False, "unknown", F.lit(UNKNOWN)))
    )


def refused(text: Column, phrases: dict[str, list[str]]) -> Column:
    """The first type that one of its phrases speaks for; null without any."""
    return F.coalesce(*[F.when(text.rlike(rx(signs(ps))), t) for t, ps in phrases.items()])


def by_file_name(name: Column) -> Column:
    """The type that a file's name tells, first in order; null without any."""
    low = F.lower(name)
    return F.coalesce(*[F.when(F.contains(low, F.lit(w)), t) for t, ws in V.FILE_WORDS.items() for w in ws])


def item_gate(text: Column, file_name: Column, n_fields: Column) -> Column:
    """Struct (accepted, doc_type): refused by the file's name, by a phrase of another type or the name BOM, by two words of a bill's build; an item sheet by a word of one or by any field that was read."""
    low = F.lower(text)
    bill = F.coalesce(text.rlike("\\bBOM\\b") | (count_in(low, V.BILL_BUILD) >= 2), F.lit(False))
    sheet = (count_in(low, V.ITEM_SIGNS) > 0) | (F.coalesce(n_fields, F.lit(0)) > 0)
    phrase = refused(text, {t: ps for t, ps in V.ITEM_REFUSED.items() if t != UNKNOWN})
    no = F.coalesce(by_file_name(file_name), phrase, F.when(bill, "nomenclature"), F.when(text.rlike(rx(signs(V.ITEM_REFUSED[UNKNOWN]))), UNKNOWN))
    kind = F.coalesce(no, F.when(sheet, "fiche_article").otherwise(UNKNOWN))
    return F.struct((no.isNull() & sheet).alias("accepted"), kind.alias("doc_type"))


def bill_refusal(text: Column) -> Column:
    """The type that speaks against a bill of materials; null if none does."""
    return F.coalesce(refused(text, V.BILL_REFUSED), F.when(count_in(F.lower(text), V.SHEET_BUILD) >= 2, "fiche_article"))


def bill_gate(text: Column, second: Column) -> Column:
    """Struct (accepted, doc_type): any sure word lets a text pass; else it must have a word of a bill and nothing against it. Where it has neither, the text of a second reading is tried the same way."""

    def judged(t: Column) -> Column:
        low = F.lower(t)
        sure, some = count_in(low, V.BILL_SURE) > 0, count_in(low, V.BILL_SIGNS) > 0
        return F.when(sure, "nomenclature").otherwise(F.coalesce(bill_refusal(t), F.when(some, "nomenclature")))

    kind = F.coalesce(judged(text), judged(second), F.lit(UNKNOWN))
    return F.struct((kind == "nomenclature").alias("accepted"), kind.alias("doc_type"))


def invoice_type(text: Column) -> Column:
    """The type by patterns, overruled by what only exported sheets hold: a sure word or two others."""
    low = F.lower(text)
    bill = low.contains("fiche nomenclature") | low.contains("nomenclature (bom)") | (count_in(low, V.EXPORTED_BILL) >= 2)
    item = low.contains("fiche article") | (count_in(low, V.EXPORTED_ITEM) >= 2)
    return F.when(bill, "fiche_nomenclature").when(item, "fiche_article").otherwise(by_patterns(text))


def invoice_gate(text: Column, second: Column | None = None) -> Column:
    """Struct (accepted, doc_type): no refused type, and a word of an invoice in the text or in that of a second reading; a type that stays unknown is an invoice then."""
    has = lambda t: F.coalesce(count_in(F.lower(t), V.INVOICE_SIGNS) > 0, F.lit(False))
    some = has(text) if second is None else has(text) | has(second)
    kind = invoice_type(text)
    no = kind.isin(V.NO_INVOICE)
    return F.struct((~no & some).alias("accepted"), F.when(no, kind).when(~some, UNKNOWN).when(kind == UNKNOWN, "facture").otherwise(kind).alias("doc_type"))


def from_fields(fields: Column) -> Column:
    """C11: from a map's keys, in order."""
    keys = F.map_keys(fields)
    return (
        F.when(F.array_contains(keys, "numero_cheque"), "cheque").when(F.array_contains(keys, "numero_traite"), "traite").when(F.array_contains(keys, "numero_facture"), "facture")
        .when(F.array_contains(keys, "numero_bl"), "bon_livraison").when(F.array_contains(keys, "numero_commande"), "bon_commande").when(F.array_contains(keys, "numero_devis"), "devis").otherwise(UNKNOWN)
    )


def text_quality(text: Column, score: Column) -> Column:
    """Why a text won't do, null if it will: too few words, a low score, runs of noise, few clean words."""
    words = F.filter(F.split(text, "(?U)\\s+"), lambda w: w != "")
    clean = F.size(F.filter(words, lambda w: w.rlike("^[\\p{L}\\d][\\p{L}\\d'’.,:/\\-]*$")))
    return (
        F.when(F.size(words) < 5, "too few words")
        .when((score > 0) & (score < 40), "low score")
        .when(F.regexp_count(text, F.lit("[^\\p{L}\\d\\s]{4,}")) > 5, "noise")
        .when(clean / F.size(words) < 0.35, "few clean words")
    )


def accepted(text: Column) -> Column:
    """C16."""
    return text.rlike(rx("accept[eé]|accepted|bon\\s+pour\\s+accord"))


def band(confidence: Column) -> Column:
    """C17."""
    return F.when(confidence >= 80, "green").when(confidence >= 60, "orange").otherwise("red")


def image_quality(width: Column, contrast: Column, sharpness: Column) -> Column:
    """0 to 100 from measures of the image."""
    return F.when(width >= 2000, 35).when(width >= 1200, 20).otherwise(5) + F.when(contrast > 80, 35).when(contrast > 40, 20).otherwise(5) + F.when(sharpness > 500, 30).when(sharpness > 100, 15).otherwise(0)
