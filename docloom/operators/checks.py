"""Validation and reconciliation of extracted fields; all row-wise expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import vocabulary as V
from docloom.functions.dates import typed
from docloom.functions.numbers import amount_typed
from docloom.functions.text import is_missing


def missing_fields(doc_type: Column, fields: Column) -> Column:
    """V1: mandatory fields of the type that the map lacks or holds empty."""
    table = F.create_map(*[x for t, fs in V.MANDATORY.items() for x in (F.lit(t), F.array(*map(F.lit, fs)).cast("array<string>"))])
    wanted = F.coalesce(F.try_element_at(table, doc_type), F.array().cast("array<string>"))
    return F.filter(wanted, lambda f: F.coalesce(F.try_element_at(fields, f), F.lit("")) == "")


def date_format(value: Column) -> Column:
    """V2: the date with slashes; null where the shape is wrong (dots are)."""
    return F.when(value.rlike("^\\d{1,4}[/-]\\d{1,2}[/-]\\d{2,4}"), F.replace(value, F.lit("-"), F.lit("/")))


def amount_format(value: Column) -> Column:
    """V2: the amount; null where it is no number or below zero."""
    v = F.replace(value, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(v >= 0, v)


def incoherent(net: Column, tax: Column, gross: Column, tolerance: float = 0.5) -> Column:
    """V3."""
    return F.coalesce(F.abs(net + tax - gross) > tolerance, F.lit(False))


def validated(df: DataFrame, doc_type: str = "doc_type", fields: str = "fields") -> DataFrame:
    """V1-V4: df with errors (code and field), n_errors and status. fields: a map of texts."""
    f = F.col(fields)
    have = lambda n: F.try_element_at(f, F.lit(n))
    error = lambda code, n: F.struct(F.lit(code).alias("code"), F.lit(n).alias("field"))
    lacking = F.transform(missing_fields(F.col(doc_type), f), lambda n: F.struct(F.lit("CHAMP_MANQUANT").alias("code"), n.alias("field")))
    dates = [F.when(have(n).isNotNull() & date_format(have(n)).isNull(), error("FORMAT_DATE_INVALIDE", n)) for n in ("date", "date_livraison", "date_commande", "date_echeance")]
    amounts = [F.when(have(n).isNotNull() & amount_format(have(n)).isNull(), error("MONTANT_INVALIDE", n)) for n in ("montant_ttc", "montant_ht", "montant_tva", "montant")]
    apart = F.when(incoherent(*[amount_format(have(n)) for n in ("montant_ht", "montant_tva", "montant_ttc")]), error("INCOHERENCE_MONTANTS", "montant_ttc"))
    errors = F.concat(lacking, F.array_compact(F.array(*dates, *amounts, apart)))
    out = df.withColumn("errors", errors)
    return out.withColumns({"n_errors": F.size("errors"), "status": F.when(F.size("errors") > 0, "validation_requise").otherwise("valide")})


def reconciled(df: DataFrame, net: str = "net", tax: str = "tax", gross: str = "gross") -> DataFrame:
    """V5: implausible amounts dropped, the missing third derived, a tax that leaves out parts of the difference replaced by it. Order counts."""
    n, t, g = F.col(net), F.col(tax), F.col(gross)
    some = lambda c: c.isNotNull() & (c != 0)
    out = df.withColumn(tax, F.when(some(g) & some(t) & ((t >= g * 0.90) | F.coalesce(some(n) & (t > n * 0.90), F.lit(False))), None).otherwise(t))
    out = out.withColumn(net, F.when(some(g) & some(n) & ~some(t) & ((n >= g * 0.98) | (n < g * 0.25)), None).otherwise(n))
    derived = F.round(g - t, 3)
    out = out.withColumn(net, F.when(some(g) & some(t) & (n.isNull() | (n <= 0)) & (derived > 0), derived).otherwise(n))
    rest = F.round(g - n, 3)
    out = out.withColumn(tax, F.when(some(g) & some(n) & ~some(t) & (rest > 0), rest).otherwise(t))
    return out.withColumn(tax, F.when(some(g) & some(n) & some(t) & (rest > 0) & (t < rest * 0.98), rest).otherwise(t))


def merged_totals(first: Column, second: Column) -> Column:
    """Two readings (net, tax, gross) of the same totals: of the gross the smaller if they differ a hundredfold, else the larger; of the net the largest below it; the tax nearest to their difference."""
    a, b = first["gross"], second["gross"]
    gross = F.when(a.isNull() | b.isNull(), F.coalesce(a, b)).when(F.greatest(a, b) / F.least(a, b) > 100, F.least(a, b)).otherwise(F.greatest(a, b))
    net = F.array_max(F.filter(F.array(first["net"], second["net"]), lambda x: x < gross))
    tax = F.array_min(F.transform(F.filter(F.array(first["tax"], second["tax"]), lambda x: x.isNotNull()), lambda x: F.struct(F.abs(x - (gross - net)).alias("off"), x.alias("tax"))))["tax"]
    return F.struct(net.alias("net"), tax.alias("tax"), gross.alias("gross"))


def matched_share(matched: Column, total: Column, read_score: Column | None = None) -> Column:
    """V8: struct (confidence, applied): whole percent, or the score of the reading where nothing is wanted; below 30 nothing is applied."""
    c = F.when(total > 0, F.floor(100 * F.try_divide(matched, total))).otherwise(F.lit(0) if read_score is None else F.floor(F.coalesce(read_score, F.lit(0)))).cast("int")
    return F.struct(c.alias("confidence"), (c >= 30).alias("applied"))


def renamed(fields: DataFrame, mapping: DataFrame, last: bool = True, key: str = "doc_id") -> DataFrame:
    """(key, name, value): fields under their names in the books; of several fields with one name the last (or first) in the mapping's order. fields: key, doc_type, field, value; mapping: doc_type, ord, field, name. The mapping is small and goes to every task: all rows have few fields, so that a shuffled join would bring them to as few tasks."""
    joined = fields.where(~is_missing(F.col("value"))).join(F.broadcast(mapping), ["doc_type", "field"])
    pick = F.max_by if last else F.min_by
    return joined.groupBy(key, "name").agg(pick("value", "ord").alias("value"))


def first_present(fields: Column, aliases: list[str]) -> Column:
    """The value of the first alias that is there, null if that is empty."""
    keys = F.map_keys(fields)
    return F.nullif(F.coalesce(*[F.when(F.array_contains(keys, a), F.coalesce(F.try_element_at(fields, F.lit(a)), F.lit(""))) for a in aliases]), F.lit(""))


def precedence(*values: Column) -> Column:
    """The first that isn't missing."""
    return F.coalesce(*[F.when(~is_missing(v), v) for v in values])


def net_amount(net: Column, gross: Column, tax: Column) -> Column:
    """The net amount; else gross less tax where both are above zero, rounded to the thousandth; else a gross above zero; else 0."""
    some = lambda c: F.coalesce(c > 0, F.lit(False))
    return F.when(F.coalesce(net != 0, F.lit(False)), net).when(some(gross) & some(tax), F.round(gross - tax, 3)).when(some(gross), gross).otherwise(0.0)


def derived_on_form(net: Column, tax: Column, gross: Column) -> Column:
    """V6: struct (net, tax) as a form fills them in: what is missing of the two from the gross and the other, if above zero."""
    some = lambda c: F.coalesce(c > 0, F.lit(False))
    positive = lambda c: F.when(c > 0, c)
    return F.struct(
        F.when(~some(net) & some(gross) & some(tax), positive(F.round(gross - tax, 3))).otherwise(net).alias("net"),
        F.when(~some(tax) & some(gross) & some(net), positive(F.round(gross - net, 3))).otherwise(tax).alias("tax"),
    )


def coerced(field_type: Column, value: Column) -> Column:
    """V9: a text in the form of its field's type: amounts as numbers, dates as days, whole numbers without rest, flags as 0 or 1, else trimmed; null where that fails."""
    v = F.trim(value)
    return (
        F.when(field_type.isin("Currency", "Float", "Percent"), amount_typed(v).cast("string"))
        .when(field_type == "Int", amount_typed(v).cast("long").cast("string"))
        .when(field_type == "Date", typed(v).cast("string"))
        .when(field_type == "Check", F.lower(v).isin("1", "true", "oui", "yes", "vrai").cast("int").cast("string"))
        .otherwise(F.nullif(v, F.lit("")))
    )


def final_status(n_filled: Column, least: int = 3) -> Column:
    """V16."""
    return F.when(n_filled >= least, V.VALID).otherwise(V.TO_CHECK)


def valid_point(lat: Column, lon: Column) -> Column:
    """V13."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def valid_zone(kind: Column, lat: Column, lon: Column, radius: Column, polygon: Column) -> Column:
    """Struct (valid, radius): a circle has a centre, its radius is 500 unless given; a polygon has three points of two."""
    points = F.from_json(polygon, "array<array<double>>")
    good = F.coalesce((F.size(points) >= 3) & F.forall(points, lambda p: F.size(p) == 2), F.lit(False))
    r = F.when(kind == "Cercle", F.coalesce(F.when(radius > 0, radius), F.lit(500.0)))
    return F.struct(F.when(kind == "Cercle", valid_point(lat, lon)).when(kind == "Polygone", good).otherwise(F.lit(True)).alias("valid"), r.alias("radius"))


def clamp(value: Column, low: float, high: float | None = None) -> Column:
    """V14."""
    v = F.greatest(value, F.lit(low))
    return v if high is None else F.least(v, F.lit(high))
