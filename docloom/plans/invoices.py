"""Invoices from text to checked entries, and their rendering from orders, for checks against the base tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import dates
from docloom.functions.numbers import amount_typed
from docloom.functions.text import once
from docloom.operators.checks import reconciled, validated
from docloom.operators.classify import by_patterns
from docloom.operators.fields import chosen, found


def money(amount: Column, style: Column) -> Column:
    """Three decimals; blanks (style 0), no-break spaces (1) or nothing (2) between thousands."""
    s = F.format_number(amount, 3)
    return F.when(style == 0, F.translate(s, ",.", " ,")).when(style == 1, F.translate(s, ",.", " ,")).otherwise(F.replace(F.replace(s, F.lit(","), F.lit("")), F.lit("."), F.lit(",")))


def render(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """doc_id, text: an invoice for each order; the gross of every seventh is 0.6 off."""
    net = F.col("o_totalprice").cast("decimal(18,3)")
    tax = (net * F.lit(0.19).cast("decimal(3,2)")).cast("decimal(18,3)")
    gross = net + tax + F.when(F.col("o_orderkey") % 7 == 0, F.lit("0.6").cast("decimal(18,3)")).otherwise(F.lit("0").cast("decimal(18,3)"))
    style = F.col("o_orderkey") % 3
    text = F.concat(
        F.lit("Facture N° : FAC-"), F.date_format("o_orderdate", "yyyy"), F.lit("-"), F.lpad(F.col("o_orderkey").cast("string"), F.greatest(F.length(F.col("o_orderkey").cast("string")), F.lit(5)), F.lit("0")), F.lit("\nDate : "), F.date_format("o_orderdate", "dd/MM/yyyy"),
        F.lit("\nDate Échéance : "), F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 30), "dd/MM/yyyy"), F.lit("\nFournisseur : "), F.col("c_name"), F.lit(" SARL\nMontant HT : "), money(net, style), F.lit(" DT\nTVA (19%) : "), money(tax, style), F.lit(" DT\nMontant TTC : "), money(gross, style), F.lit(" DT\n"),
    )
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


def read(docs: DataFrame) -> DataFrame:
    """doc_id, doc_type, bill_no, bill_date, due_date, supplier, net, tax, gross, status: type, fields, amounts, reconciliation and checks; no row leaves its partition."""
    t = F.col("text")
    names = ("numero_facture", "date", "echeance", "fournisseur", "montant_ht", "tva", "montant_ttc")
    spans = docs.select("doc_id", by_patterns(t).alias("doc_type"), found(t, list(names)).alias("_found"))
    raw = once(spans, {n: chosen(F.col(f"_found.{n}"), n) for n in names}).drop("_found")
    amounts = once(raw, {"net": amount_typed(F.col("montant_ht")), "tax": amount_typed(F.col("tva")), "gross": amount_typed(F.col("montant_ttc"))})
    text_of = {"numero_facture": F.col("numero_facture"), "date": F.col("date"), "fournisseur": F.col("fournisseur"), "montant_ht": F.col("net").cast("string"), "montant_tva": F.col("tax").cast("string"), "montant_ttc": F.col("gross").cast("string")}
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in text_of.items()]), lambda p: p["v"].isNotNull())
    checked = validated(amounts.withColumn("fields", F.map_from_entries(pairs)))
    done = reconciled(checked)
    return done.select("doc_id", "doc_type", F.col("numero_facture").alias("bill_no"), dates.normalised(F.col("date")).alias("bill_date"), dates.normalised(F.col("echeance")).alias("due_date"), F.col("fournisseur").alias("supplier"), "net", "tax", "gross", "n_errors", "status")
