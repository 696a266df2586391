"""More registered queries: one for each group of rules, over whole tables, with what they must find in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import dates, fuzzy, numbers, text
from docloom.functions import vocabulary as V
from docloom.operators import checks, classify, documents, fields, fleet, forms, grid, payments, resolve, sheets
from docloom.plans import invoices, worker
from docloom.queries import order_cells, query, spread, table
from docloom.sources import files


def literal(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def one_of(key: str, values: list) -> str:
    """SQL: the value of the list at the key's remainder."""
    return f"[{', '.join(map(literal, values))}][1 + {key} % {len(values)}]"


def each(key: str, values: list) -> Column:
    """The same in Spark."""
    return F.get(F.array(*map(F.lit, values)), (F.col(key) % len(values)).cast("int"))


def among(key: str, said: Column, below: bool = True) -> Column:
    """A text among lines that say nothing to any rule, whose words, numbers and order change from row to row; null stays null. below: whether some stand behind it."""
    k = F.col(key).cast("long")
    line = lambda n: F.concat(F.get(F.array(*map(F.lit, ["page", "dossier", "agent", "suite", "vu par"])), F.pmod(F.xxhash64(k, F.lit(n)), F.lit(5)).cast("int")), F.lit(" "), F.pmod(F.xxhash64(F.lit(n), k), F.lit(90)).cast("string"))
    before, after = F.pmod(F.xxhash64(k), F.lit(3)), F.pmod(F.xxhash64(k, F.lit("after")), F.lit(3 if below else 1))
    lines = lambda n, shift: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i < n, line(i + shift)))
    return F.when(said.isNotNull(), F.array_join(F.array_compact(F.concat(lines(before, 0), F.array(said), lines(after, 10))), "\n"))


def lettered(key: str) -> Column:
    """A name of letters for each key: its digits as letters."""
    return F.initcap(F.translate(F.col(key).cast("string"), "0123456789", "bcdfglmnrt"))


def lettered_sql(key: str) -> str:
    x = f"translate({key}::VARCHAR, '0123456789', 'bcdfglmnrt')"
    return f"(upper(substr({x}, 1, 1)) || substr({x}, 2))"


PRICE = "round(l_extendedprice, 2)"


@query(f"""
SELECT l_orderkey, l_linenumber, {PRICE}::DECIMAL(12,2)::DOUBLE::VARCHAR AS matcher, {PRICE} AS extractor, {PRICE} AS price, -{PRICE} AS client, {PRICE} AS item, {PRICE} AS bill, {PRICE} AS scanned, l_linenumber % 2 = 0 AS replaced FROM lineitem
""")
def number_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.format_number(F.round("l_extendedprice", 2), 2)
    bare = F.replace(s, F.lit(","), F.lit(""))
    spaced, dotted, comma = F.translate(s, ",.", " ,"), F.translate(s, ",.", ".,"), F.replace(bare, F.lit("."), F.lit(","))
    larger = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice") * 25).otherwise(F.col("l_extendedprice"))
    return spread(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", numbers.amount_matcher(spaced).alias("matcher"), numbers.amount_extractor(comma).alias("extractor"), numbers.price(F.concat(spaced, F.lit(" DT"))).alias("price"),
        forms.client_amount(F.concat(F.lit("("), bare, F.lit(" DT)"))).alias("client"), forms.item_amount(dotted).alias("item"), forms.bill_amount(F.concat(comma, F.lit(" kg"))).alias("bill"),
        F.array_max(numbers.scan_amounts(F.concat(F.lit("Total "), spaced, F.lit(" DT")))).alias("scanned"), numbers.replaces(bare, larger).alias("replaced"),
    )


@query("""
SELECT o_orderkey AS doc_id, ((2 + o_orderkey % 8) * 1000 + (2 + o_custkey % 8) * 100 + 70 + (2 + o_orderkey % 7) + (2 + o_custkey % 5) / 1000.0)::DOUBLE AS amount FROM orders
""")
def amount_in_words_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = ["deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"]
    word = lambda c: F.get(F.array(*map(F.lit, digits)), c.cast("int"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    said = F.concat(F.lit("montant de "), word(k % 8), F.lit(" mille "), word(c % 8), F.lit(" cent soixante-dix "), word(k % 7), F.lit(" dinars et "), word(c % 5), F.lit(" millimes"))
    return spread(spark, sf_dir, "orders").select(k.alias("doc_id"), numbers.amount_in_words(said, 10.0, True).alias("amount"))


@query("""
WITH d AS (SELECT o_orderkey AS doc_id, (o_orderdate::DATE + INTERVAL 120 MONTH)::DATE AS d FROM orders)
SELECT doc_id, d AS first, 2 AS found, (DATE '2009-01-01' - d) / 30.44 AS months, d <= DATE '2005-01-01' AS past, d + 90 AS due, d AS voted, d < DATE '2009-01-01' - 183 AS old FROM d
""")
def date_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, as_of = F.add_months(F.col("o_orderdate").cast("date"), 120), F.lit("2009-01-01").cast("date")
    said = F.concat(F.lit("Le "), F.date_format(d, "dd/MM/yyyy"), F.lit(" à 90 jours, fait le "), F.date_format(d, "dd-MM-yyyy"))
    return spread(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), dates.first_plausible(said, as_of).alias("first"), F.size(dates.scan(said, as_of)).alias("found"), dates.age_in_months(d, as_of).alias("months"),
        dates.not_in_future(d, F.lit("2005-01-01").cast("date")).alias("past"), dates.due_after(said, d).alias("due"), dates.voted(said, as_of).alias("voted"), dates.stale_on_save(d, as_of).alias("old"),
    )


@query("""
WITH d AS (SELECT o_orderkey AS doc_id, (DATE '2024-06-01' - (o_orderkey % 80)::INT) AS d FROM orders)
SELECT doc_id, d AS repaired, TRUE AS corrected, d AS kept, d + 100 AS draft, d AS emitted, d + 60 AS due FROM d
""")
def year_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit("2024-06-01").cast("date")
    d = F.date_sub(as_of, (F.col("o_orderkey") % 80).cast("int"))
    five = F.add_months(d, 60)
    both = dates.reconcile_due(F.date_add(d, 60), d)
    rows = spread(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), dates.repair_year(five, as_of).alias("r"), dates.repair_year(d, as_of).alias("k"), dates.repair_year(F.date_add(d, 100), as_of, "traite").alias("t"), both.alias("b"))
    return rows.select("doc_id", F.col("r.date").alias("repaired"), F.col("r.corrected").alias("corrected"), F.col("k.date").alias("kept"), F.col("t.date").alias("draft"), F.col("b.emitted").alias("emitted"), F.col("b.due").alias("due"))


UNITS = [("pcs", "Unité", "Unité", "Unité"), ("Boîte", "Box", "Boîte", "Boîte"), ("zz", "", "ZZ", "zz"), ("kg", "Kg", "Kg", "Kg")]
METHODS = [("Chèque barré", "cheque"), ("Lettre de change", "traite"), ("draft", "traite"), ("virement", None)]
BANKS = [("Banque STB Sfax", "STB"), ("attijari", "Attijari"), ("rien", None)]


@query(f"""
SELECT c_custkey AS id, 'ecole n' || c_custkey AS folded, 'champ_e_' || c_custkey AS key, 'a ' || c_custkey || ' b' AS squeezed, c_custkey || '0' || c_custkey || '-1' AS payment, c_custkey || '0' || c_custkey AS sheet, 'AB0' || c_custkey AS codes,
  'AB-' || c_custkey AS item_code, 'PX0' || c_custkey AS part_code, 'x ' || c_custkey AS chain, 'Alpha ' || c_custkey AS before, {one_of("c_custkey", [u[1] for u in UNITS])} AS unit_item, {one_of("c_custkey", [u[2] for u in UNITS])} AS unit_bom,
  {one_of("c_custkey", [u[3] for u in UNITS])} AS unit_sheet, {one_of("c_custkey", [m[1] for m in METHODS])} AS method, {one_of("c_custkey", [b[1] for b in BANKS])} AS bank, '10 123 456 7' || lpad((c_custkey % 1000000)::VARCHAR, 6, '0') || ' 123 45' AS account, '12/03/2024' AS day FROM customer
""")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return spread(spark, sf_dir, "customer").select(
        k.alias("id"), text.fold(say("École N", k)).alias("folded"), text.field_key(say("Champ É ", k)).alias("key"), text.squeeze(say("  a \n ", k, "\t b ")).alias("squeezed"), text.repair_payment(say(k, "O", k, "–1")).alias("payment"),
        text.repair_sheet(say(k, "O", k)).alias("sheet"), text.repair_codes(say("ABO", k)).alias("codes"), text.item_code(say("AB-", k, ". reste")).alias("item_code"), text.part_code(say("aPXO", k)).alias("part_code"), text.chain(say(" - x  ", k, " |")).alias("chain"),
        text.before_label(say("Alpha ", k, " Tel : 71")).alias("before"), *[text.unit(each("c_custkey", [u[0] for u in UNITS]), p).alias(f"unit_{p}") for p in ("item", "bom", "sheet")], text.payment_method(each("c_custkey", [m[0] for m in METHODS])).alias("method"),
        text.bank(each("c_custkey", [b[0] for b in BANKS])).alias("bank"), text.account_number(say("1o 123 456 7", F.lpad((k % 1000000).cast("string"), 6, "0"), " 123 45")).alias("account"), text.repair_names(F.lit("1 2/03/2024")).alias("day"),
    )


#: What a party is called around a name ({}), and what is taken of it; null where it is none.
PARTIES = [("Acier {} SARL", "Acier {} SARL"), ("signature", None), ("Acier ({})", None), ("OT OLEO TECHNO", "OLEO TECHNO"), ("aCi{}eR tUnIs", None), ("{} 12345 B", None), ("Bon pour aval {}", None), ("Acier {} x Tunisie Sud", "Acier {} Tunisie Sud")]
DRAWEES = [("agence BIAT {}", "BIAT"), ("Fonds {}", "Fonds {}"), ("xy", None)]
COMPANIES = [("Alpha {}", True), ("TVA 19 {}", False), ("12 34", False), ("ab", False)]


def put_in(texts: list[str | None], key: str) -> Column:
    """The text at the key's remainder, with the key's name in it."""
    return F.replace(each(key, texts), F.lit("{}"), lettered(key))


@query(f"SELECT c_custkey AS id, replace({one_of('c_custkey', [p[1] for p in PARTIES])}, '{{}}', {lettered_sql('c_custkey')}) AS party, replace({one_of('c_custkey', [p[1] for p in DRAWEES])}, '{{}}', {lettered_sql('c_custkey')}) AS drawee, {one_of('c_custkey', [c[1] for c in COMPANIES])} AS company, lpad(((c_custkey * 7919) % 10000000)::VARCHAR, 8, '0') AS cheque FROM customer")
def party_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "c_custkey"
    number = F.concat(F.lit("9"), F.lpad(((F.col(k) * 7919) % 10000000).cast("string"), 7, "0"))
    of = lambda rows: put_in([x[0] for x in rows], k)
    return spread(spark, sf_dir, "customer").select(F.col(k).alias("id"), payments.plausible_party(of(PARTIES), "tireur").alias("party"), payments.plausible_party(of(DRAWEES), "tire").alias("drawee"), payments.company_name(of(COMPANIES)).alias("company"), payments.cheque_number(number).alias("cheque"))


SUBSTRINGS = [("acture 12", "facture"), ("BL N° 4, bordereau", "bon_livraison"), ("chque, rib", "cheque"), ("Bon de commande", "bon_commande"), ("rien", "inconnu")]
NO_PAYMENT = [("Fiche nomenclature", "nomenclature"), ("Fiche article : A1", "fiche_article"), ("Proforma", "devis"), ("chèque", None), ("Invoice", "facture"), ("Purchase order", "bon_commande")]
KEYED = [("numero_cheque", "cheque"), ("numero_bl", "bon_livraison"), ("numero_devis", "devis"), ("autre", "inconnu"), ("numero_traite", "traite"), ("numero_commande", "bon_commande"), ("numero_facture", "facture")]
IMAGES = [(2000, 81.0, 501.0, 100), (1999, 80.0, 500.0, 55), (1199, 40.0, 100.0, 10)]
SHEETS = [("bom, niveau", 0, True), ("autre", 3, True), ("autre", 1, False)]


@query(f"""
SELECT o_orderkey AS doc_id, {one_of("o_orderkey", [x[1] for x in SUBSTRINGS])} AS by_substrings, {one_of("o_orderkey", [x[1] for x in NO_PAYMENT])} AS no_payment, {one_of("o_orderkey", [x[1] for x in KEYED])} AS keyed, {one_of("o_orderkey", [x[3] for x in IMAGES])} AS image,
  o_orderkey % 2 = 0 AS accepted, {one_of("o_orderkey", ["green", "orange", "red"])} AS band, {one_of("o_orderkey", [x[2] for x in SHEETS])} AS sheet FROM orders
""")
def class_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "o_orderkey"
    image = [each(k, [x[n] for x in IMAGES]) for n in range(3)]
    said = {"_substrings": [x[0] for x in SUBSTRINGS], "_other": [x[0] for x in NO_PAYMENT], "_accord": ["Bon pour accord", "refus"]}
    # the texts are made once, though rules name them often
    rows = text.once(spread(spark, sf_dir, "orders").select(k), {n: among(k, each(k, v)) for n, v in said.items()})
    return rows.select(
        F.col(k).alias("doc_id"), classify.by_substrings(F.col("_substrings")).alias("by_substrings"), classify.other_type(F.col("_other")).alias("no_payment"), classify.from_fields(F.create_map(each(k, [x[0] for x in KEYED]), F.lit("1"))).alias("keyed"),
        classify.image_quality(*image).alias("image"), classify.accepted(F.col("_accord")).alias("accepted"), classify.band(each(k, [80, 60, 59])).alias("band"), forms.final_sheet_type(each(k, [x[0] for x in SHEETS]), each(k, [x[1] for x in SHEETS]), ["bom"], 2).alias("sheet"),
    )


PAYMENTS = [
    ("Chèque N° 1234567", "cheque", True, 0, 0, "duplicate"), ("Facture N° 1", "cheque", False, 0, 0, "other type"), ("Lettre de change", "cheque", False, 0, 0, "words of a draft"), ("Payez contre ce chèque", "traite", False, 0, 0, "words of a cheque"),
    ("Chèque N° 1234567", "traite", False, 0, 0, "is the other kind"), ("illisible", "cheque", False, 2, 9, "fields of a draft"), ("illisible", "cheque", False, 0, 2, "no sign of a cheque"), ("illisible", "cheque", False, 1, 3, "as wanted"), ("Chèque barré", None, False, 0, 0, "as found"), ("illisible", None, False, 0, 0, "unknown"),
]
ITEMS = [("Fiche article A1", "a.pdf", 0, "fiche_article"), ("Fiche article A1", "cheque_1.pdf", 0, "cheque"), ("Code article, échéance", "a", 2, "traite"), ("Total TTC 5", "a", 0, "facture"), ("Liste BOM 3", "a", 0, "nomenclature"), ("repère 1, niveau 2", "a", 0, "nomenclature"), ("rien", "a", 0, "inconnu")]
BILLS = [("Nomenclature, facture", None, "nomenclature"), ("facture de composant", None, "facture"), ("sku 1, part no 2", None, "fiche_article"), ("flou", "bom 3", "nomenclature"), ("flou", None, "inconnu")]
INVOICES = [("Subtotal 5", None, "facture"), ("Fiche article, facture", None, "fiche_article"), ("Devis N° 3, tva", None, "devis"), ("flou", "net a payer", "facture"), ("flou", None, "inconnu")]


@query(f"""
SELECT o_orderkey AS doc_id, {one_of("o_orderkey", [x[5] for x in PAYMENTS])} AS payment, {one_of("o_orderkey", [x[3] for x in ITEMS])} AS item, {one_of("o_orderkey", [x[2] for x in BILLS])} AS bill, {one_of("o_orderkey", [x[2] for x in INVOICES])} AS invoice FROM orders
""")
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "o_orderkey"
    of = lambda rows, n: each(k, [x[n] for x in rows])
    said = {"_payment": of(PAYMENTS, 0), "_item": of(ITEMS, 0), "_bill": of(BILLS, 0), "_bill2": of(BILLS, 1), "_invoice": of(INVOICES, 0), "_invoice2": of(INVOICES, 1)}
    # the texts are made once, though rules name them often
    rows = text.once(spread(spark, sf_dir, "orders").select(k), {n: among(k, v) for n, v in said.items()})
    t = lambda n: F.col(f"_{n}")
    return rows.select(
        F.col(k).alias("doc_id"), classify.payment_gate(t("payment"), *[of(PAYMENTS, n) for n in range(1, 5)])["reason"].alias("payment"), classify.item_gate(t("item"), of(ITEMS, 1), of(ITEMS, 2))["doc_type"].alias("item"),
        classify.bill_gate(t("bill"), t("bill2"))["doc_type"].alias("bill"), classify.invoice_gate(t("invoice"), t("invoice2"))["doc_type"].alias("invoice"),
    )


GROUPS = [("Catégorie : CONS", "Consommables"), ("Item Group : Peintures (bleu)", "Peintures"), ("fournitures de bureau", "Fournitures de bureau"), ("une perceuse", "Outillage"), ("Fiche technique : perceuse", None), ("rien", None)]


@query(f"SELECT p_partkey AS doc_id, {one_of('p_partkey', [g[1] for g in GROUPS])} AS item_group, 'R-' || p_partkey AS basic_code, (p_partkey + 0.5)::DOUBLE::VARCHAR AS basic_rate FROM part")
def item_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("Réf. : R-"), "p_partkey", F.lit("\nPrix : "), "p_partkey", F.lit(",5"))
    basic = sheets.basic_item(said)
    return spread(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), sheets.item_group(among("p_partkey", each("p_partkey", [g[0] for g in GROUPS]), False))["group"].alias("item_group"), basic["item_code"]["value"].alias("basic_code"), basic["standard_rate"]["value"].alias("basic_rate"))


#: By kind of value: what stands behind a label, and what must be read, around the part's key.
SAID = {"words": ("Valeur ", "", "'Valeur ' || k"), "line": ("Texte ", "", "'Texte ' || k"), "number": ("", ",5", "(k + 0.5)::DOUBLE::VARCHAR"), "code": ("C", "", "'C' || k"), "unit": ("kg", None, "'Kg'"), "digits": ("20000000", None, "'20000000'"), "count": ("24", None, "'24'"), "yes": ("Oui", None, "'1'"), "flag": ("", None, "'1'")}


@query("WITH p AS (SELECT p_partkey AS k FROM part) " + " UNION ALL ".join(f"SELECT k AS doc_id, '{n}' AS field, {SAID[kind][2]} AS value FROM p" for n, _, kind, _ in sheets.ITEM_LABELS))
def item_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def line(labels: list[str], kind: str) -> Column:
        start, end, _ = SAID[kind]
        label = labels[0].replace("?", "").replace(".", "")
        return F.concat(F.lit(f"{label} {start}"), F.col("p_partkey").cast("string") if end is not None else F.lit(""), F.lit(f"{end or ''}\n"))

    page = F.concat(*[line(labels, kind) for _, labels, kind, _ in sheets.ITEM_LABELS])
    found = spread(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), page.alias("page"))
    return found.select("doc_id", F.explode(sheets.by_labels(F.col("page"), sheets.ITEM_LABELS)).alias("field", "v")).select("doc_id", "field", F.col("v.value").alias("value"))


@query("""
SELECT p_partkey AS doc_id, 'BOM-' || lpad((p_partkey % 10000)::VARCHAR, 4, '0') || '-001' AS name, p_partkey::VARCHAR AS item, 'Châssis ' || p_partkey AS item_name, (1 + p_partkey % 9)::DOUBLE::VARCHAR AS quantity, 'Unité' AS uom, 'TND' AS currency, 'RT-' || p_partkey AS routing, 'Last Purchase Rate' AS basis, 'Work Order' AS transfer, '4.0' AS scrap, '1' AS is_default FROM part
""")
def bill_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    page = F.concat(F.lit("Article "), k, F.lit(" — Châssis "), k, F.lit("\nBOM-"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("-001\nGamme (Routing) RT-"), k, F.lit("\nQuantité produite "), 1 + k % 9, F.lit("\nUDM de l'article : pcs\nDevise : TND\nPrix basé sur dernier achat\nTransfert matériel ordre de fabrication\nTaux de perte processus 4 %\nPar défaut"))
    rows = spread(spark, sf_dir, "part").select(k.alias("doc_id"), sheets.bill_head(page).alias("f"))
    names = {"name": "name", "item": "item", "item_name": "item_name", "quantity": "quantity", "uom": "uom", "currency": "currency", "routing": "routing", "rm_cost_as_per": "basis", "transfer_material_against": "transfer", "scrap_percentage": "scrap", "is_default": "is_default"}
    return rows.select("doc_id", *[F.try_element_at("f", F.lit(a))["value"].alias(b) for a, b in names.items()])


@query("SELECT p_partkey AS doc_id, 'S' || p_partkey AS code, (p_partkey % 7 + 1)::DOUBLE AS safety_stock, (p_partkey % 5)::DOUBLE AS reorder_level FROM part UNION ALL SELECT p_partkey, 'T' || p_partkey, NULL, 9.0::DOUBLE FROM part")
def site_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    page = F.concat(F.lit("Fiche\nStock site : S"), k, F.lit("\nStock sécurité : "), k % 7 + 1, F.lit("\nSeuil de réappro : "), k % 5, F.lit("\nStock site : T"), k, F.lit("\nSeuil de réappro : 9"))
    return table(spark, sf_dir, "part").select(k.alias("doc_id"), F.inline(sheets.site_blocks(page))).select("doc_id", "code", "safety_stock", "reorder_level")


#: By type of document: a field, its label and the kind of its value.
HEADS = {
    "bon_commande": [("numero_commande", "Bon de commande N° : ", "CMD-{}"), ("fournisseur", "Fournisseur : ", "Alpha {}"), ("delai_livraison", "Délai : ", "15 jours")],
    "devis": [("numero_devis", "Devis N° : ", "DV-{}"), ("client", "Client : ", "Beta {}")],
    "bon_livraison": [("numero_bl", "Delivery note N° : ", "BLX-{}"), ("reference_commande", "Votre référence : ", "R{}"), ("quantite", "Quantité : ", "12 pcs")],
    "cheque": [("numero_cheque", "Chèque N° : ", "1234567"), ("titulaire_compte", "Titulaire : ", "Gamma {}"), ("banque", "Banque : ", "STB Sfax")],
    "traite": [("numero_traite", "Traite N° : ", "T{}"), ("tireur", "Tireur : ", "Delta {}"), ("date_emission", "Fait le : ", "05/04/2024")],
}


@query("WITH o AS (SELECT o_orderkey AS k FROM orders) " + " UNION ALL ".join(f"SELECT k AS doc_id, '{t}' AS doc_type, '{n}' AS field, {literal(v.split('{}')[0])}{' || k' if '{}' in v else ''} AS value FROM o" for t, fs in HEADS.items() for n, _, v in fs))
def typed_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, fs in HEADS.items():
        page = F.concat(*[F.concat(F.lit(label + v.split("{}")[0]), F.col("o_orderkey").cast("string") if "{}" in v else F.lit(""), F.lit("\n")) for _, label, v in fs])
        docs = spread(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), page.alias("text"))
        rows = fields.long_form(docs, t).where(F.col("field").isin([n for n, *_ in fs])).select("doc_id", F.lit(t).alias("doc_type"), "field", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""
SELECT o_orderkey AS doc_id, (1000000 + o_orderkey)::VARCHAR || 'ABM000' AS tax_id, '71 ' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') || ' 123' AS phone, '2' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') AS postcode, 'F-' || o_orderkey AS invoice, '05/04/2024' AS day, o_orderkey || ',500' AS total, '19,000' AS tax,
  'Alpha ' || o_orderkey || ' SARL' AS company, '12 rue du port' AS address, '100,00' AS net_role, '119,00' AS gross_role, '01/03/2024' AS due_role, 'Alpha ' || o_orderkey || ' SARL' AS firm, 1 AS n_firms FROM orders
""")
def tunisian_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    three = F.lpad((k % 1000).cast("string"), 3, "0")
    page = F.concat(F.lit("Alpha "), k, F.lit(" SARL\n12 rue du port\n2"), three, F.lit(" Tunis\nTél 71 "), three, F.lit(" 123\nMF "), k + 1000000, F.lit("ABM000\nFacture N° : F-"), k, F.lit("\nLe 05/04/2024\nTVA (19%) : 19,000\nTotal TTC : "), k, F.lit(",500 DT"))
    roles = fields.roles(F.lit("Total HT : 100,00 TVA : 19,00\nNet à payer 119,00"), "amount")
    days = fields.roles(F.lit("Date 01/02/2024 échéance 01/03/2024"), "date")
    found, more, some = fields.contacts(page), fields.tunisian_fields(page), fields.entities(page)
    return spread(spark, sf_dir, "orders").select(
        k.alias("doc_id"), found["tax_id"].alias("tax_id"), found["phone"].alias("phone"), found["postcode"].alias("postcode"), more["invoice"].alias("invoice"), more["date"].alias("day"), more["total"].alias("total"), more["tax"].alias("tax"), more["company"].alias("company"), more["address"].alias("address"),
        roles["montant_ht"].alias("net_role"), roles["montant_ttc"].alias("gross_role"), days["echeance"].alias("due_role"), F.get(some["companies"], 0).alias("firm"), F.size(some["companies"]).alias("n_firms"),
    )


@query("""
SELECT l_orderkey, l_linenumber, 'ABC' || l_partkey AS reference, 'Tube acier' AS designation, least(l_quantity, 10.5)::DOUBLE AS small, greatest(l_quantity, 10.5)::DOUBLE AS middle, round(l_extendedprice + 100, 2) AS total, CASE l_linenumber % 3 WHEN 0 THEN 'header' WHEN 1 THEN 'body' ELSE 'footer' END AS zone FROM lineitem
""")
def body_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.replace(F.replace(F.format_number(F.round(F.col("l_extendedprice") + 100, 2), 2), F.lit(","), F.lit("")), F.lit("."), F.lit(","))
    got = fields.body_line(F.concat(F.lit("ABC"), "l_partkey", F.lit(" | Tube acier | "), F.col("l_quantity").cast("int"), F.lit(" | 10,5 | "), total))
    top = each("l_linenumber", [10.0, 50.0, 90.0])
    rows = spread(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", got.alias("g"), fields.zone_of_line(top, top, F.lit(100.0)).alias("zone"))
    return rows.select("l_orderkey", "l_linenumber", "g.reference", "g.designation", F.col("g.quantity").alias("small"), F.col("g.price").alias("middle"), "g.total", "zone")


@query("""
SELECT o_orderkey AS doc_id, o_orderkey % 1000 + 1000 AS number, 1500.0::DOUBLE AS amount, DATE '2024-01-01' + (o_orderkey % 200)::INT AS emitted, DATE '2024-01-01' + (o_orderkey % 200)::INT + 90 AS due, 'Acier Tunisie SARL' AS drawer, 'BIAT' AS drawee, 'BIAT' AS bank, 'Sousse' AS town, TRUE AS accepted FROM orders
""")
def draft_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 200).cast("int"))
    page = F.concat(F.lit("Lettre de change\nTraite N° : T"), k % 1000 + 1000, F.lit("\nDate d'émission : "), F.date_format(day, "dd/MM/yyyy"), F.lit("\nÀ 90 jours\nMontant : 1 500,000 DT\nTireur : Acier Tunisie SARL\nTiré : BIAT Sousse\nBon pour accord"))
    docs = spread(spark, sf_dir, "orders").select(k.alias("doc_id"), page.alias("text"))
    got = payments.drafts(docs, F.lit("2024-06-01").cast("date"))
    return got.select("doc_id", F.regexp_extract("number", "(\\d+)$", 1).cast("long").alias("number"), "amount", "emitted", "due", "drawer", "drawee", "bank", "town", "accepted")


@query("""
SELECT s_suppkey AS doc_id, s_name AS supplier FROM supplier
""")
def supplier_from_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.translate("s_name", "#", " ").alias("name"))
    docs = s.select(F.col("s_suppkey").alias("doc_id"), F.concat(F.lit("Facture\nVendeur "), F.lower("name"), F.lit("\nTotal")).alias("text"))
    return forms.known_supplier(docs, s.select("name", F.col("s_suppkey").alias("ord"))).select("doc_id", F.replace("supplier", F.lit(" "), F.lit("#")).alias("supplier"))


@query("""
SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN n_name WHEN 2 THEN CASE WHEN length(n_name) >= 5 AND length(n_name) >= 0.6 * (length(n_name) + 2) THEN n_name END ELSE NULL END AS found FROM nation
""")
def contained_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumn("plain", F.regexp_replace("n_name", "[^A-Z]", ""))
    k = F.col("n_nationkey") % 4
    value = F.when(k == 0, F.col("n_name")).when(k == 1, F.lower("n_name")).when(k == 2, F.concat("n_name", F.lit(" xy"))).otherwise(F.concat(F.lit("q"), F.col("n_nationkey")))
    return resolve.contained_match(n.select(F.col("n_nationkey").alias("id"), value.alias("value")), n.select(F.col("n_name").alias("name"))).select("id", "found")


@query("""
SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 2 THEN NULL ELSE 'I' || p_partkey END AS item, p_partkey % 3 <> 2 AS exists, p_partkey % 3 <> 1 AS on_list FROM part
""")
def bill_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 3
    code = F.when(k == 0, F.concat(F.lit("I"), "p_partkey")).when(k == 1, F.concat(F.lit("nom"), "p_partkey")).otherwise(F.concat(F.lit("Z"), "p_partkey"))
    rows = p.select(F.col("p_partkey").alias("id"), code.alias("code"), F.concat(F.lit("K"), "p_partkey").alias("key"))
    items = p.where(k != 2).select(F.concat(F.lit("I"), "p_partkey").alias("id"), F.concat(F.lit("Tube NOM"), "p_partkey", F.lit(" acier")).alias("item_name"))
    listed = p.where(k != 1).select(F.concat(F.lit("K"), "p_partkey").alias("k"))
    found = resolve.item_or_like(rows.withColumnRenamed("id", "row"), items)
    return resolve.with_existence(found, listed, "key", "k", "on_list").select(F.col("row").alias("id"), "item", "exists", "on_list")


@query("SELECT 'RT-' || p_partkey AS routing FROM part WHERE p_partkey % 2 = 1")
def routings_to_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("RT-"), "p_partkey").alias("routing"), "p_partkey")
    return resolve.to_create(p.unionByName(p), p.where("p_partkey % 2 = 0").select(F.col("routing").alias("name")), "routing", "name")


@query("""
SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_name WHEN 2 THEN NULL ELSE NULL END AS resolved FROM customer
""")
def link_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey") % 4
    value = F.when(k == 0, F.col("c_name")).when(k == 1, F.lower("c_name")).when(k == 2, F.concat(F.lit("zz"), "c_name"))
    return forms.link_value(c.select(F.col("c_custkey").alias("id"), value.alias("value")), c.select(F.col("c_name").alias("id"))).select("id", "resolved")


@query("SELECT n_name AS label, n_name AS field FROM nation UNION ALL SELECT 'le ' || n_name, (SELECT max(m.n_name) FROM nation m WHERE contains(lower('le ' || nation.n_name), lower(m.n_name)) AND m.n_nationkey = (SELECT max(x.n_nationkey) FROM nation x WHERE contains(lower('le ' || nation.n_name), lower(x.n_name)))) FROM nation")
def field_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    labels = n.select(F.col("n_name").alias("label")).unionByName(n.select(F.concat(F.lit("le "), "n_name").alias("label")))
    return resolve.label_match(labels, n.select(F.col("n_name").alias("field"), F.col("n_nationkey").alias("ord"))).select("label", "field")


@query("""
SELECT o_orderkey AS doc_id, o_orderkey % 3 < 2 AS amount_fits, (CASE o_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.1 END)::DOUBLE AS amount_score, CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 0.85 END::DOUBLE AS date_score, TRUE AS text_fits, 1.0::DOUBLE AS field_score, 0.8::DOUBLE AS confidence, CASE WHEN o_orderkey % 2 = 0 THEN 0.3 ELSE 0.0 END::DOUBLE AS shape,
  100.0::DOUBLE AS ratio, 100.0::DOUBLE AS token_set, 100.0::DOUBLE AS token_sort, 100.0::DOUBLE AS part FROM orders
""")
def field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, even = F.col("o_orderkey"), F.col("o_orderkey") % 2 == 0
    number = F.concat(F.lit("FAC-"), k)
    amount = resolve.compatible(F.lit("montant_ttc"), F.lit("100"), each("o_orderkey", ["100.01", "104", "120"]))
    day = resolve.compatible(F.lit("date"), F.lit("15/04/2024"), F.when(even, "15/04/2024").otherwise("15/04/2023"))
    return spread(spark, sf_dir, "orders").select(
        k.alias("doc_id"), amount["compatible"].alias("amount_fits"), amount["score"].alias("amount_score"), day["score"].alias("date_score"), resolve.compatible(F.lit("fournisseur"), F.lit("Acier Tunisie"), F.lit("acier tunisie sarl"))["compatible"].alias("text_fits"),
        F.round(resolve.field_score(F.lit("numero_facture"), number, F.concat(F.lit("Facture "), number), number), 6).alias("field_score"), F.round(forms.field_confidence(F.lit("numero_facture"), number, F.concat(F.lit("x "), number)), 6).alias("confidence"),
        resolve.shape_score(F.lit("numero_cheque"), F.when(even, "123456").otherwise("x")).alias("shape"), fuzzy.ratio_of(number, number).alias("ratio"), fuzzy.token_set_ratio_of(F.concat(number, F.lit(" b a")), F.concat(F.lit("a "), number)).alias("token_set"),
        fuzzy.token_sort_ratio_of(F.concat(number, F.lit(" a")), F.concat(F.lit("a "), number)).alias("token_sort"), fuzzy.partial_ratio_of(number, F.concat(F.lit("xx "), number, F.lit(" yy"))).alias("part"),
    )


@query("SELECT c_custkey AS form_id, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE 'a' || c_custkey END AS candidate_id, CASE WHEN c_custkey % 3 = 2 THEN 'numero_facture' END AS blocking_field FROM customer")
def form_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.createDataFrame([("facture", k, f, f) for k, f in enumerate(["numero_facture", "date", "fournisseur", "montant_ttc"])], "doc_type string, ord int, field string, name string")
    k = F.col("c_custkey")
    number = F.concat(F.lit("FAC-"), k)
    entry = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    good = entry("numero_facture", number, "date", "01/02/2024", "fournisseur", "Acier")
    c = table(spark, sf_dir, "customer")
    first = c.select(k.alias("form_id"), F.concat(F.lit("a"), k).alias("candidate_id"), F.lit(0.9).alias("confidence"), F.lit("facture").alias("doc_type"), F.concat(number, F.lit(" 01/02/2024 Acier")).alias("text"), F.when(k % 3 == 2, entry("numero_facture", "??")).otherwise(good).alias("fields"))
    second = c.where(k % 3 != 2).select(k.alias("form_id"), F.concat(F.lit("b"), k).alias("candidate_id"), F.lit(0.8).alias("confidence"), F.lit("facture").alias("doc_type"), number.alias("text"), entry("numero_facture", number).alias("fields"))
    wanted = c.select(k.alias("form_id"), entry("numero_facture", F.when(k % 3 == 2, "Z9").otherwise(number)).alias("values"))
    return resolve.best_candidate(first.unionByName(second), mapping, wanted).select("form_id", "candidate_id", "blocking_field")


@query("SELECT o_orderkey AS doc_id, 'Alpha SARL' AS supplier, '05/04/2024' AS day, '200,00' AS gross, 0.4::DOUBLE AS confidence, 'F-' || o_orderkey AS number FROM orders")
def enriched_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = F.create_map(F.lit("numero_facture"), F.concat(F.lit("F-"), "o_orderkey"))
    entities = F.struct(F.array(F.lit("05/04/2024")).alias("dates"), F.array(F.lit("100,00"), F.lit("200,00")).alias("amounts"), F.array(F.lit("AB-1")).alias("references"), F.array(F.lit("Alpha SARL")).alias("companies"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), resolve.enriched(have, entities).alias("e"))
    return rows.select("doc_id", F.col("e")["fournisseur"]["value"].alias("supplier"), F.col("e")["date"]["value"].alias("day"), F.col("e")["montant_ttc"]["value"].alias("gross"), F.col("e")["montant_ttc"]["confidence"].alias("confidence"), F.col("e")["numero_facture"]["value"].alias("number"))


@query("""
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, round(o_totalprice, 2) AS n FROM orders)
SELECT k AS doc_id, CASE WHEN k % 3 = 1 THEN round(round(n + 19, 2) - 19, 3) ELSE n END AS net, CASE WHEN k % 2 = 0 THEN n WHEN k % 5 = 0 THEN 0.0 ELSE round(round(n + 19, 2) - 19, 3) END::DOUBLE AS form_net, CASE WHEN k % 5 <> 0 THEN 19.0 WHEN k % 2 = 0 THEN round(round(n + 19, 2) - n, 3) ELSE 0.0 END::DOUBLE AS form_tax,
  CASE WHEN c % 9 > 0 THEN 100 * (k % 7) // (c % 9) ELSE k % 100 END::INT AS share, CASE WHEN c % 9 > 0 THEN 100 * (k % 7) // (c % 9) ELSE k % 100 END >= 30 AS applied, CASE WHEN k % 4 = 0 THEN NULL ELSE 'b' || k END AS alias, CASE WHEN k % 3 = 0 THEN 'x' || c ELSE 'b' || k END AS first,
  CASE WHEN k % 6 >= 3 THEN 'Validé' ELSE 'Validation requise' END AS status, CASE k % 5 WHEN 0 THEN (k + 0.5)::DOUBLE::VARCHAR WHEN 1 THEN k::VARCHAR WHEN 2 THEN (DATE '2024-01-01' + (c % 300)::INT)::VARCHAR WHEN 3 THEN CASE WHEN c % 2 = 0 THEN '1' ELSE '0' END ELSE 'mot ' || k END AS coerced,
  CASE k % 3 WHEN 0 THEN n * 2 ELSE n END::DOUBLE AS merged_gross FROM o
""")
def check_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c, n = F.col("o_orderkey"), F.col("o_custkey"), F.round("o_totalprice", 2)
    gross = F.round(n + 19, 2)
    net = checks.net_amount(F.when(k % 3 == 0, n).otherwise(0.0), F.when(k % 3 == 1, gross).otherwise(n), F.when(k % 3 == 1, 19.0).otherwise(0.0))
    form = checks.derived_on_form(F.when(k % 2 == 0, n).otherwise(0.0), F.when(k % 5 == 0, 0.0).otherwise(19.0), gross)
    share = checks.matched_share(k % 7, c % 9, k % 100)
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    fields = F.map_from_arrays(F.array(F.when(k % 2 == 0, "x").otherwise("y")), F.array(F.when(k % 4 == 0, "").otherwise(said("b", k))))
    kind = each("o_orderkey", ["Float", "Int", "Date", "Check", "Data"])
    value = F.when(k % 5 == 0, said(k, ",50")).when(k % 5 == 1, said(k, ",00")).when(k % 5 == 2, F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (c % 300).cast("int")), "dd/MM/yyyy")).when(k % 5 == 3, F.when(c % 2 == 0, " Oui").otherwise("non")).otherwise(said(" mot ", k))
    reading = lambda g: F.struct(F.lit(None).cast("double").alias("net"), F.lit(None).cast("double").alias("tax"), g.alias("gross"))
    other = F.when(k % 3 == 0, n * 2).when(k % 3 == 1, n * 1000)
    return spread(spark, sf_dir, "orders").select(
        k.alias("doc_id"), net.alias("net"), form["net"].alias("form_net"), form["tax"].alias("form_tax"), share["confidence"].alias("share"), share["applied"].alias("applied"), checks.first_present(fields, ["x", "y"]).alias("alias"),
        checks.precedence(F.lit(""), F.when(k % 3 == 0, said("x", c)).otherwise("0"), said("b", k)).alias("first"), checks.final_status(k % 6).alias("status"), checks.coerced(kind, value).alias("coerced"), checks.merged_totals(reading(n), reading(other))["gross"].alias("merged_gross"),
    )


@query("""
SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus IN ('F', 'P') AND o_orderkey % 2 = 0 THEN CASE o_orderstatus WHEN 'F' THEN 'Validé' ELSE 'Rejeté' END WHEN o_orderkey % 2 = 0 THEN 'En attente' ELSE 'Validé' END AS guarded, CASE WHEN o_orderkey % 2 = 0 THEN 'Validé' ELSE 'Validation requise' END AS completed,
  o_orderkey % 2 = 0 AS may_save, o_orderkey % 3 <> 0 AS row_complete, 'OLD' AS code, CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '0' END AS flag, CASE o_orderkey % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 7.0 ELSE 9.0 END::DOUBLE AS paid, CASE WHEN o_orderkey % 2 = 0 THEN ['item_name'] ELSE []::VARCHAR[] END AS missing FROM orders
""")
def form_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    even = k % 2 == 0
    old = F.when(F.col("o_orderstatus") == "O", V.PENDING).when(F.col("o_orderstatus") == "F", V.VALID).otherwise(V.REJECTED)
    links = F.array(F.struct(F.lit("x").alias("value"), even.alias("resolved")), F.struct(F.lit("").alias("value"), F.lit(False).alias("resolved")))
    item = F.create_map(F.lit("item_code"), F.lit("A"), F.lit("item_name"), F.when(even, "").otherwise("B"))
    return spread(spark, sf_dir, "orders").select(
        k.alias("doc_id"), documents.guarded_status(old, F.when(even, V.PENDING).otherwise(V.VALID)).alias("guarded"), forms.completed(F.lit(V.TO_CHECK), F.when(even, 0).otherwise(1)).alias("completed"), forms.may_save(links).alias("may_save"),
        forms.row_complete(F.lit("A"), F.lit("Kg"), (k % 3).cast("double")).alias("row_complete"), forms.item_value(F.lit("text"), F.lit("OLD"), F.lit("NEW"), F.lit(True)).alias("code"), forms.item_value(F.lit("check"), F.lit(""), F.when(even, "Oui").otherwise("Non"), F.lit(False)).alias("flag"),
        documents.payment_amount(F.when(k % 3 == 0, 5.0), F.when(k % 3 == 1, 7.0).otherwise(0.0), F.lit(9.0)).alias("paid"), forms.missing_on_item(item, ["item_code", "item_name", "item_group"], "item_group").alias("missing"),
    )


@query("""
WITH d AS (SELECT c_custkey AS name, 'objet n' || c_custkey || ' du dossier' AS said FROM customer), e AS (SELECT 'E' || c_custkey AS entry, 'n' || c_custkey AS bill_no FROM customer WHERE c_custkey % 2 = 1)
SELECT c_custkey AS name, 'Purchase Invoice' AS doctype, 'E' || c_custkey AS entry, FALSE AS by_number FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT name, 'Purchase Invoice', entry, TRUE FROM d JOIN e ON contains(said, bill_no) QUALIFY row_number() OVER (PARTITION BY entry ORDER BY name) <= 5
""")
def linked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, odd = table(spark, sf_dir, "customer"), F.col("c_custkey") % 2 == 1
    docs = c.select(F.col("c_custkey").alias("name"), F.when(~odd, "Purchase Invoice").alias("linked_doctype"), F.when(~odd, F.concat(F.lit("E"), "c_custkey")).alias("linked_docname"), F.create_map(F.lit("memo"), F.concat(F.lit("objet n"), "c_custkey", F.lit(" du dossier"))).alias("fields"))
    entries = c.select(F.lit("Purchase Invoice").alias("doctype"), F.concat(F.lit("E"), "c_custkey").alias("entry"), F.concat(F.lit("n"), "c_custkey").alias("bill_no"))
    return documents.linked(docs, entries)


@query("SELECT c_custkey AS name, CASE WHEN c_custkey % 2 = 0 THEN 'Purchase Invoice' END AS linked_doctype, CASE WHEN c_custkey % 2 = 0 THEN 'E' || c_custkey END AS linked_docname FROM customer")
def saved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    docs = c.select(F.col("c_custkey").alias("name"), F.lit(None).cast("string").alias("linked_doctype"), F.lit(None).cast("string").alias("linked_docname"))
    saved = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("name"), F.lit("Purchase Invoice").alias("doctype"), F.concat(F.lit("E"), "c_custkey").alias("entry"))
    return forms.linked_back(docs, saved)


@query("SELECT s_name AS name, 'supplier' AS kind FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT c_name, 'customer' FROM customer WHERE c_custkey % 3 <> 0")
def active_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = lambda c: F.when(F.col(c) % 3 == 0, 1).otherwise(0).alias("disabled")
    return documents.parties(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), off("s_suppkey")), table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), off("c_custkey")))


@query("SELECT o_orderkey AS name FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0")
def pending_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"), F.when(F.col("o_orderstatus") == "O", V.PENDING).otherwise(V.VALID).alias("status"), F.when(F.col("o_orderkey") % 2 == 0, "/files/a.pdf").otherwise("").alias("file_url"))
    return documents.pending(docs).select("name")


@query("SELECT l_orderkey AS doc_id, l_returnflag AS role, min_by(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) AS value FROM lineitem GROUP BY ALL")
def first_of_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("role"), F.col("l_partkey").alias("value"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey")).alias("place"))
    return documents.first_per_role(rows, "doc_id", "role", "value", "place")


@query("SELECT r_name AS name FROM region WHERE r_regionkey % 2 = 1")
def seed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    return documents.missing_rows(r.select(F.col("r_name").alias("name")), r.where("r_regionkey % 2 = 0").select(F.col("r_name").alias("name")), "name")


@query("SELECT l_suppkey AS vehicle, CASE WHEN arg_max(l_returnflag, l_orderkey * 100 + l_linenumber) = 'R' THEN 'Disponible' ELSE 'En mission' END AS status FROM lineitem GROUP BY 1")
def vehicle_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("vehicle"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("at"), F.when(F.col("l_returnflag") == "R", "cancel").otherwise("submit").alias("kind"))
    return fleet.status_after(events)


@query("""
WITH taken AS (SELECT DISTINCT l_suppkey AS s FROM lineitem WHERE l_returnflag <> 'A' AND l_shipdate < TIMESTAMP '1995-06-17 12:00:00' AND l_shipdate + INTERVAL 2 DAY > TIMESTAMP '1995-06-17')
SELECT count(*) AS n FROM supplier WHERE s_nationkey % 5 <> 0 AND s_suppkey NOT IN (SELECT s FROM taken)
""")
def available_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    vehicles = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), F.col("s_name").alias("plate"), F.lit("").alias("make"), F.lit("").alias("model"), F.when(F.col("s_nationkey") % 5 == 0, "Hors service").otherwise("Disponible").alias("status"))
    bookings = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_suppkey").alias("vehicle"), F.col("l_shipdate").alias("start"), (F.col("l_shipdate") + F.expr("INTERVAL 2 DAY")).alias("end"), F.when(F.col("l_returnflag") == "A", "Terminée").otherwise("Confirmée").alias("status"))
    at = lambda s: F.lit(s).cast(bookings.schema["start"].dataType)
    return fleet.available(vehicles, bookings, at("1995-06-17"), at("1995-06-17 12:00:00"), n=None).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS name, round(o_totalprice, 2) AS rate, CASE WHEN o_orderkey % 2 = 0 THEN 19.0 END::DOUBLE AS tax FROM orders")
def posted_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"), F.lit("x").alias("supplier"), F.lit("n").alias("bill_no"), F.col("o_orderdate").alias("bill_date"), F.round("o_totalprice", 2).alias("net_total"), F.when(F.col("o_orderkey") % 2 == 0, 19.0).otherwise(0.0).alias("tax"), F.lit(0.0).alias("grand_total"))
    return documents.posted_invoice(docs).select("name", F.get("items", 0)["rate"].alias("rate"), F.get("taxes", 0)["tax_amount"].alias("tax"))


@query("SELECT l_orderkey::VARCHAR AS file, string_agg('P' || l_partkey || chr(10) || 'Part ' || l_partkey, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS words FROM lineitem GROUP BY l_orderkey")
def sheet_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.concat(F.lit("Nomenclature\nRéférence\nBOM-"), "file", F.lit("\nCode article\nDésignation\nQuantité\nPrix\n"))
    return grid.sheet_text(order_cells(spark, sf_dir)).select("file", F.replace("text", head, F.lit("")).alias("words"))


@query("SELECT p_partkey AS id, (p_partkey + 0.5)::DOUBLE::VARCHAR AS number, CASE WHEN p_partkey % 2 = 0 THEN '1' ELSE '0' END AS flag, 'x ' || p_partkey AS words FROM part")
def cell_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    of = lambda name, v: grid.cell_value(F.lit(name), v, ["qty"], ["active"])
    return table(spark, sf_dir, "part").select(k.alias("id"), of("qty", F.concat(k.cast("string"), F.lit(",5"))).alias("number"), of("active", F.when(k % 2 == 0, "Oui").otherwise("non")).alias("flag"), of("name", F.concat(F.lit(" x "), k, F.lit(" "))).alias("words"))


@query("SELECT o_orderkey AS doc_id, idx::INT AS idx, 'P' || (o_custkey + idx) AS item_code, 'Tube acier' AS item_name, 2.5::DOUBLE AS qty, 'Kg' AS uom, 3.0::DOUBLE AS qty_per_unit, 'Unité' AS stock_uom, 1.5::DOUBLE AS conversion_factor, CASE WHEN o_orderkey % 2 = 0 THEN 9.0 ELSE 0.0 END::DOUBLE AS rate FROM orders, (SELECT unnest([1, 2]) AS idx)")
def component_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    row = lambda i, end: F.concat(F.lit(f"{i} P"), c + i, F.lit(f" Tube acier 2,5 Kg 3 Unité 1,5{end}"))
    page = F.when(k % 2 == 0, F.concat(F.lit("Nomenclature\nComposants\n"), row(1, " 9"), F.lit("\n"), row(2, " 9"), F.lit("\nRésumé des coûts\n1 X9 Fin 1 Kg 1 Kg 1 1")))
    page = page.otherwise(F.concat(F.lit("Composants\n1\nP"), c + 1, F.lit("\nTube acier\n2,5 Kg\n3 Unité\n1,5 "), row(2, "")))
    return sheets.components(spread(spark, sf_dir, "orders").select(k.alias("doc_id"), page.alias("text")))


@query("""
WITH o AS (SELECT o_orderkey AS doc_id, 1000.0 + o_orderkey % 500 AS n FROM orders)
SELECT doc_id, n AS net, CASE doc_id % 4 WHEN 0 THEN 100.0 WHEN 1 THEN 100.0 WHEN 2 THEN 200.0 ELSE 50.0 END::DOUBLE AS tax, CASE doc_id % 4 WHEN 0 THEN n + 100.6 WHEN 1 THEN n + 100.0 WHEN 2 THEN n + 200.0 ELSE n + 50.0 END AS gross FROM o
""")
def total_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("o_orderkey"), 1000 + F.col("o_orderkey") % 500
    num = lambda c: F.replace(F.format_string("%.3f", c.cast("double")), F.lit("."), F.lit(","))
    stamped = F.concat(F.lit("Total HT "), num(n), F.lit("\nBase TVA "), num(n), F.lit("\nTVA 100,000\nTimbre 0,600\nTél 71 999 999"))
    beside = F.concat(F.lit("Total HT\n"), num(n), F.lit("\nTVA\n100,000"))
    spaced = lambda c: F.translate(F.format_number(c.cast("double"), 2), ",.", " ,")
    largest = F.concat(F.lit("articles "), spaced(n), F.lit("\nfin "), spaced(n + 200))
    levied = F.concat(F.lit("Total TTC "), num(n + 50), F.lit("\nTVA 50,000\nRIB 12345678901234567890"))
    page = F.when(k % 4 == 0, stamped).when(k % 4 == 1, beside).when(k % 4 == 2, largest).otherwise(levied)
    return sheets.totals(spread(spark, sf_dir, "orders").select(k.alias("doc_id"), page.alias("text")))


@query("SELECT p_partkey::VARCHAR AS file, 'item_code' AS field, 'A' || p_partkey AS value FROM part UNION ALL SELECT p_partkey::VARCHAR, 'item_name', 'Nom ' || p_partkey FROM part UNION ALL SELECT p_partkey::VARCHAR, 'item_group', 'CONS' FROM part")
def item_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    rows = [["Article :", F.concat(F.lit("old"), k), "Désignation", F.concat(F.lit("Nom "), k)], ["Article :", F.concat(F.lit("A"), k), "Code", F.lit("B")], ["Catégorie", F.lit("CONS"), "Famille", F.lit("")]]
    cells = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), (F.lit(v) if isinstance(v, str) else v).alias("v")) for r, row in enumerate(rows) for c, v in enumerate(row)])
    sheet = table(spark, sf_dir, "part").select(k.alias("file"), F.lit("Fiche").alias("sheet"), F.inline(cells))
    aliases = spark.createDataFrame([("article", "item_code", 0), ("code", "item_code", 1), ("désignation", "item_name", 0), ("famille", "item_group", 0), ("catégorie", "item_group", 1)], "alias string, field string, ord int")
    return grid.label_pairs(sheet, aliases).select("file", "field", "value")


@query("SELECT p_partkey::VARCHAR AS file, 'S' || n AS code, 'Site ' || n AS label, (p_partkey % 7 + n)::VARCHAR AS safety_stock FROM part, (SELECT unnest([1, 2]) AS n)")
def site_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = [["Stock par site", "", ""], ["Site", "Nom site", "Stock sécurité"], ["S1", "Site 1", (k % 7 + 1).cast("string")], ["", "x", "9"], ["S2", "Site 2", (k % 7 + 2).cast("string")]]
    cells = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), (F.lit(v) if isinstance(v, str) else v).alias("v")) for r, row in enumerate(rows) for c, v in enumerate(row)])
    sheet = table(spark, sf_dir, "part").select(k.cast("string").alias("file"), F.lit("Sites").alias("sheet"), F.inline(cells))
    found = grid.site_table(sheet, [("code", ["site", "code"]), ("label", ["nom site", "nom", "label"]), ("safety_stock", ["sécurité", "securite"])])
    return found.select("file", *[F.try_element_at("values", F.lit(f)).alias(f) for f in ("code", "label", "safety_stock")])


@query("""
SELECT o_orderkey AS name, CASE WHEN o_orderkey % 5 = 0 THEN 'Rejeté' WHEN o_orderkey % 7 = 0 THEN 'Validation requise' ELSE 'Validé' END AS status FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F'
""")
def worker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spread(spark, sf_dir, "orders")
    pages = invoices.render(o, table(spark, sf_dir, "customer"))
    docs = o.select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "O", V.PENDING).when(F.col("o_orderstatus") == "P", V.RUNNING).otherwise(V.VALID).alias("status")).join(pages, "doc_id")
    docs = docs.select(F.col("doc_id").alias("name"), F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("text")).alias("text"), "status")
    return worker.worked(docs).select("name", "status")


MAGIC = [("pdf", "255044462D312E34", "pdf"), ("bin", "89504E470D0A1A0A", "png"), ("tmp", "FFD8FFE000104A46", "jpg"), ("XLSX", "0000000000000000", "xlsx"), ("doc", "0000000000000000", None)]


@query(f"""
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders),
e AS (SELECT k, c, CASE WHEN k % 101 > 50 THEN 'pdf_text' WHEN k % 41 > 20 THEN 'fast' WHEN c % 13 > greatest(k % 41, c % 7) THEN 'paddle' ELSE 'slow' END AS engine FROM o)
SELECT k AS id, {one_of("k", [m[2] for m in MAGIC])} AS kind, CASE WHEN c % 4096 < 2048 THEN 'too small' WHEN k % 5 = 4 THEN 'unknown type' END AS refused, engine, CASE engine WHEN 'pdf_text' THEN 95 WHEN 'fast' THEN 75 WHEN 'paddle' THEN 85 ELSE 65 END AS score FROM e
""")
def upload_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    words = lambda n: F.array_join(F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: F.when(i > 0, F.concat(F.lit("mot"), i)).otherwise("")), " ")
    # other bytes behind the first ones that tell the format
    content = F.concat(F.unhex(each("o_orderkey", [m[1] for m in MAGIC])), F.unhex(F.md5(k.cast("string"))))
    rows = spread(spark, sf_dir, "orders").select(
        k.alias("id"), F.concat(F.lit("/in/f."), k, F.lit("."), each("o_orderkey", [m[0] for m in MAGIC])).alias("path"), content.alias("content"), (c % 4096).cast("long").alias("length"),
        F.repeat(F.lit("x"), (k % 101).cast("int")).alias("pdf_text"), words(k % 41).alias("fast_text"), words(c % 7).alias("sharp_text"), words(c % 13).alias("other_text"),
    )
    return files.chosen_text(files.intake(rows)).select("id", "kind", "refused", "engine", F.col("ocr_score").alias("score"))


@query("SELECT md5('c' || (o_custkey % 50)) AS file_hash FROM orders WHERE o_custkey % 50 >= 10 GROUP BY 1")
def unseen_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("n"))
    found = o.select(F.concat(F.lit("c"), "n").cast("binary").alias("content"))
    seen = o.where("n < 10").select(F.md5(F.concat(F.lit("c"), "n").cast("binary")).alias("file_hash"))
    return files.unseen(found, seen).select("file_hash")


@query("SELECT s_suppkey AS id, CASE s_nationkey % 3 WHEN 0 THEN 'own' WHEN 1 THEN 'group' ELSE 'company' END || (s_nationkey % 5) AS account FROM supplier")
def cascaded_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("s_nationkey") % 5, F.col("s_nationkey") % 3
    key = lambda on, name: F.when(on, F.concat(F.lit(name), n))
    docs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id_"), key(k == 0, "own").alias("own"), key(k == 1, "group").alias("grp"), F.concat(F.lit("company"), n).alias("company"))
    accounts = spark.range(5).select(F.explode(F.array(*[F.concat(F.lit(x), F.col("id")) for x in ("own", "group", "company")])).alias("id")).withColumn("key", F.col("id"))
    return resolve.by_priority(docs, accounts, [("own", "key"), ("grp", "key"), ("company", "key")], "account").select(F.col("id_").alias("id"), "account")
