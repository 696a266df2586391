"""Registered queries of the reference's own operators and the SQL that checks them.

Where the driver's tables have no documents of a kind, they are rendered from base columns, and the SQL
computes what must be recovered straight from those columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import dates, numbers, text
from docloom.functions import vocabulary as V
from docloom.operators import checks, classify, documents, fields, fleet, forms, grid, payments, resolve, sheets
from docloom.plans import invoices
from docloom.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.read(spark, sf_dir, name)


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows' texts are long work."""
    return tables.spread(table(spark, sf_dir, name))


def together(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """A table by keys, where each row gives many."""
    return tables.together(table(spark, sf_dir, name), *keys)


NET = "o_totalprice::DECIMAL(18,3)"
TAX = f"({NET} * 0.19::DECIMAL(3,2))::DECIMAL(18,3)"


@query(f"""
SELECT o_orderkey AS doc_id, 'facture' AS doc_type, 'FAC-' || strftime(o_orderdate, '%Y') || '-' || lpad(o_orderkey::VARCHAR, greatest(5, length(o_orderkey::VARCHAR))::INT, '0') AS bill_no,
  o_orderdate::DATE AS bill_date, o_orderdate::DATE + 30 AS due_date, c_name || ' SARL' AS supplier, ({NET})::DOUBLE AS net,
  (CASE WHEN o_orderkey % 7 = 0 AND {TAX} < 0.98 * ({TAX} + 0.6) THEN {TAX} + 0.6 ELSE {TAX} END)::DOUBLE AS tax,
  ({NET} + {TAX} + CASE WHEN o_orderkey % 7 = 0 THEN 0.6 ELSE 0 END)::DOUBLE AS gross,
  CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS n_errors, CASE WHEN o_orderkey % 7 = 0 THEN 'validation_requise' ELSE 'valide' END AS status
FROM orders JOIN customer ON o_custkey = c_custkey
""")
def invoice_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invoices.read(invoices.render(spread(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")))


KINDS = ["Facture N° 12", "Bon de commande N° 7", "Devis N° 3", "Bon de livraison N° 9", "Facture de vente 4", "Chèque N° 12345", "Lettre de change", "Bonjour"]


@query("""
SELECT o_orderkey AS doc_id, ['facture', 'bon_commande', 'devis', 'bon_livraison', 'facture_vente', 'cheque', 'traite', 'inconnu'][1 + o_orderkey % 8] AS doc_type,
  ['facture', 'bon_commande', 'devis', 'bon_livraison', 'facture_vente', 'inconnu', 'inconnu', 'inconnu'][1 + o_orderkey % 8] AS by_words,
  CASE o_orderkey % 8 WHEN 5 THEN 'cheque' WHEN 6 THEN 'traite' ELSE 'inconnu' END AS payment FROM orders
""")
def doc_type_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array(*map(F.lit, KINDS))[(F.col("o_orderkey") % 8).cast("int")]
    docs = spread(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), said.alias("text"))
    return docs.select("doc_id", classify.by_patterns(F.col("text")).alias("doc_type"), classify.by_weighted_words(F.col("text"))["doc_type"].alias("by_words"), classify.cheque_or_draft(F.col("text"))["doc_type"].alias("payment"))


@query("""
SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS nlp, round(l_extendedprice, 2) AS pipeline, round(l_extendedprice, 2) AS typed, round(l_extendedprice, 2) AS bom, round(l_extendedprice, 2) AS cell, round(l_extendedprice, 2) AS payment, round(l_extendedprice, 2) AS api FROM lineitem
""")
def amount_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.format_number(F.round("l_extendedprice", 2), 2)
    spaced = F.translate(s, ",.", " ,")
    dotted = F.translate(s, ",.", ".,")
    out = {"nlp": F.concat(spaced, F.lit(" TND")), "pipeline": F.concat(spaced, F.lit(" DT")), "typed": dotted, "bom": dotted, "cell": s, "payment": dotted, "api": spaced}
    return spread(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[numbers.amount(v, k).alias(k) for k, v in out.items()])


DIGITS = ["deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"]


@query("""
SELECT o_orderkey AS doc_id, ((2 + o_orderkey % 8) * 1000 + (2 + o_custkey % 8) * 100 + 70 + (2 + o_orderkey % 7) + (2 + o_custkey % 5) / 1000.0)::DOUBLE AS amount FROM orders
""")
def amount_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = lambda c: F.array(*map(F.lit, DIGITS))[c.cast("int")]
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    said = F.concat(F.lit("la somme de "), word(k % 8), F.lit(" mille "), word(c % 8), F.lit(" cent soixante-dix "), word(k % 7), F.lit(" dinars et "), word(c % 5), F.lit(" millimes"))
    return spread(spark, sf_dir, "orders").select(k.alias("doc_id"), numbers.amount_in_words(said).alias("amount"))


@query("SELECT o_orderkey AS doc_id, o_orderdate::DATE AS slashed, o_orderdate::DATE AS named, o_orderdate::DATE AS iso, o_orderdate::DATE AS typed, CASE WHEN (o_orderkey % 2) = 0 THEN NULL ELSE o_orderdate::DATE END AS impossible, (DATE '2000-01-01' - o_orderdate::DATE) > 365 AS stale FROM orders")
def date_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    month = F.element_at(F.array(*[F.lit(m) for m in ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")]), F.month(d))
    named = F.concat_ws(" ", F.dayofmonth(d), month, F.year(d))
    odd = F.when(F.col("o_orderkey") % 2 == 0, "31/02/2024").otherwise(F.date_format(d, "dd-MM-yyyy"))
    return spread(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), dates.normalised(F.date_format(d, "dd/MM/yyyy")).alias("slashed"), dates.normalised(named).alias("named"), dates.normalised(F.date_format(d, "yyyy-MM-dd")).alias("iso"), dates.typed(F.date_format(d, "dd.MM.yyyy")).alias("typed"), dates.normalised(odd).alias("impossible"), dates.stale_hard(d.cast("date"), F.lit("2000-01-01").cast("date")).alias("stale"))


@query("""
WITH t AS (SELECT o_orderkey AS doc_id, o_totalprice::DECIMAL(18,2) AS n, (o_totalprice::DECIMAL(18,2) * 0.25::DECIMAL(3,2))::DECIMAL(18,2) AS t FROM orders),
b AS (SELECT doc_id, n::DOUBLE AS n, t::DOUBLE AS t, (n + t)::DOUBLE AS g FROM t)
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN round(g - t, 3) ELSE n END AS net, CASE WHEN doc_id % 4 IN (1, 2) THEN round(g - n, 3) ELSE t END AS tax, g AS gross FROM b
""")
def totals_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderkey") % 4
    t = (n * F.lit("0.25").cast("decimal(3,2)")).cast("decimal(18,2)")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(k != 0, n).cast("double").alias("net"), F.when(k == 1, None).when(k == 2, n).otherwise(t).cast("double").alias("tax"), (n + t).cast("double").alias("gross"))
    return checks.reconciled(rows).select("doc_id", "net", "tax", "gross")


@query("""
SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN ['date', 'montant_ttc'] WHEN 1 THEN ['montant_ttc'] ELSE []::VARCHAR[] END AS missing FROM orders
""")
def mandatory_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    f = F.map_from_arrays(F.array(F.lit("numero_facture"), F.lit("date"), F.lit("fournisseur"), F.lit("montant_ttc")), F.array(F.lit("F1"), F.when(k == 0, "").otherwise("01/02/2024"), F.lit("X"), F.when(k == 2, "5").otherwise(F.lit(None))))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), checks.missing_fields(F.lit("facture"), f).alias("missing"))


STORED = """WITH d AS (SELECT 'DOC-' || o_orderkey AS name, 'facture_' || o_custkey || '.pdf' AS document_name, CASE o_orderstatus WHEN 'O' THEN 'En attente' WHEN 'F' THEN 'Validé' ELSE 'Rejeté' END AS status, o_orderdate AS creation, o_totalprice AS confidence_score, o_orderkey AS k, o_custkey AS c FROM orders)"""


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", V.PENDING).when(F.col("o_orderstatus") == "F", V.VALID).otherwise(V.REJECTED)
    return o.select(F.concat(F.lit("DOC-"), "o_orderkey").alias("name"), F.concat(F.lit("facture_"), "o_custkey", F.lit(".pdf")).alias("document_name"), status.alias("status"), F.col("o_orderdate").alias("creation"), F.col("o_totalprice").alias("confidence_score"), F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))


@query(STORED + "SELECT count(*) AS total, count(*) FILTER (status = 'En attente') AS pending, count(*) FILTER (status = 'En cours') AS running, count(*) FILTER (status = 'Validé') AS valid, count(*) FILTER (status = 'Rejeté') AS rejected FROM d")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.status_counts(stored(spark, sf_dir))


@query(STORED + "SELECT name, creation FROM d ORDER BY creation DESC, name DESC LIMIT 100")
def document_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.history(stored(spark, sf_dir)).select("name", "creation")


@query(STORED + "SELECT document_name, name, creation FROM d QUALIFY row_number() OVER (PARTITION BY document_name ORDER BY creation DESC, name DESC) = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.latest_per(stored(spark, sf_dir).select("document_name", "name", "creation"), "document_name", "creation", "name")


@query(STORED + "SELECT document_name, name, confidence_score, (row_number() OVER (PARTITION BY document_name ORDER BY confidence_score DESC, name))::INT AS rank FROM d QUALIFY rank <= 20")
def candidate_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.top_per(stored(spark, sf_dir), "document_name", "confidence_score", "name").select("document_name", "name", "confidence_score", "rank")


@query(STORED + "SELECT c, status FROM (SELECT c, status, count(*) n, min(k) f FROM d GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC, f) = 1")
def mode_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.most_frequent(stored(spark, sf_dir), "c", "status", "k")


@query("""
WITH e AS (SELECT o_custkey AS reference, min(o_orderkey) AS first FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT c_custkey AS doc_id, first AS duplicate_of, first IS NOT NULL AS is_duplicate FROM customer LEFT JOIN e ON reference = c_custkey
""")
def duplicate_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_custkey").alias("reference"))
    books = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"), F.col("o_custkey").alias("reference"), F.when(F.col("o_orderstatus") == "P", 2).otherwise(1).alias("docstatus"))
    return documents.duplicates(new, books, "reference").select("doc_id", "duplicate_of", "is_duplicate")


@query(STORED + """
SELECT name, status AS old, n AS new FROM (SELECT name, status, CASE WHEN k % 2 = 1 THEN NULL WHEN k % 3 = 0 THEN 'Validé' ELSE ['En attente', 'Validé', 'Rejeté'][1 + k % 3] END AS n FROM d) WHERE n <> status
""")
def linked_status_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    docs = stored(spark, sf_dir).withColumns({"linked_doctype": F.when(k % 2 == 0, "Purchase Invoice"), "linked_docname": F.when(k % 2 == 0, k)})
    entries = table(spark, sf_dir, "orders").select(F.lit("Purchase Invoice").alias("doctype"), F.col("o_orderkey").alias("entry"), F.when(F.col("o_orderkey") % 3 == 0, "Approved").alias("workflow_state"), (F.col("o_orderkey") % 3).cast("int").alias("docstatus"))
    return documents.synced(docs, entries)


@query("""
WITH taken AS (SELECT DISTINCT l_suppkey AS s FROM lineitem WHERE l_returnflag <> 'A' AND l_shipdate < TIMESTAMP '1995-06-17 12:00:00' AND l_shipdate + INTERVAL 2 DAY > TIMESTAMP '1995-06-17')
SELECT s_suppkey AS name, s_name AS plate FROM supplier WHERE s_nationkey % 5 <> 0 AND s_suppkey NOT IN (SELECT s FROM taken) ORDER BY s_name LIMIT 100
""")
def availability_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    vehicles = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), F.col("s_name").alias("plate"), F.lit("").alias("make"), F.lit("").alias("model"), F.when(F.col("s_nationkey") % 5 == 0, "Hors service").otherwise("Disponible").alias("status"))
    bookings = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_suppkey").alias("vehicle"), F.col("l_shipdate").alias("start"), (F.col("l_shipdate") + F.expr("INTERVAL 2 DAY")).alias("end"), F.when(F.col("l_returnflag") == "A", "Terminée").otherwise("Confirmée").alias("status"))
    at = lambda s: F.lit(s).cast(bookings.schema["start"].dataType)
    return fleet.available(vehicles, bookings, at("1995-06-17"), at("1995-06-17 12:00:00")).select("name", "plate")


@query(r"""SELECT doc_id, nullif(regexp_extract(text, '([A-Za-z0-9._+\-]+@[A-Za-z0-9\-]+\.[A-Za-z0-9.\-]*[A-Za-z0-9])', 1), '') AS email FROM documents""")
def email_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, "documents").select("doc_id", fields.contacts(F.col("text"))["email"].alias("email"))


@query(r"""
WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents)
SELECT doc_id, CASE WHEN len(ws) < 5 THEN 'too few words' WHEN len(regexp_extract_all(text, '[^\p{L}\d\s]{4,}')) > 5 THEN 'noise'
  WHEN len(list_filter(ws, lambda x: regexp_matches(x, '^[\p{L}\d][\p{L}\d''’.,:/\-]*$'))) / len(ws) < 0.35 THEN 'few clean words' END AS reason FROM w
""")
def text_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, "documents").select("doc_id", classify.text_quality(F.col("text"), F.lit(0)).alias("reason"))


@query("SELECT event_id, value * 2 - 90 BETWEEN -90 AND 90 AND value * 4 - 180 BETWEEN -180 AND 180 AS valid, least(greatest(value, 10.0), 50.0) AS battery FROM events")
def gps_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", checks.valid_point(v * 2 - 90, v * 4 - 180).alias("valid"), checks.clamp(v, 10.0, 50.0).alias("battery"))


@query("""
SELECT l_orderkey AS item, max(l_quantity) FILTER (l_quantity <> 0) AS greatest, arg_max(l_quantity, l_linenumber * 1000 + l_quantity) FILTER (l_quantity <> 0) AS last FROM lineitem GROUP BY 1
""")
def site_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("item")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("v"))
    values = F.transform("v", lambda x: x["l_quantity"])
    return per.select("item", documents.rolled_up(values, "max").alias("greatest"), documents.rolled_up(values).alias("last"))


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spreadsheet for each order: a title, a label with a value, headings, and a row for each line."""
    rows = tables.together(table(spark, sf_dir, "lineitem").withColumn("file", F.col("l_orderkey").cast("string")), "file")
    place = F.row_number().over(Window.partitionBy("file").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    row = lambda r, *vs: F.struct(F.lit(r).alias("r") if isinstance(r, int) else r.alias("r"), F.array(*[F.lit(v) if isinstance(v, str) else v for v in vs]).alias("vs"))
    # what stands above the lines comes with the first one, so that a file's cells lie together
    top = F.array(row(0, "Nomenclature", ""), row(1, "Référence", "", F.concat(F.lit("BOM-"), "file")), row(3, "Code article", "Désignation", "Quantité", "Prix"))
    line = F.array(row(F.col("place") + 3, F.concat(F.lit("P"), "l_partkey"), F.concat(F.lit("Part "), "l_partkey"), F.col("l_quantity").cast("int").cast("string"), F.format_number("l_extendedprice", 2)))
    some = rows.withColumn("place", place).select("file", F.inline(F.when(F.col("place") == 1, F.concat(top, line)).otherwise(line)))
    return some.select("file", F.lit("1").alias("sheet"), "r", F.posexplode("vs").alias("c", "v"))


@query("""
SELECT l_orderkey::VARCHAR AS file, 3 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r, 'P' || l_partkey AS item_code, 'Part ' || l_partkey AS item_name, l_quantity::INT::DOUBLE AS qty, l_quantity::INT::DOUBLE AS qty_per_unit, 1.0::DOUBLE AS conversion_factor, round(l_extendedprice, 2) AS rate FROM lineitem
""")
def grid_bom_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [("Code article", "item_code"), ("Désignation", "item_name"), ("Quantité", "qty"), ("Prix", "rate")]
    rows = grid.table(order_cells(spark, sf_dir), columns, ["item_code", "item_name", "qty"], "item_code", together=True)
    return grid.component_defaults(rows).select("file", "r", "item_code", "item_name", "qty", "qty_per_unit", "conversion_factor", "rate")


@query("SELECT DISTINCT l_orderkey::VARCHAR AS file, 'bom_name' AS field, 'BOM-' || l_orderkey AS value FROM lineitem")
def grid_label_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.createDataFrame([("référence", "bom_name", 0)], "label string, field string, ord int")
    return grid.label_values(order_cells(spark, sf_dir), labels).select("file", "field", "value")


@query("SELECT l_orderkey::VARCHAR AS file, 3 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r, round(l_extendedprice, 2) AS amount, 'Part ' || l_partkey AS label FROM lineitem")
def grid_number_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.label_of_numbers(order_cells(spark, sf_dir)).where("c = 3").select("file", "r", "amount", "label")


@query("SELECT l_orderkey AS doc_id, l_linenumber AS idx, 'PX-' || lpad(l_partkey::VARCHAR, 9, '0') AS item_code, 'Tube ' || l_suppkey AS item_name, l_quantity::INT::DOUBLE AS qty, 'Kg' AS uom, round(l_extendedprice, 2) AS rate FROM lineitem")
def bom_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws("  ", F.col("l_linenumber"), F.concat(F.lit("PX-"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")), F.concat(F.lit("Tube "), "l_suppkey"), F.col("l_quantity").cast("int"), F.lit("kg"), F.replace(F.replace(F.format_number("l_extendedprice", 2), F.lit(","), F.lit("")), F.lit("."), F.lit(",")))
    docs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))
    return sheets.components(docs).select("doc_id", "idx", "item_code", "item_name", "qty", "uom", "rate")


@query("SELECT c_custkey AS doc_id, c_custkey AS party FROM customer")
def party_resolve_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    docs = c.select(F.col("c_custkey").alias("doc_id"), F.lower("c_name").alias("code"), F.col("c_name").alias("name"))
    return resolve.by_priority(docs, c.select(F.col("c_custkey").alias("id"), F.lit(None).cast("string").alias("code"), F.col("c_name").alias("name")), [("code", "code"), ("name", "name")], "party").select("doc_id", "party")


@query("SELECT c_custkey AS doc_id, c_name AS party FROM customer")
def party_resolve_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(spark, sf_dir, "customer")
    docs = c.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("Vendu à : "), F.translate("c_name", "#", " ")).alias("text"))
    return resolve.party_match(docs, c.select(F.translate("c_name", "#", " ").alias("name"))).select("doc_id", F.replace("party", F.lit(" "), F.lit("#")).alias("party"))


@query("SELECT p_partkey AS doc_id, CASE WHEN p_partkey = 0 THEN NULL ELSE 'PX' || lpad(p_partkey::VARCHAR, 12, '0') END AS resolved FROM part")
def zero_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(spark, sf_dir, "part")
    code = lambda n: F.concat(F.lit("PX"), F.lpad(F.col("p_partkey").cast("string"), n, "0"))
    found = resolve.zero_padding(p.select(F.col("p_partkey").alias("doc_id"), code(16).alias("code")), p.select(code(12).alias("item_code")))
    return found.select("doc_id", "resolved")


@query("SELECT o_orderkey AS doc_id, 'grand_total' AS name, 'b' || o_orderkey AS value FROM orders UNION ALL SELECT o_orderkey, 'bill_no', 'n' || o_orderkey FROM orders")
def field_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.createDataFrame([("facture", 0, "montant", "grand_total"), ("facture", 1, "montant_ttc", "grand_total"), ("facture", 2, "numero_facture", "bill_no"), ("facture", 3, "numero", "bill_no")], "doc_type string, ord int, field string, name string")
    k = F.col("o_orderkey").cast("string")
    rows = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in (("montant", F.concat(F.lit("a"), k)), ("montant_ttc", F.concat(F.lit("b"), k)), ("numero_facture", F.concat(F.lit("n"), k)), ("numero", F.lit("")))])
    return checks.renamed(spread(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("facture").alias("doc_type"), F.inline(rows)), mapping)


@query(STORED + ", f AS (SELECT document_name, min(name) AS name FROM d GROUP BY 1), n AS (SELECT DISTINCT o_custkey AS c FROM orders) SELECT d.name, d.document_name, CASE WHEN f.name IS NOT NULL THEN 'Validation requise' ELSE status END AS status FROM d LEFT JOIN f ON d.name = f.name UNION ALL SELECT NULL, 'new_' || c_custkey || '.pdf', 'Validation requise' FROM customer")
def document_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = stored(spark, sf_dir).select("name", "document_name", "status")
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c")).distinct().select(F.concat(F.lit("facture_"), "c", F.lit("_a1b2c3d4.pdf")).alias("document_name"))
    new = table(spark, sf_dir, "customer").select(F.concat(F.lit("new_"), "c_custkey", F.lit(".pdf")).alias("document_name"))
    return documents.upserted(old, c.unionByName(new).withColumn("status", F.lit(V.TO_CHECK)), ["status"])


@query("SELECT o_orderkey AS doc_id, 'Fournisseur X ' || o_orderkey AS header, 'Désignation ' || o_custkey AS body, 'Total HT 5' AS footer FROM orders")
def zone_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.concat(F.lit("Fournisseur X "), "o_orderkey", F.lit("\nDésignation "), "o_custkey", F.lit("\nTotal HT 5"))
    return spread(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), fields.zones(page).alias("z")).select("doc_id", "z.*")


@query("SELECT o_orderkey AS doc_id, 'f' || o_orderkey || 'x_a1b2c3d4.pdf' AS name, 'f' || o_orderkey || 'x.pdf' AS clean, 'f' || o_orderkey || 'x_a1b2c3d4' AS base, 'f' || o_orderkey || 'x' AS clean_base FROM orders")
def file_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a letter that no hash has stands behind the key, so that keys of any length are none
    v = text.file_variants(F.concat(F.lit("f"), "o_orderkey", F.lit("x_a1b2c3d4.pdf")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), *[v[k].alias(n) for k, n in enumerate(("name", "clean", "base", "clean_base"))])


@query("SELECT o_orderkey AS doc_id, lpad((10000000 + o_orderkey)::VARCHAR, 8, '0') AS number, round(o_totalprice, 2) AS amount, DATE '2000-01-01' - (o_orderkey % 700)::INT AS date, 'BIAT' AS bank, 'Société Alpha SARL' AS beneficiary, o_orderkey % 700 > 365 AS stale FROM orders")
def cheque_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit("2000-01-01").cast("date")
    t = F.concat(F.lit("Chèque N° : "), F.col("o_orderkey") + 10_000_000, F.lit("\nBIAT\nPayez contre ce chèque\nMontant : "), F.translate(F.format_number(F.round("o_totalprice", 2), 2), ",.", " ,"), F.lit(" DT\nÀ l'ordre de : Société Alpha SARL\nTunis, le "), F.date_format(F.date_sub(as_of, (F.col("o_orderkey") % 700).cast("int")), "dd/MM/yyyy"))
    docs = spread(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), t.alias("text"))
    got = payments.cheques(docs, as_of)
    return got.select("doc_id", "number", "amount", "date", "bank", "beneficiary", "stale")


@query("SELECT l_orderkey AS doc_id, l_linenumber::INT AS n, 'REF' || l_partkey AS reference, l_quantity::INT::DOUBLE AS qty, 1234.5::DOUBLE AS rate, round(l_quantity::INT * 1234.5, 3) AS amount FROM lineitem")
def invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(F.lit("REF"), "l_partkey", F.lit(" Tube acier\n"), F.col("l_quantity").cast("int"), F.lit(" x 1234,5\n"), F.replace((F.round(F.col("l_quantity").cast("int") * 1234.5, 3)).cast("decimal(18,3)").cast("string"), F.lit("."), F.lit(",")))
    docs = spread(spark, sf_dir, "lineitem").select(F.struct(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).alias("id"), s.alias("text")).select(F.concat_ws("-", "id.o", "id.n").alias("doc_id"), "text")
    got = sheets.invoice_lines(docs)
    part = F.split("doc_id", "-")
    return got.select(part[0].cast("long").alias("doc_id"), part[1].cast("int").alias("n"), "reference", "qty", "rate", "amount")


@query("SELECT o_orderkey AS doc_id, round(o_totalprice, 3) AS net, 19.5::DOUBLE AS tax, round(round(o_totalprice, 3) + 19.5, 3) AS gross FROM orders")
def invoice_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    num = lambda c: F.translate(F.format_number(c, 3), ",.", " ,")
    net = F.round("o_totalprice", 3)
    t = F.concat(F.lit("Total HT "), num(net), F.lit(" DT\nTVA (7%)\n7,5\nTVA (19%)\n12\nTotal TTC "), num(net + 19.5), F.lit(" DT"))
    return sheets.totals(spread(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), t.alias("text")))


@query("SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN 'low' WHEN c_custkey % 2 = 0 THEN 'mandatory' ELSE 'high' END AS mark, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS amount, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'A' || c_custkey END AS value FROM customer")
def form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    value = F.when(k % 2 != 0, F.lit("x"))
    found = F.create_map(F.lit("alias"), F.when(k % 2 != 0, F.concat(F.lit("A"), k)).otherwise(""), F.lit("raw"), F.col("c_name"))
    uncertain = F.when(k % 3 == 0, F.array(F.lit("raw"))).otherwise(F.array(F.lit("other")))
    return table(spark, sf_dir, "customer").select(k.alias("doc_id"), forms.mark(value, forms.is_uncertain(uncertain, "raw", ["alias"]), F.lit(1)).alias("mark"), forms.positive(F.col("c_acctbal")).alias("amount"), forms.form_value(found, ["alias"], "name", "raw").alias("value"))


@query("SELECT s_suppkey AS site, CASE WHEN s_nationkey < 25 THEN n_name END AS warehouse FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 1")
def warehouse_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    sites = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("site"), F.concat(F.lit("Magasin "), F.lower("n_name"), F.lit(".")).alias("label"), (F.col("s_suppkey") % 2).alias("reorder_level"), F.lit(0).alias("reorder_qty"))
    return forms.warehouses(sites, n.select(F.col("n_name").alias("warehouse"), (-F.length("n_name") * 100 + F.col("n_nationkey")).alias("ord"))).select("site", "warehouse")


@query("SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'ALPHA ' || o_custkey || ' SARL' WHEN 1 THEN 'Beta Negoce' ELSE 'GAMMA' END AS supplier, CASE o_orderkey % 3 WHEN 0 THEN 'FAC-24-' || (o_orderkey % 1000) WHEN 1 THEN 'A' || o_orderkey ELSE o_orderkey::VARCHAR END AS number FROM orders WHERE NOT (o_orderkey % 3 = 2 AND o_orderkey BETWEEN 1900 AND 2099) UNION ALL SELECT o_orderkey, 'GAMMA', NULL FROM orders WHERE o_orderkey % 3 = 2 AND o_orderkey BETWEEN 1900 AND 2099")
def invoice_heuristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    page = F.when(k % 3 == 0, F.concat(F.lit("Facture\nALPHA "), c, F.lit(" SARL rue 5\nFacture FAC-24-"), k % 1000, F.lit("\nDésignation Quantité\n")))
    page = page.when(k % 3 == 1, F.concat(F.lit("Facture\n12 rue du port\nBeta Negoce\nTotal\nN° facture : A"), k)).otherwise(F.concat(F.lit("Tel fax GAMMA\nDésignation\nN° : "), k))
    return spread(spark, sf_dir, "orders").select(k.alias("doc_id"), forms.supplier(F.split(page, "\n")).alias("supplier"), forms.invoice_number(page).alias("number"))


from docloom import feature_queries, rule_queries  # noqa: E402, F401  (register their queries here)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
