"""Queries of sources, streams' rules over tables, joins by time and by containment, merges and boxes, with what they must give in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.functions import vocabulary as V
from docloom.operators import classify, documents, fields, fleet, grid, payments, roles, sheets
from docloom.plans import invoices, worker
from docloom.plans.steps import Steps
from docloom.queries import STORED, query, spread, stored, table, together
from docloom.sources import shared, workbooks
from docloom.sources.store import DocumentStore
from docloom.streaming import intake


def say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def comma(amount: Column, digits: int, gap: str = "") -> Column:
    """An amount as French books write it."""
    return F.translate(F.replace(F.format_number(amount, digits), F.lit(","), F.lit(gap)), ".", ",")


# Amounts of a few hundred with cents, and days, from the keys of orders.
NET, DAYS = "(100 + o_orderkey % 800 + (o_custkey % 100) / 100.0)", "(DATE '2024-01-01' + (o_orderkey % 300)::INT)"


def parts_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, Column, Column, Column]:
    """orders with their key, customer, net amount and day."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    net = F.round(100 + k % 800 + (c % 100) / 100.0, 2)
    return spread(spark, sf_dir, "orders"), k, c, net, F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int"))


@query(f"""
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, round({NET}, 2) AS n, {DAYS} AS d FROM orders)
SELECT k AS doc_id, strftime(d, '%d/%m/%Y') AS day, strftime(d + 30, '%d/%m/%Y') AS due, round(n + 50, 2) AS gross, CASE WHEN k % 2 = 0 THEN round(round(n + 50, 2) / 1.19, 2) END AS net,
  CASE WHEN k % 2 = 0 THEN round(round(n + 50, 2) - round(n + 50, 2) / 1.19, 2) ELSE n END AS tax, 'FAC-2024-' || k AS number, 'CDE-2023-' || c AS ordered, 'Acier ' || c AS supplier, 'Metal ' || k || ' SARL' AS company FROM o
""")
def role_scan_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger amount is the total, even where a smaller one says so too; account numbers and repeated values are none."""
    o, k, c, net, day = parts_of(spark, sf_dir)
    far = " " * 70
    total = say("Total ", comma(net + 50, 2, " "), " DT", far)
    tax = F.when(k % 2 == 1, say("\nTVA ", comma(net, 2, " "), " DT", far)).otherwise("")
    page = say("Facture FAC-2024-", k, far, "\nLe ", F.date_format(day, "dd/MM/yyyy"), far, "\nÉchéance ", F.date_format(F.date_add(day, 30), "dd/MM/yyyy"), far, "\nCommande CDE-2023-", c, far, "\nFournisseur : Acier ", c, "\n", far, "Rib 12,00", far, "\n", total, total, tax, far, far, "\nMetal ", k, " SARL")
    rows = o.select(k.alias("doc_id"), roles.by_role(page).alias("r"))
    of = lambda kind, role: F.try_element_at(F.col(f"r.{kind}"), F.lit(role))
    return rows.select("doc_id", of("dates", "date").alias("day"), of("dates", "date_echeance").alias("due"), of("amounts", "montant_ttc").alias("gross"), of("amounts", "montant_ht").alias("net"), of("amounts", "montant_tva").alias("tax"), of("references", "numero_facture").alias("number"), of("references", "numero_commande").alias("ordered"), of("names", "fournisseur").alias("supplier"), of("names", "societe").alias("company"))


@query(f"""
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, round({NET}, 2) AS n, {DAYS} AS d FROM orders),
a AS (SELECT *, CASE k % 3 WHEN 0 THEN n WHEN 1 THEN round(1000 + n, 2) ELSE round(2000 + n, 2) END AS g FROM o)
SELECT k AS doc_id, strftime(d, '%d/%m/%Y') AS bill_date, strftime(d, '%d/%m/%Y') AS posting_date, 'FC/2024/' || k AS bill_no, round(g + 100, 2)::DOUBLE AS gross, CASE WHEN k % 2 = 0 THEN g END::DOUBLE AS net, CASE WHEN k % 2 = 0 THEN 100.0 END::DOUBLE AS tax, round(c % 50 + 0.25, 2)::DOUBLE AS discount FROM a
""")
def role_scan_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in three ways of writing; shorter shapes inside a longer amount don't count, the role is told by what stands before; tax by lines where no total of taxes is there."""
    o, k, c, net, day = parts_of(spark, sf_dir)
    g = F.when(k % 3 == 0, net).when(k % 3 == 1, net + 1000).otherwise(net + 2000)
    put = lambda v: F.when(k % 3 == 0, comma(v, 2)).when(k % 3 == 1, comma(v, 2, " ")).otherwise(F.format_string("%.2f", v))
    # odd documents have no net and no tax: with a discount only, both lack and are not worked out, as a line of tax says 0,00
    middle = F.when(k % 2 == 0, say("Total HT ", put(g), "\nTVA 19% ", comma(F.lit(100.0), 2))).otherwise("Base TVA 7,00")
    page = say("Facture n° FC/2024/", k, "\nDate ", F.date_format(day, "dd/MM/yyyy"), "\nTél : 71 123,45\nMatricule 999,99\nRemise ", comma(c % 50 + 0.25, 2), "\n", middle, "\nNet à payer ", put(g + 100))
    rows = o.select(k.alias("doc_id"), roles.by_role(page, "sheet").alias("r"))
    rows = rows.select("doc_id", "r", roles.entry_of(F.col("r")).alias("e"))
    of = lambda role: F.try_element_at(F.col("r.amounts"), F.lit(role))
    e = lambda name: F.try_element_at(F.col("e"), F.lit(name))
    odd = F.col("doc_id") % 2 == 1
    return rows.select("doc_id", e("bill_date").alias("bill_date"), e("posting_date").alias("posting_date"), e("bill_no").alias("bill_no"), e("montant_ttc").cast("double").alias("gross"), F.when(~odd, of("montant_ht")).alias("net"), F.when(~odd, of("montant_tva")).alias("tax"), of("remise").alias("discount"))


@query("""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS n FROM lineitem)
SELECT l_suppkey AS file, l_returnflag AS sheet, CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE 0 END AS place, n::INT AS r, 'P' || l_partkey AS part, 'é <' || l_orderkey || '> & "x"' AS words, round(l_extendedprice, 2) AS price FROM l
""")
def workbook_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook for each supplier with a sheet for each flag, whose parts are numbered against the sheets' order, written and read as a data source."""
    from pyspark.sql import Window

    per = Window.partitionBy("l_suppkey", "l_returnflag").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    line = together(spark, sf_dir, "lineitem", "l_suppkey").withColumn("n", F.row_number().over(per))
    values = F.array(say("P", F.col("l_partkey")), say("é <", F.col("l_orderkey"), '> & "x"'), F.format_string("%.2f", F.round("l_extendedprice", 2)))
    place = F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "N", 1).otherwise(0)
    rows = line.select(F.col("l_suppkey").cast("string").alias("file"), F.col("l_returnflag").alias("sheet"), place.alias("place"), F.col("n").alias("r"), values.alias("v"))
    at = shared.folder(spark, "workbooks")
    workbooks.write(rows, at, dealt=True)
    v = lambda n: F.get("v", F.lit(n))
    return workbooks.read(spark, at, by_rows=True).select(F.regexp_extract("file", "(\\d+)\\.xlsx$", 1).cast("long").alias("file"), "sheet", "place", "r", v(0).alias("part"), v(1).alias("words"), v(2).cast("double").alias("price"))


@query("""
SELECT s_suppkey AS file, CASE s_suppkey % 3 WHEN 0 THEN 'Fiche ' || s_suppkey WHEN 1 THEN 'Notes' ELSE 'Article stock' END AS item_sheet, CASE s_suppkey % 3 WHEN 2 THEN NULL ELSE 'Stock par site' END AS site_sheet,
  CASE s_suppkey % 3 WHEN 2 THEN NULL ELSE 2 END::BIGINT AS n_sites, CASE WHEN s_suppkey % 3 <> 2 THEN 1 + s_suppkey % 9 END AS safety_stock, CASE WHEN s_suppkey % 3 <> 2 THEN 'B' || s_nationkey END AS abc FROM supplier
""")
def workbook_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item's sheet by its name or place, and the sites' sheet, which is none where the item's own has such a name; its columns by words in their headings."""
    k = F.col("s_suppkey")
    item = F.when(k % 3 == 0, say("Fiche ", k)).when(k % 3 == 1, "Notes").otherwise("Article stock")
    # where the item's sheet has no name of its own it is the first
    sites = F.when(k % 3 == 2, "Divers").otherwise("Stock par site")
    rows = [["Sites de stock", "", ""], ["Site", "Stock sécurité (US)", "Catégorie ABC"], ["S1", (k % 5).cast("string"), ""], ["S2", (1 + k % 9).cast("string"), say("B", F.col("s_nationkey"))], ["", "99", "Z"]]
    cells = [F.struct(sites.alias("sheet"), F.lit(1).alias("place"), F.lit(r).alias("r"), F.lit(c).alias("c"), (F.lit(v) if isinstance(v, str) else v).alias("v")) for r, row in enumerate(rows) for c, v in enumerate(row)]
    cells.append(F.struct(item.alias("sheet"), F.lit(0).alias("place"), F.lit(0).alias("r"), F.lit(0).alias("c"), say("Article : A", k).alias("v")))
    df = together(spark, sf_dir, "supplier", "s_suppkey").select(k.cast("string").alias("file"), "s_nationkey", F.inline(F.array(*cells))).drop("s_nationkey").where("v <> ''")
    at = shared.folder(spark, "sheets")
    workbooks.write(df, at, dealt=True)
    found = workbooks.marked_sheets(workbooks.read(spark, at).withColumn("file", F.regexp_extract("file", "(\\d+)\\.xlsx$", 1).cast("long")))
    named = found.groupBy("file").agg(*[F.min(F.when(F.col(c), F.col("sheet"))).alias(n) for c, n in (("is_item", "item_sheet"), ("is_site", "site_sheet"))])
    levels = grid.site_levels(found.where("is_site")).select("file", "n_sites", "safety_stock", "abc")
    # the two levels of a site are 0 to 4 and 1 to 9: the greater one counts
    return named.join(levels, "file", "left").select("file", "item_sheet", "site_sheet", "n_sites", F.when(F.col("safety_stock").isNotNull(), F.greatest("safety_stock", 1 + F.col("file") % 9) - F.greatest(F.lit(0), F.col("file") % 5 - (1 + F.col("file") % 9))).alias("safety_stock"), "abc")


EVENTS = "SELECT 'f' || user_id AS path, date_trunc('millisecond', ts) AS m FROM events"


@query(f"""
WITH e AS (SELECT DISTINCT * FROM ({EVENTS})),
g AS (SELECT *, lag(m) OVER (PARTITION BY path ORDER BY m) + INTERVAL 3 HOUR < m AS gap FROM e),
s AS (SELECT *, count(*) FILTER (gap) OVER (PARTITION BY path ORDER BY m) AS burst FROM g)
SELECT path, min(m) AS first, max(m) AS last, count(*) AS n FROM s WHERE burst = 0 GROUP BY path
""")
def settled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each file the first burst of events that a quiet time of three hours ends."""
    events = table(spark, sf_dir, "events").select(say("f", F.col("user_id")).alias("path"), F.col("ts").alias("at"))
    return intake.settled(events, 3 * 3600).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})


@query("""
WITH e AS (SELECT event_type || user_id % 40 AS key, date_trunc('millisecond', ts) AS m, CASE WHEN event_id % 3 = 0 THEN 'put' ELSE 'get' END AS kind, 'v' || event_id AS value FROM events),
p AS (SELECT key, m, max(value) AS value FROM e WHERE kind = 'put' GROUP BY ALL),
n AS (SELECT *, lead(m) OVER (PARTITION BY key ORDER BY m) AS next FROM p)
SELECT g.key, g.m AS moment, CASE WHEN n.m IS NULL THEN 'miss' ELSE 'hit' END AS outcome, n.value FROM (SELECT * FROM e WHERE kind = 'get') g LEFT JOIN n ON g.key = n.key AND n.m <= g.m AND g.m < n.m + INTERVAL 1 HOUR AND (n.next IS NULL OR n.next > g.m)
UNION ALL SELECT key, m + INTERVAL 1 HOUR, 'expired', value FROM n WHERE (next IS NULL OR next >= m + INTERVAL 1 HOUR) AND m + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-20'
""")
def result_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: results that are kept for an hour: what asks for them, and what expires."""
    e = table(spark, sf_dir, "events")
    events = e.select(say(F.col("event_type"), F.col("user_id") % 40).alias("key"), F.col("ts").alias("at"), F.when(F.col("event_id") % 3 == 0, "put").otherwise("get").alias("kind"), say("v", F.col("event_id")).alias("value"))
    return intake.kept_in(events, F.lit("2024-01-20").cast("timestamp")).select("key", F.col("at").cast("timestamp_ntz").alias("moment"), "outcome", "value")


@query("""
WITH v AS (SELECT s_suppkey AS name, s_name AS plate, s_nationkey AS nation FROM supplier WHERE s_suppkey % 7 <> 0),
q AS (SELECT o_orderkey AS request, o_orderdate::TIMESTAMP + INTERVAL 6 HOUR AS a, o_orderdate::TIMESTAMP + INTERVAL 30 HOUR AS z, c_nationkey AS nation FROM orders JOIN customer ON o_custkey = c_custkey),
b AS (SELECT l_suppkey AS name, l_shipdate::TIMESTAMP AS a, l_shipdate::TIMESTAMP + INTERVAL 20 HOUR AS z FROM lineitem WHERE l_returnflag <> 'A'),
t AS (SELECT DISTINCT request, v.name FROM q JOIN v USING (nation) JOIN b ON b.name = v.name AND q.a < b.z AND b.a < q.z)
SELECT q.request, count(v.name) FILTER (t.name IS NULL) AS n_free, min(v.plate) FILTER (t.name IS NULL) AS plate FROM q LEFT JOIN v USING (nation) LEFT JOIN t ON t.request = q.request AND t.name = v.name GROUP BY 1
""")
def requests_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1-R3 for a table of requests."""
    s, o, c, line = (table(spark, sf_dir, n) for n in ("supplier", "orders", "customer", "lineitem"))
    vehicles = s.select(F.col("s_suppkey").alias("name"), F.col("s_name").alias("plate"), F.when(F.col("s_suppkey") % 7 == 0, "En maintenance").otherwise("Disponible").alias("status"), F.col("s_nationkey").alias("nation"))
    start = F.col("o_orderdate").cast("timestamp")
    requests = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("request"), (start + F.expr("INTERVAL 6 HOURS")).alias("start"), (start + F.expr("INTERVAL 30 HOURS")).alias("end"), F.col("c_nationkey").alias("nation"))
    at = F.col("l_shipdate").cast("timestamp")
    booked = line.select(F.col("l_orderkey").alias("name"), F.col("l_suppkey").alias("vehicle"), at.alias("start"), (at + F.expr("INTERVAL 20 HOURS")).alias("end"), F.when(F.col("l_returnflag") == "A", "Terminée").otherwise("Confirmée").alias("status"))
    return fleet.available_for(requests, vehicles, booked, ["nation"])


@query(STORED + ", f AS (SELECT document_name, min(name) AS name FROM d GROUP BY 1) SELECT d.name, d.document_name, CASE WHEN f.name IS NOT NULL AND c % 3 = 0 THEN 'Rejeté' WHEN f.name IS NOT NULL AND c % 2 = 0 THEN 'Validation requise' ELSE status END AS status FROM d LEFT JOIN f ON d.name = f.name UNION ALL SELECT md5('new_' || c_custkey || '.pdf'), 'new_' || c_custkey || '.pdf', CASE WHEN c_custkey % 2 = 0 THEN 'Rejeté' ELSE 'Validé' END FROM customer")
def incremental_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: three batches merged into stored documents by partitions; the second one comes twice."""
    store = DocumentStore(spark, shared.folder(spark, "store"), 16)
    store.create(stored(spark, sf_dir).select("name", "document_name", "status"))
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c")).distinct()
    batch = lambda rows, name, status: rows.select(name.alias("document_name"), status.alias("status"))
    new, status = table(spark, sf_dir, "customer"), F.when(F.col("c_custkey") % 2 == 0, V.REJECTED).otherwise(V.VALID)
    store.merge(batch(c.where("c % 2 = 0"), say("facture_", F.col("c"), "_a1b2c3d4.pdf"), F.lit(V.TO_CHECK)), ["status"], 0)
    for _ in range(2):
        store.merge(batch(new, say("new_", F.col("c_custkey"), ".pdf"), F.lit(V.PENDING)).withColumn("status", F.lit(V.PENDING)), ["status"], 1)
    third = batch(c.where("c % 3 = 0"), say("facture_", F.col("c"), ".pdf"), F.lit(V.REJECTED)).unionByName(batch(new, say("new_", F.col("c_custkey"), "-00ffee11.pdf"), status))
    store.merge(third, ["status"], 2)
    return store.documents().select("name", "document_name", "status")


@query("""
SELECT l_orderkey AS page, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))::INT AS line, 'REF' || l_partkey AS reference, 'Tube acier ' || l_suppkey AS designation,
  CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE l_quantity END::INT AS qty, ((1 + l_partkey % 4000) / 4.0)::DOUBLE AS rate, ((1 + l_partkey % 4000) / 4.0 * CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE l_quantity::INT END)::DOUBLE AS amount FROM lineitem
""")
def box_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with boxes, put to lines by height and to columns by the gaps that all lines leave; every third line has no quantity."""
    from pyspark.sql import Window

    k, price = F.col("l_orderkey"), (1 + F.col("l_partkey") % 4000) / 4.0
    line = together(spark, sf_dir, "lineitem", "l_orderkey").withColumn("line", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    third = F.col("l_linenumber") % 3 == 0
    amount = F.when(third, price).otherwise(F.col("l_quantity").cast("int") * price)
    # words of a line stand at slightly different heights, and shift from page to page
    box = lambda x, w, dy, word: F.struct((F.lit(x) + k % 7).alias("x0"), (20 * F.col("line") + dy).alias("y0"), (F.lit(x) + k % 7 + w).alias("x1"), (20 * F.col("line") + dy + 10).alias("y1"), word.alias("word"))
    number = lambda v: F.translate(F.format_string("%.2f", v), ".", ",")
    words = F.array(box(10, 60, 0, say("REF", F.col("l_partkey"))), box(100, 40, 1, F.lit("Tube")), box(146, 44, -1, F.lit("acier")), box(196, 30, 2, F.col("l_suppkey").cast("string")), box(260, 30, 0, F.when(third, "").otherwise(F.col("l_quantity").cast("int").cast("string"))), box(320, 50, 1, number(price)), box(420, 60, -2, number(amount)))
    # the headings of a table's columns are wide enough to keep each apart on every page; they come with a page's first line
    heads = F.array(*[F.struct((F.lit(x) + k % 7).alias("x0"), F.lit(0).alias("y0"), (F.lit(x) + k % 7 + w).alias("x1"), F.lit(10).alias("y1"), F.lit(h).alias("word")) for x, w, h in ((10, 60, "Référence"), (100, 120, "Désignation"), (260, 30, "Qté"), (320, 50, "P.HT"), (420, 60, "Montant"))])
    boxes = line.select(k.alias("page"), F.inline(F.when(F.col("line") == 1, F.concat(heads, words)).otherwise(words))).where("word <> ''")
    return grid.invoice_table(grid.cells_of_boxes(boxes)).select("page", F.col("r").alias("line"), "reference", "designation", "qty", "rate", "amount")


@query("""
WITH w AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders), l AS (SELECT * FROM w WHERE s <> 'F')
SELECT 'loaded' AS step, 'rows_in' AS metric, count(*) AS value FROM w UNION ALL SELECT 'loaded', 'rows_out', count(*) FROM l
UNION ALL SELECT 'checked', 'rows_in', count(*) FROM l UNION ALL SELECT 'checked', 'rows_out', count(*) FROM l WHERE k % 5 <> 0 UNION ALL SELECT 'checked', 'refused', count(*) FROM l WHERE k % 5 = 0
UNION ALL SELECT 'checked', 'to_check', count(*) FROM l WHERE k % 5 <> 0 AND k % 7 = 0 UNION ALL SELECT 'checked', 'errors', count(*) FROM l WHERE k % 5 <> 0 AND k % 7 = 0
""")
def worker_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the worker's steps let through, counted as the rows pass by."""
    o = table(spark, sf_dir, "orders")
    pages = invoices.render(o, table(spark, sf_dir, "customer"))
    docs = o.select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "O", V.PENDING).when(F.col("o_orderstatus") == "P", V.RUNNING).otherwise(V.VALID).alias("status")).join(pages, "doc_id")
    docs = docs.select(F.col("doc_id").alias("name"), F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("text")).alias("text"), "status")
    docs = table_of(spark, docs, "waiting")
    steps = Steps()
    worker.worked(docs, steps).write.format("noop").mode("overwrite").save()
    return steps.rows(spark)


def table_of(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written and read again, so that each of its rows passes an observer once."""
    at = shared.folder(spark, name)
    df.write.parquet(at)
    return spark.read.parquet(at)


@query("""
WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders),
n AS (SELECT k, 1 + (k % 2 = 0)::INT + (c % 3 = 0)::INT + (c % 5 = 0)::INT AS cheque, (k % 4 = 0)::INT + (c % 2 = 0)::INT + (k % 3 = 0)::INT * 2 AS draft FROM o)
SELECT k AS doc_id, CASE WHEN cheque > draft THEN 'cheque' WHEN draft > cheque THEN 'traite' ELSE 'inconnu' END AS kind, CASE WHEN cheque = draft THEN 0.0 ELSE round(greatest(cheque, draft) / (cheque + draft), 3) END::DOUBLE AS confidence FROM n
""")
def payment_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheques and drafts by the payment rules' own signs, of which each text has others."""
    o, k, c, net, day = parts_of(spark, sf_dir)
    on = lambda when, words: F.when(when, words).otherwise("")
    page = say("CMC7 ", k, "\n", on(k % 2 == 0, "La somme de mille dinars\n"), on(c % 3 == 0, "à l'ordre de M. X\n"), on(c % 5 == 0, "Non endossable\n"), on(k % 4 == 0, "Tireur Acier\n"), on(c % 2 == 0, say("Échéance ", F.date_format(day, "dd/MM/yyyy"), "\n")), on(k % 3 == 0, "Lettre de change\nT-2024-001\n"))
    got = classify.cheque_or_draft(page)
    return o.select(k.alias("doc_id"), got["doc_type"].alias("kind"), got["confidence"].alias("confidence"))


@query("""
SELECT o_orderkey AS doc_id, CASE o_orderkey % 6 WHEN 0 THEN 'facture' WHEN 1 THEN 'facture_vente' WHEN 2 THEN 'traite' WHEN 3 THEN 'cheque' WHEN 4 THEN 'traite' ELSE 'bon_livraison' END AS kind FROM orders
""")
def patterned_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: a sure sign settles a text before a sales invoice's; signs with numbers, days or a second phrase on their line are counted."""
    o, k, c, net, day = parts_of(spark, sf_dir)
    page = F.when(k % 6 == 0, say("Facture n° ", k, "\nVendu à : client ", c)).when(k % 6 == 1, say("Facture V ", k, "\nDevis ", c)).when(k % 6 == 2, say("République tunisienne, lettre ", k)).when(k % 6 == 3, say(k + 1000000, " trente DT\nsignature (s)\nfacture ", c))
    page = page.when(k % 6 == 4, say("facture\nÉchéance : ", F.date_format(day, "dd/MM/yyyy"), "\n", k + 10000000000, " Sousse ", c)).otherwise(say("visa du client ", c, "\nreçu le ", F.date_format(day, "dd/MM/yyyy"), "\nfacture ", k))
    return o.select(k.alias("doc_id"), classify.by_patterns(page).alias("kind"))


@query("""
SELECT o_orderkey AS doc_id, '1' || o_orderkey % 9 || '/0' || (1 + o_custkey % 9) || '/2024 PANNEAUX n' || o_orderkey || ', OLEO TECHNO ' || o_custkey || ' TUNISIA, ' || o_orderkey || '0-1' || o_custkey || ' et ' || o_orderkey || ',500' AS said FROM orders
""")
def repaired_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with a gap, garbled names, letters among digits and signs, split decimals."""
    o, k, c, net, day = parts_of(spark, sf_dir)
    page = say("1 ", k % 9, "/O", 1 + c % 9, "/2024 ", F.when(k % 2 == 0, "PANNEA|").otherwise("PANNEA"), " n", k, ", ", F.when(k % 3 == 0, "oleo tecnning").otherwise("OLEO TECND"), " ", c, " ", F.when(k % 2 == 0, "TUNIGIA").otherwise("TUUWN1BTA7"), ", ", k, "O-l", c, " et ", k, " J500")
    return o.select(k.alias("doc_id"), text.repair_names(text.repair_payment(page)).alias("said"))


@query("""
SELECT o_orderkey AS doc_id, 'FAC-' || o_orderkey AS numero_facture, 'Client ' || o_custkey AS client, 'CMD' || o_custkey AS reference_commande, 'Virement ' || o_orderkey % 90 AS mode_paiement,
  CASE WHEN o_orderkey % 2 = 0 THEN ['numero_facture', 'client', 'reference_commande', 'mode_paiement'] ELSE ['numero_facture', 'client', 'reference_commande', 'tva', 'montant_ttc', 'mode_paiement'] END AS found,
  CASE WHEN o_orderkey % 2 = 0 THEN ['date', 'echeance', 'fournisseur', 'montant_ht', 'tva', 'montant_ttc', 'rib_iban'] ELSE ['date', 'echeance', 'fournisseur', 'montant_ht', 'rib_iban'] END AS missing FROM orders
""")
def invoice_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of a type from one pass, and what was found and what is missing."""
    o, k, c, net, day = parts_of(spark, sf_dir)
    foot = F.when(k % 2 == 1, say("\nTVA (19%) : ", comma(net, 2, " "), " DT\nTotal TTC : ", comma(net * 2, 2, " "), " DT")).otherwise("")
    page = say("Facture N° : FAC-", k, "\nClient : Client ", c, " | Tél 71\nVotre commande : CMD", c, "\nMode de paiement : Virement ", k % 90, foot)
    got = fields.by_type(o.select(k.alias("doc_id"), page.alias("text")), "facture")
    return got.select("doc_id", "numero_facture", "client", "reference_commande", "mode_paiement", "found", "missing")


@query("""
SELECT p_partkey AS doc_id, 'A' || p_partkey AS item_code, 'Tube ' || p_partkey AS item_name, 'Tube ' || p_partkey AS description, CASE WHEN p_partkey % 2 = 0 THEN '1' ELSE '0' END AS disabled, CASE WHEN p_partkey % 3 = 0 THEN '0' ELSE '1' END AS has_batch_no,
  CASE p_partkey % 4 WHEN 0 THEN '7.0' ELSE (1 + p_partkey % 5)::DOUBLE::VARCHAR END AS safety_stock FROM part
""")
def item_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules across the fields of an item sheet."""
    k = F.col("p_partkey")
    status = F.when(k % 2 == 0, "Inactif").otherwise("Actif")
    lots = F.when(k % 3 == 0, "Non géré").otherwise("Obligatoire")
    levels = F.when(k % 4 == 0, "").otherwise(say("\nStock site : S1 Tunis\nStock sécurité : 9\nStock site : S2 Sfax\nStock sécurité : ", 1 + k % 5, "\nStock site : S3 Sousse\nStock sécurité : 0"))
    page = say("Article : A", k, "\n", F.when(k % 5 == 0, "Désignation").otherwise("Désignation 1"), " : Tube ", k, "\nStatut : ", status, "\nGestion lot : ", lots, "\nStock de sécurité : 7", levels)
    rows = spread(spark, sf_dir, "part").select(k.alias("doc_id"), sheets.item_fields(page).alias("f"))
    names = ["item_code", "item_name", "description", "disabled", "has_batch_no", "safety_stock"]
    return rows.select("doc_id", *[F.try_element_at("f", F.lit(n))["value"].alias(n) for n in names])


@query("""
SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN (10000000 + o_orderkey)::VARCHAR WHEN 1 THEN 'AB' || (1000 + o_orderkey) WHEN 2 THEN (30000000 + o_orderkey)::VARCHAR ELSE (400000000 + o_orderkey)::VARCHAR END AS number, 'Acier du Sud SARL' AS drawer FROM orders
""")
def draft_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and drawers of drafts whose labels were not read."""
    o, k, c, net, day = parts_of(spark, sf_dir)
    said = F.when(k % 4 == 0, say("Ordre de paiement\n", k + 10000000)).when(k % 4 == 1, say("LC N° : AB", k + 1000)).when(k % 4 == 2, say("CNP ", k + 30000000)).otherwise(say("RIB 12345678901\nle 01/02/2024 999999999\n202499999999\nx ", k + 400000000))
    page = say("Lettre\nAcier du Sud SARL ", c, "\n", said)
    docs = o.select(k.alias("doc_id"), page.alias("text"))
    return payments.drafts(docs, F.lit("2024-06-01").cast("date")).select("doc_id", "number", "drawer")


@query("""
SELECT o_orderkey AS name, CASE WHEN o_orderkey % 11 = 0 THEN 'no supplier' WHEN o_orderkey % 7 = 0 THEN 'no amount' END AS refused, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 THEN 'Facture N' || o_orderkey END AS item_name, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 THEN round(o_totalprice, 2) END AS rate,
  o_orderdate::DATE AS posting_date, o_orderdate::DATE + 30 AS due_date FROM orders
""")
def invoices_to_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: entries with their days, or why there is none."""
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    docs = table(spark, sf_dir, "orders").select(k.alias("name"), F.when(k % 11 == 0, " ").otherwise("x").alias("supplier"), say("N", k).alias("bill_no"), day.alias("bill_date"), F.date_add(day, 30).alias("due_date"), F.when(k % 7 == 0, 0.0).otherwise(F.round("o_totalprice", 2)).alias("net_total"), F.lit(0.0).alias("tax"), F.lit(0.0).alias("grand_total"))
    return documents.posted_invoice(docs).select("name", "refused", F.get("items", 0)["item_name"].alias("item_name"), F.get("items", 0)["rate"].alias("rate"), "posting_date", "due_date")


@query("""
SELECT s_suppkey AS id, 'ACIER TUNISIE' AS company, 'Alpha ' || s_suppkey AS named, 'OLEO' AS short FROM supplier
""")
def cut_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values cut before another field, a company's own words kept."""
    k = F.col("s_suppkey")
    labels = ["date", "tunisie", "montant", "rib"]
    return table(spark, sf_dir, "supplier").select(k.alias("id"), text.before_field(say("ACIER TUNISIE Montant ", k), labels).alias("company"), text.before_word_label(say("Alpha ", k, " Tel fixe : 71")).alias("named"), text.before_field(F.lit("OLEO"), labels).alias("short"))
