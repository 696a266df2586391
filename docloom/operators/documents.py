"""Queries over stored documents and their links to the books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import vocabulary as V
from docloom.functions.text import file_variants
from docloom.operators.contains import held


def status_counts(docs: DataFrame, status: str = "status") -> DataFrame:
    """All counts in one pass."""
    return docs.agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == s).alias(n) for n, s in (("pending", V.PENDING), ("running", V.RUNNING), ("valid", V.VALID), ("rejected", V.REJECTED))])


def history(docs: DataFrame, created: str = "creation", tie: str = "name", n: int = 100) -> DataFrame:
    """The latest n (top-k without a full sort)."""
    return docs.orderBy(F.desc(created), F.desc(tie)).limit(n)


def latest_per(docs: DataFrame, key: str, created: str, tie: str) -> DataFrame:
    """Of each key the latest row, as a partial aggregation instead of a window."""
    return docs.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*docs.columns), F.struct(created, tie)).alias("r")).select("r.*")


def top_per(docs: DataFrame, key: str, score: str, tie: str, n: int = 20) -> DataFrame:
    """Of each key the n best."""
    w = Window.partitionBy(key).orderBy(F.desc(score), tie)
    return docs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def pending(docs: DataFrame) -> DataFrame:
    """Waiting documents that have a file."""
    return docs.where((F.col("status") == V.PENDING) & F.col("file_url").isNotNull() & (F.col("file_url") != ""))


def most_frequent(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Of each key the value seen most often; the first seen of equals."""
    n = df.groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return n.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))


def first_per_role(df: DataFrame, key: str, role: str, value: str, place: str) -> DataFrame:
    """R19."""
    return df.groupBy(key, role).agg(F.min_by(value, place).alias(value))


def rolled_up(values: Column, how: str = "last") -> Column:
    """Of child values the greatest, or the last, that isn't zero."""
    some = F.filter(values, lambda x: x != 0)
    return F.array_max(some) if how == "max" else F.try_element_at(some, F.lit(-1))


def parties(suppliers: DataFrame, customers: DataFrame) -> DataFrame:
    """Names of both kinds that are in use."""
    active = lambda d, kind: d.where("disabled = 0").select("name", F.lit(kind).alias("kind"))
    return active(suppliers, "supplier").unionAll(active(customers, "customer"))


def missing_rows(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Rows to insert."""
    return wanted.join(have.select(key), key, "left_anti")


def duplicates(new: DataFrame, books: DataFrame, key: str, id_column: str = "name") -> DataFrame:
    """V7: new with the first live entry of the same key, and whether there is one."""
    live = books.where((F.col("docstatus") != 2) & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(id_column).alias("duplicate_of"))
    return new.join(live, new[key] == live["_key"], "left").drop("_key").withColumn("is_duplicate", F.col("duplicate_of").isNotNull())


def linked(docs: DataFrame, entries: DataFrame, most: int = 5) -> DataFrame:
    """Documents and the entries they link to; for entries that nothing links to, the first documents by name whose extracted fields hold the entry's number anywhere in their text, as many as most. Numbers meet texts by docloom.operators.contains. docs: name, linked_doctype, linked_docname, fields (map); entries: doctype, entry, bill_no."""
    direct = docs.join(entries, (F.col("linked_doctype") == F.col("doctype")) & (F.col("linked_docname") == F.col("entry"))).select("name", "doctype", "entry", F.lit(False).alias("by_number"))
    rest = entries.join(direct.select("doctype", "entry").distinct(), ["doctype", "entry"], "left_anti").where("bill_no <> ''")
    said = docs.select("name", F.to_json("fields").alias("_said"))
    pairs = held(said, rest, "_said", "bill_no").select(F.col("text").alias("_said"), F.col("phrase").alias("bill_no"))
    met = rest.join(pairs, "bill_no").join(said, "_said").select("name", "doctype", "entry").distinct()
    first = Window.partitionBy("doctype", "entry").orderBy("name")
    return direct.unionByName(met.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= most).select("name", "doctype", "entry", F.lit(True).alias("by_number")))


def status_of(workflow: Column, docstatus: Column) -> Column:
    """The workflow's state counts before the entry's."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.coalesce(F.try_element_at(table(V.WORKFLOW), F.coalesce(workflow, F.lit(""))), F.try_element_at(table(V.DOCSTATUS), docstatus))


def synced(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """(name, old, new) of the linked documents whose status changes."""
    j = docs.join(entries, (F.col("linked_doctype") == F.col("doctype")) & (F.col("linked_docname") == F.col("entry")))
    return j.select("name", F.col("status").alias("old"), status_of(F.col("workflow_state"), F.col("docstatus")).alias("new")).where("new is not null and new <> old")


def guarded_status(old: Column, new: Column) -> Column:
    """A final status doesn't go back to waiting."""
    return F.when(old.isin(V.FINAL) & (new == V.PENDING), old).otherwise(F.coalesce(new, old))


def upserted(stored: DataFrame, incoming: DataFrame, columns: list[str], key: str = "document_name") -> DataFrame:
    """Stored with incoming rows: the first stored row (by creation) that any variant of an incoming name fits gets the given columns, other incoming rows are added. incoming: one row for each name."""
    tries = incoming.select("*", F.posexplode(file_variants(F.col(key))).alias("_order", "_try"))
    ids = stored.groupBy(F.col(key).alias("_try")).agg(F.min("name").alias("_name"))
    hit = tries.join(ids, "_try").groupBy(F.col(key).alias("_in")).agg(F.min_by("_name", "_order").alias("_name"))
    matched = incoming.join(hit, incoming[key] == hit["_in"]).groupBy("_name").agg(*[F.max_by(c, key).alias(f"_new_{c}") for c in columns])
    kept = stored.join(matched, stored["name"] == matched["_name"], "left")
    updated = kept.select(*[F.when(F.col("_name").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns])
    fresh = incoming.join(hit, incoming[key] == hit["_in"], "left_anti")
    return updated.unionByName(fresh.select(*[F.col(c) if c in fresh.columns else F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in stored.columns]))


def posted_invoice(docs: DataFrame) -> DataFrame:
    """K2: an entry of one line at the net amount and its tax as an actual one, posted on the bill's day and due on its own; refused says why there is none: no supplier, or no amount. docs: name, supplier, bill_no, bill_date, net_total, tax, grand_total, and due_date where there is one."""
    from docloom.operators.checks import net_amount

    net = net_amount(F.col("net_total"), F.col("grand_total"), F.col("tax"))
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    some = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    refused = F.when(~has("supplier"), "no supplier").when(~(net > 0) & ~some("grand_total"), "no amount")
    line = F.struct(F.when(has("bill_no"), F.concat(F.lit("Facture "), "bill_no")).otherwise("Facture fournisseur").alias("item_name"), F.lit(1).alias("qty"), net.alias("rate"), F.lit("Nos").alias("uom"))
    tax = F.struct(F.lit("Actual").alias("charge_type"), F.col("tax").alias("tax_amount"))
    due = F.col("due_date") if "due_date" in docs.columns else F.lit(None).cast(docs.schema["bill_date"].dataType)
    return docs.select("name", "supplier", "bill_no", "bill_date", F.col("bill_date").alias("posting_date"), due.alias("due_date"), F.when(refused.isNull(), F.array(line)).alias("items"), F.when(refused.isNull() & some("tax"), F.array(tax)).alias("taxes"), refused.alias("refused"))


def payment_amount(read: Column, outstanding: Column, total: Column) -> Column:
    """K3: read, else outstanding, else total."""
    return F.coalesce(*[F.when(c > 0, c) for c in (read, outstanding, total)])
