"""The background worker's plan: texts of waiting documents to typed, checked fields and the status that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import vocabulary as V
from docloom.plans import invoices
from docloom.plans.steps import Steps

#: What a check's result makes of a document.
STATUS = {"valide": V.VALID, "validation_requise": V.TO_CHECK}


def worked(docs: DataFrame, steps: Steps | None = None) -> DataFrame:
    """Name, status, doc_type, n_errors of documents (name, text, status) that wait: those without text are refused, the others get the status of their checks. Works on a table or on each micro-batch of a stream (see streaming.upserts). W5: steps counts what its steps let through."""
    if steps:
        docs = steps.watch("loaded", docs)
    waiting = docs.where(F.col("status").isin(V.PENDING, V.RUNNING))
    read = invoices.read(waiting.select(F.col("name").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    table = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    checked = read.select(F.col("doc_id").alias("name"), "doc_type", "n_errors", F.try_element_at(table, F.col("status")).alias("checked"))
    out = waiting.select("name", empty.alias("empty")).join(checked, "name").select("name", F.when(F.col("empty"), V.REJECTED).otherwise(F.col("checked")).alias("status"), "doc_type", "n_errors")
    return steps.watch("checked", out) if steps else out
