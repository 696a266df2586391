"""Token counts without ids.

Texts are split into pre-tokens: what stands between ASCII white space, which both kinds of vocabulary file
treat as a border; special strings inside a text stand within one pre-token, so that the tokenizer handles
them by its default. A table of the distinct pre-tokens of all texts is made, and the tokenizer counts the pieces
of each once. That table is joined to each document's pre-token frequencies, and frequency times pieces is
summed by document. No ids are kept.

Pre-tokens that stand in many documents (FREQUENT at most, chosen by the table's own counts) go with their
pieces to every task, so that none of them makes a hot task and their frequencies, nine in ten, are summed where
the text is. Frequencies of all others by document and pre-token are shuffled to the table, and their pieces
summed by document. Texts are read twice, and never shuffled or written.

Defined results: a null or empty text has 0 bytes and 0 tokens; a row without doc_id is counted like any other, and
repeated rows each on their own; an empty table gives an empty one. Very long texts are counted like
short ones. Columns other than the two that are named play no part, whatever their names.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.columns import pick
from docloom.llm.storage import Scratch

#: Pre-tokens whose pieces are broadcast, at most, and the most bytes of one.
FREQUENT, LONGEST = 250_000, 200
#: Classes of frequency for each doubling.
CLASSES = 8
#: Distinct pre-tokens that a task holds before it passes them on.
HELD = 400_000


class PieceCounter:
    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(tokenizer_file)
        self.lib.no_truncation()
        self.lib.no_padding()

    def counts(self, pre_tokens: list[str]) -> list[int]:
        return [len(e) for e in self.lib.encode_batch_fast(pre_tokens, add_special_tokens=False)]


_counters: dict[str, PieceCounter] = {}


def counter(tokenizer_file: str) -> PieceCounter:
    if tokenizer_file not in _counters:
        _counters[tokenizer_file] = PieceCounter(tokenizer_file)
    return _counters[tokenizer_file]


def in_portions(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of a batch, nulls as empty, with about so many bytes at most; (first row, texts)."""
    texts, first, size = [], 0, 0
    for k, x in enumerate(batch.column(column)):
        x = x.as_py() or ""
        if texts and size + len(x) > most:
            yield first, texts
            texts, first, size = [], k, 0
        texts.append(x)
        size += len(x)
    yield first, texts


def in_documents(source: DataFrame) -> DataFrame:
    """token, docs: in how many texts a pre-token stands; several rows for one, from several tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            got = pa.record_batch([pa.array([x.decode() for x in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "docs"])
            seen.clear()
            return got

        for b in batches:
            for x in b.column(1):
                seen.update(set((x.as_py() or "").encode().split()))
                if len(seen) > HELD:
                    yield out()
        yield out()

    return source.mapInArrow(work, "token string, docs long")


def piece_table(found: DataFrame, tokenizer_file: str) -> DataFrame:
    """token, docs, pieces: each distinct pre-token, in how many texts it stands, and its pieces."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer_file)
        for b in batches:
            for first in range(0, b.num_rows, 10_000):
                part = b.slice(first, 10_000)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(c.counts(part.column(0).to_pylist()), pa.int64())], ["token", "docs", "pieces"])

    return found.groupBy("token").agg(F.sum("docs").alias("docs")).mapInArrow(work, "token string, docs long, pieces long")


def frequencies(source: DataFrame, often) -> DataFrame:
    """row, doc_id, n_bytes, n (pieces of the frequent pre-tokens), rare (the others) and times. often: a broadcast of pieces by pre-token."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces, row = often.value, TaskContext.get().partitionId() << 40
        for b in batches:
            for first, texts in in_portions(b, 1):
                size, n, rare, times = [], [], [], []
                for x in texts:
                    raw = x.encode()
                    found = Counter(raw.split())
                    other = [w for w in found if w not in pieces]
                    size.append(len(raw))
                    rare.append([w.decode() for w in other])
                    times.append([found.pop(w) for w in other])
                    n.append(sum(k * pieces[w] for w, k in found.items()))
                ids = pa.array(range(row, row + len(texts)), pa.int64())
                row += len(texts)
                yield pa.record_batch([ids, b.column(0).slice(first, len(texts)), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(rare, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))], ["row", "doc_id", "n_bytes", "n", "rare", "times"])

    return source.mapInArrow(work, f"row long, doc_id {source.dtypes[0][1]}, n_bytes long, n long, rare array<string>, times array<long>")


def least_docs(table: DataFrame) -> int:
    """In how many documents a pre-token must stand so that FREQUENT at most do: from counts by class of frequency."""
    found = table.where(F.octet_length("token") <= LONGEST).groupBy(F.ceil(F.log2("docs") * CLASSES).alias("class")).agg(F.count("*").alias("n"), F.min("docs").alias("docs")).collect()
    left, least = FREQUENT, 1 << 62
    for r in sorted(found, key=lambda r: -r["class"]):
        left -= r["n"]
        if left < 0:
            break
        least = r["docs"]
    return least


def token_counts(df: DataFrame, tokenizer_file: str, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row."""
    spark = df.sparkSession
    scratch = Scratch(spark, "pieces")
    source = pick(df, doc_id=key, text=text)
    table = scratch.save(piece_table(in_documents(source), tokenizer_file), "table")
    # FREQUENT rows at most
    often = table.where((F.col("docs") >= least_docs(table)) & (F.octet_length("token") <= LONGEST)).select("token", "pieces").toArrow()
    known = spark.sparkContext.broadcast({w.encode(): k for w, k in zip(often.column(0).to_pylist(), often.column(1).to_pylist(), strict=True)})
    rows = scratch.save(frequencies(source, known), "rows")
    rare = rows.select("row", F.inline(F.arrays_zip("rare", "times"))).join(table.select(F.col("token").alias("rare"), "pieces"), "rare")
    sums = rare.groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    n = F.col("n") + F.coalesce("more", F.lit(0))
    return rows.drop("rare", "times").join(sums, "row", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
