"""Exact duplicates by a minimal perfect hash over the digests that are known already.

Texts are equal when they are identical after each run of white space has become one space; they are compared by
SHA-256. The history, all rows up to a border of ids (or an index of earlier runs), is first reduced to
distinct digests with the locator of the row that stays. Digests are dealt to buckets by hash, and each bucket's
task builds a minimal perfect hash: level by level, digests that are alone at their place in a bit array
get it, the others go on to the next array; the slot is the number of set bits before it. A
slot holds the full digest, the winner's id and row, and how many rows have it. Newer texts are reduced to distinct
digests as well, look their slot up and are members only if all 32 bytes agree; members add to their slot's
count, and nonmembers are groups of their own.

Counts are partial aggregations, so that a text that a third of all rows share is one row of each task
before the shuffle; a bucket holds about PER_BUCKET digests at any size of the input, whatever the copies. The last join
gives each row its group; it is an ordinary shuffled one, whose hot keys Spark splits.

Defined results: a null text is empty, and all empty texts are equal; a text of white space alone is one space. Of
equal texts the smallest id stays, ids that are null last; of rows with the same id and text one stays. An empty table gives
an empty one. Texts of any length are digested whole. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.columns import pick
from docloom.llm.storage import Scratch

#: Digests of a bucket, about; a bucket is one task's work.
PER_BUCKET = 50_000
#: Places of a level for each digest that is left.
ROOM = 2
WIDTH = 32
GROUPS = "digest binary, winner long, row long, size long"
INDEX = "bucket long, levels array<long>, bits binary, digests binary, winners array<long>, rows array<long>, sizes array<long>"


def digest(text: Column) -> Column:
    """SHA-256 of a text whose runs of white space are one space each."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " "), 256))


def distinct(rows: DataFrame) -> DataFrame:
    """digest, winner (smallest id), row (the winner's), size, from rows of digest, doc_id, row."""
    # min_by knows no null ids
    row = F.coalesce(F.min_by("row", "doc_id"), F.min("row"))
    return rows.groupBy("digest").agg(F.min("doc_id").alias("winner"), row.alias("row"), F.count("*").alias("size"))


def places(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """The place of each digest, given as four words, in a level of that size."""
    h = np.full(len(words), (level + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return (h % np.uint64(size)).astype(np.int64)


def as_words(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests).view("<u8").reshape(len(digests), WIDTH // 8)


def perfect_hash(digests: np.ndarray) -> list[np.ndarray]:
    """Bit arrays, one a level, of a minimal perfect hash over distinct digests (n x 32 bytes)."""
    left, levels = as_words(digests), []
    while len(left):
        size = max(64, ROOM * len(left))
        at = places(left, len(levels), size)
        bits = np.bincount(at, minlength=size) == 1
        levels.append(bits)
        left = left[~bits[at]]
    return levels


def slots(digests: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The slot of each digest; of one that the hash was not built over, any slot or -1."""
    words, found = as_words(digests), np.full(len(digests), -1, np.int64)
    left, before = np.arange(len(digests)), 0
    for k, bits in enumerate(levels):
        at = places(words[left], k, len(bits))
        hit = bits[at]
        rank = np.cumsum(bits)
        found[left[hit]] = before + rank[at[hit]] - 1
        left, before = left[~hit], before + int(rank[-1])
    return found


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDTH)


def _built(group: pa.Table) -> pa.Table:
    """One bucket's digests to its row of the index."""
    digests = _matrix(group["digest"])
    levels = perfect_hash(digests)
    order = np.argsort(slots(digests, levels))
    in_slots = group.take(pa.array(order))
    row = {"bucket": group["bucket"][0].as_py(), "levels": [len(x) for x in levels], "bits": b"".join(np.packbits(x).tobytes() for x in levels), "digests": digests[order].tobytes()}
    row |= {f"{c}s": in_slots[c].to_pylist() for c in ("winner", "row", "size")}
    return pa.Table.from_pylist([row], pa.schema([("bucket", pa.int64()), ("levels", pa.list_(pa.int64())), ("bits", pa.binary()), ("digests", pa.binary()), *[(f"{c}s", pa.list_(pa.int64())) for c in ("winner", "row", "size")]]))


def _levels(sizes: list[int], packed: bytes) -> list[np.ndarray]:
    found, at = [], 0
    for n in sizes:
        width = -(-n // 8)
        found.append(np.unpackbits(np.frombuffer(packed, np.uint8, width, at), count=n).astype(bool))
        at += width
    return found


def _merged(new: pa.Table, index: pa.Table) -> pa.Table:
    """A bucket's slots with the rows that newer members add, and its nonmembers."""
    out = pa.schema([("digest", pa.binary()), ("winner", pa.int64()), ("row", pa.int64()), ("size", pa.int64())])
    new = new.select(out.names).cast(out)
    if not len(index):
        return new
    bucket = index.to_pylist()[0]
    held = np.frombuffer(bucket["digests"], np.uint8).reshape(-1, WIDTH)
    keys = _matrix(new["digest"])
    slot = slots(keys, _levels(bucket["levels"], bucket["bits"]))
    member = slot >= 0
    member[member] = (held[slot[member]] == keys[member]).all(axis=1)
    sizes = np.array(bucket["sizes"], np.int64)
    # each member's digest is there once, so no slot is met twice
    sizes[slot[member]] += new["size"].to_numpy()[member]
    winners, rows = bucket["winners"], bucket["rows"]
    for k, winner, row in zip(slot[member].tolist(), *(new.filter(pa.array(member))[c].to_pylist() for c in ("winner", "row")), strict=True):
        if winner is not None and (winners[k] is None or winner < winners[k]):
            winners[k], rows[k] = winner, row
    known = pa.table([pa.array([x.tobytes() for x in held], pa.binary()), pa.array(winners, pa.int64()), pa.array(rows, pa.int64()), pa.array(sizes)], schema=out)
    return pa.concat_tables([known, new.filter(pa.array(~member))])


@dataclass
class Index:
    """A written table of buckets, and how many buckets there are."""

    table: DataFrame
    buckets: int

    def of(self) -> Column:
        return F.pmod(F.xxhash64("digest"), F.lit(self.buckets))


def build(history: DataFrame, scratch: Scratch, expected: int) -> Index:
    """The index of a table of distinct digests, in buckets for as many digests as are expected in all."""
    index = Index(history, max(1, -(-expected // PER_BUCKET)))
    dealt = history.withColumn("bucket", index.of())
    index.table = scratch.save(dealt.groupBy("bucket").applyInArrow(_built, INDEX), "index")
    return index


def merged(index: Index, new: DataFrame) -> DataFrame:
    """The groups of all digests, from an index and the distinct digests of newer rows."""
    dealt = new.withColumn("bucket", index.of())
    return dealt.groupBy("bucket").cogroup(index.table.groupBy("bucket")).applyInArrow(_merged, GROUPS)


def _grouped(docs: DataFrame, text: str, key: str, border: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows (digest, doc_id, row) and groups, both written."""
    scratch = Scratch(docs.sparkSession, "exact")
    picked = pick(docs, doc_id=key, text=text)
    rows = scratch.save(picked.select(digest(F.col("text")).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row")), "rows")
    count, least, most = rows.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    if border is None and least is not None:
        border = least + (most - least) // 2
    old = F.coalesce(F.col("doc_id") <= F.lit(border).cast("long"), F.lit(False))
    index = build(distinct(rows.where(old)), scratch, count)
    return rows, scratch.save(merged(index, distinct(rows.where(~old))), "groups")


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id", border: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row. Rows with ids up to the border, by default the middle of the range of ids, are the history; the result is the same for any border."""
    rows, found = _grouped(docs, text, key, border)
    of = found.select("digest", F.col("winner").alias("keep_id"), F.col("size").alias("group_size"), F.col("row").alias("stays"))
    met = rows.join(of, "digest")
    return met.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("stays")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs, all columns, with one row of each group of equal texts."""
    rows, found = _grouped(docs, text, key, None)
    stays = found.select(F.col("digest").alias("__exact_digest"), F.col("winner").alias("__exact_winner"), "row")
    mine = docs.withColumn("__exact_of", digest(F.col(f"`{text}`")))
    same = (F.col("__exact_of") == F.col("__exact_digest")) & F.col(f"`{key}`").cast("long").eqNullSafe(F.col("__exact_winner"))
    # rows that share the winner's id and text are one row only after a grouping, and only then texts are shuffled
    again = rows.join(found.select("digest", "winner", F.col("row").alias("stays")), "digest").where(F.col("doc_id").eqNullSafe(F.col("winner")) & (F.col("row") != F.col("stays")))
    again = Scratch(docs.sparkSession, "repeated").save(again.select("digest").distinct(), "digests")
    names = [F.col(f"`{c}`") for c in docs.columns]
    if again.isEmpty():
        return mine.join(stays, same, "left_semi").select(names)
    winners = mine.join(stays, same, "left_semi")
    often = again.withColumnRenamed("digest", "__exact_digest")
    is_often = F.col("__exact_of") == F.col("__exact_digest")
    once = winners.join(often, is_often, "left_anti").select(names)
    more = winners.join(often, is_often, "left_semi").groupBy("__exact_of").agg(F.first(F.struct(*names)).alias("r")).select("r.*")
    return once.unionByName(more)
