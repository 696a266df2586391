"""Connected components of links between integer ids.

First each task reduces its share of the links (LOCAL at most) to a forest: every node and its smallest id
there. If that is one task's work, it is done. Else large and small stars alternate over what is left: each
step is a partial aggregation and a join with its saved result, so that a hub with many links is summed
before the shuffle and its join can be split. Rounds grow with the logarithm of a component's size; each
one's links are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.storage import Scratch

#: Links that one task holds at most.
LOCAL = 200_000


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) to (node, smallest id that these links connect it to)."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            up.setdefault(u, u)
            up.setdefault(v, v)
            x, y = root(u), root(v)
            if x != y:
                up[max(x, y)] = min(x, y)
    pairs = [(x, root(x)) for x in up]
    pairs = [p for p in pairs if p[0] != p[1]]
    yield pa.record_batch([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["u", "v"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest id) for every id that has a link to another."""
    scratch = Scratch(links.sparkSession, "components")
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = scratch.save(links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")), "links")
    parts = -(-now.count() // LOCAL) or 1
    now = scratch.save(now.coalesce(parts).mapInArrow(forest, "u long, v long"), "forests")
    scratch.drop("links")
    before, k = None, 0
    while parts > 1:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy(F.col("u").alias("n")).agg(F.least(F.min("v"), F.min("u")).alias("m")), f"large{k}")
        # large star: greater neighbours go to the least one
        large = both.where("v > u").join(least, F.col("u") == F.col("n")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"between{k}")
        # small star: a node and its smaller neighbours go to the least of them
        least = scratch.save(large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m")), f"small{k}")
        others = large.join(least, F.col("u") == F.col("n")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = others.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()
        now = scratch.save(small, f"round{k}")
        scratch.drop(f"large{k}", f"between{k}", f"small{k}", *([f"round{k - 1}"] if k else ["forests"]))
        k += 1
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
