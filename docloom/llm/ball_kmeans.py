"""Clusters of vectors by ball k-means, exact in integers.

Each component x becomes the integer floor(256 * x). A cluster is a ball: its centroid, and as radius its
farthest member's distance. When centroids have moved, a ball's radius grows by no more than the move; its neighbours are
the centroids within twice that radius, as any other is farther from every member than the ball's own. These few
numbers are worked out on the driver from one row for each cluster. In a task the members of a ball are
sorted by their distance from its centroid. Members that are nearer than half the way to the nearest neighbour are
the stable core and are compared with nothing; the others lie in annuli, and those beyond half the way to the n-th neighbour
are compared with it. So each assignment is that of all comparisons, ties included.

Vectors stay where they are: each round writes them with their cluster and reads the sums of their components, one row
for each cluster and task, summed by Spark before they reach the driver (one row for each cluster in all). There is no shuffle
of vectors, and a hot cluster is summed in every task.

Defined results: vectors with another number of components, null or with a component that is null, not finite, or beyond LIMIT
after scaling (squares of longer ones do not fit into a long) get no row; rows without id are clustered like others and seed
under an empty name; repeated rows are vectors each, and of rows with one id the one with the smaller cells seeds first. Fewer
vectors than clusters give as many clusters as vectors; an empty table gives an empty one. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.columns import pick
from docloom.llm.storage import Scratch

SCALE = 256
#: Greatest magnitude of a scaled component; LIMIT * 2 squared, 64 times, is below 2 ** 63.
LIMIT = 2**27
VECTORS = "vec_id long, cells array<int>, cluster int, distance long"
_ARROW = pa.schema([("vec_id", pa.int64()), ("cells", pa.list_(pa.int32())), ("cluster", pa.int32()), ("distance", pa.int64())])
#: Rows that a task handles at a time.
PORTION = 20_000


def _cells(rows: pa.RecordBatch, dim: int) -> np.ndarray:
    column = rows.column("cells")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _out(ids: pa.Array, cells: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    n, dim = cells.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
    return pa.record_batch([ids.cast(pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(cells.reshape(-1).astype(np.int32))), pa.array(cluster.astype(np.int32)), pa.array(distance.astype(np.int64))], schema=_ARROW)


def whole(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Vectors to integers, all in ball 0; those that cannot be compared go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fits = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b.column("embedding")), dim), False))
            ids, flat = fits.column("vec_id"), fits.column("embedding").flatten()
            x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
            # a null became not-a-number above
            good = np.isfinite(x).all(axis=1)
            with np.errstate(over="ignore", invalid="ignore"):
                cells = np.floor(SCALE * x)
            good &= (np.abs(cells) <= LIMIT).all(axis=1)
            n = int(good.sum())
            yield _out(ids.filter(pa.array(good)), cells[good], np.zeros(n), np.zeros(n))

    return run


def distances(cells: np.ndarray, squares: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances of rows from a centre, exact: in doubles while all terms stay below 2 ** 53."""
    if cells.dtype == np.float64:
        return squares - 2 * (cells @ centre) + centre @ centre
    gap = cells - centre
    return (gap * gap).sum(axis=1)


def nearest(cells: np.ndarray, cluster: np.ndarray, centres: np.ndarray, near: list[list[int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and squared distance of each row, and how many comparisons with neighbours it took. near: each ball's neighbours, nearest first."""
    most = int(max(np.abs(cells).max(initial=0), np.abs(centres).max(initial=0)))
    kind = np.float64 if 4 * cells.shape[1] * most * most < 2**53 else np.int64
    x, c = cells.astype(kind), centres.astype(kind)
    squares = (x * x).sum(axis=1)
    best, own, compared = np.empty(len(x), np.int64), cluster.astype(np.int64), 0
    for i in np.unique(cluster):
        rows = np.flatnonzero(cluster == i)
        mine = distances(x[rows], squares[rows], c[i]).astype(np.int64)
        order = np.argsort(-mine, kind="stable")
        rows, mine = rows[order], mine[order]
        members, parts = x[rows], squares[rows]
        least, at = mine.copy(), np.full(len(rows), i, np.int64)
        for j in near[i]:
            gap = int(sum((int(a) - int(b)) ** 2 for a, b in zip(centres[i], centres[j], strict=True)))
            # members at half the way to the neighbour or beyond: 4 * mine >= gap; they stand first
            outer = int(np.searchsorted(-mine, -(-(-gap // 4)), side="right"))
            if not outer:
                break
            there = distances(members[:outer], parts[:outer], c[j]).astype(np.int64)
            closer = (there < least[:outer]) | (there == least[:outer]) & (j < at[:outer])
            least[:outer][closer], at[:outer][closer] = there[closer], j
            compared += outer
        best[rows], own[rows] = least, at
    return own, best, compared


def assigned(centres: list[list[int]], near: list[list[int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centres, np.int64)
        for batch in batches:
            for at in range(0, len(batch), PORTION):
                b = batch.slice(at, PORTION)
                cells = _cells(b, c.shape[1])
                own, best, _ = nearest(cells, b.column("cluster").to_numpy(), c, near)
                yield _out(b.column("vec_id"), cells, own, best)

    return run


def summed(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's vectors to one row for each cluster: members, greatest squared distance, sums of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, int, np.ndarray]] = {}
        for b in batches:
            cells, cluster, far = _cells(b, dim).astype(np.int64), b.column("cluster").to_numpy(), b.column("distance").to_numpy()
            for i in np.unique(cluster).tolist():
                rows = cluster == i
                n, most, sums = found.get(i, (0, 0, np.zeros(dim, np.int64)))
                found[i] = n + int(rows.sum()), max(most, int(far[rows].max())), sums + cells[rows].sum(axis=0)
        names = ["cluster", "n", "far", *[f"s{k}" for k in range(dim)]]
        yield pa.RecordBatch.from_pylist([dict(zip(names, [i, n, most, *sums.tolist()], strict=True)) for i, (n, most, sums) in found.items()], pa.schema([(x, pa.int64()) for x in names]))

    return run


def _squared(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def _root(n: int) -> int:
    """The square root, rounded up."""
    r = math.isqrt(n)
    return r + (r * r < n)


def neighbours(centres: list[list[int]], radii: list[int | None]) -> list[list[int]]:
    """For each ball the centroids within twice its radius, nearest first; all of them where the radius is not known."""
    found = []
    for i, a in enumerate(centres):
        gaps = sorted((_squared(a, b), j) for j, b in enumerate(centres) if j != i)
        found.append([j for gap, j in gaps if radii[i] is None or gap <= 4 * radii[i] ** 2])
    return found


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each vector of dim finite components."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "balls")
    picked = pick(vectors, vec_id=key, embedding=vector).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    now = scratch.save(picked.mapInArrow(whole(dim), VECTORS), "assigned0")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centres = [list(r.cells) for r in now.orderBy(name, "cells").select("cells").limit(k).collect()]
    if not centres:
        return now.select("vec_id", "cluster", "distance", F.lit(None).cast("long").alias("cluster_inertia"), F.lit(None).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    radii: list[int | None] = [None] * len(centres)
    for n in range(1, rounds + 2):
        now = scratch.save(now.mapInArrow(assigned(centres, neighbours(centres, radii)), VECTORS), f"assigned{n}")
        scratch.drop(f"assigned{n - 1}")
        if n > rounds:
            break
        sums = [f"s{j}" for j in range(dim)]
        parts = now.mapInArrow(summed(dim), ", ".join(f"{c} long" for c in ("cluster", "n", "far", *sums)))
        # one row for each cluster: decimals, as sums over a large table may pass a long
        balls = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("far").alias("far"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in sums]).collect()
        radii = [0] * len(centres)
        for b in balls:
            moved = [int(b[c]) // b.n for c in sums]
            radii[b.cluster] = _root(b.far) + _root(_squared(moved, centres[b.cluster]))
            centres[b.cluster] = moved
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    inertia = {r.cluster: int(r.d) for r in now.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    small = [(i, min(d, 2**63 - 1), min(sum(inertia.values()), 2**63 - 1), digests[i]) for i, d in inertia.items()]
    of = F.broadcast(spark.createDataFrame(small, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return now.join(of, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
