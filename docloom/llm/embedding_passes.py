"""Near-duplicate vectors by sorted projection passes.

Equal vectors of a label become one node first. A node's sketch has 256 signs of random projections. Each
pass orders the nodes of a label lexicographically by 64 of the signs, in an order of its own, and
compares each node's sketch with those of the WINDOW nodes before it; pairs whose sketches don't rule out
the wanted cosine are verified in double precision on the vectors. Verified pairs of all passes are united
into components. FIRST passes are made for all labels, and show how many first signs the nodes at both ends of a window have in
common where they are not near each other: the two of a lone pair must agree in as many to meet. A label gets
as many further passes as a pair at the wanted cosine needs for that with a chance of MISS short of one, so a label of many
nodes, or of nodes in one direction, gets more. One that would need more than MOST is compared whole instead. Orders are made by range
partitioning on (pass, label, signs, id), so that a label with a third of all rows is spread over all tasks.

A window bounds the pairs that a pass finds, not those that are counted: the members of each component are then compared with
each other in packed blocks, each pair of blocks a group of its own, so that all links of a component count, however
dense it is. So components are those that the passes find (of lone pairs at the wanted cosine about MISS are missed), and links
inside them are exact; the work grows with the vectors and with the squares of components, not with those of labels. ``exact``
compares all vectors of every label, which loses nothing and whose work grows with the squares of labels.

Defined results: a null label, and a vector that is null, empty, zero or holds null or non-finite components,
links with nothing; such a row is its own component and kept. Rows with equal labels and vectors are always
linked; vectors of different lengths never. A row without vec_id counts as a vector, has the component of
its copies, and is kept only where there is none. Rows that repeat a vec_id count each. An empty table gives an empty
one; columns other than the three named play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.columns import pick
from docloom.llm.components import components
from docloom.llm.storage import Scratch

SIGNS, KEY, WINDOW = 256, 64, 4
#: A lone pair at the wanted cosine is missed with this chance, about; passes of every label, and of one at most.
MISS, FIRST, MOST = 0.02, 4, 160
#: Of the windows' ends that are not near each other, those with more first signs in common than this share of all others don't count.
DEPTH = 0.95
#: Bytes of a block of vectors, about, and rows of it that are compared at once.
BLOCK, TILE = 4 << 20, 512
#: Standard deviations of the sketch that the wanted cosine may be missed by.
SLACK = 6.0


def projections(size: int) -> np.ndarray:
    return np.random.default_rng(31).standard_normal((SIGNS, size))


def orders() -> np.ndarray:
    rng = np.random.default_rng(32)
    return np.stack([rng.permutation(SIGNS)[:KEY] for _ in range(MOST)])


def most_differing(cosine: float) -> int:
    p = np.arccos(cosine) / np.pi
    return int(SIGNS * p + SLACK * np.sqrt(SIGNS * p * (1 - p)))


def passes_for(depth: np.ndarray, cosine: float) -> np.ndarray:
    """Passes for labels in which a pair must agree in so many first signs to meet."""
    p = 1 - np.arccos(min(cosine, 1.0)) / np.pi
    hit = p ** np.asarray(depth, float)
    return np.maximum(np.ceil(np.log(MISS) / np.log1p(-np.minimum(hit, 0.999))), FIRST).astype(int)


def pass_rows(nodes: DataFrame, begin: int = 0) -> DataFrame:
    """A row for each node and pass of its label from begin on: pass, label, key (signs), id, sketch. nodes: id, label, vector, passes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        picks = orders()
        for b in batches:
            ids, labels = b.column(0), b.column(1)
            vectors = [np.array(x, float) for x in b.column(2).to_pylist()]
            passes = b.column(3).to_numpy()
            signs = np.zeros((len(vectors), SIGNS), np.uint8)
            for k, v in enumerate(vectors):
                if len(v) not in planes:
                    planes[len(v)] = projections(len(v))
                signs[k] = planes[len(v)] @ v > 0
            sketch = pa.array([x.tobytes() for x in np.packbits(signs, axis=1)], pa.binary())
            for p in range(begin, int(passes.max(initial=0))):
                at = pa.array(np.flatnonzero(passes > p))
                key = pa.array([x.tobytes() for x in np.packbits(signs[passes > p][:, picks[p]], axis=1)], pa.binary())
                yield pa.record_batch([pa.array(np.full(len(at), p, np.int32)), labels.take(at), key, ids.take(at), sketch.take(at)], ["pass", "label", "key", "id", "sketch"])

    return nodes.select("id", "label", "vector", F.col("passes").cast("int")).mapInArrow(work, f"pass int, label {dict(nodes.dtypes)['label']}, key binary, id long, sketch binary")


def common_signs(groups: list, keys: np.ndarray, sketches: np.ndarray, near: int, fresh: int) -> list[tuple]:
    """(label, first signs in common, how often) of nodes and the WINDOW-th before them in the same group whose sketches differ in more than near signs."""
    at = np.arange(max(WINDOW, fresh), len(keys))
    if not len(at):
        return []
    at = at[np.bitwise_count(sketches[at] ^ sketches[at - WINDOW]).sum(1) > near]
    off = keys[at] ^ keys[at - WINDOW]
    depth = np.where(off == 0, KEY, KEY - 1 - np.floor(np.log2(np.maximum(off, 1).astype(np.longdouble))).astype(int))
    counts: dict[tuple, int] = {}
    for i, d in zip(at.tolist(), depth.tolist(), strict=True):
        if groups[i] == groups[i - WINDOW]:
            k = (groups[i][1], d)
            counts[k] = counts.get(k, 0) + 1
    return [(label, d, n) for (label, d), n in counts.items()]


def near_in(groups: list, ids: np.ndarray, sketches: np.ndarray, limit: int, fresh: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a node and one of the WINDOW before it in the same group; only with nodes from the fresh-th on."""
    found = []
    for step in range(1, WINDOW + 1):
        at = np.arange(max(step, fresh), len(ids))
        if len(at):
            differing = np.bitwise_count(sketches[at] ^ sketches[at - step]).sum(1)
            at = at[(differing <= limit) & (ids[at] != ids[at - step])]
            at = np.array([i for i in at if groups[i] == groups[i - step]], int)
            found.append((ids[at], ids[at - step]))
    return found


#: What rows of candidates are.
PAIR, EDGE, COMMON = 0, 1, 2


def candidates(rows: DataFrame, cosine: float) -> DataFrame:
    """By kind: pairs (a, b); the WINDOW first and last rows of each partition (a: id, b: its number, from below for the last); and how often (b) the ends of a window of a label have so many first signs (a) in common."""
    limit, close = most_differing(cosine), int(SIGNS * np.arccos(cosine) / np.pi)
    label_type = dict(rows.dtypes)["label"]
    ordered = rows.repartitionByRange("pass", "label", "key", "id").sortWithinPartitions("pass", "label", "key", "id")
    names = ["kind", "a", "b", "part", "pass", "label", "sketch"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, seen, kind = TaskContext.get().partitionId(), [], 0, None

        def batch(what: int, a: list, b: list, passes: list | None = None, labels: list | None = None, sketches: list | None = None) -> pa.RecordBatch:
            n = len(a)
            some = lambda x, t: pa.nulls(n, t) if x is None else pa.array(x, t)
            return pa.record_batch([pa.array([what] * n, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([part] * n, pa.int32()), some(passes, pa.int32()), some(labels, kind), some(sketches, pa.binary())], names)

        def edges(ends: list, numbers: range) -> pa.RecordBatch:
            return batch(EDGE, [r[2] for r in ends], list(numbers), [r[0] for r in ends], [r[1] for r in ends], [r[3] for r in ends])

        for b in batches:
            kind = b.schema.field(1).type
            rows = held + list(zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4, 2)), strict=True))
            if seen < WINDOW:
                ends = rows[len(held) :][: WINDOW - seen]
                yield edges(ends, range(seen, seen + len(ends)))
            seen += b.num_rows
            if rows:
                ids = np.array([r[2] for r in rows], np.int64)
                sketches = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
                groups = [r[:2] for r in rows]
                for x, y in near_in(groups, ids, sketches, limit, len(held)):
                    if len(x):
                        yield batch(PAIR, np.minimum(x, y).tolist(), np.maximum(x, y).tolist())
                keys = np.frombuffer(b"".join(r[4] for r in rows), ">u8").astype(np.uint64)
                if common := common_signs(groups, keys, sketches, close, len(held)):
                    yield batch(COMMON, [d for _, d, _ in common], [n for *_, n in common], None, [x for x, *_ in common])
            held = rows[-WINDOW:]
        if held:
            yield edges(held, range(-len(held), 0))

    return ordered.mapInArrow(work, f"kind int, a long, b long, part int, pass int, label {label_type}, sketch binary")


def across(edges: list, cosine: float) -> list[tuple[int, int]]:
    """Pairs over the borders of partitions, from each one's first and last rows; partitions may be smaller than the window."""
    limit, found, tail = most_differing(cosine), [], []
    for part in sorted({e.part for e in edges}):
        own = [e for e in edges if e.part == part]
        first = sorted((e for e in own if e.b >= 0), key=lambda e: e.b)
        last = sorted((e for e in own if e.b < 0), key=lambda e: e.b)
        line = tail + first
        ids = np.array([e.a for e in line], np.int64)
        sketches = np.frombuffer(b"".join(e.sketch for e in line), np.uint8).reshape(len(line), -1)
        for x, y in near_in([(e["pass"], e["label"]) for e in line], ids, sketches, limit, len(tail)):
            found += [(int(min(p)), int(max(p))) for p in zip(x, y, strict=True)]
        tail = (tail + last)[-WINDOW:] if len(last) < WINDOW else last
    return found


def usable(vector, label):
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(label.isNotNull() & vector.isNotNull() & good, F.lit(False))


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=-1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=-1, keepdims=True))


def verified(pairs: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    """The pairs whose cosine, in double precision, is high enough."""
    both = pairs.join(vectors.select(F.col("id").alias("a"), F.col("vector").alias("x")), "a").join(vectors.select(F.col("id").alias("b"), F.col("vector").alias("y")), "b").select("a", "b", "x", "y").where(F.size("x") == F.size("y"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [float(unit(np.array(x, float)) @ unit(np.array(y, float))) >= cosine for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(work, "a long, b long")


def bridges(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Of the links (left's rows, right's columns) so many as join all components that they join."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    found = []
    for x, y in zip(*np.nonzero(near & (left[:, None] != right[None, :])), strict=True):
        a, b = int(left[x]), int(right[y])
        p, q = root(a), root(b)
        if p != q:
            up[max(p, q)] = min(p, q)
            found.append((a, b))
    return found


def blocks(nodes: DataFrame, by: str) -> DataFrame:
    """by, size, own (number of the block), blocks (of its by and size), and packed: ids, components, copies, vectors."""
    scratch = Scratch(nodes.sparkSession, "blocks")
    nodes = nodes.withColumn("size", F.size("vector"))
    count = F.ceil(F.count("*") * F.col("size") * 8 / BLOCK).cast("int")
    sizes = scratch.save(nodes.groupBy(by, "size").agg(count.alias("blocks"), F.count("*").alias("nodes")).toDF("of", "of_size", "blocks", "nodes").where("nodes > 1"), "sizes")
    own = nodes.join(sizes, (F.col(by) == F.col("of")) & (F.col("size") == F.col("of_size"))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    kind = dict(nodes.dtypes)[by]

    def pack(t: pd.DataFrame) -> pd.DataFrame:
        v = unit(np.stack([np.asarray(x, float) for x in t["vector"]]))
        first = t.iloc[0]
        return pd.DataFrame({"by": [first["by"]], "size": [first["size"]], "own": [first["own"]], "blocks": [first["blocks"]], "ids": [t["id"].to_numpy(np.int64).tobytes()], "components": [t["component"].to_numpy(np.int64).tobytes()], "copies": [t["copies"].to_numpy(np.int64).tobytes()], "vectors": [v.tobytes()]})

    packed = own.select(F.col(by).alias("by"), "size", "own", "blocks", "id", "component", "copies", "vector").groupBy("by", "size", "own")
    return scratch.save(packed.applyInPandas(pack, f"by {kind}, size int, own int, blocks int, ids binary, components binary, copies binary, vectors binary"), "packed")


def all_links(nodes: DataFrame, cosine: float, by: str) -> DataFrame:
    """id, links (vectors of other nodes of equal by at that cosine), other null; and, links null, components (id, other) that a link joins. by: component, or label for all pairs of it. nodes: id, label, component, vector, copies."""
    packed = blocks(nodes, by)
    dealt = packed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "blocks")

    def work(key, t: pd.DataFrame) -> pd.DataFrame:
        _, size, i, j = key
        sides = {r.own: (np.frombuffer(r.ids, np.int64), np.frombuffer(r.components, np.int64), np.frombuffer(r.copies, np.int64), np.frombuffer(r.vectors, float).reshape(-1, size)) for r in t.itertuples()}
        # a block of hash classes may be empty
        if i not in sides or j not in sides:
            return pd.DataFrame({"id": pd.array([], "Int64"), "links": pd.array([], "Int64"), "other": pd.array([], "Int64")})
        (ids, parts, n, v), (ids2, parts2, n2, w) = sides[i], sides[j]
        left, right, joins = np.zeros(len(ids), np.int64), np.zeros(len(ids2), np.int64), []
        for at in range(0, len(ids), TILE):
            near = v[at : at + TILE] @ w.T >= cosine
            if i == j:
                near[np.arange(len(near)), np.arange(at, at + len(near))] = False
            else:
                right += n[at : at + TILE] @ near
            left[at : at + TILE] = near @ n2
            joins += bridges(near, parts[at : at + TILE], parts2)
        known = ids if i == j else np.concatenate([ids, ids2])
        counts = left if i == j else np.concatenate([left, right])
        return pd.DataFrame({
            "id": np.concatenate([known, np.array([a for a, _ in joins], np.int64)]),
            "links": pd.array([*counts.tolist(), *[None] * len(joins)], "Int64"),
            "other": pd.array([*[None] * len(known), *[b for _, b in joins]], "Int64"),
        })

    return dealt.groupBy("by", "size", "i", "j").applyInPandas(work, "id long, links long, other long")


def passes(nodes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """The links (a, b) that the passes find, and the labels (of) that are to be compared whole. nodes: id, label, vector. Partitions' first and last WINDOW rows come to the driver."""
    spark = nodes.sparkSession
    scratch = Scratch(spark, "passes")

    def met(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        found = scratch.save(candidates(rows, cosine), name)
        pairs = found.where(F.col("kind") == PAIR).select("a", "b")
        if more := across(found.where(F.col("kind") == EDGE).collect(), cosine):
            pairs = pairs.unionByName(spark.createDataFrame(more, "a long, b long"))
        return pairs, found

    first, found = met(pass_rows(nodes.withColumn("passes", F.lit(FIRST))), "first")
    depth = found.where(F.col("kind") == COMMON).groupBy(F.col("label").alias("of")).agg(F.percentile("a", DEPTH, F.col("b")).alias("depth"))
    table = F.create_map(*[F.lit(x) for d in range(KEY + 1) for x in (d, int(passes_for(np.array([d]), cosine)[0]))])
    wanted = scratch.save(depth.select("of", table[F.ceil("depth").cast("int")].alias("passes")), "wanted")
    more = nodes.join(wanted.where(F.col("passes").between(FIRST + 1, MOST)), F.col("label") == F.col("of"))
    second, _ = met(pass_rows(more.select("id", "label", "vector", "passes"), FIRST), "second")
    links = scratch.save(verified(scratch.save(first.unionByName(second).distinct(), "pairs"), nodes.select("id", "vector"), cosine), "links")
    dense = scratch.save(wanted.where(F.col("passes") > MOST).select("of"), "dense")
    scratch.drop("first", "second", "pairs")
    return links, dense


def pass_links(nodes: DataFrame, cosine: float) -> DataFrame:
    """The links (a, b) that the passes find. nodes: id, label, vector."""
    return passes(nodes, cosine)[0]


def groups(df: DataFrame, cosine: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row. exact: beyond the passes, all vectors of a label are compared."""
    spark = df.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = pick(df, vec_id=key, vector=vector, label=label).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"), "label")
    good = rows.where(usable(F.col("vector"), F.col("label")))
    # -0.0 and 0.0 are one number, as in the comparison
    same = F.xxhash64("label", F.transform("vector", lambda x: x + F.lit(0.0)))
    nodes = good.groupBy("label", F.transform("vector", lambda x: x + F.lit(0.0)).alias("vector")).agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    nodes = scratch.save(nodes.where("id is not null"), "nodes")
    links, dense = passes(nodes, cosine)
    labels = scratch.save(components(links), "labels")
    placed = nodes.join(labels, nodes.id == labels.node, "left").select("id", "label", F.coalesce("component", "id").alias("component"), "vector", "copies")
    placed = scratch.save(placed, "placed")
    is_dense = F.col("label") == F.col("of")
    if exact:
        compared = all_links(placed, cosine, "label")
    else:
        compared = all_links(placed.join(dense, is_dense, "left_anti"), cosine, "component")
        if not dense.isEmpty():
            compared = compared.unionByName(all_links(placed.join(dense, is_dense, "left_semi"), cosine, "label"))
    compared = scratch.save(compared, "compared")
    counts = compared.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    # a component is named by its smallest id, and so is what its bridges join
    joined = scratch.save(components(compared.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))), "joined")
    known = placed.withColumnRenamed("component", "part").join(joined, F.col("part") == joined.node, "left").join(counts, "id", "left").withColumn("component", F.coalesce("component", "part"))
    known = known.select(F.col("label").alias("of_label"), F.col("vector").alias("of_vector"), F.coalesce("component", "id").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    known = scratch.save(known.withColumn("hash", F.xxhash64("of_label", "of_vector")), "known")
    at = rows.withColumn("hash", F.when(usable(F.col("vector"), F.col("label")), same))
    out = at.join(known, (at.hash == known.hash) & (F.col("label") == F.col("of_label")) & (F.transform("vector", lambda x: x + F.lit(0.0)) == F.col("of_vector")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))
