"""Near-duplicate documents by an LSH forest over MinHash signatures.

Documents with the same set of five-word shingles become one node first. A node's signature has 64 minima.
Each of 16 trees orders the nodes by eight of them, and of each two neighbours there the longest common prefix is
taken; those that share FIRST values at least are candidates, as deep as they share any. Orders are made by range
partitioning on (values, id), so that even equal signatures are spread over all tasks; neighbours across two
partitions are joined from the partitions' first and last rows.

Candidates are confirmed on full shingle sets. Depth adapts to the region: each node first meets those of its
neighbours, over all trees, with which it shares the longest prefix, however long that is around it. Then, round by
round, come the shallower ones that still stand in different components, and beside them the hubs of these
components (the node with most links in each), until a round has nothing new to test or finds no link. A group
around one text whose copies differ among themselves is so joined through that text. A node that many pairs
name is salted: the other node's set travels, and its own is laid out once for each HOT pairs.

Trees and hubs find most links, but not surely all. What still stands apart is settled by an exact join: of
each node's shingles, rarest first, so many are listed that two similar sets must share a listed one. Nodes of
different components in one list are tested, first the WIDTHS most linked of each component there, at last
all. Parities of the sets rule out most pairs, here as before; whole sets confirm the rest. How rare a shingle is comes from a
sample; the order decides the cost only, as any order that is one for all nodes gives the same links.

Only candidates' sets are made, from their texts; signatures, listed shingles and ids are all that is sorted.

Texts of any length count whole. Columns other than the two named play no part, whatever their names; an empty
table gives an empty one. Defined results: null and empty texts, and texts of white space, have no shingles, link with nothing, are
their own component and are kept. Rows with equal sets are always linked. Rows that repeat a doc_id have its
component each. A row without doc_id takes the component of its set, null if no row has an id there; it is
kept only in that last case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.columns import give_back, pick, take_turns
from docloom.llm.components import components
from docloom.llm.storage import Scratch

SHINGLE, MINIMA, TREES, FIRST, DEPTH = 5, 64, 16, 4, 8
#: Pairs that one copy of a set serves at most.
HOT = 200
REMEMBERED = 200_000
#: Documents that shingles' frequencies are estimated from, the frequent shingles that tasks know, and the tasks that count them.
SAMPLE, FREQUENT, SHARES = 20_000, 200_000, 16
#: Bits of a set's parities, at least and at most; larger sets have more, about two for each shingle.
BITS = (1024, 1 << 16)
#: Nodes of a component that a list tests in each round of the exact join; None for all.
WIDTHS = (2, 16, None)

_rng = np.random.default_rng(20)
WEIGHTS = _rng.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
ORDERS = (_rng.integers(0, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
PLACES = np.stack([_rng.choice(MINIMA, DEPTH, replace=False) for _ in range(TREES)])

_words: dict[bytes, int] = {}


def forget() -> None:
    """A function of the module, as a table of the module that a task's function names is copied to the worker with it."""
    _words.clear()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if n < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)] if n else [], np.uint64)
    if len(_words) > REMEMBERED:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    s = sum(h[k : n - SHINGLE + 1 + k] * WEIGHTS[k] for k in range(SHINGLE))
    s ^= s >> np.uint64(31)
    s *= np.uint64(0x7FB5D329728EA185)
    s ^= s >> np.uint64(27)
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        np.minimum(out, (s[at : at + 4096] * ORDERS).min(1), out=out)
    return (out >> np.uint64(32)).astype(">u4")


def frequent(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several different sets of a sample share, sorted, and in how many: FREQUENT at most. Shingles travel packed, by their last bits."""
    source = pick(df, id=key, text=text).withColumn("id", F.col("id").cast("long"))
    every = max(1, source.count() // SAMPLE)
    sample = source.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turns("forest", forget)
        for b in batches:
            rows: list[tuple[int, int, bytes]] = []
            for x in b.column(1):
                s = shingles(x.as_py())
                own = xxhash.xxh3_64_intdigest(s.tobytes()) >> 1
                rows += [(k, own, part.tobytes()) for k in range(SHARES) if len(part := s[s % np.uint64(SHARES) == k])]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["share", "own", "packed"])
        forget()
        give_back()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, own, parts = None, set(), []

        def out() -> pa.RecordBatch:
            g, n = np.unique(np.frombuffer(b"".join(parts), np.uint64), return_counts=True)
            return pa.record_batch([pa.array(g[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["g", "count"])

        for b in batches:
            for k, x, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != share:
                    yield out()
                    share, own, parts = k, set(), []
                if x not in own:
                    own.add(x)
                    parts.append(packed)
        yield out()
        give_back()

    found = sample.mapInArrow(dealt, "share int, own long, packed binary").repartition(SHARES, "share").sortWithinPartitions("share").mapInArrow(counted, "g long, count long")
    rows = Scratch(df.sparkSession, "frequent").save(found, "counts").orderBy(F.desc("count"), "g").limit(FREQUENT).toPandas()
    keys = rows["g"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows["count"].to_numpy(np.int64)[order]


def listed(s: np.ndarray, known: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """So many of a set's shingles, rarest first, that a similar set must share one of its own."""
    keys, counts = known
    if len(keys):
        at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
        s = s[np.argsort(np.where(keys[at] == s, counts[at], 0), kind="stable")]
    return s[: len(s) + percent * -len(s) // 100 + 1]


def parities(s: np.ndarray) -> bytes:
    """Two sets' parities differ in no more bits than the sets in shingles."""
    bits = min(max(BITS[0], 1 << int(2 * len(s)).bit_length()), BITS[1])
    return np.packbits((np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def differing(x: bytes, y: bytes) -> int:
    """In how many bits two parities differ; longer ones are folded first."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def fingerprints(df: DataFrame, percent: int, known: tuple[np.ndarray, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, set_key (null without shingles), signature, listed shingles, parities, for each row."""
    source = pick(df, doc_id=key, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turns("forest", forget)
        for b in batches:
            n, keys, signs, lists, bits = [], [], [], [], []
            for x in b.column(1):
                s = shingles(x.as_py())
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signs.append(signature(s).tobytes() if len(s) else None)
                lists.append(listed(s, known, percent).view(np.int64) if len(s) else None)
                bits.append(parities(s) if len(s) else None)
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary()), pa.array(lists, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["doc_id", "n", "set_key", "signature", "listed", "bits"])
        forget()
        give_back()

    return source.mapInArrow(work, "doc_id long, n long, set_key binary, signature binary, listed array<long>, bits binary")


def tree_rows(nodes: DataFrame) -> DataFrame:
    """A row for each node and tree: place in the tree's order (tree, then eight values), id, n."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            signs = np.frombuffer(b"".join(b.column(2).to_pylist()), ">u4").reshape(-1, MINIMA)
            for t in range(TREES):
                rows = np.concatenate([np.full((len(signs), 1), t, np.uint8), np.ascontiguousarray(signs[:, PLACES[t]]).view(np.uint8).reshape(len(signs), -1)], 1)
                size = rows.shape[1]
                place = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, size * len(rows) + 1, size, np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])
                yield pa.record_batch([place, b.column(0), b.column(1)], ["place", "id", "n"])

    return nodes.select("id", "n", "signature").mapInArrow(work, "place binary, id long, n long")


PLACE = 1 + 4 * DEPTH
PAIR = "a long, b long, na long, nb long, depth int, part int, place binary"


def common_prefix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many values the places (rows of bytes) share before the first that differs; 0 in different trees."""
    same = (x[:, 1:] == y[:, 1:]).reshape(len(x), DEPTH, 4).all(2) & (x[:, :1] == y[:, :1])
    return np.minimum.accumulate(same, axis=1).sum(1)


def close_sizes(x, y, percent: int):
    return 100 * np.minimum(x, y) >= percent * np.maximum(x, y)


def neighbours(rows: DataFrame, percent: int) -> DataFrame:
    """Neighbours in each tree's order that share FIRST values or more, and how many; and of each partition its first and last row (place not null; b null for the last)."""
    ordered = rows.repartitionByRange("place", "id").sortWithinPartitions("place", "id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None

        def edge(row, first: bool) -> pa.RecordBatch:
            return pa.record_batch([pa.array([row[1]], pa.int64()), pa.array([row[1] if first else None], pa.int64()), pa.array([row[2]], pa.int64()), pa.array([row[2]], pa.int64()), pa.array([0], pa.int32()), pa.array([part], pa.int32()), pa.array([row[0]], pa.binary())], ["a", "b", "na", "nb", "depth", "part", "place"])

        for b in batches:
            if not b.num_rows:
                continue
            places = b.column(0).to_pylist()
            ids, n = b.column(1).to_numpy(), b.column(2).to_numpy()
            if last is None:
                yield edge((places[0], int(ids[0]), int(n[0])), True)
            else:
                places, ids, n = [last[0], *places], np.append(last[1], ids), np.append(last[2], n)
            last = (places[-1], int(ids[-1]), int(n[-1]))
            rows = np.frombuffer(b"".join(places), np.uint8).reshape(-1, PLACE)
            depth = common_prefix(rows[1:], rows[:-1])
            at = np.flatnonzero((depth >= FIRST) & (ids[1:] != ids[:-1]) & close_sizes(n[1:], n[:-1], percent))
            if len(at):
                swap = ids[at] > ids[at + 1]
                low, high = np.where(swap, at + 1, at), np.where(swap, at, at + 1)
                yield pa.record_batch([pa.array(ids[low]), pa.array(ids[high]), pa.array(n[low]), pa.array(n[high]), pa.array(depth[at].astype(np.int32)), pa.array(np.full(len(at), part, np.int32)), pa.nulls(len(at), pa.binary())], ["a", "b", "na", "nb", "depth", "part", "place"])
        if last is not None:
            yield edge(last, False)
        give_back()

    return ordered.mapInArrow(work, PAIR)


def across(edges: list, percent: int) -> list[tuple]:
    """Pairs between the last row of a partition and the first of the next."""
    found, last = [], None
    for e in sorted(edges, key=lambda e: (e.part, e.b is None)):
        if e.b is not None and last is not None and last.a != e.a and close_sizes(last.na, e.na, percent):
            depth = int(common_prefix(*(np.frombuffer(p, np.uint8).reshape(1, -1) for p in (last.place, e.place)))[0])
            if depth >= FIRST:
                x, y = sorted([(last.a, last.na), (e.a, e.na)])
                found.append((x[0], y[0], x[1], y[1], depth))
        if e.b is None:
            last = e
    return found


def shingle_sets(df: DataFrame, wanted: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, shingles of the wanted ids only."""
    source = pick(df, id=key, text=text).withColumn("id", F.col("id").cast("long")).join(wanted, "id", "left_semi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turns("forest", forget)
        for b in batches:
            sets = [shingles(x.as_py()).view(np.int64) for x in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])
        # what follows in the JVM needs the room
        forget()
        give_back()

    return source.mapInArrow(work, "id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. The set of the less frequent node joins first and travels; the other's is laid out for every salt."""
    scratch = Scratch(pairs.sparkSession, "confirm")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("pairs")).where(F.col("pairs") > HOT)
    often = scratch.save(ends.select("id", F.ceil(F.col("pairs") / HOT).cast("int").alias("salts")), "often")
    named = pairs.select("a", "b")
    for side in "ab":
        named = named.join(often.toDF(side, f"salts_{side}"), side, "left").withColumn(f"salts_{side}", F.coalesce(f"salts_{side}", F.lit(1)))
    swap = F.col("salts_a") > F.col("salts_b")
    named = named.select("a", "b", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("few"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("many"), F.pmod(F.xxhash64("a", "b"), F.greatest("salts_a", "salts_b")).cast("int").alias("salt"))
    # pairs are few beside sets: once written, Spark knows their size, and sets that no pair names stay where they are
    named = scratch.save(named, "named")
    first = named.join(sets.select(F.col("id").alias("few"), F.col("shingles").alias("x")), "few")
    other = sets.join(named.select(F.col("many").alias("id")).distinct(), "id", "left_semi").join(often, "id", "left")
    laid = other.select(F.col("id").alias("many"), F.col("shingles").alias("y"), F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    both = first.join(laid, ["many", "salt"])
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", (100 * shared >= percent * (F.size("x") + F.size("y") - shared)).alias("linked")).where("linked").select("a", "b").distinct()


def deepest_first(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that share as long a prefix as one of the two shares with any node."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"), "depth").groupBy("id").agg(F.max("depth").alias("deepest"))
    at = pairs.join(ends.toDF("a", "deepest_a"), "a").join(ends.toDF("b", "deepest_b"), "b")
    return at.where((F.col("depth") == F.col("deepest_a")) | (F.col("depth") == F.col("deepest_b"))).select("a", "b")


def shared_lists(nodes: DataFrame) -> DataFrame:
    """g, id, n, pos: each node's listed shingles with their places, where another node lists the same."""
    rows = nodes.select("id", "n", F.posexplode("listed").alias("pos", "g")).select("g", "id", "n", "pos")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, same = None, False
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b] if last is None else [last, b]).combine_chunks()
            g = t.column(0).to_numpy()
            equal = g[1:] == g[:-1]
            before = np.append(same, equal)
            yield from t.slice(0, len(g) - 1).filter(pa.array(before[:-1] | equal)).to_batches()
            last, same = t.slice(len(g) - 1).to_batches()[0], bool(before[-1])
        if same:
            yield last
        give_back()

    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(work, "g long, id long, n long, pos int")


def apart_pairs(lists: DataFrame, labels: DataFrame, links: DataFrame, width: int | None, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a listed shingle early enough to be similar."""
    at = lists.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id"))
    mixed = at.groupBy("g").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("g")
    at = at.join(mixed, "g", "left_semi")
    if width:
        ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("links"))
        first = Window.partitionBy("g", "c").orderBy(F.desc(F.coalesce("links", F.lit(0))), "id")
        at = at.join(ends, "id", "left").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= width)
    x, y = (at.select("g", *[F.col(n).alias(n + side) for n in ("c", "id", "n", "pos")]) for side in "xy")
    left = F.least(F.col("nx") - F.col("posx"), F.col("ny") - F.col("posy"))
    close = (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")) & ((100 + percent) * left >= percent * (F.col("nx") + F.col("ny")))
    return x.join(y, "g").where((F.col("cx") < F.col("cy")) & close).select(F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b")).distinct()


def possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose parities don't rule them out. pairs: a written table; parities of the nodes that it names move, no others."""
    scratch = Scratch(pairs.sparkSession, "possible")
    ids = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    bits = scratch.save(nodes.select("id", "n", "bits").join(ids, "id", "left_semi"), "bits")
    both = pairs.select("a", "b").join(bits.toDF("a", "na", "x"), "a").join(bits.toDF("b", "nb", "y"), "b").select("a", "b", "na", "nb", "x", "y")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            apart = np.array([differing(x.as_py(), y.as_py()) for x, y in zip(b.column(4), b.column(5), strict=True)], np.int64)
            both = b.column(2).to_numpy() + b.column(3).to_numpy()
            yield b.select(["a", "b"]).filter(pa.array((100 + percent) * apart <= (100 - percent) * both, pa.bool_()))
        give_back()

    return both.mapInArrow(work, "a long, b long").distinct()


def groups(df: DataFrame, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row."""
    spark = df.sparkSession
    scratch = Scratch(spark, "forest")
    prints = scratch.save(fingerprints(df, percent, frequent(df, key, text), key, text), "prints")
    light = prints.select("doc_id", "n", "set_key")
    firsts = scratch.save(light.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep")), "firsts")
    members = light.join(firsts, "set_key", "left").select("doc_id", "n", "set_key", F.coalesce("rep", F.when(F.col("n") == 0, F.col("doc_id"))).alias("rep"))
    members = scratch.save(members, "members")
    # what stands for a set keeps its signature and lists, and these move only if the rest is too much to know everywhere
    copies = scratch.save(members.where("doc_id is null or doc_id <> rep").select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("lost"), "set_key").distinct(), "copies")
    nodes = prints.where("set_key is not null").withColumn("lost", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    nodes = nodes.join(copies, ["doc_id", "lost", "set_key"], "left_anti").select(F.col("doc_id").alias("id"), "n", "signature", "listed", "bits")
    again = scratch.save(members.where("doc_id = rep and n > 0").groupBy(F.col("doc_id").alias("id"), "n").count().where("count > 1").select("id", "n"), "again")
    if not again.isEmpty():
        nodes = nodes.join(again, ["id", "n"], "left_anti").unionByName(nodes.join(again, ["id", "n"], "left_semi").dropDuplicates(["id", "n"]))
    nodes = scratch.save(nodes, "nodes")
    members = members.drop("set_key")
    scratch.drop("prints", "firsts", "copies")
    found = scratch.save(neighbours(tree_rows(nodes), percent), "found")
    edges = found.where("place is not null").collect()
    pairs = found.where("place is null").select("a", "b", "na", "nb", "depth")
    if more := across(edges, percent):
        pairs = pairs.unionByName(spark.createDataFrame(more, "a long, b long, na long, nb long, depth int"))
    pairs = scratch.save(pairs.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.max("depth").alias("depth")), "pairs")
    wanted = scratch.save(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "wanted")
    sets = scratch.save(shingle_sets(df, wanted, key, text), "sets")
    scratch.drop("found")
    tested = scratch.save(deepest_first(pairs), "tested0")
    links = scratch.save(confirmed(scratch.save(possible(tested, nodes, percent), "possible0"), sets, percent), "links0")
    labels = components(links)
    k = 0
    while True:
        k += 1
        labels = scratch.save(labels, f"labels{k}")
        ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
        hubs = ends.join(labels, "node").groupBy("component").agg(F.max_by("node", F.struct("links", -F.col("node"))).alias("hub"))
        sizes = nodes.select(F.col("id").alias("hub"), F.col("n").alias("hub_n")).dropDuplicates(["hub"])
        hubs = scratch.save(hubs.join(sizes, "hub"), f"hubs{k}")
        at = scratch.save(labels.join(hubs, "component").select("node", "component", "hub", "hub_n"), f"at{k}")

        def placed(p: DataFrame, side: str, at: DataFrame = at) -> DataFrame:
            return p.join(at.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"), F.col("hub").alias(f"h{side}"), F.col("hub_n").alias(f"hn{side}")), side, "left")

        apart = placed(placed(pairs, "a"), "b").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        a, b = F.struct(F.col("a").alias("id"), F.col("na").alias("n")), F.struct(F.col("b").alias("id"), F.col("nb").alias("n"))
        ha = F.struct(F.coalesce("ha", "a").alias("id"), F.coalesce("hna", "na").alias("n"))
        hb = F.struct(F.coalesce("hb", "b").alias("id"), F.coalesce("hnb", "nb").alias("n"))
        tries = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((a, b), (a, hb), (ha, b), (ha, hb))])
        new = apart.select(F.explode(F.array_distinct(tries)).alias("t")).select(F.least("t.x.id", "t.y.id").alias("a"), F.greatest("t.x.id", "t.y.id").alias("b"), F.least("t.x.n", "t.y.n").alias("less"), F.greatest("t.x.n", "t.y.n").alias("more"))
        new = new.where((F.col("a") != F.col("b")) & (100 * F.col("less") >= percent * F.col("more"))).select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
        new = scratch.save(new, f"new{k}")
        if new.isEmpty():
            break
        more = scratch.save(confirmed(scratch.save(possible(new, nodes, percent), f"possible{k}"), sets, percent), f"more{k}")
        if more.isEmpty():
            break
        tested = scratch.save(tested.unionByName(new), f"tested{k}")
        links = scratch.save(links.unionByName(more), f"links{k}")
        labels = components(links)
    scratch.drop("sets")
    lists = scratch.save(shared_lists(nodes), "lists")
    for k, width in enumerate(WIDTHS):
        new = apart_pairs(lists, labels, links, width, percent).join(tested, ["a", "b"], "left_anti")
        new = scratch.save(new, f"listed{k}")
        if new.isEmpty():
            continue
        tested = scratch.save(tested.unionByName(new), f"all_tested{k}")
        close = scratch.save(possible(new, nodes, percent), f"close{k}")
        if close.isEmpty():
            continue
        ids = scratch.save(close.select(F.col("a").alias("id")).unionByName(close.select(F.col("b").alias("id"))).distinct(), f"ids{k}")
        more = scratch.save(confirmed(close, scratch.save(shingle_sets(df, ids, key, text), f"sets{k}"), percent), f"exact{k}")
        links = scratch.save(links.unionByName(more), f"all_links{k}")
        labels = scratch.save(components(links), f"all_labels{k}")
    scratch.drop("lists", "nodes", "pairs", "wanted")
    out = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def keep_one(df: DataFrame, percent: int = 80) -> DataFrame:
    """df with one row of each group, all columns as they were; rows without doc_id stay only where nothing stands for them."""
    found = groups(df, percent)
    scratch = Scratch(df.sparkSession, "keep")
    gone = scratch.save(found.where("not kept and doc_id is not null").select("doc_id").distinct(), "gone")
    again = scratch.save(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    left = df.join(gone, "doc_id", "left_anti")
    if again.isEmpty():
        return left
    repeated = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.join(again, "doc_id", "left_anti").unionByName(repeated.select(left.columns))
