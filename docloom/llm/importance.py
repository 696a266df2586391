"""Documents drawn by importance: how much more likely their word pairs are in a target's texts than in all documents.

Words are runs of letters and digits (ASCII, lower-cased) and of all other than ASCII characters. A task keeps a dictionary that
gives each distinct word an integer; an n-gram of one or two words is then a pair of integers packed into one
number. Of a portion of texts, the distinct pairs are sorted out, each one's bytes are put together again from
the dictionary and hashed once, and the buckets go back to all places where the pairs stand, to be counted
for each document. The counts by document and bucket are written; so texts are read and hashed once. Sums by bucket
(partial aggregation, one row for each bucket in the end) give each bucket's gain, and a second step over
the written counts gives each document's mean gain. Neither texts nor words are shuffled.

The dictionary and the portion are bounded, so that a pair is hashed once for each portion that has it, not once in
the whole corpus: moving pairs to one place costs a shuffle several times the input, hashing one 0.2 microseconds.

The draw adds Gumbel noise, from a hash of the id, to the weights and takes the highest: sampling without
replacement in proportion to exp(weight). Documents with a score are sorted by range, and a task's ranks start after the counts of the
tasks before it, so no task ever sees all of them.

Defined results: a null text has no words, no features and the weight 0; a row without id is hashed as an empty id and comes
after others with its score; repeated rows are documents each, ranked next to each other; an empty target leaves gains by the
documents alone; an empty table gives an empty one. Words and texts may be of any length. Other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.columns import pick
from docloom.llm.storage import Scratch

BUCKETS = 10_000
#: Lower-cases A-Z and makes a blank of every ASCII character that is no letter or digit.
SIGNS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Bytes of a text that are split into words at a time; words of a portion; words and bytes of a dictionary.
PIECE, PORTION, HELD, HELD_BYTES = 1 << 20, 1 << 20, 300_000, 16 << 20
COUNTS = "doc_id long, n_words long, n_features long, buckets array<int>, counts array<int>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])


def pieces(text: str) -> Iterator[list[bytes]]:
    """The words of a text, a piece of it at a time."""
    signs = text.encode("utf-8", "surrogatepass").translate(SIGNS)
    at = 0
    while at < len(signs):
        end = signs.find(b" ", at + PIECE) if at + PIECE < len(signs) else -1
        end = len(signs) if end < 0 else end
        # runs of blanks, of which each sign of its own is one here
        yield signs[at:end].split()
        at = end


class Dictionary:
    """Integers for distinct words, and buckets for the n-grams of a portion of documents."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.bytes = 0

    def numbered(self, words: list[bytes]) -> np.ndarray:
        ids = self.ids
        for w in set(words).difference(ids):
            ids[w] = len(self.words)
            self.words.append(w)
            self.bytes += len(w)
        return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))

    def full(self) -> bool:
        return len(self.words) > HELD or self.bytes > HELD_BYTES

    def hashed(self, tuples: np.ndarray) -> np.ndarray:
        """The bucket of each tuple: its first word, and its second one plus 1 or 0 for none."""
        words, crc = self.words, zlib.crc32
        first, second = (tuples >> 32).tolist(), (tuples & 0xFFFFFFFF).tolist()
        return np.fromiter((crc(words[a] + b" " + words[b - 1] if b else words[a]) for a, b in zip(first, second, strict=True)), np.int64, len(tuples)) % BUCKETS

    def counted(self, runs: list[tuple[int, np.ndarray, bool]]) -> tuple[np.ndarray, np.ndarray]:
        """Keys (document * BUCKETS + bucket) and counts, from runs of word ids: document, ids, whether the first id was counted with the run before."""
        ids = np.concatenate([r[1] for r in runs])
        sizes = np.array([len(r[1]) for r in runs])
        docs, starts = np.repeat([r[0] for r in runs], sizes), np.cumsum(sizes) - sizes
        alone, paired = np.ones(len(ids), bool), np.ones(len(ids), bool)
        alone[starts[[r[2] for r in runs]]] = False
        paired[starts + sizes - 1] = False
        follows = np.append(ids[1:], 0) + 1
        tuples = np.concatenate([ids[alone] << 32, ids[paired] << 32 | follows[paired]])
        distinct, back = np.unique(tuples, return_inverse=True)
        return np.unique(np.concatenate([docs[alone], docs[paired]]) * BUCKETS + self.hashed(distinct)[back], return_counts=True)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to their counts by bucket."""
    words = Dictionary()
    for b in batches:
        n_words, parts, runs, held = np.zeros(len(b), np.int64), [], [], 0
        for d, text in enumerate(b.column("text")):
            last = None
            for found in pieces(text.as_py() or ""):
                if not found:
                    continue
                if held > PORTION:
                    parts.append(words.counted(runs))
                    runs, held = [], 0
                if words.full() and not runs:
                    before = words.words[last] if last is not None else None
                    words = Dictionary()
                    last = None if before is None else int(words.numbered([before])[0])
                ids = words.numbered(found)
                n_words[d] += len(ids)
                runs.append((d, ids if last is None else np.append(last, ids), last is not None))
                last, held = int(ids[-1]), held + len(ids)
        if runs:
            parts.append(words.counted(runs))
        keys, counts = _summed(parts) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        offsets = pa.array(np.searchsorted(keys, np.arange(len(b) + 1) * BUCKETS).astype(np.int32))
        listed = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (keys % BUCKETS, counts)]
        yield pa.record_batch([b.column("doc_id"), pa.array(n_words), pa.array(np.maximum(2 * n_words - 1, 0)), *listed], schema=_ARROW)


def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts by bucket."""
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        at, n = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("buckets", "counts"))
        # weights are doubles: exact, as a batch holds far fewer than 2 ** 53 features
        total += np.bincount(at, n, BUCKETS).astype(np.int64)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])


def weighed(gains: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.array(gains, np.int64)
        for b in batches:
            lists = b.column("buckets")
            at, n = (b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("buckets", "counts"))
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            upto = np.append(0, np.cumsum(gain[at] * n))
            total = upto[ends] - upto[np.append(0, ends[:-1])] if len(b) else np.zeros(0, np.int64)
            features = b.column("n_features").to_numpy()
            yield pa.record_batch([b.column("doc_id"), b.column("n_words"), b.column("n_features"), pa.array(total // np.maximum(features, 1))], ["doc_id", "n_words", "n_features", "weight"])

    return run


def bucket_counts(table: DataFrame, text: str, key: str | None, scratch: Scratch, name: str) -> DataFrame:
    picked = pick(table, text=text).withColumn("doc_id", F.lit(None).cast("long")) if key is None else pick(table, text=text, doc_id=key)
    rows = picked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scratch.save(rows.mapInArrow(counted, COUNTS), name)


def gains(source: DataFrame, target: DataFrame) -> list[int]:
    """floor(1000 * ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))) of each bucket, from counts by document. BUCKETS rows reach the driver, at any size of the tables."""
    sums = [{r.bucket: int(r.n) for r in counts.mapInArrow(histogram, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()} for counts in (source, target)]
    s, t = (np.array([x.get(k, 0) for k in range(BUCKETS)], np.float64) for x in sums)
    S, T = (float(sum(x.values())) for x in sums)
    return np.floor(1000 * np.log((t + 1) * (S + BUCKETS) / ((s + 1) * (T + BUCKETS)))).astype(np.int64).tolist()


def ranked(scored: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Rows in drawing order get rank 1, 2, 3 ... up to percent of all, then null."""
    sort = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    parts = max(1, int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # the id numbers a sorted task's rows: task * 2 ** 33 + place
    order = scored.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).withColumn("place", F.monotonically_increasing_id())
    order = scratch.save(order, "order")
    sizes = sorted((r.task, r.n) for r in order.groupBy(F.shiftright("place", 33).alias("task")).agg(F.count("*").alias("n")).collect())
    before, start = 0, []
    for task, n in sizes:
        start.append((task, before))
        before += n
    draw = percent * before // 100
    # one row for each partition
    starts = F.broadcast(scored.sparkSession.createDataFrame(start, "task long, before long"))
    place = F.col("before") + F.col("place").bitwiseAND(F.lit(2**33 - 1)) + 1
    return order.join(starts, F.shiftright("place", 33) == F.col("task")).withColumn("rank", F.when(place <= draw, place))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least: int = 20, seed: int = 7, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_features, weight, score, rank of each document; percent of those with at least that many words are drawn."""
    scratch = Scratch(docs.sparkSession, "importance")
    own = bucket_counts(docs, text, key, scratch, "documents")
    aim = bucket_counts(target, text, None, scratch, "target")
    weights = own.mapInArrow(weighed(gains(own, aim)), "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = scratch.save(weights.withColumn("score", F.col("weight") + noise), "scores")
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    short = scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    return ranked(scored.where(F.col("n_words") >= least), scratch, percent).select(columns).unionByName(short.select(columns))


def drawn(docs: DataFrame, target: DataFrame, percent: int = 25, least: int = 20, seed: int = 7, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents that are drawn, all columns; ids are to be distinct. Ids go to the texts, not texts to the ids, where they are few."""
    ids = resample(docs, target, percent, least, seed, text, key).where("rank IS NOT NULL").select(F.col("doc_id").alias("__importance_id"))
    return docs.join(ids, F.col(f"`{key}`").eqNullSafe(F.col("__importance_id")), "left_semi")
