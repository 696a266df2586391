"""A byte-level convolutional network for document quality, in numpy.

Filters of four bytes slide over the whole text. Their rectified answers are pooled by maximum over chunks
of 256 bytes that overlap by half and cover the text to its end; the mean over all chunks and the maximum
over all chunks go into one logistic unit. A filter is a table for each of its four places, so that a text
costs two look-ups of byte pairs a byte.

Fitting runs on the driver over a bounded sample: SAMPLE labelled rows at most, those with the lowest hash of their
id, and of these as many as fit into BYTES together, in that order. Texts of all lengths are among them, each learned whole; one that
is larger than BYTES alone can't be. Scoring runs where the texts are, over the whole of every text, without
a shuffle.

Defined results: a null text counts as empty; an empty text gets the score of no chunks at all. Without
usable labels every score is 0.5. A label that a doc_id has twice counts as the greater; of several texts with one
doc_id the least is learned. Repeated rows and rows without doc_id are scored each on their own (rows without are never
learned from); an empty table gives an empty one; columns other than those named play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.columns import give_back, pick, take_turns
from docloom.llm.storage import Scratch
from docloom.llm.token_counts import in_portions

WIDTH, FILTERS, CELL, CELLS, HOP = 4, 16, 64, 4, 2
#: Labelled rows for fitting, at most.
SAMPLE = 3000
#: Bytes of the texts for fitting together, at most.
BYTES = 64 << 20
#: Bytes whose answers are in memory at once.
BLOCK = 1 << 18


@dataclass
class ByteNet:
    tables: np.ndarray  # place, byte, filter
    bias: np.ndarray
    mean_w: np.ndarray
    max_w: np.ndarray
    offset: float

    def __post_init__(self):
        t = self.tables
        self.head = (t[0][:, None] + t[1][None] + self.bias).reshape(65536, FILTERS).astype(np.float32)
        self.tail = (t[2][:, None] + t[3][None]).reshape(65536, FILTERS).astype(np.float32)

    def __reduce__(self):
        return ByteNet, (self.tables, self.bias, self.mean_w, self.max_w, self.offset)

    def cells(self, data: np.ndarray) -> np.ndarray:
        """Greatest rectified answers of each 64 places; data: whole cells and three bytes more."""
        pairs = data[:-1].astype(np.int32) * 256 + data[1:]
        out = []
        for at in range(0, len(data) - 3, BLOCK):
            end = min(at + BLOCK, len(data) - 3)
            answers = np.take(self.head, pairs[at:end], axis=0)
            answers += np.take(self.tail, pairs[at + 2 : end + 2], axis=0)
            out.append(answers.reshape(-1, CELL, FILTERS).max(1))
        return np.maximum(np.concatenate(out), 0)

    def scores(self, texts: list[str]) -> list[float]:
        raws = [x.encode() for x in texts]
        counts = [-(-len(r) // CELL) for r in raws]
        got = []
        if any(counts):
            # a cell of zeros behind each text: no filter sees the next one
            data = np.frombuffer(b"".join(r.ljust((n + 1) * CELL, b"\0") for r, n in zip(raws, counts, strict=True) if n) + b"\0\0\0", np.uint8)
            tops = self.cells(data)
        at = 0
        for n in counts:
            if n:
                h = chunked(tops[at : at + n])
                logit = float(h.mean(0) @ self.mean_w + h.max(0) @ self.max_w + self.offset)
            else:
                logit = self.offset
            got.append(float(1 / (1 + np.exp(-np.clip(logit, -60, 60)))))
            at += n + 1 if n else 0
        return got


def chunked(cells: np.ndarray) -> np.ndarray:
    """Maxima over chunks of CELLS cells, HOP apart; the last chunk may be shorter."""
    n = len(cells)
    starts = range(0, max(1, n - CELLS + HOP), HOP)
    if n <= CELLS:
        return cells.max(0, keepdims=True)
    padded = np.concatenate([cells, np.zeros((CELLS, cells.shape[1]), cells.dtype)])
    first = np.arange(starts.start, starts.stop, HOP)
    return np.maximum.reduce([padded[first + k] for k in range(CELLS)])


def fit(texts: list[str], labels: list[int], epochs: int = 8, batch: int = 32, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> ByteNet:
    """Adam on the log loss; gradients pass through the places that won their chunk."""
    rng = np.random.default_rng(seed)
    params = {"t": rng.normal(0, 0.15, (WIDTH, 256, FILTERS)), "b": np.zeros(FILTERS), "u": rng.normal(0, 0.1, FILTERS), "v": rng.normal(0, 0.1, FILTERS), "c": np.zeros(1)}
    if not texts or len(set(labels)) < 2:
        return ByteNet(params["t"].astype(np.float32), params["b"], 0 * params["u"], 0 * params["v"], 0.0)
    share = float(np.mean(labels))
    params["c"][0] = np.log(share / (1 - share))
    docs = []
    for x in texts:
        raw = x.encode()
        docs.append(np.frombuffer(raw.ljust(-(-len(raw) // CELL) * CELL, b"\0") + b"\0\0\0", np.uint8))
    m1 = {k: np.zeros_like(p) for k, p in params.items()}
    m2 = {k: np.zeros_like(p) for k, p in params.items()}
    step = 0
    filters = np.arange(FILTERS)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            t32 = params["t"].astype(np.float32)
            grad = {k: np.zeros_like(p) for k, p in params.items()}
            for i in order[at : at + batch]:
                d, y = docs[i], labels[i]
                n = len(d) - 3
                if n <= 0:
                    grad["c"] += 1 / (1 + np.exp(-params["c"])) - y
                    continue
                answers = t32[0][d[:n]] + t32[1][d[1 : n + 1]] + t32[2][d[2 : n + 2]] + t32[3][d[3 : n + 3]]
                cells = answers.reshape(-1, CELL, FILTERS)
                where = cells.argmax(1)
                tops = np.take_along_axis(cells, where[:, None], 1)[:, 0] + params["b"]
                where = where + np.arange(len(where))[:, None] * CELL
                m = len(tops)
                first = np.arange(0, max(1, m - CELLS + HOP), HOP)
                reach = np.minimum(first[:, None] + np.arange(CELLS), m - 1)
                best = tops[reach].argmax(1)
                cell = np.take_along_axis(reach[:, :, None].repeat(FILTERS, 2), best[:, None], 1)[:, 0]
                h = np.maximum(tops[cell, filters], 0)
                top = h.argmax(0)
                mean, most = h.mean(0), h[top, filters]
                logit = mean @ params["u"] + most @ params["v"] + params["c"][0]
                g = 1 / (1 + np.exp(-np.clip(logit, -60, 60))) - y
                grad["u"] += g * mean
                grad["v"] += g * most
                grad["c"] += g
                back = np.tile(g * params["u"] / len(h), (len(h), 1))
                back[top, filters] += g * params["v"]
                back *= h > 0
                grad["b"] += back.sum(0)
                place = where[cell, filters]
                for j in range(WIDTH):
                    np.add.at(grad["t"][j], (d[place + j], np.broadcast_to(filters, place.shape)), back)
            step += 1
            for k, p in params.items():
                g = grad[k] / batch + (decay * p if k != "c" else 0)
                m1[k] += 0.1 * (g - m1[k])
                m2[k] += 0.01 * (g * g - m2[k])
                p -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return ByteNet(params["t"].astype(np.float32), params["b"], params["u"], params["v"], float(params["c"][0]))


def held_out(key: str = "doc_id"):
    """Rows whose labels are never learned."""
    return F.crc32(F.col(key).cast("string")) % 3 == 1


def train(df: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = SAMPLE, most_bytes: int = BYTES) -> ByteNet:
    """Fits on at most sample labelled rows outside the held-out third, and at most so many bytes of text."""
    known = pick(labels, doc_id=key, y=label).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64("doc_id")
    chosen = known.orderBy(order, "doc_id").limit(sample)
    # no more than sample rows, as Spark broadcasts them
    found = pick(df, doc_id=key, text=text).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    found = Scratch(df.sparkSession, "learned").save(found, "rows")
    sizes = found.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), order.alias("h")).collect()
    fits, total = [], 0
    for r in sorted(sizes, key=lambda r: (r.h, r.doc_id)):
        if total + r.n <= most_bytes:
            fits.append(r.doc_id)
            total += r.n
    rows = found.where(F.col("doc_id").isin(fits)).collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit([r.text or "" for r in rows], [int(r.y) for r in rows])


def score(df: DataFrame, net: ByteNet, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    source = pick(df, doc_id=key, text=text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turns("cnn", lambda: None)
        for b in batches:
            s = [x for _, texts in in_portions(b, 1, 1_000_000) for x in net.scores(texts)]
            yield pa.record_batch([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    got = source.mapInArrow(work, f"doc_id {source.dtypes[0][1]}, score double")
    return got.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(df: DataFrame, net: ByteNet, below: float = 0.5, text: str = "text") -> DataFrame:
    """df without the rows that score below; all columns as they were."""
    names = df.columns
    place = names.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turns("cnn", lambda: None)
        for b in batches:
            s = [x >= below for _, texts in in_portions(b, place, 1_000_000) for x in net.scores(texts)]
            yield b.filter(pa.array(s, pa.bool_()))
        give_back()

    return df.mapInArrow(work, df.schema)
