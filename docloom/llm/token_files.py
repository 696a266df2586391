"""Token ids in files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents, one after another, in blocks of 4,096 ids. Of a block the
minimum is subtracted; what remains is packed at the width that a percentile of it needs, one bit plane
after another; values that need more bits are exceptions, stored with their places behind the planes. The
footer has the start of every block and the id, length and order of every document, so that a reader can
begin anywhere.

    file   = magic, blocks, footer, length of footer (8 bytes)
    block  = minimum u32, width u8, exceptions u32, planes, places u16 each, values u32 each
    footer = docs u64, ids u64, blocks u64, starts u64 each, doc ids i64 each, no id u8 each, lengths u64 each

Documents go to files by ranges of doc_id (null first, equal ids by a hash of their texts, so that they too are
spread), so that files in order are the corpus in order. A file is written under a name of its own for each attempt of a task; only names of
successful attempts are read. Files are reached by pyarrow's file systems, in the folder shared by all
executors. Texts are encoded in stretches that begin before a space or line feed with no white space on
either side, where the pre-tokenizer always splits; each worker keeps the ids of stretches, within a bound.
A new stretch that ends in signs is put together from its word and its signs.

Defined results: a null text counts as empty; an empty document has the end id alone. Repeated rows, and rows
without doc_id, are documents each. Texts of any length are encoded whole; an empty table gives no file and no row;
columns other than the two named play no part, whatever their names.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.columns import pick
from docloom.llm.storage import Scratch
from docloom.llm.token_counts import in_portions

MAGIC = b"DLTOKEN1"
BLOCK = 4096
#: Share of a block's values that its width must hold.
PERCENTILE = 95
#: Stretches of text of one generation that a worker remembers, about; it keeps two.
REMEMBERED = 1_300_000
PACKED = [struct.Struct(f"<{n}I").pack for n in range(40)]
HEAD = struct.Struct("<IBI")
#: Begins what is known as it stands; texts with it are split by BORDER.
MARK = "\x01"
#: White space other than the space and the line feed.
OTHER_BLANKS = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x01]")
#: A letter, then signs to the end of a stretch: the pre-tokenizer always splits there.
TAIL = re.compile(r"(.*[^\W\d_])([!-/:-@\[-^`{-~]+)", re.S)
BORDER = re.compile(r"(?<!\s)(?=[ \n]\S)")


def pack(values: np.ndarray) -> bytes:
    """One block; values: u32, at least one, at most 65,536."""
    low = int(values.min())
    rest = values - np.uint32(low)
    width = int(np.percentile(rest, PERCENTILE, method="higher")).bit_length()
    places = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, int)
    found = rest[places]
    if len(places):
        rest = rest.copy()
        rest[places] = 0
    planes = [np.packbits(((rest >> np.uint32(b)) & np.uint32(1)).astype(np.uint8)).tobytes() for b in range(width)]
    return b"".join([HEAD.pack(low, width, len(places)), *planes, places.astype("<u2").tobytes(), found.astype("<u4").tobytes()])


def unpack(block: bytes, n: int) -> np.ndarray:
    low, width, exceptions = HEAD.unpack_from(block)
    each, at = (n + 7) // 8, HEAD.size
    values = np.zeros(n, np.uint32)
    for b in range(width):
        values |= np.unpackbits(np.frombuffer(block, np.uint8, each, at), count=n).astype(np.uint32) << np.uint32(b)
        at += each
    if exceptions:
        places = np.frombuffer(block, "<u2", exceptions, at)
        values[places] = np.frombuffer(block, "<u4", exceptions, at + 2 * exceptions)
    return values + np.uint32(low)


class TokenFileWriter:
    """Writes documents one after another to a binary sink; memory: one block and the documents' index."""

    def __init__(self, sink):
        self.sink, self.at = sink, len(MAGIC)
        sink.write(MAGIC)
        self.starts: list[int] = []
        self.docs: list[tuple[int | None, int]] = []
        self.waiting: list[bytes] = []
        self.held = self.ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: little-endian u32 each."""
        self.docs.append((doc_id, len(ids) // 4))
        self.ids += len(ids) // 4
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 64 * BLOCK:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        raw = b"".join(self.waiting)
        whole = len(raw) if all_of_it else len(raw) // (4 * BLOCK) * 4 * BLOCK
        values = np.frombuffer(raw, "<u4", whole // 4)
        for k in range(0, len(values), BLOCK):
            block = pack(values[k : k + BLOCK])
            self.starts.append(self.at)
            self.sink.write(block)
            self.at += len(block)
        self.waiting, self.held = [raw[whole:]], len(raw) - whole

    def close(self) -> None:
        self._flush(True)
        names = [0 if d is None else d for d, _ in self.docs]
        footer = b"".join([struct.pack("<QQQ", len(self.docs), self.ids, len(self.starts)), np.array(self.starts, "<u8").tobytes(), np.array(names, "<i8").tobytes(), np.array([d is None for d, _ in self.docs], np.uint8).tobytes(), np.array([n for _, n in self.docs], "<u8").tobytes()])
        self.sink.write(footer + struct.pack("<Q", len(footer)))


class TokenFileReader:
    """Reads a file that can be sought in."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        size = source.tell()
        source.seek(size - 8)
        (length,) = struct.unpack("<Q", source.read(8))
        self.end = size - 8 - length
        source.seek(self.end)
        footer = source.read(length)
        n, self.n_ids, blocks = struct.unpack_from("<QQQ", footer)
        self.starts = np.frombuffer(footer, "<u8", blocks, 24)
        names = np.frombuffer(footer, "<i8", n, 24 + 8 * blocks)
        none = np.frombuffer(footer, np.uint8, n, 24 + 8 * blocks + 8 * n)
        self.doc_ids = [None if x else int(d) for d, x in zip(names, none, strict=True)]
        self.lengths = np.frombuffer(footer, "<u8", n, 24 + 8 * blocks + 9 * n).astype(np.int64)
        source.seek(0)
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")

    def block(self, k: int) -> np.ndarray:
        end = int(self.starts[k + 1]) if k + 1 < len(self.starts) else self.end
        self.source.seek(int(self.starts[k]))
        return unpack(self.source.read(end - int(self.starts[k])), min(BLOCK, self.n_ids - k * BLOCK))

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from the start-th of the file on; only their blocks are read."""
        if not n:
            return np.empty(0, np.uint32)
        first = start // BLOCK
        got = np.concatenate([self.block(k) for k in range(first, (start + n - 1) // BLOCK + 1)])
        return got[start - first * BLOCK :][:n]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in this file, ids), in order, each block read once."""
        held, first, k, start = np.empty(0, np.uint32), 0, 0, 0
        for doc_id, n in zip(self.doc_ids, self.lengths.tolist(), strict=True):
            parts, have = [held[start - first :]], first + len(held) - start
            while have < n:
                parts.append(self.block(k))
                have += len(parts[-1])
                k += 1
            if len(parts) > 1:
                held, first = np.concatenate(parts), start
            yield doc_id, start, held[start - first :][:n]
            start += n


class StretchEncoder:
    """ids, as little-endian u32, of whole texts as the tokenizers library gives them for a byte-level model."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(tokenizer_file)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def key(stretch: str) -> str:
        """What a stretch is known by: without the blank that most begin with; with a mark if another one could be taken for it."""
        if stretch[:1] == " " and stretch[1:2] not in ("\n", MARK):
            return stretch[1:]
        return stretch if stretch[:1] == "\n" else MARK + stretch

    @staticmethod
    def stretch(key: str) -> str:
        return key[1:] if key[:1] == MARK else key if key[:1] == "\n" else " " + key

    def keys(self, text: str) -> list[str]:
        """The keys of a text's stretches, in order."""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or OTHER_BLANKS.search(text):
            return list(map(self.key, BORDER.split(text)))
        found = text.replace("\n", " \n").split(" ")
        found[0] = self.key(found[0])
        return found

    def learn(self, rest: list[str]) -> None:
        for at in range(0, len(rest), 10_000):
            part = rest[at : at + 10_000]
            for x, e in zip(part, self.lib.encode_batch_fast(list(map(self.stretch, part)), add_special_tokens=False), strict=True):
                ids = e.ids
                self.known[x] = PACKED[len(ids)](*ids) if len(ids) < len(PACKED) else struct.pack(f"<{len(ids)}I", *ids)

    def recall(self, new: set[str]) -> set[str]:
        """What is not known of new keys; those of the older generation are taken over, so that frequent ones stay when it goes."""
        found = self.older.keys() & new
        self.known.update((x, self.older[x]) for x in found)
        return new - found

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        waiting, new = [], set()
        look = self.known.get
        for text in texts:
            parts = self.keys(text)
            found = list(map(look, parts))
            try:
                out.append(b"".join(found))
            except TypeError:
                gaps = [k for k, x in enumerate(found) if x is None]
                new.update([parts[k] for k in gaps])
                waiting.append((len(out), parts, found, gaps))
                out.append(b"")
        if len(self.known) + len(new) > REMEMBERED:
            self.older, self.known = self.known, {}
        new = self.recall(new)
        # signs at the end of a stretch are told apart from its word; what begins with a mark or a line is rare
        ended = {x: (m[1], MARK + m[2]) for x in new if not x[-1:].isalnum() and "|>" not in x and (m := TAIL.fullmatch(x))}
        known = self.known
        self.learn(list(self.recall({y for x in new for y in ended.get(x, (x,)) if y not in known})))
        for x, (word, signs) in ended.items():
            known[x] = known[word] + known[signs]
        for at, parts, found, gaps in waiting:
            for k in gaps:
                found[k] = known[parts[k]]
            out[at] = b"".join(found)
        return out


_encoders: dict[str, StretchEncoder] = {}


def encoder(tokenizer_file: str) -> StretchEncoder:
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = StretchEncoder(tokenizer_file)
    return _encoders[tokenizer_file]


def write_token_files(df: DataFrame, tokenizer_file: str, folder: str, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encodes df and writes it below folder. Lazy; returns a row for each file: part, file, n_docs, n_ids. To be run once: save it before reading it."""
    source = pick(df, doc_id=key, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    # equal ids, and rows without one, are spread by their texts
    source = source.withColumn("hash", F.xxhash64("text")).repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    end = struct.pack("<I", end_id)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, out = encoder(tokenizer_file), TaskContext.get().partitionId(), None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                at, base = fs.FileSystem.from_uri(folder)
                at.create_dir(base, recursive=True)
                name = f"part-{part:07d}-{uuid.uuid4().hex}.tok"
                sink = at.open_output_stream(f"{base}/{name}")
                out = TokenFileWriter(sink)
            for first, texts in in_portions(b, 1):
                for d, ids in zip(b.column(0)[first : first + len(texts)].to_pylist(), enc.encode(texts), strict=True):
                    out.add(d, ids + end)
        if out is not None:
            out.close()
            sink.close()
            yield pa.record_batch([pa.array([part], pa.int64()), pa.array([name]), pa.array([len(out.docs)], pa.int64()), pa.array([out.ids], pa.int64())], ["part", "file", "n_docs", "n_ids"])

    return source.mapInArrow(work, "part long, file string, n_docs long, n_ids long")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files of a written list."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    listed = files.select("part", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    n = max(1, files.count())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            for row in b.to_pylist():
                with at.open_input_file(f"{base}/{row['file']}") as f:
                    cols: tuple = ([], [], [], [])
                    for doc_id, start, ids in TokenFileReader(f).documents():
                        for c, v in zip(cols, (doc_id, row["base"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            c.append(v)
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.repartition(n).mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(df: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """Writes the files in the shared folder, then reads them back. The list of files is one row for each partition."""
    scratch = Scratch(df.sparkSession, "tokens")
    folder = scratch.path("files")
    files = scratch.save(write_token_files(df, tokenizer_file, folder, end_id), "list")
    return read_token_files(files, folder)
