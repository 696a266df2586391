"""Quality rules from tokenizer fertility.

Two public vocabularies measure the words of each text: characters per token under a vocabulary of pieces with
byte fall-back and under one of bytes, the share of pieces that are byte fall-backs, and the entropy of the
text's pieces against that of as many different ones. For each language (for each script where the language is
null) bands are laid around the quartiles of all texts that pass the base rules, over the whole table; a text
outside a band is rejected. Base rules: enough words, and not mostly repeated three-word windows.

Each distinct word is split once by each vocabulary and gets a number; a portion of texts then is an array of
numbers, from which all measures come at once. Only the small per-row measures are written and reread; texts
are read once and never shuffled.

Defined results: a null text has no words and fails the base rules, as an empty one; a language with a single text
has a band around that text, which is kept if the base rules keep it. Equal measures get equal verdicts,
repeated rows and rows without doc_id are judged each on their own, an empty table gives an empty one, and
texts of any length are measured whole. Columns other than the three named play no part.
"""

from __future__ import annotations

import os
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.columns import give_back, pick, take_turns
from docloom.llm.storage import Scratch
from docloom.llm.token_counts import in_portions

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: For each measure, the quartile distances that a band reaches beyond the quartiles, and its least reach. Chosen on labelled rows outside the held-out third (195 texts of quality 0 that pass the base rules, 2,144 of quality 1): characters per token reject 95 for 12, those per byte token 79 for 10, entropy 6 for none, fall-backs none, as the junk there has none.
REACH = {"chars_per_token": 3.0, "chars_per_byte_token": 3.0, "byte_share": 3.0, "entropy": 1.5}
LEAST = {"chars_per_token": 0.1, "chars_per_byte_token": 0.1, "byte_share": 0.005, "entropy": 0.02}
REMEMBERED = 400_000
ENDS = np.zeros(0, np.int64)


class Words:
    """Numbers of words, and for each word: code points, hash, pieces (their ids, how many, how many fall-backs), byte tokens."""

    def __init__(self, piece_file: str, byte_file: str):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        n = self.pieces.get_piece_size()
        self.fallback = np.array([self.pieces.is_byte(i) for i in range(n)])
        self.width = n
        self.lib = Tokenizer.from_file(byte_file)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.size, self.room = 0, 1 << 12
        self.chars, self.tokens, self.fallen, self.byte_tokens = (np.zeros(self.room, np.int32) for _ in range(4))
        self.hash, self.start = np.zeros(self.room, np.uint64), np.zeros(self.room + 1, np.int64)
        self.flat = np.zeros(1 << 14, np.uint16)

    def _grow(self, most: int, flat: int) -> None:
        while self.room < most:
            self.room *= 2
        for name in ("chars", "tokens", "fallen", "byte_tokens", "hash"):
            x = getattr(self, name)
            if len(x) < self.room:
                setattr(self, name, np.concatenate([x, np.zeros(self.room - len(x), x.dtype)]))
        if len(self.start) <= self.room:
            self.start = np.concatenate([self.start, np.zeros(self.room + 1 - len(self.start), np.int64)])
        if len(self.flat) < flat:
            self.flat = np.concatenate([self.flat, np.zeros(max(flat, 2 * len(self.flat)) - len(self.flat), np.uint16)])

    def learn(self, new: list[bytes]) -> None:
        said = [x.decode() for x in new]
        ids = self.pieces.encode(said, num_threads=1)
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        own = np.fromiter((i for x in ids for i in x), np.uint16, int(count.sum()))
        a, z = self.size, self.size + len(new)
        at = int(self.start[a])
        self._grow(z, at + len(own))
        self.flat[at : at + len(own)] = own
        ends = at + np.cumsum(count)
        self.start[a + 1 : z + 1] = ends
        self.tokens[a:z] = count
        bad = np.concatenate([[0], np.cumsum(self.fallback[own])])
        self.fallen[a:z] = bad[ends - at] - bad[ends - at - count]
        self.chars[a:z] = np.fromiter(map(len, said), np.int64, len(said))
        self.hash[a:z] = np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))
        self.byte_tokens[a:z] = np.fromiter(map(len, self.lib.encode_batch_fast([" " + x for x in said], add_special_tokens=False)), np.int64, len(said))
        self.number.update(zip(new, range(a, z), strict=True))
        self.size = z

    def numbers(self, words: list[list[bytes]]) -> np.ndarray:
        """All words' numbers, one text behind the other."""
        known = self.number
        if len(known) > REMEMBERED:
            self.forget()
            known = self.number
        new: set[bytes] = set()
        for x in words:
            new.update(x)
        ordered = sorted(new.difference(known))
        for at in range(0, len(ordered), 20_000):
            self.learn(ordered[at : at + 20_000])
        n = sum(map(len, words))
        return np.fromiter((known[w] for x in words for w in x), np.int64, n)


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive parts that end there."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(total[np.concatenate([[0], ends])])


def repeated(doc: np.ndarray, word: np.ndarray, hashes: np.ndarray, docs: int) -> np.ndarray:
    """For each text, how many of its words lie in a three-word window that it holds twice or more. Windows that look alike by hash are compared word by word."""
    out = np.zeros(docs, np.int64)
    if len(word) < 4:
        return out
    first = np.flatnonzero(doc[2:] == doc[:-2])
    h = hashes[word]
    key = h[first] * np.uint64(0x9E3779B97F4A7C15) + (h[first + 1] ^ (h[first + 1] >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) + h[first + 2] * np.uint64(0x165667B19E3779F9) + doc[first].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    line = np.sort(key)
    twice = np.unique(line[1:][line[1:] == line[:-1]])
    if not len(twice):
        return out
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    first = first[twice[at] == key]
    rows = np.stack([doc[first], word[first], word[first + 1], word[first + 2]], 1)
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    same = (rows[1:] == rows[:-1]).all(1)
    first = first[order][np.append(same, False) | np.append(False, same)]
    covered = np.zeros(len(word), bool)
    for k in range(3):
        covered[first + k] = True
    return np.bincount(doc[covered], minlength=docs)


class Measures:
    def __init__(self, piece_file: str, byte_file: str):
        self.words = Words(piece_file, byte_file)

    def forget(self) -> None:
        self.words.forget()

    def all(self, texts: list[str]) -> list[np.ndarray]:
        """The columns of COLUMNS for these texts."""
        w = self.words
        split = [x.encode().split() for x in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        number = w.numbers(split)
        ends, doc = np.cumsum(n), np.repeat(np.arange(len(n)), n)
        chars, tokens = sums(w.chars[number], ends), w.tokens[number].astype(np.int64)
        n_tokens, fallen, by_byte = sums(tokens, ends), sums(w.fallen[number], ends), sums(w.byte_tokens[number], ends)
        # ids of all pieces, text by text; equal ones of a text are counted
        place = np.repeat(w.start[number] - (np.cumsum(tokens) - tokens), tokens) + np.arange(int(tokens.sum()))
        key = np.sort(np.repeat(doc, tokens) * w.width + w.flat[place])
        begins = np.flatnonzero(np.concatenate([[len(key) > 0], key[1:] != key[:-1]]) if len(key) else ENDS)
        count = np.diff(np.append(begins, len(key)))
        weighed = np.bincount(key[begins] // w.width, count * np.log2(np.maximum(count, 1)), len(n)) if len(key) else np.zeros(len(n))
        some = np.maximum(n_tokens, 1)
        full = np.log2(some)
        entropy = np.where(n_tokens > 1, (full - weighed / some) / np.where(full > 0, full, 1), 0.0)
        symbols = np.array([sum(map(x.count, SYMBOLS)) for x in texts], np.int64)
        lines = np.array([duplicate_lines(x) for x in texts], np.int64)
        ratio = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 0.0)
        return [n, chars, symbols, lines, repeated(doc, number, w.hash, len(n)), n_tokens, ratio(chars, n_tokens), ratio(chars, by_byte), ratio(fallen, n_tokens), entropy]


def duplicate_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


_measures: dict[tuple[str, str], Measures] = {}


def measures(piece_file: str, byte_file: str) -> Measures:
    if (piece_file, byte_file) not in _measures:
        _measures[piece_file, byte_file] = Measures(piece_file, byte_file)
    return _measures[piece_file, byte_file]


def forget() -> None:
    """A function of the module, as a table of the module that a task's function names is copied to the worker with it."""
    _measures.clear()


def script(text: str) -> str:
    """The script of most letters, by the first word of their names."""
    found = Counter(unicodedata.name(c, "OTHER").split(" ")[0] for c, _ in Counter(text).most_common() if c.isalpha())
    return found.most_common(1)[0][0].lower() if found else "none"


COLUMNS = [*[(x, "long") for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")], *[(x, "double") for x in LEAST]]


def measured(df: DataFrame, piece_file: str, byte_file: str, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """A row for each of df: doc_id, band (language or script), and the measures."""
    source = pick(df, doc_id=key, text=text, lang=lang)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turns("fertility", forget)
        m = measures(piece_file, byte_file)
        for b in batches:
            for first, texts in in_portions(b, 1, 2_000_000):
                part = b.slice(first, len(texts))
                band = [y if y is not None else f"script {script(x)}" for x, y in zip(texts, part.column(2).to_pylist(), strict=True)]
                yield pa.record_batch([part.column(0), pa.array(band, pa.string()), *map(pa.array, m.all(texts))], ["doc_id", "band", *[n for n, _ in COLUMNS]])
        give_back()

    return source.mapInArrow(work, f"doc_id {source.dtypes[0][1]}, band string, " + ", ".join(f"{n} {k}" for n, k in COLUMNS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bands(rows: DataFrame) -> DataFrame:
    """For each language or script the limits of each measure, from all of its texts that pass the base rules."""
    quartiles = [F.percentile_approx(m, [0.25, 0.75], 1000).alias(m) for m in LEAST]
    got = rows.where(~base_failed()).groupBy("band").agg(*quartiles)
    limits = []
    for m, least in LEAST.items():
        low, high = F.col(m)[0], F.col(m)[1]
        reach = F.greatest((high - low) * REACH[m], F.lit(least))
        limits += [(low - reach).alias(f"{m}_from"), (high + reach).alias(f"{m}_to")]
    return got.select(F.col("band").alias("of"), *limits)


def inside() -> Column:
    """Whether every measure lies in its band."""
    out = F.lit(True)
    for m in LEAST:
        out &= F.col(m).between(F.col(f"{m}_from"), F.col(f"{m}_to"))
    return out


def verdicts(df: DataFrame, piece_file: str, byte_file: str, **columns: str) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, then the fertility measures."""
    scratch = Scratch(df.sparkSession, "fertility")
    rows = scratch.save(measured(df, piece_file, byte_file, **columns), "rows")
    limits = scratch.save(bands(rows), "bands")
    return (
        rows.join(limits, rows.band == limits.of, "left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(inside(), F.lit(False)))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", *LEAST)
    )
