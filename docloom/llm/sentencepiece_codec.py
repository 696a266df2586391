"""SentencePiece encoding and decoding by a prefix table.

For every prefix of a chunk the table holds the one token that its encoding ends with. A token that the
automaton finds to end at position i is that token if it is compatible with the last token of the prefix
before it, that is, if merging the two texts together would leave both tokens as they are. The ids are then
read backwards from the end. Each position costs the automaton's matches there, so a chunk takes time linear
in its length, however the merges are nested.

Pieces never hold a space after another character, so a text is encoded in chunks that begin at spaces (and
at line feeds, which no piece holds); each worker keeps what it found for the chunks it has seen, within a
bound. Runs of spaces have pieces of one common score, for which no unique last token exists; they are
merged by the ordinary agenda instead, after everything else, as their score is below all others.

Defined results: a null text counts as empty; an empty text has no ids (the digest of the empty string).
Repeated rows and rows without doc_id are encoded each on their own, texts of any length whole; an empty table
gives an empty one; columns other than the two named play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.columns import give_back, pick, take_turns

SPACE = "▁"
#: Chunks that a worker remembers at most; then it starts anew.
REMEMBERED = 500_000
#: Between spaces and line feeds where the fast way of splitting isn't safe.
PARTS = re.compile(r" +[^ \n]*|\n[^ \n]*|[^ \n]+")
#: Pair tests that a worker remembers at most.
PAIRS = 400_000
FAR = 1 << 60


class PieceCodec:
    """Encodes and decodes as the sentencepiece library does with a merge-type model without normalisation."""

    def __init__(self, model_file: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = lib.get_piece_size()
        self.text = [lib.id_to_piece(i) for i in range(n)]
        self.bytes_at = {}
        normal = []
        for i in range(n):
            if lib.is_byte(i):
                self.bytes_at[int(self.text[i][3:5], 16)] = i
            elif not (lib.is_unknown(i) or lib.is_control(i) or lib.is_unused(i)):
                normal.append(i)
        self.byte_ids = {i: b for b, i in self.bytes_at.items()}
        self.silent = {i for i in range(n) if lib.is_control(i)}
        score = {i: lib.get_score(i) for i in normal}
        self.runs = {self.text[i]: i for i in normal if len(self.text[i]) > 1 and not self.text[i].strip(SPACE)}
        order = sorted((i for i in normal if self.text[i] not in self.runs), key=lambda i: (-score[i], i))
        self.rank = {self.text[i]: k for k, i in enumerate(order)}
        self.id_of = {self.text[i]: i for i in order}
        self.right, self.left = {}, {}
        for piece in self.rank:
            self._spines(piece)
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id_of.items():
            if piece in self.right:
                self.automaton.add_word(piece, (len(piece), piece, i))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.run_ids: dict[int, list[int]] = {}
        self.known: dict[str, str] = {}
        self.decoded: dict[str, str] = {}

    def _merged(self, parts: list[str]) -> list:
        """The merge tree(s) of these parts: nested pairs, best rank first, leftmost among equals."""
        trees: list = list(parts)
        while len(parts) > 1:
            best, at = min((self.rank.get(a + b, FAR), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == FAR:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            trees[at : at + 2] = [(trees[at], trees[at + 1])]
        return trees

    def _spines(self, piece: str) -> None:
        """Notes, from the character outwards, the ranks and texts along a piece's right and left edges. Pieces that their own merges don't reach have none."""
        trees = self._merged(list(piece))
        if len(trees) > 1:
            return

        def flat(t) -> str:
            return t if isinstance(t, str) else flat(t[0]) + flat(t[1])

        for side, spines in ((1, self.right), (0, self.left)):
            t, down = trees[0], []
            while True:
                down.append(flat(t))
                if isinstance(t, str):
                    break
                t = t[side]
            spines[piece] = [(self.rank[x], x) for x in reversed(down)]

    def compatible(self, a: str, b: str) -> bool:
        """Whether the text a + b keeps a and b as its two tokens."""
        r, l = self.right[a], self.left[b]
        i = j = 0
        while True:
            over_a = r[i + 1][0] if i + 1 < len(r) else FAR
            over_b = l[j + 1][0] if j + 1 < len(l) else FAR
            across = self.rank.get(r[i][1] + l[j][1], FAR)
            if across < over_a and across <= over_b and across < FAR:
                return False
            if over_a == over_b == FAR:
                return True
            if over_a <= over_b:
                i += 1
            else:
                j += 1

    def prefix_table(self, s: str) -> list[int]:
        """Ids of a stretch of known characters."""
        last: list = [None] * (len(s) + 1)
        fits = self.fits
        for end, (size, piece, number) in self.automaton.iter(s):
            end += 1
            if last[end] is not None:
                continue
            start = end - size
            if start:
                if last[start] is None:
                    continue
                _, before, left = last[start]
                pair = left << 32 | number
                good = fits.get(pair)
                if good is None:
                    if len(fits) > PAIRS:
                        fits.clear()
                    good = fits[pair] = self.compatible(before, piece)
                if not good:
                    continue
            last[end] = (start, piece, number)
        ids, at = [], len(s)
        while at:
            at, _, number = last[at]
            ids.append(number)
        return ids[::-1]

    def run(self, k: int) -> list[int]:
        """Ids of k spaces in a row that no other piece takes: equal scores, so leftmost pairs first."""
        if k in self.run_ids:
            return self.run_ids[k]
        size, after, before = [1] * k, [*range(1, k), -1], [*range(-1, k - 1)]
        agenda = [(i, i + 1, 2) for i in range(k - 1)] if SPACE * 2 in self.runs else []
        heapq.heapify(agenda)
        while agenda:
            i, j, total = heapq.heappop(agenda)
            if not size[i] or not size[j] or after[i] != j or size[i] + size[j] != total:
                continue
            size[i], size[j] = total, 0
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and SPACE * (size[a] + size[b]) in self.runs:
                    heapq.heappush(agenda, (a, b, size[a] + size[b]))
        ids = [self.runs.get(SPACE * n) or self.id_of[SPACE] for n in size if n]
        if len(self.run_ids) < 10_000:
            self.run_ids[k] = ids
        return ids

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of a chunk: spaces, then characters other than spaces."""
        word = chunk.lstrip(" ")
        spaces = len(chunk) - len(word)
        ids: list[int] = []
        stretch = SPACE if spaces else ""
        for c in word:
            if c in self.rank:
                stretch += c
                continue
            ids += self.prefix_table(stretch)
            ids += [self.bytes_at[b] for b in c.encode()]
            stretch = ""
        ids += self.prefix_table(stretch)
        if spaces > 1:
            lone = ids[0] == self.id_of[SPACE]
            ids = self.run(spaces - (not lone)) + ids[lone:]
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids as they stand: bytes joined, spaces restored; the first space is still there."""
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.byte_ids:
                raw.append(self.byte_ids[i])
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()
            if i not in self.silent:
                out.append(self.text[i])
        if raw:
            out.append(raw.decode(errors="replace"))
        return "".join(out).replace(SPACE, " ")

    def forget(self) -> None:
        self.known.clear()
        self.decoded.clear()
        self.fits.clear()

    def learn(self, chunk: str) -> str:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
            self.decoded.clear()
        ids = self.chunk_ids(chunk)
        # most chunks come back as they were
        back = self.decode(ids)
        if back != chunk:
            self.decoded[chunk] = back
        self.known[chunk] = said = ",".join(map(str, ids))
        return said

    def chunks(self, text: str) -> list[str]:
        """The text, with the space that the model puts before it, in parts that no piece crosses."""
        if not text:
            return []
        text = " " + text.replace(SPACE, " ")
        if "  " in text or "\x01" in text:
            return PARTS.findall(text)
        return text.replace(" ", "\x01 ").replace("\n", "\x01\n").split("\x01")[1:]

    def encode_decode(self, text: str) -> tuple[str, str]:
        """The ids as decimals joined by commas, and the decoded text."""
        known, decoded, ids, back = self.known, self.decoded, [], []
        for c in self.chunks(text):
            said = known.get(c)
            if said is None:
                said = self.learn(c)
            ids.append(said)
            back.append(decoded.get(c, c))
        return ",".join(ids), "".join(back)[1:]

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_decode(text)[0].split(",") if x]


_codecs: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """One for each model and process; workers keep theirs from task to task."""
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


def forget() -> None:
    """A function of the module, as a table of the module that a task's function names is copied to the worker with it."""
    _codecs.clear()


def encode_decode(df: DataFrame, model_file: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, ids (decimals joined by commas), n_tokens, decoded: one row for each of df, no shuffle."""
    source = pick(df, doc_id=key, text=text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turns("sentencepiece", forget)
        c = codec(model_file)
        for b in batches:
            got = [c.encode_decode(x or "") for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([x.count(",") + 1 if x else 0 for x, _ in got], pa.int64()), pa.array([x for _, x in got], pa.string())], ["doc_id", "ids", "n_tokens", "decoded"])

    return source.mapInArrow(work, f"doc_id {source.dtypes[0][1]}, ids string, n_tokens long, decoded string")


def digests(df: DataFrame, model_file: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256. The digests are taken where the ids are made, so that neither ids nor texts go back to the JVM."""
    source = pick(df, doc_id=key, text=text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turns("sentencepiece", forget)
        c, sha = codec(model_file), hashlib.sha256
        for b in batches:
            n, ids, back = [], [], []
            for x in b.column(1):
                said, text = c.encode_decode(x.as_py() or "")
                n.append(said.count(",") + 1 if said else 0)
                ids.append(sha(said.encode()).hexdigest())
                back.append(sha(text.encode()).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    return source.mapInArrow(work, f"doc_id {source.dtypes[0][1]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
