"""An index of labels: one pass over a text finds where any of hundreds of phrases begins.

A batch of texts is folded into one string (small letters, no accents, no blanks, dots, hyphens, colons and apostrophes,
as a label may be written with or without them) whose places are kept, and one automaton of all folded phrases
runs over it. Only at the places that it names, a phrase's own pattern is tried with the value that
follows it. So a text costs one pass and a handful of short matches, however many fields and labels there are. The work runs in
Arrow batches; rules on what was found stay Column expressions.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.phrases import Labelled, sign, words

#: Between texts in the folded string, and what folds to nothing.
BORDER, NOTHING = 1, " .-:'’`"
#: Letters that patterns take for s and i where capitals don't count, but that fold to themselves or not to one letter.
ODD = re.compile("[ſıİ]")


@cache
def _folds() -> np.ndarray:
    """For each character of the first plane what it folds to; 0 for nothing."""
    table = np.arange(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        s = chr(c)
        if s.isspace() or s in NOTHING:
            table[c] = 0
        elif not 0xD800 <= c < 0xE000:
            small = s.lower()
            table[c] = ord(unicodedata.normalize("NFD", small[0])[0]) if len(small) == 1 or c == 0x130 else c
    table[0] = BORDER
    table[ord("°")] = ord("o")
    return table


def folded(text: str) -> str:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    low = codes < 0x10000
    codes[low] = _folds()[codes[low]]
    return codes[codes != 0].tobytes().decode("utf-32-le", "surrogatepass")


def spellings(phrase: str) -> set[str]:
    """What a phrase folds to; a sign for digits ends it, a letter that may lack gives two."""
    phrase = phrase.split("#")[0].replace("|", "")
    found = {""}
    for k, c in enumerate(phrase):
        if c == "?":
            continue
        more = {s + folded(c) for s in found}
        found = found | more if phrase[k + 1 : k + 2] == "?" else more
    return found


class Finder:
    """Places at which phrases may begin. Phrases are numbered as they are given."""

    def __init__(self, phrases: list[str]):
        self.automaton = ahocorasick.Automaton()
        known: dict[str, list[int]] = {}
        for n, phrase in enumerate(phrases):
            for s in spellings(phrase):
                if not s:
                    raise ValueError(f"no letter to look for in {phrase!r}")
                known.setdefault(s, []).append(n)
        for s, ns in known.items():
            self.automaton.add_word(s, (len(s), tuple(ns)))
        self.some = bool(known)
        self.automaton.make_automaton()

    def places(self, texts: list[str]) -> list[dict[int, list[int]]]:
        """For each text a map from a phrase's number to its places, in order."""
        if not self.some:
            return [{} for _ in texts]
        codes = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
        low = codes < 0x10000
        codes[low] = _folds()[codes[low]]
        kept = np.flatnonzero(codes)
        hits = [(end - size + 1, ns) for end, (size, ns) in self.automaton.iter(codes[kept].tobytes().decode("utf-32-le", "surrogatepass"))]
        out: list[dict[int, list[int]]] = [{} for _ in texts]
        if hits:
            at = kept[np.array([h[0] for h in hits])]
            text = np.searchsorted(ends, at, side="right")
            begin = at - (ends - [len(t) + 1 for t in texts])[text]
            for k, p, (_, ns) in zip(text.tolist(), begin.tolist(), hits, strict=True):
                for n in ns:
                    out[k].setdefault(n, []).append(p)
        for found in out:
            for n, places in found.items():
                if len(places) > 1:
                    found[n] = sorted(set(places))
        return out


class Ways:
    """The ways to the values of some fields: labels with a kind of value, or a value's own shape, in order for each field."""

    def __init__(self, fields: dict[str, list[Labelled]], values: dict[str, str], skip: dict[str, str] | None = None, tail: dict[str, str] | None = None, lists: dict[str, list[str]] | None = None):
        """skip: for a field, a pattern of lines whose values are not its own. tail: what may not stand behind a field's value (capitals count). lists: the words of a kind of value that is one of a list, each as a word of its own."""
        phrases: list[str] = []
        #: Of each way its field, its number, itself, its pattern, and the lines that its field skips.
        self.ways: list[tuple[int, int, Labelled, re.Pattern, re.Pattern | None]] = []
        #: The way of each phrase, and the ways that are tried on every text.
        self.of, self.always, self.n = [], [], len(fields)
        # ways whose values are words of a list are found by the words
        self.listed: set[int] = set()
        for f, (name, ways) in enumerate(fields.items()):
            lines = re.compile(skip[name], re.I) if skip and name in skip else None
            for k, way in enumerate(ways):
                by = way.labels or tuple((lists or {}).get(way.value, ()))
                if not by:
                    self.always.append(len(self.ways))
                elif not way.labels:
                    self.listed.add(len(self.ways))
                phrases += by
                self.of += [len(self.ways)] * len(by)
                behind = (tail or {}).get(name, "")
                self.ways.append((f, k, way, re.compile(f"(?i:{way.pattern(values)}){behind}", re.M), lines))
        self.finder = Finder(phrases)

    @staticmethod
    def _matches(text: str, anywhere: bool, pattern: re.Pattern, places: list[int]) -> Iterator[re.Match]:
        if anywhere:
            yield from pattern.finditer(text)
            return
        end = 0
        for p in places:
            m = pattern.match(text, p) if p >= end else None
            if m:
                end = m.end()
                yield m

    def found(self, texts: list[str], every: bool) -> Iterator[list[list[tuple[int, str]]]]:
        """For each text and field: (number of the way, value) of the first match of each way, or of every match. Only ways of which a phrase is there are tried, and those without phrases."""
        for text, places in zip(texts, self.finder.places(texts), strict=True):
            at: dict[int, list[int]] = {w: [] for w in self.always}
            for n, ps in places.items():
                w = self.of[n]
                at[w] = sorted({*at[w], *ps}) if w in at else ps
            odd = self.listed if ODD.search(text) else ()
            at |= {w: [] for w in odd}
            row: list[list[tuple[int, str]]] = [[] for _ in range(self.n)]
            for w in sorted(at):
                f, k, way, pattern, skip = self.ways[w]
                anywhere = w in odd or not at[w] or bool(way.labels) and not way.behind
                for m in self._matches(text, anywhere, pattern, at[w]):
                    if skip and skip.search(text, text.rfind("\n", 0, m.start()) + 1, _line_end(text, m.end())):
                        continue
                    row[f].append((k, m[1]))
                    if not every:
                        break
            yield row


def _line_end(text: str, at: int) -> int:
    end = text.find("\n", at)
    return len(text) if end < 0 else end


def _per_text(make: Callable[[], Callable[[list[str]], pa.Array]], kind: str) -> Callable[[Column], Column]:
    """A Column function that works on batches of texts; what make returns is made once for each task. Functions over the same texts share one exchange with Python."""
    made: list[Callable[[list[str]], pa.Array]] = []

    def run(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(make())
        return made[0]([t or "" for t in texts.to_pylist()])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)


def listed(rows: list[list[tuple]], kind: pa.StructType) -> pa.ListArray:
    """Rows of tuples as an array of lists of structs, column by column."""
    flat = [x for row in rows for x in row]
    columns = zip(*flat, strict=True) if flat else [()] * kind.num_fields
    values = pa.StructArray.from_arrays([pa.array(c, kind.field(n).type) for n, c in enumerate(columns)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), values)


_SPANS = pa.struct([("way", pa.int32()), ("value", pa.string())])


def spans(make: Callable[[], Ways], names: list[str], every: bool = False) -> Callable[[Column], Column]:
    """text to a struct with, for each field, an array of struct (way, value)."""

    def made() -> Callable[[list[str]], pa.Array]:
        ways = make()

        def work(texts: list[str]) -> pa.Array:
            rows = list(ways.found(texts, every))
            columns = [listed([r[n] for r in rows], _SPANS) for n in range(len(names))]
            return pa.StructArray.from_arrays(columns, names)

        return work

    return _per_text(made, ", ".join(f"{n} array<struct<way int, value string>>" for n in names))


class Sheet:
    """Fields of a sheet: the value behind the first of a field's labels that has one. A label begins a line, a cell, or stands behind two blanks or more."""

    def __init__(self, rules: list[tuple], kinds: dict[str, str]):
        """rules: name, labels, kind, confidence."""
        self.rules, phrases = [], []
        for name, labels, kind, confidence in rules:
            tries = []
            for label in labels:
                end = "" if label.endswith(":") else "\\s*[:\\-]?"
                tries.append((len(phrases), re.compile(sign(label) if kind == "flag" else words(label) + end + "[ \t]*" + kinds[kind], re.I | re.M)))
                phrases.append(label)
            self.rules.append((name, kind, confidence, tries))
        self.finder = Finder(phrases)

    @staticmethod
    def _begins(text: str, p: int) -> bool:
        if not p or text[p - 1] in "\n\t":
            return True
        q = p
        while q and text[q - 1].isspace():
            q -= 1
        gap = text[q:p]
        return not q or "\n" in gap or "\t" in gap or len(gap) > 1 or text[q - 1] in ",|;"

    def found(self, texts: list[str]) -> Iterator[list[tuple[str, str, float, str]]]:
        """For each text: (field, kind, confidence, value as it stands) of each field that is there."""
        for text, places in zip(texts, self.finder.places(texts), strict=True):
            row = []
            for name, kind, confidence, tries in self.rules:
                for n, pattern in tries:
                    if n not in places:
                        continue
                    ms = (pattern.match(text, p) for p in places[n] if kind == "flag" or self._begins(text, p))
                    value = next(("1" if kind == "flag" else m[1] for m in ms if m), None)
                    if value is not None:
                        row.append((name, kind, confidence, value))
                        break
            yield row


_FOUND = pa.struct([("k", pa.string()), ("kind", pa.string()), ("confidence", pa.float64()), ("value", pa.string())])


def sheet(make: Callable[[], Sheet]) -> Callable[[Column], Column]:
    """text to an array of struct (k, kind, confidence, value) of the fields found."""

    def made() -> Callable[[list[str]], pa.Array]:
        index = make()
        return lambda texts: listed(list(index.found(texts)), _FOUND)

    return _per_text(made, "array<struct<k string, kind string, confidence double, value string>>")


class Signs:
    """Which of some named signs a text has. A sign is a phrase in one or several spellings, or a shape."""

    def __init__(self, phrases: dict[str, list[list[tuple[str, str]]]], shapes: dict[str, list[str]]):
        """phrases: by name, signs; each a list of spellings, pairs of a phrase to look for and the pattern that must match at its place. shapes: by name, patterns without a phrase of their own."""
        self.phrases = [(name, f"{name} {n}", phrase, re.compile(p, re.I | re.M)) for name, ps in phrases.items() for n, spelled in enumerate(ps) for phrase, p in spelled]
        self.shapes = [(name, re.compile(p, re.I | re.M)) for name, ps in shapes.items() for p in ps]
        self.finder = Finder([p for _, _, p, _ in self.phrases])

    def counts(self, texts: list[str]) -> Iterator[dict[str, int]]:
        """For each text, by name, how many of its signs are there."""
        for text, places in zip(texts, self.finder.places(texts), strict=True):
            seen: set[tuple[str, str]] = set()
            for k, at in places.items():
                name, key, _, pattern = self.phrases[k]
                if any(pattern.match(text, p) for p in at):
                    seen.add((name, key))
            n: dict[str, int] = {}
            for name, _ in seen:
                n[name] = n.get(name, 0) + 1
            for name, pattern in self.shapes:
                if pattern.search(text):
                    n[name] = n.get(name, 0) + 1
            yield n


def counts(make: Callable[[], Signs], names: list[str]) -> Callable[[Column], Column]:
    """text to a struct with, for each name, how many of its phrases and patterns the text has."""

    def made() -> Callable[[list[str]], pa.Array]:
        signs = make()

        def work(texts: list[str]) -> pa.Array:
            rows = list(signs.counts(texts))
            return pa.StructArray.from_arrays([pa.array([r.get(n, 0) for r in rows], pa.int32()) for n in names], names)

        return work

    return _per_text(made, ", ".join(f"{n} int" for n in names))
