"""Chat transcripts to canonical turns by a hidden Markov model.

The lines of a transcript are the observations: which role a speaker marker at their start names, if any, and
whether it is written as the transcript's first one is; whether a blank line stands before; whether the line
asks or is long. The states are, for each role, the first line of a turn and a later one. Viterbi finds the likeliest
path, so that turns without a marker are found by blank lines and by who speaks after whom, and a quoted marker
inside a turn needs more than itself. The turns are then rendered in one form, in which a text can't be
mistaken for a marker: after each ``<|`` of a text one more ``|`` is put.

How often a turn has no marker, and how often blank lines stand before turns and inside them, is estimated for each way of
writing markers (``Tally``): between two markers of a user and an assistant stand an odd number of blocks, parted by blank lines, only
if they are paragraphs of one turn, or if both markers are of one role and the blocks are turns; so the share of the
latter tells how many blocks are turns. Where every turn has a marker that share is nothing, and paragraphs, code and lists
never begin a turn. A table's rates come from all of its transcripts, those of a single transcript from itself.

A table may hold a transcript in each row (``formatted``), or its pieces in rows, in order (``turns_of_pieces``). Pieces
are sorted by range, so a transcript of any length spreads over many tasks; each task keeps its stretch in
a file of the shared folder. A stretch of a transcript that goes on in other tasks is summed up by the best score
from each role before it to each role at its end; the chain of these small tables gives the roles at all
borders (Viterbi over stretches), and each task then decodes its stretch between them. So the result is that of
one run over the whole transcript, however it is spread.

``pieces`` writes the turns of a table of conversations as such pieces, in several marker styles, some turns without a
marker: the raw input for the operator, for which the table has none.

Defined results: a null or empty transcript has no turns; lines before any marker are the likeliest role's; a name
that is no known role stays the turn's role between the signs of STRICT; elsewhere it is text (``Note: keep this``); a
transcript without any marker, or with those of one speaker only, is parted by blank lines; a null role is written without a marker; a null text is empty; a null turn counts as 0; rows without
conv_id are one conversation; repeated rows are turns each. Lines and transcripts may be of any length. An empty
table gives an empty one, and other columns stay out, whatever their names.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.columns import pick
from docloom.llm.storage import Scratch

ROLES = ("system", "user", "assistant", "tool", "other")
OTHER = len(ROLES) - 1
#: Names that are little else, and names that are words of texts too.
SURE = {"system": 0, "user": 1, "human": 1, "assistant": 2, "ai": 2, "bot": 2, "chatbot": 2, "tool": 3, "function": 3, "observation": 3}
VAGUE = {"instruction": 0, "instructions": 0, "context": 0, "customer": 1, "question": 1, "prompt": 1, "you": 1, "q": 1, "model": 2, "agent": 2, "answer": 2, "response": 2, "a": 2}
_NAME = "([A-Za-z][A-Za-z_-]{0,19})"
#: Forms of a marker.
MARKER = re.compile(rf"[ \t]*(?:<\|(?:im_start\|>)?{_NAME}(?:\|>|(?=[ \t]*$))|\*\*{_NAME}(?::\*\*|\*\*:?)|#{{1,4}} {_NAME}:?(?=[ \t]*$)|\[{_NAME}\]:?|<{_NAME}>|{_NAME}>|{_NAME}:)(?:[ \t]|$)")
#: Forms between which a name that is no known role opens a turn; elsewhere it is a heading, a bold word, a tag or text.
STRICT = (1, 4)
STYLES = (("{}: ", "title"), ("**{}:** ", "title"), ("### {}\n", "title"), ("[{}] ", "upper"), ("<|{}|>\n", "lower"), ("{}> ", "lower"))
LONG = 200

# who speaks first, and who after whom
FIRST = (0.25, 0.62, 0.10, 0.01, 0.02)
AFTER = (
    (0.02, 0.87, 0.08, 0.01, 0.02),
    (0.01, 0.02, 0.94, 0.01, 0.02),
    (0.01, 0.92, 0.02, 0.03, 0.02),
    (0.01, 0.04, 0.88, 0.05, 0.02),
    (0.01, 0.40, 0.40, 0.05, 0.14),
)
#: A turn goes on at a line's end.
STAY = 0.7
# another role's marker before a first line; a marker by chance before a later one
MISMARKED, INSIDE = 0.0005, 0.01
# a marker in another way than the transcript's: seldom a turn's
ODD_FIRST, ODD_INSIDE = 0.01, 0.02
# a name that is no role, between signs
UNKNOWN_SIGNS = 0.001
ASKS = (0.02, 0.35, 0.10, 0.02, 0.10)
LONGER = (0.2, 0.2, 0.5, 0.3, 0.3)
#: A share of blocks below it is none: two speakers of one role in a row have markers, too.
FEW = 0.1

LOG_STAY, LOG_FIRST = math.log(STAY), [math.log(x) for x in FIRST]
LOG_AFTER = [[math.log((1 - STAY) * x) for x in row] for row in AFTER]
N = len(ROLES)
USER, ASSISTANT = 1, 2


@dataclass(frozen=True)
class Rates:
    """Share of turns without a marker; of first lines and of later ones behind a blank line."""

    bare: float = 0.118
    blank_first: float = 0.6
    blank_inside: float = 0.005


#: Where there are no markers to learn from.
PLAIN = Rates()


@dataclass
class Line:
    text: str
    name: str | None  # a marker's name
    form: int
    end: int  # where the marker ends
    blank: bool  # a blank line before
    after: int = 0  # blank lines behind
    lead: int = 0  # blank lines before the first line

    def role(self) -> int | None:
        return None if self.name is None else SURE.get(self.name, VAGUE.get(self.name, OTHER))

    def way(self) -> tuple[int, bool] | None:
        """How the marker is written; null for unknown names, which set no example."""
        return (self.form, self.name in SURE) if self.name in SURE or self.name in VAGUE else None


def read(text: str, blank: bool = False) -> tuple[list[Line], bool]:
    """Lines with something on them, and whether blank ones end the text. blank: whether one stands before it."""
    lines: list[Line] = []
    lead = 0
    for raw in text.split("\n"):
        if not raw.strip():
            blank = True
            if lines:
                lines[-1].after += 1
            else:
                lead += 1
            continue
        m = MARKER.match(raw)
        name = m and m[m.lastindex].lower()
        known = m and (m.lastindex in STRICT or name in SURE or name in VAGUE)
        lines.append(Line(raw, name, m.lastindex, m.end(), blank) if known else Line(raw, None, 0, 0, blank))
        blank = False
    if lines:
        lines[0].lead = lead
    return lines, blank


@dataclass
class Open:
    """What a stretch of a transcript leaves open at one of its ends: the way and role of the marker there (null if it has none), the blocks and other lines without a marker beyond it, and what its first line is: nothing, a marker or none, and whether behind a blank line."""

    way: tuple[int, bool] | None = None
    role: int = -1
    blocks: int = 0
    plain: int = 0
    first: int = 0


COUNTS = ("turns", "blank_turns", "blocks", "plain", "odd", "odd_same", "even", "even_same", "users", "assistants")


class Tally:
    """Counts by way of markers: turns with a marker and those behind a blank line; lines without one, behind a blank line (blocks) and not; stretches between markers of users and assistants with an odd and an even number of blocks, and those between equal roles; markers of users and of assistants."""

    def __init__(self) -> None:
        self.counts: dict[tuple[int, bool], list[int]] = {}

    def add(self, way: tuple[int, bool], name: str, n: int = 1) -> None:
        self.counts.setdefault(way, [0] * len(COUNTS))[COUNTS.index(name)] += n

    def closed(self, a: Open, way: tuple[int, bool], role: int, blocks: int) -> None:
        """A stretch between two markers."""
        if a.way == way and {a.role, role} <= {USER, ASSISTANT}:
            kind = "odd" if blocks % 2 else "even"
            self.add(way, kind)
            if a.role == role:
                self.add(way, f"{kind}_same")

    def feed(self, lines: list[Line]) -> tuple[Open, Open]:
        """Counts the lines of a stretch; what it leaves open at its beginning and its end."""
        head, tail = Open(), Open()
        for k, line in enumerate(lines):
            way = line.way()
            if way is None:
                tail.blocks += line.blank
                tail.plain += not line.blank
                continue
            role = line.role()
            if role in (USER, ASSISTANT):
                self.add(way, "users" if role == USER else "assistants")
            if k:
                self.add(way, "turns")
                if line.blank:
                    self.add(way, "blank_turns")
            if tail.way is None:
                head = Open(way, role, tail.blocks, tail.plain)
            else:
                self.closed(tail, way, role, tail.blocks)
                self.add(tail.way, "blocks", tail.blocks)
                self.add(tail.way, "plain", tail.plain)
            tail = Open(way, role)
        if head.way is None:
            head = Open(None, -1, tail.blocks, tail.plain)
        if lines:
            head.first = (1 if lines[0].way() is not None else 3) + lines[0].blank
        return head, tail

    def joined(self, tail: Open, head: Open, after: Open) -> Open:
        """Counts what stands between the end of a stretch and the next one's first marker; what is open then. after: the next one's own end."""
        if tail.way is not None:
            self.add(tail.way, "blocks", tail.blocks + head.blocks if head.way is not None else 0)
            self.add(tail.way, "plain", tail.plain + head.plain if head.way is not None else 0)
        if head.way is None:
            return Open(tail.way, tail.role, tail.blocks + head.blocks, tail.plain + head.plain)
        if tail.way is None:
            self.ended(Open(head.way, head.role, tail.blocks + head.blocks, tail.plain + head.plain))
        else:
            self.closed(tail, head.way, head.role, tail.blocks + head.blocks)
        return after

    def ended(self, tail: Open) -> None:
        """What is open at the end of a transcript, or before its first marker, counts for the marker there."""
        if tail.way is not None:
            self.add(tail.way, "blocks", tail.blocks)
            self.add(tail.way, "plain", tail.plain)

    def whole(self, lines: list[Line]) -> None:
        """Counts a whole transcript."""
        head, tail = self.feed(lines)
        if head.way is not None:
            self.ended(Open(head.way, head.role, head.blocks, head.plain))
            self.ended(tail)

    def merge(self, way: tuple[int, bool], counts: list[int]) -> None:
        own = self.counts.setdefault(way, [0] * len(COUNTS))
        for k, n in enumerate(counts):
            own[k] += n

    def rates(self) -> dict[tuple[int, bool], Rates]:
        """By way of markers. A way without an odd stretch takes the share of turns among blocks from all ways together; where nothing tells and only one speaker has markers, the other has none."""

        def share(n: dict[str, int]) -> float | None:
            if not n["odd"]:
                return None
            usual = n["even_same"] / n["even"] if n["even"] else 0.0
            found = (n["odd_same"] / n["odd"] - usual) / (1 - usual) if usual < 1 else 0.0
            return found if found >= FEW else 0.0

        every = share({c: sum(x[k] for x in self.counts.values()) for k, c in enumerate(COUNTS)}) if self.counts else None
        out = {}
        for way, counts in self.counts.items():
            n = dict(zip(COUNTS, counts, strict=True))
            q = share(n)
            if q is None and every is None and not (n["users"] and n["assistants"]):
                out[way] = PLAIN
                continue
            q = (every or 0.0) if q is None else q
            bare, turns = q * n["blocks"], n["turns"]
            inside = n["blocks"] - bare
            out[way] = Rates(max(bare / (turns + bare), 0.002) if bare else 1e-9, (n["blank_turns"] + bare + 3) / (turns + bare + 5), (inside + 0.05) / (inside + n["plain"] + 10))
        return out


def own_rates(lines: list[Line]) -> Rates:
    """The rates of a single transcript, by itself."""
    way, tally = example(lines), Tally()
    if way is None:
        return PLAIN
    tally.whole(lines)
    return tally.rates()[way]


def rates_for(known: dict[tuple[int, bool], Rates] | None, way: tuple[int, bool] | None) -> Rates:
    return PLAIN if way is None else (known or {}).get(way, PLAIN)


@cache
def logs(kind: str, role: int | None, blank: bool, asks: bool, long: bool, rates: Rates) -> tuple[list[float], list[float]]:
    if kind == "none":
        first, later = [rates.bare] * N, 1 - INSIDE - ODD_INSIDE
    elif kind == "own":
        marked = 1 - rates.bare - 4 * MISMARKED
        first, later = [marked if r == role else MISMARKED for r in range(N)], UNKNOWN_SIGNS if role == OTHER else INSIDE
    else:
        first, later = [ODD_FIRST if r == role else MISMARKED for r in range(N)], ODD_INSIDE
    blank_first, blank_later = (rates.blank_first, rates.blank_inside) if blank else (1 - rates.blank_first, 1 - rates.blank_inside)
    shape = [(ASKS[r] if asks else 1 - ASKS[r]) * (LONGER[r] if long else 1 - LONGER[r]) for r in range(N)]
    return [math.log(p * blank_first * s) for p, s in zip(first, shape, strict=True)], [math.log(later * blank_later * s) for s in shape]


def seen(line: Line, way: tuple[int, bool] | None, rates: Rates = PLAIN) -> tuple[list[float], list[float]]:
    """Log-probabilities of a line as the first of each role's turns, and as a later one."""
    role = line.role()
    kind = "none" if role is None else "own" if way is not None and line.form == way[0] and (role == OTHER or line.way() == way) else "odd"
    return logs(kind, role, line.blank, line.text.rstrip().endswith("?"), len(line.text) > LONG, rates)


def best_of(values: list[float]) -> int:
    return max(range(len(values)), key=lambda k: (values[k], -k))


def forward(lines: list[Line], way: tuple[int, bool] | None, before: list[float] | None, rates: Rates = PLAIN) -> tuple[list[float], list[tuple[list[int], list[bool]]]]:
    """Scores by role at the end, from scores by role before (null: the transcript begins), and how each line came about: for each role the one before it, and whether the line is a first one."""
    now, back = before, []
    for line in lines:
        first, later = seen(line, way, rates)
        if now is None:
            came, opens = list(range(N)), [True] * N
            now = [a + b for a, b in zip(LOG_FIRST, first, strict=True)]
        else:
            came, opens, then = [], [], []
            for s in range(N):
                r = best_of([now[r] + LOG_AFTER[r][s] for r in range(N)])
                opened, stayed = now[r] + LOG_AFTER[r][s] + first[s], now[s] + LOG_STAY + later[s]
                opens.append(opened > stayed)
                came.append(r if opened > stayed else s)
                then.append(max(opened, stayed))
            now = then
        back.append((came, opens))
    return now if now is not None else [0.0] * N, back


def path(back: list[tuple[list[int], list[bool]]], end: int) -> list[tuple[int, bool]]:
    """Role of each line, and whether it is a first one, from the role at the end."""
    out = []
    for came, opens in reversed(back):
        out.append((end, opens[end]))
        end = came[end]
    return out[::-1]


def example(lines: list[Line]) -> tuple[int, bool] | None:
    """The way of the first marker."""
    return next((w for x in lines if (w := x.way()) is not None), None)


def said(line: Line, opens: bool) -> str:
    return line.text[line.end if opens and line.name else 0 :] + "\n" * line.after


def named(line: Line, role: int) -> str:
    return line.name if role == OTHER and line.name else ROLES[role]


def parse(text: str | None, known: dict[tuple[int, bool], Rates] | None = None) -> list[tuple[str, str]]:
    """(role, content) of each turn. known: rates by way of markers (see rates_of); the transcript's own without them."""
    lines, _ = read(text or "")
    if not lines:
        return []
    way = example(lines)
    now, back = forward(lines, way, None, own_rates(lines) if known is None else rates_for(known, way))
    turns: list[tuple[str, list[str]]] = []
    for line, (role, opens) in zip(lines, path(back, best_of(now)), strict=True):
        if opens:
            turns.append((named(line, role), []))
        turns[-1][1].append(said(line, opens))
    return [(r, "\n".join(rows).strip()) for r, rows in turns]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{r}|>\n{text.replace('<|', '<||')}\n<|end|>\n" for r, text in turns)


def formatted(df: DataFrame, transcript: str = "transcript") -> DataFrame:
    """df with n_turns, roles (joined by commas) and rendered in place of the transcript; extra columns stay."""
    keep = [c for c in df.columns if c not in (transcript, "n_turns", "roles", "rendered")]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{transcript}`"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turns = [parse(x.as_py()) for x in b.column(len(keep))]
            yield pa.record_batch([*b.columns[:-1], pa.array([len(t) for t in turns], pa.int64()), pa.array([",".join(r for r, _ in t) for t in turns], pa.string()), pa.array([render(t) for t in turns], pa.string())], [*keep, "n_turns", "roles", "rendered"])

    kinds = dict(df.dtypes)
    return source.mapInArrow(work, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "n_turns long, roles string, rendered string"]))


def runs(rows: Iterator[tuple]) -> Iterator[tuple[int | None, list[str]]]:
    """Consecutive pieces of one transcript."""
    held: list[str] = []
    of, some = None, False
    for conv, piece in rows:
        if some and conv != of:
            yield of, held
            held = []
        of, some = conv, True
        held.append(piece or "")
    if some:
        yield of, held


def kept(df: DataFrame, folder: str) -> DataFrame:
    """Writes each task's stretch of the sorted pieces as a file; a row for each. To be run once: save it before reading it."""
    ordered = df.withColumn("tie", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange("conv_id", "place", "tie").sortWithinPartitions("conv_id", "place", "tie").select("conv_id", "piece")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out, ends, opened, tally = TaskContext.get().partitionId(), None, {}, [], Tally()

        def note(conv, pieces: list[str]) -> dict:
            # for the stretches at both ends: the first marker's way, whether lines or blank lines end it, what is open
            lines, blank = read("\n".join(pieces))
            way = example(lines)
            head, tail = tally.feed(lines)
            return {"conv": conv, "form": way and way[0], "sure": way and way[1], "lines": len(lines), "blank": blank, "open": [x for o in (head, tail) for x in (o.way[0] if o.way else -1, int(o.way[1]) if o.way else -1, o.role, o.blocks, o.plain, o.first)]}

        held: list[str] = []
        of = None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                at, base = fs.FileSystem.from_uri(folder)
                at.create_dir(base, recursive=True)
                name = f"part-{part:07d}-{uuid.uuid4().hex}.arrow"
                opened.append(at.open_output_stream(f"{base}/{name}"))
                out = pa.ipc.new_stream(opened[0], b.schema)
                of = b.column(0)[0].as_py()
            out.write_batch(b)
            for conv, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if conv != of:
                    if "first" in ends:
                        tally.whole(read("\n".join(held))[0])
                    else:
                        ends["first"] = note(of, held)
                    of, held = conv, []
                held.append(piece or "")
        if out is not None:
            out.close()
            opened[0].close()
            last = note(of, held)
            first = ends.setdefault("first", last)
            counts = [[form, int(sure), *n] for (form, sure), n in tally.counts.items()]
            cols = [[part], [name], *[[x[k]] for x in (first, last) for k in ("conv", "form", "sure", "lines", "blank", "open")], [len(ends) and first is last], [counts]]
            kinds = [pa.int32(), pa.string(), *[pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.bool_(), pa.list_(pa.int64())] * 2, pa.bool_(), pa.list_(pa.list_(pa.int64()))]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "file", *[f"{x}_{k}" for x in ("first", "last") for k in ("conv", "form", "sure", "lines", "blank", "open")], "single", "counts"])

    ends = ", ".join(f"{x}_conv long, {x}_form int, {x}_sure boolean, {x}_lines long, {x}_blank boolean, {x}_open array<long>" for x in ("first", "last"))
    return ordered.mapInArrow(work, f"part int, file string, {ends}, single boolean, counts array<array<long>>")


def table_rates(parts: list, before: dict[int, dict]) -> dict[tuple[int, bool], Rates]:
    """The rates of a table, from its parts' counts (a row for each way of markers) and what their stretches leave open at the borders."""
    tally = Tally()

    def opened(values: list[int]) -> tuple[Open, Open]:
        ends = [values[:6], values[6:]]
        return tuple(Open(None if v[0] < 0 else (v[0], bool(v[1])), *v[2:]) for v in ends)

    tail: Open | None = None
    for p in parts:
        for form, sure, *n in p.counts:
            tally.merge((form, bool(sure)), n)
        head, end = opened(p.first_open)
        if not before[p.part]["goes_on"]:
            if tail is not None:
                tally.ended(tail)
            tail = tally.joined(Open(), head, end)
        else:
            blank = before[p.part]["blank"]
            if blank and head.first == 3:
                head.blocks, head.plain = head.blocks + 1, head.plain - 1
            if head.first in (1, 2) and before[p.part]["begun"]:
                # the stretch's first line is not the transcript's: a turn like any other
                tally.add(head.way, "turns")
                if blank or head.first == 2:
                    tally.add(head.way, "blank_turns")
            tail = tally.joined(tail, head, end)
        if not p.single:
            tally.ended(tail)
            tail = tally.joined(Open(), *opened(p.last_open))
    if tail is not None:
        tally.ended(tail)
    return tally.rates()


def rates_of(df: DataFrame) -> dict[tuple[int, bool], Rates]:
    """The rates of the transcripts whose pieces are df, by way of markers."""
    scratch = Scratch(df.sparkSession, "rates")
    parts = sorted(scratch.save(kept(df, scratch.path("files")), "list").collect(), key=lambda p: p.part)
    found = table_rates(parts, carried(parts))
    scratch.drop()
    return found


def stretches(folder: str, file: str, before: dict) -> Iterator[tuple[int | None, list[Line], int, tuple | None, bool, bool]]:
    """Of a kept file: conv, lines, how many lines in all, way, whether it is the first and the last stretch."""
    at, base = fs.FileSystem.from_uri(folder)
    with at.open_input_stream(f"{base}/{file}") as f:
        found = runs((c, p) for b in pa.ipc.open_stream(f) for c, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        first, held = True, next(found)
        while held is not None:
            conv, pieces = held
            held = next(found, None)
            text = "\n".join(pieces)
            lines, _ = read(text, first and before["blank"])
            yield conv, lines, text.count("\n") + 1, (first and before["way"]) or example(lines) or (before["ahead"] if held is None else None), first, held is None
            first = False


def carried(parts: list) -> dict[int, dict]:
    """For each part: whether its first stretch goes on from the one before (goes_on), with what way of markers and whether after a blank line; and the way that its last stretch's transcript shows only in later parts (ahead)."""
    out, last = {}, None
    for p in parts:
        on = last is not None and last["conv"] == p.first_conv
        own = (p.first_form, p.first_sure) if p.first_form is not None else None
        way = (last["way"] or own) if on else own
        out[p.part] = {"goes_on": on, "way": way if on else None, "blank": on and last["blank"], "begun": on and last["begun"]}
        if p.single:
            begun = out[p.part]["begun"] or p.first_lines > 0
            last = {"conv": p.last_conv, "way": way, "blank": p.last_blank if p.last_lines else (p.last_blank or out[p.part]["blank"]), "begun": begun}
        else:
            last = {"conv": p.last_conv, "way": (p.last_form, p.last_sure) if p.last_form is not None else None, "blank": p.last_blank, "begun": p.last_lines > 0}
    ahead = None
    for p in reversed(parts):
        out[p.part]["ahead"] = ahead
        own = (p.first_form, p.first_sure) if p.first_form is not None else ahead if p.single else None
        ahead = own if out[p.part]["goes_on"] else None
    return out


def summed(listed: DataFrame, folder: str, before: dict[int, dict], known: dict[tuple[int, bool], Rates]) -> DataFrame:
    """part, last (whether it is the part's last stretch), scores: by role before and role at the end (from a beginning, one row) for the stretches at both ends."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = []
                for _, lines, _, way, first, last in stretches(folder, file, before[part]):
                    if not (first or last):
                        continue
                    if first and before[part]["begun"]:
                        scores = [forward(lines, way, [0.0 if r == s else -1e300 for s in range(N)], rates_for(known, way))[0] for r in range(N)] if lines else [[0.0 if r == s else -1e300 for s in range(N)] for r in range(N)]
                    else:
                        scores = [forward(lines, way, None, rates_for(known, way))[0] if lines else []]
                    found.append((last, scores))
                yield pa.record_batch([pa.array([part] * len(found), pa.int32()), pa.array([x for x, _ in found], pa.bool_()), pa.array([x for _, x in found], pa.list_(pa.list_(pa.float64())))], ["part", "last", "scores"])

    return listed.mapInArrow(work, "part int, last boolean, scores array<array<double>>")


def borders(parts: list, before: dict[int, dict], sums: list) -> dict[int, int | None]:
    """For each part the role at the end of its last stretch where the transcript goes on in the next part: Viterbi over the stretches of each transcript that spans parts."""
    scores = {(s.part, s.last): s.scores for s in sums}
    ends: dict[int, int | None] = {}
    chain: list[tuple[int, list[int]]] = []
    now: list[float] | None = None

    def settle() -> None:
        nonlocal now
        if chain and now:
            end = best_of(now)
            for part, came in reversed(chain):
                ends[part] = end
                end = came[end]
        chain.clear()
        now = None

    for p in parts:
        first = scores.get((p.part, p.single))
        if not before[p.part]["goes_on"]:
            settle()
        if p.single or before[p.part]["goes_on"]:
            if before[p.part]["begun"] and now:
                came = [best_of([now[r] + first[r][s] for r in range(N)]) for s in range(N)]
                now = [now[r] + first[r][s] for s, r in enumerate(came)]
                chain.append((p.part, came))
            elif first and first[0]:
                now = first[0]
                chain.append((p.part, list(range(N))))
        if not p.single:
            settle()
            own = scores[p.part, True]
            if own and own[0]:
                now = own[0]
                chain.append((p.part, list(range(N))))
    settle()
    return ends


def decoded(listed: DataFrame, folder: str, before: dict[int, dict], entry: dict[int, int | None], exits: dict[int, dict], known: dict[tuple[int, bool], Rates]) -> DataFrame:
    """part, conv_id, first, last, turn (from 0 in the stretch, -1 for what goes on), role, text: the turns of each stretch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "conv_id", "first", "last", "turn", "role", "text"]
        kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            for part, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for conv, lines, size, way, first, last in stretches(folder, file, before[part]):
                    start = None
                    if first and before[part]["begun"]:
                        start = [0.0 if r == entry[part] else -1e300 for r in range(N)]
                    if not lines:
                        if start is not None:
                            # blank lines inside a transcript
                            rows.append((part, conv, first, last, -1, None, "\n" * (size - 1)))
                        continue
                    now, back = forward(lines, way, start, rates_for(known, way))
                    end = exits[part].get("first" if first and not last else "last") if first or last else None
                    turn, role, held = -1, None, []
                    if start is not None and lines[0].lead:
                        held.append("\n" * (lines[0].lead - 1))
                    for line, (r, opens) in zip(lines, path(back, best_of(now) if end is None else end), strict=True):
                        if opens:
                            if held:
                                rows.append((part, conv, first, last, turn, role, "\n".join(held)))
                            turn, role, held = turn + 1, named(line, r), []
                        held.append(said(line, opens))
                    rows.append((part, conv, first, last, turn, role, "\n".join(held)))
                    if len(rows) > 20_000:
                        yield pa.record_batch([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], names)
                        rows = []
                yield pa.record_batch([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], names)

    return listed.mapInArrow(work, "part int, conv_id long, first boolean, last boolean, turn long, role string, text string")


def turns_of_pieces(df: DataFrame) -> DataFrame:
    """conv_id, turn_no (from 0), role, rendered: a row for each turn of the transcripts whose pieces are df: conv_id, place (in order), piece. What goes to the driver has a bounded number of rows for each partition."""
    spark = df.sparkSession
    scratch = Scratch(spark, "chat")
    folder = scratch.path("files")
    listed = scratch.save(kept(df, folder), "list")
    parts = sorted(listed.collect(), key=lambda p: p.part)
    before = carried(parts)
    known = table_rates(parts, before)
    files = listed.select("part", "file").repartition(max(1, len(parts)))
    sums = scratch.save(summed(files, folder, before, known), "sums").collect()
    ends = borders(parts, before, sums)
    entry, exits, previous = {}, {}, None
    for k, p in enumerate(parts):
        entry[p.part] = previous
        on = k + 1 < len(parts) and before[parts[k + 1].part]["goes_on"]
        exits[p.part] = {"last": ends.get(p.part) if on else None}
        previous = ends.get(p.part, previous if p.single else None)
    rows = scratch.save(decoded(files, folder, before, entry, exits, known), "turns")
    # turns of a transcript are counted on from part to part
    counts = {(r.part, r["first"], r["last"]): r.n for r in rows.where("first or last").groupBy("part", "first", "last").agg((F.max("turn") + 1).alias("n")).collect()}
    base, total = [], 0
    for p in parts:
        if not before[p.part]["goes_on"]:
            total = 0
        base.append((p.part, total))
        total = total + counts.get((p.part, True, True), 0) if p.single else counts.get((p.part, False, True), 0)
    if not base:
        return rows.select("conv_id", F.col("turn").alias("turn_no"), "role", F.col("text").alias("rendered"))
    base = spark.createDataFrame(base, "part int, base long")
    placed = rows.join(F.broadcast(base), "part").withColumn("turn_no", F.col("turn") + F.when(F.col("first"), F.col("base")).otherwise(0))
    # only turns at the ends of parts can be in pieces
    edge = F.col("turn") < 0
    ended = placed.where("last").groupBy("part").agg(F.max("turn_no").alias("end")).withColumnRenamed("part", "of")
    placed = placed.join(F.broadcast(ended), (F.col("part") == F.col("of")) & F.col("last") & (F.col("turn_no") == F.col("end")), "left").withColumn("split", edge | F.col("of").isNotNull())
    parted = placed.where("split").groupBy("conv_id", "turn_no").agg(F.max("role").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "\n").alias("text"))
    every = placed.where("not split").select("conv_id", "turn_no", "role", "text").unionByName(parted)
    body = F.replace(F.btrim("text", F.lit(" \t\n\r\x0b\f")), F.lit("<|"), F.lit("<||"))
    return every.select("conv_id", "turn_no", "role", F.concat(F.lit("<|"), "role", F.lit("|>\n"), body, F.lit("\n<|end|>\n")).alias("rendered"))


def pieces(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, place, piece: each turn as it stands in a transcript; a fifth, and those without a role, have no marker."""
    rows = pick(df, conv_id=conversation, turn=turn, role=role, text=text)
    turn_no = F.coalesce(F.col("turn").cast("long"), F.lit(0))
    words = F.trim(F.coalesce("text", F.lit("")))
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    case = {"title": F.initcap("role"), "upper": F.upper("role"), "lower": F.lower("role")}
    written = F.lit(None).cast("string")
    for k, (form, kind) in enumerate(STYLES):
        start, end = form.split("{}")
        written = F.when(style == k, F.concat(F.lit(start), case[kind], F.lit(end))).otherwise(written)
    bare = F.col("role").isNull() | (turn_no > 0) & (F.pmod(F.xxhash64("conv_id") + turn_no, F.lit(5)) == 0) & (words != "")
    piece = F.concat(F.lit("\n"), F.when(bare, words).otherwise(F.concat(written, words)))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(turn_no.alias("turn"), "role", words.alias("text")).alias("place"), piece.alias("piece"))
