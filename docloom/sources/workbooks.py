"""Workbooks (.xlsx) as a Spark data source: cells as rows (file, sheet, place, r, c, v), read and written.

``spark.read.format("workbook").load(path)`` reads a file, a folder or a pattern. Small files are packed into partitions by
their bytes; a large one gives a partition for each sheet, so that its sheets are read side by side. Sheets are
named and ordered by the workbook's relations, whatever the numbers of their parts are. A sheet is parsed as it is
unpacked and passed on in batches; shared strings go to a temporary file beyond SPILL bytes; so memory doesn't grow with a
workbook. A schema with fewer columns reads fewer, and filters on the sheet's name skip sheets. Damaged files give no rows.

With the option ``rows`` a row of a sheet is one: (file, sheet, place, r, v), v an array with a null for each empty cell before
the last filled one. What reads rows needs no shuffle to bring their cells together.

``df.write.format("workbook").mode("append").save(folder)`` writes a workbook for each value of file. Rows must come sorted by
file, place, r, c, with all rows of a file in one task: ``sheets_together`` sees to that. Rows in the form above are written too. Files stand in the folder only
after all tasks are done.
"""

from __future__ import annotations

import fnmatch
import functools
import io
import itertools
import re
import tempfile
import uuid
import zipfile
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

SCHEMA = "file string, sheet string, place int, r int, c int, v string"
ROWS = "file string, sheet string, place int, r int, v array<string>"
_KINDS = {"file": pa.string(), "sheet": pa.string(), "place": pa.int32(), "r": pa.int32(), "c": pa.int32(), "v": pa.string()}
_ROW_KINDS = {k: t for k, t in _KINDS.items() if k not in ("c", "v")} | {"v": pa.list_(pa.string())}
#: Bytes from which a file is read by sheets, bytes of a partition of smaller files and how many bytes the opening of one counts (2 MB are some 200,000 cells), bytes of shared strings in memory, rows of a batch.
LARGE, PACK, OPEN, SPILL, BATCH = 16 << 20, 2 << 20, 4 << 10, 8 << 20, 5_000
#: Bytes of a sheet parsed at a time, bytes up to which a file is read at once, cells written at a time.
CHUNK, WHOLE, CELLS = 64 << 10, 1 << 20, 1_000
#: Fixed values of the format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
SHEET_TYPE, BOOK_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"
DAMAGED = (zipfile.BadZipFile, ElementTree.ParseError, expat.ExpatError, KeyError, IndexError, ValueError, EOFError, NotImplementedError)


class SharedStrings:
    """The strings that cells name by number, in a file once they are many."""

    def __init__(self, stream: BinaryIO):
        self.file, self.ends = tempfile.SpooledTemporaryFile(SPILL), array("Q", [0])
        root = None
        for event, e in ElementTree.iterparse(stream, ("start", "end")):
            if root is None:
                root = e
            elif event == "end" and e.tag == f"{{{MAIN}}}si":
                # what tells how a text is pronounced is no part of it
                parts = [t.text or "" for p in e if p.tag in (f"{{{MAIN}}}t", f"{{{MAIN}}}r") for t in p.iter(f"{{{MAIN}}}t")]
                self.file.write("".join(parts).encode())
                self.ends.append(self.file.tell())
                root.clear()

    def __getitem__(self, n: int) -> str:
        if not 0 <= n < len(self.ends) - 1:
            raise IndexError(n)
        self.file.seek(self.ends[n])
        return self.file.read(self.ends[n + 1] - self.ends[n]).decode()


_PLACE = re.compile(r"([A-Z]+)(\d+)")


@functools.cache
def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


class Workbook:
    def __init__(self, stream: BinaryIO):
        self.zip, self._shared = zipfile.ZipFile(stream), None
        names = set(self.zip.namelist())
        targets = {}
        if "xl/_rels/workbook.xml.rels" in names:
            for x in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels")):
                to = x.get("Target") or ""
                targets[x.get("Id")] = to.lstrip("/") if to.startswith("/") else f"xl/{to}"
        listed = list(ElementTree.fromstring(self.zip.read("xl/workbook.xml")).iter(f"{{{MAIN}}}sheet")) if "xl/workbook.xml" in names else []
        #: Title and part of each sheet, in order.
        self.sheets: list[tuple[str, str]] = [(x.get("name") or "", targets.get(x.get(f"{{{RELATIONS}}}id"), "")) for x in listed]
        if not any(part in names for _, part in self.sheets):
            # a book without relations: parts by number
            parts = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml$", n)[1]))
            self.sheets = [(self.sheets[k][0] if k < len(self.sheets) else part, part) for k, part in enumerate(parts)]
        self.sheets = [(title, part if part in names else "") for title, part in self.sheets]

    def _value(self, kind: str | None, said: str) -> str:
        if kind == "s" and said:
            if self._shared is None:
                with self.zip.open("xl/sharedStrings.xml") as f:
                    self._shared = SharedStrings(f)
            return self._shared[int(said)]
        return said

    def cells(self, place: int) -> Iterator[tuple[int, int, str]]:
        """Row, column and text of each filled cell of a sheet, as it is unpacked."""
        part = self.sheets[place][1]
        if not part:
            return
        held: list[tuple[int, int, str]] = []
        r = c = -1
        # of the cell at hand: whether one is open, its kind, the depth of what is open in it, its texts, whether text counts, whether its value was met
        inside, kind, depth, texts, taking, met = False, None, 0, [], False, False
        row_tag, cell_tag, text_tag, value_tag = (f"{MAIN}}}{t}" for t in ("row", "c", "t", "v"))

        def start(tag: str, named: dict[str, str]) -> None:
            nonlocal r, c, inside, kind, depth, texts, taking, met
            if inside:
                depth += 1
                # an element's text ends where another begins in it
                if kind == "inlineStr":
                    taking = tag == text_tag
                else:
                    taking = tag == value_tag and depth == 1 and not met
                    met = met or taking
            elif tag == cell_tag:
                inside, kind, depth, texts, taking, met = True, named.get("t"), 0, [], False, False
                at = _PLACE.fullmatch(named.get("r") or "")
                if at:
                    r, c = int(at[2]) - 1, column_number(at[1])
                else:
                    c += 1
            elif tag == row_tag:
                r, c = int(named.get("r") or r + 2) - 1, -1

        def said(text: str) -> None:
            if taking:
                texts.append(text)

        def end(tag: str) -> None:
            nonlocal inside, depth, taking
            if inside:
                if depth:
                    depth, taking = depth - 1, False
                else:
                    inside = False
                    text = "".join(texts)
                    if kind != "inlineStr":
                        text = self._value(kind, text)
                    if text:
                        held.append((r, c, text))

        parser = expat.ParserCreate(namespace_separator="}")
        parser.buffer_text = True
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, said
        with self.zip.open(part) as stream:
            while True:
                try:
                    chunk = stream.read(CHUNK)
                    parser.Parse(chunk, not chunk)
                except DAMAGED:
                    yield from held
                    raise
                yield from held
                held.clear()
                if not chunk:
                    return


def rows(stream: BinaryIO, places: list[int] | None = None, sheets: set[str] | None = None) -> Iterator[tuple[str, int, int, int, str]]:
    """Sheet, place, row, column and text of the cells of a workbook; a damaged one ends where it is damaged."""
    try:
        book = Workbook(stream)
        for place, (title, _) in enumerate(book.sheets):
            if (places is None or place in places) and (sheets is None or title in sheets):
                for r, c, v in book.cells(place):
                    yield title, place, r, c, v
    except DAMAGED:
        return


def whole_rows(cells: Iterator[tuple[str, int, int, int, str]]) -> Iterator[tuple[str, int, int, list[str | None]]]:
    """Sheet, place, row and texts by column of cells that come row by row; of a column that a row names twice the last text counts."""
    now, texts = None, []
    for sheet, place, r, c, v in cells:
        if now is None or r != now[2] or place != now[1]:
            if now is not None:
                yield *now, texts
            now, texts = (sheet, place, r), []
        if c > len(texts):
            texts.extend([None] * (c - len(texts)))
        if c == len(texts):
            texts.append(v)
        else:
            texts[c] = v
    if now is not None:
        yield *now, texts


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub("^file:/(?!/)", "file:///", path)
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _listed(path: str) -> list[tuple[str, int]]:
    """Names and sizes of the workbooks of a file, a folder or a pattern."""
    store, at = store_of(path)
    wild = re.search(r"[*?\[]", at)
    if wild:
        base = at[: wild.start()].rpartition("/")[0] or "."
        found = [f for f in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)) if fnmatch.fnmatch(f.path, at)]
    else:
        info = store.get_file_info(at)
        found = store.get_file_info(fs.FileSelector(at)) if info.type == fs.FileType.Directory else [info]
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and (f.path.lower().endswith(".xlsx") or f.path == at))


@dataclass
class Files(InputPartition):
    #: Each file with the places of its sheets, or None for all.
    files: list[tuple[str, list[int] | None]]

    def __post_init__(self) -> None:
        super().__init__(None)


class _Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], by_rows: bool = False):
        self.path, self.columns, self.sheets, self.by_rows = path, columns, None, by_rows

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("sheet",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.sheets = named if self.sheets is None else self.sheets & named
            else:
                yield f

    def partitions(self) -> list[Files]:
        store = store_of(self.path)[0]
        parts, pack, size = [], [], 0
        for path, n in _listed(self.path):
            if n >= LARGE:
                try:
                    with store.open_input_file(path) as f:
                        parts += [Files([(path, [k])]) for k in range(len(Workbook(f).sheets))]
                except DAMAGED:
                    pass
                continue
            pack.append((path, None))
            size += n + OPEN
            if size >= PACK:
                parts, pack, size = [*parts, Files(pack)], [], 0
        return [*parts, Files(pack)] if pack else parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store = store_of(self.path)[0]
        kinds = _ROW_KINDS if self.by_rows else _KINDS
        wanted = [(list(kinds).index(c), kinds[c]) for c in self.columns]

        def found() -> Iterator[tuple]:
            for path, places in partition.files:
                with store.open_input_file(path) as f:
                    cells = rows(io.BytesIO(f.read()) if f.size() <= WHOLE else f, places, self.sheets)
                    for row in whole_rows(cells) if self.by_rows else cells:
                        yield path, *row

        every = found()
        while held := list(itertools.islice(every, BATCH)):
            by_column = list(zip(*held, strict=True))
            yield pa.record_batch([pa.array(by_column[k], t) for k, t in wanted], self.columns)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: list[str]


def clean(text: str) -> str:
    """Text without the characters that XML can't hold."""
    return re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]", "", text)


@functools.cache
def letters(c: int) -> str:
    out = ""
    while c >= 0:
        out, c = chr(65 + c % 26) + out, c // 26 - 1
    return out


def write_book(stream: BinaryIO, cells: Iterator[tuple[str, int, int, int, str]]) -> None:
    """A workbook from sheet, place, row, column and text, sorted. Parts are numbered downwards; only the relations tell which sheet is which."""
    sheets: list[tuple[str, int]] = []
    with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as z:
        now, out, row = None, None, None
        said: list[str] = []

        def put() -> None:
            out.write("".join(said).encode())
            said.clear()

        def close() -> None:
            said.append("</row></sheetData></worksheet>")
            put()
            out.close()

        for sheet, place, r, c, v in cells:
            if place != now:
                if out:
                    close()
                now, row = place, None
                sheets.append((sheet, place))
                out = z.open(f"xl/worksheets/sheet{9999 - place}.xml", "w", force_zip64=True)
                said.append(f'<worksheet xmlns="{MAIN}"><sheetData>')
            if r != row:
                said.append(f'{"" if row is None else "</row>"}<row r="{r + 1}">')
                row = r
            # what XML can't hold is not printable
            said.append(f'<c r="{letters(c)}{r + 1}" t="inlineStr"><is><t xml:space="preserve">{escape(v if v.isprintable() else clean(v))}</t></is></c>')
            if len(said) >= CELLS:
                put()
        if out:
            close()
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets>' + "".join(f'<sheet name={quoteattr(clean(s))} sheetId="{n + 1}" r:id="r{p}"/>' for n, (s, p) in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}">' + "".join(f'<Relationship Id="r{p}" Type="{RELATIONS}/worksheet" Target="worksheets/sheet{9999 - p}.xml"/>' for _, p in sheets) + "</Relationships>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="{PACKAGE}"><Relationship Id="r1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("[Content_Types].xml", f'<Types xmlns="{TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{BOOK_TYPE}"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{9999 - p}.xml" ContentType="{SHEET_TYPE}"/>' for _, p in sheets) + "</Types>")


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, columns: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite = path, columns, overwrite
        self.folder = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, at = store_of(self.path)
        # a task that is tried again writes to a folder of its own
        folder, files = f"{at}/{self.folder}/{uuid.uuid4().hex}", []
        store.create_dir(folder)
        by_rows = "c" not in self.columns
        kinds = _ROW_KINDS if by_rows else _KINDS
        places = [self.columns.index(c) for c in kinds]
        every = itertools.chain.from_iterable(zip(*(b.column(k).to_pylist() for k in places), strict=True) for b in iterator)
        for name, row in itertools.groupby(every, lambda x: x[0]):
            if by_rows:
                cells = ((sheet or "", place, r, c, v) for _, sheet, place, r, texts in row for c, v in enumerate(texts or []) if v)
            else:
                cells = ((sheet or "", place, r, c, v or "") for _, sheet, place, r, c, v in row)
            files.append(f"{quote(name or '', safe=' ')}.xlsx")
            with store.open_output_stream(f"{folder}/{files[-1]}") as out:
                write_book(out, cells)
        return Written(folder, files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, at = store_of(self.path)
        if self.overwrite:
            for path, _ in _listed(self.path):
                store.delete_file(path)
        for m in messages:
            for name in m.files if m else []:
                store.move(f"{m.folder}/{name}", f"{at}/{name}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, at = store_of(self.path)
        if store.get_file_info(f"{at}/{self.folder}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/{self.folder}")


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    @property
    def by_rows(self) -> bool:
        return str(self.options.get("rows", "")).lower() == "true"

    def schema(self) -> str:
        return ROWS if self.by_rows else SCHEMA

    def reader(self, schema) -> _Reader:
        kinds = _ROW_KINDS if self.by_rows else _KINDS
        unknown = [c for c in schema.fieldNames() if c not in kinds]
        if unknown:
            raise ValueError(f"a workbook has no columns {unknown}; it has {list(kinds)}")
        return _Reader(self.options["path"], schema.fieldNames(), self.by_rows)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema.fieldNames(), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters on sheets reach it; once is enough."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkbookSource)


def read(spark: SparkSession, path: str, by_rows: bool = False) -> DataFrame:
    """The cells of all sheets, or their rows."""
    register(spark)
    return spark.read.format("workbook").option("rows", by_rows).load(path)


def sheets_together(cells: DataFrame, parts: int | None = None, dealt: bool = False) -> DataFrame:
    """cells, or rows, as the writer wants them. The number of tasks does not go by bytes, as a cell costs far more than its few ones. dealt: all rows of a file lie in one partition already."""
    spark = cells.sparkSession
    parts = parts or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not dealt:
        cells = cells.repartition(parts, "file")
    numbers = [c for c in ("place", "r", "c") if c in cells.columns]
    return cells.select("file", "sheet", *[F.col(c).cast("int").alias(c) for c in numbers], F.col("v").cast("string" if "c" in numbers else "array<string>").alias("v")).sortWithinPartitions("file", *numbers)


def write(cells: DataFrame, path: str, parts: int | None = None, dealt: bool = False) -> None:
    register(cells.sparkSession)
    sheets_together(cells, parts, dealt).write.format("workbook").mode("append").save(path)


def named_place(words: list[str]) -> Column:
    """Of each cell the place of its book's first sheet, in the book's order, whose name holds one of the words; null without any."""
    named = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("sheet"), w))
    return F.min(F.when(named, F.col("place"))).over(Window.partitionBy("file"))


#: Words in the names of an item's sheet and of its sites' sheet.
ITEM_SHEET, SITE_SHEET = ["fiche", "article"], ["site", "stock"]


def marked_sheets(cells: DataFrame) -> DataFrame:
    """Cells with is_item and is_site: whether they are of the item's sheet (the book's first where none has such a name) and of its sites' sheet, which is no sheet of that name if it is the item's own. Windows over a book, so that the books are read once."""
    first = F.min("place").over(Window.partitionBy("file"))
    placed = cells.withColumns({"_item": F.coalesce(named_place(ITEM_SHEET), first), "_site": named_place(SITE_SHEET)})
    is_site = F.coalesce((F.col("place") == F.col("_site")) & (F.col("_site") != F.col("_item")), F.lit(False))
    return placed.withColumns({"is_item": F.col("place") == F.col("_item"), "is_site": is_site}).drop("_item", "_site")


def item_book(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cells of the item's sheet and those of its sites' sheet."""
    marked = marked_sheets(cells)
    return tuple(marked.where(c).drop("is_item", "is_site") for c in ("is_item", "is_site"))


def cells_of_content(files: DataFrame) -> DataFrame:
    """(file, sheet, place, r, c, v) of workbooks whose bytes Spark has read already (path, content), from any store that Spark reads."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                held: list[tuple] = []
                for row in rows(io.BytesIO(content.as_py() or b"")):
                    held.append((path.as_py(), *row))
                    if len(held) == BATCH:
                        yield pa.record_batch([pa.array([h[k] for h in held], t) for k, t in enumerate(_KINDS.values())], list(_KINDS))
                        held = []
                yield pa.record_batch([pa.array([h[k] for h in held], t) for k, t in enumerate(_KINDS.values())], list(_KINDS))

    return files.select("path", "content").mapInArrow(work, SCHEMA)
