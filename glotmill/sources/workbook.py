"""Spreadsheet workbooks (.xlsx) as a Spark data source: a sheet is a partition when read, a task a workbook when written.

A sheet's XML is streamed out of the zip file, so a task holds one batch of rows and the workbook's table of shared
strings. Files are opened by ``pyarrow.fs`` on the executors (local or mounted paths, object stores, HDFS where its client
library is installed); the driver only lists files, sheets and headings.

What a cell gives: text as it is (an empty one stays empty, which is not null), numbers as they are written, booleans,
and null for a cell without a value or with an error. Dates are numbers in this format, and stay so. Rows without any
value are left out. Texts are written whole, also beyond the 32,767 characters that desktop programs show.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "workbook"
# Limits of the format, and its names.
MAX_ROWS = 1_048_576
MAX_NAME = 31
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Rows and characters of a batch that a reading task hands on; bytes of a sheet's XML before a writing task starts a new workbook.
BATCH_ROWS, BATCH_CHARS, SHEET_BYTES = 4096, 1 << 22, 1 << 30

_ILLEGAL = re.compile("[\x00-\x08\x0b-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")
_ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if re.match("[A-Za-z][A-Za-z0-9+.-]+:", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub("^file:(//)?", "", path)


def exists(path: str) -> bool:
    system, at = opened(path)
    return system.get_file_info(at).type != fs.FileType.NotFound


def _inside(at: str, target: str) -> str:
    """A part's name in the zip file, from a link in the folder ``at``."""
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(at, target))


def _text(element: ElementTree.Element) -> str:
    """All runs of a text, but for the phonetic ones."""
    runs = [element, *element.findall(f"{MAIN}r")]
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(t.text or "" for r in runs for t in r.findall(f"{MAIN}t")))


def sheet_parts(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheets by name, in their order, with the part that holds their rows."""
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = {e.get("Id"): _inside("xl", e.get("Target")) for e in links}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    return {s.get("name"): target[s.get(LINK)] for s in sheets if "worksheet" in target[s.get(LINK)]}


def _streamed(book: zipfile.ZipFile, part: str, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of one kind, each released after use."""
    with book.open(part) as f:
        events = ElementTree.iterparse(f, events=("start", "end"))
        parents = []
        for event, e in events:
            if event == "start":
                parents.append(e)
                continue
            parents.pop()
            if e.tag == MAIN + tag:
                yield e
                parents[-1].clear()


def _shared(book: zipfile.ZipFile) -> Iterator[str]:
    if "xl/sharedStrings.xml" in book.namelist():
        yield from map(_text, _streamed(book, "xl/sharedStrings.xml", "si"))


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _cell(cell: ElementTree.Element, shared: list[str]) -> tuple[str, str] | None:
    """Kind (i: whole number, n: number, b: boolean, s: text) and value."""
    kind, value = cell.get("t", "n"), cell.find(f"{MAIN}v")
    if kind == "inlineStr":
        inline = cell.find(f"{MAIN}is")
        return None if inline is None else ("s", _text(inline))
    if kind == "e" or value is None or value.text is None:
        return ("s", "") if kind == "str" and value is not None else None
    if kind == "s":
        return "s", shared[int(value.text)]
    if kind == "b":
        return "b", "true" if value.text.strip() in ("1", "true") else "false"
    if kind == "n":
        number = value.text.strip()
        whole = re.fullmatch("-?[0-9]{1,19}", number) and -(1 << 63) <= int(number) < 1 << 63
        return ("i" if whole else "n"), number
    return "s", _ESCAPED.sub(lambda m: chr(int(m[1], 16)), value.text)


def row_cells(row: ElementTree.Element, shared: list[str]) -> dict[int, tuple[str, str]]:
    """Cells by column number; one without a reference follows the one before it."""
    cells, at = {}, -1
    for c in row.findall(f"{MAIN}c"):
        at = _column(c.get("r")) if c.get("r") else at + 1
        if (found := _cell(c, shared)) is not None:
            cells[at] = found
    return cells


def headings(first: dict[int, tuple[str, str]]) -> dict[str, int]:
    """Column numbers by name: empty names are ``Unnamed: n``, a repeated one (whatever its case) gets ``.1``, ``.2``."""
    names: dict[str, int] = {}
    taken = {"_sheet"}
    for at in range(max(first, default=-1) + 1):
        plain = (first[at][1].strip() if at in first else "") or f"Unnamed: {at}"
        name, n = plain, 0
        while name.lower() in taken:
            n += 1
            name = f"{plain}.{n}"
        taken.add(name.lower())
        names[name] = at
    return names


@dataclass
class Sheet:
    """A sheet of a workbook with the numbers of its columns."""

    path: str
    name: str
    part: str
    columns: dict[str, int]


def find_workbooks(path: str) -> list[str]:
    """The workbook of that name, or all in that folder, by name."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    inside = system.get_file_info(fs.FileSelector(at, recursive=True))
    prefix = path.rstrip("/")
    names = sorted(i.path[len(at.rstrip("/")) + 1 :] for i in inside if i.type == fs.FileType.File and i.path.endswith(".xlsx"))
    return [f"{prefix}/{n}" for n in names if not any(p.startswith(("_", ".", "~")) for p in n.split("/"))]


def find_sheets(path: str) -> list[Sheet]:
    """All sheets of one workbook; of their rows only the first with a value is read, of shared strings what it needs."""
    system, at = opened(path)
    found = []
    with system.open_input_file(at) as f, zipfile.ZipFile(f) as book:
        for name, part in sheet_parts(book).items():
            first: dict[int, tuple[str, str]] = {}
            for row in _streamed(book, part, "row"):
                wanted = [int(v.text) for c in row.findall(f"{MAIN}c") if c.get("t") == "s" and (v := c.find(f"{MAIN}v")) is not None and v.text]
                if first := row_cells(row, list(islice(_shared(book), max(wanted) + 1)) if wanted else []):
                    break
            found.append(Sheet(path, name, part, headings(first)))
    return found


@dataclass
class SheetPartition(InputPartition):
    sheet: Sheet


class WorkbookReader(DataSourceReader):
    def __init__(self, sheets: list[Sheet], schema: StructType, kinds: bool) -> None:
        self.sheets, self.schema, self.kinds = sheets, schema, kinds

    def partitions(self) -> list[SheetPartition]:
        return [SheetPartition(s) for s in self.sheets]

    def read(self, partition: SheetPartition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        sheet, schema = partition.sheet, to_arrow_schema(self.schema)
        values: list[list] = [[] for _ in schema]
        takes = [sheet.columns.get(f.name) for f in schema]
        convert = [_CONVERT.get(str(f.type), str) if not self.kinds else str for f in schema]
        n_rows = n_chars = 0
        system, at = opened(sheet.path)
        with system.open_input_file(at) as f, zipfile.ZipFile(f) as book:
            shared = list(_shared(book))
            rows = filter(None, (row_cells(row, shared) for row in _streamed(book, sheet.part, "row")))
            next(rows, None)  # the headings
            for cells in rows:
                for name, column, take, to in zip(schema.names, values, takes, convert):
                    cell = cells.get(take) if take is not None else None
                    column.append(sheet.name if name == "_sheet" else None if cell is None else cell[0] if self.kinds else to(cell[1]))
                n_rows += 1
                n_chars += sum(len(c[1]) for c in cells.values())
                if n_rows >= BATCH_ROWS or n_chars >= BATCH_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)
                    values, n_rows, n_chars = [[] for _ in schema], 0, 0
        if n_rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)


_CONVERT = {"int64": int, "double": float, "bool": lambda v: v == "true"}


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Book:
    """One workbook being written, sheet after sheet."""

    def __init__(self, stream) -> None:
        self.stream, self.zip, self.names, self.sheet = stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED, compresslevel=4), [], None

    def start(self, name: str, header: list[str]) -> None:
        self.end()
        self.names.append(name)
        self.sheet = self.zip.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w")
        self.rows = self.bytes = 0
        self.put(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{MAIN[1:-1]}"><sheetData>')
        self.row([("s", h) for h in header])

    def put(self, xml: str) -> None:
        data = xml.encode()
        self.bytes += len(data)
        self.sheet.write(data)

    def row(self, cells: list[tuple[str, str | None]]) -> None:
        self.rows += 1
        self.put(f'<row r="{self.rows}">{"".join(_written(i, self.rows, k, v) for i, (k, v) in enumerate(cells) if v is not None)}</row>')

    def full(self) -> bool:
        return self.rows >= MAX_ROWS or self.bytes >= SHEET_BYTES

    def end(self) -> None:
        if self.sheet is not None:
            self.put("</sheetData></worksheet>")
            self.sheet.close()
            self.sheet = None

    def close(self) -> None:
        self.end()
        n = range(1, len(self.names) + 1)
        package, office = "http://schemas.openxmlformats.org/package/2006", LINK[1:-3]
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        top = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
        parts = {
            "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>'
            + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in n) + "</Types>",
            "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{_escaped(s)}" sheetId="{i}" r:id="rId{i}"/>' for i, s in zip(n, self.names)) + "</sheets></workbook>",
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>",
        }
        for name, xml in parts.items():
            self.zip.writestr(name, top + xml)
        self.zip.close()
        self.stream.close()


def _escaped(text: str) -> str:
    out = _ILLEGAL.sub(lambda m: f"_x{ord(m[0]):04X}_", text)
    return out.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _letters(i: int) -> str:
    out, i = "", i + 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _written(i: int, row: int, kind: str, value: str) -> str:
    at = f"{_letters(i)}{row}"
    if kind == "n":
        return f'<c r="{at}"><v>{value}</v></c>'
    if kind == "b":
        return f'<c r="{at}" t="b"><v>{int(value == "true")}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{_escaped(value)}</t></is></c>'


class WorkbookWriter(DataSourceArrowWriter):
    """Takes (sheet, cells) rows whose sheets lie together. A task's workbooks lie aside until the job commits."""

    def __init__(self, path: str, headers: dict[str, list[str]], overwrite: bool, single: bool) -> None:
        self.path, self.headers, self.overwrite, self.single = path.rstrip("/"), headers, overwrite, single
        self.job = uuid.uuid4().hex
        self.aside = f"{self.path}.{self.job}" if single else f"{self.path}/_{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, aside = opened(self.aside)
        system.create_dir(aside, recursive=True)
        files: list[str] = []
        book: _Book | None = None

        def start(sheet: str) -> _Book:
            """The sheet in the open workbook, or in a new one where that has a sheet of this name (whatever its case)."""
            into = book
            if into is not None and sheet.lower() in map(str.lower, into.names):
                if self.single:
                    raise ValueError(f"sheet {sheet} is too long for one workbook, or comes twice")
                into.close()
                into = None
            if into is None:
                files.append(f"part-{self.job[:8]}-{uuid.uuid4().hex}.xlsx")
                into = _Book(system.open_output_stream(f"{aside}/{files[-1]}"))
            into.start(sheet, self.headers[sheet] if sheet in self.headers else self.headers["*"])
            return into

        for batch in iterator:
            for row in batch.to_pylist():
                if book is None or row["sheet"] != book.names[-1] or book.full():
                    book = start(row["sheet"])
                book.row([(c["kind"], c["value"]) for c in row["cells"]])
        if self.single:
            for sheet in self.headers:
                if book is None or sheet not in book.names:
                    book = start(sheet)
        if book is not None:
            book.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """The driver renames what the tasks tell, so that files of lost or repeated attempts never show."""
        system, at = opened(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        if self.single:
            if len(files) > 1:
                raise ValueError("one workbook is written by one task")
            files = files or self.write(iter(())).files  # no rows may mean no task
            system.move(f"{opened(self.aside)[1]}/{files[0]}", at)
        else:
            old = [opened(p)[1] for p in find_workbooks(self.path)] if self.overwrite and system.get_file_info(at).type == fs.FileType.Directory else []
            for f in files:
                system.move(f"{opened(self.aside)[1]}/{f}", f"{at}/{f}")
            for p in old:
                system.delete_file(p)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, aside = opened(self.aside)
        if system.get_file_info(aside).type == fs.FileType.Directory:
            system.delete_dir(aside)


class WorkbookSource(DataSource):
    """Options: ``path``, ``sheets`` (JSON list of those that ``find_sheets`` gave), ``kinds`` (cells as their kinds),
    and for writing ``headers`` (JSON, by sheet), ``single``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _sheets(self) -> list[Sheet]:
        if "sheets" in self.options:
            return [Sheet(**s) for s in json.loads(self.options["sheets"])]
        return [s for p in find_workbooks(self.options["path"]) for s in find_sheets(p)]

    def schema(self) -> StructType:
        names = dict.fromkeys(n for s in self._sheets() for n in s.columns)
        out = StructType().add("_sheet", "string")
        for n in names:
            out = out.add(n, "string")
        return out

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(self._sheets(), schema, self.options.get("kinds") == "true")

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options["path"], json.loads(self.options["headers"]), overwrite, self.options.get("single") == "true")
