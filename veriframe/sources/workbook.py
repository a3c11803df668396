"""Spreadsheet cells as rows: spark.read binaryFile, then one workbook at a time in Python.

.xlsx is read with the standard library. .xls needs the optional package xlrd; without it the file's
error row says so. A broken file gives an error row, not a failed job.
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
COLUMNS = ("file", "sheet", "sheet_no", "r", "c", "kind", "v_str", "v_num", "v_ts", "is_bold", "has_fill", "has_top_border", "indent", "r2", "c2", "error")
SCHEMA = (
    "file string, sheet string, sheet_no int, r int, c int, kind string, v_str string, v_num double, v_ts timestamp_ntz, is_bold boolean, "
    "has_fill boolean, has_top_border boolean, indent int, r2 int, c2 int, error string"
)
#: Built-in number formats that show a date.
DATE_FORMATS = {*range(14, 18), 22, *range(27, 37), *range(50, 59)}


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def _place(ref: str) -> tuple[int, int]:
    m = re.match(r"([A-Z]+)(\d+)$", ref)
    return int(m[2]), column_number(m[1])


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{{{NS['m']}}}t"))


class Workbook:
    """The parts of an .xlsx file that matter here."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        book = ET.fromstring(self.zip.read("xl/workbook.xml"))
        rels = ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))
        target = {r.get("Id"): r.get("Target") for r in rels}
        self.epoch = dt.datetime(1904, 1, 1) if (p := book.find("m:workbookPr", NS)) is not None and p.get("date1904") in ("1", "true") else dt.datetime(1899, 12, 30)
        self.sheets = {s.get("name"): posixpath.normpath(posixpath.join("xl", target[s.get(REL)]) if not target[s.get(REL)].startswith("/") else target[s.get(REL)][1:]) for s in book.findall("m:sheets/m:sheet", NS)}

    def _part(self, name: str):
        return ET.fromstring(self.zip.read(name)) if name in self.zip.namelist() else None

    def _styles(self) -> list[tuple[bool, bool, bool, int, bool]]:
        """(bold, fill, top border, indent, date) of each cell format."""
        root = self._part("xl/styles.xml")
        if root is None:
            return []
        on = lambda e: e is not None and e.get("val", "1") not in ("0", "false")
        bold = [on(f.find("m:b", NS)) for f in root.findall("m:fonts/m:font", NS)]
        fill = [(p := f.find("m:patternFill", NS)) is not None and p.get("patternType", "none") not in ("none",) for f in root.findall("m:fills/m:fill", NS)]
        top = [(t := b.find("m:top", NS)) is not None and t.get("style") is not None for b in root.findall("m:borders/m:border", NS)]
        own = {int(n.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", n.get("formatCode", "")) for n in root.findall("m:numFmts/m:numFmt", NS)}
        out = []
        for x in root.findall("m:cellXfs/m:xf", NS):
            at = lambda name, known: known[int(x.get(name, 0))] if int(x.get(name, 0)) < len(known) else False  # noqa: B023, E731
            fmt, align = int(x.get("numFmtId", 0)), x.find("m:alignment", NS)
            date = fmt in DATE_FORMATS or bool(re.search("[ymd]", own.get(fmt, "").lower()))
            out.append((at("fontId", bold), at("fillId", fill), at("borderId", top), int(align.get("indent", 0)) if align is not None else 0, date))
        return out

    def cells(self, sheet: str) -> Iterator[dict]:
        """Cells with a value, and merged ranges as rows of kind `merge`."""
        styles = self._styles()
        shared = [_text(si) for si in root.findall("m:si", NS)] if (root := self._part("xl/sharedStrings.xml")) is not None else []
        ws = ET.fromstring(self.zip.read(self.sheets[sheet]))
        for c in ws.iter(f"{{{NS['m']}}}c"):
            kind, value = c.get("t", "n"), c.find("m:v", NS)
            style = styles[int(c.get("s", 0))] if int(c.get("s", 0)) < len(styles) else (False, False, False, 0, False)
            row = dict(zip(("r", "c"), _place(c.get("r")))) | dict(zip(("is_bold", "has_fill", "has_top_border", "indent"), style))
            if kind == "inlineStr":
                row |= {"kind": "str", "v_str": _text(c)}
            elif value is None or value.text is None:
                continue
            elif kind == "s":
                row |= {"kind": "str", "v_str": shared[int(value.text)]}
            elif kind == "b":
                row |= {"kind": "bool", "v_num": float(value.text)}
            elif kind in ("str", "e"):
                row |= {"kind": "str", "v_str": value.text}
            elif kind == "d" or style[4]:
                when = dt.datetime.fromisoformat(value.text) if kind == "d" else self.epoch + dt.timedelta(days=float(value.text))
                row |= {"kind": "date", "v_ts": when.replace(microsecond=0)}
            else:
                row |= {"kind": "num", "v_num": float(value.text)}
            yield row
        for m in ws.iter(f"{{{NS['m']}}}mergeCell"):
            (r, c), (r2, c2) = map(_place, m.get("ref").split(":"))
            yield {"r": r, "c": c, "r2": r2, "c2": c2, "kind": "merge"}


def _xls_cells(data: bytes) -> Iterator[tuple[str, int, dict]]:
    try:
        import xlrd
    except ImportError:
        raise ValueError("reading .xls needs the optional package xlrd") from None
    book = xlrd.open_workbook(file_contents=data)
    for n, ws in enumerate(book.sheets()):
        for r in range(ws.nrows):
            for c in range(ws.ncols):
                kind, v = ws.cell_type(r, c), ws.cell_value(r, c)
                row = {"r": r + 1, "c": c + 1}
                if kind == 1 and v != "":
                    yield ws.name, n, row | {"kind": "str", "v_str": v}
                elif kind == 2:
                    yield ws.name, n, row | {"kind": "num", "v_num": float(v)}
                elif kind == 3:
                    yield ws.name, n, row | {"kind": "date", "v_ts": xlrd.xldate_as_datetime(v, book.datemode)}
                elif kind == 4:
                    yield ws.name, n, row | {"kind": "bool", "v_num": float(v)}


def workbook_rows(file: str, data: bytes, list_only: bool = False) -> list[dict]:
    """Rows of all sheets of a workbook, or one row a sheet, or one error row."""
    try:
        if data[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
            return [{"file": file, "sheet": s, "sheet_no": n, **row} for s, n, row in _xls_cells(data)]
        if data[:4] != b"PK\x03\x04":
            raise ValueError("neither an .xlsx nor an .xls file")
        book = Workbook(data)
        if list_only:
            return [{"file": file, "sheet": s, "sheet_no": n} for n, s in enumerate(book.sheets)]
        return [{"file": file, "sheet": s, "sheet_no": n, **row} for n, s in enumerate(book.sheets) for row in book.cells(s)]
    except Exception as e:
        return [{"file": file, "kind": "error", "error": f"{type(e).__name__}: {e}"}]


_TYPES = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "timestamp_ntz": pa.timestamp("us")}
_ARROW = pa.schema([(n, _TYPES[t]) for n, t in (f.split() for f in SCHEMA.split(", "))])


def _parser(list_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in COLUMNS} for r in workbook_rows(name, data, list_only)], _ARROW)

    return run


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """All cells, merges and error rows of the workbooks under path (schema SCHEMA)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_parser(False), SCHEMA)


def list_sheets(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, sheet_no, error) of the workbooks under path; only names are read."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_parser(True), SCHEMA).select("file", "sheet", "sheet_no", "error").distinct()


def cells_from_rows(spark: SparkSession, grids: list[tuple[str, str, list[list]]]) -> DataFrame:
    """Cells of small grids given as Python lists: (file, sheet, rows)."""
    rows = []
    for n, (file, sheet, grid) in enumerate(grids):
        for r, line in enumerate(grid, 1):
            for c, v in enumerate(line, 1):
                base = {"source_ord": n, "file": file, "sheet": sheet, "r": r, "c": c, "is_bold": False, "has_fill": False, "has_top_border": False, "indent": 0}
                if isinstance(v, tuple):  # (value, style)
                    v, style = v
                    base |= style
                if isinstance(v, bool):
                    rows.append(base | {"kind": "bool", "v_num": float(v)})
                elif isinstance(v, (int, float)):
                    rows.append(base | {"kind": "num", "v_num": float(v)})
                elif isinstance(v, (dt.date, dt.datetime)):
                    rows.append(base | {"kind": "date", "v_ts": dt.datetime(v.year, v.month, v.day)})
                elif v is not None:
                    rows.append(base | {"kind": "str", "v_str": v})
    from ..schemas import CELLS

    return spark.createDataFrame([tuple(r.get(f.name) for f in CELLS) for r in rows], CELLS)


def number_sources(rows: DataFrame, sheets: str | None = None) -> DataFrame:
    """Cells with source_ord by file and sheet order. sheets: names, one a file (the last goes on), default all.

    A file without the wanted sheet is a ValueError that lists its sheets. The driver sees names of files and sheets only.
    """
    cells = rows.where("kind <> 'error'")
    names = [s.strip() for s in (sheets or "").split(",") if s.strip()]
    keys = [(r["file"], r["sheet_no"], r["sheet"]) for r in cells.select("file", "sheet_no", "sheet").distinct().orderBy("file", "sheet_no").collect()]
    if names:
        files = sorted({f for f, _, _ in keys})
        wanted = {f: names[min(i, len(names) - 1)] for i, f in enumerate(files)}
        for f, name in wanted.items():
            there = [s for g, _, s in keys if g == f]
            if name not in there:
                raise ValueError(f"{f} has no sheet {name!r}; its sheets: {', '.join(there)}")
        keys = [(f, n, s) for f, n, s in keys if wanted[f] == s]
    order = cells.sparkSession.createDataFrame([(f, s, i) for i, (f, _, s) in enumerate(keys)], "file string, sheet string, source_ord int")
    return cells.join(order, ["file", "sheet"])


def propagate_merges(cells: DataFrame) -> DataFrame:
    """Cells with the anchor of each merged range copied over the range."""
    from ..schemas import CELLS

    names = [f.name for f in CELLS]
    plain = cells.where("kind <> 'merge'").select(*names)
    ranges = cells.where("kind = 'merge'").select("source_ord", F.col("r").alias("r0"), F.col("c").alias("c0"), F.explode(F.sequence("r", "r2")).alias("r"), "c", "c2")
    spread = ranges.select("source_ord", "r0", "c0", "r", F.explode(F.sequence("c", "c2")).alias("c"))
    anchors = plain.withColumnsRenamed({"r": "r0", "c": "c0"})
    copies = spread.join(anchors, ["source_ord", "r0", "c0"]).select(*names)
    return plain.join(spread.select("source_ord", "r", "c"), ["source_ord", "r", "c"], "left_anti").select(*names).unionByName(copies)
