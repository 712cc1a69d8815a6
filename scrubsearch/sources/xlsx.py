"""S1/S3/S4 for workbooks: ``.xlsx`` files -> ticket rows, plus an error table.

Spark lists and reads the files (``binaryFile``, one row per file, glob
filter, Excel lock files ``~$*`` skipped); each file is decoded inside a
``mapInPandas`` task with the standard library (zip + XML), first sheet,
first row as header; the sheet is parsed as a stream. A file that cannot be
decoded yields one error row and none of its rows, and the other files continue
(S4). No file ever passes through the driver.
"""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from itertools import count, islice
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubsearch.session import small_batches

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
ROWS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("row_no", T.LongType()),
    T.StructField("cells", T.ArrayType(T.StringType())),
    T.StructField("header", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
])


ROWS_AT_ONCE = 2_000

# Fixed: number formats of the file format that show a date, and those that show a time.
DATE_FORMATS = {14, 15, 16, 17, 22, *range(27, 32), 36, *range(50, 59)}
TIME_FORMATS = {18, 19, 20, 21, 22, *range(32, 36), 45, 46, 47}
_QUOTED = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]')


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _elements(book: zipfile.ZipFile, name: str, tag: str):
    """The elements ``tag`` of a part, one at a time; what has been read is let go of."""
    with book.open(name) as part:
        above = None
        for event, e in ET.iterparse(part, ("start", "end")):
            if event == "start":
                above = e if above is None else above
            elif e.tag.rsplit("}", 1)[-1] == tag:
                yield e
                e.clear()
                above.clear()


def _date_styles(book: zipfile.ZipFile) -> dict[int, tuple[bool, bool]]:
    """Cell style -> (shows a date, shows a time), of those that show one."""
    if "xl/styles.xml" not in book.namelist():
        return {}
    root = ET.fromstring(book.read("xl/styles.xml"))
    kinds = {n: (n in DATE_FORMATS, n in TIME_FORMATS) for n in DATE_FORMATS | TIME_FORMATS}
    for f in root.iterfind(".//m:numFmt", NS):
        code = _QUOTED.sub("", f.get("formatCode", "")).lower()
        day = "y" in code or "d" in code
        kinds[int(f.get("numFmtId"))] = (day, "h" in code or "s" in code)
    found = {i: kinds.get(int(x.get("numFmtId", 0)), (False, False)) for i, x in enumerate(root.iterfind(".//m:cellXfs/m:xf", NS))}
    return {i: k for i, k in found.items() if any(k)}


def _date_text(number: float, day: bool, clock: bool, from_1904: bool) -> str:
    """A serial day number as ``2024-01-31``, ``2024-01-31 08:30:00`` or ``08:30:00``."""
    days = number + (1462 if from_1904 else 0)
    days += day and days < 60  # the calendar counts a 29 February 1900
    at = datetime(1899, 12, 30) + timedelta(seconds=round(days * 86400))
    return at.strftime("%Y-%m-%d %H:%M:%S" if day and clock else "%Y-%m-%d" if day else "%H:%M:%S")


def _cell_text(c, shared: list[str], dates: dict[int, tuple[bool, bool]], from_1904: bool):
    t = c.get("t")
    if t == "inlineStr":
        return "".join(x.text or "" for x in c.iter(f"{{{NS['m']}}}t"))
    v = c.find("m:v", NS)
    if v is None or v.text is None:
        return None
    if t == "s":
        return shared[int(v.text)]
    if t == "b":
        return "True" if v.text == "1" else "False"
    if t is None or t == "n":
        x = float(v.text)
        if (shown := dates.get(int(c.get("s", 0)))) is not None:
            return _date_text(x, *shown, from_1904)
        return str(int(x)) if x.is_integer() and "." not in v.text and "E" not in v.text.upper() else str(x)
    return v.text


def _first_sheet(book: zipfile.ZipFile) -> tuple[str, bool]:
    """The part of the workbook's first sheet, and whether its days count from 1904."""
    root = ET.fromstring(book.read("xl/workbook.xml"))
    days = root.find("m:workbookPr", NS)
    from_1904 = days is not None and days.get("date1904") in ("1", "true")
    sheet = root.find(".//m:sheet", NS)
    rid = next((v for k, v in sheet.attrib.items() if k.endswith("}id")), None)
    links = ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(x.get("Target") for x in links if x.get("Id") == rid)
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}", from_1904


def sheet_rows(data: bytes):
    """The header, then each row, of a workbook's first sheet; missing cells -> None.

    The sheet is read as a stream: beside the packed file only one row and the
    table of shared texts are in memory. Cells with a date format are dates."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{NS['m']}}}t"))
                      for si in _elements(book, "xl/sharedStrings.xml", "si")]
        dates = _date_styles(book)
        name, from_1904 = _first_sheet(book)
        width = None
        for r in _elements(book, name, "row"):
            cells: dict[int, str | None] = {}
            for i, c in enumerate(r.findall("m:c", NS)):
                cells[_col_index(c.get("r")) if c.get("r") else i] = _cell_text(c, shared, dates, from_1904)
            row = [cells.get(i) for i in range(max(cells, default=-1) + 1)]
            if width is None:
                width = len(row)
                yield [h if h is not None else f"Unnamed: {i}" for i, h in enumerate(row)]
            else:
                yield (row + [None] * width)[:width]


def read_sheet(data: bytes) -> tuple[list[str], list[list[str | None]]]:
    """``sheet_rows`` as a whole: (header, rows)."""
    header, *rows = [*sheet_rows(data)] or [[]]
    return header, rows


def _decode(batches):
    """Rows of each file in runs of ROWS_AT_ONCE; a file that breaks off adds one row with its error."""
    names = ["path", "row_no", "cells", "header", "error"]
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                rows = sheet_rows(bytes(content))
                header = next(rows, [])
                for at in count(0, ROWS_AT_ONCE):
                    run = list(islice(rows, ROWS_AT_ONCE))
                    if not run:
                        break
                    yield pd.DataFrame([(path, at + i, row, header, None) for i, row in enumerate(run)], columns=names)
            except Exception as exc:  # S4: report the file, keep going
                yield pd.DataFrame([(path, None, None, None, f"{type(exc).__name__}: {exc}")], columns=names)


def read_workbooks(spark: SparkSession, folder: str, glob: str = "*.xlsx") -> tuple[DataFrame, DataFrame]:
    """S1 + S3 + S4: (rows (source, row_no, text), errors (path, error)).

    ``text`` is every cell of the row cast to text (missing -> 'nan'),
    joined with one space (P1). ``source`` is the file name."""
    small_batches(spark)
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
             .where(~F.element_at(F.split("path", "/"), -1).startswith("~$"))
             .select("path", "content"))
    decoded = files.repartition(F.col("path")).mapInPandas(_decode, ROWS)
    errors = decoded.where(F.col("error").isNotNull()).select("path", "error")
    # rows that a file gave before it broke off are not rows of the table
    ok = decoded.where(F.col("error").isNull()).join(errors.select("path"), "path", "left_anti")
    rows = ok.select(F.element_at(F.split("path", "/"), -1).alias("source"), "row_no",
                     F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit("nan"))), " ").alias("text"))
    return rows, errors


# ---------------------------------------------------------------------------
# Writing (used to derive workbook fixtures from the driver tables)
# ---------------------------------------------------------------------------

def _xml_escape(s: str) -> str:
    return (s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
            .replace('"', "&quot;"))


def _col_name(i: int) -> str:
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def write_workbook(target, header: list[str], rows) -> None:
    """A minimal one-sheet workbook with inline strings; ``rows`` are streamed into ``target``."""
    def row_xml(r: int, values) -> str:
        cells = "".join(
            f'<c r="{_col_name(i)}{r}" t="inlineStr"><is><t xml:space="preserve">{_xml_escape(v)}</t></is></c>'
            for i, v in enumerate(values) if v is not None)
        return f'<row r="{r}">{cells}</row>'

    files = {
        "[Content_Types].xml": (
            '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
            '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            '<Default Extension="xml" ContentType="application/xml"/>'
            '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
            '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
            "</Types>"),
        "_rels/.rels": (
            '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/>'
            "</Relationships>"),
        "xl/workbook.xml": (
            f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{NS["m"]}" '
            'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
            '<sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>'),
        "xl/_rels/workbook.xml.rels": (
            '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/>'
            "</Relationships>"),
    }
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(name, body)
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
            sheet.write(('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
                         f'<worksheet xmlns="{NS["m"]}"><sheetData>' + row_xml(1, header)).encode())
            for i, r in enumerate(rows):
                sheet.write(row_xml(i + 2, r).encode())
            sheet.write(b"</sheetData></worksheet>")


def workbook_bytes(header: list[str], rows: list[list[str | None]]) -> bytes:
    """``write_workbook`` in memory."""
    buf = io.BytesIO()
    write_workbook(buf, header, rows)
    return buf.getvalue()


def _broken(data: bytes, how: str | None) -> bytes:
    """A workbook as it may arrive: cut short, no workbook at all, or with a sheet that breaks off."""
    if how == "cut":
        return data[:len(data) // 2]
    if how == "text":
        return b"not a workbook"
    if how == "sheet":
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
            for name in old.namelist():
                body = old.read(name)
                new.writestr(name, body[:len(body) * 2 // 3] if "worksheets" in name else body)
        return out.getvalue()
    return data


def write_numbered(df: DataFrame, columns: list[str], number: str, order: str, folder: str, broken: dict[int, str] = {}) -> None:
    """A workbook ``tickets-<number>.xlsx`` for the rows of each ``number``, a bounded run of them; ``broken`` says how
    the files of a number modulo 5 are spoilt. Written through Spark's file systems."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["_number"].iloc[0])
        rows = pdf.sort_values("_order")[columns].astype(object)
        data = workbook_bytes(columns, rows.where(rows.notna(), None).values.tolist())
        return pd.DataFrame({"name": [f"tickets-{n:06d}.xlsx"], "content": [_broken(data, broken.get(n % 5))]})

    cols = [F.col(c).cast("string").alias(c) for c in columns]
    books = df.select(F.col(number).alias("_number"), F.col(order).alias("_order"), *cols).groupBy("_number").applyInPandas(
        build, "name string, content binary")
    write_files(books, folder)


def write_files(files: DataFrame, folder: str) -> None:
    """Each row (name, content) as a file of ``folder``, which is a path of the executors' default file systems.

    A local or mounted folder is written directly; any other through pyarrow's file system for its scheme."""
    def put(batches):
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        where.create_dir(root, recursive=True)
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"]):
                with where.open_output_stream(f"{root}/{name}") as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"name": pdf["name"]})

    small_batches(files.sparkSession)
    files.mapInPandas(put, "name string").count()


ROWS_PER_FILE = 10_000


def write_workbooks(df: DataFrame, columns: list[str], folder: str, files: int = 8,
                    rows_per_file: int = ROWS_PER_FILE) -> None:
    """Workbooks of at most ``rows_per_file`` rows of ``df``, at least about
    ``files`` of them (all ``columns`` cast to text), written by the executors
    into ``folder`` (a shared path). Their number grows with the table."""
    cols = [F.col(c).cast("string").alias(c) for c in columns]
    def build(batches):
        import itertools
        import uuid
        rows = (row for pdf in batches
                for row in pdf[columns].astype(object).where(pdf[columns].notna(), None).values.tolist())
        for first in rows:
            data = workbook_bytes(columns, itertools.chain([first], itertools.islice(rows, rows_per_file - 1)))
            yield pd.DataFrame({"name": [f"tickets-{uuid.uuid4().hex}.xlsx"], "content": [data]})

    parts = max(files, -(-df.count() // rows_per_file))
    write_files(df.select(*cols).repartition(parts).mapInPandas(build, "name string, content binary"), folder)
