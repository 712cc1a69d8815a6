"""Workbooks that others wrote, and the ingest ledger."""

import io
import zipfile

from pyspark.sql import functions as F

from scrubsearch.session import scratch_dir
from scrubsearch.sources import ledger, xlsx

M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def foreign(date1904=False):
    """A workbook as other programs write it: shared texts, styles, sheets out of order, cells without a place."""
    sheet = (f'<worksheet {M}><sheetData>'
             '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="s"><v>2</v></c></row>'
             '<row r="2"><c r="A2" t="s"><v>3</v></c><c r="B2" s="1"><v>45322</v></c><c r="C2" s="2"><v>45322.354166666664</v></c><c r="D2" s="3"><v>0.5</v></c></row>'
             '<row r="3"><c><v>7</v></c><c s="4"><v>59</v></c><c s="5"><v>1.5</v></c><c t="b"><v>1</v></c></row>'
             '<row r="4"><c r="A4"><v></v></c></row></sheetData></worksheet>')
    styles = (f'<styleSheet {M}><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy hh:mm"/>'
              '<numFmt numFmtId="165" formatCode="0.00 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/>'
              '<xf numFmtId="164"/><xf numFmtId="21"/><xf numFmtId="14"/><xf numFmtId="165"/></cellXfs></styleSheet>')
    book = (f'<workbook {M} xmlns:r="{R}"><workbookPr date1904="{int(date1904)}"/><sheets><sheet name="First" sheetId="9" r:id="rId7"/>'
            '<sheet name="Second" sheetId="1" r:id="rId1"/></sheets></workbook>')
    rels = (f'<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/>'
            '<Relationship Id="rId7" Target="/xl/worksheets/sheet10.xml"/></Relationships>')
    texts = f'<sst {M}><si><t>id</t></si><si><r><t>da</t></r><r><t>te</t></r></si><si><t>x</t></si><si><t>IN0000001</t></si></sst>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in (("xl/workbook.xml", book), ("xl/_rels/workbook.xml.rels", rels), ("xl/styles.xml", styles),
                           ("xl/sharedStrings.xml", texts), ("xl/worksheets/sheet10.xml", sheet),
                           ("xl/worksheets/sheet1.xml", f"<worksheet {M}><sheetData/></worksheet>")):
            z.writestr(name, body)
    return out.getvalue()


def test_foreign_workbook():
    header, rows = xlsx.read_sheet(foreign())
    assert header == ["id", "date", "Unnamed: 2", "x"]
    assert rows == [["IN0000001", "2024-01-31", "2024-01-31 08:30:00", "12:00:00"], ["7", "1900-02-28", "1.5", "True"],
                    [None, None, None, None]]
    assert xlsx.read_sheet(foreign(True))[1][0][1] == "2028-02-01"


def test_a_long_sheet_is_a_stream():
    """A hundred thousand rows are read without the tree of the sheet."""
    import tracemalloc

    data = xlsx.workbook_bytes(["a", "b"], ([f"IN{i:07d}", "text of the row"] for i in range(100_000)))
    tracemalloc.start()
    n = sum(1 for _ in xlsx.sheet_rows(data)) - 1
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert n == 100_000 and peak < 30e6


def _put(spark, folder, files):
    xlsx.write_files(spark.createDataFrame(list(files.items()), "name string, content binary"), folder)


def _texts(spark, table):
    return sorted((r.source, r.text) for r in ledger.rows(spark, table).collect())


def _state(df):
    return sorted((r.path.rsplit("/", 1)[-1], r.n_rows, r.error and r.error.split(":")[0]) for r in df.collect())


def test_files_are_taken_in_once(spark):
    folder, table = scratch_dir(spark, "in"), scratch_dir(spark, "table")
    book = lambda *texts: xlsx.workbook_bytes(["t"], [[t] for t in texts])
    good = book("one", "two")
    _put(spark, folder, {"a.xlsx": good, "b.xlsx": good[:60], "~$a.xlsx": b"lock", "c.txt": b"x", "d.xlsx": xlsx._broken(good, "sheet")})
    assert _state(ledger.ingest(spark, folder, table)) == [("a.xlsx", 2, None), ("b.xlsx", 0, "BadZipFile"), ("d.xlsx", 0, "ParseError")]
    assert ledger.ingest(spark, folder, table).count() == 0
    _put(spark, folder, {"b.xlsx": book("three"), "e.xlsx": book(), "a.xlsx": book("one", "new")})  # mended, added, changed
    assert _state(ledger.ingest(spark, folder, table)) == [("a.xlsx", 2, None), ("b.xlsx", 1, None), ("e.xlsx", 0, None)]
    assert _texts(spark, table) == [("a.xlsx", "new"), ("a.xlsx", "one"), ("b.xlsx", "three")]
    assert ledger.ledger(spark, table).where("current AND error IS NOT NULL").count() == 1


def test_a_run_that_is_cut_off_counts_for_nothing(spark):
    folder, table = scratch_dir(spark, "in"), scratch_dir(spark, "table")
    _put(spark, folder, {"a.xlsx": xlsx.workbook_bytes(["t"], [["one"]])})
    lost = spark.createDataFrame([("x/a.xlsx", 0, ["t"], ["lost"])], "path string, row_no long, header array<string>, cells array<string>")
    lost.write.parquet(f"{table}/rows/run=dead")  # rows, and then no ledger entries
    assert ledger.rows(spark, table).count() == 0
    ledger.ingest(spark, folder, table)
    assert _texts(spark, table) == [("a.xlsx", "one")]


def test_empty_folder(spark):
    folder, table = scratch_dir(spark, "in"), scratch_dir(spark, "table")
    _put(spark, folder, {"readme.txt": b"no workbooks"})
    assert ledger.ingest(spark, folder, table).count() == 0 and ledger.rows(spark, table).where(F.lit(True)).count() == 0
