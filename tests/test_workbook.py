"""Workbooks: what is written is read again, workbooks as other programs write them, and runs that fail."""

import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glotmill.sources import workbook
from glotmill.sources.readers import read_excel, read_table
from glotmill.sources.writers import write_report, write_workbooks

ODD = ["", " a ", "line\nfeed\r\n", "\x00\x08\x1f", "_x0041_", "_x005F_", "<b>&\"'", "=1+1", "\ufffe", "😀 ế", "true", "12", None, "x" * 40000]


def test_round_trip(spark, tmp_path):
    rows = [(i, t, i / 7, i % 3 == 0, ["train", "dev", " Test ", "val"][i % 4], [i]) for i, t in enumerate(ODD * 3)]
    df = spark.createDataFrame(rows, "id long, text string, part double, flag boolean, split string, list array<long>").repartition(3)
    path = str(tmp_path / "books")
    write_workbooks(df, path)
    assert len(workbook.find_workbooks(path)) == 3
    got = read_excel(spark, path)
    assert dict(got.dtypes) == {"id": "bigint", "text": "string", "part": "double", "flag": "boolean", "list": "string", "split": "string"}
    split = {"train": "train", "dev": "val", " Test ": "test", "val": "val"}
    assert sorted(map(repr, got.select("id", "text", "part", "flag", "split", "list").collect())) == sorted(map(repr, [r for r in spark.createDataFrame([(*r[:4], split[r[4]], str(r[5])) for r in rows], got.select("id", "text", "part", "flag", "split", "list").schema).collect()]))
    with pytest.raises(FileExistsError):
        write_workbooks(df, path)
    write_workbooks(df.limit(2), path, mode="append")
    assert read_excel(spark, path).count() == len(rows) + 2
    write_workbooks(df.limit(2), path, mode="overwrite")
    assert read_excel(spark, path).count() == 2
    with pytest.raises(ValueError, match="mode"):
        write_workbooks(df, path, mode="ignore")


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"])), st.text(st.characters(exclude_categories=["Cs"]), min_size=1))
def test_any_text(tmp_path_factory, text, name):
    path = str(tmp_path_factory.mktemp("t") / "a.xlsx")
    book = workbook._Book(open(path, "wb"))
    book.start("s", [f"h{name}"])
    book.row([("s", text)])
    book.close()
    with zipfile.ZipFile(path) as z:
        rows = [workbook.row_cells(r, []) for r in workbook._streamed(z, "xl/worksheets/sheet1.xml", "row")]
    assert rows == [{0: ("s", f"h{name}")}, {0: ("s", text)}]


MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def foreign(path, sheets, strings=()):
    """A workbook with shared strings, absolute links and sheets given as XML rows."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{OFFICE}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Type="{OFFICE}/worksheet" Target="/xl/worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, xml in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {MAIN}><sheetData>{xml}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")


def test_workbook_of_another_program(spark, tmp_path):
    shared = ["<t>Sentence</t>", "<t>n</t>", "<r><t>rich </t></r><r><t>text</t></r><rPh><t>no</t></rPh>", "<t>never read for headings</t>"]
    head = '<row r="1"/><row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c><c t="s"><v>1</v></c></row>'
    body = '<row><c r="A3"><v>5</v></c><c r="B3" t="s"><v>2</v></c><c r="C3"><v>1</v></c><c r="D3" t="b"><v>1</v></c></row><row><c r="C4"><v>2.5E1</v></c><c r="B4" t="e"><v>#REF!</v></c></row>'
    wide = '<row><c r="AB5" t="str"><v>sum</v></c></row>'
    foreign(tmp_path / "a.xlsx", {"Notes": "<row><c><v>1</v></c></row>", " Train ": head + body, "DEV": head + wide}, shared)
    got = read_table(spark, str(tmp_path / "a.xlsx"))
    assert got.dtypes == [("Unnamed: 0", "bigint"), ("Sentence", "string"), ("n", "double"), ("n.1", "boolean"), ("split", "string")]
    assert sorted(map(tuple, got.collect()), key=str) == [(5, "rich text", 1.0, True, "train"), (None, None, 25.0, None, "train"), (None, None, None, None, "val")]
    with pytest.raises(ValueError, match="needed"):
        read_excel(spark, str(tmp_path / "a.xlsx"), strict=True)


def test_first_sheet_and_strict(spark, tmp_path):
    row = lambda *v: "<row>" + "".join(f'<c t="inlineStr"><is><t>{x}</t></is></c>' for x in v) + "</row>"
    foreign(tmp_path / "plain.xlsx", {"a": row("text") + row("x"), "b": row("other") + row("y")})
    got = read_excel(spark, str(tmp_path / "plain.xlsx"))
    assert got.columns == ["text"] and [tuple(r) for r in got.collect()] == [("x",)]
    foreign(tmp_path / "strict.xlsx", {s: row("text", "TEXT") + row(s, "u") for s in ("train", "val", "test", "Test")})
    got = read_excel(spark, str(tmp_path / "strict.xlsx"), strict=True)
    assert sorted(map(tuple, got.collect())) == [(s, "u", s) for s in ("test", "train", "val")] and got.columns == ["text", "TEXT.1", "split"]
    # a folder of both: rows of the first sheet have no split
    assert sorted(map(str, read_excel(spark, str(tmp_path)).select("text", "split").collect()))[-1] == "Row(text='x', split=None)"
    foreign(tmp_path / "none.xlsx", {"a": ""})
    assert read_excel(spark, str(tmp_path / "none.xlsx")).count() == 0
    with pytest.raises(ValueError, match="no .xlsx"):
        (tmp_path / "old").mkdir()
        read_excel(spark, str(tmp_path / "old"))


def test_report_is_one_workbook(spark, tmp_path):
    path = str(tmp_path / "report.xlsx")
    detail = spark.range(50, numPartitions=5).select("id", (F.col("id") / 3).alias("f1")).orderBy(F.desc("id"))
    none = detail.where("id < 0")
    long = "a/b" + "c" * 40
    write_report({"detail": detail, long: detail.limit(1), "gaps": none}, path)
    names = {s.name: s.columns for s in workbook.find_sheets(path)}
    assert names == {"detail": {"id": 0, "f1": 1}, ("a_b" + "c" * 40)[:31]: {"id": 0, "f1": 1}, "gaps": {"id": 0, "f1": 1}}
    got = read_excel(spark, path).collect()
    assert [r.id for r in got] == list(range(49, -1, -1)) and got[0].f1 == 16.3333
    write_report({"gaps": none}, path, mode="overwrite")
    assert read_excel(spark, path).count() == 0 and [p.name for p in tmp_path.iterdir()] == ["report.xlsx"]
    with pytest.raises(ValueError, match="once cut"):
        write_report({"x" * 31 + "1": detail, "X" * 31 + "2": detail}, path, mode="overwrite")


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.range(100, numPartitions=4).select("id", F.lit("train").alias("split"), F.when(F.col("id") == 77, F.raise_error("late")).otherwise("x").alias("text"))
    path = str(tmp_path / "books")
    with pytest.raises(Exception, match="late"):
        write_workbooks(df, path)
    assert workbook.find_workbooks(path) == [] and list((tmp_path / "books").iterdir()) == []


def test_full_sheets_go_on_in_the_next_workbook(tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(workbook, "MAX_ROWS", 4)
    cells = lambda i: [{"kind": "n", "value": str(i)}]
    batch = pa.RecordBatch.from_pylist([{"sheet": s, "cells": cells(i)} for s in ("A", "a", "b") for i in range(7)])
    w = workbook.WorkbookWriter(str(tmp_path), {"*": ["n"]}, False, False)
    w.commit([w.write(iter([batch])), None])
    rows = {}
    for p in workbook.find_workbooks(str(tmp_path)):
        found = workbook.find_sheets(p)
        assert len({s.name.lower() for s in found}) == len(found)
        with zipfile.ZipFile(p) as z:
            for s in found:
                read = [workbook.row_cells(r, [])[0] for r in workbook._streamed(z, s.part, "row")]
                assert len(read) <= 4
                rows.setdefault(s.name, []).extend(int(v) for k, v in read[1:])
    assert {k: sorted(v) for k, v in rows.items()} == {s: list(range(7)) for s in ("A", "a", "b")}
