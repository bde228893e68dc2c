import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources import readers, sinks
from ledgerlens.streaming import refresh


def test_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,name\n1,x\n2, \n3,None\n".encode())
    df = readers.read_any(spark, f"{tmp_path}/a.csv")
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", "x"), ("2", None), ("3", None)]
    (tmp_path / "b.jsonl").write_text('{"k": 1}\n\n{"k": 2}\n')
    assert readers.read_first(spark, f"{tmp_path}/b").count() == 2
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2"><v>5</v></c></row></sheetData></worksheet>'
    shared = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>id</t></si></sst>'
    with zipfile.ZipFile(tmp_path / "c.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", shared)
    got = readers.read_any(spark, f"{tmp_path}/c.xlsx")
    assert got.columns == ["id", "column_1", "n"] and [tuple(r) for r in got.collect()] == [("5", None, None)]


def test_zipped_facts(spark, tmp_path):
    head = "要素ID\t項目名\tコンテキストID\t相対年度\t連結・個別\t期間・時点\tユニットID\t単位\t値\n"
    body = "x:NetSales\t売上高\tCurrentYearDuration\t当期\t連結\t期間\tJPY\t円\t△1,000\nx:NoteTextBlock\t注記\tFilingDate\t\t\t\t\t\t文\n"
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("XBRL_TO_CSV/one.csv", (head + body).encode("utf-16"))
        z.writestr("two.csv", "element_id,value\ny:Cost_NonConsolidated,5\n".encode("cp932"))
        z.writestr("three.txt", "no")
    facts = readers.fact_columns(readers.read_zipped_facts(spark, f"file://{tmp_path}")).collect()
    got = {r.element_local_name: (r.value_type, r.value_numeric) for r in facts}
    assert got == {"NetSales": ("numeric", -1000.0), "NoteTextBlock": ("text", None), "Cost_NonConsolidated": ("numeric", 5.0)}


def test_charts_and_links(spark, tmp_path):
    quote = {k: [1.0, None, None] for k in ("open", "high", "low", "close")} | {"volume": [5, None, None]}
    events = {"dividends": {"1": {"amount": 2.5, "date": 1704034800}, "2": {"amount": 1.5, "date": 1705000000}, "3": {"amount": 9.0, "date": 1600000000}}, "splits": {"1": {"date": 1704100000, "numerator": 3.0, "denominator": 2.0}, "2": {"date": 1704100001, "splitRatio": "2:1"}}}
    chart = {"meta": {"symbol": "S", "currency": "JPY"}, "timestamp": [1704034800, 1706713200, 1709218800], "events": events, "indicators": {"quote": [quote], "adjclose": [{"adjclose": [0.5, None, 7.0]}]}}
    (tmp_path / "c.json").write_text(json.dumps({"chart": {"result": [chart]}}))
    got = readers.read_chart(spark, f"{tmp_path}/c.json").orderBy("date").collect()
    assert [(str(r.date), r.close, r.adjusted_close, r.dividend, r.split_factor) for r in got] == [("2024-01-31", 1.0, 0.5, 4.0, 3.0), ("2024-03-31", None, 7.0, None, None)]
    (tmp_path / "bare.json").write_text(json.dumps({"chart": {"result": [{"meta": {"symbol": "S"}, "timestamp": [1704034800], "indicators": {"quote": [quote]}}]}}))
    assert [(r.close, r.dividend) for r in readers.read_chart(spark, f"{tmp_path}/bare.json").collect()] == [(1.0, None)]
    (tmp_path / "m.json").write_text(json.dumps({"categories": ["x", "y"], "series": [{"name": "s", "data": [1.0, 2.0]}]}))
    assert {tuple(r) for r in readers.read_matrix(spark, f"{tmp_path}/m.json").collect()} == {("s", "x", 1.0), ("s", "y", 2.0)}
    page = spark.createDataFrame([(1, '<a href="/a.pdf">Fact <b>book</b></a><a href="/b">x</a><table><tr><th>k</th><td> 1 </td></tr></table>')], "page_id long, html string")
    assert [r.href for r in readers.links(page, ["fact"], [".pdf"]).collect()] == ["/a.pdf"]
    assert [r.text for r in readers.html_cells(page).orderBy("column").collect()] == ["k", "1"]


def test_versions_and_stream(spark, tmp_path):
    base, land = f"file://{tmp_path}/table", tmp_path / "land"
    for i, rows in enumerate(([(1, "a", 0), (2, "b", 1), (1, "c", 2)], [(2, "d", 3), (3, "e", 4)])):
        spark.createDataFrame(rows, "k int, v string, o int").coalesce(1).write.mode("append").parquet(str(land))
        source = spark.readStream.schema("k int, v string, o int").parquet(str(land))
        refresh.merge_batches(spark, source, base, f"{tmp_path}/check", ["k"], "o").awaitTermination(120)
    assert {(r.k, r.v) for r in sinks.current(spark, base).collect()} == {(1, "c"), (2, "d"), (3, "e")}
    for _ in range(6):
        sinks.replace(spark.range(1), f"file://{tmp_path}/v", keep=2)
    assert len(list((tmp_path / "v").glob("v*"))) == 2
    nested = spark.range(1).select("id", F.array(F.lit(1)).alias("a"))
    sinks.write_any(nested, f"{tmp_path}/n", "csv")
    assert readers.read_csv(spark, f"{tmp_path}/n").head().a == "[1]"
    assert sinks.markdown(spark.createDataFrame([("a|b", None)], "x string, y int")).splitlines()[-1] == "| a\\|b |  |"


def test_workbooks_manifests_and_aliases(spark, tmp_path):
    df = spark.createDataFrame([("a<b", 1, 2.5), (None, None, None)], "x string, n int, d double")
    sinks.write_xlsx({"first": df, "second": df.limit(1)}, str(tmp_path / "w.xlsx"))
    assert [tuple(r) for r in readers.read_xlsx(spark, f"{tmp_path}/w.xlsx").collect()] == [("a<b", "1", "2.5"), (None, None, None)]
    land = tmp_path / "land"
    land.mkdir()
    with zipfile.ZipFile(land / "z.zip", "w") as z:
        z.writestr("a/b.html", "日本".encode("cp932"))
        z.writestr("c.bin", b"x")
    assert [(r.member, r.text) for r in readers.zipped_texts(spark, f"file://{land}").collect()] == [("a/b.html", "日本")]
    row = readers.manifest(spark, f"file://{land}").head()
    assert row.bytes == (land / "z.zip").stat().st_size and len(row.sha256) == 64
    got = readers.aliased(spark.createDataFrame([("", "v"), ("u", "v")], "p string, q string"), {"a": ["p", "q"], "b": ["none"]}).collect()
    assert [tuple(r) for r in got] == [("v", None), ("u", None)]


def test_workbook_has_every_row(spark, tmp_path):
    """A table above a sheet's rows goes on in further sheets, and the old bound of 100,000 rows drops nothing."""
    sinks.write_xlsx({"t" * 40: spark.range(5), "none": spark.range(0), "T" * 31: spark.range(1)}, str(tmp_path / "w.xlsx"), most=2)
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        book = z.read("xl/workbook.xml").decode()
        sheets = [z.read(f"xl/worksheets/sheet{i}.xml").decode() for i in range(1, book.count("<sheet ") + 1)]
    assert [x.count("<row>") - 1 for x in sheets] == [2, 2, 1, 0, 1]
    assert [v for x in sheets[:3] for v in re.findall("<v>(.*?)</v>", x)] == list("01234")
    names = re.findall('<sheet name="(.*?)"', book)
    assert len({n.lower() for n in names}) == 5 and max(map(len, names)) == 31
    sinks.write_xlsx({"all": spark.range(100_003)}, str(tmp_path / "l.xlsx"))
    with zipfile.ZipFile(tmp_path / "l.xlsx") as z:
        assert z.read("xl/worksheets/sheet1.xml").count(b"<row>") == 100_004


def test_sheets_of_workbooks_and_zips(spark, tmp_path):
    """All sheets of workbooks, csv files and both inside zips, as rows of cells."""
    land = tmp_path / "land"
    land.mkdir()
    sinks.write_xlsx({"a": spark.range(2), "b": spark.range(1)}, str(land / "w.xlsx"))
    (land / "c.csv").write_bytes("x,\n,日本\n".encode("cp932"))
    with zipfile.ZipFile(land / "z.zip", "w") as z:
        z.writestr("in/d.csv", "1,2\n")
        z.write(land / "w.xlsx", "w2.xlsx")
        z.writestr("e.txt", "no")
    got = {(r.path.rsplit("/", 1)[1], r.member, r.sheet, r.row): r.cells for r in readers.read_sheets(spark, f"file://{land}").collect()}
    assert got[("c.csv", "", 0, 0)] == ["x", None] and got[("c.csv", "", 0, 1)] == [None, "日本"]
    assert got[("z.zip", "in/d.csv", 0, 0)] == ["1", "2"] and got[("z.zip", "w2.xlsx", 0, 2)] == ["1"] and got[("w.xlsx", "", 1, 0)] == ["id"]
    assert len(got) == 5 + 2 + 1 + 5


def test_fetches_and_parsers(spark):
    """Refusals and faults are tried again, errors are rows; a registry parses what it knows."""

    def fetch(day):
        if day == "2024-01-02":
            return 404, b""
        if day == "2024-01-03":
            raise OSError("no route")
        return 200, b'{"results": [{"docID": "S1"}, {"docID": "S2"}]}'

    days = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), ("2024-01-03",)], "day string")
    got = {r.day: (r.status, r.bytes, r.error, r.sha256 is not None) for r in readers.fetched(days, "day", fetch, 1, 0.0).collect()}
    assert got == {"2024-01-01": (200, 47, None, True), "2024-01-02": (404, None, "status 404", False), "2024-01-03": (0, None, "no route", False)}
    assert [json.loads(r.document)["docID"] for r in readers.read_index(days, fetch, retries=0).collect()] == ["S1", "S2"]

    def flaky(day, seen=[]):  # noqa: B006  counts its calls
        seen.append(day)
        return (503, b"") if len(seen) < 3 else (200, b"ok")

    one = readers.fetched(days.limit(1).coalesce(1), "day", flaky, 3, 0.0).head()
    assert (one.status, one.error, bytes(one.content)) == (200, None, b"ok")
    files = spark.createDataFrame([("p", "text", b"a b"), ("q", "pdf", b""), ("r", "bad", b"")], "path string, kind string, content binary")
    parsers = {"text": lambda _, c: [(w, i) for i, w in enumerate(c.decode().split())], "bad": lambda _, c: [c[5]]}
    rows = {(r.path, r.error and r.error[:9], r.word, r.place) for r in readers.parsed_documents(files, parsers, "word string, place bigint").collect()}
    assert rows == {("p", None, "a", 0), ("p", None, "b", 1), ("q", "no parser", None, None), ("r", "index out", None, None)}


def test_mirrors_bundles_and_repair(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", "x"), (1, "a", "5")], "id int, name string, n string")
    sinks.mirrors({"t": (df, ["id"])}, f"{tmp_path}/m")
    assert [r.id for r in readers.read_csv(spark, f"{tmp_path}/m/t").collect()] == ["1", "2"]
    listed = {r.name: (r.kind, r.rows, r.columns) for r in sinks.bundle({"t": df, "u": df.limit(0)}, f"{tmp_path}/b").collect()}
    assert listed == {"t": ("jsonl", 2, "id,name,n"), "u": ("jsonl", 0, "id,name,n")} and spark.read.json(f"{tmp_path}/b/manifest").count() == 2
    schema = spark.createDataFrame([], "n double, id long, gone date").schema
    assert sorted(map(tuple, sinks.repaired(df, schema).collect()), key=str) == [(5.0, 1, None), (None, 2, None)]
    with pytest.raises(ValueError, match="more than 1"):
        sinks.markdown(df, 1)


def test_gated_steps():
    """A closed gate skips what is behind it; a failing step ends the run with its error."""
    ran = []
    steps = [("plan", lambda: ran.append(1)), ("gate", None), ("collect", lambda: ran.append(2))]
    assert [s["status"] for s in refresh.gated(steps, lambda: (False, ["open items"]))] == ["done", "blocked", "skipped"] and ran == [1]
    assert [s["status"] for s in refresh.gated(steps, lambda: (True, []))] == ["done", "ready", "done"]
    assert refresh.gated([("a", lambda: 1 / 0), ("b", lambda: 1)], lambda: (True, []))[0]["error"] == "division by zero"
    assert refresh.poll_if_due(False, lambda: 1) == {"status": "skipped"} and refresh.poll_if_due(False, lambda: 1, True)["result"] == 1
