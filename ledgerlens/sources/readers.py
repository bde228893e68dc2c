"""Readers: one entry for each format, declared schemas at the edge, blanks as nulls, explicit row order."""

from __future__ import annotations

import csv
import hashlib
import io
import re
import time
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type as to_arrow

from ..functions.exprs import nullify_blank


def read_any(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The table at path by its suffix; csv columns are strings with blanks as nulls. Other suffixes fail."""
    kind = re.sub(r"\.gz$", "", path.rstrip("/")).rpartition(".")[2].lower()
    if kind == "parquet":
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    if kind == "csv":
        return read_csv(spark, path, schema)
    if kind in ("jsonl", "json"):
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.json(path, multiLine=kind == "json")
    if kind == "xlsx":
        return read_xlsx(spark, path)
    if kind in ("yml", "yaml"):
        return read_yaml(spark, path, schema)
    raise ValueError(f"no reader for {kind}: {path}")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; a byte order mark goes, blanks become nulls, every column is a string unless declared."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    df = df.toDF(*[c.removeprefix("\ufeff") for c in df.columns])
    return df.select(*[nullify_blank(F.col(c)).alias(c) if isinstance(f.dataType, T.StringType) else F.col(c) for c, f in zip(df.columns, df.schema, strict=True)])


def read_first(spark: SparkSession, base: str, suffixes: tuple[str, ...] = ("parquet", "xlsx", "csv", "jsonl")) -> DataFrame:
    """The first format in which a table is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for s in suffixes:
        path = hadoop.Path(f"{base}.{s}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return read_any(spark, f"{base}.{s}")
    raise FileNotFoundError(f"{base}: {', '.join(suffixes)}")


def require_columns(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{name} lacks the columns {', '.join(missing)}")
    return df


def with_ordinal(df: DataFrame, out: str = "ordinal") -> DataFrame:
    """An ordinal that grows with file and row order, stamped at the read, for later first- and last-wins rules."""
    return df.withColumn(out, F.monotonically_increasing_id())


def read_yaml(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A list of mappings, for configuration; it goes through the driver."""
    import yaml

    text = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    return spark.createDataFrame(yaml.safe_load(text) or [], schema)


XLSX = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}  # fixed value of the format


def sheet_rows(content: bytes, sheet: str = "xl/worksheets/sheet1.xml") -> list[list[str | None]]:
    """Cells of a sheet as texts; rows and columns that the file leaves out are null."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{XLSX['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", XLSX)]
        rows = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{{{XLSX['m']}}}row"):
            out: list[str | None] = []
            for c in row.findall("m:c", XLSX):
                place = 0
                for letter in re.match("[A-Z]*", c.get("r", ""))[0]:
                    place = 26 * place + ord(letter) - 64
                place = place or len(out) + 1
                value = c.findtext("m:v", None, XLSX)
                if c.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{{{XLSX['m']}}}t"))
                out += [None] * (place - len(out) - 1) + [value]
            rows.append(out)
    return rows


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook; its first row has the names, which alone come to the driver. A workbook is one task's work."""
    rows = read_sheets(spark, path).where("sheet = 0")
    head = rows.where("row = 0").select("cells").head()
    names = [n or f"column_{i}" for i, n in enumerate(head["cells"] if head else ["column_0"])]
    return rows.where("row > 0").orderBy("row").select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


SHEET_TABLE = "path string, member string, sheet int, row int, cells array<string>"


def read_sheets(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".xlsx", ".csv", ".zip")) -> DataFrame:
    """(path, member, sheet, row, cells): all rows of all sheets of the workbooks, csv files, and both inside zips, under path. Files spread over tasks; tables.blocks() parts rows into blocks."""

    def sheets(name: str, content: bytes, member: str) -> Iterator[tuple[str, int, list]]:
        kind = name.lower()
        if kind.endswith(".xlsx"):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                found = [n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet[0-9]+\.xml", n)]
            for i, sheet in enumerate(sorted(found, key=lambda n: int(re.search("[0-9]+", n)[0]))):
                yield member, i, sheet_rows(content, sheet)
        elif kind.endswith(".csv"):
            yield member, 0, [[x or None for x in r] for r in csv.reader(io.StringIO(decoded(content, ("utf-8-sig", "cp932"))))]
        elif kind.endswith(".zip") and not member:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for inner in sorted(z.namelist()):
                    yield from sheets(inner, z.read(inner), inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for member, sheet, rows in sheets(p, content.as_py(), ""):
                    n = len(rows)
                    if n:
                        cols = [pa.array([p] * n), pa.array([member] * n), pa.array([sheet] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(rows, pa.list_(pa.string()))]
                        yield pa.record_batch(cols, names=["path", "member", "sheet", "row", "cells"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    keep = F.lit(False)
    for s in suffixes:
        keep = keep | F.lower("path").endswith(s)
    return files.where(keep).select("path", "content").mapInArrow(run, SHEET_TABLE)


def fetched(rows: DataFrame, key: str, fetch, retries: int = 3, pause: float = 1.0) -> DataFrame:
    """(key, status, content, bytes, sha256, error) of what fetch(key) -> (status, content) gives, in the tasks, for each row.

    A refusal for now (429) or a fault of the server (5xx), and a raised error, are tried again after a pause that grows by
    its own length; what fails in the end is a row that says so. fetch is any function that can be shipped to executors.
    """
    kind = rows.schema[key].dataType.simpleString()

    def one(k) -> tuple[int, bytes | None, str | None]:
        status, content, error = 0, None, None
        for attempt in range(retries + 1):
            if attempt:
                time.sleep(pause * attempt)
            try:
                status, content = fetch(k)
                error = None if status < 400 else f"status {status}"
            except Exception as e:  # noqa: BLE001  any failure of a fetch is a row
                status, content, error = 0, None, str(e)
            if error is None or 400 <= status < 500 and status != 429:
                break
        return status, None if error else content, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, k in enumerate(batch.column(0).to_pylist()):
                status, content, error = one(k)
                digest = hashlib.sha256(content).hexdigest() if content is not None else None
                cols = [batch.column(0).slice(i, 1), pa.array([status], pa.int32()), pa.array([content], pa.binary()), pa.array([None if content is None else len(content)], pa.int64()), pa.array([digest], pa.string()), pa.array([error], pa.string())]
                yield pa.record_batch(cols, names=[key, "status", "content", "bytes", "sha256", "error"])

    return rows.select(key).mapInArrow(run, f"`{key}` {kind}, status int, content binary, bytes bigint, sha256 string, error string")


def read_index(days: DataFrame, fetch, **how) -> DataFrame:
    """(day, document as JSON) of a filing index that is asked once a day: fetch(day) -> (status, JSON with a list `results`)."""
    pages = fetched(days, "day", fetch, **how).where("error IS NULL")
    return pages.select("day", F.explode(F.from_json(F.col("content").cast("string"), "results array<string>")["results"]).alias("document"))


def parsed_documents(files: DataFrame, parsers: dict, schema: str) -> DataFrame:
    """Rows that a registry of parsers makes of files (path, kind, content): parsers[kind](path, content) -> rows of the schema. A file whose kind has no parser, or whose parser fails, is a row with an error.

    The registry is where layouts of single sources, and readers of formats for which there is a library, are plugged in.
    """
    fields = T._parse_datatype_string(schema).fieldNames()
    types = [pa.string(), pa.string(), *(to_arrow(f.dataType) for f in T._parse_datatype_string(schema))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, kind, content in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                try:
                    if kind not in parsers:
                        raise LookupError(f"no parser for {kind}")
                    rows = [(p, None, *r) for r in parsers[kind](p, content)]
                except Exception as e:  # noqa: BLE001  a document that fails must not end the others
                    rows = [(p, str(e), *[None] * len(fields))]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["path", "error", *fields])

    return files.select("path", "kind", "content").mapInArrow(run, f"path string, error string, {schema}")


ENCODINGS = ("utf-16", "utf-8-sig", "cp932")
#: Column: its headers, in order of preference. Fixed values.
FACT_COLUMNS = {
    "element_id": ["要素ID", "element_id"],
    "item_name": ["項目名", "item_name"],
    "context_id": ["コンテキストID", "context_id"],
    "relative_year": ["相対年度", "relative_year"],
    "consolidation_scope": ["連結・個別", "consolidation_scope"],
    "period_or_instant": ["期間・時点", "period_or_instant"],
    "unit_id": ["ユニットID", "unit_id"],
    "unit": ["単位", "unit"],
    "value": ["値", "value"],
}


def decoded(content: bytes, encodings: tuple[str, ...] = ENCODINGS) -> str:
    """The text by the first encoding that fits; UTF-16 needs its byte order mark."""
    for e in encodings:
        if e == "utf-16" and content[:2] not in (b"\xff\xfe", b"\xfe\xff"):
            continue
        try:
            return content.decode(e)
        except UnicodeDecodeError:
            continue
    return content.decode(encodings[-1], errors="replace")


def read_zipped_facts(spark: SparkSession, path: str, encodings: tuple[str, ...] = ENCODINGS) -> DataFrame:
    """Rows of every csv member of the zips under path: file, member, row number and the aliased columns.

    Encoding and delimiter (tab or comma, whichever its head has more of) are found for each member; zips spread over tasks.
    """
    names = ["path", "csv_file", "row_index", *FACT_COLUMNS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for member in sorted(n for n in z.namelist() if n.lower().endswith(".csv")):
                        text = decoded(z.read(member), encodings)
                        mark = "\t" if text[:4096].count("\t") > text[:4096].count(",") else ","
                        rows = []
                        for i, row in enumerate(csv.DictReader(io.StringIO(text), delimiter=mark)):
                            rows.append((p, member, i, *[next((row[a] for a in alias if row.get(a)), None) for alias in FACT_COLUMNS.values()]))
                        if rows:
                            cols = list(zip(*rows, strict=True))
                            yield pa.record_batch([pa.array(c, pa.int64() if n == "row_index" else pa.string()) for n, c in zip(names, cols, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(run, ", ".join(f"{n} {'bigint' if n == 'row_index' else 'string'}" for n in names))


def fact_columns(facts: DataFrame) -> DataFrame:
    """Derived columns of facts: local name, whether it is a text block, the number and the kind of value, and the scope."""
    from ..functions.exprs import parse_number

    local = F.regexp_extract("element_id", "([^:]*)$", 1)
    block, number = local.endswith("TextBlock"), parse_number(F.col("value"))
    kind = F.when(block, "text").when(F.coalesce(F.trim("value"), F.lit("")) == "", "blank").when(number.isNotNull(), "numeric").otherwise("string")
    scope = F.when(F.col("context_id").contains("NonConsolidated") | F.col("consolidation_scope").contains("個別"), "standalone").when(F.col("context_id").contains("Member"), "segment").otherwise("consolidated")
    return facts.withColumns({"element_local_name": local, "is_text_block": block, "value_numeric": F.when(~block, number), "value_type": kind, "normalized_scope": scope})


CHART = (
    "chart struct<result: array<struct<meta: struct<symbol: string, currency: string>, timestamp: array<bigint>, "
    "events: struct<dividends: map<string, struct<amount: double, date: bigint>>, splits: map<string, struct<date: bigint, numerator: double, denominator: double, splitRatio: string>>>, "
    "indicators: struct<quote: array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<bigint>>>, adjclose: array<struct<adjclose: array<double>>>>>>>"
)


def read_chart(spark: SparkSession, path: str) -> DataFrame:
    """Monthly bars of landed chart JSON, dated at the month's end in Japan: parallel arrays become rows, bars without a price go; with the month's dividends, summed, and its split factors, multiplied."""
    from ..functions.parsing import day_in_japan, split_ratio

    one = spark.read.schema(CHART).json(path, multiLine=True).select(F.explode("chart.result").alias("r")).select("r.*")
    q, adj = F.get("indicators.quote", F.lit(0)), F.get("indicators.adjclose", F.lit(0))["adjclose"]
    month = lambda c: F.date_format(day_in_japan(c), "yyyy-MM")
    paid = F.transform(F.map_values("events.dividends"), lambda e: F.struct(month(e["date"]).alias("m"), e["amount"].alias("x")))
    factor = lambda e: F.coalesce(F.try_divide(e["numerator"], e["denominator"]), split_ratio(e["splitRatio"]))
    split = F.transform(F.map_values("events.splits"), lambda e: F.struct(month(e["date"]).alias("m"), factor(e).alias("x")))
    bars = F.arrays_zip(F.col("timestamp").alias("t"), q["open"].alias("open"), q["high"].alias("high"), q["low"].alias("low"), q["close"].alias("close"), q["volume"].alias("volume"), F.coalesce(adj, F.array()).alias("adjusted_close"))
    rows = one.select(F.col("meta.symbol").alias("symbol"), F.col("meta.currency").alias("currency"), paid.alias("_p"), split.alias("_s"), F.explode(bars).alias("b"))
    rows = rows.where("b.close IS NOT NULL OR b.adjusted_close IS NOT NULL").withColumn("month", month(F.col("b.t")))
    mine = lambda c: F.transform(F.filter(F.coalesce(c.cast("array<struct<m:string,x:double>>"), F.array().cast("array<struct<m:string,x:double>>")), lambda e: e["m"] == F.col("month")), lambda e: e["x"])
    total = lambda xs, start, add: F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(start), add))
    return rows.select(
        "symbol", "currency", F.last_day(day_in_japan(F.col("b.t"))).alias("date"), "month", "b.open", "b.high", "b.low", "b.close", "b.adjusted_close", "b.volume",
        total(mine(F.col("_p")), 0.0, lambda s, x: s + x).alias("dividend"), total(mine(F.col("_s")), 1.0, lambda s, x: s * x).alias("split_factor"),
    )


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Series by category of landed chart JSON: {categories: [..], series: [{name, data: [..]}]} to rows."""
    df = spark.read.schema("categories array<string>, series array<struct<name: string, data: array<double>>>").json(path, multiLine=True)
    rows = df.select("categories", F.explode("series").alias("s")).select("categories", "s.name", F.posexplode("s.data").alias("i", "value"))
    return rows.select(F.col("name").alias("series"), F.get("categories", F.col("i")).alias("category"), "value")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files (html, htm, xhtml, txt, csv) under a folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{html,htm,xhtml,txt,csv}").text(path, wholetext=True)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def links(pages: DataFrame, text_words: list[str] | None = None, href_words: list[str] | None = None, every: bool = True) -> DataFrame:
    """(page_id, href, text) of a page's links whose text and address have the words (all kinds of test, or any)."""
    rows = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)(<a\s[^>]*href=[^>]*>.*?</a>)"))).alias("a"))
    rows = rows.select("page_id", F.regexp_extract("a", r"(?i)href=[\"']?([^\"'\s>]*)", 1).alias("href"), F.trim(F.regexp_replace("a", "(?s)<[^>]+>", " ")).alias("text"))
    tests = [F.lower(c).contains(w.lower()) for c, words in ((F.col("text"), text_words), (F.col("href"), href_words)) for w in words or []]
    if not tests:
        return rows
    keep = tests[0]
    for t in tests[1:]:
        keep = (keep & t) if every else (keep | t)
    return rows.where(keep)


def html_cells(pages: DataFrame) -> DataFrame:
    """(page_id, table, row, column, text) of all cells of all tables of a page, by position."""
    strip = lambda c: F.btrim(F.regexp_replace(F.regexp_replace(c, "(?s)<[^>]+>", " "), r"\s+", " "))
    tables = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)(<table.*?</table>)"))).alias("table", "t"))
    rows = tables.select("page_id", "table", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)(<tr.*?</tr>)"))).alias("row", "r"))
    cells = rows.select("page_id", "table", "row", F.posexplode(F.regexp_extract_all("r", F.lit(r"(?is)(<t[dh].*?</t[dh]>)"))).alias("column", "c"))
    return cells.select("page_id", "table", "row", "column", strip(F.col("c")).alias("text"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the landed files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def zipped_texts(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".html", ".htm", ".xhtml", ".txt", ".csv")) -> DataFrame:
    """(path, member, text) of the text members of the zips under a folder, decoded as UTF-8 or else cp932."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for member in sorted(n for n in z.namelist() if n.lower().endswith(suffixes)):
                        text = decoded(z.read(member), ("utf-8-sig", "cp932"))
                        yield pa.record_batch([pa.array([p]), pa.array([member]), pa.array([text])], names=["path", "member", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(run, "path string, member string, text string")


def aliased(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns by the first of their aliases that has a value; aliases that a table lacks do not count."""
    pick = lambda xs: [nullify_blank(F.col(f"`{x}`")) for x in xs if x in df.columns] or [F.lit(None).cast("string")]
    return df.select(*[F.coalesce(*pick(xs)).alias(c) for c, xs in aliases.items()])
