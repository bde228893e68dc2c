"""Writers: by format, with nested cells as JSON where a format has none, and replacement of a table as one step."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON texts, for formats without nesting."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*[F.to_json(c.name).alias(c.name) if isinstance(c.dataType, nested) else F.col(c.name) for c in df.schema])


def write_any(df: DataFrame, path: str, kind: str, mode: str = "errorifexists", by: list[str] | None = None) -> None:
    """Writes parquet, csv or jsonl, partitioned by columns if asked."""
    out = {"csv": lambda: flat(df)}.get(kind, lambda: df)().write.mode(mode)
    if by:
        out = out.partitionBy(*by)
    if kind == "csv":
        out.option("header", True).csv(path)
    elif kind in ("json", "jsonl"):
        out.json(path)
    elif kind == "parquet":
        out.parquet(path)
    else:
        raise ValueError(f"no writer for {kind}")


def repaired(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a declared schema in its order: present ones cast (a text that does not fit is null), absent ones null."""
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def union_all(tables: list[DataFrame]) -> DataFrame:
    """All rows under the union of all columns."""
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def with_payload(df: DataFrame, typed: list[str], payload: str = "row_json") -> DataFrame:
    """The typed columns of an evidence table, and the whole row as JSON with its keys in order."""
    return df.select(*typed, F.to_json(F.struct(*sorted(df.columns))).alias(payload))


def mirrors(tables: dict[str, tuple[DataFrame, list[str]]], base: str) -> None:
    """A csv mirror of each table under base, its rows sorted by the table's key."""
    for name, (df, keys) in tables.items():
        flat(df).orderBy(*keys).write.mode("overwrite").option("header", True).csv(f"{base}/{name}")


def bundle(tables: dict[str, DataFrame], base: str, kind: str = "jsonl") -> DataFrame:
    """Writes tables side by side with a manifest (name, kind, rows, columns), which is returned and written too."""
    spark = next(iter(tables.values())).sparkSession
    entries = []
    for name, df in tables.items():
        write_any(df, f"{base}/{name}", kind, "overwrite")
        back = spark.read.format({"jsonl": "json"}.get(kind, kind)).load(f"{base}/{name}")
        entries.append((name, kind, back.count(), ",".join(df.columns)))
    out = spark.createDataFrame(entries, "name string, kind string, rows long, columns string")
    out.coalesce(1).write.mode("overwrite").json(f"{base}/manifest")
    return out


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def replace(df: DataFrame, base: str, keep: int = 5) -> str:
    """Writes a new version under base and then points to it: readers see the old version or the whole new one. Older ones than `keep` go.

    The pointer is a one-row table named by its order, so that it too appears at once.
    """
    spark = df.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs
    root = fs.Path(base)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = _versions(store, root, fs)
    name = f"v{(int(versions[-1][1:9]) if versions else 0) + 1:08d}"
    hidden, shown = f"{base}/_new-{uuid.uuid4().hex}", f"{base}/{name}"
    df.write.parquet(hidden)
    if not store.rename(fs.Path(hidden), fs.Path(shown)):
        raise OSError(f"{shown} could not be published")
    for old in _versions(store, root, fs)[:-keep]:
        store.delete(fs.Path(f"{base}/{old}"), True)
    return shown


def _versions(store, root, fs) -> list[str]:
    return sorted(s.getPath().getName() for s in store.listStatus(root) if s.getPath().getName().startswith("v")) if store.exists(root) else []


def current(spark, base: str) -> DataFrame:
    """The newest published version."""
    fs = spark._jvm.org.apache.hadoop.fs
    root = fs.Path(base)
    versions = _versions(root.getFileSystem(spark._jsc.hadoopConfiguration()), root, fs)
    if not versions:
        raise FileNotFoundError(base)
    return spark.read.parquet(f"{base}/{versions[-1]}")


def markdown(df: DataFrame, most: int = 200) -> str:
    """A report table; one of more than `most` rows fails, so that none is lost without a word: aggregate first."""
    rows = [tuple(r) for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *rows]
    return "\n".join("| " + " | ".join(cell(v) for v in r) + " |" for r in lines)


#: Rows of a sheet, the header included: fixed by the format.
SHEET_ROWS = 1_048_576


def write_xlsx(tables: dict[str, DataFrame], path: str, most: int = SHEET_ROWS - 1) -> None:
    """A workbook of all rows of each table, as inline texts and numbers; after so many rows a table goes on in a further sheet, named (2) and so on.

    Rows pass the driver a partition at a time and are not held.
    """
    if not 0 < most < SHEET_ROWS:
        raise ValueError(f"{most} rows a sheet")
    import zipfile
    from xml.sax.saxutils import escape, quoteattr

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"  # fixed values of the format
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    names: list[str] = []

    def named(table: str, part: int) -> str:
        """A sheet's name of at most 31 characters that no other sheet has, whatever the case."""
        taken = {n.lower() for n in names}
        while True:
            end = f" ({part})" if part > 1 else ""
            name = table[: 31 - len(end)] + end
            if name.lower() not in taken:
                return name
            part += 1

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for table, df in tables.items():
            rows, part = flat(df).toLocalIterator(), 1
            row = next(rows, None)
            while part == 1 or row is not None:
                names.append(named(table, part))
                with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as out:
                    put = lambda r: out.write(("<row>" + "".join(map(cell, r)) + "</row>").encode())  # noqa: B023, E731
                    out.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
                    put(df.columns)
                    count = 0
                    while row is not None and count < most:
                        put(row)
                        row, count = next(rows, None), count + 1
                    out.write(b"</sheetData></worksheet>")
                part += 1
        sheets = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{sheets}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r0" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
