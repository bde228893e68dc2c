import datetime
import math

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import mapping, reads, schedule, tables


def one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr.alias("x")).head().x


def test_label_runs(spark):
    rows = [(1, "受注高 1,234 △5 － 6 繰越高合計 7 繰越高 １２"), (2, "繰越高"), (3, None), (4, "受注高" + " 100" * 12)]
    df = spark.createDataFrame(rows, "k int, t string")
    got = tables.label_runs(df, ["k"], "t", {"orders": ["受注高"], "backlog": ["繰越高"], "total": ["繰越高合計"]}).orderBy("k", "place").collect()
    assert [(r.k, r.field_id, r["values"]) for r in got] == [(1, "orders", [1234.0, -5.0, None, 6.0]), (1, "total", [7.0]), (1, "backlog", [12.0]), (2, "backlog", []), (4, "orders", [100.0] * 8)]


def test_rows_and_shares(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    good = one(spark, tables.order_row(arr(184321, 238921, 233462, 189780)))
    assert (good.confidence, good.review_required) == (0.9, False)
    shifted = one(spark, tables.order_row(arr(-3, 100, 50, 30, 120, 9)))
    assert (shifted.previous, shifted.next, shifted.review_required) == (100.0, 120.0, False)
    assert one(spark, tables.order_row(arr(100, 50))).review_required
    assert one(spark, tables.breakdown(arr(1, 2, 3), 2)).total == 3.0 and one(spark, tables.breakdown(arr(1, 2, 30), 2)) is None
    assert one(spark, tables.current_value(arr(1000, 40, 1200, 60), F.lit(False))) == 1200.0
    assert one(spark, tables.current_value(arr(10, 20), F.lit(False))) == 20.0
    assert one(spark, tables.hundred(F.lit(40.1), F.lit(60.0))) and not one(spark, tables.hundred(F.lit(40.0), F.lit(61.0)))


def test_segments_and_costs(spark):
    assert one(spark, tables.segment(F.col("t"), "受注.*表", ["注記", "合計"]), t="a受注の表 1 2 合計 注記") == "受注の表 1 2 "
    assert one(spark, tables.segment(F.col("t"), "無い", ["x"]), t="abc") is None
    assert one(spark, tables.cost_value(F.col("t"), "材料費"), t="材料費 1,000 12.5 2,000 13.5 労務費 5") == 2000.0
    assert one(spark, tables.cost_value(F.col("t"), "労務費"), t="材料費 1,000 労務費 5") == 5.0


@pytest.mark.parametrize(("text", "want"), [('{"a": 1}', '{"a": 1}'), ('x\n```json\n{"a": [1]}\n```', '{"a": [1]}'), ('so: {"a": 2} done', '{"a": 2}'), ("none", None), ("{broken", None)])
def test_json(spark, text, want):
    assert one(spark, tables.json_in(F.col("t")), t=text) == want


def test_melt_and_blocks(spark):
    rows = spark.createDataFrame([(1, "住宅", "1,000", "－"), (1, "合計", "5", "6"), (1, "Total", "5", "6"), (1, "工場", "△3", "４")], "k int, c string, a string, b string")
    assert {tuple(r) for r in tables.melt(rows, ["k"], "c", {"a": "2023", "b": "2024"}).collect()} == {(1, "住宅", "2023", 1000.0), (1, "工場", "2023", -3.0), (1, "工場", "2024", 4.0)}
    sheet = spark.createDataFrame([(1, 0, None), (1, 1, "a"), (1, 2, "b"), (1, 3, " "), (1, 4, ""), (1, 5, "c")], "k int, i int, v string")
    assert [(r.i, r.block) for r in tables.blocks(sheet, ["k"], "i", ["v"]).orderBy("i").collect()] == [(1, 0), (2, 0), (5, 1)]


STORE = "mapping int, item int, concept string, action string, status string, decided_by string, confidence double"


def test_store(spark):
    m = spark.createDataFrame([(1, 1, "a", "map", "proposed", "model:x", 0.9), (2, 2, "a", "map", "confirmed", "p", 1.0), (3, 3, "a", "map", "rejected", "p", 1.0), (4, 4, "b", "new_concept", "proposed", "model:x", 0.5)], STORE)
    verdict = spark.createDataFrame([(1, "corroborated"), (2, "corroborated"), (4, "corroborated")], "mapping int, verdict string")
    once = mapping.promote(m, verdict)
    assert {r.mapping: r.status for r in once.collect()} == {1: "confirmed", 2: "confirmed", 3: "rejected", 4: "proposed"}
    assert sorted(mapping.promote(once, verdict).collect()) == sorted(once.collect())
    concepts = spark.createDataFrame([("a", "A", "active"), ("b", "B", "active")], "concept string, name string, status string")
    moved, left = mapping.merge_concept(m, concepts, "a", "b")
    assert {r.mapping: r.concept for r in moved.collect()} == {1: "b", 2: "b", 3: "a", 4: "b"}
    assert {r.concept: (r.status, r.merged_into) for r in left.collect()} == {"a": ("merged", "b"), "b": ("active", None)}
    items = spark.createDataFrame([(i, "e", "u") for i in range(1, 7)], "item int, element string, unit string")
    assert {r.item for r in mapping.unmapped(items, m).collect()} == {3, 5, 6}


def test_calendar(spark):
    d = datetime.date
    windows = spark.createDataFrame([("w", 12, 20, 2, 10)], "name string, start_month int, start_day int, end_month int, end_day int")
    today = F.lit("2026-01-05").cast("date")
    rows = schedule.filing_windows(windows, today)
    assert [(r.target_year, r.window_start, r.window_end) for r in rows.where("in_window").collect()] == [(2024, d(2025, 12, 20), d(2026, 2, 10))]
    assert schedule.next_window(rows, today).head().window_start == d(2026, 12, 20)
    assert one(spark, schedule.target_month_end(F.lit("2026-06-22").cast("date"))) == d(2026, 5, 31)
    assert one(spark, schedule.refresh_due(F.lit("2026-06-22").cast("date"), F.lit(None).cast("string"))) and not one(spark, schedule.refresh_due(F.lit("2026-06-02").cast("date"), F.lit("2026-01")))
    master = spark.createDataFrame([("a", 2020, "x"), ("a", 2021, "y"), ("b", 2022, "z")], "entity string, year int, note string")
    assert [tuple(r) for r in schedule.roll_forward(master, 2022, ["note"]).collect()] == [("a", 2022, None)]
    errors = spark.createDataFrame([("s", "e1"), ("t", "e2"), ("u", "e3")], "security string, error string")
    listed = spark.createDataFrame([("s", d(2020, 1, 1), d(2021, 1, 1)), ("t", d(2020, 1, 1), None)], "security string, listed_from date, listed_to date")
    assert {r.security: r.active for r in schedule.split_errors(errors, listed, F.lit("2024-01-01").cast("date")).collect()} == {"s": False, "t": True, "u": True}


def test_cell_detail(spark):
    key = "entity string, year int, field_id string"
    final = spark.createDataFrame([("a", 1, "f", 2.0)], key + ", value double")
    audit = spark.createDataFrame([("a", 1, "f", "doc2"), ("a", 1, "f", "doc1"), ("a", 2, "f", "no")], key + ", source string")
    none = spark.createDataFrame([], key + ", decision string")
    row = reads.cell_detail(final, audit, none, none, "a", 1, "f").head()
    assert row.value == 2.0 and [x.source for x in row.audit] == ["doc1", "doc2"] and row.evidence == []
    assert reads.cell_detail(final, audit, none, none, "z", 1, "f").head().value is None


def test_findings_of_values(spark):
    pairs = [(5e9, 5e9 + 1, True), (5e9, 5e9 + 0.01, False), (-5e9, -5e9 - 1, True), (1e15, 1e15 + 1, True), (0.1 + 0.2, 0.3, False), (100.0, 100.000001, True), (0.0, -0.0, False)]
    pairs += [(math.inf, math.inf, False), (math.inf, 1.0, True), (math.nan, math.nan, False), (math.nan, 1.0, True), (None, None, False), (None, 1.0, True), (1.0, None, True)]
    schema = "entity string, year int, field_id string, value double"
    final, shown = (spark.createDataFrame([("a", i, "f", p[side]) for i, p in enumerate(pairs)], schema) for side in (0, 1))
    got = {r.finding: r.rows for r in reads.findings(final, final, shown).collect()}
    assert got == {"final_without_audit": 0, "audit_without_final": 0, "duplicate_keys": 0, "wide_differs_from_long": sum(p[2] for p in pairs)}
    alone = [reads.findings(final.where(f"year = {i}"), final, shown.where(f"year = {i}")).where("finding = 'wide_differs_from_long'") for i in (0, 1, 7, 8)]
    assert [df.head().rows for df in alone] == [1, 0, 0, 1]
