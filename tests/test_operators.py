import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import exprs as E
from ledgerlens.operators import audit, evidence, extract, market, matching, merge, paging, reshape, review, rules

CELLS = "entity string, year int, field_id string, value double"


def one(spark, expr, **values):
    """An expression over a row of named columns."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr.alias("x")).head().x


@pytest.mark.parametrize(("text", "want"), [("1,234", 1234.0), ("△1,234", -1234.0), ("▲1,234", -1234.0), ("(1,234)", -1234.0), ("－", None), ("１２３", 123.0), ("5%", 5.0), ("a1", None), (None, None), (" 7 ", 7.0)])
def test_number(spark, text, want):
    assert one(spark, E.parse_number(F.col("v")), v=text) == want


@pytest.mark.parametrize(("value", "unit", "target", "want"), [(1e6, "円", "百万円", 1.0), (1000.0, "千円", "百万円", 1.0), (12.0, "億円", "百万円", 1200.0), (8885.0, "千円", "円", 8_885_000.0), (45.5, "歳", "歳", 45.5), (45.5, "年", "歳", 45.5), (0.359, "pure", "%", 35.9), (1.0, "不明", "百万円", None)])
def test_unit(spark, value, unit, target, want):
    got = one(spark, E.convert_unit(F.col("v"), F.col("u"), F.col("t")), v=value, u=unit, t=target)
    assert got == want or got == pytest.approx(want)


def test_texts(spark):
    assert one(spark, E.normalize_unit(F.col("v")), v="単位：百万円") == "百万円" and one(spark, E.normalize_unit(F.col("v")), v="％") == "%"
    assert [one(spark, E.truthy(F.col("v")), v=v) for v in ("True", "1", " yes", "no", None)] == [True, True, True, False, False]
    assert one(spark, E.nullify_blank(F.col("v")), v=" NaN ") is None and one(spark, E.nullify_blank(F.col("v")), v="0") == "0"
    assert one(spark, E.merge_terms(F.col("a"), F.col("b")), a="x; Y", b="y;z;;z") == "x;Y;z"
    assert one(spark, E.entity_of(F.col("v")), v="a_b_2024H1") == "a_b" and one(spark, E.year_of(F.col("v")), v="a_b_2024H1") == 2024
    page = "<html><script>x</script><p>a&amp;b</p><br/><div>c <b>d</b></div></html>"
    assert one(spark, E.html_to_text(F.col("v")), v=page) == "a&b\nc d"
    assert one(spark, E.loose_number(F.col("v")), v="△1,2円") == -12.0


def test_fiscal_year(spark):
    for day, end, want in (("2024-03-31", 3, 2023), ("2024-04-01", 3, 2024), ("2024-06-30", 12, 2024), ("2024-02-01", 2, 2023)):
        assert one(spark, E.fiscal_year(F.to_date(F.col("d")), end), d=day) == want


def test_rules(spark):
    def status(rule, rows):
        df = spark.createDataFrame([("a", y, f, v) for y, f, v in rows], CELLS)
        return [r.status for r in rules.validate(df, [rule]).orderBy("year").collect()]

    total = rules.SumRule("s", "t", ("p", "q", "r"))
    for first, want in ((700.0, "pass"), (600.0, "fail"), (None, "not_applicable")):
        assert status(total, [(1, "t", 1000.0), (1, "p", first), (1, "q", 200.0), (1, "r", 100.0)]) == [want]
    roll = rules.RollRule("b", "c", "i", "o", 2, 0.001)
    for (before, i, o, close), want in (((184321, 238921, 233462, 189780), "pass"), ((100, 50, 30, 121), "pass"), ((100, 50, 30, 500), "fail")):
        got = status(roll, [(1, "c", float(before)), (2, "c", float(close)), (2, "i", float(i)), (2, "o", float(o))])
        assert got == ["not_applicable", want]
    change = rules.ChangeRule("y", ("v",))
    assert status(change, [(1, "v", 100.0), (2, "v", 151.0), (4, "v", 0.0), (5, "v", 3.0)]) == ["not_applicable", "warn", "warn", "not_applicable"]


def test_worst_status_and_reason(spark):
    cells = spark.createDataFrame([("a", 1, "t", 1000.0), ("a", 1, "p", 600.0), ("a", 1, "q", 200.0), ("a", 1, "r", 100.0), ("b", 1, "t", 1.0)], CELLS)
    out = rules.attach_worst(cells, rules.validate(cells, [rules.SumRule("s", "t", ("p", "q", "r"))])).collect()
    assert {(r.entity, r.field_id): r.validation_reason for r in out} == {("a", f): "validation_fail" for f in "tpqr"} | {("b", "t"): None}


METHOD = "entity string, year int, field_id string, method string, unit string, value double"


def test_same_cell(spark):
    def pairs(*rows):
        return [(r.matched, r.check_ref) for r in evidence.same_cell(spark.createDataFrame([("a", 1, "f", *r) for r in rows], METHOD)).collect()]

    assert pairs(("X", "u", 1000.0), ("L", "u", 1000.4)) == [(True, "L|X")]
    assert pairs(("X", "u", 1000.0), ("L", "u", 2000.0)) == [(False, "L|X")]
    for other in (("X", "u", 1.0), ("L", "w", 1.0), ("L", "u", None), ("L", "u", float("nan"))):
        assert pairs(("X", "u", 1.0), other) == []


@pytest.mark.parametrize(
    ("rows", "value", "status", "method", "want"),
    [
        ([], None, "pass", "XBRL_CSV", "no_value"),
        ([], 1.0, "pass", "XBRL_CSV", "needs_review"),
        ([("xbrl_vs_local", True, "XBRL_CSV", "LOCAL_TABLE", None, False)], 1.0, "pass", "XBRL_CSV", "auto_confirmed"),
        ([("xbrl_vs_local", True, "XBRL_CSV", "LOCAL_TABLE", None, False)], 1.0, "fail", "XBRL_CSV", "needs_review"),
        ([("xbrl_vs_local", True, "XBRL_CSV", "XBRL_TEXT", None, False)], 1.0, "pass", "XBRL_CSV", "single_source"),
        ([("xbrl_vs_local", True, "MANUAL", "OTHER", None, False)], 1.0, "pass", "MANUAL", "auto_confirmed"),
        ([("xbrl_vs_local", False, "XBRL_CSV", "LOCAL_TABLE", None, False)], 1.0, "pass", "XBRL_CSV", "conflicted"),
        ([("factbook", False, None, None, None, False)], 1.0, "pass", "XBRL_CSV", "conflicted"),
        ([("identity_rule", False, None, None, None, False)], 1.0, "pass", "XBRL_CSV", "needs_reconciliation"),
        ([("next_year_prior", False, None, None, 5.0, False)], 1.0, "pass", "XBRL_CSV", "needs_review"),
        ([("next_year_prior", False, None, None, 5.0, False), ("xbrl_vs_local", True, "XBRL_CSV", "LOCAL_TABLE", None, False)], 1.0, "pass", "XBRL_CSV", "auto_confirmed"),
        ([("next_year_prior", False, None, None, 5.0, True)], 1.0, "pass", "XBRL_CSV", "needs_review"),
        ([("next_year_prior", True, None, None, 5e6, False), ("identity_rule", True, None, None, None, False)], 5.0, "pass", "XBRL_CSV", "auto_confirmed"),
        ([("next_year_prior", True, None, None, 9e6, False), ("identity_rule", True, None, None, None, False)], 5.0, "pass", "XBRL_CSV", "single_source"),
    ],
)
def test_resolution(spark, rows, value, status, method, want):
    cells = spark.createDataFrame([("a", 1, "f", value, method, status)], "entity string, year int, field_id string, value double, method string, validation_status string")
    schema = "entity string, year int, field_id string, check_kind string, check_ref string, matched boolean, primary_value double, other_value double, difference double, restatement_suspected boolean, method_a string, method_b string"
    found = spark.createDataFrame([("a", 1, "f", kind, "ref", matched, p, None, None, restated, a, b) for kind, matched, a, b, p, restated in rows], schema)
    assert evidence.resolve(cells, found).head().resolution == want


def test_priority_pivot_and_lead(spark):
    rows = [("a", 1, "f", 22207.0, "unreviewed", "XBRL_CSV", 1), ("a", 1, "f", 22200.0, "unreviewed", "LOCAL", 2), ("a", 2, "f", 8.0, "unreviewed", "XBRL_CSV", 3), ("a", 2, "f", 168.0, "corrected", "LOCAL", 4)]
    long = spark.createDataFrame(rows, "entity string, year int, field_id string, value double, status string, method string, ordinal long")
    wide = reshape.priority_pivot(long, ["f", "g"], "XBRL_CSV")
    assert {(r.year, r.f, r.g) for r in wide.collect()} == {(1, 22207.0, None), (2, 168.0, None)}
    led = {r.year: (r.next_f, r.f_growth) for r in reshape.with_lead(wide, "f", ["entity"], "year").collect()}
    assert led == {1: (168.0, round((168 - 22207) / 22207, 4)), 2: (None, None)}


def test_review(spark):
    rows = spark.createDataFrame([("k1", 8.0, "True"), ("k1", 9.0, "False"), ("k2", 5.0, "True"), ("k3", 6.0, "False")], "k string, value double, review_required string")
    saved = spark.createDataFrame([("k1", "accept", 168.0), ("k4", "correct", 1000.0)], "k string, decision string, corrected_value double")
    out = review.apply_decisions(rows, saved, ["k"]).collect()
    assert {(r.k, r.status, r.final_value, r.exported) for r in out} == {("k1", "approved", 168.0, True), ("k2", "unreviewed", 5.0, False), ("k3", "auto_accepted", 6.0, True), ("k4", "corrected", 1000.0, True)}
    assert len(out) == 5
    why = F.array(F.lit("confidence_below_threshold"), F.lit("unit_unknown"))
    assert one(spark, review.demote(why, F.lit("auto_confirmed"))) == ["unit_unknown"]
    assert one(spark, review.demote(why, F.lit("conflicted")))[-1] == "corroboration_conflict"
    assert one(spark, review.demote(F.array(F.lit("confidence_below_threshold"), F.lit("validation_fail")), F.lit("auto_confirmed"))) == ["confidence_below_threshold", "validation_fail"]
    none, no = F.lit(None).cast("string"), F.lit(None).cast("double")
    got = one(spark, review.reasons(F.lit("1"), F.lit("a;b;a"), F.lit(0.5), F.lit(0.9), F.lit("x"), F.lit("y"), none, F.lit(200.0), F.lit("warn"), F.lit("approved"), F.lit(100.0)))
    assert got == ["a", "b", "confidence_below_threshold", "data_scope_mismatch", "unit_unknown", "validation_warn", "existing_human_reviewed", "existing_value_mismatch"]
    assert one(spark, review.reasons(none, none, no, no, none, F.lit("y"), F.lit("u"), F.lit(1.0), F.lit("pass"), none, no)) == []


def test_merge(spark):
    schema = "k string, v int, n int"
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 2), (None, 7, 7), (None, 8, 8)], schema)
    new = spark.createDataFrame([("a", 9, None), ("c", 3, 3), (None, 7, 7)], schema)
    assert {tuple(r) for r in merge.merge(old, new, ["k"]).collect()} == {("a", 9, None), ("b", 2, 2), ("c", 3, 3), (None, 7, 7), (None, 8, 8)}
    assert ("a", 1, 1) in {tuple(r) for r in merge.merge(old, new, ["k"], F.col("v") == 1).collect()}
    assert merge.delete(old, new, ["k"]).count() == 3
    status = {r.k: r.status for r in merge.full_compare(old.dropna(), new.dropna(subset=["k"]), ["k"], "n").collect()}
    assert status == {"a": "mismatch", "b": "old_only", "c": "new_only"}


def test_golden(spark):
    schema = "k string, value double, origin string"
    golden = spark.createDataFrame([("a", 158.0, "manual"), ("b", 158.0, "corroborated_2plus"), ("c", 1.0, "manual"), ("d", 5.0, "human"), ("e", 1e6, "manual"), ("f", 1e6, "manual")], schema)
    actual = spark.createDataFrame([("a", 158.0), ("b", 200.0), ("d", 50.0), ("e", 1_000_500.0), ("f", 1_010_000.0), ("n", 1.0)], "k string, value double")
    negative = spark.createDataFrame([("n",), ("m",)], "k string")
    diff = audit.golden_diff(golden, negative, actual, ["k"])
    assert {r.k: r.kind for r in diff.collect()} == {"b": "value_mismatch", "c": "missing_in_actual", "d": "human_locked_unreproduced", "f": "value_mismatch", "n": "negative_golden_violation"}
    assert not audit.golden_summary(diff).head().passed and audit.golden_summary(diff.where("k = 'd'")).head().passed
    frozen = audit.freeze_golden(golden.where("k = 'a'"), golden.limit(0), spark.createDataFrame([("a", 7.0, "human")], schema), negative, ["k"])
    assert [tuple(r) for r in frozen.collect()] == [("a", 7.0, "human")]


def test_matching(spark):
    facts = spark.createDataFrame([(1, "NetSales", "売上高", False, "10", 1), (1, "netsales", "売上高", False, "10 ", 2), (1, "Other", "売上高の内訳", True, "x", 0), (2, "Other", "売上高の内訳", True, "x", 0)], "doc int, local_name string, label string, is_text boolean, value string, ord int")
    fields = spark.createDataFrame([("sales", ["NetSales", "売上"]), ("none", ["Zip"])], "field_id string, tags array<string>")
    found = matching.candidates(facts, {"sales": ["NetSales", "売上"], "none": ["Zip"]}, ["doc"])
    assert matching.candidates(facts, {"none": ["Zip"]}, ["doc"]).count() == 0 and matching.candidates(facts, {}, ["doc"]).count() == 0
    assert {(r.doc, r.field_id, r.value, r.priority, r.candidates) for r in found.collect()} == {(1, "sales", "10", 0, 1), (2, "sales", "x", 1, 1)}
    grid = matching.always(facts, fields, found, ["doc"])
    assert grid.count() == 4 and grid.where("reason = 'not_found'").count() == 2
    rows = spark.createDataFrame([("a", "f", 2000), ("a", "f", None), ("b", "f", None)], "entity string, field_id string, year int")
    gone = spark.createDataFrame([("a", "f", 1999, None), ("b", "f", None, None)], "entity string, field_id string, from_year int, to_year int")
    assert [r.year for r in matching.without_excluded(rows, gone).collect()] == [None]


def test_series_and_text(spark):
    s = spark.createDataFrame([(1, 100.0), (2, None), (3, 110.0), (4, 0.0), (5, 5.0)], "m int, c double").withColumn("k", F.lit("x"))
    got = {r.m: r.monthly_return for r in market.returns(s, ["k"], "m", "c").collect()}
    assert got == {1: None, 2: None, 3: 0.1, 4: -1.0, 5: None}
    texts = [(0, "受注高 123,456 △1,234 １２３４ 4 (121,098) 7.2")]
    tokens = extract.number_tokens(spark.createDataFrame(texts, "k int, t string"), ["k"], "t").orderBy("position").collect()
    assert [(r.value, r.parenthetical) for r in tokens] == [(123456.0, False), (-1234.0, False), (1234.0, False), (-121098.0, True), (7.2, False)]
    lines = spark.createDataFrame([("| name | n |",), ("|---|---|",), ("| a | 1 |",), ("text",)], "l string")
    assert [tuple(r)[:2] for r in extract.markdown_table(lines, "l", ["name", "n"]).collect()] == [("a", "1")]


def test_mart_and_pages(spark):
    mart = spark.createDataFrame([(1, 120000.0), (2, 1.0), (3, 5000.0)], "k int, v double")
    wide = spark.createDataFrame([(1, 120050.0), (3, 9000.0)], "k int, total double")
    out = market.compare_mart(mart, wide, ["k"], "v", "total")
    assert {r.k: r.status for r in out.collect()} == {1: "pass", 2: "no_reference", 3: "mismatch"}
    assert market.compare_mart(mart, wide, ["k"], "v", "total", 0, 0).where("k = 1").head().status == "mismatch"
    assert market.overall(out).head().overall == "mismatch"
    df = spark.range(120)
    assert [r.id for r in paging.page(df, ["id"], 3, 50).collect()] == list(range(100, 120))
    assert paging.page_info(df.limit(0)).head().total_pages == 1 and paging.page_info(df.limit(0), least_pages=0).head().total_pages == 0
    assert reshape.correlation(spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0)], "k int, x double, y double"), ["k"], "x", "y").head().r is None


def test_coverage(spark):
    entities = spark.createDataFrame([("a",), ("b",)], "entity string")
    years = spark.createDataFrame([(e, y) for e in "ab" for y in (2020, 2021)], "entity string, year int")
    filled = spark.createDataFrame([("a", 2020, "f"), ("a", 2020, "f"), ("b", 2019, "f")], "entity string, year int, field_id string")
    gone = spark.createDataFrame([("b", "f", 2021, 2021)], "entity string, field_id string, from_year int, to_year int")
    out = {r.entity: (r.expected, r.filled, r.blank_years) for r in audit.coverage_matrix(entities, years, ["f"], filled, gone).collect()}
    assert out == {"a": (2, 1, [2021]), "b": (1, 0, [2020])}
    tags = spark.createDataFrame([("x", ["t"], ["con"]), ("y", ["t"], ["non"]), ("z", ["u"], []), ("w", ["u"], []), ("v", ["q"], [])], "field_id string, tags array<string>, markers array<string>")
    assert {r.tag: r.severity for r in audit.duplicate_tags(tags).collect()} == {"t": "low", "u": "medium"}


def test_blanks_of_a_null_key(spark):
    """Null is a key like any other: its blanks go where it has a value."""
    rows = spark.createDataFrame([(None, None, 1), (None, "v", 2), ("a", None, 3), ("b", None, 4), ("b", "w", 5)], "k string, v string, n int")
    assert {r.n for r in merge.suppress_blanks(rows, ["k"], "v").collect()} == {2, 3, 5}


def test_rules_over_one_pivot(spark):
    """Negative bases, missing fields, the last of repeated rows, and entities that have none of a rule's fields."""
    data = [("x", 1, "a", -10.0, 0), ("x", 2, "a", -5.0, 0), ("x", 3, "a", 4.0, 0), ("x", 3, "a", 5.0, 1), ("y", 1, "z", 1.0, 0)]
    cells = spark.createDataFrame(data, "entity string, year int, field_id string, value double, ordinal int")
    got = {r.year: (r.status, r.difference) for r in rules.validate(cells.where("ordinal = 0"), [rules.ChangeRule("c", ("a",))]).collect()}
    assert got == {1: ("not_applicable", None), 2: ("pass", -0.5), 3: ("warn", -1.8)}
    out = rules.validate(cells, [rules.SumRule("s", "a", ("b",)), rules.BoundRule("u", ("a",), "z")]).collect()
    assert {(r.entity, r.year, r.rule_id, tuple(r.missing)) for r in out if r.rule_id == "s"} == {("x", y, "s", ("b",)) for y in (1, 2, 3)} | {("y", 1, "s", ("a", "b"))}
    assert len([r for r in out if r.rule_id == "u"]) == 4 and all(r.status == "not_applicable" for r in out)
    same = rules.validate(cells.withColumn("field_id", F.lit("a")), [rules.BoundRule("u", ("a",), "a")]).where("year = 3").head()
    assert (same.status, same.difference) == ("pass", 0.0)


def test_numbers_and_units(spark):
    """Both marks, signs behind marks, folded digits; units with a prefix, the older sign for age, and the bare share."""
    texts = {"△-5": -5.0, "(-5)": -5.0, "△(5)": -5.0, "（１，２３４）": -1234.0, "▲": None, "()": None, "5%": 5.0, "１２．５": 12.5, "²": 2.0, "△△5": None, "1 234": 1234.0}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", E.parse_number(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == texts
    units = {"単位：百万円": "百万円", "才": "歳", "pure": "pure", "impure": None, "（％）": "%", "": None, "千円・円": "千円"}
    df = spark.createDataFrame([(t,) for t in units], "t string").select("t", E.normalize_unit(F.col("t")).alias("u"))
    assert {r.t: r.u for r in df.collect()} == units
