"""Queries on sections of texts and on tables that a text states line by line.

Sections are sought in the documents. Tables are written from order keys by expressions that Spark and DuckDB both run.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks, extract
from .base import query, spread, table
from .parsing import said

FOUND = blocks.Section("found", ("the ", "der "), ("and", "und", "est"), table_least=1, needs=("a", "e"), barred=("§", "%%%"), barred_chars=100, bonus=(("in", 4), ("zz", -6)), cap=3, least_score=4)
SECTION_SQL = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, w, unnest(string_split(t, w)) AS piece, generate_subscripts(string_split(t, w), 1) AS i, len(string_split(t, w)) AS n FROM d, (VALUES ('the '), ('der ')) v(w)),
c AS (SELECT doc_id, i, n, CAST(sum(length(piece)) OVER (PARTITION BY doc_id, w ORDER BY i) + (i - 1) * length(w) AS BIGINT) AS p FROM s),
g AS (SELECT DISTINCT doc_id, p FROM c WHERE i < n),
x AS (SELECT doc_id, p, greatest(p - 80, 0) AS a, least(p + 400, length(t)) AS b FROM g JOIN d USING (doc_id)),
r AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
l AS (SELECT *, sum(CASE WHEN a <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM r),
m AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM l GROUP BY doc_id, island),
w AS (SELECT m.doc_id, lang, source, a, regexp_replace(substr(t, a + 1, b - a), '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS win FROM m JOIN d USING (doc_id)),
k AS (SELECT *, regexp_replace(left(win, 1000), '[\s\x0b]+', '', 'g') AS sig FROM w),
u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, sig ORDER BY a) = 1),
o AS (SELECT *, contains(win, 'the ')::INT + contains(win, 'der ')::INT AS h, contains(win, 'and')::INT + contains(win, 'und')::INT + contains(win, 'est')::INT AS tw FROM u),
f AS (SELECT *, 3 * h + 2 * tw + CASE WHEN contains(win, 'in') THEN 4 ELSE 0 END - CASE WHEN contains(win, 'zz') THEN 6 ELSE 0 END AS score FROM o WHERE h > 0 AND tw >= 1 AND (contains(win, 'a') OR contains(win, 'e')) AND NOT regexp_matches(left(win, 100), '§|%%%'))"""


@query("section_text_windows", SECTION_SQL + " SELECT doc_id, a AS window_start, length(win) AS chars, score FROM f")
def section_text_windows(spark, sf):
    """Windows around heading words in every document, merged, without repeats, that meet the section's predicate."""
    docs = spread(table(spark, sf, "documents")).select("doc_id", "text")
    out = blocks.windows(docs, ["doc_id"], "text", FOUND, reach=400)
    return out.select("doc_id", F.col("window_start").cast("long").alias("window_start"), F.length("window").alias("chars"), blocks.score(F.col("window"), FOUND).alias("score"))


LOCATE_SQL = SECTION_SQL.replace("p - 80", "p - 1000").replace("p + 400", "p + 5000") + """,
z AS (SELECT * FROM f WHERE score >= 4 QUALIFY row_number() OVER (PARTITION BY lang, source, sig ORDER BY score DESC, doc_id, a) = 1)
SELECT doc_id, lang, source, score, length(win) AS chars FROM z QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY score DESC, doc_id, a) <= 3"""


@query("section_blocks", LOCATE_SQL)
def section_blocks(spark, sf):
    """The best three blocks of each language and source."""
    docs = spread(table(spark, sf, "documents")).select("doc_id", "lang", "source", "text")
    out = blocks.locate(docs.withColumn("_g", F.struct("lang", "source")), ["doc_id", "lang", "source"], ["lang", "source"], "text", [FOUND])
    return out.select("doc_id", "lang", "source", "score", F.length("window").alias("chars"))


A, B, C = "(500 + o_custkey % 1000)", "(100 + o_orderkey % 77)", "(150 + o_custkey % 90)"
X, Y, Z = "(700 + o_orderkey % 300)", "(200 + o_custkey % 50)", "(300 + o_orderkey % 40)"
S = "CAST({} AS STRING)"
#: Three rows of an order table by kind: with a sum column, without, broken, as dashes; the total is off for every third.
KIND = "o_orderkey % 4"
BUILD = f"CASE {KIND} WHEN 0 THEN {S.format(A)} || ' ' || {S.format(B)} || ' (1,234) ' || {S.format(f'{A} + {B}')} || ' ' || {S.format(C)} || ' ' || {S.format(f'{A} + {B} - {C}')} WHEN 1 THEN {S.format(A)} || ' ' || {S.format(B)} || ' ' || {S.format(C)} || ' ' || {S.format(f'{A} + {B} - {C}')} WHEN 2 THEN {S.format(A)} || ' ' || {S.format(B)} || ' 9,999 ' || {S.format(C)} || ' 8.5' ELSE '－ 12' END"
CIVIL = f"{S.format(X)} || ' ' || {S.format(Y)} || ' ' || {S.format(f'{X} + {Y}')} || ' ' || {S.format(Z)} || ' ' || {S.format(f'{X} + {Y} - {Z}')}"
OFF = "(CASE WHEN o_orderkey % 3 = 0 THEN 100 ELSE 0 END)"
TOTALS = [f"{A} + {X} + {OFF}", f"{B} + {Y}", f"{A} + {X} + {B} + {Y} + {OFF}", f"{C} + {Z}", f"{A} + {X} + {B} + {Y} - {C} - {Z} + {OFF}"]
TOTAL = " || ' ' || ".join(S.format(t) for t in TOTALS)
TABLE_TEXT = f"'受注高 当期 土木 ' || {CIVIL} || ' 建　築 工事 ' || {BUILD} || ' 合 計 ' || {TOTAL}"
TOKENS_SQL = f"""
WITH n AS (SELECT o_orderkey, 0 AS place, 'civil' AS label, [{X}, {Y}, {X} + {Y}, {Z}, {X} + {Y} - {Z}]::DOUBLE[] AS v FROM orders
  UNION ALL SELECT o_orderkey, 1, 'building', CASE {KIND} WHEN 0 THEN [{A}, {B}, {A} + {B}, {C}, {A} + {B} - {C}]::DOUBLE[] WHEN 1 THEN [{A}, {B}, {C}, {A} + {B} - {C}]::DOUBLE[] WHEN 2 THEN [{A}, {B}, 9999, {C}, 8.5]::DOUBLE[] ELSE []::DOUBLE[] END FROM orders
  UNION ALL SELECT o_orderkey, 2, 'total', [{', '.join(TOTALS)}]::DOUBLE[] FROM orders),
t AS (SELECT o_orderkey, place, label, unnest(v) AS value, generate_subscripts(v, 1) - 1 AS position FROM n),
q AS (SELECT *, lead(value) OVER w AS v1, lead(value, 2) OVER w AS v2, lead(value, 3) OVER w AS v3, lead(value, 4) OVER w AS v4 FROM t WINDOW w AS (PARTITION BY o_orderkey, place ORDER BY position)),
e AS (SELECT *, coalesce(abs(value + v1 - v2) <= greatest(1, abs(v2) * 0.005) AND abs(v2 - v3 - v4) <= greatest(1, abs(v4) * 0.005), false) AS five, coalesce(abs(value + v1 - v2 - v3) <= greatest(2, abs(v3) * 0.001), false) AS four FROM q),
h AS (SELECT *, bool_or(five) OVER (PARTITION BY o_orderkey, place) AS whole FROM e),
y AS (SELECT o_orderkey, place, label, position, value AS a, v1 AS b, CASE WHEN five THEN v2 END AS c, CASE WHEN five THEN v3 ELSE v2 END AS d, CASE WHEN five THEN v4 ELSE v3 END AS e FROM h WHERE five OR (NOT whole AND four))"""


def tuples(spark, sf):
    tokens = extract.labelled_numbers(said(spark, sf, f"{TABLE_TEXT} AS t"), ["o_orderkey"], "t")
    return extract.fitted_tuples(tokens, ["o_orderkey", "place", "label"])


@query("labelled_numbers", TOKENS_SQL + " SELECT o_orderkey, place, label, position, value FROM t")
def labelled_numbers(spark, sf):
    return extract.labelled_numbers(said(spark, sf, f"{TABLE_TEXT} AS t"), ["o_orderkey"], "t").select("o_orderkey", F.col("place").cast("int").alias("place"), "label", F.col("position").cast("long").alias("position"), "value")


@query("tuple_fit", TOKENS_SQL + " SELECT * FROM y")
def tuple_fit(spark, sf):
    """Rows of tables in texts: five numbers with both identities, else four without the sum, never across labels."""
    return tuples(spark, sf).withColumn("position", F.col("position").cast("long"))


@query("tuple_consistency", TOKENS_SQL + """,
b AS (SELECT *, lag(label) OVER w AS pl, lead(label) OVER w AS nl, abs(a + lag(a) OVER w - lead(a) OVER w) > greatest(1, abs(lead(a) OVER w) * 0.005) OR abs(b + lag(b) OVER w - lead(b) OVER w) > greatest(1, abs(lead(b) OVER w) * 0.005) OR coalesce(abs(c + lag(c) OVER w - lead(c) OVER w) > greatest(1, abs(lead(c) OVER w) * 0.005), false) OR abs(d + lag(d) OVER w - lead(d) OVER w) > greatest(1, abs(lead(d) OVER w) * 0.005) OR abs(e + lag(e) OVER w - lead(e) OVER w) > greatest(1, abs(lead(e) OVER w) * 0.005) AS off FROM y WINDOW w AS (PARTITION BY o_orderkey ORDER BY place, position)),
k AS (SELECT *, coalesce(label = 'building' AND pl = 'civil' AND nl = 'total' AND off, false) AS bad FROM b)
SELECT o_orderkey, place, position, NOT (bad OR coalesce(lag(bad) OVER w, false) OR coalesce(lead(bad) OVER w, false)) AS consistent FROM k WINDOW w AS (PARTITION BY o_orderkey ORDER BY place, position)""")
def tuple_consistency(spark, sf):
    out = extract.row_consistency(tuples(spark, sf), ["o_orderkey"])
    return out.select("o_orderkey", "place", F.col("position").cast("long").alias("position"), "consistent")


@query("inferred_values", TOKENS_SQL + """
SELECT o_orderkey, CASE WHEN c IS NOT NULL AND o_orderkey % 3 <> 0 THEN 'high_confidence' ELSE 'low_confidence' END AS status, CASE WHEN c IS NOT NULL AND o_orderkey % 3 <> 0 THEN e END AS value FROM y WHERE label = 'building'""")
def inferred_values(spark, sf):
    """The closing value of the building row of each text, sure where five numbers fit and the three rows add up."""
    fits = extract.row_consistency(tuples(spark, sf), ["o_orderkey"]).where("label = 'building'")
    found = fits.select("o_orderkey", F.col("e").alias("value"), F.col("c").isNotNull().alias("whole"), "consistent")
    return extract.classified(found, ["o_orderkey"])


LF = " || chr(10) || "
#: A text of lines: last year's and this year's building rows, a domestic one, with what a case adds.
ROWS_KIND = "o_custkey % 5"
NUMBERS = LF.join([S.format(A), S.format(B), S.format(f"{A} + {B}"), f"CASE WHEN {ROWS_KIND} = 1 THEN '99,999' ELSE {S.format(C)} END", S.format(f"{A} + {B} - {C}")])
LINES = LF.join(["'受注高 完成工事高 繰越'", "'前事業年度'", "'建 築 工 事'", "'単位：千円'", "'1,000'", "'△2,000'", "'3'", "'4'", "'5'", "'土木工事'", "'9'", "'当事業年度'", f"CASE WHEN {ROWS_KIND} = 2 THEN 'その他' ELSE '建築事業（注）' END",
                 f"CASE WHEN {ROWS_KIND} = 3 THEN '△7' || chr(10) ELSE '' END || {NUMBERS}", "'合計'", "'11'", "'国内建築'", "'－'", f"'(' || {S.format(B)} || ')'", "'12 345'", "'注'", "'6'"])


@query("table_rows_by_label", f"""
WITH k AS (SELECT o_orderkey, {ROWS_KIND} AS kind, {A} AS a, {B} AS b, {C} AS c FROM orders),
n AS (SELECT o_orderkey, CASE WHEN kind = 2 THEN 2 ELSE 12 END AS row, CASE WHEN kind = 2 THEN 'previous' ELSE 'current' END AS period,
  CASE WHEN kind = 2 THEN '1000.0 -2000.0 3.0 4.0 5.0' ELSE CASE WHEN kind = 3 THEN '-7.0 ' ELSE '' END || array_to_string([format('{{:.1f}}', CAST(x AS DOUBLE)) FOR x IN [a, b, a + b, CASE WHEN kind = 1 THEN 99999 ELSE c END, a + b - c]], ' ') END AS numbers FROM k)
SELECT * FROM n""")
def table_rows_by_label(spark, sf):
    """The building row of the current period in each text, else the last one."""
    found = blocks.current_row(blocks.labelled_rows(said(spark, sf, f"{LINES} AS t"), ["o_orderkey"], "t"), ["o_orderkey"])
    return found.select("o_orderkey", "row", "period", F.array_join(F.transform("values", lambda x: F.format_string("%.1f", x)), " ").alias("numbers"))


@query("table_order_fields", f"""
WITH k AS (SELECT o_orderkey, {ROWS_KIND} AS kind, {A} AS a, {B} AS b, {C} AS c FROM orders),
r AS (SELECT *, CASE WHEN kind = 2 THEN [1000, -2000, 3, 4, 5] ELSE [a, b, a + b, CASE WHEN kind = 1 THEN 99999 ELSE c END, a + b - c] END::DOUBLE[] AS v, abs(CASE WHEN kind = 2 THEN 1000 - 2000 - 4 - 5 WHEN kind = 1 THEN a + b - 99999 - (a + b - c) ELSE 0 END) <= 2 AS ok FROM k)
SELECT o_orderkey, unnest(['previous', 'orders', 'total', 'completed', 'next']) AS role, unnest(v) AS value, CASE WHEN ok THEN 0.9::DOUBLE ELSE 0.78::DOUBLE END AS confidence, NOT ok AS review_required FROM r""")
def table_order_fields(spark, sf):
    found = blocks.current_row(blocks.labelled_rows(said(spark, sf, f"{LINES} AS t"), ["o_orderkey"], "t"), ["o_orderkey"], 5)
    return blocks.order_fields(found, ["o_orderkey"])


@query("table_domestic_rows", f"SELECT o_orderkey, 'current' AS period, '-|' || format('{{:.1f}}', CAST(-{B} AS DOUBLE)) || '|12345.0' AS numbers FROM orders")
def table_domestic_rows(spark, sf):
    """The domestic building row: a dash is a null, parentheses are minus, blanks in digits go, other text ends the run."""
    found = blocks.labelled_rows(said(spark, sf, f"{LINES} AS t"), ["o_orderkey"], "t", blocks.DOMESTIC, blocks.DOMESTIC_STARTS)
    return found.select("o_orderkey", "period", F.array_join(F.transform("values", lambda x: F.when(x.isNull(), "-").otherwise(F.format_string("%.1f", x))), "|").alias("numbers"))


G, PR, OV = "CAST(o_custkey % 400 AS DOUBLE)", "CAST(o_orderkey % 900 AS DOUBLE)", "CAST(o_custkey % 30 AS DOUBLE)"


@query("customer_breakdowns", f"""
WITH k AS (SELECT o_orderkey, o_orderkey % 5 AS kind, {G} AS g, {PR} AS p, {OV} AS o FROM orders),
v AS (SELECT *, CASE kind WHEN 0 THEN [g, p, o, g + p + o] WHEN 1 THEN [g, p, NULL, 5, g + p] WHEN 2 THEN [g, p, o, 1, 2, g + p + o + 1] WHEN 3 THEN [g, p, g + p + 50] ELSE [g, p] END AS v FROM k),
b AS (SELECT *, len(v) >= 4 AS four, g + p + coalesce(v[3], 0) AS added FROM v),
c AS (SELECT *, CASE WHEN four THEN coalesce([x FOR x IN v[4:6] IF x IS NOT NULL AND abs(x - added) <= greatest(2, abs(added) * 0.001)][1], v[4]) END AS total FROM b)
SELECT o_orderkey, CASE WHEN four THEN coalesce(v[3], 0) END AS overseas, total,
  CASE kind WHEN 0 THEN 'three' WHEN 1 THEN 'two' WHEN 2 THEN 'three' ELSE '' END AS with_overseas,
  CASE WHEN kind = 4 THEN '' WHEN len([x FOR x IN v[3:5] IF x IS NOT NULL AND abs(x - g - p) <= greatest(2, abs(g + p) * 0.001)]) > 0 THEN 'two' ELSE '' END AS without_overseas FROM c""")
def customer_breakdowns(spark, sf):
    made = f"CASE o_orderkey % 5 WHEN 0 THEN array({G}, {PR}, {OV}, {G} + {PR} + {OV}) WHEN 1 THEN array({G}, {PR}, NULL, 5D, {G} + {PR}) WHEN 2 THEN array({G}, {PR}, {OV}, 1D, 2D, {G} + {PR} + {OV} + 1) WHEN 3 THEN array({G}, {PR}, {G} + {PR} + 50) ELSE array({G}, {PR}) END"
    rows = table(spark, sf, "orders").select("o_orderkey", F.expr(made).alias("v"))
    orders, yes, no = blocks.order_breakdown(F.col("v")), blocks.customer_breakdown(F.col("v"), F.lit(True)), blocks.customer_breakdown(F.col("v"), F.lit(False))
    said_ = lambda c: F.when(c.isNull(), "").when(c["overseas"].isNull(), "two").otherwise("three")
    return rows.select("o_orderkey", orders.alias("x"), said_(yes).alias("with_overseas"), said_(no).alias("without_overseas")).select("o_orderkey", "x.overseas", "x.total", "with_overseas", "without_overseas")


@query("contract_shares", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN CAST(o_custkey % 100 AS DOUBLE) END AS special FROM orders")
def contract_shares(spark, sf):
    """Shares that make up the whole within 0.2, are off by one, or lack a number."""
    s = "CAST(o_custkey % 100 AS DOUBLE)"
    made = f"CASE o_orderkey % 4 WHEN 0 THEN array({s}, 100 - {s}, 100D) WHEN 1 THEN array({s}, 100.1 - {s}, 100D) WHEN 2 THEN array({s}, 101 - {s}, 100D) ELSE array({s}, NULL, 100D) END"
    rows = table(spark, sf, "orders").select("o_orderkey", blocks.contract_shares(F.expr(made)).alias("x"))
    return rows.select("o_orderkey", "x.special")


HINTS = LF.join(["'従業員の状況'", "CASE o_orderkey % 4 WHEN 0 THEN '平均年齢（歳） 41.5 平均勤続年数 ' || CAST(o_custkey % 40 AS STRING) WHEN 1 THEN '平均年齢' WHEN 2 THEN '平均年齢 平均勤続年数 17.5' ELSE '平均勤続年数 該当なし' END", "'（注）'", "CASE WHEN o_orderkey % 4 = 1 THEN '38.2' ELSE '平均年齢 44.4' END", "'研究開発費'", "CAST(o_custkey AS STRING) || '百万円 (999)'"])


@query("hint_values", """
WITH k AS (SELECT o_orderkey, o_orderkey % 4 AS kind, o_custkey FROM orders)
SELECT o_orderkey, 'average_age' AS field_id, CAST(CASE kind WHEN 0 THEN 41.5 WHEN 1 THEN 38.2 ELSE 44.4 END AS DOUBLE) AS value FROM k
UNION ALL SELECT o_orderkey, 'average_tenure', CASE kind WHEN 0 THEN o_custkey % 40 WHEN 2 THEN 17.5 ELSE 0 END FROM k WHERE kind <> 1
UNION ALL SELECT o_orderkey, 'research', o_custkey FROM k""")
def hint_values(spark, sf):
    """Values behind labels on a line, on a line below, or stated as none."""
    out = blocks.hint_values(said(spark, sf, f"{HINTS} AS t"), ["o_orderkey"], "t", {"average_age": ["平均年齢（歳）", "平均年齢"], "average_tenure": ["平均勤続年数"], "research": ["研究開発費"]})
    return out.select("o_orderkey", "field_id", "value")


SEG = LF.join(["'受注実績 セグメントの名称'", "'建築事業 ' || CAST(5000 + o_custkey AS STRING) || ' 12.5 ' || CAST(7000 + o_orderkey % 100 AS STRING)", "'土木事業'", "'1,200'", "'3,400'", "'国内建築 900 1,000'", "'当社(建築事業)の受注高は ' || CAST(o_custkey AS STRING) || ' 億円。(土木事業)は別。受注高は 77 億円'"])


@query("segment_order_rows", "SELECT o_orderkey, 'segment_orders_building' AS field_id, CAST(7000 + o_orderkey % 100 AS DOUBLE) AS value FROM orders UNION ALL SELECT o_orderkey, 'segment_orders_civil', 3400 FROM orders")
def segment_order_rows(spark, sf):
    return blocks.segment_orders(said(spark, sf, f"{SEG} AS t"), ["o_orderkey"], "t", {"建築事業": "segment_orders_building", "土木事業": "segment_orders_civil"}).select("o_orderkey", "field_id", "value")


@query("segment_order_narrative", "SELECT o_orderkey, 'segment_orders_building' AS field_id, CAST(o_custkey AS DOUBLE) AS value FROM orders")
def segment_order_narrative(spark, sf):
    """The civil sentence ends before its amount."""
    return blocks.segment_narrative(said(spark, sf, f"{SEG} AS t"), ["o_orderkey"], "t", {"建築事業": "segment_orders_building", "土木事業": "segment_orders_civil"})


@query("value_units_and_scopes", """
WITH k AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '単位：千円' WHEN 1 THEN '売上' WHEN 2 THEN '（％）' ELSE '' END AS line, CASE o_custkey % 3 WHEN 0 THEN '表 百万円 連結' WHEN 1 THEN '提出会社 連結' ELSE '' END AS segment, CASE o_custkey % 2 WHEN 0 THEN '億円' ELSE '' END AS hint FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '千円' WHEN contains(segment, '百万円') THEN '百万円' WHEN hint <> '' THEN hint ELSE '百万円' END AS unit,
  CASE WHEN segment = '' THEN 'whole' WHEN contains(segment, '提出会社') THEN 'standalone' ELSE 'consolidated' END AS scope_alone_first, CASE WHEN segment = '' THEN 'whole' ELSE 'consolidated' END AS scope_whole_first FROM k""")
def value_units_and_scopes(spark, sf):
    rows = said(spark, sf, "CASE o_orderkey % 4 WHEN 0 THEN '単位：千円' WHEN 1 THEN '売上' WHEN 2 THEN '（％）' ELSE '' END AS line", "CASE o_custkey % 3 WHEN 0 THEN '表 百万円 連結' WHEN 1 THEN '提出会社 連結' ELSE '' END AS segment", "CASE o_custkey % 2 WHEN 0 THEN '億円' ELSE '' END AS hint")
    line, segment, hint = F.col("line"), F.col("segment"), F.col("hint")
    scope = lambda first: blocks.value_scope(line, segment, F.lit("whole"), F.lit(first))
    return rows.select("o_orderkey", blocks.amount_unit(line, segment, hint).alias("unit"), scope(True).alias("scope_alone_first"), scope(False).alias("scope_whole_first"))
