"""Queries on parsed labels, numbers, units and periods, and on rows in normal form.

The test tables hold no such texts, so each query writes them from the keys of orders (or customers, parts) by an
expression that Spark and DuckDB both run; what is read out of the texts is stated twice, in the library and in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import parsing as P
from ..operators import normalize, tables
from .base import query, spread, table


def said(spark, sf, *columns: str, source: str = "orders", keys: tuple[str, ...] = ("o_orderkey",)):
    """The keys of a table with texts made from them."""
    return spread(table(spark, sf, source)).select(*keys, *[F.expr(c) for c in columns])


N = "CAST(o_custkey AS STRING)"
WIDE = "translate({}, '0123456789().,-+%', '０１２３４５６７８９（）．，－＋％')"
RAW = f"""CASE o_orderkey % 16 WHEN 0 THEN {N} WHEN 1 THEN '△' || {N} WHEN 2 THEN '△-' || {N} WHEN 3 THEN '(-' || {N} || ')' WHEN 4 THEN '△(' || {N} || ')'
  WHEN 5 THEN {WIDE.format(f"'(' || {N} || ')'")} WHEN 6 THEN {N} || ' %' WHEN 7 THEN '－' WHEN 8 THEN 'abc' || {N} WHEN 9 THEN '+' || {N} || '.5' WHEN 10 THEN '  ' || {N} || '  '
  WHEN 11 THEN {WIDE.format(f"'-' || {N} || '.25%'")} WHEN 12 THEN '1,' || right('000' || {N}, 3) || ',000' WHEN 13 THEN '△' WHEN 14 THEN 'N/A' ELSE '△△' || {N} END"""
#: The rules, step by step: fold, trim, one triangle, one pair of parentheses, marks out, digits.
NUMBER_SQL = f"""
WITH r AS (SELECT o_orderkey, {RAW} AS raw FROM orders),
a AS (SELECT *, trim(translate(raw, '０１２３４５６７８９（）．，－＋％', '0123456789().,-+%')) AS t FROM r),
b AS (SELECT *, CASE WHEN left(t, 1) IN ('△', '▲') THEN t[2:] ELSE t END AS u FROM a),
c AS (SELECT *, CASE WHEN u LIKE '(%)' THEN u[2:len(u) - 1] ELSE u END AS w FROM b),
d AS (SELECT *, replace(replace(replace(w, ',', ''), ' ', ''), '%', '') AS x, w <> u OR u <> t AS negative FROM c),
n AS (SELECT *, CASE WHEN t NOT IN ('', '-', 'N/A') AND regexp_full_match(x, '[+-]?\\d+(\\.\\d+)?') THEN CASE WHEN negative THEN -abs(CAST(x AS DOUBLE)) ELSE CAST(x AS DOUBLE) END END AS value FROM d)
"""


@query("locale_number_parse", NUMBER_SQL + "SELECT o_orderkey, raw, value FROM n")
def locale_number_parse(spark, sf):
    return said(spark, sf, f"{RAW} AS raw").withColumn("value", E.parse_number(F.col("raw")))


UNIT = "CASE o_orderkey % 17 WHEN 0 THEN '単位：百万円' WHEN 1 THEN '千円' WHEN 2 THEN '（億円）' WHEN 3 THEN '円' WHEN 4 THEN '％' WHEN 5 THEN 'pure' WHEN 6 THEN 'impure' WHEN 7 THEN '才' WHEN 8 THEN '歳' WHEN 9 THEN '年' WHEN 10 THEN '人' WHEN 11 THEN '単位:円' WHEN 12 THEN 'USD' WHEN 13 THEN ' PURE ' WHEN 14 THEN '' WHEN 15 THEN '単位：％' END"
TARGET = "CASE o_custkey % 6 WHEN 0 THEN '百万円' WHEN 1 THEN '円' WHEN 2 THEN '歳' WHEN 3 THEN '%' WHEN 4 THEN '人' ELSE '年' END"
UNIT_SQL = """CASE WHEN unit IS NULL THEN NULL WHEN contains(unit, '％') OR contains(unit, '%') THEN '%' WHEN lower(trim(unit)) = 'pure' THEN 'pure' WHEN regexp_matches(unit, '歳|才') THEN '歳'
  WHEN contains(unit, '百万円') THEN '百万円' WHEN contains(unit, '千円') THEN '千円' WHEN contains(unit, '億円') THEN '億円' WHEN contains(unit, '円') THEN '円' WHEN contains(unit, '人') THEN '人' WHEN contains(unit, '年') THEN '年' END"""
CONVERT_SQL = """CASE WHEN own = target THEN value WHEN own IN ('年', '歳') AND target IN ('年', '歳') THEN value
  WHEN own IN ('円', '千円', '百万円', '億円') AND target IN ('円', '百万円') THEN value * CASE own WHEN '円' THEN 1e-6 WHEN '千円' THEN 1e-3 WHEN '百万円' THEN 1 ELSE 100 END / CASE target WHEN '円' THEN 1e-6 ELSE 1 END
  WHEN own = 'pure' AND target = '%' THEN value * 100 END"""


@query("unit_conversion", f"""
WITH r AS (SELECT o_orderkey, o_totalprice AS value, {UNIT} AS unit, {TARGET} AS target FROM orders), u AS (SELECT *, {UNIT_SQL} AS own FROM r)
SELECT o_orderkey, unit, target, own, {CONVERT_SQL} AS converted FROM u""")
def unit_conversion(spark, sf):
    rows = said(spark, sf, "o_totalprice AS value", f"{UNIT} AS unit", f"{TARGET} AS target")
    return rows.select("o_orderkey", "unit", "target", E.normalize_unit(F.col("unit")).alias("own"), E.convert_unit(F.col("value"), F.col("unit"), F.col("target")).alias("converted"))


SCOPE = "CASE o_orderkey % 4 WHEN 0 THEN 'standalone' WHEN 1 THEN 'consolidated' WHEN 2 THEN '' END"
OLD = "CASE o_custkey % 5 WHEN 0 THEN 'unit_unknown;kept' WHEN 1 THEN 'kept' WHEN 2 THEN ';' END"


@query("row_normalizer", NUMBER_SQL.rstrip() + f""",
x AS (SELECT n.*, {UNIT.replace('o_orderkey', 'n.o_orderkey')} AS unit, {TARGET} AS target, {SCOPE.replace('o_orderkey', 'n.o_orderkey')} AS scope, {OLD} AS old FROM n JOIN orders ON n.o_orderkey = orders.o_orderkey),
u AS (SELECT *, {UNIT_SQL} AS own FROM x),
v AS (SELECT o_orderkey, raw, value AS parsed, {CONVERT_SQL} AS converted, own, target, scope, old FROM u),
w AS (SELECT *, CASE WHEN converted IS NOT NULL THEN target ELSE own END AS unit_normalized FROM v),
y AS (SELECT *, [z FOR z IN list_concat([z FOR z IN string_split(coalesce(old, ''), ';') IF z <> ''], [CASE WHEN parsed IS NULL AND raw <> '' THEN 'number_parse_failed' END, CASE WHEN converted IS NULL AND parsed IS NOT NULL THEN 'unit_conversion_failed' END,
  CASE WHEN unit_normalized IS NULL AND parsed IS NOT NULL THEN 'unit_unknown' END, CASE WHEN scope IN ('standalone', 'consolidated') AND scope <> 'standalone' THEN 'data_scope_mismatch' END]) IF z IS NOT NULL] AS why FROM w)
SELECT o_orderkey, converted AS value, unit_normalized, array_to_string([z FOR z, i IN why IF list_position(why, z) = i], ';') AS review_reason, len(why) > 0 AS review_required FROM y""")
def row_normalizer(spark, sf):
    rows = said(spark, sf, f"{RAW} AS value_raw", f"{UNIT} AS unit_raw", f"{TARGET} AS target_unit", f"{SCOPE} AS data_scope", "'standalone' AS wanted_scope", f"{OLD} AS review_reason")
    return normalize.extraction(rows).select("o_orderkey", "value", "unit_normalized", "review_reason", "review_required")


HEADING = """CASE o_orderkey % 9 WHEN 0 THEN CAST(2000 + o_custkey % 30 AS STRING) || '年' || CAST(1 + o_custkey % 12 AS STRING) || '月期 第1四半期' WHEN 1 THEN CAST(2000 + o_custkey % 30 AS STRING) || '年度 中間'
  WHEN 2 THEN 'FY' || CAST(2000 + o_custkey % 30 AS STRING) || ' 通期' WHEN 3 THEN '第3四半期' WHEN 4 THEN '昭和60年' WHEN 5 THEN CAST(2000 + o_custkey % 30 AS STRING) || '年 ' || CAST(1 + o_custkey % 12 AS STRING) || '月期 第4四半期'
  WHEN 6 THEN '第2四半期 ' || CAST(1990 + o_custkey % 9 AS STRING) WHEN 7 THEN '' END"""


@query("heading_periods", f"""
WITH r AS (SELECT o_orderkey, coalesce({HEADING}, '') AS h FROM orders),
m AS (SELECT *, regexp_extract(h, '(20\\d\\d)年\\s*(\\d{{1,2}})月期', ['y', 'm']) AS t, regexp_extract(h, '(20\\d\\d)年度', 1) AS f, regexp_extract(h, '20\\d\\d') AS b FROM r)
SELECT o_orderkey, CASE WHEN t.y <> '' THEN CAST(try_cast(t.y AS INT) - (try_cast(t.m AS INT) <= 3)::INT AS VARCHAR) WHEN f <> '' THEN f ELSE b END AS year,
  CASE WHEN t.y <> '' THEN t.y || '年' || CAST(try_cast(t.m AS INT) AS VARCHAR) || '月期' WHEN f <> '' THEN f || '年度' ELSE b END AS label,
  CASE WHEN contains(h, '第1四半期') THEN 'q1' WHEN regexp_matches(h, '第2四半期|中間') THEN 'q2' WHEN contains(h, '第3四半期') THEN 'q3' WHEN regexp_matches(h, '第4四半期|通期') THEN 'annual' ELSE 'document' END AS period_type FROM m""")
def heading_periods(spark, sf):
    h = said(spark, sf, f"{HEADING} AS h")
    return h.select("o_orderkey", P.fiscal_period(F.col("h")).alias("p"), P.period_type(F.col("h")).alias("period_type")).select("o_orderkey", "p.year", "p.label", "period_type")


@query("chart_periods", f"""
WITH r AS (SELECT o_orderkey, o_orderkey % 3 = 0 AS forecast, CASE o_orderkey % 4 WHEN 0 THEN '20' || right(CAST(o_custkey + 100 AS VARCHAR), 2) || '0331' WHEN 1 THEN '20' || right(CAST(o_custkey + 100 AS VARCHAR), 2) || '1231' WHEN 2 THEN 'latest' ELSE '' END AS c FROM orders),
m AS (SELECT *, try_cast(c[1:4] AS INT) AS y, try_cast(c[5:6] AS INT) AS m FROM r)
SELECT o_orderkey, CASE WHEN y IS NULL THEN c ELSE CAST(CASE WHEN m <= 3 THEN y - 1 ELSE y END AS VARCHAR) END AS year, CASE WHEN m = 3 THEN y || '-03-31' ELSE '' END AS year_end,
  CASE WHEN forecast THEN 'forecast_annual' ELSE 'annual' END AS period_type, CASE WHEN y IS NULL THEN c ELSE y || '年' || m || '月期' || CASE WHEN forecast THEN '予想' ELSE '' END END AS label FROM m""")
def chart_periods(spark, sf):
    tail = "right(CAST(o_custkey + 100 AS STRING), 2)"
    rows = said(spark, sf, "o_orderkey % 3 = 0 AS forecast", f"CASE o_orderkey % 4 WHEN 0 THEN '20' || {tail} || '0331' WHEN 1 THEN '20' || {tail} || '1231' WHEN 2 THEN 'latest' ELSE '' END AS c")
    return rows.select("o_orderkey", P.chart_period(F.col("c"), F.col("forecast")).alias("p")).select("o_orderkey", "p.*")


NOTE = "CASE o_orderkey % 5 WHEN 0 THEN CAST(1990 + o_custkey % 30 AS STRING) WHEN 1 THEN ' ' || CAST(1990 + o_custkey % 30 AS STRING) || '(' || CAST(1 + o_custkey % 12 AS STRING) || ') ' WHEN 2 THEN '12(3)' WHEN 3 THEN '1999(123)' END"
STAMP = "CASE o_orderkey % 6 WHEN 0 THEN '2024-05-0' || CAST(1 + o_custkey % 9 AS STRING) || 'T10:20:30Z' WHEN 1 THEN '2024-05-06T10:20:30+09:00' WHEN 2 THEN '2024-05-06T10:20:3' || CAST(o_custkey % 10 AS STRING) WHEN 3 THEN '2024-05-06' WHEN 4 THEN 'soon' ELSE '' END"


@query("note_periods_and_times", f"""
WITH r AS (SELECT o_orderkey, {NOTE} AS n, {STAMP} AS s FROM orders), m AS (SELECT *, regexp_extract(n, '^\\s*(\\d{{4}})(?:\\((\\d{{1,2}})\\))?\\s*$', ['y', 'm']) AS p FROM r)
SELECT o_orderkey, try_cast(p.y AS INT) AS year, try_cast(p.m AS INT) AS month, CAST(epoch(CASE WHEN s LIKE '%Z' THEN CAST(left(s, 19) AS TIMESTAMP) WHEN s LIKE '%+09:00' THEN CAST(left(s, 19) AS TIMESTAMP) - INTERVAL 9 HOUR ELSE try_cast(s AS TIMESTAMP) END) AS BIGINT) AS seconds FROM m""")
def note_periods_and_times(spark, sf):
    rows = said(spark, sf, f"{NOTE} AS n", f"{STAMP} AS s")
    return rows.select("o_orderkey", P.note_period(F.col("n")).alias("p"), P.utc_time(F.col("s")).alias("seconds")).select("o_orderkey", "p.year", "p.month", "seconds")


AMOUNT = f"CASE o_orderkey % 9 WHEN 0 THEN {N} WHEN 1 THEN '1,' || right('000' || {N}, 3) WHEN 2 THEN '△' || {N} || '円' WHEN 3 THEN {N} || '.12345678' WHEN 4 THEN '' WHEN 5 THEN 'nan' WHEN 6 THEN '-' || {N} WHEN 7 THEN {N} || '.9' ELSE 'x' END"
MONEY_UNIT = "CASE o_custkey % 7 WHEN 0 THEN '億円' WHEN 1 THEN '百万円' WHEN 2 THEN '千円' WHEN 3 THEN '万円' WHEN 4 THEN '円' WHEN 5 THEN '%' END"
SPLIT = f"CASE o_orderkey % 6 WHEN 0 THEN '2:1' WHEN 1 THEN '1:' || {N} WHEN 2 THEN '1:0' WHEN 3 THEN '1.5' WHEN 4 THEN 'a:b' END"


@query("amounts_and_ratios", f"""
WITH r AS (SELECT o_orderkey, {AMOUNT} AS a, {MONEY_UNIT} AS u, {SPLIT} AS s, floor(o_totalprice) AS p FROM orders),
k AS (SELECT *, CASE WHEN a IN ('', 'nan') THEN NULL ELSE try_cast(replace(regexp_replace(replace(a, '△', '-'), '[^0-9.\\-]', '', 'g'), ',', '') AS DOUBLE) END AS loose, CASE WHEN a IN ('', 'nan') THEN NULL ELSE try_cast(replace(a, ',', '') AS DOUBLE) END AS plain FROM r)
SELECT o_orderkey, round(loose, 6) + 0.0 AS clean, plain, CAST(trunc(plain) AS BIGINT) AS whole, try_cast(replace(replace(a, ',', ''), '△', '-') AS DOUBLE) AS fact,
  CASE u WHEN '億円' THEN round(loose * 100, 6) + 0.0 WHEN '百万円' THEN loose + 0.0 WHEN '千円' THEN round(loose / 1000, 6) WHEN '万円' THEN round(loose / 100, 6) WHEN '円' THEN round(loose / 1000000, 6) END AS millions,
  CASE WHEN contains(s, ':') THEN try_cast(split_part(s, ':', 1) AS DOUBLE) / nullif(try_cast(split_part(s, ':', 2) AS DOUBLE), 0) ELSE try_cast(s AS DOUBLE) END AS ratio,
  CASE WHEN u = '%' THEN p WHEN u IS NULL OR u = '百万円' THEN round(p / 1000000, 6) ELSE p END AS comparable FROM k""")
def amounts_and_ratios(spark, sf):
    rows = said(spark, sf, f"{AMOUNT} AS a", f"{MONEY_UNIT} AS u", f"{SPLIT} AS s", "CAST(floor(o_totalprice) AS DOUBLE) AS p")
    a, u = F.col("a"), F.col("u")
    return rows.select(
        "o_orderkey", P.clean_number(a).alias("clean"), P.plain_number(a).alias("plain"), P.whole_number(P.plain_number(a)).alias("whole"), P.fact_number(F.when(a == "nan", "").otherwise(a)).alias("fact"),
        P.million(a, u).alias("millions"), P.split_ratio(F.col("s")).alias("ratio"), P.comparable(F.col("p"), u, u).alias("comparable"),
    )


NAME = "CASE c_custkey % 6 WHEN 0 THEN '株式会社' || c_name WHEN 1 THEN c_name || '（株）' WHEN 2 THEN '(株) ' || c_name || '．' WHEN 3 THEN '㈱ ' || c_name || '・' WHEN 4 THEN ' ' || c_name || ' ' ELSE c_name || '.' END"
CONTEXT = "CASE c_custkey % 4 WHEN 0 THEN 'CurrentYearDuration' WHEN 1 THEN 'CurrentYearInstant_NonConsolidatedMember' WHEN 2 THEN 'Prior1YearDuration_A_B' ELSE '_x' END"
HINT = "CASE c_custkey % 9 WHEN 0 THEN '提出会社の状況（百万円）' WHEN 1 THEN '連結、単位：千円' WHEN 2 THEN 'セグメント 億円' WHEN 3 THEN 'グループ %' WHEN 4 THEN '従業員数（人）' WHEN 5 THEN '当社 連結 円' WHEN 6 THEN '売上_単独' WHEN 7 THEN 'none' END"


@query("names_contexts_hints", f"""
WITH r AS (SELECT c_custkey, {NAME} AS n, {CONTEXT} AS c, coalesce({HINT}, '') AS h FROM customer)
SELECT c_custkey, regexp_replace(trim(n), '株式会社|（株）|\\(株\\)|㈱|[ 　・.．]', '', 'g') AS name, CASE WHEN contains(c, '_') THEN substr(c, instr(c, '_') + 1) ELSE '' END AS after_first, string_split(c, '_')[-1] AS after_last,
  regexp_extract(h, '百万円') || CASE WHEN contains(h, '百万円') THEN '' WHEN contains(h, '千円') THEN '千円' WHEN contains(h, '億円') THEN '億円' WHEN contains(h, '円') THEN '円' WHEN contains(h, '%') THEN '%' WHEN contains(h, '人') THEN '人' ELSE '' END AS unit_hint,
  CASE WHEN regexp_matches(h, '単独|提出会社|当社') THEN 'standalone' WHEN regexp_matches(h, '連結|グループ') THEN 'consolidated' WHEN contains(h, 'セグメント') THEN 'segment' ELSE 'unknown' END AS scope_hint,
  CASE WHEN contains(h, '単独') THEN 'standalone' WHEN contains(h, '連結') THEN 'consolidated' WHEN contains(h, 'セグメント') THEN 'segment' ELSE '' END AS concept_scope FROM r""")
def names_contexts_hints(spark, sf):
    rows = said(spark, sf, f"{NAME} AS n", f"{CONTEXT} AS c", f"{HINT} AS h", source="customer", keys=("c_custkey",))
    return rows.select("c_custkey", P.company_name(F.col("n")).alias("name"), P.after_first(F.col("c")).alias("after_first"), P.after_last(F.col("c")).alias("after_last"), P.unit_hint(F.col("h")).alias("unit_hint"), P.scope_hint(F.col("h")).alias("scope_hint"), P.concept_scope(F.col("h")).alias("concept_scope"))


RUN = f"""CASE o_orderkey % 8 WHEN 0 THEN '計 ' || {N} || ' ［999］ 1,234 △56' WHEN 1 THEN {N} || ' 45.5 ' || {N} || '00 50.1' WHEN 2 THEN '(1,000) 2,000 3,000' WHEN 3 THEN '50.1 2,345.6' WHEN 4 THEN 'なし' WHEN 5 THEN '１２，３４５ ６７８'
  WHEN 6 THEN '1, 234 5' ELSE '12.5 ' || {N} || '000 30' END"""


@query("amount_runs", f"""
WITH r AS (SELECT o_orderkey, translate({RUN}, '０１２３４５６７８９，［］', '0123456789,[]') AS t FROM orders),
s AS (SELECT *, regexp_replace(regexp_replace(t, '\\[\\s*[+-]?\\d[\\d,\\s.]*\\s*\\]', ' ', 'g'), '\\(\\s*\\d[\\d,\\s.]*\\)', ' ', 'g') AS u FROM r),
v AS (SELECT *, [CAST(replace(replace(replace(x, ',', ''), ' ', ''), '△', '-') AS DOUBLE) FOR x IN regexp_extract_all(u, '△?\\d{{1,3}}(?:,\\s?\\d{{3}})+(?:\\.\\d+)?|△?\\d+(?:\\.\\d+)?')] AS v FROM s),
w AS (SELECT *, len(v) AS n, [x FOR x IN v IF abs(x) <= 1000] AS small FROM v)
SELECT o_orderkey, array_to_string([format('{{:.3f}}', x) FOR x IN v], ' ') AS numbers,
  CASE WHEN n = 0 THEN NULL WHEN n >= 4 AND abs(v[2]) <= 100 AND abs(v[4]) <= 100 AND (abs(v[1]) > 100 OR abs(v[3]) > 100) THEN v[3] ELSE v[n] END AS current_amount,
  CASE WHEN n = 0 THEN NULL WHEN len(small) > 0 THEN small[len(small)] ELSE v[n] END AS current_share FROM w""")
def amount_runs(spark, sf):
    rows = said(spark, sf, f"{RUN} AS t").select("o_orderkey", P.amounts(F.col("t")).alias("v"))
    numbers = F.array_join(F.transform("v", lambda x: F.format_string("%.3f", x)), " ")
    return rows.select("o_orderkey", numbers.alias("numbers"), tables.current_value(F.col("v"), F.lit(False)).alias("current_amount"), tables.current_value(F.col("v"), F.lit(True)).alias("current_share"))


FIELD = "CASE o_custkey % 5 WHEN 0 THEN 'average_age' WHEN 1 THEN 'average_tenure' WHEN 2 THEN 'average_salary' WHEN 3 THEN 'employees_standalone' ELSE 'total' END"


@query("plausible_values", f"""
WITH r AS (SELECT o_orderkey, {FIELD} AS f, CASE o_orderkey % 3 WHEN 0 THEN '百万円' WHEN 1 THEN '円' ELSE '' END AS u, (o_orderkey % 240) - 20 AS v FROM orders)
SELECT o_orderkey, f, CASE f WHEN 'average_age' THEN v >= 10 AND v <= 100 WHEN 'average_tenure' THEN v >= 0 AND v <= 80 WHEN 'average_salary' THEN CASE WHEN u = '百万円' THEN v >= 1 ELSE v >= 100 END WHEN 'employees_standalone' THEN v >= 0 ELSE true END AS plausible FROM r""")
def plausible_values(spark, sf):
    rows = said(spark, sf, f"{FIELD} AS f", "CASE o_orderkey % 3 WHEN 0 THEN '百万円' WHEN 1 THEN '円' ELSE '' END AS u", "(o_orderkey % 240) - 20 AS v")
    return rows.select("o_orderkey", "f", P.plausible(F.col("f"), F.col("v"), F.col("u")).alias("plausible"))


CTX = "CASE o_orderkey % 8 WHEN 0 THEN 'CurrentYearDuration' WHEN 1 THEN 'CurrentYearDuration_NonConsolidatedMember' WHEN 2 THEN 'CurrentYearDuration_ConsolidatedMember' WHEN 3 THEN 'CurrentYearInstant' WHEN 4 THEN 'FilingDateInstant' WHEN 5 THEN 'CurrentYTDDuration' WHEN 6 THEN 'Prior1YearDuration' ELSE 'CurrentYearDuration_Row1Member' END"
REL = "CASE o_custkey % 4 WHEN 0 THEN '当期' WHEN 1 THEN '前期' WHEN 2 THEN '当中間期' ELSE '' END"
PER = "CASE o_custkey % 3 WHEN 0 THEN '期間' WHEN 1 THEN '時点' ELSE '' END"
SC = "CASE o_custkey % 5 WHEN 0 THEN '連結' WHEN 1 THEN '個別' WHEN 2 THEN '単独' ELSE 'その他' END"
#: The tests for the token lists of the query, each written out by hand from the rules.
CUR, ANN = "(contains(rel, '当期') OR contains(rel, '当年度') OR contains(rel, '当四半期') OR contains(rel, '当中間'))", "(contains(rel, '当期') OR contains(rel, '当年度'))"


@query("context_filters", f"""
WITH r AS (SELECT o_orderkey, {CTX} AS c, {REL} AS rel, {PER} AS per, CASE WHEN {SC} = '連結' THEN 'consolidated' WHEN {SC} IN ('個別', '単独') THEN 'standalone' END AS sc FROM orders)
SELECT o_orderkey, starts_with(c, 'CurrentYearDuration') OR ({CUR} AND per = '期間') AS duration,
  c = 'CurrentYearDuration_NonConsolidatedMember' AS alone,
  c IN ('CurrentYearDuration', 'CurrentYearDuration_ConsolidatedMember') AS consolidated,
  starts_with(c, 'CurrentYTDDuration') OR ({CUR} AND per = '期間') AS half_year,
  starts_with(c, 'CurrentYearInstant') OR ({ANN} AND per = '時点') AS annual_instant,
  coalesce(sc = 'standalone', false) OR contains(c, 'StandaloneMember') AS standalone FROM r""")
def context_filters(spark, sf):
    rows = said(spark, sf, f"{CTX} AS c", f"{REL} AS rel", f"{PER} AS per", f"{SC} AS sc")
    tokens = lambda *t: F.array(*map(F.lit, t))
    fits = lambda t, annual=False: P.context_fits(F.col("c"), F.col("rel"), F.col("per"), P.fact_scope(F.col("sc")), t, annual)
    half = P.half_year_tokens(tokens("CurrentYearDuration"), F.lit("semiannual_h1"))
    return rows.select(
        "o_orderkey", fits(tokens("CurrentYearDuration")).alias("duration"), fits(tokens("CurrentYearDuration", "NonConsolidatedMember")).alias("alone"), fits(tokens("CurrentYearDuration", "ConsolidatedMember")).alias("consolidated"),
        fits(half).alias("half_year"), fits(tokens("CurrentYearInstant"), True).alias("annual_instant"), fits(tokens("StandaloneMember")).alias("standalone"),
    )


SEGMENT = "CASE o_orderkey % 12 WHEN 0 THEN 'CurrentYearDuration_BuildingConstructionReportableSegmentsMember' WHEN 1 THEN 'X_ConstructionReportableSegmentsMember' WHEN 2 THEN 'X_RealEstateReportableSegmentsMember' WHEN 3 THEN 'X_CivilEngineeringReportableSegmentsMember' WHEN 4 THEN 'X_EngineeringConstructionReportableSegmentsMember' WHEN 5 THEN 'X_CivilEngineeringAndBuildingConstructionReportableSegmentsMember' WHEN 6 THEN 'X_ConstructionBusinessReportableSegmentsMember' WHEN 7 THEN 'X_OtherReportableSegmentsMember' WHEN 8 THEN 'X_DomesticConstructionReportableSegmentsMember' WHEN 9 THEN 'ConstructionReportableSegment_Total' WHEN 10 THEN 'X_BuildingMember' END"


@query("segment_contexts", f"""
WITH r AS (SELECT o_orderkey, string_split(coalesce({SEGMENT}, ''), '_')[-1] AS s FROM orders)
SELECT o_orderkey, s IN ('BuildingConstructionReportableSegmentsMember', 'ConstructionReportableSegmentsMember', 'CivilEngineeringReportableSegmentsMember', 'CivilEngineeringAndBuildingConstructionReportableSegmentsMember', 'ConstructionBusinessReportableSegmentsMember', 'DomesticConstructionReportableSegmentsMember') AS construction,
  s IN ('ConstructionReportableSegmentsMember', 'CivilEngineeringAndBuildingConstructionReportableSegmentsMember', 'ConstructionBusinessReportableSegmentsMember', 'EngineeringConstructionReportableSegmentsMember') AS broad FROM r""")
def segment_contexts(spark, sf):
    """Which contexts are of construction, and of it as a whole, named one by one in the SQL."""
    rows = said(spark, sf, f"{SEGMENT} AS c")
    return rows.select("o_orderkey", P.construction_segment(F.col("c")).alias("construction"), P.broad_segment(F.col("c")).alias("broad"))


DESCRIPTION = "CASE o_orderkey % 5 WHEN 0 THEN '有価証券報告書' WHEN 1 THEN '訂正有価証券報告書' WHEN 2 THEN '四半期報告書' WHEN 3 THEN '有価証券報告書（内国投資信託受益証券）' END"


@query("eligible_documents", f"""
WITH r AS (SELECT o_orderkey, coalesce({DESCRIPTION}, '') AS d, CASE o_custkey % 3 WHEN 0 THEN '010' WHEN 1 THEN '030' END AS o, CASE o_custkey % 4 WHEN 0 THEN '030000' WHEN 1 THEN '030001' ELSE '043000' END AS f, CASE WHEN o_orderkey % 11 = 0 THEN '1' ELSE '0' END AS w, CASE WHEN o_orderkey % 13 = 0 THEN '1' END AS u FROM orders)
SELECT o_orderkey, contains(d, '訂正') OR right(f, 3) = '001' AS correction, contains(d, '有価証券報告書') AND NOT contains(d, '投資信託') AND coalesce(o, '') = '010' AND f IN ('030000', '030001') AND w <> '1' AND coalesce(u, '0') <> '1' AS eligible FROM r""")
def eligible_documents(spark, sf):
    rows = said(spark, sf, f"{DESCRIPTION} AS d", "CASE o_custkey % 3 WHEN 0 THEN '010' WHEN 1 THEN '030' END AS o", "CASE o_custkey % 4 WHEN 0 THEN '030000' WHEN 1 THEN '030001' ELSE '043000' END AS f", "CASE WHEN o_orderkey % 11 = 0 THEN '1' ELSE '0' END AS w", "CASE WHEN o_orderkey % 13 = 0 THEN '1' END AS u")
    c = F.col
    ok = P.eligible(c("d"), c("o"), c("f"), c("w"), c("u"), ["有価証券報告書"], ["投資信託"], ["010"], ["030000", "030001"])
    return rows.select("o_orderkey", P.correction(c("d"), c("f"), ["訂正"]).alias("correction"), ok.alias("eligible"))


@query("table_classes", """
WITH r AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS t, p_brand AS b FROM part)
SELECT p_partkey, regexp_matches(t, 'ring|bolt') AND regexp_matches(t, 'standard|steel') AS accept, CASE WHEN NOT regexp_matches(t, 'ring|bolt') THEN '' WHEN contains(t, 'standard') THEN 'building_orders_by_use' WHEN contains(t, 'steel') THEN 'completed_building_by_use' ELSE '' END AS metric_id,
  CASE WHEN NOT regexp_matches(t, 'ring|bolt') THEN 'no_use_category_keywords' WHEN contains(t, 'standard') THEN 'order_keywords' WHEN contains(t, 'steel') THEN 'completion_keywords' WHEN b = 'Brand#1' THEN 'source_metric_hint_requires_table_keywords_or_ai' ELSE 'no_metric_keywords' END AS reason FROM r""")
def table_classes(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("t"), "p_brand")
    found = P.table_class(F.col("t"), F.col("p_brand"), ["ring", "bolt"], ["standard"], ["steel"], ["Brand#1"])
    return rows.select("p_partkey", found.alias("x")).select("p_partkey", "x.*")


@query("segment_fields", """
WITH r AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS e, CASE o_orderkey % 6 WHEN 0 THEN 'segment_sales_building' WHEN 1 THEN 'segment_profit_' || o_custkey || '_civil' WHEN 2 THEN 'employees_segment_other' WHEN 3 THEN 'total_assets' WHEN 4 THEN 'segment_margin_x' ELSE 'segment_orders_9999999_y' END AS f FROM orders)
SELECT o_orderkey, CASE WHEN f LIKE 'segment\\_%' ESCAPE '\\' OR f LIKE 'employees\\_segment\\_%' ESCAPE '\\' THEN regexp_replace(f, '^(segment_sales_|segment_profit_|segment_orders_|employees_segment_)', '') END AS key,
  CASE WHEN NOT (starts_with(f, 'segment_') OR starts_with(f, 'employees_segment_')) THEN NULL WHEN contains(f, '_' || e || '_') THEN 'company_specific' ELSE 'common' END AS taxonomy FROM r""")
def segment_fields(spark, sf):
    rows = said(spark, sf, "CAST(o_custkey AS STRING) AS e", "CASE o_orderkey % 6 WHEN 0 THEN 'segment_sales_building' WHEN 1 THEN 'segment_profit_' || CAST(o_custkey AS STRING) || '_civil' WHEN 2 THEN 'employees_segment_other' WHEN 3 THEN 'total_assets' WHEN 4 THEN 'segment_margin_x' ELSE 'segment_orders_9999999_y' END AS f")
    return rows.select("o_orderkey", P.segment_metadata(F.col("f"), F.col("e")).alias("x")).select("o_orderkey", "x.key", "x.taxonomy")


@query("source_metrics", """
WITH r AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'a; b,c' WHEN 1 THEN ' x、y ' WHEN 2 THEN ' ; ' END AS l, CASE o_custkey % 3 WHEN 0 THEN 'major_indicators' WHEN 1 THEN ' own ' END AS m FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'a|b|c' WHEN o_orderkey % 5 = 1 THEN 'x|y' WHEN m = 'major_indicators' THEN 'd1|d2' WHEN m IS NOT NULL THEN 'own' ELSE '' END AS metrics FROM r""")
def source_metrics(spark, sf):
    rows = said(spark, sf, "CASE o_orderkey % 5 WHEN 0 THEN 'a; b,c' WHEN 1 THEN ' x、y ' WHEN 2 THEN ' ; ' END AS l", "CASE o_custkey % 3 WHEN 0 THEN 'major_indicators' WHEN 1 THEN ' own ' END AS m")
    return rows.select("o_orderkey", F.array_join(P.metric_ids(F.col("l"), F.col("m"), ["major_indicators", "building_use_metrics"], ["d1", "d2"]), "|").alias("metrics"))


@query("security_master", """
SELECT CAST(c_custkey AS VARCHAR) AS listed_company_id, CAST(c_custkey AS VARCHAR) AS operating_company_id, c_name AS operating_company_name, CAST(1000 + c_custkey AS VARCHAR) AS stock_code, (1000 + c_custkey) || '.T' AS ticker, 'JPX' AS exchange, 'JPY' AS currency,
  CAST(1 + c_custkey % 12 AS VARCHAR) AS fiscal_year_end_month, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE (1980 + c_nationkey) || '-01-01' END AS listed_from, '' AS listed_to, '' AS successor_listed_company_id, 'true' AS enabled, 'company_master' AS source, c_mktsegment AS note
FROM customer WHERE c_custkey % 7 <> 0""")
def security_master(spark, sf):
    """Companies with a code; every seventh has none, and one in four no first year."""
    key = F.col("c_custkey")
    code = F.when(key % 7 != 0, (1000 + key).cast("string")).otherwise(" ")
    companies = table(spark, sf, "customer").select(key.cast("string").alias("operating_company_id"), F.col("c_name").alias("operating_company_name"), code.alias("securities_code"), (1 + key % 12).cast("string").alias("fiscal_year_end_month"), F.when(key % 4 != 0, 1980 + F.col("c_nationkey")).alias("valid_from_year"), F.col("c_mktsegment").alias("notes"))
    return normalize.securities_of_companies(companies)


@query("price_columns", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS close, o_orderstatus AS state, CAST(NULL AS DOUBLE) AS volume, '' AS currency FROM orders")
def price_columns(spark, sf):
    rows = said(spark, sf, "CASE o_orderkey % 5 WHEN 0 THEN ' nan ' ELSE CAST(o_custkey AS STRING) END AS close", "o_orderstatus AS state").withColumnRenamed("o_orderkey", "id")
    return normalize.numeric_columns(rows, ["id", "close", "state", "volume", "currency"], ["close", "volume"])


KEYWORDS, LABELS = {"medical": ["医療", "病 院"], "office": ["事務所"]}, {"office": "事務所ビル", "medical": "医療福祉"}
USE = "CASE o_orderkey % 6 WHEN 0 THEN '医 療・福祉' WHEN 1 THEN '事務所・庁舎' WHEN 2 THEN 'Ware House 2' WHEN 3 THEN '宿泊 施設' WHEN 4 THEN '大病院' ELSE '' END"


@query("order_row_normalizer", f"""
WITH r AS (SELECT o_orderkey, {USE} AS raw, CASE WHEN o_orderkey % 10 = 0 THEN 'given' ELSE '' END AS given, o_custkey, {AMOUNT} AS a FROM orders),
k AS (SELECT *, CASE WHEN given <> '' THEN given WHEN regexp_matches(replace(raw, ' ', ''), '医療|病院') THEN 'medical' WHEN contains(raw, '事務所') THEN 'office' WHEN raw LIKE 'Ware%' THEN 'warehouse2' WHEN raw LIKE '宿泊%' THEN '宿泊施設' ELSE 'other_use' END AS cat FROM r)
SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN 'own name' ELSE coalesce(c_name, '') END AS company_name, cat AS use_category_normalized, CASE cat WHEN 'office' THEN '事務所ビル' WHEN 'medical' THEN '医療福祉' ELSE CASE WHEN raw <> '' THEN raw ELSE cat END END AS use_category_label,
  CASE WHEN a IN ('', 'nan') THEN NULL ELSE round(try_cast(regexp_replace(replace(a, '△', '-'), '[^0-9.\\-]', '', 'g') AS DOUBLE), 6) + 0.0 END AS order_amount
FROM k LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c ON o_custkey = c_custkey""")
def order_row_normalizer(spark, sf):
    """Order rows named from a master that lacks every third company."""
    rows = said(spark, sf, "o_custkey AS company_id", "CASE WHEN o_orderkey % 8 = 0 THEN 'own name' END AS company_name", f"{USE} AS use_category_raw", "CASE WHEN o_orderkey % 10 = 0 THEN 'given' ELSE '' END AS use_category_normalized", f"{AMOUNT} AS order_amount", f"{AMOUNT} AS amount_million_yen")
    master = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"))
    return normalize.order_rows(rows, master, KEYWORDS, LABELS).select("o_orderkey", "company_name", "use_category_normalized", "use_category_label", "order_amount")


@query("category_field_options", """
WITH r AS (SELECT p_partkey, lower(p_type) AS n, p_name AS label, CASE p_size % 3 WHEN 0 THEN 'use' WHEN 1 THEN 'scope' ELSE '' END AS k, CASE WHEN p_size % 2 = 0 THEN '百万円' ELSE '' END AS u FROM part),
i AS (SELECT *, CASE WHEN k = '' THEN 'category' ELSE k END AS category, 'order_amount__' || CASE WHEN k = '' THEN 'category' ELSE k END || '__' || trim(regexp_replace(replace(n, ' ', ''), '[^a-z0-9]+', '_', 'g'), '_') AS id FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p_partkey) AS z FROM i)
SELECT id, label AS name, category, CASE WHEN u = '' THEN '億円' ELSE u END AS unit, label || ' (' || category || ')' AS label FROM f WHERE z = 1""")
def category_field_options(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.lower("p_type").alias("use_category_normalized"), F.lit("").alias("use_category_raw"), F.col("p_name").alias("use_category_label"), F.expr("CASE p_size % 3 WHEN 0 THEN 'use' WHEN 1 THEN 'scope' ELSE '' END").alias("category_type"), F.expr("CASE WHEN p_size % 2 = 0 THEN '百万円' ELSE '' END").alias("unit"))
    return normalize.category_options(rows, "p_partkey").select("id", "name", "category", "unit", "label")


@query("fact_places", """
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END, l_linestatus, l_linenumber) AS place FROM lineitem""")
def fact_places(spark, sf):
    """Facts of known units first: line items with flag N are in yen, others in shares of a kind."""
    facts = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "N", "円").otherwise("株").alias("unit"), F.col("l_linestatus").alias("file"), F.col("l_linenumber").alias("row"))
    return normalize.fact_order(facts, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "place")
