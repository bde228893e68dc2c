"""Queries on series, texts, charts and reads."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import exprs as E
from ..operators import audit, extract, market, paging, reshape
from ..sources import readers
from ..streaming import refresh
from .base import WITH_ORDERS, item_years, order_years, orders_by_nation, query, table


@query("ohlc_bars", """
SELECT event_type, strftime(ts, '%Y-%m') AS month, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS ticks FROM events GROUP BY 1, 2""")
def ohlc_bars(spark, sf):
    ticks = table(spark, sf, "events").withColumn("month", F.date_format("ts", "yyyy-MM"))
    return market.bars(ticks, ["event_type", "month"], "ts", "value", "event_id")


@query("return_over_gaps", """
WITH d AS (SELECT user_id, event_id, CASE WHEN event_id % 4 <> 0 THEN value END AS close FROM events),
p AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_close FROM d)
SELECT user_id, event_id, close, previous_close, round((close - previous_close) / nullif(previous_close, 0), 6) AS monthly_return FROM p""")
def return_over_gaps(spark, sf):
    d = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("close"))
    return market.returns(d, ["user_id"], "event_id", "close", 6)


@query("product_of_factors", "SELECT event_type, user_id, round(product(CASE WHEN event_id % 2 = 0 THEN 2.0 ELSE 0.5 END), 6) AS factor, count(*) AS splits FROM events GROUP BY 1, 2")
def product_of_factors(spark, sf):
    e = table(spark, sf, "events").withColumn("f", F.when(F.col("event_id") % 2 == 0, 2.0).otherwise(0.5))
    return market.product_of_factors(e, ["event_type", "user_id"], "f").withColumn("factor", F.round("factor", 6))


@query("topk_per_group_cap", "SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k <= 5")
def topk_per_group_cap(spark, sf):
    items = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    return extract.top_per_group(items, ["l_returnflag"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 5)


@query("facet_counts", "SELECT event_type, count(*) AS rows FROM (SELECT coalesce(nullif(trim(event_type), ''), '(blank)') AS event_type FROM events) GROUP BY 1")
def facet_counts(spark, sf):
    return paging.facet(table(spark, sf, "events"), "event_type")


@query("top_group_counts", "SELECT o_orderpriority, o_orderstatus, count(*) AS rows FROM orders GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 12")
def top_group_counts(spark, sf):
    return paging.top_groups(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"])


@query("page_slice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_slice(spark, sf):
    return paging.page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 3, 50)


@query("page_info", "SELECT count(*) AS total, CAST(greatest(ceil(count(*) / 50.0), 1) AS BIGINT) AS total_pages FROM orders")
def page_info(spark, sf):
    return paging.page_info(table(spark, sf, "orders"))


@query("row_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(chr(1), p_partkey, p_name, p_type)), 'ring')")
def row_search(spark, sf):
    return paging.search(table(spark, sf, "part").select("p_partkey", "p_name", "p_type"), "RING").select("p_partkey", "p_name")


@query("chart_slice", WITH_ORDERS + "SELECT entity, year, total FROM y ORDER BY entity, year LIMIT 40")
def chart_slice(spark, sf):
    return paging.chart_slice(order_years(spark, sf).select("entity", "year", "total"), ["entity", "year"], 40)


@query("pearson_corr", "SELECT l_returnflag, count(*) AS points, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def pearson_corr(spark, sf):
    return reshape.correlation(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").withColumn("r", F.round("r", 6))


@query("period_pivot", WITH_ORDERS + "SELECT entity, max(total) FILTER (year = 1995) AS y1995, max(total) FILTER (year = 1996) AS y1996, max(total) FILTER (year = 1997) AS y1997 FROM y GROUP BY 1")
def period_pivot(spark, sf):
    out = reshape.period_pivot(order_years(spark, sf), "entity", "year", [1995, 1996, 1997], "total")
    return out.select("entity", *[F.col(str(y)).alias(f"y{y}") for y in (1995, 1996, 1997)])


@query("trend_matrix", WITH_ORDERS + "SELECT year, max(total) FILTER (entity = 'NATION_1') AS NATION_1__total, max(total) FILTER (entity = 'NATION_2') AS NATION_2__total FROM y GROUP BY 1")
def trend_matrix(spark, sf):
    keyed = order_years(spark, sf).withColumn("series", F.concat_ws("__", "entity", F.lit("total")))
    return reshape.period_pivot(keyed, "year", "series", ["NATION_1__total", "NATION_2__total"], "total")


@query("scatter_pairs", WITH_ORDERS + "SELECT entity, year, total_f AS x, total_p AS y FROM y WHERE total_f IS NOT NULL AND total_p IS NOT NULL")
def scatter_pairs(spark, sf):
    return reshape.scatter(order_years(spark, sf), "total_f", "total_p").select("entity", "year", F.col("total_f").alias("x"), F.col("total_p").alias("y"))


@query("company_bars", WITH_ORDERS + "SELECT entity, year, total_o, total_p FROM y WHERE total_o IS NOT NULL OR total_p IS NOT NULL")
def company_bars(spark, sf):
    return order_years(spark, sf).select("entity", "year", "total_o", "total_p").dropna(how="all", subset=["total_o", "total_p"])


@query("duplicate_tags", """
WITH t AS (SELECT DISTINCT p_brand AS field_id, unnest(string_split(p_type, ' ')) AS tag FROM part)
SELECT tag, string_agg(field_id, ',' ORDER BY field_id) AS field_ids, 'medium' AS severity FROM t GROUP BY 1 HAVING count(*) >= 2""")
def duplicate_tags(spark, sf):
    none = F.array().cast("array<string>")
    fields = table(spark, sf, "part").select(F.col("p_brand").alias("field_id"), F.split("p_type", " ").alias("tags"), none.alias("markers"))
    out = audit.duplicate_tags(fields)
    return out.withColumn("field_ids", F.array_join("field_ids", ","))


@query("json_props_parse", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_parse(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("deterministic_ids", "SELECT o_orderkey, 'corr_' || left(sha1(CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus || '|' || o_orderpriority), 16) AS id FROM orders")
def deterministic_ids(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", E.stable_id("corr", F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("id"))


@query("html_to_text", r"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<(br|/p|/tr|/div|/table|/h[1-6])[^>]*>', chr(10), 'g'), '(?s)<[^>]+>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM b)
SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \t\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS text FROM c""")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", E.html_to_text(F.col("html")).alias("text"))


@query("keyword_window_score", "SELECT doc_id, 3 * (contains(lower(text), 'the')::INT + contains(lower(text), 'der')::INT) + 2 * contains(lower(text), '|')::INT - contains(lower(text), '%%%')::INT AS score FROM documents")
def keyword_window_score(spark, sf):
    out = extract.score_blocks(table(spark, sf, "documents").select("doc_id", "text"), F.col("text"), ["the", "der"], ["|"], penalty=["%%%"])
    return out.select("doc_id", "score")


@query("number_tokens", r"""
WITH t AS (SELECT l_orderkey, l_linenumber, 'order ' || l_orderkey || ' qty ' || CAST(floor(l_quantity) AS INTEGER) || ' amount (' || CAST(CAST(floor(l_extendedprice) AS INTEGER) AS VARCHAR) || ')' AS s FROM lineitem),
x AS (SELECT l_orderkey, l_linenumber, unnest(regexp_extract_all(s, '\(?[△▲\-]?[0-9][0-9,]*(?:\.[0-9]+)?\)?')) AS token FROM t)
SELECT l_orderkey, l_linenumber, token, CASE WHEN token LIKE '(%)' THEN -CAST(replace(replace(token, '(', ''), ')', '') AS DOUBLE) ELSE CAST(token AS DOUBLE) END AS value FROM x WHERE length(regexp_replace(token, '[^0-9]', '', 'g')) >= 3 OR token LIKE '%.%'""")
def number_tokens(spark, sf):
    text = F.concat(F.lit("order "), F.col("l_orderkey").cast("string"), F.lit(" qty "), F.floor("l_quantity").cast("int").cast("string"), F.lit(" amount ("), F.floor("l_extendedprice").cast("int").cast("string"), F.lit(")"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.alias("s"))
    return extract.number_tokens(rows, ["l_orderkey", "l_linenumber"], "s").select("l_orderkey", "l_linenumber", "token", "value")


@query("section_windows", """
WITH h AS (SELECT user_id, event_id AS p FROM events WHERE event_type = 'click'),
s AS (SELECT user_id, greatest(p - 20, 0) AS a, p + 100 AS b, p FROM h),
r AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN a <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY p) AS island FROM r)
SELECT user_id, min(a) AS window_start, max(b) AS window_end, count(*) AS hits FROM i GROUP BY user_id, island""")
def section_windows(spark, sf):
    hits = table(spark, sf, "events").where("event_type = 'click'").select("user_id", "event_id")
    return extract.merged_windows(hits, ["user_id"], "event_id", 20, 100)


@query("period_forward_fill", """
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked_at FROM conversations""")
def period_forward_fill(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("marker"))
    return extract.forward_fill(rows, ["conv_id"], "turn", "marker", "asked_at").drop("marker")


@query("adjacent_consistency", """
SELECT user_id, event_id, abs(value - lag(value) OVER w) <= greatest(1.0, abs(lag(value) OVER w) * 0.005) AS consistent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def adjacent_consistency(spark, sf):
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf, "events").select("user_id", "event_id", E.within(F.col("value") - before, before, 1.0, 0.005).alias("consistent"))


@query("fiscal_calendar", """
SELECT o_orderkey, CAST(CASE WHEN month(o_orderdate) > 3 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS INTEGER) AS fy_march, CAST(year(o_orderdate) AS INTEGER) AS fy_december,
  CAST(CAST(make_date(CASE WHEN month(o_orderdate) > 3 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END + 1, 3, 31) AS DATE) AS VARCHAR) AS fy_end FROM orders""")
def fiscal_calendar(spark, sf):
    day = F.col("o_orderdate")
    march = E.fiscal_year(day, 3)
    return table(spark, sf, "orders").select("o_orderkey", march.alias("fy_march"), E.fiscal_year(day, 12).alias("fy_december"), E.fiscal_year_end(march, 3).cast("string").alias("fy_end"))


@query("composite_keys", "SELECT c_custkey, 'C_' || c_nationkey AS entity, 1990 + c_custkey % 9 AS year FROM customer")
def composite_keys(spark, sf):
    key = F.concat(F.lit("C_"), F.col("c_nationkey").cast("string"), F.lit("_"), (F.lit(1990) + F.col("c_custkey") % 9).cast("string"), F.when(F.col("c_custkey") % 2 == 0, "H1").otherwise(""))
    return table(spark, sf, "customer").select("c_custkey", E.entity_of(key).alias("entity"), E.year_of(key).cast("long").alias("year"))


@query("category_keywords", "SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'ring' WHEN contains(p_name, 'bolt') OR contains(p_name, 'gear') THEN 'metal' ELSE trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') END AS category FROM part")
def category_keywords(spark, sf):
    return table(spark, sf, "part").select("p_partkey", E.first_category(F.col("p_name"), {"ring": ["ring"], "metal": ["bolt", "gear"]}).alias("category"))


@query("latest_per_entity", WITH_ORDERS + "SELECT entity, max(year) AS year, arg_max(total, year) AS total FROM y GROUP BY 1")
def latest_per_entity(spark, sf):
    return order_years(spark, sf).groupBy("entity").agg(F.max("year").alias("year"), F.max_by("total", "year").alias("total"))


@query("roll_forward_plan", WITH_ORDERS + """,
l AS (SELECT entity, max(year) + 1 AS year FROM y GROUP BY 1)
SELECT entity, year, EXISTS (SELECT 1 FROM y WHERE y.entity = l.entity AND y.year = l.year) AS existing FROM l""")
def roll_forward_plan(spark, sf):
    y = order_years(spark, sf)
    planned = y.groupBy("entity").agg((F.max("year") + 1).alias("year"))
    return planned.join(y.select("entity", "year", F.lit(True).alias("_e")), ["entity", "year"], "left").select("entity", "year", F.coalesce("_e", F.lit(False)).alias("existing"))


@query("item_year_totals", """WITH o AS (
  SELECT o_orderkey, n_name AS entity, CAST(CASE WHEN month(o_orderdate) > 3 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS INTEGER) AS year FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT entity, year, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS gross, round(sum(l_extendedprice), 2) AS price, round(sum(l_quantity), 2) AS quantity FROM o JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def item_year_totals(spark, sf):
    return item_years(spark, sf)


@query("priority_by_status", "SELECT entity, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS partial FROM (SELECT n_name AS entity, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1")
def priority_by_status(spark, sf):
    count = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return orders_by_nation(spark, sf).groupBy("entity").agg(count("F").alias("finished"), count("O").alias("open"), count("P").alias("partial"))


@query("event_windows", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS rows, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    """The streaming window aggregation over the whole table as one batch."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = refresh.windowed(events, "ts", ["event_type"], "value", "1 day")
    return out.withColumn("window_start", F.to_timestamp_ntz("window_start")).withColumn("total", F.round("total", 2))


@query("event_sessions", """
WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 12 HOUR AS session_end, count(*) AS rows FROM s GROUP BY user_id, n""")
def event_sessions(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = refresh.sessions(events, "ts", ["user_id"], "12 hours")
    return out.withColumns({c: F.to_timestamp_ntz(c) for c in ("session_start", "session_end")})


@query("page_links", r"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href=[^>]*>.*?</a>')) AS a FROM pages)
SELECT page_id, href, text FROM (SELECT page_id, regexp_extract(a, '(?i)href=["'']?([^"''\s>]*)', 1) AS href, trim(regexp_replace(a, '(?s)<[^>]+>', ' ', 'g')) AS text FROM a) WHERE contains(lower(href), 'a')""")
def page_links(spark, sf):
    return readers.links(table(spark, sf, "pages"), href_words=["a"])


@query("page_table_cells", r"""
WITH t AS (SELECT page_id, generate_subscripts(x, 1) - 1 AS "table", unnest(x) AS t FROM (SELECT page_id, regexp_extract_all(html, '(?is)<table.*?</table>') AS x FROM pages)),
r AS (SELECT page_id, "table", generate_subscripts(x, 1) - 1 AS "row", unnest(x) AS r FROM (SELECT *, regexp_extract_all(t, '(?is)<tr.*?</tr>') AS x FROM t)),
c AS (SELECT page_id, "table", "row", generate_subscripts(x, 1) - 1 AS "column", unnest(x) AS c FROM (SELECT *, regexp_extract_all(r, '(?is)<t[dh].*?</t[dh]>') AS x FROM r))
SELECT page_id, "table", "row", "column", trim(regexp_replace(regexp_replace(c, '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM c""")
def page_table_cells(spark, sf):
    out = readers.html_cells(table(spark, sf, "pages"))
    return out.select("page_id", *[F.col(c).cast("long").alias(c) for c in ("table", "row", "column")], "text")
