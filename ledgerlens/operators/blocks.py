"""Sections of texts, and rows of tables that a text states line by line: a label's line and a number on each line below.

A text is handled in its own row, as arrays of its lines, spans and numbers; only caps over several texts of a key shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions.exprs import half_width, within
from .extract import keyword_hits, top_per_group
from .tables import current_value, half


@dataclass(frozen=True)
class Section:
    """What a section is found by: heading words, and how many of the table words a window must have, one of `needs`, none of `barred` in its first `barred_chars`; then a score per word, a cap and a least score."""

    name: str
    headings: tuple[str, ...]
    table_words: tuple[str, ...]
    table_least: int = 1
    needs: tuple[str, ...] = ()
    barred: tuple[str, ...] = ()
    barred_chars: int = 1500
    bonus: tuple[tuple[str, int], ...] = ()
    cap: int = 3
    least_score: int = 0


def _joined(spans: Column, new: Column) -> Column:
    """spans with one more that begins at or behind all of them: joined to the last if they overlap or touch."""
    last = F.element_at(spans, -1)
    wider = F.struct(last["a"].alias("a"), F.greatest(last["b"], new["b"]).alias("b"))
    return F.when(F.size(spans) == 0, F.array(new)).when(new["a"] <= last["b"], F.concat(F.slice(spans, F.lit(1), F.size(spans) - 1), F.array(wider))).otherwise(F.concat(spans, F.array(new)))


def merged_spans(text: Column, words: tuple[str, ...], before: int, after: int) -> Column:
    """Spans [from, to) around all places of any of the words, cut at the text's ends; overlapping or touching ones are one.

    The places of a word follow from the lengths of what a split at it leaves; a word's spans are joined while they are
    found, then those of all words, so that what is kept grows with the spans and not with the places.
    """
    size, none = F.length(text), F.array().cast("array<struct<a:int,b:int>>")
    found = []
    for w in words:
        pieces = F.split(text, re.escape(w))
        lengths = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.length(p))

        def step(s: Column, n: Column) -> Column:
            at = s["at"] + n
            span = F.struct(F.greatest(at - before, F.lit(0)).cast("int").alias("a"), F.least(at + after, size).cast("int").alias("b"))
            return F.struct((at + len(w)).cast("int").alias("at"), _joined(s["spans"], span).alias("spans"))  # noqa: B023  used at once

        found.append(F.aggregate(lengths, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda s: s["spans"]))
    return F.aggregate(F.array_sort(F.flatten(F.array(*found))), none, _joined)


def signature(text: Column, chars: int = 1000) -> Column:
    return F.regexp_replace(F.left(text, F.lit(chars)), "\\s+", "")


def windows(df: DataFrame, keys: list[str], text: str, section: Section, reach: int = 5000) -> DataFrame:
    """(keys, section, place, window_start, window): the windows of a section in each text that meet its predicate; equal signatures of a text once."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(*keys, t.alias("_t")).where(P.has_any(F.col("_t"), list(section.headings)))
    rows = rows.select(*keys, "_t", F.posexplode(merged_spans(F.col("_t"), section.headings, reach // 5, reach)).alias("place", "s"))
    window = F.regexp_replace(F.substr("_t", F.col("s.a") + 1, F.col("s.b") - F.col("s.a")), "^\\s+|\\s+$", "")
    rows = rows.select(*keys, F.lit(section.name).alias("section"), "place", F.col("s.a").alias("window_start"), window.alias("window"))
    rows = top_per_group(rows, [*keys, "section", signature(F.col("window"))], [F.col("place")], 1).drop("rank")
    w = F.col("window")
    ok = (keyword_hits(w, list(section.headings)) > 0) & (keyword_hits(w, list(section.table_words)) >= section.table_least)
    if section.needs:
        ok = ok & P.has_any(w, list(section.needs))
    if section.barred:
        ok = ok & ~P.has_any(F.left(w, F.lit(section.barred_chars)), list(section.barred))
    return rows.where(ok)


def score(window: Column, section: Section) -> Column:
    """Three for a heading word, two for a table word, and the section's own weights."""
    out = 3 * keyword_hits(window, list(section.headings)) + 2 * keyword_hits(window, list(section.table_words))
    for word, weight in section.bonus:
        out = out + F.when(window.contains(word), weight).otherwise(0)
    return out


def heading_line(window: Column, section: Section) -> Column:
    """The first line that has a heading word, 200 characters at most."""
    lines = F.filter(F.transform(F.split(window, "\n"), lambda x: F.trim(x)), lambda x: P.has_any(x, list(section.headings)))
    return F.left(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), F.lit(200))


def locate(df: DataFrame, keys: list[str], group: list[str], text: str, sections: list[Section]) -> DataFrame:
    """Candidate blocks: windows of all sections with score, heading, unit and scope hints; of each group and section the best, equal signatures once."""
    out = None
    for s in sections:
        rows = windows(df, keys, text, s).withColumn("score", score(F.col("window"), s)).where(F.col("score") >= s.least_score)
        best = top_per_group(rows, [*group, "section"], [F.col("score").desc(), *[F.col(k) for k in keys], F.col("place")], s.cap, signature(F.col("window")))
        best = best.withColumn("heading", heading_line(F.col("window"), s)).withColumn("unit_hint", P.unit_hint(F.col("window"))).withColumn("scope_hint", P.scope_hint(F.col("window")))
        out = best if out is None else out.unionByName(best)
    return out


#: What lines of tables call the rows and periods that are read.
BUILDING, DOMESTIC = ("建築事業", "建築工事", "建築"), ("国内建築", "国内建築事業", "国内建築工事")
BUILDING_STARTS, DOMESTIC_STARTS = ("建築事業",), ("国内建築",)
NEXT_ROWS = ["土木事業", "土木工事", "土木", "国内土木", "国内土木事業", "国内土木工事", "海外", "海外建設事業", "小計", "不動産事業", "計", "合計"]
NEXT_STARTS = ["土木事業", "土木工事", "国内土木", "海外建設"]
CURRENT, PREVIOUS = ["当事業年度", "当連結会計年度", "当期"], ["前事業年度", "前連結会計年度", "前期"]
DASHES = ["-", "―", "—", "–"]  # the wide one folds to the first
MOST, REACH = 8, 20


def lines_of(text: Column) -> Column:
    """The trimmed lines that are not empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _label(line: Column) -> Column:
    """A line folded and without blanks."""
    return F.translate(half_width(line), " \t\r\x0b\x0c", "")


def _starts(label: Column, names: tuple[str, ...] | list[str]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | label.startswith(n)
    return out


def line_number(line: Column) -> Column:
    """The number that a folded line is, and nothing else: blanks between digits go, triangles and parentheses are minus."""
    t = F.translate(line, "−,", "-")
    number = F.translate(F.regexp_extract(t, "^[△▲]?\\s*\\(?\\s*([+-]?[0-9][0-9\\s]*(?:\\.[0-9]+)?)\\s*\\)?$", 1), " \t", "").try_cast("double")
    marked = t.startswith("△") | t.startswith("▲") | t.startswith("(")
    return F.when(t.contains("(") == t.contains(")"), F.when(marked, -F.abs(number)).otherwise(number))


def numbers_below(lines: Column, row: Column) -> Column:
    """The numbers on the lines below a row, at most MOST within REACH lines: lines before the first number are passed over, and the next row's label or any other text ends the run. A dash is a null. lines are structs (number, dash, next)."""
    start = F.struct(F.array().cast("array<double>").alias("v"), F.lit(False).alias("over"))

    def step(s: Column, x: Column) -> Column:
        value = x["number"].isNotNull() | x["dash"]
        over = s["over"] | ((F.size(s["v"]) > 0) & (x["next"] | ~value)) | (F.size(s["v"]) >= MOST)
        return F.struct(F.when(~over & value, F.concat(s["v"], F.array(x["number"]))).otherwise(s["v"]).alias("v"), over.alias("over"))

    return F.aggregate(F.slice(lines, row + 2, REACH), start, step, lambda s: s["v"])


def labelled_rows(df: DataFrame, keys: list[str], text: str, names: tuple[str, ...] = BUILDING, starts: tuple[str, ...] = BUILDING_STARTS) -> DataFrame:
    """(keys, row, period, values): the lines with one of the labels, the period whose marker stands last at or above each, and the numbers below.

    Every line is folded and read once: arrays are bound to lambda variables, as columns would be computed again where the
    optimizer pushes a filter through them.
    """

    def read(x: Column) -> Column:
        label = F.translate(x, " \t\r\x0b\x0c", "")
        mark = F.when(P.has_any(label, CURRENT), "current").when(P.has_any(label, PREVIOUS), "previous")
        return F.struct(
            line_number(x).alias("number"), x.isin(*DASHES).alias("dash"), (label.isin(*NEXT_ROWS) | _starts(label, NEXT_STARTS)).alias("next"),
            mark.alias("mark"), (label.isin(*names) | _starts(label, starts)).alias("named"),
        )

    def rows_of(n: Column) -> Column:
        found = F.filter(F.sequence(F.lit(0), F.size(n) - 1), lambda i: F.get(n, i)["named"])

        def one(i: Column) -> Column:
            above = F.array_compact(F.transform(F.slice(n, F.lit(1), i + 1), lambda x: x["mark"]))
            return F.struct(i.alias("row"), F.element_at(F.concat(F.array(F.lit(None).cast("string")), above), -1).alias("period"), numbers_below(n, i).alias("values"))

        return F.when(F.exists(n, lambda x: x["named"]), F.transform(found, one).cast("array<struct<row:int,period:string,values:array<double>>>"))

    lines = F.transform(lines_of(half_width(F.col(text))), read).cast("array<struct<number:double,dash:boolean,next:boolean,mark:string,named:boolean>>")
    # An outer explode, as the optimizer would ask a plain one's array for its size first, by computing it twice.
    rows = df.select(*keys, F.explode_outer(F.flatten(F.transform(F.array(lines), rows_of))).alias("r")).where("r IS NOT NULL")
    return rows.select(*keys, "r.row", "r.period", "r.values")


def last_row(rows: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """Of each text the last row with as many values."""
    return rows.where(F.size("values") >= least).groupBy(*keys).agg(F.max_by(F.struct("row", "period", "values"), "row").alias("r")).select(*keys, "r.*")


def current_row(rows: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Of each text the last row of the current period, else the last one at all, with as many values."""
    rank = F.struct(F.coalesce(F.col("period") == "current", F.lit(False)), F.col("row"))
    return rows.where(F.size("values") >= least).groupBy(*keys).agg(F.max_by(F.struct("row", "period", "values"), rank).alias("r")).select(*keys, "r.*")


def _close(diff: Column, base: Column) -> Column:
    return F.coalesce(within(diff, base, 2.0, 0.001), F.lit(False))


def _balanced(v: Column) -> Column:
    """Whether previous + orders - completed = next, in a row previous, orders, sum, completed, next; a negative next before an amount is a misread mark."""
    a = lambda i: F.get(v, F.lit(i))
    after = F.when((a(4) < 0) & (a(5) >= 0), a(5)).otherwise(a(4))
    return (F.size(v) >= 5) & _close(a(0) + a(1) - a(3) - after, after)


ORDER_ROLES = {"previous": 0, "orders": 1, "total": 2, "completed": 3, "next": 4}


def order_fields(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, role, value, confidence, review_required) of rows of values: a misread mark in front goes where the rest balances; a balanced row is trusted (.90), another to be reviewed (.78)."""
    a = lambda i: F.get("values", F.lit(i))
    rest = F.slice("values", 2, MOST)
    shifted = (F.size("values") >= 6) & (a(0) < 0) & (a(1) >= 0) & _balanced(rest)
    v = F.when(shifted, rest).otherwise(F.col("values"))
    out = rows.withColumn("values", v).withColumn("_ok", _balanced(F.col("values")))
    at = lambda i: F.get("values", F.lit(i))
    backlog = lambda i: F.when((at(i) < 0) & (at(i + 1) >= 0), at(i + 1)).otherwise(at(i))
    each = F.array(*[F.struct(F.lit(r).alias("role"), (backlog(i) if r in ("previous", "next") else at(i)).alias("value")) for r, i in ORDER_ROLES.items()])
    out = out.select(*keys, F.explode(each).alias("x"), F.when(F.col("_ok"), 0.9).otherwise(0.78).alias("confidence"), (~F.col("_ok")).alias("review_required"))
    return out.select(*keys, "x.role", "x.value", "confidence", "review_required").where("value IS NOT NULL")


def order_breakdown(values: Column) -> Column:
    """(government, private, overseas, total) of a row of orders by customer: a dash overseas is zero; the total is the first of the three numbers behind that adds up, else the first; null without four values."""
    a = lambda i: F.get(values, F.lit(i))
    overseas = F.coalesce(a(2), F.lit(0.0))
    added = a(0) + a(1) + overseas
    fits = F.filter(F.slice(values, 4, 3), lambda x: x.isNotNull() & _close(x - added, added))
    return F.when((F.size(values) >= 4) & a(0).isNotNull() & a(1).isNotNull(), F.struct(a(0).alias("government"), a(1).alias("private"), overseas.alias("overseas"), F.coalesce(F.get(fits, F.lit(0)), a(3)).alias("total")))


def customer_breakdown(values: Column, overseas: Column) -> Column:
    """(government, private, overseas) where they add up to one of the numbers behind; with an overseas column its value counts, else only the two."""
    a = lambda i: F.get(values, F.lit(i))
    known = (F.size(values) >= 3) & a(0).isNotNull() & a(1).isNotNull()
    three = overseas & (F.size(values) >= 4) & a(2).isNotNull()
    fits = lambda s, total: F.exists(s, lambda x: x.isNotNull() & _close(x - total, total))
    out = lambda o: F.struct(a(0).alias("government"), a(1).alias("private"), o.alias("overseas"))
    with_ = F.when(fits(F.slice(values, 4, 3), a(0) + a(1) + a(2)), out(a(2)))
    without = F.when(fits(F.slice(values, 3, 3), a(0) + a(1)), out(F.lit(None).cast("double")))
    return F.when(known & three, with_).when(known & ~three, without)


def contract_shares(values: Column) -> Column:
    """(special, competitive) of three shares that make up the whole within 0.2."""
    a = lambda i: F.get(values, F.lit(i))
    ok = (F.abs(a(2) - 100) <= 0.2) & (F.abs(a(0) + a(1) - a(2)) <= 0.2)
    return F.when(ok, F.struct(a(0).alias("special"), a(1).alias("competitive")))


def amount_unit(text: Column, segment: Column, hint: Column, money: bool = True) -> Column:
    """The unit that a line names, else its segment, else the block's hint; without one, millions for money."""
    units = ("百万円", "千円", "億円", "円") if money else ("百万円", "千円", "億円", "%", "人", "歳", "年", "円")

    def first(c: Column) -> Column:
        out = F.when(F.lit(False), "")
        for u in units:
            out = out.when(half_width(c).contains(u), u)
        return out

    blank = F.nullif(F.coalesce(hint, F.lit("")), F.lit(""))
    return F.coalesce(first(text), first(segment), blank, F.lit("百万円" if money else ""))


def value_scope(local: Column, segment: Column, hint: Column, alone_first: Column) -> Column:
    """The scope around a value: its neighbourhood speaks before its segment; of both scopes the one that the field is usually of goes first; else the hint."""
    alone, whole = (lambda t: P.has_any(half_width(t), ["提出会社", "単独", "個別"])), (lambda t: P.has_any(half_width(t), ["連結", "当社グループ", "企業集団", "グループ"]))
    one = lambda t: F.when(alone_first & alone(t), "standalone").when(whole(t), "consolidated").when(alone(t), "standalone")
    return F.coalesce(one(local), one(segment), F.nullif(hint, F.lit("")), F.lit("standalone"))


def hint_values(df: DataFrame, keys: list[str], text: str, labels: dict[str, list[str]], reach: int = 5) -> DataFrame:
    """(keys, field_id, row, value): for each field the first line with one of its labels and a number: what stands behind the label up to the next one, or on the next lines if nothing does.

    Labels do not overlap: the leftmost wins, then the longest. A line that says there is none is zero.
    """
    owner = {half(x): f for f, xs in labels.items() for x in xs}
    either = "|".join(re.escape(x) for x in sorted(owner, key=lambda x: (-len(x), x)))
    rows = df.select(*keys, half_width(F.col(text)).alias("_t")).where(F.col("_t").rlike(either)).select(*keys, lines_of(F.col("_t")).alias("_l"))
    rows = rows.select(*keys, "_l", F.posexplode("_l").alias("row", "_line")).where(F.col("_line").rlike(either))
    found = F.arrays_zip(F.regexp_extract_all("_line", F.lit(f"({either})"), 1).alias("label"), F.slice(F.split("_line", f"(?:{either})"), 2, 1 << 30).alias("tail"))
    # What follows on the next lines counts up to the first that has a label of its own; most values stand on the line itself.
    below = F.slice("_l", F.col("row") + 2, reach - 1)
    rows = rows.select(*keys, "row", "_line", below.alias("_b"), F.posexplode_outer(found).alias("_p", "x")).select(*keys, "row", "_line", "_b", "_p", "x.label", "x.tail")
    rows = rows.withColumn("_own", P.amounts(F.col("tail")))
    start = F.struct(F.array().cast("array<double>").alias("v"), F.lit(False).alias("over"))
    step = lambda s, x: F.struct(F.when(s["over"] | x.rlike(either), s["v"]).otherwise(P.amounts(x)).alias("v"), (s["over"] | x.rlike(either)).alias("over"))
    first = F.aggregate("_b", start, lambda s, x: F.when(F.size(s["v"]) > 0, s).otherwise(step(s, x)), lambda s: s["v"])
    names = F.create_map(*[F.lit(x) for kv in owner.items() for x in kv])
    none = P.has_any(F.col("_line"), ["特記事項なし", "該当事項なし", "該当なし"])
    rows = rows.withColumn("field_id", names[F.col("label")]).withColumn("_v", F.when(F.size("_own") > 0, F.col("_own")).otherwise(first))
    rows = rows.withColumn("value", F.coalesce(current_value(F.col("_v"), F.col("tail").contains("%")), F.when(none, F.lit(0.0))))
    first = F.min_by(F.struct("row", "value"), F.when(F.col("value").isNotNull(), F.struct("row", "_p")))  # lines without a value do not count
    return rows.groupBy(*keys, "field_id").agg(first.alias("r")).where("r IS NOT NULL").select(*keys, "field_id", "r.*")


def segment_orders(df: DataFrame, keys: list[str], text: str, labels: dict[str, str], least: float = 1000.0) -> DataFrame:
    """(keys, field_id, row, value): of lines that begin with a segment's label the second amount of `least` or more (the first is last year's), on the line or on it and the next three; the last such line of a field counts."""
    rows = df.select(*keys, lines_of(F.col(text)).alias("_l")).select(*keys, "_l", F.posexplode("_l").alias("row", "_line")).withColumn("_n", _label(F.col("_line")))
    named = F.when(F.lit(False), "")
    for label in sorted(labels, key=lambda x: (-len(x), x)):
        named = named.when(F.col("_n").startswith(label), labels[label])
    large = lambda c: F.filter(P.amounts(c), lambda x: F.abs(x) >= least)
    rows = rows.withColumn("field_id", named).where("field_id IS NOT NULL").withColumn("_one", large(F.col("_line")))
    four = large(F.array_join(F.slice("_l", F.col("row") + 1, 4), " "))
    rows = rows.withColumn("value", F.get(F.when(F.size("_one") >= 2, F.col("_one")).otherwise(four), F.lit(1)))
    last = F.max_by(F.struct("row", "value"), F.when(F.col("value").isNotNull(), F.col("row")))
    return rows.groupBy(*keys, "field_id").agg(last.alias("r")).where("r IS NOT NULL").select(*keys, "field_id", "r.*")


def segment_narrative(df: DataFrame, keys: list[str], text: str, labels: dict[str, str]) -> DataFrame:
    """(keys, field_id, value): of sentences "(label) ... orders were N hundred millions" the first of each label."""
    t = F.regexp_replace(half_width(F.coalesce(F.col(text), F.lit(""))), "\\s+", " ")
    each = F.array(*[F.struct(F.lit(f).alias("field_id"), F.regexp_extract(t, f"\\({re.escape(label)}\\)[^。]{{0,80}}?受注高は\\s*([0-9,\\s]+?)\\s*億円", 1).alias("raw")) for label, f in labels.items()])
    rows = df.select(*keys, F.explode(each).alias("x")).select(*keys, "x.*").where("raw <> ''")
    return rows.select(*keys, "field_id", F.regexp_replace("raw", "[,\\s]", "").try_cast("double").alias("value"))
