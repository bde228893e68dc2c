"""Rows out of table-like texts: labels and the numbers behind them, identities that choose and grade a row, blocks and melts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import half_width, within

MOST = 8  # numbers of a run
AMOUNT = r"(\(?[△▲]?[0-9][0-9,]*(?:\.[0-9]+)?\)?|[－—―–]|(?<![0-9A-Za-z])-(?![0-9]))"


def _number(token: Column) -> Column:
    """Marks of a negative become one sign; what is no number then is null."""
    return F.replace(F.translate(token, "△▲(),", "---"), F.lit("--"), F.lit("-")).try_cast("double")


def label_runs(df: DataFrame, keys: list[str], text: str, labels: dict[str, list[str]]) -> DataFrame:
    """(keys, place, field_id, label, values): each label in the text and the numbers up to the next label, at most MOST; a dash is a null.

    Labels do not overlap: the leftmost wins, of those that begin together the longest. Labels are found once; the texts
    behind them are what a split at the labels leaves.
    """
    owner = {half(x): f for f, xs in labels.items() for x in xs}
    either = "|".join(re.escape(x) for x in sorted(owner, key=lambda x: (-len(x), x)))
    t = half_width(F.coalesce(F.col(text), F.lit("")))
    found = df.select(*keys, t.alias("_t")).where(F.col("_t").rlike(either))
    tails = F.slice(F.split("_t", f"(?:{either})"), 2, 1 << 30)
    pairs = F.arrays_zip(F.regexp_extract_all("_t", F.lit(f"({either})"), 1).alias("label"), tails.alias("tail"))
    # Outer, as the optimizer would compute a plain explode's array once more to ask for its size; no text here is without a label.
    rows = found.select(*keys, F.posexplode_outer(pairs).alias("place", "p")).select(*keys, "place", "p.label", "p.tail")
    field = F.create_map(*[F.lit(x) for kv in owner.items() for x in kv])
    values = F.transform(F.slice(F.regexp_extract_all("tail", F.lit(AMOUNT)), 1, MOST), _number)
    return rows.select(*keys, "place", field[F.col("label")].alias("field_id"), "label", values.alias("values"))


def half(text: str) -> str:
    """half_width() of a plain text."""
    from ..functions.exprs import FULL_WIDTH, HALF_WIDTH

    return text.translate(str.maketrans(FULL_WIDTH, HALF_WIDTH))


def segment(text: Column, start: str, ends: list[str]) -> Column:
    """The text from a pattern on up to the earliest of the end marks; null without the pattern."""
    at = F.regexp_instr(text, F.lit(start))
    rest = F.substr(text, at)
    cut = [F.nullif(F.locate(e, rest, 2), F.lit(0)) for e in ends]
    end = F.least(*cut) if len(cut) > 1 else cut[0] if cut else F.lit(None)
    return F.when(at > 0, F.when(end.isNull(), rest).otherwise(F.left(rest, end - 1)))


def current_value(values: Column, percent: Column) -> Column:
    """The current one of a run of numbers: of shares the last up to 1,000 (else the last); of four or more that alternate
    amounts and ratios the third; else the last.
    """
    n, at = F.size(values), lambda i: F.abs(F.get(values, F.lit(i)))
    pairs = (n >= 4) & (at(1) <= 100) & (at(3) <= 100) & ((at(0) > 100) | (at(2) > 100))
    shares = F.filter(values, lambda x: F.abs(x) <= 1000)
    last = F.get(values, n - 1)
    return F.when(n == 0, None).when(percent, F.coalesce(F.get(shares, F.size(shares) - 1), last)).when(pairs, F.get(values, F.lit(2))).otherwise(last)


def order_row(values: Column) -> Column:
    """A row previous, orders, completed, next as a struct with its grade: .90 where previous + orders - completed = next within max(2, 0.1 %), else .78 and to be reviewed.

    A negative first number before a row of amounts is a misread mark and goes.
    """
    v = F.when((F.size(values) >= 6) & (F.get(values, F.lit(0)) < 0) & (F.get(values, F.lit(1)) >= 0), F.slice(values, 2, MOST)).otherwise(values)
    a, b, c, d = (F.get(v, F.lit(i)) for i in range(4))
    fits = F.coalesce(within(a + b - c - d, d, 2.0, 0.001), F.lit(False))
    return F.struct(a.alias("previous"), b.alias("orders"), c.alias("completed"), d.alias("next"), F.when(fits, 0.9).otherwise(0.78).alias("confidence"), (~fits).alias("review_required"))


def breakdown(values: Column, parts: int) -> Column:
    """Parts and a total after them, only where they add up within max(2, 0.1 %); else null."""
    own, total = F.slice(values, 1, parts), F.get(values, F.lit(parts))
    added = F.aggregate(own, F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(values) > parts) & F.coalesce(within(added - total, total, 2.0, 0.001), F.lit(False)), F.struct(own.alias("parts"), total.alias("total")))


def hundred(a: Column, b: Column) -> Column:
    """Whether two shares make up the whole, within 0.2."""
    return F.coalesce(F.abs(a + b - 100) <= 0.2, F.lit(False))


def first_per_cell(rows: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """The first value of each cell by block score, then by the order of the rules."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def blocks(rows: DataFrame, keys: list[str], order: str, cells: list[str]) -> DataFrame:
    """Rows that are not empty, numbered by the block they are in: empty rows part blocks (gaps and islands)."""
    empty = F.lit(True)
    for c in cells:
        empty = empty & (F.coalesce(F.trim(c), F.lit("")) == "")
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("_e", empty).withColumn("_n", F.sum(F.col("_e").cast("int")).over(w)).where("NOT _e")
    return marked.withColumn("block", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_n")) - 1).drop("_e", "_n")


def melt(rows: DataFrame, keys: list[str], category: str, value_columns: dict[str, str], totals: str = "合計|総計|(?i)^total") -> DataFrame:
    """(keys, category, period, amount): value columns become rows; total rows and blank amounts go."""
    kept = rows.where(~F.col(category).rlike(totals))
    out = kept.select(*keys, F.col(category).alias("category"), *[F.col(c).cast("string").alias(p) for c, p in value_columns.items()]).unpivot([*keys, "category"], list(value_columns.values()), "period", "raw")
    return out.withColumn("amount", _number(half_width(F.col("raw")))).where("amount IS NOT NULL").drop("raw")


def cost_value(text: Column, label: str) -> Column:
    """The current (second) amount behind a label of pairs amount ratio amount ratio; with a single amount, that one."""
    tail = F.regexp_extract(half_width(text), re.escape(label) + r"[^0-9△▲(]*((?:[△▲(]?[0-9][0-9,.]*\)?[%\s]*)+)", 1)
    numbers = F.transform(F.regexp_extract_all(tail, F.lit(AMOUNT)), _number)
    amounts = F.filter(numbers, lambda x, i: (F.size(numbers) < 4) | (i % 2 == 0))
    return F.when(F.size(amounts) >= 2, F.get(amounts, F.lit(1))).otherwise(F.get(amounts, F.lit(0)))


def json_in(text: Column) -> Column:
    """The JSON of a noisy text: itself, what a fence holds, or the span of the outermost braces; null if none parses."""
    fence = F.regexp_extract(text, "(?s)```(?:json)?\\s*(.*?)```", 1)
    braces = F.regexp_extract(text, "(?s)(\\{.*\\}|\\[.*\\])", 1)
    ok = lambda c: F.when((c != "") & F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(ok(F.btrim(text, F.lit(" \n\r\t"))), ok(F.btrim(fence, F.lit(" \n\r\t"))), ok(braces))


def reverse_lookup(cells: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks and roles whose value is the cell's, within max(1, 0.1 %): confidence .95 for a five-tuple, .80 else, .2 less if its neighbours disagree.

    cells: keys, field_id, value; found: keys, block, role, amount, fitted, consistent. Only rows of the same document meet.
    """
    near = cells.join(found, keys).where(F.col("value").isNotNull() & within(F.col("value") - F.col("amount"), F.col("value"), 1.0, 0.001))
    confidence = F.when(F.col("fitted"), 0.95).otherwise(0.8) - F.when(F.col("consistent"), 0.0).otherwise(0.2)
    return near.withColumn("confidence", F.round(confidence, 2)).select(*keys, "field_id", "block", "role", "confidence")


def recovery(cells: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Class of each cell: already_filled, recoverable_high (one distinct value), recoverable_low (several) or not_found."""
    seen = found.groupBy(*keys).agg(F.count_distinct("amount").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    kind = F.when(F.col("value").isNotNull(), "already_filled").when(n == 1, "recoverable_high").when(n > 1, "recoverable_low").otherwise("not_found")
    return cells.join(seen, keys, "left").withColumn("recovery", kind).drop("_n")
