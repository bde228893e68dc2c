"""Column expressions: blanks, numbers, units, dates, ids, tolerances and texts. All run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing value, and marks of null in numbers.
BLANKS = ["", "nan", "none", "null", "<na>"]
NULL_MARKS = ["", "-", "－", "—", "―", "–", "N/A", "n/a", "None", "null"]
#: Characters that compatibility folding (NFKC) turns into plain ones, as far as numbers, units and labels have them: the
#: full-width forms of ASCII, the wide, thin and no-break blanks, and raised and lowered digits.
FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000\u00a0\u2002\u2003\u2009" + "\u00b9\u00b2\u00b3" + "".join(map(chr, [0x2070, *range(0x2074, 0x207A), *range(0x2080, 0x208A)]))
HALF_WIDTH = "".join(map(chr, range(0x21, 0x7F))) + " " * 5 + "123" + "0456789" + "0123456789"
# How many million of the base currency a money unit is.
MONEY = {"円": 1e-6, "千円": 1e-3, "百万円": 1.0, "億円": 100.0}
TRUE_TEXTS = ("true", "1", "yes")


def nullify_blank(c: Column) -> Column:
    """Null where the trimmed text stands for a missing value; otherwise the text."""
    text = c.cast("string")
    return F.when(~F.lower(F.trim(text)).isin(BLANKS), text)


def truthy(c: Column, accepted: tuple[str, ...] = TRUE_TEXTS) -> Column:
    """Whether a mixed boolean column says yes; null says no."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*accepted), F.lit(False))


def half_width(c: Column) -> Column:
    """Compatibility folding of the characters in FULL_WIDTH; texts of plain ASCII, one byte a character, pass as they are."""
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.translate(c, FULL_WIDTH, HALF_WIDTH))


def finite(c: Column) -> Column:
    """A double, or null where the text is none or it is not a number."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number), number)


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def parse_number(c: Column) -> Column:
    """Locale number: full-width forms, null marks, one leading triangle and then parentheses as marks of a negative, commas, blanks and percent signs.

    With a mark the number is negative whatever its sign. Null marks have no digits and so give null.
    """
    text = half_width(c.cast("string"))
    bare = F.translate(F.regexp_extract(text, "^\\s*[△▲]?\\(?([-+0-9., %]*)\\)?\\s*$", 1), ", %", "")
    balanced = text.contains("(") == text.contains(")")
    number = F.when(balanced & bare.rlike("^[+-]?[0-9]+(\\.[0-9]+)?$"), bare.try_cast("double"))
    return F.when(text.rlike("^\\s*[△▲(]"), -F.abs(number)).otherwise(number)


def loose_number(c: Column) -> Column:
    """Keeps digits, dots and minus only; triangles are minus."""
    text = half_width(c.cast("string"))
    number = F.regexp_replace(text, "[^0-9.\\-]", "").try_cast("double")
    return F.when(text.rlike("[△▲]"), -F.abs(number)).otherwise(number)


#: Units in their order of precedence, each with the texts that name it.
UNITS = {"百万円": ["百万円"], "千円": ["千円"], "億円": ["億円"], "円": ["円"], "人": ["人"], "年": ["年"]}


def normalize_unit(c: Column) -> Column:
    """The first unit, in the order of precedence, that the text contains; null without one. The bare share is named by the whole text only."""
    text = stripped(F.replace(stripped(half_width(c)), F.lit("単位:"), F.lit("")))
    out = F.when(text.contains("%"), "%").when(F.lower(text) == "pure", "pure").when(text.contains("歳") | text.contains("才"), "歳")
    for unit in UNITS:
        out = out.when(text.contains(unit), unit)
    return out


def _million(unit: Column) -> Column:
    return F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for kv in MONEY.items() for x in kv]), lambda k, _: k == unit)), F.lit(0))


def convert_unit(value: Column, unit: Column, target: Column) -> Column:
    """value in the target unit, its own unit being normalized first: equal units, years of age, money by its factor, shares to percent; else null."""
    own = normalize_unit(unit)
    age = own.isin("歳", "年") & target.isin("歳", "年")
    money = own.isin(*MONEY) & target.isin(*MONEY)
    return F.when(own == target, value).when(age, value).when(money, value * _million(own) / _million(target)).when((own == "pure") & (target == "%"), value * 100)


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null if either is null or b is zero."""
    return F.try_divide(a, b)


def sum_if_all(*cs: Column) -> Column:
    """The sum, null as soon as one is."""
    total = cs[0]
    for c in cs[1:]:
        total = total + c
    return total


def fiscal_year(day: Column, end_month: int | Column = 3) -> Column:
    """Fiscal year that a day falls in, named by the calendar year in which it begins; December years are calendar years."""
    end = F.lit(end_month) if isinstance(end_month, int) else end_month
    return F.when((F.month(day) > end) | (end == 12), F.year(day)).otherwise(F.year(day) - 1)


def fiscal_year_end(year: Column, end_month: int = 3) -> Column:
    return F.last_day(F.make_date(year + (0 if end_month == 12 else 1), F.lit(end_month), F.lit(1)))


def stable_id(prefix: str, *cs: Column) -> Column:
    """prefix_ and 16 hexadecimal digits of the SHA-1 of the columns joined by |; null joins as empty."""
    return F.concat(F.lit(prefix + "_"), F.left(F.sha1(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cs])), F.lit(16)))


def within(diff: Column, base: Column, absolute: float, share: float) -> Column:
    """|diff| <= max(absolute, |base| * share): the form of all tolerance rules; callers choose base and limits."""
    return F.abs(diff) <= F.greatest(F.lit(float(absolute)), F.abs(base) * F.lit(float(share)))


def evidence_match(a: Column, b: Column, absolute: float = 1.0, share: float = 0.001) -> Column:
    return within(a - b, F.greatest(F.abs(a), F.abs(b), F.lit(1.0)), absolute, share)


def supports(evidence: Column, cell: Column) -> Column:
    """Whether an evidence value equals the cell on either scale, as is or in millions."""
    limit = F.greatest(F.lit(1.0), F.abs(cell) * 0.005)
    return F.coalesce((F.abs(cell - evidence) <= limit) | (F.abs(cell - evidence / 1e6) <= limit), F.lit(False))


def golden_match(expected: Column, actual: Column) -> Column:
    """Numbers within max(1, 0.1 %), other texts if equal."""
    a, b = finite(expected), finite(actual)
    return F.when(a.isNotNull() & b.isNotNull(), within(a - b, a, 1.0, 0.001)).otherwise(expected.cast("string") == actual.cast("string"))


def entity_of(key: Column) -> Column:
    """Everything before the last underscore of a composite key."""
    return F.regexp_extract(key, "^(.*)_[^_]*$", 1)


def year_of(key: Column) -> Column:
    return F.regexp_extract(key, "_([0-9]{4})[^_]*$", 1).try_cast("int")


def split_terms(c: Column, sep: str = ";") -> Column:
    """Trimmed, non-empty terms of a list in a text."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != "")


def merge_terms(old: Column, new: Column) -> Column:
    """old with the terms of new it lacks (letter case aside), in order."""
    known = F.transform(split_terms(old), lambda x: F.lower(x))
    added = F.filter(split_terms(new), lambda x: ~F.array_contains(known, F.lower(x)))
    return F.array_join(F.concat(split_terms(old), F.array_distinct(added)), ";")


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def first_category(c: Column, keywords: dict[str, list[str]]) -> Column:
    """The first category, in the order given, one of whose keywords the text contains; else its slug."""
    out = F.when(F.lit(False), F.lit(""))
    for category, words in keywords.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | c.contains(w)
        out = out.when(hit, category)
    return out.otherwise(slug(c))


def html_to_text(c: Column) -> Column:
    """Text of a page: scripts and styles go, block ends become line feeds, tags go, entities decode, blanks collapse."""
    text = F.regexp_replace(c, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, "(?i)<(br|/p|/tr|/div|/table|/h[1-6])[^>]*>", "\n")
    text = F.regexp_replace(text, "(?s)<[^>]+>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.btrim(F.regexp_replace(F.regexp_replace(text, "[ \\t\\r]+", " "), " ?\\n[ \\n]*", "\n"), F.lit(" \n"))


def quote(label: Column, value: Column, limit: int = 500) -> Column:
    return F.left(F.concat(label, F.lit(": "), F.regexp_replace(F.trim(value), "\\s+", " ")), F.lit(limit))
