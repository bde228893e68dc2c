"""Column expressions that read labels, periods, units, ratios and identifiers out of texts. All run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import half_width, loose_number, nullify_blank, stripped


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _ladder(steps: list[tuple[Column, object]], otherwise: object) -> Column:
    """The value of the first condition that holds."""
    out = F.when(F.lit(False), F.lit(None))
    for condition, value in steps:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def has_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def whole_number(c: Column, default: int | None = None) -> Column:
    """An integer, or the integer part of a number, or the default."""
    number = nullify_blank(c).try_cast("double")
    out = F.when(~F.isnan(number), number.cast("long"))
    return out if default is None else F.coalesce(out, F.lit(default).cast("long"))


def clean_number(c: Column, digits: int = 6) -> Column:
    """The number that a display text states (digits, dots and minus are kept, triangles are minus), rounded half to even as floats are."""
    return F.bround(loose_number(nullify_blank(c)), digits)


def plain_number(c: Column) -> Column:
    """A number with commas, and nothing else beside it; blank or other texts are null."""
    return F.replace(nullify_blank(c), F.lit(","), F.lit("")).try_cast("double")


def fact_number(c: Column) -> Column:
    """The number of a fact: commas go, a leading triangle is minus; marks of nothing and other texts are null."""
    text = F.trim(F.replace(_text(c), F.lit(","), F.lit("")))
    signed = F.when(text.rlike("^[△▲]"), F.concat(F.lit("-"), F.trim(F.substring(text, 2, 1 << 20)))).otherwise(text)
    return F.when(~text.isin("", "-", "－", "—", "―"), signed.try_cast("double"))


def million(value: Column, unit: Column) -> Column:
    """An amount in millions of the currency, by its unit's text; null for another unit."""
    number, u = clean_number(value, 12), _text(unit)
    return _ladder([(u.contains("億"), F.bround(number * 100, 6)), (u.contains("百万円"), number), (u.contains("千円"), F.bround(number / 1000, 6)), (u.contains("万円"), F.bround(number / 100, 6)), (u.contains("円"), F.bround(number / 1_000_000, 6))], None)


def comparable(value: Column, observed_unit: Column, concept_unit: Column) -> Column:
    """A fact's value in the unit of its concept: shares as they are, millions from units of one, others as they are."""
    observed, wanted = _text(observed_unit), _text(concept_unit)
    return F.when((wanted == "%") | (observed == "%"), value).when(wanted.isin("百万円", ""), F.bround(value / 1_000_000, 6)).otherwise(value)


def matches_in_unit(concept: Column, element: Column, unit: Column) -> Column:
    """Half a point for shares, else within max(1, 0.1 %)."""
    limit = F.when(_text(unit) == "%", F.lit(0.5)).otherwise(F.greatest(F.lit(1.0), F.abs(concept) * 0.001))
    return F.abs(concept - element) <= limit


def split_ratio(c: Column) -> Column:
    """a:b as a / b, a bare number as itself; null where a side is none or b is zero."""
    text = nullify_blank(c)
    left, right = F.split_part(text, F.lit(":"), F.lit(1)), F.regexp_replace(text, "^[^:]*:", "")
    return F.when(text.contains(":"), F.try_divide(plain_number(left), plain_number(right))).otherwise(plain_number(text))


def day_in_japan(epoch: Column) -> Column:
    """The day, nine hours ahead of UTC, of seconds since 1970."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor((epoch + 9 * 3600) / 86400).cast("int"))


def epoch_of(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400


def month_key(c: Column) -> Column:
    """Year and month of YYYY-MM... as 100 * year + month; zero for other texts."""
    m = F.left(_text(c), F.lit(7))
    year, month = F.regexp_extract(m, "^([0-9]+)-([0-9]+)$", 1).try_cast("long"), F.regexp_extract(m, "^([0-9]+)-([0-9]+)$", 2).try_cast("long")
    return F.coalesce(year * 100 + month, F.lit(0).cast("long"))


def fiscal_period(c: Column) -> Column:
    """(year, label) that a heading names: the term of a month (to March it belongs to the year before), a fiscal year, or any year from 2000; empty without one."""
    t = _text(c)
    term, own = "(20[0-9]{2})年\\s*([0-9]{1,2})月期", lambda p, g: F.regexp_extract(t, p, g)
    year, month = own(term, 1).try_cast("int"), own(term, 2).try_cast("int")
    fiscal = F.when(month <= 3, year - 1).otherwise(year).cast("string")
    named = _ladder([(t.rlike(term), fiscal), (t.rlike("20[0-9]{2}年度"), own("(20[0-9]{2})年度", 1)), (t.rlike("20[0-9]{2}"), own("(20[0-9]{2})", 1))], "")
    label = _ladder([(t.rlike(term), F.concat(year.cast("string"), F.lit("年"), month.cast("string"), F.lit("月期"))), (t.rlike("20[0-9]{2}年度"), F.concat(own("(20[0-9]{2})年度", 1), F.lit("年度")))], named)
    return F.struct(named.alias("year"), label.alias("label"))


def chart_period(c: Column, forecast: Column) -> Column:
    """(year, year_end, period_type, label) of a chart's category that begins with YYYYMMDD; other texts are their own label."""
    t = _text(c)
    day = "(20[0-9]{2})([0-9]{2})([0-9]{2})"
    year, month = F.regexp_extract(t, day, 1).try_cast("int"), F.regexp_extract(t, day, 2).try_cast("int")
    found, kind = t.rlike(day), F.when(forecast, "forecast_annual").otherwise("annual")
    label = F.concat(year.cast("string"), F.lit("年"), month.cast("string"), F.lit("月期"), F.when(forecast, "予想").otherwise(""))
    return F.struct(
        F.when(found, F.when(month <= 3, year - 1).otherwise(year).cast("string")).otherwise(t).alias("year"),
        F.when(found & (month == 3), F.concat(year.cast("string"), F.lit("-03-31"))).otherwise("").alias("year_end"),
        kind.alias("period_type"), F.when(found, label).otherwise(t).alias("label"),
    )


def period_type(c: Column) -> Column:
    """Quarter, year or whole document that a heading speaks of."""
    t = _text(c)
    return _ladder([(t.contains("第1四半期"), "q1"), (has_any(t, ["第2四半期", "中間"]), "q2"), (t.contains("第3四半期"), "q3"), (has_any(t, ["第4四半期", "通期"]), "annual")], "document")


def note_period(c: Column) -> Column:
    """(year, month) of YYYY or YYYY(M); null for other texts, the month null without one."""
    pattern = "^\\s*([0-9]{4})(?:\\(([0-9]{1,2})\\))?\\s*$"
    part = lambda g: F.regexp_extract(c, pattern, g).try_cast("int")
    return F.when(c.rlike(pattern), F.struct(part(1).alias("year"), part(2).alias("month")))


def utc_time(c: Column) -> Column:
    """ISO date and time as seconds since 1970; without a zone it is UTC, other texts are null."""
    t = F.regexp_replace(stripped(_text(c)), "Z$", "+00:00")
    zoned = F.when(t.rlike("[+-][0-9]{2}:[0-9]{2}$"), t).when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.concat(t, F.lit("T00:00:00+00:00"))).otherwise(F.concat(t, F.lit("+00:00")))
    form = "^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\\.[0-9]+)?)?[+-][0-9]{2}:[0-9]{2}$"
    return F.when(zoned.rlike(form), F.unix_timestamp(F.try_to_timestamp(F.replace(zoned, F.lit(" "), F.lit("T")))))


# Legal forms and marks that a company's name is compared without.
LEGAL_FORMS = ["株式会社", "（株）", "(株)", "㈱", " ", "　", "・", ".", "．"]


def company_name(c: Column) -> Column:
    """A company's name without its legal form, blanks and dots."""
    out = F.trim(c)
    for mark in LEGAL_FORMS:
        out = F.replace(out, F.lit(mark), F.lit(""))
    return out


def compact(c: Column) -> Column:
    return F.regexp_replace(_text(c), "\\s+", "")


def file_name(c: Column) -> Column:
    """Letters, digits, dots, minus and underscores; other runs are one underscore."""
    out = F.btrim(F.regexp_replace(_text(c), "[^a-zA-Z0-9_.\\-]+", "_"), F.lit("_"))
    return F.when(out == "", "source").otherwise(out)


def word_slug(c: Column) -> Column:
    """The lower-case Latin letters and digits of a text joined by underscores; of a text without such the letters of any script."""
    t = F.lower(compact(c))
    latin = F.btrim(F.regexp_replace(t, "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(latin != "", latin).otherwise(F.btrim(F.regexp_replace(t, "[^\\p{L}\\p{N}_]+", "_"), F.lit("_")))


def after_first(c: Column) -> Column:
    """What follows the first underscore of a context; empty without one."""
    return F.when(c.contains("_"), F.regexp_replace(c, "^[^_]*_", "")).otherwise("")


def after_last(c: Column) -> Column:
    """What follows the last underscore; all without one."""
    return F.substring_index(c, "_", -1)


def unit_hint(c: Column) -> Column:
    t = _text(c)
    return _ladder([(t.contains(u), u) for u in ("百万円", "千円", "億円", "円", "%", "人")], "")


def scope_hint(c: Column) -> Column:
    t = _text(c)
    return _ladder([(has_any(t, ["単独", "提出会社", "当社"]), "standalone"), (has_any(t, ["連結", "グループ"]), "consolidated"), (t.contains("セグメント"), "segment")], "unknown")


def concept_scope(c: Column) -> Column:
    """The scope that a concept's name speaks of; empty if none."""
    t = F.trim(_text(c))
    return _ladder([(t.contains("単独"), "standalone"), (t.contains("連結"), "consolidated"), (t.contains("セグメント"), "segment")], "")


def concept_unit(c: Column) -> Column:
    """The unit that a concept of an item is kept in: money in millions."""
    t = F.trim(_text(c))
    return F.when(t == "円", "百万円").otherwise(t)


def amounts(c: Column) -> Column:
    """The numbers of a text in order, as doubles; those in brackets or parentheses go first, triangles are minus."""
    t = F.regexp_replace(half_width(_text(c)), "[\\[［【〔]\\s*[+-]?[0-9][0-9,\\s.]*(?:\\.[0-9]+)?\\s*[\\]］】〕]|\\(\\s*[0-9][0-9,\\s.]*(?:\\.[0-9]+)?\\s*\\)", " ")
    token = "([△▲]?\\(?(?:[0-9]{1,3}(?:,\\s?[0-9]{3})+|[0-9]+)(?:\\.[0-9]+)?\\)?)"
    # A mark of a negative becomes a sign, all else but digits and dots goes.
    return F.transform(F.regexp_extract_all(t, F.lit(token)), lambda x: F.translate(x, "△▲(),\u0020\u0009\u000a\u000b\u000c\u000d", "---").try_cast("double"))


def plausible(field: Column, value: Column, unit: Column) -> Column:
    """Bounds of the fields that have any: ages, years of service, salaries by their unit, head counts."""
    floor = F.when(unit.isin("百万円", "億円"), 1.0).otherwise(100.0)
    return _ladder([(field == "average_age", value.between(10, 100)), (field == "average_tenure", value.between(0, 80)), (field == "average_salary", value >= floor), (field == "employees_standalone", value >= 0)], True)


def half_year_tokens(tokens: Column, period: Column) -> Column:
    """Context tokens of a half-year report in place of those of a year."""
    moved = F.transform(tokens, lambda t: F.when(t == "CurrentYearDuration", "CurrentYTDDuration").when(t == "CurrentYearInstant", "CurrentQuarterInstant").otherwise(t))
    return F.when(period == "semiannual_h1", moved).otherwise(tokens)


DURATIONS, INSTANTS = ("CurrentYearDuration", "CurrentYTDDuration"), ("CurrentYearInstant", "CurrentQuarterInstant")


def context_fits(context: Column, relative_year: Column, period: Column, scope: Column, tokens: Column, annual_only: bool = False) -> Column:
    """Whether a fact's context meets every token.

    A period token must begin the context, or the fact's own year and period say the same; with a member token the context
    is the period token with that member, the consolidated one also without. Other tokens are part of the context, or the
    fact's period or scope stands for them. annual_only knows the tokens of a whole year and fewer words for it.
    """
    c, years, p = _text(context), _text(relative_year), _text(period)
    durations, instants = (DURATIONS[:1], INSTANTS[:1]) if annual_only else (DURATIONS, INSTANTS)
    current = has_any(years, ["当期", "当年度"] if annual_only else ["当期", "当年度", "当四半期", "当中間"])
    says = lambda t: (t.isin(*durations) & current & p.contains("期間")) | (t.isin(*instants) & current & p.contains("時点"))
    periods = F.filter(tokens, lambda t: t.isin(*durations, *instants))
    first, none = F.coalesce(F.get(periods, F.lit(0)), F.lit("")), F.size(periods) == 0
    member = lambda m: F.array_contains(tokens, m)
    head = (
        F.when(none, True)
        .when(member("NonConsolidatedMember"), c == F.concat(first, F.lit("_NonConsolidatedMember")))
        .when(member("ConsolidatedMember"), (c == first) | (c == F.concat(first, F.lit("_ConsolidatedMember"))))
        .otherwise(c.startswith(first) | says(first))
    )
    one = lambda t: c.contains(t) | says(t) | ((t == "ConsolidatedMember") & (scope.eqNullSafe("consolidated") | (~none & (c == first)))) | (t.isin("NonConsolidatedMember", "StandaloneMember") & scope.eqNullSafe("standalone"))
    return F.coalesce(head & F.forall(tokens, one), F.lit(False))


# Names in segment contexts that are, and are not, of the construction business.
SEGMENT_OUT = ["RealEstate", "Development", "ReserveForConstruction", "RoadConstructionAndPaving", "AdvertisingAgency", "GolfCourse", "HotelBusiness", "ServiceRelated", "Infrastructure", "Manufacturing", "Machinery", "Subsidiaries", "AssociateCompanies", "Other"]
SEGMENT_IN = ["Construction", "Building", "CivilEngineering"]
SUBSEGMENTS = ["BuildingConstruction", "CivilEngineeringReportable", "DomesticBuilding", "DomesticCivil", "DomesticConstruction", "OverseasBuilding", "OverseasCivil", "OverseasConstruction", "BuildingReportableSegment"]
BROAD = ["ConstructionReportableSegment", "ConstructionBusinessReportableSegment", "ConstructionBusinessOfTheCorporationReportableSegment", "ConstructionRelatedBusinessReportableSegment", "CivilEngineeringAndBuildingConstructionReportableSegment", "ConstructionConstructionReportableSegment"]


def construction_segment(context: Column) -> Column:
    """Whether a context's last part is a reportable segment of construction, and no other business."""
    s = after_last(_text(context))
    lone_engineering = ~s.contains("CivilEngineering") & s.contains("Engineering")
    return s.contains("ReportableSegment") & ~has_any(s, SEGMENT_OUT) & ~lone_engineering & has_any(s, SEGMENT_IN)


def broad_segment(context: Column) -> Column:
    """Whether it is construction as a whole and not a part of it."""
    s = after_last(_text(context))
    part = ~s.contains("CivilEngineeringAndBuildingConstruction") & has_any(s, SUBSEGMENTS)
    return ~part & has_any(s, BROAD)


def fact_scope(c: Column) -> Column:
    t = _text(c)
    return F.when(t.contains("連結"), "consolidated").when(has_any(t, ["個別", "単独"]), "standalone")


def correction(description: Column, form: Column, words: list[str]) -> Column:
    """Whether a filing corrects another: by a word of its description, or a form code that ends in 001."""
    return has_any(_text(description), words) | _text(form).endswith("001")


def eligible(description: Column, ordinance: Column, form: Column, withdrawn: Column, undisclosed: Column, include: list[str], exclude: list[str], ordinances: list[str], forms: list[str]) -> Column:
    """Whether a filing is one to be read: words it has and lacks, code lists (empty: any), and neither withdrawn nor undisclosed."""
    t = _text(description)
    ok = (has_any(t, include) if include else F.lit(True)) & ~has_any(t, exclude)
    ok = ok & (_text(ordinance).isin(*ordinances) if ordinances else F.lit(True)) & (_text(form).isin(*forms) if forms else F.lit(True))
    return ok & (_text(withdrawn) != "1") & (_text(undisclosed) != "1")


def table_class(text: Column, metric: Column, uses: list[str], orders: list[str], completions: list[str], hints: list[str]) -> Column:
    """(accept, metric_id, reason) of a table by its words: a use, and orders or completions."""
    t = F.lower(_text(text))
    use, order, done, hinted = has_any(t, uses), has_any(t, orders), has_any(t, completions), _text(metric).isin(*hints)
    return F.struct(
        (use & (order | done)).alias("accept"),
        _ladder([(use & order, "building_orders_by_use"), (use & done, "completed_building_by_use")], "").alias("metric_id"),
        _ladder([(~use, "no_use_category_keywords"), (order, "order_keywords"), (done, "completion_keywords"), (hinted, "source_metric_hint_requires_table_keywords_or_ai")], "no_metric_keywords").alias("reason"),
    )


SEGMENT_PREFIXES = ["segment_sales_", "segment_profit_", "segment_orders_", "employees_segment_"]


def segment_metadata(field: Column, entity: Column) -> Column:
    """(key, taxonomy) of a segment's field: its id without the measure, and whether it is one entity's own; null for other fields."""
    own = (F.coalesce(entity, F.lit("")) != "") & field.contains(F.concat(F.lit("_"), entity, F.lit("_")))
    key = F.regexp_replace(field, "^(?:" + "|".join(SEGMENT_PREFIXES) + ")", "")
    return F.when(field.startswith("segment_") | field.startswith("employees_segment_"), F.struct(key.alias("key"), F.when(own, "company_specific").otherwise("common").alias("taxonomy")))


def metric_ids(listed: Column, metric: Column, groups: list[str], defaults: list[str]) -> Column:
    """The metrics of a source: its list (by ; , 、 or blanks), else its own metric; a group's name stands for the defaults."""
    own = F.filter(F.split(_text(listed), "[;,、\\s]+"), lambda x: x != "")
    m = F.trim(_text(metric))
    return F.when(F.size(own) > 0, own).when(m.isin(*groups), F.array(*map(F.lit, defaults))).when(m != "", F.array(m)).otherwise(F.array().cast("array<string>"))
