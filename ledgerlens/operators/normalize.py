"""Normal forms of rows: extracted cells, securities, prices, order rows, facts in their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import parsing as P


def extraction(rows: DataFrame) -> DataFrame:
    """rows (field_id, value_raw, unit_raw, target_unit, data_scope, wanted_scope, review_reason, ...) with value, unit_normalized, review_required and the ordered distinct reasons joined by ;.

    A value that is no number, a unit that does not convert, an unknown unit and another scope are reasons for review;
    reasons that a row has stay first.
    """
    raw, parsed = F.col("value_raw"), E.parse_number(F.col("value_raw"))
    value = E.convert_unit(F.col("_parsed"), F.col("unit_raw"), F.col("target_unit"))
    unit = F.when(F.col("value").isNotNull(), F.col("target_unit")).otherwise(E.normalize_unit(F.col("unit_raw")))
    scope = F.coalesce("data_scope", F.lit(""))
    found = F.array(
        F.when(F.col("_parsed").isNull() & (F.coalesce(raw, F.lit("")) != ""), "number_parse_failed"),
        F.when(F.col("value").isNull() & F.col("_parsed").isNotNull(), "unit_conversion_failed"),
        F.when(F.col("unit_normalized").isNull() & F.col("_parsed").isNotNull(), "unit_unknown"),
        F.when((scope != "") & ~F.col("data_scope").eqNullSafe(F.col("wanted_scope")), "data_scope_mismatch"),
    )
    old = F.filter(F.split(F.coalesce("review_reason", F.lit("")), ";"), lambda x: x != "")
    out = rows.withColumn("_parsed", parsed).withColumn("value", value).withColumn("unit_normalized", unit)
    out = out.withColumn("review_reason", F.array_join(F.array_distinct(F.concat(old, F.array_compact(found))), ";"))
    return out.withColumn("review_required", F.col("review_reason") != "").drop("_parsed")


#: Columns of a security and what stands where a source has none.
SECURITY = {"listed_company_id": "", "operating_company_id": "", "operating_company_name": "", "stock_code": "", "ticker": "", "exchange": "JPX", "currency": "JPY", "fiscal_year_end_month": "3", "listed_from": "", "listed_to": "", "successor_listed_company_id": "", "enabled": "true", "source": "", "note": ""}


def securities(rows: DataFrame) -> DataFrame:
    """Securities in one form: ids stand in for each other, the ticker follows the code, missing columns have their defaults."""
    has = set(rows.columns)

    def first(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in has], F.lit(""))

    code = first("stock_code", "securities_code")
    made = {
        "stock_code": code,
        "ticker": F.when(first("ticker") != "", first("ticker")).when(code != "", F.concat(code, F.lit(".T"))).otherwise(""),
        "listed_company_id": F.when(first("listed_company_id", "operating_company_id") != "", first("listed_company_id", "operating_company_id")).otherwise(code),
        "operating_company_id": first("operating_company_id", "listed_company_id"),
        "enabled": F.lower(F.when(first("enabled") != "", first("enabled")).otherwise("true")),
        "note": F.coalesce(*[F.col(n).cast("string") for n in ("note", "notes") if n in has], F.lit("")),
    }
    return rows.select(*[(made[n] if n in made else F.coalesce(F.col(n).cast("string"), F.lit(d)) if n in has else F.lit(d)).alias(n) for n, d in SECURITY.items()])


def securities_of_companies(companies: DataFrame) -> DataFrame:
    """Securities derived from a company master (operating_company_id, operating_company_name, securities_code, fiscal_year_end_month, valid_from_year): one for each company with a code, listed from the first of January of its first year."""
    coded = companies.where(F.trim(F.coalesce("securities_code", F.lit(""))) != "")
    start = F.when(F.col("valid_from_year").isNotNull(), F.concat(F.col("valid_from_year").cast("int").cast("string"), F.lit("-01-01"))).otherwise("")
    return securities(coded.withColumn("listed_from", start).withColumn("source", F.lit("company_master")))


def numeric_columns(rows: DataFrame, columns: list[str], numeric: list[str]) -> DataFrame:
    """The columns in their order; blanks of numeric ones are null, columns that rows lack are empty texts, or nulls if numeric."""
    has = set(rows.columns)
    one = lambda n: (P.plain_number(F.col(n)) if n in has else F.lit(None).cast("double")) if n in numeric else (F.col(n) if n in has else F.lit(""))
    return rows.select(*[one(n).alias(n) for n in columns])


def category_of(raw: Column, keywords: dict[str, list[str]]) -> Column:
    """The first category one of whose keywords the text has, blanks aside; else its slug, else other_use."""
    text, out = P.compact(raw), F.when(F.lit(False), "")
    for category, words in keywords.items():
        out = out.when(P.has_any(text, ["".join(w.split()) for w in words]), category)
    own = P.word_slug(raw)
    return out.otherwise(F.when(own != "", own).otherwise("other_use"))


def order_rows(rows: DataFrame, companies: DataFrame, keywords: dict[str, list[str]], labels: dict[str, str]) -> DataFrame:
    """rows (company_id, company_name, use_category_raw, use_category_normalized, order_amount, amount_million_yen) with the company's name, the category, its label and clean numbers.

    companies (company_id, name) is a master of unique ids. What a row states stays.
    """
    named = companies.select(F.col("company_id").alias("_c"), F.col("name").alias("_name"))
    out = rows.join(named, F.col("company_id") == F.col("_c"), "left")
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    out = out.withColumn("company_name", F.coalesce(blank(F.col("company_name")), "_name", F.lit(""))).drop("_c", "_name")
    out = out.withColumn("use_category_normalized", F.coalesce(blank(F.col("use_category_normalized")), category_of(F.col("use_category_raw"), keywords)))
    given = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    label = F.coalesce(F.try_element_at(given, F.col("use_category_normalized")), blank(F.col("use_category_raw")), F.col("use_category_normalized"))
    return out.withColumn("use_category_label", label).withColumn("order_amount", P.clean_number(F.col("order_amount"))).withColumn("amount_million_yen", P.clean_number(F.col("amount_million_yen")))


def category_options(rows: DataFrame, order: str) -> DataFrame:
    """(id, name, category, unit, label): the distinct categories of order rows as fields one can choose; the first row by `order` names them."""
    slug = P.word_slug(F.coalesce(F.nullif(F.trim("use_category_normalized"), F.lit("")), F.trim("use_category_raw"), F.lit("")))
    kind = F.coalesce(F.nullif(F.trim("category_type"), F.lit("")), F.lit("category"))
    keyed = rows.withColumn("category", kind).withColumn("id", F.when(slug != "", F.concat(F.lit("order_amount__"), kind, F.lit("__"), slug))).where("id IS NOT NULL")
    name = F.coalesce(F.nullif("use_category_label", F.lit("")), F.nullif("use_category_raw", F.lit("")), F.col("id"))
    unit = F.coalesce(F.nullif("unit", F.lit("")), F.lit("億円"))
    first = keyed.groupBy("id").agg(F.min_by(F.struct(name.alias("name"), F.col("category"), unit.alias("unit")), order).alias("f")).select("id", "f.*")
    return first.withColumn("label", F.concat("name", F.lit(" ("), "category", F.lit(")")))


def fact_order(facts: DataFrame, keys: list[str]) -> DataFrame:
    """facts with their place among those of a key: known units first, then by file and row."""
    from pyspark.sql.window import Window

    known = F.when(F.col("unit").isin("円", "千円", "百万円", "億円", "%"), 0).otherwise(1)
    return facts.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(known, "file", "row")))


def configured_sources(config: dict, defaults: list[str]) -> list[dict]:
    """The sources of a configuration: the listed ones, and those of companies with the shared defaults under what each says. Driver-side: a configuration is a short list."""
    out = [dict(s) for s in config.get("sources") or []]
    for item in config.get("company_document_sources") or []:
        own = {**(config.get("document_source_defaults") or {}), **item}
        company = str(own.get("company_id") or "").strip()
        if company:
            dataset = f"{company.lower()}_company_factbook_documents"
            usual = {"id": dataset, "parser": "link_index", "enabled": True, "source_doc_type": "factbook_or_ir_data", "source_dataset_id": dataset, "source_metric_id": "building_use_metrics", "category_type": "use", "scope": "mixed", "business_scope": "building"}
            own = {**usual, **own}
            own["target_metric_ids"] = own.get("target_metric_ids") or list(defaults)
            out.append(own)
    return out
