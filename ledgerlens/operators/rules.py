"""Declarative rules over a long table of cells (key, field, value): identities, bounds, year-on-year and roll-forward."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import safe_ratio, within

RESULT = ["entity", "year", "rule_id", "status", "field_ids", "difference", "missing"]
RANK = {"not_applicable": 0, "pass": 1, "warn": 2, "fail": 3}


@dataclass(frozen=True)
class SumRule:
    """left is the sum of parts, within a tolerance of left."""

    rule_id: str
    left: str
    parts: tuple[str, ...]
    absolute: float = 10.0
    share: float = 0.01


@dataclass(frozen=True)
class BoundRule:
    """Each field is at most the bound."""

    rule_id: str
    fields: tuple[str, ...]
    bound: str


@dataclass(frozen=True)
class ChangeRule:
    """A change of more than `share` against the previous row of entity and field is a warning."""

    rule_id: str
    fields: tuple[str, ...]
    share: float = 0.5


@dataclass(frozen=True)
class RollRule:
    """previous closing + inflow - outflow is the closing value, within a tolerance of it."""

    rule_id: str
    closing: str
    inflow: str
    outflow: str
    absolute: float = 50.0
    share: float = 0.03


def wide(cells: DataFrame, fields: list[str]) -> DataFrame:
    """One row an entity and year, with a column for each field; of several rows of a cell the last by a column `ordinal` counts, if there is one, also where it is null."""
    value = F.max_by("value", "ordinal") if "ordinal" in cells.columns else F.first("value")
    return cells.groupBy("entity", "year").pivot("field_id", fields).agg(value)


def _result(rule_id: str, status: Column, fields: Column, difference: Column, missing: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(
        F.lit(rule_id).alias("rule_id"), status.alias("status"), fields.alias("field_ids"),
        difference.cast("double").alias("difference"), (none if missing is None else missing).alias("missing"),
    )


def sum_rule(rule: SumRule) -> list[Column]:
    """Missing fields are named, and a rule without all of its fields does not apply."""
    names = [rule.left, *rule.parts]
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names]))
    total = sum((F.col(p) for p in rule.parts[1:]), F.col(rule.parts[0]))
    diff = F.col(rule.left) - total
    status = F.when(F.size(missing) > 0, "not_applicable").when(within(diff, F.col(rule.left), rule.absolute, rule.share), "pass").otherwise("fail")
    return [_result(rule.rule_id, status, F.array(*map(F.lit, names)), diff, missing)]


def bound_rule(rule: BoundRule) -> list[Column]:
    out = []
    for f in rule.fields:
        value, bound = F.col(f), F.col(rule.bound)
        status = F.when(value.isNull() | bound.isNull(), "not_applicable").when(value <= bound, "pass").otherwise("fail")
        out.append(_result(rule.rule_id, status, F.array(F.lit(f), F.lit(rule.bound)), value - bound))
    return out


def roll_rule(rule: RollRule) -> list[Column]:
    """Against the closing value of the entity's row before, whatever its year: the column _before_<closing> that validate() adds."""
    diff = F.col(f"_before_{rule.closing}") + F.col(rule.inflow) - F.col(rule.outflow) - F.col(rule.closing)
    status = F.when(diff.isNull(), "not_applicable").when(within(diff, F.col(rule.closing), rule.absolute, rule.share), "pass").otherwise("fail")
    return [_result(rule.rule_id, status, F.array(*map(F.lit, (rule.closing, rule.inflow, rule.outflow))), diff)]


def change_rule(cells: DataFrame, rule: ChangeRule) -> DataFrame:
    """value / before - 1 against the previous row, whatever its year; a null or zero before is no base."""
    rows = cells.where(F.col("field_id").isin(*rule.fields))
    before = F.lag("value").over(Window.partitionBy("entity", "field_id").orderBy("year"))
    change = safe_ratio(F.col("value"), F.col("_before")) - 1
    rows = rows.withColumn("_before", before).withColumn("_change", change)
    status = F.when(F.col("_change").isNull(), "not_applicable").when(F.abs("_change") > rule.share, "warn").otherwise("pass")
    return rows.select("entity", "year", _result(rule.rule_id, status, F.array("field_id"), F.col("_change")).alias("r")).select("entity", "year", "r.*")


ROW_KINDS = {SumRule: sum_rule, BoundRule: bound_rule, RollRule: roll_rule}


def fields_of(rule) -> list[str]:
    if isinstance(rule, SumRule):
        return [rule.left, *rule.parts]
    return [*rule.fields, rule.bound] if isinstance(rule, BoundRule) else [rule.closing, rule.inflow, rule.outflow]


def validate(cells: DataFrame, rules: list) -> DataFrame:
    """All results of all rules (see RESULT), by the kind of each: rules over one row share one pivot of the cells, and every entity and year gets a result of each."""
    rowwise, changes = [r for r in rules if type(r) in ROW_KINDS], [r for r in rules if isinstance(r, ChangeRule)]
    out = None
    if rowwise:
        rows = wide(cells, list(dict.fromkeys(f for r in rowwise for f in fields_of(r))))
        for closing in dict.fromkeys(r.closing for r in rowwise if isinstance(r, RollRule)):
            rows = rows.withColumn(f"_before_{closing}", F.lag(closing).over(Window.partitionBy("entity").orderBy("year")))
        found = F.array(*[c for r in rowwise for c in ROW_KINDS[type(r)](r)])
        out = rows.select("entity", "year", F.explode(found).alias("r")).select("entity", "year", "r.*")
    for rule in changes:
        one = change_rule(cells, rule)
        out = one if out is None else out.unionByName(one)
    return out.select(*RESULT)


def attach_worst(cells: DataFrame, results: DataFrame) -> DataFrame:
    """cells with the worst status of the rules that name their field, and its reason."""
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    names = F.create_map(*[F.lit(x) for k, v in RANK.items() for x in (v, k)])
    worst = results.select("entity", "year", F.explode("field_ids").alias("field_id"), rank[F.col("status")].alias("rank")).groupBy("entity", "year", "field_id").agg(F.max("rank").alias("rank"))
    out = cells.join(worst, ["entity", "year", "field_id"], "left").withColumn("validation_status", F.coalesce(names[F.col("rank")], F.lit("not_applicable"))).drop("rank")
    reason = F.when(F.col("validation_status").isin("warn", "fail"), F.concat(F.lit("validation_"), "validation_status"))
    return out.withColumn("validation_reason", reason)
