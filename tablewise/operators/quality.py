"""Quality contracts: rules made from a profile, and checks fused into one pass over a table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.operators.profile import frequencies

ACTIVE = ("observing", "enforced")
FEW_VALUES = 30


@dataclass(frozen=True)
class Rule:
    """One contract. ``kind`` is not_null, unique, range, cardinality, row_count or custom.

    ``expression`` is a predicate that good rows meet; for row_count, ``low`` and ``high`` bound the
    number of rows, both inclusive, either may be missing."""

    name: str
    kind: str
    column: str | None = None
    expression: str | None = None
    low: int | None = None
    high: int | None = None
    severity: str = "error"
    status: str = "observing"


@dataclass(frozen=True)
class Reference:
    """A key that must exist in another table."""

    name: str
    column: str
    to_table: str
    to_column: str


def _violations(rule: Rule) -> Column:
    """Rows against a rule; a predicate that is null is not a violation."""
    if rule.kind == "not_null":
        return F.count_if(F.col(rule.column).isNull())
    if rule.kind in ("range", "custom"):
        return F.count_if(~F.expr(rule.expression))
    if rule.kind == "cardinality":
        return F.count_if(F.col(rule.column).isNotNull() & ~F.expr(rule.expression))
    if rule.kind == "row_count":
        return F.count(F.lit(1))
    raise ValueError(f"unknown kind of rule: {rule.kind}")


def _resolves(df: DataFrame, rule: Rule) -> str | None:
    """What is wrong with a rule, read from the analyzed plan; no job runs."""
    try:
        df.select(F.col(rule.column)) if rule.kind == "unique" else df.agg(_violations(rule))
    except Exception as error:
        return str(error).splitlines()[0]
    return None


def _passed(rule: Rule, observed: Column) -> Column:
    if rule.kind != "row_count":
        return observed == 0
    low = F.lit(True) if rule.low is None else observed >= rule.low
    high = F.lit(True) if rule.high is None else observed <= rule.high
    return low & high


def repeats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, observed): rows less distinct values, so that nulls count as repeats. Each column is
    grouped by itself, in its own type, and long texts by their digest."""
    freq = frequencies(df, columns)
    return freq.groupBy("column").agg((F.sum("n") - F.count("value")).alias("observed"))


def check(df: DataFrame, rules: list[Rule], only_active: bool = True) -> DataFrame:
    """(rule, kind, column, severity, observed, passed, error) for a table's rules.

    All row rules are one aggregate; uniqueness is one more. A rule that does not fit the table is a
    failed result of its own."""
    wanted = [r for r in rules if not only_active or r.status in ACTIVE]
    spark = df.sparkSession
    broken = {r.name: e for r in wanted if (e := _resolves(df, r))}
    plain = [r for r in wanted if r.kind != "unique" and r.name not in broken]
    unique = [r for r in wanted if r.kind == "unique" and r.name not in broken]
    schema = "rule string, kind string, column string, severity string, observed bigint, passed boolean, error string"
    parts = [spark.createDataFrame([(r.name, r.kind, r.column, r.severity, None, False, broken[r.name]) for r in wanted if r.name in broken], schema)]

    def result(r: Rule, observed: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.column).cast("string").alias("column"), F.lit(r.severity).alias("severity"), observed.cast("bigint").alias("observed"), _passed(r, observed).alias("passed"), none.alias("error"))

    if plain:
        wide = df.agg(*[_violations(r).alias(f"r{i}") for i, r in enumerate(plain)])
        parts.append(wide.select(F.explode(F.array(*[result(r, F.col(f"r{i}")) for i, r in enumerate(plain)])).alias("x")).select("x.*"))
    if unique:
        found = repeats(df, sorted({r.column for r in unique}))
        rows = F.filter(F.array(*[result(r, F.col("observed")) for r in unique]), lambda x: x["column"] == F.col("column"))
        empty = df.limit(1).count() == 0
        parts.append(spark.createDataFrame([(r.name, r.kind, r.column, r.severity, 0, True, None) for r in unique], schema) if empty else found.select(F.explode(rows).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, parts)


def check_tables(tables: dict[str, DataFrame], rules: dict[str, list[Rule]], only_active: bool = True) -> DataFrame:
    """Results of all tables; the rules of a table that is missing all fail."""
    spark = next(iter(tables.values())).sparkSession
    schema = "rule string, kind string, column string, severity string, observed bigint, passed boolean, error string"
    parts = []
    for name, own in rules.items():
        if name in tables:
            got = check(tables[name], own, only_active)
        else:
            got = spark.createDataFrame([(r.name, r.kind, r.column, r.severity, None, False, f"no table {name}") for r in own if not only_active or r.status in ACTIVE], schema)
        parts.append(got.withColumn("table", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def check_reference(df: DataFrame, target: DataFrame, rule: Reference) -> DataFrame:
    """Rows whose key is not in the target: counted per key first, then an anti-join of keys."""
    keys = df.where(F.col(rule.column).isNotNull()).groupBy(F.col(rule.column).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    known = target.select(F.col(rule.to_column).alias("key")).distinct()
    lost = keys.join(known, "key", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("observed"), F.count(F.lit(1)).alias("orphan_values"))
    return lost.select(F.lit(rule.name).alias("rule"), "observed", "orphan_values", (F.col("observed") == 0).alias("passed"))


def report(results: DataFrame) -> DataFrame:
    """Totals and the share of rules that pass, in percent to one digit."""
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("passed")).alias("passed"), F.count_if(~F.col("passed") & F.col("error").isNull()).alias("failed"), F.count_if(F.col("error").isNotNull()).alias("skipped"), F.round(F.try_divide(F.count_if(F.col("passed")) * 100.0, F.count(F.lit(1))), 1).alias("pass_rate"))


def generate(profiled: DataFrame, tops: DataFrame) -> DataFrame:
    """(column, rule_type, expression, severity, confidence, status): contracts that the profile bears out.

    ``profiled`` has column, dtype, null_count, distinct_count, uniqueness_ratio and, for numbers,
    min_value and max_value; ``tops`` has the frequent values. Ranges get half their span as headroom;
    a floor that is negative is widened to one and a half times itself, one that is not stays at 0 or above.
    A column with nulls gets no uniqueness rule, since that rule counts nulls as repeats."""
    c, low, high = F.col("column"), F.col("min_value"), F.col("max_value")
    room = F.abs(high - low) * 0.5
    floor = F.when(low >= 0, F.greatest(F.lit(0.0), low - room)).otherwise(low * 1.5)
    tick = F.concat(F.lit("`"), c, F.lit("`"))
    values = tops.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("v"))
    listed = F.array_join(F.transform("v", lambda x: F.concat(F.lit("'"), F.replace(x["value"], F.lit("'"), F.lit("''")), F.lit("'"))), ", ")
    known = profiled.join(F.broadcast(values.select("column", listed.alias("listed"))), "column", "left")
    status = F.lit("proposed").alias("status")

    def rule(kind: str, text: Column, severity: str, sure: float) -> Column:
        return F.struct(F.lit(kind).alias("rule_type"), text.alias("expression"), F.lit(severity).alias("severity"), F.lit(sure).alias("confidence"), status)

    cents = lambda x: F.round(x, 2).cast("decimal(38,2)").cast("string")
    made = F.array_compact(F.array(
        F.when((F.col("null_count") == 0) & (F.col("distinct_count") > 0), rule("not_null", F.concat(tick, F.lit(" IS NOT NULL")), "error", 0.95)),
        F.when((F.col("uniqueness_ratio") == 1) & (F.col("null_count") == 0) & (F.col("distinct_count") > 1), rule("unique", tick, "error", 0.9)),
        F.when(low.isNotNull() & high.isNotNull(), rule("range", F.concat(tick, F.lit(" BETWEEN "), cents(floor), F.lit(" AND "), cents(high + room)), "warning", 0.8)),
        F.when(F.col("listed").isNotNull() & (F.col("distinct_count") <= FEW_VALUES) & (F.col("dtype") == "varchar"), rule("cardinality", F.concat(tick, F.lit(" IN ("), F.col("listed"), F.lit(")")), "warning", 0.75)),
    ))
    return known.select("column", F.explode(made).alias("r")).select("column", "r.*")


def as_rules(generated: DataFrame, status: str = "observing") -> list[Rule]:
    """Generated contracts as rules; their number is that of columns, not of rows."""
    return [Rule(f"{r.column}:{r.rule_type}", r.rule_type, r.column, None if r.rule_type in ("not_null", "unique") else r.expression, severity=r.severity, status=status) for r in generated.collect()]
