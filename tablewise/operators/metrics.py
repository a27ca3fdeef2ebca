"""Metric-by-dimension queries: what a question about a table comes down to."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.operators.staging import matching

_AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.count_distinct}
#: How columns are added up, by the beginning, the end or the whole of their name, tried from
#: top to bottom.
BY_NAME = (
    ("count", {"begins": ["num_"], "ends": ["_count"], "whole": ["count", "total"]}),
    ("sum", {"begins": ["sum_"], "ends": ["_sum"]}),
    ("avg", {"begins": ["avg_", "mean_"], "ends": ["_avg", "_average"]}),
    ("avg", {"begins": ["pct_"], "ends": ["_rate", "_ratio", "_pct"]}),
    ("avg", {"ends": ["score"]}),
    ("sum", {"ends": ["_amount", "_value", "_cost", "_price", "_budget"]}),
    ("min", {"ends": ["_min"]}),
    ("max", {"ends": ["_max"]}),
)


def aggregate_for(column: str) -> str:
    """The aggregate that a metric column's name asks for; the mean if it doesn't say."""
    name = column.lower()
    for kind, words in BY_NAME:
        if name.startswith(tuple(words.get("begins", ()))) or name.endswith(tuple(words.get("ends", ()))) or name in words.get("whole", ()):
            return kind
    return "avg"


@dataclass(frozen=True)
class Metric:
    """A named aggregate of a column, or a free aggregate expression such as a ratio of counts."""

    name: str
    column: str = "*"
    kind: str = "count"
    expression: str | None = None

    def compiled(self) -> Column:
        if self.expression:
            return F.expr(self.expression).alias(self.name)
        return (F.count(F.lit(1)) if self.column == "*" else _AGGREGATES[self.kind](self.column)).alias(self.name)


def metric_by(df: DataFrame, metrics: Sequence[Metric], dimensions: Sequence[str] = (), filters: dict[str, object] | None = None, top: int | None = None) -> DataFrame:
    """Metrics by dimensions, largest last metric first; ties go by the dimensions."""
    rows = matching(df, filters or {}).groupBy(*dimensions).agg(*[m.compiled() for m in metrics])
    rows = rows.orderBy(F.col(metrics[-1].name).desc_nulls_last(), *dimensions)
    return rows if top is None else rows.limit(top)


def ratio(name: str, numerator: str, denominator: str) -> Metric:
    return Metric(name, expression=f"try_divide({numerator} * 1.0D, {denominator})")


def breakdown(df: DataFrame, dimension: str, metric: str, top: int | None = None) -> DataFrame:
    """Mean (two digits) and rows by dimension, largest mean first."""
    rows = df.groupBy(dimension).agg(F.round(F.avg(metric), 2).alias(f"avg_{metric}"), F.count(F.lit(1)).alias("row_count"))
    rows = rows.orderBy(F.col(f"avg_{metric}").desc_nulls_last(), dimension)
    return rows if top is None else rows.limit(top)


def top_n(df: DataFrame, dimension: str, metric: str, n: int = 15) -> DataFrame:
    return breakdown(df, dimension, metric, n)


def period_of(df: DataFrame, time: str) -> Column:
    """Months for timestamps, days for dates, the value itself otherwise."""
    kind = df.schema[time].dataType.simpleString()
    if kind.startswith("timestamp"):
        return F.date_trunc("month", time).cast("timestamp_ntz")
    return F.col(time)


def trend(df: DataFrame, time: str, metric: str, dimension: str | None = None, period: Column | None = None) -> DataFrame:
    keys = [(period_of(df, time) if period is None else period).alias("period"), *([F.col(dimension)] if dimension else [])]
    return df.groupBy(*keys).agg(F.avg(metric).alias(f"avg_{metric}"), F.count(F.lit(1)).alias("row_count")).orderBy("period", *([dimension] if dimension else []))


def time_series(df: DataFrame, time: Column, metric: str, limit: int = 100) -> DataFrame:
    return trend(df, "", metric, period=time).limit(limit)


def count_by(df: DataFrame, dimension: str | None = None) -> DataFrame:
    return df.groupBy(*([dimension] if dimension else [])).agg(F.count(F.lit(1)).alias("row_count"))


def distribution(df: DataFrame, metric: str) -> DataFrame:
    return df.agg(F.min(metric).alias("min_value"), F.max(metric).alias("max_value"), F.round(F.avg(metric), 2).alias("avg_value"), F.count(metric).alias("value_count"))


def extremes(df: DataFrame, dimension: str, metric: str, top: int = 20) -> DataFrame:
    rows = df.groupBy(dimension).agg(F.count(F.lit(1)).alias("row_count"), F.round(F.avg(metric), 2).alias("avg_value"), F.max(metric).alias("max_value"))
    return rows.orderBy(F.col("max_value").desc_nulls_last(), dimension).limit(top)


def children_per_parent(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, metric: str, keep: Sequence[str] = (), top: int = 20) -> DataFrame:
    """Children and their mean by parent. Children are reduced to keys before parents are met."""
    by_key = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("_key")).agg(F.count(F.lit(1)).alias("children"), F.avg(metric).alias("avg_value"))
    rows = by_key.join(parent, by_key["_key"] == parent[parent_key]).select(parent_key, *keep, "children", "avg_value")
    return rows.orderBy(F.col("children").desc(), parent_key).limit(top)


def join_breakdown(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, dimension: str, metric: str, top: int = 20) -> DataFrame:
    """A parent's dimension over its children: their number and mean, largest number first."""
    by_key = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("_key")).agg(F.count(F.lit(1)).alias("n"), F.sum(metric).alias("s"), F.count(metric).alias("k"))
    rows = by_key.join(parent, by_key["_key"] == parent[parent_key]).groupBy(dimension).agg(F.sum("n").alias("row_count"), (F.sum("s") / F.sum("k")).alias("avg_value"))
    return rows.orderBy(F.col("row_count").desc(), dimension).limit(top)


def duplicates(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.col("n").desc(), column).limit(top)


def value_frequencies(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column)
