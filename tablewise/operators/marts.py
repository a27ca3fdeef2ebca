"""Summary tables: by period, by entity and over a whole table, and which of them a table allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_of(column: Column) -> Column:
    return F.date_trunc("month", column).cast("timestamp_ntz")


def period_comparison(df: DataFrame, time: str, metrics: list[str]) -> DataFrame:
    """Monthly means and row counts beside the month before. Rows are reduced to months before the
    window, so its single partition holds one row a month."""
    months = df.where(F.col(time).isNotNull()).groupBy(month_of(F.col(time)).alias("period")).agg(*[F.avg(m).alias(f"avg_{m}") for m in metrics[:5]], F.count(F.lit(1)).alias("row_count"))
    return months.withColumn("prev_row_count", F.lag("row_count").over(Window.orderBy("period")))


def entity_summary(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, metrics: list[str], keep: list[str] | None = None) -> DataFrame:
    """Means, sums and counts of a fact for every row of a dimension that it refers to. The fact is
    reduced to its keys before it meets the dimension."""
    sums = [x for m in metrics[:3] for x in (F.sum(m).alias(f"sum_{m}"), F.count(m).alias(f"_n_{m}"))]
    by_key = fact.where(F.col(fact_key).isNotNull()).groupBy(F.col(fact_key).alias("_key")).agg(*sums, F.count(F.lit(1)).alias("row_count"))
    names = keep or dim.columns
    joined = by_key.join(dim, by_key["_key"] == dim[dim_key])
    figures = [x for m in metrics[:3] for x in ((F.sum(f"sum_{m}") / F.sum(f"_n_{m}")).alias(f"avg_{m}"), F.sum(f"sum_{m}").alias(f"sum_{m}"))]
    return joined.groupBy(*names).agg(*figures, F.sum("row_count").alias("row_count"))


def whole_summary(df: DataFrame, metrics: list[str]) -> DataFrame:
    figures = [x for m in metrics[:5] for x in (F.avg(m).alias(f"avg_{m}"), F.min(m).alias(f"min_{m}"), F.max(m).alias(f"max_{m}"))]
    return df.agg(*figures, F.count(F.lit(1)).alias("row_count"))


def archetypes(profiled: DataFrame, edges: DataFrame, least_rows: int = 100, least_edges: int = 2, least_metrics: int = 1) -> DataFrame:
    """(table, archetype): the marts that a table's columns, rows and relations support.

    ``profiled`` has table, role and row_count; ``edges`` has from_table and to_table.
    """
    shape = profiled.groupBy("table").agg(F.count_if(F.col("role") == "temporal").alias("times"), F.count_if(F.col("role") == "metric").alias("metrics"), F.max("row_count").alias("rows"))
    ends = edges.select(F.explode(F.array(F.struct(F.col("from_table").alias("table"), F.lit(1).alias("parent")), F.struct(F.col("to_table").alias("table"), F.lit(0).alias("parent")))).alias("e"))
    linked = ends.groupBy("e.table").agg(F.count(F.lit(1)).alias("edges"), F.sum("e.parent").alias("parents"))
    got = shape.join(F.broadcast(linked), "table", "left").na.fill(0, ["edges", "parents"])
    enough = F.col("rows") >= least_rows
    kinds = F.array_compact(F.array(
        F.when(F.col("times") > 0, F.lit("period_comparison")),
        F.when((F.col("metrics") > 0) & (F.col("parents") > 0) & ((F.col("edges") >= least_edges) | (F.col("metrics") >= least_metrics)) & enough, F.lit("entity_summary")),
        F.when((F.col("metrics") >= 2) & (F.col("edges") == 0) & enough, F.lit("aggregation")),
    ))
    return got.select("table", F.explode(kinds).alias("archetype"))
