"""Order without one task for a whole series: positions, running sums and neighbours in a table that is
divided by ranges of its order.

``placed`` deals rows into ranges and writes each with the number of its range. Figures of a range are
one row a group and range; what stands before a range is a running sum over these few rows, and
windows over rows never cross a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.sources.paths import stored


def placed(df: DataFrame, group: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with ``part``: ranges of (group, order) are numbered upwards, and rows that agree in both
    share one."""
    parts = parts or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return stored(df.repartitionByRange(parts, *group, *order).withColumn("part", F.spark_partition_id()))


def running(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``placed`` rows with inclusive running sums within their group: name -> what is summed."""
    names = list(sums)
    own = rows.groupBy(*group, "part").agg(*[F.sum(c).alias(f"own_{n}") for n, c in sums.items()])
    upto = Window.partitionBy(*group).orderBy("part")
    before = own.select(*group, "part", *[(F.sum(f"own_{n}").over(upto) - F.col(f"own_{n}")).alias(f"before_{n}") for n in names])
    here = Window.partitionBy(*group, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(before, [*group, "part"])
    return joined.withColumns({n: F.col(f"before_{n}") + F.sum(c).over(here) for n, c in sums.items()}).drop(*[f"before_{n}" for n in names])


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """``df`` with each row's place within its group, from 1."""
    return running(placed(df, group, order, parts), group, order, {name: F.lit(1)}).drop("part")


def with_prior(rows: DataFrame, group: list[str], order: str, value: str, name: str) -> DataFrame:
    """``placed`` rows with the value of the row before within their group, null for the first."""
    ends = rows.groupBy(*group, "part").agg(F.max_by(F.struct(value), order).alias("end"))
    prior = ends.select(*group, "part", F.lag("end").over(Window.partitionBy(*group).orderBy("part")).alias("end_before"))
    here = Window.partitionBy(*group, "part").orderBy(order)
    is_first = F.row_number().over(here) == 1
    joined = rows.join(prior, [*group, "part"], "left")
    return joined.withColumn(name, F.when(is_first, F.col("end_before")[value]).otherwise(F.lag(value).over(here))).drop("end_before")
