"""Materialization and the catalog."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Outcome:
    name: str
    success: bool
    row_count: int
    elapsed_ms: float
    error: str | None = None


def ensure_database(spark: SparkSession, database: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def materialize(df: DataFrame, name: str) -> Outcome:
    """Write a managed table; its rows are counted on the way, without a second scan."""
    began, seen = time.monotonic(), Observation(name)
    try:
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").saveAsTable(name)
    except Exception as error:  # a failed model is a result, not an end to the run
        return Outcome(name, False, 0, (time.monotonic() - began) * 1000, str(error))
    return Outcome(name, True, seen.get["rows"], (time.monotonic() - began) * 1000)


def catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, position, dtype, nullable, row_count); all counts in one job."""
    counts = reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table"), "row_count") for n, df in tables.items()])
    spark = next(iter(tables.values())).sparkSession
    rows = [(n, f.name, i, f.dataType.simpleString(), f.nullable) for n, df in tables.items() for i, f in enumerate(df.schema)]
    columns = spark.createDataFrame(rows, "table string, column string, position int, dtype string, nullable boolean")
    return columns.join(counts, "table")
