"""Staging projections, previews and guarded SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.functions.types import normalized, numeric_columns, temporal_columns

MOST_ROWS = 500
#: Statements that change something.
_CHANGES = ("insert", "update", "delete", "drop", "create", "alter", "truncate", "merge", "grant", "revoke", "replace", "copy", "attach", "call", "set")


def snake(name: str) -> str:
    """Lower case; everything but letters and digits as single underscores; ``col`` if none is left."""
    broken = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)
    return re.sub(r"[^0-9a-z]+", "_", broken.lower()).strip("_") or "col"


def header(name: str) -> str:
    """A header cell as a column name; unlike ``snake`` it leaves camel case together."""
    return re.sub(r"[^0-9a-z]+", "_", name.lower()).strip("_") or "col"


def unique_names(names: list[str], rule=header) -> list[str]:
    """Normalized names; a name that is taken gets the first free number."""
    out: list[str] = []
    for name in map(rule, names):
        tries = [name, *(f"{name}_{i}" for i in range(1, len(out) + 1))]
        out.append(next(t for t in tries if t not in out))
    return out


def normalized_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names(df.columns))


def normalized_schema(df: DataFrame) -> DataFrame:
    """(column, position, dtype, filled): the schema under nine type names, and how many values each
    column has, by one aggregate."""
    cells = [F.struct(F.lit(f.name).alias("column"), F.lit(i).alias("position"), F.lit(normalized(f.dataType)).alias("dtype"), F.count(F.col(f.name)).alias("filled")).alias(f"c{i}") for i, f in enumerate(df.schema)]
    return df.agg(*cells).select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(cells))])).alias("r")).select("r.*")


def stage(df: DataFrame, casts: dict[str, str] | None = None) -> DataFrame:
    """Snake-case names, temporal text cast where asked for, and the time of loading."""
    casts = casts or {}
    cells = [(F.col(f"`{c}`").try_cast(casts[c]) if c in casts else F.col(f"`{c}`")).alias(n) for c, n in zip(df.columns, unique_names(df.columns, snake))]
    return df.select(*cells, F.current_timestamp().alias("_loaded_at"))


def preview(df: DataFrame, limit: int = 100) -> tuple[DataFrame, int]:
    """The first rows (1 to 500 of them), and how many there are in all."""
    return df.limit(max(1, min(limit, MOST_ROWS))), df.count()


def guarded_sql(spark: SparkSession, sql: str, limit: int = MOST_ROWS) -> DataFrame:
    """A read-only query, cut at ``limit`` rows before anything is collected."""
    bare = re.sub(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S).strip().rstrip(";").lower()
    if not re.match(r"(select|with)\b", bare) or ";" in bare or any(re.search(rf"\b{w}\b\s+(?!\()", bare) for w in _CHANGES):
        raise ValueError("only a single SELECT or WITH statement is allowed")
    return spark.sql(sql.strip().rstrip(";")).limit(max(1, min(limit, MOST_ROWS)))


def null_rows(df: DataFrame, column: str, limit: int = 20) -> DataFrame:
    return df.where(F.col(column).isNull()).limit(limit)


def matching(df: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Rows whose columns equal all of the values; values are bound, never spliced into SQL."""
    condition: Column = F.lit(True)
    for c, v in filters.items():
        condition = condition & (F.col(c) == F.lit(v))
    return df.where(condition)


def filled_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(a, b).dropna()


def time_columns(df: DataFrame) -> list[str]:
    return temporal_columns(df.schema)


def metric_columns(df: DataFrame, least: int = 10) -> list[str]:
    """Numeric columns that are no ids, have enough values and vary; one aggregate for all."""
    names = [c for c in numeric_columns(df.schema) if c != "id" and not c.endswith("_id")]
    if not names:
        return []
    got = df.agg(*[F.struct(F.count(c).alias("n"), F.stddev_samp(c).alias("s")).alias(c) for c in names]).first()
    return [c for c in names if got[c]["n"] >= least and (got[c]["s"] or 0) > 0]
