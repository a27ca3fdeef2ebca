"""Foreign keys measured on the data, and joins along them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Candidate:
    from_table: str
    from_column: str
    to_table: str
    to_column: str

    @property
    def name(self) -> str:
        return f"{self.from_table}.{self.from_column}->{self.to_table}.{self.to_column}"


def stem(column: str, prefixed: bool = False) -> str:
    """A key column's entity: without a table prefix (``o_custkey``) and without its suffix."""
    name = column.lower()
    if prefixed:
        name = name.split("_", 1)[-1]
    for suffix in ("_id", "_key", "key"):
        if name.endswith(suffix) and name != suffix:
            return name[: -len(suffix)]
    return ""


def candidates(columns: dict[str, list[str]], keys: dict[str, str], prefixed: bool = False) -> list[Candidate]:
    """Columns that may refer to another table's key: same name, or a name for its table.

    ``prefixed`` compares names without their table prefix, as in ``l_orderkey``.
    """
    plain = lambda c: c.lower().split("_", 1)[-1] if prefixed else c.lower()
    found = []
    for table, names in columns.items():
        for column in names:
            if keys.get(table) == column:
                continue
            entity = stem(column, prefixed)
            for target, key in keys.items():
                names_table = bool(entity) and target in (entity, entity + "s", entity + "es")
                if target != table and (plain(column) == plain(key) or names_table):
                    found.append(Candidate(table, column, target, key))
    return sorted(found, key=lambda c: c.name)


def integrity(tables: dict[str, DataFrame], found: list[Candidate]) -> DataFrame:
    """Per candidate: distinct values, those that exist, share, and the edge's cardinality.

    All candidates are one job: the values of each are counted by key and side, in their own type if both
    columns have the same, and then compared, so a key is one row and no raw rows meet.
    """
    parts = []
    for c in found:
        own, key = tables[c.from_table], tables[c.to_table]
        kinds = [df.schema[name].dataType.simpleString() for df, name in ((own, c.from_column), (key, c.to_column))]
        kind = kinds[0] if kinds[0] == kinds[1] and kinds[0] in ("tinyint", "smallint", "int", "bigint", "string", "date") else "string"
        side = lambda df, name, uses: df.select(F.col(name).cast(kind).alias("value"), F.lit(uses).alias("uses"), F.lit(1 - uses).alias("is_key"))  # noqa: E731, B023
        values = side(own, c.from_column, 1).unionByName(side(key, c.to_column, 0)).where("value is not null").groupBy("value").agg(F.sum("uses").alias("uses"), F.max("is_key").alias("is_key")).where("uses > 0")
        parts.append(values.agg(F.sum("uses").alias("n_values"), F.count(F.lit(1)).alias("n_distinct"), F.sum("is_key").cast("bigint").alias("n_matched")).select(F.lit(c.name).alias("edge"), "*"))
    got = reduce(DataFrame.unionByName, parts)
    spark = next(iter(tables.values())).sparkSession
    ends = spark.createDataFrame([(c.name, c.from_table, c.from_column, c.to_table, c.to_column) for c in found], "edge string, from_table string, from_column string, to_table string, to_column string")
    share = F.coalesce(F.try_divide("n_matched", "n_distinct"), F.lit(0.0))
    kind = F.when(F.col("n_values") == F.col("n_distinct"), F.lit("one_to_one")).otherwise(F.lit("many_to_one"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_values", "n_distinct", "n_matched")}
    return F.broadcast(ends).join(got, "edge", "left").withColumns(zero).withColumn("ref_integrity", share).withColumn("rel_type", kind)


def edges(measured: DataFrame, least: float = 0.5) -> DataFrame:
    """Candidates that hold well enough, with a confidence and where it comes from."""
    share = F.col("ref_integrity")
    return measured.where(share >= least).withColumn("confidence", F.when(share > 0.9, 0.9).otherwise(0.7)).withColumn("source", F.when(share == 1, F.lit("inferred_value")).otherwise(F.lit("inferred_name")))


def detect(tables: dict[str, DataFrame], keys: dict[str, str], prefixed: bool = False, least: float = 0.5) -> DataFrame:
    return edges(integrity(tables, candidates({t: df.columns for t, df in tables.items()}, keys, prefixed)), least)


@dataclass(frozen=True)
class Edge:
    from_table: str
    from_column: str
    to_table: str
    to_column: str
    ref_integrity: float = 1.0


def join_edge(left: DataFrame, right: DataFrame, edge: Edge, forward: bool = True) -> DataFrame:
    """Join along an edge: inner, or left where the key is so often unmatched that rows would go."""
    own, other = (edge.from_column, edge.to_column) if forward else (edge.to_column, edge.from_column)
    return left.join(right, left[own] == right[other], "inner" if edge.ref_integrity >= 0.5 else "left")


def find_path(edges_: list[Edge], start: str, goal: str, hops: int = 3) -> list[tuple[Edge, bool]]:
    """The shortest way between two tables over edges in either direction; raises without one."""
    ways: dict[str, list[tuple[Edge, bool]]] = {start: []}
    for _ in range(hops):
        reached = {}
        for e in edges_:
            for near, far, forward in ((e.from_table, e.to_table, True), (e.to_table, e.from_table, False)):
                if near in ways and far not in ways and far not in reached:
                    reached[far] = [*ways[near], (e, forward)]
        ways |= reached
        if goal in ways:
            return ways[goal]
    if goal in ways:
        return ways[goal]
    raise ValueError(f"no join path of at most {hops} steps from {start} to {goal}")


def join_path(tables: dict[str, DataFrame], edges_: list[Edge], start: str, goal: str, hops: int = 3) -> DataFrame:
    """``start`` joined to every table on the shortest way to ``goal``."""
    out, at = tables[start], start
    for edge, forward in find_path(edges_, start, goal, hops):
        at = edge.to_table if forward else edge.from_table
        out = join_edge(out, tables[at], edge, forward)
    return out
