"""Rollups over profiles, edges, check results and decision logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _percent(part: Column, whole: Column) -> Column:
    return F.round(F.least(F.lit(100.0), F.try_divide(part * 100.0, whole)), 1)


def overview(profiled: DataFrame) -> DataFrame:
    """Tables, columns, rows, cells and how complete they are; rows count once a table."""
    by_table = profiled.groupBy("table").agg(F.count(F.lit(1)).alias("c"), F.max("row_count").alias("r"), F.sum("row_count").alias("cells"), F.sum("null_count").alias("nulls"))
    return by_table.agg(F.count(F.lit(1)).alias("tables"), F.sum("c").alias("columns"), F.sum("r").alias("rows"), F.sum("cells").alias("cells"), _percent(F.sum("cells") - F.sum("nulls"), F.sum("cells")).alias("completeness"))


def table_health(profiled: DataFrame, edges: DataFrame) -> DataFrame:
    """Per table: mean null rate, completeness, columns that could be keys, references to other
    tables, whether it is related. The lists are as long as the table has columns."""
    key = (F.col("null_count") == 0) & (F.col("distinct_count") == F.col("row_count")) & (F.col("row_count") > 0)
    names = F.array_join(F.array_sort(F.collect_list(F.when(key, F.col("column")))), ",").alias("keys")
    got = profiled.groupBy("table").agg(F.count(F.lit(1)).alias("columns"), F.max("row_count").alias("rows"), F.round(F.avg("null_rate"), 4).alias("mean_null_rate"), _percent(F.sum("row_count") - F.sum("null_count"), F.sum("row_count")).alias("completeness"), F.count_if(key).alias("key_columns"), names)
    ends = F.explode(F.array(F.struct(F.col("from_table").alias("table"), F.concat_ws(".", F.concat("from_column", F.lit(">"), "to_table"), "to_column").alias("ref")), F.struct(F.col("to_table").alias("table"), F.lit(None).cast("string").alias("ref")))).alias("e")
    # One row a table, as many as there are edges at most.
    linked = edges.select(ends).groupBy("e.table").agg(F.array_join(F.array_sort(F.collect_set("e.ref")), ",").alias("references"))
    return got.join(F.broadcast(linked), "table", "left").withColumn("has_relationships", F.col("references").isNotNull()).withColumn("references", F.coalesce("references", F.lit("")))


def column_issues(profiled: DataFrame) -> DataFrame:
    """(table, column, issue, severity): sparse, empty and constant columns, and columns that are
    unexpectedly unique: no repeats, though their name is not an id's.

    Nested columns have no distinct count and are not judged by it."""
    filled = F.col("row_count") - F.col("null_count")
    issue = lambda when, name, level: F.when(when, F.struct(F.lit(name).alias("issue"), level.alias("severity")))
    found = F.array_compact(F.array(
        issue((F.col("null_rate") > 0.05) & (filled > 0), "high_nulls", F.when(F.col("null_rate") > 0.2, F.lit("error")).otherwise(F.lit("warning"))),
        issue((F.col("row_count") > 0) & (filled == 0), "empty_column", F.lit("error")),
        issue((F.col("uniqueness_ratio") == 1) & (F.col("distinct_count") > 1) & ~F.col("column").endswith("_id"), "unexpected_uniqueness", F.lit("info")),
        issue((F.col("distinct_count") == 1) & (F.col("null_rate") == 0), "constant_column", F.lit("warning")),
    ))
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return profiled.select("table", "column", F.explode(found).alias("f")).select("table", "column", "f.*").orderBy(rank, "table", "column", "issue")


def null_ranking(profiled: DataFrame) -> DataFrame:
    return profiled.where("null_rate > 0").select("table", "column", "null_rate").orderBy(F.col("null_rate").desc(), "table", "column")


def unique_columns(profiled: DataFrame) -> DataFrame:
    return profiled.where("uniqueness_ratio = 1 and distinct_count > 1").select("table", "column", "distinct_count").orderBy("table", "column")


def pattern_listing(profiled: DataFrame) -> DataFrame:
    return profiled.where("detected_pattern is not null").select("table", "column", "detected_pattern").orderBy("table", "column")


def domain_rollup(tables: DataFrame) -> DataFrame:
    """(domain, tables, rows) from rows of (table, domain, row_count)."""
    return tables.groupBy("domain").agg(F.count(F.lit(1)).alias("tables"), F.sum("row_count").alias("rows"))


def data_profile(profiled: DataFrame, edges: DataFrame, results: DataFrame) -> DataFrame:
    """Key coverage, mean integrity, pass rate, sparse and constant columns, as one row."""
    key = (F.col("null_count") == 0) & (F.col("distinct_count") == F.col("row_count")) & (F.col("row_count") > 0)
    by_table = profiled.groupBy("table").agg(F.max(key).alias("has_key"), F.count_if(F.col("null_rate") > 0.05).alias("sparse"), F.count_if(F.col("distinct_count") == 1).alias("constant"))
    one = by_table.agg(_percent(F.count_if("has_key"), F.count(F.lit(1))).alias("key_coverage"), F.sum("sparse").alias("high_null_columns"), F.sum("constant").alias("constant_columns"))
    two = edges.agg(F.round(F.avg("ref_integrity") * 100, 1).alias("mean_integrity"))
    three = results.agg(_percent(F.count_if("passed"), F.count(F.lit(1))).alias("pass_rate"))
    tag = lambda df: df.withColumn("_one", F.lit(1))
    return tag(one).join(tag(two), "_one").join(tag(three), "_one").drop("_one")


def findings(profiled: DataFrame, edges: DataFrame, results: DataFrame) -> DataFrame:
    """(priority, kind, table, column): what to look at, most pressing first."""
    health = table_health(profiled, edges)
    text = lambda v: F.lit(v).cast("string")
    row = lambda df, rank, kind, table, column: df.select(F.lit(rank).alias("priority"), F.lit(kind).alias("kind"), table.alias("table"), column.alias("column"))
    t, c = F.col("table"), F.col("column")
    parts = [
        row(results.where("not passed"), 1, "failed_contract", t, c),
        row(edges.where("ref_integrity < 0.95"), 2, "weak_reference", F.col("from_table"), F.col("from_column")),
        row(health.where("key_columns = 0"), 3, "no_key", t, text(None)),
        row(profiled.where("null_rate > 0.05"), 4, "high_nulls", t, c),
        row(health.where("not has_relationships"), 5, "isolated_table", t, text(None)),
        row(health.where("mean_null_rate = 0"), 6, "complete_table", t, text(None)),
    ]
    return reduce(DataFrame.unionByName, parts).orderBy("priority", "table", "column")


def dedup_suggestions(profiled: DataFrame, edges: DataFrame, ids: str = "(?i)(_id|key)$") -> DataFrame:
    """(kind, table, column, figure): id columns that repeat, and references that are not whole."""
    repeated = profiled.where(F.col("column").rlike(ids) & (F.col("uniqueness_ratio") > 0) & (F.col("uniqueness_ratio") < 1)).select(F.lit("repeated_id").alias("kind"), "table", "column", F.col("uniqueness_ratio").alias("figure"))
    weak = edges.where("ref_integrity < 0.95").select(F.lit("weak_reference").alias("kind"), F.col("from_table").alias("table"), F.col("from_column").alias("column"), F.col("ref_integrity").alias("figure"))
    return repeated.unionByName(weak)


#: Actions of a decision log that count as decided.
DESCRIPTION_ACTIONS = ("locked", "description_accepted", "description_edited")
CONTRACT_ACTIONS = ("false_positive", "true_positive", "acknowledged")


def acceptance_rate(decisions: DataFrame, source: str | None = None, least: int = 5) -> DataFrame:
    """(accepted, decided, rate): column descriptions kept as they were; null for fewer than five.

    ``decisions`` has artifact_type, artifact_id (``source.table.column``), action and payload."""
    rows = decisions.where((F.col("artifact_type") == "column") & F.col("action").isin(*DESCRIPTION_ACTIONS))
    if source is not None:
        rows = rows.where(F.col("artifact_id").startswith(f"{source}."))
    got = rows.agg(F.count_if(F.col("action") == "description_accepted").alias("accepted"), F.count(F.lit(1)).alias("decided"))
    return got.withColumn("rate", F.when(F.col("decided") >= least, F.round(F.try_divide("accepted", "decided"), 4)))


def mean_edit_distance(decisions: DataFrame, source: str | None = None, field: str = "edit_distance") -> DataFrame:
    """(mean_distance, n) over edited models whose payload has a distance."""
    rows = decisions.where((F.col("artifact_type") == "model") & (F.col("action") == "edited"))
    if source is not None:
        rows = rows.where(F.col("artifact_id").startswith(source))
    value = F.get_json_object("payload", f"$.{field}").try_cast("double")
    return rows.agg(F.round(F.avg(value), 4).alias("mean_distance"), F.count(value).alias("n"))


def contract_precision(decisions: DataFrame, contracts: DataFrame | None = None, source: str | None = None) -> DataFrame:
    """(false_positives, decided, precision) of contract alerts; with ``source``, of the ``contracts``
    (id, model_name) whose model's name holds it."""
    rows = decisions.where((F.col("artifact_type") == "contract") & F.col("action").isin(*CONTRACT_ACTIONS))
    if source is not None:
        rows = rows.join(contracts.where(F.contains("model_name", F.lit(source))).select(F.col("id").alias("artifact_id")), "artifact_id", "left_semi")
    got = rows.agg(F.count_if(F.col("action") == "false_positive").alias("false_positives"), F.count(F.lit(1)).alias("decided"))
    return got.withColumn("precision", F.round(1 - F.try_divide("false_positives", "decided"), 4))


def review_progress(items: DataFrame, done: str = "reviewed") -> DataFrame:
    """(status, n, percent): how many items have each status, and their share."""
    counts = items.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    whole = items.agg(F.count(F.lit(1)).alias("total"))
    return counts.join(F.broadcast(whole)).select("status", "n", _percent(F.col("n"), F.col("total")).alias("percent"))
