"""Column profiles, and what names and profiles say about a column.

Counts, ranges, lengths, moments and patterns are one map-side aggregate of a table. Distinct values
come from ``frequencies``, which groups each column by itself, in its own type and reading nothing
else; long texts are grouped by a digest. Nested columns only have their nulls counted.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions.types import columns_of, normalized, numeric_columns, temporal_columns
from tablewise.sources.paths import stored

TOP_VALUES, TOP_DISTINCT, PATTERN_SHARE = 30, 100, 0.7
#: Characters beyond which a text is grouped, and shown, by its digest.
LONG_TEXT = 200
#: Patterns in the order in which they are tried.
PATTERNS = (
    ("email", r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z]{2,}$"),
    ("uuid", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
    ("phone", r"^\+?[\d\s\-().]{7,20}$"),
    ("iso_date", r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2})?"),
    ("url", r"(?i)^https?://"),
    ("hex_id", r"(?i)^[0-9a-f]{8,}$"),
)


def _clean(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.simpleString()
    return F.nanvl(F.col(name), F.lit(None).cast(kind)) if kind in ("float", "double") else F.col(name)


def _key(df: DataFrame, name: str) -> Column:
    """What a column is grouped by: its own value, or a long text's digest."""
    if normalized(df.schema[name].dataType) != "varchar":
        return _clean(df, name)
    text = F.col(name).cast("string")
    return F.when(F.char_length(text) <= LONG_TEXT, text).otherwise(F.concat(F.lit("md5:"), F.md5(text)))


def flat_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if normalized(f.dataType) not in ("json", "list")]


def frequencies(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, n): how often each value occurs; NaN counts as null, and a text of more than
    ``LONG_TEXT`` characters is given as ``md5:`` and its digest.

    Each column is an aggregate of its own that scans only this column, keeps its type and combines
    within tasks; only distinct values become text."""
    parts = [df.select(_key(df, c).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("column"), F.col("v").cast("string").alias("value"), "n") for c in columns or flat_columns(df)]
    return reduce(DataFrame.unionByName, parts)


def _rows(df: DataFrame, figures: dict[str, dict[str, Column]]) -> DataFrame:
    """One aggregate over the table, turned into a row per column; figures: column -> name -> aggregate."""
    cells = [F.struct(F.lit(c).alias("column"), *[v.alias(n) for n, v in own.items()]).alias(f"c{i}") for i, (c, own) in enumerate(figures.items())]
    return df.agg(*cells).select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(cells))])).alias("r")).select("r.*")


def universal(freq: DataFrame) -> DataFrame:
    """Rows, nulls, distinct values and their shares for each column."""
    got = freq.groupBy("column").agg(F.sum("n").alias("row_count"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"), F.count("value").alias("distinct_count"))
    filled = F.col("row_count") - F.col("null_count")
    return got.withColumn("null_rate", F.round(F.try_divide("null_count", "row_count"), 4)).withColumn("uniqueness_ratio", F.coalesce(F.round(F.try_divide("distinct_count", filled), 4), F.lit(0.0)))


CUTS = (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95))
#: Distinct values (about) beyond which a column's percentiles are found by rank.
IN_TASK_VALUES = 200_000


def percentiles_by_rank(values: DataFrame, cuts=CUTS, parts: int | None = None) -> DataFrame:
    """(column, *cuts): exact linear percentiles of (column, v, n), whatever the number of values.

    Values are range-partitioned and written with their partition; counts per partition, a small
    table, say where each rank falls, and only those partitions are put in order."""
    spark = values.sparkSession
    parts = parts or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = stored(values.repartitionByRange(parts, "column", "v").withColumn("part", F.spark_partition_id()))
    sums = placed.groupBy("column", "part").agg(F.sum("n").alias("size"))
    before = F.sum("size").over(Window.partitionBy("column").orderBy("part")) - F.col("size")
    sums = sums.withColumns({"before": before, "total": F.sum("size").over(Window.partitionBy("column"))})
    at = [(F.lit(name), F.lit(p) * (F.col("total") - 1)) for name, p in cuts]
    ranks = F.explode(F.array(*[F.struct(n.alias("cut"), r.alias("h"), side.alias("rank")) for n, r in at for side in (F.floor(r), F.ceil(r))])).alias("r")
    wanted = sums.select("column", "part", "before", "size", ranks).select("column", "part", "before", "size", "r.*").where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("size"))).distinct()
    held = placed.join(F.broadcast(wanted.select("column", "part", "before").distinct()), ["column", "part"])
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("column", "part").orderBy("v"))
    held = held.withColumn("upto", upto).select("column", "v", "upto", (F.col("upto") - F.col("n")).alias("since"))
    hit = held.join(F.broadcast(wanted.select("column", "cut", "h", "rank")), "column").where((F.col("rank") >= F.col("since")) & (F.col("rank") < F.col("upto")))
    value = F.min("v") + (F.max("h") - F.floor(F.max("h"))) * (F.max("v") - F.min("v"))
    found = hit.groupBy("column", "cut").agg(value.alias("value"))
    return found.groupBy("column").agg(*[F.max(F.when(F.col("cut") == n, F.col("value"))).alias(n) for n, _ in cuts])


def numeric(df: DataFrame, columns: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Range, mean, spread and exact linear percentiles of numeric columns; NaN counts as null.

    A first aggregate gives all but the percentiles, and an estimate of each column's distinct
    values. Columns with up to ``most`` of them have their percentiles in a second aggregate, whose
    state is the distinct values; all others by rank, whatever the number of values."""
    names = columns or numeric_columns(df.schema)
    most = IN_TASK_VALUES if most is None else most
    value = {c: _clean(df, c).cast("double") for c in names}
    plain = {c: {"min_value": F.min(v), "max_value": F.max(v), "mean": F.avg(v), "stddev": F.when(F.count(v) > 1, F.stddev_samp(v)).otherwise(F.when(F.count(v) == 1, 0.0)), "filled": F.count(v), "about": F.approx_count_distinct(v)} for c, v in value.items()}
    got = _rows(df, plain).collect()
    base = df.sparkSession.createDataFrame([tuple(r)[:5] for r in got if r.filled], "column string, min_value double, max_value double, mean double, stddev double")
    found = _percentiles(df, {r["column"]: r.about for r in got}, most)
    return base.join(found, "column") if found is not None else base.select("*", *[F.lit(None).cast("double").alias(n) for n, _ in CUTS])


def _percentiles(df: DataFrame, about: dict[str, int], most: int) -> DataFrame | None:
    """(column, *cuts) of columns with about so many distinct values."""
    few, many = ([c for c, n in about.items() if (n <= most) == side] for side in (True, False))
    parts = []
    if few:
        cuts = ", ".join(f"{p}D" for _, p in CUTS)
        found = df.selectExpr(*[f"percentile(CAST({_clean_sql(df, c)} AS double), array({cuts})) AS c{i}" for i, c in enumerate(few)]).first()
        parts.append(df.sparkSession.createDataFrame([(c, *(own or [None] * len(CUTS))) for c, own in zip(few, found)], "column string, " + ", ".join(f"{n} double" for n, _ in CUTS)))
    if many:
        value = {c: _clean(df, c).cast("double") for c in many}
        counts = [df.select(value[c].alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("column"), "v", "n") for c in many]
        parts.append(percentiles_by_rank(reduce(DataFrame.unionByName, counts)))
    return reduce(DataFrame.unionByName, parts) if parts else None


def numeric_approx(df: DataFrame, columns: list[str] | None = None, accuracy: int = 10_000) -> DataFrame:
    """The same figures in one pass with sketches: bounded state for any number of distinct values."""
    names = columns or numeric_columns(df.schema)
    rows = []
    for c in names:
        v = _clean(df, c).cast("double")
        cuts = F.percentile_approx(v, [0.25, 0.5, 0.75, 0.95], accuracy)
        rows.append(F.struct(F.lit(c).alias("column"), F.count(v).alias("filled"), F.approx_count_distinct(v).alias("distinct_count"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stddev"), *[cuts[i].alias(n) for i, n in enumerate(("p25", "median", "p75", "p95"))]))
    return df.agg(*[r.alias(f"c{i}") for i, r in enumerate(rows)]).select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(rows))])).alias("r")).select("r.*")


def _texts(df: DataFrame, columns: list[str] | None) -> dict[str, Column]:
    return {c: F.col(c).cast("string") for c in columns or flat_columns(df)}


def lengths(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Shortest, longest and mean text length in characters."""
    size = {c: F.char_length(v) for c, v in _texts(df, columns).items()}
    return _rows(df, {c: {"min_length": F.min(n), "max_length": F.max(n), "avg_length": F.round(F.avg(n), 1)} for c, n in size.items()}).where("min_length is not null")


def top_values(freq: DataFrame, k: int = TOP_VALUES, most_distinct: int = TOP_DISTINCT) -> DataFrame:
    """(column, rank, value, n): the most frequent values of columns with few distinct ones."""
    filled = freq.where("value is not null")
    few = filled.groupBy("column").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") <= most_distinct).select("column")
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.col("n").desc(), "value"))
    return filled.join(F.broadcast(few), "column").withColumn("rank", place).where(F.col("rank") <= k).select("column", "rank", "value", "n")


def with_long_texts(df: DataFrame, tops: DataFrame) -> DataFrame:
    """``top_values`` with the texts themselves where they are given by their digest.

    Only columns that have such values are scanned again, for at most as many texts as are listed."""
    digests: dict[str, list[str]] = {}
    for r in tops.where(F.col("value").rlike("^md5:[0-9a-f]{32}$")).select("column", "value").collect():
        digests.setdefault(r[0], []).append(r[1])
    if not digests:
        return tops
    found = [df.select(_key(df, c).alias("value"), F.col(c).cast("string").alias("text")).where((F.char_length("text") > LONG_TEXT) & F.col("value").isin(own)).groupBy("value").agg(F.min("text").alias("text")).withColumn("column", F.lit(c)) for c, own in digests.items()]
    met = tops.join(reduce(DataFrame.unionByName, found), ["column", "value"], "left")
    return met.select("column", "rank", F.coalesce("text", "value").alias("value"), "n")


def patterns(df: DataFrame, columns: list[str] | None = None, share: float = PATTERN_SHARE) -> DataFrame:
    """(column, detected_pattern): the first pattern that more than a share of all values match."""
    hits = {c: {name: F.count_if(v.rlike(p)) / F.count(v) for name, p in PATTERNS} | {"filled": F.count(v)} for c, v in _texts(df, columns).items()}
    found = F.coalesce(*[F.when(F.col(name) > share, F.lit(name)) for name, _ in PATTERNS])
    return _rows(df, hits).where("filled > 0").select("column", found.alias("detected_pattern"))


def temporal(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, min_date, max_date, days, rows, span_days) of date and timestamp columns."""
    names = columns or temporal_columns(df.schema)
    rows = [F.struct(F.lit(c).alias("column"), F.min(c).cast("string").alias("min_date"), F.max(c).cast("string").alias("max_date"), F.count_distinct(F.col(c).cast("date")).alias("days"), F.count(F.lit(1)).alias("rows"), F.datediff(F.max(c).cast("date"), F.min(c).cast("date")).alias("span_days")).alias(f"c{i}") for i, c in enumerate(names)]
    return df.agg(*rows).select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(names))])).alias("r")).select("r.*")


def connector_profile(freq: DataFrame) -> DataFrame:
    """The source-level profile: a null counts as one more distinct value."""
    value = F.col("value").try_cast("double")
    got = freq.groupBy("column").agg(F.sum("n").alias("row_count"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"), F.count(F.lit(1)).alias("distinct_count"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    return got


def profile(df: DataFrame, table: str) -> DataFrame:
    """One row a column with all figures that apply to its type; nested columns have nulls only."""
    return profile_all({table: df})


def _profiled(df: DataFrame, table: str, brief: bool = False) -> list[tuple]:
    """The rows of a table's profile; a brief one has the figures that roles are found by, and no others.

    A first aggregate gives all plain figures and an estimate of each column's distinct values. Columns
    of few values are then counted in one grouped pass, which gives their top values too; each
    other column is grouped by itself. What comes back is a row a column, or a row for each of few values."""
    spark, schema = df.sparkSession, df.schema
    kinds = {f.name: normalized(f.dataType) for f in schema}
    texts, numbers, times, flat = columns_of(schema, "varchar"), numeric_columns(schema), temporal_columns(schema), flat_columns(df)
    got = df.selectExpr(*[f"{_plain(df, c, kinds[c], brief)} AS c{i}" for i, c in enumerate(kinds)]).first() if kinds else ()
    rows = {c: {"column": c} | r.asDict() for c, r in zip(kinds, got)}
    few = [c for c in flat if rows[c]["about"] <= FEW_VALUES]
    counted = _counts_of_few(df, few)
    for c in few:
        rows[c]["distinct_count"] = sum(value is not None for value in counted[c])
    apart = [(c, "distinct_count", _key_sql(df, c)) for c in flat if c not in few] + [(c, "days", f"CAST({_quoted(c)} AS date)") for c in times if not brief]
    many = [df.selectExpr(f"{key} AS v").distinct().selectExpr(f"{i} AS i", "count(v) AS d") for i, (_, _, key) in enumerate(apart)]
    for r in reduce(DataFrame.union, many).collect() if many else ():
        column, figure, _ = apart[r[0]]
        rows[column][figure] = r[1]
    cuts = None if brief else _percentiles(df, {c: rows[c]["about"] for c in numbers}, IN_TASK_VALUES)
    for r in cuts.collect() if cuts is not None else ():
        rows[r[0]] |= r.asDict()
    tops = [(c, rank, value, n) for c in texts if not brief and c in counted and rows[c]["distinct_count"] <= TOP_DISTINCT for rank, (value, n) in enumerate(sorted(((v, n) for v, n in counted[c].items() if v is not None), key=lambda x: (-x[1], x[0]))[:TOP_VALUES], 1)]
    own: dict[str, list] = {}
    for c, _, value, n in with_long_texts(df, spark.createDataFrame(tops, "column string, rank int, value string, n bigint")).orderBy("column", "rank").collect() if tops else ():
        own.setdefault(c, []).append((value, n))
    for c, values in own.items():
        rows[c]["top_values"] = values
    return [(table, kinds[c], c in flat, *(rows[c].get(name) for name, _ in PROFILE_COLUMNS)) for c in kinds]


#: About so many distinct values let a column be counted together with others.
FEW_VALUES = 1_000


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _clean_sql(df: DataFrame, name: str) -> str:
    """``_clean`` as an expression; a table has many, and text is built faster than columns."""
    kind = df.schema[name].dataType.simpleString()
    return f"nanvl({_quoted(name)}, CAST(NULL AS {kind}))" if kind in ("float", "double") else _quoted(name)


def _key_sql(df: DataFrame, name: str) -> str:
    """``_key`` as an expression."""
    if normalized(df.schema[name].dataType) != "varchar":
        return _clean_sql(df, name)
    text = f"CAST({_quoted(name)} AS string)"
    return f"CASE WHEN char_length({text}) <= {LONG_TEXT} THEN {text} ELSE concat('md5:', md5({text})) END"


def _plain(df: DataFrame, c: str, kind: str, brief: bool = False) -> str:
    """Aggregates of one column as a struct; those that do not apply to its type are left out."""
    if kind in ("json", "list"):
        return f"named_struct('row_count', count(1), 'null_count', count_if({_quoted(c)} IS NULL), 'about', 0L)"
    key = _clean_sql(df, c)
    out = {"row_count": "count(1)", "null_count": f"count(1) - count({key})", "about": f"approx_count_distinct({key})"}
    if c in numeric_columns(df.schema):
        v = f"CAST({key} AS double)"
        out |= {"min_value": f"min({v})", "max_value": f"max({v})", "mean": f"avg({v})", "stddev": f"CASE WHEN count({v}) > 1 THEN stddev_samp({v}) WHEN count({v}) = 1 THEN 0D END"}
    if kind == "varchar" and not brief:
        text = f"CAST({_quoted(c)} AS string)"
        tried = " ".join(f"WHEN count_if({text} RLIKE r'{p}') / count({key}) > {PATTERN_SHARE} THEN '{name}'" for name, p in PATTERNS)
        out |= {"min_length": f"min(char_length({text}))", "max_length": f"max(char_length({text}))", "avg_length": f"round(avg(char_length({text})), 1)", "detected_pattern": f"CASE WHEN count({key}) = 0 THEN NULL {tried} END"}
    if c in temporal_columns(df.schema) and not brief:
        out |= {"min_date": f"CAST(min({key}) AS string)", "max_date": f"CAST(max({key}) AS string)", "span_days": f"datediff(CAST(max({key}) AS date), CAST(min({key}) AS date))"}
    return "named_struct(" + ", ".join(f"'{n}', {x}" for n, x in out.items()) + ")"


def _counts_of_few(df: DataFrame, columns: list[str]) -> dict[str, dict[str | None, int]]:
    """How often each value of some columns occurs, nulls too, in one pass that combines within tasks."""
    out: dict[str, dict[str | None, int]] = {c: {} for c in columns}
    if columns:
        cells = ", ".join(f"named_struct('i', {i}, 'value', CAST({_key_sql(df, c)} AS string))" for i, c in enumerate(columns))
        for r in df.selectExpr(f"explode(array({cells})) AS c").groupBy("c.i", "c.value").count().collect():
            out[columns[r[0]]][r[1]] = r[2]
    return out


#: Figures of a profile; most are of some types only.
PROFILE_COLUMNS = (
    ("column", "string"), ("row_count", "bigint"), ("null_count", "bigint"), ("distinct_count", "bigint"), ("min_value", "double"), ("max_value", "double"), ("mean", "double"), ("stddev", "double"),
    *((name, "double") for name, _ in CUTS), ("min_length", "int"), ("max_length", "int"), ("avg_length", "double"), ("top_values", "array<struct<value:string,count:bigint>>"), ("detected_pattern", "string"),
    ("min_date", "string"), ("max_date", "string"), ("days", "bigint"), ("span_days", "int"),
)


def profile_all(tables: dict[str, DataFrame], at_once: int = 8, brief: bool = False) -> DataFrame:
    """``profile`` of many tables: one small frame. The jobs of some tables run side by side. A brief one
    has exact counts, ranges, means and spreads, and nulls for all figures that no role is found by."""
    with ThreadPoolExecutor(at_once) as pool:
        rows = [r for own in pool.map(lambda item: _profiled(item[1], item[0], brief), tables.items()) for r in own]
    spark = next(iter(tables.values())).sparkSession
    schema = ", ".join(f"`{n}` {t}" for n, t in (("table", "string"), ("dtype", "string"), ("flat", "boolean"), *PROFILE_COLUMNS))
    filled = F.col("row_count") - F.col("null_count")
    rates = {"null_rate": F.round(F.try_divide("null_count", "row_count"), 4), "uniqueness_ratio": F.coalesce(F.round(F.try_divide("distinct_count", filled), 4), F.lit(0.0))}
    return spark.createDataFrame(rows, schema).withColumns({n: F.when(F.col("flat"), x) for n, x in rates.items()}).drop("flat")


# What a column means, from its name and its profile -----------------------------------------------


@dataclass(frozen=True)
class Words:
    """Names that say something: the whole name, its end, or any part of it, in lower case."""

    whole: Sequence[str] = ()
    ends: Sequence[str] = ()
    holds: Sequence[str] = ()

    def match(self, name: Column) -> Column:
        tests = [name.isin(*self.whole)] if self.whole else []
        tests += [name.endswith(w) for w in self.ends] + [F.contains(name, F.lit(w)) for w in self.holds]
        return reduce(Column.__or__, tests)


#: Words of a column's name by the kind that they stand for, tried from top to bottom.
NAME_KINDS: tuple[tuple[str, Words], ...] = (
    ("id", Words(whole=["id"], ends=["_id"])),
    ("pii", Words(holds=["email", "phone", "ssn"])),
    ("dimension", Words(ends=["name", "type"], holds=["category", "status"])),
    ("dimension", Words(whole=["county", "borough", "city", "state", "country", "region", "district", "ward", "province", "department", "zone", "sector", "priority", "severity", "channel", "source", "platform", "tier", "level", "class", "group", "gender", "race", "ethnicity"])),
    ("dimension", Words(whole=["tract", "board"], ends=["code", "flag", "indicator", "number", "_num", "_no", "_tract", "_board"])),
    ("temporal", Words(whole=["year", "month"], ends=["_at"], holds=["date", "timestamp"])),
    ("metric", Words(whole=["count", "rate", "value"], ends=["_count", "_rate", "_value", "_measure"], holds=["score", "amount", "budget", "pct_", "measure_"])),
    ("geographic", Words(whole=["lat", "lon"], holds=["latitude", "longitude", "address"])),
    ("text", Words(holds=["description", "narrative", "notes"])),
)
#: Names of identifiers, of numbers that are not metrics, of times, and those that leave no doubt.
ID_NAMES = Words(whole=["id", "key", "uuid"], ends=["_id", "_key", "_fk", "_pk"])
NOT_METRIC_NAMES = Words(whole=["number", "lat", "lon"], ends=["code", "flag", "indicator", "_number"], holds=["latitude", "longitude"])
TIME_NAMES = Words(whole=["month", "year", "day", "week"], ends=["_time", "_month", "_year", "_day", "_week"], holds=["date", "timestamp"])
SURE_NAMES = Words(whole=["id", "count", "rate"], ends=["_id", "_count", "_rate"], holds=["email", "phone", "ssn", "score", "amount", "budget", "latitude", "longitude"])
#: Name tokens that say nothing about kinship.
NOISE = ("id", "date", "name", "type", "code", "at", "status", "flag", "count", "rate", "value", "number", "description", "notes", "created", "updated", "is", "has", "pct")
#: Beginnings of names of times.
TIME_BEGINNINGS = ("time_", "month_", "year_", "day_", "week_")


def _is_number() -> Column:
    return F.col("dtype").isin("int64", "float64")


def _room() -> Column:
    """How many distinct values a dimension of so many rows may have."""
    return F.greatest(F.lit(2), F.least(F.lit(200), F.floor(F.sqrt("row_count")).cast("int")))


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def semantic_type(profiled: DataFrame) -> DataFrame:
    """Add ``semantic_type`` and ``name_confidence``: the name's kind, refined by the profile."""
    # A numbered type (``some_type_2``) reads like one without a number.
    name = F.regexp_replace(F.lower("column"), r"_type_\d+$", "_type")
    hits = [(kind, words, words.match(name)) for kind, words in NAME_KINDS]
    named = F.coalesce(*[F.when(hit, F.lit(kind)) for kind, _, hit in hits])
    alone = next(hit for kind, words, hit in hits if "county" in words.whole)
    sure = F.when(named.isNull(), 0.0).when(SURE_NAMES.match(name), 0.9).when(alone, 0.8).otherwise(0.7)
    unique = _is_number() & (F.col("uniqueness_ratio") > 0.9)
    spread = _is_number() & (F.col("stddev") > 0) & (F.col("max_value") > F.col("min_value"))
    by_data = F.coalesce(F.when(unique, F.lit("id")), F.when(spread, F.lit("metric")), F.when(F.col("distinct_count") <= _room(), F.lit("dimension")), F.when(_is_number() & F.col("mean").isNotNull(), F.lit("metric")))
    kind = F.coalesce(F.when((named == "dimension") & unique, F.lit("id")), named, by_data)
    return profiled.withColumn("semantic_type", kind).withColumn("name_confidence", sure)


def is_primary_key(key_name: Column) -> Column:
    """A key by its name that the data bears out: no nulls and no repeats."""
    return key_name & (F.col("null_count") == 0) & (F.col("distinct_count") == F.col("row_count")) & (F.col("row_count") > 0)


def roles(typed: DataFrame, primary_key: Column) -> DataFrame:
    """Add ``is_metric``, ``is_dimension``, ``role`` and ``confidence`` to a typed profile.

    What is known of a column is gathered as flags first; the role is the first of a list of claims
    whose flags hold."""
    kind, name, dtype = F.col("semantic_type"), F.lower("column"), F.col("dtype")
    tagged = lambda *kinds: _yes(kind.isin(*kinds))
    number = _is_number()
    key = primary_key | ID_NAMES.match(name) | tagged("id", "foreign_key", "primary_key")
    counts = number & ~key & ~NOT_METRIC_NAMES.match(name) & ~tagged("dimension", "temporal", "geographic", "pii", "text")
    few = _yes(F.col("distinct_count") <= 200)
    groups = few & ~key & ~tagged("geographic") & (tagged("dimension") | (dtype == "varchar") | (number & ~tagged("metric")))
    timed = TIME_NAMES.match(name) | reduce(Column.__or__, [name.startswith(w) for w in TIME_BEGINNINGS])
    claims = (
        ("identifier", key | _yes((dtype == "int64") & (F.col("uniqueness_ratio") >= 0.8))),
        ("metric", tagged("metric") & number),
        ("dimension", tagged("dimension")),
        ("temporal", dtype.isin("date", "timestamp") | tagged("temporal") | (timed & (dtype != "varchar"))),
        ("geographic", tagged("geographic")),
        ("text", tagged("text", "pii")),
        ("metric", counts),
        ("dimension", groups),
    )
    role = F.coalesce(*[F.when(holds, F.lit(name_)) for name_, holds in claims], F.lit("unknown"))
    return typed.withColumns({"is_metric": counts, "is_dimension": groups, "role": role, "confidence": confidence()})


#: What adds to, or makes up, the confidence in a column's kind. Agreement of a named kind
#: with the data; by how full a dimension's room is; by how far it is overrun; spread and range of numbers.
AGREEMENT = {"metric": 0.1, "dimension": 0.05, "id": 0.1}
BY_FULLNESS = ((0.2, 0.75), (0.5, 0.65), (float("inf"), 0.45))
BY_OVERRUN = ((1.5, 0.0), (3.0, 0.08), (float("inf"), 0.15))
OF_SPREAD, OF_RANGE, OF_NUMBERS, OF_NOTHING = 0.1, 0.05, 0.55, 0.3
OF_UNIQUE, UNIQUE_FROM, UNIQUE_MORE, UNIQUE_MOST = 0.7, 0.9, 2.0, 0.2


def _below(value: Column, table: Sequence[tuple[float, float]], or_equal: bool) -> Column:
    """The figure beside the first limit that the value is below (or, if so asked, equal to)."""
    return F.coalesce(*[F.when(value <= at if or_equal else value < at, F.lit(figure)) for at, figure in table])


def confidence() -> Column:
    """How sure the kind is. With a speaking name: the name's part, and more if the data agrees.
    Otherwise the evidence that decided: uniqueness, fullness of the dimension's room, or numbers."""
    number, named, kind = _is_number(), F.col("name_confidence"), F.col("semantic_type")
    ratio, fullness = F.col("uniqueness_ratio"), F.col("distinct_count") / _room()
    has_mean, is_unique = number & F.col("mean").isNotNull(), number & (ratio > UNIQUE_FROM)
    agrees = {"metric": has_mean, "dimension": ~number, "id": is_unique}
    bonus = F.coalesce(*[F.when((kind == k) & holds, F.lit(AGREEMENT[k])) for k, holds in agrees.items()], F.lit(0.0))
    points = lambda holds, figure: F.when(holds, F.lit(figure)).otherwise(F.lit(0.0))
    numeric_case = F.lit(OF_NUMBERS) + F.coalesce(_below(fullness, BY_OVERRUN, True), F.lit(0.0)) + points(F.col("stddev") > 0, OF_SPREAD) + points(F.col("max_value") > F.col("min_value"), OF_RANGE)
    by_data = F.coalesce(
        F.when(is_unique, OF_UNIQUE + F.least(F.lit(UNIQUE_MOST), (ratio - UNIQUE_FROM) * UNIQUE_MORE)),
        F.when(fullness <= 1, _below(fullness, BY_FULLNESS, False)), F.when(has_mean, numeric_case), F.lit(OF_NOTHING),
    )
    return F.round(F.when(named > 0, F.least(F.lit(1.0), named + bonus)).otherwise(by_data), 4)


def sibling_roles(typed: DataFrame, least: int = 3, majority: float = 0.6) -> DataFrame:
    """Columns of a table that share a name token take on the role that most of them have.

    Only columns of confidence under 0.75 change, and only numbers become metrics. Of several
    tokens the one with the clearest majority decides, then the first in order."""
    token = F.explode(F.array_distinct(F.filter(F.split(F.lower("column"), "[_ ]+"), lambda t: (F.length(t) >= 3) & ~t.isin(*NOISE))))
    members = typed.where(F.col("confidence") < 0.8).select("table", "column", "role", token.alias("token"))
    by_role = members.groupBy("table", "token", "role").agg(F.count(F.lit(1)).alias("n"))
    whole = by_role.groupBy("table", "token").agg(F.sum("n").alias("size"), F.max(F.struct("n", "role")).alias("best"))
    clear = whole.where((F.col("size") >= least) & (F.col("best.n") >= majority * F.col("size")) & F.col("best.role").isin("metric", "dimension"))
    pick = members.join(clear, ["table", "token"]).groupBy("table", "column").agg(F.max(F.struct((F.col("best.n") / F.col("size")).alias("share"), F.col("best.role").alias("role"))).alias("m"))
    joined = typed.join(pick, ["table", "column"], "left")
    flips = F.col("m").isNotNull() & (F.col("confidence") < 0.75) & (F.col("m.role") != F.col("role")) & ((F.col("m.role") == "dimension") | F.col("dtype").isin("int64", "float64"))
    changed = {"role": F.when(flips, F.col("m.role")).otherwise(F.col("role")), "semantic_type": F.when(flips, F.col("m.role")).otherwise(F.col("semantic_type")), "confidence": F.when(flips, F.greatest("confidence", F.lit(0.65))).otherwise(F.col("confidence"))}
    return joined.withColumns(changed).drop("m")


def grain_by_days(ranges: DataFrame) -> DataFrame:
    """Add ``grain`` from a hint in the name, or from distinct days over the span of days."""
    name, ratio = F.lower("column"), F.col("days") / F.col("span_days")
    hint = F.when(name.contains("year"), F.lit("yearly")).when(name.contains("month"), F.lit("monthly")).when(name.contains("week"), F.lit("weekly"))
    data = F.when(F.col("span_days") > 0, F.when(ratio > 0.8, F.lit("daily")).when(ratio > 0.2, F.lit("weekly")).when(ratio > 0.02, F.lit("monthly")).otherwise(F.lit("yearly")))
    return ranges.withColumn("grain", F.coalesce(hint, data, F.lit("event-based")))


def grain_by_rows(ranges: DataFrame) -> DataFrame:
    """Add ``row_grain`` from rows per day of the span."""
    per_day = F.col("rows") / F.col("span_days")
    data = F.when(per_day >= 10, F.lit("event-based")).when(per_day >= 0.8, F.lit("daily")).when(per_day >= 0.2, F.lit("weekly")).when(per_day >= 0.03, F.lit("monthly")).otherwise(F.lit("yearly"))
    return ranges.withColumn("row_grain", F.when(F.col("span_days").isNull() | (F.col("rows") == 0), F.lit("none")).when(F.col("span_days") == 0, F.lit("snapshot")).otherwise(data))
