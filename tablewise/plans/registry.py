"""Queries over the standard tables and the DuckDB SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.operators import drift, graph, health, insights, marts, metrics, profile, quality, relate, similarity, staging
from tablewise.operators import terms as term_matches
from tablewise.operators.metrics import Metric
from tablewise.operators.quality import Rule
from tablewise.operators.relate import Edge
from tablewise.sources import files, jdbc, sinks
from tablewise.sources.paths import scratch, small, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TPCH = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}


class Tables:
    """The Parquet tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return files.read_parquet(self.spark, f"{self.folder}/{name}.parquet")

    def many(self, *names: str) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in names}


def query(sql: str | None = None):
    """Register a function of ``Tables`` under its own name."""

    def add(function):
        QUERIES[function.__name__] = lambda spark, folder: function(Tables(spark, folder))
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def union_sql(part: Callable[[str], str], columns: list[str]) -> str:
    return "\nUNION ALL\n".join(part(c) for c in columns)


# Profiles -----------------------------------------------------------------------------------------

LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_COLUMNS = [*LINE_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]
UNIVERSAL = """SELECT '{c}' AS "column", CAST(count(*) AS BIGINT) AS row_count, CAST(count(*) - count({c}) AS BIGINT) AS null_count, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_count,
round((count(*) - count({c})) / count(*) + 1e-12, 4) AS null_rate, coalesce(round(count(DISTINCT {c}) / nullif(count({c}), 0) + 1e-12, 4), 0.0) AS uniqueness_ratio FROM {t}"""


@query(union_sql(lambda c: UNIVERSAL.format(c=c, t="lineitem"), LINE_COLUMNS))
def profile_universal(t):
    return profile.universal(profile.frequencies(t.lineitem))


@query(union_sql(lambda c: f"""SELECT '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS stddev,
quantile_cont(CAST({c} AS DOUBLE), 0.25) AS p25, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS p75, round(quantile_cont(CAST({c} AS DOUBLE), 0.95), 6) AS p95 FROM lineitem""", LINE_NUMBERS))
def profile_numeric(t):
    got = profile.numeric(t.lineitem, LINE_NUMBERS)
    return got.withColumns({c: F.round(c, 6) for c in ("mean", "stddev", "p95")})


@query(union_sql(lambda c: f"""SELECT '{c}' AS "column", quantile_cont(CAST({c} AS DOUBLE), 0.25) AS p25, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS p75, round(quantile_cont(CAST({c} AS DOUBLE), 0.95), 6) AS p95 FROM lineitem""", LINE_NUMBERS))
def percentiles_by_rank(t):
    got = profile.numeric(t.lineitem, LINE_NUMBERS, most=-1)
    return got.select("column", "p25", "median", "p75", F.round("p95", 6).alias("p95"))


TEXTS = [("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("customer", "c_name"), ("customer", "c_mktsegment"), ("pages", "url")]


def _texts(t, step):
    parts = [step(getattr(t, table), [c]) for table, c in TEXTS]
    return reduce(DataFrame.unionByName, parts)


@query(union_sql(lambda x: f"""SELECT '{x[1]}' AS "column", min(length({x[1]})) AS min_length, max(length({x[1]})) AS max_length, round(avg(length({x[1]})), 1) AS avg_length FROM {x[0]}""", TEXTS))
def profile_strings(t):
    return _texts(t, profile.lengths).withColumns({c: F.col(c).cast("bigint") for c in ("min_length", "max_length")})


@query(union_sql(lambda x: f"""SELECT "column", rank, value, n FROM (SELECT '{x[1]}' AS "column", CAST(row_number() OVER (ORDER BY count(*) DESC, {x[1]}) AS INTEGER) AS rank, {x[1]} AS value, count(*) AS n, count(*) OVER () AS d FROM {x[0]} WHERE {x[1]} IS NOT NULL GROUP BY {x[1]}) WHERE d <= 100 AND rank <= 30""", TEXTS))
def top_values(t):
    return _texts(t, lambda df, names: profile.top_values(profile.frequencies(df, names)))


_SQL_PATTERNS = " ".join(f"WHEN avg(CASE WHEN regexp_matches(CAST({{c}} AS VARCHAR), '{p}') THEN 1.0 ELSE 0.0 END) > 0.7 THEN '{n}'" for n, p in profile.PATTERNS)
PATTERNED = [("pages", "url"), ("customer", "c_name"), ("orders", "o_orderdate"), ("documents", "n_chars")]


@query(union_sql(lambda x: f"""SELECT '{x[1]}' AS "column", CASE {_SQL_PATTERNS.replace('{c}', x[1])} END AS detected_pattern FROM {x[0]} WHERE {x[1]} IS NOT NULL""", PATTERNED))
def patterns(t):
    return reduce(DataFrame.unionByName, [profile.patterns(getattr(t, table), [c]) for table, c in PATTERNED])


_RANGE = """SELECT '{c}' AS "column", strftime(min({c}), '%Y-%m-%d') AS min_day, strftime(max({c}), '%Y-%m-%d') AS max_day, count(DISTINCT CAST({c} AS DATE)) AS days, count(*) AS rows, date_diff('day', CAST(min({c}) AS DATE), CAST(max({c}) AS DATE)) AS span_days FROM {t}"""
_RANGES = " UNION ALL ".join(_RANGE.format(c=c, t=table) for table, c in (("orders", "o_orderdate"), ("events", "ts"), ("lineitem", "l_shipdate")))


def _ranges(t):
    return reduce(DataFrame.unionByName, [profile.temporal(df) for df in (t.orders, t.events, t.lineitem)])


@query(f"SELECT \"column\", min_day, max_day, days, rows, CAST(span_days AS INTEGER) AS span_days FROM ({_RANGES})")
def profile_temporal(t):
    return _ranges(t).select("column", F.substring("min_date", 1, 10).alias("min_day"), F.substring("max_date", 1, 10).alias("max_day"), "days", "rows", "span_days")


@query(f"""SELECT "column", CASE WHEN span_days <= 0 THEN 'event-based' WHEN days / span_days > 0.8 THEN 'daily' WHEN days / span_days > 0.2 THEN 'weekly' WHEN days / span_days > 0.02 THEN 'monthly' ELSE 'yearly' END AS grain,
CASE WHEN span_days = 0 THEN 'snapshot' WHEN rows / span_days >= 10 THEN 'event-based' WHEN rows / span_days >= 0.8 THEN 'daily' WHEN rows / span_days >= 0.2 THEN 'weekly' WHEN rows / span_days >= 0.03 THEN 'monthly' ELSE 'yearly' END AS row_grain FROM ({_RANGES})""")
def temporal_grain(t):
    return profile.grain_by_rows(profile.grain_by_days(_ranges(t))).select("column", "grain", "row_grain")


@query(union_sql(lambda c: f"""SELECT '{c}' AS "column", count(*) AS row_count, count(*) - count(x.{c}) AS null_count, count(DISTINCT x.{c}) + CASE WHEN count(*) > count(x.{c}) THEN 1 ELSE 0 END AS distinct_count, min(TRY_CAST(x.{c} AS DOUBLE)) AS min_value, max(TRY_CAST(x.{c} AS DOUBLE)) AS max_value
FROM (SELECT user_id, event_type, CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END AS value FROM events) x""", ["user_id", "event_type", "value"]))
def connector_profile(t):
    rows = with_null_values(t.events).select("user_id", "event_type", "value")
    return profile.connector_profile(profile.frequencies(rows))


@query(union_sql(lambda c: f"""SELECT '{c}' AS "column", count({c}) AS filled, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS stddev FROM part""", ["p_partkey", "p_size", "p_retailprice"]))
def profile_single_pass(t):
    got = profile.numeric_approx(t.part)
    return got.select("column", "filled", "min_value", "max_value", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"))


def with_null_values(events: DataFrame) -> DataFrame:
    """Events with the value of every fiftieth event missing."""
    return events.withColumn("value", F.when(F.col("event_id") % 50 != 0, F.col("value")))


def _universal_all(t, names=TPCH) -> DataFrame:
    return reduce(DataFrame.unionByName, [profile.universal(profile.frequencies(df)).withColumn("table", F.lit(n)) for n, df in t.many(*names).items()])


TPCH_COLUMNS = [("region", c) for c in ("r_regionkey", "r_name")] + [("nation", c) for c in ("n_nationkey", "n_name", "n_regionkey")] + [("customer", c) for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")] + [("supplier", c) for c in ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")] + [("part", c) for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")] + [("orders", c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")] + [("lineitem", c) for c in LINE_COLUMNS]
ALL_UNIVERSAL = union_sql(lambda x: f"SELECT '{x[0]}' AS \"table\", * FROM ({UNIVERSAL.format(c=x[1], t=x[0])})", TPCH_COLUMNS)


@query(f"""SELECT "table", "column" FROM ({ALL_UNIVERSAL}) WHERE null_count = 0 AND distinct_count = row_count AND row_count > 0 AND regexp_matches("column", 'key$')""")
def pk_candidates(t):
    return _universal_all(t).where(profile.is_primary_key(F.col("column").rlike("key$"))).select("table", "column")


def _typed(t, names):
    # A row a column, which what follows reads more than once.
    every = profile.profile_all(t.many(*names), brief=True)
    return small(profile.roles(profile.semantic_type(every), profile.is_primary_key(F.col("column").rlike("key$"))))


_ROLE_SQL = """WITH p AS ({profile}), k AS (
    SELECT *, dtype IN ('int64', 'float64') AS num, greatest(2, least(200, CAST(floor(sqrt(row_count)) AS INTEGER))) AS lim,
        CASE WHEN regexp_matches("column", '(^|_)id$') THEN 'id' WHEN regexp_matches("column", 'email|phone|ssn') THEN 'pii'
             WHEN regexp_matches("column", 'name$|type$|category|status|code$|flag$|indicator$|number$|_num$|_no$') THEN 'dimension'
             WHEN regexp_matches("column", 'date|_at$|timestamp') THEN 'temporal' WHEN regexp_matches("column", 'score|amount|(^|_)value$') THEN 'metric' END AS named FROM p
), s AS (
    SELECT *, CASE WHEN named = 'dimension' AND num AND uniqueness_ratio > 0.9 THEN 'id' WHEN named IS NOT NULL THEN named WHEN num AND uniqueness_ratio > 0.9 THEN 'id'
        WHEN num AND dev > 0 AND hi > lo THEN 'metric' WHEN distinct_count <= lim THEN 'dimension' WHEN num THEN 'metric' END AS semantic_type,
        null_count = 0 AND distinct_count = row_count AND regexp_matches("column", 'key$') AS pk FROM k
)
SELECT "table", "column", dtype, semantic_type, named, num, lim, pk, row_count, distinct_count, uniqueness_ratio, dev, lo, hi,
    CASE WHEN pk OR regexp_matches("column", '(_id|_key)$') OR coalesce(semantic_type = 'id', false) OR (dtype = 'int64' AND uniqueness_ratio >= 0.8) THEN 'identifier'
         WHEN semantic_type = 'metric' AND num THEN 'metric' WHEN semantic_type = 'dimension' THEN 'dimension'
         WHEN dtype IN ('date', 'timestamp') OR coalesce(semantic_type = 'temporal', false) THEN 'temporal'
         WHEN num AND semantic_type IS NULL THEN 'metric' WHEN dtype = 'varchar' AND distinct_count <= 200 THEN 'dimension' ELSE 'unknown' END AS role
FROM s"""
_KINDS = {"r_regionkey": "int64", "n_nationkey": "int64", "n_regionkey": "int64", "c_custkey": "int64", "c_nationkey": "int64", "s_suppkey": "int64", "s_nationkey": "int64", "p_partkey": "int64", "p_size": "int64", "o_orderkey": "int64", "o_custkey": "int64", "c_acctbal": "float64", "s_acctbal": "float64", "p_retailprice": "float64", "o_totalprice": "float64", "o_orderdate": "timestamp", "l_shipdate": "timestamp", "l_orderkey": "int64", "l_partkey": "int64", "l_suppkey": "int64", "l_linenumber": "int64", "l_quantity": "float64", "l_extendedprice": "float64", "l_discount": "float64", "l_tax": "float64"}
def _role_profile(x: tuple[str, str]) -> str:
    number = "NULL::DOUBLE" if _KINDS.get(x[1], "varchar") in ("varchar", "timestamp") else f"CAST({x[1]} AS DOUBLE)"
    return f"SELECT '{x[0]}' AS \"table\", '{_KINDS.get(x[1], 'varchar')}' AS dtype, stddev_samp({number}) AS dev, min({number}) AS lo, max({number}) AS hi, " + UNIVERSAL.format(c=x[1], t=x[0])[7:]


_ROLE_PROFILE = union_sql(_role_profile, TPCH_COLUMNS)


_ROLES = _ROLE_SQL.format(profile=_ROLE_PROFILE)
#: Confidence from the name's part and the data, flags, and what most columns of a token are.
_CONFIDENCE = f"""WITH r AS ({_ROLES}), c AS (
    SELECT *, CASE WHEN regexp_matches("column", '(_id|_key)$') OR pk OR coalesce(semantic_type = 'id', false) THEN true ELSE false END AS ident, CASE WHEN named IS NULL THEN 0.0 WHEN regexp_matches("column", '(^|_)id$|email|phone|ssn|(^|_)count$|score|(^|_)rate$|amount|budget') THEN 0.9 ELSE 0.7 END AS base,
        distinct_count / lim AS fullness FROM r
), d AS (
    SELECT *, round(CASE WHEN base > 0 THEN least(1.0, base + CASE WHEN semantic_type = 'metric' AND num THEN 0.1 WHEN semantic_type = 'dimension' AND NOT num THEN 0.05 WHEN semantic_type = 'id' AND num AND uniqueness_ratio > 0.9 THEN 0.1 ELSE 0.0 END)
        WHEN num AND uniqueness_ratio > 0.9 THEN 0.7 + least(0.2, (uniqueness_ratio - 0.9) * 2) WHEN fullness <= 1 THEN CASE WHEN fullness < 0.2 THEN 0.75 WHEN fullness < 0.5 THEN 0.65 ELSE 0.45 END
        WHEN num THEN 0.55 + CASE WHEN fullness > 3 THEN 0.15 WHEN fullness > 1.5 THEN 0.08 ELSE 0.0 END + CASE WHEN dev > 0 THEN 0.1 ELSE 0.0 END + CASE WHEN hi > lo THEN 0.05 ELSE 0.0 END ELSE 0.3 END, 4) AS confidence,
        num AND NOT ident AND NOT regexp_matches("column", '(code|flag|indicator|_number)$') AND coalesce(semantic_type, '') NOT IN ('dimension', 'temporal', 'geographic', 'pii', 'text') AS is_metric,
        NOT ident AND distinct_count <= 200 AND (coalesce(semantic_type, '') = 'dimension' OR dtype = 'varchar' OR (num AND coalesce(semantic_type, '') <> 'metric')) AS is_dimension FROM c
), k AS (
    SELECT "table", "column", role, unnest(list_filter(list_distinct(string_split_regex(lower("column"), '[_ ]+')), lambda x: length(x) >= 3 AND NOT list_contains({list(profile.NOISE)}, x))) AS token FROM d WHERE confidence < 0.8
), n AS (SELECT "table", token, role, count(*) AS n FROM k GROUP BY ALL), w AS (SELECT "table", token, sum(n) AS size, max(struct_pack(n := n, role := role)) AS best FROM n GROUP BY ALL HAVING sum(n) >= 3),
m AS (SELECT k."table", k."column", max(struct_pack(share := best.n / size, role := best.role)) AS m FROM k JOIN w USING ("table", token) WHERE best.n >= 0.6 * size AND best.role IN ('metric', 'dimension') GROUP BY ALL),
e AS (SELECT d.*, m.m IS NOT NULL AND confidence < 0.75 AND m.m.role <> d.role AND (m.m.role = 'dimension' OR num) AS flips, m.m.role AS new_role FROM d LEFT JOIN m USING ("table", "column"))
SELECT "table", "column", CASE WHEN flips THEN new_role ELSE semantic_type END AS semantic_type, CASE WHEN flips THEN new_role ELSE role END AS role, is_metric, is_dimension, CASE WHEN flips THEN greatest(confidence, 0.65) ELSE confidence END AS confidence FROM e"""


@query(f'SELECT "table", "column", dtype, semantic_type, role FROM ({_ROLES})')
def column_roles(t):
    return _typed(t, TPCH).select("table", "column", "dtype", "semantic_type", "role")


@query(_CONFIDENCE)
def column_confidence(t):
    return profile.sibling_roles(_typed(t, TPCH)).select("table", "column", "semantic_type", "role", "is_metric", "is_dimension", "confidence")


# Relations and joins ------------------------------------------------------------------------------

FK = [("customer", "c_nationkey", "nation", "n_nationkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("supplier", "s_nationkey", "nation", "n_nationkey")]
_FK_SQL = union_sql(lambda e: f"""SELECT '{e[0]}' AS from_table, '{e[1]}' AS from_column, '{e[2]}' AS to_table, '{e[3]}' AS to_column, (SELECT count({e[1]}) FROM {{{e[0]}}}) AS n_values, count(*) AS n_distinct, count(k.{e[3]}) AS n_matched
FROM (SELECT DISTINCT {e[1]} FROM {{{e[0]}}} WHERE {e[1]} IS NOT NULL) f LEFT JOIN (SELECT DISTINCT {e[3]} FROM {{{e[2]}}}) k ON f.{e[1]} = k.{e[3]}""", FK)


def _fk_sql(**replaced) -> str:
    return _FK_SQL.format(**{n: replaced.get(n, n) for n in TPCH})


def keyless_customers(t, expression: str = "c_custkey % 3 <> 0") -> DataFrame:
    """All customers, but only those that meet the expression have their key, so that the orders of
    the others have no parent."""
    return t.customer.withColumn("c_custkey", F.when(F.expr(expression), F.col("c_custkey")))


def fewer_customers(t) -> dict[str, DataFrame]:
    return t.many(*TPCH) | {"customer": keyless_customers(t)}


_FEWER = {"customer": "(SELECT * REPLACE (CASE WHEN c_custkey % 3 <> 0 THEN c_custkey END AS c_custkey) FROM customer)"}


@query(f"SELECT from_table, from_column, to_table, to_column, n_values, n_distinct, n_matched, n_matched / n_distinct AS ref_integrity, CASE WHEN n_values = n_distinct THEN 'one_to_one' ELSE 'many_to_one' END AS rel_type FROM ({_fk_sql()})")
def fk_integrity(t):
    tables = t.many(*TPCH)
    found = relate.candidates({n: df.columns for n, df in tables.items()}, KEYS, prefixed=True)
    return relate.integrity(tables, found).drop("edge")


@query(f"""SELECT * FROM (SELECT from_table, from_column, to_table, to_column, round(n_matched / n_distinct, 6) AS ref_integrity, CASE WHEN n_matched / n_distinct > 0.9 THEN 0.9 ELSE 0.7 END AS confidence, CASE WHEN n_matched = n_distinct THEN 'inferred_value' ELSE 'inferred_name' END AS source FROM ({_fk_sql(**_FEWER)})) WHERE ref_integrity >= 0.5""")
def fk_edges(t):
    got = relate.detect(fewer_customers(t), KEYS, prefixed=True)
    return got.select("from_table", "from_column", "to_table", "to_column", F.round("ref_integrity", 6).alias("ref_integrity"), "confidence", "source")


@query("SELECT c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON o_custkey = CASE WHEN c_custkey % 3 = 0 THEN c_custkey END GROUP BY c_mktsegment")
def join_left_nullable(t):
    edge = Edge("orders", "o_custkey", "customer", "c_custkey", ref_integrity=0.33)
    joined = relate.join_edge(t.orders, keyless_customers(t, "c_custkey % 3 = 0"), edge)
    return joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


EDGES = [Edge(*e) for e in FK]


@query("SELECT n_name, count(*) AS orders, round(avg(o_totalprice), 2) AS avg_price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_two_hop(t):
    joined = relate.join_path(t.many("orders", "customer", "nation"), EDGES, "orders", "nation")
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.avg("o_totalprice"), 2).alias("avg_price"))


@query("SELECT r_name, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def join_path(t):
    joined = relate.join_path(t.many("orders", "customer", "nation", "region"), EDGES, "orders", "region")
    return joined.groupBy("r_name").agg(F.count(F.lit(1)).alias("orders"))


@query("SELECT c_mktsegment, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def join_inner_fk(t):
    return relate.join_edge(t.orders, t.customer, Edge("orders", "o_custkey", "customer", "c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("orders"))


# Staging, sources and sinks -----------------------------------------------------------------------


@query("SELECT o_orderkey AS order_key, o_custkey AS customer_no, o_totalprice AS total_price, strftime(o_orderdate, '%Y-%m-%d') AS order_date FROM orders")
def staging_orders(t):
    raw = t.orders.select(F.col("o_orderkey").alias("OrderKey"), F.col("o_custkey").alias("Customer No."), F.col("o_totalprice").alias("total price"), F.col("o_orderdate").cast("string").alias("Order-Date"))
    return staging.stage(raw, {"Order-Date": "date"}).drop("_loaded_at").withColumn("order_date", F.col("order_date").cast("string"))


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS name_1, c_mktsegment AS col FROM customer")
def header_normalization(t):
    raw = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").toDF(" ID ", "Name", "name!", "--")
    return staging.normalized_headers(raw)


_EVENT_KINDS = "CASE typeof({c}) WHEN 'BIGINT' THEN 'int64' WHEN 'INTEGER' THEN 'int64' WHEN 'DOUBLE' THEN 'float64' WHEN 'TIMESTAMP' THEN 'timestamp' WHEN 'DATE' THEN 'date' WHEN 'VARCHAR' THEN 'varchar' WHEN 'BOOLEAN' THEN 'bool' WHEN 'VARCHAR[]' THEN 'list' ELSE 'json' END"


def _kind_sql(name: str, rows: str) -> str:
    return f"(SELECT {_EVENT_KINDS.format(c=name)} FROM {rows} LIMIT 1)"


_WIDE_EVENTS = f"(SELECT e.*, [event_type] AS tags, struct_pack(event_id := event_id, v := value) AS pair, value > 50 AS high, CAST(ts AS DATE) AS day FROM (SELECT * REPLACE (CASE WHEN event_id % 50 <> 0 THEN value END AS value) FROM events) e)"


@query(union_sql(lambda x: f"SELECT '{x[1]}' AS \"column\", {x[0]} AS position, {_kind_sql(x[1], _WIDE_EVENTS)} AS dtype, (SELECT count({x[1]}) FROM {_WIDE_EVENTS}) AS filled", list(enumerate(["event_id", "ts", "user_id", "event_type", "value", "props", "tags", "pair", "high", "day"]))))
def type_normalization(t):
    rows = with_null_values(t.events)
    return staging.normalized_schema(rows.withColumns({"tags": F.array("event_type"), "pair": F.struct("event_id", "value"), "high": F.col("value") > 50, "day": F.to_date("ts")}))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def guarded_sql(t):
    t.nation.createOrReplaceTempView("tablewise_nation")
    return staging.guarded_sql(t.spark, "SELECT n_nationkey, n_name FROM tablewise_nation WHERE n_regionkey = 1")


@query("SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM orders) AS total_rows FROM orders ORDER BY o_orderkey LIMIT 100")
def table_preview(t):
    rows, total = staging.preview(t.orders.select("o_orderkey", "o_orderstatus").orderBy("o_orderkey"))
    return rows.withColumn("total_rows", F.lit(total).cast("bigint"))


@query("SELECT event_id, user_id FROM events WHERE event_id % 50 = 0 ORDER BY event_id LIMIT 20")
def null_drilldown(t):
    return staging.null_rows(with_null_values(t.events).orderBy("event_id"), "value").select("event_id", "user_id")


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def equality_filters(t):
    return staging.matching(t.orders, {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT count(*) AS pairs FROM events WHERE event_id % 50 <> 0 AND ts IS NOT NULL AND value IS NOT NULL")
def filled_pairs(t):
    return staging.filled_pairs(with_null_values(t.events), "ts", "value").agg(F.count(F.lit(1)).alias("pairs"))


@query("""SELECT * FROM (VALUES ('time', 'l_shipdate'), ('metric', 'l_discount'), ('metric', 'l_extendedprice'), ('metric', 'l_linenumber'), ('metric', 'l_orderkey'), ('metric', 'l_partkey'), ('metric', 'l_quantity'), ('metric', 'l_suppkey'), ('metric', 'l_tax')) v(kind, "column")""")
def column_picks(t):
    rows = [("time", c) for c in staging.time_columns(t.lineitem)] + [("metric", c) for c in staging.metric_columns(t.lineitem)]
    return t.spark.createDataFrame(rows, "kind string, column string")


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day FROM orders GROUP BY o_orderpriority")
def csv_folder(t):
    folder = scratch(t.spark)
    t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice", F.to_date("o_orderdate").alias("o_orderdate")).write.option("header", True).csv(f"{folder}/orders.csv")
    read = files.load_folder(t.spark, folder, "csv", "tablewise_csv_")["orders"]
    return read.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderdate").cast("date").cast("string").alias("first_day"))


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_mktsegment")
def ndjson_folder(t):
    folder = scratch(t.spark)
    t.customer.write.json(f"{folder}/customer.json")
    read = files.load_folder(t.spark, folder, "ndjson", "tablewise_json_")["customer"]
    return read.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT p_brand, count(*) AS n, max(CAST(p_size AS VARCHAR)) AS size_text FROM part GROUP BY p_brand")
def csv_as_text(t):
    path = f"{scratch(t.spark)}/part.csv"
    t.part.write.option("header", True).csv(path)
    return files.read_csv_as_text(t.spark, path).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.max("p_size").alias("size_text"))


@query("""WITH x AS (SELECT *, CASE WHEN p_partkey % 101 = 0 THEN 'line' WHEN p_partkey % 97 = 0 THEN 'value' ELSE 'none' END AS odd FROM part)
SELECT odd, CASE WHEN odd <> 'line' THEN p_brand END AS p_brand, count(*) AS n, CAST(sum(CASE WHEN odd <> 'line' THEN p_partkey END) AS BIGINT) AS keys, CAST(sum(CASE WHEN odd = 'none' THEN p_size END) AS BIGINT) AS sizes,
sum(CASE WHEN odd = 'value' THEN p_size ELSE 0 END) AS rescued_sizes, round(sum(CASE WHEN odd <> 'line' THEN p_retailprice END), 2) AS price, 'bigint,string,string,bigint,double,string' AS types FROM x GROUP BY 1, 2""")
def csv_rescued(t):
    """Some sizes of the file are words, and some lines have a quote that is never closed."""
    path, line = f"{scratch(t.spark)}/part.csv", F.col("p_partkey") % 101 == 0
    name = F.when(line, F.concat(F.lit('"'), "p_name")).otherwise(F.col("p_name"))
    size = F.when(F.col("p_partkey") % 97 == 0, F.concat(F.lit("about "), "p_size")).otherwise(F.col("p_size").cast("string"))
    t.part.select("p_partkey", name.alias("p_name"), "p_brand", size.alias("p_size"), "p_retailprice").write.option("header", True).option("quote", "").csv(path)
    read = files.read_csv_rescued(t.spark, path)
    odd = F.when(F.get_json_object("_rescued", "$._line").isNotNull(), "line").when(F.get_json_object("_rescued", "$.p_size").isNotNull(), "value").otherwise("none")
    words = F.regexp_extract(F.get_json_object("_rescued", "$.p_size"), "([0-9]+)", 1).cast("bigint")
    types = F.lit(",".join(f.dataType.simpleString() for f in read.schema))
    return read.groupBy(odd.alias("odd"), "p_brand").agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("keys"), F.sum("p_size").alias("sizes"), F.coalesce(F.sum(words), F.lit(0)).alias("rescued_sizes"), F.round(F.sum("p_retailprice"), 2).alias("price")).withColumn("types", types)


@query("SELECT event_id, user_id FROM events ORDER BY md5(CAST(event_id AS VARCHAR) || ':42'), event_id LIMIT 1000")
def uniform_sample(t):
    return files.sample_exact(t.events, 1000, "event_id").select("event_id", "user_id")


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_returnflag")
def materialized_model(t):
    sinks.ensure_database(t.spark, "tablewise_marts")
    model = t.lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    name = f"tablewise_marts.flags_{abs(hash(t.folder))}"
    outcome = sinks.materialize(model, name)
    if not outcome.success or not sinks.table_exists(t.spark, name):
        raise RuntimeError(outcome.error)
    return t.spark.table(name)


@query("\nUNION ALL\n".join(f"SELECT '{n}' AS \"table\", (SELECT count(*) FROM {n}) AS row_count, (SELECT count(*) FROM (DESCRIBE {n})) AS columns" for n in TPCH))
def lake_catalog(t):
    return sinks.catalog(t.many(*TPCH)).groupBy("table").agg(F.max("row_count").alias("row_count"), F.count(F.lit(1)).alias("columns"))


# A database: what it lists and aggregates must be what the tables hold --------------------------------

IN_DATABASE = ("nation", "supplier", "customer", "part", "orders")


def _database(t, schema: str, *names: str) -> jdbc.Database:
    """The database of the session's ``tablewise.jdbc.url``, or else Derby in memory, which only
    local mode can reach; tables are written to the schema."""
    url = t.spark.conf.get("tablewise.jdbc.url", None)
    if url is None:
        if not t.spark.sparkContext.master.startswith("local["):
            raise ValueError("tablewise.jdbc.url must name a database that the driver and all executors reach")
        url = "jdbc:derby:memory:tablewise;create=true"
    database = jdbc.Database(url)
    jdbc.attach(t.spark, "tablewise_db", database)
    jdbc.ensure_schema(t.spark, "tablewise_db", schema)
    for name in names:
        jdbc.write(getattr(t, name), database, jdbc.qualified(schema, name))
    return database


@query(union_sql(lambda n: f"""SELECT '{n}' AS table_name, column_name, CAST(ordinal_position AS INTEGER) AS position, (SELECT count(*) FROM {n}) AS row_count
FROM information_schema.columns WHERE table_name = '{n}'""", IN_DATABASE))
def jdbc_tables(t):
    """Tables and columns that the database lists, with the rows that it counts."""
    database = _database(t, "LISTED", *IN_DATABASE)
    listed = jdbc.list_columns(t.spark, database).where("schema_name = 'LISTED'").select("table_name", "column_name", "position")
    counts = [database.query(t.spark, f"SELECT COUNT(*) AS n FROM {jdbc.qualified(s, n)}").select(F.lit(n).alias("table_name"), F.col("n").cast("bigint").alias("row_count")) for s, n in jdbc.list_tables(t.spark, database) if s == "LISTED"]
    return listed.join(reduce(DataFrame.unionByName, counts), "table_name")


def _pushed_sql(table: str, c: str) -> str:
    return f"""SELECT '{table}' AS table_name, '{c}' AS "column", count(*) AS row_count, count({c}) AS non_null, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count,
       CAST(try_cast(min({c}) AS DOUBLE) AS DOUBLE) AS min_value, CAST(try_cast(max({c}) AS DOUBLE) AS DOUBLE) AS max_value FROM {table}"""


@query("\nUNION ALL\n".join(_pushed_sql(n, c) for n, c in (("orders", "o_orderkey"), ("orders", "o_custkey"), ("orders", "o_totalprice"), ("customer", "c_custkey"), ("customer", "c_nationkey"), ("customer", "c_acctbal"))))
def pushed_down_profile(t):
    """Profiles that the database computes, of numbers; texts and times are profiled in jdbc_text_profile."""
    found = jdbc.profile_all(t.spark, _database(t, "PROFILED", "orders", "customer")).where("schema_name = 'PROFILED'")
    return found.where(F.col("column").isin("o_orderkey", "o_custkey", "o_totalprice", "c_custkey", "c_nationkey", "c_acctbal")).withColumns({c: F.col(c).cast("double") for c in ("min_value", "max_value")}).drop("schema_name")


@query("\nUNION ALL\n".join(f"""SELECT '{c}' AS "column", count({c}) AS non_null, count(DISTINCT {c}) AS distinct_count, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM orders""" for c in ("o_orderstatus", "o_orderpriority", "o_orderdate")))
def jdbc_text_profile(t):
    database = _database(t, "TEXTS", "orders")
    found = jdbc.profile(t.spark, database, jdbc.qualified("TEXTS", "orders")).where(F.col("column").isin("o_orderstatus", "o_orderpriority", "o_orderdate"))
    return found.select("column", "non_null", "distinct_count", "min_value", "max_value")


@query("SELECT least(count(*), 10000) AS sampled, least(count(*), 10000) AS known FROM orders")
def jdbc_sample(t):
    """How many rows the sample has, and how many different ones of them the table has."""
    database = _database(t, "SAMPLED", "orders")
    sample = jdbc.sample(t.spark, database, jdbc.qualified("SAMPLED", "orders"))
    known = sample.join(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey", "o_custkey", "o_totalprice"], "left_semi").distinct()
    return sample.agg(F.count(F.lit(1)).alias("sampled")).crossJoin(known.agg(F.count(F.lit(1)).alias("known")))


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")
def jdbc_append(t):
    """Half the table created and half appended, read back in ranges of the key."""
    database, name = _database(t, "APPENDED"), jdbc.qualified("APPENDED", "orders")
    half = F.col("o_orderkey") % 2 == 0
    jdbc.write(t.orders.where(half), database, name)
    jdbc.write(t.orders.where(~half), database, name, append=True)
    back = jdbc.read(t.spark, database, name, key="o_orderkey", rows=1_000)
    return back.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderstatus, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders WHERE o_custkey > 20 GROUP BY o_orderstatus")
def jdbc_pushed_groups(t):
    """A filter and a grouped aggregate over the attached database, run by the database."""
    _database(t, "GROUPED", "orders")
    orders = t.spark.table("tablewise_db.GROUPED.orders").where("o_custkey > 20")
    return orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


# Marts and metric queries -------------------------------------------------------------------------


@query("SELECT period, round(avg_o_totalprice, 4) AS avg_o_totalprice, row_count, lag(row_count) OVER (ORDER BY period) AS prev_row_count FROM (SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS period, avg(o_totalprice) AS avg_o_totalprice, count(*) AS row_count FROM orders GROUP BY 1)")
def mart_period(t):
    return marts.period_comparison(t.orders, "o_orderdate", ["o_totalprice"]).withColumn("avg_o_totalprice", F.round("avg_o_totalprice", 4))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, round(avg(o_totalprice), 4) AS avg_o_totalprice, round(sum(o_totalprice), 4) AS sum_o_totalprice, count(*) AS row_count FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def mart_entity(t):
    got = marts.entity_summary(t.orders, t.customer, "o_custkey", "c_custkey", ["o_totalprice"])
    return got.withColumns({c: F.round(c, 4) for c in ("avg_o_totalprice", "sum_o_totalprice")})


@query("SELECT " + ", ".join(f"round(avg({c}), 6) AS avg_{c}, min({c}) AS min_{c}, max({c}) AS max_{c}" for c in LINE_NUMBERS[4:]) + ", count(*) AS row_count FROM lineitem")
def mart_summary(t):
    got = marts.whole_summary(t.lineitem, LINE_NUMBERS[4:])
    return got.withColumns({f"avg_{c}": F.round(f"avg_{c}", 6) for c in LINE_NUMBERS[4:]})


@query(f"""WITH s AS (SELECT "table", count(*) FILTER (role = 'temporal') AS times, count(*) FILTER (role = 'metric') AS metrics, max(row_count) AS rows FROM ({_ROLES}) GROUP BY 1),
e AS (SELECT * FROM ({_fk_sql()}) WHERE n_matched / n_distinct >= 0.5), l AS (SELECT "table", count(*) AS edges, sum(p) AS parents FROM (SELECT from_table AS "table", 1 AS p FROM e UNION ALL SELECT to_table, 0 FROM e) GROUP BY 1),
x AS (SELECT s.*, coalesce(edges, 0) AS edges, coalesce(parents, 0) AS parents FROM s LEFT JOIN l USING ("table"))
SELECT "table", 'period_comparison' AS archetype FROM x WHERE times > 0 UNION ALL SELECT "table", 'entity_summary' FROM x WHERE metrics > 0 AND parents > 0 AND (edges >= 2 OR metrics >= 1) AND rows >= 100
UNION ALL SELECT "table", 'aggregation' FROM x WHERE metrics >= 2 AND edges = 0 AND rows >= 100""")
def mart_archetypes(t):
    tables = t.many(*TPCH)
    return marts.archetypes(_typed(t, TPCH), relate.detect(tables, KEYS, prefixed=True))


@query("SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS revenue, count(*) AS orders FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL")
def metric_by_dim(t):
    got = metrics.metric_by(t.orders.where("o_orderstatus <> 'P'"), [Metric("revenue", "o_totalprice", "sum"), Metric("orders")], ["o_orderstatus", "o_orderpriority"])
    return got.withColumn("revenue", F.round("revenue", 2))


@query("SELECT event_type, count(value) AS n_count, round(sum(value), 4) AS n_sum, round(avg(value), 6) AS n_avg, min(value) AS n_min, max(value) AS n_max, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type")
def metric_aggregates(t):
    kinds = [Metric(f"n_{k}", "value", k) for k in ("count", "sum", "avg", "min", "max")] + [Metric("n_users", "user_id", "count_distinct")]
    return metrics.metric_by(t.events, kinds, ["event_type"]).withColumns({"n_sum": F.round("n_sum", 4), "n_avg": F.round("n_avg", 6)})


_NAMED = {"total_amount": "value", "num_orders": "user_id", "error_rate": "value", "lowest_min": "value", "highest_max": "value", "sum_paid": "value", "plain": "value"}


@query("SELECT event_type, round(sum(value), 4) AS total_amount, count(user_id) AS num_orders, round(avg(value), 6) AS error_rate, min(value) AS lowest_min, max(value) AS highest_max, round(sum(value), 4) AS sum_paid, round(avg(value), 6) AS plain FROM events GROUP BY event_type")
def aggregates_by_name(t):
    rows = t.events.select("event_type", *[F.col(c).alias(n) for n, c in _NAMED.items()])
    got = metrics.metric_by(rows, [Metric(n, n, metrics.aggregate_for(n)) for n in _NAMED], ["event_type"])
    return got.withColumns({n: F.round(n, digits) for n, digits in (("total_amount", 4), ("sum_paid", 4), ("error_rate", 6), ("plain", 6))})


@query("SELECT l_shipdate_year, round(count(returned) * 1.0 / count(*), 6) AS return_share FROM (SELECT year(l_shipdate) AS l_shipdate_year, CASE WHEN l_returnflag = 'R' THEN 1 END AS returned FROM lineitem) GROUP BY 1")
def ratio_metric(t):
    rows = t.lineitem.select(F.year("l_shipdate").cast("bigint").alias("l_shipdate_year"), F.when(F.col("l_returnflag") == "R", 1).alias("returned"))
    got = metrics.metric_by(rows, [metrics.ratio("return_share", "count(returned)", "count(*)")], ["l_shipdate_year"])
    return got.withColumn("return_share", F.round("return_share", 6))


@query("SELECT event_type, round(avg(value), 2) AS avg_value, count(*) AS row_count FROM events GROUP BY event_type")
def breakdown(t):
    return metrics.breakdown(t.events, "event_type", "value")


@query("SELECT user_id, round(avg(value), 2) AS avg_value, count(*) AS row_count FROM events GROUP BY user_id ORDER BY avg_value DESC, user_id LIMIT 15")
def top_n(t):
    return metrics.top_n(t.events, "user_id", "value")


@query("SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS period, o_orderpriority, round(avg(o_totalprice), 4) AS avg_o_totalprice, count(*) AS row_count FROM orders GROUP BY ALL")
def trend(t):
    return metrics.trend(t.orders, "o_orderdate", "o_totalprice", "o_orderpriority").withColumn("avg_o_totalprice", F.round("avg_o_totalprice", 4))


@query("SELECT strftime(ts, '%Y-%m-%d') AS period, round(avg(value), 6) AS avg_value, count(*) AS row_count FROM events GROUP BY 1 ORDER BY 1 LIMIT 100")
def daily_trend(t):
    return metrics.time_series(t.events, F.to_date("ts"), "value").select(F.col("period").cast("string").alias("period"), F.round("avg_value", 6).alias("avg_value"), "row_count")


@query("SELECT event_type, count(*) AS row_count FROM events GROUP BY event_type")
def count_by(t):
    return metrics.count_by(t.events, "event_type")


@query("SELECT min(l_extendedprice) AS min_value, max(l_extendedprice) AS max_value, round(avg(l_extendedprice), 2) AS avg_value, count(l_extendedprice) AS value_count FROM lineitem")
def distribution(t):
    return metrics.distribution(t.lineitem, "l_extendedprice")


@query("SELECT l_suppkey, count(*) AS row_count, round(avg(l_quantity), 2) AS avg_value, max(l_quantity) AS max_value FROM lineitem GROUP BY l_suppkey ORDER BY max_value DESC, l_suppkey LIMIT 20")
def extremes(t):
    return metrics.extremes(t.lineitem, "l_suppkey", "l_quantity")


@query("SELECT c_custkey, c_name, count(*) AS children, round(avg(o_totalprice), 4) AS avg_value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_name ORDER BY children DESC, c_custkey LIMIT 20")
def children_per_parent(t):
    return metrics.children_per_parent(t.orders, t.customer, "o_custkey", "c_custkey", "o_totalprice", ["c_name"]).withColumn("avg_value", F.round("avg_value", 4))


@query("SELECT c_mktsegment, count(*) AS row_count, round(avg(o_totalprice), 4) AS avg_value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment ORDER BY row_count DESC, c_mktsegment LIMIT 20")
def join_breakdown(t):
    return metrics.join_breakdown(t.orders, t.customer, "o_custkey", "c_custkey", "c_mktsegment", "o_totalprice").withColumn("avg_value", F.round("avg_value", 4))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1 ORDER BY n DESC, l_orderkey LIMIT 20")
def duplicates(t):
    return metrics.duplicates(t.lineitem, "l_orderkey")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def value_freq(t):
    return metrics.value_frequencies(t.part, "p_brand")


# Quality ------------------------------------------------------------------------------------------

_EVENT_RULES = [
    Rule("value_filled", "not_null", "value"), Rule("user_filled", "not_null", "user_id"), Rule("id_unique", "unique", "event_id"), Rule("value_unique", "unique", "value"),
    Rule("value_range", "range", "value", "value BETWEEN 0 AND 50", severity="warning"), Rule("types", "cardinality", "event_type", "event_type IN ('click', 'view')"),
    Rule("enough", "row_count", low=100), Rule("custom", "custom", expression="user_id > 0"), Rule("off", "not_null", "value", status="proposed"),
]
_EVENTS = "(SELECT event_id, user_id, event_type, CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END AS value FROM events)"
_CHECKS = f"""WITH e AS (SELECT * FROM {_EVENTS}), r AS (
SELECT 'value_filled' AS rule, 'not_null' AS kind, 'value' AS "column", 'error' AS severity, count(*) - count(value) AS observed FROM e UNION ALL
SELECT 'user_filled', 'not_null', 'user_id', 'error', count(*) - count(user_id) FROM e UNION ALL
SELECT 'id_unique', 'unique', 'event_id', 'error', count(*) - count(DISTINCT event_id) FROM e UNION ALL
SELECT 'value_unique', 'unique', 'value', 'error', count(*) - count(DISTINCT value) FROM e UNION ALL
SELECT 'value_range', 'range', 'value', 'warning', count(*) FILTER (NOT (value BETWEEN 0 AND 50)) FROM e UNION ALL
SELECT 'types', 'cardinality', 'event_type', 'error', count(*) FILTER (event_type NOT IN ('click', 'view')) FROM e UNION ALL
SELECT 'custom', 'custom', NULL, 'error', count(*) FILTER (NOT (user_id > 0)) FROM e)
SELECT *, observed = 0 AS passed FROM r UNION ALL SELECT 'enough', 'row_count', NULL, 'error', count(*), count(*) >= 100 FROM e"""


@query(_CHECKS)
def contracts_checked(t):
    return quality.check(with_null_values(t.events), _EVENT_RULES).drop("error")


@query(f"SELECT count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, CAST(0 AS BIGINT) AS skipped, round(count(*) FILTER (passed) * 100.0 / count(*), 1) AS pass_rate FROM ({_CHECKS})")
def quality_report(t):
    return quality.report(quality.check(with_null_values(t.events), _EVENT_RULES))


@query(f"""SELECT 'orders' AS "table", 'o_fk' AS rule, 'custom' AS kind, false AS passed UNION ALL SELECT 'orders', 'rows', 'row_count', (SELECT count(*) FROM orders) BETWEEN 1 AND 10 UNION ALL SELECT 'missing', 'any', 'not_null', false""")
def contracts_isolated(t):
    rules = {"orders": [Rule("o_fk", "custom", expression="no_such_column > 0"), Rule("rows", "row_count", low=1, high=10)], "missing": [Rule("any", "not_null", "x")]}
    return quality.check_tables({"orders": t.orders}, rules).select("table", "rule", "kind", "passed")


@query("SELECT 'orders_customer' AS rule, count(*) AS observed, count(DISTINCT o_custkey) AS orphan_values, count(*) = 0 AS passed FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)")
def referential_check(t):
    return quality.check_reference(t.orders, fewer_customers(t)["customer"], quality.Reference("orders_customer", "o_custkey", "customer", "c_custkey"))


_GEN = """WITH p AS ({profile}), r AS (
SELECT "column", 'not_null' AS rule_type, '`' || "column" || '` IS NOT NULL' AS expression, 0.95 AS confidence FROM p WHERE null_count = 0 AND distinct_count > 0 UNION ALL
SELECT "column", 'unique', '`' || "column" || '`', 0.9 FROM p WHERE uniqueness_ratio = 1 AND null_count = 0 AND distinct_count > 1 UNION ALL
SELECT "column", 'range', '`' || "column" || '` BETWEEN ' || CAST(CAST(round(CASE WHEN lo >= 0 THEN greatest(0.0, lo - abs(hi - lo) * 0.5) ELSE lo * 1.5 END, 2) AS DECIMAL(38, 2)) AS VARCHAR) || ' AND ' || CAST(CAST(round(hi + abs(hi - lo) * 0.5, 2) AS DECIMAL(38, 2)) AS VARCHAR), 0.8 FROM p WHERE lo IS NOT NULL UNION ALL
SELECT "column", 'cardinality', '`' || "column" || '` IN (' || vals || ')', 0.75 FROM p WHERE vals IS NOT NULL AND distinct_count <= 30)
SELECT "column", rule_type, expression, CAST(confidence AS DOUBLE) AS confidence FROM r"""


def _gen_profile() -> str:
    numbers, texts = ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"]
    head = lambda c: UNIVERSAL.format(c=c, t="orders")[7:].replace(" FROM orders", "")
    parts = [f"SELECT {head(c)}, CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, NULL AS vals FROM orders" for c in numbers]
    parts += [f"SELECT {head(c)}, NULL, NULL, (SELECT string_agg('''' || v || '''', ', ' ORDER BY n DESC, v) FROM (SELECT {c} AS v, count(*) AS n FROM orders GROUP BY 1)) FROM orders" for c in texts]
    parts.append(f"SELECT {head('o_orderdate')}, NULL, NULL, NULL FROM orders")
    return " UNION ALL ".join(parts)


@query(_GEN.format(profile=_gen_profile()))
def contracts_generated(t):
    found = profile.profile(t.orders, "orders")
    tops = profile.top_values(profile.frequencies(t.orders, ["o_orderstatus", "o_orderpriority"]))
    return quality.generate(found, tops).select("column", "rule_type", "expression", "confidence")


# Insights -----------------------------------------------------------------------------------------


@query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, count(*) AS n, round(corr(l_quantity, l_extendedprice), 8) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', count(*), round(corr(l_quantity, l_discount), 8) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', count(*), round(corr(l_extendedprice, l_discount), 8) FROM lineitem")
def correlations(t):
    return insights.correlations(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]).select("a", "b", "n", F.round("r", 8).alias("r"))


def _corr_sql(rows: str, names: list[str]) -> str:
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, corr({a}, {b}) AS r FROM {rows}" for a, b in pairs)


_LENGTHS = "(SELECT n_chars, length(text) AS text_length FROM documents)"
_LINE_RATES = "(SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross, l_tax FROM lineitem)"
#: With hundreds of rows and |r| of 0.6 or more, t is beyond 10 and p below 1e-20.
_STRONG = "SELECT a, b, n, round(r, 6) AS r, 0.0 AS p_value, CASE WHEN abs(r) >= 0.8 THEN 'strong' ELSE 'moderate' END AS strength, '99.9%' AS confidence FROM ({rows}) WHERE n >= 100 AND abs(r) >= 0.6 AND (abs(r) >= 1 OR abs(r) * sqrt((n - 2) / (1 - r * r)) > 6)"


@query(_STRONG.format(rows=_corr_sql(_LENGTHS, ["n_chars", "text_length"]) + " UNION ALL " + _corr_sql(_LINE_RATES, ["l_quantity", "l_extendedprice", "net", "gross", "l_tax"])))
def correlations_strong(t):
    chars = t.documents.select("n_chars", F.length("text").alias("text_length"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    lines = t.lineitem.select("l_quantity", "l_extendedprice", net.alias("net"), (net * (1 + F.col("l_tax"))).alias("gross"), "l_tax")
    found = insights.correlations(chars, ["n_chars", "text_length"]).unionByName(insights.correlations(lines, ["l_quantity", "l_extendedprice", "net", "gross", "l_tax"]))
    return insights.strong_correlations(found).select("a", "b", "n", F.round("r", 6).alias("r"), F.round("p_value", 6).alias("p_value"), "strength", "confidence")


_ROLLING = """WITH s AS (SELECT date_trunc('hour', ts) AS t, avg(value) AS value FROM events GROUP BY 1), n AS (SELECT count(*) AS n, greatest(5, CAST(floor(count(*) / 3) AS INTEGER)) AS w FROM s),
x AS (SELECT t, value, row_number() OVER (ORDER BY t) AS i FROM s),
y AS (SELECT a.t, a.i, any_value(a.value) AS value, avg(b.value) AS m, stddev_samp(b.value) AS d, any_value(n.w) AS w, any_value(n.n) AS n FROM x a, n JOIN x b ON b.i BETWEEN a.i - n.w + 1 AND a.i GROUP BY a.t, a.i),
z AS (SELECT *, (value - m) / nullif(d, 0) AS z FROM y WHERE i > w AND n >= 7),
f AS (SELECT * FROM z WHERE abs(z) >= 2)"""


def _hourly(t):
    return insights.series(t.events, F.date_trunc("hour", "ts").cast("timestamp_ntz"), ["value"])


@query(_ROLLING + " SELECT 'value' AS metric, CAST(t AS TIMESTAMP) AS t, round(value, 6) AS value, round(z, 5) AS z, round((value - m) * 100 / abs(nullif(m, 0)), 4) AS magnitude, CASE WHEN abs(z) >= 3 THEN 'critical' WHEN abs(z) >= 2.5 THEN 'warning' ELSE 'info' END AS severity FROM f")
def anomalies(t):
    return insights.anomalies(_hourly(t)).select("metric", "t", F.round("value", 6).alias("value"), F.round("z", 5).alias("z"), F.round("magnitude", 4).alias("magnitude"), "severity")


@query(_ROLLING + ", g AS (SELECT *, CAST(sign(z) AS INTEGER) AS sg, i - row_number() OVER (PARTITION BY sign(z) ORDER BY i) AS isl FROM f) SELECT 'value' AS metric, sg AS sign, CAST(min(t) AS TIMESTAMP) AS first_t, CAST(max(t) AS TIMESTAMP) AS last_t, count(*) AS periods, round(arg_max(z, i), 5) AS z FROM g GROUP BY sg, isl")
def anomaly_streaks(t):
    return insights.streaks(insights.anomalies(_hourly(t))).select("metric", "sign", "first_t", "last_t", "periods", F.round("z", 5).alias("z"))


@query("""WITH x AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_orderdate, o_orderkey, o_totalprice) AS i, count(*) OVER () AS n FROM orders),
h AS (SELECT count(*) FILTER (i <= n // 2) AS n1, count(*) FILTER (i > n // 2) AS n2, avg(v) FILTER (i <= n // 2) AS m1, avg(v) FILTER (i > n // 2) AS m2, var_samp(v) FILTER (i <= n // 2) AS v1, var_samp(v) FILTER (i > n // 2) AS v2 FROM x)
SELECT 'o_totalprice' AS metric, n1 AS n_early, n2 AS n_late, round(m1, 4) AS mean_early, round(m2, 4) AS mean_late, round((m2 - m1) / sqrt(v1 / n1 + v2 / n2), 5) AS t, round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 2) AS df FROM h""")
def period_shift_stats(t):
    got = insights.shift_statistics(insights.halves(t.orders, "o_orderdate", ["o_totalprice"], "o_orderkey"))
    return got.select("metric", "n_early", "n_late", F.round("mean_early", 4).alias("mean_early"), F.round("mean_late", 4).alias("mean_late"), F.round("t", 5).alias("t"), F.round("df", 2).alias("df"))


#: Critical values of the normal tail; with thousands of rows those of Student's t are the same.
_LABEL = "CASE WHEN {x} >= 3.29 THEN '99.9%' WHEN {x} >= 2.576 THEN '99%' WHEN {x} >= 1.96 THEN '95%' WHEN {x} >= 1.645 THEN '90%' ELSE 'low' END"
_LIFTED = "(SELECT event_id, user_id, ts, value + CASE WHEN epoch_us(ts) >= (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 FROM events) THEN 30 ELSE 0 END AS value FROM events)"
_SHIFTED = f"""x AS (SELECT value AS v, row_number() OVER (ORDER BY ts, event_id, value) AS i, count(*) OVER () AS n FROM {{rows}}),
h AS (SELECT count(*) FILTER (i <= n // 2) AS n1, count(*) FILTER (i > n // 2) AS n2, avg(v) FILTER (i <= n // 2) AS m1, avg(v) FILTER (i > n // 2) AS m2, var_samp(v) FILTER (i <= n // 2) AS v1, var_samp(v) FILTER (i > n // 2) AS v2 FROM x),
w AS (SELECT *, (m2 - m1) / sqrt(v1 / n1 + v2 / n2) AS t, (m2 - m1) * 100 / abs(m1) AS magnitude FROM h)"""
_SHIFT_ROWS = "round(magnitude, 4) AS magnitude, CASE WHEN abs(t) >= 3.29 THEN 'critical' WHEN abs(t) >= 2.576 THEN 'warning' ELSE 'info' END AS severity, " + _LABEL.format(x="abs(t)") + " AS confidence FROM w WHERE abs(t) >= 1.96"


@query("WITH " + _SHIFTED.format(rows=_LIFTED) + " SELECT 'value' AS metric, n1 AS n_early, n2 AS n_late, " + _SHIFT_ROWS)
def period_shifts(t):
    """Values that are raised by 30 from the middle of the time on."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = t.events.agg(F.min(at), F.max(at)).first()
    rows = t.events.withColumn("value", F.col("value") + F.when(at >= ((low or 0) + (high or 0)) // 2, 30).otherwise(0))
    got = insights.shifts(insights.halves(rows, "ts", ["value"], "event_id"))
    return got.select("metric", "n_early", "n_late", F.round("magnitude", 4).alias("magnitude"), "severity", "confidence")


_ROUGH = "SELECT '{t}' AS \"table\", '{kind}' AS kind, {metric} AS metric, {other} AS other, round({size}, 4) AS magnitude, round(p_value, 8) AS p_value, {level} AS severity, {label} AS confidence FROM ({rows})"
_OF_P = "CASE WHEN p_value < 0.001 THEN '99.9%' WHEN p_value < 0.01 THEN '99%' WHEN p_value < 0.05 THEN '95%' WHEN p_value < 0.1 THEN '90%' ELSE 'low' END"


def _tails_sql(x: str, density: str, factor: str) -> str:
    """Both tails beyond x of an even density: Simpson's rule with a thousand steps up to x, or 40."""
    return f"greatest(0.0, 1 - 2 * {factor} * least(abs({x}), 40.0) / 3000 * (SELECT sum((CASE WHEN k IN (0, 1000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * {density.format(u=f'(least(abs({x}), 40.0) * k / 1000)')}) FROM range(1001) g(k)))"


_NORMAL_P = _tails_sql("z", "exp(-{u} * {u} / 2)", "(1 / sqrt(2 * pi()))")
_T_P = _tails_sql("t", "pow(1 + {u} * {u} / df, -(df + 1) / 2)", "(exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()))")


def _anomalies_sql(table: str, time: str, metric: str) -> str:
    daily = _ROLLING.replace("date_trunc('hour', ts)", f"CAST({time} AS DATE)").replace("avg(value) AS value FROM events", f"avg({metric}) AS value FROM {table}")
    rows = daily + f""", g AS (SELECT *, CAST(sign(z) AS INTEGER) AS sg, i - row_number() OVER (PARTITION BY sign(z) ORDER BY i) AS isl FROM f),
a AS (SELECT arg_max(z, i) AS z, arg_max((value - m) * 100 / abs(nullif(m, 0)), i) AS size FROM g GROUP BY sg, isl) SELECT *, {_NORMAL_P} AS p_value FROM a"""
    return _ROUGH.format(t=table, kind="anomaly", metric=f"'{metric}'", other="NULL", size="size", level="CASE WHEN abs(z) >= 3 THEN 'critical' WHEN abs(z) >= 2.5 THEN 'warning' ELSE 'info' END", label=_LABEL.format(x="abs(z)"), rows=rows)


def _shifts_sql(table: str, time: str, key: str, metric: str) -> str:
    rows = "WITH " + _SHIFTED.format(rows=table).replace("value AS v", f"{metric} AS v").replace("ORDER BY ts, event_id, value", f"ORDER BY {time}, {key}, {metric}")
    rows += f", d AS (SELECT *, pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS df FROM w WHERE n1 >= 10 AND n2 >= 10) SELECT * FROM (SELECT *, {_T_P} AS p_value FROM d) WHERE p_value < 0.05"
    return _ROUGH.format(t=table, kind="shift", metric=f"'{metric}'", other="NULL", size="magnitude", level="CASE WHEN p_value < 0.001 THEN 'critical' WHEN p_value < 0.01 THEN 'warning' ELSE 'info' END", label=_OF_P, rows=rows)


def _tied_sql(table: str, rows: str, metrics: list[str]) -> str:
    found = f"SELECT *, {_T_P} AS p_value FROM (SELECT a, b, n, r, n - 2 AS df, CASE WHEN abs(r) >= 1 THEN 40.0 ELSE r * sqrt((n - 2) / (1 - r * r)) END AS t FROM ({_corr_sql(rows, metrics)}) WHERE n >= 10 AND abs(r) >= 0.6)"
    return _ROUGH.format(t=table, kind="correlation", metric="a", other="b", size="r", level="CASE WHEN abs(r) >= 0.8 THEN 'warning' ELSE 'info' END", label=_OF_P, rows=f"SELECT * FROM ({found}) WHERE p_value < 0.05")


#: Metrics of the tables that can have ten rows and more: numbers that are no ids.
MEASURED = {
    "nation": ["n_nationkey", "n_regionkey"],
    "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
    "supplier": ["s_suppkey", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
    "lineitem": LINE_NUMBERS,
    "events": ["value"],
    "documents": ["n_chars", "text_length"],
    "embeddings": ["label"],
    "labels": ["quality", "toxic"],
    "conversations": ["turn"],
}
#: Time and order of the rows of one time.
TIMED = {"orders": ("o_orderdate", "o_orderkey"), "lineitem": ("l_shipdate", "l_orderkey"), "events": ("ts", "event_id")}


def _insights_sql() -> str:
    parts = [x for t, (time, key) in TIMED.items() for m in MEASURED[t] for x in (_anomalies_sql(t, time, m), _shifts_sql(t, time, key, m))]
    parts += [_tied_sql(t, _LENGTHS if t == "documents" else t, names) for t, names in MEASURED.items() if len(names) > 1]
    return "\nUNION ALL\n".join(parts)


@query(_insights_sql())
def insights_all(t):
    """Every table, also those that have too few rows or no numbers and so no insights."""
    tables = t.many(*TPCH, "events", "embeddings", "pages", "benchmark", "labels", "conversations")
    tables["documents"] = t.documents.withColumn("text_length", F.length("text"))
    found = insights.detect(tables, {name: key for name, (_, key) in TIMED.items()})
    return found.select("table", "kind", "metric", "other", F.round("magnitude", 4).alias("magnitude"), F.round("p_value", 8).alias("p_value"), "severity", "confidence")


# Drift --------------------------------------------------------------------------------------------


def _versions(t) -> tuple[DataFrame, DataFrame]:
    """Two snapshots: customer loses a column, gets one and changes two; supplier goes, part comes."""
    old = stored(drift.snapshot(t.many("customer", "supplier", "nation"), 1))
    changed = t.customer.drop("c_name").withColumns({"c_acctbal": F.col("c_acctbal").cast("bigint").cast("string"), "c_since": F.lit("2024-01-01").cast("date"), "c_mktsegment": F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment"))})
    return old, stored(drift.snapshot({"customer": changed, "nation": t.nation, "part": t.part}, 2))


_CUSTOMER_2 = "(SELECT c_custkey, c_nationkey, CAST(trunc(c_acctbal) AS BIGINT)::VARCHAR AS c_acctbal, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS c_mktsegment, DATE '2024-01-01' AS c_since FROM customer)"


def _snapshot_sql(run: int, table: str, rows: str, columns: list[str]) -> str:
    """A snapshot's rows computed from the table: types, nulls and counts."""
    return union_sql(lambda c: f"SELECT {run} AS run_id, '{table}' AS \"table\", '{c}' AS \"column\", {_kind_sql(c, rows)} AS dtype, count({c}) < count(*) AS nullable, count(*) AS row_count, count({c}) AS filled FROM {rows}", columns)


_CUSTOMER_COLUMNS, _PARTS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
_BEFORE = f"b AS MATERIALIZED ({_snapshot_sql(1, 'customer', 'customer', _CUSTOMER_COLUMNS)} UNION ALL {_snapshot_sql(1, 'supplier', 'supplier', ['s_suppkey', 's_name', 's_nationkey', 's_acctbal'])} UNION ALL {_snapshot_sql(1, 'nation', 'nation', ['n_nationkey', 'n_name', 'n_regionkey'])})"
_AFTER = f"a AS MATERIALIZED ({_snapshot_sql(2, 'customer', _CUSTOMER_2, ['c_custkey', 'c_nationkey', 'c_acctbal', 'c_mktsegment', 'c_since'])} UNION ALL {_snapshot_sql(2, 'nation', 'nation', ['n_nationkey', 'n_name', 'n_regionkey'])} UNION ALL {_snapshot_sql(2, 'part', 'part', _PARTS)})"
_DRIFT = f"""WITH {_BEFORE}, {_AFTER}, tables AS (SELECT DISTINCT "table", 'added' AS change FROM a WHERE "table" NOT IN (SELECT "table" FROM b) UNION ALL SELECT DISTINCT "table", 'removed' FROM b WHERE "table" NOT IN (SELECT "table" FROM a)),
j AS (SELECT coalesce(b."table", a."table") AS "table", coalesce(b."column", a."column") AS "column", b.dtype AS bd, a.dtype AS ad, b.nullable AS bn, a.nullable AS an FROM (SELECT * FROM b WHERE "table" IN (SELECT "table" FROM a)) b FULL JOIN (SELECT * FROM a WHERE "table" IN (SELECT "table" FROM b)) a ON a."table" = b."table" AND a."column" = b."column"),
columns AS (SELECT "table", "column", 'added' AS change, NULL AS before, ad AS after FROM j WHERE bd IS NULL UNION ALL SELECT "table", "column", 'removed', bd, NULL FROM j WHERE ad IS NULL UNION ALL SELECT "table", "column", 'type_changed', bd, ad FROM j WHERE bd <> ad UNION ALL SELECT "table", "column", 'nullability_changed', CAST(bn AS VARCHAR), CAST(an AS VARCHAR) FROM j WHERE bn <> an)"""


def _fingerprint_sql(table: str, c: str) -> str:
    """Sums of digests of a column's values, with the name of both."""
    text = f"CASE typeof({c}) WHEN 'DOUBLE' THEN CAST(CAST(round(TRY_CAST({c} AS DOUBLE) * 100) AS HUGEINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"
    return f"""SELECT '{table}' AS "table", '{c}' AS "column", CAST(coalesce(sum(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)), 0) AS VARCHAR) AS fingerprint FROM {table}"""


_FINGERPRINTS = "\nUNION ALL\n".join(_fingerprint_sql(n, c) for n, names in (("customer", _CUSTOMER_COLUMNS), ("supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]), ("nation", ["n_nationkey", "n_name", "n_regionkey"])) for c in names)


@query(f"""WITH {_BEFORE}, f AS ({_FINGERPRINTS}) SELECT b.*, fingerprint FROM b JOIN f USING ("table", "column")""")
def schema_snapshot(t):
    """The snapshot of the first run, with fingerprints that any engine can compute."""
    found = _versions(t)[0].drop("fingerprint", "table_digest")
    return found.join(F.broadcast(drift.text_fingerprints(t.many("customer", "supplier", "nation"))), ["table", "column"]).select(*found.columns, "fingerprint")


@query(_DRIFT + ' SELECT "table", "column", change, before, after FROM columns')
def schema_diff(t):
    return drift.column_changes(*_versions(t))


@query(_DRIFT + ' SELECT "table", change FROM tables')
def table_changes(t):
    return drift.table_changes(*_versions(t))


@query(f"""SELECT CAST(1 AS BIGINT) AS added, CAST(1 AS BIGINT) AS removed, count(*) FILTER (d > 0) AS updated, count(*) FILTER (d = 0) AS unchanged FROM (
SELECT 1 AS d UNION ALL SELECT (SELECT count(*) FROM (SELECT * FROM nation EXCEPT ALL SELECT * FROM nation)))""")
def rerun_summary(t):
    """Customer gets and loses a column, so it is changed; nation is not; supplier goes and part comes."""
    return drift.rerun_summary(*_versions(t))


_MOVED = "(SELECT c_custkey, c_name, c_nationkey, c_acctbal + CASE WHEN c_custkey % 50 = 0 THEN 0.001 ELSE 0 END AS c_acctbal, c_mktsegment FROM customer)"
_SWAPPED = "(SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, coalesce(p.o_totalprice, o.o_totalprice) AS o_totalprice, o.o_orderdate, o.o_orderpriority FROM orders o LEFT JOIN orders p ON p.o_orderkey = xor(o.o_orderkey, 1) AND o.o_orderkey % 100 < 2)"
_MARKED = "(SELECT * FROM part ORDER BY p_partkey DESC)"
_RERUN = (("customer", _MOVED), ("orders", _SWAPPED), ("part", _MARKED))


def _rerun(t) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Balances moved by 0.001, prices swapped between neighbours, and rows in another order."""
    moved = t.customer.withColumn("c_acctbal", F.col("c_acctbal") + F.when(F.col("c_custkey") % 50 == 0, 0.001).otherwise(0))
    other = t.orders.select(F.col("o_orderkey").bitwiseXOR(F.lit(1)).alias("o_orderkey"), F.col("o_totalprice").alias("other"))
    pairs = t.orders.join(other.where((F.col("o_orderkey") % 100) < 2), "o_orderkey", "left")
    swapped = pairs.withColumn("o_totalprice", F.coalesce("other", "o_totalprice")).select(*t.orders.columns)
    return t.many("customer", "orders", "part"), {"customer": moved, "orders": swapped, "part": t.part.orderBy(F.col("p_partkey").desc())}


@query("\nUNION ALL\n".join(f"""SELECT '{n}' AS "table", CASE WHEN (SELECT count(*) FROM (SELECT * FROM {rows} EXCEPT ALL SELECT * FROM {n})) > 0 THEN 'updated' ELSE 'unchanged' END AS change""" for n, rows in _RERUN))
def rerun_tables(t):
    """What a second run finds of three tables, each summed up by itself."""
    old, new = _rerun(t)
    parts = []
    for name in old:
        got = drift.rerun_summary(drift.snapshot({name: old[name]}, 1), drift.snapshot({name: new[name]}, 2))
        parts.append(got.select(F.lit(name).alias("table"), F.when(F.col("updated") == 1, "updated").when(F.col("unchanged") == 1, "unchanged").alias("change")))
    return reduce(DataFrame.unionByName, parts)


_BUCKET = "CAST(CAST('0x' || substr(md5(CAST({k} AS VARCHAR)), 1, 8) AS BIGINT) % 1024 AS INTEGER)"


@query("\nUNION ALL\n".join(f"""SELECT '{n}' AS "table", bucket, CAST(count(*) AS BIGINT) AS rows_before, CAST(count(*) AS BIGINT) AS rows_after FROM (SELECT {_BUCKET.format(k=k)} AS bucket FROM {n})
WHERE bucket IN (SELECT {_BUCKET.format(k=k)} FROM (SELECT * FROM {rows} EXCEPT ALL SELECT * FROM {n})) GROUP BY ALL""" for (n, rows), k in zip(_RERUN, ("c_custkey", "o_orderkey", "p_partkey"))))
def changed_buckets(t):
    old, new = _rerun(t)
    keys = {"customer": ["c_custkey"], "orders": ["o_orderkey"], "part": ["p_partkey"]}
    return drift.changed_buckets(stored(drift.digest_tree(old, keys)), stored(drift.digest_tree(new, keys)))


@query(f"""SELECT c_custkey, 'updated' AS change FROM (SELECT * FROM {_MOVED} EXCEPT ALL SELECT * FROM customer) WHERE c_custkey >= 100
UNION ALL SELECT c_custkey, 'removed' FROM customer WHERE c_custkey < 100 UNION ALL SELECT c_custkey + 10000000, 'added' FROM customer WHERE c_custkey < 100""")
def changed_rows(t):
    """Balances moved, and keys below 100 that become others."""
    moved = _rerun(t)[1]["customer"].withColumn("c_custkey", F.col("c_custkey") + F.when(F.col("c_custkey") < 100, 10_000_000).otherwise(0))
    return drift.changed_rows(t.customer, moved, ["c_custkey"])


@query(_DRIFT + """ SELECT 'first' AS run, true AS first_run, (SELECT count(DISTINCT "table") FROM b) AS tables_added, CAST(0 AS BIGINT) AS tables_removed, CAST(0 AS BIGINT) AS column_changes, false AS no_changes UNION ALL SELECT 'same', false, 0, 0, 0, true
UNION ALL SELECT 'next', false, count(*) FILTER (change = 'added'), count(*) FILTER (change = 'removed'), (SELECT count(*) FROM columns), count(*) + (SELECT count(*) FROM columns) = 0 FROM tables""")
def drift_overview(t):
    old, new = _versions(t)
    runs = {"first": drift.overview(old.where("run_id < 0"), old), "same": drift.overview(old, old), "next": drift.overview(old, new)}
    return reduce(DataFrame.unionByName, [df.withColumn("run", F.lit(n)) for n, df in runs.items()])


@query(f"WITH {_BEFORE}, {_AFTER}, s AS (SELECT * FROM b UNION ALL SELECT * FROM a) SELECT \"table\", count(*) AS columns, sum(row_count) AS cells FROM s WHERE run_id = (SELECT max(run_id) FROM s WHERE run_id < 2) GROUP BY 1")
def latest_snapshot(t):
    old, new = _versions(t)
    return drift.latest_before(old.unionByName(new), 2).groupBy("table").agg(F.count(F.lit(1)).alias("columns"), F.sum("row_count").alias("cells"))


_OLD_CUSTOMERS = "(SELECT c_custkey, c_name, c_acctbal, c_custkey % 5 = 0 AS locked, CASE WHEN c_custkey % 7 = 0 THEN 1 END AS removed FROM customer)"
_NEW_CUSTOMERS = "(SELECT c_custkey + 50 AS c_custkey, 'new ' || c_name AS c_name, c_acctbal + 1 AS c_acctbal FROM customer)"


def _customers(t) -> tuple[DataFrame, DataFrame]:
    """All customers with locks and removal marks, and all of them again under keys further on."""
    old = t.customer.selectExpr("c_custkey", "c_name", "c_acctbal", "c_custkey % 5 = 0 AS locked", "CASE WHEN c_custkey % 7 = 0 THEN 1L END AS removed")
    new = t.customer.selectExpr("c_custkey + 50 AS c_custkey", "concat('new ', c_name) AS c_name", "c_acctbal + 1 AS c_acctbal")
    return old, new


@query(f"""SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NULL OR coalesce(o.locked, false) THEN o.c_name ELSE n.c_name END AS c_name, round(CASE WHEN n.c_custkey IS NULL THEN o.c_acctbal ELSE n.c_acctbal END, 4) AS c_acctbal,
coalesce(o.locked, false) AS locked, CAST(CASE WHEN n.c_custkey IS NULL THEN o.removed END AS BIGINT) AS removed FROM {_OLD_CUSTOMERS} o FULL JOIN {_NEW_CUSTOMERS} n ON o.c_custkey = n.c_custkey""")
def locked_upsert(t):
    return drift.locked_upsert(*_customers(t), ["c_custkey"], ["c_name"], removed="removed").withColumn("c_acctbal", F.round("c_acctbal", 4))


@query(f"SELECT c_custkey, CAST(CASE WHEN removed IS NOT NULL THEN removed WHEN c_custkey NOT IN (SELECT c_custkey FROM {_NEW_CUSTOMERS}) THEN 9 END AS BIGINT) AS removed FROM {_OLD_CUSTOMERS}")
def soft_delete(t):
    old, new = _customers(t)
    return drift.soft_delete(old, new, "c_custkey", 9, "removed").select("c_custkey", "removed")


_TOUCHED = "(SELECT c_custkey + 50 AS c_custkey, 'new ' || c_name AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_nationkey = 3)"


@query(f"""SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NULL OR coalesce(o.locked, false) THEN o.c_name ELSE n.c_name END AS c_name, round(CASE WHEN n.c_custkey IS NULL THEN o.c_acctbal ELSE n.c_acctbal END, 4) AS c_acctbal,
coalesce(o.locked, false) AS locked, CAST(CASE WHEN n.c_custkey IS NULL THEN coalesce(o.removed, CASE WHEN o.c_custkey % 10 = 0 THEN 9 END) WHEN coalesce(o.c_custkey, n.c_custkey) % 10 = 0 THEN 9 END AS BIGINT) AS removed FROM {_OLD_CUSTOMERS} o FULL JOIN {_TOUCHED} n ON o.c_custkey = n.c_custkey""")
def bucketed_upsert(t):
    """Customers of one nation over a bucketed table of all, and then every tenth key gone."""
    old, new = _customers(t)
    table = drift.BucketedTable(t.spark, scratch(t.spark), ["c_custkey"])
    table.create(old)
    table.upsert(new.join(t.customer.where("c_nationkey = 3").select((F.col("c_custkey") + 50).alias("c_custkey")), "c_custkey", "left_semi"), ["c_name"], removed="removed")
    table.soft_delete(table.read().where("c_custkey % 10 <> 0"), 9, "removed")
    return table.read().withColumn("c_acctbal", F.round("c_acctbal", 4))


@query(f"SELECT count(*) AS n FROM {_OLD_CUSTOMERS} WHERE removed IS NULL")
def active_rows(t):
    return drift.active(_customers(t)[0], "removed").agg(F.count(F.lit(1)).alias("n"))


# Graphs -------------------------------------------------------------------------------------------


def user_types(t) -> DataFrame:
    """Users as sources, event types as targets: an edge table that grows with the events."""
    return t.events.select(F.col("user_id").cast("string").alias("src"), F.col("event_type").alias("dst"))


@query("SELECT dst, count(*) AS degree FROM (SELECT DISTINCT user_id AS src, event_type AS dst FROM events) GROUP BY dst HAVING count(*) >= 2")
def hubs(t):
    return graph.hubs(user_types(t)).select("dst", "degree")


def table_edges(t) -> DataFrame:
    return relate.detect(fewer_customers(t), KEYS, prefixed=True, least=0.0).select(F.col("from_table").alias("src"), F.col("to_table").alias("dst"), "ref_integrity")


_EDGE_SQL = f"SELECT from_table AS src, to_table AS dst, n_matched / n_distinct AS ref_integrity FROM ({_fk_sql(**_FEWER)})"


@query(f"SELECT dst, count(*) AS degree FROM ({_EDGE_SQL}) GROUP BY dst HAVING count(DISTINCT src) >= 3")
def star_hubs(t):
    return graph.star_hubs(table_edges(t)).select("dst", "degree")


@query(f"""WITH RECURSIVE e AS ({_EDGE_SQL}), p AS (SELECT [src, dst] AS path, 1 AS hops FROM e UNION ALL SELECT list_append(path, e.dst), hops + 1 FROM p JOIN e ON path[-1] = e.src WHERE hops < 4 AND NOT list_contains(path, e.dst))
SELECT DISTINCT array_to_string(path, '>') AS path, hops FROM p WHERE hops >= 2""")
def chains(t):
    return graph.chains(table_edges(t)).select(F.array_join("path", ">").alias("path"), "hops")


@query(f"SELECT src, dst, round(ref_integrity, 6) AS ref_integrity FROM ({_EDGE_SQL}) WHERE ref_integrity < 0.9")
def weak_edges(t):
    return graph.weak_edges(table_edges(t), 0.9).select("src", "dst", F.round("ref_integrity", 6).alias("ref_integrity"))


_WAYS = f"e AS MATERIALIZED ({_EDGE_SQL})"


@query(f"""WITH RECURSIVE {_WAYS}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), p AS (SELECT ['lineitem'] AS path, 0 AS hops UNION ALL SELECT list_append(path, b.dst), hops + 1 FROM p JOIN b ON path[-1] = b.src WHERE hops < 3 AND NOT list_contains(path, b.dst))
SELECT array_to_string(path, '>') AS path, hops FROM p WHERE path[-1] = 'nation' ORDER BY hops, path LIMIT 1""")
def shortest_path(t):
    return graph.shortest_path(table_edges(t), "lineitem", "nation").select(F.array_join("path", ">").alias("path"), "hops")


@query(f"""WITH RECURSIVE {_WAYS}, p AS (SELECT ['nation'] AS path, 0 AS hops UNION ALL SELECT list_append(path, e.dst), hops + 1 FROM p JOIN e ON path[-1] = e.src WHERE hops < 3 AND NOT list_contains(path, e.dst)),
q AS (SELECT ['lineitem'] AS path, 0 AS hops UNION ALL SELECT list_append(path, e.dst), hops + 1 FROM q JOIN e ON path[-1] = e.src WHERE hops < 3 AND NOT list_contains(path, e.dst))
SELECT array_to_string(path, '>') AS path, hops FROM (SELECT *, 0 AS turn FROM p WHERE path[-1] = 'lineitem' UNION ALL SELECT *, 1 FROM q WHERE path[-1] = 'nation') ORDER BY turn, hops, path LIMIT 1""")
def directed_path(t):
    """There is no way from nation to lineitem along the edges, so the reverse one is given."""
    return graph.shortest_path(table_edges(t), "nation", "lineitem", directed=True).select(F.array_join("path", ">").alias("path"), "hops")


@query("""SELECT DISTINCT event_type AS dst, CAST(user_id AS VARCHAR) AS src FROM events WHERE event_type IN (SELECT event_type FROM events GROUP BY 1 HAVING count(DISTINCT user_id) >= 2)""")
def hub_sources(t):
    return graph.hub_sources(user_types(t))


@query("""WITH c AS (SELECT o_custkey, 'c' || o_custkey AS node, least('c' || o_custkey, min('o' || o_orderkey)) AS component FROM orders GROUP BY o_custkey)
SELECT node, component FROM c UNION ALL SELECT DISTINCT 'o' || o_orderkey, component FROM orders JOIN c USING (o_custkey)""")
def components(t):
    edges = t.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst"))
    return graph.components(edges)


_REACH = f"""e AS MATERIALIZED (SELECT from_table AS src, to_table AS dst FROM ({{fk}}) WHERE n_matched / n_distinct >= 0.5), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
r AS (SELECT src AS node, src AS other FROM b UNION SELECT node, dst FROM r JOIN b ON other = src), m AS (SELECT node, min(other) AS component FROM r GROUP BY 1),
z AS ({" UNION ALL ".join(f"SELECT '{n}' AS node, count(*) AS size FROM {n}" for n in TPCH)})"""


@query(f"""WITH RECURSIVE {_REACH.format(fk=_fk_sql())}
SELECT component, CASE WHEN count(*) > 1 AND min(string_split(node, '_')[1]) = max(string_split(node, '_')[1]) THEN min(string_split(node, '_')[1]) ELSE arg_max(node, struct_pack(s := size, n := node)) END AS label FROM m JOIN z USING (node) GROUP BY 1""")
def cluster_labels(t):
    edges = relate.detect(t.many(*TPCH), KEYS, prefixed=True).select(F.col("from_table").alias("src"), F.col("to_table").alias("dst"))
    sizes = sinks.catalog(t.many(*TPCH)).select(F.col("table").alias("node"), F.col("row_count").alias("size")).distinct()
    return graph.cluster_labels(graph.components(edges), sizes)


@query("""WITH x AS (SELECT DISTINCT event_type, user_id % 7 AS u, CAST(user_id AS VARCHAR) AS node FROM events), c AS (SELECT 'user_' || u AS component, count(DISTINCT 'user_' || node) AS members FROM x GROUP BY 1)
SELECT component, CASE WHEN members > 1 THEN 'user' ELSE (SELECT min('user_' || node) FROM x WHERE 'user_' || u = component) END AS label FROM c""")
def cluster_prefixes(t):
    """Users of one remainder as a cluster: all their names begin alike."""
    members = t.events.select(F.concat(F.lit("user_"), F.col("user_id") % 7).alias("component"), F.concat(F.lit("user_"), "user_id").alias("node")).distinct()
    return graph.cluster_labels(members, members.groupBy("node").agg(F.count(F.lit(1)).alias("size")))


@query("""WITH x AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS p FROM lineitem) SELECT a.k AS a, b.k AS b, CAST(count(*) AS INTEGER) AS shared FROM x a JOIN x b ON a.p = b.p AND a.k < b.k GROUP BY ALL HAVING count(*) >= 3""")
def kin_pairs(t):
    baskets = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    return graph.kin(baskets, "l_orderkey", "parts")


@query("""WITH RECURSIVE x AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS p FROM lineitem), s AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM x a JOIN x b ON a.p = b.p AND a.k < b.k GROUP BY ALL HAVING count(*) >= 2),
near AS (SELECT b AS k, list(a) AS smaller FROM s GROUP BY b), o AS MATERIALIZED (SELECT n.k, coalesce(smaller, CAST([] AS BIGINT[])) AS smaller, row_number() OVER (ORDER BY n.k) AS i FROM (SELECT a AS k FROM s UNION SELECT b FROM s) n LEFT JOIN near USING (k)),
walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS leaders UNION ALL SELECT o.i, CASE WHEN list_has_any(o.smaller, leaders) THEN leaders ELSE list_append(leaders, o.k) END FROM walk JOIN o ON o.i = walk.i + 1)
SELECT b AS item, min(a) AS leader FROM s JOIN (SELECT unnest(leaders) AS a FROM walk ORDER BY i DESC LIMIT (SELECT max(len(leaders)) FROM walk)) USING (a) GROUP BY b""")
def kin_groups(t):
    baskets = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    return graph.kin_groups(baskets, "l_orderkey", "parts", 2)


# Health -------------------------------------------------------------------------------------------


def _with_gaps(t) -> DataFrame:
    tables = t.many(*TPCH) | {"events": with_null_values(t.events)}
    return stored(reduce(DataFrame.unionByName, [profile.universal(profile.frequencies(df)).withColumn("table", F.lit(n)) for n, df in tables.items()]))


_ALL_EVENTS = "(SELECT * REPLACE (CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END AS value) FROM events)"
_GAPS = f"WITH p AS ({ALL_UNIVERSAL} UNION ALL " + union_sql(lambda c: f"SELECT 'events' AS \"table\", * FROM ({UNIVERSAL.format(c=c, t=_ALL_EVENTS)})", ["event_id", "ts", "user_id", "event_type", "value", "props"]) + ")"


@query(_GAPS + " SELECT count(DISTINCT \"table\") AS tables, CAST(sum(c) AS BIGINT) AS columns, CAST(sum(r) AS BIGINT) AS rows, CAST(sum(s) AS BIGINT) AS cells, round(least(100.0, (sum(s) - sum(n)) * 100.0 / sum(s)), 1) AS completeness FROM (SELECT \"table\", count(*) AS c, max(row_count) AS r, sum(row_count) AS s, sum(null_count) AS n FROM p GROUP BY 1)")
def overview(t):
    return health.overview(_with_gaps(t))


@query(_GAPS + f""", e AS ({_fk_sql()}), r AS (SELECT from_table AS "table", string_agg(from_column || '>' || to_table || '.' || to_column, ',' ORDER BY from_column || '>' || to_table || '.' || to_column) AS refs FROM e WHERE n_matched / n_distinct >= 0.5 GROUP BY 1)
SELECT "table", count(*) AS columns, max(row_count) AS rows, round(avg(null_rate), 4) AS mean_null_rate, round(least(100.0, (sum(row_count) - sum(null_count)) * 100.0 / sum(row_count)), 1) AS completeness, count(*) FILTER (null_count = 0 AND distinct_count = row_count) AS key_columns,
coalesce(string_agg("column", ',' ORDER BY "column") FILTER (null_count = 0 AND distinct_count = row_count), '') AS keys, coalesce(any_value(refs), '') AS "references", bool_or("table" IN (SELECT from_table FROM e UNION SELECT to_table FROM e)) AS has_relationships FROM p LEFT JOIN r USING ("table") GROUP BY 1""")
def table_health(t):
    edges = relate.detect(t.many(*TPCH), KEYS, prefixed=True)
    return health.table_health(_with_gaps(t), edges)


@query(_GAPS.replace("event_id % 50 = 0", "event_id % 10 = 0") + " SELECT \"table\", \"column\", 'high_nulls' AS issue, CASE WHEN null_rate > 0.2 THEN 'error' ELSE 'warning' END AS severity FROM p WHERE null_rate > 0.05 AND distinct_count > 0 UNION ALL SELECT \"table\", \"column\", 'constant_column', 'warning' FROM p WHERE distinct_count = 1 AND null_rate = 0 UNION ALL SELECT \"table\", \"column\", 'unexpected_uniqueness', 'info' FROM p WHERE uniqueness_ratio = 1 AND distinct_count > 1 AND NOT ends_with(\"column\", '_id') UNION ALL SELECT \"table\", \"column\", 'empty_column', 'error' FROM p WHERE distinct_count = 0 AND row_count > 0")
def column_issues(t):
    events = t.events.withColumn("value", F.when(F.col("event_id") % 10 != 0, F.col("value")))
    tables = t.many(*TPCH) | {"events": events}
    return health.column_issues(reduce(DataFrame.unionByName, [profile.universal(profile.frequencies(df)).withColumn("table", F.lit(n)) for n, df in tables.items()]))


@query(_GAPS + " SELECT \"table\", \"column\", null_rate FROM p WHERE null_rate > 0")
def null_ranking(t):
    return health.null_ranking(_with_gaps(t))


@query(_GAPS + " SELECT \"table\", \"column\", distinct_count FROM p WHERE uniqueness_ratio = 1 AND distinct_count > 1")
def unique_columns(t):
    return health.unique_columns(_with_gaps(t))


@query("SELECT * FROM (SELECT 'pages' AS \"table\", 'url' AS \"column\", 'url' AS detected_pattern) WHERE (SELECT count(*) FROM pages) > 0")
def pattern_listing(t):
    return health.pattern_listing(profile.profile_all(t.many("pages", "nation")))


@query("SELECT CASE WHEN \"table\" IN ('orders', 'lineitem') THEN 'sales' ELSE 'master' END AS domain, count(*) AS tables, CAST(sum(n) AS BIGINT) AS rows FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS n FROM {n}" for n in TPCH) + ") GROUP BY 1")
def domain_rollup(t):
    counts = sinks.catalog(t.many(*TPCH)).select("table", "row_count").distinct()
    return health.domain_rollup(counts.withColumn("domain", F.when(F.col("table").isin("orders", "lineitem"), F.lit("sales")).otherwise(F.lit("master"))))


_GOOD_FEWER = f"SELECT *, n_matched / n_distinct AS share FROM ({_fk_sql(**_FEWER)}) WHERE n_matched / n_distinct >= 0.5"


@query(_GAPS + f""", k AS (SELECT "table", bool_or(null_count = 0 AND distinct_count = row_count) AS has_key, count(*) FILTER (null_rate > 0.05) AS sparse, count(*) FILTER (distinct_count = 1) AS constant FROM p GROUP BY 1)
SELECT round(count(*) FILTER (has_key) * 100.0 / count(*), 1) AS key_coverage, CAST(sum(sparse) AS BIGINT) AS high_null_columns, CAST(sum(constant) AS BIGINT) AS constant_columns, (SELECT round(avg(n_matched / n_distinct) * 100, 1) FROM ({_fk_sql()})) AS mean_integrity, (SELECT round(count(*) FILTER (passed) * 100.0 / count(*), 1) FROM ({_CHECKS})) AS pass_rate FROM k""")
def data_profile(t):
    edges = relate.detect(t.many(*TPCH), KEYS, prefixed=True)
    return health.data_profile(_with_gaps(t), edges, quality.check(with_null_values(t.events), _EVENT_RULES))


@query(_GAPS + f""", h AS (SELECT "table", count(*) FILTER (null_count = 0 AND distinct_count = row_count) AS keys, round(avg(null_rate), 4) AS gaps FROM p GROUP BY 1), e AS ({_GOOD_FEWER})
SELECT 1 AS priority, 'failed_contract' AS kind, 'events' AS "table", "column" FROM ({_CHECKS}) WHERE NOT passed UNION ALL SELECT 2, 'weak_reference', from_table, from_column FROM e WHERE share < 0.95
UNION ALL SELECT 3, 'no_key', "table", NULL FROM h WHERE keys = 0 UNION ALL SELECT 4, 'high_nulls', "table", "column" FROM p WHERE null_rate > 0.05
UNION ALL SELECT 5, 'isolated_table', "table", NULL FROM h WHERE "table" NOT IN (SELECT from_table FROM e UNION SELECT to_table FROM e) UNION ALL SELECT 6, 'complete_table', "table", NULL FROM h WHERE gaps = 0""")
def findings(t):
    edges = relate.detect(fewer_customers(t), KEYS, prefixed=True)
    results = quality.check(with_null_values(t.events), _EVENT_RULES).withColumn("table", F.lit("events"))
    return health.findings(_with_gaps(t), edges, results)


@query(_GAPS + f" SELECT 'repeated_id' AS kind, \"table\", \"column\", round(uniqueness_ratio, 4) AS figure FROM p WHERE regexp_matches(\"column\", '(_id|key)$') AND uniqueness_ratio > 0 AND uniqueness_ratio < 1 UNION ALL SELECT 'weak_reference', from_table, from_column, round(n_matched / n_distinct, 4) FROM ({_fk_sql(**_FEWER)}) WHERE n_matched / n_distinct < 0.95 AND n_matched / n_distinct >= 0.5")
def dedup_suggestions(t):
    edges = relate.detect(fewer_customers(t), KEYS, prefixed=True)
    return health.dedup_suggestions(_with_gaps(t), edges).withColumn("figure", F.round("figure", 4))


_ACTIONS = {"column": ("description_accepted", "description_edited", "locked", "seen"), "model": ("edited", "edited", "locked", "edited"), "contract": ("false_positive", "true_positive", "acknowledged", "muted")}


def decisions(t) -> DataFrame:
    """Events read as a decision log: each is about a column, a model or a contract of one of two
    sources, and some payloads hold the value as an edit distance."""
    pick = lambda names, n: F.element_at(F.array(*[F.lit(a) for a in names]), (n + 1).cast("int"))
    kind = pick(list(_ACTIONS), F.col("event_id") % 3)
    action = F.coalesce(*[F.when(kind == k, pick(names, F.col("user_id") % 4)) for k, names in _ACTIONS.items()])
    artifact = F.when(kind == "contract", F.concat(F.lit("c"), F.col("event_id") % 100)).otherwise(F.concat(F.when(F.col("event_id") % 2 == 0, F.lit("shop.")).otherwise(F.lit("crm.")), "event_type"))
    payload = F.when(F.col("event_id") % 5 < 3, F.to_json(F.struct(F.col("value").alias("edit_distance")))).otherwise(F.lit("{}"))
    return t.events.select("event_id", kind.alias("artifact_type"), artifact.alias("artifact_id"), action.alias("action"), payload.alias("payload"))


def contracts_of(t) -> DataFrame:
    return t.events.select(F.concat(F.lit("c"), F.col("event_id") % 100).alias("id"), F.concat(F.when(F.col("event_id") % 100 < 60, F.lit("stg_shop_")).otherwise(F.lit("stg_crm_")), F.col("event_id") % 100).alias("model_name")).distinct()


_DECISIONS = f"""(SELECT *, CASE artifact_type WHEN 'contract' THEN 'c' || event_id % 100 ELSE CASE WHEN event_id % 2 = 0 THEN 'shop.' ELSE 'crm.' END || event_type END AS artifact_id, CASE artifact_type {" ".join(f"WHEN '{k}' THEN {list(v)}[user_id % 4 + 1]" for k, v in _ACTIONS.items())} END AS action FROM (SELECT *, ['column', 'model', 'contract'][event_id % 3 + 1] AS artifact_type FROM events))"""


def _by_source(function) -> DataFrame:
    """A rate over all sources, for one, and for one that nothing was decided for."""
    return reduce(DataFrame.unionByName, [function(s).withColumn("source", F.lit(s or "all")) for s in (None, "shop", "nothing")])


def _source_sql(figures: str, where: str, scope: Callable[[str], str]) -> str:
    return " UNION ALL ".join(f"SELECT {figures}, '{s}' AS source FROM {_DECISIONS} WHERE {where} AND {scope(s)}" for s in ("all", "shop", "nothing"))


_DECIDED = "artifact_type = 'column' AND action IN ('locked', 'description_accepted', 'description_edited')"


@query(_source_sql("count(*) FILTER (action = 'description_accepted') AS accepted, count(*) AS decided, CASE WHEN count(*) >= 5 THEN round(count(*) FILTER (action = 'description_accepted') / count(*), 4) END AS rate", _DECIDED, lambda s: "true" if s == "all" else f"starts_with(artifact_id, '{s}.')"))
def acceptance_rate(t):
    return _by_source(lambda s: health.acceptance_rate(decisions(t), s))


@query(_source_sql("round(avg(value) FILTER (event_id % 5 < 3), 4) AS mean_distance, count(value) FILTER (event_id % 5 < 3) AS n", "artifact_type = 'model' AND action = 'edited'", lambda s: "true" if s == "all" else f"starts_with(artifact_id, '{s}')"))
def edit_distance(t):
    return _by_source(lambda s: health.mean_edit_distance(decisions(t), s))


@query(_source_sql("count(*) FILTER (action = 'false_positive') AS false_positives, count(*) AS decided, round(1 - count(*) FILTER (action = 'false_positive') / nullif(count(*), 0), 4) AS precision", "artifact_type = 'contract' AND action IN ('false_positive', 'true_positive', 'acknowledged')", lambda s: {"all": "true", "shop": "event_id % 100 < 60", "nothing": "false"}[s]))
def contract_precision(t):
    return _by_source(lambda s: health.contract_precision(decisions(t), contracts_of(t), s))


@query(f"SELECT action AS status, count(*) AS n, round(least(100.0, count(*) * 100.0 / (SELECT count(*) FROM events)), 1) AS percent FROM {_DECISIONS} GROUP BY 1")
def review_progress(t):
    return health.review_progress(decisions(t).withColumnRenamed("action", "status"))


# Text and vectors ---------------------------------------------------------------------------------


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0), d AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)))) AS distance FROM q JOIN embeddings e ON q.vec_id <> e.vec_id)
SELECT query_id, id, rank, round(distance, 6) AS distance, round(greatest(0.3, 1 - distance), 6) AS confidence FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM d) WHERE rank <= 5 AND distance <= 1.2""")
def knn(t):
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = similarity.match_confidence(similarity.nearest(rows.where("id % 20 = 0"), rows, 5), 1.2)
    return found.select("query_id", "id", "rank", F.round("distance", 6).alias("distance"), F.round("confidence", 6).alias("confidence"))


@query("SELECT label % 4 AS part, count(*) AS n FROM embeddings GROUP BY 1")
def replaced_partitions(t):
    path = scratch(t.spark)
    rows = t.embeddings.withColumn("part", F.col("label") % 4)
    similarity.replace_partition(rows, path, "part")
    similarity.replace_partition(rows.where("part = 0"), path, "part")
    return t.spark.read.parquet(path).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lower(p_name) AS synonym, count(DISTINCT p_brand) AS n_items FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def synonym_collisions(t):
    items = t.part.select(F.col("p_brand").alias("item"), F.col("p_name").alias("synonym"))
    return similarity.synonym_collisions(items)


@query("""WITH terms AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS term FROM part UNION SELECT DISTINCT lower(p_type) FROM part)
SELECT doc_id, term, CAST(0.7 AS DOUBLE) AS confidence FROM documents, terms WHERE length(term) > 0 AND (length(lower(text)) - length(replace(lower(text), term, ''))) // length(term) >= 2 GROUP BY ALL""")
def document_term_match(t):
    docs = t.documents.select("doc_id", F.lit("").alias("title"), "text")
    terms = t.part.select(F.explode(F.split("p_name", " ")).alias("term")).unionByName(t.part.select(F.col("p_type").alias("term"))).distinct()
    return term_matches.match_terms(docs, terms)


@query("""WITH terms AS (SELECT DISTINCT lower(n_name) AS term FROM nation UNION SELECT DISTINCT lower(source) FROM documents WHERE source <> '' UNION SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) FROM part UNION SELECT DISTINCT lower(url) || '/more' FROM pages),
docs AS (SELECT page_id, lower(coalesce(url, '')) AS t, lower(coalesce(html, '')) AS b FROM pages)
SELECT page_id, term, max(CASE WHEN contains(t, term) OR (t <> '' AND contains(term, t)) THEN 0.9 ELSE 0.7 END) AS confidence FROM docs, terms
WHERE term <> '' AND (contains(t, term) OR (t <> '' AND contains(term, t)) OR (length(b) - length(replace(b, term, ''))) // length(term) >= 2) GROUP BY ALL""")
def page_term_match(t):
    """Terms in the addresses and texts of pages, and addresses in terms."""
    parts = [t.nation.select(F.col("n_name").alias("term")), t.documents.select(F.col("source").alias("term")), t.part.select(F.explode(F.split("p_name", " ")).alias("term")), t.pages.select(F.concat("url", F.lit("/more")).alias("term"))]
    return term_matches.match_terms(t.pages, reduce(DataFrame.unionByName, parts), key="page_id", title="url", text="html")
