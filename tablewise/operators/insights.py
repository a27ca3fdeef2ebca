"""Anomalies, shifts and correlations of time-stamped metrics."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.stats import confidence_of_p, confidence_of_z, normal_p_value, t_p_value
from tablewise.operators import ordered
from tablewise.operators.staging import metric_columns, time_columns
from tablewise.sources.paths import stored

LEAST_PERIODS, Z_INFO, Z_WARNING, Z_CRITICAL = 7, 2.0, 2.5, 3.0


def series(df: DataFrame, period: Column, metrics: list[str]) -> DataFrame:
    """(metric, t, value): the mean of each metric per period. Rows are reduced before any window."""
    means = df.where(period.isNotNull()).groupBy(period.alias("t")).agg(*[F.avg(m).alias(m) for m in metrics])
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("c")
    return means.select("t", cells).select("c.metric", "t", "c.value").where("value is not null")


def rolling(values: DataFrame, parts: int | None = None) -> DataFrame:
    """Add the mean and deviation of the last w periods, the present one included, and the z-score.

    w is a third of a metric's periods, at least 5; the figures are null before w periods exist. A
    series is divided by ranges of time. A window is the difference of two running sums, which
    meet by an equi-join of places; values are centred first, so nothing cancels, and a window in which no
    value changes has a deviation of exactly 0."""
    rows = ordered.placed(values, ["metric"], ["t"], parts)
    # A row for each metric, and so for each column at most.
    whole = F.broadcast(rows.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("centre")).withColumn("w", F.greatest(F.lit(5), F.floor(F.col("n") / 3)).cast("int")))
    own = ordered.with_prior(rows.join(whole, "metric"), ["metric"], "t", "value", "prior").withColumn("x", F.col("value") - F.col("centre"))
    changed = (~F.col("prior").eqNullSafe(F.col("value"))).cast("bigint")
    summed = ordered.running(own, ["metric"], ["t"], {"i": F.lit(1), "s": F.col("x"), "q": F.col("x") * F.col("x"), "changes": changed})
    summed = stored(summed.select(*values.columns, "n", "w", "centre", "i", "x", "s", "q", "changes"))
    first = summed.select("metric", (F.col("i") + F.col("w") - 1).alias("i"), (F.col("s") - F.col("x")).alias("s0"), (F.col("q") - F.col("x") * F.col("x")).alias("q0"), F.col("changes").alias("changes0"))
    met = summed.join(first, ["metric", "i"], "left")
    total, w = F.col("s") - F.col("s0"), F.col("w")
    variance = F.greatest(F.col("q") - F.col("q0") - total * total / w, F.lit(0.0)) / (w - 1)
    deviation = F.when(F.col("changes") == F.col("changes0"), 0.0).otherwise(F.sqrt(variance))
    mean = F.when(F.col("changes") == F.col("changes0"), F.col("value")).otherwise(F.col("centre") + total / w)
    full = F.col("i") >= w
    got = met.withColumns({"rolling_mean": F.when(full, mean), "rolling_std": F.when(full, deviation)}).drop("centre", "x", "s", "q", "changes", "s0", "q0", "changes0")
    return got.withColumn("z", F.try_divide(F.col("value") - F.col("rolling_mean"), F.nullif("rolling_std", F.lit(0.0))))


def anomalies(values: DataFrame) -> DataFrame:
    """Periods that are two deviations or more away, with their severity and size in percent."""
    got = rolling(values).where((F.col("n") >= LEAST_PERIODS) & (F.col("i") > F.col("w")) & (F.abs("z") >= Z_INFO))
    size = F.try_divide((F.col("value") - F.col("rolling_mean")) * 100, F.abs(F.nullif("rolling_mean", F.lit(0.0))))
    level = F.when(F.abs("z") >= Z_CRITICAL, F.lit("critical")).when(F.abs("z") >= Z_WARNING, F.lit("warning")).otherwise(F.lit("info"))
    return got.select("metric", "t", "i", "value", "rolling_mean", "rolling_std", "z", size.alias("magnitude"), level.alias("severity"))


def streaks(found: DataFrame) -> DataFrame:
    """Consecutive anomalies of one sign as one row: first and last period, and the last one's figures."""
    sign = F.signum("z").cast("int")
    got = ordered.numbered(found.withColumn("sign", sign), ["metric", "sign"], ["i"], "place").withColumn("island", F.col("i") - F.col("place"))
    last = lambda c: F.max_by(c, "i").alias(c)
    return got.groupBy("metric", "sign", "island").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("periods"), last("value"), last("z"), last("magnitude"), last("severity")).drop("island")


def with_significance(rows: DataFrame) -> DataFrame:
    return rows.withColumn("p_value", normal_p_value("z")).withColumn("confidence", confidence_of_z(F.col("z")))


def halves(df: DataFrame, time: str, metrics: list[str], key: str, parts: int | None = None) -> DataFrame:
    """Per metric: rows, means and variances of the first half in time and of the rest.

    The half is found from counts per time stamp: running sums over ranges of time give the stamp where
    it falls, and only rows of that one stamp are put in order, by ``key``, again in ranges."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("c")
    flat = df.where(F.col(time).isNotNull()).select(F.col(time).alias("t"), F.col(key).alias("k"), cells).select("t", "k", "c.metric", "c.value").where("value is not null")
    counts = ordered.placed(flat.groupBy("metric", "t").agg(F.count(F.lit(1)).alias("n")), ["metric"], ["t"], parts)
    totals = F.broadcast(counts.groupBy("metric").agg(F.floor(F.sum("n") / 2).alias("half")))
    marks = ordered.running(counts, ["metric"], ["t"], {"upto": F.col("n")}).join(totals, "metric")
    border = stored(marks.where((F.col("upto") > F.col("half")) & (F.col("upto") - F.col("n") <= F.col("half"))).select("metric", F.col("t").alias("edge"), (F.col("half") - (F.col("upto") - F.col("n"))).alias("take")))
    met = flat.join(F.broadcast(border), "metric")
    ties = ordered.numbered(met.where("t = edge"), ["metric"], ["k", "value"], "place", parts).withColumn("early", F.col("place") <= F.col("take")).drop("place")
    sides = met.where("t <> edge").withColumn("early", F.col("t") < F.col("edge")).unionByName(ties)
    figures = [x for name, side in (("early", F.col("early")), ("late", ~F.col("early"))) for x in (F.count_if(side).alias(f"n_{name}"), F.avg(F.when(side, F.col("value"))).alias(f"mean_{name}"), F.var_samp(F.when(side, F.col("value"))).alias(f"var_{name}"))]
    return sides.groupBy("metric").agg(*figures)


def shift_statistics(two: DataFrame) -> DataFrame:
    """Welch's t and its degrees of freedom, and the change in percent."""
    a, b = F.col("var_early") / F.col("n_early"), F.col("var_late") / F.col("n_late")
    t = F.try_divide(F.col("mean_late") - F.col("mean_early"), F.sqrt(a + b))
    df = F.try_divide(F.pow(a + b, F.lit(2)), F.pow(a, F.lit(2)) / (F.col("n_early") - 1) + F.pow(b, F.lit(2)) / (F.col("n_late") - 1))
    enough = (F.col("n_early") >= 10) & (F.col("n_late") >= 10)
    change = F.try_divide((F.col("mean_late") - F.col("mean_early")) * 100, F.abs(F.nullif("mean_early", F.lit(0.0))))
    return two.where(enough).withColumns({"t": t, "df": df, "magnitude": change})


def shifts(two: DataFrame, most_p: float = 0.05) -> DataFrame:
    """Metrics whose later half differs with significance."""
    got = shift_statistics(two).where(F.abs("mean_early") >= 1e-10).withColumn("p_value", t_p_value("t", "df")).where(F.col("p_value") < most_p)
    level = F.when(F.col("p_value") < 0.001, F.lit("critical")).when(F.col("p_value") < 0.01, F.lit("warning")).otherwise(F.lit("info"))
    return got.withColumns({"severity": level, "confidence": confidence_of_p(F.col("p_value"))})


#: Columns of a block of the tables of products that a task holds.
BLOCK_COLUMNS = 512


def _products(cells: DataFrame, first: list[int], second: list[int]) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) of a task's rows that have both columns, i before j: six products of
    matrices a batch, added up. ``cells`` has a centred column c0, c1 and so on for each metric."""
    columns = sorted({*first, *second})
    at = {c: k for k, c in enumerate(columns)}
    x_at, y_at = np.array([at[c] for c in first]), np.array([at[c] for c in second])
    i, j = (g.ravel() for g in np.meshgrid(np.array(first), np.array(second), indexing="ij"))
    upper = i < j

    def run(batches):
        total = np.zeros((6, len(first), len(second)))
        for batch in batches:
            table = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], 1)
            seen = ~np.isnan(table)
            x, y = np.where(seen, table, 0.0)[:, x_at], np.where(seen, table, 0.0)[:, y_at]
            u, v = seen[:, x_at].astype(float), seen[:, y_at].astype(float)
            for k, (left, right) in enumerate(((u, v), (x, v), (u, y), (x * x, v), (u, y * y), (x, y))):
                total[k] += left.T @ right
        flat = total.reshape(6, -1)[:, upper]
        yield pa.RecordBatch.from_arrays([pa.array(i[upper]), pa.array(j[upper]), *map(pa.array, flat)], ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    schema = "i bigint, j bigint, n double, sx double, sy double, sxx double, syy double, sxy double"
    return cells.select(*[f"c{c}" for c in columns]).mapInArrow(run, schema)


def correlations(df: DataFrame, metrics: list[str], block: int = BLOCK_COLUMNS) -> DataFrame:
    """(a, b, n, r, t) for every pair of metrics on the rows that have both; NaN counts as null.

    Columns are centred by their means. Each pair of blocks of columns is a scan of these columns only, in
    which tasks add up matrix products; a row a task and pair is sent on. A column that does not vary on the
    pair's rows has no correlation."""
    spark = df.sparkSession
    clean = [f"nanvl(CAST(`{m}` AS double), CAST(NULL AS double))" for m in metrics]
    means = [x or 0.0 for x in df.selectExpr(*[f"avg({c})" for c in clean]).first()] if metrics else []
    cells = df.selectExpr(*[f"{c} - {x!r}D AS c{k}" for k, (c, x) in enumerate(zip(clean, means))])
    blocks = [list(range(k, min(k + block, len(metrics)))) for k in range(0, len(metrics), block)]
    parts = [_products(cells, first, second) for k, first in enumerate(blocks) for second in blocks[k:] if len({*first, *second}) > 1]
    if not parts:
        return spark.createDataFrame([], "a string, b string, n bigint, r double, t double")
    sums = reduce(DataFrame.unionByName, parts).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    named = spark.createDataFrame([(k, m, x) for k, (m, x) in enumerate(zip(metrics, means))], "k bigint, name string, mean double")
    side = lambda k, name: F.broadcast(named.select(F.col("k").alias(k), F.col("name").alias(name), F.col("mean").alias(f"mean_{name}")))
    n = F.nullif(F.col("n"), F.lit(0.0))
    spread = lambda s, ss, mean: F.when(F.col(ss) - F.col(s) * F.col(s) / n > 1e-28 * n * F.col(mean) * F.col(mean), F.col(ss) - F.col(s) * F.col(s) / n)
    r = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(spread("sx", "sxx", "mean_a") * spread("sy", "syy", "mean_b"))
    bounded = F.when(r.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))
    rows = sums.join(side("i", "a"), "i").join(side("j", "b"), "j").select("a", "b", F.col("n").cast("bigint").alias("n"), bounded.alias("r"))
    rest = 1 - F.col("r") * F.col("r")
    t = F.when(rest > 0, F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, rest)))
    return rows.withColumn("t", t)


def strong_correlations(rows: DataFrame, least: float = 0.6, most_p: float = 0.05) -> DataFrame:
    t = F.coalesce("t", F.when(F.abs("r") >= 1, F.lit(float("inf"))))
    got = rows.where((F.col("n") >= 10) & (F.abs("r") >= least)).withColumn("p_value", t_p_value(t, (F.col("n") - 2).cast("double"))).where(F.col("p_value") < most_p)
    return got.withColumns({"strength": F.when(F.abs("r") >= 0.8, F.lit("strong")).otherwise(F.lit("moderate")), "confidence": confidence_of_p(F.col("p_value"))})


#: What ``detect`` says of each finding.
_FINDING = "table string, kind string, metric string, other string, magnitude double, p_value double, severity string, confidence string"


def _anomalous(df: DataFrame, time: str, metrics: list[str], key: str) -> DataFrame:
    found = with_significance(streaks(anomalies(series(df, F.to_date(time), metrics))))
    return found.select(F.lit("anomaly").alias("kind"), "metric", F.lit(None).cast("string").alias("other"), "magnitude", "p_value", "severity", "confidence")


def _moved(df: DataFrame, time: str, metrics: list[str], key: str) -> DataFrame:
    found = shifts(halves(df, time, metrics, key))
    return found.select(F.lit("shift").alias("kind"), "metric", F.lit(None).cast("string").alias("other"), "magnitude", "p_value", "severity", "confidence")


def _tied(df: DataFrame, time: str, metrics: list[str], key: str) -> DataFrame:
    level = F.when(F.col("strength") == "strong", F.lit("warning")).otherwise(F.lit("info"))
    found = strong_correlations(correlations(df, metrics))
    return found.select(F.lit("correlation").alias("kind"), F.col("a").alias("metric"), F.col("b").alias("other"), F.col("r").alias("magnitude"), "p_value", level.alias("severity"), "confidence")


def detect(tables: dict[str, DataFrame], keys: dict[str, str], least_rows: int = 10, at_once: int = 8) -> DataFrame:
    """(table, kind, metric, other, magnitude, p_value, severity, confidence) over many tables.

    A table with too few rows, or without numbers, gives nothing. Rows of one time are ordered by the
    table's key in ``keys``, else by its first metric. Tables and kinds of findings run side by side, each
    written as it is found."""

    def picked(df: DataFrame) -> tuple[list[str], list[str]]:
        few = df.limit(least_rows).count() < least_rows
        return ([], []) if few else (metric_columns(df), time_columns(df))

    def run(job) -> DataFrame:
        name, find, times, metrics = job
        time = times[0] if times else None
        return stored(find(tables[name], time, metrics, keys.get(name, metrics[0])).withColumn("table", F.lit(name)))

    with ThreadPoolExecutor(at_once) as pool:
        columns = dict(zip(tables, pool.map(picked, tables.values())))
        jobs = [(name, find, times, metrics) for name, (metrics, times) in columns.items() if metrics and times for find in (_anomalous, _moved)]
        jobs += [(name, _tied, times, metrics) for name, (metrics, times) in columns.items() if len(metrics) > 1]
        parts = list(pool.map(run, jobs))
    if parts:
        return reduce(DataFrame.unionByName, parts).select(*[c.split()[0] for c in _FINDING.split(", ")])
    return next(iter(tables.values())).sparkSession.createDataFrame([], _FINDING)
