import random

import pandas as pd
import pytest

from tablewise.operators import insights, ordered


@pytest.mark.parametrize("parts", [2, 9])
def test_running_sums_and_neighbours(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice("abc"), i, rng.randint(0, 3)) for i in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "g string, t int, v int")
    placed = ordered.placed(df, ["g"], ["t"], parts)
    assert placed.select("part").distinct().count() > 1
    got = ordered.running(ordered.with_prior(placed, ["g"], "t", "v", "prior"), ["g"], ["t"], {"total": placed["v"], "place": ordered.F.lit(1)}).toPandas().sort_values(["g", "t"])
    by = got.groupby("g").v
    assert got.total.tolist() == by.cumsum().tolist() and got.place.tolist() == (by.cumcount() + 1).tolist()
    assert got.prior.fillna(-1).tolist() == by.shift().fillna(-1).tolist()


def frame(n, seed=0):
    rng = random.Random(seed)
    rows = [("a", t, 1e6 + rng.gauss(0, 1) + (40 if t in (700, 701, 702) else 0)) for t in range(n)] + [("b", t, 5.0 if t < n // 2 else 5.0 + (t == n - 3) * 1e-3) for t in range(n)] + [("short", t, float(t)) for t in range(6)]
    return rows


@pytest.mark.parametrize("parts", [2, 13])
def test_long_series(spark, parts):
    """One row a stamp over many ranges gives what windows over the whole series give."""
    rows = frame(900)
    got = insights.rolling(spark.createDataFrame(rows, "metric string, t int, value double"), parts).toPandas()
    want = pd.DataFrame(rows, columns=["metric", "t", "value"])
    for metric, own in want.groupby("metric"):
        w = max(5, len(own) // 3)
        mine = got[got.metric == metric].sort_values("t")
        assert mine.i.tolist() == list(range(1, len(own) + 1)) and set(mine.w) == {w}
        roll = own.value.rolling(w)
        pd.testing.assert_series_equal(mine.rolling_mean.reset_index(drop=True), roll.mean().reset_index(drop=True), check_names=False, rtol=1e-12)
        exact = [pd.Series(own.value.values[max(0, i - w + 1) : i + 1]).std() if i >= w - 1 else None for i in range(len(own))]
        assert all((pd.isna(a) and pd.isna(b)) or a == pytest.approx(b, rel=1e-6, abs=1e-12) for a, b in zip(mine.rolling_std, exact))
    flat = got[(got.metric == "b") & (got.t < 450) & (got.t >= 300)]
    assert (flat.rolling_std == 0).all() and flat.z.isna().all()


def test_no_window_over_a_whole_metric(spark):
    values = spark.createDataFrame(frame(60), "metric string, t int, value double")
    import re

    for df in (insights.rolling(values, 5), insights.halves(values.withColumnRenamed("value", "x"), "t", ["x"], "metric", 5)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        specs = re.findall(r"Window \[[^\n]*?\], \[([^\]]*)\], \[([^\]]*)\]", plan)
        # Windows by metric alone run over one row a range, and are ordered by the range.
        assert all("part" in keys or "part" in order for keys, order in specs)


def test_halves_with_one_hot_stamp(spark):
    rows = [(5, i, float(i)) for i in range(500)] + [(9, 1000 + i, 2.0) for i in range(3)]
    df = spark.createDataFrame(rows, "t int, k int, x double").repartition(4)
    got = insights.halves(df, "t", ["x"], "k", 6).first()
    early = [float(i) for i in range(251)]
    assert got.n_early == 251 and got.n_late == 252 and got.mean_early == pytest.approx(sum(early) / 251)
