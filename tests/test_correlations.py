import numpy as np
import pytest

from tablewise.operators import insights


def frame(spark, x, names):
    return spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"`{n}` double" for n in names)).repartition(3)


@pytest.mark.parametrize("block", [512, 3])
def test_pairs_with_gaps(spark, block):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) + 1e5
    x[:, 1] = 3 * x[:, 0] + 1
    x[:, 2] = 7.25
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 7] = np.nan
    names = ["a", "b", "c c", "d", "e", "f", "g", "h"]
    got = {(r.a, r.b): (r.n, r.r) for r in insights.correlations(frame(spark, x, names), names, block).collect()}
    assert len(got) == 28
    for i in range(8):
        for j in range(i + 1, 8):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            n, r = got[names[i], names[j]]
            assert n == both.sum()
            if 2 in (i, j) or 7 in (i, j):
                assert r is None
            else:
                assert r == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9) and -1 <= r <= 1


def test_five_hundred_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 500))
    names = [f"m{k}" for k in range(500)]
    got = insights.correlations(frame(spark, x, names), names, 200)
    assert got.count() == 500 * 499 // 2
    want = np.corrcoef(x.T)
    for r in got.where("a = 'm17' or b = 'm450'").collect():
        assert r.r == pytest.approx(want[int(r.a[1:]), int(r.b[1:])], abs=1e-12)


def test_too_few_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert insights.correlations(df, ["a"]).count() == 0 and insights.correlations(df, []).count() == 0
    assert [tuple(r) for r in insights.correlations(df, ["a", "b"]).collect()] == [("a", "b", 1, None, None)]
