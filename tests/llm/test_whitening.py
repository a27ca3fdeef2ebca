import numpy as np
import pytest

from tablewise.llm import whitening


def brute(rows):
    """id -> (n, deviation, whitened, explained), signs by the largest entry of a direction."""
    good = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows]
    fit = np.array(sorted({tuple(x) for _, x in good}), dtype=object)
    n, sums = len(fit), fit.sum(0)
    centred = fit.astype(float) - (sums / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    return n, {i: (sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums)), (x - (sums / n).astype(float)) @ vectors / np.sqrt(values)) for i, x in good}, values / (centred**2).sum() * n


@pytest.mark.parametrize("rows_per_block", [1024, 7])
def test_against_numpy(spark, sf, monkeypatch, rows_per_block):
    monkeypatch.setattr(whitening, "ROWS", rows_per_block)
    df = spark.read.parquet(f"{sf}/embeddings.parquet").limit(60)
    df = df.unionByName(df.limit(5).selectExpr("vec_id + 1000 AS vec_id", "embedding", "label"))
    got = whitening.by_component(whitening.whiten(df)).toPandas()
    n, want, explained = brute([(r.vec_id, r.embedding) for r in df.collect()])
    assert len(got) == 4 * len(want) and set(got.n) == {n} and got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    for k in range(4):
        own = got[got.component == k + 1].sort_values("vec_id")
        w = np.array([want[i][1][k] for i in own.vec_id])
        assert [want[i][0] for i in own.vec_id] == own.deviation.tolist()
        assert min(np.abs(own.whitened - w).max(), np.abs(own.whitened + w).max()) < 1e-8
        assert np.allclose(own.explained, explained[k], rtol=1e-9)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 0.0]), (None, [3.0, -1.0]), (6, [0.5, 0.25]), (7, [9.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS id", "2 AS x", "3 AS n", "4 AS w", "5 AS place")
    got = whitening.by_component(whitening.whiten(df)).toPandas()
    assert len(got) == 8 and got.vec_id.isna().sum() == 2 and set(got.component) == {1, 2}
    assert set(got.n) == {3} and (got.deviation > 0).all()
    assert whitening.whiten(df.limit(0)).count() == 0
    one = whitening.by_component(whitening.whiten(df.where("vec_id = 1"))).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained) for r in one] == [(c, 1, 0, None, None) for c in (1, 1, 2, 2)] or len(one) == 4


def test_no_variance_in_a_direction(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(50)], "vec_id bigint, embedding array<double>")
    got = whitening.by_component(whitening.whiten(df)).toPandas()
    assert got[got.component == 1].whitened.notna().all() and got[got.component > 1].whitened.isna().all()
    assert got.identity_error.max() < 1e-9


def test_one_hot_vector(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(1000 + i, rng.normal(size=3).tolist()) for i in range(100)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).toPandas()
    assert len(got) == 400 and set(got.n) == {101}


def test_scatter_is_summed_in_groups(spark):
    x = np.random.default_rng(1).normal(size=(9000, 3))
    df = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    fit = whitening.fit_list(whitening.on_grid(df, "vec_id", "embedding"))
    n, sums = whitening._sums(fit)
    assert sorted(r.place for r in fit.collect()) == list(range(n))
    grid = np.unique(np.floor(256 * x), axis=0)
    assert np.allclose(whitening._scatter(whitening._centred(fit, n, sums)), np.cov(grid.T, bias=True) * n)
