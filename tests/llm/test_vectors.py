import numpy as np
import pytest

from tablewise.llm import vectors


def exact(ids, x, q, k=20):
    score = x @ x[q]
    score[q] = -np.inf
    return ids[np.lexsort((ids, -score))[:k]]


@pytest.mark.parametrize("shard", [4096, 700])
def test_recall(spark, shard, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", shard)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = df.orderBy("vec_id").toPandas()
    x, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    got = vectors.nearest(df, df.where("vec_id % 20 = 0")).toPandas()
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        own = got[got.query_id == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and own.score.is_monotonic_decreasing
        hits += len(set(own.vec_id) & set(exact(ids, x, q)))
        total += 20
        assert np.allclose(own.score, x[np.searchsorted(ids, own.vec_id)] @ x[q], atol=1e-12)
    assert hits / total >= 0.95


def test_odd_rows(spark):
    rows = [(20, [1.0, 2.0]), (20, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, []), (6, [1.0, 2.0]), (7, [2.0, 4.0]), (40, [1.0, 1.0]), (None, [5.0, 5.0]), (8, [1.0, 2.0, 3.0]), (9, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS id", "2 AS score")
    got = vectors.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(20, 7, 10.0), (20, 6, 5.0), (20, 40, 3.0), (40, 7, 6.0), (40, 6, 3.0), (40, 20, 3.0)]
    assert vectors.nearest(df.limit(0), df.limit(0)).count() == 0


def test_one_hot_vector(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(400)] + [(1000 + i, [0.001 * i, 0.01]) for i in range(100)], "vec_id bigint, embedding array<float>")
    got = vectors.nearest(df, df.where("vec_id % 20 = 0")).toPandas()
    assert got[got.query_id == 40].sort_values("rank").vec_id.tolist() == list(range(20))
    assert got[got.query_id == 0].sort_values("rank").vec_id.tolist() == list(range(1, 21))


def test_ties_of_different_vectors(spark):
    """399 different vectors with the same inner product: the smallest ids are the nearest."""
    rng = np.random.default_rng(4)
    rows = [(0, [1.0] + [0.0] * 7)] + [(i, [1.0, *map(float, rng.normal(size=7))]) for i in range(1, 400)] + [(1000 + i, [0.5, *map(float, rng.normal(size=7))]) for i in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(i), v) for i, v in rows], "vec_id bigint, embedding array<double>")
    got = vectors.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 21)) and {r.score for r in got} == {1.0}


def _norm_inputs():
    rng = np.random.default_rng(1)
    plain, middle = rng.normal(size=(3000, 64)), rng.normal(size=(30, 64))
    grouped = middle[rng.integers(0, 30, 3000)] + 0.3 * rng.normal(size=(3000, 64))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    return {"unit": unit(plain), "grouped": unit(grouped), "natural": plain, "log-normal": unit(plain) * np.exp(rng.normal(size=3000))[:, None]}


@pytest.mark.parametrize("kind", ["unit", "grouped", "natural", "log-normal"])
def test_recall_for_any_norms(spark, kind):
    x = _norm_inputs()[kind]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    got = vectors.nearest(df, df.where("vec_id % 20 = 0")).toPandas()
    assert got.groupby("query_id").size().tolist() == [20] * 150
    ids = np.arange(len(x))
    hits = sum(len(set(own.vec_id) & set(exact(ids, x, q))) for q, own in got.groupby("query_id"))
    assert hits / len(got) >= 0.95
    assert np.allclose(got.score, np.einsum("nd,nd->n", x[got.query_id], x[got.vec_id]), atol=1e-9)


def test_bands_end_where_norms_fall(monkeypatch):
    monkeypatch.setattr(vectors, "BAND_NODES", 3)
    assert vectors.bands(np.array([8.0] * 4 + [4.0] * 4 + [1.0, 0.5])) == [0, 4, 10]
    assert vectors.bands(np.ones(9)) == [0, 9] and vectors.bands(np.array([2.0])) == [0, 1]


def test_norms_out_of_range_of_squares(spark):
    df = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e100, 1e100]), (2, [1e-200, 0.0]), (3, [-1e200, 0.0]), (20, [1e-170, 0.0])], "vec_id bigint, embedding array<double>")
    got = vectors.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 1), (0, 20), (0, 2), (0, 3), (20, 0), (20, 1), (20, 2), (20, 3)]
