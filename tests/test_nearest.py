import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewise.operators import similarity


def brute(ids, x, q, k):
    out = {}
    for i in q:
        gap = ((x - x[i]) ** 2).sum(1)
        gap[ids == ids[i]] = np.inf
        order = np.lexsort((ids, gap))[:k]
        out[int(ids[i])] = [int(j) for j in ids[order] if True][: len(order)]
    return out


def table(spark, x):
    return spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "id bigint, v array<double>")


def clusters(n=3000, centres=40, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(centres, dim))[rng.integers(0, centres, n)] * 10 + rng.normal(size=(n, dim)) * 0.5


@pytest.mark.parametrize("block", [1_000_000, 600])
@pytest.mark.parametrize("kind", ["clusters", "one cloud", "one hot vector", "far from zero"])
def test_exact(spark, monkeypatch, kind, block):
    monkeypatch.setattr(similarity, "BLOCK_CELLS", block)
    rng = np.random.default_rng(2)
    x = {"clusters": clusters(600), "one cloud": rng.normal(size=(500, 8)), "one hot vector": np.vstack([np.ones((200, 4)), rng.normal(size=(300, 4))]), "far from zero": 1e6 + clusters(400)}[kind]
    df = table(spark, x)
    got = similarity.nearest(df.where("id % 20 = 0"), df, 5).orderBy("query_id", "rank").collect()
    ids = np.arange(len(x))
    want = brute(ids, x, range(0, len(x), 20), 5)
    for q, near in want.items():
        own = [r for r in got if r.query_id == q]
        assert [r.id for r in own] == near and [r["rank"] for r in own] == [1, 2, 3, 4, 5]


def test_few_cells_are_visited(spark):
    """On clustered data a query meets less than a tenth of all vectors."""
    x = clusters()
    df = table(spark, x)
    seen = []
    plain = similarity._search
    similarity._search = lambda routed, held, k: seen.append((routed.groupBy("cell").count(), held.groupBy("cell").count())) or plain(routed, held, k)
    try:
        assert similarity.nearest(df.where("id % 20 = 0"), df, 5).count() == 150 * 5
    finally:
        similarity._search = plain
    visits = sum(r.n for routed, held in seen for r in routed.withColumnRenamed("count", "m").join(held, "cell").select((F.col("m") * F.col("count")).alias("n")).collect())
    cells = seen[0][1].count()
    assert cells > 20 and visits < 0.1 * 150 * len(x)


def test_groups_and_odd_rows(spark):
    rows = [(1, "a", [0.0, 0.0]), (2, "a", [1.0, 0.0]), (3, "b", [0.1, 0.0]), (4, "a", None), (5, "a", [float("nan"), 1.0]), (6, "a", [1.0]), (None, "a", [0.0, 0.1]), (7, "a", []), (8, "c", [5.0, 5.0])]
    df = spark.createDataFrame(rows, "id bigint, same string, v array<double>").withColumnRenamed("same", "kind")
    got = similarity.nearest(df, df, 3, equal=["kind"]).collect()
    assert {(r.query_id, r.id, r.distance) for r in got} == {(1, 2, 1.0), (2, 1, 1.0)}
    assert similarity.nearest(df, df.limit(0), 3).count() == 0 and similarity.nearest(df.limit(0), df, 3).count() == 0


def test_rows_carry_no_lists_of_cells(spark, monkeypatch):
    """Queries meet their group's cells in place: no list of cells is made or sent along with each of them."""
    plans, plain = [], similarity._search
    monkeypatch.setattr(similarity, "_search", lambda routed, held, k: plans.append(routed._jdf.queryExecution().toString()) or plain(routed, held, k))
    monkeypatch.setattr(similarity, "PART", 7, raising=False)
    x = clusters(300)
    df = table(spark, x)
    got = similarity.nearest(df.where("id % 20 = 0"), df, 5).collect()
    want = brute(np.arange(len(x)), x, range(0, len(x), 20), 5)
    assert {q: [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in want} == want
    assert len(plans) == 2 and not any("collect_list" in p for p in plans)
