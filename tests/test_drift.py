import os

import pytest
from pyspark.sql import functions as F

from tablewise.operators import drift, profile, quality


def test_rerun_sees_small_changes_swaps_and_no_order(spark):
    base = spark.createDataFrame([(1, 0.001, "a", [1]), (2, 0.002, "b", None), (3, None, None, [3])], "id int, x double, s string, l array<int>")
    swapped = spark.createDataFrame([(1, 0.002, "a", [1]), (2, 0.001, "b", None), (3, None, None, [3])], base.schema)
    nudged = base.withColumn("x", F.col("x") + F.when(F.col("id") == 1, 0.003).when(F.col("id") == 2, -0.0016))
    moved_null = spark.createDataFrame([(1, 0.001, "a", [1]), (2, 0.002, "b", None), (None, 3.0, None, [3])], base.schema)
    once_more = base.unionByName(base.where("id = 1"))
    old = drift.snapshot({"t": base}, 1)
    for df, unchanged in ((base.orderBy(F.col("id").desc()).repartition(3), 1), (swapped, 0), (nudged, 0), (moved_null, 0), (once_more, 0)):
        got = drift.rerun_summary(old, drift.snapshot({"t": df}, 2)).first()
        assert (got.unchanged, got.updated) == (unchanged, 1 - unchanged)


def test_changes_are_located(spark):
    old = spark.range(5000).selectExpr("id", "id * 0.5D AS x", "cast(null AS string) AS s")
    new = old.where("id <> 17").withColumn("x", F.when(F.col("id") == 42, 0.001 + F.col("x")).otherwise(F.col("x"))).unionByName(spark.createDataFrame([(9999, 1.0, None)], old.schema))
    assert {(r.id, r.change) for r in drift.changed_rows(old, new, ["id"]).collect()} == {(17, "removed"), (42, "updated"), (9999, "added")}
    trees = [drift.digest_tree({"t": df, "only": df}, {"t": ["id"]}, 256) for df in (old, new)]
    found = drift.changed_buckets(trees[0], trees[1].where("table = 't'"))
    assert 1 <= found.count() <= 3 and {r.table for r in found.collect()} == {"t"}
    assert drift.changed_rows(old, old.repartition(7), ["id"]).count() == 0
    assert drift.changed_buckets(trees[0], trees[0]).count() == 0 and drift.changed_rows(old.limit(0), old.limit(0), ["id"]).count() == 0


def files(path):
    return {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith("bucket=")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.range(2000).selectExpr("id", "concat('n', id) AS name", "id % 3 = 0 AS locked", "cast(null AS bigint) AS removed")
    table = drift.BucketedTable(spark, path, ["id"], 32)
    table.create(old)
    before = files(path)
    new = spark.createDataFrame([(6, "six"), (7, "seven"), (5000, "more")], "id bigint, name string")
    touched = table.upsert(new, ["name"], removed="removed")
    after = files(path)
    assert len(touched) <= 3 and {d for d in before if before[d] != after[d]} == {f"bucket={b}" for b in touched}
    want = drift.locked_upsert(old, new, ["id"], ["name"], removed="removed")
    assert sorted(map(tuple, table.read().collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    gone = table.soft_delete(table.read().where("id <> 11"), 4, "removed")
    assert len(gone) == 1 and {d for d in after if after[d] != files(path)[d]} == {f"bucket={gone[0]}"}
    assert [(r.id, r.removed) for r in table.read().where("removed is not null").collect()] == [(11, 4)]
    assert table.soft_delete(table.read().where("id <> 11"), 5, "removed") == [] and table.upsert(new.limit(0)) == []
    with pytest.raises(Exception, match="(?i)exist"):
        table.create(old)


def test_contracts_of_long_texts_hold(spark):
    """Few long texts, some of which share their beginning, and a quote: rules come out of the texts themselves."""
    rows = [(i, ["x" * 250, "x" * 249 + "'", "short", "y" * 5000][i % 4]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, note string")
    found = profile.profile(df, "t")
    tops = found.where("top_values is not null").select("column", F.posexplode("top_values").alias("rank", "v")).select("column", "rank", "v.value")
    assert {r.value for r in tops.collect()} == {t for _, t in rows}
    rules = quality.as_rules(quality.generate(found, tops))
    assert any(r.kind == "cardinality" for r in rules)
    assert all(r.passed for r in quality.check(df, rules).collect())


def test_repeats_shuffle_no_text(spark):
    df = spark.createDataFrame([(1, "a" * 1000, 1.5), (2, "a" * 1000, None), (3, None, None)], "id int, s string, x double")
    assert {r.column: r.observed for r in quality.repeats(df, ["id", "s", "x"]).collect()} == {"id": 0, "s": 2, "x": 2}


def test_snapshot_query_tells_values_apart(spark, sf):
    """The registered snapshot has a fingerprint of each column's values, which order does not change."""
    import hashlib

    from tablewise.plans.registry import QUERIES

    got = {(r.table, r.column): r.fingerprint for r in QUERIES["schema_snapshot"](spark, sf).collect()}
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    digest = lambda v: int(hashlib.md5(str(v).encode()).hexdigest()[:8], 16)
    assert got["nation", "n_name"] == str(sum(digest(r.n_name) for r in nation.collect()))
    changed = nation.withColumn("n_name", F.when(F.col("n_nationkey") == 3, F.lit("X")).otherwise(F.col("n_name")))
    other = {r.column: r.fingerprint for r in drift.text_fingerprints({"nation": changed.orderBy(F.col("n_nationkey").desc())}).collect()}
    assert other["n_name"] != got["nation", "n_name"] and other["n_nationkey"] == got["nation", "n_nationkey"]


def test_roles_need_no_percentiles(spark, sf, monkeypatch):
    """Roles come from a brief profile: equal to those of the full one, and no percentile is looked for."""
    from tablewise.plans import registry

    tables = {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("supplier", "part")}
    names = ("table", "column", "row_count", "null_count", "distinct_count", "min_value", "max_value", "stddev", "uniqueness_ratio")
    full = sorted(map(tuple, profile.profile_all(tables).select(*names).collect()))

    def fail(*_):
        raise AssertionError("percentiles")

    monkeypatch.setattr(profile, "_percentiles", fail)
    assert sorted(map(tuple, profile.profile_all(tables, brief=True).select(*names).collect())) == full
    assert registry._typed(registry.Tables(spark, sf), ("supplier",)).count() == 4
