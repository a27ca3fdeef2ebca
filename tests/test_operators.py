"""Operators on small literal tables."""

import datetime
import math
import random

import numpy as np
import pytest

from tablewise.functions import stats
from tablewise.operators import drift, graph, health, insights, marts, metrics, profile, quality, relate, similarity, staging
from tablewise.operators.quality import Rule
from tablewise.operators.relate import Edge
from tablewise.operators import terms as terms_of
from tablewise.sources import files, sinks


@pytest.fixture(scope="module")
def items(spark):
    rows = [("i1", "Widget", 10.0, "hardware"), ("i2", "Gadget", 25.0, "electronics"), ("i3", "Doohickey", 5.0, "hardware"), ("i4", None, 15.0, "electronics"), ("i5", "Thingamajig", 100.0, "toys")]
    return spark.createDataFrame(rows, "item_id string, name string, price double, category string")


def observed(results):
    return {r.rule: (r.observed, r.passed) for r in results.collect()}


def test_contract_kinds(items):
    rules = [
        Rule("name", "not_null", "name"), Rule("price", "range", "price", "price BETWEEN 0 AND 20"), Rule("category", "cardinality", "category", "category IN ('hardware', 'electronics')"),
        Rule("rows", "row_count", low=5), Rule("few", "row_count", high=4), Rule("id", "unique", "item_id"), Rule("broken", "range", "price", "no_column > 1"), Rule("off", "not_null", "name", status="proposed"),
    ]
    got = observed(quality.check(items, rules))
    assert got == {"name": (1, False), "price": (2, False), "category": (1, False), "rows": (5, True), "few": (5, False), "id": (0, True), "broken": (None, False)}


def test_unique_counts_nulls_as_repeats(items):
    twice = items.unionByName(items.where("item_id = 'i1'"))
    assert observed(quality.check(twice, [Rule("id", "unique", "item_id"), Rule("name", "unique", "name")])) == {"id": (1, False), "name": (2, False)}


def test_missing_table_fails_its_rules(items):
    got = quality.check_tables({"items": items}, {"gone": [Rule("x", "not_null", "a")]}).collect()
    assert [(r.passed, r.table) for r in got] == [(False, "gone")]


def test_report(items):
    r = quality.report(quality.check(items, [Rule("name", "not_null", "name"), Rule("id", "unique", "item_id")])).first()
    assert (r.total, r.passed, r.failed, r.pass_rate) == (2, 1, 1, 50.0)


def test_generated_contracts_hold_on_their_own_table(items):
    found = profile.profile(items, "items")
    made = quality.generate(found, profile.top_values(profile.frequencies(items, ["name", "category"])))
    rules = quality.as_rules(made)
    assert {r.kind for r in rules} == {"not_null", "unique", "range", "cardinality"}
    assert all(r.passed for r in quality.check(items, rules).collect())
    price = next(r for r in rules if r.name == "price:range")
    assert "0.00" in price.expression and "147.50" in price.expression


def test_profile_of_nested_and_nan(spark):
    df = spark.createDataFrame([(1, float("nan"), [1]), (2, 2.0, None), (3, None, [3])], "id int, x double, l array<int>")
    got = {r.column: r for r in profile.profile(df, "t").collect()}
    assert got["x"].null_count == 2 and got["x"].max_value == 2.0 and got["x"].stddev == 0.0
    assert got["l"].null_count == 1 and got["l"].distinct_count is None


def test_patterns(spark):
    rows = [(f"user{i}@mail.example", f"+1 555 01{i:02d} 99", f"https://e.example/{i}", f"{i:08x}", "2024-01-05") for i in range(20)]
    got = profile.patterns(spark.createDataFrame(rows, "a string, b string, c string, d string, e string"))
    assert {r.column: r.detected_pattern for r in got.collect()} == {"a": "email", "b": "phone", "c": "url", "d": "hex_id", "e": "phone"}


def test_names_and_types(spark):
    assert staging.unique_names(["A b", "a-B", "", "a_b"]) == ["a_b", "a_b_1", "col", "a_b_2"]
    assert staging.snake("orderDate No.") == "order_date_no"
    with pytest.raises(ValueError):
        staging.guarded_sql(spark, "DROP TABLE x")
    with pytest.raises(ValueError):
        staging.guarded_sql(spark, "SELECT 1; DELETE FROM x")


def test_join_mart(spark):
    users = spark.createDataFrame([("u1", "Alice", 30), ("u2", "Bob", 25), ("u3", "Carol", 35)], "user_id string, name string, age int")
    orders = spark.createDataFrame([("o1", "u1", 100.0), ("o2", "u2", 200.0), ("o3", "u1", 50.0)], "order_id string, user_id string, amount double")
    got = marts.entity_summary(orders.withColumnRenamed("user_id", "buyer"), users, "buyer", "user_id", ["amount"]).collect()
    assert {r.name: r.sum_amount for r in got} == {"Alice": 150.0, "Bob": 200.0}
    edges = relate.detect({"users": users, "orders": orders}, {"users": "user_id", "orders": "order_id"})
    assert [(r.from_table, r.to_table, r.ref_integrity, r.rel_type) for r in edges.collect()] == [("orders", "users", 1.0, "many_to_one")]


def test_join_paths():
    edges = [Edge("a", "b_id", "b", "id"), Edge("b", "c_id", "c", "id"), Edge("d", "c_id", "c", "id")]
    assert [(e.from_table, f) for e, f in relate.find_path(edges, "a", "d")] == [("a", True), ("b", True), ("d", False)]
    with pytest.raises(ValueError):
        relate.find_path(edges, "a", "d", hops=2)


@pytest.fixture(scope="module")
def air(spark):
    start = datetime.date(2024, 1, 1)
    rows = [(start + datetime.timedelta(i), float(120 + (i % 5) * 2 if 90 <= i <= 100 else 50 + (i % 7) * 3), f"Zone {'AB'[i % 2]}", 10 + i % 5) for i in range(180)]
    return spark.createDataFrame(rows, "reading_date date, avg_value double, zone_name string, reading_count int")


def test_anomalies_of_a_spike(air):
    from pyspark.sql import functions as F

    found = insights.anomalies(insights.series(air, F.col("reading_date"), ["avg_value"]))
    rows = found.collect()
    assert rows and any(r.magnitude > 0 for r in rows) and {r.severity for r in rows} <= {"info", "warning", "critical"}
    for r in insights.with_significance(insights.streaks(found)).collect():
        assert 0 <= r.p_value <= 1 and r.first_t <= r.last_t
    values = [120 + (i % 5) * 2 if 90 <= i <= 100 else 50 + (i % 7) * 3 for i in range(180)]
    want = set()
    for i in range(60, 180):
        w = np.array(values[i - 59 : i + 1], float)
        if abs((values[i] - w.mean()) / w.std(ddof=1)) >= 2:
            want.add(i + 1)
    assert {r.i for r in rows} == want


def test_shift_and_correlation(spark):
    rng = random.Random(1)
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(hours=i), float(i), 2.0 * i + rng.gauss(0, 5), 50 + rng.gauss(0, 10)) for i in range(100)]
    df = spark.createDataFrame(rows, "t timestamp, x double, y double, z double")
    strong = {(r.a, r.b) for r in insights.strong_correlations(insights.correlations(df, ["x", "y", "z"])).collect()}
    assert strong == {("x", "y")}
    moved = {r.metric: r for r in insights.shifts(insights.halves(df, "t", ["x", "z"], "x")).collect()}
    assert moved["x"].severity == "critical" and moved["x"].n_early == 50
    assert "z" not in moved or moved["z"].p_value < 0.05


def test_p_values():
    # Values of Student's t that tables give for 5 % and 1 % two-sided.
    for t, df, p in ((2.228, 10, 0.05), (3.169, 10, 0.01), (1.96, 1e6, 0.05), (12.706, 1, 0.05)):
        assert abs(stats.t_two_sided(np.array([t]), np.array([df]))[0] - p) < 2e-4
    assert stats.t_two_sided(np.array([np.inf]), np.array([5.0]))[0] == 0
    assert math.isnan(stats.t_two_sided(np.array([1.0]), np.array([0.0]))[0])


def test_drift(spark):
    cols = "run_id bigint, table string, column string, dtype string, nullable boolean"
    a = spark.createDataFrame([(1, "orders", "order_id", "int64", False), (1, "orders", "price", "int64", True), (1, "orders", "legacy", "varchar", True), (1, "old", "x", "int64", True)], cols)
    b = spark.createDataFrame([(2, "orders", "order_id", "int64", True), (2, "orders", "price", "float64", True), (2, "orders", "created_at", "timestamp", True), (2, "new", "x", "int64", True)], cols)
    got = {(r.column, r.change, r.before, r.after) for r in drift.column_changes(a, b).collect()}
    assert got == {("order_id", "nullability_changed", "false", "true"), ("price", "type_changed", "int64", "float64"), ("created_at", "added", None, "timestamp"), ("legacy", "removed", "varchar", None)}
    assert {(r.table, r.change) for r in drift.table_changes(a, b).collect()} == {("new", "added"), ("old", "removed")}
    assert {r.change for r in drift.table_changes(a.limit(0), b).collect()} == {"added"}
    assert drift.latest_before(a.unionByName(b), 2).count() == 4 and drift.latest_before(a, 1).count() == 0
    first, same = drift.overview(a.limit(0), a).first(), drift.overview(a, a).first()
    assert (first.first_run, first.tables_added, first.no_changes) == (True, 2, False) and (same.first_run, same.no_changes) == (False, True)


def test_snapshots_read_values(spark):
    one = spark.createDataFrame([(1, "a", 0.5), (2, None, 1.5)], "id int, name string, x double")
    two = spark.createDataFrame([(2, None, 1.5), (1, "a", 0.5)], "id int, name string, x double")
    three = spark.createDataFrame([(1, "b", 0.5), (2, None, 1.5)], "id int, name string, x double")
    s = {n: drift.snapshot({"t": df}, i) for i, (n, df) in enumerate({"one": one, "two": two, "three": three}.items())}
    assert {(r.column, r.nullable, r.filled) for r in s["one"].collect()} == {("id", False, 2), ("name", True, 1), ("x", False, 2)}
    assert drift.rerun_summary(s["one"], s["two"]).first().unchanged == 1
    assert drift.rerun_summary(s["one"], s["three"]).first().updated == 1


def test_graph(spark):
    rows = [("complaints", "sites", 0.28), ("complaints", "zones", 1.0), ("sites", "zones", 1.0), ("sensors", "sites", 1.0), ("readings", "sensors", 1.0), ("readings", "sites", 1.0), ("incidents", "zones", 1.0), ("inspections", "sites", 1.0)]
    e = spark.createDataFrame(rows, "src string, dst string, ref_integrity double")
    assert {r.dst for r in graph.star_hubs(e).collect()} == {"zones", "sites"}
    assert [r.src for r in graph.weak_edges(e).collect()] == ["complaints"]
    assert ["readings", "sensors", "sites", "zones"] in [r.path for r in graph.chains(e).collect()]
    assert graph.shortest_path(e, "readings", "zones").first().path == ["readings", "sites", "zones"]
    assert graph.shortest_path(e, "readings", "nowhere").count() == 0
    assert {r.component for r in graph.components(e).collect()} == {"complaints"}


def test_components_of_long_paths(spark):
    e = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [("x", "y")], "src string, dst string")
    got = graph.components(e).collect()
    assert {r.component for r in got} == {"000", "x"} and len(got) == 63


def test_components_of_a_shuffled_path(spark):
    ids = [f"{i:03d}" for i in range(400)]
    random.Random(3).shuffle(ids)
    e = spark.createDataFrame([*zip(ids, ids[1:]), ("x", "x"), (None, "y")], "src string, dst string")
    got = {r.node: r.component for r in graph.components(e).collect()}
    assert got == {**{i: "000" for i in ids}, "x": "x"}


def test_kin(spark):
    rows = [("a", ["x", "y", "z"]), ("b", ["x", "y", "z", "w"]), ("c", ["x", "y"]), ("d", ["w", "z", "y"]), ("e", None)]
    df = spark.createDataFrame(rows, "k string, tokens array<string>")
    assert {(r.a, r.b, r.shared) for r in graph.kin(df, "k", "tokens").collect()} == {("a", "b", 3), ("b", "d", 3)}
    assert {(r.item, r.leader) for r in graph.kin_groups(df, "k", "tokens").collect()} == {("b", "a")}


def test_kin_groups_are_greedy(spark):
    chain = [("a", ["1", "2", "3"]), ("b", ["1", "2", "3", "4", "5", "6"]), ("c", ["4", "5", "6", "7", "8", "9"]), ("d", ["7", "8", "9"])]
    rng = random.Random(2)
    many = [(f"{i:02d}", [str(x) for x in rng.sample(range(14), 5)]) for i in range(60)]
    for rows in (chain, many):
        sets, free, want = {k: set(t) for k, t in rows}, {k for k, _ in rows}, {}
        for k in sorted(sets):
            if k in free:
                own = {j for j in free if j > k and len(sets[j] & sets[k]) >= 3}
                want |= dict.fromkeys(own, k)
                free -= own | {k}
        got = {r.item: r.leader for r in graph.kin_groups(spark.createDataFrame(rows, "k string, tokens array<string>"), "k", "tokens").collect()}
        assert got == want
    assert want and {r.item for r in graph.kin_groups(spark.createDataFrame(chain, "k string, tokens array<string>"), "k", "tokens").collect()} == {"b", "d"}


def test_labels_and_directed_paths(spark):
    c = spark.createDataFrame([("aqs_sites", "x"), ("aqs_daily", "x"), ("b_a", "y"), ("a_b", "y"), ("alone_a", "z")], "node string, component string")
    sizes = spark.createDataFrame([("b_a", 3), ("a_b", 9)], "node string, size int")
    assert {r.component: r.label for r in graph.cluster_labels(c, sizes).collect()} == {"x": "aqs", "y": "a_b", "z": "alone_a"}
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d")], "src string, dst string")
    assert graph.shortest_path(e, "d", "c", directed=True).first().path == ["c", "d"]
    assert graph.shortest_path(e, "a", "d", directed=True).count() == 0 and graph.shortest_path(e, "a", "d").first().path == ["a", "b", "c", "d"]


def test_health(spark):
    rows = [("t", "id", 10, 0, 10, 0.0, 1.0), ("t", "empty", 10, 10, 0, 1.0, 0.0), ("t", "same", 10, 0, 1, 0.0, 0.1), ("t", "some", 10, 1, 5, 0.1, 0.5556), ("t", "nested", 10, 0, None, None, None)]
    p = spark.createDataFrame(rows, "table string, column string, row_count bigint, null_count bigint, distinct_count bigint, null_rate double, uniqueness_ratio double")
    got = {(r.column, r.issue, r.severity) for r in health.column_issues(p).collect()}
    assert got == {("id", "unexpected_uniqueness", "info"), ("empty", "empty_column", "error"), ("same", "constant_column", "warning"), ("some", "high_nulls", "warning")}
    unique = spark.createDataFrame([("t", "code", 5, 0, 5, 0.0, 1.0), ("t", "x_id", 5, 0, 5, 0.0, 1.0), ("t", "one", 1, 0, 1, 0.0, 1.0)], p.schema)
    assert {(r.column, r.issue) for r in health.column_issues(unique).collect()} == {("code", "unexpected_uniqueness"), ("one", "constant_column")}


def test_decisions_by_source_and_artifact(spark):
    rows = [("column", "a.t.c", "description_accepted", None)] * 4 + [("column", "b.t.c", "locked", None), ("column", "a.t.c", "seen", None), ("model", "a.m", "edited", '{"edit_distance": 2}'), ("model", "a.m", "edited", "{}"), ("model", "b.m", "locked", '{"edit_distance": 9}'), ("contract", "1", "false_positive", None), ("contract", "2", "acknowledged", None)]
    log = spark.createDataFrame(rows, "artifact_type string, artifact_id string, action string, payload string")
    contracts = spark.createDataFrame([("1", "stg_a"), ("2", "stg_b")], "id string, model_name string")
    assert tuple(health.acceptance_rate(log).first()) == (4, 5, 0.8) and tuple(health.acceptance_rate(log, "a").first()) == (4, 4, None)
    assert tuple(health.mean_edit_distance(log).first()) == (2.0, 1) and tuple(health.mean_edit_distance(log, "b").first()) == (None, 0)
    assert tuple(health.contract_precision(log).first()) == (1, 2, 0.5) and tuple(health.contract_precision(log, contracts, "b").first()) == (0, 1, 1.0)


def test_similarity(spark):
    rows = [(1, [0.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, [0.0, 0.5], "b"), (4, [5.0, 5.0], "a")]
    df = spark.createDataFrame(rows, "id int, v array<double>, kind string")
    near = similarity.nearest(df.where("id = 1"), df, 2)
    assert [(r.id, r.distance) for r in near.orderBy("rank").collect()] == [(3, 0.25), (2, 1.0)]
    assert [r.id for r in similarity.nearest(df.where("id = 1"), df, 1, equal=["kind"]).collect()] == [2]
    assert similarity.match_confidence(near).where("id = 2").first().confidence == 0.3
    docs = spark.createDataFrame([(1, "Pump guide", "pump pump valve", "local"), (2, "Other", "valve valve", "global")], "doc_id int, title string, text string, scope string")
    terms = spark.createDataFrame([("pump",), ("valve",)], "term string")
    got = {(r.doc_id, r.term): r.confidence for r in terms_of.match_terms(docs, terms, scope="scope").collect()}
    assert got == {(1, "pump"): 0.9, (2, "pump"): 0.5, (2, "valve"): 0.7}


def test_terms_within_words(spark):
    docs = spark.createDataFrame([(1, "Reordering", "x"), (2, None, "orders, orders"), (3, "", "reorder reorder"), (4, "", "насосы и насос"), (5, "泵", None), (6, "", "only one order"), (None, "", "or or")], "doc_id int, title string, text string")
    terms = spark.createDataFrame([("Order",), ("насос",), ("泵",), ("or",), ("",), (None,)], "term string")
    got = {(r.doc_id, r.term): r.confidence for r in terms_of.match_terms(docs, terms).collect()}
    assert got == {(1, "order"): 0.9, (1, "or"): 0.9, (2, "order"): 0.7, (2, "or"): 0.7, (3, "order"): 0.7, (3, "or"): 0.7, (4, "насос"): 0.7, (5, "泵"): 0.9, (None, "or"): 0.7}


def test_synonyms_of_flat_rows(spark):
    rows = [("a", "Name"), ("b", " name "), ("b", "name"), ("c", "other"), ("c", "Other"), ("d", ""), ("e", None)]
    got = similarity.synonym_collisions(spark.createDataFrame(rows, "item string, synonym string")).collect()
    assert [(r.synonym, r.n_items) for r in got] == [("name", 2)]


def test_files(spark, tmp_path):
    (tmp_path / "b.csv").write_text("id,day\n1,2024-01-05\n2,2024-01-06\n")
    (tmp_path / "a.json").write_text('{"x": 1}\n{"x": 2, "y": {"z": 3}}\n')
    assert list(files.load_folder(spark, str(tmp_path), "csv")) == ["b"]
    assert files.read_csv(spark, str(tmp_path / "b.csv")).dtypes == [("id", "int"), ("day", "date")]
    assert files.read_ndjson(spark, str(tmp_path / "a.json")).count() == 2
    df = spark.range(1000)
    assert files.sample_exact(df, 10, "id").collect() == files.sample_exact(df.repartition(7), 10, "id").collect()


def test_numeric_by_rank_and_in_task(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(rng.integers(0, 50)), float(rng.normal()) if i % 9 else None, float("nan")) for i in range(500)], "a double, b double, c double")
    one, two = ({r.column: r for r in profile.numeric(df, most=m).collect()} for m in (None, 60))
    assert set(one) == set(two) == {"a", "b"}
    for c in one:
        assert [one[c][n] for n in ("min_value", "max_value", "p25", "median", "p75", "p95")] == pytest.approx([two[c][n] for n in ("min_value", "max_value", "p25", "median", "p75", "p95")])


def test_long_texts_are_grouped_by_digest(spark):
    df = spark.createDataFrame([("x" * 5000,), ("x" * 5000,), ("y" * 5000,), ("short",), (None,)], "t string")
    freq = profile.frequencies(df).collect()
    assert max(len(r.value or "") for r in freq) < 60 and profile.universal(profile.frequencies(df)).first().distinct_count == 3
    assert profile.profile(df, "t").first().max_length == 5000


def test_terms_that_hold_a_title(spark):
    docs = spark.createDataFrame([(1, "pump", "x"), (2, "", "x")], "doc_id int, title string, text string")
    got = terms_of.match_terms(docs, spark.createDataFrame([("water pumps",), ("pum",), ("valve",)], "term string")).collect()
    assert {(r.doc_id, r.term, r.confidence) for r in got} == {(1, "water pumps", 0.9), (1, "pum", 0.9)}


def test_materialize(spark):
    sinks.ensure_database(spark, "tablewise_test")
    good = sinks.materialize(spark.range(7), "tablewise_test.seven")
    assert good.success and good.row_count == 7 and sinks.table_exists(spark, "tablewise_test.seven")
    bad = sinks.materialize(spark.range(3).selectExpr("assert_true(id < 1) AS x"), "tablewise_test.bad")
    assert not bad.success and bad.error


def test_metrics(items):
    assert metrics.aggregate_for("total_amount") == "sum" and metrics.aggregate_for("error_rate") == "avg" and metrics.aggregate_for("x") == "avg"
    got = metrics.metric_by(items, [metrics.ratio("share", "count(name)", "count(*)")], ["category"], {"category": "electronics"}).first()
    assert got.share == 0.5


def test_stream_checks(spark, tmp_path, items):
    from tablewise.streaming.checks import check_stream

    items.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(items.schema).parquet(str(tmp_path / "in"))
    check_stream(stream, [Rule("name", "not_null", "name")], str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg({"observed": "sum"}).first()[0] == 1


def test_percentiles_by_rank(spark):
    rng = np.random.default_rng(0)
    rows = [(c, float(v), int(n)) for c in "ab" for v, n in zip(rng.permutation(500), rng.integers(1, 9, 500))] + [("c", 7.0, 1)]
    values = spark.createDataFrame(rows, "column string, v double, n bigint")
    got = {r.column: r for r in profile.percentiles_by_rank(values, parts=7).collect()}
    for c in "abc":
        flat = np.repeat([v for k, v, _ in rows if k == c], [n for k, _, n in rows if k == c])
        for name, p in profile.CUTS:
            assert got[c][name] == pytest.approx(np.percentile(flat, 100 * p))


def test_nearest_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(i % 7), float(i % 5), 0.0], "a") for i in range(60)] + [(100 + i, rng.normal(size=3).tolist(), "ab"[i % 2]) for i in range(140)] + [(300, None, "a"), (301, [1.0, None, 2.0], "a"), (302, [1.0, 2.0], "a"), (303, [1.5, 2.0], "a")]
    df = spark.createDataFrame(rows, "id int, v array<double>, kind string")
    for cells in (1_000_000, 60):
        monkeypatch.setattr(similarity, "BLOCK_CELLS", cells)
        for equal in (None, ["kind"]):
            got = {}
            for r in similarity.nearest(df, df, 3, equal=equal).orderBy("query_id", "rank").collect():
                got.setdefault(r.query_id, []).append(r.id)
            for i, v, kind in rows:
                near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w, k in rows if j != i and v and w and None not in v and None not in w and len(v) == len(w) and (equal is None or k == kind)) if v else []
                assert got.get(i, []) == [j for _, j in near[:3]]
