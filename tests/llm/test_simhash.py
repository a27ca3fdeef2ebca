import numpy as np
import pytest
import xxhash
from brute import brute_components

from tablewise.llm import simhash
from tablewise.operators.graph import components


def test_fingerprint_by_hand():
    words = [b"a", b"b\xc3\x89", b"c", b"a", b"b\xc3\x89", b"c"]
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(4)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) > 2)
    assert simhash.fingerprint("A bÉ\tC\x0ba  bÉ c\n") == want
    assert simhash.fingerprint("One two") == xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \r\n") == 0


def test_blocks_do_not_change_fingerprints(monkeypatch):
    text = " ".join(f"w{i % 17}" for i in range(500))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text) == whole


def test_keys_meet_for_up_to_three_errors():
    rng = np.random.default_rng(0)
    fp = rng.integers(-(2**63), 2**63 - 1, 3000, dtype=np.int64)
    other = fp.copy()
    for _ in range(3):
        other ^= np.int64(1) << rng.integers(0, 64, 3000)
    own, fuzzy = simhash.keys(other, False), simhash.keys(fp, True)
    assert own.shape[1] == 10
    assert all(set(f[f >= 0]) & set(o[o >= 0]) for f, o in zip(fuzzy, own))


@pytest.mark.parametrize("hot", [5_000, 2])
def test_components_against_all_pairs(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = np.random.default_rng(1)
    fps = list(rng.integers(0, 2**63, 40, dtype=np.int64))
    for k in range(160):
        fps.append(fps[rng.integers(0, len(fps))] ^ np.bitwise_or.reduce(np.int64(1) << rng.integers(0, 64, rng.integers(0, 6)), initial=0))
    fps = [int(f) for f in fps]
    reps = spark.createDataFrame([(f,) for f in sorted(set(fps))], "fp bigint")
    roots = {r.node: r.component for r in components(simhash.links(reps).toDF("src", "dst")).collect()}
    got = [roots.get(f, f) for f in sorted(set(fps))]
    want = brute_components(sorted(set(fps)), [f & (2**64 - 1) for f in sorted(set(fps))])
    assert got == want


def test_tables(spark, odd_docs, sf):
    got = {r.doc_id: r for r in simhash.near_duplicates(odd_docs).collect()}
    assert got[1].component_id == got[2].component_id == got[6].component_id == 1 and got[1].fingerprint == "0" * 16
    assert got[3].component_id == 3
    assert simhash.near_duplicates(odd_docs.limit(0)).count() == 0
    rows = simhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).orderBy("doc_id").collect()
    assert [r.component_id for r in rows] == brute_components([r.doc_id for r in rows], [int(r.fingerprint, 16) for r in rows])


def test_links_through_rows_without_or_with_one_id(spark, monkeypatch):
    """Fingerprints 0, 7 and 63 link in a row, whatever ids they have."""
    chain = {"a": 0, "b": 7, "c": 63, "d": 1 << 40 | 0xFFFFFF}
    table = lambda rows: spark.createDataFrame(rows, "doc_id bigint, fp bigint")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, text, key: docs.select("doc_id", "fp"))
    got = simhash.near_duplicates(table([(1, chain["a"]), (None, chain["b"]), (9, chain["c"])])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (None, 1), (9, 1)}
    got = simhash.near_duplicates(table([(5, chain["a"]), (5, chain["d"]), (7, chain["d"]), (6, chain["c"]), (None, 1 << 62 | 0xFF0F0F0F0F)])).collect()
    assert sorted((str(r.doc_id), int(r.fingerprint, 16), str(r.component_id)) for r in got) == sorted([("5", chain["a"], "5"), ("5", chain["d"], "5"), ("7", chain["d"], "5"), ("6", chain["c"], "6"), ("None", 1 << 62 | 0xFF0F0F0F0F, "None")])


def test_one_frequent_fingerprint(spark):
    docs = spark.createDataFrame([(i, "the same text in many rows here") for i in range(500, 0, -1)] + [(1000 + i, f"another text {i} entirely {i * i} of its own {i % 7}") for i in range(50)], "doc_id bigint, text string").selectExpr("*", "1 AS component_id", "2 AS n")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert {got[i] for i in range(1, 501)} == {1} and len(got) == 550


def test_probes_are_not_broadcast(spark):
    """Some 197 rows of keys come from a fingerprint, which Spark's sizes don't know."""
    reps = spark.range(2_000).selectExpr("xxhash64(id) AS fp")
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) == 10 << 20
    plan = simhash.links(reps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
