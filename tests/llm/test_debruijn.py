import random

import numpy as np
import pytest
from brute import brute_windows

from tablewise.llm import debruijn
from tablewise.llm.debruijn import Sizes


def found(df, sizes=Sizes()):
    rows = debruijn.remove_repeats(df, sizes=sizes).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    return sorted((2**63 - 1 if r[0] is None else r[0], *r[1:]) for r in rows)


@pytest.mark.parametrize("sizes", [Sizes(), Sizes(part=30_000, block=2_000), Sizes(part=100_000, hot=0)])
def test_documents(spark, sf, sizes):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(docs, sizes) == brute_windows([(r.doc_id, r.text) for r in docs.collect()])


def random_rows(seed):
    rng = random.Random(seed)
    base = [rng.choice("abé") for _ in range(900)] + ["w%d" % rng.randint(0, 40) for _ in range(900)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            a = rng.randrange(1700)
            words += base[a : a + rng.randint(30, 120)] + [rng.choice(["", "x", "yz"])]
        rows.append((rng.choice([i, i, 7, None]), rng.choice([" ", "\t", " \n "]).join(words) if rng.random() < 0.95 else None))
    return rows + [(100, "a " * 500), (101, "a " * 300 + "b"), (5, "a " * 49), (102, " a" * 50), (103, ""), (104, "\0 " * 120), (105, " \0" * 90 + "z"), (106, " \t\r\n"), (107, "a b " * 60), (108, "a b " * 70)]


@pytest.mark.parametrize("seed", range(3))
def test_random_overlaps(spark, seed):
    rows = random_rows(seed)
    want = brute_windows(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert found(df, Sizes(part=1_500, block=200)) == want
    assert found(df, Sizes(part=1_500, hot=2)) == want


def test_spans_name_their_source(spark):
    passage = " ".join(f"w{i}" for i in range(120))
    df = spark.createDataFrame([(3, "before " + passage + " after"), (1, "one two " + passage), (2, passage + " other end")], "doc_id bigint, text string")
    rows = sorted(tuple(r) for r in debruijn.repeated_spans(df).collect())
    assert rows == [(2, 0, 120, 1, 2), (3, 1, 120, 1, 2)]


def test_a_path_is_one_row_however_long(spark):
    """Copies that differ in a word have a path on either side of it, not a row a window."""
    words = [f"w{i}" for i in range(3000)]
    other = words.copy()
    other[1500] = "changed"
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(other))], "doc_id bigint, text string")
    rows = debruijn.repeated_spans(df).collect()
    assert sorted((r.doc, r.start, r.words) for r in rows) == [(2, 0, 1500), (2, 1451, 99), (2, 1501, 1499), (3, 0, 1500), (3, 1501, 1499)]


def test_hot_passages(spark):
    """One line before many different texts, and one long passage in every document."""
    rng = random.Random(4)
    line, passage = " ".join(f"l{i}" for i in range(20)), " ".join(f"p{i}" for i in range(70))
    rows = [(i, " ".join([line, *(rng.choice("ab") for _ in range(rng.randint(0, 60))), passage, *(rng.choice("ab") for _ in range(40)), line])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    want = brute_windows(rows)
    assert found(df, Sizes(part=2_000, hot=10)) == want == found(df)


def test_odd_documents(spark, odd_docs):
    got = debruijn.remove_repeats(odd_docs)
    assert set(got.columns) == {*odd_docs.columns, "n_words", "n_removed", "kept_sha256"} and got.count() == odd_docs.count()
    clash = odd_docs.selectExpr("*", "7 AS n_words", "map(1, 2) AS `doc`", "'x' AS part")
    assert sorted(r.n_words for r in debruijn.remove_repeats(clash).collect()) == sorted(r.n_words for r in got.collect())
    assert found(odd_docs) == brute_windows([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert debruijn.remove_repeats(odd_docs.limit(0)).count() == 0


def test_anchors_are_the_first_smallest():
    h = np.random.default_rng(0).integers(0, 50, 400).astype(np.uint64) << np.uint64(40)
    for block in (64, 1 << 18):
        assert debruijn.anchors(h, 39, block).tolist() == [p + int(np.argmin(h[p : p + 39])) for p in range(len(h) - 38)]


def test_parts_of_few_words_have_no_windows():
    import pyarrow as pa

    from tablewise.llm.debruijn import Part

    for text in ("one two three", "", "w " * 49):
        part = Part(pa.table({"doc": pa.array([1], pa.int64()), "text": [text]}), Sizes())
        assert len(part.first) == len(part.edge) == 0
