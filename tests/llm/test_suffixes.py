import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from brute import brute_repeats

from tablewise.llm import suffixes
from tablewise.llm.suffixes import Sizes


def found(df, sizes=Sizes()):
    rows = suffixes.remove_repeats(df, sizes=sizes).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    return sorted((2**63 - 1 if r[0] is None else r[0], *r[1:]) for r in rows)


@pytest.mark.parametrize("sizes", [Sizes(), Sizes(part=30_000, block=3_000), Sizes(part=100_000, bits=4)])
def test_documents(spark, sf, sizes):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(docs, sizes) == brute_repeats([(r.doc_id, r.text) for r in docs.collect()])


def random_rows(seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("abé ") for _ in range(3000))
    rows = []
    for i in range(60):
        text = "".join(base[a : a + rng.randint(10, 200)] + rng.choice(["", "x", "yz"]) for a in (rng.randrange(2900) for _ in range(rng.randint(0, 6))))
        rows.append((rng.choice([i, i, 7, None]), text if rng.random() < 0.95 else None))
    return rows + [(100, "a" * 500), (101, "a" * 300 + "b"), (5, "a" * 49), (102, "a" * 50), (103, ""), (104, "\0" * 120), (105, "\0" * 90 + "z")]


@pytest.mark.parametrize("seed", range(3))
def test_random_overlaps(spark, seed):
    rows = random_rows(seed)
    want = brute_repeats(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert found(df, Sizes(part=1_000, block=200, strings=100)) == want
    # Hashes that all but always collide must not decide anything.
    assert found(df, Sizes(part=1_000, bits=1)) == want


def test_frequent_heads_are_divided(spark):
    """One head before many different texts, and one suffix in many documents, over many buckets."""
    rng = random.Random(3)
    line = "=" * 40 + " the same line stands in every document here "
    rows = [(i, line + "".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) + "=" * 30 + rng.choice(["x", "y"]) * 30) for i in range(0, 4000, 20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    assert found(df, Sizes(part=300, sample=20_000)) == brute_repeats(rows)


def test_boundaries_leave_little_open(spark, sf):
    """Buckets settle nearly all strings; only those that agree with a splitter go further."""
    rng = np.random.default_rng(1)
    text = np.concatenate([np.zeros(32, np.uint8), rng.integers(97, 99, 400).astype(np.uint8), np.zeros(64, np.uint8)])
    size, ahead = np.full(20, 60), np.full(20, 10)
    runs = suffixes.Suffixes(text, 32 + np.arange(20) * 7 + 10, ahead, size)
    order, group = runs.order()
    keys = [bytes(k) for k in runs.keys(order)]
    assert keys == sorted(keys) and len(set(group)) == len(set(keys))
    words = [runs.after(k, order) for k in range(7)]
    common = suffixes.common_prefix([w[1:] for w in words], [w[:-1] for w in words])
    assert common.tolist() == [next((i for i in range(50) if a[i] != b[i]), 50) for a, b in zip(keys[1:], keys)]


def test_tables(spark, odd_docs):
    got = suffixes.remove_repeats(odd_docs)
    assert got.columns == [*odd_docs.columns, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert got.dtypes[: len(odd_docs.columns)] == odd_docs.dtypes
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].text == "" and rows[1].n_bytes == 0 and rows[4].n_removed == 0 and rows[7].text.startswith("ñandú") and rows[7].home == [1]
    assert suffixes.remove_repeats(odd_docs.limit(0)).count() == 0


def test_clashing_columns(spark):
    rows = [(1, "k" * 30 + "m" * 51, 7, 7, 7, "x"), (2, "k" * 30 + "m" * 51, 7, 7, 7, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    assert found(df) == brute_repeats([r[:2] for r in rows])
    named = suffixes.remove_repeats(df, figures=("a", "b", "c", "d"))
    assert named.columns == [*df.columns, "a", "b", "c", "d"]
    assert sorted((r.n_removed, r.b) for r in named.collect()) == [(7, 0), (7, 81)]


def test_multikey_order():
    rng = np.random.default_rng(0)
    columns = [rng.integers(0, 3, 500).astype(np.uint64) for _ in range(3)]
    order, group = suffixes.multikey_order([lambda r, c=c: c if r is None else c[r] for c in columns])
    keys = [tuple(int(c[i]) for c in columns) for i in order]
    assert keys == sorted(keys)
    assert all((a == b) == (g == h) for a, b, g, h in zip(keys, keys[1:], group, group[1:]))


def test_every_string_has_one_anchor():
    rng = np.random.default_rng(2)
    text = bytes(rng.integers(97, 100, 2000).astype(np.uint8))
    runs = lambda t, block: suffixes.find_runs(np.frombuffer(t, np.uint8), np.array([len(t)]), block)
    first, last, anchor, _ = runs(text, 1 << 18)
    assert first[0] == 0 and (last[:-1] + 1 == first[1:]).all() and last[-1] == len(text) - suffixes.LENGTH
    at = {text[p : p + 50]: a - p for a, f, l in zip(anchor, first, last) for p in range(f, l + 1)}
    for f, l, a in zip(*runs(b"zz" + text[5:], 100)[:3]):
        for p in range(max(f, 2), l + 1):
            assert at[text[p + 3 : p + 53]] == a - p


def test_equal_runs_take_little_memory():
    """Two copies of a megabyte: their runs' bytes are compared a few at a time."""
    body = np.random.default_rng(2).integers(97, 123, 1_000_000).astype(np.uint8).tobytes().decode()
    part = suffixes.Part(pa.table({"doc": [1, 2], "text": [body, body]}), 1, Sizes())
    keep = np.arange(len(part.first))
    tracemalloc.start()
    try:
        gone = suffixes._equal_runs(part, keep, 63)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # Blocks cut a few runs of the two copies in different places.
    assert most < 60e6 and not gone[part.row == 0].any() and gone.sum() > 0.99 * (part.row == 1).sum()
