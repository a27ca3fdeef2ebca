import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
from brute import brute_near_copies
from pyspark.sql import functions as F

import corpus_pipeline
from tablewise.llm import common, shingles, simhash
from tablewise.operators import graph


def cut(text):
    words = text.split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def brute_kept(rows):
    """Smallest id of each group of texts at similarity 0.8 or more, directly or through others."""
    group = {i: i for i, _ in rows}
    rows = [(i, cut(t)) for i, t in rows]
    for i, a in rows:
        for j, b in rows:
            if i < j and len(a & b) >= 0.8 * len(a | b):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if g == old else g for k, g in group.items()}
    return sorted(set(group.values()))


def test_stage_finds_copies_at_four_fifths(spark):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        words = [rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(300)]
        rows.append((len(rows), " ".join(words)))
        for changed in (3, 6, 8):  # similarity about 0.9, 0.8 and 0.77
            for at in rng.sample(range(300), changed):
                words[at] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, df, "")
    assert sorted(r.doc_id for r in got.collect()) == brute_kept(rows)


def test_chain_beside_a_hub(spark):
    """Members of a key that only meet through others than its smallest are found too."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[20 * k : 20 * k + 200])) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert brute_kept(rows) == [0] and len({r.component for r in shingles.near_copies(df).collect()}) == 1


def test_recall_of_keys_at_four_fifths():
    rng, met = np.random.default_rng(6), 0
    for _ in range(300):
        whole = rng.integers(0, 1 << 64, 500, dtype=np.uint64)
        a, b = whole[:450], whole[50:]  # 400 of 500 in common
        low = [shingles.minima(x) for x in (a, b)]
        met += bool(set(shingles.band_keys(low[0])) & set(shingles.band_keys(low[1])))
    assert met >= 299


def test_sketches_keep_similar_sets_and_drop_others(spark):
    """Values that differ are counted four bits at a time; pairs at 0.8 stay below the bound, and most at 0.3 don't."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(60):
        whole = rng.integers(0, 1 << 64, 600, dtype=np.uint64)
        for name, a, b in (("like", whole[:540], whole[60:]), ("unlike", whole[:390], whole[210:])):
            lows = [shingles.minima(x) for x in (a, b)]
            rows.append((name, int(((lows[0] ^ lows[1]) & np.uint64(15) != 0).sum()), *[shingles.sketch(x).view(np.int64).tolist() for x in lows]))
    df = spark.createDataFrame(rows, "kind string, n int, a array<bigint>, b array<bigint>")
    got = df.select("kind", "n", shingles.unlike(df.a, df.b).alias("m")).collect()
    assert all(r.n == r.m for r in got)
    assert max(r.m for r in got if r.kind == "like") <= shingles.MOST_UNLIKE - 10
    assert sum(r.m > shingles.MOST_UNLIKE for r in got if r.kind == "unlike") > 50


def test_bitmaps_never_count_more_than_the_sets_differ(spark):
    """Bits that differ are at most the shingles of one set only, widths folded; near the limit they tell pairs apart."""
    rng, rows = np.random.default_rng(3), []
    for n in (0, 1, 16, 17, 60, 130, 500, 1000, 20_000):
        for lost in (0, 0.05, 0.1, 0.2, 0.5, 0.9):
            whole = rng.integers(0, 1 << 64, 2 * n, dtype=np.uint64)
            a, b = whole[:n], whole[int(n * lost) : int(n * (1 + lost * rng.choice([0.2, 1])))]
            rows.append((len(a), len(b), len(np.setxor1d(a, b)), *[shingles.odd_bits(x).tolist() for x in (a, b)]))
    df = spark.createDataFrame(rows, "x int, y int, truth int, a array<bigint>, b array<bigint>")
    apart = shingles.unmatched(df.a, df.b, df.x, df.y)
    for turned in (df.select("x", "y", "truth", apart.alias("d"), shingles.can_link(apart, df.x, df.y).alias("near")), df.select("x", "y", "truth", shingles.unmatched(df.b, df.a, df.y, df.x).alias("d"), F.lit(None).alias("near"))):
        for r in turned.collect():
            assert r.d <= r.truth
            if r.near is not None:
                assert r.near or 9 * r.truth > r.x + r.y
                assert not r.near or r.x > 16_384 or 9 * r.truth <= 1.6 * (r.x + r.y)


def test_large_group_of_near_copies_makes_few_rows(spark):
    """Variants of one text that are less than 0.8 alike share keys: rows of candidates follow the group's size, not its square."""
    made = []
    for count in (150, 300):
        rng = random.Random(5)
        base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        rows = []
        for i in range(count):
            words = list(base)
            for at in rng.sample(range(150), rng.choice([1, 1, 2, 2, 3, 4, 6])):
                words[at] = f"new{rng.randrange(10**6)}"
            rows.append((i, " ".join(words)))
        sent = []
        stored = shingles._verified
        shingles._verified = lambda pairs, *rest: (sent.append(pairs.count()), stored(pairs, *rest))[1]
        try:
            got = shingles.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        finally:
            shingles._verified = stored
        want, first = brute_near_copies([i for i, _ in rows], [t for _, t in rows]), {}
        for r in sorted(got, key=lambda r: r.doc):
            first.setdefault(r.component, r.doc)
        assert [first[r.component] for r in sorted(got, key=lambda r: r.doc)] == want
        made.append(sum(sent))
    assert made[0] < 150 * 149 / 4 and made[1] < 3 * made[0]


def test_fingerprints_find_candidates_and_sets_decide(spark, monkeypatch):
    """Texts link by their SimHash where they share no other key, and only if their sets are similar."""
    words = [f"w{i}" for i in range(600)]
    near, far = [*words, "more"], ["x y z"] * 400
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join([*far, *(f"a{i}" for i in range(9))])), (4, " ".join([*far, *(f"b{i}" for i in range(9))])), (5, " ".join(reversed(words)))]
    fp = {i: simhash.fingerprint(t) for i, t in rows}
    assert (fp[1] ^ fp[2]).bit_count() <= 3 and (fp[3] ^ fp[4]).bit_count() <= 3
    whole = shingles._prints
    monkeypatch.setattr(shingles, "_prints", lambda texts: whole(texts).withColumn("keys", F.expr("slice(keys, 1, 0)")))
    got = {r.doc: r.component for r in shingles.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == got[2] and len(set(got.values())) == 4


def test_sieve_loses_nothing_and_keeps_most_others_out(spark):
    from pyspark.sql import functions as F

    from tablewise.llm.common import sieve, sifted

    for n in (0, 1, 3000, 30_000):
        rows = spark.range(60_000).withColumn("h", F.xxhash64("id"))
        marks = sieve(rows.where(F.col("id") < n).select("h"), n)
        got = sifted(rows, F.col("h"), marks, "near").groupBy((F.col("id") < n).alias("own"), "near").count().collect()
        found = {(r.own, r.near): r["count"] for r in got}
        assert found.get((True, True), 0) == n and (True, False) not in found and found.get((False, True), 0) < 0.1 * 60_000


class Caught:
    """A frame that hands out the function it should run."""

    def mapInArrow(self, function, schema):
        return function


def held(run, batch):
    """Bytes that a task holds at most beyond its input."""
    tracemalloc.start()
    try:
        for _ in run(iter([batch])):
            pass
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_tasks_hold_few_sets_at_once():
    """A worker's memory doesn't follow the rows of a batch."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdefgh", k=200)) for _ in range(3000)]
    batch = pa.record_batch({"doc": pa.array(range(3000)), "digest": pa.array(map(str, range(3000))), "text": pa.array(texts)})
    run = shingles._prints(Caught())
    assert held(run, batch) < 2 * held(run, batch.slice(0, 600))
    run, batch = shingles._sets(Caught()), batch.select(["text"])
    assert held(run, batch) < 2 * held(run, batch.slice(0, 600))


def test_tasks_give_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    assert list(common.map_batches(Caught(), lambda batches: batches, "a int")(iter([1, 2]))) == [1, 2]
    assert calls == [1]


def below_broadcasts(plan):
    """The operators whose rows a plan broadcasts."""
    found, depth = [], None
    for line in plan.splitlines():
        at = len(re.match(r"[\s:+*()\d-]*", line)[0])
        if depth is not None and at > depth:
            found.append(line[at:].split()[0])
        else:
            depth = at if line[at:].startswith("BroadcastExchange") else None
    return found


def test_nothing_that_grew_is_broadcast(spark, sf, monkeypatch):
    """Spark sizes what Python or an explode makes of a row as that row, so it must not choose by this."""
    plans = []
    for module in (shingles, simhash, graph, common, corpus_pipeline):
        monkeypatch.setattr(module, "stored", lambda df, plain=module.stored: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.keep_one_of_each(spark, docs, sf).count() < docs.count()
    sent = {x for p in plans for x in below_broadcasts(p)}
    assert len(plans) > 20 and sent and not sent & {"MapInArrow", "Generate"}
