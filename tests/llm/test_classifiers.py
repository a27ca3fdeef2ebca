import math
import zlib

import numpy as np
import pytest

from tablewise.llm import langid, quality, toxicity
from tablewise.llm.common import labelled_sample

BIG = "/root/testdata/sf0.1"


def area(truth, score):
    """Area under the curve by ranks."""
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    ones = truth.sum()
    return (rank[truth == 1].sum() - ones * (ones + 1) / 2) / ones / (len(truth) - ones)


@pytest.fixture(scope="module")
def big(spark):
    return spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")


@pytest.mark.parametrize("module, label, modulus, left", [(toxicity, "toxic", 5, 0), (quality, "quality", 4, 2)])
def test_held_out_accuracy(big, module, label, modulus, left):
    docs, labels = big
    got = module.score(docs, labels).join(labels, "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % modulus == left)).all()
    test = got[got.held_out]
    assert area(test[label].to_numpy(), test.score.to_numpy()) > (0.95 if module is toxicity else 0.99)
    assert (test.predicted == test[label]).mean() > 0.95


def test_held_out_languages(big):
    docs, _ = big
    got = langid.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97


def test_misspellings_share_subwords():
    rng = np.random.default_rng(0)
    clean = [" ".join(rng.choice(["tree", "river", "stone", "cloud", "grass", "meadow"], 30)) for _ in range(150)]
    rude = [t + " " + str(rng.choice(["horriblex", "awfulness"])) for t in clean]
    row_margin, bias = toxicity.train(clean + rude, np.array([0] * 150 + [1] * 150))
    scorer = toxicity.Scorer(row_margin, bias)
    a, b, c, empty = scorer.score(["tree stone " * 50, "tree stone " * 50 + "horriblexx", "tree stone " * 50 + "hxorriblex", None])
    assert a < 0.5 < b and c > a and 0 <= empty <= 1


def test_gradients_by_differences():
    weights = {k: v.astype(float) for k, v in langid.init(3).items()}
    x, y = np.random.default_rng(1).integers(97, 101, (4, 5)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, found = langid.gradients(weights, x, y)
    for name, g in found.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        kept, ends = weights[name][at], []
        for step in (1e-3, -1e-3):
            weights[name][at] = kept + step
            ends.append(langid.gradients(weights, x, y)[0])
        weights[name][at] = kept
        assert (ends[0] - ends[1]) / 2e-3 == pytest.approx(g[at], rel=1e-2)


def test_blocks_do_not_change_quality(monkeypatch):
    texts = ["a b c d | e", None, "x Y!! z z z 9", "", "one two"]
    scorer = quality.Scorer(np.random.default_rng(0).normal(size=quality.BUCKETS + 1).astype(np.float32))
    whole = scorer.score(texts)
    monkeypatch.setattr(quality, "BLOCK_WORDS", 2)
    assert np.allclose(scorer.score(texts), whole)
    f = quality.Features()
    rows, value = quality.vector(f, texts[0])
    assert 1 / (1 + np.exp(-(scorer.weights[rows] @ value + scorer.weights[-1]))) == pytest.approx(whole[0], rel=1e-5)


def naive_gru(w, data):
    """Language distributions of every byte, one position and one direction at a time."""
    n = langid.HIDDEN
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    states = np.zeros((2, len(data), n))
    for k, order in ((0, range(len(data))), (1, reversed(range(len(data))))):
        h = np.zeros(n)
        for t in order:
            g, a = w["byte"][k][data[t]].astype(float), h @ w["state"][k].astype(float)
            z, r = sigmoid(g[:n] + a[:n]), sigmoid(g[n : 2 * n] + a[n : 2 * n])
            c = np.tanh(g[2 * n :] + r * a[2 * n :])
            h = z * h + (1 - z) * c
            states[k, t] = h
    logits = states[0] @ w["out"][:n] + states[1] @ w["out"][n:] + w["bias"]
    p = np.exp(logits - logits.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def test_languages_against_a_plain_forward_pass():
    w = langid.init(3)
    texts = ["Straße 12, ÇA va?", None, "12 34", "x", "The quick brown fox; " * 40, "ab " * 75]
    best, score = langid.read(w, 3, texts)
    for text, b, p in zip(texts, best, score):
        if not text or not any(c.isalpha() for c in text):
            assert (b, p) == (-1, 0)
            continue
        data = text.lower().encode()
        total, seen = np.zeros(3), np.zeros(len(data), int)
        for begin, end, first, stop in langid.windows(len(data)):
            assert begin <= first < stop <= end and (end - begin) % langid.STEP == 0 or (begin, end) == (0, len(data))
            total += naive_gru(w, data[begin:end])[first - begin : stop - begin].sum(0)
            seen[first:stop] += 1
        assert (seen == 1).all()
        assert p == pytest.approx(total.max() / len(data), abs=2e-5) and b == total.argmax()


def test_context_reaches_across_words():
    w = langid.init(2)
    one, two = (naive_gru(w, t.encode()) for t in ("ab cd 12 ef", "ab cd 99 ef"))
    assert not np.allclose(one[-2:], two[-2:]) and not np.allclose(one[:2], two[:2])


def test_languages_are_learned_from_their_own_rows(spark, monkeypatch):
    """Rows without a language teach none, whatever rows share their id."""
    seen = {}

    def train(texts, truth, n, seed=7):
        seen["texts"] = texts
        return langid.init(n)

    monkeypatch.setattr(langid, "train", train)
    docs = [(1, f"plain text {i}", "en") for i in range(400)] + [(1, f"no language {i}", None) for i in range(400)] + [(2, "otro texto", "es"), (None, "ohne Nummer", "de")]
    langid.predict(spark.createDataFrame(docs, "doc_id bigint, text string, lang string")).count()
    assert len(seen["texts"]) == langid.DOCS_PER_LANG + 1 and not any(t.startswith(("no", "ohne")) for t in seen["texts"])


def test_fit_sets_are_bounded_by_rows(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(900)] + [(7, "x" * 50)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (7, 0), (8, 0)], "doc_id bigint, toxic int")
    got = labelled_sample(docs, labels, "toxic", 100, 30).collect()
    assert sorted(r.y for r in got) == [0] * 100 + [1] * 100 and {r.doc_id for r in got} == {0, 1, 2}
    again = labelled_sample(docs.repartition(7), labels, "toxic", 100, 30).collect()
    assert sorted(got) == sorted(again)
    # A class whose other texts are too long is still learned.
    assert {r.y for r in labelled_sample(docs, labels.where("doc_id <> 0"), "toxic", 100, 60).collect()} == {0, 1}


def test_toxicity_against_plain_sums():
    """The odds of a text, one word and one n-gram at a time."""

    def row(gram):
        h = len(gram)
        for c in gram:
            h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
            h ^= h >> 29
        return h >> 64 - toxicity.BUCKETS.bit_length() + 1

    margin = np.random.default_rng(3).normal(size=toxicity.BUCKETS).astype(np.float32)
    texts = ["A quick Brown fox", "one", "", "ñandú über allez allez a", None]
    for text, p in zip(texts, toxicity.Scorer(margin, -0.5).score(texts)):
        values = []
        for word in (text or "").lower().split():
            marked = f"<{word}>"
            grams = [marked[i : i + n] for n in toxicity.GRAMS for i in range(len(marked) - n + 1)]
            values.append(sum(float(margin[row(g)]) for g in grams) / len(grams))
        windows = [sum(values[i : i + 2]) / 2 for i in range(len(values) - 1)] or [sum(values)]
        odds = sum(math.exp(v - 0.5) ** toxicity.POWER for v in windows) ** (1 / toxicity.POWER)
        assert p == pytest.approx(1 / (1 + 1 / odds), rel=1e-6)


def test_quality_training_against_a_plain_loop():
    """FTRL-proximal with dictionaries, as published."""
    rng = np.random.default_rng(5)
    truth = rng.integers(0, 2, 30)
    vectors = [(np.sort(rng.choice(40, 6, replace=False)) + 40 * y * (rng.random(6) < 0.3), rng.random(6).astype(np.float32)) for y in truth]
    vectors = [(np.unique(r), v[: len(np.unique(r))]) for r, v in vectors]
    got = quality.train(vectors, truth)
    z, n = {}, {}
    weight = lambda i: 0.0 if abs(z.get(i, 0)) <= quality.L1 else -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)
    order = np.random.default_rng(7)
    for _ in range(quality.EPOCHS):
        for k in order.permutation(len(vectors)):
            x = {**dict(zip(vectors[k][0].tolist(), vectors[k][1].tolist())), quality.BUCKETS: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            cost = 0.5 / truth.mean() if truth[k] else 0.5 / (1 - truth.mean())
            for i, v in x.items():
                g = (p - truth[k]) * cost * v
                sigma = (math.sqrt(n.get(i, 0) + g * g) - math.sqrt(n.get(i, 0))) / quality.ALPHA
                z[i] = z.get(i, 0) + g - sigma * w[i]
                n[i] = n.get(i, 0) + g * g
    assert {i: pytest.approx(weight(i), rel=1e-4, abs=1e-6) for i in z} == {i: got[i] for i in z}
    assert not np.delete(got, list(z)).any()


def test_equal_texts_have_equal_quality():
    texts = ["one text that stands here many times"] * 3_000
    texts[1::2] = [f"something {i} between them {'x' * (i % 9)}" for i in range(1_500)]
    scorer = quality.Scorer(np.random.default_rng(0).normal(size=quality.BUCKETS + 1).astype(np.float32))
    assert len(set(scorer.score(texts)[0::2].tolist())) == 1


def test_long_clean_texts_stay_clean(big):
    """A clean text repeated to megabytes is no more toxic than the text."""
    docs, labels = big
    known = labels.where("toxic = 0").join(docs, "doc_id").where("length(text) BETWEEN 1000 AND 4000").orderBy("doc_id").limit(40).collect()
    long = docs.sparkSession.createDataFrame([(-1 - i, r.text * (2_000_000 // len(r.text))) for i, r in enumerate(known)], "doc_id bigint, text string")
    both = docs.select("doc_id", "text").unionByName(long)
    got = {r.doc_id: r.score for r in toxicity.score(both, labels).where("doc_id < 0").collect()}
    assert sum(s >= 0.5 for s in got.values()) == 0, got


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 9)] + [(None, 1, 1), (3, 1, 1), (4, None, None)], "doc_id bigint, quality int, toxic int")
    for module in (toxicity, quality):
        got = module.score(odd_docs, labels).collect()
        assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
        assert {r.score for r in module.score(odd_docs, labels.limit(0)).collect()} == {0.0}
        assert module.score(odd_docs.limit(0), labels).count() == 0
    got = {r.doc_id: r for r in langid.predict(odd_docs).collect()}
    assert {got[i].lang_pred for i in (1, 2, 6, 8)} == {"und"} and got[3].lang_pred in ("en", "de", "es", "fr")
    assert langid.predict(odd_docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.predict(odd_docs.withColumn("lang", odd_docs["lang"].substr(1, 0)).selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")).collect()} == {"und"}


def test_first_marks_are_those_of_the_whole_order(spark, monkeypatch):
    """One language has most rows, one a single row; marks are negative as well."""
    monkeypatch.setattr(langid, "DOCS_PER_LANG", 7)
    monkeypatch.setattr(langid, "SLOTS", 4)
    marks = spark.range(400).selectExpr("CASE WHEN id = 9 THEN 'fr' WHEN id % 5 = 0 THEN 'de' ELSE 'en' END AS lang", "xxhash64(id) AS mark")
    got, want = {}, {}
    for rows, out in ((langid.first_marks(marks), got), (marks, want)):
        for r in rows.collect():
            out.setdefault(r.lang, []).append(r.mark)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:7] for k, v in want.items()}
    assert langid.first_marks(marks.limit(0)).count() == 0
