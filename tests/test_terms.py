import random

import numpy as np
import pytest

from tablewise.operators import terms
from tablewise.operators.terms import Automaton, apart


def brute(text, words):
    return sorted((p + len(w) - 1, w) for w in words for p in range(len(text) - len(w) + 1) if text.startswith(w, p))


@pytest.mark.parametrize("seed", range(6))
def test_all_occurrences(seed):
    rng = random.Random(seed)
    letters = rng.choice(["ab", "abcé", "aб泵🙂"])
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(40)})
    texts = ["".join(rng.choice(letters + "x") for _ in range(rng.randint(0, 300))) for _ in range(20)]
    codes, ends = terms._codes(texts)
    automaton = Automaton(words)
    for lane in (1, 33, 2048):
        place, term = automaton.scan(codes, lane)
        own = np.searchsorted(ends, place, "right")
        begin = np.concatenate([[0], ends])
        for k, t in enumerate(texts):
            assert sorted((int(p - begin[k]), words[w]) for p, w in zip(place[own == k], term[own == k])) == brute(t, words)


def test_occurrences_apart():
    owner, place = np.array([5] * 6 + [2] * 3), np.array([1, 2, 3, 4, 9, 10, 7, 4, 1])
    got = apart(owner, place, np.full(9, 3))
    assert got[0].tolist() == [2, 5] and got[1].tolist() == [3, 3]


def test_titles_in_terms():
    words = ["water pump", "pumps", "x" * 200 + "y", "valve"]
    a = Automaton(words)
    assert sorted(a.holding("pump")) == [0, 1] and a.holding("x" * 199 + "y") == [2] and a.holding("x" * 201) == [] and a.holding("z") == []


@pytest.mark.parametrize("bounds", [{}, {"BLOCK": 60, "CELLS": 500, "CHARS": 40}])
def test_matches(spark, monkeypatch, bounds):
    """One automaton, or many blocks of several, give what comparing each pair gives."""
    for name, value in bounds.items():
        monkeypatch.setattr(terms, name, value)
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(30)] + ["", None, "AB"]
    rows = [(i if i % 9 else None, rng.choice(["", None, "ab", "CABBAGE", "".join(rng.choice("abc") for _ in range(5))]), "".join(rng.choice("abc ") for _ in range(rng.randint(0, 120))), rng.choice(["local", "global", None])) for i in range(60)]
    rows += [(7, "", None, "local"), (8, "tail", "aaaa aaa" * 50, "local")]
    docs = spark.createDataFrame(rows, "doc_id int, title string, text string, scope string").selectExpr("*", "1 AS t", "2 AS key")
    want = {}
    for key, t, b, scope in rows:
        t, b = (t or "").lower(), (b or "").lower()
        for w in {x.lower() for x in words if x}:
            score = 0.9 if w in t or (t and t in w) else 0.7 if b.count(w) >= 2 else 0.5 if scope == "global" else 0
            if score:
                want[key, w] = max(score, want.get((key, w), 0))
    got = terms.match_terms(docs, spark.createDataFrame([(w,) for w in words], "term string"), scope="scope").collect()
    assert {(r.doc_id, r.term): r.confidence for r in got} == want and len(got) == len(want)
    assert terms.match_terms(docs, spark.createDataFrame([], "term string")).count() == 0
    assert terms.match_terms(docs.limit(0), spark.createDataFrame([("a",)], "term string")).count() == 0


def test_one_scan_and_no_join(spark):
    docs = spark.createDataFrame([(1, "", "pump pump")], "doc_id int, title string, text string")
    plan = terms.match_terms(docs, spark.createDataFrame([("pump",), ("valve",)], "term string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Generate" not in plan


def test_work_does_not_grow_with_terms_times_documents(spark, monkeypatch):
    """Many long terms, some of them alike: documents are read a fixed number of times, and matches are
    those of each pair; titles in terms, too, and a document that holds more terms than are tried one by one."""
    monkeypatch.setattr(terms, "BLOCK", 200)
    monkeypatch.setattr(terms, "BITS", 16)
    rng = random.Random(3)
    words = [f"http://a.example/é/{k % 40}/page-{k}/more" for k in range(300)] + [f"term{k}" for k in range(0, 60)] + ["aaaaaaaaaaaaaa", "aaaaaaa", "ab", "é泵🙂é泵🙂é泵🙂é泵🙂"]
    rows = [(k, rng.choice([f"http://a.example/é/{k % 40}/page-{k}", "", "page-1", "ab", words[k]]), " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5]))) * rng.choice([1, 2])) for k in range(80)]
    rows += [(90, "", "a" * 27), (91, "", "a" * 28), (92, None, " ".join(words) * 2), (93, "no", "é泵🙂" * 8)]
    docs = spark.createDataFrame(rows, "doc_id int, title string, text string")
    want = {(k, w): 0.9 if w in (t or "") or (t and t in w) else 0.7 for k, t, b in rows for w in words if w in (t or "") or (t and t in w) or b.count(w) >= 2}
    got = terms.match_terms(docs, spark.createDataFrame([(w,) for w in words], "term string"))
    rows_got = got.collect()
    assert {(r.doc_id, r.term): r.confidence for r in rows_got} == want and len(rows_got) == len(want)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 12
