"""The pipeline, stage by stage, against brute-force versions of what each stage does."""

import hashlib

import duckdb
import numpy as np
import public_tokenizers
from brute import brute_near_copies, brute_repeats
from tokenizers import Tokenizer

import corpus_pipeline
from tablewise.llm import toxicity
from tablewise.llm.registry import ORACLES

STAGES = dict(corpus_pipeline.STAGES)


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")

    clean = STAGES["toxicity"](spark, docs, sf)
    assert clean.columns == names
    clean.write.parquet(str(tmp_path / "1"))
    clean = spark.read.parquet(str(tmp_path / "1"))
    low = {r.doc_id for r in toxicity.score(docs, labels).where("predicted = 0").collect()}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(low)

    single = STAGES["simhash_near_dedup"](spark, clean, sf)
    assert single.columns == names
    single.write.parquet(str(tmp_path / "2"))
    single = spark.read.parquet(str(tmp_path / "2"))
    rows = clean.orderBy("doc_id").collect()
    ids = [r.doc_id for r in rows]
    want = [i for i, c in zip(ids, brute_near_copies(ids, [r.text for r in rows])) if i == c]
    assert sorted(r.doc_id for r in single.collect()) == want

    cut = STAGES["suffix_dedup"](spark, single, sf)
    assert cut.columns == names
    cut.write.parquet(str(tmp_path / "3"))
    cut = spark.read.parquet(str(tmp_path / "3"))
    brute = {b[0]: b for b in brute_repeats([(r.doc_id, r.text) for r in single.collect()])}
    for r in cut.collect():
        if brute[r.doc_id][2] == 0:
            assert hashlib.sha256(r.text.encode()).hexdigest() == brute[r.doc_id][4]
        else:
            assert len(r.text.encode()) <= brute[r.doc_id][1] - brute[r.doc_id][2] and r.n_chars == len(r.text)

    mixed = STAGES["mixing"](spark, cut, sf)
    assert mixed.columns == names
    mixed.write.parquet(str(tmp_path / "4"))
    mixed = spark.read.parquet(str(tmp_path / "4"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/3/*.parquet'")
    chosen = con.execute(f"SELECT doc_id FROM ({ORACLES['op5_mixing']}) WHERE sampled = 1 ORDER BY doc_id").fetchall()
    assert sorted(r.doc_id for r in mixed.collect()) == [c[0] for c in chosen]

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in mixed.collect()}
    last = STAGES["bpe"](spark, mixed, sf).collect()
    assert len(last) == len(text)
    for r in last:
        tokens = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(tokens), hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest())


def test_odd_rows(spark, sf, odd_docs):
    """Nulls, repeated rows, an empty table, and columns with names that stages use themselves."""
    clash = odd_docs.selectExpr("*", "1 AS place", "2D AS toxicity_score", "7L AS n_removed", "8L AS n_bytes", "'x' AS kept_doc", "'y' AS carried", "3 AS component", "'z' AS digest", "map('a', 1) AS extra")
    for docs in (odd_docs.select("doc_id", "text", "lang", "source", "n_chars"), clash):
        for frame in (docs, docs.limit(0)):
            for name, stage in corpus_pipeline.STAGES:
                got = stage(spark, frame, sf)
                rows = got.collect()
                assert len(rows) <= frame.count()
                if name != "bpe":
                    assert got.columns == docs.columns
                    assert docs is not clash or all((r.place, r.toxicity_score, r.n_removed, r.kept_doc, r.digest) == (1, 2.0, 7, "x", "z") for r in rows)
        one = STAGES["simhash_near_dedup"](spark, docs, sf).collect()
        assert sorted(str(r.doc_id) for r in one) == sorted(["1", "3", "4", "5", "7", "8", "None"])


def test_rows_that_share_an_id_are_judged_by_their_texts(spark, sf):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (3, " ".join(words + ["more"])), (3, " ".join(reversed(words))), (3, " ".join(reversed(words)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    got = STAGES["simhash_near_dedup"](spark, docs, sf).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([rows[0], rows[2]])
