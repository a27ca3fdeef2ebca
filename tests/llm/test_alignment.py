import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tablewise.llm import alignment
from tablewise.llm.alignment import Sizes

PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def brute(rows):
    """The contract, token by token, with the libraries' own encoders."""
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a_bytes = dict(enumerate(alignment.byte_vocabulary(PATHS[0])))
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs = []
    for doc, t in rows:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        whole = (" " + (t or "")).encode()
        if b"".join(a_bytes[i] for i in x) != whole or b"".join(map(piece, y)) != whole:
            x, y = [], []
        ends = [np.cumsum([len(f(i)) for i in ids]).tolist() for f, ids in ((a_bytes.__getitem__, x), (piece, y))]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, links, last = [], [], 0
        for c in common:
            own = [[str(i) for i, e in zip(ids, es) if last < e <= c] for ids, es in zip((x, y), ends)]
            groups.append(",".join(own[0]) + "|" + ",".join(own[1]))
            links.append((int(own[0][-1]), int(own[1][-1])))
            last = c
        docs.append((doc, len(x), len(y), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""))
    counts = Counter(p for d in docs for p in d[3])
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(n, most.get(j, 0))
    return counts, sorted((str(d), n_a, n_b, len(ls), len(ls), sum(counts[p] == most[p[1]] for p in ls), sum(counts[p] for p in ls), sha) for d, n_a, n_b, ls, sha in docs)


ODD = ["", None, " ", "  ", "a ", " a", "a  b   c    ", "\ttabs\n\nand  lines \n", "mixed▁mark", "<|endoftext|> <s> </s> <unk> <0x41>", "naïve Straße 東京 🙂🙂 ́e", "x" * 5000, " " * 3000, "ab" * 4000, "a b　c", "\0\x01", "it's we'll 123456 !!!???", "\r\n\r\n", "﻿bom", "Ａｂｃ ﬁ", "é" * 300]


@pytest.mark.parametrize("sizes", [Sizes(), Sizes(part=40_000, batch=3_000, stride=3)])
def test_documents(spark, sf, sizes):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + k // 2, t) for k, t in enumerate(ODD)] + [(None, "no id"), (10_000, "the same id")], "doc_id bigint, text string")
    df = docs.unionByName(odd)
    counts, want = brute([tuple(r) for r in df.collect()])
    got = sorted((str(r[0]), *r[1:]) for r in alignment.align(df, *PATHS, sizes=sizes).collect())
    assert got == want
    pairs = alignment.pair_counts(df, *PATHS, sizes=sizes).collect()
    assert {(r.a_id, r.b_id): r["count"] for r in pairs} == counts and len(pairs) == len(counts)


def test_groups_have_equal_bytes(spark):
    df = spark.createDataFrame([(1, "Tokenization of uncommonly long words, e.g. antidisestablishmentarianism"), (2, None)], "doc_id bigint, text string")
    one, none = alignment.token_groups(df, *PATHS).orderBy("doc_id").collect()
    both = alignment.tokenizers(*PATHS)
    tokens = alignment.byte_vocabulary(PATHS[0])
    last = (0, 0)
    for a, b in zip(one.a_stops, one.b_stops):
        assert b"".join(tokens[i] for i in one.a_ids[last[0] : a]) == b"".join(both.b_bytes[i] for i in one.b_ids[last[1] : b])
        last = (a, b)
    assert last == (len(one.a_ids), len(one.b_ids)) and none.a_ids == none.b_stops == []


def test_odd_documents(spark, odd_docs):
    got = alignment.align(odd_docs, *PATHS)
    assert got.count() == odd_docs.count()
    assert alignment.align(odd_docs.limit(0), *PATHS).count() == 0
    assert alignment.pair_counts(odd_docs.limit(0), *PATHS).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_galloping(seed):
    rng = np.random.default_rng(seed)
    a, b, a_begin, b_begin, base = [], [], [], [], 0
    for _ in range(30):
        n = int(rng.integers(0, 300))
        a_begin.append(len(a))
        b_begin.append(len(b))
        if n:
            for ends in (a, b):
                ends += (base + np.append(np.flatnonzero(rng.random(n - 1) < rng.random()) + 1, n)).tolist()
        base += n
    x, y = (np.array(v, np.int64) for v in (a, b))
    got = alignment.common_ends(x, y, np.array(a_begin), np.array(b_begin), int(rng.integers(1, 20)))
    both = np.intersect1d(x, y)
    assert x[got[0]].tolist() == y[got[1]].tolist() == both.tolist()


def test_a_million_spaces():
    """The faster encoder of A gives up here; the other one takes its place."""
    both = alignment.tokenizers(*PATHS)
    found = alignment.Aligned(["a" + " " * 1_000_000 + "b" + "\n" * 1_000_000], both, alignment.Pieces(both), 16)
    assert [x.tolist() for x in (found.n_a, found.n_b, found.n_groups)] == [[1_500_001], [1_062_503], [562_503]]


def test_both_encoders_of_a_agree_on_all_characters():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    own = alignment.tokenizers(*PATHS).a
    texts = ["".join(f"a{chr(c)}b {chr(c)}1" for c in range(at, at + 64) if not 0xD800 <= c < 0xE000) for at in range(0, 0x30000, 64)]
    assert [e.ids for e in a.encode_batch(texts, add_special_tokens=False)] == [own.encode(t, disallowed_special=()) for t in texts]
