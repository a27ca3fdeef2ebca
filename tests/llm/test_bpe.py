import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablewise.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def table():
    return bpe.MergeTable(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(3)
    out = ["", "  ", "It's I'LL we've 12345 ½ ²³ ΑΣ ΣΣ. naïve ﬁ Å x\x1cy\x1d z　r\x85s\xa0t", "a" * 5000, "!" * 3000 + "?!" * 999, "<|startoftext|>Hello<|endoftext|> <|EndOfText|>", "日本語 한국어 العربية हिन्दी 👍🏽👨‍👩‍👧", "İstanbul ǅ ẞ", "abcabcabc" * 900, "th" * 3000, "\x00\x01 a\x00b", "﻿​q", "'s't're've '''s 1's", "é ọ̈"]
    out += ["".join(rng.choice("abcdefghinorstéß '!1.") for _ in range(rng.randint(1, 400))) for _ in range(200)]
    return out + ["".join(rng.choice("ainther") for _ in range(rng.randint(1, 2000))) for _ in range(60)]


def test_equals_the_library(table, library):
    encoder, decoder = bpe.Encoder(table), bpe.Decoder(table)
    for text, want in zip(texts(), library.encode_batch(texts(), add_special_tokens=False)):
        got = encoder.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == want.ids
        assert "".join(decoder.decode(got, step=7)) == library.decode(want.ids, skip_special_tokens=False)


def test_window_is_bounded_and_does_not_change_tokens(table):
    machine = bpe.Transducer(table)
    word = "antherin" * 2000
    whole = list(machine.encode(word))
    machine.window = table.longest + 8
    assert list(machine.encode(word)) == whole
    early = next(iter(machine.encode(word)))  # settled long before the end
    assert early == whole[0]
    assert 0 < table.lookahead < 1000


def test_memo_may_overflow(table, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 3)
    small, plain = bpe.Encoder(table), bpe.MergeTable(PATH)
    text = "one two three four five six one two"
    assert small.encode(text) == bpe.Encoder(plain).encode(text)


def test_byte_level_decoder_holds_back_unfinished_characters():
    class Bytes:
        names = ["Ã", "©", "a"]
        decoder = "ByteLevel"

    machine = bpe.Decoder(Bytes)
    assert [machine.feed([0]), machine.feed([1]), machine.feed([2]), machine.finish()] == ["", "é", "a", ""]


def test_tables(spark, odd_docs):
    got = bpe.round_trip(odd_docs, PATH).collect()
    assert len(got) == odd_docs.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got if r.doc_id in (1, 2, 6)} == {(0, empty, empty)}
    ids = bpe.encode(odd_docs, PATH)
    said = {r.doc_id: r.text for r in bpe.decode(ids, PATH).collect()}
    assert said[1] == "" and said[3].startswith("hello</w> there</w> ,</w>")
    assert bpe.round_trip(odd_docs.limit(0), PATH).count() == 0
