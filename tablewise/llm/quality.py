"""Quality classifier: hashed word n-gram logistic regression trained with FTRL-proximal updates.

A text's words give two token streams: the words themselves and their shapes (case, digits and
punctuation in runs, plus a mark for a word that repeats one of the two before it). N-grams of
both streams are hashed into one weight table. A feature's value is its share of the document's
n-grams, so the score is the mean of the hit weights: a sparse dot product that needs one pass
over the text and no counting table.

Training takes at most ``ROWS_PER_CLASS`` rows of each class, out of the labelled ones of at most
``TRAIN_CHARS`` characters: their sparse vectors are collected on the driver. Scores cover whole
texts.

Defined results: null, empty and wordless texts have no features and score by the bias alone;
equal texts have equal scores, whatever stands beside them; all rows of a labelled id carry its label,
and rows with a null id carry none but are scored; without labels of both classes every score is 0; further input
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import held_out, labelled_sample, map_batches

BUCKETS = 1 << 18
WORD_GRAMS, SHAPE_GRAMS = 2, 3
#: Features are shares times this, so that typical values are near 1.
SCALE = 10.0
ROWS_PER_CLASS, TRAIN_CHARS = 2_000, 20_000
#: FTRL-proximal: per-coordinate rate alpha / (beta + sqrt(sum g^2)), L1 and L2 terms.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 0.05, 1e-4, 1e-3, 6
MEMO_WORDS, MEMO_CHARS = 1_000_000, 64
#: Words hashed at once.
BLOCK_WORDS = 400_000
THRESHOLD = 0.7

_RUNS = ((re.compile("[a-z]+"), "x"), (re.compile("[A-Z]+"), "X"), (re.compile("[0-9]+"), "9"), (re.compile("[^\\W\\d_A-Za-z]+"), "w"), (re.compile("(.)\\1+"), "\\1"))


def shape(word: str) -> str:
    """Runs of lower case, upper case, digits and other letters as one sign each, the rest as is."""
    if not word.isascii() and word.isupper():
        return "X" + "".join(c for c in word if not c.isalpha())[:4]
    for run, sign in _RUNS:
        word = run.sub(sign, word)
    return word.replace("xw", "x").replace("wx", "x").replace("w", "x").replace("xx", "x")[:12]


class Features:
    """Hashed n-gram rows of texts; word hashes are remembered up to a bound."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}
        self.shapes: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Hash of the word in the upper 32 bits, of its shape in the lower."""
        ending = word[-1] if word[-1].isalnum() else ""
        plain = word if len(word) > MEMO_CHARS or ending else word.rstrip(".,")
        kind = shape(plain or word)
        return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) << 32 | zlib.crc32(kind.encode("utf-8", "surrogatepass"))

    def codes(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        new = set(words).difference(memo)
        if len(memo) + len(new) > MEMO_WORDS:
            memo.clear()
            new = set(words)
        memo.update([(w, self.word(w)) for w in new])
        out = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        for w in new:
            if len(w) > MEMO_CHARS:
                del memo[w]
        return out

    def rows(self, words: list[str], sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each n-gram kind: the row of every n-gram, and the word at which it starts."""
        code = self.codes(words)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        text, kind = code >> np.uint64(32), code & np.uint64(0xFFFFFFFF)
        for back in (1, 2):
            same = (text[back:] == text[:-back]) & (doc[back:] == doc[:-back])
            kind[back:][same] = back
        for salt, stream, most in ((1, text, WORD_GRAMS), (2, kind, SHAPE_GRAMS)):
            gram = np.full(len(code), salt, np.uint64)
            for n in range(1, most + 1):
                if n > len(code):
                    break
                gram = (gram[: len(code) - n + 1] ^ stream[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
                gram ^= gram >> np.uint64(31)
                whole = np.flatnonzero(doc[: len(gram)] == doc[n - 1 :])
                yield (gram[whole] >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), whole


def blocks(texts: list[str | None]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Whole texts in blocks of about BLOCK_WORDS words: the words, and how many each text has."""
    words: list[str] = []
    sizes: list[int] = []
    for t in texts:
        own = (t or "").split()
        words += own
        sizes.append(len(own))
        if len(words) >= BLOCK_WORDS:
            yield words, np.array(sizes)
            words, sizes = [], []
    if sizes:
        yield words, np.array(sizes)


def vector(features: Features, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a text and their values."""
    words = text.split()
    found = [r for r, _ in features.rows(words, np.array([len(words)]))] if words else []
    rows, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0))
    return rows, (count * (SCALE / max(1, len(words)))).astype(np.float32)


def train(vectors: list[tuple[np.ndarray, np.ndarray]], truth: np.ndarray, seed: int = 7) -> np.ndarray:
    """FTRL-proximal over the vectors; the last weight is the bias."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    share = truth.mean()
    cost = {1: 0.5 / share, 0: 0.5 / (1 - share)}

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(vectors)):
            rows, value = vectors[k]
            i, x = np.append(rows, BUCKETS), np.append(value, 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - truth[k]) * cost[int(truth[k])] * x
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - step * w
            n[i] += g * g
    return weights(np.arange(BUCKETS + 1)).astype(np.float32)


class Scorer:
    def __init__(self, weights: np.ndarray):
        self.weights, self.features = weights, Features()

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = []
        for words, sizes in blocks(texts):
            at, dot = np.zeros(len(words)), np.zeros(len(sizes))
            if words:
                for rows, start in self.features.rows(words, sizes):
                    at[start] += self.weights[rows]
                # Each text's own sum, so that nothing before it in the block enters.
                some = sizes > 0
                dot[some] = np.add.reduceat(at, (np.cumsum(sizes) - sizes)[some])
            dot = dot * SCALE / np.maximum(1, sizes) + self.weights[BUCKETS]
            out.append(1 / (1 + np.exp(-np.clip(dot, -35, 35))))
        return np.concatenate(out) if out else np.zeros(0)


def _vectors(batches):
    features = Features()
    for b in batches:
        made = [vector(features, t or "") for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r.astype("<i4").tobytes() for r, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())], ["doc_id", "y", "rows", "value"])


def score(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """(key, held_out, score, predicted) for every document; learns from rows not held out.

    ``labels`` joins by ``doc_id``. Neither labels nor anything but the text enters a score.
    """
    docs = documents.select(documents[key].alias("doc_id"), documents[text].alias("text"))
    sample = labelled_sample(docs, labels.where(~held_out(labels["doc_id"], 4, 2)), label, ROWS_PER_CLASS, TRAIN_CHARS)
    found = sorted(tuple(r) for r in map_batches(sample, _vectors, "doc_id bigint, y int, rows binary, value binary").collect())
    truth = np.array([r[1] for r in found])
    vectors = [(np.frombuffer(r[2], "<i4"), np.frombuffer(r[3], np.float32)) for r in found]
    weights = train(vectors, truth) if len(set(truth)) == 2 else None

    def run(batches):
        scorer = Scorer(weights) if weights is not None else None
        for b in batches:
            p = scorer.score(b.column(1).to_pylist()) if scorer else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    scored = map_batches(docs, run, "doc_id bigint, score double")
    return scored.select(F.col("doc_id").alias(key), held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
