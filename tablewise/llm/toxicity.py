"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (boundary marks included); each n-gram owns a hashed
embedding row. The rows of a word are averaged, the words of a short window are averaged again and
a two-class softmax reads the window. Rows, softmax weights and bias are trained jointly by
full-batch Adam in numpy, so a misspelling that was never seen shares most of its vector with the
word it comes from. The odds of a document are the ``POWER``-norm of its windows' odds, so one
window is enough however long the document is, and many harmless ones add little.

Because the softmax is linear, a word adds one number (its margin) to its windows; scoring looks
margins up per distinct word, computing unseen words in bulk.

Training takes at most ``ROWS_PER_CLASS`` rows of each class, out of the labelled ones of at most
``TRAIN_CHARS`` characters: all of them are collected on the driver. Scores cover whole texts.

Defined results: null, empty and wordless texts have one empty window and so the bias as their
odds; equal texts have equal scores; all rows of a labelled id carry its label, and rows with a null
id carry none but are scored; without labels of both classes every score is 0; further
input columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tablewise.llm.common import held_out, labelled_sample, map_batches, slices

BUCKETS, DIM = 1 << 17, 8
GRAMS = (3, 4, 5, 6)
#: Words of a window, and the norm that joins the odds of windows (1: their sum).
WINDOW, POWER = 2, 3
ROWS_PER_CLASS, TRAIN_CHARS = 2_000, 20_000
EPOCHS, RATE, SHRINK = 80, 0.1, 2e-3
#: Margins remembered by a task, and the longest word that is.
MEMO_WORDS, MEMO_CHARS = 1_000_000, 64


def subword_rows(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: hashed rows of the words' n-grams, word by word, and each one's word."""
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), np.fromiter((len(w) + 2 for w in words), np.int64, len(words)))
    found = []
    for n in GRAMS:
        if len(codes) < n:
            continue
        hashed = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            hashed ^= codes[k : len(codes) - n + 1 + k]
            hashed *= np.uint64(0x9E3779B97F4A7C15)
            hashed ^= hashed >> np.uint64(29)
        hashed >>= np.uint64(64 - BUCKETS.bit_length() + 1)
        whole = owner[: len(hashed)] == owner[n - 1 :]
        found.append((hashed[whole].astype(np.int32), owner[: len(hashed)][whole]))
    return found


def word_means(grams: list[tuple[np.ndarray, np.ndarray]], row_values: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean over each word's n-gram rows, and how many it has (at least one)."""
    total, count = np.zeros(words), np.zeros(words)
    for rows, owner in grams:
        total += np.bincount(owner, row_values[rows], words)
        count += np.bincount(owner, minlength=words)
    return total / count, count


def margins(words: list[str], row_margin: np.ndarray) -> np.ndarray:
    """The mean margin of each word's n-gram rows."""
    return word_means(subword_rows(words), row_margin, len(words))[0] if words else np.zeros(0)


def window_means(values: np.ndarray) -> np.ndarray:
    """Means of all runs of WINDOW values; of all there are, if fewer."""
    n = min(WINDOW, len(values))
    if not n:
        return np.zeros(1)
    total = np.concatenate([[0.0], np.cumsum(values)])
    return (total[n:] - total[:-n]) / n


def train(texts: list[str], truth: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """The margin of every embedding row under the trained softmax, and the bias."""
    number: dict[str, int] = {}
    by_doc = [np.fromiter((number.setdefault(w, len(number)) for w in t.lower().split() or [" "]), np.int32) for t in texts]
    token, sizes = np.concatenate(by_doc), np.array([len(d) for d in by_doc])
    grams = subword_rows(list(number))
    n_words, n_docs = len(number), len(by_doc)
    del number, by_doc
    # Windows of one document: starts at each token but the last few; shorter documents have one.
    width = np.minimum(sizes, WINDOW)
    n_win = sizes - width + 1
    win_first = np.cumsum(n_win) - n_win
    win_doc = np.repeat(np.arange(n_docs, dtype=np.int32), n_win)
    win_at = (np.arange(n_win.sum()) + np.repeat(np.cumsum(sizes) - sizes - win_first, n_win)).astype(np.int32)
    win_len = width[win_doc].astype(np.int32)

    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.array([-float(np.log(n_win.mean())) / POWER], np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, soft, bias)]
    weight = np.where(truth == 1, 0.5 / max(1, (truth == 1).sum()), 0.5 / max(1, (truth == 0).sum())) * n_docs
    for epoch in range(1, EPOCHS + 1):
        u = soft[:, 1] - soft[:, 0]
        of_row = table @ u
        of_word, count = word_means(grams, of_row, n_words)
        total = np.concatenate([[0.0], np.cumsum(of_word[token], dtype=np.float64)])
        odds = (total[win_at + win_len] - total[win_at]) / win_len + bias[0]
        top = np.maximum.reduceat(odds, win_first)
        share = np.exp(POWER * (odds - top[win_doc]))
        summed = np.add.reduceat(share, win_first)
        p = 1 / (1 + np.exp(-np.clip(top + np.log(summed) / POWER, -60, 60)))
        slope = (p - truth) * weight
        by_window = slope[win_doc] * share / summed[win_doc] / win_len
        change = np.zeros(len(token) + 1)
        change += np.bincount(win_at, by_window, len(change))
        change -= np.bincount(win_at + win_len, by_window, len(change))
        by_word = (np.bincount(token, np.cumsum(change[:-1]), n_words) / count).astype(np.float32)
        by_row = sum(np.bincount(rows, by_word[owner], BUCKETS) for rows, owner in grams).astype(np.float32)
        d_u = by_row @ table
        steps = (np.outer(by_row, u) + SHRINK * table, np.stack([-d_u, d_u], 1) + SHRINK * soft, np.array([slope.sum()], np.float32))
        for value, (m, v), g in zip((table, soft, bias), moments, steps):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value -= RATE * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-6)
    return (table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[0])


class Scorer:
    def __init__(self, row_margin: np.ndarray, bias: float):
        self.row_margin, self.bias, self.memo = row_margin, bias, {}

    def learn(self, words: set[str]) -> dict[str, float]:
        """Margins of all the words; short ones stay in the memo."""
        new = list(words.difference(self.memo))
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo.clear()
            new = list(words)
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            self.memo.update(zip(part, margins(part, self.row_margin).tolist()))
        return self.memo

    def score(self, texts: list[str | None]) -> list[float]:
        docs = [(t or "").lower().split() for t in texts]
        memo = self.learn(set().union(*docs))
        out = []
        for words in docs:
            odds = window_means(np.fromiter(map(memo.__getitem__, words), np.float64, len(words))) + self.bias
            top = odds.max()
            out.append(float(1 / (1 + np.exp(-np.clip(top + np.log(np.exp(POWER * (odds - top)).sum()) / POWER, -60, 60)))))
        for w in [w for w in memo if len(w) > MEMO_CHARS]:
            del memo[w]
        return out


def with_scores(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", score: str = "score") -> DataFrame:
    """``documents`` with one more column, the score; learns from rows that are not held out.

    ``labels`` joins by ``doc_id``. Neither labels nor anything but the text enters a score.
    """
    docs = documents.select(documents[key].alias("doc_id"), documents[text].alias("text"))
    known = labels.where(~held_out(labels["doc_id"], 5, 0))
    sample = labelled_sample(docs, known, label, ROWS_PER_CLASS, TRAIN_CHARS)
    rows = sorted((r.doc_id, r.text or "", r.y) for r in sample.collect())
    truth = np.array([y for _, _, y in rows])
    model = None
    if len(set(truth)) == 2:
        row_margin, bias = train([t for _, t, _ in rows], truth)
        # Training weighs both classes alike; all labels say how frequent they are.
        share = known.agg(F.count_if(F.col(label) == 1).alias("ones"), F.count_if(F.col(label) == 0).alias("zeros")).first()
        model = row_margin, bias + float(np.log(share.ones / share.zeros))

    def run(batches):
        scorer = Scorer(*model) if model else None
        for b in slices(batches, 500):
            texts = b.column(place).to_pylist()
            p = scorer.score(texts) if scorer else [0.0] * len(texts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*b.schema.names, score])

    place = documents.columns.index(text)
    return map_batches(documents, run, StructType([*documents.schema.fields, StructField(score, DoubleType())]))


def score(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(key, held_out, score, predicted) for every document."""
    docs = documents.select(documents[key].alias("doc_id"), documents[text].alias("text"))
    scored = with_scores(docs, labels, label=label)
    return scored.select(F.col("doc_id").alias(key), held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
