"""Language identification with a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes, in lower case, are read by a forward and a backward GRU, across words, digits,
marks and white space; every byte position gets a language distribution from both states, and a
document's distribution is the mean over all of its positions. Weights are trained in numpy by
backpropagation through time on pieces of labelled documents.

Texts are read in windows of ``WINDOW`` positions. Each is read with ``CONTEXT`` further bytes on
either side, which carry the states but whose positions belong to the neighbouring windows, so
every position is labelled once and windows of all texts run through the network in batches.

Training takes at most ``DOCS_PER_LANG`` rows of each language, out of those of at most
``TRAIN_CHARS`` characters, which are collected on the driver, and ``PIECES_PER_LANG`` pieces of
``PIECE`` bytes of them. Predictions cover whole texts.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the first
language in order; equal texts have equal predictions (means are rounded to five digits before they
are compared); only a row's own language is learned from its text, whatever other rows share its
id; rows with a null id are predicted but not learned from; without any language to learn all are
``und``; further input columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewise.llm.common import held_out, map_batches

HIDDEN = 8
#: Positions of a window, bytes of context on either side, and the step that lengths are rounded up to.
WINDOW, CONTEXT, STEP = 224, 16, 16
DOCS_PER_LANG, TRAIN_CHARS, PIECES_PER_LANG, PIECE = 300, 20_000, 3_000, 64
EPOCHS, BATCH, RATE = 4, 128, 0.01
#: Into how many slots the marks of a language are dealt before they are ranked together.
SLOTS = 64
#: Windows run through the network at once, and bytes of text that are read at once.
RUN_WINDOWS, RUN_BYTES = 1_024, 8 << 20
UNKNOWN = "und"


def init(n_langs: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights: per direction a row of gate inputs for each byte and the recurrent matrix; the output
    layer over both states."""
    rng = np.random.default_rng(seed)
    h = HIDDEN
    return {
        "byte": rng.normal(0, 0.3, (2, 256, 3 * h)).astype(np.float32),
        "state": (rng.normal(0, 1, (2, h, 3 * h)) / np.sqrt(h)).astype(np.float32),
        "out": (rng.normal(0, 1, (2 * h, n_langs)) / np.sqrt(2 * h)).astype(np.float32),
        "bias": np.zeros(n_langs, np.float32),
    }


def _gates(w: dict, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """Update and reset gates, candidate and the candidate's recurrent part for both directions."""
    n = HIDDEN
    g = np.stack([w["byte"][0][x[0]], w["byte"][1][x[1]]])
    a = h @ w["state"]
    zr = 0.5 * np.tanh(0.5 * (g[..., : 2 * n] + a[..., : 2 * n])) + 0.5
    z, r, u = zr[..., :n], zr[..., n:], a[..., 2 * n :]
    return z, r, np.tanh(g[..., 2 * n :] + r * u), u


def _softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(-1, keepdims=True))
    p /= p.sum(-1, keepdims=True)
    return p


def _both(x: np.ndarray) -> np.ndarray:
    """(T, 2, n): the bytes as the forward and as the backward network read them."""
    return np.stack([x.T, x.T[::-1]], 1)


def position_sums(w: dict, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Language probabilities summed over those positions of (n, T) windows that count.

    The same network as in ``gradients``, with one row a gate and one column a window, so that every
    operation runs over long contiguous rows."""
    n, steps = HIDDEN, x.shape[1]
    columns = np.ascontiguousarray(x.T).astype(np.intp)
    half = np.repeat(np.array([0.5, 0.5, 1], np.float32), n)[:, None]
    logits = np.repeat(w["bias"].astype(np.float32)[None, :, None], steps, 0) + np.zeros((1, 1, len(x)), np.float32)
    for k, order in ((0, range(steps)), (1, range(steps - 1, -1, -1))):
        byte, state = half * w["byte"][k].T, half * w["state"][k].T
        byte, state = (np.ascontiguousarray(m, np.float32) for m in (byte, state))
        states, h = np.empty((steps, n, len(x)), np.float32), np.zeros((n, len(x)), np.float32)
        for t in order:
            a, g = state @ h, byte.take(columns[t], 1)
            zr = a[: 2 * n]
            zr += g[: 2 * n]
            np.tanh(zr, zr)
            zr *= 0.5
            zr += 0.5
            c, u = g[2 * n :], a[2 * n :]
            u *= zr[n:]
            c += u
            np.tanh(c, c)
            h = h - c
            h *= zr[:n]
            h += c
            states[t] = h
        logits += np.ascontiguousarray(w["out"][k * n : (k + 1) * n].T) @ states
    logits -= logits.max(1, keepdims=True)
    p = np.exp(logits, logits)
    p *= (counts.T / p.sum(1))[:, None, :].astype(np.float32)
    return p.sum(0).T


def gradients(w: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions, and its gradients by backpropagation through time."""
    both, steps, n = _both(x), x.shape[1], len(x)
    h, kept = np.zeros((2, n, HIDDEN), np.float32), []
    states = np.empty((steps, 2, n, HIDDEN), np.float32)
    for t, xt in enumerate(both):
        z, r, c, u = _gates(w, xt, h)
        kept.append((h, z, r, c, u))
        h = c + z * (h - c)
        states[t] = h
    fore, back = states[:, 0], states[::-1, 1]
    p = _softmax(fore @ w["out"][:HIDDEN] + back @ w["out"][HIDDEN:] + w["bias"])
    loss = -np.log(np.maximum(p[:, np.arange(n), y], 1e-9)).mean()
    p[:, np.arange(n), y] -= 1
    p /= n * steps
    flat = p.reshape(-1, p.shape[-1])
    found = {"bias": flat.sum(0), "out": np.concatenate([fore.reshape(-1, HIDDEN).T @ flat, back.reshape(-1, HIDDEN).T @ flat])}
    to_state = np.stack([p @ w["out"][:HIDDEN].T, (p @ w["out"][HIDDEN:].T)[::-1]], 1)
    d_byte, d_state = np.zeros_like(w["byte"]), np.zeros_like(w["state"])
    dh = np.zeros((2, n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        before, z, r, c, u = kept[t]
        dh = dh + to_state[t]
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (before - c) * z * (1 - z)
        dr = dc * u * r * (1 - r)
        inner = np.concatenate([dz, dr, dc * r], -1)
        d_state += before.transpose(0, 2, 1) @ inner
        dh = dh * z + inner @ w["state"].transpose(0, 2, 1)
        outer = np.concatenate([dz, dr, dc], -1)
        for k in (0, 1):
            at = (both[t, k].astype(np.int64)[:, None] * outer.shape[-1] + np.arange(outer.shape[-1])).ravel()
            d_byte[k] += np.bincount(at, outer[k].ravel(), d_byte[k].size).reshape(d_byte[k].shape).astype(np.float32)
    return float(loss), found | {"byte": d_byte, "state": d_state}


def windows(size: int) -> list[tuple[int, int, int, int]]:
    """(begin, end, first, stop) of each window of a text: bytes read, and positions that count.

    A window's length is a multiple of STEP, or the whole text's, so that windows fall into few
    kinds: what is missing is read further ahead of it, or further on."""
    out = []
    for first in range(0, size, WINDOW):
        stop = min(size, first + WINDOW)
        begin, end = max(0, first - CONTEXT), min(size, stop + CONTEXT)
        more = -(end - begin) % STEP
        ahead = min(more, begin)
        out.append((begin - ahead, min(size, end + more - ahead), first, stop))
    return out


def letters(text: str) -> bool:
    return any(map(str.isalpha, text))


def train(texts: list[str], truth: np.ndarray, n_langs: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam over minibatches of equally long pieces, at most as many from each language."""
    rng = np.random.default_rng(seed)
    by_size: dict[int, list[tuple[bytes, int]]] = defaultdict(list)
    for lang in range(n_langs):
        data = [t.lower().encode("utf-8", "surrogatepass") for t, own in zip(texts, truth) if own == lang and letters(t)]
        pieces = [d[i : i + PIECE] for d in data for i in range(0, max(1, len(d) - PIECE // 2), PIECE)]
        for k in rng.permutation(len(pieces))[:PIECES_PER_LANG]:
            by_size[len(pieces[k])].append((pieces[k], lang))
    w = init(n_langs, seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    batches = []
    for _, items in sorted(by_size.items()):
        items = [items[k] for k in rng.permutation(len(items))]
        batches += [items[i : i + BATCH] for i in range(0, len(items), BATCH)]
    step = 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(batches)):
            x = np.frombuffer(b"".join([d for d, _ in batches[k]]), np.uint8).reshape(len(batches[k]), -1)
            _, found = gradients(w, x, np.array([y for _, y in batches[k]]))
            step += 1
            for name, g in found.items():
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.005 * (g * g - v)
                w[name] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.995**step)) + 1e-7)).astype(np.float32)
    return w


def read(w: dict, n_langs: int, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the likeliest language (-1: no letter) and its mean probability."""
    bodies = [t.lower().encode("utf-8", "surrogatepass") if t and letters(t) else b"" for t in texts]
    sizes = np.array([len(b) for b in bodies])
    data = np.frombuffer(b"".join(bodies), np.uint8)
    base = np.cumsum(sizes) - sizes
    spans = np.array([(k, *window) for k, n in enumerate(sizes.tolist()) for window in windows(n)], np.int64).reshape(-1, 5)
    total = np.zeros((len(texts), n_langs))
    length = spans[:, 2] - spans[:, 1]
    for size in np.unique(length).tolist():
        own = spans[length == size]
        at = np.arange(size)
        for i in range(0, len(own), RUN_WINDOWS):
            doc, begin, _, first, stop = own[i : i + RUN_WINDOWS].T
            place = begin[:, None] + at
            counts = (place >= first[:, None]) & (place < stop[:, None])
            np.add.at(total, doc, position_sums(w, data[base[doc][:, None] + place], counts))
    mean = np.round(total / np.maximum(sizes, 1)[:, None], 5)
    return np.where(sizes > 0, mean.argmax(1), -1), np.where(sizes > 0, np.clip(mean.max(1), 0, 1), 0.0)


def first_marks(marks: DataFrame) -> DataFrame:
    """The DOCS_PER_LANG smallest marks of each language. They are ranked within SLOTS slots of a
    language first, so that a language of most rows is spread, and one task ranks at most SLOTS times
    DOCS_PER_LANG of them."""
    for by in (["lang", F.pmod("mark", F.lit(SLOTS))], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("mark"))
        marks = marks.withColumn("place", place).where(F.col("place") <= DOCS_PER_LANG).drop("place")
    return marks


def predict(documents: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score); learns from rows with a language that are not held out."""
    docs = documents.select(documents[key].alias("doc_id"), documents[text].alias("text"))
    rows = documents.select(documents[key].alias("doc_id"), documents[text].alias("text"), documents[lang].alias("lang"))
    known = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0) & (F.char_length("text") <= TRAIN_CHARS))
    # Rows are chosen by a hash of id and text, which is all that the ranking moves.
    mark = F.xxhash64("doc_id", "text")
    marks = first_marks(known.select("lang", mark.alias("mark")).distinct()).select(F.col("lang").alias("its"), "mark")
    picked = known.withColumn("mark", mark).join(F.broadcast(marks), ["mark"]).where(F.col("lang") == F.col("its"))
    got = picked.dropDuplicates(["mark", "lang"]).select("lang", "doc_id", "text").collect()
    got = sorted(tuple(r) for r in got)
    langs = sorted({r[0] for r in got})
    weights = train([r[2] for r in got], np.array([langs.index(r[0]) for r in got]), len(langs)) if langs else None

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            found, score = [], []
            if weights is None:
                found, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            at = 0
            while at < len(texts) and weights is not None:
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size < RUN_BYTES):
                    size, stop = size + 2 * len(texts[stop] or ""), stop + 1
                best, p = read(weights, len(langs), texts[at:stop])
                found += [langs[k] if k >= 0 else UNKNOWN for k in best]
                score += p.tolist()
                at = stop
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    scored = map_batches(docs, run, "doc_id bigint, lang_pred string, score double")
    return scored.select(F.col("doc_id").alias(key), held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")
