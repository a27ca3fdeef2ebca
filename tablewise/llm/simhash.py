"""SimHash near-duplicates through Golay-code fuzzy hashing.

Fingerprints: 64-bit SimHash over the XXH64 (seed 42) of 3-word shingles. Two fingerprints link at
Hamming distance ``RADIUS`` = 3 or less, and components are the links' transitive closure.

Candidates: a fingerprint is cut into three segments of 22, 21 and 21 bits. The binary Golay code
[23,12,7] is perfect, so a segment has exactly one codeword within distance 3 (its *own* index),
and at most five more at distance 4 (its *near* indices). Flipping one bit of a segment moves it at
most one step, so the own index of one of two segments that differ in one bit or none is among the
own and near indices of the other. Three errors fall on the segments in one of three ways, and each
has a kind of key:

* all on one segment: the two other segments are equal (3 keys);
* on two segments, at most one of them with two errors: the third is equal, and another one has at
  most one error, so equal bits go with a Golay index (6 keys; 6 sets of fuzzy keys to probe with);
* one on each: three Golay indices (1 key; up to 216 fuzzy keys to probe with).

Each distinct fingerprint enters the index under its 10 own keys and probes with its fuzzy keys;
an equi-join on the key with the exact distance as a further condition gives the links. A key has
34 to 43 bits, so a probe meets few strangers up to billions of fingerprints. Index keys with more
than ``HOT`` fingerprints leave the join: every fingerprint that meets such a key links through
the points of its Hamming balls instead, where links need no pairs: two fingerprints are within 3
exactly if some point is within 1 of one and within 2 of the other, and all that are within 2 of
a point with something within 1 belong together. That costs 2,081 rows a fingerprint whatever the
size of the group.

Components are those of fingerprints, so it does not matter which ids stand for them.

Defined results: null, empty and wordless texts have fingerprint zero and link like any other;
fewer than three words are one shingle; repeated shingles count; equal texts share a component; rows
with a null id link like any other and take the smallest id of their component, which is null only
if none of its rows has an id; rows with one id are rows of their own; further input columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import discard, map_batches, meet, stored
from tablewise.operators.graph import components

RADIUS = 3
SHINGLE, SEED = 3, 42
#: Segments as (shift, bits).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: a generator polynomial of the binary Golay code.
GENERATOR = 0xAE3
#: Fingerprints under one index key beyond which links go through Hamming balls.
HOT = 5_000
#: Fingerprints, each with some 200 keys, that a task turns into keys.
TASK_PRINTS = 10_000
BLOCK = 100_000


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text, lower-casing A-Z only and splitting at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp): fp as a signed 64-bit integer."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return map_batches(docs.select(docs[key].alias("doc_id"), docs[text].alias("text")), run, "doc_id bigint, fp bigint")


@cache
def golay_patterns() -> tuple[np.ndarray, np.ndarray]:
    """Check bits of each 12-bit message, and for each syndrome the error patterns of weight 4 or
    less that have it, lightest first, filled up with -1."""
    check = np.zeros(4096, np.int64)
    for m in range(4096):
        rest = m << 11
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= GENERATOR << (bit - 11)
        check[m] = rest
    errors = [[] for _ in range(2048)]
    level = [(0, -1)]
    for weight in range(5):
        for e, _ in level:
            s = (e & 2047) ^ int(check[e >> 11])
            if not errors[s] or weight == 4 and errors[s][0].bit_count() == 3:
                errors[s].append(e)
        level = [(e | 1 << b, b) for e, top in level for b in range(top + 1, 23)]
    width = max(map(len, errors))
    return check, np.array([e + [-1] * (width - len(e)) for e in errors], np.int64)


def golay_indices(segment: np.ndarray) -> np.ndarray:
    """(n, 6) message indices of the codewords near each segment: own first, -1 where there is none."""
    check, patterns = golay_patterns()
    error = patterns[(segment & 2047) ^ check[segment >> 11]]
    return np.where(error >= 0, (segment[:, None] ^ error) >> 11, -1)


def _pack(kind: int, parts: list[np.ndarray]) -> np.ndarray:
    """A key from its kind and (value, bits) parts; -1 where a part is missing."""
    key, bad = np.int64(kind), np.bool_(False)
    for value, bits in parts:
        bad = bad | (value < 0)
        key = key << np.int64(bits) | value
    return np.where(bad, -1, key)


def keys(fp: np.ndarray, fuzzy: bool) -> np.ndarray:
    """(n, k) keys of fingerprints: own ones for the index, or fuzzy ones to probe it; -1: none."""
    bits = fp.view(np.uint64)
    exact = [((bits >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
    index = [golay_indices(e) if fuzzy else golay_indices(e)[:, :1] for e in exact]
    out = []
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        out.append(_pack(1 + k, [(exact[i], 22), (exact[j], 22)])[:, None])
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))):
        out.append(_pack(4 + k, [(exact[i][:, None], 22), (index[j], 22)]))
    triple = _pack(10, [(index[0][:, :, None, None], 12), (index[1][:, None, :, None], 12), (index[2][:, None, None, :], 20)])
    return np.concatenate([*out, triple.reshape(len(fp), -1)], axis=1)


def _keyed(reps: DataFrame, fuzzy: bool) -> DataFrame:
    def run(batches):
        for b in batches:
            fps = b.column(0).to_numpy()
            for at in range(0, len(fps), 2_000):
                fp = fps[at : at + 2_000]
                found = keys(fp, fuzzy)
                row, column = np.nonzero(found >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(found[row, column]), pa.array(fp[row])], ["key", "fp"])

    return map_batches(reps.select("fp"), run, "key bigint, fp bigint")


def _ball_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect fingerprints within RADIUS, by shared points of their balls."""
    bit = F.array(*[F.shiftleft(F.lit(1).cast("bigint"), k) for k in range(64)])
    ones = F.transform(bit, lambda x: F.col("fp").bitwiseXOR(x))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.transform(F.slice(bit, i + 2, 64), lambda y: F.col("fp").bitwiseXOR(F.get(bit, i)).bitwiseXOR(y))))
    near = fps.select("fp", F.explode(F.concat(F.array("fp"), ones)).alias("point"), F.lit(1).alias("at"))
    far = fps.select("fp", F.explode(pairs).alias("point"), F.lit(2).alias("at"))
    points = stored(near.unionByName(far))
    hub = points.groupBy("point").agg(F.min("fp").alias("hub"), F.min("at").alias("at"), F.count("*").alias("n")).where("at = 1 and n > 1")
    return points.join(hub.select("point", "hub"), "point").select(F.col("fp").alias("a"), F.col("hub").alias("b")).where("a <> b")


def links(reps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all within RADIUS bits."""
    # Splits follow the small input, not its keys, so fingerprints are dealt anew.
    spark = reps.sparkSession
    reps = reps.select("fp").repartition(max(spark.sparkContext.defaultParallelism, -(-reps.count() // TASK_PRINTS)), "fp")
    index, probe = stored(_keyed(reps, False)), _keyed(reps, True)
    hot = stored(index.groupBy("key").count().where(F.col("count") > HOT).select("key"))
    apart = None
    if hot.limit(1).count():
        met = index.unionByName(probe).join(hot, "key", "left_semi").select("fp").distinct()
        apart, index = _ball_links(stored(met)), index.join(hot, "key", "left_anti")
    near = F.bit_count(F.col("p.fp").bitwiseXOR(F.col("i.fp"))) <= RADIUS
    # Spark takes the probes, made in Python, to be as few as the fingerprints, and would broadcast them.
    found = probe.hint("merge").alias("p").join(index.alias("i"), (F.col("p.key") == F.col("i.key")) & near & (F.col("p.fp") != F.col("i.fp")))
    found = found.select(F.greatest("p.fp", "i.fp").alias("a"), F.least("p.fp", "i.fp").alias("b"))
    return (found if apart is None else found.unionByName(apart)).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component_id): the smallest key reachable over links, itself included."""
    prints = stored(fingerprints(docs, text, key))
    reps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    found = stored(links(reps))
    roots = components(found.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    rooted = stored(reps.join(roots, reps["fp"] == roots["node"], "left").select("fp", "n", "rep", F.coalesce("component", "fp").alias("root")))
    discard(found)
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("members"))
    named = stored(meet(rooted, least, "root", "members", "component_id"))
    return meet(prints, named, "fp", "n", "component_id").select(F.col("doc_id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
