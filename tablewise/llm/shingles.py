"""Near copies by exact Jaccard similarity of 5-word shingles.

Two texts link at a similarity of ``LEAST`` (4/5) or more over their sets of shingles (as 64-bit
hashes), and components are the links' transitive closure. Texts with the same set are one node.

Candidates are, first, texts whose SimHash fingerprints are linked, directly or through others, at up to
``simhash.RADIUS`` bits: the component of the fingerprint is one of a text's keys. SimHash at 3 bits
reaches only the nearest copies, so candidates also share one of ``BANDS`` further keys, each made of ``ROWS`` MinHash values: a pair of similarity s
meets with probability 1 - (1 - s^5)^25, which is 0.99995 at 0.8. No similarity is estimated: every
candidate is decided on the shingles themselves.

Large groups: each key's nodes are first compared with two of them only, the smallest and the one that is
nearest to it, which is mostly one in the middle of the group. Pairs that these links already put into one
component need no comparison. For those left, 4 bits of each of the 125 values are compared as the keys
meet: of a pair at 0.8 more than ``MOST_UNLIKE`` differ with a probability of 1e-8, and most others go no
further.

No pair is sent to be decided that cannot be similar: every set has a bitmap in which each shingle turns one
bit over. Bits that differ between two bitmaps are at most as many as shingles that only one set has, so
where they are too many the pair is dropped without loss. Bitmaps have 4 to 8 bits a shingle, up to
``ODD_BITS``; beyond 16,384 shingles they are denser and drop less.

Defined results: null, empty and wordless texts have the empty set and are one node; fewer than five
words are one shingle; a text of any length is hashed whole; null ids count as the largest number, and
repeated rows stay, a row each; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.llm import simhash
from tablewise.llm.common import discard, map_batches, sieve, sifted, slices, stored
from tablewise.llm.simhash import fingerprint
from tablewise.llm.suffixes import _mix
from tablewise.operators import ordered
from tablewise.operators.graph import components

SHINGLE, SEED = 5, 42
#: Least similarity as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 25, 5
#: Shingles of a block of sets that are compared in one place.
BLOCK_SHINGLES = 500_000
#: Of the MinHash values of similar sets, how many may differ.
MOST_UNLIKE = 50
#: Bits of a bitmap of shingles at most.
ODD_BITS = 1 << 16
#: Words, and shingles, that are hashed at once.
WORDS, BLOCK = 100_000, 2_048
#: Texts whose sets a task holds at once.
TEXTS = 500
_MASK, _FACTOR = np.random.default_rng(8).integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64)
_FACTOR = _FACTOR | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, lower-casing A-Z only and splitting at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    found = []
    for at in range(0, len(words) - SHINGLE + 1, WORDS):
        part = words[at : at + WORDS + SHINGLE - 1]
        w = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in part), np.uint64, len(part))
        n = len(w) - SHINGLE + 1
        h = w[:n]
        for k in range(1, SHINGLE):
            h = _mix(h, w[k : k + n])
        found.append(np.unique(h))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def minima(found: np.ndarray) -> np.ndarray:
    """BANDS x ROWS MinHash values of a set of shingles."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), BLOCK):
        low = np.minimum(low, ((found[None, at : at + BLOCK] ^ _MASK) * _FACTOR).min(1))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """BANDS keys from MinHash values."""
    low = low.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key, low[:, k])
    return key


def sketch(low: np.ndarray) -> np.ndarray:
    """Four bits of each MinHash value, sixteen to a number."""
    bits = np.zeros(-(-len(low) // 16) * 16, np.uint64)
    bits[: len(low)] = low & np.uint64(15)
    return np.bitwise_or.reduce(bits.reshape(-1, 16) << np.arange(0, 64, 4, dtype=np.uint64), 1)


def unlike(a: Column, b: Column) -> Column:
    """How many MinHash values of two sketches differ."""
    x = [F.get(a, k).bitwiseXOR(F.get(b, k)) for k in range(-(-BANDS * ROWS // 16))]
    any_of_four = [v.bitwiseOR(F.shiftrightunsigned(v, 1)) for v in x]
    ones = [v.bitwiseOR(F.shiftrightunsigned(v, 2)).bitwiseAND(F.lit(0x1111111111111111)) for v in any_of_four]
    return reduce(Column.__add__, [F.bit_count(v) for v in ones])


def odd_bits(found: np.ndarray) -> np.ndarray:
    """Bitmap in which each shingle turns one bit over; its first and second half together are that of half the size."""
    width = min(ODD_BITS, max(64, 1 << (4 * len(found) - 1).bit_length()))
    ones = np.bincount((found & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little").view("<i8")


def unmatched(odd_a: Column, odd_b: Column, size_a: Column, size_b: Column) -> Column:
    """Of how many shingles, at least, only one of two sets has each."""
    longer, shorter = (F.when((F.size(odd_a) >= F.size(odd_b)) == first, odd_a).otherwise(odd_b) for first in (True, False))
    half = (F.size(longer) / 2).cast("int")
    xor = lambda x, y: x.bitwiseXOR(y)
    total = lambda x: F.aggregate(x, F.lit(0), lambda n, v: n + F.bit_count(v))
    even = F.when(F.size(odd_a) == F.size(odd_b), total(F.zip_with(odd_a, odd_b, xor)))
    folded = F.zip_with(F.slice(longer, 1, half), F.slice(longer, half + 1, half), xor)
    # Widths that are further apart are of sizes that are not similar.
    bits = even.when(half == F.size(shorter), total(F.zip_with(folded, shorter, xor))).otherwise(0)
    return F.greatest(bits, F.abs(size_a - size_b))


def can_link(apart: Column, size_a: Column, size_b: Column) -> Column:
    """Whether sets of these sizes can be similar if ``apart`` shingles or more are in only one of them."""
    part, whole = LEAST
    return (part + whole) * apart <= (whole - part) * (size_a + size_b)


def set_name(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.md5(found.tobytes()).digest()[:8], "little", signed=True)


def _prints(rows: DataFrame) -> DataFrame:
    """(doc, digest, node, fp, keys, sketch, odd, size) of rows (doc, digest, text)."""

    def run(batches):
        for b in slices(batches, TEXTS):
            texts = b.column(2).to_pylist()
            sets = [shingles(t) for t in texts]
            prints = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            lows = [minima(s) for s in sets]
            keys, sketches = ([f(low).view(np.int64).tolist() for low in lows] for f in (band_keys, sketch))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(set_name, sets), pa.int64()), pa.array(prints), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64())), pa.array(map(odd_bits, sets), pa.list_(pa.int64())), pa.array(map(len, sets), pa.int64())], ["doc", "digest", "node", "fp", "keys", "sketch", "odd", "size"])

    return map_batches(rows, run, "doc bigint, digest string, node bigint, fp bigint, keys array<bigint>, sketch array<bigint>, odd array<bigint>, size bigint")


def _fingerprint_keys(prints: DataFrame) -> DataFrame:
    """(node, k): nodes by the component of their SimHash fingerprint."""
    fps = stored(prints.select("node", "fp").distinct())
    found = stored(simhash.links(fps.select("fp").distinct()))
    roots = components(found.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnsRenamed({"node": "fp", "component": "linked"})
    out = stored(fps.join(roots, "fp", "left").select("node", F.xxhash64(F.lit("simhash"), F.coalesce("linked", "fp")).alias("k")).distinct())
    discard(fps, found)
    return out


def _sets(rows: DataFrame) -> DataFrame:
    """(node, s) of rows (text)."""

    def run(batches):
        for b in slices(batches, TEXTS):
            sets = [shingles(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(set_name, sets), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "s"])

    return map_batches(rows, run, "node bigint, s array<bigint>")


def _sized(prints: DataFrame, keyed: DataFrame) -> DataFrame:
    """(node, block): nodes in the order of their most common key, cut into blocks of about BLOCK_SHINGLES."""
    place = keyed.groupBy("node").agg(F.max(F.struct("n", "k")).alias("m")).select("node", F.col("m.n").alias("n"), F.col("m.k").alias("k"))
    sizes = prints.groupBy("node").agg(F.first("size").alias("size"))
    placed = ordered.placed(place.join(sizes, "node").withColumn("all", F.lit(0)), ["all"], ["n", "k", "node"])
    out = stored(ordered.running(placed, ["all"], ["n", "k", "node"], {"upto": F.col("size")}).select("node", F.floor(F.col("upto") / BLOCK_SHINGLES).alias("block")))
    discard(placed)
    return out


def _similar(pairs: DataFrame, texts: DataFrame, known: DataFrame, blocks: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar enough, written.

    Pairs are gathered by the two blocks that their nodes are in, and a set is sent once to each such
    place that needs it, not once a pair."""
    of = lambda side: blocks.select(F.col("node").alias(side), F.col("block").alias(f"block_{side}"))
    placed = stored(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.least("block_a", "block_b").alias("low"), F.greatest("block_a", "block_b").alias("high")))
    needed = stored(placed.select("low", "high", F.explode(F.array("a", "b")).alias("node")).distinct())
    wanted = stored(known.join(needed.select("node").distinct(), "node", "left_semi").select("at.*"))
    # Texts are large and few are wanted: a sieve keeps nearly all others from being moved.
    name = F.xxhash64("doc", "digest")
    few = sieve(wanted.select(name.alias("h")), wanted.count())
    near = sifted(texts, name, few, "near").where("near").drop("near")
    sets = stored(_sets(near.join(wanted, ["doc", "digest"], "left_semi").select("text")).dropDuplicates(["node"]))
    discard(few)
    sent = needed.join(sets, "node")
    part, whole = LEAST

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        values = right.column("s").combine_chunks()
        flat, ends = values.flatten().to_numpy().view(np.uint64), values.offsets.to_numpy()
        start = dict(zip(right.column("node").to_pylist(), range(right.num_rows)))
        own = [flat[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
        kept = []
        for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist()):
            x, y = own[start[a]], own[start[b]]
            both = np.sort(np.concatenate([x, y]), kind="stable")
            if int((both[1:] == both[:-1]).sum()) * (part + whole) >= part * len(both):
                kept.append((a, b))
        return pa.table([pa.array([p[k] for p in kept], pa.int64()) for k in (0, 1)], ["a", "b"])

    out = stored(placed.groupBy("low", "high").cogroup(sent.groupBy("low", "high")).applyInArrow(run, "a bigint, b bigint"))
    discard(placed, needed, wanted, sets)
    return out


def _facts(prints: DataFrame, keyed: DataFrame) -> DataFrame:
    """(node, size, sketch, odd) of the nodes of ``keyed`` and few others, written."""
    nodes = stored(keyed.select("node").distinct())
    marks = sieve(nodes.select(F.xxhash64("node").alias("h")), nodes.count())
    near = sifted(prints.select("node", "size", "sketch", "odd"), F.xxhash64("node"), marks, "near").where("near").drop("near")
    out = stored(near.dropDuplicates(["node"]))
    discard(nodes, marks)
    return out


def _weighed(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """(a, b, apart, near) of distinct pairs (a, b), written: ``apart`` is no more than the shingles that
    only one of them has, and pairs that are not ``near`` are not similar."""
    of = lambda side: facts.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col("odd").alias(f"odd_{side}"))
    met = pairs.distinct().join(of("a"), "a").join(of("b"), "b").withColumn("apart", unmatched(*map(F.col, ("odd_a", "odd_b", "size_a", "size_b"))))
    return stored(met.select("a", "b", "apart", can_link(*map(F.col, ("apart", "size_a", "size_b"))).alias("near")))


def _hub_links(keyed: DataFrame, texts: DataFrame, known: DataFrame, blocks: DataFrame, facts: DataFrame) -> DataFrame:
    """Similar pairs of a key's hub, or of its member nearest to that, and the key's others, written."""
    first = keyed.where("node <> hub").select("k", "n", F.col("node").alias("a"), F.col("hub").alias("b"))
    weighed = _weighed(first.select("a", "b"), facts)
    nearest = first.where("n > 2").join(weighed, ["a", "b"]).groupBy("k").agg(F.min(F.struct("apart", "a")).alias("m")).select("k", F.col("m.a").alias("second"))
    others = keyed.join(nearest, "k").where("node <> hub and node <> second").select(F.col("node").alias("a"), F.col("second").alias("b"))
    again = _weighed(others, facts)
    out = _verified(weighed.unionByName(again).where("near").select("a", "b"), texts, known, blocks)
    discard(weighed, again)
    return out


def _roots(links: DataFrame) -> DataFrame:
    return components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("component", "root")


def _mixed(keyed: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (k, node, root) of the keys that still hold more than one component."""
    rooted = stored(keyed.join(roots, "node", "left").select("k", "node", F.coalesce("root", "node").alias("root")))
    mixed = rooted.groupBy("k").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("k")
    out = stored(rooted.join(mixed, "k", "left_semi"))
    discard(rooted)
    return out


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, digest, component): for every row its key (null: the largest number), the MD5 of its
    text, and a number that similar rows share, directly or through others."""
    body = F.coalesce(docs[text], F.lit(""))
    texts = docs.select(F.coalesce(docs[key].cast("bigint"), F.lit((1 << 63) - 1)).alias("doc"), F.md5(body).alias("digest"), body.alias("text"))
    prints = stored(_prints(texts))
    known = stored(prints.groupBy("node").agg(F.min(F.struct("doc", "digest")).alias("at")))
    linked = _fingerprint_keys(prints)
    every = stored(prints.select("node", F.explode("keys").alias("k")).unionByName(linked).distinct())
    groups = stored(every.groupBy("k").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    keyed = stored(every.join(groups, "k"))
    discard(every, groups, linked)
    blocks = _sized(prints, keyed)
    facts = _facts(prints, keyed)
    links = _hub_links(keyed, texts, known, blocks, facts)
    roots = stored(_roots(links))
    open_ = _mixed(keyed.where("n > 2"), roots)
    discard(keyed)
    sketched = open_.join(facts, "node")
    x, y = sketched.alias("x"), sketched.alias("y")
    near = can_link(unmatched(*map(F.col, ("x.odd", "y.odd", "x.size", "y.size"))), F.col("x.size"), F.col("y.size"))
    more = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & (unlike(F.col("x.sketch"), F.col("y.sketch")) <= MOST_UNLIKE) & near)
    if open_.limit(1).count():
        found = _verified(more.select(F.col("y.node").alias("a"), F.col("x.node").alias("b")), texts, known, blocks)
        every = stored(links.unionByName(found))
        discard(found, roots)
        roots = stored(_roots(every))
        discard(every)
    discard(links, open_, known, blocks, facts)
    return prints.join(roots, "node", "left").select("doc", "digest", F.coalesce("root", "node").alias("component"))


def _verified(pairs: DataFrame, texts: DataFrame, known: DataFrame, blocks: DataFrame) -> DataFrame:
    """The similar ones of some candidates, written."""
    distinct = stored(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    out = _similar(distinct, texts, known, blocks)
    discard(distinct)
    return out
