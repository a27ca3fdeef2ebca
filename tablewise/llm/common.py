"""Shared plumbing of the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablewise.sources.paths import discard, scratch, stored

__all__ = ["discard", "give_back", "held_out", "labelled_sample", "map_batches", "meet", "read_table", "scratch", "sieve", "sifted", "slices", "stored", "unused"]

#: A key is hot if more than one in so many rows have it, so there are at most so many hot keys.
HOT_SHARE = 1_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True for rows kept from training: crc32(id as text) mod ``modulus`` is ``remainder``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def give_back() -> None:
    """Return memory that is free inside a worker to the system, for the next task's sake."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_batches(df: DataFrame, function: Callable[[Iterator], Iterator], schema: str | StructType) -> DataFrame:
    """``mapInArrow``, after which a task's worker, which stays for later tasks, gives memory back."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut into some of at most so many rows."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def meet(rows: DataFrame, facts: DataFrame, key: str, n: str, value: str) -> DataFrame:
    """``rows`` with the ``value`` that ``facts`` has for their ``key`` (null if none).

    ``facts`` has one row a key, and in ``n`` how many rows have it. Hot keys, of which there can be
    no more than HOT_SHARE, are broadcast; their rows and those without a key are dealt evenly, and
    all others meet by a join."""
    total = facts.agg(F.sum(n)).first()[0] or 0
    hot = facts.where(F.col(n) > total / HOT_SHARE).select(F.col(key).alias("_hot_key"), F.col(value).alias("_hot_value"))
    cold = facts.where(F.col(n) <= total / HOT_SHARE).select(F.lit(False).alias("_hot"), F.xxhash64(key).alias("_at"), F.col(key).alias("_key"), F.col(value).alias("_value"))
    placed = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    is_hot = F.col("_hot_key").isNotNull() | F.col(key).isNull()
    placed = placed.withColumns({"_is_hot": is_hot, "_place": F.when(is_hot, F.xxhash64(*rows.columns)).otherwise(F.xxhash64(key))})
    met = placed.join(cold, (F.col("_place") == F.col("_at")) & (F.col("_is_hot") == F.col("_hot")) & (F.col(key) == F.col("_key")), "left")
    return met.select(*rows.columns, F.coalesce("_hot_value", "_value").alias(value))


#: Bits of a sieve at most and of one of its slices, as powers of two.
SIEVE_BITS, SLICE_BITS = 27, 15


def sieve(hashes: DataFrame, n: int) -> DataFrame:
    """(slice, slices, bits) of n hashes (h): a bitmap that is the same size at most however many there are."""
    bits = max(SLICE_BITS, min(SIEVE_BITS, (16 * n).bit_length()))
    slices = 1 << (bits - SLICE_BITS)

    def pack(table: pa.Table) -> pa.Table:
        own = np.zeros(1 << SLICE_BITS, bool)
        own[table.column("place").to_numpy()] = True
        return pa.table([pa.array([table.column("slice")[0].as_py()], pa.int32()), pa.array([slices], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], ["slice", "slices", "bits"])

    split = hashes.select(_slice(F.col("h"), slices).alias("slice"), _place(F.col("h")).alias("place")).distinct()
    return stored(split.groupBy("slice").applyInArrow(pack, "slice int, slices int, bits binary"))


def _slice(h: Column, slices: int) -> Column:
    return F.shiftrightunsigned(h, 64 - SIEVE_BITS + SLICE_BITS).bitwiseAND(F.lit(slices - 1)).cast("int")


def _place(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << SLICE_BITS) - 1)).cast("int")


def sifted(rows: DataFrame, h: Column, by: DataFrame, flag: str) -> DataFrame:
    """``rows`` with a ``flag``: false only where the hash is certainly not among the sieve's. No row moves."""
    slices = (by.select("slices").first() or [1])[0]
    asked = rows.withColumns({"_sieve_at": _slice(h, slices), "_sieve_bit": _place(h)})
    met = asked.join(F.broadcast(by.select(F.col("slice").alias("_sieve_at"), F.col("bits").alias("_sieve_bits"))), "_sieve_at", "left")
    byte = F.conv(F.hex(F.substring("_sieve_bits", F.shiftright("_sieve_bit", 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, 7 - F.col("_sieve_bit").bitwiseAND(F.lit(7)))
    return met.withColumn(flag, F.coalesce(bit == 1, F.lit(False))).select(*rows.columns, flag)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows_per_class: int, most_chars: int) -> DataFrame:
    """(doc_id, text, y): at most ``rows_per_class`` rows of each class, out of the labelled rows of
    at most ``most_chars`` characters.

    The choice is by the smallest hashes of id and text, so it does not depend on order or
    partitions. Ids are chosen first, which bounds what is broadcast, and then rows, which bounds
    what is collected even if an id repeats. An id whose labels disagree counts as 1."""
    short = documents.where(F.coalesce(F.char_length("text"), F.lit(0)) <= most_chars).select("doc_id", "text")
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.max("y").alias("y"))
    near = known.join(short.select("doc_id"), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = [near.where(F.col("y") == y).orderBy(*order).limit(rows_per_class) for y in (0, 1)]
    found = short.join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")
    order = [F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.col("doc_id")]
    rows = [found.where(F.col("y") == y).orderBy(*order).limit(rows_per_class) for y in (0, 1)]
    return rows[0].unionByName(rows[1])
