"""The corpus pipeline: five stages, each one corpus operator at work on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``; all but the last return the columns of ``documents``.

Nulls, empty and very long texts, repeated rows and empty tables are handled as the operators'
docstrings say. Of each group of near copies one row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewise.llm import bpe, mixing, shingles, suffixes, toxicity
from tablewise.llm.common import discard, read_table, sieve, sifted, stored, unused
from tablewise.llm.registry import TOKENIZER


def _digest(docs: DataFrame):
    return F.md5(F.coalesce(docs["text"], F.lit("")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half for toxicity."""
    score = unused(docs, "toxicity_score")
    scored = toxicity.with_scores(docs, read_table(spark, sf_dir, "labels"), score=score)
    return scored.where(F.col(score) < 0.5).drop(score)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (see ``shingles``): that with the smallest id, then digest
    of the text; of several such rows that whose columns, as JSON, have the smallest text."""
    groups = stored(shingles.near_copies(docs))
    sizes = groups.groupBy("component").agg(F.min(F.struct("doc", "digest")).alias("at"), F.count(F.lit(1)).alias("n"))
    # Rows that are alone stay where they are; a sieve tells nearly all of them from those of larger groups.
    larger = stored(sizes.where("n > 1"))
    members = stored(groups.join(larger.select("component"), "component", "left_semi"))
    rows = members.groupBy("doc", "digest").agg(F.count(F.lit(1)).alias("n"))
    doc, digest, n, near = (unused(docs, name) for name in ("kept_doc", "kept_digest", "kept_rows", "kept_near"))
    names = [F.coalesce(docs["doc_id"].cast("bigint"), F.lit((1 << 63) - 1)), _digest(docs)]
    marks = sieve(members.select(F.xxhash64("doc", "digest").alias("h")), members.count())
    sorted_out = sifted(docs.withColumns({doc: names[0], digest: names[1]}), F.xxhash64(doc, digest), marks, near)
    alone = sorted_out.where(~F.col(near)).select(*docs.columns)
    known = stored(rows.join(larger.select("at.*").withColumn("first", F.lit(True)), ["doc", "digest"], "left").select(F.col("doc").alias(doc), F.col("digest").alias(digest), F.when(F.col("first"), F.col("n")).otherwise(0).alias(n)))
    discard(members, larger)
    # Rows that only seem to be of a larger group are not among its rows, and stay too.
    left = sorted_out.where(near).join(known, [doc, digest], "left").withColumn(n, F.coalesce(n, F.lit(1)))
    # Only rows that repeat both id and text are grouped, and reduced before they move.
    again = left.where(F.col(n) > 1).groupBy(doc, digest).agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias("one")).select("one.*")
    return alone.unionByName(left.where(F.col(n) == 1).select(*docs.columns)).unionByName(again)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has too."""
    figures = [unused(docs, name) for name in suffixes.FIGURES]
    found = suffixes.remove_repeats(docs, figures=figures)
    changed = F.when(F.col(figures[1]) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", changed).select(*docs.columns)


def sample_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of documents whose tokens have the raked proportions, with topics named by all texts.
    Rows are chosen by id, text, source and language, so rows that share an id stand or fall by themselves."""
    found = mixing.sampled(docs, carry=_digest(docs), leads=mixing.lead_words_of_all(docs)).where("sampled = 1")
    names = [unused(docs, name) for name in ("its_id", "its_digest", "its_source", "its_lang")]
    chosen = stored(found.select("doc_id", "carried", "source", "lang").distinct().toDF(*names))
    plain = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    same = docs["doc_id"].eqNullSafe(chosen[names[0]]) & (_digest(docs) == chosen[names[1]]) & (plain("source") == chosen[names[2]]) & (plain("lang") == chosen[names[3]])
    return docs.join(chosen, same, "left_semi")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and the decoded texts."""
    return bpe.round_trip(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", keep_one_of_each),
    ("suffix_dedup", cut_repeats),
    ("mixing", sample_mixture),
    ("bpe", encode),
]

#: The first stage's model is not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
