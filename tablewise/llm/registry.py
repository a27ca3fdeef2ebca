"""The corpus operators' queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.llm import alignment, bpe, debruijn, langid, media, mixing, quality, simhash, suffixes, toxicity, vectors, warc, whitening
from tablewise.llm.common import read_table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ALIGNED = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_read(read_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(read_table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.sampled(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "sampled")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_table(spark, sf_dir, "embeddings")
    return vectors.nearest(found, found.where("vec_id % 20 = 0"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(read_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), TOKENIZER)


def op11_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = debruijn.remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read_table(spark, sf_dir, "documents"), *ALIGNED)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(read_table(spark, sf_dir, "embeddings")))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_media": op2_media,
    "op3_simhash": op3_simhash,
    "op4_warc": op4_warc,
    "op5_mixing": op5_mixing,
    "op6_quality": op6_quality,
    "op7_graph_ann": op7_graph_ann,
    "op8_suffixes": op8_suffixes,
    "op9_langid": op9_langid,
    "op10_bpe": op10_bpe,
    "op11_debruijn": op11_debruijn,
    "op12_alignment": op12_alignment,
    "op13_whitening": op13_whitening,
}
OP4_SQL = """
WITH heads AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
    SELECT payload_digest, payload_bytes, max(page_id) AS keeper FROM heads WHERE payload_bytes >= 1000 GROUP BY ALL
)
SELECT h.page_id, CAST(h.payload_bytes AS BIGINT) AS payload_bytes, h.payload_digest,
       CASE WHEN f.keeper IS NULL OR f.keeper IS NOT DISTINCT FROM h.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.keeper IS DISTINCT FROM h.page_id THEN f.keeper END AS refers_to
FROM heads h LEFT JOIN firsts f USING (payload_digest, payload_bytes)
"""

#: Sweeps over the three marginals after which nothing moves on the given tables.
SWEEPS = 600


def _op5_sql() -> str:
    """Topics, goals and plain sweeps of raking; their limit does not depend on the way to it."""
    lead = f"""sampled_texts AS MATERIALIZED (
    SELECT lower(coalesce(text, '')) AS t FROM documents WHERE length(coalesce(text, '')) <= {mixing.SAMPLE_CHARS}
    ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) LIMIT {mixing.SAMPLE}
), leads AS MATERIALIZED (
    SELECT word, row_number() OVER (ORDER BY n DESC, word) AS place FROM (
        SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(t, '{mixing.LONG_WORD}'))) AS word FROM sampled_texts) GROUP BY word)
    WHERE n <= {mixing.SAMPLE} / 4 ORDER BY place LIMIT {mixing.LEADS}
), topics AS MATERIALIZED (
    SELECT row_id, arg_min(word, place) AS topic FROM (
        SELECT row_id, word, place, (length(t) - length(replace(t, word, ''))) // length(word) AS k, max(k) OVER (PARTITION BY row_id) AS most
        FROM (SELECT rowid_ AS row_id, lower(coalesce(text, '')) AS t FROM d0), leads)
    WHERE k = most AND k > 0 GROUP BY row_id
)"""
    temper = mixing.TEMPER
    steps = ["d0 AS MATERIALIZED (SELECT *, row_number() OVER () AS rowid_ FROM documents)", lead, f"""d AS MATERIALIZED (
    SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(topic, '{mixing.OTHER_TOPIC}') AS topic,
           CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS n_tokens FROM d0 LEFT JOIN topics ON rowid_ = row_id
), cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS n FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)"""]
    for level in ("source", "lang", "topic"):
        steps.append(f"goal_{level} AS MATERIALIZED (SELECT {level}, sum(pow(n, {temper})) / sum(sum(pow(n, {temper}))) OVER () AS goal FROM cells GROUP BY {level})")
    # Sources, languages and topics in turn, until far below what rounding shows.
    now = "JOIN r l ON l.kind = 'l' AND l.level = lang JOIN r t ON t.kind = 't' AND t.level = topic"
    fit_source = "SELECT source, any_value(goal) / sum(n * l.f * t.f) AS a FROM cells {now} JOIN goal_source USING (source) GROUP BY source"
    steps.append(f"""r(i, kind, level, f) AS (
    SELECT 0, 'l', lang, 1.0::DOUBLE FROM goal_lang UNION ALL SELECT 0, 't', topic, 1.0::DOUBLE FROM goal_topic
    UNION ALL
    (WITH s AS ({fit_source.format(now=now)}),
     nl AS (SELECT lang, any_value(l.f) * any_value(goal) / sum(n * a * l.f * t.f) AS f FROM cells JOIN s USING (source) {now} JOIN goal_lang USING (lang) GROUP BY lang),
     nt AS (SELECT topic, any_value(t.f) * any_value(goal) / sum(n * a * nl.f * t.f) AS f FROM cells JOIN s USING (source) JOIN nl USING (lang) JOIN r t ON t.kind = 't' AND t.level = topic JOIN goal_topic USING (topic) GROUP BY topic),
     k AS (SELECT max(i) AS i FROM r)
     SELECT k.i + 1, 'l', lang, f FROM nl, k WHERE k.i < {SWEEPS} UNION ALL SELECT k.i + 1, 't', topic, f FROM nt, k WHERE k.i < {SWEEPS})
)""")
    steps.append(f"ll AS MATERIALIZED (SELECT level AS lang, f AS b FROM r WHERE i = {SWEEPS} AND kind = 'l'), tt AS MATERIALIZED (SELECT level AS topic, f AS c FROM r WHERE i = {SWEEPS} AND kind = 't')")
    steps.append("ss AS MATERIALIZED (SELECT source, any_value(goal) / sum(n * b * c) AS a FROM cells JOIN ll USING (lang) JOIN tt USING (topic) JOIN goal_source USING (source) GROUP BY source)")
    factor = "coalesce(a, 1) * coalesce(b, 1) * coalesce(c, 1)"
    joins = "LEFT JOIN ss USING (source) LEFT JOIN ll USING (lang) LEFT JOIN tt USING (topic)"
    steps.append(f"top AS MATERIALIZED (SELECT max({factor}) AS most, sum(n) AS whole FROM cells {joins})")
    steps.append(f"w AS (SELECT d.*, {factor} * whole AS weight, least(1.0, {factor} / most) AS p FROM d {joins} CROSS JOIN top)")
    return "WITH RECURSIVE " + ",\n".join(steps) + """
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(p, 6) AS probability,
       CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < p AS INTEGER) AS sampled FROM w"""


ORACLES: dict[str, str] = {"op4_warc": OP4_SQL, "op5_mixing": _op5_sql()}
