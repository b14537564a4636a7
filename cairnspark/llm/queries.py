"""The queries of the training-data operators: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import read, written


#: The old layout that resharding starts from: whole sources, by their hash, in this many shards.
OLD_SHARDS = 6


def old_layout() -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce("source", F.lit("")), "UTF-8")), F.lit(OLD_SHARDS)).cast("int")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.placed(read(spark, sf_dir, "documents")).select("doc_id", "source", "block", "slot", "position")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs), {"doc_id": F.col("doc_id")})


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    found = decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard_join

    return jaccard_join.link_groups(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_id

    docs = read(spark, sf_dir, "documents")
    held_out = language_id.held_out(F.col("doc_id"))
    model = language_id.train(docs.where(~held_out))
    return language_id.predict(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out})


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neighbours

    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_id, lm_score

    docs = read(spark, sf_dir, "documents")
    held_out = language_id.held_out(F.col("doc_id"), 2, 7)
    model = lm_score.train(docs.where(~held_out), min_count=1)  # every n-gram of the training texts counts
    scores = written(lm_score.score(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out}), "scores")
    lm_score.forgotten(spark, model)
    return scores


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    placed = sharding.place(read(spark, sf_dir, "documents"), old_layout(), old_shards=OLD_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_filter

    judged = url_filter.judge_urls(read(spark, sf_dir, "pages"), url_filter.HOST_RULES + url_filter.PATTERN_RULES)
    return judged.select("page_id", "host", "path", "rule", "pattern", "verdict")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import token_counts

    counted = token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_quality": op2_quality,
    "op3_decontamination": op3_decontamination,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_language_id": op5_language_id,
    "op6_neighbours": op6_neighbours,
    "op7_lm_score": op7_lm_score,
    "op8_sharding": op8_sharding,
    "op9_url_filter": op9_url_filter,
    "op10_token_counts": op10_token_counts,
}

_WORDS = "list_filter(string_split_regex(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) item, {_WORDS.format('text')} w FROM benchmark),
g AS (SELECT DISTINCT item, least(10, len(w)) n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') gram FROM i, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) t(k) WHERE len(w) > 0),
d AS (SELECT doc_id, row_number() OVER () rid, {_WORDS.format('text')} w FROM documents),
dw AS (SELECT rid, n, k, array_to_string(w[k:k + n - 1], ' ') gram FROM d, (SELECT DISTINCT n FROM g) l, unnest(generate_series(1, len(w) - n + 1)) t(k) WHERE len(w) >= n),
h AS (SELECT rid, k, dw.n, item FROM dw JOIN g ON dw.n = g.n AND dw.gram = g.gram),
c AS (SELECT rid, count(DISTINCT p) n_hit FROM h, unnest(generate_series(k, k + n - 1)) t(p) GROUP BY rid),
ki AS (SELECT rid, count(*) n_items, string_agg(item, ',' ORDER BY item) items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
  sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN ki USING (rid)""",
    "op9_url_filter": """
WITH u AS (SELECT page_id, coalesce(url, '') url FROM pages),
p AS (SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') low,
  translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') path FROM u),
r AS (SELECT *, CASE
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END rule FROM p),
m AS (SELECT *, CASE WHEN rule IS NOT NULL THEN NULL
  WHEN regexp_matches(low, '://[^/?#]*\\badult\\b') THEN 'adult'
  WHEN regexp_matches(low, '://[^/?#]*\\bcasino\\b') THEN 'casino'
  WHEN regexp_matches(low, '://([^/?#]*\\.)?cheap-pills\\.') THEN 'cheap pills'
  WHEN regexp_matches(low, '://([^/?#]*\\.)?spam-farm\\.') THEN 'spam farm'
  WHEN regexp_matches(low, '[?&]utm_source=feed\\b') THEN 'feed tracking' END pattern FROM r)
SELECT page_id, host, path, rule, pattern,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN pattern IN ('adult', 'casino', 'cheap pills', 'spam farm') THEN 'block' ELSE 'allow' END verdict
FROM m""",
}
