"""Queries of this subpackage over the driver's tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from jobtide.llm import (
    byte_bpe,
    decontaminate,
    hnsw,
    language,
    lm,
    minhash,
    oracles,
    packing,
    prefixes,
    secrets,
    shards,
    token_counts,
    url_lists,
    variants,
)
from jobtide.llm.batches import Scratch

#: Production parameters.
TOKEN_VOCABULARY = "word_bpe_49k.json"
BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
SHARDS = 8
PACKED_VOCABULARY = "byte_bpe_50k.json"
WINDOW = 1024


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return found.select(*columns) if columns else found


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return token_counts.count_tokens(documents, public_tokenizers.path(TOKEN_VOCABULARY), keep=["doc_id"])


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    held_out = language.remainder("doc_id", 7) == 2
    found = lm.learn_and_score(documents, ~held_out, Scratch(spark), id_col="doc_id", keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    benchmark = table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.find_benchmark(documents, benchmark, keep=["doc_id"]))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    path = public_tokenizers.path(BPE_RANKS)
    return byte_bpe.digests(documents, path, public_tokenizers.PATTERN, keep=["doc_id"])


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return secrets.digest(secrets.find_secrets(documents, keep=["doc_id"]))


def op5_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return hnsw.near_vectors(embeddings, keep=["vec_id"])


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return minhash.near_duplicates(documents, keep=["doc_id"])


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return shards.digest(shards.assign_shards(documents, SHARDS, keep=["doc_id"]))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language.learn(documents.where(language.remainder("doc_id", 5) != 0))
    found = language.identify(documents, model, keep=["doc_id"])
    held_out = (language.remainder("doc_id", 5) == 0).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score")


def op10_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = url_lists.dated_captures(table(spark, sf_dir, "pages", "page_id", "url"))
    found = url_lists.filter_urls(captures, url_lists.production_list(spark), keep=["page_id", "fetched_at"])
    return url_lists.digest(found)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.digest(packing.pack(documents, public_tokenizers.path(PACKED_VOCABULARY), WINDOW, keep=["doc_id"]))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_lm_scores, op3_decontaminate, op4_byte_bpe, op5_hnsw, op6_minhash, op7_shards, op8_secrets, op9_language, op10_url_lists, op11_packing, op12_variants, op13_prefix_trie)
}

QUERIES |= oracles.projections(QUERIES)

ORACLES = oracles.ORACLES | {
    "op1_token_counts": oracles.token_counts(public_tokenizers.path(TOKEN_VOCABULARY)),
    "op10_url_lists": url_lists.ORACLE,
    "op3_decontaminate": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
p AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
o AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM d, (SELECT DISTINCT n FROM p), unnest(range(1, len(w) - n + 2)) AS t(i)),
h AS (SELECT o.doc_id, o.i, o.n, p.item FROM o JOIN p ON o.n = p.n AND o.s = p.s),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM h, unnest(range(i, i + n)) AS t(j) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM h WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
