"""DuckDB SQL for the queries of this subpackage, in full or for those of their columns that SQL can say.

The queries here are projections of the registered ones to such columns; what depends on a trained model, a vocabulary
or a 64-bit hash is left to the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WORDS = r"""regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
#: CRC-32 of doc_id as text, by the usual table.
_CRC = """t AS (SELECT list(list_reduce(CAST([n, 0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS tab FROM range(256) AS r(n)),
c AS (SELECT doc_id, xor(list_reduce(CAST([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)) AS BIGINT[]),
  lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc FROM documents, t)"""
_TOKENS = r"""k AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') || [''] AS w FROM documents)"""


def projections(queries: dict) -> dict:
    """Queries by name, made of the registered ones."""

    def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = queries["op2_lm_scores"](spark, sf_dir)
        return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"), (F.col("score") < 0).alias("scored"))

    def bpe_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
        return queries["op4_byte_bpe"](spark, sf_dir).select("doc_id", "decoded_sha256", (F.col("n_tokens") > 0).alias("some"))

    def shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Of each document its size, whether its text is in one shard, and whether its shard's slots have no gap."""
        found = queries["op7_shards"](spark, sf_dir)
        text = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        of_text = found.join(text, "doc_id").groupBy("text").agg((F.min("shard") == F.max("shard")).alias("together"))
        of_shard = found.groupBy("shard").agg(((F.min("slot") == 0) & (F.max("slot") == F.count("*") - 1) & (F.count_distinct("slot") == F.count("*"))).alias("gapless"))
        return found.join(text, "doc_id").join(of_text, "text").join(of_shard, "shard").select("doc_id", "size", "law", "together", "gapless", F.col("shard").between(0, 7).alias("placed"))

    def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
        return queries["op8_secrets"](spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")

    def language_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Which rows are held out and undetermined, and the share of right ones among those held out."""
        found = queries["op9_language"](spark, sf_dir)
        told = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id", "lang")
        judged = found.join(told, "doc_id").withColumn("right", F.when(F.col("held_out") & (F.col("lang_pred") != "und") & F.col("lang").isNotNull(), (F.col("lang") == F.col("lang_pred")).cast("int")))
        share = F.avg("right").over(Window.partitionBy()) >= 0.95
        return judged.select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("undetermined"), F.col("score").between(0, 1).alias("scored"), share.alias("accurate"))

    made = (lm_base_scores, bpe_decoded, shard_rows, secret_base_spans, language_rows)
    return {f.__name__: f for f in made}


def _spans(kind: str, pattern: str, least: int, group: int, some: str) -> str:
    """Rows doc_id, kind, s, e of the leftmost non-overlapping matches: places are sums of what is between them.

    some: a pattern that every text with a match has, so that other texts are not taken apart.
    """
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, s, s + len(m) AS e FROM (
  SELECT doc_id, unnest(ms) AS m, unnest(gs) AS g, unnest(list_transform(range(1, len(ms) + 1), lambda i:
    CAST(list_sum(list_transform(ps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0) AS BIGINT))) AS s FROM (
    SELECT doc_id, regexp_extract_all(x, '{quoted}') AS ms, regexp_extract_all(x, '{quoted}', {group}) AS gs, string_split_regex(x, '{quoted}') AS ps
    FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents) WHERE regexp_matches(x, '{some}'))) WHERE len(g) >= {least}"""


_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def token_counts(path: str) -> str:
    """op1 from the vocabulary's file: of each word all pieces that it holds, the longest at each place, and the way from its start.

    A place past the last letter stands for the word's end.
    """
    return rf"""WITH RECURSIVE p AS (SELECT unnest(json_keys(content, '$.model.vocab')) AS piece FROM read_text('{path}')),
z AS (SELECT max(len(piece)) AS longest FROM p),
e AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS w FROM documents),
u AS (SELECT w, array_to_string(list_transform(range(octet_length(encode(w))), lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS INTEGER))
  .list_transform(lambda b: chr(CASE WHEN b < 33 THEN 256 + b WHEN b BETWEEN 127 AND 160 THEN b + 162 WHEN b = 173 THEN 323 ELSE b END)), '') AS m FROM (SELECT DISTINCT w FROM e)),
s AS (SELECT w, len(m) AS n, i, unnest(range(i, least(len(m) + 1, i + longest) + 1)) AS j, m FROM u, z, unnest(range(1, len(m) + 2)) AS t(i)),
b AS MATERIALIZED (SELECT w, n, i, max(j) AS j FROM s JOIN p ON piece = CASE WHEN j > n THEN m[i:n] || '</w>' ELSE m[i:j] END GROUP BY ALL),
r(w, i, k) AS (SELECT w, 1, 0 FROM u UNION ALL SELECT r.w, b.j + 1, r.k + 1 FROM r JOIN b ON r.w = b.w AND r.i = b.i),
c AS (SELECT u.w, coalesce(max(k) FILTER (i = len(m) + 2), 1) AS k FROM u JOIN r USING (w) GROUP BY u.w)
SELECT doc_id, CAST(count(e.w) AS BIGINT) AS n_words, CAST(coalesce(sum(k), 0) AS BIGINT) AS n_tokens FROM documents LEFT JOIN e USING (doc_id) LEFT JOIN c ON c.w = e.w GROUP BY doc_id"""


ORACLES = {
    "lm_base_scores": f"""WITH {_CRC}, {_TOKENS},
e AS (SELECT doc_id, unnest(w) AS w FROM k), n AS (SELECT w, count(*) AS c FROM e JOIN c USING (doc_id) WHERE crc % 7 <> 2 GROUP BY w),
z AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM n)
SELECT doc_id, crc % 7 = 2 AS held_out, count(*) AS n_tokens, CAST(count_if(n.c > 0) AS BIGINT) AS n_known, z.n AS train_tokens,
  round(sum(log10((coalesce(n.c, 0) + 1) / (z.n + z.v + 1))), 3) AS base_score, true AS scored
FROM e JOIN c USING (doc_id) LEFT JOIN n USING (w), z GROUP BY doc_id, crc, z.n""",
    "bpe_decoded": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256, coalesce(text, '') <> '' AS some FROM documents",
    "op5_hnsw": """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM embeddings LEFT JOIN m ON m.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op6_minhash": f"""WITH RECURSIVE d AS (SELECT doc_id, text, {_WORDS.format(text="text")} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS s FROM d),
f AS (SELECT doc_id, s, count(*) AS tf FROM s GROUP BY ALL), n AS (SELECT count(DISTINCT doc_id) AS n FROM f), q AS (SELECT s, count(*) AS df FROM f GROUP BY s),
x AS (SELECT doc_id, s, df, (1 + ln(tf)) * (1 + ln(1 / greatest(df / n, 1 / 512)) / ln(512)) AS w FROM f JOIN q USING (s), n),
g AS (SELECT doc_id, sum(w) AS w FROM x GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.w, b.w)) AS shared FROM (SELECT * FROM x WHERE df > 1) AS a JOIN (SELECT * FROM x WHERE df > 1) AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN g AS u ON u.doc_id = a JOIN g AS v ON v.doc_id = b WHERE shared >= 0.8 * (u.w + v.w - shared)
  UNION SELECT min(doc_id) OVER (PARTITION BY text), doc_id FROM d),
z AS (SELECT a, b FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b),
r(a, b) AS (SELECT a, b FROM z UNION SELECT r.a, z.b FROM r JOIN z ON r.b = z.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a),
k AS (SELECT doc_id, text IS NULL AS none, least(doc_id, coalesce(least, doc_id)) AS class_id FROM documents LEFT JOIN m ON m.a = doc_id)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_rows, doc_id = class_id AS kept FROM k""",
    "shard_rows": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, 'bytes' AS law, true AS together, true AS gapless, true AS placed FROM documents",
    "secret_base_spans": f"""WITH m AS ({_spans("assign", _ASSIGN, 8, 2, "[:=]")} UNION ALL {_spans("access", "AKIA[A-Z0-9]+", 16, 0, "AKIA")} UNION ALL {_spans("hex", "[0-9a-f]+", 32, 0, "[0-9a-f]{32}")}),
g AS (SELECT doc_id, count_if(kind = 'assign') AS a, count_if(kind = 'access') AS b, count_if(kind = 'hex') AS c,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, list_position(['assign', 'access', 'hex'], kind)) AS t FROM m GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex, sha256(coalesce(t, '')) AS base_sha256
FROM documents LEFT JOIN g USING (doc_id)""",
    "language_rows": rf"""WITH {_CRC} SELECT doc_id, crc % 5 = 0 AS held_out, NOT regexp_matches(coalesce(text, ''), '\p{{L}}') AS undetermined, true AS scored, true AS accurate FROM documents JOIN c USING (doc_id)""",
}
