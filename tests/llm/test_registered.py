"""Registered queries on small whole tables, and on empty ones: columns, one row for each row, contract values."""

import hashlib
import zlib

import public_tokenizers
import pytest
import tiktoken

from jobtide.llm import byte_bpe, url_lists
from jobtide.llm.registry import ORACLES, QUERIES

COLUMNS = {
    "op1_token_counts": ["doc_id", "n_words", "n_tokens"],
    "op2_lm_scores": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op3_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op4_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op5_hnsw": ["vec_id", "n_links", "component_id", "kept"],
    "op6_minhash": ["doc_id", "class_id", "class_rows", "kept"],
    "op7_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op8_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal"],
    "op9_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op10_url_lists": ["page_id", "fetched_on", "decision", "list_kind", "list_value", "listed_on", "kept"],
}
WORDS = "the and with order house thing other never again stone river cloud small green".split()
TEXTS = [
    None, "", "  \n", "123 !!", *(" ".join(WORDS[k % 14 :] + WORDS[: k % 11] + [f"w{k}"]) for k in range(30)), "the and " * 4000,
    'token = "0123456789abcdef0123" x', " ".join(WORDS) + " x y z", " ".join(WORDS) + " x y z",
]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", params=["some", "empty"])
def tables(request, spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp(request.param)
    rows = [(i, t, "en" if i % 2 else None, "s", 0) for i, t in enumerate(TEXTS)]
    vectors = [(i, None if i == 3 else [float(i % 5), 1.0, float(i % 3)]) for i in range(40)]
    pages = [(i, f"https://h{i % 4}.example.org/en/{i}" if i else None, "<p>") for i in range(20)]
    made = {
        "documents": spark.createDataFrame(rows, DOCUMENTS), "benchmark": spark.createDataFrame([(1, " ".join(WORDS)), (2, None)], "item_id long, text string"),
        "embeddings": spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), "pages": spark.createDataFrame(pages, "page_id long, url string, html string"),
    }
    for name, df in made.items():
        (df if request.param == "some" else df.limit(0)).write.parquet(f"{folder}/{name}.parquet")
    return str(folder), request.param == "some"


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, tables, name):
    folder, some = tables
    found = QUERIES[name](spark, folder)
    assert found.columns == COLUMNS[name]
    rows = found.collect()
    key = COLUMNS[name][0]
    count = {"doc_id": len(TEXTS), "vec_id": 40, "page_id": 20}[key] if some else 0
    assert sorted(r[key] for r in rows) == list(range(count))
    rows = {r[key]: r for r in rows}
    remainder = lambda i, n: zlib.crc32(str(i).encode()) % n
    if name == "op2_lm_scores":
        assert all(r["held_out"] == (remainder(i, 7) == 2) and r["n_tokens"] == len((TEXTS[i] or "").split()) + 1 for i, r in rows.items())
        assert {r["train_tokens"] for r in rows.values()} <= {sum(len((t or "").split()) + 1 for i, t in enumerate(TEXTS) if remainder(i, 7) != 2)}
    elif name == "op4_byte_bpe":
        ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
        public = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for i, r in rows.items():
            ids = public.encode_ordinary(TEXTS[i] or "")
            assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256((TEXTS[i] or "").encode()).hexdigest()
    elif name == "op7_shards":
        assert all(r["size"] == len((TEXTS[i] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((TEXTS[i] or "").encode()) for i, r in rows.items())
    elif name == "op9_language":
        assert all(r["held_out"] == (remainder(i, 5) == 0) and (r["lang_pred"] == "und") == (not any(map(str.isalpha, TEXTS[i] or ""))) for i, r in rows.items())


SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in ("documents", "benchmark", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    found = QUERIES[name](spark, SF_DIR)
    columns = sorted(found.columns)
    want = con.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_oracles_name_queries():
    assert set(ORACLES) <= set(QUERIES) and set(COLUMNS) <= set(QUERIES)


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    schema = DOCUMENTS + ", h string, own long, `k0` string, N_TOKENS int"
    rows = [(i, t, "en", "s", 0, "a", 1, "b", 2) for i, t in enumerate(TEXTS)] + [(None, "order house thing river " * 9, None, None, None, None, None, None, None)] * 2
    spark.createDataFrame([*rows, *rows[5:9]], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "never again stone " * 9)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert [(c, t) for c, t in docs.dtypes] == spark.read.parquet(f"{tmp_path}/documents.parquet").dtypes
            empty = stage(spark, docs.limit(0), str(tmp_path))
            assert empty.columns == docs.columns and empty.count() == 0
    ids = [r["doc_id"] for r in docs.collect()]
    assert len(ids) == len(set(ids)) and None in ids and docs.where("NOT decodes").count() == 0


@pytest.mark.parametrize("most", [url_lists.BROADCAST_ENTRIES, 0])
def test_generated_log_of_entries(spark, most):
    """A log of 100,000 entries, a hot host, and a URL deeper than any entry, against dictionaries."""
    entries = spark.range(100_000).selectExpr(
        "CASE id % 3 WHEN 0 THEN 'domain' WHEN 1 THEN 'host' ELSE 'prefix' END AS kind",
        "CASE id % 3 WHEN 0 THEN concat('d', id % 20000, '.org') WHEN 1 THEN concat('h', id % 20000, '.net') ELSE concat('hot.com/p', id % 20000) END AS value",
        "CASE id % 7 WHEN 0 THEN 'remove' WHEN 1 THEN 'allow' ELSE 'block' END AS action", "timestamp_seconds(1700000000 + id * 60) AS listed_at",
    )
    captures = spark.range(6000).selectExpr(
        "id AS page_id", "timestamp_seconds(1700000000 + id * 1000) AS fetched_at",
        "CASE id % 3 WHEN 0 THEN concat('http://a.b.d', id % 500, '.org/x') WHEN 1 THEN concat('http://h', id % 500, '.net/', repeat('y/', 2000)) ELSE concat('http://hot.com/p', id % 500, '/z?q') END AS url",
    )
    told = {}
    for r in entries.collect():
        told.setdefault((r["kind"], r["value"]), []).append((r["listed_at"], r["action"]))
    found = url_lists.filter_urls(captures, entries, broadcast_entries=most).collect()
    assert len(found) == 6000
    for r in found:
        i = r["page_id"]
        key = [("domain", f"d{i % 500}.org"), ("host", f"h{i % 500}.net"), ("prefix", f"hot.com/p{i % 500}")][i % 3]
        past = [a for t, a in sorted(told.get(key, ())) if t <= r["fetched_at"]]
        assert r["decision"] == (past[-1] if past and past[-1] != "remove" else "none")
