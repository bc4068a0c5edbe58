"""Registered queries leave out no rows: held against the catalogue's SQL without its cuts, and hand-made pages."""

import duckdb
from pyspark.sql import functions as F

from jobtide.operators import history
from jobtide.plans import catalogue

SF_DIR = "/root/testdata/sf0.01"


def sql(query, *names):
    con = duckdb.connect()
    for name in names:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return sorted(con.execute(query).fetchall(), key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_feed_is_whole(spark):
    whole = catalogue.ORACLES["newest_feed"].replace("QUALIFY place <= 100", "")
    want = sql(whole, "events")
    assert len(want) == 120 and rows(catalogue.QUERIES["newest_feed"](spark, SF_DIR)) == want


def test_ranked_within_keys(spark):
    # small ranges stay apart
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked_within_keys(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def ranked_within_keys(spark):
    # a key with two thirds of all rows, keys of one row, a null key, rows that repeat
    board = F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, F.col("id").cast("string"))
    df = spark.range(3000).select(board.alias("board"), (F.col("id") % 50).alias("k"), "id")
    df = df.unionByName(df.where("id = 1"))
    got = history.ranked(df, [F.col("k").desc(), F.col("id").asc()], within=["board"])
    want = {}
    for r in df.collect():
        want.setdefault(r["board"], []).append((-r["k"], r["id"]))
    found = {}
    for r in got.collect():
        found.setdefault(r["board"], []).append((r["place"], (-r["k"], r["id"])))
    assert {b: [x for _, x in sorted(v)] for b, v in found.items()} == {b: sorted(v) for b, v in want.items()}
    assert all(sorted(p for p, _ in v) == list(range(1, len(v) + 1)) for v in found.values())
    assert got.columns == ["board", "k", "id", "place"]
    assert history.ranked(df.limit(0), ["k"], within=["board"]).count() == 0
    # the hot key is several tasks' work
    dealt = df.repartitionByRange("board", "k", "id").where("board = 'hot'").select(F.spark_partition_id().alias("p"))
    assert dealt.distinct().count() > 1


def test_ranked(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("k"), "id").repartition(5)
    got = history.ranked(df, [F.col("k").desc(), F.col("id").asc()]).orderBy("place").collect()
    assert [(r["k"], r["id"]) for r in got] == sorted(((i % 7, i) for i in range(5000)), key=lambda x: (-x[0], x[1]))
    assert [r["place"] for r in got] == list(range(1, 5001))
    assert history.ranked(df.limit(0), ["k", "id"]).count() == 0


def test_merge_takes_every_order(spark):
    for name in ("merge_snapshot", "missing_from_snapshot"):
        whole = catalogue.ORACLES[name].replace("WHERE o_orderkey % 7 = 0", "")
        assert rows(catalogue.QUERIES[name](spark, SF_DIR)) == sql(whole, "customer", "orders")


def pages_of(spark, pages):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages.items())], "page_id long, url string, html string")


def registered(spark, tmp_path, name, pages):
    pages_of(spark, pages).write.parquet(f"{tmp_path}/pages.parquet")
    return catalogue.QUERIES[name](spark, str(tmp_path))


def test_pages_without_html_need_scripts(spark, tmp_path):
    pages = {"null": None, "empty": "", "text": "no tags", "plain": "<body>" + "<p>word</p>" * 30 + "</body>", "root": "<div id='root'></div><script></script>"}
    got = registered(spark, tmp_path, "js_shell_verdicts", pages).orderBy("page_id").collect()
    assert [r["needs_script"] for r in got] == [True, True, False, False, True]
    features = catalogue.QUERIES["js_shell_features"](spark, str(tmp_path)).orderBy("page_id").collect()
    assert [(r["scripts"], r["mount"]) for r in features] == [(0, False)] * 4 + [(1, True)]


def test_titles_of_each_source(spark, tmp_path):
    ld = "<script type='application/ld+json'>{}</script>".format
    rest = "<h1>Find your role</h1>" + ld('[3, {"title": " ", "name": "N"}, {"name": "Lead - Meta"}]') + "<meta property='og:title' content='Site'><title>Doc</title>"
    pages = {
        "army": "<div class='x_armyz'>Army</div><h1>H</h1>", "role": "<div role='heading'>Role</div><h1>H</h1>", "h1": "<h2>B</h2><h1>A - Meta</h1>",
        "h2": "<h1>Find your role</h1><h2>B</h2>" + ld('{"title": "L"}'), "jsonld": rest, "bad": ld("{bad") + rest, "og": rest.replace("ld+json", "json"),
        "title": "<title>Doc - Meta</title>", "boiler": "<title>Job openings at Meta | Meta careers</title>", "null": None, "empty": "",
    }
    got = {r["url"]: r["title"] for r in registered(spark, tmp_path, "page_titles", pages).collect()}
    assert got == {"army": "Army", "role": "Role", "h1": "A", "h2": "B", "jsonld": "Lead", "bad": "Site", "og": "Site", "title": "Doc", "boiler": None, "null": None, "empty": None}


def test_page_queries_are_their_sql(spark):
    for name in ("js_shell_features", "page_titles"):
        assert rows(catalogue.QUERIES[name](spark, SF_DIR)) == sql(catalogue.ORACLES[name], "pages")
