"""Nodes, extractors and paging on small pages; sources and streams."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jobtide.operators import adapters, dom, extract, paging
from jobtide.sources import boards, fetch
from jobtide.streaming import live

T0 = datetime(2024, 1, 1)
POSTING = '<script type="application/ld+json">{"@graph": [{"@type": ["JobPosting"], "name": "Lead", "url": "/job/lead-1234"}, {"@type": "JobPosting", "title": 5, "url": "/job/odd-title"}]}</script>'
PAGES = {
    "http://h/jsonld": f"<body>{POSTING}<script type='application/ld+json'>{{bad</script><ul><li><a href='/job/other-one'>Other</a></li></ul></body>",
    "http://h/list": "<ul aria-label='Open positions'><li><a href='/job/data-lead?utm_source=x'><h3>Data  Lead</h3><h4>A longer heading</h4></a></li><li><a href='/job/data-lead'>Twice</a></li><li><a href='/x'>No</a></li></ul>",
    "http://h/cards": "<div>" + "".join(f"<div class='card job'><a href='/job/card-no{k}' title='Card {k}'><p>x<br>y</a></div>" for k in range(3)) + "</div>",
    "http://h/anchors": "<p><a href='/job/engineer-1'>Engineer &amp; more</a><a href='/z'><h2>Some role</h2></a><a href='/job/apply-now'>Apply</a></p>",
    "http://h/none": "<p>nothing</p>",
    "http://h/empty": "",
}


@pytest.fixture(scope="module")
def nodes(spark):
    return dom.nodes(spark.createDataFrame(list(PAGES.items()), "url string, html string")).persist()


def test_nodes(nodes):
    rows = {r["node_id"]: r for r in nodes.where("url = 'http://h/cards'").collect()}
    assert rows[0]["last_desc"] == max(rows) and rows[0]["parent_id"] == -1
    assert [r["tag"] for _, r in sorted(rows.items())][:5] == ["div", "div", "a", "p", "br"]
    assert rows[1]["text"] == "x y" and rows[1]["attrs"]["class"] == "card job"


def test_first_extractor_wins(nodes):
    found = {}
    for r in extract.postings(nodes).orderBy("url", "pos").collect():
        found.setdefault(r["url"].rpartition("/")[2], []).append((r["priority"], r["title"], r["link"].removeprefix("http://h")))
    assert found == {
        "jsonld": [(1, "Lead", "/job/lead-1234")],
        "list": [(2, "A longer heading", "/job/data-lead")],
        "cards": [(3, f"Card {k}", f"/job/card-no{k}") for k in range(3)],
        "anchors": [(4, "Engineer & more", "/job/engineer-1"), (4, "Some role", "/z")],
    }


def test_lever(spark):
    rows = [{"id": "1", "text": "A", "hostedUrl": "http://h/1"}, {"id": "2", "text": " B ", "applyUrl": ""}, {"id": "3", "text": ""}]
    df = spark.createDataFrame([("s", "jobs.lever.co", json.dumps(rows)), ("t", "h", json.dumps({"data": rows[:1]})), ("u", "h", "{bad")], "site string, host string, json string")
    got = sorted((r["site"], r["title"], r["link"]) for r in extract.from_lever(df).collect())
    assert got == [("s", "A", "http://h/1"), ("s", "B", "https://jobs.lever.co/s/2"), ("t", "A", "http://h/1")]


def test_shells(spark):
    pages = {"root": "<body><div id='root'></div><script></script></body>", "text": "<body><p>Please enable cookies now</p></body>", "plain": "<body>" + "<p>word</p>" * 30 + "</body>", "small": "<body>" + "<script>x</script>" * 3 + "</body>"}
    found = dom.shell_features(dom.nodes(spark.createDataFrame(list(pages.items()), "url string, html string")))
    assert {r["url"]: r["needs_script"] for r in found.collect()} == {"root": True, "text": True, "plain": False, "small": True}


def test_next_pages(spark):
    pages = {
        "http://h/rel": "<a href='/a'>x</a><a rel='next' href='/b?page=2'>n</a>",
        "http://h/label": "<a aria-label='Weiter' aria-disabled='true' href='/no'>x</a><a aria-label='Weiter' href='/yes'>x</a>",
        "http://h/nav": "<nav aria-label='Pagination'><a aria-label='3' href='?page=3'>3</a><a aria-label='2' href='?page=2'>2</a></nav>",
        "http://h/l?page=4": "<span class='rc-pagination-total-pages'>5</span>",
        "http://h/l?page=5": "<span class='rc-pagination-total-pages'>5</span>",
        "http://h/l?start=0": "<p>1–20 of 45</p>", "http://h/l?start=40": "<p>41–45 of 45</p>",
        "http://h/l": "<div aria-live='polite'>Page 1</div><a href='/l?seite=9'>9</a>", "http://h/end": "<p>x</p>",
    }
    nodes = dom.nodes(spark.createDataFrame(list(pages.items()), "url string, html string"))
    got = {r["url"].removeprefix("http://h"): r["next_url"] and r["next_url"].removeprefix("http://h") for r in paging.next_pages(nodes).collect()}
    assert got == {"/rel": "/b?page=2", "/label": "/yes", "/nav": "/nav?page=2", "/l?page=4": "/l?page=5", "/l?page=5": None, "/l?start=0": "/l?start=20", "/l?start=40": None, "/l": "/l?seite=2", "/end": None}


def test_rows_that_share_a_url_stay_apart(spark):
    pages = spark.createDataFrame([(1, "http://h/", "<a href='/job/lead-one'>Lead</a>"), (2, "http://h/", "<a href='/job/lead-two'>Other</a><p><a rel=next href='/n'>n</a>"), (3, "http://h/", "")], "page_id long, url string, html string")
    nodes = dom.nodes(pages)
    assert sorted((r["page_id"], r["link"]) for r in extract.postings(nodes).collect()) == [(1, "http://h/job/lead-one"), (2, "http://h/job/lead-two")]
    assert sorted((r["page_id"], r["next_url"]) for r in paging.next_pages(nodes).collect()) == [(1, None), (2, "http://h/n")]
    assert sorted((r["page_id"], r["needs_script"]) for r in dom.shells(pages).collect()) == [(1, False), (2, False), (3, True)]


def test_key_of_an_anchor_is_set_before_the_fragment(spark):
    pages = spark.createDataFrame([("http://h/l?seite=1#x", "<div aria-live='polite'>Page 1</div><a href='/l?seite=9'>9</a>")], "url string, html string")
    assert paging.next_pages(dom.nodes(pages)).first()["next_url"] == "http://h/l?seite=2#x"


def test_without_badges(spark):
    html = "<div>a<p>b<span class='x tag-container'>New<b>!</b></span></p>c</div><i>d</i>"
    found = dom.without(dom.nodes(spark.createDataFrame([("u", html)], "url string, html string")), "tag-container")
    assert sorted((r["tag"], sorted(r["text"].split())) for r in found.collect()) == [("div", ["a", "b", "c"]), ("i", ["d"]), ("p", ["b"])]


def test_fetch_json(spark):
    def client():
        def get(url, plain, headers, body):
            if "bad" in url:
                return "{no"
            if "gone" in url:
                raise fetch.Refused(404)
            return json.dumps({"url": url, "accept": headers["Accept"], "x": headers.get("X"), "body": body})

        return get

    rows = [("http://a/?k=1#f", {"q": "a b"}, {"X": "y"}, None), ("http://b", None, None, '{"z": 1}'), ("http://bad", None, None, None), ("http://gone", None, None, None)]
    asked = spark.createDataFrame(rows, "url string, params map<string,string>, headers map<string,string>, body string")
    got = {r["url"]: r for r in fetch.fetched_json(asked, client).selectExpr("url", "to_json(json) AS json", "status", "fetch_error").collect()}
    assert json.loads(got["http://a/?k=1#f"]["json"]) == {"url": "http://a/?k=1&q=a+b#f", "accept": "application/json", "x": "y", "body": None} or "body" not in json.loads(got["http://a/?k=1#f"]["json"])
    assert json.loads(got["http://b"]["json"])["body"] == '{"z": 1}' and got["http://bad"]["fetch_error"] == "ValueError" and got["http://gone"]["status"] == 404


def test_cached_table(spark):
    now, reads = [0.0], []
    held = boards.Cached(lambda: reads.append(1) or spark.range(len(reads)), 30, lambda: now[0])
    assert held.get().count() == 1
    now[0] = 29.0
    assert held.get().count() == 1
    now[0] = 30.0
    assert held.get().count() == 2


def test_crawl(spark):
    links = spark.createDataFrame([("http://h/1", "http://h/2"), ("http://h/2", "http://h/1?page=1"), ("http://h/x", "http://other/")], "url string, next_url string")
    starts = spark.createDataFrame([("http://h/1",), ("http://h/x",)], "url string")
    assert sorted(tuple(r) for r in paging.crawl(starts, links).collect()) == [("http://h/1", "http://h/1", 1), ("http://h/1", "http://h/2", 2), ("http://h/x", "http://h/x", 1)]


def walked(start, following, bound):
    """The crawl by hand: pages are told apart by their address, as none here has two."""
    seen, at = [], start
    while at is not None and at not in seen and len(seen) < bound and at.split("/")[2] == start.split("/")[2]:
        seen.append(at)
        at = min(following.get(at, ()), default=None)
    return [(start, url, k) for k, url in enumerate(seen, 1)]


def test_long_crawls(spark):
    # a chain beyond the bound, cycles that are entered at their middle, several next pages, another host on the way
    following = {f"http://h/long/{k}": [f"http://h/long/{k + 1}"] for k in range(70)}
    following |= {f"http://h/ring/{k}": [f"http://h/ring/{k + 1 if k < 29 else 10}"] for k in range(30)}
    following |= {"http://h/fork": ["http://h/ring/3", "http://h/long/60"], "http://h/away": ["http://g/1"], "http://g/1": ["http://h/long/1"], "http://h/self": ["http://h/self"]}
    links = spark.createDataFrame([(u, n) for u, many in following.items() for n in (*many, None)], "url string, next_url string")
    starts = ["http://h/long/0", "http://h/long/40", "http://h/ring/0", "http://h/ring/20", "http://h/fork", "http://h/away", "http://h/self", "http://h/none"]
    asked = spark.createDataFrame([(s,) for s in starts], "url string")
    for bound in (1, 50):
        found = sorted(tuple(r) for r in paging.crawl(asked, links, bound).collect())
        assert found == sorted(x for s in starts for x in walked(s, following, bound))
    assert paging.crawl(asked.limit(0), links).count() == 0
    assert "UnionLoop" in paging.crawl(asked, links)._jdf.queryExecution().executedPlan().toString()


def test_boards(spark, tmp_path):
    job = {"title": "b", "link": "l1", "history": [{"status": "active", "at": "2024-01-01T00:00:00.000001Z"}]}
    board = {"title": "Acme", "icon_url": "i", "website_url": "w", "attempts": [{"at": "2024-01-01T00:00:00Z", "ok": True, "count": 3}], "content": [job]}
    (tmp_path / "acme.json").write_text(json.dumps(board, indent=2))
    (tmp_path / "bad.json").write_text("{no")
    (tmp_path / "untitled.json").write_text(json.dumps({**board, "title": ""}))
    valid, refused = boards.read(spark, str(tmp_path))
    assert [r["slug"] for r in valid.collect()] == ["acme"] and {r["file"] for r in refused.collect()} == {"bad.json", "untitled.json"}
    event = boards.events(valid).first()
    assert (event["board"], event["link"], event["at"].microsecond) == ("acme", "l1", 1) and boards.attempts(valid).first()["n"] == 3
    content = spark.createDataFrame([("acme", "b", "l1", False), ("acme", "Z", "l2", True)], "board string, title string, link string, active boolean")
    assert [j["title"] for j in boards.assembled(content, boards.events(valid)).first()["content"]] == ["Z", "b"]
    boards.write(valid.drop("file", "slug"), str(tmp_path / "out"), dry_run=True)
    assert not (tmp_path / "out").exists()


def test_fetch(spark):
    def client():
        def get(url, plain):
            if "refused" in url and not plain:
                raise fetch.Refused(403)
            if "gone" in url:
                raise fetch.Refused(404)
            if "slow" in url:
                raise TimeoutError
            return f"<p>{url}</p>"

        return get

    df = spark.createDataFrame([("ok",), ("refused",), ("gone",), ("slow",)], "url string")
    got = {r["url"]: (r["html"], r["status"], r["fetch_error"]) for r in fetch.fetched(df, client).collect()}
    assert got == {"ok": ("<p>ok</p>", 200, None), "refused": ("<p>refused</p>", 200, None), "gone": (None, 404, "Refused"), "slow": (None, None, "TimeoutError")}


def streamed(spark, tmp_path, df, build, name):
    df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/{name}")
    rows = []
    query = live.poll(build(stream), lambda batch, _: rows.extend(batch.collect()), f"{tmp_path}/{name}-state", once=True)
    query.awaitTermination(120)
    return rows


def test_streaming_health_is_batch_health(spark, tmp_path):
    from jobtide.operators import health

    rows = [(f"b{b}", T0 + timedelta(hours=3 * i), i, (i * 7 + b) % 5 > 0, (i * (b + 3)) % 4) for b in range(2) for i in range(70)]
    df = spark.createDataFrame(rows, "board string, at timestamp, seq int, ok boolean, n long")
    got = streamed(spark, tmp_path, df, live.health, "health")
    want = health.states(df).select("board", "at", "status", "reason", "streak", "baseline").collect()
    assert sorted((r["board"], r["at"], r["status"], r["reason"], r["streak"], r["baseline"]) for r in got) == sorted(map(tuple, want))


def test_streaming_health_tells_attempts_of_one_time_apart(spark, tmp_path, monkeypatch):
    from jobtide.operators import health

    monkeypatch.setattr(live, "HANDED_ON", 7)
    rows = [(f"b{b}", T0 + timedelta(hours=i // 4), (i * 37) % 60, (i * 7 + b) % 5 > 0, (i * (b + 3)) % 4) for b in range(2) for i in range(60)]
    df = spark.createDataFrame(rows, "board string, at timestamp, seq int, ok boolean, n long")
    got = streamed(spark, tmp_path, df, live.health, "ties")
    want = health.states(df).select("board", "at", "seq", "status", "reason", "streak", "baseline").collect()
    assert sorted((r["board"], r["at"], r["seq"], r["status"], r["reason"], r["streak"], r["baseline"]) for r in got) == sorted(map(tuple, want))


def test_streaming_flaps(spark, tmp_path):
    hours = [("active", 0), ("inactive", 10), ("active", 12), ("inactive", 30), ("active", 50), ("active", 51)]
    df = spark.createDataFrame([("b", "l", s, T0 + timedelta(hours=h)) for s, h in hours], "board string, link string, status string, at timestamp")
    got = streamed(spark, tmp_path, df, live.changes, "flaps")
    assert [(r["status"], (r["at"] - T0).total_seconds() / 3600) for r in got] == [("active", 0), ("inactive", 30), ("active", 50)]


def test_streaming_takes_late_events_in_order(spark, tmp_path):
    """A late active event before the pending inactive one does not cancel it; a late inactive one inside a flap is none."""
    hours = [("active", 0), ("inactive", 10), ("active", 8), ("inactive", 40), ("active", 60), ("active", 70), ("inactive", 67), ("active", 200)]
    rows = [("b", "l", s, T0 + timedelta(hours=h)) for s, h in hours]
    df = spark.createDataFrame(rows, "board string, link string, status string, at timestamp")
    for k in range(len(rows)):  # a micro-batch each
        df.where(F.col("at") == F.lit(rows[k][3])).coalesce(1).write.mode("append").parquet(f"{tmp_path}/late")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/late")
    got = []
    live.poll(live.changes(stream, "30 hours"), lambda batch, _: got.extend(batch.collect()), f"{tmp_path}/late-state", once=True).awaitTermination(180)
    assert [(r["status"], (r["at"] - T0).total_seconds() / 3600) for r in got] == [("active", 0), ("inactive", 10), ("active", 60)]


def test_schedule(spark, tmp_path):
    table = spark.createDataFrame([("a", None), ("b", T0), ("c", T0 + timedelta(days=9))], "file string, next_scrape_at timestamp")
    ticks = spark.createDataFrame([(T0 + timedelta(hours=1),)], "at timestamp")
    ticks.write.parquet(f"{tmp_path}/ticks")
    seen = []
    query = live.schedule(spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/ticks"), lambda: table, lambda due, now: seen.append(([r["file"] for r in due.collect()], now)), f"{tmp_path}/ticks-state", once=True)
    query.awaitTermination(120)
    assert [x for x, _ in seen] == [["a", "b"]]
    batch = spark.createDataFrame([(T0,), (T0 + timedelta(hours=2),)], "at timestamp")
    in_time, late = live.late_events(batch, F.lit(T0 + timedelta(hours=1)))
    assert (in_time.count(), late.count()) == (1, 1)


def test_streaming_windows(spark, tmp_path):
    df = spark.createDataFrame([(T0 + timedelta(minutes=m), "view", 1.0, 1) for m in (0, 20, 61, 500)], "ts timestamp, event_type string, value double, user_id long")
    got = streamed(spark, tmp_path, df, lambda s: live.tumbling(s), "windows")
    assert sorted((r["w"]["start"].hour, r["n"]) for r in got)[:2] == [(0, 2), (1, 1)]
    assert {r["n"] for r in live.sessions(df, "1 hour").collect()} == {3, 1}


def test_lever_answers_are_not_sorted(spark):
    """Answers and their rows stream past tables of calls; a task sorts none of them, however many there are."""
    boards = spark.createDataFrame([(f"https://jobs.lever.co/s{i}",) for i in range(5)] + [("https://jobs.eu.lever.co/s5/one",), ("https://jobs.lever.co/none",)], "url string")
    calls = adapters.lever_requests(boards)
    row = '{{"id": "{0}", "text": " T{0} ", "hostedUrl": ""}}'.format
    page = lambda first, n: "[" + ", ".join(row(first + k) for k in range(n)) + "]"
    at = lambda r, region: r["api_url"] if region == "own" else r["other_url"]
    # s0: two pages; s1: by the other region; s2: both regions answer; s3: its second page is lost; s4: a full page, then {"data": []}
    answers = []
    for r in calls.collect():
        site, k = r["site"], r["page_no"]
        text = page(k * 50, 50 if k == 0 else 3 if k == 1 else 50)
        if site == "s5":
            answers.append((at(r, "own"), 200, row(7).replace('""', '"https://h/7"')))
        elif site == "s4" and k:
            answers.append((at(r, "own"), 200, '{"data": []}'))
        elif site != "none" and not (site == "s3" and k == 1):
            if site != "s1":
                answers.append((at(r, "own"), 200, text))
            else:
                answers.append((at(r, "own"), 500, text))
            if site in ("s1", "s2"):
                answers.append((at(r, "other"), 200, text))
    found = adapters.from_lever_pages(calls, spark.createDataFrame(answers, "url string, status int, html string"))
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [next((i for i, c in enumerate(x) if c.isalpha()), 0) for x in lines]
    above, least = [], 10**6
    for x, n in reversed(list(zip(lines, depth, strict=True))[: next(i for i, x in enumerate(lines) if "FileScan" in x and "rows#" in x) + 1]):
        if n < least:
            above.append(x)
            least = n
    assert any("ShuffledHashJoin" in x for x in above) and not any("Sort" in x for x in above)
    counts = {}
    for r in found.collect():
        counts.setdefault(r["url"].rsplit("lever.co/")[1], []).append((r["page_no"], r["pos"], r["title"], r["link"]))
    assert {k: len(v) for k, v in counts.items()} == {"s0": 53, "s1": 53, "s2": 53, "s3": 50, "s4": 50, "s5/one": 1}
    assert sorted(counts["s1"])[-1] == (1, 2, "T52", "https://jobs.lever.co/s1/52") and counts["s5/one"] == [(0, 0, "T7", "https://h/7")]
