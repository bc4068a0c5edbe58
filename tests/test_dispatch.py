"""Adapters by rules and by selectors, and nodes of pages in SQL."""

import pytest
from pyspark.sql import functions as F

from jobtide.operators import dispatch, dom

SHAPE = "page_id long, url string, html string, adapter string"


def pages_of(spark, *rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SHAPE)


def found(df):
    return sorted((r["page_id"], r["adapter"], r["pos"], r["title"], r["link"]) for r in df.collect())


def test_a_board_by_selectors(spark):
    html = """<ul><li class="job"><a>no link</a><a href="">x</a><a href="/1?utm_source=a">One</a><i></i><i> First </i></li>
<li class="job"><a href="/2">Two</a></li><li class="job"><a href="/1">again</a><i>Again</i></li><li class="job"><i>no link</i></li><li><a href="/3">no item</a></li></ul>"""
    board = dispatch.Boards().add("own", dispatch.by_selectors("li.job", "a", "i"), host=r"^own\.example$")
    pages = pages_of(spark, (1, "https://own.example/jobs", html), (1, "https://own.example/jobs", html), (2, "https://own.example/none", "<p>"), (3, None, html), (4, "https://own.example/null", None), (None, "https://own.example/x", html))
    one, two = ("First", "https://own.example/1"), ("Two", "https://own.example/2")
    got = [(p, a, *rest) for p, a, _, *rest in found(board.postings(pages.where("page_id IS NOT NULL")))]
    assert got == [(1, "own", *one), (1, "own", *two)]
    assert {(r["title"], r["link"]) for r in board.postings(pages.where("page_id IS NULL")).collect()} == {one, two}
    empty = board.postings(pages.limit(0))
    assert empty.columns == ["page_id", "url", "adapter", "pos", "title", "link"] and empty.count() == 0
    # the items themselves are the links, their text the titles
    plain = dispatch.Boards().add("own", dispatch.by_selectors("li.job > a[href]"), path="^/jobs$")
    assert [x[3:] for x in found(plain.postings(pages.where("page_id = 1")))] == [("One", one[1]), two]


def test_rules_in_their_order(spark):
    read = dispatch.by_selectors("a")
    boards = dispatch.Boards().add("first", read, host=r"\.example$").add("second", read, host=r"^b\.example$", path="^/x").add("ashby", read, host="^c$")
    urls = {
        "https://a.example/x": "first", "https://B.example/x": "second", "https://b.example/y": "first", "https://jobs.ashbyhq.com/o": "ashby", "https://c/z": "ashby",
        "https://join.com/a": "join", "https://jobs.lever.co/a": "generic", "https://www.metacareers.com/": "generic", "https://else/": "generic", "no url": "generic",
    }
    rows = spark.createDataFrame([(u,) for u in [*urls, None]], "url string").select("url", boards.adapter(F.col("url")).alias("a")).collect()
    assert {r["url"]: r["a"] for r in rows} == {**urls, None: "generic"}


def test_rules_that_cannot_be(spark):
    for args in (("", "^x$"), ("generic", "^x$"), ("own", None)):
        with pytest.raises(ValueError, match="adapter|rule"):
            dispatch.Boards().add(args[0], dispatch.by_selectors("a"), host=args[1])
    with pytest.raises(ValueError, match="selector"):
        dispatch.by_selectors("a", "b[")


def test_nodes_in_sql(spark):
    dispatch.register(spark)
    html = "<div id=a><p>x <b>y</b></p><script>z</script><![foo[bar]]></div>"
    pages = pages_of(spark, (1, "https://h/", html), (2, "https://g/", ""), (3, "https://g/", None))
    names = ["node_id", "parent_id", "last_desc", "tag", "attrs", "own_text", "text"]
    for tags, wanted in (("NULL", None), ("'P, b'", ("p", "b"))):
        got = spark.sql(f"SELECT p.page_id, n.* FROM {{pages}} p, LATERAL page_nodes(p.html, {tags}) n", pages=pages)
        want = dom.nodes(pages, tags=wanted).select("page_id", *names)
        assert sorted(map(str, got.select("page_id", *names).collect())) == sorted(map(str, want.collect())) and want.count() > 1
