"""Selectors and structural joins against a matcher that walks trees, and pages that must not end a job."""

import random
import time

import pytest
from pyspark.sql import functions as F

from jobtide.operators import adapters, dom, extract, selectors

# what a page of boards is asked for: rows and cells, lists by label, cards, marked links
SELECTORS = (
    "tr.job-post td.cell a[href]", "a[data-testid='Link']", "ul[aria-label*=Open] > li", "div.card > h3", "li:not(.hidden) a",
    'a[href^="/jobs/"]:not([rel~=nofollow])', "#root .card, main > p", "[role=listitem] span[class|=title]", "*:not(div):not(li) > a", "section div div a[href$='.html']",
)
TAGS = ("div", "li", "a", "ul", "section", "tr", "td", "span", "h3", "p", "main")
ATTRIBUTES = (
    ("class", ("card", "card x", "job-post", "cell", "hidden", "title-a", "title")), ("href", ("/jobs/1", "/jobs/2.html", "x.html", "")), ("id", ("root", "r")),
    ("data-testid", ("Link", "link")), ("aria-label", ("Open positions", "closed")), ("rel", ("nofollow x", "next")), ("role", ("listitem",)),
)


def made(draw, n):
    """HTML of about n elements and the tree: (parent, tag, attributes) by number."""
    nodes, parts, stack = [], [], []
    while len(nodes) < n or stack:
        if stack and (len(nodes) >= n or draw.random() < 0.45):
            parts.append(f"</{nodes[stack.pop()][1]}>")
        else:
            attrs = {k: draw.choice(v) for k, v in ATTRIBUTES if draw.random() < 0.5}
            nodes.append((stack[-1] if stack else -1, draw.choice(TAGS), attrs))
            stack.append(len(nodes) - 1)
            parts.append(f"<{nodes[-1][1]}{''.join(f' {k}={chr(34)}{v}{chr(34)}' for k, v in attrs.items())}>t")
    return "".join(parts), nodes


def simple(node, text):
    _, tag, attrs = node
    words = lambda k: attrs.get(k, "").split()
    checks = {
        "tr.job-post": tag == "tr" and "job-post" in words("class"), "td.cell": tag == "td" and "cell" in words("class"), "a[href]": tag == "a" and "href" in attrs,
        "a[data-testid='Link']": tag == "a" and attrs.get("data-testid") == "Link", "ul[aria-label*=Open]": tag == "ul" and "Open" in attrs.get("aria-label", ""),
        "li": tag == "li", "div.card": tag == "div" and "card" in words("class"), "h3": tag == "h3", "li:not(.hidden)": tag == "li" and "hidden" not in words("class"), "a": tag == "a",
        'a[href^="/jobs/"]:not([rel~=nofollow])': tag == "a" and attrs.get("href", "").startswith("/jobs/") and "nofollow" not in words("rel"),
        "#root": attrs.get("id") == "root", ".card": "card" in words("class"), "main": tag == "main", "p": tag == "p", "[role=listitem]": attrs.get("role") == "listitem",
        "span[class|=title]": tag == "span" and (attrs.get("class", "") == "title" or attrs.get("class", "").startswith("title-")), "*:not(div):not(li)": tag not in ("div", "li"),
        "section": tag == "section", "div": tag == "div", "a[href$='.html']": tag == "a" and attrs.get("href", "").endswith(".html"),
    }
    return checks[text]


def matches(nodes, k, chain):
    """Whether node k matches a chain, from its end."""
    how, text = chain[-1]
    if not simple(nodes[k], text):
        return False
    if how == "":
        return True
    up = nodes[k][0]
    while up >= 0:
        if matches(nodes, up, chain[:-1]):
            return True
        if how == ">":
            return False
        up = nodes[up][0]
    return False


@pytest.fixture(scope="module")
def pages(spark):
    draw = random.Random(11)
    trees = [made(draw, draw.choice([1, 60, 900])) for _ in range(40)]
    html = spark.createDataFrame([(k, f"u{k % 7}", t[0]) for k, t in enumerate(trees)], "page_id long, url string, html string")
    return dom.nodes(html).cache(), [t[1] for t in trees]


@pytest.mark.parametrize("selector", SELECTORS)
def test_selector_is_the_walk(pages, selector):
    nodes, trees = pages
    chains = selectors.parsed(selector)
    want = {(p, k) for p, tree in enumerate(trees) for k in range(len(tree)) if any(matches(tree, k, c) for c in chains)}
    rows = selectors.select(nodes, selector).collect()
    assert {(r["page_id"], r["node_id"]) for r in rows} == want and len(rows) == len(want) and want


@pytest.mark.parametrize("bad", ["", "a >", "> a", "a::before", "a:hover", "a[", "a,,b", "a + b", ".x div.", "div:not(a b)"])
def test_what_is_no_selector(spark, bad):
    with pytest.raises(ValueError):
        selectors.parsed(bad) and selectors.select(dom.nodes(spark.createDataFrame([("u", "")], "url string, html string")), bad)


def test_pairs_and_what_lies_within(pages):
    nodes, trees = pages
    outer = nodes.where("tag IN ('li', 'section')").select(*selectors.PAGE, "node_id", "last_desc")
    inner = nodes.where("tag IN ('a', 'li')").select(*selectors.PAGE, F.col("node_id").alias("i"))

    def above(tree, k):
        while (k := tree[k][0]) >= 0:
            yield k

    want = {(p, a, k) for p, t in enumerate(trees) for k in range(len(t)) if t[k][1] in ("a", "li") for a in above(t, k) if t[a][1] in ("li", "section")}
    rows = [(r["page_id"], r["node_id"], r["i"]) for r in selectors.contained(outer, inner, "i").collect()]
    assert set(rows) == want and len(rows) == len(want)
    found = selectors.within(nodes.where("tag = 'a'"), outer)
    assert found.columns == nodes.columns
    assert {(r["page_id"], r["node_id"]) for r in found.collect()} == {(p, k) for p, _, k in want if trees[p][k][1] == "a"}


def test_deep_pages_are_linear(spark):
    deep = "<div class='card'><a href='/jobs/1'>x</a>" * 50_000
    nodes = dom.nodes(spark.createDataFrame([(1, "u", deep)], "page_id long, url string, html string"), text_of=("a",)).cache()
    assert nodes.count() == 100_000
    began = time.time()
    assert selectors.select(nodes, "div.card div a[href]").count() == 49_999
    assert selectors.select(nodes, "div.card > a").count() == 50_000
    assert time.time() - began < 60
    assert nodes.agg(F.sum(F.length("text"))).first()[0] == 50_000


def test_no_page_ends_a_job(spark):
    script = '<script type="application/ld+json">{}</script>'
    posting = '{"@type": "JobPosting", "title": "T", "url": "/jobs/one-two"}'
    broken = [
        "<![foo[bar]]><h1>A</h1>", "<![CDATA[x]]><h1>B</h1>", "<!x", "<h1>C", "<" * 3000, "</p></p><h1>D</h1>", script.format("[" * 100_000), script.format('{"a":' * 50_000),
        script.format(posting.replace('"T"', '"half \\ud800 of"')), script.format('{"title": "half \\udc00"}'), script.format('{"@type": "JobPosting", "title": 3, "url": []}'), None, "",
        "<div>" * 2000 + "word " * 10,
    ]
    df = spark.createDataFrame([(k, "https://x.org/", h) for k, h in enumerate(broken)] + [(99, "https://x.org/", script.format(posting))], "page_id long, url string, html string")
    found = extract.from_jsonld(dom.nodes(df))
    assert {(r["page_id"], r["title"]) for r in found.collect()} == {(8, "half ? of"), (99, "T")}
    titles = {r["page_id"]: r["title"] for r in dom.detail_titles(dom.nodes(df, tags=dom.TITLE_TAGS, text_of=dom.TITLE_TAGS)).collect()}
    assert (titles[0], titles[1], titles[3], titles[5], titles[9]) == ("A", "B", "C", "D", "half ?")
    assert dom.shells(df).count() == len(broken) + 1
    assert dom.stored(dom.nodes(df)).count() > 2000 and extract.postings(dom.stored(dom.nodes(df))).count() == 2


def test_texts_are_handed_on_in_parts(spark, monkeypatch):
    whole = [r[:] for r in dom.parse("<p>a<b>c</b></p><p>d</p>")]
    monkeypatch.setattr(dom, "BATCH_TEXT", 0)
    df = spark.createDataFrame([(1, "u", "<p>a<b>c</b></p><p>d</p>")], "page_id long, url string, html string")
    assert [(r["node_id"], r["text"]) for r in dom.nodes(df).orderBy("node_id").collect()] == [(r[0], r[-1]) for r in whole]


def test_page_tables_are_not_broadcast(spark):
    """Written tables are small on disk and large in the driver, so no extractor hands one to all tasks, however small it looks."""
    html = '<ul aria-label="Jobs"><li><a href="/job/abcd-1">One</a></li></ul><section>' + '<p class="card x"><a href="/job/abcd-2"><h3>Two</h3></a></p>' * 3 + "</section>"
    found = dom.stored(dom.nodes(spark.createDataFrame([(1, "https://h.example/", html)], "page_id long, url string, html string")))
    postings = extract.postings(found)
    assert "Broadcast" not in postings._jdf.queryExecution().executedPlan().toString()
    assert [(r["priority"], r["title"]) for r in postings.collect()] == [(2, "One")]


def test_pages_are_parsed_before_what_reads_them(spark):
    """No plan parses a page again for each of its readers, nor resolves links in the tasks that parse."""
    pages = spark.createDataFrame([(1, "https://join.com/companies/acme", "<p>x</p>")], "page_id long, url string, html string")
    made = adapters.from_proton(dom.nodes(pages)), extract.from_jsonld(dom.nodes(pages)), adapters.from_join(dom.nodes(pages), dom.stored(dom.nodes(pages)))
    assert not any("MapInArrow" in df._jdf.queryExecution().executedPlan().toString() for df in made)


def test_each_extractor_is_a_plan_of_its_own(spark):
    """The driver holds a plan for each extractor, not one of all of them for each time they are read."""
    html = '<body><ul><li><a href="/job/abcd-1">One</a></li></ul><section>' + '<p class="card x"><a href="/job/abcd-2"><h3>Two</h3></a></p>' * 3 + '</section><b><a href="/job/abcd-3">Three</a></b></body>'
    pages = spark.createDataFrame([(1, "https://h.example/", html), (2, "https://h.example/", html.replace("<li>", "<b>"))], "page_id long, url string, html string")
    postings = extract.postings(dom.stored(dom.nodes(pages, text_of=extract.TEXT_OF)))
    plan = postings._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1
    assert {(r["page_id"], r["priority"], r["title"]) for r in postings.collect()} == {(1, 2, "One"), (2, 3, "Two")}
    # no extractor reads the text of another element
    assert sorted(postings.collect()) == sorted(extract.postings(dom.stored(dom.nodes(pages))).collect())
