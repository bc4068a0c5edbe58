"""Column functions against hand-made cases and Python's own library."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from jobtide.functions import texts, urls


@pytest.fixture(scope="module")
def apply(spark):
    def run(function, *rows):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        names = [f"c{i}" for i in range(len(rows[0]))]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} string" for n in names)).repartition(1)
        return [r[0] for r in df.orderBy("i").select(function(*map(F.col, names)).alias("x")).collect()]

    return run


def test_canonical(apply):
    cases = {
        "https://a.b/x?locationCity=x&utm_source=y&Page=2&b=2&a=1": "https://a.b/x?a=1&b=2&locationCity=x",
        "https://a.b/jobs/results/jobs/results/9": "https://a.b/jobs/results/9",
        "https://a.b/p?q=a%20b&q=a+a&gh_jid=1#top": "https://a.b/p?q=a+a&q=a+b#top",
        "https://a.b/p?x=&y": "https://a.b/p?x=&y=",
        "https://a.b/p?x=%C3%BC*~": "https://a.b/p?x=%C3%BC%2A~",
        "https://a.b/p?x=%zz": "https://a.b/p?x=%25zz",
        "": "",
    }
    assert apply(urls.canonical, *cases) == list(cases.values())
    assert apply(urls.canonical, *cases.values()) == list(cases.values())


def test_page_identity(apply):
    cases = {"http://a/?page=1&start=0&q=a b": "http://a/?q=a%20b", "http://a/?page=2&page=1": "http://a/", "http://a/?b=2&a=1&b=1": "http://a/?a=1&b=2&b=1"}
    assert apply(urls.page_identity, *cases) == list(cases.values())


def test_with_param(apply):
    out = apply(lambda u: urls.with_param(u, "page", 3), "http://a/?page=1&x=2&page=2", "http://a/?x=1&x=2#f", "http://a/")
    assert out == ["http://a/?page=3&x=2", "http://a/?x=2&page=3#f", "http://a/?page=3"]


def test_absolute_is_rfc_resolution(apply):
    base = "https://h.example/a/b?q#f"
    refs = ["x", "/x", "//y/z", "http://k/", "?z", "#t", "../c", "", "/", "http:x", "mailto:a@b", "/x?", "http://k", "./q/../r", "/a/../b"]
    assert apply(urls.absolute, *((r, base) for r in refs)) == [urljoin(base, r) for r in refs]


@pytest.mark.parametrize(
    ("url", "detail"),
    [
        ("https://x.com/careers/eng/123", True), ("https://x.com/en-us/details/200500123", True), ("https://x.com/job/data-engineer", True),
        ("https://jobs.lever.co/acme/0a1b2c3d-0000-1111-2222-333344445555", True), ("https://jobs.lever.co/acme", False),
        ("https://job-boards.greenhouse.io/acme/x/12", False), ("https://boards.greenhouse.io/acme/jobs/12", True), ("https://boards.greenhouse.io:443/acme/12", False),
        ("https://x.com/about/jobs/data", False), ("https://x.com/jobs/data?page=2", False), ("https://x.com/jobs/data", True), ("/jobs/data", False), ("ftp://x.com/job/abcdefg", False),
    ],
)
def test_detail(apply, url, detail):
    assert apply(urls.is_detail, url) == [detail]


def test_adapters_and_links(apply):
    hosts = {
        "https://jobs.eu.lever.co/a": "lever", "https://www.metacareers.com/jobs": "meta", "https://jobs.careers.microsoft.com/x": "microsoft",
        "https://job-boards.eu.greenhouse.io/proton": "proton", "https://acme.wd5.myworkdayjobs.com/x": "workday", "https://join.com/companies/a": "join",
        "https://boards.greenhouse.io/a": "greenhouse", "https://jobs.ashbyhq.com/a": "ashby", "https://example.com/": "generic",
    }
    assert apply(urls.adapter, *hosts) == list(hosts.values())
    assert apply(urls.greenhouse_link, ("/a/jobs/12/?x=1&amp;y#z", "https://boards.greenhouse.io/a"), ("/a/12", "https://boards.greenhouse.io/a"), ("https://o.com/jobs/12", "x")) == ["https://boards.greenhouse.io/a/jobs/12", None, None]
    uuid = "0a1b2c3d-0000-1111-2222-333344445555"
    assert apply(urls.ashby_link, (f"/a/{uuid}/", "https://jobs.ashbyhq.com/a")) == [f"https://jobs.ashbyhq.com/a/{uuid}"]
    assert apply(urls.details_url, "https://h/en/app/job/Zurich/T_R1?x", "https://h/details/job/x", "https://h/job") == ["https://h/en/app/details/T_R1?x", "https://h/details/job/x", "https://h/job"]
    assert apply(urls.requisition_id, "Engineer JR-12345-1 x", "none") == ["JR-12345-1", None]
    assert apply(urls.api_host, "JOBS.eu.lever.co", "jobs.lever.co") == ["api.eu.lever.co", "api.lever.co"]
    assert apply(urls.microsoft_slug, " Staff Eng. (C++) é") == ["Staff-Eng.-%28C%2B%2B%29-%C3%A9"]
    assert apply(urls.microsoft_slug, "\t A~b_c *\n", None) == ["A~b_c-%2A", ""]
    assert apply(urls.is_http, "mailto:a", None, "/x", "http://a", "ftp://a") == [False, False, True, True, False]
    assert apply(lambda a, b: urls.job_item_id(a, F.split(b, ",")), ("Job item 1854316", ""), ("", "123456789,1234567,x654321")) == ["1854316", "654321"]


def test_texts(apply):
    assert apply(texts.slugify, "Zürich & Genève!", "日本", "--A b--") == ["zurich-geneve", "page", "a-b"]
    assert apply(texts.norm, " Zürich-Straße 5 ", "ﬁ") == ["zurich strasse 5", "fi"]
    assert apply(texts.split_locations, "Geneva; Paris, |x·y ", None) == [["Geneva", "Paris", "x", "y"], []]
    assert apply(texts.label_title, "Learn more about  Data Lead", "Apply", " Data ", None) == ["Data Lead", "", "Data", ""]
    assert apply(texts.anchor_title, ("a \n b", "t"), ("", "t"), ("SHARE", None)) == ["a b", "t", ""]
    assert apply(texts.attribute_title, ("", "View details for X", "t"), (None, None, None)) == ["X", ""]
    assert apply(texts.is_heading, "View job", "abc", "Data", "!!a!!", None) == [False, False, True, False, False]
    assert apply(texts.results_window, "Results 1–20 of 45", "5-1 of 9", "none") == [(20, 45), (None, 9), None]
    assert apply(texts.whole_number, " 1,234 ", "x") == [1234, None]
    assert apply(texts.page_of, "Page 2 of 7") == [(2, 7)]
    assert apply(texts.cleaned_title, "Data - Meta", "Find your role") == ["Data", ""]
    assert apply(texts.class_key, "b  a", None) == ["a b", ""]
    assert apply(texts.is_generic_class, "a row", "", "card") == [True, True, False]
    assert apply(lambda x: texts.floor_median(F.transform(F.split(x, ","), lambda v: v.cast("int"))), "7,4", "3,1,2") == [5, 2]
    assert apply(texts.svg_view_box, '<svg viewBox="0 0 10,5">', '<svg width="4px" height="3">', "<svg>") == [[0, 0, 10, 5], [0, 0, 4, 3], None]


def test_svg(apply):
    sized = '<?xml?><svg width="40px" height="20"><g/></svg>'
    assert apply(texts.svg_with_view_box, sized, '<svg viewBox="1 2 3 4"/>', '<svg width="2em" height="3"/>') == [
        '<?xml?><svg viewBox="0 0 40 20" width="40px" height="20"><g/></svg>', '<svg viewBox="1 2 3 4"/>', '<svg width="2em" height="3"/>'
    ]
    assert apply(lambda x: texts.svg_expanded(x, 5), sized, "<svg/>") == ['<?xml?><svg viewBox="-2 -2 44 24" width="40px" height="20"><g/></svg>', "<svg/>"]
    out = apply(lambda x: texts.svg_outlined(x, 1.5), sized, "none")
    assert out[0].count("<g filter=") == 1 and out[0].endswith("<g/></g></svg>") and 'radius="1.5"' in out[0] and out[1] == "none"
    assert apply(urls.unescaped, "a&amp;b&lt;", "&eacute;&nbsp;&amp;lt;", "&x", None) == ["a&b<", "é\xa0&lt;", "&x", None]
    assert apply(lambda x: F.date_format(texts.ensure_utc(x), "HH:mm"), "2024-01-01T10:00:00", "2024-01-01T10:00:00+02:00", "2024-01-01 10:00:00Z", "x", None) == ["10:00", "08:00", "10:00", None, None]


def test_distance():
    assert texts.osa_distance("abcd", "xyzbcd", 3) == 3 and texts.osa_distance("abcd", "xyzbcd", 2, compat=True) == 1
    assert texts.osa_distance("ab", "ba", 2) == 1 and texts.osa_distance("geneva", "geneve", 2) == 1
    assert texts.osa_distance("abc", "xyz", 2) == 3


def test_distance_is_the_recurrence():
    import random
    from functools import cache

    pick = random.Random(3)
    for _ in range(4000):
        a, b = ("".join(pick.choices("abc", k=pick.randint(0, 7))) for _ in range(2))

        @cache
        def d(i, j, a=a, b=b):
            if not i or not j:
                return i + j
            n = min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
            return min(n, d(i - 2, j - 2) + 1) if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] else n

        for most in (0, 1, 2, 3):
            assert texts.osa_distance(a, b, most) == min(d(len(a), len(b)), most + 1)


def test_ages(spark):
    rows = spark.createDataFrame([(True, 3600.0), (True, 49 * 3600.0), (True, 8 * 86400.0), (False, 1.0)], "a boolean, s double")
    out = rows.select(texts.age_text(F.col("s")), texts.age_class(F.col("a"), F.col("s"))).collect()
    assert [tuple(r) for r in out] == [("1.0h", "new"), ("2.0d", "plain"), ("8.0d", "old"), ("0.0h", "inactive")]
