"""Queries over the driver's tables, one for each group of operators, with DuckDB SQL to hold them against.

Events stand for status observations: a user is a posting of board user_id % 10, `error` means inactive, every other
type active. Times are given as text in UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.functions import texts, urls
from jobtide.operators import dom, extract, health, history, merge, paging, places
from jobtide.streaming import live

AS_OF = "2024-01-31 00:00:00"
KEY = ["board", "link"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def shown(x):
    return F.date_format(x, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("board"), F.col("user_id").alias("link"),
        F.when(F.col("event_type") == "error", "inactive").otherwise("active").alias("status"),
        F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"),
    )


def status_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.normalized(observations(spark, sf_dir), KEY, from_active=True)


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts of boards: an error is an empty success or, on every third id, a failure."""
    failed = (F.col("event_type") == "error") & (F.col("event_id") % 3 == 0)
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("board"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), (~failed).alias("ok"),
        F.when(F.col("event_type") == "error", 0).otherwise(F.floor(F.col("value") / 10)).cast("long").alias("n"),
    )


_SHOW = "'%Y-%m-%d %H:%M:%S.%f'"
_HISTORY = """e AS (
  SELECT user_id % 10 AS board, user_id AS link, CASE WHEN event_type = 'error' THEN 'inactive' ELSE 'active' END AS status,
    ts AS tm, event_id AS seq FROM events),
s AS (SELECT *, max(CASE WHEN status = 'active' THEN 1 ELSE 0 END) OVER (PARTITION BY link ORDER BY tm, seq ROWS UNBOUNDED PRECEDING) AS seen FROM e),
r AS (SELECT *, lag(status) OVER (PARTITION BY link ORDER BY tm, seq) AS before FROM s WHERE seen = 1),
c AS (SELECT * FROM r WHERE before IS NULL OR before <> status),
m AS (SELECT *, lag(tm) OVER (PARTITION BY link ORDER BY tm, seq) AS b, lead(tm) OVER (PARTITION BY link ORDER BY tm, seq) AS a FROM c),
h AS (SELECT board, link, status, tm, seq FROM m WHERE NOT coalesce(
  (status = 'inactive' AND a - tm <= INTERVAL 6 HOURS) OR (status = 'active' AND tm - b <= INTERVAL 6 HOURS), false)),
p AS (SELECT *, lead(tm) OVER (PARTITION BY link ORDER BY tm, seq) AS e FROM h),
i AS (SELECT board, link, tm AS s, coalesce(e, TIMESTAMP '2024-01-31 00:00:00') AS e FROM p WHERE status = 'active' AND (e IS NULL OR e > tm))"""


@query(f"WITH {_HISTORY} SELECT board, link, status, strftime(tm, {_SHOW}) AS \"at\" FROM h")
def history_normalize(spark, sf_dir):
    return status_history(spark, sf_dir).select("board", "link", "status", shown("at").alias("at"))


@query(f"""WITH RECURSIVE n AS (
  SELECT user_id % 10 AS board, user_id AS link, CASE WHEN event_type = 'error' THEN 'inactive' ELSE 'active' END AS status, ts AS tm,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (
  SELECT board, link, k, [{{'tm': tm, 'status': status}}] AS h FROM n WHERE k = 1
  UNION ALL
  SELECT n.board, n.link, n.k, CASE WHEN len(h) = 0 THEN [{{'tm': tm, 'status': status}}] WHEN h[-1].status = n.status THEN h
    WHEN n.status = 'active' AND h[-1].status = 'inactive' AND tm - h[-1].tm <= INTERVAL 6 HOURS THEN h[:-2]
    ELSE list_append(h, {{'tm': tm, 'status': n.status}}) END
  FROM f JOIN n ON n.link = f.link AND n.k = f.k + 1),
l AS (SELECT board, link, unnest(arg_max(h, k)) AS e FROM f GROUP BY board, link)
SELECT board, link, e.status AS status, strftime(e.tm, {_SHOW}) AS "at" FROM l""")
def history_fold(spark, sf_dir):
    """The event-by-event fold, which differs from the windows only for postings that start inactive."""
    grouped = observations(spark, sf_dir).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("at", "seq", "status"))).alias("h"))
    return grouped.select(*KEY, F.explode(history.folded(F.col("h"))).alias("e")).select(*KEY, "e.status", shown("e.at").alias("at"))


@query(f"WITH {_HISTORY} SELECT board, link, strftime(s, {_SHOW}) AS start, strftime(e, {_SHOW}) AS \"end\" FROM i")
def active_intervals(spark, sf_dir):
    return history.intervals(status_history(spark, sf_dir), KEY, as_of()).select(*KEY, shown("start").alias("start"), shown("end").alias("end"))


@query(f"""WITH {_HISTORY},
g AS (SELECT min(s) AS first, greatest(max(e), TIMESTAMP '2024-01-31 00:00:00') AS last FROM i),
t AS (SELECT unnest(generate_series(first, last, INTERVAL 30 MINUTES)) AS t FROM g),
d AS (SELECT board, tm, sum(d) AS d FROM (SELECT board, s AS tm, 1 AS d FROM i WHERE e > s UNION ALL SELECT board, e, -1 FROM i WHERE e > s) GROUP BY ALL),
u AS (SELECT board, tm, sum(d) OVER (PARTITION BY board ORDER BY tm) AS n FROM d),
b AS (SELECT DISTINCT board FROM i), x AS (SELECT board, t FROM b, t)
SELECT x.board, strftime(x.t, {_SHOW}) AS time, CAST(coalesce(u.n, 0) AS BIGINT) AS active
FROM x ASOF LEFT JOIN u ON x.board = u.board AND x.t >= u.tm""")
def active_step_counts(spark, sf_dir):
    spans = history.intervals(status_history(spark, sf_dir), KEY, as_of())
    return history.step_counts(spans, "board", 30, as_of()).select("board", shown("time").alias("time"), "active")


@query(f"""WITH {_HISTORY},
t AS (SELECT TIMESTAMP '2024-01-31 00:00:00' AS now, TIMESTAMP '2024-01-30 00:00:00' AS ago),
j AS (SELECT link, arg_max(status, seq) AS status, coalesce(min(CASE WHEN status = 'active' THEN tm END), min(tm)) AS since,
  min(CASE WHEN status = 'active' THEN tm END) AS fa FROM h GROUP BY link),
k AS (SELECT j.*, EXISTS (SELECT 1 FROM i, t WHERE i.link = j.link AND i.s <= t.ago AND t.ago < i.e) AS past FROM j),
a AS (SELECT count_if(status = 'active') AS active_now, count_if(past) AS active_before,
  count_if(status = 'active' AND now - since <= INTERVAL 24 HOURS) AS new_now,
  count_if(past AND ago >= fa AND ago - fa <= INTERVAL 48 HOURS) AS new_before FROM k, t)
SELECT CAST(active_now AS BIGINT) AS active_now, CAST(active_before AS BIGINT) AS active_before, CAST(new_now AS BIGINT) AS new_now,
  CAST(new_before AS BIGINT) AS new_before, CAST(active_now - active_before AS BIGINT) AS active_delta, CAST(new_now - new_before AS BIGINT) AS new_delta FROM a""")
def active_new_metrics(spark, sf_dir):
    return history.metrics(status_history(spark, sf_dir), KEY, as_of())


@query("""WITH s AS (SELECT o_orderkey, o_orderdate AS s, max(l_shipdate) AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
t AS (SELECT DISTINCT date_trunc('year', o_orderdate) AS t FROM orders)
SELECT strftime(t, '%Y-%m-%d') AS moment, o_orderkey FROM t JOIN s ON s <= t AND t < e""")
def interval_stab(spark, sf_dir):
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    shipped = items.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("end"))
    spans = orders.join(shipped, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.col("o_orderdate").alias("start"), "end")
    moments = orders.select(F.date_trunc("year", "o_orderdate").alias("moment")).distinct()
    return history.active_at(spans, moments, ["o_orderkey"]).select(F.date_format("moment", "yyyy-MM-dd").alias("moment"), "o_orderkey")


def _content(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("long").alias("board"), F.col("c_custkey").alias("link"), F.col("c_name").alias("title"), (F.col("c_custkey") % 4 != 0).alias("active"), F.col("c_custkey").alias("seq")
    )


def _snapshot(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.select(
        F.col("c_nationkey").cast("long").alias("board"), F.when(F.col("o_orderkey") % 5 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("link"),
        F.concat(F.lit("t"), F.col("o_orderkey") % 3).alias("title"), F.col("o_orderkey").alias("seq"),
    )


_MERGE = """o AS (SELECT CAST(c_nationkey AS BIGINT) AS board, c_custkey AS link, c_name AS title, c_custkey % 4 <> 0 AS active FROM customer),
n AS (SELECT CAST(c_nationkey AS BIGINT) AS board, CASE WHEN o_orderkey % 5 = 0 THEN -o_custkey ELSE o_custkey END AS link, arg_max('t' || (o_orderkey % 3), o_orderkey) AS title
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


@query(f"""WITH {_MERGE}
SELECT board, link, coalesce(n.title, o.title) AS title, n.link IS NOT NULL AS active,
  CASE WHEN n.link IS NOT NULL AND NOT coalesce(active, false) THEN 'active' WHEN n.link IS NULL AND active THEN 'inactive' END AS event,
  o.link IS NULL AS is_new
FROM o FULL JOIN n USING (board, link)""")
def merge_snapshot(spark, sf_dir):
    """Every order is a scrape row."""
    return merge.merged(_content(spark, sf_dir), _snapshot(spark, sf_dir), KEY)


@query(f"WITH {_MERGE} SELECT board, link, title FROM o ANTI JOIN n USING (board, link)")
def missing_from_snapshot(spark, sf_dir):
    """Customers without a row among all orders."""
    return merge.missing(_content(spark, sf_dir), _snapshot(spark, sf_dir), KEY).select("board", "link", "title")


_HEALTH = """a AS (SELECT user_id % 10 AS board, ts AS tm, event_id AS seq, NOT (event_type = 'error' AND event_id % 3 = 0) AS ok,
  CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value / 10) AS BIGINT) END AS n FROM events),
x AS (SELECT *, ok AND n > 0 AS good FROM a),
y AS (SELECT *, sum(CASE WHEN good THEN 1 ELSE 0 END) OVER w AS island, lag(good) OVER (PARTITION BY board ORDER BY tm, seq) AS was,
  last_value(CASE WHEN good THEN n END IGNORE NULLS) OVER w AS last_nonzero_count,
  list(CASE WHEN good THEN n END) OVER (PARTITION BY board ORDER BY tm, seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS recent
  FROM x WINDOW w AS (PARTITION BY board ORDER BY tm, seq ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, list_sort(list_filter(recent, lambda q: q IS NOT NULL)[-10:]) AS srt FROM y),
z AS (SELECT *, CASE WHEN good THEN (srt[(len(srt) + 1) // 2] + srt[len(srt) // 2 + 1]) // 2 END AS base,
  sum(CASE WHEN good THEN 0 ELSE 1 END) OVER i AS streak, min(CASE WHEN NOT good THEN tm END) OVER i AS first_zero,
  max(CASE WHEN NOT good THEN tm END) OVER i + INTERVAL 1 DAY AS flagged FROM
  (SELECT * REPLACE (list_sort(list_filter(recent, lambda q: q IS NOT NULL)[greatest(len(list_filter(recent, lambda q: q IS NOT NULL)) - 9, 1):]) AS srt) FROM b)
  WINDOW i AS (PARTITION BY board, island ORDER BY tm, seq ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, last_value(base IGNORE NULLS) OVER (PARTITION BY board ORDER BY tm, seq ROWS UNBOUNDED PRECEDING) AS baseline FROM z)"""


@query(f"""WITH {_HEALTH}
SELECT board, seq, CAST(streak AS BIGINT) AS streak, strftime(first_zero, {_SHOW}) AS first_zero_at, strftime(flagged, {_SHOW}) AS flagged_until,
  CAST(last_nonzero_count AS BIGINT) AS last_nonzero_count,
  CASE WHEN good THEN 'normal' WHEN coalesce(last_nonzero_count, 0) >= 3 THEN
    CASE WHEN tm - first_zero <= INTERVAL 24 HOURS AND streak >= 5 THEN 'down' ELSE 'suspect' END
    WHEN streak >= 2 THEN 'suspect' ELSE 'normal' END AS status,
  CASE WHEN good THEN 'NONE' WHEN coalesce(was, false) AND n = 0 THEN 'ZERO_SPIKE' ELSE 'EMPTY_STREAK' END AS reason FROM v""")
def health_streaks(spark, sf_dir):
    return health.states(attempts(spark, sf_dir)).select(
        "board", "seq", "streak", shown("first_zero_at").alias("first_zero_at"), shown("flagged_until").alias("flagged_until"), "last_nonzero_count", "status", "reason"
    )


@query(f"WITH {_HEALTH} SELECT board, seq, CAST(baseline AS INTEGER) AS baseline FROM v")
def baseline_median(spark, sf_dir):
    return health.states(attempts(spark, sf_dir)).select("board", "seq", "baseline")


@query(f"""WITH {_HEALTH}, s AS (SELECT *, lag(n) OVER (PARTITION BY board ORDER BY tm, seq) AS pn, lag(ok) OVER (PARTITION BY board ORDER BY tm, seq) AS pok,
  CASE WHEN good THEN true WHEN coalesce(last_nonzero_count, 0) >= 3 THEN false ELSE streak < 2 END AS normal FROM v)
SELECT board, CAST(count_if(coalesce(ok AND pok AND pn = 0 AND normal, false) AND n = 0) AS BIGINT) AS two_zeros, CAST(count_if(normal AND n = 0) AS BIGINT) AS one_zero FROM s GROUP BY board""")
def deactivation_gate(spark, sf_dir):
    empty = F.col("n") == 0
    return health.states(attempts(spark, sf_dir)).groupBy("board").agg(
        F.count_if(health.may_deactivate() & empty).alias("two_zeros"), F.count_if(health.may_deactivate(False) & empty).alias("one_zero")
    )


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50")
def attempt_cap(spark, sf_dir):
    return history.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 50).select("user_id", "event_id")


@query("SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text")
def first_wins_dedupe(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return history.first_wins(keyed, ["h"], ["doc_id"]).select("doc_id", "source")


_FRONT = r"regexp_extract(url, '^([^?#]*)', 1)"
_PARTS = r"string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&')"
_FRAGMENT = r"CASE WHEN regexp_extract(url, '#(.*)$', 1) <> '' THEN '#' || regexp_extract(url, '#(.*)$', 1) ELSE '' END"
# a query, and what is left of it: keys that do not tell postings apart go, the others are sorted and encoded anew
_QUERIES = (
    ("locationCity=x&utm_source=y&Page=2&b=2&a=1", "a=1&b=2&locationCity=x"),
    ("gh_src=q&id=7&ref=mail&id=4", "id=4&id=7"),
    ("q=a%20b&q=a+a&_ga=1&lat=4&lng=5", "q=a+a&q=a+b"),
    ("x=&y&utm_term=z", "x=&y="),
)


@query(rf"""WITH c AS (SELECT page_id, url, 0 AS k, regexp_replace(url, '\?(page=2&ref=x|utm_source=feed)', '') AS link FROM pages
  UNION ALL SELECT page_id, {_FRONT} || '?' || q, k, {_FRONT} || CASE WHEN l = '' THEN '' ELSE '?' || l END
  FROM pages, (VALUES {', '.join(f"({k}, '{q}', '{x}')" for k, (q, x) in enumerate(_QUERIES, 1))}) AS v(k, q, l)
  UNION ALL SELECT page_id, replace(url, '/en/', '/jobs/results/jobs/results/jobs/results/'), 9, regexp_replace(replace(url, '/en/', '/jobs/results/'), '\?(page=2&ref=x|utm_source=feed)', '') FROM pages)
SELECT page_id, k, link FROM c""")
def canonical_url(spark, sf_dir):
    """URL-3 on the URLs as they are, with other queries, and with a repeated path."""
    url, front = F.col("url"), F.regexp_extract("url", r"^([^?#]*)", 1)
    cases = [(0, url), *((k, F.concat(front, F.lit("?" + q))) for k, (q, _) in enumerate(_QUERIES, 1))]
    cases.append((9, F.replace(url, F.lit("/en/"), F.lit("/jobs/results/jobs/results/jobs/results/"))))
    made = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), x.alias("u")) for k, x in cases))).alias("c"))
    return made.select("page_id", "c.k", urls.canonical(F.col("c.u")).alias("link"))


@query(f"""WITH q AS (SELECT page_id, url, array_to_string(list_sort(list_filter({_PARTS},
  lambda p: p <> '' AND NOT (split_part(p, '=', 1) IN ('page', 'pg', 'p', 'pageNumber') AND split_part(p, '=', 2) = '1')
  AND NOT (split_part(p, '=', 1) IN ('start', 'offset', 'from', 'startrow') AND split_part(p, '=', 2) = '0'))), '&') AS kept FROM pages)
SELECT page_id, {_FRONT} || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END || {_FRAGMENT} AS page FROM q""")
def page_identity(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.page_identity(F.col("url")).alias("page"))


# hosts (empty: the page's own) and paths with what they are; a literal list, so that no pattern is on both sides
_UUID = "0a1b2c3d-0000-1111-2222-333344445555"
_DETAIL_CASES = (
    ("", "/careers/eng/123", True), ("", "/en-us/details/200500123", True), ("", "/details/200500", True), ("", "/details/20050", False),
    ("", "/job/data-engineer", True), ("", "/job/data", True), ("", "/job/abc", False), ("", "/jobs/results/9", True), ("", "/positions/12", True),
    ("", "/vacancy/5", True), ("", "/vacancies/x", False), ("", "/about/jobs/data", False), ("", "/jobs/data?page=2", False), ("", "/jobs/data", True),
    ("", "/help/job/x1", False), ("", "/team", False), ("", "/job/Zurich/Lead_JR-12345", True), ("", "/en-us/apply/200500-1", True), ("", "/en-us/apply/20050-1", False),
    ("jobs.lever.co", "/acme/" + _UUID, True), ("jobs.lever.co", "/acme", False), ("boards.greenhouse.io", "/acme/jobs/12", True),
    ("boards.greenhouse.io", "/acme/about", False), ("acme.wd5.myworkdayjobs.com", "/x/job/y", True), ("jobs.ashbyhq.com", "/acme/" + _UUID, True),
    ("careers.smartrecruiters.com", "/acme/123", True), ("smartrecruiters.com.evil.org", "/acme/123", False),
)


@query(rf"""WITH c AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{h}', '{p}', {str(d).lower()})" for k, (h, p, d) in enumerate(_DETAIL_CASES))}) AS v(k, host, path, detail))
SELECT page_id, k, detail FROM pages, c""")
def detail_url_flags(spark, sf_dir):
    """URL-7, URL-8 for each page's host and hosts of applicant-tracking systems."""
    own = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    cases = F.array(*(F.struct(F.lit(k).alias("k"), F.concat(F.lit("https://"), F.lit(h) if h else own, F.lit(p)).alias("u")) for k, (h, p, _) in enumerate(_DETAIL_CASES)))
    made = table(spark, sf_dir, "pages").select("page_id", F.explode(cases).alias("c"))
    return made.select("page_id", "c.k", urls.is_detail(F.col("c.u")).alias("detail"))


# hosts and the names of their adapters, below /proton and elsewhere
_BOARD_HOSTS = (
    ("jobs.lever.co", "lever", "lever"), ("JOBS.eu.lever.co", "lever", "lever"), ("acme.wd5.myworkdayjobs.com", "workday", "workday"),
    ("boards.greenhouse.io", "greenhouse", "greenhouse"), ("job-boards.eu.greenhouse.io", "proton", "generic"), ("jobs.ashbyhq.com", "ashby", "ashby"),
    ("www.join.com", "join", "join"), ("join.com.example.net", "generic", "generic"), ("www.metacareers.com", "meta", "meta"),
    ("jobs.careers.microsoft.com", "microsoft", "microsoft"), ("wd3.myworkdaysite.com", "workday", "workday"), ("", "generic", "generic"),
)


@query(rf"""WITH h AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{p}', '{o}')" for k, (_, p, o) in enumerate(_BOARD_HOSTS))}) AS v(k, proton, other))
SELECT page_id, k, CASE WHEN page_id % 3 = 0 THEN proton ELSE other END AS adapter FROM pages, h""")
def adapter_dispatch(spark, sf_dir):
    """JOIN-4 for the pages' URLs with the hosts of boards, every third one below /proton."""
    own = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    rest = F.concat(F.when(F.col("page_id") % 3 == 0, "/proton").otherwise("/acme"), F.regexp_extract("url", r"^https?://[^/?#]+(.*)$", 1))
    cases = F.array(*(F.struct(F.lit(k).alias("k"), F.concat(F.lit("https://"), F.lit(h) if h else own, rest).alias("u")) for k, (h, _, _) in enumerate(_BOARD_HOSTS)))
    made = table(spark, sf_dir, "pages").select("page_id", F.explode(cases).alias("c"))
    return made.select("page_id", "c.k", urls.adapter(F.col("c.u")).alias("adapter"))


@query(r"""SELECT page_id, CAST(count(*) AS BIGINT) AS anchors, CAST(count(DISTINCT href) AS BIGINT) AS links FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages) GROUP BY page_id""")
def page_anchors(spark, sf_dir):
    found = dom.nodes(table(spark, sf_dir, "pages"), tags=("a",), text_of=()).where((F.col("tag") == "a") & dom.attr("href").isNotNull())
    found = found.withColumn("ref", urls.absolute(dom.attr("href"), F.col("url"))).groupBy(*dom.PAGE)
    return found.agg(F.count("*").alias("anchors"), F.count_distinct("ref").alias("links")).select("page_id", "anchors", "links")


@query(r"""SELECT page_id, trim(regexp_replace(replace(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM pages""")
def page_headings(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = dom.nodes(pages, tags=("body", *dom.HEADINGS), text_of=dom.HEADINGS)
    whole, heads = dom.once(found, F.col("tag") == "body", dom.headings)
    titles = dom.heading_texts(whole, heads)
    return pages.select("page_id", "url").join(titles, dom.PAGE, "left").select("page_id", F.coalesce("highest", F.lit("")).alias("title"))


def _shell_pages(spark, sf_dir):
    """Some pages without HTML, with a mount, a spinner, a hint for scripts, or a few nodes only."""
    html = F.replace("html", F.lit("<article>"), F.lit('<div id="root">'))
    small = F.lit("<body><p>x</p>" + "<script>y</script>" * 3 + "</body>")
    k = F.col("page_id") % 8
    made = (
        F.when(k == 1, None).when(k == 2, "").when(k == 3, html).when(k == 4, F.replace("html", F.lit("<article>"), F.lit('<div class="a app-loading-spinner">')))
        .when(k == 5, F.replace("html", F.lit("<article>"), F.lit("<article>Please Enable JavaScript now."))).when(k == 6, small).otherwise(F.col("html"))
    )
    return table(spark, sf_dir, "pages").withColumn("html", made)


_SHELL = r"""q AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '<\1>', 'gs'), '<!DOCTYPE[^>]*>', '') AS bare FROM p),
t AS (SELECT *, len(regexp_extract_all(bare, '<[a-z][^>]*>')) - len(regexp_extract_all(bare, '<(script|style)>')) AS nodes, len(regexp_extract_all(bare, '<script>')) AS scripts,
  array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(regexp_extract(bare, '<body>(.*)$', 1, 's'), '&[a-z]+;', 'x', 'g'), '<[^>]*>'),
    lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), ' ') AS body FROM q),
v AS (SELECT page_id, CAST(nodes AS BIGINT) AS nodes, CAST(scripts AS BIGINT) AS scripts, len(body) AS text_length, k = 5 AS hint, k = 3 AS mount, k = 4 AS spinner,
  coalesce(html, '') = '' OR k IN (3, 4, 5) OR (nodes < 15 AND scripts >= 3) OR (nodes > 200 AND len(body) < 800 AND scripts >= 3) AS needs_script FROM t)"""
_PLAIN = "p AS (SELECT page_id, 0 AS k, html FROM pages)"


def _features(pages: DataFrame) -> DataFrame:
    counts = (F.col(c).cast("long").alias(c) for c in ("nodes", "scripts", "text_length"))
    return dom.shells(pages).select("page_id", *counts, "hint", "mount", "spinner", "needs_script")


@query(f"WITH {_PLAIN}, {_SHELL} SELECT * EXCLUDE needs_script FROM v")
def js_shell_features(spark, sf_dir):
    return _features(table(spark, sf_dir, "pages")).drop("needs_script")


@query(f"WITH {_PLAIN}, {_SHELL} SELECT page_id, needs_script FROM v")
def js_shell_verdicts(spark, sf_dir):
    """FLT-5 of the pages as they are."""
    return _features(table(spark, sf_dir, "pages")).select("page_id", "needs_script")


@query(f"""WITH p AS (SELECT page_id, page_id % 8 AS k, CASE page_id % 8 WHEN 1 THEN NULL WHEN 2 THEN '' WHEN 3 THEN replace(html, '<article>', '<div id="root">')
    WHEN 4 THEN replace(html, '<article>', '<div class="a app-loading-spinner">') WHEN 5 THEN replace(html, '<article>', '<article>Please Enable JavaScript now.')
    WHEN 6 THEN '<body><p>x</p>' || repeat('<script>y</script>', 3) || '</body>' ELSE html END AS html FROM pages), {_SHELL} SELECT * FROM v""")
def js_shell_kinds(spark, sf_dir):
    """FLT-5 with one page in eight of each kind of sign."""
    return _features(_shell_pages(spark, sf_dir))


def _items(html) -> list:
    """The links of a page's list, as (href, text)."""
    return F.zip_with(
        F.regexp_extract_all(html, F.lit(r'<li><a href="([^"]*)">[^<]*</a></li>'), 1), F.regexp_extract_all(html, F.lit(r'<li><a href="[^"]*">([^<]*)</a></li>'), 1),
        lambda a, b: F.struct(a.alias("href"), b.alias("text")),
    )


@query(r"""SELECT url, 'p' AS kind, 'card item' AS key FROM pages WHERE least(len(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>')), page_id % 6) >= 3""")
def repeated_blocks(spark, sf_dir):
    """AGG-8: up to five of a page's links as cards, beside others with a class of layout."""
    pages = table(spark, sf_dir, "pages").withColumn("items", _items(F.col("html")))
    cards = F.transform(F.slice("items", F.lit(1), (F.col("page_id") % 6).cast("int")), lambda x: F.concat(F.lit('<p class="item card">'), x["text"], F.lit("</p>")))
    rows = F.transform("items", lambda x: F.concat(F.lit('<span class="row x">'), x["text"], F.lit("</span>")))
    html = F.concat(F.lit("<div>"), F.array_join(cards, ""), F.lit("</div><section>"), F.array_join(rows, ""), F.lit("</section>"))
    return extract.prototypes(dom.nodes(pages.withColumn("html", html), text_of=())).select("url", "kind", "key")


@query(r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host, regexp_replace(html, 'href="/([A-Za-z])', 'href="/job/posting-\1', 'g') AS html FROM pages),
i AS (SELECT page_id, host, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">[^<]*</a></li>', 1)) AS href, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1)) AS t,
  generate_subscripts(regexp_extract_all(html, '<li>'), 1) AS k FROM p),
d AS (SELECT * FROM i WHERE regexp_matches(href, '^/job/[\p{L}\p{N}_-]{4,}$') QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY k) = 1)
SELECT page_id, 2 AS priority, trim(t) AS title, host || href AS link FROM d WHERE t <> ''""")
def first_nonempty_extractor(spark, sf_dir):
    """Postings of the pages; their links made to look like posting pages, which the table has none of."""
    pages = table(spark, sf_dir, "pages").withColumn("html", F.regexp_replace("html", r'href="/([A-Za-z])', 'href="/job/posting-$1'))
    # every extractor reads the nodes: they are parsed once
    return extract.postings(dom.stored(dom.nodes(pages, text_of=extract.TEXT_OF))).select("page_id", "priority", "title", "link")


_PAGERS = (
    ('<a href="/a">x</a><a rel="next nofollow" href="/b?page=2">n</a>', "'/b?page=2'"),
    ('<a aria-label="Weiter" aria-disabled="true" href="/no">x</a><a aria-label="Weiter" href="/yes">x</a>', "'/yes'"),
    ('<span data-analytics-pagination="next"><a href="/w">n</a></span>', "'/w'"),
    ('<nav aria-label="Job pagination"><a href="/1">1</a><a aria-label="Next page" href="/nav">2</a></nav>', "'/nav'"),
    ('<input class="rc-pagination-pageinput" value="2"><div class="pagination"><a aria-label="1" href="?page=1">1</a><a aria-label="4" href="/l?page=4">4</a><a aria-label="3" href="/l?page=3">3</a></div>', "'/l?page=3'"),
    ('<div aria-live="polite">Page 3</div><a href="/l?seite=9#x">9</a><span class="rc-pagination-total-pages">1,200</span>', None),
    ('<div aria-live="polite">Page 7</div><a href="/l?seite=9">9</a><span class="rc-pagination-total-pages">7</span>', None),
    ("<p>nothing</p>", None),
)


@query(rf"""WITH p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host, regexp_extract(url, '^([^?#]*)', 1) AS front, contains(url, '?page=2') AS paged FROM pages)
SELECT page_id, CASE page_id % 8 {' '.join(f"WHEN {k} THEN host || {x}" for k, (_, x) in enumerate(_PAGERS) if x)}
  WHEN 5 THEN CASE WHEN paged THEN front || '?page=3&ref=x' ELSE front || regexp_replace('?seite=4', '', '') END
  WHEN 6 THEN CASE WHEN paged THEN front || '?page=3&ref=x' END WHEN 7 THEN CASE WHEN paged THEN front || '?page=3&ref=x' END END AS next_url FROM p""")
def next_page_urls(spark, sf_dir):
    """PAG-1 in all its tiers, PAG-2 and PAG-4: the pages with one of eight pagers, some below a URL with a page."""
    made = F.element_at(F.array(*(F.lit(x) for x, _ in _PAGERS)), (F.col("page_id") % 8).cast("int") + 1)
    bare = F.regexp_replace("url", "#.*$", "")
    cleaned = F.when(bare.contains("?page=2"), bare).otherwise(F.regexp_extract(bare, r"^([^?]*)", 1))
    pages = table(spark, sf_dir, "pages").withColumns({"html": made, "url": cleaned})
    found = dom.stored(dom.nodes(pages))
    return pages.select("page_id").join(paging.next_pages(found).select("page_id", "next_url"), "page_id", "left")


@query(r"""SELECT url, nullif(trim(replace(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1), '&amp;', '&')), '') AS title FROM pages""")
def page_titles(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = dom.detail_titles(dom.nodes(pages, tags=dom.TITLE_TAGS, text_of=dom.TITLE_TAGS))
    return dom.keyed(pages).select(*dom.PAGE).join(found, dom.PAGE, "left").select("url", "title")


@query("""SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type""")
def json_props(spark, sf_dir):
    value = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(value).alias("total"))


_SLUG = "regexp_replace(regexp_replace(regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g'), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"SELECT p_partkey, coalesce(nullif(lower({_SLUG.format(x='p_name')}), ''), 'page') AS slug FROM part")
def slugify_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", texts.slugify(F.col("p_name")).alias("slug"))


@query("""SELECT doc_id, CAST(len(l) AS INTEGER) AS n, array_to_string(l, '|') AS places FROM (
  SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[;,/|•·]+'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)""")
def split_locations(spark, sf_dir):
    found = texts.split_locations(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n"), F.array_join(found, "|").alias("places"))


_TERMS = ("blue", "green", "steel", "large")


@query(f"""SELECT DISTINCT p_partkey, t AS term FROM part, unnest(string_split(p_name, ' ')) AS w(x), (SELECT unnest([{', '.join(f"'{t}'" for t in _TERMS)}]) AS t)
WHERE contains(lower(x), t) OR contains(t, lower(x)) OR damerau_levenshtein(lower(x), t) <= 2""")
def fuzzy_match(spark, sf_dir):
    words = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("w")).select("p_partkey", texts.norm(F.col("w")).alias("w"))
    close = places.matching(words, "w", list(_TERMS)).withColumnRenamed("place", "w")
    return words.join(close, "w").select("p_partkey", "term").distinct()


@query(f"""WITH {_HISTORY}, j AS (SELECT link, arg_max(status, seq) AS status, min(CASE WHEN status = 'active' THEN tm END) AS fa FROM h GROUP BY link)
SELECT link, CAST(row_number() OVER (ORDER BY fa DESC, link) AS INTEGER) AS place FROM j
WHERE status = 'active' AND TIMESTAMP '2024-01-04 00:00:00' - fa <= INTERVAL 72 HOURS""")
def newest_feed(spark, sf_dir):
    """FLT-4, SRT-4: every active posting of the last 72 hours, newest first."""
    found = history.jobs(status_history(spark, sf_dir), KEY, F.lit("2024-01-04 00:00:00").cast("timestamp"))
    fresh = found.where(F.col("active") & (F.col("age_seconds") <= 72 * 3600))
    ranked = history.ranked(fresh, [F.col("first_active").desc(), F.col("link").asc()])
    return ranked.select("link", "place")


@query(f"""WITH {_HISTORY}, j AS (SELECT board, link, arg_max(status, seq) = 'active' AS active, min(CASE WHEN status = 'active' THEN tm END) AS fa FROM h GROUP BY board, link)
SELECT board, link, active, CAST(row_number() OVER (PARTITION BY board ORDER BY active DESC, CASE WHEN active THEN fa END DESC NULLS LAST, link) AS INTEGER) AS place FROM j""")
def board_list(spark, sf_dir):
    """SRT-3: places within a board, whose rows are many tasks' if they are many."""
    found = history.jobs(status_history(spark, sf_dir), KEY, as_of())
    order = [F.col("active").desc(), F.when(F.col("active"), F.col("first_active")).desc_nulls_last(), F.col("link").asc()]
    return history.ranked(found, order, within=["board"]).select("board", "link", "active", "place")


@query(f"""WITH {_HISTORY}, j AS (SELECT link, arg_max(status, seq) = 'active' AS active, epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(min(CASE WHEN status = 'active' THEN tm END)) AS age FROM h GROUP BY link)
SELECT CASE WHEN NOT active THEN 'inactive' WHEN age <= 172800000000 THEN 'new' WHEN age >= 604800000000 THEN 'old' ELSE 'plain' END AS age_class, CAST(count(*) AS BIGINT) AS n FROM j GROUP BY 1""")
def age_classes(spark, sf_dir):
    found = history.jobs(status_history(spark, sf_dir), KEY, as_of())
    return found.groupBy(texts.age_class(F.col("active"), F.col("age_seconds")).alias("age_class")).agg(F.count("*").alias("n"))


@query("""SELECT 'union' AS kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)
UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)""")
def set_ops(spark, sf_dir):
    known, seen = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    made = {"union": known.union(seen).distinct(), "except": known.subtract(seen), "intersect": known.intersect(seen)}
    counted = [x.agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k, x in made.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("""WITH w AS (SELECT user_id, CAST(count_if(event_type = 'error') AS BIGINT) AS error, CAST(count_if(event_type = 'view') AS BIGINT) AS "view", CAST(count_if(event_type = 'click') AS BIGINT) AS click FROM events GROUP BY user_id)
SELECT user_id, kind, n FROM (UNPIVOT w ON error, "view", click INTO NAME kind VALUE n)""")
def unpivot_counts(spark, sf_dir):
    kinds = ["error", "view", "click"]
    wide = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1))).fillna(0, kinds)
    return wide.unpivot(["user_id"], kinds, "kind", "n")


@query("""WITH d AS (SELECT o_orderkey, o_orderdate, (o_orderkey % 201 - 100) / 100.0 AS draw, epoch_us(TIMESTAMP '1996-01-01') AS now FROM orders),
m AS (SELECT *, epoch_us(o_orderdate) + 3600000000 + CAST(round(draw * 1800) AS BIGINT) * 1000000 AS planned, now + 300000000 AS least FROM d)
SELECT o_orderkey, strftime(make_timestamp(CASE WHEN planned < least THEN least + CASE WHEN draw = 0 THEN 0 ELSE CAST(round((draw + 1) * 15000000) AS BIGINT) END ELSE planned END), '%Y-%m-%d %H:%M:%S.%f') AS next_at,
  strftime(make_timestamp(now + greatest(CAST(round(1200000000 + draw * 300000000) AS BIGINT), 300000000)), '%Y-%m-%d %H:%M:%S.%f') AS after_error, o_orderdate <= TIMESTAMP '1996-01-01' AS due FROM m""")
def next_scrape(spark, sf_dir):
    """DT-8, STM-8 with a draw for each order, and FLT-2 without a limit."""
    now, last = F.lit("1996-01-01 00:00:00").cast("timestamp"), F.col("o_orderdate").cast("timestamp")
    draw = ((F.col("o_orderkey") % 201 - 100) / 100.0).cast("double")
    boards = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("file"), last.alias("next_scrape_at"), shown(health.next_scrape(last, now, draw=draw)).alias("next_at"), shown(health.next_after_error(now, draw)).alias("after_error"))
    due = health.due(boards, now, None).select("o_orderkey", F.lit(True).alias("due"))
    return boards.join(due, "o_orderkey", "left").select("o_orderkey", "next_at", "after_error", F.coalesce("due", F.lit(False)).alias("due"))


@query("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def windowed_counts(spark, sf_dir):
    found = live.tumbling(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return found.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k""")
def session_counts(spark, sf_dir):
    found = live.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return found.select("user_id", shown("w.start").alias("start"), "n")
