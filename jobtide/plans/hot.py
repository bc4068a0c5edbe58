"""Queries of operators that hold a key, a page or a table of terms of any size, with DuckDB SQL by another way."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobtide.operators import asof, dom, extract, health_scan, places, selectors
from jobtide.plans.catalogue import _SHOW, query, shown, table
from jobtide.plans.systems import _said


@query(f"""WITH a AS (SELECT ts AS tm, event_id AS seq, NOT (event_type = 'error' AND event_id % 3 = 0) AS ok, event_type = 'signup' AND value > 60 AS manual,
  CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value / 10) AS BIGINT) END AS n FROM events),
x AS (SELECT *, ok AND n > 0 AS filled, ok AND n > 0 AND NOT manual AS good, NOT (ok AND n > 0) AND NOT manual AS bad FROM a),
y AS (SELECT *, sum(CASE WHEN good THEN 1 ELSE 0 END) OVER w AS island, lag(filled) OVER (ORDER BY tm, seq) AS was,
  last_value(CASE WHEN good THEN n END IGNORE NULLS) OVER w AS last_nonzero_count,
  list_filter(list(CASE WHEN filled THEN n END) OVER (ORDER BY tm, seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), lambda q: q IS NOT NULL) AS recent
  FROM x WINDOW w AS (ORDER BY tm, seq ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, list_sort(recent[greatest(len(recent) - 9, 1):]) AS srt FROM y),
z AS (SELECT *, CASE WHEN good THEN (srt[(len(srt) + 1) // 2] + srt[len(srt) // 2 + 1]) // 2 END AS base, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER i AS streak,
  min(CASE WHEN bad THEN tm END) OVER i AS first_zero, max(CASE WHEN bad THEN tm END) OVER i + INTERVAL 1 DAY AS flagged
  FROM b WINDOW i AS (PARTITION BY island ORDER BY tm, seq ROWS UNBOUNDED PRECEDING)),
o AS (SELECT *, CASE WHEN manual THEN NULL WHEN good THEN 'normal' WHEN coalesce(last_nonzero_count, 0) >= 3 THEN
  CASE WHEN tm - first_zero <= INTERVAL 24 HOURS AND streak >= 5 THEN 'down' ELSE 'suspect' END WHEN streak >= 2 THEN 'suspect' ELSE 'normal' END AS own FROM z),
v AS (SELECT *, last_value(base IGNORE NULLS) OVER w AS baseline, last_value(own IGNORE NULLS) OVER w AS held FROM o WINDOW w AS (ORDER BY tm, seq ROWS UNBOUNDED PRECEDING))
SELECT seq, CAST(streak AS BIGINT) AS streak, strftime(first_zero, {_SHOW}) AS first_zero_at, strftime(flagged, {_SHOW}) AS flagged_until,
  CAST(last_nonzero_count AS BIGINT) AS last_nonzero_count, CAST(baseline AS INTEGER) AS baseline,
  CASE WHEN manual THEN CASE WHEN held = 'down' THEN 'down' ELSE 'suspect' END ELSE own END AS status,
  CASE WHEN manual THEN 'MANUAL' WHEN good THEN 'NONE' WHEN coalesce(was, false) AND n = 0 THEN 'ZERO_SPIKE' ELSE 'EMPTY_STREAK' END AS reason FROM v""")
def health_one_board(spark, sf_dir):
    """H1 to H7, WIN-5 to WIN-7: all events as the log of one board, some under an override, replayed in six-hour buckets."""
    failed = (F.col("event_type") == "error") & (F.col("event_id") % 3 == 0)
    n = F.when(F.col("event_type") == "error", 0).otherwise(F.floor(F.col("value") / 10)).cast("long")
    log = table(spark, sf_dir, "events").select(
        F.lit(0).alias("board"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), (~failed).alias("ok"), n.alias("n"),
        ((F.col("event_type") == "signup") & (F.col("value") > 60)).alias("manual"),
    )
    return health_scan.states(log, width_seconds=6 * 3600).select(
        "seq", F.col("streak").cast("long").alias("streak"), shown("first_zero_at").alias("first_zero_at"), shown("flagged_until").alias("flagged_until"),
        F.col("last_nonzero_count").cast("long").alias("last_nonzero_count"), F.col("baseline").cast("int").alias("baseline"), "status", "reason",
    )


@query(f"""WITH l AS (SELECT event_id, user_id AS k, ts - INTERVAL 9500 DAYS AS tm FROM events),
r AS (SELECT o_custkey % 150 AS k, o_orderdate AS tm, max(o_orderkey) AS o, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1, 2),
j AS (SELECT event_id, l.tm AS tm, r.tm AS since, o, price FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.tm >= r.tm)
SELECT event_id, CASE WHEN tm - since <= INTERVAL 20 DAYS THEN o END AS o_orderkey, CASE WHEN tm - since <= INTERVAL 20 DAYS THEN strftime(since, {_SHOW}) END AS since,
  CASE WHEN tm - since <= INTERVAL 20 DAYS THEN price END AS price FROM j""")
def asof_orders(spark, sf_dir):
    """JOIN-7, WIN-10: for each event the latest order of its user's customers at that time, if it is no older than twenty days."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("k"), (F.col("ts").cast("timestamp") - F.expr("INTERVAL 9500 DAYS")).alias("tm"))
    orders = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 150).alias("k"), F.col("o_orderdate").cast("timestamp").alias("since"), "o_orderkey", F.col("o_totalprice").alias("price")
    )
    found = asof.latest_before(events, orders, ["k"], "tm", "since", "o_orderkey", 20 * 86_400, 30 * 86_400)
    return found.select("event_id", "o_orderkey", shown("since").alias("since"), "price")


_SELECTED = {
    "nav > ul > li a[href]": "len(regexp_extract_all(html, '<li><a href='))", "body h1, footer, div.ad": "len(regexp_extract_all(html, '<h1|<footer|<div class=\"ad\">'))",
    "ul a[href^='/t']": "len(regexp_extract_all(html, '<li><a href=\"/t'))", "a:not([href*=an])": "len(list_filter(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), lambda x: NOT contains(x, 'an')))",
    "head > *, html:not([lang=fr]) nav": "CASE WHEN contains(html, '<html lang=\"fr\">') THEN 0 ELSE 1 END + len(regexp_extract_all(regexp_extract(html, '<head>(.*)</head>', 1), '<(meta|script|link|title|style)'))",
}


@query("WITH p AS (SELECT page_id, html FROM pages) " + " UNION ALL ".join(f"SELECT page_id, {k} AS k, CAST({x} AS BIGINT) AS n FROM p" for k, x in enumerate(_SELECTED.values())))
def selected_nodes(spark, sf_dir):
    """DOM-1, DOM-3: how many nodes of each page some selectors choose."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    nodes = dom.stored(dom.nodes(pages, text_of=()).select(*dom.PAGE, "node_id", "parent_id", "last_desc", "tag", "attrs"))
    every = None
    for k, selector in enumerate(_SELECTED):
        counted = selectors.select(nodes, selector).groupBy("page_id").agg(F.count("*").alias("n"))
        told = pages.select("page_id").join(counted, "page_id", "left").select("page_id", F.lit(k).alias("k"), F.coalesce("n", F.lit(0)).alias("n"))
        every = told if every is None else every.unionByName(told)
    return every


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/job/' AS job, CAST(page_id AS VARCHAR) AS i FROM pages)
SELECT page_id, 1 AS priority, 'J ' || i AS title, job || 'json-' || i AS link FROM p WHERE page_id % 5 = 0
UNION ALL SELECT page_id, 2, 'L ' || i, job || 'list-' || i FROM p WHERE page_id % 5 = 1
UNION ALL SELECT page_id, 2, 'Longest of ' || i, job || 'listed-' || i FROM p WHERE page_id % 5 = 1
UNION ALL SELECT page_id, 3, 'C ' || k || ' ' || i, job || 'card-' || k || '-' || i FROM p, range(3) AS t(k) WHERE page_id % 5 = 2
UNION ALL SELECT page_id, 4, 'S ' || i, job || 'solo-' || i FROM p WHERE page_id % 5 = 3""")
def extractor_priorities(spark, sf_dir):
    """LIM-3, EXT-2 to EXT-4, JOIN-5, STR-6, STR-14, FLT-6: pages that each of the four extractors wins, over the later ones, and pages for none."""
    i = F.col("page_id").cast("string")
    jsonld = _said('<script type="application/ld+json">{"@graph": [{"@type": ["JobPosting"], "title": " J ', i, ' ", "url": "/job/json-', i, '"}]}</script>')
    lists = _said('<ul aria-label="Open positions"><li><a href="/job/list-', i, '">L ', i, '</a></li><li><h3>Of ', i, "</h3><h4>Longest of ", i, '</h4><a href="/job/listed-', i, '">z</a></li></ul>')
    card = lambda k: _said('<p class="vacancy tile"><a href="/job/card-', str(k), "-", i, '"><h3>C ', str(k), " ", i, "</h3></a></p>")
    cards = _said("<section>", card(0), card(1), card(2), "</section>")
    anchor = _said('<div><a href="/job/solo-', i, '">S ', i, '</a><a href="/about">about us</a></div>')
    kind = F.col("page_id") % 5
    html = _said("<body>", *(F.when(kind <= k, part).otherwise("") for k, part in enumerate((jsonld, lists, cards, anchor))), "</body>")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html"))
    return extract.postings(dom.stored(dom.nodes(pages, text_of=extract.TEXT_OF))).select("page_id", "priority", "title", "link")


@query(r"""WITH w AS (SELECT p_name AS s, p_partkey % len(p_name) + 1 AS k FROM part),
a AS (SELECT DISTINCT substr(s, 1, k - 1) || substr(s, k + 1) AS place FROM w UNION SELECT substr(s, 1, k - 1) || substr(s, k + 1, 1) || substr(s, k, 1) || substr(s, k + 2) FROM w WHERE k < len(s)
  UNION SELECT n_name FROM nation UNION SELECT 'district of the ' || s || ' and the harbour' FROM w),
b AS (SELECT DISTINCT p_name AS term FROM part UNION SELECT unnest(string_split(p_name, ' ')) FROM part UNION SELECT replace(n_name, '_', '-') FROM nation UNION SELECT 'district of teh ' || p_name || ' and the harbor' FROM part),
x AS (SELECT place, trim(regexp_replace(lower(place), '[^a-z0-9]+', ' ', 'g')) AS p FROM a), y AS (SELECT term, trim(regexp_replace(lower(term), '[^a-z0-9]+', ' ', 'g')) AS t FROM b)
SELECT place, term FROM x JOIN y ON p <> '' AND t <> '' AND (contains(p, t) OR contains(t, p) OR (abs(len(p) - len(t)) <= 2 AND damerau_levenshtein(p, t) <= 2))""")
def places_by_terms(spark, sf_dir):
    """JOIN-6, FLT-9 with a table of terms: names of parts with a letter lost or two swapped, against names and their words."""
    part, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    s, k = F.col("p_name"), (F.col("p_partkey") % F.length("p_name") + 1).cast("int")
    lost = F.concat(F.substring(s, F.lit(1), k - 1), F.substring(s, k + 1, F.length(s)))
    swapped = F.when(k < F.length(s), F.concat(F.substring(s, F.lit(1), k - 1), F.substring(s, k + 1, F.lit(1)), F.substring(s, k, F.lit(1)), F.substring(s, k + 2, F.length(s))))
    named = part.select(F.explode(F.array(lost, swapped, _said("district of the ", s, " and the harbour"))).alias("place"))
    terms = part.select(F.explode(F.concat(F.array(s, _said("district of teh ", s, " and the harbor")), F.split(s, " "))).alias("term"))
    terms = terms.unionByName(nation.select(F.replace("n_name", F.lit("_"), F.lit("-")).alias("term")))
    return places.matching_table(named.unionByName(nation.select(F.col("n_name").alias("place"))), "place", terms, "term")
