"""URL functions (URL-1 to URL-14) as Column expressions.

Queries are cut on the first ? and # by regular expressions, since the JVM's strict URI parser rejects URLs that a
browser accepts. Only RFC 3986 resolution of odd relative references needs Python, and then in Arrow batches.
"""

from __future__ import annotations

import html
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values. Query keys that do not tell postings apart, compared with lower-cased keys: the camel-case names
# therefore never match, which keeps identities stable.
IGNORED_KEYS = (
    "page", "start", "offset",
    "ref", "referral", "src", "source",
    "gh_src", "gh_jid",
    "_gl", "_ga", "_gac",
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "locations", "location", "locationHierarchy1", "locationHierarchy2",
    "locationCity", "locationState", "lat", "lng",
)
# Fixed values. Keys dropped from a list page's identity if their last value is 1 or 0.
ONE_KEYS = ("page", "pg", "p", "pageNumber")
ZERO_KEYS = ("start", "offset", "from", "startrow")
# Fixed values. Hosts of applicant-tracking systems.
TRACKING_HOSTS = (
    r"(?:^|\.)jobs\.lever\.co$",
    r"(?:^|\.)boards\.greenhouse\.io$",
    r"(?:^|\.)smartrecruiters\.com$",
    r"(?:^|\.)workable\.com$",
    r"(?:^|\.)jobvite\.com$",
    r"(?:^|\.)ashbyhq\.com$",
    r"(?:^|\.)(?:[a-z0-9-]+\.wd\d+\.)?myworkdayjobs\.com$",
)
# Fixed values. Shapes of the paths of posting pages.
DETAIL_PATHS = (
    r"(^|/)(?:[a-z]{2}-[a-z]{2}/)?details/\d{6,}(?:-\d+)?(?:/|$)",
    r"(^|/)(?:app/)?[a-z]{2}-[a-z]{2}/apply/\d{6,}(?:-\d+)?(?:/|$)",
    r"(^|/)jobs?/results?/\d",
    r"(^|/)careers?/.*/\d",
    r"(^|/)positions?/\d",
    r"(^|/)vacanc(?:y|ies)/\d",
    r"(^|/)job/[^/]+/[^/]+_(?:JR|R|REQ)[-_]?\d{4,}(?:-\d+)?(?:/|$)",
    r"(^|/)(?:[a-z]{2}(?:-[a-z]{2})?/)?sites?/jobsearch/job/\d{4,}(?:/|$|\?)",
    r"(^|/)wday/(?:jobs|cxs)/[^/]+/[^/]+/job/[^/]+_(?:JR|R|REQ)[-_]?\d{4,}(?:-\d+)?(?:/|$)",
    r"(^|/)(?:[a-z]{2}(?:-[a-z]{2})?/)?job/[\w-]{6,}(?:/|$)",
)
# Fixed values. Path segments that no posting page has.
OTHER_SEGMENTS = (
    "saved", "alerts", "recommendations", "dashboard", "signin", "sign-in",
    "login", "help", "support", "about", "privacy", "terms", "eeo",
    "how-we-hire", "legal", "saved jobs", "saved-jobs",
)
# Fixed values. Path segments of posting pages on the hosts above.
JOB_SEGMENTS = ("j", "job", "jobs", "openings")
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
# Fixed values. Adapters in order of precedence: name, pattern of the host, pattern of the path.
ADAPTERS = (
    ("lever", r"^(?:www\.)?jobs(?:\.eu)?\.lever\.co(?::\d+)?$", None),
    ("meta", r"(?:^|\.)(?:metacareers|facebookcareers)\.com$", None),
    ("microsoft", r"(^|\.)careers\.microsoft\.com$", None),
    ("proton", r"(^|\.)job-boards\.eu\.greenhouse\.io$", r"^/proton(?:/|$)"),
    ("workday", r"(?:^|\.)(?:[\w-]+\.wd\d+\.myworkdayjobs\.com|wd\d+\.myworkdaysite\.com)$", None),
    ("join", r"(?:^|\.)join\.com$", None),
    ("greenhouse", r"(?:^|\.)(?:job-boards\.greenhouse\.io|boards\.greenhouse\.io)$", None),
    ("ashby", r"(?:^|\.)jobs\.ashbyhq\.com$", None),
)
# Fixed values. Ids of requisitions, and the paths of three systems' posting pages.
REQUISITION = r"\b((?:JR|R|REQ)[-_]?\d{4,8}(?:-\d+)?)\b"
GREENHOUSE_PATH = r"/jobs/(\d+)(?:/|$)"
ASHBY_PATH = rf"/[^/]+/({UUID})(?:/|$)"
JOIN_PATH = r"^/companies/[^/]+/\d{5,}-[A-Za-z0-9-]+/?$"


def head(url) -> Column:
    """Scheme, host and path."""
    return F.regexp_extract(url, r"^([^?#]*)", 1)


def query(url) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def fragment(url) -> Column:
    return F.regexp_extract(url, r"#(.*)$", 1)


def host(url) -> Column:
    """Host with port and user, as written; empty without //."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path(url) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def segments(url_path) -> Column:
    """ARR-1: path segments without empty ones."""
    return F.filter(F.split(url_path, "/"), lambda s: s != "")


def _decoded(x) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def quoted(x, space: str) -> Column:
    """Percent-encoding that leaves letters, digits and _.-~ bare."""
    encoded = F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return encoded if space == "+" else F.replace(encoded, F.lit("+"), F.lit(space))


def pairs(url) -> Column:
    """Decoded (key, value) pairs of the query in order; blank values are kept."""
    parts = F.filter(F.split(query(url), "&"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            _decoded(F.substring_index(p, "=", 1)).alias("k"),
            F.when(p.contains("="), _decoded(F.regexp_replace(p, r"^[^=]*=", ""))).otherwise("").alias("v"),
        ),
    )


def _assembled(front, kept, url, space: str) -> Column:
    text = F.array_join(F.transform(kept, lambda p: F.concat(quoted(p["k"], space), F.lit("="), quoted(p["v"], space))), "&")
    return F.concat(
        front,
        F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""),
        F.when(fragment(url) != "", F.concat(F.lit("#"), fragment(url))).otherwise(""),
    )


def canonical(url) -> Column:
    """URL-3: repeated /jobs/results collapsed, ignored keys dropped, pairs sorted, re-encoded with + for space."""
    front = F.regexp_replace(head(url), r"/jobs/results(?:/jobs/results)+(?![^/])", "/jobs/results")
    kept = F.array_sort(F.filter(pairs(url), lambda p: ~F.lower(p["k"]).isin(*IGNORED_KEYS)))
    return _assembled(front, kept, url, "+")


def page_identity(url) -> Column:
    """URL-4: first-page and zero-offset keys dropped by their last value, keys sorted, values in order."""
    found = pairs(url)

    def stays(p):
        own = F.filter(found, lambda q: q["k"] == p["k"])
        last = F.try_element_at(own, F.lit(-1))["v"]
        return ~((p["k"].isin(*ONE_KEYS) & (last == "1")) | (p["k"].isin(*ZERO_KEYS) & (last == "0")))

    placed = F.transform(F.filter(found, stays), lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["v"].alias("v")))
    return _assembled(head(url), F.array_sort(placed), url, "%20")


def with_param(url, key, value) -> Column:
    """URL-5: the key set (where it stood first, or last if it is new); of repeated keys the last value stays."""
    found = pairs(url)
    key, value = (x if isinstance(x, Column) else F.lit(x) for x in (key, value))
    several = F.transform(found, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i")))
    first = F.filter(several, lambda p: F.size(F.filter(several, lambda q: (q["k"] == p["k"]) & (q["i"] < p["i"]))) == 0)
    latest = F.transform(
        first,
        lambda p: F.struct(
            p["k"].alias("k"),
            F.when(p["k"] == key, value.cast("string"))
            .otherwise(F.try_element_at(F.filter(found, lambda q: q["k"] == p["k"]), F.lit(-1))["v"]).alias("v"),
        ),
    )
    added = F.array(F.struct(key.alias("k"), value.cast("string").alias("v")))
    kept = F.when(F.exists(latest, lambda p: p["k"] == key), latest).otherwise(F.concat(latest, added))
    return _assembled(head(url), kept, url, "+")


def page_url(url, key: str, page) -> Column:
    """URL-6: the key set to a page; other keys keep all their values, gathered where each key stood first; %20 for space."""
    found = F.transform(pairs(url), lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i")))
    page = (page if isinstance(page, Column) else F.lit(page)).cast("string")

    def place(p):
        return F.array_min(F.transform(F.filter(found, lambda q: q["k"] == p["k"]), lambda q: q["i"]))

    rows = F.transform(found, lambda p: F.struct(place(p).alias("at"), p["i"].alias("i"), p["k"].alias("k"), F.when(p["k"] == key, page).otherwise(p["v"]).alias("v")))
    rows = F.array_sort(F.filter(rows, lambda p: (p["k"] != key) | (p["at"] == p["i"])))
    own = F.transform(rows, lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v")))
    added = F.array(F.struct(F.lit(key).alias("k"), page.alias("v")))
    kept = F.when(F.exists(own, lambda p: p["k"] == key), own).otherwise(F.concat(own, added))
    return _assembled(head(url), kept, url, "%20")


@F.pandas_udf(T.StringType())
def _joined(base: pd.Series, ref: pd.Series) -> pd.Series:
    def one(b, r):
        try:
            return None if r is None or b is None else urljoin(b, r)
        except ValueError:
            return None

    return pd.Series([one(b, r) for b, r in zip(base, ref, strict=True)], dtype=object)


def absolute(ref, base) -> Column:
    """URL-1: RFC 3986 resolution; the usual forms stay in the JVM."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    plain = ~ref.rlike(r"(^|/)\.{1,2}(/|$|[?#])")
    return (
        F.when(ref.isNull() | base.isNull(), F.lit(None))
        .when(plain & ref.rlike(r"^https?://[^/?#]+(/[^?#]*)?([?#].+)?$"), ref)
        .when(plain & (root != "") & ref.rlike(r"^//[^/?#]+/"), F.concat(scheme, ref))
        .when(plain & (root != "") & ref.rlike(r"^/($|[^/])") & ~ref.rlike(r"[?#]$"), F.concat(root, ref))
        .otherwise(_joined(base, ref))
    )


def is_http(url) -> Column:
    """URL-2."""
    refused = url.isNull() | (url == "") | url.rlike(r"^(?:mailto:|tel:|javascript:)")
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return ~refused & (scheme.isin("http", "https") | ((scheme == "") & (path(url) != "")))


def _any(patterns) -> str:
    return "(?iU)" + "|".join(f"(?:{p})" for p in patterns)


def on_tracking_host(url_host) -> Column:
    """URL-8."""
    return url_host.rlike("(?i)" + "|".join(f"(?:{p})" for p in TRACKING_HOSTS))


def is_detail(url) -> Column:
    """URL-7: whether an absolute URL looks like a posting's page."""
    own, parts = path(url), segments(path(url))
    leaf = F.try_element_at(parts, F.lit(-1))
    system = on_tracking_host(host(url)) & (
        ((F.size(parts) >= 2) & leaf.rlike(rf"^(?:{UUID}|\d+)$")) | F.arrays_overlap(parts, F.array(*map(F.lit, JOB_SEGMENTS)))
    )
    named = (
        own.contains("job") & ~F.lower(url).contains("page=")
        & ~F.arrays_overlap(parts, F.array(*map(F.lit, OTHER_SEGMENTS))) & own.rlike(r"(?U)/job[s]?/[\w-]{4,}(/|$)")
    )
    shaped = F.when(own == "", "/").otherwise(own).rlike(_any(DETAIL_PATHS))
    return F.coalesce(url.rlike(r"^(?i:https?)://[^/?#]+") & (shaped | system | named), F.lit(False))


def adapter(url) -> Column:
    """JOIN-4: the first adapter that matches, or generic."""
    found = F.lit("generic")
    for name, of_host, of_path in reversed(ADAPTERS):
        matches = host(url).rlike("(?i)" + of_host)
        if of_path:
            matches = matches & path(url).rlike(of_path)
        found = F.when(matches, name).otherwise(found)
    return found


def details_url(url) -> Column:
    """URL-9: /job/<location>/ becomes /details/, unless a segment is `details` already."""
    front = F.regexp_extract(url, r"^((?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?)", 1)
    parts = segments(path(url))
    at = F.array_position(parts, "job").cast("int")
    moved = F.concat(F.slice(parts, F.lit(1), F.greatest(at - 1, F.lit(0))), F.array(F.lit("details")),
                     F.slice(parts, at + 2, F.greatest(F.size(parts) - at - 1, F.lit(0))))
    tail = F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    change = ~F.array_contains(parts, "details") & (at > 0) & (at < F.size(parts))
    return F.when(change, F.concat(front, F.lit("/"), F.array_join(moved, "/"), tail)).otherwise(url)


def api_host(url_host) -> Column:
    """URL-10."""
    return F.when(F.lower(url_host).endswith("jobs.eu.lever.co"), "api.eu.lever.co").otherwise("api.lever.co")


def posting_link(ref, base, of_host: str, of_path: str) -> Column:
    """URL-11: unescaped, absolute, without query, fragment and last slash; null off the host or the path's shape."""
    whole = absolute(unescaped(ref), base)
    bare = F.regexp_replace(F.lower(host(whole)), r":.*$", "")
    good = bare.rlike("(?i)" + of_host) & path(whole).rlike(of_path)
    return F.when(good, F.regexp_replace(head(whole), r"/+$", ""))


def greenhouse_link(ref, base) -> Column:
    return posting_link(ref, base, ADAPTERS[6][1], GREENHOUSE_PATH)


def ashby_link(ref, base) -> Column:
    return posting_link(ref, base, ADAPTERS[7][1], ASHBY_PATH)


def join_link(ref, base) -> Column:
    return posting_link(ref, base, ADAPTERS[5][1], JOIN_PATH)


@F.pandas_udf(T.StringType())
def _unescaped(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else html.unescape(s))


def unescaped(x) -> Column:
    """STR-18; the entities that occur in links stay in the JVM."""
    plain = x
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(character))
    other = x.rlike(r"&(?!(?:lt|gt|quot|#39|#x27|amp);)[#A-Za-z]\w*;")
    return F.when(other, _unescaped(F.when(other, x))).otherwise(plain)


def _extracted(x, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, 1), F.lit(""))


def greenhouse_id(url) -> Column:
    return _extracted(path(url), GREENHOUSE_PATH)


def ashby_id(url) -> Column:
    return _extracted(path(url), ASHBY_PATH)


def requisition_id(text) -> Column:
    return _extracted(text, "(?iU)" + REQUISITION)


def org_slug(url) -> Column:
    return F.get(segments(path(url)), 0)


def job_item_id(label, others) -> Column:
    """URL-12, DT-10: the id after `Job item`, else of digit runs the best: 6 to 8 digits, then shortest, then first."""
    runs = F.flatten(F.transform(others, lambda v: F.regexp_extract_all(v, F.lit(r"(\d{6,})"), 1)))
    ranked = F.transform(
        runs, lambda d, i: F.struct((F.length(d) > 8).cast("int").alias("l"), F.length(d).alias("n"), i.alias("i"), d.alias("d"))
    )
    return F.coalesce(_extracted(label, r"(?iU)\bJob item\s+(\d{6,})\b"), F.get(F.array_sort(ranked), 0)["d"])


def microsoft_slug(title) -> Column:
    """URL-13: white space off both ends, spaces to -, everything outside A-Z a-z 0-9 - . _ ~ percent-encoded, nothing collapsed."""
    bare = F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)^\s+|\s+$", "")
    encoded = F.url_encode(F.replace(bare, F.lit(" "), F.lit("-")))
    for plain, code in (("*", "%2A"), ("+", "%20")):
        encoded = F.replace(encoded, F.lit(plain), F.lit(code))
    return F.replace(encoded, F.lit("%7E"), F.lit("~"))


def proton_list(url) -> Column:
    """URL-14: the board's fixed list page."""
    return F.concat(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit("/proton"))
