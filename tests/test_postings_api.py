"""The data source against a recorded server: what is asked, in which order, and what becomes of each answer."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from jobtide.sources import postings_api


@pytest.fixture
def server():
    """Two interfaces, /a and /b; /a lacks the site `moved`."""
    asked = []
    cities = ("Berlin", "Paris", "Oslo")
    jobs = [{"id": f"p{i}", "text": f" Job {i} ", "categories": {"location": cities[i % 3], "team": "Data" if i % 2 else "Ops"}} for i in range(120)]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            parts = urlsplit(self.path)
            host, site = parts.path.strip("/").split("/")
            q = parse_qs(parts.query)
            asked.append((host, site, {k: v for k, v in q.items() if k != "mode"}))
            skip, limit = int(q["skip"][0]), int(q["limit"][0])
            hits = [j for j in jobs if j["categories"]["location"] in q.get("location", cities) and j["categories"]["team"] in q.get("team", ["Data", "Ops"])]
            body, status = json.dumps(hits[skip : skip + limit]), 200
            if site == "moved":
                body, status = (body, 200) if host == "b" else ("", 404)
            elif site == "gone":
                status = 500
            elif site == "text":
                body = "<p>no JSON</p>"
            elif site == "loose":  # takes no filter, wraps its list
                body = json.dumps({"data": [{"text": "T", "applyUrl": "http://x/1", "categories": {"location": "Paris"}}, {"text": " "}, 7, {"text": "\ud800", "hostedUrl": "h"}]})
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}", asked
    made.shutdown()


@pytest.fixture
def load(spark, server):
    postings_api.register(spark)

    def run(sites, **options):
        reader = spark.read.format("lever_postings").option("sites", sites).option("base", server[0] + "/a").option("other", server[0] + "/b")
        return reader.options(**options).load()

    return run


def test_filters_reach_the_interface(load, server):
    found = load("acme").where("location IN ('Berlin', 'Paris') AND team = 'Data' AND title LIKE 'Job %'")
    assert {r["title"] for r in found.collect()} == {f"Job {i}" for i in range(120) if i % 3 < 2 and i % 2}
    assert [q for _, _, q in server[1]] == [{"location": ["Berlin", "Paris"], "team": ["Data"], "skip": ["0"], "limit": ["50"]}]


def test_filters_of_one_parameter_all_hold(load, server):
    assert load("acme").where("location IN ('Berlin', 'Paris') AND location IN ('Paris', 'Oslo')").count() == 40
    assert server[1][0][2]["location"] == ["Paris"]
    del server[1][:]
    assert load("acme").where("location = 'Paris' AND team = 'Data' AND location IN ('Oslo')").count() == 0 and not server[1]


def test_site_filter_chooses_calls_and_others_stay(load, server):
    assert load("acme,other, acme,,", sitesPerPartition=1).where("site = 'other' AND (team = 'Ops' OR title = 'Job 1')").count() == 61
    assert {(s, "team" in q) for _, s, q in server[1]} == {("other", False)}


def test_pages_regions_and_errors(load, server):
    rows = load("acme,moved,gone,text,loose", sitesPerPartition=2).collect()
    of = lambda s: [r for r in rows if r["site"] == s]
    assert sorted((r["page_no"], r["pos"]) for r in of("acme")) == [(i // 50, i % 50) for i in range(120)]
    assert of("acme")[0]["link"] == "https://jobs.lever.co/acme/p0" and not any(r["error"] for r in of("acme"))
    assert len(of("moved")) == 120 and [h for h, s, _ in server[1] if s == "moved"] == ["a", "b", "b", "b"]
    assert [(r["error"], r["title"]) for r in of("gone")] == [("Refused", None)]
    assert [(r["error"], r["raw"]) for r in of("text")] == [("ValueError", "<p>no JSON</p>")]
    assert [(r["title"], r["error"]) for r in of("loose")] == [("T", None), (None, "Malformed"), (None, "Malformed"), ("?", None)]
    assert load("loose").where("location = 'Oslo'").count() == 0


def test_a_cut_is_told_and_no_sites_are_no_rows(load):
    rows = load("acme", maxPages=2).collect()
    assert len(rows) == 101 and [r["error"] for r in rows if r["error"]] == ["MorePages"]
    assert load("").count() == 0
    with pytest.raises(Exception, match="maxPages"):
        load("acme", maxPages=0).count()
