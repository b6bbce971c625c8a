"""The search source: what is pushed down, what is read, and a service over HTTP."""

import http.server
import json
import threading
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from spindrift.sources import search


def results():
    return [("alert" if i % 3 else "report", f"2024-{i % 12 + 1:02d}-{i % 28 + 1:02d}", f"2024-{i % 12 + 1:02d}-{i % 28 + 1:02d}T10:00:00Z", f"/{'drugs' if i % 2 else 'news'}/{i}", f"Title {i}") for i in range(400)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    search.register(spark)
    rows = [*results(), (None, "2024-05-05", "2024-05-05", "/drugs/none", ""), ("alert", None, None, "/drugs/undated", ""), ("alert", "", "", "/x", "")]
    return search.store(spark.createDataFrame(rows, search.SCHEMA), f"file://{tmp_path_factory.mktemp('search')}/r")


def load(spark, **options):
    return spark.read.format(search.NAME).options(**options).load()


WHERE = "document_type = 'alert' and published_date >= '2024-03-10' and published_date < '2024-06-02' and link like '/drugs/%'"


def wanted():
    return sorted(r for r in results() if r[0] == "alert" and "2024-03-10" <= r[1] < "2024-06-02" and r[3].startswith("/drugs/"))


def test_filters_reach_the_source(spark, stored, capsys):
    df = load(spark, path=stored).where(WHERE)
    assert sorted(tuple(r) for r in df.collect()) == wanted()
    df.explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    for x in ("EqualTo(document_type,alert)", "GreaterThanOrEqual(published_date,2024-03-10)", "LessThan(published_date,2024-06-02)", "StringStartsWith(link,/drugs/)"):
        assert x in pushed
    # four months of twelve are opened, a task each
    assert df.rdd.getNumPartitions() == 4
    assert load(spark, path=stored).rdd.getNumPartitions() == 12


@pytest.mark.parametrize("where", ["document_type in ('report', 'other')", "published_date = '2024-02-14'", "published_date > '2024-12-31'", "published_date < '0001-01-01'", "document_type is null", "document_type = 'alert' and document_type = 'report'", "title = 'Title 7'", "length(link) = 8", "published_date >= '2024'", "document_type <> 'alert'", "published_date > '2024-06-30' or document_type = 'report'"])
def test_any_filter_is_right(spark, stored, where):
    plain = spark.createDataFrame([*results(), (None, "2024-05-05", "2024-05-05", "/drugs/none", "")], search.SCHEMA).where(where)
    assert sorted(map(str, load(spark, path=stored).where(where).collect())) == sorted(map(str, plain.collect()))


def test_count_is_taken_at_the_source(spark, stored):
    got = search.oldest(spark, F.col("document_type") == "alert", 7, path=stored)
    assert [tuple(r) for r in got.collect()] == sorted((r for r in results() if r[0] == "alert"), key=lambda r: (r[1], r[3]))[:7]
    assert load(spark, path=stored, count="2").count() == 24
    # a filter that the source can't apply switches its count off
    assert [r.title for r in search.oldest(spark, F.col("title") == "Title 7", 1, path=stored).collect()] == ["Title 7"]


class Handler(http.server.BaseHTTPRequestHandler):
    asked: list = []

    def do_GET(self):
        q = parse_qs(urlparse(self.path).query)
        Handler.asked.append(q)
        a, b = (x.split(":", 1)[1] for x in q["filter_public_timestamp"][0].split(","))
        rows = sorted((r for r in results() if a <= r[1] <= b and r[0] in q.get("filter_content_store_document_type", [r[0]])), key=lambda r: (r[2], r[3]))
        start = int(q["start"][0])
        body = json.dumps({"results": [{"link": r[3], "public_timestamp": r[2], "title": r[4] + " ", "content_store_document_type": r[0]} for r in rows[start : start + int(q["count"][0])]]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_service(spark, stored, monkeypatch):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        api = f"http://127.0.0.1:{server.server_port}/search.json"
        df = load(spark, api=api, splits="3").where(WHERE)
        assert sorted(tuple(r) for r in df.collect()) == wanted()
        spans = sorted(q["filter_public_timestamp"][0] for q in Handler.asked)
        assert len(spans) == 3 and spans[0].startswith("from:2024-03-10") and spans[-1].endswith("to:2024-06-01")
        assert all(q["filter_content_store_document_type"] == ["alert"] for q in Handler.asked)
        got = search.oldest(spark, F.col("published_date") >= "2024-03-01", 3, api=api)
        assert [r.link for r in got.collect()] == [r[3] for r in sorted((r for r in results() if r[1] >= "2024-03-01"), key=lambda r: (r[1], r[3]))[:3]]
    finally:
        server.shutdown()


def test_neither_path_nor_service(spark, stored):
    with pytest.raises(Exception, match="give the option path or api"):
        load(spark).count()
