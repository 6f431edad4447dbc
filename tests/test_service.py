"""Ingest over HTTP from a local server, and the command line."""

import gzip
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from dossier import __main__ as cli
from dossier.catalog import Catalog
from dossier.config import Config
from dossier.functions import fixed
from dossier.sources.edgar import fetch_documents

PAGE = b"<html><body><p title='a>b'>Item 1. Business</p><p>We acquired Widget Works for $ 3 million in cash. Revenue was $ 9 million of it.</p></body></html>"


@pytest.fixture
def site(monkeypatch):
    """A small archive: two companies, one of whose documents can't be had."""
    asked = []
    recent = {"accessionNumber": ["1-24-1", "1-24-2", "1-24-3"], "form": ["10-K", "8-K", "10-Q"], "filingDate": ["2024-01-02", "2024-01-03", "2024-01-04"], "primaryDocument": ["a.htm", "missing.htm", ""]}
    pages = {
        "/tickers": json.dumps({"0": {"cik_str": 1, "ticker": "one", "title": "One"}, "1": {"cik_str": 2, "ticker": "two", "title": "Two"}}).encode(),
        "/CIK0000000001.json": json.dumps({"filings": {"recent": recent}}).encode(), "/archive/1/1241/a.htm": PAGE,
    }

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((time.monotonic(), self.path, self.headers["User-Agent"]))
            body = pages.get(self.path)
            if body is None:
                return self.send_error(404)
            self.send_response(200)
            self.send_header("Content-Encoding", "gzip")
            self.end_headers()
            self.wfile.write(gzip.compress(body))

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    monkeypatch.setattr(cli, "TICKERS_URL", f"{root}/tickers")
    monkeypatch.setattr(cli, "SUBMISSIONS_URL", root + "/CIK{}.json")
    monkeypatch.setattr(fixed, "ARCHIVE_URL", f"{root}/archive")
    yield root, asked, pages
    server.shutdown()


def test_fetches_keep_the_budget_and_go_on_after_failures(spark, site):
    root, asked, _ = site
    urls = [f"{root}/tickers", f"{root}/nothing", "http://127.0.0.1:9/closed", f"{root}/CIK0000000001.json"]
    got = {r.url: r for r in fetch_documents(spark.createDataFrame([(u,) for u in urls], "url string"), "me me@site.org", 4).collect()}
    assert [got[u].error is None for u in urls] == [True, False, False, True]
    assert json.loads(got[urls[0]].content)["0"]["ticker"] == "one"
    times = sorted(t for t, _, _ in asked)
    assert times[-1] - times[0] > 0.6 and all(b - a > 0.1 for a, b in zip(times, times[1:])) and {a for _, _, a in asked} == {"me me@site.org"}


def test_sync_twice_then_the_reports(spark, site, tmp_path, capsys, monkeypatch):
    _, asked, pages = site
    config = Config(str(tmp_path), "me me@site.org", 50)
    catalog = Catalog(spark, f"file://{config.tables}")
    first = cli.sync(catalog, config, 50, 2, 50)
    assert first == {"tickers_synced": 2, "filings_collected": 2, "documents_downloaded": 1, "filings_graded": 1}
    pages["/archive/1/1242/missing.htm"] = PAGE.replace(b"Widget", b"Gadget")
    again = cli.sync(catalog, config, 50, 2, 50)
    assert again == first  # the first document isn't fetched again, the missing one is
    assert sum(p.endswith("/a.htm") for _, p, _ in asked) == 1
    assert catalog.read("filing_documents").count() == 2 and catalog.read("filing_grades").count() == 2
    assert {r.seller_target_name for r in catalog.read("filing_transactions").collect()} == {"Widget Works", "Gadget Works"}
    assert sorted(r.action for r in catalog.read("sync_log").collect()) == sorted(["sync_ticker_map", "run_sync_pass", "run_grading_pass"] * 2)
    monkeypatch.setattr(cli, "local_session", lambda cores: spark)
    monkeypatch.setattr(cli, "Catalog", lambda s, root: Catalog(s, f"file://{root}"))
    for verb, said in (("status", "filing_grades"), ("deals", "Widget Works"), ("grade", "overall_grade")):
        assert cli.main([verb, "--root", str(tmp_path)]) == 0
        assert said in capsys.readouterr().out
    assert cli.main(["show", "ONE", "--root", str(tmp_path)]) == 0
    assert "word_count" in capsys.readouterr().out
    assert cli.main(["no-such-verb"]) == 1
