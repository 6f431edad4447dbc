"""Command line: status, sync (once), grade (score), transactions (deals, purchases),
inspect (show, view) TARGET, run (service, daemon)."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import functions as F

from dossier.catalog import Catalog
from dossier.config import Config
from dossier.plans import worklists
from dossier.plans.grading_pass import journal, run_grading_pass
from dossier.session import local_session, written
from dossier.sources.edgar import SUBMISSIONS_URL, TICKERS_URL, company_rows, fetch_documents, filing_rows, filing_url, submissions, tickers, write_archive

ALIASES = {"once": "sync", "score": "grade", "deals": "transactions", "purchases": "transactions", "show": "inspect", "view": "inspect", "service": "run", "daemon": "run"}


def sync(catalog: Catalog, config: Config, companies: int, filings: int, documents: int) -> dict[str, int]:
    """One pass: tickers, histories, pending documents, grades. Failed fetches are passed over."""
    catalog.init()
    now, spark = F.current_timestamp(), catalog.spark

    def get(urls):
        return written(fetch_documents(urls, config.user_agent, config.requests_per_second), "fetched")

    body = F.decode("content", "UTF-8").alias("value")
    listed = get(spark.createDataFrame([(TICKERS_URL,)], "url string")).where("content is not null").select(body)
    n_tickers = catalog.upsert("companies", company_rows(tickers(listed), now), "seq")
    journal(catalog, "sync_ticker_map", n_tickers, now)
    who = worklists.some_companies(catalog.read("companies"), companies)
    before, after = SUBMISSIONS_URL.split("{}")
    histories = get(who.withColumn("url", F.concat(F.lit(before), "cik", F.lit(after)))).where("content is not null").select("cik", body)
    n_filings = catalog.upsert("filings", filing_rows(submissions(histories, filings), now), "pos")
    todo = worklists.pending_documents(catalog.read("filings"), catalog.read("filing_documents"), documents).join(who, "cik", "left_semi")
    url = filing_url(F.col("cik"), F.col("accession_number"), F.col("primary_document"))
    fetched = get(todo.withColumn("url", url).withColumnRenamed("primary_document", "document_name"))
    stored = written(write_archive(fetched, config.raw_dir, now), "stored")
    rows = stored.join(fetched.select("accession_number", "cik", "form", F.col("url").alias("document_url")), "accession_number").withColumn("collected_time", now)
    n_documents = catalog.upsert("filing_documents", rows)
    journal(catalog, "run_sync_pass", n_filings + n_documents, now)
    graded = run_grading_pass(catalog, now, 5000).count()
    return {"tickers_synced": n_tickers, "filings_collected": n_filings, "documents_downloaded": n_documents, "filings_graded": graded}


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="dossier")
    parser.add_argument("verb", nargs="?", default="status")
    parser.add_argument("target", nargs="?", default="NVDA")
    parser.add_argument("--root", default="data")
    args = parser.parse_args(argv)
    verb = ALIASES.get(args.verb, args.verb)
    if verb not in ("status", "sync", "grade", "transactions", "inspect", "run"):
        print(f"unknown: {args.verb}", file=sys.stderr)
        return 1
    config = Config.load(args.root)
    catalog = Catalog(local_session("*"), config.tables)
    if verb == "status":
        catalog.init()
        catalog.counts().show(truncate=False)
    elif verb == "sync":
        print(sync(catalog, config, 50, 20, 50))
    elif verb == "grade":
        run_grading_pass(catalog, F.current_timestamp(), 50).show(50, truncate=False)
    elif verb == "transactions":
        worklists.top_transactions(catalog.read("filing_transactions")).show(50, truncate=False)
    elif verb == "inspect":
        worklists.inspect(catalog.read("filing_grades"), catalog.read("filing_metrics"), catalog.read("filing_transactions"), args.target).show(5, truncate=False, vertical=True)
    else:
        while True:
            try:
                print(sync(catalog, config, 0, 100, 50))
            except Exception as e:  # the service goes on after any failure
                print(f"pass failed: {e}", file=sys.stderr)
            time.sleep(60)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
