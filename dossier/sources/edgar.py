"""EDGAR: ticker map, filing histories and raw documents, from files or over HTTP.

Payloads are parsed by Spark either way. Documents are fetched by the tasks of a plan;
the request budget is divided among them, so that all together stay below it.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.pylike import archive_path, filing_url, hash_id, pad_cik
from dossier.operators.cleaning import decode_utf8

TICKERS = "map<string,struct<cik_str:string,ticker:string,title:string>>"
SUBMISSIONS = "struct<filings:struct<recent:struct<accessionNumber:array<string>,form:array<string>,filingDate:array<string>,reportDate:array<string>,primaryDocument:array<string>>>>"
TICKERS_URL = "https://www.sec.gov/files/company_tickers.json"
SUBMISSIONS_URL = "https://data.sec.gov/submissions/CIK{}.json"


def tickers(payload: DataFrame, column: str = "value") -> DataFrame:
    """seq, cik, ticker, company_name from the ticker map; entries without a CIK are dropped."""
    entries = payload.select(F.posexplode(F.map_entries(F.from_json(column, TICKERS))).alias("seq", "e")).select("seq", "e.value.*")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return entries.where(text("cik_str") != "").select("seq", pad_cik(F.col("cik_str")).alias("cik"), F.upper(text("ticker")).alias("ticker"), text("title").alias("company_name"))


def submissions(payload: DataFrame, first: int = 0, column: str = "value") -> DataFrame:
    """A row per filing of `cik`, from parallel arrays whose shorter ones are null at the end.
    first: at most so many per company (0: all)."""
    recent = F.from_json(column, SUBMISSIONS)["filings"]["recent"]
    arrays = F.arrays_zip(*[F.coalesce(recent[c], F.array().cast("array<string>")).alias(c) for c in ("accessionNumber", "form", "filingDate", "reportDate", "primaryDocument")])
    rows = payload.select("cik", F.posexplode(F.slice(arrays, 1, first) if first > 0 else arrays).alias("pos", "f"))
    rows = rows.where(F.coalesce(F.col("f.accessionNumber"), F.lit("")) != "")
    day = lambda c: F.nullif(F.col(f"f.{c}"), F.lit("")).try_cast("date")
    document = F.nullif(F.col("f.primaryDocument"), F.lit(""))
    cik, accession = pad_cik(F.col("cik")), F.col("f.accessionNumber")
    return rows.select(
        "pos", cik.alias("cik"), accession.alias("accession_number"), F.coalesce("f.form", F.lit("")).alias("form"), day("filingDate").alias("filing_date"), day("reportDate").alias("report_date"),
        document.alias("primary_document"), F.when(document.isNull(), "").otherwise(filing_url(cik, accession, document)).alias("filing_url"),
    )


def company_rows(parsed: DataFrame, as_of: Column) -> DataFrame:
    times = {c: as_of for c in ("first_seen_time", "last_seen_time", "collected_time")}
    return parsed.withColumn("company_id", hash_id("company", F.col("cik"))).withColumns(times)


def filing_rows(parsed: DataFrame, as_of: Column) -> DataFrame:
    return parsed.withColumns({"filing_id": hash_id("filing", F.col("accession_number")), "company_id": hash_id("company", F.col("cik")), "collected_time": as_of})


def read_archive(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """raw_file_path, byte_size, raw (text) of archived documents, by Spark's own file reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return files.select(F.col("path").alias("raw_file_path"), F.col("length").alias("byte_size"), decode_utf8("content").alias("raw"))


class Budget:
    """Calls start at least 1 / rate seconds apart."""

    def __init__(self, rate: float):
        self.gap, self.last = 1 / max(rate, 0.1), 0.0

    def wait(self) -> None:
        time.sleep(max(0.0, self.last + self.gap - time.monotonic()))
        self.last = time.monotonic()


def fetch(url: str, agent: str, budget: Budget) -> bytes:
    from gzip import decompress
    from urllib.request import Request, urlopen

    budget.wait()
    with urlopen(Request(url, headers={"User-Agent": agent, "Accept-Encoding": "gzip"}), timeout=30) as answer:
        body = answer.read()
        return decompress(body) if answer.headers.get("Content-Encoding") == "gzip" else body


def fetch_documents(pending: DataFrame, agent: str, rate: float, parts: int = 1) -> DataFrame:
    """pending (with `url`) and content, error; the budget is shared by `parts` tasks."""
    import pyarrow as pa

    fields = pending.schema.fields

    def run(batches):
        budget = Budget(rate / parts)
        for batch in batches:
            bodies, errors = [], []
            for url in batch.column("url").to_pylist():
                try:
                    bodies.append(fetch(url, agent, budget))
                    errors.append(None)
                except OSError as e:
                    bodies.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bodies, pa.binary()), pa.array(errors, pa.string())], [*(f.name for f in fields), "content", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", content binary, error string"
    return pending.coalesce(parts).mapInArrow(run, schema)


def write_archive(fetched: DataFrame, root: str, day: Column) -> DataFrame:
    """Writes each content under root (a folder all executors share) and returns the manifest:
    accession_number, document_name, raw_file_path, byte_size. Unsafe names are left out."""
    placed = fetched.withColumn("place", archive_path(F.col("accession_number"), day, F.col("document_name"))).where("place is not null and content is not null")

    def run(frames):
        import os

        for pdf in frames:
            paths = []
            for place, content in zip(pdf["place"], pdf["content"], strict=True):
                path = os.path.join(root, place)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path + ".part", "wb") as f:  # a retried task writes the same bytes again
                    f.write(content)
                os.replace(path + ".part", path)
                paths.append(path)
            yield pdf.assign(raw_file_path=paths, byte_size=[len(c) for c in pdf["content"]])[["accession_number", "document_name", "raw_file_path", "byte_size"]]

    return placed.select("accession_number", "document_name", "place", "content").mapInPandas(run, "accession_number string, document_name string, raw_file_path string, byte_size long")
