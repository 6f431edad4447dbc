"""One pass: raw documents to sections, metrics, deals and grades, then four merges."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.catalog import Catalog
from dossier.functions.money import FINANCIALS, FOUND, FOUND_TYPE, find_financials, with_financials
from dossier.functions.pylike import hash_id, py_str
from dossier.functions.textstats import COUNTS, RATIOS, with_metrics
from dossier.operators.cleaning import clean
from dossier.operators.deals import DEAL, DEAL_TYPE, MATCH, find_deals, with_deal_columns
from dossier.operators.grading import SCORES, with_grade
from dossier.operators.sections import SECTIONS, section_rows, split_sections
from dossier.plans.worklists import ungraded
from dossier.session import free_shuffles, written
from dossier.sources.edgar import read_archive


#: Roots of raw documents that one pass reads.
MOST_ARCHIVES = 1000
PARSED = T.StructType([T.StructField("clean_text", T.StringType()), T.StructField("sections", SECTIONS), T.StructField("deals", MATCH), T.StructField("found", FOUND)])


@F.arrow_udf(PARSED)
def parse_filing(raw: pa.Array) -> pa.Array:
    """Clean text, sections, deals and financial statements of a batch, in one trip to Python."""
    texts = [clean(x or "") for x in raw.to_pylist()]
    sections = pa.array([list(split_sections(x).items()) for x in texts], pa.map_(pa.string(), pa.string()))
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), sections, pa.array([find_deals(x) for x in texts], DEAL_TYPE), pa.array([find_financials(x) for x in texts], FOUND_TYPE)], ["clean_text", "sections", "deals", "found"])


# So that the filter on its result isn't pushed below it, which would run it twice.
parse_filing = parse_filing.asNondeterministic()


def enrich(raw: DataFrame) -> DataFrame:
    """raw (with the column raw) with clean_text, sections, deals, all metrics and the grade.
    Documents without text go: they stay ungraded."""
    rest = [c for c in raw.columns if c != "raw"]
    df = raw.withColumn("__p", parse_filing("raw")).where("__p.clean_text <> ''").select(*rest, "__p.*")
    df = with_financials(with_metrics(df, "clean_text"), sections="sections", found="found")
    return with_grade(df, F.map_keys("sections"))


def enriched(raw: DataFrame) -> DataFrame:
    """What store() needs of enrich(raw). A table, not a cache: four merges read it, and it survives
    lost executors. The whole text isn't in it: its sections hold what is stored of it."""
    done = written(enrich(raw).drop("clean_text"), "enriched", "zstd")
    free_shuffles(done.sparkSession)
    return done


def metric_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """A row per metric: metric_name, metric_value, text_value. A count is a whole number in
    text_value; an amount that didn't parse reads None; what a filing doesn't say has no row."""
    each = [(c, F.col(c).cast("double"), F.col(c).cast("string"), F.lit(True)) for c in COUNTS]
    each += [(c, F.col(c), py_str(F.col(c)), F.lit(True)) for c in RATIOS]
    beside = {"revenue_usd": "revenue_text", "net_income_usd": "net_income_text"}
    for c in FINANCIALS:
        number = c.endswith("_usd") or c == "eps_diluted"
        there = F.col(beside[c]).isNotNull() if c in beside else F.col(c).isNotNull()
        each.append((c, F.col(c), py_str(F.col(c)), there) if number else (c, F.lit(None).cast("double"), F.col(c), there))
    items = F.array(*[F.when(there, F.struct(F.lit(c).alias("metric_name"), v.alias("metric_value"), t.alias("text_value"))) for c, v, t, there in each])
    return df.select(*keys, F.explode(F.array_compact(items)).alias("m")).select(*keys, "m.*")


def run_grading_pass(catalog: Catalog, as_of: Column, most: int = 50) -> DataFrame:
    """Grades what has no grade yet and returns the grades of this pass. The grade is
    merged last, so a pass that broke off is simply repeated."""
    catalog.init()
    read = catalog.read
    plain = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")
    todo = written(ungraded(read("filing_documents"), read("filings"), read("companies"), read("filing_grades"), most), "worklist")
    if todo.isEmpty():
        return catalog.spark.createDataFrame([], "ticker string, form string, accession_number string, " + ", ".join(f"{c} {'string' if c in ('overall_grade', 'summary_notes') else 'double'}" for c in SCORES))
    # The documents themselves if they are few; else the archives that hold them.
    places = todo.select("raw_file_path") if most > 0 else todo.select(F.regexp_replace("raw_file_path", "/filing_document/.*$", "/filing_document"))
    paths = [r[0] for r in places.distinct().limit(max(most, MOST_ARCHIVES) + 1).collect()]
    if len(paths) > max(most, MOST_ARCHIVES):
        raise ValueError(f"documents lie in over {MOST_ARCHIVES} archives: grade them in passes of `most`")
    files = read_archive(catalog.spark, paths).withColumn("__path", plain(F.col("raw_file_path"))).drop("raw_file_path")
    done = enriched(todo.withColumn("__path", plain(F.col("raw_file_path"))).join(files, "__path").drop("__path"))
    return store(catalog, done, as_of)


def store(catalog: Catalog, done: DataFrame, as_of: Column, run: str | None = None) -> DataFrame:
    """Merges what enrich() made into the four tables. run: names the pass in the journal, which
    holds a pass that is repeated under its name once."""
    acc = F.col("accession_number")
    filing, at = {"filing_id": hash_id("filing", acc)}, ("extracted_at", as_of)
    sections = section_rows(done.select("accession_number", "document_name", "sections"))
    catalog.upsert("filing_sections", sections.withColumn(*at), "document_name", {"section_id": hash_id("section", acc, F.col("section_name")), **filing})
    metrics = metric_rows(done, ["accession_number", "document_name"])
    catalog.upsert("filing_metrics", metrics.withColumn(*at), "document_name", {"metric_id": hash_id("metric", acc, F.col("metric_name")), **filing})
    found = done.select("accession_number", "document_name", F.col("ticker").alias("buyer_ticker"), F.explode("deals").alias("match"))
    deals = with_deal_columns(found).select("accession_number", "document_name", "buyer_ticker", *DEAL)
    catalog.upsert("filing_transactions", deals.withColumn(*at), "document_name", {"transaction_id": hash_id("transaction", acc, F.col("seller_target_name")), **filing})
    grades = done.select("accession_number", "document_name", "cik", "ticker", "form", *SCORES).withColumn("graded_at", as_of)
    n = catalog.upsert("filing_grades", grades, "document_name", {"grade_id": hash_id("grade", acc), **filing})
    journal(catalog, "run_grading_pass", n, as_of, run)
    return done.select("ticker", "form", "accession_number", *SCORES)


def journal(catalog: Catalog, action: str, items: int, as_of: Column, run: str | None = None) -> None:
    row = catalog.spark.range(1).select(F.lit(run or uuid.uuid4().hex[:8]).alias("id"), F.lit(action).alias("action"), F.lit(items).cast("int").alias("items_synced"), F.lit("success").alias("status"), F.lit(None).cast("string").alias("message"), as_of.alias("created_at"))
    catalog.upsert("sync_log", row)
