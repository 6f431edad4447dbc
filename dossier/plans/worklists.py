"""What is still to do, and the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.pylike import falsy


def some_companies(companies: DataFrame, most: int = 0) -> DataFrame:
    """cik of the first `most` companies (0 or less: all)."""
    out = companies.select("cik")
    return out.orderBy("cik").limit(most) if most > 0 else out


def pending_documents(filings: DataFrame, documents: DataFrame, per_company: int = 0) -> DataFrame:
    """Filings with a primary document that was never stored; at most `per_company` of each (0: all)."""
    todo = filings.where("primary_document is not null and primary_document <> ''").join(documents.select("accession_number"), "accession_number", "left_anti")
    todo = todo.select("cik", "accession_number", "primary_document", "form")
    if per_company <= 0:
        return todo
    order = Window.partitionBy("cik").orderBy("accession_number")
    return todo.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= per_company).drop("__n")


def ungraded(documents: DataFrame, filings: DataFrame, companies: DataFrame, grades: DataFrame, most: int = 0) -> DataFrame:
    """Stored documents whose filing has no grade."""
    docs = documents.where("raw_file_path is not null").join(grades.select("accession_number"), "accession_number", "left_anti").select("accession_number", "cik", "raw_file_path", "document_name")
    out = docs.join(filings.select("accession_number", "form", "filing_date"), "accession_number").join(companies.select("cik", "ticker"), "cik", "left")
    out = out.select("accession_number", "cik", falsy(F.col("ticker"), "UNKNOWN").alias("ticker"), falsy(F.col("form"), "UNKNOWN").alias("form"), falsy(F.col("filing_date"), "").alias("filing_date"), "raw_file_path", "document_name")
    return out.orderBy("accession_number", "document_name").limit(most) if most > 0 else out


def top_transactions(transactions: DataFrame, most: int = 50) -> DataFrame:
    """The largest deals; unpriced ones last."""
    order = [F.col("purchase_price_usd").desc_nulls_last(), F.col("accession_number"), F.col("seller_target_name")]
    return transactions.orderBy(*order).limit(most).select("buyer_ticker", "seller_target_name", "transaction_type", "purchase_price_usd", "consideration_type", "accession_number", "context_summary")


def find_graded(grades: DataFrame, target: str, most: int = 5) -> DataFrame:
    """Grades of a ticker, in any case, or of one accession number."""
    hit = grades.where((F.upper("ticker") == F.upper(F.lit(target))) | (F.col("accession_number") == target))
    return hit.orderBy("accession_number").limit(most).select("ticker", "form", "accession_number", "overall_grade", "overall_score", "summary_notes")


def inspect(grades: DataFrame, metrics: DataFrame, transactions: DataFrame, target: str) -> DataFrame:
    """Per graded filing, its metrics and deals, by two joins."""
    hit = find_graded(grades, target)
    said = metrics.where("metric_value is not null or text_value <> ''")
    value = F.coalesce(F.format_number("metric_value", 2), F.col("text_value"))
    m = said.groupBy("accession_number").agg(F.array_sort(F.collect_list(F.struct("metric_name", value.alias("value")))).alias("metrics"))
    price = F.when(F.coalesce("purchase_price_usd", F.lit(0.0)) == 0, "Unspecified Amount").otherwise(F.concat(F.lit("$"), F.format_number("purchase_price_usd", 0)))
    deal = F.struct("seller_target_name", "transaction_type", price.alias("price"), "consideration_type", F.substring("context_summary", 1, 140).alias("details"))
    t = transactions.groupBy("accession_number").agg(F.array_sort(F.collect_list(deal)).alias("deals"))
    return hit.join(m, "accession_number", "left").join(t, "accession_number", "left")


def submissions_first(filings: DataFrame, most: int) -> DataFrame:
    """The first filings of each company's history, newest first."""
    order = Window.partitionBy("cik").orderBy(F.col("filing_date").desc_nulls_last(), "accession_number")
    return filings.withColumn("pos", F.row_number().over(order) - 1).where(F.col("pos") < most)
