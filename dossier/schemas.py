"""The eight tables: columns, natural keys, and what a conflict updates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Table:
    """updates: the columns that a conflict on the key overwrites; none: the old row stays."""

    name: str
    ddl: str
    key: tuple[str, ...]
    updates: tuple[str, ...]

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)


TABLES = {
    t.name: t
    for t in (
        Table("companies", "company_id string, ticker string, company_name string, cik string, first_seen_time timestamp, last_seen_time timestamp, collected_time timestamp", ("cik",), ("ticker", "company_name", "last_seen_time", "collected_time")),
        Table("filings", "filing_id string, company_id string, cik string, accession_number string, form string, filing_date date, report_date date, primary_document string, filing_url string, collected_time timestamp", ("accession_number",), ()),
        Table("filing_documents", "document_id string, filing_id string, company_id string, cik string, accession_number string, form string, document_name string, document_url string, byte_size bigint, raw_file_path string, collected_time timestamp", ("accession_number", "document_name"), ("form", "byte_size", "raw_file_path", "collected_time")),
        Table("sync_log", "id string, action string, items_synced int, status string, message string, created_at timestamp", ("id",), ()),
        Table("filing_sections", "section_id string, filing_id string, accession_number string, section_name string, section_title string, clean_text string, word_count int, extracted_at timestamp", ("accession_number", "section_name"), ()),
        Table("filing_metrics", "metric_id string, filing_id string, accession_number string, metric_name string, metric_value double, text_value string, extracted_at timestamp", ("accession_number", "metric_name"), ("metric_value", "text_value", "extracted_at")),
        Table("filing_grades", "grade_id string, filing_id string, cik string, ticker string, accession_number string, form string, overall_grade string, overall_score double, sentiment_score double, transparency_score double, financial_score double, summary_notes string, graded_at timestamp", ("accession_number",), ("overall_grade", "overall_score", "sentiment_score", "transparency_score", "financial_score", "summary_notes", "graded_at")),
        Table("filing_transactions", "transaction_id string, filing_id string, accession_number string, buyer_ticker string, seller_target_name string, transaction_type string, purchase_price_usd double, consideration_type string, context_summary string, extracted_at timestamp", ("accession_number", "seller_target_name"), ("transaction_type", "purchase_price_usd", "consideration_type", "context_summary", "extracted_at")),
    )
}
