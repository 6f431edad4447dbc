"""Filing-like tables made from the benchmark tables, in SQL that Spark and DuckDB share.

{s} is the engine's string type. Each view may use the earlier ones.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from dossier.session import spread

VIEWS = {
    "companies": """select lpad(cast(c_custkey as {s}), 10, '0') as cik, upper(concat('t', cast(c_custkey as {s}))) as ticker, c_name as company_name from customer""",
    "filings": """select concat(lpad(cast(o_custkey as {s}), 10, '0'), '-', substring(cast(cast(o_orderdate as date) as {s}), 3, 2), '-', lpad(cast(o_orderkey as {s}), 6, '0')) as accession_number,
        lpad(cast(o_custkey as {s}), 10, '0') as cik,
        case substring(o_orderpriority, 1, 1) when '1' then '10-K' when '2' then '10-Q' when '3' then '8-K' when '4' then 'S-1' else '' end as form,
        cast(o_orderdate as date) as filing_date, case when o_orderkey % 11 = 0 then '' else concat('doc', cast(o_orderkey % 7 as {s}), '.htm') end as primary_document, o_orderkey, o_totalprice from orders""",
    "filing_documents": """select accession_number, cik, case when o_orderkey % 4 = 1 then '' when o_orderkey % 4 = 2 then cast(null as {s}) else form end as form, primary_document as document_name,
        case when o_orderkey % 13 = 0 then cast(null as {s}) else concat('/raw/', accession_number) end as raw_file_path, o_orderkey from filings where o_orderkey % 3 <> 0""",
    "filing_grades": """select accession_number, cik, concat('T', cast(o_orderkey % 97 as {s})) as ticker, form, case when o_orderkey % 2 = 0 then 'A' else 'C+' end as overall_grade, cast(o_orderkey % 100 as double) as overall_score from filing_documents where o_orderkey % 5 = 0""",
    "filing_text": """select accession_number, o_orderkey, concat('Cover page', chr(10), 'Item 1. Business', chr(10), 'We sell goods and our growth is strong.', chr(10),
        'Item 1A. Risk Factors', chr(10), 'Litigation claims and uncertainty may adversely affect us.', chr(10), 'Item 7. Management''s Discussion and Analysis', chr(10),
        case when o_orderkey % 4 = 0 then 'Sales were flat.' else concat('Total net revenues were $ ', cast(cast(o_totalprice as decimal(12,2)) as {s}), case o_orderkey % 3 when 0 then ' million' when 1 then ' billion' else '' end, '.') end, chr(10),
        case when o_orderkey % 6 = 0 then concat('Diluted earnings per share were $', cast(o_orderkey % 9 as {s}), '.', cast(o_orderkey % 10 as {s}), '5. ') else '' end,
        case when o_orderkey % 7 = 0 then concat('Cash and cash equivalents of $', cast(o_orderkey % 500 as {s}), '.5 million ') else '' end,
        'Net loss of $', cast(o_orderkey % 1000 as {s}), ',', lpad(cast(o_orderkey % 997 as {s}), 3, '0'), '. ',
        'We acquired Target', cast(o_orderkey % 50 as {s}), ' Corp for $ ', cast(o_orderkey % 90 + 1 as {s}), ' million in cash. ', case when o_orderkey % 5 = 0 then 'Appointment of directors followed.' else 'Nothing followed.' end) as text from filings""",
    "filing_transactions": """select accession_number, concat('T', cast(o_orderkey % 31 as {s})) as buyer_ticker, concat('Target', cast(o_orderkey % 50 as {s}), ' Corp') as seller_target_name, 'Acquisition' as transaction_type,
        case when o_orderkey % 6 = 0 then cast(null as double) else o_totalprice end as purchase_price_usd, 'Cash' as consideration_type, concat('context ', cast(o_orderkey as {s})) as context_summary from filings""",
    "doc_lexicon": """select doc_id, concat(text, case doc_id % 5 when 0 then ' Growth was strong and uncertainty fell. Write-off!' when 1 then ' A lawsuit and penalties may arise; losses declined.' when 2 then ' Record gains? Improved.' when 3 then ' The company''s subpoena is pending.' else '' end) as text from documents""",
    "deal_text": """select p_partkey, p_size, concat('In 2024 the firm said that ', case p_partkey % 5
        when 0 then concat('it acquired Alpha', cast(p_size as {s}), ' Corp for $ ', cast(p_size as {s}), '.5 million in cash. ')
        when 1 then concat('it entered into a definitive agreement with Beta', cast(p_size as {s}), ' Inc for $', cast(p_size as {s}), ' billion in stock. ')
        when 2 then concat('it completed the acquisition of Gamma', cast(p_size as {s}), ', paid in cash and shares. ')
        when 3 then concat('it procured new chips from Delta', cast(p_size as {s}), ', totaling $', cast(p_size as {s}), ',000. ')
        else concat('a vendor agreement with Omega', cast(p_size as {s}), ', worth $ ', cast(p_size as {s}), ' thousand. ') end, 'More to come.') as text from part""",
}
BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _needs(sql: str) -> list[str]:
    return [t for t in [*BASE, *VIEWS] if re.search(rf"\bfrom {t}\b|\bjoin {t}\b", sql)]


#: Views whose texts cost far more to work on than to read.
TEXTS = {"documents", "pages", "filing_text", "doc_lexicon", "deal_text"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, or a fixture view over them, on all cores if it has texts."""
    df = _view(spark, sf_dir, name)
    return spread(df) if name in TEXTS else df


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return query(spark, sf_dir, VIEWS[name])


def query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = _needs(sql)
    text = sql.replace("{s}", "string")
    for n in names:
        text = re.sub(rf"\b(from|join) {n}\b", rf"\1 {{{n}}} as {n}", text)
    return spark.sql(text, **{n: _view(spark, sf_dir, n) for n in names})


def oracle(sql: str) -> str:
    """sql for DuckDB, with the views that it needs before it."""
    need: list[str] = []

    def add(text: str) -> None:
        for n in _needs(text):
            if n in VIEWS and n not in need:
                add(VIEWS[n])
                need.append(n)

    add(sql)
    views = ", ".join(f"{n} as ({VIEWS[n]})" for n in need).replace("{s}", "varchar")
    sql = sql.strip().replace("{s}", "varchar")
    if not need:
        return sql
    if sql.startswith("with "):
        return f"with {views}, {sql[5:]}"
    return f"with {views} {sql}"
