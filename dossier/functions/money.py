"""Dollar amounts, financial line items and events. Whole texts are searched in one trip to
Python; amounts are parsed from what was found, JVM-side."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions import fixed
from dossier.functions.pylike import strip
from dossier.functions.search import Finder, lowered

#: Case-insensitive, Unicode classes, and a dot that excludes line feeds only.
FLAGS = "(?iUd)"
FINANCIALS = ["revenue_text", "revenue_usd", "net_income_text", "net_income_usd", "eps_diluted", "cash_and_equivalents_usd", "executive_event_summary", "business_description_sample"]


def _first(text: Column, pattern: str, group: int) -> Column:
    """The group of the first match; null without a match."""
    return F.when(F.regexp_like(text, F.lit(FLAGS + pattern)), F.regexp_extract(text, FLAGS + pattern, group))


def dollars(snippet: Column, trim_dots: bool) -> Column:
    """The first amount of a snippet. trim_dots: whether dots
    at its end are dropped first (deals) or left to the number parser (financials)."""
    digits = F.replace(_first(snippet, fixed.MONEY, 1), F.lit(","), F.lit(""))
    if trim_dots:
        digits = F.regexp_replace(digits, r"\.+$", "")
    unit = F.lower(_first(snippet, fixed.MONEY, 2))
    scale = F.when(unit == "billion", 1e9).when(unit == "million", 1e6).when(unit == "thousand", 1e3).otherwise(1.0)
    return digits.try_cast("double") * scale


FOUND = T.StructType([T.StructField(n, T.StringType()) for n in ("revenue", "net_income", "cash", "eps", "event")])
FOUND_TYPE = pa.struct([(f.name, pa.string()) for f in FOUND])
_items = {
    "revenue": Finder(fixed.REVENUE, "revenue", "sales", starts=("total", "net", "revenue")), "net_income": Finder(fixed.NET_INCOME, "income", "loss", starts=("net",)), "cash": Finder(fixed.CASH, "equivalent", starts=("cash",)),
    "eps": Finder(fixed.EPS, "diluted", starts=("diluted",)), "event": Finder(fixed.EXECUTIVE, "departure", "appoint", "resignation", "retired", starts=("departure", "appoint", "resignation", "retired")),
}


def find_financials(text: str) -> dict[str, str | None]:
    """The first statement of each item: what matched; of earnings per share the number; of an
    event the text around it, on one line."""
    low = lowered(text)
    found = {name: finder.first(text, low) for name, finder in _items.items()}
    out = {name: m and (m[1] if name == "eps" else m[0]) for name, m in found.items()}
    if m := found["event"]:
        out["event"] = text[max(0, m.start() - fixed.EXECUTIVE_BEFORE) : m.end() + fixed.EXECUTIVE_AFTER].replace("\n", " ").strip()
    return out


@F.arrow_udf(FOUND)
def financial_matches(text: pa.Array) -> pa.Array:
    return pa.array([find_financials(x or "") for x in text.to_pylist()], FOUND_TYPE)


def business_sample(section: Column) -> Column:
    return strip(F.replace(F.substring(section, 1, fixed.BUSINESS_CHARS), F.lit("\n"), F.lit(" ")))


def with_financials(df: DataFrame, text: str = "text", sections: str | None = None, found: str | None = None) -> DataFrame:
    """df with FINANCIALS; null where a filing doesn't say. sections: a map column of name to text;
    found: a column of FOUND, where the text was searched already."""
    if found is None:
        df = df.withColumn("__found", financial_matches(F.col(text)))
    f = F.col(found or "__found")
    sample = business_sample(F.try_element_at(F.col(sections), F.lit("ITEM_1_BUSINESS"))) if sections else F.lit(None).cast("string")
    eps = F.regexp_replace(f["eps"], r"\.+$", "").try_cast("double")
    values = (strip(f["revenue"]), dollars(f["revenue"], False), strip(f["net_income"]), dollars(f["net_income"], False), eps, dollars(f["cash"], False), f["event"], sample)
    return df.withColumns(dict(zip(FINANCIALS, values, strict=True))).drop(found or "__found")
