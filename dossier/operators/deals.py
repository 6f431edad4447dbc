"""Corporate purchases in filing texts.

The patterns backtrack over long names, which overflows the JVM's matcher on long
texts, so they run in Python over Arrow batches; what follows from a match
(price, consideration) is JVM-side.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions import fixed
from dossier.functions.money import dollars
from dossier.functions.search import Finder, lowered

MATCH = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType() if n in ("pattern", "start") else T.StringType()) for n in ("pattern", "start", "target", "price", "context")]))
DEAL = ["seller_target_name", "transaction_type", "purchase_price_usd", "consideration_type", "context_summary"]
_needs = [("acquire", "purchase"), ("entered",), ("completed",), ("purchas", "procured", "buy"), ("agreement", "contract")]
_starts = [("acquire", "purchase"), ("entered",), ("completed",), ("purchas", "procured", "buy"), ("master", "commercial", "vendor")]
_deals = [Finder(p, *needs, starts=starts) for (p, _), needs, starts in zip(fixed.DEALS, _needs, _starts, strict=True)]
_tail = re.compile(fixed.TRAILING_WORD, re.I)
DEAL_TYPE = pa.list_(pa.struct([("pattern", pa.int32()), ("start", pa.int32()), ("target", pa.string()), ("price", pa.string()), ("context", pa.string())]))


def find_deals(text: str) -> list[dict]:
    """Matches by pattern, then by place; of a name, in any case, the first."""
    seen: set[str] = set()
    out, low_text = [], lowered(text)
    for k, finder in enumerate(_deals):
        for m in finder.every(text, low_text):
            target = _tail.sub("", m[1].strip())
            low = target.lower()
            if len(target) < 3 or low in fixed.NO_TARGETS or low in seen:
                continue
            seen.add(low)
            context = text[max(0, m.start() - fixed.CONTEXT_BEFORE) : m.end() + fixed.CONTEXT_AFTER].replace("\n", " ").strip()
            out.append({"pattern": k + 1, "start": m.start(), "target": target, "price": m[2] or None, "context": context})
    return out


@F.arrow_udf(MATCH)
def deal_matches(text: pa.Array) -> pa.Array:
    return pa.array([find_deals(x or "") for x in text.to_pylist()], DEAL_TYPE)


# So that the filter that an explode implies isn't pushed below it, which would run it twice.
deal_matches = deal_matches.asNondeterministic()


def clean_target(name: Column) -> Column:
    """Without one trailing word that belongs to no name; null if nothing of a name is left."""
    short = F.regexp_replace(name, "(?iU)" + fixed.TRAILING_WORD, "")
    return F.when((F.length(short) >= 3) & ~F.lower(short).isin(*fixed.NO_TARGETS), short)


def consideration(context: Column) -> Column:
    low = F.lower(context)
    cash, stock = low.contains("cash"), low.contains("stock") | low.contains("shares")
    return F.when(cash & stock, "Mixed (Cash & Stock)").when(cash, "Cash").when(stock, "Stock").otherwise("Unknown")


def with_deal_columns(df: DataFrame, match: str = "match") -> DataFrame:
    """From a MATCH struct to the columns of DEAL."""
    m = F.col(match)
    kinds = F.array(*[F.lit(kind) for _, kind in fixed.DEALS])
    price = F.coalesce(dollars(m["price"], True), dollars(m["context"], True))
    values = (m["target"], F.element_at(kinds, m["pattern"]), price, consideration(m["context"]), m["context"])
    return df.withColumns(dict(zip(DEAL, values, strict=True)))


def deal_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """A row per deal beside df's other columns, with pattern and start."""
    rest = [c for c in df.columns if c != text]
    found = df.select(*rest, F.explode(deal_matches(F.col(text))).alias("match"))
    return with_deal_columns(found).select(*rest, F.col("match.pattern").alias("pattern"), F.col("match.start").alias("start"), *DEAL)
