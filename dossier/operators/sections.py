"""Named sections of a filing's clean text.

Header positions need Python's regular expressions (Unicode classes, positions in
code points), so this is an Arrow UDF over whole batches.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions import fixed
from dossier.functions.search import Finder, lowered

SECTIONS = T.MapType(T.StringType(), T.StringType())
_needs = {"ITEM_1_BUSINESS": "business", "ITEM_1A_RISK_FACTORS": "1a", "ITEM_7_MDA": "discussion", "ITEM_8_FINANCIALS": "statements", "PART1_ITEM2_MDA": "discussion", "PART2_ITEM1A_RISK": "1a", "ITEM_202_EARNINGS": "2.02"}
_patterns = {name: Finder(p, _needs[name], starts=("part" if name.startswith("PART") else "item",)) for name, p in fixed.SECTION_PATTERNS.items()}


def split_sections(text: str) -> dict[str, str]:
    """From each header to the next of any kind; a name that comes again holds its
    last slice of enough length, in the place of its first."""
    low = lowered(text)
    starts = sorted(((m.start(), name) for name, finder in _patterns.items() for m in finder.every(text, low)), key=lambda x: x[0])
    ends = [at for at, _ in starts[1:]] + [len(text)] * bool(starts)
    found: dict[str, str] = {}
    for (at, name), end in zip(starts, ends, strict=True):
        piece = text[at:end].strip()
        if len(piece) > fixed.SECTION_MORE_THAN:
            found[name] = piece[: fixed.SECTION_CAP]
    return found or {fixed.WHOLE_DOCUMENT: text[: fixed.WHOLE_CAP]}


@F.arrow_udf(SECTIONS)
def extract_sections(text: pa.Array) -> pa.Array:
    return pa.array([list(split_sections(x or "").items()) for x in text.to_pylist()], pa.map_(pa.string(), pa.string()))


# So that the filter that an explode implies isn't pushed below it, which would run it twice.
extract_sections = extract_sections.asNondeterministic()


def section_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda x: x != ""))


def section_rows(df: DataFrame, sections: str = "sections") -> DataFrame:
    """A row per section: section_name, section_title, clean_text, word_count beside df's other columns."""
    rest = [c for c in df.columns if c != sections]
    out = df.select(*rest, F.explode(sections).alias("section_name", "clean_text"))
    return out.withColumns({"section_title": F.replace("section_name", F.lit("_"), F.lit(" ")), "word_count": section_words(F.col("clean_text"))})
