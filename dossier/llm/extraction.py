"""Main text of web pages: boosted trees over DOM features, hierarchical decoding.

Every element of a page's block tree is described by its kind, the words of its
class, id and role, its ancestors' hints, and the density, depth and sibling
statistics of its subtree. Boosted trees give the chances of three states: holds
main text and other things, is main text, is anything else. Decoding picks
the likeliest states for the tree as a whole, where the only changes allowed on the
way down are from the first state to any, and from main text to anything else: so a
dropped element has no kept descendant, and menus inside an article go. Text is
kept if its element is main text.

The trees are trained once per process on TRAIN_PAGES made-up pages with a
fixed seed, and travel to the tasks as a constant of a few kilobytes. Pages
are independent rows: nothing is shuffled.

Null or empty html, or no main text: an empty text. Broken markup costs no page: a tag that
never closes is text; a comment that never ends is a tag; a script or style that never ends stops
at the next block element, and what else never ends (a title, a template) is read as page.
Parsing takes time in proportion to the length of a page; nothing is capped. Repeated rows
keep one result each; other columns stay as they are, one named text as text_in.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from dossier.llm.boosting import Boosted
from dossier.llm.common import bounded_batches, set_aside, slices
from dossier.llm.dom import Page, feature_blocks, features
from dossier.llm.madeup import Maker

#: Bound of the training sample.
TRAIN_PAGES, TRAIN_SEED = 500, 11
MIXED, MAIN, OTHER = range(3)
#: What leaving main text costs, in log odds: most of an article's elements belong to it.
LEAVE = 1.0
#: Rows of features that are judged at once.
ROWS = 50_000
RESULTS = ("text",)


@lru_cache(maxsize=1)
def classifier(pages: int = TRAIN_PAGES, seed: int = TRAIN_SEED) -> Boosted:
    x, y = [], []
    for k in range(pages):
        page = Page(Maker(seed * 1_000_003 + k).page())
        label = np.array(page.label)
        x.append(features(page)[label >= 0])
        y.append(label[label >= 0])
    return Boosted(3).fit(np.concatenate(x), np.concatenate(y))


def decode(page: Page, margins: np.ndarray) -> list[int]:
    """The likeliest consistent states."""
    n = len(page.kind)
    loss = -margins + np.log(np.exp(margins - margins.max(1, keepdims=True)).sum(1, keepdims=True)) + margins.max(1, keepdims=True)
    silent = np.zeros(n, bool)
    spoken = np.zeros(n + 1, np.int64)
    for k, text, _ in page.runs:
        spoken[k + 1] += len(text)
    spoken = np.cumsum(spoken)
    last = np.array(page.last)
    silent = spoken[last + 1] == spoken[:-1]  # elements without text have no say
    loss[silent] = 0
    cost = loss.tolist()
    parent = page.parent
    for k in range(n - 1, 0, -1):
        a, b, c = cost[k]
        p = cost[parent[k]]
        p[MIXED] += min(a, b, c)
        p[MAIN] += min(b, c + LEAVE)
        p[OTHER] += c
    state = [0] * n
    for k in range(n):
        above = state[parent[k]] if k else MIXED
        a, b, c = cost[k]
        if above == MIXED:
            state[k] = MIXED if a <= min(b, c) else MAIN if b <= c else OTHER
        else:
            state[k] = MAIN if above == MAIN and b <= c + LEAVE else OTHER
    return state


def extract(pages: list[str], model: Boosted) -> list[str]:
    parsed = [Page(x) for x in pages]
    margins, held = [np.zeros((0, 3))], []
    for page in parsed:
        for block in feature_blocks(page):
            held.append(block)
            if sum(map(len, held)) >= ROWS:
                margins.append(model.margins(np.concatenate(held)))
                held = []
    if held:
        margins.append(model.margins(np.concatenate(held)))
    margins = np.concatenate(margins)
    out, at = [], 0
    for page in parsed:
        state = decode(page, margins[at : at + len(page.kind)])
        at += len(page.kind)
        out.append("\n".join(text for k, text, _ in page.runs if state[k] == MAIN))
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """pages with text (of the column html)."""
    bounded_batches(pages.sparkSession)
    model = classifier()
    pages = set_aside(pages, RESULTS)
    fields = pages.schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 2 << 20):
            text = extract([x or "" for x in batch.column("html").to_pylist()], model)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(text, pa.string())], [*(f.name for f in fields), *RESULTS])

    return pages.mapInArrow(run, schema)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
