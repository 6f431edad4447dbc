"""Quality rules with adaptive thresholds, in DataFrame functions only.

One pass measures each text; nothing but the measures is kept of it. The
measures, as whole numbers, go into quantile sketches per language and source: a
value is rounded down to its five leading bits (an error of 1/16 at most), and
the sketch holds the count of each rounded value. Sketches merge by adding
counts, in any order, to the same result: a group of fewer than `min_group`
documents (a parameter of judge) takes its language's merged sketch, and a language of
fewer that of all.
A document is out if a measure lies beyond the group's fence: the upper quartile
plus FENCE quartile distances plus a slack (below likewise for word length).
Thresholds then come back to the documents by language and source.

Repeated windows are found inside the row: hashes of the windows with their
places are sorted as longs, those with an equal neighbour are compared as
strings. No word leaves its row, so a source or text of any size shuffles nothing.

Null or empty text: no words, so base_failed. Null language or source: a
group of its own. Repeated rows keep one result each. Other columns stay; one
named like a result gets "_in".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import SPACE, outward
from dossier.session import written

SYMBOLS = "#*$%&|<>"
#: Default of judge's min_group.
MIN_GROUP = 100
FENCE = 3
#: Measure, slack above, slack below (none: no lower fence). Shares are in thousandths, word length in hundredths.
MEASURES = {"symbol_share": (50, None), "dup_line_share": (500, None), "repeat_share": (200, None), "word_length": (150, 150)}
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
#: Names that are needed on the way.
BETWEEN = ("n_lines", *(f"{m}_{x}" for m in MEASURES for x in ("high", "low")))
#: More groups than this are joined by shuffle instead of broadcast.
MOST_BROADCAST = 10_000


def _neighbour(items: Column, k: Column, value, own) -> Column:
    """Whether an item equals the one before or after it."""
    return F.coalesce(value(F.get(items, k - 1)) == own, F.lit(False)) | F.coalesce(value(F.get(items, k + 1)) == own, F.lit(False))


def measured(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce("text", F.lit(""))
    bare = F.translate(text, SPACE, "")
    df = docs.withColumns({
        "__w": F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)),
        "word_chars": F.char_length(bare).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "__l": F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE, "") != ""),
    })

    def window(i: Column) -> list[Column]:
        return [F.get("__w", i + k) for k in range(3)]

    hashed = F.transform(
        F.when(F.size("__w") > 2, F.sequence(F.lit(0), F.size("__w") - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.shiftleft(F.xxhash64(*window(i)), 32) + i.cast("long"),
    )
    df = df.withColumns({
        "n_words": F.size("__w").cast("long"), "n_lines": F.size("__l").cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"), "__h": F.sort_array(hashed),
    })
    # An empty sequence for texts without candidates spares their strings.
    maybe = F.filter("__h", lambda x, k: _neighbour(F.col("__h"), k, lambda y: F.shiftright(y, 32), F.shiftright(x, 32)))
    df = df.withColumn("__c", F.transform(maybe, lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")))
    df = df.withColumn("__s", F.array_sort(F.transform("__c", lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("s"), i.alias("i")))))
    df = df.withColumn("__r", F.sort_array(F.transform(F.filter("__s", lambda x, k: _neighbour(F.col("__s"), k, lambda y: y["s"], x["s"])), lambda x: x["i"])))
    covered = F.transform("__r", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("__r", k + 1) - i, F.lit(3))).cast("long"))
    df = df.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, b: a + b))
    return df.drop("__w", "__l", "__h", "__c", "__s", "__r")


def _measure(name: str) -> Column:
    words = F.greatest("n_words", F.lit(1))
    return {
        "symbol_share": F.expr("1000 * n_symbols div greatest(word_chars, 1)"), "dup_line_share": F.expr("1000 * n_dup_lines div greatest(n_lines, 1)"),
        "repeat_share": F.floor(1000 * F.col("n_repeat_words") / words), "word_length": F.floor(100 * F.col("word_chars") / words),
    }[name].cast("long")


def rounded(value: Column) -> Column:
    """A whole number without all but its five leading bits."""
    spare = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, spare), spare)


def sketches(df: DataFrame) -> DataFrame:
    """lang, source, measure, value, n: the mergeable sketch of each group."""
    each = F.array(*[F.struct(F.lit(m).alias("measure"), rounded(_measure(m)).alias("value")) for m in MEASURES])
    long = df.select("lang", "source", F.explode(each).alias("x")).select("lang", "source", "x.*")
    return long.groupBy("lang", "source", "measure", "value").agg(F.count("*").alias("n"))


def quartiles(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, total, q1, q3 of the merged sketches."""
    merged = counts.groupBy(*keys, "measure", "value").agg(F.sum("n").alias("n"))
    lists = merged.groupBy(*keys, "measure").agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("v"), F.sum("n").alias("total"))

    def at(share: float) -> Column:
        walked = F.aggregate(
            "v", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("value")),
            lambda a, x: F.when(a["seen"] >= share * F.col("total"), a).otherwise(F.struct((a["seen"] + x["n"]).alias("seen"), x["value"].alias("value"))),
        )
        return walked["value"]

    return lists.select(*keys, "measure", "total", at(0.25).alias("q1"), at(0.75).alias("q3"))


def fences(counts: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """lang, source and, for each measure, <measure>_high and, if it has one, <measure>_low."""
    own, lang, every = quartiles(counts, ["lang", "source"]), quartiles(counts, ["lang"]), quartiles(counts, [])
    lang = lang.select(F.col("lang").alias("l"), F.col("measure").alias("m"), F.struct("total", "q1", "q3").alias("by_lang"))
    every = every.select(F.col("measure").alias("e"), F.struct("total", "q1", "q3").alias("by_all"))
    all_ = own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("m"))).join(F.broadcast(every), F.col("measure") == F.col("e"))
    pick = F.when(F.col("total") >= min_group, F.struct("total", "q1", "q3")).when(F.col("by_lang.total") >= min_group, F.col("by_lang")).otherwise(F.col("by_all"))
    fence = all_.select("lang", "source", "measure", pick.alias("q")).select("lang", "source", "measure", "q.q1", "q.q3")

    def one(measure: str, value: Column, name: str) -> Column:
        return F.max(F.when(F.col("measure") == measure, value)).alias(f"{measure}_{name}")

    out = []
    for m, (above, below) in MEASURES.items():
        out.append(one(m, F.col("q3") + FENCE * (F.col("q3") - F.col("q1")) + above, "high"))
        if below is not None:
            out.append(one(m, F.col("q1") - FENCE * (F.col("q3") - F.col("q1")) - below, "low"))
    return fence.groupBy("lang", "source").agg(*out)


def judge(docs: DataFrame, columns: list[str] | None = None, min_group: int = MIN_GROUP) -> DataFrame:
    """`columns` of docs (default: all) with the measures, base_failed and kept. min_group: the
    documents that a language and source must have to be judged by quartiles of their own."""
    docs = docs if columns is None else docs.select(*dict.fromkeys([*columns, "lang", "source", "text"]))
    wanted = docs.columns if columns is None else columns
    shown = dict(zip(docs.columns, outward(docs.columns, RESULTS), strict=True))
    inner = dict(zip(docs.columns, outward(docs.columns, [*RESULTS, *BETWEEN]), strict=True))
    docs, names = docs.toDF(*inner.values()), [inner[c] for c in wanted]
    need = list(dict.fromkeys([*names, "lang", "source"]))
    df = written(measured(docs).select(*need, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"), "measures")
    limits = written(fences(sketches(df), min_group).select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *[f"{m}_{x}" for m, (_, low) in MEASURES.items() for x in ("high", "low") if x == "high" or low is not None]), "fences")
    few = limits.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    joined = df.join(F.broadcast(limits) if few else limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")))
    within = F.lit(True)
    for m, (_, low) in MEASURES.items():
        within &= _measure(m) <= F.col(f"{m}_high")
        if low is not None:
            within &= _measure(m) >= F.col(f"{m}_low")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return joined.withColumns({"base_failed": failed, "kept": ~failed & within}).select(*[F.col(f"`{inner[c]}`").alias(shown[c]) for c in wanted], *RESULTS)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])


def _sql() -> str:
    measures = {
        "symbol_share": "1000 * n_symbols // greatest(word_chars, 1)", "dup_line_share": "1000 * n_dup_lines // greatest(n_lines, 1)",
        "repeat_share": "1000 * n_repeat_words // greatest(n_words, 1)", "word_length": "100 * word_chars // greatest(n_words, 1)",
    }
    within = " and ".join(
        f"{e} <= (select q3 + {FENCE} * (q3 - q1) + {MEASURES[m][0]} from fence f where f.doc_id = d.doc_id and measure = '{m}')" + (f" and {e} >= (select q1 - {FENCE} * (q3 - q1) - {MEASURES[m][1]} from fence f where f.doc_id = d.doc_id and measure = '{m}')" if MEASURES[m][1] is not None else "")
        for m, e in measures.items()
    )
    quartile = "select {0} measure, sum(n) as total, min(value) filter (seen >= 0.25 * all_n) as q1, min(value) filter (seen >= 0.75 * all_n) as q3 from (select *, sum(n) over (partition by {0} measure order by value) as seen, sum(n) over (partition by {0} measure) as all_n from (select {0} measure, value, sum(n) as n from sketch group by {0} measure, value)) group by {0} measure"
    return rf"""
with split as (
  select doc_id, lang, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents
), wins as (
  select doc_id, k, array_to_string(w[k:k + 2], ' ') as win from (select doc_id, w, unnest(range(1, len(w) - 1)) as k from split where len(w) >= 3)
), repeated as (
  select doc_id, count(distinct k + j) as n from (select doc_id, k, count(*) over (partition by doc_id, win) as c from wins), (select unnest(range(3)) as j) where c > 1 group by doc_id
), measured as (
  select doc_id, lang, source, len(w) as n_words, length(translate(t, E' \t\n\x0b\x0c\r', '')) as word_chars, length(t) - length(translate(t, '{SYMBOLS}', '')) as n_symbols,
    len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n, 0) as n_repeat_words from split left join repeated using (doc_id)
), exact as (
  {" union all ".join(f"select doc_id, lang, source, '{m}' as measure, ({e})::bigint as v from measured" for m, e in measures.items())}
), sketch as (
  select lang, source, measure, (v >> greatest(length(bin(v)) - 5, 0)) << greatest(length(bin(v)) - 5, 0) as value, count(*) as n from exact group by all
), own as ({quartile.format("lang, source,")}), by_lang as ({quartile.format("lang,")}), by_all as ({quartile.format("")}),
fence as (
  select e.doc_id, e.measure, case when o.total >= {MIN_GROUP} then o.q1 when b.total >= {MIN_GROUP} then b.q1 else a.q1 end as q1, case when o.total >= {MIN_GROUP} then o.q3 when b.total >= {MIN_GROUP} then b.q3 else a.q3 end as q3
  from exact e join own o on e.lang is not distinct from o.lang and e.source is not distinct from o.source and e.measure = o.measure
  join by_lang b on e.lang is not distinct from b.lang and e.measure = b.measure join by_all a on e.measure = a.measure
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and {within} as kept from measured d
"""


OP9_SQL = _sql()
