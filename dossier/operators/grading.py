"""Letter grades from metrics and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import fixed
from dossier.functions.pylike import py_round, py_str

SCORES = ["overall_grade", "overall_score", "sentiment_score", "transparency_score", "financial_score", "summary_notes"]


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def per_hundred(count: Column, words: Column) -> Column:
    return count / F.greatest(F.lit(1), words) * 100.0


def sentiment_score(net: Column, uncertainty: Column, litigious: Column, words: Column) -> Column:
    return _clamp(50.0 + net * 100.0 - per_hundred(uncertainty, words) * 5.0 - per_hundred(litigious, words) * 10.0)


def transparency_score(fog: Column, words: Column) -> Column:
    base = F.when(fog <= 14.0, 90.0).when(fog <= 18.0, 80.0).when(fog <= 22.0, 65.0).otherwise(50.0)
    return _clamp(base - F.when(words > 80_000, 10.0).otherwise(0.0))


def financial_score(names: Column) -> Column:
    """names: the section names, an array."""
    has = lambda *x: F.arrays_overlap(names, F.array(*map(F.lit, x)))
    return _clamp(70.0 + F.when(has("ITEM_7_MDA", "PART1_ITEM2_MDA"), 15.0).otherwise(0.0) + F.when(has("ITEM_1A_RISK_FACTORS", "PART2_ITEM1A_RISK"), 15.0).otherwise(0.0))


def composite(sentiment: Column, transparency: Column, financial: Column) -> Column:
    return py_round(0.40 * sentiment + 0.30 * transparency + 0.30 * financial, 1)


def letter(score: Column) -> Column:
    out = F
    for least, name in fixed.LETTERS:
        out = out.when(score >= least, name)
    return out.otherwise(fixed.FALLING_LETTER)


def notes(net: Column, fog: Column, litigious_rate: Column, revenue: Column, income: Column, eps: Column, executive: Column) -> Column:
    up, down, even = fixed.TONES
    hard, clear = fixed.CLARITY
    return F.concat_ws(
        " | ", F.concat(F.lit("Revenue Signal: "), revenue), F.concat(F.lit("Net Income Signal: "), income), F.when(eps.isNotNull(), F.concat(F.lit("Diluted EPS: $"), py_str(eps))),
        F.concat(F.lit("Executive Event: "), F.substring(executive, 1, 120), F.lit("...")), F.when(net > 0.1, up).when(net < -0.05, down).otherwise(even),
        F.when(fog > 20.0, hard).otherwise(clear), F.when(litigious_rate > 0.5, fixed.LITIGIOUS_NOTE),
    )


def with_grade(df: DataFrame, names: Column) -> DataFrame:
    """df, which has the metrics (absent values null), with SCORES."""
    get = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in df.columns else F.lit(default)
    said = lambda c, t: F.col(c) if c in df.columns else F.lit(None).cast(t)
    words, net, fog = get("word_count", 0), get("net_sentiment_score", 0.0), get("fog_index", 15.0)
    lit, unc = get("litigious_count", 0), get("uncertainty_count", 0)
    df = df.withColumns({"__s": sentiment_score(net, unc, lit, words), "__t": transparency_score(fog, words), "__f": financial_score(names)})
    df = df.withColumn("overall_score", composite(F.col("__s"), F.col("__t"), F.col("__f")))
    text = notes(net, fog, per_hundred(lit, words), said("revenue_text", "string"), said("net_income_text", "string"), said("eps_diluted", "double"), said("executive_event_summary", "string"))
    return df.withColumns({
        "overall_grade": letter(F.col("overall_score")), "sentiment_score": py_round(F.col("__s"), 1), "transparency_score": py_round(F.col("__t"), 1), "financial_score": py_round(F.col("__f"), 1), "summary_notes": text,
    }).drop("__s", "__t", "__f")
