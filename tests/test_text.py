"""Cleaning, sections, metrics, financials, deals and grades against hand-computed values."""

import re

import pytest
from pyspark.sql import functions as F

from dossier.functions import fixed
from dossier.functions.money import dollars, with_financials
from dossier.functions.pylike import falsy, filing_url, hash_id, pad_cik, py_round
from dossier.functions.textstats import syllables, with_metrics
from dossier.operators.cleaning import clean_html, decode_utf8, normalize_lines
from dossier.operators.deals import deal_rows, find_deals
from dossier.operators.grading import with_grade
from dossier.operators.sections import split_sections


def texts(spark, *values):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, text string")


def column(df, name):
    return [r[name] for r in df.orderBy("k").collect()]


FILING = """<html><head><title>x</title></head><body><div>Item 1. Business</div><p>We make things &amp; sell them to many people.</p>
<div>Item 1A. Risk Factors</div><p>Many risks could harm the business we run.</p><script>no()</script>
<h2>Item 7. Management's Discussion and Analysis</h2><p>Net sales were $ 5 million in the quarter.</p></body></html>"""


def test_html_to_sections(spark):
    (clean,) = column(texts(spark, FILING).withColumn("c", clean_html(F.col("text"))), "c")
    assert "no()" not in clean and "things & sell" in clean
    assert set(split_sections(clean)) == {"ITEM_1_BUSINESS", "ITEM_1A_RISK_FACTORS", "ITEM_7_MDA"}


def test_cleaning_edges(spark):
    df = texts(spark, None, "", "a\r\n\r\n  b \rc", "<b>no html mark</b>", "<div>a<!-- b -->c&nbsp;d&#233;</div>")
    assert column(df.withColumn("c", clean_html(F.col("text"))), "c") == ["", "", "a\nb\nc", "<b>no html mark</b>", "a\nc\xa0dé"]
    assert column(texts(spark, " \xa0x\xa0 ").withColumn("c", normalize_lines(F.col("text"))), "c") == ["x"]
    raw = spark.createDataFrame([(bytearray(b"caf\xc3\xa9 \xff!"),)], "b binary")
    assert raw.select(decode_utf8("b")).first()[0] == "café !"


def test_unfinished_references_are_text():
    from dossier.operators.cleaning import clean

    assert clean("<div>a&amp</div>b&ampc &copy 1 &notit; &amp;lt; &lt;&#233;&#xe9 &a & &") == "a&amp\nb&ampc &copy 1 &notit; &lt; <éé &a & &"


def test_cleaning_of_valid_and_broken_markup(spark):
    from dossier.operators.cleaning import clean

    assert clean("<div title='a>b' alt=\"c>d\">k</div>") == "k"
    assert clean("<html>a<script>if (x > '</p>') y()</script>b<style>p{}</style>c") == "a\nb\nc"
    assert clean("<html>a<ix:header>x<ix:header>y</ix:header>z</ix:header>b") == "a\nb"
    assert clean("<html>a<script>never ends <p>b") == "a"
    assert clean("<html>a<head><header>b</header>c") == "a\nb\nc"  # a head that never ends
    assert clean("<html>a<p class='x>b</p>c") == "a\nb\nc"
    assert clean("<html>a<script src=x />b</html>") == "a\nb"
    samples = [" a\r\n\tb \x1c\n\n", "\x85x\u2003\r\ry", "no  change", "\n"]
    df = texts(spark, *samples)
    assert column(df.withColumn("c", normalize_lines(F.col("text"))), "c") == [clean(x) for x in samples]


@pytest.mark.parametrize("text", [
    "Total net revenues were $5 and NET INCOME OF $3; Diluted EPS was $ 1.5. ", "net\u00a0sales were $2 billion", "Re\u017fignation of Joe", "DEPARTURE OF DIRECTORS", "cash and cash equivalent: $4", "appointed Dr. Ann Lee",
])
def test_skipped_searches_would_have_found_nothing(text):
    """What a text must hold to be searched never hides a match."""
    from dossier.functions.money import _items
    from dossier.functions.search import lowered
    from dossier.operators.deals import _deals
    from dossier.operators.sections import _patterns

    more = ["Part I of it Item 2. Management's Discussion", "ITEM 8: FINANCIAL STATEMENTS", "Item 2.02 Results of Operations", "entered into an agreement with Acme for $ 5", "procured parts from Acme", "vendor agreement with Acme", "buying goods from Acme"]
    for t in [text, *more]:
        for finder in [*_items.values(), *_deals, *_patterns.values()]:
            assert [m.span() for m in finder.every(t, lowered(t))] == [m.span() for m in finder.pattern.finditer(t)]


def test_section_rules():
    toc = "Item 1A. Risk Factors\nItem 7. Management’s Discussion and Analysis of all that\nItem 1A. Risk Factors\nthe body is long enough"
    found = split_sections(toc)
    assert found["ITEM_1A_RISK_FACTORS"].endswith("long enough")
    assert list(found) == ["ITEM_1A_RISK_FACTORS", "ITEM_7_MDA"]
    assert split_sections("Item 1. Business") == {"FULL_DOCUMENT": "Item 1. Business"}  # 16 characters: too short
    assert split_sections("x" * 100_001) == {"FULL_DOCUMENT": "x" * 100_000}
    long = split_sections("Item 1. Business " + "y" * 60_000)["ITEM_1_BUSINESS"]
    assert len(long) == 50_000
    gap = split_sections("Part II  some words in between that are long Item 1A. Risk Factors and then the text")
    assert set(gap) == {"PART2_ITEM1A_RISK", "ITEM_1A_RISK_FACTORS"}
    assert "PART2_ITEM1A_RISK" not in split_sections("Part II\tItem 1A. Risk Factors and then the text of it")
    assert "PART2_ITEM1A_RISK" not in split_sections("Part II, Item 1A. Risk Factors and then the text of it")


def test_metrics(spark):
    df = with_metrics(texts(spark, "Growth was strong and record gains improved. A risk of uncertainty may depend on claims, perhaps!", "", None, "123 456. 7", "café x1 y_z well-known"))
    rows = df.orderBy("k").collect()
    assert (rows[0].positive_count, rows[0].negative_count, rows[0].uncertainty_count, rows[0].litigious_count) == (5, 2, 2, 1)
    assert rows[0].sentence_count == 2 and rows[0].net_sentiment_score == 0.375
    assert (rows[1].word_count, rows[1].sentence_count, rows[1].fog_index) == (0, 0, 0.0)
    assert (rows[2].word_count, rows[2].sentence_count) == (0, 0)
    assert (rows[3].word_count, rows[3].sentence_count) == (0, 1)
    assert rows[4].word_count == 2  # well, known


def test_syllables_like_python(spark):
    def by_hand(w):
        if len(w) <= 3:
            return 1
        w = re.sub(r"^y", "", re.sub(r"(?:[^laeiouy]|ed|es|e)$", "", w))
        return max(1, len(re.findall(r"[aeiouy]{1,2}", w)))

    words = "the walked boxes make little yellow queue rhythm beautiful strength eyes area uncertainty".split()
    assert column(texts(spark, *words).withColumn("s", syllables(F.col("text"))), "s") == [by_hand(w) for w in words]


@pytest.mark.parametrize(("snippet", "financial", "deal"), [
    ("$ 25.4 billion", 25.4e9, 25.4e9), ("$1,234.", 1234.0, 1234.0), ("$5.2.", None, 5.2), ("$.", None, None), ("$,", None, None), ("$1.2.3", None, None), ("$\xa07 MILLION", 7e6, 7e6), ("none", None, None),
])
def test_dollars(spark, snippet, financial, deal):
    df = texts(spark, snippet).select(dollars(F.col("text"), False).alias("f"), dollars(F.col("text"), True).alias("d"))
    assert tuple(df.first()) == (financial, deal)


def test_financials(spark):
    text = "Total net revenues were $ 25.4 billion. Net income was $5.2 billion and diluted earnings per share were $1.25. The appointment of\nnew directors followed."
    r = with_financials(texts(spark, text, "nothing")).orderBy("k").collect()
    assert (r[0].revenue_usd, r[0].net_income_usd, r[0].eps_diluted) == (25.4e9, 5.2e9, 1.25)
    assert "appointment of new directors" in r[0].executive_event_summary
    assert all(r[1][c] is None for c in ("revenue_text", "revenue_usd", "eps_diluted", "executive_event_summary"))
    event = "z" * 80 + " resignation of " + "y" * 400
    (got,) = column(with_financials(texts(spark, event)), "executive_event_summary")
    m = re.search("resignation of", event)
    assert got == event[max(0, m.start() - 50) : m.end() + 250].strip()


def test_deals(spark):
    text = "The company acquired Big Target Inc. for $ 1.5 billion in cash. It later purchased parts from Supplier Co, totaling $ 2 million."
    rows = deal_rows(texts(spark, text)).orderBy("start").collect()
    assert "Big Target" in rows[0].seller_target_name and rows[0].purchase_price_usd == 1.5e9 and rows[0].consideration_type == "Cash"
    twice = find_deals("completed the acquisition of Acme, completed the acquisition of ACME, too")
    assert [d["target"] for d in twice] == ["Acme"]
    early = deal_rows(texts(spark, "a fee of $ 9 million; completed the acquisition of Zed for $ 4 thousand")).first()
    assert early.purchase_price_usd == 9e6  # the name took the "for", so the first amount of the context counts
    assert find_deals("") == [] and find_deals("completed the acquisition of The Company, ok") == []


@pytest.mark.parametrize(("score", "grade"), [(93.0, "A+"), (92.9, "A"), (90.0, "A"), (85.0, "B+"), (84.9, "B"), (75.0, "C+"), (70.0, "C"), (60.0, "D"), (59.9, "F")])
def test_letters(spark, score, grade):
    from dossier.operators.grading import letter

    assert spark.range(1).select(letter(F.lit(score))).first()[0] == grade


def test_grade(spark):
    row = [(1000, 0.5, 12.0, 0, 0, "Revenue of $5")]
    df = spark.createDataFrame(row, "word_count int, net_sentiment_score double, fog_index double, litigious_count int, uncertainty_count int, revenue_text string")
    g = with_grade(df, F.array(F.lit("ITEM_7_MDA"), F.lit("ITEM_1A_RISK_FACTORS"))).first()
    assert (g.overall_grade, g.overall_score) == ("A+", 97.0)
    assert g.summary_notes == f"Revenue Signal: Revenue of $5 | {fixed.TONES[0]} | {fixed.CLARITY[1]}"
    bare = with_grade(spark.createDataFrame([(1,)], "k int"), F.array().cast("array<string>")).first()
    assert (bare.sentiment_score, bare.transparency_score, bare.financial_score, bare.overall_score) == (50.0, 80.0, 70.0, 65.0)
    long = with_grade(spark.createDataFrame([(80_001, 12.0)], "word_count int, fog_index double"), F.array().cast("array<string>")).first()
    assert long.transparency_score == 80.0


def test_python_like(spark):
    import hashlib

    values = [82.25, 0.125, 2.675, -0.04, 1e9 + 0.05, 15.05]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(py_round(F.col("x"), 1)).collect()] == [round(v, 1) for v in values]
    one = spark.range(1)
    assert one.select(hash_id("filing", F.lit("a"), F.lit(None))).first()[0] == hashlib.sha256(b"filing:a:None").hexdigest()[:16]
    assert one.select(pad_cik(F.lit("320193")), pad_cik(F.lit("12345678901"))).first()[:] == ("0000320193", "12345678901")
    assert one.select(filing_url(F.lit("0000"), F.lit("1-2-3"), F.lit("a/b.htm"))).first()[0].endswith("/0/123/a/b.htm")
    assert one.select(falsy(F.lit(""), "U"), falsy(F.lit(None).cast("date"), "U")).first()[:] == ("U", "U")


def test_str_of_doubles(spark):
    from dossier.functions.pylike import py_str

    values = [0.0, 1.25, -3.5, 25.4e9, 123456789.125, 1e15, 1e16, 1.5e22, 1e-3, 1e-4, 1.5e-5, 1e100, 2e-300, float("nan"), float("inf"), float("-inf"), None, 1e7, 5200.0]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double")
    assert column(df.withColumn("s", py_str(F.col("x"))), "s") == [str(v) for v in values]


def test_one_trip_to_python(spark):
    """Text is searched once, whatever refers to the results."""
    from dossier.plans.grading_pass import enrich

    raw = spark.createDataFrame([("a", "T", "10-K", "Growth.")], "accession_number string, ticker string, form string, raw string")
    plan = enrich(raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("regexp_extract_all") <= 2


def test_write_off_never_counts(spark):
    assert with_metrics(texts(spark, "write-off write-off")).first().negative_count == 0


def test_a_pattern_is_tried_only_where_it_may_start():
    """With the matches of a search of the whole text."""
    import random

    from dossier.functions import money
    from dossier.functions.search import lowered
    from dossier.operators import deals, sections

    finders = [*sections._patterns.values(), *deals._deals, *money._items.values()]
    pieces = (
        "Item 1. Business|ITEM 1 business|item 1. description of business|Item 1A: Risk Factors|item 7 Management's Discussion and Analysis|Item 8. Financial Statements|Part I |part ii |item 2. managements discussion|Item 2.02 Results of Operations|"
        "acquired |purchase |purchased |Alpha Corp |for $ 5 million|at $3.|entered into a definitive agreement with |completed the acquisition of |buying new chips from |vendor agreement with |master supply agreement with |totaling $7|"
        "Total net revenues |net |net sales |revenue was |of $ 1,2 billion|net loss |diluted eps |diluted loss per share $ 1.5.|cash and |cash and cash equivalents |departure of directors|appointment of|appointed Mr. John Doe|retired from the board|\n| |é|K|ſ"
    ).split("|")
    tried, found, r = [], 0, random.Random(3)
    for _ in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(12)))
        for f in finders:
            spans = [m.span() for m in f.every(text, lowered(text))]
            assert spans == [m.span() for m in f.pattern.finditer(text)]
            assert (m := f.first(text, lowered(text))) is None and not spans or m.span() == spans[0]
            found += len(spans)
    assert found > 1000

    class Counted:
        def match(self, text, at):
            tried.append(at)

    f = deals._deals[0]
    plain, f.pattern = f.pattern, Counted()
    try:
        text = "no words of it. " * 100 + "They acquired nothing."
        assert list(f.every(text, lowered(text))) == [] and tried == [text.index("acquired")]
    finally:
        f.pattern = plain


def test_syllables_of_all_words_at_once(spark):
    from dossier.functions.textstats import syllable_counts, words

    df = texts(spark, "", "a be the", "Yyed yyyy eeed makes jumped rhythm ally yellow yes seed trees beautiful", "x1 é_y 𝐚abcd abcd𝐚 😀growth well-beings cafés İstanbul made")
    df = df.withColumn("w", words(F.col("text"))).withColumn("n", syllable_counts(F.col("w")))
    assert column(df, "w")[3] == ["growth", "well", "beings", "i", "stanbul", "made"]  # a dot above is no letter
    long = F.filter("w", lambda w: F.length(w) > 3)
    for r in df.withColumn("one", F.transform(long, syllables)).collect():
        assert r.n == (r.one or [1])


def test_sentences_have_more_than_five_characters_between_white_space(spark):
    from dossier.functions.textstats import sentence_count

    df = texts(spark, None, "", "   .  ", "a    b. abcde.  \x1cabcdef ! \U0001d41abcdef? 12345\n", "ab\ncdef.  abcde ")
    assert column(df.withColumn("n", sentence_count(F.col("text"))), "n") == [0, 0, 1, 3, 1]
