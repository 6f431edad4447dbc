"""Chat formatting, extraction, quality rules, search and the pipeline."""

import html.parser
import math
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dossier.llm import chat, extraction, quality, topk
from dossier.llm.dom import Page
from dossier.llm.madeup import Maker

CONTROL = st.sampled_from(["<turn>", "</turn>", "<says>", "\\", "<", "\n", "### Assistant:", "<image:0>", "a", "é"])


@settings(max_examples=300, deadline=None)
@given(st.lists(CONTROL).map("".join), st.lists(CONTROL).map("".join) | st.text(), st.booleans())
def test_turns_come_back(role, text, learn):
    part = {"type": "text", "text": text, "uri": None, "width": None, "height": None, "seconds": None, "pages": None}
    segment, loss, _ = chat.format_turn(role, [part], learn)
    assert chat.parse_turn(segment) == (role, text)
    assert "".join(chat.unescape(segment[x["start"] : x["start"] + x["length"]]) for x in loss) == (text if learn else "")


def test_typed_parts(spark):
    rows = [
        (1, 0, "user", [("text", "look <here>", None, None, None, None, None), ("image", None, "a.png", 57, 28, None, None), ("audio", None, "b.wav", None, None, 2.01, None)]),
        (1, 1, "assistant", [("text", "seen", None, None, None, None, None), ("document", None, "c.pdf", None, None, None, 2), ("text", "read", None, None, None, None, None)]),
        (2, None, None, None), (None, 0, "user", []), (1, 1, "assistant", None), (3, 0, "user", [("odd kind", None, "x", None, None, None, None)]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{chat.PART}>").selectExpr("*", "1 as position", "'x' as segment")
    out = {(r.conv_id, r.position): r for r in chat.format_chats(df).collect()}
    first = out[1, 0]
    assert first.segment == "<turn>user<says>look \\<here><image:0><audio:1></turn>\n"
    assert [(a.kind, a.uri, a.tokens, first.segment[a.at : a.at + 3]) for a in first.attachments] == [("image", "a.png", 3, "<im"), ("audio", "b.wav", 51, "<au")]
    assert first.extra_tokens == 54 and first.loss == []
    last = out[1, 2]  # the null content sorts before
    assert [last.segment[x.start : x.start + x.length] for x in last.loss] == ["seen", "read"]
    assert out[1, 1].start == len(first.segment)
    assert len(out) == 6 and out[3, 0].attachments[0].tokens == 0
    digests = {r.conv_id: r for r in chat.digest_chats(chat.format_chats(df)).collect()}
    assert digests[1].n_turns == 3 and digests[1].loss_chars == 8 and digests[2].n_turns == 1
    assert chat.digest_chats(chat.format_chats(df.limit(0))).count() == 0


def test_text_that_looks_like_a_placeholder_is_no_part():
    text = {"type": "text", "text": "<image:0>", "uri": None, "width": None, "height": None, "seconds": None, "pages": None}
    image = text | {"type": "image", "text": None, "uri": "a.png"}
    segment = chat.format_turn("user", [text, image, text, image], False)[0]
    assert chat.parse_parts(segment) == ("user", ["<image:0>", 0, "<image:0>", 1])
    assert chat.parse_turn(segment) == ("user", "<image:0><image:0>")
    long = "\\<\\" * 400_000
    segment = chat.format_turn("user", [text | {"text": long}], True)[0]
    assert chat.parse_turn(segment) == ("user", long)


def test_held_out_pages():
    model = extraction.classifier()
    right = total = 0
    for k in range(150):
        source = Maker(90_000 + k).page()
        page = Page(source)
        wanted = "\n".join(text for at, text, _ in page.runs if page.label[at] == 1)
        total += 1
        right += extraction.extract([source], model)[0] == wanted
    assert right / total > 0.9


def test_pages(spark):
    article = "<article><h1>Title &amp; more</h1><p>First  paragraph<br>goes on, with some words.<p>Second one; it ends here.</article>"
    page = f"<html><head><title>t</title></head><body><nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav><div class=ad>Buy now.</div>{article}<script>if (a < b) c('</p>')</script><section id=comments><h3>Comments</h3><div class=comment><p>I like this very much, thanks.</p></div></section><footer>&copy; us</footer>"
    df = spark.createDataFrame([(1, page, "x"), (2, None, "x"), (3, "", "x"), (1, page, "y"), (4, "<<<>\"'<p", "x"), (5, "<div>" * 3000, "x")], "page_id long, html string, text2 string")
    out = extraction.main_text(df).collect()
    wanted = "Title & more\nFirst paragraph goes on, with some words.\nSecond one; it ends here."
    assert [r.text for r in out if r.page_id == 1] == [wanted, wanted]
    assert all(r.text == "" for r in out if r.page_id in (2, 3, 5)) and len(out) == 6
    assert extraction.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("before", [
    "<datalist id=d><option value=a><option value=b></datalist>", "<form><select name=s><option>One<option selected>Two</select></form>", "<canvas id=c>", "<object data=x.swf>",
    "<svg viewBox='0 0 1 1'><path d='M0 0'/><g>", "<iframe src=x>", "<noscript><img src=y>", "<template>", "<textarea name=t>", "<script>var a = 1 < 2;", "<style>p{margin:0}", "<!-- never ends ", "<div title='a>b'></div>", "<STYLE>i{}</Style>",
])
def test_tags_without_end_cost_no_page(before):
    article = "<article><h1>Title of it</h1><p>First paragraph goes on, with some words.<p>Second one; it ends here.</article>"
    page = "<html><body><nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav>{}<footer>&copy; us</footer>"
    assert extraction.extract([page.format(before + article)], extraction.classifier()) == ["Title of it\nFirst paragraph goes on, with some words.\nSecond one; it ends here."]


@pytest.mark.parametrize("page", [
    "<a " * 1_600_000, "<a " * 1_600_000 + ">", "<a \">\"" * 700_000 + "'", "<!--" * 1_200_000, "<script>" * 600_000, "<title>" * 600_000, "<![CDATA[" * 500_000, "&amp" * 1_200_000, "<" * 5_000_000, "<p class='" * 500_000,
    "<div>" * 100_000 + "</p>" * 1_000_000, "<ul><li><ul>" + "<div>" * 100_000 + "<li></li>" * 100_000, "<td>" * 100_000 + "<option>" * 100_000,
])
def test_malformed_pages_take_time_in_proportion(page):
    """Megabytes of it; the quadratic parser would need hours."""
    began = time.process_time()
    extraction.extract([page], extraction.classifier())
    assert time.process_time() - began < 60


def test_articles_of_the_test_pages(spark):
    """An independent parser's text of the article element, for pages that have one."""

    class Article(html.parser.HTMLParser):
        blocks, text, depth, gone = (), "", 0, 0

        def handle_starttag(self, tag, attrs):
            words = set(" ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).split())
            if self.depth and (self.gone or tag in ("nav", "aside", "form", "script", "style", "footer", "header") or words & {"ad", "comments", "comment", "share", "notice"}):
                self.gone += tag not in ("br", "img", "input", "hr")
            elif tag == "article" or (self.depth and tag in ("h1", "h2", "h3", "p", "li", "ul", "ol", "div", "section", "blockquote", "pre", "td", "tr", "table", "dt", "dd")):
                self.depth += tag == "article"
                self.end()
            elif tag == "br":
                self.text += " "

        def handle_endtag(self, tag):
            if self.gone:
                self.gone -= tag not in ("br",)
            elif tag == "article":
                self.end()
                self.depth -= 1
            elif tag not in ("b", "i", "a", "em", "strong", "code", "span"):
                self.end()

        def handle_data(self, data):
            self.text += data if self.depth and not self.gone else ""

        def end(self):
            if self.depth and self.text.split():
                self.blocks = (*self.blocks, " ".join(self.text.split()))
            self.text = ""

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    same = total = 0
    for r in extraction.main_text(pages.withColumn("text", pages.page_id)).collect():
        if r.html and len(re.findall("<article", r.html)) == 1 and "</article>" in r.html:
            plain = Article()
            plain.feed(r.html)
            plain.close()
            total += 1
            same += "\n".join(plain.blocks) == r.text
            assert r.text_in == r.page_id
    assert total > 100 and same == total


def test_what_stands_in_a_paragraph_stays():
    say = lambda x: [text for _, text, _ in Page(f"<body><article><p>So {x} it is.</p></article>").runs]
    assert say("<math><mrow><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></mrow></math> as") == ["So x=12 as it is."]
    assert say("<svg><title>t</title><path d='M0'/><text>label</text></svg> and <object><b>that</b></object>") == ["So label and that it is."]
    page = Page("<body><article><p>Pick <select><optgroup><option>a<option>b<optgroup><option>c</select> now.</p></article>")
    assert [text for _, text, _ in page.runs] == ["Pick", "a", "b", "c", "now."]
    assert page.runs[0][0] == page.runs[-1][0]  # both in the paragraph
    assert page.depth[page.runs[1][0]] == page.depth[page.runs[3][0]]


def test_states_never_contradict():
    model = extraction.classifier()
    rng = np.random.default_rng(0)
    for k in range(30):
        page = Page(Maker(50_000 + k).page())
        state = extraction.decode(page, rng.normal(size=(len(page.kind), 3)) * 5)
        for at, up in enumerate(page.parent):
            if up >= 0:
                assert state[at] >= state[up]
    assert model.classes == 3


def plain_measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    places = {}
    for k in range(len(w) - 2):
        places.setdefault(tuple(w[k : k + 3]), []).append(k)
    covered = {k + j for at in places.values() if len(at) > 1 for k in at for j in range(3)}
    rows = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(rows) - len(set(rows)), len(covered)


@pytest.mark.parametrize("rows", [
    [], [(1, None, None, None), (2, "", "en", None)],
    [(k, t, "en", "s" if k % 2 else None) for k, t in enumerate(["a b c " * 40, "one two three four\none two three four\nx", "\n \nx\nx\n", "é " * 60, "# $ %", "w" * 50_000, " ".join(map(str, range(5000))), "a b c d a b c d a b"])],
])
def test_measures(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as n_lines2")
    out = {r.doc_id: r for r in quality.judge(df).collect()}
    assert len(out) == len(rows)
    for i, text, *_ in rows:
        r = out[i]
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == plain_measures(text)
        assert r.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0]) and not (r.base_failed and r.kept)


def test_min_group_is_a_parameter(spark):
    """A source of 40 with longer words than the rest: out by its language's fences, in by its own."""
    r = random.Random(4)
    say = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(n)) for _ in range(80))
    rows = [(k, say(4), "en", "a") for k in range(200)] + [(1000 + k, say(12), "en", "b") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = lambda **x: {s: n for s, n in quality.judge(df, ["source"], **x).where("kept").groupBy("source").count().collect()}
    assert kept() == kept(min_group=41) == {"a": 200}
    assert kept(min_group=40) == {"a": 200, "b": 40}


def test_top_k(spark):
    rng = np.random.default_rng(2)
    center = rng.normal(size=16)
    rows = [(k, [float(x) for x in (center if k % 3 else 0) + rng.normal(size=16) * 0.3]) for k in range(3000)]
    rows += [(3000 + k, rows[100][1]) for k in range(300)]  # ties
    rows += [(4000, None), (4100, [1.0, None]), (4200, [float("nan")] * 16), (4300, [float("inf")] * 16), (None, rows[0][1]), (4400, [0.0] * 16), (4500, [0.5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score")
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    clean = {i: np.floor(np.float64(np.float32(v)) * 1024).astype(np.int64) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    for q in (i for i in clean if i % 100 == 0):
        score = {i: int(v[: len(clean[q])] @ clean[q][: len(v)]) for i, v in clean.items() if i != q}
        best = sorted(score, key=lambda i: (-score[i], i))[:10]
        assert sorted(got[q]) == [(k + 1, i, score[i]) for k, i in enumerate(best)]
    assert set(got) == {i for i in clean if i % 100 == 0}
    few = df.where("vec_id < 3 or vec_id = 0")
    assert topk.top_k(few, few.where("vec_id = 0")).count() == 2
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def plain_top(rows, k=10):
    """Scores in Python's integers; of rows that share a query's id, the smallest vector asks."""
    clean = [(i, [math.floor(np.float64(x) * 1024) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(np.float64(x) * 1024) for x in v)]
    asks = {}
    for i, v in clean:
        if i % 100 == 0:
            asks[i] = min(asks.get(i, v), v)
    out = {}
    for q, v in asks.items():
        score = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in clean if i != q)[:k]
        out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(score)]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_top_k_of_odd_vectors(spark, seed, monkeypatch):
    """Sparse, wide, huge and repeated vectors; vec_ids that several rows share, some of whose vectors take no part."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "LEAST_SHARD_ROWS", 300)
    r = random.Random(seed)
    sparse = lambda n: [r.choice([-1, 1, 2]) * r.random() if r.random() < 0.15 else 0.0 for _ in range(n)]
    rows = [(k, sparse(40)) for k in range(0, 900)]
    rows += [(100, [None, 1.0]), (100, [1.0, 1.0]), (200, None), (200, [float("nan")] * 3), (200, sparse(40)), (5, [1e300] * 4), (6, [2.0] * 40), (6, [2.0] * 40)]
    if seed == 1:
        rows += [(700, [1e20, -1e20]), (701, [1e20, 3.0]), (702, [-1e20] * 3), (1000, [3e15, 1.0]), (1001, [1e307] * 2)]
    if seed == 2:  # all products small in number, with sums beyond 2^53
        rows = [(k, [r.uniform(-1, 1) * 1e5 for _ in range(300)]) for k in range(250)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for x in topk.top_k(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    assert got == plain_top(rows)


def test_pipeline(spark):
    import corpus_pipeline as c
    from dossier.session import written
    from test_brute_force import components_of, plain_fingerprint, plain_lines

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stages = dict(c.STAGES)
    kept = written(stages["quality_rules"](spark, docs, ""), "t")
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    lined = written(stages["line_dedup"](spark, kept, ""), "t")
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    expected = plain_lines(rows)
    assert {r.doc_id: (r.text, r.n_chars) for r in lined.collect()} == {i: (x[2], len(x[2])) for i, x in expected.items()}
    single = written(stages["near_dedup"](spark, lined, ""), "t")
    roots = components_of({i: plain_fingerprint(x[2]) for i, x in expected.items()}, 2)
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(roots.values()))
    mixed = written(stages["mix_sources"](spark, single, ""), "t")
    assert mixed.columns == docs.columns and mixed.count() > 0
    pieces = stages["pack"](spark, mixed, "")
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in mixed.collect()}


def test_near_dedup_keeps_one_row_of_each_group(spark):
    """Also of groups with null or repeated doc_id; a doc_id that stands for two texts loses neither for the other."""
    import corpus_pipeline as c

    say = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    texts = [(1, 0), (1, 0), (2, 0), (None, 0), (None, 1), (None, 1), (None, 2), (5, 3), (3, 3), (5, 4), (6, 5), (6, 5)]
    d = spark.createDataFrame([(i, say(k), "en") for i, k in texts] + [(6, say(5), None)], "doc_id long, text string, lang string").repartition(3)
    got = [(r.doc_id, r.text) for r in dict(c.STAGES)["near_dedup"](spark, d, "").collect()]
    expected = [(1, 0), (None, 1), (None, 2), (3, 3), (5, 4), (6, 5)]
    assert sorted(got, key=str) == sorted(((i, say(k)) for i, k in expected), key=str)


def test_columns_named_like_results_stay(spark):
    import corpus_pipeline as c
    from dossier.llm.lines import drop_lines
    from dossier.llm.mixing import mix
    from dossier.session import written

    names = ["kept", "n_words", "word_chars", "n_lines", "n_dropped", "Size", "source_size", "target", "copies", "wanted", "scale", "last", "word_length_low", "base_failed", "kept_in", "__k1", "__u", "__id", "in__u"]
    plain = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = plain.selectExpr("*", *[f"concat({k}, '-', doc_id) as `{x}`" for k, x in enumerate(names)])
    for op, result in ((quality.judge, "kept"), (drop_lines, "n_dropped"), (mix, "copies")):
        rows = written(op(docs), "t")
        assert {(r.doc_id, r[result]) for r in rows.collect()} == {(r.doc_id, r[result]) for r in op(plain).collect()}
        at = result + ("_in_" if result == "kept" else "_in")
        assert all(r[at] == f"{names.index(result)}-{r.doc_id}" and r.scale == f"10-{r.doc_id}" for r in rows.collect())
    for name, stage in c.STAGES[:-1]:
        out, bare = written(stage(spark, docs, ""), "t"), stage(spark, plain, "")
        assert out.columns == docs.columns
        assert sorted(out.select(*plain.columns).collect()) == sorted(bare.collect())
        assert all(r[x] == f"{k}-{r.doc_id}" for r in out.collect() for k, x in enumerate(names))
