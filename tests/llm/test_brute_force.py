"""Each operator against a plain version, on a fixture with edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

import public_tokenizers
from dossier.llm import lines, packing, simhash, substrings, tokens
from dossier.session import scratch

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, kept int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def fixture():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdéfgİ") for _ in range(r.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, line = say(40), "  A Line That Many Documents Share \t"
    texts = [None, "", " ", "\n\n", "one", "a b", say(12), say(13), "x" * 30_000, say(9000), "wörter  mit\tlücken\r\nund\xa0mehr"]
    for k in range(60):
        text = say(r.randint(1, 200))
        if k % 3 == 0:
            text += " " + passage + " " + say(20)
        if k % 4 == 0:
            text += "\n" + (line if k % 8 else line.upper()) + "\n" + say(5)
        texts.append(text)
    copy = say(300)
    texts += [copy] * 12 + [copy.replace(" ", "  ", 3), copy + " end", copy + " <|endoftext|> end", (say(14) + "\n") * 5]
    rows = [(k * 7 % 1009, t) for k, t in enumerate(texts)]
    return [(i, t, "en", "s", 0, 1, 2) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture(), DOCS).repartition(5)


def test_tokens(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    cache = scratch(spark, "cache")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs, TOKENIZER, cache).collect()}
    expected = {}
    for i, t, *_ in fixture():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        expected[i] = (len((t or "").encode()), n, n > 1024)
    assert got == expected
    known = tokens.read_cache(spark, cache).count()
    assert known == len({t or "" for _, t, *_ in fixture()})
    again = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs, TOKENIZER, cache).collect()}
    assert again == expected and tokens.read_cache(spark, cache).count() == known  # all hits


def test_tokens_when_runs_appended_the_same_digests(spark, docs):
    """A cache that holds rows twice, or of another tokenizer."""
    cache = scratch(spark, "cache")
    first = sorted(map(tuple, tokens.count_tokens(docs, TOKENIZER, cache).collect()), key=str)
    rows = spark.createDataFrame(tokens.read_cache(spark, cache).collect(), tokens.CACHE)
    rows.unionByName(rows.selectExpr("'other' as tokenizer", "digest", "n_tokens + 1 as n_tokens")).write.mode("append").parquet(cache)
    assert sorted(map(tuple, tokens.count_tokens(docs, TOKENIZER, cache).collect()), key=str) == first
    assert len(first) == docs.count()


def test_files_whose_ids_do_not_rank_their_merges_go_to_the_library(tmp_path):
    import json

    from dossier.llm.bpe import Encoder, ids_ascend

    with open(TOKENIZER) as f:
        kind = json.load(f)
    special = {t["content"] for t in kind["added_tokens"]}
    assert ids_ascend(kind["model"], special)
    kind["model"]["merges"].reverse()
    assert not ids_ascend(kind["model"], special)
    path = tmp_path / "reversed.json"
    path.write_text(json.dumps(kind))
    e = Encoder(str(path))
    text = "the merges of this file come in another order"
    assert e.ids == e._by_library and e.ids(text).tolist() == e.whole(text)


def test_token_engine_agrees_with_the_library():
    from dossier.llm.bpe import Encoder

    e = Encoder(TOKENIZER)
    odd = ["a  b", "  a", " a ", "a\n\nb", "x <|endoftext|> y", "a\r\nb", "a\xa0b c", "é\x85 x", " ", "it's  'll", "​x", "　a", "x" * 9000 + " " * 500, "\U0001f600 ok", "İx ǆ"]
    for text in odd:
        assert e.ids(text).tolist() == e.whole(text)
    for k in range(0, 0x11000, 3):
        if not 0xD800 <= k <= 0xDFFF:
            text = f"a{chr(k)}1 {chr(k)}{chr(k)}!"
            assert e.ids(text).tolist() == e.whole(text), hex(k)


def test_long_runs_of_mixed_white_space_go_to_the_library():
    from dossier.llm import bpe

    e = bpe.Encoder(TOKENIZER)
    for run in ("\r\n", " \n", "\xa0", "\u3000\x85\t"):
        text = "a" + run * (1_200_000 // len(run)) + "x"
        assert e.ids(text).tolist() == e.whole(text)
        for n in (199, 200, 201, 230):
            for before in range(0, 30, 7):
                text = "a" * before + (run * n)[:n] + "x y" * 20
                assert bpe.long_run(text) == (n >= 200)
                assert e.ids(text).tolist() == e.whole(text)


def plain_fingerprint(text):
    w = WORDS(lower(text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(fps, distance):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= distance:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_simhash(docs):
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = {i: plain_fingerprint(t) for i, t, *_ in fixture()}
    roots = components_of(fps, 2)
    assert got == {i: (fps[i], roots[i]) for i in fps}


@pytest.mark.parametrize("distance", [1, 2, 3])
@pytest.mark.parametrize("most", [4096, 20])
def test_links_of_planted_neighbours(spark, distance, most, monkeypatch):
    """Also with buckets that must be split."""
    monkeypatch.setattr(simhash, "MOST_IN_BUCKET", most)
    r = random.Random(distance)
    fps = {r.getrandbits(64) for _ in range(200)}
    base = r.getrandbits(64)
    for _ in range(80):  # a hot group around one value
        fps.add(base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(12)))
    names = {f: f for f in fps}
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = [(x.a & (1 << 64) - 1, x.b & (1 << 64) - 1) for x in simhash.links(nodes, distance).collect()]
    assert all((a ^ b).bit_count() <= distance for a, b in found)
    root = dict(names)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in found:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    assert {f: find(f) for f in fps} == components_of(names, distance)


def test_allocation_covers_every_distance():
    both = np.full((64, 64), 250.0) + np.eye(64) * 250
    for n in (1000, 10**7, 10**10):
        groups, thresholds = simhash.allocate(n, both * n / 1000, 2)
        assert sorted(b for g in groups for b in g) == list(range(64))
        assert sum(thresholds) == 2 - len(groups) + 1


def plain_lines(rows, least=3, chars=20):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t, *_ in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(k, []).append(i)
    out = {}
    for i, t, *_ in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if len(key(x)) < chars or len(held[key(x)]) < least or max(held[key(x)]) == i]
        out[i] = (len(every), len(every) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("hot", [20_000, 30])
def test_lines(docs, hot, monkeypatch):
    monkeypatch.setattr(lines, "HOT_SHARE", hot)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in lines.drop_lines(docs).collect()}
    assert got == plain_lines(fixture())
    assert sum(x[1] for x in got.values()) > 5


@pytest.mark.parametrize("hot", [20_000, 1])
def test_lines_of_rows_that_share_an_id(spark, hot, monkeypatch):
    """Null or repeated doc_id over different texts: each row loses its own lines; with 1, no line is hot."""
    monkeypatch.setattr(lines, "HOT_SHARE", hot)
    common, own = "a line that many documents share", "a line of this document alone, number "
    texts = [(None, f"{common}\n{own}1"), (None, f"{own}2\n{common}\n{own}3"), (None, f"{own}4"), (5, f"{own}5\n{common}"), (5, f"{common}\n{own}6\n{common}"), (7, f"{own}7\n{common}")]
    rows = [(k, *x) for k, x in enumerate(texts + texts[:2])]
    d = spark.createDataFrame(rows, "k int, doc_id long, text string").repartition(3)
    got = {r.k: (r.kept, r.n_lines, r.n_dropped) for r in lines.drop_lines(d).collect()}
    expected = {}
    for k, i, t in rows:
        every = t.split("\n")
        left = [x for x in every if x != common or i == 7]
        expected[k] = ("\n".join(left), len(every), len(every) - len(left))
    assert got == expected


def test_line_sql_means_the_same_rows(spark):
    """The registered SQL and the operator agree on rows with null and repeated doc_ids."""
    import duckdb
    import pandas as pd

    common, own = "a line that many documents share", "a line of this document alone, number "
    texts = [(None, f"{common}\n{own}1"), (None, f"{own}2\n{common}\n{own}3"), (5, f"{own}5\n{common}"), (5, f"{common}\n{own}6\n{common}"), (7, f"{own}7\n{common}"), (7, None), (8, "")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    got = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest()) for r in lines.drop_lines(d).collect()]
    documents = pd.DataFrame(texts, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})  # noqa: F841
    assert sorted(duckdb.sql(lines.OP3_SQL).fetchall(), key=str) == sorted(got, key=str)


def test_perfect_hash():
    from dossier.llm.perfecthash import LineIndex, PerfectHash

    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 63, 50_000).astype(np.uint64))
    h = PerfectHash.build(keys)
    assert sorted(h.slots(keys)) == list(range(len(keys)))
    index = LineIndex.load(LineIndex.build(keys, keys * np.uint64(3), np.arange(len(keys), dtype=np.uint32), np.arange(len(keys))).dump())
    found, slot = index.probe(keys, keys * np.uint64(3))
    assert found.all() and (index.last[slot] == np.arange(len(keys))).all()
    assert not index.probe(keys + np.uint64(1), keys)[0].any()
    assert not LineIndex.build(*(np.zeros(0, np.uint64),) * 2, np.zeros(0, np.uint32), np.zeros(0, np.int64)).probe(keys, keys)[0].any()


def plain_substrings(rows, width=13):
    first = {}
    for i, t, *_ in sorted(rows):
        w = WORDS(t or "")
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = {}
    for i, t, *_ in rows:
        w = WORDS(t or "")
        gone = {k + j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for j in range(width)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("chunk", [4 << 20, 3000])
def test_substrings(docs, chunk, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    monkeypatch.setattr(substrings, "BUCKET", 20_000)
    got = substrings.cut_repeats(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == plain_substrings(fixture())
    assert sum(r.n_removed for r in got) > 100 and all(r.kept_in == 2 for r in got)


def test_substrings_of_large_buckets(spark, docs, monkeypatch):
    """A frequent long seed in many contexts, and a passage in many documents: buckets over HELD go on for several turns."""
    monkeypatch.setattr(substrings, "CHUNK", 4000)
    monkeypatch.setattr(substrings, "HELD", 3000)
    r = random.Random(8)
    say = lambda n: [f"w{r.randrange(40)}" for _ in range(n)]
    seed, passage = ["extraordinarily", "uncommonwealth"], say(30)
    texts = [" ".join(say(5) + seed + say(8) + (passage if k % 2 else []) + say(6) + seed + say(12)) for k in range(150)]
    rows = [(k * 11 % 1009, t) for k, t in enumerate(texts)]
    turns = []
    count = substrings.count_buckets
    monkeypatch.setattr(substrings, "count_buckets", lambda *a: turns.append(a[-1]) or count(*a))
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept) for x in substrings.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == plain_substrings(rows) and len(turns) > 1
    monkeypatch.setattr(substrings, "HELD", 1)  # every turn, and the last without a bound
    monkeypatch.setattr(substrings, "TURNS", 3)
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept) for x in substrings.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == plain_substrings(rows)


def test_substrings_of_rows_that_share_an_id(spark, monkeypatch):
    """Null or repeated doc_id over different texts: each row loses words of its own only."""
    say = lambda name, n=20: " ".join(f"{name}{k}" for k in range(n))
    texts = [(1, say("a")), (5, say("u")), (5, say("a")), (5, say("u") + " " + say("a")), (None, say("a")), (None, say("n")), (7, say("n") + " " + say("x")), (7, say("x")), (7, say("x")), (8, say("x"))]
    rows = [(k, *x) for k, x in enumerate(texts)]
    d = spark.createDataFrame(rows, "k int, doc_id long, text string").repartition(3)
    low = lambda i: -1 if i is None else i
    first = {}
    for _, i, t in rows:
        w = t.split()
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, low(i)), low(i))
    expected = {}
    for n, i, t in rows:
        w = t.split()
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < low(i) for j in range(13)}
        expected[n] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    for tag in (0xFFFF, 0):  # also where all tags are equal
        with monkeypatch.context() as m:
            m.setattr(substrings, "TAG", tag)
            assert {r.k: (r.n_words, r.n_removed, r.kept) for r in substrings.cut_repeats(d).collect()} == expected
    assert expected[1][1] == 0 and expected[2][1] == 20 and expected[5][1] == 0


def test_substrings_compares_words_when_hashes_collide(docs, monkeypatch):
    monkeypatch.setattr(substrings, "_mix", lambda x: x & np.uint64(7))
    rows = [x for x in fixture() if len(x[1] or "") < 2000]
    import pyarrow as pa

    column = pa.array([t for _, t, *_ in rows], pa.string())
    ids = np.array([i for i, *_ in rows])
    with np.errstate(over="ignore"):
        w = substrings.Words(*substrings._column(column))
        place = np.arange(len(w.start)) - w.first[w.text]
        at = np.flatnonzero(place + 13 <= np.diff(w.first)[w.text])
        repeats = substrings.earlier(w, at, ids[w.text[at]], 13)
    first = {}
    say = [w.data[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]
    for k in sorted(range(len(at)), key=lambda k: ids[w.text[at[k]]]):
        first.setdefault(tuple(say[at[k] : at[k] + 13]), ids[w.text[at[k]]])
    assert repeats.tolist() == [bool(first[tuple(say[a : a + 13])] < ids[w.text[a]]) for a in at]


@pytest.mark.parametrize("group_docs", [250_000, 4])
def test_packing(docs, group_docs, monkeypatch):
    from dossier.llm.bpe import encoder

    monkeypatch.setattr(packing, "GROUP_DOCS", group_docs)
    e = encoder(TOKENIZER)
    ids = {i: np.append(e.ids(t) if t else np.zeros(0, np.uint32), np.uint32(1)).astype("<u4") for i, t, *_ in fixture()}
    pieces = packing.pack_documents(docs, TOKENIZER).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        assert p.doc_tokens == len(ids[p.doc_id])
    for i, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length > 0
            at += p.length
        assert at == len(ids[i])
    assert set(by_doc) == set(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 2048 or at & (at - 1) == 0


def test_best_fill_is_best():
    r = random.Random(3)
    for _ in range(200):
        counts = {r.randint(1, 60): r.randint(1, 3) for _ in range(r.randint(0, 6))}
        room = r.randint(0, 100)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
        got = packing.best_fill(counts, room)
        assert sum(n * k for n, k in got.items()) == max(sums) and all(k <= counts[n] for n, k in got.items())


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "same text"), (1, "same text"), (2, None), (None, "x")]])
def test_edges(spark, rows):
    """Empty tables, nulls, repeated rows: no crash, one row each."""
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert tokens.count_tokens(d, TOKENIZER, scratch(spark, "cache")).count() == len(rows)
    assert simhash.near_duplicates(d).count() == len(rows)
    assert lines.drop_lines(d).count() == len(rows)
    assert substrings.cut_repeats(d).count() == len(rows)
    pieces = packing.pack_documents(d, TOKENIZER).collect()
    assert len(pieces) >= len(rows) and {p.doc_id for p in pieces} == {i for i, _ in rows}


def test_digest_of_kept_text(spark, docs):
    from pyspark.sql import functions as F

    got = {r.doc_id: r.h for r in lines.drop_lines(docs).select("doc_id", F.sha2("kept", 256).alias("h")).collect()}
    assert got == {i: hashlib.sha256(x[2].encode()).hexdigest() for i, x in plain_lines(fixture()).items()}
