"""Merges, the catalog, sources, worklists, the grading pass and the stream."""

import datetime
import json

from pyspark.sql import functions as F

from dossier.catalog import Catalog
from dossier.config import FALLBACK_AGENT, Config
from dossier.operators.merge import merge_upsert
from dossier.plans.grading_pass import run_grading_pass
from dossier.schemas import TABLES
from dossier.sources.edgar import company_rows, filing_rows, read_archive, submissions, tickers, write_archive


def as_of():
    return F.lit(datetime.datetime(2024, 5, 1))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_like_sequential_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, s string, n int")
    new = spark.createDataFrame([(1, "x", 10, 1), (3, "first", 30, 2), (3, "last", 31, 3), (1, "y", 11, 4)], "k int, s string, n int, seq int")
    assert rows(merge_upsert(old, new, ("k",), ("n",), "seq")) == [(1, "a", 11), (2, "b", 2), (3, "first", 31)]
    assert rows(merge_upsert(old, new, ("k",), (), "seq")) == [(1, "a", 1), (2, "b", 2), (3, "first", 30)]
    once = merge_upsert(old, new, ("k",), ("n",), "seq")
    assert rows(merge_upsert(once, new, ("k",), ("n",), "seq")) == rows(once)
    assert rows(merge_upsert(old, new.limit(0), ("k",), ("n",), "seq")) == rows(old)


def test_fresh_tables(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/t")
    c.init()
    assert {r.table_name: r.n_rows for r in c.counts().collect()} == dict.fromkeys(TABLES, 0)
    assert c.upsert("companies", c.read("companies")) == 0


def test_upserts_touch_few_buckets_and_keep_readers(spark, tmp_path):
    """A small batch rewrites the buckets of its keys; journals only gain files, until they are written as one."""
    from dossier import catalog as module

    c = Catalog(spark, f"file://{tmp_path}/t", buckets=8)
    grades = spark.range(200).selectExpr("cast(id as string) as accession_number", "'A' as overall_grade")
    assert c.upsert("filing_grades", grades) == 200
    before, reader = dict(map(tuple, c._manifest("filing_grades")["parts"])), c.read("filing_grades")
    assert c.upsert("filing_grades", spark.createDataFrame([("7", "B"), ("7", "C"), ("new", "B")], "accession_number string, overall_grade string")) == 3
    after = dict(map(tuple, c._manifest("filing_grades")["parts"]))
    assert 0 < sum(before[b] != after[b] for b in before) <= 2
    now = {r.accession_number: r.overall_grade for r in c.read("filing_grades").collect()}
    assert len(now) == 201 and now["7"] == "C" and now["8"] == "A"  # without an order, the columns' order
    assert reader.count() == 200
    for k in range(module.MOST_FOLDERS + 3):
        c.upsert("sync_log", spark.createDataFrame([("same" if k % 2 else f"id{k}", k)], "id string, items_synced int"))
    log = {r.id: r.items_synced for r in c.read("sync_log").collect()}
    assert log["same"] == 1 and len(log) == (module.MOST_FOLDERS + 3 + 1) // 2 + 1
    parts = c._manifest("sync_log")["parts"]
    assert all(sum(b == x for x, _ in parts) <= module.MOST_FOLDERS for b, _ in parts)
    assert sorted(r.table_name for r in c.tables().collect()) == ["filing_grades", "sync_log"]


def test_scratch(spark, monkeypatch):
    import os

    import pytest

    from dossier import session

    with session.recorded() as made:
        rows = session.written(spark.range(5), "t")
    path = made[0].removeprefix("file://")
    assert rows.count() == 5 and os.path.isdir(path)
    session.delete(spark, made)
    assert not os.path.exists(path)

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        session.shared_folder(Far)


def test_repeated_stream_batches_have_one_line(spark, tmp_path):
    from dossier.plans.grading_pass import journal

    c = Catalog(spark, f"file://{tmp_path}/t")
    for run in ("r1", "r1", "r2"):
        journal(c, "run_grading_pass", 3, as_of(), run)
    assert sorted(r.id for r in c.read("sync_log").collect()) == ["r1", "r2"]


def test_buckets_grow_with_the_table(spark, tmp_path, monkeypatch):
    from dossier import catalog
    from dossier.plans.grading_pass import journal

    monkeypatch.setattr(catalog, "BUCKET_BYTES", 4000)
    c = Catalog(spark, f"file://{tmp_path}/t", buckets=1)
    sizes = []
    for run in range(5):
        journal(c, "run_grading_pass", run, as_of(), f"r{run}")
        sizes.append(c._manifest("sync_log")["buckets"])
    assert sizes == sorted(sizes) and sizes[0] < sizes[-1] <= 16
    journal(c, "run_grading_pass", 9, as_of(), "r0")  # still meets its old row
    assert sorted((r.id, r.items_synced) for r in c.read("sync_log").collect())[1:] == [(f"r{k}", k) for k in range(1, 5)]
    assert c.read("sync_log").count() == 5
    c.write("sync_log", c.read("sync_log"))
    assert c.read("sync_log").count() == 5 and c._manifest("sync_log")["buckets"] >= sizes[-1]
    c.init()
    assert c.read("companies").count() == 0 and c.tables().count() == 8


def test_sources(spark):
    payload = json.dumps({"0": {"cik_str": 320193, "ticker": "aapl", "title": "Apple"}, "1": {"ticker": "none"}, "2": {"cik_str": "320193", "ticker": "AAPL2", "title": "Apple again"}})
    parsed = tickers(spark.createDataFrame([(payload,)], "value string"))
    assert [tuple(r) for r in parsed.orderBy("seq").collect()] == [(0, "0000320193", "AAPL", "Apple"), (2, "0000320193", "AAPL2", "Apple again")]
    recent = {"accessionNumber": ["a-1", "a-2", "a-3"], "form": ["10-K", "8-K"], "filingDate": ["2024-01-02", ""], "primaryDocument": ["x.htm", ""]}
    got = submissions(spark.createDataFrame([("320193", json.dumps({"filings": {"recent": recent}}))], "cik string, value string"), 2).orderBy("pos").collect()
    assert [(r.accession_number, r.form, str(r.filing_date), r.primary_document) for r in got] == [("a-1", "10-K", "2024-01-02", "x.htm"), ("a-2", "8-K", "None", None)]
    assert got[0].filing_url.endswith("/320193/a1/x.htm") and got[1].filing_url == ""


def test_pass_end_to_end(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/tables")
    c.init()
    payload = spark.createDataFrame([(json.dumps({"0": {"cik_str": 7, "ticker": "abc", "title": "Abc"}}),)], "value string")
    c.upsert("companies", company_rows(tickers(payload), as_of()), "seq")
    recent = {"accessionNumber": ["7-24-1", "7-24-2"], "form": ["10-K", "8-K"], "filingDate": ["2024-01-02", "2024-01-03"], "primaryDocument": ["a.htm", "sub/b.htm"]}
    found = submissions(spark.createDataFrame([("7", json.dumps({"filings": {"recent": recent}}))], "cik string, value string"))
    c.upsert("filings", filing_rows(found, as_of()), "pos")
    body = bytearray(b"<html><body><p>Item 1. Business</p><p>We acquired Widget Works for $ 3 million in cash. Revenue was $ 9 million.</p></body></html>")
    fetched = spark.createDataFrame([("7-24-1", "a.htm", body), ("7-24-2", "sub/b.htm", bytearray(b"")), ("7-24-2", "../x.htm", body)], "accession_number string, document_name string, content binary")
    manifest = write_archive(fetched, f"{tmp_path}/raw", as_of()).cache()
    assert manifest.count() == 2
    assert read_archive(spark, f"{tmp_path}/raw").count() == 1  # Spark passes over empty files
    c.upsert("filing_documents", manifest.join(c.read("filings").select("accession_number", "cik", "form"), "accession_number"))
    graded = run_grading_pass(c, as_of()).collect()
    assert [(g.accession_number, g.ticker, g.form) for g in graded] == [("7-24-1", "ABC", "10-K")]
    assert c.read("filing_transactions").first().purchase_price_usd == 3e6
    metrics = {r.metric_name: (r.metric_value, r.text_value) for r in c.read("filing_metrics").collect()}
    assert metrics["revenue_usd"] == (9e6, "9000000.0") and metrics["word_count"][1].isdigit()
    assert run_grading_pass(c, as_of()).count() == 0  # the empty document stays in the worklist, ungraded
    assert c.read("filing_grades").count() == 1


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("SEC_USER_AGENT", "me me@example.com")
    assert Config.load(str(tmp_path / "x")).user_agent == FALLBACK_AGENT
    monkeypatch.setenv("SEC_USER_AGENT", "me me@site.org")
    assert Config.load(str(tmp_path / "x")).user_agent == "me me@site.org"


def test_entry_is_imported_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)


def test_entry_without_llm(spark):
    import __spark_entry__ as e

    assert len(e.queries()) > 60
    assert set(e.oracle_sql()) <= set(e.queries())


def test_a_merge_moves_its_rows_once(spark):
    """Both sides together, by the key or by given columns; old rows that share a key all stay."""
    from dossier.operators.merge import new_rows

    old = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3), (2, "d", 4), (None, "e", 5)], "k int, s string, n int")
    new = spark.createDataFrame([(1, "x", 9, None), (1, "y", 8, 1), (None, "z", 7, 1), (5, None, 1, 2), (5, "w", 2, 2)], "k int, s string, n int, seq int")
    merged = merge_upsert(old, new, ("k",), ("n",), "seq")
    assert sorted(map(repr, rows_of(merged))) == sorted(map(repr, [(1, "a", 8), (1, "b", 8), (2, "c", 3), (2, "d", 4), (None, "e", 7), (5, None, 2)]))
    assert sorted(map(repr, rows_of(new_rows(old.select("k"), new, ("k",), "seq")))) == [repr((5, None, 1))]
    assert shuffles(merged) == 1
    dealt = {"b": F.col("k") % 2}
    again = merge_upsert(old.withColumns(dealt), new.withColumns(dealt), ("k",), ("n",), "seq", dealt)
    assert sorted(map(repr, rows_of(again.drop("b")))) == sorted(map(repr, rows_of(merged)))
    assert shuffles(again) == 1


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning")


def test_passes_leave_no_shuffles_and_no_whole_texts(spark, tmp_path):
    """Shuffle files of an upsert go with the next, and what a pass keeps meanwhile has no text twice."""
    import os
    import time

    from dossier.plans.grading_pass import enriched

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        files = [files.apply(k) for k in range(files.size())]
        return sum(f.length() for f in files if f.getName().startswith("shuffle_"))

    c = Catalog(spark, f"file://{tmp_path}/t")
    grades = spark.range(200_000).selectExpr("sha2(cast(id as string), 256) as accession_number", "sha2(cast(id + 1 as string), 256) as summary_notes")
    before = shuffled()
    assert c.upsert("filing_grades", grades) == 200_000
    assert shuffled() > before + 1_000_000  # the last plan is held until another one runs
    assert c.upsert("companies", spark.createDataFrame([("1",)], "cik string")) == 1
    for _ in range(40):  # the driver's cleaner works beside it
        if shuffled() <= before + 1_000_000:
            break
        time.sleep(0.5)
    assert shuffled() <= before + 1_000_000
    raw = spark.createDataFrame([("a", "<html><body>Item 1. Business<p>We sell goods to many people.</p></body></html>")], "accession_number string, raw string")
    done = enriched(raw)
    assert "clean_text" not in done.columns and done.first().sections["ITEM_1_BUSINESS"].endswith("many people.")
    assert all(".zstd." in os.path.basename(f) for f in done.inputFiles())


def test_counts_are_of_rows_where_cut_order_numbers_repeat(spark, tmp_path):
    """Two orders of a customer and year whose numbers agree in six of seven digits."""
    from dossier.plans.queries import QUERIES

    spark.range(1, 3).selectExpr("id as c_custkey", "'x' as c_name").write.parquet(f"{tmp_path}/customer.parquet")
    orders = "cast(1000000 + id as bigint) as o_orderkey, cast(1 as bigint) as o_custkey, timestamp'1995-03-01' as o_orderdate, '1-URGENT' as o_orderpriority, 5.0D as o_totalprice"
    spark.range(2, 6).selectExpr(*orders.split(", ")).write.parquet(f"{tmp_path}/orders.parquet")
    counts = dict(map(tuple, QUERIES["table_counts"](spark, str(tmp_path)).collect()))
    assert counts["companies"] == 2 and counts["filings"] == counts["filing_transactions"] == 4 and counts["filing_documents"] == 2


def test_upserts_in_many_shares(spark, tmp_path, monkeypatch):
    """Each key is merged in one share of its bucket, and sorted by its hash."""
    from dossier import catalog

    monkeypatch.setattr(catalog, "TASK_BYTES", 500)
    c = Catalog(spark, f"file://{tmp_path}/t")
    for k in range(2):
        rows = spark.range(k * 1000, 3000).selectExpr("cast(id as string) as accession_number", "'m' as metric_name", f"cast(id + {k} as double) as metric_value", "'x' as clean_text", "'s' as section_name")
        assert c.upsert("filing_metrics", rows) == c.upsert("filing_sections", rows) == 3000 - k * 1000
    now = {r.accession_number: r.metric_value for r in c.read("filing_metrics").collect()}
    assert now == {str(k): float(k + (k >= 1000)) for k in range(3000)}
    assert c.read("filing_metrics").count() == c.read("filing_sections").count() == 3000


def test_ids_are_made_where_new_rows_are_written(spark, tmp_path, monkeypatch):
    """They follow from the key, so they don't move with the rows; old rows keep theirs."""
    from dossier import catalog
    from dossier.functions.pylike import hash_id
    from dossier.plans.grading_pass import enriched, store

    moved, plain = {}, Catalog._typed
    monkeypatch.setattr(catalog.Catalog, "_typed", lambda self, name, rows, seq=None: moved.setdefault(name, plain(self, name, rows, seq)))
    c = Catalog(spark, f"file://{tmp_path}/t")
    text = "Item 1. Business\nWe sell goods to many people.\nWe acquired Alpha Corp for $ 5 million in cash."
    raw = spark.createDataFrame([("a", "1", "T1", "10-K", "m", text)], "accession_number string, cik string, ticker string, form string, document_name string, raw string")
    store(c, enriched(raw), as_of())
    keys = {"filing_sections": ("section", "section_name"), "filing_metrics": ("metric", "metric_name"), "filing_transactions": ("transaction", "seller_target_name"), "filing_grades": ("grade", None)}
    for name, (kind, key) in keys.items():
        expected = hash_id(kind, F.col("accession_number"), *([F.col(key)] if key else []))
        got = c.read(name).select(F.col(f"{kind}_id").alias("id"), expected.alias("expected"), "filing_id", hash_id("filing", F.col("accession_number")).alias("filing")).collect()
        assert got and all(r.id == r.expected and r.filing_id == r.filing for r in got)
        assert moved[name].where(f"{kind}_id is not null or filing_id is not null").count() == 0
    monkeypatch.setattr(catalog.Catalog, "_typed", plain)
    old = spark.createDataFrame([("b", "m", "kept", 1.0)], "accession_number string, metric_name string, metric_id string, metric_value double")
    c.upsert("filing_metrics", old)
    new = spark.createDataFrame([("b", "m", 2.0), ("c", "m", 3.0)], "accession_number string, metric_name string, metric_value double")
    c.upsert("filing_metrics", new, ids={"metric_id": F.concat(F.lit("of "), "accession_number")})
    assert rows(c.read("filing_metrics").where("metric_name = 'm'").select("accession_number", "metric_id", "metric_value")) == [("b", "kept", 2.0), ("c", "of c", 3.0)]


def test_passes_where_cut_order_numbers_repeat(spark, tmp_path):
    """Two of three orders have one number: each document has its grade, as in the SQL, and the journal counts filings."""
    import duckdb

    from dossier.plans.queries import QUERIES, SQL

    spark.range(1, 3).selectExpr("id as c_custkey", "'x' as c_name").write.parquet(f"{tmp_path}/customer.parquet")
    orders = "cast(1000001 + 6 * id as bigint) as o_orderkey, cast(1 as bigint) as o_custkey, timestamp'1995-03-01' as o_orderdate, '1-URGENT' as o_orderpriority, 5.0D + id as o_totalprice"
    spark.range(3).selectExpr(*orders.split(", ")).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for name in ("customer", "orders"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for name, n in (("stream_grading_pass", 5), ("grading_pass_idempotent", 5), ("sync_journal", 2)):
        got = rows(QUERIES[name](spark, str(tmp_path)))
        assert len(got) == n and got == sorted(con.sql(SQL[name]).fetchall())
        assert name != "sync_journal" or {r[1] for r in got} == {3}


def test_upserts_move_some_buckets_at_a_time_and_keep_unchanged_ones(spark, tmp_path, monkeypatch):
    """Rows of a filing lie together; a repeated upsert writes nothing, one new value the bucket of its filing."""
    from dossier import catalog

    saves, save = [], Catalog._save
    monkeypatch.setattr(Catalog, "_save", lambda self, name, df: saves.append(name) or save(self, name, df))
    monkeypatch.setattr(catalog, "MOVED_BYTES", 1)
    c = Catalog(spark, f"file://{tmp_path}/t", buckets=4)
    metrics = spark.range(600).selectExpr("cast(id div 6 as string) as accession_number", "concat('m', id % 6) as metric_name", "if(id % 7 = 0, null, cast(id as double)) as metric_value")
    assert c.upsert("filing_metrics", metrics) == 600 and len(saves) == 4  # a bucket each
    before = c._manifest("filing_metrics")["parts"]
    parts = [(b, c._parts("filing_metrics", [[b, f]]).select("accession_number").distinct().collect()) for b, f in before]
    assert sum(len(x) for _, x in parts) == 100  # each filing in one bucket
    assert c.upsert("filing_metrics", metrics) == 600 and c._manifest("filing_metrics")["parts"] == before
    assert sum(n.startswith("d") for n in c._names(f"{c.root}/filing_metrics")) >= 4 and c.read("filing_metrics").count() == 600
    c.upsert("filing_metrics", metrics.where("accession_number = '3'").withColumn("metric_value", F.when(F.col("metric_name") == "m2", None).otherwise(F.col("metric_value"))))
    after = c._manifest("filing_metrics")["parts"]
    assert len([p for p in after if p not in before]) == 1 and len(after) == len(before)
    got = {(r.accession_number, r.metric_name): r.metric_value for r in c.read("filing_metrics").collect()}
    assert got == {(str(k // 6), f"m{k % 6}"): None if k % 7 == 0 or k == 20 else float(k) for k in range(600)}


def test_tables_of_the_old_layout_are_dealt_anew(spark, tmp_path, monkeypatch):
    from dossier import catalog

    c = Catalog(spark, f"file://{tmp_path}/t", buckets=4)
    metrics = spark.range(60).selectExpr("cast(id div 6 as string) as accession_number", "concat('m', id % 6) as metric_name", "cast(id as double) as metric_value")
    with monkeypatch.context() as m:
        m.setattr(catalog, "LAYOUT", "whole key")
        m.setattr(Catalog, "_bucket", lambda self, name, n: F.pmod(F.xxhash64(*TABLES[name].key), F.lit(n)).cast("int"))
        c.upsert("filing_metrics", metrics)
    monkeypatch.setattr(catalog, "BUCKET_BYTES", 1000)  # and the table grows after
    for _ in range(2):
        c.upsert("filing_metrics", metrics.withColumn("metric_value", F.lit(1.0)))
    assert rows(c.read("filing_metrics").select("accession_number", "metric_name", "metric_value")) == sorted((str(k // 6), f"m{k % 6}", 1.0) for k in range(60))
    assert c._manifest("filing_metrics")["buckets"] > 4
