"""Line dedup over a sharded minimal perfect hash.

1. Each task counts the keys of its lines (128-bit hashes, equal ones merged) and
   sends (hash, documents, largest doc_id); sums give each distinct line's
   number of documents.
2. The distinct hashes that reach `min_docs` are dealt to shards; a shard is a
   minimal perfect hash over them that indexes arrays of fingerprints, counts
   and last documents. Hashes below `min_docs` never cause a drop: leaving
   them out changes nothing, as a stranger is exposed by its fingerprint.
3. Documents probe. A line held by more than 1 / HOT_SHARE of all counted lines
   is hot: there can be no more than HOT_SHARE such lines, so their index has a
   proven bound and goes to every task. Probes of all other lines go to their
   shard as packed arrays of (hash, document, row key, line), so lines never join lines
   and no shard gets a hot line's probes.
4. The line numbers to drop come back to their rows by a key of doc_id and text
   (128 bits), and the rows are cut. Rows of one key lose the same lines; a
   doc_id alone, null above all, can stand for different texts.

Null or empty text: one empty line, kept. Each row counts as a document; rows
that share a doc_id lose or keep a line together, each where its own text has it.
Null doc_id: below all others. A line repeated within a document counts once and is lost or kept with
its copies. Other columns stay as they are; one named like a result gets "_in".
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import SPACE, bounded_batches, set_aside, slices
from dossier.llm.perfecthash import LineIndex
from dossier.session import written

#: At most so many lines are hot, whatever the corpus.
HOT_SHARE = 20_000
#: Lines of a shard, about: its index takes some 30 bytes a line.
SHARD_LINES = 2_000_000
#: Distinct lines that a task holds before it sends its counts on.
HELD_LINES = 500_000
NO_ID = -(1 << 63)
RESULTS = ("kept", "n_lines", "n_dropped")
#: The two halves of a row's key.
KEY = ["__k1", "__k2"]


def line_hashes(text: str | None, min_chars: int) -> list[tuple[int, bytes]]:
    """(line number, 16 bytes) of each line whose key is long enough."""
    digest = xxhash.xxh3_128_digest
    # lower() of bytes changes A-Z only
    return [(k, digest(key.encode().lower())) for k, line in enumerate((text or "").split("\n")) if len(line) >= min_chars and len(key := line.strip(SPACE)) >= min_chars]


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with KEY."""
    return docs.withColumns({name: F.xxhash64(F.lit(seed), "doc_id", "text") for seed, name in enumerate(KEY)})


def count_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """a, b (halves of the hash), n (documents that hold the line), last (the largest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            a, b = _halves(list(held))
            n, last = (pa.array([x[k] for x in held.values()], pa.int64()) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), n, last], ["a", "b", "n", "last"])

        for batch in slices(batches, "text"):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                doc = NO_ID if doc is None else doc
                for digest in {d for _, d in line_hashes(text, min_chars)}:
                    x = held.get(digest)
                    if x is None:
                        held[digest] = [1, doc]
                    else:
                        x[0] += 1
                        x[1] = max(x[1], doc)
            if len(held) >= HELD_LINES:
                yield flush()
                held.clear()
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "a long, b long, n long, last long").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def build_shards(lines: DataFrame, shards: int) -> DataFrame:
    """shard, index: one row per shard that has lines."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        a, b, n, last = (table.column(c).to_numpy() for c in ("a", "b", "n", "last"))
        index = LineIndex.build(a.view(np.uint64), b.view(np.uint64), n.astype(np.uint32), last)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "index": pa.array([index.dump()], pa.binary())})

    return lines.withColumn("shard", F.pmod("a", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(run, "shard int, index binary")


def drops(docs: DataFrame, shards: DataFrame, n_shards: int, hot: LineIndex, min_chars: int) -> DataFrame:
    """KEY, line: what the shards say of all lines that aren't hot. docs: with KEY."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows, numbers, digests = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                for k, d in line_hashes(text, min_chars):
                    rows.append(row)
                    numbers.append(k)
                    digests.append(d)
            if not digests:
                continue
            a, b = _halves(digests)
            cold = ~hot.probe(a, b)[0]
            a, b, row, number = a[cold], b[cold], np.array(rows, np.int64)[cold], np.array(numbers, np.int64)[cold]
            of_row = [c.to_numpy().view(np.uint64)[row] for c in (batch.column("doc_id").fill_null(NO_ID), *(batch.column(c) for c in KEY))]
            shard = np.mod(a.view(np.int64), n_shards)
            order = np.argsort(shard, kind="stable")
            packed = np.stack((a, b, *of_row, number.view(np.uint64)), 1)[order]
            ends = np.flatnonzero(np.diff(shard[order], append=-1))
            starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
            yield pa.RecordBatch.from_arrays([pa.array(shard[order][ends].astype(np.int32)), pa.array([packed[i : j + 1].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary())], ["shard", "probes"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index = None, None
        for batch in batches:
            for shard, blob, probes in zip(*(batch.column(c).to_pylist() for c in ("shard", "index", "probes")), strict=True):
                if blob is not None:
                    now, index = shard, LineIndex.load(blob)
                    continue
                if shard != now:  # no line of this shard is frequent
                    continue
                a, b, owner, *rest = np.frombuffer(probes, np.uint64).reshape(-1, 6).T.copy()
                found, slot = index.probe(a, b)
                lose = found.copy()
                lose[found] = owner.view(np.int64)[found] != index.last[slot[found]]
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)[lose]) for x in rest], [*KEY, "line"])

    probes = docs.select("doc_id", "text", *KEY).mapInArrow(ask, "shard int, probes binary")
    both = shards.select("shard", "index", F.lit(None).cast("binary").alias("probes")).unionByName(probes.select("shard", F.lit(None).cast("binary").alias("index"), "probes"))
    # The index of a shard sorts before its probes, which then stream past it.
    met = both.repartition(n_shards, "shard").sortWithinPartitions("shard", F.col("index").isNull())
    return met.mapInArrow(answer, ", ".join(f"{c} long" for c in [*KEY, "line"]))


def drop_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """docs with `kept` (the text without its dropped lines), n_lines, n_dropped."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = set_aside(docs, RESULTS)
    lines = written(count_lines(docs, min_chars).where(F.col("n") >= min_docs), "lines")
    seen = lines.agg(F.count("*"), F.sum("n")).first()
    n_shards = max(1, -(-seen[0] // SHARD_LINES), min(seen[0] // 1000, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    often = -(-(seen[1] or 0) // HOT_SHARE)
    rows = lines.where(F.col("n") > max(often, min_docs)).toArrow()  # no more than HOT_SHARE rows
    hot = LineIndex.build(*(rows.column(c).to_numpy().view(np.uint64) for c in ("a", "b")), rows.column("n").to_numpy().astype(np.uint32), rows.column("last").to_numpy())
    shards = written(build_shards(lines.where(F.col("n") <= max(often, min_docs)), n_shards), "line-shards")
    own = keyed(docs)
    lost = drops(own, shards, n_shards, hot, min_chars).distinct().groupBy(*KEY).agg(F.collect_list("line").alias("__lost"))
    joined = own.join(lost, KEY, "left")
    fields = [f for f in docs.schema.fields]
    kept_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", kept string, n_lines long, n_dropped long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            kept, n_lines, n_dropped = [], [], []
            for doc, text, lost in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "__lost")), strict=True):
                every = (text or "").split("\n")
                gone = set(lost or ())
                if len(hot.prints) and (own := line_hashes(text, min_chars)):
                    found, slot = hot.probe(*_halves([d for _, d in own]))
                    doc = NO_ID if doc is None else doc
                    gone.update(own[k][0] for k in np.flatnonzero(found) if hot.last[slot[k]] != doc)
                kept.append("\n".join(x for k, x in enumerate(every) if k not in gone) if gone else text or "")
                n_lines.append(len(every))
                n_dropped.append(len(gone))
            columns = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*(f.name for f in fields), *RESULTS])

    return joined.select(*[F.col(f"`{f.name}`") for f in fields], "__lost").mapInArrow(cut, kept_schema)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


#: Fixed values of the contract: 3 documents, 20 code points.
OP3_SQL = r"""
with rows as (select row_number() over () as n, doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents), lines as (
  select n, doc_id, unnest(l) as line, generate_subscripts(l, 1) as k from rows
), keyed as (
  select *, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines
), frequent as (
  select key, max(doc_id) as last from keyed where length(key) >= 20 group by key having count(distinct n) >= 3
)
select doc_id, count(*) as n_lines, count(*) filter (lost) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by k) filter (not lost), '')) as kept_sha256
from (select keyed.*, key in (select key from frequent) and last is distinct from doc_id as lost from keyed left join frequent using (key)) group by n, doc_id
"""
