"""Substring dedup by super-k-mer partitioning.

A window is `width` consecutive words; its minimiser is the first of the `seed`-word
runs in it, by an order that begins with rare ones. Consecutive windows that share a minimiser form a
super-k-mer: its words travel once, as one packed string, to the bucket of the
minimiser, so equal windows always meet. There, windows are sorted by a hash of
their word hashes and compared word by word, so counts are exact; each
window that also starts in a document with a smaller doc_id marks its words.

Each task first settles what its own documents repeat: a window that starts in
a smaller document of the same task is marked there and then, and travels no
further, so that a passage in a third of all documents reaches its bucket once
per task and not once per document. The number of buckets follows the size of the
table. A bucket that is over HELD all the same (of a frequent seed) is worked off
in parts of HELD: each part settles what it repeats, and the rest goes to new buckets by
another order of the seeds, where windows that only shared the seed part. So no
task holds more than HELD, for TURNS turns; what is left then has been settled so many
times that only windows of enormous words remain.

The marks come back as word spans by doc_id and 16 bits of the text, each with a
digest of its words; a row is cut only where its words have that digest, so rows that
share a doc_id lose words of their own only.

Null or empty text: no words, kept text empty. Texts shorter than a window lose
nothing. Rows that share a doc_id are one document for all that is compared: none of
them loses what only they hold. Null doc_id is the smallest, so rows without one lose
nothing. Repeated rows have the same result. Other columns stay as they are; one named
like a result gets "_in".
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import bounded_batches, partitions, set_aside, slices
from dossier.session import written

#: Bytes of text that a task settles by itself before it sends on.
CHUNK = 4 << 20
#: Bytes of text per bucket, about: what a worker sorts at once is some 40 times that.
BUCKET = 2 << 20
#: Buckets that one task works off, one after another.
BUCKETS_PER_TASK = 32
#: Bytes a word of seeds that come last.
SHORT = 4
#: Bytes of super-k-mers that a task sorts at once, and the turns for which this holds.
HELD, TURNS = 10 << 20, 6
#: kind 0: super-k-mers (of many documents); kind 1: marks of a document, as (place, length, digest).
ROWS = "kind byte, bucket int, id long, tag int, payload binary"
RESULTS = ("kept", "n_words", "n_removed")
NO_ID = -(1 << 63)
#: The bits of the text's hash that tell rows of one doc_id apart on the way back.
TAG = 0xFFFF
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolled(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` consecutive values, by their order."""
    n = len(values) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for k in range(width):
            out = out * _P + values[k : k + n]
    return _mix(out)


_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """The words of a run of UTF-8 texts: where each starts and ends, its hash,
    the text it belongs to and its place there."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        solid = ~_WHITE[data]
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        begin[inner] = solid[inner]
        end[inner - 1] = solid[inner - 1]
        self.data, self.start, self.end = data, np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """Sums of mixed (byte, place), eight bytes at a time."""
        n = self.end - self.start
        out = n.astype(np.uint64) * _P
        padded = np.concatenate((self.data, np.zeros(8, np.uint8)))
        eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
        at, left, who = self.start.copy(), n.copy(), np.arange(len(n))
        while len(who):
            value = np.ascontiguousarray(eight[at]).view(np.uint64).ravel()
            short = np.minimum(left, 8).astype(np.uint64)
            keep = np.where(short == 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (short % np.uint64(8) * np.uint64(8))) - np.uint64(1))
            out[who] = _mix((out[who] ^ (value & keep)) * _P + np.uint64(1))
            more = left > 8
            at, left, who = at[more] + 8, left[more] - 8, who[more]
        return out


def _column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _same(words: Words, x: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """Whether the windows at x and at y are equal, byte by byte of each word."""
    out = np.ones(len(x), bool)
    length = words.end - words.start
    for k in range(width):
        p, q = x + k, y + k
        out &= (length[p] == length[q]) & (words.hash[p] == words.hash[q])
    sure = np.flatnonzero(out)
    padded = np.concatenate((words.data, np.zeros(8, np.uint8)))
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    for k in range(width):
        at, to, left, who = words.start[x[sure] + k], words.start[y[sure] + k], length[x[sure] + k], sure
        while len(who):
            differ = eight[at] != eight[to]
            differ &= np.arange(8) < left[:, None]
            out[who[differ.any(1)]] = False
            more = left > 8
            at, to, left, who = at[more] + 8, to[more] + 8, left[more] - 8, who[more]
    return out


def earlier(words: Words, at: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """For the windows at `at` of documents `doc`: whether an equal window has a
    smaller document."""
    hashes = _rolled(words.hash, width)[at] if len(at) else np.zeros(0, np.uint64)
    order = np.lexsort((doc, hashes))  # stable, so places of a document stay in order
    h, d, a = hashes[order], doc[order], at[order]
    head = np.ones(len(a), bool)
    head[1:] = h[1:] != h[:-1]
    group = np.cumsum(head) - 1
    firsts = np.flatnonzero(head)
    lead = firsts[group]
    equal = lead == np.arange(len(a))
    rest = np.flatnonzero(~equal)
    equal[rest] = _same(words, a[rest], a[lead[rest]], width)
    repeats = np.zeros(len(a), bool)
    repeats[order] = equal & (d > d[lead])
    for g in np.unique(group[~equal]):  # different windows under one hash: settled one by one
        seen: dict[bytes, int] = {}
        for k in range(firsts[g], len(a) if g + 1 == len(firsts) else firsts[g + 1]):
            key = b" ".join(words.data[words.start[i] : words.end[i]].tobytes() for i in range(a[k], a[k] + width))
            repeats[order[k]] = d[k] > seen.setdefault(key, int(d[k]))
    return repeats


def spans(where: np.ndarray, width: int, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of what windows at `where` (sorted) cover, within `same` (their text)."""
    if not len(where):
        return where, where
    new = np.ones(len(where), bool)
    new[1:] = (where[1:] > where[:-1] + width) | (same[1:] != same[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(where)) - 1
    return where[begin], where[end] + width - where[begin]


def _minimisers(words: Words, at: np.ndarray, width: int, seed: int, turn: int) -> np.ndarray:
    """The first seed of each window in the order of this turn: those of SHORT bytes a
    word or fewer come last, then by hash. Frequent words are short, so a frequent phrase
    leads a window only if there is nothing else in it."""
    length = np.concatenate(([0], np.cumsum(words.end - words.start)))
    short = (length[seed:] - length[:-seed] <= SHORT * seed).astype(np.uint64)
    small = short << np.uint64(63) | _rolled(words.hash ^ (_P * np.uint64(turn)), seed) >> np.uint64(1)
    out = small[at]
    for k in range(1, width - seed + 1):
        out = np.minimum(out, small[at + k])
    return out


class Runs:
    """Runs of words of documents: whole texts, or super-k-mers. id and tag say whose a
    run is, base at which word of the document it begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, tags: np.ndarray, base: np.ndarray):
        with np.errstate(over="ignore"):
            self.words = Words(data, offsets)
        self.ids, self.tags = ids, tags
        inside = np.arange(len(self.words.start)) - self.words.first[self.words.text]
        self.left = np.diff(self.words.first)[self.words.text] - inside  # words of the run from here on
        self.place = inside + base[self.words.text]

    def settle(self, width: int) -> tuple[np.ndarray, list[tuple[int, int, int, int, int]]]:
        """The windows that repeat no smaller document of these runs, and the marks of those
        that do: (id, tag, place, length, digest of the words)."""
        words = self.words
        at = np.flatnonzero(self.left >= width)
        with np.errstate(over="ignore"):
            repeats = earlier(words, at, self.ids[words.text[at]], width)
        gone = at[repeats]
        start, length = spans(gone, width, words.text[gone])
        owner, raw = words.text[start], words.data.tobytes() if len(start) else b""
        said = [digest(raw[a:b].split()) for a, b in zip(words.start[start].tolist(), words.end[start + length - 1].tolist(), strict=True)]
        return at[~repeats], list(zip(self.ids[owner].tolist(), self.tags[owner].tolist(), self.place[start].tolist(), length.tolist(), said, strict=True))

    def super_kmers(self, at: np.ndarray, buckets: int, width: int, seed: int, turn: int) -> Iterator[pa.RecordBatch]:
        """Rows of kind 0: the windows at `at`, as packed runs by the bucket of their minimiser."""
        if not len(at):
            return
        words = self.words
        with np.errstate(over="ignore"):
            least = _minimisers(words, at, width, seed, turn)
            new = np.ones(len(at), bool)
            new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1) | (words.text[at[1:]] != words.text[at[:-1]])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(at)) - 1
            bucket = (_mix(least[head]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        lo, hi = words.start[at[head]], words.end[at[tail] + width - 1]
        owner = words.text[at[head]]
        ids, tags, where, size = self.ids[owner], self.tags[owner].astype(np.uint16), self.place[at[head]].astype(np.int32), (hi - lo).astype(np.int32)
        ends = np.flatnonzero(np.diff(bucket[order], append=-1))
        begin = np.concatenate(([0], ends[:-1] + 1))
        raw, keys, blobs, pack = words.data.tobytes(), [], [], zstandard.ZstdCompressor(level=3).compress
        for i, j in zip(begin, ends, strict=True):
            own = order[i : j + 1]
            text = b"".join([raw[a:b] for a, b in zip(lo[own].tolist(), hi[own].tolist(), strict=True)])
            keys.append(bucket[own[0]])
            steps = np.diff(ids[own], prepend=0)  # small, as documents come in order
            blobs.append(len(own).to_bytes(4, "little") + len(text).to_bytes(4, "little") + pack(steps.tobytes() + where[own].tobytes() + size[own].tobytes() + tags[own].tobytes() + text))
        yield _rows(0, keys, [0] * len(keys), [0] * len(keys), blobs)

    @classmethod
    def unpack(cls, blobs: list[bytes]) -> Runs:
        meta, texts, unpack = [], [], zstandard.ZstdDecompressor().decompress
        for blob in blobs:
            n, raw = int.from_bytes(blob[:4], "little"), unpack(memoryview(blob)[8:])
            meta.append((np.cumsum(np.frombuffer(raw, np.int64, n)), *(np.frombuffer(raw, np.int32, n, k * n) for k in (8, 12)), np.frombuffer(raw, np.uint16, n, 16 * n)))
            texts.append(raw[18 * n :])
        ids, base, size, tags = (np.concatenate(x) for x in zip(*meta, strict=True))
        return cls(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum(size))), ids, tags.astype(np.int64), base.astype(np.int64))


def digest(words: list[bytes]) -> int:
    """64 bits of a run of words, signed."""
    return int.from_bytes(xxhash.xxh3_64_digest(b" ".join(words)), "big", signed=True)


def _rows(kind: int, bucket: list[int], ids: list[int], tags: list[int], payload: list[bytes]) -> pa.RecordBatch:
    columns = pa.array([kind] * len(bucket), pa.int8()), pa.array(bucket, pa.int32()), pa.array(ids, pa.int64()), pa.array(tags, pa.int32()), pa.array(payload, pa.binary())
    return pa.RecordBatch.from_arrays(list(columns), ["kind", "bucket", "id", "tag", "payload"])


def _marks(marks: list[tuple[int, int, int, int, int]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of kind 1: the marks of a document, packed. Their bucket only spreads them."""
    if not marks:
        return
    marks.sort()
    table = np.array(marks, np.int64)
    begin = np.flatnonzero(np.append(True, (table[1:, :2] != table[:-1, :2]).any(1)))
    own = [(int(table[i, 0]), int(table[i, 1]), table[i:j, 2:].tobytes()) for i, j in zip(begin, [*begin[1:], len(table)], strict=True)]
    for k in range(0, len(own), 4096):
        ids, tags, payload = zip(*own[k : k + 4096], strict=True)
        yield _rows(1, [(i ^ t) % buckets for i, t in zip(ids, tags, strict=True)], list(ids), list(tags), list(payload))


def super_kmers(docs: DataFrame, buckets: int, width: int, seed: int) -> DataFrame:
    """ROWS of the table's texts: super-k-mers, and what tasks settle by themselves. docs: __id, __tag, text."""

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, tags = (table.column(c).to_numpy().astype(np.int64) for c in ("__id", "__tag"))
        runs = Runs(*_column(table.column("text").combine_chunks()), ids, tags, np.zeros(len(ids), np.int64))
        # Windows of the smallest document here travel, with their copies within it.
        at, marks = runs.settle(width)
        yield from _marks(marks, buckets)
        yield from runs.super_kmers(at, buckets, width, seed, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches, "text"):
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= CHUNK:
                yield from settle(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from settle(pa.Table.from_batches(held))

    return docs.select("__id", "__tag", "text").mapInArrow(run, ROWS)


def count_buckets(rows: DataFrame, buckets: int, width: int, seed: int, tasks: int, turn: int) -> DataFrame:
    """ROWS: the marks that each bucket finds and those that came along; and, of buckets over
    HELD, what they leave to the next turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, over, size = None, False, 0
        held: list[bytes] = []

        def settle(more: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if held:
                runs = Runs.unpack(held)
                held, size = [], 0
                at, marks = runs.settle(width)
                yield from _marks(marks, buckets)
                if more:
                    yield from runs.super_kmers(at, buckets, width, seed, turn + 1)

        for batch in batches:
            is_mark = pc.equal(batch.column("kind"), 1)
            if pc.any(is_mark).as_py():
                yield batch.filter(is_mark)
                batch = batch.filter(pc.invert(is_mark))
            for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                raw = int.from_bytes(payload[4:8], "little")
                if bucket != now:
                    yield from settle(over)
                    now, over = bucket, False
                elif held and size + raw > HELD and turn < TURNS:
                    over = True
                    yield from settle(True)
                held.append(payload)
                size += raw
        yield from settle(over)

    return rows.repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, ROWS)


def cut_repeats(docs: DataFrame, width: int = 13, seed: int = 2) -> DataFrame:
    """docs with kept (its remaining words, one space between), n_words, n_removed."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = set_aside(docs, RESULTS)
    own = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__tag": F.xxhash64("text").bitwiseAND(F.lit(TAG)).cast("int")})
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET))
    tasks = max(1, min(buckets, max(partitions(docs), buckets // BUCKETS_PER_TASK)))
    rows, marks = super_kmers(own, buckets, width, seed), None
    for turn in range(1, TURNS + 1):
        found = written(count_buckets(rows, buckets, width, seed, tasks, turn), "substring-marks")
        new = found.where("kind = 1").select(F.col("id").alias("__id"), F.col("tag").alias("__tag"), "payload")
        marks = new if marks is None else marks.unionByName(new)
        rows = found.where("kind = 0")
        if rows.isEmpty():
            break
    marks = marks.groupBy("__id", "__tag").agg(F.collect_set("payload").alias("__marks"))
    fields = docs.schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", kept string, n_words long, n_removed long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            kept, n_words, n_removed = [], [], []
            for text, marks in zip(batch.column("text").to_pylist(), batch.column("__marks").to_pylist(), strict=True):
                words = (text or "").encode().split()
                n_words.append(len(words))
                if marks:
                    change = np.zeros(len(words) + 1, np.int64)
                    for place, length, said in np.frombuffer(b"".join(marks), np.int64).reshape(-1, 3).tolist():
                        # Another row may share doc_id and tag: its marks hold where the words are the same.
                        if place + length <= len(words) and digest(words[place : place + length]) == said:
                            change[place] += 1
                            change[place + length] -= 1
                    gone = np.cumsum(change[:-1]) > 0
                    words = [words[k] for k in np.flatnonzero(~gone).tolist()]
                kept.append(b" ".join(words).decode())
                n_removed.append(n_words[-1] - len(words))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], [*(f.name for f in fields), *RESULTS])

    joined = own.join(marks, ["__id", "__tag"], "left")
    return joined.select(*[F.col(f"`{f.name}`") for f in fields], "__marks").mapInArrow(cut, schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cut_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Fixed value of the contract: windows of 13 words.
OP4_SQL = r"""
with split as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), windows as (
  select doc_id, k, array_to_string(w[k:k + 12], ' ') as win from (select doc_id, w, unnest(range(1, len(w) - 11)) as k from split where len(w) >= 13)
), least as (select win, min(doc_id) as first from windows group by win),
gone as (
  select distinct doc_id, k + j as place from windows join least using (win), (select unnest(range(13)) as j) where first < doc_id
), words as (
  select doc_id, unnest(w) as word, generate_subscripts(w, 1) as place from split
), kept as (
  select doc_id, count(*) as n_kept, string_agg(word, ' ' order by place) as kept from words anti join gone using (doc_id, place) group by doc_id
)
select doc_id, len(w) as n_words, len(w) - coalesce(n_kept, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from split left join kept using (doc_id)
"""
