"""Packing documents into training windows by minimum bin slack.

Each task tokenises its documents and packs bounded groups of them on its own:
nothing is shuffled, and no group outgrows a task. Within a group, full windows
are cut off long documents first; what remains of each is shorter than a window.
The multiset of remaining lengths is then packed window by window: the longest
length opens a window, and a bounded subset-sum over the distinct lengths finds
the multiset that fills it closest to capacity. A bitset per number of lengths
used holds the reachable sums, and the counts are read back from the bitsets.
Pieces of equal length are interchangeable, so a found multiset is used as often
as the counts allow. Where no multiset fills a window exactly, the next piece is
cut to do so; the last ids of a group go into windows whose lengths are powers
of two, which need no padding.

Null or empty text: one piece that holds the end id alone. Null doc_id and
repeated rows: packed like others, each row on its own. An empty table has no
pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from dossier.llm.bpe import encoder
from dossier.llm.common import bounded_batches, slices

#: Ids (64 MB) and documents (some 200 bytes each) that a task gathers before it packs them.
GROUP_IDS, GROUP_DOCS = 16_000_000, 250_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset within `counts` whose sum is the largest up to `room`, by
    subset-sum over bitsets; of equal sums, the one with more of the long lengths."""
    lengths = sorted((n for n in counts if n <= room and counts[n] > 0), reverse=True)
    mask = (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []  # length, how many this step adds, sums reachable before it
    reach = 1
    for n in lengths:
        left, unit = min(counts[n], room // n), 1
        while left > 0 and not reach >> room & 1:
            take = min(unit, left)
            steps.append((n, take, reach))
            reach |= (reach << n * take) & mask
            left, unit = left - take, unit * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, Counter()
    for n, take, before in reversed(steps):
        if not before >> total & 1:
            used[n] += take
            total -= n * take
    return dict(used)


def plan(lengths: Counter, window: int) -> Iterator[tuple[dict[int, int], int]]:
    """Multisets of lengths below the window, and how many windows each fills."""
    left = Counter({n: c for n, c in lengths.items() if c > 0})
    order = sorted(left, reverse=True)
    while order:
        while order and not left[order[0]]:
            order.pop(0)
        if not order:
            return
        seed = order[0]
        left[seed] -= 1
        used = Counter(best_fill(left, window - seed))
        left[seed] += 1
        used[seed] += 1
        times = min(left[n] // k for n, k in used.items())
        yield dict(used), times
        for n, k in used.items():
            left[n] -= k * times


def pack(sizes: list[int], window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece. Every sequence
    is full, but for the last few, whose lengths are powers of two."""
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    rest: dict[int, list[tuple[int, int]]] = defaultdict(list)  # length: (document, start)
    for d, size in enumerate(sizes):
        start = 0
        while size - start >= window:
            pieces.append((d, start, window, sequence, 0))
            sequence, start = sequence + 1, start + window
        if start < size:
            rest[size - start].append((d, start))
    loose: list[tuple[int, int, int]] = []  # what lies in windows that aren't full
    for used, times in plan(Counter({n: len(x) for n, x in rest.items()}), window):
        full = sum(n * k for n, k in used.items()) == window
        for _ in range(times):
            offset = 0
            for n, k in sorted(used.items(), reverse=True):
                for _ in range(k):
                    d, start = rest[n].pop()
                    if full:
                        pieces.append((d, start, n, sequence, offset))
                        offset += n
                    else:
                        loose.append((d, start, n))
            sequence += full
    left = sum(n for _, _, n in loose)
    room, offset = 0, 0
    for d, start, n in loose:
        while n:
            if not room:
                room = window if left >= window else 1 << (left.bit_length() - 1)
                offset = 0
            take = min(n, room)
            pieces.append((d, start, take, sequence, offset))
            d, start, n, offset, room, left = d, start + take, n - take, offset + take, room - take, left - take
            sequence += not room
    return pieces


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece, as PIECES; the id `end_id` follows each document."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).ids, np.array([end_id], np.uint32)
        first = TaskContext.get().partitionId() << 40
        names: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal first
            pieces = pack([len(x) for x in ids], window)
            for i in range(0, len(pieces), 10_000):
                part = pieces[i : i + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[p[0]] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64()), pa.array([p[2] for p in part], pa.int64()),
                        pa.array([zlib.crc32(ids[d][s : s + n]) for d, s, n, _, _ in part], pa.int64()), pa.array([len(ids[p[0]]) for p in part], pa.int64()),
                        pa.array([first + p[3] for p in part], pa.int64()), pa.array([p[4] for p in part], pa.int64()),
                    ], PIECES.replace(" long", "").split(", "),
                )
            first += 1 + max((p[3] for p in pieces), default=-1)

        for batch in slices(batches, "text"):
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                names.append(name)
                ids.append(np.concatenate((encode(text), end)) if text else end)
                held += len(ids[-1])
                if held >= GROUP_IDS or len(names) >= GROUP_DOCS:
                    yield from packed()
                    names, ids, held = [], [], 0
        yield from packed()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
