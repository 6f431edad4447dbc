"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at `distance` differing bits or fewer. With the
bits in m partitions and thresholds t_1 + ... + t_m = distance - m + 1 (each -1
or more; -1 never matches), any two linked fingerprints agree to within t_i
bits in some partition i. Bits that go together are grouped in one partition,
by their correlations over all fingerprints, so that what one partition says is
news to the others; the number of partitions and the thresholds come from a
dynamic program over the candidates that each (partition, threshold) would
give, estimated from the same statistics.

Equal fingerprints are one node, so exact copies cost nothing. A probe is a
signature: the partition's value, with up to t_i bits masked. Fingerprints that
share a signature are verified inside their bucket, which hands on a spanning
forest of its links and never its pairs. Buckets over MOST_IN_BUCKET are split
by what the other bits must still agree on (their own pigeonholes), until none is
too large or all bits are fixed. Linked nodes are joined into components by star
contraction.

Null or empty text, or no words: fingerprint 0, linked like any other. Rows that
share a doc_id stay rows of their own. Null doc_id: kept, and ignored as the
smallest id of a component (null if it has no other). Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import ASCII_LOWER, WORD, bounded_batches, partitions, set_aside, slices
from dossier.llm.components import components
from dossier.session import written

BITS = 64
#: A bucket of more fingerprints than this is split by further bits.
MOST_IN_BUCKET = 4096
_words = re.compile(WORD).findall


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the hashes of the shingles."""
    if not text:
        return 0
    words = _words(text.translate(ASCII_LOWER) if not text.isascii() else text.lower())
    if not words:
        return 0
    line = " ".join(words).encode()
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, seed)
    cuts = [-1, *np.flatnonzero(np.frombuffer(line, np.uint8) == 32).tolist(), len(line)]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(line[i + 1 : j], seed) for i, j in zip(cuts, cuts[width:])]), np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[i : i + 65_536], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, beside: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) and the columns `beside` (longs)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(x) for x in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64)), *(batch.column(c) for c in beside)], ["doc_id", "fp", *beside])

    return docs.select(F.col("doc_id").cast("long"), "text", *beside).mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", "fp", *beside]))


def agreement(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """n and the 64 x 64 counts of fingerprints with both bits set, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((BITS, BITS))
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            bits = ((fps[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
            both += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS), pa.int32()), pa.array(both.astype(np.int64).tolist(), pa.list_(pa.int64()))], ["i", "row"])

    counts = np.zeros((BITS, BITS))
    cells = nodes.select("fp").mapInArrow(run, "i int, row array<long>").select("i", F.posexplode("row").alias("j", "n")).groupBy("i", "j").agg(F.sum("n").alias("n"))
    for i, j, n in cells.collect():  # 4096 rows, whatever the corpus
        counts[i, j] = n
    return nodes.count(), counts


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of near equal size; each grows by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    left, out = set(range(BITS)), []
    for k in range(m):
        size = (BITS - sum(map(len, out))) // (m - k)
        group = [min(left, key=lambda i: (-tie[i, sorted(left)].sum(), i))]
        left.discard(group[0])
        while len(group) < size:
            best = min(left, key=lambda i: (-tie[i, group].mean(), i))
            group.append(best)
            left.discard(best)
        out.append(sorted(group))
    return out


def chance_equal(n: int, both: np.ndarray, bits: list[int]) -> float:
    """Chance that two fingerprints agree on all of `bits`: a tree of the
    strongest pairs stands for their joint distribution."""
    if not bits or not n:
        return 1.0
    p = np.diag(both) / n
    single = {i: p[i] ** 2 + (1 - p[i]) ** 2 for i in bits}

    def pair(i: int, j: int) -> float:
        c = both[i, j] / n
        cells = (c, p[i] - c, p[j] - c, 1 - p[i] - p[j] + c)
        return sum(x * x for x in cells)

    out, inside, rest = single[bits[0]], [bits[0]], list(bits[1:])
    while rest:
        gain, j = max((pair(i, j) / (single[i] * single[j]), j) for i in inside for j in rest)
        out *= min(1.0, single[j] * gain)
        inside.append(j)
        rest.remove(j)
    return out


def allocate(n: int, both: np.ndarray, distance: int, most: int = 4, probe_cost: float = 8.0) -> tuple[list[list[int]], list[int]]:
    """Partitions and thresholds of the least estimated cost: pairs to verify
    plus `probe_cost` for each signature."""
    best: tuple[float, list[list[int]], list[int]] | None = None
    for m in range(1, min(most, distance + 2) + 1):
        groups = group_bits(n, both, m)
        cost = []
        for bits in groups:
            row = {-1: 0.0}
            for t in range(distance + 1):
                signatures = comb(len(bits), t)
                if signatures > 3000:
                    break
                pairs = n * n / 2 * chance_equal(n, both, bits[t:]) * signatures
                row[t] = pairs + probe_cost * n * signatures
            cost.append(row)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in cost:
            after: dict[int, tuple[float, list[int]]] = {}
            for total, (c, ts) in table.items():
                for t, x in row.items():
                    if total + t not in after or c + x < after[total + t][0]:
                        after[total + t] = (c + x, [*ts, t])
            table = after
        found = table.get(distance - m + 1)
        if found and (best is None or found[0] < best[0]):
            best = (found[0], groups, found[1])
    return best[1], best[2]


def _masks(bits: list[int], masked: int) -> np.ndarray:
    """Every mask that keeps `bits` but for `masked` of them."""
    whole = sum(1 << b for b in bits)
    return np.array([whole & ~sum(1 << b for b in out) for out in combinations(bits, masked)], np.uint64)


def signatures(nodes: DataFrame, groups: list[list[int]], thresholds: list[int]) -> DataFrame:
    """mask (the bits that are fixed), value (of those bits), fp."""
    masks = np.concatenate([_masks(bits, t) for bits, t in zip(groups, thresholds, strict=True) if t >= 0]).view(np.int64)
    return nodes.select("fp", F.explode(F.array(*[F.lit(int(m)) for m in masks])).alias("mask")).select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp")


def _split(keyed: DataFrame, distance: int) -> tuple[DataFrame, bool]:
    """Splits the buckets that are too large by pigeonholes of their free bits."""
    large = keyed.groupBy("mask", "value").count().where(F.col("count") > MOST_IN_BUCKET).select("mask", "value")
    large = written(large, "large-buckets")
    if large.isEmpty():
        return keyed, False

    def parts(mask: int) -> list[int]:
        free = [b for b in range(BITS) if not mask >> b & 1]
        return [mask | sum(1 << b for b in free[k :: distance + 1]) for k in range(distance + 1)]

    finer = {m: parts(m & (1 << BITS) - 1) for (m,) in large.select("mask").distinct().collect()}  # no more than there are masks
    rows = [(m, [p - (1 << BITS) if p >> BITS - 1 else p for p in ps]) for m, ps in finer.items()]
    to = keyed.sparkSession.createDataFrame(rows, "mask long, finer array<long>")
    hot = keyed.join(large, ["mask", "value"], "left_semi").join(F.broadcast(to), "mask").select("fp", F.explode("finer").alias("mask"))
    hot = hot.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp")
    return keyed.join(large, ["mask", "value"], "left_anti").unionByName(hot), True


def verify(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the distinct fingerprints of a bucket."""
    n = len(fps)
    label = np.arange(n)
    a: list[int] = []
    b: list[int] = []
    for i in range(0, n - 1, 256):
        near = np.bitwise_count(fps[i : i + 256, None] ^ fps[None, i:]) <= distance
        for x, row in enumerate(near, i):
            others = np.flatnonzero(row) + i
            new, first = np.unique(label[others], return_index=True)
            if len(new) > 1:
                for k in np.flatnonzero(new != label[x]):
                    a.append(x)
                    b.append(int(others[first[k]]))
                label[np.isin(label, new)] = new[0]
    return fps[a], fps[b]


def links(nodes: DataFrame, distance: int) -> DataFrame:
    """a, b: pairs of linked fingerprints that join all that is linked."""
    n, both = agreement(nodes)
    groups, thresholds = allocate(n, both, distance)
    keyed = signatures(nodes, groups, thresholds)
    for _ in range(4):
        keyed, more = _split(keyed, distance)
        if not more:
            break
        keyed = written(keyed.distinct(), "signatures")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def checked() -> pa.RecordBatch:
            x, y = verify(np.array(held, np.int64).view(np.uint64), distance)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

        for batch in batches:
            for mask, value, fp in zip(*(batch.column(c).to_pylist() for c in ("mask", "value", "fp")), strict=True):
                if (mask, value) != now:
                    if len(held) > 1:
                        yield checked()
                    now, held = (mask, value), []
                held.append(fp)
        if len(held) > 1:
            yield checked()

    spread = keyed.repartition(partitions(nodes), "mask", "value").sortWithinPartitions("mask", "value")
    return spread.mapInArrow(run, "a long, b long").distinct()


def rooted(nodes: DataFrame, distance: int) -> DataFrame:
    """nodes (distinct fingerprints) with the root of their component."""
    roots = components(links(nodes, distance)).withColumnRenamed("node", "fp")
    return nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, distance: int = 2) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of all that it reaches)."""
    fps = written(fingerprints(docs), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = written(rooted(nodes, distance), "rooted")
    # As a table, so that the nodes of a large component can be split in the join.
    least = written(found.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    return fps.join(found.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp")


def one_of_each(docs: DataFrame, distance: int = 2) -> DataFrame:
    """One row of each component: that of the smallest doc_id (null above all),
    and of rows that share it, that of the smallest digest of the whole row. Rows
    alike in all columns count as one."""
    docs, key = set_aside(docs, ()), ("__k1", "__k2")
    # Maps have no digest; a null adds nothing to one but its mark.
    names = [F.col(f"`{f.name}`") for f in docs.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]
    own = docs.withColumns({name: F.xxhash64(F.lit(seed), *names, *(c.isNull() for c in names)) for seed, name in enumerate(key)})
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", *key)
    nodes = written(fingerprints(own, key).groupBy("fp").agg(F.min(row).alias("least")), "nodes")
    stays = rooted(nodes, distance).groupBy("root").agg(F.min("least").alias("x")).select("x.*").select(*key)
    return own.join(stays, list(key), "left_semi").dropDuplicates(list(key)).drop(*key)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
