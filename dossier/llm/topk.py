"""Exact top-k by inner product with MaxScore.

A dimension is a term, a component its weight. Candidates are dealt to shards of
a bounded number of bytes; every block of queries visits every shard. A shard keeps
blocks of candidates, and a block a posting list per term: the candidates whose component
is not zero, in order, and their weights (no list of candidates where all have the
term, as in dense vectors). For a query, block after block: terms are sorted by the
most that they can add to the query's score in this block. Those whose bounds together
stay below the k-th best score so far are non-essential: only the others'
postings are traversed, and the remaining terms of a candidate are looked up, largest
bound first, while it can still reach the k-th best. The shards' k best of each
query are merged.

All components are whole numbers (floor(1024 x)), so scores are exact: sums
that stay below 2^53 in doubles, below 2^62 in 64-bit integers, others in Python's integers; a
score beyond 64 bits counts as the nearest 64-bit number. Vectors that are null or hold null or non-finite components (before or after the product with 1024) take no
part, nor do rows without vec_id.
Vectors of unequal lengths meet over the components that both have. Rows that
share a vec_id are candidates of their own, and one query (the smallest vector that takes part);
a query's own id is never its candidate. Fewer candidates than k: all of
them. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.common import bounded_batches, partitions

#: Bytes of a shard's vectors, about, at two bytes a component; a task holds some three times that. Query blocks
#: move once per shard, so that shards are as large as a task can hold, but a core has one where there are rows for it.
SHARD_BYTES, LEAST_SHARD_ROWS = 64 << 20, 8192
BLOCK_ROWS, QUERY_ROWS = 1024, 256
PROBED_AT_ONCE = 8
SCALE = 1024
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """ids and whole-number vectors (doubles) of the rows that take part."""
    ids, out = [], []
    for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
        if i is None or not v.is_valid or v.values.null_count:
            continue
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(v.values.to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
        if np.isfinite(x).all():
            ids.append(i)
            out.append(x)
    return np.array(ids, np.int64), out


def _pack(ids: np.ndarray, vectors: list[np.ndarray]) -> bytes:
    width = max((len(v) for v in vectors), default=0)
    flat = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        flat[k, : len(v)] = v
    small = flat.astype(np.int16) if not flat.size or np.abs(flat).max() < 32768 else flat
    return len(ids).to_bytes(4, "little") + bytes([small.itemsize]) + ids.tobytes() + small.tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, item = int.from_bytes(blob[:4], "little"), blob[4]
    ids = np.frombuffer(blob, np.int64, n, 5)
    return ids, np.frombuffer(blob, np.int16 if item == 2 else np.float64, offset=5 + 8 * n).reshape(n, -1)


def _whole(x: np.ndarray, number: type) -> np.ndarray:
    """Whole numbers as `number`; object: as Python's integers, of any size."""
    if number is not object:
        return x.astype(number)
    out = np.empty(x.size, object)
    out[:] = [int(v) for v in x.ravel().tolist()]
    return out.reshape(x.shape)


class Block:
    """Posting lists of some candidates: by term, weights[term] of the candidates at[term] (None: of all)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.low, self.high = ids, vectors.min(0).astype(np.float64), vectors.max(0).astype(np.float64)
        self.weights = np.ascontiguousarray(vectors.T)  # those of a term lie side by side
        self.full = (vectors != 0).all(0)
        self.at = [None if whole else np.flatnonzero(own) for whole, own in zip(self.full, self.weights, strict=True)]

    def traverse(self, weights: np.ndarray, terms: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The candidates that a posting of `terms` names, and their scores so far."""
        score = np.zeros(len(self.ids), query.dtype)
        whole = self.full[terms]
        if whole.any():
            score += query[terms[whole]] @ weights[terms[whole]]
        if whole.all() and len(terms):
            return np.arange(len(score)), score
        met = np.full(len(score), whole.any())
        for t in terms[~whole].tolist():
            score[self.at[t]] += query[t] * weights[t, self.at[t]]
            met[self.at[t]] = True
        at = np.flatnonzero(met)
        return at, score[at]


class Best:
    """The k best of a query so far, ties to the smaller id; floor: the least of k."""

    def __init__(self, number: type):
        self.ids, self.scores, self.floor = np.zeros(0, np.int64), np.zeros(0, number), None

    def add(self, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
        if scores.dtype == object:
            scores = np.clip(scores, LEAST, MOST)
        ids, scores = np.append(self.ids, ids), np.append(self.scores, scores)
        if len(ids) > k:
            first = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[first], scores[first]
        self.ids, self.scores = ids, scores
        if len(ids) == k and scores.min() > LEAST:
            self.floor = scores.min()


class Shard:
    """Blocks of candidates in the order of their ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        self.width = vectors.shape[1]
        self.peak = max(abs(float(vectors.max())), abs(float(vectors.min()))) if vectors.size else 0.0
        self.blocks = [Block(ids[i : i + BLOCK_ROWS], vectors[order[i : i + BLOCK_ROWS]]) for i in range(0, len(ids), BLOCK_ROWS)]

    def search(self, own: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the k best candidates of each query, whose ids are `own`."""
        width = min(queries.shape[1], self.width)
        queries = queries[:, :width].astype(np.float64)
        # Python's integers, as a product of doubles may be infinite.
        bound = width * int(self.peak) * int(np.abs(queries).max(initial=1))
        number = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object
        queries, best = _whole(queries, number), [Best(number) for _ in own]
        for block in self.blocks:
            weights, low, high = (_whole(x[:width], number) for x in (block.weights, block.low, block.high))
            for name, query, found in zip(own.tolist(), queries, best, strict=True):
                at, score = self._probe(block, weights, np.maximum(np.maximum(query * low, query * high), 0), query, found.floor)
                alive = block.ids[at] != name
                if found.floor is not None:
                    alive &= score >= found.floor
                found.add(block.ids[at][alive], score[alive], k)
        return [(x.ids, x.scores) for x in best]

    @staticmethod
    def _probe(block: Block, weights: np.ndarray, most: np.ndarray, query: np.ndarray, floor) -> tuple[np.ndarray, np.ndarray]:
        """The candidates of a block that reach `floor`, and maybe others; `most`: what each term can add."""
        order = np.argsort(-most, kind="stable")
        rest = np.append(np.cumsum(most[order][::-1])[::-1], 0)  # what the terms from here on can add
        essential = len(order) if floor is None else int(np.count_nonzero(rest[:-1] >= floor))
        at, score = block.traverse(weights, order[:essential], query)
        if len(at) < len(block.ids) and (floor is None or floor <= 0):  # a candidate that no posting names counts too
            every = np.zeros(len(block.ids), query.dtype)
            every[at] = score
            at, score = np.arange(len(every)), every
        for j in range(essential, len(order), PROBED_AT_ONCE):
            alive = score + rest[j] >= floor
            at, score = at[alive], score[alive]
            if not len(at):
                break
            terms = order[j : j + PROBED_AT_ONCE]
            score = score + query[terms] @ weights[np.ix_(terms, at)]
        return at, score


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score; both tables have vec_id and embedding."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows, components = vectors.agg(F.count("*"), F.sum(F.greatest(F.size("embedding"), F.lit(0)))).first()
    shards = max(1, -(-2 * (components or 0) // SHARD_BYTES), min(rows // LEAST_SHARD_ROWS, 2 * partitions(vectors)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = quantised(batch)
            with np.errstate(over="ignore"):
                mixed = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            to = ((mixed >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)
            own = np.unique(to)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int32()), pa.array([False] * len(own)), pa.array([_pack(ids[to == s], [found[i] for i in np.flatnonzero(to == s)]) for s in own], pa.binary())], ["shard", "asks", "rows"]
            )

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = quantised(batch)
            for i in range(0, len(ids), QUERY_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([_pack(ids[i : i + QUERY_ROWS], found[i : i + QUERY_ROWS])], pa.binary())], ["rows"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        for batch in batches:
            for shard, asks, rows in zip(*(batch.column(c).to_pylist() for c in ("shard", "asks", "rows")), strict=True):
                if shard != now:
                    now, held, index = shard, [], None
                if not asks:
                    held.append(_unpack(rows))
                    continue
                if index is None:
                    width = max((v.shape[1] for _, v in held), default=0)
                    index = Shard(np.concatenate([i for i, _ in held] or [np.zeros(0, np.int64)]), np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for _, v in held] or [np.zeros((0, 0))]))
                ids, queries = _unpack(rows)
                each = index.search(ids, queries, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, [len(x) for x, _ in each]), pa.int64()), pa.array(np.concatenate([x for x, _ in each]), pa.int64()), pa.array([int(x) for _, s in each for x in s.tolist()], pa.int64())],
                    ["query_id", "vec_id", "score"],
                )

    rows = "shard int, asks boolean, rows binary"
    candidates = vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(deal, rows)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * SCALE) < float("inf")))
    asked = queries.where(F.col("vec_id").isNotNull() & finite).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("embedding")).mapInArrow(block, "rows binary")
    visits = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "rows")
    met = candidates.unionByName(visits).repartition(max(1, min(shards, 4 * partitions(vectors))), "shard").sortWithinPartitions("shard", "asks")
    found = met.mapInArrow(answer, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


OP10_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 10
"""
