"""Token counts from a digest cache.

Documents carry the digest of their normalised content (null becomes the empty
text; nothing else may change, as counts are of whole texts). The cache holds
(tokenizer digest, content digest, n_tokens). Only distinct contents that the
cache has no row for are encoded, and their counts are appended to it.

Texts move once, to meet the cache by digest; equal texts of a task are merged
before that, so a text that fills a third of the table moves once per task.
The counts then come back by digest alone.

Runs that miss the same text at the same time append it twice; a digest counts once.

Null or empty text: 0 bytes, 0 tokens. Repeated rows keep one result each.
Null doc_id: kept as null. Columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.bpe import encoder, file_digest
from dossier.llm.common import bounded_batches, slices
from dossier.session import scratch, written

CACHE = "tokenizer string, digest string, n_tokens long"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache's rows; none before the first append."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of every
    document. `tokenizer`: a file that every executor has; `cache`: a folder that
    driver and executors share, appended to by this call."""
    spark = docs.sparkSession
    bounded_batches(spark)
    version = file_digest(tokenizer)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digested = texts.withColumn("digest", F.sha2("text", 256))
    known = read_cache(spark, cache).where(F.col("tokenizer") == version).select("digest", "n_tokens")

    def first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            digests = batch.column("digest").to_pylist()
            keep = []
            for d in digests:
                keep.append(d not in seen)
                if len(seen) < 1_000_000:
                    seen.add(d)
            yield batch.filter(pa.array(keep, pa.bool_()))

    candidates = digested.select("digest", "text").mapInArrow(first_of_each, "digest string, text string")
    misses = candidates.join(known.select("digest"), "digest", "left_anti").dropDuplicates(["digest"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(tokenizer).count
        for batch in slices(batches, "text"):
            counts = [count(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(counts), pa.string()), batch.column("digest"), pa.array(counts, pa.int64())], ["tokenizer", "digest", "n_tokens"]
            )

    misses.mapInArrow(encode, CACHE).write.mode("append").parquet(cache)
    # One row a digest, though runs side by side may each have appended it. As a table, since
    # a join straight after an aggregate can't split the documents of a hot digest.
    counted = written(read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    sized = digested.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return sized.join(counted, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table, from a cache that begins empty, so that the
    figures are those of a cold run."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "token-cache"))
