"""A training corpus from the documents table: quality rules, line dedup,
near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
stage's rows to the shared folder and reads them back as the next one's docs,
so a lost executor repeats tasks of one stage only; what a stage no longer needs is
deleted. Every stage works on all that its predecessor kept.

Null or empty texts count as empty; null doc_id, lang or source are values of their own.
Repeated rows are judged alike, one of them stays in near_dedup, ties go to the smallest
digest of the row. Extra columns stay as they are up to the last stage, whatever their
names; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import lines, mixing, quality
from dossier.llm.common import put_back
from dossier.llm.lines import drop_lines
from dossier.llm.mixing import mix
from dossier.llm.packing import pack_documents
from dossier.llm.quality import judge
from dossier.llm.simhash import one_of_each
from dossier.session import delete, recorded, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return put_back(judge(docs).where("kept"), docs.columns, quality.RESULTS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; a text left without lines stays as an empty one."""
    kept = drop_lines(docs)
    new = {"text": F.col("kept")} | ({"n_chars": F.char_length("kept").cast("long")} if "n_chars" in docs.columns else {})
    return put_back(kept.withColumns(new), docs.columns, lines.RESULTS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, one row stays: that with the smallest
    doc_id, or one of those without doc_id where the group has no other."""
    return put_back(one_of_each(docs), docs.columns, ())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes."""
    mixed = mix(docs).where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return put_back(mixed, docs.columns, mixing.RESULTS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full training sequences."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack", pack)]

#: Fingerprints are bits of XXH64 and ids come from a tokenizer: SQL can express neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with recorded() as made:
            docs = written(stage(spark, docs, sf_dir), name)
        delete(spark, before + made[:-1])  # the stage's rows are written: nothing reads these again
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
