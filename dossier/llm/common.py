"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: tab, line feed, vertical tab, form feed, carriage return, space.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = str.maketrans(_UPPER, _UPPER.lower())

#: Rows and bytes of an Arrow batch: bounds what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the column's values of a slice take about `most` bytes."""
    for batch in batches:
        rows, size = batch.num_rows, batch.column(column).nbytes
        step = rows if size <= most else max(1, rows * most // size)
        for start in range(0, rows, max(1, step)):
            yield batch.slice(start, step)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def outward(columns: list[str], results: Iterable[str]) -> list[str]:
    """The names of a table's columns beside an operator's results: one that a
    result has too gets "_in" (and "_" until it is free), one that begins with "__",
    as names on the way do, gets "in" before it."""
    results = {c.lower() for c in results}
    taken = results | {c.lower() for c in columns}
    out = []
    for name in columns:
        if name.lower() in results or name.startswith("__"):
            name = f"in{name}" if name.startswith("__") else f"{name}_in"
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
        out.append(name)
    return out


def set_aside(docs: DataFrame, results: Iterable[str]) -> DataFrame:
    """docs with its columns under their outward names."""
    return docs.toDF(*outward(docs.columns, results))


def put_back(df: DataFrame, columns: list[str], results: Iterable[str]) -> DataFrame:
    """The table's own columns, under the names they had."""
    return df.select(*[F.col(f"`{now}`").alias(name) for name, now in zip(columns, outward(columns, results), strict=True)])


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
