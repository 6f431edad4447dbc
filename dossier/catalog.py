"""Tables in a folder: Parquet files in buckets by key, and a manifest per version.

A manifest names, for each bucket, the folders that hold its rows; the newest one
counts, and it is written last, so a write that breaks off leaves the table as it was.
Rows that agree in the first column of the key lie together. An upsert works off
some buckets at a time, writes only those that it changes, and one that never
updates (conflicts keep the old row) only adds files. A bucket of too many
folders is written anew as one. Buckets are of bounded size on average: a table that
outgrows them is dealt to twice as many or more, so each row is dealt anew a
few times at most, however large the table gets.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from dossier.operators.merge import merge_upsert, new_rows
from dossier.schemas import TABLES
from dossier.session import delete, free_shuffles, recorded, written

#: Versions that stay, so that running readers keep their files.
KEPT_VERSIONS = 2
#: Folders of a bucket before they are written as one.
MOST_FOLDERS = 16
#: Bytes of a bucket, as stored.
BUCKET_BYTES = 128 << 20
#: Bytes of a bucket, as stored, that are dealt together in an upsert: some MB of rows. A task merges
#: several; so many that tasks come out alike.
TASK_BYTES = 256 << 10
#: Bytes of buckets, as stored, that an upsert moves at once. Their shuffle files go before it moves others.
MOVED_BYTES = 128 << 20
#: Bytes of a row, as stored, at least expected of rows that come: they get ids where they are written.
ROW_BYTES = 24
#: How rows are dealt to buckets. Tables written before this was noted are dealt anew.
LAYOUT = "first of key"


class Catalog:
    """Any folder that Spark can write. One writer at a time per table. buckets: of small tables;
    larger ones get more, by BUCKET_BYTES."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 4):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        fs, at = self._files(path)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def versions(self, name: str) -> list[int]:
        return sorted(int(x[1:-5]) for x in self._names(f"{self.root}/{name}") if x.startswith("m") and x.endswith(".json"))

    def _manifest(self, name: str, version: int = 0) -> dict:
        """buckets: their number; parts: [bucket, folder] of all that has rows; bytes: by folder and bucket; layout."""
        version = version or max(self.versions(name), default=0)
        if not version:
            return {"buckets": self.buckets, "parts": [], "bytes": {}, "layout": LAYOUT}
        fs, at = self._files(f"{self.root}/{name}/m{version}.json")
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, name: str, buckets: int, parts: list[list]) -> dict:
        known = self._manifest(name).get("bytes", {})
        sizes = {folder: known.get(folder) or self._bytes(f"{self.root}/{name}/{folder}") for folder in {f for _, f in parts}}
        manifest = {"buckets": buckets, "parts": parts, "bytes": sizes, "layout": LAYOUT}
        version = max(self.versions(name), default=0) + 1
        fs, part = self._files(f"{self.root}/{name}/.m{version}-{uuid.uuid4().hex[:8]}")
        stream = fs.create(part, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        _, at = self._files(f"{self.root}/{name}/m{version}.json")
        if not fs.rename(part, at):
            raise RuntimeError(f"{name} was written by another writer")
        versions = self.versions(name)
        for old in versions[:-KEPT_VERSIONS]:
            fs.delete(self._files(f"{self.root}/{name}/m{old}.json")[1], False)
        kept = {folder for v in versions[-KEPT_VERSIONS:] for _, folder in self._manifest(name, v)["parts"]}
        delete(self.spark, [f"{self.root}/{name}/{x}" for x in self._names(f"{self.root}/{name}") if x.startswith("d") and x not in kept])
        return manifest

    def _bucket(self, name: str, buckets: int):
        return F.pmod(F.xxhash64(TABLES[name].key[0]), F.lit(buckets)).cast("int")

    def _bytes(self, path: str) -> dict[str, int]:
        """What is stored under path, by the folder that directly holds it: one listing."""
        fs, at = self._files(path)
        files, held = fs.listFiles(at, True), Counter()
        while files.hasNext():
            file = files.next()
            held[file.getPath().getParent().getName()] += file.getLen()
        return held

    def _fitting(self, size: int, buckets: int) -> int:
        """Buckets, doubled until `size` bytes fit."""
        while size > buckets * BUCKET_BYTES:
            buckets *= 2
        return buckets

    def _put(self, name: str, df: DataFrame, buckets: int) -> list[list]:
        """Writes df to a folder of its own, a file per bucket; the parts that it has."""
        return self._save(name, df.withColumn("__b", self._bucket(name, buckets)).repartition("__b"))

    def _save(self, name: str, df: DataFrame) -> list[list]:
        """Writes df, whose rows lie together by __b, to a folder of its own; the parts that it has."""
        folder = f"d{uuid.uuid4().hex[:12]}"
        df.select(*TABLES[name].schema.fieldNames(), "__b").write.option("compression", "zstd").partitionBy("__b").parquet(f"{self.root}/{name}/{folder}")
        return [[int(x[4:]), folder] for x in self._names(f"{self.root}/{name}/{folder}") if x.startswith("__b=")]

    def _parts(self, name: str, parts: list[list]) -> DataFrame:
        schema = TABLES[name].schema
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{folder}/__b={b}" for b, folder in parts])

    def read(self, name: str) -> DataFrame:
        """The table; empty if it was never written. Columns added since are null."""
        return self._parts(name, self._manifest(name)["parts"])

    def write(self, name: str, df: DataFrame) -> None:
        """The whole table anew: each row of df, also where keys repeat. Columns that it lacks are null."""
        with recorded() as made:
            source = written(self._typed(name, df), "table", "zstd")  # its size is known
            n = self._fitting(sum(self._bytes(made[-1]).values()), self._manifest(name)["buckets"])
            self._commit(name, n, self._put(name, source, n))
        delete(self.spark, made)

    def tables(self) -> DataFrame:
        """table_name of the tables that were written."""
        return self.spark.createDataFrame([(n,) for n in sorted(TABLES) if self.versions(n)], "table_name string")

    def init(self) -> None:
        """Creates what is missing; running it again changes nothing but empty forms (back-filled)."""
        for name in TABLES:
            if not self.versions(name):
                self._commit(name, self.buckets, [])
        empty = self.read("filing_documents").where("form is null or form = ''")
        if not empty.isEmpty():
            self.upsert("filing_documents", backfill_forms(empty, self.read("filings")))

    def upsert(self, name: str, rows: DataFrame, seq: str | None = None, ids: Mapping[str, Column] = {}) -> int:
        """Returns the rows attempted, as the counts of the journal are. ids: columns beside those of
        rows that follow from the key; they are made where a new row is written, and only there."""
        table, manifest = TABLES[name], self._manifest(name)
        with recorded() as made:
            source = written(self._typed(name, rows, seq), "upsert", "zstd")  # its plan runs once
            coming, least = sum(self._bytes(made[-1]).values()), source.count() * ROW_BYTES
            manifest = self._grown(name, manifest, coming, least)
            n, first = manifest["buckets"], F.col(table.key[0])
            touched = dict(source.groupBy(self._bucket(name, n)).count().collect())  # n rows at most
            free_shuffles(self.spark)  # of what made the rows
            total = sum(touched.values())
            there = {b: [p for p in manifest["parts"] if p[0] == b] for b in touched}
            sizes = {b: max(self._stored(manifest, there[b]) + coming * k // total, k * ROW_BYTES) for b, k in touched.items()}
            parts = manifest["parts"]
            for k, some in enumerate(_groups(sizes, MOVED_BYTES)):
                if k:
                    free_shuffles(self.spark)  # of those before
                # Rows move once, to the task of their share of a bucket: it merges them and writes them.
                shares = -(-sum(sizes[b] for b in some) // (len(some) * TASK_BYTES))
                # They are sorted by hashes first, which takes less than by keys that begin alike.
                sorts = {"__hash": F.xxhash64(first)}
                dealt = {"__b": self._bucket(name, n), "__share": F.pmod(F.hash(first), F.lit(shares))}
                own = source.withColumns(dealt | sorts).where(F.col("__b").isin(some))
                known = self._parts(name, [p for b in some for p in there[b]]).withColumns(dealt | sorts)
                if table.updates:
                    seen = Observation()
                    merged = merge_upsert(known, own, table.key, table.updates, seq, dealt, sorts, ids, "__changed")
                    made_parts = self._save(name, merged.observe(seen, F.collect_set(F.when(F.col("__changed"), F.col("__b"))).alias("changed")))
                    changed = set(seen.get["changed"])
                    delete(self.spark, [f"{self.root}/{name}/{folder}/__b={b}" for b, folder in made_parts if b not in changed])
                    parts = [p for p in parts if p[0] not in changed] + [p for p in made_parts if p[0] in changed]
                else:
                    new = new_rows(known.select(*dealt, *sorts, *table.key), own, table.key, seq, dealt, sorts, ids)
                    parts = parts + self._save(name, new)
            if touched and parts != manifest["parts"]:
                self._commit(name, n, self._compact(name, parts, n))
        delete(self.spark, made)
        free_shuffles(self.spark)
        return sum(touched.values())

    def _typed(self, name: str, rows: DataFrame, seq: str | None = None) -> DataFrame:
        """rows with all columns of the table, absent ones null, and seq."""
        schema = TABLES[name].schema
        given = [F.col(c).cast(schema[c].dataType).alias(c) if c in schema.fieldNames() else F.col(c) for c in rows.columns if c in schema.fieldNames() or c == seq]
        return rows.select(*given, *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in rows.columns])

    def _stored(self, manifest: dict, parts: list[list]) -> int:
        """Bytes of these parts."""
        return sum(manifest.get("bytes", {}).get(folder, {}).get(f"__b={b}", 0) for b, folder in parts)

    def _grown(self, name: str, manifest: dict, coming: int, least: int) -> dict:
        """The manifest, of a table that has buckets for `coming` more bytes and for `least` in all."""
        parts, before, same = manifest["parts"], manifest["buckets"], manifest.get("layout") == LAYOUT
        n = self._fitting(max(self._stored(manifest, parts) + coming, least), before)
        if n == before and same:
            return manifest
        # A bucket goes to new ones that take from no other, so some can be dealt at a time.
        sizes = {b: self._stored(manifest, [p for p in parts if p[0] == b]) for b in sorted({p[0] for p in parts})}
        out: list[list] = []
        for some in _groups(sizes, MOVED_BYTES) if same else [[*sizes]] * bool(sizes):
            out += self._put(name, self._parts(name, [p for p in parts if p[0] in some]), n)
            free_shuffles(self.spark)
        return self._commit(name, n, out)

    def _compact(self, name: str, parts: list[list], buckets: int) -> list[list]:
        many = {b for b, folders in Counter(p[0] for p in parts).items() if folders > MOST_FOLDERS}
        if not many:
            return parts
        return [p for p in parts if p[0] not in many] + self._put(name, self._parts(name, [p for p in parts if p[0] in many]), buckets)

    def counts(self) -> DataFrame:
        """table_name, n_rows of all eight tables; 0 for missing ones."""
        out = None
        for name in TABLES:
            one = self.read(name).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
            out = one if out is None else out.unionByName(one)
        return out


def _groups(sizes: Mapping[int, int], most: int) -> list[list[int]]:
    """The keys of `sizes`, in groups of `most` together, or of one."""
    out: list[list[int]] = []
    size = 0
    for k in sorted(sizes):
        if not out or size + sizes[k] > most:
            out.append([])
            size = 0
        out[-1].append(k)
        size += sizes[k]
    return out


def backfill_forms(documents: DataFrame, filings: DataFrame) -> DataFrame:
    """Null or empty forms take their filing's."""
    forms = filings.select(F.col("accession_number").alias("__a"), F.col("form").alias("__form"))
    form = F.when(F.coalesce(F.col("form"), F.lit("")) == "", F.coalesce("__form", "form")).otherwise(F.col("form"))
    return documents.join(forms, F.col("accession_number") == F.col("__a"), "left").withColumn("form", form).select(*documents.columns)
