"""Mixing sources to target weights by Pareto order sampling, in DataFrame
functions only.

A source's target is its share, by weight, of `share` times all words, at most
`most` times its own words; what it can't take is shared again by weight. Each
document of a source gets the whole copies that all of them are certain of
(target / words, rounded down). What is left of the target, a fraction f of the
source's words, is sampled: a document's inclusion probability grows with the
bit length of its size, is 1 for lengths that are certain, and is scaled so
that the expected words are f times the source's; its rank is its random odds
divided by its inclusion odds, and the sample is of fixed size: the documents
in rank order whose middle word lies within the words wanted.

The random number is a digest of seed, doc_id and text, so reruns agree; repeats of a
row are numbered, and all but the first draw their own from it and their number. Ranks
are never sorted within a source: words per (source, rank bin) are summed, the bin
in which the sample ends is found, and only that bin's documents (one in
thousands) are ranked, which gives each source's last rank. A document is then
taken if its rank is no larger.

Null or empty text: size 0, kept or not at no cost. Null source: a source of
its own, the last. Sources without words have target 0. Repeated rows
are taken or left one by one. Other columns stay as they are; one named
like a result gets "_in".
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm.common import outward
from dossier.session import written

#: Rank bins: 1/4096 wide, up to rank 16.
BINS_PER_UNIT, LAST_RANK = 4096, 16
RESULTS = ("size", "source_size", "target", "copies")
#: Names that are needed on the way.
BETWEEN = ("wanted", "scale", "last")
#: More sources than this are joined by shuffle instead of broadcast.
MOST_BROADCAST = 10_000
#: Repeats of a row are numbered in so many parts, so that no task numbers them all.
SALTS = 1024


def with_size(docs: DataFrame, seed: int) -> DataFrame:
    """docs with size (words) and __u (a random number of 48 bits)."""
    text = F.coalesce("text", F.lit(""))
    u = _drawn(F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text))
    return docs.withColumns({"size": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), "__u": u})


def _drawn(*parts: Column) -> Column:
    """48 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("long")


def numbered(sized: DataFrame) -> DataFrame:
    """sized (written; with __h, a hash of the row, and __salt), with a __u of its own for each
    repeat of a row. Rows alike in doc_id, text and source are numbered by the rest of the row."""
    key, part = ["source", "size", "__u"], ["__h", "__salt"]
    again = written(sized.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key), "repeated")
    if again.isEmpty():
        return sized

    def meet(df: DataFrame, other: DataFrame, on: list[str], how: str) -> DataFrame:
        few = other.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
        other = other.withColumnsRenamed({c: f"__o{c}" for c in on})
        same = [F.col(c).eqNullSafe(F.col(f"__o{c}")) for c in on]
        return df.join(F.broadcast(other) if few else other, same, how).drop(*[f"__o{c}" for c in on])

    parts = meet(sized.select(*key, *part), again, key, "left_semi").groupBy(*key, *part).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*key).orderBy(*part)) - F.col("n")  # SALTS rows for each kind of row
    parts = written(parts.withColumn("__before", before).drop("n"), "repeats")
    place = F.row_number().over(Window.partitionBy(*key, *part).orderBy("__u"))  # equal rows, in any order
    repeats = meet(sized, parts, key + part, "inner").withColumn("__n", F.col("__before") + place - 1)
    repeats = repeats.withColumn("__u", F.when(F.col("__n") == 0, F.col("__u")).otherwise(_drawn(F.col("__u").cast("string"), F.col("__n").cast("string")))).select(*sized.columns)
    return written(meet(sized, again, key, "left_anti").unionByName(repeats), "numbered")


def _weight(size: Column) -> Column:
    return F.length(F.bin(size)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size in; target, copies (certain ones) and wanted (the words to sample) out."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sources.withColumn("w", turn).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_need = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    filled = weighed.withColumns({
        "total": F.sum("source_size").over(every) * F.lit(float(share)), "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "open": F.sum("w").over(by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    }).withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    level = F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(every)
    target = F.least("cap", F.coalesce(level * F.col("w"), F.col("cap")))
    out = filled.withColumn("target", target).select("source", "source_size", "target")
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.nullif("source_size", F.lit(0)))).otherwise(0)
    return out.withColumn("copies", ratio.cast("long")).withColumn("wanted", F.col("target") - F.col("copies") * F.col("source_size"))


def inclusion(lengths: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: target, copies, wanted, source_size and scale (probability per bit of length)."""
    per = lengths.alias("l").join(targets.alias("t"), F.col("l.source").eqNullSafe(F.col("t.source"))).select("t.*", "q", "words")
    down = Window.partitionBy("source").orderBy(F.col("q").desc())  # some 60 rows at most
    certain = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spread = F.sum(F.col("q") * F.col("words")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    scaled = per.withColumn("c", F.when(spread > 0, (F.col("wanted") - certain) / F.nullif(spread, F.lit(0))))
    keep = F.min(F.when((F.col("c") * F.col("q") <= 1) & (F.col("c") >= 0), F.struct(-F.col("q"), "c")))["c"]
    return scaled.groupBy("source", "source_size", "target", "copies", "wanted").agg(F.coalesce(keep, F.lit(0.0)).alias("scale"))


def _rank(scale: Column, size: Column, u: Column) -> Column:
    """Random odds over inclusion odds: 0 for certain documents, none for impossible ones."""
    p = scale * _weight(size)
    odds = (u + F.lit(0.5)) / (F.lit(float(1 << 48)) - u - F.lit(0.5))
    return F.when(p >= 1, F.lit(0.0)).when(p > 0, odds / F.nullif(p / F.nullif(1 - p, F.lit(0.0)), F.lit(0.0)))


def _meet(df: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """The source's row beside each document."""
    plan = plan.withColumnRenamed("source", "__source")
    return df.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def plan_mix(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> tuple[DataFrame, bool]:
    """Per source: target, copies, scale and last (the last rank taken); and whether sources are few."""
    lengths = written(sized.groupBy("source", _weight(F.col("size")).alias("q")).agg(F.sum("size").alias("words")), "lengths")
    targets = written(source_targets(lengths.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most), "targets")
    plan = written(inclusion(lengths, targets), "inclusion")
    few = plan.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    ranked = _meet(sized.select("source", "size", "__u"), plan.select("source", "scale", "wanted"), few)
    ranked = ranked.withColumn("rank", _rank(F.col("scale"), F.col("size"), F.col("__u"))).where("rank is not null")
    ranked = ranked.withColumn("bin", F.when(F.col("rank") == 0, -1).otherwise(F.floor(F.least("rank", F.lit(float(LAST_RANK))) * BINS_PER_UNIT)))
    bins = ranked.groupBy("source", "bin", "wanted").agg(F.sum("size").alias("words"), F.max("rank").alias("top"))
    along = Window.partitionBy("source").orderBy("bin")  # as many rows as there are bins
    bins = bins.withColumn("reached", F.sum("words").over(along))
    inside = written(bins.withColumn("before", F.col("reached") - F.col("words")).where(F.col("before") <= F.col("wanted")), "bins")
    full = inside.where(F.col("reached") <= F.col("wanted")).groupBy("source").agg(F.max("top").alias("top"))
    edge = inside.where(F.col("reached") > F.col("wanted")).groupBy("source").agg(F.min(F.struct("bin", "before")).alias("e")).select("source", "e.*")
    at_edge = _meet(ranked.withColumnRenamed("bin", "__bin"), edge, few).where(F.col("__bin") == F.col("bin"))
    middle = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("rank", "__u", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size") / 2
    within = at_edge.withColumn("middle", middle).where(F.col("middle") <= F.col("wanted")).groupBy("source").agg(F.max("rank").alias("edge"))
    out = plan.alias("p").join(full.alias("f"), F.col("p.source").eqNullSafe(F.col("f.source")), "left").join(within.alias("w"), F.col("p.source").eqNullSafe(F.col("w.source")), "left")
    return written(out.select("p.*", F.greatest(F.coalesce("top", F.lit(-1.0)), F.coalesce("edge", F.lit(-1.0))).alias("last")), "mix"), few


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2, seed: int = 7, columns: list[str] | None = None) -> DataFrame:
    """`columns` of docs (default: all) with size, source_size, target and copies (0 to `most`)."""
    docs = docs if columns is None else docs.select(*dict.fromkeys([*columns, "doc_id", "source", "text"]))
    asked = docs.columns if columns is None else columns
    shown = dict(zip(docs.columns, outward(docs.columns, RESULTS), strict=True))
    inner = dict(zip(docs.columns, outward(docs.columns, [*RESULTS, *BETWEEN]), strict=True))
    docs, names = docs.toDF(*inner.values()), [inner[c] for c in asked]
    # Maps have no hash; a null adds nothing to one but its mark.
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name in names and not re.search("map<|variant", f.dataType.simpleString())]
    marks = {"__h": F.xxhash64(*hashed, *(c.isNull() for c in hashed)), "__salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")}
    sized = numbered(written(with_size(docs, seed).withColumns(marks).select(*dict.fromkeys([*names, "source", "size", "__u", *marks])), "sizes"))
    plan, few = plan_mix(sized, weights, share, most)
    rank = F.coalesce(_rank(F.col("scale"), F.col("size"), F.col("__u")), F.lit(float("inf")))
    met = _meet(sized, plan, few).withColumn("copies", F.col("copies") + F.when(rank <= F.col("last"), 1).otherwise(0))
    return met.select(*[F.col(f"`{inner[c]}`").alias(shown[c]) for c in asked], *RESULTS)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), columns=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: Fixed values of the contract: weights 3, 1, 2; 150 %; at most twice.
OP7_SQL = r"""
with drawn as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, ('0x' || substr(md5('7|' || coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))), 1, 12))::bigint as u from documents
), sized as (
  select * replace (case when row_number() over same = 1 then u else ('0x' || substr(md5(u::varchar || '|' || (row_number() over same - 1)::varchar), 1, 12))::bigint end as u) from drawn window same as (partition by source, size, u)
), bits as (select *, length(bin(size)) as q from sized),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (select *, [3.0, 1.0, 2.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as w, 2.0::double * source_size as cap from sources),
filled as (
  select *, ((sum(source_size) over ())::double * 1.5::double - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as level from weighed
), targets as (
  select source, source_size, least(cap, coalesce((select max(level) from filled where level * w <= cap) * w, cap)) as target from filled
), certain as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as copies from targets),
lengths as (select source, q, sum(size)::double as words from bits group by source, q),
scaled as (
  select t.source, q, (t.target - t.copies * t.source_size - coalesce(sum(words) over (partition by t.source order by q desc rows between unbounded preceding and 1 preceding), 0)) / nullif(sum(q * words) over (partition by t.source order by q desc rows between current row and unbounded following), 0) as c
  from lengths l join certain t on l.source is not distinct from t.source
), plan as (
  select t.source, t.source_size, t.target, t.copies, t.target - t.copies * t.source_size as wanted, coalesce(arg_max(c, q) filter (c * q <= 1 and c >= 0), 0) as scale
  from certain t left join scaled s on t.source is not distinct from s.source group by all
), ranked as (
  select doc_id, b.source, size, u, source_size, target, copies, wanted, case when scale * q >= 1 then 0 when scale * q > 0 then ((u + 0.5::double) / (281474976710656::double - u - 0.5::double)) / ((scale * q) / (1 - scale * q)) end as rank
  from bits b join plan p on b.source is not distinct from p.source
), walked as (
  select *, sum(size) over (partition by source order by rank, u, size rows between unbounded preceding and current row) - size / 2 as middle from ranked where rank is not null
), ends as (select source, max(rank) as last from walked where middle <= wanted group by source)
select doc_id, size, source_size, target, (size * (copies + case when rank <= last then 1 else 0 end))::bigint as taken from ranked left join ends on ranked.source is not distinct from ends.source
"""
