"""Operator 8, mixing sources to target weights: systematic sampling on prefix sums.

Every document of a source has the same expected number of copies, target / source size. The
documents stand in a line (by size class, so that the sample is spread over all sizes), the
expected copies are summed along it, one random offset per source is added, and a document is
emitted once for each whole number that its own stretch of the line crosses.

The line of a hot source is never sorted in one task: a document's place is the sum of three
counts, of the size classes before its own, of the hash buckets before its own within the class,
and of the documents before it within the bucket. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.llm._common import stored

#: Fixed-point unit of one copy: rank * copies stays exact in a long up to 10**10 documents a source.
UNIT = 1 << 28
#: Weights repeat over the sources in code-point order.
WEIGHTS = (1, 2, 3)
#: A source is never repeated more often than this.
MOST = 3


def words(text: Column) -> Column:
    """Number of runs of characters other than space and \\t\\n\\v\\f\\r; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _hash32(*parts: Column) -> Column:
    """32 bits of md5 of the parts, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``sizes`` has (source, n_docs, source_size), a row per source; adds weight and target.

    Targets share the total by weight; one that reaches MOST times its source's size stops there
    and the excess is shared again by weight. That fixed point is min(MOST * size, level * weight)
    with one common level: in ascending order of MOST * size / weight, the sources before the first
    one above the level are the stopped ones.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    sizes = sizes.withColumn("_place", F.row_number().over(by_name) - 1)
    sizes = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_place") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    most = F.lit(MOST) * F.col("source_size")
    line = W.orderBy(most / F.col("weight"), "_place")
    before, rest, everything = line.rowsBetween(W.unboundedPreceding, -1), line.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    sizes = sizes.withColumn("_level", (F.sum("source_size").over(everything) - F.coalesce(F.sum(most).over(before), F.lit(0))) / F.sum("weight").over(rest))
    # The level counts where the source itself is not stopped by it; it is the same for all after it.
    open_level = F.min(F.when(F.col("_level") * F.col("weight") <= most, F.struct(most / F.col("weight"), F.col("_level").alias("level")))).over(everything)
    sizes = sizes.withColumn("_open", open_level["level"])
    return sizes.withColumn("target", F.when(F.col("_open").isNull(), most.cast("double")).otherwise(F.least(most.cast("double"), F.col("_open") * F.col("weight")))).drop("_place", "_level", "_open")


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    """What a document's place in its source's line follows from, and the columns ``more``."""
    d = docs.select(*more, F.col("doc_id"), F.col("source"), words(F.col("text")).alias("size"), F.xxhash64("text").alias("_tie"))
    return d.withColumn("_class", F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double")) * 4).cast("int")).withColumn("_hash", _hash32(F.col("doc_id").cast("string"))).withColumn("_bucket", F.shiftright("_hash", 20))


def _before(d: DataFrame) -> DataFrame:
    """Per source, size class and hash bucket of ``_sized``: the documents before it in its source's line, and its source's size and target."""
    counted = d.groupBy("source", "_class", "_bucket").agg(F.count("*").alias("_n"), F.sum("size").alias("_size"))
    sizes = source_targets(counted.groupBy("source").agg(F.sum("_n").alias("n_docs"), F.sum("_size").alias("source_size")))
    classes = counted.groupBy("source", "_class").agg(F.sum("_n").alias("_n"))
    up_to = lambda *k: W.partitionBy(*k[:-1]).orderBy(k[-1]).rowsBetween(W.unboundedPreceding, -1)
    classes = classes.select("source", "_class", F.coalesce(F.sum("_n").over(up_to("source", "_class")), F.lit(0)).alias("_classes_before"))
    buckets = counted.select("source", "_class", "_bucket", F.coalesce(F.sum("_n").over(up_to("source", "_class", "_bucket")), F.lit(0)).alias("_buckets_before"))
    before = buckets.alias("b").join(classes.alias("c"), [F.col("b.source").eqNullSafe(F.col("c.source")), F.col("b._class") == F.col("c._class")]).join(sizes.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")))
    return before.select(F.col("b.source").alias("_source"), F.col("b._class").alias("_c"), F.col("b._bucket").alias("_b"), (F.col("_classes_before") + F.col("_buckets_before")).alias("_before"), "source_size", "target")


def _copied(d: DataFrame, before: DataFrame, seed: int) -> DataFrame:
    """``_sized`` documents with source_size, target and copies."""
    place = W.partitionBy("source", "_class", "_bucket").orderBy("_hash", "size", "doc_id", "_tie")
    d = d.withColumn("_row", F.row_number().over(place))
    d = d.join(before, [d["source"].eqNullSafe(before["_source"]), d["_class"] == before["_c"], d["_bucket"] == before["_b"]])
    step = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * F.lit(UNIT))).otherwise(F.lit(0)).cast("long")
    offset = F.shiftright(_hash32(F.lit(str(seed)), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))), 4)
    rank = F.col("_before") + F.col("_row")
    crossed = lambda r: F.shiftright(r * step + offset, 28)
    return d.withColumn("copies", crossed(rank) - crossed(rank - 1))


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Copies of each document: (doc_id, source, size, source_size, target, copies, taken).

    Null text counts 0 words; a null source is one source, the last. A source without words has
    target 0 and gives no copies. Ties stand by doc_id, then by a hash of the text; rows that repeat a doc_id each get
    a place of their own and may differ in copies. An empty table gives an empty result; other columns of
    ``docs`` are ignored. ``seed`` sets the offset of every source, so reruns agree.
    """
    d = stored(_sized(docs), "sizes")  # a few longs a document: the texts are read and counted once
    d = _copied(d, _before(d), seed)
    return d.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` has copies of it, with all columns.

    Rows are placed as they are, not joined by doc_id, so null and repeated doc_ids are mixed like others; no
    column of ``docs`` can clash. Otherwise as ``mix``.
    """
    before = _before(stored(_sized(docs), "sizes"))
    d = _copied(_sized(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")), before, seed).filter(F.col("copies") > 0)
    return d.select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


_HASH = "('0x' || substr(md5({}), 1, 8))::BIGINT"
ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         {_HASH.format("doc_id::VARCHAR")} AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
o AS (SELECT arg_min(level, 3 * source_size / weight) AS level FROM l WHERE level * weight <= 3 * source_size),
t AS (SELECT w.source, w.source_size, least(3.0 * w.source_size, coalesce(o.level * w.weight, 3.0 * w.source_size))::DOUBLE AS target FROM w, o),
r AS (SELECT d.*, t.source_size, t.target,
        row_number() OVER (PARTITION BY d.source ORDER BY floor(log2(greatest(size, 1)) * 4), h, size, doc_id) AS place,
        CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size * {UNIT})::BIGINT ELSE 0 END AS step,
        ({_HASH.format("'0:' || coalesce('=' || d.source, 'null')")}) >> 4 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((((place * step + u) >> 28) - (((place - 1) * step + u) >> 28)) * size)::BIGINT AS taken
FROM r
"""
