"""The event fold: an event log to the catalog's tables, independent of order and repetition.

Last-writer-wins slots are a ``max`` over (clock, value) structs, which Spark compares field by field, so they
combine map-side and need one exchange; observed-remove tags are an anti-join with tombstones; grow-only sets
are ``distinct``. All of them take an event twice as once, so the log isn't made unique first: each fold
filters its event types at the scan and exchanges only its own keys. (Equal ids hold equal events.)
"""

from __future__ import annotations

import re
import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.functions.dates import MAX_DRIFT_MS
from quillmesh.functions.media import media_kind
from quillmesh.schemas import OUTCOMES, PARA_KINDS

ASSET_OPS = ("asset_seen", "tag_add", "tag_remove", "field_set", "asset_para_set", "verification_recorded")


def ordinal(value: Column, order: tuple[str, ...]) -> Column:
    """Place in a declared order; unknown values come first, by spelling."""
    return F.array_position(F.array(*map(F.lit, order)), value)


def of(events: DataFrame, *types: str) -> DataFrame:
    """Events of some types with the clock and the operation's fields as columns."""
    return events.filter(F.col("op.type").isin(*types)).select("id", "hlc", "op.*")


def unique(events: DataFrame) -> DataFrame:
    """One row an id. The whole event goes into the minimum, so the choice doesn't depend on order."""
    return events.groupBy("id").agg(F.min(F.struct("hlc", "author", "op")).alias("e")).select("id", "e.hlc", "e.author", "e.op")


def lww(df: DataFrame, keys: list[str], *values: Column | str) -> DataFrame:
    """The values under the greatest (clock, values) of each key; null values lose ties."""
    best = F.max(F.struct("hlc", F.struct(*values).alias("v"))).alias("b")
    return df.groupBy(*keys).agg(best).select(*keys, "b.hlc", "b.v.*")


def instances(events: DataFrame) -> DataFrame:
    """(asset, volume, path, size, mtime_ms, kind): the latest sighting of each place."""
    e = of(events, "asset_seen").withColumn("mtime_ms", F.coalesce("mtime_ms", F.lit(0)))
    out = lww(e, ["asset", "volume", "path"], "size", "mtime_ms").drop("hlc")
    return out.withColumn("kind", media_kind(F.col("path")))


def removed_adds(events: DataFrame) -> DataFrame:
    """(asset, id) tombstones: the add events that some remove of the asset has observed."""
    return of(events, "tag_remove").select("asset", F.explode("observed").alias("id")).distinct()


def tag_adds(events: DataFrame) -> DataFrame:
    """(id, asset, tag, wall_ms) of the adds without a tombstone, under their raw tags."""
    adds = of(events, "tag_add").select("id", "asset", "tag", F.col("hlc.wall_ms").alias("wall_ms"))
    return adds.join(removed_adds(events), ["asset", "id"], "left_anti").select("id", "asset", "tag", "wall_ms").distinct()


def aliases(events: DataFrame) -> DataFrame:
    """(raw, target): the latest rename of each tag, one hop."""
    e = of(events, "tag_renamed").withColumnRenamed("from", "raw").withColumnRenamed("to", "target")
    return lww(e, ["raw"], "target").select("raw", "target")


def follow(hops: dict[str, str]) -> dict[str, str]:
    """Where each raw tag's renames end; a cycle ends at the first name met twice."""
    out = {}
    for raw in hops:
        seen, tag = {raw}, hops[raw]
        while tag not in seen and tag in hops:
            seen.add(tag)
            tag = hops[tag]
        out[raw] = tag
    return out


def _cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage: checkpointed in the folder that the session names, or in a local session in one of its own."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(at or tempfile.mkdtemp(prefix="quillmesh-"))
    return df.checkpoint()


def _ends(hops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((raw, tag): where the hops (raw, target) that end lead, raw tags that come to no end).

    Steps double: each turn joins the table with itself. As long as some tag's renames go on to an end, others have
    just come to theirs, so the number of open ones falls with every turn until only those that run into a cycle are left.
    """
    reach = hops.select("raw", F.col("target").alias("tag"), F.lit(True).alias("open"))
    before = -1
    while True:
        step = reach.select(F.col("raw").alias("tag"), F.col("tag").alias("_tag"), F.col("open").alias("_open"))
        joined = reach.join(step, "tag", "left")
        reach = joined.select("raw", F.coalesce("_tag", "tag").alias("tag"), F.coalesce("_open", F.lit(False)).alias("open"))
        reach = _cut(reach)
        size = reach.filter("open").count()
        if size in (0, before):
            return reach.filter("not open").select("raw", "tag"), reach.filter("open").select("raw", "tag")
        before = size


def closure(alias: DataFrame, most: int = 100_000) -> DataFrame:
    """(raw, tag): where following the renames ends; on a cycle, the first name met twice.

    The rename table has a row per renamed tag. Up to ``most`` rows (checked) are followed on the driver; a larger
    table is joined with itself, in steps that double, so a chain of any length takes few of them.
    """
    spark = alias.sparkSession
    rows = alias.limit(most + 1).collect()
    if len(rows) <= most:
        return spark.createDataFrame(sorted(follow(dict(map(tuple, rows))).items()), "raw string, tag string")
    done, endless = _ends(alias)
    # what endless renames have come to lies on a cycle, and all of a cycle is come to: there they end
    cycle = endless.select("tag").distinct()
    tails, _ = _ends(alias.join(endless.select("raw"), "raw", "left_semi").join(cycle.withColumnRenamed("tag", "raw"), "raw", "left_anti"))
    return done.unionByName(cycle.select(F.col("tag").alias("raw"), "tag")).unionByName(tails)


def effective(adds: DataFrame, alias: DataFrame) -> DataFrame:
    """``adds`` with ``raw`` and the effective ``tag``; the renames are the small side."""
    c = closure(alias).withColumnRenamed("tag", "_to")
    return adds.withColumnRenamed("tag", "raw").join(c, "raw", "left").withColumn("tag", F.coalesce("_to", "raw")).drop("_to")


def asset_tags(events: DataFrame) -> DataFrame:
    return effective(tag_adds(events), aliases(events)).select("asset", "tag").distinct()


def fields(events: DataFrame) -> DataFrame:
    return lww(of(events, "field_set"), ["asset", "field"], "value").drop("hlc")


def volumes(events: DataFrame) -> DataFrame:
    """(id, label, last_seen_ms): label and time from one winner."""
    return lww(of(events, "volume_seen"), ["volume"], "label").select(F.col("volume").alias("id"), "label", F.col("hlc.wall_ms").alias("last_seen_ms"))


def para_nodes(events: DataFrame) -> DataFrame:
    """(id, kind, name, archived) of the nodes that have both a kind and a name."""
    e = of(events, "para_node_create", "para_node_rename", "para_node_archive")
    kind = F.max(F.when(F.col("kind").isNotNull(), F.struct("hlc", ordinal(F.col("kind"), PARA_KINDS).alias("n"), "kind")))
    name = F.max(F.when(F.col("name").isNotNull(), F.struct("hlc", "name")))
    out = e.groupBy(F.col("node").alias("id")).agg(kind["kind"].alias("kind"), name["name"].alias("name"), F.max(F.col("type") == "para_node_archive").alias("archived"))
    return out.filter("kind is not null and name is not null")


def asset_para(events: DataFrame) -> DataFrame:
    return lww(of(events, "asset_para_set"), ["asset"], "node").drop("hlc")


def verifications(events: DataFrame) -> DataFrame:
    return of(events, "verification_recorded").select("asset", "volume", "path", "algo", "value", "outcome", "hashdate_ms").distinct()


def latest_outcome(verified: DataFrame) -> DataFrame:
    """The outcome of the newest verification of each place; ties by declared order."""
    best = F.max(F.struct("hashdate_ms", ordinal(F.col("outcome"), OUTCOMES).alias("n"), "outcome"))["outcome"]
    return verified.groupBy("asset", "volume", "path").agg(best.alias("outcome"))


def manifests(events: DataFrame) -> DataFrame:
    return of(events, "manifest_recorded").select("volume", "generation", "mhl_path", "roothash").distinct()


def saved_searches(events: DataFrame) -> DataFrame:
    """(name, query) of those that aren't removed; a later set revives."""
    e = of(events, "saved_search_set", "saved_search_remove").withColumn("query", F.when(F.col("type") == "saved_search_set", F.col("query")))
    return lww(e, ["name"], "query").filter("query is not null").select("name", "query")


def assets(events: DataFrame) -> DataFrame:
    """Every asset that any event mentions, seen or not."""
    return events.filter(F.col("op.type").isin(*ASSET_OPS)).select(F.col("op.asset").alias("id")).distinct()


def first_instances(inst: DataFrame) -> DataFrame:
    """(asset, volume, path, kind) of the least (volume, path): what names and classes an asset."""
    return inst.groupBy("asset").agg(F.min(F.struct("volume", "path", "kind")).alias("f")).select("asset", "f.*")


def suspect_clocks(events: DataFrame, now_ms: int) -> DataFrame:
    """(events, clamped, worst_wall_ms): clocks over a day ahead of now aren't followed."""
    wall = F.col("hlc.wall_ms")
    late = wall > now_ms + MAX_DRIFT_MS
    return events.agg(F.count("*").alias("events"), F.count_if(late).alias("clamped"), F.max(F.when(late, wall)).alias("worst_wall_ms"), F.max(F.when(~late, wall)).alias("observed_wall_ms"))


@dataclass
class Projection:
    """The folded tables by name; lazy until used."""

    assets: DataFrame
    instances: DataFrame
    tag_adds: DataFrame
    aliases: DataFrame
    tags: DataFrame
    fields: DataFrame
    volumes: DataFrame
    para_nodes: DataFrame
    asset_para: DataFrame
    verifications: DataFrame
    manifests: DataFrame
    saved_searches: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return dict(self.__dict__)

    def dump(self) -> dict[str, list[tuple]]:
        """Sorted rows of every table, to compare projections of small logs."""
        return {k: sorted((tuple(r) for r in df.collect()), key=repr) for k, df in self.tables().items()}


def project(events: DataFrame) -> Projection:
    e = events
    return Projection(assets(e), instances(e), tag_adds(e), aliases(e), asset_tags(e), fields(e), volumes(e), para_nodes(e), asset_para(e), verifications(e), manifests(e), saved_searches(e))


def raw_tags_of(adds: DataFrame, alias: DataFrame, tag: str) -> DataFrame:
    """(asset, raw, ids): the live adds that end at an effective tag, which a removal has to cite."""
    e = effective(adds, alias).filter(F.col("tag") == tag)
    return e.groupBy("asset", "raw").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
