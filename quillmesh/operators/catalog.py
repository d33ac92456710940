"""Filters, summaries, browsing, tags, PARA nodes, volumes and coverage over the folded tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.functions.dates import MAX_DRIFT_MS
from quillmesh.functions.media import ancestors, basename, in_scope, parent_dir
from quillmesh.functions.text import normal_tag
from quillmesh.operators.fold import Projection, effective, first_instances

# ---- filters: each is an independent EXISTS over its own table


@dataclass(frozen=True)
class Filter:
    """key: tag, volume, para, kind, online, before or after; ``ids`` are the mounted volumes of online."""

    key: str
    value: str | int | bool
    negated: bool = False
    ids: tuple[str, ...] = ()


def matching(p: Projection, f: Filter) -> DataFrame:
    """(id) of the assets that one filter's EXISTS finds, before negation."""
    if f.key == "tag":
        found = p.tags.filter(F.col("tag") == f.value)
    elif f.key == "volume":  # by label or id; volumes without a row are found by id
        v = p.volumes.withColumnRenamed("id", "volume")
        found = p.instances.join(v, "volume", "left").filter((F.col("volume") == f.value) | F.coalesce(F.col("label") == f.value, F.lit(False)))
    elif f.key == "para":
        found = p.asset_para.filter(F.col("node") == f.value)
    elif f.key == "kind":
        found = p.instances.filter(F.col("kind") == f.value)
    elif f.key == "online":
        found = p.instances.filter(F.col("volume").isin(*f.ids) if f.ids else F.lit(False))
    elif f.key == "before":
        found = p.instances.filter(F.col("mtime_ms") < f.value)
    elif f.key == "after":
        found = p.instances.filter(F.col("mtime_ms") > f.value)
    else:
        raise ValueError(f"unknown filter {f.key!r}")
    return found.select(F.col("asset").alias("id"))


def assets_matching(p: Projection, filters: list[Filter]) -> DataFrame:
    """(id) of the assets that all filters let through: a chain of semi- and anti-joins."""
    out = p.assets
    for f in filters:
        positive = not f.negated if f.key != "online" else bool(f.value) != f.negated
        out = out.join(matching(p, f), "id", "left_semi" if positive else "left_anti")
    return out


# ---- presentation


def instance_volumes(p: Projection) -> DataFrame:
    """(asset, volumes): sorted (id, label) of an asset's volumes; the id stands for a missing label."""
    v = p.volumes.select(F.col("id").alias("volume"), "label")
    rows = p.instances.select("asset", "volume").distinct().join(v, "volume", "left")
    return rows.groupBy("asset").agg(F.sort_array(F.collect_list(F.struct(F.col("volume").alias("id"), F.coalesce("label", "volume").alias("label")))).alias("volumes"))


def summaries(p: Projection, ids: DataFrame) -> DataFrame:
    """(id, name, kind, volumes, tags, para, known) of the assets in ``ids``, whatever is missing empty.

    Every side is pre-aggregated to a row per asset and cut down to the wanted assets before its join.
    """
    want = lambda df: df.join(ids.select(F.col("id").alias("asset")), "asset", "left_semi")
    first = first_instances(want(p.instances)).select(F.col("asset").alias("id"), basename(F.col("path")).alias("name"), "kind")
    vols = instance_volumes(_only(p, instances=want(p.instances))).withColumnRenamed("asset", "id")
    tags = want(p.tags).groupBy(F.col("asset").alias("id")).agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    nodes = p.para_nodes.select(F.col("id").alias("node"), F.concat_ws("/", "kind", "name").alias("label"))
    para = want(p.asset_para).join(nodes, "node", "left").select(F.col("asset").alias("id"), F.coalesce("label", "node").alias("para"))
    out = ids
    for side in (first, vols, tags, para):
        out = out.join(side, "id", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(dict(out.dtypes)[c]))
    return out.withColumn("known", F.col("name").isNotNull()).withColumn("volumes", empty("volumes")).withColumn("tags", empty("tags"))


def _only(p: Projection, **tables: DataFrame) -> Projection:
    return Projection(**{**p.__dict__, **tables})


def asset_detail(p: Projection, asset: str) -> DataFrame:
    """One row with everything about an asset; none if no event mentions it."""
    a = p.assets.filter(F.col("id") == asset)
    one = lambda df, name, *cols: df.filter(F.col("asset") == asset).groupBy(F.col("asset").alias("id")).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    sides = [one(p.instances, "instances", "volume", "path", "size", "mtime_ms", "kind"), one(p.verifications, "verifications", "volume", "path", "algo", "value", "outcome", "hashdate_ms")]
    pairs = one(p.fields, "pairs", "field", "value").select("id", F.map_from_entries("pairs").alias("fields"))
    out = summaries(p, a)
    for s in (*sides, pairs):
        out = out.join(s, "id", "left")
    return out


# ---- browsing


def browse_tree(p: Projection) -> DataFrame:
    """(volume, path, children, recursive_count): every folder with its subfolders' names, sorted, and the number of
    distinct assets at or below it; a volume without instances has its root."""
    up = p.instances.select("volume", "asset", F.explode(ancestors(F.col("path"))).alias("path"))
    counts = up.groupBy("volume", "path").agg(F.count_distinct("asset").alias("recursive_count"))
    folders = counts.filter("path <> ''").select("volume", parent_dir(F.col("path")).alias("path"), basename(F.col("path")).alias("child"))
    kids = folders.groupBy("volume", "path").agg(F.sort_array(F.collect_set("child")).alias("children"))
    roots = p.volumes.select(F.col("id").alias("volume"), F.lit("").alias("path"))
    every = counts.select("volume", "path").unionByName(roots).distinct()
    out = every.join(counts, ["volume", "path"], "left").join(kids, ["volume", "path"], "left")
    return out.select("volume", "path", F.coalesce("children", F.array().cast("array<string>")).alias("children"), F.coalesce("recursive_count", F.lit(0)).alias("recursive_count"))


SORTS = {"captured": ("mtime_ms", True), "name": ("name", False), "size": ("size", True)}


def browse_rows(p: Projection, volume: str | None = None, scope: str = "", flatten: bool = True, kind: str | None = None) -> DataFrame:
    """(asset, volume, path, name, size, mtime_ms, kind): the best instance of each asset in a folder.

    Best: the newest, then the least (path, volume).
    """
    keep = in_scope(F.col("path"), scope, flatten)
    if volume is not None:
        keep &= F.col("volume") == volume
    if kind is not None:
        keep &= F.col("kind") == kind
    rows = p.instances.filter(keep)
    top = rows.groupBy("asset").agg(F.max("mtime_ms").alias("mtime_ms"))
    best = rows.join(top, ["asset", "mtime_ms"]).groupBy("asset").agg(F.min(F.struct("path", "volume", "size", "mtime_ms", "kind")).alias("b"))
    return best.select("asset", "b.volume", "b.path", basename(F.col("b.path")).alias("name"), "b.size", "b.mtime_ms", "b.kind")


def browse_list(p: Projection, sort: str = "captured", offset: int = 0, limit: int = 200, **where) -> tuple[DataFrame, DataFrame]:
    """One page of ``browse_rows`` in order, and (total, folders) of all of it."""
    if sort not in SORTS:
        raise ValueError(f"unknown sort {sort!r}: one of {', '.join(SORTS)}")
    rows = browse_rows(p, **where)
    by, down = SORTS[sort]
    totals = rows.agg(F.count("*").alias("total"), F.count_distinct(parent_dir(F.col("path"))).alias("folders"))
    return rows.orderBy(F.desc(by) if down else F.asc(by), "asset").offset(offset).limit(limit), totals


# ---- tags


def tags_list(p: Projection) -> DataFrame:
    """(tag, count, last_used_ms): assets with the tag and its newest live add."""
    e = effective(p.tag_adds, p.aliases)
    return e.groupBy("tag").agg(F.count_distinct("asset").alias("count"), F.max("wall_ms").alias("last_used_ms"))


def assets_carrying(p: Projection, tag: str) -> DataFrame:
    return p.tags.filter(F.col("tag") == tag).agg(F.count_distinct("asset").alias("count"))


def vocabulary(p: Projection) -> DataFrame:
    return p.tags.select("tag").distinct()


def near_duplicate_tags(tags: DataFrame) -> DataFrame:
    """(tag, other): of tags alike but for case, spaces and hyphens, each with the next one, the last with the first."""
    t = tags.withColumn("like", normal_tag(F.col("tag")))
    ring = W.partitionBy("like").orderBy("tag")
    t = t.withColumn("n", F.count("*").over(W.partitionBy("like"))).withColumn("other", F.coalesce(F.lead("tag").over(ring), F.first("tag").over(ring)))
    return t.filter("n > 1").select("tag", "other")


def check_rename(p: Projection, source: str, target: str) -> int:
    """Number of assets that a rename touches; an error if it can't be done."""
    if source == target or not target:
        raise ValueError("a tag needs another name")
    n = assets_carrying(p, source).first()[0]
    if not n:
        raise ValueError(f"no asset carries {source!r}")
    if assets_carrying(p, target).first()[0]:
        raise ValueError(f"{target!r} exists: merge instead")
    return n


def check_merge(p: Projection, source: str, into: str) -> int:
    if source == into:
        raise ValueError("a tag can't be merged into itself")
    n = assets_carrying(p, source).first()[0]
    if not n or not assets_carrying(p, into).first()[0]:
        raise ValueError("both tags must be in use")
    return n


def assign(p: Projection, wanted: DataFrame, tags: list[str]) -> tuple[DataFrame, DataFrame]:
    """((asset, tag) to add, unknown assets) for bulk tagging: the few tags are a literal array."""
    a = wanted.select("asset").distinct()
    known = a.join(p.instances.select("asset"), "asset", "left_semi")
    pairs = known.withColumn("tag", F.explode(F.array(*map(F.lit, tags)) if tags else F.array().cast("array<string>")))
    return pairs.join(p.tags, ["asset", "tag"], "left_anti"), a.join(p.instances.select("asset"), "asset", "left_anti")


def pending_suggestions(suggested: DataFrame, p: Projection, rejected: DataFrame) -> DataFrame:
    """``suggested`` (asset, tag, confidence, model_tag) less tags the asset has and rejected (asset, tag) pairs."""
    s = suggested.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))))
    s = s.join(p.tags, ["asset", "tag"], "left_anti").join(rejected, ["asset", "tag"], "left_anti")
    return s.join(vocabulary(p).withColumn("in_vocab", F.lit(True)), "tag", "left").withColumn("in_vocab", F.coalesce("in_vocab", F.lit(False)))


# ---- volumes and PARA


def volume_asset_counts(p: Projection) -> DataFrame:
    return p.instances.groupBy("volume").agg(F.count_distinct("asset").alias("assets"))


def volumes_list(p: Projection, now_ms: int, online: tuple[str, ...] = ()) -> DataFrame:
    """(id, label, last_seen_ms, assets, online, clock_suspect)."""
    n = volume_asset_counts(p).withColumnRenamed("volume", "id")
    is_on = F.col("id").isin(*online) if online else F.lit(False)
    out = p.volumes.join(n, "id", "left").withColumn("assets", F.coalesce("assets", F.lit(0)))
    return out.withColumn("online", is_on).withColumn("clock_suspect", F.col("last_seen_ms") > now_ms + MAX_DRIFT_MS)


def resolve_para(nodes: DataFrame, reference: str) -> str:
    """Node id of ``kind/name`` (active nodes only, one match) or of an id."""
    if "/" in reference:
        kind, name = reference.split("/", 1)
        found = nodes.filter((F.col("kind") == kind) & (F.col("name") == name) & ~F.col("archived")).select("id").limit(2).collect()
        if len(found) > 1:
            raise ValueError(f"{reference!r} is ambiguous")
    else:
        found = nodes.filter(F.col("id") == reference).select("id").limit(1).collect()
    if not found:
        raise ValueError(f"no node {reference!r}")
    return found[0][0]


# ---- coverage


def eligible_assets(p: Projection, kinds: tuple[str, ...]) -> DataFrame:
    """(asset) whose first instance is of one of the kinds."""
    return first_instances(p.instances).filter(F.col("kind").isin(*kinds)).select("asset")


def text_coverage(p: Projection, text_rows: DataFrame, needs: dict[str, tuple[str, ...]]) -> DataFrame:
    """(source, eligible, covered): assets that a text source could cover, and those with rows of it."""
    first = first_instances(p.instances).select("asset", "kind")
    pairs = p.instances.sparkSession.createDataFrame([(s, k) for s, ks in needs.items() for k in ks], "source string, kind string")
    want = first.join(F.broadcast(pairs), "kind")  # a row per source and kind
    have = text_rows.select("asset", "source").distinct().withColumn("has", F.lit(1))
    return want.join(have, ["asset", "source"], "left").groupBy("source").agg(F.count("*").alias("eligible"), F.count("has").alias("covered"))


def best_instances(df: DataFrame, order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy("asset").orderBy(*order))).filter("_n = 1").drop("_n")
