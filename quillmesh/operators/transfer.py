"""Ingest planning, journals, verification diffs, two-way sync and the contribution inbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.functions.media import blob_class, escapes_folder, lower_hex16

CLASSES = ("thumbs", "metadata", "vectors", "transcripts")
INBOX_QUIET_MS = 300_000

# ---- ingest


def known_pairs(instances: DataFrame) -> DataFrame:
    """(hash, size) of everything the catalog has."""
    return instances.select(F.col("asset").alias("hash"), "size").distinct()


def ingest_plan(files: DataFrame, known: DataFrame, on_duplicate: str = "skip", hash_of=None) -> DataFrame:
    """``files`` (source, rel, size, ...) with ``prehash`` and ``decision``: copy, duplicate or rejected.

    Two phases: only files whose size some known asset has are hashed (``hash_of`` a Column, evaluated
    after the size join), the others are copies without a look at their content. ``action`` is
    what a duplicate gets: skip, copy-anyway or link.
    """
    sizes = known.select("size").distinct().withColumn("_hit", F.lit(True))
    f = files.join(sizes, "size", "left")
    f = f.withColumn("prehash", F.when(F.col("_hit") & (F.col("size") > 0), hash_of if hash_of is not None else F.col("hash")))
    k = known.select(F.col("hash").alias("prehash"), "size", F.col("hash").alias("asset"))
    f = f.join(k, ["prehash", "size"], "left")
    decision = F.when(F.col("size") == 0, "rejected").when(F.col("asset").isNotNull(), "duplicate").otherwise("copy")
    out = f.withColumn("decision", decision).withColumn("action", F.when(F.col("decision") == "duplicate", on_duplicate)).withColumn("reason", F.when(F.col("decision") == "rejected", "empty file"))
    return out.select("source", "rel", "size", "prehash", "decision", "asset", "action", "reason")


def plan_summary(planned: DataFrame) -> DataFrame:
    copies = (F.col("decision") == "copy") | (F.col("action") == "copy-anyway")
    return planned.agg(
        F.count("*").alias("files"), F.count_if(copies).alias("copyable"), F.count_if(F.col("decision") == "duplicate").alias("duplicates"), F.count_if(F.col("decision") == "rejected").alias("rejected"),
        F.coalesce(F.sum(F.when(copies, F.col("size"))), F.lit(0)).alias("copy_bytes"),
    )


def without_resumed(planned: DataFrame, done: DataFrame) -> DataFrame:
    return planned.join(done.select("rel"), "rel", "left_anti")


def missing_at(placed: DataFrame, dests: list[str], listing: DataFrame) -> DataFrame:
    """(rel, dests) of placed files that some destination's listing (dest, rel) lacks."""
    want = placed.select("rel").distinct().withColumn("dest", F.explode(F.array(*map(F.lit, dests))))
    return want.join(listing.select("dest", "rel"), ["dest", "rel"], "left_anti").groupBy("rel").agg(F.sort_array(F.collect_list("dest")).alias("dests"))


def outcome_events(placed: DataFrame, dests: DataFrame, node: str | None, at_ms: int) -> DataFrame:
    """(type, asset, volume, path, size, node) to record: a sighting and a verification for every destination, a
    PARA assignment once an asset."""
    each = placed.crossJoin(F.broadcast(dests))  # the run's destinations: a handful
    seen = each.select(F.lit("asset_seen").alias("type"), "asset", "volume", F.concat_ws("/", F.nullif("root", F.lit("")), "rel").alias("path"), "size", F.lit(None).cast("string").alias("node"))
    checked = seen.withColumn("type", F.lit("verification_recorded"))
    out = seen.unionByName(checked).withColumn("at_ms", F.lit(at_ms).cast("long"))
    if node is None:
        return out
    para = placed.select("asset").distinct().select(F.lit("asset_para_set").alias("type"), "asset", F.lit(None).cast("string").alias("volume"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("size"), F.lit(node).alias("node"), F.lit(at_ms).cast("long").alias("at_ms"))
    return out.unionByName(para)


def provenance_tags(planned: DataFrame, placed: DataFrame, tags: list[str]) -> DataFrame:
    """(asset, tag) once for every asset of an ingest, duplicates included."""
    a = placed.select("asset").unionByName(planned.filter("decision = 'duplicate'").select("asset")).distinct()
    return a.withColumn("tag", F.explode(F.array(*map(F.lit, tags))))


# ---- journals


def journal_fold(records: DataFrame) -> DataFrame:
    """(run, rel, size, planned, status) of every file: the last of placed and failed wins.

    ``records``: (run, seq, type, rel, size), type file_planned, file_copied, file_verified, file_placed or file_failed.
    """
    end = F.max(F.when(F.col("type").isin("file_placed", "file_failed"), F.struct("seq", "type")))["type"]
    g = records.filter("rel is not null").groupBy("run", "rel").agg(F.max(F.when(F.col("type") == "file_planned", F.col("size"))).alias("size"), F.max(F.col("type") == "file_planned").alias("planned"), end.alias("end"))
    return g.select("run", "rel", "size", "planned", F.when(F.col("end") == "file_placed", "placed").when(F.col("end") == "file_failed", "failed").otherwise("open").alias("status"))


def unfinished_runs(records: DataFrame) -> DataFrame:
    """(run, started, planned, placed, failed) of the runs that haven't placed all they planned."""
    started = records.groupBy("run").agg(F.min("seq").alias("started"))
    g = journal_fold(records).groupBy("run").agg(F.count_if("planned").alias("planned"), F.count_if(F.col("status") == "placed").alias("placed"), F.count_if(F.col("status") == "failed").alias("failed"))
    return g.join(started, "run").filter("placed < planned")


# ---- verification


def verify_diff(prior: DataFrame, present: DataFrame) -> DataFrame:
    """(rel, status): verified, altered, new or missing, from two tables (rel, hash)."""
    a, b = prior.select("rel", F.col("hash").alias("_a")), present.select("rel", F.col("hash").alias("_b"))
    status = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "missing").when(F.col("_a") == F.col("_b"), "verified").otherwise("altered")
    return a.join(b, "rel", "full_outer").select("rel", status.alias("status"))


def verify_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count("*").alias("files"))


# ---- sync


def segment_diff(src: DataFrame, dst: DataFrame) -> DataFrame:
    """(machine, segment, src_len, dst_len) of the log segments that are longer at the source."""
    d = dst.select("machine", "segment", F.col("len").alias("dst_len"))
    s = src.select("machine", "segment", F.col("len").alias("src_len"))
    return s.join(d, ["machine", "segment"], "left").withColumn("dst_len", F.coalesce("dst_len", F.lit(0).cast("long"))).filter("src_len > dst_len")


def blob_diff(src: DataFrame, dst: DataFrame) -> DataFrame:
    """(rel, class, size, ordinal) of the blobs (rel, size) that the other side lacks or has in another size."""
    d = dst.select("rel", F.col("size").alias("_d"))
    kind = blob_class(F.element_at(F.split("rel", "/"), -1))
    out = src.join(d, "rel", "left").filter("_d is null or _d <> size").withColumn("class", kind)
    return out.select("rel", "class", "size", F.array_position(F.array(*map(F.lit, CLASSES)), F.col("class")).alias("ordinal"))


def both_ways(a: DataFrame, b: DataFrame) -> DataFrame:
    """(machine, segment, ahead, behind) in bytes, from one full outer join."""
    x, y = a.select("machine", "segment", F.col("len").alias("_a")), b.select("machine", "segment", F.col("len").alias("_b"))
    j = x.join(y, ["machine", "segment"], "full_outer").withColumns({"_a": F.coalesce("_a", F.lit(0)), "_b": F.coalesce("_b", F.lit(0))})
    zero = F.lit(0).cast("long")
    return j.select("machine", "segment", F.greatest(F.col("_a") - F.col("_b"), zero).alias("ahead"), F.greatest(F.col("_b") - F.col("_a"), zero).alias("behind")).filter("ahead > 0 or behind > 0")


def segment_totals(diff: DataFrame) -> DataFrame:
    return diff.groupBy("machine").agg(F.count("*").alias("segments"), F.sum(F.col("src_len") - F.col("dst_len")).alias("bytes"))


def blob_totals(diff: DataFrame) -> DataFrame:
    return diff.groupBy("class").agg(F.count("*").alias("blobs"), F.sum("size").alias("bytes"))


def only(diff: DataFrame, classes: list[str]) -> DataFrame:
    return diff.filter(F.col("class").isin(*classes))


# ---- inbox


def check_contribution(listed: DataFrame, disk: DataFrame) -> DataFrame:
    """(name, state) of a contribution's files: ok, waiting, refused or unlisted.

    ``listed``: (name, xxh64, size) of the manifest; ``disk``: (name, size). A listed file is refused if its name leaves
    the folder or its hash isn't 16 lower-case hex digits, and waits until it is there in full.
    """
    a = listed.select("name", "xxh64", F.col("size").alias("_want"), F.lit(True).alias("_listed"))
    b = disk.select("name", F.col("size").alias("_have"))
    bad = escapes_folder(F.col("name")) | ~lower_hex16(F.col("xxh64"))
    state = F.when(F.col("_listed").isNull(), "unlisted").when(bad, "refused").when(F.col("_have").isNull() | (F.col("_have") < F.col("_want")), "waiting").when(F.col("_have") > F.col("_want"), "refused").otherwise("ok")
    return a.join(b, "name", "full_outer").select("name", state.alias("state"))


def quiescent(files: DataFrame, now_ms: Column, window_ms: int = INBOX_QUIET_MS) -> DataFrame:
    """(folder, quiet): whether nothing below a folder has changed within the window."""
    return files.groupBy("folder").agg((F.max("mtime_ms") <= now_ms - window_ms).alias("quiet"))


def fingerprint(files: DataFrame) -> DataFrame:
    """(folder, fingerprint) over the sorted (name, size, mtime_ms) of its files."""
    rows = F.sort_array(F.collect_list(F.concat_ws(":", "name", F.col("size").cast("string"), F.col("mtime_ms").cast("string"))))
    return files.groupBy("folder").agg(F.sha2(F.array_join(rows, "\n"), 256).alias("fingerprint"))


def to_retry(prints: DataFrame, failures: DataFrame) -> DataFrame:
    """Contributions (folder, fingerprint) that haven't failed in this very state before."""
    return prints.join(failures.select("folder", "fingerprint"), ["folder", "fingerprint"], "left_anti")


def throttle(progress: DataFrame, gap_ms: int = 100) -> DataFrame:
    """The progress events (run, rel, at_ms, bytes) of each file that are passed on: the first, then one whenever
    ``gap_ms`` have gone by since the last one passed on, and always the final one.

    A file's events stand by time and bytes. Which ones pass depends on those before, so they are gone through in
    order, as a sorted stream: a task holds a batch, not a file's events.
    """

    def passed(frames):
        key, last, final = None, 0, None
        for f in frames:
            keep = []
            for row in f[["run", "rel", "at_ms", "bytes"]].itertuples(index=False, name=None):
                if row[:2] != key:
                    if final is not None:
                        keep.append(final)
                    key, last, final = row[:2], row[2], None
                    keep.append(row)
                elif row[2] - last >= gap_ms:
                    last, final = row[2], None
                    keep.append(row)
                else:
                    final = row
            yield f.head(0)[["run", "rel", "at_ms", "bytes"]] if not keep else type(f)(keep, columns=["run", "rel", "at_ms", "bytes"])
        if final is not None:
            yield type(f)([final], columns=["run", "rel", "at_ms", "bytes"])

    e = progress.select("run", "rel", F.col("at_ms").cast("long"), F.col("bytes").cast("long"))
    return e.repartition("run", "rel").sortWithinPartitions("run", "rel", "at_ms", "bytes").mapInPandas(passed, "run string, rel string, at_ms bigint, bytes bigint")


# ---- what a sync run reports


def landed_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """(machine, segment, events): whole lines of ``after`` (machine, segment, line) behind those of ``before`` (machine, segment, lines)."""
    b = before.select("machine", "segment", F.col("lines").alias("_had"))
    a = after.groupBy("machine", "segment").agg(F.count("*").alias("_has"))
    out = a.join(b, ["machine", "segment"], "left").withColumn("events", F.col("_has") - F.coalesce("_had", F.lit(0)))
    return out.filter("events > 0").select("machine", "segment", "events")


def pull_summary(landed: DataFrame, blobs: DataFrame) -> DataFrame:
    """(what, n): events landed from each machine, machines, and blobs received."""
    each = landed.groupBy("machine").agg(F.sum("events").alias("n"))
    rows = each.select(F.concat(F.lit("events "), "machine").alias("what"), "n")
    return rows.unionByName(each.agg(F.count("*").alias("n")).select(F.lit("machines").alias("what"), "n")).unionByName(blobs.agg(F.count("*").alias("n")).select(F.lit("blobs").alias("what"), "n"))


def transfer_plan(segments: DataFrame, blobs: DataFrame, classes: list[str]) -> DataFrame:
    """(ordinal, kind, name, from, bytes) of what a push or pull moves: log segments first, from the byte they differ, then blobs by class and name."""
    s = segments.select(F.lit(0).cast("long").alias("ordinal"), F.lit("segment").alias("kind"), F.concat_ws("/", "machine", "segment").alias("name"), F.col("dst_len").alias("from"), (F.col("src_len") - F.col("dst_len")).alias("bytes"))
    b = only(blobs, classes).select("ordinal", F.col("class").alias("kind"), F.col("rel").alias("name"), F.lit(0).cast("long").alias("from"), F.col("size").alias("bytes"))
    return s.unionByName(b)


def transfer_outcome(plan: DataFrame, failed: DataFrame) -> DataFrame:
    """(kind, moved, failed, bytes) of an executed plan, of which ``failed`` (name) went wrong: a failure costs its own item only."""
    p = plan.join(failed.select("name").distinct().withColumn("_bad", F.lit(True)), "name", "left")
    good = F.col("_bad").isNull()
    return p.groupBy("kind").agg(F.count_if(good).alias("moved"), F.count_if(~good).alias("failed"), F.coalesce(F.sum(F.when(good, F.col("bytes"))), F.lit(0)).alias("bytes"))


def first_readable(instances: DataFrame, mounts: DataFrame) -> DataFrame:
    """(asset, abs_path): each asset's first place on a readable mounted volume.

    ``mounts``: (volume, root, readable); places stand by volume and path.
    """
    m = mounts.filter("readable").select("volume", "root")
    best = instances.join(m, "volume").groupBy("asset").agg(F.min(F.struct("volume", "path", "root")).alias("b"))
    return best.select("asset", F.concat_ws("/", "b.root", "b.path").alias("abs_path"))


def dest_roots(runs: DataFrame) -> DataFrame:
    """(run, roots): the destination roots of a run's state and those chosen, each once, the state's first."""
    return runs.select("run", F.array_union(F.coalesce("state", F.array().cast("array<string>")), F.coalesce("chosen", F.array().cast("array<string>"))).alias("roots"))
