"""The derivation work planner, transcript chunks, scene detection, and healing of derived tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.functions.media import DERIVATIONS, asset_id_ok, undecodable

MAX_CHUNK_MS, MAX_CHUNK_WORDS = 45_000, 120
MIN_CONTENT, RATIO, AROUND, MAX_KEYFRAMES, FALLBACK, MAX_DESCRIBED = 15.0, 3.0, 2, 150, 10, 12


@dataclass(frozen=True)
class Capabilities:
    """What this machine can do: model tags (None: no model) and tools."""

    model: str | None = "m1"
    whisper: bool = True
    whisper_tag: str = "whisper"
    text_model: bool = True
    text_tag: str = "text"
    describer: str | None = "d1"
    ocr: bool = True
    ocr_tag: str = "ocr"
    pdf: bool = True
    pdf_tag: str = "pdf"
    ffmpeg: bool = True


#: Order of the passes, the counter each adds to, and the asset kinds it looks at (None: all).
PASSES = (
    ("thumb", "thumbs", ("image", "video", "pdf")),
    ("image_embed", "embeddings", ("image", "pdf")),
    ("keyframes", "keyframes", ("video",)),
    ("keyframe_images", "keyframe_images", ("video",)),
    ("transcribe", "transcripts", ("video", "audio")),
    ("transcript_embed", "transcripts", None),
    ("ocr_image", "ocr", ("image",)),
    ("ocr_keyframes", "ocr", ("video",)),
    ("pdf_text", "pdf", ("pdf",)),
    ("caption_still", "captions", ("image", "pdf")),
    ("caption_video", "captions", ("video",)),
)


def _cascade(name: str, c: Capabilities) -> Column:
    """Status of an asset in one pass: the first rule that holds. Null: the asset isn't in the pass.

    The order differs from pass to pass: a model may be asked for before or after looking for the result.
    """
    has = lambda key, tag: F.coalesce(F.array_contains("blobs", F.lit(f"{tag}/{DERIVATIONS[key]}")), F.lit(False))
    thumb = F.coalesce(F.array_contains("blobs", F.lit("thumb-320.webp")), F.lit(False))
    offline, raw = F.col("abs_path").isNull(), undecodable(F.col("abs_path"))
    no = lambda ok: F.lit(not ok)
    manifest = has("keyframes", c.model) if c.model else F.lit(False)
    rules: dict[str, list[tuple[Column, str | None]]] = {
        "thumb": [(thumb, "done"), (offline, "offline"), (raw, "unsupported"), ((F.col("kind") == "video") & no(c.ffmpeg), "needs_ffmpeg")],
        "image_embed": [(no(c.model), "needs_model"), (has("image_embed", c.model), "done"), (offline, "offline"), (raw, "unsupported")],
        "keyframes": [(no(c.model), "needs_model"), (manifest, "done"), (offline, "offline"), (no(c.ffmpeg), "needs_ffmpeg")],
        "keyframe_images": [(~manifest, None), (has("keyframe_images", c.model), "done"), (offline, "offline"), (no(c.ffmpeg), "needs_ffmpeg")],
        "transcribe": [(has("transcribe", c.whisper_tag), "done"), (no(c.whisper), "needs_model"), (offline, "offline"), (no(c.ffmpeg), "needs_ffmpeg")],
        "transcript_embed": [(~has("transcribe", c.whisper_tag), None), (has("chunks_complete", c.text_tag) | has("chunks_empty", c.text_tag), "done"), (no(c.text_model), "needs_model")],
        "ocr_image": [(has("ocr_image", c.ocr_tag), "done"), (offline, "offline"), (raw, "unsupported"), (no(c.ocr), "unavailable")],
        "ocr_keyframes": [(~manifest, None), (has("ocr_complete", c.ocr_tag), "done"), (offline, "offline"), (no(c.ffmpeg), "needs_ffmpeg"), (no(c.ocr), "unavailable")],
        "pdf_text": [(has("pdf_text", c.pdf_tag), "done"), (offline, "offline"), (no(c.pdf), "unavailable")],
        "caption_still": [(no(c.describer), "needs_model"), (has("caption", c.describer) & has("tags", c.describer), "done"), (offline, "offline")],
        "caption_video": [(~manifest, None), (no(c.describer), "needs_model"), (has("captions", c.describer) & has("tags", c.describer), "done"), (offline, "offline")],
    }
    out = F.lit("pending")
    for condition, value in reversed(rules[name]):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def plan(sources: DataFrame, blobs: DataFrame, caps: Capabilities = Capabilities(), kinds: set[str] | None = None) -> DataFrame:
    """(priority, pass, counter, asset, abs_path, status) of every asset in every pass that concerns it.

    ``sources``: (asset, kind, abs_path; null if offline). ``blobs``: (asset, blob), blob the path below the asset's
    folder. An asset's few blobs are gathered once, so the eleven passes are expressions on one row and
    no join is repeated; assets with malformed ids are left out.
    """
    have = blobs.groupBy("asset").agg(F.collect_set("blob").alias("blobs"))
    rows = sources.filter(asset_id_ok(F.col("asset"))).join(have, "asset", "left")
    passes = []
    for i, (name, counter, of) in enumerate(PASSES):
        if kinds is not None and name not in kinds:
            continue
        if of and not caps.pdf and name != "pdf_text":
            of = tuple(k for k in of if k != "pdf")
        inside = F.col("kind").isin(*of) if of else F.lit(True)
        passes.append(F.when(inside, F.struct(F.lit(i).alias("priority"), F.lit(name).alias("pass"), F.lit(counter).alias("counter"), _cascade(name, caps).alias("status"))))
    out = rows.select("asset", "abs_path", F.explode(F.array(*passes)).alias("p")).filter("p.status is not null")
    return out.select("p.priority", "p.pass", "p.counter", "asset", "abs_path", "p.status")


STATUSES = ("done", "pending", "offline", "unsupported", "needs_ffmpeg", "needs_model", "unavailable")


def status_counts(planned: DataFrame) -> DataFrame:
    return planned.groupBy("counter").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def work_items(planned: DataFrame, each: int | None = None) -> DataFrame:
    """Pending work by priority and asset, ``each`` of a pass at most."""
    todo = planned.filter("status = 'pending'").select("priority", "pass", "asset", "abs_path")
    if each is not None:
        todo = todo.withColumn("_n", F.row_number().over(W.partitionBy("pass").orderBy("asset"))).filter(F.col("_n") <= each).drop("_n")
    return todo


# ---- chunks


def chunks(segments: DataFrame, max_ms: int = MAX_CHUNK_MS, max_words: int = MAX_CHUNK_WORDS) -> DataFrame:
    """(asset, start_ms, end_ms, text): segments (asset, start_ms, end_ms, text) joined greedily in order.

    A segment joins the open chunk while the whole stays within both bounds. The state is carried by ``aggregate``
    over the asset's sorted segments, inside the JVM.
    """
    words = lambda t: F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    seg = F.struct("start_ms", "end_ms", F.trim(F.coalesce("text", F.lit(""))).alias("text"), words(F.coalesce("text", F.lit(""))).alias("words"))
    per = segments.groupBy("asset").agg(F.sort_array(F.collect_list(seg)).alias("segs"))
    shape = "array<struct<start_ms:bigint,end_ms:bigint,text:string,words:int>>"

    def step(state: Column, s: Column) -> Column:
        last = F.element_at(state, -1)
        fits = (F.size(state) > 0) & (F.greatest(F.lit(0), s["end_ms"] - last["start_ms"]) <= max_ms) & (last["words"] + s["words"] <= max_words)
        joined = F.struct(last["start_ms"].alias("start_ms"), s["end_ms"].alias("end_ms"), F.concat(last["text"], F.lit(" "), s["text"]).alias("text"), (last["words"] + s["words"]).alias("words"))
        own = F.struct(s["start_ms"].alias("start_ms"), s["end_ms"].alias("end_ms"), s["text"].alias("text"), s["words"].alias("words"))
        return F.when(F.size(state) == 0, F.array(own)).when(fits, F.concat(F.slice(state, F.lit(1), F.size(state) - 1), F.array(joined))).otherwise(F.concat(state, F.array(own)))

    done = per.select("asset", F.aggregate("segs", F.array().cast(shape), step).alias("chunks"))
    return done.select("asset", F.explode("chunks").alias("c")).select("asset", "c.start_ms", "c.end_ms", "c.text")


# ---- scenes


def content_score(a: np.ndarray, b: np.ndarray) -> float:
    """Mean difference of hue, saturation and value of two RGB frames of equal size."""
    x, y = rgb_to_hsv(a).astype(np.int16), rgb_to_hsv(b).astype(np.int16)
    return float(np.abs(x - y).mean())


def rgb_to_hsv(rgb: np.ndarray) -> np.ndarray:
    """8-bit hue (0 to 179, half degrees), saturation and value of (..., 3) pixels."""
    c = rgb.reshape(-1, 3).astype(np.float32)
    high, low = c.max(axis=1), c.min(axis=1)
    span = high - low
    safe = np.where(span > 0, span, 1)
    r, g, b = c.T
    hue = np.where(high == r, (g - b) / safe, np.where(high == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 60
    hue = np.where(span > 0, hue % 360, 0) / 2
    saturation = np.where(high > 0, span / np.where(high > 0, high, 1) * 255, 0)
    return np.stack([np.round(hue), np.round(saturation), high], axis=1).astype(np.uint8)


def candidate_cuts(scores: DataFrame) -> DataFrame:
    """(asset, ts_ms) where a frame's score is high by itself and against its neighbours, two on each side.

    ``scores``: (asset, ts_ms, score), the score against the frame before. A silent neighbourhood passes.
    """
    around = W.partitionBy("asset").orderBy("ts_ms").rowsBetween(-AROUND, AROUND)
    s = scores.withColumn("_sum", F.sum("score").over(around) - F.col("score")).withColumn("_n", F.count("score").over(around) - 1)
    mean = F.when(F.col("_n") > 0, F.col("_sum") / F.greatest(F.col("_n"), F.lit(1))).otherwise(0.0)
    return s.filter((F.col("score") >= MIN_CONTENT) & ((mean <= 0) | (F.col("score") >= RATIO * mean))).select("asset", "ts_ms")


def merge_short(cuts: list[int], shortest: int, duration: int) -> list[int]:
    """Cuts left after every scene shorter than ``shortest`` has lost both its bounds, the first one first."""
    cuts = list(cuts)
    while cuts:
        edges = [0, *cuts, duration]
        at = next((i for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b - a < shortest), None)
        if at is None:
            break
        del cuts[max(at - 1, 0) : at + 1]
    return cuts


def keyframes(cuts: DataFrame, videos: DataFrame, shortest: int = 2_000) -> DataFrame:
    """(asset, ts_ms): middle of every scene, evenly thinned; ten even samples for a video without cuts.

    ``videos``: (asset, duration_ms, frames); fewer than two frames give nothing.
    """
    per = videos.filter("frames >= 2").join(cuts.groupBy("asset").agg(F.sort_array(F.collect_list("ts_ms")).alias("cuts")), "asset", "left")

    @F.pandas_udf("array<bigint>")
    def times(cut: pd.Series, duration: pd.Series) -> pd.Series:
        out = []
        for c, d in zip(cut, duration, strict=True):
            if c is None or not len(c):
                out.append([d * (2 * k + 1) // (2 * FALLBACK) for k in range(FALLBACK)])
                continue
            edges = [0, *merge_short([int(x) for x in c], shortest, d), d]
            mids = sorted({(a + b) // 2 for a, b in zip(edges, edges[1:], strict=False)})
            out.append(mids if len(mids) <= MAX_KEYFRAMES else [mids[i * len(mids) // MAX_KEYFRAMES] for i in range(MAX_KEYFRAMES)])
        return pd.Series(out)

    return per.select("asset", F.explode(times("cuts", "duration_ms")).alias("ts_ms"))


def described(frames: DataFrame, most: int = MAX_DESCRIBED) -> DataFrame:
    """Every k-th keyframe (asset, ts_ms), k the least that leaves ``most``."""
    n, row = F.count("*").over(W.partitionBy("asset")), F.row_number().over(W.partitionBy("asset").orderBy("ts_ms")) - 1
    s = frames.withColumn("_n", n).withColumn("_i", row).withColumn("_k", F.ceil(F.col("_n") / most))
    return s.filter((F.col("_i") % F.col("_k") == 0) & (F.col("_i") / F.col("_k") < most)).select("asset", "ts_ms")


# ---- healing: derived tables follow the blobs


def missing_vectors(blobs: DataFrame, table: DataFrame) -> DataFrame:
    """Blob vectors (asset, kind, ts_ms, model_tag, vector) that the table lacks."""
    return blobs.join(table, ["asset", "kind", "ts_ms", "model_tag"], "left_anti")


def missing_chunks(blobs: DataFrame, chunked: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to add, blobs without a chunk): chunk vectors by start time against the chunks as cut now."""
    fresh = blobs.join(table, ["asset", "start_ms"], "left_anti")
    return fresh.join(chunked.select("asset", "start_ms", "end_ms", "text"), ["asset", "start_ms"]), fresh.join(chunked, ["asset", "start_ms"], "left_anti")


def heal_text(rows: DataFrame, derived: DataFrame) -> DataFrame:
    """Text rows after adding the derived ones of (asset, source) pairs that have none yet.

    ``derived``: (content, asset, source, locator, model_tag); blank contents are dropped, and of several model
    tags the greatest supplies all rows of a pair.
    """
    d = derived.filter(F.trim("content") != "")
    d = d.withColumn("_top", F.max("model_tag").over(W.partitionBy("asset", "source"))).filter("model_tag = _top")
    return rows.unionByName(d.join(rows.select("asset", "source").distinct(), ["asset", "source"], "left_anti").select(*rows.columns))


def upsert_text(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Replace all rows of the new rows' (asset, source) pairs."""
    return rows.join(new.select("asset", "source").distinct(), ["asset", "source"], "left_anti").unionByName(new.select(*rows.columns))


def page_rows(pages: DataFrame) -> DataFrame:
    """(content, asset, source, locator) of (asset, pages array): pages count from 1, blank ones are dropped."""
    p = pages.select("asset", F.posexplode("pages").alias("i", "content"))
    return p.filter(F.trim("content") != "").select("content", "asset", F.lit("pdf").alias("source"), (F.col("i") + 1).cast("long").alias("locator"))


def over_half_failed(outcomes: DataFrame) -> DataFrame:
    """(asset, failed, total, complete): a video most of whose frames failed isn't complete."""
    g = outcomes.groupBy("asset").agg(F.count_if("failed").alias("failed"), F.count("*").alias("total"))
    return g.withColumn("complete", F.col("failed") * 2 <= F.col("total"))


def aborted_after(items: DataFrame) -> DataFrame:
    """``items`` (n, backend_failed, ...) with ``skipped``: all after the first backend failure."""
    first = items.filter("backend_failed").agg(F.min("n").alias("_first"))
    return items.crossJoin(F.broadcast(first)).withColumn("skipped", F.coalesce(F.col("n") > F.col("_first"), F.lit(False))).drop("_first")


def merge_failures(previous: DataFrame, current: DataFrame, kinds: list[str]) -> DataFrame:
    """Failure report (kind, asset, error): the kinds just run are replaced."""
    return previous.filter(~F.col("kind").isin(*kinds)).unionByName(current)
