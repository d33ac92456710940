"""Paths, media kinds and their relatives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by kind.
EXTENSIONS = {
    "image": ("jpg", "jpeg", "png", "gif", "tif", "tiff", "bmp", "webp", "heic", "heif", "avif", "dng", "cr2", "cr3", "nef", "arw", "raf", "orf", "rw2", "jxl", "pef", "iiq", "3fr"),
    "video": ("mov", "mp4", "m4v", "avi", "mkv", "mxf", "mts", "m2ts", "webm", "r3d", "braw", "mpg", "mpeg", "3gp", "wmv", "insv"),
    "audio": ("wav", "mp3", "m4a", "aac", "flac", "aif", "aiff", "caf", "ogg"),
    "pdf": ("pdf",),
}
KINDS = (*EXTENSIONS, "other")
#: Image formats without a decoder.
UNDECODABLE = ("dng", "cr2", "cr3", "nef", "arw", "raf", "orf", "rw2", "pef", "iiq", "3fr", "avif", "jxl")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_dir(path: Column) -> Column:
    """Everything before the last slash, empty without one."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Lower-case part after the last dot of the last segment, empty without one."""
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]*)$", 1))


def media_kind(path: Column) -> Column:
    e = extension(path)
    out = F.lit("other")
    for kind, known in reversed(EXTENSIONS.items()):
        out = F.when(e.isin(*known), kind).otherwise(out)
    return out


def undecodable(path: Column) -> Column:
    return extension(path).isin(*UNDECODABLE)


def ancestors(path: Column) -> Column:
    """All folders above a path, the root ('') first."""
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return folders


def in_scope(path: Column, scope: str, flatten: bool) -> Column:
    """Whether a path lies in a folder: anywhere below (flatten) or directly in it."""
    if flatten:
        return F.lit(True) if scope == "" else path.startswith(f"{scope}/")
    return parent_dir(path) == scope


def ignored(path: Column) -> Column:
    """Hidden: some segment starts with a dot."""
    return F.exists(F.split(path, "/"), lambda s: s.startswith("."))


def escapes_folder(name: Column) -> Column:
    return name.startswith("/") | F.array_contains(F.split(name, "/"), "..")


def lower_hex16(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{16}$"), F.lit(False))


def asset_id_ok(value: Column) -> Column:
    return F.coalesce(value.rlike("^xxh3:[0-9a-f]{32}$"), F.lit(False))


def model_tag(name: Column) -> Column:
    return F.translate(name, "/:", "--")


def blob_class(file_name: Column) -> Column:
    """Transfer class of a blob's file; whatever isn't known is metadata."""
    return F.when(file_name == "thumb-320.webp", "thumbs").when(file_name == "transcript.json.zst", "transcripts").when(file_name.endswith(".f32le.zst"), "vectors").otherwise("metadata")


def vector_file(name: Column) -> Column:
    """(kind, ts_ms) of a vector blob's file name; null kind if it is none."""
    number = lambda lead: F.regexp_extract(name, rf"^{lead}-(-?[0-9]{{1,18}})\.f32le\.zst$", 1)
    frame, chunk = number("kf"), number("chunk")
    kind = F.when(name == "image.f32le.zst", "image").when(frame != "", "keyframe").when(chunk != "", "chunk")
    at = F.when(name == "image.f32le.zst", F.lit(-1)).when(frame != "", frame.try_cast("long")).when(chunk != "", chunk.try_cast("long")).cast("long")
    return F.struct(kind.alias("kind"), at.alias("ts_ms"))


#: File of each derivation below the model's folder.
DERIVATIONS = {
    "image_embed": "image.f32le.zst", "keyframes": "keyframes.json", "keyframe_images": "keyframe-images-complete.json", "transcribe": "transcript.json.zst",
    "chunks_complete": "chunks-complete.json", "chunks_empty": "chunks-empty.json", "ocr_image": "image.json.zst", "ocr_complete": "ocr-complete.json",
    "pdf_text": "text.json.zst", "caption": "caption.json.zst", "captions": "captions.json.zst", "tags": "tags.json.zst",
}


def blob_path(asset_hex: Column, tag: Column | None, file_name: Column) -> Column:
    """Path below the store; a thumbnail has no model folder."""
    parts = [F.lit("blobs"), F.substring(asset_hex, 1, 2), asset_hex, *([tag] if tag is not None else []), file_name]
    return F.concat_ws("/", *parts)


#: Longest edge of a thumbnail and frames a second that videos are sampled with (fixed values).
THUMB_EDGE, SAMPLED_FPS = 320, 2


def scaled_dimension(edge: Column, longest: Column) -> Column:
    """``edge`` when ``longest`` becomes THUMB_EDGE: rounded to the nearest, 1 at least."""
    return F.greatest(F.lit(1), F.floor((2 * edge * THUMB_EDGE + longest) / (2 * longest))).cast("long")


def frame_ms(index: Column, fps: int = SAMPLED_FPS) -> Column:
    return F.floor(index * 1000 / fps).cast("long")


def centis_ms(centis: Column) -> Column:
    """Negative times are 0."""
    return F.greatest(F.lit(0), centis * 10).cast("long")


def crumb_path(crumbs: Column, index: Column) -> Column:
    """Path of the folder that a crumb stands for: the crumbs up to it."""
    return F.array_join(F.slice(crumbs, F.lit(1), index + 1), "/")


def child_path(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(F.concat_ws("/", folder, name))
