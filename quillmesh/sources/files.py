"""File trees, derived blobs, hash manifests, journals and contributions as DataFrames."""

from __future__ import annotations

import json
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.functions.hashing import xxh3_asset, xxh64_hex
from quillmesh.functions.media import ignored, vector_file
from quillmesh.schemas import CONTRIBUTION, JOURNAL

MHL = "urn:ASC:MHL:v2.0"


def tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel, size, mtime_ms, content) of every file that isn't hidden; content is read only if used."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").rpartition("/")[2]
    rel = F.substring_index(F.col("path"), f"/{base}/", -1)
    out = f.select("path", rel.alias("rel"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"), "content")
    return out.filter(~ignored(F.col("rel")))


def sightings(files: DataFrame, volume: str) -> DataFrame:
    """(asset, volume, path, size, mtime_ms) of a scanned tree."""
    return files.select(xxh3_asset("content").alias("asset"), F.lit(volume).alias("volume"), F.col("rel").alias("path"), "size", "mtime_ms")


def hashed(files: DataFrame) -> DataFrame:
    """(rel, size, hash) with xxh64, as manifests have it; the history folder is left out."""
    return files.filter(~F.col("rel").startswith("ascmhl/")).select("rel", "size", xxh64_hex("content").alias("hash"))


# ---- blobs


def blobs(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(rel, asset, model_tag, file, size, content) below a blob store."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(f"{root}/blobs")
    rel = F.substring_index("path", "/blobs/", -1)
    parts = F.split(rel, "/")
    out = f.select(rel.alias("rel"), parts.alias("p"), F.col("length").alias("size"), "content")
    return out.select("rel", F.concat(F.lit("xxh3:"), F.col("p")[1]).alias("asset"), F.when(F.size("p") > 3, F.col("p")[2]).alias("model_tag"), F.element_at("p", -1).alias("file"), "size", "content")


def encode_vector(v) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.asarray(v, "<f4").tobytes())


def _mapped(content: Column | str, kind: str, one) -> Column:
    def batch(values):
        return values.map(one)

    batch.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, kind)(content)


def _unzip(x) -> bytes:
    return zstandard.ZstdDecompressor().decompress(bytes(x), max_output_size=1 << 28)


def decode_vector(content: Column | str) -> Column:
    """f32 little-endian under zstd; null if the bytes aren't whole floats."""
    return _mapped(content, "array<float>", lambda x: np.frombuffer(r, "<f4") if len(r := _unzip(x)) % 4 == 0 else None)


def vector_rows(b: DataFrame) -> DataFrame:
    v = b.withColumn("v", vector_file(F.col("file"))).filter("v.kind is not null")
    return v.select("asset", "v.kind", "v.ts_ms", "model_tag", decode_vector("content").alias("vector"))


def inflate(content: Column | str) -> Column:
    """Text of zstd-compressed blobs."""
    return _mapped(content, "string", lambda x: _unzip(x).decode())


def transcripts(b: DataFrame) -> DataFrame:
    """(asset, start_ms, end_ms, text) of transcript blobs."""
    schema = "model_tag string, segments array<struct<start_ms:bigint,end_ms:bigint,text:string>>, text string"
    t = b.filter("file = 'transcript.json.zst'").select("asset", F.from_json(inflate("content"), schema).alias("t"))
    return t.select("asset", F.explode("t.segments").alias("s")).select("asset", "s.*")


def suggestions(b: DataFrame) -> DataFrame:
    """(asset, tag, confidence, model_tag) of tag suggestion blobs."""
    t = b.filter("file = 'tags.json.zst'").select("asset", "model_tag", F.explode(F.from_json(inflate("content"), "array<struct<tag:string,confidence:double>>")).alias("t"))
    return t.select("asset", "t.tag", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("t.confidence"))).alias("confidence"), "model_tag")


def captions(b: DataFrame) -> DataFrame:
    """(content, asset, source, locator, model_tag) of still captions and of video captions by time."""
    still = b.filter("file = 'caption.json.zst'").select(F.get_json_object(inflate("content"), "$.text").alias("content"), "asset", F.lit("caption").alias("source"), F.lit(-1).cast("long").alias("locator"), "model_tag")
    video = b.filter("file = 'captions.json.zst'").select("asset", "model_tag", F.explode(F.from_json(inflate("content"), "array<struct<ts_ms:bigint,text:string>>")).alias("c"))
    return still.unionByName(video.select(F.col("c.text").alias("content"), "asset", F.lit("caption").alias("source"), F.col("c.ts_ms").alias("locator"), "model_tag"))


# ---- hash manifests


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(rel, size, xxh64, action, hashdate) of one generation."""
    schema = "path struct<_VALUE:string,_size:bigint>, xxh64 struct<_VALUE:string,_action:string,_hashdate:string>"
    x = spark.read.format("xml").option("rowTag", "hash").schema(schema).load(path)
    return x.select(F.col("path._VALUE").alias("rel"), F.col("path._size").alias("size"), F.col("xxh64._VALUE").alias("xxh64"), F.col("xxh64._action").alias("action"), F.col("xxh64._hashdate").alias("hashdate"))


def write_manifest(rows: list[dict], path: str, created: str) -> None:
    """One generation's file from collected entries: manifests describe one folder tree and are single files."""
    top = ElementTree.Element("hashlist", {"version": "2.0", "xmlns": MHL})
    ElementTree.SubElement(ElementTree.SubElement(top, "creatorinfo"), "creationdate").text = created
    hashes = ElementTree.SubElement(top, "hashes")
    for r in sorted(rows, key=lambda r: r["rel"]):
        h = ElementTree.SubElement(hashes, "hash")
        ElementTree.SubElement(h, "path", {"size": str(r["size"])}).text = r["rel"]
        ElementTree.SubElement(h, "xxh64", {"action": r["action"], "hashdate": r["hashdate"]}).text = r["xxh64"]
    ElementTree.indent(top)
    ElementTree.ElementTree(top).write(path, "utf-8", xml_declaration=True)


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """(sequence, file, c4) of a chain file."""
    x = spark.read.format("xml").option("rowTag", "hashlist").schema("_sequencenr bigint, path string, c4 string").load(path)
    return x.select(F.col("_sequencenr").alias("sequence"), F.col("path").alias("file"), "c4")


def write_chain(entries: list[tuple[int, str, str]], path: str) -> None:
    top = ElementTree.Element("ascmhldirectory", {"xmlns": f"{MHL}/directory"})
    for number, file, c4 in sorted(entries):
        h = ElementTree.SubElement(top, "hashlist", {"sequencenr": str(number)})
        ElementTree.SubElement(h, "path").text = file
        ElementTree.SubElement(h, "c4").text = c4
    ElementTree.indent(top)
    ElementTree.ElementTree(top).write(path, "utf-8", xml_declaration=True)


def generations(files: DataFrame) -> DataFrame:
    """(number, rel) of the manifests in a listing."""
    n = F.regexp_extract("rel", r"(?:^|/)ascmhl/([0-9]{4})_[^/]*\.mhl$", 1)
    return files.withColumn("number", n.try_cast("int")).filter("number is not null").select("number", "rel")


# ---- journals and contributions


def journal(spark: SparkSession, path: str) -> DataFrame:
    """Records of ingest journals; lines that don't parse are dropped."""
    return spark.read.schema(T.StructType.fromDDL(JOURNAL)).option("mode", "DROPMALFORMED").json(path)


def append_journal(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def contribution(text: str) -> dict:
    """A contribution's manifest, checked: known version, a contributor, files with names and sizes."""
    m = json.loads(text)
    if m.get("version") != 1:
        raise ValueError(f"unknown manifest version {m.get('version')}")
    if not str(m.get("contributor", "")).strip():
        raise ValueError("a manifest needs a contributor")
    files = m.get("files") or []
    if not files or len({f["name"] for f in files}) != len(files) or any(f["size"] < 0 for f in files):
        raise ValueError("a manifest needs files, each once and with a size")
    return m


def contributions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONTRIBUTION).option("multiLine", "true").json(path)


def rejections(spark: SparkSession, path: str) -> DataFrame:
    """(asset, tag); a bad line is an error: a lost rejection would bring a suggestion back."""
    return spark.read.schema("asset string, tag string").option("mode", "FAILFAST").json(path).distinct()
