"""Schemas of the catalog's entities. Sources are read with these; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

HLC = "struct<wall_ms:bigint,counter:bigint,machine:string>"

#: All variants' fields in one struct; ``type`` tells which apply.
OP = (
    "struct<type:string,asset:string,volume:string,path:string,size:bigint,mtime_ms:bigint,label:string,tag:string,"
    "observed:array<string>,field:string,value:string,node:string,kind:string,name:string,algo:string,outcome:string,"
    "hashdate_ms:bigint,generation:int,mhl_path:string,roothash:string,`from`:string,`to`:string,query:string>"
)
EVENT = f"id string, hlc {HLC}, author string, op {OP}"

INSTANCE = "asset string, volume string, path string, size bigint, mtime_ms bigint"
IMAGE_VECTOR = "asset string, kind string, ts_ms bigint, model_tag string, vector array<float>"
TEXT_CHUNK = "asset string, source string, start_ms bigint, end_ms bigint, model_tag string, text string, vector array<float>"
TEXT_ROW = "content string, asset string, source string, locator bigint"
HASH_ENTRY = "rel string, size bigint, xxh64 string, action string, hashdate string"
CONTRIBUTION = "version int, contributor string, para_target string, source string, note string, files array<struct<name:string,xxh64:string,size:bigint>>"
JOURNAL = "type string, run string, rel string, size bigint, seq bigint, source string, started_ms bigint, dest string, error string"

#: Enumerations order by declaration, not by spelling (ties of equal clocks).
PARA_KINDS = ("project", "area", "resource", "archive")
OUTCOMES = ("original", "verified", "failed")
