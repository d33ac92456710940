"""Operator 3, token-ID output: patched frame-of-reference blocks.

A shard file holds the ids of consecutive documents, little-endian throughout:

    "PFOR2" + 3 zero bytes | part u32 | number in the part u32
    n_docs u64 | n_null u64 | n_ids u64 | n_blocks u64
    doc_ids        n_docs x i64   the first n_null of them are null (0 here)
    doc ends       n_docs x u64   ids up to the end of each document
    block starts   n_blocks x u64 offset of each block in the body: the index
    body           the blocks, then a line end

and a block of up to BLOCK ids: minimum u32, number of ids u16, exceptions u16, width u8, then the
low ``width`` bits of each id less the minimum, packed, then the exceptions' places (u16 each)
and their high bits (u32 each). The width is the least that PERCENT of the block's ids fit into.
Any block decodes alone, so a reader can start at the block that holds a wanted id.

Files are written and read by Spark, so they lie in any store that it reaches: a file is a row's bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.llm import bytebpe
from quillmesh.llm._common import map_arrow, new_path, stored, strings

MAGIC = b"PFOR2\0\0\0"
BLOCK = 4096
PERCENT = 95
#: Ids that close a shard; a longer document has a shard of its own.
SHARD = 1 << 21
END = 2


def pack(values: np.ndarray, width: int) -> bytes:
    """Low ``width`` bits of each value, first value in the lowest bits."""
    if not width:
        return b""
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint32)
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)


def encode_block(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    rest = ids - np.uint32(low)
    fit = int(np.partition(rest, k := (len(rest) - 1) * PERCENT // 100)[k])
    width = fit.bit_length()
    high = rest.astype(np.uint64) >> np.uint64(width)
    at = np.flatnonzero(high)
    return struct.pack("<IHHB", low, len(ids), len(at), width) + pack(rest, width) + at.astype("<u2").tobytes() + high[at].astype("<u4").tobytes()


def decode_block(data: memoryview) -> np.ndarray:
    low, n, odd, width = struct.unpack_from("<IHHB", data)
    size = (n * width + 7) // 8
    ids = unpack(data[9 : 9 + size], n, width)
    if odd:
        at = np.frombuffer(data, "<u2", odd, 9 + size)
        ids[at] |= (np.frombuffer(data, "<u4", odd, 9 + size + 2 * odd).astype(np.uint64) << np.uint64(width)).astype(np.uint32)
    return ids + np.uint32(low)


def encode_shard(docs: list[np.ndarray], ids: list[int | None] | None = None, part: int = 0, number: int = 0) -> bytes:
    """Image of the documents' token ids (uint32 arrays; empty ones allowed); ``ids``: doc_ids, null ones first (none given: 0, 1, ...)."""
    flat = np.concatenate(docs).astype(np.uint32) if docs else np.zeros(0, np.uint32)
    blocks = [encode_block(flat[i : i + BLOCK]) for i in range(0, len(flat), BLOCK)]
    ids = list(range(len(docs))) if ids is None else ids
    null = sum(x is None for x in ids)
    ends = np.cumsum([len(x) for x in docs], dtype=np.int64).astype("<u8")
    starts = np.cumsum([0, *map(len, blocks)][: len(blocks)], dtype=np.int64).astype("<u8")
    head = MAGIC + struct.pack("<IIQQQQ", part, number, len(docs), null, len(flat), len(blocks))
    return head + np.array([x or 0 for x in ids], "<i8").tobytes() + ends.tobytes() + starts.tobytes() + b"".join(blocks) + b"\n"


class Shard:
    """A shard file's image; ids are read through the block index, and the last block read is held."""

    def __init__(self, image: bytes):
        if image[:8] != MAGIC:
            raise ValueError("not a PFOR2 file")
        self.part, self.number, n, self.null, self.n_ids, n_blocks = struct.unpack_from("<IIQQQQ", image, 8)
        self.doc_ids, self.ends = np.frombuffer(image, "<i8", n, 48), np.frombuffer(image, "<u8", n, 48 + 8 * n).astype(np.int64)
        self.starts = np.frombuffer(image, "<u8", n_blocks, 48 + 16 * n).astype(np.int64)
        self.body = memoryview(image)[48 + 16 * n + 8 * n_blocks :]
        self.held: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def block(self, i: int) -> np.ndarray:
        if self.held[0] != i:
            self.held = i, decode_block(self.body[self.starts[i] :])
        return self.held[1]

    def between(self, first: int, last: int) -> np.ndarray:
        """Ids first .. last - 1 of the shard, decoding only the blocks that hold them."""
        last = min(last, self.n_ids)
        if first >= last:
            return np.zeros(0, np.uint32)
        low = first // BLOCK
        parts = [self.block(i) for i in range(low, (last - 1) // BLOCK + 1)]
        return (parts[0] if len(parts) == 1 else np.concatenate(parts))[first - low * BLOCK : last - low * BLOCK]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of each document."""
        at = 0
        for i, (key, end) in enumerate(zip(self.doc_ids.tolist(), self.ends.tolist(), strict=True)):
            yield None if i < self.null else key, self.between(at, end)
            at = end


def shards(docs: DataFrame, path: str, encoder=bytebpe.encode, end: int = END, partitions: int | None = None) -> DataFrame:
    """Rows (image) of shard files over ``docs`` in ascending doc_id, ties by a hash of the text.

    Null text is the empty text: its ids are the end id alone. A null doc_id comes first. Rows
    are dealt by id range, so shard numbers ascend with doc_id; a shard never mixes two ranges.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]  # the ranges' bounds are sampled on the driver, so no text is among them
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        ids: list[int | None] = []
        size = number = part = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([encode_shard(held, ids, part, number)], pa.binary())], ["image"])

        for b in batches:
            if b.num_rows:
                part = b.column("part")[0].as_py()
            for at in range(0, b.num_rows, 1024):
                piece = b.slice(at, 1024)
                for key, x in zip(piece.column("doc_id").to_pylist(), encoder(strings(piece.column("text")), path), strict=True):
                    held.append(np.append(x, np.uint32(end)))
                    ids.append(key)
                    size += len(held[-1])
                    if size >= SHARD:
                        yield flush()
                        held, ids, size, number = [], [], 0, number + 1
        if held:
            yield flush()

    return map_arrow(d, run, "image binary")


def write(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write the shards of ``docs`` as files in the folder ``path`` (any store that Spark writes), one a file.

    Spark's text writer puts out a row's bytes as they are, and a line end, which the format has as its last byte.
    """
    images = shards(docs, tokenizer).select(F.expr("substring(image, 1, octet_length(image) - 1)").cast("string").alias("value"))
    images.write.mode("overwrite").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def read(spark, path: str) -> DataFrame:
    """The shard files of a folder, a row each: (image)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.filter("length > 0").select(F.col("content").alias("image"))


def read_documents(files: DataFrame) -> DataFrame:
    """Per document of ``read``'s shards: doc_id, start (ids before it), n_tokens, ids_crc32.

    The ids before a document are those of the parts before its own, of the shards before its own in the part, and of
    the documents before it in the shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "number", "doc_id", "local", "n_tokens", "ids_crc32"]
        for b in batches:
            for image in b.column("image"):
                x = Shard(image.as_py())
                found = [(key, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4"))) for key, ids in x.documents()]
                key, size, crc = zip(*found, strict=True) if found else ((), (), ())
                place = [pa.array([v] * len(key), pa.int32()) for v in (x.part, x.number)]
                yield pa.RecordBatch.from_arrays([*place, pa.array(key, pa.int64()), pa.array(x.ends - np.array(size, np.int64)), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], names)

    found = stored(map_arrow(files, run, "part int, number int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint"), "tokens")
    each = found.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    before = lambda line: F.coalesce(F.sum("n").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # one row a part
    parts = each.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(W.orderBy("part")).alias("_part"))
    base = each.select("part", "number", before(W.partitionBy("part").orderBy("number")).alias("_shard")).join(parts, "part")
    return found.join(base, ["part", "number"]).select("doc_id", (F.col("_part") + F.col("_shard") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "pfor")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(read(spark, path))
