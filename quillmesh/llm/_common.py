"""Helpers shared by the operators: the shared folder, durable intermediate tables, batching."""

from __future__ import annotations

import atexit
import ctypes
import functools
import operator
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that setting is absent, a local session (all of it on one machine, as in tests) gets a folder of its own;
    on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillmesh-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system API, whichever store holds it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Folders written and not yet deleted, oldest first.
_written: list[tuple[SparkSession, str]] = []


def _forget(written: list[tuple[SparkSession, str]]) -> None:
    for spark, path in written:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is then left
            pass


atexit.register(_forget, _written)


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of our own in the shared one; it goes when the driver's process ends, or by ``discard``."""
    path = f"{shared_dir(spark)}/quillmesh/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs a re-read and not a recomputation.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """Place in the list of written folders, for ``discard``."""
    return len(_written)


def discard(since: int, but: int = 0) -> None:
    """Delete the folders written since ``mark()`` gave ``since``, but for the last ``but`` ones: nothing reads them any more."""
    top = len(_written) - but
    gone, _written[since:top] = _written[since:top], []
    _forget(gone)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (extra columns may clash with ours)."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Ranges of about equally many rows, and how many of their bounds are compared at once.
COARSE, STEP = 256, 16


def id_ranges(df: DataFrame, key: str) -> tuple[Column, int]:
    """Number of the id range that ``key`` falls in, ascending with the id, and how many ranges there are, about sqrt(rows).

    COARSE ranges of about equally many rows each (by approximate percentiles, so ids may be spread in any way)
    are cut into ranges of equal width. Both the rows of a range and the number of ranges grow with about the
    square root of the table, so neither ever has to fit one task.
    """
    n, low, high, cuts = df.agg(F.count(key), F.min(key), F.max(key), F.percentile_approx(key, [i / COARSE for i in range(1, COARSE)])).first()
    if not n:
        return F.lit(0).cast("long"), 1
    fine = max(1, round(n**0.5 / COARSE))
    start = [low, *sorted({x for x in cuts if x > low})]
    width = [max(1.0, (b - a) / fine) for a, b in zip(start, [*start[1:], high + 1], strict=True)]
    id_, longs = F.col(key).cast("long"), lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    rows = [start[i : i + STEP] for i in range(0, len(start), STEP)]
    at_most = lambda xs: functools.reduce(operator.add, [(x <= id_).cast("int") for x in xs], F.lit(0))
    row = at_most([F.lit(r[0]).cast("long") for r in rows]) - 1
    in_row = F.get(F.array(*[longs(r + [(1 << 63) - 1] * (STEP - len(r))) for r in rows]), row)
    coarse = row * STEP + at_most([F.get(in_row, F.lit(i)) for i in range(STEP)]) - 1
    within = F.floor((id_.cast("double") - F.get(longs(start), coarse).cast("double")) / F.get(F.array(*map(F.lit, width)), coarse))
    return coarse.cast("long") * fine + F.least(within, F.lit(fine - 1)), len(start) * fine


def text_chunks(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of ``limit`` code points together (one longer text is a run of its own)."""
    at = start = size = 0
    for at, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, texts[start:at]
            start, size = at, 0
        size += len(text)
    if texts:
        yield start, texts[start:]


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Values as str, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


_shipped: set[str] = set()


def _give_back() -> None:
    """Hand freed memory back to the system: a worker that is used again would keep its peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


#: Bytes of a batch that goes to a Python worker, unless the session says otherwise: rows may be long texts or sets.
_BATCH, _BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 8 << 20


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with this package sent to the executors, whose workers may not have it installed.

    Where the session has Spark's default of 64 MB a batch, batches get smaller: both sides hold one whole.
    """
    spark = df.sparkSession
    if spark.conf.get(_BATCH) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="quillmesh-")) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, path.relative_to(root.parent))
        context.addPyFile(str(archive.resolve()))
        _shipped.add(context.applicationId)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        _give_back()

    return df.mapInArrow(task, schema)


def extended(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of ``df`` with further fields."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])
