"""The fold as a stream: every micro-batch rewrites the entities that its events touch.

The state is a table of unique events beside the projected tables. No watermark: an event of any age changes the
result, or the machines wouldn't converge. A batch recomputes its touched assets from their whole history, which
is a semi-join of the event table with the batch's keys, and swaps their rows; a tag rename rewrites the tags.
"""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import fold
from quillmesh.sources import eventlog
from quillmesh.schemas import EVENT

#: Tables whose rows belong to one asset.
BY_ASSET = {"assets": "id", "instances": "asset", "tag_adds": "asset", "tags": "asset", "fields": "asset", "asset_para": "asset", "verifications": "asset"}
GLOBAL = ("volumes", "para_nodes", "manifests", "saved_searches", "aliases")
VERSION = 1


class IncrementalCatalog:
    """Projected tables in ``root``, one generation per applied batch; the last complete one counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        os.makedirs(root, exist_ok=True)

    def state(self) -> dict:
        """The applied generation; a missing, torn or older state means starting over."""
        try:
            with open(f"{self.root}/state.json") as f:
                s = json.load(f)
            return s if s.get("version") == VERSION else {"version": VERSION, "generation": 0}
        except (FileNotFoundError, ValueError):
            return {"version": VERSION, "generation": 0}

    def table(self, name: str) -> DataFrame | None:
        g = self.state()["generation"]
        return self.spark.read.parquet(f"{self.root}/{g:06d}/{name}") if g else None

    def events(self) -> DataFrame:
        have = self.table("events")
        return have if have is not None else self.spark.createDataFrame([], EVENT)

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in (*BY_ASSET, *GLOBAL)}

    def _write_state(self, generation: int, cursors: dict[str, int]) -> None:
        with open(f"{self.root}/state.tmp", "w") as f:
            json.dump({"version": VERSION, "generation": generation, "cursors": cursors}, f)
        os.replace(f"{self.root}/state.tmp", f"{self.root}/state.json")

    def pull(self, log: str) -> bool:
        """Apply what has been appended to the log at ``log`` since the last pull; whether anything was new.

        The log's cursors are kept with the tables' generation, so both advance together. Where a segment has
        become shorter or is gone, all is built anew.
        """
        try:
            rows, cursors = eventlog.read_since(self.spark, log, self.state().get("cursors", {}))
        except eventlog.StaleCursor:
            self._write_state(0, {})
            rows, cursors = eventlog.read_since(self.spark, log, {})
        return self.apply(eventlog.events(rows), cursors)

    def apply(self, batch: DataFrame, cursors: dict[str, int] | None = None) -> bool:
        """Apply events; whether anything was new. Applying a batch again changes nothing."""
        have = self.state().get("cursors", {})
        cursors = have if cursors is None else cursors
        batch = batch.select("id", "hlc", "author", "op").persist()
        try:
            old = self.state()["generation"]
            fresh = fold.unique(batch).join(self.events().select("id"), "id", "left_anti").persist()
            if old and not fresh.limit(1).count():
                if cursors != have:
                    self._write_state(old, cursors)
                return False
            new = f"{self.root}/{old + 1:06d}"
            shutil.rmtree(new, ignore_errors=True)
            self.events().unionByName(fresh).write.parquet(f"{new}/events")
            every = self.spark.read.parquet(f"{new}/events")
            touched = fresh.select(F.col("op.asset").alias("asset")).filter("asset is not null").distinct()
            renamed = bool(fresh.filter("op.type = 'tag_renamed'").limit(1).count())
            mine = every.withColumn("asset", F.col("op.asset")).join(touched, "asset", "left_semi").drop("asset")
            part = fold.project(mine.unionByName(every.filter("op.asset is null")))
            whole = fold.project(every) if renamed or not old else None
            for name, key in BY_ASSET.items():
                if whole is not None and (name == "tags" or not old):
                    rows = getattr(whole, name)
                else:
                    rows = self.table(name).join(touched.withColumnRenamed("asset", key), key, "left_anti").unionByName(getattr(part, name).join(touched.withColumnRenamed("asset", key), key, "left_semi"))
                rows.write.parquet(f"{new}/{name}")
            for name in GLOBAL:
                getattr(part, name).write.parquet(f"{new}/{name}")
            self._write_state(old + 1, cursors)
            if old:
                shutil.rmtree(f"{self.root}/{old:06d}", ignore_errors=True)
            return True
        finally:
            batch.unpersist()

    def follow(self, stream: DataFrame, checkpoint: str, once: bool = True, every: str = "5 seconds"):
        """Apply a stream of events batch by batch: all that is there now, or for ever at an interval."""
        w = stream.writeStream.foreachBatch(lambda df, _: self.apply(df)).option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()
