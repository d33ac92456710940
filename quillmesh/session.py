"""The session that the catalog expects: UTC, adaptive plans, partitions in step with the cores."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "quillmesh", master: str | None = None, **conf: str) -> SparkSession:
    cores = os.cpu_count() or 1
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master).config("spark.sql.shuffle.partitions", str(2 * cores)).config("spark.ui.enabled", "false")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
