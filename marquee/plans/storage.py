"""Scratch folders, and tables that are prepared once per session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[tuple[str, str, str], str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints of the cluster; local sessions may have their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/marquee-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return tempfile.mkdtemp(prefix="marquee-")


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A prepared table: built once per session, read as Parquet afterwards."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        path = f"{scratch_folder(spark)}/{name}"
        build().write.mode("overwrite").parquet(path, compression="zstd")
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def stored_folder(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], object]) -> str:
    """A folder that ``build`` fills, once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        path = f"{scratch_folder(spark)}/{name}"
        build(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]
