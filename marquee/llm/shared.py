"""Folders that driver and executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="marquee-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the writes inside."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def released_shuffles(spark: SparkSession):
    """Shuffle files of the writes inside go as soon as a write has ended: its rows are in the shared folder then."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession, rows: int = 1000):
    """Texts of the writes inside go to Python in batches of few rows, as a batch lies in memory on both sides."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, read again at will."""
    spark = df.sparkSession
    path = shared_folder(spark)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    with released_shuffles(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes tables of :func:`written`, or unions of them, that nothing reads any more."""
    for table in tables:
        session = table.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = session._jvm.org.apache.hadoop.fs.Path(session._jvm.java.net.URI(folder))
            path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def bucketed(df: DataFrame, key: str) -> Iterator[DataFrame]:
    """``df`` written in buckets of ``key``: joins on it inside the block don't shuffle it again."""
    spark = df.sparkSession
    name = f"llm_{uuid.uuid4().hex}"
    writer = df.repartition(partitions(spark), key).write.format("parquet").bucketBy(partitions(spark), key)
    with released_shuffles(spark):
        writer.option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


#: Parts of a share of rows that is drawn by hash.
PARTS = 1 << 40


def label_shares(total: dict[float, int], bound: int) -> dict[float, int]:
    """Share of each label's rows, in ``PARTS``, that draws about ``bound`` rows in all.

    Each label gives an equal part of them, and more where another label has too few: a rare label is taken whole.
    """
    rows, each = sum(total.values()), max(1, bound // max(1, len(total)))
    take = {label: max(each, bound - (rows - n)) for label, n in total.items()}
    return {label: PARTS if take[label] >= n else max(1, take[label] * PARTS // n) for label, n in total.items()}


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
