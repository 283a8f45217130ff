"""Sinks. Everything is written in parallel by the tasks that hold the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from marquee.functions.vectors import unit
from marquee.session import cut_lineage
from marquee.sources.payloads import payload_map


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", rows_per_file: int = 0) -> None:
    """CSV with a header; ``rows_per_file`` bounds the rows of each file."""
    writer = df.write.mode(mode).options(header=True, quote='"', escape='"')
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", rows_per_file: int = 0) -> None:
    writer = df.write.mode(mode)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(kind, path: str, spark: SparkSession | None = None):
    """A saved model or pipeline of class ``kind``, read in ``spark`` or the active session."""
    reader = kind.read()
    return (reader.session(spark) if spark is not None else reader).load(path)


def observed(df: DataFrame, write: Callable[[DataFrame], None], **counters: Column) -> dict:
    """Write ``df`` and count beside the write: the counters cost no second scan.

    Returns the counters (aggregates over the rows written) as a dictionary of plain values.
    """
    seen = Observation()
    write(df.observe(seen, *(c.alias(n) for n, c in counters.items())))
    return dict(seen.get)


def collection_points(vectors: DataFrame, payload: DataFrame) -> DataFrame:
    """(id, vector, unit_vector, payload) of every vector that has a payload."""
    joined = vectors.select("id", "vector").join(payload, "id")
    return joined.select(
        "id",
        F.transform("vector", lambda x: x.cast("double")).alias("vector"),
        unit("vector").alias("unit_vector"),
        payload_map(joined).alias("payload"),
    )


def upserted(current: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The table after the new rows replaced their namesakes."""
    return current.join(new.select(key), key, "left_anti").unionByName(new)


def write_collection(
    spark: SparkSession, points: DataFrame, path: str, current: str | None = None, rows_per_file: int = 512
) -> None:
    """Write a new version of the vector collection to ``path``.

    ``current`` names the version to upsert into; without it the collection is
    recreated. A version is never written over the one it reads. An empty input
    is an error.
    """
    if points.isEmpty():
        raise ValueError("no rows to index after joining vectors and payload")
    if current is not None:
        if current.rstrip("/") == path.rstrip("/"):
            raise ValueError("write the new version beside the current one")
        points = upserted(spark.read.parquet(current), points)
    write_parquet(points, path, rows_per_file=rows_per_file)


# -- tables in buckets --------------------------------------------------------------------------------

#: Buckets of a keyed table.
BUCKETS = 256


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    """The bucket of a row: by a hash of its key, so patterned keys spread evenly."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_buckets(
    df: DataFrame, path: str, key: str = "id", buckets: int = BUCKETS, rows_per_file: int = 0, parts: int = 1
) -> None:
    """A keyed table as one folder per bucket; ``upsert_buckets`` rewrites only those it touches.

    ``parts`` tasks write each bucket; files are cut at ``rows_per_file``.
    """
    part = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(parts))
    dealt = df.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket", part)
    writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.partitionBy("bucket").parquet(path)


def upsert_buckets(
    spark: SparkSession, new: DataFrame, path: str, key: str = "id", buckets: int = BUCKETS, rows_per_file: int = 0, parts: int = 1
) -> list[int]:
    """Replace and add rows by key; the buckets that were rewritten.

    Only touched buckets are read (the others are pruned as partitions) and only they are overwritten, when the
    write commits; a failed job leaves the table as it was, and a repeated one gives the same table. ``new`` holds each key once.
    """
    kept = cut_lineage(new.withColumn("bucket", bucket_of(key, buckets)))
    touched = sorted(r.bucket for r in kept.select("bucket").distinct().collect())
    if not touched:
        return []
    current = spark.read.parquet(path).filter(F.col("bucket").isin(touched)).select(*kept.columns)
    write_buckets(upserted(current, kept, key).drop("bucket"), path, key, buckets, rows_per_file, parts)
    return touched


def file_states(spark: SparkSession, path: str) -> DataFrame:
    """(file, modified, bytes) of a table's data files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
