"""Resumable ingest: new batch files only, each exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from marquee.functions.columns import union_all
from marquee.operators.dedupe import last_batch
from marquee.session import cut_lineage
from marquee.sources.readers import BATCH_ORDER, MALFORMED, with_malformed
from marquee.sources.sinks import BUCKETS, bucket_of, write_buckets


def new_batches(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Stream of the rows of batch files that were not ingested before.

    A row that does not fit the schema comes with its text in ``_malformed``:
    ingested like the others, it can be counted and looked at in the table. A file that
    cannot be read does not stop the stream; ``readers.unreadable_files`` lists it.
    """
    return (
        spark.readStream.schema(with_malformed(schema))
        .options(header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=MALFORMED)
        .option("ignoreCorruptFiles", "true")
        .csv(folder)
        .withColumn("batch_file", F.col("_metadata.file_path"))
    )


def ingest(batches: DataFrame, table: str, progress: str) -> StreamingQuery:
    """Append all waiting batches to a Parquet table and stop.

    ``progress`` is the checkpoint folder: a job that died goes on where it
    stopped, and a file that was ingested is never read again. Later rows of an
    id are resolved when the table is read (keep last per id).
    """
    return (
        batches.writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", progress)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


# -- incremental enrichment ---------------------------------------------------------------------------


def merge_batch(
    spark: SparkSession, rows: DataFrame, batch_id: int, table: str, buckets: int = BUCKETS
) -> None:
    """Merge one micro-batch into a keyed table: the row of the latest batch file stays for each id.

    ``rows`` carry the batch order (``BATCH_ORDER``), which is kept in the table beside the id of the
    micro-batch, so an older file that comes late changes nothing. The merge is idempotent: a micro-batch that runs again, after
    a failure or by hand, finds its own rows there and leaves the same table.
    """
    new = last_batch(rows.filter(F.col("id").isNotNull()), BATCH_ORDER).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    new = cut_lineage(new.withColumn("bucket", bucket_of("id", buckets)))
    touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
    if not touched:
        return
    known = _existing(spark, table, new.schema)
    current = known.filter(F.col("bucket").isin(touched)).select(*new.columns)
    # Of equal batch positions the stored row stays, so a repeated micro-batch keeps its first number.
    both = union_all([current.withColumn("_old", F.lit(1)), new.withColumn("_old", F.lit(0))])
    merged = last_batch(both, [*BATCH_ORDER, "_old"]).drop("_old", "bucket")
    write_buckets(merged, table, "id", buckets)


def _existing(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """The table so far; empty before the first merge."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(schema).parquet(table)
    return spark.createDataFrame([], schema)


def enrich(batches: DataFrame, table: str, progress: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Merge all waiting batch files into the enrichment table and stop.

    ``batches`` as of :func:`new_batches`; rows that do not fit the schema are left to the ingest.
    """

    def merge(rows: DataFrame, batch_id: int) -> None:
        good = rows.filter(F.col(MALFORMED).isNull()).drop(MALFORMED)
        ordered = good.withColumn("batch_row", F.monotonically_increasing_id())
        merge_batch(rows.sparkSession, ordered, batch_id, table, buckets)

    return (
        batches.writeStream.foreachBatch(merge)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
