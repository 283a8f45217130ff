"""Scans. Schemas are explicit, so a scan never reads the data twice."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from marquee.functions.columns import has_text, number, present
from marquee.operators.dedupe import first_batch


def read_csv(
    spark: SparkSession, path: str | list[str], schema: StructType | str | None = None, line_ends: bool = True, **options
) -> DataFrame:
    """CSV with a header; quoted values may hold quotes and, with ``line_ends``, line ends.

    A file whose values may hold line ends is read by one task; without them large files are split.
    Without a schema every column is text. ``inferSchema=True`` is possible but
    costs a second pass.
    """
    reader = spark.read.options(header=True, multiLine=line_ends, quote='"', escape='"', **options)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def read_documents(spark: SparkSession, path: str, line_ends: bool = True) -> DataFrame:
    """The columns that vector training reads, cast, without blank rows."""
    raw = read_csv(spark, path, line_ends=line_ends)
    return model_input(raw)


def model_input(raw: DataFrame) -> DataFrame:
    """Typed rows with an id, a title and a document."""
    return (
        raw.select(
            number("id", "bigint").alias("id"),
            "title",
            number("release_year", "int").alias("release_year"),
            "genres_text",
            *(
                number(c).alias(c)
                for c in present(raw, ["vote_average", "vote_count", "popularity", "recommendation_quality_score"])
            ),
            F.trim("movie_document_weighted").alias("movie_document_weighted"),
        )
        .dropna(subset=["id", "title"])
        .filter(has_text("movie_document_weighted"))
    )


MALFORMED = "_malformed"


def with_malformed(schema: StructType | str) -> StructType:
    """The schema with a column that keeps the text of rows that do not fit it."""
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return StructType([*fields.fields, StructField(MALFORMED, StringType())])


def checked_batches(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All batch files of a folder as one frame with the path of its file.

    A row that does not fit the schema is kept with its text in ``_malformed``; all
    columns are parsed for that, whichever are read.
    The path, and the position of the row in its file, give the batch order: a
    file is read by one task, in order. Batch files hold a bounded number of
    rows, so reading each whole (values may hold line ends) stays small. A file
    that cannot be read whole is left out; :func:`unreadable_files` lists those.
    """
    batches = read_csv(
        spark, path, with_malformed(schema), mode="PERMISSIVE", columnNameOfCorruptRecord=MALFORMED, ignoreCorruptFiles="true"
    )
    # always true; it names every column, as the parser checks only those that are read
    whole = F.hash(*(c for c in batches.columns)) >= F.lit(-(1 << 31))
    rows = batches.filter(whole).select(
        "*",
        F.col("_metadata.file_path").alias("batch_file"),
        F.monotonically_increasing_id().alias("batch_row"),
    )
    broken = unreadable_files(spark, path).select(F.col("file").alias("batch_file"))
    return rows.join(broken, "batch_file", "left_anti").select(rows.columns)


def _reason(name: str, content: bytes) -> str | None:
    """Why a batch file cannot be read, or None."""
    try:
        data = zlib.decompress(content, wbits=31) if name.endswith(".gz") else content
    except zlib.error:
        return "damaged"
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return "not_text"
    return None if text.strip() else "empty"


def unreadable_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, reason) of the batch files that cannot be read: damaged, not text, or without even a header.

    Each file's bytes are looked at by the task that reads them; files hold a bounded number of rows.
    """

    @F.pandas_udf("string")
    def reason(names: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([_reason(n, c) for n, c in zip(names, contents)], dtype=object)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv*").load(path)
    looked = files.select(F.col("_metadata.file_path").alias("file"), reason(F.col("path"), F.col("content")).alias("reason"))
    return looked.filter(F.col("reason").isNotNull())


def read_batches(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of all batch files that fit the schema; :func:`quarantined_rows` gives the others."""
    return checked_batches(spark, path, schema).filter(F.col(MALFORMED).isNull()).drop(MALFORMED)


def quarantined_rows(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of all batch files that do not fit the schema: file, place and text."""
    checked = checked_batches(spark, path, schema).filter(F.col(MALFORMED).isNotNull())
    return checked.select("batch_file", "batch_row", F.col(MALFORMED).alias("text"))


def batch_counts(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Valid and malformed rows per batch file."""
    bad = F.col(MALFORMED).isNotNull()
    counts = [F.sum(F.when(x, 1).otherwise(0)).alias(name) for name, x in (("n_valid", ~bad), ("n_malformed", bad))]
    return checked_batches(spark, path, schema).groupBy("batch_file").agg(*counts)


BATCH_ORDER = ["batch_file", "batch_row"]


def combine_batches(batches: DataFrame) -> DataFrame:
    """First row per id over all batches in file order, dates parsed."""
    first = first_batch(batches, BATCH_ORDER)
    return first.drop(*BATCH_ORDER).withColumn(
        "release_date", F.col("release_date").try_cast("date")
    )


def lookup(ids: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """Point lookups as one join; ids without a row have status ``not_found``."""
    found = table.withColumn("_hit", F.lit(True))
    return ids.join(found, key, "left").withColumn(
        "status", F.when(F.col("_hit"), "found").otherwise("not_found")
    ).drop("_hit")
