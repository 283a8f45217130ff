"""Line deduplication over levelled sorted runs of line keys.

The corpus is taken in batches. A batch gives the number of its documents per
line key, and is merge-anti-joined with the runs so far: keys that a run already
holds at the limit need no further counting. What is left is written as a run of
its own, bucketed and sorted by key, so runs meet bucket by bucket without a
shuffle. When a level holds two runs they are compacted into one of the next
level: counts are added, and stop at the limit. So a batch costs its own lines,
not all lines before it, and at any time there are at most log2(batches) runs.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z
lower-cased, as a 128-bit hash. Lines whose key has ``min_chars`` code points or
more and stands in ``min_documents`` or more documents are dropped everywhere.

Defined cases: a NULL text is one empty line and comes back empty; an empty line
has no key with ``min_chars`` of 1 or more and stays; every input row is a document,
so repeated rows count each; NULL or repeated ids are fine, as rows are found
by a hash of id and text; an empty table gives an empty result; other columns
pass through, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from marquee.llm.shared import partitions, released_shuffles, shared_folder, written
from marquee.llm.textblocks import LOWER, SPACES, binary16, row_blocks, span_hashes, text_bytes

_ROW = ("__row1", "__row2")


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines and their text; every text has one line at least."""
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets[1:], breaks, side="right")
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, offsets[1:]])
    texts = np.arange(len(offsets) - 1)
    first = np.concatenate([texts, owner])
    last = np.concatenate([owner, texts])
    return starts[np.lexsort((starts, first))], ends[np.lexsort((ends, last))], np.sort(first)


def line_keys(column: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, line number and 128-bit key of every line whose key is long enough."""
    data, offsets = text_bytes(column)
    starts, ends, text = line_spans(data, offsets)
    number = np.arange(len(text)) - np.searchsorted(text, text)
    solid = np.flatnonzero(~SPACES[data])
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = low < high
    begin = np.where(some, solid[np.minimum(low, max(len(solid) - 1, 0))], starts) if len(solid) else starts
    end = np.where(some, solid[np.maximum(high - 1, 0)] + 1, begin) if len(solid) else begin
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    keep = points[end] - points[begin] >= min_chars
    begin, end, lower = begin[keep], end[keep], LOWER[data]
    return text[keep], number[keep], span_hashes(lower, begin, end, 1), span_hashes(lower, begin, end, 2)


class LineRuns:
    """Document counts of line keys, as levelled sorted runs in the shared folder."""

    def __init__(self, spark: SparkSession, min_documents: int) -> None:
        self.spark, self.limit = spark, min_documents
        self.buckets = partitions(spark)
        self.levels: list[str | None] = []
        self.tables: list[str] = []

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = df.repartition(self.buckets, "key").write.format("parquet").bucketBy(self.buckets, "key").sortBy("key")
        with released_shuffles(self.spark):
            writer.option("path", f"{shared_folder(self.spark)}/{name}").saveAsTable(name)
        self.tables.append(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for name in self.levels if name]

    def add(self, lines: DataFrame) -> None:
        """Count a batch: one row of ``key`` for each document that has the line."""
        new = lines.groupBy("key").agg(F.count("*").alias("n"))
        for run in self.runs():
            new = new.join(run.filter(F.col("n") >= self.limit).select("key"), "key", "left_anti")
        carried, level = self._write(new), 0
        while level < len(self.levels) and self.levels[level]:
            carried = self._write(self.merged(self.spark.table(self.levels[level]), self.spark.table(carried)))
            self.levels[level] = None
            level += 1
        self.levels += [None] * (level + 1 - len(self.levels))
        self.levels[level] = carried

    def merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Two runs as one; counts stop at the limit."""
        b = b.withColumnRenamed("n", "m")
        n = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
        return a.join(b, "key", "full_outer").select("key", F.least(n, F.lit(self.limit).cast("bigint")).alias("n"))

    def frequent(self) -> DataFrame:
        """Keys that reach the limit."""
        runs = self.runs()
        whole = runs[0]
        for run in runs[1:]:
            whole = self.merged(whole, run)
        return whole.filter(F.col("n") >= self.limit).select("key")

    def forget(self) -> None:
        """Take the runs out of the session's catalogue."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def document_lines(documents: DataFrame, text: str, min_chars: int) -> DataFrame:
    """Row key, line number and line key of all lines that can be dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in row_blocks(batches, "text"):
            owner, number, one, two = line_keys(block.column("text"), min_chars)
            order = np.lexsort((number, two, one, owner))
            owner, number, one, two = owner[order], number[order], one[order], two[order]
            first = np.ones(len(owner), bool)
            first[1:] = (owner[1:] != owner[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            starts = np.flatnonzero(first).astype(np.int32)
            numbers = pa.ListArray.from_arrays(pa.array(np.append(starts, len(owner)).astype(np.int32)), pa.array(number.astype(np.int32)))
            rows = pa.array(owner[first])
            yield pa.RecordBatch.from_arrays(
                [block.column(_ROW[0]).take(rows), block.column(_ROW[1]).take(rows), numbers, binary16(one[first], two[first])],
                names=[*_ROW, "numbers", "key"],
            )

    return documents.select(*_ROW, F.col(text).alias("text")).mapInArrow(
        run, f"{_ROW[0]} bigint, {_ROW[1]} bigint, numbers array<int>, key binary"
    )


def without_frequent_lines(
    documents: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = 1, min_documents: int = 10, batches: int = 4
) -> DataFrame:
    """``documents`` with ``text`` less its frequent lines, and the columns
    ``__n_lines`` and ``__n_dropped``. Lines are counted in ``batches`` batches.
    """
    spark = documents.sparkSession
    row = (F.xxhash64(F.lit(1), key, text), F.xxhash64(F.lit(2), text, key))
    documents = documents.withColumns(dict(zip(_ROW, row)))
    lines = document_lines(documents, text, min_chars)
    lines = written(lines.withColumn("batch", F.pmod(F.col(_ROW[0]), F.lit(batches)).cast("int")), "batch")
    counted = LineRuns(spark, min_documents)
    for batch in range(batches):
        counted.add(lines.filter(F.col("batch") == batch).select("key"))
    dropped = written(
        lines.join(counted.frequent(), "key")
        .select(*_ROW, F.explode("numbers").alias("number"))
        .groupBy(*_ROW).agg(F.collect_set("number").alias("__gone"))
    )
    counted.forget()
    gone = F.coalesce("__gone", F.array().cast("array<int>"))
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    kept = F.transform(F.array(F.struct(split.alias("lines"), gone.alias("gone"))), _kept)[0]
    return (
        documents.join(dropped, list(_ROW), "left")
        .withColumn("__kept", kept)
        .withColumns({text: F.col("__kept.text"), "__n_lines": F.col("__kept.n"), "__n_dropped": F.size(gone).cast("bigint")})
        .drop("__kept", "__gone", *_ROW)
    )


def _kept(x):
    """Lines whose numbers are not among the dropped, joined again."""
    n = F.size(x["lines"])
    left = F.array_except(F.sequence(F.lit(0), n - 1), x["gone"])
    text = F.when(F.size(x["gone"]) == 0, F.array_join(x["lines"], "\n")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(x["lines"], i)), "\n")
    )
    return F.struct(text.alias("text"), n.cast("bigint").alias("n"))
