"""Importance resampling of documents towards the distribution of a target corpus.

A text's features are its runs of one to ``n`` consecutive words, hashed into buckets.
Per bucket, the gain is the log ratio of its smoothed shares in the target and in the raw
corpus. A document's weight is the mean gain of its features; Gumbel noise made from
its id turns the weights into a draw without replacement: the highest scores are taken.

Words are found on bytes: a table of 256 bytes lower-cases A-Z and blanks the separators, which
are all ASCII, so UTF-8 stays whole, and ``bytes.split`` yields the words. A run's checksum
is the checksum of the shorter run, continued over a blank and the next word, so no run is
ever put together. Texts are read in pieces cut at blanks; the last words of a
piece go before the next one, so a very long text needs no more memory than its bytes.

Every task counts its own buckets, Spark adds them up; only the ``buckets`` gains reach the
driver. Ranks come from a count per score (there are few different ones, however many
documents) and the order within one score, so no task sees all documents.

Defined cases: NULL and empty texts have no words, weight 0 and are never drawn; a NULL id
counts as the empty string for the noise and stands behind other ids in ties; repeated
rows are scored and drawn each by itself; rows alike in score and id are ordered by their
number of features; an empty corpus gives an empty result, an empty target counts none
in every bucket; other columns are kept whole by :func:`drawn_documents`, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from marquee.llm.shared import small_batches, written
from marquee.llm.textblocks import LOWER, NO_WORD

#: Lower-cases A-Z and blanks every byte that is no part of a word.
WORD_TABLE = np.where(NO_WORD[LOWER], 0x20, LOWER).astype(np.uint8).tobytes()
#: Bytes of a text that are split at a time.
PIECE = 1 << 20
#: Words that are hashed together.
WORDS = 200_000


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, cut between words into lists of about ``size`` bytes."""
    text, start = text.translate(WORD_TABLE), 0
    while start < len(text):
        end = len(text) if len(text) - start <= size else text.find(b" ", start + size)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def segments(texts: list[bytes | None], n: int) -> Iterator[tuple[int, list[bytes], int]]:
    """Text number, words, and how many of them at the front were in the piece before."""
    for number, text in enumerate(texts):
        last: list[bytes] = []
        for words in pieces(text or b""):
            words = last + words
            yield number, words, len(last)
            last = words[max(0, len(words) - n + 1) :]


def features(texts: list[bytes | None], n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Buckets of all runs of 1 to ``n`` words and the number of their text, a run length at a time."""
    block: list[tuple[int, list[bytes], int]] = []
    held = 0
    for segment in segments(texts, n):
        block.append(segment)
        held += len(segment[1])
        if held >= WORDS:
            yield from _block_features(block, n, buckets)
            block, held = [], 0
    if block:
        yield from _block_features(block, n, buckets)


def _block_features(block: list, n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    words = [w for _, some, _ in block for w in some]
    lengths = np.array([len(some) for _, some, _ in block])
    owner = np.repeat(np.arange(len(block)), lengths)
    known = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths) < np.array([k for *_, k in block])[owner]
    number = np.array([i for i, *_ in block])[owner]
    sums = list(map(crc32, words))
    for k in range(1, n + 1):
        if k > 1:
            sums = list(map(crc32, words[k - 1 :], map(crc32, repeat(b" "), sums)))
        m = len(words) - k + 1
        if m <= 0:
            break
        new = (owner[:m] == owner[k - 1 :]) & ~known[k - 1 :]
        yield np.fromiter(sums, np.uint32, m)[new] % np.uint32(buckets), number[:m][new], k


def bucket_counts(texts: DataFrame, text: Column, n: int = 2, buckets: int = 10_000) -> list[int]:
    """Features of all texts per bucket, added up over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            for found, _, _ in features(batch.column(0).to_pylist(), n, buckets):
                part = np.bincount(found, minlength=buckets)
                some = np.flatnonzero(part)
                total.update(dict(zip(some.tolist(), part[some].tolist())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["bucket", "found"])

    source = texts.select(text.cast("binary").alias("text"))
    with small_batches(texts.sparkSession):
        rows = source.mapInArrow(run, "bucket int, found bigint").groupBy("bucket").agg(F.sum("found").alias("found")).collect()
    out = [0] * buckets
    for row in rows:
        out[row.bucket] = row.found
    return out


def gains(raw: list[int], target: list[int]) -> np.ndarray:
    """Per bucket, a thousand times the log ratio of its smoothed shares, rounded down."""
    all_raw, all_target, size = sum(raw), sum(target), len(raw)
    share = lambda s, t: ((t + 1) * float(all_raw + size)) / ((s + 1) * float(all_target + size))
    return np.array([math.floor(1000 * math.log(share(s, t))) for s, t in zip(raw, target)], np.int64)


def scored(
    documents: DataFrame, target: DataFrame, id: Column, text: Column, target_text: Column,
    n: int = 2, buckets: int = 10_000, seed: int = 7, keep: Column | None = None,
) -> DataFrame:
    """Per row: ``id``, ``kept`` (the column ``keep``), ``n_words``, ``n_features``, ``weight`` and ``score``; a written table."""
    gain = gains(bucket_counts(documents, text, n, buckets), bucket_counts(target, target_text, n, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, words, size = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for found, row, k in features(batch.column("text").to_pylist(), n, buckets):
                part = np.bincount(row, minlength=batch.num_rows)
                size += part
                words += part if k == 1 else 0
                total += np.bincount(row, gain[found], minlength=batch.num_rows)
            weight = total.astype(np.int64) // np.maximum(size, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("kept"), pa.array(words), pa.array(size), pa.array(weight)],
                names=["id", "kept", "n_words", "n_features", "weight"],
            )

    source = documents.select(id.alias("id"), (F.lit(True) if keep is None else keep).alias("kept"), text.cast("binary").alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    rows = source.mapInArrow(run, f"id {kinds['id']}, kept {kinds['kept']}, n_words bigint, n_features bigint, weight bigint")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(-1000 * F.log(-F.log(share))).cast("bigint")
    with small_batches(documents.sparkSession):
        return written(rows.withColumn("score", F.col("weight") + noise))


def ranked(rows: DataFrame, percent: int = 25, least_words: int = 20) -> DataFrame:
    """The rows of :func:`scored` with ``rank``: 1, 2, ... for the ``percent`` drawn of those with ``least_words`` words, else NULL."""
    able = F.col("n_words") >= least_words
    per_score = rows.filter(able).groupBy("score").agg(F.count("*").alias("_n"))
    above = F.sum("_n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    above = written(per_score.select("score", above.alias("_above"), "_n"))
    n_drawn = above.agg(F.floor(F.coalesce(F.sum("_n"), F.lit(0)) * percent / 100)).first()[0]
    last = above.filter(F.col("_above") < n_drawn).agg(F.min("score")).first()[0]
    if last is None:
        return rows.withColumn("rank", F.lit(None).cast("bigint"))
    high = able & (F.col("score") >= last)
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("id"), "n_features")
    place = (F.col("_above") + F.row_number().over(order)).cast("bigint")
    top = rows.filter(high).join(above.select("score", "_above"), "score").withColumn("rank", F.when(place <= n_drawn, place))
    return top.select(*rows.columns, "rank").unionByName(rows.filter(~high).withColumn("rank", F.lit(None).cast("bigint")))


def drawn_documents(documents: DataFrame, target: DataFrame, id: str, text: str, target_text: str, percent: int = 25, least_words: int = 20) -> DataFrame:
    """The drawn documents, whole rows, in no order."""
    rows = scored(documents, target, F.col(id), F.col(text), F.col(target_text), keep=F.struct(*(F.col(f"`{c}`") for c in documents.columns)))
    return ranked(rows, percent, least_words).filter("rank IS NOT NULL").select("kept.*")
