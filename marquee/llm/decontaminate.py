"""Benchmark decontamination with suffix arrays of the training text.

Every block of training texts is a shard with a word suffix array: word positions
ordered by the codes of the words that follow. The order is refined only where a test
suffix needs it: first by three words, then, inside the ranges that a test suffix has
reached, by the next ones. All test suffixes are binary-searched in each shard
together, down to the window's length; what remains is extended word by word to
the longest verbatim match and its places.

A word is ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z were lower-cased; words
are compared by 64-bit hashes. A window is ``window`` consecutive words of an item;
an item of fewer words, but not none, is one window. Matches never leave a document.

The benchmark is read in blocks of ``block_bytes`` at most (or one longer item), each
sent to all tasks; its size is taken before. A larger benchmark means more passes
over the training text, not more memory.

Defined cases: a NULL or empty text has no words and no hit; an item without words
matches nothing; items with equal texts are all named; repeated rows are judged
row by row; an empty benchmark or table gives no hits or no rows; other columns
pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marquee.llm.textblocks import LOWER, NO_WORD, row_blocks, text_bytes, word_hashes, word_spans

#: Benchmark text that one pass holds in each task.
BENCHMARK_BYTES = 16 << 20


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row and each text's first word."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, NO_WORD)
    return word_hashes(data, starts, ends), first


class TestItems:
    """Words of one benchmark block and where its windows begin."""

    __test__ = False

    def __init__(self, ids: list[str], column: pa.Array, window: int) -> None:
        self.window = window
        self.words, self.first = words_of(column)
        self.ids = ids
        counts = np.diff(self.first)
        #: windows by length: starts and items
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in sorted({min(int(c), window) for c in counts if c}):
            items = np.flatnonzero(counts >= window if length == window else counts == length)
            runs = counts[items] - length + 1
            item = np.repeat(items, runs)
            start = np.arange(len(item)) - np.repeat(np.cumsum(runs) - runs, runs) + self.first[item]
            self.windows[length] = start, item


class Shard:
    """The suffix array of one block of training texts, refined on demand."""

    def __init__(self, words: np.ndarray, first: np.ndarray, tests: TestItems) -> None:
        self.first = first
        codes, vocabulary = pd.factorize(words)
        # codes of several words make one ordered number of at most 63 bits
        self.bits = max(21, (len(vocabulary) + 3).bit_length())
        self.per = 63 // self.bits
        # a zero after each text keeps matches inside it
        self.at = np.arange(len(words)) + np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.codes = np.zeros(len(words) + len(first) + 3, np.int64)
        self.codes[self.at] = codes + 2
        # 1 is a word that this shard does not have, and the end of an item
        self.test_at = np.arange(len(tests.words)) + np.repeat(np.arange(len(tests.first) - 1), np.diff(tests.first))
        self.test_codes = np.ones(len(tests.words) + len(tests.first) + 3, np.int64)
        self.test_codes[self.test_at] = np.maximum(pd.Index(vocabulary).get_indexer(tests.words), -1) + 2
        keys = self._keys(self.codes, self.at, self.per)
        order = np.argsort(keys)
        self.suffixes, self.keys = self.at[order], keys[order]

    def _keys(self, codes: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
        """The next ``words`` words at each place as one ordered number."""
        key = np.zeros(len(at), np.int64)
        for k in range(words):
            key = key << self.bits | codes[at + k]
        return key << self.bits * (self.per - words)

    def search(self, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places whose next ``length`` words equal those of a test suffix.

        Returns the places ordered by class, the class of each test suffix (-1: found nowhere),
        and the bounds of each class in the places.
        """
        step = min(self.per, length)
        low_key = self._keys(self.test_codes, starts, step)
        distinct, klass = np.unique(low_key, return_inverse=True)
        low = np.searchsorted(self.keys, distinct)
        high = np.searchsorted(self.keys, distinct + (1 << self.bits * (self.per - step)))
        sizes = high - low
        places = self.suffixes[np.repeat(low, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
        owner = np.repeat(np.arange(len(distinct)), sizes)
        klass = np.where(sizes[klass] > 0, klass, -1)
        depth = step
        while depth < length and len(places):
            step = min(self.per, length - depth)
            places, owner, klass = self._refine(places, owner, klass, starts, depth, step)
            depth += step
        found = klass >= 0
        if not len(places):
            klass, found = np.full(len(starts), -1), np.zeros(len(starts), bool)
        top = int(klass.max(initial=-1)) + 1
        bounds = np.searchsorted(owner, np.arange(top + 1))
        return places, np.where(found, klass, -1), bounds

    def _refine(self, places, owner, klass, starts, depth: int, step: int):
        """Order the reached ranges by the next ``step`` words and search the test suffixes in them."""
        live = np.flatnonzero(klass >= 0)
        wanted, index = np.unique(self._keys(self.test_codes, starts[live] + depth, step), return_inverse=True)
        pair = klass[live] * np.int64(len(wanted)) + index
        classes, new = np.unique(pair, return_inverse=True)
        keys = self._keys(self.codes, places + depth, step)
        where = np.searchsorted(wanted, keys)
        some = where < len(wanted)
        some[some] = wanted[where[some]] == keys[some]
        places, pairs = places[some], owner[some] * np.int64(len(wanted)) + where[some]
        where = np.searchsorted(classes, pairs)
        some = where < len(classes)
        some[some] = classes[where[some]] == pairs[some]
        places, owner = places[some], where[some]
        order = np.argsort(owner, kind="stable")
        places, owner = places[order], owner[order]
        reached = np.zeros(len(classes), bool)
        reached[owner] = True
        out = np.full(len(klass), -1, np.int64)
        out[live] = np.where(reached[new], new, -1)
        return places, owner, out

    def text_of(self, places: np.ndarray) -> np.ndarray:
        """Text index of each place."""
        return np.searchsorted(self.first[1:] + np.arange(1, len(self.first)), places, side="right")

    def word_of(self, places: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Number of the place's word in its text."""
        return places - text - self.first[text]


def block_hits(column: pa.Array, tests: TestItems) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: words; hit spans as (text, start, end) merged; (text, item) pairs."""
    words, first = words_of(column)
    counts = np.diff(first)
    shard = Shard(words, first, tests)
    change = np.zeros(len(shard.codes) + 1, np.int64)
    pairs = []
    for length, (starts, items) in tests.windows.items():
        places, klass, bounds = shard.search(shard.test_at[starts], length)
        if not len(places):
            continue
        np.add.at(change, places, 1)
        np.add.at(change, places + length, -1)
        found = klass >= 0
        links = np.unique(np.stack([klass[found], items[found]]), axis=1)
        class_text = np.unique(np.stack([np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), shard.text_of(places)]), axis=1)
        low, high = np.searchsorted(links[0], class_text[0]), np.searchsorted(links[0], class_text[0], side="right")
        size = high - low
        at = np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        pairs.append(np.stack([np.repeat(class_text[1], size), links[1][at]]))
    pairs = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), np.int64)
    hit = np.concatenate([[0], (np.cumsum(change) > 0).astype(np.int8), [0]])
    begin, end = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
    text = shard.text_of(begin)
    spans = np.stack([text, shard.word_of(begin, text), shard.word_of(end, text)])
    return counts, spans, pairs, shard


def _lists(rows: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """``values`` as one list per row; ``rows`` is ordered."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), values)


def test_blocks(benchmark: DataFrame, item: str, text: str, window: int, block_bytes: int) -> Iterator[TestItems]:
    """The benchmark in blocks of bounded size."""
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 64
    total, most = benchmark.agg(F.sum(size), F.max(size)).first()
    n = max(1, -(-(total or 0) // max(1, block_bytes // 2)))
    part = F.pmod(F.xxhash64(F.col(item).cast("string"), text), F.lit(n))
    for k in range(n):
        rows = benchmark.filter(part == k).select(F.col(item).cast("string"), F.coalesce(F.col(text), F.lit(""))).collect()
        yield TestItems([r[0] for r in rows], pa.array([r[1] for r in rows], pa.string()), window)


def contamination(
    documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = 10, block_bytes: int = BENCHMARK_BYTES,
) -> DataFrame:
    """Per document: key, words, hit words, the hit spans of words, and the items with occurring windows."""
    source = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    blocks = list(test_blocks(benchmark, item, item_text, window, block_bytes))
    if len(blocks) > 1:
        source = source.withColumn("row", F.struct(F.xxhash64(F.lit(1), "key", "text"), F.xxhash64(F.lit(2), "text", "key")))
    passes = [source.drop("row").mapInArrow(_hits(tests), f"key {kind}, n_words bigint, spans array<struct<start:int,end:int>>, items array<string>") for tests in blocks]
    if len(blocks) == 1:
        return _counted(passes[0])
    rows = [
        source.select("key", "text", "row").mapInArrow(
            _hits(tests, ["row"]), f"key {kind}, n_words bigint, spans array<struct<start:int,end:int>>, items array<string>, row struct<col1:bigint,col2:bigint>"
        ).groupBy("row").agg(F.count("*").alias("copies"), F.first("key").alias("key"), F.first("n_words").alias("n_words"), F.first("spans").alias("spans"), F.first("items").alias("items"))
        for tests in blocks
    ]
    whole = rows[0]
    for other in rows[1:]:
        whole = whole.unionByName(other)
    merged = whole.groupBy("row").agg(
        F.first("copies").alias("copies"), F.first("key").alias("key"), F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )
    joined = F.aggregate(
        "spans", F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]), F.concat(
            F.slice(done, 1, F.size(done) - 1),
            F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))),
        )).otherwise(F.concat(done, F.array(s))),
    )
    spread = merged.withColumn("spans", F.when(F.size("spans") > 0, joined).otherwise(F.col("spans")))
    return _counted(spread.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copy", "copies", "row"))


def _counted(rows: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return rows.select("key", "n_words", n_hit.alias("n_hit"), "spans", F.array_distinct("items").alias("items"))


def _hits(tests: TestItems, carried: list[str] | None = None):
    carried = carried or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(tests.ids, pa.string())
        for block in row_blocks(batches, "text"):
            counts, spans, pairs, _ = block_hits(block.column("text"), tests)
            n = block.num_rows
            span = pa.StructArray.from_arrays([pa.array(spans[1].astype(np.int32)), pa.array(spans[2].astype(np.int32))], names=["start", "end"])
            columns = [block.column("key"), pa.array(counts.astype(np.int64)), _lists(spans[0], n, span), _lists(pairs[0], n, names.take(pa.array(pairs[1])))]
            yield pa.RecordBatch.from_arrays(columns + [block.column(c) for c in carried], names=["key", "n_words", "spans", "items", *carried])

    return run


def decontaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """``documents`` without those that hold a window of the benchmark; all columns stay as they are."""

    def clean(tests: TestItems):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in row_blocks(batches, text):
                spans = block_hits(block.column(text), tests)[1]
                keep = np.ones(block.num_rows, bool)
                keep[spans[0]] = False
                yield block.filter(pa.array(keep))

        return run

    for tests in test_blocks(benchmark, item, item_text, window, block_bytes):
        documents = documents.mapInArrow(clean(tests), documents.schema)
    return documents


def longest_matches(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """For every test suffix that matches ``window`` words somewhere: item, its word, the longest
    verbatim match in words over all shards, how many places reach ``window`` words, and one place
    (document and word) of the longest match.
    """
    source = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    schema = f"item string, item_word int, length int, places bigint, key {kind}, word int"

    def search(tests: TestItems):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            starts, items = tests.windows.get(window, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            for block in row_blocks(batches, "text"):
                words, first = words_of(block.column("text"))
                shard = Shard(words, first, tests)
                places, klass, bounds = shard.search(shard.test_at[starts] if len(starts) else starts, window)
                reached = np.flatnonzero(klass >= 0)
                if not len(reached):
                    continue
                at = shard.test_at[starts[reached]]
                total = np.diff(bounds)[klass[reached]]
                owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                live, depth = np.arange(len(reached)), window
                best = np.full(len(reached), window)
                place = places[bounds[klass[reached]]].copy()
                state = klass[reached].copy()
                while len(live):
                    places, owner, state_live = shard._refine(places, owner, state[live], at[live], depth, 1)
                    depth += 1
                    found = state_live >= 0
                    live = live[found]
                    state[live] = state_live[found]
                    best[live] = depth
                    place[live] = places[np.searchsorted(owner, state[live])]
                text_index = shard.text_of(place)
                rows = [tests.ids[i] for i in items[reached]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows, pa.string()), pa.array((starts[reached] - tests.first[items[reached]]).astype(np.int32)), pa.array(best.astype(np.int32)),
                        pa.array(total.astype(np.int64)), block.column("key").take(pa.array(text_index)), pa.array(shard.word_of(place, text_index).astype(np.int32)),
                    ],
                    names=["item", "item_word", "length", "places", "key", "word"],
                )

        return run

    found = [source.mapInArrow(search(t), schema) for t in test_blocks(benchmark, item, item_text, window, block_bytes)]
    whole = found[0]
    for other in found[1:]:
        whole = whole.unionByName(other)
    best = F.min(F.struct((-F.col("length")).alias("less"), "key", "word"))
    return (
        whole.groupBy("item", "item_word").agg(best.alias("best"), F.sum("places").alias("places"))
        .select("item", "item_word", (-F.col("best.less")).alias("length"), "places", "best.key", "best.word")
    )
