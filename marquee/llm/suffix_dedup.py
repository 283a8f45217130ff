"""Removal of repeated byte strings by a hash-compared suffix sort.

Every byte that a string of ``length`` bytes covers which also starts anywhere else
goes, the same text included; texts are judged as they came.

Only suffixes that can match are sorted, and only where they can meet. Each
``length``-byte string holds an anchor: of its grams of a third of that length the leftmost with
the smallest hash. Equal strings hold equal anchors at the same distance, so strings are
sorted per anchor and distance. All strings with one anchor in one place overlap:
they are a context of the anchor, its neighbourhood. Contexts that occur twice are
repeated as a whole and are not sorted; what is left are the few contexts at
the edges of repeated passages.

The sort is a merge sort that moves all segments of a block together. Two suffixes are
compared through prefix polynomial hashes: a binary search over lengths finds their
common extension in log(length) steps, and the byte behind it decides. Neighbours whose
common extension reaches ``length`` are compared byte by byte before they count.

Equal texts are one class: only one of them is searched, and copies of a text of
``length`` bytes or more are repeated as a whole. An anchor with more than ``CROWD`` different
contexts (a phrase shorter than ``length`` in very many texts) is not sorted in one task:
its strings meet by 128-bit hash of their bytes, spread over all tasks.

Defined cases: NULL and empty texts have no bytes and stay; texts shorter than
``length`` stay whole; repeated rows are copies of each other, so they go if they are long
enough; ids may be NULL or repeat; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from marquee.llm.shared import bucketed, partitions, small_batches, written
from marquee.llm.textblocks import PrefixHashes, mixed, row_blocks, text_bytes

#: Text bytes searched together: a byte takes about a hundred bytes of arrays.
BLOCK = 1 << 19
#: Different contexts of one anchor that a task sorts.
CROWD = 2000
#: Context bytes sorted together.
SORT_BYTES = 2 << 20

_LOW = np.uint64(0xFFFFFFFF)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of all strings of ``length`` bytes inside the texts.

    Returns text, anchor place, first and last start of the strings that have this
    anchor, the anchor's hash, and the hash of its context. Places count in ``data``.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    if len(data) < length:
        return none
    gram = max(1, length * 8 // 25)
    width = length - gram + 1
    hashes = PrefixHashes(data, 1)
    at = np.arange(len(data) - gram + 1)
    grams = mixed(hashes.spans(at, at + gram))
    ranked = (grams & ~_LOW) | at.astype(np.uint64)
    # smallest of each window: blocks of one window's width, from either side
    padded = np.full(-(-len(ranked) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(ranked)] = ranked
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - length + 1
    least = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & _LOW).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = owner[:n] == owner[length - 1 :]
    start = np.flatnonzero(inside)
    if not len(start):
        return none
    anchor, text = least[start], owner[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    low, high, place = start[first], start[last], anchor[first]
    shape = ((place - low) << 32 | (high - low)).astype(np.uint64)
    context = mixed(PrefixHashes(data, 2).spans(low, high + length) ^ mixed(shape))
    return text[first], place, low, high, grams[place], context


class Suffixes:
    """Suffixes of a byte block, compared through prefix hashes."""

    def __init__(self, data: np.ndarray, limit: int) -> None:
        self.data = np.append(data, np.zeros(limit + 1, np.uint8))
        self.hashes = PrefixHashes(self.data, 3)
        self.limit = limit

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes, up to the limit."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.limit, np.int64)
        while True:
            middle = (low + high + 1) >> 1
            if not (low < high).any():
                return low
            same = self.hashes.spans(a, a + middle) == self.hashes.spans(b, b + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)

    def less(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether suffix a is smaller, and whether the two are equal up to the limit."""
        common = self.common(a, b)
        equal = common >= self.limit
        return ~equal & (self.data[a + common] < self.data[b + common]), equal

    def sorted_segments(self, suffix: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Order of the suffixes inside each segment (segments are contiguous): a merge sort of all together."""
        n = len(suffix)
        first = np.flatnonzero(np.append(True, segment[1:] != segment[:-1])) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(first, n))
        base, size = np.repeat(first, size), np.repeat(size, size)
        order, run = np.arange(n), 1
        place = np.arange(n) - base
        while n and run < size.max():
            mine = place // run
            other = (mine ^ 1) * run
            begin, end = np.minimum(other, size), np.minimum(other + run, size)
            left = (mine & 1) == 0
            low, high = base + begin, base + end
            value = suffix[order]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) >> 1
                smaller, equal = self.less(value[middle], value[open_])
                # a left element goes before equal right ones, a right one behind equal left ones
                ahead = smaller | (equal & ~left[open_])
                low[open_] = np.where(ahead, middle + 1, low[open_])
                high[open_] = np.where(ahead, high[open_], middle)
            target = base + np.minimum(mine, mine ^ 1) * run + (place - mine * run) + (low - base - begin)
            moved = np.empty_like(order)
            moved[target] = order
            order = moved
            run *= 2
        return order

    def verified(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes up to the limit are equal, byte by byte."""
        out = np.ones(len(a), bool)
        for k in range(0, self.limit, 8):
            at = np.arange(k, min(k + 8, self.limit))
            out &= (self.data[a[:, None] + at] == self.data[b[:, None] + at]).all(axis=1)
        return out


def repeated_strings(data: np.ndarray, begin: np.ndarray, before: np.ndarray, run: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings of contexts that occur in another context of the same group: (context, number of the string)."""
    count = run + 1
    context = np.repeat(np.arange(len(run)), count)
    number = np.arange(len(context)) - np.repeat(np.cumsum(count) - count, count)
    distance = before[context] - number
    order = np.lexsort((distance, group[context]))
    context, number, distance = context[order], number[order], distance[order]
    segment = group[context] * np.int64(length + 1) + distance
    alone = np.append(True, segment[1:] != segment[:-1]) & np.append(segment[1:] != segment[:-1], True)
    context, number, segment = context[~alone], number[~alone], segment[~alone]
    start = begin[context] + number
    suffixes = Suffixes(data, length)
    order = suffixes.sorted_segments(start, segment)
    context, number, segment, start = context[order], number[order], segment[order], start[order]
    near = np.flatnonzero(segment[1:] == segment[:-1])
    near = near[suffixes.common(start[near], start[near + 1]) >= length]
    near = near[suffixes.verified(start[near], start[near + 1])]
    twice = np.zeros(len(context), bool)
    twice[near] = twice[near + 1] = True
    return context[twice], number[twice]


def _ranges(context: np.ndarray, number: np.ndarray, n: int) -> pa.ListArray:
    """Runs of string numbers per context as lists of (a, b), both included."""
    order = np.lexsort((number, context))
    context, number = context[order], number[order]
    new = np.ones(len(context), bool)
    new[1:] = (context[1:] != context[:-1]) | (number[1:] != number[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(context)) - 1 if len(first) else first
    values = pa.StructArray.from_arrays([pa.array(number[first].astype(np.int32)), pa.array(number[last].astype(np.int32))], names=["a", "b"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(context[first], np.arange(n + 1)).astype(np.int32)), values)


def _int32(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def _find_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in row_blocks(batches, "text", BLOCK):
            data, offsets = text_bytes(block.column("text"))
            text, place, low, high, gram, context = anchors(data, offsets, length)
            ids = block.column("class").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), pa.array(ids[text]), _int32(low - offsets[text]), _int32((place - low) << 16 | (high - low))],
                names=["anchor", "context", "class", "low", "shape"],
            )

    return run


def _cut_contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in row_blocks(batches, "text", BLOCK):
            data, offsets = text_bytes(block.column("text"))
            lists = block.column("marks")
            marks = lists.flatten()
            row = np.repeat(np.arange(block.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            low, shape = (marks.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("low", "shape"))
            begin = offsets[row] + low
            size = (shape & 0xFFFF) + length
            at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            content = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[at]))])
            yield pa.RecordBatch.from_arrays(
                [marks.field("anchor"), marks.field("context"), marks.field("n"), marks.field("shape"), content], names=["anchor", "context", "n", "shape", "content"]
            )

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of about ``size`` content bytes that end where an anchor ends; rows come ordered by anchor."""
    held: list[pa.RecordBatch] = []
    last = None
    for block in row_blocks(batches, "content", size):
        key = block.column("anchor").to_numpy(zero_copy_only=False)
        if held and key[0] != last:
            yield pa.Table.from_batches(held)
            held = []
        changes = np.flatnonzero(key[1:] != key[:-1])
        cut = int(changes[-1]) + 1 if len(changes) else 0
        if cut:
            yield pa.Table.from_batches([*held, block.slice(0, cut)])
            held = []
        held.append(block.slice(cut))
        last = key[-1]
    if held:
        yield pa.Table.from_batches(held)


def _sort_contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, SORT_BYTES):
            data, offsets = text_bytes(_flat(table, "content"))
            shape = table.column("shape").to_numpy().astype(np.int64)
            _, group = np.unique(table.column("anchor").to_numpy(), return_inverse=True)
            context, number = repeated_strings(data, offsets[:-1], shape >> 16, shape & 0xFFFF, group, length)
            single = table.column("n").to_numpy() == 1
            keep = single[context]
            ranges = _ranges(context[keep], number[keep], table.num_rows)
            some = pa.array(pc.list_value_length(ranges).to_numpy(zero_copy_only=False) > 0)
            found = pa.RecordBatch.from_arrays([_flat(table, "anchor"), _flat(table, "context"), ranges], names=["anchor", "context", "ranges"])
            yield found.filter(some)

    return run


def _flat(table: pa.Table, column: str) -> pa.Array:
    return pa.concat_arrays(table.column(column).chunks)


def _crowd_strings(length: int):
    """All strings of contexts with their 128-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in row_blocks(batches, "content", SORT_BYTES // 8):
            data, offsets = text_bytes(block.column("content"))
            shape = block.column("shape").to_numpy(zero_copy_only=False).astype(np.int64)
            count = (shape & 0xFFFF) + 1
            row = np.repeat(np.arange(block.num_rows), count)
            number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = offsets[row] + number
            one, two = (mixed(PrefixHashes(data, seed).spans(start, start + length)) for seed in (4, 5))
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *(block.column(c).take(rows) for c in ("anchor", "context", "n")), _int32(number)],
                names=["one", "two", "anchor", "context", "n", "number"],
            )

    return run


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in row_blocks(batches, "text", BLOCK):
            data, offsets = text_bytes(block.column("text"))
            lists = block.column("spans").fill_null([])
            marks = lists.flatten()
            row = np.repeat(np.arange(block.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            begin, end = (offsets[row] + marks.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
            change = np.zeros(len(data) + 1, np.int32)
            np.add.at(change, begin, 1)
            np.add.at(change, end, -1)
            gone = np.cumsum(change)[:-1] > 0
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            full = offsets[:-1] < offsets[1:]
            edge[offsets[:-1][full]] = gone[offsets[:-1][full]]
            total = np.concatenate([[0], np.cumsum(gone)])
            runs = np.concatenate([[0], np.cumsum(edge)])
            kept, left = data[~gone].tobytes(), offsets - total[offsets]
            pieces = [kept[a:b] for a, b in zip(left, left[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("class"), pa.array(np.diff(total[offsets])), pa.array(np.diff(runs[offsets])),
                    pa.array([sha256(p).hexdigest() for p in pieces], pa.string()), pa.array(pieces, pa.binary()),
                ],
                names=["class", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def without_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, content: bool = False, crowd: int = CROWD) -> DataFrame:
    """Per row: ``id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, and with ``content`` the ``kept`` bytes."""
    spark = documents.sparkSession
    rows = documents.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    digest = [F.xxhash64(F.lit(1), "text").alias("h1"), F.xxhash64(F.lit(2), "text").alias("h2")]
    places = written(rows.select("id", *digest, F.octet_length("text").cast("bigint").alias("n_bytes"), F.xxhash64("id", "text").alias("row")))
    classes = written(
        places.groupBy("h1", "h2").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
        .select(F.monotonically_increasing_id().alias("class"), "h1", "h2", "row", "copies")
    )
    source = rows.select(*digest, F.xxhash64("id", "text").alias("row"), "text").join(classes.select("class", "h1", "h2", "row"), ["h1", "h2", "row"])
    with bucketed(source.select("class", "text"), "class") as texts, small_batches(spark):
        found = texts.mapInArrow(_find_anchors(length), "anchor bigint, context bigint, class bigint, low int, shape int")
        shared = written(found.withColumn("n", F.count("*").over(Window.partitionBy("anchor"))).filter("n > 1").drop("n"))
        contexts = shared.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("class", "low", "shape")).alias("at"))
        contexts = written(contexts.select("anchor", "context", "n", "at.*"))
        groups = contexts.groupBy("anchor").agg(F.count("*").alias("different"), F.min("n").alias("least")).filter("different > 1 AND least = 1")
        open_ = contexts.join(groups, "anchor")
        marks = open_.groupBy("class").agg(F.collect_list(F.struct("anchor", "context", "n", "low", "shape", "different")).alias("marks"))

        def cut(condition) -> DataFrame:
            some = marks.withColumn("marks", F.filter("marks", condition)).filter(F.size("marks") > 0)
            return texts.join(some, "class").select("text", "marks").mapInArrow(_cut_contexts(length), "anchor bigint, context bigint, n bigint, shape int, content binary")

        few = cut(lambda m: m["different"] <= crowd).repartition(partitions(spark), "anchor").sortWithinPartitions("anchor")
        few = few.mapInArrow(_sort_contexts(length), "anchor bigint, context bigint, ranges array<struct<a:int,b:int>>")
        strings = cut(lambda m: m["different"] > crowd).mapInArrow(_crowd_strings(length), "one bigint, two bigint, anchor bigint, context bigint, n bigint, number int")
        strings = written(strings)
        twice = strings.groupBy("one", "two").agg(F.count("*").alias("many")).filter("many > 1").drop("many")
        many = strings.filter("n = 1").join(twice, ["one", "two"], "left_semi").groupBy("anchor", "context").agg(
            F.collect_list(F.struct(F.col("number").alias("a"), F.col("number").alias("b"))).alias("ranges")
        )
        partly = few.unionByName(many)
        whole = contexts.filter("n > 1").select("anchor", "context", F.array(F.struct(F.lit(0).alias("a"), F.col("shape").bitwiseAND(0xFFFF).alias("b"))).alias("ranges"))
        spans = shared.join(whole.unionByName(partly), ["anchor", "context"]).select(
            "class", F.explode(F.transform("ranges", lambda r: F.struct((F.col("low") + r["a"]).alias("start"), (F.col("low") + r["b"] + length).alias("end")))).alias("span")
        )
        spans = spans.groupBy("class").agg(F.collect_list("span").alias("spans"))
        result = texts.join(spans, "class", "left").mapInArrow(_removed(length), "class bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
        result = (result if content else result.drop("kept")).dropDuplicates(["class"])
        judged = written(classes.join(result, "class"))
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    out = places.join(judged.select("h1", "h2", "copies", "n_removed", "n_spans", "kept_sha256", *(["kept"] if content else [])), ["h1", "h2"])
    none = sha256(b"").hexdigest()
    return out.select(
        "id", "n_bytes", F.when(copied, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copied, F.lit(1).cast("bigint")).otherwise(F.col("n_spans")).alias("n_spans"), F.when(copied, none).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        *([F.when(copied, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if content else []),
    )
