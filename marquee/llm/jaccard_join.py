"""N-gram Jaccard join with PartEnum signatures.

A document is the set of its distinct word shingles; two documents link when
100 * |intersection| >= percent * |union|. Documents with equal sets are one class,
and only classes are joined.

Sizes are cut into bands so that a set can only link within its band or the next
one, and a set is signed for both. Within a band the symmetric difference of
linked sets has ``k`` elements at most. The feature domain is cut into ``n1`` parts by
hash, and each part into ``n2`` cells. As there are more parts than k / (k2 + 1), some part
differs in at most ``k2`` elements, so some choice of ``n2 - k2`` of its cells is equal on
both sides: each such choice is a signature, a commutative hash of its elements. A
choice without elements would sign unrelated sets alike; it is left out unless
so many parts of a set are affected that the argument above would need it.

Signatures are made and grouped in ``SIGNATURE_SLICES`` slices of their values, one after the other, as they are the largest shuffle;
of signatures with the same members one is kept. Tables that are not read again are removed.

Classes that share a signature are not paired with each other. First each is
compared with the smallest class of the signature; links make components. Then members outside its
component are compared with the class that has most links so far, most often the original
of the copies. Only members of a signature that still lie in different components are compared
further, pack by pack inside the tasks, and only pairs that pass an exact bound on the difference by parity
sketches of 256 bits (1024 for thresholds below 90 %) leave them. So a large group of near copies costs its size, and no link between components is lost.

Defined cases: NULL, empty and wordless texts have no set and link with nothing;
a text of fewer words than a shingle has its whole word sequence as its one element;
equal texts share a class; ids may repeat or be NULL (rows are found by a hash of id
and text; the component id is the smallest id that is not NULL); an empty table
gives an empty result; other columns pass through :func:`one_per_group` unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from marquee.llm.components import components
from marquee.llm.shared import dropped, small_batches, written
from marquee.llm.textblocks import (
    LOWER, SPACES, binary16, distinct_per_text, mixed, row_blocks, shingle_hashes, text_bytes, word_hashes, word_spans,
)

_ROW = ("__row1", "__row2")
#: Longs of the parity sketch, and of one for thresholds below ``LOOSE`` per cent: the more linked sets may differ, the
#: more bits it takes until the parities of sets that differ more are told apart.
SKETCH, LOOSE_SKETCH, LOOSE = 4, 16, 90
#: Text bytes whose shingles and signatures lie in a task's memory together.
BLOCK = 1 << 20
#: Slices of the texts, and of their signatures, of which one is shuffled at a time. Each slice of signatures makes all
#: of them anew, which costs time.
SLICES, SIGNATURE_SLICES = 4, 2
#: Rounds in which the members of a signature are compared with the one that has most links, before all that is left is.
HUB_ROUNDS = 3
#: Members of a signature that are compared with each other at a time.
PACK = 256


def bands(percent: int, largest: int) -> np.ndarray:
    """The largest size of each band, from size 1 on."""
    out, low = [], 1
    while low <= largest:
        out.append(low * 100 // percent)
        low = out[-1] + 1
    return np.array([*out, low * 100 // percent], np.int64)


def layout(low: int, high: int, percent: int) -> tuple[int, int, int, int]:
    """Parts, cells a part, cells of a signature, and spare parts for linked sets of at most ``low`` and ``high`` elements.

    Sets of one band meet in the next band's signatures as well, so a band's own have to find
    only pairs with a set of the band before, whose sizes end at ``low``.
    """
    k = (low + high) * (100 - percent) // (100 + percent)
    if k == 0:
        return 1, 1, 1, 0
    if k <= 12:
        return 1, k + 2, 2, 0
    parts, spare = k + 1, 2 + k // 16
    return parts + spare, 1, 1, spare


def signatures(hashes: np.ndarray, text: np.ndarray, n_texts: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of all sets: (signature, text)."""
    sizes = np.bincount(text, minlength=n_texts)
    tops = bands(percent, int(sizes.max(initial=1)))
    band = np.searchsorted(tops, sizes)
    spec = np.array([layout(int(low), int(high), percent) for low, high in zip(np.append(0, tops), tops)], np.int64)
    out_sig, out_text = [], []
    full = np.flatnonzero(sizes)
    for tag in (band[full], band[full] + 1):
        parts, cells, chosen, spare = spec[tag].T
        width = parts * cells
        base = np.cumsum(width) - width
        place = np.zeros(n_texts, np.int64)
        place[full] = base
        mod = np.ones(n_texts, np.int64)
        mod[full] = width
        total = int(width.sum())
        cell = place[text] + (hashes % mod[text].astype(np.uint64)).astype(np.int64)
        sums = np.zeros(total, np.uint64)
        np.add.at(sums, cell, mixed(hashes ^ np.uint64(0xA5A5A5A5)))
        counts = np.bincount(cell, minlength=total)
        salt = mixed(tag.astype(np.uint64) + np.uint64(1 << 40))
        for n in np.unique(chosen):
            for n2 in np.unique(cells[chosen == n]):
                some = np.flatnonzero((chosen == n) & (cells == n2))
                doc = np.repeat(some, parts[some])
                part = np.arange(len(doc)) - np.repeat(np.cumsum(parts[some]) - parts[some], parts[some])
                first = base[doc] + part * n2
                if n == 1:
                    choices = [(c,) for c in range(n2)]
                else:
                    choices = [(a, b) for a in range(n2) for b in range(a + 1, n2)]
                count = np.stack([sum(counts[first + c] for c in choice) for choice in choices], axis=1)
                risky = np.bincount(doc, weights=(count == 0).any(axis=1), minlength=len(full))
                poor = risky > spare
                for i, choice in enumerate(choices):
                    keep = (count[:, i] > 0) | poor[doc]
                    value = sums[first[keep] + choice[0]].copy()
                    for c in choice[1:]:
                        value += sums[first[keep] + c]
                    where = (part[keep] * len(choices) + i).astype(np.uint64)
                    out_sig.append(mixed(value + mixed(salt[doc[keep]] + where)))
                    out_text.append(full[doc[keep]])
    if not out_sig:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_sig), np.concatenate(out_text)


def sets_of(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ordered by text."""
    data, offsets = text_bytes(column)
    starts, ends, first = word_spans(data, offsets, SPACES)
    hashes = word_hashes(LOWER[data], starts, ends)
    return distinct_per_text(*shingle_hashes(hashes, first, words))


def sketch_size(percent: int) -> int:
    return SKETCH if percent >= LOOSE else LOOSE_SKETCH


def _sketches(hashes: np.ndarray, text: np.ndarray, n_texts: int, longs: int) -> np.ndarray:
    """Parity of the elements per hashed bit, as longs."""
    bits = 64 * longs
    odd = np.bincount(text * bits + (mixed(hashes) % np.uint64(bits)).astype(np.int64), minlength=n_texts * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n_texts, bits), axis=1).view(np.int64)


def _set_digests(words: int, longs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in row_blocks(batches, "text", BLOCK):
            n = block.num_rows
            hashes, text = sets_of(block.column("text"), words)
            sizes = np.bincount(text, minlength=n).astype(np.int64)
            one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            np.add.at(one, text, mixed(hashes))
            np.add.at(two, text, mixed(hashes * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)))
            sketch = _sketches(hashes, text, n, longs)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * longs), pa.array(sketch.ravel()))
            key = binary16(mixed(one + sizes.astype(np.uint64)), mixed(two))
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), *(block.column(c) for c in _ROW), pa.array(sizes), key, lists], names=["id", *_ROW, "n", "set_key", "sketch"]
            )

    return run


def _signed(words: int, percent: int, number: int):
    """Signatures of one slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in row_blocks(batches, "text", BLOCK):
            hashes, text = sets_of(block.column("text"), words)
            sig, owner = signatures(hashes, text, block.num_rows, percent)
            mine = sig % np.uint64(SIGNATURE_SLICES) == number
            sig, owner = sig[mine], owner[mine]
            ids = block.column("class").to_numpy(zero_copy_only=False)
            for start in range(0, len(sig), 200_000):
                part = slice(start, start + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(sig[part].view(np.int64)), pa.array(ids[owner[part]])], names=["sig", "class"])

    return run


def _set_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in row_blocks(batches, "text", BLOCK):
            hashes, text = sets_of(block.column("text"), words)
            offsets = np.searchsorted(text, np.arange(block.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([block.column("class"), lists], names=["class", "elements"])

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose whole sets meet the threshold."""
    side = lambda c: sets.select(F.col("class").alias(c), F.col("elements").alias(f"{c}_set"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    common = F.size(F.array_intersect("u_set", "v_set"))
    union = F.size("u_set") + F.size("v_set") - common
    return both.filter(100 * common >= percent * union).select("u", "v").distinct()


def _slice(number: int) -> Column:
    return F.pmod(F.col(_ROW[0]), F.lit(SLICES)) == number


def _in_slices(of: Callable[[int], DataFrame], slices: int) -> DataFrame:
    """All slices, each written before the next one is shuffled."""
    return reduce(DataFrame.unionByName, [written(of(i)) for i in range(slices)])


def _grouped(signed: DataFrame) -> DataFrame:
    """The classes ``v`` of signatures that more than one has, with the smallest, ``u``, and two hashes of all members."""
    by = _by("sig")
    hashes = (F.bit_xor(F.xxhash64(F.lit(i), "class")).over(by).alias(f"members{i}") for i in (1, 2))
    group = F.min("class").over(by).alias("u"), F.max("class").over(by).alias("top"), F.count("*").over(by).alias("members"), *hashes
    return signed.select("sig", F.col("class").alias("v"), *group).filter("u < top").drop("top")


def _one_per_members(groups: DataFrame) -> DataFrame:
    """(sig, u, v) of one signature for each set of members: near copies share most of their signatures."""
    first = groups.groupBy("members", "members1", "members2").agg(F.min("sig").alias("sig"))
    return groups.join(first.select("sig"), "sig", "left_semi").select("sig", "u", "v")


def _near(percent: int, a: str, b: str) -> Column:
    """Whether size and parity sketches of two sets allow a link: never false for linked sets."""
    total = F.col(f"{a}n") + F.col(f"{b}n")
    apart = sum((F.bit_count(F.col(f"{a}sketch")[i].bitwiseXOR(F.col(f"{b}sketch")[i])) for i in range(sketch_size(percent))), F.lit(0))
    sizes = 100 * F.least(f"{a}n", f"{b}n") >= percent * F.greatest(f"{a}n", f"{b}n")
    return sizes & ((100 + percent) * apart <= (100 - percent) * total)


def _open_groups(shared: DataFrame, parts: DataFrame) -> DataFrame:
    """(sig, node, component) of the signatures whose members lie in different components."""
    member = shared.select("sig", F.col("v").alias("node")).distinct().join(parts, "node", "left")
    member = member.withColumn("component", F.coalesce("component", "node"))
    ends = member.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    return member.join(ends.select("sig"), "sig").select("sig", "node", "component")


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of one signature and different components whose sizes and sketches allow a link, each once.

    The members of a signature come in packs of about ``PACK``, dealt by hash; a pack is compared with itself and with the
    others of its signature, a pair of packs a row, and only pairs that pass the bound leave the task.
    """
    sizes = members.groupBy("sig").agg(F.ceil(F.count("*") / PACK).alias("packs"))
    dealt = members.join(sizes, "sig").withColumn("pack", F.pmod(F.xxhash64("node"), F.col("packs")))
    fields = F.sort_array(F.collect_list(F.struct("node", "component", F.col("node_n").alias("n"), F.col("node_sketch").alias("sketch"))))
    packs = written(dealt.groupBy("sig", "packs", "pack").agg(fields.alias("a")))
    many = packs.filter("packs > 1")
    others = many.select("sig", F.col("pack").alias("other"), F.col("a").alias("b"))
    pairs = many.join(others, "sig").filter("pack < other").select("a", "b")
    # Few rows a batch, as a row holds two packs.
    with small_batches(members.sparkSession, 256):
        found = written(packs.select("a", F.col("a").alias("b")).unionByName(pairs).mapInArrow(_close_pairs(percent), "u bigint, v bigint"))
    dropped(packs)
    return found.distinct()


def _close_pairs(percent: int):
    def table(rows: pa.StructScalar) -> tuple[np.ndarray, ...]:
        struct = rows.values
        sketch = struct.field("sketch").flatten().to_numpy(zero_copy_only=False).reshape(-1, sketch_size(percent))
        return *(struct.field(c).to_numpy(zero_copy_only=False) for c in ("node", "component", "n")), sketch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for x, y in zip(batch.column("a"), batch.column("b")):
                (a, a_part, a_n, a_bits), (b, b_part, b_n, b_bits) = table(x), table(y)
                sizes = 100 * np.minimum(a_n[:, None], b_n) >= percent * np.maximum(a_n[:, None], b_n)
                row, col = np.nonzero(sizes & (a_part[:, None] != b_part))
                # unsigned: of a negative number NumPy would count the bits of its absolute value
                apart = np.bitwise_count((a_bits[row] ^ b_bits[col]).view(np.uint64)).sum(axis=1, dtype=np.int64)
                close = (100 + percent) * apart <= (100 - percent) * (a_n[row] + b_n[col])
                us.append(np.minimum(a[row[close]], b[col[close]]))
                vs.append(np.maximum(a[row[close]], b[col[close]]))
            pairs = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])

    return run


def set_components(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Per row: ``id``, the row's hash, ``n`` (size of its set) and ``component_id`` (smallest id reachable by links)."""
    return _judged(documents, key, text, words, percent).drop("best")


def _judged(documents: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """:func:`set_components` with ``best``: the first row of the component by id, NULL last, and hash."""
    rows = documents.select(
        F.col(key).alias("id"), F.xxhash64(F.lit(1), key, text).alias(_ROW[0]), F.xxhash64(F.lit(2), text, key).alias(_ROW[1]), F.col(text).alias("text")
    )
    kind = rows.schema["id"].dataType.simpleString()
    row_types = f"{_ROW[0]} bigint, {_ROW[1]} bigint"
    with small_batches(documents.sparkSession):
        digests = written(rows.mapInArrow(_set_digests(words, sketch_size(percent)), f"id {kind}, {row_types}, n bigint, set_key binary, sketch array<bigint>"))
    classes = written(
        digests.filter("n > 0").groupBy("set_key")
        .agg(F.min("id").alias("least_id"), F.min(_rank()).alias("best"), F.min(F.struct(*_ROW)).alias("row"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        .select(F.monotonically_increasing_id().alias("class"), "set_key", "least_id", "best", "row.*", "n", "sketch")
    )
    first, all_texts = classes.select("class", *_ROW), rows.select(*_ROW, "text")
    texts = _in_slices(lambda i: all_texts.filter(_slice(i)).join(first.filter(_slice(i)), list(_ROW)).select("class", "text"), SLICES)
    with small_batches(documents.sparkSession):
        every = _in_slices(lambda i: _grouped(texts.mapInArrow(_signed(words, percent, i), "sig bigint, class bigint")), SIGNATURE_SLICES)
    shared = written(_one_per_members(every))
    dropped(every)

    wanted = shared.select(F.col("v").alias("class")).distinct()
    with small_batches(documents.sparkSession):
        sets = written(texts.join(wanted, "class", "left_semi").mapInArrow(_set_rows(words), "class bigint, elements array<bigint>"))
    dropped(texts)
    meta = classes.join(wanted, "class", "left_semi").select("class", "n", "sketch")

    def about(c: str) -> DataFrame:
        return meta.select(F.col("class").alias(c), F.col("n").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_sketch"))

    stars = shared.filter("u != v").select("u", "v").distinct()
    near = stars.join(about("u"), "u").join(about("v"), "v").filter(_near(percent, "u_", "v_")).select("u", "v")
    links = written(_linked(near, sets, percent))
    parts = written(components(links))

    done = near
    for _ in range(HUB_ROUNDS):
        degree = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        open_ = _open_groups(shared, parts).join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        hubs = open_.groupBy("sig").agg(F.max(F.struct("degree", (-F.col("node")).alias("node"), "component")).alias("hub"))
        hubs = hubs.select("sig", (-F.col("hub.node")).alias("hub"), F.col("hub.component").alias("hub_component"))
        met = open_.join(hubs, "sig").filter("component != hub_component")
        pairs = met.select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()
        pairs = pairs.join(done, ["u", "v"], "left_anti").join(about("u"), "u").join(about("v"), "v")
        pairs = written(pairs.filter(_near(percent, "u_", "v_")).select("u", "v"))
        new = written(_linked(pairs, sets, percent))
        if new.isEmpty():
            break
        done, links = done.unionByName(pairs), links.unionByName(new)
        parts = written(components(parts.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(new)))

    across = _across(_open_groups(shared, parts).join(about("node"), "node"), percent)
    more = written(_linked(across.join(done, ["u", "v"], "left_anti"), sets, percent))
    if not more.isEmpty():
        stars_done = parts.select(F.col("node").alias("u"), F.col("component").alias("v"))
        parts = written(components(stars_done.unionByName(more)))
    dropped(sets, shared)

    named = classes.select("class", "set_key", "least_id", "best").join(parts.withColumnRenamed("node", "class"), "class", "left")
    named = named.withColumn("component", F.coalesce("component", "class"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"), F.min("best").alias("best"))
    named = named.drop("best").join(least, "component").select("set_key", "component_id", "best")
    found = digests.join(named, "set_key", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return found.select("id", *_ROW, "n", own.alias("component_id"), "best")


def _rank() -> Column:
    return F.struct(F.col("id").isNull().alias("no_id"), "id", *_ROW)


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(*columns)


def one_per_group(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, equal_rows: bool = True) -> DataFrame:
    """``documents`` less near duplicates: of each component the document with the smallest id (NULL last, then by
    hash of the text) stays, and all rows without a set.

    Rows with equal id and text are one document and stay together; without ``equal_rows`` one of them
    stays, so each component keeps exactly one row."""
    found = _judged(documents, key, text, words, percent).filter("n > 0").select(*_ROW, _rank().eqNullSafe(F.col("best")).alias("stays"))
    tally = written(found.groupBy(*_ROW, "stays").count().filter("NOT stays OR count > 1"))
    marked = documents.withColumns({_ROW[0]: F.xxhash64(F.lit(1), key, text), _ROW[1]: F.xxhash64(F.lit(2), text, key)})
    kept = marked.join(tally.filter("NOT stays").select(*_ROW), list(_ROW), "left_anti")
    repeated = tally.filter("stays").select(*_ROW)
    if equal_rows or repeated.isEmpty():
        return kept.drop(*_ROW)
    # the rows of one document differ in other columns at most
    order = F.xxhash64(*(F.col(c) for c in documents.columns))
    first = marked.join(repeated, list(_ROW), "left_semi").withColumn("__nth", F.row_number().over(_by(*_ROW).orderBy(order)))
    return kept.join(repeated, list(_ROW), "left_anti").unionByName(first.filter("__nth = 1").drop("__nth")).drop(*_ROW)
