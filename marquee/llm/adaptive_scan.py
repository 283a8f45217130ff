"""Approximate nearest neighbours: inverted lists scanned by adaptive dimension sampling.

Index. Centroids are fitted on a bounded sample; every vector goes to the list of its nearest
one. A list is cut into blocks of at most ``BLOCK`` vectors. A block holds its vectors turned by one
random rotation, laid out by column blocks, and the originals beside them.

Search. A query probes the lists of its nearest centroids. Queries of one list travel in packs and
meet its blocks in an equality join, so neither a list nor its queries need one task, and a list that holds a
third of all vectors is just many blocks. Within a block, squared distances grow column
block by column block. After d of D turned dimensions they are a fair sample of the whole: a candidate goes as
soon as its partial distance, scaled by D / d, lies above the query's bound by more than
``1 + EPSILON / sqrt(d)``, a test that is wrong about a true neighbour with a probability falling as exp(-c EPSILON²). The
bound is the query's k-th distance within a small part of the fit sample, so it never cuts a true neighbour off
itself. What reaches the last column is measured on the original vectors in double precision. A query that has
found fewer than k is searched again in all lists, without a bound.

How many lists are probed is measured, not guessed: a fixed number of sample vectors is searched by
brute force over all rows, and the probes are those that reach ``RECALL`` of their true neighbours. :func:`recall`
reports what a search has found.

Parameters: ``FIT`` vectors at most reach the driver for the centroids and bounds; there are sqrt(rows) lists,
``FIT / 4`` at most. Every row is indexed, and lists have no size limit.

Defined cases: vectors that are NULL, empty, zero or hold NULL or non-finite components take no part, and neither
do rows without an id; vectors are compared with those of their own length only, and lengths that the
sample doesn't hold share one list each; of rows with the same id, a query is the least vector and a candidate counts
with its nearest one; equal distances go by id; fewer candidates than ``k`` are all returned; empty tables give an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marquee.llm.shared import PARTS, partitions, small_batches, written
from marquee.operators.dedupe import top_per_key

#: Vectors in the fit sample, at most.
FIT = 16_384
#: Vectors of the fit sample that bounds are taken from: ``BOUND`` at most, and one in ``SPARSE`` of all.
BOUND, SPARSE = 2048, 8
#: Vectors of a block, queries of a pack, and dimensions of a column block.
BLOCK, PACK, COLUMNS = 1024, 256, 16
#: Sample vectors that are searched by brute force, and the share of their neighbours that the probed lists must hold.
TRIALS, RECALL = 100, 0.99
#: Significance of the test on partial distances.
EPSILON = 2.1
#: Relative error that 32-bit columns may add to a squared distance.
SLACK = 1e-5


def usable(rows: DataFrame, id: Column, vector: Column) -> DataFrame:
    """``id`` and ``vector`` (as 32-bit floats where the input has them) of the rows that take part."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    source = rows.select(id.cast("bigint").alias("id"), vector.alias("vector"))
    return source.filter(F.col("id").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances between two tables of rows."""
    out = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    return np.maximum(out, 0)


def fitted(points: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Centroids by Lloyd's iteration; a list that falls empty starts again at the point farthest from its own."""
    rng = np.random.default_rng(7)
    centres = points[rng.choice(len(points), lists, replace=False)].copy()
    for _ in range(rounds):
        far, own = np.empty(len(points)), np.empty(len(points), np.int64)
        for s in range(0, len(points), 4096):
            d = squared(points[s : s + 4096], centres)
            own[s : s + 4096] = d.argmin(1)
            far[s : s + 4096] = d.min(1)
        counts = np.bincount(own, minlength=lists)
        order = np.argsort(own, kind="stable")
        some = counts > 0
        sums = np.add.reduceat(points[order], (np.cumsum(counts) - counts)[some])
        centres[some] = sums / counts[some][:, None]
        centres[~some] = points[np.argsort(-far, kind="stable")[: (~some).sum()]]
    return centres


@dataclass
class Cells:
    """Centroids, sample and rotation per vector length."""

    centres: dict[int, np.ndarray]
    #: ids and vectors that bounds are taken from
    near: dict[int, tuple[np.ndarray, np.ndarray]]
    rotations: dict[int, np.ndarray]

    @staticmethod
    def fit(sample: dict[int, tuple[np.ndarray, np.ndarray]], rows: dict[int, int]) -> Cells:
        """``sample``: ids and vectors per length; ``rows``: rows per length."""
        once = {}
        for d, (ids, table) in sample.items():
            first = np.sort(np.unique(ids, return_index=True)[1])
            once[d] = ids[first], table[first]
        lists = {d: max(1, min(math.ceil(math.sqrt(rows[d])), FIT // 4, len(ids))) for d, (ids, _) in once.items()}
        centres = {d: fitted(table, lists[d]) for d, (_, table) in once.items()}
        rotations = {d: np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0] for d in rows}
        some = {d: slice(0, min(BOUND, rows[d] // SPARSE)) for d in once}
        return Cells(centres, {d: (ids[some[d]], table[some[d]]) for d, (ids, table) in once.items()}, rotations)

    def order(self, vectors: np.ndarray, probes: int | None = None) -> np.ndarray:
        """The lists of each vector, nearest first."""
        centres = self.centres.get(vectors.shape[1])
        if centres is None:
            return np.zeros((len(vectors), 1), np.int64)
        d = squared(vectors, centres)
        return d.argmin(1)[:, None] if probes == 1 else np.argsort(d, axis=1, kind="stable")[:, :probes]

    def bounds(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
        """Squared distance of each vector's k-th neighbour in a part of the sample, itself left out; infinite where that has fewer."""
        out = np.full(len(vectors), np.inf)
        if vectors.shape[1] not in self.near:
            return out
        known, table = self.near[vectors.shape[1]]
        for s in range(0, len(vectors), 256):
            d = squared(vectors[s : s + 256], table)
            d[known[None, :] == ids[s : s + 256, None]] = np.inf
            if d.shape[1] >= k:
                out[s : s + 256] = np.partition(d, k - 1, axis=1)[:, k - 1]
        return out * (1 + SLACK) + 1e-12 * (vectors * vectors).sum(1)


def by_length(batch: pa.RecordBatch, column: str = "vector") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of a batch by vector length: the length, row numbers, and the vectors as a table."""
    array = batch.column(column)
    lengths = array.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield int(d), rows, array.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def scan(
    queries: np.ndarray, query_ids: np.ndarray, bounds: np.ndarray, columns: list[np.ndarray], vectors: np.ndarray, ids: np.ndarray, turned: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query rows, candidate ids and distances of the k best of each query in a block, and how many components were read.

    ``columns`` are the block's turned column blocks, ``turned`` the turned queries.
    """
    d_all = queries.shape[1]
    limit = bounds * (1 + SLACK) + SLACK * 1e-4 * (queries * queries).sum(1)
    row, col = np.nonzero(query_ids[:, None] != ids[None, :])
    partial, seen, read = np.zeros(len(row)), 0, 0
    for part in columns:
        width = part.shape[1]
        q, x = turned[:, seen : seen + width], part.astype(float)
        read += len(row) * width
        if 3 * len(row) > len(queries) * len(ids):
            partial = partial + squared(q, x)[row, col]
        else:
            partial = partial + ((q[row] - x[col]) ** 2).sum(1)
        seen += width
        wide = 1.0 if seen == d_all else (1 + EPSILON / math.sqrt(seen)) ** 2
        alive = partial * (d_all / seen) <= limit[row] * wide
        row, col, partial = row[alive], col[alive], partial[alive]
    exact = np.sqrt(((queries[row] - vectors[col].astype(float)) ** 2).sum(1))
    order = np.lexsort((ids[col], exact, row))
    row, found, exact = row[order], ids[col[order]], exact[order]
    _, first = np.unique(np.stack([row, found]), axis=1, return_index=True) if len(row) else (None, np.zeros(0, np.int64))
    first = np.sort(first)
    row, found, exact = row[first], found[first], exact[first]
    best = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[best], found[best], exact[best], read


class Index:
    """A written index: fit, list sizes, blocks."""

    def __init__(self, rows: DataFrame, k: int = 10) -> None:
        """``rows`` as from :func:`usable`; ``k`` is what the probes are measured for."""
        self.spark: SparkSession = rows.sparkSession
        self.float = "<f8" if "double" in rows.schema["vector"].dataType.simpleString() else "<f4"
        lengths = {r.d: r.n for r in rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect()}
        self.rows = sum(lengths.values())
        sample = self._sample(rows)
        self.cells = Cells.fit(sample, lengths)
        assigned = written(self._assigned(rows))
        sizes = assigned.groupBy("d", "list").agg(F.count("*").alias("n")).collect()
        self.sizes = {(r.d, r.list): r.n for r in sizes}
        self.probes = self._measured(assigned, {d: (ids[:TRIALS], table[:TRIALS]) for d, (ids, table) in sample.items()}, k)
        self.blocks = self._blocks(assigned)

    def _sample(self, rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """About ``FIT`` rows drawn by hash, and never more."""
        share = min(PARTS, FIT * PARTS // max(1, self.rows))
        drawn = F.xxhash64("id", "vector")
        few = rows.filter(F.pmod(drawn, F.lit(PARTS)) < share).orderBy(drawn, "id").limit(FIT)
        found: dict[int, list] = {}
        for batch in few.toArrow().to_batches():
            for d, at, table in by_length(batch):
                found.setdefault(d, []).append((batch.column("id").to_numpy()[at], table.astype(float)))
        return {d: (np.concatenate([i for i, _ in some]), np.concatenate([t for _, t in some])) for d, some in found.items()}

    def _assigned(self, rows: DataFrame) -> DataFrame:
        cells = self.cells

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d_of, list_of = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
                for d, at, table in by_length(batch):
                    d_of[at] = d
                    for s in range(0, len(at), 1024):
                        list_of[at[s : s + 1024]] = cells.order(table[s : s + 1024].astype(float), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(d_of), pa.array(list_of), *batch.columns], names=["d", "list", "id", "vector"])

        return rows.mapInArrow(run, f"d int, list int, id bigint, vector {rows.schema['vector'].dataType.simpleString()}")

    def _measured(self, assigned: DataFrame, trials: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> int:
        """Lists to probe so that they hold ``RECALL`` of the trials' true neighbours, found by brute force over all rows."""
        cells = self.cells
        prepared = {}
        for d, (ids, vectors) in trials.items():
            ids, first = np.unique(ids, return_index=True)
            vectors = vectors[first]
            prepared[d] = ids, vectors, cells.bounds(ids, vectors, k), np.argsort(cells.order(vectors), axis=1, kind="stable")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists, ids = batch.column("list").to_numpy(), batch.column("id").to_numpy()
                for d, at, table in by_length(batch):
                    if d not in prepared:
                        continue
                    own, vectors, bounds, place = prepared[d]
                    near = squared(vectors, table.astype(float))
                    near[own[:, None] == ids[at][None, :]] = np.inf
                    if near.shape[1] > k:
                        bounds = np.minimum(bounds, np.partition(near, k - 1, axis=1)[:, k - 1])
                    row, col = np.nonzero((near <= bounds[:, None]) & np.isfinite(near))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[row]), pa.array(ids[at[col]]), pa.array(near[row, col]), pa.array(place[row, lists[at[col]]])],
                        names=["trial", "id", "near", "place"],
                    )

        found = assigned.mapInArrow(run, "trial bigint, id bigint, near double, place bigint")
        best = top_per_key(found, ["trial"], [F.asc("near"), F.asc("id")], k, "rank")
        places = sorted(r.place for r in best.select("place").collect())
        return 1 + places[min(len(places) - 1, math.ceil(RECALL * len(places)) - 1)] if places else 1

    def _salt(self, parts: dict[tuple[int, int], int]):
        """Deals the rows of each list over its parts, task by task in turn."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start = 0
            for batch in batches:
                keys = zip(batch.column("d").to_pylist(), batch.column("list").to_pylist())
                many = np.array([parts.get(key, 1) for key in keys], np.int64)
                salt = (start + np.arange(len(many))) % many
                start += len(many)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(salt.astype(np.int32))], names=[*batch.schema.names, "salt"])

        return run

    def _gathered(self, rows: DataFrame, parts: dict[tuple[int, int], int]) -> DataFrame:
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        salted = rows.mapInArrow(self._salt(parts), f"{schema}, salt int")
        return salted.repartition(partitions(self.spark), "d", "list", "salt").sortWithinPartitions("d", "list", "salt")

    def _blocks(self, assigned: DataFrame) -> DataFrame:
        rotations, kind = self.cells.rotations, self.float
        parts = {key: math.ceil(n / BLOCK) for key, n in self.sizes.items()}

        def pack(d: int, list_: int, ids: np.ndarray, table: np.ndarray) -> list:
            turned = (table.astype(float) @ rotations[d]).astype("<f4")
            columns = [np.ascontiguousarray(turned[:, s : s + COLUMNS]).tobytes() for s in range(0, d, COLUMNS)]
            return [d, list_, ids.astype("<i8").tobytes(), columns, table.astype(kind).tobytes()]

        packed = _runs(["id", "vector"], BLOCK, pack, [pa.binary(), pa.list_(pa.binary()), pa.binary()], ["ids", "columns", "vectors"])
        with small_batches(self.spark, BLOCK):
            return written(self._gathered(assigned, parts).mapInArrow(packed, "d int, list int, ids binary, columns array<binary>, vectors binary"))

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest found of each query (``id``, ``vector``)."""
        asked = written(queries.groupBy("id").agg(F.min("vector").alias("vector")))
        found = self._scanned(asked, k, probes or self.probes, True)
        enough = found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).filter(F.col("n") >= k)
        short = asked.join(enough.withColumnRenamed("query_id", "id"), "id", "left_anti")
        if not short.isEmpty():
            found = found.unionByName(self._scanned(short, k, len(self.sizes), False))
        self.components = found.agg(F.coalesce(F.sum("components"), F.lit(0))).first()[0]
        nearest = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        best = top_per_key(nearest, ["query_id"], [F.asc("score"), F.asc("vec_id")], k, "rank")
        return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    def _scanned(self, asked: DataFrame, k: int, probes: int, bounded: bool) -> DataFrame:
        """The k best of each query and block that it meets; a written table."""
        cells, rotations, kind, known = self.cells, self.cells.rotations, self.float, frozenset(self.sizes)
        vector = asked.schema["vector"].dataType.simpleString()

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("id").to_numpy()
                for d, at, table in by_length(batch):
                    for s in range(0, len(at), PACK):
                        some, rows = table[s : s + PACK].astype(float), at[s : s + PACK]
                        bounds = cells.bounds(ids[rows], some, k) if bounded else np.full(len(rows), np.inf)
                        lists = cells.order(some, probes)
                        row = np.repeat(np.arange(len(rows)), lists.shape[1])
                        list_ = lists.ravel()
                        full = np.array([(d, x) in known for x in list_.tolist()], bool)
                        row, list_ = row[full], list_[full]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(row), d, np.int32)), pa.array(list_.astype(np.int32)), batch.column("id").take(pa.array(rows[row])),
                             pa.array(bounds[row]), batch.column("vector").take(pa.array(rows[row]))],
                            names=["d", "list", "id", "bound", "vector"],
                        )

        def pack(d: int, list_: int, ids: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> list:
            return [d, list_, ids.astype("<i8").tobytes(), bounds.astype("<f8").tobytes(), table.astype(kind).tobytes()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    d = r["d"]
                    queries_, vectors = (np.frombuffer(r[c], kind).reshape(-1, d) for c in ("queries", "vectors"))
                    query_ids, ids = np.frombuffer(r["query_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                    columns = [np.frombuffer(c, "<f4").reshape(len(ids), -1) for c in r["columns"]]
                    wide = queries_.astype(float)
                    row, found, score, read = scan(wide, query_ids, np.frombuffer(r["bounds"], "<f8"), columns, vectors, ids, wide @ rotations[d], k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(query_ids[row]), pa.array(found), pa.array(score), pa.array(np.where(np.arange(len(row)) == 0, read, 0))],
                        names=["query_id", "vec_id", "score", "components"],
                    )

        probed = asked.mapInArrow(probe, f"d int, list int, id bigint, bound double, vector {vector}")
        n = asked.count()
        parts = {key: max(1, math.ceil(n * min(1.0, probes * size / self.rows) / PACK)) for key, size in self.sizes.items()}
        packed = _runs(["id", "bound", "vector"], PACK, pack, [pa.binary()] * 3, ["query_ids", "bounds", "queries"])
        with small_batches(self.spark, BLOCK):
            packs = written(self._gathered(probed, parts).mapInArrow(packed, "d int, list int, query_ids binary, bounds binary, queries binary"))
        met = self.blocks.join(packs, ["d", "list"])
        with small_batches(self.spark, 8):
            return written(met.mapInArrow(run, "query_id bigint, vec_id bigint, score double, components bigint"))


def _runs(columns: list[str], size: int, pack, types: list, names: list[str]):
    """Cuts sorted rows into runs of one length and list, ``size`` rows at most, and packs each into a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(d, list_, parts):
            table = pa.Table.from_batches(parts).combine_chunks()
            values = [np.asarray(table[c].combine_chunks().to_numpy(zero_copy_only=False)) for c in columns[:-1]]
            vectors = table[columns[-1]].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            row = pack(d, list_, *values, vectors)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.int32(), *types])], names=["d", "list", *names])

        now, parts, held = None, [], 0
        for batch in batches:
            d, list_ = batch.column("d").to_numpy(), batch.column("list").to_numpy()
            cuts = np.flatnonzero((d[1:] != d[:-1]) | (list_[1:] != list_[:-1])) + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                if start == end:
                    continue
                key = int(d[start]), int(list_[start])
                if key != now and parts:
                    yield packed(*now, parts)
                    parts, held = [], 0
                now = key
                while start < end:
                    take = min(size - held, end - start)
                    parts.append(batch.slice(start, take).select(columns))
                    start, held = start + take, held + take
                    if held == size:
                        yield packed(*now, parts)
                        parts, held = [], 0
        if parts:
            yield packed(*now, parts)

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Index ``rows`` and search ``queries``, both as from :func:`usable`."""
    return Index(rows, k).search(queries, k)


def exact(rows: DataFrame, queries: DataFrame, k: int = 10, at_once: int = 512) -> DataFrame:
    """The same by brute force, a bounded number of queries against all rows at a time: what recall is measured with."""
    points = sorted((r.id, r.vector) for r in queries.groupBy("id").agg(F.min("vector").alias("vector")).limit(at_once + 1).collect())
    if len(points) > at_once:
        raise ValueError(f"brute force takes {at_once} queries at most")
    kept = [(i, np.array(v, float)) for i, v in points]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for d, at, table in by_length(batch):
                for i, v in kept:
                    if len(v) != d:
                        continue
                    near = np.sqrt(((table.astype(float) - v) ** 2).sum(1))
                    near[ids[at] == i] = np.inf
                    top = near <= np.partition(near, min(k, len(near)) - 1)[min(k, len(near)) - 1]
                    top &= np.isfinite(near)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(int(top.sum()), i)), pa.array(ids[at[top]]), pa.array(near[top])], names=["query_id", "vec_id", "score"]
                    )

    found = rows.mapInArrow(run, "query_id bigint, vec_id bigint, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = top_per_key(found, ["query_id"], [F.asc("score"), F.asc("vec_id")], k, "rank")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """Share of the true neighbours (of the queries in ``true``) that were found."""
    hit = true.select("query_id", "vec_id").join(found.select("query_id", "vec_id").withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return hit.agg(F.count("*").alias("n"), (F.count("hit") / F.count("*")).alias("recall"))
