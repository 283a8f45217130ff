"""Exact k-best search of a table of queries over a table of items.

No pair is ever written out: a NumPy kernel scores a block of queries against a
block of items, and only the k best of each query leave the task. Spark then
cuts the survivors to k per query.

Queries are cut into blocks by hash, items likewise, and every block pair is one
group (block nested-loop join), so neither side has to fit anywhere, and the plan
is the same for few queries and for many. Equality columns (``within``) restrict the pairs; a value that holds
a third of all rows is cut into blocks like everything else.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from marquee.operators.dedupe import top_per_key

Kernel = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]


@dataclass(frozen=True)
class Order:
    """A ranking, both for pandas blocks and for Spark."""

    columns: Sequence[str]
    ascending: Sequence[bool]

    def spark(self) -> list[Column]:
        return [
            F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last()
            for c, up in zip(self.columns, self.ascending)
        ]

    def without(self, *columns: str) -> Order:
        kept = [(c, up) for c, up in zip(self.columns, self.ascending) if c not in columns]
        return Order([c for c, _ in kept], [up for _, up in kept])

    def sorted(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values(list(self.columns), ascending=list(self.ascending), kind="stable")

    def cut(self, found: pd.DataFrame, key: str, k: int) -> pd.DataFrame:
        return self.sorted(found).groupby(key, sort=False).head(k)


@dataclass(frozen=True)
class BlockSizes:
    """Rows of a query block and of an item block: what one group holds."""

    query_rows: int = 2048
    item_rows: int = 4096


def best_matches(
    queries: DataFrame,
    items: DataFrame,
    kernel: Kernel,
    schema: str,
    order: Order,
    k: int,
    query_key: str = "query_id",
    item_key: str = "id",
    within: Sequence[str] = (),
    sizes: BlockSizes = BlockSizes(),
    rank: str = "rank",
) -> DataFrame:
    """The k best items of each query, numbered in ``order``.

    ``kernel(queries, items)`` scores one block pair with pandas and returns
    rows of ``schema``. ``within`` columns exist on both sides.
    """
    found = _gridded(queries, items, kernel, schema, order, k, query_key, item_key, list(within), sizes)
    return top_per_key(found, [query_key], order.spark(), k, rank)


def _gridded(queries, items, kernel, schema, order, k, query_key, item_key, within, sizes) -> DataFrame:
    def blocks(df: DataFrame, rows: int, name: str) -> DataFrame:
        return df.groupBy(*within).agg(F.greatest(F.ceil(F.count("*") / rows), F.lit(1)).cast("int").alias(name))

    query_blocks = blocks(queries, sizes.query_rows, "_qn")
    item_blocks = blocks(items, sizes.item_rows, "_in")
    if within:
        # One row per value. Without the hint the planner may send the queries instead, which it judges by what they were made from.
        counts = F.broadcast(query_blocks.join(item_blocks, within))
        left, right = queries.join(counts, within), items.join(counts, within)
    else:
        counts = {"_qn": query_blocks.scalar(), "_in": item_blocks.scalar()}
        left, right = queries.withColumns(counts), items.withColumns(counts)

    def own(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = left.withColumn("_qb", own(query_key, "_qn")).withColumn("_ib", every("_in"))
    right = right.withColumn("_ib", own(item_key, "_in")).withColumn("_qb", every("_qn"))
    # Both sides may descend from one table: fresh columns keep them apart.
    left, right = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (left, right))
    keys = [*within, "_qb", "_ib"]
    empty = pd.DataFrame({f.split()[0]: [] for f in schema.split(", ")}, dtype=object)

    def run(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(i):
            return empty
        found = kernel(q, i)
        return order.cut(found, query_key, k) if len(found) else empty

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)
