"""Keep-one-row-per-key operators, all with a total order.

``row_number() = 1`` lets Spark cut each group below the shuffle
(WindowGroupLimit): every task sends one row per key, so a key that holds a
third of all rows does not arrive as one huge group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank"
) -> DataFrame:
    """Number the rows of each key from 1 in the given order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank"
) -> DataFrame:
    return ranked(df, keys, order, name).filter(F.col(name) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1, "_row").drop("_row")


def _descending(names: Sequence[str]) -> list[Column]:
    return [F.col(n).desc_nulls_last() for n in names]


def most_complete(df: DataFrame, tie: Sequence[Column]) -> DataFrame:
    """Best row per id by completeness, then votes; any row when neither exists."""
    known = [c for c in ("metadata_completeness_score", "vote_count") if c in df.columns]
    return first_per_key(df, ["id"], [*_descending(known), *tie])


def best_quality(df: DataFrame, tie: Sequence[Column]) -> DataFrame:
    order = _descending(["recommendation_quality_score", "vote_count", "popularity"])
    return first_per_key(df, ["id"], [*order, *tie])


def most_popular(df: DataFrame, n: int, tie: Sequence[Column]) -> DataFrame:
    """Most popular row per id, then the n most popular ids."""
    order = _descending(["popularity", "vote_count"])
    return first_per_key(df, ["id"], [*order, *tie]).orderBy(*order, F.col("id")).limit(n)


def last_batch(df: DataFrame, batch_order: Sequence[str]) -> DataFrame:
    """The row of the latest batch (file name, then position) per id."""
    return first_per_key(df, ["id"], [F.col(c).desc() for c in batch_order])


def first_batch(df: DataFrame, batch_order: Sequence[str]) -> DataFrame:
    return first_per_key(df, ["id"], [F.col(c).asc() for c in batch_order])


def last_writer_wins(current: DataFrame, incoming: DataFrame, tie: Sequence[Column] = ()) -> DataFrame:
    """Merge two replicas by id: the newest row stays, the second side wins ties."""
    both = current.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    order = [F.col("updated_at").desc_nulls_last(), F.col("_side").desc(), *tie]
    return first_per_key(both, ["id"], order).drop("_side")


def duplicate_summary(df: DataFrame, key: str = "id") -> DataFrame:
    """Rows, distinct keys and their difference."""
    rows, unique = F.count("*"), F.countDistinct(key)
    return df.agg(
        rows.alias("total_rows"),
        unique.alias("unique_ids"),
        (rows - unique).alias("duplicate_rows_by_id"),
    )


def duplicate_keys(df: DataFrame, key: str = "id") -> DataFrame:
    return (
        df.groupBy(key)
        .agg(F.count("*").alias("count_rows"))
        .filter(F.col("count_rows") > 1)
        .orderBy(F.desc("count_rows"), F.asc(key))
    )
