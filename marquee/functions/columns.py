"""Null-safe column expressions shared by every operator. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

Name = str | Column


def as_column(c: Name) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Name) -> Column:
    """The value as text, blank where it is NULL."""
    return F.coalesce(as_column(c).cast("string"), F.lit(""))


def has_text(c: Name) -> Column:
    return F.length(F.trim(text(c))) > 0


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def total(columns: Iterable[Column]) -> Column:
    return reduce(add, columns)


def number(c: Name, kind: str = "double") -> Column:
    """Coercing numeric parse: text that is no number becomes NULL."""
    return as_column(c).try_cast(kind)


def exact_sum(c: Name, scale: int = 4) -> Column:
    """Sum through DECIMAL, so that the order of the rows cannot change it."""
    return F.sum(as_column(c).cast(f"decimal(28,{scale})"))


def mean(c: Name, digits: int = 4) -> Column:
    return F.round(F.avg(as_column(c)), digits)


def half_even_text(c: Name, digits: int) -> Column:
    """A number with fixed digits, rounded half to even on its exact binary value."""
    return F.replace(F.format_number(as_column(c), digits), F.lit(","), F.lit(""))


def half_even(c: Name, digits: int) -> Column:
    """Rounding as Python's ``round`` does it; ``bround`` works on the decimal text instead."""
    return half_even_text(c, digits).try_cast("double")


def ratio(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(part * 100.0 / whole, digits)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by name; columns missing on one side become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The wanted columns that exist, in the wanted order."""
    have = set(df.columns)
    return [n for n in names if n in have]


def project(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Column subset that tolerates missing columns."""
    return df.select(*present(df, names))


def require(df: DataFrame, names: Iterable[str], source: str = "input") -> DataFrame:
    """Raise before planning when a required column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{source} lacks required columns: {missing}")
    return df


def defaults(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Fill NULLs with a typed default, adding the column when it is absent."""
    have = set(df.columns)
    return df.withColumns(
        {n: F.coalesce(F.col(n), F.lit(v)) if n in have else F.lit(v) for n, v in values.items()}
    )


def first_available(df: DataFrame, candidates: Sequence[str]) -> str:
    found = present(df, candidates)
    if not found:
        raise ValueError(f"none of the text columns exists: {list(candidates)}")
    return found[0]


def never_broadcast(df: DataFrame) -> DataFrame:
    """A table that grows with the data, for a join: the planner judges a Parquet table by its compressed size and would
    send one of ten megabytes, which may be hundreds in memory, through the driver."""
    return df.hint("merge")


#: Rows of a key table that may be sent to every task.
FEW = 100_000


def is_few(df: DataFrame, most: int = FEW) -> bool:
    """Whether a table that is already written has at most ``most`` rows."""
    return df.limit(most + 1).count() <= most


def rows_of(keys: DataFrame, rows: DataFrame, on: str | list[str], few: bool) -> DataFrame:
    """``keys`` joined with a table that grows. ``few`` keys, counted before, are sent to that table, which is
    then read where it lies; more of them are merged with it. The table itself is never sent."""
    return F.broadcast(keys).join(rows, on) if few else keys.join(never_broadcast(rows), on)


def long_table(stats: DataFrame, name: str = "metric", value: str = "value") -> DataFrame:
    """One wide row of statistics as (metric, value) rows; NULL becomes ''."""
    pairs = [F.struct(F.lit(c).alias(name), text(c).alias(value)) for c in stats.columns]
    return stats.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
