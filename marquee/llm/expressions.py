"""Column expressions for whole texts that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: ``[\x20\x09-\x0D]`` as a trim set and as a pattern.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]"
NO_SPACE = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for NULL."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"{SPACE}+")))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(NO_SPACE))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def repeated_words(words: Column, n: int = 3) -> Column:
    """Words in ``n``-word windows that the text has twice or more, the first included.

    Windows are compared by 64-bit hashes: sorted with their places, equal ones
    are neighbours.
    """

    def covered(places: Column) -> Column:
        steps = F.zip_with(places, F.slice(places, F.lit(2), F.greatest(F.size(places), F.lit(1))), lambda a, b: F.least(F.lit(n), b - a))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def doubled(s: Column) -> Column:
        def place(x: Column, k: Column) -> Column:
            same = ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
            return F.when(same, x["i"])

        return F.array_sort(F.array_compact(F.transform(s, place)))

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - n)
        return F.sort_array(F.transform(at, lambda i: F.struct(F.xxhash64(*(F.get(w, i + k) for k in range(n))).alias("h"), i.alias("i"))))

    return F.when(F.size(words) <= n, F.lit(0)).otherwise(let(let(windows(words), doubled), covered)).cast("bigint")
