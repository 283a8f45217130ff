"""Sharding along a Hilbert curve.

Metadata dimensions are quantised into 2 ** ``BITS`` steps of about equal counts; the
steps' bounds are approximate percentiles, a bounded summary. Rows are ordered by
their index on the Hilbert curve through the quantised space, so neighbours in
the order are close in all dimensions, and the order is cut into runs. A run covers
a small box, and files can be skipped by the ranges of several columns at once.

The cut needs each row's rank. The curve has at most 2 ** (BITS * dimensions) cells and a
cell is split by hash into ``SPLITS``: counts per split are summed up along the curve, and
a row's rank is the sum before its split plus its place in the split. No task sees
more than one split's rows, also where one source holds a third of them. Rows are
reduced to key, size and index first; texts are not shuffled.

Defined cases: NULL dimensions are a value of their own, below all others; a NULL text
has no bytes; NULL and repeated keys and equal rows get places of their own; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marquee.llm.expressions import let
from marquee.llm.shared import written

BITS = 4
SPLITS = 64


def quantised(df: DataFrame, dimensions: dict[str, Column], bits: int = BITS) -> dict[str, Column]:
    """Each dimension as a step from 0 to 2 ** bits - 1: text by its hash's share, numbers by percentile.

    One aggregate finds all bounds.
    """
    steps = 1 << bits
    at = [i / steps for i in range(1, steps)]
    numbers = {name: F.xxhash64(c) if dict(df.select(c.alias("x")).dtypes)["x"] == "string" else c.cast("double") for name, c in dimensions.items()}
    numbers = {name: F.when(dimensions[name].isNotNull(), x) for name, x in numbers.items()}
    bounds = df.agg(*(F.percentile_approx(x, at, 10_000).alias(name) for name, x in numbers.items())).first()
    out = {}
    for name, x in numbers.items():
        cuts = sorted(set(bounds[name] or []))
        above = sum(((x > F.lit(c)).cast("int") for c in cuts), F.lit(0))
        out[name] = F.coalesce(above, F.lit(0))
    return out


def hilbert_index(coordinates: list[Column], bits: int = BITS) -> Column:
    """Index on the compact Hilbert curve through a grid of 2 ** bits steps a side.

    From the highest bit down, the coordinates' bits name a corner of the current
    cube. The cube's entry corner and direction turn it into the corner's place on
    the curve, and give entry and direction of the next smaller cube.
    """
    n = len(coordinates)
    size = 1 << n
    gray = [i ^ (i >> 1) for i in range(size)]
    place = [gray.index(i) for i in range(size)]
    trailing = [(~i & (i + 1)).bit_length() - 1 for i in range(size)]
    entry = [0] + [gray[2 * ((i - 1) // 2)] for i in range(1, size)]
    turn = [0] + [trailing[i - 1] % n if i % 2 == 0 else trailing[i] % n for i in range(1, size)]
    tables = {name: F.array(*map(F.lit, values)) for name, values in (("place", place), ("entry", entry), ("turn", turn))}

    def rotated(x: Column, by: Column, left: bool) -> Column:
        """``x``, a number of n bits, rotated by ``by`` modulo n."""
        by = F.pmod(by, F.lit(n))
        back = F.lit(n) - by
        first, second = (by, back) if left else (back, by)
        up = F.call_function("shiftleft", x, first)
        down = F.call_function("shiftright", x, second)
        return (up.bitwiseOR(down)).bitwiseAND(F.lit(size - 1))

    def step(state: Column, bit: Column) -> Column:
        corner = sum((F.call_function("shiftleft", F.call_function("shiftright", c.cast("int"), bit).bitwiseAND(F.lit(1)), F.lit(i)) for i, c in enumerate(coordinates)), F.lit(0))
        local = rotated(corner.bitwiseXOR(state["entry"]), state["direction"] + 1, left=False)
        return let(
            F.get(tables["place"], local),
            lambda w: F.struct(
                (state["index"] * size + w).alias("index"),
                state["entry"].bitwiseXOR(rotated(F.get(tables["entry"], w), state["direction"] + 1, left=True)).alias("entry"),
                F.pmod(state["direction"] + F.get(tables["turn"], w) + 1, F.lit(n)).alias("direction"),
            ),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("index"), F.lit(0).alias("entry"), F.lit(0).alias("direction"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda s: s["index"])


def in_runs(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` (with ``hilbert`` and ``tie``) cut along the curve into ``shards`` runs whose counts differ by
    one at most: with ``shard`` and ``slot``, the place in the shard."""
    split = F.pmod(F.xxhash64("tie"), F.lit(SPLITS)).cast("int")
    rows = rows.withColumn("split", split)
    counts = rows.groupBy("hilbert", "split").agg(F.count("*").alias("n"))
    in_cell = Window.partitionBy("hilbert").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("inside", F.coalesce(F.sum("n").over(in_cell), F.lit(0)))
    # one row per cell of the curve: bounded by the grid, not by the rows
    cells = rows.groupBy("hilbert").agg(F.count("*").alias("cell"))
    along = Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("hilbert", F.coalesce(F.sum("cell").over(along), F.lit(0)).alias("before"))
    starts = counts.join(cells, "hilbert").select("hilbert", "split", (F.col("before") + F.col("inside")).alias("first"))
    total = rows.count()
    place = F.row_number().over(Window.partitionBy("hilbert", "split").orderBy("tie"))
    ranked = rows.withColumn("place", place).join(starts, ["hilbert", "split"]).withColumn("rank", F.col("first") + F.col("place") - 1)
    ranked = ranked.withColumn("shard", F.expr(f"int((rank * {shards}) div {max(total, 1)})"))
    # the smallest rank of a shard
    lowest = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return ranked.withColumn("slot", F.col("rank") - lowest).drop("split", "place", "first", "rank")


def sharded(documents: DataFrame, key: str, text: str, dimensions: list[str], shards: int = 8, bits: int = BITS) -> DataFrame:
    """Per row: ``key``, ``size`` (UTF-8 bytes and one), ``text_crc32``, ``hilbert``, ``shard`` and ``slot``."""
    content = F.coalesce(F.col(text), F.lit(""))
    rows = written(
        documents.select(
            F.col(key).alias("key"), (F.octet_length(content) + 1).cast("bigint").alias("size"), F.crc32(content.cast("binary")).alias("text_crc32"),
            *(F.col(d).alias(f"d{i}") for i, d in enumerate(dimensions)),
        ).withColumn("at", F.monotonically_increasing_id())
    )
    steps = quantised(rows, {f"d{i}": F.col(f"d{i}") for i in range(len(dimensions))}, bits)
    rows = rows.withColumns({f"q{i}": steps[f"d{i}"] for i in range(len(dimensions))})
    rows = rows.withColumn("hilbert", hilbert_index([F.col(f"q{i}") for i in range(len(dimensions))], bits))
    rows = rows.withColumn("tie", F.struct("key", "text_crc32", "at")).drop("at", *(f"q{i}" for i in range(len(dimensions))))
    return in_runs(rows, shards).drop("tie")
