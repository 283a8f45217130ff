"""Impact-ordered blocks for sparse vectors: exact nearest neighbours by cosine that skip blocks.

Items are ordered by their heaviest term and its weight (their impact) and cut into blocks, so items that
share what matters lie together. Beside the blocks stands the largest weight of every term in every block. For a
query, the sum of its weights times those maxima bounds the cosine of anything in the block. A search

1. bounds every block that shares a term with the query (one equality join on the term),
2. scores the block with the highest bound, which gives the query a k-th score,
3. scores the blocks whose bound reaches that score, and no others.

Queries and items meet by equality on the block in the block search, so a term of a third of all items is spread
over its blocks. Items that share no term with a query have cosine 0: they count where a query finds fewer
than k positive scores, and then only the most voted ones can be in the result, a block of their own. Weights are
counts or what follows from them, never negative.

Items may have a score of their own, such as a share of ratings and votes. A hybrid search ranks by a weight times the
cosine plus that score; a block's bound is then the weighted bound of the cosine plus its largest own score, and blocks that
share no term are reached where their largest own score alone suffices: by equality on its level, as blocks and floors
are both cut to ``LEVELS`` steps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marquee.functions.columns import never_broadcast
from marquee.operators.blocks import BlockSizes
from marquee.operators.dedupe import ranked, top_per_key
from marquee.operators.retrieval import ORDER, RESULT, best_sparse
from marquee.session import cut_lineage

#: Items of a block.
BLOCK = 1024
#: Scores are ranked after rounding to six digits; bounds leave room for that.
MARGIN = 2e-6
#: The block of the most voted items.
VOTED = -1
#: Steps per unit of the own scores.
LEVELS = 1000


def unit_weights(indices: str = "indices", values: str = "values") -> Column:
    """(term, weight) pairs of a sparse vector scaled to length one; none for a vector of zeros."""
    size = F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x))
    pairs = F.arrays_zip(F.col(indices).alias("term"), F.col(values).alias("weight"))

    def scaled(n: Column) -> Column:
        return F.transform(pairs, lambda p: F.struct(p["term"].alias("term"), (p["weight"] / n).alias("weight")))

    return F.when(size > 0, F.transform(F.array(size), scaled)[0])


@dataclass(frozen=True)
class ImpactIndex:
    """Items with their block, and the largest weight of each term in each block."""

    items: DataFrame
    maxima: DataFrame
    #: part and its largest own score
    tops: DataFrame

    @staticmethod
    def build(items: DataFrame, path: str, block: int = BLOCK, own: Column | None = None) -> ImpactIndex:
        """Write the blocks of ``items`` (id, indices, values, vote_count) below ``path`` and open them; ``own`` is their own score."""
        spark = items.sparkSession
        heaviest = F.array_max(F.transform(unit_weights(), lambda p: F.struct(p["weight"], p["term"])))
        known = items.select(
            "id", "indices", "values", F.coalesce(F.col("vote_count").cast("double"), F.lit(0.0)).alias("vote_count"),
            (F.lit(0.0) if own is None else own).alias("own_score"),
        )
        rated = known.withColumn("_top", heaviest).withColumns({"_term": F.col("_top.term"), "_weight": F.col("_top.weight")}).drop("_top")
        order = [F.asc_nulls_last("_term"), F.desc_nulls_last("_weight"), F.asc("id")]
        placed = rated.repartitionByRange(*order).sortWithinPartitions(*order)
        # Partition and place in it: rows of one partition are numbered in their order.
        place = F.monotonically_increasing_id()
        number = F.shiftright(place, 33) * (1 << 22) + F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / block)
        placed.withColumn("part", number.cast("bigint")).drop("_term", "_weight").write.mode("overwrite").parquet(f"{path}/items")
        written = spark.read.parquet(f"{path}/items")
        terms = written.select("part", F.explode(unit_weights()).alias("p")).select("part", "p.term", "p.weight")
        terms.groupBy("part", "term").agg(F.max("weight").alias("most")).write.mode("overwrite").parquet(f"{path}/maxima")
        written.groupBy("part").agg(F.max("own_score").alias("top")).write.mode("overwrite").parquet(f"{path}/tops")
        return ImpactIndex.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> ImpactIndex:
        return ImpactIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("items", "maxima", "tops")))

    def bounds(self, queries: DataFrame) -> DataFrame:
        """(query_id, part, bound) of the blocks that share a term with a query."""
        terms = queries.select("query_id", F.explode(unit_weights()).alias("p")).select("query_id", "p.term", "p.weight")
        return terms.join(never_broadcast(self.maxima), "term").groupBy("query_id", "part").agg(F.sum(F.col("weight") * F.col("most")).alias("bound"))

    def nearest(self, queries: DataFrame, k: int, sizes: BlockSizes = BlockSizes()) -> DataFrame:
        """The ``k`` nearest of all items; columns as of ``nearest_sparse``, whose result it equals.

        ``queries``: query_id, source_id (left out of its own result), indices, values; each query_id once.
        """
        first, rest, voted = self._stages(_asked(queries), k, sizes)
        both = first.unionByName(rest).unionByName(voted).drop("retrieval_rank")
        # An item may be found in its block and again among the most voted.
        once = both.groupBy("query_id", "id").agg(*(F.max(c).alias(c) for c in both.columns if c not in ("query_id", "id")))
        return top_per_key(once, ["query_id"], ORDER.spark(), k, "retrieval_rank").select(*RESULT, "retrieval_rank")

    def _first(self, asked: DataFrame, k: int, sizes: BlockSizes) -> tuple[DataFrame, DataFrame]:
        """Bounds of the blocks, with the highest of each query first, and what that block gives; both small, written."""
        bounds = cut_lineage(ranked(self.bounds(asked), ["query_id"], [F.desc("bound"), F.asc("part")], "place"))
        best = bounds.filter("place = 1").select("query_id", "part")
        return bounds, cut_lineage(best_sparse(asked.join(best, "query_id"), self.items, k, ["part"], sizes))

    @staticmethod
    def _reached(bounds: DataFrame, first: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(query_id, part) that are still to be scored, and the k-th score of each query that has one."""
        floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("similarity_score").alias("floor")).filter(F.col("n") >= k)
        reached = bounds.filter("place > 1").join(floors, "query_id", "left")
        return reached.filter(F.col("bound") >= F.coalesce("floor", F.lit(-1.0)) - MARGIN).select("query_id", "part"), floors

    def _stages(self, asked: DataFrame, k: int, sizes: BlockSizes) -> tuple[DataFrame, DataFrame, DataFrame]:
        bounds, first = self._first(asked, k, sizes)
        reached, floors = self._reached(bounds, first, k)
        rest = best_sparse(asked.join(reached, "query_id"), self.items, k, ["part"], sizes)
        most = self.items.orderBy(F.desc("vote_count"), F.asc("id")).limit(2 * k + 1).withColumn("part", F.lit(VOTED).cast("bigint"))
        open_ = asked.join(floors.filter(F.col("floor") > MARGIN), "query_id", "left_anti").withColumn("part", F.lit(VOTED).cast("bigint"))
        return first, rest, best_sparse(open_, most, k, ["part"], sizes)

    def nearest_hybrid(self, queries: DataFrame, k: int, weight: float, sizes: BlockSizes = BlockSizes()) -> DataFrame:
        """The ``k`` items with the highest ``weight`` times cosine plus own score; what ``nearest_sparse`` gives with ``own``.

        A threshold search: blocks whose bound does not reach the k-th score of the best block are never scored.
        """
        asked = _asked(queries)
        total = weight * F.col("bound") + F.col("top")
        rated = self.bounds(asked).join(self.tops, "part").select("query_id", "part", total.alias("bound"))
        bounds = cut_lineage(ranked(rated, ["query_id"], [F.desc("bound"), F.asc("part")], "place"))
        best = bounds.filter("place = 1").select("query_id", "part")
        own = F.col("own_score")
        first = cut_lineage(best_sparse(asked.join(best, "query_id"), self.items, k, ["part"], sizes, weight, own))
        floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("hybrid_score")).alias("floor"))
        # A query without a k-th score yet has to see every block.
        least = self.tops.agg(F.min("top")).scalar()
        floor = F.coalesce("floor", least) - MARGIN
        open_ = cut_lineage(asked.select("query_id").join(floors, "query_id", "left").withColumn("floor", floor))
        sharing = bounds.join(open_, "query_id").filter(F.col("bound") >= F.col("floor")).select("query_id", "part")
        level = lambda c: F.floor(F.col(c) * LEVELS)
        highest = self.tops.agg(F.max("top")).scalar()
        steps = F.sequence(level("floor"), F.greatest(F.floor(highest * LEVELS), level("floor")))
        alone = open_.withColumn("_level", F.explode(steps)).join(self.tops.withColumn("_level", level("top")), "_level")
        alone = alone.filter(F.col("top") >= F.col("floor")).select("query_id", "part")
        visits = sharing.unionByName(alone).distinct().join(best, ["query_id", "part"], "left_anti")
        rest = best_sparse(asked.join(visits, "query_id"), self.items, k, ["part"], sizes, weight, own)
        found = top_per_key(first.unionByName(rest).drop("retrieval_rank"), ["query_id"], ORDER.spark(), k, "retrieval_rank")
        return found.select(*RESULT, "hybrid_score", "retrieval_rank")

    def visited(self, queries: DataFrame, k: int, sizes: BlockSizes = BlockSizes()) -> DataFrame:
        """(query_id, shared, visited): blocks that share a term with a query, and blocks that its search scores."""
        bounds, first = self._first(_asked(queries), k, sizes)
        reached, _ = self._reached(bounds, first, k)
        more = reached.groupBy("query_id").agg(F.count("*").alias("more"))
        shared = bounds.groupBy("query_id").agg(F.count("*").alias("shared"))
        return shared.join(more, "query_id", "left").select("query_id", "shared", (1 + F.coalesce("more", F.lit(0))).alias("visited"))


def _asked(queries: DataFrame) -> DataFrame:
    """The queries, written: every step reads them."""
    return cut_lineage(queries.select(F.col("query_id").cast("bigint"), "source_id", "indices", "values"))
