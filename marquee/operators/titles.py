"""Title search and title resolution for a table of queries.

Queries never meet all titles: contained titles come from a posting table of character n-grams, similar ones from
a prefix-filtered join (``postings``). Each distinct title is looked at once, however many movies share
it, and brings at most as many movies as can be in the answer.
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from marquee.functions.columns import never_broadcast
from marquee.functions.strings import normalise_title
from marquee.operators.blocks import Order
from marquee.operators.dedupe import top_per_key
from marquee.operators.postings import containing, gram_postings, lengths_met, similar_pairs

# The fuzzy thresholds and list lengths.
FUZZY_RATIO = 0.74
FUZZY_PICK = 0.88
FUZZY_MIN_LENGTH = 4
CONTAINS_LIMIT = 8
FUZZY_LIMIT = 5


def titles_of(movies: DataFrame, key: Column, order: Sequence[Column], k: int, keep: Sequence[str]) -> DataFrame:
    """The first ``k`` movies of each distinct title ``key``."""
    keyed = movies.select(*keep, key.alias("key")).filter(F.col("key").isNotNull() & (F.col("key") != ""))
    return top_per_key(keyed, ["key"], order, k, "_n").drop("_n")


def title_postings(movies: DataFrame, key: Column) -> DataFrame:
    """The posting table of the distinct titles ``key``; written once, it serves every search on that key."""
    keys = movies.select(key.alias("key")).filter(F.col("key").isNotNull() & (F.col("key") != "")).distinct()
    return gram_postings(keys)


def _search(queries, movies, key, order, k, postings, exact_first=False) -> DataFrame:
    """The k first movies of each query whose title holds it."""
    own = order.without("tier")
    needed = list(dict.fromkeys(["id", *own.columns]))
    few = titles_of(movies, key, own.spark(), k, needed)
    asked = queries.filter(F.col("wanted") != "").select(F.col("query_id").cast("bigint"), "wanted")
    hits = containing(asked.select("wanted").distinct(), title_postings(movies, key) if postings is None else postings)
    tier = (F.col("key") != F.col("wanted")).cast("int") if exact_first else F.lit(0)
    rows = hits.join(never_broadcast(few), "key").withColumn("tier", tier)
    best = top_per_key(rows, ["wanted"], order.spark(), k, "rank")
    return asked.join(best, "wanted").select("query_id", *needed, "tier", "rank")


def search_titles(queries: DataFrame, movies: DataFrame, limit: int = 10, postings: DataFrame | None = None) -> DataFrame:
    """Movies whose normalised title contains the query, most voted first.

    ``queries``: query_id, query. Exact and prefix hits are a subset of the
    contained ones and do not change the order. ``postings`` is the posting table of the
    normalised titles, if it was written before.
    """
    order = Order(["vote_count", "vote_average", "title", "id"], [False, False, True, True])
    asked = queries.withColumn("wanted", normalise_title("query"))
    return _search(asked, movies, normalise_title("title"), order, limit, postings)


def resolve_first(queries: DataFrame, movies: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """One movie per query: an equal title (ignoring case), else one that contains it."""
    order = Order(["tier", "title", "release_year", "id"], [True] * 4)
    asked = queries.withColumn("wanted", F.lower("query"))
    found = _search(asked, movies, F.lower("title"), order, 1, postings, exact_first=True)
    return found.drop("rank")


def resolve_popular(queries: DataFrame, movies: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """The most voted, then most popular, movie whose title contains the query."""
    order = Order(["vote_count", "popularity", "id"], [False, False, True])
    asked = queries.withColumn("wanted", F.trim(F.lower("query")))
    return _search(asked, movies, F.lower("title"), order, 1, postings).drop("rank", "tier")


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratio of the matching blocks of two texts; the first one is the query, as the ratio depends on the order."""

    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(left, right)], dtype=float)

    return ratio(a, b)


def _fuzzy_sides(queries: DataFrame, movies: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Queries with their wanted text, and the movies that can be in an answer, by title."""
    order = [F.desc_nulls_last("vote_count"), F.desc_nulls_last("vote_average"), F.asc("id")]
    rated = movies.withColumns({c: F.col(c).cast("double") for c in ("vote_count", "vote_average")})
    few = titles_of(rated, normalise_title("title"), order, limit, ["id", "vote_count", "vote_average"])
    wanted = queries.select(F.col("query_id").cast("bigint"), normalise_title("query").alias("wanted"))
    return wanted.filter(F.length("wanted") >= FUZZY_MIN_LENGTH), few


def fuzzy_titles(queries: DataFrame, movies: DataFrame, limit: int = FUZZY_LIMIT) -> DataFrame:
    """Movies whose normalised title resembles the query, most similar first.

    The sequence ratio is computed only for pairs that the similarity join lets through.
    """
    asked, few = _fuzzy_sides(queries, movies, limit)
    pairs = similar_pairs(asked.select("wanted").distinct(), few.select("key").distinct(), round(100 * FUZZY_RATIO))
    rated = pairs.withColumn("ratio", sequence_ratio(F.col("wanted"), F.col("key"))).filter(F.col("ratio") >= FUZZY_RATIO)
    order = [F.desc("ratio"), F.desc_nulls_last("vote_count"), F.desc_nulls_last("vote_average"), F.asc("id")]
    best = top_per_key(rated.join(never_broadcast(few), "key"), ["wanted"], order, limit, "rank")
    return asked.join(best, "wanted").select("query_id", "id", "ratio", "vote_count", "vote_average", "rank")


def fuzzy_candidates(queries: DataFrame, movies: DataFrame) -> DataFrame:
    """Per query: distinct titles of a length that can reach the ratio, and those that the similarity join lets through."""
    asked, few = _fuzzy_sides(queries, movies, 1)
    wanted, keys = asked.select("wanted").distinct(), few.select("key")
    percent = round(100 * FUZZY_RATIO)
    through = similar_pairs(wanted, keys, percent).groupBy("wanted").agg(F.count("*").alias("compared"))
    counts = lengths_met(wanted, keys, percent).join(through, "wanted", "left")
    return asked.join(counts, "wanted").select("query_id", "wanted", "in_length", F.coalesce("compared", F.lit(0)).alias("compared"))


def resolve_with_status(queries: DataFrame, movies: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """Resolve each query to one movie, or to candidates to choose from.

    A title that equals the query exactly once wins. Otherwise up to eight
    containing titles are candidates, or else up to five similar ones, of which
    a very similar first one wins. One candidate is taken, more are ambiguous.
    Returns query_id, status, source_id, candidates (ids in order).
    """
    asked = queries.withColumn("wanted", normalise_title("query"))
    per_title = movies.groupBy(normalise_title("title").alias("wanted")).agg(
        F.count("*").alias("equal"), F.min("id").alias("equal_id")
    )
    exact = asked.join(never_broadcast(per_title), "wanted", "left").withColumn("unique", F.coalesce(F.col("equal") == 1, F.lit(False)))
    open_queries = exact.filter(~F.col("unique")).select("query_id", "query")
    contained = _listed(search_titles(open_queries, movies, CONTAINS_LIMIT, postings), "contained")
    similar = fuzzy_titles(open_queries.join(contained, "query_id", "left_anti"), movies, FUZZY_LIMIT)
    similar = _listed(similar, "similar", F.max("ratio").alias("best_ratio"))
    merged = exact.join(contained, "query_id", "left").join(similar, "query_id", "left")
    candidates = F.coalesce("contained", "similar", F.array().cast("array<bigint>"))
    picked = (
        F.when(F.col("unique"), F.col("equal_id"))
        .when(F.col("contained").isNull() & (F.col("best_ratio") >= FUZZY_PICK), F.get("similar", 0))
        .when(F.size(candidates) == 1, F.get(candidates, 0))
    )
    return merged.select(
        "query_id",
        "query",
        F.when(picked.isNotNull(), "resolved").when(F.size(candidates) > 1, "ambiguous").otherwise("not_found").alias("status"),
        picked.alias("source_id"),
        F.when(picked.isNull(), candidates).otherwise(F.array().cast("array<bigint>")).alias("candidates"),
    )


def _listed(found: DataFrame, name: str, *more) -> DataFrame:
    """The few results of each query as an ordered array of ids."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", "id")))
    return found.groupBy("query_id").agg(F.transform(pairs, lambda p: p["id"]).alias(name), *more)
