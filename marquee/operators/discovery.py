"""Metadata discovery: a table of filter requests over the catalogue."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marquee.functions.columns import half_even, text, union_all
from marquee.operators.blocks import BlockSizes, Order, best_matches
from marquee.operators.dedupe import top_per_key
from marquee.operators.intents import BOUND_FIELDS, filter_reason, has_filters, language_code
from marquee.operators.places import with_places
from marquee.operators.ranking import DISCOVERY_WEIGHTS, best_by_score, metadata_score
from marquee.session import cut_lineage

# Movies of the first range of a search in score order, and how much larger each range ends.
FIRST, GROWTH = 4096, 4

# The columns each category of terms is looked up in.
_SEARCHED = {
    "preferred_genres": ["genres_text"],
    "actors": ["top_cast_text"],
    "directors": ["director_clean"],
    "keywords": ["keywords_text", "overview_clean", "tagline_clean"],
}
_BOUNDS = {
    "min_rating": ("vote_average", ">="), "max_rating": ("vote_average", "<="),
    "release_year_from": ("release_year", ">="), "release_year_to": ("release_year", "<="),
    "min_runtime": ("runtime", ">="), "max_runtime": ("runtime", "<="),
}
_ORDER = Order(["score", "vote_count", "vote_average", "id"], [False, False, False, True])
_SCHEMA = "query_id bigint, id bigint, score double, vote_count double, vote_average double"
_COLUMNS = [field.split()[0] for field in _SCHEMA.split(", ")]


def _terms(intent: Column, field: str) -> Column:
    trimmed = F.transform(intent[field], lambda t: F.lower(F.trim(t)))
    return F.filter(trimmed, lambda t: t != "")


def matches(intent: Column) -> Column:
    """The discovery predicate as one expression, for a single request.

    Terms are case-insensitive literal substrings; OR inside a category, AND
    between categories; an unknown value fails a bound.
    """
    def found_in(c: str, terms: Column) -> Column:
        return F.exists(terms, lambda t: F.contains(F.lower(text(c)), t))

    conditions = []
    for field, columns in _SEARCHED.items():
        terms = _terms(intent, field)
        hit = F.lit(False)
        for c in columns:
            hit = hit | found_in(c, terms)
        conditions.append((F.size(terms) == 0) | hit)
    codes = F.transform(F.filter(intent["original_languages"], lambda x: F.trim(x) != ""), language_code)
    conditions.append(
        (F.size(intent["original_languages"]) == 0)
        | F.array_contains(codes, F.lower(text("original_language")))
    )
    for field, (c, sign) in _BOUNDS.items():
        value = F.col(c)
        test = value >= intent[field] if sign == ">=" else value <= intent[field]
        conditions.append(intent[field].isNull() | F.coalesce(test, F.lit(False)))
    passed = conditions[0]
    for condition in conditions[1:]:
        passed = passed & condition
    return passed


def discover_one(movies: DataFrame, intent: Column, limit: int = 10) -> DataFrame:
    """One request: a filter and a top-k, all in the JVM; no filters give no rows."""
    scored = movies.withColumn("score", metadata_score(movies, DISCOVERY_WEIGHTS))
    return best_by_score(scored.filter(has_filters(intent) & matches(intent)), "score", limit)


def _kernel(k: int):
    """First k movies that pass; the score does not depend on the request, so one sort serves all."""

    def kernel(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        items = _ORDER.sorted(items)
        arrays = {c: pa.array(items[c], type=pa.string()) for cs in _SEARCHED.values() for c in cs}
        hits: dict[tuple[str, str], np.ndarray] = {}

        def holds(column: str, term: str) -> np.ndarray:
            if (column, term) not in hits:
                hits[column, term] = pc.match_substring(arrays[column], term).to_numpy(zero_copy_only=False)
            return hits[column, term]

        numbers = {c: items[c].to_numpy(dtype=float) for c in ("vote_average", "release_year", "runtime")}
        languages = items["original_language"]
        shown = items[list(_ORDER.columns)]
        parts = []
        for q in queries.itertuples(index=False):
            mask = np.ones(len(items), dtype=bool)
            for field, columns in _SEARCHED.items():
                terms = getattr(q, field)
                if len(terms):
                    mask &= np.logical_or.reduce([holds(c, t) for t in terms for c in columns])
            if q.has_languages:
                mask &= languages.isin(list(q.languages)).to_numpy()
            for field, (c, sign) in _BOUNDS.items():
                bound = getattr(q, field)
                if not np.isnan(bound):
                    mask &= numbers[c] >= bound if sign == ">=" else numbers[c] <= bound
            place = np.flatnonzero(mask)[:k]
            parts.append(shown.iloc[place].assign(query_id=q.query_id))
        return pd.concat(parts, ignore_index=True)[_COLUMNS]

    return kernel


def _asked(requests: DataFrame) -> DataFrame:
    """The requests that have a filter, with their terms and bounds."""
    intent = F.col("intent")
    return requests.filter(has_filters(intent)).select(
        F.col("query_id").cast("bigint"),
        *(_terms(intent, f).alias(f) for f in _SEARCHED),
        (F.size(intent["original_languages"]) > 0).alias("has_languages"),
        F.transform(
            F.filter(intent["original_languages"], lambda x: F.trim(x) != ""), language_code
        ).alias("languages"),
        *(intent[f].cast("double").alias(f) for f in BOUND_FIELDS),
    )


def _rated(movies: DataFrame) -> DataFrame:
    """What a request looks at, and the score, which no request changes."""
    return movies.select(
        F.col("id").cast("bigint"),
        metadata_score(movies, DISCOVERY_WEIGHTS).alias("score"),
        F.col("vote_count").cast("double").alias("vote_count"),
        *(F.col(c).cast("double").alias(c) for c in ("vote_average", "release_year", "runtime")),
        F.lower(text("original_language")).alias("original_language"),
        *(F.lower(text(c)).alias(c) for cs in _SEARCHED.values() for c in cs),
    )


def _answered(found: DataFrame, requests: DataFrame) -> DataFrame:
    reasons = requests.select(F.col("query_id").cast("bigint"), filter_reason(F.col("intent")).alias("reason"))
    return found.join(reasons, "query_id").select(
        "query_id", "rank", "id", half_even("score", 4).alias("score"), "reason"
    )


def discover(
    requests: DataFrame, movies: DataFrame, limit: int = 10, sizes: BlockSizes = BlockSizes()
) -> DataFrame:
    """The best movies of every request by rating, votes, popularity and quality.

    ``requests``: query_id, intent. Requests without any filter have no result.
    Returns query_id, rank, id, score (four digits) and reason.
    """
    found = best_matches(_asked(requests), _rated(movies), _kernel(limit), _SCHEMA, _ORDER, limit, sizes=sizes)
    return _answered(found, requests)


@dataclass(frozen=True)
class ScoreOrder:
    """Movies written in the order of their discovery score, for searches that end early.

    A request takes the first movies in that order that pass its filters. The search goes through the order in
    ranges that grow by ``GROWTH``; a request leaves as soon as it has all its results, as nothing further down can
    displace them, and the search ends with the last open request. A range is a filter on the written place, so what
    lies below is never read; there are log(movies) ranges at most.
    """

    movies: DataFrame
    size: int

    @staticmethod
    def build(movies: DataFrame, path: str) -> ScoreOrder:
        placed = with_places(_rated(movies), _ORDER.spark())
        placed.repartitionByRange("place").sortWithinPartitions("place").write.mode("overwrite").parquet(path)
        return ScoreOrder.open(movies.sparkSession, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> ScoreOrder:
        written = spark.read.parquet(path)
        return ScoreOrder(written, written.count())

    def discover(self, requests: DataFrame, limit: int = 10, first: int = FIRST, sizes: BlockSizes = BlockSizes()) -> DataFrame:
        """What :func:`discover` gives for all movies."""
        found = self.ranges(requests, limit, first, sizes)
        if not found:
            return _answered(self.movies.limit(0).select(*_COLUMNS[1:], F.lit(0).cast("bigint").alias("query_id"), F.lit(0).alias("rank")), requests)
        best = top_per_key(union_all(found), ["query_id"], _ORDER.spark(), limit, "rank")
        return _answered(best, requests)

    def ranges(self, requests: DataFrame, limit: int, first: int = FIRST, sizes: BlockSizes = BlockSizes()) -> list[DataFrame]:
        """The results of each range that had to be read, in order; written tables."""
        open_, found = cut_lineage(_asked(requests)), []
        low, high = 0, first
        while low < self.size and not open_.isEmpty():
            items = self.movies.filter((F.col("place") >= low) & (F.col("place") < high)).drop("place")
            found.append(cut_lineage(best_matches(open_, items, _kernel(limit), _SCHEMA, _ORDER, limit, sizes=sizes).drop("rank")))
            full = union_all(found).groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= limit)
            open_ = cut_lineage(open_.join(full.select("query_id"), "query_id", "left_anti"))
            low, high = high, high * GROWTH
        return found
