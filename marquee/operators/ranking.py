"""Normalisation maxima and the weighted scores built on them.

Maxima enter as scalar subqueries: computed once, never collected, no join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from marquee.functions.columns import half_even
from marquee.operators.dedupe import top_per_key


@dataclass(frozen=True)
class Weights:
    similarity: float
    rating: float
    votes: float
    popularity: float
    quality: float


# Weights of the hybrid score and of the two ranking scores.
SERVICE_WEIGHTS = Weights(0.70, 0.10, 0.08, 0.07, 0.05)
NOTEBOOK_WEIGHTS = Weights(0.70, 0.10, 0.10, 0.05, 0.05)
PLAN_WEIGHTS = Weights(0.65, 0.10, 0.10, 0.10, 0.05)
CATALOGUE_WEIGHTS = Weights(0.0, 0.40, 0.25, 0.20, 0.15)
DISCOVERY_WEIGHTS = Weights(0.0, 0.40, 0.25, 0.15, 0.20)
CATALOGUE_REASON = "Film populer dengan rating, vote count, dan kualitas metadata tinggi."
SIMILARITY_REASON = "Mirip berdasarkan metadata film dan diperkuat oleh kualitas/rating."
# Fixed value: movies fetched before the re-rank.
CANDIDATE_POOL = 50

_MEASURES = {
    "vote_average": "max_vote_average",
    "vote_count": "max_vote_count",
    "popularity": "max_popularity",
    "recommendation_quality_score": "max_quality",
}


def _value(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def linear_maxima(movies: DataFrame) -> DataFrame:
    """Plain maxima, at least 1."""
    return movies.agg(
        *(F.greatest(F.max(_value(c)), F.lit(1.0)).alias(n) for c, n in _MEASURES.items())
    )


def log_maxima(movies: DataFrame) -> DataFrame:
    """Maxima of the logs (and of quality); 0 and NULL become 1."""
    values = {
        "max_log_vote_count": F.log1p(_value("vote_count")),
        "max_log_popularity": F.log1p(_value("popularity")),
        "max_quality_score": _value("recommendation_quality_score"),
    }
    return movies.agg(
        *(F.coalesce(F.nullif(F.max(v), F.lit(0.0)), F.lit(1.0)).alias(n) for n, v in values.items())
    )


def linear_norms(movies: DataFrame) -> dict[str, Column]:
    """Shares of the maxima of ``movies``, as columns for any frame with the measures."""
    top = linear_maxima(movies)
    names = ["rating_norm", "vote_count_norm", "popularity_norm", "quality_norm"]
    return {
        n: _value(c) / top.select(m).scalar() for n, (c, m) in zip(names, _MEASURES.items())
    }


def log_norms(movies: DataFrame) -> dict[str, Column]:
    """Rating out of ten, votes and popularity as shares of the log maxima."""
    top = log_maxima(movies)
    return {
        "rating_norm": _value("vote_average") / 10.0,
        "vote_count_norm": F.log1p(_value("vote_count")) / top.select("max_log_vote_count").scalar(),
        "popularity_norm": F.log1p(_value("popularity")) / top.select("max_log_popularity").scalar(),
        "quality_norm": _value("recommendation_quality_score") / top.select("max_quality_score").scalar(),
    }


def with_hybrid_score(pairs: DataFrame, norms: dict[str, Column], weights: Weights) -> DataFrame:
    """Add the four norms and the weighted sum with ``similarity_score``."""
    score = (
        weights.similarity * F.col("similarity_score")
        + weights.rating * F.col("rating_norm")
        + weights.votes * F.col("vote_count_norm")
        + weights.popularity * F.col("popularity_norm")
        + weights.quality * F.col("quality_norm")
    )
    return pairs.withColumns(norms).withColumn("hybrid_score", score)


def own_score(norms: dict[str, Column], weights: Weights) -> Column:
    """The part of the hybrid score that does not depend on the query."""
    return (
        weights.rating * norms["rating_norm"]
        + weights.votes * norms["vote_count_norm"]
        + weights.popularity * norms["popularity_norm"]
        + weights.quality * norms["quality_norm"]
    )


def rerank(
    pairs: DataFrame,
    norms: dict[str, Column],
    weights: Weights = SERVICE_WEIGHTS,
    k: int = 10,
    query_key: str = "query_id",
    rounded: bool = False,
) -> DataFrame:
    """Cut each query's candidates to the k best by hybrid score.

    ``rounded`` ranks by the scores after rounding to four digits, half to even,
    and keeps the retrieval order on ties; otherwise ties go to more votes.
    Scores are compared to nine digits, which hides the noise of their sums.
    """
    scored = with_hybrid_score(pairs, norms, weights)
    if rounded:
        scored = scored.withColumns(
            {
                "hybrid_score": half_even("hybrid_score", 4),
                "_retrieved": F.round("similarity_score", 9),
                "similarity_score": half_even("similarity_score", 4),
            }
        )
        order = [F.desc("hybrid_score"), F.desc("similarity_score"), F.desc("_retrieved"), F.asc("id")]
    else:
        order = [
            F.round("hybrid_score", 9).desc(), F.round("similarity_score", 9).desc(),
            F.col("vote_count").desc_nulls_last(), F.asc("id"),
        ]
    return top_per_key(scored, [query_key], order, k, "hybrid_rank").drop("_retrieved")


def metadata_score(movies: DataFrame, weights: Weights) -> Column:
    """Score of a movie without any query, clipped to [0, 1]."""
    top = linear_maxima(movies)

    def share(c: str, log: bool) -> Column:
        limit = top.select(_MEASURES[c]).scalar()
        return F.log1p(_value(c)) / F.log1p(limit) if log else _value(c) / limit

    score = (
        weights.rating * share("vote_average", False)
        + weights.votes * share("vote_count", True)
        + weights.popularity * share("popularity", True)
        + weights.quality * share("recommendation_quality_score", False)
    )
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def best_by_score(scored: DataFrame, score: str, n: int) -> DataFrame:
    order = [F.desc(score), F.col("vote_count").desc_nulls_last(), F.col("vote_average").desc_nulls_last()]
    return scored.orderBy(*order, F.asc("id")).limit(n)


def catalogue_ranking(movies: DataFrame, n: int = 12) -> DataFrame:
    """The n best movies by rating, votes, popularity and metadata quality."""
    scored = movies.withColumn("_score", metadata_score(movies, CATALOGUE_WEIGHTS))
    return best_by_score(scored, "_score", n).select(
        *movies.columns,
        F.lit(0.0).alias("similarity_score"),
        half_even("_score", 4).alias("hybrid_score"),
        F.lit(CATALOGUE_REASON).alias("reason"),
        F.lit("discovery").alias("score_type"),
    )


def service_columns(movies: DataFrame) -> DataFrame:
    """Rows the service loads: an id, a title, numbers without NULL."""
    zero = ["vote_average", "vote_count", "popularity", "recommendation_quality_score"]
    return movies.dropna(subset=["id", "title"]).withColumns({c: _value(c) for c in zero})


SUMMARY = {
    "id": "id", "title": "title", "release_year": "release_year", "genres": "genres_text",
    "original_language": "original_language", "runtime": "runtime", "director": "director_clean",
    "cast": "top_cast_text", "keywords": "keywords_text", "vote_average": "vote_average",
    "overview": "overview_clean", "poster_path": "poster_path", "backdrop_path": "backdrop_path",
}


def movie_summary(movies: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The thirteen fields a listing shows, typed; absent ones are NULL."""
    have = set(movies.columns)
    kinds = {"id": "bigint", "release_year": "int", "runtime": "int", "vote_average": "double"}
    return movies.select(
        *(
            (F.col(c) if c in have else F.lit(None)).cast(kinds.get(n, "string")).alias(n)
            for n, c in SUMMARY.items()
        ),
        *extra,
    )
