"""Recommendation runs over a query table, their comparison and their summaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marquee.functions.columns import FEW, is_few, mean, never_broadcast, rows_of, union_all
from marquee.functions.strings import jaccard
from marquee.operators.blocks import BlockSizes
from marquee.operators.dedupe import ranked
from marquee.operators.ranking import (
    CANDIDATE_POOL,
    NOTEBOOK_WEIGHTS,
    SERVICE_WEIGHTS,
    Weights,
    linear_norms,
    log_norms,
    own_score,
    rerank,
)
from marquee.operators.retrieval import DENSE_SIZES, nearest_dense, nearest_sparse
from marquee.operators.titles import resolve_first, resolve_popular
from marquee.session import cut_lineage

OVERALL = "__overall__"
_SHOWN = ["id", "title", "release_year", "genres_text", "vote_average", "vote_count", "popularity", "recommendation_quality_score"]


def resolved_sources(queries: DataFrame, movies: DataFrame) -> DataFrame:
    """query_id, source_id and the source's title, year and genres; unmatched queries drop out. Written: several steps read it."""
    found = cut_lineage(resolve_first(queries, movies).select("query_id", F.col("id").alias("source_id")))
    shown = movies.select(
        F.col("id").alias("source_id"),
        F.col("title").alias("source_title"),
        F.col("release_year").alias("source_release_year"),
        F.col("genres_text").alias("source_genres"),
    )
    return cut_lineage(rows_of(found, shown, "source_id", is_few(found)))


def with_payload(pairs: DataFrame, movies: DataFrame, few: bool = False) -> DataFrame:
    """Retrieved pairs, ``few`` or many, with the metadata of the recommended movie."""
    return rows_of(pairs.drop("vote_count"), movies.select(*_SHOWN), "id", few)


def evaluate_dense(
    queries: DataFrame,
    movies: DataFrame,
    vectors: DataFrame,
    k: int = 10,
    pool: int = CANDIDATE_POOL,
    weights: Weights = SERVICE_WEIGHTS,
    sizes: BlockSizes = DENSE_SIZES,
    search: Callable[[DataFrame, int], DataFrame] | None = None,
) -> DataFrame:
    """Top k per query: cosine pool, hybrid re-rank, every score and both ranks.

    ``search`` asks an index of the movies' vectors instead of all of them.
    """
    sources = resolved_sources(queries, movies)
    own = vectors.withColumnRenamed("id", "source_id")
    asked = rows_of(sources.select("query_id", "source_id"), own, "source_id", is_few(sources)).select("query_id", "source_id", "vector")
    found = search(asked, pool) if search else nearest_dense(asked, vectors.join(never_broadcast(movies.select("id")), "id"), pool, sizes=sizes)
    pairs = with_payload(found, movies, is_few(sources, FEW // pool))
    top = rerank(pairs, linear_norms(movies), weights, k)
    return (
        top.join(sources, "query_id")
        .withColumn("genre_overlap", jaccard("source_genres", "genres_text"))
        .withColumn("rank", F.col("hybrid_rank"))
    )


def evaluate_sparse(
    queries: DataFrame,
    movies: DataFrame,
    features: DataFrame,
    model_name: str,
    k: int = 10,
    sizes: BlockSizes = BlockSizes(),
) -> DataFrame:
    """Top k per query by sparse cosine, ties to more votes.

    ``features``: id, indices, values, vote_count.
    """
    sources = resolved_sources(queries, movies)
    own = features.select(F.col("id").alias("source_id"), "indices", "values")
    asked = rows_of(sources.select("query_id", "source_id"), own, "source_id", is_few(sources))
    pairs = with_payload(nearest_sparse(asked, features, k, sizes=sizes), movies, is_few(sources, FEW // k))
    rows = pairs.join(sources, "query_id").withColumn("genre_overlap", jaccard("source_genres", "genres_text"))
    return model_rows(rows, model_name, F.col("retrieval_rank"), F.col("similarity_score"))


def model_rows(rows: DataFrame, model_name: str, rank: Column, score: Column) -> DataFrame:
    """The common shape of the results that models are compared on."""
    return rows.select(
        F.lit(model_name).alias("model"),
        "query_id",
        "source_id", "source_title", "source_release_year", "source_genres",
        rank.alias("rank"),
        F.col("id").alias("recommended_id"),
        F.col("title").alias("recommended_title"),
        F.col("release_year").alias("recommended_release_year"),
        F.col("genres_text").alias("recommended_genres"),
        "vote_average", "vote_count", "popularity",
        score.alias("score"),
        "genre_overlap",
    )


def compare_models(*results: DataFrame) -> DataFrame:
    return union_all(results)


def model_summary(examples: DataFrame) -> DataFrame:
    """Per model: results and rounded means, best overlap first."""
    return (
        examples.groupBy("model")
        .agg(
            F.count("recommended_id").alias("recommendation_count"),
            mean("score").alias("avg_score"),
            mean("genre_overlap").alias("avg_genre_overlap"),
            mean("vote_average").alias("avg_vote_average"),
            mean("vote_count").alias("avg_vote_count"),
        )
        .orderBy(F.desc("avg_genre_overlap"), F.desc("avg_score"), "model")
    )


def query_summary(examples: DataFrame, query: str = "query") -> DataFrame:
    """Per query and over all results, in one rollup."""
    return (
        examples.rollup(query)
        .agg(
            F.grouping(query).alias("_all"),
            F.count("id").alias("recommendation_count"),
            mean("similarity_score").alias("avg_similarity_score"),
            mean("hybrid_score").alias("avg_hybrid_score"),
            mean("genre_overlap").alias("avg_genre_overlap"),
            mean("vote_average").alias("avg_vote_average"),
            mean("vote_count").alias("avg_vote_count"),
        )
        .withColumn(query, F.when(F.col("_all") == 1, OVERALL).otherwise(F.col(query).cast("string")))
        .drop("_all")
    )


def grid_metrics(examples: DataFrame, models: Sequence[str], queries: DataFrame) -> DataFrame:
    """Metrics of every (model, query) pair; pairs without results are zero."""
    means = ["score", "vote_average", "vote_count", "popularity"]
    found = examples.groupBy("model", "query_id").agg(
        F.count("*").alias("recommendation_count"), *(mean(c).alias(f"avg_{c}") for c in means)
    )
    names = F.array(*(F.lit(m) for m in models))
    grid = queries.select("query_id", F.explode(names).alias("model"))
    return grid.join(found, ["model", "query_id"], "left").na.fill(0)


COUNT_MODEL, TFIDF_MODEL, HYBRID_MODEL = "CountVectorizer + Cosine", "TF-IDF + Cosine", "Hybrid Recommendation"


def notebook_examples(
    queries: DataFrame, movies: DataFrame, counts: DataFrame, tfidf: DataFrame, k: int = 10, sizes: BlockSizes = BlockSizes()
) -> DataFrame:
    """Top k of three models for the most popular movie of each title: two by cosine, one by the hybrid score over all movies.

    ``counts`` and ``tfidf``: id, indices, values, vote_count.
    """
    sources = cut_lineage(resolve_popular(queries, movies).select("query_id", F.col("id").alias("source_id")))
    shown = movies.select("id", "vote_average", "vote_count", "popularity")
    few, few_pairs = is_few(sources), is_few(sources, FEW // k)

    def found(model: str, features: DataFrame, score: str, **how) -> DataFrame:
        own = features.select(F.col("id").alias("source_id"), "indices", "values")
        pairs = nearest_sparse(rows_of(sources, own, "source_id", few), features, k, sizes=sizes, **how)
        return rows_of(pairs.drop("vote_count"), shown, "id", few_pairs).select(
            F.lit(model).alias("model"), "query_id", "id", F.col(score).alias("score"), "vote_average", "vote_count", "popularity"
        )

    rated = tfidf.drop("vote_count").join(never_broadcast(movies), "id")
    hybrid = {"weight": NOTEBOOK_WEIGHTS.similarity, "own": own_score(log_norms(movies), NOTEBOOK_WEIGHTS)}
    return union_all(
        [
            found(COUNT_MODEL, counts, "similarity_score"),
            found(TFIDF_MODEL, tfidf, "similarity_score"),
            found(HYBRID_MODEL, rated, "hybrid_score", **hybrid),
        ]
    )


def ranks_before_and_after(scored: DataFrame, query_key: str = "query_id") -> DataFrame:
    """Rank by similarity, and rank by the hybrid score, of every candidate."""
    first = ranked(scored, [query_key], [F.round("similarity_score", 9).desc(), F.asc("id")], "retrieval_rank")
    return ranked(
        first,
        [query_key],
        [F.round("hybrid_score", 9).desc(), F.round("similarity_score", 9).desc(), F.asc("id")],
        "hybrid_rank",
    )
