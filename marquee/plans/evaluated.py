"""Evaluation runs and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions.columns import mean, never_broadcast
from marquee.operators import evaluation as ev
from marquee.operators.ranking import SERVICE_WEIGHTS, linear_norms, with_hybrid_score
from marquee.operators.retrieval import nearest_dense
from marquee.plans.ranked import MAXIMA_SQL, _UNIT_SQL, _all_queries
from marquee.plans.registry import query
from marquee.plans.served import TITLE_QUERIES_SQL, movies, title_queries, vectors
from marquee.plans.storage import stored
from marquee.plans.testbed import prepared_sql
from marquee.plans.texts import COUNT_WEIGHT, TFIDF_WEIGHT, _MOVIE_TERMS_SQL, sparse_features

_SOURCES_SQL = """
sources AS (SELECT query_id, query, id AS source_id, genres_text AS source_genres FROM (SELECT q.query_id, q.query, f.*, row_number() OVER (
    PARTITION BY q.query_id ORDER BY CAST(lower(f.title) <> lower(q.query) AS INTEGER), f.title, f.release_year NULLS LAST, f.id) AS rn
  FROM title_queries q JOIN final f ON contains(lower(f.title), lower(q.query))) WHERE rn = 1)
"""
_OVERLAP = """CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE
  ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END"""


def _words(c):
    return f"list_distinct(list_filter(string_split(lower({c}), ' '), lambda w: w <> ''))"


_EXAMPLES_SQL = f"""
pool AS (SELECT s.*, f.*, list_cosine_similarity(q.vector, i.vector) AS similarity_score
  FROM sources s JOIN vectors q ON q.id = s.source_id JOIN vectors i ON i.id <> s.source_id JOIN final f ON f.id = i.id),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity_score, 6) DESC, id)
  AS retrieval_rank FROM pool) WHERE retrieval_rank <= 50),
scores AS (SELECT *, 0.7::DOUBLE * similarity_score + 0.1::DOUBLE * (vote_average / a) + 0.08::DOUBLE * (vote_count / b)
    + 0.07::DOUBLE * (popularity / c) + 0.05::DOUBLE * (recommendation_quality_score / d) AS hybrid_score FROM first, maxima),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(hybrid_score, 9) DESC, round(similarity_score, 9) DESC, vote_count DESC, id)
  AS hybrid_rank FROM scores),
examples AS (SELECT * EXCLUDE (a, b), {_OVERLAP} AS genre_overlap FROM (
  SELECT * EXCLUDE (a, b, c, d), {_words('source_genres')} AS a, {_words('genres_text')} AS b FROM placed WHERE hybrid_rank <= 10))
"""
_PARTS = (TITLE_QUERIES_SQL, _SOURCES_SQL, _UNIT_SQL, MAXIMA_SQL, _EXAMPLES_SQL)


def _examples(spark, sf):
    return ev.evaluate_dense(title_queries(spark, sf), movies(spark, sf), vectors(spark, sf))


@query(
    "m21_evaluation_run",
    prepared_sql(
        """SELECT query_id, source_id, id AS recommended_id, CAST(retrieval_rank AS INTEGER) AS retrieval_rank,
        CAST(hybrid_rank AS INTEGER) AS hybrid_rank, round(similarity_score, 6) AS similarity_score,
        round(hybrid_score, 6) AS hybrid_score, round(genre_overlap, 6) AS genre_overlap FROM examples""",
        *_PARTS,
    ),
)
def m21(spark, sf):
    return _examples(spark, sf).select(
        "query_id", "source_id", F.col("id").alias("recommended_id"), "retrieval_rank", "hybrid_rank",
        *(F.round(c, 6).alias(c) for c in ("similarity_score", "hybrid_score", "genre_overlap")),
    )


_QUERY_MEANS = """count(*) AS recommendation_count, round(avg(similarity_score), 4) AS avg_similarity_score,
  round(avg(hybrid_score), 4) AS avg_hybrid_score, round(avg(genre_overlap), 4) AS avg_genre_overlap,
  round(avg(vote_average), 4) AS avg_vote_average, round(avg(vote_count), 4) AS avg_vote_count"""


@query(
    "g20_query_summary",
    prepared_sql(
        f"""SELECT query_id::VARCHAR AS query, {_QUERY_MEANS} FROM examples GROUP BY 1
        UNION ALL SELECT '__overall__', {_QUERY_MEANS} FROM examples""",
        *_PARTS,
    ),
)
def g20(spark, sf):
    return ev.query_summary(_examples(spark, sf).withColumnRenamed("query_id", "query"))


@query(
    "w6_ranks_before_and_after",
    prepared_sql(
        """SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(similarity_score, 9) DESC, id) AS INTEGER) AS retrieval_rank,
        CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(hybrid_score, 9) DESC, round(similarity_score, 9) DESC, id) AS INTEGER) AS hybrid_rank
        FROM (SELECT q.id AS query_id, f.id, similarity_score, retrieval_rank, 0.7::DOUBLE * similarity_score
            + 0.1::DOUBLE * (vote_average / a) + 0.08::DOUBLE * (vote_count / b) + 0.07::DOUBLE * (popularity / c)
            + 0.05::DOUBLE * (recommendation_quality_score / d) AS hybrid_score
          FROM (SELECT q.id AS qid, i.id AS iid, list_cosine_similarity(q.vector, i.vector) AS similarity_score,
            row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.vector, i.vector), 6) DESC, i.id) AS retrieval_rank
            FROM vectors q JOIN vectors i ON i.id <> q.id WHERE i.id IN (SELECT id FROM final))
          JOIN vectors q ON q.id = qid JOIN final f ON f.id = iid, maxima WHERE retrieval_rank <= 20)""",
        _UNIT_SQL,
        MAXIMA_SQL,
    ),
)
def w6(spark, sf):
    shown = movies(spark, sf)
    indexed = vectors(spark, sf).join(never_broadcast(shown.select("id")), "id")
    pairs = nearest_dense(_all_queries(spark, sf), indexed, 20).drop("vote_count", "retrieval_rank")
    scored = with_hybrid_score(pairs.join(never_broadcast(shown), "id"), linear_norms(shown), SERVICE_WEIGHTS)
    return ev.ranks_before_and_after(scored).select("query_id", "id", "retrieval_rank", "hybrid_rank")


def _sparse_examples_sql(name, weight, label):
    return (
        _MOVIE_TERMS_SQL.format(weight=weight)
        .replace("sources AS (SELECT query_id, id AS source_id FROM", "plain_sources AS (SELECT query_id, id AS source_id FROM")
        .replace("words AS", f"{name}_words AS").replace("FROM words", f"FROM {name}_words")
        .replace("counts AS", f"{name}_counts AS").replace("FROM counts", f"FROM {name}_counts")
        .replace("frequency AS", f"{name}_frequency AS").replace("FROM frequency", f"FROM {name}_frequency")
        .replace("vocabulary AS", f"{name}_vocabulary AS").replace("JOIN vocabulary", f"JOIN {name}_vocabulary")
        .replace("weighted AS (", f"{name}_weighted AS (").replace("FROM weighted", f"FROM {name}_weighted")
        .replace("JOIN weighted", f"JOIN {name}_weighted")
        .replace("norms AS", f"{name}_norms AS").replace("JOIN norms", f"JOIN {name}_norms")
        .replace("plain_sources AS", f"{name}_sources AS").replace("FROM sources", f"FROM {name}_sources")
        .replace("dots AS", f"{name}_dots AS").replace("FROM dots", f"FROM {name}_dots")
        .replace("ranked AS", f"{name}_ranked AS").strip()
        + f""",
{name}_examples AS (SELECT * EXCLUDE (a, b), {_OVERLAP} AS genre_overlap FROM (SELECT '{label}' AS model, query_id, f.id,
  r.raw AS score, f.vote_average, f.vote_count, f.popularity, {_words('s.genres_text')} AS a, {_words('f.genres_text')} AS b
  FROM {name}_ranked r JOIN final f ON f.id = r.id JOIN final s ON s.id = r.source_id WHERE rn <= 10))
"""
    )


COUNT_MODEL = "CountVectorizer + Cosine"
TFIDF_MODEL = "TF-IDF + Cosine"
DENSE_MODEL = "Word2Vec + Cosine"

_COMPARED_SQL = (
    *_PARTS,
    _sparse_examples_sql("cv", COUNT_WEIGHT, COUNT_MODEL),
    _sparse_examples_sql("ti", TFIDF_WEIGHT, TFIDF_MODEL),
    f"""compared AS (SELECT model, query_id, id, score, vote_average, vote_count, popularity, genre_overlap FROM cv_examples
  UNION ALL SELECT model, query_id, id, score, vote_average, vote_count, popularity, genre_overlap FROM ti_examples
  UNION ALL SELECT '{DENSE_MODEL}', query_id, id, similarity_score, vote_average, vote_count, popularity, genre_overlap FROM examples)""",
)


def _compared(spark, sf):
    """Results of the three models, written once: they are read by several reports."""

    def build():
        queries, shown = title_queries(spark, sf), movies(spark, sf)
        dense = ev.model_rows(_examples(spark, sf), DENSE_MODEL, F.col("hybrid_rank"), F.col("similarity_score"))
        return ev.compare_models(
            ev.evaluate_sparse(queries, shown, sparse_features(spark, sf, "counts"), COUNT_MODEL),
            ev.evaluate_sparse(queries, shown, sparse_features(spark, sf, "tfidf"), TFIDF_MODEL),
            dense,
        )

    return stored(spark, sf, "compared", build)


@query(
    "m22_model_comparison",
    prepared_sql(
        """SELECT model, query_id, id AS recommended_id, round(score, 6) AS score, round(genre_overlap, 6) AS genre_overlap
        FROM compared""",
        *_COMPARED_SQL,
    ),
)
def m22(spark, sf):
    return _compared(spark, sf).select(
        "model", "query_id", "recommended_id", F.round("score", 6).alias("score"),
        F.round("genre_overlap", 6).alias("genre_overlap"),
    )


@query(
    "g19_model_summary",
    prepared_sql(
        """SELECT model, count(*) AS recommendation_count, round(avg(score), 4) AS avg_score,
        round(avg(genre_overlap), 4) AS avg_genre_overlap, round(avg(vote_average), 4) AS avg_vote_average,
        round(avg(vote_count), 4) AS avg_vote_count FROM compared GROUP BY 1""",
        *_COMPARED_SQL,
    ),
)
def g19(spark, sf):
    return ev.model_summary(_compared(spark, sf))


@query(
    "g21_model_query_grid",
    prepared_sql(
        f"""SELECT m.model, q.query_id, coalesce(n, 0) AS recommendation_count, coalesce(s, 0) AS avg_score,
        coalesce(r, 0) AS avg_vote_average, coalesce(v, 0) AS avg_vote_count, coalesce(p, 0) AS avg_popularity
        FROM (VALUES ('{COUNT_MODEL}'), ('{TFIDF_MODEL}'), ('{DENSE_MODEL}'), ('no such model')) m(model), title_queries q
        LEFT JOIN (SELECT model, query_id, count(*) AS n, round(avg(score), 4) AS s, round(avg(vote_average), 4) AS r,
          round(avg(vote_count), 4) AS v, round(avg(popularity), 4) AS p FROM compared GROUP BY 1, 2) g ON g.model = m.model AND g.query_id = q.query_id""",
        *_COMPARED_SQL,
    ),
)
def g21(spark, sf):
    models = [COUNT_MODEL, TFIDF_MODEL, DENSE_MODEL, "no such model"]
    return ev.grid_metrics(_compared(spark, sf), models, title_queries(spark, sf))


@query(
    "m23_cluster_comparison",
    prepared_sql(
        """SELECT q.label AS cluster_id, count(*) AS pairs, round(avg(similarity_score), 4) AS avg_similarity
        FROM (SELECT query_id, id, similarity_score FROM (SELECT q.id AS query_id, i.id,
            list_cosine_similarity(q.vector, i.vector) AS similarity_score,
            row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.vector, i.vector), 6) DESC, i.id) AS rn
            FROM vectors q JOIN vectors i ON q.cluster_id = i.cluster_id AND q.id <> i.id) WHERE rn <= 10)
        JOIN embeddings q ON q.vec_id = query_id GROUP BY 1""",
        _UNIT_SQL,
    ),
)
def m23(spark, sf):
    """Same-cluster neighbours of every vector, compared cluster by cluster."""
    found = nearest_dense(_all_queries(spark, sf), vectors(spark, sf), 10, within=["cluster_id"])
    clusters = vectors(spark, sf).select(F.col("id").alias("query_id"), "cluster_id")
    return found.join(never_broadcast(clusters), "query_id").groupBy("cluster_id").agg(
        F.count("*").alias("pairs"), mean("similarity_score").alias("avg_similarity")
    )
