"""Tokens, bags of words, TF-IDF, vectors, clusters and sparse retrieval."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import functions as F

from marquee.functions.columns import is_few, never_broadcast, rows_of
from marquee.functions.strings import STOP_WORDS, tokens
from marquee.operators import retrieval, text_models as tm
from marquee.operators.features import modelling_base
from marquee.plans.registry import query
from marquee.plans.served import TITLE_QUERIES_SQL, movies, title_queries
from marquee.plans.storage import scratch_folder, stored, stored_folder
from marquee.plans.testbed import prepared_sql, table
from marquee.session import cut_lineage
from marquee.sources.sinks import load_model, save_model

_STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS) + "]"


def _tokens_sql(column, stop=True):
    rule = f"length(w) >= 2 AND NOT list_contains({_STOP_SQL}, w)" if stop else "length(w) >= 2"
    return f"list_filter(string_split_regex(lower({column}), '\\W+'), lambda w: {rule})"


@query(
    "m1_document_tokens",
    f"""SELECT doc_id, len(t) AS n, array_to_string(t, ' ') AS words
    FROM (SELECT doc_id, {_tokens_sql('text', False)} AS t FROM documents)""",
)
def m1(spark, sf):
    split = table(spark, sf, "documents").select("doc_id", tokens("text", stop_words=False).alias("t"))
    return split.select("doc_id", F.size("t").cast("bigint").alias("n"), F.array_join("t", " ").alias("words"))


@query(
    "m2_without_stop_words",
    f"""SELECT doc_id, len(t) AS n, array_to_string(t, ' ') AS words
    FROM (SELECT doc_id, {_tokens_sql('text')} AS t FROM documents)""",
)
def m2(spark, sf):
    split = table(spark, sf, "documents").select("doc_id", tokens("text").alias("t"))
    return split.select("doc_id", F.size("t").cast("bigint").alias("n"), F.array_join("t", " ").alias("words"))


@query(
    "p4_rows_with_tokens",
    f"SELECT doc_id, len(t) AS n FROM (SELECT doc_id, {_tokens_sql('text')} AS t FROM documents) WHERE len(t) > 0",
)
def p4(spark, sf):
    kept = tm.with_tokens(table(spark, sf, "documents"), "text", "t")
    return kept.select("doc_id", F.size("t").cast("bigint").alias("n"))


_COUNTS_SQL = f"""
words AS (SELECT doc_id AS id, unnest({_tokens_sql('text')}) AS term FROM documents),
counts AS (SELECT id, term, count(*) AS tf FROM words GROUP BY 1, 2),
frequency AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM counts GROUP BY 1),
vocabulary AS (SELECT * FROM frequency WHERE df >= {{min_df}} ORDER BY total DESC, term LIMIT {{size}})
"""


def _document_counts(spark, sf):
    documents = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), tokens("text").alias("tokens"))
    return documents, tm.term_counts(documents)


@query(
    "g25_document_frequency",
    "WITH " + _COUNTS_SQL.format(min_df=1, size=1) + " SELECT term, df, total FROM frequency",
)
def g25(spark, sf):
    return tm.document_frequency(_document_counts(spark, sf)[1])


@query(
    "m3_vocabulary",
    "WITH " + _COUNTS_SQL.format(min_df=5, size=20000) + " SELECT term, df, total FROM vocabulary",
)
def m3(spark, sf):
    return tm.vocabulary(_document_counts(spark, sf)[1], *tm.COMPARISON_VOCABULARY)


@query(
    "m3_bag_of_words",
    "WITH " + _COUNTS_SQL.format(min_df=5, size=20000)
    + " SELECT id, term, tf FROM counts JOIN vocabulary USING (term)",
)
def m3_bag(spark, sf):
    """The ML count vectors, unfolded to (id, term, tf)."""
    documents = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("movie_document"))
    words = tm.chosen_words(tm.with_tokens(documents), *tm.COMPARISON_VOCABULARY)
    model = tm.text_pipeline(*tm.COMPARISON_VOCABULARY, idf=False, words=words).fit(documents)
    return _unfolded(model.transform(documents), "counts", model.stages[2].vocabulary, "tf").withColumn(
        "tf", F.col("tf").cast("bigint")
    )


def _unfolded(df, vector, vocabulary, value):
    """Sparse ML vectors as (id, term, value) rows; the vocabulary is bounded by the stage."""
    spark = df.sparkSession
    words = spark.createDataFrame(list(enumerate(vocabulary)), "place int, term string")
    plain = df.select("id", F.unwrap_udt(vector).alias("v"))
    cells = plain.select("id", F.explode(F.arrays_zip("v.indices", "v.values")).alias("c"))
    rows = cells.select("id", F.col("c.indices").alias("place"), F.col("c.values").alias(value))
    return rows.join(F.broadcast(words), "place").select("id", "term", value)


_TFIDF_SQL = "WITH " + _COUNTS_SQL + """ SELECT id, term, tf, round(tf * ln((n + 1.0::DOUBLE) / (df + 1)), 6) AS weight
  FROM counts JOIN vocabulary USING (term), (SELECT count(*) AS n FROM documents)"""


@query("m4_tfidf_weights", _TFIDF_SQL.format(min_df=5, size=20000))
def m4(spark, sf):
    documents, counts = _document_counts(spark, sf)
    weights = tm.tfidf_weights(counts, documents, *tm.COMPARISON_VOCABULARY)
    return weights.withColumn("weight", F.round("weight", 6))


@query(
    "m5_tfidf_stages",
    _TFIDF_SQL.format(min_df=3, size=60000).replace("SELECT id, term, tf, round", "SELECT id, term, round"),
)
def m5(spark, sf):
    documents = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("movie_document"))
    model, features = tm.text_features(documents, *tm.TFIDF_VOCABULARY)
    return _unfolded(features, "tfidf", model.stages[2].vocabulary, "weight").withColumn(
        "weight", F.round("weight", 6)
    )


def base(spark, sf):
    """The modelling base of the served movies, which are one row per id."""
    return modelling_base(movies(spark, sf), one_row=True)


def sparse_features(spark, sf, vector):
    """id, indices and values of the count or TF-IDF vectors of all movies."""

    def build():
        path = f"{scratch_folder(spark)}/counts"
        _, features = tm.text_features(base(spark, sf), *tm.COMPARISON_VOCABULARY, one_row=True, path=path, keep=["id", "vote_count"])
        return features.select("id", "vote_count", *(F.unwrap_udt(c).alias(c) for c in ("counts", "tfidf")))

    both = stored(spark, sf, "features", build)
    return both.select("id", "vote_count", f"{vector}.indices", f"{vector}.values")


_MOVIE_TERMS_SQL = f"""
words AS (SELECT id, unnest({_tokens_sql('movie_document_weighted')}) AS term FROM final),
counts AS (SELECT id, term, count(*) AS tf FROM words GROUP BY 1, 2),
frequency AS (SELECT term, count(*) AS df, sum(tf) AS total FROM counts GROUP BY 1),
vocabulary AS (SELECT * FROM frequency WHERE df >= 5 ORDER BY total DESC, term LIMIT 20000),
weighted AS (SELECT id, term, {{weight}} AS w FROM counts JOIN vocabulary USING (term), (SELECT count(*) AS n FROM final)),
norms AS (SELECT id, sqrt(sum(w * w)) AS size FROM weighted GROUP BY 1),
sources AS (SELECT query_id, id AS source_id FROM (SELECT q.query_id, f.id, row_number() OVER (PARTITION BY q.query_id
    ORDER BY CAST(lower(f.title) <> lower(q.query) AS INTEGER), f.title, f.release_year NULLS LAST, f.id) AS rn
  FROM title_queries q JOIN final f ON contains(lower(f.title), lower(q.query))) WHERE rn = 1),
dots AS (SELECT s.query_id, s.source_id, i.id, sum(q.w * i.w) AS dot FROM sources s JOIN weighted q ON q.id = s.source_id
  JOIN weighted i ON i.term = q.term AND i.id <> s.source_id GROUP BY 1, 2, 3),
ranked AS (SELECT query_id, d.source_id, f.id, dot / (a.size * b.size) AS raw, round(dot / (a.size * b.size), 6) AS similarity_score, row_number() OVER (PARTITION BY query_id
    ORDER BY round(dot / (a.size * b.size), 6) DESC, vote_count DESC, f.id) AS rn
  FROM dots d JOIN norms a ON a.id = source_id JOIN norms b ON b.id = d.id JOIN final f ON f.id = d.id)
"""
COUNT_WEIGHT = "tf::DOUBLE"
TFIDF_WEIGHT = "tf * ln((n + 1.0::DOUBLE) / (df + 1))"


def _sparse_sql(weight):
    return prepared_sql(
        "SELECT query_id, id, CAST(rn AS INTEGER) AS rank, similarity_score FROM ranked WHERE rn <= 10",
        TITLE_QUERIES_SQL,
        _MOVIE_TERMS_SQL.format(weight=weight),
    )


def _sparse_neighbours(spark, sf, vector):
    from marquee.operators.titles import resolve_first

    features = sparse_features(spark, sf, vector)
    sources = cut_lineage(resolve_first(title_queries(spark, sf), movies(spark, sf)).select("query_id", F.col("id").alias("source_id")))
    asked = rows_of(sources, features.withColumnRenamed("id", "source_id"), "source_id", is_few(sources))
    found = retrieval.nearest_sparse(asked.select("query_id", "source_id", "indices", "values"), features, 10)
    return found.select("query_id", "id", F.col("retrieval_rank").alias("rank"), F.round("similarity_score", 6).alias("similarity_score"))


@query("m9_nearest_by_words", _sparse_sql(COUNT_WEIGHT))
def m9(spark, sf):
    return _sparse_neighbours(spark, sf, "counts")


@query("m10_nearest_by_tfidf", _sparse_sql(TFIDF_WEIGHT))
def m10(spark, sf):
    return _sparse_neighbours(spark, sf, "tfidf")


def _hybrid_texts_sql(same_language=False):
    match = "AND i.original_language = a.original_language" if same_language else ""
    return prepared_sql(
        f"""SELECT query_id, id, CAST(rn AS INTEGER) AS rank, round(similarity_score, 6) AS similarity_score,
          round(hybrid_score, 6) AS hybrid_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id
            ORDER BY round(hybrid_score, 6) DESC, round(similarity_score, 6) DESC, vote_count DESC, id) AS rn FROM (
          SELECT s.query_id, i.id, i.vote_count, coalesce(dot / (x.size * y.size), 0) AS similarity_score,
            0.7::DOUBLE * coalesce(dot / (x.size * y.size), 0) + (0.1::DOUBLE * (i.vote_average / 10.0::DOUBLE)
              + 0.1::DOUBLE * (ln(1 + i.vote_count) / b) + 0.05::DOUBLE * (ln(1 + i.popularity) / c)
              + 0.05::DOUBLE * (i.recommendation_quality_score / d)) AS hybrid_score
          FROM popular s JOIN final a ON a.id = s.source_id JOIN final i ON i.id <> s.source_id {match}
          LEFT JOIN hybrid_dots h ON h.query_id = s.query_id AND h.id = i.id LEFT JOIN norms x ON x.id = s.source_id LEFT JOIN norms y ON y.id = i.id, maxima)) WHERE rn <= 10""",
        TITLE_QUERIES_SQL,
        _MOVIE_TERMS_SQL.format(weight=TFIDF_WEIGHT),
        """popular AS (SELECT query_id, id AS source_id FROM (SELECT q.query_id, f.id, row_number() OVER (PARTITION BY q.query_id
            ORDER BY vote_count DESC, popularity DESC, f.id) AS rn
          FROM title_queries q JOIN final f ON contains(lower(f.title), lower(q.query))) WHERE rn = 1)""",
        """hybrid_dots AS (SELECT s.query_id, i.id, sum(q.w * i.w) AS dot FROM popular s JOIN weighted q ON q.id = s.source_id
          JOIN weighted i ON i.term = q.term GROUP BY 1, 2)""",
        """maxima AS (SELECT coalesce(nullif(max(ln(1 + vote_count)), 0), 1.0::DOUBLE) AS b,
          coalesce(nullif(max(ln(1 + popularity)), 0), 1.0::DOUBLE) AS c,
          coalesce(nullif(max(recommendation_quality_score), 0), 1.0::DOUBLE) AS d FROM final)""",
    )


def _hybrid_texts(spark, sf, within):
    """TF-IDF similarity and metadata, ranked over all movies rather than over a pool."""
    from marquee.operators.ranking import NOTEBOOK_WEIGHTS, log_norms, own_score
    from marquee.operators.titles import resolve_popular

    shown = movies(spark, sf)
    features = sparse_features(spark, sf, "tfidf").drop("vote_count").join(never_broadcast(shown), "id")
    sources = cut_lineage(resolve_popular(title_queries(spark, sf), shown).select("query_id", F.col("id").alias("source_id")))
    vectors = features.select(F.col("id").alias("source_id"), "indices", "values", *within)
    found = retrieval.nearest_sparse(
        rows_of(sources, vectors, "source_id", is_few(sources)), features, 10, within=within, weight=NOTEBOOK_WEIGHTS.similarity,
        own=own_score(log_norms(shown), NOTEBOOK_WEIGHTS),
    )
    return found.select(
        "query_id", "id", F.col("retrieval_rank").alias("rank"),
        F.round("similarity_score", 6).alias("similarity_score"), F.round("hybrid_score", 6).alias("hybrid_score"),
    )


@query("m13_hybrid_over_all_movies", _hybrid_texts_sql())
def m13_texts(spark, sf):
    return _hybrid_texts(spark, sf, [])


@query("m16_hybrid_in_same_group", _hybrid_texts_sql(same_language=True))
def m16_texts(spark, sf):
    return _hybrid_texts(spark, sf, ["original_language"])


@query("m6_word2vec_vectors")
def m6(spark, sf):
    """Training is not reproducible across partitions: checked by invariants in the tests."""
    prepared = tm.with_tokens(base(spark, sf)).select("id", "title", "release_year", "genres_text", "tokens")
    model = tm.fit_word2vec(prepared)
    return tm.document_vectors(model, prepared).select(
        "id", "title", "release_year", "genres_text", F.size("vector").alias("vector_size"), "vector"
    )


@query(
    "m7_vectors_as_arrays",
    "SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total, 64 AS size FROM embeddings",
)
def m7(spark, sf):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    as_vector = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("v")
    )
    listed = as_vector.select("id", vector_to_array("v").alias("a"))
    total = F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x), 4)
    return listed.select("id", total.alias("total"), F.size("a").alias("size"))


@query(
    "g23_training_summary",
    prepared_sql(
        """SELECT unnest(['movie_count', 'vector_size', 'min_count', 'max_iter', 'vocabulary_size', 'avg_filtered_token_count']) AS metric,
          unnest([(SELECT count(DISTINCT id) FROM words)::VARCHAR, '64', '5', '5',
            (SELECT count(*) FROM (SELECT term FROM words GROUP BY 1 HAVING count(*) >= 5))::VARCHAR,
            (SELECT round(count(*)::DOUBLE / count(DISTINCT id), 4) FROM words)::VARCHAR]) AS value""",
        f"words AS (SELECT id, unnest({_tokens_sql('movie_document_weighted')}) AS term FROM final)",
    ),
)
def g23(spark, sf):
    prepared = tm.with_tokens(base(spark, sf)).select("id", "tokens")
    model = tm.fit_word2vec(prepared)
    return tm.training_summary(model, prepared, 64, 5, 5)


def clusters(spark, sf):
    """The text model, the fitted clusters and the clustered TF-IDF vectors: fitted once, saved and read back.

    The counts are written; they are weighed when they are read.
    """

    def build(path):
        fitted, features = tm.text_features(base(spark, sf), *tm.TFIDF_VOCABULARY, one_row=True, path=f"{path}/counts")
        save_model(fitted, f"{path}/text")
        save_model(tm.fit_clusters(features.select("id", "tfidf")), f"{path}/clusters")

    path = stored_folder(spark, sf, "clusters", build)
    fitted, model = load_model(PipelineModel, f"{path}/text"), load_model(KMeansModel, f"{path}/clusters")
    weighed = fitted.stages[-1].transform(spark.read.parquet(f"{path}/counts")).select("id", "tfidf")
    return fitted, model, model.transform(weighed)


@query("m17_document_clusters")
def m17(spark, sf):
    """K-Means on TF-IDF: start points depend on the partitions, so no SQL twin; ``m17_cluster_invariants`` has one."""
    return clusters(spark, sf)[2].select("id", "cluster_id")


@query("m18_cluster_silhouette")
def m18(spark, sf):
    return spark.createDataFrame([(20, tm.silhouette(clusters(spark, sf)[2]))], "k int, silhouette double")


@query("m19_cluster_centre_terms")
def m19(spark, sf):
    fitted, model, clustered = clusters(spark, sf)
    return tm.cluster_terms(model, fitted.stages[2].vocabulary, clustered)


@query(
    "m19_group_terms",
    "WITH " + _COUNTS_SQL.format(min_df=5, size=20000) + """,
    weighted AS (SELECT id, term, tf * ln((n + 1.0::DOUBLE) / (df + 1)) AS w FROM counts JOIN vocabulary USING (term),
      (SELECT count(*) AS n FROM documents)),
    sums AS (SELECT lang AS cluster_id, term, round(sum(w), 6) AS weight FROM weighted JOIN documents ON doc_id = id GROUP BY 1, 2),
    tops AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, term) AS rn FROM sums)
    SELECT cluster_id, string_agg(term, ' | ' ORDER BY rn) AS top_terms FROM tops WHERE rn <= 15 GROUP BY 1""",
)
def m19_groups(spark, sf):
    documents, counts = _document_counts(spark, sf)
    weights = tm.tfidf_weights(counts, documents, *tm.COMPARISON_VOCABULARY)
    members = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("cluster_id"))
    return tm.mean_terms(weights, members)


@query(
    "g18_cluster_summary",
    prepared_sql("""SELECT label AS cluster_id, count(*) AS movie_count, round(avg(vote_average), 3) AS avg_vote_average,
      round(avg(vote_count), 3) AS avg_vote_count, round(avg(popularity), 3) AS avg_popularity,
      round(avg(recommendation_quality_score), 3) AS avg_quality_score
      FROM final JOIN embeddings ON vec_id = id GROUP BY 1"""),
)
def g18(spark, sf):
    return tm.cluster_summary(_labelled(spark, sf))


def _labelled(spark, sf):
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster_id"))
    return never_broadcast(movies(spark, sf)).join(labels, "id")


@query(
    "j4_cluster_report",
    prepared_sql(
        """SELECT cluster_id, movie_count, top_terms FROM (SELECT label AS cluster_id, count(*) AS movie_count
          FROM final JOIN embeddings ON vec_id = id GROUP BY 1) LEFT JOIN (
          SELECT cluster_id, string_agg(term, ' | ' ORDER BY rn) AS top_terms FROM (
            SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, term) AS rn FROM (
              SELECT label AS cluster_id, term, round(count(*)::DOUBLE, 6) AS weight FROM words JOIN embeddings ON vec_id = id GROUP BY 1, 2))
          WHERE rn <= 15 GROUP BY 1) USING (cluster_id)""",
        f"words AS (SELECT id, unnest({_tokens_sql('movie_document_weighted')}) AS term FROM final)",
    ),
)
def j4(spark, sf):
    members = _labelled(spark, sf)
    counts = tm.term_counts(tm.with_tokens(base(spark, sf))).withColumnRenamed("tf", "weight")
    summary = tm.cluster_summary(members).select("cluster_id", "movie_count")
    return tm.cluster_report(summary, tm.mean_terms(counts, members.select("id", "cluster_id")))
