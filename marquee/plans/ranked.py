"""Catalogue ranking, title search, discovery, dense retrieval and re-ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions.columns import never_broadcast
from marquee.functions.strings import jaccard
from marquee.functions.vectors import cosine
from marquee.operators import discovery, ranking, requests as rq, retrieval, titles
from marquee.operators.intents import filter_reason, has_filters, request_error
from marquee.plans.registry import query
from marquee.plans.served import (
    FILTER_REQUESTS_SQL,
    TITLE_QUERIES_SQL,
    filter_requests,
    movies,
    title_postings,
    title_queries,
    vectors,
)
from marquee.plans.testbed import prepared_sql, table
from marquee.sources.readers import lookup

MAXIMA_SQL = """
maxima AS (SELECT greatest(max(vote_average), 1.0::DOUBLE) AS a, greatest(max(vote_count)::DOUBLE, 1.0::DOUBLE) AS b,
  greatest(max(popularity), 1.0::DOUBLE) AS c, greatest(max(recommendation_quality_score), 1.0::DOUBLE) AS d FROM final)
"""


def _score_sql(rating, votes, popularity, quality):
    return (
        f"least(greatest({rating}::DOUBLE * (vote_average / a) + {votes}::DOUBLE * (ln(1 + vote_count) / ln(1 + b)) "
        f"+ {popularity}::DOUBLE * (ln(1 + popularity) / ln(1 + c)) "
        f"+ {quality}::DOUBLE * (recommendation_quality_score / d), 0.0::DOUBLE), 1.0::DOUBLE)"
    )


@query(
    "t4_catalogue_ranking",
    prepared_sql(
        f"""SELECT id, title, round(score, 4) AS hybrid_score, 0.0::DOUBLE AS similarity_score, 'discovery' AS score_type,
        '{ranking.CATALOGUE_REASON}' AS reason FROM (SELECT *, {_score_sql(0.40, 0.25, 0.20, 0.15)} AS score
        FROM final, maxima) ORDER BY score DESC, vote_count DESC, vote_average DESC, id LIMIT 50""",
        MAXIMA_SQL,
    ),
)
def t4(spark, sf):
    rows = ranking.catalogue_ranking(movies(spark, sf), 50)
    return rows.select("id", "title", "hybrid_score", "similarity_score", "score_type", "reason")


@query(
    "b31_movie_summary",
    prepared_sql("""SELECT id, title, release_year, genres_text AS genres, original_language,
      CAST(runtime AS INTEGER) AS runtime, director_clean AS director, top_cast_text AS "cast",
      keywords_text AS keywords, vote_average, overview_clean AS overview, poster_path, backdrop_path FROM final"""),
)
def b31(spark, sf):
    return ranking.movie_summary(movies(spark, sf))


_TITLE = "trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"


def _contained_sql(order, limit, select, key="normal", extra=""):
    folded = _TITLE.format(c="title") if key == "normal" else "lower(title)"
    wanted = _TITLE.format(c="query") if key == "normal" else "lower(query)"
    return prepared_sql(
        f"""SELECT {select} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rn
        FROM (SELECT q.query_id, m.*, CAST({folded} <> {wanted} AS INTEGER) AS tier
          FROM title_queries q JOIN final m ON contains({folded}, {wanted}))) WHERE rn <= {limit}""",
        TITLE_QUERIES_SQL,
    )


@query(
    "t6_title_search",
    _contained_sql(
        "vote_count DESC, vote_average DESC, title, id", 10,
        "query_id, CAST(rn AS INTEGER) AS rank, id, title",
    ),
)
def t6(spark, sf):
    return titles.search_titles(title_queries(spark, sf), movies(spark, sf), postings=title_postings(spark, sf)).select(
        "query_id", "rank", "id", "title"
    )


@query(
    "j9_exact_or_contained_title",
    _contained_sql("tier, title, release_year NULLS LAST, id", 1, "query_id, id, title, tier", key="lower"),
)
def j9(spark, sf):
    return titles.resolve_first(title_queries(spark, sf), movies(spark, sf), title_postings(spark, sf, False)).select(
        "query_id", "id", "title", "tier"
    )


@query(
    "j10_popular_title",
    _contained_sql("vote_count DESC, popularity DESC, id", 1, "query_id, id", key="lower"),
)
def j10(spark, sf):
    return titles.resolve_popular(title_queries(spark, sf), movies(spark, sf), title_postings(spark, sf, False)).select("query_id", "id")


@query(
    "j11_title_resolution",
    prepared_sql(
        """SELECT query_id, CASE WHEN equal = 1 OR n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'not_found' END AS status,
          CASE WHEN equal = 1 THEN equal_id WHEN n = 1 THEN first END AS source_id,
          CASE WHEN equal = 1 OR n = 1 THEN '' ELSE ids END AS candidates
        FROM (SELECT query_id, any_value(equal) AS equal, any_value(equal_id) AS equal_id, count(*) AS n,
          min(id) AS first, string_agg(id::VARCHAR, ',' ORDER BY rn) AS ids FROM
          (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vote_count DESC, vote_average DESC, title, id) AS rn,
            count(*) FILTER (WHERE lower(title) = lower(query)) OVER (PARTITION BY query_id) AS equal,
            min(CASE WHEN lower(title) = lower(query) THEN id END) OVER (PARTITION BY query_id) AS equal_id
           FROM (SELECT q.query_id, q.query, m.* FROM title_queries q JOIN final m ON contains(lower(title), lower(query))))
          WHERE rn <= 8 GROUP BY query_id)""",
        TITLE_QUERIES_SQL,
    ),
)
def j11(spark, sf):
    return titles.resolve_with_status(title_queries(spark, sf), movies(spark, sf), title_postings(spark, sf)).select(
        "query_id", "status", "source_id", F.array_join("candidates", ",").alias("candidates")
    )


def misspelt_queries(spark, sf):
    """Part names with letters left out, one query per name."""
    return title_queries(spark, sf).withColumn("query", F.regexp_replace("query", "[ei]", ""))


@query("j8_fuzzy_titles")
def j8(spark, sf):
    """Sequence ratio: no SQL twin, checked by brute force in the tests."""
    found = titles.fuzzy_titles(misspelt_queries(spark, sf), movies(spark, sf))
    return found.select("query_id", "rank", "id", F.round("ratio", 6).alias("ratio"))


@query("j11_fuzzy_title_resolution")
def j11_fuzzy(spark, sf):
    return titles.resolve_with_status(misspelt_queries(spark, sf), movies(spark, sf), title_postings(spark, sf)).select(
        "query_id", "status", "source_id", F.array_join("candidates", ",").alias("candidates")
    )


# -- discovery ---------------------------------------------------------------------------------------

_ANY = "len({f}) = 0 OR len(list_filter({f}, t -> {test})) > 0".replace("t ->", "lambda t:")


def _holds(column):
    return f"contains(lower(coalesce({column}, '')), lower(trim(t)))"


_MATCH_SQL = " AND ".join(
    f"({c})"
    for c in [
        _ANY.format(f="preferred_genres", test=_holds("genres_text")),
        _ANY.format(f="directors", test=_holds("director_clean")),
        _ANY.format(
            f="keywords",
            test=" OR ".join(_holds(c) for c in ("keywords_text", "overview_clean", "tagline_clean")),
        ),
        "len(languages) = 0 OR list_contains(languages, lower(original_language))",
        "min_rating IS NULL OR coalesce(vote_average >= min_rating, FALSE)",
        "max_rating IS NULL OR coalesce(vote_average <= max_rating, FALSE)",
        "release_year_from IS NULL OR coalesce(release_year >= release_year_from, FALSE)",
        "min_runtime IS NULL OR coalesce(runtime >= min_runtime, FALSE)",
        "max_runtime IS NULL OR coalesce(runtime <= max_runtime, FALSE)",
    ]
)


@query(
    "t5_discovery",
    prepared_sql(
        f"""SELECT query_id, id, CAST(rn AS INTEGER) AS rank, round(score, 4) AS score FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vote_count DESC, vote_average DESC, id) AS rn
          FROM (SELECT r.query_id, f.*, {_score_sql(0.40, 0.25, 0.15, 0.20)} AS score
            FROM filter_requests r, maxima, final f WHERE {_MATCH_SQL})) WHERE rn <= 10""",
        MAXIMA_SQL,
        FILTER_REQUESTS_SQL,
    ),
)
def t5(spark, sf):
    return discovery.discover(filter_requests(spark, sf), movies(spark, sf)).drop("reason")


@query(
    "p5_discovery_predicate",
    prepared_sql("""SELECT id, vote_average, release_year FROM final WHERE (contains(genres_text, 'small') OR contains(genres_text, 'red'))
      AND lower(original_language) IN ('en', 'fr') AND vote_average >= 4 AND release_year >= 1980 AND runtime <= 200"""),
)
def p5(spark, sf):
    from marquee.operators.intents import intent_of

    intent = intent_of(
        preferred_genres=F.array(F.lit("Small"), F.lit(" RED ")),
        original_languages=F.array(F.lit("English"), F.lit("French")),
        min_rating=F.lit(4.0),
        release_year_from=F.lit(1980),
        max_runtime=F.lit(200),
    )
    return movies(spark, sf).filter(discovery.matches(intent)).select("id", "vote_average", "release_year")


@query(
    "p9_request_errors",
    prepared_sql(
        """SELECT query_id, len(preferred_genres) + len(directors) + len(keywords) + len(languages) > 0
          OR min_rating IS NOT NULL OR max_rating IS NOT NULL OR release_year_from IS NOT NULL
          OR min_runtime IS NOT NULL OR max_runtime IS NOT NULL AS has_filter,
        CASE WHEN max_runtime < 1 THEN 'runtime_out_of_range'
          WHEN min_runtime > max_runtime THEN 'min_runtime_above_max_runtime' END AS error FROM filter_requests""",
        FILTER_REQUESTS_SQL,
    ),
)
def p9(spark, sf):
    intent = F.col("intent")
    return filter_requests(spark, sf).select(
        "query_id", has_filters(intent).alias("has_filter"), request_error(intent, F.lit(10)).alias("error")
    )


@query(
    "b32_filter_reason",
    prepared_sql(
        """SELECT query_id, 'Sesuai filter ' || concat_ws(', ',
          CASE WHEN len(preferred_genres) > 0 THEN 'genre ' || array_to_string(preferred_genres, ', ') END,
          CASE WHEN len(directors) > 0 THEN 'sutradara ' || array_to_string(directors, ', ') END,
          CASE WHEN len(keywords) > 0 THEN 'tema ' || array_to_string(keywords, ', ') || ',  ' END,
          CASE WHEN len(languages) > 0 THEN 'bahasa English, de' END,
          CASE WHEN min_rating IS NOT NULL THEN 'rating minimal 4.5' END,
          CASE WHEN max_rating IS NOT NULL THEN 'rating maksimal 5.5' END,
          'mulai tahun ' || release_year_from, 'durasi minimal ' || min_runtime || ' menit',
          'durasi maksimal ' || max_runtime || ' menit') || '.' AS reason FROM filter_requests""",
        FILTER_REQUESTS_SQL,
    ),
)
def b32(spark, sf):
    return filter_requests(spark, sf).select("query_id", filter_reason(F.col("intent")).alias("reason"))


# -- dense retrieval ---------------------------------------------------------------------------------

_UNIT_SQL = "vectors AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vector, label AS cluster_id FROM embeddings)"
_PAIRS_SQL = """
pairs AS (SELECT q.id AS query_id, q.cluster_id AS query_cluster, i.id,
  list_cosine_similarity(q.vector, i.vector) AS raw, round(list_cosine_similarity(q.vector, i.vector), 6) AS similarity_score
  FROM vectors q, vectors i WHERE q.id <> i.id)
"""


def _all_queries(spark, sf):
    return vectors(spark, sf).select(F.col("id").alias("query_id"), F.col("id").alias("source_id"), "vector", "cluster_id")


@query(
    "m8_vector_cosine",
    """SELECT a.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
    FROM embeddings a JOIN (SELECT vec_id + 1 AS vec_id, embedding FROM embeddings) b USING (vec_id)""",
)
def m8(spark, sf):
    table_ = vectors(spark, sf).select("id", "vector")
    shifted = table_.select((F.col("id") + 1).alias("id"), F.col("vector").alias("other"))
    return table_.join(shifted, "id").select("id", F.round(cosine("vector", "other"), 6).alias("similarity"))


@query(
    "m11_nearest_vectors",
    f"""WITH {_UNIT_SQL}, {_PAIRS_SQL.strip()} SELECT query_id, id, similarity_score, CAST(rn AS INTEGER) AS retrieval_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity_score DESC, id) AS rn FROM pairs) WHERE rn <= 10""",
)
def m11(spark, sf):
    found = retrieval.nearest_dense(_all_queries(spark, sf), vectors(spark, sf), 10)
    return found.select("query_id", "id", F.round("similarity_score", 6).alias("similarity_score"), "retrieval_rank")


@query(
    "m16_nearest_in_cluster",
    f"""WITH {_UNIT_SQL}, {_PAIRS_SQL.strip()} SELECT query_id, id, similarity_score, CAST(rn AS INTEGER) AS retrieval_rank FROM (
      SELECT p.*, row_number() OVER (PARTITION BY query_id ORDER BY similarity_score DESC, p.id) AS rn
      FROM pairs p JOIN vectors v ON v.id = p.id AND v.cluster_id = query_cluster) WHERE rn <= 10""",
)
def m16(spark, sf):
    found = retrieval.nearest_dense(_all_queries(spark, sf), vectors(spark, sf), 10, within=["cluster_id"])
    return found.select("query_id", "id", F.round("similarity_score", 6).alias("similarity_score"), "retrieval_rank")


def _hybrid_sql(weights, norms, pool=50, maxima=MAXIMA_SQL):
    w = weights
    return prepared_sql(
        f"""SELECT query_id, id, CAST(hybrid_rank AS INTEGER) AS hybrid_rank, round(similarity_score, 6) AS similarity_score,
          round(hybrid_score, 6) AS hybrid_score FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(hybrid_score, 9) DESC, round(similarity_score, 9) DESC, vote_count DESC, id) AS hybrid_rank
          FROM (SELECT query_id, id, similarity_score, vote_count, {w.similarity}::DOUBLE * similarity_score + {w.rating}::DOUBLE * {norms[0]}
            + {w.votes}::DOUBLE * {norms[1]} + {w.popularity}::DOUBLE * {norms[2]} + {w.quality}::DOUBLE * {norms[3]} AS hybrid_score
            FROM pool JOIN final USING (id), maxima)) WHERE hybrid_rank <= 10""",
        _UNIT_SQL.replace("FROM embeddings", "FROM embeddings"),
        _PAIRS_SQL.replace("WHERE q.id <> i.id", "WHERE q.id <> i.id AND i.id IN (SELECT id FROM final)"),
        maxima,
        f"""pool AS (SELECT query_id, id, raw AS similarity_score FROM (SELECT p.*, row_number() OVER (PARTITION BY query_id
          ORDER BY similarity_score DESC, vote_count DESC, p.id) AS rn FROM pairs p JOIN final f ON f.id = p.id) WHERE rn <= {pool})""",
    )


_LINEAR = ("(vote_average / a)", "(vote_count / b)", "(popularity / c)", "(recommendation_quality_score / d)")
_LOGS = (
    "(vote_average / 10.0::DOUBLE)", "(ln(1 + vote_count) / b)", "(ln(1 + popularity) / c)",
    "(recommendation_quality_score / d)",
)
_LOG_MAXIMA_SQL = """
maxima AS (SELECT coalesce(nullif(max(ln(1 + vote_count)), 0), 1.0::DOUBLE) AS b,
  coalesce(nullif(max(ln(1 + popularity)), 0), 1.0::DOUBLE) AS c,
  coalesce(nullif(max(recommendation_quality_score), 0), 1.0::DOUBLE) AS d FROM final)
"""


def _pool(spark, sf, pool=50):
    shown = movies(spark, sf)
    indexed = vectors(spark, sf).join(never_broadcast(shown.select("id", "vote_count")), "id")
    pairs = retrieval.nearest_dense(_all_queries(spark, sf), indexed, pool, sizes=retrieval.POOL_SIZES)
    return shown, pairs.drop("vote_count").join(never_broadcast(shown), "id")


def _hybrid(spark, sf, weights, norms):
    shown, pairs = _pool(spark, sf)
    found = ranking.rerank(pairs, norms(shown), weights, 10)
    return found.select(
        "query_id", "id", "hybrid_rank", F.round("similarity_score", 6).alias("similarity_score"),
        F.round("hybrid_score", 6).alias("hybrid_score"),
    )


@query("m12_hybrid_rerank", _hybrid_sql(ranking.SERVICE_WEIGHTS, _LINEAR))
def m12(spark, sf):
    return _hybrid(spark, sf, ranking.SERVICE_WEIGHTS, ranking.linear_norms)


@query("m13_hybrid_log_norms", _hybrid_sql(ranking.NOTEBOOK_WEIGHTS, _LOGS, maxima=_LOG_MAXIMA_SQL))
def m13(spark, sf):
    return _hybrid(spark, sf, ranking.NOTEBOOK_WEIGHTS, ranking.log_norms)


@query("m14_hybrid_plan_weights", _hybrid_sql(ranking.PLAN_WEIGHTS, _LINEAR))
def m14(spark, sf):
    return _hybrid(spark, sf, ranking.PLAN_WEIGHTS, ranking.linear_norms)


_SERVICE_SQL = """
pool AS (SELECT query_id, id, raw AS similarity_score FROM (SELECT p.*, row_number() OVER (PARTITION BY query_id
  ORDER BY similarity_score DESC, p.id) AS rn FROM pairs p) WHERE rn <= {pool}),
service_scores AS (SELECT query_id, id, round(similarity_score, 9) AS retrieved, round(similarity_score, 4) AS similarity_score,
  round(0.7::DOUBLE * similarity_score + 0.1::DOUBLE * (vote_average / a) + 0.08::DOUBLE * (vote_count / b)
    + 0.07::DOUBLE * (popularity / c) + 0.05::DOUBLE * (recommendation_quality_score / d), 4) AS hybrid_score
  FROM pool JOIN final USING (id), maxima),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, similarity_score DESC, retrieved DESC, id) AS rn
  FROM service_scores)
"""


def _service_parts(pool):
    return (
        _UNIT_SQL,
        _PAIRS_SQL.replace("WHERE q.id <> i.id", "WHERE q.id <> i.id AND i.id IN (SELECT id FROM final)"),
        MAXIMA_SQL,
        _SERVICE_SQL.format(pool=pool),
    )


@query(
    "m15_similar_movies",
    prepared_sql(
        "SELECT query_id, id, CAST(rn AS INTEGER) AS rank, similarity_score, hybrid_score FROM ordered WHERE rn <= 10",
        *_service_parts(49),
    ),
)
def m15(spark, sf):
    sources = vectors(spark, sf).select(F.col("id").alias("query_id"), F.col("id").alias("source_id"))
    found = rq.similar_movies(sources, movies(spark, sf), vectors(spark, sf), 10)
    return found.select(
        "query_id", "id", F.col("hybrid_rank").alias("rank"), "similarity_score", "hybrid_score"
    )


_POST_SQL = " AND ".join(
    f"({c})"
    for c in [
        "len(preferred_genres) = 0 OR len(list_filter(preferred_genres, lambda t: contains(genres_text, lower(trim(t))))) > 0",
        "len(keywords) = 0 OR len(list_filter(keywords, lambda t: contains(concat_ws(' ', nullif(keywords_text, ''), nullif(overview_clean, ''), nullif(genres_text, '')), lower(trim(t))))) > 0",
        "len(languages) = 0 OR list_contains(languages, lower(original_language))",
        "min_rating IS NULL OR coalesce(vote_average >= min_rating, FALSE)",
        "max_rating IS NULL OR coalesce(vote_average <= max_rating, FALSE)",
        "release_year_from IS NULL OR coalesce(release_year >= release_year_from, FALSE)",
        "min_runtime IS NULL OR coalesce(runtime >= min_runtime, FALSE)",
        "max_runtime IS NULL OR coalesce(runtime <= max_runtime, FALSE)",
    ]
)


def _similar_requests(spark, sf):
    """The filter requests as wishes for movies like the one they are numbered by."""
    from marquee.operators.intents import empty_strings

    wishes = filter_requests(spark, sf).withColumn("source_id", F.col("query_id"))
    return wishes.withColumn("intent", F.col("intent").withField("directors", empty_strings()))


@query(
    "m24_filtered_similar_movies",
    prepared_sql(
        f"""SELECT query_id, id, CAST(r AS INTEGER) AS rank, similarity_score, hybrid_score FROM (
          SELECT o.*, row_number() OVER (PARTITION BY query_id ORDER BY o.rn) AS r
          FROM (SELECT * FROM ordered WHERE rn <= 100) o JOIN final USING (id) JOIN filter_requests USING (query_id)
          WHERE {_POST_SQL}) WHERE r <= 10""",
        *_service_parts(100),
        FILTER_REQUESTS_SQL,
    ),
)
def m24(spark, sf):
    found = rq.filtered_similar(_similar_requests(spark, sf), movies(spark, sf), vectors(spark, sf), 10)
    return found.select("query_id", "id", "rank", "similarity_score", "hybrid_score")


@query(
    "m20_genre_overlap",
    prepared_sql("""SELECT id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE
      ELSE round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) END AS genre_overlap
      FROM (SELECT id, list_distinct(list_filter(string_split(lower(genres_text), ' '), lambda w: w <> '')) AS a,
        list_distinct(list_filter(string_split(lower(keywords_text), ' '), lambda w: w <> '')) AS b FROM final)"""),
)
def m20(spark, sf):
    return movies(spark, sf).select(
        "id", F.round(jaccard("genres_text", "keywords_text"), 6).alias("genre_overlap")
    )


@query(
    "j12_explanations",
    prepared_sql("""SELECT id, coalesce(upper(lang), 'similar') AS reason FROM final LEFT JOIN
      (SELECT doc_id AS id, lang FROM documents) USING (id)"""),
)
def j12(spark, sf):
    given = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.upper("lang").alias("reason"))
    return rq.with_explanations(movies(spark, sf).select("id", F.lit("similar").alias("reason")), given)


@query(
    "j14_shares_of_maxima",
    prepared_sql(
        """SELECT id, round(vote_average / a, 6) AS rating_norm, round(vote_count / b, 6) AS vote_count_norm,
        round(popularity / c, 6) AS popularity_norm, round(recommendation_quality_score / d, 6) AS quality_norm FROM final, maxima""",
        MAXIMA_SQL,
    ),
)
def j14(spark, sf):
    rows = movies(spark, sf)
    return rows.select("id", *(F.round(c, 6).alias(n) for n, c in ranking.linear_norms(rows).items()))


@query(
    "b34_display_columns",
    prepared_sql("""SELECT id, CASE WHEN coalesce(poster_path, '') <> '' THEN 'https://image.example.org' || poster_path END AS poster_url,
      floor(vote_average / 10 * 100 + 0.5)::BIGINT || '%' AS score_text FROM final"""),
)
def b34(spark, sf):
    rows = movies(spark, sf).select("id", "poster_path", (F.col("vote_average") / 10).alias("hybrid_score"))
    return rq.display_columns(rows).select("id", "poster_url", "score_text")


@query(
    "a11_vector_lookup",
    prepared_sql("""SELECT id, CASE WHEN v.vec_id IS NULL THEN 'not_found' ELSE 'found' END AS status FROM final
      LEFT JOIN embeddings v ON vec_id = id"""),
)
def a11_vectors(spark, sf):
    return lookup(movies(spark, sf).select("id"), vectors(spark, sf)).select("id", "status")


@query(
    "j6_listed_movies",
    prepared_sql("""SELECT id, title FROM final WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)"""),
)
def j6(spark, sf):
    good = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    return movies(spark, sf).join(good, "id", "left_semi").select("id", "title")


@query(
    "p11_membership",
    """SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr')""",
)
def p11(spark, sf):
    return table(spark, sf, "documents").filter(F.col("lang").isin("en", "fr")).select("doc_id", "lang")
