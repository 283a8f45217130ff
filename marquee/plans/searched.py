"""Pruned searches: cell index, posting joins and impact-ordered blocks, beside what they must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions.columns import is_few, never_broadcast, rows_of
from marquee.functions.vectors import dot, unit
from marquee.operators import requests as rq, titles
from marquee.operators.cells import recall_at
from marquee.operators.discovery import ScoreOrder
from marquee.operators.evaluation import evaluate_dense
from marquee.operators.impacts import ImpactIndex
from marquee.operators.ranking import NOTEBOOK_WEIGHTS, log_norms, own_score
from marquee.operators.retrieval import large_sizes, nearest_dense
from marquee.operators.titles import resolve_first, resolve_popular
from marquee.plans.ranked import _all_queries, _similar_requests, misspelt_queries
from marquee.plans.registry import ORACLES, query
from marquee.plans.served import TITLE_QUERIES_SQL, cell_index, filter_requests, movie_cell_index, movies, title_queries, vectors
from marquee.plans.storage import stored_folder
from marquee.plans.testbed import prepared_sql
from marquee.plans.texts import sparse_features
from marquee.session import cut_lineage

# -- dense vectors ------------------------------------------------------------------------------------

#: Trial queries that the number of probed cells is measured on, and the recall it must reach.
_TRIALS, _RECALL = 128, 0.97


@query(
    "m11_cell_members",
    "SELECT count(*) AS vectors, count(*) AS indexed, 0::BIGINT AS away_from_nearest, 0::BIGINT AS outside_part FROM embeddings",
)
def m11_members(spark, sf):
    """Every vector lies in one part, in the cell of its nearest centre, within its part's angles."""
    index = cell_index(spark, sf)
    centres = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in index.centres))
    cosines = F.transform(F.array(unit("vector")), lambda u: F.transform(centres, lambda c: dot(c, u)))[0]
    parts = spark.createDataFrame(index.parts[["part", "lo", "hi"]], "part int, lo double, hi double")
    rows = index.vectors.withColumn("best", F.array_max(cosines)).join(parts, "part", "left")
    away = F.abs(F.cos("angle") - F.col("best")) > 1e-9
    outside = ~F.coalesce(F.col("angle").between(F.col("lo"), F.col("hi")), F.lit(False))
    return rows.agg(
        vectors(spark, sf).agg(F.count("*")).scalar().alias("vectors"), F.countDistinct("id").alias("indexed"),
        F.count_if(away).alias("away_from_nearest"), F.count_if(outside).alias("outside_part"),
    )


def _pruned(spark, sf):
    index = cell_index(spark, sf)
    trials = _all_queries(spark, sf).select("query_id", "source_id", "vector").orderBy(F.xxhash64("query_id")).limit(_TRIALS)
    probes = index.probes_for(trials, 10, _RECALL)
    return index.nearest(_all_queries(spark, sf).select("query_id", "source_id", "vector"), 10, probes)


@query("m11_pruned_neighbours")
def m11_pruned(spark, sf):
    """Approximate: probes are measured on trial queries, so no SQL twin; ``m11_recall_at_10`` holds it against the exact result."""
    return _pruned(spark, sf).select("query_id", "id", F.round("similarity_score", 6).alias("similarity_score"), "retrieval_rank")


@query(
    "m11_recall_at_10",
    "SELECT count(*) * least(10, count(*) - 1) AS pairs, TRUE AS reaches_95 FROM embeddings",
)
def m11_recall(spark, sf):
    sizes = large_sizes(vectors(spark, sf).count())
    true = nearest_dense(_all_queries(spark, sf), vectors(spark, sf), 10, sizes=sizes)
    return recall_at(_pruned(spark, sf), true).select("pairs", (F.col("recall") >= 0.95).alias("reaches_95"))


@query("m11_exact_by_cells", ORACLES["m11_nearest_vectors"])
def m11_exact(spark, sf):
    found = cell_index(spark, sf).nearest_exact(_all_queries(spark, sf).select("query_id", "source_id", "vector"), 10)
    return found.select("query_id", "id", F.round("similarity_score", 6).alias("similarity_score"), "retrieval_rank")


@query("m15_similar_movies_by_cells", ORACLES["m15_similar_movies"])
def m15_cells(spark, sf):
    sources = vectors(spark, sf).select(F.col("id").alias("query_id"), F.col("id").alias("source_id"))
    found = rq.similar_movies(sources, movies(spark, sf), vectors(spark, sf), 10, search=movie_cell_index(spark, sf).nearest_exact)
    return found.select("query_id", "id", F.col("hybrid_rank").alias("rank"), "similarity_score", "hybrid_score")


@query("m24_filtered_similar_by_cells", ORACLES["m24_filtered_similar_movies"])
def m24_cells(spark, sf):
    search = movie_cell_index(spark, sf).nearest_exact
    found = rq.filtered_similar(_similar_requests(spark, sf), movies(spark, sf), vectors(spark, sf), 10, search=search)
    return found.select("query_id", "id", "rank", "similarity_score", "hybrid_score")


@query("m16_nearest_in_cluster_by_cells", ORACLES["m16_nearest_in_cluster"])
def m16_cells(spark, sf):
    """Cluster and part must both be equal."""
    found = cell_index(spark, sf).nearest_exact(_all_queries(spark, sf), 10, within=["cluster_id"])
    return found.select("query_id", "id", F.round("similarity_score", 6).alias("similarity_score"), "retrieval_rank")


@query("m21_evaluation_by_cells", ORACLES["m21_evaluation_run"])
def m21_cells(spark, sf):
    found = evaluate_dense(title_queries(spark, sf), movies(spark, sf), vectors(spark, sf), search=movie_cell_index(spark, sf).nearest_exact)
    return found.select(
        "query_id", "source_id", F.col("id").alias("recommended_id"), "retrieval_rank", "hybrid_rank",
        *(F.round(c, 6).alias(c) for c in ("similarity_score", "hybrid_score", "genre_overlap")),
    )


# -- titles -------------------------------------------------------------------------------------------

_LETTERS = "(SELECT {key}, c, count(*) AS n FROM (SELECT {key}, unnest(string_split({key}, '')) AS c FROM {rows}) GROUP BY 1, 2)"
_PAIRS = "(SELECT {key}, g, count(*) AS n FROM (SELECT {key}, unnest(list_transform(range(1, length({key})), lambda i: substr({key}, i, 2))) AS g FROM {rows}) GROUP BY 1, 2)"


@query(
    "j8_fuzzy_candidates",
    prepared_sql(
        f"""SELECT query_id, wanted, in_length, coalesce(compared, 0) AS compared FROM asked JOIN lengths USING (wanted)
          LEFT JOIN (SELECT wanted, count(*) AS compared FROM near
            LEFT JOIN (SELECT wanted, key, sum(least(a.n, b.n)) AS letters FROM {_LETTERS.format(key="wanted", rows="asked")} a
              JOIN {_LETTERS.format(key="key", rows="keys")} b USING (c) GROUP BY 1, 2) USING (wanted, key)
            LEFT JOIN (SELECT wanted, key, sum(least(a.n, b.n)) AS pairs FROM {_PAIRS.format(key="wanted", rows="asked")} a
              JOIN {_PAIRS.format(key="key", rows="keys")} b USING (g) GROUP BY 1, 2) USING (wanted, key)
            WHERE coalesce(letters, 0) >= need AND coalesce(pairs, 0) >= 3 * need - length(wanted) - length(key) - 1
            GROUP BY 1) USING (wanted)""",
        TITLE_QUERIES_SQL,
        """asked AS (SELECT query_id, trim(regexp_replace(lower(regexp_replace(query, '[ei]', '', 'g')), '\\s+', ' ', 'g')) AS wanted FROM title_queries
            WHERE length(trim(regexp_replace(lower(regexp_replace(query, '[ei]', '', 'g')), '\\s+', ' ', 'g'))) >= 4)""",
        "keys AS (SELECT DISTINCT trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS key FROM final)",
        """near AS (SELECT wanted, key, (37 * (length(wanted) + length(key)) + 99) // 100 AS need FROM (SELECT DISTINCT wanted FROM asked) JOIN keys
            ON 100 * length(key) >= floor(100 * length(wanted) * 74 / 126) AND length(key) BETWEEN ceil(length(wanted) * 74 / 126) AND floor(length(wanted) * 126 / 74))""",
        "lengths AS (SELECT wanted, count(key) AS in_length FROM (SELECT DISTINCT wanted FROM asked) LEFT JOIN near USING (wanted) GROUP BY 1)",
    ),
)
def j8_candidates(spark, sf):
    """What the prefix-filtered join lets through is what counting letters and pairs over all titles would."""
    return titles.fuzzy_candidates(misspelt_queries(spark, sf), movies(spark, sf))


# -- sparse vectors -----------------------------------------------------------------------------------


def impact_index(spark, sf, vector) -> ImpactIndex:
    folder = stored_folder(spark, sf, f"impacts_{vector}", lambda path: ImpactIndex.build(sparse_features(spark, sf, vector), path))
    return ImpactIndex.open(spark, folder)


def _by_impacts(spark, sf, vector):
    features = sparse_features(spark, sf, vector)
    sources = cut_lineage(resolve_first(title_queries(spark, sf), movies(spark, sf)).select("query_id", F.col("id").alias("source_id")))
    asked = rows_of(sources, features.withColumnRenamed("id", "source_id"), "source_id", is_few(sources))
    found = impact_index(spark, sf, vector).nearest(asked.select("query_id", "source_id", "indices", "values"), 10)
    return found.select("query_id", "id", F.col("retrieval_rank").alias("rank"), F.round("similarity_score", 6).alias("similarity_score"))


@query("m9_nearest_by_word_impacts", ORACLES["m9_nearest_by_words"])
def m9_impacts(spark, sf):
    return _by_impacts(spark, sf, "counts")


@query("m10_nearest_by_tfidf_impacts", ORACLES["m10_nearest_by_tfidf"])
def m10_impacts(spark, sf):
    return _by_impacts(spark, sf, "tfidf")


# -- searches that end early --------------------------------------------------------------------------


@query("t5_discovery_in_score_order", ORACLES["t5_discovery"])
def t5_ordered(spark, sf):
    folder = stored_folder(spark, sf, "score_order", lambda path: ScoreOrder.build(movies(spark, sf), path))
    found = ScoreOrder.open(spark, folder).discover(filter_requests(spark, sf), first=512)
    return found.drop("reason")


@query("m13_hybrid_by_impacts", ORACLES["m13_hybrid_over_all_movies"])
def m13_impacts(spark, sf):
    shown = movies(spark, sf)
    features = sparse_features(spark, sf, "tfidf")
    rated = features.drop("vote_count").join(never_broadcast(shown), "id")
    own = own_score(log_norms(shown), NOTEBOOK_WEIGHTS)
    folder = stored_folder(spark, sf, "hybrid_impacts", lambda path: ImpactIndex.build(rated, path, own=own))
    sources = cut_lineage(resolve_popular(title_queries(spark, sf), shown).select("query_id", F.col("id").alias("source_id")))
    asked = rows_of(sources, features.select(F.col("id").alias("source_id"), "indices", "values"), "source_id", is_few(sources))
    found = ImpactIndex.open(spark, folder).nearest_hybrid(asked, 10, NOTEBOOK_WEIGHTS.similarity)
    return found.select(
        "query_id", "id", F.col("retrieval_rank").alias("rank"),
        F.round("similarity_score", 6).alias("similarity_score"), F.round("hybrid_score", 6).alias("hybrid_score"),
    )
