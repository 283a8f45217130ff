"""Free-text requests answered in bulk: parse, route, search, answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from marquee.functions.columns import FEW, is_few, never_broadcast, rows_of, union_all
from marquee.operators.blocks import BlockSizes
from marquee.operators.dedupe import top_per_key
from marquee.operators.discovery import discover
from marquee.operators.intents import extract_title, has_filters, passes_filters, with_intent
from marquee.operators.ranking import (
    CANDIDATE_POOL,
    SERVICE_WEIGHTS,
    SIMILARITY_REASON,
    linear_norms,
    rerank,
)
from marquee.operators.retrieval import POOL_SIZES, nearest_dense
from marquee.operators.titles import resolve_with_status
from marquee.session import cut_lineage

# Answer texts and the ranking notes of the analysis record.
CLARIFY = "Sebutkan satu judul film yang kamu suka agar rekomendasinya lebih tepat."
NO_DISCOVERY = "Belum ada film yang memenuhi semua filter tersebut. Coba longgarkan salah satu filter."
NO_TITLE = "Saya belum menemukan film tersebut. Coba tulis judul film yang lebih spesifik."
CHOOSE = "Saya menemukan beberapa film. Pilih salah satu agar rekomendasi lebih tepat."
DISCOVERY_RANKING = "40% rating + 25% vote count + 15% popularity + 20% metadata quality"
SIMILARITY_RANKING = "70% similarity + 10% rating + 8% vote count + 7% popularity + 5% metadata quality"

# The limits of a request.
MESSAGE_LENGTHS = (1, 500)
TOP_K = (1, 20)
DEFAULT_TOP_K = 10

_SUMMARY = {
    "genres": "genres_text", "cast": "top_cast_text", "director": "director_clean",
    "keywords": "keywords_text", "overview": "overview_clean",
    "original_language": "original_language", "vote_average": "vote_average",
    "release_year": "release_year", "runtime": "runtime",
}


#: A search of a vector index: queries (query_id, source_id, vector) and k, to what ``nearest_dense`` gives.
Search = Callable[[DataFrame, int], DataFrame]


def _searched(asked: DataFrame, movies: DataFrame, vectors: DataFrame, k: int, sizes: BlockSizes, search: Search | None) -> DataFrame:
    if search is not None:
        return search(asked, k)
    return nearest_dense(asked, vectors.join(never_broadcast(movies.select("id")), "id"), k, sizes=sizes)


def similar_movies(
    sources: DataFrame,
    movies: DataFrame,
    vectors: DataFrame,
    k: int = 10,
    pool: int = CANDIDATE_POOL,
    sizes: BlockSizes = POOL_SIZES,
    search: Search | None = None,
) -> DataFrame:
    """Service recommendation for resolved sources.

    ``sources``: query_id, source_id. The pool counts the source itself, so
    pool - 1 others are re-ranked; scores are rounded before they are ranked.
    ``search`` asks an index of the movies' vectors instead of all of them.
    """
    pool = max(pool, k + 1)
    asked = sources.join(never_broadcast(vectors.withColumnRenamed("id", "source_id")), "source_id").select(
        "query_id", "source_id", "vector"
    )
    pairs = _searched(asked, movies, vectors, pool - 1, sizes, search)
    scored = pairs.drop("vote_count").join(never_broadcast(movies), "id")
    return rerank(scored, linear_norms(movies), SERVICE_WEIGHTS, k, rounded=True).withColumns(
        {"reason": F.lit(SIMILARITY_REASON), "score_type": F.lit("similarity")}
    )


def filtered_similar(
    requests: DataFrame,
    movies: DataFrame,
    vectors: DataFrame,
    k: int = 10,
    sizes: BlockSizes = POOL_SIZES,
    search: Search | None = None,
) -> DataFrame:
    """Similar movies that also pass the request's filters, top_k per request.

    ``requests``: query_id, source_id, intent (NULL: no filter), and top_k, or
    all ask for ``k``. A request's pool is ten times its own top_k, cut by
    similarity before the pool is re-ranked and filtered. With a top_k column
    the requests' values must lie within ``TOP_K``.
    """
    own = "top_k" in requests.columns
    most = TOP_K[1] if own else k
    asked = requests.select(
        F.col("query_id").cast("bigint"), "intent", (F.col("top_k") if own else F.lit(k)).alias("_top_k")
    )
    known = vectors.withColumnRenamed("id", "source_id")
    pool = candidate_pool(most)
    sources = rows_of(requests, known, "source_id", is_few(requests)).select("query_id", "source_id", "vector")
    near = _searched(sources, movies, vectors, pool, sizes, search)
    pooled = near.join(asked, "query_id").filter(F.col("retrieval_rank") <= pool_target(F.col("_top_k")))
    scored = rows_of(pooled.drop("vote_count"), movies, "id", is_few(requests, FEW // pool))
    found = rerank(scored, linear_norms(movies), SERVICE_WEIGHTS, pool, rounded=True).withColumns(
        {"reason": F.lit(SIMILARITY_REASON), "score_type": F.lit("similarity")}
    )
    movie = {n: F.col(c) for n, c in _SUMMARY.items()}
    kept = found.filter(passes_filters(F.col("intent"), movie))
    ranked = top_per_key(kept.drop("intent"), ["query_id"], [F.asc("hybrid_rank")], most, "rank")
    return ranked.filter(F.col("rank") <= F.col("_top_k")).drop("_top_k")


def candidate_pool(top_k: int) -> int:
    """Candidates that are re-ranked for a request of ``top_k`` results."""
    return max(CANDIDATE_POOL, 10 * top_k)


def pool_target(top_k: Column) -> Column:
    return F.greatest(F.lit(CANDIDATE_POOL), top_k * 10)


def is_valid(message: Column, top_k: Column) -> Column:
    """Whether the request keeps the limits; one that does not gets an error, not a shorter answer."""
    return F.coalesce(F.length(message).between(*MESSAGE_LENGTHS) & top_k.between(*TOP_K), F.lit(False))


def routed(requests: DataFrame) -> DataFrame:
    """Add intent, title and mode to a message table (query_id, message, top_k).

    ``intent`` may be given by another interpreter; the patterns fill the rest.
    """
    parsed = with_intent(requests, name="_parsed")
    given = F.coalesce("intent", "_parsed") if "intent" in requests.columns else F.col("_parsed")
    parsed = parsed.withColumn("intent", given).drop("_parsed")
    intent = F.col("intent")
    named = F.coalesce(F.nullif(intent["reference_title"], F.lit("")), F.lit("")) != ""
    filtered = has_filters(intent)
    unclear = F.coalesce(intent["clarification_needed"], F.lit(False))
    return parsed.withColumns(
        {
            "mode": F.when(unclear & ~named & ~filtered, "clarification")
            .when(~named & filtered, "discovery")
            .otherwise("similarity"),
            "title": F.when(named, intent["reference_title"]).otherwise(extract_title("message")),
        }
    )


def analysis(top_k: Column) -> Column:
    """How a request was executed: mode, ranking, pool and parameters."""
    similar = F.col("mode") == "similarity"
    return F.struct(
        F.col("message").alias("original_query"),
        F.lit("fallback_pattern").alias("interpreter"),
        F.col("mode").alias("execution_mode"),
        F.when(similar, "resolve_title -> cosine_search -> hybrid_rerank -> intent_filters -> top_k")
        .when(F.col("mode") == "discovery", "metadata_discovery(filters) -> discovery_ranking -> top_k")
        .otherwise("request_clarification()")
        .alias("backend_query"),
        F.when(similar, F.col("title")).alias("reference_title"),
        F.when(similar, pool_target(top_k)).alias("candidate_pool_target"),
        top_k.alias("top_k"),
        F.when(similar, SIMILARITY_RANKING)
        .when(F.col("mode") == "discovery", DISCOVERY_RANKING)
        .alias("ranking"),
    )


def _results(found: DataFrame, top_k: DataFrame, score: str) -> DataFrame:
    """The first top_k results of each request as one array of small structs."""
    cut = found.join(top_k, "query_id").filter(F.col("rank") <= F.col("top_k"))
    listed = F.array_sort(
        F.collect_list(F.struct("rank", "id", F.col(score).alias("score"), "reason"))
    )
    return cut.groupBy("query_id").agg(listed.alias("recommendations"))


def answer(
    requests: DataFrame,
    movies: DataFrame,
    vectors: DataFrame,
    sizes: BlockSizes | None = None,
    search: Search | None = None,
) -> DataFrame:
    """Answer a table of messages (query_id, message, top_k).

    Returns query_id, mode, status, answer, source_id, candidates,
    recommendations and analysis. A request outside the limits (``MESSAGE_LENGTHS``,
    ``TOP_K``) is not answered but gets the status ``invalid_request``; without a
    top_k it asks for ``DEFAULT_TOP_K``. The small result tables between the steps
    are written to the checkpoint folder, since several later steps read each of them.
    """
    top_k = F.coalesce("top_k", F.lit(DEFAULT_TOP_K))
    numbered = requests.withColumns({"query_id": F.col("query_id").cast("bigint"), "top_k": top_k})
    all_asked = cut_lineage(routed(numbered).withColumn("_valid", is_valid(F.col("message"), F.col("top_k"))))
    asked = all_asked.filter("_valid").drop("_valid")
    refused = all_asked.filter("NOT _valid").select(
        "query_id", "mode", F.lit("invalid_request").alias("status"), F.lit(None).cast("string").alias("answer"),
        F.lit(None).cast("bigint").alias("source_id"), F.array().cast("array<bigint>").alias("candidates"),
        analysis(F.col("top_k")).alias("analysis"),
    )
    base = asked.withColumn("analysis", analysis(F.col("top_k")))
    wanted = asked.select("query_id", "top_k")

    discovery = base.filter(F.col("mode") == "discovery")
    listed = cut_lineage(_results(discover(discovery, movies, TOP_K[1], sizes or BlockSizes()), wanted, "score"))
    discovered = discovery.join(listed, "query_id", "left").select(
        "query_id", "mode",
        F.when(F.col("recommendations").isNotNull(), "recommendations").otherwise("not_found").alias("status"),
        F.when(
            F.col("recommendations").isNotNull(),
            F.format_string("Saya menemukan %d film yang memenuhi filter kamu.", F.size("recommendations")),
        ).otherwise(NO_DISCOVERY).alias("answer"),
        F.lit(None).cast("bigint").alias("source_id"),
        F.array().cast("array<bigint>").alias("candidates"),
        "recommendations", "analysis",
    )

    similarity = base.filter(F.col("mode") == "similarity")
    resolved = cut_lineage(
        resolve_with_status(similarity.select("query_id", F.col("title").alias("query")), movies)
    )
    known = vectors.join(never_broadcast(movies.select("id", F.col("title").alias("source_title"))), "id")
    sources = resolved.filter(F.col("status") == "resolved").select("query_id", "source_id")
    found = _results(
        filtered_similar(
            sources.join(similarity.select("query_id", "intent", "top_k"), "query_id"), movies, vectors, sizes=sizes or POOL_SIZES, search=search
        ),
        wanted,
        "hybrid_score",
    )
    titles = known.select(F.col("id").alias("source_id"), "source_title")
    joined = (
        similarity.join(resolved.drop("query"), "query_id")
        .join(found, "query_id", "left")
        .join(never_broadcast(titles), "source_id", "left")
    )
    has_vector = F.col("source_title").isNotNull()
    status = (
        F.when(F.col("status") == "ambiguous", "needs_selection")
        .when(F.col("status") == "not_found", "not_found")
        .when(~has_vector, "unavailable")
        .when(F.col("recommendations").isNull() & has_filters(F.col("intent")), "not_found")
        .otherwise("recommendations")
    )
    like = F.concat(F.lit("Berikut rekomendasi film yang mirip dengan "), "source_title", F.lit("."))
    none_left = F.concat(
        F.lit("Film yang mirip dengan "), "source_title",
        F.lit(" ditemukan, tetapi tidak ada yang memenuhi semua filter. Coba longgarkan salah satu filter."),
    )
    similar = joined.select(
        "query_id", "mode", status.alias("status"),
        F.when(status == "needs_selection", CHOOSE)
        .when(F.col("status") == "not_found", NO_TITLE)
        .when(status == "not_found", none_left)
        .when(status == "recommendations", like)
        .alias("answer"),
        "source_id", "candidates", "recommendations", "analysis",
    )

    unclear = base.filter(F.col("mode") == "clarification").select(
        "query_id", "mode", F.lit("needs_clarification").alias("status"),
        F.coalesce("intent.clarification_question", F.lit(CLARIFY)).alias("answer"),
        F.lit(None).cast("bigint").alias("source_id"),
        F.array().cast("array<bigint>").alias("candidates"),
        "analysis",
    )
    return union_all([discovered, similar, unclear, refused])


def with_explanations(results: DataFrame, explanations: DataFrame) -> DataFrame:
    """Replace the reason where another one was given for the movie."""
    given = explanations.select("id", F.col("reason").alias("_given"))
    return results.join(given, "id", "left").withColumn(
        "reason", F.coalesce("_given", "reason")
    ).drop("_given")


def display_columns(results: DataFrame, prefix: str = "https://image.example.org") -> DataFrame:
    """Poster address and score as a percent text."""
    return results.withColumns(
        {
            "poster_url": F.when(F.coalesce("poster_path", F.lit("")) != "", F.concat(F.lit(prefix), "poster_path")),
            "score_text": F.coalesce(
                F.concat(F.floor(F.col("hybrid_score") * 100 + 0.5).cast("string"), F.lit("%")), F.lit("-")
            ),
        }
    )
