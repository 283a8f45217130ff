"""Ingest, sinks, finalising and keep-one-row operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marquee.functions.columns import has_text, project, union_all
from marquee.operators import dedupe, features as ft, profile as pf
from marquee.plans.registry import query
from marquee.plans.storage import scratch_folder, stored
from marquee.plans.testbed import CATALOGUE_SQL, COLUMNS, PREPROCESS_SQL, catalogue, prepared_sql, sql, table
from marquee.sources import payloads, readers, sinks
from marquee.sources.schemas import BASE_MOVIE, data_dictionary

# The columns of the served payload table.
PAYLOAD_COLUMNS = [
    "id", "title", "original_title", "release_date", "release_year", "movie_era",
    "original_language", "genres_text", "director_clean", "top_cast_text", "keywords_text",
    "overview_clean", "tagline_clean", "runtime", "vote_average", "vote_count", "popularity",
    "budget", "revenue", "recommendation_quality_score",
]
OPTIONAL_PAYLOAD_COLUMNS = [
    "poster_path", "backdrop_path", "status", "imdb_id", "homepage", "genres_final_list_str",
    "production_companies_text", "production_countries_text", "spoken_languages_text", "writers_text",
]


def ready_movies(spark, sf) -> DataFrame:
    """The model-ready table, written once: several later tables are made from it."""
    return stored(spark, sf, "ready", lambda: ft.model_ready(ft.preprocess(catalogue(spark, sf))))


def keep_final(documents: DataFrame) -> DataFrame:
    """Rows with a title, a document and genres."""
    return documents.filter(
        F.col("id").isNotNull()
        & has_text("title")
        & has_text("movie_document_weighted")
        & has_text("genres_text")
    )


def finalise(documents: DataFrame) -> DataFrame:
    return dedupe.best_quality(keep_final(documents), [F.col("title"), F.col("movie_document_weighted")])


def final_movies(spark, sf) -> DataFrame:
    """The final table: complete rows, the best one of each movie."""
    return finalise(ready_movies(spark, sf))


def movie_payload(final: DataFrame, extra: DataFrame) -> DataFrame:
    """Final columns plus the optional ones of the model-ready table."""
    optional = project(ft.export_lists(extra), ["id", *OPTIONAL_PAYLOAD_COLUMNS])
    optional = optional.drop(*(c for c in optional.columns if c != "id" and c in final.columns))
    joined = final.join(optional, "id", "left")
    return project(joined, PAYLOAD_COLUMNS + OPTIONAL_PAYLOAD_COLUMNS)


# -- scans and sinks ---------------------------------------------------------------------------------

# Files whose values may hold line ends are read whole, so they are kept short.
_ROWS_PER_FILE = 50_000
_BASE = [f.name for f in BASE_MOVIE]
_BASE_SQL = ", ".join(c for c in _BASE if c not in ("poster_path", "overview"))


@query(
    "a1_csv_round_trip",
    sql(CATALOGUE_SQL, select=f"SELECT {_BASE_SQL}, nullif(poster_path, '') AS poster_path, overview FROM catalogue"),
)
def a1(spark, sf):
    path = scratch_folder(spark) + "/movies"
    sinks.write_csv(catalogue(spark, sf, *_BASE), path, rows_per_file=_ROWS_PER_FILE)
    return readers.read_csv(spark, path, BASE_MOVIE)


@query(
    "a2_model_input",
    prepared_sql("""SELECT id, title, release_year, genres_text, vote_average,
      CAST(vote_count AS DOUBLE) AS vote_count, popularity,
      round(recommendation_quality_score, 6) AS recommendation_quality_score,
      trim(movie_document_weighted) AS movie_document_weighted FROM final"""),
)
def a2(spark, sf):
    path = scratch_folder(spark) + "/final"
    sinks.write_csv(ft.document_table(final_movies(spark, sf)), path, rows_per_file=_ROWS_PER_FILE)
    rows = readers.read_documents(spark, path)
    return rows.withColumn("recommendation_quality_score", F.round("recommendation_quality_score", 6))


@query(
    "a3_pruned_scan",
    "SELECT doc_id, lang, n_chars FROM documents",
)
def a3(spark, sf):
    return project(table(spark, sf, "documents"), ["doc_id", "lang", "no_such_column", "n_chars"])


@query(
    "a4_parquet_vectors",
    "SELECT vec_id AS id, len(embedding) AS size, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings",
)
def a4(spark, sf):
    path = scratch_folder(spark) + "/vectors"
    sinks.write_parquet(table(spark, sf, "embeddings"), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return spark.read.parquet(path).select(
        F.col("vec_id").alias("id"),
        F.size("embedding").cast("bigint").alias("size"),
        F.round(total, 4).alias("total"),
    )


# Every sale is one hit of a collection run: the month it shipped in is the window.
_HITS_SQL = """hits AS (SELECT l_partkey AS id, p_name AS title, l_extendedprice AS popularity,
  CAST(l_quantity AS BIGINT) AS vote_count, l_discount * 10 AS recommendation_quality_score,
  strftime(l_shipdate, '%Y-%m') AS batch, l_orderkey, l_linenumber
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def hits(spark, sf) -> DataFrame:
    lineitem, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return lineitem.join(part, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.col("l_extendedprice").alias("popularity"),
        F.col("l_quantity").cast("bigint").alias("vote_count"),
        (F.col("l_discount") * 10).alias("recommendation_quality_score"),
        F.date_format("l_shipdate", "yyyy-MM").alias("batch"),
        "l_orderkey",
        "l_linenumber",
    )


@query(
    "a5_combined_batches",
    f"""WITH {_HITS_SQL} SELECT id, min(title) AS title, min(batch) AS first_batch, count(*) AS hits
    FROM hits GROUP BY id""",
)
def a5(spark, sf):
    """Batch files written per window, read as one folder, first file wins per id."""
    path = scratch_folder(spark) + "/batches"
    per_batch = (
        hits(spark, sf)
        .groupBy("id", "title", "batch")
        .agg(F.count("*").alias("n"))
        .select("id", "title", F.col("batch").alias("release_date"), "n", F.col("batch").alias("b"))
    )
    per_batch.write.partitionBy("b").option("header", True).csv(path)
    read = readers.read_batches(spark, path, "id bigint, title string, release_date string, n bigint")
    ordered = read.withColumn("batch_file", F.concat_ws("/", F.col("b").cast("string"), "batch_file"))
    counted = read.groupBy("id").agg(F.sum("n").alias("hits"))
    first = dedupe.first_batch(ordered, readers.BATCH_ORDER)
    return first.select("id", "title", F.col("release_date").alias("first_batch")).join(counted, "id")


def _pages(spark, sf) -> DataFrame:
    """One listing page per order (an order has a handful of lines)."""
    part = table(spark, sf, "part")
    lines = table(spark, sf, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey"))
    result = F.struct(
        F.col("l_linenumber").alias("place"),
        F.col("l_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.array(F.col("p_size").cast("bigint"), F.length("p_type").cast("bigint")).alias("genre_ids"),
        F.col("l_extendedprice").alias("popularity"),
        F.col("l_quantity").cast("bigint").alias("vote_count"),
    )
    grouped = lines.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(result)).alias("results"),
        F.min("l_shipdate").alias("first_ship"),
    )
    return grouped.select(
        F.to_json(F.struct(F.col("l_orderkey").alias("page"), "results")).alias("payload"),
        F.lit("vote0").alias("source_config"),
        F.date_format(F.trunc("first_ship", "month"), "yyyy-MM-dd").alias("source_start_date"),
        F.date_format(F.last_day("first_ship"), "yyyy-MM-dd").alias("source_end_date"),
        F.col("l_orderkey").alias("source_page"),
    )


_GENRES = {5: "Comedy", 6: "Drama", 7: "Horror", 8: "Music"}


@query(
    "a6_listing_rows",
    """SELECT l_partkey AS id, p_name AS title, l_extendedprice AS popularity,
      CAST(l_quantity AS BIGINT) AS vote_count, p_size || ',' || length(p_type) AS genre_ids,
      coalesce(g.name, p_size::VARCHAR) || ', ' || coalesce(h.name, length(p_type)::VARCHAR) AS genres,
      'vote0' AS source_config, l_orderkey AS source_page,
      strftime(date_trunc('month', min(l_shipdate) OVER (PARTITION BY l_orderkey)), '%Y-%m-%d') AS source_start_date,
      strftime(last_day(min(l_shipdate) OVER (PARTITION BY l_orderkey)), '%Y-%m-%d') AS source_end_date
    FROM lineitem JOIN part ON p_partkey = l_partkey
    LEFT JOIN (VALUES (5, 'Comedy'), (6, 'Drama'), (7, 'Horror'), (8, 'Music')) g(id, name) ON g.id = p_size
    LEFT JOIN (VALUES (5, 'Comedy'), (6, 'Drama'), (7, 'Horror'), (8, 'Music')) h(id, name) ON h.id = length(p_type)""",
)
def a6(spark, sf):
    rows = payloads.listing_rows(_pages(spark, sf), _GENRES)
    return rows.select(
        "id", "title", "popularity", "vote_count", "genre_ids", "genres", "source_config",
        "source_page", "source_start_date", "source_end_date",
    )


def _details(spark, sf, whole: bool = False) -> DataFrame:
    """Detail records of the catalogue, nested as a detail source delivers them; ``whole`` ones have every field."""
    more = ["revenue", "imdb_id", "homepage"] if whole else []
    movies = catalogue(
        spark, sf, "id", "runtime", "status", "tagline", "budget", "genres_detail", "director",
        "writers", "top_cast", "keywords", "production_companies", "production_countries",
        *more, *(["spoken_languages"] if whole else []),
    )

    def named(c, *extra):
        return F.transform(
            F.split(c, r" \| "), lambda x, i: F.struct(x.alias("name"), *(f(x, i) for f in extra))
        )

    crew = F.concat(
        F.array(F.struct(F.col("director").alias("name"), F.lit("Director").alias("job"))),
        F.transform(
            F.split("writers", r" \| "),
            lambda x, i: F.struct(
                F.concat(F.lit(" "), x).alias("name"),
                F.when(i % 2 == 0, "Novel").otherwise("Writer").alias("job"),
            ),
        ),
        F.array(F.struct(F.col("director").alias("name"), F.lit("Director").alias("job"))),
    )
    cast = named("top_cast", lambda x, i: (F.lit(100) - i).cast("bigint").alias("order"))
    if whole:  # two of each order, told apart by the cast id
        cast = named(
            "top_cast",
            lambda x, i: (F.lit(100) - F.floor(i / 2)).cast("bigint").alias("order"),
            lambda x, i: (i + 1).cast("bigint").alias("cast_id"),
        )
        more.append(named("spoken_languages", lambda x, i: F.concat(F.lit("L-"), x).alias("english_name")).alias("spoken_languages"))
    detail = F.struct(
        "id", "runtime", "status", "tagline", "budget", *more,
        named("genres_detail").alias("genres"),
        named("production_companies").alias("production_companies"),
        named("production_countries", lambda x, i: F.right(x, F.lit(2)).alias("iso_3166_1")).alias(
            "production_countries"
        ),
        F.struct(cast.alias("cast"), crew.alias("crew")).alias("credits"),
        F.struct(
            F.when(F.col("budget") > 0, named("keywords")).alias("keywords"),
            named("keywords").alias("results"),
        ).alias("keywords"),
    )
    return movies.select("id", F.to_json(detail).alias("payload"))


@query(
    "a7_detail_rows_short",
    sql(CATALOGUE_SQL, select="""SELECT id, runtime, status, tagline, budget,
      replace(production_companies, ' | ', ', ') AS production_companies,
      array_to_string(list_distinct_in_order, ', ') AS production_countries,
      coalesce(nullif(director, ''), '') AS director,
      coalesce(array_to_string(list_transform(list_filter(list_zip(string_split(writers, ' | '),
        range(len(string_split(writers, ' | ')))), lambda x: x[2] % 2 = 1), lambda x: ' ' || x[1]), ', '), '') AS writers,
      coalesce(array_to_string(list_reverse(string_split(top_cast, ' | ')), ', '), '') AS top_cast,
      CASE WHEN budget > 0 THEN coalesce(array_to_string(list_transform(list_filter(list_zip(w, range(len(w))),
        lambda x: list_position(w, x[1]) = x[2] + 1), lambda x: x[1]), ', '), '') ELSE '' END AS keywords
    FROM (SELECT *, string_split(keywords, ' | ') AS w,
      list_transform(list_filter(list_zip(c, range(len(c))), lambda x: list_position(c, x[1]) = x[2] + 1), lambda x: x[1]) AS list_distinct_in_order
      FROM (SELECT *, list_transform(string_split(production_countries, ' | '), lambda x: right(x, 2)) AS c FROM catalogue))"""),
)
def a7(spark, sf):
    return payloads.detail_rows_short(_details(spark, sf)).drop(
        "revenue", "imdb_id", "homepage", "spoken_languages"
    )


@query(
    "a8_detail_rows_wide",
    sql(CATALOGUE_SQL, select="""SELECT id, runtime, status, tagline, budget,
      coalesce(nullif(genres_detail, ''), '') AS genres_detail, production_companies, production_countries,
      CASE WHEN director IS NULL OR director = '' THEN '' ELSE director || ' | ' || director END AS director,
      writers, coalesce(top_cast, '') AS top_cast, coalesce(keywords, '') AS keywords FROM catalogue"""),
)
def a8(spark, sf):
    return payloads.detail_rows_wide(_details(spark, sf)).drop(
        "revenue", "imdb_id", "homepage", "spoken_languages", "enriched_at"
    )


@query(
    "a10_month_windows",
    """SELECT CAST(d AS DATE) AS start_date, last_day(CAST(d AS DATE)) AS end_date FROM (
      SELECT unnest(generate_series(date_trunc('year', min(o_orderdate)),
        date_trunc('year', max(o_orderdate)) + INTERVAL 11 MONTH, INTERVAL 1 MONTH)) AS d FROM orders)""",
)
def a10(spark, sf):
    return payloads.month_windows_of(table(spark, sf, "orders"), "o_orderdate")


@query(
    "a11_point_lookup",
    """SELECT l_partkey AS id, count(*) AS asked, any_value(v.label) AS label,
      CASE WHEN any_value(v.vec_id) IS NULL THEN 'not_found' ELSE 'found' END AS status
    FROM lineitem LEFT JOIN embeddings v ON vec_id = l_partkey GROUP BY 1""",
)
def a11(spark, sf):
    asked = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("asked"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return readers.lookup(asked, vectors)


@query(
    "a12_data_dictionary",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{k}' AS dtype, '{d}' AS description"
        for c, k, d in [
            ("doc_id", "bigint", "-"), ("text", "string", "-"), ("lang", "string", "-"),
            ("source", "string", "-"), ("n_chars", "bigint", "-"),
        ]
    ),
)
def a12(spark, sf):
    return data_dictionary(table(spark, sf, "documents"))


# -- finalising --------------------------------------------------------------------------------------


@query("p2_final_rows", prepared_sql("SELECT id, title, genres_text FROM final"))
def p2(spark, sf):
    return final_movies(spark, sf).select("id", "title", "genres_text")


_PAYLOAD_SQL = ", ".join(
    "round(recommendation_quality_score, 6) AS recommendation_quality_score" if c == "recommendation_quality_score"
    else "array_to_string(genres_final_list, ' | ') AS genres_final_list_str" if c == "genres_final_list_str" else c
    for c in PAYLOAD_COLUMNS + OPTIONAL_PAYLOAD_COLUMNS
)


@query("j2_movie_payload", prepared_sql(f"SELECT {_PAYLOAD_SQL} FROM final"))
def j2(spark, sf):
    ready = ready_movies(spark, sf)
    final = finalise(ft.document_table(ready))
    payload = movie_payload(final, ready)
    return payload.withColumn("recommendation_quality_score", F.round("recommendation_quality_score", 6))


@query(
    "j2_enriched_rows",
    sql(CATALOGUE_SQL, select="""SELECT id, c.title, d.lang AS title_enrich, d.n_chars FROM catalogue c
    LEFT JOIN (SELECT doc_id AS id, lang, n_chars FROM documents) d USING (id)"""),
)
def j2_enriched(spark, sf):
    details = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("title"), "n_chars"
    )
    return payloads.enrich(catalogue(spark, sf, "id", "title"), details)


@query(
    "j5_remaining_ids",
    "SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey NOT IN (SELECT doc_id FROM documents)",
)
def j5(spark, sf):
    source = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"))
    return payloads.remaining_ids(source, table(spark, sf, "documents").select(F.col("doc_id").alias("id")))


@query(
    "g16_final_summary",
    prepared_sql(
        """SELECT unnest(['rows_input', 'rows_final', 'rows_removed', 'unique_movies', 'duplicate_ids_final',
          'empty_title_final', 'empty_movie_document_weighted_final', 'empty_genres_text_final',
          'avg_vote_average', 'avg_vote_count', 'avg_popularity', 'avg_recommendation_quality_score',
          'min_release_year', 'max_release_year']) AS metric,
          unnest([r::VARCHAR, n::VARCHAR, (r - n)::VARCHAR, u::VARCHAR, (n - u)::VARCHAR, '0', '0', '0',
            a::VARCHAR, b::VARCHAR, c::VARCHAR, d::VARCHAR, lo::VARCHAR, hi::VARCHAR]) AS value FROM s""",
        """s AS (SELECT (SELECT count(*) FROM ready) AS r, count(*) AS n, count(DISTINCT id) AS u,
          round(avg(vote_average), 4) AS a, round(avg(vote_count), 4) AS b, round(avg(popularity), 4) AS c,
          round(avg(recommendation_quality_score), 4) AS d, min(release_year) AS lo, max(release_year) AS hi
          FROM final)""",
    ),
)
def g16(spark, sf):
    ready = ready_movies(spark, sf)
    return pf.final_summary(ready, finalise(ready))


_RATES = [c for c in pf.SUMMARY_FLAGS]
_NUMBERS = ["vote_average", "vote_count", "popularity", "runtime", "budget", "revenue", "recommendation_quality_score", "movie_document_length"]


@query(
    "g17_preprocessing_summary",
    prepared_sql(
        "SELECT metric, value FROM (SELECT COLUMNS(*)::VARCHAR FROM s) UNPIVOT (value FOR metric IN (COLUMNS(*)))",
        "full_rows AS (SELECT *, length(movie_document_weighted) AS movie_document_length FROM prepared)",
        f"""s AS (SELECT count(*) AS total_rows_preprocessed_full,
          (SELECT count(*) FROM ready) AS total_rows_model_ready,
          (SELECT count(*) FROM ready) AS total_rows_movie_documents,
          count(DISTINCT id) AS unique_movies, count(*) - count(DISTINCT id) AS duplicate_movies,
          {', '.join(f"round({f}({c})::DOUBLE, 4) AS {f}_{c}" for c in _NUMBERS for f in ('avg', 'min', 'max'))},
          {', '.join(f"round(avg({c}), 4) AS rate_{c}" for c in _RATES)} FROM full_rows)""",
    ),
)
def g17(spark, sf):
    full = ft.preprocess(catalogue(spark, sf))
    summary = pf.preprocessing_summary(full)
    other = ["roi", "profit", "metadata_completeness_score"]
    skipped = ["total_columns_preprocessed_full"] + [f"{f}_{c}" for c in other for f in ("avg", "min", "max")]
    return summary.filter(~F.col("metric").isin(skipped))


# -- keep one row per key ----------------------------------------------------------------------------


def _tie():
    return [F.col("l_orderkey"), F.col("l_linenumber")]



def _first_sql(order, columns="id, popularity, vote_count, l_orderkey, l_linenumber"):
    return f"""WITH {_HITS_SQL} SELECT {columns} FROM (SELECT *, row_number() OVER (
      PARTITION BY id ORDER BY {order}, l_orderkey, l_linenumber) AS rn FROM hits) WHERE rn = 1"""


_KEPT = ["id", "popularity", "vote_count", "l_orderkey", "l_linenumber"]


@query("w1_most_complete", _first_sql("recommendation_quality_score DESC NULLS LAST, vote_count DESC NULLS LAST"))
def w1(spark, sf):
    rows = hits(spark, sf).withColumnRenamed("recommendation_quality_score", "metadata_completeness_score")
    return dedupe.most_complete(rows, _tie()).select(*_KEPT)


@query(
    "w2_best_quality",
    _first_sql("recommendation_quality_score DESC NULLS LAST, vote_count DESC NULLS LAST, popularity DESC NULLS LAST"),
)
def w2(spark, sf):
    return dedupe.best_quality(hits(spark, sf), _tie()).orderBy("id").select(*_KEPT)


@query(
    "w3_most_popular",
    f"""WITH {_HITS_SQL} SELECT id, popularity, vote_count, l_orderkey, l_linenumber FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY popularity DESC, vote_count DESC,
      l_orderkey, l_linenumber) AS rn FROM hits) WHERE rn = 1 ORDER BY popularity DESC, vote_count DESC, id LIMIT 500""",
)
def w3(spark, sf):
    return dedupe.most_popular(hits(spark, sf), 500, _tie()).select(*_KEPT)


@query(
    "w4_last_batch",
    f"""WITH {_HITS_SQL} SELECT id, batch, popularity FROM (SELECT *, row_number() OVER (PARTITION BY id
      ORDER BY batch DESC, l_orderkey DESC, l_linenumber DESC) AS rn FROM hits) WHERE rn = 1""",
)
def w4(spark, sf):
    last = dedupe.last_batch(hits(spark, sf), ["batch", "l_orderkey", "l_linenumber"])
    return last.select("id", "batch", "popularity")


@query(
    "w5_first_batch",
    f"""WITH {_HITS_SQL} SELECT id, batch, popularity FROM (SELECT *, row_number() OVER (PARTITION BY id
      ORDER BY batch, l_orderkey, l_linenumber) AS rn FROM hits) WHERE rn = 1""",
)
def w5(spark, sf):
    first = dedupe.first_batch(hits(spark, sf), ["batch", "l_orderkey", "l_linenumber"])
    return first.select("id", "batch", "popularity")


@query("w9_bounded_files", "SELECT count(*) AS total_rows, TRUE AS bounded FROM conversations")
def w9(spark, sf):
    path = scratch_folder(spark) + "/chunks"
    sinks.write_parquet(table(spark, sf, "conversations"), path, rows_per_file=100)
    per_file = (
        spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n"))
    )
    return per_file.agg(F.sum("n").alias("total_rows"), (F.max("n") <= 100).alias("bounded"))


@query(
    "s4_collection_points",
    sql(CATALOGUE_SQL, select="""SELECT id, len(embedding) AS size,
      round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS length,
      title, homepage IS NOT NULL AS has_homepage FROM embeddings JOIN catalogue ON id = vec_id"""),
)
def s4(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    points = sinks.collection_points(vectors, catalogue(spark, sf, "id", "title", "homepage"))
    path = scratch_folder(spark)
    sinks.write_collection(spark, points, path + "/v1")
    sinks.write_collection(spark, points, path + "/v2", current=path + "/v1")
    from marquee.functions.vectors import norm

    return spark.read.parquet(path + "/v2").select(
        "id",
        F.size("unit_vector").cast("bigint").alias("size"),
        F.round(norm("vector"), 4).alias("length"),
        F.get_json_object("payload", "$.title").alias("title"),
        F.get_json_object("payload", "$.homepage").isNotNull().alias("has_homepage"),
    )


@query(
    "s5_appended_rows",
    """SELECT doc_id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark""",
)
def s5(spark, sf):
    path = scratch_folder(spark) + "/log"
    sinks.write_parquet(table(spark, sf, "documents").select("doc_id", "text"), path, mode="append")
    more = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    sinks.write_parquet(more, path, mode="append")
    return spark.read.parquet(path)


@query(
    "s6_long_statistics",
    """SELECT unnest(['documents', 'longest', 'languages', 'nothing']) AS metric,
      unnest([count(*)::VARCHAR, max(n_chars)::VARCHAR, count(DISTINCT lang)::VARCHAR, '']) AS value FROM documents""",
)
def s6(spark, sf):
    from marquee.functions.columns import long_table

    return long_table(
        table(spark, sf, "documents").agg(
            F.count("*").alias("documents"),
            F.max("n_chars").alias("longest"),
            F.countDistinct("lang").alias("languages"),
            F.max(F.lit(None).cast("string")).alias("nothing"),
        )
    )


@query(
    "b30_payload_map",
    prepared_sql("""SELECT id, title, original_language, poster_path FROM final"""),
)
def b30(spark, sf):
    rows = final_movies(spark, sf).select("id", "title", "original_language", "poster_path")
    packed = rows.select("id", payloads.payload_map(rows).alias("payload"))
    fields = ["title", "original_language", "poster_path"]
    return packed.select("id", *(F.get_json_object("payload", f"$.{c}").alias(c) for c in fields))


@query(
    "u1_stacked_batches",
    """SELECT doc_id AS id, text, lang, NULL::VARCHAR AS role FROM documents
    UNION ALL SELECT conv_id, text, NULL, role FROM conversations
    UNION ALL SELECT item_id, text, NULL, NULL FROM benchmark""",
)
def u1(spark, sf):
    return union_all(
        [
            table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang"),
            table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "text", "role"),
            table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"),
        ]
    )
