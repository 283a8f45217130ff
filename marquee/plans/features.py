"""Casts, derived columns, cleaning, documents and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions.columns import defaults, first_available, present, project
from marquee.functions.strings import clean, item_count, items, normalise_title
from marquee.operators import features as ft
from marquee.plans.registry import query
from marquee.plans.testbed import CATALOGUE_SQL, catalogue, prepared_sql, profile_sql, sql, table


def strict_digits(df, *columns, digits=6):
    """Round the named double columns, so that both engines print the same."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


_LIST = "array_to_string({c}, ';') AS {c}"


@query(
    "b1_snake_case_columns",
    """SELECT p_partkey AS movie_id, p_name AS movie_title, p_size AS size_of_part,
       p_retailprice AS retail_price FROM part""",
)
def b1(spark, sf):
    raw = table(spark, sf, "part").select(
        F.col("p_partkey").alias(" Movie ID"),
        F.col("p_name").alias("Movie--Title!"),
        F.col("p_size").alias("size  of (part)"),
        F.col("p_retailprice").alias("Retail_Price"),
    )
    return ft.snake_case_columns(raw)


@query(
    "b2_cast_columns",
    sql(CATALOGUE_SQL, select="""
    SELECT id, TRY_CAST(release_date AS DOUBLE) AS vote_average,
      TRY_CAST(coalesce(homepage, id::VARCHAR) AS BIGINT) AS vote_count, runtime,
      TRY_CAST(release_date AS DATE) AS release_date_parsed,
      TRY_CAST(collected_at AS TIMESTAMP) AS collected_at_ts FROM catalogue"""),
)
def b2(spark, sf):
    movies = catalogue(spark, sf, "id", "release_date", "homepage", "runtime", "collected_at")
    as_text = movies.select(
        F.col("id").cast("string").alias("id"),
        F.col("release_date").alias("vote_average"),
        F.coalesce("homepage", F.col("id").cast("string")).alias("vote_count"),
        F.col("runtime").cast("string").alias("runtime"),
        "release_date",
        "collected_at",
    )
    return ft.cast_columns(as_text).drop("release_date", "collected_at")


@query(
    "b3_dates_and_times",
    sql(CATALOGUE_SQL, select="""
    SELECT id, TRY_CAST(release_date AS DATE) AS release_date_parsed,
      TRY_CAST(source_start_date AS DATE) AS source_start_date_parsed,
      TRY_CAST(enriched_at AS TIMESTAMP) AS enriched_at_ts FROM catalogue"""),
)
def b3(spark, sf):
    movies = catalogue(spark, sf, "id", "release_date", "source_start_date", "enriched_at")
    return ft.cast_columns(movies).select(
        "id", "release_date_parsed", "source_start_date_parsed", "enriched_at_ts"
    )


@query(
    "b5_default_columns",
    sql(CATALOGUE_SQL, select="""
    SELECT id, coalesce(homepage, '') AS homepage, coalesce(runtime, 0.0::DOUBLE) AS runtime,
      0.0::DOUBLE AS roi, '' AS writers FROM catalogue"""),
)
def b5(spark, sf):
    movies = catalogue(spark, sf, "id", "homepage", "runtime")
    return defaults(movies, {"homepage": "", "runtime": 0.0, "roi": 0.0, "writers": ""})


@query(
    "b6_repair_ranges",
    """SELECT l_orderkey, l_linenumber,
      CASE WHEN (l_discount - 0.02) * 200 BETWEEN 0 AND 10 THEN (l_discount - 0.02) * 200 END AS vote_average,
      CAST(CASE WHEN l_quantity - 10 < 0 THEN 0 ELSE l_quantity - 10 END AS BIGINT) AS vote_count
    FROM lineitem""",
)
def b6(spark, sf):
    raw = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        ((F.col("l_discount") - 0.02) * 200).alias("vote_average"),
        (F.col("l_quantity") - 10).cast("bigint").alias("vote_count"),
    )
    return ft.repair_ranges(raw)


@query(
    "b7_release_parts",
    profile_sql("SELECT id, release_year, release_month, release_decade FROM eda"),
)
def b7(spark, sf):
    return ft.with_dates(catalogue(spark, sf, "id", "release_date")).select(
        "id", "release_year", "release_month", "release_decade"
    )


@query(
    "b8_finance_columns",
    profile_sql("""SELECT id, has_budget, has_revenue, has_budget_revenue, round(profit, 4) AS profit,
      round(roi, 6) AS roi FROM eda"""),
)
def b8(spark, sf):
    movies = ft.with_finance(catalogue(spark, sf, "id", "budget", "revenue")).drop("budget", "revenue")
    return movies.withColumns({"profit": F.round("profit", 4), "roi": F.round("roi", 6)})


_FLAGS = [
    "has_overview", "has_tagline", "has_homepage", "has_poster", "has_backdrop", "has_genre",
    "has_director", "has_top_cast", "has_keywords", "has_runtime_valid", "has_vote_count_valid",
    "has_release_date",
]


@query("b9_presence_flags", profile_sql(f"SELECT id, {', '.join(_FLAGS)} FROM eda"))
def b9(spark, sf):
    movies = catalogue(
        spark, sf, "id", "overview", "tagline", "homepage", "poster_path", "backdrop_path", "genres",
        "genres_detail", "director", "top_cast", "keywords", "runtime", "vote_count", "release_date",
    )
    return ft.with_completeness(ft.with_presence(ft.with_dates(movies))).select("id", *_FLAGS)


@query(
    "b10_text_lengths",
    profile_sql("SELECT id, overview_length, tagline_length, title_length FROM eda"),
)
def b10(spark, sf):
    movies = catalogue(spark, sf, "id", "overview", "tagline", "title")
    return ft.with_lengths(movies).drop("overview", "tagline", "title")


_COUNTS = [f"{c}_count" for c in ft.COUNTED_LISTS]


@query("b11_item_counts", profile_sql(f"SELECT id, {', '.join(_COUNTS)} FROM eda"))
def b11(spark, sf):
    return ft.with_item_counts(catalogue(spark, sf, "id", *ft.COUNTED_LISTS)).select("id", *_COUNTS)


def _prepared(spark, sf):
    return ft.preprocess(catalogue(spark, sf))


@query(
    "b12_availability_flags",
    prepared_sql("""SELECT id, is_overview_available, is_genre_available, is_director_available,
      is_cast_available, is_keyword_available FROM prepared"""),
)
def b12(spark, sf):
    movies = catalogue(
        spark, sf, "id", "title", "adult", "overview", "genres", "genres_detail", "director",
        "top_cast", "keywords",
    )
    flagged = ft.with_availability(ft.fill_texts(ft.keep_usable(movies)))
    return flagged.select("id", *(c for c in flagged.columns if c.startswith("is_")))


@query(
    "b13_validity_flags",
    prepared_sql("SELECT id, budget_valid, revenue_valid, runtime_valid, vote_count_valid FROM prepared"),
)
def b13(spark, sf):
    movies = catalogue(spark, sf, "id", "title", "adult", "budget", "revenue", "runtime", "vote_count")
    return ft.with_validity(ft.keep_usable(movies)).select(
        "id", "budget_valid", "revenue_valid", "runtime_valid", "vote_count_valid"
    )


@query(
    "b14_log_columns",
    prepared_sql("""SELECT id, round(ln(1 + popularity), 6) AS log_popularity,
      round(ln(1 + vote_count), 6) AS log_vote_count, round(ln(1 + budget), 6) AS log_budget,
      round(ln(1 + revenue), 6) AS log_revenue, round(ln(1 + runtime), 6) AS log_runtime FROM prepared"""),
)
def b14(spark, sf):
    movies = catalogue(
        spark, sf, "id", "title", "adult", "popularity", "vote_count", "budget", "revenue", "runtime"
    )
    filled = defaults(ft.keep_usable(movies), {"runtime": 0.0})
    logs = ["log_popularity", "log_vote_count", "log_budget", "log_revenue", "log_runtime"]
    return strict_digits(ft.with_logs(filled).select("id", *logs), *logs)


@query(
    "b14_finance_logs",
    profile_sql("""SELECT id, round(ln(1 + budget), 6) AS log_budget, round(ln(1 + revenue), 6) AS log_revenue,
      round(ln(1 + abs(profit)), 6) AS log_profit_abs FROM eda WHERE has_budget_revenue = 1"""),
)
def b14_finance(spark, sf):
    movies = ft.with_finance_logs(ft.with_finance(catalogue(spark, sf, "id", "budget", "revenue")))
    logs = ["log_budget", "log_revenue", "log_profit_abs"]
    return strict_digits(movies.select("id", *logs), *logs)


@query("b15_movie_era", prepared_sql("SELECT id, release_year, movie_era FROM prepared"))
def b15(spark, sf):
    movies = ft.with_dates(ft.keep_usable(catalogue(spark, sf, "id", "title", "adult", "release_date")))
    return movies.select("id", "release_year", ft.movie_era(F.col("release_year")).alias("movie_era"))


@query("b16_runtime_category", profile_sql("SELECT id, runtime_category FROM eda"))
def b16(spark, sf):
    movies = catalogue(spark, sf, "id", "runtime")
    return movies.select("id", ft.runtime_category(F.col("runtime")).alias("runtime_category"))


@query(
    "b17_completeness_score",
    profile_sql("SELECT id, round(metadata_completeness_score, 6) AS metadata_completeness_score FROM eda"),
)
def b17(spark, sf):
    movies = ft.profile_features(catalogue(spark, sf))
    return strict_digits(movies.select("id", "metadata_completeness_score"), "metadata_completeness_score")


@query(
    "b18_quality_score",
    prepared_sql("SELECT id, round(recommendation_quality_score, 6) AS recommendation_quality_score FROM prepared"),
)
def b18(spark, sf):
    movies = _prepared(spark, sf).select("id", "recommendation_quality_score")
    return strict_digits(movies, "recommendation_quality_score")


@query(
    "b19_clean_catalogue_texts",
    prepared_sql(f"SELECT id, {', '.join(f'{c}_clean' for c in ft.CLEANED_COLUMNS)} FROM prepared"),
)
def b19(spark, sf):
    return _prepared(spark, sf).select("id", *(f"{c}_clean" for c in ft.CLEANED_COLUMNS))


@query(
    "b19_clean_documents",
    """SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text),
      '[^a-z0-9\\s|\\-]', ' ', 'g'), '\\s+', ' ', 'g'), '\\s*\\|\\s*', ' | ', 'g')) AS text_clean
    FROM documents""",
)
def b19_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", clean("text").alias("text_clean"))


_LISTS = list(ft.LIST_COLUMNS)


@query(
    "b20_lists",
    prepared_sql(f"SELECT id, {', '.join(_LIST.format(c=c) for c in _LISTS)} FROM prepared"),
)
def b20(spark, sf):
    movies = _prepared(spark, sf)
    return movies.select("id", *(F.concat_ws(";", c).alias(c) for c in _LISTS))


@query(
    "b21_genre_fallback",
    prepared_sql(f"SELECT id, len(genres_list) AS detail_items, {_LIST.format(c='genres_final_list')} FROM prepared"),
)
def b21(spark, sf):
    return _prepared(spark, sf).select(
        "id",
        F.size("genres_list").cast("bigint").alias("detail_items"),
        F.concat_ws(";", "genres_final_list").alias("genres_final_list"),
    )


@query("b22_list_texts", prepared_sql(f"SELECT id, {', '.join(ft.LIST_TEXTS)} FROM prepared"))
def b22(spark, sf):
    return _prepared(spark, sf).select("id", *ft.LIST_TEXTS)


@query(
    "b23_documents",
    prepared_sql("""SELECT id, movie_document_basic, movie_document_rich, movie_document_weighted,
      CAST(length(movie_document_weighted) AS INTEGER) AS movie_document_length FROM prepared"""),
)
def b23(spark, sf):
    return _prepared(spark, sf).select("id", *ft.DOCUMENT_FIELDS, "movie_document_length")


_PLAIN = [
    "coalesce(title, '')", "coalesce(overview, '')", "coalesce(genres_detail, coalesce(genres, ''))",
    "coalesce(director, '')", "coalesce(writers, '')", "coalesce(top_cast, '')",
    "coalesce(keywords, '')", "coalesce(original_language, '')",
    "coalesce(CAST(release_year AS VARCHAR), '')",
]
_LABELS = ["Title", "Overview", "Genres", "Director", "Writers", "Cast", "Keywords", "Language", "Year"]


@query(
    "b24_labelled_document",
    profile_sql(f"""SELECT id, title, concat_ws(' ', {', '.join(f"'{k}: ' || {v}" for k, v in zip(_LABELS, _PLAIN))})
      AS movie_document, CAST(length(concat_ws(' ', {', '.join(_PLAIN)})) AS INTEGER) AS movie_document_length
    FROM eda"""),
)
def b24(spark, sf):
    movies = ft.with_dates(
        catalogue(
            spark, sf, "id", "title", "overview", "genres_detail", "genres", "director", "writers",
            "top_cast", "keywords", "original_language", "release_date",
        )
    )
    return movies.select(
        "id",
        "title",
        ft.labelled_document().alias("movie_document"),
        F.length(ft.plain_document()).alias("movie_document_length"),
    )


_DOCUMENT = [c for c in ft.DOCUMENT_COLUMNS if c not in ("recommendation_quality_score", "release_date")]


@query(
    "b25_document_table",
    prepared_sql(f"SELECT {', '.join(_DOCUMENT)}, round(recommendation_quality_score, 6) AS recommendation_quality_score, coalesce(release_date, '') AS release_date FROM ready"),
)
def b25(spark, sf):
    documents = ft.document_table(ft.model_ready(_prepared(spark, sf)))
    return strict_digits(documents, "recommendation_quality_score").withColumn(
        "release_date", F.coalesce("release_date", F.lit(""))
    )


@query(
    "b26_modelling_base",
    prepared_sql("""SELECT id, title, movie_document_weighted AS movie_document, release_year, genres_text,
      director_clean, vote_average, CAST(vote_count AS DOUBLE) AS vote_count, popularity, runtime,
      round(recommendation_quality_score, 6) AS recommendation_quality_score
      FROM ready WHERE length(trim(movie_document_weighted)) > 0"""),
)
def b26(spark, sf):
    base = ft.modelling_base(ft.document_table(ft.model_ready(_prepared(spark, sf))))
    return strict_digits(base, "recommendation_quality_score")


@query(
    "b28_normalised_titles",
    """SELECT p_partkey AS id,
      trim(regexp_replace(lower('  ' || p_name || E'\\t ' || p_type || ' '), '\\s+', ' ', 'g')) AS title_normalised
    FROM part""",
)
def b28(spark, sf):
    messy = F.concat(F.lit("  "), "p_name", F.lit("\t "), "p_type", F.lit(" "))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), normalise_title(messy).alias("title_normalised")
    )


# -- row filters -------------------------------------------------------------------------------------


@query(
    "p1_usable_rows",
    sql(CATALOGUE_SQL, select="""SELECT id, title, adult FROM catalogue
    WHERE id IS NOT NULL AND length(trim(title)) > 0 AND (NOT adult OR adult IS NULL)"""),
)
def p1(spark, sf):
    return ft.keep_usable(catalogue(spark, sf, "id", "title", "adult"))


@query("p3_model_ready", prepared_sql("SELECT id, movie_document_length FROM ready"))
def p3(spark, sf):
    return ft.model_ready(_prepared(spark, sf)).select("id", "movie_document_length")


@query(
    "p10_listing_variants",
    sql(CATALOGUE_SQL, select="""SELECT v.source_config, c.id, c.vote_count FROM catalogue c
    JOIN (VALUES ('vote10', 10), ('vote0', 0)) v(source_config, floor) ON c.vote_count >= v.floor"""),
)
def p10(spark, sf):
    from marquee.sources.payloads import LISTING_VARIANTS, listing_variants

    movies = catalogue(spark, sf, "id", "vote_count")
    return listing_variants(movies, LISTING_VARIANTS).select("source_config", "id", "vote_count")


@query(
    "s7_exported_lists",
    prepared_sql(f"SELECT id, {', '.join(f'''array_to_string({c}, ' | ') AS {c}_str''' for c in ft.EXPORTED_LISTS)} FROM prepared"),
)
def s7(spark, sf):
    movies = ft.export_lists(_prepared(spark, sf))
    return movies.select("id", *(f"{c}_str" for c in ft.EXPORTED_LISTS))
