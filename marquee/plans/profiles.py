"""Profile reports and top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.operators import features as ft
from marquee.operators import profile as pf
from marquee.operators.dedupe import duplicate_keys, duplicate_summary
from marquee.plans.registry import query
from marquee.plans.testbed import catalogue, prepared_sql, profile_sql, table


def eda(spark, sf, *columns):
    return ft.profile_features(catalogue(spark, sf, *columns))


@query(
    "g1_global_profile",
    profile_sql("""SELECT count(*) AS total_rows, count(DISTINCT id) AS unique_movie_id,
      min(release_date_parsed) AS min_release_date, max(release_date_parsed) AS max_release_date,
      min(release_year) AS min_release_year, max(release_year) AS max_release_year,
      min(collected_at) AS min_collected_at, max(collected_at) AS max_collected_at,
      min(enriched_at) AS min_enriched_at, max(enriched_at) AS max_enriched_at FROM eda"""),
)
def g1(spark, sf):
    movies = catalogue(spark, sf, "id", "release_date", "collected_at", "enriched_at")
    return pf.global_profile(ft.with_dates(movies))


@query(
    "g2_duplicate_summary",
    """SELECT count(*) AS total_rows, count(DISTINCT l_partkey) AS unique_ids,
      count(*) - count(DISTINCT l_partkey) AS duplicate_rows_by_id FROM lineitem""",
)
def g2(spark, sf):
    return duplicate_summary(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id")))


@query(
    "g3_duplicate_keys",
    """SELECT l_partkey AS id, count(*) AS count_rows FROM lineitem GROUP BY 1 HAVING count(*) > 1""",
)
def g3(spark, sf):
    return duplicate_keys(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id")))


_KINDS = {
    "id": "n", "title": "s", "overview": "s", "release_date": "s", "genres": "s", "genres_detail": "s",
    "director": "s", "writers": "s", "top_cast": "s", "keywords": "s", "vote_average": "n",
    "vote_count": "n", "popularity": "n", "original_language": "s", "release_year": "n",
    "tagline": "s", "homepage": "s", "poster_path": "s", "backdrop_path": "s", "runtime": "n",
    "budget": "n", "revenue": "n", "roi": "n", "adult": "n", "status": "s",
}


def _missing(columns):
    def condition(c):
        if _KINDS[c] == "n":
            return f"{c} IS NULL"
        return f"{c} IS NULL OR trim({c}) = '' OR lower(trim({c})) IN ('nan', 'none', 'null')"

    return profile_sql(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {condition(c)}) AS missing_count,
            round(count(*) FILTER (WHERE {condition(c)}) * 100.0::DOUBLE / count(*), 2) AS missing_pct FROM eda"""
            for c in columns
        )
    )


@query("g4_missing_values", _missing(list(_KINDS)))
def g4(spark, sf):
    return pf.missing_values(eda(spark, sf).select(*_KINDS))


@query("g4_missing_important", _missing(pf.IMPORTANT_COLUMNS))
def g4_important(spark, sf):
    return pf.missing_values(eda(spark, sf), pf.IMPORTANT_COLUMNS)


@query("g4_missing_recommendation", _missing(pf.RECOMMENDATION_COLUMNS))
def g4_recommendation(spark, sf):
    return pf.missing_values(eda(spark, sf), pf.RECOMMENDATION_COLUMNS)


@query(
    "g5_sanity_counters",
    profile_sql("""SELECT count(*) FILTER (WHERE runtime <= 0) AS runtime_lte_0,
      count(*) FILTER (WHERE vote_average < 0 OR vote_average > 10) AS vote_average_outside_0_10,
      count(*) FILTER (WHERE vote_count < 0) AS vote_count_negative,
      count(*) FILTER (WHERE budget < 0) AS budget_negative,
      count(*) FILTER (WHERE revenue < 0) AS revenue_negative,
      count(*) FILTER (WHERE release_year < 1800) AS release_year_too_old,
      count(*) FILTER (WHERE release_year > 2030) AS release_year_too_future FROM eda"""),
)
def g5(spark, sf):
    movies = catalogue(
        spark, sf, "id", "runtime", "vote_average", "vote_count", "budget", "revenue", "release_date"
    )
    return pf.sanity_counters(ft.with_dates(movies))


@query(
    "g6_describe",
    profile_sql(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean,
            round(stddev_samp({c}), 4) AS stddev, round(min({c})::DOUBLE, 4) AS min,
            round(max({c})::DOUBLE, 4) AS max FROM eda"""
            for c in pf.NUMERIC_COLUMNS
        )
    ),
)
def g6(spark, sf):
    return pf.describe(eda(spark, sf))


_QUANTILES = ", ".join(
    f"quantile_disc({{c}}::DOUBLE, {p}) AS q{int(p * 100):02d}" for p in pf.QUANTILES
)


@query(
    "g7_quantiles",
    profile_sql(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", {_QUANTILES.format(c=c)} FROM eda""" for c in pf.NUMERIC_COLUMNS
        )
    ),
)
def g7(spark, sf):
    return pf.quantiles(eda(spark, sf))


def _group_count(name, key, known=True):
    where = f"WHERE {key} IS NOT NULL" if known else ""

    @query(name, profile_sql(f"SELECT {key}, count(*) AS movie_count FROM eda {where} GROUP BY {key}"))
    def run(spark, sf):
        source = "runtime" if key == "runtime_category" else "release_date"
        if key == "original_language":
            return pf.count_by_with_unknown(catalogue(spark, sf, "id", key), key)
        movies = catalogue(spark, sf, "id", source)
        if key == "runtime_category":
            movies = movies.withColumn(key, ft.runtime_category(F.col("runtime")))
        else:
            movies = ft.with_dates(movies)
        return pf.count_by(movies, key)

    return run


_group_count("g8_movies_per_year", "release_year")
_group_count("g8_movies_per_decade", "release_decade")
_group_count("g8_movies_per_month", "release_month")
_group_count("g8_movies_per_language", "original_language", known=False)
_group_count("g8_movies_per_runtime_category", "runtime_category")


@query("g8_movies_per_era", prepared_sql("SELECT movie_era, count(*) AS movie_count FROM prepared GROUP BY 1"))
def g8_era(spark, sf):
    movies = ft.with_dates(ft.keep_usable(catalogue(spark, sf, "id", "title", "adult", "release_date")))
    return pf.count_by(movies.withColumn("movie_era", ft.movie_era(F.col("release_year"))), "movie_era")


def _exploded(source, item, pattern="\\s*\\|\\s*", fold=False):
    value = f"lower({source})" if fold else source
    return f"""items AS (SELECT * FROM (SELECT id, release_decade, vote_average, vote_count, popularity,
      trim(unnest(string_split_regex(coalesce({value}, ''), '{pattern}'))) AS {item} FROM eda) WHERE {item} <> '')"""


_COMMAS = "\\s*\\|\\s*|\\s*,\\s*"


def _entity_count(name, source, item, n, commas=False, fold=False):
    oracle = profile_sql(
        f"SELECT {item}, count(DISTINCT id) AS movie_count FROM items GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {n}",
        _exploded(source, item, _COMMAS if commas else "\\s*\\|\\s*", fold),
    )

    @query(name, oracle)
    def run(spark, sf):
        return pf.entity_counts(catalogue(spark, sf, "id", source), source, item, n, commas, fold)

    return run


_entity_count("g9_top_genres", "genres_detail", "genre", 25, commas=True)
_entity_count("g9_top_countries", "production_countries", "production_country", 25)
_entity_count("g9_top_companies", "production_companies", "production_company", 25)
_entity_count("g9_top_keywords", "keywords", "keyword", 50, fold=True)

_STATS = """count(DISTINCT id) AS movie_count, round(avg(vote_average), 6) AS avg_vote_average,
  round(avg(vote_count), 6) AS avg_vote_count, round(avg(popularity), 6) AS avg_popularity"""
_STAT_COLUMNS = ("id", "vote_average", "vote_count", "popularity")


def _entity_statistics(name, source, item, n=30, at_least=1, by="movie_count", commas=False):
    oracle = profile_sql(
        f"SELECT {item}, {_STATS} FROM items GROUP BY 1 HAVING count(DISTINCT id) >= {at_least} "
        f"ORDER BY {by} DESC, {item} LIMIT {n}",
        _exploded(source, item, _COMMAS if commas else "\\s*\\|\\s*"),
    )

    @query(name, oracle)
    def run(spark, sf):
        movies = catalogue(spark, sf, *_STAT_COLUMNS, source)
        stats = pf.entity_statistics(movies, source, item, at_least, commas, digits=6)
        return stats.orderBy(F.desc(by), item).limit(n)

    return run


_entity_statistics("g10_director_statistics", "director", "director_name")
_entity_statistics("g10_cast_statistics", "top_cast", "actor_name")
_entity_statistics("g10_writer_statistics", "writers", "writer_name")
_entity_statistics("g11_director_ratings", "director", "director_name", at_least=5, by="avg_vote_average")
_entity_statistics(
    "g11_genre_ratings", "genres_detail", "genre", n=1000, at_least=100, by="avg_vote_average", commas=True
)


@query(
    "g11_language_ratings",
    profile_sql(f"SELECT original_language, {_STATS} FROM eda GROUP BY 1 HAVING count(*) >= 100"),
)
def g11_language(spark, sf):
    movies = catalogue(spark, sf, *_STAT_COLUMNS, "original_language")
    return pf.group_statistics(movies, "original_language", 100, digits=6)


@query(
    "g12_decade_by_genre",
    profile_sql(
        """SELECT release_decade, genre, count(DISTINCT id) AS movie_count FROM items
        WHERE release_decade IS NOT NULL GROUP BY 1, 2""",
        _exploded("genres_detail", "genre", _COMMAS),
    ),
)
def g12(spark, sf):
    movies = ft.with_dates(catalogue(spark, sf, "id", "release_date", "genres_detail"))
    return pf.decade_by_item(movies, "genres_detail", "genre", commas=True)


@query(
    "g13_finance_availability",
    profile_sql("""SELECT count(*) AS total_movies, CAST(sum(has_budget) AS BIGINT) AS movies_with_budget,
      CAST(sum(has_revenue) AS BIGINT) AS movies_with_revenue,
      CAST(sum(has_budget_revenue) AS BIGINT) AS movies_with_budget_and_revenue,
      round(sum(has_budget) * 100.0::DOUBLE / count(*), 2) AS budget_pct,
      round(sum(has_revenue) * 100.0::DOUBLE / count(*), 2) AS revenue_pct,
      round(sum(has_budget_revenue) * 100.0::DOUBLE / count(*), 2) AS budget_revenue_pct FROM eda"""),
)
def g13(spark, sf):
    return pf.finance_availability(ft.with_finance(catalogue(spark, sf, "id", "budget", "revenue")))


def _correlations(value):
    return profile_sql(
        " UNION ALL ".join(
            f"""SELECT '{a}' AS column_a, '{b}' AS column_b,
            round(corr({value.format(c=a)}, {value.format(c=b)}), 6) AS correlation FROM eda"""
            for a in pf.CORRELATED_COLUMNS
            for b in pf.CORRELATED_COLUMNS
        )
    )


@query("g14_correlations", _correlations("coalesce({c}::DOUBLE, 0)"))
def g14(spark, sf):
    return pf.correlations(eda(spark, sf))


@query("g14_correlations_known_pairs", _correlations("{c}::DOUBLE"))
def g14_known(spark, sf):
    return pf.correlations(eda(spark, sf), nulls_as_zero=False)


@query(
    "g15_quality_tiers",
    profile_sql("""SELECT count(*) AS total_movies,
      count(*) FILTER (WHERE metadata_completeness_score >= 0.8) AS score_gte_0_8,
      count(*) FILTER (WHERE metadata_completeness_score >= 0.6) AS score_gte_0_6,
      round(avg(metadata_completeness_score), 6) AS avg_metadata_completeness_score FROM eda"""),
)
def g15(spark, sf):
    return pf.quality_tiers(eda(spark, sf))


@query(
    "g22_normalisation_maxima",
    prepared_sql("""SELECT greatest(max(vote_average), 1.0) AS max_vote_average,
      greatest(max(vote_count)::DOUBLE, 1.0) AS max_vote_count, greatest(max(popularity), 1.0) AS max_popularity,
      greatest(max(recommendation_quality_score), 1.0) AS max_quality,
      round(coalesce(nullif(max(ln(1 + vote_count)), 0), 1.0), 6) AS max_log_vote_count,
      round(coalesce(nullif(max(ln(1 + popularity)), 0), 1.0), 6) AS max_log_popularity,
      round(coalesce(nullif(max(recommendation_quality_score), 0), 1.0), 6) AS max_quality_score FROM final"""),
)
def g22(spark, sf):
    from marquee.operators.ranking import linear_maxima, log_maxima
    from marquee.plans.sources import final_movies

    movies = final_movies(spark, sf)
    logs = log_maxima(movies)
    return linear_maxima(movies).select(
        "*", *(F.round(logs.select(c).scalar(), 6).alias(c) for c in logs.columns)
    )


def _histogram(name, value, sql_value, bins, columns, where="TRUE", prepare=lambda df: df, source="eda"):
    oracle = profile_sql(
        f"""SELECT bin, round(lo + (hi - lo) / {bins} * bin, 6) AS bin_start,
        round(lo + (hi - lo) / {bins} * (bin + 1), 6) AS bin_end, coalesce(frequency, 0) AS frequency
        FROM edges LEFT JOIN counts USING (bin)""",
        f"vals AS (SELECT CAST({sql_value} AS DOUBLE) AS x FROM eda WHERE {where} AND {sql_value} IS NOT NULL)",
        "bounds AS (SELECT min(x) AS lo, max(x) AS hi FROM vals)",
        f"""counts AS (SELECT CAST(least(floor((x - lo) / ((hi - lo) / {bins})), {bins - 1}) AS INTEGER) AS bin,
        count(*) AS frequency FROM vals, bounds GROUP BY 1)""",
        f"edges AS (SELECT lo, hi, CAST(unnest(range({bins})) AS INTEGER) AS bin FROM bounds)",
    )

    @query(name, oracle)
    def run(spark, sf):
        return pf.histogram(prepare(catalogue(spark, sf, *columns)), value(), bins)

    return run


_histogram("g24_histogram_rating", lambda: "vote_average", "vote_average", 40, ["id", "vote_average"])
_histogram(
    "g24_histogram_runtime", lambda: "runtime", "runtime", 50, ["id", "runtime"],
    where="runtime > 0 AND runtime <= 300",
    prepare=lambda df: df.filter((F.col("runtime") > 0) & (F.col("runtime") <= 300)),
)
_histogram(
    "g24_histogram_document_length", lambda: F.length(ft.plain_document()),
    f"length(concat_ws(' ', coalesce(title, ''), coalesce(overview, ''), coalesce(genres_detail, coalesce(genres, '')), "
    "coalesce(director, ''), coalesce(writers, ''), coalesce(top_cast, ''), coalesce(keywords, ''), "
    "coalesce(original_language, ''), coalesce(CAST(release_year AS VARCHAR), '')))",
    50,
    ["id", "title", "overview", "genres_detail", "genres", "director", "writers", "top_cast", "keywords",
     "original_language", "release_date"],
    prepare=ft.with_dates,
)
_histogram(
    "g24_histogram_completeness", lambda: F.round("metadata_completeness_score", 9),
    "round(metadata_completeness_score, 9)", 20, [], prepare=ft.profile_features,
)
for _name, _value, _bins, _where, _prepare in [
    ("vote_count", "vote_count", 50, "TRUE", lambda df: df),
    ("popularity", "popularity", 50, "TRUE", lambda df: df),
    ("budget", "budget", 50, "budget > 0 AND revenue > 0", lambda df: df.filter("budget > 0 AND revenue > 0")),
    ("revenue", "revenue", 50, "budget > 0 AND revenue > 0", lambda df: df.filter("budget > 0 AND revenue > 0")),
]:
    _histogram(
        f"g24_histogram_log_{_name}", lambda c=_value: F.round(F.log1p(c), 9), f"round(ln(1 + {_value}), 9)", _bins,
        ["id", _value] if _name not in ("budget", "revenue") else ["id", "budget", "revenue"],
        where=_where, prepare=_prepare,
    )


@query("g26_row_profile", "SELECT count(*) AS total_rows, true AS has_partitions, true AS bounds_hold FROM lineitem")
def g26(spark, sf):
    """How many partitions there are is up to the cluster; that they account for all rows is not."""
    profile = pf.partition_profile(table(spark, sf, "lineitem"))
    bounds = (F.col("partitions") * F.col("smallest") <= F.col("total_rows")) & (F.col("total_rows") <= F.col("partitions") * F.col("largest"))
    return profile.select("total_rows", (F.col("partitions") > 0).alias("has_partitions"), bounds.alias("bounds_hold"))


_FINANCE = ["id", "title", "release_year", "genres_detail", "budget", "revenue", "profit", "roi", "vote_average", "vote_count", "popularity"]
_PEOPLE = ["id", "title", "release_year", "genres_detail", "director", "top_cast", "popularity", "vote_average", "vote_count"]
_FINANCE_SOURCES = ["id", "title", "release_date", "genres_detail", "budget", "revenue", "vote_average", "vote_count", "popularity"]
_PEOPLE_SOURCES = ["id", "title", "release_date", "genres_detail", "director", "top_cast", "popularity", "vote_average", "vote_count"]


def _top_finance(name, by, where="TRUE"):
    columns = ", ".join(f"round({c}, 4) AS {c}" if c in ("profit", "roi", "revenue", "budget") else c for c in _FINANCE)
    oracle = profile_sql(
        f"SELECT {columns} FROM (SELECT * FROM eda WHERE has_budget_revenue = 1 AND {where} ORDER BY {by} DESC, id LIMIT 20)"
    )

    @query(name, oracle)
    def run(spark, sf):
        movies = ft.with_finance(ft.with_dates(catalogue(spark, sf, *_FINANCE_SOURCES)))
        both = movies.filter((F.col("has_budget_revenue") == 1) & F.expr(where))
        listed = pf.top(both, [F.desc(by)], 20, _FINANCE)
        return listed.withColumns({c: F.round(c, 4) for c in ("profit", "roi", "revenue", "budget")})

    return run


_top_finance("t1_top_revenue", "revenue")
_top_finance("t1_top_profit", "profit")
_top_finance("t1_top_roi", "roi", "budget >= 100000")


def _top_people(name, order, where="TRUE"):
    oracle = profile_sql(
        f"SELECT {', '.join(_PEOPLE)} FROM eda WHERE {where} ORDER BY {', '.join(f'{c} DESC' for c in order)}, id LIMIT 20"
    )

    @query(name, oracle)
    def run(spark, sf):
        movies = ft.with_dates(catalogue(spark, sf, *_PEOPLE_SOURCES)).filter(where)
        return pf.top(movies, [F.desc(c) for c in order], 20, _PEOPLE)

    return run


_top_people("t2_top_popularity", ["popularity"])
_top_people("t2_top_rating", ["vote_average", "vote_count"], "vote_count >= 1000")
_top_people("t2_top_votes", ["vote_count"])


@query(
    "t3_shortest_documents",
    prepared_sql("""SELECT id, title, CAST(length(movie_document_weighted) AS INTEGER) AS movie_document_length
      FROM prepared ORDER BY length(movie_document_weighted), id LIMIT 10"""),
)
def t3_shortest(spark, sf):
    movies = ft.preprocess(catalogue(spark, sf))
    return pf.top(movies, [F.asc("movie_document_length")], 10, ["id", "title", "movie_document_length"])


@query(
    "t3_least_complete",
    profile_sql("""SELECT id, title, round(metadata_completeness_score, 6) AS metadata_completeness_score
      FROM eda ORDER BY round(metadata_completeness_score, 6), id LIMIT 20"""),
)
def t3_least(spark, sf):
    score = F.round("metadata_completeness_score", 6)
    movies = eda(spark, sf).withColumn("metadata_completeness_score", score)
    return pf.top(
        movies, [F.asc("metadata_completeness_score")], 20, ["id", "title", "metadata_completeness_score"]
    )


@query(
    "t8_hash_sample",
    profile_sql("""SELECT id, round(ln(1 + popularity), 6) AS log_popularity,
      round(ln(1 + vote_count), 6) AS log_vote_count, vote_average FROM eda
      WHERE popularity IS NOT NULL AND vote_count IS NOT NULL AND vote_average IS NOT NULL
        AND CAST('0x' || substr(md5(id || ':42'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.2"""),
)
def t8(spark, sf):
    movies = catalogue(spark, sf, "id", "popularity", "vote_count", "vote_average").dropna()
    return pf.hash_sample(movies, "id", 0.2).select(
        "id",
        F.round(F.log1p("popularity"), 6).alias("log_popularity"),
        F.round(F.log1p("vote_count"), 6).alias("log_vote_count"),
        "vote_average",
    )


_INSIGHT = profile_sql(
    """SELECT 1 AS line, format('The catalogue has {:,} rows and {:,} movies.', n, u) AS finding FROM s
    UNION ALL SELECT 2, format('Release years run from {} to {}.', lo, hi) FROM s
    UNION ALL SELECT 3, 'The most common genre is "' || genre || '".' FROM g
    UNION ALL SELECT 4, 'The most common language is "' || language || '".' FROM l
    UNION ALL SELECT 5, format('{:,} movies ({:.2f}%) have budget and revenue.', f, share) FROM s
    UNION ALL SELECT 6, format('The mean completeness score is {:.3f}.', score) FROM s""",
    _exploded("genres_detail", "genre", _COMMAS),
    """s AS (SELECT count(*) AS n, count(DISTINCT id) AS u, min(release_year) AS lo, max(release_year) AS hi,
      CAST(sum(has_budget_revenue) AS BIGINT) AS f,
      round(sum(has_budget_revenue) * 100.0::DOUBLE / count(*), 2) AS share,
      round(avg(metadata_completeness_score), 3) AS score FROM eda)""",
    "g AS (SELECT genre FROM items GROUP BY 1 ORDER BY count(DISTINCT id) DESC, 1 LIMIT 1)",
    """l AS (SELECT coalesce(original_language, '-') AS language FROM (SELECT original_language FROM eda
      GROUP BY 1 ORDER BY count(*) DESC, 1 NULLS LAST LIMIT 1))""",
)


@query("s8_insight_report", _INSIGHT)
def s8(spark, sf):
    return pf.insight_report(eda(spark, sf))


@query(
    "b25_profile_table",
    profile_sql("""SELECT id, title, release_year, release_decade, runtime_category, round(profit, 4) AS profit,
      round(roi, 6) AS roi, round(metadata_completeness_score, 6) AS metadata_completeness_score FROM eda"""),
)
def b25_profile(spark, sf):
    return eda(spark, sf).select(
        "id", "title", "release_year", "release_decade", "runtime_category",
        F.round("profit", 4).alias("profit"), F.round("roi", 6).alias("roi"),
        F.round("metadata_completeness_score", 6).alias("metadata_completeness_score"),
    )
