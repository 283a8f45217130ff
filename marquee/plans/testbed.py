"""A movie-like catalogue derived from the given tables, once for Spark and once as SQL.

One movie per ``part`` row. Ratings, votes, money and dates are aggregates of
its ``lineitem`` rows, people and countries come from its suppliers, texts from
``documents``. Gaps (blank, NULL, malformed) follow the part's size and type.
Only the joins that the wanted columns need are planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marquee.functions.columns import never_broadcast
from marquee.operators.dedupe import top_per_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SALES = [
    "vote_average", "vote_count", "popularity", "revenue", "release_date", "writers",
    "production_companies", "spoken_languages", "source_config", "source_start_date",
    "source_end_date", "collected_at", "enriched_at",
]
_TEXTS = ["overview", "original_language"]
#: Tasks that the sales of one part are dealt over.
_DEALT = 4

COLUMNS = [
    "id", "title", "original_title", "original_language", "overview", "release_date", "genre_ids",
    "genres", "popularity", "vote_average", "vote_count", "adult", "video", "poster_path",
    "backdrop_path", "source_config", "source_start_date", "source_end_date", "source_page",
    "collected_at", "runtime", "status", "tagline", "budget", "revenue", "imdb_id", "homepage",
    "genres_detail", "production_companies", "production_countries", "spoken_languages",
    "director", "writers", "top_cast", "keywords", "enriched_at",
]


def _part_columns() -> dict[str, Column]:
    size, name, kind, brand, key = (
        F.col(c) for c in ("p_size", "p_name", "p_type", "p_brand", "p_partkey")
    )
    key_text = key.cast("string")
    word = F.split(name, " ")[0]
    return {
        "id": key,
        "title": F.when(size <= 12, F.concat_ws(" ", name, key_text)).otherwise(name),
        "original_title": F.concat(name, F.lit(" ("), brand, F.lit(")")),
        "genre_ids": F.concat_ws(",", size.cast("string"), F.length(kind).cast("string")),
        "genres": F.concat_ws(", ", kind, word),
        "adult": F.when(size == 3, True).when(size == 4, None).otherwise(False),
        "video": F.lit(False),
        "poster_path": F.when(size == 14, "").otherwise(F.concat(F.lit("/p"), key_text, F.lit(".jpg"))),
        "backdrop_path": F.when(size != 15, F.concat(F.lit("/b"), key_text, F.lit(".jpg"))),
        "source_page": size,
        "runtime": F.when(size == 40, 0.0).when(size != 41, size * 5.0),
        "status": F.when(size > 5, "Released").otherwise("Planned"),
        "tagline": F.when(
            size >= 25, F.concat(F.lit("A "), F.lower(kind), F.lit(" story - "), name, F.lit("!"))
        ).otherwise(""),
        "budget": F.when(kind == "PROMO", 0.0).otherwise(F.col("p_retailprice") * size * 10),
        "imdb_id": F.concat(F.lit("tt"), F.lpad(key_text, 9, "0")),
        "homepage": F.when(size <= 20, F.concat(F.lit("https://example.org/"), key_text)),
        "genres_detail": F.when(size == 7, "").otherwise(F.concat_ws(" | ", kind, word)),
        "director": F.when(size == 33, "").when(size != 34, brand),
        "keywords": F.when(size != 21, F.upper(F.replace(name, F.lit(" "), F.lit(" | ")))),
    }


def _sales(lineitem: DataFrame) -> DataFrame:
    """One aggregation of ``lineitem``; the sets have at most ten values by construction.

    Sets are collected by sorting once a task meets more than 128 parts. Rows of a part are brought together first, so that
    a task sorts its share of the parts and not a whole file, which spills; a part of very many rows is dealt over ``_DEALT`` tasks.
    """
    dealt = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(_DEALT))
    return lineitem.repartition("l_partkey", dealt).groupBy("l_partkey").agg(
        F.count("*").alias("n"),
        F.sum(F.col("l_discount").cast("decimal(18,4)")).cast("double").alias("discounts"),
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("price"),
        F.min("l_shipdate").alias("first_ship"),
        F.max("l_shipdate").alias("last_ship"),
        F.collect_set(F.concat(F.lit("Writer "), "l_returnflag", "l_linestatus")).alias("writer_set"),
        F.collect_set(F.concat(F.lit("Studio "), F.col("l_linenumber").cast("string"))).alias("studio_set"),
        F.collect_set("l_returnflag").alias("flag_set"),
    )


def _sales_columns() -> dict[str, Column]:
    first, last = F.col("first_ship"), F.col("last_ship")

    def joined(c: str) -> Column:
        return F.concat_ws(" | ", F.array_sort(c))

    return {
        "vote_average": F.col("discounts") * 100 / F.col("n"),
        "vote_count": F.when(F.col("p_size") <= 2, F.floor(F.col("n") / 10)).otherwise(
            F.floor("quantity")
        ),
        "popularity": F.col("quantity") / 100,
        "revenue": F.when(F.col("p_type") == "SMALL", 0.0).otherwise(F.col("price")),
        "release_date": F.when(F.col("p_size") == 9, "unknown").when(
            F.col("p_size") != 49,
            F.date_format(F.add_months(first, (F.col("p_size") - 22) * 12), "yyyy-MM-dd"),
        ),
        "writers": joined("writer_set"),
        "production_companies": joined("studio_set"),
        "spoken_languages": joined("flag_set"),
        "source_config": F.when(F.col("p_size") > 2, "vote10").otherwise("vote0"),
        "source_start_date": F.date_format(F.trunc(first, "month"), "yyyy-MM-dd"),
        "source_end_date": F.date_format(F.last_day(first), "yyyy-MM-dd"),
        "collected_at": F.date_format(first, "yyyy-MM-dd HH:mm:ss"),
        "enriched_at": F.date_format(last, "yyyy-MM-dd HH:mm:ss"),
    }


def _part_suppliers(lineitem: DataFrame) -> DataFrame:
    """The suppliers of each part, once each, all of a part in one task: what follows sends them no more."""
    return lineitem.select("l_partkey", "l_suppkey").repartition("l_partkey").distinct()


def _cast_lists(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    """The first ten suppliers of each part; cut to ten before they are collected."""
    first = top_per_key(_part_suppliers(lineitem), ["l_partkey"], [F.col("l_suppkey")], 10)
    named = first.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    people = F.array_sort(F.collect_list(F.struct("rank", "s_name")))
    return named.groupBy("l_partkey").agg(
        F.concat_ws(" | ", F.transform(people, lambda x: x["s_name"])).alias("top_cast")
    )


def _country_lists(lineitem: DataFrame, supplier: DataFrame, nation: DataFrame) -> DataFrame:
    made = (
        _part_suppliers(lineitem)
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    )
    return made.groupBy("l_partkey").agg(
        F.concat_ws(" | ", F.array_sort(F.collect_set("n_name"))).alias("production_countries")
    )


def catalogue(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The movie-like catalogue with the wanted columns (all by default)."""
    wanted = list(columns) or COLUMNS
    part = table(spark, sf_dir, "part")
    lineitem = table(spark, sf_dir, "lineitem")
    df, made = part, _part_columns()
    key = F.col("p_partkey")
    if any(c in _SALES for c in wanted):
        df = df.join(_sales(lineitem), key == F.col("l_partkey"), "left").drop("l_partkey")
        made |= _sales_columns()
    if any(c in _TEXTS for c in wanted):
        texts = table(spark, sf_dir, "documents").select(
            "doc_id", F.col("text").alias("overview"), F.col("lang").alias("original_language")
        )
        df = df.join(never_broadcast(texts), key == F.col("doc_id"), "left")
        made |= {c: F.col(c) for c in _TEXTS}
    if "top_cast" in wanted:
        cast = _cast_lists(lineitem, table(spark, sf_dir, "supplier"))
        df = df.join(cast, key == F.col("l_partkey"), "left").drop("l_partkey")
        made["top_cast"] = F.col("top_cast")
    if "production_countries" in wanted:
        countries = _country_lists(
            lineitem, table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
        )
        df = df.join(countries, key == F.col("l_partkey"), "left").drop("l_partkey")
        made["production_countries"] = F.col("production_countries")
    return df.select(*(made[c].alias(c) for c in wanted))


CATALOGUE_SQL = """
sales AS (
  SELECT l_partkey, count(*) AS n,
         CAST(sum(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) AS discounts,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price,
         min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship,
         array_to_string(list_sort(list(DISTINCT 'Writer ' || l_returnflag || l_linestatus)), ' | ') AS writers,
         array_to_string(list_sort(list(DISTINCT 'Studio ' || l_linenumber)), ' | ') AS studios,
         array_to_string(list_sort(list(DISTINCT l_returnflag)), ' | ') AS flags
  FROM lineitem GROUP BY l_partkey),
part_suppliers AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
cast_lists AS (
  SELECT l_partkey, string_agg(s_name, ' | ' ORDER BY l_suppkey) AS top_cast
  FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS rn FROM part_suppliers)
  JOIN supplier ON s_suppkey = l_suppkey WHERE rn <= 10 GROUP BY l_partkey),
country_lists AS (
  SELECT l_partkey, array_to_string(list_sort(list(DISTINCT n_name)), ' | ') AS production_countries
  FROM part_suppliers JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
  GROUP BY l_partkey),
catalogue AS (
  SELECT p_partkey AS id,
    CASE WHEN p_size <= 12 THEN p_name || ' ' || p_partkey ELSE p_name END AS title,
    p_name || ' (' || p_brand || ')' AS original_title,
    d.lang AS original_language, d.text AS overview,
    CASE WHEN p_size = 9 THEN 'unknown' WHEN p_size <> 49
         THEN strftime(first_ship + to_years(p_size - 22), '%Y-%m-%d') END AS release_date,
    p_size || ',' || length(p_type) AS genre_ids,
    p_type || ', ' || split_part(p_name, ' ', 1) AS genres,
    quantity / 100 AS popularity, discounts * 100 / n AS vote_average,
    CAST(CASE WHEN p_size <= 2 THEN floor(n / 10) ELSE floor(quantity) END AS BIGINT) AS vote_count,
    CASE WHEN p_size = 3 THEN TRUE WHEN p_size = 4 THEN NULL ELSE FALSE END AS adult,
    FALSE AS video,
    CASE WHEN p_size = 14 THEN '' ELSE '/p' || p_partkey || '.jpg' END AS poster_path,
    CASE WHEN p_size <> 15 THEN '/b' || p_partkey || '.jpg' END AS backdrop_path,
    CASE WHEN p_size > 2 THEN 'vote10' ELSE 'vote0' END AS source_config,
    strftime(date_trunc('month', first_ship), '%Y-%m-%d') AS source_start_date,
    strftime(last_day(first_ship), '%Y-%m-%d') AS source_end_date,
    p_size AS source_page,
    strftime(first_ship, '%Y-%m-%d %H:%M:%S') AS collected_at,
    CASE WHEN p_size = 40 THEN 0.0::DOUBLE WHEN p_size <> 41 THEN p_size * 5.0::DOUBLE END AS runtime,
    CASE WHEN p_size > 5 THEN 'Released' ELSE 'Planned' END AS status,
    CASE WHEN p_size >= 25 THEN 'A ' || lower(p_type) || ' story - ' || p_name || '!' ELSE '' END AS tagline,
    CASE WHEN p_type = 'PROMO' THEN 0.0::DOUBLE ELSE p_retailprice * p_size * 10 END AS budget,
    CASE WHEN p_type = 'SMALL' THEN 0.0::DOUBLE ELSE price END AS revenue,
    'tt' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS imdb_id,
    CASE WHEN p_size <= 20 THEN 'https://example.org/' || p_partkey END AS homepage,
    CASE WHEN p_size = 7 THEN '' ELSE p_type || ' | ' || split_part(p_name, ' ', 1) END AS genres_detail,
    studios AS production_companies, production_countries, flags AS spoken_languages,
    CASE WHEN p_size = 33 THEN '' WHEN p_size <> 34 THEN p_brand END AS director,
    writers, top_cast,
    CASE WHEN p_size <> 21 THEN upper(replace(p_name, ' ', ' | ')) END AS keywords,
    strftime(last_ship, '%Y-%m-%d %H:%M:%S') AS enriched_at
  FROM part p
  LEFT JOIN sales s ON s.l_partkey = p_partkey
  LEFT JOIN documents d ON d.doc_id = p_partkey
  LEFT JOIN cast_lists c ON c.l_partkey = p_partkey
  LEFT JOIN country_lists k ON k.l_partkey = p_partkey)
"""


def _has(c: str) -> str:
    return f"CAST(length(trim(coalesce({c}, ''))) > 0 AS INTEGER)"


def _count(c: str) -> str:
    return (
        f"CASE WHEN length(trim(coalesce({c}, ''))) = 0 THEN 0 "
        f"ELSE len(string_split_regex({c}, '\\s*\\|\\s*')) END"
    )


PROFILE_SQL = f"""
dated AS (SELECT *, TRY_CAST(release_date AS DATE) AS release_date_parsed FROM catalogue),
profiled AS (
  SELECT *, CAST(year(release_date_parsed) AS INTEGER) AS release_year,
    CAST(month(release_date_parsed) AS INTEGER) AS release_month,
    CAST(floor(year(release_date_parsed) / 10) * 10 AS INTEGER) AS release_decade,
    CAST(coalesce(budget > 0, FALSE) AS INTEGER) AS has_budget,
    CAST(coalesce(revenue > 0, FALSE) AS INTEGER) AS has_revenue,
    CAST(coalesce(budget > 0 AND revenue > 0, FALSE) AS INTEGER) AS has_budget_revenue,
    CASE WHEN budget > 0 AND revenue > 0 THEN revenue - budget END AS profit,
    CASE WHEN budget > 0 AND revenue > 0 THEN (revenue - budget) / budget END AS roi,
    {_has('overview')} AS has_overview, {_has('tagline')} AS has_tagline,
    {_has('homepage')} AS has_homepage, {_has('poster_path')} AS has_poster,
    {_has('backdrop_path')} AS has_backdrop,
    CAST(length(coalesce(overview, '')) AS INTEGER) AS overview_length,
    CAST(length(coalesce(tagline, '')) AS INTEGER) AS tagline_length,
    CAST(length(coalesce(title, '')) AS INTEGER) AS title_length,
    {', '.join(f"CAST({_count(c)} AS INTEGER) AS {c}_count" for c in ['genres_detail', 'production_companies', 'production_countries', 'spoken_languages', 'writers', 'top_cast', 'keywords'])},
    {_has('coalesce(genres_detail, genres)')} AS has_genre, {_has('director')} AS has_director,
    {_has('top_cast')} AS has_top_cast, {_has('keywords')} AS has_keywords,
    CAST(coalesce(runtime > 0, FALSE) AS INTEGER) AS has_runtime_valid,
    CAST(coalesce(vote_count > 0, FALSE) AS INTEGER) AS has_vote_count_valid,
    CAST(release_date_parsed IS NOT NULL AS INTEGER) AS has_release_date,
    CASE WHEN runtime IS NULL THEN 'unknown' WHEN runtime <= 0 THEN 'invalid'
         WHEN runtime < 60 THEN 'short' WHEN runtime <= 120 THEN 'standard'
         WHEN runtime <= 180 THEN 'long' ELSE 'very_long' END AS runtime_category
  FROM dated),
eda AS (
  SELECT *, (has_overview + has_genre + has_director + has_top_cast + has_keywords + has_poster
    + has_runtime_valid + has_vote_count_valid + has_release_date) / 9.0::DOUBLE
    AS metadata_completeness_score FROM profiled)
"""


def _clean(c: str) -> str:
    return (
        "trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({c}, '')), "
        "'[^a-z0-9\\s|\\-]', ' ', 'g'), '\\s+', ' ', 'g'), '\\s*\\|\\s*', ' | ', 'g'))"
    ).replace("{c}", c)


def _items(c: str) -> str:
    return (
        f"list_filter(list_transform(string_split_regex({c}, '\\s*\\|\\s*'), lambda x: trim(x)), lambda x: x <> '')"
    )


PREPROCESS_SQL = f"""
cleaned AS (
  SELECT id, title, original_title, coalesce(original_language, '') AS original_language,
    release_date, TRY_CAST(release_date AS DATE) AS released,
    coalesce(popularity, 0.0) AS popularity,
    coalesce(CASE WHEN vote_average BETWEEN 0 AND 10 THEN vote_average END, 0.0) AS vote_average,
    coalesce(CASE WHEN vote_count < 0 THEN 0 ELSE vote_count END, 0) AS vote_count,
    coalesce(runtime, 0.0) AS runtime, coalesce(budget, 0.0) AS budget, coalesce(revenue, 0.0) AS revenue,
    poster_path, backdrop_path, status, imdb_id, coalesce(homepage, '') AS homepage,
    {_has('overview')} AS is_overview_available, {_has("coalesce(genres_detail, '')")} AS is_genre_available,
    {_has('director')} AS is_director_available, {_has('top_cast')} AS is_cast_available,
    {_has('keywords')} AS is_keyword_available,
    {', '.join(f"{_clean(c)} AS {c}_clean" for c in ['title', 'original_title', 'overview', 'tagline', 'genres', 'genres_detail', 'production_companies', 'production_countries', 'spoken_languages', 'director', 'writers', 'top_cast', 'keywords'])}
  FROM catalogue
  WHERE id IS NOT NULL AND length(trim(title)) > 0 AND NOT coalesce(adult, FALSE)),
listed AS (
  SELECT *, {', '.join(f"{_items(c + '_clean')} AS {t}" for t, c in {'genres_list': 'genres_detail', 'genres_raw_list': 'genres', 'production_companies_list': 'production_companies', 'production_countries_list': 'production_countries', 'spoken_languages_list': 'spoken_languages', 'writers_list': 'writers', 'top_cast_list': 'top_cast', 'keywords_list': 'keywords'}.items())},
    CAST(year(released) AS INTEGER) AS release_year,
    CAST(budget > 0 AS INTEGER) AS budget_valid, CAST(revenue > 0 AS INTEGER) AS revenue_valid,
    CAST(runtime BETWEEN 40 AND 240 AS INTEGER) AS runtime_valid,
    CAST(vote_count >= 10 AS INTEGER) AS vote_count_valid
  FROM cleaned),
scored AS (
  SELECT *, CASE WHEN len(genres_list) > 0 THEN genres_list ELSE genres_raw_list END AS genres_final_list,
    CASE WHEN release_year < 1990 THEN 'classic_1980s' WHEN release_year < 2000 THEN '1990s'
         WHEN release_year < 2010 THEN '2000s' WHEN release_year < 2020 THEN '2010s'
         WHEN release_year >= 2020 THEN '2020s' ELSE 'unknown' END AS movie_era,
    (is_overview_available + is_genre_available + is_director_available + is_cast_available
      + is_keyword_available + runtime_valid + vote_count_valid) / 7.0::DOUBLE AS recommendation_quality_score
  FROM listed),
texted AS (
  SELECT *, array_to_string(genres_final_list, ' ') AS genres_text,
    array_to_string(top_cast_list, ' ') AS top_cast_text,
    array_to_string(keywords_list, ' ') AS keywords_text,
    array_to_string(writers_list, ' ') AS writers_text,
    array_to_string(production_companies_list, ' ') AS production_companies_text,
    array_to_string(production_countries_list, ' ') AS production_countries_text,
    array_to_string(spoken_languages_list, ' ') AS spoken_languages_text
  FROM scored),
prepared AS (
  SELECT *, trim(concat_ws(' ', title_clean, genres_text, overview_clean)) AS movie_document_basic,
    trim(concat_ws(' ', title_clean, original_title_clean, genres_text, director_clean, writers_text,
      top_cast_text, keywords_text, tagline_clean, overview_clean)) AS movie_document_rich,
    trim(concat_ws(' ', title_clean, title_clean, genres_text, genres_text, director_clean,
      top_cast_text, top_cast_text, keywords_text, keywords_text, overview_clean, tagline_clean))
      AS movie_document_weighted
  FROM texted),
ready AS (
  SELECT *, CAST(length(movie_document_weighted) AS INTEGER) AS movie_document_length FROM prepared
  WHERE length(movie_document_weighted) > 20 AND recommendation_quality_score >= 0.45),
final AS (
  SELECT * FROM ready WHERE trim(title) <> '' AND trim(movie_document_weighted) <> '' AND trim(genres_text) <> '')
"""


def sql(*parts: str, select: str) -> str:
    """A query text: the CTE parts, then the final select."""
    return "WITH " + ",".join(p.strip().rstrip(",") for p in parts) + "\n" + select.strip()


def profile_sql(select: str, *extra: str) -> str:
    return sql(CATALOGUE_SQL, PROFILE_SQL, *extra, select=select)


def prepared_sql(select: str, *extra: str) -> str:
    return sql(CATALOGUE_SQL, PREPROCESS_SQL, *extra, select=select)
