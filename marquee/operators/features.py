"""Casts, repairs and derived columns of the catalogue (all narrow: no shuffle)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from marquee.functions.columns import (
    as_column,
    defaults,
    flag,
    has_text,
    number,
    present,
    project,
    text,
    total,
)
from marquee.functions.strings import clean, item_count, items, join_items

# Column groups.
COUNTED_LISTS = [
    "genres_detail", "production_companies", "production_countries", "spoken_languages",
    "writers", "top_cast", "keywords",
]
DOUBLE_COLUMNS = [
    "popularity", "vote_average", "runtime", "budget", "revenue", "profit", "roi",
    "metadata_completeness_score",
]
LONG_COLUMNS = [
    "id", "vote_count", "source_page", "release_year", "release_month", "release_decade",
    "overview_length", "tagline_length", "title_length",
    "genres_detail_count", "production_companies_count", "production_countries_count",
    "spoken_languages_count", "writers_count", "top_cast_count", "keywords_count",
    "has_budget", "has_revenue", "has_budget_revenue", "has_overview", "has_tagline", "has_homepage",
    "has_poster", "has_backdrop", "has_genre", "has_director", "has_top_cast", "has_keywords",
    "has_runtime_valid", "has_vote_count_valid", "has_release_date",
]
DATE_COLUMNS = ["release_date", "source_start_date", "source_end_date"]
TIME_COLUMNS = ["collected_at", "enriched_at"]
TEXT_COLUMNS = [
    "title", "original_title", "original_language", "overview", "genres", "tagline",
    "genres_detail", "production_companies", "production_countries", "spoken_languages",
    "director", "writers", "top_cast", "keywords", "status", "imdb_id", "homepage",
]
CLEANED_COLUMNS = [
    "title", "original_title", "overview", "tagline", "genres", "genres_detail",
    "production_companies", "production_countries", "spoken_languages", "director", "writers",
    "top_cast", "keywords",
]
NUMERIC_DEFAULTS = {
    "popularity": 0.0, "vote_average": 0.0, "vote_count": 0, "runtime": 0.0, "budget": 0.0,
    "revenue": 0.0, "profit": 0.0, "roi": 0.0, "metadata_completeness_score": 0.0,
}
LIST_COLUMNS = {
    "genres_list": "genres_detail_clean",
    "genres_raw_list": "genres_clean",
    "production_companies_list": "production_companies_clean",
    "production_countries_list": "production_countries_clean",
    "spoken_languages_list": "spoken_languages_clean",
    "writers_list": "writers_clean",
    "top_cast_list": "top_cast_clean",
    "keywords_list": "keywords_clean",
}
LIST_TEXTS = {
    "genres_text": "genres_final_list",
    "top_cast_text": "top_cast_list",
    "keywords_text": "keywords_list",
    "writers_text": "writers_list",
    "production_companies_text": "production_companies_list",
    "production_countries_text": "production_countries_list",
    "spoken_languages_text": "spoken_languages_list",
}
EXPORTED_LISTS = ["genres_final_list", *LIST_COLUMNS]
DOCUMENT_FIELDS = {
    "movie_document_basic": ["title_clean", "genres_text", "overview_clean"],
    "movie_document_rich": [
        "title_clean", "original_title_clean", "genres_text", "director_clean", "writers_text",
        "top_cast_text", "keywords_text", "tagline_clean", "overview_clean",
    ],
    "movie_document_weighted": [
        "title_clean", "title_clean", "genres_text", "genres_text", "director_clean",
        "top_cast_text", "top_cast_text", "keywords_text", "keywords_text", "overview_clean",
        "tagline_clean",
    ],
}
DOCUMENT_COLUMNS = [
    "id", "title", "original_title", "release_date", "release_year", "movie_era",
    "original_language", "genres_text", "director_clean", "top_cast_text", "keywords_text",
    "overview_clean", "tagline_clean", "runtime", "vote_average", "vote_count", "popularity",
    "budget", "revenue", "recommendation_quality_score", "movie_document_basic",
    "movie_document_rich", "movie_document_weighted",
]
TEXT_CANDIDATES = [
    "movie_document_weighted", "movie_document_rich", "movie_document_basic", "movie_document",
]
QUALITY_FLAGS = [
    "is_overview_available", "is_genre_available", "is_director_available", "is_cast_available",
    "is_keyword_available", "runtime_valid", "vote_count_valid",
]
COMPLETENESS_FLAGS = [
    "has_overview", "has_genre", "has_director", "has_top_cast", "has_keywords", "has_poster",
    "has_runtime_valid", "has_vote_count_valid", "has_release_date",
]


# -- names and types ---------------------------------------------------------------------------


def snake_case(name: str) -> str:
    return re.sub(r"_+", "_", re.sub(r"[^0-9a-zA-Z_]+", "_", name.strip())).lower().strip("_")


def snake_case_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: snake_case(c) for c in df.columns if snake_case(c) != c})


def cast_columns(df: DataFrame) -> DataFrame:
    """Coerce known numeric columns; parse dates and times beside the originals."""
    casts = {c: number(c) for c in present(df, DOUBLE_COLUMNS)}
    casts |= {c: number(c, "bigint") for c in present(df, LONG_COLUMNS)}
    casts |= {f"{c}_parsed": date_of(c) for c in present(df, DATE_COLUMNS)}
    casts |= {f"{c}_ts": F.try_to_timestamp(as_column(c).cast("string")) for c in present(df, TIME_COLUMNS)}
    return df.withColumns(casts)


def date_of(c: str | Column) -> Column:
    """A date, or NULL for text that is none."""
    return as_column(c).try_cast("date")


def repair_ranges(df: DataFrame) -> DataFrame:
    rating, votes = F.col("vote_average"), F.col("vote_count")
    return df.withColumns(
        {
            "vote_average": F.when(rating.between(0, 10), rating),
            "vote_count": F.when(votes < 0, 0).otherwise(votes),
        }
    )


# -- profiling features --------------------------------------------------------------------------


def decade_of(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def runtime_category(minutes: Column) -> Column:
    return (
        F.when(minutes.isNull(), "unknown")
        .when(minutes <= 0, "invalid")
        .when(minutes < 60, "short")
        .when(minutes <= 120, "standard")
        .when(minutes <= 180, "long")
        .otherwise("very_long")
    )


def movie_era(year: Column) -> Column:
    """Every year before 1990 falls into the first era; an unknown year has its own."""
    return (
        F.when(year < 1990, "classic_1980s")
        .when(year < 2000, "1990s")
        .when(year < 2010, "2000s")
        .when(year < 2020, "2010s")
        .when(year >= 2020, "2020s")
        .otherwise("unknown")
    )


def with_dates(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("release_date_parsed", date_of("release_date"))
        .withColumns(
            {
                "release_year": F.year("release_date_parsed"),
                "release_month": F.month("release_date_parsed"),
            }
        )
        .withColumn("release_decade", decade_of(F.col("release_year")))
    )


def with_finance(df: DataFrame) -> DataFrame:
    budget, revenue = F.col("budget"), F.col("revenue")
    both = (budget > 0) & (revenue > 0)
    return df.withColumns(
        {
            "has_budget": flag(budget > 0),
            "has_revenue": flag(revenue > 0),
            "has_budget_revenue": flag(both),
            "profit": F.when(both, revenue - budget),
            "roi": F.when(both, (revenue - budget) / budget),
        }
    )


def with_presence(df: DataFrame) -> DataFrame:
    sources = {
        "has_overview": "overview",
        "has_tagline": "tagline",
        "has_homepage": "homepage",
        "has_poster": "poster_path",
        "has_backdrop": "backdrop_path",
    }
    return df.withColumns({name: flag(has_text(c)) for name, c in sources.items()})


def with_lengths(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{c}_length": F.length(text(c)) for c in ("overview", "tagline", "title")})


def with_item_counts(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{c}_count": item_count(c) for c in present(df, COUNTED_LISTS)})


def with_completeness(df: DataFrame) -> DataFrame:
    """Share of nine metadata fields that are filled."""
    return df.withColumns(
        {
            "has_genre": flag(has_text(F.coalesce("genres_detail", "genres"))),
            "has_director": flag(has_text("director")),
            "has_top_cast": flag(has_text("top_cast")),
            "has_keywords": flag(has_text("keywords")),
            "has_runtime_valid": flag(F.col("runtime") > 0),
            "has_vote_count_valid": flag(F.col("vote_count") > 0),
            "has_release_date": flag(F.col("release_date_parsed").isNotNull()),
        }
    ).withColumn(
        "metadata_completeness_score", total(F.col(c) for c in COMPLETENESS_FLAGS) / F.lit(9.0)
    )


def profile_features(df: DataFrame) -> DataFrame:
    """Everything the profile reports read, in one chain of projections."""
    for step in (with_dates, with_finance, with_presence, with_lengths, with_item_counts, with_completeness):
        df = step(df)
    return df.withColumn("runtime_category", runtime_category(F.col("runtime")))


def with_finance_logs(df: DataFrame) -> DataFrame:
    """Rows with both budget and revenue, and the logs of their amounts."""
    return df.filter(F.col("has_budget_revenue") == 1).withColumns(
        {
            "log_budget": F.log1p("budget"),
            "log_revenue": F.log1p("revenue"),
            "log_profit_abs": F.log1p(F.abs("profit")),
        }
    )


def _plain_fields() -> dict[str, Column]:
    return {
        "Title": text("title"),
        "Overview": text("overview"),
        "Genres": F.coalesce(F.col("genres_detail"), text("genres")),
        "Director": text("director"),
        "Writers": text("writers"),
        "Cast": text("top_cast"),
        "Keywords": text("keywords"),
        "Language": text("original_language"),
        "Year": text("release_year"),
    }


def labelled_document() -> Column:
    """One text with every field behind its label."""
    return F.concat_ws(" ", *(F.concat(F.lit(f"{k}: "), v) for k, v in _plain_fields().items()))


def plain_document() -> Column:
    return F.concat_ws(" ", *_plain_fields().values())


# -- preprocessing -------------------------------------------------------------------------------


def keep_usable(df: DataFrame) -> DataFrame:
    """Rows with an id and a title that are not marked as adult content."""
    return df.filter(
        F.col("id").isNotNull() & has_text("title") & ~F.coalesce(F.col("adult"), F.lit(False))
    )


def fill_texts(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.withColumns({c: text(c) if c in have else F.lit("") for c in TEXT_COLUMNS})


def with_availability(df: DataFrame, fix_genre_flag: bool = False) -> DataFrame:
    """Availability flags on blank-filled text.

    The genre flag looks at the detail genres only, since a blank is not NULL
    and so never falls back; ``fix_genre_flag`` looks at both.
    """
    genre = has_text("genres_detail")
    if fix_genre_flag:
        genre = genre | has_text("genres")
    return df.withColumns(
        {
            "is_overview_available": flag(has_text("overview")),
            "is_genre_available": flag(genre),
            "is_director_available": flag(has_text("director")),
            "is_cast_available": flag(has_text("top_cast")),
            "is_keyword_available": flag(has_text("keywords")),
        }
    )


def with_clean_texts(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{c}_clean": clean(c) for c in present(df, CLEANED_COLUMNS)})


def with_lists(df: DataFrame) -> DataFrame:
    """Arrays of the multi-value texts; genres fall back to the raw list."""
    return df.withColumns({name: items(c) for name, c in LIST_COLUMNS.items()}).withColumn(
        "genres_final_list",
        F.when(F.size("genres_list") > 0, F.col("genres_list")).otherwise(F.col("genres_raw_list")),
    )


def with_validity(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "budget_valid": flag(F.col("budget") > 0),
            "revenue_valid": flag(F.col("revenue") > 0),
            "runtime_valid": flag(F.col("runtime").between(40, 240)),
            "vote_count_valid": flag(F.col("vote_count") >= 10),
        }
    )


def with_logs(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {f"log_{c}": F.log1p(c) for c in ("popularity", "vote_count", "budget", "revenue", "runtime")}
    )


def with_quality_score(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "recommendation_quality_score", total(F.col(c) for c in QUALITY_FLAGS) / F.lit(7.0)
    )


def document_texts() -> dict[str, Column]:
    """The three documents, from the cleaned and list texts."""
    return {
        name: F.trim(F.concat_ws(" ", *(F.col(c) for c in fields))) for name, fields in DOCUMENT_FIELDS.items()
    }


def with_documents(df: DataFrame) -> DataFrame:
    """List texts, the three documents and the length of the weighted one.

    The documents are made by a one-row generator. A filter on them then stays
    above it; pushed below, it would clean every text a second time.
    """
    texts = {
        name: join_items(c, " ") if c in df.columns else F.lit("") for name, c in LIST_TEXTS.items()
    }
    documents = F.struct(*(c.alias(name) for name, c in document_texts().items()))
    made = df.withColumns(texts).select("*", F.inline(F.array(documents)))
    return made.withColumn("movie_document_length", F.length("movie_document_weighted"))


def preprocess(df: DataFrame, fix_genre_flag: bool = False) -> DataFrame:
    """Clean, split, score and document a deduplicated catalogue."""
    df = defaults(fill_texts(repair_ranges(keep_usable(df))), NUMERIC_DEFAULTS)
    df = with_availability(df, fix_genre_flag)
    df = with_lists(with_clean_texts(df))
    if "release_year" not in df.columns:
        df = df.withColumn("release_year", F.year(date_of("release_date")))
    df = df.withColumn("movie_era", movie_era(F.col("release_year")))
    return with_documents(with_quality_score(with_logs(with_validity(df))))


def model_ready(df: DataFrame, min_length: int = 20, min_quality: float = 0.45) -> DataFrame:
    return df.filter(
        (F.col("movie_document_length") > min_length)
        & (F.col("recommendation_quality_score") >= min_quality)
    )


def document_table(df: DataFrame) -> DataFrame:
    return project(df, DOCUMENT_COLUMNS)


def export_lists(df: DataFrame) -> DataFrame:
    """Array columns as ' | ' texts, for formats without arrays."""
    have = present(df, EXPORTED_LISTS)
    return df.withColumns({f"{c}_str": join_items(c) for c in have}).drop(*have)


def modelling_base(df: DataFrame, one_row: bool = False) -> DataFrame:
    """Rows ready for the text models: an id and a document, one row per id.

    Ratings, votes and popularity are read from the columns the table has;
    absent ones are zero. ``one_row``: the table has one row per id already, so
    that its documents are not sent to look for others.
    """
    from marquee.functions.columns import first_available, require
    from marquee.operators.dedupe import first_per_key

    document = first_available(df, TEXT_CANDIDATES)
    require(df, ["id", "title", document], "document table")
    have = set(df.columns)

    def pick(names: list[str], kind: str, default) -> Column:
        for n in names:
            if n in have:
                return F.coalesce(number(n, kind), F.lit(default))
        return F.lit(default).cast(kind)

    base = df.select(
        number("id", "bigint").alias("id"),
        text("title").alias("title"),
        text(document).alias("movie_document"),
        (number("release_year", "int") if "release_year" in have else F.lit(None).cast("int")).alias("release_year"),
        (text("genres_text") if "genres_text" in have else F.lit("")).alias("genres_text"),
        (text("director_clean") if "director_clean" in have else F.lit("")).alias("director_clean"),
        pick(["vote_average_clean", "vote_average"], "double", 0.0).alias("vote_average"),
        pick(["vote_count_clean", "vote_count"], "double", 0.0).alias("vote_count"),
        pick(["popularity_clean", "popularity"], "double", 0.0).alias("popularity"),
        pick(["runtime_clean", "runtime"], "double", 0.0).alias("runtime"),
        pick(["recommendation_quality_score"], "double", 0.0).alias("recommendation_quality_score"),
    ).filter(F.col("id").isNotNull() & has_text("movie_document"))
    return base if one_row else first_per_key(base, ["id"], [F.col("movie_document"), F.col("title")])
