"""Explicit schemas, so that no scan has to infer one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


_S, _L, _D, _I, _B = StringType(), LongType(), DoubleType(), IntegerType(), BooleanType()

BASE_MOVIE = _struct(
    id=_L, title=_S, original_title=_S, original_language=_S, overview=_S, release_date=_S,
    genre_ids=_S, genres=_S, popularity=_D, vote_average=_D, vote_count=_L, adult=_B, video=_B,
    poster_path=_S, backdrop_path=_S, source_config=_S, source_start_date=_S, source_end_date=_S,
    source_page=_I, collected_at=_S,
)

ENRICHMENT = _struct(
    id=_L, runtime=_D, status=_S, tagline=_S, budget=_D, revenue=_D, imdb_id=_S, homepage=_S,
    genres_detail=_S, production_companies=_S, production_countries=_S, spoken_languages=_S,
    director=_S, writers=_S, top_cast=_S, keywords=_S, enriched_at=_S,
)

_NAMED = ArrayType(_struct(name=_S))

DISCOVER_PAGE = _struct(
    page=_L,
    results=ArrayType(
        _struct(
            id=_L, title=_S, original_title=_S, original_language=_S, overview=_S, release_date=_S,
            genre_ids=ArrayType(_L), popularity=_D, vote_average=_D, vote_count=_L, adult=_B,
            video=_B, poster_path=_S, backdrop_path=_S,
        )
    ),
)

DETAIL = _struct(
    id=_L, runtime=_D, status=_S, tagline=_S, budget=_D, revenue=_D, imdb_id=_S, homepage=_S,
    genres=_NAMED,
    production_companies=_NAMED,
    production_countries=ArrayType(_struct(iso_3166_1=_S, name=_S)),
    spoken_languages=ArrayType(_struct(english_name=_S, name=_S)),
    credits=_struct(
        cast=ArrayType(_struct(name=_S, order=_L, cast_id=_L)),
        crew=ArrayType(_struct(name=_S, job=_S)),
    ),
    keywords=_struct(keywords=_NAMED, results=_NAMED),
)

_STRINGS = ArrayType(_S)

INTENT = _struct(
    reference_title=_S, preferred_genres=_STRINGS, actors=_STRINGS, directors=_STRINGS,
    keywords=_STRINGS, original_languages=_STRINGS, min_rating=_D, max_rating=_D,
    release_year_from=_I, release_year_to=_I, min_runtime=_I, max_runtime=_I,
    clarification_needed=_B, clarification_question=_S,
)

# What each catalogue column holds.
COLUMN_NOTES = {
    "id": "Unique movie id.",
    "title": "Movie title.",
    "original_title": "Title in the original language.",
    "original_language": "Original language code.",
    "overview": "Synopsis.",
    "release_date": "Release date.",
    "genre_ids": "Genre ids as text.",
    "genres": "Genre names mapped from the ids.",
    "popularity": "Popularity score.",
    "vote_average": "Mean user rating.",
    "vote_count": "Number of votes.",
    "adult": "Marks adult content.",
    "video": "Marks plain videos.",
    "poster_path": "Poster path.",
    "backdrop_path": "Backdrop path.",
    "source_config": "Collection variant.",
    "source_start_date": "First day of the collection window.",
    "source_end_date": "Last day of the collection window.",
    "source_page": "Page of the listing the row came from.",
    "collected_at": "Time of collection.",
    "runtime": "Length in minutes.",
    "status": "Release status.",
    "tagline": "Tagline.",
    "budget": "Production budget.",
    "revenue": "Revenue.",
    "imdb_id": "Id in the IMDb.",
    "homepage": "Official web page.",
    "genres_detail": "Genres from the detail record.",
    "production_companies": "Production companies.",
    "production_countries": "Production countries.",
    "spoken_languages": "Spoken languages.",
    "director": "Directors.",
    "writers": "Writers.",
    "top_cast": "Leading actors.",
    "keywords": "Keywords.",
    "enriched_at": "Time of enrichment.",
}


def data_dictionary(df: DataFrame) -> DataFrame:
    """(column, dtype, description) of a frame; '-' where no note exists."""
    rows = [(name, kind, COLUMN_NOTES.get(name, "-")) for name, kind in df.dtypes]
    return df.sparkSession.createDataFrame(rows, "column string, dtype string, description string")
