"""Listing pages and detail records: nested JSON to flat catalogue rows."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marquee.functions.columns import as_column, union_all
from marquee.sources.schemas import DETAIL, DISCOVER_PAGE

# Collection variants and their vote floors, and the crew jobs that count as writing.
LISTING_VARIANTS = {"vote10": 10, "vote0": 0}
WRITER_JOBS = ["Writer", "Screenplay", "Story"]
WIDE_WRITER_JOBS = ["Writer", "Screenplay", "Story", "Novel", "Characters"]


def listing_variants(movies: DataFrame, variants: dict[str, int]) -> DataFrame:
    """The rows each collection variant lets through, tagged with its name."""
    floors = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(v).alias("floor")) for k, v in variants.items()))
    passed = F.filter(floors, lambda f: F.col("vote_count") >= f["floor"])
    return movies.withColumn("source_config", F.explode(F.transform(passed, lambda f: f["name"])))


def month_windows(spark: SparkSession, start_year: int, end_year: int) -> DataFrame:
    """(first day, last day) of every month of the years."""
    first = F.sequence(
        F.make_date(F.lit(start_year), F.lit(1), F.lit(1)),
        F.make_date(F.lit(end_year), F.lit(12), F.lit(1)),
        F.expr("interval 1 month"),
    )
    return months_between(spark.range(1).select(F.explode(first).alias("day")))


def months_between(days: DataFrame) -> DataFrame:
    return days.select(F.col("day").alias("start_date"), F.last_day("day").alias("end_date"))


def month_windows_of(df: DataFrame, date: str) -> DataFrame:
    """The month windows of all years that a date column covers."""
    span = df.agg(F.min(F.trunc(date, "year")).alias("a"), F.max(F.trunc(date, "year")).alias("b"))
    last = F.add_months("b", 11)
    return months_between(
        span.select(F.explode(F.sequence("a", last, F.expr("interval 1 month"))).alias("day"))
    )


def genre_names(ids: Column, names: dict[int, str] | Column) -> Column:
    """Genre ids as a ', ' text; an id without a name stays as a number."""
    if isinstance(names, dict):
        names = F.create_map(*(F.lit(x) for x in chain.from_iterable(names.items())))
    named = F.transform(
        F.coalesce(ids, F.array()),
        lambda g: F.coalesce(F.try_element_at(names, g), g.cast("string")),
    )
    return F.array_join(named, ", ")


def listing_rows(pages: DataFrame, names: dict[int, str] | Column, payload: str = "payload") -> DataFrame:
    """One row per result of each page, tagged with the window and page it came from.

    ``pages``: payload (JSON), source_config, source_start_date, source_end_date, source_page.
    """
    parsed = pages.withColumn("_page", F.from_json(payload, DISCOVER_PAGE))
    rows = parsed.withColumn("m", F.explode("_page.results")).filter(F.col("m.id").isNotNull())
    plain = [
        "id", "title", "original_title", "original_language", "overview", "release_date",
        "popularity", "vote_average", "vote_count", "adult", "video", "poster_path", "backdrop_path",
    ]
    tags = ["source_config", "source_start_date", "source_end_date", "source_page"]
    ids = F.coalesce(F.col("m.genre_ids"), F.array())
    return rows.select(
        *(F.col(f"m.{c}").alias(c) for c in plain),
        F.array_join(F.transform(ids, lambda g: g.cast("string")), ",").alias("genre_ids"),
        genre_names(ids, names).alias("genres"),
        *tags,
        F.current_timestamp().alias("collected_at"),
    )


def _unique_join(values: Column) -> Column:
    """Distinct non-empty values in first-seen order, joined by ', '."""
    kept = F.filter(F.coalesce(values, F.array()), lambda v: v.isNotNull() & (v != ""))
    return F.array_join(F.array_distinct(kept), ", ")


def _trimmed_join(values: Column) -> Column:
    """Trimmed non-empty values, duplicates kept, joined by ' | '."""
    kept = F.filter(
        F.transform(F.coalesce(values, F.array()), lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != "")
    )
    return F.array_join(kept, " | ")


def _names(people: Column) -> Column:
    return F.transform(people, lambda p: p["name"])


def _with_jobs(crew: Column, jobs: list[str]) -> Column:
    return _names(F.filter(crew, lambda p: p["job"].isin(jobs)))


_SCALARS = ["id", "runtime", "status", "tagline", "budget", "revenue", "imdb_id", "homepage"]


def _parsed(details: DataFrame, payload: str) -> DataFrame:
    return details.select(F.from_json(payload, DETAIL).alias("d")).select("d.*")


def detail_rows_short(details: DataFrame, payload: str = "payload") -> DataFrame:
    """Enrichment rows with ', ' lists: names once, cast by (order, cast id), at most ten."""
    d = _parsed(details, payload)
    by_place = F.array_sort(
        F.transform(
            F.coalesce("credits.cast", F.array()),
            lambda p, i: F.struct(
                F.coalesce(p["order"], F.lit(9999)).alias("a"),
                F.coalesce(p["cast_id"], F.lit(9999)).alias("b"),
                i.alias("i"),
                p["name"].alias("name"),
            ),
        )
    )
    return d.select(
        *_SCALARS,
        _unique_join(_names(F.col("production_companies"))).alias("production_companies"),
        _unique_join(F.transform("production_countries", lambda c: c["iso_3166_1"])).alias("production_countries"),
        _unique_join(F.transform("spoken_languages", lambda c: c["english_name"])).alias("spoken_languages"),
        _unique_join(_with_jobs(F.col("credits.crew"), ["Director"])).alias("director"),
        _unique_join(_with_jobs(F.col("credits.crew"), WRITER_JOBS)).alias("writers"),
        _unique_join(_names(F.slice(by_place, 1, 10))).alias("top_cast"),
        _unique_join(_names(F.col("keywords.keywords"))).alias("keywords"),
    )


def detail_rows_wide(details: DataFrame, payload: str = "payload") -> DataFrame:
    """Enrichment rows with ' | ' lists: repeats kept, the first ten of the cast as given."""
    d = _parsed(details, payload)
    given = F.col("keywords.keywords")
    words = F.when(F.size(given) > 0, given).otherwise(F.col("keywords.results"))
    lists = {
        "genres_detail": _names(F.col("genres")),
        "production_companies": _names(F.col("production_companies")),
        "production_countries": _names(F.col("production_countries")),
        "spoken_languages": _names(F.col("spoken_languages")),
        "director": _with_jobs(F.col("credits.crew"), ["Director"]),
        "writers": _with_jobs(F.col("credits.crew"), WIDE_WRITER_JOBS),
        "top_cast": _names(F.slice("credits.cast", 1, 10)),
        "keywords": _names(words),
    }
    return d.select(
        *_SCALARS,
        *(_trimmed_join(v).alias(n) for n, v in lists.items()),
        F.current_timestamp().alias("enriched_at"),
    )


def enrich(base: DataFrame, enrichment: DataFrame, key: str = "id", suffix: str = "_enrich") -> DataFrame:
    """Base rows with their detail columns; clashing names get a suffix."""
    clashes = [c for c in enrichment.columns if c in base.columns and c != key]
    return base.join(enrichment.withColumnsRenamed({c: c + suffix for c in clashes}), key, "left")


def remaining_ids(source: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Ids that are still to be enriched."""
    return source.select(key).dropna().distinct().join(done.select(key), key, "left_anti")


def stack_batches(*batches: DataFrame) -> DataFrame:
    return union_all(batches)


def payload_map(df: DataFrame, skip: tuple[str, ...] = ("id", "vector")) -> Column:
    """The other columns as a JSON object without NULLs."""
    return F.to_json(F.struct(*(c for c in df.columns if c not in skip)))


def first_enrichment(details: DataFrame, order: list[Column]) -> DataFrame:
    """The first payload per id, for sources that were fetched twice."""
    from marquee.operators.dedupe import first_per_key

    return first_per_key(details, ["id"], [as_column(c) for c in order])
