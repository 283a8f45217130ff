"""Free-text requests to structured intents, and the predicates on them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from marquee.functions.columns import Name, as_column, half_even_text
from marquee.functions.strings import contains_any, normalise_title

# Language names and their codes.
LANGUAGE_CODES = {
    "arabic": "ar", "bahasa indonesia": "id", "bahasa inggris": "en", "bahasa jepang": "ja",
    "bahasa korea": "ko", "chinese": "zh", "english": "en", "french": "fr", "german": "de",
    "hindi": "hi", "indonesia": "id", "indonesian": "id", "italian": "it", "japanese": "ja",
    "korea": "ko", "korean": "ko", "mandarin": "zh", "spanish": "es",
}
# Genre words and the genre each one means.
GENRE_WORDS = {
    "aksi": "action", "action": "action", "adventure": "adventure", "petualangan": "adventure",
    "animasi": "animation", "animation": "animation", "komedi": "comedy", "comedy": "comedy",
    "crime": "crime", "kriminal": "crime", "documentary": "documentary", "dokumenter": "documentary",
    "drama": "drama", "family": "family", "keluarga": "family", "fantasy": "fantasy",
    "fantasi": "fantasy", "history": "history", "sejarah": "history", "horror": "horror",
    "horor": "horror", "music": "music", "musik": "music", "mystery": "mystery",
    "misteri": "mystery", "romance": "romance", "romantis": "romance",
    "science fiction": "science fiction", "sci fi": "science fiction", "sci-fi": "science fiction",
    "fiksi ilmiah": "science fiction", "thriller": "thriller", "war": "war", "perang": "war",
    "western": "western",
}
# The request patterns.
TITLE_PATTERNS = [r"(?i)(?:mirip|seperti|like)\s+(.+)$", r"(?i)(?:recommend|rekomendasi)\s+(.+)$"]
YEAR_FROM_PATTERN = r"(?:setelah|sesudah|mulai|dari|after|since)\s+(\d{4})"
YEAR_TO_PATTERN = r"(?:sebelum|sampai|hingga|before|until)\s+(\d{4})"
MAX_RUNTIME_PATTERN = r"(?:durasi\s*)?(?:maksimal|maximum|max|kurang dari|di bawah)\s+(\d{2,3})\s*(?:menit|min)?"
MIN_RUNTIME_PATTERN = r"(?:durasi\s*)?(?:minimal|minimum|min|lebih dari)\s+(\d{2,3})\s*(?:menit|min)?"
MIN_RATING_PATTERN = r"(?:rating|nilai)\s*(?:minimal|minimum|min|di atas|lebih dari)?\s*(\d+(?:[.,]\d+)?)"
SIMILARITY_PHRASES = ["similar to", "similar with", "mirip dengan", "mirip seperti"]

TEXT_FIELDS = ["preferred_genres", "actors", "directors", "keywords", "original_languages"]
BOUND_FIELDS = {
    "min_rating": "double", "max_rating": "double", "release_year_from": "int",
    "release_year_to": "int", "min_runtime": "int", "max_runtime": "int",
}


def extract_title(message: Name) -> Column:
    """The title a message asks about: after a similarity word, else after a request word, else all."""
    whole = F.trim(F.regexp_replace(as_column(message), r"(?U)\s+", " "))
    found = [F.nullif(F.regexp_extract(whole, p, 1), F.lit("")) for p in TITLE_PATTERNS]
    return F.btrim(F.coalesce(*found, whole), F.lit(" .?!"))


def _alias_map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(values.items())))


def language_code(value: Column) -> Column:
    """The code of a language name; anything else is only normalised."""
    name = normalise_title(value)
    return F.coalesce(F.try_element_at(_alias_map(LANGUAGE_CODES), name), name)


def _mentioned(message: Column, words: dict[str, str]) -> Column:
    """Sorted distinct meanings of the words that stand in the message as whole words.

    One pattern holds all words, grouped by first letter, longer ones first. A
    word inside a longer one has the same meaning, so finding only the longer
    one loses nothing.
    """
    by_letter: dict[str, list[str]] = {}
    for word in sorted(words, key=len, reverse=True):
        by_letter.setdefault(word[0], []).append(word[1:])
    pattern = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by_letter.items())
    found = F.regexp_extract_all(message, F.lit(rf"(?U)\b(?:{pattern})\b"), F.lit(0))
    meanings = _alias_map(words)
    return F.array_sort(F.array_distinct(F.transform(found, lambda w: F.try_element_at(meanings, w))))


def _captured(message: Column, pattern: str, kind: str) -> Column:
    """The captured number, NULL without a match (casting '' would raise inside for every row)."""
    found = F.nullif(F.regexp_extract(message, pattern, 1), F.lit(""))
    return F.replace(found, F.lit(","), F.lit(".")).try_cast(kind)


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def with_intent(df: DataFrame, message: str = "message", name: str = "intent") -> DataFrame:
    """Add the intent that the patterns find in a message, NULL when no filter is found.

    The steps are separate projections, so that no pattern runs twice per row.
    """
    text = F.col("_text")
    steps = df.withColumn("_text", normalise_title(message)).withColumns(
        {
            "_genres": _mentioned(text, GENRE_WORDS),
            "_languages": _mentioned(text, LANGUAGE_CODES),
            "_rating": _captured(text, MIN_RATING_PATTERN, "double"),
            "_from": _captured(text, YEAR_FROM_PATTERN, "int"),
            "_to": _captured(text, YEAR_TO_PATTERN, "int"),
            "_min": _captured(text, MIN_RUNTIME_PATTERN, "int"),
            "_max": _captured(text, MAX_RUNTIME_PATTERN, "int"),
        }
    )
    intent = intent_of(
        preferred_genres=F.col("_genres"),
        original_languages=F.col("_languages"),
        min_rating=F.col("_rating"),
        release_year_from=F.col("_from"),
        release_year_to=F.col("_to"),
        min_runtime=F.col("_min"),
        max_runtime=F.col("_max"),
    )
    helpers = ["_text", "_genres", "_languages", "_rating", "_from", "_to", "_min", "_max"]
    return steps.withColumn(name, F.when(has_filters(intent), intent)).drop(*helpers)


def intent_of(**fields: Column) -> Column:
    """Intent struct from columns; fields not given are empty."""
    texts = {f: fields.get(f, empty_strings()) for f in TEXT_FIELDS}
    bounds = {f: fields.get(f, F.lit(None)).cast(k) for f, k in BOUND_FIELDS.items()}
    return F.struct(
        fields.get("reference_title", F.lit(None)).cast("string").alias("reference_title"),
        *(v.alias(f) for f, v in texts.items()),
        *(v.alias(f) for f, v in bounds.items()),
        fields.get("clarification_needed", F.lit(False)).alias("clarification_needed"),
        fields.get("clarification_question", F.lit(None)).cast("string").alias("clarification_question"),
    )


def _filled(terms: Column) -> Column:
    return F.exists(terms, lambda t: F.trim(t) != "")


def has_filters(intent: Column) -> Column:
    """True when any text list holds a non-blank term or any bound is set."""
    conditions = [_filled(intent[f]) for f in TEXT_FIELDS] + [intent[f].isNotNull() for f in BOUND_FIELDS]
    found = conditions[0]
    for c in conditions[1:]:
        found = found | c
    return F.coalesce(found, F.lit(False))


def cleaned_keywords(intent: Column) -> Column:
    """Keywords without those that only repeat the title or the wish for similarity."""
    title = F.trim(F.lower(intent["reference_title"]))

    def thematic(keyword: Column) -> Column:
        word = F.trim(F.lower(keyword))
        repeated = F.contains(word, title)
        for phrase in SIMILARITY_PHRASES:
            repeated = repeated | F.contains(word, F.lit(phrase))
        return ~repeated

    return F.when(F.coalesce(title, F.lit("")) == "", intent["keywords"]).otherwise(
        F.filter(intent["keywords"], thematic)
    )


def request_error(intent: Column, limit: Column) -> Column:
    """What is wrong with a discovery request, NULL when nothing is."""
    def outside(field: str, low: float, high: float) -> Column:
        return ~F.coalesce(intent[field].between(low, high), F.lit(True))

    return (
        F.when(outside("min_rating", 0, 10) | outside("max_rating", 0, 10), "rating_out_of_range")
        .when(outside("release_year_from", 1870, 2100) | outside("release_year_to", 1870, 2100), "year_out_of_range")
        .when(outside("min_runtime", 1, 1000) | outside("max_runtime", 1, 1000), "runtime_out_of_range")
        .when(~limit.between(1, 50), "limit_out_of_range")
        .when(~has_filters(intent), "no_filter")
        .when(intent["min_rating"] > intent["max_rating"], "min_rating_above_max_rating")
        .when(intent["release_year_from"] > intent["release_year_to"], "year_from_above_year_to")
        .when(intent["min_runtime"] > intent["max_runtime"], "min_runtime_above_max_runtime")
    )


def _general_number(value: Column) -> Column:
    """Six significant digits without trailing zeros, as C's %g prints them."""
    return F.when(value == F.floor(value), F.format_string("%.0f", value)).when(
        value.isNotNull(), F.regexp_replace(F.format_string("%.6f", value), r"\.?0+$", "")
    )


def filter_reason(intent: Column) -> Column:
    """The sentence that names the filters a result fulfils."""
    labels = {
        "preferred_genres": "genre ", "actors": "aktor ", "directors": "sutradara ",
        "keywords": "tema ", "original_languages": "bahasa ",
    }
    parts = [
        F.when(F.size(intent[f]) > 0, F.concat(F.lit(label), F.array_join(intent[f], ", ")))
        for f, label in labels.items()
    ]
    bounds = [
        ("min_rating", "rating minimal ", ""), ("max_rating", "rating maksimal ", ""),
        ("release_year_from", "mulai tahun ", ""), ("release_year_to", "sampai tahun ", ""),
        ("min_runtime", "durasi minimal ", " menit"), ("max_runtime", "durasi maksimal ", " menit"),
    ]
    for f, before, after in bounds:
        value = _general_number(intent[f]) if "rating" in f else intent[f].cast("string")
        parts.append(F.concat(F.lit(before), value, F.lit(after)))
    return F.concat(F.lit("Sesuai filter "), F.concat_ws(", ", *parts), F.lit("."))


def passes_filters(intent: Column, movie: dict[str, Column]) -> Column:
    """Post-filter of a recommended movie: OR inside a category, AND between them.

    ``movie``: genres, cast, director, keywords, overview, original_language,
    vote_average, release_year, runtime. An unknown value fails a bound.
    """
    theme = F.concat_ws(
        " ", *(F.when(movie[c] != "", movie[c]) for c in ("keywords", "overview", "genres"))
    )
    languages = F.transform(
        F.filter(intent["original_languages"], lambda x: F.trim(x) != ""), language_code
    )
    spoken = language_code(F.coalesce(movie["original_language"], F.lit("")))
    conditions = [
        contains_any(movie["genres"], intent["preferred_genres"]),
        contains_any(movie["cast"], intent["actors"]),
        contains_any(movie["director"], intent["directors"]),
        contains_any(theme, intent["keywords"]),
        (F.size(intent["original_languages"]) == 0) | F.array_contains(languages, spoken),
    ]
    for low, high, value in [
        ("min_rating", "max_rating", "vote_average"),
        ("release_year_from", "release_year_to", "release_year"),
        ("min_runtime", "max_runtime", "runtime"),
    ]:
        conditions.append(intent[low].isNull() | F.coalesce(movie[value] >= intent[low], F.lit(False)))
        conditions.append(intent[high].isNull() | F.coalesce(movie[value] <= intent[high], F.lit(False)))
    passed = conditions[0]
    for c in conditions[1:]:
        passed = passed & c
    return intent.isNull() | passed


# Question words and the answers they lead to.
QUESTION_WORDS = {
    "plot": ["cerita", "sinopsis", "tentang apa", "plot"],
    "cast": ["aktor", "pemain", "cast"],
    "director": ["sutradara", "director"],
    "genre": ["genre", "jenis film"],
    "rating": ["rating", "nilai"],
    "runtime": ["durasi", "berapa lama", "runtime"],
}


def metadata_answer(message: Column, movie: dict[str, Column], rating_label: str = "Rating") -> Column:
    """Answer a question about one movie from its metadata.

    ``movie``: title, overview, cast, director, genres, vote_average, runtime.
    ``rating_label`` may name the source of the ratings.
    """
    asked = F.lower(message)
    title = movie["title"]

    def about(topic: str) -> Column:
        hit = F.lit(False)
        for word in QUESTION_WORDS[topic]:
            hit = hit | F.contains(asked, F.lit(word))
        return hit

    def known(value: Column, answer: Column, otherwise: Column) -> Column:
        return F.when(F.coalesce(value.cast("string"), F.lit("")) != "", answer).otherwise(otherwise)

    def say(*parts) -> Column:
        return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))

    return (
        F.when(
            about("plot"),
            known(movie["overview"], movie["overview"], say("Sinopsis ", title, " belum tersedia pada metadata kami.")),
        )
        .when(
            about("cast"),
            known(movie["cast"], say("Pemeran yang tercatat untuk ", title, ": ", movie["cast"], "."), F.lit("Data pemeran belum tersedia.")),
        )
        .when(
            about("director"),
            known(movie["director"], say(title, " disutradarai oleh ", movie["director"], "."), F.lit("Data sutradara belum tersedia.")),
        )
        .when(
            about("genre"),
            known(movie["genres"], say("Genre ", title, ": ", movie["genres"], "."), F.lit("Data genre belum tersedia.")),
        )
        .when(
            about("rating"),
            known(
                movie["vote_average"],
                say(f"{rating_label} ", title, " adalah ", half_even_text(movie["vote_average"], 1), "/10."),
                F.lit("Data rating belum tersedia."),
            ),
        )
        .when(
            about("runtime"),
            F.when(
                F.coalesce(movie["runtime"], F.lit(0)) != 0,
                say("Durasi ", title, " adalah ", movie["runtime"].cast("int"), " menit."),
            ).otherwise("Data durasi belum tersedia."),
        )
        .otherwise(
            say(
                "Saya bisa membahas sinopsis, genre, sutradara, pemeran, rating, atau durasi ",
                title,
                ". OpenAI belum aktif, jadi pertanyaan lanjutan saat ini dijawab dari metadata terstruktur.",
            )
        )
    )


def detected_entries(requests: DataFrame, intent: str = "intent") -> DataFrame:
    """(query_id, label, value) for every filled field of an intent."""
    labels = {
        "reference_title": "Film acuan", "preferred_genres": "Genre", "actors": "Aktor",
        "directors": "Sutradara", "keywords": "Keyword", "original_languages": "Bahasa",
        "min_rating": "Rating minimum", "max_rating": "Rating maksimum",
        "release_year_from": "Tahun mulai", "release_year_to": "Tahun akhir",
        "min_runtime": "Durasi minimum", "max_runtime": "Durasi maksimum",
    }
    cells = []
    for field, label in labels.items():
        value = F.col(f"{intent}.{field}")
        shown = F.array_join(value, ", ") if field in TEXT_FIELDS else value.cast("string")
        filled = F.size(value) > 0 if field in TEXT_FIELDS else value.isNotNull() & (shown != "")
        cells.append(F.struct(F.lit(label).alias("label"), F.when(filled, shown).alias("value")))
    rows = requests.select("query_id", F.explode(F.array(*cells)).alias("e"))
    return rows.select("query_id", "e.label", "e.value").filter(F.col("value").isNotNull())
