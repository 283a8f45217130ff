"""The request cases: titles, intents, filters, answers, routing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.operators import intents as it, requests as rq
from marquee.sources.schemas import INTENT


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "query_id bigint, message string")


def column(df, c):
    return [r["x"] for r in df.orderBy("query_id").select(c.alias("x")).collect()]


def test_titles(spark):
    asked = texts(
        spark, "Saya ingin nonton film seperti Batman", "Rekomendasi mirip Interstellar", "recommend  Toy   Story!?",
        "  Avatar . ", "LIKE Titanic",
    )
    assert column(asked, it.extract_title("message")) == ["Batman", "Interstellar", "Toy Story", "Avatar", "Titanic"]


def parsed(spark, message):
    return it.with_intent(texts(spark, message)).first()["intent"]


def test_korean_film_after_2015(spark):
    intent = parsed(spark, "Film Korea setelah 2015 berdurasi maksimal 130 menit")
    assert intent["original_languages"] == ["ko"]
    assert (intent["release_year_from"], intent["max_runtime"], intent["min_runtime"]) == (2015, 130, None)


def test_a_rating_can_also_set_the_runtime(spark):
    intent = parsed(spark, "rating minimal 75")
    assert (intent["min_rating"], intent["min_runtime"]) == (75.0, 75)
    assert parsed(spark, "nilai di atas 7,5")["min_rating"] == 7.5


def test_words_count_only_whole(spark):
    assert parsed(spark, "warung dramatis") is None
    intent = parsed(spark, "Sci-Fi atau fiksi ilmiah, komedi; Bahasa Korea dan korean")
    assert intent["preferred_genres"] == ["comedy", "science fiction"]
    assert intent["original_languages"] == ["ko"]


def test_every_alias_is_found_alone(spark):
    for words, field in [(it.GENRE_WORDS, "preferred_genres"), (it.LANGUAGE_CODES, "original_languages")]:
        rows = it.with_intent(texts(spark, *words)).orderBy("query_id").collect()
        for row, (word, meaning) in zip(rows, words.items()):
            assert meaning in row["intent"][field], word


def intents(spark, **fields):
    base = {f.name: [] if f.name in it.TEXT_FIELDS else None for f in INTENT}
    return spark.createDataFrame([(0, base | fields)], f"query_id bigint, intent {INTENT.simpleString()}")


def test_keywords_that_repeat_the_title(spark):
    df = intents(spark, reference_title="Interstellar", keywords=["similar to Interstellar", "space exploration", "mirip dengan itu"])
    assert column(df, it.cleaned_keywords(F.col("intent"))) == [["space exploration"]]
    df = intents(spark, keywords=["similar to x"])
    assert column(df, it.cleaned_keywords(F.col("intent"))) == [["similar to x"]]


def test_has_filters(spark):
    assert column(intents(spark, actors=["Christian Bale"], max_runtime=150), it.has_filters(F.col("intent"))) == [True]
    assert column(intents(spark, actors=["  "]), it.has_filters(F.col("intent"))) == [False]
    empty = spark.createDataFrame([(0, None)], f"query_id bigint, intent {INTENT.simpleString()}")
    assert column(empty, it.has_filters(F.col("intent"))) == [False]


@pytest.mark.parametrize(
    "fields, error",
    [
        ({}, "no_filter"),
        ({"min_rating": 8.0, "max_rating": 7.0}, "min_rating_above_max_rating"),
        ({"release_year_from": 2020, "release_year_to": 2010}, "year_from_above_year_to"),
        ({"min_runtime": 100, "max_runtime": 90}, "min_runtime_above_max_runtime"),
        ({"min_rating": 75.0}, "rating_out_of_range"),
        ({"min_runtime": 0}, "runtime_out_of_range"),
        ({"min_rating": 7.0}, None),
    ],
)
def test_request_errors(spark, fields, error):
    assert column(intents(spark, **fields), it.request_error(F.col("intent"), F.lit(10))) == [error]


def test_filter_reason(spark):
    df = intents(spark, preferred_genres=["drama", "war"], min_rating=7.0, max_rating=8.25, release_year_from=2000, max_runtime=120)
    assert column(df, it.filter_reason(F.col("intent"))) == [
        "Sesuai filter genre drama, war, rating minimal 7, rating maksimal 8.25, mulai tahun 2000, durasi maksimal 120 menit."
    ]


MOVIES = [
    (1, 2020, "science fiction drama", "en", 120, "Jane Director", "Actor One, Actor Two", "space, time travel", 8.0, "A journey through space and time."),
    (2, 2010, "comedy", "fr", 150, "Other Director", "Another Actor", "friendship", 6.0, None),
]


def test_all_constraints_keep_one_movie(spark):
    movies = spark.createDataFrame(
        MOVIES,
        "id bigint, release_year int, genres string, original_language string, runtime int, director string, "
        "cast string, keywords string, vote_average double, overview string",
    )
    full = dict(
        reference_title="Interstellar", preferred_genres=["science fiction"], actors=["Actor One"],
        directors=["Jane Director"], keywords=["time travel"], original_languages=["English"], min_rating=7.0,
        max_rating=9.0, release_year_from=2015, release_year_to=2025, min_runtime=100, max_runtime=130,
    )
    movie = {c: F.col(c) for c in movies.columns if c != "id"}

    def kept(**fields):
        pairs = movies.crossJoin(intents(spark, **fields))
        return [r["id"] for r in pairs.filter(it.passes_filters(F.col("intent"), movie)).orderBy("id").collect()]

    assert kept(**full) == [1]
    assert kept() == [1, 2]
    for field, value in full.items():
        if field not in ("reference_title", "max_rating", "release_year_to", "min_runtime"):
            assert kept(**{field: value}) == [1], field
    assert kept(keywords=["comedy"]) == [2]  # keywords also look at the genres


def answer_to(spark, message, **movie):
    base = dict(title="Interstellar", overview="", cast=None, director=None, genres=None, vote_average=None, runtime=None) | movie
    df = spark.createDataFrame(
        [(0, message, *base.values())],
        "query_id bigint, message string, title string, overview string, cast string, director string, genres string, vote_average double, runtime double",
    )
    return column(df, it.metadata_answer(F.col("message"), {c: F.col(c) for c in base}))[0]


def test_answers_from_metadata(spark):
    assert "Christopher Nolan" in answer_to(spark, "Siapa sutradaranya?", director="Christopher Nolan")
    assert answer_to(spark, "plot?") == "Sinopsis Interstellar belum tersedia pada metadata kami."
    assert answer_to(spark, "Berapa RATING?", vote_average=8.25) == "Rating Interstellar adalah 8.2/10."
    assert answer_to(spark, "berapa lama?", runtime=169.0) == "Durasi Interstellar adalah 169 menit."
    assert answer_to(spark, "durasi?", runtime=0.0) == "Data durasi belum tersedia."
    assert answer_to(spark, "halo").startswith("Saya bisa membahas")


def test_routes(spark):
    asked = texts(spark, "Film drama", "mirip Titanic", "Titanic")
    assert column(rq.routed(asked), F.col("mode")) == ["discovery", "similarity", "similarity"]
    given = intents(spark, clarification_needed=True).withColumn("message", F.lit("hm"))
    assert column(rq.routed(given), F.col("mode")) == ["clarification"]
    titled = intents(spark, reference_title="Up", min_rating=7.0).withColumn("message", F.lit("hm"))
    row = rq.routed(titled).first()
    assert (row["mode"], row["title"]) == ("similarity", "Up")


def test_answer_covers_every_status(spark):
    import __spark_entry__ as entry
    from marquee.plans.served import movies, vectors

    sf = "/root/testdata/sf0.001"
    shown = movies(spark, sf)
    one = shown.join(vectors(spark, sf), "id").join(shown.groupBy("title").count().filter("count = 1"), "title")
    title = one.orderBy("id").first()["title"]
    asked = texts(spark, "film drama sebelum 1700", f"mirip {title}", "seperti qqqqqqqq", "mirip red", "film english", "hm")
    asked = asked.withColumn("top_k", F.lit(3))
    clarify = F.when(F.col("query_id") == 5, F.lit(True))
    asked = asked.withColumn("intent", F.when(clarify, it.intent_of(clarification_needed=F.lit(True))))
    got = {r["query_id"]: r for r in rq.answer(asked, shown, vectors(spark, sf)).collect()}
    assert len(got) == 6
    assert [got[i]["status"] for i in (0, 1, 2, 5)] == ["not_found", "recommendations", "not_found", "needs_clarification"]
    assert len(got[1]["recommendations"]) == 3 and got[1]["source_id"] not in [r["id"] for r in got[1]["recommendations"]]
    assert [r["rank"] for r in got[1]["recommendations"]] == [1, 2, 3]
    assert got[3]["status"] in ("needs_selection", "recommendations")
    assert got[1]["analysis"]["candidate_pool_target"] == 50
    assert "t4_catalogue_ranking" in entry.queries()


def test_pool_and_length_follow_each_request(spark):
    rnd = np.random.default_rng(3)
    n = 320
    table = rnd.normal(size=(n, 6)) * 0.4 + 1
    movies = spark.createDataFrame(
        [(i, f"m{i}", float(rnd.uniform(0, 10)), float(rnd.integers(0, 900)), float(rnd.uniform(0, 90)), float(rnd.uniform(0, 100))) for i in range(n)],
        "id bigint, title string, vote_average double, vote_count double, popularity double, recommendation_quality_score double",
    )
    for c in ("genres_text", "top_cast_text", "director_clean", "keywords_text", "overview_clean", "original_language"):
        movies = movies.withColumn(c, F.lit("x"))
    movies = movies.withColumns({"release_year": F.lit(2000), "runtime": F.lit(100.0)})
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(table)], "id bigint, vector array<double>")
    asked = spark.createDataFrame([(1, 5, 1), (2, 5, 10), (3, 5, 20), (4, 9, 7)], "query_id bigint, source_id bigint, top_k int")
    intent = it.with_intent(spark.createDataFrame([("halo",)], "message string"), name="intent").select("intent").limit(0)
    asked = asked.withColumn("intent", F.lit(None).cast(intent.schema["intent"].dataType))
    got = {}
    for r in rq.filtered_similar(asked, movies, vectors).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    for query, source, k in [(1, 5, 1), (2, 5, 10), (3, 5, 20), (4, 9, 7)]:
        alone = asked.filter(F.col("query_id") == query).drop("top_k")
        want = rq.filtered_similar(alone, movies, vectors, k).orderBy("rank").collect()
        assert got[query] == [r["id"] for r in want] and len(want) == k
    unit = table / np.linalg.norm(table, axis=1, keepdims=True)
    near = [i for i in np.argsort(-(unit @ unit[5])) if i != 5][:50]
    assert set(got[1]) <= set(near)


def test_requests_outside_the_limits_are_refused(spark):
    ok = rq.is_valid(F.col("message"), F.col("top_k"))
    rows = [("a", 1), ("a" * 500, 20), ("", 5), ("a" * 501, 5), ("a", 0), ("a", 21), (None, 5)]
    df = spark.createDataFrame(rows, "message string, top_k int")
    assert [r[0] for r in df.select(ok).collect()] == [True, True, False, False, False, False, False]
