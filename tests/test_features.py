import pytest
from pyspark.sql import functions as F

from marquee.functions.columns import defaults, first_available, long_table, require
from marquee.operators import dedupe, features as ft, profile as pf


def test_casts_coerce_and_dates_parse(spark):
    df = spark.createDataFrame([("7", "x", "2020-02-30", "bad")], "id string, runtime string, release_date string, collected_at string")
    row = ft.cast_columns(df).first()
    assert (row["id"], row["runtime"], row["release_date_parsed"], row["collected_at_ts"]) == (7, None, None, None)


def test_ranges_are_repaired(spark):
    df = spark.createDataFrame([(11.0, -3), (-0.1, 5), (10.0, 0), (None, None)], "vote_average double, vote_count bigint")
    assert [tuple(r) for r in ft.repair_ranges(df).collect()] == [(None, 0), (None, 5), (10.0, 0), (None, None)]


def test_genre_flag_never_falls_back_unless_fixed(spark):
    df = ft.fill_texts(spark.createDataFrame([(1, "Drama, War", None)], "id bigint, genres string, genres_detail string"))
    assert ft.with_availability(df).first()["is_genre_available"] == 0
    assert ft.with_availability(df, fix_genre_flag=True).first()["is_genre_available"] == 1


def test_raw_genres_stay_one_item(spark):
    df = ft.fill_texts(spark.createDataFrame([(1, "Drama, War", "")], "id bigint, genres string, genres_detail string"))
    row = ft.with_lists(ft.with_clean_texts(df)).first()
    assert row["genres_final_list"] == ["drama war"]


def test_profit_needs_both_amounts(spark):
    df = spark.createDataFrame([(100.0, 150.0), (0.0, 5.0), (None, 5.0)], "budget double, revenue double")
    got = [(r["profit"], r["roi"], r["has_budget_revenue"]) for r in ft.with_finance(df).collect()]
    assert got == [(50.0, 0.5, 1), (None, None, 0), (None, None, 0)]


def test_required_and_default_columns(spark):
    df = spark.createDataFrame([(1, None)], "id bigint, homepage string")
    with pytest.raises(ValueError, match="title"):
        require(df, ["id", "title"])
    with pytest.raises(ValueError):
        first_available(df, ["movie_document"])
    row = defaults(df, {"homepage": "", "runtime": 0.0}).first()
    assert (row["homepage"], row["runtime"]) == ("", 0.0)


def test_dedupe_has_a_total_order(spark, rows):
    data = [(1, 0.5, 10, "a"), (1, 0.5, 10, "b"), (1, None, 99, "c"), (2, None, None, "d")]
    df = spark.createDataFrame(data, "id bigint, metadata_completeness_score double, vote_count bigint, title string")
    tie = [F.col("title")]
    expected = [(1, "a"), (2, "d")]
    assert rows(dedupe.most_complete(df, tie), "id", "title") == expected
    assert rows(dedupe.most_complete(df.orderBy(F.desc("title")), tie), "id", "title") == expected


def test_first_and_last_batch(spark, rows):
    data = [(1, "f1", 0, "a"), (1, "f2", 0, "b"), (1, "f2", 1, "c"), (2, "f1", 5, "d")]
    df = spark.createDataFrame(data, "id bigint, file string, pos int, title string")
    assert rows(dedupe.last_batch(df, ["file", "pos"]), "id", "title") == [(1, "c"), (2, "d")]
    assert rows(dedupe.first_batch(df, ["file", "pos"]), "id", "title") == [(1, "a"), (2, "d")]


def test_last_writer_wins_and_ties(spark, rows):
    local = spark.createDataFrame([("t", 5, "local"), ("u", 9, "local")], "id string, updated_at bigint, title string")
    remote = spark.createDataFrame([("t", 5, "remote"), ("u", 1, "remote")], "id string, updated_at bigint, title string")
    merged = dedupe.last_writer_wins(local, remote)
    assert rows(merged, "id", "title") == [("t", "remote"), ("u", "local")]
    assert rows(dedupe.last_writer_wins(merged, merged)) == rows(merged)


def test_missing_words_count_as_missing(spark):
    df = spark.createDataFrame([("NaN",), (" ",), (None,), ("none",), ("x",)], "title string")
    row = pf.missing_values(df).first()
    assert (row["missing_count"], row["missing_pct"]) == (4, 80.0)


def test_correlation_with_nulls(spark):
    data = [(1.0, 2.0), (2.0, 4.0), (3.0, None), (4.0, 8.0)]
    df = spark.createDataFrame(data, "popularity double, vote_average double")
    names = ["popularity", "vote_average"]

    def off_diagonal(found):
        return found.filter("column_a = 'popularity' and column_b = 'vote_average'").first()["correlation"]

    assert off_diagonal(pf.correlations(df, names, nulls_as_zero=False)) == 1.0
    assert off_diagonal(pf.correlations(df, names)) == round(df.stat.corr(*names), 6)


def test_histogram_matches_numpy(spark):
    import numpy as np

    values = [0.0, 0.5, 1.0, 1.0, 2.5, 9.99, 10.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got = [r["frequency"] for r in pf.histogram(df, "x", 4).orderBy("bin").collect()]
    assert got == list(np.histogram(values, bins=4)[0])


def test_long_table_writes_null_as_blank(spark, rows):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert rows(long_table(df)) == [("a", "1"), ("b", "")]


def test_hash_sample_ignores_partitions(spark, rows):
    df = spark.range(1000)
    first = rows(pf.hash_sample(df, "id", 0.2))
    assert rows(pf.hash_sample(df.repartition(7), "id", 0.2)) == first
    assert 130 < len(first) < 270
