import json

import pytest
from pyspark.sql import functions as F

from marquee.operators import dedupe
from marquee.sources import payloads, readers, sinks
from marquee.sources.schemas import BASE_MOVIE, data_dictionary
from marquee.streaming import batches

DETAIL = {
    "id": 7, "runtime": 100, "status": "Released", "tagline": None, "budget": 5, "revenue": 0,
    "genres": [{"name": "Drama"}, {"name": " Drama "}, {"name": ""}, {"name": None}],
    "production_companies": [{"name": "A"}, {"name": "A"}, {"name": "B"}],
    "production_countries": [{"iso_3166_1": "US", "name": "United States"}],
    "spoken_languages": [{"english_name": "English", "name": "English"}],
    "credits": {
        "cast": [{"name": f"c{i}", "order": 12 - i, "cast_id": i} for i in range(12)] + [{"name": "last"}],
        "crew": [
            {"name": "D", "job": "Director"}, {"name": "W", "job": "Writer"}, {"name": "N", "job": "Novel"},
            {"name": "W", "job": "Story"}, {"name": "D", "job": "Director"},
        ],
    },
    "keywords": {"keywords": [], "results": [{"name": "k1"}, {"name": "k2"}]},
}


def details(spark, *records):
    return spark.createDataFrame([(json.dumps(r),) for r in records], "payload string")


def test_detail_variant_with_commas(spark):
    row = payloads.detail_rows_short(details(spark, DETAIL)).first()
    assert row["director"] == "D" and row["writers"] == "W"
    assert row["production_companies"] == "A, B" and row["production_countries"] == "US"
    assert row["top_cast"] == ", ".join(f"c{i}" for i in range(11, 1, -1))
    assert row["keywords"] == ""


def test_detail_variant_with_pipes(spark):
    row = payloads.detail_rows_wide(details(spark, DETAIL)).first()
    assert row["director"] == "D | D" and row["writers"] == "W | N | W"
    assert row["genres_detail"] == "Drama | Drama" and row["production_companies"] == "A | A | B"
    assert row["top_cast"] == " | ".join(f"c{i}" for i in range(10))
    assert row["keywords"] == "k1 | k2" and row["production_countries"] == "United States"


def test_empty_detail(spark):
    for parse in (payloads.detail_rows_short, payloads.detail_rows_wide):
        row = parse(details(spark, {"id": 1})).first()
        assert (row["id"], row["top_cast"], row["keywords"], row["writers"]) == (1, "", "", "")


def test_listing_rows(spark):
    page = {"results": [{"id": 1, "title": "a", "genre_ids": [18, 99]}, {"title": "no id"}, {"id": 2, "genre_ids": None}]}
    pages = spark.createDataFrame(
        [(json.dumps(page), "vote10", "2020-01-01", "2020-01-31", 3)],
        "payload string, source_config string, source_start_date string, source_end_date string, source_page int",
    )
    rows = payloads.listing_rows(pages, {18: "Drama"}).orderBy("id").collect()
    assert [(r["id"], r["genre_ids"], r["genres"], r["source_page"]) for r in rows] == [(1, "18,99", "Drama, 99", 3), (2, "", "", 3)]


def test_month_windows(spark):
    rows = payloads.month_windows(spark, 2020, 2021).collect()
    assert len(rows) == 24
    assert (str(rows[1]["start_date"]), str(rows[1]["end_date"])) == ("2020-02-01", "2020-02-29")


def test_batches_are_combined_in_file_order(spark, tmp_path):
    (tmp_path / "discover_b.csv").write_text('id,title,release_date\n1,second,2020-01-01\n2,"two\nlines",bad\n')
    (tmp_path / "discover_a.csv").write_text("id,title,release_date\n1,first,2019-05-05\n1,again,2019-05-05\n")
    (tmp_path / "discover_c.csv").write_text("")
    read = readers.read_batches(spark, str(tmp_path), "id bigint, title string, release_date string")
    rows = {r["id"]: (r["title"], str(r["release_date"])) for r in readers.combine_batches(read).collect()}
    assert rows == {1: ("first", "2019-05-05"), 2: ("two\nlines", "None")}
    last = dedupe.last_batch(read, readers.BATCH_ORDER)
    assert {r["id"]: r["title"] for r in last.collect()}[1] == "second"


def test_malformed_rows_are_kept_and_counted(spark, rows, tmp_path):
    (tmp_path / "a.csv").write_text("id,title,year\n1,a,2000\nx,b,2001\n2,c,20o2\n")
    (tmp_path / "b.csv").write_text("id,title,year\n3,d,2003\n")
    schema = "id bigint, title string, year int"
    assert rows(readers.read_batches(spark, str(tmp_path), schema), "id", "title") == [(1, "a"), (3, "d")]
    bad = readers.quarantined_rows(spark, str(tmp_path), schema).collect()
    assert sorted(r["text"].strip() for r in bad) == ["2,c,20o2", "x,b,2001"]
    counts = readers.batch_counts(spark, str(tmp_path), schema).collect()
    assert sorted((r["batch_file"].rsplit("/")[-1], r["n_valid"], r["n_malformed"]) for r in counts) == [("a.csv", 1, 2), ("b.csv", 1, 0)]


def test_equal_file_names_keep_folder_order(spark, tmp_path):
    for folder, title in (("b1", "first"), ("b2", "second")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.csv").write_text(f"id,title,release_date\n1,{title},2020-01-01\n")
    read = readers.read_batches(spark, [str(tmp_path / "b2"), str(tmp_path / "b1")], "id bigint, title string, release_date string")
    assert readers.combine_batches(read).first()["title"] == "first"


def test_csv_round_trip_keeps_quotes_and_lines(spark, tmp_path):
    text = 'He said "hi",\nthen left'
    df = spark.createDataFrame([(1, text)], "id bigint, title string")
    sinks.write_csv(df, str(tmp_path / "x"))
    assert readers.read_csv(spark, str(tmp_path / "x"), "id bigint, title string").first()["title"] == text


def test_enrich_renames_clashes(spark, rows):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, title string")
    more = spark.createDataFrame([(1, "A", 5)], "id bigint, title string, runtime int")
    assert rows(payloads.enrich(base, more).na.fill("").na.fill(0)) == [(1, "a", "A", 5), (2, "b", "", 0)]


def test_remaining_ids(spark, rows):
    source = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id bigint")
    assert rows(payloads.remaining_ids(source, spark.createDataFrame([(1,)], "id bigint"))) == [(2,)]


def test_collection_upsert(spark, rows, tmp_path):
    payload = spark.createDataFrame([(1, "a", None), (2, "b", 3)], "id bigint, title string, year int")
    first = spark.createDataFrame([(1, [3.0, 4.0]), (9, [1.0, 0.0])], "id bigint, vector array<double>")
    points = sinks.collection_points(first, payload)
    row = points.first()
    assert json.loads(row["payload"]) == {"title": "a"} and row["unit_vector"] == [0.6, 0.8]
    sinks.write_collection(spark, points, str(tmp_path / "v1"))
    second = sinks.collection_points(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "id bigint, vector array<double>"), payload)
    sinks.write_collection(spark, second, str(tmp_path / "v2"), current=str(tmp_path / "v1"))
    stored = spark.read.parquet(str(tmp_path / "v2"))
    assert [(r["id"], r["unit_vector"]) for r in stored.orderBy("id").collect()] == [(1, [1.0, 0.0]), (2, [0.0, 1.0])]
    with pytest.raises(ValueError):
        sinks.write_collection(spark, points.limit(0), str(tmp_path / "v3"))
    with pytest.raises(ValueError):
        sinks.write_collection(spark, points, str(tmp_path / "v2"), current=str(tmp_path / "v2"))


def test_lookup_marks_missing_ids(spark, rows):
    ids = spark.createDataFrame([(1,), (5,)], "id bigint")
    found = readers.lookup(ids, spark.createDataFrame([(1, "a")], "id bigint, title string"))
    assert rows(found, "id", "status") == [(1, "found"), (5, "not_found")]


def test_data_dictionary(spark):
    df = spark.createDataFrame([], BASE_MOVIE)
    rows = data_dictionary(df).collect()
    assert len(rows) == 20 and rows[0]["description"] == "Unique movie id."


def test_streamed_batches_are_ingested_once(spark, tmp_path):
    landing, table, progress = (tmp_path / n for n in ("landing", "table", "progress"))
    landing.mkdir()
    header = "id,title,release_date\n"
    (landing / "a.csv").write_text(header + "1,a,2020-01-01\n")
    schema = spark.createDataFrame([], "id bigint, title string, release_date string").schema

    def run():
        batches.ingest(batches.new_batches(spark, str(landing), schema), str(table), str(progress)).awaitTermination(60)
        return sorted((r["id"], r["batch_file"].rsplit("/")[-1]) for r in spark.read.parquet(str(table)).collect())

    assert run() == [(1, "a.csv")]
    (landing / "b.csv").write_text(header + "1,b,2021-01-01\n2,c,2021-01-01\n")
    assert run() == [(1, "a.csv"), (1, "b.csv"), (2, "b.csv")]
    assert run() == [(1, "a.csv"), (1, "b.csv"), (2, "b.csv")]
    last = dedupe.last_batch(spark.read.parquet(str(table)), ["batch_file"])
    assert {r["id"]: r["title"] for r in last.collect()} == {1: "b", 2: "c"}
