"""Keyed tables, incremental enrichment, unreadable files, saved models, observed writes, places and cascades."""

import gzip
import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Word2VecModel
from pyspark.sql import functions as F

from marquee.operators import conversations as cv, text_models as tm
from marquee.operators.places import with_places
from marquee.sources import readers, sinks
from marquee.streaming import batches

KEYED = "id bigint, title string"


def keyed(spark, *pairs):
    return spark.createDataFrame(list(pairs), KEYED)


def files(spark, path):
    return {(r.file, r.modified, r.bytes) for r in sinks.file_states(spark, path).collect()}


def test_an_upsert_rewrites_touched_buckets_only(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_buckets(keyed(spark, *((i, f"t{i}") for i in range(100))), path, buckets=16)
    before = files(spark, path)
    touched = sinks.upsert_buckets(spark, keyed(spark, (3, "new"), (500, "added")), path, buckets=16)
    after = files(spark, path)
    assert 1 <= len(touched) <= 2
    assert {f for f, *_ in before - after} == {f for f, *_ in before if any(f"bucket={b}/" in f for b in touched)}
    got = dict(rows(spark.read.parquet(path), "id", "title"))
    assert got == {i: f"t{i}" for i in range(100)} | {3: "new", 500: "added"}


def test_an_upsert_can_be_repeated(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_buckets(keyed(spark, (1, "a"), (2, "b")), path, buckets=4)
    for _ in range(2):
        sinks.upsert_buckets(spark, keyed(spark, (2, "c"), (None, "no key")), path, buckets=4, parts=3)
        assert rows(spark.read.parquet(path).filter("id IS NOT NULL"), "id", "title") == [(1, "a"), (2, "c")]
    assert sinks.upsert_buckets(spark, keyed(spark).limit(0), path, buckets=4) == []


def enrichment(spark, folder, table, progress):
    schema = spark.createDataFrame([], KEYED).schema
    batches.enrich(batches.new_batches(spark, str(folder), schema), str(table), str(progress), 4).awaitTermination(120)
    return sorted((r.id, r.title, r.batch_id) for r in spark.read.parquet(str(table)).collect())


def test_enrichment_keeps_the_last_batch_and_can_be_replayed(spark, tmp_path):
    landing, table, progress = (tmp_path / n for n in ("landing", "table", "progress"))
    landing.mkdir()
    (landing / "b.csv").write_text("id,title\n1,old\n1,newer\nx,bad\n2,two\n")
    (landing / "0.csv.gz").write_bytes(gzip.compress(b"id,title\n9,nine\n")[:-9])
    assert enrichment(spark, landing, table, progress) == [(1, "newer", 0), (2, "two", 0)]
    (landing / "c.csv").write_text("id,title\n2,last\n3,three\n")
    (landing / "a.csv").write_text("id,title\n1,late\n4,four\n")
    second = enrichment(spark, landing, table, progress)
    assert second == [(1, "newer", 0), (2, "last", 1), (3, "three", 1), (4, "four", 1)]
    assert enrichment(spark, landing, table, progress) == second
    # all files once more, under another progress folder: numbered anew, nothing changes
    replayed = enrichment(spark, landing, table, tmp_path / "again")
    assert [r[:2] for r in replayed] == [r[:2] for r in second]


def test_the_same_micro_batch_twice(spark, tmp_path):
    table = str(tmp_path / "t")
    columns = "id bigint, title string, batch_file string, batch_row bigint"
    for _ in range(2):
        for number, rows in enumerate(([(1, "a", "f1", 0), (2, "b", "f1", 1)], [(1, "c", "f2", 0)])):
            batches.merge_batch(spark, spark.createDataFrame(rows, columns), number, table, 4)
        got = sorted((r.id, r.title, r.batch_id) for r in spark.read.parquet(table).collect())
        assert got == [(1, "c", 1), (2, "b", 0)]


def test_unreadable_files_are_left_out_and_listed(spark, rows, tmp_path):
    (tmp_path / "a.csv").write_text("id,title\n1,a\n")
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(b"id,title\n2,b\n" * 1)[:-9])
    (tmp_path / "c.csv").write_bytes(b"id,title\n3,\xff\xfe\n")
    (tmp_path / "d.csv").write_text(" \n")
    (tmp_path / "e.csv.gz").write_bytes(gzip.compress(b"id,title\n5,e\n"))
    (tmp_path / "f.csv").write_text("id,title\n")
    found = {r.file.rsplit("/")[-1]: r.reason for r in readers.unreadable_files(spark, str(tmp_path)).collect()}
    assert found == {"b.csv.gz": "damaged", "c.csv": "not_text", "d.csv": "empty"}
    assert rows(readers.read_batches(spark, str(tmp_path), KEYED), "id", "title") == [(1, "a"), (5, "e")]


def test_files_without_line_ends_are_split(spark, tmp_path):
    spark.range(20000).select("id", F.concat(F.lit("title "), "id").alias("title")).coalesce(1).write.option("header", True).csv(str(tmp_path / "x"))
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        whole, split = (readers.read_csv(spark, str(tmp_path / "x"), KEYED, line_ends=e) for e in (True, False))
        assert whole.rdd.getNumPartitions() == 1 < split.rdd.getNumPartitions()
        assert whole.count() == split.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)


@pytest.fixture(scope="module")
def documents(spark):
    rnd = random.Random(1)
    return spark.createDataFrame([(i, " ".join(rnd.choice(["space", "river", "stone", "night", "glass"]) for _ in range(12))) for i in range(40)], "id bigint, movie_document string")


def test_a_pipeline_is_reloaded_in_another_session(spark, documents, tmp_path):
    model, features = tm.text_features(documents, 100, 1.0)
    sinks.save_model(model, str(tmp_path / "m"))
    other = spark.newSession()
    again = sinks.load_model(PipelineModel, str(tmp_path / "m"), other).transform(documents)
    pairs = features.select("id", "tfidf").join(again.select("id", F.col("tfidf").alias("other")), "id").collect()
    assert len(pairs) == 40 and all(r.tfidf == r.other for r in pairs)


def test_word_vectors_are_reloaded(spark, documents, tmp_path):
    prepared = tm.with_tokens(documents)
    model = tm.fit_word2vec(prepared, size=4, min_count=1, iterations=1)
    sinks.save_model(model, str(tmp_path / "w"))
    again = sinks.load_model(Word2VecModel, str(tmp_path / "w"))
    words = lambda m: {r.word: r.vector for r in m.getVectors().collect()}
    assert words(model) == words(again)


def test_counters_beside_the_write(spark, tmp_path):
    df = spark.range(1000).withColumn("even", F.col("id") % 2 == 0)
    seen = sinks.observed(df, lambda d: sinks.write_parquet(d, str(tmp_path / "x")), n=F.count("*"), even=F.count_if("even"), most=F.max("id"))
    assert seen == {"n": 1000, "even": 500, "most": 999} and spark.read.parquet(str(tmp_path / "x")).count() == 1000


def test_places_are_those_of_one_sort(spark):
    rnd = random.Random(2)
    values = [rnd.choice([None, 1, 1, 1, 2, 50]) for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id bigint, v int").repartition(7)
    got = {r.id: r.place for r in with_places(df, [F.asc_nulls_first("v"), F.asc("id")]).collect()}
    order = sorted(range(500), key=lambda i: (values[i] is not None, values[i] or 0, i))
    assert got == {i: p for p, i in enumerate(order)}
    assert with_places(df.limit(0), [F.asc("id")]).count() == 0


def test_one_moment_of_a_thread_is_many_tasks(spark):
    """All messages of a thread at one time: their places still come from ranges."""
    threads = spark.createDataFrame([(1, "2024-01-01")], "id bigint, updated_at string")
    sent = spark.range(3000).select("id", F.lit(1).cast("bigint").alias("thread_id"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    pages = cv.nested_threads(threads, sent, page=1000).collect()
    assert [m["id"] for p in pages for m in p["messages"]] == list(range(3000)) and [p["page"] for p in pages] == [0, 1, 2]


def test_cascade_against_plain_python(spark):
    rnd = random.Random(3)
    parent = {i: rnd.choice([None, *range(i)]) if i % 40 else None for i in range(1, 200)}
    parent |= {i: i - 1 for i in range(300, 420)} | {500: 502, 501: 500, 502: 501, 503: 502, 600: 600}
    removed = {3, 17, 299, 350, 501, 600, 999}
    gone = set(removed)
    for i in parent:
        seen, at = [], i
        while at is not None and at not in seen:
            seen.append(at)
            at = parent.get(at)
        if removed & set(seen):
            gone.add(i)
    threads = spark.createDataFrame([(i, p) for i, p in parent.items()], "id bigint, parent_thread_id bigint")
    got = cv.cascade(threads, spark.createDataFrame([(i,) for i in removed], "id bigint")).collect()
    assert sorted(r.id for r in got) == sorted(gone)


def test_constraints_scan_messages_once_per_join(spark, tmp_path):
    spark.createDataFrame([(1, 1, 7, None, "user", "a")], "id bigint, thread_id bigint, user_id bigint, parent_message_id bigint, role string, content string").write.parquet(str(tmp_path / "m"))
    sent = spark.read.parquet(str(tmp_path / "m"))
    threads = spark.createDataFrame([(1, 7)], "id bigint, user_id bigint")
    plan = cv.check_messages(sent, threads)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2  # the messages, and the parents among them
