from datetime import datetime, timedelta

from pyspark.sql import functions as F

from marquee.operators import conversations as cv

T0 = datetime(2024, 1, 1)


def threads(spark, *data):
    return spark.createDataFrame(
        [(i, u, p, "movie", f"t{i}", T0 + timedelta(hours=i)) for i, u, p in data],
        "id bigint, user_id bigint, parent_thread_id bigint, context_type string, title string, updated_at timestamp",
    )


def messages(spark, *data):
    return spark.createDataFrame(
        [(i, t, u, p, r, c, T0 + timedelta(minutes=i)) for i, t, u, p, r, c in data],
        "id bigint, thread_id bigint, user_id bigint, parent_message_id bigint, role string, content string, created_at timestamp",
    )


def test_only_own_threads_take_messages(spark):
    t = threads(spark, (1, 7, None), (2, 8, None))
    m = messages(spark, (1, 1, 7, None, "user", "a"), (2, 2, 7, None, "user", "b"), (3, 9, 7, None, "user", "c"))
    assert [r["id"] for r in cv.insertable(m, t).collect()] == [1]


def test_constraints_split_rows_without_loss(spark):
    t = threads(spark, (1, 7, None))
    m = messages(
        spark, (1, 1, 7, None, "user", "a"), (2, 1, 7, 1, "system", ""), (3, 5, None, 99, "user", "x" * 4001),
        (4, 1, 7, 1, "assistant", "y" * 4000),
    )
    checked = cv.check_messages(m, t)
    got = {r["id"]: set(r["violations"]) for r in checked.collect()}
    assert got == {
        1: set(), 2: {"role_invalid", "content_length"},
        3: {"user_missing", "thread_unknown", "parent_unknown", "content_length"}, 4: set(),
    }
    assert cv.valid(checked).count() + cv.quarantined(checked).count() == m.count()


def test_delete_cascades_and_unlinks(spark):
    t = threads(spark, (1, 7, None), (2, 7, 1), (3, 7, 2), (4, 7, None), (5, 8, None))
    m = messages(spark, (1, 1, 7, None, "user", "a"), (2, 3, 7, 1, "user", "b"), (3, 4, 7, 2, "user", "c"), (4, 4, 7, 3, "user", "d"), (5, 5, 8, None, "user", "e"))
    removed = spark.createDataFrame([(1,), (5,)], "id bigint")
    kept, left = cv.delete_threads(t, m, removed, user=7)
    assert sorted(r["id"] for r in kept.collect()) == [4, 5]
    assert {r["id"]: r["parent_message_id"] for r in left.collect()} == {3: None, 4: 3, 5: None}


def test_history_is_the_last_messages_and_the_new_one(spark):
    m = messages(spark, *((i, 1, 7, None, "user", f"m{i}") for i in range(20)))
    new = spark.createDataFrame([(1, "new"), (2, "alone")], "thread_id bigint, content string")
    got = {r["thread_id"]: [x["content"] for x in r["input"]] for r in cv.recent_history(m, new).collect()}
    assert got == {1: [f"m{i}" for i in range(8, 20)] + ["new"], 2: ["alone"]}


def test_nested_threads_in_pages(spark):
    t = threads(spark, (1, 7, None), (2, 7, None))
    m = messages(spark, *((i, 1, 7, None, "user", f"m{i}") for i in range(25)))
    rows = cv.nested_threads(t, m, page=10).collect()
    assert [(r["id"], r["page"], len(r["messages"])) for r in rows] == [(2, 0, 0), (1, 0, 10), (1, 1, 10), (1, 2, 5)]
    assert [x["content"] for r in rows for x in r["messages"]] == [f"m{i}" for i in range(25)]


def test_merge_is_idempotent(spark, rows):
    a = threads(spark, (1, 7, None), (2, 7, None)).withColumn("title", F.lit("a"))
    b = threads(spark, (2, 7, None), (3, 7, None)).withColumn("title", F.lit("b"))
    once = cv.merged_threads(a, b)
    assert rows(once, "id", "title") == [(1, "a"), (2, "b"), (3, "b")]
    assert rows(cv.merged_threads(once, b), "id", "title") == rows(once, "id", "title")
    assert [r["id"] for r in once.collect()] == [3, 2, 1]


def test_movie_threads_newest_first(spark):
    t = threads(spark, (1, 7, None), (2, 8, None), (3, 7, None))
    assert [r["id"] for r in cv.movie_threads(t, 7).collect()] == [3, 1]


def test_messages_without_a_time_are_nested(spark):
    threads = spark.createDataFrame([(1, "2024-01-01")], "id bigint, updated_at string")
    rows = [(1, 1, None), (2, 1, "2024-01-01 00:00:05"), (3, 1, None)]
    messages = spark.createDataFrame(rows, "id bigint, thread_id bigint, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    (row,) = cv.nested_threads(threads, messages).collect()
    assert [m["id"] for m in row["messages"]] == [1, 3, 2]


def test_missing_times_are_violations(spark):
    threads = spark.createDataFrame([(1, 7, "t", "movie", None, "2024-01-01", None)], "id bigint, user_id bigint, title string, context_type string, parent_thread_id bigint, created_at string, updated_at string")
    assert cv.check_threads(threads).first()["violations"] == ["updated_at_missing"]
    messages = spark.createDataFrame([(1, 1, 7, None, "user", "hi", None), (2, 1, 7, 1, "user", "hi", "2024"), (3, 1, 7, 9, "user", "hi", "2024")], "id bigint, thread_id bigint, user_id bigint, parent_message_id bigint, role string, content string, created_at string")
    found = {r["id"]: r["violations"] for r in cv.check_messages(messages, threads).collect()}
    assert found == {1: ["created_at_missing"], 2: [], 3: ["parent_unknown"]}


def test_deep_and_circular_threads_end(spark):
    links = [(i, i - 1 if i else None) for i in range(12)] + [(50, 51), (51, 50)]
    threads = spark.createDataFrame(links, "id bigint, parent_thread_id bigint")
    gone = cv.cascade(threads, spark.createDataFrame([(3,), (50,)], "id bigint"))
    assert sorted(r["id"] for r in gone.collect()) == [3, 4, 5, 6, 7, 8, 9, 10, 11, 50, 51]
