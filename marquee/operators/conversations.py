"""Thread and message tables: checks, ownership, merge, nesting, deletion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marquee.functions.columns import union_all
from marquee.operators.dedupe import last_writer_wins, top_per_key
from marquee.operators.places import with_places
from marquee.session import cut_lineage
from marquee.sources.sinks import upserted

# The allowed roles, contexts and content lengths, and the history that is kept.
ROLES = ["user", "assistant"]
CONTEXTS = ["recommendation", "movie"]
CONTENT_LENGTHS = (1, 4000)
HISTORY = 12
# Shares that rows without a key are dealt into.
_SPREAD = 4096


def owned(rows: DataFrame, user: Column | int | str) -> DataFrame:
    """The rows of one user."""
    return rows.filter(F.col("user_id") == user)


def insertable(messages: DataFrame, threads: DataFrame) -> DataFrame:
    """Messages that go to a thread of their own user."""
    own = threads.select(F.col("id").alias("thread_id"), "user_id")
    return messages.join(own, ["thread_id", "user_id"], "left_semi")


def _checked(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    reasons = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items())))
    return rows.withColumn("violations", reasons)


def _matched(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Left join in which rows without a key, which match nothing, are dealt by their id instead of meeting in one task."""
    spread = F.when(F.col(key).isNull(), F.pmod(F.xxhash64("id"), F.lit(_SPREAD))).otherwise(0)
    joined = rows.withColumn("_spread", spread).join(known.withColumn("_spread", F.lit(0).cast("bigint")), [key, "_spread"], "left")
    return joined.select(*rows.columns, *(c for c in known.columns if c != key))


def check_messages(messages: DataFrame, threads: DataFrame) -> DataFrame:
    """Messages with the names of the constraints they break (none: valid)."""
    known = threads.select(F.col("id").alias("thread_id"), F.lit(True).alias("_known"))
    parents = messages.select(F.col("id").alias("parent_message_id"), F.lit(True).alias("_parent"))
    joined = _matched(_matched(messages, known, "thread_id"), parents, "parent_message_id")
    rules = {
        "user_missing": F.col("user_id").isNotNull(),
        "thread_unknown": F.col("_known"),
        "parent_unknown": F.col("parent_message_id").isNull() | F.col("_parent"),
        "role_invalid": F.col("role").isin(ROLES),
        "content_length": F.length("content").between(*CONTENT_LENGTHS),
        **_timed(messages, "created_at"),
    }
    return _checked(joined, rules).drop("_known", "_parent")


def _timed(rows: DataFrame, *columns: str) -> dict[str, Column]:
    return {f"{c}_missing": F.col(c).isNotNull() for c in columns if c in rows.columns}


def check_threads(threads: DataFrame) -> DataFrame:
    parents = threads.select(F.col("id").alias("parent_thread_id"), F.lit(True).alias("_parent"))
    joined = _matched(threads, parents, "parent_thread_id")
    rules = {
        "user_missing": F.col("user_id").isNotNull(),
        "title_missing": F.col("title").isNotNull(),
        "context_invalid": F.col("context_type").isin(CONTEXTS),
        "parent_unknown": F.col("parent_thread_id").isNull() | F.col("_parent"),
        **_timed(threads, "created_at", "updated_at"),
    }
    return _checked(joined, rules).drop("_parent")


def valid(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("violations") == 0).drop("violations")


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("violations") > 0)


def recent_history(
    messages: DataFrame, new: DataFrame, order: Sequence[str] = ("created_at", "id"), keep: int = HISTORY
) -> DataFrame:
    """The last messages of each conversation in order, then the new one.

    ``new``: thread_id, content. The window is cut before anything is collected.
    """
    last = top_per_key(messages, ["thread_id"], [F.desc(c) for c in order], keep, "_back")
    history = last.select("thread_id", (-F.col("_back")).alias("place"), "role", "content")
    asked = new.select("thread_id", F.lit(0).alias("place"), F.lit("user").alias("role"), "content")
    listed = F.array_sort(F.collect_list(F.struct("place", "role", "content")))
    return (
        history.unionByName(asked)
        .groupBy("thread_id")
        .agg(F.transform(listed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("input"))
    )


def nested_threads(threads: DataFrame, messages: DataFrame, page: int = 1000) -> DataFrame:
    """Threads with their messages in time order, newest thread first.

    The messages of a thread come in pages: rows of (thread, page number,
    messages), so a thread of any length is spread over rows and tasks instead
    of one unbounded array. A thread of up to ``page`` messages is one row, and
    one without messages has an empty page.
    """
    numbered = _paged(messages, page)
    fields = [c for c in ("id", "role", "content", "parent_message_id", "metadata", "created_at") if c in messages.columns]
    listed = F.array_sort(F.collect_list(F.struct("created_at", "_place", F.struct(*fields).alias("m"))))
    pages = numbered.groupBy("thread_id", "page").agg(F.transform(listed, lambda x: x["m"]).alias("messages"))
    empty = F.array().cast(pages.schema["messages"].dataType)
    joined = threads.join(pages.withColumnRenamed("thread_id", "id"), "id", "left")
    return joined.withColumns(
        {"page": F.coalesce("page", F.lit(0)), "messages": F.coalesce("messages", empty)}
    ).orderBy(F.desc("updated_at"), "id", "page")


def _paged(messages: DataFrame, page: int) -> DataFrame:
    """Page numbers in time order, without one task per thread; messages without a time come first.

    All messages are placed in one order by thread and time, whose ranges cut long threads, and even one
    moment of a thread, into tasks; the first place of a thread makes its places start at 0.
    """
    placed = with_places(messages, [F.asc_nulls_first("thread_id"), F.asc_nulls_first("created_at"), F.asc_nulls_first("id")], "_all")
    first = placed.groupBy(F.col("thread_id").alias("_thread")).agg(F.min("_all").alias("_first"))
    own = placed.join(first, F.col("thread_id").eqNullSafe(F.col("_thread"))).withColumn("_place", F.col("_all") - F.col("_first"))
    return own.withColumn("page", F.floor(F.col("_place") / page).cast("int")).drop("_all", "_thread", "_first")


def movie_threads(threads: DataFrame, user: Column | int | str) -> DataFrame:
    """A user's movie threads, newest first."""
    mine = owned(threads, user).filter(F.col("context_type") == "movie")
    return mine.orderBy(F.desc("updated_at"), "id")


def merged_threads(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Newest version of every thread of two replicas, newest first; the second wins ties."""
    return last_writer_wins(local, remote).orderBy(F.desc("updated_at"), "id")


def written_back(stored: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """The stored table after the merged replicas were upserted into it."""
    return upserted(stored, last_writer_wins(local, remote))


def cascade(threads: DataFrame, removed: DataFrame) -> DataFrame:
    """Ids of the removed threads and of all their descendants; thread ids are unique.

    Pointer doubling: every thread knows an ancestor, and whether a removed thread lies on the way to it. In each
    round threads that are still open take over what their ancestor knows, which doubles the way, so a chain of n threads
    takes log2(n) rounds instead of n. A thread is settled when its way holds a removed thread or ends; on a
    cycle the rounds end when the way is longer than there are threads. Each round joins on the ancestor's id and
    is written to the checkpoint folder, so the plan does not grow.
    """
    gone = removed.select("id").distinct()
    links = threads.select("id", F.col("parent_thread_id").alias("up")).filter("up IS NOT NULL")
    hits = links.join(gone.withColumnsRenamed({"id": "up"}).withColumn("_hit", F.lit(True)), "up", "left")
    state = cut_lineage(hits.select("id", "up", F.coalesce("_hit", F.lit(False)).alias("hit")))
    way, size = 1, state.count()
    while way <= size:
        far = state.select(F.col("id").alias("up"), F.col("up").alias("_next"), F.col("hit").alias("_hit"))
        moved = state.filter("NOT hit AND up IS NOT NULL").join(far, "up", "left")
        step = moved.select("id", F.col("_next").alias("up"), F.coalesce("_hit", F.lit(False)).alias("hit"))
        settled = state.filter("hit OR up IS NULL")
        state, way = cut_lineage(settled.unionByName(step)), 2 * way
        if state.filter("NOT hit AND up IS NOT NULL").isEmpty():
            break
    return gone.unionByName(state.filter("hit").select("id")).distinct()


def delete_threads(
    threads: DataFrame, messages: DataFrame, removed: DataFrame, user: Column | int | str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Tables without the removed threads, their children and all their messages.

    With a user, only that user's threads can be removed. A kept message whose
    parent message is gone loses the link.
    """
    asked = threads.join(removed.select("id"), "id", "left_semi")
    if user is not None:
        asked = owned(asked, user)
    gone = cascade(threads, asked)
    kept = threads.join(gone, "id", "left_anti")
    left = messages.join(gone.withColumnRenamed("id", "thread_id"), "thread_id", "left_anti")
    there = left.select(F.col("id").alias("parent_message_id"), F.lit(True).alias("_there"))
    linked = _matched(left, there, "parent_message_id")
    return kept, linked.withColumn(
        "parent_message_id", F.when(F.col("_there"), F.col("parent_message_id"))
    ).drop("_there")
