"""Free-text requests in bulk, and conversation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions.strings import contains_any
from marquee.operators import conversations as cv, intents as it, requests as rq
from marquee.operators.dedupe import last_writer_wins
from marquee.plans.registry import query
from marquee.plans.served import MESSAGES_SQL, _grouped_parts, messages, movies, vectors
from marquee.plans.testbed import prepared_sql, sql, table
from marquee.sources.payloads import genre_names
from marquee.sources.sinks import upserted

# -- requests ----------------------------------------------------------------------------------------

_SPACES = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


@query(
    "r1_title_of_message",
    f"""WITH {MESSAGES_SQL.strip()}, said AS (SELECT query_id, {_SPACES.format(c='message')} AS m FROM messages)
    SELECT query_id, trim(coalesce(nullif(regexp_extract(m, '(?i)(?:mirip|seperti|like)\\s+(.+)$', 1), ''),
      nullif(regexp_extract(m, '(?i)(?:recommend|rekomendasi)\\s+(.+)$', 1), ''), m), ' .?!') AS title FROM said""",
)
def r1(spark, sf):
    return messages(spark, sf).select("query_id", it.extract_title("message").alias("title"))


@query(
    "r1_title_of_conversation_text",
    f"""WITH said AS (SELECT conv_id, turn, {_SPACES.format(c='text')} AS m FROM conversations)
    SELECT conv_id, turn, trim(coalesce(nullif(regexp_extract(m, '(?i)(?:mirip|seperti|like)\\s+(.+)$', 1), ''),
      nullif(regexp_extract(m, '(?i)(?:recommend|rekomendasi)\\s+(.+)$', 1), ''), m), ' .?!') AS title FROM said""",
)
def r1_conversations(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", it.extract_title("text").alias("title"))


def _mentioned_sql(words, message="m"):
    hits = ", ".join(f"CASE WHEN regexp_matches({message}, '\\b{w}\\b') THEN '{v}' END" for w, v in words.items())
    return f"array_to_string(list_sort(list_distinct([{hits}])), ',')"


def _captured_sql(pattern, kind, message="m"):
    return f"TRY_CAST(replace(regexp_extract({message}, '{pattern}', 1), ',', '.') AS {kind})"


_INTENT_SQL = f"""
said AS (SELECT query_id, message, lower({_SPACES.format(c='message')}) AS m FROM messages),
intents AS (SELECT query_id, {_mentioned_sql(it.GENRE_WORDS)} AS genres, {_mentioned_sql(it.LANGUAGE_CODES)} AS languages,
  {_captured_sql(it.MIN_RATING_PATTERN, 'DOUBLE')} AS min_rating, {_captured_sql(it.YEAR_FROM_PATTERN, 'INTEGER')} AS year_from,
  {_captured_sql(it.YEAR_TO_PATTERN, 'INTEGER')} AS year_to, {_captured_sql(it.MIN_RUNTIME_PATTERN, 'INTEGER')} AS min_runtime,
  {_captured_sql(it.MAX_RUNTIME_PATTERN, 'INTEGER')} AS max_runtime FROM said)
"""
_NO_FILTER = "genres = '' AND languages = '' AND coalesce(min_rating, year_from, year_to, min_runtime, max_runtime) IS NULL"


def _intent_columns():
    i = F.col("intent")
    return [
        F.array_join(i["preferred_genres"], ",").alias("genres"),
        F.array_join(i["original_languages"], ",").alias("languages"),
        i["min_rating"].alias("min_rating"), i["release_year_from"].alias("year_from"),
        i["release_year_to"].alias("year_to"), i["min_runtime"].alias("min_runtime"),
        i["max_runtime"].alias("max_runtime"),
    ]


@query(
    "r2_parsed_intents",
    f"""WITH {MESSAGES_SQL.strip()}, {_INTENT_SQL.strip()}
    SELECT query_id, {_NO_FILTER} AS no_filter, CASE WHEN NOT ({_NO_FILTER}) THEN genres END AS genres,
      CASE WHEN NOT ({_NO_FILTER}) THEN languages END AS languages, min_rating, year_from, year_to, min_runtime, max_runtime FROM intents""",
)
def r2(spark, sf):
    parsed = it.with_intent(messages(spark, sf))
    return parsed.select("query_id", F.col("intent").isNull().alias("no_filter"), *_intent_columns())


@query(
    "r3_cleaned_keywords",
    """SELECT query_id, array_to_string(list_filter(words, lambda w: NOT contains(lower(trim(w)), name)
      AND NOT contains(lower(trim(w)), 'mirip dengan')), ';') AS keywords
    FROM (SELECT min(p_partkey) AS query_id, min(p_name) AS name,
      ['Similar ' || upper(min(p_name)), 'mirip dengan ' || p_type, p_brand, ' ' || p_type] AS words FROM part GROUP BY p_brand, p_type)""",
)
def r3(spark, sf):
    asked = _grouped_parts(spark, sf)
    words = F.array(
        F.concat(F.lit("Similar "), F.upper("name")), F.concat(F.lit("mirip dengan "), "p_type"),
        F.col("p_brand"), F.concat(F.lit(" "), "p_type"),
    )
    intent = it.intent_of(reference_title=F.col("name"), keywords=words)
    return asked.select("query_id", F.array_join(it.cleaned_keywords(intent), ";").alias("keywords"))


def chat_requests(spark, sf):
    """One free-text request per brand and type, of every kind the router knows."""
    grouped = _grouped_parts(spark, sf)
    say = F.concat_ws
    return grouped.select(
        "query_id",
        F.when(F.col("p_type") == "SMALL", say(" ", F.lit("Film"), F.lit("english sampai"), (F.col("lo") + 1990).cast("string")))
        .when(F.col("p_type") == "LARGE", say(" ", F.lit("Rekomendasi seperti"), "name"))
        .when(F.col("p_type") == "PROMO", say(" ", F.lit("drama maksimal"), (F.col("hi") * 2).cast("string"), F.lit("menit")))
        .when(F.col("p_type") == "MEDIUM", say(" ", "name", F.col("query_id").cast("string")))
        .otherwise(say(" ", F.lit("film horor seperti"), "name", F.col("query_id").cast("string")))
        .alias("message"),
        # 0 to 23: some ask for nothing or for more than the service gives
        F.pmod("query_id", F.lit(24)).cast("int").alias("top_k"),
    )


@query("r4_answered_requests")
def r4(spark, sf):
    """The whole router; its parts have SQL twins, the routing is tested on fixtures."""
    answers = rq.answer(chat_requests(spark, sf), movies(spark, sf), vectors(spark, sf))
    return answers.select(
        "query_id", "mode", "status", "answer", "source_id", F.array_join("candidates", ",").alias("candidates"),
        F.array_join(F.transform("recommendations", lambda r: r["id"].cast("string")), ",").alias("recommended"),
    )


@query(
    "r4_routes",
    f"""WITH {MESSAGES_SQL.strip()}, {_INTENT_SQL.strip()}
    SELECT query_id, CASE WHEN {_NO_FILTER} THEN 'similarity' ELSE 'discovery' END AS mode FROM intents""",
)
def r4_routes(spark, sf):
    return rq.routed(messages(spark, sf)).select("query_id", "mode")


@query(
    "r5_analysis_records",
    f"""WITH {MESSAGES_SQL.strip()}, {_INTENT_SQL.strip()}
    SELECT query_id, message AS original_query, CASE WHEN {_NO_FILTER}
        THEN 'resolve_title -> cosine_search -> hybrid_rerank -> intent_filters -> top_k'
        ELSE 'metadata_discovery(filters) -> discovery_ranking -> top_k' END AS backend_query,
      CASE WHEN {_NO_FILTER} THEN 'similarity' ELSE 'discovery' END AS execution_mode, CAST(query_id % 20 + 1 AS INTEGER) AS top_k,
      CASE WHEN {_NO_FILTER} THEN greatest(50, CAST(10 * (query_id % 20 + 1) AS INTEGER)) END AS candidate_pool_target,
      CASE WHEN {_NO_FILTER} THEN '{rq.SIMILARITY_RANKING}' ELSE '{rq.DISCOVERY_RANKING}' END AS ranking
    FROM intents JOIN messages USING (query_id)""",
)
def r5(spark, sf):
    asked = rq.routed(messages(spark, sf).withColumn("top_k", (F.pmod("query_id", F.lit(20)) + 1).cast("int")))
    record = asked.select("query_id", rq.analysis(F.col("top_k")).alias("a"))
    return record.select(
        "query_id", "a.original_query", "a.backend_query", "a.execution_mode", "a.top_k", "a.candidate_pool_target", "a.ranking"
    )


@query(
    "b27_genre_names",
    """SELECT p_partkey AS id, coalesce(g.name, p_size::VARCHAR) || ', ' || coalesce(h.name, length(p_type)::VARCHAR) AS genres
    FROM part LEFT JOIN (VALUES (5, 'Comedy'), (6, 'Drama'), (18, 'Horror')) g(id, name) ON g.id = p_size
    LEFT JOIN (VALUES (5, 'Comedy'), (6, 'Drama'), (18, 'Horror')) h(id, name) ON h.id = length(p_type)""",
)
def b27(spark, sf):
    ids = F.array(F.col("p_size").cast("bigint"), F.length("p_type").cast("bigint"))
    names = {5: "Comedy", 6: "Drama", 18: "Horror"}
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), genre_names(ids, names).alias("genres"))


@query(
    "b29_language_codes",
    """SELECT o_orderkey AS id, CASE word WHEN 'korean' THEN 'ko' WHEN 'bahasa jepang' THEN 'ja' WHEN 'mandarin' THEN 'zh' ELSE word END AS code
    FROM (SELECT o_orderkey, (['korean', 'bahasa jepang', 'de', 'mandarin', 'klingon'])[substr(o_orderpriority, 1, 1)::INT] AS word FROM orders)""",
)
def b29(spark, sf):
    words = F.array(*(F.lit(w) for w in ("Korean", " bahasa  Jepang", "de", "MANDARIN", "klingon")))
    word = F.element_at(words, F.substring("o_orderpriority", 1, 1).cast("int"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), it.language_code(word).alias("code"))


_QUESTION_SQL = """
asked AS (SELECT *, (['Apa ceritanya?', 'Siapa pemainnya?', 'Siapa SUTRADARA film ini?', 'Jenis film apa?',
  'Berapa nilai?', 'Berapa lama?', 'Halo'])[length(title) % 7 + 1] AS question FROM final)
"""


@query(
    "b33_metadata_answers",
    prepared_sql(
        """SELECT id, CASE length(title) % 7
          WHEN 0 THEN coalesce(nullif(overview_clean, ''), 'Sinopsis ' || title || ' belum tersedia pada metadata kami.')
          WHEN 1 THEN CASE WHEN top_cast_text <> '' THEN 'Pemeran yang tercatat untuk ' || title || ': ' || top_cast_text || '.' ELSE 'Data pemeran belum tersedia.' END
          WHEN 2 THEN CASE WHEN director_clean <> '' THEN title || ' disutradarai oleh ' || director_clean || '.' ELSE 'Data sutradara belum tersedia.' END
          WHEN 3 THEN 'Genre ' || title || ': ' || genres_text || '.'
          WHEN 4 THEN 'Rating ' || title || ' adalah ' || printf('%.1f', round(vote_average, 3)) || '/10.'
          WHEN 5 THEN CASE WHEN runtime <> 0 THEN 'Durasi ' || title || ' adalah ' || runtime::INT || ' menit.' ELSE 'Data durasi belum tersedia.' END
          ELSE 'Saya bisa membahas sinopsis, genre, sutradara, pemeran, rating, atau durasi ' || title
            || '. OpenAI belum aktif, jadi pertanyaan lanjutan saat ini dijawab dari metadata terstruktur.' END AS answer FROM asked""",
        _QUESTION_SQL,
    ),
)
def b33(spark, sf):
    shown = movies(spark, sf)
    questions = F.array(
        *(
            F.lit(q)
            for q in (
                "Apa ceritanya?", "Siapa pemainnya?", "Siapa SUTRADARA film ini?", "Jenis film apa?",
                "Berapa nilai?", "Berapa lama?", "Halo",
            )
        )
    )
    question = F.element_at(questions, F.length("title") % 7 + 1)
    movie = {
        "title": F.col("title"), "overview": F.col("overview_clean"), "cast": F.col("top_cast_text"),
        "director": F.col("director_clean"), "genres": F.col("genres_text"),
        "vote_average": F.round("vote_average", 3), "runtime": F.col("runtime"),
    }
    return shown.select("id", it.metadata_answer(question, movie).alias("answer"))


@query(
    "b34_detected_entries",
    f"""WITH {MESSAGES_SQL.strip()}, {_INTENT_SQL.strip()}
    SELECT query_id, label, value FROM (
      SELECT query_id, 'Genre' AS label, nullif(replace(genres, ',', ', '), '') AS value FROM intents
      UNION ALL SELECT query_id, 'Bahasa', nullif(replace(languages, ',', ', '), '') FROM intents
      UNION ALL SELECT query_id, 'Rating minimum', min_rating::VARCHAR FROM intents
      UNION ALL SELECT query_id, 'Tahun mulai', year_from::VARCHAR FROM intents
      UNION ALL SELECT query_id, 'Tahun akhir', year_to::VARCHAR FROM intents
      UNION ALL SELECT query_id, 'Durasi minimum', min_runtime::VARCHAR FROM intents
      UNION ALL SELECT query_id, 'Durasi maksimum', max_runtime::VARCHAR FROM intents) WHERE value IS NOT NULL""",
)
def b34_entries(spark, sf):
    return it.detected_entries(it.with_intent(messages(spark, sf)))


@query(
    "p6_post_filter",
    prepared_sql("""SELECT id FROM final WHERE (contains(genres_text, 'small') OR contains(genres_text, 'large'))
      AND contains(concat_ws(' ', nullif(keywords_text, ''), nullif(overview_clean, ''), nullif(genres_text, '')), 'ring')
      AND vote_average >= 4 AND coalesce(release_year <= 2015, FALSE) AND coalesce(runtime >= 20, FALSE)"""),
)
def p6(spark, sf):
    intent = it.intent_of(
        preferred_genres=F.array(F.lit("Small "), F.lit("LARGE")), keywords=F.array(F.lit(" Ring")),
        min_rating=F.lit(4.0), release_year_to=F.lit(2015), min_runtime=F.lit(20),
    )
    movie = {n: F.col(c) for n, c in rq._SUMMARY.items()}
    return movies(spark, sf).filter(it.passes_filters(intent, movie)).select("id")


@query(
    "p7_contains_any",
    """SELECT doc_id, regexp_matches(lower(text), 'the|ing') AS hit, TRUE AS open FROM documents""",
)
def p7(spark, sf):
    terms = F.array(F.lit("The"), F.lit("  "), F.lit("ing "))
    return table(spark, sf, "documents").select(
        "doc_id", contains_any(F.col("text"), terms).alias("hit"),
        contains_any(F.col("text"), F.array(F.lit(" "))).alias("open"),
    )


@query(
    "p8_has_filters",
    """SELECT o_orderkey AS id, o_orderstatus = 'F' OR o_totalprice > 200000 AS has_filter FROM orders""",
)
def p8(spark, sf):
    blank = F.array(F.lit("  "))
    intent = it.intent_of(
        actors=F.when(F.col("o_orderstatus") == "F", F.array("o_orderpriority")).otherwise(blank),
        max_runtime=F.when(F.col("o_totalprice") > 200000, F.lit(90)),
    )
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), it.has_filters(intent).alias("has_filter"))


# -- conversations -----------------------------------------------------------------------------------

_CHAT_SQL = """
users AS (SELECT c_custkey AS id, c_nationkey::BIGINT AS user_id FROM customer),
threads AS (SELECT conv_id AS id, any_value(u.user_id) AS user_id,
    CASE WHEN conv_id > 0 THEN conv_id // 2 END AS parent_thread_id,
    CASE WHEN max(turn) > 2 THEN 'movie' ELSE 'recommendation' END AS context_type,
    'Conversation ' || conv_id AS title,
    TIMESTAMP '2024-01-01' + to_hours(conv_id::INT) AS created_at,
    TIMESTAMP '2024-01-01' + to_hours(conv_id::INT) + to_minutes(max(turn)) AS updated_at
  FROM conversations LEFT JOIN users u ON u.id = conv_id GROUP BY conv_id),
messages AS (SELECT conv_id * 1000 + turn AS id, conv_id AS thread_id, user_id,
    CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent_message_id, role, text AS content,
    TIMESTAMP '2024-01-01' + to_hours(conv_id::INT) + to_minutes(turn) AS created_at
  FROM conversations LEFT JOIN (SELECT id - 1 AS id, user_id FROM users) u ON u.id = conv_id)
"""


def _at(hours, minutes):
    return F.timestamp_seconds(F.lit(1704067200) + hours * 3600 + minutes * 60)


def _users(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("bigint").alias("user_id")
    )


def threads_and_messages(spark, sf):
    """Threads and messages of the conversations; a thread's user is its customer's nation."""
    said = table(spark, sf, "conversations")
    last = said.groupBy(F.col("conv_id").alias("id")).agg(F.max("turn").alias("last"))
    threads = last.join(_users(spark, sf), "id", "left").select(
        "id",
        "user_id",
        F.when(F.col("id") > 0, F.floor(F.col("id") / 2)).alias("parent_thread_id"),
        F.when(F.col("last") > 2, "movie").otherwise("recommendation").alias("context_type"),
        F.concat_ws(" ", F.lit("Conversation"), F.col("id").cast("string")).alias("title"),
        _at(F.col("id"), F.lit(0)).alias("created_at"),
        _at(F.col("id"), F.col("last")).alias("updated_at"),
    )
    shifted = _users(spark, sf).select((F.col("id") - 1).alias("conv_id"), "user_id")
    key = F.col("conv_id") * 1000 + F.col("turn")
    sent = said.join(shifted, "conv_id", "left").select(
        key.alias("id"),
        F.col("conv_id").alias("thread_id"),
        "user_id",
        F.when(F.col("turn") > 0, key - 1).alias("parent_message_id"),
        "role",
        F.col("text").alias("content"),
        _at(F.col("conv_id"), F.col("turn")).alias("created_at"),
    )
    return threads, sent


def chat_sql(select, *parts):
    return sql(_CHAT_SQL, *parts, select=select)


@query("p12_owned_threads", chat_sql("SELECT id, user_id, title FROM threads WHERE user_id = 7"))
def p12(spark, sf):
    return cv.owned(threads_and_messages(spark, sf)[0], 7).select("id", "user_id", "title")


@query(
    "p12_insertable_messages",
    chat_sql("SELECT m.id, m.user_id FROM messages m JOIN threads t ON t.id = m.thread_id AND t.user_id = m.user_id"),
)
def p12_insert(spark, sf):
    threads, sent = threads_and_messages(spark, sf)
    return cv.insertable(sent, threads).select("id", "user_id")


@query(
    "p13_checked_messages",
    chat_sql("""SELECT id, array_to_string([x FOR x IN [CASE WHEN user_id IS NULL THEN 'user_missing' END,
        CASE WHEN parent_message_id IS NOT NULL AND parent_message_id NOT IN (SELECT id FROM messages) THEN 'parent_unknown' END,
        CASE WHEN role NOT IN ('user', 'assistant') THEN 'role_invalid' END,
        CASE WHEN length(content) NOT BETWEEN 1 AND 4000 THEN 'content_length' END] IF x IS NOT NULL], ',') AS violations FROM messages"""),
)
def p13(spark, sf):
    threads, sent = threads_and_messages(spark, sf)
    checked = cv.check_messages(sent, threads)
    split = cv.valid(checked).withColumn("violations", F.array().cast("array<string>")).unionByName(cv.quarantined(checked))
    return split.select("id", F.array_join("violations", ",").alias("violations"))


@query(
    "p13_checked_threads",
    chat_sql("""SELECT id, array_to_string([x FOR x IN [CASE WHEN user_id IS NULL THEN 'user_missing' END,
        CASE WHEN parent_thread_id IS NOT NULL AND parent_thread_id NOT IN (SELECT id FROM threads) THEN 'parent_unknown' END]
        IF x IS NOT NULL], ',') AS violations FROM threads"""),
)
def p13_threads(spark, sf):
    checked = cv.check_threads(threads_and_messages(spark, sf)[0])
    return checked.select("id", F.array_join("violations", ",").alias("violations"))


@query(
    "w7_recent_history",
    chat_sql("""SELECT thread_id, string_agg(role || ':' || md5(content), ';' ORDER BY place) AS input FROM (
      SELECT thread_id, -row_number() OVER (PARTITION BY thread_id ORDER BY created_at DESC, id DESC) AS place, role, content FROM messages
      UNION ALL SELECT id, 0, 'user', title FROM threads) WHERE place >= -12 GROUP BY 1"""),
)
def w7(spark, sf):
    threads, sent = threads_and_messages(spark, sf)
    new = threads.select(F.col("id").alias("thread_id"), F.col("title").alias("content"))
    shown = F.transform("input", lambda m: F.concat_ws(":", m["role"], F.md5(m["content"])))
    return cv.recent_history(sent, new).select("thread_id", F.array_join(shown, ";").alias("input"))


def _replicas(spark, sf):
    """A local copy that is newer for some threads, equal for others."""
    threads = threads_and_messages(spark, sf)[0]
    movie = F.col("context_type") == "movie"
    local = threads.withColumns(
        {
            "title": F.concat(F.lit("local "), "title"),
            "updated_at": F.when(movie, F.col("updated_at") + F.expr("interval 1 hour")).otherwise(F.col("updated_at")),
        }
    )
    return threads, local


_MERGED_SQL = """
local AS (SELECT id, 'local ' || title AS title, context_type,
  CASE WHEN context_type = 'movie' THEN updated_at + INTERVAL 1 HOUR ELSE updated_at END AS updated_at FROM threads)
"""


@query(
    "w8_last_writer_wins",
    chat_sql(
        "SELECT t.id, CASE WHEN l.updated_at > t.updated_at THEN l.title ELSE t.title END AS title, greatest(l.updated_at, t.updated_at) AS updated_at FROM threads t JOIN local l USING (id)",
        _MERGED_SQL,
    ),
)
def w8(spark, sf):
    remote, local = _replicas(spark, sf)
    return last_writer_wins(local, remote).select("id", "title", "updated_at")


@query(
    "c1_upserted_messages",
    chat_sql("""SELECT id, role, CASE WHEN role = 'assistant' THEN 'edited ' || content ELSE content END AS content FROM messages
      UNION ALL SELECT -1 - id, 'user', title FROM threads"""),
)
def c1(spark, sf):
    threads, sent = threads_and_messages(spark, sf)
    stored = sent.select("id", "role", "content")
    changed = stored.filter("role = 'assistant'").withColumn("content", F.concat(F.lit("edited "), "content"))
    added = threads.select((-1 - F.col("id")).alias("id"), F.lit("user").alias("role"), F.col("title").alias("content"))
    return upserted(stored, changed.unionByName(added))


@query(
    "c2_movie_threads",
    chat_sql("SELECT id, title, updated_at FROM threads WHERE user_id = 7 AND context_type = 'movie'"),
)
def c2(spark, sf):
    return cv.movie_threads(threads_and_messages(spark, sf)[0], 7).select("id", "title", "updated_at")


_REMOVED_SQL = """
asked AS (SELECT DISTINCT thread_id AS id FROM messages WHERE role = 'system'),
gone AS (SELECT id FROM asked UNION SELECT t.id FROM gone g JOIN threads t ON t.parent_thread_id = g.id AND t.id <> g.id),
kept_messages AS (SELECT * FROM messages WHERE thread_id NOT IN (SELECT id FROM gone))
"""


def _removed(spark, sf):
    threads, sent = threads_and_messages(spark, sf)
    asked = sent.filter("role = 'system'").select(F.col("thread_id").alias("id"))
    return cv.delete_threads(threads, sent, asked)


@query("c3_threads_after_delete", chat_sql("SELECT id, title FROM threads WHERE id NOT IN (SELECT id FROM gone)", _REMOVED_SQL).replace("WITH ", "WITH RECURSIVE ", 1))
def c3(spark, sf):
    return _removed(spark, sf)[0].select("id", "title")


@query(
    "c3_messages_after_delete",
    chat_sql(
        """SELECT id, thread_id, CASE WHEN parent_message_id IN (SELECT id FROM kept_messages) THEN parent_message_id END AS parent_message_id
        FROM kept_messages""",
        _REMOVED_SQL,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def c3_messages(spark, sf):
    return _removed(spark, sf)[1].select("id", "thread_id", "parent_message_id")


_NESTED_SQL = """SELECT t.id, t.title, count(m.id) AS messages, coalesce(string_agg(m.role || ':' || md5(m.content), ';' ORDER BY m.created_at, m.id), '') AS content
  FROM threads t LEFT JOIN messages m ON m.thread_id = t.id {where} GROUP BY 1, 2"""


def _flattened(nested):
    shown = F.transform("messages", lambda m: F.concat_ws(":", m["role"], F.md5(m["content"])))
    return nested.select(
        "id", "title", F.size("messages").cast("bigint").alias("messages"), F.array_join(shown, ";").alias("content")
    )


@query("j13_threads_with_messages", chat_sql(_NESTED_SQL.format(where="")))
def j13(spark, sf):
    return _flattened(cv.nested_threads(*threads_and_messages(spark, sf)))


@query("c4_nested_movie_threads", chat_sql(_NESTED_SQL.format(where="WHERE t.user_id = 7 AND t.context_type = 'movie'")))
def c4(spark, sf):
    threads, sent = threads_and_messages(spark, sf)
    return _flattened(cv.nested_threads(cv.movie_threads(threads, 7), sent))


@query(
    "c5_merged_and_written_back",
    chat_sql(
        """SELECT t.id, CASE WHEN l.updated_at > t.updated_at THEN l.title ELSE t.title END AS title FROM threads t JOIN local l USING (id)
        UNION ALL SELECT id, text FROM (SELECT -1 - item_id AS id, text FROM benchmark)""",
        _MERGED_SQL,
    ),
)
def c5(spark, sf):
    remote, local = _replicas(spark, sf)
    columns = ["id", "title", "updated_at"]
    old = table(spark, sf, "benchmark").select(
        (-1 - F.col("item_id")).alias("id"), F.col("text").alias("title"), F.lit(None).cast("timestamp").alias("updated_at")
    )
    stored = remote.select(*columns).unionByName(old)
    return cv.written_back(stored, local.select(*columns), remote.select(*columns)).select("id", "title")


# -- joins and sets ----------------------------------------------------------------------------------


@query(
    "j1_vectors_with_payload",
    "SELECT vec_id AS id, p_name AS title, label FROM embeddings JOIN part ON p_partkey = vec_id",
)
def j1(spark, sf):
    payload = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return vectors(spark, sf).join(payload, "id").select("id", "title", F.col("cluster_id").alias("label"))


@query(
    "j3_items_with_decade",
    sql(
        "genres AS (SELECT p_partkey AS id, unnest([p_type, split_part(p_name, ' ', 1)]) AS genre FROM part)",
        "decades AS (SELECT l_partkey AS id, min(year(l_shipdate)) // 10 * 10 AS decade FROM lineitem GROUP BY 1)",
        select="SELECT decade::INT AS decade, genre, count(DISTINCT id) AS movie_count FROM genres JOIN decades USING (id) GROUP BY 1, 2",
    ),
)
def j3(spark, sf):
    """The decade is carried through the explode, so the exploded side is not joined."""
    from marquee.operators.features import decade_of
    from marquee.operators.profile import decade_by_item

    decades = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(
        decade_of(F.year(F.min("l_shipdate"))).alias("release_decade")
    )
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.concat_ws("|", "p_type", F.split("p_name", " ")[0]).alias("genres")
    )
    found = decade_by_item(part.join(decades, "id"), "genres", "genre")
    return found.withColumnRenamed("release_decade", "decade")


@query(
    "u2_union_distinct",
    """SELECT l_partkey AS id FROM lineitem UNION SELECT vec_id FROM embeddings UNION SELECT doc_id FROM documents""",
)
def u2(spark, sf):
    sides = [("lineitem", "l_partkey"), ("embeddings", "vec_id"), ("documents", "doc_id")]
    frames = [table(spark, sf, t).select(F.col(c).alias("id")) for t, c in sides]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).dropDuplicates(["id"])


@query(
    "u3_id_difference",
    "SELECT doc_id AS id FROM documents EXCEPT SELECT doc_id FROM labels",
)
def u3(spark, sf):
    from marquee.sources.payloads import remaining_ids

    documents = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return remaining_ids(documents, table(spark, sf, "labels").select(F.col("doc_id").alias("id")))


@query(
    "u4_array_sets",
    """SELECT id, array_to_string(list_sort(list_intersect(a, b)), ' ') AS both,
      array_to_string(list_sort(list_distinct(list_concat(a, b))), ' ') AS either,
      array_to_string(list_sort(list_distinct(a)), ' ') AS own
    FROM (SELECT p_partkey AS id, string_split(lower(p_name || ' ' || p_type), ' ') AS a,
      string_split(lower(p_type || ' ' || p_type || ' ring'), ' ') AS b FROM part)""",
)
def u4(spark, sf):
    a = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")
    b = F.split(F.lower(F.concat_ws(" ", "p_type", "p_type", F.lit("ring"))), " ")
    joined = {
        "both": F.array_intersect(a, b), "either": F.array_union(a, b), "own": F.array_distinct(a),
    }
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), *(F.array_join(F.array_sort(v), " ").alias(n) for n, v in joined.items())
    )


@query(
    "t7_ordered_output",
    "SELECT doc_id AS id, n_chars FROM documents ORDER BY n_chars DESC, doc_id",
)
def t7(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars").orderBy(
        F.desc("n_chars"), "id"
    )
