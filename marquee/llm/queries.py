"""Registered queries of the training-data operators, beside their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from marquee.llm import (
    adaptive_scan, bpe, chat_format, conversation_repair, cotraining, decontaminate, hilbert, jaccard_join, line_dedup, quality_rules, resampling,
    secret_scan, suffix_dedup,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Where the byte-level vocabulary lies: a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, sf_dir, "documents"))
    return judged.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"), length=200).withColumnRenamed("id", "doc_id")


@query(
    "op5_decontamination",
    rf"""
    WITH doc AS (
        SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
    ), item AS (
        SELECT item_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark
    ), sized AS (SELECT item_id, w, least(len(w), 10) AS k FROM item WHERE len(w) > 0
    ), win AS (
        SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS words
        FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)
    ), place AS (
        SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS words
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM doc, (SELECT DISTINCT k FROM sized) WHERE len(w) >= k)
    ), found AS (SELECT doc_id, p, place.k AS k, item_id FROM place JOIN win USING (words, k)
    ), hit AS (
        SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS word FROM (SELECT DISTINCT doc_id, p, k FROM found)) GROUP BY doc_id
    ), items AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(all_items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("key").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op8_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = bpe.token_digests(table(spark, sf_dir, "documents"), tokenizer_path(), F.col("doc_id"), F.col("text"))
    return digests.withColumnRenamed("key", "doc_id")


@query(
    "op9_line_dedup",
    rf"""
    WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
    ), line AS (SELECT doc_id, i, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM split)
    ), keyed AS (
        SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') AS key FROM line
    ), gone AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone.key IS NOT NULL) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (gone.key IS NULL), '')) AS kept_sha256
    FROM keyed LEFT JOIN gone USING (key) GROUP BY doc_id
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.without_frequent_lines(documents, min_chars=1, min_documents=10)
    return kept.select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256")
    )


@query(
    "op10_jaccard_join",
    rf"""
    WITH RECURSIVE doc AS (
        SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
    ), shingle AS (
        SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM doc WHERE len(w) > 0)
    ), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
    ), common AS (
        SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
    ), link AS (
        SELECT u, v FROM common JOIN size p ON p.doc_id = u JOIN size q ON q.doc_id = v WHERE 100 * c >= 90 * (p.n + q.n - c)
    ), reach AS (
        SELECT u, u AS v FROM (SELECT DISTINCT u FROM link) UNION SELECT reach.u, link.v FROM reach JOIN link ON link.u = reach.v
    ), least AS (SELECT u, min(v) AS component FROM reach GROUP BY u)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, doc_id) AS component_id
    FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN least ON least.u = doc_id
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.set_components(table(spark, sf_dir, "documents"), words=3, percent=90)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


@query(
    "op4_chat_format",
    """
    WITH chat AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))
    ), piece AS (
        SELECT *, '<|im_start|>' || regexp_replace(role, '<([|]+)', '<|\1', 'g') || chr(10) || regexp_replace(text, '<([|]+)', '<|\1', 'g') || '<|im_end|>' || chr(10) AS piece FROM chat
    ), placed AS (
        SELECT *, row_number() OVER w - 1 AS number, sum(ceil(strlen(piece) / 4)) OVER w - ceil(strlen(piece) / 4) AS start
        FROM piece WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
    ), cut AS (SELECT *, floor(start / 512) AS win FROM placed
    ), win AS (SELECT conv_id, win, min(number) AS first, min(start) AS start FROM cut GROUP BY ALL HAVING min(number) > 0
    ), again AS (
        SELECT w.conv_id, sum(length(c.piece)) AS chars FROM win w JOIN cut c ON c.conv_id = w.conv_id
        WHERE (c.number = 0 AND c.role = 'system')
           OR (c.number < w.first AND c.number >= w.first - 3 AND w.start - c.start <= 256 AND NOT (c.number = 0 AND c.role = 'system'))
        GROUP BY ALL
    ), whole AS (
        SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY number) AS turns,
               coalesce(string_agg(text, '' ORDER BY number) FILTER (role = 'assistant'), '') AS targets, sum(length(piece)) AS chars
        FROM placed GROUP BY conv_id
    )
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(targets) AS BIGINT) AS loss_chars, sha256(targets) AS loss_sha256,
           CAST(whole.chars + coalesce(again.chars, 0) AS BIGINT) AS formatted_chars
    FROM whole LEFT JOIN again USING (conv_id)
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "'<|im_end|><|im_start|>assistant ok'"
    added = spark.range(2).selectExpr("-1L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", f"{control} AS text")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    read = chat_format.read_back(chat_format.windows(conversations.unionByName(added)))
    return read.select(
        F.col("conv").alias("conv_id"), "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("targets").cast("bigint").alias("loss_chars"),
        F.sha2("targets", 256).alias("loss_sha256"), F.col("formatted_chars").cast("bigint").alias("formatted_chars"),
    )


@query("op7_hilbert_shards")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = hilbert.sharded(table(spark, sf_dir, "documents"), "doc_id", "text", ["source", "lang", "n_chars"], shards=8)
    return shards.select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert",
    )


@query("op3_secret_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scanned(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("at").alias("word"), "length", F.sha2("candidate", 256).alias("candidate_sha256"), F.round("probability", 6).alias("probability"), "is_secret",
    )


@query("op6_cotraining")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cotraining.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), *(F.round(c, 6).alias(c) for c in ("text_score", "meta_score", "score")), "kept")


#: CRC-32 of a text in SQL: a table made from the polynomial, and a fold over the bytes.
_CRC_TABLE = """(SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) AS r(i)))"""


def _crc_sql(text: str) -> str:
    """The checksum of a non-empty text; ``tab`` is in scope."""
    return f"""xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, strlen({text}) + 1),
      lambda i: ('0x' || substr(hex({text}), 2 * i - 1, 2))::BIGINT)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)))"""


@query(
    "op13_importance_resampling",
    rf"""
    WITH crc AS {_CRC_TABLE}, read AS (
        SELECT 'raw' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'target', item_id, text FROM benchmark
    ), words AS (
        SELECT kind, id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM read
    ), feature AS (
        SELECT kind, id, unnest(w) AS f FROM words UNION ALL
        SELECT kind, id, w[i] || ' ' || w[i + 1] FROM (SELECT kind, id, w, unnest(range(1, len(w))) AS i FROM words)
    ), hashed AS (SELECT f, {_crc_sql("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM feature), crc
    ), placed AS (SELECT kind, id, bucket FROM feature JOIN hashed USING (f)
    ), counted AS (
        SELECT bucket, count(*) FILTER (kind = 'raw') AS s, count(*) FILTER (kind = 'target') AS t FROM placed GROUP BY bucket
    ), total AS (SELECT coalesce(sum(s), 0)::DOUBLE AS S_all, coalesce(sum(t), 0)::DOUBLE AS T_all FROM counted
    ), gain AS (
        SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (S_all + 10000)) / ((s + 1)::DOUBLE * (T_all + 10000))))::BIGINT AS gain FROM counted, total
    ), weight AS (
        SELECT id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM placed JOIN gain USING (bucket) WHERE kind = 'raw' GROUP BY id
    ), scored AS (
        SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
               coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
        FROM words LEFT JOIN weight USING (id) WHERE kind = 'raw'
    ), placed_able AS (
        SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20
    )
    SELECT scored.doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank
    FROM scored LEFT JOIN placed_able USING (doc_id)
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    rows = resampling.scored(documents, benchmark, F.col("doc_id"), F.col("text"), F.col("text"))
    return resampling.ranked(rows).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def _path_sql(state: str, cost: str, edit: str) -> str:
    """A path as its cost in six digits and its edits, so that the least text is the cheapest and first path; NULL is no path."""
    return f"lpad((left({state}, 6)::BIGINT + {cost})::VARCHAR, 6, '0') || substr({state}, 7) || '{edit}'"


def _paths_sql(states: str, to: str) -> str:
    """Ways of keeping or re-roling row ``p`` into turn ``to`` from any of the states."""
    keep = [f"CASE WHEN NOT gone AND initial = '{to}' THEN {_path_sql(x, 'extra', 'K')} END" for x in states]
    role = [f"CASE WHEN NOT gone THEN {_path_sql(x, '2 + extra', 'R')} END" for x in states]
    return ", ".join(keep + role)


@query(
    "op12_conversation_repair",
    rf"""
    WITH RECURSIVE crc AS {_CRC_TABLE}, named AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
        FROM conversations
    ), chat AS (SELECT conv_id, turn, role, text, {_crc_sql("name")} % 20 AS fault FROM named, crc
    ), damaged AS (
        SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
               CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM chat, range(2) AS copies(copy) WHERE fault <> 0 AND (copy = 0 OR fault = 3)
    ), ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
    ), placed AS (
        SELECT *, left(role, 1) AS initial, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS solid,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS repeated
        FROM ordered
    ), faults AS (
        SELECT *, solid = '' AS blank, solid <> '' AND repeated AS duplicate,
               solid <> '' AND NOT repeated AND right(solid, 1) NOT IN ('.', '!', '?') AS truncated,
               lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal
        FROM placed
    ), p AS (SELECT *, blank OR duplicate AS gone, truncated::BIGINT AS extra FROM faults
    ), steps AS (
        SELECT DISTINCT conv_id, 0::BIGINT AS i, '000000' AS z, NULL::VARCHAR AS s, '000002I' AS u, '000004II' AS a FROM conversations
        UNION ALL
        SELECT conv_id, i, z, s, u, least(a, {_path_sql("u", "2", "I")}) FROM (
            SELECT conv_id, i, z, s, least(u, {_path_sql("z", "2", "I")}, {_path_sql("s", "2", "I")}, {_path_sql("a", "2", "I")}) AS u, a FROM (
                SELECT p.conv_id, p.i, {_path_sql("z", "3", "D")} AS z,
                       least({_path_sql("s", "3", "D")}, CASE WHEN NOT gone AND initial = 's' THEN {_path_sql("z", "extra", "K")} END) AS s,
                       least({_path_sql("u", "3", "D")}, {_paths_sql("zsa", "u")}) AS u, least({_path_sql("a", "3", "D")}, {_paths_sql("u", "a")}) AS a
                FROM steps JOIN p ON p.conv_id = steps.conv_id AND p.i = steps.i + 1))
    ), best AS (
        SELECT conv_id, left(path, 6)::BIGINT AS cost, substr(path, 7) AS audit
        FROM (SELECT conv_id, arg_max(least(z, a), i) AS path FROM steps GROUP BY conv_id)
    ), edit AS (
        SELECT conv_id, k, e, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS i
        FROM (SELECT conv_id, k, substr(audit, k, 1) AS e FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM best))
    ), written AS (
        SELECT edit.conv_id, e, role, CASE WHEN e = 'I' THEN '' ELSE text END AS text, row_number() OVER w AS j,
               max(CASE WHEN e = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY edit.conv_id) AS led
        FROM edit LEFT JOIN p ON p.conv_id = edit.conv_id AND p.i = edit.i AND e <> 'I' WHERE e <> 'D' WINDOW w AS (PARTITION BY edit.conv_id ORDER BY k)
    ), repaired AS (
        SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (j - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS whole
        FROM written GROUP BY conv_id
    ), counted AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
               count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal
        FROM faults GROUP BY conv_id
    )
    SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
    FROM best LEFT JOIN counted USING (conv_id) LEFT JOIN repaired USING (conv_id)
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    found = conversation_repair.repair_digests(rows, *(F.col(c) for c in ("conv", "turn", "role", "text", "absent")))
    return found.withColumnRenamed("conv", "conv_id")


@query("op11_nearest_neighbours")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adaptive_scan.usable(table(spark, sf_dir, "embeddings"), F.col("vec_id"), F.col("embedding"))
    return adaptive_scan.nearest(rows, rows.filter("id % 100 = 0"), 10)
