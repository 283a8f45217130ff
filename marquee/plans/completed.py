"""Whole records, whole summaries, the three-model comparison, saved models and keyed tables."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import Word2VecModel
from pyspark.sql import functions as F

from marquee.functions.columns import long_table, present
from marquee.operators import dedupe, evaluation as ev, features as ft, profile as pf, text_models as tm
from marquee.plans.profiles import eda
from marquee.plans.registry import ORACLES, query
from marquee.plans.served import TITLE_QUERIES_SQL, movies, title_queries
from marquee.plans.sources import _details, finalise, ready_movies
from marquee.plans.storage import scratch_folder
from marquee.plans.testbed import CATALOGUE_SQL, PREPROCESS_SQL, PROFILE_SQL, catalogue, prepared_sql, profile_sql, sql, table
from marquee.plans.texts import TFIDF_WEIGHT, _tokens_sql, base, clusters, sparse_features
from marquee.sources import payloads, readers, sinks
from marquee.streaming import batches

# -- whole detail records -----------------------------------------------------------------------------

_ORDERED_CAST = """list_transform(list_sort(list_transform(list_zip(t, range(len(t))),
  lambda x: {'k': (100 - x[2] // 2) * 1000 + x[2], 'n': x[1]})), lambda x: x.n)"""


@query(
    "a7_whole_detail_rows",
    sql(CATALOGUE_SQL, select=f"""SELECT id, runtime, status, tagline, budget, revenue, imdb_id, homepage,
      coalesce(array_to_string(list_transform(string_split(spoken_languages, ' | '), lambda x: 'L-' || x), ', '), '') AS spoken_languages,
      coalesce(array_to_string({_ORDERED_CAST}, ', '), '') AS top_cast
    FROM (SELECT *, string_split(top_cast, ' | ') AS t FROM catalogue)"""),
)
def a7(spark, sf):
    """Every scalar, the spoken languages, and a cast that ties in its order and is told apart by the cast id."""
    rows = payloads.detail_rows_short(_details(spark, sf, whole=True))
    return rows.drop("production_companies", "production_countries", "director", "writers", "keywords")


@query(
    "a8_whole_detail_rows",
    sql(CATALOGUE_SQL, select="""SELECT id, runtime, status, tagline, budget, revenue, imdb_id, homepage,
      coalesce(nullif(genres_detail, ''), '') AS genres_detail, production_companies, production_countries, coalesce(spoken_languages, '') AS spoken_languages,
      CASE WHEN director IS NULL OR director = '' THEN '' ELSE director || ' | ' || director END AS director,
      writers, coalesce(top_cast, '') AS top_cast, coalesce(keywords, '') AS keywords, TRUE AS has_time FROM catalogue"""),
)
def a8(spark, sf):
    rows = payloads.detail_rows_wide(_details(spark, sf, whole=True))
    return rows.withColumn("has_time", F.col("enriched_at").isNotNull()).drop("enriched_at")


# -- casts, samples, vocabularies ---------------------------------------------------------------------

_MORE_INTEGERS = [c for c in ft.LONG_COLUMNS if c not in ("id", "vote_count", "source_page", "release_year", "release_month", "release_decade")]


@query(
    "b2_cast_integer_columns",
    profile_sql(f"SELECT id, {', '.join(f'{c}::BIGINT AS {c}' for c in _MORE_INTEGERS)} FROM eda"),
)
def b2(spark, sf):
    """The profiled columns as a CSV file gives them, all text, cast back."""
    rows = eda(spark, sf).select("id", *_MORE_INTEGERS)
    return ft.cast_columns(rows.select(*(F.col(c).cast("string") for c in rows.columns)))


@query(
    "t8_financial_sample",
    profile_sql("""SELECT id, round(ln(1 + budget), 6) AS log_budget, round(ln(1 + revenue), 6) AS log_revenue, vote_average FROM eda
      WHERE has_budget_revenue = 1 AND vote_average IS NOT NULL
        AND CAST('0x' || substr(md5(id || ':42'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.5"""),
)
def t8_financial(spark, sf):
    rows = ft.with_finance_logs(ft.with_finance(catalogue(spark, sf, "id", "budget", "revenue", "vote_average")))
    drawn = pf.hash_sample(rows.dropna(subset=["log_budget", "log_revenue", "vote_average"]), "id", 0.5)
    return drawn.select("id", F.round("log_budget", 6).alias("log_budget"), F.round("log_revenue", 6).alias("log_revenue"), "vote_average")


#: Rows of the subset that the validation vocabulary is fitted on.
VALIDATION_ROWS = 10_000


@query(
    "t8_validation_subset",
    prepared_sql(f"SELECT id, title FROM ready ORDER BY id LIMIT {VALIDATION_ROWS}"),
)
def t8_validation(spark, sf):
    return pf.first_rows(ready_movies(spark, sf).select("id", "title"), VALIDATION_ROWS)


def _vocabulary_sql(rows, size, min_df):
    return prepared_sql(
        "SELECT term, df, total FROM vocabulary",
        f"words AS (SELECT id, unnest({_tokens_sql('movie_document_weighted')}) AS term FROM {rows})",
        "counts AS (SELECT id, term, count(*) AS tf FROM words GROUP BY 1, 2)",
        "frequency AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM counts GROUP BY 1)",
        f"vocabulary AS (SELECT * FROM frequency WHERE df >= {min_df} ORDER BY total DESC, term LIMIT {size})",
    )


def _vocabulary(documents, size, min_df):
    counts = tm.term_counts(tm.with_tokens(documents, "movie_document_weighted").select("id", "tokens"))
    return tm.vocabulary(counts, size, min_df)


@query("m3_baseline_vocabulary", _vocabulary_sql("final", 50000, 3))
def m3_baseline(spark, sf):
    return _vocabulary(movies(spark, sf), *tm.BASELINE_VOCABULARY)


@query("m3_validation_vocabulary", _vocabulary_sql(f"(SELECT * FROM ready ORDER BY id LIMIT {VALIDATION_ROWS})", 20000, 3))
def m3_validation(spark, sf):
    return _vocabulary(pf.first_rows(ready_movies(spark, sf), VALIDATION_ROWS), *tm.VALIDATION_VOCABULARY)


# -- the final chain on input with repeated movies ----------------------------------------------------

_REPEATED_SQL = """
repeated AS (SELECT id, title, movie_document_weighted, genres_text, vote_average, vote_count, popularity, recommendation_quality_score, release_year FROM ready
  UNION ALL SELECT id, title || ' (second)', movie_document_weighted, genres_text, vote_average, vote_count + id % 3 - 1, popularity, recommendation_quality_score, release_year
    FROM ready WHERE id % 2 = 0
  UNION ALL SELECT id, CASE WHEN id % 4 = 0 THEN ' ' ELSE title || ' (third)' END, CASE WHEN id % 4 = 1 THEN '' ELSE movie_document_weighted END, genres_text, vote_average, vote_count, popularity + id % 2,
    recommendation_quality_score + 0.25::DOUBLE, release_year FROM ready WHERE id % 3 = 0),
finished AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY recommendation_quality_score DESC NULLS LAST,
    vote_count DESC NULLS LAST, popularity DESC NULLS LAST, title, movie_document_weighted) AS rn
  FROM repeated WHERE trim(title) <> '' AND trim(movie_document_weighted) <> '' AND trim(genres_text) <> '') WHERE rn = 1)
"""
_FINAL_COLUMNS = [
    "id", "title", "movie_document_weighted", "genres_text", "vote_average", "vote_count", "popularity",
    "recommendation_quality_score", "release_year",
]


def _repeated(spark, sf):
    """Model-ready movies with second and third versions: more or fewer votes, better but sometimes blank ones."""
    rows = ready_movies(spark, sf).select(*_FINAL_COLUMNS)
    number = F.col("id")
    second = rows.filter(number % 2 == 0).withColumns(
        {"title": F.concat("title", F.lit(" (second)")), "vote_count": F.col("vote_count") + number % 3 - 1}
    )
    third = rows.filter(number % 3 == 0).withColumns(
        {
            "title": F.when(number % 4 == 0, " ").otherwise(F.concat("title", F.lit(" (third)"))),
            "movie_document_weighted": F.when(number % 4 == 1, "").otherwise(F.col("movie_document_weighted")),
            "popularity": F.col("popularity") + number % 2,
            "recommendation_quality_score": F.col("recommendation_quality_score") + 0.25,
        }
    )
    return rows.unionByName(second).unionByName(third)


@query(
    "p2_finalised_movies",
    prepared_sql("SELECT id, title, vote_count, popularity, round(recommendation_quality_score, 6) AS quality FROM finished", _REPEATED_SQL),
)
def p2(spark, sf):
    return finalise(_repeated(spark, sf)).select(
        "id", "title", "vote_count", "popularity", F.round("recommendation_quality_score", 6).alias("quality")
    )


@query(
    "g16_summary_of_finalised",
    prepared_sql(
        """SELECT metric, value FROM (SELECT COLUMNS(*)::VARCHAR FROM s) UNPIVOT (value FOR metric IN (COLUMNS(*)))""",
        _REPEATED_SQL,
        """s AS (SELECT (SELECT count(*) FROM repeated) AS rows_input, count(*) AS rows_final, (SELECT count(*) FROM repeated) - count(*) AS rows_removed,
          count(DISTINCT id) AS unique_movies, count(*) - count(DISTINCT id) AS duplicate_ids_final,
          count(*) FILTER (trim(title) = '') AS empty_title_final, count(*) FILTER (trim(movie_document_weighted) = '') AS empty_movie_document_weighted_final,
          count(*) FILTER (trim(genres_text) = '') AS empty_genres_text_final, round(avg(vote_average), 4) AS avg_vote_average,
          round(avg(vote_count), 4) AS avg_vote_count, round(avg(popularity), 4) AS avg_popularity,
          round(avg(recommendation_quality_score), 4) AS avg_recommendation_quality_score, min(release_year) AS min_release_year, max(release_year) AS max_release_year FROM finished)""",
    ),
)
def g16(spark, sf):
    rows = _repeated(spark, sf)
    return pf.final_summary(rows, finalise(rows))


_SUMMED = [c for c in pf.SUMMARY_NUMBERS]


@query(
    "g17_whole_summary",
    sql(
        CATALOGUE_SQL, PROFILE_SQL, PREPROCESS_SQL,
        """whole AS (SELECT p.*, length(movie_document_weighted) AS movie_document_length, coalesce(e.profit, 0) AS profit, coalesce(e.roi, 0) AS roi,
          coalesce(e.metadata_completeness_score, 0) AS metadata_completeness_score FROM prepared p JOIN eda e USING (id))""",
        f"""s AS (SELECT count(*) AS total_rows_preprocessed_full, (SELECT count(*) FROM ready) AS total_rows_model_ready,
          (SELECT count(*) FROM ready) AS total_rows_movie_documents, count(DISTINCT id) AS unique_movies, count(*) - count(DISTINCT id) AS duplicate_movies,
          {', '.join(f"round({f}({c})::DOUBLE, 4) AS {f}_{c}" for c in _SUMMED for f in ('avg', 'min', 'max'))},
          {', '.join(f"round(avg({c}), 4) AS rate_{c}" for c in pf.SUMMARY_FLAGS)} FROM whole)""",
        select="SELECT metric, value FROM (SELECT COLUMNS(*)::VARCHAR FROM s) UNPIVOT (value FOR metric IN (COLUMNS(*)))",
    ),
)
def g17(spark, sf):
    """The summary of the profiled catalogue after preprocessing; only the width of Spark's table has no SQL value."""
    summary = pf.preprocessing_summary(ft.preprocess(eda(spark, sf)))
    return summary.filter(F.col("metric") != "total_columns_preprocessed_full")


# -- three models -------------------------------------------------------------------------------------

_POPULAR_SQL = """popular AS (SELECT query_id, id AS source_id FROM (SELECT q.query_id, f.id, row_number() OVER (PARTITION BY q.query_id
    ORDER BY vote_count DESC, popularity DESC, f.id) AS rn
  FROM title_queries q JOIN final f ON contains(lower(f.title), lower(q.query))) WHERE rn = 1)"""
_NOTEBOOK_TERMS_SQL = f"""
words AS (SELECT id, unnest({_tokens_sql('movie_document_weighted')}) AS term FROM final),
counts AS (SELECT id, term, count(*) AS tf FROM words GROUP BY 1, 2),
frequency AS (SELECT term, count(*) AS df, sum(tf) AS total FROM counts GROUP BY 1),
vocabulary AS (SELECT * FROM frequency WHERE df >= 5 ORDER BY total DESC, term LIMIT 20000)
"""


def _cosine_sql(name, weight):
    return f"""
{name}_weighted AS (SELECT id, term, {weight} AS w FROM counts JOIN vocabulary USING (term), (SELECT count(*) AS n FROM final)),
{name}_norms AS (SELECT id, sqrt(sum(w * w)) AS size FROM {name}_weighted GROUP BY 1),
{name}_dots AS (SELECT s.query_id, s.source_id, i.id, sum(q.w * i.w) AS dot FROM popular s JOIN {name}_weighted q ON q.id = s.source_id
  JOIN {name}_weighted i ON i.term = q.term AND i.id <> s.source_id GROUP BY 1, 2, 3),
{name}_similar AS (SELECT query_id, d.id, dot / (a.size * b.size) AS likeness FROM {name}_dots d JOIN {name}_norms a ON a.id = source_id JOIN {name}_norms b ON b.id = d.id),
{name}_top AS (SELECT query_id, id, likeness AS score, vote_average, vote_count, popularity FROM (SELECT s.*, vote_average, vote_count, popularity,
  row_number() OVER (PARTITION BY query_id ORDER BY round(likeness, 6) DESC, vote_count DESC, f.id) AS rn FROM {name}_similar s JOIN final f ON f.id = s.id) WHERE rn <= 10)
"""


_HYBRID_TOP_SQL = """
log_maxima AS (SELECT coalesce(nullif(max(ln(1 + vote_count)), 0), 1.0::DOUBLE) AS b, coalesce(nullif(max(ln(1 + popularity)), 0), 1.0::DOUBLE) AS c,
  coalesce(nullif(max(recommendation_quality_score), 0), 1.0::DOUBLE) AS d FROM final),
hybrid AS (SELECT s.query_id, i.id, coalesce(likeness, 0) AS likeness, i.vote_average, i.vote_count, i.popularity,
    0.7::DOUBLE * coalesce(likeness, 0) + (0.1::DOUBLE * (i.vote_average / 10.0::DOUBLE) + 0.1::DOUBLE * (ln(1 + i.vote_count) / b)
      + 0.05::DOUBLE * (ln(1 + i.popularity) / c) + 0.05::DOUBLE * (i.recommendation_quality_score / d)) AS score
  FROM popular s JOIN final i ON i.id <> s.source_id LEFT JOIN ti_similar h ON h.query_id = s.query_id AND h.id = i.id, log_maxima),
hybrid_top AS (SELECT query_id, id, score, vote_average, vote_count, popularity FROM (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY round(score, 6) DESC, round(likeness, 6) DESC, vote_count DESC, id) AS rn FROM hybrid) WHERE rn <= 10)
"""


@query(
    "m23_notebook_comparison",
    prepared_sql(
        f"""SELECT m.model, q.query_id, coalesce(n, 0) AS recommendation_count, coalesce(s, 0) AS avg_score,
        coalesce(r, 0) AS avg_vote_average, coalesce(v, 0) AS avg_vote_count, coalesce(p, 0) AS avg_popularity
        FROM (VALUES ('{ev.COUNT_MODEL}'), ('{ev.TFIDF_MODEL}'), ('{ev.HYBRID_MODEL}')) m(model), title_queries q
        LEFT JOIN (SELECT model, query_id, count(*) AS n, round(avg(score), 4) AS s, round(avg(vote_average), 4) AS r,
          round(avg(vote_count), 4) AS v, round(avg(popularity), 4) AS p FROM tops GROUP BY 1, 2) g ON g.model = m.model AND g.query_id = q.query_id""",
        TITLE_QUERIES_SQL,
        _POPULAR_SQL,
        _NOTEBOOK_TERMS_SQL,
        _cosine_sql("cv", "tf::DOUBLE"),
        _cosine_sql("ti", TFIDF_WEIGHT),
        _HYBRID_TOP_SQL,
        f"""tops AS (SELECT '{ev.COUNT_MODEL}' AS model, * FROM cv_top UNION ALL SELECT '{ev.TFIDF_MODEL}', * FROM ti_top
          UNION ALL SELECT '{ev.HYBRID_MODEL}', * FROM hybrid_top)""",
    ),
)
def m23(spark, sf):
    """The notebook's comparison: two cosine models and the hybrid ranking over all movies, per query."""
    queries = title_queries(spark, sf)
    counts, tfidf = sparse_features(spark, sf, "counts"), sparse_features(spark, sf, "tfidf")
    examples = ev.notebook_examples(queries, movies(spark, sf), counts, tfidf)
    return ev.grid_metrics(examples, [ev.COUNT_MODEL, ev.TFIDF_MODEL, ev.HYBRID_MODEL], queries)


# -- invariants of trained models ---------------------------------------------------------------------

_WORDS_SQL = f"words AS (SELECT id, unnest({_tokens_sql('movie_document_weighted')}) AS term FROM final)"


@query(
    "m6_vector_invariants",
    prepared_sql("SELECT count(DISTINCT id) AS vectors, 0::BIGINT AS wrong_length, 0::BIGINT AS away_from_mean FROM words", _WORDS_SQL),
)
def m6(spark, sf):
    """Every document's vector is the mean of its words' vectors (an unknown word counts as zero)."""
    size = 8
    prepared = tm.with_tokens(base(spark, sf)).select("id", "tokens")
    model = tm.fit_word2vec(prepared, size=size, iterations=1)
    words = model.getVectors().select("word", F.unwrap_udt("vector")["values"].alias("own"))
    parts = prepared.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("word"))
    # the vocabulary, which the model holds and sends to every task anyway; no word of a document is sent
    parts = parts.join(F.broadcast(words), "word", "left")
    sums = parts.groupBy("id", "n").agg(*(F.coalesce(F.sum(F.col("own")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(size)))
    both = tm.document_vectors(model, prepared).select("id", "vector").join(sums, "id")
    far = F.greatest(*(F.abs(F.col("vector")[i] - F.col(f"s{i}") / F.col("n")) for i in range(size)))
    return both.agg(
        F.count("*").alias("vectors"), F.count_if(F.size("vector") != size).alias("wrong_length"),
        F.count_if(~F.coalesce(far < 1e-5, F.lit(False))).alias("away_from_mean"),
    )


@query(
    "m17_cluster_invariants",
    prepared_sql("SELECT count(*) AS movies, 0::BIGINT AS away_from_nearest, 0::BIGINT AS without_cluster FROM final"),
)
def m17(spark, sf):
    _, model, clustered = clusters(spark, sf)
    near = tm.centre_distances(model, clustered)
    own = F.col("scores")[F.col("cluster_id")]
    return near.agg(
        F.count("*").alias("movies"), F.count_if(own > F.array_min("scores") + 1e-6).alias("away_from_nearest"),
        F.count_if(F.col("cluster_id").isNull()).alias("without_cluster"),
    )


@query("m18_silhouette_from_means", "SELECT 20 AS k, TRUE AS equal")
def m18(spark, sf):
    """The evaluator's silhouette against one put together from sums per cluster."""
    _, model, clustered = clusters(spark, sf)
    other = tm.silhouette(clustered)
    own = tm.silhouette_of_means(model, clustered)
    return own.select(F.lit(20).alias("k"), (F.abs(F.col("silhouette") - other) < 1e-6).alias("equal"))


# -- saved models, keyed tables, batches --------------------------------------------------------------


@query(
    "s3_reloaded_models",
    """SELECT 'text pipeline' AS model, count(*) AS compared, count(*) AS equal FROM documents
    UNION ALL SELECT 'word vectors', count(*), count(*) FROM (SELECT term FROM (SELECT unnest(""" + _tokens_sql("text") + """) AS term FROM documents)
      GROUP BY 1 HAVING count(*) >= 5)""",
)
def s3(spark, sf):
    """Models saved and read back in another session give the same vectors."""
    path, other = scratch_folder(spark), spark.newSession()
    documents = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("movie_document"))
    fitted, features = tm.text_features(documents, *tm.COMPARISON_VOCABULARY)
    sinks.save_model(fitted, f"{path}/text")
    again = sinks.load_model(PipelineModel, f"{path}/text", other).transform(documents)
    vector = lambda df: df.select("id", F.to_json(F.unwrap_udt("tfidf")).alias("v"))
    texts = vector(features).join(vector(again).withColumnRenamed("v", "w"), "id", "left")
    model = tm.fit_word2vec(tm.with_tokens(documents), size=8, iterations=1)
    sinks.save_model(model, f"{path}/words")
    loaded = sinks.load_model(Word2VecModel, f"{path}/words", other)
    weights = lambda m: m.getVectors().select("word", F.to_json(F.unwrap_udt("vector")).alias("v"))
    words = weights(model).join(weights(loaded).withColumnRenamed("v", "w"), "word", "left")
    counted = lambda name, df: df.agg(F.lit(name).alias("model"), F.count("*").alias("compared"), F.count_if(F.col("v") == F.col("w")).alias("equal"))
    return counted("text pipeline", texts).unionByName(counted("word vectors", words))


@query(
    "s4_upserted_buckets",
    """SELECT count(*) AS rows, count(*) FILTER (content LIKE 'edited %') AS edited, 0::BIGINT AS rewritten_elsewhere, TRUE AS left_files
    FROM (SELECT conv_id * 100 + turn AS id, CASE WHEN conv_id % 50 = 0 THEN 'edited ' || coalesce(text, '') ELSE coalesce(text, '') END AS content FROM conversations
      UNION ALL SELECT -1 - item_id, coalesce(text, '') FROM benchmark WHERE item_id < 3)""",
)
def s4(spark, sf):
    """An upsert of a few rows into a keyed table: files of untouched buckets stay as they were written."""
    path, buckets = scratch_folder(spark) + "/keyed", 64
    rows = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("content"), "conv_id"
    )
    sinks.write_buckets(rows.drop("conv_id"), path, buckets=buckets)
    before = sinks.file_states(spark, path).toPandas()
    edited = rows.filter("conv_id % 50 = 0").select("id", F.concat(F.lit("edited "), "content").alias("content"))
    added = table(spark, sf, "benchmark").filter("item_id < 3").select((-1 - F.col("item_id")).alias("id"), F.coalesce("text", F.lit("")).alias("content"))
    touched = sinks.upsert_buckets(spark, edited.unionByName(added), path, buckets=buckets)
    after = set(sinks.file_states(spark, path).toPandas().itertuples(index=False, name=None))
    changed = [f for f, *_ in (x for x in before.itertuples(index=False, name=None) if x not in after)]
    elsewhere = sum(not any(f"/bucket={b}/" in f for b in touched) for f in changed)
    return spark.read.parquet(path).agg(
        F.count("*").alias("rows"), F.count_if(F.col("content").startswith("edited ")).alias("edited"),
        F.lit(elsewhere).cast("bigint").alias("rewritten_elsewhere"), F.lit(len(changed) < len(before)).alias("left_files"),
    )


@query("g5_counters_while_writing", profile_sql("""SELECT metric, value FROM (SELECT COLUMNS(*)::VARCHAR FROM (
    SELECT count(*) AS rows_written, count(*) FILTER (WHERE runtime <= 0) AS runtime_lte_0, count(*) FILTER (WHERE coalesce(trim(title), '') = '') AS without_title,
      count(*) FILTER (WHERE budget < 0) AS budget_negative, count(*) FILTER (WHERE release_year > 1990) AS after_1990 FROM eda)) UNPIVOT (value FOR metric IN (COLUMNS(*)))"""))
def g5(spark, sf):
    """Checks counted beside the write, without a second scan."""
    rows = ft.with_dates(catalogue(spark, sf, "id", "title", "runtime", "budget", "release_date"))
    seen = sinks.observed(
        rows, lambda df: sinks.write_parquet(df, scratch_folder(spark) + "/checked"),
        rows_written=F.count("*"), runtime_lte_0=F.count_if(F.col("runtime") <= 0),
        without_title=F.count_if(F.coalesce(F.trim("title"), F.lit("")) == ""), budget_negative=F.count_if(F.col("budget") < 0),
        after_1990=F.count_if(F.col("release_year") > 1990),
    )
    return long_table(spark.createDataFrame([tuple(seen.values())], ", ".join(f"{n} bigint" for n in seen)))


_REQUIRED = ["doc_id", "text", "language", "n_chars", "url"]


@query(
    "b4_required_columns",
    "SELECT c AS name, c IN (SELECT column_name FROM (DESCRIBE documents)) AS there, (SELECT count(*) FROM documents) AS in_rows "
    f"FROM (VALUES {', '.join(f'({c!r})' for c in _REQUIRED)}) t(c)",
)
def b4(spark, sf):
    """Which required columns an input has, beside its rows."""
    documents = table(spark, sf, "documents")
    have = present(documents, _REQUIRED)
    flags = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.lit(c in have).alias("there")) for c in _REQUIRED)))
    return documents.agg(F.count("*").alias("in_rows")).select("in_rows", flags.alias("f")).select("f.name", "f.there", "in_rows")


_BATCH_SCHEMA = "id bigint, title string, price double"
_BATCHES_SQL = """batch AS (SELECT o_orderkey, o_custkey AS id, o_orderpriority AS title, o_orderstatus AS file, o_orderkey % 97 = 0 AS bad,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders)"""


def _batch_files(spark, sf, statuses=("F", "O", "P")):
    """Orders as batch files, one folder per status, in order; every 97th has a price that is none. And files that cannot be read."""
    path = scratch_folder(spark) + "/batches"
    price = F.when(F.col("o_orderkey") % 97 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("title"), price.alias("price"), "o_orderkey", "o_orderstatus"
    )
    for status in statuses:
        part = rows.filter(F.col("o_orderstatus") == status).coalesce(1).sortWithinPartitions("o_orderkey")
        sinks.write_csv(part.select("id", "title", "price"), f"{path}/{status}")
    return path


@query(
    "a5_batch_counts",
    f"WITH {_BATCHES_SQL} SELECT file, count(*) FILTER (NOT bad) AS n_valid, count(*) FILTER (bad) AS n_malformed FROM batch GROUP BY 1",
)
def a5_counts(spark, sf):
    path = _batch_files(spark, sf)
    counts = readers.batch_counts(spark, f"{path}/*", _BATCH_SCHEMA)
    return counts.select(F.regexp_extract("batch_file", r"batches/(\w+)/", 1).alias("file"), "n_valid", "n_malformed")


@query(
    "a5_quarantined_rows",
    f"""WITH {_BATCHES_SQL} SELECT file, id || ',' || title || ',n/a' AS text, count(*) AS n FROM batch WHERE bad GROUP BY 1, 2""",
)
def a5_quarantined(spark, sf):
    bad = readers.quarantined_rows(spark, _batch_files(spark, sf) + "/*", _BATCH_SCHEMA)
    file = F.regexp_extract("batch_file", r"batches/(\w+)/", 1)
    return bad.groupBy(file.alias("file"), F.trim("text").alias("text")).agg(F.count("*").alias("n"))


@query(
    "a5_incremental_enrichment",
    f"""WITH {_BATCHES_SQL} SELECT id, title, round(price, 2) AS price FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file DESC, o_orderkey DESC) AS rn
      FROM batch WHERE NOT bad) WHERE rn = 1""",
)
def a5_enrichment(spark, sf):
    """Batch files merged as they come, the latest file first, and every one of them a second time: the last row per id stays."""
    path = scratch_folder(spark)
    files = _batch_files(spark, sf)
    schema = spark.createDataFrame([], _BATCH_SCHEMA).schema
    for number, status in enumerate(("P", "F", "O", "F")):
        stream = batches.new_batches(spark, f"{files}/{status}", schema)
        batches.enrich(stream, f"{path}/table", f"{path}/progress{number}", 16).awaitTermination()
    return spark.read.parquet(f"{path}/table").select("id", "title", F.round("price", 2).alias("price"))


@query("w4_merged_batches", ORACLES["w4_last_batch"])
def w4(spark, sf):
    """The last batch per id, kept up to date by merging month after month in two halves and one of them twice."""
    from marquee.plans.sources import hits

    path = scratch_folder(spark) + "/merged"
    rows = hits(spark, sf).select("id", "batch", "popularity", F.col("batch").alias("batch_file"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("batch_row"))
    late = F.substring("batch", 6, 2).cast("int") > 6
    for number, part in enumerate((late, ~late, late)):
        batches.merge_batch(spark, rows.filter(part), number, path, 16)
    return spark.read.parquet(path).select("id", "batch", "popularity")
