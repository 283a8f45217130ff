import pytest
from pyspark.sql import functions as F

from marquee.operators import evaluation as ev, features as ft, retrieval, text_models as tm


@pytest.fixture(scope="module")
def documents(spark):
    texts = ["space ship travel space", "space war ship", "love story paris", "paris love wedding", "war ship battle", "wedding story love"]
    return spark.createDataFrame([(i, f"t{i}", t) for i, t in enumerate(texts)], "id bigint, title string, movie_document string")


def test_tfidf_relation_equals_the_ml_stage(spark, documents):
    prepared = tm.with_tokens(documents)
    weights = tm.tfidf_weights(tm.term_counts(prepared), prepared, 100, 2.0)
    relation = {(r["id"], r["term"]): round(r["weight"], 9) for r in weights.collect()}
    model, features = tm.text_features(documents, 100, 2.0)
    words = model.stages[2].vocabulary
    ml = {
        (r["id"], words[int(i)]): round(float(v), 9)
        for r in features.collect() for i, v in zip(r["tfidf"].indices, r["tfidf"].values)
    }
    assert relation == ml and ml


def test_sparse_columns_hold_the_vector(spark, documents):
    _, features = tm.text_features(documents, 100, 1.0)
    for r in retrieval.sparse_columns(features, "tfidf").collect():
        assert dict(zip(r["indices"], r["values"])) == dict(zip(map(int, r["tfidf"].indices), r["tfidf"].values))


def test_word2vec_vectors(spark, documents):
    prepared = tm.with_tokens(documents)
    model = tm.fit_word2vec(prepared, size=8, min_count=1, iterations=2)
    rows = tm.document_vectors(model, prepared).collect()
    assert len(rows) == 6 and all(len(r["vector"]) == 8 for r in rows)
    words = {r["word"]: r["vector"].toArray() for r in model.getVectors().collect()}
    first = next(r for r in rows if r["id"] == 2)
    mean = sum(words[w] for w in first["tokens"]) / len(first["tokens"])
    assert max(abs(mean - first["vector"])) < 1e-9
    with pytest.raises(ValueError, match="min_count"):
        tm.fit_word2vec(prepared, min_count=1, max_vocabulary=3)


def test_clusters(spark, documents):
    fitted, features = tm.text_features(documents, 100, 1.0)
    model = tm.fit_clusters(features, k=2)
    clustered = model.transform(features)
    assert clustered.count() == 6 and clustered.select("cluster_id").distinct().count() == 2
    assert -1 <= tm.silhouette(clustered) <= 1
    terms = {r["cluster_id"]: r["top_terms"].split(" | ") for r in tm.cluster_terms(model, fitted.stages[2].vocabulary, features, 3).collect()}
    assert set(terms) == {0, 1} and all(len(t) == 3 for t in terms.values())


def test_modelling_base_defaults(spark):
    df = spark.createDataFrame([("1", "a", "doc"), ("1", "b", "doc"), ("x", "c", "doc"), ("2", "d", " ")], "id string, title string, movie_document string")
    rows = ft.modelling_base(df).collect()
    assert [(r["id"], r["title"], r["vote_average"], r["genres_text"]) for r in rows] == [(1, "a", 0.0, "")]


def test_summaries(spark):
    data = [("m", 1, 10, 0.5, 0.7, 0.2, 7.0, 10.0), ("m", 2, 11, 0.7, 0.9, 0.4, 8.0, 20.0), ("n", 1, 12, 0.1, 0.2, 0.9, 5.0, 5.0)]
    df = spark.createDataFrame(
        data, "model string, query_id bigint, id bigint, similarity_score double, hybrid_score double, genre_overlap double, vote_average double, vote_count double"
    )
    by_query = {r["query_id"]: r for r in ev.query_summary(df, "query_id").collect()}
    assert by_query["__overall__"]["recommendation_count"] == 3
    assert by_query["1"]["avg_similarity_score"] == 0.3
    shaped = df.withColumnsRenamed({"id": "recommended_id", "similarity_score": "score"}).withColumn("popularity", F.lit(2.5))
    assert [r["model"] for r in ev.model_summary(shaped).collect()] == ["n", "m"]
    queries = spark.createDataFrame([(1,), (2,)], "query_id bigint")
    grid = {(r["model"], r["query_id"]): r["recommendation_count"] for r in ev.grid_metrics(shaped, ["m", "n"], queries).collect()}
    assert grid == {("m", 1): 1, ("m", 2): 1, ("n", 1): 1, ("n", 2): 0}


def test_evaluation_invariants(spark):
    """Ranks are dense, the source is never returned, the score falls with the rank."""
    from marquee.plans.served import movies, title_queries, vectors

    sf = "/root/testdata/sf0.001"
    rows = ev.evaluate_dense(title_queries(spark, sf), movies(spark, sf), vectors(spark, sf)).collect()
    by_query = {}
    for r in rows:
        assert r["id"] != r["source_id"]
        by_query.setdefault(r["query_id"], []).append((r["hybrid_rank"], r["hybrid_score"]))
    for found in by_query.values():
        found.sort()
        assert [rank for rank, _ in found] == list(range(1, len(found) + 1))
        assert all(a[1] >= b[1] - 1e-9 for a, b in zip(found, found[1:]))


def test_words_counted_within_rows_equal_those_counted_by_document(spark):
    rows = [(i, t.split()) for i, t in enumerate(["b a b c", "b", "c c c", "a b"])]
    prepared = spark.createDataFrame([*rows, (9, []), (10, None)], "id bigint, tokens array<string>")
    frequency = tm.row_frequency(prepared)
    assert "hashpartitioning(term" in frequency._jdf.queryExecution().executedPlan().toString().replace("term#", "term")[:100000]
    expected = tm.document_frequency(tm.term_counts(prepared))
    assert sorted(map(tuple, frequency.collect())) == sorted(map(tuple, expected.collect()))
    for least in (1, 2, 3):
        assert tm.chosen_words(prepared, 2, least, one_row=True) == tm.chosen_words(prepared, 2, least)


def test_modelling_base_of_unique_rows_is_not_shuffled(spark, documents):
    base = ft.modelling_base(documents, one_row=True)
    assert "Exchange" not in base._jdf.queryExecution().executedPlan().toString()
    assert sorted(base.collect()) == sorted(ft.modelling_base(documents).collect())


def _texts(spark):
    rows = [(1, "red cat red dog"), (2, "blue cat"), (3, "the"), (4, ""), (5, None), (6, "dog dog dog cat")]
    return spark.createDataFrame(rows, "id long, movie_document string")


def test_a_text_is_split_once_where_rows_without_tokens_are_left_out(spark):
    kept = tm.with_tokens(_texts(spark))
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert kept.columns == ["id", "movie_document", "tokens"]
    assert sorted((r.id, *r.tokens) for r in kept.collect()) == [(1, "red", "cat", "red", "dog"), (2, "blue", "cat"), (6, "dog", "dog", "dog", "cat")]


def test_terms_are_counted_within_rows_as_they_are_over_pairs(spark):
    kept = tm.with_tokens(_texts(spark))
    want = sorted(map(tuple, tm.document_frequency(tm.term_counts(kept)).collect()))
    assert sorted(map(tuple, tm.row_frequency(kept).collect())) == want == [("blue", 1, 1), ("cat", 3, 3), ("dog", 2, 4), ("red", 1, 2)]


def test_written_counts_are_weighed_without_reading_texts_again(spark, tmp_path):
    texts = _texts(spark).filter("movie_document IS NOT NULL")
    plain, straight = tm.text_features(texts, 100, 1.0, one_row=True)
    model, written = tm.text_features(texts, 100, 1.0, one_row=True, path=f"{tmp_path}/counts")
    assert "movie_document" not in written._jdf.queryExecution().analyzed().toString()
    assert [type(s) for s in model.stages] == [type(s) for s in plain.stages]
    rows = [sorted((r.id, str(r.counts), str(r.tfidf)) for r in df.collect()) for df in (straight, written, model.transform(texts))]
    assert rows[0] == rows[1] == rows[2]
