"""Block search, titles and discovery against brute force."""

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marquee.operators import ranking, retrieval, titles
from marquee.operators.blocks import BlockSizes
from marquee.operators.discovery import discover, matches
from marquee.operators.intents import intent_of

# Similarity, four norms and the hybrid score of three evaluated results.
GOLDEN = [
    (0.9460315, 0.77, 0.5316838866234709, 0.016253126190004765, 1.0, 0.8328944797631781),
    (0.87870646, 0.7908999999999999, 0.5875215770645186, 0.02537024953499802, 1.0, 0.7929621656326113),
    (0.9545947, 0.7421, 0.0009506416831361169, 0.0013526505623229666, 1.0, 0.7925970268740136),
]

SMALL = BlockSizes(query_rows=7, item_rows=11)
SIZES = [BlockSizes(), SMALL]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.normal(size=6)], int(i % 3 == 0), float(i % 5)) for i in range(60)]
    data += [(60, [0.0] * 6, 1, 2.0), (61, data[5][1], 0, 1.0), (62, data[5][1], 0, 1.0)]
    return spark.createDataFrame(data, "id bigint, vector array<double>, cluster_id int, vote_count double"), data


def brute(data, k, same_cluster=False):
    unit = {}
    for i, v, _, _ in data:
        size = np.linalg.norm(v)
        unit[i] = np.array(v) / size if size else np.array(v)
    out = set()
    for i, _, c, _ in data:
        others = [(-round(float(unit[i] @ unit[j]), 6), -votes, j) for j, _, d, votes in data if j != i and (not same_cluster or c == d)]
        out |= {(i, j, r) for r, (_, _, j) in enumerate(sorted(others)[:k], 1)}
    return out


def asked(df):
    return df.select(F.col("id").alias("query_id"), F.col("id").alias("source_id"), "vector", "cluster_id")


@pytest.mark.parametrize("sizes", SIZES)
@pytest.mark.parametrize("same_cluster", [False, True])
def test_dense_neighbours(spark, vectors, sizes, same_cluster):
    df, data = vectors
    within = ["cluster_id"] if same_cluster else []
    found = retrieval.nearest_dense(asked(df), df, 4, within=within, sizes=sizes)
    got = {(r["query_id"], r["id"], r["retrieval_rank"]) for r in found.collect()}
    assert got == brute(data, 4, same_cluster)


@pytest.mark.parametrize("sizes", SIZES)
def test_sparse_neighbours(spark, sizes):
    rng = np.random.default_rng(5)
    data, plain = [], []
    for i in range(40):
        terms = sorted(int(x) for x in rng.choice(30, size=rng.integers(0, 6), replace=False))
        weights = rng.random(len(terms)) + 0.1
        weights = weights / np.linalg.norm(weights) if len(terms) else weights
        vector = np.zeros(30)
        vector[terms] = weights
        data.append((i, terms, [float(w) for w in weights], 0.0))
        plain.append((i, list(vector), 0, 0.0))
    df = spark.createDataFrame(data, "id bigint, indices array<int>, values array<double>, vote_count double")
    queries = df.select(F.col("id").alias("query_id"), F.col("id").alias("source_id"), "indices", "values")
    found = retrieval.nearest_sparse(queries, df, 5, sizes=sizes)
    got = {(r["query_id"], r["id"], r["retrieval_rank"]) for r in found.collect()}
    assert got == brute(plain, 5)


def test_a_hot_cluster_is_cut_into_blocks(spark):
    """One cluster holds nearly all rows; its blocks still give the whole answer."""
    data = [(i, [1.0, float(i)], 0 if i else 1, 0.0) for i in range(50)]
    df = spark.createDataFrame(data, "id bigint, vector array<double>, cluster_id int, vote_count double")
    found = retrieval.nearest_dense(asked(df), df, 3, within=["cluster_id"], sizes=SMALL)
    got = {(r["query_id"], r["id"], r["retrieval_rank"]) for r in found.collect()}
    assert got == brute(data, 3, True)


@pytest.mark.parametrize("sizes", SIZES)
def test_hybrid_over_all_items(spark, vectors, sizes):
    df, data = vectors
    own = F.col("vote_count") / 10
    found = retrieval.nearest_dense(asked(df), df, 4, weight=0.7, own=own, sizes=sizes)
    got = {(r["query_id"], r["id"], r["retrieval_rank"], round(r["hybrid_score"], 6)) for r in found.collect()}
    units = {i: np.array(v) / (np.linalg.norm(v) or 1.0) for i, v, _, _ in data}
    want = set()
    for i, _, _, _ in data:
        rows = []
        for j, _, _, votes in data:
            if j != i:
                similar = float(units[i] @ units[j])
                rows.append((-round(0.7 * similar + votes / 10, 6), -round(similar, 6), -votes, j))
        want |= {(i, j, r, -h) for r, (h, _, _, j) in enumerate(sorted(rows)[:4], 1)}
    assert got == want


def test_no_queries_no_rows(spark, vectors):
    df, _ = vectors
    assert retrieval.nearest_dense(asked(df).limit(0), df, 3).count() == 0


@pytest.fixture(scope="module")
def movies(spark):
    names = ["Interstellar", "Inception", "The Dark Knight", "Dark", "The Dark Knight Rises", "Titanic", "Titanic", "tide", "diet", "Spirited Away", "interstelar", "Avatar"]
    data = [
        (i, n, 2000 + i, 7.0 + (i % 3) / 10, 100 * (i % 4), float(i), 0.5, "science fiction drama" if i % 2 else "comedy", "en" if i % 3 else "fr", 90.0 + i,
         f"actor {i % 2}", "Jane Director", "space", "over view", "tag")
        for i, n in enumerate(names)
    ]
    return spark.createDataFrame(
        data,
        "id bigint, title string, release_year int, vote_average double, vote_count bigint, popularity double, "
        "recommendation_quality_score double, genres_text string, original_language string, runtime double, "
        "top_cast_text string, director_clean string, keywords_text string, overview_clean string, tagline_clean string",
    )


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, query string")


def norm(text):
    return " ".join(text.lower().split())


def test_fuzzy_titles(spark, movies):
    texts = ["intersteler", "the dark nite", "titanik", "tide", "av", "Spirted  Away"]
    found = titles.fuzzy_titles(queries(spark, *texts), movies).collect()
    got = {(r["query_id"], r["id"], round(r["ratio"], 9)) for r in found}
    rows = movies.collect()
    want = set()
    for q, text in enumerate(texts):
        if len(norm(text)) < 4:
            continue
        scored = [(SequenceMatcher(None, norm(text), norm(m["title"])).ratio(), m) for m in rows]
        kept = sorted(((-s, -m["vote_count"], -m["vote_average"], m["id"]) for s, m in scored if s >= 0.74))[:5]
        want |= {(q, k[3], round(-k[0], 9)) for k in kept}
    assert got == want and want


def test_ratio_is_asymmetric(spark, movies):
    """The query comes first, as the ratio depends on the order."""
    assert SequenceMatcher(None, "tide", "diet").ratio() != SequenceMatcher(None, "diet", "tide").ratio()


def test_resolution_status(spark, movies):
    texts = ["inception", "dark", "titanic", "dark knight", "spirited", "intersteller", "zzzz zzzz", "interstellar"]
    found = titles.resolve_with_status(queries(spark, *texts), movies).collect()
    by_query = {r["query"]: (r["status"], r["source_id"], r["candidates"]) for r in found}
    assert by_query["inception"] == ("resolved", 1, [])
    assert by_query["dark"] == ("resolved", 3, [])
    assert by_query["titanic"][0] == "ambiguous" and set(by_query["titanic"][2]) == {5, 6}
    assert by_query["dark knight"] == ("ambiguous", None, [2, 4])
    assert by_query["spirited"] == ("resolved", 9, [])
    assert by_query["intersteller"] == ("resolved", 0, [])
    assert by_query["zzzz zzzz"] == ("not_found", None, [])
    assert by_query["interstellar"] == ("resolved", 0, [])


def test_exact_title_before_contained(spark, movies):
    found = titles.resolve_first(queries(spark, "DARK", "knight"), movies).collect()
    assert {r["query_id"]: r["id"] for r in found} == {0: 3, 1: 2}


@pytest.mark.parametrize("sizes", SIZES)
def test_discovery_equals_the_single_request_filter(spark, movies, sizes):
    wishes = spark.range(3).select(
        F.col("id").alias("query_id"),
        intent_of(
            preferred_genres=F.when(F.col("id") == 0, F.array(F.lit("Science Fiction"), F.lit(" "))).otherwise(F.array().cast("array<string>")),
            original_languages=F.when(F.col("id") == 1, F.array(F.lit("french"))).otherwise(F.array().cast("array<string>")),
            min_rating=F.when(F.col("id") < 2, F.lit(7.0)),
        ).alias("intent"),
    )
    found = discover(wishes, movies, 3, sizes).collect()
    assert {r["query_id"] for r in found} == {0, 1}
    score = ranking.metadata_score(movies, ranking.DISCOVERY_WEIGHTS)
    for q, intent in [
        (0, intent_of(preferred_genres=F.array(F.lit("Science Fiction")), min_rating=F.lit(7.0))),
        (1, intent_of(original_languages=F.array(F.lit("french")), min_rating=F.lit(7.0))),
    ]:
        want = ranking.best_by_score(movies.withColumn("s", score).filter(matches(intent)), "s", 3)
        assert [r["id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] == [r["id"] for r in want.collect()]


def test_hybrid_arithmetic(spark):
    """Weighted sums of stored norms: inputs and results of the published evaluation."""
    df = spark.createDataFrame(
        GOLDEN, "similarity_score double, rating_norm double, vote_count_norm double, popularity_norm double, quality_norm double, expected double"
    )
    norms = {c: F.col(c) for c in ("rating_norm", "vote_count_norm", "popularity_norm", "quality_norm")}
    for r in ranking.with_hybrid_score(df, norms, ranking.SERVICE_WEIGHTS).collect():
        assert abs(r["hybrid_score"] - r["expected"]) < 1e-12


@pytest.mark.parametrize("weight, own", [(1.0, 0.0), (0.7, 0.1)])
def test_a_block_gives_what_ordering_all_its_scores_gives(weight, own):
    """Ties, repeated ids and the source itself, in a block that is long enough for bounds by runs."""
    rng = np.random.default_rng(3)
    table = rng.integers(-2, 3, (3000, 4)).astype(float)
    items = pd.DataFrame({"id": rng.permutation(3000) // 2, "vote_count": rng.integers(0, 3, 3000).astype(float)})
    items = items.assign(own=own * rng.integers(0, 2, 3000), vector=list(table))
    queries = pd.DataFrame({"query_id": np.arange(7), "source_id": [0, 1, 2, 3, 1499, 5000, 6], "vector": list(table[:7])})
    found = retrieval.ORDER.cut(retrieval._dense_kernel(5, weight)(queries, items), "query_id", 5)
    unit = retrieval.scaled_rows(table)
    for q, source in enumerate(queries["source_id"]):
        cosine = unit @ unit[q]
        key, similar = np.round(weight * cosine + items["own"], 6), np.round(cosine, 6)
        order = np.lexsort((items["id"], -items["vote_count"], -similar, -key))
        want = [i for i in order if items["id"][i] != source][:5]
        got = found[found["query_id"] == q]
        assert got["id"].tolist() == items["id"][want].tolist()
        assert got["score_key"].tolist() == pytest.approx(key[want].tolist(), abs=1.1e-6)


def test_a_pool_is_sent_once_for_65536_items(spark):
    from marquee.operators.blocks import _gridded

    items = spark.range(20000).select("id", F.lit(0.0).alias("vote_count"), F.lit(0.0).alias("own"), F.array(F.rand(1), F.rand(2)).alias("vector"))
    queries = items.filter("id < 3").select(F.col("id").alias("query_id"), F.col("id").alias("source_id"), "vector")
    kernel = retrieval._dense_kernel(4, 1.0)
    found = _gridded(queries, items, kernel, retrieval._SCHEMA, retrieval.ORDER, 4, "query_id", "id", [], retrieval.POOL_SIZES)
    assert found.count() == 3 * 4
