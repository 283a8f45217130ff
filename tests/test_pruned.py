"""Pruned searches against the full ones: cell index, posting joins, impact-ordered blocks."""

import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marquee.operators import cells, impacts, postings, retrieval, titles
from marquee.operators.blocks import BlockSizes
from marquee.operators.discovery import ScoreOrder, discover
from marquee.operators.intents import intent_of

SMALL = BlockSizes(query_rows=16, item_rows=32)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# -- cells --------------------------------------------------------------------------------------------


def topical(n=600, topics=12, d=8, seed=2):
    """Vectors around a few directions; a third of them are one and the same."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(topics, d))
    table = centres[rng.integers(0, topics, n)] + 0.15 * rng.normal(size=(n, d))
    table[::3] = centres[0]
    data = [(i, [float(x) for x in v], float(i % 5)) for i, v in enumerate(table)]
    return [*data, (n, [0.0] * d, 9.0), (n + 1, [0.0] * d, 1.0)]


VECTORS = "id bigint, vector array<double>, vote_count double"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    df = spark.createDataFrame(topical(), VECTORS)
    path = str(tmp_path_factory.mktemp("cells"))
    return df, cells.CellIndex.build(df, path, ring=20), path


def asked(df):
    return df.select(F.col("id").alias("query_id"), F.col("id").alias("source_id"), "vector")


def results(found):
    return sorted((r["query_id"], r["retrieval_rank"], r["id"], round(r["similarity_score"], 6)) for r in found.collect())


def test_exact_search_equals_the_full_one(index):
    df, built, _ = index
    assert results(built.nearest_exact(asked(df), 5, sizes=SMALL)) == results(retrieval.nearest_dense(asked(df), df, 5))


def test_exact_search_leaves_parts_out(index):
    df, built, _ = index
    share = built.visited_share(asked(df).filter("query_id % 3 = 1"), 5).first()
    assert 0 < share.met < 0.5 * share.all


def test_a_cell_that_a_third_of_all_vectors_share_is_cut(index):
    _, built, _ = index
    sizes = built.parts.groupby("cell")["n"].agg(["sum", "count"])
    assert len(built.parts) > len(built.centres) and built.parts["n"].sum() == 602
    assert (sizes["count"] > 1).any() and set(built.parts.loc[built.parts["cell"] < 0, "n"]) == {2}


def test_recall_follows_the_probes(index):
    df, built, _ = index
    true = retrieval.nearest_dense(asked(df), df, 5)
    probes = built.probes_for(asked(df).filter("query_id % 7 = 0"), 5, 0.97)
    shares = [cells.recall_at(built.nearest(asked(df), 5, p), true).first().recall for p in (1, probes, len(built.centres) + 1)]
    assert shares[0] <= shares[1] <= shares[2] == 1.0 and shares[1] >= 0.95


def test_an_index_is_opened_again(spark, index):
    df, built, path = index
    again = cells.CellIndex.open(spark, path)
    few = asked(df).filter("query_id < 20")
    assert results(again.nearest(few, 3, 2)) == results(built.nearest(few, 3, 2))


def test_a_query_is_sent_once_per_bundle_and_not_per_part(index):
    df, built, _ = index
    bundles = built._bundles(200)
    assert sorted(p for b in bundles for p in b) == list(range(len(built.parts))) and len(bundles) < len(built.parts) / 2
    assert all(built.parts["n"].to_numpy()[b].sum() <= 200 for b in bundles)
    assert built._sent(asked(df), built._probing(1000), bundles).count() == 602 * len(bundles)
    # what leaves the tasks before the last cut: k rows a bundle at most
    sizes = BlockSizes(query_rows=1000, item_rows=200)
    plan = plan_of(built._visit(asked(df), built._probing(1000), 5, (), sizes))
    assert "bundle" in plan and results(built.nearest_exact(asked(df), 5, sizes=sizes)) == results(retrieval.nearest_dense(asked(df), df, 5))


def test_a_query_meets_the_places_of_its_bits_only():
    items = pd.DataFrame({"id": range(6), "vote_count": 0.0, "own": 0.0, "vector": [[1.0, float(i)] for i in range(6)], "place": [0, 0, 1, 1, 2, 2]})
    queries = pd.DataFrame({"query_id": [7, 8], "source_id": [7, 8], "vector": [[1.0, 0.0]] * 2, "bits": [bytes([0b01000000]), bytes([0b10100000])]})
    found = retrieval._visiting_kernel(3)(queries, items)
    assert {q: list(rows["id"]) for q, rows in found.groupby("query_id")} == {7: [2, 3], 8: [0, 1, 4]}


def test_null_vectors_and_no_vectors(spark, tmp_path):
    some = spark.createDataFrame([(1, [1.0, 0.0], 0.0), (2, None, 0.0), (3, [1.0, 1.0], 0.0)], VECTORS)
    built = cells.CellIndex.build(some, f"{tmp_path}/some")
    assert [r[:3] for r in results(built.nearest_exact(asked(some).filter("query_id = 1"), 5))] == [(1, 1, 3)]
    none = cells.CellIndex.build(some.limit(0), f"{tmp_path}/none")
    assert none.nearest_exact(asked(some).filter("query_id = 1"), 5).count() == 0
    assert none.nearest(asked(some).filter("query_id = 1"), 5, 3).count() == 0


# -- postings -----------------------------------------------------------------------------------------

TEXTS = ["the dark knight", "dark", "the dark knight rises", "spirited away", "á la carte", "aa", "a", "aaa", "日本沈没", "b b", "x" * 300, "😀 smile"]
WANTED = ["dark", "da", "k", "aa", "aaaa", "日本", "😀", "the dark knight rises", " ", "knight r", "zz", "x" * 299, "é"]


def frame(spark, name, values):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_contained_texts(spark):
    found = postings.containing(frame(spark, "wanted", WANTED), postings.gram_postings(frame(spark, "key", TEXTS)))
    got = sorted((r.wanted, r.key) for r in found.collect())
    assert got == sorted((w, t) for w in WANTED for t in TEXTS if w in t)
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)


def test_the_rarest_gram_is_looked_up(spark):
    texts = frame(spark, "key", ["common one", "common two", "common qqq", "qq"])
    found = {r.wanted: (r.gram, r.listed) for r in postings.rarest_grams(frame(spark, "wanted", ["common q", "qq", "zzz"]), postings.gram_postings(texts)).collect()}
    assert found["common q"][1] == 1 and found["qq"] == ("qq", 2) and "zzz" not in found


def misspelt(rnd, text):
    letters = list(text)
    for _ in range(rnd.randint(0, 6)):
        at = rnd.randrange(len(letters) + 1)
        if rnd.random() < 0.5 and letters:
            del letters[min(at, len(letters) - 1)]
        else:
            letters.insert(at, rnd.choice("abcdeil "))
    return "".join(letters) or "a"


@pytest.mark.parametrize("percent", [74, 50])
def test_no_similar_pair_is_missed(spark, percent):
    rnd = random.Random(percent)
    base = ["".join(rnd.choice("aabcdeil  ") for _ in range(rnd.randint(1, 24))) for _ in range(60)]
    keys = sorted(set(base + [misspelt(rnd, b) for b in base] + ["é" * 5, "日本沈没", "a" * 250]))
    wanted = sorted(set([misspelt(rnd, b) for b in base] + ["日本沈", "a" * 230, "é" * 4]))
    pairs = [(r.wanted, r.key) for r in postings.similar_pairs(frame(spark, "wanted", wanted), frame(spark, "key", keys), percent).collect()]
    assert len(pairs) == len(set(pairs))
    similar = {(w, k) for w in wanted for k in keys if SequenceMatcher(None, w, k).ratio() >= percent / 100}
    assert similar <= set(pairs) and len(pairs) < 0.6 * len(wanted) * len(keys)


def test_fuzzy_candidates_are_counted(spark):
    movies = spark.createDataFrame([(i, t, 1.0, 1.0) for i, t in enumerate(["Interstellar", "Interstellar", "Titanic", "The Dark Knight", "tide"])], "id bigint, title string, vote_count double, vote_average double")
    queries = spark.createDataFrame([(1, "intersteler"), (2, "titanik"), (3, "abc"), (4, "qqqqqqqq")], "query_id bigint, query string")
    got = {r.query_id: (r.in_length, r.compared) for r in titles.fuzzy_candidates(queries, movies).collect()}
    assert got == {1: (3, 1), 2: (1, 1), 4: (2, 0)}


def test_searches_without_queries_or_movies(spark):
    movies = spark.createDataFrame([(1, "Titanic", 1.0, 1.0, 2000, 1.0), (2, None, 1.0, 1.0, 2000, 1.0), (3, "", 1.0, 1.0, 2000, 1.0)], "id bigint, title string, vote_count double, vote_average double, release_year int, popularity double")
    queries = spark.createDataFrame([(1, "titanic"), (2, None), (3, "")], "query_id bigint, query string")
    for search in (titles.search_titles, titles.resolve_first, titles.resolve_popular, titles.fuzzy_titles):
        assert [(r.query_id, r.id) for r in search(queries, movies).collect()] == [(1, 1)]
        assert search(queries.limit(0), movies).count() == 0 and search(queries, movies.limit(0)).count() == 0


def test_equal_queries_are_all_answered(spark):
    movies = spark.createDataFrame([(i, "Titanic", float(i), 1.0) for i in range(30)], "id bigint, title string, vote_count double, vote_average double")
    queries = spark.createDataFrame([(q, "TITANIC") for q in range(5)], "query_id bigint, query string")
    found = titles.search_titles(queries, movies, 3).collect()
    assert sorted((r.query_id, r["rank"], r.id) for r in found) == [(q, r, 30 - r) for q in range(5) for r in (1, 2, 3)]


# -- impacts ------------------------------------------------------------------------------------------

SPARSE = "id bigint, indices array<int>, values array<double>, vote_count double"


def texts(n=500, topics=10, seed=4):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        topic = rnd.randrange(topics)
        words = sorted({1000 + rnd.randrange(6)} | {topic * 20 + rnd.randrange(12) for _ in range(rnd.randint(0, 6))}) if i % 17 else []
        values = [float(rnd.randint(1, 3)) * (5 if w < 1000 else 1) for w in words]
        rows.append((i, words, values, float(rnd.randrange(4))))
    return rows


def sparse_asked(df):
    return df.select(F.col("id").alias("query_id"), F.col("id").alias("source_id"), "indices", "values")


@pytest.fixture(scope="module")
def impact(spark, tmp_path_factory):
    df = spark.createDataFrame(texts(), SPARSE)
    return df, impacts.ImpactIndex.build(df, str(tmp_path_factory.mktemp("impacts")), block=16)


@pytest.mark.parametrize("k", [4, 40])
def test_block_search_equals_the_full_one(impact, k):
    df, built = impact
    assert results(built.nearest(sparse_asked(df), k, SMALL)) == results(retrieval.nearest_sparse(sparse_asked(df), df, k))


def test_blocks_that_cannot_reach_are_skipped(impact):
    df, built = impact
    counts = built.visited(sparse_asked(df).filter("size(indices) > 3"), 3).agg(F.sum("shared").alias("shared"), F.sum("visited").alias("visited")).first()
    assert 0 < counts.visited < 0.5 * counts.shared


def test_bounds_hold(impact):
    df, built = impact
    bounds = {(r.query_id, r.part): r.bound for r in built.bounds(sparse_asked(df).filter("query_id < 40")).collect()}
    vector = {i: dict(zip(t, np.array(v) / np.linalg.norm(v))) for i, t, v, _ in texts() if t}
    for r in built.items.collect():
        for q in range(40):
            if q in vector and r.id in vector:
                dot = sum(w * vector[r.id].get(t, 0.0) for t, w in vector[q].items())
                assert dot <= bounds.get((q, r.part), 0.0) + 1e-9


def test_one_vector_and_none(spark, tmp_path):
    one = spark.createDataFrame([(1, [3], [2.0], 0.0)], SPARSE)
    built = impacts.ImpactIndex.build(one, f"{tmp_path}/one")
    query = spark.createDataFrame([(7, 9, [3], [1.0]), (8, 1, [3], [1.0]), (9, 9, [], [])], "query_id bigint, source_id bigint, indices array<int>, values array<double>")
    assert results(built.nearest(query, 2)) == [(7, 1, 1, 1.0), (9, 1, 1, 0.0)]
    none = impacts.ImpactIndex.build(one.limit(0), f"{tmp_path}/none")
    assert none.nearest(query, 2).count() == 0


@pytest.mark.parametrize("weight", [0.7, 0.05])
def test_hybrid_block_search_equals_the_full_one(spark, tmp_path, weight):
    df = spark.createDataFrame(texts(), SPARSE)
    own = (F.pmod(F.xxhash64("id"), F.lit(97)) / 300.0).cast("double")
    built = impacts.ImpactIndex.build(df, str(tmp_path), block=16, own=own)
    hybrid = lambda found: sorted((r.query_id, r.retrieval_rank, r.id, round(r.hybrid_score, 6)) for r in found.collect())
    want = hybrid(retrieval.nearest_sparse(sparse_asked(df), df, 5, weight=weight, own=own))
    assert hybrid(built.nearest_hybrid(sparse_asked(df), 5, weight, SMALL)) == want


# -- discovery in score order -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def rated(spark):
    rnd = random.Random(6)
    rows = [
        (i, rnd.choice([5.0, 6.5, 8.0]), rnd.randrange(1000), float(rnd.randrange(50)), rnd.random(), rnd.choice(["drama", "comedy", "war film"]), rnd.choice(["en", "fr", "ko"]),
         rnd.choice([80.0, 120.0, None]), "a", "b", "c", "d", "e", rnd.choice([1990, 2005, 2020])) for i in range(900)
    ]
    return spark.createDataFrame(
        rows,
        "id bigint, vote_average double, vote_count bigint, popularity double, recommendation_quality_score double, genres_text string, original_language string, "
        "runtime double, top_cast_text string, director_clean string, keywords_text string, overview_clean string, tagline_clean string, release_year int",
    )


def wishes(spark, none=False):
    no = F.array().cast("array<string>")
    return spark.range(0 if none else 5).select(
        F.col("id").alias("query_id"),
        intent_of(
            preferred_genres=F.when(F.col("id") == 0, F.array(F.lit("War"))).when(F.col("id") == 3, F.array(F.lit("nothing"))).otherwise(no),
            original_languages=F.when(F.col("id") == 1, F.array(F.lit("korean"))).otherwise(no),
            min_rating=F.when(F.col("id") < 2, F.lit(7.0)),
            max_rating=F.when(F.col("id") == 2, F.lit(5.0)),
        ).alias("intent"),
    )


def listed(found):
    return sorted((r.query_id, r["rank"], r.id, r.score, r.reason) for r in found.collect())


def test_score_order_equals_the_full_discovery(spark, rated, tmp_path):
    order = ScoreOrder.build(rated, str(tmp_path / "o"))
    assert listed(order.discover(wishes(spark), 7, first=16)) == listed(discover(wishes(spark), rated, 7))
    assert order.discover(wishes(spark, none=True), 7).count() == 0
    none = ScoreOrder.build(rated.limit(0), str(tmp_path / "n"))
    assert none.discover(wishes(spark), 7).count() == 0


def test_satisfied_requests_end_the_search(spark, rated, tmp_path):
    order = ScoreOrder.build(rated, str(tmp_path))
    easy = wishes(spark).filter("query_id < 3")
    assert len(order.ranges(easy, 2, first=64)) <= 2
    assert len(order.ranges(wishes(spark), 2, first=64)) == 3
