"""What never goes through the driver, and what a task sorts: read off the plans."""

import re

from pyspark.sql import functions as F

from marquee.functions.columns import is_few, rows_of
from marquee.operators import evaluation as ev, postings, retrieval, text_models, titles
from marquee.operators.blocks import BlockSizes
from marquee.operators.cells import CellIndex
from marquee.plans import served, storage, testbed
from marquee.plans.sources import final_movies


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _vectors(spark, n: int):
    return spark.range(n).select("id", F.array(F.rand(1), F.rand(2)).alias("vector"), (F.col("id") % 3).alias("part"))


def test_block_search_sends_counts_and_never_queries(spark):
    items = _vectors(spark, 40)
    asked = items.select(F.col("id").alias("query_id"), F.col("id").alias("source_id"), "vector", "part")
    copies = asked.mapInPandas(lambda blocks: blocks, asked.schema)
    found = retrieval.best_dense(copies, items, 2, ["part"], BlockSizes())
    hints = re.findall(r"Join Inner, .*?(leftHint|rightHint)=\(strategy=broadcast\)", _optimized(found))
    assert hints == ["rightHint", "rightHint"]
    assert found.count() == 80


def test_visits_of_one_file_are_chosen_in_many_tasks(spark, tmp_path):
    items = _vectors(spark, 60)
    index = CellIndex.build(items.select("id", "vector"), str(tmp_path / "cells"), cells=3, ring=8)
    asked = items.select(F.col("id").alias("query_id"), F.col("id").alias("source_id"), "vector").coalesce(1)
    visits = index._visits(asked, index._probing(3))
    assert visits.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert visits.count() == 60 * len(index.parts)


def test_tables_that_grow_are_not_broadcast(spark):
    movies = spark.range(5).select(
        "id", *(F.lit("a").alias(c) for c in ("title", "genres_text")), F.lit(2000).alias("release_year"),
        *(F.lit(1.0).alias(c) for c in ("vote_average", "vote_count", "popularity", "recommendation_quality_score")),
    )
    pairs = spark.range(5).select("id", F.lit(1).alias("query_id"), F.lit(0.5).alias("similarity_score"), F.lit(0.0).alias("vote_count"))
    shown = ev.with_payload(pairs, movies)
    assert "strategy=merge" in _optimized(shown)
    assert "Broadcast" not in shown._jdf.queryExecution().executedPlan().toString()
    assert shown.count() == 5
    texts = spark.createDataFrame([("abc",), ("bcd",)], "key string")
    wanted = spark.createDataFrame([("bc",)], "wanted string")
    hits = postings.containing(wanted, postings.gram_postings(texts))
    assert "strategy=merge" in _optimized(hits)
    assert sorted(r.key for r in hits.collect()) == ["abc", "bcd"]


def test_weights_of_terms_are_not_broadcast(spark):
    documents = spark.createDataFrame([(i, ["a", "b"][: 1 + i % 2]) for i in range(6)], "id bigint, tokens array<string>")
    weights = text_models.term_counts(documents).withColumnRenamed("tf", "weight")
    terms = text_models.mean_terms(weights, documents.select("id", (F.col("id") % 2).alias("cluster_id")))
    assert "strategy=merge" in _optimized(terms)
    assert "Broadcast" not in terms._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, terms.collect())) == [(0, "a"), (1, "a | b")]


def test_sales_bring_a_part_together_before_sets_are_collected(spark):
    rows = [(p, 1, n, str(n), "F", n, 0.1, 1.0, 2.0) for p in range(300) for n in (1, 2)]
    lineitem = spark.createDataFrame(
        rows, "l_partkey bigint, l_suppkey bigint, l_orderkey bigint, l_returnflag string, l_linestatus string, "
        "l_linenumber int, l_discount double, l_quantity double, l_extendedprice double"
    ).withColumn("l_shipdate", F.lit("2000-01-01").cast("date"))
    sales = testbed._sales(lineitem)
    plan = sales._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan.split("partial_collect_set")[-1]
    got = sales.collect()
    assert len(got) == 300 and all(r.n == 2 and sorted(r.flag_set) == ["1", "2"] and r.quantity == 2.0 for r in got)


SF = "/root/testdata/sf0.001"


def test_served_movies_write_each_text_once(spark):
    shown = served.movies(spark, SF)
    written = spark.read.parquet(storage._WRITTEN[(spark.sparkContext.applicationId, SF, "movies")])
    assert not [c for c in written.columns if c.startswith("movie_document")]
    assert shown.columns == served.SERVED_COLUMNS
    documents = ["id", "movie_document_basic", "movie_document_rich", "movie_document_weighted", "overview_clean", "top_cast_text"]
    expected = final_movies(spark, SF).select(*documents)
    assert sorted(map(tuple, shown.select(*documents).collect())) == sorted(map(tuple, expected.collect()))


def test_suppliers_of_a_part_are_sent_once(spark):
    lineitem = spark.createDataFrame([(p, s % 12) for p in range(3) for s in range(24)], "l_partkey bigint, l_suppkey bigint")
    supplier = spark.createDataFrame([(s, f"s{s:02}", 0) for s in range(12)], "s_suppkey bigint, s_name string, s_nationkey int")
    cast = testbed._cast_lists(lineitem, F.broadcast(supplier))
    assert cast._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r.top_cast for r in cast.collect()} == {" | ".join(f"s{s:02}" for s in range(10))}


def test_few_keys_are_sent_to_the_table_and_many_are_merged(spark):
    keys, rows = spark.range(3), spark.range(9).withColumn("v", F.col("id") * 2)
    assert is_few(keys, 3) and not is_few(keys, 2)
    few, many = rows_of(keys, rows, "id", True), rows_of(keys, rows, "id", False)
    assert "BuildLeft" in few._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(few.collect()) == sorted(many.collect()) == [(0, 0), (1, 2), (2, 4)]


def test_dense_search_cuts_queries_and_items_into_few_blocks(spark):
    items = _vectors(spark, 9000).select("id", "vector")
    asked = items.select(F.col("id").alias("query_id"), F.col("id").alias("source_id"), "vector").limit(5)
    found = retrieval.nearest_dense(asked, items, 2)
    assert "/ 16384" in _optimized(found) and "/ 8192" in _optimized(found)
    kernels = [retrieval._dense_kernel(2, 1.0, cells) for cells in (1, 1 << 20)]
    sides = asked.toPandas(), items.limit(50).withColumns({"vote_count": F.lit(0.0), "own": F.lit(0.0)}).toPandas()
    one, all_ = (kernel(*sides) for kernel in kernels)
    assert one.round(9).equals(all_.round(9)) and len(one) == 10


def test_titles_that_grow_are_not_broadcast(spark):
    columns = "id bigint, title string, vote_count double, vote_average double"
    movies = spark.createDataFrame([(1, "Alpha Centauri", 3.0, 4.0), (2, "Beta Pictoris", 2.0, 4.0)], columns)
    queries = spark.createDataFrame([(1, "alpha centauri"), (2, "beta pictoriss")], "query_id bigint, query string")
    found = titles.fuzzy_titles(queries, movies)
    assert _optimized(found).count("strategy=merge") >= 4
    assert sorted((r.query_id, r.id) for r in found.collect()) == [(1, 1), (2, 2)]
    resolved = titles.resolve_with_status(queries, movies)
    assert "strategy=merge" in _optimized(resolved.select("query_id", "status", "source_id")).split("LeftOuter", 1)[1]
    assert sorted((r.query_id, r.source_id) for r in resolved.collect()) == [(1, 1), (2, 2)]
