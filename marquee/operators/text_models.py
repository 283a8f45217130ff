"""Bag of words, TF-IDF, Word2Vec and K-Means over the movie documents."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import (
    IDF,
    CountVectorizer,
    CountVectorizerModel,
    RegexTokenizer,
    StopWordsRemover,
    Word2Vec,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from marquee.functions.columns import long_table, mean, never_broadcast
from marquee.functions.strings import STOP_WORDS, tokens
from marquee.operators.dedupe import top_per_key

# Fixed values: (vocabulary size, minimum document frequency) of each use.
COMPARISON_VOCABULARY = (20000, 5.0)
BASELINE_VOCABULARY = (50000, 3.0)
TFIDF_VOCABULARY = (60000, 3.0)
VALIDATION_VOCABULARY = (20000, 3.0)


def with_tokens(df: DataFrame, document: str = "movie_document", name: str = "tokens") -> DataFrame:
    """Token arrays; rows without a token are left out.

    The arrays are made by a one-row generator, so that the filter stays above it; pushed below, it would split every text twice.
    """
    made = F.explode(F.array(tokens(document))).alias(name)
    return df.select(*(c for c in df.columns if c != name), made).filter(F.size(name) > 0)


# -- the same features as relations -------------------------------------------------------------------


def term_counts(df: DataFrame, key: str = "id", name: str = "tokens") -> DataFrame:
    """(key, term, tf)."""
    return df.select(key, F.explode(name).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    """(term, df, total): documents and occurrences of each term.

    ``counts`` holds one row per document and term, so this is a plain
    two-stage count: a term of a third of all documents is one row per task.
    """
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


def row_frequency(df: DataFrame, name: str = "tokens") -> DataFrame:
    """The same from token arrays of documents of one row each: a task sends a term once, however many documents hold it."""
    # Each document is counted by its distinct terms, and its occurrences by all of them.
    once = F.struct(F.array_distinct(name).alias("terms"), F.lit(True).alias("once"))
    every = F.struct(F.col(name).alias("terms"), F.lit(False).alias("once"))
    terms = df.select(F.inline(F.array(once, every))).select("once", F.explode("terms").alias("term"))
    return terms.groupBy("term").agg(F.count_if("once").alias("df"), F.count_if(~F.col("once")).alias("total"))


def most_frequent(frequency: DataFrame, size: int, min_df: float) -> DataFrame:
    return frequency.filter(F.col("df") >= min_df).orderBy(F.desc("total"), F.asc("term")).limit(size)


def vocabulary(counts: DataFrame, size: int, min_df: float) -> DataFrame:
    """The ``size`` most frequent terms that occur in at least ``min_df`` documents."""
    return most_frequent(document_frequency(counts), size, min_df)


def tfidf_weights(counts: DataFrame, documents: DataFrame, size: int, min_df: float) -> DataFrame:
    """(id, term, tf, weight) with weight = tf * ln((N + 1) / (df + 1)).

    The vocabulary has at most ``size`` rows, so it is broadcast.
    """
    n = documents.agg(F.count("*")).scalar()
    terms = vocabulary(counts, size, min_df).select(
        "term", F.log((n + 1) / (F.col("df") + 1)).alias("idf")
    )
    return counts.join(F.broadcast(terms), "term").select(
        "id", "term", "tf", (F.col("tf") * F.col("idf")).alias("weight")
    )


# -- ML stages ---------------------------------------------------------------------------------------


def chosen_words(prepared: DataFrame, size: int, min_df: float, tokens_column: str = "tokens", one_row: bool = False) -> list[str]:
    """The vocabulary in order of frequency, ties by name, so that a cut at ``size`` is reproducible.

    At most ``size`` words come to the driver, as they do in any count model. ``one_row``: every id has one
    row, so that its terms are counted within the row and no (id, term) is sent.
    """
    if one_row:
        frequency = row_frequency(prepared, tokens_column)
    else:
        frequency = document_frequency(term_counts(prepared.select("id", tokens_column), name=tokens_column))
    return [r["term"] for r in most_frequent(frequency, size, min_df).select("term").collect()]


def text_pipeline(
    size: int, min_df: float, idf: bool, document: str = "movie_document", words: list[str] | None = None
) -> Pipeline:
    """Tokenise, drop stop words, count, and weigh when ``idf`` is set.

    Given ``words``, the count stage uses them instead of fitting its own.
    """
    counting = dict(inputCol="filtered", outputCol="counts")
    stages = [
        RegexTokenizer(inputCol=document, outputCol="words", pattern=r"\W+", minTokenLength=2),
        StopWordsRemover(inputCol="words", outputCol="filtered", stopWords=STOP_WORDS),
        CountVectorizerModel.from_vocabulary(words, **counting)
        if words
        else CountVectorizer(vocabSize=size, minDF=min_df, **counting),
    ]
    if idf:
        stages.append(IDF(inputCol="counts", outputCol="tfidf"))
    return Pipeline(stages=stages)


def text_features(
    df: DataFrame,
    size: int,
    min_df: float,
    document: str = "movie_document",
    one_row: bool = False,
    path: str | None = None,
    keep: Sequence[str] = ("id",),
) -> tuple[PipelineModel, DataFrame]:
    """Fit the count and TF-IDF stages and add ``counts`` and ``tfidf`` vectors; ``one_row`` as in ``chosen_words``.

    Given a ``path``, the columns ``keep`` and the counts are written there first and all that follows reads them, so
    that texts are split once for the vocabulary and once for the vectors, and not again for each reader.
    """
    words = chosen_words(with_tokens(df, document), size, min_df, one_row=one_row)
    if path is None:
        model = text_pipeline(size, min_df, True, document, words).fit(df)
        return model, model.transform(df)
    counting = text_pipeline(size, min_df, False, document, words).fit(df)
    counting.transform(df).select(*keep, "counts").write.mode("overwrite").parquet(path)
    counted = df.sparkSession.read.parquet(path)
    weighing = IDF(inputCol="counts", outputCol="tfidf").fit(counted)
    return PipelineModel([*counting.stages, weighing]), weighing.transform(counted)


def fit_word2vec(
    prepared: DataFrame,
    size: int = 64,
    min_count: int = 5,
    iterations: int = 5,
    seed: int = 42,
    tokens_column: str = "tokens",
    max_vocabulary: int | None = None,
    partitions: int | None = None,
):
    """Word2Vec over the token arrays, trained on every partition.

    Training keeps the whole vocabulary on the driver and in each task. With
    ``max_vocabulary`` its size is checked first, and a larger one is refused: it
    needs a higher ``min_count``.
    """
    if max_vocabulary is not None:
        words = prepared.select(F.explode(tokens_column).alias("term")).groupBy("term").count()
        known = words.filter(F.col("count") >= min_count).count()
        if known > max_vocabulary:
            raise ValueError(f"{known} words reach min_count={min_count}; at most {max_vocabulary} fit: raise min_count")
    partitions = partitions or max(1, prepared.sparkSession.sparkContext.defaultParallelism)
    stage = Word2Vec(
        vectorSize=size, minCount=min_count, maxIter=iterations, seed=seed, numPartitions=partitions,
        inputCol=tokens_column, outputCol="word2vec",
    )
    return stage.fit(prepared)


def document_vectors(model, prepared: DataFrame) -> DataFrame:
    """Mean word vector of each document as ``vector``."""
    return model.transform(prepared).withColumn("vector", vector_to_array("word2vec")).drop("word2vec")


def training_summary(model, prepared: DataFrame, size: int, min_count: int, iterations: int, tokens_column: str = "tokens") -> DataFrame:
    """Rows, settings, vocabulary size and mean token count as (metric, value)."""
    words = model.getVectors().agg(F.count("*")).scalar()
    stats = prepared.agg(
        F.count("*").alias("movie_count"),
        F.lit(size).alias("vector_size"),
        F.lit(min_count).alias("min_count"),
        F.lit(iterations).alias("max_iter"),
        F.round(F.avg(F.size(tokens_column)), 4).alias("avg_filtered_token_count"),
    )
    return long_table(
        stats.select(
            "movie_count", "vector_size", "min_count", "max_iter",
            words.alias("vocabulary_size"), "avg_filtered_token_count",
        )
    )


# -- clusters ----------------------------------------------------------------------------------------


def fit_clusters(df: DataFrame, features: str = "tfidf", k: int = 20, seed: int = 42, iterations: int = 20):
    return KMeans(featuresCol=features, predictionCol="cluster_id", k=k, seed=seed, maxIter=iterations).fit(df)


def silhouette(clustered: DataFrame, features: str = "tfidf") -> float:
    return ClusteringEvaluator(
        featuresCol=features, predictionCol="cluster_id", metricName="silhouette",
        distanceMeasure="squaredEuclidean",
    ).evaluate(clustered)


def _scored_by_clusters(clustered: DataFrame, tables: np.ndarray, offsets: np.ndarray, features: str) -> DataFrame:
    """id, cluster_id and, per cluster, ``offsets - 2 x . tables`` plus the squared length of x."""

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks:
            scores = [
                (offsets - 2 * tables[:, i] @ v + v @ v).tolist()
                for i, v in ((np.asarray(i, int), np.asarray(v, float)) for i, v in zip(block["indices"], block["values"]))
            ]
            yield block[["id", "cluster_id"]].assign(scores=scores)

    plain = clustered.select("id", "cluster_id", F.unwrap_udt(features).alias("v")).select("id", "cluster_id", "v.indices", "v.values")
    return plain.mapInPandas(run, "id bigint, cluster_id int, scores array<double>")


def centre_distances(model, clustered: DataFrame, features: str = "tfidf") -> DataFrame:
    """id, cluster_id and the squared distance to every centre; centres are k rows of the vocabulary's size."""
    centres = np.array([np.asarray(c, float) for c in model.clusterCenters()])
    return _scored_by_clusters(clustered, centres, (centres * centres).sum(1), features)


def silhouette_of_means(model, clustered: DataFrame, features: str = "tfidf") -> DataFrame:
    """The silhouette by mean squared distances to all members of a cluster, put together from sums per cluster."""
    centres = np.array([np.asarray(c, float) for c in model.clusterCenters()])
    lengths = F.aggregate(F.unwrap_udt(features)["values"], F.lit(0.0), lambda s, x: s + x * x)
    sums = {r.cluster_id: (r.n, r.total) for r in clustered.groupBy("cluster_id").agg(F.count("*").alias("n"), F.sum(lengths).alias("total")).collect()}
    sizes = np.array([sums.get(i, (0, 0.0))[0] for i in range(len(centres))], float)
    spread = np.array([sums[i][1] / sums[i][0] if i in sums else np.inf for i in range(len(centres))])
    scored = _scored_by_clusters(clustered, _member_means(model, clustered, features), spread, features)
    size = F.array(*(F.lit(float(n)) for n in sizes))[F.col("cluster_id")]
    own = F.col("scores")[F.col("cluster_id")] * size / F.when(size > 1, size - 1)
    other = F.array_min(F.filter("scores", lambda x, i: (i != F.col("cluster_id")) & (x < float("inf"))))
    value = F.when(size > 1, (other - own) / F.greatest(own, other)).otherwise(0.0)
    return scored.agg(F.avg(value).alias("silhouette"))


def _member_means(model, clustered: DataFrame, features: str) -> np.ndarray:
    """Mean vector of each cluster's members: the model's centres are those of the last but one assignment."""
    plain = clustered.select("cluster_id", F.unwrap_udt(features).alias("v"))
    cells = plain.select("cluster_id", F.explode(F.arrays_zip("v.indices", "v.values")).alias("c"))
    sums = cells.groupBy("cluster_id", F.col("c.indices").alias("place")).agg(F.sum("c.values").alias("total"))
    counts = clustered.groupBy("cluster_id").agg(F.count("*").alias("n"))
    means = sums.join(counts, "cluster_id").select("cluster_id", "place", (F.col("total") / F.col("n")).alias("mean")).toPandas()
    out = np.zeros((len(model.clusterCenters()), len(model.clusterCenters()[0])))
    out[means["cluster_id"], means["place"]] = means["mean"]
    return out


def cluster_summary(clustered: DataFrame, key: str = "cluster_id") -> DataFrame:
    return clustered.groupBy(key).agg(
        F.count("*").alias("movie_count"),
        mean("vote_average", 3).alias("avg_vote_average"),
        mean("vote_count", 3).alias("avg_vote_count"),
        mean("popularity", 3).alias("avg_popularity"),
        mean("recommendation_quality_score", 3).alias("avg_quality_score"),
    )


def cluster_terms(model, terms: list[str], df: DataFrame, n: int = 15) -> DataFrame:
    """The n heaviest terms of each cluster centre, joined by ' | '.

    Centres and vocabulary belong to the fitted model: k rows of at most
    vocabulary size, so this small table is made from the driver.
    """
    spark = df.sparkSession
    centres = spark.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
        "cluster_id int, centre array<double>",
    )
    words = spark.createDataFrame(list(enumerate(terms)), "place int, term string")
    weights = centres.select("cluster_id", F.posexplode("centre").alias("place", "weight"))
    top = top_per_key(weights, ["cluster_id"], [F.desc("weight"), F.asc("place")], n)
    return _joined_terms(top.join(F.broadcast(words), "place"), "cluster_id")


def mean_terms(weights: DataFrame, members: DataFrame, key: str = "cluster_id", n: int = 15) -> DataFrame:
    """Top terms of given groups by mean weight over all their members.

    ``weights``: id, term, weight; ``members``: id, key. The sum per (group,
    term) is the group's centre up to its size, so the order is the centre's. Weights are rows per
    document and term, which the planner judges by the texts they were made from: they are never sent.
    """
    sums = never_broadcast(weights).join(members, "id").groupBy(key, "term").agg(F.round(F.sum("weight"), 6).alias("weight"))
    return _joined_terms(top_per_key(sums, [key], [F.desc("weight"), F.asc("term")], n), key)


def _joined_terms(top: DataFrame, key: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return top.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["term"]), " | ").alias("top_terms"))


def cluster_report(summary: DataFrame, terms: DataFrame, key: str = "cluster_id") -> DataFrame:
    return summary.join(terms, key, "left")
