import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import adaptive_scan as scan
from marquee.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def taking_part(rows):
    good = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    return [(i, np.array(np.array(v, np.float32), float)) for i, v in rows if i is not None and good(v)]


def brute(rows, k=10, every=100):
    """(query_id, rank, vec_id, score) in plain Python."""
    points, out = taking_part(rows), []
    queries = {}
    for i, v in points:
        if i % every == 0 and (i not in queries or v.tolist() < queries[i].tolist()):
            queries[i] = v
    for q, v in queries.items():
        near = {}
        for i, w in points:
            if i != q and len(w) == len(v):
                d = math.sqrt(((w - v) ** 2).sum())
                near[i] = min(d, near.get(i, d))
        for rank, (d, i) in enumerate(sorted((d, i) for i, d in near.items())[:k], 1):
            out.append((q, rank, i, round(d, 9)))
    return sorted(out)


def got(spark, sf_of, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumn("d", F.lit("x")).withColumn("list", F.lit(1))
    found = QUERIES["op11_nearest_neighbours"](spark, sf_of(embeddings=df)).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in found)


def share(found, true):
    pairs = {(q, i) for q, _, i, _ in true}
    return len(pairs & {(q, i) for q, _, i, _ in found}) / len(pairs)


def clustered(n, d=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, d))
    table = centres[rng.integers(0, 8, n)] + 0.6 * rng.standard_normal((n, d))
    return [(i, [float(x) for x in v]) for i, v in enumerate(table.astype(np.float32))]


def test_recall_against_brute_force(spark, sf_of):
    rows = clustered(4000)
    found, true = got(spark, sf_of, rows), brute(rows)
    assert len(found) == len(true) and share(found, true) >= 0.95
    scores = {(q, i): s for q, _, i, s in found}
    points = dict(taking_part(rows))
    assert all(abs(s - math.sqrt(((points[q] - points[i]) ** 2).sum())) < 1e-8 for (q, i), s in scores.items())


def test_all_lists_and_no_early_end_are_exact(spark, sf_of, monkeypatch):
    monkeypatch.setattr(scan, "EPSILON", 1e9)
    monkeypatch.setattr(scan, "RECALL", 2.0)
    monkeypatch.setattr(scan, "BLOCK", 50)
    monkeypatch.setattr(scan, "PACK", 3)
    rows = clustered(700, d=20)
    monkeypatch.setattr(scan.Index, "_measured", lambda *a: 10_000)
    assert got(spark, sf_of, rows) == brute(rows)


def test_awkward_rows(spark, sf_of, monkeypatch):
    monkeypatch.setattr(scan.Index, "_measured", lambda *a: 10_000)
    rows = [(i, v) for i, v in clustered(300, d=3)]
    rows += [(1000, None), (1100, []), (1200, [0.0, 0.0, 0.0]), (1300, [1.0, None, 2.0]), (1400, [1.0, float("nan"), 2.0]), (1500, [1.0, float("inf"), 0.0])]
    rows += [(None, [1.0, 2.0, 3.0]), (-100, [1.0, 1.0, 1.0]), (400, [1.0, 1.0, 1.0]), (401, [1.0, 1.0, 1.0]), (401, [1.0, 1.0, 1.0]), (500, [3.0, 1.0, 1.0]), (500, [2.0, 1.0, 1.0])]
    rows += [(600, [1.0] * 5), (601, [2.0] * 5), (700, [1.0] * 7)]
    assert got(spark, sf_of, rows) == brute(rows)


def test_a_vector_that_a_third_of_all_rows_share(spark, sf_of):
    rows = clustered(1200, d=8)
    rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows]
    found, true = got(spark, sf_of, rows), brute(rows)
    hot = [r for r in true if r[0] % 3 == 0]
    assert [r for r in found if r[0] % 3 == 0] == hot
    assert share(found, true) >= 0.95


def test_every_query_gets_k(spark, sf_of, monkeypatch):
    monkeypatch.setattr(scan.Index, "_measured", lambda *a: 1)
    rows = clustered(800, d=6)
    found = got(spark, sf_of, rows)
    assert sorted((q, r) for q, r, *_ in found) == [(q, r) for q in range(0, 800, 100) for r in range(1, 11)]


def test_few_rows_and_none(spark, sf_of):
    assert got(spark, sf_of, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [1.0, 1.0])]) == brute([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [1.0, 1.0])])


def test_no_rows(spark, sf_of):
    assert got(spark, sf_of, []) == []


def test_lengths_outside_the_sample(spark, sf_of, monkeypatch):
    monkeypatch.setattr(scan, "FIT", 8)
    rows = [(i, [float(i), 1.0] if i % 50 else [float(i + 1)] * 3) for i in range(1, 402)]
    found = got(spark, sf_of, rows)
    assert found == sorted(found) and share(found, brute(rows)) >= 0.9


def test_early_end_reads_less(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate((rng.standard_normal((10, 64))[rng.integers(0, 10, 3000)] + 0.3 * rng.standard_normal((3000, 64))).astype(np.float32))]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    used = scan.usable(df, F.col("vec_id"), F.col("embedding"))
    index = scan.Index(used)
    queries = used.filter("id % 100 = 0")
    found = index.search(queries, 10, probes=len(index.sizes))
    assert index.components < 0.75 * 30 * 3000 * 64
    report = scan.recall(found, scan.exact(used, queries)).first()
    assert report.n == 300 and report.recall >= 0.97


@pytest.mark.parametrize("k", [1, 5])
def test_scan_keeps_the_nearest_of_repeated_ids(k):
    rng = np.random.default_rng(k)
    queries, vectors = rng.standard_normal((4, 10)), rng.standard_normal((60, 10)).astype(np.float32)
    ids = np.repeat(np.arange(20), 3)
    row, found, score, _ = scan.scan(queries, np.array([0, 1, 90, 91]), np.full(4, np.inf), [vectors[:, :6], vectors[:, 6:]], vectors, ids, queries, k)
    for q, own in enumerate([0, 1, 90, 91]):
        near = {}
        for i, v in zip(ids.tolist(), vectors.astype(float)):
            d = math.sqrt(((v - queries[q]) ** 2).sum())
            if i != own:
                near[i] = min(d, near.get(i, d))
        want = sorted((round(d, 9), i) for i, d in near.items())[:k]
        assert [(round(s, 9), i) for s, i in zip(score[row == q].tolist(), found[row == q].tolist())] == want
