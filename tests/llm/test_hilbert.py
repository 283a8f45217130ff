import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from marquee.llm import hilbert


@pytest.mark.parametrize("n, bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(spark, n, bits):
    grid = spark.createDataFrame(list(product(range(1 << bits), repeat=n)), ", ".join(f"x{i} int" for i in range(n)))
    rows = grid.withColumn("h", hilbert.hilbert_index([F.col(f"x{i}") for i in range(n)], bits)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(1 << n * bits))
    for a, b in zip(rows, rows[1:]):
        assert sum(abs(x - y) for x, y in zip(a[:n], b[:n])) == 1


def test_runs(spark, make_documents):
    texts = [f"text {i % 40} " * (i % 60 + 1) for i in range(900)] + ["same"] * 400 + [None, "", None]
    docs = make_documents(texts).withColumn("source", F.expr("if(doc_id % 3 = 0, 'hot', concat('s', doc_id % 17))"))
    docs = docs.withColumn("lang", F.expr("if(doc_id % 50 = 0, null, lang)")).withColumn("shard", F.lit("x")).repartition(5)
    out = hilbert.sharded(docs, "doc_id", "text", ["source", "lang", "n_chars"], shards=8).collect()
    assert len(out) == len(texts)
    counts = [sorted(r.slot for r in out if r.shard == s) for s in range(8)]
    assert all(c == list(range(len(c))) for c in counts)
    assert max(map(len, counts)) - min(map(len, counts)) <= 1
    for r in out:
        raw = (texts[r.key] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
    order = sorted(out, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in order] == sorted(r.hilbert for r in out)
    # runs along the curve are narrower than the whole in every dimension taken together
    sources = [len({r.d0 for r in out if r.shard == s}) for s in range(8)]
    assert sum(sources) < 8 * 18 * 0.8


def test_null_repeated_and_empty(spark, make_documents):
    docs = make_documents([(None, "a"), (None, "a"), (1, "b"), (1, "b")])
    out = hilbert.sharded(docs, "doc_id", "text", ["source", "lang"], shards=8).collect()
    assert len({(r.shard, r.slot) for r in out}) == 4
    assert hilbert.sharded(docs.limit(0), "doc_id", "text", ["source", "n_chars"], shards=8).count() == 0
