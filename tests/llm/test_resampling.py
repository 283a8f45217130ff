import math
import random
import re
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from marquee.llm import resampling
from marquee.llm.queries import QUERIES


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def runs_of(text, n=2):
    words = words_of(text)
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute(documents, target, percent=25, least=20):
    """Plain Python over (id, text) pairs."""
    bucket = lambda run: crc32(run.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [x for _, x in documents]), (t, target)):
        for text in texts:
            for run in runs_of(text):
                counts[bucket(run)] += 1
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (sum(s) + 10000)) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)]
    out = []
    for i, text in documents:
        runs = runs_of(text)
        weight = sum(gain[bucket(r)] for r in runs) // len(runs) if runs else 0
        h = int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for place, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = place
    return sorted((tuple(r[:5]) for r in out), key=repr)


def random_texts(count, seed=3):
    rnd = random.Random(seed)
    vocabulary = ["The", "ÇA", "straße", "naïve", "x1", "42", "Über-all", "a_b", "do\x00t", "😀", "end.", "—"]
    return [rnd.choice([" ", "\n", " \t"]).join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))) for _ in range(count)]


def got(spark, make_documents, sf_of, documents, target):
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    folder = sf_of(documents=make_documents(documents).withColumn("score", F.lit("x")), benchmark=items)
    rows = QUERIES["op13_importance_resampling"](spark, folder).collect()
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in rows), key=repr)


def test_equals_brute_force(spark, make_documents, sf_of):
    documents = list(enumerate(random_texts(300))) + [(900, None), (901, ""), (902, " .,; "), (5, "the the " * 30), (5, "the the " * 30), (None, "a b " * 40)]
    target = [*random_texts(20, 8), None, ""]
    assert got(spark, make_documents, sf_of, documents, target) == brute(documents, target)


def test_same_score_is_ordered_by_id(spark, make_documents, sf_of):
    documents = [(7, "same words " * 15)] * 9 + [(None, "same words " * 15)] * 3
    rows = got(spark, make_documents, sf_of, documents, ["other"])
    assert rows == brute(documents, ["other"])
    assert sorted(r[4] for r in rows if r[4]) == [1, 2, 3]


def test_empty_tables(spark, make_documents, sf_of, tmp_path):
    assert got(spark, make_documents, sf_of, [], []) == []


def test_empty_target(spark, make_documents, sf_of):
    documents = list(enumerate(random_texts(30)))
    assert got(spark, make_documents, sf_of, documents, []) == brute(documents, [])


@pytest.mark.parametrize("size", [1, 7, 1000])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_pieces_of_long_texts_change_nothing(monkeypatch, size, n):
    monkeypatch.setattr(resampling.pieces, "__defaults__", (size,))
    monkeypatch.setattr(resampling, "WORDS", 50)
    texts = [*random_texts(20), "w" * 5000, None, "a " * 3000]
    found = {}
    for buckets, rows, _ in resampling.features([t and t.encode() for t in texts], n, 10000):
        for b, r in zip(buckets.tolist(), rows.tolist()):
            found.setdefault(r, []).append(b)
    for i, text in enumerate(texts):
        assert sorted(found.get(i, [])) == sorted(crc32(r.encode()) % 10000 for r in runs_of(text, n))


def test_a_very_long_text(spark, make_documents, sf_of):
    documents = [(1, "alpha beta gamma " * 150_000), (2, "alpha " * 25), (3, "w" * 3_000_000), (4, "delta " * 30), (5, "beta " * 30)]
    assert got(spark, make_documents, sf_of, documents, ["beta beta"]) == brute(documents, ["beta beta"])


def test_drawn_documents_are_whole_rows(spark, make_documents):
    docs = make_documents(list(enumerate(random_texts(80)))).withColumn("weight", F.lit("own")).withColumn("kept", F.lit(3))
    target = docs.select("text").limit(5)
    drawn = resampling.drawn_documents(docs, target, "doc_id", "text", "text")
    assert drawn.columns == docs.columns
    rows = resampling.ranked(resampling.scored(docs, target, F.col("doc_id"), F.col("text"), F.col("text"))).filter("rank IS NOT NULL")
    assert sorted(r.doc_id for r in drawn.collect()) == sorted(r.id for r in rows.collect())
    assert drawn.join(docs, docs.columns, "left_semi").count() == drawn.count() > 0


def test_the_draw_moves_towards_the_target(spark, make_documents):
    plain, wanted = "grey stone river water field " * 8, "quantum tensor lattice photon spin " * 8
    docs = make_documents([wanted if i % 4 == 0 else plain for i in range(400)])
    target = spark.createDataFrame([(wanted,)], "text string")
    drawn = resampling.drawn_documents(docs, target, "doc_id", "text", "text").collect()
    assert len(drawn) == 100 and sum(r.doc_id % 4 == 0 for r in drawn) > 60
