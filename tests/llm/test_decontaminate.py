import random
import re

import pytest
from pyspark.sql import functions as F

from marquee.llm import decontaminate


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(texts, items, window=10):
    wins = {}
    for name, item in items:
        w = words(item)
        k = min(len(w), window)
        for i in range(len(w) - k + 1 if k else 0):
            wins.setdefault(tuple(w[i : i + k]), set()).add(str(name))
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in wins}:
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in wins:
                    hit |= set(range(p, p + k))
                    found |= wins[tuple(w[p : p + k])]
        out.append((len(w), len(hit), tuple(sorted(found))))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    pool = ["the", "of", "Ünd", "straße", "x1", "a", "über", "ion"]
    text = lambda n: " ".join(rnd.choice(pool) + rnd.choice(["", "", ",", ".\n"]) for _ in range(n))
    items = [(i, text(rnd.choice([0, 1, 2, 3, 4, 7, 9, 10, 11, 14, 30]))) for i in range(25)] + [(90, None), (91, "the of"), (92, "The OF!")]
    texts = [text(rnd.randint(0, 60)) for _ in range(80)] + [None, "", "...", "the", "über"]
    texts += [text(5) + " " + items[i][1] + " " + text(5) for i in range(25)] + ["the of " * 3000]
    return texts, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_brute_force(spark, make_documents, block_bytes):
    texts, items = corpus(3)
    docs = make_documents(texts).withColumn("items", F.lit("x")).withColumn("row", F.lit(1))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.key: r for r in decontaminate.contamination(docs, bench, block_bytes=block_bytes).collect()}
    want = brute(texts, items)
    assert len(got) == len(texts)
    for i, (n, n_hit, names) in enumerate(want):
        assert (got[i].n_words, got[i].n_hit, tuple(sorted(got[i]["items"]))) == (n, n_hit, names), texts[i]
        assert all(a.end < b.start for a, b in zip(got[i].spans, got[i].spans[1:]))
    clean = decontaminate.decontaminated(docs, bench, block_bytes=block_bytes)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [i for i, w in enumerate(want) if not w[1]]


def test_longest_match(spark, make_documents):
    item = [f"w{i}" for i in range(40)]
    texts = [" ".join(item[3:20]), "lead in " + " ".join(item[5:33]) + " tail", " ".join(item[:9])]
    bench = spark.createDataFrame([("q", " ".join(item))], "item_id string, text string")
    got = {r.item_word: r for r in decontaminate.longest_matches(make_documents(texts), bench).collect()}
    assert got[5].length == 28 and got[5].key == 1 and got[5].word == 2 and got[5].places == 2
    assert got[3].length == 17 and got[3].key == 0 and got[3].places == 1
    assert 0 not in got and 24 not in got and got[23].length == 10


def test_empty_and_repeated(spark, make_documents):
    bench = spark.createDataFrame([("q", "one two"), ("r", "one two")], "item_id string, text string")
    docs = make_documents([(None, "one two"), (1, "One, two!"), (1, "One, two!"), (2, None)])
    rows = decontaminate.contamination(docs, bench).collect()
    assert sorted((r.n_hit, len(r["items"])) for r in rows) == [(0, 0), (2, 2), (2, 2), (2, 2)]
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.longest_matches(docs, bench.limit(0)).count() == 0


def test_words_that_polynomials_confuse(spark, make_documents):
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    one, two = ("".join(letters[b] for b in bits) for letters in ("ab", "ba"))
    items = spark.createDataFrame([(1, one)], "item_id bigint, text string")
    found = decontaminate.contamination(make_documents([one, two]), items)
    assert sorted((r.key, r.n_hit) for r in found.collect()) == [(0, 1), (1, 0)]


@pytest.mark.parametrize("block_bytes", [1 << 24, 128])
def test_repeated_items_count_once(spark, make_documents, block_bytes):
    words = "one two three four five six seven eight nine ten eleven"
    rows = [(7, words), (7, words), (7, words + " twelve"), (8, words)] + [(20 + i, f"filler {i} text") for i in range(20)]
    items = spark.createDataFrame(rows, "item_id bigint, text string")
    found = decontaminate.contamination(make_documents(["a " + words + " b"]), items, block_bytes=block_bytes).collect()
    assert [sorted(r["items"]) for r in found] == [["7", "8"]]
