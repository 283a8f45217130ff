import os
import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marquee.llm import jaccard_join, shared
from marquee.llm.components import components


def shingles(text, n):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    ids = {}
    for i, (key, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(key)
    return {key: (len(s), min(ids[find(i)])) for i, ((key, _), s) in enumerate(zip(rows, sets))}


def near_copies(seed, n_base=14, copies=7):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("xyzäß") + str(rnd.randint(0, 40))
    texts = []
    for b in range(n_base):
        base = [word() for _ in range(rnd.choice([1, 2, 3, 4, 6, 9, 14, 25, 40, 90, 200, 400]))]
        for _ in range(copies):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, max(1, len(base) // 40), len(base) // 12])):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy) if rnd.random() < 0.7 else "\n".join(copy).upper())
    return texts + [None, "", " \n", "one", "ONE", "one two", "One two "]


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80), (2, 70)])
def test_brute_force(spark, make_documents, words, percent):
    rows = list(enumerate(near_copies(words)))
    rows = [(1000 - i, t) for i, t in rows]
    docs = make_documents(rows).withColumn("n", F.lit("x")).withColumn("set_key", F.lit(1)).repartition(3)
    got = {r.id: (r.n, r.component_id) for r in jaccard_join.set_components(docs, words=words, percent=percent).collect()}
    want = brute(rows, words, percent)
    assert got == want
    left = jaccard_join.one_per_group(docs, words=words, percent=percent)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(k for k, (n, c) in want.items() if n == 0 or c == k)


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_linked_sets_share_a_signature(percent):
    rnd = np.random.default_rng(percent)
    for size in [1, 2, 5, 9, 10, 11, 19, 20, 33, 60, 75, 128, 300, 700]:
        for _ in range(12):
            a = rnd.integers(1, 1 << 62, size).astype(np.uint64)
            gone = int(rnd.integers(0, size * (100 - percent) // 100 + 1))
            room = (size - gone) * 100 // percent - size
            extra = rnd.integers(1, 1 << 62, int(rnd.integers(0, max(room, 0) + 1))).astype(np.uint64)
            b = np.concatenate([a[gone:], extra])
            common, union = size - gone, size + len(extra)
            if not len(b) or 100 * common < percent * union:
                continue
            text = np.repeat([0, 1], [size, len(b)])
            sig, owner = jaccard_join.signatures(np.concatenate([a, b]), text, 2, percent)
            assert set(sig[owner == 0]) & set(sig[owner == 1]), (size, gone, len(extra))


def test_null_and_repeated_ids(spark, make_documents):
    long = " ".join(f"w{i}" for i in range(60))
    docs = make_documents([(None, long), (None, long + " x"), (4, long + " y"), (4, long + " y"), (4, "other"), (5, "other")])
    got = sorted((str(r.id), r.n, r.component_id) for r in jaccard_join.set_components(docs).collect())
    assert [c for _, _, c in got] == [4] * 6
    assert jaccard_join.one_per_group(docs).count() == 3
    assert jaccard_join.one_per_group(docs.limit(0)).count() == 0


def test_one_row_per_group(spark, make_documents):
    def base(name):
        return " ".join(f"{name}{i}" for i in range(60))

    rows = [(7, base("a"))] * 5 + [(3, base("b")), (3, base("b") + " x"), (3, base("b") + " y"), (None, base("c")), (None, base("c")), (None, base("c") + " z")]
    rows += [(None, base("d")), (9, base("d") + " x"), (8, base("d")), (5, "alone"), (6, None), (6, None), (None, "")]
    docs = make_documents(rows).repartition(4)
    want = sorted([(7, "a0"), (3, "b0"), ("None", "c0"), (8, "d0"), (5, "alone"), (6, ""), (6, ""), ("None", "")], key=str)

    def heads(df):
        return sorted(((("None" if r.doc_id is None else r.doc_id), (r.text or " ").split(" ")[0]) for r in df.collect()), key=str)

    assert heads(jaccard_join.one_per_group(docs, equal_rows=False)) == want
    assert heads(corpus_pipeline.unique_documents(spark, docs, "")) == want
    # rows that are equal in id and text stay together by default, other near copies go
    assert jaccard_join.one_per_group(docs).groupBy("doc_id").count().filter("doc_id = 7").first()["count"] == 5
    assert jaccard_join.one_per_group(docs).filter("doc_id = 3").count() == 1


def test_components(spark):
    rnd = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(rnd.randint(100, 200), rnd.randint(100, 200)) for _ in range(60)] + [(300, x) for x in range(301, 400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    root = {x: x for link in links for x in link}
    changed = True
    while changed:
        changed = False
        for u, v in links:
            low = min(root[u], root[v])
            if root[u] != low or root[v] != low:
                root[u] = root[v] = low
                changed = True
    assert got == {k: v for k, v in root.items() if any(k in link and link[0] != link[1] for link in links)}


@pytest.mark.parametrize("size", [1024, 4096])
def test_words_that_polynomials_confuse(spark, make_documents, size):
    bits = [bin(i).count("1") & 1 for i in range(size)]
    one, two = ("".join(letters[b] for b in bits) for letters in ("ab", "ba"))
    docs = make_documents([f"x {one} y", f"x {two} y"])
    assert sorted((r.id, r.component_id) for r in jaccard_join.set_components(docs, words=3, percent=90).collect()) == [(0, 0), (1, 1)]


@pytest.mark.parametrize("percent", [90, 80])
def test_packs_let_every_close_pair_through(percent):
    """Sketches whose highest bits differ: the bound counts single bits, whatever the sign of the long."""
    longs = jaccard_join.sketch_size(percent)
    rnd = random.Random(percent)
    members = []
    for i in range(60):
        sketch = [-1 if k % 2 else 0 for k in range(longs)]
        for _ in range(rnd.randint(0, 5)):
            k, bit = rnd.randrange(longs), rnd.choice([0, 1, 62, 63, 63])
            flipped = (sketch[k] & ((1 << 64) - 1)) ^ (1 << bit)
            sketch[k] = flipped - (1 << 64) if flipped >> 63 else flipped
        members.append({"node": i, "component": i, "n": 40, "sketch": sketch})
    kind = pa.list_(pa.struct([("node", pa.int64()), ("component", pa.int64()), ("n", pa.int64()), ("sketch", pa.list_(pa.int64()))]))
    pack = pa.array([members], kind)
    (batch,) = jaccard_join._close_pairs(percent)(iter([pa.RecordBatch.from_arrays([pack, pack], names=["a", "b"])]))
    got = set(zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()))
    want = set()
    for a, b in combinations(members, 2):
        apart = sum(((x ^ y) & ((1 << 64) - 1)).bit_count() for x, y in zip(a["sketch"], b["sketch"]))
        if (100 + percent) * apart <= (100 - percent) * 80:
            want.add((a["node"], b["node"]))
    assert got == want and want


def test_one_signature_stands_for_all_of_the_same_members(spark):
    groups = [(s, 1, v) for s in (10, 11, 12) for v in (1, 2, 3)] + [(13, 1, v) for v in (1, 2)] + [(14, 4, 4)]
    signed = spark.createDataFrame([(s, v) for s, _, v in groups], "sig bigint, class bigint")
    kept = jaccard_join._one_per_members(jaccard_join._grouped(signed)).collect()
    assert sorted(map(tuple, kept)) == [(10, 1, 1), (10, 1, 2), (10, 1, 3), (13, 1, 1), (13, 1, 2)]


def test_signatures_come_in_slices_and_tables_are_removed(spark, make_documents, monkeypatch):
    texts = pa.RecordBatch.from_pydict({"class": [1, 2], "text": near_copies(3)[-12:-10]})
    slices = [{s for b in jaccard_join._signed(3, 80, i)(iter([texts])) for s in b.column("sig").to_pylist()} for i in range(jaccard_join.SIGNATURE_SLICES)]
    whole, _ = jaccard_join.signatures(*jaccard_join.sets_of(texts.column("text"), 3), 2, 80)
    assert sum(map(len, slices)) == len(set().union(*slices)) == len(set(whole.tolist()))
    gone = []
    monkeypatch.setattr(jaccard_join, "dropped", lambda *tables: gone.extend(f for t in tables for f in t.inputFiles()) or shared.dropped(*tables))
    found = jaccard_join.set_components(make_documents(near_copies(5)))
    assert found.count() == len(near_copies(5))
    assert gone and not any(os.path.exists(f.removeprefix("file:").replace("//", "/")) for f in gone)
