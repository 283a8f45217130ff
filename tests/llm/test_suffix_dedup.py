import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import suffix_dedup


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, sha256(kept).hexdigest(), kept))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice("abcé \n") for _ in range(n))
    passages = [text(rnd.randint(15, 120)) for _ in range(8)]
    texts = ["".join(rnd.choice([text(rnd.randint(0, 60)), rnd.choice(passages), rnd.choice(passages)[5:]]) for _ in range(rnd.randint(0, 8))) for _ in range(90)]
    near = [t[: len(t) // 2] + "!" + t[len(t) // 2 :] for t in texts[:20]]
    short = "shared phrase"
    crowd = [text(30) + short + text(30) for _ in range(40)]
    return [*texts, *near, *crowd, *texts[:10], "ab" * 300, "abab" * 20, "a" * 500, "x" * 19, "x" * 19, None, "", "", "y" * 20, "y" * 20]


@pytest.mark.parametrize("length, crowd", [(20, 2000), (20, 3), (33, 5), (200, 2000)])
def test_brute_force(spark, make_documents, length, crowd):
    texts = corpus(length + crowd)
    if length == 200:
        texts = [(t or "") * 7 for t in texts]
    docs = make_documents(texts).withColumn("class", F.lit(1)).withColumn("row", F.lit("r")).repartition(4)
    out = suffix_dedup.without_repeats(docs, length=length, content=True, crowd=crowd).collect()
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in out}
    want = dict(enumerate(brute(texts, length)))
    assert len(out) == len(texts)
    assert {i: (got[i], texts[i]) for i in want if got[i] != want[i]} == {}


def test_suffix_sort():
    rnd = np.random.default_rng(1)
    data = rnd.integers(97, 99, 3000).astype(np.uint8)
    starts = rnd.integers(0, 2960, 700)
    segment = np.sort(rnd.integers(0, 60, 700))
    suffixes = suffix_dedup.Suffixes(data, 40)
    order = suffixes.sorted_segments(starts, segment)
    assert (segment[order] == segment).all()
    raw = data.tobytes()
    want = sorted(range(700), key=lambda i: (segment[i], raw[starts[i] : starts[i] + 40], i))
    assert [raw[starts[i] : starts[i] + 40] for i in order] == [raw[starts[i] : starts[i] + 40] for i in want]
    assert sorted(order) == list(range(700))


def test_null_and_repeated_ids(spark, make_documents):
    long = "".join(chr(97 + i * 7 % 26) for i in range(300)) + "end"
    docs = make_documents([(None, long), (1, "other" + long[40:260]), (1, "same row" * 30), (1, "same row" * 30), (None, None)])
    out = sorted((r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.without_repeats(docs).collect())
    assert len(out) == 5 and out[0] == (0, 0, 0)
    assert suffix_dedup.without_repeats(docs.limit(0)).count() == 0
