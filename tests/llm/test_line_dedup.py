import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marquee.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"


def brute(texts, min_chars, min_documents):
    seen = defaultdict(set)
    lower = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x)
    keys = [[lower(line.strip(SPACE)) for line in (t or "").split("\n")] for t in texts]
    for i, ks in enumerate(keys):
        for k in ks:
            seen[k].add(i)
    gone = {k for k, v in seen.items() if len(k) >= min_chars and len(v) >= min_documents}
    out = []
    for t, ks in zip(texts, keys):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, ks) if k not in gone]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("batches", [1, 3, 4])
def test_brute_force(spark, make_documents, batches):
    rnd = random.Random(batches)
    pool = ["Über uns", " über uns", "Über Uns\r", "same line", "SAME LINE \t", "", "  ", "x", "\x85nel", "ÀB", "àb", "long " * 50]
    texts = ["\n".join(rnd.choice(pool) + (str(rnd.randint(0, 9)) if rnd.random() < 0.3 else "") for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    texts += [None, "", "\n", "\n\n", "same line", "same line"] + ["copy\nof it"] * 7
    docs = make_documents(texts).withColumn("key", F.lit(1)).withColumn("number", F.lit(2))
    for min_chars, min_documents in [(1, 5), (4, 3)]:
        kept = line_dedup.without_frequent_lines(docs, min_chars=min_chars, min_documents=min_documents, batches=batches)
        got = {r.doc_id: (r.text, r["__n_lines"], r["__n_dropped"]) for r in kept.collect()}
        assert got == dict(enumerate(brute(texts, min_chars, min_documents)))
        assert kept.columns[: len(docs.columns)] == docs.columns


def test_null_and_repeated_ids(spark, make_documents):
    docs = make_documents([(None, "a\nb"), (None, "a\nc"), (1, "a\nd"), (1, "a\nd"), (1, "e")])
    got = sorted(r.text for r in line_dedup.without_frequent_lines(docs, min_documents=4).collect())
    assert got == ["b", "c", "d", "d", "e"]
    assert line_dedup.without_frequent_lines(docs.limit(0)).count() == 0


def test_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, 3)
    batch = spark.createDataFrame([(bytearray([k]),) for k in (1, 2, 2)], "key binary")
    for _ in range(5):
        runs.add(batch)
    assert len(runs.runs()) <= 3
    assert sorted(bytes(r.key) for r in runs.frequent().collect()) == [b"\1", b"\2"]
    runs.forget()


def thue_morse(n):
    """Strings of n and complementary letters on which polynomial hashes modulo 2 ** 64 agree."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("size", [1024, 4096])
def test_lines_that_polynomials_confuse(spark, make_documents, size):
    one, two = thue_morse(size)
    docs = make_documents([one] * 5 + [two] * 5)
    kept = line_dedup.without_frequent_lines(docs, min_chars=1, min_documents=10)
    assert sorted(r.text for r in kept.collect()) == sorted([one] * 5 + [two] * 5)
