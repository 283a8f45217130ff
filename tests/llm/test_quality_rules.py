import random
import re
from collections import Counter

from pyspark.sql import functions as F

from marquee.llm import quality_rules as rules

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def counts(text):
    w = [x for x in SPACE.split(text or "") if x]
    lines = [x for x in (text or "").split("\n") if SPACE.sub("", x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def texts(seed, n=120):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(2, 9)))
    good = lambda: " ".join(word() + rnd.choice(["", "", "", ". "]) for _ in range(rnd.randint(60, 200))) + ".\n" + word()
    junk = [
        lambda: " ".join(word() + rnd.choice(["***", "%%%", "&&&"]) for _ in range(80)),
        lambda: " | ".join(word() for _ in range(70)),
        lambda: " ".join(rnd.choice(["ab", "cd", "ef"]) for _ in range(90)),
        lambda: "\n".join(["same line of it"] * 20),
    ]
    out = [(good(), True) if rnd.random() < 0.7 else (rnd.choice(junk)(), False) for _ in range(n)]
    return out + [(t, False) for t in (None, "", " \t\n", "short one", "a b c a b c", "x " * 49, "\x0b\x0cw\x85 \xa0w")]


def test_counts(spark, make_documents):
    rows = texts(1)
    docs = make_documents([t for t, _ in rows]).withColumn("n_words", F.lit("x"))
    got = {r.id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.judged(docs).collect()}
    assert got == {i: counts(t) for i, (t, _) in enumerate(rows)}


def test_verdict(spark, make_documents):
    rows = texts(2, 300)
    docs = make_documents([t for t, _ in rows]).withColumn("kept", F.lit(1)).withColumn("vote0", F.lit(1))
    judged = {r.id: r for r in rules.judged(docs).collect()}
    for i, (t, good) in enumerate(rows):
        n, _, _, _, repeat = counts(t)
        assert judged[i].base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert judged[i].kept == good
    left = rules.kept_documents(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [i for i, (_, good) in enumerate(rows) if good]


def test_estimate_finds_accuracies():
    rnd = random.Random(3)
    truth = [0.95, 0.9, 0.8, 0.7, 0.9, 0.85, 0.75, 0.9, 0.6, 0.8][: len(rules.RULES)]
    seen = Counter()
    for _ in range(20000):
        good = rnd.random() < 0.6
        seen[tuple(None if rnd.random() < 0.3 else int(good == (rnd.random() < a)) for a in truth)] += 1
    share, right = rules.estimate([(list(k), n) for k, n in seen.items()])
    assert abs(share - 0.6) < 0.03
    assert all(abs(a - g) < 0.05 and abs(a - b) < 0.05 for a, (g, b) in zip(truth, right))


def test_empty_and_repeated(spark, make_documents):
    good = texts(4)[0][0]
    docs = make_documents([(None, good), (1, good), (1, good), (2, None)])
    assert rules.kept_documents(docs).count() in (0, 3)
    assert rules.judged(docs.limit(0)).count() == 0
    assert rules.kept_documents(docs.limit(0)).count() == 0
