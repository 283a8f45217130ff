import random

from pyspark.sql import functions as F

from marquee.llm import secret_scan


def corpus(n=400, seed=1):
    rnd = random.Random(seed)
    pool = ["".join(rnd.choice("abcdefghilmnorstu") for _ in range(rnd.randint(3, 8))) for _ in range(300)]
    key = lambda chars, k: "".join(rnd.choice(chars) for _ in range(k))
    texts, truth = [], {}
    for i in range(n):
        words = [rnd.choice(pool) for _ in range(40)]
        planted = [
            ("AKIA" + key("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), True),
            ("password=" + key("0123456789abcdef", 18), True),
            (f'"{key("0123456789abcdef", 40)}"', True),
            ("".join(rnd.choice(pool) for _ in range(4)) + "ation", False),
            (f"{rnd.choice(pool)}.{rnd.randint(10, 99)}@mail{rnd.randint(1, 9)}.example.com", False),
        ][i % 5]
        at = rnd.randint(5, 30)
        if planted[0].startswith('"'):
            words[at:at] = ["token", "="] if i % 2 else ["key", "is"]
            at += 2
        words.insert(at, planted[0])
        truth[i] = planted
        texts.append(" ".join(words))
    return texts, truth


def test_findings(spark, make_documents):
    texts, truth = corpus()
    docs = make_documents(texts).withColumn("value", F.lit(1)).withColumn("probability", F.lit(2)).repartition(3)
    found = secret_scan.scanned(docs).collect()
    by = {(r.id, r.candidate): r for r in found}
    for i, (candidate, secret) in truth.items():
        if len(candidate) >= 16:
            r = by[i, candidate]
            assert texts[i].split()[r["at"]] == candidate and r.length == len(candidate)
            # half of the quoted keys stand beside no telling name: only the forest can find them
            assert r.is_secret == secret, (candidate, r.probability)


def test_reviewed_findings(spark, make_documents):
    texts, truth = corpus(200, 2)
    docs = make_documents(texts)
    labels = spark.createDataFrame([(c, int(secret)) for i, (c, secret) in truth.items() if i < 100], "candidate string, label int")
    out = {(r.id, r.candidate): r.is_secret for r in secret_scan.scanned(docs, labels=labels).collect()}
    held = [out[i, c] == secret for i, (c, secret) in truth.items() if i >= 100 and (i, c) in out]
    assert len(held) > 50 and sum(held) / len(held) > 0.97


def test_odd_rows(spark, make_documents):
    docs = make_documents([(1, None), (2, ""), (None, "password=abcdef12345"), (3, "x" * 5000 + "1" * 50), (3, "AKIA" + "Q2" * 8 + " AKIA" + "Q2" * 8)])
    out = secret_scan.scanned(docs.withColumn("source", F.lit(None).cast("string"))).collect()
    assert sorted(str(r.id) for r in out) == ["3", "3", "3", "None"]
    assert secret_scan.scanned(docs.limit(0)).count() == 0
    assert secret_scan.scanned(docs.limit(2)).count() == 0


def test_dictionary_keeps_every_word(spark, make_documents):
    def word(i):
        return "w" + "".join(chr(97 + i // 26**k % 26) for k in range(4))

    common = [" ".join(word(i) for i in range(start, start + 6000)) for start in range(0, 24_000, 6000)]
    docs = make_documents([*common, *common, "seltenwort key3abc4", "ein Seltenwort, key5abc6", "einmal"])
    known = {r.word for r in secret_scan.dictionary(docs, "text").collect()}
    assert known == {*(word(i) for i in range(24_000)), "seltenwort"}


def test_short_values_of_names(spark, make_documents):
    texts = [
        "set password = hunter2xyz now", 'the password: "s3cr3tpw" here', '{"password":"hunter2x"}', "pwd : abc123", "token abc123 used", "api_key\t=\nq1w2e3",
        "password = abc12", "password is hunter2x", "the words = hunter2xyz", 'pwd: "abc"',
    ]
    found = {(r.id, r.candidate): r.value for r in secret_scan.candidates(make_documents(texts)).withColumn("value", secret_scan._value(F.col("candidate"))).collect()}
    assert found == {
        (0, "hunter2xyz"): "hunter2xyz", (1, '"s3cr3tpw"'): "s3cr3tpw", (2, '{"password":"hunter2x"}'): "hunter2x", (3, "abc123"): "abc123", (4, "abc123"): "abc123",
        (5, "q1w2e3"): "q1w2e3",
    }
    assert secret_scan.scanned(make_documents(texts)).count() == 6


def test_rare_secrets_are_learned(spark, make_documents):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghilmnorstu") for _ in range(rnd.randint(5, 9)))
    plain = [" ".join(f"{word()}.{word()}@mail.example.com" for _ in range(60)) for _ in range(100)]
    key = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    hidden = [f"the value is {key()} here" for _ in range(10)]
    told = [f"set password={key()} here" for _ in range(12)]
    docs = make_documents([*plain, *hidden, *told])
    out = secret_scan.scanned(docs, findings=100).collect()
    secrets = {r.id for r in out if r.is_secret}
    assert secrets >= set(range(100, 122)) and not secrets & set(range(100)), secrets


def test_sample_holds_both_labels(spark):
    rows = [(i, 0, f"c{i}", float(i < 7)) for i in range(5000)]
    marked = spark.createDataFrame(rows, "row bigint, at int, candidate string, label double").withColumn("features", F.col("row"))
    for findings in (2, 100):
        sample = secret_scan.fit_sample(marked, {1.0: 7, 0.0: 4993}, findings).groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()
        got = {r.label: r for r in sample}
        assert set(got) == {0.0, 1.0} and abs(got[1.0].w / (got[0.0].w + got[1.0].w) - 7 / 5000) < 1e-9
        assert findings < 100 or (got[1.0].n == 7 and 60 < got[0.0].n < 130)
