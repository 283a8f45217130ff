import random

from pyspark.sql import functions as F

from marquee.llm import cotraining
from marquee.llm.shared import setting


def corpus(n=700, seed=1):
    """Documents whose form and words tell their quality, and a source that half tells it."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 5)))
    rows, labels = [], []
    for i in range(n):
        kind = rnd.choice(["good", "good", "good", "junk", "toxic"])
        words = [word() for _ in range(rnd.randint(40, 90))]
        if kind == "junk":
            words = [w + "***" for w in words]
        if kind == "toxic":
            for _ in range(4):
                words[rnd.randrange(len(words))] = rnd.choice(["insultxx", "slurword"])
        bad = kind != "good"
        source = rnd.choice(["farm", "farm", "press"]) if bad else rnd.choice(["press", "press", "farm"])
        rows.append((i, " ".join(words), "en", source, 100))
        if rnd.random() < 0.6:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    return rows, labels


DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


def is_good(text):
    return "***" not in text and "insultxx" not in text and "slurword" not in text


def test_accuracy_on_unlabelled(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, DOCUMENTS).withColumn("score", F.lit("x")).repartition(3)
    out = {r.id: r for r in cotraining.scored(docs, spark.createDataFrame(labels, LABELS)).collect()}
    assert len(out) == len(rows)
    known = {x[0] for x in labels}
    right = [out[i].kept == is_good(t) for i, t, *_ in rows if i not in known]
    assert sum(right) / len(right) >= 0.93, sum(right) / len(right)
    assert all(0 <= r.score <= 1 and 0 <= r.meta_score <= 1 for r in out.values())
    # the score is calibrated: its mean is near the share of good documents
    assert abs(sum(r.score for r in out.values()) / len(out) - sum(is_good(r[1]) for r in rows) / len(rows)) < 0.08


def test_odd_rows(spark):
    rows, labels = corpus(150, 2)
    rows += [(None, "some text", None, None, None), (900, None, "en", "press", 3), (901, "", "en", None, None), (901, "", "en", None, None)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    out = cotraining.scored(docs, spark.createDataFrame(labels + [(None, 1, 0), (5, None, None)], LABELS), rounds=1)
    assert out.count() == len(rows)
    assert cotraining.scored(docs.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0


def test_without_labels(spark):
    rows, labels = corpus(40, 3)
    docs = spark.createDataFrame(rows, DOCUMENTS)
    none = spark.createDataFrame(labels, LABELS).limit(0)
    assert {round(r.score, 6) for r in cotraining.scored(docs, none).collect()} == {0.5}
    one = none.unionByName(spark.createDataFrame([(i, 1, 0) for i in range(40)], LABELS))
    assert all(r.kept for r in cotraining.scored(docs, one).collect())


def test_every_unlabelled_document_can_teach(spark, monkeypatch):
    rows, labels = corpus(500, 4)
    known = {x[0] for x in labels}
    rows = [r for r in rows if r[0] in known]
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 5)))
    for i in range(1000, 1500):
        # twelve of the five hundred are junk
        rows.append((i, " ".join(word() + ("***" if i < 1012 else "") for _ in range(60)), "en", "press", 100))
    taught, fit = [], cotraining._fit

    def spied(train, column, *args):
        if column == "meta_view":
            taught.append({r.id: r.label for r in train.select("id", "label").collect() if r.id >= 1000})
        return fit(train, column, *args)

    monkeypatch.setattr(cotraining, "_fit", spied)
    monkeypatch.setattr(cotraining, "CONFIDENT", 0.8)
    cotraining.fitted(spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(labels, LABELS), rounds=1, pseudo=40)
    junk = {i for i, label in taught[-1].items() if label == 0 and i < 1012}
    assert len(junk) >= 10 and 15 < len(taught[-1]) < 70, taught[-1]


def test_texts_are_read_once_and_never_sent(spark, monkeypatch):
    rows, labels = corpus(300, 6)
    made, tables, features, written = [], [], cotraining.with_features, cotraining.written
    monkeypatch.setattr(cotraining, "with_features", lambda df, *args: made.append(df) or features(df, *args))

    def planned(df, *by):
        tables.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return written(df, *by)

    monkeypatch.setattr(cotraining, "written", planned)
    monkeypatch.setattr(cotraining, "CONFIDENT", 0.6)
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        out = cotraining.scored(spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(labels, LABELS), pseudo=40)
        assert out.count() == len(rows)
    # the labelled sample, then all documents for the rounds and the result together
    assert len(made) == 2
    whole = [plan for columns, plan in tables if columns == ["id", "text_view", "meta_view"]]
    assert whole and not any("Exchange" in plan for plan in whole), whole
    assert not any("SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString() for df in made)


def test_features_are_the_same_each_time(spark):
    """Words and their beginnings are hashed alike for training and scoring; chosen words are those of the whole view."""
    rows, _ = corpus(60, 7)
    docs = spark.createDataFrame([*rows, (None, None, None, None, None)], DOCUMENTS)
    names = ("doc_id", "text", "source", "lang", "n_chars")
    whole = cotraining.with_features(docs, *names)
    views = lambda df: {(r.id, str(r.text_view.toArray().nonzero()), str(r.text_view), str(r.meta_view)) for r in df.collect()}
    assert views(whole) == views(cotraining.with_features(docs, *names))
    held = sorted({int(i) for r in whole.limit(20).collect() for i in r.text_view.indices if i >= cotraining.MEASURES})
    measures = {i: 2.0 for i in range(cotraining.MEASURES)}
    for weights in (measures, measures | {i: 0.1 * n + 0.5 for n, i in enumerate(held[::3])}):
        expected = cotraining._narrow(whole, weights).select("id", "text_view", "meta_view")
        found = cotraining.with_features(docs, *names, weights)
        one, other = ({(r.id, str(r.text_view.toArray().tolist()), str(r.meta_view)) for r in df.collect()} for df in (expected, found))
        assert one == other and len(one) == len(rows) + 1


def test_beginnings_of_words(spark):
    words = ["abcdefgh", "abcdxx", "abcdxy", "abcdef"]
    docs = spark.createDataFrame([(i, w, "en", "press", 1) for i, w in enumerate(words)], DOCUMENTS)
    view = {r.id: set(map(int, r.text_view.indices)) for r in cotraining.with_features(docs, "doc_id", "text", "source", "lang", "n_chars").collect()}
    shared = lambda a, b: len({i for i in view[a] & view[b] if i >= cotraining.MEASURES})
    assert shared(1, 2) == 1 and shared(0, 3) == 2


def test_a_view_scores_after_the_session_has_observed_a_frame(spark):
    from pyspark.ml.linalg import Vectors
    from pyspark.sql import Observation

    seen = Observation()
    spark.range(3).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get == {"n": 3}
    data = [(Vectors.dense([float(i % 2), float(i)]), float(i % 2), 1.0) for i in range(8)]
    rows = spark.createDataFrame(data, ["x", "label", "weight"])
    model = cotraining._fit(rows, "x", None, 0.1)
    odds = {r.label: r.x_odds for r in cotraining.View("x", model).scored(rows).collect()}
    assert odds[1.0] > odds[0.0]
