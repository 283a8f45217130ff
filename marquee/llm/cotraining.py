"""Quality classifier by co-training.

Two views of a document are learned apart: its text (hashed words and word beginnings,
and a few measures of form) and its page metadata (source, language, declared length). In
each round either classifier labels the unlabelled documents that it is confident about,
and these pseudo-labels train the other one. At the end each view is calibrated on
held-out labels, and a small regression over both calibrated log-odds scores all documents.

Words enter the text view with the weight that naive Bayes would give them: the smoothed
log-ratio of their shares in good and other training texts, and not at all unless the shares
differ beyond chance. So words that are rare in training add no noise.

A document is good if its label says quality 1 and toxic 0.

Fitting reads ``LABELLED`` labelled rows, give or take chance: a sample by hash of the id, so it
does not depend on order or partitions. A fifth of them is held out for calibration. In each
round both views score every document. Of all unlabelled ones that a view is confident about, the other
one trains on ``PSEUDO`` at most, give or take chance: a sample by hash of each class, half of
them of either class or all of a rarer one, with weights that restore the shares of the classes.
Scoring reads every document.

A document is kept if its score is 0.5 or more, or lower, where that would drop more than 2 % of
the held-out good documents (``KEEP_GOOD``): the bound then is the score that keeps 98 %.

Confidence is judged by calibrated probability: a view whose probabilities never reach
``CONFIDENT`` gives no labels away, so a weak view cannot mislead the strong one.

Defined cases: NULL and empty texts have no words and are scored by their measures and
metadata; NULL metadata is a value of its own; documents with several labels count each;
rows with equal id are scored row by row; without any label, or labels of one class
only, every document gets the share of good labels (0.5 without any); an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import ElementwiseProduct, HashingTF, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from marquee.llm.expressions import let, words_of
from marquee.llm.shared import PARTS, label_shares, written

LABELLED, PSEUDO = 20_000, 10_000
ROUNDS = 2
CONFIDENT = 0.97
#: Share of held-out good documents that the decision keeps at least.
KEEP_GOOD = 0.98
PSEUDO_WEIGHT = 0.5
TEXT_SIZE, META_SIZE = 1 << 16, 1 << 12
#: Measures of form at the head of the text view, and their weight.
MEASURES, MEASURE_WEIGHT = 6, 2.0
#: Standard deviations by which a word's shares must differ to count.
DEVIATIONS = 3.5
#: Words that the text classifier weighs: those that deviate most.
WORDS = 4096
#: Partitions of the bounded training sample: few enough that an iteration is one stage.
FIT_PARTITIONS = 4


def _measures(w: Column, text: Column) -> list[Column]:
    n = F.greatest(F.size(w), F.lit(1)).cast("double")
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    return [
        F.size(F.array_distinct(w)) / F.sqrt(n) / 10,
        F.least(F.regexp_count(text, F.lit(r"[#*$%&|<>]")) / n, F.lit(2.0)),
        5 * F.regexp_count(text, F.lit(r"\p{Lu}")) / chars,
        F.regexp_count(text, F.lit(r"[!?.]")) / n,
        F.log1p(n) / 10,
        F.least(chars / n, F.lit(40.0)) / 10,
    ]


def with_features(documents: DataFrame, key: str, text: str, source: str, lang: str, length: str, weights: dict[int, float] | None = None) -> DataFrame:
    """``id``, ``text_view`` and ``meta_view``: hashed, sparse, and bounded in size.

    With ``weights`` (all measures and some words) the text view is what ``_narrow`` makes of it; other words are left out before
    it is put together.
    """
    rows = documents.select(
        F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(source).cast("string").alias("source"),
        F.col(lang).cast("string").alias("lang"), F.col(length).cast("double").alias("length"),
    )

    def tokens(w: Column) -> Column:
        def starts(lower: Column, k: int) -> Column:
            # one parameter: Spark would pass a second one the place in the array
            return F.transform(lower, lambda x: F.concat(F.lit(f"{k}^"), F.substring(x, 1, k)))

        def begun(lower: Column) -> Column:
            return F.concat(lower, starts(lower, 4), starts(lower, 6))

        told = let(F.array_distinct(F.transform(w, F.lower)), begun)
        return F.struct(told.alias("tokens"), *(m.alias(f"m{i}") for i, m in enumerate(_measures(w, F.col("text")))))

    size = F.floor(F.log2(F.coalesce("length", F.lit(0.0)) + 1))
    meta = F.array(
        *(F.concat(F.lit(f"{c}="), F.coalesce(c, F.lit("\0"))) for c in ("source", "lang")), F.concat(F.lit("size="), size.cast("string")),
        F.concat(F.lit("both="), F.coalesce("lang", F.lit("\0")), F.lit("/"), size.cast("string")),
    )
    rows = rows.select("id", let(words_of(F.col("text")), tokens).alias("view"), meta.alias("meta")).select("id", "view.*", "meta")
    rows = HashingTF(numFeatures=TEXT_SIZE, binary=True, inputCol="tokens", outputCol="words").transform(rows)
    rows = HashingTF(numFeatures=META_SIZE, binary=True, inputCol="meta", outputCol="meta_view").transform(rows)
    measures = [c for c in rows.columns if c[0] == "m" and c[1:].isdigit()]
    if weights is None:
        rows = VectorAssembler(inputCols=[*measures, "words"], outputCol="text_view", handleInvalid="keep").transform(rows)
        return rows.select("id", "text_view", "meta_view")
    parts, words = list(measures), [i - MEASURES for i in weights if i >= MEASURES]
    if words:
        rows = VectorSlicer(inputCol="words", outputCol="some", indices=words).transform(rows)
        parts.append("some")
    rows = VectorAssembler(inputCols=parts, outputCol="told", handleInvalid="keep").transform(rows)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(list(weights.values())), inputCol="told", outputCol="text_view")
    return scaled.transform(rows).select("id", "text_view", "meta_view")


@dataclass
class View:
    """A classifier of one view and the calibration of its margin; the text view weighs its inputs first."""

    column: str
    model: LogisticRegressionModel
    weights: dict[int, float] | None = None
    slope: float = 1.0
    shift: float = 0.0

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the calibrated log-odds as ``<column>_odds``."""
        rows = _weighed(rows, self.column, self.weights)
        out = self.model.setFeaturesCol("__x").setRawPredictionCol("__raw").setProbabilityCol("").setPredictionCol("").transform(rows)
        return out.withColumn(f"{self.column}_odds", vector_to_array("__raw")[1] * self.slope + self.shift).drop("__raw", "__x")


def _weighed(rows: DataFrame, column: str, weights: dict[int, float] | None) -> DataFrame:
    """The view's inputs as ``__x``: all of them, or the chosen ones with their weights."""
    if weights is None:
        return rows.withColumn("__x", F.col(column))
    rows = VectorSlicer(inputCol=column, outputCol="__some", indices=list(weights)).transform(rows)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(list(weights.values())), inputCol="__some", outputCol="__x")
    return scaled.transform(rows).drop("__some")


def _word_weights(train: DataFrame) -> dict[int, float]:
    """Naive Bayes log-ratios of the hashed words that differ beyond chance, ``WORDS`` at most; measures keep a fixed weight."""
    sums = Summarizer.metrics("sum")
    rows = train.groupBy("label").agg(sums.summary(F.col("text_view"))["sum"].alias("sums"), F.count("*").alias("n")).collect()  # two rows
    seen = {r["label"]: (r["sums"].toArray() + 1, r["n"] + 2) for r in rows}
    (good, n_good), (bad, n_bad) = seen[1.0], seen[0.0]
    ratio = np.abs(np.log(good / n_good) - np.log(bad / n_bad))
    deviations = ratio / np.sqrt(1 / good + 1 / bad)
    deviations[:MEASURES] = np.inf
    ratio[:MEASURES] = MEASURE_WEIGHT
    telling = np.flatnonzero(deviations >= DEVIATIONS)
    telling = np.sort(telling[np.argsort(-deviations[telling], kind="stable")[: WORDS + MEASURES]])
    return {int(i): float(ratio[i]) for i in telling}


def _fit(rows: DataFrame, column: str, weights: dict[int, float] | None, reg: float) -> LogisticRegressionModel:
    rows = _weighed(rows, column, weights)
    learner = LogisticRegression(featuresCol="__x", labelCol="label", weightCol="weight", maxIter=20, regParam=reg, standardization=False)
    model = learner.fit(rows)
    # The summary of the training holds the session, which tasks cannot be sent once it has observed a write.
    model._java_obj.setSummary(rows.sparkSession._jvm.scala.Option.empty())
    return model


def _regression(rows: list, inputs: int) -> list[float]:
    """Shift and weights of a logistic regression on a few inputs by Newton's method; the label comes last."""
    data = np.array(rows, float).reshape(-1, inputs + 1)
    x, y = np.column_stack([np.ones(len(data)), data[:, :-1]]), data[:, -1]
    w = np.zeros(inputs + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (p - y) + 0.1 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(inputs + 1), slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return [float(v) for v in w]


def _calibrated(view: View, held: DataFrame) -> View:
    """Platt scaling: a regression of held-out labels (a fifth of the sample) on the margin."""
    shift, slope = _regression(view.scored(held).select(f"{view.column}_odds", "label").collect(), 1)
    return View(view.column, view.model, view.weights, slope, shift)


def _sample(rows: DataFrame, bound: int, salt: int) -> DataFrame:
    """About ``bound`` rows, chosen by hash of the id; all rows if there are fewer."""
    total = rows.count()
    million = 1_000_000
    share = million if total <= bound else bound * million // total
    return rows.filter(F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(million)) < share)


def _narrow(rows: DataFrame, weights: dict[int, float]) -> DataFrame:
    """``rows`` with the chosen and weighed inputs as the text view."""
    return _weighed(rows, "text_view", weights).withColumn("text_view", F.col("__x")).drop("__x")


def _unmarked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``rows`` without a label; joined by merge, as the table of marked ids grows with the labels."""
    return rows.join(marks.hint("merge"), "id", "left_anti")


def _pseudo_labelled(judged: DataFrame, odds: str, bound: int, marks: DataFrame) -> DataFrame:
    """About ``bound`` of all unlabelled rows whose ``odds`` are confident, each class drawn apart and weighed back.

    ``marks``: ids with a label. Ids alone are sent to leave them out of the count, and the drawn rows only with their views.
    """
    edge = log(CONFIDENT / (1 - CONFIDENT))
    sure = judged.filter(F.abs(odds) >= edge).withColumn("label", (F.col(odds) > 0).cast("double"))
    counted = _unmarked(sure.select("id", "label"), marks).groupBy("label").agg(F.count("*").alias("n"))
    total = {r["label"]: r["n"] for r in counted.collect()}  # at most two rows
    shares = label_shares(total, bound)
    drawn = sum(n * shares[label] / PARTS for label, n in total.items())
    scale = {label: PSEUDO_WEIGHT * PARTS / shares[label] * drawn / sum(total.values()) for label in total}
    pick = lambda of, default: F.when(F.col("label") == 1, F.lit(of.get(1.0, default))).otherwise(F.lit(of.get(0.0, default)))
    # chosen by the whole row: rows with equal or NULL ids are drawn one by one
    chosen = sure.filter(F.pmod(F.xxhash64(F.lit(3), "id", "text_view", "meta_view"), F.lit(PARTS)) < pick(shares, 0))
    return _unmarked(chosen.select("id", "text_view", "meta_view", "label", pick(scale, PSEUDO_WEIGHT).alias("weight")), marks)


def _bounded(rows: DataFrame) -> DataFrame:
    """A bounded sample, written once and read in few partitions."""
    return written(written(rows).coalesce(FIT_PARTITIONS)).coalesce(FIT_PARTITIONS)


@dataclass
class Classifier:
    """Both views, the weights of their calibrated log-odds, and the log-odds from which a document is kept."""

    text: View | None
    meta: View | None
    weights: tuple[float, float, float]
    kept_from: float = 0.0

    def scored(self, rows: DataFrame) -> DataFrame:
        shift, a, b = self.weights
        if self.text is None:
            return rows.select("id", *(F.lit(None).cast("double").alias(c) for c in ("text_odds", "meta_odds")), F.lit(shift).alias("odds"))
        both = self.meta.scored(self.text.scored(rows))
        odds = shift + a * F.col("text_view_odds") + b * F.col("meta_view_odds")
        return both.select("id", F.col("text_view_odds").alias("text_odds"), F.col("meta_view_odds").alias("meta_odds"), odds.alias("odds"))


def fitted(documents: DataFrame, labels: DataFrame, *names: str, **fit) -> Classifier:
    """Co-train on the labelled documents and all others; arguments as of ``cotrained``. It scores rows of ``with_features``."""
    classifier, _, word_weights = cotrained(documents, labels, *names, **fit)
    if classifier.text is not None:
        classifier.text.weights = word_weights
    return classifier


def cotrained(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", length: str = "n_chars", quality: str = "quality", toxic: str = "toxic", labelled: int = LABELLED, pseudo: int = PSEUDO, rounds: int = ROUNDS, keep_good: float = KEEP_GOOD) -> tuple[Classifier, DataFrame, dict[int, float] | None]:
    """The classifier, all documents with the chosen and weighed inputs that it scores, and the weights of these."""
    good = (F.coalesce(F.col(quality), F.lit(0)) == 1) & (F.coalesce(F.col(toxic), F.lit(0)) == 0)
    marked = labels.select(F.col(key).alias("id"), good.cast("double").alias("label")).filter("id IS NOT NULL")
    counts = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}  # at most two rows
    chosen = documents.select(F.col(key).alias("id"), key, text, source, lang, length) if key != "id" else documents.select(key, text, source, lang, length)
    names = _sample(marked, labelled, 1)
    # the sample is bounded, so its ids go to the documents: no text of another one is sent
    sampled = chosen.join(F.broadcast(names.select("id").distinct()), "id", "left_semi")
    known = with_features(sampled, key, text, source, lang, length).join(names, "id")
    known = _bounded(known.withColumns({"weight": F.lit(1.0), "held": F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(5)) == 0}))
    seen = {(r["held"], r["label"]) for r in known.groupBy("held", "label").count().collect()}  # at most four rows
    if len(seen) < 4:
        share = (counts.get(1.0, 0) + 1e-9) / (sum(counts.values()) + 2e-9)
        constant = Classifier(None, None, (max(-20.0, min(20.0, log(share / (1 - share)))), 0.0, 0.0))
        return constant, chosen.select("id"), None
    train, held = known.filter("NOT held").select("id", "text_view", "meta_view", "label", "weight"), known.filter("held")
    word_weights = _word_weights(train)
    # the chosen words only from here on: that makes a table of all documents small, which the rounds and the result read;
    # labels are looked up by id in what the rounds judge, so no text is sent
    rows_of_all = written(with_features(chosen, key, text, source, lang, length, word_weights))
    marks = written(marked.select("id").distinct())
    train, held = _bounded(_narrow(train, word_weights)), _bounded(_narrow(held, word_weights))
    extra: dict[str, DataFrame | None] = {"text_view": None, "meta_view": None}
    for round_ in range(rounds + 1):
        views = {}
        for column in ("text_view", "meta_view"):
            rows = train if extra[column] is None else _bounded(train.unionByName(extra[column]))
            views[column] = _calibrated(View(column, _fit(rows, column, None, 0.01)), held)
        if round_ == rounds:
            break
        judged = views["meta_view"].scored(views["text_view"].scored(rows_of_all))
        for teacher, learner in (("text_view", "meta_view"), ("meta_view", "text_view")):
            extra[learner] = _pseudo_labelled(judged, f"{teacher}_odds", pseudo, marks)
    both = views["meta_view"].scored(views["text_view"].scored(held))
    margins = np.array(both.select("text_view_odds", "meta_view_odds", "label").collect(), float)
    weights = _regression(margins, 2)
    good_odds = (weights[0] + margins[:, :2] @ np.array(weights[1:]))[margins[:, 2] == 1]
    kept_from = min(0.0, float(np.quantile(good_odds, 1 - keep_good)))
    return Classifier(views["text_view"], views["meta_view"], tuple(weights), kept_from), rows_of_all, word_weights


def scored(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", length: str = "n_chars", **fit) -> DataFrame:
    """Per row: ``id``, the views' calibrated probabilities, ``score`` (probability of good) and ``kept``."""
    classifier, rows, _ = cotrained(documents, labels, key, text, source, lang, length, **fit)
    probability = lambda c: 1 / (1 + F.exp(-F.col(c)))
    out = classifier.scored(rows)
    return out.select(
        "id", probability("text_odds").alias("text_score"), probability("meta_odds").alias("meta_score"), probability("odds").alias("score"),
        (F.col("odds") >= classifier.kept_from).alias("kept"),
    )
