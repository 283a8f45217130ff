"""Quality rules by weak supervision.

Each rule looks at one property of a text and votes good, bad, or abstains. No rule
decides alone: expectation-maximisation over the votes of all documents estimates
how often each rule is right on good and on bad texts, and the posterior
probability of good quality replaces all-must-pass filtering.

Votes are counted per pattern before the estimate: R rules have at most 3 ** R
patterns, whatever the corpus, so the estimate works on a bounded table.

All expressions run in the JVM. Properties are computed once per text and written
to the shared folder; estimate and verdict read them from there.

Defined cases: a NULL or empty text has no words, fails the base rule and is
rejected; repeated rows are judged alike, row by row; ids may be NULL or repeat; a table
without a single document that passes the base rule gets the rules' majority; other
columns pass through :func:`kept_documents` unchanged.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, functions as F

from marquee.llm.expressions import NO_SPACE, duplicate_lines, let, repeated_words, words_of
from marquee.llm.shared import written

#: (rule, property, bad from, good up to): votes bad above the first bound, good up to the
#: second, abstains between; with bounds in falling order, the other way round.
RULES = [
    ("symbols", "n_symbols / n_words", 0.20, 0.03),
    ("symbol density", "n_symbols / word_chars", 0.03, 0.006),
    ("wordless marks", "n_letterless / n_words", 0.25, 0.08),
    ("capitals", "n_capitals / word_chars", 0.30, 0.12),
    ("repeated windows", "n_repeat_words / n_words", 0.30, 0.12),
    ("vocabulary", "n_distinct_words / sqrt(n_words)", 3.5, 6.0),
    ("word length", "abs(word_chars - 5.5 * n_words) / n_words", 4.0, 2.0),
    ("double marks", "n_double_marks / n_words", 0.10, 0.02),
    ("sentences", "n_stops / n_words", 0.005, 0.02),
    ("repeated lines", "n_dup_lines / n_lines", 0.30, 0.10),
]
ROUNDS = 50
PRIOR_WEIGHT = 1.0


def properties(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Counts per text: the base rule's and those that the rules read."""
    source = documents.select(F.col(key).alias("id"), F.xxhash64(F.lit(1), key, text).alias("__row1"), F.xxhash64(F.lit(2), text, key).alias("__row2"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = let(
        words_of(F.col("text")),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct_words"),
        ),
    )
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("bigint")
    return source.select(
        "id", "__row1", "__row2", words.alias("words"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"),
        count(rf"(?m)^.*{NO_SPACE}").alias("n_lines"),
        count(r"\p{Lu}").alias("n_capitals"),
        count(r"([!?*#$%&|])\1").alias("n_double_marks"),
        count(r"[.!?](?=\s|$)").alias("n_stops"),
        count(r"(?<!\S)[^\p{L}\s]+(?!\S)").alias("n_letterless"),
    ).select("id", "__row1", "__row2", "words.*", "n_symbols", "n_dup_lines", "n_lines", "n_capitals", "n_double_marks", "n_stops", "n_letterless")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vote(measure: str, bad: float, good: float) -> Column:
    """1 good, 0 bad, NULL no vote."""
    above, below = measure.split(" / ")
    x = F.expr(f"{above} / nullif({below}, 0)")
    if bad > good:
        return F.when(x > bad, 0).when(x <= good, 1)
    return F.when(x < bad, 0).when(x >= good, 1)


def votes() -> dict[str, Column]:
    return {f"vote{i}": vote(measure, bad, good) for i, (_, measure, bad, good) in enumerate(RULES)}


def estimate(patterns: list[tuple[list[int | None], int]], rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """Expectation-maximisation over vote patterns and their counts.

    Returns the share of good documents and per rule (right on good, right on bad). It
    starts from the majority of votes; one document's weight of a fair rule smooths each share.
    """
    n_rules = len(RULES)
    total = sum(n for _, n in patterns)
    good = []
    for votes_, _ in patterns:
        cast = [v for v in votes_ if v is not None]
        good.append((sum(cast) + 0.5) / (len(cast) + 1))
    share, right = 0.5, [(0.7, 0.7)] * n_rules
    for _ in range(rounds if total else 0):
        share = (sum(p * n for p, (_, n) in zip(good, patterns)) + PRIOR_WEIGHT) / (total + 2 * PRIOR_WEIGHT)
        right = []
        for r in range(n_rules):
            cast = [(p, n, v[r]) for p, (v, n) in zip(good, patterns) if v[r] is not None]
            on_good, on_bad = sum(p * n for p, n, _ in cast), sum((1 - p) * n for p, n, _ in cast)
            hit_good, hit_bad = sum(p * n for p, n, v in cast if v == 1), sum((1 - p) * n for p, n, v in cast if v == 0)
            right.append(((hit_good + PRIOR_WEIGHT) / (on_good + 2 * PRIOR_WEIGHT), (hit_bad + PRIOR_WEIGHT) / (on_bad + 2 * PRIOR_WEIGHT)))
        good = [1 / (1 + exp(-max(-500.0, min(500.0, log_odds(v, share, right))))) for v, _ in patterns]
    return share, right


def log_odds(cast: list[int | None], share: float, right: list[tuple[float, float]]) -> float:
    out = log(share / (1 - share))
    for v, (on_good, on_bad) in zip(cast, right):
        if v is not None:
            out += log(on_good / (1 - on_bad)) if v else log((1 - on_good) / on_bad)
    return out


def judged(documents: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: id, row hash, properties, ``base_failed``, ``posterior`` of good quality, and ``kept``."""
    rows = written(properties(documents, key, text))
    rows = rows.withColumn("base_failed", base_failed())
    names = [f"vote{i}" for i in range(len(RULES))]
    voted = rows.withColumns(votes())
    counts = voted.filter(~F.col("base_failed")).groupBy(*names).agg(F.count("*").alias("n")).collect()  # at most 3 ** rules rows
    share, right = estimate([([r[name] for name in names], r["n"]) for r in counts])
    odds = F.lit(log(share / (1 - share)))
    for name, (on_good, on_bad) in zip(names, right):
        odds += F.when(F.col(name) == 1, log(on_good / (1 - on_bad))).when(F.col(name) == 0, log((1 - on_good) / on_bad)).otherwise(0.0)
    posterior = 1 / (1 + F.exp(-odds))
    return voted.withColumn("posterior", posterior).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def kept_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``documents`` without those that the rules reject."""
    kept = judged(documents, key, text, threshold).filter("kept").select("__row1", "__row2").distinct()
    marked = documents.withColumns({"__row1": F.xxhash64(F.lit(1), key, text), "__row2": F.xxhash64(F.lit(2), text, key)})
    return marked.join(kept, ["__row1", "__row2"], "left_semi").drop("__row1", "__row2")
