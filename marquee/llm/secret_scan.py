"""Secret scan with a random forest behind the candidate patterns.

Patterns find words that may be or hold a secret: values assigned to telling names (in
the same word, or of six characters or more in the word after the name), keys
with a known prefix, and long runs of key characters. Most long runs are no secrets, so
a forest judges every candidate by its length, the character classes and the
transitions between them, how much of it the corpus's dictionary covers, the path
(source) it stands in, and the words beside it.

The forest is trained on labelled findings. ``labelled_findings`` gives a starting set:
candidates that only a secret can explain (known prefix, value of a telling name) are
true, and candidates that the dictionary or a plain address explains are false. What
names or prefixes a candidate matched is not among the forest's inputs, so it has to learn
what secrets look like; reviewed findings can be passed instead or besides.

Training reads about ``FINDINGS`` labelled findings: a sample by hash of each label, half of them
secrets or all secrets if there are fewer, with weights that restore the labels' shares. The dictionary is counted
over all documents; it keeps every letter word that stands in ``KNOWN_FROM`` of them or more, whatever
their number. Letters inside a key or an address are no word: chance would make them known in
a large table. Candidates and verdicts cover every document, whole.

All expressions and the forest run in the JVM.

Defined cases: NULL and empty texts have no candidates; a candidate is one word, however
long; equal candidates in one text are findings of their own; rows with equal id are scanned row by
row; a NULL path is a path of its own; labels of one class only leave every candidate
its share of true labels; an empty table gives no findings; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from marquee.llm.expressions import NO_SPACE, SPACE, words_of
from marquee.llm.shared import PARTS, label_shares, written

FINDINGS = 20_000
#: Documents that a word of the dictionary stands in at least.
KNOWN_FROM = 2
TREES, DEPTH, SEED = 30, 8, 7
NEIGHBOURS, PATHS = 64, 16

#: Names whose values are secrets, prefixes of issued keys, and runs of key characters.
NAMES = r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)"
ISSUED = r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{8,})"
RUN = r"[\p{L}\p{N}+/_=.@-]{16,}"
CANDIDATE = rf"{RUN}|{NAMES[4:]}[\"']?[=:]\S{{6,}}"
#: Letters that are not part of a key, an address or a name with digits.
WORD = r"(?<![\p{L}\p{N}+/_=@])\p{L}{3,}(?![\p{L}\p{N}+/_=@])"
_ASSIGNED = rf"{NAMES}[\"']?[=:]+[\"']?\S{{6,}}$"
_NAME_ONLY = rf"^[\"'(\[{{]*{NAMES}[\"']?[=:]*$"
#: A text with a telling name as a word and a value of six characters behind it.
_NAME_AND_VALUE = rf"(?:^|{SPACE})[\"'(\[{{]*{NAMES}[\"']?[=:]*{SPACE}+(?:[=:]+{SPACE}+)?{NO_SPACE}{{6,}}"
#: Characters from which a value behind a name without ``=`` or ``:`` is a sure label.
SURE = 16


def dictionary(documents: DataFrame, text: str, known_from: int = KNOWN_FROM) -> DataFrame:
    """All words of three letters or more, lower-cased, that ``known_from`` documents or more hold."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0)))
    counted = documents.select(F.explode(words).alias("word")).groupBy("word").count()
    return counted.filter(F.col("count") >= known_from).select("word")


def candidates(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """``id``, ``path``, ``at`` (number of the word), ``candidate`` and two words on either side."""
    rows = documents.select(F.col(key).alias("id"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.filter(F.col("text").rlike(f"(?i){CANDIDATE}") | F.col("text").rlike(_NAME_AND_VALUE))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("w", words_of(F.col("text"))).drop("text")

    def at(w: Column) -> Column:
        side = lambda i: F.coalesce(F.get("w", i), F.lit(""))
        behind = lambda x, i: _named(side(i - 1), side(i - 2)) & (F.length(_value(x)) >= 6)
        places = F.transform(w, lambda x, i: F.when(x.rlike(f"(?i){CANDIDATE}") | behind(x, i), i))
        return F.transform(F.array_compact(places), lambda i: F.struct(
            i.alias("at"), side(i).alias("candidate"), *(side(i + k).alias(name) for name, k in (("before2", -2), ("before", -1), ("after", 1), ("after2", 2))),
        ))

    return rows.select("id", "path", "row", F.explode(at(F.col("w"))).alias("found")).select("id", "path", "row", "found.*")


def _value(candidate: Column) -> Column:
    """The candidate without quotes and a leading name."""
    bare = F.regexp_replace(candidate, r"^[\"'(\[{<]+|[\"')\]}>.,;:!?]+$", "")
    return F.regexp_replace(bare, rf"^{NAMES}[\"']?[=:]+[\"']?", "")


def _named(before: Column, before2: Column) -> Column:
    """Whether the words before are a telling name, or one and its ``=`` or ``:``."""
    return before.rlike(_NAME_ONLY) | (before.rlike("^[=:]+$") & before2.rlike(_NAME_ONLY))


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with ``features``; the dictionary is joined to the letter runs of the candidates."""
    value = _value(F.col("candidate"))
    found = found.withColumn("value", value)
    runs = found.select("row", "at", F.explode(F.regexp_extract_all(F.lower("value"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    # letters per known word; a run counts if it is a word or begins with one of six letters
    known = runs.join(words.withColumn("known", F.lit(1)), "word", "left")
    stems = words.filter(F.length("word") >= 6).select(F.substring("word", 1, 6).alias("stem")).distinct().withColumn("stem_known", F.lit(1))
    known = known.withColumn("stem", F.substring("word", 1, 6)).join(stems, "stem", "left")
    weight = F.when(F.col("known") == 1, 1.0).when(F.col("stem_known") == 1, 0.5).otherwise(0.0)
    covered = known.groupBy("row", "at").agg(F.sum(weight * F.length("word")).alias("letters_known"), F.max(F.length("word")).alias("longest_word"))
    found = found.join(covered, ["row", "at"], "left").fillna(0, ["letters_known", "longest_word"])
    n = F.greatest(F.length("value"), F.lit(1)).cast("double")
    count = lambda pattern: F.regexp_count("value", F.lit(pattern)).cast("double")
    numbers = {
        "f_length": F.least(n, F.lit(200.0)),
        "f_digits": count(r"\p{N}") / n,
        "f_upper": count(r"\p{Lu}") / n,
        "f_lower": count(r"\p{Ll}") / n,
        "f_hex": count(r"[0-9a-f]") / n,
        "f_marks": count(r"[^\p{L}\p{N}]") / n,
        "f_not_ascii": count(r"[^\x00-\x7F]") / n,
        "f_digit_letter": count(r"\p{N}(?=\p{L})") / n,
        "f_letter_digit": count(r"\p{L}(?=\p{N})") / n,
        "f_case": count(r"\p{Ll}(?=\p{Lu})") / n,
        "f_repeats": count(r"(.)(?=\1)") / n,
        "f_distinct": F.size(F.array_distinct(F.split("value", ""))) / n,
        "f_vowels": count(r"(?i)[aeiouyäöüéèêóíñ]") / n,
        "f_covered": F.col("letters_known") / n,
        "f_longest": F.col("longest_word") / n,
        "f_at_sign": count("@"),
        "f_dots": F.least(count(r"\."), F.lit(5.0)),
        "f_quoted": F.col("candidate").rlike(r"^[\"']").cast("double"),
        "f_equals": (F.col("candidate").contains("=") | F.col("before").rlike("[=:]$")).cast("double"),
    }
    near = F.array(*(F.concat(F.lit(f"{c}:"), F.lower(F.substring(c, 1, 12))) for c in ("before2", "before", "after", "after2")))
    found = found.withColumns(numbers).withColumns({"near": near, "paths": F.array(F.concat(F.lit("path:"), F.col("path")))})
    found = HashingTF(numFeatures=NEIGHBOURS, binary=True, inputCol="near", outputCol="near_view").transform(found)
    found = HashingTF(numFeatures=PATHS, binary=True, inputCol="paths", outputCol="path_view").transform(found)
    found = VectorAssembler(inputCols=[*numbers, "near_view", "path_view"], outputCol="features", handleInvalid="keep").transform(found)
    return found.withColumn("covered", F.col("f_covered")).drop("near", "near_view", "paths", "path_view", "letters_known", "longest_word", *numbers)


def labelled_findings(found: DataFrame) -> DataFrame:
    """Findings whose label is beyond doubt: ``row``, ``at``, ``label``."""
    issued = F.col("value").rlike(f"^{ISSUED}$")
    # a short word behind a bare name may be prose: the forest judges it
    sure = F.col("before").rlike("[=:]$") | (F.length("value") >= SURE)
    named = F.col("candidate").rlike(_ASSIGNED) | (_named(F.col("before"), F.col("before2")) & sure)
    address = F.col("value").rlike(r"^[^@]+@[^@]+\.\p{L}{2,}$|^https?:|^www\.")
    letters = F.col("value").rlike(r"^[\p{L}.,'-]+$")
    label = F.when(issued | (named & ~letters), 1.0).when(address | letters | (F.col("covered") >= 0.8), 0.0)
    return found.withColumn("label", label).filter("label IS NOT NULL").select("row", "at", "label")


def fit_sample(marked: DataFrame, total: dict[float, int], findings: int) -> DataFrame:
    """About ``findings`` rows of ``marked``, both labels among them, with the ``weight`` that restores the share of their label."""
    shares = label_shares(total, findings)
    while True:
        # chosen by the candidate: copies of one finding weigh what they weigh in the whole
        share = F.when(F.col("label") == 1, F.lit(shares[1.0])).otherwise(F.lit(shares[0.0]))
        sample = marked.filter(F.pmod(F.xxhash64("candidate", "row", "at"), F.lit(PARTS)) < share)
        sample = written(sample.select("features", "label").orderBy("row", "at"))
        drawn = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}  # at most two rows
        if len(drawn) == len(total):
            break
        # a small bound can miss a label by chance
        shares = {label: n if label in drawn else min(PARTS, 2 * n) for label, n in shares.items()}
    rows, chosen = sum(total.values()), sum(drawn.values())
    weights = {label: total[label] / drawn[label] * chosen / rows for label in total}
    return sample.withColumn("weight", F.when(F.col("label") == 1, F.lit(weights[1.0])).otherwise(F.lit(weights[0.0])))


def scanned(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source", labels: DataFrame | None = None, findings: int = FINDINGS, threshold: float = 0.5) -> DataFrame:
    """Every candidate with the forest's ``probability`` and ``is_secret``.

    ``labels`` (``candidate``, ``label`` 0/1) are reviewed findings; without them the starting set is used.
    """
    words = written(dictionary(documents, text))
    found = written(features(written(candidates(documents, key, text, path)), words))
    if labels is None:
        marked = found.join(labelled_findings(found), ["row", "at"])
    else:
        marked = found.join(labels.select("candidate", F.col("label").cast("double").alias("label")).dropDuplicates(["candidate"]), "candidate")
    marked = written(marked.select("row", "at", "candidate", "features", "label"))
    total = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}  # at most two rows
    if len(total) < 2:
        out = found.withColumn("probability", F.lit(1.0 if 1.0 in total else 0.0))
    else:
        sample = fit_sample(marked, total, findings)
        forest = RandomForestClassifier(
            numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label", weightCol="weight", predictionCol="", rawPredictionCol=""
        )
        model = forest.fit(sample.coalesce(4))
        out = model.setProbabilityCol("__p").transform(found).withColumn("probability", vector_to_array("__p")[1])
    return out.select(
        "id", "path", "at", "candidate", F.length("candidate").alias("length"), "before", "after", "probability", (F.col("probability") >= threshold).alias("is_secret"),
    )
