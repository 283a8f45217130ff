"""Posting tables of character n-grams: substring and similarity joins of short texts by equality.

Substring join. Every text is listed under its grams of one to three characters. A wanted text looks up
the rarest of its own grams and is checked against the texts listed there, so its work
follows the rarest gram and not the number of texts.

Similarity join. Two texts whose matching blocks cover a share ``percent`` of both lengths have at least
``ceil(percent * (a + b) / 200)`` characters in common. Characters are numbered per occurrence, so common
characters are common tokens. With tokens ordered from rare to frequent, two such texts share
a token among their first ``length - common + 1`` ones: only those are joined, on token and length. A pair
is made at the first token that both share, and at no other, so no pair is made twice.
What is left must also share enough pairs of neighbouring characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marquee.functions.columns import never_broadcast

#: Characters of the longest grams.
GRAM = 3


def grams(text: Column, size: Column | int) -> Column:
    """Distinct runs of ``size`` characters; none of a shorter text."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.length(text) - size + 1
    every = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: text.substr(i, size))
    return F.when(last >= 1, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def gram_postings(texts: DataFrame, name: str = "key") -> DataFrame:
    """(gram, ``name``): every distinct text under each of its grams of up to ``GRAM`` characters.

    ``texts`` holds each text once.
    """
    key = F.col(name)
    every = F.flatten(F.array(*(grams(key, n) for n in range(1, GRAM + 1))))
    return texts.select(name, F.explode(every).alias("gram"))


def rarest_grams(wanted: DataFrame, postings: DataFrame, name: str = "wanted") -> DataFrame:
    """(``name``, gram, listed): the gram of each wanted text that lists fewest texts; none if one of its grams lists no text."""
    text = F.col(name)
    own = wanted.select(name, F.explode(grams(text, F.least(F.length(text), F.lit(GRAM)))).alias("gram"))
    asked = own.select("gram").distinct()
    counts = postings.join(asked, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("listed"))
    rated = own.join(counts, "gram", "left").withColumn("listed", F.coalesce("listed", F.lit(0)))
    rarest = rated.groupBy(name).agg(F.min(F.struct("listed", "gram")).alias("least"))
    return rarest.filter(F.col("least.listed") > 0).select(name, "least.gram", "least.listed")


def containing(wanted: DataFrame, postings: DataFrame, name: str = "wanted", key: str = "key") -> DataFrame:
    """(``name``, ``key``): every text that contains a wanted text. ``wanted`` holds non-empty texts, each once."""
    listed = rarest_grams(wanted, postings, name).select(name, "gram").join(never_broadcast(postings), "gram")
    return listed.filter(F.contains(F.col(key), F.col(name))).select(name, key)


# -- similarity ---------------------------------------------------------------------------------------


def numbered(values: Column) -> Column:
    """The elements with the number of their occurrence, so that equal ones differ: the multiset as a set."""

    def one(ordered: Column) -> Column:
        return F.transform(ordered, lambda x, i: F.concat(x, (i - F.array_position(ordered, x) + 2).cast("string")))

    return F.transform(F.array(F.array_sort(values)), one)[0]


def _every(text: Column, size: int) -> Column:
    """All runs of ``size`` characters, repeats included."""
    last = F.length(text) - size + 1
    every = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: text.substr(i, F.lit(size)))
    return F.when(last >= 1, every).otherwise(F.array().cast("array<string>"))


def common_least(a: Column, b: Column, percent: int) -> Column:
    """Matched characters that two texts of these lengths need to reach the ratio, in whole numbers."""
    return F.floor((percent * (a + b) + 199) / 200).cast("int")


def length_bounds(size: Column, percent: int) -> tuple[Column, Column]:
    """Lengths of the texts that can reach the ratio with a text of ``size`` characters."""
    return F.ceil(size * percent / (200 - percent)).cast("int"), F.floor(size * (200 - percent) / percent).cast("int")


def _tokenised(texts: DataFrame, name: str) -> DataFrame:
    key = F.col(name)
    return texts.select(name, F.length(key).alias("size"), numbered(_every(key, 1)).alias("tokens"), numbered(_every(key, 2)).alias("pairs"))


def _rare_first(texts: DataFrame, frequency: DataFrame, name: str) -> DataFrame:
    """Tokens of each text from rare to frequent; a token no listed text has is the rarest."""
    single = texts.select(name, F.explode("tokens").alias("token")).join(frequency, "token", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")))
    listed = single.groupBy(name).agg(F.transform(order, lambda x: x["token"]).alias("tokens"))
    return texts.drop("tokens").join(never_broadcast(listed), name)


def similar_pairs(wanted: DataFrame, texts: DataFrame, percent: int, name: str = "wanted", key: str = "key") -> DataFrame:
    """(``name``, ``key``): all pairs that may reach a matching-blocks ratio of ``percent`` per cent.

    Both sides hold non-empty texts, each once. Nothing that reaches the ratio is missing: a pair is left
    out only if its lengths, its common characters or its common neighbours are too few for it.
    """
    left, right = _tokenised(wanted, name), _tokenised(texts, key)
    frequency = right.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    left, right = _rare_first(left, frequency, name), _rare_first(right, frequency, key)
    least, most = length_bounds(F.col("size"), percent)
    asked = left.select(name, F.col("size").alias("a"), F.col("tokens").alias("own"), F.col("pairs").alias("own_pairs"), F.explode(F.sequence(least, most)).alias("size"))
    first = F.slice("own", F.lit(1), F.greatest(F.col("a") - common_least(F.col("a"), F.col("size"), percent) + 1, F.lit(0)))
    asked = asked.select("*", F.posexplode(first).alias("at", "token"))
    # The prefix of a listed text is longest for the shortest text it can meet.
    shortest, _ = length_bounds(F.col("size"), percent)
    widest = F.greatest(F.col("size") - common_least(shortest, F.col("size"), percent) + 1, F.lit(0))
    listed = right.select(key, "size", "tokens", "pairs", F.posexplode(F.slice("tokens", F.lit(1), widest)).alias("place", "token"))
    met = asked.join(never_broadcast(listed), ["token", "size"])
    need = common_least(F.col("a"), F.col("size"), percent)
    shared = F.array_intersect("own", "tokens")
    together = F.size(F.array_intersect("own_pairs", "pairs"))
    return met.filter(
        (F.col("place") <= F.col("size") - need) & (F.get(shared, F.lit(0)) == F.col("token")) & (F.size(shared) >= need)
        & (together >= 3 * need - F.col("a") - F.col("size") - 1)
    ).select(name, key)


def lengths_met(wanted: DataFrame, texts: DataFrame, percent: int, name: str = "wanted", key: str = "key") -> DataFrame:
    """(``name``, in_length): how many texts have a length that can reach the ratio; what a join on lengths alone would compare."""
    sizes = texts.groupBy(F.length(key).alias("size")).agg(F.count("*").alias("n"))
    least, most = length_bounds(F.length(name), percent)
    asked = wanted.select(name, F.explode(F.sequence(least, most)).alias("size"))
    return asked.join(sizes, "size", "left").groupBy(name).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("in_length"))
