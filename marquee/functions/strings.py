"""Text and array expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marquee.functions.columns import Name, as_column, has_text, text

# The English stop-word list that Spark ML ships.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom this "
    "that these those am is are was were be been being have has had having do does did doing a an "
    "the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very s t can will just don should now i'll you'll he'll she'll we'll "
    "they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've "
    "you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't "
    "wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's "
    "there's what's when's where's who's why's would"
).split()

# Fixed value: the separator between the items of a multi-value text.
ITEM_SEPARATOR = " | "
_PIPE = r"\s*\|\s*"
_PIPE_OR_COMMA = r"\s*\|\s*|\s*,\s*"


def clean(c: Name) -> Column:
    """Lower-case ASCII text: only a-z, 0-9, '-', '|' and single spaces are left.

    The runs of kept characters are taken out and joined, which the JVM does
    several times faster than replacing what lies between them.
    """
    runs = F.regexp_extract_all(F.lower(as_column(c)), F.lit(r"[a-z0-9|\-]+"), F.lit(0))
    return F.trim(F.regexp_replace(F.array_join(runs, " "), r" ?\| ?", ITEM_SEPARATOR))


def normalise_title(c: Name) -> Column:
    """Trim, lower, collapse every run of (Unicode) white space to one space."""
    folded = F.regexp_replace(F.lower(as_column(c)), r"(?U)\s+", " ")
    return F.trim(folded)


def items(c: Name, commas: bool = False) -> Column:
    """Trimmed non-empty items of a delimited text; blank and NULL give []."""
    parts = F.split(text(c), _PIPE_OR_COMMA if commas else _PIPE)
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def item_count(c: Name) -> Column:
    """Number of delimited items; blank gives 0, empty items in between count."""
    return F.when(has_text(c), F.size(F.split(as_column(c), _PIPE))).otherwise(0)


def join_items(c: Name, separator: str = ITEM_SEPARATOR) -> Column:
    return F.concat_ws(separator, as_column(c))


def tokens(c: Name, stop_words: bool = True) -> Column:
    """Lower-case word tokens of two or more characters, stop words removed."""
    words = F.split(F.lower(text(c)), r"\W+")
    if not stop_words:
        return F.filter(words, lambda w: F.length(w) >= 2)
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(STOP_WORDS))


def word_set(c: Name) -> Column:
    """Distinct lower-case words of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(text(c)), r"\s+"), lambda w: w != ""))


def jaccard(a: Name, b: Name) -> Column:
    """Jaccard overlap of the word sets of two texts; 0 when either is empty."""
    left, right = word_set(a), word_set(b)
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(
        F.size(F.array_intersect(left, right)) / F.size(F.array_union(left, right))
    )


def contains_any(value: Column, terms: Column) -> Column:
    """True when a non-blank term occurs in the value, or when there is none."""
    wanted = F.filter(terms, lambda t: F.trim(t) != "")
    hay = normalise_title(F.coalesce(value, F.lit("")))
    return (F.size(wanted) == 0) | F.exists(wanted, lambda t: F.contains(hay, normalise_title(t)))
