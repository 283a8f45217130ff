"""Chat formatting in budgeted windows.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and roles every run of
bars behind ``<`` gets one more bar, so a control string can only be the template's;
reading back takes it away again.

Long conversations are cut at turns. The prefix sum of turn tokens decides: turns
that begin within the same ``stretch`` tokens of the conversation make one window, so
its new turns cost at most ``stretch`` and one turn. Every later window begins with the
conversation's system turn and with up to ``history_turns`` turns before it that fit
``history_tokens``. Only the assistant texts among a window's new turns are targets;
repeated turns are outside the loss mask, so each assistant text is learned once.

Turns are numbered per stretch of ``_CHUNK`` turn numbers and the stretches are summed
up after, so a conversation with very many turns is spread over tasks like any other.

Defined cases: a NULL text or role is empty; turns are ordered by turn, role and text, NULL
turns first, and equal rows are turns of their own; a NULL conversation id is one
conversation; only a first turn with the role ``system`` is repeated; a turn longer than
the stretch is never cut; an empty table gives no windows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marquee.llm.expressions import let

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
STRETCH, HISTORY_TOKENS, HISTORY_TURNS = 512, 256, 3
_CHUNK = 256


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\|+)", r"<|$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|(\|+)", "<$1")


def formatted_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit(LINE))


def read_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit(LINE), F.lit("\n")))


def token_count(formatted: Column) -> Column:
    """Tokens of a formatted turn: a quarter of its UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(formatted) / 4)


def _numbered(conversations: DataFrame, conv: str, turn: str, role: str, text: str, stretch: int) -> DataFrame:
    """Turns with their number and their window in the conversation."""
    turns = conversations.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("c"), F.col(conv).alias("conv"),
        F.coalesce(F.col(turn).cast("bigint"), F.lit(-(1 << 62))).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    head = F.concat(F.lit(START), formatted_role(F.col("role")), F.lit("\n"))
    turns = turns.withColumns({"head": head, "body": escaped(F.col("text")), "chunk": F.floor(F.col("t") / _CHUNK)})
    turns = turns.withColumn("cost", token_count(F.concat("head", "body", F.lit(END + "\n"))))
    order = Window.partitionBy("c", "chunk").orderBy("t", "role", "text")
    turns = turns.withColumns({"at": F.row_number().over(order), "upto": F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    before = Window.partitionBy("c").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = turns.groupBy("c", "chunk").agg(F.count("*").alias("n"), F.sum("cost").alias("sum"))
    chunks = chunks.select("c", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("sum0"))
    turns = turns.join(chunks, ["c", "chunk"])
    begin = F.col("sum0") + F.col("upto") - F.col("cost")
    return turns.select(
        "c", "conv", "role", "head", "body", "cost",
        (F.col("n0") + F.col("at") - 1).alias("number"), begin.alias("begin"), F.floor(begin / stretch).alias("window"),
    )


def windows(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    stretch: int = STRETCH, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS,
) -> DataFrame:
    """One row per window: ``conv``, ``window``, ``text``, ``n_repeated`` (turns at its head that earlier windows have),
    ``tokens``, and ``loss`` (start and length of each target in code points)."""
    turns = _numbered(conversations, conv, turn, role, text, stretch)
    new = turns.withColumn("rank", F.lit(2))
    starts = turns.groupBy("c", "window").agg(F.min("number").alias("first"), F.min("begin").alias("from")).filter("first > 0")
    leads = turns.filter("number = 0 AND role = 'system'")
    system = leads.drop("window", "begin").join(starts.select("c", "window"), "c").withColumn("rank", F.lit(0))
    steps = F.explode(F.sequence(F.lit(1), F.lit(max(history_turns, 1))))
    wanted = starts.select("c", F.col("window").alias("into"), "from", "first", steps.alias("back"))
    wanted = wanted.select("c", "into", "from", (F.col("first") - F.col("back")).alias("number")).filter(F.lit(history_turns) > 0)
    history = turns.join(wanted, ["c", "number"]).filter(F.col("from") - F.col("begin") <= history_tokens)
    history = history.filter("NOT (number = 0 AND role = 'system')").drop("window", "begin", "from")
    history = history.withColumnRenamed("into", "window").withColumn("rank", F.lit(1))
    parts = new.drop("begin").unionByName(history).unionByName(system)
    target = (F.col("rank") == 2) & (F.col("role") == "assistant")
    piece = F.struct("rank", "number", "head", "body", target.alias("target"))
    grouped = parts.groupBy("c", "window").agg(F.first("conv").alias("conv"), F.sum("cost").alias("tokens"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    whole = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(done: Column, p: Column) -> Column:
        start, size = done["at"] + F.length(p["head"]), F.length(p["body"])
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct((start + size + len(END) + 1).alias("at"), F.when(p["target"], F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    return grouped.select(
        "conv", "window", whole.alias("text"), F.size(F.filter("pieces", lambda p: p["rank"] < 2)).alias("n_repeated"),
        "tokens", F.aggregate("pieces", none, step, lambda done: done["spans"]).alias("loss"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a window's text: array of (role, text)."""

    def turn(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(len(START) + 1), F.length(piece))
        return let(
            F.struct(inner.alias("s"), F.instr(inner, "\n").alias("n")),
            lambda x: F.struct(
                read_role(F.substring(x["s"], F.lit(1), x["n"] - 1)).alias("role"),
                unescaped(F.substring(x["s"], x["n"] + 1, F.length(x["s"]))).alias("text"),
            ),
        )

    return let(F.split(text, r"<\|im_end\|>\n"), lambda x: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), turn))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: turns as text, target texts joined, and sizes."""
    turns = let(read_turns(F.col("text")), lambda x: F.slice(x, F.col("n_repeated") + 1, F.greatest(F.size(x) - F.col("n_repeated"), F.lit(0))))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    targets = F.array_join(F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), s["start"] + 1, s["length"]))), "")
    rows = formatted.withColumn("turns", turns).select("conv", "window", F.length("text").alias("chars"), F.size("turns").alias("n"), joined.alias("turns"), targets.alias("targets"))
    in_order = lambda c: F.array_join(F.transform("rows", lambda r: r[c]), "")
    whole = rows.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("window", "turns", "targets"))).alias("rows"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars")
    )
    return whole.select("conv", "n_turns", in_order("turns").alias("turns"), in_order("targets").alias("targets"), "formatted_chars")
