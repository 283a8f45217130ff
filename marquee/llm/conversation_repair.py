"""Conversation structure repair: the cheapest edits that make roles alternate.

A repaired conversation's role initials are ``(s?(ua)+)?``. Each row is kept (cost 0), given
another role (2) or deleted (3; the only choice for a blank or repeated row); an empty turn
may be inserted anywhere (2); a truncated row that stays adds 1. Of the cheapest repairs
the one whose edit initials (D, I, K, R) are least in ASCII order is taken.

The rows of a conversation go through a Viterbi trellis of four states: nothing written yet,
a system turn, a user turn, an assistant turn. Every survivor is the end of a path in one
tree of backpointers whose nodes count their references; a path that no survivor
uses any more is released at once. Two tied paths are compared from their common ancestor on,
over the whole of what is still open. Once all survivors descend from one node, the
edits up to it are certain: they are emitted and forgotten, with their rows. So a conversation
streams through its task, and memory holds what is undecided, not the conversation.
Survivors that can no longer win, as another one is cheaper by more than the way from
one state to the other costs, are dropped; ties are never dropped.

Comparing survivors by state is exact: two equally dear paths over the same rows hold equally many
letters for rows, and a path that merely goes on where the other ends has paid for another insertion.

Spark deals the rows by conversation and sorts them by turn; the sort spills, the trellis
streams. A repeat (same role and text earlier in the conversation) is found by a window over the
same partitions, not by a set in Python.

Defined cases: rows without a turn come first; rows of one turn are ordered by role and text; NULL
role or text is one space; NULL conversations form one; a role without any character has no
initial, is illegal beside any other and cannot be kept; a text of any length is read once and held
while its row is undecided; a row marked ``absent`` only names its conversation, and one
with no other rows gives zeros and empty texts; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marquee.llm.shared import partitions, small_batches, written

#: Costs of the edits, and of a truncated row that stays.
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
#: Undecided edits at which the common ancestor of the survivors is first looked for.
OPEN = 16

SPACES = " \t\n\v\f\r"
ENDS = ".!?"
#: States: nothing written yet, system turn, user turn, assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The turn that may follow each state.
_TO = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_NAMES = {USER: "user", ASSISTANT: "assistant"}


class Node:
    """One edit on a path, its predecessor, and how many nodes and survivors refer to it."""

    __slots__ = ("parent", "edit", "depth", "refs")

    def __init__(self, parent: Node | None, edit: str) -> None:
        self.parent, self.edit, self.refs = parent, edit, 0
        self.depth = 0 if parent is None else parent.depth + 1
        if parent is not None:
            parent.refs += 1


def _release(node: Node | None) -> None:
    """Drop a reference; paths that nothing refers to are taken down."""
    while node is not None:
        node.refs -= 1
        if node.refs:
            return
        node.parent, node = None, node.parent


def _earlier(a: Node, b: Node) -> bool:
    """Whether path ``a`` is least in ASCII order: both are read back to their common ancestor."""
    left, right = [], []
    while a is not b:
        if a.depth >= b.depth:
            left.append(a.edit)
            a = a.parent
        else:
            right.append(b.edit)
            b = b.parent
    return left[::-1] < right[::-1]


class Trellis:
    """Survivors of one conversation; ``emit`` gets each certain edit, in order."""

    def __init__(self, emit: Callable[[str], None]) -> None:
        self.emit = emit
        self.root = Node(None, "")
        self.root.refs = 2  # held by the trellis, and a survivor
        self.costs: dict[int, int] = {START: 0}
        self.nodes: dict[int, Node] = {START: self.root}
        self.limit = OPEN
        self.most_open = 0
        self._insert(self.costs, self.nodes)

    @staticmethod
    def _offer(costs: dict, nodes: dict, state: int, cost: int, parent: Node, edit: str) -> None:
        """A path into a state of the next column; the cheaper one, or the least of two tied ones, stays."""
        best = costs.get(state)
        if best is not None and best < cost:
            return
        node = Node(parent, edit)
        if best == cost and not _earlier(node, nodes[state]):
            node.refs = 1
            _release(node)
            return
        node.refs = 1
        if best is not None:
            _release(nodes[state])
        costs[state], nodes[state] = cost, node

    def _insert(self, costs: dict, nodes: dict) -> None:
        for state in (START, SYSTEM, ASSISTANT, USER):
            if state in costs:
                self._offer(costs, nodes, _TO[state], costs[state] + INSERT, nodes[state], "I")

    def row(self, initial: str, must_go: bool, truncated: bool) -> None:
        """The next column of the trellis."""
        costs: dict[int, int] = {}
        nodes: dict[int, Node] = {}
        extra = TRUNCATED if truncated else 0
        for state, cost in self.costs.items():
            node = self.nodes[state]
            self._offer(costs, nodes, state, cost + DELETE, node, "D")
            if must_go:
                continue
            to = _TO[state]
            if initial == "ua"[to - USER]:
                self._offer(costs, nodes, to, cost + extra, node, "K")
            elif initial == "s" and state == START:
                self._offer(costs, nodes, SYSTEM, cost + extra, node, "K")
            self._offer(costs, nodes, to, cost + REROLE + extra, node, "R")
        self._insert(costs, nodes)
        best = costs[ASSISTANT]
        for state, way in ((START, DELETE), (SYSTEM, 0)):
            if costs.get(state, best) > best + way:
                _release(nodes.pop(state))
                del costs[state]
        for node in self.nodes.values():
            _release(node)
        self.costs, self.nodes = costs, nodes
        still = max(n.depth for n in nodes.values()) - self.root.depth
        self.most_open = max(self.most_open, still)
        if still >= self.limit:
            self._coalesce(nodes[ASSISTANT])
            self.limit = max(OPEN, 2 * (max(n.depth for n in nodes.values()) - self.root.depth))

    def _coalesce(self, survivor: Node) -> None:
        """Emit the edits up to the last node that all survivors descend from."""
        path = []
        while survivor is not self.root:
            path.append(survivor)
            survivor = survivor.parent
        # The root is held once by the trellis; one more reference is its only child.
        while path and self.root.refs == 2:
            self._advance(path.pop())

    def _advance(self, child: Node) -> None:
        self.emit(child.edit)
        child.refs += 1
        child.parent = None
        self.root = child

    def end(self) -> int:
        """Emit the rest of the best path; its cost."""
        state = ASSISTANT
        if START in self.costs:
            kept, empty = (self.costs[ASSISTANT], self.nodes[ASSISTANT]), (self.costs[START], self.nodes[START])
            if empty[0] < kept[0] or (empty[0] == kept[0] and _earlier(empty[1], kept[1])):
                state = START
        path, node = [], self.nodes[state]
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self.emit(node.edit)
        return self.costs[state]


class Conversation:
    """Counts and repair of one conversation, row by row; ``turn_out`` gets every repaired turn as (edit, role, text)."""

    def __init__(self, turn_out: Callable[[str, str, str], None]) -> None:
        self.turn_out = turn_out
        self.rows: deque[tuple[str, str]] = deque()
        self.audit: list[str] = []
        self.state = START
        self.least = self.most = self.last_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: str | None = None
        self.trellis = Trellis(self._edit)

    def row(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        if turn is not None:
            if turn != self.last_turn:
                self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = self.last_turn = turn
        solid = text.strip(SPACES)
        blank = not solid
        duplicate = not blank and repeated
        truncated = not blank and not duplicate and solid[-1] not in ENDS
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        self.rows.append((role, text))
        self.trellis.row(initial, blank or duplicate, truncated)

    def _edit(self, edit: str) -> None:
        self.audit.append(edit)
        role, text = ("", "") if edit == "I" else self.rows.popleft()
        if edit == "D":
            return
        if edit == "K" and role[:1] == "s":
            self.state = SYSTEM
        else:
            self.state = _TO[self.state]
        self.turn_out(edit, role if edit == "K" else _NAMES[self.state], text)

    def end(self) -> dict:
        cost = self.trellis.end()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        counts = {c: getattr(self, c) for c in ("blank", "duplicate", "truncated", "illegal")}
        return {"gaps": gaps, **counts, "cost": cost, "audit": "".join(self.audit)}


def _conversations(batches: Iterator[pa.RecordBatch], start: Callable[[object], Conversation], done: Callable[[object, Conversation], None]):
    """Runs sorted rows through one conversation after another; yields after each batch."""
    open_, now = None, None
    for batch in batches:
        for conv, turn, role, text, absent, repeated in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if open_ is None or conv != now:
                if open_ is not None:
                    done(now, open_)
                open_, now = start(conv), conv
            if not absent:
                open_.row(turn, role, text, repeated)
        yield
    if open_ is not None:
        done(now, open_)
    yield


def _in_order(rows: DataFrame, conv: Column, turn: Column, role: Column, text: Column, absent: Column | None) -> DataFrame:
    """Rows dealt by conversation, repeats marked, sorted."""
    spark = rows.sparkSession
    source = rows.select(
        conv.alias("conv"), turn.cast("bigint").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"),
        (F.lit(False) if absent is None else F.coalesce(absent, F.lit(False))).alias("absent"),
    ).repartition(partitions(spark), "conv")
    alike = Window.partitionBy("conv", "absent", F.xxhash64("role", "text"), "role", "text").orderBy(F.asc_nulls_first("turn"))
    marked = source.withColumn("repeated", F.row_number().over(alike) > 1)
    return marked.sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text", "repeated")


def repaired_turns(rows: DataFrame, conv: Column, turn: Column, role: Column, text: Column, absent: Column | None = None) -> DataFrame:
    """The repaired conversations, a row per turn: ``conv``, ``place`` (from 0), ``edit``, ``role``, ``text``."""
    source = _in_order(rows, conv, turn, role, text, absent)
    kind = source.schema["conv"].dataType
    types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def start(key):
            places = iter(range(1 << 62))
            return Conversation(lambda *turn_: out.append((key, next(places), *turn_)))

        for _ in _conversations(batches, start, lambda _, c: c.end()):
            for some in _chunks(out):
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*some), types)], names=["conv", "place", "edit", "role", "text"])
            out.clear()

    return source.mapInArrow(run, f"conv {kind.simpleString()}, place bigint, edit string, role string, text string")


def _chunks(rows: list, size: int = 1000) -> Iterator[list]:
    for start in range(0, len(rows), size):
        yield rows[start : start + size]


_DIGESTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repair_digests(rows: DataFrame, conv: Column, turn: Column, role: Column, text: Column, absent: Column | None = None) -> DataFrame:
    """Per conversation: faults counted, cost, audit, and the digest of what :func:`repaired_turns` gives, made in the task."""
    source = _in_order(rows, conv, turn, role, text, absent)
    kind = source.schema["conv"].dataType
    names = ["conv", *_DIGESTS]
    types = [to_arrow_type(kind), *[pa.int64()] * 6, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []

        class Digested(Conversation):
            def __init__(self) -> None:
                self.digest, self.any = sha256(), False
                super().__init__(self.add)

            def add(self, _, role_: str, text_: str) -> None:
                self.digest.update(f"{chr(10) if self.any else ''}{role_}:{text_}".encode())
                self.any = True

        def done(key, c):
            out.append({"conv": key, **c.end(), "repaired_sha256": c.digest.hexdigest()})

        for _ in _conversations(batches, lambda _: Digested(), done):
            for some in _chunks(out):
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in some], t) for c, t in zip(names, types)], names=names)
            out.clear()

    kinds = ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'bigint'}" for c in _DIGESTS)
    with small_batches(rows.sparkSession):
        return written(source.mapInArrow(run, f"conv {kind.simpleString()}, {kinds}"))


def damaged(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Conversations with planted faults, by the checksum of ``conv:turn`` modulo 20.

    0 drops the row (it stays as ``absent``), 1 empties its text, 2 removes its sentence ends, 3 repeats
    it, 4 makes it the user's; NULLs are one space, but a NULL turn stays one.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(word(conv), F.lit(":"), word(turn)).cast("binary")) % 20
    said = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    return (
        rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), word(role).alias("role"), word(text).alias("text"), fault.alias("fault"))
        .withColumn("text", said)
        .withColumn("role", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")))
        .withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select("conv", "turn", "role", "text", (F.col("fault") == 0).alias("absent"))
    )
