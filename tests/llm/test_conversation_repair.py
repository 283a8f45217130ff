import random
import re
from hashlib import sha256
from itertools import product
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from marquee.llm import conversation_repair as cr
from marquee.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv", "turn", "role", "text"]


def flags(rows):
    """(initial, must go, truncated) of (role, text) rows."""
    seen, out = set(), []
    for role, text in rows:
        solid = text.strip(" \t\n\v\f\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role[:1], fault))
    return out


def every_repair(rows):
    """All repairs with one insertion at most per gap (two where nothing is written yet): (cost, audit, turns)."""
    marks = flags(rows)
    choices = []
    for (initial, fault), (role, text) in zip(marks, rows):
        extra = fault == "truncated"
        some = [(3, "D", None)]
        if fault not in ("blank", "duplicate"):
            some += [(extra, "K", (initial, role, text))]
            some += [(2 + extra, "R", (n[0], n, text)) for n in ("user", "assistant")]
        choices.append(some)
    inserts = [(), (("u", "user", ""),), (("a", "assistant", ""),), (("u", "user", ""), ("a", "assistant", ""))]
    for gaps in product(inserts, repeat=len(rows) + 1):
        for picked in product(*choices):
            cost, audit, turns = 0, "", []
            for i, gap in enumerate(gaps):
                cost, audit, turns = cost + 2 * len(gap), audit + "I" * len(gap), turns + list(gap)
                if i < len(rows):
                    paid, edit, turn = picked[i]
                    cost, audit, turns = cost + paid, audit + edit, turns + ([turn] if turn else [])
            if re.fullmatch("(s?(ua)+)?", "".join(t[0] or "?" for t in turns)):
                yield cost, audit, [f"{t[1]}:{t[2]}" for t in turns]


def dynamic(rows):
    """The cheapest and least repair of any conversation, by a plain table over whole audits."""
    marks = flags(rows)
    best = {"": (0, "", [])}

    def offer(table, state, cost, audit, turns):
        if state not in table or (cost, audit) < table[state][:2]:
            table[state] = (cost, audit, turns)

    def close(table):
        for _ in range(3):
            for state, (cost, audit, turns) in list(table.items()):
                to = "a" if state == "u" else "u"
                offer(table, to, cost + 2, audit + "I", [*turns, ("user:" if to == "u" else "assistant:")])
        return table

    best = close(best)
    for (initial, fault), (role, text) in zip(marks, rows):
        extra, new = fault == "truncated", {}
        for state, (cost, audit, turns) in best.items():
            offer(new, state, cost + 3, audit + "D", turns)
            if fault in ("blank", "duplicate"):
                continue
            to = "a" if state == "u" else "u"
            if initial == to or (initial == "s" and state == ""):
                offer(new, initial, cost + extra, audit + "K", [*turns, f"{role}:{text}"])
            offer(new, to, cost + 2 + extra, audit + "R", [*turns, ("user:" if to == "u" else "assistant:") + text])
        best = close(new)
    return min(v for k, v in best.items() if k in ("", "a"))


def streamed(rows):
    out = []
    c = cr.Conversation(lambda edit, role, text: out.append(f"{role}:{text}"))
    seen = set()
    for i, (role, text) in enumerate(rows):
        c.row(i, role, text, (role, text) in seen)
        seen.add((role, text))
    found = c.end()
    return (found["cost"], found["audit"], out), c


def random_rows(rnd, most):
    texts = ["a.", "b", "", "c!", " ", "d?"]
    return [(rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", ""]), rnd.choice(texts) + rnd.choice(["", str(rnd.random())])) for _ in range(rnd.randint(0, most))]


def test_small_conversations_against_every_repair():
    rnd = random.Random(1)
    for _ in range(150):
        rows = random_rows(rnd, 3)
        assert streamed(rows)[0] == min(every_repair(rows)), rows


@pytest.mark.parametrize("open_", [1, 2, 16])
def test_longer_conversations_against_a_plain_table(monkeypatch, open_):
    monkeypatch.setattr(cr, "OPEN", open_)
    rnd = random.Random(open_)
    for _ in range(200):
        rows = random_rows(rnd, 60)
        assert streamed(rows)[0] == dynamic(rows), rows


def test_memory_stays_with_what_is_undecided():
    rnd = random.Random(4)
    rows = [(rnd.choice(["user", "assistant", "system", "tool"]), f"{i}" + rnd.choice([".", ""])) for i in range(20_000)]
    kept = []
    c = cr.Conversation(lambda edit, role, text: None)
    for i, (role, text) in enumerate(rows):
        c.row(i, role, text, False)
        kept.append(len(c.rows))
    assert max(kept) < 200 and c.trellis.most_open < 400


def test_released_paths_leave_one_tree():
    rnd = random.Random(5)
    trellis = cr.Trellis(lambda edit: None)
    for _ in range(300):
        trellis.row(rnd.choice("uas"), rnd.random() < 0.2, rnd.random() < 0.5)
        found = {}
        for node in trellis.nodes.values():
            found[id(node)] = found.get(id(node), 0) + 1
        seen, todo = set(), list(trellis.nodes.values())
        refs = {id(n): 0 for n in todo}
        every = {}
        while todo:
            node = todo.pop()
            if id(node) in seen:
                continue
            seen.add(id(node))
            every[id(node)] = node
            if node.parent is not None:
                refs[id(node.parent)] = refs.get(id(node.parent), 0) + 1
                todo.append(node.parent)
        for key, node in every.items():
            assert node.refs == refs.get(key, 0) + found.get(key, 0) + (node is trellis.root)


def brute(conversations):
    """Rows of the query in plain Python."""
    out = {}
    for conv in {c for c, *_ in conversations}:
        rows = []
        for _, turn, role, text in (r for r in conversations if r[0] == conv):
            fault = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            rows += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        said = [(r, t) for _, r, t in rows]
        marks = flags(said)
        turns = [t for t, *_ in rows if t is not None]
        cost, audit, written = dynamic(said)
        illegal = sum(marks[i][0] + marks[i + 1][0] not in ("su", "ua", "au") for i in range(len(marks) - 1))
        faults = [sum(m[1] == f for m in marks) for f in ("blank", "duplicate", "truncated")]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *faults, illegal, cost, audit, sha256("\n".join(written).encode()).hexdigest())
    return out


def got(spark, sf_of, conversations, **more):
    df = spark.createDataFrame(conversations, SCHEMA).withColumns({k: F.lit(v) for k, v in more.items()})
    rows = QUERIES["op12_conversation_repair"](spark, sf_of(conversations=df)).collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_against_plain_python(spark, sf_of):
    rnd = random.Random(7)
    texts = ["Yes.", "no", "é!", "", "\t\n"]
    conversations = [
        (
            conv,
            rnd.choice([turn, turn, turn + 1, None]),
            rnd.choice(["user", "assistant", "system", None, ""]),
            rnd.choice([None, " ", "no", rnd.choice(texts) + str(rnd.random()), rnd.choice(texts) + str(rnd.random())]),
        )
        for conv in [*range(60), None]
        for turn in range(rnd.randint(1, 12))
    ]
    assert got(spark, sf_of, conversations, copy=1, fault="x", absent=True, repeated=2) == brute(conversations)


def test_a_conversation_whose_rows_all_go(spark, sf_of):
    conv = next(c for c in range(1000) if crc32(f"{c}:0".encode()) % 20 == 0)
    assert got(spark, sf_of, [(conv, 0, "user", "Hello.")]) == {conv: (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())}


def test_a_long_conversation_and_a_long_text(spark, sf_of):
    conversations = [(5, t, "user" if t % 2 == 0 else "assistant", f"turn {t % 700}.") for t in range(5000)]
    conversations += [(6, 0, "user", "w" * 3_000_000), (6, 1, "assistant", "ok.")]
    assert got(spark, sf_of, conversations) == brute(conversations)


def test_empty_table(spark, sf_of):
    assert got(spark, sf_of, []) == {}


def test_repaired_turns_are_the_digested_ones(spark):
    rnd = random.Random(9)
    rows = [(c, t, *r) for c in range(30) for t, r in enumerate(random_rows(rnd, 20))]
    df = spark.createDataFrame(rows, "conv string, turn int, role string, text string")
    columns = [F.col(c) for c in COLUMNS]
    turns = {}
    for r in sorted(cr.repaired_turns(df, *columns).collect(), key=lambda r: (r.conv, r.place)):
        turns.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    for r in cr.repair_digests(df, *columns).collect():
        whole = turns.get(r.conv, [])
        assert sha256("\n".join(whole).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in whole))
