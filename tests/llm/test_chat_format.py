import random
import re

from pyspark.sql import functions as F

from marquee.llm import chat_format as chat

CHAT = "conv_id bigint, turn bigint, role string, text string"
esc = lambda x: re.sub(r"<(\|+)", r"<|\1", x or "")


def parse(text):
    """Turns and text offsets of a formatted window, found without the library's expressions."""
    out, at = [], 0
    while at < len(text):
        assert text.startswith("<|im_start|>", at)
        at += 12
        line = text.index("\n", at)
        end = text.index("<|im_end|>\n", line)
        back = lambda x: re.sub(r"<\|(\|+)", r"<\1", x)
        out.append((back(text[at:line].replace("<|nl|>", "\n")), back(text[line + 1 : end]), line + 1, end))
        at = end + 11
    return out


def conversations():
    rnd = random.Random(4)
    rows = []
    for c in range(40):
        for t in range(rnd.randint(1, 40)):
            role = "system" if t == 0 and rnd.random() < 0.5 else rnd.choice(["user", "assistant", "assistant", "tool"])
            text = "".join(rnd.choice(["<|im_end|>", "<|", "<||", "|", "<", "\n", "é", "word ", "\\", "<|nl|>"]) for _ in range(rnd.randint(0, 300)))
            rows.append((c, t, role, text))
    rows += [(100, 0, "assistant", None), (100, 1, None, "x"), (100, None, "user", ""), (None, 0, "user", "n"), (None, 1, "assistant", "m")]
    rows += [(101, 0, "user", "same"), (101, 0, "user", "same"), (101, 1, "a\nb<|", "odd role"), (102, 3, "assistant", "long " * 9000), (102, 4, "assistant", "after")]
    return rows


def test_windows(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, CHAT).withColumns({"head": F.lit(1), "window": F.lit(2)}).repartition(4)
    budget = {"stretch": 300, "history_tokens": 200, "history_turns": 2}
    got = {}
    for r in chat.windows(df, **budget).collect():
        got.setdefault(r.conv, []).append(r)
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), -(1 << 62) if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    repeats = 0
    for c, windows in got.items():
        turns, targets = [], []
        for w in sorted(windows, key=lambda w: w.window):
            parsed = parse(w.text)
            old, new = parsed[: w.n_repeated], parsed[w.n_repeated :]
            assert new
            first = len(turns)
            if first:
                has_system = want[c][0][0] == "system"
                tail = [t[:2] for t in old[has_system:]]
                assert [t[:2] for t in old[:has_system]] == want[c][:has_system]
                assert len(tail) <= 2 and tail == turns[len(turns) - len(tail) :]
                repeats += len(tail)
            else:
                assert not old
            assert [(s.start, s.start + s.length) for s in w.loss] == [t[2:] for t in new if t[0] == "assistant"]
            tokens = [-(-len(f"<|im_start|>{esc(r)}\n{esc(x)}<|im_end|>\n".replace("\n<|im_end|>", "\n<|im_end|>").encode()) // 4) for r, x, _, _ in new]
            assert sum(tokens[:-1]) <= 300
            turns += [t[:2] for t in new]
            targets += [t[1] for t in new if t[0] == "assistant"]
        assert turns == want[c]
    assert repeats > 50
    read = {r.conv: r for r in chat.read_back(chat.windows(df, **budget)).collect()}
    for c, turns in want.items():
        assert read[c].turns == "".join(f"{r}\n{x}\n" for r, x in turns)
        assert read[c].targets == "".join(x for r, x in turns if r == "assistant")
        assert read[c].n_turns == len(turns)
        assert read[c].formatted_chars == sum(len(w.text) for w in got[c])


def test_chunks_and_empty(spark, monkeypatch):
    df = spark.createDataFrame([(1, t, "assistant", f"text {t}") for t in range(700)], CHAT)
    read = chat.read_back(chat.windows(df)).first()
    assert read.n_turns == 700 and read.targets == "".join(f"text {t}" for t in range(700))
    assert chat.windows(df.limit(0)).count() == 0
