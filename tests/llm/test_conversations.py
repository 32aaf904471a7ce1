"""Repair of conversations against a plain reading of its rules."""

import hashlib
import random
import re
import zlib

import pytest

from prefspark.llm import conversation_repair as module
from prefspark.llm.conversation_repair import cheapest, damage, damaged_and_repaired, repair_conversations

SCHEMA = "conv_id long, turn long, role string, text string, audit string, _part string, cost string"
LAW = re.compile("(s?(ua)+)?")


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if kind:
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            out += [(c, t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    return out


def walk(rows, marks):
    """Least (cost, audit) and its rows, by rows read and state, with every path's string kept."""
    due = lambda q: "assistant" if q == "u" else "user"
    may = lambda q, r: r[:1] == "s" and q == "" or r[:1] == "u" and q != "u" or r[:1] == "a" and q == "u"
    def inserted(now):
        for _ in range(2):
            for q, (cost, audit, kept) in list(now.items()):
                better(now, due(q)[0], (cost + 5, audit + "I", [*kept, (due(q), "")]))
        return now
    def better(now, q, value):
        if q not in now or value[:2] < now[q][:2]:
            now[q] = value
    now = inserted({"": (0, "", [])})
    for (_, _, r, x), mark in zip(rows, marks):
        then = {}
        for q, (cost, audit, kept) in now.items():
            better(then, q, (cost + 2, audit + "D", kept))
            if mark in "t":
                extra = 5 * (mark == "t")
                if may(q, r):
                    better(then, r[0], (cost + extra, audit + "K", [*kept, (r, x)]))
                better(then, due(q)[0], (cost + 1 + extra, audit + "R", [*kept, (due(q), x)]))
        now = inserted(then)
    return min((now[q] for q in ("", "a") if q in now), key=lambda v: v[:2])


def plain(rows, original):
    out = []
    for conv in dict.fromkeys(original):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        marks, seen = [], set()
        for _, _, r, x in mine:
            end = re.sub("[ \t-\r]+$", "", x)
            marks.append("b" if not end else "d" if (r, x) in seen else "t" if end[-1] not in ".!?" else "")
            seen.add((r, x))
        turns = [t for _, t, _, _ in mine if t is not None]
        initials = [r[:1] for _, _, r, _ in mine]
        cost, audit, kept = walk(mine, marks)
        assert LAW.fullmatch("".join(r[0] for r, _ in kept))
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, marks.count("b"), marks.count("d"),
            marks.count("t"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def table(seed, n=60, longest=9):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "usr"]
    texts = ["Yes.", "No!", "why", "Why? ", " \n", "", None, "é. \x0b", "e\x85", "e.\x85", "e.\xa0", "...", "well.\n"]
    rows = []
    for c in range(n):
        conv = None if c == 7 else c
        for t in range(rng.randint(1, longest)):
            good = rng.random() < 0.6
            role = ["user", "assistant"][t % 2] if good else rng.choice(roles)
            text = f"turn {t}." if good else rng.choice(texts)
            turn = None if rng.random() < 0.1 else t + 2 * (rng.random() < 0.2)
            rows += [(conv, turn, role, text)] * (2 if rng.random() < 0.05 else 1)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)


def answers(df):
    return sorted((tuple(r)[:9] for r in df.collect()), key=str)


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 7), (3, 40)])
def test_equals_plain_reading(spark, seed, parts):
    rows = table(seed)
    random.Random(seed).shuffle(rows)
    want = plain(damaged(rows), [r[0] for r in rows])
    assert answers(damaged_and_repaired(frame(spark, rows), parts=parts)) == want
    assert sorted(map(tuple, damage(frame(spark, rows)).collect()), key=str) == sorted(damaged(rows), key=str)


def test_hot_conversation_over_many_partitions(spark):
    rng = random.Random(6)
    rows = [(5, i // 3, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", f"b{i}", f"c{i}.", " "])) for i in range(700)]
    rows += table(4, 6)
    got = repair_conversations(frame(spark, [r for r in rows if None not in r]), parts=12, keep_rows=True).collect()
    rows = [r for r in rows if None not in r]
    want = plain(rows, [r[0] for r in rows])
    assert sorted((tuple(r)[:9] for r in got), key=str) == want
    for r in got:
        text = "\n".join(f"{x.role}:{x.text}" for x in r.repaired)
        assert hashlib.sha256(text.encode()).hexdigest() == r.repaired_sha256


def test_pieces_of_any_size(monkeypatch):
    import pyarrow as pa

    rng = random.Random(8)
    rows = sorted((c, t, rng.choice(["user", "assistant"]), "x" * rng.randint(0, 9)) for c in range(9) for t in range(rng.randint(1, 30)))
    columns = ["conv_id", "turn", "role", "text"]
    monkeypatch.setattr(module, "PIECE_ROWS", 7)
    monkeypatch.setattr(module, "PIECE_BYTES", 20)
    batches = [pa.RecordBatch.from_pylist([dict(zip(columns, r)) for r in rows[i : i + 11]]) for i in range(0, len(rows), 11)]
    got = list(module._pieces(iter(batches)))
    assert [(c, t, r, x) for c, _, *parts, _ in got for t, r, x in zip(*parts)] == rows
    assert all(len(p[2]) <= 8 for p in got)
    assert [p[1] for p in got] == list(range(1, len(got) + 1))
    counts = {c: sum(p[0] == c for p in got) for c in range(9)}
    assert all(p[5] == (counts[p[0]] == 1 and p[0] not in (0, 8)) for p in got)


def test_both_heaps_find_the_least_audit():
    rng = random.Random(9)
    for _ in range(400):
        n = rng.randint(0, 9)
        roles = [rng.choice(["user", "assistant", "system", "x"]) for _ in range(n)]
        marks = [rng.choice(["", "", "t", "b"]) for _ in range(n)]
        rows = [(0, i, r, "t") for i, r in enumerate(roles)]
        got = cheapest(module._Lattice(roles, marks, True), module.START, (module.START, module.ASSISTANT))
        assert got == walk(rows, marks)[:2]


def test_empty_table(spark):
    assert damaged_and_repaired(frame(spark, [])).count() == 0
    assert repair_conversations(frame(spark, []), keep_rows=True).count() == 0
