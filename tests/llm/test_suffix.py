"""Removal of long byte repeats against a plain reading of its rule."""

import hashlib
import random

import numpy as np
import pytest

from prefspark.llm import suffix_dedup as module
from prefspark.llm.suffix_dedup import suffix_dedup

SCHEMA = "doc_id long, text string, _block string, payload string, kept string"


def brute(rows, n):
    docs = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for _, d in docs:
        for s in range(len(d) - n + 1):
            seen[d[s : s + n]] = seen.get(d[s : s + n], 0) + 1
    out = []
    for i, d in docs:
        gone = [False] * len(d)
        for s in range(len(d) - n + 1):
            if seen[d[s : s + n]] > 1:
                gone[s : s + n] = [True] * n
        kept = bytes(b for b, g in zip(d, gone) if not g)
        starts = [k for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1])]
        ends = [k + 1 for k, g in enumerate(gone) if g and (k + 1 == len(d) or not gone[k + 1])]
        out.append((i, len(d), sum(gone), len(starts), hashlib.sha256(kept).hexdigest(), list(zip(starts, ends)), kept))
    return sorted(out, key=str)


def texts(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    run = lambda k: " ".join(word() for _ in range(k))
    passages = [run(rng.randint(30, 160)) for _ in range(5)]
    out = [None, "", " ", "q" * 199, "q" * 128, "z" * 900, "ab" * 300, "日本語" * 80, "x" * 200 + "y" + "x" * 200]
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 2)
            parts.append(rng.choice([p, p[cut:], p[: len(p) - cut], run(rng.randint(1, 60))]))
        out.append(rng.choice([" ", "", "\n"]).join(parts))
    return out + out[12:15] * 6


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], SCHEMA)


def answers(df):
    return sorted(
        ((*r[:5], [tuple(s) for s in r[5]], bytes(r[6])) for r in map(tuple, df.collect())), key=str
    )


@pytest.mark.parametrize("length,block_bytes,step", [(200, 1_500, 64), (128, 1 << 20, 1 << 16), (256, 4_000, 300)])
def test_equals_brute_force(spark, length, block_bytes, step, monkeypatch):
    monkeypatch.setattr(module, "_STEP", step)  # in this process only
    rows = [(i if i != 9 else None, t) for i, t in enumerate(texts(length))]
    random.Random(1).shuffle(rows)
    got = answers(suffix_dedup(frame(spark, rows), length=length, keep_bytes=True, block_bytes=block_bytes))
    assert got == brute(rows, length)


@pytest.mark.parametrize("step", [16, 100, 1 << 16])
def test_runs_cover_all_windows(step, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(module, "_STEP", step)
    found = texts(3, 10)
    block = module._Block(pa.table({"text": pa.chunked_array([pa.array(found, pa.string())])}), 200)
    want = []
    for a, b in zip(block.starts[:-1], block.starts[1:]):
        want += range(a, b - 199)
    got = [p for f, e in zip(block.first, block.last) for p in range(f, e + 1)]
    assert got == want
    assert all(e <= a <= f + 150 for f, e, a in zip(block.first, block.last, block.anchor))


def test_answers_do_not_depend_on_the_order_of_records():
    rng = np.random.default_rng(0)
    records = np.zeros(500, module.SPAN)
    for name in ("group", "a", "b"):
        records[name] = rng.integers(0, 4, 500)
    blocks = np.arange(500)
    want = module._rerank(records, blocks)
    mixed = rng.permutation(500)
    assert (module._rerank(records[mixed], blocks[mixed]) == want[mixed]).all()


def test_repeated_rows_and_one_id(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(1, text), (1, text), (2, text[:199]), (2, text[50:260] + "!"), (None, "a" + text), (None, "a" + text)]
    assert answers(suffix_dedup(frame(spark, rows), keep_bytes=True, block_bytes=300)) == brute(rows, 200)


def test_empty_table_and_lengths(spark):
    assert suffix_dedup(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup(frame(spark, []), length=100)
