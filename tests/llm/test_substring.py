"""Substring deduplication against a plain reading of its rule."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from prefspark.llm.substring_dedup import _Block, repeated_passages, substring_dedup

SCHEMA = "doc_id long, text string, _block string, payload string, kept string"


def brute(rows, n):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    order = lambda i: (i is not None, i or 0)
    first = {}
    for i, w in docs:
        for s in range(len(w) - n + 1):
            key, here = tuple(w[s : s + n]), (order(i), s)
            first[key] = min(first.get(key, here), here)
    out = []
    for i, w in docs:
        gone = set()
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] < (order(i), s):
                gone.update(range(s, s + n))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


def texts(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijkl") * rng.randint(1, 3)
    passage = [[word() for _ in range(rng.randint(15, 70))] for _ in range(6)]
    out = [None, "", " \n\t ", "one two", "z " * 400, "y " * 19, "nul\x00 x\x85y\xa0z " * 9]
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += rng.choice(passage) if rng.random() < 0.5 else [word() for _ in range(rng.randint(1, 50))]
        out.append(rng.choice([" ", "\n", "  "]).join(parts))
    out += out[8:12] * 5
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("window,block_bytes", [(20, 1_500), (20, 1 << 20), (4, 3_000)])
def test_equals_brute_force(spark, window, block_bytes):
    found = texts(window)
    rows = [(i if i != 9 else None, t) for i, t in enumerate(found)]
    random.Random(1).shuffle(rows)
    got = substring_dedup(frame(spark, rows), window=window, keep_text=True, block_bytes=block_bytes).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, window)


def test_rows_of_one_id_are_one_document(spark):
    text = " ".join(map(str, range(50)))
    rows = [(1, text), (1, text), (1, "x y z " + text), (2, text)]
    got = substring_dedup(frame(spark, rows), keep_text=True, block_bytes=100).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 20)


def test_empty_table(spark):
    assert substring_dedup(frame(spark, [])).count() == 0
    assert repeated_passages(frame(spark, [])).count() == 0


def test_doubling_until_none_survives(spark):
    long = [f"w{i}" for i in range(150)]
    rows = [(1, " ".join(long)), (2, " ".join(["a", *long[:100], "b"])), (3, " ".join(["c", *long[30:75]])), (4, "u v " * 3)]
    want = set()
    for length in (20, 40, 80):
        seen = {}
        for i, t in rows:
            w = t.split()
            for s in range(len(w) - length + 1):
                seen.setdefault(tuple(w[s : s + length]), []).append((i, s))
        want |= {(i, s, length, (i, s) != v[0]) for v in seen.values() if len(v) > 1 for i, s in v}
    assert set(map(tuple, repeated_passages(frame(spark, rows), block_bytes=600).collect())) == want


def test_a_block_holds_little_for_each_word():
    rng = random.Random(3)
    found = [" ".join(str(rng.randrange(50_000)) for _ in range(1_000)) for _ in range(300)]
    table = pa.table({"doc_id": pa.array(range(300), pa.int64()), "text": pa.array(found, pa.string())})
    tracemalloc.start()
    block = _Block(table, 20)
    block.candidates(np.zeros(len(block.parts), np.uint8))
    removed, peak = block.removed(np.zeros(len(block.first), np.uint8)), tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(removed) == 300_000
    assert peak < 80 * len(removed)
