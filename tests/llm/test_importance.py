"""Importance resampling against a plain reading of its rule."""

import hashlib
import math
import random
import re
import zlib

import pytest

from prefspark.llm import importance
from prefspark.llm.importance import cutoff, importance_weights, resample

SCHEMA = "doc_id long, text string, score string, rank string, _place string"


def runs(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(rows, target, percent=5, least=20):
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for b in runs(text)[1]:
                counts[b] += 1
    total, aim = sum(s) + 10000, sum(t) + 10000
    gain = [math.floor(1000 * math.log(((b + 1) * total) / ((a + 1) * aim))) for a, b in zip(s, t)]
    out = []
    for i, text in rows:
        n, found = runs(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[1], r[2]))
    for rank, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["Ab", "cd", "é", "x9", "-", "don't", "日本", "QQ", "z" * 90, "\x00", "a_b", "Ünder"]
    out = [None, "", " \n", "one", "y" * 400, "- ! ?"]
    while len(out) < n:
        out.append(rng.choice([" ", "\n", "--"]).join(rng.choice(words) for _ in range(rng.randint(1, 60))))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], SCHEMA)


def answers(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("percent", [5, 37, 100])
def test_equals_brute_force(spark, percent):
    rows = list(enumerate(texts(percent, 150)))
    rows += [(200 + i, rows[20][1]) for i in range(30)]  # copies
    rows += [(None, rows[30][1])] * 3 + [rows[40]] * 4  # no id, repeated rows
    random.Random(2).shuffle(rows)
    target = texts(7, 20)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = answers(resample(frame(spark, rows), aim, percent=percent))
    assert got == brute(rows, target, percent)


def test_long_texts_come_in_pieces(monkeypatch):
    found = [*texts(1, 30), "ab cd " * 500, "w" * 300 + " a b c"]
    monkeypatch.setattr(importance, "_STEP", 50)
    got = [[] for _ in found]
    words = [0] * len(found)
    for rows, buckets, of_word in importance.features(found):
        for r, b in zip(rows.tolist(), buckets.tolist()):
            got[r].append(b)
        for r in of_word.tolist():
            words[r] += 1
    assert [(n, sorted(g)) for n, g in zip(words, got)] == [(n, sorted(f)) for n, f in map(runs, found)]


def test_empty_tables(spark):
    rows = list(enumerate(texts(3, 40)))
    none = spark.createDataFrame([], "text string")
    assert answers(resample(frame(spark, rows), none)) == brute(rows, [])
    assert resample(frame(spark, []), none).count() == 0
    assert importance_weights(frame(spark, []), none).count() == 0


def test_bracket_widens_over_ties(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 5, 5, 5, 9]), i if i % 50 else None) for i in range(3_000)]
    df = spark.createDataFrame(rows, "score long, doc_id long")
    order = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1]))
    for k in (1, 2, 700, 1_500, 2_999, 3_000):
        assert cutoff(df, "score", "doc_id", k, len(rows), margin=1e-9) == order[k - 1]
