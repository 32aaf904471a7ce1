"""N-gram join against all pairs, the trie against set arithmetic, components against union-find."""

import cProfile
import pstats
import random

import numpy as np
import pyarrow as pa
import pytest

from prefspark.llm import common, ngram_join as module
from prefspark.llm.components import components
from prefspark.llm.ngram_join import gram_sets, linked_pairs, ngram_join, packed_grams, parity_sketches, parted, set_ids, unpacked_grams

SCHEMA = "doc_id long, text string, sid string, n string, slice string, payload string, root string"


def shingles(text, n=4):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))}


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if sets[x] and sets[y] and 100 * both >= percent * len(sets[x] | sets[y]):
                root[top(x)] = top(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[top(x)] = min(least.get(top(x), i), i)
    return sorted(((i, len(sets[x]), least.get(top(x))) for x, (i, _) in enumerate(rows)), key=str)


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeABC") for _ in range(rng.randint(1, 4)))
    common = [word() for _ in range(12)]
    out = [None, "", " \n ", "One", "one", "one two three", "a b c d", "A B C D", "x " * 3_000, "é É é É"]
    for _ in range(14):
        base = [word() for _ in range(rng.choice([5, 30, 60, 200]))]
        if rng.random() < 0.5:
            base += common
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return out + out[6:30:3]


@pytest.mark.parametrize("seed,block,chunk", [(1, 4_000, 200), (2, 1 << 20, 1 << 16)])
def test_equals_all_pairs(spark, seed, block, chunk):
    rows = [(i * 3 % 1_009 if i != 20 else None, t) for i, t in enumerate(texts(seed))]
    df = spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], SCHEMA)
    got = ngram_join(df, block_bytes=block, chunk_grams=chunk).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


@pytest.mark.parametrize("merged,parted_sets", [(0, 512), (4, 2), (0, 2), (10**6, 512)])
def test_equals_all_pairs_however_groups_are_joined(spark, monkeypatch, merged, parted_sets):
    monkeypatch.setattr(module, "MERGED", merged)
    monkeypatch.setattr(module, "PARTED", parted_sets)
    rows = list(enumerate(texts(3)))
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), chunk_grams=300).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_a_set_is_sent_once_and_only_if_it_may_link(spark, monkeypatch):
    """Sets that share rare n-grams by chance are not sent; those of a chain of near copies are sent once, not once a group."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    phrases = [" ".join(word() for _ in range(4)) for _ in range(30)]
    rows = []
    for _ in range(200):
        base = [word() for _ in range(120)]
        for at in range(10, 110, 20):
            base[at] = rng.choice(phrases)
        rows.append(" ".join(base))
    base = [word() for _ in range(200)]
    for i in range(25):
        base[8 * i] = word()
        rows.append(" ".join(base))
    rows += rows[-3:]
    seen = []

    def delivered(docs, dealt, n, was=module._delivered):
        seen.append((docs.count(), dealt.count()))
        return was(docs, dealt, n)

    monkeypatch.setattr(module, "_delivered", delivered)
    rows = list(enumerate(rows))
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert seen == [(25, 25)]


def test_sketches_part_no_sets_that_link():
    rng = np.random.default_rng(6)
    apart = 0
    for _ in range(300):
        base = rng.integers(0, 1 << 48, int(rng.integers(1, 900)), dtype=np.uint64)
        sets = []
        for _ in range(int(rng.integers(2, 9))):
            new = rng.integers(0, 1 << 48, len(base), dtype=np.uint64)
            sets.append(np.unique(np.where(rng.random(len(base)) < rng.choice([0, 0.04, 0.08, 0.2, 1]), new, base)[: max(1, int(len(base) * rng.choice([1, 0.9])))]))
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        sketches = parity_sketches(np.concatenate(sets), bounds)
        assert all(len(x) < 128 or len(x) // 2 < 8 * len(s) <= len(x) for s, x in zip(sketches, sets))
        parts = parted([len(x) for x in sets], sketches, 85)
        part_of = {x: k for k, part in enumerate(parts) for x in part}
        assert sum(map(len, parts)) == len(part_of) and min(map(len, parts), default=2) > 1
        for x in range(len(sets)):
            for y in range(x):
                if 100 * len(np.intersect1d(sets[x], sets[y])) >= 85 * len(np.union1d(sets[x], sets[y])):
                    assert part_of[x] == part_of[y]
                else:
                    apart += part_of.get(x, -1) != part_of.get(y, -2)
    assert apart > 1000


def test_empty_table_and_repeated_rows(spark):
    assert ngram_join(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (4, None), (4, None)]
    df = spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], SCHEMA)
    assert sorted(map(tuple, ngram_join(df).collect())) == [(4, 0, 4), (4, 0, 4), (5, 3, 5), (5, 3, 5)]


@pytest.mark.parametrize("n", [1, 3, 4])
@pytest.mark.parametrize("run_bytes", [1, 50, 1 << 18])
def test_sets_of_runs_equal_plain_sets(monkeypatch, n, run_bytes):
    monkeypatch.setattr("prefspark.llm.ngram_join.RUN_BYTES", run_bytes)
    odd = ["a\x00 a a\x00\x00 a", "\x1c\x85 \u3000\xa0", "ab", "c d", "c d", "AZ[@`{ \x08 \x0e", "\t\v\fx\r\n", "Ä ä", "longword " * 9]
    odd += ["w" * k + " " + "w" * k + "v" for k in (7, 8, 9, 16, 63, 64, 65, 200)]
    rows = odd + texts(5) + [None, "x y", ""]
    column = pa.array(["cut off", *rows, None]).slice(1, len(rows))
    runs = list(gram_sets(column, n))
    named = [tuple(i) for grams, bounds in runs for i in set_ids(grams, bounds)]
    hashes = [g[a:b].tolist() for g, bounds in runs for a, b in zip(bounds, bounds[1:])]
    want = [shingles(t, n) for t in rows]
    assert [len(set(x)) for x in hashes] == [len(x) for x in hashes] == [len(w) for w in want] == [size for _, size in named]
    assert all(x == sorted(x) for x in hashes)
    # The same shingle has the same hash in any text and run, and different ones have different hashes.
    for i in range(len(rows)):
        for j in range(i):
            assert len(set(hashes[i]) & set(hashes[j])) == len(want[i] & want[j])
            assert (named[i] == named[j]) == (want[i] == want[j])
    assert list(gram_sets(pa.array([], pa.string()), n)) == [] and len(list(gram_sets(pa.array([None], pa.string()), n))) == 1


def test_new_words_cost_no_call_each():
    """Most words of a large corpus are new to a task; hashing each by a call of its own took nearly half of the time of the sets."""
    column = pa.array([" ".join(f"w{i}x{j}" for j in range(500)) for i in range(100)])
    profile = cProfile.Profile()
    (grams, bounds), *_ = profile.runcall(lambda: list(gram_sets(column, 4)))
    assert np.diff(bounds).min() == 497
    assert pstats.Stats(profile).total_calls < 5_000


def test_sets_drop_the_cache_of_another_operator():
    cache = common.held("of another operator", list)
    list(gram_sets(pa.array(["a b"]), 4))
    assert common.held("of another operator", list) is not cache


def test_trie_equals_set_arithmetic():
    rng = np.random.default_rng(4)
    for _ in range(150):
        pool = int(rng.integers(3, 60))
        make = lambda: np.unique(rng.integers(0, pool, int(rng.integers(1, pool + 1))))
        index, probes = [make() for _ in range(12)], [make() for _ in range(9)]
        index += index[:3]
        percent = int(rng.choice([50, 85, 100]))
        want = {
            (p, q) for p, x in enumerate(probes) for q, y in enumerate(index)
            if 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y))
        }
        got = linked_pairs(index, probes, percent)
        assert len(got) == len(set(got)) and set(got) == want


def test_packed_sets_come_back():
    rng = np.random.default_rng(7)
    for n in (1, 2, 30, 900, 5_000):
        grams = np.unique(rng.integers(0, 1 << 48, n, dtype=np.uint64))
        for some in (grams, np.unique(np.append(grams, [0, (1 << 48) - 1, (1 << 40) - 1]).astype(np.uint64))):
            assert np.array_equal(unpacked_grams(packed_grams(some)), some)


def test_components(spark):
    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(40)] + [(7, 7)]
    pairs += [(rng.randint(300, 420), rng.randint(300, 420)) for _ in range(70)]
    root = {x: x for p in pairs for x in p}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in pairs:
        a, b = sorted((top(u), top(v)))
        root[b] = a
    got = {r.u: r.v for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: top(x) for x in root if top(x) != x}
