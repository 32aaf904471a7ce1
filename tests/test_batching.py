"""Packing: worked examples, invariants and a naive reading of each rule."""

import heapq
import random
import time

import pytest
from pyspark.sql import functions as F

from prefspark.operators import batching as B


def lengths_of(seed, n, high=60):
    rng = random.Random(seed)
    return [rng.randrange(1, high) for _ in range(n)]


def frame(spark, steps):
    rows, position = [], 0
    for step, lengths in steps.items():
        for x in lengths:
            rows.append((step, position, x))
            position += 1
    rng = random.Random(1)
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "step long, position long, total_length long").repartition(5)


def test_first_fit_example():
    assert B.first_fit_count([5, 3, 7, 2, 6], 10) == 3
    assert B.first_fit_count([50], 10) == 1
    assert B.first_fit_count([], 10) == 0


@pytest.mark.parametrize("seed", range(5))
def test_first_fit_against_a_plain_scan(seed):
    lengths = lengths_of(seed, 80)
    bins = []
    for x in lengths:
        slot = next((i for i, load in enumerate(bins) if load + x <= 64), None)
        if slot is None:
            bins.append(x)
        else:
            bins[slot] += x
    assert B.first_fit_count(lengths, 64) == len(bins)


def differencing_by_hand(lengths, k):
    """Textbook k-way differencing: merge the two widest tuples until one is left; totals only."""
    heap = []
    for i, x in enumerate(lengths):
        bins = [x] + [0] * (k - 1)
        heapq.heappush(heap, (-(bins[0] - bins[-1]), i, bins))
    count = len(lengths)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = sorted((x + y for x, y in zip(a, reversed(b))), reverse=True)
        heapq.heappush(heap, (-(merged[0] - merged[-1]), count, merged))
        count += 1
    return heap[0][2]


@pytest.mark.parametrize("seed,n,k", [(0, 16, 4), (1, 33, 5), (2, 64, 8), (3, 8, 8), (4, 9, 2)])
def test_differencing_split(seed, n, k):
    # distinct lengths leave no tie for the order of merging to decide
    lengths = random.Random(seed).sample(range(1, 10_000), n)
    parts = B.differencing_split(lengths, k)
    assert sorted(i for p in parts for i in p) == list(range(n))
    assert all(parts) and all(p == sorted(p) for p in parts)
    assert sorted((sum(lengths[i] for i in p) for p in parts), reverse=True) == differencing_by_hand(lengths, k)


@pytest.mark.parametrize("seed", range(3))
def test_equal_size_split(seed):
    lengths = lengths_of(seed, 48)
    parts = B.differencing_split(lengths, 6, equal_size=True)
    assert [len(p) for p in parts] == [8] * 6
    assert sorted(i for p in parts for i in p) == list(range(48))
    with pytest.raises(ValueError, match="equal parts"):
        B.differencing_split(lengths, 7, equal_size=True)


def test_small_cases_of_the_split():
    assert B.differencing_split([3], 1) == [[0]]
    assert sorted(B.differencing_split([5, 5], 2)) == [[0], [1]]
    # the four largest differ pairwise: 8+5 against 7+6
    assert sorted(sum([8, 7, 6, 5][i] for i in p) for p in B.differencing_split([8, 7, 6, 5], 2)) == [13, 13]
    with pytest.raises(ValueError, match="cannot split"):
        B.differencing_split([1], 2)


def test_greedy_split_follows_input_order():
    assert B.greedy_split([5, 1, 1, 1], 2) == [[0], [1, 2, 3]]
    assert B.greedy_split([5, 1, 1, 1], 2, equal_size=True) == [[0, 3], [1, 2]]


def test_operators_run_per_step(spark):
    steps = {s: lengths_of(s, 24 + 8 * s) for s in range(6)}
    df = frame(spark, steps)
    start = {}
    for s, x in steps.items():
        start[s] = sum(len(steps[t]) for t in steps if t < s)
    parts = {(r.step, r.position - start[r.step]): r.part for r in B.balanced_partitions(df, 4).collect()}
    greedy = {(r.step, r.position - start[r.step]): r.part for r in B.greedy_partitions(df, 4).collect()}
    counts = {r.step: r.num_batches for r in B.first_fit_batches(df, 50, ring=2).collect()}
    for s, x in steps.items():
        for j, members in enumerate(B.differencing_split(x, 4)):
            assert all(parts[s, i] == j for i in members)
        for j, members in enumerate(B.greedy_split(x, 4)):
            assert all(greedy[s, i] == j for i in members)
        assert counts[s] == B.first_fit_count(x, 100)


def test_dynamic_micro_batches(spark):
    rng = random.Random(3)
    rows = [(p % 2, p // 20, p, rng.randrange(1, 50)) for p in range(120)]
    df = spark.createDataFrame(rows, "rank long, step long, position long, total_length long")
    out = B.dynamic_micro_batches(df, 60).collect()
    assert len(out) == 120
    for step in range(6):
        need = max(B.first_fit_count([x for r, s, _, x in rows if (r, s) == (rank, step)], 60) for rank in (0, 1))
        for rank in (0, 1):
            mine = [r for r in out if (r.rank, r.step) == (rank, step)]
            sizes = {}
            for r in mine:
                sizes[r.micro_batch] = sizes.get(r.micro_batch, 0) + 1
            assert sorted(sizes) == list(range(need))
            for r in mine:
                assert r.loss_scale == sizes[r.micro_batch] / len(mine)
                assert r.optimizer_step == int(r.micro_batch == need - 1)


def test_rollout_micro_batches(spark):
    steps = {0: lengths_of(1, 40), 1: [1] * 8}
    out = B.rollout_micro_batches(frame(spark, steps), 4, max_tokens=70).collect()
    for step, x in steps.items():
        k = max(B.first_fit_count(x, 70) // 4 * 4, 4)
        mine = [r for r in out if r.step == step]
        totals = {}
        for r in mine:
            totals[r.micro_batch] = totals.get(r.micro_batch, 0) + r.total_length
        assert sorted(totals) == list(range(k))
        assert all(r.tokens == totals[r.micro_batch] for r in mine)


def test_snake_example(spark):
    df = spark.createDataFrame([(i, 8 - i) for i in range(8)], "position long, total_length int")
    out = B.snake_balance(df, 2).orderBy("worker", "turn").collect()
    assert [[r.total_length for r in out if r.worker == w] for w in (0, 1)] == [[8, 1, 6, 3], [7, 2, 5, 4]]


@pytest.mark.parametrize("n,workers", [(7, 3), (9, 2), (5, 4), (3, 5), (12, 3)])
def test_snake_against_chunk_lists(spark, n, workers):
    order = list(range(n, 0, -1))
    chunks = [order[i : i + workers] for i in range(0, n, workers)]
    half = len(chunks) // 2
    long, short = chunks[:half], [c[::-1] for c in chunks[half:]]
    dealt = []
    while long or short:
        if long:
            dealt.append(long.pop(0))
        dealt.append(short.pop())
    want = [list(w) for w in zip(*dealt)]
    df = spark.createDataFrame([(i, n - i) for i in range(n)], "position long, total_length int")
    out = B.snake_balance(df, workers).orderBy("worker", "turn").collect()
    got = [[r.total_length for r in out if r.worker == w] for w in range(len(want))]
    assert got == want and len(out) == sum(map(len, want))
    assert B.snake_balance(df, workers, drop_ragged=False).count() == n


def test_balance_report(spark):
    steps = {0: [9, 1, 1, 1, 1, 1, 1], 1: [4, 3, 2, 1]}
    df = frame(spark, steps)
    rows = {r.step: r for r in B.seqlen_balance_report(B.balanced_partitions(df, 2), 2).collect()}
    # seven samples in chunks of three: 11, 3 and a last chunk of 1
    assert (rows[0]["min"], rows[0]["max"], rows[0]["minmax_diff"], rows[0]["mean"]) == (1, 11, 10, 7.5)
    assert (rows[0].balanced_min, rows[0].balanced_max) == (6, 9)
    assert (rows[1]["min"], rows[1]["max"], rows[1].balanced_min, rows[1].balanced_max) == (3, 7, 5, 5)


def test_large_step_takes_no_quadratic_work():
    rng = random.Random(1)
    lengths = [rng.randint(1, 2000) for _ in range(150_000)]
    start = time.process_time()
    bins = B.first_fit_count(lengths, 16_192)
    parts = B.differencing_split(lengths, bins)
    assert time.process_time() - start < 60
    totals = [sum(lengths[i] for i in p) for p in parts]
    assert sorted(i for p in parts for i in p) == list(range(150_000)) and max(totals) - min(totals) <= 2000


def test_concat_and_split_round_trip(spark):
    df = spark.range(10).select(F.col("id").alias("position"), F.expr("sequence(0, CAST(id % 3 AS INT))").alias("ids"))
    packed = B.concat_samples(df, {"ids": -1}, 4)
    first = packed.where("batch = 0").first()
    assert first.ids == [[0, -1, -1], [0, 1, -1], [0, 1, 2], [0, -1, -1]]
    back = B.split_batches(packed, ["position", "ids"])
    assert sorted(r.position for r in back.collect()) == list(range(10))
    broken = packed.withColumn("ids", F.slice("ids", 1, 1))
    with pytest.raises(Exception, match="column ids has 1 samples"):
        B.split_batches(broken, ["position", "ids"]).collect()
