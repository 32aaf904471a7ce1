"""Interleaving by probability."""

import pytest
from pyspark.sql import functions as F

from prefspark.operators import blend as U


def sources(spark, sizes):
    return [spark.range(n).select(F.col("id"), F.lit(i).alias("origin")) for i, n in enumerate(sizes)]


@pytest.mark.parametrize("strategy", ["all_exhausted", "first_exhausted"])
def test_draws_follow_the_sources_in_order_and_stop_in_time(spark, strategy):
    sizes, probs = [200, 30, 10], [0.7, 0.2, 0.1]
    out = U.blend_interleave(sources(spark, sizes), ["id"], probs, 7, strategy).orderBy("draw").collect()
    assert [r.draw for r in out] == list(range(len(out)))
    seen, finished = [0, 0, 0], [None] * 3
    for r in out:
        assert r.source_ordinal == r.origin and r.id == seen[r.origin] % sizes[r.origin]
        seen[r.origin] += 1
        if seen[r.origin] == sizes[r.origin]:
            finished[r.origin] = r.draw
    ends = [f for f in finished if f is not None]
    if strategy == "all_exhausted":
        assert len(ends) == 3 and max(ends) == len(out) - 1
    else:
        assert ends == [len(out) - 1]


def test_proportions_and_seed(spark):
    def run(seed):
        out = U.blend_interleave(sources(spark, [3000, 1000]), ["id"], [0.75, 0.25], seed)
        return [r.source_ordinal for r in out.orderBy("draw").collect()]

    one = run(1)
    assert one == run(1) != run(2)
    assert abs(one.count(0) / len(one) - 0.75) < 0.03


def test_counts_do_not_depend_on_the_chunk(spark, monkeypatch):
    draws = U._draws(spark, [0.5, 0.5], 3, 5000)
    whole = sorted(map(tuple, U._occurrences(draws).collect()))
    monkeypatch.setattr(U, "_CHUNK", 64)
    assert sorted(map(tuple, U._occurrences(draws).collect())) == whole


def test_bad_arguments(spark):
    a, b = sources(spark, [2, 2])
    with pytest.raises(ValueError, match="one probability"):
        U.blend_interleave([a, b], ["id"], [1.0])
    with pytest.raises(ValueError, match="strategy"):
        U.blend_interleave([a, b], ["id"], [0.5, 0.5], strategy="x")
