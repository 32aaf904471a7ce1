"""Streams fed by several files give the batch result."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from prefspark.functions.tokens import WhitespaceTokenizer
from prefspark.operators.select import dynamic_batches
from prefspark.operators.trajectory import assemble_trajectory, trajectory_rollout_row
from prefspark.streaming import batches as SB
from prefspark.streaming import trajectories as ST

TOKENIZER = WhitespaceTokenizer()
START = datetime(2024, 1, 1)


def files(spark, rows, schema, path, n):
    """Rows in arrival order over ``n`` files that the stream reads one by one."""
    for i in range(n):
        part = rows[len(rows) * i // n : len(rows) * (i + 1) // n]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    return reader.parquet(path)


def samples(seed, prompts, n, round_groups):
    """Rounds of groups, a minute apart; some groups lack a sample."""
    rng = random.Random(seed)
    rows = []
    for p in range(prompts):
        at = START + timedelta(minutes=p // round_groups)
        rows += [(p, p * n + i, float(rng.random() < 0.5), at) for i in range(n) if rng.random() < 0.97]
    return rows


def plain_batches(rows, n, size):
    """Round by round, as a trainer takes them."""
    rounds = {}
    for p, position, score, at in sorted(rows, key=lambda r: r[1]):
        rounds.setdefault(at, {}).setdefault(p, []).append(score)
    out, held, seen, batch = [], [], 0, 0
    for at in sorted(rounds):
        for p, scores in rounds[at].items():
            seen += len(scores)
            if len(scores) == n and 1e-6 < sum(scores) / n < 1 - 1e-6:
                held.append(p)
        if len(held) >= size:
            rate = round(100 * n * len(held) / seen, 9)
            out += [(batch, p, rate) for p in held[:size]]
            held, seen, batch = [], 0, batch + 1
    return out


FLUSH = [(-1, -1, 0.0, datetime(2030, 1, 1))]  # lets the watermark pass


@pytest.mark.parametrize("size,round_groups,n", [(8, 5, 3), (3, 20, 2), (1, 1, 2), (40, 7, 4), (500, 3, 2)])
def test_batches_end_with_rounds(spark, size, round_groups, n):
    rows = samples(size, 240, n, round_groups)
    got = dynamic_batches(spark.createDataFrame(rows, SB.SAMPLE), n, size, round_groups=round_groups)
    found = sorted((r.batch, r.prompt_id, round(r.pass_rate, 9)) for r in got.collect())
    # Rounds by number of groups, not by time: a prompt without samples is none.
    order = {p: i for i, p in enumerate(dict.fromkeys(p for p, *_ in rows))}
    timed_ = [(p, q, s, START + timedelta(minutes=order[p] // round_groups)) for p, q, s, _ in rows]
    assert found == sorted(plain_batches(timed_, n, size))


def test_dynamic_batches_over_micro_batches(spark, tmp_path):
    rows = samples(5, 120, 3, 6)
    rng = random.Random(1)
    arrival = sorted(rows, key=lambda r: (r[1] // 40 + rng.randint(0, 1), rng.random()))
    arrival += rows[:0] + rng.sample(rows[-30:], 20)  # sent again
    stream = files(spark, arrival + FLUSH, SB.SAMPLE, f"{tmp_path}/in", 5)
    out = SB.run_dynamic_batches(stream, 3, 8, f"{tmp_path}/out", delay="10 minutes")
    got = sorted((r.batch, r.prompt_id, round(r.pass_rate, 9)) for r in out.collect())
    assert got == sorted(plain_batches(rows, 3, 8)) and len(got) >= 40
    places = {}
    for r in out.collect():
        places.setdefault(r.batch, []).append(r.place)
    assert all(sorted(p) == list(range(1, 9)) for p in places.values())
    # Another cut into files gives the same.
    stream = files(spark, arrival + FLUSH, SB.SAMPLE, f"{tmp_path}/in2", 2)
    out = SB.run_dynamic_batches(stream, 3, 8, f"{tmp_path}/out2", delay="10 minutes")
    assert sorted((r.batch, r.prompt_id, round(r.pass_rate, 9)) for r in out.collect()) == got
    seen = sum(1 for _ in rows)
    kept = {p for p, *_ in rows if 0 < sum(s for q, _, s, _ in rows if q == p) < 3 and sum(q == p for q, *_ in rows) == 3}
    assert SB.pass_rate(spark, f"{tmp_path}/out", 3) == pytest.approx(100 * 3 * len(kept) / seen)


def test_late_and_surplus_samples(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    rows = [
        [(1, 0, 0.0, at(0)), (1, 1, 1.0, at(0)), (2, 2, 1.0, at(0)), (3, 4, 0.0, at(0)), (3, 5, 1.0, at(0))],
        [(3, 6, 1.0, at(0)), (1, 1, 1.0, at(0)), (9, 20, 0.0, at(30))],  # 3 has a sample too many, 1 comes again
        [(2, 3, 0.0, at(0)), (9, 21, 1.0, at(30))],  # the other sample of 2 is too late
        FLUSH,
    ]
    for part in rows:
        spark.createDataFrame(part, SB.SAMPLE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = SB.run_dynamic_batches(spark.readStream.schema(SB.SAMPLE).parquet(f"{tmp_path}/in"), 2, 1, f"{tmp_path}/out")
    assert sorted((r.batch, r.place, r.prompt_id, r.pass_rate) for r in out.collect()) == [(0, 1, 1, pytest.approx(200 / 6)), (1, 1, 9, 100.0)]


def test_repeating_a_micro_batch_changes_nothing(spark, tmp_path):
    store = SB.batch_groups_of(str(tmp_path), 2, 4)

    def verdicts(start, n):
        return spark.range(start, start + n).selectExpr(
            "timestamp_seconds(id div 3) AS created", "id AS prompt_id", "id AS first_position", "2L AS n", "0.5D AS mean_score", "true AS kept"
        )

    for epoch, start, n in ((0, 0, 9), (1, 9, 0), (2, 9, 12), (2, 9, 12), (1, 9, 0), (0, 0, 9), (3, 21, 3)):
        store(verdicts(start, n), epoch)
    got = SB.emitted_batches(spark, str(tmp_path)).orderBy("batch", "place").collect()
    # rounds of three: a batch of four takes two rounds and loses two groups
    assert [r.prompt_id for r in got] == [6 * b + i for b in range(4) for i in range(4)]
    assert {r.pass_rate for r in got} == {100.0}


STEPS = (
    "episode_id long, step int, observation string, action_text string, environment_feedback string, "
    "reward double, score double, done boolean"
)


def episodes():
    rows = []
    for e in range(12):
        for s in range(5):
            score = None if (e + s) % 3 == 0 else float(s)
            rows.append((e, s, f"start {e} ", f"act {s} ", "" if s % 2 else f"see {s} ", 1.0 + s, score, s == 2 + e % 4))
    return rows


TIMED = STEPS + ", label string, extra_logs map<string,double>, action_log_probs array<double>, event_time timestamp"


def timed(row, seconds):
    logs, probs = {"k": float(row[1])}, [-float(row[1]), -0.5][: len(row[3].split())]
    return (*row, f"label {row[0]}", logs, probs, START + timedelta(seconds=seconds))


def run(spark, batches, folder, *args, **options):
    """Feed micro-batches one file each; what came out after all of them."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, TIMED).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        query = (
            ST.stream_trajectories(spark.readStream.schema(TIMED).parquet(f"{folder}/in"), TOKENIZER, *args, **options)
            .writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.schema(ST.RESULT).parquet(f"{folder}/out")


def test_trajectories_stream_equals_batch(spark, tmp_path):
    rows = [timed(r, 10 * r[0] + r[1]) for r in episodes()]
    arrival = sorted(rows, key=lambda r: random.Random(str(r[:2])).random())  # out of order within episodes
    arrival = [*arrival, *arrival[::3], *arrival[::2]]  # many steps are sent again, most after their episode has closed
    batches = [arrival[i::3] for i in range(2)] + [arrival[2::3] + arrival[5:9]]
    got = run(spark, batches, tmp_path, 4, 14)
    want = assemble_trajectory(spark.createDataFrame(rows, TIMED), TOKENIZER, 4, 14)
    columns = [c for c in want.columns]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.collect()))
    assert want.count() == 12 and got.where("complete").count() == 12
    assert [len(r.observation_tokens) for r in got.collect()] == [r.num_tokens for r in got.collect()]


def test_late_surplus_and_unfinished_episodes(spark, tmp_path):
    step = lambda e, s, t, done=False: timed((e, s, f"o{e} ", f"a{s} ", "", 1.0, None, done), t)
    options = {"delay": "10 seconds", "idle": timedelta(seconds=30), "forget": timedelta(seconds=60)}
    batches = [
        [step(1, 0, 0), step(1, 1, 1, True), step(2, 0, 0), step(3, 1, 2)],  # 1 is done, 2 open, 3 waits for its first
        [step(1, 0, 5), step(1, 2, 6), step(2, 1, 20), step(9, 0, 40, True)],  # 1 again and too far; 2 goes on
        [step(3, 0, 3), step(4, 0, 61, True)],  # 3 is behind the watermark of 30 by now
        [step(2, 2, 61), step(1, 0, 61)],  # 2 is given up at 50, so this changes nothing; nor does 1
        [step(5, 0, 300, True)],
        [step(1, 0, 301, True)],  # long after the mark of 1 has gone: a new episode
        [step(6, 0, 600, True)],
    ]
    out = sorted((r.episode_id, r.complete, r.num_steps, r.text) for r in run(spark, batches, tmp_path, 4, 99, **options).collect())
    assert out == [
        (1, True, 1, "o1 a0 "), (1, True, 2, "o1 a0 a1 "), (2, False, 2, "o2 a0 a1 "), (3, False, 0, ""),
        (4, True, 1, "o4 a0 "), (5, True, 1, "o5 a0 "), (6, True, 1, "o6 a0 "), (9, True, 1, "o9 a0 "),
    ]


@pytest.mark.parametrize("buckets", [1, 3, 4096])
def test_episodes_share_state_by_bucket(spark, tmp_path, buckets):
    """Open, waiting, given-up and closed episodes of one bucket do not touch each other."""
    step = lambda e, s, t, done=False: timed((e, s, f"o{e} ", f"a{s} ", f"f{t} ", 1.0, None, done), t)
    options = {"delay": "10 seconds", "idle": timedelta(seconds=30), "forget": timedelta(seconds=60), "buckets": buckets}
    batches = [
        [step(e, s, e % 5, s == 2) for e in range(40) for s in ((0, 1, 2) if e % 4 == 0 else (0, 2) if e % 4 == 1 else (2, 1) if e % 4 == 2 else (0,))],
        [step(e, 1, 20) for e in range(1, 40, 4)] + [step(e, 0, 21) for e in range(0, 40, 8)],  # 1 mod 4 closes, 0 mod 8 is sent again
        [step(e, 0, 22) for e in range(2, 20, 4)] + [step(99, 0, 43, True)],  # some of 2 mod 4 get their first step
        [step(98, 0, 44, True)],  # the watermark is 33: 3 mod 4 that were last heard of before 3 are given up; 0 mod 4 stays marked
        [step(e, 0, 62, True) for e in range(0, 40, 4)] + [step(97, 0, 300, True)],  # marks still hold
        [step(e, 0, 301, True) for e in range(0, 8)],  # all is forgotten: new episodes
        [step(96, 0, 600, True)],
    ]
    found = run(spark, batches, tmp_path, 4, 99, **options)
    out = sorted((r.episode_id, r.complete, r.num_steps, r.text) for r in found.collect())
    text = lambda e, *steps: f"o{e} " + "".join(f"a{s} f{t} " for s, t in steps)
    want = [(e, True, 1, text(e, (0, 43 + 99 - e if e > 97 else 300 if e == 97 else 600))) for e in (96, 97, 98, 99)]
    want[2:] = [(98, True, 1, text(98, (0, 44))), (99, True, 1, text(99, (0, 43)))]
    for e in range(40):
        t = e % 5
        kinds = [
            (True, 3, text(e, (0, t), (1, t), (2, t))),
            (True, 3, text(e, (0, t), (1, 20), (2, t))),
            (True, 3, text(e, (0, 22), (1, t), (2, t))) if e < 20 else (False, 0, ""),
            (False, 1, text(e, (0, t))),
        ]
        want.append((e, *kinds[e % 4]))
    want += [(e, True, 1, text(e, (0, 301))) for e in range(8)]
    assert out == sorted(want)


def test_a_deadline_at_the_watermark_has_passed(spark, tmp_path):
    step = lambda e, s, t, done=False: timed((e, s, f"o{e} ", f"a{s} ", "", 1.0, None, done), t)
    options = {"delay": "10 seconds", "idle": timedelta(seconds=30), "forget": timedelta(seconds=60), "buckets": 1}
    batches = [[step(1, 0, 0), step(2, 0, 1)], [step(99, 0, 40, True)], [step(1, 1, 35), step(2, 1, 35)], [step(98, 0, 500, True)]]
    out = sorted((r.episode_id, r.complete, r.num_steps) for r in run(spark, batches, tmp_path, 4, 99, **options).collect())
    assert out == [(1, False, 1), (2, False, 2), (98, True, 1), (99, True, 1)]


def test_state_is_kept_by_buckets(spark, tmp_path):
    """A micro-batch of many episodes leaves one mark, one bundle of texts and one timer per bucket."""
    rows = [timed((e, 0, "o ", "a ", "", 1.0, None, e % 2 == 0), e) for e in range(200)]
    spark.createDataFrame(rows, TIMED).coalesce(1).write.parquet(f"{tmp_path}/in")
    made = ST.stream_trajectories(spark.readStream.schema(TIMED).parquet(f"{tmp_path}/in"), TOKENIZER, 4, 99, buckets=5)
    query = (
        made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    made = [p.stateOperators[0].customMetrics for p in query.recentProgress if p.stateOperators]
    assert sum(m["numRegisteredTimers"] for m in made) <= 10
    assert spark.read.schema(ST.RESULT).parquet(f"{tmp_path}/out").count() == 100


def test_handler_text_counts_against_the_budget(spark, tmp_path):
    class Wordy:
        def reset(self, observation):
            return observation

        def step(self, event):
            return {"environment_feedback": "w " * 8, "reward": 1.0, "done": False}

    rows = [timed((1, s, "o ", "a ", "f ", 0.0, None, False), s) for s in range(4)]
    (row,) = run(spark, [rows[:2], rows[2:]], tmp_path, 4, 10, Wordy()).collect()
    assert (row.num_steps, row.num_tokens, row.text) == (1, 10, "o a " + "w " * 8)
    assert row.observation_tokens == TOKENIZER.encode(row.text)
    assert spark.range(1).select(TOKENIZER.ids(F.lit(row.text + "</s> é"))).first()[0] == TOKENIZER.encode(row.text + "</s> é")


def test_trajectory_by_hand(spark):
    rows = [
        (1, 0, "obs one ", "a b ", "f ", 1.0, None, False),
        (1, 1, "obs one ", "c ", "", 2.0, None, True),
        (1, 2, "obs one ", "never ", "", 9.0, 9.0, False),
        (2, 0, "x " * 6, "late ", "", 1.0, 1.0, False),
    ]
    out = {r.episode_id: r for r in assemble_trajectory(spark.createDataFrame(rows, STEPS), TOKENIZER, 5, 6).collect()}
    one = out[1]
    assert (one.text, one.num_steps, one.reward, one.score) == ("obs one a b f c ", 2, 3.0, 3.0)
    assert [(r.start, r.end) for r in one.action_ranges] == [(2, 4), (5, 6)] and len(one.observation_tokens) == 6
    # an observation that fills the budget takes no step
    assert (out[2].num_steps, out[2].reward, out[2].score) == (0, 0.0, 0.0)


def test_trajectory_payload(spark):
    schema = STEPS + ", label string, extra_logs map<string,double>, action_log_probs array<double>"
    rows = [
        (1, 1, "other ", "c ", "g h ", 2.0, None, False, "no", {"k": 2.0}, [-3.0]),
        (1, 0, "o p ", "a b ", "f ", 1.0, None, False, "yes", {"k": 1.0}, [-1.0, -2.0]),
        (1, 0, "o p ", "a b ", "f ", 1.0, None, False, "yes", {"k": 1.0}, [-1.0, -2.0]),  # sent twice
        (1, 2, "o p ", "d ", "", 4.0, 5.0, None, None, {"k": 9.0}, None),
        (2, 0, "q ", "", "", 0.0, None, True, None, None, []),
    ]
    made = assemble_trajectory(spark.createDataFrame(rows, schema), TOKENIZER, 9, 99)
    out = {r.episode_id: r for r in trajectory_rollout_row(made, 9).collect()}
    one, full = out[1], {r.episode_id: r for r in made.collect()}[1]
    assert (one.text, one.label, one.reward, one.score, one.extra_logs, one.num_steps) == ("o p a b f c g h d ", "yes", 7.0, 5.0, {"k": 9.0}, 3)
    assert full.rollout_log_probs == [0.0, 0.0, -1.0, -2.0, 0.0, -3.0, 0.0, 0.0, 0.0]
    assert one.action_mask == [0, 1, 1, 0, 1, 0, 0, 1] and one.rollout_log_probs == full.rollout_log_probs[1:9]
    assert (out[2].num_steps, out[2].action_mask, out[2].rollout_log_probs, out[2].label) == (1, [], [], None)
    wrong = spark.createDataFrame([(1, 0, "o ", "a b ", "", 1.0, None, True, None, None, [-1.0])], schema)
    with pytest.raises(Exception, match="one log-probability per action token"):
        assemble_trajectory(wrong, TOKENIZER, 9, 99).collect()


def test_running_metrics(spark, tmp_path):
    rows = [(i % 2, "kl", float(i)) for i in range(10)]
    stream = files(spark, rows, "step int, metric string, value double", f"{tmp_path}/in", 2)
    query = (
        ST.stream_metrics(stream).writeStream.outputMode("complete").format("memory").queryName("running_metrics")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {r.step: (r.value, r.n) for r in spark.table("running_metrics").collect()}
    assert got == {0: (4.0, 5), 1: (5.0, 5)}


@pytest.mark.parametrize("truncate", [3, 6, 40])
def test_trajectory_masks(spark, truncate):
    episodes_ = assemble_trajectory(spark.createDataFrame(episodes(), STEPS), TOKENIZER, 4, 14)
    for r in trajectory_rollout_row(episodes_, truncate).collect():
        mask = [0] * len(r.observation_tokens)
        for span in r.action_ranges:
            for i in range(span.start, span.end):
                mask[i] = 1
        mask = mask[1:truncate]
        ones = [i for i, x in enumerate(mask) if x]
        assert r.action_mask == mask and r.sequences == r.observation_tokens[:truncate]
        assert r.response_length == (ones[-1] - ones[0] + 1 if ones else 0)
        assert r.total_length == min(len(r.observation_tokens), truncate)
        assert r.clipped == int(r.total_length >= truncate)
