"""Trajectories assembled from a stream of step events, and running metrics."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import timedelta
from itertools import chain
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from prefspark.functions.tokens import Tokenizer
from prefspark.operators.trajectory import summary

RESULT = (
    "episode_id long, complete boolean, num_tokens int, label string, text string, observation_tokens array<int>, "
    "action_ranges array<struct<start: int, end: int>>, num_steps int, reward double, score double, "
    "extra_logs map<string,double>, rollout_log_probs array<double>"
)
_EMITTED = "episode_id long, complete boolean, num_tokens int, body string"
_BODY = (
    "observation string, label string, _ids array<int>, steps array<struct<text: string, action_ids: array<int>, "
    "feedback_ids: array<int>, log_probs: array<double>, reward: double, score: double, extra_logs: map<string,double>, start: int>>"
)
_BUCKET = StructType([StructField("timer", LongType()), StructField("added", IntegerType()), StructField("episodes", StringType())])
_NUMBER = StructType([StructField("number", IntegerType())])
_TEXT = StructType([StructField("value", StringType())])


class StepHandler(Protocol):
    """Environment hook: turns a raw step event into text, reward and an end flag."""

    def reset(self, observation: str) -> str: ...

    def step(self, event: dict) -> dict:
        """Returns ``environment_feedback``, ``reward``, ``done`` and optionally ``score`` and ``extra_logs``."""


class RecordedSteps:
    """Handler for events that already carry the outcome of their step."""

    def reset(self, observation: str) -> str:
        return observation

    def step(self, event: dict) -> dict:
        return event


@dataclass
class _Progress:
    """How far an episode is, and the numbers of the bundles that hold its steps."""

    episode_id: int | None
    upcoming: int = 0
    tokens: int = 0
    start: int = 0
    reward: float = 0.0
    closed: bool = False
    last: int = 0
    due: int | None = None  # when it is given up or, once closed, forgotten
    taken: list[int] = field(default_factory=list)
    waiting: dict[str, int] = field(default_factory=dict)  # by step


class _Episodes(StatefulProcessor):
    """The state of a bucket of episodes: how far each is, and in bundles the steps taken and those that wait for an earlier one.

    What a call to the state and a timer cost is shared by a bucket. The short marks of its episodes are read and written
    together; the texts of those that a micro-batch leaves open are added as one bundle, which is never rewritten and
    goes when all episodes in it are closed. A closed episode leaves its mark, so that events sent again or too late do not
    open it anew. Every episode has a deadline, the bucket's timer is at the first: an open one is then given up, a mark is
    forgotten.
    """

    def __init__(self, tokenizer: Tokenizer, handler: StepHandler, max_steps: int, max_length: int, idle: int, forget: int):
        self.tokenizer, self.handler = tokenizer, handler
        self.max_steps, self.max_length = max_steps, max_length
        self.idle, self.forget = idle, forget

    def init(self, handle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", _BUCKET)
        self.bundles = handle.getMapState("bundles", _NUMBER, _TEXT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, episodes = self._read()
        came: dict[int | None, tuple[int, dict[int, str]]] = {}
        for text in chain.from_iterable(frame["event"] for frame in rows):
            name, step, at, event = text.split(" ", 3)
            episode_id, step = int(name) if name else None, int(step)
            one = episodes.get(episode_id)
            if one is None:
                one = episodes[episode_id] = _Progress(episode_id)
            _, new = came.setdefault(episode_id, (one.last, {}))
            one.last = max(one.last, int(at))
            if one.upcoming <= step < self.max_steps and not one.closed:
                new.setdefault(step, event)
        results = []
        for episode_id, (before, new) in came.items():
            one = episodes[episode_id]
            if not one.closed:
                results += self._advance(one, new)
            if one.last > before or one.closed:
                one.due = one.last + (self.forget if one.closed else self.idle)
        due = self._due(episodes)
        if due is not None and (timer is None or due < timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self._write(timer, episodes)
        yield from _frames(results)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, episodes = self._read()
        results = []
        now = timerValues.getCurrentWatermarkInMs()
        for one in [e for e in episodes.values() if e.due is not None and e.due <= now]:
            if one.closed:
                del episodes[one.episode_id]
                continue
            results.append(self._result(one, False, []))
            due = one.last + self.idle + self.forget
            episodes[one.episode_id] = _Progress(one.episode_id, closed=True, last=one.last, due=due)
        due = self._due(episodes)
        if due is not None:
            due = max(due, expiredTimerInfo.getExpiryTimeInMs() + 1)  # the timer that ran out is deleted afterwards
            self.handle.registerTimer(due)
        self._write(due, episodes)
        yield from _frames(results)

    def close(self) -> None:
        pass

    def _read(self) -> tuple[int | None, dict[int | None, _Progress]]:
        timer, self.added, text = self.bucket.get() or (None, 0, "[]")
        episodes = {values[0]: _Progress(*values) for values in json.loads(text)}
        self.held, self.loaded, self.bundle = self._numbers(episodes), {}, {}
        return timer, episodes

    def _write(self, timer: int | None, episodes: dict[int | None, _Progress]) -> None:
        if self.bundle:
            self.bundles.updateValue((self.added,), (json.dumps(self.bundle),))
            self.added += 1
        for number in self.held - self._numbers(episodes):
            self.bundles.removeKey((number,))
        if episodes:
            self.bucket.update((timer, self.added, json.dumps([list(vars(one).values()) for one in episodes.values()])))
        else:
            self.bucket.clear()

    @staticmethod
    def _numbers(episodes: dict[int | None, _Progress]) -> set[int]:
        return {n for one in episodes.values() for n in (*one.taken, *one.waiting.values())}

    def _stored(self, one: _Progress, number: int) -> dict:
        """What a bundle holds of an episode."""
        if number not in self.loaded:
            self.loaded[number] = json.loads(self.bundles.getValue((number,))[0])
        return self.loaded[number][str(one.episode_id)]

    @staticmethod
    def _due(episodes: dict[int | None, _Progress]) -> int | None:
        return min((one.due for one in episodes.values() if one.due is not None), default=None)

    def _advance(self, one: _Progress, new: dict[int, str]) -> list[tuple]:
        """Take the steps that are there; the result if the episode closes, else its new events wait."""
        parts = []
        while not one.closed and (text := self._next(one, new)) is not None:
            event = json.loads(text)
            if not one.upcoming:
                begun = self.handler.reset(event["observation"])
                ids = self._ids(begun, event["observation"], event["observation_ids"])
                parts.append({"observation": begun, "label": event.get("label"), "_ids": ids})
                one.tokens = len(ids)
                if one.tokens >= self.max_length:
                    one.closed = True
                    break
            outcome = self.handler.step(event)
            feedback = outcome["environment_feedback"]
            step = {
                "text": event["action_text"] + feedback,
                "action_ids": event["action_ids"],
                "feedback_ids": self._ids(feedback, event["environment_feedback"], event["feedback_ids"]),
                "log_probs": event.get("action_log_probs"),
                "reward": outcome["reward"],
                "score": outcome.get("score"),
                "extra_logs": outcome.get("extra_logs"),
                "start": one.start,
            }
            size = len(step["action_ids"]) + len(step["feedback_ids"])
            parts.append(step)
            one.tokens, one.start, one.reward = one.tokens + size, one.start + size, one.reward + outcome["reward"]
            one.upcoming += 1
            one.closed = bool(outcome.get("done")) or one.upcoming >= self.max_steps or one.tokens >= self.max_length
        if one.closed:
            return [self._result(one, True, parts)]
        if parts:
            one.taken.append(self.added)
        one.waiting |= dict.fromkeys(map(str, new), self.added)
        if parts or new:
            self.bundle[str(one.episode_id)] = {"taken": parts, "waiting": new}
        return []

    def _next(self, one: _Progress, new: dict[int, str]) -> str | None:
        """The event of the upcoming step, which is among the new ones or has waited."""
        number = one.waiting.pop(str(one.upcoming), None)
        if one.upcoming in new:
            return new.pop(one.upcoming)
        return None if number is None else self._stored(one, number)["waiting"][str(one.upcoming)]

    def _ids(self, text: str, recorded: str, ids: list[int]) -> list[int]:
        """Tokens of a text; those of the recorded one come from the plan, those of a handler's own are made here."""
        return ids if text == recorded else self.tokenizer.encode(text)

    def _result(self, one: _Progress, complete: bool, parts: list[dict]) -> tuple:
        """What the episode comes to, with ``parts`` after those in the state; it holds no more there."""
        parts = [part for number in one.taken for part in self._stored(one, number)["taken"]] + parts
        one.taken, one.waiting = [], {}
        body, *steps = parts or [{"observation": "", "_ids": []}]
        return one.episode_id, complete, one.tokens, json.dumps({**body, "steps": steps})


def _frames(results: list[tuple]) -> Iterator[pd.DataFrame]:
    if results:
        yield pd.DataFrame(results, columns=["episode_id", "complete", "num_tokens", "body"], dtype=object)


def use_state_store(spark: SparkSession) -> None:
    """Keep state in RocksDB, which lists, maps and timers need and which does not hold it in the heap."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key, ""):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_trajectories(
    stream: DataFrame,
    tokenizer: Tokenizer,
    max_steps: int,
    max_length: int,
    handler: StepHandler | None = None,
    event_time: str = "event_time",
    delay: str = "10 minutes",
    idle: timedelta = timedelta(minutes=30),
    forget: timedelta = timedelta(hours=1),
    buckets: int = 1 << 12,
) -> DataFrame:
    """One row per episode, emitted when a step is done, the step limit or the token budget is reached.

    Step events, with their ``event_time``, may arrive out of order and more than once within ``delay``: later steps wait in
    the state, and of a step that comes again the first counts. Events older than the watermark are dropped. An episode that
    hears nothing for ``idle`` before the watermark comes out with ``complete`` false and the steps that it has. Closed
    episodes are remembered for ``forget`` after their last event (and at least so long after they were given up); events
    that come in that time change nothing. State is so bounded by the episodes of the last ``delay + idle + forget``. It is
    kept by ``buckets`` of episodes, of which a micro-batch rewrites the marks it touches: some hundred to a thousand
    remembered episodes to a bucket are few enough. The number is fixed for the life of a checkpoint.

    Columns are those of :func:`assemble_trajectory`, ``num_tokens`` and ``complete``.
    """
    use_state_store(stream.sparkSession)
    log_probs = "action_log_probs" in stream.columns
    optional = {"label": "string", "extra_logs": "map<string,double>", "action_log_probs": "array<double>"}
    event = F.struct(
        "observation",
        "action_text",
        "environment_feedback",
        F.col("reward").cast("double").alias("reward"),
        F.col("score").cast("double").alias("score"),
        "done",
        tokenizer.ids(F.col("observation")).alias("observation_ids"),
        tokenizer.ids(F.col("action_text")).alias("action_ids"),
        tokenizer.ids(F.col("environment_feedback")).alias("feedback_ids"),
        *[F.col(c).cast(t).alias(c) for c, t in optional.items() if c in stream.columns],
    )
    milliseconds = lambda t: int(t.total_seconds() * 1000)
    head = F.col("episode_id"), F.col("step").cast("int"), F.unix_millis(event_time)
    sized = stream.withWatermark(event_time, delay).select(
        F.pmod(F.xxhash64(F.col("episode_id").cast("long")), F.lit(buckets)).alias("bucket"),
        F.col(event_time),
        # One text a row, as every cell costs. A missing episode is an empty word; a missing step or time fails the job.
        F.concat_ws(" ", *[F.coalesce(c.cast("long").cast("string"), F.lit("")) for c in head], F.to_json(event)).alias("event"),
    )
    state = _Episodes(tokenizer, handler or RecordedSteps(), max_steps, max_length, milliseconds(idle), milliseconds(forget))
    emitted = sized.groupBy("bucket").transformWithStateInPandas(state, _EMITTED, "Append", "EventTime")
    body = emitted.select("episode_id", "complete", "num_tokens", F.from_json("body", _BODY).alias("_body"))
    body = body.select("episode_id", "complete", "num_tokens", "_body.*").withColumn("_n", F.size("_ids"))
    columns = {n: c for n, c in summary(log_probs).items()}
    if not log_probs:
        columns["rollout_log_probs"] = F.lit(None).cast("array<double>")
    return body.select("episode_id", "complete", "num_tokens", *[c.alias(n) for n, c in columns.items()])


def stream_metrics(stream: DataFrame, step: str = "step", metric: str = "metric", value: str = "value") -> DataFrame:
    """Running mean of every metric per step; for ``complete`` or ``update`` output."""
    return stream.groupBy(step, metric).agg(F.avg(value).alias("value"), F.count(F.lit(1)).alias("n"))
