"""Queries: batching, positions, blending, trajectories and streams."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from prefspark.functions import arrays as A
from prefspark.functions.tokens import WhitespaceTokenizer
from prefspark.operators import batching as B
from prefspark.operators import blend as U
from prefspark.operators import objective as O
from prefspark.operators import positions as P
from prefspark.operators import trajectory as TR
from prefspark.plans.registry import joined, q6, query, r6
from prefspark.plans.views import VIEWS, run_sql, table, view
from prefspark.session import scratch_path
from prefspark.streaming import batches as SB
from prefspark.streaming import trajectories as ST

TOKENIZER = WhitespaceTokenizer()


# The bins of a step as a list of totals, one sample after another.
@query("w09_first_fit_batches", """
WITH RECURSIVE i AS (SELECT step, total_length AS x, row_number() OVER (PARTITION BY step ORDER BY position) AS k FROM v_lengths),
w AS (
  SELECT step, 0::BIGINT AS k, []::BIGINT[] AS bins FROM i WHERE k = 1
  UNION ALL
  SELECT step, k, CASE WHEN hit = 0 THEN list_append(bins, x) ELSE list_transform(bins, lambda b, j: CASE WHEN j = hit THEN b + x ELSE b END) END
  FROM (
    SELECT w.step, i.k, i.x::BIGINT AS x, bins, COALESCE(list_position(list_transform(bins, lambda b: b + i.x <= 16192), TRUE), 0) AS hit
    FROM w JOIN i ON i.step = w.step AND i.k = w.k + 1))
SELECT step, len(arg_max(bins, k))::INT AS num_batches FROM w GROUP BY step""", "v_lengths")
def w09(spark, sf):
    return B.first_fit_batches(view(spark, sf, "v_lengths"), 16192)


@query("w10_balanced_partitions")
def w10(spark, sf):
    return B.balanced_partitions(_full_steps(spark, sf), 6)


@query("w10_balanced_equal_size")
def w10b(spark, sf):
    return B.balanced_partitions(_full_steps(spark, sf), 6, equal_size=True)


def _full_steps(spark, sf):
    """Lengths by step, 60 orders each; a short last step joins the one before it."""
    rows = view(spark, sf, "v_lengths")
    full = rows.agg(F.floor((F.max("position") + 1) / 60) - 1).scalar()
    return rows.withColumn("step", F.least(F.col("step"), full))


@query("w11_greedy_partitions", """
WITH RECURSIVE f AS (SELECT floor((max(position) + 1) / 60) - 1 AS last FROM v_lengths),
i AS (
  SELECT step, position, total_length, row_number() OVER (PARTITION BY step ORDER BY position) AS k
  FROM (SELECT least(step, (SELECT last FROM f)) AS step, position, total_length FROM v_lengths)),
w AS (
  SELECT step, 0::BIGINT AS k, [0, 0, 0, 0, 0, 0]::BIGINT[] AS sums, NULL::BIGINT AS position, NULL::BIGINT AS total_length, 0 AS part FROM i WHERE k = 1
  UNION ALL
  SELECT step, k, list_transform(sums, lambda s, j: CASE WHEN j = hit THEN s + total_length ELSE s END), position, total_length, hit - 1
  FROM (
    SELECT i.step, i.k, sums, i.position, i.total_length, list_position(sums, list_min(sums)) AS hit
    FROM w JOIN i ON i.step = w.step AND i.k = w.k + 1))
SELECT step::BIGINT AS step, position, total_length, part::INT AS part FROM w WHERE k > 0""", "v_lengths")
def w11(spark, sf):
    return B.greedy_partitions(_full_steps(spark, sf), 6)


@query("a16_seqlen_balance_report")
def a16(spark, sf):
    parts = B.balanced_partitions(_full_steps(spark, sf), 6)
    return B.seqlen_balance_report(parts, 6)


def _ranked(workers: int) -> str:
    return f"""i AS (SELECT position, total_length, row_number() OVER (ORDER BY total_length DESC, position) - 1 AS i, count(*) OVER () AS n FROM v_lengths),
c AS (SELECT *, i // {workers} AS chunk, i % {workers} AS slot, (n + {workers - 1}) // {workers} AS chunks FROM i),
h AS (SELECT *, chunks // 2 AS half, n - (chunks - 1) * {workers} AS tail FROM c)"""


@query("w12_snake_balance", f"""WITH {_ranked(7)},
s AS (SELECT position, total_length, tail, CASE WHEN chunk < half THEN slot WHEN chunk = chunks - 1 THEN tail - 1 - slot ELSE 6 - slot END AS worker,
  CASE WHEN chunk < half THEN 2 * chunk WHEN chunks - 1 - chunk < half THEN 2 * (chunks - 1 - chunk) + 1 ELSE 2 * half END AS turn FROM h)
SELECT position, total_length, worker, turn FROM s WHERE worker < tail""", "v_lengths")
def w12(spark, sf):
    return B.snake_balance(view(spark, sf, "v_lengths").select("position", "total_length"), 7)


@query("w13_dynamic_micro_batches")
def w13(spark, sf):
    rows = run_sql(spark, sf, """SELECT position, CAST(FLOOR(position / 60e0) AS BIGINT) % 4 AS rank,
      CAST(FLOOR(position / 240e0) AS BIGINT) AS step, total_length FROM {v_lengths}""")
    return B.dynamic_micro_batches(rows, 16192)


@query("w14_rollout_micro_batches")
def w14(spark, sf):
    return B.rollout_micro_batches(_full_steps(spark, sf), 4, max_tokens=16192)


@query("w14_fixed_micro_batches", "SELECT position, total_length, position // 8 AS micro_batch FROM v_lengths", "v_lengths")
def w14b(spark, sf):
    out = B.rollout_micro_batches(view(spark, sf, "v_lengths"), 4, size=8)
    return out.select("position", "total_length", "micro_batch")


@query("w15_shard_round_robin", "SELECT o_orderkey, o_orderkey % 4 AS shard FROM orders")
def w15(spark, sf):
    return P.shard_round_robin(table(spark, sf, "orders").select("o_orderkey"), 4, "o_orderkey")


@query("w16_epoch_shards", """
WITH n AS (SELECT count(*) AS n FROM orders), x AS (SELECT o_orderkey FROM orders UNION ALL
  SELECT o_orderkey FROM orders WHERE o_orderkey < (SELECT (n + 6) // 7 * 7 - n FROM n))
SELECT o_orderkey, (row_number() OVER (ORDER BY k, o_orderkey) - 1) % 7 AS rank, (row_number() OVER (ORDER BY k, o_orderkey) - 1) // 7 AS step
FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey) AS k FROM x) QUALIFY step >= 10""")
def w16(spark, sf):
    return P.epoch_shards(table(spark, sf, "orders").select("o_orderkey"), 7, consumed=75, index="o_orderkey")


@query("w16_shuffled_epoch", """
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY ('0x' || substr(md5('43:' || o_orderkey), 1, 15))::BIGINT, o_orderkey) - 1 AS i
  FROM orders),
t AS (SELECT CASE WHEN count(*) % 7 = 0 THEN count(*) ELSE (count(*) - 1) // 7 * 7 END AS total FROM orders)
SELECT o_orderkey, i AS epoch_index, i % 7 AS rank, i // 7 AS step FROM o, t WHERE i < total""")
def w16b(spark, sf):
    shuffled = P.epoch_order(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 42, 1)
    return P.epoch_shards(shuffled, 7, drop_last=True)


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


_PLACE = P.permuted_sql("{0}", "(SELECT count(*) FROM orders)", 42 * 1_000_003 + 1)


@query("w16_epoch_places", f"""
WITH RECURSIVE r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders),
w AS (
  SELECT o_orderkey, position, {_PLACE.format('position')} AS place FROM r
  UNION ALL SELECT o_orderkey, position, {_PLACE.format('place')} FROM w WHERE place >= (SELECT count(*) FROM orders))
SELECT o_orderkey, position, place AS epoch_index, place % 4 AS rank, place // 4 AS step FROM w
WHERE place < (SELECT count(*) FROM orders) AND place < (SELECT count(*) // 4 * 4 FROM orders)""")
def w16_places(spark, sf):
    rows = P.dense_position(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])
    out = P.epoch_shards(P.epoch_places(rows, rows.count(), 42, 1), 4, drop_last=True)
    return out.select("o_orderkey", "position", "epoch_index", "rank", "step")


@query("w17_dense_position", f"SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY {', '.join(_LINE)}) - 1 AS position FROM lineitem")
def w17(spark, sf):
    out = P.dense_position(table(spark, sf, "lineitem").select(*_LINE), _LINE)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "position")


_SAMPLES = "SELECT event_id AS position, event_id % 6 AS n, value AS reward FROM {events}"


@query("w18_concat_samples", f"""SELECT position // 8 AS batch, count(*) AS samples, sum(n) AS real_tokens, max(n) * count(*) AS padded_tokens, {q6('sum(reward)')} AS reward
FROM ({_SAMPLES.format(events='events')}) GROUP BY 1""")
def w18(spark, sf):
    rows = run_sql(spark, sf, _SAMPLES).withColumn("ids", F.expr("array_repeat(1, CAST(n AS INT))"))
    out = B.concat_samples(rows, {"ids": 0}, 8, ["reward"])
    flat = F.flatten("ids")
    return out.select(
        "batch", F.size("position").alias("samples"), F.size(F.filter(flat, lambda x: x == 1)).alias("real_tokens"), F.size(flat).alias("padded_tokens"),
        r6(F.aggregate("reward", F.lit(0.0), lambda a, x: a + x)).alias("reward"),
    )


@query("w18_split_batches", "SELECT event_id // 8 AS batch, event_id % 8 AS row_in_batch, event_id AS position, value AS reward FROM events")
def w18b(spark, sf):
    rows = run_sql(spark, sf, _SAMPLES).withColumn("ids", F.array(F.lit(1)))
    return B.split_batches(B.concat_samples(rows, {"ids": 0}, 8, ["reward"]), ["position", "reward"])


# ---------------------------------------------------------------------------------------------
# blending


@query("u01_blend_concat", """SELECT doc_id AS id, text, 0 AS source_ordinal FROM documents UNION ALL SELECT item_id, text, 1 FROM benchmark
UNION ALL SELECT page_id, html, 2 FROM pages""")
def u01(spark, sf):
    return U.blend_concat([
        table(spark, sf, "documents").selectExpr("doc_id AS id", "text"),
        table(spark, sf, "benchmark").selectExpr("item_id AS id", "text"),
        table(spark, sf, "pages").selectExpr("page_id AS id", "html AS text"),
    ])


@query("u02_blend_interleave", """
WITH parts AS (
  SELECT 0 AS source_ordinal, doc_id AS id, n_chars::BIGINT AS size FROM documents
  UNION ALL SELECT 1, page_id, length(html) FROM pages UNION ALL SELECT 2, item_id, length(text) FROM benchmark),
rows AS (SELECT *, row_number() OVER (PARTITION BY source_ordinal ORDER BY id) - 1 AS pos,
  count(*) OVER (PARTITION BY source_ordinal) AS n FROM parts),
draws AS (
  SELECT draw, CASE WHEN u < 0.6e0 THEN 0 WHEN u < 0.6e0 + 0.3e0 THEN 1 ELSE 2 END AS source_ordinal
  FROM (SELECT draw, ('0x' || substr(md5('42:' || draw), 1, 15))::BIGINT / 1152921504606846976e0 AS u
    FROM (SELECT unnest(range(12 * count(*))) AS draw FROM parts))),
counted AS (SELECT *, row_number() OVER (PARTITION BY source_ordinal ORDER BY draw) - 1 AS k FROM draws),
sizes AS (SELECT DISTINCT source_ordinal, n FROM rows),
ended AS (SELECT max(draw) AS stop FROM counted c JOIN sizes s ON s.source_ordinal = c.source_ordinal AND c.k = s.n - 1)
SELECT c.draw, c.source_ordinal, r.id, r.size FROM counted c JOIN sizes s ON s.source_ordinal = c.source_ordinal
JOIN rows r ON r.source_ordinal = c.source_ordinal AND r.pos = c.k % s.n WHERE c.draw <= (SELECT stop FROM ended)""")
def u02(spark, sf):
    parts = [
        table(spark, sf, "documents").selectExpr("doc_id AS id", "n_chars AS size"),
        table(spark, sf, "pages").selectExpr("page_id AS id", "length(html) AS size"),
        table(spark, sf, "benchmark").selectExpr("item_id AS id", "length(text) AS size"),
    ]
    return U.blend_interleave([p.withColumn("size", F.col("size").cast("long")) for p in parts], ["id"], [0.6, 0.3, 0.1], 42)


@query("u05_regroup_by_prompt", """SELECT event_id AS position, user_id AS prompt, row_number() OVER (ORDER BY f, event_id) - 1 AS group_position
FROM (SELECT event_id, user_id, min(event_id) OVER (PARTITION BY user_id) AS f FROM events)""")
def u05(spark, sf):
    return U.regroup_by_prompt(table(spark, sf, "events").selectExpr("event_id AS position", "user_id AS prompt"))


# ---------------------------------------------------------------------------------------------
# streams and trajectories


_IDS_SQL = "array_to_string(list_transform(list_filter(string_split({0}, ' '), lambda t: t <> ''), lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 1000000 + 3), ',')"

# Events arrive in three parts: halves by time, of which every 17th comes a part later and every 5th
# comes again a part later. A second passes per event.
_DELAY, _IDLE, _FORGET = 1_000_250, 60_125, 3_600_000  # milliseconds


def _parts(rows, number):
    """The rows in the parts that they arrive in."""
    share = F.col(number) / rows.agg(F.max(number) + 1).scalar()
    rows = rows.withColumn("_part", F.floor(share * 2).cast("int")).withColumn("_late", F.col(number) % 17 == 0)
    arrives = F.col("_part") + F.col("_late").cast("int")
    again = F.when(~F.col("_late") & (F.col(number) % 5 == 1), F.col("_part") + 1)
    return [rows.where((arrives == part) | (again == part)).drop("_part", "_late") for part in range(3)]


def _episodes(spark, sf, *handler):
    """Feed the parts to a trajectory stream one after another and read what it emitted."""
    out = scratch_path(spark, "episodes")
    rows = _agent_steps(spark, sf).withColumn("event_id", F.col("episode_id") + F.col("step"))
    rows = rows.withColumn("event_time", F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("event_id") * 1000))
    for part in _parts(rows, "event_id"):
        part.drop("event_id").write.mode("append").parquet(f"{out}/in")
        stream = spark.readStream.schema(spark.read.parquet(f"{out}/in").schema).parquet(f"{out}/in")
        wait = {"delay": f"{_DELAY} milliseconds", "idle": timedelta(milliseconds=_IDLE), "forget": timedelta(milliseconds=_FORGET)}
        made = ST.stream_trajectories(stream, TOKENIZER, 4, 100000, *handler, **wait)
        made.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").trigger(
            availableNow=True
        ).start().awaitTermination()
    return spark.read.schema(ST.RESULT).parquet(f"{out}/data")


# What arrives before its watermark, the steps up to the first gap or the end, and the episodes that close or are given up.
_ARRIVED = f"""a AS (
  SELECT *, episode_id + step AS event_id, floor((episode_id + step) / (SELECT max(episode_id + step) + 1e0 FROM v_steps) * 2)::INT AS part,
    (episode_id + step) % 17 = 0 AS late FROM v_steps),
w AS (SELECT k, (SELECT max(event_id) FROM a WHERE part + late::INT <= k) * 1000 - {_DELAY} AS mark FROM range(3) t(k)),
c AS (SELECT a.* FROM a LEFT JOIN w ON a.late AND w.k = a.part WHERE NOT a.late OR a.event_id * 1000 > w.mark),
d AS (SELECT *, row_number() OVER e - 1 AS nth, COALESCE(sum({{done}}::INT) OVER (PARTITION BY episode_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over
  FROM c WINDOW e AS (PARTITION BY episode_id ORDER BY step)),
s AS (SELECT * FROM d WHERE nth = step AND over = 0),
f AS (SELECT c.episode_id, max(c.event_id) * 1000 + {_IDLE} AS idle, COALESCE(count_if({{done}} AND s.step IS NOT NULL) > 0, FALSE) OR count(s.step) = 4 AS complete
  FROM c LEFT JOIN s ON s.episode_id = c.episode_id AND s.step = c.step GROUP BY 1),
g AS (SELECT * FROM f WHERE complete OR idle <= (SELECT mark FROM w WHERE k = 2))"""


def _stream(spark, sf, sql):
    """The events table as a stream behind a view's SQL."""
    schema = table(spark, sf, "events").schema
    source = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    return spark.sql(sql, events=source)


# Rounds of 40 groups, a minute apart; samples come in three parts like the steps below, up to _DELAY late.
_GENERATED = f"""a AS (
  SELECT *, prompt_id // 160 AS round, floor(position / (SELECT max(position) + 1e0 FROM v_responses) * 2)::INT AS part, position % 17 = 0 AS late FROM v_responses),
w AS (SELECT k, (SELECT max(round) FROM a WHERE part + late::INT <= k) * 60000 - {_DELAY} AS mark FROM range(3) t(k)),
c AS (SELECT a.* FROM a LEFT JOIN w ON a.late AND w.k = a.part WHERE (NOT a.late OR a.round * 60000 > w.mark)),
g AS (SELECT prompt_id, round, min(position) AS f, avg(score) AS m, count(*) AS n FROM c
  WHERE round * 60000 <= (SELECT mark FROM w WHERE k = 2) GROUP BY 1, 2),
s AS (SELECT *, dense_rank() OVER (ORDER BY round) - 1 AS r, n = 4 AND m > 1e-6 AND m < 1 - 1e-6 AS kept FROM g)"""


@query("r01_stream_dynamic_batches", f"""
WITH RECURSIVE {_GENERATED},
t AS (SELECT r, count_if(kept) AS kept, sum(n) AS seen FROM s GROUP BY 1),
x AS (
  SELECT -1::BIGINT AS r, 0::BIGINT AS batch, 0::BIGINT AS held, 0::HUGEINT AS seen, FALSE AS done
  UNION ALL
  SELECT t.r, x.batch + x.done::INT, CASE WHEN x.done THEN 0 ELSE x.held END + t.kept, CASE WHEN x.done THEN 0 ELSE x.seen END + t.seen,
    CASE WHEN x.done THEN 0 ELSE x.held END + t.kept >= 64
  FROM x JOIN t ON t.r = x.r + 1),
k AS (SELECT x.batch, s.prompt_id, s.m, row_number() OVER (PARTITION BY x.batch ORDER BY s.round, s.f) AS place FROM s JOIN x ON x.r = s.r WHERE s.kept)
SELECT k.batch, place, prompt_id, m AS mean_score, {q6('400e0 * held / seen')} AS pass_rate FROM k JOIN x ON x.batch = k.batch AND x.done WHERE place <= 64""", "v_responses")
def r01(spark, sf):
    out = scratch_path(spark, "rollouts")
    rows = view(spark, sf, "v_responses").select("prompt_id", "position", "score")
    rows = rows.withColumn("created", F.timestamp_millis(F.lit(1_700_000_000_000) + F.floor(F.col("prompt_id") / 160) * 60_000))
    for part in _parts(rows, "position"):
        part.write.mode("append").parquet(f"{out}/in")
        stream = spark.readStream.schema(SB.SAMPLE).parquet(f"{out}/in")
        done = SB.run_dynamic_batches(stream, 4, 64, out, delay=f"{_DELAY} milliseconds")
    return done.select("batch", "place", "prompt_id", "mean_score", r6("pass_rate").alias("pass_rate"))


_TAKEN = """k AS (SELECT *, min(CASE WHEN done THEN step END) OVER (PARTITION BY episode_id) AS stop,
  2 + COALESCE(sum(2 + CASE WHEN environment_feedback = '' THEN 0 ELSE 2 END) OVER (PARTITION BY episode_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS context FROM v_steps),
s AS (SELECT * FROM k WHERE (stop IS NULL OR step <= stop) AND step < {steps} AND context < {budget})"""
_EPISODE = f"""SELECT episode_id, max(observation) || string_agg(action_text || environment_feedback, '' ORDER BY step) AS text, count(*) AS num_steps,
  {q6('sum(reward)')} AS reward, {q6('COALESCE(arg_max(struct_pack(x := score), step).x, sum(reward))')} AS score FROM s GROUP BY 1"""


@query("r02_stream_trajectories", "WITH " + _ARRIVED.format(done="c.done").replace("sum(c.", "sum(") + f""",
e AS (SELECT episode_id, max(observation) || string_agg(action_text || environment_feedback, '' ORDER BY step) AS text, count(*) AS num_steps, sum(reward) AS reward,
  COALESCE(arg_max(struct_pack(x := score), step).x, sum(reward)) AS score,
  string_agg(CASE WHEN environment_feedback = '' THEN '1,1' ELSE '1,1,0,0' END, ',' ORDER BY step) AS mask FROM s GROUP BY 1)
SELECT g.episode_id, complete, COALESCE(text, '') AS text, COALESCE(num_steps, 0) AS num_steps, {q6('COALESCE(reward, 0e0)')} AS reward, {q6('COALESCE(score, 0e0)')} AS score,
  CASE WHEN text IS NULL THEN '' ELSE {_IDS_SQL.format('text')} END AS observation_tokens, COALESCE('0,0,' || mask, '') AS acted
FROM g LEFT JOIN e ON e.episode_id = g.episode_id""", "v_steps")
def r02(spark, sf):
    done = _episodes(spark, sf)
    done = done.withColumn("mask", A.range_mask(F.size("observation_tokens"), F.col("action_ranges")))
    return done.select(
        "episode_id", "complete", "text", "num_steps", r6("reward").alias("reward"), r6("score").alias("score"),
        joined(F.col("observation_tokens")).alias("observation_tokens"), joined(F.col("mask")).alias("acted"),
    )


class _Doubled:
    """Environment that greets, rewards twice and never stops early."""

    def reset(self, observation):
        return "hello " + observation

    def step(self, event):
        return {"environment_feedback": event["environment_feedback"], "reward": 2 * event["reward"], "done": False}


@query("h04_agent_handler", "WITH " + _ARRIVED.format(done="FALSE") + f""",
e AS (SELECT episode_id, 'hello ' || max(observation) || string_agg(action_text || environment_feedback, '' ORDER BY step) AS text, 2 * sum(reward) AS score FROM s GROUP BY 1)
SELECT g.episode_id, complete, COALESCE(text, '') AS text, {q6('COALESCE(score, 0e0)')} AS score,
  CASE WHEN text IS NULL THEN '' ELSE {_IDS_SQL.format('text')} END AS observation_tokens FROM g LEFT JOIN e ON e.episode_id = g.episode_id""", "v_steps")
def h04(spark, sf):
    done = _episodes(spark, sf, _Doubled())
    return done.select("episode_id", "complete", "text", r6("score").alias("score"), joined(F.col("observation_tokens")).alias("observation_tokens"))


_STEP_METRICS = "SELECT CAST(FLOOR(event_id / 128e0) AS BIGINT) AS step, event_type AS metric, value FROM {events}"


@query("r03_stream_metrics", f"SELECT step, metric, {q6('avg(value)', 9)} AS value, count(*) AS n FROM ({_STEP_METRICS.format(events='events')}) GROUP BY 1, 2")
def r03(spark, sf):
    out = scratch_path(spark, "metrics")

    def store(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{out}/data")

    running = ST.stream_metrics(_stream(spark, sf, _STEP_METRICS))
    query_ = (
        running.writeStream.outputMode("complete").foreachBatch(store).option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query_.awaitTermination()
    return spark.read.parquet(f"{out}/data").select("step", "metric", r6("value", 9).alias("value"), "n")


def _agent_steps(spark, sf):
    """Steps with a label and one log-probability for each of the two tokens of an action."""
    return view(spark, sf, "v_steps").selectExpr(
        "*", "'label ' || episode_id AS label", "map('cost', reward / 4e0) AS extra_logs", "array(-reward / 5e1, -reward / 4e1) AS action_log_probs"
    )


@query("r04_assemble_trajectory", "WITH " + _TAKEN.format(steps=4, budget=9) + f""",
e AS (SELECT episode_id, max(observation) || string_agg(action_text || environment_feedback, '' ORDER BY step) AS text, count(*) AS num_steps,
  sum(reward) AS reward, COALESCE(arg_max(struct_pack(x := score), step).x, sum(reward)) AS score, arg_max(reward, step) / 4e0 AS cost,
  string_agg(context || ':' || (context + 2), ',' ORDER BY step) AS action_ranges,
  list(-reward / 5e1 ORDER BY step) AS p, list(-reward / 4e1 ORDER BY step) AS q FROM s GROUP BY 1)
SELECT episode_id, text, num_steps, {q6('reward')} AS reward, {q6('score')} AS score, {q6('cost')} AS cost, 'label ' || episode_id AS label,
  action_ranges, {_IDS_SQL.format('text')} AS observation_tokens, {q6('list_sum(p) + list_sum(q)')} AS log_prob FROM e""", "v_steps")
def r04(spark, sf):
    out = TR.assemble_trajectory(_agent_steps(spark, sf), TOKENIZER, 4, 9)
    ranges = F.transform("action_ranges", lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string")))
    return out.select(
        "episode_id", "text", "num_steps", r6("reward").alias("reward"), r6("score").alias("score"),
        r6(F.col("extra_logs")["cost"]).alias("cost"), "label", F.array_join(ranges, ",").alias("action_ranges"),
        joined(F.col("observation_tokens")).alias("observation_tokens"), r6(A.array_sum(F.col("rollout_log_probs"))).alias("log_prob"),
    )


@query("r05_trajectory_rollout_row", "WITH " + _TAKEN.format(steps=4, budget=9) + """,
e AS (SELECT episode_id, 2 + sum(2 + CASE WHEN environment_feedback = '' THEN 0 ELSE 2 END) AS n, least(max(context) + 2, 11) AS act_end FROM s GROUP BY 1)
SELECT episode_id, least(n, 11) AS total_length, act_end - 2 AS response_length, CASE WHEN n >= 11 THEN 1 ELSE 0 END AS clipped FROM e""", "v_steps")
def r05(spark, sf):
    out = TR.trajectory_rollout_row(TR.assemble_trajectory(view(spark, sf, "v_steps"), TOKENIZER, 4, 9), 11)
    return out.select("episode_id", "total_length", "response_length", "clipped")


# Per cell of an episode: token, whether it is an action's and its log-probability.
_CELLS = """c AS (
  SELECT episode_id, string_split(trim(max(observation) || string_agg(action_text || environment_feedback, '' ORDER BY step)), ' ') AS t,
    list_concat([0, 0], flatten(list(CASE WHEN environment_feedback = '' THEN [1, 1] ELSE [1, 1, 0, 0] END ORDER BY step))) AS m,
    list_concat([0e0, 0e0], flatten(list(CASE WHEN environment_feedback = '' THEN [-reward / 5e1, -reward / 4e1]
      ELSE [-reward / 5e1, -reward / 4e1, 0e0, 0e0] END ORDER BY step))) AS p
  FROM s GROUP BY 1)"""


@query("r05_trajectory_masks", "WITH " + _TAKEN.format(steps=4, budget=9) + f""", {_CELLS}
SELECT episode_id, array_to_string(list_transform(t[1:11], lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT % 1000000 + 3), ',') AS sequences,
  array_to_string(m[2:11], ',') AS action_mask, array_to_string(list_transform(p[2:11], lambda x: CAST(round(x * 1e6) AS BIGINT)), ',') AS log_probs FROM c""", "v_steps")
def r05b(spark, sf):
    out = TR.trajectory_rollout_row(TR.assemble_trajectory(_agent_steps(spark, sf), TOKENIZER, 4, 9), 11)
    micro = F.transform("rollout_log_probs", lambda x: F.round(x * 1e6).cast("long"))
    return out.select(
        "episode_id", joined(F.col("sequences")).alias("sequences"), joined(F.col("action_mask")).alias("action_mask"), joined(micro).alias("log_probs")
    )


@query("l09_agent_rollout", "WITH " + _TAKEN.format(steps=4, budget=9) + f""", {_CELLS},
x AS (SELECT episode_id, unnest(m[2:11]) AS m, unnest(p[2:11]) AS ro, unnest(range(len(m[2:11]))) AS i FROM c),
y AS (SELECT m, ro, ro * 0.75e0 - 0.01e0 AS old, ro * 0.5e0 - 0.02e0 AS lp, (episode_id % 7 - 3) / 2e0 AS adv FROM x),
z AS (SELECT *, exp(lp - old) * adv AS s1, greatest(least(exp(lp - old), 1.2e0), 0.8e0) * adv AS s2 FROM y)
SELECT {q6('sum(least(exp(old - ro), 0.95e0) * -least(s1, s2) * m) / sum(m)')} AS loss, {q6('sum((ro - old) * m) / sum(m)')} AS rollout_kl FROM z""", "v_steps")
def l09_agent(spark, sf):
    out = TR.trajectory_rollout_row(TR.assemble_trajectory(_agent_steps(spark, sf), TOKENIZER, 4, 9), 11)
    rows = out.select(
        "action_mask",
        F.col("rollout_log_probs").alias("rollout_logprobs"),
        F.transform("rollout_log_probs", lambda x: x * 0.75 - 0.01).alias("old_logprobs"),
        F.transform("rollout_log_probs", lambda x: x * 0.5 - 0.02).alias("logprobs"),
        F.transform("rollout_log_probs", lambda _: (F.col("episode_id") % 7 - 3) / 2.0).alias("advantages"),
    )
    found = O.ppo_metrics(rows, weight_cap=0.95)
    return found.select(r6("loss").alias("loss"), r6("rollout_kl").alias("rollout_kl"))
