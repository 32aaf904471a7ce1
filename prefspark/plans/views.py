"""Preference-shaped views of the test tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from prefspark.session import configure

TABLES = ("customer", "orders", "lineitem", "events", "documents", "labels", "conversations", "pages", "benchmark")

VIEWS: dict[str, str] = {
    # user turn, its reply, and the next reply of the conversation (else the user's own words)
    "v_pairs": """
SELECT u.conv_id * 100 + u.turn AS pair_id, u.text AS prompt, a.text AS chosen, COALESCE(r.text, u.text) AS rejected
FROM {conversations} u
JOIN {conversations} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
LEFT JOIN {conversations} r ON r.conv_id = u.conv_id AND r.turn = u.turn + 3 AND r.role = 'assistant'
WHERE u.role = 'user'""",
    "v_margins": """
SELECT event_id AS pair_id, 'prompt ' || user_id AS prompt,
  'chosen ' || event_id AS chosen, 'rejected ' || event_id AS rejected,
  1 + (event_id * 7) % 50 AS chosen_len, 1 + (event_id * 13) % 60 AS rejected_len,
  -(1 + (event_id * 7) % 50) * (0.5e0 + value / 1e2) AS ref_chosen_logprob,
  -(1 + (event_id * 13) % 60) * (0.5e0 + ((event_id * 31) % 97) / 1e2) AS ref_rejected_logprob,
  -(1 + (event_id * 7) % 50) * 0.75e0 AS policy_chosen_logprob,
  -(1 + (event_id * 13) % 60) * 1.25e0 AS policy_rejected_logprob,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE ((event_id * 37) % 201 - 100) * 0.5e0 END AS rad,
  ((event_id * 41) % 801 - 400) / 1e1 AS im,
  ((event_id * 29) % 401 - 200) / 1e1 AS em_margin
FROM {events}""",
    "v_responses": """
SELECT event_id - event_id % 4 AS prompt_id, event_id % 4 AS sample_idx, event_id AS position,
  'input ' || (event_id - event_id % 4) AS input, 'output ' || event_id AS output,
  value AS reward, CASE WHEN value > 20 THEN 1e0 ELSE 0e0 END AS score,
  'ds' || ((event_id - event_id % 4) % 3) AS datasource
FROM {events}""",
    "v_tokens": """
SELECT event_id - event_id % 4 AS seq_id, event_id % 4 AS t, value / 1e2 AS reward,
  ((event_id * 17) % 89) / 89e0 AS value, CASE WHEN event_id % 9 = 0 THEN 0 ELSE 1 END AS action_mask,
  -value / 5e1 AS logprob, -((event_id * 19) % 83) / 4e1 AS base_logprob, event_id % 5 AS label
FROM {events}""",
    "v_kto": """
SELECT d.doc_id, l.quality AS label, -(d.doc_id % 37) / 1e1 AS policy_logp,
  -(d.doc_id % 41) / 1e1 AS ref_logp, -(d.doc_id % 43) / 1e1 AS policy_kl_logp, -(d.doc_id % 47) / 1e1 AS ref_kl_logp
FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id""",
    # blocks of four turns on one row
    "v_dialogs": """
SELECT conv_id * 10 + CAST(FLOOR(turn / 4e0) AS BIGINT) AS dialog_id,
  MAX(CASE WHEN turn % 4 = 0 THEN role END) AS r0, MAX(CASE WHEN turn % 4 = 0 THEN text END) AS t0,
  MAX(CASE WHEN turn % 4 = 1 THEN role END) AS r1, MAX(CASE WHEN turn % 4 = 1 THEN text END) AS t1,
  MAX(CASE WHEN turn % 4 = 2 THEN role END) AS r2, MAX(CASE WHEN turn % 4 = 2 THEN text END) AS t2,
  MAX(CASE WHEN turn % 4 = 3 THEN role END) AS r3, MAX(CASE WHEN turn % 4 = 3 THEN text END) AS t3
FROM {conversations} GROUP BY 1""",
    # four agent steps per episode
    "v_steps": """
SELECT event_id - event_id % 4 AS episode_id, CAST(event_id % 4 AS INT) AS step,
  'observe ' || (event_id - event_id % 4) || ' ' AS observation,
  event_type || ' ' || user_id || ' ' AS action_text,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE 'seen ' || event_id || ' ' END AS environment_feedback,
  value AS reward, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 2e0 END AS score,
  event_id % 7 = 0 AS done
FROM {events}""",
    # one training step per 60 consecutive orders
    "v_lengths": """
SELECT o_orderkey AS position, CAST(FLOOR(o_orderkey / 60e0) AS BIGINT) AS step,
  1 + o_custkey % 2048 AS total_length
FROM {orders}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, sql: str, **frames: DataFrame) -> DataFrame:
    """Run SQL whose ``{name}`` placeholders are test tables, views or the given frames."""
    wanted = {n for n in re.findall(r"\{(\w+)\}", sql)} - set(frames)
    for name in wanted:
        frames[name] = view(spark, sf_dir, name) if name in VIEWS else table(spark, sf_dir, name)
    return configure(spark).sql(sql, **frames)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, VIEWS[name])


def oracle(body: str, *views: str) -> str:
    """DuckDB statement: ``body`` behind the needed views as common table expressions.

    A body that starts with WITH is continued.
    """
    ctes = []
    for name in views:
        ctes.append(f"{name} AS ({re.sub(r'[{](\w+)[}]', r'\1', VIEWS[name])})")
    body = body.strip()
    if not ctes:
        return body
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return start + ", ".join(ctes) + ", " + body[len(start) :]
    return "WITH " + ", ".join(ctes) + " " + body
