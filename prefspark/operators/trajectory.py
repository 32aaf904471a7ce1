"""Multi-step agent trajectories from a table of steps.

A trajectory is a sequence of token runs: the observation, then an action and its feedback per step. Everything that
is aligned with the tokens (ranges, masks, log-probabilities) expands from the lengths of the runs in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefspark.functions import arrays as A
from prefspark.functions.tokens import Tokenizer

_OPTIONAL = {"label": "string", "extra_logs": "map<string,double>", "action_log_probs": "array<double>"}


def assemble_trajectory(
    steps: DataFrame, tokenizer: Tokenizer, max_steps: int, max_length: int, episode: str = "episode_id"
) -> DataFrame:
    """One row per episode from steps (episode, step, observation, action_text, environment_feedback,
    reward, score, done and, if given, extra_logs, label, action_log_probs).

    Steps are taken while fewer than ``max_length`` tokens are in the context and until a step is
    done; of steps of one number the least by its texts counts. The score is the last step's, else the
    running reward. Step numbers start at zero, so an episode collects at most ``max_steps`` rows.
    ``label`` and the observation are the first step's. With ``action_log_probs``, one number per action token,
    ``rollout_log_probs`` runs along the tokens, zero for observation and feedback; a step without them counts as zeros.
    """
    given = {c: F.col(c) if c in steps.columns else F.lit(None).cast(t) for c, t in _OPTIONAL.items()}
    rows = steps.where(F.col("step") < max_steps).select(
        episode,
        "step",
        "observation",
        given["label"].alias("label"),
        F.concat("action_text", "environment_feedback").alias("text"),
        tokenizer.ids(F.col("action_text")).alias("action_ids"),
        tokenizer.ids(F.col("environment_feedback")).alias("feedback_ids"),
        "reward",
        "score",
        F.coalesce("done", F.lit(False)).alias("done"),
        given["extra_logs"].alias("extra_logs"),
        given["action_log_probs"].alias("log_probs"),
    )
    in_order = Window.partitionBy(episode).orderBy("step", "text", "reward", "score", "done")
    rows = rows.withColumn("_last", F.lag("step").over(in_order)).where(F.col("_last").isNull() | (F.col("_last") < F.col("step")))
    earlier = Window.partitionBy(episode).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    size = F.size("action_ids") + F.size("feedback_ids")
    sized = rows.withColumns(
        {
            "_start": F.coalesce(F.sum(size).over(earlier), F.lit(0)).cast("int"),
            "_open": ~F.coalesce(F.max("done").over(earlier), F.lit(False)),
        }
    )
    first = F.col("_last").isNull()  # the texts of the start are carried once
    step = F.struct(
        "step", "text", "action_ids", "feedback_ids", "log_probs", "reward", "score", "extra_logs",
        F.col("_start").alias("start"), F.col("_open").alias("open"),
        F.when(first, F.col("observation")).alias("observation"), F.when(first, F.col("label")).alias("label"),
    )
    grouped = sized.groupBy(episode).agg(F.collect_list(step).alias("steps"))
    ordered = F.array_sort("steps", lambda a, b: (a["step"] - b["step"]).cast("int"))
    started = grouped.select(episode, ordered.alias("steps")).withColumn("_start", F.get("steps", F.lit(0)))
    started = started.select(
        episode, "steps", F.col("_start.observation").alias("observation"), F.col("_start.label").alias("label")
    ).withColumn("_ids", tokenizer.ids(F.col("observation")))
    taken = started.withColumn("_n", F.size("_ids"))
    taken = taken.withColumn("steps", F.filter("steps", lambda s: s["open"] & (F.col("_n") + s["start"] < max_length)))
    columns = summary("action_log_probs" in steps.columns)
    if "label" not in steps.columns:
        del columns["label"]
    return taken.select(episode, *[c.alias(n) for n, c in columns.items()])


def summary(log_probs: bool) -> dict[str, Column]:
    """What a trajectory comes to, from ``observation``, ``label``, its tokens ``_ids``, their number ``_n`` and ``steps``."""
    ids, steps, n = F.col("_ids"), F.col("steps"), F.col("_n")
    last = F.try_element_at(steps, F.lit(-1))
    total = F.aggregate(steps, F.lit(0.0), lambda acc, s: acc + s["reward"])
    out = {
        "label": F.col("label"),
        "text": F.concat("observation", F.array_join(F.transform(steps, lambda s: s["text"]), "")),
        "observation_tokens": F.concat(ids, F.flatten(F.transform(steps, lambda s: F.concat(s["action_ids"], s["feedback_ids"])))),
        "action_ranges": F.transform(
            steps,
            lambda s: F.struct((n + s["start"]).alias("start"), (n + s["start"] + F.size(s["action_ids"])).alias("end")),
        ),
        "num_steps": F.size(steps),
        "reward": total,
        "score": F.coalesce(last["score"], total),
        "extra_logs": last["extra_logs"],
    }
    if log_probs:
        zeros = lambda k: F.array_repeat(F.lit(0.0), k)

        def of_step(s: Column) -> Column:
            k = F.size(s["action_ids"])
            fits = F.when(F.size(s["log_probs"]) == k, s["log_probs"])
            fits = fits.otherwise(F.raise_error(F.lit("a step needs one log-probability per action token")).cast("array<double>"))
            known = F.when(s["log_probs"].isNull(), zeros(k)).otherwise(fits)
            return F.concat(known, zeros(F.size(s["feedback_ids"])))

        out["rollout_log_probs"] = F.concat(zeros(n), F.flatten(F.transform(steps, of_step)))
    return out


def trajectory_rollout_row(df: DataFrame, truncate: int) -> DataFrame:
    """Sequence, action mask and length metrics of assembled trajectories.

    The response runs from the first to the last action token, feedback in between included. Log-probabilities are
    those of the tokens that the mask is about: all but the first.
    """
    n = F.size("observation_tokens")
    cells = {
        "sequences": A.cut(F.col("observation_tokens"), truncate),
        "action_mask": A.drop_first(A.cut(A.range_mask(n, F.col("action_ranges")), truncate)),
        "total_length": F.least(n, F.lit(truncate)),
    }
    if "rollout_log_probs" in df.columns:
        cells["rollout_log_probs"] = A.drop_first(A.cut(F.col("rollout_log_probs"), truncate))
    out = df.withColumns(cells)
    mask = F.col("action_mask")
    first = F.array_position(mask, F.lit(1)).cast("int")
    length = F.when(first > 0, A.last_one_index(mask) - first + 2).otherwise(F.lit(0))
    return out.withColumns(
        {"response_length": length, "clipped": (F.col("total_length") >= truncate).cast("int")}
    )
