"""Feature columns of a margin table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.functions.scores import implicit_margin, implicit_reward
from prefspark.schema import require_columns

SIDES = ("chosen", "rejected")


def add_margin(df: DataFrame, name: str = "margin", policy: str = "policy", reference: str = "ref") -> DataFrame:
    """Implicit margin of two models' log-prob columns."""
    cols = [f"{m}_{s}_logprob" for m in (policy, reference) for s in SIDES]
    require_columns(df, *cols)
    return df.withColumn(name, implicit_margin(*[F.col(c) for c in cols]))


def add_discrepancy(df: DataFrame, im_pos: str = "im_pos", im_inv: str = "im_inv", name: str = "rad") -> DataFrame:
    """Difference of the margins of the forward and the inverse model against one reference."""
    return df.withColumn(name, F.col(im_pos) - F.col(im_inv))


def ref_logprob_features(df: DataFrame) -> DataFrame:
    """Per-token likelihood features of both answers under the reference model.

    Empty answers are filtered first and the division is guarded as well: filter order is no
    guarantee against an ANSI division error.
    """
    require_columns(df, "ref_chosen_logprob", "ref_rejected_logprob", "chosen_len", "rejected_len")
    out = df.where((F.col("chosen_len") > 0) & (F.col("rejected_len") > 0))
    avg = {s: F.try_divide(f"ref_{s}_logprob", f"{s}_len") for s in SIDES}
    out = out.withColumns(
        {
            **{f"original_{s}_logprobs": F.col(f"ref_{s}_logprob") for s in SIDES},
            **{f"original_avg_{s}_logprobs": avg[s] for s in SIDES},
            **{f"original_{s}_ppl": F.exp(-avg[s]) for s in SIDES},
            "ang": avg["rejected"] - avg["chosen"],
            "original_avg_logprobs_gap": avg["chosen"] - avg["rejected"],
        }
    )
    return out.withColumn("original_ppl_gap", F.col("original_chosen_ppl") - F.col("original_rejected_ppl"))


def implicit_rewards(df: DataFrame, beta: float) -> DataFrame:
    return df.withColumns(
        {
            f"{s}_reward": implicit_reward(F.col(f"policy_{s}_logprob"), F.col(f"ref_{s}_logprob"), beta)
            for s in SIDES
        }
    )
