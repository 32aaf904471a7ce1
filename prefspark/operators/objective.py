"""Objective metrics as aggregates over log-probability tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.functions import arrays as A
from prefspark.functions import losses as L
from prefspark.functions.scalars import bind, safe_div, sigmoid

LOGPS = [f"{m}_{s}_logprob" for m in ("policy", "ref") for s in ("chosen", "rejected")]


def _logps() -> list[Column]:
    return [F.col(n) for n in LOGPS]


def dpo_loss(df: DataFrame, beta: float, smoothing: float = 0.0) -> DataFrame:
    return df.withColumn("loss", L.dpo(*_logps(), beta, smoothing))


def ipo_loss(df: DataFrame, beta: float) -> DataFrame:
    return df.withColumn("loss", L.ipo(*_logps(), beta))


def mean_loss(df: DataFrame, loss: str = "loss") -> DataFrame:
    return df.agg(F.avg(loss).alias("loss"))


def kto_loss(df: DataFrame, beta: float, w_good: float = 1.0, w_bad: float = 1.0, kl: Column | None = None) -> DataFrame:
    """Mean weighted loss over labels 1 and 0; the KL term is the clamped mean over label -1.

    ``kl`` overrides the per-row KL difference for tables that carry it beside each sample.
    """
    delta = F.col("policy_logp") - F.col("ref_logp")
    term = F.avg(F.when(F.col("label") == -1, delta) if kl is None else kl)
    kl_value = df.agg(F.greatest(F.coalesce(term, F.lit(0.0)), F.lit(0.0))).scalar()
    loss = L.kto(F.col("policy_logp"), F.col("ref_logp"), F.col("label"), kl_value, beta, w_good, w_bad)
    return df.agg(F.avg(loss).alias("loss"), F.max(kl_value).alias("kl"))


def kto_even_loss(df: DataFrame, beta: float) -> DataFrame:
    """Paired form: each side is compared with the clamped mean log-ratio of the other."""
    chosen = F.col("policy_chosen_logprob") - F.col("ref_chosen_logprob")
    rejected = F.col("policy_rejected_logprob") - F.col("ref_rejected_logprob")
    clamped = [F.greatest(F.avg(x), F.lit(0.0)).alias(n) for x, n in ((chosen, "c"), (rejected, "r"))]
    kl = df.agg(F.struct(*clamped)).scalar()
    both = F.array(1 - sigmoid(beta * (chosen - kl["r"])), 1 - sigmoid(beta * (kl["c"] - rejected)))
    return df.select(F.explode(both).alias("loss")).agg(F.avg("loss").alias("loss"))


def _token_or_sequence_mean(df: DataFrame, values: Column, mask: str, token_level: bool, name: str) -> Column:
    """Aggregate: masked mean over all tokens, or mean over the rows' masked means."""
    m = F.col(mask)
    if token_level:
        return safe_div(F.sum(A.masked_sum(values, m)), F.sum(A.array_sum(A.as_double(m)))).alias(name)
    return F.avg(A.masked_mean(values, m)).alias(name)


def ppo_metrics(
    df: DataFrame,
    low: float = 0.2,
    high: float = 0.2,
    dual_clip: float | None = None,
    token_level: bool = True,
    kind: str = "ppo",
    weight_cap: float | None = None,
) -> DataFrame:
    """Policy loss, clip ratio and KL of rollout rows.

    Columns: ``logprobs``, ``old_logprobs``, ``advantages``, ``action_mask`` and, with
    ``weight_cap``, ``rollout_logprobs``. ``gspo`` uses one ratio per sequence and a sequence mean.
    """
    if kind not in ("ppo", "gspo"):
        raise ValueError(f"unknown policy loss {kind!r}")
    old = "rollout_logprobs" if kind == "gspo" and weight_cap is not None else "old_logprobs"
    log_ratio = A.sub(F.col("logprobs"), F.col(old))
    if kind == "ppo":
        ratio = F.transform(log_ratio, F.exp)
    else:
        token_level = False
        per_seq = L.sequence_ratio(F.col("logprobs"), F.col(old), F.col("action_mask"))
        mask = A.as_double(F.col("action_mask"))
        ratio = bind(per_seq, lambda r: F.transform(mask, lambda m: r * m))
    rows = df.withColumns({"_ratio": ratio, "_log_ratio": log_ratio})
    pairs = F.arrays_zip(F.col("_ratio").alias("r"), F.col("advantages").alias("a"))
    loss = F.transform(pairs, lambda x: L.clipped_surrogate(x["r"], x["a"], low, high, dual_clip))
    clipped = F.transform(pairs, lambda x: L.is_clipped(x["r"], x["a"], low, high))
    corrected = kind == "ppo" and weight_cap is not None
    if corrected:
        weight = F.zip_with("old_logprobs", "rollout_logprobs", lambda o, r: L.truncated_weight(o, r, weight_cap))
        loss = A.mul(weight, loss)
    mask = "action_mask"
    metrics = [
        _token_or_sequence_mean(rows, loss, mask, token_level, "loss"),
        _token_or_sequence_mean(rows, clipped, mask, True, "clip_ratio"),
        _token_or_sequence_mean(rows, F.transform("_log_ratio", lambda x: -x), mask, True, "ppo_kl"),
    ]
    if corrected:
        gap = A.sub(F.col("rollout_logprobs"), F.col("old_logprobs"))
        metrics.append(_token_or_sequence_mean(rows, gap, mask, True, "rollout_kl"))
    return rows.agg(*metrics)


def value_loss(df: DataFrame, clip_eps: float | None = None, token_level: bool = True) -> DataFrame:
    """Half the (clipped) mean squared value error."""
    cells = F.arrays_zip(F.col("values").alias("v"), F.col("old_values").alias("o"), F.col("returns").alias("r"))
    error = F.transform(cells, lambda x: L.value_error(x["v"], x["o"], x["r"], clip_eps))
    total = _token_or_sequence_mean(df, error, "action_mask", token_level, "_mean")
    return df.agg(total).select((F.col("_mean") * 0.5).alias("loss"))


def sft_loss(df: DataFrame, token_level: bool = True, logprobs: str = "logprobs", mask: str = "loss_mask") -> DataFrame:
    nll = F.transform(logprobs, lambda x: -x)
    return df.agg(_token_or_sequence_mean(df, nll, mask, token_level, "loss"))


def lm_loss(df: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    """Mean cross-entropy of a token table over labels that are not ignored."""
    return df.agg(F.avg(L.cross_entropy(F.col(logits), F.col(label))).alias("loss"))


def distillation_loss(
    df: DataFrame, kd_coef: float = 1.0, logits: str = "logits", teacher: str = "teacher_logits", label: str = "label"
) -> DataFrame:
    """Distillation and language-model loss of a token table and their mix."""
    counted = F.col(label) != L.IGNORE_LABEL
    kd = F.avg(F.when(counted, L.distillation(F.col(logits), F.col(teacher))))
    lm = F.avg(L.cross_entropy(F.col(logits), F.col(label)))
    out = df.agg(kd.alias("distil_loss"), lm.alias("lm_loss"))
    return out.withColumn("loss", F.col("lm_loss") * (1 - kd_coef) + F.col("distil_loss") * kd_coef)


def process_reward_loss(df: DataFrame, soft: bool, logits: str = "logits", label: str = "label") -> DataFrame:
    """Cross-entropy and accuracy over the reward-token logits of placeholder rows.

    Hard labels are indices into the reward tokens; soft labels are the probability of the first.
    """
    x, y = F.col(logits), F.col(label)
    rows = df.where(y != L.IGNORE_LABEL)
    if soft:
        # the first of two equal targets wins, as in an argmax
        loss, target = L.soft_cross_entropy(x, y), F.when(y >= 0.5, F.lit(0)).otherwise(F.lit(1))
    else:
        loss, target = L.cross_entropy(x, y.cast("int")), y.cast("int")
    hit = (L.arg_max(x) == target).cast("double")
    return rows.agg(F.avg(loss).alias("loss"), F.avg(hit).alias("acc"))


def combined_objective(df: DataFrame, beta: float, nll_coef: float, chosen_nll: str) -> DataFrame:
    """Preference loss plus a weighted NLL of the chosen answers."""
    return dpo_loss(df, beta).agg(
        F.avg("loss").alias("preference_loss"), F.avg(chosen_nll).alias("nll_loss")
    ).withColumn("loss", F.col("preference_loss") + nll_coef * F.col("nll_loss"))
