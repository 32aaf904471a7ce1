"""Objective values per row (or per token), evaluated offline over log-probability tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefspark.functions.arrays import array_sum, as_double, log_sum_exp, masked_mean
from prefspark.functions.scalars import bind, clip, log_sigmoid, sigmoid, softplus
from prefspark.functions.scores import implicit_margin

IGNORE_LABEL = -100


def dpo(policy_chosen, policy_rejected, ref_chosen, ref_rejected, beta: float, smoothing: float = 0.0) -> Column:
    h = implicit_margin(policy_chosen, policy_rejected, ref_chosen, ref_rejected)
    return -log_sigmoid(beta * h) * (1 - smoothing) - log_sigmoid(-beta * h) * smoothing


def ipo(policy_chosen, policy_rejected, ref_chosen, ref_rejected, beta: float) -> Column:
    gap = implicit_margin(policy_chosen, policy_rejected, ref_chosen, ref_rejected) - 1 / (2 * beta)
    return gap * gap


def pairwise(chosen: Column, rejected: Column, margin: Column | None = None) -> Column:
    gap = chosen - rejected
    return -log_sigmoid(gap if margin is None else gap - margin)


def log_exp(chosen: Column, rejected: Column) -> Column:
    return softplus(rejected - chosen)


def kto(policy: Column, reference: Column, label: Column, kl: Column, beta: float, w_good=1.0, w_bad=1.0) -> Column:
    """Weighted value of a desirable (1) or undesirable (0) sample; NULL for any other label."""
    delta = policy - reference
    return F.when(label == 1, w_good * (1 - sigmoid(beta * (delta - kl)))).when(
        label == 0, w_bad * (1 - sigmoid(beta * (kl - delta)))
    )


def clipped_surrogate(ratio: Column, advantage: Column, low=0.2, high=0.2, dual_clip=None) -> Column:
    """Per-token clipped policy loss."""
    if dual_clip is not None and dual_clip <= 1.0:
        raise ValueError("dual_clip must be greater than 1")
    smaller = F.least(ratio * advantage, clip(ratio, 1 - low, 1 + high) * advantage)
    if dual_clip is None:
        return -smaller
    return -F.when(advantage < 0, F.greatest(smaller, dual_clip * advantage)).otherwise(smaller)


def is_clipped(ratio: Column, advantage: Column, low=0.2, high=0.2) -> Column:
    """1.0 where clipping makes the surrogate smaller."""
    return (clip(ratio, 1 - low, 1 + high) * advantage < ratio * advantage).cast("double")


def sequence_ratio(logp: Column, old: Column, mask: Column) -> Column:
    """exp of the mean masked log-ratio of a sequence."""
    return F.exp(masked_mean(F.zip_with(logp, old, lambda a, b: a - b), mask))


def truncated_weight(old: Column, rollout: Column, cap: float) -> Column:
    """Importance weight of the training over the sampling policy, capped."""
    return F.least(F.exp(old - rollout), F.lit(cap))


def value_error(value: Column, old: Column, ret: Column, clip_eps: float | None = None) -> Column:
    """Squared value error, pessimistic under clipping, before the factor one half."""
    plain = (value - ret) * (value - ret)
    if clip_eps is None:
        return plain
    moved = old + clip(value - old, -clip_eps, clip_eps) - ret
    return F.greatest(moved * moved, plain)


def cross_entropy(logits: Column, label: Column) -> Column:
    """NLL of a 0-based label; NULL at the ignore label."""
    x = as_double(logits)
    return F.when(label != IGNORE_LABEL, log_sum_exp(x) - F.get(x, label))


def distillation(logits: Column, teacher: Column) -> Column:
    """-Σ p_teacher ln p_student over one position; infinite student logits contribute nothing."""
    student, taught = as_double(logits), as_double(teacher)

    def terms(zs: Column, zt: Column) -> Column:
        return F.zip_with(
            student,
            taught,
            lambda s, t: F.when(F.abs(s) == F.lit(float("inf")), F.lit(0.0)).otherwise(F.exp(t - zt) * (s - zs)),
        )

    sums = F.struct(log_sum_exp(student).alias("s"), log_sum_exp(taught).alias("t"))
    return bind(sums, lambda z: -array_sum(terms(z["s"], z["t"])))


def soft_cross_entropy(logits: Column, positive: Column) -> Column:
    """Cross-entropy of two reward-token logits against the target (p, 1 - p)."""
    x = as_double(logits)
    z = log_sum_exp(x)
    return positive * (z - F.get(x, F.lit(0))) + (1 - positive) * (z - F.get(x, F.lit(1)))


def arg_max(logits: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")
