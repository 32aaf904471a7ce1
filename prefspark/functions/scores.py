"""Preference and rollout score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefspark.functions.arrays import (
    array_sum,
    as_double,
    drop_first,
    last_one_index,
    log_sum_exp,
    masked_mean,
    masked_sum,
)
from prefspark.functions.scalars import bind, clip, lit_or_col, safe_div
from prefspark.schema import null_if_nan

# Joint-probability clip range, judge-score threshold of the rejected-length selector,
# discrepancy threshold per model family.
JOINT_LOW = -2.0
JOINT_HIGH = 30.0
RIP_THRESHOLD = 0.126
MODEL_TAU = {"qwen": 20.0, "llama": 20.0, "mistral": 80.0}
DEFAULT_TAU = 20.0
KL_LIMIT = 10.0


def tau_for_model(model_key: str) -> float:
    return MODEL_TAU.get(model_key, DEFAULT_TAU)


def implicit_margin(policy_chosen, policy_rejected, ref_chosen, ref_rejected) -> Column:
    """How much more the policy prefers chosen over rejected than the reference model does."""
    return (policy_chosen - policy_rejected) - (ref_chosen - ref_rejected)


def normalize_margin(x: Column, low: float = JOINT_LOW, high: float = JOINT_HIGH) -> Column:
    """Clip to [low, high] and scale to [0, 1]."""
    return (clip(x, low, high) - low) / (high - low)


def joint_prob(p: Column, q: Column) -> Column:
    """Agreement of two independent probabilities; NULL where both contradict with certainty."""
    both = p * q
    return safe_div(both, both + (1 - p) * (1 - q))


def disagreement_score(external: Column, implicit: Column) -> Column:
    return F.abs(external) - F.abs(implicit)


def implicit_reward(policy: Column, reference: Column, beta: float) -> Column:
    return beta * (policy - reference)


def span_logprob(token_logp: Column, labels: Column, prompt_len: Column, resp_len: Column, pad_id: int) -> Column:
    """Sum of shifted-token log-probs over the response span, pad labels excluded; 0.0 if empty."""
    start = F.greatest(prompt_len - 1, F.lit(0))
    end = F.least(prompt_len + resp_len - 1, F.size(token_logp))
    width = F.greatest(end - start, F.lit(0))
    kept = F.zip_with(
        F.slice(token_logp, start + 1, width),
        F.slice(labels, start + 1, width),
        lambda logp, label: F.when(label == pad_id, F.lit(0.0)).otherwise(logp),
    )
    return array_sum(kept)


def sequence_logprob(token_logp: Column, mask: Column, prompt_len: Column, average: bool = False) -> Column:
    """Masked sum (or mean) of log-probs behind the first ``prompt_len`` positions.

    ``mask`` covers the whole sequence, one cell more than the shifted log-probs: its first
    ``prompt_len`` cells are zeroed, then the first column is dropped.
    """
    behind = F.transform(mask, lambda m, i: F.when(i < prompt_len, F.lit(0)).otherwise(m.cast("int")))
    kept = drop_first(behind)
    return masked_mean(token_logp, kept) if average else masked_sum(token_logp, kept)


def approx_kl(logp: Column, base: Column, estimator: str = "k1") -> Column:
    """Per-token KL estimate, clamped to ±10."""
    delta = logp - base
    if estimator == "k1":
        kl = delta
    elif estimator == "k2":
        kl = delta * delta / 2.0
    elif estimator == "k3":
        kl = F.exp(-delta) - 1 + delta
    else:
        raise ValueError(f"unknown KL estimator {estimator!r}")
    return clip(kl, -KL_LIMIT, KL_LIMIT)


def approx_kl_tokens(logp: Column, base: Column, estimator: str = "k1") -> Column:
    """:func:`approx_kl` over two arrays."""
    return F.zip_with(logp, base, lambda a, b: approx_kl(a, b, estimator))


def per_token_reward(reward: Column, kl: Column, mask: Column, kl_coef=0.0, clip_range=None) -> Column:
    """KL penalty on every token plus the (clipped) sequence reward on the last action token."""
    coef = F.greatest(lit_or_col(kl_coef).cast("double"), F.lit(0.0))
    if clip_range:
        reward = clip(reward, *clip_range)
    last, n = last_one_index(mask), F.size(kl)
    # No lambda inside a lambda: Spark does not plan a Python scan over such an argument.
    final = F.concat(
        F.array_repeat(F.lit(0.0), last), F.array(reward.cast("double")), F.array_repeat(F.lit(0.0), n - last - 1)
    )
    return F.when(n > 0, F.zip_with(kl, final, lambda x, r: r - coef * x)).otherwise(kl)


def overlong_penalty(length: Column, max_len: int, buffer: int, factor: float = 1.0) -> Column:
    """Non-positive shaping term growing over the last ``buffer`` tokens before ``max_len``."""
    if max_len < buffer:
        raise ValueError("max_len must not be smaller than the overlong buffer")
    excess = F.least(length - (max_len - buffer), F.lit(buffer))
    return F.when(excess > 0, -excess / buffer * factor).otherwise(F.lit(0.0))


def token_logprob(logits: Column, label: Column, temperature: float = 1.0) -> Column:
    """Log-probability of the (0-based) ``label`` under a logit array."""
    scaled = F.transform(as_double(logits), lambda x: x / temperature)
    return F.get(scaled, label) - log_sum_exp(scaled)


def entropy(logits: Column) -> Column:
    """Entropy of the softmax of a logit array."""
    x = as_double(logits)
    return bind(log_sum_exp(x), lambda z: z - array_sum(F.transform(x, lambda v: F.exp(v - z) * v)))


def joint_score(em: Column, im: Column, low: float = JOINT_LOW, high: float = JOINT_HIGH) -> Column:
    return null_if_nan(joint_prob(normalize_margin(em, low, high), normalize_margin(im, low, high)))
