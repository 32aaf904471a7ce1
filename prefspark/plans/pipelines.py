"""End-to-end pipelines: subset selection, margin scoring, response post-processing, rollouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.functions.scores import tau_for_model
from prefspark.functions.tokens import Tokenizer, WhitespaceTokenizer
from prefspark.operators import advantages, features, joins, normalize, reward, select, shaping
from prefspark.schema import PAIR_KEY
from prefspark.session import materialize
from prefspark.sources.writers import write_subset


def prepare_features(
    im: DataFrame,
    rad: DataFrame | None = None,
    em: DataFrame | None = None,
    tokenizer: Tokenizer | None = None,
    need_rad: bool = True,
) -> DataFrame:
    """Complete pairs with discrepancy, judge scores, token lengths and likelihood features.

    Pairs without a ``pair_id`` get a hash of their texts: it only breaks ties, and equal texts are
    interchangeable.
    """
    out = normalize.load_pairs(im)
    if "pair_id" not in out.columns:
        out = out.withColumn("pair_id", F.xxhash64(*PAIR_KEY))
    if need_rad:
        if rad is None:
            raise ValueError("stage one needs discrepancy margins")
        out = joins.merge_im_rad(out, normalize.load_pairs(rad))
    if em is not None:
        out = joins.merge_em(out, normalize.load_pairs(em))
    out = shaping.token_lengths(out, tokenizer or WhitespaceTokenizer())
    return features.ref_logprob_features(out)


def check_methods(df: DataFrame, methods: list[str], stage1: bool = True) -> None:
    """Fail before any work when a method's score columns are missing."""
    if any(m in select.EM_METHODS for m in methods) and not {"em", "em_margin"} & set(df.columns):
        raise ValueError("judge-score methods need an em or em_margin column")
    if stage1 and "rad_ang" in methods and not {"rad", "margin"} & set(df.columns):
        raise ValueError("stage one needs a rad or margin column")


def select_subset(
    df: DataFrame, method: str, k: int, tau: float, stage1: bool = True, descending: bool = True,
    curriculum: str = "none",
) -> DataFrame:
    """Subset of one method in training order."""
    if method != "rad_ang":
        out = select.SELECTORS[method](df, k)
    elif stage1:
        out = select.select_rad_ang(df, k, tau, descending=descending)
    else:
        out = select.rank_by_ang(df, k, descending)
    return select.order_curriculum(out, curriculum)


def build_subsets(
    df: DataFrame,
    methods: str,
    out_dir: str,
    k: int,
    model_key: str = "qwen",
    tau: float | None = None,
    stage1: bool = True,
    descending: bool = True,
    curriculum: str = "none",
) -> dict[str, str]:
    """Write one subset per method; returns method to path.

    The feature table is written once to the shared folder: the join and the features are not
    repeated, and every method first finds its cut on one column of it. Names carry the requested
    ``k`` even when fewer rows exist.
    """
    names = select.parse_methods(methods)
    check_methods(df, names, stage1)
    tau = tau_for_model(model_key) if tau is None else tau
    base = materialize(df, "features")
    paths = {}
    for name in names:
        subset = select_subset(base, name, k, tau, stage1, descending, curriculum)
        if "position" in subset.columns:
            subset = subset.orderBy("position")
        tagged = tau if name == "rad_ang" and stage1 else None
        paths[name] = write_subset(subset, out_dir, name, k, tagged)
    return paths


def score_margins(pairs: DataFrame, make_scorer, save_rad: bool = False) -> DataFrame:
    """Log-probs of two models per pair and their margin; ``save_rad`` repeats it as ``rad``."""
    scored = features.add_margin(reward.score_pairs(normalize.load_pairs(pairs), make_scorer))
    return scored.withColumn("rad", F.col("margin")) if save_rad else scored


def post_process(responses: DataFrame, processor: str, **options) -> tuple[DataFrame, DataFrame]:
    """Reward summary and the post-processed responses."""
    return reward.reward_summary(responses), reward.get_processor(processor)(responses, **options)


def rollout_experience(
    samples: DataFrame, n: int, estimator: str, score_range: tuple[float, float] | None = None, **options
) -> DataFrame:
    """Filtered rollout rows with normalised token advantages."""
    if score_range:
        samples = select.dynamic_filter(samples, n, *score_range)
    out = advantages.compute_advantages(samples, estimator, **options)
    return advantages.normalize_advantages_global(out) if estimator in advantages.NORMALIZED else out
