"""Raw preference records to flat prompt / chosen / rejected pairs. Projections and filters only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.functions import messages as M
from prefspark.schema import PAIR_KEY, field_type, require_columns


Texts = tuple[Column, Column, Column]


def raw_texts(df: DataFrame, flip: bool = False) -> Texts:
    """Prompt, chosen and rejected of a raw record."""
    sides = M.assistant_text(df, "chosen"), M.assistant_text(df, "rejected")
    return M.user_text(df), *(reversed(sides) if flip else sides)


def share_texts(df: DataFrame) -> Texts:
    """Prompt, chosen and rejected of a ShareGPT record."""
    return M.share_prompt(df), M.share_text(df, "chosen"), M.share_text(df, "rejected")


def usable(prompt: Column, chosen: Column, rejected: Column) -> Column:
    """All texts present and the answers different."""
    return (prompt != "") & (chosen != "") & (rejected != "") & (chosen != rejected)


def _emit(df: DataFrame, readings: list[Texts], keep, counts: Observation | None, swap: bool = False) -> DataFrame:
    """Texts of the first usable reading of each record."""
    names = [[f"_{part}{i}" for part in PAIR_KEY] for i in range(len(readings))]
    fields = [c.alias(n) for texts, row in zip(readings, names) for c, n in zip(texts, row)]
    # The generator keeps the optimizer from copying the extraction into the filter and every output.
    out = df.select(*keep, F.inline(F.array(F.struct(*fields))))
    good = [F.coalesce(usable(*map(F.col, row)), F.lit(False)) for row in names]
    kept = reduce(lambda a, b: a | b, good)
    if counts is not None:
        out = out.observe(counts, F.count_if(kept).alias("kept"), F.count_if(~kept).alias("skipped"))
    columns = []
    for j in range(3):
        value = F.col(names[-1][j])
        for ok, row in zip(good[-2::-1], names[-2::-1]):
            value = F.when(ok, F.col(row[j])).otherwise(value)
        columns.append(value)
    prompt, chosen, rejected = columns
    first, second = (rejected, chosen) if swap else (chosen, rejected)
    return out.where(kept).select(*keep, prompt.alias("prompt"), first.alias("chosen"), second.alias("rejected"))


def to_preference_pairs(df: DataFrame, flip: bool = False, keep=(), counts: Observation | None = None) -> DataFrame:
    """Raw records to pairs; unusable records are dropped and counted in ``counts``.

    The observed counts are exact when the plan runs once (a global sort behind it samples its
    input in an extra run); :func:`conversion_counts` is the plain aggregate.
    """
    return _emit(df, [raw_texts(df, flip)], list(keep), counts)


def sharegpt_to_pairs(df: DataFrame, keep=(), counts: Observation | None = None) -> DataFrame:
    return _emit(df, [share_texts(df)], list(keep), counts)


def to_flat(df: DataFrame, keep=(), counts: Observation | None = None) -> DataFrame:
    """Mixed records to pairs."""
    return _emit(df, [raw_texts(df), share_texts(df)], list(keep), counts)


def flip_pairs(df: DataFrame, keep=(), counts: Observation | None = None) -> DataFrame:
    """Mixed records to pairs with chosen and rejected swapped."""
    return _emit(df, [raw_texts(df), share_texts(df)], list(keep), counts, swap=True)


def conversion_counts(df: DataFrame, texts: Texts) -> DataFrame:
    """Kept and skipped records as a one-row table."""
    kept = F.count_if(usable(*texts))
    return df.agg(kept.alias("kept"), (F.count(F.lit(1)) - kept).alias("skipped"))


def normalize_text_columns(df: DataFrame, cols=("chosen", "rejected")) -> DataFrame:
    """Non-string answers become text: JSON for nested values, a plain cast otherwise."""
    changes = {}
    for name in cols:
        kind = field_type(df, name)
        if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            changes[name] = F.to_json(F.col(name))
        elif not isinstance(kind, T.StringType):
            changes[name] = F.col(name).cast("string")
    return df.withColumns(changes) if changes else df


def drop_incomplete(df: DataFrame, keys=("prompt",)) -> DataFrame:
    return df.na.drop(subset=list(keys))


def select_fields(df: DataFrame, fields) -> DataFrame:
    return require_columns(df, *fields).select(*fields)


def load_pairs(df: DataFrame) -> DataFrame:
    """Rows with all three texts present."""
    return df.na.drop(subset=PAIR_KEY)
