"""Declared record layouts and plan-time column checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("role", "content", "from", "value")]
)
MESSAGES = T.ArrayType(MESSAGE)

PAIR = T.StructType([T.StructField(n, T.StringType()) for n in ("prompt", "chosen", "rejected")])
PAIR_KEY = ["prompt", "chosen", "rejected"]

RAW_STRINGS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("instruction", "prompt", "chosen", "rejected")]
)
RAW_MESSAGES = T.StructType(
    [
        T.StructField("instruction", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("chosen", MESSAGES),
        T.StructField("rejected", MESSAGES),
    ]
)
SHAREGPT = T.StructType(
    [
        T.StructField("conversations", MESSAGES),
        T.StructField("prompt", T.StringType()),
        T.StructField("chosen", MESSAGE),
        T.StructField("rejected", MESSAGE),
    ]
)
_LOGPROBS = [
    "policy_chosen_logprob",
    "policy_rejected_logprob",
    "ref_chosen_logprob",
    "ref_rejected_logprob",
]
IM_MARGINS = T.StructType(
    list(PAIR.fields) + [T.StructField(n, T.DoubleType()) for n in (*_LOGPROBS, "margin")]
)
# A margin file of the inverse run that has no ``rad`` of its own is read as IM_MARGINS: a declared
# column that the file lacks would be NULL, not absent.
RAD_MARGINS = T.StructType(list(IM_MARGINS.fields) + [T.StructField("rad", T.DoubleType())])
EM_SCORES = T.StructType(list(PAIR.fields) + [T.StructField("em", T.DoubleType())])
SCORED_RESPONSE = T.StructType(
    [
        T.StructField("input", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("reward", T.DoubleType()),
    ]
)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail while the plan is built when a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; got {df.columns}")
    return df


def first_present(df: DataFrame, *names: str) -> str:
    """The first of ``names`` that ``df`` has."""
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"need one of {list(names)}; got {df.columns}")


def field_type(df: DataFrame, name: str) -> T.DataType | None:
    return df.schema[name].dataType if name in df.columns else None


def nan_to_null(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Missing values are NULL, never NaN: NaN compares greater than everything in Spark."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    todo = floating if cols is None else floating & set(cols)
    return df.withColumns({c: null_if_nan(F.col(c)) for c in todo}) if todo else df


def null_if_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def as_messages(df: DataFrame, name: str) -> Column:
    """Column ``name`` (array of message structs) with the fields of ``MESSAGE``."""
    have = set(field_type(df, name).elementType.fieldNames())
    if have >= set(MESSAGE.fieldNames()):
        return F.col(name)
    return F.transform(F.col(name), lambda m: _canonical(m, have))


def as_message(df: DataFrame, name: str) -> Column:
    """Column ``name`` (one message struct) with the fields of ``MESSAGE``."""
    have = set(field_type(df, name).fieldNames())
    return F.col(name) if have >= set(MESSAGE.fieldNames()) else _canonical(F.col(name), have)


def _canonical(m: Column, have: set[str]) -> Column:
    return F.struct(
        *[(m[n] if n in have else F.lit(None).cast("string")).alias(n) for n in MESSAGE.fieldNames()]
    )
