"""Small numeric and string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's notion of whitespace: Unicode White_Space plus the four ASCII separators.
_BLANK = r"[\s\x1c-\x1f]"


def lit_or_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def strip(x: Column) -> Column:
    """Remove Unicode whitespace at both ends (Spark ``trim`` removes blanks only)."""
    return F.regexp_replace(x, rf"(?U)^{_BLANK}+|{_BLANK}+\z", "")


def non_empty(x: Column) -> Column:
    """NULL for the empty string."""
    return F.nullif(x, F.lit(""))


def safe_div(a, b) -> Column:
    """NULL on a zero divisor, also in ANSI mode."""
    return F.try_divide(lit_or_col(a), lit_or_col(b))


def clip(x: Column, low=None, high=None) -> Column:
    """Clamp to [low, high]; NULL stays NULL (``least``/``greatest`` would skip it)."""
    out = x
    if low is not None:
        out = F.greatest(out, lit_or_col(low))
    if high is not None:
        out = F.least(out, lit_or_col(high))
    return F.when(x.isNotNull(), out)


def log_sigmoid(x: Column) -> Column:
    """Stable ln(1 / (1 + e^-x))."""
    return -(F.greatest(F.lit(0.0), -x) + F.log1p(F.exp(-F.abs(x))))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softplus(x: Column) -> Column:
    """Stable ln(1 + e^x)."""
    return -log_sigmoid(-x)


def floor_div(a: Column, b) -> Column:
    """Integer quotient of non-negative integers, as a long."""
    return F.call_function("div", a, lit_or_col(b))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    An expression captured by a higher-order function is evaluated for every element; a lambda
    variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def drawn(seed: int, *cols) -> Column:
    """A repeatable draw below 2^60 for a row: the first 15 hexadecimal digits of an MD5 digest."""
    named = [c if isinstance(c, Column) else F.col(c) for c in cols]
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in named])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
