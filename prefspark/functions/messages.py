"""Text and role of chat messages, and the user / assistant side of a raw preference record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.functions.scalars import non_empty, strip
from prefspark.schema import as_message, as_messages, field_type

USER_ROLES = ("user", "human")
ASSISTANT_ROLES = ("assistant", "gpt", "")


def message_text(m: Column) -> Column:
    """``content``, else ``value``, else the empty string."""
    return F.coalesce(non_empty(m["content"]), non_empty(m["value"]), F.lit(""))


def message_role(m: Column) -> Column:
    """Lower-cased ``role``, else ``from``, else the empty string."""
    return F.lower(F.coalesce(non_empty(m["role"]), non_empty(m["from"]), F.lit("")))


def turn_text(m: Column) -> Column:
    """ShareGPT turns prefer ``value`` over ``content``."""
    return F.coalesce(non_empty(m["value"]), non_empty(m["content"]), F.lit(""))


def user_text(df: DataFrame) -> Column:
    """Stripped instruction or prompt; else the first user message of ``chosen``, then ``rejected``.

    A blank but non-empty instruction hides the prompt, and the first user message wins even when
    its text is empty.
    """
    stated = F.lit(None).cast("string")
    for name in ("prompt", "instruction"):
        if isinstance(field_type(df, name), T.StringType):
            stated = F.coalesce(non_empty(F.col(name)), stated)
    options = [non_empty(strip(stated))]
    options += [found for name in ("chosen", "rejected") if (found := _first_user(df, name)) is not None]
    return F.coalesce(*options, F.lit(""))


def _first_user(df: DataFrame, name: str) -> Column | None:
    kind = field_type(df, name)
    if isinstance(kind, T.ArrayType):
        hits = F.filter(as_messages(df, name), lambda m: message_role(m).isin(*USER_ROLES))
        return F.get(F.transform(hits, message_text), F.lit(0))
    if isinstance(kind, T.StructType):
        m = as_message(df, name)
        return F.when(message_role(m).isin(*USER_ROLES), message_text(m))
    return None


def assistant_text(df: DataFrame, name: str) -> Column:
    """A string as it is; a message's text; of a list the last assistant-like message, else the last."""
    kind = field_type(df, name)
    if isinstance(kind, T.ArrayType):
        messages = as_messages(df, name)
        replies = F.filter(messages, lambda m: message_role(m).isin(*ASSISTANT_ROLES))
        last = [F.try_element_at(F.transform(m, message_text), F.lit(-1)) for m in (replies, messages)]
        return F.coalesce(*last, F.lit(""))
    if isinstance(kind, T.StructType):
        return message_text(as_message(df, name))
    if isinstance(kind, T.StringType):
        return F.coalesce(F.col(name), F.lit(""))
    return F.lit("")


def share_text(df: DataFrame, name: str) -> Column:
    """Stripped ShareGPT answer; NULL for list values, which that layout does not have."""
    kind = field_type(df, name)
    if isinstance(kind, T.StructType):
        return strip(turn_text(as_message(df, name)))
    if isinstance(kind, T.StringType):
        return F.coalesce(strip(F.col(name)), F.lit(""))
    return F.lit(None).cast("string")


def share_prompt(df: DataFrame) -> Column:
    """Stripped first conversation turn, else the stripped prompt."""
    options = []
    if isinstance(field_type(df, "conversations"), T.ArrayType):
        turns = F.transform(as_messages(df, "conversations"), turn_text)
        options.append(non_empty(strip(F.get(turns, F.lit(0)))))
    if isinstance(field_type(df, "prompt"), T.StringType):
        options.append(strip(F.col("prompt")))
    return F.coalesce(*options, F.lit(""))
