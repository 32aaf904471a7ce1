"""Tokenizer and chat-template plug-ins."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from dataclasses import dataclass, field
from string import Formatter
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from prefspark.functions.messages import message_role, message_text


class Tokenizer(Protocol):
    eos_token: str
    eos_id: int
    pad_id: int

    def ids(self, text: Column) -> Column:
        """``array<int>`` of token ids."""

    def count(self, text: Column) -> Column:
        """Number of tokens."""

    def encode(self, text: str) -> list[int]:
        """The ids of a Python string, for texts that a hook makes."""


@dataclass(frozen=True)
class WhitespaceTokenizer:
    """Tokens are maximal runs of non-blank characters; pure column expressions.

    Ids are a hash of the token folded into the vocabulary above the two special ids.
    """

    eos_token: str = "</s>"
    eos_id: int = 2
    pad_id: int = 0
    vocab_size: int = 1_000_003
    native = True

    def tokens(self, text: Column) -> Column:
        return F.filter(F.split(text, r"\s+"), lambda t: t != "")

    def ids(self, text: Column) -> Column:
        return F.transform(self.tokens(text), self.token_id)

    def token_id(self, token: Column) -> Column:
        head = F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long")
        hashed = F.pmod(head, F.lit(self.vocab_size - 3)) + 3
        return F.when(token == self.eos_token, F.lit(self.eos_id)).otherwise(hashed).cast("int")

    def count(self, text: Column) -> Column:
        return F.size(self.tokens(text))

    def encode(self, text: str) -> list[int]:
        tokens = text.encode("utf-8", "surrogatepass").split()  # at ASCII white space, as in the plan
        end = self.eos_token.encode()
        hashed = lambda t: int(hashlib.md5(t).hexdigest()[:8], 16) % (self.vocab_size - 3) + 3
        return [self.eos_id if t == end else hashed(t) for t in tokens]

    def goes_on(self, open_: Column, more: Column) -> Column:
        """Whether a token of a text may go on in what follows ``more``; ``open_`` says so of the text before it."""
        return F.when(more == "", open_).otherwise(F.substring(more, -1, 1).rlike(r"\S"))

    def extended(self, n: Column, open_: Column, more: Column) -> Column:
        """Tokens of a text of ``n`` tokens with ``more`` after it."""
        joins = open_ & more.rlike(r"^\S")
        return n + self.count(more) - joins.cast("int")


@dataclass(frozen=True)
class TokenizerFile:
    """A ``tokenizers`` JSON file, run in Arrow batches and loaded once per Python worker."""

    path: str
    eos_token: str
    eos_id: int
    pad_id: int
    add_special_tokens: bool = True
    native = False

    def ids(self, text: Column) -> Column:
        path, special = self.path, self.add_special_tokens

        @F.pandas_udf("array<int>")
        def encode(batch: pd.Series) -> pd.Series:
            encoder = _load_tokenizer(path)
            done = encoder.encode_batch(batch.fillna("").tolist(), add_special_tokens=special)
            return pd.Series([e.ids for e in done])

        return encode(text)

    def count(self, text: Column) -> Column:
        return F.size(self.ids(text))

    def encode(self, text: str) -> list[int]:
        return _load_tokenizer(self.path).encode(text, add_special_tokens=self.add_special_tokens).ids


    def answer_ranges(self, whole: Column, lengths: Column, answers: Column, opening: str, max_len: int) -> Column:
        """Closed token ranges of the answers of conversations, from one encoding of each (see ``Prefixes``)."""
        path = self.path

        @F.arrow_udf("array<struct<start: int, end: int>>")
        def spans(texts: pa.Array, sizes: pa.Array, marks: pa.Array) -> pa.Array:
            encoder = _load_tokenizer(path)
            out = []
            for text, size, mark in zip(texts.to_pylist(), sizes.to_pylist(), marks.to_pylist()):
                out.append(None if text is None else _answer_ranges(encoder, text, size, mark, opening, max_len))
            return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

        return spans(whole, lengths, answers)


class Prefixes:
    """Numbers of tokens of the prefixes of a text, each with some text after it, from one encoding of the whole.

    A prefix is encoded only from a word shortly before its end; what was encoded of the whole stands for the rest if both
    agree on the words in between, else the stretch is doubled, at worst to all of the prefix.
    """

    def __init__(self, encoder, text: str, stretch: int = 64):
        self.encoder, self.text, self.stretch = encoder, text, stretch
        whole = encoder.encode(text, add_special_tokens=False)
        self.ids, self.offsets = whole.ids, whole.offsets
        words = whole.word_ids
        # Where a word begins that ends where its text does not go on: (sign, token).
        self.starts = [(0, 0)] + [(o[0], i) for i, o in enumerate(whole.offsets) if i and words[i] != words[i - 1]]
        self.places = [at for at, _ in self.starts]

    def size(self, end: int, more: str = "") -> int:
        """Tokens of the first ``end`` signs and ``more``."""
        stretch = self.stretch
        while True:
            at, first = self.starts[max(bisect_right(self.places, end - 2 * stretch) - 1, 0)]
            piece = self.encoder.encode(self.text[at:end] + more, add_special_tokens=False)
            if not first:
                return len(piece.ids)
            sure = at + stretch  # words that end before here have to be the same in both
            same = bisect_right(self.places, sure) - 1
            upto = self.starts[same][1] - first
            here = [(a + at, b + at) for a, b in piece.offsets[:upto]]
            if upto and piece.ids[:upto] == self.ids[first : first + upto] and here == self.offsets[first : first + upto]:
                return first + len(piece.ids)
            stretch *= 2


def _answer_ranges(encoder, whole: str, sizes: list[int], answers: list[bool], opening: str, max_len: int) -> list[dict]:
    prefixes, end, out = Prefixes(encoder, whole), 0, []
    for size, answer in zip(sizes, answers):
        if answer:
            start = min(prefixes.size(end, opening), max_len)
            rest = whole[end : end + size][len(opening) :]
            out.append({"start": start, "end": start + min(len(encoder.encode(rest, add_special_tokens=False).ids), max_len) - 1})
        end += size
    return out


_loaded: dict = {}


def _load_tokenizer(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer as FileTokenizer

        _loaded[path] = FileTokenizer.from_file(path)
    return _loaded[path]


@dataclass(frozen=True)
class ChatTemplate:
    """Text before and after each message, by role, and the opening of the answer to generate."""

    prefix: dict[str, str] = field(
        default_factory=lambda: {"system": "<|system|>\n", "user": "<|user|>\n", "assistant": "<|assistant|>\n"}
    )
    suffix: dict[str, str] = field(default_factory=lambda: {"system": "\n", "user": "\n", "assistant": "</s>\n"})
    generation_prompt: str = "<|assistant|>\n"

    def message(self, m: Column) -> Column:
        role = message_role(m)
        return F.concat(_by_role(role, self.prefix), message_text(m), _by_role(role, self.suffix))

    def render(self, messages: Column, add_generation_prompt: bool = False) -> Column:
        text = F.array_join(F.transform(messages, self.message), "")
        return F.concat(text, F.lit(self.generation_prompt)) if add_generation_prompt else text


def _by_role(role: Column, table: dict[str, str]) -> Column:
    out = F.lit("")
    for name, text in table.items():
        out = F.when(role == name, F.lit(text)).otherwise(out)
    return out


def say(role: str, text: Column) -> Column:
    """A one-message struct."""
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(role).alias("role"), text.alias("content"), none.alias("from"), none.alias("value")
    )


def after(full: Column, head: Column) -> Column:
    """``full`` without as many leading characters as ``head`` has."""
    return F.substr(full, F.length(head) + 1)


def fill_template(text: Column, template: str) -> Column:
    """Put ``text`` in the single ``{}`` of a Python format string."""
    fields = [name for _, name, _, _ in Formatter().parse(template) if name is not None]
    if fields != [""]:
        raise ValueError("template needs exactly one {} placeholder")
    # Formatting with a mark no template contains resolves the brace escapes.
    head, tail = template.format("\0").split("\0")
    return F.concat(F.lit(head), text, F.lit(tail))
