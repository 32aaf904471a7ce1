"""Token counts of texts of any length, by overlapping chunks that are spliced where they provably agree.

White space ends every unit that the tokenizer looks at (its normaliser, its pre-tokenizer and its added
tokens never reach across), so what follows a white space is encoded alike whatever stands before it: such a
position is a stable boundary. A huge text is encoded in chunks that overlap, with offsets; a chunk and the
next are spliced at a white space of their overlap at which no token of either straddles and after which the
tokens of both agree up to the next white space. Where the overlap has none, it is widened, in the end to the
whole rest. A text of up to one chunk is cut at all its stable boundaries, and each distinct piece is encoded
by the library once per worker and remembered.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame

from prefspark.llm.common import PieceMemo, held, vocabulary_path

CHUNK_CHARS = 65_536
OVERLAP_CHARS = 1_024


def load(name: str):
    """The library's tokenizer without truncation and padding, in one thread per task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(vocabulary_path(name))
    found.no_truncation()
    found.no_padding()
    return found


def _is_space(c: str) -> bool:
    return c.isspace() and not "\x1c" <= c <= "\x1f"


def _encode(tokenizer, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
    """(id, start, end) of the tokens of a chunk, in places of the whole text."""
    got = tokenizer.encode(text[start:end], add_special_tokens=False)
    return [(i, start + a, start + b) for i, (a, b) in zip(got.ids, got.offsets)]


def splice_at(text: str, left: list, right: list, low: int, high: int) -> tuple[int, int, int] | None:
    """A stable boundary of the overlap ``[low, high)``: (place, tokens of ``left`` before it, of ``right``).

    The overlap's first and last units may be cut by the chunks' ends, so a boundary needs white space before
    the last of them on either side.
    """
    spaces = [p for p in range(low + 1, high) if _is_space(text[p])]
    for p, q in zip(spaces[len(spaces) // 2 :], spaces[len(spaces) // 2 + 1 :]):
        a = next((k for k in range(len(left) - 1, -1, -1) if left[k][1] < p), -1) + 1
        b = next((k for k, t in enumerate(right) if t[1] >= p), len(right))
        straddles = (a and left[a - 1][2] > p) or (b and right[b - 1][2] > p)
        between = [[t for t in side if t[1] < q] for side in (left[a:], right[b:])]
        if not straddles and between[0] == between[1]:
            return p, a, b
    return None


def chunked_ids(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[list[int], int]:
    """Ids of the whole text, and how often an overlap had to be widened."""
    out: list[int] = []
    widened = start = skip = 0
    left = None
    while True:
        end = start + chunk
        if left is None:
            left = _encode(tokenizer, text, start, min(end, len(text)))[skip:]
        if end >= len(text):
            return out + [t[0] for t in left], widened
        width, size = min(overlap, chunk // 2), chunk
        while True:
            low = end - width
            right = _encode(tokenizer, text, low, min(low + chunk, len(text)))
            found = splice_at(text, left, right, low, end)
            if found:
                break
            widened += 1
            if width * 2 <= size // 2:
                width *= 2
            else:  # no white space in half a chunk: this chunk itself grows
                size *= 2
                end = start + size
                left = _encode(tokenizer, text, start, min(end, len(text)))[skip:]
                if end >= len(text):
                    return out + [t[0] for t in left], widened
                width = min(width * 2, size // 2)
        _, a, b = found
        out += [t[0] for t in left[:a]]
        start, skip, left = low, b, right[b:]


def _counter(vocabulary: str):
    """The tokenizer and its remembered counts of pieces."""
    tokenizer = load(vocabulary)
    return tokenizer, PieceMemo(lambda new: [len(e) for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)])


def token_counts(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    vocabulary: str = "word_bpe_49k.json",
    limit: int = 2_048,
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """Per row: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` and ``widened``.

    Row-local: no shuffle. A NULL text counts as empty: no bytes, no tokens. Repeated rows give repeated rows,
    an empty table an empty result; other columns, whatever their names, are not read.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        tokenizer, memo = held(f"token counts {vocabulary}", lambda: _counter(vocabulary))
        for batch in batches:
            rows = []
            texts = batch.column(text).to_pylist()
            counts = memo.texts([t if t and len(t) <= chunk else None for t in texts])
            for value, found in zip(texts, counts):
                value = value or ""
                if len(value) <= chunk:
                    n, widened = sum(found), 0
                else:
                    ids, widened = chunked_ids(tokenizer, value, chunk, overlap)
                    n = len(ids)
                rows.append((len(value.encode()), n, n > limit, widened))
            n_bytes, n_tokens, over, widened = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(n_tokens, pa.int64()),
                    pa.array(over, pa.bool_()),
                    pa.array(widened, pa.int32()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "widened"],
            )

    schema = f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean, widened int"
    return df.select(id_col, text).mapInArrow(run, schema)
