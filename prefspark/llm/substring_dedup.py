"""Substring deduplication by level-wise doubling of repeated windows.

Level one looks at windows of half the wanted length, level two at the wanted length, and so on: a window is a
candidate at one level only if its parts repeat at the level before, and its hash comes from theirs. At level
one a sample is enough: of each wanted window only its part with the least hash (a local minimum, about one
part in six) is looked at, and equal windows have equal parts, so no repeat is lost. Candidates get thinner
with every level; ``repeated_passages`` doubles on until none survives.

Blocks of documents answer what they can by themselves; what is left goes through one exchange a level, by
hash, with one record per block and hash. Level one sends 64-bit hashes, where a collision only costs a
candidate; the deciding levels have 128 bits. The text itself is shuffled once, into blocks, and reused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.llm.common import (
    BLOCK_BYTES, SENT, ask, blocked, held, id_array, keep_words, mix, ngrams, pack, parts_for, stored, text_hashes, unpack_answers, words,
)

COVERED, REPEATED = 1, 2
RUN = 1 << 16  # words whose windows are looked at together
WINDOW = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("at", "<i4")])
np.seterr(over="ignore")


class _Block:
    """The windows of one block, over the word hashes of its documents laid end to end.

    Its words are not held, only two hashes of the window at each word; what else there is per word is narrow or made for
    a run of words at a time.
    """

    def __init__(self, group: pa.Table, length: int):
        held("substrings", bool)  # needs no cache, but drops another operator's
        self.length, self.half = length, length // 2
        self.doc_keys = id_array(group["doc_id"])
        h, self.sizes = text_hashes(group["text"])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.a, self.b = (_window_hashes(h, self.half, salt) for salt in (1, 2))
        del h

        # The part of each window with the least mixed hash; the first of equals.
        reach = length - self.half
        self.offset = np.zeros(len(self.doc), np.min_scalar_type(reach))
        marked = np.zeros(len(self.doc), bool)
        for windows in self._window_runs():
            low = windows[0]
            key = mix(self.a[low : windows[-1] + reach + 1], 3)
            best, offset = key[windows - low], np.zeros(len(windows), self.offset.dtype)
            for j in range(1, reach + 1):
                other = key[windows - low + j]
                less = other < best
                best[less], offset[less] = other[less], j
            self.offset[windows] = offset
            marked[windows + offset] = True
        self.anchors = np.flatnonzero(marked)
        self.parts, self.part_of, self.part_count = np.unique(
            self.a[self.anchors], return_inverse=True, return_counts=True
        )

    def _window_runs(self) -> Iterator[np.ndarray]:
        """Where windows of the wanted length start, a run of words at a time."""
        for at in range(0, len(self.doc), RUN):
            windows = at + np.flatnonzero(self.left(np.arange(at, min(at + RUN, len(self.doc)))) >= self.length)
            if len(windows):
                yield windows

    def at(self, where: np.ndarray) -> np.ndarray:
        """Places in their documents."""
        return where - self.starts[self.doc[where]]

    def left(self, where: np.ndarray) -> np.ndarray:
        """Words to the end of the document."""
        return self.starts[self.doc[where] + 1] - where

    def candidates(self, answer: np.ndarray) -> None:
        """Windows of the wanted length whose part repeats, grouped by hash, each group's earliest first."""
        repeats = (self.part_count > 1) | (answer > 0)
        of_anchor = np.zeros(len(self.doc), bool)
        of_anchor[self.anchors] = repeats[self.part_of]
        found = [w[of_anchor[w + self.offset[w]]] for w in self._window_runs()]
        self._group(np.concatenate([np.empty(0, np.int64), *found]), self.half)

    def _group(self, where: np.ndarray, half: int) -> None:
        """Double ``half`` at the places ``where`` and find equal windows."""
        a, b = (_doubled(x, where, half) for x in (self.a, self.b))
        self.a[where], self.b[where] = a, b  # from here on the hashes of the doubled windows
        doc, at = self.doc_keys[self.doc[where]], self.at(where).astype(np.int32)
        order = np.lexsort((at, doc, b, a))
        self.where = where[order].astype(np.int32 if len(self.doc) < 1 << 31 else np.int64)
        a, b, doc, at = a[order], b[order], doc[order], at[order]
        del order
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        heads = np.flatnonzero(new)
        self.first = np.empty(len(heads), WINDOW)
        for name, column in (("a", a), ("b", b), ("doc", doc), ("at", at)):
            self.first[name] = column[heads]
        del a, b
        self.group = (np.cumsum(new) - 1).astype(self.where.dtype)
        later = (doc != self.first["doc"][self.group]) | (at != self.first["at"][self.group])
        many = np.diff(heads, append=len(new)) > 1
        self.local = later * np.uint8(COVERED) | many[self.group] * np.uint8(REPEATED)

    def flags(self, answer: np.ndarray) -> np.ndarray:
        """Of each candidate, in the order of ``where``; a later window than a covered first one is covered too."""
        return self.local | answer[self.group]

    def removed(self, answer: np.ndarray) -> np.ndarray:
        """Which words are covered by a window that also starts earlier."""
        covered = self.where[(self.flags(answer) & COVERED) > 0]
        depth = np.zeros(len(self.doc) + 1, np.int32)
        np.add.at(depth, covered, 1)
        np.add.at(depth, covered + self.length, -1)
        return np.cumsum(depth[:-1], dtype=np.int32) > 0

    def double(self, answer: np.ndarray, length: int) -> None:
        """Candidates of the next level: repeated windows followed, at their end, by another one."""
        repeats = np.zeros(len(self.doc), bool)
        repeats[self.where[(self.flags(answer) & REPEATED) > 0]] = True
        where = np.flatnonzero(repeats[: max(len(repeats) - length, 0)])
        where = where[repeats[where + length] & (self.left(where) >= 2 * length)]
        self._group(where, length)


def _window_hashes(h: np.ndarray, n: int, salt: int) -> np.ndarray:
    """``ngrams``, a run of words at a time; zeros where fewer than ``n`` words are left."""
    out = np.zeros(len(h), np.uint64)
    for at in range(0, len(h) - n + 1, RUN):
        found = ngrams(h[at : at + RUN + n - 1], n, salt)
        out[at : at + len(found)] = found
    return out


def _doubled(x: np.ndarray, where: np.ndarray, half: int) -> np.ndarray:
    """Hashes of windows at ``where`` from those of their halves, a run at a time."""
    out = np.empty(len(where), np.uint64)
    for at in range(0, len(where), RUN):
        w = where[at : at + RUN]
        out[at : at + RUN] = mix(mix(x[w], 5) + x[w + half], 6)
    return out


def _resolve_parts(records: np.ndarray, _) -> np.ndarray:
    _, back, count = np.unique(records, return_inverse=True, return_counts=True)
    return (count[back] > 1).astype(np.uint8)


def _resolve_windows(records: np.ndarray, _) -> np.ndarray:
    order = np.lexsort((records["at"], records["doc"], records["b"], records["a"]))
    k = records[order]
    new = np.ones(len(k), bool)
    new[1:] = (k["a"][1:] != k["a"][:-1]) | (k["b"][1:] != k["b"][:-1])
    group = np.cumsum(new) - 1
    first = k[new]
    later = (k["doc"] != first["doc"][group]) | (k["at"] != first["at"][group])
    many = np.bincount(group)[group] > 1
    out = np.empty(len(k), np.uint8)
    out[order] = later * COVERED | many * REPEATED
    return out


def _replay(block: _Block, right: pa.Table, depth: int, buckets: int) -> np.ndarray:
    """Bring a block to level ``depth`` of the known answers; gives the last level's answers."""
    levels = np.array(right["_level"].to_pylist(), np.int64)
    answer = np.empty(0, np.uint8)
    for level in range(depth):
        keys = block.first["a"] if level else block.parts
        answer = unpack_answers(right.filter(pa.array(levels == level)), keys, buckets, np.uint8)
        if level + 1 < depth:
            _descend(block, answer, level)
    return answer


def _descend(block: _Block, answer: np.ndarray, level: int) -> None:
    """From the answers of ``level`` to the candidates of the next."""
    if level:
        block.double(answer, block.length << (level - 1))
    else:
        block.candidates(answer)


def _blocked(df: DataFrame, id_col: str, text: str, length: int, block_bytes: int, *more: Column) -> tuple[DataFrame, int, int]:
    if length < 2 or length % 2:
        raise ValueError("a window has an even number of words")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), *more)
    buckets, partitions = parts_for(docs, "text", block_bytes)
    return blocked(docs, buckets, partitions, F.col("doc_id"), F.col("text")), buckets, partitions


def _together(docs: DataFrame, answers: list[DataFrame]):
    """Blocks beside the answers of all levels so far."""
    known = None
    for level, answer in enumerate(answers):
        answer = answer.withColumn("_level", F.lit(level))
        known = answer if known is None else known.unionByName(answer)
    return docs.groupBy("_block").cogroup(known.groupBy("_block"))


def _ask_level(docs: DataFrame, answers: list[DataFrame], length: int, buckets: int, partitions: int) -> DataFrame:
    """One more level: blocks send their groups, buckets answer."""
    depth = len(answers)

    def send_parts(group: pa.Table) -> pa.Table:
        block = _Block(group, length)
        return pack(group["_block"][0].as_py(), block.parts, block.parts, buckets)

    def send_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left, length)
        _descend(block, _replay(block, right, depth, buckets), depth - 1)
        return pack(left["_block"][0].as_py(), block.first["a"], block.first, buckets)

    if not depth:
        return ask(docs.groupBy("_block").applyInArrow(send_parts, SENT), _resolve_parts, "<u8", partitions)
    return ask(_together(docs, answers).applyInArrow(send_windows, SENT), _resolve_windows, WINDOW, partitions)


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 20, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``df`` with the repeated words of ``substring_dedup`` cut out of its texts.

    Texts without repeats are unchanged; of others the kept runs stay as they stand, joined by one space. Rows
    of which no word is left are dropped; rows that had none stay. A column ``n_chars`` becomes the new length.
    """
    rest = [c for c in df.columns if c not in (id_col, text)]
    apart = F.struct(F.lit(0).alias("_"), *rest)  # from the columns added below, whatever their names
    docs, buckets, partitions = _blocked(df, id_col, text, window, block_bytes, apart.alias("row"))
    answers: list[DataFrame] = []
    for _ in range(2):
        answers.append(_ask_level(docs, answers, window, buckets, partitions))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left, window)
        keep = ~block.removed(_replay(block, right, 2, buckets))
        texts = left["text"].to_pylist()
        for i, (a, b) in enumerate(zip(block.starts, block.starts[1:])):
            if b > a:
                texts[i] = keep_words(texts[i], keep[a:b])
        out = pa.table({"doc_id": left["doc_id"], "text": pa.array(texts, pa.string()), "row": left["row"]})
        stays = [n == 0 or keep[a:b].any() for a, b, n in zip(block.starts, block.starts[1:], np.diff(block.starts))]
        return out.filter(pa.array(stays, pa.bool_()))

    schema = docs.select("doc_id", "text", "row").schema
    cut = _together(docs, answers).applyInArrow(finish, schema)
    columns = {id_col: F.col("doc_id").cast(df.schema[id_col].dataType), text: F.col("text")}
    columns |= {c: F.col("row")[c] for c in rest}
    if "n_chars" in rest:
        columns["n_chars"] = F.length("text").cast(df.schema["n_chars"].dataType)
    return cut.select(*[columns[c].alias(c) for c in df.columns])


def substring_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    window: int = 20,
    keep_text: bool = False,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts earlier.

    Earlier is a smaller id, NULL before all, or an earlier word of the same document; rows of one id count as
    one document, so a repeated row is judged by its first likeness. Windows are judged on the input. Per row:
    ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` of the kept words joined by one space; with
    ``keep_text`` also ``kept``, those words. A NULL or empty text has no words and the digest of an empty
    text; an empty table gives an empty result. Other columns are not read.
    """
    docs, buckets, partitions = _blocked(df, id_col, text, window, block_bytes)
    answers: list[DataFrame] = []
    for _ in range(2):
        answers.append(_ask_level(docs, answers, window, buckets, partitions))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left, window)
        gone = block.removed(_replay(block, right, 2, buckets))
        removed, digests, kept = [], [], []
        for i, text in enumerate(left["text"]):
            mine, tokens = gone[block.starts[i] : block.starts[i + 1]], words(text.as_py())
            removed.append(int(mine.sum()))
            rest = b" ".join(compress(tokens, (~mine).tolist()) if removed[-1] else tokens)
            digests.append(hashlib.sha256(rest).hexdigest())
            if keep_text:
                kept.append(rest.decode("utf-8", "surrogatepass"))
        columns = [left["doc_id"], pa.array(block.sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
        if keep_text:
            columns.append(pa.array(kept, pa.string()))
        return pa.table(columns, names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    return _together(docs, answers).applyInArrow(finish, schema)


def _report(window: int, depth: int, buckets: int):
    """The repeated windows of level ``depth`` of a block."""
    length = window << (depth - 1)

    def report(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left, window)
        flags = block.flags(_replay(block, right, depth + 1, buckets))
        repeats = (flags & REPEATED) > 0
        at = block.where[repeats]
        columns = [
            left["doc_id"].combine_chunks().take(pa.array(block.doc[at])),
            pa.array(block.at(at), pa.int64()),
            pa.array(np.full(len(at), length), pa.int64()),
            pa.array((flags[repeats] & COVERED) > 0),
        ]
        return pa.table(columns, ["doc_id", "start", "length", "earlier"])

    return report


def repeated_passages(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = 20, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Where windows of ``window`` words, twice that, four times that and so on repeat.

    Doubles until no candidate survives. Per repeated window: ``doc_id``, ``start`` (word), ``length`` and
    ``earlier`` (whether it also starts earlier). Level answers are stored, since their number is not known.
    """
    docs, buckets, partitions = _blocked(df, id_col, text, window, block_bytes)
    docs = stored(docs, "passage-blocks").repartition(partitions, "_block")
    answers = [stored(_ask_level(docs, [], window, buckets, partitions), "passages")]
    found = None
    while True:
        depth = len(answers)
        answers.append(stored(_ask_level(docs, answers, window, buckets, partitions), "passages"))
        schema = "doc_id long, start long, length long, earlier boolean"
        level = stored(_together(docs, answers).applyInArrow(_report(window, depth, buckets), schema), "passages")
        found = level if found is None else found.unionByName(level)
        if level.isEmpty():
            return found
