"""Removing every byte of a long repeat by distributed prefix doubling.

A position's rank at length n stands for the n bytes that start there: equal strings, equal ranks. The rank at twice
the length is the pair of the ranks at the position and at the offset n, and that of any length from n to 2n the pair
at the position and at the offset that ends with the string. Blocks of documents send such pairs to buckets, where they
are sorted and ranked anew: a position whose rank is unique starts no repeat and leaves, the others go on to the
next length, up to the threshold and past it. Ranks are names of 128 bits made from the pairs, so that a block needs no
other answer than how its names fared.

Not every position has to be sorted. All strings of the wanted length ("windows") whose part of a quarter with the least
name (the first of equals) lies at one place, their anchor, form a *run*, dozens of windows long; equal windows have equal
anchors at equal offsets. So a run asks one question: the rank of its anchor, and with it that of all bytes the run spans,
past the threshold. If the anchor is unique, no window of the run repeats; if the span repeats, every window does. Where an
anchor has several spans, one run of each goes on, cut into cells by the offset to the anchor, which ask the same way with
the string that all windows of a cell share; what is left then is asked window by window. Texts that repeat through and
through so cost one record a run, and only the ends of repeats cost more.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm.common import BLOCK_BYTES, SENT, ask, blocked, pack, parts_for, unpack_answers

LENGTH = 200
CELL = 22  # windows of a cell
BUCKET_BLOCKS = 16  # blocks whose records make up a bucket on average
_STEP = 1 << 16  # windows searched at a time
_PLACE = np.uint64((1 << 17) - 1)
SPAN = np.dtype([("group", "<u8"), ("a", "<u8"), ("b", "<u8"), ("many", "u1")])
WINDOW = np.dtype([("a", "<u8"), ("b", "<u8"), ("many", "u1")])
KINDS = (SPAN, SPAN, WINDOW)  # what the levels send
REPEATS, GOES_ON = 1, 2
_ODD = [  # multipliers of the two halves of a name
    [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9)],
    [np.uint64(x) for x in (0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)],
]
np.seterr(over="ignore")


def _pair(x: np.ndarray, y: np.ndarray, half: int = 0) -> np.ndarray:
    """The name of a pair of names, one of two independent halves."""
    a, b, c = _ODD[half]
    h = x * a + y * b
    h ^= h >> np.uint64(31)
    h *= c
    h ^= h >> np.uint64(29)
    return h


class _Names:
    """Names of strings anywhere in some bytes."""

    def __init__(self, data: np.ndarray):
        n = max(len(data) - 7, 0)
        self.eight = np.ndarray((n,), "<u8", data, strides=(1,)) if n else np.empty(0, "<u8")

    def part(self, at: np.ndarray, size: int, half: int) -> np.ndarray:
        """Of ``size`` bytes, 32 to 64."""
        names = self.eight[np.asarray(at)[:, None] + [0, 8, 16, 24, size - 32, size - 24, size - 16, size - 8]]
        while names.shape[1] > 1:
            names = _pair(names[:, ::2], names[:, 1::2], half)
        return names[:, 0]

    def doubled(self, at: np.ndarray, part: int, times: int, half: int) -> np.ndarray:
        """Of ``part * 2 ** times`` bytes."""
        if not times:
            return self.part(at, part, half)
        step = part << (times - 1)
        return _pair(self.doubled(at, part, times - 1, half), self.doubled(at + step, part, times - 1, half), half)

    def between(self, start: np.ndarray, end: np.ndarray, part: int, times: int, half: int) -> np.ndarray:
        """Of the bytes from ``start`` to ``end``: the pair of the doubled names at its start and at its end."""
        size = part << times
        pair = _pair(self.doubled(start, part, times, half), self.doubled(end - size, part, times, half), half)
        return _pair(pair, (end - start).astype(np.uint64), half)


class _Block:
    """The runs of one block of documents, laid end to end, and how they are settled."""

    def __init__(self, group: pa.Table, length: int):
        self.length, self.part = length, length // 4
        texts = group["text"].combine_chunks().fill_null("")
        sizes = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        signs = texts.buffers()[2]
        data = np.frombuffer(signs, np.uint8) if signs else np.empty(0, np.uint8)
        self.data, self.starts = data[sizes[0] : sizes[-1]], sizes - sizes[0]
        self.names = _Names(self.data)
        self.first, self.last, self.anchor = self._runs()
        self.settled: list[tuple[np.ndarray, np.ndarray]] = []  # first and last window of repeats
        self.level = 0
        self._ask(self.names.part(self.anchor, self.part, 0))

    def _runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last window of each run, and the place of its part."""
        length, part, data = self.length, self.part, self.data
        inside = np.ones(len(data), bool)  # whether a window that starts here stays in its document
        for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist()):
            inside[max(a, b - length + 1) : b] = False
        span = length - part + 1  # parts of a window
        found = [[np.empty(0, np.int64)] * 3]
        for s in range(0, len(data) - length + 1, _STEP):
            ends = min(s + _STEP, len(data) - length + 1)
            here = np.flatnonzero(inside[s:ends])
            if not len(here):
                continue
            eight = self.names.eight[s : ends + length - 8].copy()
            name = _pair(eight[:-8], eight[8:])
            name = _pair(name[:-16], name[16:])
            name = _pair(name[: len(name) - (part - 32)], name[part - 32 :])
            least = (name & ~_PLACE) | np.arange(len(name), dtype=np.uint64)
            width = 1
            while 2 * width <= span:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            n = ends - s
            least = np.minimum(least[:n], least[span - width : span - width + n])
            at = (least[here] & _PLACE).astype(np.int64) + s
            here = here + s
            new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (here[1:] != here[:-1] + 1)]))
            found.append([here[new], here[np.append(new[1:], len(here)) - 1], at[new]])
        first, last, at = (np.concatenate(x) for x in zip(*found))
        # A run that a step has cut is one run.
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (first[1:] != last[:-1] + 1)]) if len(at) else np.empty(0, bool)
        ends = np.flatnonzero(np.append(new[1:], True)) if len(at) else np.empty(0, np.int64)
        return first[new], last[ends], at[new]

    def _distinct(self, kind: np.dtype, **columns: np.ndarray) -> None:
        """The records to send, each once; ``back`` finds the record of each piece, ``kept`` a piece of each record."""
        order = np.lexsort(list(columns.values())[::-1])
        new = np.zeros(len(order), bool)
        new[:1] = True
        for c in columns.values():
            new[1:] |= c[order[1:]] != c[order[:-1]]
        place = np.cumsum(new) - 1
        self.back = np.empty(len(order), np.int64)
        self.back[order] = place
        self.kept = order[new]
        self.records = np.empty(len(self.kept), kind)
        for name, c in columns.items():
            self.records[name] = c[self.kept]
        self.records["many"] = np.bincount(place, minlength=len(self.kept)) > 1

    def _ask(self, group: np.ndarray) -> None:
        """Ask for the spans of all pieces within their groups."""
        span = [self.names.between(self.first, self.last + self.length, self.part, 2, half) for half in (0, 1)]
        self._distinct(SPAN, group=group, a=span[0], b=span[1])

    def keys(self) -> np.ndarray:
        """By which the records are dealt to buckets."""
        return self.records["group" if self.level < 2 else "a"]

    def answered(self, answer: np.ndarray) -> None:
        """Settle the pieces that repeat and form the questions of the next level."""
        repeats = (answer & REPEATS)[self.back] > 0
        self.settled.append((self.first[repeats], self.last[repeats]))
        if self.level == 2:
            return
        on = self.kept[(answer & GOES_ON) > 0]
        first, last, anchor = self.first[on], self.last[on], self.anchor[on]
        if self.level == 0:  # cells by the offset to the anchor
            low, high = (anchor - last) // CELL, (anchor - first) // CELL
            n = high - low + 1
            row = np.repeat(np.arange(len(n)), n)
            cell = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            self.anchor = anchor[row]
            end = self.anchor - CELL * cell  # the last window of a whole cell
            self.first = np.maximum(first[row], end - CELL + 1)
            self.last = np.minimum(last[row], end)
            self._ask(self.names.between(end, end - CELL + 1 + self.length, self.part, 1, 0))
        else:  # window by window
            n = last - first + 1
            self.first = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            self.last = self.first
            self._distinct(WINDOW, **{x: self.names.doubled(self.first, self.part, 2, half) for half, x in enumerate("ab")})
        self.level += 1

    def removed(self) -> np.ndarray:
        """Which bytes a repeated window covers."""
        first, last = (np.concatenate(x) for x in zip(*self.settled))
        n = len(self.data) + 1
        depth = np.bincount(first, minlength=n) - np.bincount(last + self.length, minlength=n)
        return np.cumsum(depth[:-1]) > 0


def _rerank(records: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Sort the names of a bucket; of each record, whether its name repeats and whether it goes on.

    Within a group with several names, one record of each goes on, since windows may repeat across names: that of the least
    block, so that the answer does not depend on the order in which records came.
    """
    names = [n for n in records.dtype.names if n != "many"]
    order = np.lexsort([blocks, *[records[n] for n in names[::-1]]])
    k = records[order]
    new = np.zeros(len(k), bool)
    new[:1] = True
    for n in names:
        new[1:] |= k[n][1:] != k[n][:-1]
    name = np.cumsum(new) - 1
    flags = np.where((np.bincount(name)[name] > 1) | (np.bincount(name, k["many"])[name] > 0), REPEATS, 0)
    if "group" in names:
        group = np.concatenate([[0], np.cumsum(k["group"][1:] != k["group"][:-1])])
        flags |= np.where(new & (np.bincount(group, new)[group] > 1), GOES_ON, 0)
    out = np.empty(len(k), np.uint8)
    out[order] = flags
    return out


def _replay(left: pa.Table, right: pa.Table, length: int, depth: int, buckets: int) -> _Block:
    """A block with the answers of the first ``depth`` levels."""
    block = _Block(left, length)
    levels = np.array(right["_level"].to_pylist(), np.int64)
    for level in range(depth):
        block.answered(unpack_answers(right.filter(pa.array(levels == level)), block.keys(), buckets, np.uint8))
    return block


def suffix_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    keep_bytes: bool = False,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that also starts anywhere else.

    Anywhere is any row, the same one included, also in overlap; a string does not reach into another row, and is judged on
    the input, so that all its places are cut, the first one too. Rows of one id are separate texts, and repeated rows
    repeat each other. Per row: ``doc_id``, ``n_bytes`` (UTF-8), ``n_removed``, ``n_spans`` (maximal runs of removed
    bytes) and ``kept_sha256`` of the bytes that are left, joined; with ``keep_bytes`` also ``spans`` (start and end of
    those runs) and ``kept``, which need not be UTF-8. NULL and empty texts have no bytes and the digest of none. A very
    long text is one block by itself; an empty table gives an empty result; other columns are not read.
    ``length`` is a multiple of four from 128 to 256.
    """
    if length % 4 or not 128 <= length <= 256:
        raise ValueError("a repeat has a multiple of 4 bytes, 128 to 256")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks, partitions = parts_for(docs, "text", block_bytes)
    buckets = math.ceil(blocks / BUCKET_BLOCKS)
    docs = blocked(docs, blocks, partitions, F.col("doc_id"), F.col("text"))
    known = None

    def send_first(group: pa.Table) -> pa.Table:
        block = _Block(group, length)
        return pack(group["_block"][0].as_py(), block.keys(), block.records, buckets)

    def send(depth: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            block = _replay(left, right, length, depth, buckets)
            return pack(left["_block"][0].as_py(), block.keys(), block.records, buckets)

        return run

    for depth, kind in enumerate(KINDS):
        if depth:
            sent = docs.groupBy("_block").cogroup(known.groupBy("_block")).applyInArrow(send(depth), SENT)
        else:
            sent = docs.groupBy("_block").applyInArrow(send_first, SENT)
        answers = ask(sent, _rerank, kind, min(partitions, buckets)).withColumn("_level", F.lit(depth))
        known = answers if known is None else known.unionByName(answers)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["spans", "kept"] * keep_bytes

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _replay(left, right, length, len(KINDS), buckets)
        gone, data = block.removed(), block.data
        rows = []
        for a, b in zip(block.starts[:-1].tolist(), block.starts[1:].tolist()):
            mine = gone[a:b]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
            kept = data[a:b][~mine].tobytes() if len(edges) else data[a:b].tobytes()
            row = [b - a, b - a - len(kept), len(edges) // 2, hashlib.sha256(kept).hexdigest()]
            if keep_bytes:
                row += [[{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()], kept]
            rows.append(row)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        kinds += [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()] * keep_bytes
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        return pa.Table.from_arrays([left["doc_id"], *columns], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", spans array<struct<start: long, end: long>>, kept binary" * keep_bytes
    return docs.groupBy("_block").cogroup(known.groupBy("_block")).applyInArrow(finish, schema)
