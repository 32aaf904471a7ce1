"""What the operators of this folder share: words and their hashes, blocks of rows, and keyed exchanges.

A *block* is a bounded part of a table (``block_bytes`` of text on average), chosen by a hash, so a hot
source, a group of copies or a file layout does not matter. Block functions see one whole block as an Arrow
table. An *exchange* lets blocks put keyed records to buckets: every block sends its records packed as bytes,
one row per bucket it has records for, and a bucket function answers per block. A record is sent once per
block whatever its frequency there, so a hot key costs a bucket one record per block.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from prefspark.session import configure, scratch_path

BLOCK_BYTES = 4 << 20
PARTITION_BYTES, PARTITIONS = 256 << 20, 4096
RUN_BYTES = 1 << 18  # of text whose words are hashed at once; a longer text is by itself
LONG_WORD = 64  # bytes; longer words are hashed one by one
KEPT = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)  # the first so many of eight bytes
FACTOR = np.uint64(0x9E3779B97F4A7C15)
NO_ID = np.iinfo(np.int64).min  # stands for a NULL id: before all others


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Arrow batches are kept small, since texts may be very long."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; lost executors re-read files."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A few rows of the driver. They go as Arrow: lists would start other Python workers beside those of the operators."""
    kind = StructType.fromDDL(ddl)
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(kind.names, r)) for r in rows], to_arrow_schema(kind)), kind)


# --- words -------------------------------------------------------------------------------------------

def words(text: str | None) -> list[bytes]:
    """Runs of characters other than space and U+0009 to U+000D, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


_WORD = re.compile("[^ \t-\r]+")


def keep_words(text: str, keep: np.ndarray) -> str:
    """``text`` with only the words marked in ``keep``: runs of kept words as they stand, joined by one space."""
    if keep.all():
        return text
    spans = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
    return " ".join(text[spans[a][0] : spans[b - 1][1]] for a, b in zip(edges[::2], edges[1::2]))


_held: dict[str, object] = {}


def held(name: str, make: Callable):
    """A cache of this process. There is one at a time: a worker that turns to another operator drops the last one's."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


class WordHashes:
    """64-bit hashes of words, remembered for up to ``limit`` words."""

    def __init__(self, limit: int = 200_000):
        self.limit, self.memo = limit, {}

    def __call__(self, tokens: list[bytes]) -> np.ndarray:
        memo = self.memo
        if len(memo) > self.limit:
            memo.clear()
        try:
            return np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
        except KeyError:
            for w in set(tokens).difference(memo):
                memo[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    """Hashes of words, remembered in this process."""
    return held("word hashes", WordHashes)(tokens)


def mix(a: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    a = a ^ np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def ngrams(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of ``n`` word hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j], salt)
    return out


def byte_runs(texts: pa.Array, run_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The UTF-8 of ``texts``, about ``run_bytes`` of it at a time, and where each text begins there and the last one ends.

    A longer text is a run by itself; NULL is empty.
    """
    if not len(texts):
        return
    texts = texts.fill_null("").cast(pa.large_binary())
    places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(places, places[at] + run_bytes, "right")) - 1)
        yield data[places[at] : places[to]], places[at : to + 1] - places[at]
        at = to


def run_hashes(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the texts of a run start, and their 64-bit hashes: all at once, no step is per word."""
    raw = np.zeros(len(data) + 8, np.uint8)  # eight bytes can be read from any place
    raw[:-8] = data
    word = (data != 32) & (data - 9 >= 5)  # bytes wrap
    cut = np.zeros(len(data) + 1, bool)
    cut[places] = True
    first, last = word.copy(), word
    first[1:] &= ~word[:-1] | cut[1:-1]
    last[:-1] &= ~word[1:] | cut[1:-1]
    starts = np.flatnonzero(first)
    return starts, _hashed_words(raw, starts, np.flatnonzero(last) + 1 - starts)


def _hashed_words(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of ``raw``, by eight bytes at a time; of words up to eight bytes a length has no two alike."""
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    h = mix(mix(lengths.astype(np.uint64), 41) ^ (eight[starts] & KEPT[np.minimum(lengths, 8)]), 42)
    done, more = 8, np.flatnonzero((lengths > 8) & (lengths <= LONG_WORD))
    while len(more):
        part = eight[starts[more] + done] & KEPT[np.minimum(lengths[more] - done, 8)]
        h[more] = mix(h[more] * FACTOR ^ part, 42)
        done += 8
        more = more[lengths[more] > done]
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : starts[i] + lengths[i]].tobytes())
    return h


def text_hashes(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts end to end, and the number of words of each text."""
    hashes, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for chunk in texts.chunks:
        for data, places in byte_runs(chunk, RUN_BYTES):
            starts, h = run_hashes(data, places)
            hashes.append(h)
            sizes.append(np.diff(np.searchsorted(starts, places)))
    return np.concatenate(hashes), np.concatenate(sizes)


# --- blocks and exchanges ------------------------------------------------------------------------------

def parts_for(df: DataFrame, column: str, block_bytes: int = BLOCK_BYTES) -> tuple[int, int]:
    """(blocks, partitions) for ``df`` by the bytes of ``column``.

    A partition takes about four blocks, and beyond some thousand partitions as many as make up 256 MB: blocks are taken
    one at a time, so memory does not depend on it, but the driver keeps an entry for every pair of partitions.
    """
    size = df.agg(F.sum(F.octet_length(column)), F.count(F.lit(1))).first()
    size = (size[0] or 0) + 16 * size[1]
    blocks = max(1, math.ceil(size / block_bytes))
    return blocks, max(1, math.ceil(size / PARTITION_BYTES), min(math.ceil(blocks / 4), PARTITIONS))


def blocked(df: DataFrame, blocks: int, partitions: int, *keys: Column) -> DataFrame:
    """Rows with their ``_block``, partitioned by it."""
    return df.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(blocks))).repartition(partitions, "_block")


SENT = "_bucket long, _block long, payload binary"
ANSWER = "_block long, _bucket long, payload binary"


def as_bytes(records: np.ndarray, by_column: bool) -> bytes:
    """Records as bytes, one after another or column by column, which compresses where values are alike.

    Of columns of integers come all first bytes, then all second ones and so on: most of the higher ones are alike. Those of
    eight bytes, keys in order, are taken as differences.
    """
    if by_column:
        return b"".join(_planes(records[c]) if records.dtype[c].kind == "u" else records[c].tobytes() for c in records.dtype.names)
    return records.tobytes()


def _planes(values: np.ndarray) -> bytes:
    if values.dtype.itemsize == 8:
        values = np.diff(values, prepend=np.zeros(1, values.dtype))
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def from_bytes(payload: bytes, dtype: np.dtype, by_column: bool) -> np.ndarray:
    if not by_column:
        return np.frombuffer(payload, dtype)
    n, at = len(payload) // dtype.itemsize, 0
    out = np.empty(n, dtype)
    for c in dtype.names:
        size = dtype[c].itemsize
        if dtype[c].kind == "u":
            planes = np.frombuffer(payload, np.uint8, n * size, at).reshape(size, n)
            values = np.ascontiguousarray(planes.T).view(dtype[c])[:, 0]
            out[c] = np.cumsum(values, dtype=dtype[c]) if size == 8 else values
        else:
            out[c] = np.frombuffer(payload, dtype[c], n, at)
        at += n * size
    return out


def pack(block: int, keys: np.ndarray, records: np.ndarray, buckets: int, by_column: bool = False) -> pa.Table:
    """Rows for ``SENT``: ``records`` dealt to buckets by ``keys``, in the order given within a bucket."""
    to = (mix(keys, 77) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    ids, starts = np.unique(to[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    data = records[order]
    return pa.table(
        {
            "_bucket": pa.array(ids, pa.int64()),
            "_block": pa.array(np.full(len(ids), block), pa.int64()),
            "payload": pa.array([as_bytes(data[a:b], by_column) for a, b in zip(starts, ends)], pa.binary()),
        }
    )


def unpack_answers(right: pa.Table, keys: np.ndarray, buckets: int, dtype, by_column: bool = False) -> np.ndarray:
    """One answer per key, from the answers of its bucket, in the order of ``pack``."""
    to = (mix(keys, 77) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    got = sorted(zip(right["_bucket"].to_pylist(), right["payload"].to_pylist()))
    dtype = np.dtype(dtype)
    flat = np.concatenate([from_bytes(x, dtype, by_column) for _, x in got]) if got else np.empty(0, dtype)
    out = np.empty(len(keys), dtype)
    out[order] = flat
    return out


def ask(
    sent: DataFrame, resolve: Callable[[np.ndarray, np.ndarray], np.ndarray], dtype, partitions: int, by_column: bool = False
) -> DataFrame:
    """Answer the records of every bucket: ``resolve(records, block of each)`` gives one answer per record."""
    dtype = np.dtype(dtype)

    def answer(group: pa.Table) -> pa.Table:
        blocks = group["_block"].to_pylist()
        parts = [from_bytes(x, dtype, by_column) for x in group["payload"].to_pylist()]
        sizes = [len(p) for p in parts]
        replies = resolve(np.concatenate(parts), np.repeat(np.array(blocks), sizes))
        cuts = np.cumsum(sizes)[:-1]
        return pa.table(
            {
                "_block": pa.array(blocks, pa.int64()),
                "_bucket": group["_bucket"].combine_chunks(),
                "payload": pa.array([as_bytes(p, by_column) for p in np.split(replies, cuts)], pa.binary()),
            }
        )

    return sent.repartition(partitions, "_bucket").groupBy("_bucket").applyInArrow(answer, ANSWER)


def id_array(column: pa.ChunkedArray) -> np.ndarray:
    """Ids as int64, NULL as ``NO_ID``."""
    return np.array([NO_ID if v is None else v for v in column.to_pylist()], np.int64)


# --- tokenizer pieces --------------------------------------------------------------------------------------

_ODD = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def pieces(text: str) -> list[str]:
    """A text cut at Unicode white space. ``str.split`` would also cut at U+001C to U+001F, which are none."""
    return [p for p in _SPACE.split(text) if p] if _ODD.search(text) else text.split()


class PieceMemo:
    """Values of pieces, remembered for up to ``limit`` pieces of up to ``longest`` characters.

    ``encode`` maps a list of pieces to their values. When half the limit is new, the older half goes, but for
    those that are met again.
    """

    def __init__(self, encode: Callable[[list[str]], list], limit: int = 600_000, longest: int = 64):
        self.encode, self.half, self.longest = encode, limit // 2, longest
        self.memo, self.older = {}, {}

    def __call__(self, found: list[str]) -> list:
        memo = self.memo
        try:
            return list(map(memo.__getitem__, found))
        except KeyError:
            new = set(found).difference(memo)
            older = self.older
            again = {p: older[p] for p in new if p in older}
            asked = list(new.difference(again))
            fresh = dict(zip(asked, self.encode(asked)))
            memo.update(again)
            memo.update((k, v) for k, v in fresh.items() if len(k) <= self.longest)
            out = [memo[p] if p in memo else fresh[p] for p in found]
            if len(memo) > self.half:
                self.older, self.memo = memo, {}
            return out

    def texts(self, found: list[str | None]) -> list[list]:
        """Values of the pieces of many texts; NULL has none."""
        parts = [pieces(t) if t else [] for t in found]
        values = iter(self([p for part in parts for p in part]))
        return [list(islice(values, len(part))) for part in parts]


    def laid_out(self, found: list[str | None]) -> tuple[memoryview, np.ndarray]:
        """Values of the pieces of many texts, which are bytes, end to end, and where those of each text end.

        Pieces are numbered by Arrow, so the memory is asked once for each different one.
        """
        parts = [pieces(t) if t else [] for t in found]
        numbered = pa.array([p for part in parts for p in part], pa.string()).dictionary_encode()
        values = pa.array(self(numbered.dictionary.to_pylist()), pa.binary()).take(numbered.indices)
        ends = np.cumsum([len(part) for part in parts])
        if not len(values):
            return memoryview(b""), np.zeros(len(found), np.int64)
        places = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
        return memoryview(values.buffers()[2]), places[ends].astype(np.int64)


def text_runs(texts: pa.Array, run_bytes: int) -> Iterator[pa.Array]:
    """``texts`` in slices of up to ``run_bytes`` bytes of UTF-8; a longer text is a slice by itself."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + run_bytes, "right")))
        yield texts.slice(at, to - at)
        at = to


def vocabulary_path(name: str) -> str:
    """Where a vocabulary file lies on this machine: ``name`` itself if it is a path."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
