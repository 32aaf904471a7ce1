"""Token-id files with Elias-Fano encoded document boundaries.

A shard is two files: ``ids-<shard>.bin``, all ids of its documents one after another, each as the smallest
little-endian unsigned integer (2 or 4 bytes) that the vocabulary needs; and ``index-<shard>.ef``, the ends of
the documents and their doc_ids, both ascending sequences in Elias-Fano form. Such a sequence of n values
below u takes about 2 + log2(u / n) bits a value: low bits as they are, high bits as a unary bit vector; the
i-th value comes from the place of the i-th one bit, found from samples, so no table of offsets is kept.

``index`` = magic, width of an id, numbers of documents, of ids and of NULL doc_ids, smallest doc_id, then
the two sequences, each with n, low-bit width, byte lengths, samples (a place and a count each), high and low bits.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefspark.llm.common import PieceMemo, held, parts_for, stored
from prefspark.llm.token_counts import load
from prefspark.session import scratch_path

MAGIC = b"EFIDS002"
SAMPLE = 512
_HEADER = struct.Struct("<8sBqqqq")
_SEQUENCE = struct.Struct("<qBqqq")
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class EliasFano:
    """An ascending sequence of non-negative integers."""

    def __init__(self, n: int, width: int, samples: np.ndarray, before: np.ndarray, high: np.ndarray, low: np.ndarray):
        self.n, self.width, self.samples, self.before, self.high, self.low = n, width, samples, before, high, low

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.empty(0, np.uint32), *[np.empty(0, np.uint8)] * 3)
        width = max(0, (int(values[-1]) // n).bit_length() - 1)
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        low = np.empty((n, width), np.uint8)
        for k in range(width):
            low[:, k] = (values >> np.uint64(k)) & np.uint64(1)
        # Samples are byte places, so four bytes each reach 2^35 bits, and one byte for the ones before it in its own byte.
        high = np.packbits(bits, bitorder="little")
        samples = ones[::SAMPLE] >> 3
        before = _ONES[high[samples] & ((1 << (ones[::SAMPLE] & 7)) - 1)]
        return cls(n, width, samples.astype(np.uint32), before, high, np.packbits(low.ravel(), bitorder="little"))

    def select(self, i: int) -> int:
        """Place of the i-th one among the high bits."""
        at = int(self.samples[i // SAMPLE])
        # Ones of the sampled byte before the sampled one count to earlier values.
        left = i % SAMPLE + int(self.before[i // SAMPLE])
        while True:
            counts = np.cumsum(_ONES[self.high[at : at + 256]])
            k = int(np.searchsorted(counts, left, side="right"))
            if k < len(counts):
                left -= int(counts[k - 1]) if k else 0
                byte = int(self.high[at + k])
                for bit in range(8):
                    if byte >> bit & 1:
                        if not left:
                            return (at + k) * 8 + bit
                        left -= 1
            left -= int(counts[-1])
            at += 256

    def __getitem__(self, i: int) -> int:
        value = (self.select(i) - i) << self.width
        for k in range(self.width):
            bit = i * self.width + k
            value |= (int(self.low[bit >> 3]) >> (bit & 7) & 1) << k
        return value

    def range(self, a: int, b: int) -> np.ndarray:
        """Values a to b - 1 as int64."""
        if a >= b:
            return np.empty(0, np.int64)
        first, last = self.select(a), self.select(b - 1)
        bits = np.unpackbits(self.high[first >> 3 : (last >> 3) + 1], bitorder="little")
        ones = np.flatnonzero(bits[first & 7 :])[: b - a] + first
        out = (ones - np.arange(a, b)) << self.width
        if self.width:
            start = a * self.width
            raw = np.unpackbits(self.low[start >> 3 : ((b * self.width) >> 3) + 1], bitorder="little")
            raw = raw[start & 7 : (start & 7) + (b - a) * self.width].reshape(b - a, self.width)
            for k in range(self.width):
                out |= raw[:, k].astype(np.int64) << k
        return out

    def to_bytes(self) -> bytes:
        head = _SEQUENCE.pack(self.n, self.width, len(self.samples), len(self.high), len(self.low))
        return head + b"".join(x.tobytes() for x in (self.samples, self.before, self.high, self.low))

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple[EliasFano, int]:
        """The sequence and the number of bytes it took."""
        n, width, samples, high, low = _SEQUENCE.unpack_from(data)
        at = _SEQUENCE.size
        found = []
        for kind, count in ((np.uint32, samples), (np.uint8, samples), (np.uint8, high), (np.uint8, low)):
            found.append(np.frombuffer(data, kind, count, at))
            at += count * np.dtype(kind).itemsize
        return cls(n, width, *found), at


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Shard:
    """Writes one shard under a name of its own and renames it when complete; a repeated task writes the same."""

    def __init__(self, folder: str, shard: int, width: int):
        self.files, self.folder = _open(folder)
        self.shard, self.width = shard, width
        self.files.create_dir(self.folder, recursive=True)
        self.temporary = f"{self.folder}/_{uuid.uuid4().hex}"
        self.out = self.files.open_output_stream(f"{self.temporary}.bin")
        self.ends, self.ids, self.nulls, self.total = [], [], 0, 0

    def add(self, doc_id: int | None, data: bytes) -> None:
        self.out.write(data)
        self.total += len(data) // self.width
        self.ends.append(self.total)
        if doc_id is None:
            self.nulls += 1
        else:
            self.ids.append(doc_id)

    def close(self) -> None:
        self.out.close()
        least = self.ids[0] if self.ids else 0
        head = _HEADER.pack(MAGIC, self.width, len(self.ends), self.total, self.nulls, least)
        # doc_ids of a shard can span more than 63 bits only if they are of both signs.
        ids = np.array(self.ids, np.int64).view(np.uint64) - np.array([least], np.int64).view(np.uint64)
        with self.files.open_output_stream(f"{self.temporary}.ef") as f:
            f.write(head + EliasFano.build(np.array(self.ends)).to_bytes() + EliasFano.build(ids).to_bytes())
        self.files.move(f"{self.temporary}.bin", f"{self.folder}/ids-{self.shard:08d}.bin")
        self.files.move(f"{self.temporary}.ef", f"{self.folder}/index-{self.shard:08d}.ef")


def _mark(tokenizer) -> tuple[str, int] | None:
    """A special token that cuts a text wherever it stands, and its id."""
    for number, token in tokenizer.get_added_tokens_decoder().items():
        if token.special and not (token.lstrip or token.rstrip or token.single_word or token.normalized):
            return token.content, number
    return None


def _id_bytes(vocabulary: str, end_id: int, together: int = 256) -> tuple[int, PieceMemo]:
    """Width of an id, and the library's ids of pieces as bytes.

    Pieces are given to the library many at a time, with a special token between them, which no piece can merge across.
    """
    tokenizer = load(vocabulary)
    width = 2 if max(tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    mark = _mark(tokenizer)

    def alone(new: list[str]) -> list[bytes]:
        found = tokenizer.encode_batch_fast(new, add_special_tokens=False)
        return [np.array(e.ids, f"<u{width}").tobytes() for e in found]

    def encode(new: list[str]) -> list[bytes]:
        if mark is None or any(mark[0] in p for p in new):
            return alone(new)
        groups = [new[i : i + together] for i in range(0, len(new), together)]
        out = []
        for group, e in zip(groups, tokenizer.encode_batch_fast([mark[0].join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, f"<u{width}")
            cuts = np.flatnonzero(ids == mark[1])
            if len(cuts) + 1 != len(group):
                out += alone(group)
                continue
            data = ids.tobytes()
            starts, ends = [0, *((cuts + 1) * width).tolist()], [*(cuts * width).tolist(), len(data)]
            out += [data[a:b] for a, b in zip(starts, ends)]
        return out

    return width, PieceMemo(encode, limit=1_000_000)


def write_token_files(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text: str = "text",
    vocabulary: str = "word_bpe_49k.json",
    end_id: int = 2,
    shard_bytes: int = 32 << 20,
) -> DataFrame:
    """Write the files to ``path`` (a folder every executor reaches) and return the stored list of shards.

    Rows are range-partitioned by id into shards of about ``shard_bytes`` of text, NULL ids first, rows of one
    id by a hash of their text; so shards follow one another in ascending order. Each text becomes the library's
    ids without special tokens, then ``end_id``; NULL is empty. Pieces between white space are encoded once
    per worker: nothing in the tokenizer reaches across white space. The list has ``shard``, ``n_docs``,
    ``n_ids``; an empty table gives no shards.
    """
    _, parts = parts_for(df, text, shard_bytes // 4)
    narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    narrow = narrow.withColumn("tie", F.xxhash64("text"))
    order = [F.col("id").asc_nulls_first(), F.col("tie")]
    ranged = narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches):
        width, memo = held(f"id bytes {vocabulary} {end_id}", lambda: _id_bytes(vocabulary, end_id))
        end = np.array([end_id], f"<u{width}").tobytes()
        shard = None
        for batch in batches:
            data, ends = memo.laid_out(batch.column("text").to_pylist())
            start = 0
            for doc_id, stop in zip(batch.column("id").to_pylist(), ends.tolist()):
                shard = shard or _Shard(path, TaskContext.get().partitionId(), width)
                shard.add(doc_id, bytes(data[start:stop]) + end)
                start = stop
        if shard:
            shard.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard.shard, "n_docs": len(shard.ends), "n_ids": shard.total}])

    return stored(ranged.mapInArrow(run, "shard long, n_docs long, n_ids long"), "token-shards")


def read_shard(folder: str, shard: int, docs: int = 4_096) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(doc_ids with None first as masked, starts, ids per document) in steps of ``docs`` documents."""
    files, folder = _open(folder)
    with files.open_input_file(f"{folder}/index-{shard:08d}.ef") as f:
        data = memoryview(f.read())
    magic, width, n, _, nulls, least = _HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError(f"index of shard {shard} is no Elias-Fano index")
    ends, used = EliasFano.from_bytes(data[_HEADER.size :])
    ids, _ = EliasFano.from_bytes(data[_HEADER.size + used :])
    with files.open_input_file(f"{folder}/ids-{shard:08d}.bin") as f:
        start = 0
        for a in range(0, n, docs):
            b = min(a + docs, n)
            stop = ends.range(a, b)
            f.seek(start * width)
            flat = np.frombuffer(f.read(int(stop[-1] - start) * width), f"<u{width}").astype("<u4")
            known = [v + least for v in ids.range(max(a - nulls, 0), max(b - nulls, 0)).tolist()]
            doc_ids = [None] * (b - a - len(known)) + known
            begins = np.concatenate([[start], stop[:-1]])
            yield doc_ids, begins, np.split(flat, (stop[:-1] - start).astype(np.int64))
            start = int(stop[-1])


def read_token_files(shards: DataFrame, path: str) -> DataFrame:
    """Per document, read from the files: ``doc_id``, ``start`` in the whole, ``n_tokens``, ``ids_crc32``.

    The starts of shards are running sums over the list of shards, one narrow row each.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                for doc_ids, starts, ids in read_shard(path, row["shard"]):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(doc_ids, pa.int64()),
                            pa.array(starts + row["base"], pa.int64()),
                            pa.array([len(x) for x in ids], pa.int64()),
                            pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    # One file a task, so that a hundred shards are read by a hundred tasks.
    spread = placed.repartition(max(1, shards.count()), "shard")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_index(df: DataFrame, **options) -> DataFrame:
    """Write the files to a fresh folder of the shared place and read their documents back."""
    path = scratch_path(df.sparkSession, "token-files")
    return read_token_files(write_token_files(df, path, **options), path)
