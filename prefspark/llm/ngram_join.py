"""Jaccard self-join of n-gram sets with a prefix-tree join, and its connected documents.

N-grams get one global order: from rare to frequent by a count sketch of a fixed number of cells over the
whole corpus, then by hash. Two sets that link share an n-gram among the first ``n - ceil(t n) + 1`` of the larger and the
first ``n - ceil(2 t n / (1 + t)) + 1`` of the smaller, which are about half as many; so every distinct set is put to the
groups of the former, marked where it could be the smaller one. What is left are sets of like sizes with a smaller one that
is so marked. A group is joined through a trie of its sets, frequent n-grams first, where sets share the most: a
traversal carries all probing sets down a path at once with their overlaps so far, and drops those for which
even the best set below, by the n-grams remaining in both, falls short of the threshold. The overlap at a
set's end is exact, so no candidate needs another check.

Equal sets are one from the start, in blocks before anything is shuffled. A set has a sketch, the parity of its n-grams in
each of some cells: two sketches differ in no more cells than their sets do in n-grams, so those that differ in too many
part the sets of a group before any set is sent. Groups that overlap are joined as one while they are small, and
each set is sent there once, from one document whose place in a bitmap is marked. Other groups over a size are dealt into
chunks by hash and joined chunk by chunk; equal groups of different n-grams are joined once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefspark.llm.common import BLOCK_BYTES, RUN_BYTES, SENT, byte_runs, from_bytes, held, mix, pack, parts_for, run_hashes, stored
from prefspark.llm.components import components
from prefspark.operators.groups import join_unique

CELLS = 1 << 22  # of the count sketch, whatever the input; it decides on the order alone, never on a link
SLICES = 64
SUMS = 4  # in which the sketch's slices are added first
CHUNK_GRAMS = 1 << 16  # n-grams of the sets of a chunk
MERGED = 4  # chunks of groups that are joined as one, at most
PARTED = 512  # sets of a group that sketches may part, at most
MARKS = 1 << 24  # of the bitmap of documents, whatever the input; a wrong mark only sends a text in vain
SEND_GRAMS = 1 << 21  # records that a task holds before it sends them
# "late" marks an n-gram that a set has too late to be the smaller of two.
RECORD = np.dtype([("gram", "<u8"), ("a", "<u8"), ("n", "<u4"), ("late", "u1")])
SET_ID = np.dtype([("a", "<u8"), ("n", "<u4")])
GRAM_BITS = 48  # of an n-gram hash
MASK = np.uint64((1 << GRAM_BITS) - 1)
STEP = (1 << 40) - 1  # largest gap of five bytes
np.seterr(over="ignore")


def gram_sets(texts: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sets of texts, in runs: sorted distinct 48-bit hashes of ``n``-word shingles end to end, and where each text's begin
    and the last one's end. Fewer words are one shingle.
    """
    held("n-gram sets", bool)  # needs no cache, but drops another operator's
    for data, places in byte_runs(texts, RUN_BYTES):
        yield _gram_run(data, places, n)


def _gram_run(data: np.ndarray, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of the texts that lie in ``data`` between ``places``, all at once: no step is per word."""
    starts, h = run_hashes(data + (((data - 65) < 26).astype(np.uint8) << 5), places)

    begins = np.searchsorted(starts, places)
    words = np.diff(begins)
    grams = np.zeros(len(h), np.uint64)
    taken = np.repeat(begins[1:], words) - np.arange(len(h)) >= n
    if len(h) >= n:
        grams[: len(h) - n + 1] = _shingles([h[j : len(h) - n + 1 + j] for j in range(n)])
    for size in range(1, n):
        short = begins[:-1][words == size]
        grams[short] = _shingles([h[short + j] for j in range(size)])
        taken[short] = True
    grams = grams[taken]
    bounds = np.concatenate([[0], np.cumsum(np.where(words < n, words > 0, words - n + 1))])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        grams[a:b].sort()
    new = np.ones(len(grams) + 1, bool)
    new[1:-1] = grams[1:] != grams[:-1]
    new[bounds] = True
    return grams[new[:-1]], np.concatenate([[0], np.cumsum(new[:-1])])[bounds]


def _shingles(words: list[np.ndarray]) -> np.ndarray:
    """Hashes of runs of words, given the hashes of their first words, second words and so on."""
    factors = mix(np.arange(len(words), dtype=np.uint64), 43) | np.uint64(1)
    total = words[0] * factors[0]
    for part, factor in zip(words[1:], factors[1:]):
        total += part * factor
    return mix(total, 100 + len(words)) & MASK


def set_ids(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sets by 64 bits of their n-grams and their size."""
    out = np.zeros(len(bounds) - 1, SET_ID)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams, 11), dtype=np.uint64)])
    out["a"], out["n"] = mix(np.diff(sums[bounds]), 12), np.diff(bounds)
    return out


def parity_sketches(grams: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Per set whether each cell holds an odd number of its n-grams; as many cells as the power of two up to its size, 64 at
    least. The first half of the cells xor the second is the sketch of half the size.
    """
    sizes = np.diff(bounds)
    cells = np.left_shift(1, np.frexp(np.maximum(sizes, 64).astype(np.float64))[1] - 1).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(cells)])
    at = np.repeat(starts[:-1], sizes) + (grams.astype(np.int64) & np.repeat(cells - 1, sizes))
    raw = np.packbits((np.bincount(at, minlength=int(starts[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [raw[a:b] for a, b in zip((starts[:-1] // 8).tolist(), (starts[1:] // 8).tolist())]


def _folded(sketch: bytes, size: int) -> int:
    """A sketch with no more than ``size`` bytes, as a number."""
    out, bits = int.from_bytes(sketch, "little"), 8 * len(sketch)
    while bits > 8 * size:
        bits //= 2
        out = out >> bits ^ out & (1 << bits) - 1
    return out


def parted(sizes: list[int], sketches: list[bytes], percent: int) -> list[list[int]]:
    """The sets that may link with others, in parts between which none may; by size and sketch alone."""
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    least = min(map(len, sketches))
    folded = [_folded(sketches[x], least) for x in order]
    sizes = [sizes[x] for x in order]
    root = list(range(len(sizes)))

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for y, n in enumerate(sizes):
        for x in range(y - 1, -1, -1):
            if 100 * sizes[x] < percent * n:
                break
            both = sizes[x] + n
            apart = both + 2 * (-percent * both // (100 + percent))  # the most n-grams that are in one of two that link
            if (folded[x] ^ folded[y]).bit_count() <= apart and (u := top(x)) != (v := top(y)):
                root[v] = u
    parts: dict[int, list[int]] = {}
    for x in range(len(sizes)):
        parts.setdefault(top(x), []).append(order[x])
    return [part for part in parts.values() if len(part) > 1]


def _as_list(ids: np.ndarray) -> list[bytes]:
    raw = np.ascontiguousarray(ids).tobytes()
    return [raw[i : i + SET_ID.itemsize] for i in range(0, len(raw), SET_ID.itemsize)]


def packed_grams(grams: np.ndarray) -> bytes:
    """A sorted set as the gaps of its values, five bytes each; a gap beyond them takes several, all but the last full."""
    gaps = np.diff(grams.astype(np.int64), prepend=0)
    full = gaps // STEP
    out = np.full(len(gaps) + int(full.sum()), STEP, "<i8")
    out[np.cumsum(full + 1) - 1] = gaps - full * STEP
    return out.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked_grams(data: bytes) -> np.ndarray:
    raw = np.zeros((len(data) // 5, 8), np.uint8)
    raw[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    gaps = raw.view("<i8").ravel()
    return np.cumsum(gaps)[gaps < STEP].astype(np.uint64)


def _cells(grams: np.ndarray) -> np.ndarray:
    return (grams & np.uint64(CELLS - 1)).astype(np.int64)


def _keys(grams: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Numbers that order ``grams`` from rare to frequent, with the n-gram itself in their low bits."""
    return levels[_cells(grams)].astype(np.uint64) << np.uint64(GRAM_BITS) | grams


def _least(keys: np.ndarray, take: int) -> np.ndarray:
    """The ``take`` least of ``keys``, sorted."""
    return np.sort(np.partition(keys, take - 1)[:take])


def _scan(docs: DataFrame, n: int) -> DataFrame:
    """Per row its id, the hash of the row, set id, size and sketch; per task the slices of its count sketch."""

    def run(batches):
        counts = np.zeros(CELLS, np.uint32)
        for batch in batches:
            ids, sketches = [np.empty(0, SET_ID)], []
            for grams, bounds in gram_sets(batch.column("text"), n):
                np.add.at(counts, _cells(grams), np.uint32(1))
                ids.append(set_ids(grams, bounds))
                sketches += parity_sketches(grams, bounds)
            ids = np.concatenate(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row"),
                    pa.array(_as_list(ids), pa.binary(), mask=ids["n"] == 0),
                    pa.array(ids["n"].astype(np.int64)),
                    pa.nulls(len(ids), pa.int64()),
                    pa.array(sketches, pa.binary(), mask=ids["n"] == 0),
                ],
                ["doc_id", "row", "sid", "n", "slice", "payload"],
            )
        task = TaskContext.get().partitionId()
        slices = [(i, zlib.compress(s.tobytes(), 1)) for i, s in enumerate(np.split(counts, SLICES)) if s.any()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(len(slices), pa.int64()),
                pa.nulls(len(slices), pa.int64()),
                pa.nulls(len(slices), pa.binary()),
                pa.array([task] * len(slices), pa.int64()),
                pa.array([i for i, _ in slices], pa.int64()),
                pa.array([s for _, s in slices], pa.binary()),
            ],
            ["doc_id", "row", "sid", "n", "slice", "payload"],
        )

    return stored(docs.mapInArrow(run, "doc_id long, row long, sid binary, n long, slice long, payload binary"), "gram-sets")


def _levels(scanned: DataFrame) -> np.ndarray:
    """The sketch, summed in two steps, as logarithmic levels of one byte per cell."""

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(CELLS // SLICES, np.uint64)
        for payload in group["payload"]:
            total += np.frombuffer(zlib.decompress(payload.as_buffer()), "<u4")
        most = np.minimum(total, 2**32 - 1).astype("<u4")  # its level is the last one long before
        return pa.table(
            {"slice": group["slice"][:1], "part": pa.array([0], pa.int64()), "payload": pa.array([zlib.compress(most.tobytes(), 1)], pa.binary())}
        )

    parts = scanned.where("slice IS NOT NULL").select("slice", F.pmod("n", F.lit(SUMS)).alias("part"), "payload")
    schema = "slice long, part long, payload binary"
    summed = parts.groupBy("slice", "part").applyInArrow(add, schema).groupBy("slice", "part").applyInArrow(add, schema)
    levels = np.zeros(CELLS, np.uint8)
    width = CELLS // SLICES
    for row in summed.collect():  # CELLS numbers in all
        counts = np.frombuffer(zlib.decompress(row["payload"]), "<u4").astype(np.float64)
        levels[row["slice"] * width : (row["slice"] + 1) * width] = np.minimum(4 * np.log2(counts + 1), 255)
    return levels


def _apart(k: np.ndarray, percent: int) -> np.ndarray:
    """Whether a record, sorted by n-gram and size, is too large to link with the one before it."""
    n = k["n"].astype(np.int64)
    out = np.ones(len(k), bool)
    out[1:] = (k["gram"][1:] != k["gram"][:-1]) | (100 * n[:-1] < percent * n[1:])
    return out


def _may_link(k: np.ndarray, percent: int) -> np.ndarray:
    """Records with another one that they may link with: the smaller of two has to have the n-gram early.

    Sorted by n-gram, size and earliness, so the best smaller set of a record is the last early one before it, and the best
    larger set of an early one is the next.
    """
    n, early, at = k["n"].astype(np.int64), k["late"] == 0, np.arange(len(k))
    last = np.concatenate([[-1], np.maximum.accumulate(np.where(early, at, -1))[:-1]])
    best = np.maximum(last, 0)
    larger = (last >= 0) & (k["gram"][best] == k["gram"]) & (100 * n[best] >= percent * n)
    smaller = np.zeros(len(k), bool)
    smaller[:-1] = early[:-1] & ~_apart(k, percent)[1:]
    return k[larger | smaller]


def _memberships(docs: DataFrame, levels, n: int, percent: int, buckets: int, partitions: int) -> DataFrame:
    """``sig, sid, n``: the sets of every group of at least two that may link, stored.

    Straight from the scan: a task's sets are put to their groups once each.
    """

    def send(batches):
        held, grams_held = {}, 0
        for batch in batches:
            for grams, bounds in gram_sets(batch.column("text"), n):
                ids, keys = set_ids(grams, bounds), _keys(grams, levels.value)
                for x, sid in enumerate(_as_list(ids)):
                    size = int(ids["n"][x])
                    if size and sid not in held:
                        take = size - -(-percent * size // 100) + 1
                        early = size + 2 * percent * size // -(100 + percent) + 1
                        record = np.zeros(take, RECORD)
                        record["gram"] = _least(keys[bounds[x] : bounds[x + 1]], take) & MASK
                        record["a"], record["n"], record["late"] = ids["a"][x], size, np.arange(take) >= early
                        held[sid] = record
                        grams_held += take
            if grams_held > SEND_GRAMS:
                yield from sent(held)
                held, grams_held = {}, 0
        if held:
            yield from sent(held)

    def sent(held):
        records = np.concatenate(list(held.values()))
        records = records[np.argsort(records["gram"])]
        yield from pack(-1, records["gram"], records, buckets, by_column=True).to_batches()

    def group_up(group: pa.Table) -> pa.Table:
        k = np.concatenate([from_bytes(x, RECORD, True) for x in group["payload"].to_pylist()])
        k = k[np.lexsort((k["a"], k["late"], k["n"], k["gram"]))]
        new = np.ones(len(k), bool)
        new[1:] = (k["gram"][1:] != k["gram"][:-1]) | (k["a"][1:] != k["a"][:-1]) | (k["n"][1:] != k["n"][:-1])
        k = _may_link(k[new], percent)
        if not len(k):
            return pa.table({c: pa.array([], t) for c, t in (("sig", pa.int64()), ("sid", pa.binary()), ("n", pa.int32()))})
        # Sorted by size within an n-gram; a group ends where the next set is too large to link.
        start = _apart(k, percent)
        part = np.cumsum(start) - 1
        several = np.bincount(part)[part] > 1
        totals = np.zeros(int(part[-1]) + 1, np.uint64)
        np.add.at(totals, part, _marks_of_sets(k))
        return pa.table(
            {
                "sig": pa.array(totals[part][several].view(np.int64), pa.int64()),
                "sid": pa.array(_as_list(k[several][["a", "n"]].astype(SET_ID)), pa.binary()),
                "n": pa.array(k["n"][several], pa.int32()),
            }
        )

    grouped = docs.mapInArrow(send, SENT).repartition(partitions, "_bucket").groupBy("_bucket")
    members = grouped.applyInArrow(group_up, "sig long, sid binary, n int")
    return stored(members.groupBy("sig", "sid").agg(F.first("n").alias("n")), "gram-groups")


def _marks_of_sets(ids: np.ndarray) -> np.ndarray:
    """Numbers whose sum tells a group of sets from others."""
    return mix(mix(ids["a"], 31) + ids["n"].astype(np.uint64), 33)


def _candidates(members: DataFrame, scanned: DataFrame, percent: int, partitions: int) -> DataFrame:
    """``sig, sid, n, row, center``: the groups of ``members`` parted by sketches, stored.

    ``row`` is the hash of a document that has the set, ``center`` one set of the group. A group of more than ``PARTED`` sets
    stays as it is, and its rows pass.
    """
    sets = members.select("sid").distinct()
    known = scanned.where("sid IS NOT NULL").join(sets, "sid", "left_semi")
    known = known.groupBy("sid").agg(F.min(F.struct("row", "payload")).alias("at")).select("sid", "at.row", F.col("at.payload").alias("sketch"))
    rows = join_unique(members, known, ["sid"]).repartition(partitions, "sig").sortWithinPartitions("sig")

    def part(group):
        found = []
        for one in parted([r[2] for r in group], [r[4] for r in group], percent):
            ids = np.frombuffer(b"".join(group[x][1] for x in one), SET_ID)
            sig = int(_marks_of_sets(ids).sum(dtype=np.uint64).view(np.int64))
            center = min(group[x][1] for x in one)
            found += [(sig, *group[x][1:4], center) for x in one]
        return found

    def run(batches):
        sig, group, whole = None, [], False
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("sig", "sid", "n", "row", "sketch"))):
                if row[0] != sig:
                    out += [] if whole or not group else part(group)
                    sig, group, whole = row[0], [], False
                if whole:
                    out.append((*row[:4], group[0][1]))
                    continue
                group.append(row)
                if len(group) > PARTED:
                    out += [(*r[:4], group[0][1]) for r in group]
                    group, whole = group[:1], True
            yield batch_of(out)
        if group and not whole:
            yield batch_of(part(group))

    def batch_of(out):
        columns = list(zip(*out)) or [()] * 5
        types = pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["sig", "sid", "n", "row", "center"])

    found = rows.select("sig", "sid", "n", "row", "sketch").mapInArrow(run, "sig long, sid binary, n int, row long, center binary")
    found = found.groupBy("sig", "sid").agg(F.min(F.struct("n", "row", "center")).alias("x"))
    return stored(found.select("sig", "sid", "x.*"), "gram-candidates")


def _dealt(candidates: DataFrame, chunk_grams: int) -> DataFrame:
    """``sig, sid, row, k``: where each set is joined, with the chunks of that; stored.

    Groups that overlap are one as long as ``MERGED`` chunks hold it. Others stay by themselves.
    """
    roots = components(candidates.select(F.col("sid").alias("u"), F.col("center").alias("v")))
    named = join_unique(candidates, roots.select(F.col("u").alias("sid"), F.col("v").alias("root")), ["sid"], "left")
    named = named.withColumn("root", F.coalesce("root", "sid"))
    sets = named.groupBy("root", "sid").agg(F.first("n").alias("n"), F.min("row").alias("row"))
    chunks = F.ceil(F.sum(F.col("n").cast("long")) / F.lit(chunk_grams)).cast("int").alias("k")
    sized = sets.groupBy("root").agg(chunks)
    small = sized.where(F.col("k") <= MERGED)
    merged = join_unique(sets, small, ["root"]).select(F.xxhash64("root").alias("sig"), "sid", "row", "k")
    large = named.join(sized.where(F.col("k") > MERGED).select("root"), "root", "left_semi").select("sig", "sid", "n", "row")
    return stored(merged.unionByName(_needed_groups(large, chunk_grams).select("sig", "sid", "row", "k")), "gram-dealt")


def _marked(docs: DataFrame, dealt: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose hash is a ``row`` of ``dealt``, and few others: a bitmap by their low bits is broadcast."""
    low = F.col("row").bitwiseAND(F.lit(MARKS - 1))
    bit = F.expr("shiftleft(1L, CAST(row & 31 AS INT))")
    marks = dealt.groupBy(F.shiftright(low, 5).alias("at")).agg(F.bit_or(bit).alias("bits"))
    found = marks.toArrow()  # MARKS / 32 rows at most
    words = np.zeros(MARKS // 32, np.uint32)
    words[found["at"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    bitmap = docs.sparkSession.sparkContext.broadcast(words)

    def keep(batches):
        for batch in batches:
            at = batch.column("row").to_numpy() & (MARKS - 1)
            yield batch.filter(pa.array((bitmap.value[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)))

    return docs.select("text", "row").mapInArrow(keep, "text string, row long")


def _needed_groups(members: DataFrame, chunk_grams: int) -> DataFrame:
    """``members`` without groups that lie in a larger one, with ``k``, the number of chunks of the group.

    Tried for each group are the least and the greatest of the largest groups that its sets are in. A group that
    is left out lies in a greater one by (size, sig), so the greatest of a chain stays.
    """
    size = members.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("n").cast("long")).alias("grams"))
    sized = join_unique(members, size, ["sig"]).select("sid", F.struct("size", "sig").alias("group"))
    largest = sized.groupBy("sid").agg(F.max("group").alias("largest"))
    ends = join_unique(sized, largest, ["sid"]).groupBy("group").agg(F.min("largest").alias("low"), F.max("largest").alias("high"))
    tried = ends.select("group", F.explode(F.array_distinct(F.array("low", "high"))).alias("other")).where("other > group")
    tried = tried.select(F.col("group.sig").alias("sig"), F.col("group.size").alias("size"), F.col("other.sig").alias("other"))
    inside = tried.join(members.select("sig", "sid"), "sig")
    inside = inside.join(members.select(F.col("sig").alias("other"), "sid"), ["other", "sid"])
    within = inside.groupBy("sig", "other", "size").agg(F.count(F.lit(1)).alias("n")).where("n = size").select("sig").distinct()
    chunks = F.ceil(F.col("grams") / F.lit(chunk_grams)).cast("int").alias("k")
    return join_unique(members, size.join(within, "sig", "left_anti").select("sig", chunks), ["sig"])


def _delivered(docs: DataFrame, dealt: DataFrame, n: int) -> DataFrame:
    """``dealt`` with the ``grams`` of its sets, from the blocks that have them."""

    def deliver(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {sid: None for sid in right["sid"].to_pylist()}
        if found:
            for texts in left["text"].chunks:
                for grams, bounds in gram_sets(texts, n):
                    for x, sid in enumerate(_as_list(set_ids(grams, bounds))):
                        if sid in found and found[sid] is None:
                            found[sid] = packed_grams(grams[bounds[x] : bounds[x + 1]])
        grams = pa.array([found[sid] for sid in right["sid"].to_pylist()], pa.binary())
        return right.drop_columns(["_block"]).append_column("grams", grams)

    sides = docs.groupBy("_block").cogroup(dealt.groupBy("_block"))
    return sides.applyInArrow(deliver, "sig long, i int, j int, chunk int, sid binary, grams binary")


class PrefixTree:
    """A trie of integer sequences, with runs of unbranched steps as one node.

    Nodes come in depth-first order as (first, end, depth, until): the sequences ``first`` to ``end`` share the
    steps ``depth`` to ``until``.
    """

    def __init__(self, sequences: list[tuple[int, ...]]):
        self.order = sorted(range(len(sequences)), key=sequences.__getitem__)
        self.rows = [sequences[i] for i in self.order]
        self.sizes = np.array([len(r) for r in self.rows])
        common = []
        for x, y in zip(self.rows, self.rows[1:]):
            if len(x) <= len(y) and y[: len(x)] == x:
                common.append(len(x))
            else:
                common.append(next(i for i, (p, q) in enumerate(zip(x, y)) if p != q))
        self.common = np.array(common, np.int64)

    def children(self, first: int, end: int, depth: int) -> list[tuple[int, int, int]]:
        """(first, end, until) of the branches below ``depth``; sequences that end there are left out."""
        while first < end and self.sizes[first] == depth:
            first += 1
        if first == end:
            return []
        cuts = [first, *(np.flatnonzero(self.common[first : end - 1] <= depth) + first + 1).tolist(), end]
        out = []
        for a, b in zip(cuts, cuts[1:]):
            until = int(self.common[a : b - 1].min()) if b - a > 1 else int(self.sizes[a])
            out.append((a, b, until))
        return out


def linked_pairs(index: list[np.ndarray], probes: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(probe, index) pairs with ``100 * overlap >= percent * union``; sequences of ranks, ascending."""
    tree = PrefixTree([tuple(s.tolist()) for s in index])
    width = 1 + max(int(s[-1]) for s in [*index, *probes])
    has = np.zeros((len(probes), width), bool)
    for i, s in enumerate(probes):
        has[i, s] = True
    sizes = np.array([len(s) for s in probes])
    least = -(-percent * sizes // 100)
    found = []
    every = np.arange(len(probes))
    stack = [(a, b, 0, until, every, np.zeros(len(probes), np.int64)) for a, b, until in tree.children(0, len(index), 0)]
    while stack:
        first, end, depth, until, active, overlap = stack.pop()
        steps = np.array(tree.rows[first][depth:until])
        overlap = overlap + has[active[:, None], steps[None, :]].sum(axis=1)
        below = tree.sizes[first:end]
        # The best set below: its remaining n-grams and the probe's, against the least overlap that links.
        small = np.maximum(int(below.min()), least[active])
        rest = np.minimum(int(below.max()) - until, sizes[active] - overlap)
        needed = -(-percent * (sizes[active] + small) // (100 + percent))
        live = (overlap + rest >= needed) & (100 * int(below.max()) >= percent * sizes[active])
        active, overlap = active[live], overlap[live]
        if not len(active):
            continue
        at = first
        while at < end and tree.sizes[at] == until:
            union = sizes[active] + until - overlap
            found += [(int(p), tree.order[at]) for p in active[100 * overlap >= percent * union]]
            at += 1
        stack += [(a, b, until, to, active, overlap) for a, b, to in tree.children(at, end, until)]
    return found


def _join_groups(rows: DataFrame, levels, percent: int) -> DataFrame:
    """Spanning edges of the links within the groups of ``sig, i, j``, whose rows come together."""

    def solve(key, chunk_of, sids, payloads):
        grams = [unpacked_grams(p) for p in payloads]
        flat = np.unique(np.concatenate(grams))
        order = (np.sort(_keys(flat, levels.value)) & MASK)[::-1]
        rank = np.empty(len(flat), np.int64)
        rank[np.searchsorted(flat, order)] = np.arange(len(flat))
        ranked = [np.sort(rank[np.searchsorted(flat, g)]) for g in grams]
        mine = [x for x, c in enumerate(chunk_of) if c == key[1]]
        other = mine if key[1] == key[2] else [x for x, c in enumerate(chunk_of) if c == key[2]]
        if not mine or not other:
            return []
        root = list(range(len(sids)))

        def top(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        edges = []
        for p, q in linked_pairs([ranked[x] for x in mine], [ranked[x] for x in other], percent):
            u, v = top(other[p]), top(mine[q])
            if u != v:
                root[u] = v
                edges.append((sids[other[p]], sids[mine[q]]))
        return edges

    def run(batches):
        key, held = None, ([], [], [])
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("sig", "i", "j", "chunk", "sid", "grams")]
            edges = []
            for sig, i, j, chunk, sid, grams in zip(*columns):
                if (sig, i, j) != key:
                    if len(held[0]) > 1:
                        edges += solve(key, *held)
                    key, held = (sig, i, j), ([], [], [])
                for to, value in zip(held, (chunk, sid, grams)):
                    to.append(value)
            yield _edge_batch(edges)
        if len(held[0]) > 1:
            yield _edge_batch(solve(key, *held))

    return rows.mapInArrow(run, "u binary, v binary")


def _edge_batch(edges: list) -> pa.RecordBatch:
    u, v = zip(*edges) if edges else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])


def ngram_join(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    n: int = 4,
    percent: int = 85,
    block_bytes: int = BLOCK_BYTES,
    chunk_grams: int = CHUNK_GRAMS,
) -> DataFrame:
    """Documents whose sets of ``n``-word shingles link, as connected components.

    Words are lower-cased in A-Z; fewer than ``n`` words are one shingle; NULL, empty and blank texts have an
    empty set and link with nothing. Two rows link if ``100 * intersection >= percent * union``. Per row:
    ``doc_id``, ``n_shingles``, ``component_id``, the smallest doc_id reachable by links, itself included (NULL
    only where no row of the component has an id). Repeated rows are equal sets. Sets are compared by 48-bit
    shingle hashes (a wrong overlap in about one of 10^8 compared pairs of 1,700 shingles). An empty table gives an empty result; other columns are not read.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    buckets, partitions = parts_for(docs, "text", block_bytes)
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    scanned = _scan(docs, n)
    levels = spark.sparkContext.broadcast(_levels(scanned))  # CELLS bytes

    members = _memberships(docs, levels, n, percent, buckets, partitions)
    dealt = _dealt(_candidates(members, scanned, percent, partitions), chunk_grams)
    block = F.pmod("row", F.lit(buckets)).alias("_block")
    texts = _marked(docs, dealt).select(block, "text")
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("sid"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    ends = F.least("x", "chunk").alias("i"), F.greatest("x", "chunk").alias("j")
    dealt = dealt.select(block, "sig", *ends, "chunk", "sid")
    keys = ["sig", "i", "j"]
    together = _delivered(texts.repartition(partitions, "_block"), dealt, n)
    together = together.repartition(partitions, *keys).sortWithinPartitions(*keys)
    roots = components(_join_groups(together, levels, percent))

    ids = scanned.where("slice IS NULL").select("doc_id", "sid", "n")
    named = join_unique(ids, roots.select(F.col("u").alias("sid"), F.col("v").alias("root")), ["sid"], "left")
    named = named.select("doc_id", "n", F.coalesce("root", "sid").alias("root"))
    first = named.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = join_unique(named, first, ["root"], "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(df: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that stand for their component: those with its smallest id, one of equal rows.

    A row's fate follows its id. Rows without an id cannot be told from others and stay, as do empty texts.
    """
    found = ngram_join(df, id_col, text, **options).where("doc_id IS NOT NULL AND doc_id = component_id")
    keep = found.select(F.col("doc_id").alias(id_col)).distinct()
    stays = df.where(F.col(id_col).isNotNull()).join(keep, id_col, "left_semi").select(df.columns)
    same = Window.partitionBy(id_col, F.xxhash64(text)).orderBy(F.length(text))
    numbered = stays.select(F.struct(*df.columns).alias("row"), F.row_number().over(same).alias("nth"))
    return numbered.where("nth = 1").select("row.*").unionByName(df.where(F.col(id_col).isNull()))
