"""Resampling documents towards a target distribution, by hashed n-gram features.

Every run of one to three words is a feature and falls into one of a fixed number of buckets, by its crc32. What
a bucket gains is the log ratio of its share in the target to its share in all documents; the gains are one array
that each task holds. A document's weight is the sum over its features, and a seeded Gumbel draw beside the weight
turns the greatest scores into a sample without replacement.

The cutoff of the draw comes without sorting all scores: a quantile sketch proposes a bracket, exact counts outside
of it validate or widen it, and only the bracket is sorted, to find the row that the draw ends with.

The crc32 of a run of words comes from those of its words: crc(a b) is crc(a) shifted by the length of " b", which is
a linear map, xor crc(" b"). So words are hashed once, and runs by table look-ups, both over whole batches of texts.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.llm.common import stored
from prefspark.operators.positions import dense_position

BUCKETS = 10_000
RUN = 3  # words of the longest feature
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
_STEP = 1 << 20  # bytes of text taken at a time
_SIGNS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def _shift_byte(v: np.ndarray) -> np.ndarray:
    """What a crc32 register becomes when a zero byte follows."""
    for _ in range(8):
        v = (v >> np.uint32(1)) ^ np.where(v & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return v


def _apply(table: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A linear map, as its values at each byte of the register, applied to registers."""
    out = table[0][v & np.uint32(255)]
    for i in (1, 2, 3):
        out = out ^ table[i][(v >> np.uint32(8 * i)) & np.uint32(255)]
    return out


_BYTES = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
_ONE = _shift_byte(_BYTES)  # shift by one byte; its first row is the usual crc table
_SHORT = 64  # bytes of a word that is taken column by column


class _Shifts:
    """Maps of registers when some number of bytes follows: kept for short words, made for others."""

    def __init__(self):
        self.powers = [_ONE]  # 1, 2, 4, … bytes
        self.short = np.stack([self.map(n) for n in range(_SHORT + 2)], axis=1).reshape(4, -1)

    def map(self, length: int) -> np.ndarray:
        out, bit = _BYTES, 0
        while length >> bit:
            if bit == len(self.powers):
                self.powers.append(_apply(self.powers[-1], self.powers[-1]))
            if length >> bit & 1:
                out = _apply(self.powers[bit], out)
            bit += 1
        return out

    def __call__(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        at = np.minimum(length, _SHORT + 1) << 8
        out = np.zeros(len(crc), np.uint32)
        for i in range(4):
            out ^= self.short[i].take(at + ((crc >> np.uint32(8 * i)) & np.uint32(255)))
        for j in np.flatnonzero(length > _SHORT + 1).tolist():
            out[j] = _apply(self.map(int(length[j])), crc[j : j + 1])[0]
        return out


_shifts = _Shifts()


def _word_crcs(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of the words of ``data``: column by column for the short ones, those that go on longest first."""
    signs = np.frombuffer(data, np.uint8)
    order = np.argsort(-np.minimum(sizes, _SHORT + 1), kind="stable")
    order = order[np.searchsorted(-sizes[order], -_SHORT) :] if len(sizes) and sizes.max() > _SHORT else order
    start, size = starts[order], sizes[order]
    left = np.searchsorted(-size, -np.arange(_SHORT + 1), "left")  # words with more than j bytes come first
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for j in range(int(size[0]) if len(size) else 0):
        n = left[j]
        now = crc[:n]
        crc[:n] = _ONE[0].take((now ^ signs.take(start[:n] + j)) & np.uint32(255)) ^ (now >> np.uint32(8))
    out = np.empty(len(sizes), np.uint32)
    out[order] = ~crc
    for i in np.flatnonzero(sizes > _SHORT).tolist():
        out[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]])
    return out


def _runs(alone: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """crc32 of all runs of 1, 2, … words; the i-th of a list belongs to the run that starts at i."""
    out = [alone]
    after = alone ^ _shifts(np.full(len(sizes), zlib.crc32(b" "), np.uint32), sizes)  # of a space and the word
    for n in range(1, min(RUN, len(sizes))):
        out.append(_shifts(out[-1][:-1], sizes[n:] + 1) ^ after[n:])
    return out


def _pieces(texts: list[str | None]):
    """(number of the text, its next signs, how many of their words were already in the piece before).

    A long text comes in pieces, each with the last words of the one before, so that no run is lost.
    """
    for row, text in enumerate(texts):
        if not text:
            continue
        data = text.encode("utf-8", "surrogatepass").translate(_SIGNS)
        at, last = 0, []
        while at < len(data):
            cut = len(data) if len(data) - at <= _STEP else data.find(b" ", at + _STEP)
            cut = len(data) if cut < 0 else cut
            piece = b" ".join([*last, data[at:cut]])
            yield row, piece, len(last)
            if cut < len(data):
                last = piece.split()[1 - RUN :]
            at = cut


def _groups(texts: list[str | None]):
    """Pieces of about one step of bytes together."""
    group, size = [], 0
    for piece in _pieces(texts):
        group.append(piece)
        size += len(piece[1])
        if size > _STEP:
            yield group
            group, size = [], 0
    if group:
        yield group


def features(texts: list[str | None], buckets: int = BUCKETS):
    """(number of the text of each feature, its bucket, number of the text of each word), for parts of the texts in turn."""
    for group in _groups(texts):
        data = b" ".join([piece for _, piece, _ in group])
        inside = np.concatenate([[False], np.frombuffer(data, np.uint8) != 0x20, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        begins = np.cumsum([0] + [len(piece) + 1 for _, piece, _ in group[:-1]])
        first = np.searchsorted(starts, begins)
        piece = np.repeat(np.arange(len(group)), np.diff(np.append(first, len(starts))))
        row = np.array([r for r, _, _ in group])[piece]
        new = np.arange(len(starts)) >= (first + [seen for _, _, seen in group])[piece]
        rows, found = [], []
        for n, crc in enumerate(_runs(_word_crcs(data, starts, sizes), sizes)):
            fits = new[n:] & (piece[n:] == piece[: len(piece) - n])
            rows.append(row[n:][fits])
            found.append((crc[fits] % np.uint32(buckets)).astype(np.int64))
        yield np.concatenate(rows), np.concatenate(found), row[new]


def _bucket_counts(docs: DataFrame, buckets: int) -> np.ndarray:
    """Features by bucket, over all texts; the driver gets one number a bucket."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found, _ in features(batch.column(0).to_pylist(), buckets):
                counts += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in docs.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(all_counts: np.ndarray, target_counts: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's share in the target to its share in all, each with one more per bucket."""
    n = len(all_counts)
    s, t = int(all_counts.sum()), int(target_counts.sum())
    ratio = [((b + 1) * (s + n)) / ((a + 1) * (t + n)) for a, b in zip(all_counts.tolist(), target_counts.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def _draw(seed: int, key: int | None) -> int:
    """Thousandths of a standard Gumbel number, from the sha256 of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


def importance_weights(
    df: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text",
    buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """Per row ``doc_id``, ``n_words``, ``n_features``, ``weight`` and ``score`` (weight and seeded draw), all long.

    Words are runs of digits, lower-cased Latin letters and signs beyond ASCII. NULL and empty texts have none and
    weigh 0; a NULL id draws as the empty id; repeated rows draw alike; an empty target has a share of one in every bucket.
    Other columns are not read. Two narrow passes over the texts, no shuffle of them.
    """
    docs = df.select(F.col(text).alias("text"))
    gain = gains(_bucket_counts(docs, buckets), _bucket_counts(target.select(F.col(target_text).alias("text")), buckets))
    shared = df.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            words, weight = np.zeros(n, np.int64), np.zeros(n)  # sums below 2^53 are exact
            for rows, found, of_word in features(batch.column("text").to_pylist(), buckets):
                weight += np.bincount(rows, shared.value[found], minlength=n)
                words += np.bincount(of_word, minlength=n)
            weight = weight.astype(np.int64)
            grams = sum(np.maximum(words - i, 0) for i in range(RUN))
            drawn = np.array([_draw(seed, i) for i in batch.column("doc_id").to_pylist()], np.int64)
            columns = [batch.column("doc_id"), *map(pa.array, (words, grams, weight, weight + drawn))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight", "score"])

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def cutoff(df: DataFrame, key: str, tie: str, k: int, n: int, margin: float = 0.001) -> tuple[int, int | None]:
    """``key`` and ``tie`` of the ``k``-th of ``n`` rows by greatest ``key``, then least ``tie`` (NULL last).

    A sketch of the quantiles gives a bracket around the k-th; the exact numbers of rows above and inside show
    whether it holds it, and widen it if not. Only the rows inside are sorted, in ranges.
    """
    share = 1 - k / n
    while True:
        wanted = [share - margin, share + margin]
        low, high = df.agg(F.percentile_approx(key, [min(max(w, 0.0), 1.0) for w in wanted], 10_000)).first()[0]
        inside = F.lit(True) if wanted[0] <= 0 else F.col(key) >= low
        above = F.lit(False) if wanted[1] >= 1 else F.col(key) > high
        n_above, n_inside = df.agg(F.count_if(above), F.count_if(inside & ~above)).first()
        if n_above < k <= n_above + n_inside:
            break
        margin *= 4
    bracket = df.where(inside & ~above).select(key, tie)
    placed = dense_position(bracket, [F.desc(key), F.asc_nulls_last(tie)], "_place")
    return tuple(placed.where(F.col("_place") == k - n_above - 1).select(key, tie).first())


def _reaches(key: str, tie: str, cut: tuple[int, int | None]) -> Column:
    """Whether a row is at or before the cutoff."""
    if cut[1] is None:
        return F.col(key) >= cut[0]
    return (F.col(key) > cut[0]) | (F.col(key) == cut[0]) & F.coalesce(F.col(tie) <= cut[1], F.lit(False))


def resample(
    df: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text",
    percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """Per row ``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` in the draw (NULL: not drawn), all long.

    Of the N rows with ``least_words`` words or more, floor(percent * N / 100) are drawn: greatest score first, ties to
    the smaller id, NULL last; of rows of one id and score those with fewer features, then less weight, first. See
    :func:`importance_weights` for NULL, empty and repeated rows; an empty table gives an empty result.
    """
    scored = stored(importance_weights(df, target, id_col, text, target_text, buckets, seed), "importance")
    columns = ["doc_id", "n_features", "weight", "score"]
    able = scored.where(F.col("n_words") >= least_words)
    n = able.count()
    k = percent * n // 100
    if not k:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    reaches = (F.col("n_words") >= least_words) & _reaches("score", "doc_id", cutoff(able, "score", "doc_id", k, n))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight"]
    first = dense_position(scored.where(reaches).select(*columns), order, "_place")
    first = first.select(*columns, F.when(F.col("_place") < k, F.col("_place") + 1).alias("rank"))
    return first.unionByName(scored.where(~reaches).select(*columns, F.lit(None).cast("long").alias("rank")))
