"""Scores by cross-entropy difference of two matched bigram models.

A target corpus and the background, all documents, get models of one form over one vocabulary: the most
frequent words of both together, up to a fixed number, and one sign for all other words; or every word, by its
hash, whose counts then come by the same exchange as the bigrams'. A document's score is
the mean over its words of the loss under the target model less the loss under the background model; the
lower, the nearer to the target. Bigrams are counted exactly over everything: blocks send each distinct bigram
once with its counts, buckets add them up and answer with the loss difference.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm.common import BLOCK_BYTES, SENT, ask, blocked, mix, pack, parts_for, stored, unpack_answers, word_hashes, words

VOCABULARY = 16_384
BIGRAM, UNIGRAM, UNIFORM = 0.7, 0.29, 0.01  # weights of the interpolated model
RECORD = np.dtype([("gram", "<u8"), ("target", "<u4"), ("background", "<u4")])
COUNTS = np.dtype([("target", "<f8"), ("background", "<f8")])
_START = np.uint64(xxhash.xxh3_64_intdigest(b" start"))  # no word has a space


def _tokens(text: str | None) -> list[bytes]:
    return [w.lower() for w in words(text)]


def _word_counts(docs: DataFrame, is_target: bool) -> DataFrame:
    """``word, target, background``; the number of texts with words is the count of the NULL word."""

    def run(batches):
        counts: Counter[bytes] = Counter()
        texts = 0

        def rows():
            found = [(None, texts), *counts.items()]
            word, n = zip(*found)
            zero = [0] * len(n)
            columns = [pa.array(word, pa.binary()), *(pa.array(c, pa.int64()) for c in ((n, zero) if is_target else (zero, n)))]
            return pa.RecordBatch.from_arrays(columns, ["word", "target", "background"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = _tokens(text)
                texts += bool(found)
                counts.update(found)
            if len(counts) > 500_000:
                yield rows()
                counts.clear()
                texts = 0
        yield rows()

    return docs.select("text").mapInArrow(run, "word binary, target long, background long")


class _Models:
    """Unigram counts of both corpora over the vocabulary; place ``len(words)`` is any other word, the next the start."""

    def __init__(self, listed: list[bytes], counts: np.ndarray, totals: np.ndarray, texts: np.ndarray):
        self.ids = {w: i for i, w in enumerate(listed)}
        self.other = len(listed)
        rest = totals - counts.sum(axis=0)
        self.counts = np.vstack([counts, rest, texts]).astype(np.float64)  # columns: target, background
        self.totals = np.maximum(totals.astype(np.float64), 1)

    answers = np.dtype([("loss", "<f8")])

    def grams(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bigram keys of all texts end to end, and the number of words of each text."""
        found = [_tokens(t) for t in texts]
        sizes = np.array([len(f) for f in found], np.int64)
        now = np.fromiter((i for f in found for i in map(self.ids.get, f, repeat(self.other))), np.uint64, int(sizes.sum()))
        before = np.empty_like(now)
        before[1:] = now[:-1]
        starts = np.cumsum(sizes) - sizes
        before[starts[sizes > 0]] = self.other + 1
        return before << np.uint64(32) | now, sizes

    def difference(self, gram: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Loss under the target model less loss under the background model, from bigram counts (two columns)."""
        before, now = (gram >> np.uint64(32)).astype(np.int64), (gram & np.uint64(0xFFFFFFFF)).astype(np.int64)
        history = self.counts[before]
        two = np.divide(counts, history, out=np.zeros_like(history), where=history > 0)
        p = BIGRAM * two + UNIGRAM * self.counts[now] / self.totals + UNIFORM / (self.other + 1)
        return np.log(p[:, 1]) - np.log(p[:, 0])

    def tally(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.grams(texts)[0], return_counts=True)

    def resolve(self, records: np.ndarray, _) -> np.ndarray:
        keys, back = np.unique(records["gram"], return_inverse=True)
        counts = [np.bincount(back, records[c], minlength=len(keys)) for c in ("target", "background")]
        return self.difference(keys, np.stack(counts, axis=1))[back].view(self.answers)

    def losses(self, texts: list[str | None], answered) -> tuple[np.ndarray, np.ndarray]:
        grams, sizes = self.grams(texts)
        keys, back = np.unique(grams, return_inverse=True)
        return answered(keys)["loss"][back], sizes


class _AllWords:
    """Models over every word: words and bigrams are keys of one exchange, and each is answered with its counts."""

    answers = COUNTS

    def __init__(self, n_words: int, totals: np.ndarray):
        self.n_words, self.totals = n_words, np.maximum(totals.astype(np.float64), 1)

    def _keys(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all words end to end: the start, the words and the pairs of the word before and the word; the texts'
        first words; and the number of words of each text."""
        found = [_tokens(t) for t in texts]
        sizes = np.array([len(f) for f in found], np.int64)
        now = word_hashes([w for f in found for w in f])
        before = np.empty_like(now)
        before[1:] = now[:-1]
        firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
        before[firsts] = _START
        both = mix(mix(before, 5) * np.uint64(0x9E3779B97F4A7C15) + now, 5)
        return np.concatenate([[_START], now, both]), firsts, sizes

    def tally(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        keys, firsts, _ = self._keys(texts)
        keys, counts = np.unique(keys, return_counts=True)
        counts[np.searchsorted(keys, _START)] += len(firsts) - 1
        return keys, counts

    def resolve(self, records: np.ndarray, _) -> np.ndarray:
        keys, back = np.unique(records["gram"], return_inverse=True)
        out = np.zeros(len(keys), COUNTS)
        for c in COUNTS.names:
            out[c] = np.bincount(back, records[c], minlength=len(keys))
        return out[back]

    def losses(self, texts: list[str | None], answered) -> tuple[np.ndarray, np.ndarray]:
        keys, firsts, sizes = self._keys(texts)
        keys, place = np.unique(keys, return_inverse=True)
        counts = answered(keys)
        one, two = (counts[p] for p in np.split(place[1:], 2))
        history = np.empty_like(one)
        history[1:] = one[:-1]
        history[firsts] = counts[place[0]]
        p = []
        for total, c in zip(self.totals, COUNTS.names):
            part = np.divide(two[c], history[c], out=np.zeros(len(two)), where=history[c] > 0)
            p.append(BIGRAM * part + UNIGRAM * one[c] / total + UNIFORM / (self.n_words + 1))
        return np.log(p[1]) - np.log(p[0]), sizes


def lm_scores(
    df: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    vocabulary: int | None = VOCABULARY,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per row ``doc_id``, ``n_words`` and ``score``, the mean loss difference; NULL for a text without words.

    Words are lower-cased in A-Z; the vocabulary's ties go to the smaller word by bytes. None takes every word,
    with nothing brought to the driver but sums; words and bigrams are then told apart by 64 bits. NULL texts have no
    words; repeated rows count as often as they occur. An empty target leaves the background's part of the
    target model uniform; an empty table gives an empty result; other columns are not read.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    aims = target.select(F.col(target_text).alias("text"))
    counted = _word_counts(aims, True).unionByName(_word_counts(docs, False)).groupBy("word")
    counted = counted.agg(F.sum("target").alias("target"), F.sum("background").alias("background"))
    if vocabulary is not None:  # else they are read once
        counted = stored(counted, "word-counts")
    known = counted.where("word IS NOT NULL")
    sums = known.agg(F.sum("target"), F.sum("background"), F.count(F.lit(1))).first()
    totals = np.array([n or 0 for n in sums[:2]], np.int64)
    if vocabulary is None:
        models = _AllWords(sums[2], totals)
    else:
        top = known.orderBy(F.desc(F.col("target") + F.col("background")), "word").limit(vocabulary).collect()
        texts = counted.where("word IS NULL").select("target", "background").first()
        models = _Models(
            [bytes(r["word"]) for r in top],
            np.array([(r["target"], r["background"]) for r in top], np.int64).reshape(-1, 2),
            totals,
            np.array(texts or (0, 0), np.int64),
        )
    shared = df.sparkSession.sparkContext.broadcast(models)  # ``vocabulary`` words, or none

    buckets, partitions = parts_for(docs, "text", block_bytes)
    blocks = blocked(docs, buckets, partitions, F.col("doc_id"), F.col("text"))

    def send(column: str):
        def run(group: pa.Table) -> pa.Table:
            keys, counts = shared.value.tally(group["text"].to_pylist())
            records = np.zeros(len(keys), RECORD)
            records["gram"], records[column] = keys, counts
            return pack(group["_block"][0].as_py(), keys, records, buckets, by_column=True)

        return run

    def resolve(records: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        return shared.value.resolve(records, blocks)

    aim_blocks, aim_partitions = parts_for(aims, "text", block_bytes)
    aimed = blocked(aims, aim_blocks, aim_partitions, F.col("text")).withColumn("_block", -1 - F.col("_block"))
    sent = blocks.groupBy("_block").applyInArrow(send("background"), SENT)
    sent = sent.unionByName(aimed.groupBy("_block").applyInArrow(send("target"), SENT))
    answers = ask(sent, resolve, RECORD, partitions, by_column=True).where("_block >= 0")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        answered = lambda keys: unpack_answers(right, keys, buckets, shared.value.answers, by_column=True)
        losses, sizes = shared.value.losses(left["text"].to_pylist(), answered)
        sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), losses, minlength=len(sizes))
        score = pa.array(np.where(sizes > 0, sums / np.maximum(sizes, 1), 0), mask=sizes == 0)
        return pa.table({"doc_id": left["doc_id"], "n_words": pa.array(sizes), "score": score})

    sides = blocks.groupBy("_block").cogroup(answers.groupBy("_block"))
    return sides.applyInArrow(finish, "doc_id long, n_words long, score double")
