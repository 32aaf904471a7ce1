"""Quality classifier: random-indexing word vectors pooled per document and a two-layer network.

Every word has a sparse random index vector, made from its hash. A *lexicon* of frequent words, those that make up at least
a fixed share of all words of the corpus, also has context vectors: the sums of the index vectors of the words around
them in all documents. A document is the mean of its words' vectors (context and index) beside the mean of its *forms*,
the outlines of words (case, digits, marks), and the shares of words that repeat one just before. The network is trained in
numpy on pooled vectors of a bounded number of labelled rows; its temperature is fitted on rows it has not seen, so
that its outputs are probabilities.

Texts are taken as bytes, many at a time: hashes of words and forms are differences of running sums, so nothing is done
word by word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.llm.common import held, mix, stored

WORD_DIMS, FORM_DIMS, SPARSE = 128, 64, 4
RELATIONS = 2
DIMS = 2 * WORD_DIMS + FORM_DIMS + RELATIONS
SHARE = 1 / 4096  # of all words that a word of the lexicon makes up at least, so that it has at most as many
FIT_ROWS = 5_000  # about as many labelled rows is the network fitted on
LONGEST = 256  # bytes of a word; longer ones count as several
_STEP = 1 << 18  # bytes of text taken at a time
_SLICES = 32
_SPACE, _UPPER, _LOWER, _DIGIT = 0, ord("A"), ord("a"), ord("0")
_OUTLINE = np.arange(256, dtype=np.uint8)
_OUTLINE[[0x20, *range(9, 14)]] = _SPACE
_OUTLINE[0] = 1
_OUTLINE[0x41:0x5B], _OUTLINE[0x61:0x7B], _OUTLINE[0x80:], _OUTLINE[0x30:0x3A] = _UPPER, _LOWER, _LOWER, _DIGIT
_CASELESS = np.arange(1, 257, dtype=np.uint64)
_CASELESS[0x41:0x5B] += np.uint64(32)
_ODD = 0x9E3779B97F4A7C15
np.seterr(over="ignore")


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2^64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            steps = np.full(max(n, 2 * len(self.up)), _ODD, np.uint64), np.full(max(n, 2 * len(self.up)), pow(_ODD, -1, 2**64), np.uint64)
            for x in steps:
                x[0] = 1
            self.up, self.down = map(np.cumprod, steps)
        return self.up, self.down


def _hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of runs of values: what a polynomial over all of them gains within the run, moved to its start."""
    up, down = held("quality powers", _Powers)(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts], 40)


@dataclass
class _Words:
    """Words of some texts end to end: number of the text, hash, hash of the form, and whether it was in a part before."""

    row: np.ndarray
    word: np.ndarray
    form: np.ndarray
    old: np.ndarray


def _parts(texts: list[str | None]) -> Iterator[list[tuple[int, bytes, bool]]]:
    """(number of the text, some of its bytes, whether they go on from the part before), about a step of bytes together.

    A long text is cut at white space, or after another step without any.
    """
    group, size = [], 0
    for row, text in enumerate(texts):
        data, at = text.encode("utf-8", "surrogatepass") if text else b"", 0
        while at < len(data):
            cut = len(data)
            if cut - at > _STEP:
                found = min((i for c in b" \t\n\v\f\r" if (i := data.find(bytes([c]), at + _STEP, at + 2 * _STEP)) >= 0), default=-1)
                cut = found if found >= 0 else min(at + 2 * _STEP, cut)
            group.append((row, data[at:cut], at > 0))
            size += cut - at
            at = cut
            if size >= _STEP:
                yield group
                group, size = [], 0
    if group:
        yield group


def _read(texts: list[str | None]) -> Iterator[_Words]:
    """The words of texts, a step of bytes at a time; a text that goes on brings its last two words again."""
    last = _Words(*(np.empty(0, kind) for kind in (np.int64, np.uint64, np.uint64, bool)))
    for group in _parts(texts):
        data = np.frombuffer(b" ".join([*[part for _, part, _ in group], b""]), np.uint8)
        shape = _OUTLINE[data]
        inside = np.concatenate([[False], shape != _SPACE])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        more = (ends - starts - 1) // LONGEST
        if more.any():
            n = np.cumsum(more + 1)
            nth = np.arange(n[-1] if len(n) else 0) - np.repeat(n - more - 1, more + 1)
            starts, ends = np.repeat(starts, more + 1) + LONGEST * nth, np.repeat(ends, more + 1)
            ends = np.minimum(ends, starts + LONGEST)
        word = _hashes(_CASELESS[data], starts, ends)

        # An outline keeps one sign of a run of letters or digits, and three of any other.
        same = np.zeros(len(shape), bool)
        same[1:] = shape[1:] == shape[:-1]
        fourth = same.copy()
        fourth[2:] &= same[1:-1]
        fourth[3:] &= same[1:-2]
        fourth[:3] = False
        keep = ~(same & ((shape == _UPPER) | (shape == _LOWER) | (shape == _DIGIT)) | fourth)
        keep[starts] = True
        place = np.concatenate([[0], np.cumsum(keep)])
        form = _hashes(shape[keep].astype(np.uint64), place[starts], place[ends])

        begins = np.cumsum([0] + [len(part) + 1 for _, part, _ in group[:-1]])
        row = np.array([r for r, _, _ in group])[np.searchsorted(begins, starts, "right") - 1]
        now = _Words(row, word, form, np.zeros(len(row), bool))
        if group[0][2]:
            last.old[:] = True
            now = _Words(*(np.concatenate([getattr(last, k), getattr(now, k)]) for k in ("row", "word", "form", "old")))
        yield now
        tail = max(len(now.row) - 2, int(np.searchsorted(now.row, group[-1][0])))
        last = _Words(now.row[tail:], now.word[tail:], now.form[tail:], now.old[tail:].copy())


def _slots(hashes: np.ndarray, dims: int) -> np.ndarray:
    """Non-zero places of index vectors, ``SPARSE`` each; those of the second ``dims`` places count -1."""
    bits = np.arange(SPARSE, dtype=np.uint64) * np.uint64(16)
    return ((hashes[:, None] >> bits) & np.uint64(2 * dims - 1)).astype(np.int64)


def _summed(row: np.ndarray, rows: int, slots: np.ndarray, dims: int) -> np.ndarray:
    """Sums of index vectors by row."""
    counts = np.bincount((row[:, None] * (2 * dims) + slots).ravel(), minlength=rows * 2 * dims).reshape(rows, 2, dims)
    return counts[:, 0] - counts[:, 1]


def _known(lexicon: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in the lexicon (sorted hashes) and whether it is there."""
    slot = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
    return slot, lexicon[slot] == h


def context_sums(texts: list[str | None], lexicon: np.ndarray) -> np.ndarray:
    """Sums of the index vectors around the words of the lexicon: two words to either side."""
    total = np.zeros((len(lexicon), WORD_DIMS), np.int64)
    for w in _read(texts):
        slot, known = _known(lexicon, w.word)
        slots = _slots(w.word, WORD_DIMS)
        for step in (1, 2):
            first, second = slice(None, max(len(w.row) - step, 0)), slice(step, None)
            pair = (w.row[first] == w.row[second]) & ~w.old[second]
            for here, near in ((first, second), (second, first)):
                k = pair & known[here]
                total += _summed(slot[here][k], len(lexicon), slots[near][k], WORD_DIMS)
    return total


def pool(texts: list[str | None], lexicon: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """One row per text: mean index and context vector of the words, mean form vector, repeats; zeros without words."""
    out, sizes = np.zeros((len(texts), DIMS)), np.zeros(len(texts))
    for w in _read(texts):
        new = ~w.old
        row, word, form = w.row[new], w.word[new], w.form[new]
        if not len(row):
            continue
        low, n = int(row[0]), int(row[-1] - row[0]) + 1
        sizes[low : low + n] += np.bincount(row - low, minlength=n)
        part = out[low : low + n]
        part[:, :WORD_DIMS] += _summed(row - low, n, _slots(word, WORD_DIMS), WORD_DIMS)
        if len(lexicon):
            slot, known = _known(lexicon, word)
            counts = np.bincount((row[known] - low) * len(lexicon) + slot[known], minlength=n * len(lexicon))
            part[:, WORD_DIMS : 2 * WORD_DIMS] += counts.reshape(n, -1) @ vectors
        part[:, 2 * WORD_DIMS : -RELATIONS] += _summed(row - low, n, _slots(form, FORM_DIMS), FORM_DIMS)
        for back in (1, 2):  # whether a word is the one so many words before
            again = (w.word[back:] == w.word[:-back]) & (w.row[back:] == w.row[:-back]) & new[back:]
            part[:, back - 1 - RELATIONS] += np.bincount(w.row[back:][again] - low, minlength=n)
    return out / np.maximum(sizes, 1)[:, None]


@dataclass
class Network:
    """Standardised inputs, one hidden layer with ReLU, one logit divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def _spread() -> np.ndarray:
    """Per input: the size of its block, so that words, contexts, forms and repeats weigh alike as blocks."""
    blocks = (WORD_DIMS, WORD_DIMS, FORM_DIMS, RELATIONS)
    return np.concatenate([np.full(n, np.sqrt(n) / 2) for n in blocks])


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, rate: float = 3e-3, decay: float = 3e-3) -> Network:
    """Adam on the logistic loss over four fifths of the rows; the temperature on the rest."""
    rng = np.random.default_rng(0)
    calibrate = np.arange(len(y)) % 5 == 4
    fit, held = np.flatnonzero(~calibrate), np.flatnonzero(calibrate)
    mean = x[fit].mean(axis=0) if len(fit) else np.zeros(x.shape[1])
    scale = x[fit].std(axis=0) + 1e-4 if len(fit) else np.ones(x.shape[1])
    scale = scale * _spread()
    net = Network(mean, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
                  rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0)
    z = (x - mean) / scale
    names, step = ("w1", "b1", "w2", "b2"), 0
    first = {k: 0.0 for k in names}
    second = {k: 0.0 for k in names}
    for _ in range(epochs):
        order = rng.permutation(fit)
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            pre = z[rows] @ net.w1 + net.b1
            act = np.maximum(pre, 0)
            error = 1 / (1 + np.exp(-np.clip(act @ net.w2 + net.b2, -500, 500))) - y[rows]
            back = np.outer(error, net.w2) * (pre > 0)
            grads = {
                "w1": z[rows].T @ back / len(rows) + decay * net.w1,
                "b1": back.mean(axis=0),
                "w2": act.T @ error / len(rows) + decay * net.w2,
                "b2": error.mean(),
            }
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, getattr(net, k) - rate * move)
    if len(held):
        logit = net.logits(x[held])
        loss = lambda t: np.logaddexp(0, np.where(y[held] > 0, -logit, logit) / t).mean()
        net.temperature = float(min(np.geomspace(0.25, 8, 60), key=loss))
    return net


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves no rest by 5; FALSE for a NULL id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class QualityModel:
    lexicon: np.ndarray
    vectors: np.ndarray
    network: Network

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.network(pool(texts, self.lexicon, self.vectors))


def _lexicon(docs: DataFrame, share: float) -> np.ndarray:
    """Hashes of the words that make up ``share`` of all words or more, at most ``1 / share``; sorted."""

    def run(batches):
        for batch in batches:
            parts = [np.unique(w.word[~w.old], return_counts=True) for w in _read(batch.column("text").to_pylist())]
            for words, counts in parts:
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["h", "n"])

    counted = stored(docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "quality-words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    frequent = counted.where(F.col("n") >= F.lit(share) * F.lit(total)).select("h").collect()
    return np.sort(np.array([r["h"] for r in frequent], np.int64).view(np.uint64))


def _vectors(docs: DataFrame, lexicon: np.ndarray) -> np.ndarray:
    """Context vectors of the lexicon over all documents, of length one. Tasks' sums are added slice by slice, in two steps."""
    vectors = np.zeros((len(lexicon), WORD_DIMS))
    if not len(lexicon):
        return vectors
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    width = -(-len(lexicon) // _SLICES)

    def run(batches):
        total = np.zeros((len(lexicon), WORD_DIMS), np.int64)
        for batch in batches:
            total += context_sums(batch.column("text").to_pylist(), shared.value)
        task = TaskContext.get().partitionId()
        for i in range(0, len(lexicon), width):
            payload = zlib.compress(total[i : i + width].tobytes(), 1)
            yield pa.RecordBatch.from_pylist([{"slice": i, "part": task % 256, "payload": payload}], schema)

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(1, np.int64)
        for payload in group["payload"]:
            total = total + np.frombuffer(zlib.decompress(payload.as_buffer()), np.int64)
        row = {"slice": group["slice"][0].as_py(), "part": 0, "payload": zlib.compress(total.tobytes(), 1)}
        return pa.Table.from_pylist([row], schema)

    schema = pa.schema([("slice", pa.int64()), ("part", pa.int64()), ("payload", pa.binary())])
    ddl = "slice long, part long, payload binary"
    summed = docs.select("text").mapInArrow(run, ddl)
    for _ in range(2):
        summed = summed.groupBy("slice", "part").applyInArrow(add, ddl)
    for row in summed.collect():  # one row a slice
        part = np.frombuffer(zlib.decompress(row["payload"]), np.int64).reshape(-1, WORD_DIMS)
        vectors[row["slice"] : row["slice"] + len(part)] = part
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, share: float = SHARE) -> QualityModel:
    """Lexicon and context vectors of all documents; a network fitted on about ``fit_rows`` labelled rows not held out.

    ``labels`` has ``doc_id`` and ``quality`` (NULL: not used; of repeated ids the largest label counts). Of more rows than
    ``fit_rows`` those count whose hashed ids fall below the share that leaves as many. The driver gets the pooled vectors of
    those rows, the lexicon and its context vectors. Without labels the network stays as initialised.
    """
    texts = docs.select("doc_id", "text")
    lexicon = _lexicon(texts, share)
    vectors = _vectors(texts, lexicon)
    chosen = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out("doc_id"))
    chosen = chosen.groupBy("doc_id").agg(F.max("quality").cast("long").alias("quality"))
    n = chosen.count()
    if n > fit_rows:
        chosen = chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < fit_rows * (1 << 30) // n)
    rows = texts.join(F.broadcast(chosen), "doc_id")  # about fit_rows

    def pooled(batches):
        for batch in batches:
            x = pool(batch.column("text").to_pylist(), lexicon, vectors).astype("<f4")
            data = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), data], ["doc_id", "quality", "x"])

    got = rows.mapInArrow(pooled, "doc_id long, quality long, x binary").collect()
    got.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r["doc_id"])), bytes(r["x"])))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in got), "<f4").reshape(-1, DIMS).astype(np.float64)
    return QualityModel(lexicon, vectors, train(x, np.array([r["quality"] for r in got], np.float64)))


def quality_scores(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text: str = "text", least: float = 0.3) -> DataFrame:
    """Per row ``doc_id``, ``held_out``, ``score`` (probability of label 1) and ``predicted`` (1 from ``least`` on).

    The score depends on the text alone, all of it; NULL and empty texts get the score of no words. Rows keep
    their number; an empty table gives an empty result; other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            scores = shared.value.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()),
                 pa.array((scores >= least).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_quality(df: DataFrame, model: QualityModel, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows whose text scores ``least`` or more, unchanged.

    NULL and empty texts have the score of no words, and stay or go by it; an empty table stays empty.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            scores = shared.value.score(batch.column(at).to_pylist())
            yield batch.filter(pa.array(scores >= least))

    return df.mapInArrow(run, df.schema)
