"""Token operators against the library, and the Elias-Fano files against plain lists."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from prefspark.llm.bpe_automaton import BatchEncoder, TokenizationAutomaton, WordBpe, bpe_codec, codec_digests, coder
from prefspark.llm.common import pieces
from prefspark.llm.elias_fano import EliasFano, token_file_index
from prefspark.llm.token_counts import chunked_ids, load, token_counts

NAME = "word_bpe_49k.json"
TEXTS = [
    None, "", "   \n\t ", "Hello WORLD's 123", "a\x1cb\x85c　d​e", "x<|endoftext|>y <|STARTOFTEXT|>",
    "é ́e ΣΑΣ İstanbul straße 日本語 😀👍🏽", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "word " * 40_000, "ab" * 40_000,
    "same text", "same text", "͸ Ƛ \U000105c9̇ nul\x00l",
]
SCHEMA = "doc_id long, text string, n_tokens string, token_ids string, id long, tie string, _block string"
ROWS = [(i if i != 3 else None, t, "clash", "clash", 7, "clash", "clash") for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def library():
    return load(NAME)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_automaton_equals_merging_by_rank():
    """Random merge lists over few letters, with repeated symbols, against merging by rank."""
    rng = random.Random(5)

    def merged(word, merges):
        parts = list(word)
        for u, v in merges:
            i = 0
            while i + 1 < len(parts):
                if (parts[i], parts[i + 1]) == (u, v):
                    parts[i : i + 2] = [u + v]
                i += 1
        return parts

    for _ in range(60):
        known, merges = ["a", "b", "c"], []
        while len(merges) < 12:
            u, v = rng.choice(known), rng.choice(known)
            if len(u + v) < 9 and u + v not in known:
                known.append(u + v)
                merges.append((u, v))
        automaton = TokenizationAutomaton(merges, ["a", "b", "c"])
        for _ in range(60):
            word = "".join(rng.choice("aab c".replace(" ", "")) for _ in range(rng.randint(0, 14)))
            assert [automaton.text[x] for x in automaton.encode(word)] == merged(word, merges), (merges, word)


def test_codec_equals_library(docs, library):
    got = bpe_codec(docs).collect()
    assert len(got) == len(TEXTS)
    for row, text in zip(got, TEXTS):
        assert row.token_ids == ids_of(library, text)
        assert row.decoded == library.decode(row.token_ids, skip_special_tokens=False)
        assert row.n_tokens == "clash"


def test_codec_digests(docs, library):
    for row, text in zip(codec_digests(docs).collect(), TEXTS):
        ids = ids_of(library, text)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


class _Rows:
    """Stands for a table: ``mapInArrow`` gives the function back."""

    def __init__(self, schema):
        self.schema = schema

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_codec_digests_hold_little_beside_the_memory_of_pieces(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefghij", k=7)) for _ in range(20_000)]
    texts = [" ".join(rnd.choices(words, k=300)) for _ in range(1000)]
    batch = pa.record_batch([pa.array(range(1000), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    run = codec_digests(_Rows(spark.range(0).withColumnRenamed("id", "doc_id").schema))
    coder("word_bpe_49k.json").pieces(["warm"])
    tracemalloc.start()
    try:
        (out,) = run([batch])
        _, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert out.num_rows == 1000
    assert most < 24 * 2**20


def test_full_table_of_arcs_starts_anew(monkeypatch):
    words = ["".join(random.Random(i).choices("abcdef", k=9)) for i in range(3000)]
    expected = WordBpe().pieces(words)
    monkeypatch.setattr(BatchEncoder, "ARCS", 1200)
    small = WordBpe()
    assert [small.pieces(words[i : i + 50]) for i in range(0, 3000, 50)] == [expected[i : i + 50] for i in range(0, 3000, 50)]
    assert small._batch.built < 1_500


def test_pieces_of_random_texts(library):
    rng = random.Random(3)
    letters = "abcdehinot'019 \t\x1c\x85\xa0  ​　éÜßΣσς日語İ!?<|>-_́😀"
    for _ in range(800):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert coder(NAME).encode(text) == ids_of(library, text), repr(text)


def test_token_counts(docs, library):
    rows = token_counts(docs, chunk=1_000, overlap=64).collect()
    for row, text in zip(rows, TEXTS):
        n = len(ids_of(library, text))
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len((text or "").encode()), n, n > 2048)


def test_chunks_splice_and_widen(library):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aehinorst.,'") for _ in range(rng.randint(1, 12)))
    plain = " ".join(word() for _ in range(4_000))
    solid = "".join(word() for _ in range(600))
    for text, widens in ((plain, False), (plain[:9_000] + solid + plain[:5_000], True), (solid, True)):
        for chunk, overlap in ((512, 64), (700, 300)):
            ids, widened = chunked_ids(library, text, chunk, overlap)
            assert ids == ids_of(library, text)
            assert (widened > 0) or not widens


def test_elias_fano_sequences():
    rng = np.random.default_rng(2)
    for values in ([], [0], [5, 5, 5], range(3_000), np.cumsum(rng.integers(0, 9, 5_000)), np.sort(rng.integers(0, 1 << 60, 700)),
                   [0] * 600 + [1 << 40] * 600):
        values = np.array(values, np.int64)
        built, used = EliasFano.from_bytes(memoryview(EliasFano.build(values).to_bytes()))
        assert used == len(built.to_bytes())
        assert np.array_equal(built.range(0, len(values)), values)
        for i in rng.integers(0, max(len(values), 1), 60) if len(values) else ():
            assert built[int(i)] == values[i]
        for a in range(0, len(values), 611):
            assert np.array_equal(built.range(a, min(a + 300, len(values))), values[a : a + 300])
    dense = EliasFano.build(np.cumsum(rng.integers(1, 1_000, 100_000)))
    assert len(dense.to_bytes()) * 8 / 100_000 < 2 + np.log2(500) + 0.5


def test_token_files(docs, library):
    got = token_file_index(docs, shard_bytes=4_000).collect()
    ids = {i: [*ids_of(library, t), 2] for i, t in enumerate(TEXTS)}
    order = [3, *(i for i in range(len(TEXTS)) if i != 3)]
    rows = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id))
    start = 0
    for row, i in zip(rows, order, strict=True):
        assert (row.start, row.n_tokens) == (start, len(ids[i]))
        assert row.ids_crc32 == zlib.crc32(np.array(ids[i], "<u4").tobytes())
        start += len(ids[i])


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for run in (bpe_codec, codec_digests, token_counts, token_file_index):
        assert run(empty).count() == 0


def test_repeated_rows_stay(spark):
    twice = spark.createDataFrame([(1, "a b c")] * 3, "doc_id long, text string")
    assert codec_digests(twice).count() == token_counts(twice).count() == 3
    assert sorted(r.start for r in token_file_index(twice).collect()) == [0, 4, 8]


def test_pieces_cut_at_white_space_only():
    assert pieces("a\x1cb c\x85d") == ["a\x1cb", "c", "d"]
