"""BPE encoding and decoding by a deterministic tokenization automaton.

The automaton reads tokens (arc labels) and accepts exactly the sequences that BPE gives for their text. It
starts as one state with a loop for each base symbol. One *merge gadget* per merge ``u v -> w``, in order of
rank, changes it if an arc ``v`` leaves the state that ``u`` leads to: that state is copied without the arc
``v`` and every ``u`` is led to the copy, so ``u v`` is no longer accepted; and an arc ``w`` to where ``v``
led is added to each state that has an arc ``u``. Where an arc leads depends on its label alone, so a state
is kept as what sets it apart from the state it was copied from: the labels excluded by gadgets, each with
its rank. Reading a word, each prefix has one accepted token sequence; so one pass over its symbols with the
table of labels, and the transition table, filled as arcs are first met, finds the tokens.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
import unicodedata
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from prefspark.llm.common import PieceMemo, held, pieces, text_runs, vocabulary_path

_WORD_END = 0x8000  # added to the last symbol of a word, which carries the end-of-word mark
NEVER = 1 << 62
RUN_BYTES = 1 << 19  # of text whose pieces are held at once; a longer text is by itself


class TokenizationAutomaton:
    """Deterministic automaton of a merge list over single-character symbols.

    ``merges`` are pairs of symbol strings; every symbol that occurs in no merge is a base label too.
    """

    def __init__(self, merges: list[tuple[str, str]], base: list[str]):
        self.text = list(base)  # label -> its symbols
        self.left = [-1] * len(base)
        self.right = [-1] * len(base)
        self.born = [-1] * len(base)
        self.excluded: list[dict[int, int]] = [{} for _ in base]
        self.prefixes: dict[str, tuple[int, ...]] = {}  # every prefix of a label's symbols -> labels that end here
        self.arcs: dict[tuple[int, int], bool] = {}
        named: dict[str, list[int]] = {}
        for label, symbols in enumerate(base):
            named.setdefault(symbols, []).append(label)
        for rank, (u, v) in enumerate(merges):
            made = [(a, b) for a in named.get(u, ()) for b in named.get(v, ()) if self.follows(a, b)]
            for a, b in made:
                self._gadget(rank, a, b, named)
        for symbols, labels in named.items():
            for i in range(1, len(symbols)):
                self.prefixes.setdefault(symbols[:i], ())
            self.prefixes[symbols] = tuple(labels)

    def _gadget(self, rank: int, u: int, v: int, named: dict[str, list[int]]) -> None:
        w = len(self.text)
        self.text.append(self.text[u] + self.text[v])
        self.left.append(u)
        self.right.append(v)
        self.born.append(rank)
        self.excluded.append({})
        self.excluded[u][v] = rank
        named.setdefault(self.text[w], []).append(w)

    def follows(self, a: int, b: int) -> bool:
        """Whether an arc ``b`` leaves the state that ``a`` leads to.

        An arc added later exists where the arc of its left part did; a state has its own exclusions and,
        up to its birth, those of the label whose state it was copied from.
        """
        until, x = NEVER, a
        while x >= 0:
            excluded = self.excluded[x]
            if excluded:
                y, top = b, NEVER
                while y >= 0:
                    rank = excluded.get(y)
                    if rank is not None and rank < until and rank <= top:  # equal: "u" before a new "uu"
                        return False
                    top, y = self.born[y], self.left[y]
            until, x = self.born[x], self.right[x]
        return True

    def encode(self, symbols: str) -> list[int]:
        """Labels of the one accepted sequence for ``symbols``.

        Long arcs are tried first. A place is reached by one accepted sequence at most, so a place from which
        the rest failed is never tried again.
        """
        n, prefixes, arcs = len(symbols), self.prefixes, self.arcs
        path: list[int] = []
        ways: list[list[tuple[int, int]]] = []  # untried (end, label) from each place of the path
        dead = set()
        at, before = 0, -1
        while at < n:
            found = []
            for end in range(at + 1, n + 1):
                labels = prefixes.get(symbols[at:end])
                if labels is None:
                    break
                for label in labels:
                    found.append((end, label))
            ways.append(found)
            while True:
                if ways[-1]:
                    end, label = ways[-1].pop()
                    if end in dead:
                        continue
                    if path:
                        arc = arcs.get((before, label))
                        if arc is None:
                            if len(arcs) > 1_000_000:
                                arcs.clear()
                            arc = arcs[before, label] = self.follows(before, label)
                        if not arc:
                            continue
                    path.append(label)
                    at, before = end, label
                    break
                dead.add(at)
                ways.pop()
                at -= len(self.text[path.pop()])
                before = path[-1] if path else -1
        return path


class _Table:
    """A fixed map from non-negative int64 keys to int32 values, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys))
        slot = self._home(keys)
        while len(left):
            free = self.keys[slot] < 0
            # Of several keys for one free slot the last written stays; the others move on.
            self.keys[slot[free]] = keys[left[free]]
            placed = self.keys[slot] == keys[left]
            self.values[slot[placed]] = values[left[placed]]
            left, slot = left[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is missing."""
        slot = self._home(keys)
        out = self.values[slot]
        seen = self.keys[slot]
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        out[seen != keys] = -1
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out


class BatchEncoder:
    """The automaton as tables: many words at once, one symbol place at a time.

    ``steps`` leads from (prefix of labels, symbol) to the longer prefix, ``ends`` from a prefix to its label,
    ``arcs`` has the transitions met so far; those first met are found by the automaton and added. Each label
    text must belong to one label.
    """

    SYMBOLS = 1 << 16
    ARCS = 1_000_000  # in the table at most

    def __init__(self, automaton: TokenizationAutomaton):
        self.automaton = automaton
        nodes = {"": 0} | {p: i + 1 for i, p in enumerate(automaton.prefixes)}
        self.ends = np.full(len(nodes), -1, np.int64)
        keys = np.empty(len(nodes) - 1, np.int64)
        for p, labels in automaton.prefixes.items():
            keys[nodes[p] - 1] = nodes[p[:-1]] * self.SYMBOLS + ord(p[-1])
            if labels:
                (self.ends[nodes[p]],) = labels
        self.steps = _Table(keys, np.arange(1, len(nodes)))
        self.sizes = np.array([len(t) for t in automaton.text])
        self.fresh: dict[int, bool] = {}  # arcs that are not in the table yet
        self.arcs, self.built = _Table(np.empty(0, np.int64), np.empty(0, np.int32)), 0

    def _rebuild(self) -> None:
        """Put the fresh arcs to the table; a full one starts anew."""
        keys = np.fromiter(self.fresh, np.int64, len(self.fresh))
        values = np.fromiter(self.fresh.values(), np.int32, len(keys))
        if self.built + len(keys) <= self.ARCS:
            old = self.arcs.keys >= 0
            keys, values = np.concatenate([self.arcs.keys[old], keys]), np.concatenate([self.arcs.values[old], values])
        self.arcs, self.built = _Table(keys, values), len(keys)
        self.fresh = {}

    def allowed(self, before: np.ndarray, label: np.ndarray) -> np.ndarray:
        keys = before * (1 << 31) + label
        out = self.arcs(keys)
        new = np.flatnonzero(out < 0)
        if len(new):
            fresh, follows = self.fresh, self.automaton.follows
            for i in new.tolist():
                key = int(keys[i])
                if key not in fresh:
                    fresh[key] = follows(key >> 31, key & ((1 << 31) - 1))
                out[i] = fresh[key]
            if len(fresh) > 0.2 * self.built + 1_000:
                self._rebuild()
        return out > 0

    def __call__(self, words: list[str]) -> list[list[int]]:
        """Labels of every word."""
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        symbols = np.frombuffer("".join(words).encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.int64)
        width = int(sizes.max(initial=0)) + 1
        last = np.full((n, width), -1, np.int64)
        for at in range(width - 1):
            rows = np.flatnonzero((sizes > at) & ((last[:, at] >= 0) | (at == 0)))
            before, node, place = last[rows, at], np.zeros(len(rows), np.int64), starts[rows] + at
            end = at
            while len(rows):
                node = self.steps(node * self.SYMBOLS + symbols[place]).astype(np.int64)
                end += 1
                label = np.where(node >= 0, self.ends[node], -1)
                hit = np.flatnonzero(label >= 0)
                if at and len(hit):
                    hit = hit[self.allowed(before[hit], label[hit])]
                last[rows[hit], end] = label[hit]
                on = np.flatnonzero((node >= 0) & (sizes[rows] > end))
                rows, before, node, place = rows[on], before[on], node[on], place[on] + 1
        found, where, rows, at = [], [], np.flatnonzero(sizes > 0), sizes[sizes > 0]
        while len(rows):
            label = last[rows, at]
            found.append(label)
            where.append(rows)
            at = at - self.sizes[label]
            rows, at = rows[at > 0], at[at > 0]
        if not found:
            return [[] for _ in words]
        where, found = np.concatenate(where)[::-1], np.concatenate(found)[::-1]
        flat = found[np.argsort(where, kind="stable")].tolist()
        cuts = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=n))]).tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in set(shown) else next(hidden)) for b in range(256)]


def _newer_letters() -> str:
    """Letters and numbers that ``unicodedata`` does not know yet, but the regex module does."""
    known = regex.compile(r"[\p{L}\p{N}]")
    return "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn" and known.match(c))


def _ranges(chars: str) -> str:
    """A character class body."""
    runs: list[list[int]] = []
    for c in map(ord, chars):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in runs)


def _without(pattern: str, chars: str) -> str:
    """``pattern`` with ``chars`` counted as neither letters nor numbers."""
    if not chars:
        return pattern
    for name in (r"\p{L}", r"\p{N}"):
        pattern = pattern.replace(f"[{name}]", f"[{name}--[{_ranges(chars)}]]")
    return pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{_ranges(chars)}]]")


class WordBpe:
    """Encoder and decoder for a vocabulary file of byte-level BPE with word ends, lower case, no white space.

    ``encode`` gives ids as the tokenizers library does without added special tokens: strings of special tokens
    in a text give their ids; texts are put in NFC and lower case, cut into words, digits and runs of other
    characters, and each of those is encoded by the automaton. ``decode`` joins the arc labels by spaces.
    """

    TOGETHER = 48  # symbols

    def __init__(self, name: str = "word_bpe_49k.json"):
        with open(vocabulary_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label_text = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self._merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self._cut_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # Three Unicode versions meet here; the library's decides what is a letter and what its lower case is.
        newer = _newer_letters()
        letters = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed", invert=True).pre_tokenize_str(newer)
        unknown = "".join(sorted(set(newer) - {c for found, _ in letters for c in found}))
        self._newer = regex.compile(f"[{_ranges(newer)}]") if newer else None
        self._hint = os.path.commonprefix(list(self.special))
        self._word = regex.compile(_without(split, unknown), regex.VERSION1)
        self._bytes = byte_symbols()

    def _symbols(self, token: str) -> str:
        if token.endswith(self.end) and token != self.end:
            token = token[: -len(self.end)]
            return token[:-1] + chr(ord(token[-1]) + _WORD_END)
        return token

    @cached_property
    def automaton(self) -> TokenizationAutomaton:
        base = [s for b in self._bytes for s in (b, chr(ord(b) + _WORD_END))]
        return TokenizationAutomaton([(self._symbols(u), self._symbols(v)) for u, v in self._merges], base)

    @cached_property
    def _label_ids(self) -> list[int]:
        ids = {self._symbols(s): i for s, i in self.vocab.items()}
        return [ids[text] for text in self.automaton.text]

    @cached_property
    def _batch(self) -> BatchEncoder:
        return BatchEncoder(self.automaton)

    @cached_property
    def _words(self) -> PieceMemo:
        return PieceMemo(self._encode_words, 200_000)

    @cached_property
    def digest_texts(self) -> PieceMemo:
        """Of pieces, as bytes: their decimal ids, a line break and their labels, with a space after each id and label."""
        return PieceMemo(lambda new: [self._digest_text(i) for i in self.pieces(new)], 400_000)

    def _digest_text(self, ids: list[int]) -> bytes:
        if not ids:
            return b"\n"
        return f"{' '.join(map(str, ids))} \n{self.decode(ids)} ".encode()

    def digests(self, texts: pa.Array) -> tuple[list[int], list[str], list[str]]:
        """Of each text: the number of its ids, and the digests of its ids and of its labels, both joined by a space.

        Pieces are numbered by Arrow: the memory is asked once for each different one, and no step is per piece.
        """
        parts = [pieces(t) if t else [] for t in texts.to_pylist()]
        ends = np.cumsum([len(part) for part in parts])
        numbered = pa.array([p for part in parts for p in part], pa.string()).dictionary_encode()
        del parts
        halves = [v.split(b"\n", 1) for v in self.digest_texts(numbered.dictionary.to_pylist())]
        counts = np.fromiter((ids.count(b" ") for ids, _ in halves), np.int64, len(halves))
        totals = np.concatenate([[0], np.cumsum(counts[numbered.indices.to_numpy()])])[np.concatenate([[0], ends])]
        hashes = []
        for half in (0, 1):
            laid = pa.array([pair[half] for pair in halves], pa.large_binary()).take(numbered.indices)
            places = np.frombuffer(laid.buffers()[1], np.int64)[laid.offset : laid.offset + len(laid) + 1] if len(laid) else np.zeros(1, np.int64)
            data = memoryview(laid.buffers()[2] or b"")
            cuts = places[np.concatenate([[0], ends])].tolist()
            # Without the last space. A text can have pieces and no ids: a piece may be empty after normalisation.
            hashes.append([hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(cuts, cuts[1:])])
        return np.diff(totals).tolist(), *hashes

    def pieces(self, found: list[str]) -> list[list[int]]:
        """Ids of texts without white space."""
        units = [self._units(p) for p in found]
        words = [w for unit in units for w in unit if isinstance(w, str)]
        ids = iter(self._words(words))
        return [[i for w in unit for i in (next(ids) if isinstance(w, str) else (w,))] for unit in units]

    def _units(self, piece: str) -> list[str | int]:
        """Words, and ids of special tokens, of a piece."""
        if self._hint not in piece:
            return self._split(piece)
        out: list[str | int] = []
        at = 0
        for m in self._cut_special.finditer(piece):
            out += [*self._split(piece[at : m.start()]), self.special[m.group()]]
            at = m.end()
        return out + self._split(piece[at:])

    def _split(self, text: str) -> list[str]:
        if text.isascii():
            text = text.lower()
            return [text] if text.isalpha() else self._word.findall(text)
        if self._newer is not None and self._newer.search(text):
            text = normalizers.Lowercase().normalize_str(normalizers.NFC().normalize_str(text))
        text = unicodedata.normalize("NFC", text)
        # Lower case letter by letter: the final form of sigma depends on its neighbours in str.lower.
        text = "σ".join(part.lower() for part in text.split("Σ")) if "Σ" in text else text.lower()
        return self._word.findall(text)

    def _encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of whole words: long ones one by one, the others together."""
        ids, table = self._label_ids, self._bytes
        symbols = []
        for word in words:
            if not (word.isascii() and word.isprintable()):
                word = "".join([table[b] for b in word.encode("utf-8", "surrogatepass")])
            symbols.append(word[:-1] + chr(ord(word[-1]) + _WORD_END))
        short = [i for i, w in enumerate(symbols) if len(w) <= self.TOGETHER]
        labels = {i: self.automaton.encode(w) for i, w in enumerate(symbols) if len(w) > self.TOGETHER}
        labels.update(zip(short, self._batch([symbols[i] for i in short])))
        return [[ids[label] for label in labels[i]] for i in range(len(words))]

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in self.pieces(pieces(text or "")) for i in ids]

    def decode(self, ids) -> str:
        """The labels of the arcs, joined by one space; unknown ids give nothing."""
        return " ".join(self.label_text[i] for i in ids if i in self.label_text)


def coder(name: str) -> WordBpe:
    """The compiled vocabulary, kept in this process."""
    return held(f"coder {name}", lambda: WordBpe(name))


def bpe_codec(df: DataFrame, text: str = "text", vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """Add ``token_ids array<int>`` and ``decoded string`` (the ids decoded again) to every row.

    NULL and empty texts give no ids and an empty text. Existing columns with these names are replaced.
    """
    rest = [c for c in df.columns if c not in ("token_ids", "decoded")]
    schema = df.select(rest).withColumns({"token_ids": F.array(F.lit(0)), "decoded": F.lit("")}).schema

    def run(batches):
        code = coder(vocabulary)
        memo = PieceMemo(code.pieces, 200_000)
        for batch in batches:
            texts = memo.texts(batch.column(text).to_pylist())
            ids = [[i for got in parts for i in got] for parts in texts]
            columns = [batch.column(c) for c in rest]
            columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(map(code.decode, ids), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*rest, "token_ids", "decoded"])

    return df.mapInArrow(run, schema)


def codec_digests(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = "word_bpe_49k.json"
) -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids_sha256`` of the decimal ids joined by a space, ``decoded_sha256``.

    The same automaton; the texts of a piece's ids and of its labels are remembered with it. A batch is read in runs of
    texts, which bounds what a task holds beside that memory. Rows keep their
    number, repeated or not; a NULL or empty text has 0 tokens and the digests of an empty text.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        code = coder(vocabulary)
        for batch in batches:
            counts, id_hash, text_hash = [], [], []
            for texts in text_runs(batch.column(text), RUN_BYTES):
                for column, values in zip((counts, id_hash, text_hash), code.digests(texts)):
                    column += values
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(counts, pa.int64()), pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return df.select(id_col, text).mapInArrow(run, schema)
