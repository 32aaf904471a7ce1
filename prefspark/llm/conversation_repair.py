"""Repair of conversations by the cheapest edits that give a lawful order of roles.

Rows and the state of the role order span a lattice: a node is a number of rows read and a state, an edge an edit (keep,
rerole, delete, insert) with its cost. A bidirectional Dijkstra search grows a forward heap from the start and a
reverse heap from the accepted ends. Labels are pairs of cost and audit, the initials of the edits, so that among equal costs
the least audit wins on either side. Once the heaps meet, the search goes on until no crossing of the same cost can be
missing, and the least concatenated audit of all crossings is taken.

Conversations are read in order from range partitions, so a hot one is spread over many tasks. One that lies within a
partition is repaired where it is read. Others, and very long ones, are cut into *pieces* of a bounded size, which are searched
apart for every state that they may be entered and left in; the cheapest chain of pieces follows from those few numbers.
Only the digest of a repaired conversation has to run over all its rows in order; they stream through.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm.common import stored
from prefspark.operators.groups import join_unique

START, SYSTEM, USER, ASSISTANT = range(4)  # what the last role was
STATES = range(4)
MISSING = " "  # stands for a NULL role or text
KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
CUT_OFF = 5  # for every truncated row that stays
PIECE_ROWS, PIECE_BYTES = 1024, 4 << 20
PART_BYTES = 64 << 20
_BLANK = " \t\n\x0b\x0c\r"
_LAWFUL = {"su", "ua", "au"}


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``turn``, ``role`` and ``text`` with faults planted by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats the row, 4 makes the role ``user``. NULL
    roles and texts are one space, as are NULL numbers within the key.
    """
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
    kind = F.crc32(F.concat(number(conv), F.lit(":"), number(turn)).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(MISSING)) for c in (role, text))
    changed = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    rows = df.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        changed.alias("text"),
        kind.alias("_kind"),
    ).where("_kind <> 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))).drop("_kind", "_copy")


# --- one conversation, or a piece of one ----------------------------------------------------------------

def next_state(state: int, initial: str) -> int | None:
    """The state after a role, if the role may follow."""
    if initial == "u":
        return None if state == USER else USER
    if initial == "a":
        return ASSISTANT if state == USER else None
    return SYSTEM if initial == "s" and state == START else None


def _due(state: int) -> str:
    """The one role that may follow, other than a leading system."""
    return "assistant" if state == USER else "user"


def faults(roles: list[str], texts: list[str]) -> list[str]:
    """First fault of each row: ``b`` blank, ``d`` seen earlier, ``t`` cut off; else empty."""
    seen, out = set(), []
    for role, text in zip(roles, texts):
        end = text.rstrip(_BLANK)
        out.append("b" if not end else "d" if (role, text) in seen else "" if end[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


class _Lattice:
    """Edits of some rows: (cost, letter, row after, state after) from a node, and the same backwards."""

    def __init__(self, roles: list[str], found: list[str], tail: bool):
        self.rows = [(r[:1], f in ("b", "d"), CUT_OFF * (f == "t")) for r, f in zip(roles, found)]
        self.n = len(self.rows)
        self.tail = tail  # whether rows may be inserted after the last one

    def _reads(self, i: int, state: int) -> Iterator[tuple[int, str, int]]:
        initial, must_go, extra = self.rows[i]
        yield DELETE, "D", state
        if not must_go:
            kept = next_state(state, initial)
            if kept is not None:
                yield KEEP + extra, "K", kept
            yield REROLE + extra, "R", next_state(state, _due(state)[0])

    def forward(self, node: tuple[int, int]):
        i, state = node
        if i < self.n:
            for cost, letter, after in self._reads(i, state):
                yield cost, letter, (i + 1, after)
        if i < self.n or self.tail:
            yield INSERT, "I", (i, next_state(state, _due(state)[0]))

    def backward(self, node: tuple[int, int]):
        i, state = node
        for before in STATES:
            if i:
                for cost, letter, after in self._reads(i - 1, before):
                    if after == state:
                        yield cost, letter, (i - 1, before)
            if (i < self.n or self.tail) and next_state(before, _due(before)[0]) == state:
                yield INSERT, "I", (i, before)


def cheapest(lattice: _Lattice, enter: int, leave: tuple[int, ...]) -> tuple[int, str] | None:
    """Least cost, and of its paths the least audit, from ``enter`` at the first row to one of ``leave`` after the last.

    Strings of one cost at one node never begin with one another, since they have read the same rows and each
    further insertion costs; so the least of their beginnings stays the least.
    """
    sides = [{(0, enter): (0, "")}, {(lattice.n, q): (0, "") for q in leave}]
    heaps = [[(0, i if not side else -i, q) for i, q in labels] for side, labels in enumerate(sides)]
    done: list[set] = [set(), set()]
    best = math.inf
    for node in sides[0].keys() & sides[1].keys():
        best = 0
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = 0 if len(heaps[0]) <= len(heaps[1]) else 1
        cost, i, q = heapq.heappop(heaps[side])
        node = (i if not side else -i, q)
        if node in done[side]:
            continue
        done[side].add(node)
        mine, other = sides[side], sides[1 - side]
        audit = mine[node][1]
        for more, letter, to in lattice.backward(node) if side else lattice.forward(node):
            label = (cost + more, letter + audit if side else audit + letter)
            old = mine.get(to)
            if old is None or label < old:
                mine[to] = label
                heapq.heappush(heaps[side], (label[0], -to[0] if side else to[0], to[1]))
                if to in other:
                    best = min(best, label[0] + other[to][0])
    both = sides[0].keys() & sides[1].keys()
    joined = ((sides[0][v][0] + sides[1][v][0], sides[0][v][1] + sides[1][v][1]) for v in both)
    return min(joined, default=None)


def render(roles: list[str], texts: list[str], audit: str, state: int) -> tuple[list[tuple[str, str]], int]:
    """The rows that edits leave, and the state after them."""
    out, at = [], 0
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        role = roles[at] if letter == "K" else _due(state)
        out.append((role, "" if letter == "I" else texts[at]))
        state = next_state(state, role[:1])
        at += letter != "I"
    return out, state


def _digest(rows: list[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode("utf-8", "surrogatepass")).hexdigest()


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in _LAWFUL for a, b in zip(initials, initials[1:]))


def _turns(turns: list[int | None]) -> tuple[int | None, int | None, int]:
    known = [t for t in turns if t is not None]
    return (min(known), max(known), len(set(known))) if known else (None, None, 0)


def repair(turns: list[int | None], roles: list[str], texts: list[str]) -> dict:
    """One conversation whose rows are in order."""
    found = faults(roles, texts)
    cost, audit = cheapest(_Lattice(roles, found, True), START, (START, ASSISTANT))
    kept, _ = render(roles, texts, audit, START)
    low, high, n = _turns(turns)
    return {
        "gaps": 0 if low is None else high - low + 1 - n,
        "blank": found.count("b"),
        "duplicate": found.count("d"),
        "truncated": found.count("t"),
        "illegal": _illegal([r[:1] for r in roles]),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": _digest(kept),
        "repaired": [{"role": r, "text": t} for r, t in kept],
    }


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "repaired array<struct<role: string, text: string>>"
PIECE = "_part int, _seq int, turns array<long>, roles array<string>, texts array<string>"


# --- reading in order -------------------------------------------------------------------------------------

def _runs(table: pa.Table) -> np.ndarray:
    """Where pieces begin: at a new conversation, or where one has got too long."""
    ids, none = (np.asarray(pc.fill_null(table["conv_id"], 0)), np.asarray(pc.is_null(table["conv_id"])))
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
    size = np.cumsum(np.asarray(pc.binary_length(table["text"])).astype(np.int64))
    size = (size - size[start]) // PIECE_BYTES
    rows = (np.arange(len(ids)) - start) // PIECE_ROWS
    cut = np.zeros(len(ids), bool)
    cut[1:] = (size[1:] != size[:-1]) | (rows[1:] != rows[:-1])
    return new | cut


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, list, list, list, bool]]:
    """(conversation, number, turns, roles, texts, whether it is all of a conversation) from rows in order.

    The first and the last conversation of a partition may go on elsewhere.
    """
    waiting, seq, last = None, 0, None  # of the piece before: conversation, whether it was cut

    def given(table: pa.Table, more: bool):
        nonlocal seq, last
        conv = table["conv_id"][0].as_py()
        parts = [table[c].to_pylist() for c in ("turn", "role", "text")]
        whole = last is not None and last[0] != conv and not more
        last = (conv,)
        seq += 1
        return conv, seq, *parts, whole

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if waiting is None else pa.concat_tables([waiting, table])
        if not len(table):
            continue
        begins = np.flatnonzero(_runs(table)).tolist()
        for a, b in zip(begins, begins[1:]):
            more = table["conv_id"][a].as_py() == table["conv_id"][b].as_py()
            yield given(table.slice(a, b - a), more)
        waiting = table.slice(begins[-1]).combine_chunks()
    if waiting is not None and len(waiting):
        yield given(waiting, True)


def _read(batches: Iterator[pa.RecordBatch], keep_rows: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Reports of conversations read whole, and the pieces of others as they are."""
    rows: list[dict] = []
    weight, part = 0, None

    def parts():
        nonlocal part
        for batch in batches:
            if batch.num_rows:
                part = batch.column(4)[0].as_py()
            yield batch.select(["conv_id", "turn", "role", "text"])

    for conv, seq, turns, roles, texts, whole in _pieces(parts()):
        if whole:
            row = {"conv_id": conv, **repair(turns, roles, texts)}
            if not keep_rows:
                del row["repaired"]
        else:
            row = {"conv_id": conv, "_part": part, "_seq": seq, "turns": turns, "roles": roles, "texts": texts}
            weight += sum(map(len, texts))
        rows.append(row)
        if len(rows) >= 1000 or weight > PIECE_BYTES:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows, weight = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


# --- conversations in pieces ------------------------------------------------------------------------------

def _dead(pieces: DataFrame) -> DataFrame:
    """``_part``, ``_seq`` and ``seen``, the places in the piece of rows whose role and text came earlier."""
    row = pieces.select("conv_id", "_part", "_seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "row"))
    row = row.select("conv_id", F.col("row.roles").alias("role"), F.sha2("row.texts", 256).alias("digest"), "_part", "_seq", "at")
    keys = ["conv_id", "role", "digest"]
    first = row.groupBy(*keys).agg(F.min(F.struct("_part", "_seq", "at")).alias("_first"))
    later = join_unique(row, first, keys).where(F.struct("_part", "_seq", "at") != F.col("_first"))
    return later.groupBy("_part", "_seq").agg(F.collect_list("at").alias("seen"))  # at most a piece's rows


TABLE = (
    "conv_id long, _part int, _seq int, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "low long, high long, n_turns long, costs array<long>, audits array<string>"
)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every piece what its conversation needs: counts, its ends, and costs and audits by the states it runs between."""
    for batch in batches:
        out = defaultdict(list)
        for row in batch.to_pylist():
            found = faults(row["roles"], row["texts"])
            seen = set(row["seen"] or ())
            found = ["b" if f == "b" else "d" if at in seen else f for at, f in enumerate(found)]
            lattice = _Lattice(row["roles"], found, False)
            got = [cheapest(lattice, p, (q,)) or (None, None) for p in STATES for q in STATES]
            low, high, n = _turns(row["turns"])
            values = (
                row["conv_id"], row["_part"], row["_seq"], found.count("b"), found.count("d"), found.count("t"),
                _illegal([r[:1] for r in row["roles"]]), row["roles"][0][:1], row["roles"][-1][:1], low, high, n,
                [c for c, _ in got], [a for _, a in got],
            )
            for i, v in enumerate(values):
                out[i].append(v)
        if out:
            ints, text = pa.int64(), pa.string()
            kinds = [ints, pa.int32(), pa.int32(), *[ints] * 4, text, text, *[ints] * 3, pa.list_(ints), pa.list_(text)]
            names = [c.split()[0] for c in TABLE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(out[i], k) for i, k in enumerate(kinds)], names)


_ENDS = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}  # inserts that make an end lawful


def _chain(pieces: list[dict]) -> tuple[int, list[tuple[int, str]]]:
    """The cheapest way through the pieces of a conversation: its cost, and by piece the state it enters in and its audit.

    Of equal costs the audit that is least so far wins; only the order of the four audits so far has to be known, since
    none begins with another (each ends with a row read).
    """
    cost, order = {START: 0}, {START: 0}
    back: list[dict[int, tuple[int, str]]] = []
    for piece in pieces:
        now = {}
        for q in STATES:
            ways = [
                (cost[p] + piece["costs"][4 * p + q], order[p], piece["audits"][4 * p + q], p)
                for p in cost
                if piece["costs"][4 * p + q] is not None
            ]
            if ways:
                now[q] = min(ways)
        back.append({q: (way[3], way[2]) for q, way in now.items()})
        cost = {q: way[0] for q, way in now.items()}
        order = {q: i for i, (_, _, q) in enumerate(sorted((way[1], way[2], q) for q, way in now.items()))}
    total, _, state = min((cost[q] + _ENDS[q][0], order[q], q) for q in cost)
    tail, out = _ENDS[state][1], []
    for step in reversed(back):
        state, audit = step[state]
        out.append((state, audit + tail))
        tail = ""
    return total, out[::-1]


WAY = "conv_id long, _part int, _seq int, state int, edits string, cost long"


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each conversation, from rows in its order; one holds a few numbers and letters a row of the conversation."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and rows[-1]["conv_id"] != row["conv_id"]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _grouped(batches):
        cost, chosen = _chain(rows)
        columns = [
            pa.array([r["conv_id"] for r in rows], pa.int64()),
            pa.array([r["_part"] for r in rows], pa.int32()),
            pa.array([r["_seq"] for r in rows], pa.int32()),
            pa.array([s for s, _ in chosen], pa.int32()),
            pa.array([a for _, a in chosen], pa.string()),
            pa.array([cost] * len(rows), pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in WAY.split(", ")])


def _finish(batches: Iterator[pa.RecordBatch], keep_rows: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Add up the pieces of each conversation, which come in order; texts are hashed as they pass."""
    now, done = None, []

    def report() -> dict:
        out = {k: now[k] for k in ("conv_id", "blank", "duplicate", "truncated", "illegal", "cost")}
        out["gaps"] = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["n_turns"]
        out |= {"audit": "".join(now["edits"]), "repaired_sha256": now["digest"].hexdigest()}
        return out | {"repaired": now["repaired"]} if keep_rows else out

    for batch in batches:
        for row in batch.to_pylist():
            if now is None or now["conv_id"] != row["conv_id"]:
                if now is not None:
                    done.append(report())
                now = {"conv_id": row["conv_id"], "cost": row["cost"], "edits": [], "digest": hashlib.sha256(), "any": False,
                       "repaired": [], "last": None, "low": None, "high": None, "n_turns": 0,
                       **dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)}
            for k in ("blank", "duplicate", "truncated", "illegal"):
                now[k] += row[k]
            now["illegal"] += now["last"] is not None and now["last"] + row["first"] not in _LAWFUL
            now["last"] = row["last"]
            if row["low"] is not None:
                now["n_turns"] += row["n_turns"] - (row["low"] == now["high"])  # rows are in the order of turns
                now["low"] = row["low"] if now["low"] is None else now["low"]
                now["high"] = row["high"]
            now["edits"].append(row["edits"])
            kept, _ = render(row["roles"], row["texts"], row["edits"], row["state"])
            for role, text in kept:
                now["digest"].update(f"{chr(10) * now['any']}{role}:{text}".encode("utf-8", "surrogatepass"))
                now["any"] = True
            if keep_rows:
                now["repaired"] += [{"role": r, "text": t} for r, t in kept]
        if len(done) >= 1000:
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
    if now is not None:
        done.append(report())
    if done:
        yield pa.RecordBatch.from_pylist(done, schema)


def _fields(ddl: str) -> list[str]:
    depth, out = 0, [""]
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [f.split()[0] for f in out]


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def repair_conversations(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    keep_rows: bool = False, parts: int | None = None,
) -> DataFrame:
    """Per conversation ``conv_id``, the counts of its faults, ``cost``, ``audit`` and ``repaired_sha256``.

    Rows go by turn (NULL first), then role and text. The first of these faults counts for a row: blank, duplicate (role and
    text seen earlier in the conversation), truncated (the last sign other than white space is none of ``.!?``).
    ``gaps`` is the number of turns missing between the least and the greatest, ``illegal`` the number of neighbours whose
    roles' initials are not su, ua or au. Edits: keep (0), rerole to user or assistant (1), delete (2; blank and duplicate rows
    must go), insert an empty row of user or assistant (5); a truncated row that stays costs 5 more. ``audit`` has
    the initials of the cheapest edits, the least string of those, that give initials ``(s?(ua)+)?``; the digest is that of
    ``role:text`` of what they leave, joined by line ends. ``keep_rows`` adds ``repaired``, those rows.

    A NULL conversation is one of its own; NULL roles and texts are one space; an empty role has no initial and cannot be
    kept; very long texts stay whole; repeated rows are duplicates; other columns are not read; an empty table gives none.
    """
    spark = df.sparkSession
    named = df.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(MISSING)).alias("role"),
        F.coalesce(F.col(text), F.lit(MISSING)).alias("text"),
    )
    if parts is None:
        size = named.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
        parts = max(math.ceil(size / PART_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ["conv_id", "turn", "role", "text"]
    placed = named.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    ddl = f"conv_id long, {REPORT}" + f", {ROWS}" * keep_rows
    result = _fields(ddl)
    schema, wide = _arrow(spark, ddl), _arrow(spark, f"{ddl}, {PIECE}")
    read = placed.mapInArrow(lambda batches: _read(batches, keep_rows, wide), f"{ddl}, {PIECE}")
    read = stored(read, "conversations")
    whole, pieces = read.where("_seq IS NULL").select(*result), read.where("_seq IS NOT NULL").select("conv_id", *_fields(PIECE))

    place = ["_part", "_seq"]
    tables = stored(pieces.join(_dead(pieces), place, "left").mapInArrow(_tables, TABLE), "conversation-pieces")
    ways = _in_order(tables.select("conv_id", *place, "costs", "audits")).mapInArrow(_ways, WAY)
    chosen = pieces.join(tables.drop("conv_id", "costs", "audits"), place).join(ways.drop("conv_id"), place)
    return whole.unionByName(_in_order(chosen).mapInArrow(lambda batches: _finish(batches, keep_rows, schema), ddl))


def _in_order(df: DataFrame) -> DataFrame:
    """Conversations in pieces, each in one task in order; a task takes them one after another."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", "_part", "_seq")


def damaged_and_repaired(df: DataFrame, parts: int | None = None) -> DataFrame:
    """:func:`repair_conversations` of :func:`damage`, with a row for every conversation that had one before.

    Those of which no row is left have zeros, an empty audit and the digest of nothing.
    """
    done = repair_conversations(damage(df), parts=parts)
    everyone = df.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    named = done.withColumnRenamed("conv_id", "_conv").withColumn("_found", F.lit(True))
    out = everyone.join(named, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(_digest([]))).alias("repaired_sha256"),
    )
