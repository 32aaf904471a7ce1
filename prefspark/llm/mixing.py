"""Mixing sources to target weights by a low-discrepancy schedule.

The words of a source are divided into blocks of equally many words, the last one maybe shorter; small targets
have smaller blocks. A slot of the schedule takes one block, and a source has the slots whose words come nearest
to its target. Slot i falls at the i-th point of the golden-ratio sequence, mapped through the cumulative numbers
of slots to a source. So every stretch of the schedule has each source in near its share. The r-th slot of a
source takes its block r modulo its number of blocks; the blocks cut the source's documents in a hashed order, and
a document counts the words it has in each block that is taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefspark.llm.common import keep_words, small_table, stored, words
from prefspark.operators.positions import running_sums

SLOTS = 1 << 18  # slots of the schedule, while blocks have up to BLOCK_WORDS words; more on larger input
BLOCK_WORDS = 1024  # words of a block at most
LEAST_SLOTS = 256  # slots of a source at least, but for targets of fewer words
RANGE = 1 << 16  # slots that are ranked in one go
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)  # 2^64 divided by the golden ratio


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Words for each source: shares of the sum of all by weight, none above ``most`` times its size.

    The excess is shared by weight among the others until none is above.
    """
    out = [0.0] * len(sizes)
    left, open_ = float(sum(sizes)), set(range(len(sizes)))
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        above = {i for i in open_ if left * weights[i] / total > most * sizes[i]}
        if not above:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in above:
            out[i] = float(most * sizes[i])
        left = float(sum(sizes)) - sum(most * sizes[i] for i in range(len(sizes)) if i not in open_ - above)
        open_ -= above
    return out


def source_targets(sized: DataFrame, weights=(1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """``source, index, source_size, target``: sources by code point, NULL last, weights in turn.

    The list of sources has to fit the driver; nothing else is brought there.
    """
    found = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["n"] for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], most)
    rows = [(r["source"], i, r["n"], goal[i]) for i, r in enumerate(found)]
    return small_table(sized.sparkSession, rows, "source string, index int, source_size long, target double")


def turns(size: int, target: float, most_words: int) -> tuple[int, int]:
    """(words of a block, number of slots) of a source: the number whose words come nearest to ``target``."""
    block = max(1, min(most_words, int(target) // LEAST_SLOTS))
    if size == 0:
        return block, 0
    rounds, rest = divmod(target, size)
    whole, part = divmod(rest, block)
    last = min(block, size - whole * block)  # words of the block that would come next
    return block, int(rounds) * -(-size // block) + int(whole) + (2 * part >= last > 0)


def schedule(spark, dealt: list[tuple[int, int, int]]) -> DataFrame:
    """``slot, index, rank, block`` for sources given as (size, words of a block, slots), in order of index.

    Each source has just its number of slots: those beyond it fall out, and missing ones come at the end.
    """
    counts = np.array([n for _, _, n in dealt], np.int64)
    total = int(counts.sum())
    edges = np.cumsum(counts) / total if total else np.empty(0)

    def place(batches):
        for batch in batches:
            for part in batch.column("id").to_pylist():
                slot = np.arange(part * RANGE, min((part + 1) * RANGE, total))
                point = (slot.astype(np.uint64) * _GOLDEN + (_GOLDEN >> np.uint64(1))).astype(np.float64) / 2.0**64
                index = np.minimum(np.searchsorted(edges, point, side="right"), len(edges) - 1)
                order = np.argsort(index, kind="stable")
                nth = np.empty_like(slot)
                nth[order] = np.arange(len(slot)) - np.searchsorted(index[order], index[order])
                columns = [pa.array(x, pa.int64()) for x in (np.full_like(slot, part), slot, nth)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(index, pa.int32())], ["part", "slot", "nth", "index"])

    placed = spark.range(-(-total // RANGE)).mapInArrow(place, "part long, slot long, nth long, index int")
    found = placed.groupBy("index", "part").agg(F.count(F.lit(1)).alias("n"))
    # Rows of an index: ranges of slots.
    before = F.sum("n").over(Window.partitionBy("index").orderBy("part")) - F.col("n")
    starts = found.select("index", "part", before.alias("before"))
    had = {r["index"]: r["n"] for r in found.groupBy("index").agg(F.sum("n").alias("n")).collect()}
    lacking = [(i, had.get(i, 0), n) for i, n in enumerate(counts.tolist()) if had.get(i, 0) < n]
    # A few slots a source: the sequence's error grows with the logarithm of its length.
    late = [(total + j, i, r) for j, (i, r) in enumerate((i, r) for i, low, n in lacking for r in range(low, n))]

    sources = [(i, n, max(1, -(-size // block))) for i, (size, block, n) in enumerate(dealt)]
    sources = small_table(spark, sources, "index int, turns long, blocks long")
    ranked = placed.join(starts, ["index", "part"]).select("slot", "index", (F.col("before") + F.col("nth")).alias("rank"))
    ranked = ranked.unionByName(small_table(spark, late, "slot long, index int, rank long")).join(sources, "index")
    ranked = ranked.where("rank < turns")
    return ranked.select("slot", "index", "rank", (F.col("rank") % F.col("blocks")).alias("block"))


def _sized(df: DataFrame, id_col: str, text: str, source: str, seed: int) -> DataFrame:
    """Narrow rows, stored: id, source, words, a hash of the text and the place of the row in the shuffled order."""
    # Regular expressions count code units; the classes below hold none beyond ASCII.
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        size.alias("size"),
        F.xxhash64(text).alias("hash"),
    )
    return stored(rows.withColumn("key", F.xxhash64(F.lit(seed), "doc_id")), "mix-sizes")


def _pieces(sized: DataFrame, weights, most: int, slots: int) -> tuple[DataFrame, DataFrame]:
    """The words of each row in each block with the times the block is taken; and the sources with their targets."""
    goals = source_targets(sized, weights, most)
    listed = goals.orderBy("index").select("source_size", "target").collect()
    most_words = max(1, min(BLOCK_WORDS, -(-sum(n for n, _ in listed) // slots)))
    dealt = [(n, *turns(n, goal, most_words)) for n, goal in listed]
    spread = [(i, block, n) for i, (_, block, n) in enumerate(dealt)]
    named = goals.join(small_table(sized.sparkSession, spread, "index int, each long, turns long"), "index")
    named = named.withColumnRenamed("source", "_source")
    placed = running_sums(sized.where("size > 0"), ["key", "doc_id", "size", "hash"], {"stop": F.col("size")}, ["source"])
    placed = placed.withColumn("start", F.col("stop") - F.col("size"))
    placed = placed.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "key", "stop")

    times = schedule(sized.sparkSession, dealt).groupBy("index", "block").agg(F.count(F.lit(1)).alias("times"))
    # Blocks from ``turns`` on are not taken; a row that lies behind has one piece, without words.
    reached = F.expr("sequence(start div each, least((start + size - 1) div each, turns - 1))")
    pieces = placed.withColumn("block", F.explode_outer(F.when(F.expr("start < turns * each"), reached)))
    first = F.greatest(F.col("block") * F.col("each") - F.col("start"), F.lit(0))
    last = F.least(F.col("size"), (F.col("block") + 1) * F.col("each") - F.col("start"))
    pieces = pieces.withColumns({"first": first, "words": F.when(F.col("block").isNull(), 0).otherwise(last - first)})
    return pieces.join(times, ["index", "block"], "left").fillna(0, ["times"]), named


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights=(1.0, 2.0, 3.0),
    most: int = 3,
    slots: int = SLOTS,
    seed: int = 0,
) -> DataFrame:
    """Per row ``doc_id, size, source_size, target, taken``, and its ``source``.

    ``size`` is the number of words, 0 for NULL and empty texts; ``taken`` the words the mix takes of the row,
    repeats counted, at most ``most`` times ``size``. Reruns agree: the order within a source is a hash of
    seed and id. Repeated rows are rows of their own, with the same words taken or not by their place. An empty
    table gives an empty result; other columns are not read.
    """
    sized = _sized(df, id_col, text, source, seed)
    pieces, named = _pieces(sized, weights, most, slots)
    keys = ["doc_id", "source", "size", "source_size", "target", "index", "start"]
    taken = pieces.groupBy(*keys).agg(F.sum(F.col("words") * F.col("times")).alias("taken"))

    nothing = sized.where("size = 0").join(named, F.col("source").eqNullSafe(F.col("_source")))
    columns = ["doc_id", "size", "source_size", "target", "taken", "source"]
    return taken.select(columns).unionByName(nothing.withColumn("taken", F.lit(0).cast("long")).select(columns))


def mixed_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights=(1.0, 2.0, 3.0),
    most: int = 3,
    slots: int = SLOTS,
    seed: int = 0,
) -> DataFrame:
    """The mix itself, with the columns of ``df``: a row for each copy that is taken of a row.

    The n-th copy has the words of the blocks taken at least n times; a whole copy is the text as it stands.
    Rows of which nothing is taken, those without words among them, are left out. A column ``n_chars`` becomes
    the new length. Equal rows are told apart by their number.
    """
    sized = _sized(df, id_col, text, source, seed)
    pieces, _ = _pieces(sized, weights, most, slots)
    plan = pieces.groupBy("doc_id", "source", "hash", "index", "start").agg(
        F.collect_list(F.when(F.col("times") > 0, F.struct("first", "words", "times"))).alias("pieces")
    )  # of one row: its number of blocks
    keys = ["doc_id", "source", "hash"]
    plan = plan.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("start")))
    plan = plan.where(F.size("pieces") > 0).select(F.struct(*keys, "nth").alias("_key"), "pieces")

    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
        F.xxhash64(text).alias("hash"), F.struct(*df.columns).alias("row"),
    ).where(F.col("row")[text].rlike(r"[^ \t-\r]"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("hash")))
    # Structs compare NULL fields as equal.
    both = rows.select(F.struct(*keys, "nth").alias("_key"), "row").join(plan, "_key").select("row", "pieces")

    def run(batches):
        for batch in batches:
            at, texts = [], []
            for i, (row, found) in enumerate(zip(batch.column("row").field(text).to_pylist(), batch.column("pieces").to_pylist())):
                times = np.zeros(len(words(row)), np.int64)
                for piece in found:
                    times[piece["first"] : piece["first"] + piece["words"]] = piece["times"]
                for copy in range(1, int(times.max()) + 1):
                    at.append(i)
                    texts.append(keep_words(row, times >= copy))
            taken = batch.column("row").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken, pa.array(texts, pa.string())], ["row", "new_text"])

    out = both.mapInArrow(run, both.select("row").withColumn("new_text", F.lit("")).schema)
    columns = {c: F.col("row")[c] for c in df.columns} | {text: F.col("new_text")}
    if "n_chars" in df.columns:
        columns["n_chars"] = F.length("new_text").cast(df.schema["n_chars"].dataType)
    return out.select(*[columns[c].alias(c) for c in df.columns])
