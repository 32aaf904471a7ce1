"""CSV whose texts hold line breaks, read by many tasks.

Whether a line break ends a record depends on all quotes before it: the automaton has two states, inside quotes or not, and
a run of bytes either keeps or swaps them. So every split of a file gives its swap, one row; their composition in the order
of the file tells the state at the start of each, and the splits are read at the same time. Records that reach over
splits come in pieces, at most two a split, and only those are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PIECE = "file string, block long, seq long, head boolean, tail boolean, text string"
_OPTIONS = {"escape": '"', "multiLine": "true"}
_BATCH_CHARS = 4 << 20


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of splits; ``head`` marks one that began in an earlier split, ``tail`` one that goes on in the next."""
    rows: list[tuple] = []
    size, split, state, seq, head, held = 0, None, False, 0, False, []

    def out() -> pa.RecordBatch:
        kinds = pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(columns, ["file", "block", "seq", "head", "tail", "text"])

    for batch in batches:
        for file, block, text, odd, open_ in zip(*[batch.column(i).to_pylist() for i in range(5)]):
            if (file, block) != split:
                if held:
                    rows.append((*split, seq, head, state, "\n".join(held)))
                split, state, seq, head, held = (file, block), open_, 0, open_, []
            elif not state:
                rows.append((*split, seq, head, False, "\n".join(held)))
                seq, head, held = seq + 1, False, []
            held.append(text)
            size += len(text)
            state ^= odd
        if rows and (len(rows) >= 1000 or size > _BATCH_CHARS):
            yield out()
            rows, size = [], 0
    if held:
        rows.append((*split, seq, head, state, "\n".join(held)))
    if rows:
        yield out()


def csv_records(spark: SparkSession, path) -> DataFrame:
    """``file``, ``first`` (whether it is the file's first) and ``text`` of every record, header included.

    Quotes stand only around texts and, doubled, within them. A file that ends inside quotes gives what is left as a record.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text")
    )
    quotes = F.length("text") - F.length(F.replace(F.col("text"), F.lit('"'), F.lit("")))
    lines = lines.withColumn("odd", quotes % 2 == 1)
    splits = lines.groupBy("file", "block").agg((F.count_if("odd") % 2).alias("_swap"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    states = splits.select("file", "block", (F.coalesce(F.sum("_swap").over(earlier), F.lit(0)) % 2 == 1).alias("open"))
    found = lines.join(F.broadcast(states), ["file", "block"]).select("file", "block", "text", "odd", "open")  # a row a split
    found = found.mapInArrow(_pieces, _PIECE)
    first = (F.col("block") == 0) & (F.col("seq") == 0)
    whole = found.where("NOT head AND NOT tail").select("file", first.alias("first"), "text")
    in_order = Window.partitionBy("file").orderBy("block", "seq")  # at most two pieces a split
    cut = found.where("head OR tail").withColumn("_record", F.sum((~F.col("head")).cast("int")).over(in_order))
    joined = cut.groupBy("file", "_record").agg(
        F.max(first).alias("first"), F.array_sort(F.collect_list(F.struct("block", "seq", "text"))).alias("_parts")
    )
    text = F.array_join(F.transform("_parts", lambda p: p["text"]), "\n")
    return whole.unionByName(joined.select("file", "first", text.alias("text")))


def read_csv(spark: SparkSession, path, schema: T.StructType | None = None) -> DataFrame:
    """CSV files with a header line, whose quoted texts may hold line breaks, split like any text file.

    Without a schema all columns are text, named by the header. Blank lines are skipped; records end with a line feed, a
    carriage return before it is not part of them.
    """
    names = spark.read.option("header", True).option("escape", '"').csv(path).columns
    schema = schema or T.StructType([T.StructField(n, T.StringType()) for n in names])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    records = csv_records(spark, path).where(~F.col("first")).select(F.regexp_replace("text", r"\r\z", "").alias("text"))
    return records.where("text <> ''").select(F.from_csv("text", ddl, _OPTIONS).alias("_row")).select("_row.*")
