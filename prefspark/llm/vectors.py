"""Vector columns: usable rows, blobs of bounded size, and blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.llm.common import stored

QUERY_BLOCK = 1_024
BATCH_BYTES = "8m"  # of blobs that go to a worker at once; Spark takes 64 MB, in buffers that double


def usable(df: DataFrame, id_col: str, vector: str, zero: bool) -> list[tuple[DataFrame, int]]:
    """``vec_id, v array<double>`` of the rows that take part, stored, by the length of their vectors.

    Left out are rows whose id or vector is NULL or empty, whose vector has a NULL or non-finite component or, unless
    ``zero``, only zeros. Vectors of different lengths have no score and are searched apart; there are few lengths.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    v = F.col("v")
    good: Column = v.isNotNull() & F.col("vec_id").isNotNull() & (F.size(v) > 0)
    good = good & F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    if not zero:
        good = good & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(good)
    rows = stored(rows, "vectors")
    lengths = sorted(r["d"] for r in rows.select(F.size("v").alias("d")).distinct().collect())
    return [(rows.where(F.size("v") == d), d) for d in lengths] or [(rows, 0)]


def queries_of(rows: DataFrame, every: int) -> DataFrame:
    """The rows whose id is divisible by ``every``, one of each id: the one of the least vector."""
    return rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column, length: int) -> np.ndarray:
    """An Arrow list column as rows of doubles."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [np.asarray(c.flatten(), np.float64) for c in chunks]
    return np.concatenate([*flat, np.empty(0)]).reshape(-1, length)


def as_blob(x: np.ndarray) -> bytes:
    """Vectors as bytes: single precision where that changes no number, which is half of double."""
    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    return (single if np.array_equal(single, x) else x).tobytes()


def packed(rows: DataFrame, keys: list[str], length: int, also: list[str] = []) -> DataFrame:
    """One row per value of ``keys`` with ``ids`` and ``data``, its ids and vectors as bytes, in order of id.

    Columns of ``also`` are integers, one for each vector, and come as bytes too.
    """

    def run(group: pa.Table) -> pa.Table:
        ids = np.asarray(group["vec_id"].combine_chunks(), np.int64)
        order = np.argsort(ids, kind="stable")
        out = {k: group[k][:1] for k in keys}
        out["ids"] = pa.array([ids[order].tobytes()], pa.binary())
        out["data"] = pa.array([as_blob(matrix(group["v"], length)[order])], pa.binary())
        for name in also:
            out[name] = pa.array([np.asarray(group[name].combine_chunks(), np.int32)[order].tobytes()], pa.binary())
        return pa.table(out)

    schema = ", ".join(f"{k} long" for k in keys) + ", ids binary, data binary" + "".join(f", {name} binary" for name in also)
    return rows.select(*[F.col(k).cast("long").alias(k) for k in keys], "vec_id", "v", *also).groupBy(*keys).applyInArrow(run, schema)


def hashed_parts(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """Rows dealt by a hash of their id to parts of about ``size`` rows."""
    parts = max(1, -(-rows.count() // size))
    return rows.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(parts))), parts


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch one at a time, bytes as views of it: blobs of many rows are not copied at once."""
    for i in range(batch.num_rows):
        found = {name: batch.column(name)[i] for name in batch.schema.names}
        yield {k: v.as_buffer() if pa.types.is_binary(v.type) else v.as_py() for k, v in found.items()}


def opened(ids: bytes | pa.Buffer, data: bytes | pa.Buffer, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, in double precision, of a row of ``packed``."""
    ids = np.frombuffer(ids, np.int64)
    kind = np.float32 if len(data) == 4 * length * len(ids) else np.float64
    return ids, np.frombuffer(data, kind).astype(np.float64, copy=False).reshape(-1, length)
