"""Writers of JSON-lines datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from prefspark.schema import PAIR_KEY
from prefspark.session import remove
from prefspark.sources.readers import _exists, finished


def write_jsonl(df: DataFrame, path: str, force: bool = True) -> int:
    """One object per line with NULL fields kept; returns the number of rows written.

    Without ``force`` a finished output that is not empty is left alone and zero is returned; a folder without
    the mark of a finished job, or with nothing in it, is written anew.
    """
    if not force and finished(df.sparkSession, path):
        return 0
    counted = Observation()
    observed = df.observe(counted, F.count(F.lit(1)).alias("rows"))
    observed.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return counted.get["rows"]


def subset_suffix(k: int) -> str:
    """A size in names: thousands as ``k``, if nothing is left over."""
    thousands, rest = divmod(k, 1000)
    return str(k) if rest else f"{thousands}k"


def tau_tag(tau: float) -> str:
    """A threshold in names: shortest decimal form, with ``p`` for the point."""
    return f"{tau:.12g}".replace(".", "p")


def subset_name(method: str, k: int, tau: float | None = None) -> str:
    prefix = method if tau is None else f"{method}_tau{tau_tag(tau)}"
    return f"{prefix}_{subset_suffix(k)}"


def write_subset(df: DataFrame, out_dir: str, method: str, k: int, tau: float | None = None, force: bool = True) -> str:
    """Write the three texts of a subset; returns its path."""
    path = f"{out_dir}/{subset_name(method, k, tau)}"
    write_jsonl(df.select(*PAIR_KEY), path, force)
    return path


def write_tau_sweep(df: DataFrame, out_dir: str) -> None:
    """One folder per threshold from a table with a ``tau`` column, in one job."""
    df.select("tau", *PAIR_KEY).write.mode("overwrite").partitionBy("tau").json(out_dir)


def merge_shards(spark: SparkSession, paths: list[str], schema, order: str | None = None) -> DataFrame:
    """Concatenate per-shard outputs, in one scan; a missing shard is an error."""
    missing = [p for p in paths if not _exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"missing shards: {missing}")
    merged = spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    return merged.orderBy(order) if order else merged


def merge_shards_to(spark: SparkSession, paths: list[str], schema, out: str, order: str | None = None) -> int:
    """Write the merged shards to ``out`` and, once that is finished, remove them; returns the rows."""
    rows = write_jsonl(merge_shards(spark, paths, schema, order), out)
    if not _exists(spark, f"{out}/_SUCCESS"):
        raise RuntimeError(f"{out} is not finished; the shards stay")
    for path in paths:
        remove(spark, path)
    return rows
