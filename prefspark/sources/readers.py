"""Readers for preference and prompt tables."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from prefspark.operators.normalize import load_pairs
from prefspark.operators.positions import head_limit
from prefspark.schema import PAIR, nan_to_null
from prefspark.session import file_system
from prefspark.sources.csv_records import read_csv

FORMATS = {".json": "json", ".jsonl": "json", ".csv": "csv", ".parquet": "parquet", ".arrow": "arrow_ipc"}


def read_jsonl(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """One JSON object per line; blank lines are skipped, a malformed line fails the job.

    The schema is declared: inference would read the data twice and turn mixed columns into text.
    """
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_pairs(spark: SparkSession, path, schema: T.StructType = PAIR) -> DataFrame:
    """Pair records with all three texts present and NaN scores as NULL."""
    return load_pairs(nan_to_null(read_jsonl(spark, path, schema)))


def read_split(spark: SparkSession, root: str, split: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """One named split of a dataset folder: ``root/split`` or the partition ``root/split=name``."""
    reader = spark.read.schema(schema) if schema else spark.read
    reader = reader.format(fmt)
    for path in (f"{root}/{split}", f"{root}/split={split}"):
        if _exists(spark, path):
            return reader.load(path)
    raise FileNotFoundError(f"no split {split!r} under {root}")


def _exists(spark: SparkSession, path: str) -> bool:
    system, target = file_system(spark, path)
    return system.exists(target)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds a complete output: a non-empty file, or a folder with ``_SUCCESS`` and some data."""
    system, target = file_system(spark, path)
    if not system.exists(target):
        return False
    if system.getFileStatus(target).isFile():
        return system.getFileStatus(target).getLen() > 0
    return _exists(spark, f"{path}/_SUCCESS") and system.getContentSummary(target).getLength() > 0


class _ArrowFile(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class ArrowFileReader(DataSourceReader):
    """Runs of record batches of Arrow IPC files; one Spark partition per run."""

    def __init__(self, options: dict):
        self.paths = options["path"].split(",")
        self.run = int(options.get("batches_per_partition", "16"))

    def partitions(self) -> list[InputPartition]:
        parts = []
        for path in self.paths:
            with _open_arrow(path) as reader:
                total = getattr(reader, "num_record_batches", None)
            # A stream file has no batch index: it is read front to back by one task.
            steps = [(0, None)] if total is None else [(i, i + self.run) for i in range(0, total, self.run)]
            parts += [_ArrowFile(path, *s) for s in steps]
        return parts

    def read(self, partition: _ArrowFile) -> Iterator:
        with _open_arrow(partition.path) as reader:
            if partition.last is None:
                yield from reader
            else:
                for i in range(partition.first, min(partition.last, reader.num_record_batches)):
                    yield reader.get_batch(i)


def _open_arrow(path: str):
    import pyarrow as pa
    from pyarrow import fs

    if "://" in path:
        system, inner = fs.FileSystem.from_uri(path)
        source = system.open_input_file(inner)
    else:
        source = pa.memory_map(path)
    try:
        return pa.ipc.open_file(source)
    except pa.ArrowInvalid:
        source.seek(0)
        return pa.ipc.open_stream(source)


class ArrowFileSource(DataSource):
    """``spark.read.format("arrow_ipc")`` for ``.arrow`` files."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self) -> T.StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        with _open_arrow(self.options["path"].split(",")[0]) as reader:
            return from_arrow_schema(reader.schema)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ArrowFileReader(dict(self.options))


def parse_spec(spec: str) -> list[tuple[str, str | None]]:
    """``a.jsonl, b@dir`` to [(path, data_dir)]."""
    out = []
    for item in spec.split(","):
        path, _, data_dir = item.partition("@")
        out.append((path.strip(), data_dir.strip() or None))
    return out


def read_any(
    spark: SparkSession, spec: str, schema: T.StructType | None = None, split: str = "train", csv_newlines: bool = True
) -> list[DataFrame]:
    """One table per comma-separated dataset; the format follows the extension.

    A ``.json`` file may hold one object per line or one array over several lines. A folder is read from
    ``data_dir`` when given, else from its ``split`` subfolder when there is one, else as a whole, in the format
    of its files. CSV texts may hold line breaks (see :func:`read_csv`), unless ``csv_newlines`` is off.
    """
    tables = []
    for path, data_dir in parse_spec(spec):
        if data_dir:
            path = f"{path}/{data_dir}"
        elif split and not os.path.splitext(path)[1] and _exists(spark, f"{path}/{split}"):
            path = f"{path}/{split}"
        ext = os.path.splitext(path)[1].lower()
        tables.append(_load(spark, path, ext if ext in FORMATS else _folder_format(spark, path), schema, csv_newlines))
    return tables


def _folder_format(spark: SparkSession, path: str) -> str:
    """Extension of the files of a folder, ``.parquet`` if they have none that is known."""
    system, target = file_system(spark, path)
    for status in system.listStatus(target) if system.exists(target) else ():
        ext = os.path.splitext(status.getPath().getName().removesuffix(".gz"))[1].lower()
        if status.isFile() and ext in FORMATS:
            return ext
    return ".parquet"


def _load(spark: SparkSession, path: str, ext: str, schema: T.StructType | None, csv_newlines: bool) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    fmt = FORMATS[ext]
    if fmt == "arrow_ipc":
        spark.dataSource.register(ArrowFileSource)
        system, target = file_system(spark, path)
        if system.getFileStatus(target).isDirectory():
            names = [s.getPath().toString() for s in system.listStatus(target) if s.getPath().getName().endswith(ext)]
            path = ",".join(n.removeprefix("file:") if n.startswith("file:/") else n for n in sorted(names))
    if fmt == "json":
        # An array is told from lines by its first character.
        first = spark.read.option("wholetext", False).text(path).where("trim(value) <> ''").limit(1).collect()
        array = ext == ".json" and bool(first) and first[0][0].lstrip("\ufeff \t").startswith("[")
        reader = reader.option("mode", "FAILFAST").option("multiLine", array)
    if fmt == "csv" and csv_newlines:
        return read_csv(spark, path, schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"')  # RFC 4180: quotes are doubled
    return reader.format(fmt).load(path)


def read_capped(tables: list[DataFrame], max_count: int, order: str) -> list[DataFrame]:
    """First ``max_count`` rows of every source by the numeric column ``order``."""
    return [head_limit(t, max_count, -F.col(order), []) for t in tables]
