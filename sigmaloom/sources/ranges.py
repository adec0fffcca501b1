"""Files read by ranges on executors: Parquet footers as a table, and Arrow files split by record batch.

Executors open files by URI with Arrow's file systems (local, hdfs, s3, gs) and read what they need of them. Files of other file
systems are reached by Spark alone, which hands whole files over (`binaryFile`); then a footer comes with its file.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File systems that Arrow opens by itself.
BY_RANGE = ("file", "hdfs", "s3", "s3a", "gs")
FOOTERS = "path string, row_group int, rows bigint, column string, scalar boolean, uncompressed bigint, compressed bigint"


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """path, length of the files of a table, without hidden ones; contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")


def by_range(path: str) -> bool:
    return path.split(":", 1)[0].lower() in BY_RANGE


def opened(path: str):
    """A file for random access, by its URI."""
    from pyarrow import fs

    scheme, rest = path.split(":", 1)
    if scheme.lower() == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    system, at = fs.FileSystem.from_uri(path.replace("s3a:", "s3:", 1))
    return system.open_input_file(at)


def _sources(spark: SparkSession, path: str) -> tuple[DataFrame, bool]:
    """A row for each file: its path alone, or its content too where Arrow cannot open it; spread over tasks by file."""
    files = files_of(spark, path)
    first = files.select("path").first()
    if first is None:
        raise FileNotFoundError(path)
    if not by_range(first["path"]):
        return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content"), True
    return files.select("path").repartition(spark.sparkContext.defaultParallelism), False


def _each(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[tuple[str, object]]:
    for batch in batches:
        contents = batch.column(1) if whole else [None] * batch.num_rows
        for path, content in zip(batch.column(0).to_pylist(), contents, strict=True):
            yield path, io.BytesIO(content.as_py()) if whole else opened(path)


def footers(spark: SparkSession, path: str) -> DataFrame:
    """FOOTERS of a Parquet table: a row for each file, row group and top-level column. No value is decoded."""
    files, whole = _sources(spark, path)
    names = [f.split()[0] for f in FOOTERS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for name, source in _each(batches, whole):
            with source, pq.ParquetFile(source) as file:
                schema, rows = file.schema_arrow, []
                scalar = {f.name: not pa.types.is_nested(f.type) for f in schema}
                for g in range(file.metadata.num_row_groups):
                    group, sizes = file.metadata.row_group(g), {}
                    for k in range(group.num_columns):
                        chunk = group.column(k)
                        top = chunk.path_in_schema if chunk.path_in_schema in scalar else chunk.path_in_schema.split(".")[0]
                        a, b = sizes.get(top, (0, 0))
                        sizes[top] = (a + chunk.total_uncompressed_size, b + chunk.total_compressed_size)
                    rows += [(name, g, group.num_rows, c, scalar.get(c, False), *s) for c, s in sizes.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=names)

    return files.mapInArrow(run, FOOTERS)


def arrow_batches(spark: SparkSession, path: str) -> DataFrame:
    """path, batch, schema (in its IPC form): a row for each record batch of the Arrow files below a path; from their footers. A file without batches
    has one row with batch -1."""
    files, whole = _sources(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, source in _each(batches, whole):
            with source:
                reader = pa.ipc.open_file(source)
                n, schema = reader.num_record_batches, reader.schema.serialize().to_pybytes()
            places = list(range(n)) or [-1]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(places)), pa.array(places, pa.int32()), pa.array([schema] * len(places), pa.binary())], names=["path", "batch", "schema"])

    return files.mapInArrow(run, "path string, batch int, schema binary")


def read_arrow(spark: SparkSession, path: str, columns: Sequence[str] | None = None, batches_a_task: int = 4) -> DataFrame:
    """The rows of the Arrow files below a path, all of one schema. A task reads about `batches_a_task` record batches, each by its range, and of
    them the asked columns only; so one file of any size is read by many tasks. Files of one schema that differ in metadata are the same."""
    from pyspark.sql.pandas.types import from_arrow_schema

    from . import store

    plan = store.staged(arrow_batches(spark, path), "batches")
    # metadata and the order of its keys are no part of a schema
    kinds = {pa.ipc.read_schema(pa.py_buffer(bytes(r["schema"]))).remove_metadata() for r in plan.select("schema").distinct().limit(64).collect()}
    if len(kinds) != 1:
        raise ValueError("the files have different schemas")
    schema = kinds.pop()
    missing = [c for c in columns or () if c not in schema.names]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    wanted = list(columns) if columns else schema.names
    places = [schema.get_field_index(c) for c in wanted]
    real = plan.where("batch >= 0").select("path", "batch")
    first = plan.select("path").first()["path"]
    if not by_range(first):
        return _read_whole(spark, path, wanted, from_arrow_schema(pa.schema([schema.field(k) for k in places])))
    tasks = max(1, -(-real.count() // batches_a_task))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcReadOptions(included_fields=sorted(places))
        for batch in batches:
            for name, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with opened(name) as source:
                    yield pa.ipc.open_file(source, options=options).get_batch(k).select(wanted)

    return real.repartition(tasks, "path", "batch").mapInArrow(run, from_arrow_schema(pa.schema([schema.field(k) for k in places])))


def _read_whole(spark: SparkSession, path: str, wanted: list[str], schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, source in _each(batches, True):
            reader = pa.ipc.open_file(source)
            for k in range(reader.num_record_batches):
                yield reader.get_batch(k).select(wanted)

    return _sources(spark, path)[0].mapInArrow(run, schema)
