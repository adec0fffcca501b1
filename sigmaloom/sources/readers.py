"""Sources, the bounded Parquet projection, and sinks.

Formats: CSV, Parquet, Feather (Arrow IPC), frames in memory, image bundles (binary files and a metadata table), object
store prefixes. Columns are pruned at the scan; types are declared, not guessed.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranges, results
from .store import canonical_json

#: Bounds of a bounded projection.
MAX_ROWS, MAX_BYTES = 5_000_000, 512 << 20
KINDS = ("in_memory", "parquet", "csv", "feather", "image_bundle", "asset_ref")


@dataclass(frozen=True)
class Descriptor:
    """A lazy reference to a dataset: nothing is read before open()."""

    dataset_id: str
    kind: str
    path: str | None = None
    frame: DataFrame | None = None
    assets: dict[str, str] = field(default_factory=dict)
    schema: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS or (self.frame is None) == (self.kind == "in_memory"):
            raise ValueError("a descriptor has a known kind, and a frame or a path")

    def open(self, spark: SparkSession, columns: Sequence[str] | None = None) -> DataFrame:
        if self.kind == "in_memory":
            df = self.frame
        elif self.kind == "csv":
            df = read_csv(spark, self.path, self.schema)
        elif self.kind == "feather":
            df = read_feather(spark, self.path, columns)
        else:
            df = spark.read.parquet(self.path)
        return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """With a header; without a schema every column is text. Only an empty field is null: NA is a text like others."""
    reader = spark.read.option("header", True).option("nullValue", "").option("enforceSchema", False)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_feather(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Arrow IPC files, one or a folder of them, split by record batch; see `ranges.read_arrow`."""
    return ranges.read_arrow(spark, path, columns)


def read_files(spark: SparkSession, prefix: str, pattern: str = "*") -> DataFrame:
    """path (relative to the prefix), length, content of the files below a prefix of any file system; folders' markers are out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(prefix)
    root = prefix.rstrip("/") + "/"
    return files.where("length > 0").select(F.regexp_replace(F.col("path"), "^.*" + root.split("://")[-1].lstrip("/").replace(".", r"\."), "").alias("path"), "length", "content")


def listing(files: DataFrame) -> DataFrame:
    """files, bytes of a listing."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def column_names(df: DataFrame) -> list[str]:
    return df.columns


def projection_plan(spark: SparkSession, path: str, columns: Sequence[str]) -> dict:
    """rows, and the uncompressed bytes of the asked columns, of a Parquet table, from its footers, which executors read. ValueError if a column
    is missing from a row group, is not scalar, or is named twice."""
    if not 1 <= len(columns) <= 3 or len(set(columns)) != len(columns):
        raise ValueError("one to three different columns")
    feet = ranges.footers(spark, path)
    groups = feet.groupBy("path", "row_group").agg(F.max("rows").alias("rows"), F.sum(F.when(F.col("column").isin(*columns), F.col("uncompressed")).otherwise(0)).alias("bytes"), F.count_if(F.col("column").isin(*columns) & F.col("scalar")).alias("found"))
    found = groups.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("row_groups"), F.min("found").alias("found")).first()
    kinds = dict(spark.read.parquet(path).dtypes)
    if found["found"] not in (None, len(columns)) or any(kinds.get(c) is None or kinds[c].startswith(("array", "map", "struct", "variant")) for c in columns):
        raise ValueError("a column is missing or is not scalar")
    return {"rows": found["rows"], "bytes": found["bytes"], "row_groups": found["row_groups"]}


def _value_bytes(df: DataFrame) -> Column:
    """The bytes of a row's values once decoded: of texts and binaries their own and 8 of their offset, of others 8 or 16."""
    of = lambda name, kind: F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0)) + 8 if kind in ("string", "binary") else F.lit(16 if kind.startswith("decimal") else 8)
    return sum((of(*c) for c in df.dtypes), F.lit(0))


def bounded_projection(spark: SparkSession, path: str, columns: Sequence[str], max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Up to three scalar columns of a Parquet table, refused before a value is decoded if it has too many rows, or if its columns are larger,
    uncompressed and with 64 bytes a row, than they may be, as the footers say."""
    plan = projection_plan(spark, path, columns)
    if plan["rows"] > max_rows or plan["bytes"] + 64 * plan["rows"] > max_bytes:
        raise ValueError("the table is larger than a bounded projection may be")
    return spark.read.parquet(path).select(*columns)


def materialised_projection(spark: SparkSession, path: str, columns: Sequence[str], destination: str, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> dict:
    """Writes a bounded projection as a committed result of its own, checked again by what was decoded: dictionaries and runs make a column
    larger than its footer says. Returns rows, bytes and the digest of the rows, by which others compare their copy."""
    df = bounded_projection(spark, path, columns, max_rows, max_bytes)
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(_value_bytes(df)), F.lit(0)).alias("bytes")).first()
    if found["rows"] > max_rows or found["bytes"] + 64 * found["rows"] > max_bytes:
        raise ValueError("the table is larger than a bounded projection may be")
    note = {"rows": found["rows"], "bytes": found["bytes"], "sha256": results.content_digest(df)}
    commit = results.publish(df, destination, "table", note)
    if commit["rows"] != found["rows"] or results.content_digest(results.result(spark, destination)) != note["sha256"]:
        raise ValueError("the table changed while it was read")
    return note


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = df.write.mode("errorifexists")
    writer.option("compression", "zstd").parquet(path) if kind == "parquet" else writer.option("header", True).csv(path)


def sha256_json(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def write_json(value: object, path: str) -> str:
    """Writes canonical JSON on the driver by rename, so readers see the old file or the new one. Returns its digest."""
    text = canonical_json(value)
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        f.write(text)
    os.chmod(f.name, 0o600)
    os.replace(f.name, path)
    return hashlib.sha256(text.encode()).hexdigest()


def public_images(manifest: dict, what: str) -> list[dict]:
    """Labels, assets or masks that a manifest declares: names and definitions, never values or counts."""
    allowed = {"labels": ("name", "levels", "description"), "assets": ("name", "kind", "description"), "masks": ("name", "structure", "description")}[what]
    return [{k: str(x[k]) if not isinstance(x[k], list) else x[k] for k in allowed if k in x} for x in manifest.get(what, ()) if isinstance(x, dict)]
