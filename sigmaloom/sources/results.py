"""Results that are there whole or not at all, and a replay guard, on any file system that Spark reaches.

A result is a folder with data and, written last, a commit that names the data, its files and their sizes. The commit is made by exclusive
creation, so of several writers one wins, and a writer that was killed leaves nothing that a reader sees. Readers go by the commit
alone, and compare the files with it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import canonical_json

COMMIT = "_commit.json"
#: What a result can be.
KINDS = ("table", "metrics", "model")


class Files:
    """A folder on any file system that Hadoop knows, by the session's own configuration."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm, self.folder = spark._jvm, folder.rstrip("/")
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), spark._jsc.hadoopConfiguration())
        self.system = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def local(self) -> str | None:
        """The folder's path if it lies on this machine's file system."""
        uri = self.system.makeQualified(self._path("")).toUri()
        return uri.getPath() if uri.getScheme() == "file" else None

    def create(self, name: str, content: bytes) -> bool:
        """Makes a file whole by exclusive creation; False if there is one. The content is written aside first, so no one sees a part of it."""
        self.system.mkdirs(self._path(""))
        aside = f".{name}.{uuid.uuid4().hex}"
        out = self.system.create(self._path(aside), True)
        out.write(bytearray(content))
        out.close()
        try:
            if self.local():  # a hard link is exclusive there, and a rename is not
                import os

                try:
                    os.link(f"{self.local()}/{aside}", f"{self.local()}/{name}")
                except FileExistsError:
                    return False
                return True
            return self._renamed(aside, name)
        finally:
            self.system.delete(self._path(aside), False)

    def _renamed(self, aside: str, name: str) -> bool:
        from py4j.protocol import Py4JJavaError
        from pyspark import SparkContext

        kind = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename")
        options = SparkContext._active_spark_context._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            self.context.rename(self._path(aside), self._path(name), options)  # fails if the target exists
        except Py4JJavaError:
            if self.read(name) is None:
                raise
            return False
        return True

    def read(self, name: str) -> bytes | None:
        if not self.system.exists(self._path(name)):
            return None
        stream = self.system.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def sizes(self, name: str) -> dict[str, int]:
        """Names and sizes of the files of a folder below this one, but hidden ones."""
        path = self._path(name)
        found = self.system.listStatus(path) if self.system.exists(path) else []
        return {f.getPath().getName(): int(f.getLen()) for f in found if f.isFile() and not f.getPath().getName().startswith(("_", "."))}

    def delete(self, name: str) -> None:
        self.system.delete(self._path(name), True)


def publish(df: DataFrame, folder: str, kind: str = "table", note: dict | None = None) -> dict:
    """Writes a result of some kind, with a note that JSON holds, and commits it. Returns the commit; FileExistsError if there is one
    already. A failure before the commit leaves data that no reader looks at, and that is removed if the process still can."""
    if kind not in KINDS:
        raise ValueError(f"no such kind: {kind}")
    files, data = Files(df.sparkSession, folder), f"data-{uuid.uuid4().hex}"
    if files.read(COMMIT) is not None:
        raise FileExistsError(folder)
    try:
        df.write.parquet(f"{folder}/{data}")
        rows = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{data}").count()
        commit = {"kind": kind, "data": data, "rows": rows, "files": files.sizes(data), "note": note or {}, "schema": json.loads(df.schema.json())}
        text = canonical_json(commit)
        won = files.create(COMMIT, text.encode())
    except BaseException:
        files.delete(data)
        raise
    if not won:
        files.delete(data)
        raise FileExistsError(folder)
    return json.loads(text)


def committed(spark: SparkSession, folder: str) -> dict | None:
    """The commit of a result, or None if there is none yet."""
    text = Files(spark, folder).read(COMMIT)
    return None if text is None else json.loads(text)


def result(spark: SparkSession, folder: str, kind: str | None = None) -> DataFrame:
    """The rows of a committed result. FileNotFoundError without a commit; ValueError if it is of another kind or its files are not those that were
    committed."""
    from pyspark.sql.types import StructType

    commit = committed(spark, folder)
    if commit is None:
        raise FileNotFoundError(folder)
    if kind is not None and commit["kind"] != kind:
        raise ValueError(f"a result of kind {commit['kind']}")
    if Files(spark, folder).sizes(commit["data"]) != commit["files"]:
        raise ValueError("files of the result are missing or changed")
    return spark.read.schema(StructType.fromJson(commit["schema"])).parquet(f"{folder}/{commit['data']}")


def content_digest(df: DataFrame) -> str:
    """A digest of a table's rows as a bag: the same for any order, partitioning and file format. Each row's SHA-256 is cut into four numbers, and
    these are added up."""
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.coalesce(F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string").alias(f"s{k}")
    sums = df.agg(F.count(F.lit(1)).alias("n"), *map(part, range(4))).first()
    return hashlib.sha256(canonical_json([df.columns, *map(str, sums)]).encode()).hexdigest()


class SharedGuard:
    """The replay guard over a folder that several drivers share: one answer for each operation, fold and round. A claim and an answer are each made
    by exclusive creation, so of several processes with one request all return the answer of the one that was first, and another request
    under the same name is refused before any data are read. A claim whose process ended before it answered is answered by the next."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.files = Files(spark, folder)

    def claim(self, operation: str, fold: int, round_: int, request: object, answer: Callable[[], object]) -> object:
        name = hashlib.sha256(json.dumps([operation, fold, round_]).encode()).hexdigest()
        digest = hashlib.sha256(canonical_json(request).encode()).hexdigest()
        if not self.files.create(f"{name}.claim", digest.encode()) and self.files.read(f"{name}.claim") != digest.encode():
            raise ValueError("this round was answered for another request")
        found = self.files.read(f"{name}.json")
        if found is None:
            self.files.create(f"{name}.json", canonical_json(answer()).encode())
            found = self.files.read(f"{name}.json")
        return json.loads(found)
