"""Tables in the folder that driver and executors share, to cut lineage: computed once, and safe when executors are lost."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What this process has written and has not removed: folders, and catalog tables by name.
_PATHS: list[str] = []
_TABLES: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, local mode gets a temporary folder; on a cluster no machine's own folder would do, so
    that raises RuntimeError."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sigmaloom-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, which cleanup removes."""
    _PATHS.append(f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}")
    return _PATHS[-1]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def temporary_table(name: str) -> str:
    """A new name of a catalog table, which cleanup drops."""
    _TABLES.append(f"{name}_{uuid.uuid4().hex}")
    return _TABLES[-1]


def cleanup(spark: SparkSession) -> int:
    """Removes the staged tables of this process, and returns their number. Frames that read them are no longer valid: call it when
    the results of the queries have been written or collected."""
    done = len(_PATHS) + len(_TABLES)
    for table in _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in _PATHS:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    _PATHS.clear()
    _TABLES.clear()
    return done


def canonical_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, allow_nan=False, sort_keys=True, separators=(",", ":"))
