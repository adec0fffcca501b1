"""Footers, Arrow files split by batch, committed results and the shared guard; locally and by a path that only Hadoop opens."""

import json
import subprocess
import sys
from pathlib import Path

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sigmaloom.sources import ranges, readers, results


@pytest.fixture(params=["local", "viewfs"])
def folder(spark, tmp_path, request):
    """A folder, as a path of this machine and as Spark is told of it."""
    if request.param == "local":
        return tmp_path, f"file://{tmp_path}"
    conf = spark._jsc.hadoopConfiguration()
    conf.set(f"fs.viewfs.mounttable.{tmp_path.name.lower().replace('_', '-')}.link./in", f"file://{tmp_path}")
    return tmp_path, f"viewfs://{tmp_path.name.lower().replace('_', '-')}/in"


def test_footers(spark, folder):
    here, there = folder
    (here / "t").mkdir()
    table = pa.table({"a": list(range(1000)), "b": ["x" * 50] * 1000, "c": [[1, 2]] * 1000})
    pq.write_table(table, here / "t" / "1.parquet", row_group_size=300)
    pq.write_table(table.slice(0, 10), here / "t" / "2.parquet")
    got = ranges.footers(spark, f"{there}/t").collect()
    assert len(got) == 5 * 3 and {r["column"]: r["scalar"] for r in got} == {"a": True, "b": True, "c": False}
    want = {}
    for name in ("1", "2"):
        meta = pq.read_metadata(here / "t" / f"{name}.parquet")
        for g in range(meta.num_row_groups):
            for k in range(3):
                want[f"{name}.parquet", g, "abc"[k]] = (meta.row_group(g).num_rows, meta.row_group(g).column(k).total_uncompressed_size, meta.row_group(g).column(k).total_compressed_size)
    assert {(r["path"].rsplit("/", 1)[1], r["row_group"], r["column"]): (r["rows"], r["uncompressed"], r["compressed"]) for r in got} == want


def test_projection_is_refused_by_its_real_size(spark, tmp_path):
    path = str(tmp_path / "t")
    long = "".join(chr(97 + k % 26) for k in range(5000))
    spark.range(400).select("id", F.concat(F.lit(long), F.col("id").cast("string")).alias("text"), F.lit("y" * 5000).alias("same")).coalesce(1).write.parquet(path)
    plan = readers.projection_plan(spark, path, ["text"])
    assert plan["rows"] == 400 and plan["bytes"] > 400 * 5000 > readers.projection_plan(spark, path, ["id"])["bytes"]
    assert readers.bounded_projection(spark, path, ["id"], max_bytes=100_000).count() == 400
    with pytest.raises(ValueError, match="larger"):  # 64 bytes a row and column would have let it pass
        readers.bounded_projection(spark, path, ["text"], max_bytes=100_000)
    readers.bounded_projection(spark, path, ["same"], max_bytes=100_000)  # one entry of a dictionary
    with pytest.raises(ValueError, match="larger"):  # but not when it is decoded
        readers.materialised_projection(spark, path, ["same"], str(tmp_path / "no"), max_bytes=100_000)
    assert results.committed(spark, str(tmp_path / "no")) is None
    for columns in (["absent"], [], ["id", "id"], ["id", "text", "same", "x"]):
        with pytest.raises(ValueError):
            readers.bounded_projection(spark, path, columns)
    other = tmp_path / "mixed"
    other.mkdir()
    pq.write_table(pa.table({"a": [1], "b": [2]}), other / "1.parquet")
    pq.write_table(pa.table({"a": [1]}), other / "2.parquet")
    with pytest.raises(ValueError, match="missing"):
        readers.bounded_projection(spark, str(other), ["b"])


def test_materialised_projection(spark, folder):
    here, there = folder
    df = spark.range(300).select(F.col("id").alias("a"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("b"), F.lit(1.5).alias("c"))
    df.write.parquet(f"{there}/source")
    note = readers.materialised_projection(spark, f"{there}/source", ["b", "a"], f"{there}/copy")
    copy = results.result(spark, f"{there}/copy", "table")
    assert copy.columns == ["b", "a"] and copy.count() == note["rows"] == 300 and note["sha256"] == results.content_digest(df.select("b", "a").repartition(5))
    assert note["sha256"] != results.content_digest(df.select("b", (F.col("a") + 1).alias("a"))) != results.content_digest(df.select("a", "b"))
    with pytest.raises(FileExistsError):
        readers.materialised_projection(spark, f"{there}/source", ["b", "a"], f"{there}/copy")


def test_arrow_files_by_batch(spark, folder):
    here, there = folder
    (here / "f").mkdir()
    schema = pa.schema([("id", pa.int64()), ("text", pa.string()), ("x", pa.float64())])
    at = 0
    for name, sizes in (("1.arrow", [10, 0, 25, 7]), ("2.arrow", [3]), ("3.arrow", [])):
        with pa.OSFile(str(here / "f" / name), "wb") as out, pa.ipc.new_file(out, schema.with_metadata({"made": name})) as writer:
            for n in sizes:
                writer.write_batch(pa.record_batch([pa.array(range(at, at + n)), pa.array([f"t{k}" for k in range(at, at + n)]), pa.array([0.5] * n)], schema=schema))
                at += n
    plan = ranges.arrow_batches(spark, f"{there}/f").collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["batch"]) for r in plan) == [("1.arrow", 0), ("1.arrow", 1), ("1.arrow", 2), ("1.arrow", 3), ("2.arrow", 0), ("3.arrow", -1)]
    got = readers.read_feather(spark, f"{there}/f")
    assert got.columns == ["id", "text", "x"] and sorted(r["id"] for r in got.collect()) == list(range(45))
    some = ranges.read_arrow(spark, f"{there}/f", ["x", "id"], batches_a_task=1)
    assert some.columns == ["x", "id"] and some.agg(F.sum("id"), F.sum("x")).first() == (45 * 44 // 2, 22.5)
    if there.startswith("file"):
        assert some.rdd.getNumPartitions() == 5
    with pytest.raises(ValueError):
        ranges.read_arrow(spark, f"{there}/f", ["absent"])
    frame = pd.DataFrame({"id": [1], "other": ["x"]})
    frame.to_feather(here / "f" / "4.arrow")
    with pytest.raises(ValueError):
        ranges.read_arrow(spark, f"{there}/f")


def test_bytes_read_do_not_grow_with_the_file(tmp_path):
    """One batch of a large file is read by its range."""
    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])
    with pa.OSFile(str(tmp_path / "big.arrow"), "wb") as out, pa.ipc.new_file(out, schema) as writer:
        for k in range(50):
            writer.write_batch(pa.record_batch([pa.array(range(1000)), pa.array(["z" * 500] * 1000)], schema=schema))
    read = []

    class Counted:
        def __init__(self, f):
            self.f, self.closed, self.mode = f, False, "rb"

        def read(self, n=-1):
            data = self.f.read(n)
            read.append(len(data))
            return data

        def __getattr__(self, name):
            return getattr(self.f, name)

    with open(tmp_path / "big.arrow", "rb") as f:
        batch = pa.ipc.open_file(pa.PythonFile(Counted(f), "r")).get_batch(20)
    assert batch.num_rows == 1000 and sum(read) < (tmp_path / "big.arrow").stat().st_size / 10


def test_results_are_whole_or_not_there(spark, folder):
    here, there = folder
    df = spark.range(10).select("id", F.array("id").alias("more"))
    with pytest.raises(FileNotFoundError):
        results.result(spark, f"{there}/r")
    broken = df.select(F.raise_error(F.lit("killed")).alias("id"))
    with pytest.raises(Exception, match="killed"):
        results.publish(broken, f"{there}/r")
    assert results.committed(spark, f"{there}/r") is None
    df.write.parquet(f"{there}/r/data-of-a-killed-writer")  # no commit: no one looks at it
    commit = results.publish(df, f"{there}/r", "metrics", {"n": 10})
    assert commit["rows"] == 10 and results.committed(spark, f"{there}/r") == commit and sorted(results.result(spark, f"{there}/r", "metrics").collect()) == df.collect()
    with pytest.raises(FileExistsError):
        results.publish(df, f"{there}/r")
    with pytest.raises(ValueError):
        results.result(spark, f"{there}/r", "model")
    with pytest.raises(ValueError):
        results.publish(df, f"{there}/s", "other")
    results.publish(df.limit(0), f"{there}/none")
    assert results.result(spark, f"{there}/none").count() == 0
    part = next((here / "r" / commit["data"]).glob("*.parquet"))
    part.unlink()
    with pytest.raises(ValueError):
        results.result(spark, f"{there}/r")


def test_one_of_two_writers_wins(spark, folder):
    files = results.Files(spark, folder[1] + "/x")
    assert files.create("a", b"1") and not files.create("a", b"2") and files.read("a") == b"1" and files.read("b") is None
    assert {p.name for p in (folder[0] / "x").iterdir() if not p.name.endswith(".crc")} == {"a"}  # nothing is left aside


def test_a_guard_of_several_drivers(spark, folder):
    here, there = folder
    asked = []
    answer = lambda v: lambda: asked.append(v) or {"v": v}
    one, two = results.SharedGuard(spark, f"{there}/g"), results.SharedGuard(spark, f"{there}/g")
    assert one.claim("train", 1, 0, {"x": 1}, answer(1)) == {"v": 1} == two.claim("train", 1, 0, {"x": 1}, answer(2)) and asked == [1]
    with pytest.raises(ValueError):
        two.claim("train", 1, 0, {"x": 2}, answer(3))
    assert two.claim("train", 2, 0, {"x": 2}, answer(4)) == {"v": 4} and asked == [1, 4]
    with pytest.raises(RuntimeError):
        one.claim("train", 3, 0, {}, lambda: (_ for _ in ()).throw(RuntimeError()))
    assert two.claim("train", 3, 0, {}, answer(5)) == {"v": 5}  # the first one ended before it answered
    late = results.SharedGuard(spark, f"{there}/g")
    outer = one.claim("train", 4, 0, {}, lambda: late.claim("train", 4, 0, {}, answer(6)) and {"v": 7})
    assert outer == {"v": 6}  # both were at work: the first answer is everyone's


def test_two_processes_one_answer(tmp_path):
    code = "import sys, json, time; sys.path.insert(0, %r); from pyspark.sql import SparkSession; from sigmaloom.sources.results import SharedGuard; s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate(); print(json.dumps(SharedGuard(s, %r).claim('op', 1, 1, {'a': 1}, lambda: (time.sleep(2), time.time_ns())[1])))"
    code %= (str(Path(__file__).resolve().parent.parent), f"file://{tmp_path}/g")
    both = [subprocess.Popen([sys.executable, "-c", code], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) for _ in range(2)]
    said = {json.loads(p.communicate(timeout=300)[0].split()[-1]) for p in both}
    assert len(said) == 1
