import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigmaloom.plans import contract, prepare
from sigmaloom.sources import images, readers
from sigmaloom.streaming import windows


def test_readers(spark, tmp_path):
    frame = pd.DataFrame({"id": ["a", "NA", ""], "x": [1.0, 2.0, 3.0]})
    frame.to_csv(tmp_path / "t.csv", index=False)
    assert [r["id"] for r in readers.read_csv(spark, str(tmp_path / "t.csv"), "id string, x double").collect()] == ["a", "NA", None]
    pa.feather = __import__("pyarrow.feather").feather
    pa.feather.write_feather(frame, tmp_path / "t.feather")
    assert readers.read_feather(spark, str(tmp_path / "t.feather")).agg(F.sum("x")).first()[0] == 6
    d = readers.Descriptor("d", "csv", str(tmp_path / "t.csv"), schema="id string, x double")
    assert d.open(spark, ["x"]).columns == ["x"]
    with pytest.raises(ValueError):
        readers.Descriptor("d", "in_memory")


def test_bounded_projection(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(100).select("id", F.array("id").alias("nested")).write.parquet(path)
    assert readers.bounded_projection(spark, path, ["id"]).count() == 100
    for columns, rows in ((["nested"], 1000), (["absent"], 1000), (["id"], 99)):
        with pytest.raises(ValueError):
            readers.bounded_projection(spark, path, columns, max_rows=rows)


def test_images(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.pgm").write_bytes(b"P5\n4 4\n255\n" + bytes(range(16)))
    (tmp_path / "b.pgm").write_bytes(b"P5 broken")
    (tmp_path / "empty.pgm").write_bytes(b"")
    files = readers.read_files(spark, str(tmp_path))
    got = {r["path"]: r for r in images.thumbnails(files, 2).collect()}
    assert set(got) == {"sub/a.pgm", "b.pgm"} and got["sub/a.pgm"]["ok"] and got["sub/a.pgm"]["pixels"][3] > 0.8 and got["b.pgm"]["pixels"] == [0.0] * 4
    assert readers.listing(files).first()["files"] == 2


def test_sinks(spark, tmp_path):
    digest = readers.write_json({"b": 1, "a": "ä"}, str(tmp_path / "r.json"))
    assert (tmp_path / "r.json").read_text() == '{"a":"ä","b":1}' and len(digest) == 64
    readers.write_table(spark.range(3).toDF("x"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_prepare_keeps_every_row(spark):
    rows = [(str(v) if v is not None else None, y, u) for v, y, u in ((1, "0", "a"), ("x", "1", None), (None, None, "a"), ("Infinity", "7", " "))]
    df = spark.createDataFrame(rows, "f string, y string, u string").withColumn("extra", F.lit(1))
    c = contract.Contract("y", ("f",), subject="u", levels=(0, 1))
    got = prepare.prepare(df, c)
    assert got.columns == ["unit", "y", "f"] and got.count() == 4 and got.where("f is null or y is null").count() == 0
    assert prepare.handle(df, c)["n_units"] == 2 and prepare.prepare(df.limit(0), c).count() == 0
    with pytest.raises(ValueError):
        prepare.prepare(df.drop("f"), c)


def test_windows(spark, tmp_path):
    path = str(tmp_path / "events")
    df = spark.createDataFrame([("2024-01-01 01:00:00", 1), ("2024-01-01 02:00:00", 1), ("2024-01-02 01:00:00", 2), ("2024-01-09 01:00:00", 0)], "ts string, c int")
    df.select(F.to_timestamp("ts").alias("ts"), "c").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("ts timestamp, c int").parquet(path)
    q = windows.windowed_counts(stream, "ts", F.col("c")).writeStream.format("memory").queryName("cells").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["coord"], r["value"]) for r in spark.table("cells").collect()) == [(1, 2), (2, 1)]


def test_image_samples(spark):
    samples = spark.createDataFrame([("a", None), ("b", "x/b.png"), ("c", "../c"), ("d", None)], "sample_id string, relative_path string")
    labels = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "0"), ("d", "1")], "sample_id string, y0 string")
    manifest = spark.createDataFrame([("a", 2, "late"), ("a", 1, "m/a.png")], "sample_id string, ordinal int, path string")
    files = spark.createDataFrame([("f/c.nii.gz",)], "path string")
    c = contract.Contract("y0", ("f",), levels=(0, 1))
    got = {r["sample_id"]: (r["relative_path"], r["y"]) for r in prepare.image_samples(samples, labels, manifest, files, c).collect()}
    assert got == {"a": ("m/a.png", 1), "b": ("x/b.png", 0), "c": ("f/c.nii.gz", 0), "d": ("__invalid_path__", 1)}


def test_multilabel_contract():
    from sigmaloom.plans.contract import Contract

    c = Contract("a", ("x",), task="multilabel", more_targets=("b",))
    assert c.columns == ["a", "b", "x"]
    for bad in ({"task": "multilabel"}, {"more_targets": ("b",)}, {"task": "multilabel", "more_targets": ("a",)}):
        with pytest.raises(ValueError):
            Contract("a", ("x",), **bad)


def test_suffix_probe(spark):
    from sigmaloom.operators import joins

    samples = spark.createDataFrame([("f/a", None), ("f/b", None), (None, None)], "sample_id string, relative_path string")
    manifest = spark.createDataFrame([], "sample_id string, ordinal int, path string")
    files = spark.createDataFrame([("f/a.PNG",), ("f/a.dcm",), ("f/b.txt",), (None,)], "path string")
    got = {r["sample_id"]: r["relative_path"] for r in joins.resolved_paths(samples, manifest, files).collect()}
    assert got == {"f/a": "f/a.dcm", "f/b": "__invalid_path__", None: "__invalid_path__"}
