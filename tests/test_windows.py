"""Closed windows are released once, whatever restarts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmaloom.sources import results
from sigmaloom.streaming import windows

DAY = 86_400
FIRST = 1_704_067_200  # 2024-01-01


def start(spark, source, folder, checkpoint, sigma=2.0, secret=b"k"):
    stream = spark.readStream.schema("ts timestamp, c int").parquet(str(source))
    counts = windows.windowed_counts(stream, "ts", F.col("c"))
    query = windows.release_closed(counts, f"file://{folder}", f"file://{checkpoint}", 3, sigma, secret, {"of": "events"}, {"availableNow": True})
    query.awaitTermination(300)
    return query


def test_windows_are_released_once(spark, tmp_path):
    source, folder = tmp_path / "in", tmp_path / "out"
    rows = [("2024-01-01 01:00:00", 1), ("2024-01-01 02:00:00", 1), ("2024-01-01 03:00:00", 7), ("2024-01-02 01:00:00", 2), ("2024-01-09 01:00:00", 0)]
    add = lambda r: spark.createDataFrame(r, "ts string, c int").select(F.to_timestamp("ts").alias("ts"), "c").coalesce(1).write.mode("append").parquet(str(source))
    add(rows)
    days = [FIRST + k * DAY for k in range(12)]
    start(spark, source, folder, tmp_path / "c1")
    one = windows.released(spark, f"file://{folder}", days)
    assert set(one) == {days[0], days[1]}  # the ninth is open
    assert 0 < np.abs(np.array(one[days[0]]) - [0, 2, 0]).max() < 20 and one[days[0]] != one[days[1]]
    again = tmp_path / "c2"  # a driver that lost its checkpoint reads all again
    start(spark, source, folder, again)
    assert windows.released(spark, f"file://{folder}", days) == one
    add([("2024-01-12 05:00:00", 1), ("2024-01-01 05:00:00", 1)])  # the second is too late for its window
    start(spark, source, folder, tmp_path / "c1")
    two = windows.released(spark, f"file://{folder}", days)
    assert set(two) == {days[0], days[1], days[8]} and all(two[d] == one[d] for d in one)
    with pytest.raises(Exception, match="another request"):  # other cells under a window that was answered
        start(spark, source, folder, tmp_path / "c3", sigma=3.0)


def test_other_secrets_give_other_noise(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("2024-01-01 01:00:00", 1), ("2024-01-09 01:00:00", 0)], "ts string, c int").select(F.to_timestamp("ts").alias("ts"), "c").coalesce(1).write.parquet(str(source))
    got = []
    for k in (b"a", b"b"):
        start(spark, source, tmp_path / k.decode(), tmp_path / f"c{k.decode()}", secret=k)
        got.append(windows.released(spark, f"file://{tmp_path / k.decode()}", [FIRST]))
    assert got[0] != got[1] and len(got[0]) == len(got[1]) == 1
    assert results.Files(spark, f"file://{tmp_path}/none").read("x") is None


def test_the_registered_windows_take_times_to_the_nearest_second_as_their_sql_does(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__

    con = duckdb.connect()
    times = ["05:59:59.4", "05:59:59.5", "05:59:59.6", "06:00:00.5", "11:59:58.5", "12:00:00"]
    rows = ", ".join(f"(TIMESTAMP '2024-01-01 {t}', '{kind}')" for t in times for kind in ("error", "click"))
    con.sql(f"COPY (SELECT * FROM (VALUES {rows}) AS v(ts, event_type)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = sorted(con.sql(__spark_entry__.oracle_sql()["windowed_counts"]).fetchall())
    got = sorted(map(tuple, __spark_entry__.queries()["windowed_counts"](spark, str(tmp_path)).collect()))
    assert got == want and [r[2] for r in want] == [1, 1, 4, 4, 1, 1]
