"""Cleaning rules on the values that are known to be awkward. No row is ever dropped."""

import pytest
from pyspark.sql import functions as F

from sigmaloom.functions import clean, paths


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_features_are_total(spark):
    got = column(spark, ["1e300", "-1e300", None, "not-numeric", "NaN", "Infinity", "3"], lambda v: clean.feature(v, -10, 10))
    assert got == [1e6, -1e6, 0.0, 0.0, 0.0, 0.0, 3.0]
    assert column(spark, ["x", None, "7"], clean.feature) == [0.0, 0.0, 7.0]


def test_tree_features_keep_missing(spark):
    assert column(spark, ["NaN", None, "Infinity", "-Infinity", "-0.0", "7"], lambda v: clean.tree_feature(v, -5, 5)) == [None, None, 5.0, -5.0, 0.0, 5.0]


def test_levels(spark):
    levels = ("b", "c", "d")
    assert column(spark, ["b", "c", "d", "unknown", None], lambda v: clean.level_code(v, levels)) == [0, 1, 2, 0, 0]
    assert column(spark, ["2", "1.5", "-1", "9", None], lambda v: clean.integer_code(v, 3)) == [2, 0, 0, 0, 0]


def test_association_codes(spark):
    assert column(spark, ["0", "1", None, "9", "NaN", "-0.0"], lambda v: clean.association_code(v, (0, 1))) == [0, 1, 2, 2, 2, 0]


def test_units(spark):
    ids = [None, "", "  \t\r\n", "NA", "NaN", "NULL", "<NA>", "NaT", " patient ", "patient", " patient ", clean.MISSING_UNIT, "x" * 5000]
    got = column(spark, ids, clean.unit_id)
    assert got.count(clean.MISSING_UNIT) == 10 and got.count("patient") == 2 and " patient " in got


@pytest.mark.parametrize(("x", "want"), [(5.0, 0), (5.1, 1), (40.0, 3), (41.0, 4), (None, None), (float("nan"), None)])
def test_bins_count_cuts_below(spark, x, want):
    assert column(spark, [x], lambda v: clean.bin_of(v, (5.0, 10.0, 20.0, 40.0)), "double") == [want]


def test_paths(spark):
    got = column(spark, ["a/b.png", "/a", "a//b", "../a", "C:x", "a\\b", "", None, "a\tb"], paths.safe_relative)
    assert got == ["a/b.png", *[paths.INVALID_PATH] * 8]
    assert column(spark, ["x/LUNG1-001.NII.GZ", "y.tar.png"], paths.stem) == ["LUNG1-001", "y.tar"]
    assert column(spark, ["s3://b/site/images/L.nii.gz", "s3://b/other/L"], lambda v: paths.below_prefix(v, "s3://b/site/images/")) == ["L.nii.gz", None]
    files = ['[{"role":"mask","path":"m"},{"role":"image","uri":"u"}]', '[{"role":"x","file":"f"}]', "[]", "broken", None]
    assert column(spark, files, paths.primary_file) == ["u", "f", None, None, None]
