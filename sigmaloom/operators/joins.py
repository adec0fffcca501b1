"""The left join of labels and the look-ups of image collections. No left row is lost or doubled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import MISSING_UNIT, unit_id
from ..functions.paths import INVALID_PATH, base_name, first_path, stem, suffix_rank, without_suffix


def label_join(samples: DataFrame, labels: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join on the canonical key. Labels whose key is missing or occurs more than once are out, all copies of them; keys that
    are missing on the left match nothing."""
    once = labels.select(unit_id(F.col(key)).alias("_key"), *columns).groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in columns])
    once = once.where((F.col("_n") == 1) & (F.col("_key") != MISSING_UNIT)).drop("_n")
    left = samples.withColumn("_sample", F.nullif(unit_id(F.col(key)), F.lit(MISSING_UNIT)))
    return left.join(once, left["_sample"] == once["_key"], "left").drop("_sample", "_key")


def first_match(left: DataFrame, lookup: DataFrame, left_key: Column, lookup_key: str, value: str, order: str, name: str) -> DataFrame:
    """Left join with the first lookup row of each key, by `order`."""
    one = lookup.where(F.col(lookup_key).isNotNull()).groupBy(F.col(lookup_key).alias("_lookup")).agg(F.min_by(F.col(value), F.col(order)).alias(name))
    return left.withColumn("_left", left_key).join(one, F.col("_left") == F.col("_lookup"), "left").drop("_left", "_lookup")


def resolved_paths(samples: DataFrame, manifest: DataFrame, files: DataFrame, id_col: str = "sample_id", path_col: str = "relative_path") -> DataFrame:
    """The path of each sample: its own, else that of the first manifest row with its id, else that of the first file whose stem is its
    id, else the file that is its id, folders included, and an image suffix, in the order of the suffixes, else INVALID_PATH.
    manifest: sample_id, ordinal, path; files: path."""
    with_manifest = first_match(samples, manifest, F.col(id_col), "sample_id", "path", "ordinal", "_from_manifest")
    named = files.select(stem(F.col("path")).alias("_stem"), F.col("path").alias("_path"))
    with_files = first_match(with_manifest, named, F.col(id_col), "_stem", "_path", "_path", "_from_files")
    probes = files.where(suffix_rank(F.col("path")).isNotNull()).select(without_suffix(F.col("path")).alias("_whole"), F.col("path").alias("_path"), F.struct(suffix_rank(F.col("path")), "path").alias("_rank"))
    with_probes = first_match(with_files, probes, F.col(id_col), "_whole", "_path", "_rank", "_from_probe")
    found = first_path(F.col(path_col), F.col("_from_manifest"), F.col("_from_files"), F.col("_from_probe"))
    return with_probes.withColumn(path_col, found).drop("_from_manifest", "_from_files", "_from_probe")


def invalid_paths(df: DataFrame, path_col: str = "relative_path") -> DataFrame:
    return df.agg(F.count_if(F.col(path_col) == INVALID_PATH).alias("invalid"), F.count(F.lit(1)).alias("rows"), F.count_distinct(base_name(F.col(path_col))).alias("names"))
