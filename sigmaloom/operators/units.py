"""Units of aggregation: rows or subjects. Every reducer leaves one row for a unit, with map-side combination."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keyed
from ..functions.clean import clamp, unit_id
from ..sources import store


def with_unit(df: DataFrame, subject: str | None, row_key: str | None = None, name: str = "unit") -> DataFrame:
    """Adds the unit: the canonical subject id, or the declared row key as text."""
    return df.withColumn(name, unit_id(F.col(subject)) if subject else F.col(row_key).cast("string"))


def count_units(df: DataFrame, unit: str | None = None) -> DataFrame:
    """n_rows, n_units."""
    units = F.count_distinct(F.col(unit)) if unit else F.count(F.lit(1))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), units.alias("n_units"))


def ever_positive(df: DataFrame, keys: list[str], codes: list[str]) -> DataFrame:
    """One row for keys; of the codes 0, 1, 2 of each column the strongest: 1 before 0 before 2."""
    strongest = lambda c: F.max(F.when(F.col(c) == 1, 2).when(F.col(c) == 0, 1).otherwise(0))
    out = df.groupBy(*keys).agg(*[strongest(c).alias(c) for c in codes])
    return out.select(*keys, *[F.when(F.col(c) == 2, 1).when(F.col(c) == 1, 0).otherwise(2).cast("tinyint").alias(c) for c in codes])


def pooled_means(df: DataFrame, unit: str, features: list[str], target: str | None = None) -> DataFrame:
    """Means of features, and of a continuous target."""
    return df.groupBy(unit).agg(*[F.avg(c).alias(c) for c in [*features, *([target] if target else [])]])


def pooled_mode(df: DataFrame, unit: str, label: str) -> DataFrame:
    """The most frequent label, of equally frequent ones the lowest."""
    counted = df.groupBy(unit, label).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(unit).agg(F.min_by(F.col(label), F.struct(-F.col("_n"), F.col(label))).alias(label))


def pooled_multilabel(df: DataFrame, unit: str, labels: list[str]) -> DataFrame:
    """1 if the mean is 0.5 or more: a tie counts as 1."""
    return df.groupBy(unit).agg(*[(2 * F.sum(c) >= F.count(F.lit(1))).cast("int").alias(c) for c in labels])


def pooled_tree_units(df: DataFrame, unit: str, features: dict[str, tuple[float, float]], target: str, task: str, bounds: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """For trees: means of the observed feature values, clamped (null if none was observed); a binary target by majority, a tie
    counting as 0; a continuous target by its clamped mean."""
    y = (2 * F.sum(target) > F.count(F.lit(1))).cast("int") if task == "binary" else clamp(F.avg(target), *bounds)
    return df.groupBy(unit).agg(*[clamp(F.avg(c), lo, hi).alias(c) for c, (lo, hi) in features.items()], y.alias(target))


def visits(df: DataFrame, unit: str, name: str = "visits") -> DataFrame:
    """Adds the number of rows of each row's unit. The counts are aggregated first and joined, so a hot unit is not
    gathered in one task."""
    counts = df.groupBy(F.col(unit).alias("_unit")).agg(F.count(F.lit(1)).alias(name))
    return df.join(counts, df[unit] == counts["_unit"]).drop("_unit")


def numbered(df: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """Adds the place of each row, from 0, in the order of a declared key, without one task that holds all rows: counts of
    ranges are prefix-summed, places inside a range are counted there. The ranged rows are staged once, so that counts and places
    are of the same ranges. Rows with equal keys come in any order."""
    ranged = df.repartitionByRange(*order) if order else df
    ranged = store.staged(ranged.withColumn("_part", F.spark_partition_id()), "ranged")
    before = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    offsets = before.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    inside = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*(order or ["_part"]))))
    return inside.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at") - 1).drop("_part", "_at", "_before")


def row_blocks(df: DataFrame, key: bytes, row_key: list[str], blocks: int, name: str = "block") -> DataFrame:
    """Adds a block, 0 .. blocks - 1, to each row: rows stand in the order of a keyed hash of their declared key, which is a random
    permutation to all without the key, and are cut into runs of sizes that differ by one at most."""
    if blocks < 1:
        raise ValueError("at least one block")
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in row_key])
    placed = numbered(df.withColumn("_rank", F.lower(keyed.hmac_hex(key, keyed.token("row", text, "row-blocks/v1")))), ["_rank", *row_key], "_place")
    n = placed.agg(F.count(F.lit(1)).alias("_rows"))  # one row
    # the first n % blocks blocks hold one row more
    small, more = F.expr(f"_rows div {blocks}"), F.col("_rows") % blocks
    block = F.when(F.col("_place") < more * (small + 1), F.expr(f"_place div (_rows div {blocks} + 1)")).otherwise(more + F.expr(f"(_place - (_rows % {blocks}) * (_rows div {blocks} + 1)) div greatest(_rows div {blocks}, 1)"))
    return placed.crossJoin(F.broadcast(n)).withColumn(name, block.cast("int")).drop("_rank", "_place", "_rows")


def small_cells_hidden(counts: DataFrame, count: str, least: int) -> DataFrame:
    """The rows of a table of counts that stand for `least` units or more. Never applied by itself: whether a row is there tells about
    the data, which noise does not cover."""
    return counts.where(F.col(count) >= least)


def check_least_rows(df: DataFrame, least: int) -> DataFrame:
    """df, if it has `least` rows or more; else ValueError. Looks at no more rows than it needs."""
    if least > 0 and len(df.select(F.lit(1)).limit(least).groupBy().count().where(F.col("count") >= least).take(1)) == 0:
        raise ValueError(f"fewer than {least} rows")
    return df


def check_label_range(df: DataFrame, label: str, classes: int) -> DataFrame:
    """df, if each label is a whole number of 0 .. classes - 1; else ValueError. Null labels are outside."""
    y = F.col(label).cast("double")
    outside = df.where(y.isNull() | F.isnan(y) | (y < 0) | (y >= classes) | (y != F.floor(y)))
    if not outside.isEmpty():
        raise ValueError(f"a label is outside 0 .. {classes - 1}")
    return df


def canonical_order(df: DataFrame, token: str, features: list[str], target: str) -> DataFrame:
    """Rows by token, features and target, nulls first. No sum here depends on the order; it is for files that are compared byte by byte."""
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in (token, *features, target)])
