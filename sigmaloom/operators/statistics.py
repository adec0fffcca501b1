"""Sufficient statistics in long form: (keys..., coord, value) with every coordinate of a fixed public layout present.

All of them are sums with map-side combination; counts and fixed-point sums are BIGINT, so no result depends on the
order in which partitions arrive. Nothing here is fit to be released as it is; see privacy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import bin_of, clamp, score_bin

#: Fixed point of regression sums, gradients and hessians.
SCALE = 1 << 20
#: Mass of a unit, in parts.
MASS = 1 << 52


def dense(sparse: DataFrame, keys: list[str], size: int, value: str = "value", zero: object = 0) -> DataFrame:
    """Every coordinate 0 .. size - 1 for each combination of keys that occurs; for no keys also of an empty table."""
    layout = sparse.sparkSession.range(size).withColumnRenamed("id", "coord")
    if keys:
        layout = sparse.select(*keys).distinct().withColumn("coord", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))))
    filled = layout.join(sparse.withColumn("coord", F.col("coord").cast("long")), [*keys, "coord"], "left")
    return filled.select(*keys, F.col("coord").cast("int").alias("coord"), F.coalesce(F.col(value), F.lit(zero)).alias(value))


def counts(df: DataFrame, keys: list[str], coord: Column, size: int) -> DataFrame:
    return dense(df.groupBy(*keys, coord.cast("long").alias("coord")).agg(F.count(F.lit(1)).alias("value")), keys, size)


def association(df: DataFrame, keys: list[str], exposure: str, outcome: str) -> DataFrame:
    """Nine cells, 3 x exposure + outcome, of the codes 0, 1, 2."""
    return counts(df, keys, F.col(exposure) * 3 + F.col(outcome), 9)


def score_histogram(df: DataFrame, keys: list[str], label: Column, score: Column, bins: int) -> DataFrame:
    """label x bins + bin of the score; labels are rounded half to even and clamped to 0, 1."""
    y = clamp(F.rint(label.cast("double")), 0, 1).cast("int")
    return counts(df, keys, y * bins + score_bin(score, bins), 2 * bins)


def class_scores(scores: Column, classes: int) -> Column:
    """Scores clamped to 0 .. 1 and normalised; all zero: equal."""
    p = F.transform(scores, lambda v: clamp(v, 0, 1))
    total = F.aggregate(p, F.lit(0.0), lambda a, v: a + v)
    return F.transform(p, lambda v: F.when(total > 0, v / total).otherwise(F.lit(1.0 / classes)))


def multiclass(df: DataFrame, keys: list[str], label: Column, scores: Column, classes: int, bins: int) -> DataFrame:
    """classes x classes confusion cells (true class major; the first of equal scores is predicted), then for each class a histogram of
    its score, one against the rest."""
    y = clamp(F.rint(label.cast("double")), 0, classes - 1).cast("int")
    rows = df.select(*keys, y.alias("_y"), class_scores(scores, classes).alias("_p"))
    cell = F.array((F.col("_y") * classes + F.array_position("_p", F.array_max("_p")) - 1).cast("long"))
    of_class = lambda c: (F.lit(classes * classes) + (c * 2 + (F.col("_y") == c).cast("int")) * bins + score_bin(F.get("_p", c), bins)).cast("long")
    coords = F.concat(cell, F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), of_class))
    return counts(rows.select(*keys, F.explode(coords).alias("_c")), keys, F.col("_c"), classes * classes + 2 * classes * bins)


def multilabel(df: DataFrame, keys: list[str], truth: Column, scores: Column, labels: int, bins: int) -> DataFrame:
    """A histogram of each label's score; truth and scores are arrays."""
    rows = df.select(*keys, F.posexplode(F.arrays_zip(truth.alias("y"), scores.alias("p"))).alias("_l", "_x"))
    y = clamp(F.rint(F.col("_x.y").cast("double")), 0, 1).cast("int")
    return counts(rows, keys, (F.col("_l") * 2 + y) * bins + score_bin(F.col("_x.p"), bins), 2 * labels * bins)


def regression_terms(y: Column, p: Column, lower: float, upper: float, count_task: bool = False) -> list[Column]:
    """1, error, squared error, target, squared target, all on the unit interval of the bounds; for counts also the Poisson
    deviance as a share of its public cap."""
    import math

    yc, pc = clamp(y.cast("double"), lower, upper), clamp(p.cast("double"), lower, upper)
    yn, pn = (yc - lower) / (upper - lower), (pc - lower) / (upper - lower)
    e = F.abs(yn - pn)
    out = [F.lit(1.0), e, e * e, yn, yn * yn]
    if count_task:
        floor = max(1e-8, lower)
        safe = clamp(pc, floor, upper)
        deviance = F.greatest(F.lit(0.0), 2 * F.when(yc > 0, yc * F.ln(F.greatest(yc, F.lit(1e-300)) / safe) - (yc - safe)).otherwise(safe))
        cap = max(1e-12, 2 * floor, 2 * upper, 2 * (upper * math.log(upper / floor) - (upper - floor)) if upper > 0 else 0.0)
        out.append(clamp(deviance / cap, 0, 1))
    return out


def regression_sums(df: DataFrame, keys: list[str], y: Column, p: Column, lower: float, upper: float, count_task: bool = False) -> DataFrame:
    """The sums of regression_terms, one coordinate each. Sums are of fixed point, so they are the same in any order."""
    terms = regression_terms(y, p, lower, upper, count_task)
    fixed = [F.sum(F.rint(t * float(1 << 40)).cast("long").cast("decimal(38,0)")).alias(f"t{k}") for k, t in enumerate(terms)]
    one = df.groupBy(*keys).agg(*fixed)
    values = F.array(*[(F.coalesce(F.col(f"t{k}"), F.lit(0)).cast("double") / float(1 << 40)) for k in range(len(terms))])
    return one.select(*keys, F.posexplode(values).alias("coord", "value"))


def unit_mass(df: DataFrame, keys: list[str], unit: str, coord: Column, size: int) -> DataFrame:
    """A histogram to which each unit adds a mass of exactly 1, however many rows it has: MASS parts dealt over its rows, the
    remainder by falling coordinate rank. Rows of a unit are counted by coordinate first, so what is gathered for a unit is a row for
    each of its distinct coordinates, `size` at most."""
    cells = df.groupBy(*keys, unit, coord.cast("long").alias("coord")).agg(F.count(F.lit(1)).alias("n"))
    of_unit = cells.groupBy(*keys, unit).agg(F.array_sort(F.collect_list(F.struct("coord", "n"))).alias("cells"), F.sum("n").alias("rows"))
    share, left = F.floor(F.lit(MASS) / F.col("rows")).cast("long"), (F.lit(MASS) % F.col("rows")).cast("long")
    before = lambda k: F.aggregate(F.slice(F.col("cells"), 1, k), F.lit(0).cast("long"), lambda a, c: a + c["n"])
    parts = F.transform(F.col("cells"), lambda c, k: F.struct(c["coord"].alias("coord"), (share * c["n"] + F.least(F.greatest(left - before(k), F.lit(0).cast("long")), c["n"])).alias("parts")))
    dealt = of_unit.select(*keys, F.explode(parts).alias("x")).groupBy(*keys, F.col("x.coord").alias("coord")).agg(F.sum(F.col("x.parts").cast("decimal(38,0)")).alias("parts"))
    return dense(dealt.select(*keys, "coord", (F.col("parts").cast("double") / float(MASS)).alias("value")), keys, size, zero=0.0)


def leaf_statistics(df: DataFrame, keys: list[str], leaf: Column, target: Column, leaves: int, task: str) -> DataFrame:
    """For each leaf two coordinates: counts of both classes, or the count and the fixed-point sum of a target on 0 .. 1."""
    y = target.cast("double")
    second = F.rint(clamp(y, 0, 1) * SCALE).cast("long")
    pair = F.array((1 - y).cast("long"), y.cast("long")) if task == "binary" else F.array(F.lit(1).cast("long"), second)
    rows = df.select(*keys, leaf.cast("long").alias("_leaf"), F.posexplode(pair).alias("_k", "_v"))
    return dense(rows.groupBy(*keys, (F.col("_leaf") * 2 + F.col("_k")).alias("coord")).agg(F.sum("_v").alias("value")), keys, 2 * leaves)


def gradient_columns(margin: Column, y: Column, task: str, g_clip: float, h_clip: float) -> tuple[Column, Column]:
    """Clipped gradient and hessian in fixed point."""
    p = 1 / (1 + F.exp(-clamp(margin, -700, 700)))
    g, h = (p - y, p * (1 - p)) if task == "binary" else (margin - y, F.lit(1.0))
    fix = lambda v, clip, lo: F.rint(clamp(v, lo, clip) / clip * SCALE).cast("long")
    return fix(g, g_clip, -g_clip), fix(h, h_clip, 0.0)


def gradient_histogram(df: DataFrame, slot: Column, bins: dict[int, Column], missing_bin: int, g: Column, h: Column) -> DataFrame:
    """slot, feature, bin, g, h, n: fixed-point sums of gradient and hessian, and counts. The features are exploded after
    projection, and combined in the map tasks, so the shuffle has a row for each cell and task at most."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(b, F.lit(missing_bin)).cast("int").alias("bin")) for f, b in bins.items()]))
    rows = df.select(slot.cast("int").alias("slot"), g.alias("_g"), h.alias("_h"), each.alias("_x")).select("slot", "_x.feature", "_x.bin", "_g", "_h")
    return rows.groupBy("slot", "feature", "bin").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h"), F.count(F.lit(1)).alias("n"))


def binned(df: DataFrame, features: dict[str, Sequence[float]]) -> DataFrame:
    """Adds b_<feature>: the bin of each feature by its cuts; null if missing."""
    return df.withColumns({f"b_{name}": bin_of(F.col(name), cuts) for name, cuts in features.items()})


def bucketed_count(n: Column) -> Column:
    """0 for 3 or fewer, else the power of two that is nearest in the logarithm."""
    return F.when(n <= 3, F.lit(0)).otherwise(F.pow(F.lit(2.0), F.rint(F.log2(n.cast("double"))))).cast("long")
