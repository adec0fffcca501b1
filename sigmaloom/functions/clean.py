"""Cleaning expressions. Each has one rule for every input value; all stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bound of every numeric feature.
FEATURE_LIMIT = 1e6
#: Bound of log-scale outputs.
LOGIT_LIMIT = 30.0
#: The unit of every row whose subject is missing or invalid.
MISSING_UNIT = "__missing_unit__"
MAX_ID_BYTES = 4096
# Spellings of a missing id, lower-cased.
MISSING_SPELLINGS = ("na", "nan", "null", "<na>", "nat")


def number(c: Column) -> Column:
    """A double, or null if the text is no number."""
    return c.try_cast("double")


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def clamp(x: Column, lower: float, upper: float) -> Column:
    """Null stays null (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(upper))), F.lit(float(lower))))


def middle(lower: float, upper: float) -> float:
    return lower / 2 + upper / 2


def feature(c: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Missing, NaN and infinite values become the middle of the bounds (0 without bounds); then clamped to the feature limit."""
    x = number(c)
    default = 0.0 if lower is None else middle(lower, upper)
    return clamp(F.when(is_finite(x), x).otherwise(F.lit(default)), -FEATURE_LIMIT, FEATURE_LIMIT)


def model_feature(c: Column) -> Column:
    """For gradient models: NaN and null 0, infinities at the limit, clamped, to single precision."""
    x = number(c)
    return clamp(F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x), -FEATURE_LIMIT, FEATURE_LIMIT).cast("float")


def scaled(c: Column, lower: float, upper: float) -> Column:
    """(clamped - centre) / half width; not finite: 0."""
    x, centre, half = number(c), (lower + upper) / 2, (upper - lower) / 2
    return clamp((clamp(F.when(is_finite(x), x).otherwise(F.lit(centre)), lower, upper) - centre) / half, -FEATURE_LIMIT, FEATURE_LIMIT)


def tree_feature(c: Column, lower: float, upper: float, single: bool = True) -> Column:
    """For trees: missing stays missing (null), infinities go to their bound, clamped, no negative zero."""
    x = number(c)
    out = F.when(~F.isnan(x), clamp(x, lower, upper)) + F.lit(0.0)
    return out.cast("float").cast("double") if single else out


def regression_target(c: Column, lower: float, upper: float) -> Column:
    """Not finite: the middle; else clamped."""
    x = number(c)
    return clamp(F.when(is_finite(x), x).otherwise(F.lit(middle(lower, upper))), lower, upper)


def level_code(c: Column, levels: Sequence[object]) -> Column:
    """The place of the value in the level list, from 0; 0 for any other value. Text levels compare as text, numbers as numbers."""
    value = number(c) if isinstance(levels[0], (int, float)) and not isinstance(levels[0], bool) else c.cast("string")
    out = F.lit(0)
    for k, level in reversed(list(enumerate(levels))):
        same = str(level).lower() if isinstance(level, bool) else float(level) if isinstance(level, (int, float)) else level
        out = F.when(value == F.lit(same), F.lit(k)).otherwise(out)
    return out.cast("int")


def integer_code(c: Column, classes: int) -> Column:
    """An integer from 0 to classes - 1; 0 for anything else."""
    x = number(c)
    return F.when(is_finite(x) & (F.floor(x) == x) & (x >= 0) & (x < classes), x).otherwise(F.lit(0)).cast("int")


def binary_tree_target(c: Column) -> Column:
    x = number(c)
    return F.when(is_finite(x) & (x >= 0.5), F.lit(1)).otherwise(F.lit(0))


def association_code(c: Column, levels: Sequence[object]) -> Column:
    """0 the reference level, 1 the positive level, 2 anything else, null and NaN included."""
    a, b = levels
    numeric = isinstance(a, (int, float)) and not isinstance(a, bool)
    value = number(c) if numeric else c.cast("string")
    show = lambda v: float(v) if numeric else str(v).lower() if isinstance(v, bool) else v
    return F.when(value == F.lit(show(a)), 0).when(value == F.lit(show(b)), 1).otherwise(2).cast("tinyint")


def association_again(c: Column) -> Column:
    """Codes that were written and read: 0, 1 or 2; anything else is 2."""
    x = number(c)
    return F.when(x.isin(0.0, 1.0, 2.0), x).otherwise(2).cast("tinyint")


def unit_id(c: Column) -> Column:
    """The id without blanks, tabs and line ends around it; MISSING_UNIT if empty, too long, not UTF-8 or a spelling of missing."""
    s = F.btrim(c.cast("string"), F.lit(" \t\r\n"))
    bad = s.isNull() | (s == "") | (F.octet_length(s) > MAX_ID_BYTES) | ~F.is_valid_utf8(s) | F.lower(s).isin(*MISSING_SPELLINGS)
    return F.when(bad, F.lit(MISSING_UNIT)).otherwise(s)


def ordinal_targets(level: Column, classes: int) -> Column:
    """classes - 1 indicators, the k-th whether the level is above k."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 2)), lambda k: (level > k).cast("int"))


def bin_of(x: Column, cuts: Sequence[float]) -> Column:
    """The number of cuts below x; null if x is null or NaN."""
    below = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < x))
    return F.when(x.isNotNull() & ~F.isnan(x), below)


def score_bin(p: Column, bins: int) -> Column:
    return F.least((clamp(p, 0, 1) * bins).cast("int"), F.lit(bins - 1))


def saturated(x: Column, limit: float) -> Column:
    """NaN and null 0; clamped to the limit on both sides."""
    return clamp(F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x), -limit, limit)


def complete(*columns: Column) -> Column:
    """Whether all are finite numbers; the dormant complete-case filter, which no plan turns on."""
    out = F.lit(True)
    for c in columns:
        out = out & is_finite(number(c))
    return out
