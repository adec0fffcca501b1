"""From a raw table to a supervised frame: one projection, every row kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean, keyed
from ..operators import units
from .contract import Contract


def target_column(contract: Contract) -> Column:
    """The target made total; of a multilabel task an array of 0 and 1, one for each target."""
    if contract.task == "multilabel":
        one = lambda name: clean.level_code(F.col(name), contract.levels) if contract.levels else clean.integer_code(F.col(name), 2)
        return F.array(*[one(name) for name in contract.targets])
    c = F.col(contract.target)
    if contract.task in ("regression", "count"):
        return clean.regression_target(c, *contract.target_bounds)
    if contract.levels and not isinstance(contract.levels[0], int):
        return clean.level_code(c, contract.levels)
    return clean.integer_code(c, max(2, len(contract.levels)))


def prepare(df: DataFrame, contract: Contract, row_key: str | None = None) -> DataFrame:
    """unit, y, and the features under their names. The projection is declared, so the scan reads these columns only."""
    missing = [c for c in contract.columns if c not in df.columns]
    if missing or not contract.subject and not row_key:
        raise ValueError(f"columns are missing: {missing}" if missing else "row units need a declared key")
    unit = clean.unit_id(F.col(contract.subject)) if contract.subject else F.col(row_key).cast("string")
    features = [clean.feature(F.col(f), *contract.bounds.get(f, (None, None))).alias(f) for f in contract.model_features]
    return df.select(unit.alias("unit"), target_column(contract).alias("y"), *features)


def pooled(frame: DataFrame, contract: Contract) -> DataFrame:
    """One row for each unit."""
    features = list(contract.model_features)
    if contract.task in ("regression", "count"):
        return units.pooled_means(frame, "unit", features, "y")
    if contract.task == "multilabel":
        flat = frame.withColumns({f"_y{k}": F.get("y", F.lit(k)) for k in range(len(contract.targets))})
        names = [f"_y{k}" for k in range(len(contract.targets))]
        labels = units.pooled_multilabel(flat, "unit", names).select("unit", F.array(*names).alias("y"))
        return units.pooled_means(frame, "unit", features).join(labels, "unit")
    return units.pooled_means(frame, "unit", features).join(units.pooled_mode(frame, "unit", "y"), "unit")


def sides(frame: DataFrame, contract: Contract, key: bytes) -> DataFrame:
    """The frame with is_test (holdout) or fold."""
    r = contract.resampling
    kind = "subject" if contract.subject else "row"
    if r.method == "holdout":
        return frame.withColumn("is_test", keyed.holdout(key, F.col("unit"), r.test_numerator, kind=kind))
    if r.method == "folds":
        return frame.withColumn("fold", keyed.fold(key, F.col("unit"), r.folds, kind=kind))
    return frame


def handle(df: DataFrame, contract: Contract, row_key: str | None = None) -> dict[str, object]:
    """What a prepared dataset says of itself: its contract's digest and public counts."""
    n = units.count_units(prepare(df, contract, row_key), "unit").first()
    return {"contract": contract.sha256(), "n_rows": n["n_rows"], "n_units": n["n_units"], "dropped": 0}


def capabilities() -> dict[str, list[str]]:
    from ..operators.trees import ENGINES

    return {"engines": sorted(ENGINES), "tasks": ["association", "binary", "multiclass", "ordinal", "multilabel", "regression", "count"], "resampling": ["holdout", "folds"], "units": ["row", "subject"]}


def image_samples(samples: DataFrame, labels: DataFrame, manifest: DataFrame, files: DataFrame, contract: Contract) -> DataFrame:
    """The samples of an image bundle: each with its label by left join, made total, and its resolved path. No sample is lost."""
    from ..operators import joins

    labelled = joins.label_join(samples.drop(contract.target), labels, "sample_id", [contract.target])
    return joins.resolved_paths(labelled, manifest, files).withColumn("y", target_column(contract))
