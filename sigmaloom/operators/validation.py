"""Cross-validation of tree ensembles in shared scans, and the release of what they predict out of fold.

A unit's fold follows from its id and the site's key. All folds' models are trained together: a scan adds up statistics by fold, so the
number of jobs does not grow with the number of folds. Every row is scored once, by the model that has not seen its unit, and the scores
of all folds are one vector of sufficient statistics. Of the budget, four fifths are dealt over the folds' models and one fifth goes to
that vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean, keyed
from ..sources import store
from . import metrics, privacy, statistics, trees

#: Engines whose folds are grown in shared scans; the others are trained fold by fold.
SHARED = ("extra_trees", "random_forest")


def with_folds(df: DataFrame, schema: trees.TreeSchema, target: str, unit: str, key: bytes, folds: int, name: str = "fold") -> DataFrame:
    """A row for each unit, as `trees.units_of` pools it, with its fold from 1."""
    units = trees.units_of(df.withColumn(unit, clean.unit_id(F.col(unit))), schema, target, unit)
    return units.withColumn(name, keyed.fold(key, F.col(unit), folds))


def train_folds(engine: str, df: DataFrame, schema: trees.TreeSchema, target: str, fold: str, folds: int, key: bytes = b"", epsilon: float | None = None, delta: float | None = None, secret: bytes = b"", **parameters: float) -> list[dict]:
    """The model of each fold, 1 to folds, trained on the rows of all other folds. fold: a column of df; other values than 1 to folds raise
    ValueError. With epsilon and delta each model is a release of that budget: all together have `folds` times it."""
    if not 2 <= folds <= 10:
        raise ValueError("2 to 10 folds")
    if df.where(F.col(fold).isNull() | ~F.col(fold).between(1, folds)).limit(1).count():
        raise ValueError("a row has no fold")
    noise, plan = trees.no_noise, {}
    if epsilon is not None:
        noise = trees.Released(engine, schema, epsilon, delta, secret, parameters)
        plan = {"release": {"epsilon": epsilon, "delta": delta, **{k: v if isinstance(v, int) else float(v) for k, v in noise.plan.items()}}}
    if engine not in SHARED:
        of = lambda k: df.where(F.col(fold) != k)
        return [trees.boost(of(k), schema, target, trees.Boosting(trees.ENGINES[engine], **parameters), _of_fold(noise, k)) | plan for k in range(1, folds + 1)]
    rows = trees.binned_rows(df, schema, target, F.col(fold))
    if engine == "extra_trees":
        found = trees.extra_trees_models(rows, schema, noise=noise, folds=folds, **parameters)
    else:
        found = trees.random_forest_models(rows, schema, key=key, noise=noise, folds=folds, **parameters)
    return [m | plan for m in found]


class _of_fold:
    """The noise of one fold's model: its labels name the fold."""

    def __init__(self, noise: trees.Noise, fold: int) -> None:
        self.noise, self.fold = noise, fold

    def __call__(self, vector: np.ndarray, label: str) -> np.ndarray:
        return self.noise(vector, f"fold {self.fold} {label}")

    def integers(self, vector: np.ndarray, label: str) -> np.ndarray:
        return self.noise.integers(vector, f"fold {self.fold} {label}")


def out_of_fold(df: DataFrame, models: list[dict], schema: trees.TreeSchema, fold: str, keep: list[str]) -> DataFrame:
    """keep and prediction: each row's by the model of its own fold, in one scan."""
    import pyarrow as pa

    rows = df.select(*keep, F.array(*[F.coalesce(trees._bins(schema, k), F.lit(-1)).cast("int") for k in range(len(schema.features))]).alias("_b"), F.col(fold).cast("int").alias("_fold"))
    known = df.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            b = np.array(batch.column("_b").flatten()).reshape(batch.num_rows, -1)
            of, out = batch.column("_fold").to_numpy(), np.full(batch.num_rows, np.nan)
            for k, model in enumerate(known.value, 1):
                if (of == k).any():
                    out[of == k] = trees._walk(model, b[of == k])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out)], names=[*keep, "prediction"])

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes)
    return rows.mapInArrow(run, f"{fields}, prediction double")


def scores_vector(scored: DataFrame, schema: trees.TreeSchema, target: Column, prediction: Column, bins: int = 64) -> DataFrame:
    """coord, value: the sufficient statistics of all predictions, by which `metrics` derives what is reported."""
    if schema.task == "binary":
        return statistics.score_histogram(scored, [], target, prediction, bins)
    return statistics.regression_sums(scored, [], target, prediction, schema.lower, schema.upper)


def cross_validated(engine: str, df: DataFrame, schema: trees.TreeSchema, target: str, unit: str, key: bytes, folds: int, epsilon: float | None = None, delta: float | None = None, secret: bytes = b"", bins: int = 64, **parameters: float) -> dict:
    """Units are pooled and dealt to folds, a model is trained for each fold, every unit is scored by the model of its own fold, and the
    statistics of all scores are released once. Returns the metrics of that vector, and sigma of its noise (0 without a budget); neither
    models nor figures of a fold leave, as a difference of two of them would tell of one."""
    budget = privacy.fold_budget(epsilon, delta, folds) if epsilon is not None else None
    rows = store.staged(with_folds(df, schema, target, unit, key, folds, "_fold"), "folds")  # read for the models and for their scores
    models = train_folds(engine, rows, schema, target, "_fold", folds, key, *(budget["fold"] if budget else (None, None)), secret=secret, **parameters)
    scored = out_of_fold(rows, models, schema, "_fold", [target])
    vector = np.zeros(2 * bins if schema.task == "binary" else 5)
    for row in scores_vector(scored, schema, F.col(target), F.col("prediction"), bins).collect():
        vector[row["coord"]] = row["value"]
    sigma = 0.0
    if budget:
        sigma = privacy.gaussian_sigma(*budget["out_of_fold"], privacy.sensitivity(schema.task))
        layout = {"engine": engine, "schema": schema.sha256(), "folds": folds, "bins": bins, "parameters": {k: repr(v) for k, v in sorted(parameters.items())}}
        vector = privacy.release(vector, sigma, secret, "trees/out of fold", layout)
    found = metrics.binary(vector, bins) if schema.task == "binary" else metrics.regression(vector, schema.lower, schema.upper)
    return metrics.guarded({"metrics": found, "sigma": sigma})
