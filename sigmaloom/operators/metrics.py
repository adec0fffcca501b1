"""Metrics of a released vector: pure functions. A vector is a fixed public layout of at most a few thousand coordinates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def association_measures(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One row for keys of (coord, value): odds ratio (by logarithms; null unless all four cells are positive), prevalences of
    both exposure groups, their difference and ratio. Cells are projected to 0 or more; unknown codes take no part."""
    cell = lambda k: F.sum(F.when(F.col("coord") == k, F.greatest(F.col("value").cast("double"), F.lit(0.0))))
    t = cells.groupBy(*keys).agg(*[cell(k).alias(f"c{k}") for k in (0, 1, 3, 4)])
    a, b, c, d = (F.col(f"c{k}") for k in (4, 3, 1, 0))  # exposed with and without, unexposed with and without
    exposed, unexposed = ratio(a, a + b), ratio(c, c + d)
    odds = F.when((a > 0) & (b > 0) & (c > 0) & (d > 0), F.exp(F.ln(a) + F.ln(d) - F.ln(b) - F.ln(c)))
    return t.select(*keys, odds.alias("odds_ratio"), unexposed.alias("prevalence_unexposed"), exposed.alias("prevalence_exposed"), (exposed - unexposed).alias("prevalence_difference"), ratio(exposed, unexposed).alias("prevalence_ratio"))


def roc_curve(histogram: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """keys, bin, tpr, fpr: cumulative from the highest bin down, of a score histogram in long form."""
    h = histogram.groupBy(*keys, (F.col("coord") % bins).alias("bin")).agg(
        F.sum(F.when(F.col("coord") >= bins, F.col("value")).otherwise(0)).cast("double").alias("pos"), F.sum(F.when(F.col("coord") < bins, F.col("value")).otherwise(0)).cast("double").alias("neg")
    )
    down, whole = Window.partitionBy(*keys).orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    share = lambda c: F.coalesce(ratio(F.sum(c).over(down), F.sum(c).over(whole)), F.lit(0.0))
    return h.select(*keys, "bin", "pos", "neg", share("pos").alias("tpr"), share("neg").alias("fpr"))


def roc_auc(histogram: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """keys, roc_auc: the trapezoid below the curve; null if a class is empty."""
    curve = roc_curve(histogram, keys, bins)
    w = Window.partitionBy(*keys).orderBy(F.col("bin").desc())
    step = curve.select(*keys, "pos", "neg", ((F.col("fpr") - F.lag("fpr", 1, 0.0).over(w)) * (F.col("tpr") + F.lag("tpr", 1, 0.0).over(w)) / 2).alias("area"))
    return step.groupBy(*keys).agg(F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), F.sum("area")).alias("roc_auc"))


def _ratio(a: float, b: float) -> float | None:
    return float(a) / float(b) if b > 0 and math.isfinite(a) and math.isfinite(b) else None


def _unit(x: float | None) -> float | None:
    return None if x is None else min(1.0, max(0.0, x))


def _share(a: np.ndarray, b: np.ndarray, empty: float = 0.0) -> np.ndarray:
    return np.clip(np.divide(a, b, out=np.full(np.shape(a), empty), where=b > 0), 0, 1)


def binary(vector: np.ndarray, bins: int) -> dict:
    """Metrics and curves of a 2 x bins histogram; a bin is positive if its centre is 0.5 or more."""
    neg, pos = np.clip(np.asarray(vector, float).reshape(2, bins), 0, None)
    centre = (np.arange(bins) + 0.5) / bins
    high = centre >= 0.5
    tn, fp, fn, tp = neg[~high].sum(), neg[high].sum(), pos[~high].sum(), pos[high].sum()
    n, all_pos, all_neg = neg.sum() + pos.sum(), pos.sum(), neg.sum()
    recall, specificity, precision = _unit(_ratio(tp, tp + fn)), _unit(_ratio(tn, tn + fp)), _unit(_ratio(tp, tp + fp))
    tp_down, fp_down = pos[::-1].cumsum(), neg[::-1].cumsum()
    tpr, fpr = (np.r_[0.0, np.clip(c / t, 0, 1) if t > 0 else c, 1.0] for c, t in ((tp_down, all_pos), (fp_down, all_neg)))
    pr_recall, pr_precision = np.r_[0.0, _share(tp_down, np.full(bins, all_pos))], np.r_[1.0, _share(tp_down, tp_down + fp_down, 1.0)]
    weight, odds = pos + neg, centre / (1 - centre)
    observed, prevalence = _share(pos, weight), _ratio(all_pos, n)
    benefit = (pos[::-1].cumsum()[::-1] - neg[::-1].cumsum()[::-1] * odds) / n if n > 0 else np.zeros(bins)
    return {
        "n": float(n), "accuracy": _unit(_ratio(tp + tn, n)) if n > 0 else 0.0, "sensitivity": recall, "specificity": specificity, "precision": precision,
        "negative_predictive_value": _unit(_ratio(tn, tn + fn)),
        "f1": None if not precision and not recall or precision is None or recall is None else _unit(2 * precision * recall / (precision + recall)),
        "balanced_accuracy": None if recall is None or specificity is None else (recall + specificity) / 2,
        "roc_auc": _unit(float(np.trapezoid(tpr, fpr))) if all_pos > 0 and all_neg > 0 else None,
        "pr_auc": _unit(float(np.trapezoid(pr_precision, pr_recall))) if all_pos > 0 else None,
        "brier": _unit(_ratio(float((pos * (1 - centre) ** 2 + neg * centre**2).sum()), n)),
        "expected_calibration_error": _unit(_ratio(float((weight * np.abs(observed - centre)).sum()), n)),
        "roc": {"fpr": fpr.tolist(), "tpr": tpr.tolist()}, "precision_recall": {"recall": pr_recall.tolist(), "precision": pr_precision.tolist()},
        "calibration": {"predicted": centre.tolist(), "observed": observed.tolist(), "weight": weight.tolist()},
        "decision_curve": {"threshold": centre.tolist(), "net_benefit": benefit.tolist(), "treat_all": (prevalence - (1 - prevalence) * odds if prevalence is not None else np.zeros(bins)).tolist(), "treat_none": [0.0] * bins},
    }


def _mean(x: list) -> float | None:
    some = [v for v in x if v is not None]
    return _unit(float(np.mean(some))) if some else None


def multiclass(vector: np.ndarray, classes: int, bins: int, ordinal: bool = False) -> dict:
    x = np.asarray(vector, float)
    cm = np.clip(x[: classes * classes].reshape(classes, classes), 0, None)
    n, hit = cm.sum(), np.diag(cm)
    recall, precision = _share(hit, cm.sum(1)), _share(hit, cm.sum(0))
    each = [binary(h, bins)["roc_auc"] for h in x[classes * classes :].reshape(classes, 2 * bins)]
    out = {
        "n": float(n), "accuracy": _unit(_ratio(hit.sum(), n)), "balanced_accuracy": float(recall.mean()), "macro_precision": float(precision.mean()), "macro_recall": float(recall.mean()),
        "macro_f1": float(_share(2 * precision * recall, precision + recall).mean()), "macro_roc_auc": _mean(each), "confusion_matrix": cm.tolist(),
    }
    if ordinal:
        away = np.abs(np.subtract.outer(np.arange(classes), np.arange(classes)))
        mae = _ratio(float((cm * away).sum()), n)
        out["ordinal_mae"] = None if mae is None else min(classes - 1.0, mae)
    return out


def multilabel(vector: np.ndarray, labels: int, bins: int) -> dict:
    each = [binary(h, bins) for h in np.asarray(vector, float).reshape(labels, 2 * bins)]
    return {"labels": each, "macro_roc_auc": _mean([m["roc_auc"] for m in each]), "macro_f1": _mean([m["f1"] for m in each])}


def regression(vector: np.ndarray, lower: float, upper: float) -> dict:
    """mae, mse, rmse, r_squared of five sums; of six also the mean deviance of a count task."""
    x = np.asarray(vector, float)
    n, width = max(float(x[0]), 0.0), upper - lower
    error, square, y, y2, *rest = np.clip(x[1:], 0, n)
    spread = y2 - y * y / n if n > 0 else 0.0
    mse = square / n if n > 0 else 0.0
    out = {"n": n, "mae": error / n * width if n > 0 else 0.0, "mse": mse * width**2, "rmse": math.sqrt(mse) * width, "r_squared": None if spread <= 0 else min(1.0, 1 - square / spread)}
    return out | ({"mean_poisson_deviance_normalized": _unit(_ratio(rest[0], n))} if rest else {})


#: Names that no pooled result may carry.
PER_SITE_NAMES = frozenset(("per_node", "per_site", "predictions", "oof_predictions", "fold", "per_fold", "fold_metrics", "models"))


def guarded(result: object) -> object:
    """The result with values that are not finite as None; raises ValueError on a name that tells of one site or fold."""
    if isinstance(result, dict):
        if PER_SITE_NAMES & set(result):
            raise ValueError("the result names a single site or fold")
        return {k: guarded(v) for k, v in result.items()}
    if isinstance(result, (list, tuple)):
        return [guarded(v) for v in result]
    return None if isinstance(result, float) and not math.isfinite(result) else result
