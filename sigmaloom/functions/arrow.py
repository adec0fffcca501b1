"""Functions that Spark has no expression for, as Arrow-batched pandas functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_erf, _lgamma = np.vectorize(math.erf, otypes=[float]), np.vectorize(math.lgamma, otypes=[float])


def gelu(x: Column) -> Column:
    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        a = v.to_numpy(float)
        return pd.Series(a * 0.5 * (1 + _erf(a / math.sqrt(2))))

    return run(x.cast("double"))


def lgamma(x: Column) -> Column:
    """The logarithm of the gamma function; null and values up to 0 are null."""

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        a = v.to_numpy(float)
        out = np.full(len(a), np.nan)
        good = a > 0
        out[good] = _lgamma(a[good]) if good.any() else 0.0
        return pd.Series(out)

    y = run(x.cast("double"))
    return F.when(~F.isnan(y), y)


def negbin_nll(z: Column, y: Column, r: float) -> Column:
    """Negative log likelihood of counts with a log link and dispersion r."""
    from .models import log_add_exp

    log_r = F.lit(math.log(r))
    both = log_add_exp(z, log_r)
    return -(lgamma(y + r) - math.lgamma(r) - lgamma(y + 1) + r * (log_r - both) + y * (z - both))
