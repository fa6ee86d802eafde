"""Scalar mathematics of the record and the reading line."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def places(x: Column, n: int) -> Column:
    """x to n decimal places, halves up, by floor: the same in every engine."""
    scale = F.lit(float(10**n))
    return F.floor(x * scale + F.lit(0.5)).cast("double") / scale


def hard_label(x: Column) -> Column:
    """A 0/1 label of a soft one: nearest integer, halves to even, so 0.5 is 0."""
    return F.bround(x.cast("double")).cast("int")


def logit(p: Column, eps: float = 1e-6) -> Column:
    p = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(p) - F.log1p(-p)


def inverse_logit(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    """By the series x + x^3 / 3 + x^5 / 15 + ... of positive terms times the density, over whole columns."""
    x = np.clip(z.to_numpy(float), -9.0, 9.0)
    term = total = x.copy()
    for k in range(1, 140):
        term = term * x * x / (2 * k + 1)
        total = total + term
    return pd.Series(np.clip(0.5 + total * np.exp(-x * x / 2) / math.sqrt(2 * math.pi), 0.0, 1.0))


def predictive_z(mean: Column, variance: Column) -> Column:
    """The argument of the probit predictive probability; it orders as the probability does."""
    return mean / F.sqrt(F.lit(1.0) + variance)


def evidence(square_norm: Column, variance: Column, lam: float) -> Column:
    """How many past observations lie along a direction; 0 before any."""
    return F.greatest(F.lit(0.0), square_norm / F.lit(lam) / F.greatest(variance, F.lit(1e-12)) - F.lit(1.0))


def read_value(trust: Column, own: Column, rho: Column, delta: Column) -> Column:
    """Expected success of reading the sources at this trust."""
    return trust * rho + (F.lit(1.0) - trust) * (own - delta)


def switch_point(own: Column, rho: Column, delta: Column) -> Column:
    """The trust at which reading and the own answer are worth the same; null when the lines are parallel."""
    return F.try_divide(delta, rho + delta - own)


def reads_when(own: Column, rho: Column, delta: Column) -> Column:
    low, high = -delta, rho - own
    at = F.format_string("%.2f", switch_point(own, rho, delta))
    return (
        F.when((low >= 0) & (high >= 0), "always").when((low < 0) & (high < 0), "never").when(high >= 0, F.concat(F.lit("T >= "), at)).otherwise(F.concat(F.lit("T <= "), at))
    )


def tilt(p: Column, top: Column, low: Column, gamma: float, form: str = "logratio", flat: float = 0.1) -> Column:
    """Additive score of a source against its event's best (0 for it, and for all of a flat event)."""
    if form == "logratio":
        value = F.lit(gamma) * F.log(F.greatest(p, F.lit(1e-3)) / F.greatest(top, F.lit(1e-3)))
    elif form == "logodds":
        cut = lambda x: F.least(F.greatest(x, F.lit(1e-3)), F.lit(1 - 1e-3))
        odds = lambda x: F.log(cut(x) / (F.lit(1.0) - cut(x)))
        value = F.lit(gamma) * (odds(p) - odds(top))
    else:
        raise ValueError(f"unknown form {form!r}")
    return F.when(F.lit(gamma == 0) | (top - low <= flat), 0.0).otherwise(value)
