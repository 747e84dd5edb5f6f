"""p-values of test results.

The regularised incomplete beta function by its continued fraction, computed over
Arrow batches: as one expression it is larger than the virtual machine compiles.  It is
meant for result tables with one row per test, never for input rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHIFT = 16


def _stirling_tail(z: np.ndarray) -> np.ndarray:
    """Correction of Stirling's formula, for z >= 16."""
    square = z * z
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / square) / square) / square) / z


def _stirling(z: np.ndarray) -> np.ndarray:
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + _stirling_tail(z)


def log_gamma(z: np.ndarray) -> np.ndarray:
    """ln Gamma(z) for z > 0."""
    raised = np.ones_like(z)
    for step in range(_SHIFT):
        raised = raised * (z + step)
    return np.where(z >= _SHIFT, _stirling(z), _stirling(z + _SHIFT) - np.log(raised))


def log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln B(a, b) without cancelling two huge log-gammas when one side is large."""
    big, small, total = np.maximum(a, b), np.minimum(a, b), a + b
    growth = (big - 0.5) * np.log1p(small / big) + small * np.log(total) - small + _stirling_tail(total) - _stirling_tail(big)
    return np.where(big >= _SHIFT, log_gamma(small) - growth, log_gamma(a) + log_gamma(b) - log_gamma(total))


def _log(x: np.ndarray, complement: np.ndarray) -> np.ndarray:
    return np.where(x > 0.5, np.log1p(-complement), np.log(x))


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """1 / (1 + d1 / (1 + d2 / (1 + ...))), folded from the innermost term outwards.

    NaN where an argument is or a term would be divided by zero.  Rows with more steps come first,
    so a round takes those that have begun.
    """
    steps = np.nan_to_num(60 + np.ceil(1.5 * np.sqrt(np.minimum(a, b))))
    order = np.argsort(-steps, kind="stable")
    steps, a, b, x = steps[order], a[order], b[order], x[order]
    f = np.ones(len(a))
    for m in range(int(steps.max(initial=0)), 0, -1):
        begun = slice(int(np.searchsorted(-steps, -m, side="right")))
        p, q, z, g = a[begun], b[begun], x[begun], f[begun]
        top = p + 2.0 * m
        inner = 1 + (-(p + m) * (p + q + m) * z / (top * (top + 1))) / np.where(g == 0, np.nan, g)
        f[begun] = 1 + (m * (q - m) * z / ((top - 1) * top)) / np.where(inner == 0, np.nan, inner)
    out = np.empty(len(f))
    out[order] = 1 / (1 - (a + b) * x / (a + 1) / np.where(f == 0, np.nan, f))
    return out


@F.pandas_udf(T.DoubleType())
def _beta_tail(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    """I_x(a, b), with ``y`` = 1 - x; null where an argument is null."""
    a, b, x, y = (c.to_numpy(np.float64, na_value=np.nan) for c in (a, b, x, y))
    with np.errstate(all="ignore"):
        # The fraction converges fast on one side of the mean only.
        swap = x > (a + 1) / (a + b + 2)
        a, b, x, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, y, x), np.where(swap, x, y)
        front = np.exp(a * _log(x, y) + b * _log(y, x) - log_beta(a, b)) / a
        tail = np.select(
            [np.isnan(a + b + x + y), x <= 0, b == 1, a == 1],
            [np.nan, 0.0, np.exp(a * _log(x, y)), 1 - np.exp(b * _log(y, x))], front * _fraction(a, b, x))
        return pd.Series(np.clip(np.where(swap, 1 - tail, tail), 0.0, 1.0))


def with_beta_tail(df: DataFrame, name: str, a: str, b: str, x: str, y: str) -> DataFrame:
    """Add ``name`` = I_x(a, b), with ``y`` = 1 - x given separately for accuracy.

    All arguments are SQL texts; the result is null where any of them is null.
    """
    return df.withColumn(name, _beta_tail(*[F.expr(f"cast({given} as double)") for given in (a, b, x, y)]))


def with_pearson_p(df: DataFrame, name: str, r: str, n: str) -> DataFrame:
    """Add the two-sided p-value of the Pearson correlation in column ``r`` over ``n`` pairs."""
    usable = f"{n} > 2 and abs({r}) < 1"
    tail = with_beta_tail(
        df, "_p",
        f"case when {usable} then {n} / 2D - 1D end", f"case when {usable} then 0.5D end",
        f"case when {usable} then 1D - {r} * {r} end", f"case when {usable} then {r} * {r} end",
    )
    # Two points always lie on a line, so they carry no evidence at all.
    return tail.withColumn(name, F.expr(
        f"case when {r} is null then null when {n} = 2 then 1D when abs({r}) >= 1 then 0D else _p end"
    )).drop("_p")


def with_f_tail(df: DataFrame, name: str, f: str, d1: str, d2: str) -> DataFrame:
    """Add the upper tail probability of the F statistic in column ``f``."""
    infinite = f"{f} = double('Infinity')"
    usable = f"not ({infinite}) and {d1} > 0 and {d2} > 0"
    tail = with_beta_tail(
        df, "_p",
        f"case when {usable} then {d2} / 2D end", f"case when {usable} then {d1} / 2D end",
        f"case when {usable} then {d2} / ({d2} + {d1} * {f}) end",
        f"case when {usable} then {d1} * {f} / ({d2} + {d1} * {f}) end",
    )
    return tail.withColumn(name, F.expr(f"case when {infinite} then 0D else _p end")).drop("_p")
