"""Distribution functions (P-40) as vectorised pandas UDFs.

Spark has no t, F or chi-square distribution. These run on already aggregated rows
(one per statistic): continued fractions over whole Arrow batches, no row loop.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

def _each(fn, x):
    x = np.asarray(x, dtype=float)
    return np.fromiter(map(fn, x.ravel()), float, x.size).reshape(x.shape)


def _lgamma(x):
    return _each(math.lgamma, x)


def _erfc(x):
    return _each(math.erfc, x)


STEPS = 20_000


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function (modified Lentz); NaN where it has not settled."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    settled = np.zeros(np.shape(x), bool)
    for m in range(1, STEPS):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
        settled = np.abs(c * d - 1.0) < 1e-14
        if np.all(settled):
            break
    return np.where(settled, h, np.nan)


def betainc(a, b, x):
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    a, b, x = np.broadcast_arrays(a, b, x)
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    aa, bb, xx = a[ok], b[ok], x[ok]
    swap = xx > (aa + 1) / (aa + bb + 2)
    p, q, y = np.where(swap, bb, aa), np.where(swap, aa, bb), np.where(swap, 1 - xx, xx)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) if y.size else y
    edge = (y <= 0) | (y >= 1)
    v = np.where(edge, np.where(y <= 0, 0.0, 1.0), np.where(edge, 0.0, front) * _beta_fraction(p, q, np.where(edge, 0.5, y)) / p) if y.size else y
    out[ok] = np.where(swap, 1 - v, v)
    return out


LARGE_SHAPE = 1e5


def _gammaincc_large(a, x):
    """Q(a, x) for large ``a``: the uniform expansion around the normal, with its first correction."""
    mu = (x - a) / a
    with np.errstate(divide="ignore", invalid="ignore"):
        eta = np.sign(mu) * np.sqrt(2.0 * np.maximum(mu - np.log1p(mu), 0.0))
        c0 = np.where(np.abs(mu) < 1e-3, -1.0 / 3 + eta / 12 - 2 * eta**2 / 135, 1.0 / mu - 1.0 / eta)
        rest = np.exp(-0.5 * a * eta**2) / np.sqrt(2.0 * np.pi * a) * c0
    return np.where(x <= 0, 1.0, np.clip(0.5 * _erfc(eta * np.sqrt(a / 2.0)) + np.where(np.isfinite(rest), rest, 0.0), 0.0, 1.0))


def gammaincc(a, x):
    """Regularised upper incomplete gamma function Q(a, x); NaN where no expansion settles."""
    a, x = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(x, dtype=float))
    out = np.full(x.shape, np.nan)
    large = (a > LARGE_SHAPE) & (x >= 0)
    if large.any():
        out[large] = _gammaincc_large(a[large], x[large])
    ok = (a > 0) & (x >= 0) & ~large
    a, x = a[ok], x[ok]
    if not x.size:
        return out
    low = x < a + 1
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.where(x > 0, np.exp(-x + a * np.log(x) - _lgamma(a)), 0.0)
    term = np.where(low, 1.0 / a, 0.0)
    total = term.copy()
    for n in range(1, STEPS):
        term = term * x / (a + n)
        total = total + term
        summed = term <= 1e-16 * total
        if np.all(summed):
            break
    b = x + 1.0 - a
    c = np.full(x.shape, 1e300)
    d = 1.0 / np.where(b == 0, 1e-300, b)
    h = d.copy()
    settled = low
    for i in range(1, STEPS):
        an = -i * (i - a)
        b = b + 2.0
        d = an * d + b
        d = 1.0 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + an / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        h = h * d * c
        settled = low | (np.abs(d * c - 1.0) < 1e-14)
        if np.all(settled):
            break
    out[ok] = np.where(low, np.where(summed, 1.0 - front * total, np.nan), np.where(settled, front * h, np.nan))
    return out


def t_sf2(t, df):
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return np.where(np.isinf(t), 0.0, betainc(df / 2.0, 0.5, df / (df + np.where(np.isinf(t), 0.0, t) ** 2)))


def f_sf(f, d1, d2):
    f = np.asarray(f, dtype=float)
    return np.where(f <= 0, 1.0, betainc(np.asarray(d2) / 2.0, np.asarray(d1) / 2.0, d2 / (d2 + d1 * np.maximum(f, 0))))


def norm_cdf(z):
    return 0.5 * _erfc(-np.asarray(z, dtype=float) / math.sqrt(2.0))


def _bisect(cdf, p, lo, hi, steps=200):
    lo, hi = np.full(p.shape, lo), np.full(p.shape, hi)
    for _ in range(steps):
        mid = (lo + hi) / 2
        up = cdf(mid) < p
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


def norm_ppf(p):
    p = np.asarray(p, dtype=float)
    return np.where((p > 0) & (p < 1), _bisect(norm_cdf, p, -40.0, 40.0), np.where(p <= 0, -np.inf, np.inf))


def t_ppf(p, df):
    p, df = np.asarray(p, dtype=float), np.asarray(df, dtype=float)
    cdf = lambda t: np.where(t >= 0, 1 - t_sf2(t, df) / 2, t_sf2(t, df) / 2)
    return _bisect(cdf, p, -1e6, 1e6)


def _series(v, like) -> pd.Series:
    return pd.Series(v, index=like.index).where(lambda s: s.notna(), None)


@F.pandas_udf(DoubleType())
def _t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _series(t_sf2(t, df), t)


@F.pandas_udf(DoubleType())
def _f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _series(f_sf(f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)), f)


@F.pandas_udf(DoubleType())
def _chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _series(gammaincc(df.to_numpy(float) / 2.0, x.to_numpy(float) / 2.0), x)


@F.pandas_udf(DoubleType())
def _norm_cdf(z: pd.Series) -> pd.Series:
    return _series(norm_cdf(z.to_numpy(float)), z)


@F.pandas_udf(DoubleType())
def _norm_ppf(p: pd.Series) -> pd.Series:
    return _series(norm_ppf(p.to_numpy(float)), p)


@F.pandas_udf(DoubleType())
def _t_ppf(p: pd.Series, df: pd.Series) -> pd.Series:
    return _series(t_ppf(p.to_numpy(float), df.to_numpy(float)), p)


def _d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def t_p_value(t, df) -> Column:
    """Two-sided p of a t statistic."""
    return _t_p(_d(t), _d(df))


def f_p_value(f, d1, d2) -> Column:
    return _f_p(_d(f), _d(d1), _d(d2))


def chi2_p_value(x, df) -> Column:
    return _chi2_p(_d(x), _d(df))


def normal_cdf(z) -> Column:
    return _norm_cdf(_d(z))


def normal_quantile(p) -> Column:
    return _norm_ppf(_d(p))


def t_quantile(p, df) -> Column:
    return _t_ppf(_d(p), _d(df))


def correlation_p(r: Column, n: Column) -> Column:
    """P-04: two-sided p of a correlation with n pairs."""
    ok = (n > 2) & (F.abs(r) < 1)
    t = F.when(ok, r * F.sqrt((n - 2) / (1 - r * r)))
    p = t_p_value(t, F.when(ok, n - 2))
    return F.when((n > 2) & (F.abs(r) >= 1), 0.0).otherwise(p)
