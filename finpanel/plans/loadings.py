"""Rolling factor betas from running products. The panel is shuffled by security; inside a task numpy solves the small systems.

A window's normal equations hold sums of products over its rows: 36 of the factors and the constant with each other, 8 with the return (for seven
factors). They are taken from sums that run forward and backward through blocks as long as the window: a window is the end of one block and the start of
the next, so every row is multiplied once, whatever the window, and no large totals are subtracted from each other.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finpanel.plans.factors import FACTORS, characteristics, factor_columns

BLOCK = 256  # windows solved at once where rows are needed
NOISE = 1e-8  # least variance of a factor in a window, as a share of its mean square, that is not taken for rounding
SAFE = 1e-6  # least share of a factor's variance that the factors before it must leave, for normal equations to be solved as they stand

# Tasks get these functions by value: executors need numpy and pandas, but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _windows(x: np.ndarray, window: int) -> np.ndarray:
    """All windows of consecutive rows (windows x rows x factors), gaps filled forward, then backward.

    Filling the whole series forward gives the right values for every window whose first row is complete;
    only the others, where an older value would leak in, are filled on their own.
    """
    have = ~np.isnan(x)
    rows = np.arange(len(x))[:, None]
    last = np.maximum.accumulate(np.where(have, rows, 0), axis=0)
    view = np.lib.stride_tricks.sliding_window_view
    filled = view(np.take_along_axis(x, last, axis=0), window, axis=0).transpose(0, 2, 1)
    open_start = ~have[: len(filled)].all(axis=1)
    if open_start.any():
        filled = filled.copy()
        raw = view(x, window, axis=0).transpose(0, 2, 1)[open_start]
        seen = ~np.isnan(raw)
        at = np.maximum.accumulate(np.where(seen, np.arange(window)[None, :, None], -1), axis=1)
        at = np.where(at < 0, seen.argmax(axis=1)[:, None, :], at)
        filled[open_start] = np.take_along_axis(raw, at, axis=1)
    return filled


def _solve(x: np.ndarray, y: np.ndarray, min_obs: int) -> np.ndarray:
    """Slopes of the regression with intercept in every window; NaN rows where it is not defined."""
    slopes = np.full((x.shape[0], x.shape[2]), np.nan)
    use = ~np.isnan(y)
    run = (use.sum(axis=1) >= min_obs) & ~np.isnan(x).any(axis=(1, 2))
    if not run.any():
        return slopes
    if not run.all():
        x, y, use = x[run], y[run], use[run]
    if use.all():
        xc = x - x.mean(axis=1, keepdims=True)
        yc = y - y.mean(axis=1, keepdims=True)
    else:
        weight, y = use.astype(float), np.where(use, y, 0.0)
        count = weight.sum(axis=1)
        xc = (x - np.einsum("bwf,bw->bf", x, weight)[:, None, :] / count[:, None, None]) * weight[:, :, None]
        yc = (y - (y.sum(axis=1) / count)[:, None]) * weight
    normal = np.matmul(xc.transpose(0, 2, 1), xc)
    right = np.matmul(yc[:, None, :], xc)[:, 0, :]
    size, axes = np.linalg.eigh(normal)
    safe = size[:, 0] > size[:, -1] * 1e-10
    found = np.einsum("bij,bj->bi", axes, np.einsum("bji,bj->bi", axes, right) / np.where(size > 0, size, 1.0))
    for i in np.flatnonzero(~safe):  # near-singular windows: minimum-norm least squares
        keep = use[i]
        design = np.column_stack([np.ones(keep.sum()), x[i][keep]])
        found[i] = np.linalg.lstsq(design, y[i][keep], rcond=None)[0][1:]
    slopes[run] = found
    return slopes


def _window_sums(rows: np.ndarray, window: int) -> np.ndarray:
    """Sums over all windows of ``window`` consecutive rows, one per start."""
    blocks = -(-len(rows) // window) + 1
    padded = np.zeros((blocks * window, rows.shape[1]))
    padded[: len(rows)] = rows
    cut = padded.reshape(blocks, window, -1)
    ahead = np.cumsum(cut, axis=1).reshape(len(padded), -1)  # from the block's start up to a row
    rest = np.cumsum(cut[:, ::-1], axis=1)[:, ::-1].reshape(len(padded), -1)  # from a row to the block's end
    start = np.arange(len(rows) - window + 1)
    return rest[start] + np.where((start % window > 0)[:, None], ahead[start + window - 1], 0.0)


def _filled_forward(x: np.ndarray) -> np.ndarray:
    """The last value up to each row; NaN before the first."""
    last = np.maximum.accumulate(np.where(np.isnan(x), -1, np.arange(len(x))[:, None]), axis=0)
    return np.where(last < 0, np.nan, np.take_along_axis(x, np.maximum(last, 0), axis=0))


def _eliminated(normal: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of many small normal equations, and which of them are safe: scaled to correlations, no pivot is below SAFE."""
    k = normal.shape[1]
    size = np.sqrt(np.maximum(normal[:, range(k), range(k)], 0.0))
    scale = np.where(size > 0, size, 1.0)
    a = np.concatenate([normal / scale[:, :, None] / scale[:, None, :], (target / scale)[:, :, None]], axis=2)
    safe = (size > 0).all(axis=1)
    for i in range(k):
        pivot = a[:, i, i]
        safe &= pivot > SAFE
        row = a[:, i, i:] / np.where(pivot > SAFE, pivot, 1.0)[:, None]
        a[:, i + 1 :, i:] -= a[:, i + 1 :, i, None] * row[:, None, :]
        a[:, i, i:] = row
    found = np.zeros_like(target)
    for i in reversed(range(k)):
        found[:, i] = a[:, i, k] - np.einsum("bj,bj->b", a[:, i, i + 1 : k], found[:, i + 1 :])
    return found / scale, safe


def _security_betas(pdf: pd.DataFrame, factors: Sequence[str], window: int, min_obs: int) -> np.ndarray:
    """Betas of each row of a security from the ``window`` rows before it.

    Factors are filled forward through the series. Where a window begins inside a gap, the products of its first rows are replaced by those of
    the first value after the gap. Nearly singular windows are solved from their rows by ``_solve``.
    """
    y = pdf["return_pct"].to_numpy(float) / 100.0
    x = pdf[list(factors)].to_numpy(float)
    n, k = x.shape
    betas = np.full((n, k), np.nan)
    have, use = ~np.isnan(x), ~np.isnan(y)
    if n <= window or not use.any():
        return betas
    center = np.array([np.median(c[h]) if h.any() else 0.0 for c, h in zip(x.T, have.T)])  # keeps products small, even beside outliers
    xs = np.column_stack([np.nan_to_num(_filled_forward(x) - center), np.ones(n)])
    ys = np.where(use, y - np.median(y[use]), 0.0)
    left, right = np.triu_indices(k + 1)
    pairs = len(left)

    def products(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.column_stack([rows[:, left] * rows[:, right] * use[at, None], rows * ys[at, None]])

    counts = _window_sums(np.column_stack([have, use]).astype(float), window)[:-1]
    run = np.flatnonzero((counts[:, k] >= max(min_obs, 1)) & (counts[:, :k] > 0).all(axis=1))
    sums = _window_sums(products(xs, np.arange(n)), window)[run]
    after = np.minimum.accumulate(np.where(have, np.arange(n)[:, None], n)[::-1], axis=0)[::-1]  # next row that has the factor
    ends = after[run] - run[:, None]  # rows of each window's start that lie in a gap
    for step in range(int(ends.max(initial=0))):
        open_ = np.flatnonzero((ends > step).any(axis=1))
        row, later = run[open_] + step, np.take_along_axis(x, np.minimum(after[run[open_]], n - 1), axis=0) - center
        other = xs[row].copy()
        other[:, :k] = np.where(ends[open_] > step, later, other[:, :k])
        sums[open_] += products(other, row) - products(xs[row], row)
    both = np.zeros((len(run), k + 1, k + 1))
    both[:, left, right] = both[:, right, left] = sums[:, :pairs]
    moments, count = sums[:, pairs:], counts[run, k, None]
    mean = both[:, :k, k] / count
    normal = both[:, :k, :k] - mean[:, :, None] * both[:, None, k, :k]
    found, safe = _eliminated(normal, moments[:, :k] - mean * moments[:, k:])
    safe &= (normal[:, range(k), range(k)] > NOISE * both[:, range(k), range(k)]).all(axis=1)
    betas[window + run[safe]] = found[safe]
    slow = run[~safe]
    for at in range(0, len(slow), BLOCK):
        part = slow[at : at + BLOCK]
        lo, hi = part[0], part[-1] + window
        yw = np.lib.stride_tricks.sliding_window_view(y[lo:hi], window)[part - lo]
        betas[window + part] = _solve(_windows(x[lo:hi], window)[part - lo], yw, min_obs)
    return betas


def rolling_betas(
    df: DataFrame,
    factors: DataFrame,
    *,
    names: Sequence[str] = FACTORS,
    keep: Sequence[str] = (),
    window: int = 252,
    min_obs: int = 60,
) -> DataFrame:
    """Betas of the security return (a fraction) on factor returns (percent) over the ``window`` rows before.

    Missing factor values are filled forward, then backward, inside each window. Betas are null for the
    first ``window`` rows, when fewer than ``min_obs`` returns are present, or when a factor has no value
    in the window; a singular window gives the minimum-norm solution. ``keep`` columns are passed
    through, which saves joining the result back. A security's series is bounded by the calendar.
    """
    live = factor_columns(factors, names)
    keep = list(keep)
    side = factors.groupBy("date").agg(*[F.max(F.col(n).cast("double")).alias(f"_f_{n}") for n in live])  # one row per day
    joined = df.select("stock_code", "date", "return_pct", *keep).join(F.broadcast(side), "date", "left")
    fields = [f for f in df.select("stock_code", "date", *keep).schema.fields]
    schema = T.StructType(fields + [T.StructField(f"beta_{n}", T.DoubleType()) for n in names])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", ignore_index=True)
        betas = _security_betas(pdf, [f"_f_{n}" for n in live], window, min_obs)
        out = pdf[["stock_code", "date", *keep]].copy()
        for n in names:
            out[f"beta_{n}"] = betas[:, live.index(n)] if n in live else np.nan
        return out

    fitted = joined.groupBy("stock_code").applyInPandas(solve, schema)
    betas = [f"beta_{n}" for n in names]
    return fitted.select("stock_code", "date", *keep, *[F.nanvl(b, F.lit(None).cast("double")).alias(b) for b in betas])


def characteristics_with_betas(df: DataFrame, factors: DataFrame, *, window: int = 252, min_obs: int = 60) -> DataFrame:
    """Characteristics and betas per security-day, from one shuffle by security."""
    chars = characteristics(df)
    return rolling_betas(chars, factors, keep=["size", "bm", "ep", "dy", "mom", "rev"], window=window, min_obs=min_obs)
