"""Least squares from sufficient statistics: any number of groups (folds, samples, rungs) fitted in one aggregation.

A group's sums of products, its moments, are all that its fit needs. They add up: sums taken once for the smallest parts are
summed for every group that holds these parts, and each group is solved by itself, on executors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def centres(rows: DataFrame, columns: list[str]) -> list[float]:
    """A number near each column's values. Moments around it lose no digits; fits and predictions don't depend on it."""
    found = rows.agg(*[F.avg(F.col(c).cast("double")) for c in columns]).first() if columns else []
    return [float(x) if x is not None and np.isfinite(x) else 0.0 for x in found]


def _inputs(columns: list[str], around: list[float]) -> list[Column]:
    """Columns as numbers, missing ones 0, less their centres."""
    return [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(m) for c, m in zip(columns, around, strict=True)]


def names(columns: list[str]) -> list[str]:
    p = range(len(columns))
    return ["_m_n", "_m_y", *[f"_m_x{i}" for i in p], *[f"_m_y{i}" for i in p], *[f"_m_x{i}_{j}" for i in p for j in p if i <= j]]


def moments(columns: list[str], around: list[float], target: str = "target") -> list[Column]:
    """Aggregates of rows with a target: n, and sums of the target, the inputs and their products."""
    y = F.col(target).cast("double")
    x = [F.when(y.isNotNull(), v) for v in _inputs(columns, around)]
    p = range(len(columns))
    values = [F.count(y), F.sum(y), *[F.sum(v) for v in x], *[F.sum(v * y) for v in x], *[F.sum(x[i] * x[j]) for i in p for j in p if i <= j]]
    return [v.alias(name) for v, name in zip(values, names(columns), strict=True)]


def summed(columns: list[str]) -> list[Column]:
    """Aggregates that add the moments of parts."""
    return [F.sum(name).alias(name) for name in names(columns)]


def solved(sums: pd.DataFrame, p: int) -> list[np.ndarray | None]:
    """Intercept and slopes of each row of moments. Columns that don't vary, or repeat others, share the least slopes."""
    v = sums.to_numpy(np.float64)
    n = np.where(v[:, 0] > 0, v[:, 0], np.nan)
    y, sx, sxy = v[:, 1] / n, v[:, 2 : 2 + p], v[:, 2 + p : 2 + 2 * p]
    products = np.zeros((len(v), p, p))
    products[:, *np.triu_indices(p)] = v[:, 2 + 2 * p :]
    products = products + np.triu(products, 1).transpose(0, 2, 1)
    mean = sx / n[:, None]
    spread = products - sx[:, :, None] * mean[:, None, :]
    own, whole = np.diagonal(spread, axis1=1, axis2=2), np.diagonal(products, axis1=1, axis2=2)
    varies = own > 1e-12 * whole
    unit = np.sqrt(np.where(varies, own, 1.0))
    both = varies[:, :, None] & varies[:, None, :]
    scaled = np.where(both, spread, 0.0) / (unit[:, :, None] * unit[:, None, :])
    right = np.where(varies, sxy - sx * y[:, None], 0.0) / unit
    known = np.isfinite(n)
    slopes = np.zeros((len(v), p))
    if p and known.any():
        slopes[known] = (np.linalg.pinv(scaled[known], rcond=1e-10, hermitian=True) @ right[known][:, :, None])[:, :, 0] / unit[known]
    return [np.r_[y[k] - slopes[k] @ mean[k], slopes[k]] if known[k] else None for k in range(len(v))]


def coefficients(columns: list[str]) -> Column:
    """Intercept and slopes, around the centres, from the columns of moments; NULL without rows."""
    p = len(columns)

    def solve(sums: pd.DataFrame) -> pd.Series:
        return pd.Series(solved(sums, p), dtype=object)

    return F.pandas_udf(solve, "array<double>")(F.struct(*[F.col(c).cast("double").alias(c) for c in names(columns)]))


def prediction(columns: list[str], around: list[float], coefficients: str = "_coefficients") -> Column:
    fit = F.col(coefficients)
    return sum((fit[k + 1] * x for k, x in enumerate(_inputs(columns, around))), fit[0])


def predicted(rows: DataFrame, keys: list[str], columns: list[str], target: str = "target") -> DataFrame:
    """The test rows of ``rows`` (keys, part, columns, target) with y_pred by the fit of their key's training rows.

    All keys are fitted at once; one without training rows predicts NULL. Missing inputs count as 0.
    """
    around = centres(rows, columns)
    fits = rows.where("part = 'train'").groupBy(*keys).agg(*moments(columns, around, target)).select(*keys, coefficients(columns).alias("_coefficients"))
    return rows.where("part = 'test'").join(fits, keys, "left").withColumn("y_pred", prediction(columns, around)).drop("_coefficients")
