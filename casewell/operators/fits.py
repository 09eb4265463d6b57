"""Logistic and Poisson regression by Newton steps over counted rows.

A step is one grouped aggregation: tasks add up the log likelihood, its slope and the information
matrix over their rows, and one sum of each comes back. So the data are only read, and what is
solved on the driver is as large as the number of terms.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewell.functions.values import null_to_false
from casewell.session import stage

Z95 = 1.959963984540054
STEPS = 50
# Relative size of the last step of a converged fit.
_TOLERANCE = 1e-10

Design = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Fit:
    """Estimates, their standard errors (NaN where the information matrix has no inverse), the log
    likelihood, and whether the steps came to rest. They don't where levels tell the outcome for
    sure: some estimate then grows without end."""

    estimates: np.ndarray
    errors: np.ndarray
    likelihood: float
    converged: bool

    def p_value(self, i: int) -> float | None:
        """Two-sided p of an estimate, from the normal distribution."""
        if not self.errors[i] > 0:
            return None
        return math.erfc(abs(self.estimates[i] / self.errors[i]) / math.sqrt(2))


def _sums(rows: DataFrame, design: Design, family: str, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log likelihood without its constant, slope, information) at `beta`."""
    size = len(beta)

    def task(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + size + size * size)
        for frame in frames:
            x, y, n = design(frame)
            eta = x @ beta
            if family == "logistic":
                with np.errstate(over="ignore"):
                    mean = 1 / (1 + np.exp(-eta))
                weight, fitted, normal = n * mean * (1 - mean), n * mean, n * np.logaddexp(0, eta)
            else:
                fitted = weight = normal = np.exp(eta)
            total[0] += float(y @ eta - normal.sum())
            total[1 : size + 1] += x.T @ (y - fitted)
            total[size + 1 :] += (x.T @ (weight[:, None] * x)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["cell", "v"])

    out = np.zeros(1 + size + size * size)
    for row in rows.mapInArrow(task, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[row["cell"]] = row["v"]
    return float(out[0]), out[1 : size + 1], out[size + 1 :].reshape(size, size)


def newton(rows: DataFrame, design: Design, family: str, start: np.ndarray, steps: int = STEPS) -> Fit:
    """Newton steps from `start`; a step that lowers the likelihood is halved."""
    beta, converged = start.astype(float), False
    value, slope, information = _sums(rows, design, family, beta)
    for _ in range(steps):
        try:
            step = np.linalg.solve(information, slope)
        except np.linalg.LinAlgError:
            break
        small = np.abs(step).max(initial=0) <= _TOLERANCE * (1 + np.abs(beta).max(initial=0))
        tried = _sums(rows, design, family, beta + step)
        while not small and not tried[0] >= value - 1e-12 * abs(value) and np.abs(step).max() > 1e-14:
            step = step / 2
            tried = _sums(rows, design, family, beta + step)
        beta = beta + step
        value, slope, information = tried
        if small:
            converged = True
            break
    try:
        errors = np.sqrt(np.diag(np.linalg.inv(information)))
    except np.linalg.LinAlgError:
        errors = np.full(len(beta), np.nan)
    return Fit(beta, errors, value, converged)


def logistic_or(df: DataFrame, outcome: str, terms: Sequence[str], steps: int = STEPS) -> DataFrame:
    """Logistic regression of a flag on categorical terms, first level as reference: odds ratio,
    95 % interval, two-sided p of every other level and of the intercept, McFadden's pseudo-R2 and
    whether the fit converged.

    It runs on the counted combinations of levels, which give the same estimates and errors as
    the rows. Rows without a level are left out; a null outcome is false. Where some level has
    only one outcome the fit does not converge, and says so. Without rows there is no result.
    """
    typed = df.select(
        null_to_false(F.col(outcome)).cast("long").alias("modelled_hits"),
        *[F.col(t).cast("string").alias(t) for t in terms],
    ).dropna()
    counted = typed.groupBy(*terms).agg(
        F.sum("modelled_hits").alias("modelled_hits"), F.count(F.lit(1)).alias("modelled_rows")
    )
    # Staged, since every step reads it.
    counted = stage(counted, "levels")
    found = counted.agg(
        F.sum("modelled_hits").alias("hits"), F.sum("modelled_rows").alias("n"),
        *[F.sort_array(F.collect_set(t)).alias(f"levels_{i}") for i, t in enumerate(terms)],
    ).first()
    shape = "term string, odds_ratio double, ci_low double, ci_high double, p_value double, pseudo_r2 double, converged boolean"
    if not found["n"]:
        return df.sparkSession.createDataFrame([], shape)
    names, place = [], []
    for i, term in enumerate(terms):
        own = found[f"levels_{i}"][1:]
        place.append({level: len(names) + j for j, level in enumerate(own)})
        names += [f"{term}_{level}" for level in own]
    size = len(names) + 1

    def design(frame: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.zeros((frame.num_rows, size))
        x[:, -1] = 1
        for i, at in enumerate(place):
            for row, level in enumerate(frame.column(i).to_pylist()):
                if level in at:
                    x[row, at[level]] = 1
        return x, *(frame.column(len(place) + i).to_numpy().astype(float) for i in (0, 1))

    rows = counted.select(*terms, "modelled_hits", "modelled_rows")
    fit = newton(rows, design, "logistic", np.zeros(size), steps)
    share = found["hits"] / found["n"]
    null = sum(found["n"] * s * math.log(s) for s in (share, 1 - share) if s > 0)
    pseudo_r2 = 1 - fit.likelihood / null if null else None
    table = []
    for i, name in enumerate([*names, "(intercept)"]):
        beta, error = fit.estimates[i], fit.errors[i]
        low, high = (math.exp(min(beta + side * Z95 * error, 700)) if error == error else None for side in (-1, 1))
        table.append((name, math.exp(min(beta, 700)), low, high, fit.p_value(i), pseudo_r2, fit.converged))
    return df.sparkSession.createDataFrame(table, shape)


def poisson_trend(series: DataFrame, n: str = "n", order: str = "period", steps: int = STEPS) -> DataFrame:
    """Poisson regression of the period counts on the period number: slope, intercept, the
    slope's error and p, and whether the fit converged. An empty series has no result."""
    # One row per period, staged because every step reads it.
    series = stage(series.select(order, n), "series")
    place = F.row_number().over(Window.orderBy(order)).cast("double")
    rows = stage(series.select(F.col(n).cast("double").alias("y"), place.alias("x")), "periods")
    mean = rows.agg(F.avg("y")).first()[0]
    shape = "slope double, intercept double, std_error double, p_value double, converged boolean"
    if mean is None:
        return series.sparkSession.createDataFrame([], shape)

    def design(frame: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y, x = (frame.column(i).to_numpy() for i in (0, 1))
        return np.column_stack([x, np.ones(len(x))]), y, np.ones(len(x))

    start = np.asarray([0.0, math.log(mean) if mean > 0 else 0.0])
    fit = newton(rows, design, "poisson", start, steps)
    row = (*map(float, fit.estimates), float(fit.errors[0]), fit.p_value(0), fit.converged)
    return series.sparkSession.createDataFrame([row], shape)
