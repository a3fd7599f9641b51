"""Chaotic systems: orbits and largest Lyapunov exponents, many systems side by side in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separation, steps before and while measuring, rounds left out of the mean, size at which a system counts as unbounded.
SEPARATION = 1e-7
TRANSIENT, ROUNDS, SKIPPED = 10_000, 64_100, 100
UNBOUNDED = 1e7
#: The orbit's parameters and start.
ORBIT_A, ORBIT_B = 1.4, 0.3
ORBIT_X, ORBIT_Y = 0.631354477, 0.189406343

#: A system maps states (dimensions by systems) to states one step on.
Step = Callable[[np.ndarray], np.ndarray]


def henon(a: np.ndarray, b: np.ndarray) -> Step:
    """x' = b * y + 1 - a * x * x, y' = x."""
    return lambda s: np.stack([b * s[1] + 1.0 - a * s[0] * s[0], s[0]])


def lorenz(sigma: np.ndarray, beta: np.ndarray, rho: np.ndarray) -> Step:
    """The rates of change of the Lorenz system."""
    return lambda s: np.stack([sigma * (s[1] - s[0]), s[0] * (rho - s[2]) - s[1], s[0] * s[1] - beta * s[2]])


def runge_kutta(rates: Step, dt: float) -> Step:
    """One step of the classical fourth-order method."""

    def step(s: np.ndarray) -> np.ndarray:
        k1 = rates(s)
        k2 = rates(s + 0.5 * dt * k1)
        k3 = rates(s + 0.5 * dt * k2)
        k4 = rates(s + dt * k3)
        return s + (dt / 6.0) * ((k1 + k4) + 2.0 * (k2 + k3))

    return step


def largest_exponent(step: Step, state: np.ndarray, dt: float = 1.0, transient: int = TRANSIENT, rounds: int = ROUNDS, skipped: int = SKIPPED) -> np.ndarray:
    """Largest Lyapunov exponent of each system; NaN for those that leave all bounds.

    A companion starts a little apart; each round both move on, the logarithm of
    how far they parted counts, and the companion is brought back along the line
    between them.
    """
    with np.errstate(all="ignore"):
        for _ in range(transient):
            state = step(state)
        other = state + SEPARATION / np.sqrt(len(state))
        total = np.zeros(state.shape[1])
        lost = ~np.isfinite(state).all(0)
        for i in range(1, rounds + 1):
            other, state = step(other), step(state)
            lost |= ~(np.abs(state).sum(0) < UNBOUNDED)
            apart = other - state
            d = np.sqrt((apart * apart).sum(0))
            if i > skipped:
                total += np.log(d / SEPARATION)
            other = state + apart * (SEPARATION / d)
        return np.where(lost, np.nan, total / ((rounds - skipped - 1) * dt))


def lyapunov_henon(a: Column, b: Column, transient: int = TRANSIENT, rounds: int = ROUNDS) -> Column:
    """Exponent of each Hénon map from the origin; null parameters give null."""

    @F.pandas_udf("double")
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        p, q = a.to_numpy(float, na_value=np.nan), b.to_numpy(float, na_value=np.nan)
        return pd.Series(_rows(largest_exponent(henon(p, q), np.zeros((2, len(p))), 1.0, transient, rounds), ~(np.isnan(p) | np.isnan(q))))

    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(udf(a, b), F.lit(float("nan"))))


def lyapunov_lorenz(sigma: Column, beta: Column, rho: Column, dt: float = 0.01, transient: int = TRANSIENT, rounds: int = ROUNDS, start: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Column:
    """The same for Lorenz systems, by Runge-Kutta steps of dt."""

    @F.pandas_udf("double")
    def udf(sigma: pd.Series, beta: pd.Series, rho: pd.Series) -> pd.Series:
        p = [x.to_numpy(float, na_value=np.nan) for x in (sigma, beta, rho)]
        state = np.repeat(np.array(start, float)[:, None], len(p[0]), axis=1)
        return pd.Series(_rows(largest_exponent(runge_kutta(lorenz(*p), dt), state, dt, transient, rounds), ~np.isnan(np.stack(p)).any(0)))

    return F.when(sigma.isNotNull() & beta.isNotNull() & rho.isNotNull(), F.coalesce(udf(sigma, beta, rho), F.lit(float("nan"))))


def _rows(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return np.where(known, values, np.nan)


def chaos_map(space: DataFrame, transient: int = TRANSIENT, rounds: int = ROUNDS, partitions: int | None = None) -> DataFrame:
    """a, b, exponent for each point of a two-dimensional parameter space; partitions spreads the points over so many tasks."""
    a, b = (F.col(c) for c in space.columns[:2])
    points = space.select(a.alias("a"), b.alias("b"))
    points = points.repartition(partitions) if partitions else points
    return points.withColumn("exponent", lyapunov_henon(F.col("a"), F.col("b"), transient, rounds))


def exponent_grid(found: DataFrame, decimals: int = 6) -> DataFrame:
    """The map as a table, one row for each a and one column for each b, for plotting."""
    return found.select(F.round("a", decimals).alias("a"), F.round("b", decimals).alias("b"), "exponent").groupBy("a").pivot("b").agg(F.first("exponent")).orderBy("a")


def henon_orbit(spark: SparkSession, steps: int = 1_000_000, a: float = ORBIT_A, b: float = ORBIT_B, x: float = ORBIT_X, y: float = ORBIT_Y, burn_in: int = 0) -> DataFrame:
    """step, x, y of x' = y + 1 - a * x * x, y' = b * x. One task makes it, a chunk at a time: each point needs the one before."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in parts:
            px, py, rows = x, y, []
            for k in range(1, burn_in + steps + 1):
                px, py = py + 1.0 - a * px * px, b * px
                if k > burn_in:
                    rows.append((k - burn_in, px, py))
                    if len(rows) == 50_000:
                        yield pd.DataFrame(rows, columns=["step", "x", "y"])
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["step", "x", "y"])

    return spark.range(1, numPartitions=1).mapInPandas(run, "step long, x double, y double")
