"""Swaption values over paths of forward rates (a market model in which the rates of all periods move by one factor)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.session import ensure_importable

#: 80 periods of a quarter, rates of 5 % and volatility 0.2 for all, 40 periods until the options' date.
PERIODS, UNTIL, QUARTER, RATE, VOLATILITY = 80, 40, 0.25, 0.05, 0.2
#: The options' lengths in periods and swap rates.
MATURITIES = [4, 4, 4, 8, 8, 8, 20, 20, 20, 28, 28, 28, 40, 40, 40]
SWAP_RATES = [0.045, 0.05, 0.055, 0.045, 0.05, 0.055, 0.045, 0.05, 0.055, 0.045, 0.05, 0.055, 0.045, 0.05, 0.055]


def path_values(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value of the portfolio for each row of draws (paths x UNTIL), and its derivative by the last initial rate.

    Periods are columns, so a step over all paths is one cumulative sum; the derivative is carried forward with the rates, as
    only the last rate depends on its own initial value.
    """
    rates = np.full((len(z), PERIODS), RATE)
    slope = np.ones(len(z))
    drift = QUARTER * VOLATILITY
    for n in range(UNTIL):
        later = rates[:, n + 1 :]
        grown = np.cumsum(drift * later / (1 + QUARTER * later), axis=1)
        factor = np.exp(drift * grown + VOLATILITY * (np.sqrt(QUARTER) * z[:, n, None] - 0.5 * drift))
        last = later[:, -1]
        slope = factor[:, -1] * (slope + last * drift * drift * slope / (1 + QUARTER * last) ** 2)
        rates[:, n + 1 :] = later * factor
    discounts = np.cumprod(1 / (1 + QUARTER * rates[:, UNTIL:]), axis=1)
    annuities = QUARTER * np.cumsum(discounts, axis=1)
    at = np.array(MATURITIES) - 1
    swaps = discounts[:, at] + np.array(SWAP_RATES) * annuities[:, at] - 1.0
    now = np.prod(1 / (1 + QUARTER * rates[:, :UNTIL]), axis=1)
    moved = -discounts[:, -1] * QUARTER / (1 + QUARTER * rates[:, -1]) * slope
    exposed = np.where((swaps < 0) & (at == PERIODS - UNTIL - 1), -100.0 * (1 + np.array(SWAP_RATES) * QUARTER), 0.0).sum(axis=1)
    return now * 100.0 * np.maximum(-swaps, 0).sum(axis=1), now * exposed * moved + 0.0  # no negative zeros


def swaption_values(paths: DataFrame) -> DataFrame:
    """(path, value, sensitivity) of paths (path, z: array of UNTIL draws); paths are independent, so nothing is shuffled."""
    ensure_importable(paths.sparkSession)

    def valued(batches):
        for batch in batches:
            z = np.asarray(batch.column(1).flatten()).astype(np.float64).reshape(batch.num_rows, UNTIL)
            value, sensitivity = path_values(z)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value), pa.array(sensitivity)], names=["path", "value", "sensitivity"])

    return paths.select(F.col("path").cast("long"), F.col("z").cast("array<double>")).mapInArrow(valued, "path long, value double, sensitivity double")
