import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphspark.functions import grids, rates


def test_characteristic_polynomial(spark):
    rng = np.random.default_rng(2)
    matrices = [rng.integers(-3, 4, (4, 4)) for _ in range(20)] + [np.zeros((4, 4), dtype=int), np.eye(4, dtype=int)]
    df = spark.createDataFrame([(i, [int(x) for x in m.reshape(-1)]) for i, m in enumerate(matrices)], "id int, m array<long>")
    for r in grids.characteristic_polynomial(df, "m", 4).collect():
        assert [r.c4, r.c3, r.c2, r.c1, r.c0] == [round(x) for x in np.poly(matrices[r.id])]
    traces = {r.id: r.t for r in df.select("id", grids.trace("m", 4).alias("t")).collect()}
    assert traces == {i: int(np.trace(m)) for i, m in enumerate(matrices)}


def test_hotspot_step(spark):
    rng = np.random.default_rng(3)
    temp, power = rng.uniform(300, 340, (4, 5)), rng.uniform(0, 1, (4, 5))
    over_cap, rx, ry, rz = 0.01, 1.5, 2.5, 40.0
    want = temp.copy()
    for i in range(4):
        for j in range(5):
            at = lambda a, b: temp[min(max(a, 0), 3), min(max(b, 0), 4)]
            t = temp[i, j]
            want[i, j] += over_cap * (power[i, j] + (at(i - 1, j) + at(i + 1, j) - 2 * t) / ry + (at(i, j - 1) + at(i, j + 1) - 2 * t) / rx + (80.0 - t) / rz)
    grid = spark.createDataFrame([(i, j, float(temp[i, j]), float(power[i, j])) for i in range(4) for j in range(5)], "row long, col long, temp double, power double")
    for r in grids.hotspot_step(grid, over_cap, rx, ry, rz).collect():
        assert r.temp == pytest.approx(want[r.row, r.col], rel=1e-12)
    alone = grids.hotspot_step(grid.limit(0).union(spark.createDataFrame([(0, 0, 90.0, 2.0)], grid.schema)), 1.0, 1.0, 1.0, 10.0).first()
    assert alone.temp == pytest.approx(90.0 + 2.0 - 1.0)


def plain_value(z, last=rates.RATE):
    """The portfolio of one path by plain loops."""
    levels = [rates.RATE] * (rates.PERIODS - 1) + [last]
    q, vol = rates.QUARTER, rates.VOLATILITY
    for n in range(rates.UNTIL):
        total, new = 0.0, list(levels)
        for i in range(n + 1, rates.PERIODS):
            total += q * vol * levels[i] / (1 + q * levels[i])
            new[i] = levels[i] * math.exp(q * vol * total + vol * (math.sqrt(q) * z[n] - 0.5 * q * vol))
        levels = new
    value = 0.0
    for length, rate in zip(rates.MATURITIES, rates.SWAP_RATES, strict=True):
        discount, annuity = 1.0, 0.0
        for level in levels[rates.UNTIL : rates.UNTIL + length]:
            discount /= 1 + q * level
            annuity += q * discount
        value += 100 * max(0.0, 1 - discount - rate * annuity)
    for level in levels[: rates.UNTIL]:
        value /= 1 + q * level
    return value


def test_swaption_values(spark):
    rng = np.random.default_rng(4)
    draws = [[0.3] * rates.UNTIL, *rng.normal(0, 0.4, (6, rates.UNTIL)).tolist()]
    df = spark.createDataFrame(list(enumerate(draws)), "path long, z array<double>").repartition(3)
    out = rates.swaption_values(df).collect()
    assert len(out) == len(draws)
    for r in out:
        z = draws[r.path]
        assert r.value == pytest.approx(plain_value(z), rel=1e-9, abs=1e-9)
        step = 1e-5
        assert r.sensitivity == pytest.approx((plain_value(z, 0.05 + step) - plain_value(z, 0.05 - step)) / (2 * step), rel=1e-4, abs=1e-4)
    assert rates.swaption_values(df.where(F.lit(False))).count() == 0
