"""The distributed transform against numpy's, for lengths of every kind."""

import numpy as np
import pytest

from planlens.operators import series, spectrum


@pytest.mark.parametrize("n", [2, 3, 5, 64, 97, 1009])
@pytest.mark.parametrize("group", [8, 1 << 17])
def test_power_spectrum(spark, monkeypatch, n, group):
    monkeypatch.setattr(spectrum, "GROUP_VALUES", group)
    d = np.random.default_rng(n).normal(size=n)
    rows = spark.createDataFrame([(i, float(v), n) for i, v in enumerate(d)], "i long, d double, n long").repartition(5)
    got = {r["k"]: r["power"] for r in spectrum.power_spectrum(rows).collect()}
    assert sorted(got) == list(range(n))
    assert np.allclose([got[k] for k in range(n)], np.abs(np.fft.fft(d)) ** 2 / n, rtol=1e-9, atol=1e-11)


def test_long_series(spark):
    n = 50_021
    rows = spark.range(n).selectExpr("id as t", "sin(2 * pi() * id * 17 / 50021) * 3 + sin(2 * pi() * id * 4001 / 50021) as y")
    top = series.top_periods(series.periodogram(rows, "y", ["t"]), 2).collect()
    assert [r["k"] for r in top] == [17, 4001] and abs(top[0]["power"] - 9 * n / 4) < 1e-4 and abs(top[1]["power"] - n / 4) < 1e-4
    assert series.periodogram(rows.limit(0), "y", ["t"]).count() == 0 and series.periodogram(rows.limit(1), "y", ["t"]).count() == 0
