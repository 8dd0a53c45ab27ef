"""F22, whole spectrum: both ways of the transform against numpy, Welch segments against their definition, undefined values."""

import numpy as np
import pytest

from medfuse.functions import spectrum as SP
from medfuse.functions.tsfeatures import fname


def frame(spark, series):
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "Patient_ID long, time long, value double")


def moments(x):
    y = np.abs(np.fft.rfft(x))
    m = [(y * np.arange(len(y), dtype=float) ** p).sum() / y.sum() for p in range(5)]
    var = m[2] - m[1] ** 2
    skew = (m[3] - 3 * m[1] * var - m[1] ** 3) / var ** 1.5 if var >= 0.5 else None
    kurt = (m[4] - 4 * m[1] * m[3] + 6 * m[2] * m[1] ** 2 - 3 * m[1]) / var ** 2 if var >= 0.5 else None
    return [m[1], var, skew, kurt]


def welch(x):
    n = min(len(x), SP.SEGMENT)
    step = n - n // 2
    total = 0
    for s in range((len(x) - n // 2) // step):
        part = x[s * step:s * step + n]
        k = np.arange(n // 2 + 1)[:, None]
        w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
        p = np.abs(((part - part.mean()) * w * np.exp(-2j * np.pi * k * np.arange(n) / n)).sum(1)) ** 2
        total = total + p * np.where((k[:, 0] == 0) | ((n % 2 == 0) & (k[:, 0] == n // 2)), 1, 2)
    return total / total.max()


@pytest.mark.parametrize("block", [4, SP.BLOCK])
def test_spectrum_moments_equal_numpy_on_both_ways(spark, block):
    rng = np.random.default_rng(4)
    series = {n: rng.normal(3, 2, n) for n in (1, 2, 3, 5, 8, 31, 64, 1009, 5000)}       # primes, powers of two, odd and even
    got = {r["Patient_ID"]: r for r in SP.spectrum_features(frame(spark, series), kinds=["fft_aggregated"], block=block).collect()}
    assert set(got) == set(series)
    for n, x in series.items():
        for a, want in zip(SP.AGGREGATES, moments(x)):
            value = got[n][fname("fft_aggregated", aggtype=a)]
            assert value is None if want is None else value == pytest.approx(want, rel=1e-8, abs=1e-8), (n, a)


def test_fourier_entropy_of_short_and_segmented_series(spark):
    rng = np.random.default_rng(5)
    series = {n: rng.normal(0, 1, n) for n in (7, 10, 256, 257, 700, 1000)} | {2000: np.ones(30), 2001: np.zeros(1)}
    got = {r["Patient_ID"]: r for r in SP.spectrum_features(frame(spark, series), kinds=["fourier_entropy"]).collect()}
    for key, x in series.items():
        for b in SP.BINS:
            value = got[key][fname("fourier_entropy", bins=b)]
            if key >= 2000:
                assert value is None
                continue
            share = np.histogram(welch(x), b)[0] / (min(len(x), SP.SEGMENT) // 2 + 1)
            assert value == pytest.approx(-(share[share > 0] * np.log(share[share > 0])).sum(), abs=1e-9), (key, b)


def test_spectrum_of_zeros_and_of_nothing(spark):
    row = SP.spectrum_features(frame(spark, {1: np.zeros(9)})).first()
    assert all(v is None for k, v in row.asDict().items() if "__" in k)
    assert SP.spectrum_features(frame(spark, {1: [1.0]}).limit(0)).count() == 0
