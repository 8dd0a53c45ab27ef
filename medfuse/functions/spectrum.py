"""F22, whole spectrum: ``fft_aggregated`` (moments of the absolute spectrum) and ``fourier_entropy`` (of the Welch density).

A series of any length n takes n log n work, and no task ever holds more of it than about the square root of 4n readings:

- Up to ``block`` readings: one bounded array a series, transformed by numpy.
- Longer: the transform of length n is a convolution with a chirp, padded to a power of two M = R x C, and both
  transforms of the convolution go over the readings as a table of R rows and C columns: columns first, then rows (with
  the product and the way back in the same task), then columns.  Each of the three steps is a grouping by (series, column
  or row), so a long series spreads over all tasks.
- The Welch density takes segments of at most 256 readings that overlap by half; their powers are averaged by a Spark
  aggregate.

Definitions are the published ones of the calculators of the same names.  An undefined value is NULL: moments of a
spectrum that is zero everywhere, skew and kurtosis where the variance is under 0.5, the entropy of a constant series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, DoubleType, LongType

from medfuse.functions import series as S
from medfuse.functions.tsfeatures import SIG, fname, prepare_long
from medfuse.session import materialize

BLOCK = 4096            # readings of a series that is transformed as one array
SEGMENT = 256           # readings of a Welch segment
BINS = (2, 3, 5, 10, 100)
MOMENTS = [f"s{m}" for m in range(5)]
AGGREGATES = ("centroid", "variance", "skew", "kurtosis")


def chirp(j: np.ndarray, n: int) -> np.ndarray:
    """exp(-i pi j^2 / n); the square is reduced in whole numbers, so long series lose no digits."""
    j = np.abs(j.astype(np.int64)) % (2 * n)
    square = (j * j) % (2 * n) if n < 1 << 30 else np.array([int(v) * int(v) % (2 * n) for v in j], np.int64)
    return np.exp(-1j * np.pi * square / n)


def table_shape(n: int) -> tuple[int, int]:
    """(R, C) with R x C the smallest power of two of at least 2n - 1."""
    p = max(1, int(2 * n - 2).bit_length())
    return 1 << (p - p // 2), 1 << (p // 2)


def power_sums(size: np.ndarray, k: np.ndarray) -> list[float]:
    return [float((size * k.astype(float) ** m).sum()) for m in range(5)]


def _short(base: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, s0..s4) of series that fit one array."""
    @F.pandas_udf("struct<" + ",".join(f"{m}:double" for m in MOMENTS) + ">")
    def sums(values: pd.Series) -> pd.DataFrame:
        rows = []
        for x in values:
            size = np.abs(np.fft.rfft(np.asarray(x, float)))
            rows.append(power_sums(size, np.arange(len(size))))
        return pd.DataFrame(rows, columns=MOMENTS)
    arrays = base.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(S.RN, S.X))).getField(S.X).alias("_values"))
    return arrays.select(*keys, sums("_values").alias("_s")).select(*keys, "_s.*")


def _long(base: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, s0..s4) of series of any length from 4 on, by three groupings of the table."""
    key_fields = [base.schema[k] for k in keys]

    def schema(*names: str) -> StructType:
        return StructType([*key_fields, StructField(S.N, LongType()), *[StructField(f, LongType()) for f in ("line", "place")],
                           *[StructField(f, DoubleType()) for f in names]])

    def columns_of(pdf: pd.DataFrame, line: int, parts: dict[str, np.ndarray], n: int) -> pd.DataFrame:
        size = len(next(iter(parts.values())))
        out = {k: pdf[k].iloc[0] for k in keys} | {S.N: n, "line": np.arange(size), "place": line} | parts
        return pd.DataFrame(out)

    def down(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # column c of the table: places r * C + c of the padded series, and of the chirp it is convolved with
        n, c = int(pdf[S.N].iloc[0]), int(key[-1])
        R, C = table_shape(n)
        a = np.zeros(R, complex)
        j = pdf[S.RN].to_numpy(np.int64) - 1
        a[j // C] = pdf[S.X].to_numpy(float) * chirp(j, n)
        place = np.arange(R, dtype=np.int64) * C + c
        away = np.minimum(place, R * C - place)
        b = np.where(away < n, np.conj(chirp(away, n)), 0)
        turn = np.exp(-2j * np.pi * c * np.arange(R) / (R * C))
        a, b = np.fft.fft(a) * turn, np.fft.fft(b) * turn
        return columns_of(pdf, c, {"ar": a.real, "ai": a.imag, "br": b.real, "bi": b.imag}, n)

    def across(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # row r: both transforms end here, and the way back begins on their product
        n, r = int(pdf[S.N].iloc[0]), int(key[-1])
        R, C = table_shape(n)
        pdf = pdf.sort_values("place")
        a, b = pdf["ar"].to_numpy() + 1j * pdf["ai"].to_numpy(), pdf["br"].to_numpy() + 1j * pdf["bi"].to_numpy()
        back = np.fft.ifft(np.fft.fft(a) * np.fft.fft(b)) * np.exp(2j * np.pi * r * np.arange(C) / (R * C))
        return columns_of(pdf, r, {"ar": back.real, "ai": back.imag}, n)

    def up(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, c = int(pdf[S.N].iloc[0]), int(key[-1])
        R, C = table_shape(n)
        pdf = pdf.sort_values("place")
        size = np.abs(np.fft.ifft(pdf["ar"].to_numpy() + 1j * pdf["ai"].to_numpy()))
        k = np.arange(R, dtype=np.int64) * C + c
        inside = k <= n // 2
        return pd.DataFrame([{name: pdf[name].iloc[0] for name in keys} | dict(zip(MOMENTS, power_sums(size[inside], k[inside])))])

    half = (F.length(F.bin(2 * F.col(S.N) - 2)) / 2).cast("int")            # the exponent of C
    dealt = base.select(*keys, F.col(S.N).cast("long").alias(S.N), S.RN, S.X,
                        F.pmod(F.col(S.RN) - 1, F.pow(F.lit(2.0), half).cast("long")).alias("line"))
    first = dealt.groupBy(*keys, "line").applyInPandas(down, schema("ar", "ai", "br", "bi"))
    second = first.groupBy(*keys, "line").applyInPandas(across, schema("ar", "ai"))
    sums = StructType([*key_fields, *[StructField(m, DoubleType()) for m in MOMENTS]])
    return second.groupBy(*keys, "line").applyInPandas(up, sums).groupBy(*keys).agg(*[F.sum(m).alias(m) for m in MOMENTS])


def fft_aggregated(base: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Centroid, variance, skew and kurtosis of the absolute spectrum of every series of ``base`` (keys, rn, n, x)."""
    block = max(4, block)
    sums = _short(base.where(F.col(S.N) <= block), keys).unionByName(_long(base.where(F.col(S.N) > block), keys))
    m = [F.try_divide(F.col(f"s{i}"), F.col("s0")) for i in range(5)]
    c, var = m[1], m[2] - m[1] * m[1]
    values = {"centroid": c, "variance": var,
              "skew": F.when(var >= 0.5, (m[3] - 3 * c * var - F.pow(c, 3)) / F.pow(var, 1.5)),
              # the last term is three times the centroid itself, as published
              "kurtosis": F.when(var >= 0.5, (m[4] - 4 * c * m[3] + 6 * m[2] * c * c - 3 * c) / (var * var))}
    return sums.select(*keys, *[values[a].alias(fname("fft_aggregated", aggtype=a)) for a in AGGREGATES])


def fourier_entropy(base: DataFrame, keys: list[str], bins: Sequence[int] = BINS, segment: int = SEGMENT) -> DataFrame:
    """Entropy of the binned Welch density, relative to its largest value, of every series of ``base`` (keys, rn, n, x)."""
    i, size = F.col(S.RN) - 1, F.least(F.col(S.N), F.lit(segment)).cast("long")
    rows = base.select(*keys, S.X, i.alias("_i"), size.alias("_size"), (size - F.floor(size / 2)).alias("_step"),
                       F.floor((F.col(S.N) - F.floor(size / 2)) / (size - F.floor(size / 2))).alias("_count"))
    last = F.floor(F.col("_i") / F.col("_step"))
    parts = (rows.withColumn("_seg", F.explode(F.sequence(F.greatest(last - 2, F.lit(0)), last)))
             .withColumn("_at", F.col("_i") - F.col("_seg") * F.col("_step"))
             .where("_seg < _count AND _at < _size"))
    arrays = parts.groupBy(*keys, "_seg").agg(F.sort_array(F.collect_list(F.struct("_at", S.X))).getField(S.X).alias("_values"))

    @F.pandas_udf("array<double>")
    def powers(values: pd.Series) -> pd.Series:
        out = []
        for x in values:
            x = np.asarray(x, float)
            n = len(x)
            window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) if n > 1 else np.ones(1)
            p = np.abs(np.fft.rfft((x - x.mean()) * window)) ** 2
            p[1:len(p) - (n % 2 == 0)] *= 2             # one-sided: all but zero and the highest of an even length
            out.append(p)
        return pd.Series(out)

    @F.pandas_udf("array<double>")
    def entropies(values: pd.Series) -> pd.Series:
        out = []
        for p in values:
            p = np.asarray(p, float) / np.max(p)
            shares = [np.histogram(p, b)[0] / len(p) for b in bins]
            out.append([float(-(s[s > 0] * np.log(s[s > 0])).sum()) for s in shares])
        return pd.Series(out)

    density = (arrays.select(*keys, F.posexplode(powers("_values")).alias("_f", "_p")).groupBy(*keys, "_f").agg(F.avg("_p").alias("_p"))
               .groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_f", "_p"))).getField("_p").alias("_density")))
    varying = base.groupBy(*keys).agg((F.min(S.X) < F.max(S.X)).alias("_varies"))
    found = density.join(varying.where("_varies"), keys).select(*keys, entropies("_density").alias("_e"))
    return varying.select(*keys).join(found, keys, "left").select(
        *keys, *[F.col("_e")[n].alias(fname("fourier_entropy", bins=b)) for n, b in enumerate(bins)])


def spectrum_features(df: DataFrame, column_id: str = "Patient_ID", column_sort: str = "time", signals: list[str] | None = None,
                      kinds: Sequence[str] = ("fft_aggregated", "fourier_entropy"), block: int = BLOCK) -> DataFrame:
    """One row per (id, signal) with the features of ``kinds``; NULL and NaN readings are left out, an empty table is empty."""
    long, _ = prepare_long(df, column_id, column_sort, signals)
    keys = [column_id, SIG]
    base = materialize(S.rank_series(long, keys, [S.T, S.X]).select(*keys, S.RN, S.N, S.X))
    parts = []
    if "fft_aggregated" in kinds:
        parts.append(fft_aggregated(base, keys, block))
    if "fourier_entropy" in kinds:
        parts.append(fourier_entropy(base, keys))
    return parts[0] if len(parts) == 1 else parts[0].join(parts[1], keys)
