"""Time-series features per series, as Spark aggregates.

``extract_features(df, column_id, column_sort)`` treats every other column as a
signal (long input), and returns one row per id with columns
``<signal>__<feature>[__<param>_<value>]``.  Calculator names and semantics
follow the published tsfresh definitions; the parameter grid is our declared
configuration (``FeatureSettings``), not the library's full default grid.

Plan shape (per call): one stats aggregate, one ranking join, one halo shuffle
for neighbours; every order-free and neighbour feature is then a single
``groupBy(series).agg(...)`` (partial aggregation, so hot series are combined
map-side).  Value counts (F7), chunk trends (F13), strikes and mass quantiles
(F14/F16, block prefix scans), top-n (F18) and order patterns (F20) are extra
aggregates joined at series grain.

Rules: NULL/NaN readings are dropped before ordering; ties in the sort column
are broken by the value; a feature undefined for the series length is NULL.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from medfuse.functions import series as S
from medfuse.session import materialize

SIG = "signal"
ALL_GROUPS = ("F1", "F2", "F3", "F4", "F5", "F6", "F7", "F8", "F9", "F10", "F11",
              "F12", "F13", "F14", "F15", "F16", "F17", "F18", "F19", "F20", "F21", "F22")


def _quantile_edges():
    qs = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
    return tuple((lo, hi) for i, lo in enumerate(qs) for hi in qs[i + 1:])


@dataclass(frozen=True)
class FeatureSettings:
    """Declared parameter grid (fixed values, tsfresh calculator parameters)."""
    quantiles: tuple = (0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9)
    count_above: tuple = (0.0,)
    count_below: tuple = (0.0,)
    range_count: tuple = ((-1.0, 1.0), (-1e12, 0.0), (0.0, 1e12))
    value_count: tuple = (0.0, 1.0, -1.0)
    r_sigma: tuple = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 5.0, 6.0, 7.0, 10.0)
    large_std: tuple = tuple(round(r * 0.05, 2) for r in range(1, 20))
    symmetry: tuple = tuple(round(r * 0.05, 2) for r in range(20))
    c3_lags: tuple = (1, 2, 3)
    tras_lags: tuple = (1, 2, 3)
    acf_lags: tuple = tuple(range(10))
    agg_acf_maxlag: int = 40
    agg_acf_funcs: tuple = ("mean", "median", "var")
    pacf_lags: tuple = (1, 2, 3)
    trend_chunks: tuple = (5, 10, 50)
    trend_funcs: tuple = ("max", "min", "mean", "var")
    trend_attrs: tuple = ("rvalue", "intercept", "slope", "stderr")
    crossing_m: tuple = (-1.0, 0.0, 1.0)
    peaks_n: tuple = (1, 3, 5, 10, 50)
    energy_segments: int = 10
    mass_quantiles: tuple = (0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9)
    change_q: tuple = field(default_factory=_quantile_edges)
    change_abs: tuple = (False, True)
    change_aggs: tuple = ("mean", "var")
    n_abs_max: tuple = (7,)
    entropy_bins: tuple = (10,)
    perm_dims: tuple = (3, 4, 5, 6, 7)
    sampen_r: float = 0.2               # sample entropy: m = 2, tolerance 0.2 * std
    apen_m: int = 2
    apen_r: tuple = (0.1, 0.3, 0.5, 0.7, 0.9)
    fft_coeffs: tuple = tuple(range(10))
    fft_attrs: tuple = ("real", "imag", "abs", "angle")
    groups: tuple = ALL_GROUPS
    quantile_buckets: int = 128         # value buckets per series for the exact quantile scan
    chunk_width: float | None = None    # time chunk for ranking (seconds, or sort units)
    block_rows: int = S.DEFAULT_BLOCK_ROWS
    entropy_block_rows: int = 2_048     # rows per block of the entropies: a tile compares at most its square

    def only(self, *groups: str) -> "FeatureSettings":
        return replace(self, groups=tuple(groups))


# ----------------------------------------------------------------------------- naming

def pval(v) -> str:
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        v = round(v, 6)
        if v == int(v) and abs(v) < 1e15:
            v = int(v)
    return str(v).replace("-", "m").replace(".", "_")


def fname(feature: str, **params) -> str:
    return "__".join([feature] + [f"{k}_{pval(v)}" for k, v in params.items()])


# ----------------------------------------------------------------------------- helpers

def _c(name: str) -> Column:
    return F.col(name)


def _div(a, b) -> Column:
    return F.try_divide(a, b)


def _bool(c: Column) -> Column:
    return c.cast("double")


#: Groups with a feature made from quantiles, and groups that need no order of the readings.
QUANTILE_GROUPS = {"F1", "F4", "F6", "F17"}
UNORDERED_GROUPS = {"F1", "F2", "F3", "F4", "F5", "F6"}


def _quantile_list(st: FeatureSettings) -> list[float]:
    if not set(st.groups) & QUANTILE_GROUPS:
        return []
    qs = {0.5, *st.quantiles}
    if "F17" in st.groups:
        for lo, hi in st.change_q:
            qs.update((lo, hi))
    return sorted(qs)


def _qv(qlist, q) -> Column:
    return _c(f"_q{qlist.index(q)}")


def _lr(sxx, syy, sxy, avg_x, avg_y, n) -> dict[str, Column]:
    """Least squares of y on x from moment aggregates (scipy linregress conventions)."""
    slope = _div(sxy, sxx)
    r = F.when((sxx == 0) | (syy == 0), F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(-1.0), _div(sxy, F.sqrt(sxx * syy)))))
    stderr = (F.when(n < 2, F.lit(None).cast("double"))
               .when(n == 2, F.lit(0.0))
               .otherwise(F.sqrt(_div(F.greatest(F.lit(0.0), 1 - r * r) * syy, sxx) / (n - 2))))
    valid = n >= 2
    return {"slope": F.when(valid, slope),
            "intercept": F.when(valid, avg_y - slope * avg_x),
            "rvalue": F.when(valid, r),
            "stderr": stderr}


# ----------------------------------------------------------------------------- preparation

def prepare_long(df: DataFrame, column_id: str, column_sort: str | None,
                 signals: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Wide readings -> long (id, t, signal, x).

    One rule for bad readings, for every feature: a reading without a time, and a
    value that is NULL, NaN or infinite, does not count.
    """
    if column_sort is None or column_sort not in df.columns:
        raise ValueError("a sort column is required; use operators.clean.dummy_time first")
    signals = signals or [c for c in df.columns if c not in (column_id, column_sort)
                          and isinstance(df.schema[c].dataType, NumericType)]
    if not signals:
        raise ValueError("no numeric signal columns")
    wide = df.select(_c(column_id), _c(column_sort).alias(S.T),
                     *[_c(s).cast("double").alias(s) for s in signals])
    long = wide.unpivot([column_id, S.T], signals, SIG, S.X)
    finite = _c(S.X).isNotNull() & ~F.isnan(_c(S.X)) & (F.abs(_c(S.X)) < float("inf"))
    return long.where(finite & _c(S.T).isNotNull()), signals


def series_stats(long: DataFrame, keys: list[str], st: FeatureSettings) -> DataFrame:
    """One row per series: n, moments, extremes, first time, sum |x| and the quantiles.

    Quantiles leave as scalar columns ``_q0..`` so every later aggregate that
    carries them keeps fixed-width buffers (hash aggregation, whole-stage codegen).
    Exact quantiles never gather a series in one buffer (see ``exact_quantiles``);
    they are left out when no group of ``st`` uses one.
    """
    x = _c(S.X)
    qs = _quantile_list(st)
    b = st.quantile_buckets
    extra = [F.percentile_approx(x, [i / b for i in range(1, b)], 10 * b).alias("_bounds")] if qs else []
    agg = long.groupBy(*keys).agg(
        F.count(x).alias(S.N), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
        F.var_pop(x).alias("var"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.min(S.T).alias("t0"), F.sum(F.abs(x)).alias("abs_sum"), *extra)
    base = stat_cols(st)[:len(stat_cols(st)) - len(qs)]
    if not qs:
        return agg.select(*keys, *base)
    exact = exact_quantiles(long, keys, agg.select(*keys, S.N, "_bounds"), qs, b - 1)
    return agg.select(*keys, *base).join(exact, keys, "inner")


def exact_quantiles(long: DataFrame, keys: list[str], bounds: DataFrame, qs: list[float],
                    n_bounds: int) -> DataFrame:
    """Exact linear-interpolation quantiles ``_q0..`` per series, skew-safe.

    (series, value) counts (duplicates collapse map-side) -> bucket by the
    series' approximate quantile bounds -> running count per (series, bucket)
    plus the bucket offsets -> the order statistics at floor/ceil of (n-1)q.
    Work per task is bounded by a bucket, never a whole series.
    Interpolation follows Spark's ``percentile``.
    """
    vc = (long.groupBy(*keys, S.X).agg(F.count(F.lit(1)).alias("_c"))
              .join(bounds, keys, "inner").withColumn("_b", F.lit(0)))
    # bucket = number of bounds below the value, by binary search over the sorted
    # bounds (log2 steps of compiled comparisons, no per-element lambda)
    step = 1 << max(0, max(1, n_bounds).bit_length() - 1)
    while step >= 1:
        nxt = _c("_b") + step
        vc = vc.withColumn("_b", F.when(F.try_element_at("_bounds", nxt) < _c(S.X), nxt).otherwise(_c("_b")))
        step //= 2
    run = Window.partitionBy(*keys, "_b").orderBy(S.X).rowsBetween(Window.unboundedPreceding, 0)
    local = vc.select(*keys, "_b", S.X, "_c", S.N, F.sum("_c").over(run).alias("_cl"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = (vc.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bt"))
              .select(*keys, "_b", F.coalesce(F.sum("_bt").over(before), F.lit(0)).alias("_bo")))
    cum = (local.join(offs, [*keys, "_b"], "inner")
                .select(*keys, S.X, S.N, (_c("_bo") + _c("_cl") - _c("_c")).alias("_below"),
                        (_c("_bo") + _c("_cl")).alias("_upto")))

    aggs, fin = [], []
    for i, q in enumerate(qs):   # SQL text: one JVM call per expression
        pos = f"(CAST({S.N} - 1 AS DOUBLE) * {q!r}D)"
        for tag, k in (("lo", f"floor({pos})"), ("hi", f"ceil({pos})")):
            aggs.append(F.expr(f"max(CASE WHEN _below <= {k} AND {k} < _upto THEN {S.X} END)").alias(f"_{tag}{i}"))
        fin.append(f"CASE WHEN floor({pos}) = ceil({pos}) OR _lo{i} = _hi{i} THEN _lo{i} "
                   f"ELSE (ceil({pos}) - {pos}) * _lo{i} + ({pos} - floor({pos})) * _hi{i} END AS _q{i}")
    return cum.groupBy(*keys).agg(F.max(S.N).alias(S.N), *aggs).selectExpr(*keys, *fin)


def stat_cols(st: FeatureSettings) -> list[str]:
    return [S.N, "mean", "std", "var", "min", "max", "t0", "abs_sum",
            *[f"_q{i}" for i in range(len(_quantile_list(st)))]]


def needed_neighbors(st: FeatureSettings) -> tuple[list[int], list[int]]:
    g = set(st.groups)
    lags, leads = set(), set()
    if g & {"F8", "F15", "F17"}:
        lags.add(1)
    if "F9" in g:
        for l in (*st.c3_lags, *st.tras_lags):
            leads.update((l, 2 * l))
    if "F10" in g or "F11" in g:
        leads.update(l for l in st.acf_lags if l > 0)
        leads.update(range(1, st.agg_acf_maxlag + 1))
        leads.update(range(1, max(st.pacf_lags, default=0) + 1))
    if "F20" in g:
        leads.update(range(1, max(st.perm_dims) if st.perm_dims else 1))
    if "F21" in g:
        leads.update(range(1, max(3, st.apen_m + 1)))
    return sorted(lags), sorted(leads)


# ----------------------------------------------------------------------------- groups on the main pass

#: Single-pass groups that share one aggregate where several are asked for: the driver plans and compiles one bunch at a time.
BUNCHES = (("F1", "F2", "F3", "F4", "F5", "F6"), ("F8", "F9"), ("F10", "F11"), ("F12", "F13", "F15", "F16"), ("F17",), ("F19", "F22"))


JOINED = 4          # written parts that one plan joins


def _main_aggs(st: FeatureSettings, is_time: bool, groups: Iterable[str] | None = None) -> tuple[list[Column], list[Column], list[Column]]:
    """(aggregates over rows, per-series intermediates, final expressions) for the single-pass groups of ``st``, or those of ``groups``."""
    g = set(st.groups) & set(st.groups if groups is None else groups)
    x, rn, n, mean, std, var = _c(S.X), _c(S.RN), _c(S.N), _c("mean"), _c("std"), _c("var")
    mn, mx = _c("min"), _c("max")
    qlist = _quantile_list(st)
    aggs: list[Column] = [F.max(c).alias(c) for c in stat_cols(st)]
    fin: list[Column] = []
    pre: list[Column] = []
    i = (rn - 1).cast("double")

    def at(k):  # value at row number k (Column)
        return F.max(F.when(rn == k, x))

    if g & {"F1", "F2"}:
        aggs += [F.sum(x).alias("_sum"), F.sum(x * x).alias("_sumsq")]
    if "F1" in g:
        fin += [n.cast("double").alias("length"), _c("_sum").alias("sum_values"), mean.alias("mean"),
                _qv(qlist, 0.5).alias("median"), mn.alias("minimum"), mx.alias("maximum"),
                F.greatest(F.abs(mn), F.abs(mx)).alias("absolute_maximum")]
    if "F2" in g:
        fin += [var.alias("variance"), std.alias("standard_deviation"),
                F.sqrt(_c("_sumsq") / n).alias("root_mean_square"), _c("_sumsq").alias("abs_energy"),
                _div(std, mean).alias("variation_coefficient")]
    if "F3" in g:
        aggs += [F.skewness(x).alias("_g1"), F.kurtosis(x).alias("_g2")]
        nd = n.cast("double")
        fin += [F.when(n < 3, F.lit(None).cast("double")).when(var == 0, F.lit(0.0))
                 .otherwise(_c("_g1") * F.sqrt(nd * (nd - 1)) / (nd - 2)).alias("skewness"),
                F.when(n < 4, F.lit(None).cast("double")).when(var == 0, F.lit(0.0))
                 .otherwise((nd - 1) / ((nd - 2) * (nd - 3)) * ((nd + 1) * _c("_g2") + 6)).alias("kurtosis")]
    if "F4" in g:
        fin += [_qv(qlist, q).alias(fname("quantile", q=q)) for q in st.quantiles]
    if "F5" in g:
        for t in st.count_above:
            a = fname("count_above", t=t)
            aggs.append(F.count_if(x >= t).alias("_" + a))
            fin.append((_c("_" + a) / n).alias(a))
        for t in st.count_below:
            a = fname("count_below", t=t)
            aggs.append(F.count_if(x <= t).alias("_" + a))
            fin.append((_c("_" + a) / n).alias(a))
        for lo, hi in st.range_count:
            a = fname("range_count", max=hi, min=lo)
            aggs.append(F.count_if((x >= lo) & (x < hi)).alias("_" + a))
            fin.append(_c("_" + a).cast("double").alias(a))
        for v in st.value_count:
            a = fname("value_count", value=v)
            aggs.append(F.count_if(x == v).alias("_" + a))
            fin.append(_c("_" + a).cast("double").alias(a))
    if "F6" in g:
        aggs += [F.count_if(x > mean).alias("_cam"), F.count_if(x < mean).alias("_cbm")]
        fin += [_c("_cam").cast("double").alias("count_above_mean"),
                _c("_cbm").cast("double").alias("count_below_mean")]
        for r in st.r_sigma:
            a = fname("ratio_beyond_r_sigma", r=r)
            aggs.append(F.count_if(F.abs(x - mean) > F.lit(r) * std).alias("_" + a))
            fin.append((_c("_" + a) / n).alias(a))
        fin += [_bool(std > F.lit(r) * (mx - mn)).alias(fname("large_standard_deviation", r=r))
                for r in st.large_std]
        fin += [_bool(F.abs(mean - _qv(qlist, 0.5)) < F.lit(r) * (mx - mn)).alias(fname("symmetry_looking", r=r))
                for r in st.symmetry]
        fin.append(_bool(var > std).alias("variance_larger_than_standard_deviation"))
    if "F8" in g or "F17" in g:
        d = x - _c("lag_1")
    if "F8" in g:
        zn = F.when(std != 0, (x - mean) / std - (_c("lag_1") - mean) / std)
        aggs += [F.sum(F.abs(d)).alias("_asc"), F.avg(F.abs(d)).alias("_mac"),
                 F.sum(d * d).alias("_cid"), F.sum(zn * zn).alias("_cidn"),
                 at(1).alias("_x1"), F.max(F.when(rn == n, x)).alias("_xn")]
        fin += [F.coalesce(_c("_asc"), F.lit(0.0)).alias("absolute_sum_of_changes"),
                _c("_mac").alias("mean_abs_change"),
                F.when(n > 1, (_c("_xn") - _c("_x1")) / (n - 1)).alias("mean_change"),
                F.when(std == 0, F.lit(0.0)).otherwise(F.sqrt(F.coalesce(_c("_cidn"), F.lit(0.0))))
                 .alias(fname("cid_ce", normalize=True)),
                F.sqrt(F.coalesce(_c("_cid"), F.lit(0.0))).alias(fname("cid_ce", normalize=False))]
    if "F9" in g:
        aggs += [at(1).alias("_m1"), at(2).alias("_m2"), F.max(F.when(rn == n - 1, x)).alias("_mn1"),
                 F.max(F.when(rn == n, x)).alias("_mn")]
        fin.append(F.when(n > 2, (_c("_mn") - _c("_mn1") - _c("_m2") + _c("_m1")) / (2.0 * (n - 2)))
                   .alias("mean_second_derivative_central"))
        for l in st.c3_lags:
            a = fname("c3", lag=l)
            aggs.append(F.avg(x * _c(f"lead_{l}") * _c(f"lead_{2 * l}")).alias("_" + a))
            fin.append(F.when(2 * l >= n, F.lit(0.0)).otherwise(_c("_" + a)).alias(a))
        for l in st.tras_lags:
            a = fname("time_reversal_asymmetry_statistic", lag=l)
            one, two = _c(f"lead_{l}"), _c(f"lead_{2 * l}")
            aggs.append(F.avg(two * two * one - one * x * x).alias("_" + a))
            fin.append(F.when(2 * l >= n, F.lit(0.0)).otherwise(_c("_" + a)).alias(a))
    if "F10" in g or "F11" in g:
        lags = sorted({*st.acf_lags, *range(1, st.agg_acf_maxlag + 1), *range(1, max(st.pacf_lags, default=0) + 1)})
        for l in lags:
            other = x if l == 0 else _c(f"lead_{l}")
            aggs.append(F.sum((x - mean) * (other - mean)).alias(f"_acs{l}"))

        def acf(l):
            return F.when((n >= l) & (F.abs(var) > 1e-8),
                          _div(F.coalesce(_c(f"_acs{l}"), F.lit(0.0)), (n - l) * var))
    if "F10" in g:
        fin += [acf(l).alias(fname("autocorrelation", lag=l)) for l in st.acf_lags]
        # the acf array is materialised once per series (``pre``); the lambdas below
        # reference nothing but their own arguments, so no outer expression is
        # re-evaluated per element (higher-order functions are interpreted)
        pre.append(F.filter(F.array(*[F.when(n > l, acf(l)) for l in range(1, st.agg_acf_maxlag + 1)]),
                            lambda v: v.isNotNull()).alias("_aarr"))
        arr = _c("_aarr")
        degenerate = (F.abs(var) < 1e-10) | (n == 1)
        k = F.size(arr)
        m = F.aggregate(arr, F.lit(0.0), lambda a, v: a + v) / k
        srt = F.array_sort(arr)
        med = F.when(k % 2 == 1, F.element_at(srt, ((k + 1) / 2).cast("int"))).otherwise(
            (F.element_at(srt, (k / 2).cast("int")) + F.element_at(srt, (k / 2).cast("int") + 1)) / 2.0)
        vv = F.greatest(F.aggregate(arr, F.lit(0.0), lambda a, v: a + v * v) / k - m * m, F.lit(0.0))
        for fn_name, val in (("mean", m), ("median", med), ("var", vv)):
            if fn_name in st.agg_acf_funcs:
                fin.append(F.when(degenerate, F.lit(0.0)).otherwise(F.when(k > 0, val))
                           .alias(fname("agg_autocorrelation", f_agg=fn_name, maxlag=st.agg_acf_maxlag)))
    if "F11" in g and st.pacf_lags:
        kmax = max(st.pacf_lags)
        r = F.array(*[acf(l) for l in range(1, kmax + 1)])
        pac = _durbin_levinson(r, kmax)
        fin += [F.when((n > 1) & (n > l), F.element_at(pac, l)).alias(fname("partial_autocorrelation", lag=l))
                for l in st.pacf_lags]
    if "F12" in g:
        # positions of the extremes from the per-series max/min already on every row
        # (fixed-width buffers keep the whole aggregate on the hash path)
        aggs += [F.min(F.when(x == mx, rn)).alias("_fmax"), F.max(F.when(x == mx, rn)).alias("_lmax"),
                 F.min(F.when(x == mn, rn)).alias("_fmin"), F.max(F.when(x == mn, rn)).alias("_lmin")]
        fin += [((_c("_fmax") - 1) / n).alias("first_location_of_maximum"),
                (_c("_lmax") / n).alias("last_location_of_maximum"),
                ((_c("_fmin") - 1) / n).alias("first_location_of_minimum"),
                (_c("_lmin") / n).alias("last_location_of_minimum")]
    if "F13" in g:
        aggs += [F.regr_sxx(x, i).alias("_lsxx"), F.regr_syy(x, i).alias("_lsyy"),
                 F.regr_sxy(x, i).alias("_lsxy"), F.avg(i).alias("_lax")]
        lr = _lr(_c("_lsxx"), _c("_lsyy"), _c("_lsxy"), _c("_lax"), mean, n)
        fin += [lr[a].alias(fname("linear_trend", attr=a)) for a in st.trend_attrs]
        if is_time:
            hrs = (F.unix_micros(_c(S.T).cast("timestamp")) - F.unix_micros(_c("t0").cast("timestamp"))) / 3.6e9
            aggs += [F.regr_sxx(x, hrs).alias("_tsxx"), F.regr_syy(x, hrs).alias("_tsyy"),
                     F.regr_sxy(x, hrs).alias("_tsxy"), F.avg(hrs).alias("_tax")]
            lt = _lr(_c("_tsxx"), _c("_tsyy"), _c("_tsxy"), _c("_tax"), mean, n)
            fin += [lt[a].alias(fname("linear_trend_timewise", attr=a)) for a in st.trend_attrs]
    if "F15" in g:
        for m_ in st.crossing_m:
            a = fname("number_crossing_m", m=m_)
            aggs.append(F.count_if(_c("lag_1").isNotNull() & ((x > m_) != (_c("lag_1") > m_))).alias("_" + a))
            fin.append(_c("_" + a).cast("double").alias(a))
        for k in st.peaks_n:
            a = fname("number_peaks", n=k)
            cond = (rn > k) & (rn <= n - k) & (x > _c(f"back_{k}")) & (x > _c(f"ahead_{k}"))
            aggs.append(F.count_if(cond).alias("_" + a))
            fin.append(_c("_" + a).cast("double").alias(a))
    if "F16" in g:
        ns = st.energy_segments
        ii = rn - 1
        q, r_ = (n / ns).cast("long"), n % ns
        seg = F.when(ii < r_ * (q + 1), (ii / (q + 1)).cast("long")).otherwise(
            r_ + ((ii - r_ * (q + 1)) / F.greatest(q, F.lit(1))).cast("long"))
        aggs.append(F.sum(x * x).alias("_energy"))
        for s in range(ns):
            a = fname("energy_ratio_by_chunks", num_segments=ns, segment_focus=s)
            aggs.append(F.sum(F.when(seg == s, x * x)).alias("_" + a))
            fin.append(_div(F.coalesce(_c("_" + a), F.lit(0.0)), _c("_energy")).alias(a))
    if "F17" in g:
        for lo, hi in st.change_q:
            qlo, qhi = _qv(qlist, lo), _qv(qlist, hi)
            inside = (x >= qlo) & (x <= qhi) & (_c("lag_1") >= qlo) & (_c("lag_1") <= qhi)
            for isabs in st.change_abs:
                dv = F.abs(d) if isabs else d
                for fa in st.change_aggs:
                    a = fname("change_quantiles", f_agg=fa, isabs=isabs, qh=hi, ql=lo)
                    agg = F.avg if fa == "mean" else F.var_pop
                    aggs.append(agg(F.when(inside, dv)).alias("_" + a))
                    fin.append(F.when(qlo == qhi, F.lit(0.0)).otherwise(F.coalesce(_c("_" + a), F.lit(0.0))).alias(a))
    if "F19" in g:
        for bins in st.entropy_bins:
            b = _hist_bin(x, mn, mx, bins)
            cnts = [F.count_if(b == k) for k in range(bins)]
            a = fname("binned_entropy", max_bins=bins)
            for k, cc in enumerate(cnts):
                aggs.append(cc.alias(f"_{a}_{k}"))
            ent = reduce(lambda acc, k: acc + F.when(_c(f"_{a}_{k}") > 0, -(_c(f"_{a}_{k}") / n) * F.ln(_c(f"_{a}_{k}") / n))
                         .otherwise(F.lit(0.0)), range(bins), F.lit(0.0))
            fin.append(ent.alias(a))
        dig = first_digit(x)
        for dd in range(1, 10):
            aggs.append(F.avg((dig == dd).cast("double")).alias(f"_bf{dd}"))
        fin.append(_benford_corr([_c(f"_bf{dd}") for dd in range(1, 10)]).alias("benford_correlation"))
    if "F22" in g:
        for k in st.fft_coeffs:
            ang = F.lit(2.0 * math.pi * k) * i / n
            aggs += [F.sum(x * F.cos(ang)).alias(f"_fre{k}"), F.sum(x * F.sin(ang)).alias(f"_fim{k}")]
            valid = F.lit(k) <= (n / 2).cast("long")
            re, im = _c(f"_fre{k}"), -_c(f"_fim{k}")
            vals = {"real": re, "imag": im, "abs": F.sqrt(re * re + im * im),
                    "angle": F.degrees(F.atan2(F.round(im, 9), F.round(re, 9)))}
            fin += [F.when(valid, vals[a]).alias(fname("fft_coefficient", attr=a, coeff=k)) for a in st.fft_attrs]
    return aggs, pre, fin


def _hist_bin(x: Column, mn: Column, mx: Column, bins: int) -> Column:
    """numpy.histogram bin index with edges linspace(min, max, bins+1), top edge inclusive."""
    width = mx - mn
    step = width / bins
    raw = F.least(((x - mn) * (F.lit(float(bins)) / width)).cast("long"), F.lit(bins - 1))
    edge = lambda k: k * step + mn
    adj = (F.when(x < edge(raw), raw - 1)
            .when((x >= F.when(raw + 1 == bins, mx).otherwise(edge(raw + 1))) & (raw != bins - 1), raw + 1)
            .otherwise(raw))
    return F.when(width == 0, F.lit(bins // 2)).otherwise(adj)


def first_digit(x: Column) -> Column:
    """Leading digit of |x| from its shortest decimal form (0 for x = 0)."""
    s = F.regexp_extract(F.abs(x).cast("string"), "[1-9]", 0)
    return F.coalesce(s.try_cast("int"), F.lit(0))


def _benford_corr(freqs: list[Column]) -> Column:
    ben = [math.log10(1 + 1 / d) for d in range(1, 10)]
    bmean = sum(ben) / 9
    fmean = reduce(lambda a, b: a + b, freqs) / 9.0
    num = reduce(lambda a, b: a + b, [(f - fmean) * (b - bmean) for f, b in zip(freqs, ben)])
    sf = reduce(lambda a, b: a + b, [(f - fmean) * (f - fmean) for f in freqs])
    sb = sum((b - bmean) ** 2 for b in ben)
    return _div(num, F.sqrt(sf * F.lit(sb)))


def _durbin_levinson(r: Column, kmax: int) -> Column:
    """PACF 1..kmax from autocorrelations r[1..kmax] as an array fold."""
    init = F.struct(F.array().cast("array<double>").alias("phi"), F.array().cast("array<double>").alias("pac"))

    def step(acc, k):
        phi = acc.getField("phi")
        prev = F.when(k > 1, F.sequence(F.lit(1), k - 1)).otherwise(F.array().cast("array<int>"))
        num = F.element_at(r, k) - F.aggregate(
            prev, F.lit(0.0), lambda s, j: s + F.element_at(phi, j) * F.element_at(r, k - j))
        den = F.lit(1.0) - F.aggregate(prev, F.lit(0.0), lambda s, j: s + F.element_at(phi, j) * F.element_at(r, j))
        pkk = F.try_divide(num, den)
        new_phi = F.concat(F.transform(prev, lambda j: F.element_at(phi, j) - pkk * F.element_at(phi, k - j)),
                           F.array(pkk))
        return F.struct(new_phi.alias("phi"), F.concat(acc.getField("pac"), F.array(pkk)).alias("pac"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(kmax)), init, step, lambda acc: acc.getField("pac"))


# ----------------------------------------------------------------------------- extra passes

def _value_counts(base: DataFrame, keys: list[str]) -> DataFrame:
    """F7 from a (series, value) count table: two partial aggregations."""
    vc = base.groupBy(*keys, S.X).agg(F.count(F.lit(1)).alias("c"))
    x, c = _c(S.X), _c("c")
    rep = c > 1
    agg = vc.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_d"), F.sum(c).alias("_n"), F.count_if(rep).alias("_rv"),
        F.sum(F.when(rep, c)).alias("_rp"), F.sum(F.when(rep, x)).alias("_srv"),
        F.sum(F.when(rep, x * c)).alias("_srp"), F.max_by(c, x).alias("_cmax"), F.min_by(c, x).alias("_cmin"))
    return agg.select(
        *keys,
        _bool(_c("_d") < _c("_n")).alias("has_duplicate"),
        _bool(_c("_cmax") >= 2).alias("has_duplicate_max"),
        _bool(_c("_cmin") >= 2).alias("has_duplicate_min"),
        (_c("_d") / _c("_n")).alias("ratio_value_number_to_time_series_length"),
        (_c("_rv") / _c("_d")).alias("percentage_of_reoccurring_values_to_all_values"),
        (F.coalesce(_c("_rp"), F.lit(0)) / _c("_n")).alias("percentage_of_reoccurring_datapoints_to_all_datapoints"),
        F.coalesce(_c("_srv"), F.lit(0.0)).alias("sum_of_reoccurring_values"),
        F.coalesce(_c("_srp"), F.lit(0.0)).alias("sum_of_reoccurring_data_points"))


def _agg_trend(base: DataFrame, keys: list[str], st: FeatureSettings) -> DataFrame:
    """F13 agg_linear_trend: aggregate chunks of L readings, regress on chunk index."""
    parts = [base.select(*keys, F.lit(L).alias("L"), ((_c(S.RN) - 1) / L).cast("long").alias("ci"), _c(S.X), _c(S.N))
             for L in st.trend_chunks]
    chunks = reduce(DataFrame.unionByName, parts).groupBy(*keys, "L", "ci").agg(
        F.max(S.X).alias("max"), F.min(S.X).alias("min"), F.avg(S.X).alias("mean"),
        F.var_pop(S.X).alias("var"), F.max(S.N).alias(S.N))
    aggs, fin = [F.max(S.N).alias(S.N)], []
    for L in st.trend_chunks:
        ci = F.when(_c("L") == L, _c("ci").cast("double"))
        aggs.append(F.count(ci).alias(f"_m{L}"))
        for fa in st.trend_funcs:
            y = F.when(_c("L") == L, _c(fa))
            p = f"_{fa}{L}"
            aggs += [F.regr_sxx(y, ci).alias(p + "sxx"), F.regr_syy(y, ci).alias(p + "syy"),
                     F.regr_sxy(y, ci).alias(p + "sxy"), F.avg(ci).alias(p + "ax"), F.avg(y).alias(p + "ay")]
            lr = _lr(_c(p + "sxx"), _c(p + "syy"), _c(p + "sxy"), _c(p + "ax"), _c(p + "ay"), _c(f"_m{L}"))
            for a in st.trend_attrs:
                fin.append(F.when(_c(S.N) > L, lr[a]).alias(
                    fname("agg_linear_trend", attr=a, chunk_len=L, f_agg=fa)))
    return chunks.groupBy(*keys).agg(*aggs).select(*keys, *fin)


def _scans(nb: DataFrame, keys: list[str], st: FeatureSettings) -> DataFrame:
    """F14 strikes (running max of last non-member row) and F16 index mass quantiles (running sum)."""
    g = set(st.groups)
    x, rn, mean = _c(S.X), _c(S.RN), _c("mean")
    ex = {}
    if "F14" in g:
        ex["_lna"] = ("max", F.when(~(x > mean), rn).otherwise(F.lit(0)))
        ex["_lnb"] = ("max", F.when(~(x < mean), rn).otherwise(F.lit(0)))
    if "F16" in g:
        ex["_cabs"] = ("sum", F.abs(x))
    sc = S.prefix_scan(nb, keys, ex, st.block_rows)
    aggs, fin = [F.max(S.N).alias(S.N), F.max("abs_sum").alias("abs_sum")], []
    if "F14" in g:
        aggs += [F.max(F.when(x > mean, rn - _c("_lna"))).alias("_sa"),
                 F.max(F.when(x < mean, rn - _c("_lnb"))).alias("_sb")]
        fin += [F.coalesce(_c("_sa"), F.lit(0)).cast("double").alias("longest_strike_above_mean"),
                F.coalesce(_c("_sb"), F.lit(0)).cast("double").alias("longest_strike_below_mean")]
    if "F16" in g:
        for q in st.mass_quantiles:
            a = fname("index_mass_quantile", q=q)
            aggs.append(F.min(F.when(_div(_c("_cabs"), _c("abs_sum")) >= q, rn)).alias("_" + a))
            fin.append(F.when(_c("abs_sum") != 0, _c("_" + a) / _c(S.N)).alias(a))
    return sc.groupBy(*keys).agg(*aggs).select(*keys, *fin)


def _top_abs(nb: DataFrame, keys: list[str], st: FeatureSettings) -> DataFrame:
    """F18 mean of the k largest |x|: top-k per block, then per super-block, then per series."""
    kmax = max(st.n_abs_max)
    ax = F.abs(_c(S.X))
    w1 = Window.partitionBy(*keys, S.BLK).orderBy(F.col("ax").desc())
    lvl1 = (nb.select(*keys, S.BLK, _c(S.N), ax.alias("ax"))
              .withColumn("_r", F.row_number().over(w1))
              .where(_c("_r") <= kmax).withColumn("_sb", (_c(S.BLK) / 4096).cast("long")))
    w2 = Window.partitionBy(*keys, "_sb").orderBy(F.col("ax").desc())
    lvl2 = lvl1.withColumn("_r2", F.row_number().over(w2)).where(_c("_r2") <= kmax)
    top = lvl2.groupBy(*keys).agg(F.max(S.N).alias(S.N),
                                   F.slice(F.sort_array(F.collect_list("ax"), asc=False), 1, kmax).alias("_top"))
    fin = []
    for k in st.n_abs_max:
        vals = F.slice(_c("_top"), 1, k)
        fin.append(F.when(_c(S.N) > k, F.aggregate(vals, F.lit(0.0), lambda a, v: a + v) / k)
                   .alias(fname("mean_n_absolute_max", number_of_maxima=k)))
    return top.select(*keys, *fin)


def _perm_entropy(nb: DataFrame, keys: list[str], st: FeatureSettings) -> DataFrame:
    """F20 permutation entropy (tau = 1): order-pattern counts per series and dimension."""
    vals = [_c(S.X)] + [_c(f"lead_{k}") for k in range(1, max(st.perm_dims))]
    pats = []
    for d in st.perm_dims:
        window = F.array(*[F.struct(vals[j].alias("v"), F.lit(j).alias("i")) for j in range(d)])
        pattern = F.array_join(F.transform(F.array_sort(window), lambda s: s.getField("i").cast("string")), ",")
        pats.append(F.when(vals[d - 1].isNotNull(), F.struct(F.lit(d).alias("d"), pattern.alias("p"))))
    ex = nb.select(*keys, F.explode(F.array_compact(F.array(*pats))).alias("w"))
    cnt = ex.groupBy(*keys, _c("w.d").alias("d"), _c("w.p").alias("p")).agg(F.count(F.lit(1)).alias("c"))
    tot = Window.partitionBy(*keys, "d")
    ent = (cnt.withColumn("_p", _c("c") / F.sum("c").over(tot))
              .groupBy(*keys, "d").agg((-F.sum(_c("_p") * F.ln(_c("_p")))).alias("h")))
    return ent.groupBy(*keys).agg(*[F.max(F.when(_c("d") == d, _c("h"))).alias(fname("permutation_entropy", dimension=d, tau=1))
                                    for d in st.perm_dims])


def _entropies(nb: DataFrame, keys: list[str], st: FeatureSettings) -> DataFrame:
    """F21 sample entropy (m = 2) and approximate entropy (m, r) by tiles of template pairs.

    Both count, per template (x_i .. x_i+L-1), the templates within Chebyshev
    distance r = factor * std, itself included.  A series is cut into blocks of
    ``entropy_block_rows`` row numbers and every block meets every block, so a
    tile holds a bounded number of pairs and a long series spreads over many
    tasks.  A pair is compared once for all lengths and tolerances: a row goes to
    as many tiles as its series has blocks (one, for a short series), and counts
    leave the tile, never pairs.
    """
    m, b = st.apen_m, int(st.entropy_block_rows)
    dims = max(3, m + 1)
    lengths = sorted({2, 3, m, m + 1})
    factors = sorted({st.sampen_r, *st.apen_r})
    vals = [S.X] + [f"lead_{d}" for d in range(1, dims)]
    own, blocks = f"CAST(floor(({S.RN} - 1) / {b}) AS INT)", f"sequence(0, CAST(floor(({S.N} - 1) / {b}) AS INT))"
    t = nb.where(_c(S.N) >= lengths[0])
    ask = t.select(*keys, F.expr(own).alias("_ba"), F.expr(f"explode({blocks})").alias("_bb"), S.RN, S.N, "std",
                   *[_c(v).alias(f"_p{d}") for d, v in enumerate(vals)])
    other = t.select(*keys, F.expr(f"explode({blocks})").alias("_ba"), F.expr(own).alias("_bb"),
                     *[_c(v).alias(f"_o{d}") for d, v in enumerate(vals)])
    # distance of the first L values; NULL where either template would pass the end of its series
    far = F.abs(_c("_p0") - _c("_o0"))
    dist = {1: far}
    for d in range(1, dims):
        step = F.abs(_c(f"_p{d}") - _c(f"_o{d}"))
        dist[d + 1] = F.when(dist[d] > step, dist[d]).otherwise(step)
    pairs = ask.join(other, [*keys, "_ba", "_bb"], "inner").select(
        *keys, S.RN, S.N, "std", *[dist[L].alias(f"_d{L}") for L in lengths])
    names = {(f, L): f"_c{i}_{L}" for i, f in enumerate(factors) for L in lengths}
    per_t = pairs.groupBy(*keys, S.RN).agg(
        F.max(S.N).alias(S.N), *[F.count_if(_c(f"_d{L}") <= F.lit(f) * _c("std")).alias(name) for (f, L), name in names.items()])
    whole = {L: _c(S.RN) <= _c(S.N) - L + 1 for L in lengths}
    per_s = per_t.groupBy(*keys).agg(
        F.max(S.N).alias(S.N), *[F.count_if(whole[L]).alias(f"_K{L}") for L in lengths],
        *[F.sum(F.when(whole[L], _c(names[st.sampen_r, L]))).alias(f"_s{L}") for L in (2, 3)],
        *[F.sum(F.when(whole[L], F.ln(_c(names[r, L])))).alias(f"_l{i}_{L}") for i, r in enumerate(st.apen_r) for L in (m, m + 1)])

    def phi(i, L):
        return _div(_c(f"_l{i}_{L}"), _c(f"_K{L}")) - F.ln(_c(f"_K{L}"))

    a, b2 = (F.coalesce(_c(f"_s{L}"), F.lit(0)) - _c(f"_K{L}") for L in (3, 2))
    # pairs of length 2 of which none goes on: infinite; without a pair of length 2: undefined
    fin = [F.when(b2 > 0, F.when(a > 0, -F.ln(a / b2)).otherwise(F.lit(float("inf")))).alias("sample_entropy")]
    fin += [F.when(_c(S.N) <= m + 1, F.lit(0.0)).otherwise(F.abs(phi(i, m) - phi(i, m + 1)))
            .alias(fname("approximate_entropy", m=m, r=r)) for i, r in enumerate(st.apen_r)]
    return per_s.select(*keys, *fin)


# ----------------------------------------------------------------------------- entry points

def series_features(long: DataFrame, keys: list[str], st: FeatureSettings, is_time: bool) -> DataFrame:
    """Per-series feature table (one row per ``keys``) for the long frame (t, x)."""
    g = set(st.groups)
    if g <= UNORDERED_GROUPS:
        # no order, no neighbours: the statistics meet the readings once
        aggs, pre, fin = _main_aggs(st, is_time)
        joined = long.join(series_stats(long, keys, st), keys)
        return joined.groupBy(*keys).agg(*aggs).select("*", *pre).select(*keys, *fin)
    branches = len(g & {"F7", "F13", "F14", "F16", "F18", "F20", "F21"})
    stats = series_stats(long, keys, st)
    if branches:
        stats = materialize(stats)
    base = S.rank_series(long, keys, [S.T, S.X], st.chunk_width, stats)
    if branches > 1:
        base = materialize(base)
    lags, leads = needed_neighbors(st)
    spans = st.peaks_n if "F15" in g else ()
    need_nb = bool(lags or leads or spans) or bool(g & {"F14", "F16", "F18"})
    nb = S.with_neighbors(base, keys, S.X, lags, leads, st.block_rows, spans) if need_nb else base
    if (branches > 1 or "F21" in g) and need_nb:
        nb = materialize(nb)
    parts = []
    for bunch in BUNCHES if branches > 1 else [ALL_GROUPS]:
        aggs, pre, fin = _main_aggs(st, is_time, bunch)
        if fin:
            parts.append(nb.groupBy(*keys).agg(*aggs).select("*", *pre).select(*keys, *fin))
    if "F7" in g:
        parts.append(_value_counts(base, keys))
    if "F13" in g and st.trend_chunks:
        parts.append(_agg_trend(base, keys, st))
    if g & {"F14", "F16"}:
        parts.append(_scans(nb, keys, st))
    if "F18" in g:
        parts.append(_top_abs(nb, keys, st))
    if "F20" in g:
        parts.append(_perm_entropy(nb, keys, st))
    if "F21" in g:
        parts.append(_entropies(nb, keys, st))
    if not parts:
        raise ValueError("no feature group selected")
    if len(parts) == 1:
        return parts[0]
    # every part is written by a plan of its own, and a few of them are joined at a time, so no plan on the driver holds
    # the expressions of all; a part has one row per series at most, and the statistics have them all
    parts = [materialize(p) for p in parts]
    while len(parts) > JOINED:
        parts = [materialize(_beside(stats.select(*keys), parts[i:i + JOINED], keys)) for i in range(0, len(parts), JOINED)]
    return _beside(stats.select(*keys), parts, keys)


def _beside(series: DataFrame, parts: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys, "left"), parts, series)


def extract_features(df: DataFrame, column_id: str = "Patient_ID", column_sort: str = "time",
                     signals: list[str] | None = None,
                     settings: FeatureSettings | None = None) -> DataFrame:
    """Wide feature table: one row per id, ``<signal>__<feature>`` columns."""
    st = settings or FeatureSettings()
    long, signals = prepare_long(df, column_id, column_sort, signals)
    is_time = not isinstance(df.schema[column_sort].dataType, NumericType)
    feats = series_features(long, [column_id, SIG], st, is_time)
    names = [c for c in feats.columns if c not in (column_id, SIG)]
    if len(signals) == 1:
        return feats.select(_c(column_id), *[_c(c).alias(f"{signals[0]}__{c}") for c in names])
    wide = feats.groupBy(column_id).pivot(SIG, signals).agg(*[F.first(c).alias(c) for c in names])
    return wide.select(_c(column_id), *[_c(f"{s}_{c}").alias(f"{s}__{c}") for s in signals for c in names])
