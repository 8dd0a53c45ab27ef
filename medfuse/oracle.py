"""DuckDB SQL for the registered queries (the correctness oracle).

The SQL restates each operator independently with plain window functions over
the driver's pre-registered tables.  Every output double is rounded to 6 places
on both sides (``medfuse.functions.exprs.round_doubles``).
"""

from __future__ import annotations

import math

from medfuse.functions.tsfeatures import FeatureSettings, fname
from medfuse.sources import fixtures as fx

DIGITS = 6
HALF = 0.5 - 2.0 ** -20   # see medfuse.functions.exprs.round_doubles


def lit(v: float) -> str:
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def rnd(expr: str, alias: str) -> str:
    return f"{rnd_expr(expr)} AS \"{alias}\""


def rnd_expr(expr: str) -> str:
    x = f"CAST({expr} AS DOUBLE)"
    return (f"CASE WHEN abs({x}) < 1e12 THEN floor({x} * 1e{DIGITS} + {HALF!r}) / 1e{DIGITS} + 0.0 "
            f"ELSE {x} + 0.0 END")


# ----------------------------------------------------------------------------- modality views

LABELS_CTE = f"""lab AS (
  SELECT user_id AS Patient_ID,
         CAST(avg(value) > {fx.CVD_THRESHOLD} AS INTEGER) AS CVD_Presence,
         (epoch_us(min(ts) FILTER (WHERE value > {fx.EVENT_THRESHOLD}))
           - epoch_us(TIMESTAMP '{fx.EVENT_ORIGIN}')) / 86400000000.0 AS Time_To_Event
  FROM events GROUP BY user_id)"""

EHR_CTE = f"""ehr AS (
  SELECT c.c_custkey AS Patient_ID,
         CASE WHEN c.c_custkey % {fx.ACCTBAL_NULL_EVERY} <> 0 THEN c.c_acctbal END AS acctbal,
         c.c_nationkey AS nationkey, c.c_mktsegment AS mktsegment, lab.CVD_Presence, lab.Time_To_Event
  FROM customer c LEFT JOIN lab ON lab.Patient_ID = c.c_custkey)"""

IMAGING_CTE = "imaging AS (SELECT vec_id AS Patient_ID, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(fx.ORACLE_IMAGING_DIMS)) + " FROM embeddings)"

WEARABLES_CTE = f"""wearables AS (
  SELECT user_id AS Patient_ID, ts AS time,
         CASE WHEN event_id % {fx.VALUE_NULL_EVERY} <> 0 THEN value END AS value FROM events)"""

WEARABLES_RAW_CTE = "wearables_raw AS (SELECT user_id AS Patient_ID, ts AS time, value FROM events)"

GENOMIC_CTE = "genomic AS (SELECT o_custkey AS Patient_ID, " + ", ".join(
    f"CAST(count(*) FILTER (WHERE o_orderpriority = '{p}') AS INTEGER) AS g{i + 1}"
    for i, p in enumerate(fx.PRIORITIES)) + " FROM orders GROUP BY o_custkey)"

MODALITY_CTES = ",\n".join([LABELS_CTE, EHR_CTE, IMAGING_CTE, WEARABLES_CTE, WEARABLES_RAW_CTE, GENOMIC_CTE])

SCORE_CTE = """scores AS (
  SELECT l_orderkey AS order_key, l_linenumber AS line, CAST(l_returnflag = 'R' AS INTEGER) AS label,
         round(l_discount * 5 + l_tax, 4) AS p, l_quantity AS y, l_extendedprice / 1000.0 AS y_hat
  FROM lineitem)"""


def with_modalities(body: str, *extra_ctes: str) -> str:
    ctes = ",\n".join([MODALITY_CTES, *extra_ctes])
    return f"WITH {ctes}\n{body}"


# ----------------------------------------------------------------------------- time-series features

def series_cte(source: str, st: FeatureSettings, lags=(), leads=()) -> str:
    """s: one row per reading with rn, n, per-series stats, lags and leads."""
    lag_cols = "".join(f", lag(x, {k}) OVER w AS lag_{k}" for k in lags)
    lead_cols = "".join(f", lead(x, {k}) OVER w AS lead_{k}" for k in leads)
    return f"""s0 AS (SELECT Patient_ID, time AS t, CAST(value AS DOUBLE) AS x FROM {source}
         WHERE value IS NOT NULL AND NOT isnan(value)),
s AS (SELECT Patient_ID, t, x, row_number() OVER w AS rn, count(*) OVER p AS n,
         avg(x) OVER p AS mean, stddev_pop(x) OVER p AS std, var_pop(x) OVER p AS var,
         min(x) OVER p AS mn, max(x) OVER p AS mx, min(t) OVER p AS t0,
         quantile_cont(x, 0.5) OVER p AS med, sum(abs(x)) OVER p AS abs_sum{lag_cols}{lead_cols}
      FROM s0 WINDOW p AS (PARTITION BY Patient_ID), w AS (PARTITION BY Patient_ID ORDER BY t, x))"""


def _lr_sql(sxx, syy, sxy, ax, ay, n):
    r = (f"CASE WHEN ({sxx}) = 0 OR ({syy}) = 0 THEN 0.0 ELSE "
         f"least(1.0, greatest(-1.0, ({sxy}) / sqrt(({sxx}) * ({syy})))) END")
    return {
        "slope": f"CASE WHEN {n} >= 2 THEN ({sxy}) / nullif({sxx}, 0) END",
        "intercept": f"CASE WHEN {n} >= 2 THEN ({ay}) - ({sxy}) / nullif({sxx}, 0) * ({ax}) END",
        "rvalue": f"CASE WHEN {n} >= 2 THEN {r} END",
        "stderr": (f"CASE WHEN {n} < 2 THEN NULL WHEN {n} = 2 THEN 0.0 ELSE "
                   f"sqrt(greatest(0.0, 1 - ({r}) * ({r})) * ({syy}) / nullif({sxx}, 0) / ({n} - 2)) END"),
    }


def feature_sql(group: str, st: FeatureSettings | None = None, source: str = "wearables_raw",
                prefix: str = "", pre_ctes: tuple = (), finite: bool = False) -> str:
    """Oracle SQL for one feature group on a (Patient_ID, time, value) view.

    ``finite``: an infinite sample entropy is NULL, as in the patient feature matrix.
    """
    def R(expr, alias):
        return rnd(expr, prefix + alias)

    st = (st or FeatureSettings()).only(group)
    sel: list[str] = []
    lags, leads, extra, tail = [], [], [], "FROM s GROUP BY Patient_ID"
    n = "any_value(n)"
    if group == "F1":
        sel = [R(f"{n}", "length"), R("sum(x)", "sum_values"), R("avg(x)", "mean"),
               R("quantile_cont(x, 0.5)", "median"), R("min(x)", "minimum"), R("max(x)", "maximum"),
               R("max(abs(x))", "absolute_maximum")]
    elif group == "F2":
        sel = [R("var_pop(x)", "variance"), R("stddev_pop(x)", "standard_deviation"),
               R("sqrt(avg(x * x))", "root_mean_square"), R("sum(x * x)", "abs_energy"),
               R("stddev_pop(x) / nullif(avg(x), 0)", "variation_coefficient")]
    elif group == "F3":
        sel = [R(f"CASE WHEN {n} < 3 THEN NULL WHEN var_pop(x) = 0 THEN 0.0 ELSE skewness(x) END", "skewness"),
               R(f"CASE WHEN {n} < 4 THEN NULL WHEN var_pop(x) = 0 THEN 0.0 ELSE kurtosis(x) END", "kurtosis")]
    elif group == "F4":
        sel = [R(f"quantile_cont(x, {lit(q)})", fname("quantile", q=q)) for q in st.quantiles]
    elif group == "F5":
        sel = [R(f"count_if(x >= {lit(t)}) / {n}", fname("count_above", t=t)) for t in st.count_above]
        sel += [R(f"count_if(x <= {lit(t)}) / {n}", fname("count_below", t=t)) for t in st.count_below]
        sel += [R(f"count_if(x >= {lit(lo)} AND x < {lit(hi)})", fname("range_count", max=hi, min=lo))
                for lo, hi in st.range_count]
        sel += [R(f"count_if(x = {lit(v)})", fname("value_count", value=v)) for v in st.value_count]
    elif group == "F6":
        sel = [R("count_if(x > mean)", "count_above_mean"), R("count_if(x < mean)", "count_below_mean")]
        sel += [R(f"count_if(abs(x - mean) > {lit(r)} * std) / {n}", fname("ratio_beyond_r_sigma", r=r))
                for r in st.r_sigma]
        sel += [R(f"CAST(any_value(std) > {lit(r)} * (any_value(mx) - any_value(mn)) AS INTEGER)",
                    fname("large_standard_deviation", r=r)) for r in st.large_std]
        sel += [R(f"CAST(abs(any_value(mean) - any_value(med)) < {lit(r)} * (any_value(mx) - any_value(mn)) AS INTEGER)",
                    fname("symmetry_looking", r=r)) for r in st.symmetry]
        sel.append(R("CAST(any_value(var) > any_value(std) AS INTEGER)", "variance_larger_than_standard_deviation"))
    elif group == "F7":
        extra = ["""vc AS (SELECT Patient_ID, x, count(*) AS c FROM s GROUP BY Patient_ID, x)"""]
        tail = "FROM vc GROUP BY Patient_ID"
        sel = [R("CAST(count(*) < sum(c) AS INTEGER)", "has_duplicate"),
               R("CAST(arg_max(c, x) >= 2 AS INTEGER)", "has_duplicate_max"),
               R("CAST(arg_min(c, x) >= 2 AS INTEGER)", "has_duplicate_min"),
               R("count(*) / sum(c)", "ratio_value_number_to_time_series_length"),
               R("count_if(c > 1) / count(*)", "percentage_of_reoccurring_values_to_all_values"),
               R("coalesce(sum(c) FILTER (WHERE c > 1), 0) / sum(c)",
                   "percentage_of_reoccurring_datapoints_to_all_datapoints"),
               R("coalesce(sum(x) FILTER (WHERE c > 1), 0)", "sum_of_reoccurring_values"),
               R("coalesce(sum(x * c) FILTER (WHERE c > 1), 0)", "sum_of_reoccurring_data_points")]
    elif group == "F8":
        lags = [1]
        sel = [R("coalesce(sum(abs(x - lag_1)), 0)", "absolute_sum_of_changes"),
               R("avg(abs(x - lag_1))", "mean_abs_change"),
               R(f"CASE WHEN {n} > 1 THEN (max(x) FILTER (WHERE rn = n) - max(x) FILTER (WHERE rn = 1)) / ({n} - 1) END",
                   "mean_change"),
               R("CASE WHEN any_value(std) = 0 THEN 0.0 ELSE sqrt(coalesce(sum(((x - mean) / std - (lag_1 - mean) / std)"
                   " * ((x - mean) / std - (lag_1 - mean) / std)), 0)) END", fname("cid_ce", normalize=True)),
               R("sqrt(coalesce(sum((x - lag_1) * (x - lag_1)), 0))", fname("cid_ce", normalize=False))]
    elif group == "F9":
        leads = sorted({k for l in (*st.c3_lags, *st.tras_lags) for k in (l, 2 * l)})
        at = lambda cond: f"max(x) FILTER (WHERE {cond})"
        sel = [R(f"CASE WHEN {n} > 2 THEN ({at('rn = n')} - {at('rn = n - 1')} - {at('rn = 2')} + {at('rn = 1')})"
                   f" / (2.0 * ({n} - 2)) END", "mean_second_derivative_central")]
        sel += [R(f"CASE WHEN {2 * l} >= {n} THEN 0.0 ELSE avg(x * lead_{l} * lead_{2 * l}) END", fname("c3", lag=l))
                for l in st.c3_lags]
        sel += [R(f"CASE WHEN {2 * l} >= {n} THEN 0.0 ELSE avg(lead_{2 * l} * lead_{2 * l} * lead_{l} - lead_{l} * x * x) END",
                    fname("time_reversal_asymmetry_statistic", lag=l)) for l in st.tras_lags]
    elif group in ("F10", "F11"):
        kmax = max(st.pacf_lags) if group == "F11" else max(max(st.acf_lags), st.agg_acf_maxlag)
        leads = list(range(1, kmax + 1))

        def acf(l):
            other = "x" if l == 0 else f"lead_{l}"
            return (f"CASE WHEN {n} >= {l} AND abs(any_value(var)) > 1e-8 THEN "
                    f"coalesce(sum((x - mean) * ({other} - mean)), 0) / nullif(({n} - {l}) * any_value(var), 0) END")
        if group == "F10":
            sel = [R(acf(l), fname("autocorrelation", lag=l)) for l in st.acf_lags]
            arr = "list_filter([" + ", ".join(f"CASE WHEN {n} > {l} THEN {acf(l)} END"
                                                for l in range(1, st.agg_acf_maxlag + 1)) + "], lambda v: v IS NOT NULL)"
            deg = f"abs(any_value(var)) < 1e-10 OR {n} = 1"
            for fa, agg in (("mean", "avg"), ("median", "median"), ("var", "var_pop")):
                sel.append(R(f"CASE WHEN {deg} THEN 0.0 ELSE list_aggregate({arr}, '{agg}') END",
                               fname("agg_autocorrelation", f_agg=fa, maxlag=st.agg_acf_maxlag)))
        else:
            extra = ["r AS (SELECT Patient_ID, any_value(n) AS n, " +
                     ", ".join(f"{acf(l)} AS r{l}" for l in range(1, kmax + 1)) + " FROM s GROUP BY Patient_ID)"]
            tail = "FROM r"
            n = "n"
            # Durbin-Levinson unrolled for lags 1..3
            p1 = "r1"
            p2 = "(r2 - r1 * r1) / nullif(1 - r1 * r1, 0)"
            phi21 = f"(r1 - ({p2}) * r1)"
            p3 = f"(r3 - {phi21} * r2 - ({p2}) * r1) / nullif(1 - {phi21} * r1 - ({p2}) * r2, 0)"
            pac = {1: p1, 2: p2, 3: p3}
            sel = [R(f"CASE WHEN n > 1 AND n > {l} THEN {pac[l]} END", fname("partial_autocorrelation", lag=l))
                   for l in st.pacf_lags]
    elif group == "F12":
        sel = [R(f"(min(rn) FILTER (WHERE x = mx) - 1) / {n}", "first_location_of_maximum"),
               R(f"max(rn) FILTER (WHERE x = mx) / {n}", "last_location_of_maximum"),
               R(f"(min(rn) FILTER (WHERE x = mn) - 1) / {n}", "first_location_of_minimum"),
               R(f"max(rn) FILTER (WHERE x = mn) / {n}", "last_location_of_minimum")]
    elif group == "F13":
        i = "CAST(rn - 1 AS DOUBLE)"
        lr = _lr_sql(f"regr_sxx(x, {i})", f"regr_syy(x, {i})", f"regr_sxy(x, {i})", f"avg({i})", "avg(x)", n)
        sel = [R(lr[a], fname("linear_trend", attr=a)) for a in st.trend_attrs]
        h = "(epoch_us(t) - epoch_us(t0)) / 3.6e9"
        lt = _lr_sql(f"regr_sxx(x, {h})", f"regr_syy(x, {h})", f"regr_sxy(x, {h})", f"avg({h})", "avg(x)", n)
        sel += [R(lt[a], fname("linear_trend_timewise", attr=a)) for a in st.trend_attrs]
        parts = []
        for L in st.trend_chunks:
            parts.append(f"""SELECT Patient_ID, {L} AS L, (rn - 1) // {L} AS ci, max(x) AS "max", min(x) AS "min",
                 avg(x) AS "mean", var_pop(x) AS "var", any_value(n) AS n FROM s GROUP BY Patient_ID, (rn - 1) // {L}""")
        extra = ["ch AS (" + " UNION ALL ".join(parts) + ")",
                 "ltr AS (SELECT Patient_ID, " + ", ".join(sel) + " FROM s GROUP BY Patient_ID)"]
        sel2 = []
        for L in st.trend_chunks:
            for fa in st.trend_funcs:
                y, ci = f"CASE WHEN L = {L} THEN \"{fa}\" END", f"CASE WHEN L = {L} THEN CAST(ci AS DOUBLE) END"
                m = f"count({ci})"
                lr = _lr_sql(f"regr_sxx({y}, {ci})", f"regr_syy({y}, {ci})", f"regr_sxy({y}, {ci})",
                             f"avg({ci})", f"avg({y})", m)
                sel2 += [R(f"CASE WHEN any_value(n) > {L} THEN {lr[a]} END",
                             fname("agg_linear_trend", attr=a, chunk_len=L, f_agg=fa)) for a in st.trend_attrs]
        extra.append("atr AS (SELECT Patient_ID, " + ", ".join(sel2) + " FROM ch GROUP BY Patient_ID)")
        sel = ["ltr.* EXCLUDE (Patient_ID)", "atr.* EXCLUDE (Patient_ID)"]
        tail = "FROM ltr JOIN atr USING (Patient_ID)"
    elif group == "F14":
        extra = ["""fl AS (SELECT Patient_ID, rn, CASE WHEN x > mean THEN 1 WHEN x < mean THEN -1 ELSE 0 END AS f FROM s)""",
                 """isl AS (SELECT Patient_ID, f, rn - row_number() OVER (PARTITION BY Patient_ID, f ORDER BY rn) AS g FROM fl)""",
                 """runs AS (SELECT Patient_ID, f, count(*) AS len FROM isl GROUP BY Patient_ID, f, g)"""]
        tail = "FROM (SELECT DISTINCT Patient_ID FROM s) ids LEFT JOIN runs USING (Patient_ID) GROUP BY Patient_ID"
        sel = [R("coalesce(max(len) FILTER (WHERE f = 1), 0)", "longest_strike_above_mean"),
               R("coalesce(max(len) FILTER (WHERE f = -1), 0)", "longest_strike_below_mean")]
    elif group == "F15":
        kmax = max(st.peaks_n)
        lags = list(range(1, kmax + 1))
        leads = list(range(1, kmax + 1))
        sel = [R(f"count_if(lag_1 IS NOT NULL AND ((x > {lit(m)}) <> (lag_1 > {lit(m)})))", fname("number_crossing_m", m=m))
               for m in st.crossing_m]
        for k in st.peaks_n:
            cond = " AND ".join([f"lag_{k} IS NOT NULL AND lead_{k} IS NOT NULL"] +
                                [f"x > lag_{j} AND x > lead_{j}" for j in range(1, k + 1)])
            sel.append(R(f"count_if({cond})", fname("number_peaks", n=k)))
    elif group == "F16":
        ns = st.energy_segments
        extra = [f"""sg AS (SELECT *, n // {ns} AS q, n % {ns} AS r,
                  sum(abs(x)) OVER (PARTITION BY Patient_ID ORDER BY rn ROWS UNBOUNDED PRECEDING) AS cabs FROM s)""",
                 """sg2 AS (SELECT *, CASE WHEN rn - 1 < r * (q + 1) THEN (rn - 1) // (q + 1)
                   ELSE r + (rn - 1 - r * (q + 1)) // greatest(q, 1) END AS seg FROM sg)"""]
        tail = "FROM sg2 GROUP BY Patient_ID"
        sel = [R(f"coalesce(sum(x * x) FILTER (WHERE seg = {s_}), 0) / nullif(sum(x * x), 0)",
                   fname("energy_ratio_by_chunks", num_segments=ns, segment_focus=s_)) for s_ in range(ns)]
        sel += [R(f"CASE WHEN any_value(abs_sum) <> 0 THEN min(rn) FILTER (WHERE cabs / abs_sum >= {lit(q)}) / {n} END",
                    fname("index_mass_quantile", q=q)) for q in st.mass_quantiles]
    elif group == "F17":
        lags = [1]
        qs = sorted({q for pair in st.change_q for q in pair})
        extra = ["qq AS (SELECT Patient_ID, " + ", ".join(
            f"quantile_cont(x, {lit(q)}) AS q{int(round(q * 100))}" for q in qs) + " FROM s GROUP BY Patient_ID)",
                 "sq AS (SELECT * FROM s JOIN qq USING (Patient_ID))"]
        tail = "FROM sq GROUP BY Patient_ID"
        for lo, hi in st.change_q:
            ql, qh = f"q{int(round(lo * 100))}", f"q{int(round(hi * 100))}"
            inside = f"x >= {ql} AND x <= {qh} AND lag_1 >= {ql} AND lag_1 <= {qh}"
            for isabs in st.change_abs:
                d = "abs(x - lag_1)" if isabs else "(x - lag_1)"
                for fa in st.change_aggs:
                    agg = "avg" if fa == "mean" else "var_pop"
                    sel.append(R(f"CASE WHEN any_value({ql}) = any_value({qh}) THEN 0.0 ELSE "
                                   f"coalesce({agg}({d}) FILTER (WHERE {inside}), 0) END",
                                   fname("change_quantiles", f_agg=fa, isabs=isabs, qh=hi, ql=lo)))
    elif group == "F18":
        k = max(st.n_abs_max)
        extra = [f"""tk AS (SELECT Patient_ID, n, abs(x) AS ax,
                 row_number() OVER (PARTITION BY Patient_ID ORDER BY abs(x) DESC) AS r FROM s)"""]
        tail = "FROM tk GROUP BY Patient_ID"
        sel = [R(f"CASE WHEN any_value(n) > {kk} THEN avg(ax) FILTER (WHERE r <= {kk}) END",
                   fname("mean_n_absolute_max", number_of_maxima=kk)) for kk in st.n_abs_max]
        del k
    elif group == "F19":
        sel = []
        for bins in st.entropy_bins:
            w = "(mx - mn)"
            raw = f"least(CAST(trunc((x - mn) * ({float(bins)} / {w})) AS BIGINT), {bins - 1})"
            edge = lambda kk: f"(({kk}) * ({w} / {bins}) + mn)"
            nxt = f"CASE WHEN {raw} + 1 = {bins} THEN mx ELSE {edge(raw + ' + 1')} END"
            b = (f"CASE WHEN {w} = 0 THEN {bins // 2} WHEN x < {edge(raw)} THEN {raw} - 1 "
                 f"WHEN x >= {nxt} AND {raw} <> {bins - 1} THEN {raw} + 1 ELSE {raw} END")
            extra.append(f"hb AS (SELECT Patient_ID, n, {b} AS b FROM s)")
            extra.append("hc AS (SELECT Patient_ID, b, count(*) / any_value(n) AS pr FROM hb GROUP BY Patient_ID, b)")
            extra.append(f"he AS (SELECT Patient_ID, -sum(pr * ln(pr)) AS \"{fname('binned_entropy', max_bins=bins)}\" "
                         "FROM hc GROUP BY Patient_ID)")
        ben = {d: math.log10(1 + 1 / d) for d in range(1, 10)}
        dig = "coalesce(TRY_CAST(regexp_extract(CAST(abs(x) AS VARCHAR), '[1-9]', 0) AS INTEGER), 0)"
        extra.append(f"bd AS (SELECT Patient_ID, {dig} AS d FROM s)")
        extra.append("bf AS (SELECT Patient_ID, d.d, avg(CASE WHEN bd.d = d.d THEN 1.0 ELSE 0.0 END) AS f FROM bd, "
                     "(SELECT unnest(range(1, 10)) AS d) d GROUP BY Patient_ID, d.d)")
        bvals = "CASE " + " ".join(f"WHEN d = {d} THEN {lit(v)}" for d, v in ben.items()) + " END"
        extra.append(f"bc AS (SELECT Patient_ID, corr(f, {bvals}) AS benford_correlation FROM bf GROUP BY Patient_ID)")
        cols = [R(f'"{fname("binned_entropy", max_bins=b_)}"', fname("binned_entropy", max_bins=b_)) for b_ in st.entropy_bins]
        sel = cols + [R("benford_correlation", "benford_correlation")]
        tail = "FROM he JOIN bc USING (Patient_ID)"
        return "WITH " + ",\n".join([MODALITY_CTES, *pre_ctes, series_cte(source, st), *extra]) + \
            "\nSELECT Patient_ID, " + ", ".join(sel) + " " + tail
    elif group == "F20":
        dmax = max(st.perm_dims)
        leads = list(range(1, dmax))
        pats = []
        for d in st.perm_dims:
            vals = ["x"] + [f"lead_{j}" for j in range(1, d)]
            lst = "[" + ", ".join(f"{{'v': {v}, 'i': {j}}}" for j, v in enumerate(vals)) + "]"
            pats.append(f"SELECT Patient_ID, {d} AS d, array_to_string(list_transform(list_sort({lst}), lambda e: e.i), ',') AS pat "
                        f"FROM s WHERE lead_{d - 1} IS NOT NULL")
        extra = ["pt AS (" + " UNION ALL ".join(pats) + ")",
                 "pc AS (SELECT Patient_ID, d, pat, count(*) AS c FROM pt GROUP BY ALL)",
                 "pe AS (SELECT Patient_ID, d, -sum(c / tot * ln(c / tot)) AS h FROM "
                 "(SELECT *, sum(c) OVER (PARTITION BY Patient_ID, d) AS tot FROM pc) GROUP BY Patient_ID, d)"]
        tail = "FROM (SELECT DISTINCT Patient_ID FROM s) ids LEFT JOIN pe USING (Patient_ID) GROUP BY Patient_ID"
        sel = [R(f"max(h) FILTER (WHERE d = {d})", fname("permutation_entropy", dimension=d, tau=1)) for d in st.perm_dims]
    elif group == "F22":
        sel = []
        for k in st.fft_coeffs:
            ang = f"(({lit(2.0 * math.pi * k)} * CAST(rn - 1 AS DOUBLE)) / n)"
            re, im = f"sum(x * cos({ang}))", f"(-sum(x * sin({ang})))"
            valid = f"{k} <= {n} // 2"
            vals = {"real": re, "imag": im, "abs": f"sqrt({re} * {re} + {im} * {im})",
                    "angle": f"degrees(atan2(round({im}, 9), round({re}, 9)))"}
            sel += [R(f"CASE WHEN {valid} THEN {vals[a]} END", fname("fft_coefficient", attr=a, coeff=k))
                    for a in st.fft_attrs]
    elif group == "F21":
        # brute force: every template against every template of its series
        m = st.apen_m
        leads = list(range(1, max(3, m + 1)))
        dims = max(3, m + 1)
        factors = sorted({st.sampen_r, *st.apen_r})
        lengths = sorted({2, 3, m, m + 1})
        vs = ", ".join(f"CASE WHEN L > {d} THEN {'x' if d == 0 else f'lead_{d}'} ELSE 0.0 END AS v{d}" for d in range(dims))
        dist = "greatest(" + ", ".join(f"abs(a.v{d} - b.v{d})" for d in range(dims)) + ")"
        extra = [
            "fl AS (SELECT unnest([" + ", ".join(f"{f!r}::DOUBLE" for f in factors) + "]) AS f)",
            "ll AS (SELECT unnest([" + ", ".join(str(L) for L in lengths) + "]) AS L)",
            f"tt AS (SELECT Patient_ID, f, L, rn, n, f * std AS r, {vs} FROM s, fl, ll WHERE rn <= n - L + 1)",
            f"""cnt AS (SELECT a.Patient_ID, a.f, a.L, a.rn, any_value(a.n) AS n, count(*) AS C
                 FROM tt a JOIN tt b ON a.Patient_ID = b.Patient_ID AND a.f = b.f AND a.L = b.L
                 WHERE {dist} <= a.r GROUP BY ALL)""",
            """pl AS (SELECT Patient_ID, f, L, any_value(n) AS n, count(*) AS K, sum(C) - count(*) AS pairs,
                 sum(ln(C)) / count(*) - ln(count(*)) AS phi FROM cnt GROUP BY ALL)"""]
        tail = "FROM pl GROUP BY Patient_ID"

        def pick(f, L, c):
            return f"max({c}) FILTER (WHERE f = {f!r}::DOUBLE AND L = {L})"
        b, a = pick(st.sampen_r, 2, "pairs"), f"coalesce({pick(st.sampen_r, 3, 'pairs')}, 0)"
        none = f"OR {a} = 0 THEN NULL" if finite else f"THEN NULL WHEN {a} = 0 THEN 'inf'::DOUBLE"
        sel = [R(f"CASE WHEN {b} IS NULL OR {b} = 0 {none} "
                 f"ELSE -ln({a} / {b}) END", "sample_entropy")]
        sel += [R(f"CASE WHEN max(n) <= {m + 1} THEN 0.0 ELSE abs({pick(r, m, 'phi')} - {pick(r, m + 1, 'phi')}) END",
                  fname("approximate_entropy", m=m, r=r)) for r in st.apen_r]
    else:
        raise KeyError(group)
    ctes = [MODALITY_CTES, *pre_ctes, series_cte(source, st, lags, leads), *extra]
    return "WITH " + ",\n".join(ctes) + "\nSELECT Patient_ID, " + ", ".join(sel) + " " + tail
