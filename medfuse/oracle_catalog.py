"""Oracle SQL per registered query name (see ``medfuse.plans.catalog``)."""

from __future__ import annotations

from medfuse import oracle as O
from medfuse.operators.rounds import LOSSES
from medfuse.operators.split import threshold_hex
from medfuse.plans.catalog import (ABLATION_SETTINGS, DECLARED_CLASS, DECLARED_INTERCEPTS, DECLARED_TIME, FEATURE_QUERIES, FIXED_NODES,
                                   ROUND_FEATURES, ROUND_MODALITIES, ROUND_SETTINGS, STACK_FIRST, STACK_FOLDS, STACK_SECOND)


# ----------------------------------------------------------------------------- P, R, J, slice 1
from medfuse.oracle import MODALITY_CTES, SCORE_CTE, feature_sql, rnd, rnd_expr  # noqa: E402
from medfuse.sources import fixtures as fx  # noqa: E402

# Columns of the fixture modality views: (name, is_floating)
MOD_COLS = {
    "ehr": [("Patient_ID", False), ("acctbal", True), ("nationkey", False), ("mktsegment", False),
            ("CVD_Presence", False), ("Time_To_Event", True)],
    "imaging": [("Patient_ID", False)] + [(f"e{i}", True) for i in range(fx.ORACLE_IMAGING_DIMS)],
    "wearables": [("Patient_ID", False), ("time", False), ("value", True)],
    "genomic": [("Patient_ID", False)] + [(f"g{i + 1}", False) for i in range(len(fx.PRIORITIES))],
}


def _w(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([MODALITY_CTES, *ctes]) + "\n" + body


def _miss(c: str, flt: bool) -> str:
    return f'("{c}" IS NULL OR isnan("{c}"))' if flt else f'("{c}" IS NULL)'


def _p1() -> str:
    parts = []
    for m, cols in MOD_COLS.items():
        for i, (c, flt) in enumerate(cols):
            parts.append(f"""SELECT '{c}' AS "column", {i} AS position, count(*) AS n,
                count_if({_miss(c, flt)}) AS n_missing, {rnd_expr(f'count_if({_miss(c, flt)}) / count(*)')} AS rate,
                '{m}' AS modality FROM {m}""")
    return _w(" UNION ALL ".join(parts))


def _p2() -> str:
    parts = []
    for m, cols in MOD_COLS.items():
        pat = " || ".join(f"CASE WHEN {_miss(c, flt)} THEN '1' ELSE '0' END" for c, flt in cols)
        parts.append(f"SELECT {pat} AS pattern, count(*) AS n, '{m}' AS modality FROM {m} GROUP BY 1")
    return _w(" UNION ALL ".join(parts))


def _impute_select(m: str, src: str | None = None, prefix: str = "") -> str:
    """Mean-imputed modality (numeric non-key non-label columns to DOUBLE), rounded."""
    src = src or m
    out = []
    for c, flt in MOD_COLS[m]:
        if c == "Patient_ID":
            out.append("Patient_ID")
        elif c in ("CVD_Presence",):
            out.append(f'"{c}"')
        elif c == "Time_To_Event":
            out.append(rnd('"Time_To_Event"', "Time_To_Event"))
        elif c in ("mktsegment", "time"):
            out.append(f'"{c}" AS "{prefix}{c}"')
        else:
            x = f"CAST(\"{c}\" AS DOUBLE)"
            clean = f"CASE WHEN isnan({x}) THEN NULL ELSE {x} END"
            out.append(rnd(f"coalesce({clean}, (SELECT avg({clean}) FROM {src}))", f"{prefix}{c}"))
    return "SELECT " + ", ".join(out) + f" FROM {src}"


def _r8_r9() -> str:
    cols = ["Patient_ID"] + [rnd(f'TRY_CAST("{c}" AS DOUBLE)' if c in fx.LABEL_COLS else f'coalesce(TRY_CAST("{c}" AS DOUBLE), 0)', c)
                             for c, _ in MOD_COLS["ehr"] if c != "Patient_ID"]
    return _w("SELECT " + ", ".join(cols) + " FROM ehr")


R10_SQL = f"""WITH v AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN CAST('NaN' AS DOUBLE)
    WHEN event_id % 17 = 0 THEN CAST('inf' AS DOUBLE) WHEN event_id % 19 = 0 THEN CAST('-inf' AS DOUBLE)
    ELSE value END AS value FROM events)
SELECT event_id, {rnd_expr("CASE WHEN isnan(value) THEN 0.0 WHEN value = CAST('inf' AS DOUBLE) THEN 1.7976931348623157e308 "
                            "WHEN value = CAST('-inf' AS DOUBLE) THEN -1.7976931348623157e308 ELSE value END")} AS value FROM v"""

R12_SQL = _w("""SELECT Patient_ID, CVD_Presence, CAST(list_transform(range(0, (SELECT max(CVD_Presence) + 1 FROM ehr)),
    lambda i: CASE WHEN i = CVD_Presence THEN 1.0 ELSE 0.0 END) AS DOUBLE[]) AS CVD_Presence_onehot FROM ehr""")

R13_SQL = f"""SELECT user_id AS Patient_ID, event_id, {rnd('value', 'value')},
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS time FROM events"""

R14_SQL = _w(f"""SELECT Patient_ID, CAST(rn - greatest(n - 5, 0) - 1 AS INTEGER) AS position, epoch_us(time) AS time_micros, {rnd('value', 'value')}
    FROM (SELECT *, row_number() OVER (PARTITION BY Patient_ID ORDER BY time, value) AS rn,
                count(*) OVER (PARTITION BY Patient_ID) AS n FROM wearables_raw WHERE value IS NOT NULL)
    WHERE rn > n - 5""")


def _r16() -> str:
    cols = ["Patient_ID"]
    for c, _ in MOD_COLS["imaging"][1:]:
        sd = f"stddev_pop({c}) OVER ()"
        cols.append(rnd(f"CASE WHEN {c} IS NULL THEN NULL WHEN {sd} = 0 THEN 0.0 ELSE ({c} - avg({c}) OVER ()) / {sd} END", c))
    return _w("SELECT " + ", ".join(cols) + " FROM imaging")


R17_SQL = f"""WITH {SCORE_CTE}
SELECT order_key, line, {rnd('p', 'p')}, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS pred_class,
    CASE WHEN p > 1 - p THEN 1 ELSE 0 END AS pred_argmax,
    CASE WHEN p > 0.5 THEN 'Positive' ELSE 'Negative' END AS label_text FROM scores"""


def _prefixed(m: str) -> str:
    cols = ["Patient_ID"] + [(rnd(f'"{c}"', f"{m}_{c}") if flt else f'"{c}" AS "{m}_{c}"')
                             for c, flt in MOD_COLS[m][1:]]
    return f"SELECT {', '.join(cols)} FROM {m} WHERE Patient_ID IS NOT NULL"


def _ehr_rounded() -> str:
    return ("SELECT Patient_ID, " + rnd("acctbal", "acctbal") + ", nationkey, mktsegment, CVD_Presence, "
            + rnd("Time_To_Event", "Time_To_Event") + " FROM ehr WHERE Patient_ID IS NOT NULL")


J1_SQL = _w(f"""SELECT * FROM ({_ehr_rounded()}) e JOIN ({_prefixed('imaging')}) i USING (Patient_ID)
    JOIN ({_prefixed('wearables')}) w USING (Patient_ID) JOIN ({_prefixed('genomic')}) g USING (Patient_ID)""")

J3_SQL = _w(f"""SELECT * FROM ({_ehr_rounded()}) e FULL JOIN ({_prefixed('imaging')}) i USING (Patient_ID)
    FULL JOIN ({_prefixed('genomic')}) g USING (Patient_ID)""")


def _j5() -> str:
    common = " INTERSECT ".join(f"SELECT Patient_ID FROM {m} WHERE Patient_ID IS NOT NULL" for m in MOD_COLS)
    parts = [f"""SELECT '{m}' AS modality, count(DISTINCT Patient_ID) AS n_keys,
        count(DISTINCT Patient_ID) FILTER (WHERE Patient_ID NOT IN (SELECT Patient_ID FROM common)) AS n_lost,
        count_if(Patient_ID IS NULL) AS n_null_key_rows FROM {m}""" for m in MOD_COLS]
    return _w(" UNION ALL ".join(parts), f"common AS ({common})")


def _j2_matrix() -> str:
    """Slice 1: imputed modalities, all wearables feature groups, patient-grain joins."""
    wi = ("wi AS (SELECT Patient_ID, time, coalesce(value, (SELECT avg(value) FROM wearables)) AS value "
          "FROM wearables)")
    from medfuse.functions.tsfeatures import ALL_GROUPS
    feats = " ".join(f"JOIN ({feature_sql(g, source='wi', prefix='value__', pre_ctes=(wi,), finite=True)}) f{i} USING (Patient_ID)"
                     for i, g in enumerate(ALL_GROUPS))
    ehr = _impute_select("ehr")
    img = _impute_select("imaging", prefix="imaging_")
    gen = _impute_select("genomic", prefix="genomic_")
    return _w(f"""SELECT * FROM ({ehr}) e JOIN ({img}) i USING (Patient_ID)
        {feats} JOIN ({gen}) g USING (Patient_ID)""")



# ----------------------------------------------------------------------------- M1-M2, E1-E14
from medfuse.functions.exprs import DOUBLE_EPS  # noqa: E402
from medfuse.operators.metrics import KERAS_EPS  # noqa: E402
from medfuse.operators.split import threshold_hex  # noqa: E402

_SC = f"WITH {SCORE_CTE}, sc AS (SELECT *, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS pred_class FROM scores)\n"

M1_SQL = f"""SELECT c_custkey AS Patient_ID,
  CASE WHEN substr(md5(CAST(c_custkey AS VARCHAR) || ':42'), 1, 8) < '{threshold_hex(0.2)}' THEN 'test'
       WHEN substr(md5(CAST(c_custkey AS VARCHAR) || ':42:val'), 1, 8) < '{threshold_hex(0.2)}' THEN 'validation'
       ELSE 'train' END AS split FROM customer"""

E1_SQL = _SC + f"""SELECT {rnd('avg(CASE WHEN label = pred_class THEN 1.0 ELSE 0.0 END)', 'accuracy')},
  {rnd('coalesce(count_if(label = 1 AND pred_class = 1) / nullif(count_if(pred_class = 1), 0), 0)', 'precision')},
  {rnd('coalesce(count_if(label = 1 AND pred_class = 1) / nullif(count_if(label = 1), 0), 0)', 'recall')},
  {rnd('coalesce(2 * count_if(label = 1 AND pred_class = 1) / nullif(2 * count_if(label = 1 AND pred_class = 1) + count_if(label = 0 AND pred_class = 1) + count_if(label = 1 AND pred_class = 0), 0), 0)', 'f1')},
  count_if(label = 1 AND pred_class = 1) AS tp, count_if(label = 0 AND pred_class = 1) AS fp,
  count_if(label = 1 AND pred_class = 0) AS fn, count_if(label = 0 AND pred_class = 0) AS tn FROM sc"""


def _auc_sql(label: str, score: str, src: str = "sc") -> str:
    return f"""(SELECT sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) AS roc_auc,
        CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM (
      SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM (SELECT {score} AS s, count_if({label} = 1) AS pos, count_if({label} = 0) AS neg
            FROM {src} WHERE {score} IS NOT NULL GROUP BY {score})))"""


E5_SQL = _SC + f"SELECT {rnd('roc_auc', 'roc_auc')}, n_pos, n_neg FROM {_auc_sql('label', 'p')}"

E6_SQL = _SC + f"""SELECT {rnd('(a0.roc_auc + a1.roc_auc) / 2', 'roc_auc_macro')}
  FROM {_auc_sql('1 - label', '1 - p')} a0, {_auc_sql('label', 'p')} a1"""

_MAPE = f"avg(abs((y - y_hat) / CASE WHEN y = 0 THEN {DOUBLE_EPS!r} ELSE y END)) * 100"
_R2 = ("CASE WHEN var_pop(y) * count(y) = 0 THEN CASE WHEN sum((y - y_hat) * (y - y_hat)) = 0 THEN 1.0 ELSE 0.0 END "
       "ELSE 1 - sum((y - y_hat) * (y - y_hat)) / (var_pop(y) * count(y)) END")
E7_SQL = _SC + f"""SELECT {rnd('avg(abs(y - y_hat))', 'mae')}, {rnd('avg((y - y_hat) * (y - y_hat))', 'mse')},
  {rnd('sqrt(avg((y - y_hat) * (y - y_hat)))', 'rmse')}, {rnd(_R2, 'r2')}, {rnd(_MAPE, 'mape')} FROM sc"""

_PC = f"least(greatest(p, {KERAS_EPS!r}), {1 - KERAS_EPS!r})"
_CE = f"avg(-(label * ln({_PC}) + (1 - label) * ln(1 - {_PC})))"
E12_SQL = _SC + f"""SELECT {rnd(_CE, 'cross_entropy')}, {rnd('avg((y - y_hat) * (y - y_hat))', 'mse')},
  {rnd(_CE + ' + avg((y - y_hat) * (y - y_hat))', 'total_loss')} FROM sc"""

E13_SQL = f"""WITH m AS ({E1_SQL.replace(chr(10), ' ')}), a AS ({E5_SQL.replace(chr(10), ' ')}),
  r AS ({E7_SQL.replace(chr(10), ' ')})
SELECT 'accuracy' AS metric, accuracy AS value FROM m UNION ALL SELECT 'precision', precision FROM m
UNION ALL SELECT 'recall', recall FROM m UNION ALL SELECT 'f1', f1 FROM m
UNION ALL SELECT 'roc_auc', roc_auc FROM a UNION ALL SELECT 'mae', mae FROM r UNION ALL SELECT 'mse', mse FROM r
UNION ALL SELECT 'rmse', rmse FROM r UNION ALL SELECT 'r2', r2 FROM r UNION ALL SELECT 'mape', mape FROM r"""

E14_SQL = _SC + "SELECT label, pred_class, count(*) AS n FROM sc GROUP BY label, pred_class"


# ----------------------------------------------------------------------------- X1 / X3 with declared weights
from medfuse.plans.catalog import FIXED_INTERCEPT, FIXED_WEIGHTS  # noqa: E402


def _fixed_contrib_sql() -> str:
    parts = [f"SELECT Patient_ID, {i} AS position, 'e{i}' AS feature, "
             f"{w!r} * (e{i} - (SELECT avg(e{i}) FROM imaging)) AS contribution FROM imaging"
             for i, w in enumerate(FIXED_WEIGHTS)]
    return " UNION ALL ".join(parts)


X1_FIXED_SQL = _w(f"SELECT Patient_ID, position, feature, {rnd('contribution', 'contribution')} FROM ({_fixed_contrib_sql()})")

_BASE = f"({FIXED_INTERCEPT!r} + " + " + ".join(f"{w!r} * (SELECT avg(e{i}) FROM imaging)"
                                                 for i, w in enumerate(FIXED_WEIGHTS)) + ")"
X3_FIXED_SQL = _w(f"""SELECT Patient_ID, feature, {rnd('contribution', 'contribution')},
  row_number() OVER w AS rank, {rnd(_BASE + ' + sum(contribution) OVER (w ROWS UNBOUNDED PRECEDING)', 'cumulative')}
  FROM ({_fixed_contrib_sql()}) WINDOW w AS (PARTITION BY Patient_ID ORDER BY abs(contribution) DESC, position)""")


def _exact_split_sql(table: str, key: str, extra: str, size: float, seed: int) -> str:
    part = "PARTITION BY segment" if extra else ""
    return f"""SELECT Patient_ID{', segment' if extra else ''}, CASE WHEN place <= ceil(n * {size!r}) THEN 'test' ELSE 'train' END AS split FROM (
      SELECT *, row_number() OVER ({part} ORDER BY md5(CAST(Patient_ID AS VARCHAR) || ':{seed}')) AS place, count(*) OVER ({part}) AS n
      FROM (SELECT {key} AS Patient_ID{extra} FROM {table}))"""


R4_SQL = _w(f"""SELECT Patient_ID, {rnd('acctbal', 'acctbal')}, nationkey, 1.5 AS severity, CAST(0 AS DOUBLE) AS Time_To_Event, 'mktsegment' AS left_out
  FROM ehr""")


def _x1_tree() -> str:
    """Shapley values by listing every coalition of a tree's features (the brute-force definition)."""
    import itertools
    import math
    nodes = {(t, n): (f, thr, l, r, v, c) for t, _, n, f, thr, l, r, v, c in FIXED_NODES}
    weights = {t: w for t, w, *_ in FIXED_NODES}

    def said(t, n, known):
        f, thr, l, r, v, c = nodes[t, n]
        if f < 0:
            return f"{v!r}"
        a, b = said(t, l, known), said(t, r, known)
        share = nodes[t, l][5] / c
        return f"CASE WHEN e{f} <= {thr!r} THEN {a} ELSE {b} END" if f in known else f"({share!r} * ({a}) + {1 - share!r} * ({b}))"

    parts, base = {}, []
    for t, w in weights.items():
        used = sorted({nodes[k][0] for k in nodes if k[0] == t and nodes[k][0] >= 0})
        base.append(f"{w!r} * ({said(t, 0, ())})")
        for i in used:
            rest = [u for u in used if u != i]
            for k in range(len(rest) + 1):
                share = math.factorial(k) * math.factorial(len(rest) - k) / math.factorial(len(used))
                for s in itertools.combinations(rest, k):
                    parts.setdefault(i, []).append(f"{w * share!r} * (({said(t, 0, (*s, i))}) - ({said(t, 0, s)}))")
    return _w(" UNION ALL ".join(
        f"SELECT Patient_ID, {i} AS position, 'e{i}' AS feature, {rnd(' + '.join(p), 'contribution')}, {rnd(' + '.join(base), 'base_value')} FROM imaging"
        for i, p in parts.items()))


def _x2_permutation() -> str:
    d = len(FIXED_WEIGHTS)
    margin = " + ".join(f"({w!r} * e{i})" for i, w in enumerate(FIXED_WEIGHTS)) + f" + {FIXED_INTERCEPT!r}"
    ranks = ", ".join(f"row_number() OVER (ORDER BY substr(md5(CAST(Patient_ID AS VARCHAR) || ':42:{s}'), 1, 8), Patient_ID) AS r{s or 'own'}"
                      for s in ["", *map(str, range(d))])
    clip = f"least(greatest(1 / (1 + exp(-m)), {KERAS_EPS!r}), {1 - KERAS_EPS!r})"
    loss = f"avg(-(CVD_Presence * ln({clip}) + (1 - CVD_Presence) * ln(1 - {clip})))"
    each = " UNION ALL ".join(f"SELECT 'e{i}' AS feature, a.CVD_Presence, a.m + {w!r} * (b.e{i} - a.e{i}) AS m FROM r a JOIN r b ON a.rown = b.r{i}"
                              for i, w in enumerate(FIXED_WEIGHTS))
    return _w(f"""SELECT feature, {rnd('loss', 'loss')}, {rnd('loss - (SELECT ' + loss + ' FROM r)', 'importance')}
      FROM (SELECT feature, {loss} AS loss FROM ({each}) GROUP BY feature)""",
              f"r AS (SELECT *, {margin} AS m, {ranks} FROM imaging JOIN (SELECT Patient_ID, CVD_Presence FROM ehr WHERE CVD_Presence IS NOT NULL) USING (Patient_ID))")


# ----------------------------------------------------------------------------- F22: whole spectrum by direct sums
def _spectrum_ctes(key: str) -> str:
    return f"""s AS (SELECT {key} AS id, value AS x, row_number() OVER (PARTITION BY {key} ORDER BY ts, value) - 1 AS i,
      count(*) OVER (PARTITION BY {key}) AS n FROM events WHERE value IS NOT NULL AND NOT isnan(value))"""


def _fft_aggregated(key: str, out: str) -> str:
    c, var = "m1", "(m2 - m1 * m1)"
    values = {"centroid": c, "variance": var, "skew": f"CASE WHEN {var} >= 0.5 THEN (m3 - 3 * m1 * {var} - m1 ** 3) / {var} ** 1.5 END",
              "kurtosis": f"CASE WHEN {var} >= 0.5 THEN (m4 - 4 * m1 * m3 + 6 * m2 * m1 * m1 - 3 * m1) / ({var} * {var}) END"}
    turn = "2 * pi() * CAST((k * i) % n AS DOUBLE) / n"
    moments = ", ".join(f"sum(a * CAST(k AS DOUBLE) ** {m}) / nullif(sum(a), 0) AS m{m}" for m in range(1, 5))
    return f"""WITH {_spectrum_ctes(key)},
    f AS (SELECT id, k, sqrt(sum(x * cos({turn})) ** 2 + sum(x * sin({turn})) ** 2) AS a
      FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM s) GROUP BY id, k),
    m AS (SELECT id, {moments} FROM f GROUP BY id)
    SELECT id AS "{out}", {", ".join(rnd(v, f"fft_aggregated__aggtype_{a}") for a, v in values.items())} FROM m"""


def _fourier_entropy(key: str, out: str) -> str:
    from medfuse.functions.spectrum import BINS, SEGMENT
    turn = "2 * pi() * CAST((k * j) % size AS DOUBLE) / size"
    def place(b):
        # the bins of a histogram between the smallest and the largest value, the last one closed
        return f"least(CAST(floor((q - lo) / (hi - lo) * {b}) AS INTEGER), {b - 1})"
    shares = ", ".join(f"(SELECT -sum(p * ln(p)) FROM (SELECT count(*) / CAST(any_value(z.total) AS DOUBLE) AS p FROM r z WHERE z.id = v.id GROUP BY {place(b)})) AS e{b}"
                       for b in BINS)
    return f"""WITH {_spectrum_ctes(key)},
    l AS (SELECT *, least(n, {SEGMENT}) AS size FROM s),
    g AS (SELECT *, size - size // 2 AS step FROM l),
    w AS (SELECT *, unnest(range(0, (n - size // 2) // step)) AS seg FROM g),
    t AS (SELECT *, i - seg * step AS j FROM w WHERE i >= seg * step AND i < seg * step + size),
    d AS (SELECT id, seg, j, size, (x - avg(x) OVER (PARTITION BY id, seg)) * CASE WHEN size = 1 THEN 1 ELSE 0.5 - 0.5 * cos(2 * pi() * j / size) END AS y FROM t),
    p AS (SELECT id, seg, k, any_value(size) AS size, (sum(y * cos({turn})) ** 2 + sum(y * sin({turn})) ** 2)
        * CASE WHEN k = 0 OR 2 * k = any_value(size) THEN 1 ELSE 2 END AS power
      FROM (SELECT *, unnest(range(0, size // 2 + 1)) AS k FROM d) GROUP BY id, seg, k),
    a AS (SELECT id, k, avg(power) AS power FROM p GROUP BY id, k),
    o AS (SELECT id, k, power / max(power) OVER (PARTITION BY id) AS q FROM a),
    r AS (SELECT *, min(q) OVER (PARTITION BY id) AS lo, max(q) OVER (PARTITION BY id) AS hi, count(*) OVER (PARTITION BY id) AS total FROM o),
    v AS (SELECT id, min(x) < max(x) AS varies FROM s GROUP BY id),
    e AS (SELECT id, varies, {shares} FROM v)
    SELECT id AS "{out}", {", ".join(rnd(f"CASE WHEN varies THEN e{b} END", f"fourier_entropy__bins_{b}") for b in BINS)} FROM e"""


# ----------------------------------------------------------------------------- M6: training rounds
def _rounds_ctes(cols=ROUND_FEATURES, st=ROUND_SETTINGS) -> list[str]:
    """The whole training path by a recursive query: scaled rows, weights of every round, losses, the round it stops at."""
    d = len(cols)
    def dot(head):
        return " + ".join(f"w[{2 * i + head + 1}] * x{i}" for i in range(d)) + f" + w[{2 * d + head + 1}]"
    p, v = f"(1 / (1 + exp(-({dot(0)}))))", f"({dot(1)})"
    errors = (f"({p} - label)", f"(2 * ({v} - y))")
    steps = ", ".join(f"w[{2 * i + h + 1}] - {st.step!r} * avg({errors[h]} * {f'x{i}' if i < d else '1'})" for i in range(d + 1) for h in (0, 1))
    scale = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate([*cols, "Time_To_Event"]))
    xs = ", ".join(f"coalesce(({c} - m{i}) / CASE WHEN s{i} > 2.3e-16 THEN s{i} ELSE 1 END, 0) AS x{i}" for i, c in enumerate(cols))
    ce = f"(greatest({dot(0)}, 0) + ln(1 + exp(-abs({dot(0)}))) - label * ({dot(0)}))"
    part = {"train": "split = 'train'", "valid": "split = 'validation'"}
    losses = ", ".join(f"avg({ce}) FILTER ({f}) AS {n}_cross_entropy, avg(({v} - y) ** 2) FILTER ({f}) AS {n}_mse" for n, f in part.items())
    return [f"""stat AS (SELECT Patient_ID, avg(value) AS w_mean, stddev_pop(value) AS w_std, min(value) AS w_min, max(value) AS w_max
      FROM wearables GROUP BY Patient_ID)""",
            f"""raw AS (SELECT *, CASE WHEN substr(md5(CAST(Patient_ID AS VARCHAR) || ':42'), 1, 8) < '{threshold_hex(0.2)}' THEN 'test'
        WHEN substr(md5(CAST(Patient_ID AS VARCHAR) || ':42:val'), 1, 8) < '{threshold_hex(0.2)}' THEN 'validation' ELSE 'train' END AS split
      FROM ehr JOIN genomic USING (Patient_ID) JOIN imaging USING (Patient_ID) JOIN stat USING (Patient_ID) WHERE CVD_Presence IS NOT NULL AND Time_To_Event IS NOT NULL)""",
            f"scale AS (SELECT {scale} FROM raw WHERE split = 'train')",
            f"data AS (SELECT Patient_ID, split, CVD_Presence AS label, Time_To_Event AS y_raw, (Time_To_Event - m{d}) / s{d} AS y, m{d} AS y_mean, s{d} AS y_std, {xs} FROM raw, scale)",
            f"""weights AS (SELECT 0 AS round, list_transform(range({2 * d + 2}), lambda i: CAST(0 AS DOUBLE)) AS w UNION ALL
      SELECT round + 1, [{steps}] FROM weights, data WHERE split = 'train' AND round < {st.rounds - 1} GROUP BY round, w)""",
            f"losses AS (SELECT round, {losses} FROM weights, data GROUP BY round)",
            "summed AS (SELECT *, valid_cross_entropy + valid_mse AS valid_loss FROM losses)",
            """gained AS (SELECT *, coalesce(valid_loss < min(valid_loss) OVER (ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS gain FROM summed)""",
            "since AS (SELECT *, max(CASE WHEN gain THEN round END) OVER (ORDER BY round) AS best_round FROM gained)",
            f"last AS (SELECT coalesce(min(round) FILTER (round - best_round >= {st.patience}), max(round)) AS stop FROM since)",
            "best AS (SELECT best_round FROM since, last WHERE round = stop)",
            f"""predicted AS (SELECT Patient_ID, label, y_raw, {p} AS p_class1, {v} * y_std + y_mean AS pred_time
      FROM data, weights, best WHERE split = 'test' AND round = best_round)"""]


def _recursive(body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([MODALITY_CTES, *_rounds_ctes()]) + "\n" + body


M6_PATH_SQL = _recursive("SELECT round, " + ", ".join(rnd(c, c) for c in (*LOSSES, "valid_loss")) + """,
  round = best_round AS best FROM summed, last, best WHERE round <= stop""")
M6_WEIGHTS_SQL = _recursive(f"""SELECT round, CAST(position AS INTEGER) AS position, {rnd('value', 'value')}
  FROM (SELECT round, unnest(range(len(w))) AS position, unnest(w) AS value FROM weights, last WHERE round <= stop)""")
M6_PREDICTIONS_SQL = _recursive(f"""SELECT Patient_ID, {rnd('p_class1', 'p_class1')}, CAST(p_class1 > 0.5 AS INTEGER) AS pred_class,
  {rnd('pred_time', 'pred_time')} FROM predicted""")


def _prediction_metrics(scope: str, with_regression: bool = True) -> tuple[str, str]:
    """(a CTE of counts, the long metric rows) over a table ``predicted`` (label, y_raw, p_class1, pred_time)."""
    from medfuse.functions.exprs import DOUBLE_EPS
    e = "(y_raw - pred_time)"
    values = {"accuracy": "avg(CAST((p_class1 > 0.5) = (label = 1) AS DOUBLE))",
              "precision": "coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0)", "recall": "coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0)",
              "f1": "coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0)",
              "mae": f"avg(abs{e})", "mse": f"avg({e} ** 2)", "rmse": f"sqrt(avg({e} ** 2))",
              "r2": f"""CASE WHEN var_pop(y_raw) * count(y_raw) <> 0 THEN 1 - sum({e} ** 2) / (var_pop(y_raw) * count(y_raw))
                WHEN sum({e} ** 2) = 0 THEN 1.0 ELSE 0.0 END""",
              "mape": f"100 * avg(abs({e} / CASE WHEN y_raw = 0 THEN {DOUBLE_EPS!r} ELSE y_raw END))"}
    counts = """counts AS (SELECT count(*) FILTER (p_class1 > 0.5 AND label = 1) AS tp, count(*) FILTER (p_class1 > 0.5 AND label = 0) AS fp,
      count(*) FILTER (p_class1 <= 0.5 AND label = 1) AS fn FROM predicted)"""
    if not with_regression:
        values = {n: x for n, x in values.items() if n in ("accuracy", "precision", "recall", "f1")}
    rows = [f"SELECT '{scope}' AS scope, '{n}' AS metric, {rnd(f'(SELECT {x} FROM predicted)' if n in ('accuracy', 'mae', 'mse', 'rmse', 'r2', 'mape') else f'(SELECT {x} FROM counts)', 'value')}"
            for n, x in values.items()]
    auc = """(SELECT sum(CASE WHEN a.p_class1 > b.p_class1 THEN 1.0 WHEN a.p_class1 = b.p_class1 THEN 0.5 ELSE 0 END) / count(*)
      FROM predicted a, predicted b WHERE a.label = 1 AND b.label = 0)"""
    rows.append(f"SELECT '{scope}' AS scope, 'roc_auc' AS metric, {rnd(auc, 'value')}")
    return counts, " UNION ALL ".join(rows)


def _round_metrics(scope: str, cols=ROUND_FEATURES, st=ROUND_SETTINGS) -> str:
    counts, rows = _prediction_metrics(scope)
    return "WITH RECURSIVE " + ",\n".join([MODALITY_CTES, *_rounds_ctes(cols, st), counts]) + "\n" + rows


def _ab1_rounds() -> str:
    from medfuse.operators.joins import leave_one_out
    scopes = [("All", None), *[(f"No {m.capitalize()}", m) for m in ROUND_MODALITIES]]
    return " UNION ALL ".join(f"SELECT * FROM ({_round_metrics(name, leave_one_out(ROUND_MODALITIES, drop), ABLATION_SETTINGS)})" for name, drop in scopes)


# ----------------------------------------------------------------------------- M5: stacked fusion
def _stacked_ctes() -> list[str]:
    """Every first-level head by its own recursive query, and ``said``: out-of-fold values of training keys, full heads' of others."""
    h = "substr(md5(CAST(Patient_ID AS VARCHAR) || ':42:fold'), 1, 8)"
    fold = " + ".join(f"CAST({h} >= '{threshold_hex(i / STACK_FOLDS)}' AS INTEGER)" for i in range(1, STACK_FOLDS))
    stat, raw, *_ = _rounds_ctes()
    ctes = [stat, raw.replace("raw AS", "three AS", 1), f"base AS MATERIALIZED (SELECT *, {fold} AS fold FROM three)"]
    for m, cols in ROUND_MODALITIES.items():
        parts = []
        for f in (None, *range(STACK_FOLDS)):
            learned = "split = 'train'" + ("" if f is None else f" AND fold <> {f}")
            inner = [f"raw AS (SELECT * REPLACE (CASE WHEN {learned} THEN 'train' ELSE 'test' END AS split) FROM base)", *_rounds_ctes(cols, STACK_FIRST)[2:]]
            own = "b.split <> 'train'" if f is None else f"b.split = 'train' AND b.fold = {f}"
            parts.append(f"""SELECT h.Patient_ID, h.p_class1 AS {m}_p_class1, h.pred_time AS {m}_pred_time
              FROM (WITH RECURSIVE {", ".join(inner)} SELECT * FROM predicted) h JOIN base b ON b.Patient_ID = h.Patient_ID WHERE {own}""")
        ctes.append(f"said_{m} AS MATERIALIZED ({' UNION ALL '.join(parts)})")
    joins = " ".join(f"JOIN said_{m} USING (Patient_ID)" for m in ROUND_MODALITIES)
    return [*ctes, f"said AS MATERIALIZED (SELECT * FROM base {joins})"]


def _stacked_values() -> list[str]:
    return [f"{m}_{v}" for m in ROUND_MODALITIES for v in ("p_class1", "pred_time")]


def _stacked_out_of_fold() -> str:
    return "WITH RECURSIVE " + ",\n".join([MODALITY_CTES, *_stacked_ctes()]) + f"""
      SELECT Patient_ID, split, fold, {", ".join(rnd(v, v) for v in _stacked_values())} FROM said WHERE split <> 'test'"""


def _stacked_metrics() -> str:
    counts, rows = _prediction_metrics("stacked")
    second = ["raw AS (SELECT * FROM said)", *_rounds_ctes(_stacked_values(), STACK_SECOND)[2:]]
    return "WITH RECURSIVE " + ",\n".join([MODALITY_CTES, *_stacked_ctes(), *second, counts]) + "\n" + rows


# ----------------------------------------------------------------------------- declared coefficients: S5, S6, S8, S10, M7-M9
def _declared_ctes() -> list[str]:
    test = f"substr(md5(CAST(Patient_ID AS VARCHAR) || ':42'), 1, 8) < '{threshold_hex(0.2)}'"
    names = {"value__mean": "w_mean", "value__maximum": "w_max", "value__minimum": "w_min", "acctbal": f"coalesce(acctbal, (SELECT avg(acctbal) FROM ehr WHERE NOT {test}))"}

    def linear(weights, b):
        return " + ".join(f"{w!r} * ({names.get(c, c.split('_')[-1])})" for c, w in weights.items()) + f" + {b!r}"
    return [f"""filled AS (SELECT Patient_ID, coalesce(value, (SELECT avg(value) FROM wearables WHERE NOT {test})) AS value FROM wearables)""",
            "stat AS (SELECT Patient_ID, avg(value) AS w_mean, max(value) AS w_max, min(value) AS w_min FROM filled GROUP BY Patient_ID)",
            f"""scored AS (SELECT Patient_ID, {test} AS test, CVD_Presence AS label, Time_To_Event AS y_raw,
        1 / (1 + exp(-({linear(DECLARED_CLASS, DECLARED_INTERCEPTS[0])}))) AS p_class1, {linear(DECLARED_TIME, DECLARED_INTERCEPTS[1])} AS pred_time
      FROM ehr JOIN imaging USING (Patient_ID) JOIN stat USING (Patient_ID) JOIN genomic USING (Patient_ID) WHERE CVD_Presence IS NOT NULL)"""]


DECLARED_SQL = _w(f"""SELECT Patient_ID, {rnd('p_class1', 'p_class1')}, CAST(p_class1 > 0.5 AS INTEGER) AS pred_class, {rnd('pred_time', 'pred_time')}
  FROM scored WHERE test""", *_declared_ctes())
DECLARED_SCORING_SQL = _w(f"""SELECT CAST(Patient_ID AS VARCHAR) AS Patient_ID, CASE WHEN p_class1 > 0.5 THEN 'Positive' ELSE 'Negative' END AS CVD_Presence,
  {rnd('p_class1', 'CVD_Presence_probability')}, {rnd('pred_time', 'Time_To_Event')}, 'history' AS features_from, CAST(NULL AS VARCHAR) AS error
  FROM scored""", *_declared_ctes())


def _declared_report() -> str:
    parts = []
    for scope, which, regression in (("declared", "test", True), ("declared_train", "NOT test", False)):
        counts, rows = _prediction_metrics(scope, regression)
        parts.append("SELECT * FROM (" + _w(rows, *_declared_ctes(), f"predicted AS (SELECT * FROM scored WHERE {which})", counts) + ")")
    return " UNION ALL ".join(parts)


# ----------------------------------------------------------------------------- S7, M10
S7_SQL = _w("""SELECT CAST(e.Patient_ID AS VARCHAR) AS Patient_ID,
    ['imaging_features: field required or invalid'] AS errors
  FROM ehr e JOIN imaging USING (Patient_ID) JOIN genomic USING (Patient_ID)
  JOIN (SELECT DISTINCT Patient_ID FROM wearables WHERE value IS NOT NULL) w USING (Patient_ID)
  WHERE e.Patient_ID % 5 = 0""")

M10_SQL = f"""WITH r AS (SELECT user_id AS Patient_ID, ts AS time, value FROM events),
g AS (SELECT Patient_ID, date_trunc('day', time) AS window_start, date_trunc('day', time) + INTERVAL 1 DAY AS window_end,
        count(value) AS n, {rnd('sum(value)', 'sum_values')}, {rnd('avg(value)', 'mean')},
        {rnd('stddev_pop(value)', 'standard_deviation')}, {rnd('min(value)', 'minimum')}, {rnd('max(value)', 'maximum')},
        {rnd('quantile_disc(value, 0.5)', 'median_approx')}, {rnd('median(value)', 'median')}, count_if(value > 100.0) AS n_above
      FROM r GROUP BY Patient_ID, date_trunc('day', time))
SELECT * FROM g"""


def _m10_series() -> str:
    parts = [f"(SELECT * FROM ({O.feature_sql(g)})) g{i}" for i, g in enumerate(("F8", "F9", "F12"))]
    return "SELECT * FROM " + " JOIN ".join(p if i == 0 else f"{p} USING (Patient_ID)" for i, p in enumerate(parts))


# ----------------------------------------------------------------------------- S2
S2_SQL = _w(f"""SELECT Patient_ID, {rnd('acctbal', 'acctbal')}, nationkey, mktsegment, false AS corrupt FROM ehr""")


# ----------------------------------------------------------------------------- all feature groups in one extraction
def _all_features_sql() -> str:
    from medfuse.functions.tsfeatures import ALL_GROUPS
    parts = [f"(SELECT * FROM ({O.feature_sql(g, prefix='value__')})) g{i}" for i, g in enumerate(ALL_GROUPS)]
    return "SELECT * FROM " + " FULL JOIN ".join(
        p if i == 0 else f"{p} USING (Patient_ID)" for i, p in enumerate(parts))


def oracle_sql() -> dict[str, str]:
    out = {name: O.feature_sql(g) for g, name in FEATURE_QUERIES.items()}
    out.update({
        "p1_missingness": _p1(),
        "p2_missingness_patterns": _p2(),
        "r2_impute_ehr": _w(_impute_select("ehr")),
        "r2_impute_wearables": _w(_impute_select("wearables")),
        "r8_r9_coerce_fill": _r8_r9(),
        "r10_nan_to_num": R10_SQL,
        "r12_one_hot": R12_SQL,
        "r13_dummy_time": R13_SQL,
        "r14_last_k_sequence": R14_SQL,
        "r16_standardize": _r16(),
        "r17_r19_decisions": R17_SQL,
        "j1_merge_modalities": J1_SQL,
        "j2_patient_feature_matrix": _j2_matrix(),
        "j3_wide_concat": J3_SQL,
        "j5_unmatched_keys": _j5(),
    })
    out.update({"m1_m2_split_assignment": M1_SQL, "e1_e4_classification_metrics": E1_SQL, "e5_roc_auc": E5_SQL,
                "e6_macro_auc": E6_SQL, "e7_e11_regression_metrics": E7_SQL, "e12_losses": E12_SQL,
                "e13_evaluate": E13_SQL, "e14_confusion_counts": E14_SQL})
    out.update({"x1_linear_attribution_fixed": X1_FIXED_SQL, "x3_breakdown_fixed": X3_FIXED_SQL,
                "x1_tree_attribution_fixed": _x1_tree(), "x2_permutation_importance_fixed": _x2_permutation()})
    out.update({"m6_early_stopping_path": M6_PATH_SQL, "m6_round_coefficients": M6_WEIGHTS_SQL,
                "m6_restored_predictions": M6_PREDICTIONS_SQL, "m6_restored_metrics": _round_metrics("rounds"),
                "m3_baseline_rounds": _round_metrics("baseline_ehr", ROUND_MODALITIES["ehr"], ABLATION_SETTINGS), "ab1_ablation_rounds": _ab1_rounds(),
                "s5_m7_declared_predictions": DECLARED_SQL, "s10_declared_report": _declared_report(),
                "s6_s8_m8_declared_scoring": DECLARED_SCORING_SQL, "m9_declared_stream_scoring": DECLARED_SCORING_SQL})
    out.update({"s7_quarantine": S7_SQL, "m10_windowed_stream_features": M10_SQL, "m10_stream_series_features": _m10_series()})
    out.update({"m1_exact_stratified_split": _exact_split_sql("customer", "c_custkey", ", c_mktsegment AS segment", 0.2, 42),
                "m1_exact_split": _exact_split_sql("orders", "o_orderkey", "", 0.15, 7), "r4_r7_r11_columns": R4_SQL})
    out.update({"f22_fft_aggregated": _fft_aggregated("user_id", "Patient_ID"), "f22_fourier_entropy": _fourier_entropy("user_id", "Patient_ID"),
                "f22_fft_aggregated_long": _fft_aggregated("event_type", "series"), "f22_fourier_entropy_long": _fourier_entropy("event_type", "series")})
    out.update({"m5_stacked_out_of_fold": _stacked_out_of_fold(), "m5_stacked_metrics": _stacked_metrics()})
    out["s2_csv_scan"] = S2_SQL
    out["s4_matrix_from_csv"] = out["j2_patient_feature_matrix"]
    out["f_all_features"] = _all_features_sql()
    return out
