"""Compare registered Spark queries with their DuckDB oracle (driver-style check).

Usage: python tests/oracle_check.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(_norm(x) for x in list(v))
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime()
    return v


def frame_rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark_pdf: pd.DataFrame, oracle_pdf: pd.DataFrame) -> tuple[bool, str]:
    if sorted(spark_pdf.columns) != sorted(oracle_pdf.columns):
        a, b = set(spark_pdf.columns), set(oracle_pdf.columns)
        return False, f"columns differ: spark-only={sorted(a - b)[:8]} oracle-only={sorted(b - a)[:8]}"
    if len(spark_pdf) != len(oracle_pdf):
        return False, f"rows {len(spark_pdf)} vs {len(oracle_pdf)}"
    ra, rb = frame_rows(spark_pdf), frame_rows(oracle_pdf)
    if ra == rb:
        return True, f"{len(ra)} rows ok"
    cols = sorted(spark_pdf.columns)
    bad = {}
    for x, y in zip(ra, rb):
        for c, u, v in zip(cols, x, y):
            if u != v:
                bad.setdefault(c, (u, v))
    return False, f"{len(bad)} cols differ, e.g. {list(bad.items())[:4]}"


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    pats = argv[2:]
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from medfuse.session import get_spark_session
    spark = get_spark_session(master="local[8]", conf={"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    qs, sql = E.queries(), E.oracle_sql()
    ok = 0
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            pdf = fn(spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(e)[:300]}")
            continue
        t1 = time.time()
        if name not in sql:
            print(f"ROWS {name}: {len(pdf)} rows (no oracle) {t1 - t0:.1f}s")
            continue
        try:
            opdf = con.execute(sql[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            continue
        good, msg = compare(pdf, opdf)
        ok += good
        print(f"{'OK  ' if good else 'FAIL'} {name}: {msg} ({t1 - t0:.1f}s)")
    print(f"{ok} matched")


if __name__ == "__main__":
    main(sys.argv)
