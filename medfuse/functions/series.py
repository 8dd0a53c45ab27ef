"""Skew-safe ordered-series primitives.

A patient may hold a large share of all readings, so no window here is
partitioned by the series key alone:

- ``rank_series``   1-based row number per series: a window per (series, time
  chunk) numbers rows locally, a small per-chunk count table turns that into
  global offsets (one join whose big side is already partitioned by the chunk).
  Chunks of more than ``dense_rows`` rows are cut further by their own data
  (``chunked``), so readings packed into one day or one instant spread as well.
- ``with_neighbors`` lags and leads up to H: rows are cut into blocks of B row
  numbers; the H rows on each side of a block are copied into it (a halo), so a
  window per (series, block) sees every neighbour it needs.
- ``prefix_scan``   running sum / max over the row order: window per block plus
  the scan of block totals.

Work per task is bounded by ``dense_rows`` and by B.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, TimestampNTZType, TimestampType

from medfuse.session import materialize

RN, N, X, T, BLK, CHUNK = "rn", "n", "x", "t", "blk", "chunk"
DEFAULT_CHUNK_SECONDS = 86_400          # time chunk for timestamp ordering: one day
DEFAULT_BLOCK_ROWS = 4_096              # rows per block for neighbours and scans
DENSE_ROWS = 262_144                    # a chunk of more rows is cut further
SLICES = 64                             # quantile slices of one cut
CUTS = 16                               # cuts of one chunk, one after the other


def chunk_expr(df: DataFrame, order_col: str, width: float | None) -> Column:
    """Chunk id that is monotone in the order column."""
    dt = df.schema[order_col].dataType
    if isinstance(dt, NumericType):
        w = width or 1_000_000.0
        return F.floor(F.col(order_col) / F.lit(float(w))).cast("long")
    w = int((width or DEFAULT_CHUNK_SECONDS) * 1_000_000)
    return F.floor(F.unix_micros(F.col(order_col).cast("timestamp")) / F.lit(w)).cast("long")


def _axis(df: DataFrame, name: str) -> Column | None:
    """The order column as a double that never falls where the column rises; None where it cannot be cut by value."""
    kind = df.schema[name].dataType
    if isinstance(kind, NumericType):
        return F.col(name).cast("double")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    return None


def _piece_table(rows: DataFrame, keys: list[str], order_cols: list[str], axes: list[Column | None]) -> DataFrame:
    """Per piece: its rows, and the column to cut it by (the first that is not constant in it; -1 for none)."""
    aggs = [F.count(F.lit(1)).alias("_cnt")]
    for i, name in enumerate(order_cols):
        aggs += [F.count(name).alias(f"_some{i}"), F.min(name).alias(f"_least{i}"), F.max(name).alias(f"_most{i}")]
    cut_by = F.lit(-1)
    for i in reversed(range(len(order_cols))):
        constant = (F.col(f"_some{i}") == 0) | ((F.col(f"_some{i}") == F.col("_cnt")) & (F.col(f"_least{i}") == F.col(f"_most{i}")))
        cut_by = F.when(constant, cut_by).otherwise(F.lit(i if axes[i] is not None else -1))
    return rows.groupBy(*keys, CHUNK).agg(*aggs).select(*keys, CHUNK, "_cnt", cut_by.alias("_cut"))


def _value(axes: list[Column | None]) -> Column:
    """The value by which the row's piece is cut."""
    return reduce(lambda v, i: F.when(F.col("_cut") == i, axes[i]).otherwise(v),
                  [i for i, axis in enumerate(axes) if axis is not None], F.lit(None).cast("double"))


def _slice(v: Column) -> Column:
    """Which slice of its piece a row falls in, in order (NULL first, NaN last); a value that is a cut has its own slice."""
    below = F.size(F.filter("_cuts", lambda c: c < v))
    inner = 2 * below + F.array_contains("_cuts", v).cast("int")
    return (F.when(v.isNull(), -2).when(v == float("-inf"), -1).when(v >= float("inf"), 2 * SLICES).otherwise(inner)).cast("long")


def chunked(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], chunk_width: float | None = None,
            dense_rows: int = DENSE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows with ``chunk``, pieces with the rows of each in ``_cnt``): pieces of a series that follow each other in order.

    A piece is a time chunk; one of more than ``dense_rows`` rows is cut at the quantiles of the first order column that
    varies in it, and so are its slices, until each is small enough or all its rows are equal in the order columns.  A
    value that fills many quantiles is a slice of its own, which the next order column cuts.  The quantiles come from a
    bounded sketch of each piece and are written before use, as a sketch need not come out alike twice.  Only columns of
    numbers and timestamps are cut.  ``chunk`` is the list of slice numbers.  The table of pieces to cut has at most one
    row per ``dense_rows`` rows; Spark broadcasts it only below its threshold.
    """
    keys, order_cols = list(keys), list(order_cols)
    at = [*keys, CHUNK]
    rows = df.withColumn(CHUNK, F.array(chunk_expr(df, order_cols[0], chunk_width)))
    axes = [_axis(df, c) for c in order_cols]
    finite = F.when(F.abs(_value(axes)) < float("inf"), _value(axes))
    pieces = last = materialize(_piece_table(rows, keys, order_cols, axes))
    for depth in range(1, CUTS):
        dense = last.where((F.col("_cnt") > dense_rows) & (F.col("_cut") >= 0))
        if dense.isEmpty():
            break
        named = dense.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(at)], "_cut")
        cuts = materialize(rows.join(named, _all_same(at)).groupBy(*[f"_k{i}" for i in range(len(at))], "_cut").agg(
            F.coalesce(F.array_distinct(F.percentile_approx(finite, [i / SLICES for i in range(1, SLICES)], 10_000)),
                       F.array().cast("array<double>")).alias("_cuts")))
        path = F.when(F.col("_cut").isNotNull(), F.concat(CHUNK, F.array(_slice(_value(axes))))).otherwise(F.col(CHUNK))
        rows = rows.join(cuts, _all_same(at), "left").select(*df.columns, path.alias(CHUNK))
        last = materialize(_piece_table(rows.where(F.size(CHUNK) == depth + 1), keys, order_cols, axes))
        pieces = pieces.join(cuts, _all_same(at), "left_anti").unionByName(last)
    return rows, pieces.select(*keys, CHUNK, "_cnt")


def _all_same(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(names)])


def rank_series(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str],
                chunk_width: float | None = None, stats: DataFrame | None = None, dense_rows: int = DENSE_ROWS) -> DataFrame:
    """Add ``rn`` (1..n in ``order_cols`` order) and ``n`` per series ``keys``.

    ``stats`` (one row per series, keyed by ``keys``) is attached on the same
    join, so per-series statistics reach every row without a second shuffle.
    """
    keys, order_cols = list(keys), list(order_cols)
    c, per_chunk = chunked(df, keys, order_cols, chunk_width, dense_rows)
    local = c.withColumn(
        "_lrn", F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy(*order_cols)))
    w = Window.partitionBy(*keys).orderBy(CHUNK)
    offsets = per_chunk.select(
        *keys, CHUNK,
        F.coalesce(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(Window.partitionBy(*keys)).alias(N))
    if stats is not None:
        offsets = offsets.join(stats.drop(N) if N in stats.columns else stats, keys, "left")
    return (local.join(offsets, [*keys, CHUNK], "inner")
                 .withColumn(RN, (F.col("_lrn") + F.col("_off")).cast("long"))
                 .drop("_lrn", "_off"))


def with_neighbors(df: DataFrame, keys: Sequence[str], value: str, lags: Sequence[int],
                   leads: Sequence[int], block_rows: int = DEFAULT_BLOCK_ROWS, spans: Sequence[int] = ()) -> DataFrame:
    """Add ``lag_k`` / ``lead_k`` of ``value`` for the given k (needs ``rn``).

    For each k of ``spans``, also ``back_k`` / ``ahead_k``: the largest of the k values before / after.
    """
    keys = list(keys)
    h = max([0, *lags, *leads, *spans])
    b = int(block_rows)
    if h > b:
        raise ValueError(f"neighbour distance {h} exceeds block size {b}")
    pos = (F.col(RN) - 1) % b
    own = F.floor((F.col(RN) - 1) / b).cast("long")
    targets = F.array_compact(F.array(
        own, F.when(pos >= b - h, own + 1), F.when((pos < h) & (own > 0), own - 1)))
    halo = df.withColumn("_own", own).withColumn(BLK, F.explode(targets))
    w = Window.partitionBy(*keys, BLK).orderBy(RN)
    cols = [F.lag(value, k).over(w).alias(f"lag_{k}") for k in sorted(set(lags))]
    cols += [F.lead(value, k).over(w).alias(f"lead_{k}") for k in sorted(set(leads))]
    for k in sorted(set(spans)):
        cols += [F.max(value).over(w.rowsBetween(-k, -1)).alias(f"back_{k}"), F.max(value).over(w.rowsBetween(1, k)).alias(f"ahead_{k}")]
    return (halo.select("*", *cols)
                .where(F.col(BLK) == F.col("_own"))
                .drop("_own"))


def prefix_scan(df: DataFrame, keys: Sequence[str], exprs: dict[str, tuple[str, Column]],
                block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Running aggregates over ``rn`` order: {out_name: ("sum"|"max", column)}.

    Reuses the (keys, blk) partitioning of ``with_neighbors`` output when present.
    """
    keys = list(keys)
    b = int(block_rows)
    if BLK not in df.columns:
        df = df.withColumn(BLK, F.floor((F.col(RN) - 1) / b).cast("long"))
    fn = {"sum": F.sum, "max": F.max}
    run = Window.partitionBy(*keys, BLK).orderBy(RN).rowsBetween(Window.unboundedPreceding, 0)
    local = df.select("*", *[fn[k](c).over(run).alias(f"_loc_{name}") for name, (k, c) in exprs.items()])
    totals = df.groupBy(*keys, BLK).agg(*[fn[k](c).alias(f"_tot_{name}") for name, (k, c) in exprs.items()])
    before = Window.partitionBy(*keys).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(*keys, BLK, *[fn[k](f"_tot_{name}").over(before).alias(f"_off_{name}")
                                       for name, (k, _) in exprs.items()])
    out = local.join(offs, [*keys, BLK], "inner")
    for name, (k, _) in exprs.items():
        loc, off = F.col(f"_loc_{name}"), F.col(f"_off_{name}")
        val = loc + F.coalesce(off, F.lit(0)) if k == "sum" else F.greatest(loc, off)
        out = out.withColumn(name, val).drop(f"_loc_{name}", f"_off_{name}")
    return out
