"""SimHash near-duplicates: 64-bit fingerprints compared exactly, tile by tile, with numpy exclusive-or and bit counts.

Fingerprints are made in one pass without a shuffle.  Equal fingerprints meet first, so copies cost one row.  Tiles are
cut inside blocks of fingerprints that agree on some of ``radius + j`` bit ranges: ``radius`` differing bits cannot
touch them all, so no link is lost, and the number of comparisons does not follow the square of the corpus.  A block
that holds many fingerprints is cut into tiles of one bit count each, and pairs of tiles whose bit counts differ by
more than the radius are skipped.  Each pair of tiles is a row of its own, so a large block spreads over all tasks.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medfuse.llm import textbytes as tb
from medfuse.llm.common import cut, discard, fresh
from medfuse.llm.components import components

WORDS_PER_SHINGLE = 4
RADIUS = 4
SEED = 42
TILE = 2048             # fingerprints in a tile
PART = 512              # of a tile compared at once


def block_fingerprints(data: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """The fingerprint of each row of a block: a bit is 1 if it is set in over half of the shingles' hashes."""
    import xxhash
    w = tb.Words(data, offsets, tb.NOT_BLANK)
    counts = w.counts()
    out = np.zeros(w.rows, np.uint64)
    if not len(w):
        return out
    shingles = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    ends = np.cumsum(shingles)
    row = np.repeat(np.arange(w.rows), shingles)
    head = w.first[:-1][row] + np.arange(len(row)) - (ends - shingles)[row]
    tail = np.minimum(head + k - 1, w.first[1:][row] - 1)
    raw, digest = w.text.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(w.start[head].tolist(), w.end[tail].tolist())),
                         np.uint64, len(row))
    filled = np.flatnonzero(shingles)
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    set_in = np.add.reduceat(bits, (ends - shingles)[filled], axis=0, dtype=np.int32)
    majority = (2 * set_in > shingles[filled][:, None]).astype(np.uint8)
    out[filled] = np.packbits(majority, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS_PER_SHINGLE,
                 carry: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, fp bigint) for every row, and the bigint columns of ``carry``; NULL and blank texts have fingerprint 0."""
    carry = carry or {}
    names = ["doc_id", "fp", *carry]

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in tb.blocks(batch.column(1)):
                fp = block_fingerprints(data, offsets, k).view(np.int64)
                ids, *others = [batch.column(i).slice(first, end - first) for i in (0, *range(2, batch.num_columns))]
                yield pa.RecordBatch.from_arrays([ids, pa.array(fp), *others], names)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"),
                       *[c.alias(n) for n, c in carry.items()]).mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def link_tiles(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into a, into b) at ``radius`` or fewer differing bits; parts too far apart in bit count are skipped."""
    pa_, pb = np.bitwise_count(a), np.bitwise_count(b)
    oa, ob = np.argsort(pa_, kind="stable"), np.argsort(pb, kind="stable")
    sa, sb = pa_[oa].astype(np.int64), pb[ob].astype(np.int64)
    found = []
    for i in range(0, len(a), PART):
        part = oa[i:i + PART]
        lo = np.searchsorted(sb, sa[i] - radius, side="left")
        hi = np.searchsorted(sb, sa[min(i + PART, len(a)) - 1] + radius, side="right")
        for j in range(lo, hi, PART):
            other = ob[j:min(j + PART, hi)]
            near = np.bitwise_count(a[part][:, None] ^ b[other][None, :]) <= radius
            x, y = np.nonzero(near)
            found.append((part[x], other[y]))
    return found


def spanning(nodes: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component among these pairs) for nodes that are not the smallest themselves."""
    label = nodes.copy()
    if pairs:
        x, y = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        while True:
            low = np.minimum(label[x], label[y])
            before = label.copy()
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            if np.array_equal(before, label):
                break
    moved = label != nodes
    return nodes[moved], label[moved]


def block_masks(count: int, radius: int) -> list[int]:
    """Bit masks of which two fingerprints at ``radius`` or fewer differing bits agree on one at least.

    The 64 bits fall into ``radius + j`` ranges, and a mask holds ``j`` of them; ``j`` grows with the number of
    fingerprints, so that a mask leaves a few thousand of them together at most when they are evenly spread.
    """
    j = 1 if count <= 1 << 24 else 2 if count <= 1 << 32 else 3
    n = radius + j
    if n > 64:
        return [0]
    cuts = [64 * i // n for i in range(n + 1)]
    ranges = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(ranges, j)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(u, v): links that join the same fingerprints as all pairs of ``prints`` (distinct ``fp``) within the radius."""
    masks = block_masks(prints.count(), radius)
    keys = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m)).cast("bigint")) for m in masks]))
                         .alias("part", "shared")).withColumn("ones", F.bit_count("fp").cast("int"))
    by_ones = cut(keys.groupBy("part", "shared", "ones").agg(F.count(F.lit(1)).alias("n")))
    total = by_ones.groupBy("part", "shared").agg(F.sum("n").alias("total"))
    sizes = cut(total.where("total > 1"))
    split = cut(by_ones.join(sizes.where(F.col("total") > tile), ["part", "shared"])
                .selectExpr("part", "shared", "ones", f"CAST(ceil(n / {tile}) AS INT) AS salts"))
    # a block that fits one tile has ones = -1; else tiles hold one bit count each, salted where that is still too many
    dealt = keys.join(split, ["part", "shared", "ones"], "left").selectExpr(
        "part", "shared", "fp", "IF(salts IS NULL, -1, ones) AS ones", "IF(salts IS NULL, 0, CAST(pmod(xxhash64(fp), salts) AS INT)) AS salt")
    tiles = cut(dealt.groupBy("part", "shared", "ones", "salt").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
                .where("ones >= 0 OR size(fps) > 1"))
    large = tiles.where("ones >= 0")
    left = large.select("part", "shared", F.col("ones").alias("o1"), F.col("salt").alias("s1"), F.col("fps").alias("left"))
    right = large.select("part", "shared", F.col("ones").alias("o2"), F.col("salt").alias("s2"), F.col("fps").alias("right"))
    pairs = left.join(right, ["part", "shared"]).where(
        (F.abs(F.col("o1") - F.col("o2")) <= radius) & (F.struct("o1", "s1") <= F.struct("o2", "s2")))
    jobs = tiles.where("ones < 0").select(F.col("fps").alias("left"), F.lit(None).cast("array<bigint>").alias("right")).unionByName(
        pairs.select("left", F.when(F.struct("o1", "s1") != F.struct("o2", "s2"), F.col("right")).alias("right")))

    def run(batches):
        for batch in batches:
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for left_, right_ in zip(batch.column(0), batch.column(1)):
                a = left_.values.to_numpy().astype(np.int64)
                if right_.is_valid:
                    b = right_.values.to_numpy().astype(np.int64)
                    nodes = np.concatenate([a, b])
                    found = [(x, y + len(a)) for x, y in link_tiles(a.view(np.uint64), b.view(np.uint64), radius)]
                else:
                    nodes = a
                    found = link_tiles(a.view(np.uint64), a.view(np.uint64), radius)
                u, v = spanning(nodes, found)
                us.append(u)
                vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    out = cut(jobs.mapInArrow(run, "u bigint, v bigint").distinct())
    for old in (by_ones, sizes, split, tiles):
        discard(old)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS_PER_SHINGLE,
                    radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Rows whose fingerprints differ in ``radius`` bits or fewer are linked; ``component_id`` is the smallest ``doc_id``
    that can be reached.  NULL, empty and blank texts have fingerprint 0 and link like any other.  A row with a NULL
    ``doc_id`` is linked too, but names no component: its ``component_id`` is the smallest known one, or NULL.
    Repeated rows stay repeated, an empty table gives an empty result, and columns beyond the two named are not read.
    """
    rows = cut(fingerprints(docs, id_col, text_col, k))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("lowest")))
    linked = links(prints, radius)
    labels = components(linked, "u", "v")
    named = cut(prints.join(labels, prints["fp"] == labels["node"], "left")
                .select("fp", F.coalesce("label", "fp").alias("label"), "lowest"))
    lowest = named.groupBy("label").agg(F.min("lowest").alias("component_id"))
    by_print = cut(named.select("fp", "label").join(cut(lowest), "label").select("fp", "component_id"))
    out = rows.join(by_print, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    discard(linked)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates, unchanged: the one with the smallest id, NULL being the largest.

    Rows are judged one by one, whatever id they share: of unlike rows with the smallest id, the one with the smaller hash of
    its text, then of the whole row, stays, and of rows alike in every column one.  So every group keeps exactly one row, also
    where all of its ids are NULL.  NULL, empty and blank texts are one group.  An empty table gives an empty result.
    """
    own = {"text_hash": F.xxhash64(F.col(f"`{text_col}`")), "row_hash": F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])}
    key = ["doc_id", *own]
    rows = cut(fingerprints(docs, id_col, text_col, carry=own).groupBy(*key, "fp").agg(F.count(F.lit(1)).alias("copies"))
               .withColumn("rank", F.struct(F.col("doc_id").isNull().alias("unnamed"), *key)))
    prints = cut(rows.groupBy("fp").agg(F.min("rank").alias("rank")))
    linked = links(prints)
    labels = components(linked, "u", "v")
    named = cut(prints.join(labels, prints["fp"] == labels["node"], "left").select("fp", F.coalesce("label", "fp").alias("label"), "rank"))
    lowest = cut(named.groupBy("label").agg(F.min("rank").alias("lowest")))
    judged = cut(rows.join(named.select("fp", "label").join(lowest, "label"), "fp")
                 .select(*key, F.col("rank").eqNullSafe(F.col("lowest")).alias("stays"), "copies"))
    names = fresh(docs, *key)
    here = [F.col(f"`{id_col}`").cast("bigint"), *own.values()]
    same = reduce(lambda a, b: a & b, [c.eqNullSafe(F.col(n)) for c, n in zip(here, names)])

    def keys(which: str) -> DataFrame:
        return judged.where(which).select(*[F.col(c).alias(n) for c, n in zip(key, names)])

    kept = docs.join(keys("NOT stays"), same, "left_anti")
    if judged.where("stays AND copies > 1").limit(1).count():
        again = keys("stays AND copies > 1")
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates())
    for old in (rows, prints, linked, named, lowest):
        discard(old)
    return kept
