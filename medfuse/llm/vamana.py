"""Embedding near-duplicates by a robust-pruned flat graph.

Equal vectors meet first, so copies cost one node.  Within a label, nodes are dealt to overlapping cluster shards: a
node lives at its nearest centre and visits every other centre that is nearly as near.  Each shard builds a flat graph
by robust pruning; the adjacency lists of a node are united over its shards; then each member of a shard searches its
graph greedily from the medoid and expands every node in range until no new one is found.  A search that does
not arrive at its own node goes on from there.  Found pairs are verified by their cosine in double precision and counted where
the found node lives, so no pair is counted twice and none is ever shuffled.  A cluster beyond ``SHARD`` nodes is
split by a hash, and its parts search one another.  The whole is audited against brute force for a sample of
queries, and repeated with wider overlap if recall falls short.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medfuse.llm.common import cut, discard
from medfuse.llm.components import components

LEAST_COSINE = 0.93
SAMPLE = 20_000         # vectors from which centres are made, at most
CLUSTER = 1000          # nodes of a cluster, on average
SHARD = 3000            # nodes of a shard: larger clusters are split
OVERLAPS = (0.05, 0.15, 0.35, 2.5)    # how much less near (in cosine) a visited centre may be; the last one is every centre
NEAREST, RANDOM, DEGREE, ALPHA = 32, 12, 24, 1.2
BEAM = 16
BATCH = 512             # queries that search together
AUDIT = 200             # queries of the audit
LEAST_RECALL = 0.99

MEMBER = "struct<rep: bigint, n: bigint, home: boolean, vec: array<double>, adj: array<bigint>>"


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return np.einsum("ij,ij->i", a, b) / (na * nb)


def centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """``k`` unit centres of a sample by spherical k-means, from evenly spaced sample rows."""
    x = unit(sample)
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1)
        c = np.where((norm > 1e-9)[:, None], sums / np.maximum(norm, 1e-9)[:, None], c)
    return c


def build_graph(x: np.ndarray, seed: int) -> list[np.ndarray]:
    """Robust-pruned neighbours of each row of ``x`` (unit vectors), with the reverse of every edge."""
    m = len(x)
    if m == 1:
        return [np.zeros(0, np.int64)]
    rng = np.random.default_rng(seed)
    near = min(NEAREST, m - 1)
    cand = np.empty((m, near + RANDOM), np.int64)
    for a in range(0, m, 1024):
        sim = x[a:a + 1024] @ x.T
        sim[np.arange(len(sim)), a + np.arange(len(sim))] = -np.inf
        cand[a:a + 1024, :near] = np.argpartition(-sim, near - 1, axis=1)[:, :near]
    cand[:, near:] = rng.integers(0, m, (m, RANDOM))
    dist = np.empty(cand.shape)
    for a in range(0, m, 1024):
        dist[a:a + 1024] = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("id,ijd->ij", x[a:a + 1024], x[cand[a:a + 1024]])))
    dist[cand == np.arange(m)[:, None]] = np.inf
    source, target = [], []
    rows = np.arange(m)
    for _ in range(DEGREE):
        best = dist.argmin(axis=1)
        alive = np.isfinite(dist[np.arange(len(rows)), best])
        if not alive.any():
            break
        rows, dist, cand, best = rows[alive], dist[alive], cand[alive], best[alive]
        pick = cand[np.arange(len(rows)), best]
        source.append(rows)
        target.append(pick)
        for a in range(0, len(rows), 1024):
            b = slice(a, a + 1024)
            between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("id,ijd->ij", x[pick[b]], x[cand[b]])))
            covered = ALPHA * between <= dist[b]
            dist[b][covered | (cand[b] == pick[b][:, None])] = np.inf
        rows_at = np.arange(len(rows))
        dist[rows_at, best] = np.inf
    s, t = np.concatenate(source), np.concatenate(target)
    edges = np.unique(np.stack([np.concatenate([s, t]), np.concatenate([t, s])], axis=1), axis=0)
    first = np.searchsorted(edges[:, 0], np.arange(m + 1))
    return [edges[first[i]:first[i + 1], 1] for i in range(m)]


def search(x: np.ndarray, adj: list[np.ndarray], q: np.ndarray, own: np.ndarray, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each batch of queries ``q``: (query, node) pairs with a cosine of ``least`` or more that the graph over ``x`` leads to.

    ``own``: node of each query, or -1 if it is not in this graph.
    """
    m = len(x)
    nx, nq = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
    width = max(1, max(len(a) for a in adj))
    table = np.full((m, width), m, np.int64)
    for i, a in enumerate(adj):
        table[i, :len(a)] = a
    target = np.repeat(np.arange(m), [len(a) for a in adj])         # edges are in both directions
    source = np.concatenate(adj) if len(target) else np.zeros(0, np.int64)
    heads = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.zeros(0, np.int64)
    mean = (x / nx[:, None]).mean(axis=0)
    medoid = int(((x / nx[:, None]) @ mean).argmax())
    ux = np.vstack([x / nx[:, None], np.zeros((1, x.shape[1]))])
    found = []
    for a in range(0, len(q), BATCH):
        who = np.arange(a, min(a + BATCH, len(q)))
        uq, n = q[who] / nq[who][:, None], len(who)
        seen = np.zeros((n, m + 1), bool)
        seen[:, m] = True
        seen[:, medoid] = True
        beam = np.full((n, BEAM), m, np.int64)
        sims = np.full((n, BEAM), -np.inf)
        done = np.ones((n, BEAM), bool)
        beam[:, 0], sims[:, 0], done[:, 0] = medoid, uq @ ux[medoid], False
        alive = np.arange(n)
        while len(alive):
            at = np.where(done[alive], -np.inf, sims[alive]).argmax(axis=1)
            node = beam[alive, at]
            done[alive, at] = True
            near = table[node]
            fresh = ~seen[alive[:, None], near]
            seen[alive[:, None], near] = True
            s = np.where(fresh, np.einsum("id,ijd->ij", uq[alive], ux[near]), -np.inf)
            all_ids = np.concatenate([beam[alive], near], axis=1)
            all_sims = np.concatenate([sims[alive], s], axis=1)
            all_done = np.concatenate([done[alive], ~fresh], axis=1)
            top = np.argpartition(-all_sims, BEAM - 1, axis=1)[:, :BEAM]
            beam[alive], sims[alive], done[alive] = (np.take_along_axis(v, top, axis=1) for v in (all_ids, all_sims, all_done))
            open_ = ~done[alive] & np.isfinite(sims[alive])
            alive = alive[open_.any(axis=1)]
        # what was seen is verified, and every node in range is expanded, bit by bit for all queries of the batch
        seen[np.flatnonzero(own[who] >= 0), own[who][own[who] >= 0]] = True
        tested = np.zeros((m, n), bool)
        inside = np.zeros((m, n), bool)
        new = seen[:, :m].T.copy()
        while new.any():
            v, w = np.nonzero(new)
            tested |= new
            for b in range(0, len(v), 1 << 17):
                vb, wb = v[b:b + (1 << 17)], w[b:b + (1 << 17)]
                inside[vb, wb] = cosines(x[vb], q[who[wb]], nx[vb], nq[who[wb]]) >= least
            if not len(source):
                break
            grown = np.packbits(inside & new, axis=1)
            reach = np.zeros_like(grown)
            reach[target[heads]] = np.bitwise_or.reduceat(grown[source], heads, axis=0)
            new = np.unpackbits(reach, axis=1, count=n).astype(bool) & ~tested
        v, w = np.nonzero(inside)
        found.append((who[w], v))
    return found


def nodes_of(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(all rows with their class key, one node per class): a class is all rows of a label with the same vector."""
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"), vec.alias("vec"))
    usable = F.expr("vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0 AND "
                    "forall(vec, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity')) AND exists(vec, v -> v <> 0)")
    return rows, rows.where(usable).groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))


def assign(nodes: DataFrame, spark: SparkSession, overlap: float) -> DataFrame:
    """(label, dim, cluster, rep, n, home, vec): each node once for every cluster that it lives in or visits."""
    total = nodes.count()
    sample = nodes.orderBy(F.xxhash64(F.lit("centres"), "rep"), "rep").limit(SAMPLE).select("label", "vec").toPandas()
    sample["dim"] = sample["vec"].map(len)
    found = {}
    for (label, dim), part in sample.groupby(["label", "dim"]):
        k = min(max(1, round(total * len(part) / max(1, len(sample)) / CLUSTER)), max(1, len(part) // 8))
        if k > 1:
            found[(label, int(dim))] = centres(np.array(part["vec"].tolist()), k)
    shared = spark.sparkContext.broadcast(found)            # at most SAMPLE / 8 centres

    def run(batches):
        for batch in batches:
            label, vec = batch.column(0).to_pylist(), batch.column(1)
            values, ends = vec.values.to_numpy(), vec.offsets.to_numpy()
            row, cluster, home = [], [], []
            groups: dict[tuple[str, int], list[int]] = {}
            for i in range(len(batch)):
                groups.setdefault((label[i], int(ends[i + 1] - ends[i])), []).append(i)
            for key, members in groups.items():
                own = np.array(members)
                c = shared.value.get(key)
                if c is None:
                    row.append(own)
                    cluster.append(np.zeros(len(own), np.int64))
                    home.append(np.ones(len(own), bool))
                    continue
                x = unit(np.stack([values[ends[i]:ends[i + 1]] for i in members]))
                sim = x @ c.T
                best = sim.argmax(axis=1)
                r, k = np.nonzero(sim >= sim.max(axis=1, keepdims=True) - overlap)
                row.append(own[r])
                cluster.append(k)
                home.append(best[r] == k)
            if not row:
                continue
            taken = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).take(taken) for i in range(4)] + [pa.array(np.concatenate(cluster)), pa.array(np.concatenate(home))],
                ["label", "vec", "rep", "n", "cluster", "home"])

    return nodes.select("label", "vec", "rep", "n").mapInArrow(
        run, "label string, vec array<double>, rep bigint, n bigint, cluster bigint, home boolean").withColumn("dim", F.size("vec"))


class Members:
    """The members of one shard, from the array of structs that Spark collected."""

    def __init__(self, cell: pa.Scalar):
        s = cell.values
        self.rep, self.n = s.field("rep").to_numpy(), s.field("n").to_numpy()
        self.home = s.field("home").to_numpy(zero_copy_only=False)
        vec = s.field("vec")
        ends = vec.offsets.to_numpy()
        self.vec = vec.values.to_numpy()[ends[0]:ends[-1]].reshape(len(self.rep), -1)
        adj = s.field("adj")
        ends = adj.offsets.to_numpy()
        self.adj_first, self.adj_ids = ends - ends[0], adj.values.to_numpy()[ends[0]:ends[-1]]

    def graph(self) -> list[np.ndarray]:
        """United adjacency as places among the members; what lies outside of the shard is left out."""
        order = np.argsort(self.rep)
        place = np.minimum(np.searchsorted(self.rep[order], self.adj_ids), len(order) - 1)
        known = self.rep[order][place] == self.adj_ids
        node = np.repeat(np.arange(len(self.rep)), np.diff(self.adj_first))[known]
        other = order[place][known]
        edges = np.unique(np.stack([np.concatenate([node, other]), np.concatenate([other, node])], axis=1), axis=0)
        first = np.searchsorted(edges[:, 0], np.arange(len(self.rep) + 1))
        return [edges[first[i]:first[i + 1], 1] for i in range(len(self.rep))]


KEYS = ["label", "dim", "cluster"]


def _graphs(shards: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for cell in batch.column(0):
                m = Members(cell)
                adj = build_graph(unit(m.vec), int(m.rep[0]) & 0xFFFF)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m.rep), pa.array([m.rep[a] for a in adj], pa.list_(pa.int64()))], ["rep", "adj"])
    return shards.select("members").mapInArrow(run, "rep bigint, adj array<bigint>")


def _searches(jobs: DataFrame, least: float) -> DataFrame:
    """(rep, links, low) per query of a job (index members, query members or NULL for the same)."""
    def run(batches):
        for batch in batches:
            for index_cell, query_cell in zip(batch.column(0), batch.column(1)):
                index = Members(index_cell)
                query = Members(query_cell) if query_cell.is_valid else index
                own = np.arange(len(index.rep)) if query is index else np.full(len(query.rep), -1)
                links = np.zeros(len(query.rep), np.int64)
                low = query.rep.copy()
                for q, v in search(index.vec, index.graph(), query.vec, own, least):
                    here = index.home[v] & (query.rep[q] != index.rep[v])
                    np.add.at(links, q[here], index.n[v[here]])
                    np.minimum.at(low, q, index.rep[v])
                yield pa.RecordBatch.from_arrays([pa.array(query.rep), pa.array(links), pa.array(low)], ["rep", "links", "low"])
    return jobs.mapInArrow(run, "rep bigint, links bigint, low bigint")


def found_links(nodes: DataFrame, overlap: float, least: float) -> DataFrame:
    """(rep, links, low): for every node and shard it searched, the links counted there and the smallest linked node."""
    spark = nodes.sparkSession
    dealt = cut(assign(nodes, spark, overlap))
    sizes = cut(dealt.groupBy(*KEYS).agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARD)).cast("bigint").alias("salts")).where("salts > 1"))
    salted = cut(dealt.join(sizes, KEYS, "left").selectExpr(
        *KEYS, "rep", "n", "home", "vec", "IF(salts IS NULL, 0, pmod(xxhash64(rep), salts)) AS salt"))
    shard_of = [*KEYS, "salt"]

    def shards(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*shard_of).agg(F.sort_array(F.collect_list(F.struct("rep", "n", "home", "vec", "adj"))).alias("members"))

    plain = salted.withColumn("adj", F.expr("CAST(array() AS array<bigint>)"))
    lists = cut(_graphs(shards(plain)))
    united = cut(lists.select("rep", F.explode("adj").alias("other")).distinct().groupBy("rep").agg(F.collect_list("other").alias("adj")))
    ready = cut(shards(salted.join(united, "rep", "left").withColumn("adj", F.coalesce("adj", F.expr("CAST(array() AS array<bigint>)")))))
    left = ready.select(*KEYS, F.col("salt").alias("s1"), F.col("members").alias("indexed"))
    right = ready.select(*KEYS, F.col("salt").alias("s2"), F.col("members").alias("asking")).join(sizes, KEYS, "left_semi")
    jobs = left.select("indexed", F.lit(None).cast(ready.schema["members"].dataType).alias("asking")).unionByName(
        left.join(right, KEYS).where("s1 <> s2").select("indexed", "asking"))
    out = cut(_searches(jobs, least))
    for old in (dealt, sizes, salted, lists, united, ready):
        discard(old)
    return out


def audit(nodes: DataFrame, linked: DataFrame, least: float, queries: int = AUDIT) -> float:
    """Share of the links of a sample of nodes (in the order of a hash) that were found, by brute force over all nodes."""
    sample = nodes.orderBy(F.xxhash64(F.lit("audit"), "rep"), "rep").limit(queries).select("rep", "label", "vec").toPandas()
    if not len(sample):
        return 1.0
    by_label: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    sample["dim"] = sample["vec"].map(len)
    for key, part in sample.groupby(["label", "dim"]):
        by_label[(key[0], int(key[1]))] = (part["rep"].to_numpy(), np.array(part["vec"].tolist()))
    shared = nodes.sparkSession.sparkContext.broadcast(by_label)        # AUDIT vectors

    def run(batches):
        for batch in batches:
            reps, true = [], []
            for label, vec, rep, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                ids, q = shared.value.get((label, len(vec)), (None, None))
                if ids is None:
                    continue
                x = np.array(vec)
                cos = q @ x / (np.linalg.norm(q, axis=1) * np.linalg.norm(x))
                hit = (cos >= least) & (ids != rep)
                reps += ids[hit].tolist()
                true += [n] * int(hit.sum())
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(true, pa.int64())], ["rep", "true"])

    truth = nodes.select("label", "vec", "rep", "n").mapInArrow(run, "rep bigint, true bigint").groupBy("rep").agg(F.sum("true").alias("true"))
    seen = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    sums = truth.join(seen, "rep", "left").agg(
        F.sum("true").alias("t"), F.sum(F.least("true", F.coalesce("links", F.lit(0)))).alias("f")).first()
    return 1.0 if not sums["t"] else sums["f"] / sums["t"]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    least: float = LEAST_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall) for every row.

    Vectors of one label and length are linked at a cosine of ``least`` or more.  ``n_links``: other rows linked with this one;
    ``component_id``: the smallest id that can be reached; ``kept``: whether that is its own.  Vectors that are NULL, empty,
    zero, or hold a NULL or non-finite number, and rows with a NULL label, link with nothing; a row with a NULL id neither, and
    its component is NULL and it is kept.  Rows that share an id are one vertex, and each is a link of the others only where they hold the
    same vector.  An empty table gives an empty result; other columns are not read.  ``audit_recall``: see ``audit``.
    """
    rows, classes = nodes_of(vectors, id_col, vec_col, label_col)
    nodes = cut(classes)
    for overlap in OVERLAPS:
        linked = found_links(nodes, overlap, least)
        recall = audit(nodes, linked, least)
        if recall >= LEAST_RECALL:
            break
        if overlap != OVERLAPS[-1]:
            discard(linked)
    labels = components(linked.where("low <> rep").select("rep", "low"), "rep", "low")
    counts = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    reached = labels.withColumnRenamed("label", "lowest")
    per_node = cut(nodes.join(counts, "rep", "left").join(reached, F.col("rep") == F.col("node"), "left").select(
        F.col("label").alias("node_label"), F.col("vec").alias("node_vec"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("lowest", "rep").alias("component_id")))
    usable = F.col("vec_id").isNotNull()
    out = rows.join(per_node, usable & (F.col("label") == F.col("node_label")) & (F.col("vec") == F.col("node_vec")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.lit(float(recall)).alias("audit_recall"))


def oracle_sql(least: float = LEAST_COSINE) -> str:
    """DuckDB SQL of ``near_duplicates`` over ``embeddings``, by comparing all pairs (recall is then 1)."""
    return f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
 ok AS (SELECT *, sqrt(list_dot_product(x, x)) AS norm FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0
        AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
 pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
           WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= {least}),
 reach(vec_id, node) AS (SELECT DISTINCT vec_id, vec_id FROM v UNION SELECT r.vec_id, p.b FROM reach r JOIN pairs p ON r.node = p.a),
 low AS (SELECT vec_id, min(node) AS component_id FROM reach GROUP BY vec_id),
 links AS (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept, CAST(1.0 AS DOUBLE) AS audit_recall
FROM v JOIN low USING (vec_id) LEFT JOIN links USING (vec_id)"""
