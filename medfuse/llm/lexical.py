"""Ranked lexical search by Block-Max MaxScore over compressed shards of an inverted index.

Index: each task cuts its documents into shards of about ``SHARD_BYTES`` of text.  A shard numbers its documents by
length, holds every term (as a 64-bit hash) with its postings in blocks of ``BLOCK`` documents, each block packed by
itself into the fewest bytes a value, and beside each block its last document and the pairs (tf, n) that no other pair of the block beats.  Only
shards are written; with the counts that they carry the weights of any query follow.

Search: the pairs give each block, and so each list, the exact maximum of its contributions.  For a query the lists are
ordered by their maxima; those that together cannot reach the tenth score so far are not essential.  Candidates come
from the essential lists only, and meet the other lists from the largest to the smallest: a candidate whose score, block
maximum and remaining list maxima stay below the tenth score goes before the block is decompressed.  A task keeps one
heap for each query over all of its shards; the heaps of all tasks are merged by one window.

Terms with equal hashes would be one term; for v terms in all and q in the queries the odds are v * q / 2^64.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medfuse.llm import textbytes as tb
from medfuse.llm.common import cut, discard

TOP = 10
SHARD_BYTES = 24 << 20      # text of a shard (or one longer text)
BLOCK = 128                 # postings of a block
QUERY_BYTES = 8 << 20       # text of the queries that are searched in one pass over the index
SCALE = 1_000_000_000
ALNUM = tb.ALNUM            # runs of a-z (A-Z lower-cased), 0-9 and bytes from 0x80 up

INDEX_SCHEMA = ("n_docs bigint, n_words bigint, ids binary, named binary, lengths binary, terms binary, df binary, last binary, "
                "widths binary, data binary, pairs binary, pair_tf binary, pair_n binary")


def blocks_of(df: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of postings of every block of lists of these sizes, and the first block of every list (one entry more)."""
    blocks = -(-df // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    counts = np.full(first[-1], BLOCK, np.int64)
    counts[first[1:] - 1] = df - (blocks - 1) * BLOCK
    return counts, first


def spread(first: np.ndarray, counts: np.ndarray, step: np.ndarray) -> np.ndarray:
    """first, first + step, ... (``counts`` of them) for each entry, one after another."""
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(first, counts) + within * np.repeat(step, counts)


def byte_width(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bytes (1, 2 or 4) that hold the largest value of each block."""
    top = np.maximum.reduceat(values, starts) if len(starts) else np.zeros(0, np.int64)
    return np.where(top < 1 << 8, 1, np.where(top < 1 << 16, 2, 4))


def put(data: np.ndarray, at: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    for k in range(4):
        wide = width > k
        data[at[wide] + k] = (values[wide] >> (8 * k)) & 255


def take(data: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    out = data[at].astype(np.int64)
    for k in range(1, int(width.max(initial=1))):
        wide = np.flatnonzero(width > k)
        out[wide] |= data[at[wide] + k].astype(np.int64) << (8 * k)
    return out


def build_shard(ids: list, lengths: np.ndarray, terms: np.ndarray, docs: np.ndarray, tf: np.ndarray) -> tuple:
    """Index row of one shard from its postings (term hash, document, tf); documents are renumbered by length.

    A block's gaps between documents and its tfs take 1, 2 or 4 bytes each, by the largest; ``widths`` holds both.
    """
    order = np.argsort(lengths, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    docs, n = place[docs], lengths[order]
    by = np.lexsort((docs, terms))
    terms, docs, tf = terms[by], docs[by], tf[by].astype(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
    df = np.diff(np.append(heads, len(terms)))
    counts, _ = blocks_of(df)
    starts = np.cumsum(counts) - counts
    gaps = np.diff(docs, prepend=0)
    gaps[starts] = docs[starts]
    gap_width, tf_width = byte_width(gaps, starts), byte_width(tf, starts)
    size = counts * (gap_width + tf_width)
    first_byte = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    put(data, spread(first_byte, counts, gap_width), gaps, np.repeat(gap_width, counts))
    put(data, spread(first_byte + counts * gap_width, counts, tf_width), tf, np.repeat(tf_width, counts))
    # the pairs (tf, n) of a block that no pair of a shorter document beats: documents stand by length already
    block = np.repeat(np.arange(len(counts)), counts)
    best = np.maximum.accumulate(tf + block * (int(tf.max(initial=0)) + 1))
    pair = np.flatnonzero(np.concatenate([[True], best[1:] > best[:-1]])) if len(best) else np.zeros(0, np.int64)
    known = [ids[i] for i in order.tolist()]
    return (int((lengths > 0).sum()), int(lengths.sum()), np.array([i or 0 for i in known], np.int64).tobytes(),
            np.array([i is not None for i in known], np.bool_).tobytes(), n.astype(np.int64).tobytes(), terms[heads].tobytes(),
            df.astype(np.int32).tobytes(), docs[starts + counts - 1].astype(np.int32).tobytes(),
            (gap_width + 8 * tf_width).astype(np.uint8).tobytes(), data.tobytes(),
            np.bincount(block[pair], minlength=len(counts)).astype(np.uint8).tobytes(), tf[pair].astype(np.int32).tobytes(),
            n[docs[pair]].astype(np.int32).tobytes())


def _index(shard_bytes: int):
    def run(batches):
        ids, lengths, terms, docs, tfs, size = [], [], [], [], [], 0

        def shard():
            row = build_shard(ids, np.concatenate(lengths), np.concatenate(terms), np.concatenate(docs), np.concatenate(tfs))
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if i < 2 else pa.binary()) for i, v in enumerate(row)],
                                              [f.split()[0] for f in INDEX_SCHEMA.split(", ")])

        for batch in batches:
            known = batch.column(0).to_pylist()
            for first, end, data, offsets in tb.blocks(batch.column(1)):
                words = tb.Words(data, offsets, ALNUM)
                hashes = words.hashes()
                by = np.lexsort((hashes, words.doc))
                h, d = hashes[by], words.doc[by]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.zeros(0, np.int64)
                terms.append(h[new])
                docs.append(d[new] + len(ids))
                tfs.append(np.diff(np.append(new, len(h))))
                lengths.append(words.counts())
                ids.extend(known[first:end])
                size += len(data) + 8 * (end - first)
                if size >= shard_bytes:
                    yield shard()
                    ids, lengths, terms, docs, tfs, size = [], [], [], [], [], 0
        if ids:
            yield shard()
    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The written index of ``docs``, one row a shard; every row of ``docs`` is in it, without a shuffle.

    A NULL or empty text has no terms and counts neither among the documents nor in their length; a repeated row is a
    document of its own; a row with a NULL id counts in all statistics but is never returned, as nothing names it.
    """
    return cut(docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
               .mapInArrow(_index(shard_bytes), INDEX_SCHEMA))


class Shard:
    """Read side of one index row, with the maxima of its blocks for given totals."""

    def __init__(self, row: dict, n_docs: int, n_words: int):
        def ints(name, kind=np.int32):
            return np.frombuffer(row[name], kind).astype(np.int64)

        self.n, self.ids = ints("lengths", np.int64), ints("ids", np.int64)
        self.named = np.frombuffer(row["named"], np.bool_)
        self.norm = 10 + 90 * self.n * n_docs // max(1, n_words)
        self.terms, df, self.last = np.frombuffer(row["terms"], np.uint64), ints("df"), ints("last")
        widths = ints("widths", np.uint8)
        self.gap_width, self.tf_width, self.data = widths & 7, widths >> 3, np.frombuffer(row["data"], np.uint8)
        self.counts, self.first_block = blocks_of(df)
        size = self.counts * (self.gap_width + self.tf_width)
        self.first_byte = np.cumsum(size) - size
        best = impact(ints("pair_tf"), 10 + 90 * ints("pair_n") * n_docs // max(1, n_words))
        pairs = ints("pairs", np.uint8)
        self.block_max = np.maximum.reduceat(best, np.cumsum(pairs) - pairs) if len(pairs) else np.zeros(0, np.int64)

    def find(self, term: int) -> int | None:
        at = int(np.searchsorted(self.terms, np.uint64(term)))
        return at if at < len(self.terms) and int(self.terms[at]) == term else None

    def blocks(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impact) of these blocks, decompressed."""
        counts, gap_width, tf_width, first = self.counts[which], self.gap_width[which], self.tf_width[which], self.first_byte[which]
        gaps = take(self.data, spread(first, counts, gap_width), np.repeat(gap_width, counts))
        tf = take(self.data, spread(first + counts * gap_width, counts, tf_width), np.repeat(tf_width, counts))
        sums = np.cumsum(gaps)
        ends = np.cumsum(counts)
        docs = sums - np.repeat(np.concatenate([[0], sums[ends[:-1] - 1]]) if len(ends) else ends, counts)
        return docs, impact(tf, self.norm[docs])


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Share of a term's weight that a document gets; grows with tf and falls with the document's length."""
    return (SCALE * tf) // (1000 * tf + 8 * norm)


def search_shard(shard: Shard, terms: list[tuple[int, int]], least: tuple[int, int] | None, top: int) -> list[tuple[int, int]]:
    """(score, doc id) of the shard's documents that may be among the ``top`` best of a query of (term, weight).

    ``least``: the worst (score, id) of a full heap so far; what stays behind it is not searched for.
    """
    lists = []
    for term, weight in terms:
        at = shard.find(term)
        if at is not None and weight > 0:
            a, z = shard.first_block[at:at + 2].tolist()
            maxima = weight * shard.block_max[a:z]
            lists.append((int(maxima.max()), weight, a, z, maxima))
    lists.sort(key=lambda x: x[0])
    below = np.concatenate([[0], np.cumsum([x[0] for x in lists])]).astype(np.int64)     # the lists before the i-th together
    bar = least[0] if least else 1
    essential = int(np.searchsorted(below[1:], bar, side="left"))       # lists before it cannot reach the bar together
    if essential == len(lists):
        return []
    scores = np.zeros(len(shard.n), np.int64)
    for _, weight, a, z, _ in lists[essential:]:
        docs, got = shard.blocks(np.arange(a, z))
        scores[docs] += weight * got
    candidates = np.flatnonzero((scores > 0) & shard.named)
    for i in range(essential - 1, -1, -1):
        got = scores[candidates]
        if len(candidates) > top:       # the tenth best known part of a score is a bar as well
            bar = max(bar, int(np.partition(got, len(got) - top)[len(got) - top]))
        candidates = candidates[got + below[i + 1] >= bar]
        if not len(candidates):
            return []
        _, weight, a, z, maxima = lists[i]
        block = np.searchsorted(shard.last[a:z], candidates)        # the block that would hold the candidate
        inside = block < z - a
        bound = np.where(inside, maxima[np.minimum(block, z - a - 1)], 0)
        alive = scores[candidates] + bound + below[i] >= bar
        wanted = np.unique(block[alive & inside])
        candidates = candidates[alive]
        if len(wanted):
            docs, got = shard.blocks(wanted + a)
            scores[docs] += weight * got
    got = scores[candidates]
    keep = got >= max(bar, 1)
    candidates, got = candidates[keep], got[keep]
    best = np.lexsort((shard.ids[candidates], -got))[:top]
    return list(zip(got[best].tolist(), shard.ids[candidates[best]].tolist()))


def _searcher(shared, n_docs: int, n_words: int, top: int):
    def run(batches):
        queries = shared.value
        heaps: list[list[tuple[int, int]]] = [[] for _ in queries]      # (-score, id), best first
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, n_docs, n_words)
                for i, (_, terms) in enumerate(queries):
                    heap = heaps[i]
                    worst = (-heap[-1][0], heap[-1][1]) if len(heap) == top else None
                    found = search_shard(shard, terms, worst, top)
                    if found:
                        heaps[i] = sorted(heap + [(-s, d) for s, d in found])[:top]
        rows = [(queries[i][0], d, -s) for i, heap in enumerate(heaps) for s, d in heap]
        if rows:
            q, d, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.int64())], ["query", "doc_id", "score"])
    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def query_terms(texts: list[str | None]) -> list[list[int]]:
    """Distinct term hashes of each text."""
    data, offsets = tb.column_bytes(pa.array([t or "" for t in texts], pa.large_string()))
    if not len(data):
        return [[] for _ in texts]
    words = tb.Words(data, offsets, ALNUM)
    hashes = words.hashes()
    return [np.unique(hashes[words.first[i]:words.first[i + 1]]).tolist() for i in range(len(texts))]


def document_frequencies(index: DataFrame, terms: list[int]) -> dict[int, int]:
    """Documents that hold each of ``terms``, summed over all shards: one row a term of the queries comes back."""
    wanted = index.sparkSession.sparkContext.broadcast(np.array(sorted(terms), np.uint64))

    def run(batches):
        total = np.zeros(len(wanted.value), np.int64)
        for batch in batches:
            for t, df in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = np.frombuffer(t, np.uint64)
                at = np.minimum(np.searchsorted(held, wanted.value), max(0, len(held) - 1))
                if len(held):
                    total += np.where(held[at] == wanted.value, np.frombuffer(df, np.int32)[at], 0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["term", "df"])

    found = index.select("terms", "df").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()
    ordered = wanted.value.tolist()
    return {ordered[r["term"]]: r["df"] for r in found}


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", top: int = TOP, shard_bytes: int = SHARD_BYTES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` the ``top`` documents of highest score above 0.

    Equal scores rank by ascending document id; ranks are unique.  An item with a NULL or empty text finds nothing; a
    repeated item is answered each time, an item with a NULL id under that id.  For NULL, empty and repeated documents see
    ``build_index``; empty tables give an empty result; columns beyond the four named are not read.  Queries are read in
    blocks of about ``query_bytes`` of text, one pass over the index each, so what is broadcast is bounded.
    """
    spark = docs.sparkSession
    index = build_index(docs, id_col, text_col, shard_bytes)
    totals = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).first()
    items = cut(items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
                .withColumn("query", F.monotonically_increasing_id()))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    parts, found = int(size // query_bytes) + 1, None
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part).select("query", "text").collect()    # about query_bytes
        terms = query_terms([r["text"] for r in rows])
        df = document_frequencies(index, list({t for ts in terms for t in ts}))
        queries = [(r["query"], [(t, weight(totals["docs"], df[t])) for t in ts if t in df]) for r, ts in zip(rows, terms)]
        shared = spark.sparkContext.broadcast(queries)
        heaps = index.mapInArrow(_searcher(shared, totals["docs"], totals["words"], top), "query bigint, doc_id bigint, score bigint")
        found = heaps if found is None else found.unionByName(heaps)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
    best = cut(found.withColumn("rank", place).where(F.col("rank") <= top))
    out = cut(best.join(items, "query").select("item_id", "rank", "doc_id", "score"))
    for old in (index, items, best):
        discard(old)
    return out


def oracle_sql(top: int = TOP) -> str:
    """DuckDB SQL of ``search`` over ``documents`` and ``benchmark``: every score of every document."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, unnest({words}) AS term FROM documents),
 lengths AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
 totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM lengths),
 postings AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY 1, 2),
 weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
             FROM (SELECT term, count(*) AS df FROM postings GROUP BY 1), totals),
 q AS (SELECT DISTINCT item_id, unnest({words}) AS term FROM benchmark),
 scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) AS BIGINT) AS score
            FROM q JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), totals GROUP BY 1, 2),
 ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
            FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {top}"""
