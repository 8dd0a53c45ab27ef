"""Benchmark decontamination: an FM-index over each shard of documents, searched for every benchmark window.

A shard is a block of a partition's documents, as a sequence of word numbers: the benchmark's words by rank, every
other word as a symbol of its own.  Its suffixes are sorted whole (prefix doubling over the suffixes that are not yet
alone), and the Burrows-Wheeler sequence is held as a wavelet matrix.  All windows are searched backwards at once by
ranks in it; occurrences are found by walking back to sampled suffix positions, compared with the window's words byte
by byte, and merged into removal spans.  Documents never move: there is no shuffle.

The benchmark goes to the tasks in blocks of at most ``BLOCK_BYTES`` of text, one pass over the documents each, whose
spans and items are merged; so what is broadcast is bounded however large the benchmark is.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medfuse.llm import textbytes as tb
from medfuse.llm.common import fresh

WINDOW = 13
BLOCK_BYTES = 16 << 20
SHARD_WORDS = 1 << 20       # words of a shard's index; longer sequences continue in the next one with an overlap
SAMPLE = 16                 # every sixteenth word position is sampled


class Phrases:
    """Distinct windows of some benchmark items as word numbers, and the items that hold each."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        column = pa.array([t or "" for _, t in items], pa.large_string())
        data, offsets = tb.column_bytes(column)
        words = tb.Words(data, offsets, tb.ALNUM)
        self.vocabulary, ids = np.unique(words.hashes(), return_inverse=True)
        ids = ids.ravel().astype(np.int64) + 1
        raw = words.text.tobytes()
        self.words = [b""] * (len(self.vocabulary) + 1)
        for number, a, b in zip(ids.tolist(), words.start.tolist(), words.end.tolist()):
            self.words[number] = raw[a:b]
        at: dict[tuple[int, ...], set[str]] = {}
        for row, (item, _) in enumerate(items):
            seq = ids[words.first[row]:words.first[row + 1]].tolist()
            for i in range(max(1, len(seq) - window + 1) if seq else 0):
                at.setdefault(tuple(seq[i:i + window]), set()).add(item)
        self.windows = list(at)
        self.items = [sorted(at[w]) for w in self.windows]
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        self.table = np.zeros((len(self.windows), window), np.int64)
        for i, w in enumerate(self.windows):
            self.table[i, :len(w)] = w


class ShardIndex:
    """FM-index of one sequence: numbers from 1 up are searchable, every 0 is a symbol that equals nothing else."""

    def __init__(self, seq: np.ndarray, symbols: int):
        n = len(seq)
        sa = suffix_array(seq)
        self.n = n
        bwt = np.where(sa > 0, seq[sa - 1], 0)
        self.bwt = bwt
        counts = np.bincount(seq, minlength=symbols + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)])          # suffixes with a smaller first symbol
        sampled = (sa % SAMPLE == 0) | (bwt == 0)                       # a walk ends here
        self.sampled = sampled
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)])
        self.samples = sa[sampled]
        self.levels = []
        rest = bwt
        for bit in reversed(range(max(1, int(symbols).bit_length()))):
            ones = (rest >> bit) & 1
            rank = np.zeros(n + 1, np.int32)
            np.cumsum(ones, out=rank[1:])
            self.levels.append((bit, rank, n - int(rank[-1])))
            ones = ones.astype(bool)
            rest = np.concatenate([rest[~ones], rest[ones]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` stands before ``place`` in the Burrows-Wheeler sequence, by wavelet ranks."""
        low = np.zeros_like(place)
        for bit, rank, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            rl, rp = rank[low], rank[place]
            low = np.where(one, zeros + rl, low - rl)
            place = np.where(one, zeros + rp, place - rp)
        return place - low

    def search(self, table: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, first row, end row) of the suffix range of each window that occurs."""
        which = np.arange(len(table))
        last = table[which, lengths - 1]
        lo, hi = self.before[last], self.before[last + 1]
        for back in range(2, table.shape[1] + 1):
            alive = hi > lo
            which, lo, hi = which[alive], lo[alive], hi[alive]
            go = np.flatnonzero(lengths[which] >= back)
            if not len(go):
                break
            symbol = table[which[go], lengths[which[go]] - back]
            base = self.before[symbol]
            lo[go], hi[go] = base + self.rank(symbol, lo[go]), base + self.rank(symbol, hi[go])
        alive = hi > lo
        return which[alive], lo[alive], hi[alive]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row: walk back to a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        going = np.flatnonzero(~self.sampled[rows])
        while len(going):
            symbol = self.bwt[rows[going]]
            rows[going] = self.before[symbol] + self.rank(symbol, rows[going])
            steps[going] += 1
            going = going[~self.sampled[rows[going]]]
        return self.samples[self.sample_rank[rows]] + steps


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; only suffixes that still tie with another are sorted again."""
    n = len(seq)
    symbol = np.where(seq > 0, seq + n, np.arange(n))       # zeros first, each for itself by position
    sa = np.argsort(symbol, kind="stable")
    ordered = symbol[sa]
    head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(head, n))
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(head, size)
    tied = sa[np.repeat(size, size) > 1]
    h = 1
    while len(tied):
        # a tied suffix never runs off the end: the sequence ends with a zero, which ties with nothing
        order = np.lexsort((rank[tied + h], rank[tied]))
        tied = tied[order]
        first, second = rank[tied], rank[tied + h]
        new_group = np.concatenate([[True], first[1:] != first[:-1]])
        new_run = new_group | np.concatenate([[True], second[1:] != second[:-1]])
        place = np.arange(len(tied))
        group_at = np.maximum.accumulate(np.where(new_group, place, 0))
        run_at = np.maximum.accumulate(np.where(new_run, place, 0))
        sa[first + place - group_at] = tied
        rank[tied] = first + run_at - group_at
        runs = np.flatnonzero(new_run)
        lengths = np.diff(np.append(runs, len(tied)))
        tied = tied[np.repeat(lengths, lengths) > 1]
        h *= 2
    return sa


def block_hits(data: np.ndarray, offsets: np.ndarray, phrases: Phrases, window: int):
    """Per block: words of each row, and (row, window, first word in the row) of every occurrence."""
    words = tb.Words(data, offsets, tb.ALNUM)
    hashes = words.hashes()
    slot = np.searchsorted(phrases.vocabulary, hashes)
    slot = np.minimum(slot, max(0, len(phrases.vocabulary) - 1))
    known = phrases.vocabulary[slot] == hashes if len(phrases.vocabulary) else np.zeros(len(hashes), bool)
    # a zero after each row's words keeps occurrences inside one row
    seq = np.zeros(len(words) + words.rows, np.int64)
    own = np.arange(len(words)) + words.doc
    seq[own] = np.where(known, slot + 1, 0)
    found_window, found_at = [], []
    for a in range(0, len(seq), SHARD_WORDS):
        part = np.append(seq[a:a + SHARD_WORDS + window - 1], 0)
        index = ShardIndex(part, len(phrases.vocabulary))
        which, lo, hi = index.search(phrases.table, phrases.lengths)
        if not len(which):
            continue
        rows = np.repeat(lo, hi - lo) + (np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo))
        at = index.locate(rows)
        which = np.repeat(which, hi - lo)
        own_part = at < SHARD_WORDS                          # what begins in the overlap belongs to the next shard
        found_window.append(which[own_part])
        found_at.append(at[own_part] + a)
    if not found_at:
        none = np.zeros(0, np.int64)
        return words, none, none, none
    which, at = np.concatenate(found_window), np.concatenate(found_at)
    place = np.searchsorted(own, at)                         # word number in the block
    raw = words.text.tobytes()
    same = np.array([all(raw[words.start[p + k]:words.end[p + k]] == phrases.words[w] for k, w in enumerate(phrases.windows[i]))
                     for i, p in zip(which.tolist(), place.tolist())], bool)
    which, place = which[same], place[same]
    row = words.doc[place]
    return words, row, which, place - words.first[row]


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                       item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                       carry_text: bool = True) -> tuple[DataFrame, list[str]]:
    """``docs`` with three columns more: words, removal spans and items found; and the names of these columns.

    Without ``carry_text`` the text column is left out of the result, which spares its way back from the Python workers.

    Words are runs of letters, digits and all characters from U+0080 up, with A-Z lower-cased.  A window is ``window``
    consecutive words of an item, or a shorter item as a whole.  The columns: number of words (bigint); spans
    (array of struct first, end: word numbers, merged, of everything inside an occurrence); ids of the items
    whose windows occur (sorted array of string).  A NULL or empty text has no words and no spans; an item without words
    matches nothing; an item with a NULL id marks its words and is named by the empty string; repeated rows and items
    change nothing; an empty benchmark gives no spans.  The names do not clash with columns of ``docs``.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    parts = int(total // block_bytes) + 1
    n_words, spans, found = names = fresh(docs, "n_words", "spans", "items")
    out = docs.select("*", F.lit(0).cast("bigint").alias(n_words), F.expr("CAST(array() AS array<struct<first: bigint, end: bigint>>)").alias(spans),
                      F.expr("CAST(array() AS array<string>)").alias(found))
    schema = out.schema
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).collect()     # at most about block_bytes of text
        shared = spark.sparkContext.broadcast(Phrases([(r["item"], r["text"]) for r in rows], window))
        text_at = docs.columns.index(text_col)
        drop = part == parts - 1 and not carry_text
        fields = [f for i, f in enumerate(schema.fields) if not (drop and i == text_at)]
        out = out.mapInArrow(_searcher(shared, text_at, len(docs.columns), window, drop), T.StructType(fields))
    return out, names


def _searcher(shared, text_at: int, width: int, window: int, drop: bool):
    def run(batches):
        phrases = shared.value
        for batch in batches:
            kept_words, kept_spans, kept_items = [], [], []
            old_spans, old_items = batch.column(width + 1).to_pylist(), batch.column(width + 2).to_pylist()
            for first, end, data, offsets in tb.blocks(batch.column(text_at)):
                words, row, which, at = block_hits(data, offsets, phrases, window)
                kept_words.append(words.counts())
                by_row: dict[int, list[tuple[int, int]]] = {}
                for r, i, p in zip(row.tolist(), which.tolist(), at.tolist()):
                    by_row.setdefault(r, []).append((i, p))
                for r in range(end - first):
                    spans, items = old_spans[first + r], old_items[first + r]
                    if r in by_row:
                        hits = by_row[r]
                        spans = merge_spans([(s["first"], s["end"]) for s in spans] + [(p, p + len(phrases.windows[i])) for i, p in hits])
                        spans = [{"first": a, "end": b} for a, b in spans]
                        items = sorted({*items, *(x for i in {i for i, _ in hits} for x in phrases.items[i])})
                    kept_spans.append(spans)
                    kept_items.append(items)
            names = [n for i, n in enumerate(batch.schema.names) if not (drop and i == text_at)]
            columns = [batch.column(i) for i in range(width) if not (drop and i == text_at)]
            columns += [pa.array(np.concatenate(kept_words) if kept_words else [], pa.int64()),
                        pa.array(kept_spans, batch.schema.field(width + 1).type), pa.array(kept_items, batch.schema.field(width + 2).type)]
            yield pa.RecordBatch.from_arrays(columns, names)
    return run


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts, digest of the items found, and whether the document is contaminated.

    A document is contaminated if a word is hit and at least one word in twenty is.  See ``find_contamination`` for NULLs,
    empty texts, repeated rows and empty tables.
    """
    found, (n_words, spans, items) = find_contamination(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, carry_text=False)
    hit = F.aggregate(spans, F.lit(0).cast("bigint"), lambda t, s: t + s["end"] - s["first"])
    return found.select(
        "doc_id", F.col(n_words).alias("n_words"), hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), F.col(spans).alias("spans")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged."""
    found, (n_words, spans, _) = find_contamination(docs, benchmark, text_col)
    hit = F.aggregate(spans, F.lit(0).cast("bigint"), lambda t, s: t + s["end"] - s["first"])
    return found.where(~((hit > 0) & (20 * hit >= F.col(n_words)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def items_digest(items: list[str]) -> str:
    """The digest that ``report`` gives for these items."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def oracle_sql(window: int = WINDOW) -> str:
    """DuckDB SQL of ``report`` over ``documents`` and ``benchmark`` (without spans), by joining word lists."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
 b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words} AS w FROM benchmark),
 windows AS (SELECT DISTINCT item, w[i:i + least(len(w), {window}) - 1] AS win
             FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {window} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
 sizes AS (SELECT DISTINCT len(win) AS size FROM windows),
 places AS (SELECT doc_id, size, w[i:i + size - 1] AS win, i
            FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
 found AS (SELECT doc_id, i, size, item FROM places JOIN windows USING (win)),
 hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM found) GROUP BY doc_id),
 items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS told FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(told, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""
