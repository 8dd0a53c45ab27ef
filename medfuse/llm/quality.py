"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its hashed words, word pairs and character n-grams; a softmax layer gives
the probability of each label.  Both are trained by stochastic gradient descent in numpy on a bounded sample of labelled
documents.  For two labels, the softmax of the mean is the logistic function of the mean of one number per hash bucket,
so whole texts are scored a block at a time by table look-ups, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medfuse.llm import textbytes as tb
from medfuse.llm.common import remainder

BITS = 17
DIM = 16
EPOCHS = 8
RATE = 4.0
SAMPLE_ROWS = 2000          # labelled documents that train, at most, in the order of a hash of their id
SAMPLE_BYTES = 50_000       # longer documents do not train
SCORE_BYTES = 1 << 20       # text scored at once
THRESHOLD = 0.3
FOLDS = 5
REPEATED = np.uint64(0xA5A5A5A5)        # the pair of a word with itself, whatever the word


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(buckets, rows, number of rows) of every feature of a block; case and symbols count."""
    words = tb.Words(data, offsets, tb.NOT_BLANK, lower=False)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), words.rows
    h = words.hashes()
    together = np.flatnonzero(words.doc[1:] == words.doc[:-1])
    pairs = tb.mix(h[:-1][together] * np.uint64(31) + h[1:][together])
    pairs[h[:-1][together] == h[1:][together]] = REPEATED
    buckets, rows = [tb.bucket(h, BITS), tb.bucket(pairs + np.uint64(1), BITS)], [words.doc, words.doc[together]]
    text = np.concatenate([np.array([tb.SPACE], np.uint8), words.text])      # every word now stands between two blanks
    row = np.concatenate([words.doc[:1], np.repeat(words.doc, words.end - words.start + 1)])
    blanks = np.concatenate([[0], np.cumsum(text == tb.SPACE)])
    for n in (3, 4):
        codes = tb.grams(text, n, BITS, salt=5)
        at = np.arange(len(codes))
        inner = np.flatnonzero(blanks[at + n - 1] == blanks[at + 1])         # blanks at the ends only
        buckets.append(codes[inner])
        rows.append(row[inner + 1])
    return np.concatenate(buckets), np.concatenate(rows), words.rows


@dataclass
class Model:
    table: np.ndarray       # per bucket: its vector times the difference of the two output rows
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        buckets, rows, n = features(data, offsets)
        counts = np.bincount(rows, minlength=n)
        sums = np.bincount(rows, weights=self.table[buckets], minlength=n)
        return np.round(1 / (1 + np.exp(-np.clip(sums / np.maximum(1, counts) + self.bias, -30, 30))), 9)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> Model:
    data, offsets = tb.column_bytes(pa.array(texts, pa.large_string()))
    y = np.asarray(labels, np.int64)
    docs = []
    for i in range(len(texts)):
        buckets, _, _ = features(data[offsets[i]:offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
        kinds, counts = np.unique(buckets, return_counts=True)
        docs.append((kinds, (counts / max(1, counts.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            lr = rate * (1 - done / steps)
            done += 1
            kinds, share = docs[i]
            mean = share @ vectors[kinds]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= lr * 0.2 * np.outer(mean, p)
            bias -= lr * 0.01 * p
            vectors[kinds] -= lr * share[:, None] * back[None, :]
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Train on labelled rows whose crc32(id) mod 5 is not 0: the first ``sample_rows`` in the order of a hash of the id,
    without texts over ``SAMPLE_BYTES``.  None without such a row."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(
        (remainder("id", FOLDS) != 0) & F.col("label").isin(0, 1))
    picked = known.distinct().orderBy(F.xxhash64(F.lit("quality"), "id"), "id", "label").limit(sample_rows).toPandas()
    if not len(picked):
        return None
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(
        F.col("id").isin(picked["id"].unique().tolist()) & (F.octet_length("text") <= SAMPLE_BYTES)).toPandas()
    sample = picked.merge(texts.drop_duplicates(), on="id").sort_values(["id", "label", "text"])
    return train(sample["text"].tolist(), sample["label"].tolist()) if len(sample) else None


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    ``score``: probability of label 1, to 9 digits.  NULL, empty and blank texts have no features and get the model's
    bias alone.  ``held_out``: crc32(id) mod 5 is 0; neither such rows nor rows with a NULL id train (the latter are not held
    out).  Labels other than 0 and 1 are not used; without a label every score is 0.5.  Repeated rows get equal
    results; an empty table gives an empty result; other columns are not read.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)            # 2^BITS numbers

    def run(batches):
        m = shared.value
        for batch in batches:
            for first, end, data, offsets in tb.blocks(batch.column(1), SCORE_BYTES):
                scores = m.score(data, offsets) if m else np.full(end - first, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(scores)], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(remainder("doc_id", FOLDS) == 0, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
