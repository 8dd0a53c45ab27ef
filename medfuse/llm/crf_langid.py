"""Language identification by a linear-chain conditional random field over words.

Each word has affix, n-gram and lexicon features (hashed to a fixed table); the weights and the transitions between
languages are learned by stochastic gradient steps on code-switched training sequences, whose word labels are the
languages of the documents they come from.  Forward-backward gives each word of a text its probability for
every language; the words' mean decides for the text.  Words are scored a block of documents at a time, and each
distinct word of a block once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medfuse.llm import textbytes as tb
from medfuse.llm.common import fresh, remainder

BITS = 17                   # size of the feature table, as a power of two
SAMPLE_ROWS = 300           # training documents of one language at most, in the order of a hash of their id
SAMPLE_BYTES = 20_000       # longer documents do not train
MAX_LANGUAGES = 200
CHUNK = 1 << 14             # distinct words whose features are made at once
UNKNOWN = "und"
SEQUENCE = 64               # words of a training sequence
EPOCHS = 3


def word_features(words: tb.Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_some_features`` of any number of words, a few thousand at a time."""
    parts = [_some_features(words, which[a:a + CHUNK]) for a in range(0, len(which), CHUNK)]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    sizes = np.concatenate([np.diff(first) for _, first in parts])
    return np.concatenate([buckets for buckets, _ in parts]), np.concatenate([[0], np.cumsum(sizes)])


def _some_features(words: tb.Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, first): feature buckets of the words numbered ``which``, one run of buckets per word.

    Lexicon feature: the whole word.  N-gram features: its runs of one to four bytes, with a blank on either side.  Affix
    features: its first and last two, three and four bytes.
    """
    lengths = (words.end - words.start)[which]
    rows = np.repeat(np.arange(len(which)), lengths + 2)
    begin = np.concatenate([[0], np.cumsum(lengths + 2)])
    within = np.arange(len(rows)) - begin[rows]
    text = np.full(len(rows), tb.SPACE, np.uint8)
    inner = (within > 0) & (within <= lengths[rows])
    text[inner] = words.text[(words.start[which][rows] + within - 1)[inner]]
    found, owner = [], []
    for n in range(1, 5):
        codes = tb.grams(text, n, BITS, salt=1)
        inside = within[:len(codes)] + n <= lengths[rows[:len(codes)]] + 2
        found.append(codes[inside])
        owner.append(rows[:len(codes)][inside])
    for n in range(2, 5):
        codes = tb.grams(text, n, BITS, salt=2)
        fits = np.flatnonzero(lengths >= n)
        found += [codes[begin[fits] + 1], tb.grams(text, n, BITS, salt=3)[begin[fits] + 1 + lengths[fits] - n]]
        owner += [fits, fits]
    hashes = words.hashes()[which]
    found.append(tb.bucket(hashes, BITS))
    owner.append(np.arange(len(which)))
    buckets, owners = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return buckets[order].astype(np.int32), np.searchsorted(owners[order], np.arange(len(which) + 1))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray         # feature bucket x language
    transitions: np.ndarray     # language x language, log
    start: np.ndarray           # language, log

    def emissions(self, words: tb.Words) -> np.ndarray:
        """Word x language scores; each distinct word is scored once."""
        _, sample, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        scores = np.empty((len(sample), len(self.languages)))
        for a in range(0, len(sample), CHUNK):
            buckets, first = _some_features(words, sample[a:a + CHUNK])
            scores[a:a + CHUNK] = np.add.reduceat(self.weights[buckets], first[:-1], axis=0, dtype=np.float64) / np.sqrt(np.diff(first))[:, None]
        return scores[back.ravel()]


def forward_backward(emissions: np.ndarray, first: np.ndarray, lengths: np.ndarray, transitions: np.ndarray,
                     start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word x language probabilities of sequences that begin at ``first``; all sequences advance together, longest first.

    Also the forward weights of each word, and what its own emission and all words after it weigh (both scaled by word).
    """
    order = np.argsort(-lengths, kind="stable")
    first, lengths = first[order], lengths[order]
    psi = np.exp(emissions - emissions.max(axis=1, keepdims=True)) + 1e-30
    step, begin = np.exp(transitions), np.exp(start)
    alpha, beta = np.empty_like(psi), np.ones_like(psi)
    longest = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(longest), side="left")      # sequences longer than t
    for t in range(longest):
        at = first[:alive[t]] + t
        a = psi[at] * (begin if t == 0 else alpha[at - 1] @ step)
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        at = first[:alive[t + 1]] + t
        b = (psi[at + 1] * beta[at + 1]) @ step.T
        beta[at] = b / b.sum(axis=1, keepdims=True)
    out = alpha * beta
    return out / out.sum(axis=1, keepdims=True), alpha, psi * beta


def train(texts: list[str], labels: list[str], epochs: int = EPOCHS, seed: int = 7) -> Model | None:
    """Learn weights and transitions; None without a labelled word."""
    languages = sorted(set(labels))
    data, offsets = tb.column_bytes(pa.array([t.lower() for t in texts], pa.large_string()))
    words = tb.Words(data, offsets, tb.LETTER)
    if not len(words):
        return None
    label = np.array([languages.index(x) for x in labels])[words.doc]
    rng = np.random.default_rng(seed)
    # code-switched order: each text is cut into stretches of 1 to 40 words, and the stretches are shuffled
    cuts = np.unique(np.concatenate([words.first[:-1][words.counts() > 0],
                                     np.cumsum(rng.integers(1, 41, size=len(words) // 8 + 2))]))
    cuts = cuts[cuts < len(words)]
    stretches = np.split(np.arange(len(words)), cuts[cuts > 0])
    _, sample, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
    back = back.ravel()
    buckets, begin = word_features(words, sample)
    k = len(languages)
    weights = np.zeros((1 << BITS, k))
    scale = np.zeros(1 << BITS) + 1e-8                       # of the squared gradients (AdaGrad, one rate for each bucket)
    transitions, start = np.full((k, k), -1.0) + np.eye(k), np.zeros(k)
    for _ in range(epochs):
        order = np.concatenate([stretches[i] for i in rng.permutation(len(stretches))])
        for a in range(0, len(order), SEQUENCE * 64):
            batch = order[a:a + SEQUENCE * 64]
            firsts = np.arange(0, len(batch), SEQUENCE)
            lengths = np.minimum(SEQUENCE, len(batch) - firsts)
            kinds, where = np.unique(back[batch], return_inverse=True)
            sizes = (begin[kinds + 1] - begin[kinds])
            rows = np.repeat(np.arange(len(kinds)), sizes)
            feats = buckets[np.repeat(begin[kinds], sizes) + np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
            norm = 1 / np.sqrt(np.maximum(1, sizes))
            scores = tb.group_sums(weights[feats], np.concatenate([[0], np.cumsum(sizes)])) * norm[:, None]
            emit = scores[where]
            posterior, ahead, behind = forward_backward(emit, firsts, lengths, transitions, start)
            truth = np.eye(k)[label[batch]]
            grad = np.zeros((len(kinds), k))
            np.add.at(grad, where, posterior - truth)
            grad = (grad * norm[:, None])[rows] / len(firsts)
            slots, slot = np.unique(feats, return_inverse=True)
            total = np.zeros((len(slots), k))
            np.add.at(total, slot, grad)
            scale[slots] += (total ** 2).sum(axis=1)
            weights[slots] -= 0.3 * total / np.sqrt(scale[slots])[:, None]
            # transitions: pairs expected by forward-backward against pairs seen
            pair = np.ones(len(batch), bool)
            pair[firsts] = False
            after = np.flatnonzero(pair)
            joint = ahead[after - 1][:, :, None] * np.exp(transitions)[None] * behind[after][:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            seen = truth[after - 1].T @ truth[after]
            if len(after):
                transitions -= 0.5 * (joint.sum(axis=0) - seen) / len(after)
            start -= 0.5 * (posterior[firsts] - truth[firsts]).mean(axis=0)
    return Model(languages, weights.astype(np.float32), transitions, start)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Train on ``text`` and non-NULL ``lang`` of rows whose crc32(id) mod 4 is not 2.

    The sample is bounded: the first ``sample_rows`` ids of each language in the order of a hash of the id, without texts
    over ``SAMPLE_BYTES``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        (remainder("id", 4) != 2) & F.col("lang").isNotNull())
    languages = [r["lang"] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in the labels")
    picked = [r["id"] for lang in sorted(languages) for r in rows.where(F.col("lang") == lang).select("id").distinct().orderBy(
        F.xxhash64(F.lit("langid"), "id"), "id").limit(sample_rows).collect()]
    if not picked:
        return None
    # one scan for the texts; the list of ids is bounded by sample_rows x MAX_LANGUAGES
    sample = (rows.where(F.col("id").isin(picked) & (F.octet_length("text") <= SAMPLE_BYTES))
              .dropDuplicates(["id", "lang"]).toPandas().sort_values(["lang", "id"]))
    return train(sample["text"].tolist(), sample["lang"].tolist()) if len(sample) else None


def predict(docs: DataFrame, model: Model | None, text_col: str, out_cols: tuple[str, str]) -> DataFrame:
    """``docs`` with the predicted language and its score (mean probability over the words, 9 digits) as two more columns.

    ``und`` with score 0 where the text is NULL or has no letter, or where there is no model.
    """
    lang_col, score_col = out_cols
    shared = docs.sparkSession.sparkContext.broadcast(model)        # at most 2^BITS x MAX_LANGUAGES weights
    lettered = F.when(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lower(F.col(f"`{text_col}`")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    given = docs.select(*columns, lettered.alias(lang_col), F.lit(0.0).alias(score_col))

    def run(batches):
        m = shared.value
        for batch in batches:
            names = batch.schema.names
            at = names.index(lang_col)
            langs, scores = [], []
            for first, end, data, offsets in tb.blocks(batch.column(at)):
                lang, score = label_block(m, data, offsets)
                langs += lang
                scores.append(score)
            arrays = [batch.column(i) for i in range(len(names))]
            arrays[at] = pa.array(langs, batch.schema.field(at).type)
            arrays[at + 1] = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays(arrays, names)

    return given.mapInArrow(run, given.schema)


def label_block(model: Model | None, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    words = tb.Words(data, offsets, tb.LETTER, lower=False)
    langs, scores = [UNKNOWN] * words.rows, np.zeros(words.rows)
    if model is None or not len(words):
        return langs, scores
    counts = words.counts()
    filled = np.flatnonzero(counts)
    posterior, _, _ = forward_backward(model.emissions(words), words.first[:-1][filled], counts[filled], model.transitions, model.start)
    mean = tb.group_sums(posterior, words.first) / np.maximum(1, counts)[:, None]
    best = mean.argmax(axis=1)
    for i in filled.tolist():
        langs[i] = model.languages[best[i]]
    scores[filled] = np.round(np.clip(mean[filled, best[filled]], 0, 1), 9)
    return langs, scores


def tag_words(model: Model, text: str) -> list[tuple[str, str, float]]:
    """(word, language, probability) for each word of a code-switched text."""
    data, offsets = tb.column_bytes(pa.array([text.lower()], pa.large_string()))
    words = tb.Words(data, offsets, tb.LETTER, lower=False)
    if not len(words):
        return []
    posterior, _, _ = forward_backward(model.emissions(words), words.first[:-1], words.counts(), model.transitions, model.start)
    raw = words.text.tobytes()
    return [(raw[a:b].decode("utf-8", "replace"), model.languages[p.argmax()], float(p.max()))
            for a, b, p in zip(words.start, words.end, posterior)]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row.

    ``held_out``: crc32(id) mod 4 is 2; such rows never train, nor do rows with a NULL id (not held out either).  A NULL
    text, an empty one and one without a letter are ``und`` with score 0.  Repeated rows get equal results; an empty
    table, or one without a label, has no model, and every row of it is ``und``; other columns are not read.
    """
    model = fit(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    slim = predict(rows, model, "text", ("lang_pred", "score"))
    return slim.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of ``least`` or more, unchanged."""
    lang, score = fresh(docs, "lang_pred", "score")
    marked = predict(docs, fit(docs, id_col, text_col, lang_col), text_col, (lang, score))
    return marked.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
