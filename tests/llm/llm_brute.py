"""Brute-force versions of the corpus operators, for small fixtures."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))


def union_find(ids, pairs):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def simhash(text, k=4):
    words = re.findall("[^\x20\x09-\x0D]+", lower_ascii(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(rows, radius=4):
    """rows: list of (id, text)."""
    prints = {i: simhash(t) for i, t in rows}
    ids = list(prints)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if (prints[a] ^ prints[b]).bit_count() <= radius]
    parts = union_find(ids, pairs)
    return {i: (format(prints[i], "016x"), parts[i]) for i in ids}


WORDS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(rows, items, window=13):
    """rows: list of texts; items: list of (item_id, text).  One tuple per row, as ``fm_decontam.report`` gives it."""
    windows = defaultdict(set)
    for item, text in items:
        w = WORDS.findall(lower_ascii(text))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[k:k + window])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for text in rows:
        w = WORDS.findall(lower_ascii(text))
        hit, found = [0] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                owners = windows.get(tuple(w[k:k + n]))
                if owners:
                    found |= owners
                    hit[k:k + n] = [1] * n
        h = sum(hit)
        out.append((len(w), h, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), h > 0 and 20 * h >= len(w)))
    return out


def cosine_links(rows, least=0.93):
    """rows: list of (id, vector or None, label).  id -> (links, component)."""
    good = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or not len(v) or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        good[i] = (np.array(v, float), label)
    pairs = []
    ids = list(good)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            (x, lx), (y, ly) = good[a], good[b]
            if lx == ly and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                pairs.append((a, b))
    links = Counter(x for p in pairs for x in p)
    parts = union_find([i for i, _, _ in rows if i is not None], pairs)
    return {i: (links[i], parts[i]) for i in parts}


def plain_tokens(line):
    return [t for t in re.split(r"[\t\r\f\x0b ]+", line) if t]


def tokens_of(line):
    """Tokens with every one that holds a digit as the variable field."""
    return plain_tokens(re.sub(r"(?<!\S)[^\s0-9]*[0-9]\S*", "<*>", line))


def copy_groups(texts, copy=0.8):
    """{doc: smallest doc of its copies} from {doc: [texts]}: texts that share enough of their word pairs, all pairs compared."""
    sets = []
    for doc, mine in texts.items():
        for text in mine:
            words = re.split("[\n\t\r\f\x0b ]", text)
            if any(words):
                sets.append((doc, set(zip(words, [*words[1:], None]))))
    links = [(x, y) for k, (x, a) in enumerate(sets) for y, b in sets[:k] if x != y and len(a & b) >= copy * len(a | b)]
    return union_find(list(texts), links)


def line_dedup(rows, depth=3, fields=8, similarity=0.7, min_docs=2):
    """rows: list of (id, text).  List of (text, lines, dropped)."""
    last = (1 << 63) - 1
    lines, texts = [], defaultdict(list)          # (row, doc, no, (leaf, wording))
    for r, (i, text) in enumerate(rows):
        doc = last if i is None else i
        if text is None:
            continue
        texts[doc].append(text)
        for no, x in enumerate(text.split("\n")):
            t = tokens_of(x)
            if t:
                t = tuple(t if len(t) >= depth else plain_tokens(x))
                lines.append((r, doc, no, ((len(t), t[:depth]), t)))

    def parts(t):
        n = len(t)
        if n <= depth + fields:
            return [(x,) for x in t[depth:]]
        step = math.ceil((n - depth) / fields)
        return [t[depth + k * step:depth + (k + 1) * step] for k in range(fields) if depth + k * step < n]

    # wordings of a leaf that agree on enough fields are one template, by any chain of them
    nodes = sorted({x for *_, x in lines})
    alike = [(a, b) for a in nodes for b in nodes if a < b and a[0] == b[0] and parts(a[1])
             and sum(x == y for x, y in zip(parts(a[1]), parts(b[1]))) >= similarity * len(parts(a[1])) - 1e-9]
    template = union_find(nodes, alike)
    group = copy_groups(texts)
    docs = defaultdict(set)
    for _, doc, _, x in lines:
        docs[template[x]].add(doc)
    recurring = {t: min(d) for t, d in docs.items() if len({group[x] for x in d}) >= min_docs}
    gone = defaultdict(set)
    for r, doc, no, x in lines:
        if doc != recurring.get(template[x], doc):
            gone[r].add(no)
    out = []
    for r, (i, text) in enumerate(rows):
        if text is None:
            out.append((None, 0, 0))
            continue
        own = text.split("\n")
        out.append(("\n".join(x for no, x in enumerate(own) if no not in gone[r]), len(own), len(gone[r])))
    return out
