"""Spelling variants, ranked lexical search and licence scan: brute force, SQL, awkward rows."""

import math
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import llm_brute as brute  # noqa: E402
from medfuse.llm import lexical, licenses, spelling  # noqa: E402

TERM = re.compile("[0-9a-z\u0080-\U0010ffff]+")


# ---- spelling variants

def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_groups(counts, ratio=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] > 0 and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (counts[w], len(near[w]), form[w], counts[form[w]] if form[w] is not None else None, root)
    return out


def grouped(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def test_spelling_groups_equal_brute_force(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(350)} | {"", "aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "😀b", "b"}
    counts = {w: rng.choice([1, 2, 5, 10, 25, 60, 300, 301, 301]) for w in words}
    rows = [(w, n, "x") for w, n in counts.items()]
    df = spark.createDataFrame(rows, "word string, n bigint, root string").repartition(6)
    assert grouped(spelling.group_variants(df)) == brute_groups(counts)


def test_spelling_numbers_tries_alike_in_any_partitioning(spark):
    words = sorted({"".join(random.Random(i).choices("ab", k=1 + i % 9)) for i in range(300)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    seen = {}
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            nodes = {r["word"]: r["nodes"] for r in spelling.trie_nodes(df).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
        by_node = {}
        for w, numbers in nodes.items():
            assert len(numbers) == len(w) + 1
            for i, x in enumerate(numbers):
                assert by_node.setdefault(x, w[:i]) == w[:i]
        assert len(set(by_node.values())) == len(by_node)       # a number for each beginning, and one only
        ends = [nodes[w][-1] for w in words]
        assert ends == sorted(ends)
        seen[parts] = len(by_node)
    assert seen[1] == seen[7]


def test_spelling_counts_and_errors_equal_brute_force(spark, sf_small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(None, "Colour colour COLOUR"), (7, None), (8, ""), (9, "Élan ÉLANÉE élanée" * 2)]
    expected = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = brute.lower_ascii(run)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            word = run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run
            if len(word) >= 6:
                expected[word] += 1
    got = spelling.word_counts(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("run", F.lit(1)), error_rate=199)
    assert {r["word"]: r["n"] for r in got.collect()} == {w: n for w, n in expected.items() if n >= 5}


def test_spelling_awkward_rows(spark):
    df = spark.createDataFrame([(None, 5), ("abc", 2), ("abc", 3), ("abcd", None), ("a" * 3000, 1), ("a" * 3001, 9)], "word string, n bigint")
    got = grouped(spelling.group_variants(df))
    assert got["abc"] == (5, 1, None, None, "abc") and got["abcd"] == (0, 1, "abc", 5, "abc")
    assert got["a" * 3000] == (1, 1, "a" * 3001, 9, "a" * 3001) and len(got) == 4
    assert spelling.group_variants(df.where("n > 99")).collect() == []
    assert spelling.variants(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


# ---- lexical search

def brute_search(docs, items, top=10):
    terms = [(i, Counter(TERM.findall(brute.lower_ascii(t or "")))) for i, t in docs]
    held = [(i, c) for i, c in terms if c]
    total, words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        wanted = [(t, math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))) for t in set(TERM.findall(brute.lower_ascii(text or ""))) if t in df]
        scores = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * total // words
            s = sum(w * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t, w in wanted if t in c)
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def search_rows():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(120)] + ["Été", "naïve"]
    docs = [(i, " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(122)], k=rng.choice([1, 3, 8, 40, 400])))) for i in range(500)]
    docs += [(i + 600, docs[3][1]) for i in range(30)]                                    # ties
    docs += [(1000, None), (1001, ""), (1002, "!?"), (None, docs[5][1]), (1003, docs[5][1]), (1003, docs[5][1]), (1004, "w1 " * 30000), (1005, "É É w3")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for i in range(25)]
    return docs, items + [(90, None), (91, ""), (92, "unheard of"), (None, "w50 w60"), (93, "W3 w3, W4!"), (93, "w77")]


@pytest.mark.parametrize("shard_bytes,block,query_bytes", [(1 << 24, 128, 1 << 20), (2000, 4, 60)])
def test_lexical_search_equals_brute_force(spark, shard_bytes, block, query_bytes, monkeypatch):
    docs, items = search_rows()
    monkeypatch.setattr(lexical, "BLOCK", block)
    got = lexical.search(spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit(1)).repartition(3),
                         spark.createDataFrame(items, "item_id bigint, text string").withColumn("query", F.lit(1)),
                         shard_bytes=shard_bytes, query_bytes=query_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search(docs, items)


def test_lexical_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert lexical.search(docs.limit(0), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
    assert [tuple(r) for r in lexical.search(docs, items).collect()] == [(1, 1, 1, brute_search([(1, "a b")], [(1, "a")])[0][3])]


def test_lexical_blocks_unpack_and_bound_their_postings():
    rng = np.random.default_rng(4)
    for wide in (5, 70000):
        lengths = rng.integers(1, wide, 900)
        docs = np.concatenate([np.sort(rng.choice(900, k, replace=False)) for k in (1, 700, 300)])
        terms = np.repeat(np.array([3, 1, 2], np.uint64), [1, 700, 300])
        tf = rng.integers(1, wide, len(docs))
        names = [f.split()[0] for f in lexical.INDEX_SCHEMA.split(", ")]
        shard = lexical.Shard(dict(zip(names, lexical.build_shard(list(range(900)), lengths, terms, docs, tf))), 900, int(lengths.sum()))
        norm = 10 + 90 * lengths * 900 // int(lengths.sum())
        for t in (1, 2, 3):
            at = shard.find(t)
            a, z = shard.first_block[at:at + 2]
            got, impact = shard.blocks(np.arange(a, z))
            mine = terms == t
            assert dict(zip(shard.ids[got].tolist(), impact.tolist())) == dict(zip(docs[mine].tolist(), lexical.impact(tf[mine], norm[docs[mine]]).tolist()))
            tops = [int(shard.blocks(np.array([b]))[1].max()) for b in range(a, z)]
            assert shard.block_max[a:z].tolist() == tops
        assert shard.find(9) is None


def test_lexical_search_skips_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    lengths = np.full(20000, 50)
    rare, common = np.sort(rng.choice(20000, 12, replace=False)), np.arange(20000)
    terms, docs = np.repeat(np.array([1, 2], np.uint64), [12, 20000]), np.concatenate([rare, common])
    names = [f.split()[0] for f in lexical.INDEX_SCHEMA.split(", ")]
    shard = lexical.Shard(dict(zip(names, lexical.build_shard(list(range(20000)), lengths, terms, docs, np.full(len(docs), 2)))), 20000, 10 ** 6)
    read, blocks = [], lexical.Shard.blocks
    monkeypatch.setattr(lexical.Shard, "blocks", lambda self, which: read.append(len(which)) or blocks(self, which))
    found = lexical.search_shard(shard, [(1, 9000), (2, 1)], (9000 * int(shard.block_max.max()), 5), 10)
    assert [d for _, d in found] == rare[:10].tolist()
    assert sum(read) <= 1 + 12                    # the rare list's block, and the blocks of its documents alone


# ---- licence scan

def brute_licenses(text, templates=licenses.TEMPLATES):
    words = TERM.findall(brute.lower_ascii(text or ""))
    places = []
    for t in templates:
        tw = t.words()
        for o in range(len(words)):
            if all(words[o + a:o + a + n] == tw[a:a + n] for a, n in t.spans()):
                same = sum(o + i < len(words) and words[o + i] == w for i, w in enumerate(tw))
                places.append((t.label, t.base, o, same / len(tw)))
    base = [p for p in places if p[1]]
    return (len(words), len(base), min((p[2] for p in base), default=None), max((p[2] for p in base), default=None),
            ",".join(sorted({p[0] for p in base})), ",".join(sorted({p[0] for p in places})), max((p[3] for p in places), default=0.0))


def license_rows():
    rng = random.Random(2)
    filler = "the by cc all rights license of software general copy".split()
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 5)):
            t = rng.choice(licenses.TEMPLATES)
            w = t.text.upper().split() if rng.random() < .3 else t.text.split()
            if rng.random() < .5:
                w[rng.randrange(len(w))] = rng.choice(["x", "É", "the"])
            if rng.random() < .2:
                w = w[rng.randrange(3):]
            parts += [" ".join(rng.choices(filler, k=rng.randint(0, 6))), rng.choice([" ", ", ", "-"]).join(w)]
        rows.append((i, "\n".join(parts)))
    return rows + [(200, None), (201, ""), (202, " .,"), (203, "cc by cc by"), (203, "all rights reserved"), (None, "CC-BY"),
                   (204, "all rights reserved " * 20000), (205, "general public"), (206, "CCÉ BY cc.by")]


def test_license_scan_equals_brute_force(spark):
    rows = license_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("places", F.lit(0)).withColumn("words", F.lit(0))
    got = sorted((tuple(r) for r in licenses.report(df).collect()), key=str)
    assert got == sorted(((i, *brute_licenses(t)) for i, t in rows), key=str)
    kept, names = licenses.scan(df)
    assert kept.columns == [*df.columns, *names] and len(set(kept.columns)) == len(kept.columns)
    assert licenses.report(df.limit(0)).collect() == []


def test_license_index_takes_the_rarest_words_and_the_result_does_not_depend_on_them(spark):
    t = licenses.Template("x", "a b c d", ("a b", "d"))
    entry = licenses.index([t], {"a": 1.0, "b": 3.0, "d": 2.0})[0]
    assert (entry["seed"], entry["seed_at"]) == ("b", 1) and [o["word"] for o in entry["others"]] == ["d", "a"]
    with pytest.raises(ValueError):
        licenses.Template("x", "a b", ("b a",)).spans()
    for common in ("a ", "d "):
        df = spark.createDataFrame([(1, "z a b q d"), (2, common * 50)], "doc_id bigint, text string")
        found = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.report(df, templates=[t]).collect()}
        assert found == {1: ("x", 0.75), 2: ("", 0.0)}


def test_license_scan_stays_in_the_jvm(spark, sf_small):
    plan = licenses.report(spark.read.parquet(f"{sf_small}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
