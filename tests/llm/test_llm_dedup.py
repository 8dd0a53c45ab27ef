"""Near duplicates, line dedup, embeddings and components against brute force, and on awkward rows."""

import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import llm_brute as brute  # noqa: E402
from medfuse.llm import components, line_dedup, simhash, vamana  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n):
    return [rng.choice("the of and alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()) + str(rng.randint(0, 40)) * (rng.random() < .2)
            for _ in range(n)]


def near_rows():
    rng = random.Random(5)
    rows = []
    for base in range(12):
        w = words(rng, 400)
        for copy in range(6):
            v = list(w)
            for _ in range(copy):
                v[rng.randrange(len(v))] = "edit%d" % rng.randint(0, 99)
            rows.append((len(rows), " ".join(v)))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One"), (1004, "one"), (1005, "two words"), (1006, "x " * 60_000), (1007, "é ü 漢字 a b")]
    return rows


def test_simhash_equals_brute_force(spark):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert got == brute.simhash_components(rows)


@pytest.mark.parametrize("tile", [1, 7])
def test_simhash_large_blocks_are_split_without_loss(spark, tile):
    rng = np.random.default_rng(3)
    prints = sorted({int(0x0F0F0F0F0F0F0F0F) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 4), replace=False)) for _ in range(120)})
    df = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    linked = simhash.links(df, tile=tile)
    got = {r["node"]: r["label"] for r in components.components(linked, "u", "v").collect()}
    pairs = [(a, b) for n, a in enumerate(prints) for b in prints[n + 1:] if (a ^ b).bit_count() <= 4]
    expected = brute.union_find(prints, pairs)
    assert {p: got.get(p, p) for p in prints} == expected


def test_simhash_masks_keep_every_pair_within_the_radius():
    rng = np.random.default_rng(1)
    for count in (10, 1 << 25, 1 << 33):
        masks = simhash.block_masks(count, 4)
        for _ in range(300):
            diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(diff & m == 0 for m in masks)


def test_simhash_awkward_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, None), (9, "q w")],
                                "doc_id bigint, text string").withColumn("fp", F.lit(1)).withColumn("gone_id", F.lit(2)).withColumn("place", F.lit(3))
    got = sorted(map(tuple, simhash.near_duplicates(odd).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (None, None), (9, 9)], key=str)
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    # the NULL id linked to document 7 goes, the group of the NULL text keeps its only row
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [7, 9, None]


def test_simhash_keeps_one_row_of_every_group_whatever_its_ids(spark):
    a, b, c, d = "one two three four five", "red green blue white black", "sun moon star sky sea", "iron gold tin lead zinc"
    rows = [(2, a, "x"), (5, a, "x"), (5, b, "x"), (7, b, "x"), (8, b, "x"),        # no text of a repeated id is lost
            (9, c, "x"), (9, c, "y"), (9, c, "y"), (None, c, "x"),                  # unlike rows with one id and text
            (None, d, "x"), (None, d, "x"), (None, d, "z")]                         # a group without any id
    df = spark.createDataFrame(rows, "doc_id bigint, text string, row_hash string")
    kept = [tuple(r) for r in simhash.keep_one(df).collect()]
    assert sorted((r[1] for r in kept)) == sorted([a, b, c, d]) and set(kept) <= set(rows)
    assert {(r[0], r[1]) for r in kept} == {(2, a), (5, b), (9, c), (None, d)}
    # repeated rows only: one of them
    same = spark.createDataFrame([(1, a, "x")] * 5, df.schema)
    assert [tuple(r) for r in simhash.keep_one(same).collect()] == [(1, a, "x")]
    assert simhash.keep_one(df.limit(0)).columns == df.columns


def test_simhash_keeps_the_smallest_id_of_each_group(spark):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    expected = {i for i, (_, c) in brute.simhash_components(rows).items() if i == c}
    assert {r["doc_id"] for r in simhash.keep_one(df).collect()} == expected


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200, 263)] + [(500, i) for i in range(501, 560)] + [(9, 9), (None, 3)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    expected = brute.union_find(sorted({x for e in edges[:-1] for x in e}), edges[:-1])
    assert got == expected
    assert components.components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def line_rows():
    rng = random.Random(8)
    rows = []
    boiler = ["Licensed under the Apache License, Version %d.0.", "All rights reserved", "Thank you for reading our daily news letter, dear subscriber",
              "User %d logged in from a machine in the main office"]
    for i in range(60):
        lines = [" ".join(words(rng, rng.randint(1, 30))) for _ in range(rng.randint(2, 7))]
        for b in boiler:
            if rng.random() < .4:
                lines.insert(rng.randrange(len(lines) + 1), b % i if "%d" in b else b)
        if rng.random() < .3:
            lines.append("dear " + rng.choice(["anna", "bob", "carl"]) + " we wish you a very merry season and a happy year from us all here")
        rows.append((i, "\n".join(lines)))
    rows += [(100 + k, rows[3][1]) for k in range(5)]                      # exact copies
    rows += [(200 + k, rows[4][1].replace("alpha", "ALPHA%d" % k, 1)) for k in range(3)]
    rows += [(300, None), (301, ""), (302, "\n\n"), (303, "  a\t b  c \n x"), (None, "one two three four\nfive six seven"), (None, "one two three four\nsix five seven"),
             (304, "one two three four\nall else is new here"), (3, "the same id again\none two three four"), (5, rows[5][1])]
    return rows


def rule_rows():
    """Texts that tell today's rules from plainer ones: short lines, several templates of a leaf, copies that share a line."""
    rng = random.Random(21)
    cities = "oslo rome bern riga kiev lima".split()
    forms = ["please contact our %s office for more details", "please contact our team in %s by phone"]
    rows = [(400 + i, "\n".join([*own_lines(rng, 3), "And ornd." if i % 2 else "in 2024", forms[i % 2] % cities[i % 6], str(70 + i)])) for i in range(12)]
    copied = "\n".join([*own_lines(rng, 6), "only copies and one other text say this here", "copies alone say this line again"])
    rows += [(500 + i, copied) for i in range(6)] + [(520, copied.replace("a", "Z", 1)), (530, "\n".join([*own_lines(rng, 4), "only copies and one other text say this here"]))]
    block = own_lines(rng, 10)
    return rows + [(600 + i, "\n".join([*block, *own_lines(rng, 2)])) for i in range(2)]


def test_line_dedup_equals_brute_force(spark):
    rows = line_rows() + rule_rows()
    docs = spark.createDataFrame([(n, i, t) for n, (i, t) in enumerate(rows)], "n int, doc_id bigint, text string")
    got = {r["n"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.drop_recurring(docs).collect()}
    expected = dict(enumerate(brute.line_dedup(rows)))
    assert got == expected
    assert sum(x[2] for x in expected.values()) > 60
    # the fixture tells other rules apart: templates by exact wording, whole copies counted apart, three groups needed, no short lines
    for other in (dict(similarity=1.1), dict(min_docs=3), dict(depth=4), dict(fields=2)):
        assert dict(enumerate(brute.line_dedup(rows, **other))) != expected, other
    kept = {i: t for (i, _), (t, _, _) in zip(rows, expected.values())}
    assert all("copies alone say this line again" in kept[500 + i] for i in range(6)) and "only copies" not in kept[530]
    assert "And ornd." in kept[401] and "And ornd." not in kept[403]


def test_line_dedup_finds_the_copy_links(spark):
    """Share of the links between near copies that the hash classes find, against all pairs: 0.9 or more."""
    rng = random.Random(33)
    rows = []
    for g in range(25):
        base = [w for line in own_lines(rng, 12) for w in line.split(" ")]
        for k in range(4):
            text = list(base)
            for _ in range(k):
                text[rng.randrange(len(text))] = "changed" + str(k)
            rows.append((10 * g + k, " ".join(text)))
    want = brute.copy_groups({i: [t] for i, t in rows})
    labels = {r["node"]: r["label"] for r in line_dedup.copy_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").collect()}
    linked = [i for i in want if want[i] != i]
    found = sum(labels.get(i) == want[i] for i in linked)
    assert len(linked) == 75 and found >= 0.9 * len(linked)
    assert all(want[i] == want[x] for i, x in labels.items())          # no two texts are joined that all pairs keep apart


def test_line_dedup_generalises_variable_fields_and_keeps_the_first(spark):
    rows = [(i, f"intro text number one for document {c}{c}\nUser {i}77 logged in from host {c}\nlast words {c} of it") for i, c in enumerate("abcdef")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring(df).collect()}
    assert "logged in" in got[0] and not any("logged in" in got[i] for i in range(1, 6))


def test_line_dedup_leaves_copies_whole(spark):
    text = "a first line of some length\nand a second line of it\nthe third one ends it"
    df = spark.createDataFrame([(i, text) for i in range(30)], "doc_id bigint, text string")
    assert {r["text"] for r in line_dedup.drop_recurring(df).collect()} == {text}


def own_lines(rng, n):
    return [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(6)) for _ in range(n)]


def test_line_dedup_finds_every_template_of_a_leaf(spark):
    rng, cities = random.Random(9), "oslo rome bern riga kiev lima doha".split()
    forms = ["please contact our %s office for more details", "please contact our team in %s by phone", "please contact our shop near %s before next"]
    lines = [f % c for f, n in zip(forms, (3, 4, 3)) for c in cities[:n]]
    assert {len(x.split()) for x in lines} == {8}
    prose = ["please contact our " + " ".join(x.split()[:5]) for x in own_lines(rng, 30)]
    rows = [(i, "\n".join([*own_lines(rng, 3), x])) for i, x in enumerate(lines + prose)]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_recurring(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: int(i < 10 and i not in (0, 3, 7)) for i, _ in rows}


def test_line_dedup_drops_short_lines_by_their_exact_wording(spark):
    rng, unbroken = random.Random(2), "漢字仮名交じり文は空白なしで書かれる" * 5
    rows = [(i, "\n".join([*own_lines(rng, 3), "And ornd.", "", unbroken, str(40 + i), "in 2024", *own_lines(rng, 1)])) for i in range(4)]
    rows += [(10 + i, "Tiny") for i in range(3)]                                                                       # copies
    got = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.drop_recurring(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    gone = {"And ornd.", unbroken, "in 2024"}
    assert got == {i: [x for x in t.split("\n") if not 0 < i < 4 or x not in gone] for i, t in rows}


def test_line_dedup_counts_a_copy_group_once(spark):
    rng, line = random.Random(4), "this one line stands in every text of them"
    copied = "\n".join([*own_lines(rng, 6), line])
    rows = [(i, copied) for i in range(40)] + [(100 + i, "\n".join([*own_lines(rng, 3), line])) for i in range(9)]     # 40 of 49 are copies
    pair = "a line that two texts share and one is copied"
    twice = "\n".join([*own_lines(rng, 5), pair])
    rows += [(200, twice), (201, twice.replace("a", "z", 1)), (202, "\n".join([pair, *own_lines(rng, 5)]))]               # a near copy
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [i for i in got if line in got[i]] == [0] and [i for i in got if pair in got[i]] == [200]
    lost = "\n" + line
    assert all(got[i] == copied.replace(lost, "") for i in range(1, 40)) and got[201] + "\n" + pair == rows[-2][1]


def test_line_dedup_a_shared_block_makes_no_copies(spark):
    rng = random.Random(6)
    block = own_lines(rng, 10)
    rows = [(i, "\n".join([*block, *own_lines(rng, 2)])) for i in range(3)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_recurring(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {0: rows[0][1], **{i: "\n".join(rows[i][1].split("\n")[10:]) for i in (1, 2)}}


def test_line_dedup_plans_alike_at_every_size(spark, monkeypatch):
    """No step broadcasts a table that grows with the corpus, however small it is here, and the sketches are taken apart once."""
    plans, cut = [], line_dedup.cut
    monkeypatch.setattr(line_dedup, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    docs = spark.createDataFrame(line_rows() + rule_rows(), "doc_id bigint, text string")
    assert line_dedup.drop_recurring(docs).count() == docs.count()
    assert sum("SortMergeJoin" in p for p in plans) >= 8 and not [p for p in plans if "BroadcastHashJoin" in p]
    assert sum("filter(sketch" in p for p in plans) == 1


def test_line_dedup_awkward_columns_and_long_text(spark):
    assert line_dedup.drop_recurring(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    long = "\n".join(f"line {w} of this very long text" for w in "abcdefghij" * 3000)
    df = spark.createDataFrame([(1, long), (2, "x\ny")], "doc_id bigint, text string").withColumn("n_lines", F.lit("mine")).withColumn("rid", F.lit(1)).withColumn("gone", F.lit(2)).withColumn("Key", F.lit(0))
    out = line_dedup.drop_recurring(df)
    assert out.columns == [*df.columns, "n_lines_", "n_dropped"]
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()} == {1: (long, "mine", 0), 2: ("x\ny", "mine", 0)}


def vector_rows():
    rng = np.random.default_rng(2)
    rows = []
    for label in (0, 1, None):
        base = rng.normal(size=(40, 16))
        for b in base:
            for k in range(rng.integers(1, 6)):
                rows.append((len(rows), (b + rng.normal(size=16) * 0.12 * k).tolist(), label))
    hot = rng.normal(size=16)
    rows += [(len(rows) + k, (hot + rng.normal(size=16) * 0.02).tolist(), 1) for k in range(150)]
    rows += [(5000 + k, rows[0][1], 0) for k in range(4)]                    # copies
    rows += [(6000, None, 0), (6001, [0.0] * 16, 0), (6002, [None] + [1.0] * 15, 0), (6003, [float("nan")] * 16, 1),
             (6004, [float("inf")] + [1.0] * 15, 1), (6005, [], 1), (6006, [1.0, 2.0], 1), (6007, [2.0, 4.0], 1)]
    return rows


@pytest.mark.parametrize("shard", [vamana.SHARD, 60])
def test_vamana_equals_brute_force(spark, shard, monkeypatch):
    monkeypatch.setattr(vamana, "SHARD", shard)
    monkeypatch.setattr(vamana, "CLUSTER", 60)
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("rep", F.lit(1))
    out = vamana.near_duplicates(df).collect()
    expected = brute.cosine_links(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out}
    found, true = sum(min(g[0], expected[i][0]) for i, g in got.items()), sum(e[0] for e in expected.values())
    assert found >= 0.99 * true and out[0]["audit_recall"] >= 0.9
    assert all(g[0] <= expected[i][0] for i, g in got.items())
    assert sum(got[i][1] == expected[i][1] for i in expected) >= 0.99 * len(expected)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)


def test_vamana_awkward_rows(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    assert vamana.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (2, [1.0, 0.1], 1), (3, [1.0, 0.0], None)]
    got = sorted(map(tuple, vamana.near_duplicates(spark.createDataFrame(rows, schema)).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)
    assert got == sorted([(None, 0, None, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True)], key=str)


def test_vamana_search_reaches_across_the_graph():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    adj = vamana.build_graph(vamana.unit(x), 1)
    found = vamana.search(x, adj, x[:50], np.arange(50), 0.7)
    got = {(int(a), int(b)) for q, v in found for a, b in zip(q, v)}
    cos = vamana.unit(x)[:50] @ vamana.unit(x).T
    true = {(int(a), int(b)) for a, b in zip(*np.nonzero(cos >= 0.7))}
    assert got <= {(int(a), int(b)) for a, b in zip(*np.nonzero(cos >= 0.7 - 1e-9))}
    assert len(got & true) >= 0.95 * len(true)
