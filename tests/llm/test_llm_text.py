"""Chat formatting, decontamination, classifiers, URL filter, surrogates, mixing and the pipeline: brute force, round trips, accuracy."""

import hashlib
import os
import random
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import llm_brute as brute  # noqa: E402
from oracle_check import compare, duck  # noqa: E402
from medfuse.llm import chat_format, crf_langid, fm_decontam, mixing, quality, queries, surrogates, url_filter  # noqa: E402
from medfuse.llm.common import cut, table  # noqa: E402

NASTY = ["", " ", "[INST]", "x </s> y", "<\\/s>", "<\\\\/s>", "\\", "[\\INST] [INST]", "<<SYS>> a <</SYS>>", "<<<SYS>>", "[ROLE=x] [/ROLE]", "[/INST [/INST]", "é😀 [/INST] \n",
         " [/INST]", "< /s>", "<s><s>", "[", "<", "$1 \\1", "<A> b"]


def test_chat_round_trip_of_conflicting_texts(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "to]ol [/INST]", "", None]), rng.choice([None, *NASTY]) if rng.random() < .5 else "".join(rng.choice(NASTY) for _ in range(4)))
            for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(None, 1, "user", "q"), (100, None, "user", "second?"), (100, 0, "assistant", "b"), (100, 0, "assistant", "b"), (100, 0, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("place", F.lit(1))
    written = cut(chat_format.format_conversations(df))
    back = {r["conv_id"]: r for r in chat_format.read_back(written).collect()}
    plain = {r["conv_id"]: r for r in written.collect()}
    by_conv = {}
    for c, t, role, text in rows:
        by_conv.setdefault(c, []).append((t, role or "", text or ""))
    assert set(back) == set(by_conv)
    for c, turns in by_conv.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        assert [tuple(t) for t in back[c]["turns"]] == [(r, t) for _, r, t in turns]
        said = [t for _, r, t in turns if r == "assistant"]
        assert back[c]["loss_text"] == "".join(said)
        cutouts = [plain[c]["formatted"][s["first"]:s["first"] + s["length"]] for s in plain[c]["loss_spans"]]
        assert [re.sub(r"([\[<])\\(\\*)" + chat_format.REST, r"\1\2\3", x) for x in cutouts] == said


def test_chat_turns_are_compared_with_their_source(spark, monkeypatch):
    """The operator reads its own rendering back: an escape that does not do its work is noticed, texts that read back stay as they are."""
    schema = "conv_id bigint, turn bigint, role string, text string"
    plain = spark.createDataFrame([(1, 0, "user", "a [INST b"), (1, 1, "assistant", "c\\d")], schema)
    said = [(2, 0, "user", "x </s>[INST] y"), (2, 1, "assistant", "[\\INST] <\\\\/s>"), (2, 2, "tool", "plain")]
    back = {r["conv_id"]: r for r in chat_format.read_back(cut(chat_format.format_conversations(spark.createDataFrame(said, schema)))).collect()}
    assert [(t["role"], t["text"]) for t in back[2]["turns"]] == [(role, text) for _, _, role, text in said]
    monkeypatch.setattr(chat_format, "escape", lambda text: text)
    assert chat_format.format_conversations(plain).first()["formatted"] == "<s>[INST] a [INST b [/INST]<A> c\\d </s>"
    with pytest.raises(Exception, match="not read back"):
        chat_format.format_conversations(spark.createDataFrame(said, schema)).collect()


def test_chat_masks_that_do_not_fit_are_read_by_place(spark):
    written = cut(chat_format.format_conversations(spark.createDataFrame([(1, 0, "user", "abc"), (1, 1, "assistant", "defg")], "conv_id bigint, turn bigint, role string, text string")))
    moved = written.withColumn("loss_spans", F.expr("transform(loss_spans, s -> named_struct('first', s.first + 1, 'length', s.length - 2))"))
    assert chat_format.read_back(cut(moved)).first()["loss_text"] == "ef"


def test_chat_empty_and_long(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert chat_format.digests(spark.createDataFrame([], schema)).count() == 0
    long = "<s>word " * 50_000
    row = chat_format.digests(spark.createDataFrame([(1, 0, "assistant", long)], schema)).first()
    assert row["loss_chars"] == len(long) and row["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    assert row["formatted_chars"] == len(long) + 50_000 + len("<s><A>  </s>")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf_mid, name):
    good, message = compare(queries.QUERIES[name](spark, sf_mid).toPandas(), duck(sf_mid).execute(queries.ORACLES[name]).df())
    assert good, message


def decontamination_rows():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "Ünder", "x1"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 12, 13, 14, 40])))) for i in range(25)]
    items += [(25, None), (26, ""), (27, "..."), (3, items[7][1]), (None, "alone here")]
    docs = []
    for i in range(60):
        parts = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            item = rng.choice(items)[1] or ""
            own = item.upper().split(" ")
            at = rng.randrange(len(parts) + 1)
            parts[at:at] = own[rng.randint(0, 5):]
        docs.append((rng.choice([", ", " ", "\n"])).join(parts))
    return docs + [None, "", "?!", docs[0], "ALONE-here", "w1 " * 30_000 + (items[5][1] or "")], items


@pytest.mark.parametrize("shard_words, block_bytes", [(fm_decontam.SHARD_WORDS, fm_decontam.BLOCK_BYTES), (64, 400)])
def test_decontamination_equals_brute_force(spark, monkeypatch, shard_words, block_bytes):
    docs, items = decontamination_rows()
    if shard_words == 64:
        docs = docs[:60]
    monkeypatch.setattr(fm_decontam, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(fm_decontam, "BLOCK_BYTES", block_bytes)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found, names = fm_decontam.find_contamination(df, bench, block_bytes=block_bytes)
    rows = {r["doc_id"]: r for r in found.collect()}
    expected = brute.contamination(docs, items)
    for i, (n, hit, n_items, digest, _) in enumerate(expected):
        r = rows[i]
        assert (r["n_words"], sum(s["end"] - s["first"] for s in r["spans"]), len(r["items"]), fm_decontam.items_digest(r["items"])) == (n, hit, n_items, digest), i
    if shard_words != 64:
        got = {r["doc_id"]: tuple(r)[1:6] for r in fm_decontam.report(df, bench).collect()}
        assert got == dict(enumerate(expected))
        kept = fm_decontam.keep_clean(df.withColumn("spans", F.lit(1)).withColumn("N_WORDS", F.lit(2)), bench)
        assert kept.columns == ["doc_id", "text", "spans", "N_WORDS"]
        assert {r["doc_id"] for r in kept.collect()} == {i for i, e in enumerate(expected) if not e[4]}


def test_decontamination_of_empty_tables(spark):
    df, none = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert tuple(fm_decontam.report(df, none).first())[:4] == (1, 2, 0, 0)
    assert fm_decontam.report(df.limit(0), none).count() == 0


def test_suffix_array_and_index_against_naive_search():
    rng = np.random.default_rng(5)
    for _ in range(30):
        seq = np.append(rng.integers(0, 4, rng.integers(1, 200)), 0)
        sa = fm_decontam.suffix_array(seq)
        key = [tuple((int(v), 0) if v else (0, int(i)) for i, v in zip(range(s, len(seq)), seq[s:])) for s in range(len(seq))]
        assert sa.tolist() == sorted(range(len(seq)), key=lambda s: [(a, b) for a, b in key[s]])
        index = fm_decontam.ShardIndex(seq, 3)
        table_ = np.array([[1, 2, 0], [1, 1, 3], [2, 0, 0], [3, 3, 3]])
        which, lo, hi = index.search(table_, np.array([2, 3, 1, 3]))
        got = {(int(w), int(p)) for w, a, b in zip(which, lo, hi) for p in index.locate(np.arange(a, b))}
        pats = [(1, 2), (1, 1, 3), (2,), (3, 3, 3)]
        assert got == {(w, p) for w, x in enumerate(pats) for p in range(len(seq) - len(x) + 1) if tuple(seq[p:p + len(x)]) == x}


def test_quality_held_out_accuracy(spark, sf_mid):
    labels = table(spark, sf_mid, "labels")
    scored = quality.score(table(spark, sf_mid, "documents"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(scored) > 40 and scored["score"].between(0, 1).all()
    assert (scored["predicted"] == scored["quality"]).mean() >= 0.95


def test_quality_ignores_held_out_labels_and_other_columns(spark, sf_small):
    docs, labels = table(spark, sf_small, "documents"), table(spark, sf_small, "labels")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = sorted(map(tuple, quality.score(docs, labels).collect()))
    assert a == sorted(map(tuple, quality.score(docs.withColumn("source", F.lit("x")).withColumn("score", F.lit(1)).repartition(3), flipped).collect()))


def test_quality_awkward_rows(spark, sf_small):
    labels = table(spark, sf_small, "labels")
    rows = [(None, "a b"), (1, None), (2, ""), (3, " \n"), (3, " \n"), (4, "w " * 100_000)]
    odd = quality.score(table(spark, sf_small, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string")), labels)
    out = odd.where("doc_id IS NULL OR doc_id <= 4").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert [r["held_out"] for r in out if r["doc_id"] is None] == [False]
    assert quality.score(spark.createDataFrame(rows, "doc_id bigint, text string"), labels.limit(0)).select("score").distinct().first()[0] == 0.5
    assert quality.score(spark.createDataFrame([], "doc_id bigint, text string"), labels).count() == 0


def test_language_held_out_accuracy_and_code_switching(spark, sf_mid):
    docs = table(spark, sf_mid, "documents")
    found = crf_langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(found) > 100 and (found["lang_pred"] == found["lang"]).mean() >= 0.97
    model = crf_langid.fit(docs)
    sides = docs.where("length(text) > 400 AND crc32(CAST(doc_id AS STRING)) % 4 = 2").groupBy("lang").agg(F.min_by("text", "doc_id").alias("text")).toPandas()
    texts = {r.lang: " ".join(re.findall(r"[^\W\d_]+", r.text)[:25]) for r in sides.itertuples()}
    langs = sorted(texts)
    tags = crf_langid.tag_words(model, " ".join(texts[x] for x in langs))
    truth = [x for x in langs for _ in texts[x].split()]
    assert np.mean([t[1] == x for t, x in zip(tags, truth)]) >= 0.9


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(9)
    emissions, trans, start = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    first, lengths = np.array([0, 4, 5]), np.array([4, 1, 4])
    got, _, _ = crf_langid.forward_backward(emissions, first, lengths, trans, start)
    import itertools
    for f, n in zip(first, lengths):
        total, marginal = 0.0, np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.exp(start[path[0]] + sum(emissions[f + t, y] for t, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            total += w
            for t, y in enumerate(path):
                marginal[t, y] += w
        assert np.allclose(got[f:f + n], marginal / total)


def test_language_awkward_rows(spark):
    rows = [(i, "the and of thing was here " * 3, "en") for i in range(30)] + [(100 + i, "der die und ist nicht ungen " * 3, "de") for i in range(30)]
    rows += [(200, None, "en"), (201, "", None), (202, "123 !?", "en"), (None, "the thing", None), (203, "the " * 100_000, None), (0, rows[0][1], "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("mine"))
    got = crf_langid.identify(df)
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert [by_id[i]["lang_pred"] for i in (200, 201, 202)] == ["und"] * 3 and by_id[203]["lang_pred"] == "en" and not by_id[None]["held_out"]
    kept = crf_langid.keep_identified(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {200, 201, 202}
    unlabelled = crf_langid.identify(df.withColumn("lang", F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in unlabelled.collect()} == {("und", 0.0)}
    assert crf_langid.identify(df.limit(0)).count() == 0


def brute_rule(url, rules=url_filter.RULES):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = brute.lower_ascii(host)
    fits = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


def test_url_rules_equal_brute_force(spark, sf_mid):
    odd = [None, "", "abc", "HTTP://Ex.ORG", "x://EXAMPLE.org/en/12?x", "x://notorg/en/", "x://a.com/FR/", "x://a.com/fr/", "x://u:p@h.org:80/", "://", "a://b://c.org/x",
           "x://example.org#/es/", "x://.org/", "x://org/", "x://a.example.org/es/1", "x://É.com/de/"]
    urls = [r["url"] for r in table(spark, sf_mid, "pages").collect()] + odd
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("host", F.lit(1)).withColumn("score", F.lit(2))
    for r in url_filter.judge(df).collect():
        host, path, rule = brute_rule(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule[0] if rule else None)
        assert r["verdict"] == (rule[1] if rule else "block" if r["score"] >= 0.5 else "allow")
    assert url_filter.judge(df.limit(0)).count() == 0
    assert url_filter.judge(df, rules=()).where("rule IS NOT NULL").count() == 0


def test_url_model_tells_spam_hosts(spark):
    bad = ["https://free-bets.example.net/en/1", "http://www.spam-farm.example.com/x", "https://cheap-pills.example.net/", "https://casino-bets.example.net/7"]
    good = ["https://m.therst.example.net/en/123", "http://blog.ththin.example.net/de/5", "https://www.uni-library.example.net/catalogue/8"]
    df = spark.createDataFrame(list(enumerate(bad + good)), "page_id bigint, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(df, rules=()).collect()}
    assert [got[i] for i in range(len(bad + good))] == ["block"] * len(bad) + ["allow"] * len(good)


PRIVATE = [(1, "write a.b@x.org or A.B@X.ORG now; call +1 (017) 555-7713 or +10175557713."), (2, "4111 1111 1111 1111 and 4111111111111111, 9807915762804490"),
           (3, "Mr. John Smith met Mrs Smith, Mr Smith, госпожа Иванова. ip 10.1.2.3!"), (4, None), (5, ""),
           (6, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" 9233A8ECF7C5B09FE5949719B6B82BC439E9329B a@b.c'), (None, "q@b.c é.ü12@mail.de 123-45-6789"),
           (None, "q@b.c é.ü12@mail.de 123-45-6789"), (7, "no private thing, only 12 words of 3.5 kinds"), (8, "a" * 200_000 + " z@z.zz " + "1" * 100_000)]


def luhn(s):
    return sum(x // 10 + x % 10 for x in (int(d) * (1 + i % 2) for i, d in enumerate(reversed(s)))) % 10


def test_surrogates_keep_type_format_and_coreference(spark):
    df = spark.createDataFrame(PRIVATE, "doc_id bigint, text string").withColumn("rid", F.lit(1)).withColumn("n_mentions", F.lit("mine"))
    out = surrogates.replace_mentions(df, key="k")
    assert out.columns == [*df.columns, "n_mentions_"]
    rows = out.collect()
    text = {r["doc_id"]: r["text"] for r in rows}
    a, b, plus, flat = re.search(r"write (\S+) or (\S+) now; call (.{17}) or (\S+)\.$", text[1]).groups()
    assert b == a.upper() and re.fullmatch(r"[a-z]\.[a-z]@[a-z]\.org", a) and re.sub(r"\D", "", plus) == flat[1:] and plus.startswith("+1 (")
    spaced, card, other = re.fullmatch(r"([\d ]{19}) and (\d{16}), (\d{16})", text[2]).groups()
    assert spaced.replace(" ", "") == card and card[0] == "4" and luhn(card) == 0 and luhn(other) == luhn(other[:-1] + other[-1])
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+), Mr (\w+), госпожа ([а-яА-Я]+)\. ip (\d+\.){3}\d+!", text[3])
    assert m and m[1] in surrogates.GIVEN[("latin", "m")] and m[2] == m[3] == m[4]
    assert text[4] is None and text[5] == "" and text[7] == PRIVATE[8][1]
    assert re.fullmatch(r'token = "[0-9a-f]{40}" [0-9A-F]{40} \w@\w\.c', text[6])
    assert [r["text"] for r in rows if r["doc_id"] is None].count(text[None]) == 2
    assert "z@z.zz" not in text[8] and len(text[8]) == len(PRIVATE[9][1])
    again = {r["doc_id"]: r["text"] for r in surrogates.replace_mentions(df, key="k").collect()}
    assert again == text and {r["doc_id"]: r["text"] for r in surrogates.replace_mentions(df, key="other").collect()}[1] != text[1]
    assert surrogates.replace_mentions(df.limit(0)).count() == 0


def test_surrogates_are_distinct_after_collisions(spark):
    entities = spark.createDataFrame([("email", f"{c}@x.org") for c in "abcdefghijklmnopqrstuvwxyz"], "kind string, entity string")
    got = [r for r in surrogates.distinct_surrogates(entities, "k").collect()]
    assert len({r["surrogate"] for r in got}) == 26 and not {r["surrogate"] for r in got} & {r["entity"] for r in got}


LETTERS_ONLY = ["sk-" + "QwErTyUiOpAsDfGhJkLz", "ghp_" + "AbCdEfGhIjKl" * 3, "gho_" + "zYxWvUtSrQpO" * 3, "ghu_" + "abcdefghijkl" * 3, "ghs_" + "MNOPQRSTUVWX" * 3,
                "ghr_" + "mNoPqRsTuVwX" * 3, "AKIA" + "QWERTYUIOPASDFGH", "ASIA" + "ZXCVBNMLKJHGFDSA", "abcdef" * 6, "FEDCBA" * 6]


@pytest.mark.parametrize("around", ["key = %s.", "7 keys: %s, a@b.org"])
def test_surrogates_find_secrets_without_digits(spark, around):
    df = spark.createDataFrame([(i, around % s) for i, s in enumerate(LETTERS_ONLY)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["text"], r["n_mentions"]) for r in surrogates.replace_mentions(df).collect()}
    assert not [s for i, s in enumerate(LETTERS_ONLY) if s in got[i][0]]
    assert {n for _, n in got.values()} == {1 + around.count("@")}


def test_surrogates_leave_no_mention(spark, sf_mid):
    docs = table(spark, sf_mid, "documents")
    old = {r["mention"] for r in surrogates.mentions_of(docs, "doc_id", "text").collect()}
    out = surrogates.replace_mentions(docs)
    text = "\n".join(r["text"] for r in out.collect())
    assert len(old) > 50 and not [m for m in old if m in text]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_shares(children, budget):
    """Shares of children (capacity, weight) by raising the level step by step."""
    left, open_, share = budget, list(range(len(children))), [0] * len(children)
    while open_:
        total = sum(children[i][1] for i in open_)
        full = [i for i in open_ if children[i][0] * total <= children[i][1] * left]
        if not full:
            for i in open_:
                share[i] = left * children[i][1] // total
            break
        i = min(full, key=lambda i: children[i][0] / children[i][1])
        share[i] = children[i][0]
        left -= children[i][0]
        open_.remove(i)
    return share


def test_mixing_equals_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, " ".join("t" * rng.randint(1, 3) for _ in range(rng.randint(0, 30))) if rng.random() < .95 else None, rng.choice(["en", "de", "xx", None]), rng.choice(["s0", "s1", "s2", "s3", "web", None]), 0)
            for i in range(400)] + [(7, "a b c", "en", "s0", 0), (None, "d e", "en", "s0", 0), (None, "d e", "en", "s0", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    domain = lambda s: "other" if not s or not s[-1].isdigit() else ["web", "books", "code"][int(s[1:]) % 3]
    for budget in (0, 50, 3000, 9000, 10 ** 9):
        leaves = {}
        for i, t, lang, s, _ in rows:
            leaves.setdefault((domain(s), lang or "none", s or "none"), []).append((i, len((t or "").split())))
        cap = {k: 4 * sum(n for _, n in v) for k, v in leaves.items()}
        weight = lambda path: mixing.WEIGHTS.get(path) or mixing.WEIGHTS.get(("*", *path[1:])) or 1

        def split(prefix, amount, depth):
            names = sorted({k[:depth + 1] for k in leaves if k[:depth] == prefix})
            given = brute_shares([(sum(c for k, c in cap.items() if k[:depth + 1] == n), weight(n) if depth < 2 else 1) for n in names], amount)
            return dict(zip(names, given)) if depth == 2 else {k: v for n, g in zip(names, given) for k, v in split(n, g, depth + 1).items()}

        shares = split((), min(budget, sum(cap.values())), 0)
        expected = []
        for leaf, docs in leaves.items():
            tokens = sum(n for _, n in docs)
            if not tokens:
                continue
            passes, rest = divmod(shares[leaf], tokens)
            key = lambda i: hashlib.md5(f"17:{passes}:{'' if i is None else i}".encode()).hexdigest()
            for i, n in docs:
                upto = sum(m for j, m in docs if key(j) <= key(i))
                expected += [(i, e) for e in range(passes + (rest > 0 and upto <= rest))]
        got = [(r["doc_id"], r["epoch"]) for r in mixing.mix(df, budget=budget, slim_rows=True).collect()]
        assert sorted(got, key=str) == sorted(expected, key=str), budget
    whole = mixing.mix(df.withColumn("epoch", F.lit(1)).withColumn("leaf_last", F.lit(2)))
    assert whole.columns == [*df.columns, "epoch", "leaf_last", "epoch_"]
    assert mixing.mix(df.limit(0)).count() == 0


def test_pipeline_stages(spark, sf_small):
    import corpus_pipeline as p
    docs = table(spark, sf_small, "documents").withColumn("score", F.lit(1)).withColumn("rid", F.lit(2))
    first = {r["doc_id"]: r for r in docs.collect()}
    kept = []
    for name, stage in p.STAGES:
        columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = cut(stage(spark, docs, sf_small))
        rows = docs.collect()
        kept.append(len({r["doc_id"] for r in rows}))
        if name != "mix_sources":
            assert docs.columns == columns
        if name == "benchmark_decontamination":
            items = [(r["item_id"], r["text"]) for r in table(spark, sf_small, "benchmark").collect()]
            expected = {i for (i, _), e in zip(before.items(), brute.contamination(before.values(), items)) if not e[4]}
            assert {r["doc_id"] for r in rows} == expected
        if name == "simhash_near_dedup":
            assert {r["doc_id"] for r in rows} == {i for i, (_, c) in brute.simhash_components(list(before.items())).items() if i == c}
        if name == "line_dedup":
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "mix_sources"]
    assert kept[0] >= 0.95 * len(first) and kept == sorted(kept, reverse=True)


def test_native_operators_have_no_python_in_their_plans(spark, sf_small):
    for name in ("op1_line_dedup", "op2_chat_formatting", "op6_pii_surrogates"):
        plan = queries.QUERIES[name](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan, name
