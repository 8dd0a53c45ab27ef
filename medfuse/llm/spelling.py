"""Spelling variant grouping: exact neighbours at one edit through pairs of trie nodes.

The dictionary is sorted once forwards and once backwards.  Each sorted order is a trie: a word's new nodes begin where
it parts from the word before, so the nodes are numbered in one pass over range partitions, and the few nodes on the
way to a partition's first word take the numbers that the partitions before gave them.  A word then is a row of integer
pairs (prefix node, suffix node): one pair for each position skipped, one for each gap into which a letter may be
inserted.  Words that share a pair are one edit apart: two skips of one pair differ by one replaced letter, a skip and a
gap by one inserted letter.  A pair whose prefix or suffix belongs to one word alone is never made.

A pair's group holds at most one word for each letter of the alphabet and one without, so it is small however large the
dictionary; each member gets its number of neighbours and its best neighbour from the group's first two places, and no
pair of words is ever written.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medfuse.llm.common import cut, discard

MIN_LETTERS = 6
MIN_COUNT = 5
FORM_RATIO = 5          # a form stands at least this many times as often as its variant
ERROR_RATE = 199        # one run in so many loses a letter (the fixed rule of the digest query)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "A-Za-zÀ-ÿ"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", error_rate: int | None = None,
                min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) for the letter runs of all texts, with A-Z lower-cased, of enough letters and occurrences.

    With ``error_rate`` a run whose crc32 of ``<id>:<run>`` it divides loses the letter at that number modulo its length;
    a row with a NULL id loses none.  NULL and empty texts have no runs; repeated rows count again.
    """
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(
        F.split(F.translate(F.col(text_col), UPPER, LOWER), f"[^{LETTERS}]+")).alias("run")).where(F.length("run") >= min_letters)
    word = F.col("run")
    if error_rate:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % error_rate == 0, F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))).otherwise(F.col("run"))
    return (runs.select(word.alias("word")).where(F.length("word") >= min_letters)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count))


def shared_letters(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def _number_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted distinct keys of one range partition, with the local numbers of their nodes by length of the beginning.

    The first key's nodes are numbered by their lengths.  ``shared``: longest beginning shared with a key beside it (the
    whole key at a partition's edges, where the key beside is not seen).
    """
    part, used, above, before = TaskContext.get().partitionId(), 0, [], None
    held = None                         # (key, nodes, letters shared with the key before)

    def batch(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.string()),
             pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.int32())],
            ["part", "key", "nodes", "shared"])

    for b in batches:
        done = []
        for key in b.column(0).to_pylist():
            same = -1 if before is None else shared_letters(before, key)
            fresh = len(key) - same
            nodes = above[:same + 1] + list(range(used, used + fresh))
            used += fresh
            if held is not None:
                done.append((held[0], held[1], max(held[2], same)))
            held = (key, nodes, len(key) if before is None else same)
            above, before = nodes, key
        if done:
            yield batch(done)
    if held is not None:
        yield batch([(held[0], held[1], len(held[0]))])


def trie_nodes(words: DataFrame, backwards: bool = False) -> DataFrame:
    """(word, nodes, shared) for distinct words: numbers of the trie nodes of all beginnings (or endings) by length.

    Equal beginnings have equal numbers all over the table, unequal ones never; a word's last node grows with the word
    in code-point order.  ``shared``: beginnings beyond this length belong to this word alone.  Only one row per range
    partition reaches the driver (its edge words and the numbers between them).
    """
    key = F.reverse("word") if backwards else F.col("word")
    local = cut(words.select(key.alias("key")).repartitionByRange("key").sortWithinPartitions("key")
                .mapInArrow(_number_nodes, "part int, key string, nodes array<bigint>, shared int"))
    edges = (local.groupBy("part").agg(
        F.min("key").alias("first"), F.max("key").alias("last"), F.max_by("nodes", "key").alias("nodes"),
        F.max(F.element_at("nodes", -1)).alias("top")).orderBy("part").collect())
    starts, before, numbers, offset = [], None, [], 0
    for e in edges:
        known = numbers[:shared_letters(before, e["first"]) + 1] if before is not None else []
        numbers = [known[j] if j < len(known) else offset + j for j in e["nodes"]]
        starts.append((e["part"], offset, known))
        offset += e["top"] + 1
        before = e["last"]
    spark = words.sparkSession
    starts = spark.createDataFrame(starts, "part int, offset bigint, known array<bigint>")
    word = F.reverse("key") if backwards else F.col("key")
    return local.join(starts, "part").select(
        word.alias("word"), F.transform("nodes", lambda j: F.when(
            j < F.size("known"), F.get("known", j.cast("int"))).otherwise(F.col("offset") + j)).alias("nodes"), "shared")


def node_pairs(counted: DataFrame) -> DataFrame:
    """(p, s, kind, n, back) for the words of ``counted`` (word, n, no, ahead, ahead_shared, behind, behind_shared).

    kind 0: the letter between prefix p and suffix s is skipped; 1: likewise, and it differs from the letter before it, so
    that a word reaches each shorter word by one skip only; 2: the gap between p and s, with nothing skipped.
    """
    return counted.select("n", F.expr("-no").alias("back"), F.expr("""inline(filter(concat(
        transform(slice(sequence(0, length(word)), 1, length(word)), i -> named_struct('p', ahead[i], 's', behind[length(word) - 1 - i],
          'kind', IF(i = 0 OR substring(word, i, 1) <> substring(word, i + 1, 1), 1, 0),
          'shared', i <= ahead_shared AND length(word) - 1 - i <= behind_shared)),
        transform(sequence(0, length(word)), i -> named_struct('p', ahead[i], 's', behind[length(word) - i],
          'kind', 2, 'shared', i <= ahead_shared AND length(word) - i <= behind_shared))), x -> x.shared))""")).drop("shared")


def nearest(pairs: DataFrame) -> DataFrame:
    """(no, n_near, best) for every word that has a near word: their number, and (n, back) of the best of them."""
    groups = pairs.groupBy("p", "s").agg(
        F.reverse(F.sort_array(F.expr("collect_list(IF(kind < 2, named_struct('n', n, 'back', back, 'kind', kind), NULL))"))).alias("skip"),
        F.expr("max(IF(kind = 2, named_struct('n', n, 'back', back), NULL))").alias("gap")).where(
        (F.size("skip") > 1) | ((F.size("skip") > 0) & F.col("gap").isNotNull()))
    groups = groups.select("skip", "gap", F.expr("filter(skip, x -> x.kind = 1)").alias("plain"))
    told = groups.select(F.expr("""inline(concat(
        transform(skip, x -> named_struct('no', -x.back,
          'near', CAST(size(skip) - 1 + IF(gap IS NOT NULL AND x.kind = 1, 1, 0) AS BIGINT),
          'best', greatest(IF(x.back = skip[0].back,
                              IF(size(skip) > 1, named_struct('n', get(skip, 1).n, 'back', get(skip, 1).back), NULL),
                              named_struct('n', skip[0].n, 'back', skip[0].back)),
                           IF(x.kind = 1, gap, NULL)))),
        IF(gap IS NULL OR size(plain) = 0, array(), array(named_struct('no', -gap.back, 'near', CAST(size(plain) AS BIGINT),
          'best', named_struct('n', get(plain, 0).n, 'back', get(plain, 0).back))))))"""))
    return told.where("near > 0").groupBy("no").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """(no, root) for ``links`` (no, form): the end of each word's chain of forms, by pointer jumping.

    Forms grow ``FORM_RATIO``-fold along a chain, so chains are short and the rounds few.
    """
    step = cut(links.select("no", F.col("form").alias("root")))
    while True:
        onward = step.select(F.col("no").alias("root"), F.col("root").alias("beyond"))
        jumped = cut(step.join(onward, "root", "left").select(
            "no", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        discard(step)
        step = jumped
        if not step.where("moved").limit(1).count():
            return step.select("no", "root")


def group_variants(words: DataFrame, form_ratio: int = FORM_RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for ``words`` (word string, n bigint), one row for each word.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point; ``n_near`` counts them.
    The form is the near word of largest n (ties: the smallest in code-point order) if that n is at least
    ``form_ratio`` times the word's own, else NULL.  The root is reached by following forms to the last one; a word
    without a form is its own.  A NULL word is left out, a repeated word counts once with the sum of its n (a NULL n is
    0), an empty word is a word like any other (a form of nothing but one-letter words), an empty table gives an empty
    result; further columns are not read.
    """
    if form_ratio < 2:
        raise ValueError("forms must stand at least twice as often as their variants, or chains of forms could close")
    words = cut(words.where("word IS NOT NULL").groupBy("word").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n")))
    ahead, behind = trie_nodes(words), trie_nodes(words, backwards=True)
    counted = cut(words.join(ahead.select("word", F.col("nodes").alias("ahead"), F.col("shared").alias("ahead_shared")), "word")
                  .join(behind.select("word", F.col("nodes").alias("behind"), F.col("shared").alias("behind_shared")), "word")
                  .withColumn("no", F.element_at("ahead", -1)))
    near = nearest(node_pairs(counted))
    told = cut(counted.select("word", "n", "no").join(near, "no", "left").select(
        "word", "n", "no", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when((F.col("best.n") > 0) & (F.col("best.n") >= form_ratio * F.col("n")), -F.col("best.back")).alias("form_no")))
    discard(counted)
    chained = roots(told.where("form_no IS NOT NULL").select("no", F.col("form_no").alias("form")))
    names = told.select("no", "word", "n")
    led = (told.where("form_no IS NOT NULL").join(chained, "no")
           .join(names.select(F.col("no").alias("form_no"), F.col("word").alias("form"), F.col("n").alias("form_n")), "form_no")
           .join(names.select(F.col("no").alias("root"), F.col("word").alias("root_word")), "root")
           .select("word", "n", "n_near", "form", "form_n", F.col("root_word").alias("root")))
    alone = told.where("form_no IS NULL").select("word", "n", "n_near", F.lit(None).cast("string").alias("form"),
                                                 F.lit(None).cast("bigint").alias("form_n"), F.col("word").alias("root"))
    return led.unionByName(alone)


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", error_rate: int | None = ERROR_RATE) -> DataFrame:
    """``group_variants`` over the ``word_counts`` of ``docs``; see there for NULLs, empty texts, ties and repeated rows."""
    return group_variants(word_counts(docs, id_col, text_col, error_rate))


def oracle_sql() -> str:
    """DuckDB SQL of ``variants`` over ``documents``: crc32 by its table, neighbours by words with one letter out."""
    bytes_of = ("flatten(list_transform(string_split(s, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] "
                "ELSE [192 + CAST(unicode(x) AS BIGINT) // 64, 128 + CAST(unicode(x) AS BIGINT) % 64] END))")
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k8: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, CAST(k AS BIGINT)) ORDER BY k) AS t
  FROM range(256) AS r(k)),
 runs AS (SELECT CAST(doc_id AS VARCHAR) || ':' || run AS s, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
    WHERE length(run) >= {MIN_LETTERS} GROUP BY 1, 2),
 hashed AS (SELECT run, times, xor(list_reduce({bytes_of}, lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h
    FROM runs, crc_table),
 words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT times, CASE WHEN h % {ERROR_RATE} = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word
    FROM hashed) WHERE length(word) >= {MIN_LETTERS} GROUP BY 1 HAVING sum(times) >= {MIN_COUNT}),
 cuts AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (
    SELECT word, unnest(range(0, length(word))) AS i FROM words)),
 near AS (SELECT DISTINCT a.word AS word, b.word AS other FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT c.word, w.word FROM cuts c JOIN words w ON c.rest = w.word
    UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.rest = w.word),
 ranked AS (SELECT near.word, other, o.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
    row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) AS place FROM near JOIN words o ON o.word = other),
 formed AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN other_n >= {FORM_RATIO} * w.n THEN other END AS form,
    CASE WHEN other_n >= {FORM_RATIO} * w.n THEN other_n END AS form_n FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
 chain AS (SELECT word, word AS at FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.at AS root FROM formed f
JOIN chain c ON c.word = f.word JOIN formed e ON e.word = c.at AND e.form IS NULL"""
