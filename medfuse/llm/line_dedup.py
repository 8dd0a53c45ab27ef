"""Line deduplication by a log-template tree, with DataFrame operations only.

A line's way through the tree is its number of tokens and its first ``DEPTH`` tokens; tokens with a digit are variable
fields from the start, but a line of fewer than ``DEPTH`` tokens is a template by its exact wording.  The rest of the line falls into ``FIELDS`` runs of tokens.  Wordings of a leaf that agree on
``SIMILARITY`` or more of their fields are linked, and the connected components are the leaf's templates: a leaf may hold any number
of them.  Two wordings agree on enough fields exactly if they agree on all fields of some subset of that size, so that
equal subsets meet and no pairs are made.

A template recurs if it stands in documents of two or more copy groups, however many copies a group has.  Copies are told
by whole documents: by the share of word pairs that two texts have in common, over a sketch of the ``SKETCH`` lowest hashes of
each text's pairs.  Sketches that agree on all pairs of one of ``CLASSES`` hash classes meet, and those with ``COPY`` or more of their
pairs in common are linked; the groups are the connected components.  Copies without a recurring line are thus left whole
for the near-duplicate operators, which keep one of each group.

Only hashes are shuffled until the very end: the texts move once, to meet the numbers of their dropped lines.  Joins are by
sort-merge at every size: both sides grow with the corpus, and a plan that broadcasts one of them while it is small would
shuffle more for each row of a larger corpus.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medfuse.llm.common import cut, discard, fresh
from medfuse.llm.components import components

DEPTH = 3
FIELDS = 8
SIMILARITY = 0.7
VARIABLE = "<*>"
MIN_DOCS = 2
SKETCH = 64             # lowest word-pair hashes that stand for a text
CLASSES = 12            # hash classes of a sketch; one of them must agree for two texts to be compared
COPY = 0.8              # share of word pairs in common from which two texts are copies
LAST = (1 << 63) - 1


def _even(text: Column) -> Column:
    """The text with one blank between tokens of a line.  The rewrite runs only over texts that need it: a search is far cheaper than a copy."""
    ragged = reduce(lambda a, b: a | b, [text.contains(x) for x in ("  ", "\t", "\r", "\f", "\x0b", " \n", "\n ")])
    return F.when(ragged, F.regexp_replace(F.regexp_replace(text, r"[\t\r\f\x0B ]+", " "), r" ?\n ?", "\n")).otherwise(text)


def _masked(line: Column) -> Column:
    """An even line with any token with a digit as the variable field."""
    digits = reduce(lambda a, b: a | b, [line.contains(str(d)) for d in range(10)])
    return F.when(digits, F.regexp_replace(line, r"(?<!\S)[^\s0-9]*+[0-9]\S*", VARIABLE)).otherwise(line)


def _doc(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("doc")


def copy_groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, label): the copy group (its smallest document) of each document that is a copy or near copy of another one."""
    text = F.col(text_col)
    spaced = reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(" ")), "\n\t\r\f\x0b", text)
    blank = F.when(text.rlike(r"[\t\r\f\x0B]"), spaced).otherwise(F.replace(text, F.lit("\n"), F.lit(" ")))
    pairs = F.zip_with("t", F.expr("slice(t, 2, size(t))"), lambda a, b: F.hash(a, b)).alias("pairs")
    # plain integers are made distinct and sorted by compiled code; a filter that lets fewer of them through is interpreted and dearer
    sketch = F.slice(F.sort_array(F.array_distinct("pairs")), 1, SKETCH).alias("sketch")
    classes = [F.expr(f"filter(sketch, x -> pmod(x, {CLASSES}) = {k})").alias(f"c{k}") for k in range(CLASSES)]
    class_keys = F.array(*[F.when(F.size(f"c{k}") > 0, F.xxhash64(F.lit(k), f"c{k}")) for k in range(CLASSES)]).alias("keys")
    # trimmed by its left end, a text is tested for words without being rewritten a second time; keys are written, as they are read twice
    prints = cut(docs.where(F.ltrim(text, F.lit(" \n\t\r\f\x0b")) != "").select(_doc(id_col), F.xxhash64(F.col(id_col), text).alias("rid"),
                                                                               F.split(blank, " ").alias("t"))
                 .select("doc", "rid", pairs).select("doc", "rid", sketch).select("*", *classes).select("doc", "rid", "sketch", class_keys))
    keys = prints.select("doc", "rid", F.explode("keys").alias("key")).where("key IS NOT NULL")
    # every text of a class is compared with the first one alone, so a large group costs no more than its rows
    firsts = cut(keys.groupBy("key").agg(F.min(F.struct("doc", "rid")).alias("head"), F.max("doc").alias("hi"))
                 .where("head.doc <> hi").selectExpr("key", "head.doc AS first", "head.rid AS first_rid"))
    met = cut(keys.join(firsts.hint("merge"), "key").where("doc <> first").select("rid", "first", "first_rid").distinct())
    heads = cut(prints.join(firsts.select(F.col("first_rid").alias("rid")).distinct().hint("merge"), "rid", "left_semi")
                .groupBy(F.col("rid").alias("first_rid")).agg(F.first("sketch").alias("other")))
    links = cut(prints.join(met.hint("merge"), "rid").join(heads.hint("merge"), "first_rid").where(
        F.size(F.array_intersect("sketch", "other")) >= COPY * F.size(F.array_union("sketch", "other"))).select("doc", "first").distinct())
    out = components(links, "doc", "first")
    for old in (prints, firsts, met, heads, links):
        discard(old)
    return out


def tree_lines(docs: DataFrame, id_col: str, text_col: str, depth: int, fields: int) -> DataFrame:
    """One row per line that reaches a leaf: document, line number, leaf, wording, fields."""
    base = docs.select(_doc(id_col), F.xxhash64(F.col(id_col), F.col(text_col)).alias("rid"), _even(F.col(text_col)).alias("even"))
    # lines are taken apart after the explode, where Spark compiles the work; before it, it would interpret it line by line.
    # The outer form: Spark would test the lines of a plain explode for emptiness by parsing the text once more
    lines = (base.select("doc", "rid", F.posexplode_outer(F.split("even", "\n")).alias("no", "line"))
             .select("doc", "rid", "no", F.trim("line").alias("line")).where("line <> ''"))
    masked = lines.select("*", _masked(F.col("line")).alias("masked")).select("*", F.split("masked", " ").alias("t"))
    # a line of fewer tokens than the tree is deep stands for itself, digits and all: numbers alone make no template
    rows = masked.select("doc", "rid", "no", "t", F.size("t").alias("n"), F.expr(f"CAST(ceil((size(t) - {depth}) / {fields}) AS INT)").alias("step"),
                         F.when(F.size("t") < depth, F.col("line")).otherwise(F.col("masked")).alias("own"))
    # one short form for all fields (runs beyond the end are empty): longer code would be too much for Spark to compile
    parts = [F.expr(f"xxhash64(slice(t, {depth + 1} + {i} * step, greatest(step, 0)))").alias(f"f{i}") for i in range(fields)]
    lead = F.substring_index("own", " ", depth)
    return rows.select("doc", "rid", "no", "n", F.xxhash64("n", lead).alias("leaf"), F.xxhash64("own").alias("wording"), *parts)


def generalised(lines: DataFrame, depth: int, fields: int, similarity: float) -> DataFrame:
    """(node, label): the template of every wording that is similar to another wording of its leaf.

    A node is the hash of a leaf and a wording, and the label of a template the smallest of its nodes.
    """
    names = [f"f{i}" for i in range(fields)]
    several = cut(lines.groupBy("leaf").agg(F.min("wording").alias("lo"), F.max("wording").alias("hi"))
                  .where("lo <> hi").select("leaf"))
    # the fields in use come first, and their number follows from the leaf's token count
    used = (f"IF(n <= {depth + fields}, n - {depth}, CAST(ceil((n - {depth}) / ceil((n - {depth}) / {fields})) AS INT))")
    # grouped by node, not by leaf: a shuffle follows the join, so that Spark may split a leaf with many lines
    wordings = cut(lines.join(several.hint("merge"), "leaf").groupBy(F.xxhash64("leaf", "wording").alias("node"))
                   .agg(F.max("leaf").alias("leaf"), F.max("n").alias("n"), *[F.max(c).alias(c) for c in names])
                   .select("leaf", "node", F.expr(used).alias("used"), *names))
    subsets = "CASE used "
    for u in range(1, fields + 1):
        least = max(1, math.ceil(similarity * u - 1e-9))
        keys = ", ".join(f"xxhash64(leaf, {k}, {', '.join(f'f{i}' for i in c)})" for k, c in enumerate(combinations(range(u), least)))
        subsets += f"WHEN {u} THEN array({keys}) "
    keyed = wordings.select("node", F.explode(F.expr(subsets + "END")).alias("key"))
    firsts = cut(keyed.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("hi")).where("first <> hi").select("key", "first"))
    links = cut(keyed.join(firsts.hint("merge"), "key").where("node <> first").select("node", "first").distinct())
    out = components(links, "node", "first")
    for old in (several, wordings, firsts, links):
        discard(old)
    return out


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, fields: int = FIELDS,
                  similarity: float = SIMILARITY, min_docs: int = MIN_DOCS) -> DataFrame:
    """(rid, n_gone, gone): for each row with lines to drop, its identity (``xxhash64(id, text)``), their number, and a
    binary mask with a ``1`` at the place of each of them (places beyond its end stay)."""
    lines = cut(tree_lines(docs, id_col, text_col, depth, fields))
    templates = generalised(lines, depth, fields, similarity)
    node = F.xxhash64("leaf", "wording")
    marked = cut(lines.select("doc", "rid", "no", node.alias("own")).join(templates.hint("merge"), F.col("own") == templates["node"], "left").select(
        "doc", "rid", "no", F.coalesce("label", "own").alias("template")))
    discard(lines)
    several = marked.groupBy("template").agg(F.min("doc").alias("first"), F.max("doc").alias("hi")).where("first <> hi")
    shared = cut(marked.select("template", "doc").join(several.select("template", "first").hint("merge"), "template").distinct())
    group = copy_groups(docs, id_col, text_col)
    # a copy group counts once for a template
    groups = (shared.join(group.hint("merge"), shared["doc"] == group["node"], "left")
              .groupBy("template", F.coalesce("label", "doc").alias("group")).agg(F.min("first").alias("first")))
    recurring = cut(groups.groupBy("template").agg(F.count(F.lit(1)).alias("groups"), F.min("first").alias("first"))
                    .where(F.col("groups") >= min_docs).select("template", "first"))
    out = cut(marked.join(recurring.hint("merge"), "template").where(F.col("doc") != F.col("first"))
              .groupBy("rid", "no").agg(F.lit(1).alias("one"))
              .groupBy("rid").agg(F.sort_array(F.collect_list("no")).alias("nos"))
              .select("rid", F.size("nos").alias("n_gone"), F.expr(
                  "encode(array_join(zip_with(nos, array_insert(nos, 1, -1), (a, b) -> IF(a IS NULL, '', concat(repeat('0', a - b - 1), '1'))), ''), 'UTF-8')")
                      .alias("gone")))
    for old in (marked, shared, recurring):
        discard(old)
    return out


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` without the lines whose template recurs, except in the document with the smallest id; more columns: how many
    lines the text had, and how many were dropped (named ``n_lines`` and ``n_dropped``, with underscores where taken).

    Lines end with a line feed and keep their order and bytes.  Blank lines have no leaf and
    stay.  A NULL text stays NULL (0 lines), an empty text is one empty line and stays.  Rows that share an id count as one
    document, and rows with a NULL id as one that comes last.  Equal rows get equal results and all stay.  A
    text of which every line is dropped becomes empty.  Other columns pass through, whatever their names; an empty table
    gives an empty result.
    """
    rid, key, gone, n_gone, n_lines, n_dropped = fresh(docs, "rid", "key", "gone", "n_gone", "n_lines", "n_dropped")
    masks = dropped_lines(docs, id_col, text_col, **settings).select(
        F.col("rid").alias(key), F.col("gone").alias(gone), F.col("n_gone").alias(n_gone))
    rows = docs.withColumn(rid, F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")))
    # always by sort-merge: the masks grow with the corpus, and the plan is then the same at every size
    both = rows.join(masks.hint("merge"), rows[rid] == masks[key], "left")
    # a binary slice is taken in one step, so a long text costs no more for each line than a short one
    kept = F.array_join(F.filter(F.split(F.col(f"`{text_col}`"), "\n"),
                                 lambda _, i: F.substring(F.col(gone), i + 1, F.lit(1)) != F.lit(b"1")), "\n")
    lines = F.when(F.col(f"`{text_col}`").isNull(), 0).otherwise(F.size(F.split(F.col(f"`{text_col}`"), "\n")))
    return both.select(
        *[(F.when(F.col(gone).isNull(), F.col(f"`{c}`")).otherwise(kept).alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns],
        lines.cast("bigint").alias(n_lines), F.coalesce(F.col(n_gone), F.lit(0)).cast("bigint").alias(n_dropped))
