"""Mixing sources to target weights by hierarchical budgeting over a domain-language-source tree.

Token counts are summed for each leaf.  From the root down, a node's budget is shared among its children by weight; a
child takes no more than all leaves below it hold in ``max_epochs`` passes, and what it leaves goes to its siblings by
weight before anything returns to their ancestors' siblings.  All shares are integers.  A leaf's tokens are taken as whole
passes over its documents, and one last pass in the order of a seeded hash, as far as its budget reaches.

The tree is aggregated rows only.  The place where a last pass ends is found by summing hash ranges of a few hundred
documents each, and by ordering the one range in which it falls; no leaf is ever sorted or gathered whole.  Documents then
meet one row per leaf, so texts do not move when that table is small enough for Spark to broadcast it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medfuse.llm.common import cut, discard, fresh

MAX_EPOCHS = 4
SEED = 17
RANGE_DOCS = 256        # documents in a hash range, on average
LEVELS = ("domain", "lang", "source")
NONE = "none"
#: Production weights: by domain, and by language under every domain; everything else weighs 1.
WEIGHTS = {("web",): 5, ("books",): 3, ("code",): 2, ("*", "en"): 4, ("*", "de"): 2, ("*", "fr"): 2}
#: Production budget: this share of all tokens, as a fraction.
BUDGET = (3, 5)


def token_count(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).cast("bigint")


def domain_of(source: Column) -> Column:
    """Domain of a source by the number at its end: 0, 1, 2 modulo 3 are web, books, code; no number is other."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return (F.when(F.coalesce(number, F.lit("")) == "", "other")
            .otherwise(F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("code")), F.try_to_number(number, F.lit("999999999")).cast("int") % 3 + 1)))


def weight_sql(level: int, weights: dict[tuple[str, ...], int]) -> str:
    """SQL of a node's weight: its own path, where ``*`` stands for any name; 1 if none is given."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"          # noqa: E731
    rules = [(p, w) for p, w in weights.items() if len(p) == level + 1]
    rules.sort(key=lambda r: r[0].count("*"))
    whens = [f"WHEN {' AND '.join([f'{LEVELS[i]} = {quote(x)}' for i, x in enumerate(p) if x != '*'] or ['true'])} THEN {int(w)}" for p, w in rules]
    return f"CAST(CASE {' '.join(whens)} ELSE 1 END AS BIGINT)" if whens else "CAST(1 AS BIGINT)"


def share_sql(parent: str) -> tuple[str, str, str]:
    """SQL for sharing among the children of ``parent``: capacity before a child in fill order, weight from it on, window."""
    by = f"PARTITION BY {parent}" if parent else ""
    order = f"{by} ORDER BY CAST(cap AS DOUBLE) / weight, {{name}} ROWS BETWEEN"
    return (
        f"coalesce(sum(cap) OVER ({order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)",
        f"sum(weight) OVER ({order} CURRENT ROW AND UNBOUNDED FOLLOWING)",
        f"{by}")


def budgets(leaves: DataFrame, budget: int, weights: dict[tuple[str, ...], int]) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens, docs, cap) with ``share``: the tokens that each leaf gives."""
    # capacities from the leaves up
    by_lang = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    by_domain = by_lang.groupBy("domain").agg(F.sum("cap").alias("cap"))
    total = by_domain.agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("cap")).first()["cap"]
    given = by_domain.withColumn("budget", F.lit(min(int(budget), int(total))).cast("bigint"))
    given = _shared(given, 0, "", weights)
    given = _shared(by_lang.join(given.select("domain", F.col("share").alias("budget")), "domain"), 1, "domain", weights)
    return _shared(leaves.join(given.select("domain", "lang", F.col("share").alias("budget")), ["domain", "lang"]), 2, "domain, lang", weights)


def _shared(children: DataFrame, level: int, parent: str, weights: dict[tuple[str, ...], int]) -> DataFrame:
    before, left, by = (s.format(name=LEVELS[level]) for s in share_sql(parent))
    columns = ", ".join(children.columns)
    weighed = children.selectExpr("*", f"{weight_sql(level, weights)} AS weight")
    # in the order of capacity by weight, a child is full if its capacity is within its share of what is left
    filled = weighed.selectExpr("*", f"cap * {left} <= weight * (budget - {before}) AS full")
    rest = filled.selectExpr("*", f"coalesce(sum(IF(full, cap, 0)) OVER ({by}), 0) AS taken", f"sum(IF(full, 0, weight)) OVER ({by}) AS open")
    return rest.selectExpr(*columns.split(", "), "IF(full, cap, ((budget - taken) * weight) DIV greatest(open, 1)) AS share")


def order_key(id_col: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(id_col.cast("string"), F.lit(""))))


def leaf_plan(slim: DataFrame, budget: int | None = None, weights: dict[tuple[str, ...], int] = WEIGHTS,
              max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per leaf of ``slim`` (doc_id, domain, lang, source, n_tokens): whole passes and the last key of the next one."""
    leaves = cut(slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
                 .withColumn("cap", F.col("tokens") * max_epochs))
    if budget is None:
        held = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
        budget = int(held) * BUDGET[0] // BUDGET[1]
    plan = cut(budgets(leaves, budget, weights).selectExpr(
        *LEVELS, "tokens", "docs", "share", "IF(tokens = 0, 0, share DIV greatest(tokens, 1)) AS passes",
        "IF(tokens = 0, 0, share % greatest(tokens, 1)) AS rest", f"CAST(ceil(docs / {RANGE_DOCS}) AS BIGINT) AS ranges"))
    keyed = (slim.join(plan.where("rest > 0"), list(LEVELS)).withColumn("key", order_key(F.col("doc_id"), F.col("passes"), seed))
             .selectExpr(*LEVELS, "n_tokens", "key", "rest", "(CAST(conv(substr(key, 1, 8), 16, 10) AS BIGINT) * ranges) DIV 4294967296 AS part"))
    sums = keyed.groupBy(*LEVELS, "part").agg(F.sum("n_tokens").alias("held"), F.max("rest").alias("rest"), F.max("key").alias("top"))
    running = cut(sums.selectExpr("*", f"sum(held) OVER (PARTITION BY {', '.join(LEVELS)} ORDER BY part) - held AS before"))
    whole = running.where("before + held <= rest").groupBy(*LEVELS).agg(F.max("top").alias("last"))
    edge = cut(running.where("before <= rest AND before + held > rest").select(*LEVELS, "part", "before"))
    inside = (keyed.join(edge, [*LEVELS, "part"])
              .selectExpr(*LEVELS, "key", "rest", f"before + sum(n_tokens) OVER (PARTITION BY {', '.join(LEVELS)}, part ORDER BY key) AS sofar")
              .where("sofar <= rest").groupBy(*LEVELS).agg(F.max("key").alias("last")))
    last = whole.unionByName(inside).groupBy(*LEVELS).agg(F.max("last").alias("last"))
    out = cut(plan.join(last, list(LEVELS), "left").select(*LEVELS, "tokens", "share", "passes", F.coalesce("last", F.lit("")).alias("last")))
    for old in (leaves, plan, running, edge):
        discard(old)
    return out


def tree_columns(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens) of each row, without texts."""
    source = F.col(f"`{source_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), domain_of(source).alias("domain"),
                       F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NONE)).alias("lang"), F.coalesce(source, F.lit(NONE)).alias("source"),
                       token_count(F.col(f"`{text_col}`")).alias("n_tokens"))


def mix(docs: DataFrame, budget: int | None = None, weights: dict[tuple[str, ...], int] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
        seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
        slim_rows: bool = False) -> DataFrame:
    """The chosen rows of ``docs``, once for each pass, with the pass number as column ``epoch`` (underscores added where taken).

    ``budget``: tokens in all; by default ``BUDGET`` of what ``docs`` holds.  With ``slim_rows`` the result is (doc_id, domain,
    lang, source, n_tokens, epoch) and no texts.

    A token is a run of characters other than blanks.  A NULL language or source is a node named ``none``, and a source without a
    number at its end has the domain ``other``.  NULL and empty texts have no tokens: they ride along in every whole pass of
    their leaf and in the part of the last pass that they fall in; a leaf without tokens gives nothing.  Rows with equal ids
    (or NULL ones) share a place in the order and are taken or left together.  Other columns pass through; an empty table
    gives an empty result.
    """
    slim = cut(tree_columns(docs, id_col, text_col, lang_col, source_col))
    plan = leaf_plan(slim, budget, weights, max_epochs, seed)
    if slim_rows:
        rows, names = slim, ["doc_id", *LEVELS, "n_tokens"]
        d, l, s, key_id, epoch_name = F.col("domain"), F.col("lang"), F.col("source"), F.col("doc_id"), "epoch"
    else:
        rows, names = docs, docs.columns
        source = F.col(f"`{source_col}`").cast("string")
        d, l, s = domain_of(source), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NONE)), F.coalesce(source, F.lit(NONE))
        key_id, (epoch_name,) = F.col(f"`{id_col}`"), fresh(docs, "epoch")
    mine, theirs, passes, last = fresh(rows, "leaf_of_row", "leaf_of_plan", "leaf_passes", "leaf_last")
    chosen = plan.select(F.struct(*LEVELS).alias(theirs), F.col("passes").alias(passes), F.col("last").alias(last))
    both = rows.withColumn(mine, F.struct(d.alias("domain"), l.alias("lang"), s.alias("source"))).join(
        chosen, F.col(mine) == F.col(theirs))
    tail = F.when(order_key(key_id, F.col(passes), seed) <= F.col(last), 1).otherwise(0)
    times = F.col(passes) + tail
    return both.where(times > 0).select(
        *[F.col(f"`{c}`") for c in names], F.explode(F.sequence(F.lit(0).cast("bigint"), times - 1)).alias(epoch_name))


def oracle_sql(weights: dict[tuple[str, ...], int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> str:
    """DuckDB SQL of ``mix(documents, slim_rows=True)``: the same shares, and last passes by one running sum over each leaf."""
    def level(i: int, source: str, parent: str, out: str) -> str:
        before, left, by = (s.format(name=LEVELS[i]) for s in share_sql(parent))
        return f"""
 w{i} AS (SELECT *, {weight_sql(i, weights)} AS weight FROM {source}),
 f{i} AS (SELECT *, cap * {left} <= weight * (budget - {before}) AS filled FROM w{i}),
 t{i} AS (SELECT *, coalesce(sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ({by}), 0) AS taken, sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({by}) AS open FROM f{i}),
 {out} AS (SELECT *, CAST(CASE WHEN filled THEN cap ELSE ((budget - taken) * weight) // greatest(open, 1) END AS BIGINT) AS share FROM t{i})"""
    return f"""
WITH slim AS (
  SELECT doc_id, CASE WHEN coalesce(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') = '' THEN 'other'
           ELSE ['web', 'books', 'code'][CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INTEGER) % 3 + 1] END AS domain,
         coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source,
         CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS BIGINT) AS n_tokens
  FROM documents),
 leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {max_epochs} AS BIGINT) AS cap FROM slim GROUP BY ALL),
 langs AS (SELECT domain, lang, CAST(sum(cap) AS BIGINT) AS cap FROM leaves GROUP BY ALL),
 domains AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, least((SELECT CAST(sum(tokens) AS BIGINT) * {BUDGET[0]} // {BUDGET[1]} FROM leaves), (SELECT CAST(sum(cap) AS BIGINT) FROM leaves)) AS budget
             FROM langs GROUP BY domain),{level(0, "domains", "", "s0")},
 lang_budget AS (SELECT langs.*, s0.share AS budget FROM langs JOIN s0 USING (domain)),{level(1, "lang_budget", "domain", "s1")},
 leaf_budget AS (SELECT leaves.*, s1.share AS budget FROM leaves JOIN s1 USING (domain, lang)),{level(2, "leaf_budget", "domain, lang", "s2")},
 plan AS (SELECT domain, lang, source, CASE WHEN tokens = 0 THEN 0 ELSE share // greatest(tokens, 1) END AS passes,
                 CASE WHEN tokens = 0 THEN 0 ELSE share % greatest(tokens, 1) END AS rest FROM s2),
 keyed AS (SELECT slim.*, passes, rest, md5('{seed}:' || CAST(passes AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
           FROM slim JOIN plan USING (domain, lang, source)),
 placed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS sofar FROM keyed),
 counted AS (SELECT *, passes + CASE WHEN rest > 0 AND sofar <= rest THEN 1 ELSE 0 END AS times FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(CAST(times AS BIGINT))) AS BIGINT) AS epoch FROM counted WHERE times > 0"""
