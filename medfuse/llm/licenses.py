"""Licence scan: a positional rare-token index over licence templates, looked up inside each text.

A template is a run of words with mandatory key phrases at fixed places.  One pass over all documents counts in how many
of them each key word stands; the index keeps each template's key words by falling IDF with their places.  A file's
words are looked up in it: a template's rarest word gives the places where the template could begin, the next rarest ones
must stand at the same relative positions, and what is left is verified by its key phrases, word by word.  As every
place of a template holds all of its key words, none is missed whatever the counts are: IDF decides the work, not the
result.

All of it is array expressions on the row itself: texts never move, nothing is grouped by document, and a file of any
length or with any number of notices is one row.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medfuse.llm.common import fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
INTERSECTED = 2             # words beside the rarest one whose places must agree before key phrases are compared


@dataclass(frozen=True)
class Template:
    """``text`` and the phrases of it that must stand word by word, in words of a-z, 0-9 and characters from U+0080 up."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False

    def words(self) -> list[str]:
        return self.text.split()

    def spans(self) -> list[tuple[int, int]]:
        """(first word, number of words) of each key phrase."""
        words, out = self.words(), []
        for key in self.keys:
            k = key.split()
            at = next((i for i in range(len(words) - len(k) + 1) if words[i:i + len(k)] == k), None)
            if at is None or not k:
                raise ValueError(f"key phrase {key!r} is not in the template {self.text!r}")
            out.append((at, len(k)))
        return out

    def key_words(self) -> dict[str, int]:
        """First place of each word of the key phrases."""
        words, out = self.words(), {}
        for at, size in sorted(self.spans()):
            for i in range(at, at + size):
                out.setdefault(words[i], i)
        return out


def base_phrase(label: str, phrase: str) -> Template:
    return Template(label, phrase, (phrase,), base=True)


BASE = (
    base_phrase("cc-by", "cc by"),
    base_phrase("gpl", "general public license"),
    base_phrase("reserved", "all rights reserved"),
)

# Opening and notice sentences of public licences.
TEMPLATES = BASE + (
    Template("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("boost", "distributed under the boost software license version 1 0", ("boost software license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
                    "following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights",
             ("waived all copyright and related or neighboring rights",)),
    Template("creative-commons", "this work is licensed under a creative commons attribution", ("creative commons attribution",)),
    Template("epl", "made available under the terms of the eclipse public license", ("eclipse public license",)),
    Template("gnu-gpl", "this work is licensed under the gnu general public license", ("gnu general public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
             ("permission to use copy modify and", "distribute this software for any purpose", "without fee is hereby granted")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                    "documentation files", ("permission is hereby granted free of charge", "obtaining a copy of this software")),
    Template("mit", "released under the mit license", ("under the mit license",)),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", ("subject to the terms of the mozilla public license",)),
    Template("proprietary", "unauthorized copying of this file via any medium is strictly prohibited", ("unauthorized copying of this file", "strictly prohibited")),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("free and unencumbered software released into the public domain",)),
)

INDEX_SCHEMA = ("array<struct<label: string, base: boolean, words: array<string>, keys: array<struct<at: int, size: int>>, "
                "seed: string, seed_at: int, others: array<struct<word: string, at: int>>>>")


def word_array(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; a NULL text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), "")


def inverse_frequencies(docs: DataFrame, words: Sequence[str], text_col: str = "text") -> dict[str, float]:
    """ln((1 + N) / (1 + df)) of each of ``words`` over all rows of ``docs``; at most one row a word reaches the driver."""
    known = F.array(*[F.lit(w) for w in words])
    counts = (docs.select(F.explode(F.array_append(F.array_intersect(word_array(F.col(f"`{text_col}`")), known), F.lit(""))).alias("word"))
              .groupBy("word").agg(F.count("*").alias("n")))
    df = {r["word"]: r["n"] for r in counts.collect()}
    total = df.get("", 0)           # every row has the empty word once
    return {w: math.log((1 + total) / (1 + df.get(w, 0))) for w in words}


def index(templates: Sequence[Template], idf: dict[str, float]) -> list[dict]:
    """One entry for each template: its rarest key word with its place, the next rarest ones, and what is verified."""
    out = []
    for t in templates:
        ranked = sorted(t.key_words().items(), key=lambda x: (-idf[x[0]], x[0]))
        (seed, seed_at), others = ranked[0], ranked[1:1 + INTERSECTED]
        out.append({"label": t.label, "base": t.base, "words": t.words(), "keys": [{"at": a, "size": n} for a, n in t.spans()],
                    "seed": seed, "seed_at": seed_at, "others": [{"word": w, "at": a} for w, a in others]})
    return out


def scan(docs: DataFrame, text_col: str = "text", templates: Sequence[Template] = TEMPLATES) -> tuple[DataFrame, list[str]]:
    """``docs`` with two columns more, and their names: number of words, and the licence places of each text.

    A place is a struct (label, base, first: word number from 0, score: share of the template's words that stand at their
    places) for every template and every place where all of its key phrases stand.  A NULL, empty or wordless text has
    no words and no places; repeated rows are scanned each for itself; an empty table gives an empty result; the names do
    not clash with columns of ``docs``.
    """
    vocabulary = sorted({w for t in templates for w in t.key_words()})
    entries = index(templates, inverse_frequencies(docs, vocabulary, text_col))
    n_words, places = names = fresh(docs, "n_words", "places")
    words, hits = fresh(docs, "words", "hits")
    seeds = sorted({e["seed"] for e in entries})
    looked = docs.select("*", word_array(F.col(f"`{text_col}`")).alias(words))
    looked = looked.select("*", F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))),
                                         lambda i: F.get(words, i).isin(seeds)).alias(hits))
    table = F.from_json(F.lit(json.dumps(entries)), INDEX_SCHEMA)

    def at(hit: Column) -> Column:
        def stands(t: Column) -> Column:
            first = hit - t["seed_at"]
            intersect = F.forall(t["others"], lambda o: F.coalesce(F.get(words, first + o["at"]) == o["word"], F.lit(False)))
            phrases = F.forall(t["keys"], lambda k: F.slice(words, first + k["at"] + 1, k["size"]) == F.slice(t["words"], k["at"] + 1, k["size"]))
            return (F.get(words, hit) == t["seed"]) & (first >= 0) & intersect & phrases

        def place(t: Column) -> Column:
            first = hit - t["seed_at"]
            same = F.filter(t["words"], lambda w, i: F.coalesce(F.get(words, first + i) == w, F.lit(False)))
            return F.struct(t["label"].alias("label"), t["base"].alias("base"), first.cast("bigint").alias("first"),
                            (F.size(same).cast("double") / F.size(t["words"])).alias("score"))

        return F.transform(F.filter(table, stands), place)

    return looked.select(*[F.col(f"`{c}`") for c in docs.columns], F.size(words).cast("bigint").alias(n_words),
                         F.flatten(F.transform(hits, at)).alias(places)), names


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """One row per document: number of words, base places and their first and last word, labels, and the best score.

    ``labels`` holds the base labels too; both lists are sorted, distinct and comma-joined (empty if there is none).  The
    score is that of the best place, 0 without one.  See ``scan`` for NULLs, empty texts and repeated rows.
    """
    found, (n_words, places) = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", templates)
    base = F.filter(places, lambda p: p["base"])

    def names(of: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(of["label"])), ",")

    return found.select(
        "doc_id", F.col(n_words).alias("n_words"), F.size(base).cast("bigint").alias("n_base"),
        F.array_min(base["first"]).alias("first_word"), F.array_max(base["first"]).alias("last_word"),
        names(base).alias("base_labels"), names(F.col(places)).alias("labels"),
        F.coalesce(F.array_max(F.col(places)["score"]), F.lit(0.0)).alias("score"))


def oracle_sql(templates: Sequence[Template] = TEMPLATES) -> str:
    """DuckDB SQL of ``report`` over ``documents``: every key word joined with every word, without an index."""
    def rows(values):
        return ", ".join("(" + ", ".join(str(v) if not isinstance(v, str) else f"'{v}'" for v in r) + ")" for r in values)

    names = rows((i, t.label, t.base, len(t.words()), len({p for a, n in t.spans() for p in range(a, a + n)})) for i, t in enumerate(templates))
    every = rows((i, p, w, p in {x for a, n in t.spans() for x in range(a, a + n)}) for i, t in enumerate(templates) for p, w in enumerate(t.words()))
    return f"""
WITH t(k, label, base, n, n_keys) AS (VALUES {names}),
 tw(k, place, word, is_key) AS (VALUES {every}),
 d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
 p AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d),
 places AS (SELECT doc_id, k, i - place AS first, count(*) AS n_same, count(*) FILTER (is_key) AS n_found FROM p JOIN tw USING (word) GROUP BY 1, 2, 3),
 found AS (SELECT doc_id, label, base, first, n_same / CAST(n AS DOUBLE) AS score FROM places JOIN t USING (k) WHERE n_found = n_keys AND first >= 0),
 told AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word, max(score) AS score
          FROM found GROUP BY 1),
 names AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
           FROM (SELECT DISTINCT doc_id, label, base FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN told USING (doc_id) LEFT JOIN names USING (doc_id)"""
