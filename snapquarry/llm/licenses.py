"""License scan by a positional index of rare template words.

The index posts every word of the templates' mandatory key phrases under its template and
position, ranked by inverse document frequency over all documents.  Of each file the
highest-ranked of these words are looked up: as many as it takes until every template whose
mandatory words are all in the file has two of them (its one word, if it has no more).  Each
place of such a word, less its position in the template, is where the template would have to
start; the starts that all looked-up words of a template agree on are kept.  There every
mandatory phrase must stand word by word, and enough of the template's other words, counted
over those that the file has room for: a notice may be cut off by either end of the file.

Nothing is missed: where all mandatory phrases stand, so does each looked-up word.  Words
inserted between two mandatory phrases of one notice do lose it.

Only DataFrame functions are used.  Everything happens within a row: no join, no shuffle,
no group.  The counts of template words are one row for the whole corpus.

Defined results: a null text is an empty one, with no words and no labels; without base
phrases the first and last word are null and the labels empty strings; repeated rows give
equal rows; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table


@dataclass(frozen=True)
class Template:
    """``keys``: (first word, number of words) of each mandatory phrase; without any, the whole text."""

    label: str
    text: str
    base: bool = False
    keys: tuple[tuple[int, int], ...] = ()

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def mandatory(self) -> tuple[tuple[int, int], ...]:
        return self.keys or ((0, len(self.words)),)


# The base phrases and their labels.
BASE = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
)
# Names and opening lines of well-known license notices, in lower case without punctuation.
NOTICES = (
    Template("gpl-2.0", "gnu general public license version 2"),
    Template("gpl-3.0", "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", keys=((3, 5), (18, 4))),
    Template("apache-2.0", "apache license version 2 0"),
    Template("cc-by-4.0", "cc by 4 0"),
    Template("cc-by-nc-4.0", "cc by nc 4 0"),
    Template("cc-by-sa-4.0", "cc by sa 4 0"),
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", keys=((2, 5), (10, 3))),
    Template("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", keys=((0, 4), (5, 3))),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", keys=((16, 4),)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", keys=((6, 3),)),
    Template("isc-notice", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", keys=((1, 4), (16, 3))),
    Template("unlicense", "this is free and unencumbered software released into the public domain", keys=((2, 4),)),
)
TEMPLATES = BASE + NOTICES

_LOOKED_UP = 2  # mandatory words of each possible template
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def document_frequencies(text: Column, docs: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """In how many documents each word stands: one row of counts for the whole table."""
    low = docs.select(F.lower(text).alias("low"))
    counts = [F.count_if(F.when(F.contains("low", F.lit(w)), F.col("low").rlike(f"(?:^|{_BREAK}){w}(?:$|{_BREAK})"))).alias(f"n{i}") for i, w in enumerate(vocabulary)]
    row = low.agg(F.count(F.lit(1)).alias("all"), *counts).first()
    return {w: row[f"n{i}"] for i, w in enumerate(vocabulary)} | {"": row["all"]}


@dataclass(frozen=True)
class Index:
    """``words``, rarest first; for each template its ``postings`` (rank of the word, position), rarest first."""

    words: list[str]
    postings: list[list[tuple[int, int]]]

    def needed(self, k: int) -> list[str]:
        """The distinct mandatory words of a template, rarest first."""
        return [self.words[r - 1] for r in sorted({r for r, _ in self.postings[k]})]

    def depth(self, k: int) -> int:
        """Up to which rank words are looked up where this template is possible."""
        return self.postings[k][:_LOOKED_UP][-1][0]


def build_index(docs: DataFrame, templates: Sequence[Template], text: str = "text") -> Index:
    """All mandatory words of the templates, ranked over all documents."""
    mandatory = [[(t.words[i], i) for first, n in t.mandatory for i in range(first, first + n)] for t in templates]
    vocabulary = sorted({w for ws in mandatory for w, _ in ws})
    df = document_frequencies(F.col(text), docs, vocabulary)
    idf = {w: math.log((df[""] + 1) / (df[w] + 1)) for w in vocabulary}
    ranked = sorted(vocabulary, key=lambda w: (-idf[w], w))
    rank = {w: i for i, w in enumerate(ranked, 1)}
    return Index(ranked, [sorted((rank[w], at) for w, at in ws) for ws in mandatory])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also inside of lambda functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _possible(index: Index, holds: Callable[[str], Column]) -> Column:
    """Whether some template has all its mandatory words, the rarest asked first."""
    some = F.lit(False)
    for k in range(len(index.postings)):
        every = F.lit(True)
        for w in index.needed(k):
            every = every & holds(w)
        some = some | every
    return some


def _matches(words: Column, index: Index, templates: Sequence[Template], least: float) -> Column:
    """Array of (template, start, share of equal words) at the places where all mandatory phrases stand."""
    literal = F.array(*[
        F.struct(
            F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.array(*[F.lit(w) for w in t.words]).alias("text"),
            F.array(*[F.struct(F.lit(a).alias("a"), F.lit(n).alias("n")) for a, n in t.mandatory]).alias("keys"),
            F.array(*[F.struct(F.lit(index.words[r - 1]).alias("w"), F.lit(r).alias("rank"), F.lit(at).alias("at")) for r, at in index.postings[k]]).alias("postings"),
            F.array(*[F.lit(w) for w in index.needed(k)]).alias("needed"), F.lit(index.depth(k)).alias("depth"),
        )
        for k, t in enumerate(templates)
    ])
    ranked = F.array(*[F.lit(w) for w in index.words])
    placed = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(index.words))

    def look_up(placed: Column) -> Column:
        here = F.array_distinct(F.transform(placed, lambda x: x["w"]))
        possible = _let(here, lambda ws: F.filter(literal, lambda t: F.size(F.array_except(t["needed"], ws)) == 0))
        return _let(possible, lambda ts: _let(F.coalesce(F.array_max(F.transform(ts, lambda t: t["depth"])), F.lit(0)), lambda depth: intersect(placed, ts, depth)))

    def intersect(placed: Column, possible: Column, depth: Column) -> Column:
        rarest = _let(F.slice(ranked, 1, depth), lambda ws: F.filter(placed, lambda x: F.array_contains(ws, x["w"])))

        def starts(rarest: Column, t: Column) -> Column:
            start = lambda p: F.transform(F.filter(rarest, lambda x: x["w"] == p["w"]), lambda x: x["i"] - p["at"])
            return _let(F.filter(t["postings"], lambda p: p["rank"] <= depth), lambda ps: F.aggregate(ps, start(F.element_at(ps, 1)), lambda both, p: F.array_intersect(both, start(p))))

        return _let(rarest, lambda r: F.flatten(F.transform(possible, lambda t: F.transform(starts(r, t), lambda s: verify(t, s)))))

    def verify(t: Column, start: Column) -> Column:
        first, skipped = F.greatest(start, F.lit(0)), F.greatest(-start, F.lit(0))
        whole = F.forall(t["keys"], lambda key: (start + key["a"] >= 0) & (F.slice(words, F.greatest(start + key["a"], F.lit(0)) + 1, key["n"]) == F.slice(t["text"], key["a"] + 1, key["n"])))
        part = F.slice(words, first + 1, F.size(t["text"]) - skipped)
        equal = F.filter(F.zip_with(part, F.slice(t["text"], skipped + 1, F.size(t["text"])), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda e: e)
        share = F.when(whole, F.size(equal) / F.size(part)).otherwise(0.0)
        return F.struct(t["label"].alias("label"), t["base"].alias("base"), first.cast("long").alias("start"), share.alias("share"))

    return F.filter(_let(placed, look_up), lambda m: m["share"] >= least)


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """``docs`` with ``n_words`` and ``matches`` (template label, base, start, share)."""
    index = build_index(docs, templates)
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)  # lets every ASCII letter through: no match is lost by it
    words = F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_WORD), F.lit(0))
    found = _let(words, lambda w: _matches(w, index, templates, least))
    nothing = F.array().cast("array<struct<label:string,base:boolean,start:bigint,share:double>>")
    matches = F.when(_possible(index, lambda w: F.contains(low, F.lit(w))), found)
    return docs.withColumn("n_words", F.regexp_count(text, F.lit(_WORD_ANY_CASE)).cast("long")).withColumn("matches", F.coalesce(matches, nothing))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "matches")
    base = F.filter("matches", lambda m: m["base"])
    join = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["start"])
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        join(base).alias("base_labels"), join(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )


def _oracle(templates: Sequence[Template] = TEMPLATES, least: float = 0.8) -> str:
    rows = ",\n".join(f"({k}, '{t.label}', {str(t.base).lower()}, {t.words!r}, {[[a, n] for a, n in t.mandatory]!r})" for k, t in enumerate(templates))
    return rf"""
WITH t(k, label, base, tw, keys) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
p AS (SELECT r, label, base, tw, keys, w, i - 1 - keys[1][1] AS start
      FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) x JOIN t ON w[i] = tw[1 + keys[1][1]]),
m AS (SELECT r, label, base, greatest(start, 0) AS start,
             len(list_filter(range(1, len(tw) + 1), lambda j: start + j > 0 AND coalesce(w[start + j] = tw[j], false)))::DOUBLE
             / len(list_filter(range(1, len(tw) + 1), lambda j: start + j BETWEEN 1 AND len(w))) AS share,
             len(list_filter(keys, lambda q: start + q[1] >= 0 AND w[start + q[1] + 1 : start + q[1] + q[2]] = tw[q[1] + 1 : q[1] + q[2]])) = len(keys) AS whole
      FROM p),
g AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
      FROM m WHERE whole AND share >= {least} GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN g USING (r)
"""


ORACLE = _oracle()
