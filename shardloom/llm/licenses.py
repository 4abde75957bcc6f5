"""License scan with a positional rare-token index, with DataFrame operations only.

Texts are lower-cased (A-Z) and cut into words.  The index holds postings (word, template,
offsets): for each template its words that are rare over all documents (in a ``RARE``th of them
at most, or among the template's ``KEPT`` rarest).  Each file's licence words are looked up there by a
join; of each template a file goes on with its ``TOP`` words of highest IDF, rarest first.
Every place of such a word, less its offset in the template, proposes a start; the starts
on which two of the words agree are what is left after intersecting the postings, and there
the template's mandatory key phrases must stand, at their offsets: exactly for base templates,
whose key is the whole phrase, and within ``SLACK`` words for the others, which may have
names or changes inside: there a key has several short phrases, any of which will do, so that a changed
word rarely hides a licence.  A place is where the template's text would begin.  Templates are data: more of them make a longer index, not a longer plan.

A file's words are kept for the second step only if two of them are licence words other than
``COMMON``; each base phrase has two such words.

Nulls: a null text is empty.  Ties between words of one frequency go to the smaller word; a
template that stands in a text several times has several places.  A very long text is one
row, and the work on it grows with its length.  Rows that repeat a doc_id are one row each; empty
tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, text_of, written

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TOP, SLACK, KEPT, RARE = 8, 16, 8, 20
COMMON = {*"a above all and any are as at be by can for from if in is it may not of on one or other out that the this to under was will with you".split()}


def cut(text: str) -> list[str]:
    return [w for w in re.split(SPLIT, text.lower()) if w]


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[tuple[str, ...], ...] = field(default=())  # of each key any phrase must stand there
    base: bool = False
    at: int | None = None  # the offset of phrases that the text doesn't have

    @property
    def words(self) -> list[str]:
        return cut(self.text)

    def phrases(self) -> list[list[tuple[int, list[str]]]]:
        """(offset, words) of the phrases of each mandatory key; without any the whole text is one."""
        words = self.words

        def place(k: list[str]) -> int:
            return next((i for i in range(len(words)) if words[i : i + len(k)] == k), self.at)

        return [[(place(k), k) for k in map(cut, key)] for key in self.keys] or [[(0, words)]]


#: Phrases, texts and labels.
TEMPLATES = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        (
            ("hereby granted", "free of charge", "person obtaining", "associated documentation", "to deal in"),
            ("without restriction", "modify merge", "publish distribute", "persons to whom", "substantial portions"),
        ),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies.",
        (
            ("permission to use copy", "or distribute this", "for any purpose with", "with or without", "without fee"),
            ("without fee", "fee is", "is hereby granted", "provided that the above", "appear in all copies"),
        ),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
        (
            ("redistribution and use", "source and binary", "binary forms", "with or without", "without modification"),
            ("without modification", "are permitted provided", "redistributions of source", "source code must", "list of conditions", "redistributions in binary", "following disclaimer"),
        ),
    ),
    Template(
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
        (
            ("express or implied", "no event will", "authors be held", "held liable", "damages arising"),
            ("granted to anyone", "commercial applications", "alter it", "and redistribute it", "it freely"),
        ),
    ),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version.",
        (("program is free", "free software", "can redistribute", "redistribute it", "or modify it"), ("gnu general",)),
    ),
    Template(
        "lgpl",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version.",
        (("library is free", "free software", "can redistribute", "redistribute it", "or modify it"), ("gnu lesser", "lesser general")),
    ),
    Template(
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        (("apache license", "license version 2", "the apache"), ("may not use", "this file except", "in compliance", "compliance with", "may obtain")),
    ),
    Template("gpl", "licensed under the gnu general public license", (("licensed under", "under the", "public license"), ("gnu general",))),
    Template("lgpl", "licensed under the gnu lesser general public license", (("licensed under", "under the", "public license"), ("gnu lesser", "lesser general"))),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", (("source code form", "code form is", "form is subject", "subject to the terms"), ("mozilla public", "the mozilla", "public license v", "license v 2", "v 2 0"))),
    Template("unlicense", "This is free and unencumbered software released into the public domain.", (("free and unencumbered", "and unencumbered", "unencumbered software"), ("software released", "released into", "public domain"))),
    Template("cc-by-sa", "cc by sa"),
    Template("all-rights-reserved", "all rights reserved", (("all rights reserved",), ("copyright",)), at=-SLACK // 2),
    *(
        Template(label, f"spdx license identifier {name}")
        for label, name in (("apache-2", "apache 2 0"), ("bsd", "bsd 2 clause"), ("bsd", "bsd 3 clause"), ("gpl", "gpl 2 0"), ("gpl", "gpl 3 0"), ("isc", "isc"), ("lgpl", "lgpl 2 1"), ("lgpl", "lgpl 3 0"), ("mit", "mit"), ("mpl-2", "mpl 2 0"), ("unlicense", "unlicense"), ("zlib", "zlib"))
    ),
)
VOCABULARY = sorted({w for t in TEMPLATES for w in t.words})
CONTENT = [w for w in VOCABULARY if w not in COMMON]


def word_array() -> Column:
    """The words of ``text``; a split leaves an empty text before a leading separator and after a trailing one."""
    return F.filter(F.split(ascii_lower(text_of()), SPLIT), lambda w: w != "")


def parsed(docs: DataFrame) -> DataFrame:
    """file_id, doc_id, n_words, known (the licence words in the text) and, where they may make up a template, text."""
    found = docs.select("doc_id", text_of().alias("text"), word_array().alias("words"))
    known = F.array_distinct(F.filter("words", lambda w: w.isin(VOCABULARY)))
    found = found.select("doc_id", "text", F.size("words").cast("long").alias("n_words"), known.alias("known"))
    content = F.size(F.filter("known", lambda w: w.isin(CONTENT)))
    return found.select(F.monotonically_increasing_id().alias("file_id"), "doc_id", "n_words", "known", F.when(content > 1, F.col("text")).alias("text"))


def rarity(files: DataFrame) -> tuple[int, dict[str, int]]:
    """The number of texts, and those that have each licence word; at most a row per licence word comes to the driver."""
    found = files.select(F.explode("known").alias("w")).groupBy("w").count().collect()
    return files.count(), {r[0]: r[1] for r in found}


def index(spark: SparkSession, n: int, df: dict[str, int]) -> DataFrame:
    """word, posting (template, df, word, offsets), of: the indexed words of the template; a few rows per template."""
    rows = []
    for t, template in enumerate(TEMPLATES):
        places: dict[str, list[int]] = {}
        for i, w in enumerate(template.words):
            places.setdefault(w, []).append(i)
        order = sorted(set(places) & set(df), key=lambda w: (df[w], w))  # a word in no text finds none
        rare = [w for i, w in enumerate(order) if i < KEPT or df[w] * RARE <= n]
        rows += [(w, (t, df[w], w, places[w]), len(rare)) for w in rare]
    return spark.createDataFrame(rows, "word string, posting struct<template:int,df:long,word:string,offsets:array<int>>, of int")


def looked_up(files: DataFrame, postings: DataFrame) -> DataFrame:
    """A row per file with indexed words: file_id, found (array of postings), share (the largest part of a template's indexed words)."""
    hits = files.select("file_id", F.explode("known").alias("word")).join(F.broadcast(postings), "word")  # fixed by the templates
    by_template = hits.groupBy("file_id", F.col("posting.template").alias("template")).agg(F.sort_array(F.collect_list("posting")).alias("postings"), (F.count("*") / F.first("of")).alias("share"))
    anchors = F.struct("template", F.slice("postings", 1, TOP).alias("anchors"))
    return by_template.groupBy("file_id").agg(F.max("share").alias("share"), F.collect_list(F.when(F.size("postings") > 1, anchors)).alias("found"))


def _templates() -> Column:
    def one(t: Template) -> Column:
        phrase = lambda at, words: F.struct(F.lit(at).alias("at"), F.array(*map(F.lit, words)).alias("words"))
        keys = F.array(*(F.array(*(phrase(*p) for p in key)) for key in t.phrases()))
        return F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(0 if t.base else SLACK).alias("slack"), keys.alias("keys"))

    return F.array(*map(one, TEMPLATES))


def _agreed(anchors: Column, rare: Column) -> Column:
    """The starts that two of the anchors propose."""

    def starts(a: Column) -> Column:
        return F.flatten(F.transform(F.filter(rare, lambda x: x["word"] == a["word"]), lambda x: F.transform(a["offsets"], lambda o: x["place"] - o)))

    # Each anchor proposes a start once, so in order those of two anchors stand beside each other.
    proposed = F.sort_array(F.flatten(F.transform(anchors, lambda a: F.array_distinct(starts(a)))))
    twice = F.transform(F.array(proposed), lambda all_: F.filter(all_, lambda s, i: (i > 0) & (s == F.get(all_, i - 1))))
    return F.array_distinct(F.flatten(twice))


def _places(template: Column, agreed: Column, words: Column) -> Column:
    """Where the template begins by the first phrase of its first key that stands, for the starts at which all keys do."""

    def near(phrase: Column, start: Column) -> Column:
        low, high = (F.greatest(F.lit(0), start + phrase["at"] + x) for x in (-template["slack"], template["slack"]))
        return F.sequence(low, high)

    def stands(phrase: Column, p: Column) -> Column:
        return (F.get(words, p) == F.get(phrase["words"], F.lit(0))) & (F.slice(words, p + 1, F.size(phrase["words"])) == phrase["words"])

    def has(key: Column, start: Column) -> Column:
        return F.exists(key, lambda k: F.exists(near(k, start), lambda p: stands(k, p)))

    def begins(start: Column) -> Column:
        found = F.transform(F.get(template["keys"], F.lit(0)), lambda k: F.transform(F.filter(near(k, start), lambda p: stands(k, p)), lambda p: F.greatest(F.lit(0), p - k["at"])))
        return F.get(F.flatten(found), F.lit(0))

    sure = F.filter(agreed, lambda s: (~template["base"] | (s >= 0)) & F.forall(template["keys"], lambda key: has(key, s)))
    return F.transform(F.array_distinct(F.transform(sure, begins)), lambda p: F.struct(template["label"].alias("label"), p.alias("place"), template["base"].alias("base")))


def scan(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_words, places (label, first word, base) of all matches, score.

    The score is 1 with a match, else half the largest share of a template's indexed words that the text has.
    """
    files = written(parsed(docs), "licenses")
    candidates = looked_up(files, index(docs.sparkSession, *rarity(files)))
    cut = files.join(candidates, "file_id", "left").select("doc_id", "n_words", "share", "found", F.when(F.size("found") > 0, word_array()).alias("words"))
    anchors = F.flatten(F.transform("found", lambda f: F.transform(f["anchors"], lambda a: a["word"])))
    rare = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("place"))), lambda x: F.array_contains(F.col("anchors"), x["word"]))
    cut = cut.withColumn("anchors", F.array_distinct(anchors)).withColumn("rare", rare).withColumn("templates", _templates())

    def matches(f: Column) -> Column:
        return _places(F.get("templates", f["template"]), _agreed(f["anchors"], F.col("rare")), F.col("words"))

    none = F.expr("cast(array() as array<struct<label:string,place:int,base:boolean>>)")
    places = F.when(F.size("rare") > 1, F.flatten(F.transform("found", matches))).otherwise(none)
    placed = cut.select("doc_id", "n_words", F.coalesce(places, none).alias("places"), "share")
    return placed.select("doc_id", "n_words", "places", F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)) / 2).alias("score"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("places", lambda p: p["base"])
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda p: p["label"]))), ",")
    first = F.transform(base, lambda p: p["place"])
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(first).cast("long").alias("first_word"), F.array_max(first).cast("long").alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"), "score",
    )


def _rows(values) -> str:
    """SQL rows; texts and numbers only, of ``TEMPLATES``."""
    cell = lambda x: "'" + x + "'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(cell, row)) + ")" for row in values)


def sql() -> str:
    """The same rows without the index: all template words of all texts, numbered, joined and counted."""
    keys = [(t, k, alt, at, words) for t, template in enumerate(TEMPLATES) for k, key in enumerate(template.phrases()) for alt, (at, words) in enumerate(key)]
    return f"""
WITH templates(template, label, base, slack) AS (VALUES {_rows((t, x.label, x.base, 0 if x.base else SLACK) for t, x in enumerate(TEMPLATES))}),
template_words(template, place, word) AS (VALUES {_rows((t, i, w) for t, x in enumerate(TEMPLATES) for i, w in enumerate(x.words))}),
keys(template, k, alt, off, n) AS (VALUES {_rows((t, k, alt, at, len(words)) for t, k, alt, at, words in keys)}),
key_words(template, k, alt, i, word) AS (VALUES {_rows((t, k, alt, i, w) for t, k, alt, _, words in keys for i, w in enumerate(words))}),
common(word) AS (VALUES {_rows((w,) for w in sorted(COMMON))}),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS file, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents),
w AS MATERIALIZED (
  SELECT file, word, place FROM (SELECT file, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS place FROM d) WHERE word IN (SELECT word FROM template_words)),
df AS (SELECT word, count(DISTINCT file) AS df FROM w GROUP BY word),
ranked AS (
  SELECT template, word, df, row_number() OVER (PARTITION BY template ORDER BY df, word) AS nth
  FROM (SELECT DISTINCT template, word FROM template_words) JOIN df USING (word)),
indexed AS (SELECT *, count(*) OVER (PARTITION BY template) AS n_words FROM ranked WHERE nth <= {KEPT} OR df * {RARE} <= (SELECT count(*) FROM d)),
hits AS MATERIALIZED (
  SELECT file, template, word, row_number() OVER (PARTITION BY file, template ORDER BY df, word) AS nth, count(*) OVER (PARTITION BY file, template) AS n, n_words
  FROM (SELECT DISTINCT file, word FROM w) JOIN indexed USING (word)),
shares AS (SELECT file, max(n / n_words::DOUBLE) AS share FROM hits GROUP BY file),
searched AS (SELECT file FROM w WHERE word NOT IN (SELECT word FROM common) GROUP BY file HAVING count(DISTINCT word) > 1),
starts AS (
  SELECT file, h.template, w.place - t.place AS start
  FROM (SELECT * FROM hits SEMI JOIN searched USING (file) WHERE nth <= {TOP} AND n > 1) h JOIN w USING (file, word) JOIN template_words t ON t.template = h.template AND t.word = w.word
  GROUP BY ALL HAVING count(DISTINCT w.word) > 1),
stands AS (
  SELECT file, template, k, alt, w.place - i AS place FROM w JOIN key_words USING (word) JOIN keys USING (template, k, alt) GROUP BY file, template, k, alt, w.place - i, n HAVING count(*) = n),
found AS (
  SELECT s.file, s.template, s.start, k, min((alt, greatest(0, p.place - off))) AS best
  FROM starts s JOIN templates USING (template) JOIN keys USING (template) JOIN stands p USING (file, template, k, alt)
  WHERE (NOT base OR start >= 0) AND p.place BETWEEN greatest(0, start + off - slack) AND greatest(0, start + off + slack)
  GROUP BY ALL),
sure AS (
  SELECT file, template, min(best[2]) FILTER (k = 0) AS place FROM found GROUP BY file, template, start
  HAVING count(*) = (SELECT count(DISTINCT keys.k) FROM keys WHERE keys.template = found.template)),
places AS (SELECT DISTINCT file, label, base, template, place FROM sure JOIN templates USING (template)),
by_file AS (
  SELECT file, count(*) FILTER (base) AS n_base, min(place) FILTER (base) AS first_word, max(place) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM places GROUP BY file)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CASE WHEN labels IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) / 2 END AS score
FROM d LEFT JOIN by_file USING (file) LEFT JOIN shares USING (file)
"""


SQL = sql()
