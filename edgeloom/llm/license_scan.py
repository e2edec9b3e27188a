"""License scans by an exact set-similarity join of text blocks with notice templates, in DataFrame functions only.

A block is a window of consecutive words, a quarter longer than the template it is held against (the whole text, if that
is shorter), at any place of the text, whatever its lines are; it counts as the set of its words. It meets a template if
it holds THRESHOLD of the template's words or more, and the words that tell the template's license from others
(`needed`) among them. Tokens have one global order, the rarest in the corpus first (counted over all documents). With
`need` words required of a template's `m`:

* prefix filter: a block without any of the template's first m - need + 1 tokens can't meet it. The templates are indexed
  by these tokens; only windows that hold a token of the index at its own templates are looked at;
* length filter: nor can one if fewer than `need` of the template's words stand within reach of that token;
* positional filter: if the first shared token is the template's k-th and the block's l-th, at most
  min(m - k, block - l) words can be shared (k, l from 0, in the global order of the templates' vocabulary);
* the rest is verified by the exact intersection.

The templates are a fixed list, so their index is part of the plan: no row leaves its task, and no block meets
another block. Base phrases are found beside it and stay.

Defined cases: a null text is empty; very long texts are scanned whole within their row, and the work beyond one pass
follows the number of index tokens in them; windows with equal shares give one score; labels that several templates give
are listed once; repeated rows are judged alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import let, lower_ascii

#: What separates words: all ASCII but digits and letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
THRESHOLD = 0.8

#: Sentences of the notices of common public licenses, and the words that tell them apart.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0", "apache"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "contributors"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc nc"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "commons noncommercial"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu general"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "fee"),
    ("lgpl", "this library is licensed under the gnu lesser general public license version 2 1", "lesser"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "granted sublicense"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
]


def need(size: int) -> int:
    """Words that a block has to share with a template of so many."""
    return math.ceil(THRESHOLD * size - 1e-9)


def width(template: str) -> int:
    """Words of a template's blocks."""
    return -(-5 * len(template.split()) // 4)


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def token_order(docs: DataFrame) -> list[str]:
    """The templates' words, the rarest in the corpus first. The list is as long as the templates' vocabulary."""
    vocabulary = sorted({w for _, t, _ in TEMPLATES for w in t.split()})
    words = docs.select(F.explode(F.split(lower_ascii(F.col("text").cast("string")), GAP)).alias("w"))
    count = {r["w"]: r["n"] for r in words.where(F.col("w").isin(vocabulary)).groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def _shared(block: Column, template: list[str], needed: list[str]) -> Column:
    """Words that a block shares with a template, 0 if they are too few or lack a needed one.

    block: its template words, in the global order, as template is.
    """
    least = need(len(template))
    prefix = template[: len(template) - least + 1]
    first = F.get(F.array_intersect(_strings(prefix), block), F.lit(0))
    k, at = F.array_position(_strings(template), first) - 1, F.array_position(block, first) - 1
    possible = F.least(len(template) - k, F.size(block) - at)
    exact = F.size(F.array_intersect(_strings(template), block))
    told = F.size(F.array_intersect(_strings(needed), block)) == len(needed) if needed else F.lit(True)
    return F.when((F.size(block) >= least) & first.isNotNull() & (possible >= least) & told, exact).otherwise(0)


def _best(words: Column, hits: Column, number: int, template: list[str], needed: list[str], span: int, order: list[str]) -> Column:
    """The most words of a template that a block of `span` words shares with it, null below its need.

    hits: (at, of) of each index token, of: the templates that it is in the index for.
    """
    n = F.size(words)
    near = lambda at: F.slice(words, F.greatest(F.lit(0), at - span + 1) + 1, F.lit(2 * span - 1))
    own = F.filter(hits, lambda h: F.array_contains(h["of"], number) & (F.size(F.array_intersect(_strings(template), near(h["at"]))) >= need(len(template))))
    starts = F.array_distinct(F.flatten(F.transform(own, lambda h: F.sequence(F.greatest(F.lit(0), h["at"] - span + 1), F.least(h["at"], F.greatest(F.lit(0), n - span))))))
    block = lambda s: F.array_intersect(_strings(order), F.slice(words, s + 1, F.lit(span)))
    best = F.array_max(F.transform(starts, lambda s: let(block(s), lambda b: _shared(b, template, needed))))
    return F.when(F.size(hits) > 0, F.when(best >= need(len(template)), best))


def _stands(parts: list[str]) -> Callable[[Column], Column]:
    """Do these words stand from word i on?"""
    return lambda i: reduce(lambda a, b: a & b, [F.coalesce(F.get(F.col("words"), i + k) == w, F.lit(False)) for k, w in enumerate(parts)])


def license_scan(docs: DataFrame) -> DataFrame:
    """Licenses that each document names: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: the largest share of a template that one block holds, if it meets the template, else 0.
    """
    order = token_order(docs)
    rank = {w: i for i, w in enumerate(order)}
    templates = [(label, sorted(set(t.split()), key=rank.__getitem__), needed.split(), width(t)) for label, t, needed in TEMPLATES]
    index: dict[str, list[int]] = {}
    for i, (_, t, _, _) in enumerate(templates):
        for w in t[: len(t) - need(len(t)) + 1]:
            index.setdefault(w, []).append(i)

    step = docs.select("doc_id", lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    step = step.select("doc_id", F.trim(F.regexp_replace("text", GAP, " ")).alias("norm"))
    step = step.withColumn("words", F.split("norm", " "))
    table = F.create_map(*[x for w, of in sorted(index.items()) for x in (F.lit(w), F.array(*[F.lit(i) for i in of]))])
    none = F.array().cast("array<struct<at:int,of:array<int>>>")
    marked = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), F.try_element_at(table, w).alias("of"))), lambda h: h["of"].isNotNull())
    step = step.withColumn("hits", F.when(F.arrays_overlap("words", _strings(sorted(index))), marked).otherwise(none))
    for i, (_, t, needed, span) in enumerate(templates):
        step = step.withColumn(f"share{i}", _best(F.col("words"), F.col("hits"), i, t, needed, span, order) / F.lit(float(len(t))))

    padded = F.concat(F.lit(" "), F.col("norm"), F.lit(" "))
    named = reduce(lambda a, b: a | b, [padded.contains(f" {p} ") for p, _ in PHRASES])
    step = step.withColumn("named", named)
    for phrase, label in PHRASES:
        step = step.withColumn(f"at_{label}", F.when(F.col("named"), F.filter(F.sequence(F.lit(0), F.size("words") - 1), _stands(phrase.split()))).otherwise(F.array().cast("array<int>")))
    places = F.concat(*[f"at_{label}" for _, label in PHRASES])
    base = F.array_compact(F.array(*[F.when(F.size(f"at_{label}") > 0, label) for _, label in PHRASES]))
    more = F.array_compact(F.array(*[F.when(F.col(f"share{i}").isNotNull(), label) for i, (label, *_) in enumerate(templates)]))
    return step.select(
        "doc_id",
        F.when(F.col("norm") == "", 0).otherwise(F.size("words")).cast("long").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"),
        F.coalesce(F.greatest(*[f"share{i}" for i in range(len(templates))]), F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """The same by brute force, in DuckDB SQL: every block of every document that holds enough of a template's words at
    all."""
    rows = ", ".join(f"('{label}', {sorted(set(t.split()))}, {needed.split()}::VARCHAR[], {need(len(set(t.split())))}, {width(t)})" for label, t, needed in TEMPLATES)
    base = " UNION ALL ".join("SELECT doc_id, i - 1 AS place, '{l}' AS label FROM w, unnest(range(1, len(words) + 1)) AS u(i) WHERE {c}".format(l=label, c=" AND ".join(f"words[i + {k}] = '{p}'" for k, p in enumerate(phrase.split()))) for phrase, label in PHRASES)
    return f"""
WITH t(label, tokens, needed, need, width) AS (VALUES {rows}),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
c AS (SELECT doc_id, words, label, tokens, needed, need, width FROM w, t WHERE len(list_intersect(list_distinct(words), tokens)) >= need),
b AS (SELECT doc_id, label, tokens, needed, need, list_distinct(words[i:i + width - 1]) AS block FROM c, unnest(range(1, greatest(1, len(words) - width + 1) + 1)) AS u(i)),
m AS (SELECT doc_id, label, len(list_intersect(block, tokens)) AS n, len(tokens) AS size FROM b WHERE len(list_intersect(block, tokens)) >= need AND list_has_all(block, needed)),
p AS ({base}),
pd AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id),
md AS (SELECT doc_id, max(n / CAST(size AS DOUBLE)) AS score FROM m GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM p UNION SELECT doc_id, label FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM w LEFT JOIN pd ON pd.doc_id = w.doc_id LEFT JOIN md ON md.doc_id = w.doc_id LEFT JOIN al ON al.doc_id = w.doc_id
"""
