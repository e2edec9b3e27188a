"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule rejects a document by what is counted in it. The verdict is the same in any order, so the order is free: on
a bounded sample (SAMPLE documents, about, chosen by hash) the share that each rule rejects is counted, and its cost is
estimated from the sample's own characters, words and lines by the passes that the rule makes over them (`work`).
Rules are ordered one by one: next comes the rule with the most rejections per cost among the sample's documents that no
earlier rule rejects. The estimate is made of whole numbers in one job, so reruns agree. A rule is evaluated only for
documents that all earlier ones let pass (CASE stops at the first branch that holds).

quality() returns five counts whatever the verdict, so rules on these cost nothing there and what the cascade spares
are the rules on the text; quality_filter() returns no counts, and every rule is evaluated only when it is reached.

Defined cases: a null text has no words and fails; documents without words fail the shortest-text rule; repeated
rows are judged alike; very long texts are judged whole, as arrays of their words within one row (a text has to fit a
row's 2 GB); rules with equal rejections per cost come in order of their names; an empty table gives no rows, and its
rules come in order of their names; further columns are kept by quality_filter() and ignored by quality().
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import SPACE, let, words_of

#: Documents on which costs and selectivities are estimated, about.
SAMPLE = 1000
LEAST_WORDS, MOST_REPEATED, MOST_SYMBOLS, MOST_DUP_LINES = 50, 0.5, 0.25, 0.3
LEAST_WORD_CHARS, MOST_WORD_CHARS = 2, 20
MOST_DIGITS, MOST_BULLETS, MOST_ELLIPSES = 0.9, 0.9, 0.3
BULLET, ELLIPSIS = rf"\A[{SPACE}]*[-*\u2022]", rf"(\.\.\.|\u2026)[{SPACE}]*\z"


def word_chars(text: Column) -> Column:
    """Code points in words."""
    return F.length(F.regexp_replace(text, rf"[{SPACE}]+", "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long")


def n_digits(text: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, "[0-9]+", ""))).cast("long")


def n_like(lines: Column, pattern: str) -> Column:
    return F.size(F.filter(lines, lambda x: x.rlike(pattern))).cast("long")


def word_lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(rf"[^{SPACE}]"))


def n_dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def trigrams(words: Column) -> Column:
    """64-bit hashes of the 3-word windows, in order; empty below three words."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n >= 3, hashes).otherwise(F.array().cast("array<bigint>"))


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that stand twice or more: equal hashes stand side by side once they are sorted."""

    def of_pairs(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda x, i: (x["h"] == F.get(pairs, i - 1)["h"]) | (x["h"] == F.get(pairs, i + 1)["h"]))
        return _union_of(F.sort_array(F.transform(twice, lambda x: x["i"])))

    def of_grams(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(grams) == F.size(F.array_distinct(grams)), F.lit(0)).otherwise(let(pairs, of_pairs))

    return let(let(words, trigrams), of_grams).cast("long")


def _union_of(places: Column) -> Column:
    """Words covered by windows of three at sorted places; a window adds the words after the last one's end."""
    steps = F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("end")), lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p + 3 - acc["end"])).cast("int").alias("n"), (p + 3).cast("int").alias("end")))
    return steps["n"]


def _counted(docs: DataFrame) -> DataFrame:
    """doc_id, text, its lines and the counts of every document, whole texts."""
    step = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    step = step.withColumns({"words": words_of(F.col("text")), "lines": word_lines(F.col("text"))})
    return step.select("doc_id", "text", "lines", F.size("words").cast("long").alias("n_words"), word_chars(F.col("text")).alias("word_chars"), n_symbols(F.col("text")).alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"), n_dup_lines(F.col("lines")).alias("n_dup_lines"), repeat_words(F.col("words")).alias("n_repeat_words"))


#: What rules share; each is made once, when the first rule that needs it is reached.
PARTS = {"words": words_of, "lines": word_lines}
Parts = dict[str, Column]


@dataclass(frozen=True)
class Rule:
    """rejects: the condition, of the text and the PARTS that it needs; on_counts: the same where the counts are there.

    work, work_on_counts: what they cost for a document of so many characters, words and lines, in passes over a
    character.
    """

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Parts], Column]
    work: Callable[[Column, Column, Column], Column]
    on_counts: Column
    work_on_counts: Callable[[Column, Column, Column], Column] = lambda chars, words, lines: F.lit(1)


def rules() -> list[Rule]:
    """The rules. Weights of `work` are fixed: regular expressions count 1 for each pass over the text, an array's element
    8, a hash of a window 12, and sorting n windows n * log2(n) * 2."""
    c = F.col
    few = lambda n: n < LEAST_WORDS
    letters = lambda n, chars: (chars < LEAST_WORD_CHARS * n) | (chars > MOST_WORD_CHARS * n)
    symbols = lambda n, k: k > MOST_SYMBOLS * n
    like = lambda lines, pattern, most: n_like(lines, pattern) > most * F.size(lines)
    splitting = lambda chars, words, lines: 2 * chars + 8 * words
    by_lines = lambda chars, words, lines: 2 * chars + 8 * lines
    return [
        Rule("few_words", ("words",), lambda p: few(F.size(p["words"])), splitting, few(c("n_words"))),
        Rule("word_length", ("words",), lambda p: letters(F.size(p["words"]), word_chars(p["text"])), lambda x, w, n: splitting(x, w, n) + x, letters(c("n_words"), c("word_chars"))),
        Rule("symbols", ("words",), lambda p: symbols(F.size(p["words"]), n_symbols(p["text"])), lambda x, w, n: splitting(x, w, n) + x, symbols(c("n_words"), c("n_symbols"))),
        Rule("dup_lines", ("lines",), lambda p: n_dup_lines(p["lines"]) > MOST_DUP_LINES * F.size(p["lines"]), by_lines, c("n_dup_lines") > MOST_DUP_LINES * c("n_lines")),
        Rule("repeated_words", ("words",), lambda p: repeat_words(p["words"]) > MOST_REPEATED * F.size(p["words"]), lambda x, w, n: splitting(x, w, n) + 12 * w + 2 * w * F.log2(w + 2), c("n_repeat_words") > MOST_REPEATED * c("n_words")),
        Rule("digits", (), lambda p: n_digits(p["text"]) > MOST_DIGITS * word_chars(p["text"]), lambda x, w, n: 2 * x, n_digits(c("text")) > MOST_DIGITS * c("word_chars"), lambda x, w, n: x),
        Rule("bullets", ("lines",), lambda p: like(p["lines"], BULLET, MOST_BULLETS), lambda x, w, n: by_lines(x, w, n) + 4 * n, like(c("lines"), BULLET, MOST_BULLETS), lambda x, w, n: 4 * n),
        Rule("ellipses", ("lines",), lambda p: like(p["lines"], ELLIPSIS, MOST_ELLIPSES), by_lines, like(c("lines"), ELLIPSIS, MOST_ELLIPSES), lambda x, w, n: x),
    ]


def ordered_rules(docs: DataFrame, given: bool, found: list[Rule] | None = None) -> list[Rule]:
    """The rules by rejections per cost, estimated on the sample. given: are the counts there?

    The sample isn't gathered: the driver gets a row for each combination of verdicts that occurs in it, 2 to the number
    of rules at most.
    """
    found = sorted(found or rules(), key=lambda r: r.name)
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sample = slim.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(max(1, docs.count() // SAMPLE))) == 0)
    text = F.coalesce(F.col("text"), F.lit(""))
    sample = sample.select(text.alias("text"), words_of(text).alias("words"), word_lines(text).alias("lines"))
    parts = {k: F.col(k) for k in ("text", "words", "lines")}
    size = [F.length("text"), F.size("words"), F.size("lines")]
    work = [(r.work_on_counts if given else r.work)(*size).cast("long").alias(f"work{i}") for i, r in enumerate(found)]
    judged = sample.select(*[r.rejects(parts).alias(f"hit{i}") for i, r in enumerate(found)], *work)
    rows = judged.groupBy(*[f"hit{i}" for i in range(len(found))]).agg(F.count("*").alias("n"), *[F.sum(f"work{i}").alias(f"work{i}") for i in range(len(found))]).collect()
    return [found[i] for i in cascade_order(rows, len(found))]


def cascade_order(rows: list, k: int) -> list[int]:
    """Rules 0 to k - 1, next always the one with the most rejections per cost among the rows that are left.

    A row has hit0, hit1 ... (is it rejected?), n (documents) and work0, work1 ... (their cost, in all).
    """
    order: list[int] = []
    while len(order) < k:
        open_ = [i for i in range(k) if i not in order]
        rate = {i: sum(r["n"] for r in rows if r[f"hit{i}"]) / max(1, sum(r[f"work{i}"] for r in rows)) for i in open_}
        order.append(min(open_, key=lambda i: (-rate[i], i)))
        rows = [r for r in rows if not r[f"hit{order[-1]}"]]
    return order


def cascade(order: list[Rule], parts: Parts) -> Column:
    """The name of the first rule that rejects, else null; what comes after it is not evaluated."""
    if not order:
        return F.lit(None).cast("string")
    rule, missing = order[0], [k for k in order[0].needs if k not in parts]
    if missing:
        return let(PARTS[missing[0]](parts["text"]), lambda x: cascade(order, parts | {missing[0]: x}))
    return F.when(rule.rejects(parts), F.lit(rule.name)).otherwise(cascade(order[1:], parts))


def quality(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, failed_rule (the first in the cascade's order; null if kept)."""
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    first = F.lit(None).cast("string")
    for rule in reversed(ordered_rules(docs, given=True)):
        first = F.when(rule.on_counts, F.lit(rule.name)).otherwise(first)
    judged = _counted(docs).withColumns({"base_failed": base, "failed_rule": first})
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("failed_rule").isNull()).alias("kept"), "failed_rule")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that every rule lets pass, with all their columns.

    A rule is evaluated only if all earlier ones let the document pass.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.where(cascade(ordered_rules(docs, given=False), {"text": text}).isNull())


def oracle() -> str:
    """The same by brute force, in DuckDB SQL."""
    word = rf"[^{SPACE}]+"
    bullet, ellipsis = (p.replace("\\u2022", "\u2022").replace("\\u2026", "\u2026") for p in (BULLET, ELLIPSIS))
    return f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS words FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM w),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM w, unnest(range(1, len(words) - 1)) AS u(i)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
rw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
c AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(regexp_extract_all(text, '[0-9]')) AS n_digits,
  len(list_filter(lines, lambda x: regexp_matches(x, '{bullet}'))) AS n_bullets, len(list_filter(lines, lambda x: regexp_matches(x, '{ellipsis}'))) AS n_ellipses, CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words
  FROM w JOIN l ON l.doc_id = w.doc_id LEFT JOIN rw ON rw.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_words >= {LEAST_WORDS} AND word_chars BETWEEN {LEAST_WORD_CHARS} * n_words AND {MOST_WORD_CHARS} * n_words AND n_symbols <= {MOST_SYMBOLS} * n_words
  AND n_dup_lines <= {MOST_DUP_LINES} * n_lines AND n_digits <= {MOST_DIGITS} * word_chars AND n_bullets <= {MOST_BULLETS} * n_lines AND n_ellipses <= {MOST_ELLIPSES} * n_lines AND n_repeat_words <= {MOST_REPEATED} * n_words AS kept
FROM c
"""
