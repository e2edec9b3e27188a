"""Secret scans: fixed patterns and a randomness test battery, in DataFrame functions only.

Patterns give the base spans. The method adds spans of kind `random`: runs of 20 or more key characters that no
pattern needs to name. For each run the encoding is inferred (the smallest alphabet of ALPHABETS that holds all its
characters; hexadecimal digits may stand in groups, divided by dashes, which are not counted) and the battery asks
whether it looks like random output of that encoding:

* chi-squared uniformity of its characters over the alphabet, standardised by the statistic's exact mean and
  variance for the run's length, so that short runs are judged fairly;
* a runs test about the alphabet's middle;
* the serial correlation of neighbouring characters, and the uniformity of the steps between them (modulo the
  alphabet's size), which shows counters and repeated patterns.

A run that any test rejects (two-sided, LEVEL each) is not random, nor is one that no single encoding holds. What is left
is put to false-discovery control. A run's evidence against "ordinary text" is the likelihood of the mixture of all
encodings, each with weight 1 / their number, divided by that of independent characters of TEXT_PER_MILLE (shares that
are divided by their sum, so they are probabilities); it grows with the run's length. Its expectation under ordinary text
is 1 at most, whichever encoding a run fits, so it is an e-value; the smallest alphabet's term alone is counted, which is
less. Over all runs of the corpus the step-up rule keeps the k strongest with evidence of at least m / (FDR * k). Counts
by whole nats of evidence are all that is gathered, so the driver sees a table of bounded size.

Offsets are code points, ends exclusive. Places are running sums over a text's matches, taken in two levels, and pieces
of a text are cut from blocks of it, so the work on a text follows its length however many spans it has.

Defined cases: a null text is empty; very long texts are scanned whole within their row; spans that start at one place
are listed by kind; repeated rows are judged alike (and counted); an empty table gives no rows; further columns are
ignored by secret_scan() and kept by redacted().
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import column, let, materialise, whole_row

ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX, RUN = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}", r"[A-Za-z0-9+/_-]{20,}"
KINDS = ["assign", "access", "hex", "random"]
#: Encodings by the pattern of their alphabet, the smallest first, and the alphabet's order.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_WORDS = DIGITS + UPPER + LOWER
ALPHABETS = [("[0-9]+", DIGITS), ("[0-9a-f]+", DIGITS + "abcdef"), ("[0-9A-F]+", DIGITS + "ABCDEF"), ("[0-9a-f]+(?:-[0-9a-f]+)+", DIGITS + "abcdef"), ("[0-9A-F]+(?:-[0-9A-F]+)+", DIGITS + "ABCDEF"), ("[A-Z2-7]+", UPPER + "234567"), ("[0-9a-z]+", DIGITS + LOWER), ("[0-9A-Z]+", DIGITS + UPPER), ("[0-9A-Za-z]+", _WORDS), ("[0-9A-Za-z+/]+", _WORDS + "+/"), ("[0-9A-Za-z_-]+", _WORDS + "-_")]
LEVEL, FDR = 0.001, 0.01
#: How often a character stands in ordinary words of western languages, per thousand.
TEXT_PER_MILLE = {"e": 140, "n": 85, "i": 75, "a": 75, "t": 75, "s": 70, "r": 70, "o": 60, "d": 40, "l": 40, "h": 40, "u": 40, "c": 30, "m": 25, "g": 25, "p": 20, "b": 18, "f": 18, "w": 15, "k": 10, "y": 10, "v": 10, "z": 8}
OTHER_PER_MILLE = 1.5
#: The sum of all shares, by which they are divided: key characters are the alphabets' 66.
TEXT_SUM = sum(TEXT_PER_MILLE.values()) + OTHER_PER_MILLE * (66 - len(TEXT_PER_MILLE))


#: Elements of a block of a running sum; code points of a block of a text.
STEP, BLOCK = 256, 4096


def running(items: Column, join: Callable[[Column, Column], Column], value: Callable[[Column], Column], out: Callable[[Column, Column], Column], kind: str) -> Column:
    """out(before, item) of each item, of type `kind`; before: the values of earlier items, joined, from 0.

    Arrays can only grow by copies, so blocks of STEP items are worked off by themselves, each from the joined value of
    all blocks before it.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / STEP).cast("int")), lambda i: F.slice(items, i * STEP + 1, F.lit(STEP)))
    whole = lambda block: F.aggregate(block, F.lit(0), lambda s, x: join(s, value(x)))

    def of(blocks: Column) -> Column:
        none = F.array().cast("array<int>")
        starts = F.aggregate(F.transform(blocks, whole), F.struct(F.lit(0).alias("at"), none.alias("out")), lambda s, t: F.struct(join(s["at"], t).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(blocks, starts, lambda block, start: F.aggregate(block, F.struct(start.alias("at"), F.array().cast(f"array<{kind}>").alias("out")), lambda s, x: F.struct(join(s["at"], value(x)).alias("at"), F.concat(s["out"], F.array(out(s["at"], x))).alias("out")))["out"]))

    return F.when(F.size(items) > 0, let(blocks, of)).otherwise(F.array().cast(f"array<{kind}>"))


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    """(start, end, part) of the leftmost non-overlapping matches, in order; part: the text of the group."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    every = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    parts = F.arrays_zip(gaps.alias("gap"), F.transform(every(0), lambda x: F.length(x)).alias("own"), every(group).alias("part"))
    parts = F.filter(parts, lambda x: x["own"].isNotNull())
    span = lambda at, x: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["own"]).alias("end"), x["part"].alias("part"))
    kind = "struct<start:int,end:int,part:string>"
    return F.when(text.rlike(pattern), let(parts, lambda p: running(p, lambda a, b: a + b, lambda x: x["gap"] + x["own"], span, kind))).otherwise(F.array().cast(f"array<{kind}>"))


def _normal_tail(z: Column) -> Column:
    """Two-sided tail of a standard normal, by its logistic approximation (error below 0.0002)."""
    a = F.abs(z)
    return 2 / (1 + F.exp(F.least(1.5976 * a + 0.070565992 * a * a * a, F.lit(700.0))))


def _tested(run: Column) -> Column:
    """(random, evidence) of a run of key characters: does the battery let it pass; nats against ordinary text."""
    alphabet = F.coalesce(*[F.when(run.rlike(f"\\A(?:{p})\\z"), F.lit(a)) for p, a in ALPHABETS])
    places = lambda own: F.filter(F.transform(F.split(run, ""), lambda c: F.instr(own, c).cast("double")), lambda v: v > 0)
    known = let(alphabet, lambda own: F.struct(F.length(own).cast("double").alias("k"), places(own).alias("values")))
    no = F.struct(F.lit(False).alias("random"), F.lit(0.0).alias("evidence"))
    return F.when(alphabet.isNotNull(), let(known, lambda x: _battery(run, x["k"], x["values"]))).otherwise(no)


def _pairs(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Sum of step(a value, the next one)."""
    walk = F.aggregate(values, F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("sum")), lambda acc, v: F.struct(v.alias("last"), (acc["sum"] + F.coalesce(step(acc["last"], v), F.lit(0.0))).alias("sum")))
    return walk["sum"]


def _uniform(values: Column, k: Column) -> Column:
    """The chi-squared statistic of values over k equally likely ones, less its mean, by its deviation."""
    n = F.size(values).cast("double")
    # sum of squared counts: equal values stand side by side once they are sorted
    squares = F.aggregate(
        F.sort_array(values),
        F.struct(F.lit(-1.0).alias("v"), F.lit(0.0).alias("c"), F.lit(0.0).alias("sum")),
        lambda acc, v: let(F.when(v == acc["v"], acc["c"] + 1).otherwise(F.lit(1.0)), lambda c: F.struct(v.alias("v"), c.alias("c"), (acc["sum"] + 2 * c - 1).alias("sum"))),
    )["sum"]
    return (squares * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))


def _battery(run: Column, k: Column, values: Column) -> Column:
    n = F.size(values).cast("double")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    steps = F.zip_with(F.slice(values, F.lit(2), F.size(values) - 1), F.slice(values, F.lit(1), F.size(values) - 1), lambda b, a: F.pmod(b - a, k))
    high = F.transform(values, lambda v: (v > k / 2).cast("double"))
    sums = F.struct(total(high).alias("ones"), (_pairs(high, lambda a, b: (a != b).cast("double")) + 1).alias("turns"), (total(values) / n).alias("middle"))

    def tails(x: Column) -> Column:
        mean = 2 * x["ones"] * (n - x["ones"]) / n + 1
        spread = F.sqrt(F.greatest(F.lit(0.0), (mean - 1) * (mean - 2) / (n - 1)))
        runs = F.when(spread > 0, (x["turns"] - mean) / F.when(spread > 0, spread)).otherwise(F.lit(9.0))
        power = total(F.transform(values, lambda v: (v - x["middle"]) * (v - x["middle"])))
        product = _pairs(values, lambda a, b: (a - x["middle"]) * (b - x["middle"]))
        serial = F.when(power > 0, product / F.when(power > 0, power) * F.sqrt(n)).otherwise(F.lit(9.0))
        return F.array(*[let(z, _normal_tail) for z in (_uniform(values, k), runs, serial, _uniform(steps, k))])

    passes = F.array_min(let(sums, tails)) >= LEVEL
    common = F.lit(0.0)
    for c, share in TEXT_PER_MILLE.items():
        common = common + (F.length(run) - F.length(F.replace(run, F.lit(c), F.lit("")))) * math.log(share / OTHER_PER_MILLE)
    evidence = -(n * math.log(OTHER_PER_MILLE / TEXT_SUM) + common) - n * F.log(k) - math.log(len(ALPHABETS))
    return F.struct(passes.alias("random"), evidence.alias("evidence"))


def _threshold(runs: DataFrame) -> float:
    """Evidence from which runs are kept. runs: a row for each, with random and evidence."""
    bins = runs.groupBy(F.when(F.col("random"), F.greatest(F.lit(-1), F.least(F.lit(2000), F.floor("evidence").cast("int")))).otherwise(F.lit(-1)).alias("nats")).agg(F.count("*").alias("n"))
    count = {r["nats"]: r["n"] for r in bins.collect()}
    total, above, best = sum(count.values()), 0, math.inf
    for nats in sorted(count, reverse=True):
        above += count[nats]
        if nats >= 0 and nats >= math.log(total / (FDR * above)):
            best = float(nats)
    return best


def _scanned(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """keep, the base spans by kind, and the runs with their tests."""
    step = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    text = F.col("_text")
    step = step.withColumns({"_assign": _found(text, ASSIGN, 2), "_access": _found(text, ACCESS), "_hex": _found(text, HEX), "_runs": _found(text, RUN)})
    step = step.withColumn("_assign", F.filter("_assign", lambda x: F.length(x["part"]) >= 6))
    test = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), let(x["part"], _tested).alias("test"))
    return step.withColumn("_runs", F.transform("_runs", test))


def _listed(spans: list[tuple[str, Column]]) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    ranked = lambda k: lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"))
    every = F.concat(*[F.transform(c, ranked(KINDS.index(kind))) for kind, c in spans])
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(every), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def _kept_runs(least: float) -> Column:
    return F.filter("_runs", lambda x: x["test"]["random"] & (x["test"]["evidence"] >= F.lit(least)))


def secret_scan(docs: DataFrame) -> DataFrame:
    """Secrets of every document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    found = materialise(_scanned(docs, [F.col("doc_id")]).drop("_text"), "secrets")
    least = _threshold(found.select(F.explode("_runs.test").alias("t")).select("t.*"))
    base = [(k, F.col(f"_{k}")) for k in KINDS[:3]]
    size = lambda c: F.size(c).cast("long")
    found = found.withColumn("_random", _kept_runs(least))
    return found.select("doc_id", size("_assign").alias("n_assign"), size("_access").alias("n_access"), size("_hex").alias("n_hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed([*base, ("random", F.col("_random"))]).alias("spans"), size("_random").alias("n_random"))


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """Code points start to end of the text that the blocks make up."""
    of = lambda x: F.floor(x / BLOCK).cast("int")
    within = lambda x: F.pmod(x, F.lit(BLOCK))
    block = lambda x: F.coalesce(F.get(blocks, of(x)), F.lit(""))
    parts = F.concat(F.substring(block(start), within(start) + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, of(start) + 2, of(end) - of(start) - 1), ""), F.substring(block(end), F.lit(1), within(end)))
    return F.when(of(start) == of(end), F.substring(block(start), within(start) + 1, end - start)).otherwise(parts)


def _marked(text: Column, spans: Column, mark: str) -> Column:
    """text with a mark for each of the sorted spans; those that overlap have one mark."""
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))
    gaps = running(spans, lambda a, b: F.greatest(a, b), lambda x: x["end"], lambda at, x: F.struct(at.alias("start"), x["start"].alias("end")), "struct<start:int,end:int>")
    kept = lambda b: F.transform(F.filter(gaps, lambda x: x["start"] <= x["end"]), lambda x: F.concat(_between(b, x["start"], x["end"]), F.lit(mark)))
    last = lambda b: _between(b, F.array_max(F.transform(spans, lambda x: x["end"])), F.length(text))
    return let(blocks, lambda b: F.concat(F.array_join(kept(b), ""), last(b)))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every secret replaced by a mark, with all their columns; overlapping spans become one mark."""
    found = materialise(_scanned(docs, [whole_row(docs).alias("_row")]).drop("_text"), "secrets")
    least = _threshold(found.select(F.explode("_runs.test").alias("t")).select("t.*"))
    step = found.withColumn("_random", _kept_runs(least))
    plain = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    step = step.withColumn("_spans", F.sort_array(F.concat(*[plain(f"_{k}") for k in KINDS])))
    text = F.col("_row")["text"].cast("string")
    own = F.when(F.size("_spans") > 0, _marked(text, F.col("_spans"), mark)).otherwise(text)
    return step.select("_row.*", own.alias("_new")).select(*[F.col("_new").alias(c) if c == "text" else column(c) for c in docs.columns])
