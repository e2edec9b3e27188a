"""Small document tables that hold the awkward cases."""

import random

from pyspark.sql import Row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words long, chunk string, size double"


def frame(spark, texts, sources=None):
    """texts: list of (doc_id, text); further columns have names that operators might use themselves."""
    rows = [Row(doc_id=i, text=t, lang="en", source=sources[k] if sources else f"s{k % 3}", n_chars=None, words=k, chunk="x", size=0.5) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" + ("." if r.random() < 0.1 else "") for _ in range(n)]


def awkward(seed=1):
    """(doc_id, text): copies, shared passages, own repeats, empty, null, odd white space, other scripts, NULs."""
    r = random.Random(seed)
    shared = [" ".join(prose(100 + k, 45)) for k in range(3)]
    out = [(5, None), (3, ""), (4, " \t\n "), (8, "one"), (9, "a b"), (2, "été 東京 ö x y 😀 " * 12), (30, "\x00" * 80), (31, "a" + "\x00" * 80 + "b"), (32, "abab" * 40)]
    for k in range(12):
        words = prose(k, 120)
        words[30:30] = shared[k % 3].split()
        if k % 4 == 0:
            words += words[10:60]
        out.append((100 - 3 * k, r.choice([" ", "\n", "  "]).join(words)))
    out += [(200, out[-1][1]), (1, out[-2][1]), (7, " ".join(["same"] * 90)), (6, " ".join(["same"] * 41))]
    return out
