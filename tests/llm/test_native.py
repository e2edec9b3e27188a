"""Operators of DataFrame functions against brute force in Python."""

import hashlib
import math
import random
import re
import string
import textwrap
import uuid
from collections import Counter, defaultdict

import pytest
from cases import awkward, empty, frame, prose

from edgeloom.llm import quality_rules as QR
from edgeloom.llm import secret_scan as SS
from edgeloom.llm.license_scan import PHRASES, TEMPLATES, license_scan, need, width
from edgeloom.llm.quality_rules import quality, quality_filter
from edgeloom.llm.secret_scan import ALPHABETS, redacted, secret_scan
from edgeloom.llm.source_mix import mix, mixed_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def licensed():
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    return [
        (1, "Some text.\nReleased under the MIT License.\nMIT-License, apache license"),
        (2, "licensed under CC BY-NC 4.0."),
        (3, mit + " and more"),
        (4, " ".join(mit.split()[:-6])),
        (5, "the software is granted free to any person"),
        (6, "GNU GENERAL PUBLIC LICENSE general public license"),
        (7, "released under\nthe mit\nlicense"),
        (9, "x\nReleased under the MİT License"),
        (10, "The book was released under the imprint of the MIT Press"),
        (11, "Released under the MIT imprint"),
        *[(20 + i, "Header\n\n" + textwrap.fill(FULL[k], 78 if i % 2 else 40, initial_indent=" * ", subsequent_indent=" * ") + "\nint main() {}") for i, k in enumerate(["mit", "mit", "bsd", "bsd", "gpl", "gpl", "apache", "isc"])],
        (40, " ".join(prose(1, 300)) + "\n" + FULL["mpl"] + "\n" + " ".join(prose(2, 300))),
    ]


FULL = {
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one.",
}


def words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return low, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_license_scan(spark):
    texts = licensed() + [(d + 1000, t) for d, t in awkward()]
    got = {r.doc_id: r for r in license_scan(frame(spark, texts)).collect()}
    for doc, text in texts:
        low, ws = words(text)
        at, labels, score = [], set(), 0.0
        for phrase, label in PHRASES:
            p = phrase.split()
            own = [i for i in range(len(ws)) if ws[i : i + len(p)] == p]
            at += own
            labels |= {label} if own else set()
        base = ",".join(sorted(labels))
        for label, t, needed in TEMPLATES:
            own, span = set(t.split()), width(t)
            for i in range(max(1, len(ws) - span + 1)):
                block = set(ws[i : i + span])
                n = len(block & own)
                if n >= need(len(own)) and set(needed.split()) <= block:
                    labels.add(label)
                    score = max(score, n / len(own))
        r = got[doc]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (len(ws), len(at), min(at, default=None), max(at, default=None), base, ",".join(sorted(labels)), pytest.approx(score)), doc
    assert got[2].labels == "cc-by-nc" and got[3].labels == "mit" and got[5].labels == "" and got[7].labels == "mit"
    assert got[10].labels == "" == got[11].labels
    assert [got[i].labels for i in (20, 21, 22, 23, 24, 25, 26, 27, 40)] == ["mit", "mit", "bsd", "bsd", "gpl", "gpl", "apache", "isc", "mpl"]
    assert license_scan(empty(spark)).count() == 0


def test_quality_counts(spark):
    texts = awkward() + [(300, "a b c a b c a b c\n\na b\na b\n x $# |"), (301, "# " * 60), (302, " ".join(prose(3, 300)))]
    got = {r.doc_id: r for r in quality(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for doc, text in texts:
        text = text or ""
        ws = WORD.findall(text)
        grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
        count = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = got[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)), doc
        failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
        assert r.base_failed == failed and (not failed or not r.kept)
    assert got[302].kept and not got[301].kept
    kept = {r.doc_id for r in quality_filter(frame(spark, texts)).collect()}
    assert kept == {d for d, r in got.items() if r.kept}
    assert quality(empty(spark)).count() == 0 == quality_filter(empty(spark)).count()
    assert quality_filter(frame(spark, texts)).columns == frame(spark, texts).columns


def test_rules_come_by_rejections_per_cost(spark):
    rows = [{"hit0": a, "hit1": b, "hit2": c, "n": n, "work0": 10 * n, "work1": n, "work2": 5 * n} for a, b, c, n in [(True, False, True, 50), (False, True, False, 10), (False, False, False, 40)]]
    # rule 1: 10 of 100 for 100; rule 2: 50 for 500, which is 0.1 too; then nothing is left for rule 0
    assert QR.cascade_order(rows, 3) == [1, 2, 0]
    assert QR.cascade_order([], 3) == [0, 1, 2]
    texts = [(i, "too few") for i in range(900)] + [(1000 + i, " ".join(prose(i, 80))) for i in range(100)]
    names = [[r.name for r in QR.ordered_rules(frame(spark, texts).repartition(k), given=False)] for k in (2, 5)]
    assert names[0] == names[1] and names[0][0] == "few_words"


def test_later_rules_are_not_evaluated(spark, monkeypatch):
    texts = [(i, "too few") for i in range(20)]
    boom = QR.Rule("boom", ("lines",), lambda p: QR.F.raise_error(QR.F.concat(QR.F.lit("reached "), p["lines"][0])).cast("boolean"), lambda x, w, n: x, QR.F.raise_error(QR.F.lit("reached")).cast("boolean"))
    order = [r for r in QR.rules() if r.name == "few_words"] + [boom]
    monkeypatch.setattr(QR, "ordered_rules", lambda docs, given: order)
    assert quality_filter(frame(spark, texts)).count() == 0
    assert {r.failed_rule for r in quality(frame(spark, texts)).collect()} == {"few_words"}
    with pytest.raises(Exception, match="reached"):
        quality_filter(frame(spark, [(1, " ".join(prose(1, 80)))])).count()


KEY = "".join(random.Random(4).choices(string.ascii_letters + string.digits, k=40))


def secrets():
    return [
        (1, 'password = "hunter22" and Token: abc; api-key=zzzzzzzz apikey=zzzzzzzz API_KEY=\'q.w=e-r\''),
        (2, "AKIA" + "A" * 16 + " AKIAABC AKIA" + "B2" * 20),
        (3, "é😀 0123456789abcdef01234567 deadbeef " + "f" * 23),
        (4, "token=token:abcdefgh secret=short secretsecret==abcde"),
        (5, "key f33e61083db5dbdf4bd2369d2f80176e57f7fda2 erberbeeinheitkeiterundheit"),
        (6, "x" * 60 + " " + KEY + " thanbleshaningtionntion"),
        (7, None),
    ]


def base_spans(text):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secret_scan(spark):
    texts = secrets() + [(d + 1000, t) for d, t in awkward()]
    got = {r.doc_id: r for r in secret_scan(frame(spark, texts)).collect()}
    for doc, text in texts:
        base = base_spans(text or "")
        kinds = ["assign", "access", "hex", "random"]
        listed = [f"{kinds[k]}:{a}:{b}" for a, k, b in base]
        r = got[doc]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in base) for k in range(3)], doc
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest(), doc
        assert [x for x in r.spans.split(",") if x and not x.startswith("random")] == listed
    assert "random:4:44" in got[5].spans and got[5].spans.count("random") == 1
    assert "random:61:101" in got[6].spans and got[6].spans.count("random") == 1
    assert secret_scan(empty(spark)).count() == 0
    clean = {r.doc_id: r.text for r in redacted(frame(spark, texts)).collect()}
    assert clean[5] == "key [SECRET] erberbeeinheitkeiterundheit"
    assert clean[3] == "é😀 [SECRET] deadbeef " + "f" * 23
    assert clean[7] is None and clean[1].startswith("[SECRET]\" and Token: abc")
    for doc, text in awkward():
        assert clean[doc + 1000] == (text if not base_spans(text or "") else "[SECRET]")
    assert redacted(empty(spark)).count() == 0 and redacted(frame(spark, texts)).columns == frame(spark, texts).columns


def tail(z):
    a = abs(z)
    return 2 / (1 + math.exp(min(700, 1.5976 * a + 0.070565992 * a**3)))


def uniform(values, k):
    n = len(values)
    return (sum(c * c for c in Counter(values).values()) * k / n - n - (k - 1)) / math.sqrt(2 * (k - 1) * (1 - 1 / n))


def judged(run):
    """(random, evidence) of a run, by the docstring."""
    own = next((a for p, a in ALPHABETS if re.fullmatch(p, run)), None)
    if own is None:
        return False, 0.0
    values, k = [own.index(c) + 1 for c in run if c in own], len(own)
    n = len(values)
    high = [v > k / 2 for v in values]
    turns = 1 + sum(a != b for a, b in zip(high, high[1:]))
    mean = 2 * sum(high) * (n - sum(high)) / n + 1
    spread = math.sqrt(max(0.0, (mean - 1) * (mean - 2) / (n - 1)))
    middle = sum(values) / n
    power = sum((v - middle) ** 2 for v in values)
    serial = sum((a - middle) * (b - middle) for a, b in zip(values, values[1:])) / power * math.sqrt(n) if power > 0 else 9.0
    zs = [uniform(values, k), (turns - mean) / spread if spread > 0 else 9.0, serial, uniform([(b - a) % k for a, b in zip(values, values[1:])], k)]
    total = sum(SS.TEXT_PER_MILLE.values()) + SS.OTHER_PER_MILLE * (66 - len(SS.TEXT_PER_MILLE))
    text = sum(math.log(SS.TEXT_PER_MILLE.get(c, SS.OTHER_PER_MILLE) / total) for c in run if c in own)
    return min(map(tail, zs)) >= SS.LEVEL, -text - n * math.log(k) - math.log(len(ALPHABETS))


def runs():
    r = random.Random(8)
    some = lambda own, n: "".join(r.choices(own, k=n))
    out = [some(a, n) for _, a in ALPHABETS for n in (20, 33, 64, 400) for _ in range(6)]
    out += [str(uuid.UUID(int=r.getrandbits(128), version=4)) for _ in range(40)]
    out += ["12345678901234567890", "abcdefghijklmnopqrstuvwxyz", "abcabcabcabcabcabcabcabc", "a" * 30, "straightforwardnesses", "path/to/some-file_name-of/it", "aAbBcCdDeEfFgGhHiIjJkKlL"]
    return out


def test_battery_like_brute_force(spark):
    df = spark.createDataFrame([(x,) for x in runs()], "run string")
    got = {r.run: r.t for r in df.select("run", SS.let(SS.F.col("run"), SS._tested).alias("t")).collect()}
    for run in runs():
        random_, evidence = judged(run)
        assert got[run].random == random_ and got[run].evidence == pytest.approx(evidence, abs=1e-6), run
    passed = lambda some: sum(got[x].random for x in some) / len(some)
    assert passed([x for x in runs() if len(x) == 36 and x.count("-") == 4]) > 0.9
    assert not got["12345678901234567890"].random and not got["abcabcabcabcabcabcabcabc"].random and not got["path/to/some-file_name-of/it"].random


def test_long_base64_runs_pass(spark):
    r = random.Random(2)
    keys = ["".join(r.choices(string.ascii_letters + string.digits + "+/", k=1024)) for _ in range(100)]
    df = spark.createDataFrame([(x,) for x in keys], "run string")
    assert df.select(SS.let(SS.F.col("run"), SS._tested).alias("t")).where("t.random").count() > 95


def test_control_like_brute_force(spark):
    r = random.Random(6)
    rows = [(r.random() < 0.7, r.uniform(-20, 60)) for _ in range(500)]
    evidence = sorted((math.floor(e) for ok, e in rows if ok and e >= 0), reverse=True)
    # the step-up rule on whole nats: the largest k of which the weakest has evidence m / (FDR * k)
    want = math.inf
    for e in sorted(set(evidence), reverse=True):
        if e >= math.log(len(rows) / (SS.FDR * sum(x >= e for x in evidence))):
            want = e
    assert SS._threshold(spark.createDataFrame(rows, "random boolean, evidence double")) == want < math.inf


def test_many_spans_in_a_long_text(spark, monkeypatch):
    text = "".join(f"é{'word ' * (k % 9)}token=abcdef{k:06d} " for k in range(3000))
    monkeypatch.setattr(SS, "STEP", 7)
    monkeypatch.setattr(SS, "BLOCK", 11)
    row = secret_scan(frame(spark, [(1, text)])).first()
    want = base_spans(text)
    assert row.n_assign == 3000 and [x for x in row.spans.split(",") if x.startswith("assign")] == [f"assign:{a}:{b}" for a, k, b in want if k == 0]
    assert redacted(frame(spark, [(1, text)])).first().text == re.sub(r"token=abcdef\d+", "[SECRET]", text)


def test_alphabets_grow():
    assert [len(a) for _, a in ALPHABETS] == [10, 16, 16, 16, 16, 32, 36, 36, 62, 64, 64]


def level(sizes, weights=(1, 2, 3), most=3.0):
    """Targets by sharing again and again."""
    total, order = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), float(total), set(order)
    while open_ and left > 1e-9:
        share = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += share * weight[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def test_mix_meets_its_targets(spark):
    texts = [(i, " ".join(prose(i, 5 + i * 7 % 90))) for i in range(300)] + [(900, None), (901, ""), (5, "twice here"), (5, "twice here"), (None, "no id")]
    sources = [["b", "a", "é", "big", None, "tiny"][0 if i % 50 == 0 else 3 if i % 3 else i % 5 if i % 5 != 3 else 1] for i in range(300)] + ["tiny", "none", "b", "b", None]
    docs = frame(spark, texts, sources)
    rows = mix(docs).collect()
    assert len(rows) == len(texts)
    sizes, taken = defaultdict(int), defaultdict(int)
    for (d, t), s in zip(texts, sources):
        sizes[s] += len(WORD.findall(t or ""))
    want = level(sizes)
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9) and 0 <= r.taken <= 3 * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    again = mix(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert mix(empty(spark)).count() == 0


def test_mix_takes_random_documents(spark):
    texts = [(i, "one two three") for i in range(4000)]
    rows = mix(frame(spark, texts, ["a"] * 2000 + ["b"] * 2000)).collect()
    some = [r.doc_id for r in rows if r.source == "a" and r.taken]
    assert abs(len(some) - 4000 / 3) < 3 and 900 < sum(some) / len(some) < 1100
    assert all(r.taken >= 3 for r in rows if r.source == "b")


def test_documents_are_included_at_their_rates(spark):
    texts = [(i, " ".join(["w"] * (10 if i % 2 else 200))) for i in range(1200)]
    docs = frame(spark, texts, ["a"] * 800 + ["b"] * 400)
    seen, rate = Counter(), {}
    for seed in range(6):
        for r in mix(docs, weights=(2, 1), seed=seed).collect():
            seen[r.source, r.size] += r.taken / r.size
            rate[r.source, r.size] = r.p + (0 if r.source == "a" else 0)
    mean = {k: n / 6 / (400 if k[0] == "a" else 200) for k, n in seen.items()}
    # source a has two thirds of the words and gets two thirds: long documents are wanted more than short ones
    assert mean["a", 200] > 1.0 > mean["a", 10] and rate["a", 10] != rate["a", 200]
    for k, n in mean.items():
        assert abs(n % 1 - rate[k]) < 0.06 or abs(n - round(n)) < 0.06, (k, n, rate[k])


def test_priority_is_an_argument(spark):
    texts = [(i, "one two three") for i in range(2000)]
    docs = frame(spark, texts, ["a"] * 1000 + ["b"] * 1000).withColumn("priority", SS.F.when(SS.F.col("doc_id") % 2 == 0, "4").otherwise("high"))
    plain, wanted = ({r.doc_id: r.taken for r in mix(docs, priority=p).collect()} for p in (None, "priority"))
    even = lambda taken: sum(n for d, n in taken.items() if d < 1000 and d % 2 == 0) / sum(n for d, n in taken.items() if d < 1000)
    assert 0.4 < even(plain) < 0.6 and 0.75 < even(wanted) < 0.85


def test_rows_that_share_an_id_get_their_own_copies(spark):
    texts = [(7, "a " * 200), (7, "b " * 12), (None, "c " * 90), (None, "d " * 91)] + [(10 + i, " ".join(prose(i, 30))) for i in range(40)]
    docs = frame(spark, texts, ["a"] * 4 + ["b"] * 40).withColumnRenamed("chunk", "od`d name")
    sizes = sum(len((t or "").split()) for _, t in texts[:4])
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.source] += len(r.text.split())
    target = {r.source: r.target for r in mix(docs).collect()}
    assert abs(words["a"] - target["a"]) <= 200 and sizes


def test_mixed_documents(spark):
    texts = [(i, " ".join(prose(i, 40))) for i in range(90)]
    docs = frame(spark, texts)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    want = {(r.doc_id): r.copies for r in mix(docs, cut=False).collect()}
    assert {d: n for (d, _), n in got.items()} == {d: n for d, n in want.items() if n} and set(got) <= {(d, t) for d, t in texts}
    assert mixed_documents(empty(spark)).count() == 0
