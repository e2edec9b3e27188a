"""The pipeline's rows against brute force over a small table of documents."""

import os
import re
import sys
from collections import Counter, defaultdict

from cases import frame, prose
from test_simhash import fingerprint, roots
from tokenizers import Tokenizer

from edgeloom.llm import queries as Q
from edgeloom.llm.queries import tokenizer_path
from edgeloom.llm.source_mix import mix

sys.path.append(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def documents():
    out = [(k, " ".join(prose(k, 150 + k))) for k in range(40)]
    out += [(100 + k, out[k][1]) for k in range(5)]  # copies
    out += [(200, "too short"), (201, None), (202, "## a " * 80), (203, " ".join(["again and again"] * 40))]
    out += [(300, " ".join(prose(77, 90)) + "\ntoken = 2321bac4d15ec8f90433955bf9d3cf61da5bdd1e and more")]
    return out


def test_run(spark, tmp_path):
    import corpus_pipeline

    texts = documents()
    frame(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    clean = [(d, t) for d, t in texts if d < 200 or d == 300]
    own = {d: fingerprint(t) for d, t in clean}
    group = roots(set(own.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for d, f in own.items():
        first[group[f]] = min(d, first.get(group[f], d))
    kept = {d: re.sub(r"token = [0-9a-f]+", "[SECRET]", t) for d, t in clean if d in first.values()}
    source = {d: f"s{k % 3}" for k, (d, _) in enumerate(texts)}
    mixed = mix(frame(spark, list(kept.items()), [source[d] for d in kept]), cut=False).collect()
    copies = {r.doc_id: r.copies for r in mixed if r.copies}
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = {d: tokenizer.encode(kept[d], add_special_tokens=False).ids + [0] for d in copies}

    got, length = defaultdict(Counter), Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        ids = [int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)]
        assert ids == want[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(want[r.doc_id])
        for i in range(r.start, r.start + r.length):
            got[r.doc_id][i] += 1
        length[r.sequence_id] += r.length
    assert {d: set(c.values()) for d, c in got.items()} == {d: {n} for d, n in copies.items()}
    assert all(n == 1024 or n & (n - 1) == 0 for n in length.values())
    assert 100 not in got and 200 not in got and 202 not in got and 203 not in got and 300 in kept


def test_stages_keep_the_columns_of_documents(spark):
    import corpus_pipeline

    docs = frame(spark, documents())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns


def test_queries_agree_with_their_sql(spark):
    from compare import check, connect

    sf = "/root/testdata/sf0.001"
    con = connect(sf)
    for name, sql in Q.oracle_sql().items():
        check(spark, con, name, Q.queries()[name], sql, sf)
