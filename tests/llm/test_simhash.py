import random

import xxhash
from cases import awkward, empty, frame, prose

from edgeloom.llm.simhash import components, linked, near_dedup, simhash_components


def fingerprint(text):
    low = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
    ws = low.split()
    if not ws:
        return 0
    shingles = [b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, near):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {n: find(n) for n in nodes}


def signed(x):
    return x - 2**64 if x >> 63 else x


def test_like_brute_force(spark):
    texts = awkward() + [(500 + k, " ".join(prose(9, 400)[:399] + [f"end{k}"])) for k in range(25)] + [(700, "A  b\nC d"), (701, "a b c d")]
    own = {d: fingerprint(t) for d, t in texts}
    group = roots(set(own.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for d, f in own.items():
        first[group[f]] = min(d, first.get(group[f], d))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_components(frame(spark, texts)).collect()}
    assert got == {d: (f"{f:016x}", first[group[f]]) for d, f in own.items()}
    kept = near_dedup(frame(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values()) and kept.columns == frame(spark, texts).columns


def test_links_lose_nothing(spark):
    r = random.Random(5)
    values = set()
    for _ in range(30):
        x = r.getrandbits(64)
        values.add(x)
        for _ in range(8):
            y = r.choice(sorted(values))
            values.add(y ^ (1 << r.randrange(64)) ^ (r.random() < 0.7) * (1 << r.randrange(64)))
    values |= {0, 2**64 - 1, 1, 2**63}
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    links = [(x.a, x.b) for x in linked(df).collect()]
    want = roots({signed(v) for v in values}, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {n: got.get(n, n) for n in want} == want


def test_fingerprints_of_long_texts(monkeypatch):
    from edgeloom.llm import simhash

    text = " ".join(prose(4, 500))
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text) == fingerprint(text)


def test_crowded_cells_give_the_same_links(spark, monkeypatch):
    from edgeloom.llm import simhash

    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(3)]
    values = {b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(60)}
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    want = roots({signed(v) for v in values}, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    for most in (2, 1000):
        monkeypatch.setattr(simhash, "PAIRS", most)
        links = {(x.a, x.b) for x in linked(df).collect()}
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in links)
        got = roots({signed(v) for v in values}, lambda a, b: (max(a, b), min(a, b)) in links)
        assert got == want


def test_long_chains_settle(spark):
    chain = [(i + 1, i) for i in range(200)]
    got = components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert len(got) == 201 and {x.root for x in got} == {0}


def test_empty_and_repeated_rows(spark):
    assert simhash_components(empty(spark)).count() == 0 == near_dedup(empty(spark)).count()
    docs = frame(spark, [(4, "x y z"), (4, "x y z"), (None, "x y z"), (9, None), (8, "")])
    assert sorted((r.doc_id or 0, r.component_id) for r in simhash_components(docs).collect()) == [(0, 4), (4, 4), (4, 4), (8, 8), (9, 8)]
    assert sorted(r.doc_id for r in near_dedup(docs).collect()) == [4, 8]


def shingle_set(text):
    ws = text.lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}


def similar(a, b):
    x, y = shingle_set(a), shingle_set(b)
    return 5 * len(x & y) >= 4 * len(x | y)


def edited():
    """Originals and copies with some words changed: similarity on both sides of 0.8; one group shares an original."""
    r, texts = random.Random(3), []
    for k in range(12):
        words = prose(300 + k, 150, 5000)
        texts.append(words)
        for edits in (1, 2, 3, 4, 5, 8) if k else (1, 2, 3) * 12:
            copy = list(words)
            for _ in range(edits):
                copy[r.randrange(len(copy))] = f"new{r.randrange(10**6)}"
            texts.append(copy)
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


def test_near_dedup_takes_edited_copies(spark):
    texts = edited()
    group = roots([d for d, _ in texts], lambda a, b: similar(texts[a][1], texts[b][1]))
    bits = roots([d for d, _ in texts], lambda a, b: (fingerprint(texts[a][1]) ^ fingerprint(texts[b][1])).bit_count() <= 2)
    assert len(set(bits.values())) > len(set(group.values())) > 12
    assert sorted(r.doc_id for r in near_dedup(frame(spark, texts)).collect()) == sorted(set(group.values()))


def test_near_dedup_keeps_a_row_of_each_group(spark):
    a, b, c, d = (" ".join(prose(40 + k, 60)) for k in range(4))
    texts = [(5, a), (None, a), (None, b), (None, c), (7, c + " more"), (7, d), (8, d), (9, a + " z"), (9, a + " y")]
    kept = near_dedup(frame(spark, texts)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(5, a), (0, b), (7, c + " more"), (7, d)])
    tied = near_dedup(frame(spark, [(9, a + " z"), (9, a + " y"), (9, a + " y"), (None, b), (None, b)])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in tied) == sorted([(9, a + " y"), (0, b)])


def test_prefixes_hold_the_rarest_shingles_of_all_documents(spark, monkeypatch):
    from edgeloom.llm import common, simhash

    monkeypatch.setattr(common, "CHUNK_BYTES", 2000)
    near = edited()
    group = roots([d for d, _ in near], lambda a, b: similar(near[a][1], near[b][1]))
    texts = near + [(1000 + k, t) for k, (_, t) in enumerate(awkward())] + [(None, None), (None, near[0][1])]
    for each in (simhash.SHINGLES_EACH, 20):  # 64 buckets and very many
        monkeypatch.setattr(simhash, "SHINGLES_EACH", each)
        sets = [simhash.shingles(t).view("int64").tolist() for _, t in texts]
        count = {}
        for own in sets:
            for x in own:
                count[x] = count.get(x, 0) + 1
        want = []
        for (d, _), own in zip(texts, sets, strict=True):
            order = sorted(own, key=lambda x: (count[x], x % 2**64))[: len(own) - -(-len(own) * 4 // 5) + 1]
            want.append((d or 0, len(own), [(i, x) for i, x in enumerate(order) if count[x] > 1]))
        got = simhash._near_rows(frame(spark, texts)).collect()
        assert sorted((r.d or 0, r.n, [tuple(x) for x in r.prefix]) for r in got) == sorted(want)
        assert sorted(r.doc_id or 0 for r in near_dedup(frame(spark, near)).collect()) == sorted(set(group.values()))
