import hashlib
import random

import numpy as np
from cases import awkward, empty, frame

from edgeloom.llm import substring_dedup as module
from edgeloom.llm.substring_dedup import extended, substring_dedup

DEAL = module.C.Deal(4, 1)


def brute(texts, window):
    docs = sorted(((d, (t or "").encode().split()) for d, t in texts), key=lambda x: x[0])
    seen, out = set(), {}
    for d, words in docs:
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[d] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_like_brute_force(spark):
    texts = awkward()
    for window in (20, 7):
        got = result(substring_dedup(frame(spark, texts), window))
        assert got == brute(texts, window)
    assert sum(x[1] for x in got.values()) > 100


def test_spans_are_maximal_and_join_to_what_is_removed(spark):
    for r in substring_dedup(frame(spark, awkward())).collect():
        assert sum(s.length for s in r.repeats) == r.n_removed
        assert all(a.start + a.length < b.start for a, b in zip(r.repeats, r.repeats[1:]))


def test_empty_and_repeated_rows(spark):
    assert substring_dedup(empty(spark)).count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    rows = substring_dedup(frame(spark, [(1, text), (1, text), (2, text), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (1, 0), (1, 0), (2, 40)]


def test_hits_are_extended_to_what_agrees_on_both_sides():
    r = random.Random(3)
    for _ in range(20):
        # contexts about blocks of 3 words, windows of 7: few words, so many agree in part
        rows = []
        for k in range(60):
            left, right = r.randrange(5), r.randrange(5)
            if left + right >= 4:
                rows.append(([r.randrange(2) for _ in range(left + 3 + right)], left, r.randrange(9)))
        size = np.array([len(c) for c, _, _ in rows])
        got = extended(np.array([x for c, _, _ in rows for x in c]), np.cumsum(size) - size, size, np.array([x for _, x, _ in rows]), np.array([d for *_, d in rows]), 7)
        for (c, left, d), bits in zip(rows, got):
            for i, bit in enumerate(bits):
                o = left - i
                # a window with the block within it, at the same offset, in a context of a smaller doc_id
                want = 0 <= o <= 4 and any(e < d and 0 <= a - o and b[a - o : a - o + 7] == c[i : i + 7] for b, a, e in rows)
                assert bool(bit) == want


def test_several_chunks(spark):
    r = random.Random(9)
    long = [[f"w{r.randrange(10**6)}" for _ in range(220_000)] for _ in range(4)]
    long[3][1000:1000] = long[1][219_000:] + long[0][:500]
    texts = [(k, " ".join(w)) for k, w in enumerate(long)]
    assert sum(len(t) for _, t in texts) > module.C.CHUNK_BYTES
    assert result(substring_dedup(frame(spark, texts))) == brute(texts, 20)


def chunk_of(texts, number=0):
    raw = [(t or "").encode() for _, t in texts]
    return module.C.Chunk(number, [d for d, _ in texts], [len(x) for x in raw], module.C.squeeze(b"".join(raw)))


def test_hashes_that_collide_are_told_apart(monkeypatch):
    texts = awkward(2)
    words = module._Words(chunk_of(texts))
    found = module._Contexts(words, all_hits(words), 7, DEAL, DEAL)
    want = found.locally.copy()
    assert want.any() and not want.all()
    n = len(found.start)
    assert (found._repeated(words, 7, np.zeros(n, np.uint64), np.zeros(n, np.uint64)) == want).all()


def all_hits(words, state=1):
    """Replies that call every block a hit."""
    _, h1, h2 = words.windows(3)
    keys, _, _ = module._anchor_keys(h1, h2, DEAL)
    return {b: module.C.pack_arrays(np.full(j - i, state, np.uint8)) for b, (i, j) in module.C.bucket_runs(keys >> np.uint64(32)).items()}


def test_borders_of_blocks_chunks_and_wide_anchors(spark, monkeypatch):
    texts = awkward(3)
    want = brute(texts, 7)
    for block, state in ((16, 1), (1 << 20, 2), (16, 2)):
        monkeypatch.setattr(module, "BLOCK", block)
        parts = [texts[k::3] for k in range(3)]
        words = [module._Words(chunk_of(p, k)) for k, p in enumerate(parts)]
        hits = [all_hits(w, state) for w in words]
        sent, back = {}, [{} for _ in parts]
        for k, (p, h) in enumerate(zip(parts, hits)):
            for r in module._emit_contexts(7, DEAL, DEAL)(chunk_of(p, k), {"anchor": h}).to_pylist():
                sent.setdefault(r["bucket"], []).append((k, r["payload"]))
        for b, rows in sent.items():
            for (k, _), reply in zip(rows, module._Places(7).reduce([x for _, x in rows])):
                back[k][b] = reply
        got = {}
        for k, p in enumerate(parts):
            for r in module._finish(7, DEAL, DEAL)(chunk_of(p, k), {"anchor": hits[k], "context": back[k]}).to_pylist():
                got[r["doc_id"]] = (r["n_words"], r["n_removed"], r["kept_sha256"])
        assert got == want


def test_words_are_hashed_together_by_their_bytes_alone():
    words = [b"a", b"ab", b"abcdefgh", b"abcdefghi", b"x" * 64, b"x" * 65, b"x" * 3000, "ä".encode(), b"a\0", b"\0"]
    hashed = lambda ws: module._hashes(np.frombuffer(b"".join(ws), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in ws])])).tolist()
    assert len(set(hashed(words))) == len(words)
    assert hashed(words[::-1]) == hashed(words)[::-1]
    assert [h for w in words for h in hashed([w])] == hashed(words)


def test_windows_are_looked_for_once(monkeypatch):
    texts = awkward(3)
    sent = module._emit_contexts(7, DEAL, DEAL)(chunk_of(texts), {"anchor": all_hits(module._Words(chunk_of(texts)))}).to_pylist()
    back = {r["bucket"]: module._Places(7).reduce([r["payload"]])[0] for r in sent}
    monkeypatch.delattr(module, "_Contexts")
    monkeypatch.delattr(module, "_Words")
    rows = module._finish(7, DEAL, DEAL)(chunk_of(texts), {"context": back}).to_pylist()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == brute(texts, 7)
