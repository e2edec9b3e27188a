import hashlib

from cases import awkward, empty, frame

from edgeloom.llm.suffix_dedup import maximal_repeats, suffix_dedup


def brute(texts, length):
    docs = sorted(((d, (t or "").encode()) for d, t in texts), key=lambda x: x[0])
    first, out = {}, {}
    for d, raw in docs:
        for i in range(len(raw) - length + 1):
            first.setdefault(raw[i : i + length], d)
    for d, raw in docs:
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < d:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_like_brute_force(spark):
    texts = awkward()
    for length in (50, 26):
        assert result(suffix_dedup(frame(spark, texts), length)) == brute(texts, length)


def test_strings_dealt_one_by_one_give_the_same(spark, monkeypatch):
    from edgeloom.llm import suffix_dedup as module

    texts = awkward(4)
    want = brute(texts, 50)
    monkeypatch.setattr(module, "WIDE", 2)
    got = {}
    chunk = module.C.Chunk(0, [d for d, _ in texts], [len((t or "").encode()) for _, t in texts], module.C.squeeze(b"".join((t or "").encode() for _, t in texts)))
    import pyarrow as pa

    one = pa.RecordBatch.from_pydict({"chunk": [0], "ids": [chunk.ids.tolist()], "sizes": [chunk.sizes.tolist()], "raw": [len(chunk.raw)], "blob": [module.C.squeeze(chunk.raw)]})
    deal = module.C.Deal(64, 1)
    emitted = next(iter(module._emit_anchors(50, deal)(iter([one]))))
    anchors = {b.as_py(): module.C.Keyed(module._combine_anchors, lambda places, several: several * (1 + (places >= 2)).astype("uint8")).reduce([p.as_py()])[0] for b, p in zip(emitted["bucket"], emitted["payload"])}
    sent = module._emit_contexts(50, deal, deal)(chunk, {"anchor": anchors})
    contexts = {b.as_py(): module._Strings(50).reduce([p.as_py()])[0] for b, p in zip(sent["bucket"], sent["payload"])}
    for r in module._finish(50, deal, deal)(chunk, {"anchor": anchors, "context": contexts}).to_pylist():
        got[r["doc_id"]] = (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
    assert got == want


def test_borders_of_blocks(monkeypatch):
    from edgeloom.llm import suffix_dedup as module

    raw = [(t or "").encode() for _, t in awkward(5)]
    chunk = module.C.Chunk(0, [d for d, _ in awkward(5)], [len(x) for x in raw], module.C.squeeze(b"".join(raw)))

    def strings():
        place, first, last, _, h = module._anchors(chunk, 50)
        return {(s, p, int(x)) for p, a, z, x in zip(place.tolist(), first.tolist(), last.tolist(), h) for s in range(a, z + 1)}

    whole = strings()
    monkeypatch.setattr(module, "BLOCK", 64)
    assert strings() == whole and len(whole) > 1000


def test_empty_and_repeated_rows(spark):
    assert suffix_dedup(empty(spark)).count() == 0
    rows = suffix_dedup(frame(spark, [(1, "x" * 70), (1, "x" * 70), (2, "x" * 70), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (1, 0), (1, 0), (2, 70)]


def test_maximal_repeats_hold_all_occurrences():
    texts = [b"xabcdey", b"zabcdew", b"qabcr", b"abc"]
    groups = dict(maximal_repeats(texts, 3))
    assert groups == {b"abcde": [(0, 1), (1, 1)], b"abc": [(0, 1), (1, 1), (2, 1), (3, 0)]}
