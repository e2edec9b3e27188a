import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from cases import awkward, empty, frame, prose
from tokenizers import Tokenizer

from edgeloom.llm import tokens
from edgeloom.llm.packing import capacities, pack
from edgeloom.llm.queries import tokenizer_path
from edgeloom.llm.token_files import IdFile, encode_file, pack_bits, token_files, unpack_bits, width_of
from edgeloom.llm.tokens import Encoder

ODD = ["", " ", "a  b", " lead", "trail ", "tab\t x", "x \n y", "foo\n", "foo\n bar", "foo bar", "it's we'll", "a  b", "x <|endoftext|> y", "\x1c x", "a  b c", "1 2 33", "...  ...", "😀 é 東京", "Größe ñandú, ª º µ. don't. x's, ǆ ﬁ. naïve..", "a , . b., c", "the the. the, The.", "a\nb c\nD.\ne, f\n\ng h \ni", "x y.\nZ z\n", "\nq r\ns", "日本語. ключ, ключ"]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(tokenizer_path())


def texts():
    return awkward() + [(2000 + k, t) for k, t in enumerate(ODD)]


def test_pieces_give_the_same_ids(plain):
    encoder = Encoder(open(tokenizer_path(), encoding="utf-8").read())
    for group in (texts(), texts()[::-1], [(0, t) for t in ODD[::2]]):
        for (_, t), raw in zip(group, encoder.stream(t or "" for _, t in group), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == plain.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_random_texts_and_a_small_table(plain, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 300)
    monkeypatch.setattr(tokens, "BLOCK", 200)
    encoder = Encoder(open(tokenizer_path(), encoding="utf-8").read())
    r = random.Random(5)
    parts = [*"aB z'.!,5\n\t\r -_\x00\x1c\x0bé世😀ß²ªſ\u0301\u00a0\u2003", "  ", "\n\n", " \n", "'s", "'ll", "don't", " word", "x" * 30, "<|endoftext|>", "<|endof", "text|>", "\u0120", "\u010a"]
    for _ in range(40):
        group = ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(100)]
        want = [e.ids for e in plain.encode_batch(group, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.stream(group)] == want
    long = "".join(r.choices(parts, k=20000))
    assert np.frombuffer(encoder.ids([long])[0], "<u4").tolist() == plain.encode(long, add_special_tokens=False).ids


def test_bits_round_trip():
    r = np.random.default_rng(1)
    for width in (1, 3, 7, 8, 13, 16, 17, 24, 31, 32):
        ids = r.integers(0, 1 << width, 70001, dtype=np.uint64).astype(np.uint32)
        data = pack_bits(ids, width)
        assert len(data) <= -(-len(ids) * width // 8) + 1 and (unpack_bits(data, width, len(ids)) == ids).all()
    assert [width_of(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_random_access():
    r = np.random.default_rng(2)
    docs = [(None if k == 0 else k * 3, r.integers(0, 3000, n).astype(np.uint32)) for k, n in enumerate([0, 5, 300, 1, 0, 999])]
    own = IdFile(encode_file(docs, 12, 64))
    every = np.concatenate([x for _, x in docs])
    assert (own.ids() == every).all() and all((own.document(i) == x).all() for i, (_, x) in enumerate(docs))
    assert (own.ids(60, 200) == every[60:260]).all() and len(own.ids(2000, 5)) == 0


def test_token_files(spark, plain):
    docs = texts() + [(3, "again"), (None, "no id")]
    got = [tuple(r) for r in token_files(frame(spark, docs), tokenizer_path(), 2).collect()]
    want, start = [], 0
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())):
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda x: x[1]) == want
    assert token_files(empty(spark), tokenizer_path()).count() == 0


def check_pieces(rows, docs, plain, length=1024):
    ids = defaultdict(list)
    for d, t in docs:
        ids[d].append(plain.encode(t or "", add_special_tokens=False).ids + [0])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert 1 <= r.length
        assert any(len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    assert set(by_doc) == set(ids)
    for d, own in by_doc.items():
        assert sum(r.length for r in own) == sum(map(len, ids[d]))
        if len(ids[d]) == 1:
            at = 0
            for r in sorted(own, key=lambda r: r.start):
                assert r.start == at
                at += r.length
    padding = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    assert padding == 0
    return by_seq


def test_packing(spark, plain):
    docs = texts() + [(3, "again"), (None, "no id"), (4000, " ".join(prose(8, 30000)))]
    rows = pack(frame(spark, docs, [None if k % 7 == 0 else f"s{k % 4}" for k in range(len(docs))]), tokenizer_path(), 0, with_ids=True).collect()
    check_pieces(rows, docs, plain)
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert pack(empty(spark), tokenizer_path()).count() == 0


def test_windows_keep_proportions_across_slices(spark, plain, monkeypatch):
    from edgeloom.llm import packing

    monkeypatch.setattr(packing, "SLICE", 8)
    docs = [(k, " ".join(prose(k, 150 + k % 60))) for k in range(240)]
    sources = ["big" if k % 3 else ("mid" if k % 2 else "low") for k in range(240)]
    rows = pack(frame(spark, docs, sources), tokenizer_path(), 0).collect()
    seqs = check_pieces(rows, docs, plain)
    total = sum(r.length for r in rows)
    share = {s: sum(r.length for r in rows if r.source == s) / total for s in set(sources)}
    run, n = defaultdict(int), 0
    for k in sorted(seqs):
        for r in seqs[k]:
            run[r.source] += r.length
            n += r.length
        assert all(abs(run[s] - share[s] * n) < 520 for s in share)
    assert len({k >> 32 for k in seqs}) > 5


def test_capacities():
    assert capacities(2048 + 777, 1024) == [1024, 1024, 512, 256, 8, 1] and capacities(0, 1024) == []


def test_windows_have_the_shares_that_are_asked_for(spark, plain):
    docs = frame(spark, [(i, " ".join(prose(i, 400))) for i in range(60)], ["a"] * 30 + ["b"] * 30)
    rows = pack(docs, tokenizer_path(), length=256, shares={"a": 3, "b": 1}).collect()
    by = defaultdict(lambda: defaultdict(int))
    for r in rows:
        by[r.sequence_id][r.source] += r.length
    full = [by[k] for k in sorted(by) if sum(by[k].values()) == 256]
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    # source a lasts for its third of the windows and more, then b fills them alone
    early = full[: len(full) // 2]
    assert all(abs(w["a"] - 192) <= 128 for w in early) and abs(sum(w["a"] for w in early) / len(early) - 192) < 10
    assert full[-1]["a"] == 0


def test_words_stay_arrays_until_they_are_encoded(plain, monkeypatch):
    encoder = Encoder(open(tokenizer_path(), encoding="utf-8").read())
    apart, learn = [], Encoder._learn
    monkeypatch.setattr(Encoder, "_learn", lambda self, pieces: apart.extend(pieces) or learn(self, pieces))
    group = ["Größe and ñandú ǆ naïve ª wordɏ", "a × b ÷ c 12 ключ wordɐ é", "x", " y z\nq. w's"] + [" ".join(prose(k, 200)) for k in range(3)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.stream(group)] == [e.ids for e in plain.encode_batch(group, add_special_tokens=False)]
    assert apart and not [p for p in apart if tokens._is_word(p.decode().removeprefix(" ")) and len(p) <= tokens.SHORT]


def test_the_next_task_finds_pieces_again(plain):
    encoder = Encoder(open(tokenizer_path(), encoding="utf-8").read())
    group = [" ".join(prose(k, 200)) for k in range(3)]
    for keep in (True, True, False):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.stream(group, keep=keep)] == [e.ids for e in plain.encode_batch(group, add_special_tokens=False)]
        known, first = encoder.known, locals().get("known") or encoder.known
        assert known == (first if keep else 0)
