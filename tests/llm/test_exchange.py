"""The exchange of packed entries in two levels gives what one level gives, with few payloads a chunk."""

import numpy as np
import pytest
from cases import awkward, frame, prose
from test_substring_dedup import brute as brute_words
from test_substring_dedup import result as words_result
from test_suffix_dedup import brute as brute_bytes
from test_suffix_dedup import result as bytes_result

from edgeloom.llm import common as C
from edgeloom.llm import simhash, substring_dedup, suffix_dedup


def copied():
    """Awkward documents, and a passage that every one of many small documents holds."""
    shared = " ".join(prose(7, 60))
    return awkward() + [(1000 + k, f"{shared} " + " ".join(prose(500 + k, 30))) for k in range(60)]


@pytest.fixture
def two_levels(monkeypatch):
    """64 buckets or more in 4 bundles, chunks of a few documents."""
    monkeypatch.setattr(C, "BUNDLES", 4)
    monkeypatch.setattr(C, "CHUNK_BYTES", 1000)
    assert C.dealt(0, 1) == C.Deal(64, 16)


def test_substring_dedup(spark, two_levels, monkeypatch):
    texts = copied()
    assert words_result(substring_dedup.substring_dedup(frame(spark, texts), 20)) == brute_words(texts, 20)
    monkeypatch.setattr(substring_dedup, "CONTEXTS_EACH", 2)
    monkeypatch.setattr(substring_dedup, "ANCHORS_EACH", 20)
    assert words_result(substring_dedup.substring_dedup(frame(spark, texts), 7)) == brute_words(texts, 7)


def test_suffix_dedup(spark, two_levels, monkeypatch):
    texts = copied()
    assert bytes_result(suffix_dedup.suffix_dedup(frame(spark, texts), 50)) == brute_bytes(texts, 50)
    monkeypatch.setattr(suffix_dedup, "CONTEXTS_EACH", 2)
    assert bytes_result(suffix_dedup.suffix_dedup(frame(spark, texts), 26)) == brute_bytes(texts, 26)


def test_shingle_counts(spark, two_levels):
    texts = copied()
    rows = [(r.d, r.n, [tuple(x) for x in r.prefix]) for r in simhash._near_rows(frame(spark, texts)).collect()]
    C.BUNDLES = 8192
    again = [(r.d, r.n, [tuple(x) for x in r.prefix]) for r in simhash._near_rows(frame(spark, texts)).collect()]
    key = lambda row: (row[0] is None, row[0], row[1:])
    assert sorted(rows, key=key) == sorted(again, key=key)


def test_a_chunk_sends_few_payloads_however_many_buckets():
    for entries in (10**6, 10**9, 10**15):
        deal = C.dealt(entries, 1000)
        bucket = np.unique(np.random.default_rng(1).integers(0, deal.buckets, 50_000).astype(np.uint64))
        sent = C.Keyed.payloads(deal, bucket << np.uint64(32), np.ones(len(bucket), np.uint8))
        assert len(sent) <= C.BUNDLES and deal.buckets * 1000 >= entries


def test_a_unit_sends_an_entry_that_all_its_chunks_hold_once():
    deal, total = C.Deal(64, 16), C.Keyed(lambda n, head, size: (np.add.reduceat(n.astype(np.int64), head),), lambda n: n)
    keys = np.array([(17 << 32) | 5, (20 << 32) | 9], np.uint64)
    payloads = [p for k in range(50) for b, p in C.Keyed.payloads(deal, keys[: 1 + (k == 0)], np.ones(1 + (k == 0), np.uint8))]
    assert [b for b, _ in total.fold(payloads, deal, 1)] == [17, 20]
    replies = {b: total.reduce([p, p])[0] for b, p in total.fold(payloads, deal, 1)}
    back = [C.unpack_arrays(p)[0].tolist() for p in total.spread(payloads, replies, deal, 1)]
    assert back == [[100, 2]] + [[100]] * 49
