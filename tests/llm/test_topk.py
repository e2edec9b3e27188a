import math

import numpy as np
from pyspark.sql import Row

from edgeloom.llm import topk
from edgeloom.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string"


def frame(spark, rows):
    return spark.createDataFrame([Row(vec_id=i, embedding=e, label=1, rank=0, score="x") for i, e in rows], SCHEMA)


def brute(rows, k=5, every=50):
    whole = {}
    for i, e in rows:
        if i is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v = [math.floor(256 * float(np.float32(x))) for x in e]
        whole[i] = min(whole.get(i, v), v)
    out = set()
    for q, a in whole.items():
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole.items() if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def test_like_brute_force(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(0, 0.2, 12).astype("f4").tolist()) for i in range(400)]
    rows += [(400 + i, rows[i % 7][1]) for i in range(60)]  # ties
    rows += [(600, None), (650, [1.0, None]), (700, [float("nan")] * 12), (750, [float("inf")] * 12), (50, [9.0] * 12), (None, [1.0] * 12), (800, [0.5] * 3), (850, [])]
    for tiles in ((2048, 16384), (2, 60)):
        monkeypatch.setattr(topk, "QUERIES", tiles[0])
        monkeypatch.setattr(topk, "TILE", tiles[1])
        monkeypatch.setattr(topk, "BAR", tiles[1] // 2)
        assert {tuple(x) for x in top_k(frame(spark, rows)).collect()} == brute(rows)


def test_few_and_none(spark):
    assert top_k(frame(spark, [])).count() == 0
    rows = [(0, [1.0]), (1, [2.0]), (-50, [-1.0])]
    assert {tuple(x) for x in top_k(frame(spark, rows)).collect()} == brute(rows)
    assert top_k(frame(spark, [(0, [1.0])])).count() == 0


def test_reading_stops_early():
    r = np.random.default_rng(1)
    centres = r.normal(0, 40, (40, 16))
    vectors = np.floor(centres[np.arange(4000) % 40] + r.normal(0, 4, (4000, 16))).astype(np.int64)
    ids = np.arange(4000)
    lists = topk.SortedLists(ids, vectors)
    bars = topk.first_bars(vectors[:64], ids[:64], ids[:2000], vectors[:2000], 5)
    got = lists.top(vectors[:64], ids[:64], bars, 5)
    for q in range(64):
        scores = vectors @ vectors[q]
        assert got[q] == sorted(((i, int(scores[i])) for i in range(4000) if i != q), key=lambda x: (-x[1], x[0]))[:5]
    # entries read, of those that the lists have for all queries
    assert 0 < lists.entries < 0.7 * 64 * vectors.size


def test_queries_skip_tables_that_cannot_reach_the_bar():
    q = np.array([[10, -10], [1, 1]])
    top, bottom = np.array([[9, 9], [1, 1]]), np.array([[-9, -9], [0, 0]])
    assert topk.reaches(q, np.array([100, 2]), top, bottom).tolist() == [[True, False], [True, True]]


def test_components_out_of_range_end_the_job(spark):
    import pytest

    with pytest.raises(Exception, match="after scaling"):
        top_k(frame(spark, [(0, [1e9]), (1, [1.0])])).collect()
