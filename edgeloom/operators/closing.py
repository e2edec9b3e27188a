"""Closing wedges: pairs of a list's elements that are an edge, looked up in memory and not dealt.

A list is a vertex with the targets of its oriented edges. The edges that may close a wedge (both ends are somebody's
targets) are written in buckets of MOST_HELD at most, about; a Python worker holds one bucket as sorted keys behind a table of
bits and goes through the lists once for each bucket. No wedge leaves its worker, so what is dealt grows with the edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from edgeloom.sources.shared import arrow_place

#: Closing edges of a bucket (16 bytes each and 8 of the table), and pairs that are made at once.
MOST_HELD, PAIRS = 8_000_000, 1 << 18
FOUND = "p long, q long, r long, done_pos long"
SIDES = "u long, v long, n long, s long"
#: The bucket that this worker holds: its folder and its tables.
_held: dict[str, tuple] = {}


def _hashed(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def bucket(path: str) -> tuple:
    """Vertices (sorted), which of them are a smaller end and a larger one, keys of the edges (sorted), their positions, and
    a table of the keys' hashes."""
    if path not in _held:
        import pyarrow.parquet as pq

        _held.clear()
        system, root = arrow_place(path)
        a = b = pos = np.empty(0, np.int64)
        if system.get_file_info(root).type.name == "Directory":  # no edge fell into it otherwise
            table = pq.read_table(root, filesystem=system, columns=["t1", "t2", "p3"], partitioning=None)
            a, b, pos = (table.column(x).to_numpy() for x in ("t1", "t2", "p3"))
            del table
        ids = np.unique(np.concatenate([np.unique(a), np.unique(b)]))
        a, b = np.searchsorted(ids, a), np.searchsorted(ids, b)
        small, large = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        small[a], large[b] = True, True
        keys = a * len(ids) + b
        order = np.argsort(keys)
        keys, pos = keys[order], pos[order]
        bits = max(3, int(len(keys) * 8).bit_length() - 1)
        there = np.zeros(1 << bits, bool)
        there[_hashed(keys, bits)] = True
        _held[path] = ids, small, large, keys, pos, there, bits
    return _held[path]


def _closed(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(s, ts, ps), a list of ascending targets and their edges' positions -> for the pairs i < j of elements that the bucket's
    edges close, some at a time: i, j, each element's vertex, target and position, and the closing edge's position."""
    ids, small, large, keys, pos, there, bits = bucket(path)
    if not len(ids):
        return
    for batch in batches:
        s, lists, places = batch.column(0).to_numpy(), batch.column(1), batch.column(2).flatten().to_numpy()
        sizes = np.diff(lists.offsets.to_numpy())
        t = lists.flatten().to_numpy()
        code = np.minimum(np.searchsorted(ids, t), len(ids) - 1)
        known = ids[code] == t
        owner = np.repeat(np.arange(len(s)), sizes)[known]
        code, t, places = code[known], t[known], places[known]
        vertex = s[owner]
        # the end of each element's list, among the elements that are left
        end = np.searchsorted(owner, owner, "right")
        first = np.flatnonzero(small[code])
        after = end[first] - first - 1
        first, after = first[after > 0], after[after > 0]
        total = np.concatenate([[0], np.cumsum(after)])
        at = 0
        while at < len(first):
            stop = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
            own, n = first[at:stop], after[at:stop]
            i = np.repeat(own, n)
            j = np.arange(total[stop] - total[at]) - np.repeat(total[at:stop] - total[at], n) + i + 1
            key = code[i] * len(ids) + code[j]
            likely = np.flatnonzero(there[_hashed(key, bits)] & large[code[j]])
            key, i, j = key[likely], i[likely], j[likely]
            k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[k] == key
            k, i, j = k[hit], i[hit], j[hit]
            if len(k):
                yield i, j, vertex, t, places, pos[k]
            at = stop


def close(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s, ts, ps) -> triangles that the bucket's edges close."""
    for i, j, s, t, places, pos in _closed(path, batches):
        own, x, y = s[i], t[i], t[j]
        done = np.maximum(np.maximum(places[i], places[j]), pos)
        columns = np.minimum(own, x), np.maximum(x, np.minimum(own, y)), np.maximum(own, y), done
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["p", "q", "r", "done_pos"])


def sides(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s, ts, ps) -> common neighbours of edges, in part: their number and the sum of their ids.

    An edge of a list, of which many triangles are found at once, is one row for them; a closing edge is one row a triangle.
    """
    for i, j, s, t, *_ in _closed(path, batches):
        x, y = t[i], t[j]
        u, v, n, total = [np.minimum(x, y)], [np.maximum(x, y)], [np.ones(len(i), np.int64)], [s[i]]
        low, top = int(i[0]), int(j.max()) + 1
        if max(abs(int(y.min())), abs(int(y.max())), abs(int(x.min())), abs(int(x.max()))) < 2**63 // (2 * len(i)):
            each, sums = np.zeros((2, top - low), np.int64)
            for at, other in ((i - low, y), (j - low, x)):
                np.add.at(each, at, 1)
                np.add.at(sums, at, other)
            at = np.flatnonzero(each)
            own, to = s[at + low], t[at + low]
            rows = [(own, to, each[at], sums[at])]
        else:  # ids so large that sums may be beyond 64 bits: Spark adds them, and tells
            rows = [(s[i], x, n[0], y), (s[i], y, n[0], x)]
        for own, to, k, total_ in rows:
            u.append(np.minimum(own, to))
            v.append(np.maximum(own, to))
            n.append(k)
            total.append(total_)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (u, v, n, total)], ["u", "v", "n", "s"])
