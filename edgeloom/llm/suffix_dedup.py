"""Exact dedup over bytes by the common-prefix interval tree of an enhanced suffix array.

One suffix array over the corpus would not be distributed, so suffixes are dealt by content:

1. *Anchors.* Every string of `length` bytes is assigned the smallest of its 24-byte substrings by hash (its
   minimizer, the leftmost if equal). Equal strings have equal anchors at equal offsets, so they meet. An anchor
   that only one document holds is dropped; nothing it stands for can repeat across documents.
2. *Contexts.* Of the other anchors, the bytes covered by their strings go to the anchor's bucket, equal ones of a
   chunk once, with the smallest doc_id. An anchor with very many occurrences would gather in one bucket, so its
   strings are dealt one by one, by their own hash, and equal ones of a chunk are sent once.
3. *Suffix array.* A bucket sorts the suffixes that start at its anchors, computes the common prefixes of
   neighbours byte by byte and scans them with a stack into the tree of common-prefix intervals.
4. *Left extension.* A string that starts `o` bytes before its anchor repeats in an interval of the depth it needs
   if its occurrences there agree on the `o` bytes to the left. Intervals are divided where left extensions
   differ; each group holds all its occurrences, not just neighbours, and the smallest doc_id decides.

maximal_repeats() gives the same tree's groups with all occurrences for one list of texts.

Defined cases: a null text is empty; a null doc_id sorts before all others; rows that share a doc_id are the same
age, so neither loses bytes to the other; a very long text is a chunk of its own, held by one task (2 GB at most, as a
string is); anchors that tie are taken from the left; an empty table gives no rows; further columns are ignored. Bytes
that remain may no longer be UTF-8, so they are returned as binary. Strings are 24 to 55 bytes long (ANCHOR, and the 32
bits of a context's verdict); other lengths are refused.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm import common as C

ANCHOR = 24
#: Anchors and contexts in one bucket, about; occurrences (a chunk counts 255 at most) from which strings are dealt one by one.
ANCHORS_EACH, CONTEXTS_EACH, WIDE = 2_000_000, 150_000, 2_000
#: Bytes of a chunk that are hashed at a time.
BLOCK = 1 << 20

OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, spans array<struct<start:long,length:long>>"
OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])

_TABLE = C.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(C.BASES[0]))


def _anchors(chunk: C.Chunk, length: int) -> tuple[np.ndarray, ...]:
    """Of each anchor: place, first and last start of its strings, row, hash. Places are bytes of the chunk."""
    data = np.frombuffer(chunk.raw, np.uint8)
    reach = length - ANCHOR + 1
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    row_of = np.repeat(np.arange(len(chunk.sizes)), chunk.sizes)
    for begin in range(0, max(0, len(data) - length + 1), BLOCK):
        part = data[begin : begin + BLOCK + length - 1]
        h = C.rolling(_TABLE[part], ANCHOR, C.BASES[1])
        key = (h & ~np.uint64((1 << 22) - 1)) | np.arange(len(h), dtype=np.uint64)
        best = (C.sliding_min(key, reach) & np.uint64((1 << 22) - 1)).astype(np.int64)
        rows = row_of[begin : begin + len(part)]
        start = np.flatnonzero(rows[: len(best)] == rows[length - 1 :])
        best = best[start]
        if not len(best):
            continue
        new = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (start[1:] != start[:-1] + 1)]))
        last = np.append(new[1:], len(best)) - 1
        for have, x in zip(out, (best[new] + begin, start[new] + begin, start[last] + begin, rows[best[new]], h[best[new]]), strict=True):
            have.append(x)
    # an anchor whose strings lie on both sides of a block's border stands twice: each part has its own strings
    return tuple(np.concatenate(x) if x else np.zeros(0, np.uint64 if i == 4 else np.int64) for i, x in enumerate(out))


def _anchor_keys(h: np.ndarray, anchors: C.Deal):
    key = ((h % np.uint64(anchors.buckets)) << np.uint64(32)) | (h >> np.uint64(32))
    return np.unique(key, return_inverse=True, return_counts=True)


def _emit_anchors(length: int, anchors: C.Deal):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in C.Chunk.rows(batch):
                _, _, _, row, h = _anchors(chunk, length)
                keys, inverse, count = _anchor_keys(h, anchors)
                ids = chunk.ids[row]
                low, high = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
                np.minimum.at(low, inverse, ids)
                np.maximum.at(high, inverse, ids)
                count = np.minimum(count, 255).astype(np.uint8)
                several = (low != high).astype(np.uint8)
                out = C.Keyed.payloads(anchors, keys, count, several)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _ in out], pa.int32()), "chunk": pa.array([chunk.chunk] * len(out), pa.int64()), "payload": pa.array([p for _, p in out], pa.binary())})

    return emit


def _combine_anchors(count: np.ndarray, several: np.ndarray, head: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    places = np.minimum(np.add.reduceat(count.astype(np.int64), head), WIDE).astype(np.uint32)
    return places, ((size > 1) | (np.maximum.reduceat(several, head) > 0)).astype(np.uint8)


#: Reply 0: held by one document; 1: by several; 2: by very many.
_ANCHORS = C.Keyed(_combine_anchors, lambda places, several: several * (1 + (places >= WIDE)).astype(np.uint8))


class _Contexts:
    """The distinct contexts of a chunk's shared anchors, as (bytes, left bytes), in order of bucket."""

    def __init__(self, chunk: C.Chunk, replies: dict[int, bytes], length: int, anchors: C.Deal, deal: C.Deal):
        buckets = deal.buckets
        place, first, last, row, h = _anchors(chunk, length)
        keys, inverse, _ = _anchor_keys(h, anchors)
        runs = anchors.runs(keys >> np.uint64(32))
        verdict = np.zeros(len(keys), np.uint8)
        for b, data in replies.items():
            verdict[slice(*runs[b])] = C.unpack_arrays(data)[0]
        verdict = verdict[inverse] if len(keys) else np.zeros(0, np.uint8)
        far = C.mix64(h) % np.uint64(buckets) if len(h) else h
        seen: dict[tuple[int, int, bytes], int] = {}
        #: each use: context, first start, row
        uses: list[tuple[int, int, int]] = []
        raw = chunk.raw
        narrow = np.flatnonzero(verdict == 1)
        for b, p, a, z, r in zip(far[narrow].tolist(), place[narrow].tolist(), first[narrow].tolist(), last[narrow].tolist(), row[narrow].tolist(), strict=True):
            uses.append((seen.setdefault((b, p - a, raw[a : z + length]), len(seen)), a, r))
        wide = np.flatnonzero(verdict == 2)
        if len(wide):
            n = last[wide] - first[wide] + 1
            begin = np.repeat(first[wide] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            for p, a, r in zip(np.repeat(place[wide], n).tolist(), begin.tolist(), np.repeat(row[wide], n).tolist(), strict=True):
                s = raw[a : a + length]
                uses.append((seen.setdefault((_own_bucket(s, buckets), p - a, s), len(seen)), a, r))
        order = sorted(range(len(seen)), key=[k[0] for k in seen].__getitem__)
        rank = np.empty(len(seen), np.int64)
        rank[order] = np.arange(len(seen))
        contexts = list(seen)
        self.contexts = [contexts[i] for i in order]
        use = np.array(uses, np.int64).reshape(-1, 3)
        self.context, self.start, self.row = rank[use[:, 0]], use[:, 1], use[:, 2]
        self.doc = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(self.doc, self.context, chunk.ids[self.row])
        self.strings = np.array([len(s) - length + 1 for _, _, s in self.contexts], np.int64)
        self.runs = deal.runs(np.array([b for b, _, _ in self.contexts], np.int64))


def _own_bucket(s: bytes, buckets: int) -> int:
    return int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little") % buckets


def _payload(contexts: list[tuple[int, int, bytes]], doc: np.ndarray, deal: C.Deal, bundle: int) -> bytes:
    ids, which = np.unique(doc, return_inverse=True)
    flat = np.frombuffer(b"".join(s for _, _, s in contexts), np.uint8)
    sizes, lefts = (np.array(x, np.uint8) for x in ([len(s) for _, _, s in contexts], [left for _, left, _ in contexts]))
    return C.pack_arrays(deal.within(np.array([b for b, _, _ in contexts], np.int64), bundle), flat, sizes, lefts, ids, which.astype(np.uint32))


def _emit_contexts(length: int, anchors: C.Deal, buckets: C.Deal):
    def work(chunk: C.Chunk, replies: dict[str, dict[int, bytes]]) -> pa.Table:
        found = _Contexts(chunk, replies.get("anchor", {}), length, anchors, buckets)
        out = [(b, _payload(found.contexts[i:j], found.doc[i:j], buckets, b)) for b, (i, j) in found.runs.items()]
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int32()), "chunk": pa.array([chunk.chunk] * len(out), pa.int64()), "payload": pa.array([p for _, p in out], pa.binary())})

    return work


def _sorted_prefixes(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of zero-padded byte rows, and the common prefix of each row with the one before it (the first: 0)."""
    words = rows.view(">u8")
    order = np.lexsort((sizes, *(words[:, k] for k in range(words.shape[1] - 1, -1, -1))))
    s, n = rows[order], sizes[order]
    common = np.zeros(len(s), np.int64)
    if len(s) > 1:
        unequal = s[1:] != s[:-1]
        common[1:] = np.where(unequal.any(axis=1), unequal.argmax(axis=1), rows.shape[1])
        common[1:] = np.minimum(common[1:], np.minimum(n[1:], n[:-1]))
    return order, common


def interval_tree(common: list[int], least: int) -> list[tuple[int, int, int, int]]:
    """Stack-scan of a common-prefix array: (depth, parent's depth, first, last) of each interval of depth >= least.

    An interval of depth d is a maximal run of suffixes of which all share d bytes and not more. A parent's depth
    below `least` is given as it is.
    """
    out: list[tuple[int, int, int, int]] = []
    depths, lefts = [0], [0]
    for i in range(1, len(common) + 1):
        now = common[i] if i < len(common) else 0
        left = i - 1
        while now < depths[-1]:
            depth, left = depths.pop(), lefts.pop()
            if depth >= least:
                out.append((depth, max(now, depths[-1]), left, i - 1))
        if now > depths[-1]:
            depths.append(now)
            lefts.append(left)
    return out


def _pad(flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray, width: int, step: int) -> np.ndarray:
    """Rows of `width` bytes that start at `begin` and go on by `step`, zero from their size on."""
    at = np.arange(width)
    rows = flat[np.clip(begin[:, None] + step * at, 0, len(flat) - 1)]
    rows[at >= sizes[:, None]] = 0
    return np.ascontiguousarray(rows)


class _Strings(C.Entries):
    """Contexts with their smallest doc_id; the reply to one is a bit for each of its strings."""

    def __init__(self, length: int):
        self.length = length

    def reduce(self, payloads):
        length, got = self.length, [C.unpack_arrays(p) for p in payloads]
        flat = np.concatenate([x[1] for x in got])
        size = np.concatenate([x[2] for x in got]).astype(np.int64)
        left = np.concatenate([x[3] for x in got]).astype(np.int64)
        doc = np.concatenate([x[4][x[5]] for x in got])
        begin = np.cumsum(size) - size
        strings = size - length + 1
        order, common = _sorted_prefixes(_pad(flat, begin + left, size - left, -(-length // 8) * 8, 1), np.minimum(size - left, length))
        by_left, common_left = _sorted_prefixes(_pad(flat, begin + left - 1, left, -(-(length - ANCHOR) // 8) * 8, -1), left)
        tree = np.array(interval_tree(common.tolist(), ANCHOR), np.int64).reshape(-1, 4)
        verdict = np.zeros(len(size), np.uint32)
        lefts = np.empty(len(size), np.int64)
        for o in range(length - ANCHOR + 1):
            need = length - o
            own = tree[(tree[:, 0] >= need) & (tree[:, 1] < need)]
            if not len(own):
                continue
            n = own[:, 3] - own[:, 2] + 1
            member = order[np.repeat(own[:, 2] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            node = np.repeat(np.arange(len(own)), n)
            string = left[member] - o  # the string's number within the context
            has = (string >= 0) & (string < strings[member])
            member, node, string = member[has], node[has], string[has]
            lefts[by_left] = np.cumsum(common_left < o)
            key = node * (len(size) + 1) + lefts[member]
            by = np.argsort(key, kind="stable")
            if not len(by):
                continue
            k, d = key[by], doc[member[by]]
            head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            later = d > np.repeat(np.minimum.reduceat(d, head), np.diff(np.append(head, len(k))))
            verdict[member[by][later]] |= np.uint32(1) << string[by][later].astype(np.uint32)
        return [C.pack_arrays(x) for x in np.split(verdict, np.cumsum([len(x[2]) for x in got])[:-1])]

    @staticmethod
    def _met(payloads: list[bytes], deal: C.Deal, bundle: int):
        """Distinct contexts in order of bucket, their doc_ids, the context of each entry, where payloads end."""
        got = [C.unpack_arrays(p) for p in payloads]
        seen: dict[tuple[int, int, bytes], int] = {}
        use = []
        for within, flat, size, left, _, _ in got:
            raw, end = flat.tobytes(), np.cumsum(size, dtype=np.int64)
            for b, x, i, j in zip((within.astype(np.int64) + bundle * deal.span).tolist(), left.tolist(), (end - size).tolist(), end.tolist(), strict=True):
                use.append(seen.setdefault((b, x, raw[i:j]), len(seen)))
        order = sorted(range(len(seen)), key=[k[0] for k in seen].__getitem__)
        rank = np.empty(len(seen), np.int64)
        rank[order] = np.arange(len(seen))
        which = rank[np.array(use, np.int64)]
        doc = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(doc, which, np.concatenate([x[4][x[5]] for x in got]))
        contexts = list(seen)
        return [contexts[i] for i in order], doc, which, np.cumsum([len(x[2]) for x in got])[:-1]

    def fold(self, payloads, deal, bundle):
        contexts, doc, *_ = self._met(payloads, deal, bundle)
        own = C.Deal(deal.buckets, 1)
        return [(b, _payload(contexts[i:j], doc[i:j], own, b)) for b, (i, j) in own.runs(np.array([b for b, _, _ in contexts], np.int64)).items()]

    def spread(self, payloads, replies, deal, bundle):
        contexts, doc, which, ends = self._met(payloads, deal, bundle)
        found = np.concatenate([C.unpack_arrays(replies[b])[0] for b in C.bucket_runs(np.array([b for b, _, _ in contexts], np.int64))])
        own = np.concatenate([x[4][x[5]] for x in map(C.unpack_arrays, payloads)])
        # what the unit has earlier in the same context is earlier for all its strings
        all_strings = (np.uint64(1) << np.array([len(contexts[k][2]) - self.length + 1 for k in which], np.uint64)) - np.uint64(1)
        out = np.where(own > doc[which], all_strings.astype(np.uint32), found[which])
        return [C.pack_arrays(x) for x in np.split(out, ends)]


def _finish(length: int, anchors: C.Deal, buckets: C.Deal):
    def work(chunk: C.Chunk, replies: dict[str, dict[int, bytes]]) -> pa.Table:
        found = _Contexts(chunk, replies.get("anchor", {}), length, anchors, buckets)
        verdict = np.zeros(len(found.contexts), np.uint32)
        for b, data in replies.get("context", {}).items():
            verdict[slice(*found.runs[b])] = C.unpack_arrays(data)[0]
        edge = np.zeros(len(chunk.raw) + 1, np.int32)
        younger = chunk.ids[found.row] > found.doc[found.context] if len(found.row) else np.zeros(0, bool)
        n = found.strings[found.context] if len(found.row) else np.zeros(0, np.int64)
        np.add.at(edge, found.start[younger], 1)
        np.add.at(edge, found.start[younger] + n[younger] - 1 + length, -1)
        mask = verdict[found.context] if len(found.row) else np.zeros(0, np.uint32)
        for k in range(length - ANCHOR + 1):
            at = found.start[~younger & (((mask >> np.uint32(k)) & 1) > 0)] + k
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length, -1)
        removed = np.cumsum(edge[:-1]) > 0
        data = np.frombuffer(chunk.raw, np.uint8)
        rows = []
        for i, doc in enumerate(chunk.doc_ids()):
            a, b = chunk.starts[i], chunk.starts[i + 1]
            m = removed[a:b]
            kept = data[a:b][~m].tobytes()
            step = np.flatnonzero(np.diff(m.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            rows.append((doc, int(b - a), int(m.sum()), len(step), kept, hashlib.sha256(kept).hexdigest(), [{"start": int(x), "length": int(y - x)} for x, y in step]))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), OUT_ARROW, strict=True)], schema=OUT_ARROW)

    return work


def suffix_dedup(docs: DataFrame, length: int = 50) -> DataFrame:
    """Removes each byte covered by a string of `length` bytes that also starts in a document with a smaller doc_id.

    `length` is 24 to 55. Returns a row for each document: doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256
    and the removed runs (first byte, bytes).
    """
    if not ANCHOR <= length < ANCHOR + 32:
        raise ValueError(f"length is {ANCHOR} to {ANCHOR + 31}")
    chunks = C.chunked(docs)
    raw, n = C.size_of(chunks)
    dense = 2 * raw // (length - ANCHOR + 2)
    anchors, buckets = C.dealt(dense, ANCHORS_EACH), C.dealt(dense // 2, CONTEXTS_EACH)
    shared = C.reduce_buckets(chunks.mapInArrow(_emit_anchors(length, anchors), C.EMITTED), _ANCHORS, anchors, n)
    shared = C.materialise(shared.withColumn("kind", F.lit("anchor")), "shared-anchors")
    verdicts = C.reduce_buckets(C.with_replies(chunks, shared, _emit_contexts(length, anchors, buckets), C.EMITTED), _Strings(length), buckets, n)
    replies = shared.unionByName(verdicts.withColumn("kind", F.lit("context")))
    return C.with_replies(chunks, replies, _finish(length, anchors, buckets), OUT)


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """The maximal repeats of at least `least` bytes in a few texts, each with all its occurrences (text, start).

    A repeat is maximal if its occurrences differ to the left and to the right. Intervals of the common-prefix
    tree differ to the right; those are kept of which the left extensions are diverse (a text's start is unlike
    any other).
    """
    suffixes = sorted((t[i:], n, i) for n, t in enumerate(texts) for i in range(len(t)))
    common = [0] * len(suffixes)
    for k in range(1, len(suffixes)):
        a, b = suffixes[k - 1][0], suffixes[k][0]
        while common[k] < min(len(a), len(b)) and a[common[k]] == b[common[k]]:
            common[k] += 1
    found = defaultdict(list)
    for depth, _, first, last in interval_tree(common, max(1, least)):
        places = [(n, i) for _, n, i in suffixes[first : last + 1]]
        before = {texts[n][i - 1] if i else (n,) for n, i in places}
        if len(before) > 1:
            found[suffixes[first][0][:depth]] = sorted(places)
    return sorted(found.items())


def oracle(length: int = 50) -> str:
    """The digests by brute force, in DuckDB SQL: every string of every document."""
    return f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
g AS (SELECT doc_id, i, b[i:i + {length - 1}] AS win FROM d, unnest(range(1, octet_length(b) - {length - 2})) AS u(i)),
r AS (SELECT doc_id, i FROM g QUALIFY min(doc_id) OVER (PARTITION BY win) < doc_id),
s AS (SELECT doc_id, i, i > {length} + coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), {-2 * length}) AS new FROM r),
n AS (SELECT doc_id, i, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM s),
z AS (SELECT doc_id, span, min(i) AS a, max(i) + {length} AS e FROM n GROUP BY doc_id, span),
k AS (SELECT doc_id, count(*) AS n_spans, sum(e - a) AS n_removed FROM z GROUP BY doc_id),
y AS (SELECT d.doc_id, a, coalesce(lag(e) OVER o, 1) AS begin, a - 1 AS stop FROM d JOIN z ON z.doc_id = d.doc_id WINDOW o AS (PARTITION BY d.doc_id ORDER BY a)),
t AS (SELECT doc_id, begin, stop FROM y UNION ALL SELECT d.doc_id, coalesce(max(e), 1), octet_length(any_value(b)) FROM d LEFT JOIN z ON z.doc_id = d.doc_id GROUP BY d.doc_id),
h AS (SELECT t.doc_id, string_agg(CASE WHEN stop >= begin THEN hex(b[begin:stop]) ELSE '' END, '' ORDER BY begin) AS kept FROM t JOIN d ON d.doc_id = t.doc_id GROUP BY t.doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN h ON h.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""
