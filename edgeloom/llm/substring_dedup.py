"""Substring dedup over words by fixed-block anchors.

A repeat of `window` words holds a whole aligned block of window // 2 words of its earlier place, at any alignment. So:

1. *Index and probe.* Every document's non-overlapping blocks are indexed, and every rolling window of a block's
   length probes the index. A place is a hit if a block with its words is indexed and stands elsewhere too. Probes are
   known by hashes here: a hit may be false, and is then dropped by the next step.
2. *Extend.* Of the hits within a window of the full length the one with the smallest hash is its anchor; windows with
   equal words have equal anchors at equal offsets. A hit goes to its block's bucket with the words about it that its
   windows cover. There all places of a block are extended at once, word by word, to the right and to the left: places
   stay in one class as long as their words are the same (the words themselves, by a dictionary of the bucket). A window
   that begins `o` words before its block repeats where o words to the left and the rest to the right agree, and the
   smallest doc_id of the class tells whether it is earlier elsewhere.
3. *Merge.* Repeated windows that follow or overlap one another join into maximal exact repeats, which are removed. Which
   windows a chunk asked about travels with its contexts and back, so they are looked for once.

Nothing grows with the square of a group: a chunk sends each distinct context once, with its smallest doc_id, and gets
one bit a window back; beyond common.BUNDLES buckets a unit of chunks does so for all of them. A block with very many places (WIDE) would gather in one bucket, so its windows are dealt one by
one, by their own words. Within a chunk equal windows are found by two 64-bit hashes and compared word by word.

Defined cases: a null text has no words; a null doc_id sorts before all others; rows that share a doc_id count as
documents of the same age, so neither is "earlier" than the other, though each loses its own inner repeats; a very long
text is a chunk of its own, held by one task with its words (2 GB at most); repeats of equal length and place can't
tie, as places differ; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm import common as C

#: Anchors and contexts in one bucket, about; places (a chunk counts 127 at most) from which windows are dealt one by one.
ANCHORS_EACH, CONTEXTS_EACH, WIDE = 2_000_000, 50_000, 2_000
#: Places of a chunk whose anchors are sought at a time; windows that are compared at a time.
BLOCK, COMPARED = 1 << 20, 1 << 15
#: What the last step needs of a chunk goes to one of so many negative buckets; it has more arrays than a payload of contexts.
KEPT, KEPT_ARRAYS = 1_000_003, 8

OUT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string, repeats array<struct<start:long,length:long>>"
OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string()), ("repeats", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of the longest word that is hashed with others, eight bytes at a time.
SHORT = 64


def _hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each word data[offsets[i] : offsets[i + 1]], of its bytes alone."""
    at, size = offsets[:-1], np.diff(offsets)
    words = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    out = C.mix64(size)
    here = np.flatnonzero(size <= SHORT)
    for done in range(0, SHORT, 8):
        here = here[size[here] > done]
        if not len(here):
            break
        # bytes beyond the word's end are shifted out
        unused = (8 * np.maximum(0, done + 8 - size[here])).astype(np.uint64)
        out[here] = C.mix64(out[here] ^ (words[at[here] + done] << unused))
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = xxhash.xxh64_intdigest(data[offsets[i] : offsets[i + 1]].tobytes(), 7)
    return out


def _distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes of the values data[offsets[i] : offsets[i + 1]], and the distinct ones."""
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary


def _raw(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_binary array that begins with its buffers."""
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int64, len(values) + 1)
    return np.frombuffer(data or b"", np.uint8)[: ends[-1]], ends


class _Words:
    """The words of a chunk: codes (by a dictionary of the chunk), hashes, the row of each word and each row's first word."""

    def __init__(self, chunk: C.Chunk):
        self.chunk = chunk
        raw = np.frombuffer(chunk.raw, np.uint8)
        letter = ~_SPACE[raw]
        # a document's start divides words too: texts stand side by side
        begins, ends = letter.copy(), letter.copy()
        begins[1:] &= ~letter[:-1]
        ends[:-1] &= ~letter[1:]
        border = chunk.starts[(chunk.starts > 0) & (chunk.starts < len(raw))]
        begins[border] = letter[border]
        ends[border - 1] = letter[border - 1]
        at = np.flatnonzero(begins)
        sizes = np.flatnonzero(ends) + 1 - at
        self.codes, self.vocabulary = _distinct(raw[letter], np.concatenate([[0], np.cumsum(sizes)]))
        self.hashes = _hashes(*_raw(self.vocabulary))[self.codes] if len(self.codes) else np.zeros(0, np.uint64)
        self.first = np.searchsorted(at, chunk.starts)
        self.row = np.repeat(np.arange(len(chunk.sizes)), np.diff(self.first))

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places where a window lies within one document, and two hashes of each."""
        n = max(0, len(self.hashes) - width + 1)
        ok = self.row[:n] == self.row[width - 1 :] if n else np.zeros(0, bool)
        at = np.flatnonzero(ok)
        return at, C.rolling(self.hashes, width, C.BASES[0])[at], C.rolling(self.hashes, width, C.BASES[1])[at]


def _anchor_keys(h1: np.ndarray, h2: np.ndarray, anchors: C.Deal):
    key = ((h2 % np.uint64(anchors.buckets)) << np.uint64(32)) | (h1 >> np.uint64(32))
    return np.unique(key, return_inverse=True, return_counts=True)


def _payloads(chunk: int, out: list[tuple[int, bytes]]) -> dict[str, pa.Array]:
    return {"bucket": pa.array([b for b, _ in out], pa.int32()), "chunk": pa.array([chunk] * len(out), pa.int64()), "payload": pa.array([p for _, p in out], pa.binary())}


def _emit_anchors(block: int, anchors: C.Deal):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in C.Chunk.rows(batch):
                words = _Words(chunk)
                at, h1, h2 = words.windows(block)
                keys, inverse, count = _anchor_keys(h1, h2, anchors)
                aligned = (at - words.first[words.row[at]]) % block == 0
                indexed = np.zeros(len(keys), np.uint8)
                indexed[inverse[aligned]] = 1
                flags = indexed | (np.minimum(count, 127).astype(np.uint8) << 1)
                out = C.Keyed.payloads(anchors, keys, flags)
                yield pa.RecordBatch.from_pydict(_payloads(chunk.chunk, out))
        C.tidy()

    return emit


def _combine_anchors(flags: np.ndarray, head: np.ndarray, size: np.ndarray) -> tuple[np.ndarray]:
    places = np.minimum(np.add.reduceat((flags >> 1).astype(np.int64), head), WIDE)
    return ((np.bitwise_or.reduceat(flags, head) & 1).astype(np.uint32) | (places.astype(np.uint32) << 1),)


def _judge_anchors(flags: np.ndarray) -> np.ndarray:
    """0: no hit; 1: indexed, and at several places; 2: at very many."""
    places = flags >> 1
    return (((flags & 1) > 0) & (places > 1)).astype(np.uint8) * (1 + (places >= WIDE)).astype(np.uint8)


_ANCHORS = C.Keyed(_combine_anchors, _judge_anchors)


class _Contexts:
    """The windows of a chunk that hold a hit, which of them repeat within the chunk, and the contexts of their anchors.

    start, row: of each window; locally: does an earlier place within the chunk have its words; begins, each, use: of each run
    of windows that is in one context, its first window, their number and the context. contexts: (bucket, left, codes of the
    words) in order of bucket, doc: smallest doc_id of each.
    """

    def __init__(self, words: _Words, replies: dict[int, bytes], window: int, anchors: C.Deal, deal: C.Deal):
        buckets = deal.buckets
        block, n = window // 2, len(words.hashes)
        at, h1, h2 = words.windows(block)
        keys, inverse, _ = _anchor_keys(h1, h2, anchors)
        verdict, runs = np.zeros(len(keys), np.uint8), anchors.runs(keys >> np.uint64(32))
        for b, data in replies.items():
            verdict[slice(*runs[b])] = C.unpack_arrays(data)[0]
        state, order, far = np.zeros(n + 1, np.uint8), np.full(n + 1, ~np.uint64(0)), np.zeros(n + 1, np.uint64)
        state[at], order[at], far[at] = verdict[inverse], h1, h2
        del at, h1, h2, keys, inverse
        own, w1, w2 = words.windows(window)
        anchor = np.full(n, -1, np.int64)
        mask = np.uint64((1 << 22) - 1)
        reach = window - block + 1
        for begin in range(0, max(0, n - window + 1), BLOCK):
            part = slice(begin, min(n, begin + BLOCK + reach - 1))
            key = np.where(state[part] > 0, (order[part] & ~mask) | np.arange(part.stop - begin, dtype=np.uint64), ~np.uint64(0))
            if len(key) < reach:
                continue
            least = C.sliding_min(key, reach)
            anchor[begin : begin + len(least)] = np.where(least == ~np.uint64(0), -1, (least & mask).astype(np.int64) + begin)
        live = anchor[own] >= 0
        self.start, w1, w2 = own[live], w1[live], w2[live]
        self.row, anchor = words.row[self.start], anchor[self.start]
        self.ids = words.chunk.ids
        self.locally = self._repeated(words, window, w1, w2)

        # a run of windows with one anchor is a context; at a wide anchor each window is one
        wide = state[anchor] == 2
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (self.start[1:] != self.start[:-1] + 1) | wide[1:]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(anchor)) - 1 if len(first) else first
        bucket = np.where(wide[first], C.mix64(w1[first]) % np.uint64(buckets), far[anchor[first]] % np.uint64(buckets)).astype(np.int64)
        seen: dict[tuple[int, int, bytes], int] = {}
        begins, ends, lefts = self.start[first], self.start[last] + window, anchor[first] - self.start[first]
        raw, wide_of = words.codes.tobytes(), words.codes.itemsize
        use = np.fromiter((seen.setdefault((b, left, raw[i:j]), len(seen)) for b, left, i, j in zip(bucket.tolist(), lefts.tolist(), (begins * wide_of).tolist(), (ends * wide_of).tolist(), strict=True)), np.int64, len(first))
        contexts = list(seen)
        by = sorted(range(len(contexts)), key=[c[0] for c in contexts].__getitem__)
        rank = np.empty(len(contexts), np.int64)
        rank[by] = np.arange(len(contexts))
        self.contexts = [contexts[i] for i in by]
        self.sizes = np.array([len(c) // wide_of for _, _, c in self.contexts], np.int64)
        self.begins, self.each, self.use = begins, last - first + 1, rank[use] if len(use) else use
        self.doc = np.full(len(contexts), np.iinfo(np.int64).max)
        # a run's windows share the place of their anchor, so they are of one document
        np.minimum.at(self.doc, self.use, self.ids[self.row[first]])
        self.runs = deal.runs(np.array([b for b, _, _ in self.contexts], np.int64))

    def kept(self) -> bytes:
        """What the last step needs to know of the windows."""
        runs = [np.array(x, np.uint32) for x in (list(self.runs), [j for _, j in self.runs.values()])]
        narrow = [x.astype(np.uint32) for x in (np.diff(self.begins, prepend=0), self.each, self.use, self.sizes)]
        return C.pack_arrays(np.zeros(0, np.uint8), *narrow, np.packbits(self.locally), *runs)

    def _repeated(self, words: _Words, window: int, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        """Has an earlier place of the chunk (smaller doc_id, or the same row and an earlier start) the window's words?"""
        ids, row = self.ids[self.row], self.row
        for exact in (False, True):
            if exact:
                _, w1 = np.unique(words.codes[self.start[:, None] + np.arange(window)], axis=0, return_inverse=True)
                w2 = np.zeros(len(w1), np.int64)
            order = np.lexsort((self.start, row, ids, w1, w2))
            new = np.ones(len(order), bool)
            new[1:] = (w1[order][1:] != w1[order][:-1]) | (w2[order][1:] != w2[order][:-1])
            head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else order
            if exact or self._same(words.codes, self.start[order], self.start[order[head]], window):
                break
        out = np.zeros(len(order), bool)
        same_row = np.zeros(len(order), bool)
        same_row[1:] = ~new[1:] & (row[order][1:] == row[order][:-1])
        out[order] = same_row | (ids[order] > ids[order[head]]) if len(order) else False
        return out

    @staticmethod
    def _same(codes: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> bool:
        """Are the words of windows a[i] and b[i] the same, for every i?"""
        at = np.arange(window)
        other = np.flatnonzero(a != b)
        return all((codes[a[x][:, None] + at] == codes[b[x][:, None] + at]).all() for x in (other[i : i + COMPARED] for i in range(0, len(other), COMPARED)))


def _payload(contexts: list[tuple[int, int, bytes]], doc: np.ndarray, vocabulary: pa.Array, deal: C.Deal, bundle: int) -> bytes:
    """contexts: (bucket, left, codes of the words by the vocabulary, four bytes each)."""
    codes = np.frombuffer(b"".join(c for _, _, c in contexts), np.int32)
    there, number = np.zeros(len(vocabulary), bool), np.empty(len(vocabulary), np.int32)
    there[codes] = True
    used = np.flatnonzero(there)
    number[used] = np.arange(len(used))
    codes = number[codes]
    ids, which = np.unique(doc, return_inverse=True)
    names = vocabulary.take(pa.array(used))
    text = np.frombuffer(pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(names)]), names), pa.scalar(b"\n", pa.large_binary()))[0].as_buffer(), np.uint8)
    small = np.uint16 if len(used) < 65536 else np.uint32
    sizes, lefts = (np.array(x, np.uint32) for x in ([len(c) // 4 for _, _, c in contexts], [left for _, left, _ in contexts]))
    return C.pack_arrays(deal.within(np.array([b for b, _, _ in contexts], np.int64), bundle), text, codes.astype(small), sizes, lefts, ids, which.astype(np.uint32))


def _emit_contexts(window: int, anchors: C.Deal, buckets: C.Deal):
    def work(chunk: C.Chunk, replies: dict[str, dict[int, bytes]]) -> pa.Table:
        words = _Words(chunk)
        found = _Contexts(words, replies.get("anchor", {}), window, anchors, buckets)
        out = [(b, _payload(found.contexts[i:j], found.doc[i:j], words.vocabulary, buckets, b)) for b, (i, j) in found.runs.items()]
        # no bucket of contexts: it comes back as it is
        return pa.table(_payloads(chunk.chunk, [*out, (-1 - chunk.chunk % KEPT, found.kept())]))

    return work


def _refined(classes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Classes of equal (class, code)."""
    return np.unique(classes * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)[1]


def extended(codes: np.ndarray, begin: np.ndarray, size: np.ndarray, left: np.ndarray, doc: np.ndarray, window: int) -> list[np.ndarray]:
    """Extends all places of blocks at once; for each context, one entry a window: has a smaller doc_id its words?

    Context i is codes[begin[i] : begin[i] + size[i]], its block of window // 2 words begins left[i] words into it.
    """
    block = window // 2
    places = begin + left
    core = np.zeros(len(size), np.int64)
    for k in range(block):
        core = _refined(core, codes[places + k])

    def grow(step: int, most: np.ndarray, far: int) -> list[np.ndarray]:
        """Classes of the block with 0, 1, ... more words to one side; -1 where a context has no more words."""
        out = [core]
        for k in range(far):
            has = np.flatnonzero(most > k)
            new = np.full(len(size), -1, np.int64)
            if len(has):
                new[has] = _refined(out[-1][has], codes[places[has] + (block + k if step > 0 else -1 - k)])
            out.append(new)
        return out

    rest = window - block
    right, leftward = grow(1, size - left - block, rest), grow(-1, left, rest)
    each = size - window + 1
    place = np.cumsum(each) - each
    verdict = np.zeros(int(each.sum()), np.uint8)
    for o in range(rest + 1):
        has = np.flatnonzero((left >= o) & (size - left >= window - o))
        if not len(has):
            continue
        key = leftward[o][has] * (len(size) + 1) + right[rest - o][has]
        order = np.argsort(key, kind="stable")
        k, d = key[order], doc[has][order]
        head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        later = d > np.repeat(np.minimum.reduceat(d, head), np.diff(np.append(head, len(k))))
        late = has[order[later]]
        verdict[place[late] + left[late] - o] = 1
    return np.split(verdict, place[1:])


class _Places(C.Entries):
    """Contexts with their smallest doc_id; the reply to one is a bit for each of its windows."""

    def __init__(self, window: int):
        self.window = window

    @staticmethod
    def _words(got: list[list[np.ndarray]]) -> tuple[list[np.ndarray], pa.Array]:
        """Codes of each payload's words by one dictionary, whose values end with a line end."""
        text = np.frombuffer(b"".join(x[1].tobytes() + b"\n" for x in got), np.uint8)
        ends = np.flatnonzero(text == 10) + 1
        codes, names = _distinct(text, np.concatenate([[0], ends]))
        stops = np.searchsorted(ends, np.cumsum([len(x[1]) + 1 for x in got]), "right")
        return [codes[i:j].astype(np.int64)[x[2]] for i, j, x in zip([0, *stops[:-1]], stops, got, strict=True)], names

    def reduce(self, payloads):
        got = [C.unpack_arrays(p) for p in payloads]
        if len(got[0]) == KEPT_ARRAYS:
            return payloads
        codes, _ = self._words(got)
        size, left = (np.concatenate([x[k] for x in got]).astype(np.int64) for k in (3, 4))
        doc = np.concatenate([x[5][x[6]] for x in got])
        verdict = extended(np.concatenate(codes), np.cumsum(size) - size, size, left, doc, self.window)
        ends = np.cumsum([len(x[3]) for x in got])
        return [C.pack_arrays(np.packbits(np.concatenate(verdict[i:j]))) for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def _met(self, payloads: list[bytes], deal: C.Deal, bundle: int):
        """Distinct contexts in order of bucket, their doc_ids, the vocabulary; doc_id and context of each payload's entries."""
        got = [C.unpack_arrays(p) for p in payloads]
        codes, words = self._words(got)
        seen: dict[tuple[int, int, bytes], int] = {}
        use = []
        for own, (within, _, _, size, left, _, _) in zip(codes, got, strict=True):
            raw, end = own.astype(np.int32).tobytes(), np.cumsum(size, dtype=np.int64)
            for b, x, i, j in zip((within.astype(np.int64) + bundle * deal.span).tolist(), left.tolist(), (4 * (end - size)).tolist(), (4 * end).tolist(), strict=True):
                use.append(seen.setdefault((b, x, raw[i:j]), len(seen)))
        order = sorted(range(len(seen)), key=[k[0] for k in seen].__getitem__)
        rank = np.empty(len(seen), np.int64)
        rank[order] = np.arange(len(seen))
        which = rank[np.array(use, np.int64)]
        own_doc = np.concatenate([x[5][x[6]] for x in got])
        doc = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(doc, which, own_doc)
        contexts = list(seen)
        ends = np.cumsum([len(x[3]) for x in got])[:-1]
        return [contexts[i] for i in order], doc, pa.array([w[:-1] for w in words.to_pylist()], pa.large_binary()), np.split(own_doc, ends), np.split(which, ends)

    def fold(self, payloads, deal, bundle):
        contexts, doc, vocabulary, *_ = self._met(payloads, deal, bundle)
        own = C.Deal(deal.buckets, 1)
        return [(b, _payload(contexts[i:j], doc[i:j], vocabulary, own, b)) for b, (i, j) in own.runs(np.array([b for b, _, _ in contexts], np.int64)).items()]

    def spread(self, payloads, replies, deal, bundle):
        contexts, doc, _, own_doc, which = self._met(payloads, deal, bundle)
        each = [len(c) // 4 - self.window + 1 for _, _, c in contexts]
        verdict: list[np.ndarray] = []
        for b, (i, j) in C.bucket_runs(np.array([b for b, _, _ in contexts], np.int64)).items():
            bits = np.unpackbits(C.unpack_arrays(replies[b])[0], count=sum(each[i:j]))
            verdict += np.split(bits, np.cumsum(each[i:j])[:-1])
        # what the unit has earlier in the same context is earlier for all its windows
        return [C.pack_arrays(np.packbits(np.concatenate([np.ones_like(verdict[k]) if d > doc[k] else verdict[k] for d, k in zip(own.tolist(), at.tolist(), strict=True)]))) for own, at in zip(own_doc, which, strict=True)]


def _finish(window: int, *_: C.Deal):
    """The last step, from what _Contexts.kept() left and the verdicts on its contexts; it looks for no windows again."""

    def work(chunk: C.Chunk, replies: dict[str, dict[int, bytes]]) -> pa.Table:
        got = replies["context"]
        _, step, each, use, sizes, locally, bundles, stops = C.unpack_arrays(got[-1 - chunk.chunk % KEPT])
        begins, each, use = np.cumsum(step, dtype=np.int64), each.astype(np.int64), use.astype(np.int64)
        windows = sizes.astype(np.int64) - window + 1
        place = np.cumsum(windows) - windows
        verdict = np.zeros(int(windows.sum()), bool)
        for b, i, j in zip(bundles.tolist(), [0, *stops.tolist()][:-1], stops.tolist(), strict=True):
            n = int(windows[i:j].sum())
            verdict[place[i] : place[i] + n] = np.unpackbits(C.unpack_arrays(got[b])[0], count=n).astype(bool)
        # a window's number within its run
        number = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        again = np.unpackbits(locally, count=len(number)).astype(bool) | verdict[np.repeat(place[use], each) + number]
        gone = (np.repeat(begins, each) + number)[again]
        split = [text.split() for text in chunk.texts()]
        first = np.concatenate([[0], np.cumsum([len(ws) for ws in split])])
        edge = np.zeros(int(first[-1]) + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + window, -1)
        removed = np.cumsum(edge[:-1]) > 0
        rows = []
        for i, (doc, ws) in enumerate(zip(chunk.doc_ids(), split, strict=True)):
            mask = removed[first[i] : first[i + 1]]
            kept = b" ".join(compress(ws, ~mask) if mask.any() else ws)
            step = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
            rows.append((doc, len(ws), int(mask.sum()), kept.decode(), hashlib.sha256(kept).hexdigest(), [{"start": int(a), "length": int(b - a)} for a, b in step.reshape(-1, 2)]))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), OUT_ARROW, strict=True)], schema=OUT_ARROW)

    return work


def substring_dedup(docs: DataFrame, window: int = 20) -> DataFrame:
    """Removes every word covered by a window of `window` words that also starts earlier. See the module for cases.

    Returns a row for each document: doc_id, n_words, n_removed, kept_text, kept_sha256 and the removed maximal
    repeats (first word, words).
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    chunks = C.chunked(docs)
    raw, n = C.size_of(chunks)
    # a word and its space take two bytes at least, five or more in prose; a context's windows are some
    anchors, buckets = C.dealt(raw // 5, ANCHORS_EACH), C.dealt(raw // 80, CONTEXTS_EACH)
    hits = C.reduce_buckets(chunks.mapInArrow(_emit_anchors(window // 2, anchors), C.EMITTED), _ANCHORS, anchors, n)
    hits = C.materialise(hits.withColumn("kind", F.lit("anchor")), "anchor-hits")
    earlier = C.reduce_buckets(C.with_replies(chunks, hits, _emit_contexts(window, anchors, buckets), C.EMITTED), _Places(window), buckets, n)
    return C.with_replies(chunks, earlier.withColumn("kind", F.lit("context")), _finish(window), OUT)


def oracle(window: int = 20) -> str:
    """The digests by brute force, in DuckDB SQL: every window of every document."""
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i:i + {window - 1}], ' ') AS win FROM w, unnest(range(1, len(words) - {window - 2})) AS u(i)),
r AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1),
x AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + {window})) AS p FROM r)),
p AS (SELECT w.doc_id, u.p, words[u.p] AS word FROM w, unnest(range(1, len(words) + 1)) AS u(p)),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.p) AS kept, count(*) AS n FROM p ANTI JOIN x ON x.doc_id = p.doc_id AND x.p = p.p GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
