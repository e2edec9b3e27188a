"""Exact token ids of whole texts by the tokenizers library, with a cache of pieces.

A byte-level tokenizer divides a text by a fixed pattern before it joins characters. Where the pattern always ends a
unit, whatever stands around (`_UNITS`), a text may be cut: its ids are those of its pieces, and a piece that was met
before needs no encoding. Pieces are found and looked up by numpy for a group of texts at once; new ones are encoded
together. Texts with white space or control characters beyond ASCII's usual ones, or with an added token's text, and
texts of other tokenizers, are encoded whole.

The table of pieces compares their bytes, so it is exact. It is emptied when it holds CACHE pieces, so memory is
bounded.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession
from tokenizers import Tokenizer, pre_tokenizers, processors

from edgeloom.llm.common import ship, tidy

#: Pieces that a table holds before it is emptied; pieces looked up at once; characters of a group of texts; pieces of
#: one call of the tokenizer. CACHE and BLOCK together fill half of the table.
CACHE, BLOCK, GROUP, TOGETHER = 640_000, 400_000, 1 << 21, 1000
#: Bytes of the longest piece in the table of pieces; the key's last byte is the piece's length.
SHORT = 23
#: Texts with these are encoded whole: white space beyond ASCII's, and controls that some count as white space.
_WHOLE = re.compile(r"[\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]")
_encoders: dict[int, Encoder] = {}

def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet by its rule: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_ALPHABET = _byte_alphabet()


def _is_word(p: str) -> bool:
    """Letters only, of scripts in which all versions of Unicode agree on what is a letter."""
    return p.isalpha() and (p.isascii() or max(p) < "\u0250")


#: Code points of the byte-level alphabet by byte, and which code points of two bytes _is_word() takes for letters.
_CODES = np.array([ord(_ALPHABET[b]) for b in range(256)], "<u4")
_LETTERS = np.array([_is_word(chr(c)) for c in range(0x280)])
#: Kinds of bytes.
OTHER, SPACE, LETTER, DIGIT, SIGN, QUOTE = range(6)


def _kinds() -> np.ndarray:
    def kind(c: str) -> int:
        if c in "\t\n\v\f\r ":
            return SPACE
        if not "!" <= c <= "~":
            return OTHER
        return LETTER if c.isalpha() else DIGIT if c.isdigit() else QUOTE if c == "'" else SIGN

    return np.array([kind(chr(b)) for b in range(256)], np.uint8)


def _units() -> np.ndarray:
    """Is there always a border between bytes of kinds a and b, at a * 6 + b?"""
    borders = [(LETTER, DIGIT), (DIGIT, LETTER), (LETTER, SIGN), (SIGN, LETTER), (DIGIT, SIGN), (SIGN, DIGIT), (LETTER, QUOTE), (DIGIT, QUOTE), (QUOTE, DIGIT)]
    out = np.zeros(36, bool)
    out[[a * 6 + b for a, b in borders] + [a * 6 + SPACE for a in range(6) if a != SPACE]] = True
    return out


_KINDS, _UNITS = _kinds(), _units()
#: Masks that keep the first n bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def borders(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces begin, in the bytes of texts that begin at starts."""
    kind = _KINDS[raw]
    cut = np.zeros(len(raw), bool)
    cut[1:] = _UNITS[kind[:-1] * np.uint8(6) + kind[1:]]
    # a line end that stands alone is a unit
    line = np.flatnonzero(raw[1:-1] == 10) + 1
    cut[line[(kind[line - 1] != SPACE) & (kind[line + 1] != SPACE)] + 1] = True
    cut[starts[starts < len(raw)]] = True
    return np.flatnonzero(cut)


def keys_of(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Pieces of up to SHORT bytes as three words each, their size in the last byte; raw has 24 bytes more at its end."""
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    out = np.empty((len(at), 3), np.uint64)
    for i in range(3):
        out[:, i] = words[at + 8 * i] & _FIRST[np.clip(size - 8 * i, 0, 8)]
    out[:, 2] |= size.astype(np.uint64) << np.uint64(56)
    return out


def hashed(keys: np.ndarray) -> np.ndarray:
    h = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ keys[:, 2] * np.uint64(0x165667B19E3779F9)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """A table from keys to places of their ids: open addressing, all keys of a group at once."""

    def __init__(self, bits: int = 21):
        self.bits = bits
        self.keys = np.zeros((1 << bits, 3), np.uint64)
        self.entry = np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (hashed(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's entry, -1 where there is none."""
        out = np.full(len(keys), -1, np.int32)
        open_, slot = np.arange(len(keys)), self._slots(keys)
        while len(open_):
            there = self.keys.take(slot, axis=0)
            same = (there == keys[open_]).all(axis=1) if len(open_) < len(keys) else (there[:, 0] == keys[:, 0]) & (there[:, 1] == keys[:, 1]) & (there[:, 2] == keys[:, 2])
            out[open_[same]] = self.entry[slot[same]]
            more = np.flatnonzero(~same & (there[:, 2] != 0))
            open_, slot = open_[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray, entry: np.ndarray) -> None:
        """Different keys that the table doesn't hold; the table stays at most half full."""
        open_, slot = np.arange(len(keys)), self._slots(keys)
        while len(open_):
            free = self.keys[slot, 2] == 0
            self.entry[slot[free]] = open_[free]
            won = free.copy()
            won[free] = self.entry[slot[free]] == open_[free]
            self.keys[slot[won]] = keys[open_[won]]
            self.entry[slot[won]] = entry[open_[won]]
            open_, slot = open_[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)


class Encoder:
    """Ids of texts, as the bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, spec: str):
        self.tokenizer = Tokenizer.from_str(spec)
        self.vocabulary = self.tokenizer.get_vocab_size()
        known = json.loads(spec)
        pre = known.get("pre_tokenizer") or {}
        added = known.get("added_tokens", [])
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.added = [t["content"] for t in added]
        #: A special token parts the text about it, so many pieces can be encoded at once and told apart.
        self.mark = next(((t["content"], t["id"]) for t in added if t.get("special")), None)
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not known.get("normalizer") and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in added)
        #: The same model without a step before it, for words that are divided already.
        self.divided, self.line_end = None, self.tokenizer.token_to_id("\u010a")
        if self.cuts and self.line_end is not None and len(self._each(["\n"])[0]) == 4:
            self.divided = Tokenizer.from_str(spec)
            self.divided.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            self.divided.post_processor = processors.Sequence([])
            self.divided_batch = getattr(self.divided, "encode_batch_fast", self.divided.encode_batch)
        self._forget()

    def _forget(self) -> None:
        """Empties the table; entry i has ids[at[i] : at[i] + n[i]]."""
        self.pieces = Pieces()
        self.long: dict[bytes, int] = {}
        self.known = self.used = 0
        self.at, self.n, self.arena = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, "<u4")

    def _store(self, ids: list[bytes]) -> np.ndarray:
        """Entries for the ids of new pieces."""
        return self._put(np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4)

    def _put(self, flat: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The same, of the ids side by side and their number for each piece."""
        for name, need in (("at", self.known + len(n)), ("n", self.known + len(n)), ("arena", self.used + len(flat))):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(need, old.dtype)]))
        entry = np.arange(self.known, self.known + len(n), dtype=np.int32)
        self.n[entry], self.at[entry] = n, self.used + np.cumsum(n) - n
        self.arena[self.used : self.used + len(flat)] = flat
        self.known, self.used = self.known + len(n), self.used + len(flat)
        return entry

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for i in range(0, len(texts), 64) for e in self.batch(texts[i : i + 64], add_special_tokens=False)]

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of short texts, by one call for many of them. They hold no added token."""
        if not self.mark:
            return self._each(pieces)
        text, number = self.mark
        out: list[bytes] = []
        for i in range(0, len(pieces), TOGETHER):
            own = pieces[i : i + TOGETHER]
            joined = text.join(own)
            if joined.count(text) != len(own) - 1:  # one begins or ends with a part of it
                out += self._each(own)
                continue
            out += self._parted(self.batch([joined], add_special_tokens=False)[0].ids, number, True)
        return out

    @staticmethod
    def _parted(ids: list[int], number: int, last: bool) -> list[bytes]:
        """Ids between those equal to number, and the ones after the last of them if asked for."""
        own = np.array(ids, "<u4")
        ends = (np.flatnonzero(own == number) * 4).tolist()
        raw, at, out = own.tobytes(), 0, []
        for e in [*ends, len(raw)] if last else ends:
            out.append(raw[at:e])
            at = e + 4
        return out

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, some after a space. Such a word is one unit of the model, so the text is handed
        over in the model's own alphabet, already divided, with line ends between words."""
        out: list[bytes] = []
        for i in range(0, len(words), TOGETHER):
            joined = "\n".join(words[i : i + TOGETHER])
            if not joined.isascii():
                joined = "\n".join(w if w.isascii() else w.encode().decode("latin-1").translate(_ALPHABET) for w in joined.split("\n")).replace(_ALPHABET[32], " ")
            joined = joined.replace(" ", "\u0120").replace("\n", " \u010a ") + " \u010a"
            out += self._parted(self.divided_batch([joined], add_special_tokens=False)[0].ids, self.line_end, False)
        return out

    def _learn_words(self, joined: np.ndarray, size: np.ndarray) -> np.ndarray:
        """_encode_words() of the bytes of words, a line end after each; returns their entries."""
        ends = np.cumsum(size + 1)
        flat, counts = [], []
        for i in range(0, len(size), TOGETHER):
            own = _CODES[joined[ends[i] - size[i] - 1 : ends[min(i + TOGETHER, len(size)) - 1] - 1]].tobytes().decode("utf-32-le")
            ids = np.array(self.divided_batch([own.replace("\u010a", " \u010a ") + " \u010a"], add_special_tokens=False)[0].ids, "<u4")
            mark = ids == self.line_end
            flat.append(ids[~mark])
            counts.append(np.diff(np.flatnonzero(mark), prepend=-1) - 1)
        return self._put(np.concatenate(flat), np.concatenate(counts))

    def _learn_at(self, raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Encodes new pieces raw[at[i] : at[i] + size[i]]; returns their entries. Words stay arrays until they are handed over."""
        ends = np.cumsum(size + 1)
        starts = ends - size - 1
        joined = raw[np.arange(ends[-1]) - np.repeat(starts - at, size + 1)]
        joined[ends - 1] = 10
        letter = _KINDS[joined] == LETTER
        lead = np.flatnonzero((joined >= 0xC2) & (joined <= 0xC9))
        lead = lead[_LETTERS[((joined[lead] & 31).astype(np.int64) << 6) | (joined[lead + 1] & 63)]]
        letter[lead] = letter[lead + 1] = True
        spaced = joined[starts] == 32
        # as _is_word() has it, but for a space before and the line end
        word = (np.add.reduceat(~letter, starts, dtype=np.int64) == 1 + spaced) & (size > spaced) & (self.divided is not None)
        out = np.empty(len(at), np.int32)
        if word.any():
            out[word] = self._learn_words(joined[np.repeat(word, size + 1)], size[word])
        rest = np.flatnonzero(~word)
        if len(rest):
            out[rest] = self._learn([joined[a:b].tobytes() for a, b in zip(starts[rest].tolist(), (ends[rest] - 1).tolist(), strict=True)])
        return out

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Encodes new pieces; returns their entries."""
        texts = [p.decode() for p in pieces]
        word = [_is_word(t[1:] if t[0] == " " else t) for t in texts] if self.divided else [False] * len(texts)
        words = iter(self._encode_words([t for t, w in zip(texts, word, strict=True) if w]))
        other = iter(self._encode([t for t, w in zip(texts, word, strict=True) if not w]))
        return self._store([next(words) if w else next(other) for w in word])

    def _entries(self, raw: bytes, padded: np.ndarray, keys: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The entries of pieces; new ones are learned."""
        out = np.full(len(at), -1, np.int32)
        short = np.flatnonzero(size <= SHORT)
        found = self.pieces.find(keys[short])
        miss = short[found < 0]
        out[short] = found
        if len(miss):
            # equal keys stand together; if others of the same hash part them, a piece is learned twice
            miss = miss[np.argsort(hashed(keys[miss]))]
            first = np.ones(len(miss), bool)
            first[1:] = (keys[miss[1:]] != keys[miss[:-1]]).any(axis=1)
            new = miss[first]
            made = self._learn_at(padded, at[new], size[new])
            self.pieces.add(keys[new], made)
            out[miss] = made[np.cumsum(first) - 1]
        far = np.flatnonzero(size > SHORT)
        if len(far):
            own = [raw[a:b] for a, b in zip(at[far].tolist(), (at[far] + size[far]).tolist(), strict=True)]
            fresh = [p for p in dict.fromkeys(own) if p not in self.long]
            if fresh:
                self.long.update(zip(fresh, self._learn(fresh).tolist(), strict=True))
            out[far] = [self.long[p] for p in own]
        return out

    def _flat(self, raw: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Of joined texts that begin at starts: where pieces begin, numbers of ids before each (and of all), the ids."""
        padded = np.frombuffer(raw + bytes(24), np.uint8)
        at = borders(padded[: len(raw)], starts)
        size = np.diff(at, append=len(raw))
        counts, flat = [], []
        for i in range(0, len(at), BLOCK):
            if self.known > CACHE:
                self._forget()
            own, width = at[i : i + BLOCK], size[i : i + BLOCK]
            entry = self._entries(raw, padded, keys_of(padded, own, width), own, width)
            n = self.n[entry]
            ends = np.cumsum(n)
            flat.append(self.arena[np.repeat(self.at[entry] - ends + n, n) + np.arange(ends[-1])].tobytes())
            counts.append(n)
        return at, np.concatenate([[0], np.cumsum(np.concatenate(counts))]), b"".join(flat)

    def ids(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self._each(texts)
        whole = [(not t.isascii() or "\x1c" in t or "\x1d" in t or "\x1e" in t or "\x1f" in t) and _WHOLE.search(t) is not None or any(a in t for a in self.added) for t in texts]
        parts = [b"" if w else t.encode() for t, w in zip(texts, whole, strict=True)]
        apart = iter(self._each([t for t, w in zip(texts, whole, strict=True) if w]))
        ends = np.cumsum([len(p) for p in parts])
        raw = b"".join(parts)
        if not raw:
            return [next(apart) if w else b"" for w in whole]
        at, before, flat = self._flat(raw, ends - [len(p) for p in parts])
        stops = (before[np.searchsorted(at, ends)] * 4).tolist()
        return [next(apart) if w else flat[a:b] for w, a, b in zip(whole, [0, *stops[:-1]], stops, strict=True)]

    def stream(self, texts: Iterable[str], keep: bool = False) -> Iterator[bytes]:
        """ids() of many texts, in groups of about GROUP characters. keep: the worker's next task finds the pieces again; the
        table stays as small as it is within a task, but the worker holds it (some 80 MB) as long as it lives."""
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= GROUP:
                yield from self.ids(held)
                held, size = [], 0
        yield from self.ids(held)
        if not keep:
            self._forget()  # workers live on
        tidy()


def share(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer's file, read by the driver: its size is that of a vocabulary, whatever the corpus."""
    ship(spark)
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encoder(spec: Broadcast) -> Encoder:
    """The worker's encoder of a shared file; one for each process."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = hash(spec.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec.value)
    return _encoders[key]
