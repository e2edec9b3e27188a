"""What the operators share: the shared folder, materialised tables, words and packed chunks.

Texts travel in *chunks*: rows of a few MB that hold many documents, compressed, so that numpy works on
whole arrays and an exchange moves packed arrays instead of a row for every word or byte.
"""

from __future__ import annotations

import contextlib
import ctypes
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.sources.shared import discard, materialise, new_path, ship  # noqa: F401

#: Bytes of text in a chunk, at most, unless one document is longer.
CHUNK_BYTES = 4 << 20
#: Sorts before every id: what a null doc_id counts as.
NULL_ID = np.int64(-(2**63))
#: White space between words, as a character class.
SPACE = r"\x20\x09-\x0D"

CHUNKS = "chunk long, ids array<bigint>, sizes array<int>, raw long, blob binary"
_Z = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct; `select("row.*")` gives them back."""
    return F.struct(*[column(c) for c in df.columns])


#: A key with more than this share of all rows is hot.
HOT_SHARE = 0.001


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, n_rows: str) -> DataFrame:
    """rows joined (inner) to the one row of per_key for their key; a null key meets a null key.

    per_key, a written table whose other columns rows has not, tells in n_rows how many rows have a key. Hot keys, of which there are fewer than
    1 / HOT_SHARE whatever the input, are broadcast, so their rows stay where they are; the others are dealt by key,
    and none of them has more than HOT_SHARE of the rows.
    """
    total = per_key.agg(F.sum(n_rows).alias("n")).first()["n"] or 0
    is_hot = F.col(n_rows) > F.lit(HOT_SHARE * total)
    named = lambda df, own: df.select(*[F.col(c).alias(own if c == key else c) for c in per_key.columns])
    hot, other = named(per_key.where(is_hot), "_hot"), named(per_key.where(~is_hot), "_other")
    same = lambda own: F.col(key).eqNullSafe(F.col(own))
    at_once = rows.join(F.broadcast(hot), same("_hot")).drop("_hot")
    rest = rows.join(F.broadcast(hot.select("_hot")), same("_hot"), "left_anti")
    return at_once.unionByName(rest.join(other, same("_other")).drop("_other"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it, also within functions of elements."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ of a text; empty for null."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^[{SPACE}]+|[{SPACE}]+\z", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, rf"[{SPACE}]+"))


def tidy() -> None:
    """Gives memory that a Python worker has freed back to the machine; workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def squeeze(data: bytes, level: int = 1) -> bytes:
    z = _Z.get(level) or _Z.setdefault(level, zstandard.ZstdCompressor(level=level))
    return z.compress(data)


def unsqueeze(data: bytes) -> bytes:
    z = _Z.get("d") or _Z.setdefault("d", zstandard.ZstdDecompressor())
    return z.decompress(data)


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Numpy arrays as one compressed value; wide integers are stored by byte planes, which compress better."""
    parts = [np.uint8(len(arrays)).tobytes()]
    body = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(a.dtype.str.encode().ljust(4) + np.uint64(a.size).tobytes())
        body.append(a.view(np.uint8).reshape(a.size, a.itemsize).T.tobytes() if a.itemsize > 1 and a.size else a.tobytes())
    return squeeze(b"".join(parts + body))


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    raw = unsqueeze(data)
    n, at = raw[0], 1
    heads = []
    for _ in range(n):
        heads.append((np.dtype(raw[at : at + 4].decode().strip()), int(np.frombuffer(raw, np.uint64, 1, at + 4)[0])))
        at += 12
    out = []
    for kind, size in heads:
        flat = np.frombuffer(raw, np.uint8, size * kind.itemsize, at)
        at += size * kind.itemsize
        out.append(np.ascontiguousarray(flat.reshape(kind.itemsize, size).T).view(kind).ravel() if kind.itemsize > 1 else flat.view(kind))
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def rolling(symbols: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of every window of `width` symbols (uint64); base is odd."""
    n = len(symbols)
    if n < width:
        return np.zeros(0, np.uint64)
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * powers, out=sums[1:])
    inverse = np.full(n - width + 1, pow(base, -1, 2**64), np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    return mix64((sums[width:] - sums[:-width]) * inverse)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    m, have = x, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(x) - width + 1], m[width - have : len(x) - have + 1]) if have < width else m


#: Bases of two independent rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def chunked(docs: DataFrame) -> DataFrame:
    """Rows (chunk, ids, sizes, raw, blob): the texts of many documents, UTF-8, joined and compressed.

    Null texts are empty, a null doc_id becomes NULL_ID. The table is written, so chunk numbers stay as they are.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def row() -> pa.RecordBatch:
            nonlocal n, ids, texts, size
            blob = b"".join(texts)
            out = {"chunk": [(part << 32) + n], "ids": [ids], "sizes": [[len(t) for t in texts]], "raw": [len(blob)], "blob": [squeeze(blob, 3)]}
            n, ids, texts, size = n + 1, [], [], 0
            return pa.RecordBatch.from_pydict(out, SCHEMA)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "replace")
                if ids and size + len(raw) > CHUNK_BYTES:
                    yield row()
                ids.append(int(NULL_ID) if doc is None else doc)
                texts.append(raw)
                size += len(raw)
        if ids:
            yield row()
        tidy()

    SCHEMA = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("raw", pa.int64()), ("blob", pa.binary())])
    ship(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(slim.mapInArrow(pack, CHUNKS), "chunks")


class Chunk:
    """One row of chunked(): ids and sizes as arrays, raw as bytes."""

    def __init__(self, chunk: int, ids, sizes, blob: bytes):
        self.chunk, self.raw = chunk, unsqueeze(blob)
        self.ids, self.sizes = np.asarray(ids, np.int64), np.asarray(sizes, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    @classmethod
    def rows(cls, data) -> Iterator[Chunk]:
        """data: a record batch or table with the columns of CHUNKS."""
        names = data.schema.names
        at = {k: names.index(k) for k in ("chunk", "ids", "sizes", "blob")}
        for i in range(data.num_rows):
            yield cls(data.column(at["chunk"])[i].as_py(), data.column(at["ids"])[i].values.to_numpy(), data.column(at["sizes"])[i].values.to_numpy(), data.column(at["blob"])[i].as_py())

    def texts(self) -> Iterator[bytes]:
        for a, b in zip(self.starts[:-1], self.starts[1:], strict=True):
            yield self.raw[a:b]

    def doc_ids(self) -> list[int | None]:
        return [None if x == NULL_ID else int(x) for x in self.ids]


EMITTED = "bucket int, chunk long, payload binary"
REPLIES = "chunk long, bucket int, payload binary"


def bucket_runs(bucket: np.ndarray) -> dict[int, tuple[int, int]]:
    """Where each bucket starts and ends in an array sorted by bucket.

    Only buckets that are there are visited: their number in all grows with the corpus, a chunk's share doesn't.
    """
    if not len(bucket):
        return {}
    head = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.append(head[1:], len(bucket))
    return dict(zip(bucket[head].tolist(), zip(head.tolist(), ends.tolist(), strict=True), strict=True))


class Deal(NamedTuple):
    """Entries by bucket, in two levels: `span` buckets make a bundle, and chunks send a payload to each bundle.

    A chunk's share of a bucket shrinks as buckets grow in number, its share of a bundle doesn't: there are BUNDLES at most.
    """

    buckets: int
    span: int

    def runs(self, bucket: np.ndarray) -> dict[int, tuple[int, int]]:
        """Where each bundle starts and ends in an array sorted by bucket."""
        return bucket_runs(bucket // bucket.dtype.type(self.span)) if self.span > 1 else bucket_runs(bucket)

    def within(self, bucket: np.ndarray, bundle: int) -> np.ndarray:
        """A payload's buckets, counted within its bundle; nothing where a bundle is one bucket."""
        return (bucket - bucket.dtype.type(bundle * self.span)).astype(np.uint32) if self.span > 1 else np.zeros(0, np.uint32)


#: Payloads that a chunk sends, at most.
BUNDLES = 8192


def dealt(entries: int, each: int) -> Deal:
    """Buckets for so many entries; 64 at least, so that small inputs are dealt evenly too."""
    buckets = max(64, -(-entries // each))
    return Deal(buckets, -(-buckets // BUNDLES))


class Entries(ABC):
    """Entries that meet in a bucket. Payloads hold those of a chunk, or of a unit (many chunks), each one once."""

    @abstractmethod
    def reduce(self, payloads: list[bytes]) -> list[bytes]:
        """The replies to the payloads of one bucket."""

    @abstractmethod
    def fold(self, payloads: list[bytes], deal: Deal, bundle: int) -> list[tuple[int, bytes]]:
        """The distinct entries of a unit's payloads to a bundle, as a payload for each bucket."""

    @abstractmethod
    def spread(self, payloads: list[bytes], replies: dict[int, bytes], deal: Deal, bundle: int) -> list[bytes]:
        """The replies to those payloads, from the buckets' replies to what fold() made of them."""


class Keyed(Entries):
    """Entries of a key and values. combine(sorted values..., heads, sizes) gives the values of each distinct key, judge() its reply."""

    def __init__(self, combine: Callable[..., tuple[np.ndarray, ...]], judge: Callable[..., np.ndarray]):
        self.combine, self.judge = combine, judge

    @staticmethod
    def payloads(deal: Deal, keys: np.ndarray, *values: np.ndarray) -> list[tuple[int, bytes]]:
        """keys: distinct, sorted, bucket << 32 | the rest."""
        bucket, low = keys >> np.uint64(32), keys.astype(np.uint32)
        return [(b, pack_arrays(deal.within(bucket[i:j], b), np.diff(low[i:j], prepend=np.uint32(0)), *(v[i:j] for v in values))) for b, (i, j) in deal.runs(bucket).items()]

    def _met(self, payloads: list[bytes]):
        """Distinct keys (buckets counted within the bundle), their values, the key of each entry, where payloads end."""
        got = [unpack_arrays(p) for p in payloads]
        low = np.concatenate([np.cumsum(x[1], dtype=np.uint32) for x in got])
        within = np.concatenate([x[0] for x in got])
        keys = (within.astype(np.uint64) << np.uint64(32)) | low if len(within) else low
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        head = np.flatnonzero(new)
        which = np.empty(len(s), np.int64)
        which[order] = np.cumsum(new) - 1
        values = self.combine(*(np.concatenate(v)[order] for v in list(zip(*got, strict=True))[2:]), head, np.diff(np.append(head, len(s))))
        return s[head].astype(np.uint64), values, which, np.cumsum([len(x[1]) for x in got])[:-1]

    def reduce(self, payloads):
        _, values, which, ends = self._met(payloads)
        return [pack_arrays(x) for x in np.split(self.judge(*values)[which], ends)]

    def fold(self, payloads, deal, bundle):
        keys, values, *_ = self._met(payloads)
        # each of these buckets is a bundle of its own from here on
        return Keyed.payloads(Deal(deal.buckets, 1), keys + (np.uint64(bundle * deal.span) << np.uint64(32)), *values)

    def spread(self, payloads, replies, deal, bundle):
        keys, _, which, ends = self._met(payloads)
        found = np.concatenate([unpack_arrays(replies[b])[0] for b in bucket_runs((keys >> np.uint64(32)) + np.uint64(bundle * deal.span))])
        return [pack_arrays(x) for x in np.split(found[which], ends)]


def reduce_buckets(emitted: DataFrame, entries: Entries, deal: Deal, chunks: int) -> DataFrame:
    """Brings the payloads of a bucket together and returns a reply for each payload that was emitted.

    The number of buckets follows the input, so a bucket has bounded size. Where a bundle is one bucket, payloads go there
    at once. Else as many chunks as a bundle has buckets make a unit; a unit's payloads to a bundle meet first, and are dealt on to the
    bundle's buckets with each distinct entry once. So a payload's size depends on the chunks' size and not on the input's, and an
    entry that every chunk holds costs its bucket one entry a unit. A negative bucket belongs to no bundle: its payloads
    are reduced, and never folded.
    """

    def by_chunk(group: pa.Table) -> pa.Table:
        return group.take(pa.array(np.argsort(group.column("chunk").to_numpy(), kind="stable")))

    def bytes_of(group: pa.Table) -> list[bytes]:
        return [x.as_py() for x in group.column("payload")]

    def work(group: pa.Table) -> pa.Table:
        group = by_chunk(group)
        replies = entries.reduce(bytes_of(group))
        return pa.table({"chunk": group.column("chunk"), "bucket": group.column("bucket"), "payload": pa.array(replies, pa.binary())})

    def fold(group: pa.Table) -> pa.Table:
        unit, bundle = group.column("unit")[0].as_py(), group.column("bucket")[0].as_py()
        out = entries.fold(bytes_of(by_chunk(group)), deal, bundle)
        return pa.table({"bucket": pa.array([b for b, _ in out], pa.int32()), "chunk": pa.array([unit] * len(out), pa.int64()), "payload": pa.array([p for _, p in out], pa.binary())})

    def spread(group: pa.Table, found: pa.Table) -> pa.Table:
        group = by_chunk(group)
        replies = dict(zip(found.column("bucket").to_pylist(), bytes_of(found), strict=True))
        out = entries.spread(bytes_of(group), replies, deal, group.column("bucket")[0].as_py())
        return pa.table({"chunk": group.column("chunk"), "bucket": group.column("bucket"), "payload": pa.array(out, pa.binary())})

    if deal.span == 1:
        return emitted.groupBy("bucket").applyInArrow(work, REPLIES)
    units = -(-chunks // deal.span)
    emitted = materialise(emitted.withColumn("unit", F.pmod(F.xxhash64("chunk"), F.lit(units)).cast("bigint")), "unit-entries")
    kept, emitted = emitted.where("bucket < 0").select("chunk", "bucket", "payload"), emitted.where("bucket >= 0")
    of_unit = emitted.groupBy("bucket", "unit")
    replies = of_unit.applyInArrow(fold, EMITTED).groupBy("bucket").applyInArrow(work, REPLIES)
    replies = replies.withColumn("bundle", F.expr(f"bucket div {deal.span}").cast("int"))
    return of_unit.cogroup(replies.groupBy("bundle", "chunk")).applyInArrow(spread, REPLIES).unionByName(kept.groupBy("bucket").applyInArrow(work, REPLIES))


def with_replies(chunks: DataFrame, replies: DataFrame, work: Callable[[Chunk, dict[str, dict[int, bytes]]], pa.Table], schema: str) -> DataFrame:
    """Runs work(chunk, {kind: {bucket: reply}}) for each chunk; replies has a column kind besides REPLIES."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        got: dict[str, dict[int, bytes]] = {}
        for i in range(right.num_rows):
            got.setdefault(right.column("kind")[i].as_py(), {})[right.column("bucket")[i].as_py()] = right.column("payload")[i].as_py()
        return pa.concat_tables([work(c, got) for c in Chunk.rows(left)])

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(both, schema)


def size_of(chunks: DataFrame) -> tuple[int, int]:
    """Bytes of text and number of chunks."""
    found = chunks.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.count("*").alias("n")).first()
    return found["raw"], found["n"]
