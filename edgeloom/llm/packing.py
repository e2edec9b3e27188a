"""Packing by deficit round-robin over source queues.

Every window (sequence) is to hold the sources in target proportions (`shares`). With all documents packed once and no
proportions asked for, those are the sources' shares of all tokens, which every window can meet; with others the sources
that are wanted more than they have run out first, and later windows of a slice share what is left in the
proportions of the rest. Each source is a queue; at each window a queue's deficit grows by its share of the
window, the queue with the largest deficit is served (a piece of LEAST_PIECE tokens or of its deficit, whichever is
more, if document and window have so many), and what it got is taken off. Deficits stay for the next windows.

Partitions. Queue positions are known from prefix sums of token counts by (source, part of the token table). Slice k
of K takes tokens floor(N * k / K) to floor(N * (k + 1) / K) of every queue, so each slice holds all sources in their
proportions, whichever source is large; the part of a token that rounding leaves, N * k / K - floor(N * k / K), is the
deficit that a queue brings along into the slice. A slice has a bounded number of tokens and is packed by one task.

A slice's last tokens fill sequences of powers of two, which need no padding.

Defined cases: a null text is empty and has the end id only; a null source is a queue of its own; rows that repeat a
doc_id are documents of their own; sources that tie in their deficits are served in code-point order (null first); a very
long text is rows of ROW_IDS ids and may lie in many slices; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm import tokens
from edgeloom.llm.common import materialise, tidy

LENGTH = 1024
#: Sequences in a slice, about; tokens of a piece, at least, where there are so many; tokens of a row of the token table.
SLICE, LEAST_PIECE, ROW_IDS = 512, 128, 1 << 16

TOKENS = "part int, doc_id long, source string, before long, start long, n long, doc_tokens long, ids binary"
PIECES = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def token_table(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Rows of ROW_IDS ids at most; before: tokens of the same source earlier in the part."""
    spec = tokens.share(docs.sparkSession, tokenizer)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), {}
        encoder = tokens.encoder(spec)
        kind = np.uint16 if max(encoder.vocabulary, end_id + 1) <= 1 << 16 else np.uint32
        names = [f.split()[0] for f in TOKENS.split(", ")]
        for batch in batches:
            out = []
            texts = (x.as_py() or "" for x in batch.column(2))
            for doc, source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), encoder.stream(texts), strict=True):
                ids = np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id)).astype(kind)
                for i in range(0, len(ids), ROW_IDS):
                    own = ids[i : i + ROW_IDS]
                    out.append((part, doc, source, before.get(source, 0), i, len(own), len(ids), own.tobytes()))
                    before[source] = before.get(source, 0) + len(own)
            kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return materialise(slim.mapInArrow(work, TOKENS), "tokens")


def _cut(slices: int):
    """Rows of the token table with their queue positions -> rows that lie in one slice."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                size = len(r["ids"]) // r["n"]
                pos, end, total = r["first"] + r["before"], r["first"] + r["before"] + r["n"], r["total"]
                at = pos
                while at < end:
                    k = -(-(at + 1) * slices // total) - 1
                    stop = min(end, total * (k + 1) // slices)
                    own = r["ids"][(at - pos) * size : (stop - pos) * size]
                    out.append((k, r["source"], total, at, r["doc_id"], r["start"] + at - pos, stop - at, r["doc_tokens"], own))
                    at = stop
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["slice", "source", "total", "at", "doc_id", "start", "n", "doc_tokens", "ids"])
        tidy()

    return work


class Queue:
    """One source's pieces in a slice."""

    def __init__(self):
        self.items: list[tuple] = []
        self.item = self.used = self.left = 0

    def add(self, *item) -> None:
        """item: doc_id, start, n, doc_tokens, ids."""
        self.items.append(item)
        self.left += item[2]

    def take(self, most: int) -> tuple:
        """The next piece of one document, of `most` tokens at most: doc_id, start, n, doc_tokens, ids."""
        doc, start, n, whole, ids = self.items[self.item]
        k = min(most, n - self.used)
        size = len(ids) // n
        piece = (doc, start + self.used, k, whole, ids[self.used * size : (self.used + k) * size])
        self.used += k
        self.left -= k
        if self.used == n:
            self.item, self.used = self.item + 1, 0
        return piece

    def head(self) -> int:
        return self.items[self.item][2] - self.used


def capacities(total: int, length: int) -> list[int]:
    """Sizes of the sequences for so many tokens: full ones, then the powers of two of the rest."""
    rest = total % length
    return [length] * (total // length) + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]


def round_robin(queues: list[Queue], deficits: np.ndarray, length: int, weights: np.ndarray | None = None) -> Iterator[tuple[int, int, int, tuple]]:
    """(sequence, offset, queue, piece): fills one window after the other until the queues are empty.

    weights: what each queue is to have of a window, in proportion; without them what it has of all tokens.
    """
    left = np.array([q.left for q in queues], np.float64)
    wanted = left if weights is None else np.where(left > 0, weights, 0.0)
    deficits = np.where(left > 0, deficits, -np.inf)
    for number, capacity in enumerate(capacities(int(left.sum()), length)):
        now = np.where(deficits > -np.inf, wanted, 0.0) if weights is not None else wanted
        deficits = deficits + capacity * (now / now.sum() if now.sum() > 0 else now)
        room = capacity
        while room:
            s = int(deficits.argmax())
            queue = queues[s]
            want = min(room, queue.head(), max(LEAST_PIECE, int(np.ceil(deficits[s]))))
            piece = queue.take(want)
            yield number, capacity - room, s, piece
            room -= want
            deficits[s] = deficits[s] - want if queue.left else -np.inf


def _pack(length: int, slices: int, with_ids: bool, schema: pa.Schema, shares: dict[str | None, float] | None):
    def work(rows: pa.Table) -> pa.Table:
        k = rows.column("slice")[0].as_py()
        queues: dict[str | None, Queue] = {}
        totals = {}
        for r in rows.sort_by([("source", "ascending"), ("at", "ascending")]).to_pylist():
            queues.setdefault(r["source"], Queue()).add(r["doc_id"], r["start"], r["n"], r["doc_tokens"], r["ids"])
            totals[r["source"]] = r["total"]
        names = list(queues)
        rest = np.array([totals[s] * k % slices / slices for s in names])
        weights = None if shares is None else np.array([float(shares.get(s, 0.0)) for s in names])
        out = []
        for number, offset, s, (doc, start, n, whole, ids) in round_robin([queues[s] for s in names], rest, length, weights):
            wide = np.frombuffer(ids, np.uint16 if len(ids) == 2 * n else np.uint32).astype("<u4").tobytes()
            out.append((doc, names[s], start, n, zlib.crc32(wide), whole, (k << 32) + number, offset, *([wide] if with_ids else [])))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return work


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = LENGTH, with_ids: bool = False, shares: dict[str | None, float] | None = None) -> DataFrame:
    """Pieces of documents in sequences: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    with_ids adds the ids (bytes of little-endian unsigned 32-bit integers). shares: the proportions of sources that every
    window is to have, as long as they last; those of sources that aren't named are 0, so they come last.
    """
    table = token_table(docs, tokenizer, end_id)
    parts = table.groupBy("source", "part").agg(F.sum("n").alias("n"))
    by_source = Window.partitionBy("source")
    first = F.coalesce(F.sum("n").over(by_source.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = materialise(parts.select(F.col("source").alias("s"), F.col("part").alias("p"), first.alias("first"), F.sum("n").over(by_source).alias("total")), "token-parts")
    everything = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    slices = max(1, round(everything / (SLICE * length)))
    placed = table.join(parts, (table["part"] == parts["p"]) & table["source"].eqNullSafe(parts["s"])).drop("s", "p")
    cut = placed.mapInArrow(_cut(slices), "slice int, source string, total long, at long, doc_id long, start long, n long, doc_tokens long, ids binary")
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), *[(x, pa.int64()) for x in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")], *([("ids", pa.binary())] if with_ids else [])])
    return cut.groupBy("slice").applyInArrow(_pack(length, slices, with_ids, schema, shares), PIECES + (", ids binary" if with_ids else ""))
