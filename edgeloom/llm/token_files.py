"""Token ids in binary files of fixed-width bit packing.

A file holds, in this order (little-endian numbers):

    magic b"EDGEIDS1" | width u4 | block u4 | documents u8 | ids u8 | blocks u8
    documents x (doc_id i8, null u1, ids u8), as three arrays
    blocks x offset u8 (bytes from the first block)
    blocks: `block` ids each (the last one fewer), each id in `width` bits, the highest first; a block starts at a byte

width is the least number of bits that holds every id of the vocabulary. Any id is found by its block's offset and
its place in the block; a block is unpacked by numpy without a loop over ids.

write_files() deals documents by ranges of doc_id, so files in order of their names hold documents in ascending
order of doc_id. A file is written under another name and then renamed, so a task that runs again, or twice, leaves
whole files.

Defined cases: a null text is empty and has the end id only; a null doc_id sorts first; rows that repeat a doc_id
stand next to each other, by text, and rows with equal texts in any order (their ids are equal); a very long text is
one document of one file, encoded by one task; an empty table gives no file and no rows; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.llm import tokens
from edgeloom.llm.common import materialise, new_path, ship
from edgeloom.sources.shared import arrow_place, qualified

MAGIC, HEAD = b"EDGEIDS1", struct.Struct("<8sIIQQQ")
BLOCK, FILE_IDS = 4096, 1 << 22


def width_of(vocabulary: int) -> int:
    """Bits for ids 0 to vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f">u{width // 8}").tobytes()
    at = np.arange(width - 1, -1, -1, dtype=np.uint32)
    return b"".join(np.packbits(((ids[i : i + (1 << 16), None] >> at) & 1).astype(np.uint8)).tobytes() for i in range(0, len(ids), 1 << 16))


def unpack_bits(data: bytes, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f">u{width // 8}", n).astype(np.uint32)
    out = np.empty(n, np.uint32)
    for i in range(0, n, 1 << 16):
        m = min(1 << 16, n - i)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, -(-m * width // 8), i * width // 8), count=m * width).reshape(m, width)
        out[i : i + m] = bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width - 1, -1, -1, dtype=np.uint32))
    return out


def encode_file(docs: list[tuple[int | None, np.ndarray]], width: int, block: int = BLOCK) -> bytes:
    ids = np.concatenate([x for _, x in docs]) if docs else np.zeros(0, np.uint32)
    packed = [pack_bits(ids[i : i + block], width) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0, *(len(p) for p in packed)])[:-1] if packed else np.zeros(0)
    parts = [HEAD.pack(MAGIC, width, block, len(docs), len(ids), len(packed)), np.array([d or 0 for d, _ in docs], "<i8").tobytes(), np.array([d is None for d, _ in docs], "u1").tobytes(), np.array([len(x) for _, x in docs], "<u8").tobytes(), np.asarray(offsets, "<u8").tobytes()]
    return b"".join(parts + packed)


class IdFile:
    """Random access to one file's bytes."""

    def __init__(self, data: bytes):
        magic, self.width, self.block, n, self.n_ids, blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        at = HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.null = np.frombuffer(data, "u1", n, at + 8 * n)
        self.sizes = np.frombuffer(data, "<u8", n, at + 9 * n).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", blocks, at + 17 * n)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.body = memoryview(data)[at + 17 * n + 8 * blocks :]

    def ids(self, start: int = 0, n: int | None = None) -> np.ndarray:
        """Ids start to start + n, of the blocks that hold them only."""
        stop = self.n_ids if n is None else min(self.n_ids, start + n)
        if stop <= start:
            return np.zeros(0, np.uint32)
        out = []
        for b in range(start // self.block, (stop - 1) // self.block + 1):
            have = min(self.block, self.n_ids - b * self.block)
            o = int(self.offsets[b])
            own = unpack_bits(self.body[o : o + -(-have * self.width // 8)], self.width, have)
            out.append(own[max(0, start - b * self.block) : stop - b * self.block])
        return np.concatenate(out)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.sizes[i]))


def write_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of all documents below path; returns a row for each file: file, part, number, n_docs, n_ids."""
    spark = docs.sparkSession
    path = qualified(spark, path)
    spec = tokens.share(spark, tokenizer)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        encoder = tokens.encoder(spec)
        width = width_of(max(encoder.vocabulary, end_id + 1))
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0
        system, root = arrow_place(path)

        def save() -> pa.RecordBatch:
            nonlocal number, held, size
            system.create_dir(root, recursive=True)
            name = f"part-{part:06d}-{number:06d}.ids"
            temporary = f"{root}/_{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(temporary) as f:
                f.write(encode_file(held, width))
            system.move(temporary, f"{root}/{name}")
            row = pa.RecordBatch.from_pydict({"file": [name], "part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "n_docs": [len(held)], "n_ids": [size]})
            number, held, size = number + 1, [], 0
            return row

        for batch in batches:
            texts = (x.as_py() or "" for x in batch.column(1))
            for doc, raw in zip(batch.column(0).to_pylist(), encoder.stream(texts, keep=True), strict=True):
                ids = np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id))
                held.append((doc, ids))
                size += len(ids)
                if size >= file_ids:
                    yield save()
        if held:
            yield save()

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = slim.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return materialise(dealt.mapInArrow(work, "file string, part int, number int, n_docs long, n_ids long"), "id-files")


def read_files(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """Documents from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                own = IdFile(content.as_py())
                ids = own.ids().astype("<u4")
                n = len(own.doc_ids)
                crc = [zlib.crc32(ids[a : a + k].tobytes()) for a, k in zip(own.starts, own.sizes, strict=True)]
                yield pa.RecordBatch.from_pydict({"name": [name.as_py().rsplit("/", 1)[-1]] * n, "doc_id": pa.array(own.doc_ids, pa.int64(), mask=own.null.astype(bool)), "own": pa.array(own.starts, pa.int64()), "n_tokens": pa.array(own.sizes, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    ship(spark)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(qualified(spark, path)).select("path", "content")
    docs = raw.mapInArrow(work, "name string, doc_id long, own long, n_tokens long, ids_crc32 long")
    # a row for each file: what stands before it
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return docs.join(files.select("file", before.alias("before")), docs["name"] == F.col("file")).select("doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes the files and reads them back: doc_id, start, n_tokens, ids_crc32 of every document."""
    spark = docs.sparkSession
    path = path or new_path(spark, "ids")
    files = write_files(docs, tokenizer, path, end_id)
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_files(spark, path, files)
