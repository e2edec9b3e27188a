"""SimHash near-dedup by a segment-popcount embedding, and near copies by similarity of their shingles.

simhash_components() links by fingerprints alone, as told here; near_dedup() takes near copies of similarity 0.8 or more
on five-word shingles, which differ in more bits than links reach: see near_groups().

Fingerprints: 64 bits from the XXH64 (seed 42) of a text's 3-word shingles, repeats included; a bit is 1 if it is set
in more than half of them.

Links: fingerprints at `distance` = 2 or fewer differing bits. A fingerprint is embedded as the bit counts of its
segments. One differing bit moves one count by one, so the Manhattan distance of two embeddings is a lower
bound of the Hamming distance. A grid range join finds what lies within 2: in the integer grid, two points are
within Manhattan distance 2 if and only if the balls of radius 1 about them meet, so every point is dealt to the cells
of its ball, and fingerprints that meet in a cell are the candidates. Cells are counted first; from those that several
fingerprints reach the way leads back to the points of their own balls, so only fingerprints with candidates are dealt
with their bits.

Exact verification: in a cell of PAIRS fingerprints or fewer every pair's bits are counted. A crowded cell is split by the
64-bit strings at the cell's own point: two of its fingerprints differ in at most 2 bits through this cell if and only
if both lie within one bit of one such string, and at most 65 fingerprints share one. Those of a string are linked to
the least of them and each link's bits are counted, so a group of near copies of any size never makes all its pairs.

Components: large-star and small-star rounds over the links until nothing changes, written in the shared folder
round by round. Everything works on distinct fingerprints; copies share theirs and join at the end, those of very
frequent fingerprints (a bounded number of them) without being dealt by it.

Defined cases: a null text has no words and fingerprint 0, linked like any other; fewer than three words are one
shingle; very long texts are fingerprinted whole, BLOCK shingles at a time; bits that are set in exactly half of the
shingles are 0; a null doc_id counts last when the smallest is looked for; repeated rows have the same component; an empty
table gives no rows; further columns are ignored by simhash_components() and kept by near_dedup().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm import common as C
from edgeloom.llm.common import BASES, discard, join_per_key, materialise, rolling, ship, tidy, whole_row

#: Bits of a segment (the last one has the rest): 22 segments.
SEGMENT_BITS = 3
DISTANCE = 2
#: Fingerprints of a cell up to which all its pairs are compared.
PAIRS = 16
#: near_dedup(): words of a shingle, and the Jaccard similarity of shingle sets, as a fraction, from which documents are near copies.
NEAR_WORDS = 5
NEAR = (4, 5)
#: Shingles in one bucket of the count of documents, about; bits that tell those of a bucket apart.
SHINGLES_EACH, ID_BITS = 1 << 20, 27
#: Bits of a shingle set, from which many dissimilar pairs show without their sets.
PARITIES = 1024
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 15


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "replace").translate(_UPPER).split()
    if not words:
        return 0
    if len(words) < 3:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b"%b %b %b" % t, 42) for t in zip(words, words[1:], words[2:], strict=False)), np.uint64, len(words) - 2)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[i : i + BLOCK].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed 64-bit integer) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int64())], ["doc_id", "fp"])
        tidy()

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, fp long")


def _embedding(fp: Column) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(fp, i).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))) for i in range(0, 64, SEGMENT_BITS)]


def _ball(point: str) -> Column:
    """The points of the grid within 1 of a point, each as one number."""
    steps = [(SEGMENT_BITS + 3) ** i for i in range(0, -(-64 // SEGMENT_BITS))]
    moves = F.array(*[F.lit(m).cast("long") for m in [0, *steps, *(-s for s in steps)]])
    return F.explode(F.transform(moves, lambda m: F.col(point) + m))


def _placed(fps: DataFrame) -> DataFrame:
    """(fp, at): each fingerprint's embedding as one number.

    A count is 0 to SEGMENT_BITS and its neighbours one less and one more, so SEGMENT_BITS + 3 values a segment; numbers
    of 22 digits to the base 6 fit 63 bits, and differ for different points. Digits of `at` are 1 to 4, so one step
    never carries, and a number one step from a cell is some fingerprint's `at` only if the points are one apart.
    """
    own = _embedding(F.col("fp"))
    return fps.select("fp", reduce(lambda a, b: a + b, [(c + 1).cast("long") * F.lit((SEGMENT_BITS + 3) ** i) for i, c in enumerate(own)]).alias("at"))


def linked(fps: DataFrame) -> DataFrame:
    """Links (a, b), a > b, that connect all fingerprints (column fp, each once) at most DISTANCE bits apart."""
    placed = materialise(_placed(fps), "simhash-placed")
    cells = placed.select(_ball("at").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    cells = materialise(cells, "simhash-cells")
    # back from a shared cell to the points that reach it: a fingerprint without candidates goes no further
    reach = cells.select(_ball("cell").alias("at")).distinct()
    near = materialise(placed.join(reach, "at", "left_semi").select("fp", "at"), "simhash-near")
    members = materialise(near.select("fp", "at", _ball("at").alias("cell")).join(cells, "cell"), "simhash-members")
    discard(placed, cells, near)

    few = members.where(F.col("n") <= PAIRS)
    p, q = few.alias("p"), few.alias("q")
    # those at one point share its whole ball and are compared in its middle alone
    once = (F.col("p.at") != F.col("q.at")) | (F.col("p.cell") == F.col("p.at"))
    bits = F.bit_count(F.col("p.fp").bitwiseXOR(F.col("q.fp")))
    pairs = p.join(q, (F.col("p.cell") == F.col("q.cell")) & (F.col("p.fp") > F.col("q.fp")) & once & (bits <= DISTANCE)).select(F.col("p.fp").alias("a"), F.col("q.fp").alias("b"))

    by_string = members.where(F.col("n") > PAIRS).select("fp", F.explode(_strings()).alias("string")).groupBy("string").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.collect_set("fp").alias("fps"))
    starred = by_string.where("low <> high").select(F.explode("fps").alias("a"), F.col("low").alias("b")).where("a <> b")
    return pairs.union(starred.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).distinct()


def _strings() -> Column:
    """Of (fp, at, cell): the strings within one bit of fp that the grid places at the cell."""
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    step = F.array(*[F.lit((SEGMENT_BITS + 3) ** (i // SEGMENT_BITS)).cast("long") for i in range(64)])
    moved = lambda i: F.col("at") + F.when(F.col("fp").bitwiseAND(one(i)) == 0, F.get(step, i)).otherwise(-F.get(step, i))
    flipped = F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: moved(i) == F.col("cell")), lambda i: F.col("fp").bitwiseXOR(one(i)))
    return F.when(F.col("cell") == F.col("at"), F.array("fp")).otherwise(flipped)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the least node of its component.

    Rounds go on until nothing changes; their number grows with the logarithm of the longest chain. Nodes with very
    many links, such as the root of a large component, are few and meet theirs by a broadcast (join_per_key()).
    """
    links = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state, done = None, False
    while not done:
        # large star: every greater neighbour of a node links to the node's least neighbour or itself
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "lows")
        large = join_per_key(both, low, "u", "n").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every lesser neighbour and the node itself link to the least one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        after = materialise(small, "links")
        discard(links, low)
        links = after
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("x")).first()
        done, state = state == now, now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b").distinct())


def _classes(rows: DataFrame) -> DataFrame:
    """(fp, n, component_id) of each distinct fingerprint; n: rows that have it."""
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    fps = materialise(fps, "simhash-fps")
    roots = components(linked(fps.select("fp")))
    ids = fps.join(roots, fps["fp"] == roots["node"]).select("fp", "root", "first")
    least = ids.groupBy("root").agg(F.min("first").alias("component_id"))
    linked_ids = ids.join(least, "root").select("fp", "component_id")
    return fps.join(linked_ids, "fp", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint (16 hex digits) and component_id, the smallest doc_id it reaches by links."""
    rows = materialise(fingerprints(docs), "simhash-rows")
    classes = materialise(_classes(rows), "simhash-classes")
    return join_per_key(rows, classes, "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


PACKED = "chunk long, d array<bigint>, h array<bigint>, g array<int>, sizes array<bigint>, raw long, blob binary"
NEAR_ROWS = "d long, h long, g int, fp long, sid long, n long, prefix array<struct<pos:long,key:long>>, parities array<long>"


def _packed(docs: DataFrame) -> DataFrame:
    """Rows of many documents, about CHUNK_BYTES of text each: d, h, g (hashes of the text), texts joined and compressed."""
    most = C.CHUNK_BYTES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = [(t.as_py() or "").encode("utf-8", "replace") for t in batch.column(3)]
            sizes = np.array([len(t) for t in texts], np.int64)
            for i, j in C.bucket_runs((np.cumsum(sizes) - sizes) // most).values():
                blob = b"".join(texts[i:j])
                lists = [pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), x) for x in (*(batch.column(k).slice(i, j - i) for k in range(3)), pa.array(sizes[i:j]))]
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), *lists, pa.array([len(blob)]), pa.array([C.squeeze(blob, 3)], pa.binary())], ["chunk", "d", "h", "g", "sizes", "raw", "blob"])
                chunk += 1
        tidy()

    return materialise(_slim(docs).mapInArrow(work, PACKED), "near-chunks")


def _texts(sizes: np.ndarray, blob: bytes) -> list[str]:
    raw, ends = C.unsqueeze(blob), np.cumsum(sizes)
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends - sizes, ends, strict=True)]


def _counted(own: np.ndarray, buckets: int) -> np.ndarray:
    """What shingles are counted by: bucket and ID_BITS bits. Two that share both count together, so as more, never as less."""
    return (((own >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)) << np.uint64(32)) | (own & np.uint64((1 << ID_BITS) - 1))


def _emit_counts(deal: C.Deal):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sizes, blob in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("chunk", "sizes", "blob")), strict=True):
                own = np.concatenate([shingles(t) for t in _texts(sizes.values.to_numpy(), blob.as_py())])
                keys, n = np.unique(_counted(own, deal.buckets), return_counts=True)
                out = C.Keyed.payloads(deal, keys, n.astype(np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([chunk.as_py()] * len(out), pa.int64()), pa.array([p for _, p in out], pa.binary())], ["bucket", "chunk", "payload"])
        tidy()

    return emit


#: Documents that hold each shingle, in all chunks.
_COUNTS = C.Keyed(lambda n, head, size: (np.add.reduceat(n.astype(np.uint64), head),), lambda total: total)


def _near_rows(docs: DataFrame) -> DataFrame:
    """(d, h, g, fp, sid, n, prefix, parities) of every row, written.

    h, g: hashes of the text; sid, n: hash and size of its shingle set; prefix: the shingles, in the global order, of
    which a set of similarity NEAR has one at least, less those that no other document holds. The order: by the number of
    documents, counted over all of them, then by value; pos: the place in it among the document's own.
    parities: is the number of shingles with each remainder by PARITIES odd? Sets differ in as many shingles as bits at least.
    """
    chunks = _packed(docs)
    raw, n_chunks = C.size_of(chunks)
    # a word and its space take six bytes or so, and a shingle begins at nearly each
    deal = C.dealt(raw // 6, SHINGLES_EACH)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        replies = dict(zip(right.column("bucket").to_pylist(), right.column("payload"), strict=True))
        texts = _texts(left.column("sizes")[0].values.to_numpy(), left.column("blob")[0].as_py())
        sets = [shingles(t) for t in texts]
        keys, inverse = np.unique(_counted(np.concatenate(sets), deal.buckets), return_inverse=True)
        total = np.zeros(len(keys), np.uint64)
        for b, (i, j) in deal.runs(keys >> np.uint64(32)).items():
            total[i:j] = C.unpack_arrays(replies[b].as_py())[0]
        total, at = total[inverse], 0
        places, prefixes, parities = [], [], []
        for own in sets:
            n = total[at : at + len(own)]
            at += len(own)
            order = np.lexsort((own, n))[: len(own) - _need(len(own)) + 1]
            pos = np.flatnonzero(n[order] > 1)
            places.append(pos)
            prefixes.append(own[order[pos]].view(np.int64))
            parities.append(np.packbits(np.bincount((own % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1).view(np.int64))
        fps = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        sids = np.array([xxhash.xxh64_intdigest(own.tobytes(), 42) for own in sets], np.uint64).view(np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
        entries = pa.StructArray.from_arrays([pa.array(np.concatenate(places), pa.int64()), pa.array(np.concatenate(prefixes), pa.int64())], ["pos", "key"])
        columns = [left.column(c)[0].values for c in ("d", "h", "g")]
        columns += [pa.array(fps), pa.array(sids), pa.array([len(own) for own in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), entries), pa.array(parities, pa.list_(pa.int64()))]
        return pa.Table.from_arrays(columns, ["d", "h", "g", "fp", "sid", "n", "prefix", "parities"])

    counts = materialise(C.reduce_buckets(chunks.mapInArrow(_emit_counts(deal), C.EMITTED), _COUNTS, deal, n_chunks), "near-counts")
    rows = materialise(chunks.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(work, NEAR_ROWS), "near-rows")
    discard(chunks, counts)
    return rows


def shingles(text: str | None) -> np.ndarray:
    """The set of a text's NEAR_WORDS-word shingles, as sorted hashes; fewer words are one shingle."""
    words = (text or "").encode("utf-8", "replace").translate(_UPPER).split()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))
    if len(words) < NEAR_WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    return np.unique(rolling(hashes, NEAR_WORDS, BASES[0]))


def _need(size: int) -> int:
    """Shingles that a set of so many has to share with another one of similarity NEAR."""
    return -(-size * NEAR[0] // NEAR[1])


def _slim(docs: DataFrame, *more: str) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("d"), F.xxhash64(text).alias("h"), F.hash(text).alias("g"), text.alias("text"), *more)


def _sets(texts: DataFrame) -> DataFrame:
    """(sid, shingles) of (sid, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["sid", "shingles"])
        tidy()

    return texts.select("sid", "text").mapInArrow(work, "sid long, shingles array<long>")


def _similar(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of sets whose similarity, counted exactly, is NEAR or more."""
    every = materialise(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "near-pairs")
    of_a, of_b = (sets.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("parities").alias(f"p_{c}")) for c in "ab")
    pairs = every.join(of_a, "a").join(of_b, "b").where(_likely("p_a", "p_b", F.col("n_a") + F.col("n_b"))).select("a", "b")
    pairs = materialise(pairs, "near-likely")
    discard(every)
    named = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    source = materialise(sets.select("sid", "h", "g").join(named, "sid"), "near-named")
    texts = _slim(docs).join(source, ["h", "g"]).groupBy("sid").agg(F.first("text").alias("text"))
    full = materialise(_sets(texts), "near-sets")
    discard(source)
    both = pairs.join(full.select(F.col("sid").alias("a"), F.col("shingles").alias("x")), "a").join(full.select(F.col("sid").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    found = materialise(both.where(shared * NEAR[1] >= (F.size("x") + F.size("y") - shared) * NEAR[0]).select("a", "b"), "near-found")
    discard(pairs, full)
    return found


def _likely(p: str, q: str, sizes: Column) -> Column:
    """Do the parity bits p and q of two sets let them be similar?

    At similarity s the shingles of one set only are (1 - s) / (1 + s) of both sizes at most, and as many bits differ.
    """
    odd = F.aggregate(F.zip_with(p, q, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return odd * sum(NEAR) <= sizes * (NEAR[1] - NEAR[0])


def _possible(p: str, q: str) -> Column:
    """Can the sets in rows p and q of one key be similar, if it is the first that they share?"""
    n, m = F.col(f"{p}.n"), F.col(f"{q}.n")
    left = 1 + F.least(n - F.col(f"{p}.pos") - 1, m - F.col(f"{q}.pos") - 1)
    return (F.least(n, m) * NEAR[1] >= F.greatest(n, m) * NEAR[0]) & (left * sum(NEAR) >= (n + m) * NEAR[0])


def near_groups(docs: DataFrame) -> DataFrame:
    """(d, h, g, root) of every row: rows of equal root are near copies, directly or by way of others.

    Near copies are documents whose sets of NEAR_WORDS-word shingles have similarity NEAR (Jaccard) or more. Sets that
    similar share a shingle of both prefixes, so all pairs are among the rows of a prefix shingle (a key). Links of
    fingerprints and of each key's rows to one of them come first, are verified and make components; then all pairs of a
    key's rows that are still in different components are verified, so none is missed, and a large group of near
    copies doesn't cost all its pairs.
    """
    ship(docs.sparkSession)
    rows = _near_rows(docs)
    first = F.first(F.struct("h", "g", "fp", "n", "prefix", "parities")).alias("s")
    sets = materialise(rows.groupBy("sid").agg(first).select("sid", "s.*"), "near-classes")
    every_row, rows = rows, materialise(rows.select("d", "h", "g", "sid"), "near-ids")
    discard(every_row)
    keys = sets.select("sid", "n", F.inline("prefix"))
    own = F.struct(F.xxhash64("key", "sid").alias("by"), "sid", "n", "pos")
    every = Window.partitionBy("key")
    keys = keys.select("*", F.count("*").over(every).alias("rows"), F.min(own).over(every).alias("q")).where("rows > 1")
    keys_table = materialise(keys, "near-keys")
    keys = keys_table.alias("p")

    stars = keys.where(_possible("p", "q")).select(F.col("p.sid").alias("a"), F.col("q.sid").alias("b"))
    of_fp = materialise(sets.groupBy("fp").agg(F.min("sid").alias("least"), F.count("*").alias("n")), "near-fps")
    same = join_per_key(sets.select("sid", "fp"), of_fp, "fp", "n").select(F.col("sid").alias("a"), F.col("least").alias("b"))
    fps = linked(of_fp.select("fp"))
    of_a, of_b = (of_fp.select(F.col("fp").alias(c), F.col("least").alias(f"of_{c}")) for c in "ab")
    across = fps.join(of_a, "a").join(of_b, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    links = _similar(docs, sets, stars.union(same).union(across))

    roots = materialise(components(links), "near-roots")
    open_keys = keys.where("rows > 2").join(roots, F.col("p.sid") == F.col("node"), "left").select("key", "p.sid", "n", "pos", F.coalesce("root", "p.sid").alias("root"))
    open_keys = materialise(open_keys, "near-rooted")
    between = materialise(open_keys.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n_key")).where("low <> high"), "near-between")
    open_keys = join_per_key(open_keys, between, "key", "n_key")
    # with their parity bits, so that the join of a key's rows gives likely pairs only
    open_keys = materialise(open_keys.join(sets.select("sid", "parities"), "sid"), "near-open")
    discard(keys_table)
    p, q = open_keys.alias("p"), open_keys.alias("q")
    rest = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.sid") > F.col("q.sid")) & (F.col("p.root") != F.col("q.root")) & _possible("p", "q") & _likely("p.parities", "q.parities", F.col("p.n") + F.col("q.n")))
    more = _similar(docs, sets, rest.select(F.col("p.sid").alias("a"), F.col("q.sid").alias("b")))
    first_roots, roots = roots, materialise(components(links.union(more)), "near-roots")
    discard(first_roots, open_keys, links)

    classes = sets.select("sid").join(roots, F.col("sid") == F.col("node"), "left").select("sid", F.coalesce("root", "sid").alias("root"))
    sizes = materialise(rows.groupBy("sid").agg(F.count("*").alias("n_rows")).join(classes, "sid"), "near-sizes")
    return join_per_key(rows.select("d", "h", "g", "sid"), sizes, "sid", "n_rows").select("d", "h", "g", "root")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, with all its columns: the smallest doc_id, a null one last, then the first text.

    Rows are told apart by doc_id and text, so rows of different groups stay whatever their doc_ids are.
    """
    groups = materialise(near_groups(docs).groupBy("root", "d", "h", "g").agg(F.count("*").alias("n")), "near-groups")
    by_id = groups.groupBy("root", "d").agg(F.sum("n").alias("ties"))
    least = by_id.groupBy("root").agg(F.min(F.struct(F.col("d").isNull().alias("none"), "d", "ties")).alias("o")).select(F.col("root").alias("r"), F.col("o.d").alias("least"), "o.ties")
    own = groups.join(least, (F.col("root") == F.col("r")) & F.col("d").eqNullSafe(F.col("least")))
    own = materialise(own.select("root", F.col("d").alias("k"), F.col("h").alias("kh"), F.col("g").alias("kg"), "ties"), "near-own")
    rows = _slim(docs.select("doc_id", "text", whole_row(docs).alias("row")), "row")
    same = F.col("d").eqNullSafe(F.col("k")) & (F.col("h") == F.col("kh")) & (F.col("g") == F.col("kg"))
    kept = rows.join(own.where("ties = 1"), same).select("row.*")
    tied = materialise(own.where("ties > 1"), "near-tied")
    if tied.isEmpty():
        return kept
    by_text = F.struct(F.col("text").isNull().alias("none"), "text")
    return kept.unionByName(rows.join(tied, same).groupBy("root").agg(F.min_by("row", by_text).alias("row")).select("row.*"))
