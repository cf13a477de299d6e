"""Token ids in files of patched frame-of-reference blocks.

A segment file (all integers little-endian):

    header   magic PFR2, block length u32, segment number u64, documents u64, ids u64
    docs     doc_id i64 and has-id u8 and id count u32 of each document, column after column
    index    of each block: start u64 (in 64-bit words of the packed area), first exception u64, minimum u32, width u8
    packed   each block's values less its minimum, `width` low bits each
    patches  of each exception: place in its block u16, the bits above the width u32
    end      a line end, as Spark's writer of text files leaves it

A block's width is a percentile of its values' bit lengths; values that need more bits leave the rest in the exception
list. The index makes any block readable alone. Segments end at documents. Each is a file of its own: Spark's text writer
puts a row's bytes into a file as they are, by whatever file system it reaches, and commits a task's files once, so a
task that is run again leaves no second copy. Files are read back by Spark's reader of binary files.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, parallel, pieces, shared_dir
from .tokens import encoder

BLOCK = 256
_HEAD = struct.Struct("<4sIQQQ")
_INDEX = np.dtype([("start", "<u8"), ("patch", "<u8"), ("least", "<u4"), ("width", "u1")])


def _bit_length(v: np.ndarray) -> np.ndarray:
    v = v.copy()
    for s in (1, 2, 4, 8, 16):
        v |= v >> np.uint32(s)
    return np.bitwise_count(v)


def encode(ids: np.ndarray, doc_ids: list, counts: np.ndarray, percentile: float = 90.0, number: int = 0) -> bytes:
    """A segment of the documents' ids, one after another."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    v = np.empty(blocks * BLOCK, np.uint32)
    v[:n] = ids
    if n:
        v[n:] = ids[-1]
    v = v.reshape(blocks, BLOCK)
    least = v.min(axis=1) if blocks else np.zeros(0, np.uint32)
    v = v - least[:, None]
    bits = _bit_length(v)
    rank = min(BLOCK - 1, max(0, int(np.ceil(percentile / 100 * BLOCK)) - 1))
    width = np.partition(bits, rank, axis=1)[:, rank].astype(np.uint8) if blocks else np.zeros(0, np.uint8)
    index = np.zeros(blocks, _INDEX)
    words = width.astype(np.uint64) * np.uint64(BLOCK // 64)
    over = bits > width[:, None]
    patches = over.sum(1)
    index["start"], index["patch"] = np.cumsum(words) - words, np.cumsum(patches) - patches
    index["least"], index["width"] = least, width
    packed = np.zeros(int(words.sum()), "<u8")
    for w in np.unique(width):
        if w:
            of = np.flatnonzero(width == w)
            low = (v[of] & np.uint32((1 << int(w)) - 1)).astype(np.uint64).T.copy()
            out = np.zeros((int(w) * BLOCK // 64, len(of)), np.uint64)
            for k in range(BLOCK):
                word, shift = divmod(k * int(w), 64)
                out[word] |= low[k] << np.uint64(shift)
                if shift + int(w) > 64:
                    out[word + 1] |= low[k] >> np.uint64(64 - shift)
            packed[index["start"][of].astype(np.int64)[:, None] + np.arange(len(out))] = out.T
    at, place = np.nonzero(over)
    high = v[at, place] >> width[at].astype(np.uint32)
    has = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [_HEAD.pack(b"PFR2", BLOCK, number, len(doc_ids), n), np.array([d or 0 for d in doc_ids], "<i8"), has, np.asarray(counts, "<u4"), index, packed, place.astype("<u2"), high.astype("<u4")]
    return b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)


class Segment:
    """A segment file that has been read; blocks are decoded on demand."""

    def __init__(self, data: bytes):
        magic, block, self.number, docs, self.n = _HEAD.unpack_from(data)
        if magic != b"PFR2" or block != BLOCK:
            raise ValueError("not a segment file")
        at = _HEAD.size

        def take(dtype, n):
            nonlocal at
            out = np.frombuffer(data, dtype, n, at)
            at += out.nbytes
            return out

        ids, has = take("<i8", docs), take("u1", docs)
        self.doc_ids = [int(d) if h else None for d, h in zip(ids, has, strict=True)]
        self.counts = take("<u4", docs)
        self.index = take(_INDEX, -(-self.n // BLOCK))
        self.packed = take("<u8", int(self.index["width"].astype(np.int64).sum()) * BLOCK // 64)
        left = (len(data) - at) // 6
        self.place, self.high = take("<u2", left), take("<u4", left)

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Ids lo to hi of the segment; only the blocks that hold them are decoded."""
        hi = self.n if hi is None else min(hi, self.n)
        if lo >= hi:
            return np.zeros(0, "<u4")
        a, b = lo // BLOCK, -(-hi // BLOCK)
        index = self.index[a:b]
        v = np.zeros((b - a, BLOCK), np.uint32)
        for w in np.unique(index["width"]):
            if w:
                of = np.flatnonzero(index["width"] == w)
                words = self.packed[index["start"][of].astype(np.int64)[:, None] + np.arange(int(w) * BLOCK // 64)].T.copy()
                out = np.empty((BLOCK, len(of)), np.uint32)
                mask = np.uint64((1 << int(w)) - 1)
                for k in range(BLOCK):
                    word, shift = divmod(k * int(w), 64)
                    x = words[word] >> np.uint64(shift)
                    if shift + int(w) > 64:
                        x = x | (words[word + 1] << np.uint64(64 - shift))
                    out[k] = x & mask
                v[of] = out.T
        first = int(index["patch"][0])
        last = int(self.index["patch"][b]) if b < len(self.index) else len(self.place)
        if last > first:
            owner = np.searchsorted(index["patch"].astype(np.int64), np.arange(first, last), "right") - 1
            v[owner, self.place[first:last]] |= self.high[first:last] << index["width"][owner].astype(np.uint32)
        return (v + index["least"][:, None]).reshape(-1)[lo - a * BLOCK : hi - a * BLOCK].astype("<u4")


def write(docs: DataFrame, vocabulary: str, path: str | None = None, end_id: int = 2, segment_ids: int = 1 << 20, percentile: float = 90.0) -> DataFrame:
    """Writes the documents' ids in ascending doc_id order to files under path (a new folder of the shared one if not given); gives back files(path).

    Null doc_ids come first, equal ones in the order of their texts; a null text is empty, so it is the end id alone.
    Repeated rows are written as often. An empty table makes no file. Segments are cut after the document that fills
    `segment_ids`, so a longer text makes a longer file (of 2 GB at most); a task holds about 30 bytes for a byte of it.
    """

    def run(batches):
        tok = encoder(vocabulary)
        end = struct.pack("<I", end_id)
        part = TaskContext.get().partitionId() << 32
        ids, names, counts, held, k = [], [], [], 0, 0

        def segment():
            data = encode(np.frombuffer(b"".join(ids), "<u4"), names, np.array(counts, "<u4"), percentile, part + k)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])

        for batch in batches:
            for b in pieces(batch, 1, most_bytes=1 << 21):
                for doc_id, x in zip(b.column(0).to_pylist(), tok.many(b.column(1).to_pylist()), strict=True):
                    x += end
                    ids.append(x)
                    names.append(doc_id)
                    counts.append(len(x) // 4)
                    held += len(x) // 4
                    if held >= segment_ids:
                        yield segment()
                        ids, names, counts, held, k = [], [], [], 0, k + 1
        if names:
            yield segment()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(parallel(docs), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    path = path or f"{shared_dir(docs.sparkSession).rstrip('/')}/files-{uuid.uuid4().hex}"
    rows.mapInArrow(run, "data binary").select(F.col("data").cast("string")).write.option("maxRecordsPerFile", 1).text(path)
    return files(docs.sparkSession, path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, n_bytes, segment, n_docs, n_ids, data) of each file under path; the numbers are those of its header."""
    found = spark.read.format("binaryFile").load(path).filter("length > 1")

    def number(at: int):
        """A little-endian integer of eight bytes."""
        return F.conv(F.concat(*[F.hex(F.substring("content", at + k, 1)) for k in range(8, 0, -1)]), 16, 10).cast("long")

    return found.select("path", F.col("length").alias("n_bytes"), number(8).alias("segment"), number(16).alias("n_docs"), number(24).alias("n_ids"), F.col("content").alias("data"))


def read(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of every document in the files; start counts all ids before it.

    The starts of segments are a running sum within the part that a task has written, and one over the parts' totals: a row
    for each task.
    """
    heads = cut(segments.select("segment", F.shiftright("segment", 32).alias("part"), "n_ids"))
    upto = (Window.unboundedPreceding, 0)
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part").rowsBetween(*upto)) - F.col("n")).select("part", "base")
    inner = heads.withColumn("own", F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment").rowsBetween(*upto)) - F.col("n_ids"))
    before = inner.join(parts, "part").select("segment", (F.col("base") + F.col("own")).alias("base"))

    def run(batches):
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = Segment(data.as_py())
                raw = s.ids().tobytes()
                ends = np.cumsum(s.counts.astype(np.int64))
                starts = ends - s.counts
                for k in range(0, len(ends), 512):
                    lo, hi = starts[k : k + 512], ends[k : k + 512]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number] * len(lo)), pa.array(s.doc_ids[k : k + 512], pa.int64()), pa.array(lo), pa.array(hi - lo), pa.array([raw[4 * a : 4 * b] for a, b in zip(lo, hi, strict=True)], pa.binary())],
                        names=["segment", "doc_id", "local", "n_tokens", "ids"],
                    )

    docs = segments.select("segment", "data").mapInArrow(run, "segment long, doc_id long, local long, n_tokens long, ids binary")
    return docs.join(F.broadcast(before) if heads.count() <= 100_000 else before, "segment").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids")


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), all read back from the files; see write and read for nulls, ties and empty tables."""
    return read(write(docs, vocabulary, end_id=end_id)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
