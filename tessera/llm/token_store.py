"""Token files: one id array per frame, with Elias-Fano coded document boundaries.

``write_token_store`` range-sorts documents by doc_id, tokenizes each range in one
task and writes its frames; Spark's own committer publishes the files, so a task
that is lost is simply run again. ``read_token_store`` reads the files back from
any file system that Spark knows.

A frame (little endian):

    magic TSF1 | frame bytes u64 | shard u32 | frame u32 | documents u64 | tokens u64
    | null ids u64 | least doc_id i64 | bytes per id u8 | doc_ids (Elias-Fano) | ends (Elias-Fano) | ids | newline

An Elias-Fano list of n values below u takes about n * (2 + log2(u / n)) bits: the
low bits of each value side by side, and the high bits in unary in one bit vector.
The position of every 256th set bit is kept (32 bits each), so select(i) reads one
sample and scans a few bytes. The reader takes documents 2,000 at a time: the first one's start by select(),
the others by the same scan going on (part()); no table of a frame's offsets exists anywhere.

Defined results: a null text is the empty text and gets only the end id; rows with
a null doc_id come first; rows that repeat a doc_id each have their own entry,
ordered by the text; a text or word of any length is tokenized whole, and a frame holds one document at least; an empty table
gives no files and an empty result; columns other than doc_id and text, however they are called, are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialize, parts_for, rows_of, shared_dir, tidy
from tessera.llm.tokens import encoder

MAGIC = b"TSF1"
HEAD = "<4sQIIQQQqB"
EF_HEAD = "<QQBQQ"
SAMPLE = 256


class EliasFano:
    """A non-decreasing list of integers in near-minimal space."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high, self.samples = n, universe, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        universe = int(v[-1]) + 1 if n else 0
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        if low_bits:
            shifts = np.arange(low_bits, dtype=np.uint64)
            low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, universe, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = struct.pack(EF_HEAD, self.n, self.universe, self.low_bits, len(self.low), len(self.high))
        return b"".join((head, self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()))

    @classmethod
    def from_bytes(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, universe, low_bits, n_low, n_high = struct.unpack_from(EF_HEAD, data, at)
        at += struct.calcsize(EF_HEAD)
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        n_samples = -(-n // SAMPLE)
        samples = np.frombuffer(data, "<u4", n_samples, at + n_low + n_high)
        return cls(n, universe, low_bits, low, high, samples), at + n_low + n_high + 4 * n_samples

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        first = i * self.low_bits
        span = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little")
        return span >> (first % 8) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sample."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        pos, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        at, skip = pos // 8, pos % 8
        byte = int(self.high[at]) >> skip << skip
        while (ones := byte.bit_count()) <= left:
            left -= ones
            at += 1
            byte = int(self.high[at])
        for _ in range(left):
            byte &= byte - 1
        one = 8 * at + (byte & -byte).bit_length() - 1
        return (one - i) << self.low_bits | self._low(i)

    def part(self, lo: int, hi: int) -> np.ndarray:
        """Values lo to hi - 1: select() for a stretch of neighbours, from the sample before the first to the sample after the last."""
        if lo >= hi:
            return np.zeros(0, np.uint64)
        base, until = lo // SAMPLE, (hi - 1) // SAMPLE + 1
        first = int(self.samples[base])
        stop = int(self.samples[until]) // 8 + 1 if until < len(self.samples) else len(self.high)
        ones = 8 * (first // 8) + np.flatnonzero(np.unpackbits(self.high[first // 8 : stop], bitorder="little"))
        ones = ones[np.searchsorted(ones, first) :][lo - base * SAMPLE : hi - base * SAMPLE]
        out = (ones - np.arange(lo, hi)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            begin, end = lo * self.low_bits, hi * self.low_bits
            bits = np.unpackbits(self.low[begin // 8 : (end + 7) // 8], bitorder="little")[begin % 8 :][: end - begin].reshape(hi - lo, self.low_bits)
            out |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out

    def values(self) -> np.ndarray:
        """All values at once."""
        return self.part(0, self.n)


def frame_bytes(shard: int, number: int, doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    """One frame; its last byte is a line feed, which the text sink adds."""
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    keys = EliasFano.encode(np.asarray([d - least for d in known], dtype=np.uint64)).to_bytes()
    ends = EliasFano.encode(np.cumsum(np.asarray(lengths, dtype=np.uint64))).to_bytes()
    packed = ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    size = struct.calcsize(HEAD) + len(keys) + len(ends) + len(packed) + 1
    head = struct.pack(HEAD, MAGIC, size, shard, number, len(doc_ids), sum(lengths), len(doc_ids) - len(known), least, width)
    return b"".join((head, keys, ends, packed))


def frames_of(data: bytes) -> Iterator[tuple]:
    """(shard, frame, number of null ids, least doc_id, doc_ids above it, ends, ids) of each frame in a file; doc_ids and ends stay Elias-Fano coded."""
    at = 0
    while at < len(data):
        magic, size, shard, number, n_docs, n_tokens, n_null, least, width = struct.unpack_from(HEAD, data, at)
        if magic != MAGIC:
            raise ValueError("not a token file")
        keys, pos = EliasFano.from_bytes(data, at + struct.calcsize(HEAD))
        ends, pos = EliasFano.from_bytes(data, pos)
        ids = np.frombuffer(data, "<u4" if width == 4 else "<u2", n_tokens, pos)
        yield shard, number, n_null, least, keys, ends, ids
        at += size


#: Frames after which a range goes on in another file, which is read in one piece: some 64 MB of ids.
FRAMES_PER_FILE = 16


def write_token_store(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, shards: int | None = None, frame_tokens: int = 2_000_000) -> None:
    """Write doc_id, text as token files; part files are ranges of doc_id in ascending order, and a range is as many files as it takes; rows with one id are in order of a hash of their texts.

    shards defaults to one per 16 MB of input. A frame closes at frame_tokens, so a
    writer holds one frame however large its range.
    """
    shards = shards or parts_for(docs, 16 << 20)
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        width = 2 if max(enc.size, (end_id or 0) + 1) <= 1 << 16 else 4
        keys: list[int | None] = []
        lengths: list[int] = []
        ids: list[bytes] = []
        total = 0

        def frame() -> pa.RecordBatch:
            data = frame_bytes(shard, number, keys, lengths, b"".join(ids), width)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["frame"])

        for batch in batches:
            for doc_id, text in rows_of(batch):
                coded = enc.encode(text or "") + tail
                keys.append(doc_id)
                ids.append(coded)
                lengths.append(len(coded) // 4)
                total += lengths[-1]
                if total >= frame_tokens:
                    yield frame()
                    number, total = number + 1, 0
                    keys, lengths, ids = [], [], []
        if keys:
            yield frame()

    # rows that share an id, or have none, are dealt out by their texts, so that no range grows with one id
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    # the text sink writes a row's bytes as they are, and a line feed after them
    frames = ranged.mapInArrow(tidy(write, keeps=True), "frame binary").select(F.col("frame").cast("string").alias("value"))
    frames.write.option("maxRecordsPerFile", FRAMES_PER_FILE).text(path)


def read_token_store(spark: SparkSession, path: str, broadcast_frames: int = 200_000) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, unsigned 32-bit little endian).

    The frames' first positions are broadcast up to broadcast_frames frames (5 MB), and joined by a shuffle beyond.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for (data,) in rows_of(batch, 1):
                at = 0
                while at < len(data):
                    _, size, shard, number, _, n_tokens, *_ = struct.unpack_from(HEAD, data, at)
                    rows.append((shard, number, n_tokens))
                    at += size
            yield pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], pa.int64()) for i, k in enumerate(("shard", "frame", "tokens"))})

    def documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (data,) in rows_of(batch, 1):
                for shard, number, n_null, least, keys, ends, ids in frames_of(data):
                    for lo in range(0, ends.n, 2000):
                        hi = min(lo + 2000, ends.n)
                        cut = ends.part(lo, hi).astype(np.int64)
                        begin = np.concatenate(([ends.select(lo - 1) if lo else 0], cut[:-1]))
                        known = keys.part(max(0, lo - n_null), max(0, hi - n_null)).astype(np.int64) + least
                        of = pa.array([None] * (hi - lo - len(known)) + known.tolist(), pa.int64())
                        yield pa.RecordBatch.from_pydict({
                            "shard": pa.array([shard] * (hi - lo), pa.int64()), "frame": pa.array([number] * (hi - lo), pa.int64()),
                            "doc_id": of, "local": pa.array(begin, pa.int64()), "n_tokens": pa.array(cut - begin, pa.int64()),
                            "ids": pa.array([ids[b:e].astype("<u4").tobytes() for b, e in zip(begin.tolist(), cut.tolist(), strict=True)], pa.binary()),
                        })

    # one row for each frame of some million tokens
    order = T.StructType([T.StructField(k, T.LongType()) for k in ("shard", "frame", "tokens")])
    sizes = files.mapInArrow(heads, order)
    shard_base = _running(sizes.groupBy("shard").agg(F.sum("tokens").alias("tokens")), [], "shard", "shard_base")
    base = _running(sizes, ["shard"], "frame", "frame_base").join(shard_base.select("shard", "shard_base"), "shard")
    base = materialize(base.select("shard", "frame", (F.col("shard_base") + F.col("frame_base")).alias("base")), "frames")
    if base.count() <= broadcast_frames:
        base = F.broadcast(base)
    rows = files.mapInArrow(tidy(documents_of), "shard long, frame long, doc_id long, local long, n_tokens long, ids binary")
    return rows.join(base, ["shard", "frame"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids")


def _running(df: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum("tokens").over(w), F.lit(0)))


def tokenize_to_store(docs: DataFrame, tokenizer: str, end_id: int | None = 2, **options) -> DataFrame:
    """Write the token files into the shared folder and read them back."""
    spark = docs.sparkSession
    path = shared_dir(spark, "tokens")
    write_token_store(docs, path, tokenizer, end_id, **options)
    return read_token_store(spark, path)
