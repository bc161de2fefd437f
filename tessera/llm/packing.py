"""Best-fit packing of token pieces into fixed-length sequences, bulk-synchronously.

Documents and gaps are both sorted by size. In each step the longest pieces that
are left sweep to their successor, the smallest gap that is not smaller; conflicts
(many pieces, one gap) are resolved by rank, the r-th piece of a length takes the
r-th sequence with that gap; gaps shrink, and the next step follows.

All pieces of one length are alike, and so are all sequences with one gap. A step
therefore moves a whole class at once: ``plan`` sweeps over the histogram of
lengths, of at most ``capacity`` rows at any corpus size, and yields runs (length,
first rank, first sequence, offset). Only that histogram reaches the driver. The
pieces themselves stay distributed: each gets its rank within its length by a
two-level count, (length, bucket) totals and then rows of one bucket, so a length
that a third of all pieces share is split over the buckets; it then looks up its
run. The result equals best-fit decreasing over single pieces.

Defined results: a null text is the empty text (the end id only); a text longer
than the capacity is cut from its end into full pieces, so the first may be shorter;
rows that repeat a doc_id are packed each on its own; ties are ranked by a hash and
then by the key columns; a very long word is tokenized whole like any other; columns of documents other than doc_id and
text, however they are called, are ignored; an empty table packs into nothing.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, rows_of, tidy
from tessera.llm.tokens import encoder


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; all but the first are full."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *[(at, capacity) for at in range(first, n, capacity)]] if n else []


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int | None = 0, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids (binary, unsigned 32-bit little endian) of every whole text."""
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, text in rows_of(batch):
                ids = enc.encode(text or "") + tail
                rows += [(doc_id, k, s, n, ids[4 * s : 4 * (s + n)]) for k, (s, n) in enumerate(cut_points(len(ids) // 4, capacity))]
                held += len(ids)
                if held > 8 << 20:
                    yield _pieces(rows)
                    rows, held = [], 0
            if rows:
                yield _pieces(rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(cut, keeps=True), "doc_id long, piece int, start long, length long, ids binary")


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[k for k, _ in kinds])


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs (length, first rank, first sequence, offset) and the number of sequences.

    counts: pieces by length, each at most capacity. Pieces of a length with ranks
    from one run's first to the next run's lie in consecutive sequences at one offset.
    """
    gaps: list[int] = []  # sizes of open gaps, sorted
    open_: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, how many)
    runs: list[tuple[int, int, int, int]] = []
    next_seq = 0

    def add(gap: int, first: int, n: int) -> None:
        if gap:
            if gap not in open_:
                open_[gap] = []
                insort(gaps, gap)
            open_[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = open_[gap].pop()
                take = min(n, left)
                if take < n:
                    open_[gap].append((first + take, n - take))
                if not open_[gap]:
                    del open_[gap], gaps[at]
            else:
                gap, first = capacity, next_seq
                take = -(-left // max(1, capacity // length))
                next_seq += take
            runs.append((length, rank, first, capacity - gap))
            add(gap - length, first, take)
            rank, left = rank + take, left - take
    return runs, next_seq


def best_fit_pack(pieces: DataFrame, capacity: int = 2048, keys: tuple[str, ...] = ("doc_id", "piece"), bucket_rows: int = 200_000) -> DataFrame:
    """pieces with sequence_id and offset; all other columns are carried along.

    pieces must be cheap to read twice (a written table). bucket_rows bounds the
    rows ranked in one group. Columns called sequence_id and offset are replaced, all others kept.
    """
    spark, names = pieces.sparkSession, [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    inner = {c: c if c == "length" else f"c{i}" for i, c in enumerate(names)}
    packed = _best_fit(pieces.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()]), capacity, tuple(inner[k] for k in keys), bucket_rows)
    return packed.toDF(*names, "sequence_id", "offset")


def _best_fit(pieces: DataFrame, capacity: int, keys: tuple[str, ...], bucket_rows: int) -> DataFrame:
    spark = pieces.sparkSession
    fits = F.col("length").between(1, capacity)
    hist = {r["length"]: r["n"] for r in pieces.filter(fits).groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan(hist, capacity)
    buckets = max(16, -(-max(hist.values(), default=1) // bucket_rows))
    # null keys are told apart by what else the rows hold
    tie = [c for c in pieces.columns if c not in keys and dict(pieces.dtypes)[c] != "binary"]
    salted = pieces.filter(fits).withColumn("_bucket", F.pmod(F.xxhash64(*keys, *tie), F.lit(buckets)).cast("int"))
    # at most capacity * buckets rows
    per = salted.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    base = per.withColumn("_base", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    w = Window.partitionBy("length", "_bucket").orderBy(*keys, *tie)
    ranked = salted.withColumn("_rank", F.row_number().over(w) - 1).join(base, ["length", "_bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("_rank") + F.col("_base")).cast("long").alias("_rank"))

    # the runs are sorted by (length, first rank); their number depends on the capacity, not on the corpus
    order = sorted(runs)
    names = pieces.columns
    table = spark.sparkContext.broadcast(np.asarray(order, dtype=np.int64).reshape(-1, 4))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        key = (t[:, 0] << 40) + t[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            run = t[np.searchsorted(key, (length << 40) + rank, side="right") - 1]
            out = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*out, pa.array(run[:, 2] + rank - run[:, 1]), pa.array(run[:, 3])], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_pieces, n_tokens, ids: the packed sequences themselves, from pieces that carry ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    made = packed.groupBy("sequence_id").agg(parts.alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return made.select("sequence_id", F.size("p").alias("n_pieces"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"), joined.alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int | None = 0, capacity: int = 2048) -> tuple[DataFrame, DataFrame]:
    """The written pieces with their ids, and where each lies: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(token_pieces(docs, tokenizer, end_id, capacity), "pieces")
    narrow = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pieces, best_fit_pack(narrow, capacity)
