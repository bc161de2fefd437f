"""Benchmark decontamination with suffix arrays over the training text.

Every task builds a suffix array over the words of its shard of documents. All
suffixes of all benchmark items are then binary-searched in it at once: the lower
and upper bound give each training position where the item's next ``window`` words
stand verbatim, and the match is extended from there to its full length. Nothing is
shuffled; each document leaves the task with its hits.

Words outside the benchmark can't be part of a match, so they only separate runs
of words in the array, and runs shorter than the shortest window are left out.

The benchmark is read in blocks of at most ``block_chars`` characters; each block
is broadcast on its own and takes one pass over the documents, so no broadcast
grows with the benchmark. Where there are several, one is held at a time: the
documents are written once with row numbers, and each pass leaves its hits.

A window that stands in several items is searched once. All of them are told as items;
matches name the first of them.

Defined results: a null or empty text has no words and no hits; an item with fewer
words than the window is one window; an item without words never occurs; items that
repeat an item_id and its text count once, and rows that repeat a document are each told; an item with a null item_id hits words, but has no id to
tell; an empty benchmark marks nothing, and an empty table of documents gives an empty
result; a very long text is searched whole, and a very long word is one word; extra
columns are kept, but for those called n_words, n_hit, items, hits or matches, which
find_contamination replaces and decontaminate keeps.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, kept, materialize, tidy

#: Lower-cases A-Z, keeps 0-9, a-z and every byte of a non-ASCII character, and blanks the rest.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

HITS = "array<struct<start:int,end:int>>"
MATCHES = "array<struct<item_id:string,item_start:int,doc_start:int,length:int>>"


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions with a word (id above 0), in the order of their first depth words; id 0 ends a run."""
    rank = ids.astype(np.int64)
    step = 1
    while step < depth and len(rank):
        # a run that has ended stays at 0, the lowest rank
        nxt = np.zeros_like(rank)
        nxt[:-step] = rank[step:] if step < len(rank) else 0
        nxt = np.where(_inside(ids, step), nxt, 0)
        key = rank * (int(nxt.max(initial=0)) + 1) + nxt
        key[ids == 0] = 0
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        if not (ids == 0).any():
            rank += 1
        step *= 2
    at = np.flatnonzero(ids)
    return at[np.argsort(rank[at], kind="stable")]


def _inside(ids: np.ndarray, step: int) -> np.ndarray:
    """Whether the word step places on belongs to the same run."""
    zeros = np.cumsum(ids == 0)
    ahead = np.minimum(np.arange(len(ids)) + step, len(ids) - 1)
    return (zeros[ahead] == zeros) & (np.arange(len(ids)) + step < len(ids))


def _distinct(column: Callable[[int], np.ndarray], width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct row of a table of n rows given by columns, and which of these each row is. Rows are told apart by a hash of 64 bits, which is verified."""
    mixed = np.zeros(n, np.uint64)
    for k in range(width):
        mixed = (mixed ^ column(k).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    _, first, of = np.unique(mixed, return_index=True, return_inverse=True)
    del mixed
    if any((c != c[first][of]).any() for c in map(column, range(width))):  # two rows of one hash
        _, first, of = np.unique(np.stack([column(k) for k in range(width)], axis=1), axis=0, return_index=True, return_inverse=True)
    return first, of.ravel()


class Suffixes:
    """The suffixes of a block of benchmark items, with their distinct windows, as flat arrays."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.vocab: dict[bytes, int] = {}
        self.window = window
        self.items: list[str] = []
        number = self.vocab.setdefault
        flat, lengths = array("i"), []
        for item_id, text in items:
            if w := words(text):
                self.items.append(item_id)
                flat.extend(number(x, len(self.vocab) + 1) for x in w)
                flat.append(0)
                lengths.append(len(w))
        self.flat = np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)
        length = np.asarray(lengths, np.int64)
        self.item_start = np.cumsum(length + 1) - (length + 1)
        # a window starts wherever enough words are left; a short item is one window
        n = np.maximum(1, length - window + 1)
        item = np.repeat(np.arange(len(length), dtype=np.int32), n)
        at = (np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        size = np.minimum(window, length)[item].astype(np.int32)
        self.shortest = int(size.min(initial=window)) if len(size) else 0
        test = np.concatenate((self.flat, np.zeros(window, np.int32)))
        begin = self.item_start[item] + at
        column = lambda k: np.where(k < size, test[begin + k], 0)
        # equal windows are one: searched once, whatever number of items they stand in, and told by the first of them
        first, of = _distinct(column, window, len(item))
        self.item, self.at, self.size = item[first], at[first], size[first]
        begin, size = begin[first], self.size
        self.want = np.stack([column(k) for k in range(window)], axis=1)
        self.member = item[np.argsort(of, kind="stable")]  # items of each window, one window after the other
        self.member_end = np.cumsum(np.bincount(of, minlength=len(first)))

    def members(self, w: int) -> list[int]:
        """The items that a window stands in."""
        return self.member[self.member_end[w - 1] if w else 0 : self.member_end[w]].tolist()

    def matches(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, position, length) of all places where a window stands, with the longest match of its first item there."""
        none = np.zeros(0, np.int64)
        if not len(self.size) or not ids.any():
            return none, none, none
        sa = suffix_array(ids, self.window)
        train = np.concatenate((ids.astype(np.int64), np.zeros(self.window, np.int64)))
        test = np.concatenate((self.flat, np.zeros(self.window, np.int64)))
        begin = self.item_start[self.item] + self.at
        cols = np.arange(self.window)
        want = self.want

        def compare(pos: np.ndarray, rows: np.ndarray) -> np.ndarray:
            """-1, 0, 1: training suffix against window, over the window's words."""
            have = train[pos[:, None] + cols]
            ended = np.cumsum(have == 0, axis=1) > 0
            have = np.where(ended, 0, have)
            w = want[rows]
            diff = np.where(cols < self.size[rows][:, None], np.sign(have - w), 0)
            first = (diff != 0).argmax(axis=1)
            return diff[np.arange(len(pos)), first]

        def bound(upper: bool) -> np.ndarray:
            lo, hi = np.zeros(len(begin), np.int64), np.full(len(begin), len(sa), np.int64)
            while len(rows := np.flatnonzero(lo < hi)):
                mid = (lo[rows] + hi[rows]) // 2
                c = compare(sa[mid], rows)
                right = c <= 0 if upper else c < 0
                lo[rows] = np.where(right, mid + 1, lo[rows])
                hi[rows] = np.where(right, hi[rows], mid)
            return lo

        first, last = bound(False), bound(True)
        n = last - first
        suffix = np.repeat(np.arange(len(begin)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pos = sa[first[suffix] + offset]
        length = self.size[suffix].copy()
        going = np.arange(len(pos))
        while len(going):  # extend word by word while both sides go on alike
            t = np.minimum(pos[going] + length[going], len(train) - 1)
            b = np.minimum(begin[suffix[going]] + length[going], len(test) - 1)
            going = going[(train[t] == test[b]) & (train[t] != 0)]
            length[going] += 1
        return suffix, pos, length


def _annotate(docs: DataFrame, block: list[tuple[str, str | None]], window: int, text: str, shard_words: int, added: list[str]) -> DataFrame:
    """docs with the block's columns ``added``: number of words, hits, items and matches. A Python worker builds a block's suffixes once."""
    shared, block_id = docs.sparkSession.sparkContext.broadcast((block, window)), uuid.uuid4().hex
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = kept(("suffixes", block_id), lambda: Suffixes(*shared.value))
        get, shortest = suffixes.vocab.get, suffixes.shortest
        for batch in batches:
            col = batch.column(names.index(text)).to_pylist()
            lo, held, parts = 0, 0, []
            for k, t in enumerate(col):
                w = words(t)
                parts.append(np.fromiter(map(get, w, repeat(0)), np.int32, len(w)))
                held += len(w)
                if held >= shard_words:
                    yield _hits(batch.slice(lo, k + 1 - lo), parts, suffixes, shortest, added)
                    lo, held, parts = k + 1, 0, []
            if parts:
                yield _hits(batch.slice(lo), parts, suffixes, shortest, added)

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    kinds = [f"`{c}` {kind}" for c, kind in zip(added, ("long", HITS, "array<string>", MATCHES), strict=True)]
    return docs.mapInArrow(tidy(run, keeps=True), ", ".join([*schema, *kinds]))


def _hits(rows: pa.RecordBatch, parts: list[np.ndarray], suffixes: Suffixes, shortest: int, added: list[str]) -> pa.RecordBatch:
    lengths = np.asarray([len(p) for p in parts])
    shard, source = [], []
    for d, p in enumerate(parts):  # only runs that can hold a window
        if not shortest or len(p) < shortest:
            continue
        edges = np.flatnonzero(np.diff((p > 0).view(np.int8), prepend=np.int8(0), append=np.int8(0))).reshape(-1, 2)
        for a, b in edges[edges[:, 1] - edges[:, 0] >= shortest].tolist():
            shard += [p[a:b], np.zeros(1, np.int32)]
            source.append((d, a, b - a))
    ids = np.concatenate(shard) if shard else np.zeros(0, np.int32)
    suffix, pos, length = suffixes.matches(ids)
    hits, matches, items = [[] for _ in parts], [[] for _ in parts], [set() for _ in parts]
    if len(pos):
        src = np.asarray(source)
        run_at = np.cumsum(src[:, 2] + 1) - (src[:, 2] + 1)
        run = np.searchsorted(run_at, pos, side="right") - 1
        doc, start = src[run, 0], src[run, 1] + pos - run_at[run]
        order = np.lexsort((start, doc))
        open_: dict[tuple, int] = {}  # where the last match of (document, item, diagonal) ends
        for j in order.tolist():
            d, s, e = int(doc[j]), int(start[j]), int(start[j] + suffixes.size[suffix[j]])
            if hits[d] and s <= hits[d][-1]["end"]:
                hits[d][-1]["end"] = max(e, hits[d][-1]["end"])
            else:
                hits[d].append({"start": s, "end": e})
            k, at = int(suffixes.item[suffix[j]]), int(suffixes.at[suffix[j]])
            if s >= open_.get((d, k, s - at), 0):
                open_[d, k, s - at] = s + int(length[j])
                matches[d].append({"item_id": suffixes.items[k], "item_start": at, "doc_start": s, "length": int(length[j])})
        for d, w in np.unique(np.column_stack((doc, suffix)), axis=0).tolist():
            items[d].update(suffixes.members(w))
    extra = [
        pa.array(lengths, pa.int64()),
        pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        pa.array([sorted({suffixes.items[k] for k in x} - {None}) for x in items], pa.list_(pa.string())),
        pa.array(matches, pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())]))),
    ]
    return pa.RecordBatch.from_arrays([*rows.columns, *extra], names=[*rows.schema.names, *added])


def benchmark_blocks(benchmark: DataFrame, block_chars: int, key: str, text: str) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of at most block_chars characters (or one item)."""
    block, held = [], 0
    for r in benchmark.select(F.col(key).cast("string"), text).dropDuplicates().toLocalIterator(prefetchPartitions=False):
        if block and held + len(r[1] or "") > block_chars:
            yield block
            block, held = [], 0
        block.append((r[0], r[1]))
        held += len(r[1] or "")
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_key: str = "item_id", item_text: str = "text", block_chars: int = 8_000_000, shard_words: int = 2_000_000) -> DataFrame:
    """docs with n_words, n_hit, items (sorted ids), hits (merged word spans) and matches (longest verbatim ones)."""
    blocks = benchmark_blocks(benchmark, block_chars, item_key, item_text)
    first, second = next(blocks, []), next(blocks, None)
    row, *added = fresh(docs, "row", "n_words", "hits", "items", "matches")
    n_words, hits, items, matches = added
    if second is None:
        out = _annotate(docs, first, window, text, shard_words, added)
    else:  # one block at a time; what a block's pass leaves is its hits
        whole = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
        texts, passes = whole.select(row, text), []
        for k, block in enumerate(chain([first, second], blocks)):
            found = _annotate(texts, block, window, text, shard_words, added).drop(text)
            passes.append(materialize(found if k == 0 else found.filter(F.size(hits) > 0), "hits"))
        each = reduce(DataFrame.unionByName, passes).groupBy(row).agg(F.max(n_words).alias(n_words), *[F.flatten(F.collect_list(c)).alias(c) for c in (hits, items, matches)])
        out = whole.join(each, row)
    spans = F.array_sort(hits)
    # spans of several blocks may overlap: count each word once
    covered = F.aggregate(
        spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto")),
    )["n"]
    mine = {"n_words": F.col(n_words), "n_hit": covered.cast("long"), "items": F.array_sort(F.array_distinct(items)), "hits": spans, "matches": F.col(matches)}
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in mine], *[v.alias(k) for k, v in mine.items()])


def decontaminate(docs: DataFrame, benchmark: DataFrame, most_hit: float = 0.0, text: str = "text", **options) -> DataFrame:
    """The documents whose share of hit words is at most most_hit, with their own columns."""
    own = [f"_c{i}" for i in range(len(docs.columns))]
    found = find_contamination(docs.toDF(*own), benchmark, text=own[docs.columns.index(text)], **options)
    return found.filter(F.col("n_hit") <= most_hit * F.col("n_words")).select(*own).toDF(*docs.columns)
