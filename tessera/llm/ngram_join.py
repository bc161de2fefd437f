"""N-gram Jaccard self-join with vertical partitioning, and its components.

Every document is a set of 56-bit hashes of its word n-grams; equal sets form one
class, named by 128 bits of digest, and only classes are joined. The order of the hashes
is the global n-gram order. It is cut into fragments, equal ranges of hashes, and every
class into the segments that fall into each fragment.

1. Fragments. A task per fragment counts in how many classes each n-gram stands, and
   passes on those n-grams that stand in two or more; no other n-gram can be part of
   an overlap. Segments travel packed, 7 bytes an n-gram, and copies of a class meet
   in the fragment and count once. A task counts its fragment in parts, so its arrays stay
   small. An n-gram that so many classes share that they would fill a fragment is
   found in a sample beforehand, goes to all fragments by class, and ranks as the most common.
2. Classes. The passed n-grams of a class, its reduced set, come together again. A
   class whose reduced set is smaller than its least overlap with any partner,
   ceil(t * n), is out. For the others, the rarest n-grams up to the usual prefix
   length are noted: two classes that are linked share one of them.
3. Candidates. Classes that share a noted n-gram and are of comparable size. Of an
   n-gram with more than ``list_cut`` classes not all pairs are made: its classes are paired
   with one hub, the class with the most common n-grams. A class that ends up in another
   component than the hub is searched for once more, by its n-grams outside the hub: what it
   may share with any partner inside the hub is bounded by its overlap with the hub, so a
   partner must share one of those. Links within a component can't change it; for the number
   of a class's links they are counted afterwards, in blocks of the component's classes.
4. Overlaps. The reduced sets are cut into fragments of the same order; the overlap of
   each candidate pair is counted in each fragment separately and summed per pair.
   ``100 * overlap >= 100 * t * union`` makes a link.
5. Components of the links by contraction: in each round every vertex follows its neighbour of
   lowest rank, and what has come together is one vertex of the next round, so two rounds halve the
   vertices of any graph. Labels and links are tables, written each round.

Defined results: a null or empty text has no n-grams, is linked with nothing and is its own
component; a text of fewer than ``n`` words is one n-gram of all of them; rows that repeat are equal
sets; a null doc_id belongs to its class but names no component; a very long text or word is hashed
whole like any other; an empty table gives an empty result; columns other than doc_id and text, however
they are called, are ignored.

Two n-grams share a hash with probability 2**-56, two different sets a class with 2**-128: some 1e-17 over all
pairs of 5e10 sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ASCII_LOWER, Memory, input_bytes, kept, materialize, rows_of, tidy

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
#: Bits of an n-gram's hash; all of them travel.
HASH_BITS = 56
#: Classes that may share an n-gram before its postings are dealt out by class.
HOT_CLASSES = 2_000_000


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of the distinct word n-grams of a text, sorted."""

    def __init__(self, n: int = 5):
        self.n = n
        self.known = Memory(24 << 20)

    def _word(self, w: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        self.known.keep(w, h)
        return h

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        get, new = self.known.get, self._word
        h = np.array([get(w) or new(w) for w in words], dtype=np.uint64)
        k = min(self.n, len(h))
        out = np.full(len(h) - k + 1, np.uint64(k))
        for j in range(k):
            out = _scramble(out + h[j : len(h) - k + 1 + j] * _MIX[j % 5])
        return np.unique(out >> np.uint64(64 - HASH_BITS))


_PACKED = "fragment int, kind int, class binary, n binary, len binary, gram binary, doc_id long, class_id binary, size long"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int64())
    names = [x.split()[0] for x in _PACKED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def _gram_bytes(grams: np.ndarray) -> bytes:
    """56-bit numbers as three planes, of 32, 16 and 8 bits."""
    return grams.astype("<u4").tobytes() + (grams >> np.uint64(32)).astype("<u2").tobytes() + (grams >> np.uint64(48)).astype("<u1").tobytes()


def _grams_of(data: bytes) -> np.ndarray:
    n = len(data) // 7
    out = np.frombuffer(data, "<u4", n).astype(np.uint64)
    out |= np.frombuffer(data, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)
    out |= np.frombuffer(data, "<u1", n, 6 * n).astype(np.uint64) << np.uint64(48)
    return out


def _planes(x: np.ndarray, kind: str) -> bytes:
    """Small numbers as planes of their bytes, low bytes first; the planes that are mostly zero cost next to nothing in a shuffle."""
    x = np.ascontiguousarray(x.astype(kind))
    return x.view("u1").reshape(len(x), -1).T.tobytes()


def _of_planes(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(data, "u1").reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _class_numbers(cls: np.ndarray) -> np.ndarray:
    """The first 64 bits of class ids."""
    return np.ascontiguousarray(cls).view("<u8").reshape(-1, 2)[:, 0]


def _binary(cls: np.ndarray) -> pa.Array:
    """Class ids as a column."""
    fixed = pa.Array.from_buffers(pa.binary(16), len(cls), [None, pa.py_buffer(np.ascontiguousarray(cls).tobytes())])
    return fixed.cast(pa.binary())


def hot_grams(docs: DataFrame, n: int, most: int, sample: int = 200_000, longest: int = 1_000_000) -> np.ndarray:
    """Sorted hashes of the n-grams that more than about most documents share, counted in a sample of the documents.

    They steer the work only: whatever is listed here, or missing, the join's result is the same. Tables of no more than most rows have none.
    """
    rows = docs.count()
    if rows <= most:
        return np.zeros(0, np.uint64)
    share = min(1.0, sample / rows)
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1 << 40)) < int(share * (1 << 40)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for batch in batches:
            sets = [shingle(text) for (text,) in rows_of(batch.select(["text"]))]
            gram, k = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(k)], names=["gram", "k"])

    counts = chosen.select("text").mapInArrow(tidy(count), "gram long, k long").groupBy("gram").agg(F.sum("k").alias("k"))
    found = counts.filter(F.col("k") > share * most / 2).orderBy(F.desc("k"), "gram").limit(longest).select("gram").collect()
    return np.sort(np.asarray([r["gram"] for r in found], np.int64).astype(np.uint64))


def _among(grams: np.ndarray, hot: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
    return hot[at] == grams


def segments(docs: DataFrame, fragments: int, n: int, hot: np.ndarray, chunk: int = 1_000_000) -> DataFrame:
    """Per task and fragment the packed segments of its classes (kind 0), and a row per document (kind 1)."""
    bits = (fragments - 1).bit_length()
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, hot = kept(("shingler", n), lambda: Shingler(n)), shared.value
        sent: set[bytes] = set()
        sets: list[np.ndarray] = []
        classes: list[bytes] = []
        held = nameless = 0

        def flush() -> Iterator[pa.RecordBatch]:
            sizes = np.asarray([len(s) for s in sets])
            flat = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
            ids = np.frombuffer(b"".join(classes), "S16")
            frag = (flat >> np.uint64(HASH_BITS - bits)).astype(np.int32)
            if len(hot):
                common = _among(flat, hot)
                frag[common] = (_class_numbers(ids) >> np.uint64(64 - bits)).astype(np.int32)[owner[common]] if bits else 0
            # owners are in order, so the stable sort keeps a class's n-grams together within a fragment
            order = np.argsort(frag, kind="stable")
            frag, owner, flat = frag[order], owner[order], flat[order]
            at = np.concatenate(([0], np.flatnonzero(np.diff(frag)) + 1, [len(frag)]))
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own, cnt = np.unique(owner[a:b], return_counts=True)
                yield _packed([(int(frag[a]), 0, ids[own].tobytes(), _planes(sizes[own], "<u4"), _planes(cnt, "<u4"), _gram_bytes(flat[a:b]), None, None, None)])

        for batch in batches:
            rows = []
            for doc_id, text in rows_of(batch):
                grams = shingle(text)
                cid = hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None
                nameless += doc_id is None
                spread = hash((doc_id, int.from_bytes(cid or b"", "little"))) + (nameless if doc_id is None else 0)
                rows.append((spread % fragments, 1, None, None, None, None, doc_id, cid, len(grams)))
                if cid is not None and cid not in sent:
                    if len(sent) == 100_000:
                        sent.clear()  # a class that is sent again counts once all the same
                    sent.add(cid)
                    sets.append(grams)
                    classes.append(cid)
                    held += len(grams)
                if held >= chunk:
                    yield from flush()
                    sets, classes, held = [], [], 0
            yield _packed(rows)
        if sets:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run, keeps=True), _PACKED)


def _shared_grams(table: pa.Table, bits: int, buckets: int, hot: np.ndarray, part_grams: int = 1_000_000) -> Iterator[tuple]:
    """One fragment: the n-grams of two or more classes, packed by class bucket. The fragment is counted in parts of about part_grams n-grams."""
    table = table.filter(pa.compute.equal(table.column("kind"), 0)).select(["fragment", "class", "n", "len", "gram"])
    if not table.num_rows:
        return
    fragment = table.column("fragment")[0].as_py()
    cls = np.concatenate([np.frombuffer(x, "S16") for x in table.column("class").to_pylist()])
    n, cnt = (np.concatenate([_of_planes(x, "<u4") for x in table.column(c).to_pylist()]).astype(np.int64) for c in ("n", "len"))
    gram = np.concatenate([_grams_of(x.as_py()) for x in table.column("gram")])
    # a class that several tasks have sent counts once
    first = np.zeros(len(cls), bool)
    first[np.unique(cls, return_index=True)[1]] = True
    if not first.all():
        gram = gram[np.repeat(first, cnt)]
        cls, n, cnt = cls[first], n[first], cnt[first]
    owner = np.repeat(np.arange(len(cls), dtype=np.int32), cnt)
    deep = max(0, -(-len(gram) // part_grams) - 1).bit_length()
    bucket_of = (_class_numbers(cls) % np.uint64(buckets)).astype(np.int64)
    for part in range(1 << deep):
        mine = (gram >> np.uint64(HASH_BITS - bits - deep)) & np.uint64((1 << deep) - 1) == part if deep else slice(None)
        low, own = gram[mine], owner[mine]
        _, inverse, df = np.unique(low, return_inverse=True, return_counts=True)
        df = np.minimum(df[inverse], 65535)
        if len(hot) and len(low):
            df[_among(low, hot)] = 65535
        common = df >= 2
        low, own, df = low[common], own[common], df[common]
        if not len(low):
            continue
        bucket = bucket_of[own]
        order = np.lexsort((own, bucket))
        own, low, df, bucket = own[order], low[order], df[order], bucket[order]
        at = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            of, k = np.unique(own[i:j], return_counts=True)
            yield int(bucket[i]), fragment, cls[of].tobytes(), _planes(n[of], "<u4"), _planes(k, "<u4"), _gram_bytes(low[i:j]), _planes(df[i:j], "<u2")


def _reduced_sets(table: pa.Table, percent: int) -> pa.Table:
    """One bucket of classes: class, n, commonness, n-grams and prefix of each class that can have a partner."""
    cls = np.concatenate([np.frombuffer(x, "S16") for x in table.column("class").to_pylist()])
    n, cnt = (np.concatenate([_of_planes(x, "<u4") for x in table.column(c).to_pylist()]).astype(np.int64) for c in ("n", "len"))
    gram = np.concatenate([_grams_of(x.as_py()) for x in table.column("gram")])
    df = np.concatenate([_of_planes(x, "<u2") for x in table.column("df").to_pylist()])
    ids, at, number = np.unique(cls, return_index=True, return_inverse=True)
    total = n[at]
    owner = np.repeat(number.astype(np.int32), cnt)
    have = np.bincount(owner, minlength=len(ids))
    least = -(-percent * total // 100)
    able = have >= least
    # n-grams of one class only come first in the order of rarity, and are part of the prefix
    prefix = np.maximum(0, total - least + 1 - (total - have))
    mine = able[owner]
    owner, gram, df = owner[mine], gram[mine], df[mine]
    order = np.lexsort((gram, df, owner))
    owner, gram, df = owner[order], gram[order], df[order]
    kept, start = np.flatnonzero(able), np.concatenate(([0], np.cumsum(have[able])))
    rank = np.arange(len(owner)) - start[np.searchsorted(kept, owner)]
    noted = rank < prefix[owner]
    longs = lambda values, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.astype(np.int64)))
    common = np.bincount(owner, np.log2(np.maximum(df, 1)), len(ids))[kept] / total[kept]
    by_gram = np.lexsort((gram, owner))
    return pa.table({
        "class_id": _binary(ids[kept]), "n": pa.array(total[kept]), "common": pa.array(common),
        "grams": longs(gram[by_gram], start), "prefix": longs(gram[noted], np.concatenate(([0], np.cumsum(np.minimum(prefix, have)[kept])))),
    })


def reduced_sets(docs: DataFrame, n: int, percent: int, fragments: int | None = None, hot_classes: int = HOT_CLASSES) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, class_id, size; sets: class_id, n, common, grams, prefix), both written."""
    fragments = fragments or min(1 << 24, max(16, 1 << max(0, (input_bytes(docs) // (24 << 20)).bit_length())))
    bits = (fragments - 1).bit_length()
    buckets = fragments
    hot = hot_grams(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), n, hot_classes)
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    packed = segments(docs, fragments, n, hot)
    schema = "bucket int, fragment int, class binary, n binary, len binary, gram binary, df binary, doc_id long, class_id binary, size long"

    def fragment_task(table: pa.Table) -> pa.Table:
        rows = list(_shared_grams(table, bits, buckets, shared.value))
        m = table.filter(pa.compute.equal(table.column("kind"), 1)).select(["doc_id", "class_id", "size"])
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
        left = [pa.chunked_array([pa.array([r[i] for r in rows], t), pa.nulls(m.num_rows, t)]) for i, t in enumerate(kinds)]
        right = [pa.chunked_array([pa.nulls(len(rows), m.schema.field(c).type), *m.column(c).chunks]) for c in names[7:]]
        return pa.table([*left, *right], names=names)

    both = materialize(packed.groupBy("fragment").applyInArrow(tidy(fragment_task), schema), "segments")
    members = both.filter("bucket is null").select("doc_id", "class_id", "size")

    def bucket_task(table: pa.Table) -> pa.Table:
        return _reduced_sets(table, percent)

    sets = both.filter("bucket is not null").select("bucket", "class", "n", "len", "gram", "df")
    sets = sets.groupBy("bucket").applyInArrow(tidy(bucket_task), "class_id binary, n long, common double, grams array<long>, prefix array<long>")
    return members, materialize(sets, "reduced-sets")


def _comparable(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _ordered(pairs: DataFrame) -> DataFrame:
    """Each pair once, the smaller class first."""
    small = F.col("a") < F.col("b")
    return pairs.select(*[F.when(small, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("a", "b", "a"), ("b", "a", "b"), ("na", "nb", "na"), ("nb", "na", "nb"))]).distinct()


def _overlaps(pairs: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """a, b, na, nb, overlap: counted per fragment of the n-gram order and summed per pair."""
    seg = lambda p: F.filter("grams", lambda g: F.shiftright(g * parts, HASH_BITS) == p)
    cut = sets.select("class_id", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), seg(p).alias("seg")) for p in range(parts)])).alias("s"))
    cut = cut.select("class_id", "s.part", "s.seg").filter(F.size("seg") > 0)
    first = pairs.join(cut.withColumnsRenamed({"class_id": "a", "seg": "seg_a"}), "a")
    both = first.join(cut.withColumnsRenamed({"class_id": "b", "seg": "seg_b"}), ["b", "part"])
    partial = both.select("a", "b", "na", "nb", F.size(F.array_intersect("seg_a", "seg_b")).cast("long").alias("overlap"))
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("overlap"))


def _linked(percent: int) -> Column:
    return 100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))


def connected_components(links: DataFrame, hops: int = 3) -> DataFrame:
    """(id, component) of every id in links (a, b); the component is the smallest id reachable.

    Each round, every vertex follows its neighbour of lowest rank, a hash that changes from round to round, if that
    ranks below itself; paths are shortened by doubling ``hops`` times. Links between what they lead to are the next
    round's. Of two rounds, each vertex that isn't alone takes part in a merge, so the number of rounds is logarithmic
    at most, and each works on fewer vertices. The end of a path needn't be reached in a round: links keep what is connected together.
    """
    edges = materialize(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a != b").distinct(), "links")
    labels = None
    for k in range(1_000_000):
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(k)), F.col(c))  # noqa: B023, E731
        lowest = edges.groupBy("a").agg(F.min(rank("b")).alias("low"))
        step = materialize(lowest.select(F.col("a").alias("id"), F.when(F.col("low") < rank("a"), F.col("low.b")).otherwise(F.col("a")).alias("to")), "steps")
        for _ in range(hops):
            on = step.select(F.col("id").alias("to"), F.col("to").alias("next"))
            step = step.join(on, "to").select("id", F.col("next").alias("to"))
        step = materialize(step, "steps")
        if labels is None:
            labels = step.withColumnRenamed("to", "at")
        else:
            moved = labels.join(step.select(F.col("id").alias("at"), "to"), "at", "left")
            labels = materialize(moved.select("id", F.coalesce("to", "at").alias("at")), "labels")
        for end in ("a", "b"):
            edges = edges.join(step.withColumnRenamed("id", end), end).drop(end).withColumnRenamed("to", end)
        edges = materialize(edges.filter("a != b").select("a", "b").distinct(), "links")
        if edges.isEmpty():
            break
    least = labels.groupBy("at").agg(F.min("id").alias("component"))
    return materialize(labels.join(least, "at").select("id", "component"), "labels")


def similar_links(sets: DataFrame, percent: int, list_cut: int = 24, parts: int = 4) -> tuple[DataFrame, DataFrame]:
    """(links (a, b) between classes, class_id of the classes in long lists).

    The links are enough for the components to be those of all links; those that may be missing
    lie within a component, between two classes in long lists.
    """
    posts = sets.select("class_id", "n", "common", F.explode("prefix").alias("gram"))
    lists = posts.groupBy("gram").agg(F.count("*").alias("k"), F.max(F.struct("common", "class_id", "n")).alias("hub")).filter("k > 1")
    posts = materialize(posts.join(lists, "gram"), "postings")
    short, long_ = posts.filter(F.col("k") <= list_cut), posts.filter(F.col("k") > list_cut)
    fits = _comparable(F.col("na"), F.col("nb"), percent)
    left, right = (short.select("gram", F.col("class_id").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    pairs = left.join(right, "gram").filter(F.col("a") < F.col("b")).select("a", "b", "na", "nb")
    # hubs are met whatever their size: the overlap with the hub bounds all others
    hubs = materialize(long_.select(F.col("hub.class_id").alias("hub"), "class_id").filter("hub != class_id").distinct(), "hubs")
    sizes = long_.select("class_id", "n").distinct()
    met = hubs.join(sizes.withColumnsRenamed({"class_id": "hub", "n": "nh"}), "hub").join(sizes, "class_id")
    small = F.col("hub") < F.col("class_id")
    met = met.select(F.least("hub", "class_id").alias("a"), F.greatest("hub", "class_id").alias("b"), F.when(small, F.col("nh")).otherwise(F.col("n")).alias("na"), F.when(small, F.col("n")).otherwise(F.col("nh")).alias("nb"))
    tried = pairs.filter(fits).union(met).distinct()
    found = materialize(_overlaps(tried, sets, parts), "overlaps")
    links = found.filter(_linked(percent)).select("a", "b")
    if long_.isEmpty():
        return links, sizes.select("class_id")
    more = _beyond_hubs(sets, long_, hubs, found, links, percent)
    more = _overlaps(materialize(_ordered(more.filter(fits)), "pairs").join(found.select("a", "b"), ["a", "b"], "left_anti"), sets, parts)
    return materialize(links.union(more.filter(_linked(percent)).select("a", "b")), "all-links"), sizes.select("class_id")


def _beyond_hubs(sets: DataFrame, long_: DataFrame, hubs: DataFrame, found: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) that may still join the component of a to another.

    For a class x and a hub h, an overlap of x with any y is at most |x & h| plus what x and y
    share outside h. So a partner that needs a larger overlap than |x & h| holds one of the
    n-grams of x outside h; the rarest of these, up to the usual prefix length, are enough.
    Only classes that lie in another component than the hub of one of their lists are searched
    for: all other pairs of a list are connected through its hub.
    """
    labels = connected_components(links)
    of = lambda df, key, name: df.join(labels.withColumnsRenamed({"id": key, "component": name}), key, "left").withColumn(name, F.coalesce(name, key))
    apart = of(of(hubs, "hub", "hub_component"), "class_id", "component").filter("component != hub_component").select("class_id", "hub", "component")
    both = found.select("a", "b", "na", "nb", "overlap")
    both = both.select(F.col("a").alias("class_id"), F.col("b").alias("hub"), F.col("na").alias("n"), "overlap").union(both.select("b", "a", "nb", "overlap"))
    known = apart.join(both, ["class_id", "hub"])
    # the hub that covers most leaves the fewest n-grams to look for
    best = known.groupBy("class_id", "n", "component").agg(F.max(F.struct("overlap", "hub")).alias("c"))
    whole = F.col("c.overlap") < F.ceil(F.lit(percent) * F.col("n") / 100)
    best = materialize(best.select("class_id", "n", "component", whole.alias("whole"), F.col("c.overlap").alias("overlap"), F.col("c.hub").alias("hub")), "searched")
    mine = best.join(sets.select("class_id", "grams"), "class_id").join(sets.select(F.col("class_id").alias("hub"), F.col("grams").alias("hub_grams")), "hub")
    outside = mine.select("class_id", "n", "component", "whole", "overlap", F.size("grams").alias("reduced"), F.explode(F.array_except("grams", "hub_grams")).alias("gram"))
    outside = materialize(outside, "outside")
    every = sets.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), F.explode("grams").alias("gram")).join(outside.select("gram").distinct(), "gram", "left_semi")
    every = materialize(every, "outside-postings")
    rank = F.row_number().over(Window.partitionBy("class_id").orderBy("k", "gram"))
    ranked = outside.join(every.groupBy("gram").agg(F.count("*").alias("k")), "gram").withColumn("rank", rank)
    singles = F.col("n") - F.col("reduced")
    prefix = F.when(F.col("whole"), F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1 - singles).otherwise(F.col("n"))
    asked = ranked.filter((F.col("rank") <= prefix) & (F.col("k") > 1)).select("gram", F.col("class_id").alias("a"), F.col("n").alias("na"), "component", "whole", F.col("overlap").alias("o"))
    met = asked.join(every, "gram").filter(F.col("a") != F.col("b")).filter(_comparable(F.col("na"), F.col("nb"), percent)).groupBy("a", "b", "na", "nb", "component", "whole", "o").agg(F.count("*").alias("shared"))
    # where all n-grams outside the hub were looked for, those found bound the overlap
    met = of(met.filter(F.col("whole") | (percent * (F.col("na") + F.col("nb")) <= (100 + percent) * (F.col("o") + F.col("shared")))), "b", "other")
    pairs = met.filter("component != other").select("a", "b", "na", "nb")
    # a hub that covers more than a small partner asks for says nothing about it: those few are met directly
    part = best.filter("not whole").join(long_.select("class_id", "gram"), "class_id")
    small = part.select("gram", F.col("class_id").alias("a"), F.col("n").alias("na"), "overlap", "component").join(long_.select("gram", F.col("class_id").alias("b"), F.col("n").alias("nb")), "gram")
    small = small.filter((percent * (F.col("na") + F.col("nb")) <= (100 + percent) * F.col("overlap")) & (F.col("a") != F.col("b")))
    small = of(small.select("a", "b", "na", "nb", "component").distinct(), "b", "other").filter("component != other").select("a", "b", "na", "nb")
    return pairs.union(small)


def _block_degrees(size: np.ndarray, flat: np.ndarray, ends: np.ndarray, mine: int, alone: bool, percent: int, tile: int = 512, width: int = 2048, dense: int = 128) -> np.ndarray:
    """How many links each row of a pair of blocks has across; rows up to mine are one block, the others the other. Of a block alone, all rows are both.

    N-grams of at least ``dense`` rows are multiplied as 0/1 matrices, a width of n-grams at a time; of the others the pairs of rows are counted.
    """
    rows = np.arange(len(size))
    left, right = (rows, rows) if alone else (rows[:mine], rows[mine:])
    first = int(right[0]) if len(right) else 0
    degree = np.zeros(len(size), np.int64)
    if not len(left) or not len(right):
        return degree
    _, gram, k = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(rows, np.diff(ends))
    overlap = np.zeros((len(left), len(right)), np.float32)
    often = k[gram] >= dense
    at, cols = owner[often], np.unique(gram[often], return_inverse=True)[1]
    order = np.argsort(cols, kind="stable")
    at, cols = at[order], cols[order]
    for lo in range(0, int(cols[-1]) + 1 if len(cols) else 0, width):
        a, b = np.searchsorted(cols, (lo, lo + width))
        wide = np.zeros((len(size), width), np.float32)
        wide[at[a:b], cols[a:b] - lo] = 1
        overlap += wide[left] @ wide[right].T
    few = ~often & (k[gram] > 1)  # those of one row make no overlap
    order = np.argsort(gram[few], kind="stable")
    at, cols = owner[few][order], gram[few][order]
    in_right, in_left = (at >= first), (at < len(left))
    right_at, starts = at[in_right] - first, np.searchsorted(cols[in_right], np.arange(len(k) + 1))
    left_at, left_cols = at[in_left], cols[in_left]
    met = starts[left_cols + 1] - starts[left_cols]
    upto = np.concatenate(([0], np.cumsum(met)))
    lo = 0
    while lo < len(left_at):  # some million pairs at a time
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + 4_000_000, side="right")) - 1)
        n = met[lo:hi]
        other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[left_cols[lo:hi]], n)
        cell, times = np.unique(np.repeat(left_at[lo:hi], n) * len(right) + right_at[other], return_counts=True)
        overlap.ravel()[cell] += times
        lo = hi
    for lo in range(0, len(left), tile):
        own = left[lo : lo + tile]
        o = overlap[lo : lo + tile].astype(np.int64)
        linked = 100 * o >= percent * (size[own][:, None] + size[right][None, :] - o)
        if alone:
            linked[np.arange(len(own)), own] = False  # no class is linked with itself
        degree[own] += linked.sum(axis=1)
        if not alone:
            degree[right] += linked.sum(axis=0)
    return degree


def class_degrees(links: DataFrame, long_: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, block_classes: int = 512, block_grams: int = 2_000_000) -> DataFrame:
    """class_id, n_class_links: the number of classes each class is linked with, over all pairs.

    Pairs of which one class is in no long list have all been tried, and are counted from the
    links. For the others the classes in long lists of each component are dealt into blocks: by
    size, so that only blocks of equal or neighbouring sizes can hold links, and by hash. Each
    pair of blocks is one task's group, counts all its overlaps, and passes on one number a class.
    """
    width = float(np.log(100 / percent * 1.0001))
    mine = long_.join(labels.withColumnRenamed("id", "class_id"), "class_id").join(sets.select("class_id", "n", "grams"), "class_id")
    mine = mine.withColumn("band", F.floor(F.log("n") / width).cast("long"))
    bands = mine.groupBy("component", "band").agg(F.count("*").alias("k"), F.sum(F.size("grams")).alias("g"))
    bands = materialize(bands.select("component", "band", "k", F.ceil(F.greatest(F.col("k") / block_classes, F.col("g") / block_grams)).cast("long").alias("blocks")), "bands")
    near = bands.select("component", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above")).unionByName(bands.select("component", (F.col("band") + 1).alias("band"), F.lit(0).cast("long").alias("above"), F.col("blocks").alias("below")), allowMissingColumns=True)
    near = near.groupBy("component", "band").agg(F.max("above").alias("above"), F.max("below").alias("below"))
    bands = bands.join(near, ["component", "band"], "left").na.fill(0, ["above", "below"]).filter("k > 1 or above > 0 or below > 0")
    block = F.pmod(F.xxhash64("class_id"), F.col("blocks"))
    dealt = mine.join(bands, ["component", "band"]).withColumn("block", block)
    # each pair is named by its lower block: (band, block) and then the step in bands and the other block; a block with itself is met once, as side 0
    meet = lambda band, low, step, high, side: F.struct(band.alias("low_band"), low.alias("low"), F.lit(step).alias("step"), high.alias("high"), F.lit(side).alias("side"))
    upto = lambda k, f: F.when(k > 0, F.transform(F.sequence(F.lit(0).cast("long"), k - 1), f)).otherwise(F.array().cast("array<struct<low_band:bigint,low:bigint,step:int,high:bigint,side:int>>"))
    band, b = F.col("band"), F.col("block")
    within = upto(F.col("blocks"), lambda o: F.when(b <= o, meet(band, b, 0, o, 0)).otherwise(meet(band, o, 0, b, 1)))
    met = F.concat(within, upto(F.col("above"), lambda o: meet(band, b, 1, o, 0)), upto(F.col("below"), lambda o: meet(band - 1, o, 1, b, 1)))
    keys = ["component", "low_band", "low", "step", "high"]
    groups = dealt.select("component", "class_id", "n", "grams", F.explode(met).alias("m")).select("component", "m.*", "class_id", "n", "grams")

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by("side")
        grams = table.column("grams").combine_chunks()
        ends = np.concatenate(([0], np.cumsum(grams.value_lengths().to_numpy())))
        low, high, step = (table.column(c)[0].as_py() for c in ("low", "high", "step"))
        mine = int((table.column("side").to_numpy() == 0).sum())
        degree = _block_degrees(table.column("n").to_numpy(), grams.flatten().to_numpy(), ends, mine, step == 0 and low == high, percent)
        return pa.table([table.column("class_id"), pa.array(degree, pa.int64())], names=["class_id", "n_class_links"])

    counted = groups.groupBy(*keys).applyInArrow(count, "class_id binary, n_class_links long")
    seen = lambda key: long_.select(F.col("class_id").alias(key), F.lit(1).alias(f"long_{key}"))
    other = links.join(seen("a"), "a", "left").join(seen("b"), "b", "left").filter("long_a is null or long_b is null")
    told = other.select(F.explode(F.array("a", "b")).alias("class_id"), F.lit(1).cast("long").alias("n_class_links"))
    return told.union(counted).groupBy("class_id").agg(F.sum("n_class_links").alias("n_class_links"))


def ngram_jaccard_components(docs: DataFrame, n: int = 5, percent: int = 75, **options) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), class_id (the smallest doc_id with an equal set) and n_class_links (the number of other classes it is linked with) of every document."""
    return _components(docs, n, percent, True, **options)


def _components(docs: DataFrame, n: int = 5, percent: int = 75, count_links: bool = True, fragments: int | None = None, hot_classes: int = HOT_CLASSES, hot_copies: int = 500, **options) -> DataFrame:
    """ngram_jaccard_components(); without count_links, n_class_links is 0, and no links are counted."""
    members, sets = reduced_sets(docs, n, percent, fragments, hot_classes)
    links, long_ = similar_links(sets, percent, **options)
    labels = connected_components(links)
    none = labels.select(F.col("id").alias("class_id"), F.lit(None).cast("long").alias("n_class_links"))
    degree = materialize(class_degrees(links, materialize(long_, "long-listed"), labels, sets, percent), "degrees") if count_links else none
    full = members.filter("size > 0")
    classes = materialize(full.groupBy("class_id").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")), "classes")
    # only classes in links need a component of more than themselves
    linked = classes.join(labels.withColumnRenamed("id", "class_id"), "class_id").join(degree, "class_id", "left")
    named = linked.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    linked = linked.join(named, "component").select("class_id", "component_id", "n_class_links")
    every = classes.join(linked, "class_id", "left").select("class_id", "copies", "first_doc", F.coalesce("component_id", "first_doc").alias("component_id"), F.coalesce("n_class_links", F.lit(0)).cast("long").alias("n_class_links"))
    every = materialize(every, "named-classes")
    # classes of very many copies, 100,000 of them at most, are sent to the copies; the copies of all others meet their class
    many = F.col("copies") > max(hot_copies, (classes.agg(F.sum("copies").alias("n")).first()["n"] or 0) // 100_000)
    hot, cold = (every.filter(x).drop("copies") for x in (many, ~many))
    sent = full.join(F.broadcast(hot), "class_id", "left")
    rest = sent.filter("n_class_links is null").select("doc_id", "size", "class_id").join(cold, "class_id")
    told = sent.filter("n_class_links is not null").unionByName(rest).select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.col("first_doc").alias("class_id"), "n_class_links")
    empty = members.filter("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_class_links"))
    return told.unionByName(empty)


def keep_one_per_component(docs: DataFrame, broadcast_ids: int = 1_000_000, **options) -> DataFrame:
    """docs without near copies: of each component the document with the smallest doc_id stays.

    Up to ``broadcast_ids`` ids of documents that go are broadcast, so that the texts stay where
    they are read; more of them are joined by a shuffle.

    Rows that repeat both doc_id and text count as one document. Rows that share a doc_id with different texts go
    only if each of them is a copy of another document. Rows with a null doc_id can't be named and all stay. Null and
    empty texts are no copies of anything; columns are kept as they are, however they are called; an empty table stays empty.
    """
    found = materialize(_components(docs, count_links=False, **options).select("doc_id", "component_id"), "components")
    gone = materialize(found.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("copy")).filter("copy").select("doc_id"), "gone")
    if gone.count() <= broadcast_ids:
        gone = F.broadcast(gone)
    one = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = found.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1")
    if again.isEmpty():
        return one
    known = one.filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "text"])
    return known.unionByName(one.filter(F.col("doc_id").isNull()))
