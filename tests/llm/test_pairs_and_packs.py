import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, awkward, awkward_documents, empty, prose
from tessera.llm import ngram_join, packing, token_store
from tessera.llm.common import shared_dir
from tessera.llm.queries import tokenizer_path
from tessera.llm.tokens import WordwiseEncoder

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_components(rows, percent=75):
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append((d, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, (d, _) in enumerate(sets):
        if d is not None:
            groups[find(i)].append(d)
    return sorted(((d, len(s), (min(groups[find(i)], default=None) if s else d)) for i, (d, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("cut", [3, 24])
def test_components_equal_all_pairs(spark, cut):
    docs = awkward(spark)
    got = ngram_join.ngram_jaccard_components(docs, list_cut=cut).select("doc_id", "n_shingles", "component_id").collect()
    want = brute_components([(r[0], r[1]) for r in awkward_documents()])
    assert sorted((tuple(r) for r in got), key=str) == want


def brute_degrees(rows, percent=75):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        if w:
            sets.setdefault(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))), []).append(d)
    linked = lambda a, b: a != b and 100 * len(a & b) >= percent * len(a | b)
    return sorted(((d, sum(linked(a, b) for b in sets)) for a, ids in sets.items() for d in ids), key=str)


@pytest.mark.parametrize("cut", [3, 24])
@pytest.mark.parametrize("block", [3, 256])
def test_links_equal_all_pairs(spark, monkeypatch, cut, block):
    monkeypatch.setattr(ngram_join.class_degrees, "__defaults__", (block, 2_000_000))
    rng = random.Random(6)
    rows = [(r[0], r[1]) for r in awkward_documents()]
    base = prose(rng, 150).split()
    for i in range(70):  # near copies of many lengths, some far from one another
        w = base[: rng.randrange(90, 151)]
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"odd{rng.randrange(1000)}"
        rows.append((3000 + i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.ngram_jaccard_components(docs, list_cut=cut).filter("n_shingles > 0").select("doc_id", "n_class_links").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_degrees(rows)


def test_joins_of_an_empty_table(spark):
    assert ngram_join.ngram_jaccard_components(empty(spark)).count() == 0
    assert ngram_join.keep_one_per_component(empty(spark)).count() == 0


def test_one_document_of_each_group_stays(spark):
    docs = awkward(spark)
    kept = ngram_join.keep_one_per_component(docs)
    assert kept.columns == docs.columns
    want = {c for d, _, c in brute_components([(r[0], r[1]) for r in awkward_documents()]) if d is not None and d == c}
    ids = [r["doc_id"] for r in kept.filter("doc_id is not null").collect()]
    assert sorted(ids) == sorted(want)


def test_long_chains_settle_in_few_rounds(spark, monkeypatch):
    rng = random.Random(4)
    shuffled, n = rng.sample(range(10_000, 13_000), 3000), 3000
    valley = [20_000 + (n - k if k < n // 2 else k) for k in range(n)]  # falls, then rises
    combs = [30_000 + (k // 2 if k % 2 == 0 else n + k) for k in range(n)]  # every second vertex is a local minimum
    paths = [list(range(1, 41)), [100, 101], shuffled, valley, combs]
    links = spark.createDataFrame([e for p in paths for e in zip(p, p[1:], strict=False)], "a long, b long")
    written = []
    plain = ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, name: written.append(name) or plain(df, name))
    got = {r["id"]: r["component"] for r in ngram_join.connected_components(links.coalesce(4)).collect()}
    assert got == {x: min(p) for p in paths for x in p}
    assert written.count("links") - 1 <= 20


def test_hot_ngrams_and_copies_change_no_result(spark):
    rows = [(d, t, *rest) for d, t, *rest in awkward_documents()]
    shared = " ".join(f"chorus{k}" for k in range(9))
    rows = [(d, f"{t} {shared}" if t and d is not None and d % 3 == 0 else t, *rest) for d, t, *rest in rows]
    rows += [(5000 + k, rows[60][1], None, None, None, None, None) for k in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    hot = ngram_join.hot_grams(docs, 5, 20)
    assert len(hot)
    plain = ngram_join.ngram_jaccard_components(docs)
    steered = ngram_join.ngram_jaccard_components(docs, hot_classes=20, hot_copies=5, fragments=64)
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(plain) == key(steered)
    assert [r[:3] for r in key(plain.select("doc_id", "n_shingles", "component_id"))] == brute_components([(r[0], r[1]) for r in rows])


def test_a_fragment_is_counted_in_parts():
    rng = np.random.default_rng(2)
    docs = [(bytes([k]) * 16, np.unique(rng.integers(0, 1 << 56, 40, dtype=np.uint64) >> np.uint64(40) << np.uint64(40))) for k in range(30)]
    cols = {"fragment": [0] * 30, "kind": [0] * 30, "class": [c for c, _ in docs], "n": [ngram_join._planes(np.array([len(g)]), "<u4") for _, g in docs]}
    cols |= {"len": cols["n"], "gram": [ngram_join._gram_bytes(g) for _, g in docs]}
    seen = []
    for part_grams in (10_000, 50):
        got = collections.Counter()
        for _, _, cls, _, cnt, gram, df in ngram_join._shared_grams(pa.table(cols), 0, 4, np.zeros(0, np.uint64), part_grams):
            owner = np.repeat(np.frombuffer(cls, "S16"), ngram_join._of_planes(cnt, "<u4"))
            got.update(zip(owner.tolist(), ngram_join._grams_of(gram).tolist(), ngram_join._of_planes(df, "<u2").tolist(), strict=True))
        seen.append(got)
    times = collections.Counter(int(x) for _, g in docs for x in g)
    assert seen[0] == seen[1] == collections.Counter((c, int(x), times[int(x)]) for c, g in docs for x in g if times[int(x)] > 1)


@given(st.integers(0, 1 << 30))
@settings(max_examples=60, deadline=None)
def test_block_degrees_equal_all_pairs(seed):
    rng = np.random.default_rng(seed)
    m, percent = int(rng.integers(1, 25)), int(rng.choice([30, 75]))
    sets = [rng.choice(50, size=rng.integers(1, 40), replace=False) for _ in range(m)]
    size, ends = np.array([len(s) + rng.integers(0, 3) for s in sets]), np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    alone = bool(rng.integers(2))
    mine = m if alone else int(rng.integers(0, m + 1))
    meets = lambda i, j: i != j and (alone or (i < mine) != (j < mine))
    linked = lambda o, i, j: 100 * o >= percent * (size[i] + size[j] - o)
    want = [sum(meets(i, j) and linked(len(np.intersect1d(sets[i], sets[j])), i, j) for j in range(m)) for i in range(m)]
    got = ngram_join._block_degrees(size, np.concatenate(sets), ends, mine, alone, percent, tile=7, width=5, dense=int(rng.integers(2, 20)))
    assert got.tolist() == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_wordwise_ids_are_the_librarys(name):
    enc = WordwiseEncoder(tokenizer_path(name), most_bytes=5000)
    odd = ["a  b\n c\t\td", "x’s it's 'S ’ll I'LL", "  lead", "trail  ", "é áb", "A\x1cB \x1c C", "\x85 x\x85 y", "日本 語, ok", "<|endoftext|> a<|endoftext|>b", "\r\n\r\n a", "½²³ ªº µ", " ", "\n", "İI ıK ſ", "a\nb", "x###\ny,&&& z", "a\x00b \x00"]
    for t in odd + [r[1] or "" for r in awkward_documents()]:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, repr(t[:50])


@given(st.lists(st.integers(0, 1 << 50), max_size=700), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_elias_fano_round_trip(values, shift):
    v = np.sort(np.asarray(values, dtype=np.uint64) >> np.uint64(12 * shift))
    ef, end = token_store.EliasFano.from_bytes(b"x" + token_store.EliasFano.encode(v).to_bytes(), 1)
    assert ef.values().tolist() == v.tolist()
    assert [ef.select(i) for i in range(len(v))] == v.tolist()


@given(st.lists(st.integers(0, 1 << 40), min_size=1, max_size=900), st.data())
@settings(max_examples=60, deadline=None)
def test_elias_fano_parts(values, data):
    values = sorted(values)
    ef, _ = token_store.EliasFano.from_bytes(token_store.EliasFano.encode(np.asarray(values, dtype=np.uint64)).to_bytes(), 0)
    lo = data.draw(st.integers(0, len(values)))
    hi = data.draw(st.integers(lo, len(values)))
    assert ef.part(lo, hi).tolist() == values[lo:hi]


def test_token_files_round_trip(spark):
    path = shared_dir(spark, "test-tokens")
    enc = WordwiseEncoder(tokenizer_path("word_bpe_49k.json"))
    token_store.write_token_store(awkward(spark), path, tokenizer_path("word_bpe_49k.json"), shards=3, frame_tokens=700)
    for frames in (0, 100):
        got = token_store.read_token_store(spark, path, broadcast_frames=frames).orderBy("start").collect()
        rows = sorted(((r[0], r[1]) for r in awkward_documents()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        at = 0
        for r, (d, t) in zip(got, rows, strict=True):
            ids = enc.encode(t or "") + b"\x02\0\0\0"
            assert (r["doc_id"], r["start"], bytes(r["ids"])) == (d, at, ids)
            at += len(ids) // 4
    # all rows share an id or have none: they are dealt to several ranges, and a range to several files
    many = spark.createDataFrame([(7 if k % 2 else None, f"text number {k} " * (k % 40)) for k in range(600)], "doc_id long, text string")
    path = shared_dir(spark, "one-id")
    token_store.write_token_store(many, path, tokenizer_path("word_bpe_49k.json"), shards=6, frame_tokens=200)
    told = token_store.read_token_store(spark, path).orderBy("start").collect()
    assert len(told) == 600 and [r["doc_id"] for r in told] == [None] * 300 + [7] * 300
    assert [r["start"] for r in told] == [sum(x["n_tokens"] for x in told[:k]) for k in range(600)]
    sizes = spark.read.format("binaryFile").load(path).select("length").collect()
    assert len(sizes) > 6 and len({r["doc_id"] for r in told}) == 2
    assert token_store.tokenize_to_store(empty(spark), tokenizer_path("word_bpe_49k.json")).count() == 0


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        g = min(fit) if fit else capacity
        if fit:
            gaps.remove(g)
        gaps.append(g - n)
    return len(gaps)


@given(st.lists(st.integers(1, 50), min_size=1, max_size=300))
@settings(max_examples=80, deadline=None)
def test_plan_is_best_fit_decreasing(lengths):
    counts = collections.Counter(lengths)
    runs, n = packing.plan(dict(counts), 50)
    assert n == best_fit_decreasing(lengths, 50)
    filled = collections.defaultdict(list)
    for length, c in counts.items():
        mine = sorted((r for r in runs if r[0] == length), key=lambda r: r[1])
        for rank in range(c):
            run = [r for r in mine if r[1] <= rank][-1]
            filled[run[2] + rank - run[1]].append((run[3], length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 50


def test_packing_whole_documents(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    enc = WordwiseEncoder(path)
    pieces, placed = packing.pack_documents(awkward(spark), path, capacity=256)
    rows = placed.collect()
    total = sum(len(enc.encode(r[1] or "")) // 4 + 1 for r in awkward_documents())
    assert sum(r["length"] for r in rows) == total
    lengths = [r["length"] for r in rows]
    assert len({r["sequence_id"] for r in rows}) == best_fit_decreasing(lengths, 256)
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    ids = enc.encode(dict((r[0], r[1]) for r in awkward_documents())[1003]) + b"\0\0\0\0"
    for r in by_doc[1003]:
        assert zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]
        assert r["length"] == 256 or r["piece"] == 0
    whole = packing.sequences(packing.best_fit_pack(pieces, 256))
    assert whole.agg(F.sum("n_tokens")).first()[0] == total and whole.agg(F.max("n_tokens")).first()[0] <= 256
    assert packing.pack_documents(empty(spark), path)[1].count() == 0


def test_a_very_long_word_goes_through_joins_stores_and_packs(spark):
    word = "q" * 120_000
    rows = [(1, word), (2, word), (3, word + " a b c d e"), (4, "a b c d e"), (5, "a b " + word)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_components(docs, n=5, percent=75).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (2, 3), 4: (1, 4), 5: (1, 5)}
    for store in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        enc = WordwiseEncoder(tokenizer_path(store))
        want = {d: len(enc.encode(t)) // 4 + 1 for d, t in rows}
        told = {r["doc_id"]: r["n_tokens"] for r in token_store.tokenize_to_store(docs, tokenizer_path(store)).collect()}
        assert told == want
    pieces = packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=2048)[1].collect()
    assert all(sum(r["length"] for r in pieces if r["doc_id"] == d) == n for d, n in want.items()) and max(r["length"] for r in pieces) <= 2048
