"""Word and phrase boundaries, and parts moved to legal cuts, against plain Python."""

import math
import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import lexicon as L
from tessera.operators import wording as X


def brute_marks(chars, text):
    """Walks the text and the characters side by side."""
    if not text:
        return None
    out, i = set(), 0
    for c in text:
        if c.isspace():
            continue
        if c in X.MARKS:
            if i:
                out.add(i - 1)
        elif i < len(chars) and chars[i] == c:
            i += 1
        else:
            return None
    return sorted(out) if i == len(chars) else None


def brute_path(s, weight, single):
    @lru_cache(None)
    def best(i):
        if i == len(s):
            return (0, 0)
        options = [(single + best(i + 1)[0], 1)]
        options += [(weight[s[i:j]] + best(j)[0], j - i) for j in range(i + 1, len(s) + 1) if s[i:j] in weight]
        return max(options)

    out, at = [], 0
    while at < len(s):
        at += best(at)[1]
        out.append(at)
    return out


def brute_breaks(chars, text, counts, joined):
    if not chars:
        return [], []
    total = sum(counts.values())
    weight = {w: round(math.log(n / total) * 1e6) for w, n in counts.items()}
    single = -round(math.log(total) * 1e6)
    marks = brute_marks(chars, text)
    if marks is None:
        whole = "".join(chars)
        stop = next((k for k, c in enumerate(whole) if c in X.MARKS or c.isspace()), len(whole))
        stretches = [(0, whole[:stop])]
    else:
        stretches, at, now = [], 0, ""
        for c in text + " ":
            if c in X.MARKS or c.isspace():
                stretches.append((at, now))
                at, now = at + len(now), ""
            else:
                now += c
    words = set()
    for at, s in stretches:
        for e in brute_path(s, weight, single):
            inside = joined and e < len(s) and all(c.isascii() and c.isalnum() for c in s[e - 1 : e + 1])
            if not inside:
                words.add(at + e - 1)
    last = {len(chars) - 1}
    return sorted(set(marks or ()) | last), sorted(words | set(marks or ()) | last)


WORDS = {"丝滑": 9, "搅匀": 5, "丝": 3, "滑搅": 1, "配料表": 7, "配料": 4, "表": 6, "看": 8, "see": 2, "the": 9, "ab": 3, "abc": 3, "cd": 3}
TEXTS = ["丝滑。搅匀", "看 配料表，丝滑搅匀！", "see the 配料表", "abcd看abcd", "……看、、表。", " ", "。", "", "表表表", "see2the"]


def test_breaks_equal_a_plain_search(spark):
    rows, n = [], 0
    for text in TEXTS:
        bare = [c for c in text if not c.isspace() and c not in X.MARKS]
        for chars, heard in ((bare, text), (bare, None), (bare, text + "x"), (bare[::-1], text), ([*bare, "，", "看"], text), (None, text)):
            rows.append((n if n else None, chars, heard))
            n += 1
    df = spark.createDataFrame(rows, "k int, chars array<string>, text string")
    words = spark.createDataFrame([*WORDS.items(), ("丝滑", 1), ("", 4), ("never", 0)], "word string, n int")
    counts = WORDS | {"丝滑": 10}
    for joined in (X.JOINED, None):
        got = {r["k"]: (r["punct"], r["brk"]) for r in X.word_breaks(df, words, ["k"], joined=joined).collect()}
        assert len(got) == len(rows)
        for k, chars, text in rows:
            assert got[k] == brute_breaks(chars or [], text, counts, joined), (chars, text)


def test_breaks_without_words_or_streams(spark):
    none = spark.createDataFrame([], "word string, n int")
    df = spark.createDataFrame([(1, list("看配")), (2, list("ab"))], "k int, chars array<string>").withColumn("text", F.lit("看，配"))
    got = {r["k"]: (r["punct"], r["brk"]) for r in X.word_breaks(df, none, ["k"]).collect()}
    assert got == {1: ([0, 1], [0, 1]), 2: ([1], [1])}
    assert X.word_breaks(df.limit(0), none, ["k"]).count() == 0


def brute_cover(n, cuts, parts, role):
    """One border at a time, looking at every cut."""
    cuts = sorted({c for c in cuts if 0 <= c < n - 1})
    out, at = [], 0
    for a, b, kind in [*parts, (n, n, None)]:
        if a > at:
            inner = [c for c in cuts if at <= c < a - 1]
            if a - at > 14 and inner:
                c = min(inner, key=lambda x: (abs(x - at + 1 - (a - at + 1) // 2), x))
                out += [[at, c + 1, role], [c + 1, a, role]]
            else:
                out.append([at, a, role])
        if kind is not None:
            out.append([a, b, kind])
        at = b
    if not cuts:
        return [tuple(x) for x in out]
    done = out[:1]
    for a, b, kind in out[1:]:
        last = done[-1]
        options = [c for c in cuts if last[0] <= c < b - 1]
        if last[1] != a or a - 1 in cuts:
            done.append([a, b, kind])
        elif options:
            c = min(options, key=lambda x: (abs(x - a + 1), x))
            last[1] = c + 1
            done.append([c + 1, b, kind])
        else:
            done[-1] = [last[0], b, kind if b - a > last[1] - last[0] else last[2]]
    return [tuple(x) for x in done]


@given(st.integers(0, 80), st.lists(st.integers(-2, 82), max_size=12), st.lists(st.integers(0, 80), max_size=9))
@settings(max_examples=400, deadline=None)
def test_covered_parts_equal_brute_force(n, cuts, edges):
    edges = sorted({min(e, n) for e in edges})
    parts = [(a, b, f"r{k % 3}") for k, (a, b) in enumerate(zip(edges[::2], edges[1::2], strict=False))]
    legal = sorted({c for c in cuts if 0 <= c < n - 1})
    got = X.cover(n, legal, parts, "narration")
    assert got == brute_cover(n, cuts, parts, "narration")
    assert [a for a, _, _ in got] == [0, *[b for _, b, _ in got[:-1]]][: len(got)] and (not got or got[-1][1] == n)


def test_covered_parts_of_rows(spark):
    rows = [(1, 40, [4, 9, 30], [(3, 12, "emphasis"), (12, 20, "label")]), (2, 5, None, None), (3, 0, [], []), (4, None, [1], None)]
    df = spark.createDataFrame(rows, "k int, n int, cuts array<int>, parts array<struct<a:int,b:int,role:string>>")
    got = {r["k"]: [tuple(p) for p in r["parts"]] for r in X.covered_parts(df).collect()}
    assert got[1] == brute_cover(40, rows[0][2], rows[0][3], "narration") and got[2] == [(0, 5, "narration")] and got[3] == [] and got[4] == []
    rng = random.Random(1)
    assert X.best_path(3, [(0, 2, -5), (1, 2, -5)], -5 - rng.randrange(3)) == [2, 3]


def test_equal_stretches_meet_the_dictionary_once(spark, monkeypatch):
    """Many copies of a stretch, at several places of their streams, get the words of one; a dictionary too large to be sent gives the same."""
    rows = [(k, list("xy" * (k % 3) + "thecat"), None) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, chars array<string>, text string")
    words = spark.createDataFrame([("the", 5), ("cat", 5), ("xy", 1)], "word string, n int")
    want = {k: [2 * i + 1 for i in range(k % 3)] + [2 * (k % 3) + 2, 2 * (k % 3) + 5] for k in range(40)}
    plan = X.word_breaks(df, words, ["k"], joined=None)
    assert {r["k"]: r["brk"] for r in plan.collect()} == want
    told = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in told and "min(struct(_id" in told
    monkeypatch.setattr(X, "SENT_WORDS", 0)
    assert {r["k"]: r["brk"] for r in X.word_breaks(df, words, ["k"], joined=None).collect()} == want


def test_a_large_dictionary_meets_stretches_and_not_their_parts(spark, monkeypatch):
    """Slices of stretches and blocks of words, in one block and in many, give the same as a plain search; no row is made for a character of a stretch."""
    rows = []
    for text in TEXTS:
        bare = [c for c in text if not c.isspace() and c not in X.MARKS]
        rows += [(len(rows) + j, chars, heard) for j, (chars, heard) in enumerate([(bare, text), (bare, None), (bare[::-1], text), (None, text)])]
    df = spark.createDataFrame(rows, "k int, chars array<string>, text string")
    words = spark.createDataFrame(list(WORDS.items()), "word string, n int")
    for key, value in {"SENT_WORDS": 0, "SLICE_CHARS": 7, "PACK_WORDS": 2}.items():
        monkeypatch.setattr(X, key, value)
    for size in (100, 3):
        monkeypatch.setattr(X, "BLOCK_WORDS", size)
        plan = X.word_breaks(df, words, ["k"])
        got = {r["k"]: (r["punct"], r["brk"]) for r in plan.collect()}
        assert got == {k: brute_breaks(chars or [], text, WORDS, X.JOINED) for k, chars, text in rows}
        told = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in told and "explode(sequence(1" not in told


def test_words_and_paths_as_arrays_equal_a_plain_search(monkeypatch):
    """Numbers that run full, tables of a single stretch, characters beyond 16 bits, and ties."""
    rng = random.Random(3)
    for room, cells in ((1 << 62, 8_000_000), (1000, 50), (60, 1)):
        monkeypatch.setattr(L, "ROOM", room)
        monkeypatch.setattr(L, "CELLS", cells)
        for alphabet in ("ab", "abc漢字\U0001f600é") * 10:
            draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(rng.randint(1, n)))
            weight = {draw(alphabet, 9): -rng.choice([5, 7, 10, 10, 20]) for _ in range(rng.randint(0, 40))}
            texts = sorted({draw(alphabet + "zq", 40) for _ in range(20)} | {a + b for a in list(weight)[:4] for b in list(weight)[:4]})
            words, size, seen = L.Words(pa.array(list(weight), pa.string()), np.array(list(weight.values()), np.int64)), np.array([len(s) for s in texts]), 0
            for few in L.few_at_a_time(size, len(words.lengths)):
                paths = L.Paths(size[few], sorted(words.lengths))
                paths.search(L.codes(pa.array([texts[i] for i in few]))[0], words)
                ends, count = paths.best(-11)
                stretch, *found = paths.found()
                for no, at in enumerate(few):
                    s = texts[at]
                    edges = [(a, b - a, weight[s[a:b]]) for a in range(len(s)) for b in range(a + 1, len(s) + 1) if s[a:b] in weight]
                    assert sorted(zip(*[x[stretch == no].tolist() for x in found], strict=True)) == edges
                    assert [e + 1 for e in np.split(ends, np.cumsum(count))[no].tolist()] == X.best_path(len(s), edges, -11)
                seen += len(few)
            assert seen == len(texts)


def test_covered_parts_hold_few_lines_at_a_time(spark, monkeypatch):
    """A batch of Python objects has FEW_LINES lines, whatever comes from Spark at once."""
    rows = [(k, 30, [4, 9, 20], [(2, 7 + k % 5, "label")]) for k in range(50)]
    df = spark.createDataFrame(rows, "k int, n int, cuts array<int>, parts array<struct<a:int,b:int,role:string>>").coalesce(1)
    want = {r["k"]: r["parts"] for r in X.covered_parts(df).collect()}
    monkeypatch.setattr(X, "FEW_LINES", 3)
    got = X.covered_parts(df)
    assert {r["k"]: r["parts"] for r in got.collect()} == want and len(want) == 50
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()
