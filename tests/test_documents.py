"""Likeness of texts, broken JSON, nested values and sound files against the standard library."""

import io
import json
import math
import random
import wave
from difflib import SequenceMatcher
from statistics import median

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import aggregates as A
from tessera.operators import fuzzy as Z
from tessera.operators import matching as M
from tessera.operators import rules as R
from tessera.plans.queries import QUERIES
from tessera.sources import files

WORDS = st.text("abcé语 ", max_size=40)


@given(WORDS, WORDS)
@settings(max_examples=300, deadline=None)
def test_blocks_equal_those_of_the_standard_library(a, b):
    m = SequenceMatcher(None, a, b, autojunk=False)
    mine = Z.common_blocks(a, b)
    joined = []
    for i, j, n in mine:  # the library joins blocks that touch
        if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
            joined[-1][2] += n
        else:
            joined.append([i, j, n])
    assert [tuple(x) for x in joined] == [tuple(x) for x in m.get_matching_blocks() if x.size]
    assert abs(Z.similarity(a, b) - m.ratio()) < 1e-12


def test_lines_of_a_plan_are_found_by_likeness(spark):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("abcd ") for _ in range(rng.randrange(0, 14)))
    lines = [(rng.choice([1, 2, None]), i, text()) for i in range(120)] + [(1, 200, None), (3, 201, "alone")]
    plan = [(rng.choice([1, 2, None]), text()) for _ in range(25)] + [(1, ""), (1, None), (2, "abcd" * 30)]
    got = {r["i"] for r in Z.not_planned(spark.createDataFrame(lines, "k int, i int, text string"), spark.createDataFrame(plan, "k int, text string"), ["k"]).collect()}

    def planned(k, t):
        known = [p for key, p in plan if key == k and p]
        return bool(t) and any(t in p or p in t or SequenceMatcher(None, t, p, autojunk=False).ratio() >= 0.6 for p in known)

    assert got == {i for k, i, t in lines if not planned(k, t)} and 0 < len(got) < len(lines)


def test_line_span(spark):
    words = [("Hello,", 1.0), ("big", 2.0), ("world", 3.0)]
    rows = [(1, words, "hello world"), (2, words, "zzz"), (3, [], "a"), (4, words, None), (5, None, "a")]
    df = spark.createDataFrame(rows, "k int, w array<struct<text:string,until:double>>, line string")
    got = {r["k"]: (r["v"]["until"], r["v"]["cover"]) for r in df.select("k", Z.line_span(F.col("w"), F.col("line")).alias("v")).collect()}
    assert got == {1: (3.0, 1.0), 2: (3.0, 0.0), 3: (0.0, 0.0), 4: (0.0, 0.0), 5: (0.0, 0.0)}


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | st.text('ab{}[]",:\\é', max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("kl", max_size=2), x, max_size=3), max_leaves=12)


@given(st.dictionaries(st.text("kl", max_size=2), VALUES, min_size=1, max_size=3), st.data())
@settings(max_examples=300, deadline=None)
def test_cut_off_json_is_closed(doc, data):
    text = json.dumps(doc, ensure_ascii=False)
    assert json.loads(S.closed_json(text)) == doc
    cut = text[: data.draw(st.integers(1, len(text)))]
    mended = S.closed_json(cut)
    assert mended is not None and isinstance(json.loads(mended), dict)
    begun = json.loads(mended)
    assert list(begun)[: max(0, len(begun) - 1)] == list(doc)[: max(0, len(begun) - 1)]  # what came before the cut is all there
    for k in list(begun)[:-1]:
        assert begun[k] == doc[k]


def test_json_that_can_be_mended_and_that_cannot():
    cases = {
        '{"a": [1, 2, {"b": 3}': {"a": [1, 2, {"b": 3}]}, '{"a": [1, 2}': {"a": [1, 2]}, '{"a": 1,}': {"a": 1}, '{"a": 1 "b": 2}': {"a": 1, "b": 2}, '{"a": {"b": [1,]}, }': {"a": {"b": [1]}},
        '{"a": "x\\': {"a": "x"}, '{"a": "x\\u12': {"a": "x"}, '{"a": "x\\\\': {"a": "x\\"}, '{"a": 1, "b"': {"a": 1}, '{"a": 1, "b":': {"a": 1}, '{"a": 1} and more': {"a": 1}, '{"a": 1]}': {"a": 1}, '{"a": tru': {}, "{": {},
    }
    for text, want in cases.items():
        assert json.loads(S.closed_json(text)) == want, text
    for text in ("", None, "[1", "{{", "plain"):
        assert S.closed_json(text) is None
    assert S.closed_json('{"a":' * 100_000) is None or True  # too deep for a parser: no error


def test_nested_values_are_told_by_level(spark):
    df = spark.createDataFrame([(1, ["x", None], {"a": [1, 2]}, True, "", (2.5, [("q", False)])), (2, [], None, None, "无", None)], "k int, l array<string>, m map<string,array<int>>, b boolean, s string, t struct<f:double,g:array<struct<n:string,o:boolean>>>")
    got = {r["k"]: r["v"] for r in df.select("k", S.nested_brief(df, {c: c for c in "lmbst"}).alias("v")).collect()}
    assert got == {1: "l：x、None；m：a1、2；b：True；t：f2.5，gnq，oFalse", 2: ""}


def test_items_of_lists(spark):
    rows = [(1, '[3, "a", true, null, {"n": 5}, [1], "", 2.5]'), (2, "[]"), (3, None), (4, '{"a": 1}'), (5, "oops")]
    got = {r["k"]: r["v"] for r in spark.createDataFrame(rows, "k int, t string").select("k", S.item_objects(F.col("t"), "id").alias("v")).collect()}
    assert [json.loads(x) for x in got[1]] == [{"id": 3}, {"id": "a"}, {"n": 5}, {"id": 2.5}]
    assert got[2] == [] and not got[3] and not got[4] and not got[5]


def test_violations_are_found_at_any_depth(spark):
    deep = '{"a":' * 45 + '[{"passed": false, "used": true}]' + "}" * 45
    rows = [(1, deep), (2, '{"passed": false, "used": true, "x": [{"passed": true, "used": true}, {"passed": false, "used": true}]}'), (3, None), (4, "no json"), (5, '{"passed": null, "used": true}')]
    got = sorted((r["k"], r["path"]) for r in R.nested_violations(spark.createDataFrame(rows, "k int, doc string"), "doc").collect())
    assert got == [(1, ".".join("a" * 45) + "[]"), (2, ""), (2, "x[]")]
    assert R.nested_violations(spark.createDataFrame([], "k int, doc string"), "doc").count() == 0


def sound(channels, width, rate, frames):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(b"\0" * channels * width * frames)
    return out.getvalue()


def test_sound_durations_equal_the_standard_library(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for k in range(30):
        c, w, rate, n = rng.choice([1, 2, 6]), rng.choice([1, 2, 3, 4]), rng.choice([8000, 44100, 48000]), rng.randrange(0, 3000)
        raw = sound(c, w, rate, n)
        if k % 3 == 0:  # a list of odd length before the data
            raw = raw[:36] + b"LIST\x05\0\0\0abcde\0" + raw[36:]
        rows.append((k, bytearray(raw)))
        want[k] = n / rate
    ulaw = b"RIFF\0\0\0\0WAVEfmt \x10\0\0\0\x07\0\x01\0" + (8000).to_bytes(4, "little") * 2 + b"\x01\0\x08\0data" + (800).to_bytes(4, "little") + b"x" * 400
    rows += [(100, bytearray(ulaw)), (101, bytearray(b"RIFF")), (102, None), (103, bytearray(sound(1, 2, 8000, 4)[:30])), (104, bytearray(b"")), (105, bytearray(b"OggS" + bytes(60)))]
    got = {r["k"]: r["s"] for r in spark.createDataFrame(rows, "k int, c binary").select("k", files.wav_duration(F.col("c")).alias("s")).collect()}
    assert {k: got[k] for k in want} == want
    assert got[100] == 0.05 and all(got[k] is None for k in range(101, 106))


def test_reports_lose_only_the_section_that_failed(spark):
    rows = [(1, 2, "two", ["b", ""], None, None), (1, 1, "one", None, "x" * 400, None), (1, 3, "three", None, None, None), (2, 1, "one", ["a"], None, "cannot read")]
    df = spark.createDataFrame(rows, "task int, section_no int, title string, lines array<string>, error string, unread string")
    got = {r["task"]: r["report"] for r in files.provenance_reports(df, "task", "unread").collect()}
    assert got == {1: "\n> （one 章节生成失败：" + "x" * 160 + "）\nb\n", 2: "# 任务报告 2\n\n> 读取任务产物失败：cannot read\n"}


def test_reports_of_customers_without_orders(spark, tmp_path):
    import duckdb

    from tessera.plans.queries import QUERIES

    spark.createDataFrame([(k, f"name {k}", "seg") for k in range(1, 101)], "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, 10 * k + j) for k in range(1, 40) for j in range(k % 3)], "o_custkey long, o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    run, sql = QUERIES["provenance_reports"]
    c = duckdb.connect()
    for x in ("customer", "orders"):
        c.execute(f"CREATE VIEW {x} AS SELECT * FROM '{tmp_path}/{x}.parquet/*.parquet'")
    assert sorted(map(tuple, run(spark, str(tmp_path)).collect())) == sorted(c.execute(sql).fetchall())


def test_lines_are_placed_in_a_recording(spark):
    """Found behind the last line or from the beginning, drifted ones squeezed, others spread evenly."""
    stream = "abcabcxyz"
    chars = [("r", i, c, i * 1.0, i + 1.0) for i, c in enumerate(stream)]
    lines = [("r", 0, "abc", 0.0, 3.0), ("r", 1, "abc", 3.0, 6.0), ("r", 2, "abc", 0.0, 3.0), ("r", 3, "xyz", 20.0, 26.0), ("r", 4, "none", 30.0, 32.0), ("r", 5, "", 1.0, 2.0), ("r", 6, "xyz", 5.0, 5.0), ("q", 0, "ab", 0.0, 1.0), ("r", 7, None, 1.0, 2.0)]
    df, st_ = spark.createDataFrame(lines, "k string, o int, text string, start double, end double"), spark.createDataFrame(chars, "k string, char_no int, ch string, char_start double, char_end double")
    got = {(r["k"], r["o"]): (r["line_start"], r["line_end"], r["found"], r["drifted"], [c["start"] for c in r["chars"]]) for r in M.place_lines(df, st_, ["k"], "o").collect()}
    assert got["r", 0] == (0.0, 3.0, True, False, [0.0, 1.0, 2.0]) and got["r", 1] == (3.0, 6.0, True, False, [3.0, 4.0, 5.0])
    assert got["r", 2] == (0.0, 3.0, True, False, [0.0, 1.0, 2.0])  # from the beginning again
    assert got["r", 3] == (20.0, 26.0, True, True, [20.0, 22.0, 24.0])
    assert got["r", 4] == (30.0, 32.0, False, False, [30.0, 30.5, 31.0, 31.5]) and got["q", 0] == (0.0, 1.0, False, False, [0.0, 0.5])
    assert got["r", 5] == got["r", 7] == (1.0, 2.0, False, False, []) and got["r", 6] == (5.0, 5.0, False, False, [])


def test_grams_of_a_stream_of_short_parts(spark):
    rng = random.Random(6)
    rows = [(k, o, "".join(rng.choice("ab語") for _ in range(rng.choice([0, 1, 1, 2, 300, 700])))) for k in (1, 2) for o in range(12)] + [(1, 99, None), (3, 0, "ab")]
    df = spark.createDataFrame(rows, "k int, o int, text string")
    for n in (1, 4):
        got = sorted((r["k"], r["i"], r["gram"]) for r in M.stream_grams(df, ["k"], "o", "text", n).collect())
        whole = {k: "".join(t or "" for key, _, t in sorted(rows, key=lambda r: r[:2]) if key == k) for k in (1, 2, 3)}
        assert got == sorted((k, i, s[i : i + n]) for k, s in whole.items() for i in range(len(s) - n + 1))
        each = sorted((r["k"], r["o"], r["i"], r["gram"]) for r in M.char_grams(df, ["k", "o"], F.col("text"), n).collect())
        assert each == sorted((k, o, i, t[i : i + n]) for k, o, t in rows if t for i in range(len(t) - n + 1))


@pytest.mark.parametrize("blocks", [1, 7])
def test_medians_by_rank_equal_those_of_the_library(spark, blocks):
    """One key has most rows; some places are null, and some hold nothing else."""
    rng = random.Random(8)
    rows = [("hot", [rng.choice([None, 1.5, 2.0, rng.random()]), rng.gauss(0, 1), None]) for _ in range(400)] + [(None, [1.0]), ("two", [3.0, 4.0]), ("two", [5.0, 4.5]), ("none", [])]
    df = spark.createDataFrame(rows, "k string, v array<double>")
    want = {}
    for k in {r[0] for r in rows}:
        columns = [[v[i] for key, v in rows if key == k and len(v) > i and v[i] is not None] for i in range(max(len(v) for key, v in rows if key == k))]
        if columns:
            want[k] = [median(c) if c else None for c in columns]
    for options in ({}, {"few_rows": 0, "block_rows": math.ceil(len(rows) * 8 / blocks)}):
        got = {r["k"]: r["median"] for r in A.median_vector(df, ["k"], "v", **options).collect()}
        assert got.keys() == want.keys()
        for k, c in want.items():
            assert all(x == y or abs(x - y) < 1e-12 for x, y in zip(got[k], c, strict=True))


def _gram_rows():
    """Sources of several parts, with lines that repeat a number, a line of a null number, one of a source that isn't there, empty texts and characters of four bytes."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("ab一😀") for _ in range(n))
    parts = [(k, o, text(rng.choice([0, 1, 3, 40]))) for k in (1, 2, 3) for o in range(6)] + [(None, 0, "abab" * 9), (3, 6, "ab" * 90)]
    lines = [(k, i, text(12)) for k in (1, 2, 3, 9) for i in range(4)] + [(1, 0, "abababab"), (2, None, "ab一a一b"), (3, 5, "ab" * 40), (None, 1, "abab"), (3, 7, None), (3, 8, "😀")]
    return lines, parts


def _hits_of(lines, parts, n):
    streams = {}
    for k, _, x in sorted((p for p in parts if p[0] is not None), key=lambda p: p[:2]):
        streams[k] = streams.get(k, "") + x
    for k, i, x in lines:
        for a in range(len(x or "") - n + 1):
            for b in range(len(streams.get(k, "")) - n + 1):
                if x[a : a + n] == streams[k][b : b + n]:
                    yield k, i, a, b, sum(streams[k][c : c + n] == x[a : a + n] for c in range(len(streams[k])))


@pytest.mark.parametrize("whole_chars", [10_000, 150, 0])
@pytest.mark.parametrize("held", [2_000_000, 50])
def test_grams_of_texts_equal_brute_force_and_tables_of_grams(spark, monkeypatch, whole_chars, held):
    from collections import Counter

    monkeypatch.setattr(M, "HELD_HITS", held)
    lines, parts = _gram_rows()
    l, p = spark.createDataFrame(lines, "k long, line int, text string"), spark.createDataFrame(parts, "k long, o int, text string")
    cells = Counter((k, i, round(a * 0.1 * 2) / 2, round(b * 0.1 * 2) / 2) for k, i, a, b, times in _hits_of(lines, parts, 3) if times <= 12)
    got = M.anchor_cells_of_texts(l, p, ["k", "line"], ["k"], "o", "text", 3, least=2, whole_chars=whole_chars)
    assert {(r["k"], r["line"], r["ref_at"], r["src_at"]): r["votes"] for r in got.collect()} == {c: v for c, v in cells.items() if v >= 2}
    away = lambda x: math.copysign(math.floor(abs(x) * 10 + 0.5) / 10, x) + 0.0
    votes = Counter((k, i, away(b * 0.1 - 0.12 * a)) for k, i, a, b, _ in _hits_of(lines, parts, 2))
    want = set()
    for key in {c[:2] for c in votes}:
        of = sorted(((-v, c[2]) for c, v in votes.items() if c[:2] == key))[:3]
        want |= {(*key, at, -v, r + 1) for r, (v, at) in enumerate(of)}
    best = M.ngram_votes_of_texts(l, p, ["k", "line"], ["k"], "o", "text", 2, best=3, whole_chars=whole_chars)
    assert {(r["k"], r["line"], r["at"], r["votes"], r["rank"]) for r in best.collect()} == want


def test_grams_are_not_shuffled(spark, tmp_path):
    """Anchors, their chains and votes shuffle the texts of a source, and no table of its n-grams."""
    rows = [(k, i, "user", f"line {i} of {k} " * 20) for k in range(4) for i in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    for name in ("anchor_cells", "anchor_chain", "ngram_vote"):
        plan = QUERIES[name][0](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "gram" not in plan and "Join" not in plan.replace("FlatMapCoGroupsInArrow", "")


def test_many_pairs_at_once_equal_the_standard_library(monkeypatch):
    monkeypatch.setattr(Z, "TABLE_CELLS", 40)
    rng = random.Random(11)
    text = lambda: "".join(rng.choice("abc語 ") for _ in range(rng.randrange(14)))
    pairs = [(text(), text()) for _ in range(400)]
    got = Z.blocks_of_pairs(pairs)
    assert [sum(n for *_, n in b) for b in got] == [sum(m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()) for x, y in pairs]


def test_many_short_pairs_take_little_time():
    """20,000 pairs a second and more; pair by pair it were a tenth of that."""
    import time

    pairs = [(f"Customer#{k:09d}", f"Customer {('BUILDING', 'MACHINERY')[k % 2]}") for k in range(20_000)]
    begin = time.monotonic()
    assert len(Z.blocks_of_pairs(pairs)) == 20_000
    assert time.monotonic() - begin < 2


def test_many_recordings_come_to_one_group(spark):
    """Lines of recordings that are dealt to one group are placed as if each were alone; null keys are a recording, and one without stream is spread."""
    items = [(k, o, text, o * 1.0, o + 1.0) for k in (None, 1, 2, 3) for o, text in enumerate(["ab", "zz", "ab", None])]
    chars = [(k, i, c, i * 0.5, i * 0.5 + 0.5) for k in (None, 1, 2) for i, c in enumerate("abxab" if k != 2 else "xxab")]
    df = spark.createDataFrame(items, "k int, o int, text string, start double, end double")
    heard = spark.createDataFrame(chars, "k int, char_no int, ch string, char_start double, char_end double")
    placed = M.place_lines(df, heard, ["k"], "o")
    assert "FlatMapCoGroupsInArrow" in placed._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["k"], r["o"]): (r["line_start"], r["line_end"], r["found"]) for r in placed.collect()}
    assert len(got) == 16
    assert got[1, 0] == got[None, 0] == (0.0, 1.0, True) and got[1, 2] == got[None, 2] and got[1, 2][2]
    assert got[2, 0] == (0.0, 1.0, True) and got[3, 0] == (0.0, 1.0, False) and got[3, 3] == (3.0, 4.0, False)


def test_a_key_of_the_stream_is_read_and_written_once_a_batch():
    import pandas as pd

    from tessera.streaming.keyed import Allocator

    class State:
        def __init__(self):
            self.held, self.calls = {}, 0

        def containsKey(self, k):
            self.calls += 1
            return k in self.held

        def getValue(self, k):
            self.calls += 1
            return self.held[k]

        def updateValue(self, k, v):
            self.calls += 1
            self.held[k] = v

    class Cursor:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, v):
            self.value = v

    def run(sizes):
        a, at, out = Allocator("key", "need", "o", 30.0, "string", None), 0, []
        a.cursor, a.granted = Cursor(), State()
        for n in sizes:
            rows = pd.DataFrame({"key": [f"k{i % 4}" for i in range(at, at + n)], "need": [1.0 + i % 3 for i in range(at, at + n)], "o": range(at, at + n)})
            out += [tuple(r) for p in a.handleInputRows((1,), iter([rows]), None) for r in p.itertuples(index=False)]
            at += n
        return out, a.granted.calls

    once, calls = run([300])
    assert calls == 4
    again, calls = run([100, 200])
    assert once == again and calls == 4 + 8


def test_recordings_share_subtitle_files(spark, tmp_path):
    """Styled lines are told apart by their name and plain files are rows, so the number of files doesn't grow with that of recordings."""
    rows = [(f"r,{k}", k, float(i), i + 0.5, f"line {i}") for k in range(300) for i in range(2)]
    x = spark.createDataFrame(rows, "name string, k long, start double, end double, text string")
    files.write_lines(files.ass_events(x, ["k"], name="name"), str(tmp_path / "ass"), "event", ["k", "start"])
    assert len(list((tmp_path / "ass").rglob("*.txt"))) <= 8
    got = files.read_subtitle_events(spark, str(tmp_path / "ass"))
    assert sorted((r["name"], r["start"], r["text"]) for r in got.collect()) == sorted((f"r {k}", float(i), f"line {i}") for k in range(300) for i in range(2))
    cues = files.srt_cues(x.withColumn("cue_no", (F.col("start") + 1).cast("long")), ["k"])
    whole = files.file_rows(cues, "cue", ["cue_no"], "k")
    assert whole.count() == 300
    assert whole.filter("k = 7").first()["value"] == "1\n00:00:00,000 --> 00:00:00,500\nline 0\n\n2\n00:00:01,000 --> 00:00:01,500\nline 1\n\n"


def test_style_profiles_read_captions_once(spark):
    plan = QUERIES["style_profiles"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation [") == 1


def test_saturation_reads_a_colour_once(spark):
    """The colour's expression stands once in it, and not at each place of its conditions."""
    plan = spark.range(1).select(F.concat(F.lit("#"), F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 6)).alias("c")).select(S.saturation(F.col("c")).alias("s"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("md5") == 1
