"""Worked cases, brute force and invariants of single operators."""

import hashlib
import random
import wave

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import scalars as S
from tessera.operators import aggregates as A
from tessera.operators import catalog as C
from tessera.operators import fuzzy as Z
from tessera.operators import intervals as I
from tessera.operators import matching as M
from tessera.operators import packing as P
from tessera.operators import rules as R
from tessera.operators import sequences as W
from tessera.sources import files
from tessera.streaming import keyed


def one(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_null_facts_meet_wildcards_only(spark):
    bools = [True, False, None]
    df = spark.createDataFrame([(a, b, c) for a in bools for b in bools for c in bools], "a boolean, b boolean, c boolean")
    got = {(r.a, r.b, r.c): r.v.hit_row for r in df.withColumn("v", R.CLIP.decide({"on_camera_speech": F.col("a"), "speech_match": F.col("b"), "has_bgm": F.col("c")})).collect()}
    for (a, b, c), hit in got.items():
        want = 0 if a is False else 4 if a is None else 1 if b is False else 4 if b is None or c is None else 3 if c else 2
        assert hit == want


def test_score_edges(spark):
    got = one(spark, R.STRATEGY.decide({"score": F.col("s")})["action"], [(0.5499,), (0.55,), (0.795,), (0.7999,), (0.80,), (1.0,), (None,)], "s double")
    assert got == ["regenerate", "edit", "edit", "edit", "direct_cut", "direct_cut", "regenerate"]


def test_tables_end_unconditionally():
    with pytest.raises(ValueError):
        R.DecisionTable("x", ("a",), (({"a": True}, "y"),))
    assert "| score | action |" in R.STRATEGY.markdown()


def test_gate_policies_and_blocking(spark):
    df = spark.createDataFrame([(None,), (-50.0,), (-40.0,)], "db double")
    r = [x[0] for x in df.select(R.gate_report("s", R.has_sound(F.col("db")), "block", {"db": F.col("db")})).collect()]
    assert [(x.passed, x.ok) for x in r] == [(None, False), (False, False), (True, True)]
    blocked = df.select(R.NARRATION.decide({"ref_has_speech": F.lit(True)}, F.col("db") < -45, "unused")).collect()
    assert [x[0].hit_row for x in blocked] == [1, -1, 1]


def test_timecodes(spark):
    assert one(spark, S.parse_timecode(F.col("x")), [("1:02.5",), ("90",), ("1:00:00",), ("",), ("x",), (None,)], "x string") == [62.5, 90.0, 3600.0, -1.0, -1.0, -1.0]
    assert one(spark, S.format_srt(F.col("x")), [(3661.5,), (0.0,)], "x double") == ["01:01:01,500", "00:00:00,000"]
    assert one(spark, S.format_ass(F.col("x")), [(3661.5,)], "x double") == ["1:01:01.50"]


def test_scalars(spark):
    assert one(spark, S.first_filled(F.col("a"), F.col("b")), [("", "x"), (None, None), ("0", "y")], "a string, b string") == ["x", "", "0"]
    assert one(spark, S.tristate(F.col("a")), [(" YES ",), ("没有",), ("对",), (None,)], "a string") == [True, False, None, None]
    assert one(spark, S.score_01(F.col("a")), [("1.7",), ("x",), ("0.3",)], "a string") == [1.0, 0.0, 0.3]
    assert one(spark, S.ordinal(F.col("a")), [("7",), ("x",)], "a string") == [7, 1 << 30]
    assert one(spark, S.json_object_in(F.col("a")), [('```json\n{"a": {"b": 1}}\n```',), ("none",)], "a string") == ['{"a": {"b": 1}}', None]
    assert one(spark, S.hard_cut(F.col("a")), [("叠化",), ("硬切",), ("叠化后硬切",), ("推镜",), ("",), (None,)], "a string") == [False, True, False, False, True, True]
    assert one(spark, S.display_width(F.col("a")), [("ab",), ("中文a",)], "a string") == [2, 5]
    assert one(spark, S.normal_box(F.col("a")), [([0.9, 0.8, 0.1, 0.2],), ([0.1, 0.1, 0.1, 0.5],), ([100.0, 50.0, 0.0, 0.0],)], "a array<double>") == [[0.1, 0.2, 0.9, 0.8], None, [0.0, 0.0, 1.0, 0.5]]
    assert one(spark, F.round(S.saturation(F.col("a")), 4), [("#ff0000",), ("#808080",)], "a string") == [1.0, 0.0]
    assert one(spark, S.loudness_gain(F.col("a")), [(-25.1,), (-20.3,), (-60.0,), (-40.0,)], "a double") == [pytest.approx(5.1), 0.0, 0.0, 6.0]


def test_interval_union_and_complement(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (1, 1.0, 3.0), (1, 3.0, 4.0), (1, 6.0, 7.0), (1, 9.0, 9.0), (1, 8.0, 5.0)], "g int, start double, end double")
    assert I.covered_length(df, ["g"]).first().covered == 5.0
    s = spark.createDataFrame([(1, 2.0, 3.0, 0.0, 10.0), (1, 5.0, 9.0, 0.0, 10.0)], "g int, start double, end double, lo double, hi double")
    r = I.active_profile(s, ["g"], "lo", "hi").first()
    assert (r.active, r.longest) == (5.0, 2.0)


def test_nearest_of_equal_times_are_those_of_least_id(spark):
    iv = spark.createDataFrame([("a", 1, 100.0, 110.0), ("a", 2, 0.0, 1.0), ("a", 3, 89.0, 91.0), ("b", 4, 5.0, 6.0)], "k string, iv long, t0 double, t1 double")
    times = {"a": [90.0] * 5 + [95.0] + [115.0] * 4 + [116.0], "b": [200.0]}
    frames = [(g, i, t) for g, ts in times.items() for i, t in enumerate(ts)]
    got = {}
    for r in I.nearest_rows(iv, spark.createDataFrame(frames[::-1], "k string, fr long, t double"), ["k"], "iv", "fr").collect():
        got.setdefault(r["iv"], {})[r["rank"]] = r["fr"]
    assert got == {1: {1: 5, 2: 6, 3: 7}, 2: {1: 0, 2: 1, 3: 2}, 3: {1: 0, 2: 1, 3: 2}, 4: {1: 0}}
    late = spark.createDataFrame([("a", 5, 200.0, 201.0), ("a", 6, 93.4, 93.6)], "k string, iv long, t0 double, t1 double")
    got = sorted((r["iv"], r["rank"], r["fr"]) for r in I.nearest_rows(late, spark.createDataFrame(frames[:10], "k string, fr long, t double"), ["k"], "iv", "fr").collect())
    assert got == [(5, 1, 6), (5, 2, 7), (5, 3, 8), (6, 1, 5), (6, 2, 0), (6, 3, 1)]


def test_bracket_window(spark):
    pts = spark.createDataFrame([(1, 18.0)], "g int, t double")
    anchors = spark.createDataFrame([(1, 10.0, 100.0), (1, 30.0, 140.0)], "g int, at double, v double")
    b = I.asof_bracket(pts, anchors, ["g"], "t", "at", "v")
    lo, hi = I.padded_window(F.lit(18.0), F.lit(20.0), F.col("lo_at"), F.col("lo_value"), F.col("hi_at"), F.col("hi_value"))
    assert tuple(b.select(lo, hi).first()) == (92.0 + 0.0, 148.5)


def test_trusted_timeline(spark):
    rows = [(1, 1, 0.0, 2.0, 10.0), (1, 2, 3.0, 5.0, 10.0), (2, 1, 0.0, 2.0, 10.0), (2, 2, 1.0, 5.0, 10.0)]
    df = spark.createDataFrame(rows, "g int, o int, start double, end double, total double")
    got = {(r.g, r.o): (r.start, r.end) for r in I.trusted_timeline(df, ["g"], ["o"], "total").collect()}
    assert got == {(1, 1): (0.0, 2.0), (1, 2): (3.0, 5.0), (2, 1): (0.0, 3.3), (2, 2): (3.3, 10.0)}


def test_gap_edge_is_strict(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 1.2), (1, 2.5)], "g int, t double")
    assert [r.session for r in W.gap_sessions(df, ["g"], "t", 1.2).orderBy("t").collect()] == [1, 1, 2]


def test_run_blocks_null_equals_null(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, True), (1, 4, False)], "g int, o int, f boolean")
    assert [r.block for r in W.run_blocks(df, ["g"], ["o"], ["f"]).orderBy("o").collect()] == [1, 1, 2, 3]


def test_short_runs_join_the_one_before(spark):
    df = spark.createDataFrame([(1, 1, x / 10) for x in range(2)] + [(1, 2, 0.2 + x / 10) for x in range(10)] + [(1, 3, 1.2)] + [(1, 4, 1.3 + x / 10) for x in range(8)], "g int, run int, t double")
    got = [(round(r.start, 1), round(r.end, 1)) for r in W.shots_from_runs(df, ["g"]).orderBy("shot").collect()]
    assert got == [(0.0, 0.2), (0.2, 1.3), (1.3, 2.1)]


def test_allocator():
    calls = [("k1", 2.0), ("k2", 2.5), ("k3", 2.0), ("k1", 3.0)]
    assert list(W.allocate(iter(calls), 5.0)) == [(0.0, 2.0, False), (2.0, 2.5, False), (0.0, 2.0, True), (0.0, 3.0, False)]


def test_line_segmentation_cuts_hard_and_at_gaps():
    flat = lambda marks: [(i * 0.1, i * 0.1 + 0.1, i in marks, i in marks) for i in range(60)]
    assert W.segment_chars(flat({59})).count(0) == 27  # no break before the end: cut hard
    assert W.segment_chars(flat(set())).count(0) == 18  # no break at all: anywhere
    assert W.segment_chars(flat({7, 59})).count(0) == 8 and W.segment_chars(flat({3, 59})).count(0) == 27
    words = [(i * 0.1, i * 0.1 + 0.1, False, i in {5, 19}) for i in range(40)]
    assert W.segment_chars(words).count(0) == 20
    assert W.segment_chars([(0.0, 0.1, False, False), (1.0, 1.1, False, False)]) == [0, 1]
    assert W.segment_chars([(0.0, 0.1, False, False), (1.0, 1.1, False, True)]) == [0, 0]  # a pause waits for a legal place


def test_dp_vectors():
    assert P.dp_segments([6, 6, 6, 6], [False] * 4) == [(0, 2), (2, 4)]
    assert P.dp_segments([6, 6, 6, 6], [False, False, True, False]) == [(0, 1), (1, 3), (3, 4)]
    assert P.dp_segments([2, 2, 14], [False] * 3) == [(0, 2), (2, 3)]
    assert P.dp_segments([5] * 5, [False] * 5) == [(0, 2), (2, 5)]


def test_water_fill():
    assert P.water_fill(8, [30, 2]) == [6.0, 2.0]
    assert P.water_fill(10, [1, 1, 1]) == [3.4, 3.3, 3.3]
    assert P.water_fill(25, [2, 2, 2, 2, 40]) == [4.8, 4.8, 4.8, 4.8, 5.8]
    assert P.water_fill(1.0, [1, 1, 1, 1]) == [0.4, 0.2, 0.2, 0.2] and min(P.water_fill(20, [1] * 60)) > 0


FILLS = [
    ([118.0, 201.0, 373.0, 158.0], [4.1, 5.3, 5.9, 4.7]),
    ([207.0, 958.0, 178.0, 1232.0], [4.1, 5.9, 4.0, 6.0]),
    ([94.0, 1109.0, 235.0, 1074.0, 127.0, 686.0], [0.9, 6.0, 1.7, 6.0, 1.1, 4.3]),
]


def test_water_fill_rounds_as_its_sql_does():
    """Three that fell on the other side of half a tenth; the values are those of the query's SQL."""
    for sizes, want in FILLS:
        assert P.water_fill(20.0, sizes, half_away=True) == want
    assert P.water_fill(20.0, [1.0] * 80, half_away=True)[1:] == [0.3] * 79 and P.water_fill(20.0, [1.0] * 80)[1:] == [0.2] * 79


@pytest.mark.parametrize("order", [1, -1])
def test_rescaled_lengths_are_tenths_in_any_order_of_rows(spark, order):
    rows = [("a", k, x / 50.0) for k, x in enumerate([9, 69, 139, 583])] + [("b", k, x) for k, x in enumerate([0.1] * 3 + [1e16, 1.0, -1e16])]
    df = spark.createDataFrame(rows[::order], "k string, i int, length double").coalesce(1).withColumn("total", F.lit(40.0))
    got = {(r["k"], r["i"]): r["length"] for r in P.rescale_total(df, ["k"], "length", "total", ["i"]).collect()}
    assert [got["a", k] for k in range(4)] == [0.5, 3.5, 7.0, 29.2]
    assert [got["b", k] for k in range(6)] == [0.1] * 3 + [1e16, 1.0, -1e16]  # from left to right they come to 0; in another order not


def test_redistribution(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 26), (1, 2, 4.0, 6), (1, 3, 3.0, None)], "g int, o int, d double, c int")
    got = [r.new_length for r in P.redistribute(df, ["g"], "d", "c").orderBy("o").collect()]
    assert got[0] == pytest.approx(4.0) and sum(got) == pytest.approx(9.0) and got[1] >= 2.0 and got[2] >= 1.5


def test_deal_sentences():
    assert [sum(map(len, g)) for g in P.deal_sentences(["aaaaa", "bbb", "cccccccc", "dddd"], 2)] == [16, 4]
    assert P.deal_sentences(["a", "b", "cccccccccc"], 3) == [["a"], ["b"], ["cccccccccc"]] and P.deal_sentences([], 3) == []


def test_wrap_keeps_text_and_width():
    rng = random.Random(0)
    for _ in range(50):
        text = " ".join("".join(rng.choice("abc,中文。") for _ in range(rng.randrange(1, 9))) for _ in range(20))
        lines = P.wrap(text, 20)
        assert all(P.text_width(x) <= 20 for x in lines)
        assert "".join("".join(lines).split()) == "".join(text.split())


def test_sequence_check(spark):
    rows = [("a", 1, ["x"], ["y", "z"]), ("a", 2, ["x", "y"], ["z"]), ("b", 1, ["x"], ["y"]), ("b", 2, ["y"], ["x"]), ("c", 1, ["x"], ["y"])]
    df = spark.createDataFrame(rows, "s string, o int, have array<string>, lack array<string>")
    got = {r.s: (r.accepted, r.reason) for r in P.sequence_check(df, "s", "o", "have", "lack", F.lit(True)).collect()}
    assert got == {"a": (True, None), "b": (False, "not monotone"), "c": (False, "fewer than two steps")}
    assert {r.s: r.never for r in A.never_present(df, ["s"], "lack", "o").collect()} == {"a": ["z"], "c": ["y"]}


def greedy(rows, cut):
    items, choices, out = set(), set(), set()
    for i, c, s, r in sorted(rows, key=lambda x: (-x[2], x[0], x[3], x[1])):
        if s >= cut and i not in items and c not in choices:
            items.add(i)
            choices.add(c)
            out.add((i, c))
    return out


def test_assignment_equals_a_greedy_pass(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(8), rng.choice([0.5, 0.6, 0.7, 0.9]), r) for i in range(12) for r in range(3)]
    df = spark.createDataFrame(rows, "item int, choice int, score double, rank int")
    got = {(r.item, r.choice) for r in M.exclusive_assignment(df, "item", "choice", "score", "rank").collect() if r.choice is not None}
    assert got == greedy(rows, 0.55)
    vec = spark.createDataFrame([(1, "A", 0.9, 0), (1, "B", 0.7, 1), (2, "A", 0.95, 0), (2, "C", 0.6, 1), (3, "A", 0.9, 0), (4, "B", 0.5, 0)], "item int, choice string, score double, rank int")
    assert {r.item: r.choice for r in M.exclusive_assignment(vec, "item", "choice", "score", "rank").collect()} == {1: "B", 2: "A", 3: None}


def test_assignment_query_covers_all_of_lineitem(spark, tmp_path):
    from tessera.plans.queries import QUERIES

    rng = random.Random(2)
    rows = [(i, rng.randrange(9), k, rng.randrange(11) / 100) for i in range(1, 40) for k in range(rng.randrange(1, 4))]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linenumber int, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["greedy_assignment"][0](spark, str(tmp_path)).collect()
    assert sorted(r["item"] for r in got) == list(range(1, 40))
    assert {(r["item"], r["choice"]) for r in got if r["choice"] is not None} == greedy([(i, c, round(1 - x * 4, 4), k) for i, c, k, x in rows], 0.55)


def test_any_order_keeps_a_customer_out(spark, tmp_path):
    from tessera.plans.queries import QUERIES

    spark.createDataFrame([(1,), (2,), (3,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 5.0), (2, 400000.0)], "o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    assert [r["c_custkey"] for r in QUERIES["customers_without_orders"][0](spark, str(tmp_path)).collect()] == [3]


def test_lines_and_cues_take_every_turn_whole(spark, tmp_path):
    from tessera.plans.queries import QUERIES

    rows = [(1, 0, "short"), (1, 1, "x" * 60), (2, 5, "a b c, " * 20)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {}
    for r in QUERIES["timed_lines"][0](spark, str(tmp_path)).collect():
        got.setdefault((r["conv_id"], r["turn"]), {})[r["line_no"]] = r["n"]
    for c, k, text in rows:
        last = len(text) - 1
        marks = [(x == "," or i == last, x in " ," or i == last or text[i + 1] == " ") for i, x in enumerate(text)]
        lines = W.segment_chars([(i * 0.1, (i + 1) * 0.1, *m) for i, m in enumerate(marks)])
        assert got[c, k] == {n: lines.count(n) for n in set(lines)}
    cues = {(r["conv_id"], r["turn"]): r["cue"] for r in QUERIES["srt_cues"][0](spark, str(tmp_path)).collect()}
    want = "2\n00:00:05,000 --> 00:00:09,500\n" + "x" * 60 + "\n"
    assert cues[1, 1] == hashlib.md5(want.encode()).hexdigest()


def test_monotone_chain_takes_the_earliest_links():
    rng = random.Random(1)
    for _ in range(500):
        pairs = sorted((rng.randrange(8), rng.randrange(8)) for _ in range(rng.randrange(1, 12)))
        size, link = [], []
        for i, (_, y) in enumerate(pairs):
            before = [j for j in range(i) if pairs[j][1] <= y]
            link.append(max(before, key=lambda j: (size[j], -j), default=-1))
            size.append(1 + (size[link[-1]] if before else 0))
        at, want = size.index(max(size)), []
        while at >= 0:
            want.append(pairs[at])
            at = link[at]
        assert M.monotone_chain(pairs) == want[::-1]


def test_monotone_chain():
    assert M.monotone_chain([(1, 10), (2, 50), (3, 11), (4, 12), (5, 12), (6, 3)]) == [(1, 10), (3, 11), (4, 12), (5, 12)]


def test_stream_placement_and_cover():
    assert M.place_in_stream(["ab", "cd", "ab", "zz"], "abxcdab") == [(0, 2), (3, 5), (5, 7), None]
    assert Z.cover_ratio("hello world", "world") == 1.0 and Z.cover_ratio("", "x") == 0.0


def test_not_planned(spark):
    a = spark.createDataFrame([("v", "hello there"), ("v", "quite different"), ("w", "alone")], "k string, text string")
    b = spark.createDataFrame([("v", "hello there friend")], "k string, text string")
    assert {r.text for r in Z.not_planned(a, b, ["k"]).collect()} == {"quite different", "alone"}


def test_catalog(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "o int, digest string")
    b = spark.createDataFrame([(3, "x"), (4, "y"), (5, None)], "o int, digest string")
    assert {(r.priority, r.o) for r in C.first_source_wins([a, b], "digest", "o").collect()} == {(0, 1), (0, 2), (1, 4), (1, 5)}
    c = spark.createDataFrame([(b"abc", 3), (b"abd", 3), (b"z", 1)], "content binary, size int")
    want = spark.createDataFrame([(3, "900150983cd24fb0d6963f7d28e17f72")], "size int, digest string")
    assert C.lookup_digest(c, want, "content", "size", "digest").count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "a", "n": 1}')
    (tmp_path / "b.json").write_text("not json")
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])
    docs = files.read_json_documents(spark, str(tmp_path / "*.json"), schema).cache()
    assert [r.id for r in files.task_catalog(docs, ["id"]).collect()] == ["a"]
    with wave.open(str(tmp_path / "s.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\0\0" * 4000)
    found = files.scan_media(spark, str(tmp_path)).collect()
    assert [(r.name, r.media) for r in found] == [("s.wav", "audio")]
    sec = spark.read.format("binaryFile").load(str(tmp_path / "s.wav")).select(files.wav_duration(F.col("content"))).first()[0]
    assert sec == 0.5
    (tmp_path / "c.ass").write_text("[Events]\nDialogue: 0,0:00:01.50,0:00:02.00,S,,0,0,0,,{\\b1}Hi, you\\Nthere\n")
    r = files.read_subtitle_events(spark, str(tmp_path / "c.ass")).first()
    assert (r.start, r.end, r.text) == (1.5, 2.0, "Hi, you there")
    assert one(spark, files.probe_duration(F.col("x")), [("Duration: 00:01:02.50, start",), ("none",)], "x string") == [62.5, None]
    assert files.markdown_head(["a"]).startswith("| a |")


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    calls = spark.createDataFrame([("s", 1, "k1", 2.0), ("s", 2, "k2", 2.5), ("s", 3, "k3", 2.0), ("s", 4, "k1", 3.0)], "source string, o long, key string, need double")
    calls.coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(calls.schema).parquet(str(src))
    out = keyed.stream_allocator(stream, "source", "key", "need", "o", 5.0)
    with keyed.map_state(spark):
        q = out.writeStream.format("memory").queryName("granted").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
        q.awaitTermination(60)
    assert sorted((r.key, r.offset, r.take, r.wrapped) for r in spark.table("granted").collect()) == [("k1", 0.0, 2.0, False), ("k1", 0.0, 3.0, False), ("k2", 2.0, 2.5, False), ("k3", 0.0, 2.0, True)]
    ev = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:20"), (1, "2024-01-01 01:00:00")], "u int, t string").withColumn("t", F.col("t").cast("timestamp"))
    ev.coalesce(1).write.parquet(str(tmp_path / "ev"))
    s = keyed.session_windows(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev")), "u", "t", "30 seconds", "0 seconds")
    q = s.writeStream.format("memory").queryName("sess").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(60)
    assert spark.table("sess").filter("n = 2").count() == 1
