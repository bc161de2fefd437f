"""Tracing of shots, placing in order and folds in blocks against plain passes in Python."""

import random

import numpy as np
import pandas as pd
import pytest

from tessera.operators import folds
from tessera.operators import sequences as W
from tessera.operators import tracing as R


def distance(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


def brute_trace(shot, frames, series, window):
    """One shot (start, end) of a video (frames at 10 a second) in one source (4 a second)."""
    start, end = shot
    seconds = max(0.0, end - start)
    taps = int(min(12, max(3, round(seconds * 4))))
    lo, hi = start + seconds * 0.12, end - seconds * 0.12 - 0.1
    if hi <= lo:
        lo, hi = start, max(start, end - 0.1)
    steps = [k * ((hi - lo) / (taps - 1)) for k in range(taps)]
    query = [frames[min(len(frames) - 1, max(0, int(np.ceil((lo + s) * 10 - 0.5))))] for s in steps]
    first, last, windowed = 0, len(series), False
    if window:
        a = min(len(series), int(np.ceil(max(0.0, window[0]) * 4)))
        b = min(len(series), int(np.ceil((window[1] + steps[-1] * 2) * 4))) + 1
        if b - a >= taps + 2:
            first, last, windowed = a, min(b, len(series)), True

    def best(speed):
        offsets = np.rint(np.asarray(steps) * speed * 4).astype(int)
        sums = [(sum(distance(q, series[p + o]) for q, o in zip(query, offsets, strict=True)), p) for p in range(first, last - int(offsets[-1]))]
        return (min(sums)[0] / taps, min(sums)[1]) if sums else None

    def row(found, speed):
        return (found[0] <= 12, round(max(0.0, found[1] / 4 - (lo - start) * speed), 2), round(found[0], 2), taps, speed, windowed)

    base = best(1.0)
    if base is None:
        return (False, 0.0, 64.0, taps, 1.0, False)
    chosen = first_row = row(base, 1.0)
    if not first_row[0] and seconds >= 1.5:
        for speed in R.SPEEDS[1:]:
            found = best(speed)
            if found and found[0] < chosen[2]:
                chosen = row(found, speed)
        if chosen[4] != 1.0 and first_row[2] - chosen[2] < 1.5:
            chosen = first_row
    return chosen


def noisy(rng, x, bits):
    for _ in range(bits):
        x ^= 1 << rng.randrange(64)
    return x - (1 << 64) if x >> 63 else x


def video(seed=3):
    rng = random.Random(seed)
    series = {f"s{k}": [rng.getrandbits(64) for _ in range(n)] for k, n in enumerate((90, 260, 5, 131))}
    series["still"] = [series["s0"][4]] * 120
    shots, ref, pairs = [], [], []
    for r in range(3):
        frames, begin = [], 0.0
        for k in range(5):
            seconds = rng.choice([0.3, 0.9, 1.6, 2.4, 4.1])
            source, speed = rng.choice(["s0", "s1", "s3"]), rng.choice([1.0, 1.0, 1.25, 0.8, 2.0, 0.95])
            n = round(seconds * 10)
            at = rng.uniform(0, len(series[source]) / 4 - seconds * speed - 0.5)
            frames += [noisy(rng, series[source][int((at + i / 10 * speed) * 4)], rng.randrange(14)) for i in range(n)]
            shots.append((r, k, begin, begin + seconds))
            for s in series:
                window = rng.choice([None, (at - 1.0, at + 1.0), (-5.0, 0.2), (500.0, 501.0)])
                pairs.append((r, k, s, *(window or (None, None))))
            begin += seconds
        ref += [(r, i, b) for i, b in enumerate(frames)]
    return series, shots, ref, pairs


@pytest.mark.parametrize("block,at_once", [(16_384, 4096), (16, 3)])
def test_traces_equal_a_plain_search(spark, block, at_once):
    series, shots, ref, pairs = video()
    index = [(s, i, b - (1 << 64) if b >> 63 else b) for s, bits in series.items() for i, b in enumerate(bits)]
    frames = spark.createDataFrame(ref, "ref_id int, pos long, bits long")
    got = R.trace_shots(spark.createDataFrame(shots, "ref_id int, shot int, start double, end double"), frames, spark.createDataFrame(index, "source string, pos long, bits long"), spark.createDataFrame(pairs, "ref_id int, shot int, source string, lo double, hi double"), block=block, queries_at_once=at_once)
    rows = {(r["ref_id"], r["shot"], r["source"]): tuple(r)[3:] for r in got.collect()}
    videos = {r: [b & (2**64 - 1) for q, _, b in ref if q == r] for r in range(3)}
    times = {(r, k): (a, b) for r, k, a, b in shots}
    want = {(r, k, s): brute_trace(times[r, k], videos[r], series[s], None if lo is None else (lo, hi)) for r, k, s, lo, hi in pairs}
    assert rows == want
    assert {x[4] for x in want.values()} > {1.0} and any(x[5] for x in want.values()) and any(x[2] == 64.0 for x in want.values())


def test_traces_of_nothing(spark):
    shots = spark.createDataFrame([], "ref_id int, shot int, start double, end double")
    got = R.best_traces(shots, spark.createDataFrame([], "ref_id int, pos long, bits long"), spark.createDataFrame([], "source string, pos long, bits long"), spark.createDataFrame([], "ref_id int, shot int, source string, lo double, hi double"))
    assert got.count() == 0


def test_a_bad_window_gives_way_to_the_whole_source(spark):
    rng = random.Random(1)
    bits = [rng.getrandbits(63) for _ in range(200)]
    index = [(s, i, b) for s in ("a", "b") for i, b in enumerate(bits if s == "b" else bits[::-1])]
    ref = [(1, i, bits[100 + int(i * 0.4)]) for i in range(30)]
    shots, pairs = [(1, 0, 0.0, 2.0)], [(1, 0, "a", None, None), (1, 0, "b", 0.0, 3.0)]
    got = R.best_traces(spark.createDataFrame(shots, "ref_id int, shot int, start double, end double"), spark.createDataFrame(ref, "ref_id int, pos long, bits long"), spark.createDataFrame(index, "source string, pos long, bits long"), spark.createDataFrame(pairs, "ref_id int, shot int, source string, lo double, hi double")).collect()
    assert len(got) == 1 and got[0]["source"] == "b" and got[0]["hit"] and not got[0]["windowed"] and abs(got[0]["src_start"] - 25.0) < 0.3


def brute_places(shots):
    placed, out = [], []
    for key, no, start, end, direct, windows, spots in shots:
        row = (key, no, None, None, None)
        if direct:
            row = (key, no, *direct[:2], "direct")
            placed.append((key, start, end, *direct))
        else:
            for source in sorted({s[0] for s in spots or ()}):
                window = next(((lo, hi) for s, lo, hi in windows or () if s == source), None)
                before = [p for p in placed if p[0] == key and p[3] == source and p[2] <= start + 0.05]
                if window is None and before:
                    on = before[-1][4] + (before[-1][2] - before[-1][1]) * before[-1][5]
                    window = (max(0.0, on - 8), on + 2 * (end - start) + 8 + 8)
                if window is None:
                    continue
                lo, hi = max(0.0, window[0]), max(window[0], window[1], 0.0)
                inside = sorted((-v, at) for s, at, v in spots if s == source and lo <= at <= hi) if hi - lo <= 90 else []
                if inside:
                    row = (key, no, source, round(max(0.0, inside[0][1]), 2), "window")
                    placed.append((key, start, end, source, row[3], 1.0))
                    break
        out.append(row)
    return out


def shots_to_place(seed=9):
    """One key has most of the rows, one a single row, one is null."""
    rng, out = random.Random(seed), []
    for key, n in (("hot", 400), ("b", 40), ("c", 1), (None, 30)):
        at = 0.0
        for no in range(n):
            seconds = rng.choice([1.0, 2.5, 4.0])
            direct = (f"s{rng.randrange(3)}", at + rng.randrange(-3, 4), rng.choice([1.0, 1.25])) if rng.random() < 0.15 else None
            windows = [(f"s{rng.randrange(3)}", at - 4, at + rng.choice([4, 200]))] if rng.random() < 0.1 else None
            spots = [(f"s{rng.randrange(3)}", at + rng.randrange(-40, 40) / 2, rng.randrange(4)) for _ in range(rng.randrange(6))] if rng.random() < 0.9 else None
            out.append((key, no, at, at + seconds, direct, windows, spots))
            at += seconds
    return out


SHOTS = "ref string, no int, start double, end double, direct struct<source:string,src_start:double,speed:double>, windows array<struct<source:string,lo:double,hi:double>>, spots array<struct<source:string,at:double,votes:int>>"


@pytest.mark.parametrize("block_rows", [200_000, 50])
def test_places_equal_one_pass_over_each_key(spark, block_rows):
    shots = shots_to_place()
    got = R.place_in_order(spark.createDataFrame(shots, SHOTS), ["ref"], "no", block_rows=block_rows)
    rows = sorted(((r["ref"], r["no"], r["source"], r["src_start"], r["locator"]) for r in got.collect()), key=str)
    assert rows == sorted(brute_places(shots), key=str)
    assert {r[4] for r in rows} == {"direct", "window", None}


@pytest.mark.parametrize("block_rows", [200_000, 40])
def test_lines_of_a_long_recording_are_folded_in_blocks(spark, block_rows):
    rng, rows, want = random.Random(2), [], {}
    for key, n, marked in ((1, 700, True), (2, 30, True), (3, 100, False), (None, 20, True)):
        at, chars = 0.0, []
        for i in range(n):
            at += 0.1 + (rng.random() < 0.05)
            punct = marked and rng.random() < 0.08
            chars.append((at, at + 0.1, punct, punct or marked and rng.random() < 0.2))
            rows.append((key, i, *chars[-1]))
        want |= {(key, i): line for i, line in enumerate(W.segment_chars(chars))}
    df = spark.createDataFrame(rows, "k int, i int, char_start double, char_end double, punct boolean, brk boolean")
    got = W.timed_lines(df, ["k"], "i", block_rows=block_rows)
    assert {(r["k"], r["i"]): r["line_no"] for r in got.collect()} == want


def test_a_state_that_never_forgets_still_settles(spark):
    df = spark.createDataFrame([("a", i, i % 7) for i in range(300)] + [("b", i, 1) for i in range(5)], "k string, i int, x int")

    def step(p: pd.DataFrame, state):
        total = (state or 0) + p["x"].cumsum()
        return p.assign(total=total), int(total.iloc[-1])

    got = folds.fold_in_blocks(df, ["k"], ["i"], step, "k string, i int, x int, total long", block_rows=60)
    assert all(r["total"] == (sum(j % 7 for j in range(r["i"] + 1)) if r["k"] == "a" else r["i"] + 1) for r in got.collect())
    assert folds.fold_in_blocks(df.limit(0), ["k"], ["i"], step, "k string, i int, x int, total long").count() == 0


def test_many_recordings_are_folded_at_once(spark, monkeypatch):
    """Recordings of all lengths in batches of few rows, marked and not, each as if it were alone; and no group of its own in the plan."""
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for k in [None, *range(40)]:
        n, at = int(rng.integers(1, 90)), 0.0
        chars = []
        for i in range(n):
            start = at + (0.6 if rng.random() < 0.1 else 0.0)
            at = start + 0.1
            punct = bool(rng.random() < 0.15) and (k or 0) % 3 > 0
            chars.append((start, at, punct, punct or (bool(rng.random() < 0.2) and (k or 0) % 3 > 0)))
            rows.append((k, i, *chars[-1]))
        want[k] = W.segment_chars(chars)
    df = spark.createDataFrame(rows, "k int, i int, char_start double, char_end double, punct boolean, brk boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        lines = W.timed_lines(df, ["k"], "i")
        assert "FlatMapGroupsInPandas" not in lines._jdf.queryExecution().optimizedPlan().toString()
        got = {}
        for r in sorted(lines.collect(), key=lambda r: r["i"]):
            got.setdefault(r["k"], []).append(r["line_no"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
