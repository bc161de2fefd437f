"""Tracing shots of a cut video back to their sources by series of 64-bit frame fingerprints.

A shot is compared by some of its frames, its taps, which lie at the same distances in the source. A source of any length is cut into
blocks of positions that overlap by the longest pattern; a task slides all patterns of some shots over one block. All distances of a
pattern in a block are sums of arrays, so no row is ever made for a tap and a position.

An index on parts of the fingerprints would not help: a hit may differ by 12 of 64 bits, so with four parts of 16 bits one of them
still differs by up to three, which is 697 probes for each part and tap, and such probes meet a 23rd of all positions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.folds import fold_in_blocks
from tessera.operators.matching import tap_count
from tessera.plans.tables import written

#: Frames a second of references and of sources, the share of a shot at each end without taps, and the largest mean distance of a hit.
REF_FPS, INDEX_FPS, EDGE, MOST_DISTANCE = 10.0, 4.0, 0.12, 12.0
#: Speeds in the order in which they are tried, by how much another speed must win over 1.0, and from how long a shot on they are tried.
SPEEDS, SPEED_MARGIN, SPEED_SECONDS = (1.0, 0.95, 1.05, 0.9, 1.1, 0.85, 1.15, 0.8, 1.25, 0.75, 1.5, 2.0), 1.5, 1.5
#: How far a window around a neighbour reaches beyond it, and the longest window that is searched for words.
NEIGHBOUR_PAD, LONGEST_WINDOW, TOUCHING = 8.0, 90.0, 0.05
#: The distance of a shot that fits nowhere.
NOWHERE = 64.0


def tap_patterns(shots: DataFrame, ref: DataFrame) -> DataFrame:
    """shots (ref_id, shot, start, end) with taps, lead (seconds from the shot's start to the first tap), and arrays steps (seconds from the first tap) and bits.

    Taps are spread evenly, away from the ends unless the shot is too short for that; each takes the nearest frame of ref (ref_id, pos, bits), the
    earlier of two. Shots of a reference without frames are left out.
    """
    seconds = F.greatest(F.lit(0.0), F.col("end") - F.col("start"))
    lo, hi = F.col("start") + seconds * EDGE, F.col("end") - seconds * EDGE - 1 / REF_FPS
    short = hi <= lo
    x = shots.select("ref_id", "shot", "start", "end", seconds.alias("_s"), tap_count(seconds, INDEX_FPS).alias("taps"), F.when(short, F.col("start")).otherwise(lo).alias("_lo"), F.when(short, F.greatest(F.col("start"), F.col("end") - 1 / REF_FPS)).otherwise(hi).alias("_hi"))
    x = x.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("taps") - 1)))
    x = x.withColumn("_step", F.col("_k") * ((F.col("_hi") - F.col("_lo")) / (F.col("taps") - 1)))
    frames = ref.groupBy("ref_id").agg(F.max("pos").alias("_last"))
    near = F.ceil((F.col("_lo") + F.col("_step")) * REF_FPS - 0.5)
    x = x.join(frames, "ref_id").withColumn("pos", F.least(F.col("_last"), F.greatest(F.lit(0), near)))
    x = x.join(ref.select("ref_id", "pos", "bits"), ["ref_id", "pos"])
    rows = x.groupBy("ref_id", "shot").agg(F.first("start").alias("start"), F.first("end").alias("end"), F.first("taps").alias("taps"), F.first(F.col("_lo") - F.col("start")).alias("lead"), F.array_sort(F.collect_list(F.struct("_k", "_step", "bits"))).alias("_t"))
    return rows.filter(F.size("_t") == F.col("taps")).select("ref_id", "shot", "start", "end", "taps", "lead", F.transform("_t", lambda r: r["_step"]).alias("steps"), F.transform("_t", lambda r: r["bits"]).alias("bits"))


def slide(bits: np.ndarray, origin: int, first: int, last: int, taps: np.ndarray, offsets: np.ndarray) -> tuple[int, int] | None:
    """(distance, base) of the best base in first..last for taps at base + offsets, in a stretch of a series that begins at origin; the earliest of equally good ones."""
    if last < first:
        return None
    total = np.zeros(last - first + 1, np.int64)
    for tap, offset in zip(taps, offsets, strict=True):
        at = first + int(offset) - origin
        total += np.bitwise_count(bits[at : at + len(total)] ^ tap)
    k = int(total.argmin())
    return int(total[k]), first + k


def _best_by_speed(patterns: DataFrame, index: DataFrame, sizes: DataFrame, speeds: tuple[float, ...], block: int, queries_at_once: int) -> DataFrame:
    """ref_id, shot, source, speed_no, distance, base of patterns (with source, and since and upto, the stretch of the source they may lie in)."""
    longest = patterns.agg(F.max(F.element_at("steps", -1))).first()[0]
    if longest is None:
        longest = 0.0
    reach = int(np.rint(longest * max(SPEEDS) * INDEX_FPS)) + 1
    block = max(block, reach)
    chunks = F.ceil(F.count("*") / queries_at_once).cast("int").alias("_chunks")
    asked = patterns.groupBy("source").agg(chunks).join(sizes, "source")
    blocks = index.join(asked, "source").withColumn("_b", F.floor(F.col("pos") / block))
    also = F.when((F.col("pos") % block < reach) & (F.col("_b") > 0), F.array(F.col("_b") - 1, F.col("_b"))).otherwise(F.array("_b"))
    blocks = blocks.select("source", "pos", "bits", F.explode(also).alias("block"), "_chunks").select("source", "pos", "bits", "block", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("chunk"))
    wide = patterns.join(asked, "source")
    spots = F.sequence(F.floor(F.col("since") / block), F.floor(F.greatest(F.col("since"), F.col("upto") - 1) / block))
    wide = wide.select("ref_id", "shot", "source", "steps", "bits", "since", "upto", F.explode(spots).alias("block"), F.pmod(F.xxhash64("ref_id", "shot"), F.col("_chunks")).cast("int").alias("chunk"))
    kinds = {f.name: f.dataType.simpleString() for f in patterns.schema}

    def search(mine: pd.DataFrame, series: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(mine) and len(series):
            series = series.sort_values("pos")
            origin, bits = int(series["pos"].iloc[0]), series["bits"].to_numpy(np.int64).view(np.uint64)
            begin = int(mine["block"].iloc[0]) * block
            for r in mine.itertuples(index=False):
                taps, steps = np.asarray(r.bits, np.int64).view(np.uint64), np.asarray(r.steps)
                for no, speed in enumerate(speeds):
                    offsets = np.rint(steps * speed * INDEX_FPS).astype(np.int64)
                    got = slide(bits, origin, max(begin, r.since), min(begin + block, r.upto - int(offsets[-1])) - 1, taps, offsets)
                    if got:
                        out.append((r.ref_id, r.shot, r.source, no, *got))
        return pd.DataFrame(out, columns=["ref_id", "shot", "source", "speed_no", "distance", "base"])

    found = wide.groupBy("source", "block", "chunk").cogroup(blocks.groupBy("source", "block", "chunk"))
    found = found.applyInPandas(search, f"ref_id {kinds['ref_id']}, shot {kinds['shot']}, source {kinds['source']}, speed_no int, distance long, base long")
    return found.groupBy("ref_id", "shot", "source", "speed_no").agg(F.min(F.struct("distance", "base")).alias("b")).select("ref_id", "shot", "source", "speed_no", "b.distance", "b.base")


def trace_shots(shots: DataFrame, ref: DataFrame, index: DataFrame, pairs: DataFrame, block: int = 16_384, queries_at_once: int = 4_096) -> DataFrame:
    """ref_id, shot, source, hit, src_start, mean_dist, taps, speed, windowed for each of pairs (ref_id, shot, source, lo, hi).

    shots: ref_id, shot, start, end in seconds; ref: ref_id, pos, bits, REF_FPS frames a second; index: source, pos, bits, INDEX_FPS a second. Positions
    count from 0 without holes. lo and hi (or null) bound where in the source the shot begins; a window with no room for the taps is
    dropped. Shots are aligned at speed 1.0. Only one that misses there and is long enough is tried at other speeds, each of which must be strictly
    better than what was best before it; the best of them counts if it wins by SPEED_MARGIN. A source that is shorter than the pattern gives no hit at
    the distance NOWHERE.
    """
    sizes = index.groupBy("source").agg((F.max("pos") + 1).alias("_frames"))
    asked = pairs.select("ref_id", "shot", "source", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"))
    p = written(tap_patterns(shots, ref)).join(asked, ["ref_id", "shot"]).join(sizes, "source")
    span = F.element_at("steps", -1) * max(SPEEDS)
    first = F.least(F.col("_frames"), F.ceil(F.greatest(F.lit(0.0), F.col("lo")) * INDEX_FPS))
    last = F.least(F.col("_frames"), F.ceil((F.col("hi") + span) * INDEX_FPS)) + 1
    fits = F.col("lo").isNotNull() & F.col("hi").isNotNull() & F.coalesce(last - first >= F.col("taps") + 2, F.lit(False))
    p = written(p.withColumns({"windowed": fits, "since": F.when(fits, first).otherwise(F.lit(0)).cast("long"), "upto": F.when(fits, F.least(last, F.col("_frames"))).otherwise(F.col("_frames")).cast("long")}).drop("_frames"))
    key = ["ref_id", "shot", "source"]
    base = written(p.join(_best_by_speed(p, index, sizes, SPEEDS[:1], block, queries_at_once).drop("speed_no"), key, "left"))
    score = F.col("distance") / F.col("taps")
    missed = base.filter((score > MOST_DISTANCE) & (F.col("end") - F.col("start") >= SPEED_SECONDS)).drop("distance", "base")
    other = _best_by_speed(missed, index, sizes, SPEEDS[1:], block, queries_at_once)
    other = other.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("speed_no", "distance", "base"))).alias("_o"))
    none = F.lit(None).cast(other.schema["_o"].dataType)
    x = base.join(other, key, "left").withColumn("_o", F.coalesce("_o", none, F.array().cast(other.schema["_o"].dataType)))
    named = lambda d, no, at: F.struct(F.bround(d / F.col("taps"), 2).alias("dist"), (d / F.col("taps") <= MOST_DISTANCE).alias("hit"), no.cast("int").alias("no"), at.cast("long").alias("base"))
    best = F.aggregate("_o", named(F.col("distance"), F.lit(-1), F.col("base")), lambda a, o: F.when(o["distance"] / F.col("taps") < a["dist"], named(o["distance"], o["speed_no"], o["base"])).otherwise(a))
    x = x.withColumn("_first", named(F.col("distance"), F.lit(-1), F.col("base"))).withColumn("_best", best)
    chosen = F.when(F.col("_first.dist") - F.col("_best.dist") < SPEED_MARGIN, F.col("_first")).otherwise(F.col("_best"))
    x = x.withColumn("_c", chosen)
    speed = F.element_at(F.array(*[F.lit(s) for s in SPEEDS]), F.col("_c.no") + 2)
    begins = F.bround(F.greatest(F.lit(0.0), F.col("_c.base") / INDEX_FPS - F.col("lead") * speed), 2)
    no = F.col("distance").isNull()
    return x.select(
        *key, F.when(no, F.lit(False)).otherwise(F.col("_c.hit")).alias("hit"), F.when(no, F.lit(0.0)).otherwise(begins).alias("src_start"), F.when(no, F.lit(NOWHERE)).otherwise(F.col("_c.dist")).alias("mean_dist"),
        "taps", F.when(no, F.lit(1.0)).otherwise(speed).alias("speed"), (F.col("windowed") & ~no).alias("windowed"),
    )


def best_traces(shots: DataFrame, ref: DataFrame, index: DataFrame, pairs: DataFrame, trust: float = 6.0, margin: float = 4.0) -> DataFrame:
    """The best row of trace_shots for each shot, over its sources (the first of equally good ones).

    A shot whose window holds nothing closer than ``trust`` is looked for in the whole source, too, which must win by more than ``margin``.
    """
    near = written(trace_shots(shots, ref, index, pairs))
    again = near.filter(F.col("windowed") & (F.col("mean_dist") > trust)).select("ref_id", "shot", "source", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    far = trace_shots(shots, ref, index, again)
    row = [c for c in near.columns if c not in ("ref_id", "shot", "source")]
    both = near.join(far.select("ref_id", "shot", "source", F.struct(*row).alias("_f")), ["ref_id", "shot", "source"], "left")
    take = F.coalesce(F.col("_f.mean_dist") + margin < F.col("mean_dist"), F.lit(False))
    both = both.select("ref_id", "shot", "source", *[F.when(take, F.col(f"_f.{c}")).otherwise(F.col(c)).alias(c) for c in row])
    order = F.struct((~F.col("hit")).alias("miss"), F.col("mean_dist").alias("dist"), F.col("source").alias("first"))
    best = both.groupBy("ref_id", "shot").agg(F.min_by(F.struct(*both.columns), order).alias("b"))
    return best.select("b.*")


def place_in_order(shots: DataFrame, keys: list[str], order: str, start: str = "start", end: str = "end", block_rows: int = 200_000) -> DataFrame:
    """shots with source, src_start, speed, locator, lo and hi: where each shot comes from, each placement narrowing where the next ones are looked for.

    Columns besides: direct (struct<source, src_start, speed> or null: a match that needs no window), windows (array<struct<source, lo, hi>>: where anchors put
    the shot) and spots (array<struct<source, at, votes>>: where words of the shot are heard, less what precedes them in it). A shot without a direct match takes, of the
    first source in order of name that has one, the spot with most votes (the earliest of these) inside that source's window. Without anchors the window is where the
    source goes on after the last shot placed in it: up to twice the shot's length on, and NEIGHBOUR_PAD more at both ends. Windows of over LONGEST_WINDOW, and sources without
    any window, are not looked at. A key's shots come in order and don't overlap. They are folded in blocks that carry the last place in each source.
    """

    def fold(p: pd.DataFrame, state: dict | None) -> tuple[pd.DataFrame, object]:
        last: dict[str, tuple[float, float]] = {k: tuple(v) for k, v in (state or {}).items()}  # of each source: end of the shot, and of its place
        out = []
        for begins, ends, direct, windows, spots in zip(p[start], p[end], p["direct"], p["windows"], p["spots"], strict=True):
            row = (None, None, None, None, None, None)
            if direct is not None:
                row = (direct["source"], direct["src_start"], direct["speed"], "direct", None, None)
            else:
                known = {w["source"]: (w["lo"], w["hi"]) for w in (windows if windows is not None else ())}
                heard: dict[str, list[tuple[float, float]]] = {}
                for s in spots if spots is not None else ():
                    heard.setdefault(s["source"], []).append((-s["votes"], s["at"]))
                for source in sorted(heard):
                    window = known.get(source)
                    if window is None and source in last and last[source][0] <= begins + TOUCHING:
                        on = last[source][1]
                        window = on - NEIGHBOUR_PAD, on + 2 * (ends - begins) + 2 * NEIGHBOUR_PAD
                    if window is None:
                        continue
                    lo, hi = max(0.0, window[0]), max(0.0, *window)
                    inside = min((x for x in heard[source] if lo <= x[1] <= hi), default=None) if hi - lo <= LONGEST_WINDOW else None
                    if inside is not None:
                        row = (source, round(max(0.0, inside[1]), 2), 1.0, "window", lo, hi)
                        break
            if row[0] is not None:
                last[row[0]] = (ends, row[1] + (ends - begins) * row[2])
            out.append(row)
        got = pd.DataFrame(out, columns=["source", "src_start", "speed", "locator", "lo", "hi"], index=p.index)
        return pd.concat([p.drop(columns=["direct", "windows", "spots"]), got], axis=1), {k: list(v) for k, v in last.items()}

    kept = [c for c in shots.columns if c not in ("direct", "windows", "spots")]
    kinds = ", ".join(f"`{c}` {shots.schema[c].dataType.simpleString()}" for c in kept)
    return fold_in_blocks(shots.select(*kept, "direct", "windows", "spots"), keys, [order], fold, f"{kinds}, source string, src_start double, speed double, locator string, lo double, hi double", block_rows)
