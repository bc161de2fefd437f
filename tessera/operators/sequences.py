"""Runs, sessions and segments of ordered rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.folds import fold_in_blocks


def _numbered(df: DataFrame, keys: list[str], order: list[str], new: Column, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_new", new.cast("int")).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def gap_sessions(df: DataFrame, keys: list[str], t: str, gap: Column | float, order: list[str] | None = None) -> DataFrame:
    """session: numbered from 1, a new one where the step is larger than gap (equal is not)."""
    o = [t, *(order or [])]
    prev = F.lag(t).over(Window.partitionBy(*keys).orderBy(*o))
    return _numbered(df, keys, o, F.coalesce(F.col(t) - prev > gap, F.lit(True)), "session")


def run_blocks(df: DataFrame, keys: list[str], order: list[str], by: list[str]) -> DataFrame:
    """block: numbered from 1, a new one where any of by changes; null equals null."""
    w = Window.partitionBy(*keys).orderBy(*order)
    same = F.lit(True)
    for c in by:
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    first = F.row_number().over(w) == 1
    return _numbered(df, keys, order, first | ~same, "block")


def change_points(df: DataFrame, keys: list[str], order: str, bits: str, cut: int = 20) -> DataFrame:
    """run: a new one where neighbouring 64-bit fingerprints differ in more than cut bits."""
    prev = F.lag(bits).over(Window.partitionBy(*keys).orderBy(order))
    return _numbered(df, keys, [order], F.coalesce(F.bit_count(F.col(bits).bitwiseXOR(prev)) > cut, F.lit(True)), "run")


def shots_from_runs(runs: DataFrame, keys: list[str], t: str = "t", step: float = 0.1, least: float = 0.4) -> DataFrame:
    """keys, shot, start, end: runs as intervals; one shorter than least joins the one before it (the first never does).

    A left fold that only asks whether a run is short: whole runs that are long enough
    begin a shot, so a second cumulative sum does it.
    """
    spans = runs.groupBy(*keys, "run").agg(F.min(t).alias("start"), F.max(t).alias("last"))
    w = Window.partitionBy(*keys).orderBy("run")
    end = F.coalesce(F.lead("start").over(w), F.col("last") + step)
    x = spans.withColumn("end", end)
    new = (F.row_number().over(w) == 1) | (F.round(F.col("end") - F.col("start"), 6) >= least)
    return _numbered(x, keys, ["run"], new, "shot").groupBy(*keys, "shot").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def soft_cut(df: DataFrame, keys: list[str], order: str, bits: str, t: str, lag: int = 4, edge: float = 0.12, peak: int = 20, above: int = 8, least_seconds: float = 2.5, least_part: float = 0.4) -> DataFrame:
    """keys, cut_at, distance: where a series dissolves into another picture.

    The distance of each fingerprint to the one lag steps on must peak (the earliest peak, away from the edges) clearly
    above its median and fall off on both sides within three lags: a long plateau is motion. Both parts must be long enough.
    """
    w, g = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    x = df.select(*keys, order, t, F.bit_count(F.col(bits).bitwiseXOR(F.lead(bits, lag).over(w))).alias("_d"), (F.row_number().over(w) - 1).alias("_i"), F.lead(t, lag // 2).over(w).alias("_at"), F.min(t).over(g).alias("_lo"), F.max(t).over(g).alias("_hi"), F.count("*").over(g).alias("_frames"))
    x = x.filter((F.col("_d").isNotNull()) & (F.col("_hi") - F.col("_lo") >= least_seconds) & (F.col("_frames") > lag + 2)).withColumn("_n", F.col("_frames") - lag)
    pad = F.greatest(F.lit(1), F.bround(F.col("_n") * edge).cast("int"))
    inner = (F.col("_i") >= pad) & (F.col("_i") < F.col("_n") - pad)
    best = x.filter(inner).groupBy(*keys).agg(F.max(F.struct(F.col("_d"), (-F.col("_i")).alias("_m"), "_at", "_lo", "_hi", "_n")).alias("_b"), F.expr("percentile(_d, 0.5)").alias("_med"))
    best = best.filter((F.col("_b._d") >= peak) & (F.col("_b._d") >= F.col("_med") + above)).select(*keys, F.col("_b._d").alias("distance"), (-F.col("_b._m")).alias("_peak"), F.col("_b._at").alias("cut_at"), F.col("_b._lo").alias("_first"), F.col("_b._hi").alias("_last"), F.col("_b._n").alias("_len"))
    low = x.join(best, keys).filter(F.col("_d") < 0.7 * F.col("distance")).groupBy(*keys).agg(F.max(F.when(F.col("_i") < F.col("_peak"), F.col("_i"))).alias("_before"), F.min(F.when(F.col("_i") > F.col("_peak"), F.col("_i"))).alias("_after"))
    y = best.join(low, keys, "left")
    plateau = F.coalesce("_after", "_len") - F.coalesce("_before", F.lit(-1)) - 1
    return y.filter((plateau <= 3 * lag) & (F.col("cut_at") - F.col("_first") >= least_part) & (F.col("_last") - F.col("cut_at") >= least_part)).select(*keys, "cut_at", "distance")


def expand_chars(df: DataFrame, text: str, start: str = "start", end: str = "end") -> DataFrame:
    """One row per character, with its share of the time."""
    n = F.length(text)
    step = (F.col(end) - F.col(start)) / n
    # the text is measured before its characters are rows
    x = df.filter(n > 0).withColumn("_step", step).select("*", F.posexplode(F.split(text, "")).alias("char_no", "ch")).filter(F.col("ch") != "")
    return x.withColumns({"char_start": F.col(start) + F.col("char_no") * F.col("_step"), "char_end": F.col(start) + (F.col("char_no") + 1) * F.col("_step")}).drop("_step")


def boundary_marks(df: DataFrame, keys: list[str], order: list[str], ch: str = "ch") -> DataFrame:
    """punct: after punctuation; brk: after that, after white space, or where letters of two scripts meet; a group's last character is both."""
    w = Window.partitionBy(*keys).orderBy(*order)
    following, last = F.lead(ch).over(w), F.lead(ch).over(w).isNull()
    punct = F.col(ch).rlike(r"[,，.。!！?？;；:：、…]")
    space = F.col(ch).rlike(r"\s") | F.coalesce(following.rlike(r"\s"), F.lit(False))
    kind = lambda c: F.when(c.rlike(r"[\x{2E80}-\x{10FFFF}]"), "wide").when(c.rlike(r"[\p{L}\p{N}]"), "letter")
    meet = F.coalesce(kind(F.col(ch)) != kind(following), F.lit(False))
    return df.withColumn("punct", punct | last).withColumn("brk", punct | space | meet | last)


#: A pause in seconds, and how many characters of a line are few, many and too many.
PAUSE, FEW, MANY, TOO_MANY = 0.45, 6, 18, 27


def line_starts(start: np.ndarray, end: np.ndarray, punct: np.ndarray, brk: np.ndarray, marked: bool | np.ndarray, held: int = 0, before: tuple[float, bool, bool] | None = None, first: np.ndarray | None = None) -> np.ndarray:
    """Places in a stretch of timed characters at which a new line begins, without the one that is open before it.

    From a line's first character on, the next line begins at the nearest of these places: after punctuation that a pause follows; after
    punctuation, FEW characters on or later; after a break, MANY or more on; TOO_MANY on; and at a place of ``first``, where another stream begins. In a stream that isn't marked every place
    counts as a break, and a pause is enough. ``held`` characters of the open line, the last of them as ``before`` (end, punct, brk), precede the stretch.
    """
    n = len(start)
    stop = np.concatenate([[before[0] if before else np.inf], end[:-1]])
    mark = np.concatenate([[before[1] if before else False], punct[:-1]]).astype(bool)
    place = np.concatenate([[before[2] if before else False], brk[:-1]]).astype(bool) | ~np.asarray(marked, bool)
    paused = start - stop > PAUSE
    nowhere = n + TOO_MANY

    def nearest(places: np.ndarray) -> np.ndarray:
        """For each place the nearest one of ``places`` from it on."""
        at = np.full(n + TOO_MANY + 1, nowhere)
        at[:n] = np.where(places, np.arange(n), nowhere)
        return np.minimum.accumulate(at[::-1])[::-1]

    near = [(nearest(paused & np.where(marked, mark, place)), 1), (nearest(mark), FEW), (nearest(place), MANY)] + ([] if first is None else [(nearest(first), 1)])
    following = np.minimum.reduce([np.arange(n) + TOO_MANY, *[to[least : n + least] for to, least in near]]).tolist()
    at, out = max(0, min(TOO_MANY - held, *[int(to[max(0, least - held)]) for to, least in near])), []
    while at < n:
        out.append(at)
        at = following[at]
    return np.asarray(out, np.int64)


def segment_chars(chars: list[tuple[float, float, bool, bool]]) -> list[int]:
    """Line numbers of timed characters (start, end, punct, brk), a whole stream."""
    if not chars:
        return []
    start, end, punct, brk = (np.asarray(x) for x in zip(*chars, strict=True))
    new = np.zeros(len(chars), np.int64)
    new[line_starts(start.astype(float), end.astype(float), punct, brk, bool(brk.any()))] = 1
    return np.cumsum(new).tolist()


def timed_lines(df: DataFrame, keys: list[str], order: str, block_rows: int = 200_000) -> DataFrame:
    """line_no of each timed character (char_start, char_end, punct, brk). A recording of any length is folded in blocks, which carry the open line; the others are folded many at once, as they lie in order in a task."""
    whole = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    marks = F.coalesce("brk", F.lit(False))

    def marked(rows: DataFrame) -> DataFrame:
        flags = rows.groupBy(*keys).agg(F.max(marks).alias("_marked")).withColumnsRenamed({k: f"_of_{k}" for k in keys})
        return rows.join(flags, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]).select(*df.columns, "_marked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, line, held, before = None, 0, 0, None
        for batch in filter(lambda b: b.num_rows, batches):
            of = [batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for k in keys]
            first = np.any([np.diff(x, prepend=x[0]) != 0 for x in of], axis=0)
            key = lambda at: tuple(batch.column(k)[at].as_py() for k in keys)  # noqa: B023, E731
            if last != key(0):
                first[0], line, held, before = True, 0, 0, None
            start, end = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("char_start", "char_end"))
            punct, brk, known = (pc.fill_null(batch.column(c), False).to_numpy(zero_copy_only=False) for c in ("punct", "brk", "_marked"))
            new = first.astype(np.int64)
            new[line_starts(start, end, punct, brk, known, held, before, first)] = 1
            upto, begun = np.cumsum(new), np.maximum.accumulate(np.where(first, np.arange(len(new)), -1))
            number = np.where(begun < 0, line + upto, upto - upto[np.maximum(begun, 0)])
            held = len(new) - int(np.flatnonzero(new)[-1]) if new.any() else held + len(new)
            last, line, before = key(-1), int(number[-1]), (float(end[-1]), bool(punct[-1]), bool(brk[-1]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(number, pa.int32())], [*names, "line_no"])

    def many(rows: DataFrame) -> DataFrame:
        # the window has brought a key's rows together
        known = rows.withColumn("_marked", F.max(marks).over(Window.partitionBy(*keys)))
        return known.sortWithinPartitions(*keys, order).mapInArrow(run, whole + ", line_no int")

    def fold(p: pd.DataFrame, state: list | None) -> tuple[pd.DataFrame, object]:
        line, held, before = state or (0, 0, None)
        flags = [p[c].fillna(False).to_numpy(bool) for c in ("punct", "brk")]
        begun = line_starts(p["char_start"].to_numpy(float), p["char_end"].to_numpy(float), *flags, bool(p["_marked"].iloc[0]), held, tuple(before) if before else None)
        new = np.zeros(len(p), np.int64)
        new[begun] = 1
        held = len(p) - int(begun[-1]) if len(begun) else held + len(p)
        last = [float(p["char_end"].iloc[-1]), bool(flags[0][-1]), bool(flags[1][-1])]
        return p.drop(columns="_marked").assign(line_no=line + np.cumsum(new)), [line + len(begun), held, last]

    names = df.columns
    return fold_in_blocks(df, keys, [order], fold, whole + ", line_no int", block_rows, many, marked)


def allocate(calls: Iterator[tuple[str, float]], total: float, cursor: float = 0.0, granted: dict | None = None, least: float = 0.4) -> Iterator[tuple[float, float, bool]]:
    """(offset, take, wrapped) for calls (key, need) on one source of total seconds, of which least are always taken.

    A new key gets what lies past the furthest end so far if that holds min(need, 1) seconds, else the source's
    beginning, which is flagged as wrapped if anything had been taken. A key that comes again keeps its offset. The
    caller's state is the furthest end, max(offset + take), and granted.
    """
    granted = {} if granted is None else granted
    total = max(least, total)
    for key, need in calls:
        wrapped = False
        if key not in granted:
            fits = total - cursor >= min(need, 1.0)
            wrapped = not fits and cursor > 0
            granted[key] = cursor if fits else 0.0
        offset = granted[key]
        take = max(least, min(need, total - offset))
        cursor = max(cursor, offset + take)
        yield offset, take, wrapped


def window_allocator(calls: DataFrame, source: str, order: list[str], key: str, need: str, total: str) -> DataFrame:
    """calls with offset, take and wrapped; each source's calls are folded in order."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in calls.schema) + ", offset double, take double, wrapped boolean"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(order, kind="stable")
        got = list(allocate(zip(p[key], p[need], strict=True), float(p[total].iloc[0])))
        return p.assign(offset=[g[0] for g in got], take=[g[1] for g in got], wrapped=[g[2] for g in got])

    return calls.groupBy(source).applyInPandas(fold, schema)


def keep_last(df: DataFrame, keys: list[str], order: list[str], n: int = 400) -> DataFrame:
    """The n newest rows of each group."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")
