"""Interval and timeline algebra with window functions: one sort per group key, no self-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys, island, start, end: touching and overlapping intervals merged; empty and reversed ones ignored."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col(start) > F.max(end).over(before), F.lit(True))
    marked = df.filter(F.col(end) > F.col(start)).withColumn("_new", new.cast("int"))
    runs = marked.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"))


def covered_length(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys, covered: length of the union of the intervals."""
    return islands(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


def active_profile(silences: DataFrame, keys: list[str], lo: str, hi: str, start: str = "start", end: str = "end") -> DataFrame:
    """keys, active, longest: total and longest stretch of [lo, hi] that no silence covers."""
    clipped = silences.withColumn("_s", F.greatest(start, lo)).withColumn("_e", F.least(end, hi))
    isl = islands(clipped, [*keys, lo, hi], "_s", "_e")
    w = Window.partitionBy(*keys, lo, hi).orderBy("start")
    gap_before = F.col("start") - F.coalesce(F.lag("end").over(w), F.col(lo))
    tail = F.when(F.lead("start").over(w).isNull(), F.col(hi) - F.col("end")).otherwise(F.col("end") - F.col("end"))
    gaps = isl.select(*keys, lo, hi, gap_before.alias("_g"), tail.alias("_t"))
    found = gaps.groupBy(*keys, lo, hi).agg(F.sum(F.col("_g") + F.col("_t")).alias("active"), F.greatest(F.max("_g"), F.max("_t")).alias("longest"))
    whole = silences.select(*keys, lo, hi).distinct()
    out = whole.join(found, [*keys, lo, hi], "left")
    return out.select(*keys, F.coalesce("active", F.col(hi) - F.col(lo)).alias("active"), F.coalesce("longest", F.col(hi) - F.col(lo)).alias("longest"))


def clip_to_next(df: DataFrame, keys: list[str], order: list[str], least: float = 0.25, start: str = "start", end: str = "end") -> DataFrame:
    """end moved back to the next start, but never below start + least; starts stay."""
    nxt = F.lead(start).over(Window.partitionBy(*keys).orderBy(start, *order))
    return df.withColumn(end, F.when(nxt.isNotNull() & (nxt < F.col(end)), F.greatest(nxt, F.col(start) + least)).otherwise(F.col(end)))


def display_end(df: DataFrame, keys: list[str], order: list[str], duration: Column | None = None, tail: float = 0.30, before_next: float = 0.02, least: float = 0.45) -> DataFrame:
    """shown_end: end + tail, before the next start, at least start + least, not past the duration."""
    nxt = F.lead("start").over(Window.partitionBy(*keys).orderBy("start", *order))
    shown = F.greatest(F.least(F.col("end") + tail, F.coalesce(nxt - before_next, F.col("end") + tail)), F.col("start") + least)
    return df.withColumn("shown_end", shown if duration is None else F.least(shown, duration))


def overlap_audit(df: DataFrame, keys: list[str], order: list[str], slack: float = 0.5, start: str = "start", end: str = "end") -> DataFrame:
    """Rows that begin more than slack before an earlier row of their group has ended, with the overlap."""
    w = Window.partitionBy(*keys).orderBy(start, *order)
    until = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("overlap", until - F.col(start)).filter(F.col("overlap") > slack)


def asof_bracket(points: DataFrame, anchors: DataFrame, keys: list[str], t: str, at: str, value: str) -> DataFrame:
    """points with the last anchor at or before t and the first at or after it, by one sort over the union of both."""
    p = points.select("*", F.col(t).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(anchors.schema[value].dataType).alias("_v"), F.lit(None).cast(anchors.schema[at].dataType).alias("_at"))
    a = anchors.select(*[F.col(k) for k in keys], F.col(at).alias("_t"), F.lit(0).alias("_kind"), F.col(value).alias("_v"), F.col(at).alias("_at"))
    both = p.unionByName(a, allowMissingColumns=True)
    anchor = F.when(F.col("_kind") == 0, F.struct("_at", "_v"))
    up = Window.partitionBy(*keys).orderBy("_t", "_kind", "_v").rowsBetween(Window.unboundedPreceding, 0)
    # a point at an anchor's own time finds it from both sides
    down = Window.partitionBy(*keys).orderBy("_t", F.desc("_kind"), "_v").rowsBetween(0, Window.unboundedFollowing)
    told = both.withColumn("_lo", F.last(anchor, ignorenulls=True).over(up)).withColumn("_hi", F.first(anchor, ignorenulls=True).over(down))
    return told.filter("_kind = 1").select(*points.columns, F.col("_lo._at").alias("lo_at"), F.col("_lo._v").alias("lo_value"), F.col("_hi._at").alias("hi_at"), F.col("_hi._v").alias("hi_value"))


def padded_window(shot_start: Column, shot_end: Column, lo_at: Column, lo_value: Column, hi_at: Column, hi_value: Column, pad: float = 6.0, per_gap: float = 0.25) -> tuple[Column, Column]:
    """A search window from bracketing anchors, wider the farther they are; null without both."""
    lo = lo_value - pad - per_gap * (shot_start - lo_at)
    hi = hi_value + pad + per_gap * (hi_at - shot_end)
    return F.greatest(lo, F.lit(0.0)), hi


def nearest_rows(intervals: DataFrame, frames: DataFrame, keys: list[str], row_id: str, frame_id: str, t: str = "t", k: int = 3, slack: float = 0.01, bucket: float = 60.0) -> DataFrame:
    """Per interval the first k frames inside it by time; where none is, the k nearest to its middle.

    Inside hits are an equi-join on time buckets; only intervals without one look at
    their neighbours, by rank around the middle.
    """
    cut = lambda x: F.floor(x / bucket).cast("long")
    iv = intervals.select(*keys, row_id, F.col("t0"), F.col("t1"))
    spread = iv.withColumn("_b", F.explode(F.sequence(cut(F.col("t0") - slack), cut(F.col("t1") + slack))))
    fr = frames.select(*keys, frame_id, F.col(t).alias("t")).withColumn("_b", cut(F.col("t")))
    inside = spread.join(fr, [*keys, "_b"]).filter((F.col("t") >= F.col("t0") - slack) & (F.col("t") <= F.col("t1") + slack))
    w = Window.partitionBy(*keys, row_id).orderBy("t", frame_id)
    hit = inside.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(*keys, row_id, frame_id, "t", "rank")
    miss = iv.join(hit.select(*keys, row_id).distinct(), [*keys, row_id], "left_anti").withColumn("_m", (F.col("t0") + F.col("t1")) / 2)
    # frames are numbered by time from both ends, of one time the smallest id first; the k before and the k after the middle hold the k nearest
    number = lambda *order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order, frame_id))
    numbered = fr.select(*keys, frame_id, "t", number("t").alias("_up"), (-number(F.desc("t"))).alias("_down"))
    numbered = numbered.select(*keys, frame_id, "t", F.explode(F.array("_up", "_down")).alias("_no"))
    side = miss.select(*keys, row_id, "_m", F.col("_m").alias("t"), F.lit(0).alias("_f"))
    line = side.unionByName(fr.select(*keys, "t", F.lit(1).alias("_f"), F.lit(None).cast("double").alias("_m"), F.lit(None).cast(iv.schema[row_id].dataType).alias(row_id)))
    passed = F.sum("_f").over(Window.partitionBy(*keys).orderBy("t", "_f").rowsBetween(Window.unboundedPreceding, 0))
    behind = F.sum("_f").over(Window.partitionBy(*keys)) - F.col("_p")
    after, before = (F.sequence((c + 1).cast("int"), (c + k).cast("int")) for c in (F.col("_p"), F.col("_q")))
    asked = line.withColumn("_p", passed).withColumn("_q", behind).filter("_f = 0").select(*keys, row_id, "_m", F.explode(F.concat(after, F.transform(before, lambda n: -n))).alias("_no"))
    near = asked.join(numbered, [*keys, "_no"]).select(*keys, row_id, "_m", F.struct("t", F.col(frame_id).alias("f")).alias("n"))
    w2 = Window.partitionBy(*keys, row_id).orderBy(F.abs(F.col("n.t") - F.col("_m")), "n.t", "n.f")
    far = near.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k).select(*keys, row_id, F.col("n.f").alias(frame_id), F.col("n.t").alias("t"), "rank")
    return hit.unionByName(far)


def uncovered(df: DataFrame, intervals: DataFrame, keys: list[str], row_id: str, start: str = "start", end: str = "end", bucket: float = 60.0) -> DataFrame:
    """Rows whose middle lies in no interval of their group: a left anti join on time buckets."""
    mid = (F.col(start) + F.col(end)) / 2
    iv = intervals.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e")).filter("_e >= _s")
    iv = iv.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / bucket).cast("long"), F.floor(F.col("_e") / bucket).cast("long"))))
    left = df.withColumn("_m", mid).withColumn("_b", F.floor(mid / bucket).cast("long"))
    cond = (F.col("_m") >= F.col("_s")) & (F.col("_m") <= F.col("_e"))
    for k in keys:
        cond = cond & (left[k] == iv[k])
    return left.join(iv, (left["_b"] == iv["_b"]) & cond, "left_anti").drop("_m", "_b")


def prefix_timeline(df: DataFrame, keys: list[str], order: list[str], seconds: str) -> DataFrame:
    """start and end of consecutive parts from their lengths."""
    w = Window.partitionBy(*keys).orderBy(*order)
    end = F.sum(seconds).over(w.rowsBetween(Window.unboundedPreceding, 0))
    start = F.coalesce(F.sum(seconds).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(df.schema[seconds].dataType))
    return df.withColumn("start", start).withColumn("end", end)


def trusted_timeline(df: DataFrame, keys: list[str], order: list[str], total: str, slack: float = 0.05, over: float = 1.05, off: float = 0.05) -> DataFrame:
    """Given spans stay if all of a group are valid, in order and within the total; else lengths are summed, and rescaled when off."""
    w = Window.partitionBy(*keys).orderBy(*order)
    g = Window.partitionBy(*keys)
    ok = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= over * F.col(total)) & F.coalesce(F.col("start") >= F.lag("end").over(w) - slack, F.lit(True))
    d = F.greatest(F.coalesce(F.col("end") - F.col("start"), F.lit(0.0)), F.lit(0.0))
    x = df.withColumn("_ok", F.coalesce(ok, F.lit(False))).withColumn("_d", d)
    x = x.withColumn("_all", F.min(F.col("_ok").cast("int")).over(g) == 1).withColumn("_sum", F.sum("_d").over(g))
    scale = F.when((F.col("_sum") > 0) & (F.abs(F.col("_sum") - F.col(total)) > off * F.col(total)), F.col(total) / F.col("_sum")).otherwise(F.lit(1.0))
    run = F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)) * scale
    start = F.when(F.col("_all"), F.col("start")).otherwise(F.round(run - F.col("_d") * scale, 1))
    end = F.when(F.col("_all"), F.col("end")).otherwise(F.round(run, 1))
    return x.withColumns({"_start": start, "_end": end}).select(*[c for c in df.columns if c not in ("start", "end")], F.col("_start").alias("start"), F.col("_end").alias("end"), F.col("_all").alias("trusted"))


def proportional_timeline(df: DataFrame, keys: list[str], order: list[str], share: str, total: str) -> DataFrame:
    """The total spread over the parts by their shares."""
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = F.sum(share).over(Window.partitionBy(*keys))
    scale = F.col(total) / whole
    run = F.sum(share).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("start", (run - F.col(share)) * scale).withColumn("end", run * scale)


def mostly_inside(start: Column, end: Column, lo: Column, hi: Column, share: float = 0.5) -> Column:
    """Whether at least so much of [start, end] lies in [lo, hi]; an empty interval on either side counts as inside."""
    inter = F.greatest(F.lit(0), F.least(end, hi) - F.greatest(start, lo))
    return F.when((end <= start) | (hi <= lo), True).otherwise(inter >= share * (end - start))


def roll_overs(df: DataFrame, keys: list[str], order: list[str], start: str) -> DataFrame:
    """Rows that begin before an earlier row of their group, in the order in which windows were given out."""
    before = F.max(start).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_b", before).filter(F.col(start) < F.col("_b")).drop("_b")
