"""Constrained packing and redistribution of timed items."""

from __future__ import annotations

import math
from bisect import bisect_left
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tessera.functions.scalars import split_sentences

# Segment limits and costs.
MAX_SEG, MIN_SEG, SPEECH_RATE, SHOT_MAX = 15.0, 4.0, 6.5, 6.0
SOFT_COST, SHORT_COST, FREE_COST = 8.0, 3.0, 0.3


def dp_segments(lengths: list[float], soft: list[bool], most: float = MAX_SEG, least: float = MIN_SEG) -> list[tuple[int, int]]:
    """Contiguous segments [i, j) of at most ``most`` seconds with the least cost.

    A segment costs 1, three per second under ``least``, 0.3 per second left free, and 8 for
    each of its ends that is a soft boundary inside the list. Of equal costs the earliest start wins.
    An item that is too long is a segment of its own. From each start only ends within ``most`` are
    tried, so the work is the list's length times the items that fit into a segment.
    """
    n, at = len(lengths), [0.0, *accumulate(lengths)]
    charge = [SOFT_COST if 0 < k < n and soft[k] else 0.0 for k in range(n + 1)]
    cheapest: list[tuple[float, int]] = [(0.0, 0), *[(math.inf, 0)] * n]  # cost up to an item, and its last segment's start
    for i in range(n):
        paid = cheapest[i][0] + 1 + charge[i]
        for j in range(i + 1, n + 1):
            size = at[j] - at[i]
            if j > i + 1 and size > most + 1e-9:
                break
            cost = paid + charge[j] + SHORT_COST * max(0.0, least - size) + FREE_COST * (most - size)
            if cost < cheapest[j][0] - 1e-12:
                cheapest[j] = cost, i
    bounds = [n]
    while bounds[-1]:
        bounds.append(cheapest[bounds[-1]][1])
    return list(pairwise(reversed(bounds)))


def _in_order(items: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys and _rows, the group's rows as an array of structs in order."""
    rest = [c for c in items.columns if c not in keys and c not in order]
    return items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[c for c in order if c not in keys], *rest))).alias("_rows"))


def pack_segments(items: DataFrame, keys: list[str], order: list[str], length: str, soft: str) -> DataFrame:
    """items with segment_no, raw_s and gen_s; one group is one script, whose lengths and boundaries come together as arrays."""

    @F.pandas_udf("array<struct<segment_no:int,raw_s:double,gen_s:int>>")
    def pack(lengths: pd.Series, softs: pd.Series) -> pd.Series:
        out = []
        for d, s in zip(lengths, softs, strict=True):
            rows = []
            for k, (i, j) in enumerate(dp_segments([float(x) for x in d], [bool(x) for x in s])):
                raw = float(sum(d[i:j]))
                rows += [{"segment_no": k, "raw_s": raw, "gen_s": int(min(MAX_SEG, max(MIN_SEG, round(round(raw, 6)))))}] * (j - i)
            out.append(rows)
        return pd.Series(out)

    x = _in_order(items, keys, order)
    x = x.withColumn("_seg", pack(F.transform("_rows", lambda r: r[length].cast("double")), F.transform("_rows", lambda r: F.coalesce(r[soft], F.lit(False)))))
    y = x.select(*keys, F.explode(F.arrays_zip("_rows", "_seg")).alias("_z")).select(*keys, "_z._rows.*", "_z._seg.*")
    return y.select(*items.columns, "segment_no", "raw_s", "gen_s")


def split_long(items: DataFrame, length: str, most: float = MAX_SEG) -> DataFrame:
    """Items over the limit as ceil(length / most) equal parts: part_no, parts, and the length of a part."""
    parts = F.greatest(F.lit(1), F.ceil(F.col(length) / most)).cast("int")
    return items.withColumn("parts", parts).withColumn("part_no", F.explode(F.sequence(F.lit(1), F.col("parts")))).withColumn(length, F.col(length) / F.col("parts"))


def rescale_total(items: DataFrame, keys: list[str], length: str, total: str, order: list[str], off: float = 0.10, least: float = 0.3) -> DataFrame:
    """Lengths scaled to the group's total when off by more than a tenth; one decimal (half away from zero, as tenths), never under least.

    Lengths are added up in order, so the last bit of the sum, and with it a share half way between two tenths, doesn't depend on how the rows arrive.
    """
    s = F.sum(length).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tenths = F.col(length) * F.col(total) / s * 10
    scaled = F.greatest(F.lit(least), (F.floor(tenths) + F.when(tenths - F.floor(tenths) >= 0.5, 1).otherwise(0)) / 10)
    return items.withColumn(length, F.when((s > 0) & (F.abs(s - F.col(total)) > off * F.col(total)), scaled).otherwise(F.col(length)))


def redistribute(items: DataFrame, keys: list[str], length: str, chars: str, rate: float = SPEECH_RATE, least: float = 0.4) -> DataFrame:
    """new_length, short: items whose speech needs more time take it from items with slack, both in proportion.

    A donor gives at most its slack, half its length, and keeps ``least``; totals per group stay.
    """
    need = F.coalesce(F.col(chars), F.lit(0)) / rate
    lack = F.greatest(F.lit(0.0), need - F.col(length))
    slack = F.when(lack > 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.col(length) - need, F.col(length) / 2, F.col(length) - least)))
    w = Window.partitionBy(*keys)
    x = items.withColumns({"_lack": lack, "_slack": slack}).withColumns({"_l": F.sum("_lack").over(w), "_s": F.sum("_slack").over(w)})
    move = F.least("_l", "_s")
    new = F.col(length) + F.when(F.col("_l") > 0, F.col("_lack") * move / F.col("_l")).otherwise(0.0) - F.when(F.col("_s") > 0, F.col("_slack") * move / F.col("_s")).otherwise(0.0)
    return x.withColumn("new_length", new).withColumn("short", need - F.col("new_length") > 0.3).drop("_lack", "_slack", "_l", "_s")


def _tenth(x: float) -> float:
    """x in whole tenths, half away from zero."""
    y = abs(x * 10)
    whole = math.floor(y)
    return math.copysign(whole + (y - whole >= 0.5), x) / 10


def water_fill(total: float, sizes: list[float], cap: float = SHOT_MAX, least: float = 0.4, half_away: bool = False) -> list[float]:
    """Shares of total in proportion to sizes, one decimal, each within [least, cap].

    Where the total is too small or too large for that, an even share is the limit instead. Shares cut to the limits are all
    moved by the same fraction of their way to one limit, the upper if something is left over, which makes up the total at once;
    under 0.01 stays as it is. What single decimals leave over goes to the roomiest. Sums are taken from left to right, so equal
    input gives equal last bits anywhere. Half a tenth goes to the even one as Python rounds it, or with half_away from zero as SQL does.
    """
    n = len(sizes)
    if not n:
        return []
    weight = np.asarray(sizes, np.float64)
    low, high = min(least, total / n), max(cap, total / n)
    tenth = _tenth if half_away else lambda x: round(x, 1)
    add = lambda v: float(np.cumsum(v)[-1])  # noqa: E731  (np.sum adds in pairs)
    whole = add(weight)
    cut = np.clip(total * weight / whole if whole > 0 else np.full(n, total / n), low, high)
    over = total - add(cut)
    room = high - cut if over > 0 else cut - low
    if abs(over) >= 0.01 and add(room) >= 0.01:
        cut = np.clip(cut + over * room / add(room), low, high)
    tenths = np.asarray([tenth(x) for x in cut.tolist()])
    rest = tenth(total - add(tenths))
    if abs(rest) >= 0.05:
        tenths[np.argmax(np.round(high - tenths, 9) if rest > 0 else tenths)] += rest
    return [tenth(x) for x in tenths.tolist()]


def fill_groups(items: DataFrame, keys: list[str], order: list[str], total: str, size: str, half_away: bool = False) -> DataFrame:
    """items with filled: water_fill per group, with the first row's total."""

    @F.pandas_udf("array<double>")
    def fill(totals: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([water_fill(float(t), [float(x) for x in z], half_away=half_away) for t, z in zip(totals, sizes, strict=True)])

    x = _in_order(items, keys, order)
    x = x.withColumn("_f", fill(F.element_at("_rows", 1)[total].cast("double"), F.transform("_rows", lambda r: r[size].cast("double"))))
    y = x.select(*keys, F.explode(F.arrays_zip("_rows", "_f")).alias("_z")).select(*keys, "_z._rows.*", F.col("_z._f").alias("filled"))
    return y.select(*items.columns, "filled")


def cut_items(items: DataFrame, keys: list[str], order: list[str], length: str, most: float = SHOT_MAX) -> DataFrame:
    """Items over most as equal children; item_no numbers all anew."""
    x = split_long(items, length, most)
    w = Window.partitionBy(*keys).orderBy(*order, "part_no")
    return x.withColumn("item_no", F.row_number().over(w))


def deal_sentences(sentences: list[str], groups: int) -> list[list[str]]:
    """Consecutive sentences in at most so many groups: each ends where the running total first reaches its share of what is left, and leaves a sentence for each later group."""
    filled = [x for x in sentences if x]
    upto = list(accumulate(map(len, filled), initial=0))
    begins = [0]
    for g in range(min(groups, len(filled)), 1, -1):
        share = upto[begins[-1]] * (g - 1) + upto[-1]  # over g
        end = bisect_left(upto, share, lo=begins[-1] + 1, key=lambda x, g=g: x * g)
        begins.append(min(end, len(filled) - g + 1))
    return [filled[a:b] for a, b in pairwise([*begins, len(filled)]) if a < b]


def deal_text(text: Column, groups: Column) -> Column:
    """array<string> of exactly so many texts: the sentences dealt into groups, at commas too where sentences are too few, filled up with empty texts."""

    @F.pandas_udf(ArrayType(StringType()))
    def deal(sentences: pd.Series, clauses: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for a, b, k in zip(sentences, clauses, n, strict=True):
            got = deal_sentences(list(a), k)
            if len(got) < k:
                got = deal_sentences(list(b), k)
            out.append(["".join(g) for g in got] + [""] * (k - len(got)))
        return pd.Series(out)

    clean = F.coalesce(text, F.lit(""))
    return deal(split_sentences(clean), split_sentences(clean, commas=True), groups)


def cut_spoken(items: DataFrame, length: str, text: str, most: float = SHOT_MAX) -> DataFrame:
    """Items over most (by more than 0.05 at the last part) as children that share the text by sentences and the length by the text's sizes: part_no, parts, warned.

    A row is a whole item, so nothing is grouped. Items that aren't cut keep their text and length.
    """
    whole = F.floor(F.col(length) / most)
    parts = F.greatest(F.lit(1), (whole + F.when(F.col(length) - whole * most > 0.05, 1).otherwise(0))).cast("int")

    @F.pandas_udf("array<double>")
    def lengths(total: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([water_fill(float(t), [float(x) for x in z], most) for t, z in zip(total, sizes, strict=True)])

    x = items.withColumn("parts", F.when(F.col(length) > most, parts).otherwise(1))
    long_ = x.filter("parts > 1").withColumn("_t", deal_text(F.col(text), F.col("parts")))
    long_ = long_.withColumn("_l", lengths(F.col(length), F.transform("_t", lambda v: F.length(v))))
    cut = long_.select("*", F.posexplode(F.arrays_zip("_t", "_l")).alias("_p", "_c"))
    cut = cut.withColumns({text: F.col("_c._t"), length: F.col("_c._l"), "part_no": F.col("_p") + 1, "warned": F.lit(True)})
    kept = x.filter("parts = 1").withColumns({"part_no": F.lit(1), "warned": F.lit(False)})
    names = [*items.columns, "parts", "part_no", "warned"]
    return kept.select(*names).unionByName(cut.select(*names))


def split_spoken(items: DataFrame, length: str, text: str, most: float = MAX_SEG) -> DataFrame:
    """Items over most as ceil(length / most) equal parts (one decimal) that share the text by sentences: part_no, parts."""
    x = items.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col(length) / most)).cast("int"))
    texts = F.when(F.col("parts") > 1, deal_text(F.col(text), F.col("parts"))).otherwise(F.array(F.coalesce(text, F.lit(""))))
    cut = x.select("*", F.posexplode(texts).alias("_p", "_t"))
    part = F.when(F.col("parts") > 1, F.round(F.col(length) / F.col("parts"), 1)).otherwise(F.col(length))
    return cut.withColumns({length: part, text: F.col("_t"), "part_no": F.col("_p") + 1}).select(*items.columns, "parts", "part_no")


def block_needs(items: DataFrame, keys: list[str], need: str, avail: str, stretch: float = 1.6) -> DataFrame:
    """given: need capped at avail * stretch; what a cap cuts off goes to items with room, in proportion to it."""
    cap = F.col(avail) * stretch
    over = F.greatest(F.lit(0.0), F.col(need) - cap)
    room = F.greatest(F.lit(0.0), cap - F.col(need))
    w = Window.partitionBy(*keys)
    x = items.withColumns({"_o": F.sum(over).over(w), "_r": F.sum(room).over(w)})
    more = F.when(F.col("_r") > 0, room * F.least("_o", "_r") / F.col("_r")).otherwise(0.0)
    return x.withColumn("given", F.least(F.col(need), cap) + more).drop("_o", "_r")


def tempo_plan(video: Column, voice: Column, fastest: float = 1.4, slowest: float = 0.85, gap: float = 0.25) -> Column:
    """struct<tempo, residual, truncated>: play the voice faster or slower to fit the picture, within limits."""
    ratio = voice / video
    fast = F.least(ratio, F.lit(fastest))
    slow = F.greatest(ratio, F.lit(slowest))
    tempo = F.when(ratio > 1, fast).otherwise(slow)
    rest = video - voice / tempo
    return F.struct(tempo.alias("tempo"), F.when(rest > gap, rest).otherwise(0.0).alias("residual"), (rest < -1e-9).alias("truncated"))


# Where a line may end early, and from how much of its width.
LINE_STOPS, EARLY = "，。！？；：、,.!?;:", 0.7


def char_width(ch: str) -> int:
    return 2 if ord(ch) > 0x2E7F else 1


def text_width(text: str) -> int:
    return sum(map(char_width, text))


def wrap(text: str, width: int) -> list[str]:
    """Lines of at most width columns, by positions in the text.

    A line ends at a stop once it is 70 % full. One that overflows ends before the character that is too much, or, if
    that belongs to an ASCII word, at the line's last space. Spaces that would begin a line go.
    """
    text = text.strip()
    cuts: list[tuple[int, int]] = []
    begin, used, space = 0, 0, -1
    for i, ch in enumerate(text):
        if begin == i and ch in " \u3000":
            begin = i + 1
            continue
        w = char_width(ch)
        full = used + w > width
        if full:
            in_word = ch.isascii() and not ch.isspace() and text[begin : max(begin, space)].strip() != ""
            stop, resume = (space, space + 1) if in_word else (i, i)
            cuts.append((begin, stop))
            begin, used, space = resume, text_width(text[resume:i]), -1
        used += w
        if ch == " ":
            space = i
        elif not full and ch in LINE_STOPS and used >= EARLY * width:
            cuts.append((begin, i + 1))
            begin, used, space = i + 1, 0, -1
    lines = (text[a:b].strip() for a, b in [*cuts, (begin, len(text))])
    return [x for x in lines if x]


def wrap_screens(df: DataFrame, text: str, start: str, end: str, width: int = 32, lines: int = 2) -> DataFrame:
    """One row per screen of at most so many lines, each with its share of the time by width."""

    @F.pandas_udf("array<struct<screen_text:string,w:int>>")
    def screens(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            w = wrap(t or "", width)
            joined = ["\n".join(w[i : i + lines]) for i in range(0, len(w), lines)]
            out.append([{"screen_text": x, "w": text_width(x)} for x in joined])
        return pd.Series(out)

    wide = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x["w"])
    x = df.withColumn("_s", screens(F.col(text))).withColumn("_whole", F.greatest(wide(F.col("_s")), F.lit(1)))
    x = x.select("*", F.posexplode("_s").alias("screen", "_one"))
    before, span = wide(F.slice("_s", F.lit(1), F.col("screen"))), F.col(end) - F.col(start)
    upto = lambda n: F.col(start) + span * n / F.col("_whole")
    return x.select(*df.columns, "screen", "_one.screen_text", upto(before).alias("screen_start"), upto(before + F.col("_one.w")).alias("screen_end"))


def balanced_break(text: Column, emphasis: Column) -> Column:
    """The position after which a line of two or more characters breaks most evenly: not inside the emphasised part, and of equally even places the first."""
    n = F.length(text)
    at = F.instr(text, emphasis)
    inside = lambda k: (F.length(emphasis) > 1) & (at > 0) & (k >= at) & (k < at + F.length(emphasis) - 1)
    places = F.filter(F.sequence(F.lit(1), n - 1), lambda k: ~F.coalesce(inside(k), F.lit(False)))
    best = F.array_min(F.transform(places, lambda k: F.struct(F.abs(2 * k - n).alias("d"), k.alias("k"))))
    return F.when(n >= 2, best["k"])


def uniform_size(df: DataFrame, keys: list[str], units: Column, width: float, least: int = 52) -> DataFrame:
    """keys, size: one size at which every block of the group fits, never under least."""
    return df.groupBy(*keys).agg(F.greatest(F.lit(least), F.min(F.floor(F.lit(width) / F.greatest(units, F.lit(1.0))))).cast("int").alias("size"))


def sequence_check(steps: DataFrame, key: str, order: str, have: str, lack: str, base_known: Column) -> DataFrame:
    """key, accepted, reason: at least two steps, nothing empty, and "have" sets that only grow or only shrink."""
    w = Window.partitionBy(key).orderBy(order)
    prev = F.lag(have).over(w)
    x = steps.withColumns({
        "_up": F.coalesce(F.size(F.array_except(prev, F.col(have))) == 0, F.lit(True)), "_down": F.coalesce(F.size(F.array_except(F.col(have), prev)) == 0, F.lit(True)),
        "_filled": F.coalesce(F.size(have) > 0, F.lit(False)), "_lacks": F.coalesce(F.size(lack) > 0, F.lit(False)), "_base": F.coalesce(base_known, F.lit(False)),
    })
    per = x.groupBy(key).agg(F.count("*").alias("n"), *[F.bool_and(c).alias(c) for c in ("_up", "_down", "_filled", "_base")], F.bool_or("_lacks").alias("_lacks"))
    reason = (
        F.when(~F.col("_base"), "unknown base").when(F.col("n") < 2, "fewer than two steps").when(~F.col("_filled"), "an empty step")
        .when(~F.col("_lacks"), "nothing is missing").when(~F.col("_up") & ~F.col("_down"), "not monotone")
    )
    return per.select(key, reason.isNull().alias("accepted"), reason.alias("reason"))


def voice_sample_check(flag: Column, start: Column, end: Column, total: Column, least: float = 2.0) -> Column:
    """The first reason a voice sample is unusable, or null."""
    return (
        F.when(~F.coalesce(flag, F.lit(False)), "no voice").when(start.isNull() | end.isNull() | (start < 0) | (end <= start), "bad interval")
        .when(end - start < least, "too short").when(end > 1.05 * total, "past the end")
    )


def apply_edits(rows: DataFrame, edits: DataFrame, key: str, field: str, allowed: tuple[str, ...], room: Column) -> DataFrame:
    """rows with the edit of their key applied where it is allowed and fits; accepted tells which (null: no edit)."""
    e = edits.select(F.col(key).alias("_k"), F.col("field").alias("_f"), F.col("value").alias("_v"))
    j = rows.join(e, (rows[key] == F.col("_k")) & (F.col("_f") == field), "left")
    ok = F.col("_f").isin(*allowed) & (F.length("_v") <= room)
    return j.withColumn("accepted", F.when(F.col("_v").isNotNull(), F.coalesce(ok, F.lit(False)))).withColumn(field, F.when(F.col("accepted"), F.col("_v")).otherwise(F.col(field))).select(*rows.columns, "accepted")


def equal_length_fixes(lines: DataFrame, fixes: DataFrame, key: str) -> DataFrame:
    """Corrections are taken only if they keep the text's length."""
    f = fixes.select(F.col(key).alias("_k"), F.col("text").alias("_t"))
    j = lines.join(f, lines[key] == F.col("_k"), "left")
    ok = F.coalesce(F.length("_t") == F.length("text"), F.lit(False))
    return j.select(*[c for c in lines.columns if c != "text"], F.when(ok, F.col("_t")).otherwise(F.col("text")).alias("text"), (ok & (F.col("_t") != F.col("text"))).alias("fixed"))


def trim_to_budget(text: Column, budget: int, least: int = 8) -> Column:
    """At most budget characters, cut after the last punctuation that leaves at least ``least`` of them."""
    head = F.substring(text, 1, budget)
    cut = F.regexp_extract(head, rf"(?s)^(.{{{least - 1},}}[。！？；，,.!?;])", 1)
    return F.when(F.length(text) <= budget, text).when(cut != "", cut).otherwise(head)


def probe_order(jobs: DataFrame, keys: list[str], largest: list[str], tie: str, most: int) -> DataFrame:
    """jobs with probed: whether a job is among the group's first so many, the largest first."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in largest], tie))
    return jobs.withColumn("probed", rank <= most)
