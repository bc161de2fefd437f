"""Frame, colour and audio statistics: vectorised Python over binary and array columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType


def difference_hash(gray: bytes | None) -> int | None:
    """64 bits of an 8 x 9 grey image: each pixel against its right neighbour, row by row."""
    if gray is None or len(gray) != 72:
        return None
    x = np.frombuffer(gray, np.uint8).reshape(8, 9)
    return int(np.packbits(x[:, 1:] > x[:, :-1]).view(">i8")[0])


def frame_hash(gray: Column) -> Column:
    @F.pandas_udf(LongType())
    def run(g: pd.Series) -> pd.Series:
        return g.map(difference_hash).astype("Int64")

    return run(gray)


def level_db(samples: Column) -> Column:
    """Mean level of samples in -1..1, in decibels; null without samples, -120 for silence."""
    n = F.size(samples)
    power = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x) / n
    return F.when(n > 0, F.greatest(F.lit(-120.0), 10 * F.log10(F.greatest(power, F.lit(1e-12)))))


#: Window and step in samples, share of the loudest frame that counts as voice, and what stands in for nothing.
STFT_SIZE, STFT_HOP, VOICED, NOTHING = 2048, 512, 0.05, 1e-10


def flatness_median(samples: np.ndarray) -> float | None:
    """Median spectral flatness of the voiced frames: the geometric mean of a frame's power over its arithmetic mean.

    1.0 where no frame is voiced; null for less than one window. Silent frames are left out before any spectrum is made.
    """
    x = np.asarray(samples, dtype=np.float64)
    if len(x) < STFT_SIZE:
        return None
    begins = np.arange(0, len(x) - STFT_SIZE + 1, STFT_HOP)
    energy = np.concatenate(([0.0], np.cumsum(x * x)))
    loudness = np.sqrt(np.maximum(energy[begins + STFT_SIZE] - energy[begins], 0) / STFT_SIZE)
    chosen = begins[loudness > max(VOICED * loudness.max(), NOTHING)]
    if not len(chosen):
        return 1.0
    taper, per_frame = np.hanning(STFT_SIZE), []
    for lo in range(0, len(chosen), 256):  # a bounded number of spectra at a time
        at = chosen[lo : lo + 256, None] + np.arange(STFT_SIZE)
        power = np.square(np.abs(np.fft.rfft(x[at] * taper)))
        per_frame.append(np.exp(np.mean(np.log(power + NOTHING), axis=-1)) / (np.mean(power, axis=-1) + NOTHING))
    return float(np.median(np.concatenate(per_frame)))


def spectral_flatness(samples: Column) -> Column:
    @F.pandas_udf(DoubleType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else flatness_median(v)).astype("float64")

    return run(samples)


CLUSTERS = ArrayType(StructType([StructField("color", StringType()), StructField("share", DoubleType())]))


def median_cut(rgb: np.ndarray, most: int = 6) -> list[tuple[str, float]]:
    """Colours of pixels by median cut, each box's mean and its share, the largest first."""
    boxes = [rgb] if len(rgb) else []
    while len(boxes) < most:
        k = max(range(len(boxes)), key=lambda i: (int(np.ptp(boxes[i], axis=0).max()) * len(boxes[i]), -i), default=None)
        if k is None or np.ptp(boxes[k], axis=0).max() == 0:
            break
        box = boxes.pop(k)
        axis = int(np.ptp(box, axis=0).argmax())
        box = box[np.argsort(box[:, axis], kind="stable")]
        cut = min(max(1, len(box) // 2), len(box) - 1)
        boxes += [box[:cut], box[cut:]]
    pixels: dict[str, int] = {}
    for b in boxes:  # boxes of one colour are one
        color = "#%02x%02x%02x" % tuple(int(round(c)) for c in b.mean(axis=0))
        pixels[color] = pixels.get(color, 0) + len(b)
    return sorted(((c, n / len(rgb)) for c, n in pixels.items()), key=lambda c: (-c[1], c[0]))


def color_clusters(pixels: Column, most: int = 6) -> Column:
    """array<struct<color, share>> of packed RGB bytes."""

    @F.pandas_udf(CLUSTERS)
    def run(p: pd.Series) -> pd.Series:
        return p.map(lambda b: [] if not b else [{"color": c, "share": s} for c, s in median_cut(np.frombuffer(b[: len(b) // 3 * 3], np.uint8).reshape(-1, 3), most)])

    return run(pixels)


def sample_grid(df: DataFrame, duration: str, fps: float, extra: str | None = None) -> DataFrame:
    """One row per sample time: the grid of fps up to the duration, and extra times, each once and in order."""
    n = F.floor(F.col(duration) * fps).cast("int")
    grid = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.round(i / fps, 3))
    grid = F.filter(grid, lambda x: x < F.col(duration))
    times = grid if extra is None else F.concat(grid, F.filter(extra, lambda x: (x >= 0) & (x < F.col(duration))))
    return df.withColumn("t", F.explode(F.array_sort(F.array_distinct(times))))


def best_source(hits: DataFrame, key: str, windowed: str = "windowed", dist: str = "mean_dist", hit: str = "hit", full_above: float = 6.0, margin: float = 4.0) -> DataFrame:
    """One row per key: the best windowed match, unless its distance is above a limit and a full search wins by a margin."""
    rank = F.struct(F.col(hit).cast("int"), -F.col(dist))
    row = F.struct(*hits.columns)
    per = hits.groupBy(key, windowed).agg(F.max_by(row, rank).alias("r"))
    near, far = (per.filter(F.col(windowed) == w).select(key, F.col("r").alias(n)) for w, n in ((True, "near"), (False, "far")))
    both = near.join(far, key, "full_outer")
    take_far = F.col("near").isNull() | (F.col("far").isNotNull() & (F.col(f"near.{dist}") > full_above) & (F.col(f"near.{dist}") - F.col(f"far.{dist}") > margin))
    return both.select(F.when(take_far, F.col("far")).otherwise(F.col("near")).alias("r")).select("r.*")


def cascade(*options: tuple[str, Column]) -> Column:
    """struct<locator, value>: the first option that has a value, else "generate"."""
    out = None
    for name, value in options:
        case = F.struct(F.lit(name).alias("locator"), value.alias("value"))
        out = F.when(value.isNotNull(), case) if out is None else out.when(value.isNotNull(), case)
    return out.otherwise(F.struct(F.lit("generate").alias("locator"), F.lit(None).alias("value")))


def neighbour_window(df: DataFrame, keys: list[str], order: str, placed: str, start: str, pad: float = 8.0) -> DataFrame:
    """lo, hi: where a row's place should lie, from the nearest placed rows before and after it."""
    up = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    at = F.when(F.col(placed).isNotNull(), F.struct(F.col(start).alias("s"), F.col(placed).alias("p")))
    x = df.withColumn("_b", F.last(at, ignorenulls=True).over(up)).withColumn("_a", F.first(at, ignorenulls=True).over(down))
    lo = F.col("_b.p") + (F.col(start) - F.col("_b.s")) - pad
    hi = F.col("_a.p") - (F.col("_a.s") - F.col(start)) + pad
    return x.withColumn("lo", F.greatest(lo, F.lit(0.0))).withColumn("hi", hi).drop("_b", "_a")


def relevant(anchors: DataFrame, wanted: Column, shots: str = "shots") -> DataFrame:
    """Anchors for all shots (an empty list) or for one of those wanted."""
    return anchors.filter((F.size(shots) == 0) | F.arrays_overlap(shots, wanted))


def fill_gaps(parts: DataFrame, keys: list[str], order: str, total: str, start: str = "start", end: str = "end") -> DataFrame:
    """parts with rows (filled = true) for the stretches of 0..total that no part covers."""
    w = Window.partitionBy(*keys).orderBy(start, order)
    upto = F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(parts.schema[end].dataType))
    last = F.lead(start).over(w).isNull()
    x = parts.withColumns({"_u": upto, "_last": last, "_top": F.max(end).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    gaps = F.filter(F.array(F.when(F.col(start) > F.col("_u"), F.struct(F.col("_u").alias("s"), F.col(start).alias("e"))), F.when(F.col("_last") & (F.col("_top") < F.col(total)), F.struct(F.col("_top").alias("s"), F.col(total).cast(parts.schema[end].dataType).alias("e")))), lambda g: g.isNotNull())
    g = x.select(*keys, order, total, F.explode(gaps).alias("_gap")).select(*keys, order, total, F.col("_gap.s").alias(start), F.col("_gap.e").alias(end), F.lit(True).alias("filled"))
    return parts.withColumn("filled", F.lit(False)).unionByName(g, allowMissingColumns=True)


def snap_to_cuts(parts: DataFrame, cuts: str, at: str) -> DataFrame:
    """at moved to the nearest legal cut (the smaller of two equally near); unchanged without cuts."""
    near = F.array_min(F.transform(cuts, lambda c: F.struct(F.abs(c - F.col(at)).alias("d"), c.alias("c"))))
    return parts.withColumn(at, F.coalesce(near["c"], F.col(at)))


def within_budget(df: DataFrame, keys: list[str], order: str, value: str, asked: Column, most: int) -> DataFrame:
    """df where value stays for the first so many rows of a group that ask for it, and is null for the others: what a budget of calls allows."""
    n = F.count_if(F.coalesce(asked, F.lit(False))).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_n", n).withColumn(value, F.when(F.coalesce(asked, F.lit(False)) & (F.col("_n") <= most), F.col(value))).drop("_n")
